"""What a watcher of folders tells, as a stream, and entries that follow it; and a budget for what a journal takes.

Notices (root, seq, kind, path) come in order for each root: added, removed, renamed_from, renamed_to, modified, overflow.
A watcher that could not keep up says overflow, and then nothing is known of what it missed. So the stream's state keeps
no picture of the tree: notices become touched paths, an overflow touches the whole root, and the entries under touched
paths are replaced by what a listing has there. Applying a batch twice, late or beside another one gives the same entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TOUCHED = "root string, seq long, op string, path string, old_path string"


def _noticed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One root's notices: the first half of a rename waits for the second, also over batches; of several writes to a path
    the last one counts; after an overflow what came before it in the batch needs no telling."""
    half = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    last = set(rows[rows.kind == "modified"].drop_duplicates("path", keep="last").seq)
    out: list[tuple] = []
    for r in rows.itertuples():
        if r.kind == "overflow":
            out, half = [(key[0], r.seq, "rescan", key[0], None)], None
        elif r.kind == "renamed_from":
            half = r.path
            out.append((key[0], r.seq, "remove", r.path, None))  # gone, unless a second half says where to
        elif r.kind == "renamed_to":
            out.append((key[0], r.seq, "rename" if half else "upsert", r.path, half))
            half = None
        elif r.kind == "modified":
            if r.seq in last:
                out.append((key[0], r.seq, "write", r.path, None))
        else:
            out.append((key[0], r.seq, "upsert" if r.kind == "added" else "remove", r.path, None))
    if half:
        state.update((half,))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=["root", "seq", "op", "path", "old_path"])


def touched(notices: DataFrame) -> DataFrame:
    """A stream of notices to what they touch; the state is half a rename for each root."""
    return notices.groupBy("root").applyInPandasWithState(_noticed, TOUCHED, "half string", "append", GroupStateTimeout.NoTimeout)


def _within(rows: DataFrame, paths: DataFrame, how: str) -> DataFrame:
    """Rows (path) at or below one of the paths (how = left_semi), or at none and below none (left_anti): by equality on the
    folders above a path."""
    parts = F.split("path", r"\\")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "\\"))
    hit = rows.select(F.col("path").alias("_path"), F.explode(above).alias("_top")).join(paths.select(F.col("path").alias("_top")).distinct(), "_top", "left_semi").select("_path").distinct()
    return rows.join(hit, F.col("path") == F.col("_path"), how)


def applied(entries: DataFrame, batch: DataFrame, listing: DataFrame) -> DataFrame:
    """entries (path, ...) after a batch of touched paths: what lies there is replaced by what the listing has there. A file
    that was written to and is in no entries is left to the notice that adds it."""
    places = batch.where("op <> 'write'").select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()
    written = batch.where("op = 'write'").select("path").join(entries.where("NOT is_dir").select("path"), "path", "left_semi").distinct()
    stay = _within(entries, places, "left_anti").join(written, "path", "left_anti")
    seen = _within(listing, places, "left_semi")
    fresh = listing.join(written, "path", "left_semi").join(seen.select("path"), "path", "left_anti")
    return stay.unionByName(seen.select(*stay.columns)).unionByName(fresh.select(*stay.columns))


# ---- a budget for a journal


@dataclass
class Budget:
    """Of notable entries so many an hour, an hour beginning with the first entry after the one before is over; of the
    others the first ones, then one every so often. What is left out is counted for the next entry that is taken."""

    notable_an_hour: int = 30
    first: int = 5
    every_ms: int = 600_000
    hour_ms: int = 3_600_000

    def taken(self, state: tuple, notable: bool, at: int) -> tuple[tuple, int | None]:
        """The state after an entry, and how many were left out before it, None where it is left out itself. The state is
        (hour's start, notable ones in it, ordinary ones at the start, time of the last ordinary one, left out); times are in
        microseconds."""
        start, n, first, last, out = state
        if start is None or at - start >= 1000 * self.hour_ms:
            start, n = at, 0
        if notable:
            take = n < self.notable_an_hour
            n += take
        else:
            take = first < self.first or last is None or at - last >= 1000 * self.every_ms
            first, last = (min(first + 1, self.first), at) if take else (first, last)
        return (start, n, first, last, 0 if take else out + 1), out if take else None


NEW = (None, 0, 0, None, 0)
TAKEN = "kind string, seq long, ts timestamp, notable boolean, skipped long"


def _micros(column: pd.Series) -> list[int]:
    return pd.to_datetime(column, utc=True).astype("datetime64[us, UTC]").astype("int64").tolist()


def budgeted(entries: DataFrame, budget: Budget | None = None) -> DataFrame:
    """A stream of entries (kind, seq, ts, notable) to those that a journal takes. The state of a kind is five numbers; a
    kind that is silent for a day after the watermark starts anew."""
    rule = budget or Budget()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, out = tuple(state.get) if state.exists else NEW, []
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        for r, at in zip(rows.itertuples(), _micros(rows.ts)):
            now, skipped = rule.taken(now, bool(r.notable), at)
            if skipped is not None:
                out.append((key[0], r.seq, r.ts, r.notable, skipped))
        state.update(now)
        state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + 86_400_000)
        if out:
            yield pd.DataFrame(out, columns=["kind", "seq", "ts", "notable", "skipped"])

    fields = "start long, n long, first long, last long, skipped long"
    return entries.withWatermark("ts", "1 minute").groupBy("kind").applyInPandasWithState(run, TAKEN, fields, "append", GroupStateTimeout.EventTimeTimeout)


def budgeted_table(entries: DataFrame, budget: Budget | None = None) -> DataFrame:
    """The same for a table: each kind is read once in order, a batch at a time, with five numbers kept."""
    rule = budget or Budget()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now = None, NEW
        for batch in batches:
            rows, keep, skips = batch.to_pandas(), [], []
            for i, (k, notable, at) in enumerate(zip(rows.kind, rows.notable, _micros(rows.ts))):
                if k != kind:
                    kind, now = k, NEW
                now, skipped = rule.taken(now, bool(notable), at)
                if skipped is not None:
                    keep.append(i)
                    skips.append(skipped)
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([*(some.column(some.schema.get_field_index(n)) for n in ("kind", "seq", "ts", "notable")), pa.array(skips, pa.int64())], ["kind", "seq", "ts", "notable", "skipped"])

    rows = entries.select("kind", "seq", "ts", "notable").repartition("kind").sortWithinPartitions("kind", "ts", "seq")
    return rows.mapInArrow(run, TAKEN)

