"""Change journals as streams: repeats dropped, renames paired, the table of entries brought up to date by batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Journal rows: seq, file_id, parent_id, name, reason (create, delete, rename_old, rename_new, data, attr, close).
CHANGE = "file_id long, op string, name string, parent_id long, old_name string, seq long, old_parent long"
WINDOW_MS, COPIES = 10_000, 3


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["file_id", "op", "name", "parent_id", "old_name", "seq", "old_parent"])
    return out.astype({"parent_id": "Int64", "old_parent": "Int64"})


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One file's records in order: a reason counts once until close, rename halves are paired over batches."""
    seen, old, parent = state.get if state.exists else ("", None, None)
    done, out = set(filter(None, (seen or "").split(","))), []
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    for r in rows.itertuples():
        if r.reason == "close":
            done.clear()
        elif r.reason == "rename_old":
            old, parent = r.name, None if pd.isna(r.parent_id) else int(r.parent_id)  # gone, unless a second half says where to
            out.append((key[0], "remove", None, None, old, r.seq, parent))
        elif r.reason == "rename_new":
            out.append((key[0], "rename" if old else "upsert", r.name, r.parent_id, old, r.seq, parent))
            old = parent = None
        elif r.reason not in done:
            done.add(r.reason)
            out.append((key[0], "remove" if r.reason == "delete" else "upsert", r.name, r.parent_id, None, r.seq, None))
    if done or old:
        state.update((",".join(sorted(done)), old, parent))
    elif state.exists:
        state.remove()  # closed: nothing of the file is kept
    if out:
        yield _frame(out)


def changes(journal: DataFrame) -> DataFrame:
    """A journal stream to the changes that it means; state is a few words for each file that is open or half renamed."""
    return journal.groupBy("file_id").applyInPandasWithState(_apply, CHANGE, "seen string, old string, parent long", "append", GroupStateTimeout.NoTimeout)


def last_of_each(batch: DataFrame) -> DataFrame:
    """The last change of each file: applying a batch twice, or a log from its start, gives the same table."""
    return batch.groupBy("file_id").agg(F.max_by(F.struct("op", "name", "parent_id"), "seq").alias("c")).select("file_id", "c.op", "c.name", "c.parent_id")


def applied(entries: DataFrame, batch: DataFrame) -> DataFrame:
    """entries (file_id, name, parent_id) after a batch of changes."""
    last = last_of_each(batch)
    stay = entries.join(last.select("file_id"), "file_id", "left_anti")
    return stay.unionByName(last.where("op <> 'remove'").select("file_id", "name", "parent_id"))


def upsert_to(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: version n + 1 of a table under a path from version n and batch n; a repeated batch writes its
    own version again."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/v={number}") if number else spark.createDataFrame([], "file_id long, name string, parent_id long")
        applied(before, batch).write.mode("overwrite").parquet(f"{path}/v={number + 1}")

    return run


def in_scope(changed: DataFrame, folders: DataFrame) -> DataFrame:
    """Changes (with old_parent) inside watched folders: a rename that leaves them is a removal, one that enters an upsert."""
    new = folders.select(F.col("folder_id").alias("parent_id"), F.lit(True).alias("_new"))
    old = folders.select(F.col("folder_id").alias("old_parent"), F.lit(True).alias("_old"))
    inside = changed.join(new, "parent_id", "left").join(old, "old_parent", "left").where("_new OR _old")
    renamed = F.col("op") == "rename"
    op = F.when(renamed & F.col("_old").isNull(), "upsert").when(renamed & F.col("_new").isNull(), "remove").otherwise(F.col("op"))
    return inside.withColumn("op", op).drop("_new", "_old")


def _repeats(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    opened, shown, hidden = state.get if state.exists else (None, 0, 0)
    if state.hasTimedOut:
        state.remove()
        if hidden:
            yield pd.DataFrame([(key[0], pd.NaT, hidden)], columns=["message", "ts", "suppressed"])
        return
    out = []
    for ts in sorted(t for b in batches for t in b["ts"]):
        at = int(pd.Timestamp(ts).value // 1_000_000)
        if opened is None or at >= opened + WINDOW_MS:
            if hidden:
                out.append((key[0], pd.NaT, hidden))
            opened, shown, hidden = at, 0, 0
        if shown < COPIES:
            shown += 1
            out.append((key[0], ts, 0))
        else:
            hidden += 1
    state.update((opened, shown, hidden))
    state.setTimeoutTimestamp(max(opened + WINDOW_MS, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=["message", "ts", "suppressed"])


def limited(messages: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Of each message the first 3 in a window of 10 s that its first copy opens; then how many were held back."""
    return messages.withWatermark("ts", delay).groupBy("message").applyInPandasWithState(
        _repeats, "message string, ts timestamp, suppressed long", "opened long, shown long, hidden long", "append", GroupStateTimeout.EventTimeTimeout
    )


def limited_table(messages: DataFrame, width_ms: int = WINDOW_MS, copies: int = COPIES) -> DataFrame:
    """The same for a table (message, ts): each message is read once in order, a batch at a time, with three numbers kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        message = opened = None
        shown = hidden = 0
        out: list[tuple] = []
        for batch in batches:
            for m, ts in zip(batch.column("message").to_pylist(), batch.column("ts").cast(pa.int64()).to_pylist()):
                if m != message or ts >= opened + 1000 * width_ms:
                    if hidden:
                        out.append((message, None, hidden))
                    message, opened, shown, hidden = m, ts, 0, 0
                if shown < copies:
                    shown += 1
                    out.append((m, ts, 0))
                else:
                    hidden += 1
            yield told(out)
            out = []
        yield told([(message, None, hidden)] if hidden else [])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64())
        message, ts, suppressed = (pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))
        return pa.record_batch([message, ts.cast(pa.timestamp("us", tz="UTC")), suppressed], ["message", "ts", "suppressed"])

    rows = messages.where("ts IS NOT NULL").select(F.col("message").cast("string").alias("message"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.repartition("message").sortWithinPartitions("message", "ts").mapInArrow(run, "message string, ts timestamp, suppressed long")


def counts(events: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Tumbling counts by type; late rows are let in for a time."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
