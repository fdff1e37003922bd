"""Entries that follow a watcher's notices, against the listing itself; a journal's budget, against counting by hand."""

import datetime as dt
import random

import pytest

from quillsift.streaming import changes
from quillsift.streaming import notices as N

NOTICE = "root string, seq long, kind string, path string"
ENTRY = "path string, is_dir boolean, size long"


class Disk:
    """Two roots of folders and files, and what a watcher says of what happens to them."""

    def __init__(self, rng):
        self.rng, self.paths, self.seq = rng, {"P:": None, "Q:": None}, 0
        for _ in range(25):
            self.act()

    def say(self, kind, path):
        self.seq += 1
        return (path[:2], self.seq, kind, path)

    def below(self, path):
        return [p for p in self.paths if p == path or p.startswith(path + "\\")]

    def act(self):
        rng, folders = self.rng, [p for p, size in self.paths.items() if size is None]
        some = sorted(p for p in self.paths if len(p) > 2)
        new = f"{rng.choice(folders)}\\{rng.choice('abcdef')}{rng.randrange(40)}"
        kind = rng.choice(["folder", "file", "file", "write", "remove", "move"]) if some else "folder"
        if kind in ("folder", "file"):
            if new in self.paths:
                return []
            self.paths[new] = None if kind == "folder" else rng.randrange(100)
            return [self.say("added", new)]
        old = rng.choice(some)
        if kind == "write":
            if self.paths[old] is not None:
                self.paths[old] = rng.randrange(100, 200)
            return [self.say("modified", old)] * 1 + ([self.say("modified", old)] if rng.random() < 0.5 else [])
        if kind == "remove":
            for p in self.below(old):
                del self.paths[p]
            return [self.say("removed", old)]
        if new in self.paths or new.startswith(old + "\\") or new[:2] != old[:2]:
            return []
        for p in self.below(old):
            self.paths[new + p[len(old) :]] = self.paths.pop(p)
        return [self.say("renamed_from", old), self.say("renamed_to", new)]

    def listing(self, spark):
        return spark.createDataFrame([(p, s is None, s) for p, s in self.paths.items()], ENTRY)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_of_notices_ends_as_the_listing(spark, tmp_path, seed):
    rng = random.Random(seed)
    disk, source, state = Disk(rng), tmp_path / "in", tmp_path / "entries"
    source.mkdir()
    disk.listing(spark).write.parquet(str(state / "v=0"))
    version, waiting = 0, []

    def follow(batch, number):
        nonlocal version
        batch.persist()
        before = spark.read.schema(ENTRY).parquet(str(state / f"v={version}"))
        N.applied(before, batch, disk.listing(spark)).write.mode("overwrite").parquet(str(state / f"v={version + 1}"))
        version += 1
        batch.unpersist()

    for step in range(4):
        told = waiting + [n for _ in range(12) for n in disk.act()]
        waiting = []
        if step == 1:  # the watcher loses most of one root's, and says so
            root = [n for n in told if n[0] == "P:"]
            told = [n for n in told if n[0] == "Q:"] + root[:2] + [disk.say("overflow", "P:")]
        if step == 2 and told and told[-1][2] == "renamed_to":  # a rename's halves in two batches
            waiting = [told.pop()]
        spark.createDataFrame(told, NOTICE).coalesce(1).write.mode("append").parquet(str(source))
        stream = N.touched(spark.readStream.schema(NOTICE).parquet(str(source)))
        query = stream.writeStream.foreachBatch(follow).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        if not waiting:
            got = {r.path: r.size for r in spark.read.parquet(str(state / f"v={version}")).collect()}
            assert got == disk.paths, step


def test_a_batch_twice_and_a_write_to_the_unknown(spark):
    entries = spark.createDataFrame([("P:", True, None), ("P:\\a", False, 1), ("P:\\ab", False, 2)], ENTRY)
    listing = spark.createDataFrame([("P:", True, None), ("P:\\a", True, None), ("P:\\a\\x", False, 7), ("P:\\ab", False, 9), ("P:\\new", False, 3)], ENTRY)
    batch = spark.createDataFrame([("P:", 1, "upsert", "P:\\a", None), ("P:", 2, "write", "P:\\ab", None), ("P:", 3, "write", "P:\\new", None)], N.TOUCHED)
    once = N.applied(entries, batch, listing)
    rows = lambda df: sorted((r.path, r.size) for r in df.collect())
    assert rows(once) == [("P:", None), ("P:\\a", None), ("P:\\a\\x", 7), ("P:\\ab", 9)] == rows(N.applied(once, batch, listing))
    rescan = spark.createDataFrame([("P:", 4, "rescan", "P:", None)], N.TOUCHED)
    assert rows(N.applied(once, rescan, listing)) == rows(listing)


def by_hand(rows, notable_an_hour, first, every):
    """Seconds, one kind: what is taken and what was left out before it."""
    out, hour, n, ordinary, last, left = [], None, 0, 0, None, 0
    for at, is_notable in rows:
        if hour is None or at >= hour + 3600:
            hour, n = at, 0
        take = n < notable_an_hour if is_notable else ordinary < first or at >= last + every
        if take:
            out.append((at, left))
            left = 0
            if is_notable:
                n += 1
            else:
                ordinary, last = ordinary + 1, at
        else:
            left += 1
    return out


def journal(rng, n):
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([1, 5, 60, 300, 900])
        rows.append((f"k{i % 3}", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), rng.random() < 0.6))
    return rows


@pytest.mark.parametrize("as_stream", [False, True])
def test_budget(spark, tmp_path, as_stream):
    rows, start = journal(random.Random(4), 900), dt.datetime(2024, 1, 1)
    schema, budget = "kind string, seq long, ts timestamp, notable boolean", N.Budget(notable_an_hour=6, first=3, every_ms=1_200_000)
    if as_stream:
        for part in range(3):
            spark.createDataFrame(rows[300 * part : 300 * part + 300], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = N.budgeted(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), budget)
            query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
            query.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out"))
    else:
        got = N.budgeted_table(spark.createDataFrame(rows, schema).repartition(5), budget)
    for kind in ("k0", "k1", "k2"):
        own = sorted((r.seq, r.skipped) for r in got.where(f"kind = '{kind}'").collect())
        mine = [(i, int((ts - start).total_seconds()), n) for k, i, ts, n in rows if k == kind]
        want = dict(by_hand([(at, n) for _, at, n in mine], 6, 3, 1200))
        assert own == [(i, want[at]) for i, at, _ in mine if at in want] and any(s for _, s in own)
    assert N.budgeted_table(spark.createDataFrame([], schema)).count() == 0


def test_windows_that_a_first_copy_opens(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    times = {"a": [0, 1, 2, 3, 9.9, 10, 11], "b": [5, 5, 5, 5, 30], "c": [1]}
    rows = spark.createDataFrame([(m, at(s)) for m, ts in times.items() for s in ts] + [("c", None)], "message string, ts timestamp").repartition(3)
    got = sorted(((r.message, r.ts, r.suppressed) for r in changes.limited_table(rows).collect()), key=repr)
    want = [("a", at(s), 0) for s in (0, 1, 2, 10, 11)] + [("a", None, 2)] + [("b", at(s), 0) for s in (5, 5, 5, 30)] + [("b", None, 1), ("c", at(1), 0)]
    assert got == sorted(want, key=repr) and changes.limited_table(rows.limit(0)).count() == 0
