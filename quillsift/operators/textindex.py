"""An inverted index of grams that follows its documents batch by batch.

The index is a folder of segments. Segment `seg-<a>-<b>` holds what batches a to b changed: `versions` (doc, seq, deleted),
the last version of each document that they touched, and `postings` (gram, seq, docs) of its text, sorted by gram: a
gram's documents stand in lists, one for each batch of rows that a task read together. A segment counts from the moment its versions are complete, and no longer once a complete one covers its batches: so a
writer that dies leaves nothing behind that is read, and a merge replaces its parts in one step. Readers merge: a hit
holds unless a later segment has a newer version of its document; a removed document is a version without postings.

A batch that was applied before changes nothing. Batches are numbered upwards, as foreachBatch does it.

Defined results: of several changes of a document in a batch the one with the largest `at` counts, of equal ones a
removal, then the largest text; a null document is left out; a null text is indexed as an empty one.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators import content
from quillsift.operators.gramlists import gram_lists
from quillsift.plans.regexneed import Need
from quillsift.sources.stored import Folder

#: Segments behind the first that are kept before they are merged.
TAIL = 8


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    # ---- segments

    def _complete(self) -> list[tuple[int, int]]:
        found = (re.fullmatch(r"seg-(\d+)-(\d+)", n) for n in self.folder.names())
        return sorted((int(m[1]), int(m[2])) for m in found if m and self.folder.has(f"{m[0]}/versions/_SUCCESS"))

    def segments(self) -> list[tuple[int, int]]:
        """Batches of the segments that count, in order."""
        known = self._complete()
        return [s for s in known if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in known)]

    @property
    def indexed_to(self) -> int:
        """The last batch that the index knows, -1 where there is none."""
        return max((b for _, b in self.segments()), default=-1)

    def _read(self, what: str, segments: list[tuple[int, int]]) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/seg-{a}-{b}/{what}") for a, b in segments]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _write(self, a: int, b: int, postings: DataFrame, versions: DataFrame) -> None:
        at = f"{self.path}/seg-{a}-{b}"
        # documents part a gram that nearly all of them have
        place = ["gram", F.get("docs", F.lit(0))]
        postings.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("overwrite").parquet(f"{at}/postings")
        versions.write.mode("overwrite").parquet(f"{at}/versions")  # the last: from here on the segment counts

    # ---- writing

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Changes (doc, text, deleted, at) of a batch."""
        if batch <= self.indexed_to:
            return
        dead = F.coalesce("deleted", F.lit(False))
        known, seq = changes.where("doc IS NOT NULL").groupBy("doc"), F.lit(batch).cast("long").alias("seq")
        last = known.agg(F.max(F.struct(F.col("at"), dead.alias("deleted"), F.coalesce("text", F.lit("")).alias("text"))).alias("c"))
        lists = gram_lists(last.where("NOT c.deleted").select("doc", "c.text").sortWithinPartitions("doc"), "doc", content.normal(F.col("text")))
        versions = known.agg(F.max(F.struct(F.col("at"), dead.alias("deleted"))).alias("c"))  # no text has to move for these
        self._write(batch, batch, lists.select("gram", seq, F.col("keys").alias("docs")), versions.select("doc", seq, "c.deleted"))

    def follow(self):
        """For foreachBatch."""
        return lambda batch, number: self.apply(batch, number)

    def compact(self, tail_only: bool = False) -> None:
        """Merges all segments into one, or those behind the first. Stale postings go; removals too, where nothing older
        is left that they could hold for. What was merged before is deleted now, and what is merged now the next time."""
        self.vacuum()
        parts = self.segments()[1 if tail_only else 0 :]
        if len(parts) < 2:
            return
        versions = self._read("versions", parts).groupBy("doc").agg(F.max(F.struct("seq", "deleted")).alias("v")).select("doc", "v.*")
        postings = self._without_stale(self._read("postings", parts), parts)
        self._write(parts[0][0], parts[-1][1], postings, versions if tail_only else versions.where("NOT deleted"))

    def vacuum(self) -> None:
        """Deletes segments that others cover."""
        live = self.segments()
        for a, b in set(self._complete()) - set(live):
            self.folder.remove(f"seg-{a}-{b}")

    def maintain(self) -> None:
        """Merges the tail where it has become long, and everything where the tail is no smaller than the first segment."""
        parts = self.segments()
        if len(parts) <= TAIL:
            return
        n = [self._read("versions", p).count() for p in (parts[:1], parts[1:])]
        self.compact(tail_only=n[1] < n[0])

    # ---- reading

    def _current(self, rows: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
        """Rows (doc, seq, ...) without those of which a later segment has a newer version."""
        later = self._read("versions", parts[1:])  # nothing in the first can be newer than another
        if later is None:
            return rows
        newer = later.select(F.col("doc").alias("_doc"), F.col("seq").alias("_seq"))
        return rows.join(newer, (F.col("doc") == F.col("_doc")) & (F.col("seq") < F.col("_seq")), "left_anti")

    def _without_stale(self, lists: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
        """Lists (gram, seq, docs) without the documents of which a later segment has a newer version. Only lists that have
        such documents change; those that are left empty go."""
        versions = self._read("versions", parts)
        stale = versions.join(self._current(versions, parts), ["doc", "seq"], "left_anti").where("NOT deleted").select("doc", "seq")
        place = ["gram", "seq", "_first"]  # a document is in one list of a gram and a version
        lists = lists.withColumn("_first", F.get("docs", F.lit(0)))
        gone = lists.select(*place, F.explode("docs").alias("doc")).join(stale, ["doc", "seq"], "left_semi")
        gone = gone.groupBy(*place).agg(F.collect_list("doc").alias("_gone"))  # no more than a list has
        kept = F.when(F.col("_gone").isNull(), F.col("docs")).otherwise(F.array_except("docs", "_gone"))
        return lists.join(gone, place, "left").select("gram", "seq", kept.alias("docs")).where(F.size("docs") > 0)

    def postings(self) -> DataFrame | None:
        """(gram, doc, seq) of the documents' last versions."""
        parts = self.segments()
        return self._current(self._read("postings", parts).select("gram", F.explode("docs").alias("doc"), "seq"), parts) if parts else None

    def hits(self, need: Need) -> DataFrame | None:
        """Documents whose last indexed version has the grams that a need asks for; None where it asks for none."""
        plan, parts = content.gram_plan(need), self.segments()
        if plan.kind == "any" or not parts:
            return None
        held = content.holding(self._read("postings", parts), plan, doc=F.explode("docs"), seq=F.col("seq"))
        return self._current(held, parts).select("doc")

    def search(self, docs: DataFrame, query: str, changed: DataFrame | None = None, complete: bool = True) -> DataFrame:
        """Rows of docs (doc, text, ...) that match a content search. The index rules documents out; `changed` (doc) are
        those touched since indexed_to, which are read whatever it says, and where they are not completely known all are."""
        ways = content.pattern(query)
        some = self.hits(content.need(ways)) if complete else None
        if some is not None:
            if changed is not None:
                some = some.unionByName(changed.select("doc")).distinct()
            docs = docs.join(some, "doc", "left_semi")
        return docs.where(content.matches(F.col("text"), ways))
