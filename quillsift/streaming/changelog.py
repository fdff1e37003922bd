"""Which documents changed since a batch: a log that keeps the newest changes and says when it can't tell them all.

Batch n of the log is the folder `batch=<n>` of its distinct documents. Only so many are kept; a mark `floor=<n>` says
that nothing up to n can be told any more. The mark is set before anything is deleted, so that a reader never takes part
of a batch for all of it. A reader that has seen everything up to a batch below the floor gets the flag `complete` as
False and has to look at everything. A new numbering of the documents (`renumbered`) sets the floor as well.

Defined results: a repeated batch writes its folder again and changes nothing; a batch at or below the floor is not
written; null documents are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.sources.stored import Folder

#: Changes that are kept.
MOST = 1 << 19


class ChangeLog:
    def __init__(self, spark: SparkSession, path: str, most: int = MOST):
        self.spark, self.path, self.most, self.folder = spark, path.rstrip("/"), most, Folder(spark, path)

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(m[1]) for m in (re.fullmatch(rf"{kind}=(-?\d+)", n) for n in self.folder.names()) if m)

    @property
    def floor(self) -> int:
        """The last batch of which nothing can be told; -1 where all can."""
        return max(self._numbers("floor"), default=-1)

    def batches(self) -> list[int]:
        return [n for n in self._numbers("batch") if n > self.floor and self.folder.has(f"batch={n}/_SUCCESS")]

    def append(self, changed: DataFrame, batch: int) -> None:
        """The documents (doc) that a batch touches."""
        if batch > self.floor:
            changed.select("doc").where("doc IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def trim(self) -> None:
        """Forgets the oldest batches beyond `most` changes; a batch that has more of them by itself is forgotten too."""
        total, known = 0, self.batches()
        for n in reversed(known):
            total += self.spark.read.parquet(f"{self.path}/batch={n}").count()  # from the files' footers
            if total > self.most:
                self._forget(n)
                return

    def renumbered(self, batch: int) -> None:
        """Documents have other numbers from here on: nothing that was said up to this batch holds."""
        self._forget(batch)

    def _forget(self, batch: int) -> None:
        if batch > self.floor:
            self.folder.mark(f"floor={batch}")
        for n in self._numbers("batch"):
            if n <= batch:
                self.folder.remove(f"batch={n}")
        for n in self._numbers("floor"):
            if n < batch:
                self.folder.remove(f"floor={n}")

    def since(self, batch: int) -> tuple[DataFrame, bool]:
        """The documents touched after a batch, and whether they are all."""
        complete, out = batch >= self.floor, None
        for n in self.batches():
            if n > batch:
                one = self.spark.read.parquet(f"{self.path}/batch={n}")
                out = one if out is None else out.unionByName(one)
        return (self.spark.createDataFrame([], "doc long") if out is None else out.distinct()), complete

    def last(self) -> int:
        """The newest batch that was ever told."""
        return max([self.floor, *self.batches()])

    def follow(self, stream_batch: DataFrame, batch: int) -> None:
        """For foreachBatch: a batch's documents, then what is too much goes."""
        self.append(stream_batch, batch)
        self.trim()


def counted(log: ChangeLog, readers: list[int]) -> DataFrame:
    """(since, complete, changed): what each reader is told that has seen everything up to its batch."""
    out = None
    for r in readers:
        rows, complete = log.since(r)
        one = rows.agg(F.count(F.lit(1)).alias("changed")).select(F.lit(r).alias("since"), F.lit(complete).alias("complete"), "changed")
        out = one if out is None else out.unionByName(one)
    return out
