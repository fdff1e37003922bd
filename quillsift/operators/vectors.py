"""Vector search: exact scores on float or int8 vectors, best passage per file, and passages of a text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def quantised(vector: Column) -> Column:
    """(values tinyint[], scale): a vector in int8."""
    most = F.array_max(F.transform(vector, F.abs)).cast("double")
    scale = F.when(most > 0, most / 127.0).otherwise(F.lit(1.0))
    return F.struct(F.transform(vector, lambda x: F.round(x.cast("double") / scale).cast("tinyint")).alias("values"), scale.alias("scale"))


def top(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors of largest dot product; each task keeps k rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(dot(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def best_per_file(passages: DataFrame, bonus: float = 0.01, most: int = 3) -> DataFrame:
    """Scored passages (file, passage, score) to files: the best score, a little more for further passages."""
    rows = passages.groupBy("file").agg(F.max("score").alias("best"), F.max_by("passage", F.struct("score", -F.col("passage"))).alias("passage"), F.count(F.lit(1)).alias("n"))
    return rows.select("file", "passage", (F.col("best") + bonus * F.least(F.col("n") - 1, F.lit(most))).alias("score"))


def _passages(target: int, most: int, limit: int | None):
    def cut(text: str) -> list[str]:
        out, now = [], ""
        for line in (text or "").split("\n"):
            if not line.strip():
                if len(now) >= target // 2:
                    out.append(now)
                    now = ""
                continue
            for at in range(0, len(line), most):
                part = line[at : at + most]
                if now and len(now) + len(part) + 1 > most or len(now) >= target:
                    out.append(now)
                    now = ""
                now = f"{now}\n{part}" if now else part
        return ([*out, now] if now else out)[:limit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, p in enumerate(cut(t))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["file", "passage", "text"])

    return run


def passages(docs: DataFrame, key: str, text: str, target: int = 600, most: int = 1000, limit: int | None = None) -> DataFrame:
    """Whole texts in passages of about `target` characters, `most` at most; a blank line may close one.

    Only an explicit `limit` keeps the first passages of a text alone (the reference sends 48 to its embedder)."""
    return docs.select(F.col(key).cast("long"), text).mapInArrow(_passages(target, most, limit), "file long, passage int, text string")
