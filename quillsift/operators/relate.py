"""Joins, windows and sums that searches are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of the last right row of its key at or before it: a union and one window."""
    a = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1))
    b = right.select(key, at, F.col(value).alias("_v")).withColumn("_left", F.lit(0))
    order = Window.partitionBy(key).orderBy(at, "_left")
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(order)).where("_left = 1").drop("_v", "_left")


def newest_capped(entries: DataFrame, per_folder: int, per_tree: int, limit: int, tree: Column) -> DataFrame:
    """The newest files, of each folder and of each tree no more than so many."""
    files = entries.where("NOT is_dir AND modified >= 315619200").withColumn("tree", tree)
    newest = [F.desc("modified"), F.asc("id")]
    one = files.withColumn("_f", F.row_number().over(Window.partitionBy("parent_id").orderBy(*newest))).where(F.col("_f") <= per_folder)
    two = one.withColumn("_t", F.row_number().over(Window.partitionBy("tree").orderBy(*newest))).where(F.col("_t") <= per_tree)
    return two.orderBy(*newest).limit(limit).drop("_f", "_t")


def context(lines: DataFrame, hit: Column, around: int) -> DataFrame:
    """Lines (doc, section, line) within so many of a hit, never across sections."""
    near = Window.partitionBy("doc", "section").orderBy("line").rowsBetween(-around, around)
    return lines.withColumn("is_hit", hit).withColumn("shown", F.max("is_hit").over(near)).where("shown")


def sections(lines: DataFrame, change: Column) -> DataFrame:
    """Numbers sections of a document: a new one where `change` holds."""
    order = Window.partitionBy("doc").orderBy("line")
    return lines.withColumn("section", F.sum(change.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def merged(sources: DataFrame, per_source: int, total: int) -> DataFrame:
    """The first rows of each source by rank, and of all together."""
    own = Window.partitionBy("source").orderBy("rank", "id")
    some = sources.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= per_source)
    return some.orderBy("rank", "source", "id").limit(total).drop("_n")


def decayed(visits: DataFrame, now: Column, half_life_seconds: float, by: list[str]) -> DataFrame:
    """Weights that halve with age: the closed form of adding one and decaying at each visit."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return visits.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -age / half_life_seconds)).alias("weight"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("visits"))


def affinity(weights: DataFrame, typed: str) -> DataFrame:
    """Choices (entity, text, weight) for what is typed now: group 0 the same text, 1 a longer one, 2 a shorter one,
    3 the entity alone; bonus round(scale * log2(1 + min(weight, 15))), scale 40, 30, 24, 20; weights under 0.5 don't
    count."""
    q = F.lit(typed.lower())
    group = F.when(F.col("text") == q, 0).when(F.startswith("text", q), 1).when(F.startswith(q, F.col("text")), 2).otherwise(3)
    scale = F.element_at(F.array(*map(F.lit, (40, 30, 24, 20))), group + 1)
    rows = weights.where("weight >= 0.5").withColumn("group", group).withColumn("bonus", F.round(scale * F.log2(1 + F.least("weight", F.lit(15.0)))).cast("long"))
    best = rows.groupBy("entity").agg(F.min("group").alias("group"), F.max_by("bonus", F.struct(-F.col("group"), "bonus")).alias("bonus"))
    return best


def kinds_of(entries: DataFrame, k: int = 3) -> DataFrame:
    """The commonest extensions and their numbers of files."""
    return entries.where("ext IS NOT NULL").groupBy("ext").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "ext").limit(k)


def capped(history: DataFrame, most: int) -> DataFrame:
    """The entities (entity, last) used last, as many as a history keeps."""
    return history.orderBy(F.desc("last"), "entity").limit(most)
