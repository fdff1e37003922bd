"""Files as rows: listings, decoded text, JSON trees, and the difference between a listing and an index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.sources.entries import cut

#: Byte order marks and the encodings they stand for.
BOMS = (("EFBBBF", "UTF-8", 3), ("FFFE", "UTF-16LE", 2), ("FEFF", "UTF-16BE", 2))


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modified, size of all files below a folder, without reading them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", F.unix_timestamp("modificationTime").alias("modified"), F.col("length").alias("size"))


def legacy(content: Column, charset: str) -> Column:
    """Text in a code page that Spark's decode doesn't know; batches go by Arrow."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode(charset, "replace"))

    return decode(content)


def decoded(content: Column, fallback: str = "gbk") -> Column:
    """Text of bytes: by byte order mark, else UTF-8 where valid, else a legacy code page (only those rows go to Python)."""
    out = None
    for mark, charset, n in BOMS:
        hit = F.startswith(F.hex(F.substring(content, 1, 3)), F.lit(mark))
        text = F.decode(F.substring(content, n + 1, 2147483647), charset)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    marked = F.hex(F.substring(content, 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    plain = F.is_valid_utf8(content.cast("string"))
    return out.when(plain, content.cast("string")).otherwise(legacy(F.when(~marked & ~plain, content), fallback))


def texts(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int = 16 << 20) -> DataFrame:
    """path and text of the files below a folder; larger ones are listed with a null text and their size."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", F.col("length").alias("size"), F.when(F.col("length") <= max_bytes, decoded(F.col("content"))).alias("text"))


def reconcile(indexed: DataFrame, listed: DataFrame, key: str = "path") -> DataFrame:
    """What a listing has added, removed or changed against an index: key and change."""
    a = indexed.select(key, F.col("size").alias("_s0"), F.col("modified").alias("_m0"), F.lit(True).alias("_in0"))
    b = listed.select(key, F.col("size").alias("_s1"), F.col("modified").alias("_m1"), F.lit(True).alias("_in1"))
    same = F.col("_s0").eqNullSafe(F.col("_s1")) & F.col("_m0").eqNullSafe(F.col("_m1"))
    change = F.when(F.col("_in0").isNull(), "added").when(F.col("_in1").isNull(), "removed").when(~same, "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def bookmarks(documents: DataFrame, json: str = "json") -> DataFrame:
    """Rows (title, url, folder) of bookmark files, a JSON tree of children, walked a level at a time."""
    node = F.try_parse_json(F.col(json))
    level = documents.select(node.alias("n"), F.lit("").alias("folder"))
    out = None
    while True:
        kids = level.select(F.explode(F.from_json(F.coalesce(F.try_variant_get("n", "$.children", "string"), F.lit("[]")), "array<string>")).alias("c"), F.concat_ws("/", F.nullif("folder", F.lit("")), F.try_variant_get("n", "$.name", "string")).alias("folder"))
        kids = kids.select(F.try_parse_json("c").alias("n"), "folder")
        found = kids.where(F.try_variant_get("n", "$.url", "string").isNotNull()).select(F.try_variant_get("n", "$.name", "string").alias("title"), F.try_variant_get("n", "$.url", "string").alias("url"), "folder")
        out = found if out is None else out.unionByName(found)
        level = cut(kids.where(F.try_variant_get("n", "$.children", "string").isNotNull()).withColumn("n", F.to_json("n")))
        if level.isEmpty():
            return out
        level = level.withColumn("n", F.try_parse_json("n"))
