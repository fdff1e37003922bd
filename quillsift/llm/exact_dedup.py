"""Exact dedup by two passes over a Bloom filter, in DataFrame functions only.

First pass: every row sets a few cells of one 32,768-bit bucket of a Bloom filter; cells that two rows or more have
set are kept as bitmaps. Second pass: a row whose cells are all kept is possibly a repeat. Only those rows shuffle, to
be grouped by the SHA-256 of their normalised text; the others are unique and pass straight through.

The passes work on narrow rows (id and digest), written in ranges of the digest of at most RANGE_ROWS rows, about; each
range has a filter of its own, so that what is broadcast at a time has a bound (16 bits a row) at every size of table.

Defined results: a null text counts as empty; a null doc_id is larger than any other; of rows that share the smallest
doc_id and the text, one stays; an empty table gives an empty result; columns that clash with added ones are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Filter, new_folder, prepare, spare, without, written

BUCKET_BITS = 32768
#: Cells of the filter for each row and cells that each row sets: about 0.5 % of unique rows pass the second pass.
BITS_PER_ROW = 16
CELLS = 3
#: Rows of one range: its filter has 64 MB.
RANGE_ROWS = 32 << 20

ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha): the narrow rows that the two passes work on."""
    return docs.select(F.col(id_col).alias("doc_id"), sha(F.col(text_col)).alias("sha"))


def _number(sha: Column, at: int, n: int) -> Column:
    """n bytes of a digest as a number."""
    return F.conv(F.hex(F.substring(sha, at, n)), 16, 10).cast("long")


def _cells(sha: Column, buckets: int) -> tuple[Column, list[Column]]:
    """The bucket of a digest and its bit places there, from disjoint parts of the digest."""
    return F.pmod(_number(sha, 1, 7), F.lit(buckets)), [F.pmod(_number(sha, 8 + 2 * i, 2), F.lit(BUCKET_BITS)) for i in range(CELLS)]


def bloom_filter(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, bits): the cells that at least two rows have set, a bitmap of 4 KB for each bucket."""
    bucket, places = _cells(F.col("sha"), buckets)
    # cells, not rows, are counted, and first in their own task: a text that a third of all rows have is a few cells here
    cells = rows.select(bucket.alias("bucket"), F.explode(F.array_distinct(F.array(*places))).alias("place"))
    twice = cells.groupBy("bucket", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def possibly_repeated(rows: DataFrame, buckets: int, bits: DataFrame) -> DataFrame:
    """The rows with boolean _maybe: whether the filter (RANGE_ROWS bounds it) has all of their cells."""
    bucket, places = _cells(F.col("sha"), buckets)

    def held(place: Column) -> Column:
        octet = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.bit_get(octet, F.pmod(place, F.lit(8)).cast("int")) == 1

    joined = rows.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket", "left")
    maybe = reduce(Column.__and__, map(held, places), F.col("bits").isNotNull())
    return joined.select(*rows.columns, F.coalesce(maybe, F.lit(False)).alias("_maybe"))


def mark(rows: DataFrame, total: int) -> DataFrame:
    """(doc_id, sha) of `total` rows to (doc_id, sha, keep_id, group_size, kept), a row for each row."""
    ranges = max(1, -(-total // RANGE_ROWS))
    path, spark = new_folder(rows.sparkSession, "digests"), rows.sparkSession
    # written by each task for itself: nothing shuffles
    rows.withColumn("part", F.pmod(_number(F.col("sha"), 17, 6), F.lit(ranges))).write.partitionBy("part").parquet(path)
    out = []
    for part in range(ranges):
        own = spark.read.schema(rows.schema).parquet(f"{path}/part={part}") if total else rows
        buckets = max(1, -(-total * BITS_PER_ROW // (BUCKET_BITS * ranges)))
        flagged = possibly_repeated(own, buckets, bloom_filter(own, buckets))
        once = flagged.where(~F.col("_maybe")).select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        maybe = written(flagged.where("_maybe").select("doc_id", "sha"), "maybe")
        groups = maybe.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        # a join of two scans: the adaptive skew join splits a text that very many rows have
        more = maybe.join(written(groups, "groups"), "sha").withColumn("_least", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        first = more.where("_least").groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out += [once, _one_of_equals(more, first)]
    return reduce(DataFrame.unionByName, out)


def _one_of_equals(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """kept: a text's smallest doc_id; where several rows (`shared`) have both, the first of them as written."""
    columns = ["doc_id", "sha", "keep_id", "group_size"]
    if shared.isEmpty():
        return rows.select(*columns, F.col("_least").alias("kept"))
    at = F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    rows = written(rows, "least").withColumn("_at", at)
    first = written(rows.where("_least").groupBy("sha").agg(F.min("_at").alias("_first")), "first")
    return rows.join(first, "sha").select(*columns, (F.col("_least") & (F.col("_at") == F.col("_first"))).alias("kept"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    prepare(docs.sparkSession)
    marked = mark(digests(docs, id_col, text_col), docs.count())
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeats, with all their columns. Rows of texts that occur once are told by a filter of the repeated
    ones' digests (16 MB at most; beyond it more rows pass) and never shuffle."""
    prepare(docs.sparkSession)
    marked = mark(digests(docs, id_col, text_col), docs.count())
    stay = written(marked.where("group_size > 1 AND kept").select("doc_id", "sha"), "stay")
    hashed = F.xxhash64(sha(F.col(text_col)))
    clear, maybe = Filter(stay.select(F.xxhash64("sha").alias("h")), stay.count()).split(docs, hashed)
    key, copy, own, twin = (spare(docs, n) for n in ("_sha", "_copy", "_stay_id", "_stay_sha"))
    maybe = written(maybe.withColumn(key, sha(F.col(text_col))), "possibly-repeated")
    joined = maybe.join(stay.toDF(own, twin), F.col(key) == F.col(twin), "left")
    alone = joined.where(F.col(twin).isNull())
    # of a text's rows with the id that stays, one; there are no more of them than that id has rows
    same = Window.partitionBy(key).orderBy(F.lit(1))
    first = joined.where(F.col(id_col).eqNullSafe(F.col(own)) & F.col(twin).isNotNull()).withColumn(copy, F.row_number().over(same)).where(F.col(copy) == 1)
    return clear.unionByName(alone.select(*docs.columns)).unionByName(first.select(*docs.columns))
