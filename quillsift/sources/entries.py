"""A hierarchy of entries as one DataFrame, and its adapters.

Columns: id, parent_id, name, name_folded, ext, is_dir, size, modified, created, depth, folders (folded names above,
outermost first), segments (names from the root to the entry), ancestor_ids, path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions.text import extension, folded

SEPARATOR = "\\"


def packed_size(size: Column) -> Column:
    """Sizes are kept as 32-bit floats: exact to 2^24."""
    return size.cast("float").cast("long")


def derived(rows: DataFrame) -> DataFrame:
    """Adds what follows from id, parent_id, name, is_dir, size, modified, created, segments and ancestor_ids."""
    return rows.select(
        "id", "parent_id", "name", folded(F.col("name")).alias("name_folded"), extension(F.col("name"), F.col("is_dir")).alias("ext"), "is_dir",
        packed_size(F.col("size")).alias("size"), "modified", "created", F.size("ancestor_ids").alias("depth"),
        F.transform(F.slice("segments", F.lit(1), F.size("segments") - 1), folded).alias("folders"), "segments", "ancestor_ids",
        F.array_join("segments", SEPARATOR).alias("path"),
    )


def cut(df: DataFrame) -> DataFrame:
    """A level of a walk with its lineage cut: by checkpoint() where the session names a folder for it, else kept."""
    found = df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.sparkContext.getCheckpointDir()
    if not found:
        return df.persist()
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(found)
    return df.checkpoint()


def with_paths(nodes: DataFrame) -> DataFrame:
    """segments and ancestor_ids of nodes (id, parent_id, name, ...): one join a level, until a level is empty.

    Nodes that no root leads to are not listed; a node that lies below itself is an error."""
    level = nodes.where("parent_id IS NULL").withColumn("segments", F.array("name")).withColumn("ancestor_ids", F.array().cast("array<bigint>"))
    out = level
    while True:
        up = level.select(F.col("id").alias("_p"), F.col("segments").alias("_s"), F.col("ancestor_ids").alias("_a"))
        level = nodes.join(up, F.col("parent_id") == F.col("_p")).select(
            *nodes.columns, F.concat("_s", F.array("name")).alias("segments"), F.concat("_a", F.array("_p")).alias("ancestor_ids")
        )
        level = cut(level)
        n, circles = level.agg(F.count(F.lit(1)), F.count_if(F.array_contains("ancestor_ids", F.col("id")))).first()
        if circles:
            raise ValueError("a node lies below itself")
        if not n:
            return out
        out = out.unionByName(level)


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region / nation / customer as folders, orders as files; the two smallest tables have a fixed number of rows."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    none = lambda t: F.lit(None).cast(t)
    folder = lambda df: df.withColumns({"is_dir": F.lit(True), "size": none("long"), "modified": none("long"), "created": none("long")})
    region = read("region").select((F.col("r_regionkey") * 8).cast("long").alias("id"), none("long").alias("parent_id"), F.col("r_name").alias("name"))
    region = folder(region.withColumns({"segments": F.array("name"), "ancestor_ids": F.array().cast("array<bigint>")}))
    nation = read("nation").join(F.broadcast(region.select("id", "name")), F.col("n_regionkey") * 8 == F.col("id")).select(
        (F.col("n_nationkey") * 8 + 1).cast("long").alias("nid"), F.col("id").alias("parent_id"), F.col("n_name").alias("nname"), F.array("name", "n_name").alias("segments"), F.array("id").alias("ancestor_ids")
    ).withColumnsRenamed({"nid": "id", "nname": "name"})
    customer = read("customer").select(F.col("c_custkey"), F.col("c_name"), (F.col("c_nationkey") * 8 + 1).cast("long").alias("p"))
    customer = customer.join(F.broadcast(nation), F.col("p") == F.col("id")).select(
        (F.col("c_custkey") * 8 + 2).alias("id"), F.col("p").alias("parent_id"), F.col("c_name").alias("name"),
        F.concat("segments", F.array("c_name")).alias("segments"), F.concat("ancestor_ids", F.array("p")).alias("ancestor_ids"),
    )
    ext = F.when(F.col("o_orderstatus") == "F", "pdf").when(F.col("o_orderstatus") == "O", "docx").otherwise("txt")
    when = F.when(F.col("o_orderkey") % 50 == 0, F.lit(0)).otherwise(F.unix_timestamp("o_orderdate"))
    orders = read("orders").select(
        (F.col("o_orderkey") * 8 + 3).alias("id"), (F.col("o_custkey") * 8 + 2).alias("parent_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority"), F.lit("."), ext).alias("name"),
        F.lit(False).alias("is_dir"), F.when(F.col("o_orderkey") % 40 != 7, F.floor(F.col("o_totalprice") * 100)).cast("long").alias("size"), when.cast("long").alias("modified"),
    ).withColumn("created", F.when(F.col("modified") > 0, F.col("modified") - 86400).otherwise(F.lit(0).cast("long")))
    up = customer.select(F.col("id").alias("_p"), F.col("segments").alias("_s"), F.col("ancestor_ids").alias("_a"))
    orders = orders.join(up, F.col("parent_id") == F.col("_p")).select(
        *orders.columns, F.concat("_s", F.array("name")).alias("segments"), F.concat("_a", F.array("_p")).alias("ancestor_ids")
    )
    rows = region
    for more in (folder(nation), folder(customer), orders):
        rows = rows.unionByName(more)
    return derived(rows)


#: The same relation in SQL, for the twins of queries.
ENTRIES_SQL = r"""
WITH n0 AS (
  SELECT (r_regionkey * 8)::BIGINT AS id, NULL::BIGINT AS parent_id, r_name AS name, TRUE AS is_dir, NULL::BIGINT AS size0,
         NULL::BIGINT AS modified, NULL::BIGINT AS created, [r_name] AS segments, []::BIGINT[] AS ancestor_ids FROM region),
n1 AS (
  SELECT (n_nationkey * 8 + 1)::BIGINT AS id, n0.id AS parent_id, n_name AS name, TRUE AS is_dir, NULL::BIGINT AS size0,
         NULL::BIGINT AS modified, NULL::BIGINT AS created, [n0.name, n_name] AS segments, [n0.id] AS ancestor_ids
  FROM nation JOIN n0 ON n_regionkey * 8 = n0.id),
n2 AS (
  SELECT c_custkey * 8 + 2 AS id, n1.id AS parent_id, c_name AS name, TRUE AS is_dir, NULL::BIGINT AS size0,
         NULL::BIGINT AS modified, NULL::BIGINT AS created, list_append(n1.segments, c_name) AS segments, list_append(n1.ancestor_ids, n1.id) AS ancestor_ids
  FROM customer JOIN n1 ON c_nationkey * 8 + 1 = n1.id),
o AS (
  SELECT *, 'Order ' || o_orderkey::VARCHAR || ' ' || o_orderpriority || '.' || CASE o_orderstatus WHEN 'F' THEN 'pdf' WHEN 'O' THEN 'docx' ELSE 'txt' END AS oname,
         CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE epoch(o_orderdate)::BIGINT END AS omod
  FROM orders),
n3 AS (
  SELECT o_orderkey * 8 + 3 AS id, n2.id AS parent_id, oname AS name, FALSE AS is_dir,
         CASE WHEN o_orderkey % 40 <> 7 THEN floor(o_totalprice * 100)::BIGINT END AS size0, omod AS modified, CASE WHEN omod > 0 THEN omod - 86400 ELSE 0 END AS created,
         list_append(n2.segments, oname) AS segments, list_append(n2.ancestor_ids, n2.id) AS ancestor_ids
  FROM o JOIN n2 ON o_custkey * 8 + 2 = n2.id),
un AS (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3),
entries AS (
  SELECT id, parent_id, name, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS name_folded,
         CASE WHEN NOT is_dir AND contains(name, '.') THEN nullif(regexp_extract(lower(name), '\.([^.]+)$', 1), '') END AS ext, is_dir,
         size0::FLOAT::BIGINT AS size, modified, created, len(ancestor_ids) AS depth,
         list_transform(segments[1:len(segments) - 1], lambda x: lower(x)) AS folders, segments, ancestor_ids, array_to_string(segments, '\') AS path
  FROM un)
"""
