"""Registered queries of how results are ordered, arranged and handed out; they join those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.operators import arrange, hierarchy, relate
from quillsift.plans import query as Q
from quillsift.plans import rank
from quillsift.queries import entries_of, register, table
from quillsift.sources import export
from quillsift.sources.entries import ENTRIES_SQL


@register(
    "inside_folder_first",
    f"{ENTRIES_SQL} SELECT id, list_contains(ancestor_ids, 9) AS inside FROM entries WHERE contains(name_folded, 'urgent') ORDER BY inside DESC, CASE WHEN modified >= 315619200 THEN modified END DESC NULLS LAST, id LIMIT 500",
)
def inside_folder_first(spark, sf_dir):
    newest = F.when(F.col("modified") >= Q.KNOWN_FROM, F.col("modified")).desc_nulls_last()
    return arrange.inside_first(Q.search(entries_of(spark, sf_dir), "urgent"), hierarchy.under([9]), [newest, F.asc("id")], 500).select("id", "inside")


@register("sort_folder_order", f"{ENTRIES_SQL} SELECT id, path FROM entries ORDER BY folders, name_folded, id LIMIT 400")
def sort_folder_order(spark, sf_dir):
    return arrange.by_folder(entries_of(spark, sf_dir)).limit(400).select("id", "path")


@register(
    "arranged_results",
    rf"""{ENTRIES_SQL}, hits AS (SELECT *, id % 97 AS score, coalesce(modified, 0) AS m FROM entries WHERE contains(name_folded, 'nation_1') OR contains(name_folded, 'urgent')),
opened AS (SELECT h.id, max(e.ts) AS opened FROM events e JOIN hits h ON h.id = (e.user_id % 25) * 8 + 1 GROUP BY h.id ORDER BY opened DESC, h.id LIMIT 3),
p AS (SELECT h.*, o.opened, CASE WHEN o.opened IS NOT NULL THEN 0
  WHEN name_folded IN ('nation_1', 'order 1 1-urgent') OR (NOT is_dir AND regexp_replace(name_folded, '(.)\.[^.]*$', '\1') IN ('nation_1', 'order 1 1-urgent')) THEN CASE WHEN NOT is_dir AND ext IN ('pdf') THEN 1 ELSE 2 END
  WHEN is_dir THEN 3 ELSE 4 END AS part FROM hits h LEFT JOIN opened o ON h.id = o.id)
SELECT id, name, part FROM p ORDER BY part, opened DESC NULLS LAST, score DESC, m DESC, id LIMIT 200""",
)
def arranged_results(spark, sf_dir):
    """The folders opened last come from the events' users."""
    hits = Q.search(entries_of(spark, sf_dir), "nation_1 | urgent").withColumns({"score": F.col("id") % 97, "modified": F.coalesce("modified", F.lit(0))})
    history = table(spark, sf_dir, "events").select((F.col("user_id") % 25 * 8 + 1).alias("id"), F.col("ts").alias("opened"))
    return arrange.arranged(hits, history, ["nation_1", "Order 1 1-URGENT"], ["pdf"], 200, folders_first=True).select("id", "name", "part")


@register(
    "hits_with_history",
    f"{ENTRIES_SQL} SELECT e.id, max(v.ts) AS opened FROM entries e LEFT JOIN events v ON e.id = (v.user_id % 25) * 8 + 1 WHERE e.is_dir GROUP BY e.id",
)
def hits_with_history(spark, sf_dir):
    history = table(spark, sf_dir, "events").select((F.col("user_id") % 25 * 8 + 1).alias("id"), F.col("ts").alias("opened"))
    return arrange.with_history(entries_of(spark, sf_dir).where("is_dir"), history).select("id", "opened")


@register(
    "newest_per_tree_capped",
    f"""{ENTRIES_SQL}, a AS (SELECT id, modified, ancestor_ids[least(2, len(ancestor_ids))] AS tree, row_number() OVER (PARTITION BY parent_id ORDER BY modified DESC, id) AS f FROM entries WHERE NOT is_dir AND modified >= 315619200),
b AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY modified DESC, id) AS t FROM a WHERE f <= 2)
SELECT id, tree, modified FROM b WHERE t <= 12 ORDER BY modified DESC, id LIMIT 80""",
)
def newest_per_tree_capped(spark, sf_dir):
    return relate.newest_capped(entries_of(spark, sf_dir), 2, 12, 80, arrange.tree_folder()).select("id", "tree", "modified")


@register(
    "type_scoped_folders",
    f"{ENTRIES_SQL} SELECT id FROM entries WHERE list_has_any(ancestor_ids, [8, 16]) AND list_has_any(ancestor_ids, [9, 17, 25, 33, 41, 49, 57, 65])",
)
def type_scoped_folders(spark, sf_dir):
    """Inside the chosen folders and inside those of the chosen type as well."""
    return entries_of(spark, sf_dir).where(hierarchy.under([8, 16])).where(hierarchy.under(list(range(9, 66, 8)))).select("id")


@register(
    "low_priority_rules",
    f"""{ENTRIES_SQL} SELECT id FROM entries WHERE len(list_filter(folders, lambda x: starts_with(x, '.') OR x IN ('nation_3', 'africa'))) > 0
OR (is_dir AND (starts_with(name_folded, '.') OR name_folded IN ('nation_3', 'africa')))""",
)
def low_priority_rules(spark, sf_dir):
    return entries_of(spark, sf_dir).where(arrange.low_priority(["nation_3", "africa"])).select("id")


@register("distinct_name_scan", r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m]\w* \w*[aeiou]\w$')")
def distinct_name_scan(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return arrange.matching_names(part, "p_name", F.col("p_name").rlike(r"^[a-m]\w* \w*[aeiou]\w$"))


@register(
    "contents_to_read",
    f"""{ENTRIES_SQL}, known AS (SELECT o_orderkey * 8 + 3 AS id, epoch(o_orderdate)::BIGINT AS stamp FROM orders WHERE o_orderstatus = 'F')
SELECT e.id, CASE WHEN k.id IS NULL THEN 'new' ELSE 'changed' END AS why FROM entries e LEFT JOIN known k ON e.id = k.id WHERE NOT e.is_dir AND (k.id IS NULL OR k.stamp IS DISTINCT FROM e.modified)""",
)
def contents_to_read(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    known = orders.select((F.col("o_orderkey") * 8 + 3).alias("id"), F.unix_timestamp("o_orderdate").alias("stamp"))
    return arrange.to_read(entries_of(spark, sf_dir), known)


@register("json_lines", f"{ENTRIES_SQL} SELECT to_json({{'id': id, 'name': name, 'ext': ext, 'size': size}})::VARCHAR AS line FROM entries WHERE contains(name_folded, 'urgent')")
def json_lines(spark, sf_dir):
    return export.json_lines(Q.search(entries_of(spark, sf_dir), "urgent").select("id", "name", "ext", "size"))


@register(
    "name_score_full",
    rf"""{ENTRIES_SQL}, s AS (
  SELECT id, name, modified, CASE WHEN starts_with(name_folded, 'urgent') THEN 30 WHEN regexp_matches(name_folded, '[^a-z]urgent') THEN 18 ELSE 4 END
         + CASE WHEN name_folded = 'urgent' THEN 60 WHEN regexp_replace(name_folded, '(.)\.[^.]*$', '\1') = 'urgent' THEN 45 ELSE 0 END
         + floor(least(6, strlen(name_folded)) * 25 / strlen(name_folded))::INT + CASE WHEN is_dir THEN 2 ELSE 0 END
         - CASE WHEN len(list_filter(folders, lambda x: x IN ('nation_3', 'africa'))) > 0 THEN 35 ELSE 0 END
         - CASE WHEN list_contains(ancestor_ids, 25) THEN 15 ELSE 0 END + CASE WHEN NOT is_dir AND ext IN ('pdf') THEN 12 ELSE 0 END - least(depth, 12) AS score
  FROM entries WHERE contains(name_folded, 'urgent'))
SELECT id, name, score FROM s ORDER BY score DESC, coalesce(modified, 0) DESC, id LIMIT 500""",
)
def name_score_full(spark, sf_dir):
    """Places, coverage, priority, hidden folders, preferred types and depth in one score."""
    hits = Q.search(entries_of(spark, sf_dir), "urgent").withColumn("modified", F.coalesce("modified", F.lit(0)))
    low, hidden = arrange.low_priority(["nation_3", "africa"]), hierarchy.under([25])
    whole = rank.entry_score(rank.score(Q.parse("urgent")), low, hidden, ["pdf"], Q.exact_name(Q.parse("urgent"), Q.fields()))
    return rank.by_match(hits.withColumn("score", whole)).limit(500).select("id", "name", "score")
