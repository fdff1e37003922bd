"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import scalars
from quillsift.functions import text as T
from quillsift.operators import content, hierarchy, relate, vectors
from quillsift.plans import query as Q
from quillsift.plans import rank
from quillsift.sources import export, readers
from quillsift.sources.entries import ENTRIES_SQL, from_orders, with_paths
from quillsift.sources.stored import once, stored

NOW = dt.datetime(2001, 9, 1, 12, 0)
QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries relation over orders, written once in a session for each state of its tables: filters on stored columns
    reach its scan, and names are folded once."""
    sources = [f"{sf_dir}/{t}.parquet" for t in ("region", "nation", "customer", "orders")]
    return stored(spark, "entries", sources, lambda: from_orders(spark, sf_dir))


# ---- names --------------------------------------------------------------------------------------------------------

#: Search texts over the entries, and what each means in SQL.
NAME_QUERIES = {
    "name_contains": ("urgent", "contains(name_folded, 'urgent')"),
    "name_two_words": ("order 5-low", "contains(name_folded, 'order') AND contains(name_folded, '5-low')"),
    "name_or_groups": ("urgent pdf | high docx", "(contains(name_folded, 'urgent') AND contains(name_folded, 'pdf')) OR (contains(name_folded, 'high') AND contains(name_folded, 'docx'))"),
    "name_phrase": ('"order 12"', "contains(name_folded, 'order 12')"),
    "name_negation": ("order !medium !low", "contains(name_folded, 'order') AND NOT contains(name_folded, 'medium') AND NOT contains(name_folded, 'low')"),
    "name_wildcard": ("order*7?4-*.pdf", "regexp_matches(name_folded, '^order.*7.4-.*\\.pdf$')"),
    "name_anchor_start": ("^customer", "name_folded LIKE 'customer%'"),
    "name_anchor_end": ("urgent.docx$", "name_folded LIKE '%urgent.docx'"),
    "name_regex": (r"re:^order\s\d*(13|31)\d\s", "regexp_matches(name_folded, '^order\\s\\d*(13|31)\\d\\s')"),
    "path_term": ("asia\\nation_1\\urgent", "contains(name_folded, 'urgent') AND EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(1, len(folders))) AS i, unnest(generate_series(1, len(folders))) AS j0) a, (SELECT unnest(generate_series(1, len(folders))) AS j) b WHERE a.i < b.j AND contains(folders[a.i], 'asia') AND contains(folders[b.j], 'nation_1'))"),
    "path_negated_folder": ("urgent !asia\\", "contains(name_folded, 'urgent') AND NOT len(list_filter(folders, lambda x: contains(x, 'asia'))) > 0"),
    "folder_fallback": ("europe urgent", "(contains(name_folded, 'europe') OR len(list_filter(folders, lambda x: contains(x, 'europe'))) > 0) AND (contains(name_folded, 'urgent') OR len(list_filter(folders, lambda x: contains(x, 'urgent'))) > 0) AND (contains(name_folded, 'europe') OR contains(name_folded, 'urgent'))"),
    "ext_filter": ("ext:pdf;.docx", "NOT is_dir AND ext IN ('pdf', 'docx')"),
    "ext_with_folder_word": ("africa ext:txt", "NOT is_dir AND ext = 'txt' AND (contains(name_folded, 'africa') OR len(list_filter(folders, lambda x: contains(x, 'africa'))) > 0)"),
    "size_range": ("size:10mb..20mb", f"NOT is_dir AND size >= {10 << 20} AND size < {(20 << 20) + 1}"),
    "size_at_least": ("size:30mb size:<40mb", f"NOT is_dir AND size >= {30 << 20} AND size < {40 << 20}"),
    "size_bucket": ("size:huge | size:small", f"NOT is_dir AND ((size >= {16 << 20} AND size < {128 << 20}) OR (size >= {10 << 10} AND size < {100 << 10}))"),
    "date_span": ("dm:1996-02..1996-04", "modified >= 315619200 AND modified >= epoch(TIMESTAMP '1996-02-01') AND modified < epoch(TIMESTAMP '1996-05-01')"),
    "date_after": ("dm:>1998 !txt", "modified >= 315619200 AND modified >= epoch(TIMESTAMP '1999-01-01') AND NOT contains(name_folded, 'txt')"),
    "date_relative": ("dm:6m pdf", "modified >= 315619200 AND modified >= epoch(TIMESTAMP '2001-03-01 12:00:00') AND contains(name_folded, 'pdf')"),
}


def _named(name: str, text: str, where: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.search(entries_of(spark, sf_dir), text, now=NOW).select("id", "name", "path")

    register(name, f"{ENTRIES_SQL} SELECT id, name, path FROM entries WHERE coalesce({where}, FALSE)")(run)


for _name, (_text, _where) in NAME_QUERIES.items():
    _named(_name, _text, _where)


@register(
    "name_score_topk",
    ENTRIES_SQL
    + r""", s AS (
  SELECT *, CASE WHEN contains(name_folded, 'ur') THEN CASE WHEN name_folded LIKE 'ur%' THEN 30
                 WHEN regexp_matches(name, '(?:^|[^A-Za-z0-9\x{80}-\x{10FFFF}]|[0-9]|[\x{80}-\x{10FFFF}])[uU][rR]|[a-z]U[rR]') THEN 18 ELSE 4 END
            ELSE 3 END
          + CASE WHEN contains(name_folded, '12') THEN CASE WHEN name_folded LIKE '12%' THEN 30
                 WHEN regexp_matches(name, '(?:^|[^A-Za-z0-9\x{80}-\x{10FFFF}]|[A-Za-z]|[\x{80}-\x{10FFFF}])12') THEN 18 ELSE 4 END
            ELSE 3 END
          + floor(least(CASE WHEN contains(name_folded, 'ur') THEN 2 ELSE 0 END + CASE WHEN contains(name_folded, '12') THEN 2 ELSE 0 END, strlen(name_folded)) * 25 / strlen(name_folded))::INT
          + CASE WHEN is_dir THEN 2 ELSE 0 END AS score
  FROM entries
  WHERE (contains(name_folded, 'ur') OR len(list_filter(folders, lambda x: contains(x, 'ur'))) > 0)
    AND (contains(name_folded, '12') OR len(list_filter(folders, lambda x: contains(x, '12'))) > 0)
    AND (contains(name_folded, 'ur') OR contains(name_folded, '12')))
SELECT id, name, score FROM s ORDER BY score DESC, coalesce(modified, 0) DESC, id LIMIT 50""",
)
def name_score_topk(spark, sf_dir):
    text = "ur 12"
    ways = Q.parse(text)
    hits = Q.search(entries_of(spark, sf_dir), text).withColumn("score", rank.score(ways)).withColumn("modified", F.coalesce("modified", F.lit(0)))
    return rank.by_match(hits).limit(50).select("id", "name", "score")


@register("sort_size_unknown_last", f"{ENTRIES_SQL} SELECT id, size FROM entries WHERE contains(name_folded, 'order 1') ORDER BY size DESC NULLS LAST, id LIMIT 100")
def sort_size_unknown_last(spark, sf_dir):
    return rank.by(Q.search(entries_of(spark, sf_dir), '"order 1"'), "size", descending=True).limit(100).select("id", "size")


@register("sort_newest", f"{ENTRIES_SQL} SELECT id, modified FROM entries WHERE NOT is_dir ORDER BY CASE WHEN modified >= 315619200 THEN modified END DESC NULLS LAST, id LIMIT 100")
def sort_newest(spark, sf_dir):
    return rank.by(entries_of(spark, sf_dir).where("NOT is_dir"), "modified", descending=True).limit(100).select("id", "modified")


@register("sort_path", f"{ENTRIES_SQL} SELECT id, path FROM entries ORDER BY path, id LIMIT 100")
def sort_path(spark, sf_dir):
    return rank.by(entries_of(spark, sf_dir), "path").limit(100).select("id", "path")


@register(
    "kinds_apart_topk",
    f"""{ENTRIES_SQL}, r AS (SELECT id, is_dir, row_number() OVER (PARTITION BY is_dir ORDER BY id % 97 DESC, coalesce(modified, 0) DESC, id) AS rank FROM entries WHERE contains(name_folded, '00'))
SELECT id, is_dir, rank FROM r WHERE rank <= 20""",
)
def kinds_apart_topk(spark, sf_dir):
    hits = Q.search(entries_of(spark, sf_dir), "00").withColumn("score", F.col("id") % 97).withColumn("modified", F.coalesce("modified", F.lit(0)))
    return rank.top_of_each_kind(hits, 20).select("id", "is_dir", F.col("rank").cast("long").alias("rank"))


@register("paginate_keyset", f"{ENTRIES_SQL} SELECT id, name FROM entries WHERE id > 4000 ORDER BY id LIMIT 30")
def paginate_keyset(spark, sf_dir):
    return rank.page(entries_of(spark, sf_dir), 4000, 30).select("id", "name")


@register(
    "paginate_byte_budget",
    f"{ENTRIES_SQL}, b AS (SELECT id, sum(strlen(path)) OVER (ORDER BY id)::BIGINT AS spent FROM entries) SELECT id, spent FROM b WHERE spent <= 100000",
)
def paginate_byte_budget(spark, sf_dir):
    return rank.within_bytes(entries_of(spark, sf_dir), F.col("path"), 100_000).select("id", F.col("_spent").alias("spent"))


# ---- hierarchy ----------------------------------------------------------------------------------------------------


@register("under_folder", f"{ENTRIES_SQL} SELECT id FROM entries WHERE list_has_any(ancestor_ids, [9, 25])")
def under_folder(spark, sf_dir):
    return entries_of(spark, sf_dir).where(hierarchy.under([9, 25])).select("id")


@register("within_folder", f"{ENTRIES_SQL} SELECT id FROM entries WHERE id IN (16) OR list_has_any(ancestor_ids, [16])")
def within_folder(spark, sf_dir):
    return entries_of(spark, sf_dir).where(hierarchy.within([16])).select("id")


@register("direct_children", f"{ENTRIES_SQL} SELECT id, name FROM entries WHERE parent_id = 9")
def direct_children(spark, sf_dir):
    return entries_of(spark, sf_dir).where(hierarchy.child_of(9)).select("id", "name")


@register("path_prefix", f"{ENTRIES_SQL} SELECT id, path FROM entries WHERE starts_with(lower(path), 'asia\\nation_1')")
def path_prefix(spark, sf_dir):
    return entries_of(spark, sf_dir).where(hierarchy.path_starts("ASIA\\Nation_1")).select("id", "path")


@register("path_tail", f"{ENTRIES_SQL} SELECT id, path FROM entries WHERE lower(path) = 'africa\\nation_5'")
def path_tail(spark, sf_dir):
    return entries_of(spark, sf_dir).where(hierarchy.path_tail(["africa", "nation_5"])).select("id", "path")


@register("folders_of_table", f"{ENTRIES_SQL} SELECT e.id FROM entries e WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_acctbal < 0 AND list_contains(e.ancestor_ids, s.s_nationkey * 8 + 1))")
def folders_of_table(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select((F.col("s_nationkey") * 8 + 1).cast("long").alias("folder_id"))
    return hierarchy.semi_below(entries_of(spark, sf_dir), wanted).select("id")


@register(
    "folder_size_rollup",
    f"""{ENTRIES_SQL}, x AS (SELECT unnest(ancestor_ids) AS folder, size FROM entries WHERE NOT is_dir),
t AS (SELECT folder, sum(size)::BIGINT AS total, count(*) AS files FROM x GROUP BY folder)
SELECT e.id, CASE WHEN t.files IS NULL THEN 0 ELSE t.total END AS total, coalesce(t.files, 0) AS files FROM entries e LEFT JOIN t ON e.id = t.folder WHERE e.is_dir""",
)
def folder_size_rollup(spark, sf_dir):
    return hierarchy.folder_totals(entries_of(spark, sf_dir))


@register("empty_folders", f"{ENTRIES_SQL} SELECT id, name FROM entries e WHERE is_dir AND NOT EXISTS (SELECT 1 FROM entries k WHERE k.parent_id = e.id)")
def empty_folders(spark, sf_dir):
    return hierarchy.empty_folders(entries_of(spark, sf_dir)).select("id", "name")


@register(
    "skip_reason_counts",
    f"""{ENTRIES_SQL}, r AS (SELECT CASE WHEN ext IN ('txt') AND list_has_any(ancestor_ids, [8]) THEN 'both' WHEN ext IN ('txt') THEN 'type' WHEN list_has_any(ancestor_ids, [8]) THEN 'hidden' ELSE 'shown' END AS reason, is_dir FROM entries)
SELECT reason, count(*) FILTER (WHERE NOT is_dir) AS files, count(*) FILTER (WHERE is_dir) AS folders FROM r GROUP BY reason""",
)
def skip_reason_counts(spark, sf_dir):
    return entries_of(spark, sf_dir).withColumn("reason", hierarchy.skip_reason(["txt"], [8])).groupBy("reason").agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("folders"))


@register(
    "path_closure",
    """WITH RECURSIVE nodes AS (SELECT (r_regionkey * 8)::BIGINT AS id, NULL::BIGINT AS parent_id, r_name AS name FROM region UNION ALL SELECT (n_nationkey * 8 + 1)::BIGINT, (n_regionkey * 8)::BIGINT, n_name FROM nation UNION ALL SELECT c_custkey * 8 + 2, (c_nationkey * 8 + 1)::BIGINT, c_name FROM customer),
w AS (SELECT id, name AS path, 0 AS depth FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.id, w.path || '/' || n.name, w.depth + 1 FROM nodes n JOIN w ON n.parent_id = w.id)
SELECT id, path, depth FROM w""",
)
def path_closure(spark, sf_dir):
    nodes = table(spark, sf_dir, "region").selectExpr("bigint(r_regionkey * 8) id", "bigint(null) parent_id", "r_name name")
    nodes = nodes.unionByName(table(spark, sf_dir, "nation").selectExpr("bigint(n_nationkey * 8 + 1) id", "bigint(n_regionkey * 8) parent_id", "n_name name"))
    nodes = nodes.unionByName(table(spark, sf_dir, "customer").selectExpr("c_custkey * 8 + 2 id", "bigint(c_nationkey * 8 + 1) parent_id", "c_name name"))
    return with_paths(nodes).select("id", F.array_join("segments", "/").alias("path"), F.size("ancestor_ids").alias("depth"))


@register(
    "derived_columns",
    ENTRIES_SQL
    + r""", v AS (SELECT *, size / 1024.0 AS k, size / 1048576.0 AS m FROM entries WHERE NOT is_dir)
SELECT id, ext, depth, CASE WHEN size IS NULL THEN NULL WHEN size < 1000 THEN printf('%.0f', size::DOUBLE) || ' B'
  WHEN k < 1000 THEN CASE WHEN k >= 100 THEN printf('%.0f', k::DOUBLE) WHEN k >= 10 THEN printf('%.1f', k::DOUBLE) ELSE printf('%.2f', k::DOUBLE) END || ' KB'
  ELSE CASE WHEN m >= 100 THEN printf('%.0f', m::DOUBLE) WHEN m >= 10 THEN printf('%.1f', m::DOUBLE) ELSE printf('%.2f', m::DOUBLE) END || ' MB' END AS size_text,
  CASE WHEN modified >= 315619200 THEN strftime(to_timestamp(modified) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') END AS modified_iso FROM v""",
)
def derived_columns(spark, sf_dir):
    files = entries_of(spark, sf_dir).where("NOT is_dir")
    iso = F.when(F.col("modified") >= Q.KNOWN_FROM, F.date_format(F.to_utc_timestamp(F.timestamp_seconds("modified"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"))
    return files.select("id", "ext", "depth", F.when(F.col("size").isNotNull(), T.size_text(F.col("size"))).alias("size_text"), iso.alias("modified_iso"))


# ---- joins, windows, sums -----------------------------------------------------------------------------------------


@register(
    "newest_per_folder_capped",
    f"""{ENTRIES_SQL}, a AS (SELECT id, parent_id, modified, ancestor_ids[1] AS tree, row_number() OVER (PARTITION BY parent_id ORDER BY modified DESC, id) AS f FROM entries WHERE NOT is_dir AND modified >= 315619200),
b AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY modified DESC, id) AS t FROM a WHERE f <= 2)
SELECT id, tree, modified FROM b WHERE t <= 12 ORDER BY modified DESC, id LIMIT 40""",
)
def newest_per_folder_capped(spark, sf_dir):
    return relate.newest_capped(entries_of(spark, sf_dir), 2, 12, 40, F.get("ancestor_ids", 0)).select("id", "tree", "modified")


@register("ext_group_counts", f"{ENTRIES_SQL} SELECT ext, count(*) AS files FROM entries WHERE ext IS NOT NULL GROUP BY ext ORDER BY files DESC, ext LIMIT 3")
def ext_group_counts(spark, sf_dir):
    return relate.kinds_of(entries_of(spark, sf_dir))


@register(
    "asof_place",
    """SELECT e.event_id, p.event_id AS place FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup') p
ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'purchase' AND p.event_id IS NOT NULL""",
)
def asof_place(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    right = events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("place"))
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return relate.as_of(left, right, "user_id", "ts", "place").where("place IS NOT NULL").select("event_id", "place")


@register(
    "history_decay",
    """SELECT user_id, event_type, round(sum(pow(2.0, -(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6 / 1209600.0)), 6) AS weight, count(*) AS visits FROM events GROUP BY ALL""",
)
def history_decay(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = relate.decayed(events, F.lit("2024-02-01 00:00:00").cast("timestamp"), 14 * 86400.0, ["user_id", "event_type"])
    return done.select("user_id", "event_type", F.round("weight", 6).alias("weight"), "visits")


@register(
    "affinity_rank",
    """WITH w AS (SELECT user_id AS entity, event_type AS text, sum(pow(2.0, -(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6 / 1209600.0)) AS weight FROM events GROUP BY ALL),
g AS (SELECT entity, CASE WHEN text = 'view' THEN 0 WHEN starts_with(text, 'view') THEN 1 WHEN starts_with('view', text) THEN 2 ELSE 3 END AS "group", weight, text FROM w WHERE weight >= 0.5),
b AS (SELECT entity, "group", round([40, 30, 24, 20]["group" + 1] * log2(1 + least(weight, 15.0)))::BIGINT AS bonus FROM g)
SELECT entity, min("group") AS "group", arg_max(bonus, -"group" * 1000 + bonus) AS bonus FROM b GROUP BY entity""",
)
def affinity_rank(spark, sf_dir):
    weights = relate.decayed(table(spark, sf_dir, "events"), F.lit("2024-02-01 00:00:00").cast("timestamp"), 14 * 86400.0, ["user_id", "event_type"])
    return relate.affinity(weights.select(F.col("user_id").alias("entity"), F.col("event_type").alias("text"), "weight"), "view")


@register(
    "reconcile_full_outer",
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS s FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS s FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'changed' END AS change FROM a FULL OUTER JOIN b ON a.k = b.k)
SELECT path, change FROM j WHERE change IS NOT NULL""",
)
def reconcile_full_outer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = orders.where("o_orderkey % 11 <> 0").selectExpr("o_orderkey path", "o_totalprice size", "0 modified")
    b = orders.where("o_orderkey % 13 <> 0").selectExpr("o_orderkey path", "if(o_orderkey % 7 = 0, o_totalprice + 1, o_totalprice) size", "0 modified")
    return readers.reconcile(a, b)


@register(
    "merge_sources_capped",
    """WITH s AS (SELECT p_brand AS source, p_partkey AS id, p_size AS rank FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, id) AS n FROM s)
SELECT source, id, rank FROM n WHERE n <= 3 ORDER BY rank, source, id LIMIT 40""",
)
def merge_sources_capped(spark, sf_dir):
    return relate.merged(table(spark, sf_dir, "part").selectExpr("p_brand source", "p_partkey id", "p_size rank"), 3, 40)


@register("distinct_first", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def distinct_first(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@register("setop_union", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def setop_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return a.union(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@register("setop_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def setop_intersect(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return a.intersect(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey"))


@register("setop_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def setop_except(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return a.exceptAll(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_custkey").distinct())


@register(
    "anti_dedup_sources",
    "SELECT 'app' AS kind, p_partkey AS id, p_name AS name FROM part WHERE p_size > 40 UNION ALL SELECT 'file', p_partkey, p_name FROM part p WHERE p_size <= 40 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size > 40 AND lower(q.p_name) = lower(p.p_name) AND q.p_brand = p.p_brand)",
)
def anti_dedup_sources(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    apps, files = part.where("p_size > 40"), part.where("p_size <= 40")
    seen = apps.select(F.lower("p_name").alias("n"), F.col("p_brand").alias("b")).distinct()
    rest = files.join(seen, (F.lower("p_name") == F.col("n")) & (F.col("p_brand") == F.col("b")), "left_anti")
    out = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return out(apps, "app").unionByName(out(rest, "file"))


# ---- content ------------------------------------------------------------------------------------------------------

CONTENT_QUERIES = {
    "content_all_words": ("rights reserved the", "contains(lower(text), 'rights') AND contains(lower(text), 'reserved') AND contains(lower(text), 'the')"),
    "content_phrase": ('"all rights reserved"', "contains(lower(text), 'all rights reserved')"),
    "content_dnf": ("licensed cc | pathetic|stupid", "(contains(lower(text), 'licensed') AND contains(lower(text), 'cc')) OR contains(lower(text), 'pathetic') OR contains(lower(text), 'stupid')"),
    "content_regex": (r"regex:licensed\sunder\s[a-z-]+\sby", r"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)licensed\sunder\s[a-z-]+\sby'))) > 0"),
}


def _content(name: str, text: str, where: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").where(content.matches(F.col("text"), content.pattern(text))).select("doc_id", "lang")

    register(name, f"SELECT doc_id, lang FROM documents WHERE coalesce({where}, FALSE)")(run)


for _name, (_text, _where) in CONTENT_QUERIES.items():
    _content(_name, _text, _where)


@register("content_left_out", "SELECT source, count(*) FILTER (WHERE n_chars > 20000) AS over_limit, count(*) FILTER (WHERE n_chars <= 20000 AND lang <> 'en') AS other_kind, count(*) FILTER (WHERE n_chars <= 20000 AND lang = 'en') AS read FROM documents GROUP BY source")
def content_left_out(spark, sf_dir):
    verdict = F.when(F.col("n_chars") > 20000, "over_limit").when(F.col("lang") != "en", "other_kind").otherwise("read")
    docs = table(spark, sf_dir, "documents").select("source", verdict.alias("v"))
    return docs.groupBy("source").agg(*[F.count_if(F.col("v") == v).alias(v) for v in ("over_limit", "other_kind", "read")])


_GRAMS_SQL = r"""
WITH c AS (SELECT DISTINCT sha256(text) AS content_id, regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g') AS t FROM conversations WHERE text IS NOT NULL),
ch AS (SELECT content_id, string_split(t, '') AS a FROM c),
g AS (SELECT DISTINCT content_id, gram FROM (SELECT content_id, unnest(list_transform(range(1, len(a) - 1), lambda i: a[i] || a[i + 1] || a[i + 2])) AS gram FROM ch WHERE len(a) > 2) WHERE regexp_matches(gram, '^[\x20-\x7E]{3}$'))
"""


@register("gram_postings", f"{_GRAMS_SQL} SELECT gram, count(*) AS texts FROM g GROUP BY gram")
def gram_postings(spark, sf_dir):
    distinct, _ = content.contents(table(spark, sf_dir, "conversations"), "conv_id", "text")
    return content.postings(distinct).groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))


def conversation_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the distinct texts, sorted by gram and written once in a session: searches read the grams they ask for."""

    def build(path: str) -> None:
        content.write_postings(content.postings(content.contents(table(spark, sf_dir, "conversations"), "conv_id", "text")[0]), path)

    return spark.read.parquet(once(spark, "postings", [f"{sf_dir}/conversations.parquet"], build))


@register("gram_intersection", f"{_GRAMS_SQL} SELECT content_id FROM g WHERE gram IN ('the', 'her', 'er ', 'ere') GROUP BY content_id HAVING count(*) = 4")
def gram_intersection(spark, sf_dir):
    return content.candidates(conversation_postings(spark, sf_dir), [["ther ", "ere"]])


@register("content_pruned_search", "SELECT DISTINCT sha256(text) AS content_id FROM conversations WHERE contains(lower(text), 'there') AND contains(lower(text), 'and the')")
def content_pruned_search(spark, sf_dir):
    distinct, _ = content.contents(table(spark, sf_dir, "conversations"), "conv_id", "text")
    return content.search(distinct, conversation_postings(spark, sf_dir), 'there "and the"').select("content_id")


@register("dedupe_contents", "SELECT sha256(text) AS content_id, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedupe_contents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content_id")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@register(
    "best_line_argmax",
    r"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
s AS (SELECT *, contains(lower(text), 'the')::INT + contains(lower(text), 'rights')::INT + contains(lower(text), 'for')::INT AS hits,
  regexp_matches(lower(text), '(^|[^a-z0-9])the')::INT + regexp_matches(lower(text), '(^|[^a-z0-9])rights')::INT + regexp_matches(lower(text), '(^|[^a-z0-9])for')::INT AS starts FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY hits DESC, starts DESC, line) AS n FROM s WHERE hits > 0)
SELECT doc, hits, starts, line, text FROM r WHERE n = 1""",
)
def best_line_argmax(spark, sf_dir):
    rows = content.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return content.best_lines(rows, ["the", "rights", "for"]).withColumn("line", F.col("line").cast("long"))


@register(
    "context_lines",
    r"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
s AS (SELECT doc, line, line // 10 AS section, contains(lower(text), 'reserved') AS h FROM l),
w AS (SELECT doc, line, h, max(h) OVER (PARTITION BY doc, section ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS shown FROM s)
SELECT doc, line, h AS is_hit FROM w WHERE shown""",
)
def context_lines(spark, sf_dir):
    rows = content.lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("section", F.floor(F.col("line") / 10))
    return relate.context(rows, F.contains(F.lower("text"), F.lit("reserved")), 1).select("doc", F.col("line").cast("long").alias("line"), "is_hit")


@register(
    "occurrence_counts",
    "SELECT doc_id AS doc, sum(len(string_split(lower(line), 'the')) - 1)::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(lower(line), 'the') GROUP BY doc_id",
)
def occurrence_counts(spark, sf_dir):
    rows = content.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return content.occurrences(rows, ["the"]).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


@register("markup_links", r"SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links, strlen(html) AS bytes FROM pages")
def markup_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("long").alias("links"), F.octet_length("html").cast("long").alias("bytes"))


@register(
    "markup_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style|head)\b.*?</(?:script|style|head)>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(?:br|p|div|li|tr|h[1-6]|article|section|table)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM c""",
)
def markup_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.markup_text(F.col("html")).alias("text"))


@register(
    "clip_search",
    "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'the') AND contains(lower(text), 'of') AND role = 'user' ORDER BY turn, conv_id LIMIT 200",
)
def clip_search(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(F.col("role") == "user").where(content.matches(F.col("text"), content.pattern("the of")))
    return rows.orderBy("turn", "conv_id").limit(200).select("conv_id", "turn", "role")


# ---- vectors ------------------------------------------------------------------------------------------------------


@register(
    "semantic_topk",
    "WITH q AS (SELECT list_transform(range(1, 65), lambda i: ((i * 37) % 11 - 5) / 10.0) AS v) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ((i * 37) % 11 - 5) / 10.0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20",
)
def semantic_topk(spark, sf_dir):
    return vectors.top(table(spark, sf_dir, "embeddings"), [((i * 37) % 11 - 5) / 10.0 for i in range(1, 65)], 20)


@register(
    "semantic_best_per_group",
    """WITH s AS (SELECT label AS file, vec_id AS passage, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ((i * 37) % 11 - 5) / 10.0)), 6) AS score FROM embeddings),
t AS (SELECT * FROM s ORDER BY score DESC, passage LIMIT 100), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, passage) AS k, count(*) OVER (PARTITION BY file) AS n FROM t)
SELECT file, passage, round(score + 0.01 * least(n - 1, 3), 6) AS score FROM r WHERE k = 1""",
)
def semantic_best_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(((i * 37) % 11 - 5) / 10.0) for i in range(1, 65)])
    scored = rows.select(F.col("label").alias("file"), F.col("vec_id").alias("passage"), F.round(vectors.dot(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "passage").limit(100)
    return vectors.best_per_file(scored).withColumn("score", F.round("score", 6))


@register(
    "semantic_best_per_file",
    """WITH s AS (SELECT label AS file, vec_id AS passage, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ((i * 37) % 11 - 5) / 10.0)), 6) AS score FROM embeddings),
t AS (SELECT * FROM s ORDER BY score DESC, passage LIMIT 400), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, passage) AS k, count(*) OVER (PARTITION BY file) AS n FROM t)
SELECT file, passage, round(score + 0.01 * least(n - 1, 3), 6) AS score FROM r WHERE k = 1""",
)
def semantic_best_per_file(spark, sf_dir):
    """The reference's 400 passages (kTopPassages)."""
    q = F.array(*[F.lit(((i * 37) % 11 - 5) / 10.0) for i in range(1, 65)])
    scored = table(spark, sf_dir, "embeddings").select(F.col("label").alias("file"), F.col("vec_id").alias("passage"), F.round(vectors.dot(F.col("embedding"), q), 6).alias("score"))
    return vectors.best_per_file(scored.orderBy(F.desc("score"), "passage").limit(400)).withColumn("score", F.round("score", 6))


@register("semantic_int8_error", "SELECT vec_id, TRUE AS close FROM embeddings")
def semantic_int8_error(spark, sf_dir):
    q = vectors.quantised(F.col("embedding"))
    back = F.transform(q["values"], lambda x: x.cast("double") * q["scale"])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.dot(back, F.col("embedding")).alias("a"), vectors.dot(back, back).alias("b"), vectors.dot(F.col("embedding"), F.col("embedding")).alias("c"))
    return rows.select("vec_id", (F.col("a") / F.sqrt(F.col("b") * F.col("c")) > 0.98).alias("close"))


# ---- kinds, filters, verdicts --------------------------------------------------------------------------------------


@register("type_keyword", f"{ENTRIES_SQL} SELECT id, name FROM entries WHERE NOT is_dir AND ext IN ('csv', 'doc', 'docx', 'md', 'pdf', 'ppt', 'pptx', 'rtf', 'txt', 'xls', 'xlsx') AND contains(name_folded, 'urgent')")
def type_keyword(spark, sf_dir):
    return entries_of(spark, sf_dir).where(Q.with_types("urgent doc:", Q.fields())).select("id", "name")


@register("type_folder", f"{ENTRIES_SQL} SELECT id, name FROM entries WHERE is_dir AND contains(name_folded, 'nation')")
def type_folder(spark, sf_dir):
    return entries_of(spark, sf_dir).where(Q.with_types(":folder nation", Q.fields())).select("id", "name")


@register("quick_filters", f"{ENTRIES_SQL} SELECT id, name FROM entries WHERE contains(name_folded, 'order 2') AND NOT contains(name_folded, 'low') AND NOT is_dir AND size >= {20 << 20}")
def quick_filters(spark, sf_dir):
    saved = {"calm": "!low", "big": "size:20mb", "broken": "re:["}
    return entries_of(spark, sf_dir).where(Q.with_filters("order :calm big: broken:", {**saved}, Q.fields())).where(F.contains("name_folded", F.lit("order 2"))).select("id", "name")


@register("hidden_folders", f"{ENTRIES_SQL} SELECT id FROM entries WHERE NOT list_has_any(CASE WHEN is_dir THEN list_append(folders, name_folded) ELSE folders END, ['asia', 'nation_3', 'customer#000000007'])")
def hidden_folders(spark, sf_dir):
    rules = spark.createDataFrame([("asia",), ("nation_3",), ("customer#000000007",)], "rule string")
    return hierarchy.hidden(rules, entries_of(spark, sf_dir)).select("id")


@register(
    "read_verdicts",
    f"""{ENTRIES_SQL}, v AS (SELECT CASE WHEN size IS NULL THEN 'unknown_size' WHEN size > CASE WHEN ext IN ('docx', 'pdf') THEN {100 << 20} ELSE {16 << 20} END THEN 'too_large' WHEN folders[1] = 'europe' THEN 'low_priority' ELSE 'read' END AS verdict FROM entries WHERE NOT is_dir)
SELECT verdict, count(*) AS files FROM v GROUP BY verdict""",
)
def read_verdicts(spark, sf_dir):
    files = entries_of(spark, sf_dir).where("NOT is_dir")
    return files.withColumn("verdict", hierarchy.read_verdict(F.get("folders", 0) == "europe")).groupBy("verdict").agg(F.count(F.lit(1)).alias("files"))


@register(
    "work_files",
    r"""
WITH n AS (
  SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '.' WHEN 1 THEN '~$' WHEN 2 THEN substr(md5(p_name), 1, 20) || '_' WHEN 3 THEN '2024010112345678' WHEN 4 THEN substr(md5(p_name), 1, 12) || '-' ELSE '' END
         || lower(p_brand) || CASE p_partkey % 7 WHEN 0 THEN '.log' WHEN 1 THEN '.txt' WHEN 2 THEN '.db-wal' WHEN 3 THEN '.bak-old' WHEN 4 THEN '' WHEN 5 THEN '.pdb' ELSE '.docx' END AS name FROM part),
s AS (
  SELECT *, regexp_extract(regexp_replace(name, '\.[^.]*$', ''), '^[0-9a-f]*', 0) AS run, p_partkey % 7 IN (0, 2, 3, 5) AS tool FROM n)
SELECT p_partkey, name FROM s WHERE name LIKE '.%' OR name LIKE '~%' OR (length(run) >= 16 AND regexp_matches(run, '[a-f]')) OR tool
""",
)
def work_files(spark, sf_dir):
    """Names as tools and people make them: hidden ones, lock files, hashes, dates, and extensions of both."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    head, tail = F.lit(""), F.lit(".docx")
    for n, x in enumerate([F.lit("."), F.lit("~$"), F.concat(F.substring(F.md5("p_name"), 1, 20), F.lit("_")), F.lit("2024010112345678"), F.concat(F.substring(F.md5("p_name"), 1, 12), F.lit("-"))]):
        head = F.when(k % 9 == n, x).otherwise(head)
    for n, x in enumerate([".log", ".txt", ".db-wal", ".bak-old", "", ".pdb"]):
        tail = F.when(k % 7 == n, F.lit(x)).otherwise(tail)
    named = part.select("p_partkey", F.concat(head, F.lower("p_brand"), tail).alias("name"))
    return named.where(hierarchy.work_file(F.col("name"), T.extension(F.col("name"), F.lit(False)))).select("p_partkey", "name")


@register(
    "all_terms_over_pages",
    "WITH h AS (SELECT conv_id AS file, contains(lower(text), 'there')::INT AS a, contains(lower(text), 'and')::INT AS b FROM conversations) SELECT file, (sum(a) + sum(b))::BIGINT AS hits FROM h GROUP BY file HAVING sum(a) > 0 AND sum(b) > 0",
)
def all_terms_over_pages(spark, sf_dir):
    return content.files_with_all(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), "text"), ["there", "and"])


@register(
    "section_numbers",
    "WITH l AS (SELECT conv_id AS doc, turn AS line, (turn = 0 OR role = 'user')::INT AS c FROM conversations) SELECT doc, line, (sum(c) OVER (PARTITION BY doc ORDER BY line ROWS UNBOUNDED PRECEDING))::BIGINT AS section FROM l",
)
def section_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), "role")
    return relate.sections(rows, (F.col("line") == 0) | (F.col("role") == "user")).select("doc", "line", "section")


@register(
    "content_relevance",
    r"""WITH l AS (SELECT doc_id AS doc, n_chars, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
s AS (SELECT *, contains(lower(text), 'the')::INT + contains(lower(text), 'rights')::INT + contains(lower(text), 'for')::INT AS hits,
  regexp_matches(lower(text), '(^|[^a-z0-9])the')::INT + regexp_matches(lower(text), '(^|[^a-z0-9])rights')::INT + regexp_matches(lower(text), '(^|[^a-z0-9])for')::INT AS starts FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY hits DESC, starts DESC, line) AS n FROM s WHERE hits > 0)
SELECT doc, (CASE WHEN hits = 3 THEN 40 ELSE 15 * (hits - 1) // 2 END + 20 * starts // 3 + floor(least(doc % 3, 3) * 30 / 3)::INT + 15
  + CASE WHEN doc % 400 < 7 THEN 12 WHEN doc % 400 < 30 THEN 8 WHEN doc % 400 < 365 THEN 4 ELSE 0 END + CASE WHEN length(text) > 1000 THEN -35 ELSE 0 END)::INT AS relevance FROM r WHERE n = 1""",
)
def content_relevance(spark, sf_dir):
    best = content.best_lines(content.lines(table(spark, sf_dir, "documents"), "doc_id", "text"), ["the", "rights", "for"])
    return best.select("doc", content.relevance(best, 3, F.col("doc") % 3, F.lit(15), F.col("doc") % 400).alias("relevance"))


@register("text_passages")
def text_passages(spark, sf_dir):
    return vectors.passages(table(spark, sf_dir, "documents"), "doc_id", "text").select("file", "passage", F.length("text").alias("chars"))


@register("gram_fingerprints", f"""{_GRAMS_SQL}, f AS (SELECT c.content_id, sha256(coalesce(string_agg(gram, chr(1) ORDER BY gram), '')) AS fingerprint FROM c LEFT JOIN g ON c.content_id = g.content_id GROUP BY c.content_id)
SELECT fingerprint, count(*) AS copies FROM conversations JOIN f ON sha256(text) = content_id GROUP BY fingerprint""")
def gram_fingerprints(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return rows.groupBy(content.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("copies"))


# ---- scalars, export, streams of changes as tables ---------------------------------------------------------------


@register(
    "hash_encode",
    "SELECT p_partkey, md5(p_name) AS md5, sha1(p_name) AS sha1, sha256(p_name) AS sha256, to_base64(p_name::BLOB) AS base64, upper(hex(p_partkey)) AS hex, bin(p_partkey) AS bin FROM part",
)
def hash_encode(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.md5("p_name").alias("md5"), F.sha1("p_name").alias("sha1"), F.sha2("p_name", 256).alias("sha256"), F.base64(F.encode("p_name", "UTF-8")).alias("base64"), F.hex("p_partkey").alias("hex"), F.bin("p_partkey").alias("bin"))


@register(
    "math_scalars",
    "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS ln, round(sin(radians(p_size)), 6) AS sine, p_size % 7 AS rem, round(pow(p_size, 1.5), 6) AS power, greatest(p_size, 20) AS most, floor(p_retailprice / 7)::BIGINT AS quotient FROM part",
)
def math_scalars(spark, sf_dir):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.sqrt(price), 6).alias("root"), F.round(F.ln(price), 6).alias("ln"), F.round(F.sin(F.radians(size)), 6).alias("sine"), (size % 7).alias("rem"), F.round(F.pow(size, F.lit(1.5)), 6).alias("power"), F.greatest(size, F.lit(20)).alias("most"), F.floor(price / 7).alias("quotient"))


@register("unit_convert", "SELECT p_partkey, round(p_size::DOUBLE * 25.4, 6) AS mm, round(p_size::DOUBLE * 0.45359237, 6) AS kg, round((p_size - 32) / 1.8, 6) AS celsius, round(p_retailprice / 1024, 6) AS kib FROM part")
def unit_convert(spark, sf_dir):
    c = lambda col, a, b: F.round(scalars.convert(F.col(col), a, b), 6)
    return table(spark, sf_dir, "part").select("p_partkey", c("p_size", "in", "mm").alias("mm"), c("p_size", "lb", "kg").alias("kg"), c("p_size", "f", "c").alias("celsius"), c("p_retailprice", "b", "kib").alias("kib"))


@register("json_extract", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@register("url_parts", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))


@register("date_texts", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, epoch_us(ts) // 1000000 AS seconds, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week FROM events")
def date_texts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("seconds"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"))


@register(
    "export_csv_lines",
    "SELECT p_partkey, p_partkey::VARCHAR || ',' || CASE WHEN p_partkey % 3 = 0 THEN chr(39) || '=' || p_name WHEN p_partkey % 3 = 1 THEN chr(34) || p_name || ', ' || chr(34) || chr(34) || 'x' || chr(34) || chr(34) || chr(34) ELSE p_name END AS line FROM part",
)
def export_csv_lines(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(', "x"'))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", export.csv_line([F.col("p_partkey"), name]).alias("line"))


@register(
    "events_apply_log",
    """WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, event_type AS last_type, event_id AS last_event, c AS n_events FROM r WHERE n = 1 AND event_type <> 'error'""",
)
def events_apply_log(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l"), F.count(F.lit(1)).alias("n_events"))
    return last.where("l.event_type <> 'error'").select("user_id", F.col("l.event_type").alias("last_type"), F.col("l.event_id").alias("last_event"), "n_events")


@register("event_window_counts", "SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_window_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


@register(
    "repeat_filter",
    """WITH w AS (SELECT event_id, user_id, event_type, ts FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, time_bucket(INTERVAL '1 day', ts) ORDER BY ts, event_id) AS n FROM w)
SELECT user_id, event_type, epoch(time_bucket(INTERVAL '1 day', ts))::BIGINT AS day, count(*) FILTER (WHERE n <= 3) AS shown, count(*) FILTER (WHERE n > 3) AS suppressed FROM g GROUP BY ALL""",
)
def repeat_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.unix_timestamp(F.date_trunc("day", "ts"))
    n = events.groupBy("user_id", "event_type", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", "event_type", "day", F.least("n", F.lit(3)).alias("shown"), F.greatest(F.col("n") - 3, F.lit(0)).alias("suppressed"))


@register("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search box, end to end: a text to ranked rows."""
    text = "order ext:pdf;docx size:>1mb dm:1996..2000 !low"
    hits = Q.search(entries_of(spark, sf_dir), text, now=NOW).withColumn("score", rank.score(Q.parse(text, now=NOW)))
    return rank.by_match(hits).limit(100).select("id", "path", "size", "modified", "score")


QUERIES["search_flagship"] = flagship
ORACLES["search_flagship"] = f"""{ENTRIES_SQL}, h AS (SELECT id, path, size, modified, (30 + CASE WHEN name_folded = 'order' THEN 60 ELSE 0 END + floor(5 * 25 / strlen(name_folded)))::INT AS score FROM entries
 WHERE NOT is_dir AND ext IN ('pdf', 'docx') AND size >= {(1 << 20) + 1} AND modified >= epoch(TIMESTAMP '1996-01-01') AND modified < epoch(TIMESTAMP '2001-01-01') AND contains(name_folded, 'order') AND NOT contains(name_folded, 'low'))
SELECT id, path, size, modified, score FROM h ORDER BY score DESC, modified DESC, id LIMIT 100"""
