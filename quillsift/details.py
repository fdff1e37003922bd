"""Registered queries of refinement, projections, names that are left out, and the history's upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.operators import arrange, content, hierarchy, refine, relate
from quillsift.plans import query as Q
from quillsift.queries import entries_of, register, table
from quillsift.sources import export
from quillsift.sources.entries import ENTRIES_SQL

_LINES = "l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"


def _lines(spark, sf_dir):
    return content.lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@register(
    "content_term_counts",
    f"""WITH {_LINES}, t AS (SELECT doc, line // 10 AS section, text, unnest(['the', 'reserved']) AS term, unnest([0, 1]) AS k FROM l)
SELECT doc, section, k AS term, sum(len(string_split(lower(text), term)) - 1)::BIGINT AS n FROM t WHERE contains(lower(text), term) GROUP BY ALL""",
)
def content_term_counts(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("section", F.floor(F.col("line") / 10))
    return refine.term_counts(rows, ["the", "reserved"])


@register(
    "content_whole_word",
    rf"WITH {_LINES} SELECT doc, line FROM l WHERE regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])The($|[^\p{{L}}\p{{N}}_])')",
)
def content_whole_word(spark, sf_dir):
    return _lines(spark, sf_dir).where(refine.refined(F.col("text"), "The", case=True, whole_word=True)).select("doc", F.col("line").cast("long").alias("line"))


@register("content_documents", "SELECT doc_id, sha256(text) AS content_id FROM documents WHERE contains(lower(text), 'rights') AND contains(lower(text), 'reserved')")
def content_documents(spark, sf_dir):
    distinct, which = content.contents(table(spark, sf_dir, "documents"), "doc_id", "text")
    return refine.documents_of(content.search(distinct, None, "rights reserved"), which).select("doc_id", "content_id")


@register(
    "content_newest",
    "SELECT doc_id, n_chars % 50 AS relevance FROM documents WHERE contains(lower(text), 'the') ORDER BY CASE WHEN doc_id % 7 > 0 AND doc_id <= 500 THEN doc_id END DESC NULLS LAST, n_chars % 50 DESC, doc_id LIMIT 300",
)
def content_newest(spark, sf_dir):
    """The documents have no time, so their number stands for one; of each seventh it is unknown."""
    hits = table(spark, sf_dir, "documents").where(content.matches(F.col("text"), content.pattern("the")))
    dated = hits.select("doc_id", (F.col("n_chars") % 50).alias("relevance"), F.when(F.col("doc_id") % 7 > 0, F.col("doc_id")).alias("modified"))
    return refine.ranked(dated, "doc_id", 500 - refine.DAY, "newest").limit(300).select("doc_id", "relevance")


@register("asked_columns", f"{ENTRIES_SQL} SELECT id, name, ext, size, modified FROM entries WHERE contains(name_folded, 'urgent')")
def asked_columns(spark, sf_dir):
    return export.asked(Q.search(entries_of(spark, sf_dir), "urgent"), 0x01 | 0x08 | 0x10 | 0x40)


@register("long_lines", f"{ENTRIES_SQL} SELECT id, coalesce(size::VARCHAR, '-') || chr(9) || CASE WHEN modified > 0 THEN strftime(make_timestamp(modified * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '-' END || chr(9) || path AS line FROM entries WHERE contains(name_folded, 'urgent')")
def long_lines(spark, sf_dir):
    return Q.search(entries_of(spark, sf_dir), "urgent").select("id", export.long_line().alias("line"))


@register(
    "left_out_counts",
    rf"""{ENTRIES_SQL}, r AS (SELECT NOT is_dir AND (ext IN ('txt') IS TRUE OR regexp_matches(name_folded, '^order .*7 .*$')) AS kind, list_has_any(ancestor_ids, [9, 25]) AS hid FROM entries)
SELECT CASE WHEN kind AND hid THEN 'both' WHEN kind THEN 'type' WHEN hid THEN 'hidden' ELSE 'shown' END AS reason, count(*) AS n FROM r GROUP BY 1""",
)
def left_out_counts(spark, sf_dir):
    reason = hierarchy.left_out(["txt"], ["order *7 *"], [9, 25])
    return entries_of(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("history_capped", "SELECT user_id AS entity, max(ts) AS last, count(*) AS visits FROM events GROUP BY user_id ORDER BY last DESC, entity LIMIT 40")
def history_capped(spark, sf_dir):
    visits = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), "ts")
    return relate.capped(relate.decayed(visits, F.lit("2030-01-01").cast("timestamp"), 14 * 86_400, ["entity"]), 40).select("entity", "last", "visits")


@register(
    "favourites_first",
    f"""{ENTRIES_SQL}, f AS (SELECT DISTINCT (user_id % 25) * 8 + 1 AS id FROM events WHERE event_id % 3 = 0)
SELECT e.id, f.id IS NOT NULL AS favourite FROM entries e LEFT JOIN f ON e.id = f.id WHERE e.is_dir ORDER BY favourite DESC, e.name_folded, e.id LIMIT 100""",
)
def favourites_first(spark, sf_dir):
    marked = table(spark, sf_dir, "events").where("event_id % 3 = 0").select((F.col("user_id") % 25 * 8 + 1).alias("id"))
    rows = arrange.with_favourites(entries_of(spark, sf_dir).where("is_dir"), marked)
    return rows.orderBy(F.desc("favourite"), "name_folded", "id").limit(100).select("id", "favourite")
