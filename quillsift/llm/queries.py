"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, decontaminate, divergence, exact_dedup, fill_in_middle, language_id, line_dedup, minhash, ngram_join, packing, quality, toxicity, warc_revisit
from .common import new_folder
from .learning import fold
from .tokens import vocabulary


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_revisit.records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    done = warc_revisit.with_payload(warc_revisit.resolve_revisits(records), records, ["html"])
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return done.select("revisit_id", "canonical_url", F.unix_seconds("warc_date").alias("revisit_time"), F.coalesce("original_id", F.lit(-1)).alias("original_id"), "status", F.array_join(lines, "|").alias("headers"), F.sha2("html", 256).alias("payload_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = documents(spark, sf_dir), fold(F.col("doc_id"), 4)
    done = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs, own != 2))
    return done.select("doc_id", (own == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(documents(spark, sf_dir), k=3, num=85, den=100)


def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op5_bitplane_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "ids")
    files = bitplane.write_ids(documents(spark, sf_dir), path, vocabulary(), end_id=2)
    return bitplane.read_back(spark, path, files)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = documents(spark, sf_dir), fold(F.col("doc_id"), 5)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), own != 0)
    done = toxicity.score(docs.select("doc_id", "text"), model)
    return done.select("doc_id", (own == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(documents(spark, sf_dir))
    return done.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(coalesce(text, ''), 256) AS kept_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir), vocabulary(), end_id=0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = documents(spark, sf_dir), fold(F.col("doc_id"), 3)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), own != 1)
    done = quality.score(docs.select("doc_id", "text"), model)
    return done.select("doc_id", (own == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("fim"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_warc_revisit, op2_language_id, op3_minhash_near_dedup, op4_winnowing_decontamination, op5_bitplane_output, op6_toxicity, op7_line_dedup, op8_exact_dedup, op9_best_fit_packing, op10_quality_classifier, op11_ngram_jaccard_join, op12_fill_in_middle, op13_source_divergence)}

ORACLES = {
    "op1_warc_revisit": r"""
WITH c AS (
  SELECT page_id, html, '"' || md5(coalesce(html, '')) || '"' AS etag, 'hour ' || (page_id // 24)::VARCHAR AS modified,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^www\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)='))), '&') AS query
  FROM c),
k AS (SELECT *, place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS key FROM q),
r AS (SELECT page_id AS original_id, key, page_id * 3600 AS ts, etag, modified, html, 'max-age=' || (page_id % 100)::VARCHAR AS cache FROM k),
v AS (
  SELECT page_id, key, CASE WHEN page_id % 11 = 0 THEN page_id * 3600 - 1800 ELSE page_id * 3600 + 129600 + (page_id % 97) * 86400 END AS ts,
         CASE WHEN page_id % 13 = 0 OR page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'W/"other"' ELSE 'W/' || etag END AS vtag,
         CASE WHEN page_id % 13 <> 0 AND page_id % 5 = 0 THEN modified END AS vmod
  FROM k),
j AS (SELECT v.*, r.original_id, r.etag, r.modified, r.html FROM v ASOF LEFT JOIN r ON v.key = r.key AND v.ts > r.ts),
s AS (
  SELECT *, CASE WHEN original_id IS NULL THEN 'missing'
                 WHEN vtag IS NOT NULL THEN CASE WHEN regexp_replace(vtag, '^W/', '') = etag THEN 'resolved' ELSE 'mismatch' END
                 WHEN vmod IS NOT NULL THEN CASE WHEN vmod = modified THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'unverified' END AS status
  FROM j)
SELECT page_id AS revisit_id, key AS canonical_url, ts AS revisit_time, coalesce(original_id, -1) AS original_id, status,
       CASE WHEN status IN ('resolved', 'unverified') THEN 'cache-control: max-age=0|content-type: text/html|date: ' || page_id::VARCHAR
         || '|etag: ' || coalesce(vtag, etag) || '|last-modified: ' || modified END AS headers,
       CASE WHEN status IN ('resolved', 'unverified') THEN sha256(html) END AS payload_sha256
FROM s
""",
    "op7_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, line, pos, translate(
    regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.line, k.pos, (f.key IS NOT NULL AND k.doc_id <> f.last) AS gone
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op8_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g ON n.text_sha256 = g.text_sha256
""",
    "op11_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END AS s
  FROM w),
t AS (SELECT *, md5(array_to_string(list_sort(s), chr(10))) AS class FROM s),
c AS (SELECT class, min(doc_id) AS id, any_value(s) AS s, any_value(len(s)) AS n FROM t WHERE len(s) > 0 GROUP BY class),
o AS MATERIALIZED (SELECT id, n, hash(unnest(s)) AS h FROM c),
e AS MATERIALIZED (
  SELECT a.id AS u, b.id AS v FROM o a JOIN o b ON a.h = b.h AND a.id <> b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.id, b.id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (
  SELECT u AS node, u AS root FROM e
  UNION
  SELECT e.v AS node, r.root FROM r JOIN e ON r.node = e.u WHERE r.root < e.v),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT t.doc_id, len(t.s) AS n_shingles, coalesce(m.root, c.id, t.doc_id) AS component_id
FROM t LEFT JOIN c ON t.class = c.class AND len(t.s) > 0 LEFT JOIN m ON m.node = c.id
""",
    "op12_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
         sha256('42:' || doc_id::VARCHAR) AS h
  FROM documents),
n AS (
  SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM n),
p AS (
  SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS prefix, coalesce(array_to_string(t[a + 1:b], ''), '') AS middle, coalesce(array_to_string(t[b + 1:], ''), '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM p
""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
o AS (SELECT row, lang, source, unnest(t) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM o GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM k GROUP BY lang),
g AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(any_value(v.v), 0) AS v, coalesce(any_value(v.total), 0) AS every, coalesce(sum(c.n) FILTER (WHERE k.term IS NOT NULL), 0)::BIGINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN k ON k.lang = c.lang AND k.term = c.term
  GROUP BY g.lang, g.source),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (g.every + 5 * g.v) AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce((
    SELECT sum(abs(m.p - o.p)) FROM p m JOIN p o ON m.lang = o.lang AND m.term = o.term WHERE m.lang = x.lang AND m.source = x.source AND o.source = y.source), 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM a)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
""",
}
