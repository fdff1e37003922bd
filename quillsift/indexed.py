"""Registered queries over written indexes: pruned searches, an index that follows changes, and its log."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators import content
from quillsift.operators.textindex import TextIndex
from quillsift.queries import register, table
from quillsift.sources.stored import once, session_folder
from quillsift.streaming import changes
from quillsift.streaming.changelog import ChangeLog, counted
from quillsift.streaming.notices import Budget, budgeted_table


def text_index(spark: SparkSession, sf_dir: str, name: str, key: str) -> TextIndex:
    """The index of a table's texts, built once in a session: batch 0 has all rows."""
    rows = table(spark, sf_dir, name).select(F.col(key).alias("doc"), "text", F.lit(False).alias("deleted"), F.lit(0).alias("at"))
    return TextIndex(spark, once(spark, f"index-{name}", [f"{sf_dir}/{name}.parquet"], lambda path: TextIndex(spark, path).apply(rows, 0)))


#: Searches whose regular expressions prune by grams, and what each means in SQL: all of several literals, one of several
#: ways, both beside a word, and an expression that every text must be read for.
REGEX_QUERIES = {
    "content_regex_all": (r"re:licensed\s+under\s[a-z]+\s\w+\slicen[cs]e", r"{line: (?i)licensed\s+under\s[a-z]+\s\w+\slicen[cs]e}"),
    "content_regex_one_of": (r"re:(all|some)\srights\sreserved|apache\slicen[cs]e", r"{line: (?i)(all|some)\srights\sreserved|apache\slicen[cs]e}"),
    "content_regex_mixed": (r"licensed re:(version|edition)\s\d | re:rights\s+reserved", r"(contains(lower(text), 'licensed') AND {line: (?i)(version|edition)\s\d}) OR {line: (?i)rights\s+reserved}"),
    "content_regex_unpruned": (r"re:\d{3}-\d{4}", r"{line: \d{3}-\d{4}}"),
}


def _lines_sql(where: str) -> str:
    """{line: expression} stands for a line that an expression matches."""
    return re.sub(r"\{line: (.*?)\}(?=$|\)|\s)", lambda m: f"list_bool_or(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, '{m[1]}')))", where)


def _regex(name: str, text: str, where: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs, ways = table(spark, sf_dir, "documents").withColumn("doc", F.col("doc_id")), content.pattern(text)
        if content.gram_plan(content.need(ways)).kind == "any":  # every text must be read: no index is made for that
            return docs.where(content.matches(F.col("text"), ways)).select("doc_id", "lang")
        return text_index(spark, sf_dir, "documents", "doc_id").search(docs, text).select("doc_id", "lang")

    register(name, f"SELECT doc_id, lang FROM documents WHERE coalesce({_lines_sql(where)}, FALSE)")(run)


for _name, (_text, _where) in REGEX_QUERIES.items():
    _regex(_name, _text, _where)


@register(
    "content_regex_candidates",
    """SELECT 'all' AS plan, count(*) AS texts FROM documents WHERE contains(lower(text), 'licensed') AND contains(lower(text), 'under')
UNION ALL SELECT 'one' AS plan, count(*) AS texts FROM documents WHERE contains(lower(text), 'apache') OR contains(lower(text), 'reserved')""",
)
def content_regex_candidates(spark, sf_dir):
    """Texts that hold the literals of a plan, read behind their grams."""
    index, out = text_index(spark, sf_dir, "documents", "doc_id"), None
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    for plan, expression in (("all", r"licensed\s[^,]*under"), ("one", r"apache|reserved")):
        need = content.need([[f"re:{expression}"]])
        read = docs.join(index.hits(need), "doc", "left_semi").where(need.column(F.lower("text")))
        one = read.agg(F.count(F.lit(1)).alias("texts")).select(F.lit(plan).alias("plan"), "texts")
        out = one if out is None else out.unionByName(one)
    return out


#: Three batches of changes to the documents: all of them, then every fifth takes the next one's text, then every
#: seventh goes and every eleventh of these comes back as it was.
_BATCHES_SQL = """
WITH b AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND doc_id % 11 <> 0 THEN NULL WHEN doc_id % 7 = 0 THEN coalesce(text, '')
                      WHEN doc_id % 5 = 0 THEN coalesce(lead(text) OVER (ORDER BY doc_id), '') ELSE coalesce(text, '') END AS text
  FROM documents)"""


def batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    following = docs.select((F.col("doc") - 1).alias("doc"), F.col("text").alias("following"))
    columns = ["doc", "text", F.lit(False).alias("deleted"), F.lit(0).alias("at")]
    first = docs.select(*columns)
    second = docs.where("doc % 5 = 0").join(following, "doc", "left").select("doc", F.col("following").alias("text"), *columns[2:])
    gone = docs.where("doc % 7 = 0").select("doc", F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"), F.lit(0).alias("at"))
    back = docs.where("doc % 77 = 0").select("doc", "text", F.lit(False).alias("deleted"), F.lit(1).alias("at"))
    return [first, second, gone.unionByName(back)]


@register("index_after_changes", _BATCHES_SQL + " SELECT doc_id FROM b WHERE text IS NOT NULL AND contains(lower(text), 'licensed') AND contains(lower(text), 'under')")
def index_after_changes(spark, sf_dir):
    """Batches applied one by one, one of them twice; tail and head merged; read through the grams alone and then checked
    against the texts as they are after the last batch."""

    def build(path: str) -> None:
        index = TextIndex(spark, path)
        for n, batch in enumerate(batches(spark, sf_dir)):
            index.apply(batch, n)
        index.apply(batches(spark, sf_dir)[1], 1)
        index.compact(tail_only=True)

    index = TextIndex(spark, once(spark, "index-changed", [f"{sf_dir}/documents.parquet"], build))
    last = F.max_by(F.struct("text", "deleted"), F.struct("n", "at")).alias("c")
    rows = None
    for n, batch in enumerate(batches(spark, sf_dir)):
        rows = batch.withColumn("n", F.lit(n)) if rows is None else rows.unionByName(batch.withColumn("n", F.lit(n)))
    now = rows.groupBy("doc").agg(last).select("doc", "c.*").where("NOT deleted").select("doc", F.coalesce("text", F.lit("")).alias("text"))
    return index.search(now, "licensed under").select(F.col("doc").alias("doc_id"))


_LOG_SQL = """
WITH y AS (SELECT DISTINCT date_part('year', o_orderdate)::BIGINT - 1995 AS batch, o_custkey AS doc FROM orders),
n AS (SELECT batch, count(*) AS n FROM y GROUP BY batch),
t AS (SELECT batch, sum(n) OVER (ORDER BY batch DESC) AS total FROM n),
f AS (SELECT coalesce(max(batch), -1) AS floor FROM t WHERE total > (SELECT 2 * count(*) FROM customer)),
r AS (SELECT unnest(generate_series(-1, 6)) AS since)
SELECT r.since::INTEGER AS since, r.since >= f.floor AS complete, count(DISTINCT doc) AS changed
FROM r CROSS JOIN f LEFT JOIN y ON y.batch > r.since AND y.batch > f.floor GROUP BY ALL
"""


@register("changed_since", _LOG_SQL)
def changed_since(spark, sf_dir):
    """The customers that a year's orders touch, as a log of batches that keeps twice as many changes as there are customers."""
    years = table(spark, sf_dir, "orders").select((F.year("o_orderdate") - 1995).alias("batch"), F.col("o_custkey").alias("doc")).distinct()
    log = ChangeLog(spark, session_folder(spark, "changes"), most=2 * table(spark, sf_dir, "customer").count())
    path = session_folder(spark, "years")
    years.write.partitionBy("batch").parquet(path)
    for n in range(7):
        log.follow(spark.read.parquet(path).where(F.col("batch") == n), n)
    return counted(log, list(range(-1, 7)))


# ---- a journal's budget

_BUDGET_SQL = """
WITH RECURSIVE e AS (SELECT event_type AS kind, event_id AS seq, ts, coalesce(value, 0) >= 20 AS notable, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
h0 AS (SELECT kind, ts, min(n) AS n FROM e GROUP BY kind, ts),
hn AS MATERIALIZED (SELECT a.kind, a.n, b.n AS next FROM e a ASOF JOIN h0 b ON a.kind = b.kind AND a.ts + INTERVAL 1 HOUR <= b.ts),
hour(kind, n) AS (SELECT kind, n FROM e WHERE n = 1 UNION ALL SELECT hour.kind, hn.next FROM hour JOIN hn ON hn.kind = hour.kind AND hn.n = hour.n),
t AS (SELECT e.*, hour.n AS hour FROM e ASOF JOIN hour ON e.kind = hour.kind AND e.n >= hour.n),
a AS (SELECT kind, n FROM (SELECT *, row_number() OVER (PARTITION BY kind, hour ORDER BY n) AS i FROM t WHERE notable) WHERE i <= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n) AS i FROM e WHERE NOT notable),
o0 AS (SELECT kind, ts, min(i) AS i FROM o GROUP BY kind, ts),
nx AS MATERIALIZED (SELECT a.kind, a.i, b.i AS next FROM o a ASOF JOIN o0 b ON a.kind = b.kind AND a.ts + INTERVAL 30 MINUTE <= b.ts),
w(kind, i) AS (SELECT kind, i FROM o WHERE i = 5 UNION ALL SELECT w.kind, nx.next FROM w JOIN nx ON nx.kind = w.kind AND nx.i = w.i),
k AS (SELECT kind, n FROM a UNION ALL SELECT kind, n FROM o WHERE i < 5 UNION ALL SELECT o.kind, o.n FROM o JOIN w ON w.kind = o.kind AND w.i = o.i)
SELECT kind, seq, ts, notable, n - coalesce(lag(n) OVER (PARTITION BY kind ORDER BY n), 0) - 1 AS skipped FROM k JOIN e USING (kind, n)
"""


@register("journal_budget", _BUDGET_SQL)
def journal_budget(spark, sf_dir):
    """Of each kind of event what a journal takes, and how many were left out before it."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), "ts", F.coalesce(F.col("value") >= 20, F.lit(False)).alias("notable"))
    return budgeted_table(rows, Budget(notable_an_hour=2, every_ms=1_800_000))


@register(
    "repeat_windows",
    """WITH RECURSIVE e AS (SELECT event_type || ' ' || (user_id % 5)::VARCHAR AS message, ts, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts) AS n FROM events),
f AS (SELECT message, ts, min(n) AS n FROM e GROUP BY message, ts),
x AS MATERIALIZED (SELECT a.message, a.n, b.n AS next FROM e a ASOF JOIN f b ON a.message = b.message AND a.ts + INTERVAL 12 HOUR <= b.ts),
w(message, n) AS (SELECT message, n FROM e WHERE n = 1 UNION ALL SELECT w.message, x.next FROM w JOIN x ON x.message = w.message AND x.n = w.n),
t AS (SELECT e.*, row_number() OVER (PARTITION BY e.message, w.n ORDER BY e.n) AS i, w.n AS opened FROM e ASOF JOIN w ON e.message = w.message AND e.n >= w.n)
SELECT message, ts, 0::BIGINT AS suppressed FROM t WHERE i <= 3
UNION ALL SELECT message, NULL AS ts, count(*) AS suppressed FROM t WHERE i > 3 GROUP BY message, opened""",
)
def repeat_windows(spark, sf_dir):
    """Of each message the first three copies in a window that its first one opens, and how many were held back."""
    message = F.concat_ws(" ", "event_type", (F.col("user_id") % 5).cast("string"))
    return changes.limited_table(table(spark, sf_dir, "events").select(message.alias("message"), "ts"), width_ms=12 * 3_600_000)
