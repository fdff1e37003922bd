"""Registered queries on what is typed: names by sound, exact names."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.functions.text import extension, folded
from quillsift.operators import arrange, scope
from quillsift.plans import foreign
from quillsift.plans import query as Q
from quillsift.plans import rank
from quillsift.queries import NOW, entries_of, register, table
from quillsift.sources.entries import ENTRIES_SQL

#: Names that parts get by their key, and readings of their characters.
SOUNDING = ["报告.txt", "年度报告.docx", "my报告.md", "报告", "解决.txt", "解.txt", "绿色.png", "重庆.jpg", "A重庆x.jpg", "银行卡.txt", "报告2.txt", "bg报告.txt"]
READINGS = {"报": "bao", "告": "gao", "年": "nian", "度": "du duo", "解": "jie xie", "决": "jue", "绿": "lv", "色": "se shai", "重": "zhong chong", "庆": "qing", "银": "yin", "行": "xing hang", "卡": "ka qia"}

#: Scores by hand, name by name: 26, 16 or 4 for the place, 12 off for a less common reading, 40 for a whole stem, and
#: 25 times the covered bytes over the name's.
_PINYIN_SQL = """
WITH w(i, term, score) AS (VALUES
  (0, 'bg', 26 + 40 + 15), (1, 'bg', 4 + 8), (2, 'bg', 16 + 13), (3, 'bg', 26 + 40 + 25), (10, 'bg', 26 + 13), (11, 'bg', 30 + 4),
  (4, 'xie', 26 - 12 + 7), (5, 'xie', 26 - 12 + 40 + 10), (6, 'lvse', 26 + 40 + 15), (6, 'luse', 26 + 40 + 15),
  (7, 'chongqing', 26 - 12 + 40 + 15), (8, 'chongqing', 16 - 12 + 12), (9, 'yinh', 26 - 12 + 11), (10, 'bg2', 26 + 40 + 15))
SELECT p_partkey, w.term, w.score FROM part JOIN w ON p_partkey % 12 = w.i
"""


def readings_table(spark):
    return spark.createDataFrame([(c, r, i + 1) for c, rs in READINGS.items() for i, r in enumerate(rs.split())], "char string, reading string, place int")


def sounding(spark, sf_dir):
    """Parts as files that are named by their key."""
    names = F.get(F.array(*[F.lit(n) for n in SOUNDING]), F.col("p_partkey") % len(SOUNDING))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.alias("name"), F.lit(False).alias("is_dir"), F.array().cast("array<string>").alias("folders"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("modified"))
    return rows.withColumns({"name_folded": folded(F.col("name")), "ext": extension(F.col("name"), F.col("is_dir"))})


@register("name_score_pinyin", _PINYIN_SQL)
def name_score_pinyin(spark, sf_dir):
    """Several texts over names that are heard once for all of them."""
    texts, f = {t: Q.parse(t) for t in ("bg", "xie", "lvse", "luse", "chongqing", "yinh", "bg2")}, Q.fields(sounds=True)
    rows = Q.heard(sounding(spark, sf_dir), [w for ways in texts.values() for w in ways], readings_table(spark))
    each = F.array(*[F.struct(F.lit(t).alias("term"), F.when(Q.predicate(ways, f), rank.score(ways, f)).alias("score")) for t, ways in texts.items()])
    return rows.select(F.col("id").alias("p_partkey"), F.inline(each)).where("score IS NOT NULL")


_PRIORITIES = ["1-urgent", "2-high", "3-medium", "4-not specified", "5-low"]


@register(
    "name_score_exact",
    f"""{ENTRIES_SQL}, t AS (SELECT unnest({_PRIORITIES}) AS priority), s AS (
  SELECT id, 'order 7 ' || priority AS typed, 30 + 45 + floor(25 * strlen('order 7 ' || priority) / strlen(name))::INT - least(depth, 12)
         + CASE WHEN ext IN ('pdf', 'docx') THEN 12 WHEN folders[1] IN ('asia', 'europe', 'africa', 'america', 'middle east') THEN -35 ELSE 0 END AS score
  FROM entries JOIN t ON NOT is_dir AND regexp_replace(name_folded, '\\.[^.]*$', '') = 'order 7 ' || priority)
SELECT id, typed, score FROM s""",
)
def name_score_exact(spark, sf_dir):
    """A file named just what was typed: it keeps its points in a folder of low priority only if its type is preferred."""
    out = None
    for priority in _PRIORITIES:
        typed = f"order 7 {priority}"
        ways, f = Q.parse(f'"{typed}" !zzz'), Q.fields()
        low = arrange.low_priority(["asia", "europe", "africa", "america", "middle east"])
        points = rank.entry_score(rank.score(ways), low, F.lit(False), ["pdf", "docx"], Q.exact_name(ways, f))
        hits = Q.search(entries_of(spark, sf_dir), f'"{typed}"').where(Q.exact_name(ways, f))
        one = hits.select("id", F.lit(typed).alias("typed"), points.alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "foreign_search",
    rf"""{ENTRIES_SQL}
SELECT 'folders' AS text, id FROM entries WHERE NOT is_dir AND (starts_with(lower(path), 'asia\') OR starts_with(lower(path), 'europe\nation_8\')) AND ext IN ('pdf', 'txt') AND contains(name_folded, 'urgent')
UNION ALL SELECT 'direct' AS text, id FROM entries WHERE lower(array_to_string(segments[1:len(segments) - 1], '\')) = 'asia' AND is_dir
UNION ALL SELECT 'roots' AS text, id FROM entries WHERE depth = 0
UNION ALL SELECT 'starts' AS text, id FROM entries WHERE starts_with(lower(path), 'asia\nation_2')""",
)
def foreign_search(spark, sf_dir):
    """Texts of another tool over the entries; two of them can't be said and find nothing. Its places begin with a drive,
    which the entries' paths get in front."""
    entries = entries_of(spark, sf_dir).withColumn("path", F.concat(F.lit("E:\\"), "path"))
    texts = {
        "folders": r'<"E:\ASIA\" | "E:\europe\Nation_8\"> file:urgent ext:pdf;txt', "direct": r"folder: infolder:E:\Asia", "roots": "root:", "starts": r"E:\asia\nation_2",
        "refused": "urgent attrib:h", "groups": "<urgent low>",
    }
    out = None
    for name, text in texts.items():
        one = foreign.search(entries, text).select(F.lit(name).alias("text"), "id")
        out = one if out is None else out.unionByName(one)
    return out


# ---- folders by name


@register(
    "folder_scopes",
    rf"""{ENTRIES_SQL}, p(typed, how, hit) AS (
  SELECT 'urgent asia/nation_2/', 'exact', id FROM entries WHERE is_dir AND name_folded = 'nation_2' AND folders = ['asia']
  UNION ALL SELECT 'low customer#00000001/', 'approximate', id FROM (SELECT * FROM entries WHERE is_dir AND contains(name_folded, 'customer#00000001') ORDER BY depth, id LIMIT 200)
  UNION ALL SELECT 'low /europe', 'exact', id FROM entries WHERE is_dir AND name_folded = 'europe'
  UNION ALL SELECT 'high asi/customer#0000001/', 'approximate', id FROM (
    SELECT * FROM entries WHERE is_dir AND contains(name_folded, 'customer#0000001') AND len(list_filter(folders, lambda x: contains(x, 'asi'))) > 0 ORDER BY depth, id LIMIT 200)),
w AS (SELECT *, regexp_extract(typed, '^[a-z]+') AS word FROM p),
b AS (SELECT typed, how, e.id FROM w JOIN entries e ON contains(e.name_folded, w.word) AND list_contains(e.ancestor_ids, w.hit)
      UNION ALL SELECT 'urgent nosuchfolder/', 'words', id FROM entries WHERE contains(name_folded, 'urgent') AND contains(name_folded, 'nosuchfolder/'))
SELECT typed, how, count(DISTINCT id) AS entries, sum(id)::BIGINT AS ids FROM (SELECT DISTINCT * FROM b) GROUP BY ALL""",
)
def folder_scopes(spark, sf_dir):
    """Places of a search read exactly, approximately, and as words; what lies in them and has the words."""
    entries, out = entries_of(spark, sf_dir), None
    for typed in ("urgent asia/nation_2/", "low customer#00000001/", "low /europe", "high asi/customer#0000001/", "urgent nosuchfolder/"):
        found = scope.resolve(entries, typed)
        rows = entries if found.folders is None else scope.inside(entries, found.folders)
        hits = Q.search(rows, f'"{found.words}"')
        one = hits.agg(F.count(F.lit(1)).alias("entries"), F.sum("id").alias("ids")).where("entries > 0")
        one = one.select(F.lit(typed).alias("typed"), F.lit(next(iter(found.readings.values()))).alias("how"), "entries", "ids")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "hidden_by_rules",
    rf"""{ENTRIES_SQL}, f AS (
  SELECT id FROM entries WHERE is_dir AND (name_folded = 'africa' OR (name_folded = 'nation_2' AND folders[-1] = 'asia') OR regexp_matches(name_folded, '^customer#.*(31|71)$'))),
r AS (
  SELECT e.id, EXISTS (SELECT 1 FROM f WHERE f.id = e.id OR list_contains(e.ancestor_ids, f.id)) AS hidden, NOT is_dir AND ext = 'txt' AS file FROM entries e)
SELECT id, CASE WHEN hidden THEN 'folder' WHEN coalesce(file, FALSE) THEN 'file' ELSE 'shown' END AS reason FROM r WHERE NOT (hidden AND coalesce(file, FALSE))""",
)
def hidden_by_rules(spark, sf_dir):
    """Rules by name, by a tail of names and by a pattern, beside a rule on files; what both skip is in no set."""
    entries = entries_of(spark, sf_dir)
    return scope.shown(entries, ["Africa", "asia\\nation_2", "customer#*31", "customer#*71"], ~F.col("is_dir") & (F.col("ext") == "txt")).select("id", "reason")


_VISITS_SQL = """
v AS (SELECT l_orderkey * 8 + 3 AS id, l_shipdate AS ts, CASE WHEN l_linenumber = 1 THEN 'urgent' WHEN l_linenumber = 2 THEN 'urg' WHEN l_linenumber = 3 THEN 'urgent pdf' WHEN l_linenumber = 4 THEN 'low' END AS text
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-01 12:00:00'),
d AS (SELECT *, pow(2.0, -(epoch_us(TIMESTAMP '2001-09-01 12:00:00') - epoch_us(ts)) / 1e6 / 1209600.0) AS w FROM v),
a AS (SELECT id, 3 AS g, sum(w) AS weight, max(ts) AS last FROM d GROUP BY id),
x AS (SELECT id, text, sum(w) AS weight, max(ts) AS last FROM d WHERE text IS NOT NULL GROUP BY id, text HAVING sum(w) >= 0.5),
y AS (SELECT x.id, CASE WHEN text = 'urgent' THEN 0 WHEN contains(text, 'urgent') THEN 1 WHEN contains('urgent', text) THEN 2 END AS g, greatest(x.weight, a.weight) AS weight, x.last FROM x JOIN a USING (id)),
z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY g, weight DESC, last DESC) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM y WHERE g IS NOT NULL)),
l AS (SELECT id, g, CASE WHEN g <= 2 THEN least(weight, 2.5) ELSE weight END AS weight, last, 300 + round([40, 30, 24, 20][g + 1] * log2(1 + least(weight, 15.0)))::INT AS bonus FROM z WHERE n = 1 AND weight >= 0.5)"""


def visits(spark, sf_dir):
    """Line items as visits to their orders; the first four of an order by a typed text."""
    text = F.when(F.col("l_linenumber") == 1, "urgent").when(F.col("l_linenumber") == 2, "urg").when(F.col("l_linenumber") == 3, "urgent pdf").when(F.col("l_linenumber") == 4, "low")
    return table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit(str(NOW)).cast("timestamp")).select((F.col("l_orderkey") * 8 + 3).alias("id"), text.alias("text"), F.col("l_shipdate").alias("ts"))


@register(
    "learned_first",
    f"""{ENTRIES_SQL}, {_VISITS_SQL.strip()},
s AS (SELECT e.id, l.g IS NOT NULL AS learned, e.modified, l.g, l.weight, l.last, greatest(18 + floor(25 * 6 / strlen(name))::INT, coalesce(l.bonus, 0)) AS score
      FROM entries e LEFT JOIN l ON l.id = e.id WHERE contains(name_folded, 'urgent'))
SELECT id, learned, score FROM s ORDER BY learned DESC, g, weight DESC, last DESC, CASE WHEN NOT learned THEN score END DESC NULLS LAST, CASE WHEN NOT learned THEN modified END DESC NULLS LAST, id LIMIT 400""",
)
def learned_first(spark, sf_dir):
    hits = Q.search(entries_of(spark, sf_dir), "urgent").withColumn("score", rank.score(Q.parse("urgent")))
    return scope.learned_first(hits, visits(spark, sf_dir), "urgent", F.lit(str(NOW)).cast("timestamp"), 400).select("id", "learned", "score")


@register(
    "path_leads",
    """WITH e AS (SELECT min(p_partkey) AS id, lower(p_type) AS kind, lower(p_brand) AS brand FROM part GROUP BY ALL),
h AS (SELECT l_partkey AS id, max(epoch(l_shipdate)::BIGINT) AS opened FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1),
t(typed, kind, brand) AS (VALUES ('brand#7/', NULL, 'brand#7'), ('small/brand#4/', 'small', 'brand#4'), ('Brand#12/', NULL, 'brand#12'), ('large\\brand#3', 'large', 'brand#3'), ('brand#7/small', 'x', 'small')),
o AS (SELECT typed, e.id, row_number() OVER (PARTITION BY typed ORDER BY opened DESC NULLS LAST, e.kind = 'large', CASE WHEN e.id * 1000 <= 1600000000 THEN e.id END DESC NULLS LAST, e.id) AS n
      FROM t JOIN e ON e.brand = t.brand AND (t.kind IS NULL OR e.kind = t.kind) LEFT JOIN h ON h.id = e.id)
SELECT typed, id FROM o WHERE n <= 3""",
)
def path_leads(spark, sf_dir):
    """Brands as folders of kinds, and where paths typed from some folder along the way lead: to what was opened last, not
    aside, shallow, new."""
    part = table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("kind"), F.lower("p_brand").alias("name_folded")).agg(F.min("p_partkey").alias("id"))
    folders = part.select("id", "name_folded", F.array("kind").alias("folders"), F.lit(True).alias("is_dir"), F.lit(1).alias("depth"), (F.col("id") * 1000).alias("modified"))
    history = table(spark, sf_dir, "lineitem").where("l_partkey % 3 = 0").select(F.col("l_partkey").alias("id"), F.unix_timestamp("l_shipdate").alias("opened"))
    out = None
    for typed in ("brand#7/", "small/brand#4/", "Brand#12/", "large\\brand#3", "brand#7/small"):
        one = scope.path_leads(folders, typed, history, F.get("folders", F.lit(0)) == "large", 1_600_000_000).select(F.lit(typed).alias("typed"), "id")
        out = one if out is None else out.unionByName(one)
    return out


_HOMOPHONE_SQL = """
WITH w(i, typed, approximate, score) AS (VALUES
  (0, '报告', FALSE, 30 + 45 + 15), (1, '报告', FALSE, 4 + 8), (2, '报告', FALSE, 18 + 13), (3, '报告', FALSE, 30 + 60 + 25), (10, '报告', FALSE, 30 + 13), (11, '报告', FALSE, 18 + 12),
  (0, '抱高', TRUE, 26 + 40 + 15), (1, '抱高', TRUE, 4 + 8), (2, '抱高', TRUE, 16 + 13), (3, '抱高', TRUE, 26 + 40 + 25), (10, '抱高', TRUE, 26 + 13), (11, '抱高', TRUE, 16 + 12),
  (7, '虫青', TRUE, 26 - 12 + 40 + 15), (8, '虫青', TRUE, 16 - 12 + 12))
SELECT p_partkey, w.typed, w.approximate, w.score FROM part JOIN w ON p_partkey % 12 = w.i
"""


@register("homophone_fallback", _HOMOPHONE_SQL)
def homophone_fallback(spark, sf_dir):
    """A text that is found as it is, and two that are only found as they sound."""
    more = spark.createDataFrame([("抱", "bao", 1), ("高", "gao", 1), ("虫", "chong", 1), ("青", "qing", 1)], "char string, reading string, place int")
    known, out = readings_table(spark).unionByName(more), None
    for typed in ("报告", "抱高", "虫青", "无此"):
        one = rank.scored(sounding(spark, sf_dir), typed, known).select(F.col("id").alias("p_partkey"), F.lit(typed).alias("typed"), "approximate", "score")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "paged_answer",
    f"""{ENTRIES_SQL}, h AS (SELECT id, name, row_number() OVER (ORDER BY id) AS n FROM entries WHERE contains(name_folded, 'urgent') AND id > 1000),
t AS (SELECT count(*) AS n, max(id) FILTER (WHERE n <= 25) AS cursor FROM h)
SELECT h.id, h.name, CASE WHEN t.n > 25 THEN t.cursor END AS next_cursor, t.n > 25 AS truncated FROM h, t WHERE h.n <= 25""",
)
def paged_answer(spark, sf_dir):
    """A page that goes on after a cursor, and says whether there is more."""
    return rank.answer(Q.search(entries_of(spark, sf_dir), "urgent"), 1000, 25).select("id", "name", "next_cursor", "truncated")
