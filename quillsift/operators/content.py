"""Search inside texts: grams, postings, patterns, lines, relevance."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.operators.gramlists import gram_lists
from quillsift.plans.regexneed import ANY, Need, either, every, literal, need_of

MAX_NEEDLES = 32
_HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"


def normal(text: Column) -> Column:
    """Lower case, runs of blanks as one space."""
    return F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " ")


def grams(text: Column) -> Column:
    """The distinct ASCII trigrams and Han characters and pairs of a text; other scripts break grams.

    Arrays are shifted and zipped, so that the cost is linear in a text of any length.
    """
    # a control character becomes one of no indexed script
    chars = F.split(F.regexp_replace(normal(text), r"[\x00-\x1F\x7F]", "\u0080"), "")
    later = lambda n: F.slice(chars, F.lit(1 + n), F.size(chars))
    two = F.zip_with(chars, later(1), lambda a, b: F.concat(a, b))
    three = F.zip_with(two, later(2), lambda a, b: F.concat(a, b))
    ascii_only = F.filter(three, lambda g: F.octet_length(g) + F.length(g) == 6)
    han = F.filter(F.concat(chars, two), lambda g: g.rlike(rf"^{_HAN}{{1,2}}\z"))
    return F.array_distinct(F.concat(ascii_only, F.when(text.rlike(_HAN), han).otherwise(F.array().cast("array<string>"))))


def contents(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (content_id, text) and which document has which: texts are read once however many copies there are."""
    tagged = docs.where(F.col(text).isNotNull()).select(F.col(key), F.sha2(F.col(text), 256).alias("content_id"), F.col(text).alias("text"))
    return tagged.groupBy("content_id").agg(F.any_value("text").alias("text")), tagged.select(key, "content_id")


def postings(distinct: DataFrame) -> DataFrame:
    """(gram, content_id), to be written sorted by gram: Parquet's row group statistics then skip other grams."""
    return gram_lists(distinct, "content_id", normal(F.col("text"))).select("gram", F.explode("keys").alias("content_id"))


def write_postings(index: DataFrame, path: str) -> None:
    index.repartitionByRange("gram", "content_id").sortWithinPartitions("gram", "content_id").write.parquet(path)


def grams_of(word: str) -> list[str]:
    """Grams that a text with this word must have: ASCII trigrams, Han pairs, and Han characters that stand alone in it."""
    word = re.sub(r"[ \t\n\x0b\f\r]+", " ", word.lower())
    found = {word[i : i + 3] for i in range(len(word) - 2) if re.fullmatch(r"[\x20-\x7E]{3}", word[i : i + 3])}
    for run in re.findall(r"[\u4e00-\u9fff\u3400-\u4dbf]+", word):
        found |= {run[i : i + 2] for i in range(len(run) - 1)} or {run}
    return sorted(found)


_REGEX = re.compile(r"(?:regex|re):(.+)", re.S)


def need(ways: list[list[str]]) -> Need:
    """What a text must contain for a search's ways: its words, and what its regular expressions can't match without."""
    one = lambda w: need_of(m[1]) if (m := _REGEX.fullmatch(w)) else literal(w.lower())
    return either([every([one(w) for w in way]) for way in ways])


def gram_plan(need: Need) -> Need:
    """A need with its literals told by grams; a literal without any needs nothing."""
    if need.kind == "literal":
        return every([literal(g) for g in grams_of(need.text)])
    if need.kind == "any":
        return ANY
    return (every if need.kind == "all" else either)([gram_plan(p) for p in need.parts])


def grams_of_plan(plan: Need) -> list[str]:
    return [plan.text] if plan.kind == "literal" else sorted({g for p in plan.parts for g in grams_of_plan(p)})


def plan_column(plan: Need, held: dict[str, Column]) -> Column:
    """Whether a plan is true, by a Column for each gram that it names."""
    if plan.kind == "literal":
        return held[plan.text]
    return reduce(Column.__and__ if plan.kind == "all" else Column.__or__, [plan_column(p, held) for p in plan.parts])


#: Grams of a plan that one number marks.
_MARKS = 62


def holding(rows: DataFrame, plan: Need, **keys: Column) -> DataFrame:
    """The keys, told from rows (gram, ...), whose grams make a plan true."""
    grams = grams_of_plan(plan)
    parts = {f"_m{i}": grams[i : i + _MARKS] for i in range(0, len(grams), _MARKS)}
    bit = lambda part: F.get(F.array(*[F.lit(1 << n).cast("long") for n in range(len(part))]), F.array_position(F.array(*[F.lit(g) for g in part]), F.col("gram")).cast("int") - 1)
    marked = rows.where(F.col("gram").isin(grams)).select(*[c.alias(k) for k, c in keys.items()], *[bit(part).alias(m) for m, part in parts.items()])
    held = marked.groupBy(*keys).agg(*[F.coalesce(F.bit_or(m), F.lit(0)).alias(m) for m in parts])
    found = {g: F.col(m).bitwiseAND(F.lit(1 << n).cast("long")) != 0 for m, part in parts.items() for n, g in enumerate(part)}
    return held.where(plan_column(plan, found)).select(*keys)


def candidates(index: DataFrame, ways: list[list[str]]) -> DataFrame | None:
    """content_id of the texts that have the grams which a search needs; None if it needs none, when every text is read."""
    plan = gram_plan(need(ways))
    if plan.kind == "any":
        return None
    return holding(index, plan, content_id=F.col("content_id"))


#: Ways that alternatives inside a way (a|b) may make together.
MAX_WAYS = 16


def pattern(text: str) -> list[list[str]]:
    """Ways of needles: words all in the text, "a phrase", a|b either, ` | ` parts ways; a way that holds another goes."""
    ways: list[list[list[str]]] = [[]]
    for token, quoted in ((m[1] if m[1] is not None else m[0], m[1] is not None) for m in re.finditer(r'"([^"]*)"?|\S+', text)):
        if token == "|" and not quoted:
            ways.append([])
        elif token:
            ways[-1].append([token] if quoted or "|" not in token or token.startswith(("regex:", "re:")) else [x for x in token.split("|") if x])
    out: list[list[str]] = []
    for way in ways:
        flat: list[list[str]] = [[]]
        if math.prod(map(len, way)) > MAX_WAYS:
            raise ValueError("too many alternatives")
        for options in way:
            flat = [[*a, o] for a in flat for o in options]
        out += [w for w in flat if w]
    if sum(map(len, out)) > MAX_NEEDLES:
        raise ValueError("too many words")
    sets = [frozenset(x.lower() for x in w) for w in out]
    return [w for i, w in enumerate(out) if not any(s < sets[i] or s == sets[i] and j < i for j, s in enumerate(sets))]


def needle(text: Column, word: str) -> Column:
    """Any case; a regular expression must match inside one line, behind the literal that it needs."""
    if m := _REGEX.fullmatch(word):
        hit = F.exists(F.split(text, "\n"), lambda line: line.rlike(f"(?i){m[1]}"))
        first = need_of(m[1]).column(F.lower(text))
        return hit if first is None else first & hit
    return F.contains(F.lower(text), F.lit(word.lower()))


def matches(text: Column, ways: list[list[str]]) -> Column:
    return reduce(Column.__or__, [reduce(Column.__and__, [needle(text, w) for w in way]) for way in ways])


def search(distinct: DataFrame, index: DataFrame | None, query: str) -> DataFrame:
    """Texts that match: the index rules texts out, what is left is read."""
    ways = pattern(query)
    some = candidates(index, ways) if index is not None else None
    rows = distinct if some is None else distinct.join(some, "content_id", "left_semi")
    return rows.where(matches(F.col("text"), ways))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "text"))


def best_lines(rows: DataFrame, words: list[str]) -> DataFrame:
    """The line of each document with most of the words, then most word starts, then the earliest."""
    hits = reduce(Column.__add__, [F.contains(F.lower("text"), F.lit(w.lower())).cast("int") for w in words])
    starts = reduce(Column.__add__, [F.lower("text").rlike(rf"(^|[^a-z0-9]){re.escape(w.lower())}").cast("int") for w in words])
    scored = rows.withColumns({"hits": hits, "starts": starts}).where("hits > 0")
    best = scored.groupBy("doc").agg(F.max(F.struct("hits", "starts", (-F.col("line")).alias("l"), "text")).alias("b"))
    return best.select("doc", F.col("b.hits").alias("hits"), F.col("b.starts").alias("starts"), (-F.col("b.l")).alias("line"), F.col("b.text").alias("text"))


def relevance(best: DataFrame, n_words: int, name_hits: Column, place: Column, age_days: Column) -> Column:
    """All words on a line 40, else 15(k-1)/(n-1); word starts 20 s/n; name 30 min(hits, n)/n; place; newness; long
    lines -35. Integers, as in the parts."""
    n = n_words
    together = F.when(F.col("hits") == n, 40).otherwise(F.expr(f"15 * (hits - 1) div {max(n - 1, 1)}"))
    new = F.when(age_days < 7, 12).when(age_days < 30, 8).when(age_days < 365, 4).otherwise(0)
    named = F.floor(F.least(name_hits, F.lit(n)) * 30 / n)
    return (together + F.expr(f"20 * starts div {n}") + named + place + new + F.when(F.length("text") > 1000, -35).otherwise(0)).cast("int")


def occurrences(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Every occurrence of every term on a line (doc, line, text): start and length, none overlapping another of its term."""
    from quillsift.functions.text import spans

    out = None
    for k, term in enumerate(terms):
        one = rows.where(F.contains(F.lower("text"), F.lit(term.lower()))).select("doc", "line", F.explode(spans(F.col("text"), term)).alias("start"), F.lit(len(term)).alias("length"), F.lit(k).alias("term"))
        out = one if out is None else out.unionByName(one)
    return out


def fingerprint(text: Column) -> Column:
    """A text by its gram set, not its letters: copies with other blanks or order of lines share it where grams agree."""
    return F.sha2(F.array_join(F.array_sort(grams(text)), "\u0001"), 256)


def files_with_all(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Files (file, text of a page) of which every term is on some page, with the pages that have any."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(t.lower())), F.lit(i)) for i, t in enumerate(terms)]))
    hits = pages.select("file", found.alias("hits")).where(F.size("hits") > 0)
    terms_of = hits.select("file", F.explode("hits").alias("t")).groupBy("file", "t").agg(F.count(F.lit(1)).alias("n"))
    return terms_of.groupBy("file").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("hits")).where(F.col("terms") == len(terms)).select("file", "hits")
