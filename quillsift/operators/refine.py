"""Refinement inside what a content search has found: case, whole words, counts by term and section, shown offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import quote
from quillsift.operators import content

#: A character of a word, in any script.
WORD = r"[\p{L}\p{N}_]"
DAY = 86_400


def refined(text: Column, wanted: str, case: bool = False, whole_word: bool = False, regex: bool = False) -> Column:
    """Lines with a text or a pattern; a whole word has no letter, digit or _ beside it. An empty text is in every line."""
    if not wanted:
        return F.lit(True)
    body = wanted if regex else quote(wanted)
    hit = text.rlike(("" if case else "(?iu)") + (f"(?<!{WORD})(?:{body})(?!{WORD})" if whole_word else body))
    # a plain text is looked for first where its case is its own
    return F.contains(text, F.lit(wanted)) & hit if case and not regex else hit


def term_counts(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Occurrences by document, section and term (its number), of lines (doc, section, line, text)."""
    keyed = rows.select(F.struct("doc", "section").alias("doc"), "line", "text")
    found = content.occurrences(keyed, terms).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))
    return found.select("doc.doc", "doc.section", "term", "n")


def utf16(text: Column, at: Column) -> Column:
    """A place counted in characters as one counted in UTF-16 units, in which those beyond U+FFFF are two."""
    before = F.substring(text, 1, at)
    return F.length(before) + F.length(before) - F.length(F.regexp_replace(before, r"[\x{10000}-\x{10FFFF}]", ""))


def documents_of(found: DataFrame, which: DataFrame) -> DataFrame:
    """The documents of contents: one text may be that of many copies."""
    return which.join(found.select("content_id").distinct(), "content_id")


def ranked(rows: DataFrame, key: str, now: int, by: str = "match") -> DataFrame:
    """Rows (relevance, modified) by relevance, or newest or oldest first: an unknown time, and one over a day ahead, is last."""
    known = F.when((F.col("modified") > 0) & (F.col("modified") <= now + DAY), F.col("modified"))
    time = {"match": [], "newest": [known.desc_nulls_last()], "oldest": [known.asc_nulls_last()]}[by]
    return rows.orderBy(*time, F.desc("relevance"), key)
