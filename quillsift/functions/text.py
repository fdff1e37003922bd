"""Text as Columns: folding, patterns, word starts, sizes, extensions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def fold(text: str) -> str:
    """A-Z in lower case, everything else as it is (names compare so)."""
    return text.translate(_FOLD)


def folded(column: Column) -> Column:
    """`fold` of a column. Where a value is ASCII, lower() is the same and much faster."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def quote(text: str) -> str:
    """A literal as a regular expression that Java and RE2 read alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", text)


def glob_regex(pattern: str) -> str:
    """`*` any run, `?` one character, over the whole name."""
    return "^" + "".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(c, quote(c)) for c in pattern) + "$"


def either_case(text: str) -> str:
    """A folded literal as a regular expression for both cases of its ASCII letters."""
    return "".join(f"[{c}{c.upper()}]" if c in LOWER else quote(c) for c in text)


def stem(name: Column) -> Column:
    """A name without its extension."""
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def word_start_regex(term: str) -> str:
    """Finds a folded term where a word starts: after a separator, at a hump, between letters and digits, next to
    another script."""
    any_case, first = either_case(term), term[0]
    before = ["^", r"[^A-Za-z0-9\x{80}-\x{10FFFF}]"]
    parts = []
    if first in LOWER:
        parts.append(f"[a-z]{first.upper()}{either_case(term[1:])}")
        before += [r"[0-9]", r"[\x{80}-\x{10FFFF}]"]
    elif first.isdigit() and first.isascii():
        before += ["[A-Za-z]", r"[\x{80}-\x{10FFFF}]"]
    elif not first.isascii():
        before += [r"[\x{00}-\x{7F}]"]
    return "|".join([f"(?:{'|'.join(before)}){any_case}", *parts])


def initials_regex(term: str) -> str | None:
    """Finds 2 to 12 initials of a program's name in order, the first at its first word; others may be skipped."""
    if not re.fullmatch(r"[a-z0-9]{2,12}", term):
        return None

    def start(c: str) -> str:
        if c.isdigit():
            return f"[^0-9]{c}"
        return f"(?:[^A-Za-z]{either_case(c)}|[a-z]{c.upper()})"

    return "^[^A-Za-z0-9]*" + either_case(term[0]) + "".join(f"(?s:.*?){start(c)}" if i else f"(?:(?s:.*?){start(c)})" for i, c in enumerate(term[1:]))


def extension(name: Column, is_dir: Column) -> Column:
    """What stands behind the last dot, folded; null for folders, without a dot, or with a dot at the end."""
    found = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return F.when(~is_dir & (found != ""), folded(found))


def size_text(size: Column) -> Column:
    """Three figures and a unit: bytes, then steps of 1024 from 1000 on. A half goes to the even figure, as printf does it;
    format_string alone rounds it up."""
    out, value = None, size.cast("double")
    figures = lambda n: F.format_string(f"%.{n}f", F.bround(value, n))
    for unit in ("B", "KB", "MB", "GB", "TB", "PB"):
        shown = F.when(F.lit(unit == "B") | (value >= 100), figures(0)).when(value >= 10, figures(1)).otherwise(figures(2))
        shown = F.concat(shown, F.lit(f" {unit}"))
        out = F.when(value < 1000, shown) if out is None else out.when(value < 1000, shown)
        value = value / 1024
    return out.otherwise(F.concat(F.format_string("%.0f", F.bround(value * 1024, 0)), F.lit(" PB")))


def markup_text(html: Column) -> Column:
    """Readable text of markup: no scripts, styles or comments, blocks on lines of their own, common entities."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</(script|style|head)>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<(br|p|div|li|tr|h[1-6]|article|section|table)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def spans(text: Column, term: str) -> Column:
    """Starts (from 0) of a term's occurrences that do not overlap, any case."""
    low, word = F.lower(text), term.lower()
    parts = F.split(low, quote(word))
    # a part's start is found from the one before it, so the cost is linear in the hits
    return F.aggregate(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x) + len(word)).alias("at"), F.array_append(a["out"], a["at"] + F.length(x)).alias("out")), lambda a: a["out"],
    )
