"""Names in Han found by how they sound: "bg", "baogao", "baog" and "bgao" all find 报告.

Each Han character of a name matches a non-empty beginning of one of its readings, every other ASCII character itself.
The readings are a relation (char, reading, place), place 1 the most common one; it is joined to names by character once,
and gives each name `sounds`: for every code point the strings that may stand for it. A term is then aligned by folding
over the code points, once for each different name, with a bit for each place of the term that has been reached, so the cost is bounded by the name's
and the term's lengths, whatever the readings; where the alignment starts and ends, and whether the most common
readings suffice, is part of the answer.
"""

from __future__ import annotations

import re
from itertools import islice, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Readings of a character that count, the most common ones first.
MOST = 3
HAN = r"[\x{4E00}-\x{9FFF}]"


def is_term(text: str) -> bool:
    """Two or more (63 at most) ASCII letters and digits, one of them a letter."""
    return re.fullmatch(r"(?=.*[a-z])[a-z0-9]{2,63}", text) is not None


def with_sounds(rows: DataFrame, readings: DataFrame) -> DataFrame:
    """rows (name, ...) with `sounds`, null for names without Han. Only different names with Han meet the readings."""
    sounds = F.transform(F.array_sort(F.collect_list(F.struct("place", "reading"))), lambda r: F.replace(r["reading"], F.lit("v"), F.lit("ü")))
    known = readings.where(F.col("place") <= MOST).groupBy("char").agg(sounds.alias("_sounds"))
    names = rows.where(F.col("name").rlike(HAN)).select(F.col("name").alias("_name")).distinct()
    letters = names.select("_name", F.posexplode(F.split("_name", "")).alias("_at", "char")).join(known, "char", "left")
    own = F.when(F.octet_length("char") == 1, F.array(F.lower("char")))
    each = letters.select("_name", F.struct("_at", F.coalesce("_sounds", own, F.array().cast("array<string>")).alias("s")).alias("x"))
    told = each.groupBy("_name").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("sounds"))  # a name is short
    plain = rows.where(~F.coalesce(F.col("name").rlike(HAN), F.lit(False))).withColumn("sounds", F.lit(None).cast("array<array<string>>"))
    return rows.join(told, F.col("name") == F.col("_name")).drop("_name").select(*plain.columns).unionByName(plain)


def span(sounds: Column, term: str, most: int = MOST) -> Column:
    """(start, length) in code points of the first place that sounds like the term, the shortest there; null if none."""
    places: dict[str, int] = {}
    for i, c in enumerate(term):
        places[c] = places.get(c, 0) | 1 << i
    places["ü"] = places.get("u", 0) | places.get("v", 0)
    signed = lambda n: F.lit(n - (1 << 64) if n >= 1 << 63 else n).cast("long")
    done = signed(1 << len(term))

    def of(letter: Column) -> Column:
        out = F.lit(0).cast("long")
        for c, bits in places.items():
            out = F.when(letter == c, signed(bits)).otherwise(out)
        return out

    def letters(reached: Column, sound: Column) -> Column:
        def one(st: Column, letter: Column) -> Column:
            after = F.shiftleft(st["t"].bitwiseAND(of(letter)), 1)
            return F.struct(after.alias("t"), st["out"].bitwiseOR(after).alias("out"))

        return F.aggregate(F.split(sound, ""), F.struct(reached.alias("t"), F.lit(0).cast("long").alias("out")), one)["out"]

    def step(st: Column, ways: Column) -> Column:
        after = F.when(st["reached"] == 0, F.lit(0).cast("long")).otherwise(
            F.aggregate(F.slice(ways, 1, most), F.lit(0).cast("long"), lambda acc, s: acc.bitwiseOR(letters(st["reached"], s)))
        )
        # evaluated once: an end puts out all places, so that nothing more is looked for
        told = lambda m: F.struct(F.when(m.bitwiseAND(done) != 0, F.lit(0).cast("long")).otherwise(m).alias("reached"), (st["n"] + 1).alias("n"), F.when(m.bitwiseAND(done) != 0, st["n"] + 1).otherwise(st["length"]).alias("length"))
        return F.element_at(F.transform(F.array(after), told), 1)

    def at(start: Column) -> Column:
        none = F.struct(F.lit(1).cast("long").alias("reached"), F.lit(0).alias("n"), F.lit(0).alias("length"))
        return F.struct(start.alias("start"), F.aggregate(F.slice(sounds, start + 1, F.size(sounds)), none, step)["length"].alias("length"))

    first = [term[0], "ü"] if term[0] in "uv" else [term[0]]
    begins = lambda s: F.substring(s, 1, 1).isin(first)
    starts = F.filter(F.sequence(F.lit(0), F.size(sounds) - 1), lambda i: F.exists(F.slice(F.get(sounds, i), 1, most), begins))
    return F.when(F.size(sounds) > 0, F.get(F.filter(F.transform(starts, at), lambda x: x["length"] > 0), F.lit(0)))


def starts_word(name: Column, start: Column) -> Column:
    """Whether a word starts at a code point: after a separator, at a hump, between letters and digits, next to another script."""
    around = F.substring(name, start, F.lit(2))
    return (start == 0) | around.rlike(r"^(?s:[^A-Za-z][A-Za-z]|[a-z][A-Z]|[^0-9][0-9]|[\x00-\x7F][\x{80}-\x{10FFFF}])$")


def graded(name: Column, sounds: Column, term: str) -> Column:
    """(start, length, bytes, points) of a term in a name, null where it does not sound like it: 26 at the start, 16 where
    a word starts, 4 elsewhere; 12 fewer where a less common reading is needed."""
    both = F.struct(span(sounds, term, 1).alias("common"), span(sounds, term).alias("any"))

    def told(x: Column) -> Column:
        at = F.coalesce(x["common"], x["any"])
        start, length = at["start"], at["length"]
        points = F.when(start == 0, 26).when(starts_word(name, start), 16).otherwise(4) - F.when(x["common"].isNull(), 12).otherwise(0)
        return F.when(at.isNotNull(), F.struct(start.alias("start"), length.alias("length"), F.octet_length(F.substring(name, start + 1, length)).alias("bytes"), points.alias("points")))

    return F.when(sounds.isNotNull(), F.element_at(F.transform(F.array(both), told), 1))


def with_heard(rows: DataFrame, readings: DataFrame, terms: list[str]) -> DataFrame:
    """rows (name, ...) with `sounds`, a map from each term to where and how well (see graded) the name sounds like it; null
    where it sounds like none. Terms are aligned once with each different name, however many rows have it."""
    han = F.coalesce(F.col("name").rlike(HAN), F.lit(False))
    names = with_sounds(rows.where(han).select("name").distinct(), readings)
    each = names.select(F.col("name").alias("_name"), *[graded(F.col("name"), F.col("sounds"), t).alias(t) for t in terms])
    told = each.where(F.coalesce(*terms).isNotNull()).select("_name", F.create_map(*[c for t in terms for c in (F.lit(t), F.col(t))]).alias("sounds"))
    heard = rows.where(han).join(told, F.col("name") == F.col("_name"), "left").select(*rows.columns, "sounds")
    return heard.unionByName(rows.where(~han).withColumn("sounds", F.lit(None).cast(told.schema["sounds"].dataType)))


#: Readings of a whole text that are searched for where the text itself is found nowhere.
MOST_READINGS = 8


def spoken(text: str, known: dict[str, list[str]]) -> list[str]:
    """A word with its Han characters as they sound: the most common readings first, the last character's changing fastest,
    MOST_READINGS at most. Empty for a word without Han."""
    pieces = [known.get(c, [c])[:MOST] for c in text]
    if all(c not in known for c in text):
        return []
    return ["".join(way) for way in islice(product(*pieces), MOST_READINGS)]
