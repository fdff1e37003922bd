"""Needs of regular expressions: no match without them, whatever the expression; and as tight as they are meant to be."""

import random
import re

import pytest

from quillsift.operators import content
from quillsift.plans.regexneed import MAX_LETTERS, MAX_STRINGS, need_of

LETTERS = "abcx -"


def expression(rng, depth=3):
    """A random expression, and a maker of strings that it matches."""
    kind = rng.choice(["letter"] * 4 + ["class", "any", "digit", "group", "either", "repeat", "repeat", "row"]) if depth else "letter"
    if kind == "letter":
        c = rng.choice(LETTERS)
        return re.escape(c), lambda: rng.choice([c, c.upper()])
    if kind == "class":
        some = rng.sample("abcx", rng.randrange(1, 4))
        return f"[{''.join(some)}]", lambda: rng.choice(some)
    if kind == "any":
        return ".", lambda: rng.choice("abcxyz ")
    if kind == "digit":
        return r"\d", lambda: rng.choice("0123456789")
    parts = [expression(rng, depth - 1) for _ in range(rng.randrange(1, 4))]
    if kind == "either":
        return f"({'|'.join(p for p, _ in parts)})", lambda: rng.choice(parts)[1]()
    if kind == "repeat":
        p, make = parts[0]
        sign, least, most = rng.choice([("*", 0, 3), ("+", 1, 4), ("?", 0, 1), ("{2}", 2, 2), ("{1,3}", 1, 3), ("{0,2}", 0, 2), ("+?", 1, 3), ("{2,}", 2, 4)])
        return f"({p}){sign}", lambda: "".join(make() for _ in range(rng.randint(least, most)))
    body = "".join(p for p, _ in parts)
    return (f"({body})" if kind == "group" else f"(?:{body})"), lambda: "".join(m() for _, m in parts)


@pytest.mark.parametrize("seed", range(6))
def test_every_match_has_what_is_needed(seed):
    rng = random.Random(seed)
    told = 0
    for _ in range(300):
        parts = [expression(rng) for _ in range(rng.randrange(1, 5))]
        pattern = "".join(p for p, _ in parts)
        need = need_of(pattern)
        told += need.kind != "any"
        for _ in range(20):
            text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(4))) + "".join(m() for _, m in parts) + rng.choice(["", "x", " a"])
            assert re.search(pattern, text, re.I), (pattern, text)
            assert need.met_by(text.lower()), (pattern, text, str(need))
    assert told > 100


@pytest.mark.parametrize("seed", range(3))
def test_any_text_that_matches_has_it(seed):
    rng = random.Random(100 + seed)
    texts = ["".join(rng.choice("abcx -1") for _ in range(rng.randrange(12))) for _ in range(300)]
    for _ in range(200):
        pattern = "".join(expression(rng)[0] for _ in range(rng.randrange(1, 4)))
        need = need_of(pattern)
        assert all(need.met_by(t) for t in texts if re.search(pattern, t, re.I)), (pattern, str(need))


def kinds(need):
    return {need.kind}.union(*(kinds(p) for p in need.parts))


def test_sequences_multiply_out_and_stay_few():
    assert str(need_of("river(bank|bed)s")) == "one('riverbanks', 'riverbeds')"
    assert str(need_of("hill.*valley")) == "all('hill', 'valley')"
    assert str(need_of("(hill.*top|valley) floor")) == "all(one(all('hill', 'top'), 'valley'), ' floor')"
    assert str(need_of("[a-p]lake")) == "one(" + ", ".join(f"'{chr(97 + i)}lake'" for i in range(16)) + ")"
    assert str(need_of("[a-q]lake")) == "'lake'"
    many = need_of("(pond|lake|creek)(s|t|u|v|w)(mill|weir)")
    literals = [x for p in many.parts for x in (p.parts or (p,))]
    assert many.kind == "all" and all(len(p.parts) <= MAX_STRINGS for p in many.parts) and all(len(x.text) <= MAX_LETTERS for x in literals)


def test_repeats_tell_their_ends():
    assert str(need_of("sto{2}p")) == "'stoop'" and str(need_of("sto+p")) == "all('sto', 'op')"
    assert str(need_of("(la){3,}dida")) == "all('lalala', 'ladida')"
    assert str(need_of("warms?er")) == "one('warmer', 'warmser')" and str(need_of("warms*er")) == "all('warm', 'er')"
    assert need_of("(?:go){0,4}").kind == "any" and str(need_of("z{500}")) == f"'{'z' * MAX_LETTERS}'"


def test_doubt_needs_nothing():
    for pattern in (r"\d+", "", "^$", "sun|", "(sun)?", r"\Qsun\E", "[a-z&&[def]]sun", "[s[u]]n", "(?x) s u n", r"\07sun", "ЖЖЖ", "sun(", "*sun", "(?i", "(" * 500 + "a" + ")" * 500 * 2):
        assert need_of(pattern).kind == "any", pattern
    assert str(need_of(r"(?<day>sun)\k")) == "any" and str(need_of(r"(sun)\1day")) == "all('sun', 'day')"
    assert str(need_of("sunЖday")) == "all('sun', 'day')" and str(need_of("太陽.{3}")) == "'太陽'"


def test_plans_of_grams():
    plan = lambda t: str(content.gram_plan(content.need(content.pattern(t))))
    assert plan("re:sand(bar|box)") == "one(all('and', 'bar', 'dba', 'ndb', 'san'), all('and', 'box', 'dbo', 'ndb', 'san'))"
    assert plan("ab") == "any" and plan("abcd | re:x") == "any" and plan("abc re:x") == "'abc'" and plan("太陽系") == "all('太陽', '陽系')" and plan("陽") == "'陽'"
    assert plan("abc | re:def") == "one('abc', 'def')"


def test_alternatives_are_counted_before_they_are_multiplied():
    with pytest.raises(ValueError):
        content.pattern(" ".join(["a|b"] * 60))
    assert len(content.pattern("a|b c|d e|f")) == 8
