"""The search box's language as one boolean Column and one score Column.

    report              the name contains it              "annual report"   spaces are part of the term
    a b | c             (a and b) or c                    !draft            the name must not contain it
    *.pdf  a?c          the whole name                    ^IMG  .pdf$       start, end
    re:^IMG_\\d+         regular expression (regex: too)   proj\\readme       a name under a folder
    ext:pdf,docx        size:>10mb  size:1mb..5mb  size:large               dm:7d  dm:2024-01..2024-03

Text is read once, on the driver; rows meet only what Catalyst sees: cheap comparisons first, regular expressions last
and behind a literal that every match must contain. `now` is a parameter, so that a query means the same when run again.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import islice, product

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions import text as T
from quillsift.plans import pinyin
from quillsift.plans.regexneed import need_of

PROGRAMS = ["exe", "com", "lnk", "bat", "cmd", "ps1"]
#: Sizes by name: half-open ranges of bytes.
BUCKETS = {"empty": (0, 1), "tiny": (1, 10 << 10), "small": (10 << 10, 100 << 10), "medium": (100 << 10, 1 << 20), "large": (1 << 20, 16 << 20), "huge": (16 << 20, 128 << 20), "gigantic": (128 << 20, None)}
UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}
#: Times before 2 January 1980 count as unknown.
KNOWN_FROM = 315_619_200
MAX_WAYS = 32


class QueryError(ValueError):
    pass


@dataclass
class Term:
    kind: str  # word, glob, anchor, regex
    text: str
    negated: bool = False
    ancestors: list[str] = field(default_factory=list)
    exact: bool = False  # never read as pinyin or initials


@dataclass
class Way:
    terms: list[Term] = field(default_factory=list)
    extensions: set[str] = field(default_factory=set)
    sizes: list[tuple[int, int | None]] = field(default_factory=list)
    times: list[tuple[int | None, int | None]] = field(default_factory=list)

    @property
    def positive(self) -> list[Term]:
        return [t for t in self.terms if not t.negated]


def tokens(text: str) -> list[list[tuple[str, bool]]]:
    """Pieces between white space outside quotes, as (character, quoted); an open quote runs to the end."""
    out, now, quoted, open_token = [], [], False, False
    for c in text:
        if c == '"':
            quoted, open_token = not quoted, True
        elif c.isspace() and not quoted:
            if open_token:
                out.append(now)
            now, open_token = [], False
        else:
            now.append((c, quoted))
            open_token = True
    return [*out, now] if open_token else out


def parse_size(text: str) -> tuple[int, int | None] | None:
    """A half-open range of bytes; None if the text is none. A bare size means at least."""

    def value(x: str) -> int | None:
        m = re.fullmatch(r"(\d+(?:\.\d*)?|\.\d+)\s*([a-z]*)", x)
        return int(float(m[1]) * UNITS[m[2]] + 0.5) if m and m[2] in UNITS else None

    text = T.fold(text)
    if text in BUCKETS:
        return BUCKETS[text]
    if m := re.fullmatch(r"([^.-][^-]*?)(?:\.\.|-)(.+)", text):
        lo, hi = value(m[1]), value(m[2])
        return (lo, hi + 1) if lo is not None and hi is not None else None
    m = re.fullmatch(r"(>=|<=|>|<|=)?(.+)", text)
    n = value(m[2]) if m else None
    if n is None:
        return None
    return {">": (n + 1, None), "<": (0, n), "<=": (0, n + 1)}.get(m[1], (n, None))


def _span(text: str) -> tuple[dt.datetime, dt.datetime] | None:
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?", text)
    if not m or not 1980 <= int(m[1]) <= 2200:
        return None
    try:
        start = dt.datetime(int(m[1]), int(m[2] or 1), int(m[3] or 1))
    except ValueError:
        return None
    if m[3]:
        return start, start + dt.timedelta(days=1)
    if m[2]:
        return start, dt.datetime(start.year + start.month // 12, start.month % 12 + 1, 1)
    return start, dt.datetime(start.year + 1, 1, 1)


def parse_time(text: str, now: dt.datetime) -> tuple[int | None, int | None] | None:
    """A half-open range of epoch seconds (UTC); None if the text is none."""
    day = dt.datetime(now.year, now.month, now.day)
    second = lambda x: int(x.replace(tzinfo=dt.timezone.utc).timestamp()) if x else None
    text = T.fold(text)
    named = {"today": (day, None), "yesterday": (day - dt.timedelta(days=1), day), "thisweek": (day - dt.timedelta(days=day.weekday()), None), "thismonth": (day.replace(day=1), None), "thisyear": (day.replace(month=1, day=1), None)}
    if text in named:
        return second(named[text][0]), second(named[text][1])
    if m := re.fullmatch(r"(\d{1,4})([dwmy])", text):
        n, unit = int(m[1]), m[2]
        if unit in "dw":
            return second(now - dt.timedelta(days=n * (7 if unit == "w" else 1))), None
        months = now.year * 12 + now.month - 1 - n * (12 if unit == "y" else 1)
        year, month = months // 12, months % 12 + 1
        last = (dt.datetime(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
        return second(now.replace(year=year, month=month, day=min(now.day, last))), None
    if m := re.fullmatch(r"(.+?)\.\.(.+)", text):
        a, b = _span(m[1]), _span(m[2])
        return (second(a[0]), second(b[1])) if a and b else None
    m = re.fullmatch(r"(>=|<=|>|<|=)?(.+)", text)
    s = _span(m[2]) if m else None
    if not s:
        return None
    return {">": (second(s[1]), None), ">=": (second(s[0]), None), "<": (None, second(s[0])), "<=": (None, second(s[1]))}.get(m[1], (second(s[0]), second(s[1])))


def typed_path(text: str) -> list[str] | None:
    """The folded parts of an absolute path, typed or pasted whole (in quotes too), the name last; None if the text is
    none. Its spaces are in the names, not between terms."""
    body = re.fullmatch(r'\s*("?)(.*?)\1\s*', text)[2]
    if not re.fullmatch(r"""(?:[A-Za-z]:|[\\/]{2}[^\\/:*?"<>|\s][^\\/:*?"<>|]*)(?:[\\/][^:*?"<>|]*)?""", body):
        return None
    parts = T.fold(body).replace("/", "\\").split("\\")
    return [*parts, ""] if len(parts) == 1 else [*parts[:-1], parts[-1].strip()]


def parse(text: str, regex_mode: bool = False, now: dt.datetime | None = None) -> list[Way]:
    """Ways to match (an or of ands)."""
    now = now or dt.datetime(2026, 1, 1)
    if not regex_mode and (path := typed_path(text)):
        return [Way([Term("word", path[-1], ancestors=[a for a in path[:-1] if a])])]
    ways, any_token, bar = [Way()], False, False
    for token in tokens(text):
        plain = "".join(c for c, _ in token)
        loose = "".join(c if not q else "\0" for c, q in token)
        if loose == "|":
            if not any_token or bar:
                raise QueryError("nothing on one side of |")
            if len(ways) >= MAX_WAYS:
                raise QueryError("too many alternatives")
            ways.append(Way())
            bar = True
            continue
        if not plain:
            continue
        any_token, bar, way = True, False, ways[-1]
        low = T.fold(loose)
        if low.startswith("ext:") and len(plain) > 4:
            way.extensions |= {T.fold(x).lstrip("*").lstrip(".") for x in re.split(r"[,;|]", plain[4:]) if x}
            continue
        if low.startswith("size:") and (s := parse_size(plain[5:])):
            way.sizes.append(s)
            continue
        if low.startswith("dm:") and (t := parse_time(plain[3:], now)):
            way.times.append(t)
            continue
        negated = loose[0] == "!" and len(plain) > 1
        if negated:
            plain, loose, low = plain[1:], loose[1:], low[1:]
        prefix = next((p for p in ("regex:", "re:") if low.startswith(p)), None)
        if regex_mode or prefix:
            pattern = plain[len(prefix or "") :]
            try:
                re.compile(re.sub(r"\(\?-?[a-zA-Z]+\)", "", pattern))  # switches that only Java has are its own to read
            except re.error as e:
                raise QueryError(f"unreadable regular expression: {pattern}") from e
            way.terms.append(Term("regex", pattern, negated))
        elif loose[0] == "^" or loose[-1] == "$" and len(plain) > 1:
            body = T.fold(plain[1:] if loose[0] == "^" else plain)
            tail = loose[-1] == "$"
            body = body[:-1] if tail and body else body
            way.terms.append(Term("anchor", ("^" if loose[0] == "^" else "") + T.quote(body) + ("$" if tail else ""), negated))
        else:
            folded = T.fold(plain).replace("/", "\\") if "\\" in plain or re.match(r"[^\s]+/[^\s]*", plain) and not any(q for _, q in token) else T.fold(plain)
            *ancestors, last = folded.split("\\")
            kind = "glob" if re.search(r"[*?]", last) else "word"
            way.terms.append(Term(kind, last, negated, [a for a in ancestors if a], exact=any(q for _, q in token)))
    if bar:
        raise QueryError("nothing on one side of |")
    return ways


@dataclass
class Fields:
    """The columns that a query reads."""

    name: Column
    name_folded: Column
    folders: Column  # folded names of the folders above, outermost first
    ext: Column
    is_dir: Column
    size: Column
    modified: Column
    sounds: Column | None = None  # terms to how the name sounds like them, where readings were joined


def fields(prefix: str = "", sounds: bool = False) -> Fields:
    c = lambda n: F.col(prefix + n)
    return Fields(c("name"), c("name_folded"), c("folders"), c("ext"), c("is_dir"), c("size"), c("modified"), c("sounds") if sounds else None)


def in_folders(ancestors: list[str], folders: Column) -> Column:
    """Every part is in the name of a folder above, innermost first, gaps allowed."""
    parts = F.array(*[F.lit(a) for a in ancestors])
    left = F.aggregate(F.reverse(folders), F.lit(len(ancestors)), lambda k, x: F.when((k > 0) & F.contains(x, F.element_at(parts, F.greatest(k, F.lit(1)))), k - 1).otherwise(k))
    return left == 0


def _name_hit(term: Term, f: Fields) -> Column:
    if term.kind == "regex":
        hit = f.name.rlike(f"(?iU){term.text}")
        first = need_of(term.text).column(f.name_folded)
        return hit if first is None else first & hit
    if term.kind == "anchor":
        body = term.text.strip("^$")
        return f.name_folded.rlike(term.text) if body else F.lit(False)
    if term.kind == "glob":
        return f.name_folded.rlike(T.glob_regex(term.text))
    if not term.text:
        return F.lit(True)
    hit = F.contains(f.name_folded, F.lit(term.text))
    if term.negated or term.exact:
        return hit
    if f.sounds is not None and pinyin.is_term(term.text):
        hit = hit | f.sounds.getItem(term.text).isNotNull()
    if initials := T.initials_regex(term.text):
        hit = hit | (f.ext.isin(PROGRAMS) & f.name.rlike(initials))
    return hit


def _term(term: Term, f: Fields) -> Column:
    hit = _name_hit(term, f)
    if term.ancestors:
        hit = hit & in_folders(term.ancestors, f.folders)
    return ~hit if term.negated else hit


def _in_any_folder(text: str, folders: Column) -> Column:
    return F.exists(folders, lambda x: F.contains(x, F.lit(text)))


def _way(way: Way, f: Fields, fallback: bool) -> Column:
    parts: list[Column] = []
    if way.extensions:
        parts.append(~f.is_dir & f.ext.isin(sorted(way.extensions)))
    parts += [~f.is_dir & (f.size >= lo) & (F.lit(True) if hi is None else f.size < hi) for lo, hi in way.sizes]
    parts += [(f.modified >= KNOWN_FROM) & (F.lit(True) if lo is None else f.modified >= lo) & (F.lit(True) if hi is None else f.modified < hi) for lo, hi in way.times]
    words = [t for t in way.positive if t.kind == "word" and not t.ancestors and t.text]
    loose = fallback and (len(way.positive) >= 2 or way.extensions and way.positive) and words
    for t in sorted(way.terms, key=lambda t: (t.kind == "regex", bool(t.ancestors), t.negated, -len(t.text))):
        hit = _term(t, f)
        if loose and t in words:  # such a word may be a folder's
            hit = hit | _in_any_folder(t.text, f.folders)
        parts.append(hit)
    if loose and not way.extensions:  # one word at least is the name's own
        parts.append(reduce(Column.__or__, [_name_hit(t, f) for t in way.positive]))
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def predicate(ways: list[Way], f: Fields, fallback: bool = True) -> Column:
    """True where an entry matches; null, which a filter drops too, may stand for false where a value is unknown. So the
    parts stay a plain AND that Catalyst splits and pushes into the scan."""
    return reduce(Column.__or__, [_way(w, f, fallback) for w in ways])


#: Kinds of files by keyword: `pic: beach` or `:pic beach`.
TYPES = {
    "pic": ["bmp", "gif", "ico", "jpeg", "jpg", "png", "svg", "tif", "tiff", "webp"],
    "doc": ["csv", "doc", "docx", "md", "pdf", "ppt", "pptx", "rtf", "txt", "xls", "xlsx"],
    "video": ["avi", "flv", "mkv", "mov", "mp4", "webm", "wmv"],
    "audio": ["aac", "flac", "m4a", "mp3", "ogg", "wav"],
    "zip": ["7z", "bz2", "gz", "rar", "tar", "xz", "zip"],
}


def split_types(text: str) -> tuple[str, list[str] | str | None]:
    """The text without its first type keyword, and that type's extensions (`folder` for folders), None if there is none.

    Several types are joined by commas; a keyword of which a part is unknown is a word like others; one letter is a drive.
    """
    for m in re.finditer(r'(?:"[^"]*"?)|(\S+)', text):
        word = T.fold(m[1] or "")
        body = word[1:] if word.startswith(":") else word[:-1] if word.endswith(":") else ""
        names = [x for x in body.split(",") if x]
        if len(body) > 1 and names and all(x in TYPES or x == "folder" for x in names):
            rest = f"{text[: m.start()]} {text[m.end() :]}".strip()
            return rest, "folder" if names == ["folder"] else sorted({e for x in names for e in TYPES.get(x, [])})
    return text, None


def with_types(text: str, f: Fields, **options) -> Column:
    """The predicate of a text that may name a type."""
    rest, kinds = split_types(text)
    hit = predicate(parse(rest, **options), f) if rest else F.lit(True)
    if kinds is None:
        return hit
    return f.is_dir & hit if kinds == "folder" else ~f.is_dir & f.ext.isin(kinds) & hit


def quick_filters(text: str, filters: dict[str, str]) -> tuple[str, list[str]]:
    """The text without keywords of saved filters (`:name` or `name:`), and those filters' texts; unreadable ones go."""
    kept, found = [], []
    for token in text.split():
        name = T.fold(token).strip(":")
        if token.startswith(":") != token.endswith(":") and name in filters:
            found.append(filters[name])
        else:
            kept.append(token)

    def readable(x: str) -> bool:
        try:
            return bool(parse(x))
        except QueryError:
            return False

    return " ".join(kept), [x for x in found if readable(x)]


def with_filters(text: str, filters: dict[str, str], f: Fields, **options) -> Column:
    """A text and the saved filters that it names, all of which must hold; filters never rank."""
    rest, found = quick_filters(text, filters)
    return reduce(Column.__and__, [predicate(parse(x, **options), f) for x in [rest, *found] if x], F.lit(True))


def exact_name(ways: list[Way], f: Fields) -> Column:
    """Named just what was typed, with or without the extension: of a text with one way and one plain word to be found."""
    words = ways[0].positive if len(ways) == 1 else []
    if len(words) != 1 or words[0].kind != "word" or not words[0].text:
        return F.lit(False)
    return (f.name_folded == words[0].text) | (~f.is_dir & (T.stem(f.name_folded) == words[0].text))


def heard(entries, ways: list[Way], readings):
    """entries with how their names sound like a text's words, where it has words that may be meant so."""
    terms = sorted({t.text for w in ways for t in w.positive if t.kind == "word" and not t.exact and pinyin.is_term(t.text)})
    return pinyin.with_heard(entries, readings, terms) if readings is not None and terms else entries


def search(entries, text: str, regex_mode: bool = False, now: dt.datetime | None = None, readings=None, fallback: bool = True):
    """The entries that a search text finds; with readings (char, reading, place) Han names by their sound too."""
    ways = parse(text, regex_mode, now)
    rows = heard(entries, ways, readings)
    return rows.where(predicate(ways, fields(sounds="sounds" in rows.columns), fallback))


def homophones(text: str, readings) -> list[list[Way]]:
    """Texts that sound like one: its Han words read as pinyin, pinyin.MOST_READINGS combinations at most. A text with
    several ways or a regular expression has none. Only the readings of the typed characters are fetched."""
    ways = parse(text)
    if len(ways) != 1 or any(t.kind == "regex" for t in ways[0].terms):
        return []
    words = [i for i, t in enumerate(ways[0].terms) if t.kind == "word" and not t.negated and re.search("[\u4e00-\u9fff]", t.text)]
    if not words:
        return []
    typed = sorted({c for i in words for c in ways[0].terms[i].text if not c.isascii()})
    known: dict[str, list[str]] = {}
    for r in readings.where(F.col("char").isin(typed)).orderBy("char", "place").collect():  # those of a typed text
        known.setdefault(r.char, []).append(r.reading)
    out = []
    for sounds in islice(product(*(pinyin.spoken(ways[0].terms[i].text, known) for i in words)), pinyin.MOST_READINGS):
        terms = list(ways[0].terms)
        for i, sound in zip(words, sounds):
            terms[i] = replace(terms[i], text=sound, exact=False)
        out.append([replace(ways[0], terms=terms)])
    return out
