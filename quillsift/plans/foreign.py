"""Search texts of another desktop tool, as launchers and file managers send them, said in this library's terms.

A text becomes a query of our own grammar and a few conditions that the grammar has no words for: a kind of entry,
folders to look in, a folder whose own entries are meant, starts of full paths, a count. What can't be said is refused,
and a refused text finds nothing: an empty answer is better than a wrong one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import fold, folded
from quillsift.plans import query as Q

# The other tool's modifiers that say how a word is compared, which our grammar does its own way.
COMPARING = frozenset(
    """case nocase ww wholeword noww nowholeword wfn wholefilename nowfn nowholefilename exact path nopath wildcards nowildcards
    diacritics nodiacritics noregex ascii utf8 utf16 name basename""".split()
)
# Its functions that ask for what no entry knows.
UNKNOWN = frozenset(
    """attrib attributes dc datecreated da dateaccessed dr daterun rc recentchange runcount content ansicontent utf8content
    utf16content utf16becontent dupe namepartdupe sizedupe dmdupe dcdupe dadupe attribdupe empty child childcount childfilecount
    childfoldercount len startwith endwith type depth parents fsi filelist filelistfilename frn shell width height dimensions
    orientation bitdepth album artist genre title track comment year""".split()
)
KINDS = {"file": "files", "files": "files", "folder": "folders", "folders": "folders"}
#: d and !d of attrib:, plain and negated.
ATTRIBUTES = {("d", False): "folders", ("d", True): "files", ("!d", False): "files", ("!d", True): "files"}


@dataclass(frozen=True)
class Meant:
    """What a text means; `refused` names what can't be said."""

    words: tuple[str, ...] = ()
    kind: str = "any"
    folders: tuple[str, ...] = ()
    direct_in: str = ""
    starts: tuple[str, ...] = ()
    count: int | None = None
    roots: bool = False
    regex: bool = False
    refused: str = ""

    @property
    def query(self) -> str:
        return " ".join(self.words)


def _bare(text: str) -> str:
    return text.replace('"', "")


def _end(path: str) -> str:
    return path.rstrip("\\")


def _rooted(path: str) -> bool:
    return re.match(r"[A-Za-z]:\\|\\\\[^\\]+\\[^\\]", path) is not None


def _also(known: tuple[str, ...], more: str) -> tuple[str, ...]:
    return known if fold(more) in map(fold, known) else (*known, more)


def _place(m: Meant, word: str) -> Meant | None:
    """A full path as a place: with a backslash behind it a folder, with wildcards in its last part names in that folder,
    else a start of full paths. None for what is no place."""
    path = _bare(word)
    if not _rooted(path):
        return None
    if path.endswith("\\"):
        return None if re.search(r"[*?]", path) else replace(m, folders=_also(m.folders, _end(path)))
    folder, last = path.rsplit("\\", 1)
    if re.search(r"[*?]", folder):
        return None
    if not re.search(r"[*?]", last):
        return replace(m, starts=_also(m.starts, path))
    return replace(m, folders=_also(m.folders, folder), words=(*m.words, f'"{last}"' if " " in last else last))


def _asked(m: Meant, name: str, rest: str, negated: bool) -> Meant | str | None:
    """A function: what is meant with it, or the word that it leaves, or None for no function."""
    if name in COMPARING:
        return rest
    if name in KINDS:
        return replace(m, kind=KINDS[name])
    if name in ("parent", "infolder", "nosubfolders"):
        return replace(m, direct_in=_end(_bare(rest)), refused=f"!{name}:" if negated else m.refused)
    if name in ("attrib", "attributes") and (kind := ATTRIBUTES.get((rest.lower(), negated))):
        return replace(m, kind=kind)
    if name == "root":
        return replace(m, roots=True, refused="root:" if negated or rest else m.refused)
    if name == "count":
        return replace(m, count=int(rest)) if re.fullmatch(r"[0-9]+", rest) else m
    return replace(m, refused=f"{name}:") if name in UNKNOWN else None


def _token(m: Meant, token: str) -> Meant:
    negated = len(token) > 1 and token[0] == "!"
    word = token[negated:]
    while found := re.match(r"([A-Za-z]{2,}[0-9]*[A-Za-z]*):(.*)", word, re.S):
        name, rest = found[1].lower(), found[2]
        if name in ("ext", "datemodified"):
            word = f"ext:{_bare(rest).replace(';', ',')}" if name == "ext" else f"dm:{rest}"
            break
        told = _asked(m, name, rest, negated)
        if told is None:
            break
        if isinstance(told, str):
            word = told
        elif name in KINDS:
            m, word = told, rest
        else:
            return told
    if not word:
        return m
    if not negated:
        if word in ("?:", "*:"):
            return replace(m, roots=True)
        if placed := _place(m, word):
            return placed
    return replace(m, words=(*m.words, f"!{word}" if negated else word))


def _groups(text: str) -> tuple[str, tuple[str, ...], bool]:
    """The text without its groups, the folders that groups list, and whether a group is something else. A `<` opens a
    group only where a word begins."""
    out, folders, other, at = [], (), False, 0
    for m in re.finditer(r'"[^"]*"?|(?<![^\s!<|])<', text):
        if m[0][0] == '"' or m.start() < at:
            continue
        end = re.compile(r'(?:"[^"]*"?|[^">])*').match(text, m.end()).end()
        parts = [_bare(p).strip() for p in text[m.end() : end].split("|")]
        known = end < len(text) and all(_rooted(p) and p.endswith("\\") or re.fullmatch(r"[A-Za-z]:\\", p) for p in parts)
        for p in parts if known else ():
            folders = _also(folders, _end(p))
        other |= not known
        out.append(text[at : m.start()])
        at = min(end + 1, len(text))
    return " ".join([*out, text[at:]]), folders, other


def translate(text: str, regex: bool = False) -> Meant:
    """What a text of the other tool means; with its regex option all of it is one expression."""
    if regex:
        return Meant(words=(text.strip(),) if text.strip() else (), regex=bool(text.strip()))
    text, folders, other = _groups(text)
    m = Meant(folders=folders, refused="<>" if other else "")
    apart = re.sub(r'("[^"]*"?)|\|', lambda x: x[1] or " | ", text)
    for token in re.findall(r'(?:"[^"]*"?|[^\s"])+', apart):
        m = _token(m, token)
    more = m.words or m.folders or m.starts or m.direct_in
    return replace(m, refused="root:") if m.roots and more else m


def _under(path: Column, folder: str) -> Column:
    return F.startswith(path, F.lit(fold(folder) + "\\"))


def predicate(m: Meant) -> Column:
    """The conditions beside the query."""
    path, hits = folded(F.col("path")), [F.lit(True)]
    if m.kind != "any":
        hits.append(F.col("is_dir") == (m.kind == "folders"))
    if m.folders:
        hits.append(reduce(Column.__or__, [_under(path, f) for f in m.folders]))
    if m.direct_in:
        hits += [_under(path, m.direct_in), F.octet_length(path) == len(fold(m.direct_in).encode()) + 1 + F.octet_length("name_folded")]
    if m.starts:
        hits.append(reduce(Column.__or__, [F.startswith(path, F.lit(fold(s))) for s in m.starts]))
    if m.roots:
        hits.append(F.col("depth") == 0)
    return reduce(Column.__and__, hits)


def search(entries: DataFrame, text: str, regex: bool = False, **options) -> DataFrame:
    """The entries that a text finds; a refused one finds none."""
    m = translate(text, regex)
    if m.refused:
        return entries.where(F.lit(False))
    rows = entries.where(predicate(m))
    if m.query:
        try:
            rows = Q.search(rows, m.query, regex_mode=m.regex, **options)
        except Q.QueryError:
            return entries.where(F.lit(False))
    return rows if m.count is None else rows.orderBy("id").limit(m.count)
