"""Fill-in-the-middle transformation: documents cut at two token boundaries, and their parts told in another order.

Tokens are `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+` from left to right. In UTF-8 such a token ends at
a byte that is no blank and stands before a blank or the end, and at the last byte. A batch of texts is viewed as uint64
words; the marks of eight bytes are made at once by sums that never carry into the next byte, `bitwise_count` counts them
word by word, a search in the running counts finds the word of a cut, and the k-th mark in that word is picked last.
Only two cuts a document are resolved; texts are never split into token lists.

A document's form and cuts come from the sha256 of "<seed>:<doc_id>", so a lost task makes the same rows again.

Defined results: a null text counts as empty; an empty text, and one that holds a sentinel, is plain; a null doc_id is
hashed as an empty string; equal doc_ids are cut alike; an empty table gives an empty result; added columns replace
columns of the same name, other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, column, prepare, released, slices, without

SENTINELS = ("<P>", "<S>", "<M>")
#: Documents of a hundred that are cut, and cut ones of a hundred that put the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
ADDED = ["n", "form", "prefix_chars", "middle_chars", "fim"]

_ONES = np.uint64(0x0101010101010101)
_LOW, _HIGH = _ONES * np.uint64(0x7F), _ONES * np.uint64(0x80)
#: Words that are marked at a time: the sums' temporaries stay small for a very long text.
_STEP = 1 << 17


def _at_least(low: np.ndarray, byte: int) -> np.ndarray:
    """High bit of each byte whose seven low bits are `byte` or more; 127 + 128 - byte fits in eight bits."""
    return low + _ONES * np.uint64(0x80 - byte)


def blanks(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that is 0x20 or 0x09 to 0x0D."""
    low = words & _LOW
    found = (_at_least(low, 0x09) & ~_at_least(low, 0x0E)) | (_at_least(low, 0x20) & ~_at_least(low, 0x21))
    return found & ~words & _HIGH


def ends(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Marks (high bits of uint64 words) of the bytes that end a token; `last` are the places of texts' last bytes."""
    padded = np.full((len(data) // 8 + 2) * 8, 0x20, np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8")
    out = np.zeros(len(words), np.uint64)
    for at in range(0, len(words) - 1, _STEP):
        part = blanks(words[at : at + _STEP + 1])
        following = (part[:-1] >> np.uint64(8)) | (part[1:] << np.uint64(56))
        out[at : at + len(part) - 1] = ~part[:-1] & _HIGH & following
    np.bitwise_or.at(out, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) << np.uint64(3)))
    return out


class Ranks:
    """Counts of marks before a byte, and the byte after the k-th mark."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, place: np.ndarray) -> np.ndarray:
        word, shift = place >> 3, (place & 7).astype(np.uint64) << np.uint64(3)
        mask = (np.uint64(1) << shift) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & mask)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th mark of all (from 1)."""
        word = np.searchsorted(self.before, k, side="left") - 1
        left, bits = k - self.before[word] - 1, self.marks[word]
        for i in range(7):  # clear the marks before it
            bits = np.where(left > i, bits & (bits - np.uint64(1)), bits)
        lowest = bits & (~bits + np.uint64(1))
        return word * 8 + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8 + 1


def cuts(texts: list[bytes], draws: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, and the bytes at which its middle and its suffix begin, by two drawn numbers a text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    stop = np.cumsum(sizes)
    start = stop - sizes
    ranks = Ranks(ends(np.frombuffer(b"".join(texts), np.uint8), stop[sizes > 0] - 1))
    first = ranks.rank(start)
    n = ranks.rank(stop) - first
    places = np.sort(np.array(draws, np.int64).reshape(-1, 2) % (n + 1)[:, None], axis=1)
    out = [np.where(k > 0, ranks.select(np.maximum(first + k, 1)) - start, 0) if len(ranks.marks) and stop[-1] else np.zeros_like(k) for k in places.T]
    return n, out[0], out[1]


def transformed(text: bytes, begin: int, end: int, form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytes:
    p, s, m = sentinels
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    if form == "psm":
        return b"".join((p, prefix, s, suffix, m, middle))
    return b"".join((s, suffix, p, prefix, m, middle)) if form == "spm" else text


def _chars(part: bytes) -> int:
    """Code points: the bytes that don't continue one."""
    return int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))


def _apply(seed: int, rate: int, suffix_first: int, sentinels: tuple[str, str, str]):
    marks = tuple(s.encode() for s in sentinels)

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in as_bytes(column(part, "text"))]
        ids = ("" if i is None else str(i) for i in column(part, "doc_id").to_pylist())
        hexes = [hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids]
        draws = [tuple(int(h[at : at + 8], 16) for at in (0, 8, 16, 24)) for h in hexes]
        n, begin, end = cuts(texts, [d[:2] for d in draws])
        forms, prefixes, middles, outs = [], [], [], []
        for text, d, i, j in zip(texts, draws, begin.tolist(), end.tolist()):
            plain = not text or d[2] % 100 >= rate or any(m in text for m in marks)
            form = "plain" if plain else "spm" if d[3] % 100 < suffix_first else "psm"
            forms.append(form)
            prefixes.append(None if plain else _chars(text[:i]))
            middles.append(None if plain else _chars(text[i:j]))
            outs.append(transformed(text, i, j, form, marks))
        made = [pa.array(n, pa.int64()), pa.array(forms), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outs, pa.binary()).cast(pa.string())]
        return pa.record_batch([*part.columns, *made], [*part.schema.names, *ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield one(part)

    return released(run)


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with `n` tokens, `form` (plain, psm or spm), `prefix_chars` and `middle_chars` (null if plain), and `fim`, the
    transformed text. Narrow: each row is made from itself alone, within its scan's task."""
    prepare(docs.sparkSession)
    rows = without(docs, ADDED)
    more = [T.StructField(a, t) for a, t in zip(ADDED, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()))]
    return rows.mapInArrow(_apply(seed, rate, suffix_first, sentinels), T.StructType([*rows.schema.fields, *more]))


def restored(fim: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that a transformed one was made from. No sentinel lies in a part, and none arises where parts meet, as `<`
    only begins a sentinel: so each is found by its first occurrence."""
    p, s, m = sentinels
    lead, rest = F.when(form == "psm", F.lit(p)).otherwise(F.lit(s)), F.when(form == "psm", F.lit(s)).otherwise(F.lit(p))
    body = F.substring(fim, F.length(lead) + 1, F.length(fim))
    one = F.call_function("substring_index", body, rest, F.lit(1))
    after = F.substring(body, F.length(one) + F.length(rest) + 1, F.length(body))
    two = F.call_function("substring_index", after, F.lit(m), F.lit(1))
    middle = F.substring(after, F.length(two) + len(m) + 1, F.length(after))
    both = F.when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return F.when(form == "plain", fim).otherwise(both)
