"""Distinct grams of texts as lists of the texts that have them, made in Arrow batches by sorting numbers.

A task turns each place of a batch's texts where a gram starts into one number, gram before text, and sorts these: equal
neighbours are one posting, and a gram's texts stand side by side. So a batch gives one row for each of its different
grams and not one for each gram of each text, and a text's letters never become an array of strings.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose grams are sorted at a time, and rows of a batch whose postings go out together: a list has that many at most.
STEP, ROWS = 1 << 22, 1 << 13


def gram_lists(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(gram, keys) of rows' texts, normal ones (see content.normal): the grams of content.grams, a key in each gram's list
    once a row. A gram comes once for each batch of rows that has it; a null text has no grams."""
    kind = rows.schema[key].dataType.simpleString()
    picked = rows.select(F.col(key).alias("key"), text.alias("text"))
    return picked.mapInArrow(_lists(STEP, ROWS), f"gram string, keys array<{kind}>")


def _lists(step: int, most: int):
    """Everything that a worker runs is inside, so that it needs no import of this package."""
    import numpy as np
    import pyarrow as pa

    def different(numbers: np.ndarray) -> np.ndarray:
        """Sorted, each once; np.unique hashes them, which takes many times as long."""
        numbers.sort()
        return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers

    def starts(data: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Gram << 30 | row, distinct and sorted, of the grams that start at lo to hi. A gram is three ASCII letters of seven
        bits, or behind a flag one Han character or two."""
        part = np.concatenate([data[lo : hi + 5], np.zeros(5, np.uint8)])
        n = hi - lo
        row = np.repeat(np.arange(len(ends)), np.diff(np.clip(np.concatenate([[0], ends]), lo, hi)))
        left = ends[row] - np.arange(lo, hi)  # bytes of the text from here on
        plain = (part >= 0x20) & (part <= 0x7E)
        at = np.flatnonzero(plain[:n] & plain[1 : n + 1] & plain[2 : n + 2] & (left >= 3))
        a, b, c = (part[at + i].astype(np.uint64) for i in range(3))
        found = [different(((a << 14 | b << 7 | c) << 30) | row[at].astype(np.uint64))]
        if ((part >= 0xE3) & (part <= 0xE9)).any():
            at = np.flatnonzero((part[: n + 3] & 0xF0) == 0xE0)
            a, b, c = (part[at + i].astype(np.uint64) for i in range(3))
            char = (a & 15) << 12 | (b & 63) << 6 | (c & 63)
            han = np.zeros(n + 6, np.uint64)
            good = ((char >= 0x4E00) & (char <= 0x9FFF)) | ((char >= 0x3400) & (char <= 0x4DBF))
            han[at[good]] = char[good]
            at = np.flatnonzero(han[:n])
            one, two, mine = han[at], han[at + 3], row[at].astype(np.uint64)
            pair = (two > 0) & (left[at] >= 6)
            found.append(different(((1 << 33 | one) << 30) | mine))
            found.append(different(((1 << 33 | one[pair] << 16 | two[pair]) << 30) | mine[pair]))
        return np.concatenate(found)

    def spelled(code: int) -> str:
        if code >> 33:
            pair = code & 0xFFFFFFFF
            return (chr(pair >> 16) if pair >> 16 else "") + chr(pair & 0xFFFF)
        return chr(code >> 14) + chr(code >> 7 & 127) + chr(code & 127)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                keys, texts = part.column(0), part.column(1).fill_null("").cast(pa.large_string())
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                if offsets[-1] == offsets[0]:
                    continue
                data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                ends = offsets[1:] - offsets[0]
                found = [starts(data, ends, lo, min(lo + step, len(data))) for lo in range(0, len(data), step)]
                made = different(np.concatenate(found))
                codes, rows = made >> np.uint64(30), (made & np.uint64((1 << 30) - 1)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
                bounds = np.append(first, len(codes))
                lo = 0
                while lo < len(first):  # about a step's postings at a time
                    hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + step, "right")) - 1)
                    lists = pa.ListArray.from_arrays(pa.array(bounds[lo : hi + 1] - bounds[lo], pa.int32()), keys.take(pa.array(rows[bounds[lo] : bounds[hi]])))
                    yield pa.record_batch([pa.array([spelled(c) for c in codes[first[lo:hi]].tolist()], pa.string()), lists], ["gram", "keys"])
                    lo = hi

    return run
