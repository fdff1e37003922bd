"""Language identification in two steps: the family first, then one-versus-one linear SVMs within the family.

A text's features are the square roots of its counts of hashed letter trigrams, as a unit vector. Families are told
apart by one-versus-rest linear SVMs; the languages of a family by an SVM for each pair. Every SVM is trained here by
dual coordinate descent on a bounded sample (MAX_DOCS documents of each language, at most MAX_TOTAL) and its margins
become probabilities by Platt scaling on documents that it was not trained on.

Defined results: null texts and texts without letters are `und` with score 0; without anything to learn from, every
text is `und`; languages that FAMILIES does not list are families of their own; null doc_ids and languages are never
learnt from; equal texts get equal results; added columns replace columns of the same name; empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, prepare, released, slices, without, written
from .learning import labelled_sample, platt, sigmoid

MAX_DOCS, MAX_TOTAL = 800, 12_000
BITS = 14
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "nb": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic",
}

_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, bytes of other characters as they are, all else a space.
_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)
_CHUNK = 1 << 20


def features(text: bytes) -> np.ndarray:
    """Unit vector of the roots of hashed trigram counts; the text may be of any length."""
    counts = np.zeros(1 << BITS, np.int64)
    for at in range(0, max(1, len(text) - 2), _CHUNK):
        codes = _BYTES[np.frombuffer(text[at : at + _CHUNK + 2], np.uint8)]
        if len(codes) < 3:
            codes = np.concatenate([codes, np.full(3 - len(codes), 32, np.uint32)])
        grams = (codes[:-2] * np.uint32(65536) + codes[1:-1] * np.uint32(256) + codes[2:]) * np.uint32(2654435761)
        counts += np.bincount(grams >> np.uint32(32 - BITS), minlength=1 << BITS)
    counts[(0x202020 * 2654435761 % 2**32) >> (32 - BITS)] = 0  # three spaces
    x = np.sqrt(counts.astype(np.float32))
    n = np.sqrt((x * x).sum())
    return x / n if n else x


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            places, weights = [], []
            for text in as_bytes(column(part, "text")):
                x = features(text or b"")
                at = np.flatnonzero(x)
                places.append(at.astype(np.uint16).tobytes())
                weights.append(x[at].astype(np.float16).tobytes())
            yield pa.record_batch([column(part, "label"), pa.array(places, pa.binary()), pa.array(weights, pa.binary())], ["label", "places", "weights"])


class Svm:
    """A linear SVM (hinge loss, L2) with a calibrated margin."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, epochs: int = 8):
        order = np.random.default_rng(0).permutation(len(rows))
        held = set(order[: len(rows) // 5].tolist()) if len(rows) >= 20 else set()
        train = [i for i in range(len(rows)) if i not in held]
        self.w, self.b = np.zeros(1 << BITS, np.float32), 0.0
        alpha, rng = np.zeros(len(rows)), np.random.default_rng(1)
        norms = np.array([float((v * v).sum()) + 1 for _, v in rows])
        for _ in range(epochs):
            for i in rng.permutation(train).tolist():
                at, v = rows[i]
                margin = y[i] * (float(self.w[at] @ v) + self.b)
                new = min(max(alpha[i] - (margin - 1) / norms[i], 0.0), c)
                if new != alpha[i]:
                    step = (new - alpha[i]) * y[i]
                    self.w[at] += np.float32(step) * v
                    self.b += step
                    alpha[i] = new
        use = sorted(held) or train
        margins = np.array([float(self.w[rows[i][0]] @ rows[i][1]) + self.b for i in use])
        self.slope, self.offset = platt(margins, (y[use] > 0).astype(int), np.ones(len(use)), ridge=1e-2)


class Model:
    def __init__(self, rows: list[tuple[str, bytes, bytes]]):
        names = np.array([r[0] for r in rows])
        vectors = [(np.frombuffer(r[1], np.uint16).astype(int), np.frombuffer(r[2], np.float16).astype(np.float32)) for r in rows]
        langs = sorted(set(names.tolist()))
        self.families = {f: [x for x in langs if FAMILIES.get(x, x) == f] for f in sorted({FAMILIES.get(x, x) for x in langs})}
        columns, self.scale = [], []
        family = np.array([FAMILIES.get(x, x) for x in names.tolist()])

        def add(vectors, y):
            m = Svm(vectors, y)
            columns.append(m.w)
            self.scale.append((m.slope, m.slope * m.b + m.offset))
            return len(columns) - 1

        self.rest = {f: add(vectors, np.where(family == f, 1, -1)) for f in self.families} if len(self.families) > 1 else {}
        self.pairs = {}
        for members in self.families.values():
            for a, b in combinations(members, 2):
                use = np.flatnonzero((names == a) | (names == b))
                self.pairs[a, b] = add([vectors[i] for i in use], np.where(names[use] == a, 1, -1))
        self.weights = np.stack(columns, axis=1) if columns else np.zeros((1 << BITS, 0), np.float32)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.families or not _LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0
        x = features(text)
        at = np.flatnonzero(x)
        margins = x[at] @ self.weights[at]
        p = [float(sigmoid(a * m + b)) for m, (a, b) in zip(margins.tolist(), self.scale)]
        total = sum(p[i] for i in self.rest.values())
        share = {f: p[self.rest[f]] / total if total else 1 / len(self.rest) for f in self.rest} or dict.fromkeys(self.families, 1.0)
        best = max(share, key=lambda f: (share[f], f))
        members = self.families[best]
        wins = {m: 0.0 for m in members}
        for (a, b), i in self.pairs.items():
            if a in wins and b in wins:
                wins[a] += p[i]
                wins[b] += 1 - p[i]
        lang = max(wins, key=lambda m: (wins[m], m))
        inside = wins[lang] / sum(wins.values()) if len(members) > 1 else 1.0
        return lang, min(1.0, max(0.0, share[best] * inside))


def fit(docs: DataFrame, learn: Column | None = None) -> Model:
    """docs have doc_id, text, lang; learn picks the rows that may be learnt from."""
    prepare(docs.sparkSession)
    labels = docs.select("doc_id", "lang")
    learn = F.lit(True) if learn is None else learn
    n = max(1, labels.where(learn & F.col("lang").isNotNull()).select("lang").distinct().count())
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "lang", max(1, min(MAX_DOCS, MAX_TOTAL // n)), learn)
    rows = written(sample.mapInArrow(released(_rows), "label string, places binary, weights binary"), "languages")
    return Model(sorted(tuple(r) for r in rows.collect()))  # MAX_TOTAL rows at most


def _predict(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                done = [m.predict(t) for t in as_bytes(column(part, "text"))]
                added = [pa.array([x for x, _ in done], pa.string()), pa.array([s for _, s in done], pa.float64())]
                yield pa.record_batch([*[column(part, n) for n in names], *added], [*names, "lang_pred", "lang_score"])

    return released(run)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and lang_score."""
    prepare(docs.sparkSession)
    docs = without(docs, ["lang_pred", "lang_score"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights for each SVM
    return docs.mapInArrow(_predict(shared, docs.columns), f"{schema}, lang_pred string, lang_score double")
