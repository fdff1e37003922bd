"""Quality by a regularised quadratic discriminant over statistics of whole texts.

Each class has a Gaussian over transformed statistics. Its covariance is shrunk towards the pooled one and its diagonal;
the shrinkage is the one of SHRINKAGE that fits held-out documents best. A score is the calibrated difference of the
Mahalanobis log densities, from Cholesky factors that are computed once. The fit is on a bounded sample of labelled
documents (MAX_DOCS of each class).

Defined results: null and blank texts have the statistics of nothing and are scored; without labels of both classes
every score is the smoothed share of class 1; equal texts get equal scores; null doc_ids are scored and never learnt
from; added columns replace columns of the same name; empty tables work.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, prepare, released, slices, without, written
from .learning import labelled_sample, platt, sigmoid

MAX_DOCS = 6000
SHRINKAGE = (0.02, 0.1, 0.3, 0.6)

_KIND = np.zeros(256, np.uint8)
for _c in range(256):
    _k = 1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c in b" \t\n\r\x0b\x0c" else 6 if _c >= 128 else 5
    _KIND[_c] = _k
_MARKS, _SYMBOLS = b".,;:?'\"-()", b"#$%&*+/<=>@[\\]^_`{|}~"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_MARKS)], _CLASS[list(_SYMBOLS)], _CLASS[33] = 1, 2, 3


def statistics(text: bytes | None) -> np.ndarray:
    """Transformed statistics of a whole text: logs of sizes, roots of shares."""
    text = text or b""
    data = np.frombuffer(text, np.uint8)
    n = max(1, len(data))
    kinds = np.bincount(_KIND[data], minlength=7)
    classes = np.bincount(_CLASS[data], minlength=4)
    letters = max(1, kinds[1] + kinds[2])
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    upper = sum(w.isupper() for w in words)
    shares = [
        kinds[2] / letters, kinds[3] / n, classes[1] / n, classes[2] / n, classes[3] / n, kinds[4] / n, kinds[6] / n,
        repeats / m, counts.most_common(1)[0][1] / m if words else 0, 1 - len(set(full)) / max(1, len(full)),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in full) / max(1, len(full)), upper / m,
        sum(not any(48 <= c <= 57 or 97 <= c | 32 <= 122 or c >= 128 for c in w) for w in counts) / max(1, len(counts)),
        (lengths <= 3).mean(),
    ]
    sizes = [np.log1p(len(text)), np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(len(counts)) / np.log1p(m), np.log1p(len(full)), np.log1p(m / max(1, len(full)))]
    return np.concatenate([sizes, np.sqrt(np.array(shares, float))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            values = [statistics(t).tolist() for t in as_bytes(column(part, "text"))]
            yield pa.record_batch([column(part, "label").cast(pa.int32()), pa.array(values, pa.list_(pa.float64()))], ["label", "x"])


class _Gauss:
    """Mean, and the Cholesky factor of the inverse's use."""

    def __init__(self, x: np.ndarray, pooled: np.ndarray, shrink: float):
        self.mean = x.mean(axis=0)
        own = np.cov(x, rowvar=False, bias=True) if len(x) > 1 else pooled
        mixed = (1 - shrink) * own + shrink * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled)))
        self.factor = np.linalg.cholesky(mixed + 1e-6 * np.eye(len(mixed)))
        self.half_log_det = float(np.log(np.diag(self.factor)).sum())
        self.solve = np.linalg.inv(self.factor)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.solve.T
        return -0.5 * (z * z).sum(axis=-1) - self.half_log_det


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, shares: dict[int, float]):
        self.classes = None
        n1, n0 = int((y == 1).sum()), int((y == 0).sum())
        self.slope, self.offset = 0.0, float(np.log((shares.get(1, 0) + 1e-3) / (shares.get(0, 0) + 1e-3)))
        if n1 < 2 or n0 < 2:
            return
        self.center, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.center) / self.spread
        held = np.zeros(len(y), bool)
        for k in (0, 1):
            at = np.random.default_rng(k).permutation(np.flatnonzero(y == k))
            held[at[: len(at) // 4]] = True
        weights = np.where(y == 1, shares[1] / n1, shares[0] / n0) * len(y)
        best = None
        for shrink in SHRINKAGE:
            model = self._classes(x[~held], y[~held], shrink)
            use = held if held.any() and len(set(y[held].tolist())) == 2 else ~held
            raw = self._raw(model, x[use])
            slope, offset = platt(raw, y[use], weights[use])
            p = sigmoid(slope * raw + offset)
            loss = -(weights[use] * np.where(y[use] == 1, np.log(p), np.log(1 - p))).sum()
            if best is None or loss < best[0]:
                best = loss, shrink, slope, offset
        _, self.shrink, self.slope, self.offset = best
        self.classes = self._classes(x, y, self.shrink)

    @staticmethod
    def _classes(x, y, shrink):
        parts = [x[y == k] for k in (0, 1)]
        pooled = sum(np.cov(p, rowvar=False, bias=True) * len(p) for p in parts) / len(x)
        return [_Gauss(p, pooled, shrink) for p in parts]

    @staticmethod
    def _raw(classes, x):
        d = classes[1].log_density(x) - classes[0].log_density(x)
        return np.sign(d) * np.log1p(np.abs(d))

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(stats), float(sigmoid(self.offset)))
        return sigmoid(self.slope * self._raw(self.classes, (stats - self.center) / self.spread) + self.offset)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model:
    """labels are (doc_id, quality); learn picks the rows that may be learnt from."""
    prepare(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn
    sample = labelled_sample(docs, labels, "quality", MAX_DOCS, learn)
    rows = sorted(tuple(r) for r in written(sample.mapInArrow(released(_rows), "label int, x array<double>"), "statistics").collect())
    found = {r.quality: r["count"] for r in labels.where(learn & F.col("quality").isNotNull()).groupBy("quality").count().collect()}
    total = sum(found.values())
    shares = {k: v / total for k, v in found.items()} if total else {}
    return Model(np.array([r[1] for r in rows]), np.array([r[0] for r in rows], int), shares)  # MAX_DOCS of each class


def _score(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = model.value.score(np.array([statistics(t) for t in as_bytes(column(part, "text"))]))
                yield pa.record_batch([*[column(part, n) for n in names], pa.array(scores, pa.float64())], [*names, "quality_score"])

    return released(run)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality_score (0 to 1)."""
    prepare(docs.sparkSession)
    docs = without(docs, ["quality_score"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two means and two factors
    return docs.mapInArrow(_score(shared, docs.columns), f"{schema}, quality_score double")
