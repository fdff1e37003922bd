"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

The examples are a bounded sample of labelled documents (MAX_EXAMPLES of each label); every word of theirs is a term of
the index. A term weighs (1 + log tf) * idf * z, where z says how far its shares of the two labels lie apart (two-proportion
z, 1 at least): words that go with neither label weigh little, but none is left out. Vectors have unit length.

Examples lie in blocks of BLOCK. Postings of rare terms are short and are merged whole. A common term has a weight for
every example, and its largest weight in each block: the sum of a query's block maxima bounds what its common terms can
add there, so blocks that cannot reach the k-th neighbour are not visited, and the neighbours are exact. Their votes,
weighted by similarity against a prior vote, become a probability by Platt scaling on left-one-out votes.

Defined results: null, empty and term-free texts have no neighbours and get the calibrated score of the prior vote;
without labels of both values every score is the smoothed share of label 1; equal texts get equal scores; of equally
near examples the one whose text has the smaller hash comes first, however rows are dealt; null doc_ids are scored and
never learnt from; added columns replace columns of the same name, and other columns are neither read nor changed;
empty tables work.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, prepare, released, slices, without, written
from .decontaminate import words_of
from .learning import labelled_sample, platt, sigmoid

MAX_EXAMPLES = 2000
BLOCK, NEIGHBOURS, PRIOR = 64, 15, 0.5
#: A term that more than one in so many examples have is common; texts that are looked up together.
COMMON, BATCH = 24, 128


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = as_bytes(column(part, "text"))
            found = [Counter(words_of(t)) for t in texts]
            yield pa.record_batch(
                [
                    column(part, "label").cast(pa.int32()), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                    pa.array([b" ".join(c) for c in found], pa.binary()), pa.array([np.array(list(c.values()), "<i4").tobytes() for c in found], pa.binary()),
                ],
                ["label", "digest", "words", "counts"],
            )


Vector = tuple[np.ndarray, np.ndarray]


class BlockMaxIndex:
    """Unit vectors of examples, sparse rows (terms in ascending order, weights), in the order given."""

    def __init__(self, rows: list[Vector], n_terms: int):
        self.n, self.blocks = len(rows), -(-len(rows) // BLOCK)
        docs, terms, weights = self._flat(rows)
        df = np.bincount(terms, minlength=n_terms)
        common = np.flatnonzero(df > self.n / COMMON)
        #: Number of a common term, -1 of a rare one.
        self.common = np.full(n_terms, -1, np.int32)
        self.common[common] = np.arange(len(common))
        often = self.common[terms] >= 0
        #: Weights of common terms by block, and their largest there.
        self.dense = np.zeros((self.blocks, len(common), BLOCK))
        self.dense[docs[often] // BLOCK, self.common[terms[often]], docs[often] % BLOCK] = weights[often]
        self.most = self.dense.max(axis=2).T
        terms, docs, weights = terms[~often], docs[~often], weights[~often]
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights = docs[order].astype(np.int32), weights[order]
        self.start = np.zeros(n_terms + 1, np.int64)
        self.start[1:] = np.cumsum(np.bincount(terms, minlength=n_terms))

    @staticmethod
    def _flat(rows: list[Vector]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number, term and weight of every entry."""
        owner = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        terms = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in rows]])
        return owner, terms, np.concatenate([np.zeros(0), *[w for _, w in rows]])

    def nearest(self, queries: list[Vector], k: int, skip: int | None = None) -> list[list[tuple[float, int]]]:
        """For each query the k examples of largest positive cosine as (cosine, number), ties by number. With `skip`,
        query i leaves out example skip + i."""
        owner, terms, weights = self._flat(queries)
        number, q = self.common[terms], len(queries)
        rare = number < 0
        lo, n = self.start[terms[rare]], self.start[terms[rare] + 1] - self.start[terms[rare]]
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        width = self.blocks * BLOCK
        scores = np.bincount(np.repeat(owner[rare] * width, n) + self.docs[at], np.repeat(weights[rare], n) * self.weights[at], minlength=q * width)
        scores = scores.astype(float).reshape(q, self.blocks, BLOCK)
        often = np.zeros((q, len(self.most)))
        often[owner[~rare], number[~rare]] = weights[~rare]
        # a block's bound: the best of its rare terms and what its common terms may add
        bounds = scores.max(axis=2) + often @ self.most
        visited = np.zeros((q, self.blocks), bool)

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                some = np.flatnonzero(wanted[:, b])
                scores[some, b] += often[some] @ self.dense[b]
            np.logical_or(visited, wanted, out=visited)

        best = np.zeros((q, self.blocks), bool)
        best[np.arange(q), bounds.argmax(axis=1)] = True
        visit(best)
        found = scores[best]
        # the k-th there, one more as one may be left out
        least = np.partition(found, -k - 1, axis=1)[:, -k - 1] if k < BLOCK else np.zeros(q)
        visit(~visited & (bounds > 0) & (bounds >= least[:, None] - 1e-12))
        scores[~visited] = 0
        scores = scores.reshape(q, width)
        if skip is not None:
            scores[np.arange(q), skip + np.arange(q)] = 0
        k = min(k, width)
        least = np.maximum(np.partition(scores, -k, axis=1)[:, -k], 1e-300)
        out = []
        for row, bound in zip(scores, least):
            near = np.flatnonzero(row >= bound)
            near = near[np.argsort(-row[near], kind="stable")][:k]
            out.append(list(zip(row[near].tolist(), near.tolist())))
        return out


class Model:
    """The examples' words with their weights, the index, and the calibration."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]], shares: dict[int, float]):
        """rows are (label, digest, words joined by spaces, counts)."""
        rows = sorted(rows, key=lambda r: r[1])
        labels = np.array([r[0] for r in rows], int)
        self.base = float(shares.get(1, 0.0))
        self.index, self.labels, self.vocabulary, self._number = None, labels, b"", None
        n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
        self.slope, self.offset = 0.0, float(np.log((shares.get(1, 0) + 1e-3) / (shares.get(0, 0) + 1e-3)))
        if not n1 or not n0:
            return
        names = sorted({w for r in rows for w in bytes(r[2]).split()})
        self.vocabulary = b" ".join(names)
        terms = [np.fromiter(map(self.number.__getitem__, bytes(r[2]).split()), np.int64) for r in rows]
        flat = np.concatenate(terms)
        df = np.bincount(flat, minlength=len(names))
        pos = np.bincount(flat, np.repeat(labels == 1, [len(t) for t in terms]), minlength=len(names))
        p = df / len(rows)
        z = np.abs(pos / n1 - (df - pos) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        self.weight = (np.log((1 + len(rows)) / (1 + df)) + 1) * np.maximum(z, 1.0)
        vectors = [self.vector(t, np.frombuffer(r[3], "<i4")) for t, r in zip(terms, rows)]
        # like examples lie together, so that block maxima are close to their members' weights
        order = sorted(range(len(rows)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, rows[i][1]))
        vectors, self.labels = [vectors[i] for i in order], labels[order]
        self.index = BlockMaxIndex(vectors, len(names))
        votes = np.array([self.vote(x) for at in range(0, len(vectors), BATCH) for x in self.index.nearest(vectors[at : at + BATCH], NEIGHBOURS, at)])
        # the sample has as many of each label as it may; the weights restore their shares
        weights = np.where(self.labels == 1, self.base / n1, (1 - self.base) / n0) * len(rows)
        self.slope, self.offset = platt(votes, self.labels, weights)

    def __getstate__(self):
        return self.__dict__ | {"_number": None}

    @property
    def number(self) -> dict[bytes, int]:
        """The number of each word."""
        if self._number is None:
            self._number = {w: i for i, w in enumerate(self.vocabulary.split())}
        return self._number

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a unit vector."""
        order = np.argsort(terms)
        terms = terms[order]
        weights = (1 + np.log(counts[order])) * self.weight[terms] if len(terms) else np.zeros(0)
        n = np.sqrt((weights**2).sum())
        return terms, weights / n if n else weights

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(s for s, _ in near)
        return (sum(s for s, i in near if self.labels[i] == 1) + PRIOR * self.base) / (total + PRIOR)

    def score(self, texts: list[bytes | None]) -> Iterator[tuple[float, list[tuple[float, int]], list[int]]]:
        """Of each text the probability, its neighbours (cosine, number), and its five heaviest terms."""
        number = self.number.get
        for at in range(0, len(texts), BATCH):
            queries = []
            for text in texts[at : at + BATCH]:
                known = [(n, c) for w, c in Counter(words_of(text)).items() if (n := number(w)) is not None] if self.index else []
                queries.append(self.vector(*np.array(known, np.int64).reshape(-1, 2).T))
            found = self.index.nearest(queries, NEIGHBOURS) if self.index else [[] for _ in queries]
            for (terms, weights), near in zip(queries, found):
                yield float(sigmoid(self.slope * self.vote(near) + self.offset)), near, terms[np.argsort(-weights, kind="stable")[:5]].tolist()


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model:
    """labels are (doc_id, toxic); learn picks the rows that may be learnt from."""
    prepare(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn
    sample = labelled_sample(docs, labels, "toxic", MAX_EXAMPLES, learn)
    counted = written(sample.mapInArrow(released(_counts), "label int, digest binary, words binary, counts binary"), "examples")
    shares_of = {r.toxic: r["count"] for r in labels.where(learn & F.col("toxic").isNotNull()).groupBy("toxic").count().collect()}
    total = sum(shares_of.values())
    rows = [(r.label, bytes(r.digest), bytes(r.words), bytes(r.counts)) for r in counted.collect()]  # MAX_EXAMPLES of each label at most
    return Model(rows, {k: v / total for k, v in shares_of.items()} if total else {})


def _score(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        words = m.vocabulary.split()
        for batch in batches:
            for part in slices(batch, "text"):
                done = list(m.score(as_bytes(column(part, "text"))))
                evidence = [[{"similarity": s, "toxic": int(m.labels[i])} for s, i in near] for _, near, _ in done]
                added = [
                    pa.array([s for s, _, _ in done], pa.float64()),
                    pa.array(evidence, pa.list_(pa.struct([("similarity", pa.float64()), ("toxic", pa.int32())]))),
                    pa.array([[words[t].decode("utf-8", "replace") for t in top] for _, _, top in done], pa.list_(pa.string())),
                ]
                yield pa.record_batch([*[column(part, n) for n in names], *added], [*names, "toxicity", "evidence", "terms"])

    return released(run)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxicity (0 to 1), evidence (similarity and label of the neighbours) and the text's five heaviest terms."""
    prepare(docs.sparkSession)
    docs = without(docs, ["toxicity", "evidence", "terms"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words of 2 * MAX_EXAMPLES examples
    return docs.mapInArrow(_score(shared, docs.columns), f"{schema}, toxicity double, evidence array<struct<similarity:double,toxic:int>>, terms array<string>")
