"""What the classifiers share: folds, bounded samples of labelled rows, and score calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, learn: Column) -> DataFrame:
    """(label, text) of at most about `most` documents of each label value, picked by a hash of doc_id.

    labels are (doc_id, label); null labels and doc_ids are left out. Of several labels of a document the largest
    counts, and of several labels of equal texts too, so that the sample does not depend on the order of rows. Labels
    are narrow and are counted in full; only picked rows meet the texts. Other columns of docs and labels are not read.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = known.groupBy("label").count().withColumn("_share", F.lit(float(most)) / F.col("count"))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_003)) / 1_000_003
    picked = known.join(counts, "label").where(place < F.col("_share")).select("doc_id", "label")
    # at most about `most` rows of each label value
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("text").agg(F.max("label").alias("label")).select("label", "text")


def platt(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the sigmoid that makes weighted scores probabilities, with smoothed targets."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    if not n1 or not n0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([scores, np.ones_like(scores)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weights * (p - target)) + ridge * w
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
