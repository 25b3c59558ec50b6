"""Labelled samples and a small ridge logistic regression, shared by the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(labels: DataFrame, documents: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents, the same ones on every run.

    Rows are drawn by a hash of the id before any text is read; only their ids are broadcast, and
    ``rows`` bounds them. Rows without id or with a label other than 0 and 1 teach nothing.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .withColumn("_order", F.md5(F.col("doc_id").cast("string"))).orderBy("_order", "doc_id").limit(rows).select("doc_id", "label")
    )
    return documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


class Logistic:
    """Ridge logistic regression on standardised features, pulled towards ``prior`` where the data are silent."""

    def __init__(self, ridge: float = 1.0, prior: np.ndarray | None = None, scale: bool = True):
        self.ridge, self.prior, self.scale = ridge, prior, scale

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean = x.mean(0) if self.scale and len(x) else np.zeros(x.shape[1])
        spread = x.std(0) if self.scale and len(x) else np.ones(x.shape[1])
        self.spread = np.where(spread > 1e-9, spread, 1.0)
        z = self._design(x)
        prior = np.zeros(z.shape[1]) if self.prior is None else np.asarray(self.prior, float)
        w, pull = prior.copy(), np.full(z.shape[1], self.ridge)

        def loss(v: np.ndarray) -> float:
            s = z @ v
            return float(np.logaddexp(0, s).sum() - y @ s + 0.5 * (pull * (v - prior) ** 2).sum())

        for _ in range(60):
            p = _sigmoid(z @ w)
            gradient = z.T @ (p - y) + pull * (w - prior)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), gradient)
            size, now = 1.0, loss(w)
            while size > 1e-6 and loss(w - size * step) > now:
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-9:
                break
        self.weights = w
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.spread])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._design(x) @ self.weights)


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))
