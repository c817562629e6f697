"""Quality by a regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics. Each class has its mean and a
covariance shrunk towards the pooled one and its diagonal; their Cholesky factors are
computed once, and the score is the logistic of the difference of the Mahalanobis
log-densities and priors.

Training takes at most `rows` labelled documents, those with the smallest hash of the id;
scoring reads all documents in whole.

Defined results: a null text counts as empty and its statistics are those of no words; with
labels of one class only every score is that class; with none it is 0; of several labels of
one id the largest counts; of documents that repeat an id the smallest text trains; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fitted, fold, released
from tessera.llm.toxicity import labelled, text_blocks

ROWS = 6_000
#: Weight of the pooled covariance in a class's own, and of its diagonal in the result.
TO_POOLED = 0.3
TO_DIAGONAL = 0.1
#: Shares below this count as this in logarithms.
LEAST = 0.002
PRIOR = 20


def _classes() -> np.ndarray:
    """The kind of each byte of UTF-8: 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 loud, 6 bar, 7 stop, 8 space."""
    kind = np.zeros(256, dtype=np.uint8)
    for group, characters in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "*#$%&@^~+=<>_{}[]\\/", "!?", "|", ".,;:", " \n\t\r"), 1):
        kind[list(characters.encode())] = group
    return kind


KIND = _classes()


def statistics(text: str) -> list[float]:
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    kinds = np.bincount(KIND[np.frombuffer(text.encode(), dtype=np.uint8)], minlength=9).astype(float)
    letters = kinds[0] + kinds[1] + kinds[2]
    distinct = len(set(words))
    # shares of short texts are drawn towards usual ones, as if PRIOR more units had been seen
    share = lambda x, of, usual=0.0: float(np.log(LEAST + (x + usual * PRIOR) / (of + PRIOR)))
    return [
        float(np.log(len(words) + PRIOR)),
        float(np.log((len(text) + 6 * PRIOR) / (n + PRIOR))),
        float(np.log((distinct + PRIOR) / (n + PRIOR)) / np.log(n + PRIOR)),
        share(sum(map(str.__eq__, words[1:], words)), n),
        share(kinds[2], letters, 0.03),
        share(kinds[3], letters),
        share(kinds[4], letters),
        share(kinds[5], letters),
        share(kinds[6], letters),
        share(kinds[7], n, 0.15),
        share(len(lines) - len(set(lines)), len(lines)),
        float(np.log((len(lines) + 0.1 * PRIOR) / (n + PRIOR))),
    ]


def train(x: np.ndarray, y: np.ndarray) -> dict:
    scale = x.std(axis=0) + 1e-6
    centre = x.mean(axis=0)
    z = (x - centre) / scale
    present = [k for k in (0, 1) if (y == k).any()]
    pooled = sum(np.cov(z[y == k].T, bias=True) * (y == k).sum() for k in present) / len(y)
    model: dict = {"centre": centre, "scale": scale, "classes": {}}
    for k in present:
        own = z[y == k]
        c = (1 - TO_POOLED) * np.cov(own.T, bias=True) + TO_POOLED * pooled
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        constant = np.log(len(own) / len(y)) - np.log(np.diag(factor)).sum()
        model["classes"][k] = (own.mean(axis=0), np.linalg.inv(factor), constant)
    return model


def scores(model: dict | None, x: np.ndarray) -> np.ndarray:
    if not model or not len(x):
        return np.zeros(len(x))
    z = (x - model["centre"]) / model["scale"]
    density = {}
    for k, (mean, whiten, constant) in model["classes"].items():
        density[k] = constant - 0.5 * (((z - mean) @ whiten.T) ** 2).sum(axis=1)
    if len(density) == 1:
        return np.full(len(x), float(next(iter(density))))
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -60, 60)))


def statistics_of() -> Column:
    """The statistics of the text column, computed where the texts are."""

    @F.arrow_udf("array<double>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([statistics(t) for part in text_blocks(texts) for t in part], pa.list_(pa.float64()))
        released()

    return measured(F.col("text"))


def fit(docs: DataFrame, labels: DataFrame, train_rows=None, rows: int = ROWS) -> dict | None:
    """Only the statistics of the sampled texts meet in the training task, no texts."""
    sample = labelled(docs, labels, "quality", rows, F.lit(True) if train_rows is None else train_rows)

    def learn(table: pa.Table) -> dict:
        return train(np.array(table["x"].to_pylist()), table["label"].to_numpy())

    return fitted(sample.withColumn("x", statistics_of()), learn, ["place", "doc_id", "label", "x"], ["place", "doc_id", "label", "x"])


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fold are never read."""
    model = fit(docs, labels, fold("doc_id", folds) != held_out)

    @F.arrow_udf("double")
    def score_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [scores(model, np.array([statistics(t) for t in part])) for part in text_blocks(texts)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())
        released()

    scored = docs.select("doc_id", score_of(F.col("text")).alias("score"))
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
