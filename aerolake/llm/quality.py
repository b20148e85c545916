"""Operator 3: quality classifier, a regularised quadratic discriminant over transformed document statistics.

One scan turns every text into ``FEATURES``: byte-class shares, word and line statistics, each through a logarithm or a square root
so that the classes come nearer to normal. The rows (a few numbers a document) are written to the shared folder. Counts, sums
and products of all labelled rows outside the held-out fifth are summed by Spark, class by class; nothing is sampled. On the driver
each class covariance is shrunk towards the pooled one and its diagonal, and its Cholesky factor is cached. The score of a text
is the logistic of the difference of the two Mahalanobis log densities plus the log odds of the labels, softened by ``TEMPER``
because the statistics are dependent. Labels, lang, source and doc_id are never inputs of a score.

Null and empty texts have the statistics of a text without words and get a score like any other. A doc_id that labels repeats
with both qualities counts for both; null qualities and ids are not learnt from. Without labels of both classes (empty tables) every
score is the share of label 1, or 0.5. Extra columns are kept by ``keep_good``, and dropped in the digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import held_out, join_small, materialize, texts_as_bytes

FEATURES = ("words", "word_length", "marks", "upper", "other", "stops", "bang", "bar", "distinct", "repeats", "same_lines", "line_words", "doubled")
THRESHOLD = 0.3
TEMPER = 0.5
#: Shares of the pooled covariance and of the diagonal in a class covariance, and what is added to each variance.
POOLED, DIAGONAL, RIDGE = 0.2, 0.1, 1e-3


def byte_classes() -> np.ndarray:
    """(256, n) membership: letters, upper case, marks, control bytes, '!', '|', stops."""
    groups = [b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>^~{}[]\\", bytes(range(9)) + bytes(range(14, 32)) + b"\x7f", b"!", b"|", b".,"]
    out = np.zeros((256, len(groups)))
    for k, group in enumerate(groups):
        out[list(group), k] = 1
    return out


CLASSES = byte_classes()


def statistics(text: bytes | None) -> np.ndarray:
    text = text or b""
    letters, upper, marks, control, bang, bar, stops = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASSES
    words = text.split()
    n, size = len(words), len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    spread = len(set(zip(words, words[3:], words[7:], strict=False)))
    doubled = sum(map(eq, words, words[1:]))
    # Denominators have a constant added: the shares of short texts lie near zero rather than anywhere.
    return np.array([
        np.log1p(n),
        np.log1p((size - n + 60) / (n + 10)),
        np.log(1e-3 + marks / (size + 50)),
        np.log(1e-2 + upper / (letters + 50)),
        np.log(1e-3 + control / (size + 50)),
        np.sqrt(stops / (n + 10)),
        np.log(1e-2 + bang / (n + 10)),
        np.log(1e-2 + bar / (n + 10)),
        np.log(1e-1 + (n - len(set(words))) / (n + 20)),
        np.log(1e-2 + (max(0, n - 7) - spread) / (n + 20)),
        np.log(1e-2 + (len(lines) - len(set(lines))) / (len(lines) + 5)),
        np.log1p(n / (len(lines) + 1)),
        np.log(1e-2 + doubled / (n + 10)),
    ])


def with_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, x (array of the statistics) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.array([statistics(t) for t in texts_as_bytes(batch["text"])]).ravel()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32()), pa.array(flat))], ["doc_id", "x"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """What the scores need: for each class its mean, inverse Cholesky factor, log determinant; the log odds of the labels."""

    means: np.ndarray
    inverse_factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * ((((x - m) @ f.T) ** 2).sum(axis=1) + d) for m, f, d in zip(self.means, self.inverse_factors, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(TEMPER * (density[1] - density[0]) + self.log_odds, -30, 30))) if len(density) == 2 else np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))


def from_sums(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled_share: float = POOLED, diagonal_share: float = DIAGONAL) -> Discriminant:
    """The discriminant of {class: (rows, sums, products)}."""
    n = {c: sums[c][0] if c in sums else 0 for c in (0, 1)}
    log_odds = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if min(n.values()) < 2:
        empty = np.zeros((0, 0))
        return Discriminant(empty, empty, np.zeros(0), log_odds)
    means, scatters = {}, {}
    for c, (rows, total, products) in sums.items():
        means[c] = total / rows
        scatters[c] = products - rows * np.outer(means[c], means[c])
    pooled = (scatters[0] + scatters[1]) / (n[0] + n[1])
    factors, dets = [], []
    for c in (0, 1):
        shrunk = (1 - pooled_share) * scatters[c] / n[c] + pooled_share * pooled
        shrunk = (1 - diagonal_share) * shrunk + diagonal_share * np.diag(np.diag(shrunk)) + RIDGE * np.eye(len(shrunk))
        factor = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(factor))
        dets.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(np.stack([means[0], means[1]]), np.stack(factors), np.array(dets), log_odds)


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from ``rows`` (doc_id, x) outside the held-out fifth and their labels."""
    learn = join_small(rows.where(~held_out()), labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id", "inner")
    k = len(FEATURES)
    x = lambda i: F.col("x")[i]
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = learn.groupBy("quality").agg(F.count("*"), *(F.sum(x(i)) for i in range(k)), *(F.sum(x(i) * x(j)) for i, j in upper)).collect()
    found = {}
    for row in sums:
        products = np.zeros((k, k))
        for (i, j), v in zip(upper, row[2 + k :], strict=True):
            products[i, j] = products[j, i] = v
        found[row[0]] = (row[1], np.array(row[2 : 2 + k]), products)
    return from_sums(found)


def score_column(model: Discriminant) -> Column:
    @F.pandas_udf("double")
    def score(x):
        return x.__class__(model.scores(np.stack(x.to_numpy()))) if len(x) else x.astype(float)

    return score(F.col("x"))


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = materialize(with_statistics(documents))
    scored = rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score_column(fit(rows, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that are not rejected, unchanged; statistics are computed again, texts never move."""
    model = fit(materialize(with_statistics(documents)), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.scores(np.array([statistics(t) for t in texts_as_bytes(batch["text"])]))
                yield batch.filter(pa.array(scores >= threshold))

    return documents.mapInArrow(run, documents.schema)
