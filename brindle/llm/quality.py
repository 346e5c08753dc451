"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a few statistics (shares of repeated words, symbols, capitals, marks, digits,
lengths), transformed to be closer to normal. Each class gets its mean and a covariance that
is shrunk towards the pooled one and its diagonal. A document's score comes from the difference of
the two log densities, whose Mahalanobis terms use Cholesky factors computed once.

Moments are sums over all labelled rows, added up on the executors; the driver sees one number
for each class and pair of statistics.

Rows: a null or empty text has statistics of its own (no words) and gets a score; a row with a
null doc_id or without label is scored but never learnt from; rows whose label isn't 0 or 1 are
not learnt from; repeated rows get equal scores, and count again when learnt from; without rows of both
classes every score is the share of label 1, or 0.5 without any label; an empty table gives no
rows; further columns are carried along by ``with_score`` and ignored by the query.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import read_table, written

#: Share of the pooled covariance in each class's, and of the diagonal in the result.
TO_POOLED, TO_DIAGONAL = 0.15, 0.1
#: Least variance of a transformed statistic, as a share of its pooled one.
FLOOR = 0.05
#: Log-density differences are divided by this before they become probabilities.
TEMPERATURE = 4.0
ACCEPT = 0.3
#: Ordinary words or characters that every text is taken to have besides: short texts vary less.
PRIOR = 20
SYMBOLS, DIGITS, MARKS = b"#$%&*+/<=>@[\\]^_`{|}~", b"0123456789", b".,;:?'\"()-"
ASCII = bytes(range(128))
STATISTICS = ("words", "mean_word", "repeated", "distinct", "symbols", "shouts", "capitals", "capitalised", "digits", "marks", "wide", "line_words", "same_lines", "longest_run", "alone")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text, in the order of STATISTICS."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x]
    same = list(map(operator.eq, words, words[1:]))
    letters = len(raw.translate(None, SYMBOLS + DIGITS + MARKS + b"! \t\n\r\x0b\x0c"))

    def share(x: float, of: float) -> float:
        return np.log1p(100 * x / (of + PRIOR))

    upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if raw else 0
    return [
        np.log1p(n),
        np.log1p((size + 7 * PRIOR) / (n + PRIOR)),
        share(sum(same), n),
        (len(set(words)) + PRIOR) / (n + PRIOR) ** 0.8,
        share(size - len(raw.translate(None, SYMBOLS)) if raw else 0, size),
        share(raw.count(b"!"), size),
        share(upper, letters),
        share(sum(map(bytes.istitle, words)), n),
        share(size - len(raw.translate(None, DIGITS)) if raw else 0, size),
        share(size - len(raw.translate(None, MARKS)) if raw else 0, size),
        share(len(raw.translate(None, ASCII)), size),
        np.log1p(n / max(1, len(lines))),
        share(len(lines) - len(set(lines)), len(lines)),
        share(sum(map(operator.and_, same, same[1:])), n),
        share(sum(map(b"|".__eq__, words)), n),
    ]


@dataclass
class Discriminant:
    """Means and Cholesky factors by class, and the log prior ratio; constant: a score for all rows, if set."""

    means: np.ndarray
    inverse: np.ndarray
    offsets: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [o - 0.5 * (((x - m) @ li.T) ** 2).sum(axis=1) for m, li, o in zip(self.means, self.inverse, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -30, 30)))


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """From the number of rows, the sums and the sums of products of each class."""
    p = sums.shape[1]
    if not counts.all():
        constant = float(counts[1] / counts.sum()) if counts.sum() else 0.5
        return Discriminant(np.zeros((2, p)), np.zeros((2, p, p)), np.zeros(2), constant)
    means = sums / counts[:, None]
    own = products / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * counts[:, None, None]).sum(axis=0) / counts.sum()
    floor = FLOOR * np.maximum(pooled.diagonal(), 1e-6)
    factors, offsets = [], []
    for k in range(2):
        c = (1 - TO_POOLED) * own[k] + TO_POOLED * pooled
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(c.diagonal()) + np.diag(floor)
        factor = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(factor))
        offsets.append(np.log(counts[k] / counts.sum()) - np.log(factor.diagonal()).sum())
    return Discriminant(means, np.array(factors), np.array(offsets))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = len(STATISTICS)
    sums = np.zeros((2, 1 + p + p * p))
    for batch in batches:
        x = np.array(batch.column(1).to_pylist(), float).reshape(-1, p)
        label = np.array(batch.column(0).to_pylist())
        for k in range(2):
            own = x[label == k]
            sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], pa.list_(pa.float64()))], names=["sums"])


def held_out() -> Column:
    """Rows that are never learnt from; false for a null doc_id, which has no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """measured: (doc_id, x). All labelled rows that aren't held out."""
    rows = measured.where(~held_out()).join(labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id").select("quality", "x")
    parts = rows.mapInArrow(_moments, "sums array<double>")
    totals = parts.select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    p = len(STATISTICS)
    flat = np.zeros(2 * (1 + p + p * p))
    for k, v in totals:
        flat[k] = v
    flat = flat.reshape(2, -1)
    return discriminant(flat[:, 0], flat[:, 1 : 1 + p], flat[:, 1 + p :].reshape(2, p, p))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each text."""
    return docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _score(model: Discriminant, names: list[str], text: bool):
    """From the last column, a text or its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            x = [statistics(t.as_py()) for t in last] if text else last.to_pylist()
            score = model.score(np.array(x, float).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*(batch.columns if text else batch.columns[:-1]), pa.array(score, pa.float64())], names=[*names, "quality_score"])

    return run


def with_score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """docs with quality_score, computed from the texts."""
    names = [c for c in docs.columns if c not in ("text", "quality_score")] + ["text"]
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names).mapInArrow(_score(model, names, True), f"{kept}, quality_score double")


def learnt(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[Discriminant, DataFrame]:
    """The model, and the table of statistics that it was learnt from."""
    measured = written(spark, measure(docs), "statistics")
    return fit(measured, labels), measured


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, measured = learnt(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    kind = measured.schema["doc_id"].dataType.simpleString()
    scored = measured.mapInArrow(_score(model, ["doc_id"], False), f"doc_id {kind}, quality_score double")
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"))
