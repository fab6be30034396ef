"""Quality classifier: regularised quadratic discriminant analysis.

A document is a vector of transformed statistics of its whole text. Each class is
a Gaussian whose covariance is shrunk twice, toward the pooled covariance and
toward the pooled variances alone. The score is the logistic function of the
difference of the two log densities plus the log ratio of the class sizes. The log
determinant and the Mahalanobis distance come from a Cholesky factor; it is worked
out and inverted once, and a batch of rows is whitened by one product with it.

The statistics are computed once and kept; class sizes, means and the scatter around
the means are added up over all labelled rows by Spark, so nothing is sampled.

Defined results: null and empty texts have the vector of an empty text and get a
score like any other; rows without a label, or with one other than 0 and 1, teach
nothing; a document labelled twice counts twice; repeated rows each get the same
score; if a class has no rows every score is the other class's value (0.5 if neither
has); an empty table gives no rows; only the named columns are looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import rows_udf, stored

STATISTICS = ("words", "word length", "distinct words", "top word", "repeated word", "upper", "digits", "symbols", "marks", "stops", "bars", "non-ASCII", "line length", "repeated lines", "byte entropy")
SIZE = len(STATISTICS)

_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True
_MARK = np.zeros(256, bool)
_MARK[[33, 63]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _STOP | _MARK | _SPACE)
_SYMBOL[128:] = False
_SYMBOL[124] = False


def statistics(text: bytes | None) -> list[float]:
    """The vector of a text; shares are under a square root, sizes under a logarithm."""
    text = text or b""
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    if not n:
        return [0.0] * SIZE
    counts = Counter(words)
    each = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    share = each / each.sum()
    letters = each[_UPPER].sum() + each[_LOWER].sum() + 1
    seen = share[share > 0]
    return [
        np.log1p(n),
        np.log(sum(map(len, words)) / n),
        np.sqrt(len(counts) / n) * np.log1p(n) ** 0.5,
        np.sqrt(max(counts.values()) / n),
        np.sqrt(sum(a == b for a, b in zip(words, words[1:])) / n),
        np.sqrt(each[_UPPER].sum() / letters),
        np.sqrt(share[_DIGIT].sum()),
        np.sqrt(share[_SYMBOL].sum()),
        np.sqrt(each[_MARK].sum() / n),
        np.sqrt(each[_STOP].sum() / n),
        np.sqrt(each[124] / n),
        np.sqrt(share[128:].sum()),
        np.log1p(len(text) / len(lines)),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        float(-(seen * np.log2(seen)).sum()),
    ]


def statistics_column(text: Column) -> Column:
    return rows_udf(lambda: lambda t: ([float(v) for v in statistics(t)],), "x array<double>")(text.cast("binary"))["x"]


@dataclass
class Discriminant:
    means: np.ndarray  # [2, d]
    whiten: list[np.ndarray]  # inverses of the lower Cholesky factors
    offsets: np.ndarray  # log size - half log determinant
    constant: float | None = None  # the score if a class is missing

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [self.offsets[k] - 0.5 * (((x - self.means[k]) @ self.whiten[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)


def _scatter(means: np.ndarray):
    """Per partition and class: the entries of the sum of (x - mean)(x - mean)'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE, SIZE))
        for batch in batches:
            label, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            for k in (0, 1):
                part = x[label == k] - means[k]
                total[k] += part.T @ part
        n = SIZE**2
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n), pa.int32()), pa.array(np.tile(np.arange(n), 2), pa.int32()), pa.array(total.ravel())], names=["label", "at", "v"])

    return run


def fit(labelled: DataFrame, *, shrink_pooled: float = 0.2, shrink_identity: float = 0.05) -> Discriminant:
    """labelled(label 0/1, x array<double>)."""
    rows = labelled.where(F.col("label").isin(0, 1)).select(F.col("label").cast("int"), "x")
    n, means = np.zeros(2), np.zeros((2, SIZE))
    for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("x")[i]) for i in range(SIZE)]).alias("mean")).collect():
        n[r["label"]], means[r["label"]] = r["n"], r["mean"]
    scatter = np.zeros((2, SIZE**2))
    for r in rows.mapInArrow(_scatter(means), "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect():
        scatter[r["label"], r["at"]] = r["v"]
    return discriminant(n, means, scatter.reshape(2, SIZE, SIZE), shrink_pooled, shrink_identity)


def covariances(n: np.ndarray, scatter: np.ndarray, shrink_pooled: float, shrink_identity: float) -> list[np.ndarray]:
    """Each class's covariance, moved toward the pooled one, then toward the pooled variances alone."""
    pooled = scatter.sum(0) / n.sum()
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    own = [(1 - shrink_pooled) * scatter[k] / n[k] + shrink_pooled * pooled for k in (0, 1)]
    return [(1 - shrink_identity) * (c + c.T) / 2 + shrink_identity * scale for c in own]


def discriminant(n: np.ndarray, means: np.ndarray, scatter: np.ndarray, shrink_pooled: float, shrink_identity: float) -> Discriminant:
    if not n.all():
        return Discriminant(np.zeros((2, SIZE)), [], np.zeros(2), constant=float(0.5 if not n.any() else n[1] > 0))
    factors = [np.linalg.cholesky(c) for c in covariances(n, scatter, shrink_pooled, shrink_identity)]
    offsets = [np.log(n[k] / n.sum()) - np.log(np.diag(f)).sum() for k, f in enumerate(factors)]
    return Discriminant(means, [np.linalg.inv(f) for f in factors], np.array(offsets))


def score_column(x: Column, model: Discriminant) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.scores(_matrix(batch)))

    return F.arrow_udf(run, "double")(x)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, *, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score, predicted. Labels of rows under `held_out` are not used."""
    kept = stored(docs.select(F.col(id).alias("id"), held_out.alias("held_out"), statistics_column(F.col(text)).alias("x")))
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where("label is not null")
    model = fit(kept.where(~F.col("held_out")).join(known, "id").select("label", "x"))
    scored = kept.select(F.col("id").alias(id), "held_out", score_column(F.col("x"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
