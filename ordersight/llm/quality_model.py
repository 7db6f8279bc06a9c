"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Every text becomes a short vector of logarithms and shares (length, word length, symbols, stop words,
repeated words, shingles and lines, digits, capitals). Each class has a mean and a covariance that is
shrunk towards the pooled diagonal; their Cholesky factors are computed once and travel with the model.
The score is the logistic of the difference of the two Gaussian log densities, that is of Mahalanobis
distances and log determinants, plus the log prior, scaled by a temperature.

Means and covariances come from sums over all labelled rows, added up across partitions; no sample
is taken. Statistics are computed once per run, block-wise in numpy, and written for both uses.

A null or empty text has the statistics of no words and is scored like any other. Rows with null
labels or ids are not learned from; with one class only, the score is that class's label; without
labels it is 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm import tokens
from ordersight.llm.jaccard import shingle_sets
from ordersight.llm.rules import STOP_WORDS
from ordersight.session import cut

SHRINKAGE = 0.1
FLOOR = 1e-3
TEMPERATURE = 3.0
NAMES = ("words", "word_bytes", "symbols", "stop", "distinct", "repeats", "dup_lines", "lines", "digits", "capitals")


def _sums(mask: np.ndarray, place: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[place[1:]] - total[place[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """Transformed statistics, one row per text, in the order of ``NAMES``."""
    powers, out = tokens.powers(), []
    stop = next(tokens.words(pa.array([" ".join(STOP_WORDS)]))).hashes(powers)
    stop.sort()
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    lines_of = tokens.words(texts, b"\n", lower=False)
    for block, lines in zip(tokens.words(texts), lines_of, strict=True):
        h, n = block.hashes(powers), block.counts().astype(float)
        at = np.minimum(np.searchsorted(stop, h), len(stop) - 1)
        word_sums = lambda mask, b=block.bounds: _sums(mask, b)
        line_hash, m = lines.hashes(powers), lines.counts().astype(float)
        distinct, dup = np.zeros(len(block)), np.zeros(len(block))
        for i, (a, b) in enumerate(zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)):
            distinct[i] = len(np.unique(h[a:b]))
        for i, (a, b) in enumerate(zip(lines.bounds[:-1].tolist(), lines.bounds[1:].tolist(), strict=True)):
            dup[i] = b - a - len(np.unique(line_hash[a:b])) if b - a > 1 else 0
        grams = np.array([len(s) for s in shingle_sets(block, h, 3)], float)
        raw = lines.data
        size = np.diff(block.place).astype(float)
        share = lambda x, y, least: np.log((x + least) / (y + 1.0))
        out.append(
            np.stack(
                [
                    np.log1p(n),
                    share(word_sums(block.end - block.start), n, 1.0),
                    share(_sums(symbol[block.data], block.place), n, 0.05),
                    share(word_sums(stop[at] == h), n, 0.5),
                    np.log1p(distinct) - np.log1p(n),
                    share(np.maximum(n - 2, 0) - np.where(n >= 3, grams, 0), n, 0.5),
                    share(dup, m, 0.2),
                    share(m, n, 1.0),
                    share(_sums((raw >= 48) & (raw <= 57), lines.place), size, 0.5),
                    share(_sums((raw >= 65) & (raw <= 90), lines.place), size, 0.5),
                ],
                1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per label the count, sums and products of the vectors, as ``label, at, value``."""
    width = len(NAMES)
    total = {}
    for batch in batches:
        label = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy().reshape(-1, width)
        for k in np.unique(label).tolist():
            own = x[label == k]
            sums = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
            total[k] = total.get(k, 0) + sums
    for k, sums in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([k] * len(sums), pa.int32()), pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)],
            ["label", "at", "value"],
        )


@dataclass
class Model:
    means: np.ndarray
    factors: np.ndarray  # inverse Cholesky factors
    offsets: np.ndarray  # log prior minus half the log determinant
    constant: float | None = None


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their vectors, written once."""

    @F.arrow_udf("array<double>")
    def vector(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))

    return cut(docs.withColumn("_vector", vector(F.col(f"`{text}`").cast("string"))).drop(text))


def train(vectors: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality") -> Model:
    """Fit on all rows of ``vectors`` that ``labels`` marks 0 or 1."""
    named = labels.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label")).dropna()
    joined = vectors.select(F.col(f"`{id}`").alias("_id"), "_vector").join(named.filter("_label in (0, 1)"), "_id")
    parts = joined.select("_label", "_vector").mapInArrow(_partial_sums, "label int, at int, value double")
    rows = parts.groupBy("label", "at").agg(F.sum("value").alias("value")).collect()  # fixed size
    d, sums = len(NAMES), {}
    for r in rows:
        sums.setdefault(r["label"], np.zeros(1 + d + d * d))[r["at"]] = r["value"]
    if len(sums) < 2:
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), float(next(iter(sums), 0)))
    n = np.array([sums[k][0] for k in (0, 1)])
    means = np.stack([sums[k][1 : 1 + d] / sums[k][0] for k in (0, 1)])
    spread = np.stack([sums[k][1 + d :].reshape(d, d) / sums[k][0] - np.outer(means[k], means[k]) for k in (0, 1)])
    pooled = np.diag(np.einsum("k,kii->i", n / n.sum(), spread))
    factors, offsets = [], []
    for k in (0, 1):
        shrunk = (1 - SHRINKAGE) * spread[k] + SHRINKAGE * pooled + FLOOR * np.eye(d)
        root = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(root))
        offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(root)).sum())
    return Model(means, np.stack(factors), np.array(offsets))


def score(model: Model, vector: Column) -> Column:
    """Probability, from 0 to 1, that a document is of label 1."""
    if model.constant is not None:
        return F.lit(model.constant)

    @F.arrow_udf("double")
    def probability(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy().reshape(len(vectors), -1)
        density = [
            model.offsets[k] - 0.5 * (((x - model.means[k]) @ model.factors[k].T) ** 2).sum(1) for k in (0, 1)
        ]
        return pa.array(1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -30, 30))))

    return probability(vector)
