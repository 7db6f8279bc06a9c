"""One-class SVM with an RBF kernel, trained by a few aggregates over the whole table.

The kernel is replaced by random Fourier features (Rahimi and Recht, 2007). In that space the dual of
the nu-one-class SVM asks for the shortest vector among averages of rows in which no row weighs more
than 1 / (nu n). The average of the nu share of rows with the lowest score along a direction is such a
vector, and the shortest mix of several of them, found on the driver, is the current solution.

A bounded sample suggests directions; the averages themselves are always taken over the whole table,
one pass for all directions at once. Further passes add the average along the current solution until
the duality gap, also measured over the whole table, is small; a fit that does not get there in the
given rounds is an error, never a model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.models.features import score_usable
from ordersight.operators.scores import minmax_score
from ordersight.session import cut, cut_for_passes

NU = 0.05
FOURIER_FEATURES = 256
ROUNDS = 200  # passes after which a fit that has not converged is an error
BINS = 4096
SAMPLE_ROWS = 20_000
SUM_GROUPS = 64  # the vectors of the tasks are summed in so many groups, then these sums
SUGGESTIONS = 24
# Shares of nu at which the sample places the borders around the wanted share; the last shell is open.
SHELLS = (0.7, 0.9, 1.0, 1.1, 1.3, 2.0)


@dataclass
class OneClassModel:
    """Projection, weight vector and offset; a few thousand numbers whatever the table size."""

    projection: np.ndarray
    weights: np.ndarray
    rho: float
    rounds: int
    gap: float


def fourier(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Random Fourier features of unit length."""
    angles = x @ projection
    return np.hstack([np.cos(angles), np.sin(angles)]) / np.sqrt(projection.shape[1])


def scale_gamma(features: DataFrame, columns: list[str]) -> float:
    """1 / (number of features * variance of all feature values)."""
    values = features.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v"))
    variance = values.agg(F.var_pop("v")).first()[0]
    return 1.0 / (len(columns) * variance) if variance else 1.0


def low_tail_border(features: DataFrame, columns: list[str], projection: np.ndarray, w: np.ndarray, nu: float):
    """Score edge below which fewer than the nu share of rows lie, the next edge, and the share needed between them."""
    length = float(np.linalg.norm(w)) * (1 + 1e-9)

    def count_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            scores = fourier(batch.to_numpy(float), projection) @ w
            at = np.clip(((scores / length + 1) / 2 * BINS).astype(int), 0, BINS - 1)
            counts += np.bincount(at, minlength=BINS)
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"bin": seen.astype(np.int32), "n": counts[seen]})

    counted = features.select(*columns).mapInPandas(count_bins, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    table = counted.toPandas().sort_values("bin")  # at most BINS rows
    bins, counts = table["bin"].to_numpy(), table["n"].to_numpy()
    wanted = nu * counts.sum()
    before = np.concatenate([[0], np.cumsum(counts)])
    i = max(0, min(int(np.searchsorted(before, wanted, side="left")), len(counts)) - 1)
    edge = lambda b: (2.0 * b / BINS - 1) * length
    return edge(bins[i]), edge(bins[i] + 1), (wanted - before[i]) / counts[i]


def shell_borders(scores: np.ndarray, nu: float) -> np.ndarray:
    """Score borders of the shells, one row per direction, from sample scores (rows x directions)."""
    return np.quantile(scores, np.minimum(1.0, nu * np.array(SHELLS)), axis=0).T


def low_tail_means(
    features: DataFrame, columns: list[str], projection: np.ndarray, directions: np.ndarray, borders: np.ndarray, nu: float
) -> np.ndarray:
    """Per direction the average Fourier vector of the nu share of rows with the lowest score.

    One pass sums the vectors of each shell between the borders; the shell that completes the nu share
    counts in part, so every average is feasible whatever the borders are.
    """
    width, count, shells = directions.shape[0], directions.shape[1], borders.shape[1] + 1

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((count, shells, width + 1))
        for batch in batches:
            z = fourier(batch.to_numpy(float), projection)
            z = np.hstack([z, np.ones((len(z), 1))])
            scores = z[:, :-1] @ directions
            for j in range(count):
                shell = np.searchsorted(borders[j], scores[:, j], side="left")
                for k in range(shells - 1):
                    total[j, k] += z[shell == k].sum(axis=0)
                total[j, shells - 1] += z.sum(axis=0) - z[shell < shells - 1].sum(axis=0)
        yield pd.DataFrame({"v": [total.ravel()]})

    # one vector per task, of directions x shells x Fourier features entries
    per_task = features.select(*columns).mapInPandas(add_up, "v array<double>")
    grouped = per_task.select(array_to_vector("v").alias("v"), (F.spark_partition_id() % SUM_GROUPS).alias("g"))
    summed = grouped.groupBy("g").agg(Summarizer.sum(F.col("v")).alias("v")).agg(Summarizer.sum(F.col("v")).alias("v"))
    sums = summed.first()["v"].toArray().reshape(count, shells, width + 1)
    mass = np.rint(sums[:, :, -1])
    wanted = nu * mass[0].sum()
    before = np.cumsum(mass, axis=1) - mass
    taken = np.clip((wanted - before) / np.maximum(mass, 1.0), 0.0, 1.0)
    return np.einsum("jk,jkd->jd", taken, sums[:, :, :-1]) / wanted


def suggested_directions(z: np.ndarray, nu: float) -> np.ndarray:
    """Solutions met while solving the same problem on a sample, as columns."""
    share = max(1, round(nu * len(z)))
    atoms = [z.mean(axis=0)]
    path = []
    for _ in range(SUGGESTIONS):
        stacked = np.array(atoms)
        w = shortest_mix(stacked) @ stacked
        path.append(w)
        atoms.append(z[np.argpartition(z @ w, share - 1)[:share]].mean(axis=0))
    return np.array(path).T


def shortest_mix(atoms: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Convex weights of the shortest combination of a few vectors, by pairwise exact line search."""
    gram = atoms @ atoms.T
    beta = np.full(len(atoms), 1.0 / len(atoms))
    for _ in range(rounds):
        slope = gram @ beta
        to = int(np.argmin(slope))
        away = int(np.argmax(np.where(beta > 0, slope, -np.inf)))
        curve = gram[to, to] + gram[away, away] - 2 * gram[to, away]
        if slope[away] - slope[to] < 1e-12 or curve <= 0:
            break
        step = min(beta[away], (slope[away] - slope[to]) / curve)
        beta[to] += step
        beta[away] -= step
    return beta


def fit_one_class(
    features: DataFrame,
    columns: list[str],
    nu: float = NU,
    gamma: float | None = None,
    fourier_features: int = FOURIER_FEATURES,
    rounds: int = ROUNDS,
    tolerance: float = 1e-2,
    seed: int = 42,
) -> OneClassModel:
    """Fit on a feature table that is cheap to read a few times (a written or persisted table)."""
    gamma = gamma or scale_gamma(features, columns)
    projection = np.random.default_rng(seed).normal(0.0, np.sqrt(2 * gamma), (len(columns), fourier_features // 2))
    numeric = features.select(*[F.col(c).cast("double").alias(c) for c in columns])
    total = numeric.count()
    picked = numeric if total <= SAMPLE_ROWS else numeric.sample(fraction=SAMPLE_ROWS / total, seed=seed)
    z = fourier(picked.toPandas().to_numpy(float), projection)
    directions = suggested_directions(z, nu)
    atoms = low_tail_means(numeric, columns, projection, directions, shell_borders(z @ directions, nu), nu)
    w, gap, done = shortest_mix(atoms) @ atoms, np.inf, 0
    for done in range(1, rounds + 1):
        atom = low_tail_means(numeric, columns, projection, w[:, None], shell_borders(z @ w[:, None], nu), nu)
        gap = float(w @ w - atom[0] @ w)
        if gap <= tolerance * float(w @ w):
            break
        atoms = np.vstack([atoms, atom])
        w = shortest_mix(atoms) @ atoms
    else:
        raise RuntimeError(f"one-class SVM: the duality gap is {gap:.3g} after {rounds} rounds, above {tolerance:g} of the objective")
    low, high, share = low_tail_border(numeric, columns, projection, w, nu)
    return OneClassModel(projection, w, low + (high - low) * share, done, gap)


def one_class_decision(features: DataFrame, model: OneClassModel, columns: list[str]) -> DataFrame:
    """Add ``decision``: negative for outliers."""
    projection, weights, rho = model.projection, model.weights, model.rho

    @F.pandas_udf("double")
    def decide(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(fourier(np.column_stack([s.to_numpy(float) for s in batch]), projection) @ weights - rho)

    return features.withColumn("decision", decide(*[F.col(c).cast("double") for c in columns]))


def one_class_svm(features: DataFrame, columns: list[str], nu: float = NU, seed: int = 42, **options) -> DataFrame:
    """Every row with its decision value and the min-max scaled anomaly score.

    Both are null for a row with a null, NaN or infinite feature; such rows take no part in the fit.
    """

    def score(rows: DataFrame) -> DataFrame:
        table = cut_for_passes(rows)
        if table.isEmpty():
            return table.withColumns({"decision": F.lit(None).cast("double"), "anomaly_score": F.lit(None).cast("double")})
        model = fit_one_class(table, columns, nu, seed=seed, **options)
        decided = cut(one_class_decision(table, model, columns))  # read twice by the min-max scaling
        return minmax_score(decided.withColumn("_raw", -F.col("decision")), "_raw").drop("_raw")

    return score_usable(features, columns, score)
