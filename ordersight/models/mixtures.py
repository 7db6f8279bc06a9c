"""K-means and Gaussian-mixture anomaly scores on MLlib pipelines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.models.features import scaler_stages, score_usable, usable
from ordersight.operators.scores import minmax_score
from ordersight.schemas import FEATURES


def fit_kmeans(features: DataFrame, k: int = 2, seed: int = 42, rounds: int = 20) -> PipelineModel:
    """Scaler and K-means in one pipeline, so both are saved together."""
    kmeans = KMeans(featuresCol="features", predictionCol="prediction", k=k, seed=seed, maxIter=rounds)
    return Pipeline(stages=[*scaler_stages(list(FEATURES)), kmeans]).fit(features.where(usable(list(FEATURES))))


def fit_gmm(features: DataFrame, k: int = 2, seed: int = 42, rounds: int = 20) -> PipelineModel:
    mixture = GaussianMixture(
        featuresCol="features", predictionCol="prediction", probabilityCol="probability", k=k, seed=seed, maxIter=rounds
    )
    return Pipeline(stages=[*scaler_stages(list(FEATURES)), mixture]).fit(features.where(usable(list(FEATURES))))


def centre_distance(centres: list, features: Column) -> Column:
    """Distance of a feature array to the nearest centre, as column arithmetic."""

    def distance(centre) -> Column:
        squares = [(features[j] - F.lit(float(c))) * (features[j] - F.lit(float(c))) for j, c in enumerate(centre)]
        return F.sqrt(sum(squares[1:], squares[0]))

    distances = [distance(c) for c in centres]
    return F.least(*distances) if len(distances) > 1 else distances[0]


def kmeans_distance(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``distance`` to the nearest centre; works on a batch or a stream."""
    prepared = features
    for stage in model.stages[:-1]:
        prepared = stage.transform(prepared)
    distance = centre_distance(model.stages[-1].clusterCenters(), F.col("_f"))
    return (
        prepared.withColumn("_f", vector_to_array("features"))
        .withColumn("distance", distance)
        .drop("_f", "raw_features", "features")
    )


def kmeans_score(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Min-max scaled distance to the nearest centre; null for rows without usable features."""
    return score_usable(features, list(FEATURES), lambda rows: minmax_score(kmeans_distance(rows, model), "distance"))


def gmm_score(features: DataFrame, model: PipelineModel, density: bool = False) -> DataFrame:
    """1 - largest posterior; with ``density`` the min-max scaled negative log density instead.

    Null for rows without usable features.
    """
    return score_usable(features, list(FEATURES), lambda rows: usable_gmm_score(rows, model, density))


def usable_gmm_score(features: DataFrame, model: PipelineModel, density: bool) -> DataFrame:
    if not density:
        posterior = F.array_max(vector_to_array("probability"))
        return (
            model.transform(features)
            .withColumn("anomaly_score", 1.0 - posterior)
            .drop("raw_features", "features", "probability", "prediction")
        )
    prepared = features
    for stage in model.stages[:-1]:
        prepared = stage.transform(prepared)
    mixture = model.stages[-1]
    x = F.col("_f")
    terms = []
    for weight, gaussian in zip(mixture.weights, mixture.gaussians, strict=True):
        terms.append(log_density(x, gaussian.mean.toArray(), gaussian.cov.toArray()) + math.log(max(weight, 1e-300)))
    peak = F.greatest(*terms) if len(terms) > 1 else terms[0]
    total = peak + F.log(sum([F.exp(t - peak) for t in terms[1:]], F.exp(terms[0] - peak)))
    scored = prepared.withColumn("_f", vector_to_array("features")).withColumn("_raw", -total)
    return minmax_score(scored, "_raw").drop("_f", "_raw", "raw_features", "features")


def log_density(x: Column, mean, covariance) -> Column:
    """Log density of a Gaussian as column arithmetic."""
    values, vectors = np.linalg.eigh(covariance)
    values = np.maximum(values, 1e-9)
    total = F.lit(float(-0.5 * (len(mean) * np.log(2 * np.pi) + np.log(values).sum())))
    for value, axis in zip(values, vectors.T, strict=True):
        along = sum(
            [(x[j] - float(mean[j])) * float(axis[j]) for j in range(1, len(mean))], (x[0] - float(mean[0])) * float(axis[0])
        )
        total = total - along * along / float(2 * value)
    return total
