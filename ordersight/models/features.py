"""Feature tables the models are fitted on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions.features import with_features
from ordersight.operators.quality import clean
from ordersight.operators.scores import standardize
from ordersight.schemas import FEATURES


def feature_table(df: DataFrame, unknown_device: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cleaned orders reduced to their key, the four model features and any further columns to ``keep``."""
    return with_features(clean(df), unknown_device).select("order_id", *FEATURES, *keep)


def usable(columns: list[str]) -> Column:
    """Whether every feature is a finite number; amounts at or below -1, for one, have no logarithm."""
    finite = [F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in columns]
    return F.array_min(F.array(*finite))


def score_usable(features: DataFrame, columns: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``score`` applied to the rows with usable features; the others stay in the result, without a score."""
    rest = features.where(~usable(columns))
    return score(features.where(usable(columns))).unionByName(rest, allowMissingColumns=True)


def scaled_features(df: DataFrame, ddof: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Key and z-scored features (population deviation unless ``ddof`` is 1)."""
    return standardize(feature_table(df, keep=keep), list(FEATURES), ddof)


def scaler_stages(columns: list[str]) -> list:
    return [
        VectorAssembler(inputCols=columns, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def fit_scaler(features: DataFrame, columns: list[str] = list(FEATURES)) -> PipelineModel:
    """Assembler and scaler (sample deviation) fitted on a feature table."""
    return Pipeline(stages=scaler_stages(columns)).fit(features)


def apply_scaler(features: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(features)
