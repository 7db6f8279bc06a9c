"""Saving and loading fitted pipelines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def save_model(model: PipelineModel, path: str) -> str:
    """Overwrite-save a fitted pipeline: scaler and clusterer together."""
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The saved pipeline, or None when there is none at ``path``."""
    try:
        spark.read.text(f"{path}/metadata")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return PipelineModel.load(path)
