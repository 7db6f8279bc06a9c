"""Joins: scores by key, fixed domains and one-row statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scores(orders: DataFrame, scores: DataFrame, key: str = "order_id") -> DataFrame:
    """Orders with their score, matched by key."""
    return orders.join(scores, key, "inner")


def zero_fill(domain: DataFrame, grouped: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Every row of a small fixed ``domain``; counts without a match become 0."""
    filled = domain.join(grouped, key, "left")
    return filled.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in counts else F.col(c) for c in filled.columns])


def hours(spark) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("int").alias("hour"))


def broadcast_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row."""
    return df.crossJoin(F.broadcast(one_row))
