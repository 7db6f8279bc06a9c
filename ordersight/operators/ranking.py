"""Top-k, ranks and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions import features as C

MAX_TOP = 1000


def ranked_top(df: DataFrame, order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of a total order with their 1-based rank.

    The limit comes first, so the ranking window sees at most ``n`` rows.
    """
    top = df.orderBy(*order).limit(n)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def rank_in_group(df: DataFrame, by: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group with their rank; groups are cut to ``n`` before the shuffle."""
    within = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(within)).where(F.col(rank) <= n)


def top_risk_orders(scored: DataFrame, n: int = 50, threshold: float = 0.8, score: str = "anomaly_score") -> DataFrame:
    """The ``n`` riskiest orders, highest score first, ties by order id."""
    top = ranked_top(
        scored.select(
            "user_id",
            "order_id",
            F.col(score).alias("anomaly_score"),
            "amount",
            "time_diff",
            C.is_rush_hour(F.col("order_time")).alias("is_rush_hour"),
            "device_type",
        ),
        [F.desc("anomaly_score"), "order_id"],
        n,
    )
    return top.withColumn("is_high_risk", C.threshold_label(F.col("anomaly_score"), threshold)).withColumn(
        "risk_level", C.risk_level(F.col("anomaly_score"))
    )


def paginate(ranked: DataFrame, page: int = 1, page_size: int = 10, rank: str = "rank") -> DataFrame:
    """One page of a ranked frame with total and total_pages on every row."""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page must be positive and page_size within 1..100")
    totals = ranked.agg(F.count("*").alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / page_size).cast("long")
    )
    rows = ranked.where(F.col(rank).between((page - 1) * page_size + 1, page * page_size))
    return rows.crossJoin(F.broadcast(totals))


def score_sample(scored: DataFrame, n: int = 1000, score: str = "anomaly_score") -> DataFrame:
    """The scores of the first ``n`` orders by id."""
    return scored.select("order_id", score).orderBy("order_id").limit(n)


def rank_features(importance: DataFrame) -> DataFrame:
    """Features by importance, with rank and share of the sum; one row per model feature."""
    order = [F.desc("importance"), "feature"]
    total = importance.agg(F.sum("importance").alias("_total"))
    ranked = importance.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.crossJoin(F.broadcast(total)).select(
        "rank",
        "feature",
        "importance",
        F.when(F.col("_total") > 0, F.col("importance") / F.col("_total")).otherwise(0.0).alias("share"),
    )
