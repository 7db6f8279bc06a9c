"""Risk reports over scored orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions import features as C
from ordersight.functions.rounding import tidy
from ordersight.operators.joins import broadcast_scalar, hours, zero_fill
from ordersight.operators.quality import clean_counts
from ordersight.operators.ranking import top_risk_orders


def risk_overview(raw: DataFrame, scored: DataFrame, threshold: float = 0.8, score: str = "anomaly_score") -> DataFrame:
    """Total, cleaned, removed and suspicious rows, suspicious share of cleaned (4 places) and its level."""
    flagged = scored.agg(F.count_if(F.col(score) >= threshold).alias("suspicious_orders"))
    joined = broadcast_scalar(clean_counts(raw), flagged)
    share = tidy(F.col("suspicious_orders") / F.col("cleaned_rows"), 4)
    return joined.select(
        F.col("total_rows").alias("total_orders"),
        F.col("cleaned_rows").alias("cleaned_samples"),
        F.col("removed_rows").alias("removed_samples"),
        "suspicious_orders",
        F.when(F.col("cleaned_rows") > 0, share).otherwise(0.0).alias("anomaly_ratio"),
        F.lit(float(threshold)).alias("threshold"),
    ).withColumn("level", C.anomaly_rate_level(F.col("anomaly_ratio")))


def flagged_orders(scored: DataFrame, threshold: float, score: str = "anomaly_score") -> DataFrame:
    return scored.where(F.col(score) >= threshold)


def risk_by_hour(scored: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Flagged orders per hour over all 24 hours, with the overall rush share on every row."""
    counts = flagged_orders(scored, threshold).groupBy(F.col("order_time").alias("hour")).agg(F.count("*").alias("count"))
    filled = zero_fill(hours(scored.sparkSession), counts, "hour", ["count"])
    totals = filled.agg(
        F.sum("count").alias("_all"), F.sum(F.when(C.is_rush_hour(F.col("hour")) == 1, F.col("count"))).alias("_rush")
    )
    share = F.when(F.col("_all") > 0, F.col("_rush") / F.col("_all")).otherwise(0.0)
    return broadcast_scalar(filled, totals).select("hour", "count", share.alias("rush_hour_ratio"))


def risk_by_device(scored: DataFrame, threshold: float = 0.8) -> DataFrame:
    return (
        flagged_orders(scored, threshold)
        .groupBy("device_type")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "device_type")
    )


def high_risk_profile(scored: DataFrame, threshold: float = 0.8, n: int = 50) -> DataFrame:
    """Among the top ``n`` orders, those at or above the threshold: count and mean score, amount and gap."""
    return top_risk_orders(scored, n, threshold).where("is_high_risk = 1").agg(
        F.count("*").alias("high_risk_count"),
        F.avg("anomaly_score").alias("avg_score"),
        F.avg("amount").alias("avg_amount"),
        F.avg("time_diff").alias("avg_time_diff"),
    )


def peak_rush_hour(scored: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rush hour with most flagged orders, first hour on ties; no row when there is none."""
    by_hour = risk_by_hour(scored, threshold).where(C.is_rush_hour(F.col("hour")) == 1).where("count > 0")
    return by_hour.orderBy(F.desc("count"), "hour").limit(1)


def top_device_share(scored: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Device with most flagged orders, its share, and whether it exceeds one half."""
    devices = risk_by_device(scored, threshold)
    total = devices.agg(F.sum("count").alias("_all"))
    top = devices.orderBy(F.desc("count"), "device_type").limit(1)
    return broadcast_scalar(top, total).select(
        "device_type",
        "count",
        (F.col("count") / F.col("_all")).alias("share"),
        (F.col("count") / F.col("_all") > 0.5).cast("int").alias("concentrated"),
    )


def recommended_actions(overview: DataFrame, ranked_features: DataFrame, best: DataFrame) -> DataFrame:
    """Codes of the actions whose rule fires, numbered in rule order; feedback always fires."""
    top = ranked_features.where("rank = 1").select(F.col("feature").alias("top_feature"))
    state = overview.select("anomaly_ratio").join(top, how="left").join(best.select("best_f1"), how="left")
    ratio, feature, f1 = F.col("anomaly_ratio"), F.col("top_feature"), F.col("best_f1")
    fired = F.array(
        F.when(ratio >= 0.10, "urgent_treatment").when(ratio >= 0.05, "tighten_monitoring"),
        F.when(feature == "time_diff", "tune_gap_rules").when(feature == "is_rush_hour", "control_rush_hours"),
        F.when(f1 >= 0.90, "deploy_model").when(f1 >= 0.80, "keep_improving"),
        F.lit("feedback_loop"),
    )
    return state.select(F.posexplode(F.filter(fired, lambda a: a.isNotNull())).alias("pos", "action")).select(
        (F.col("pos") + 1).alias("rank"), "action"
    )


def risk_summary(overview: DataFrame, best: DataFrame) -> DataFrame:
    """Headline row: totals, ratio, threshold, best model and its F1."""
    return overview.select("total_orders", "suspicious_orders", "anomaly_ratio", "threshold").join(
        best.select("best_model", "best_f1"), how="left"
    )
