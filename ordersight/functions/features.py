"""Scalar features, bins, levels and scores as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Device codes, rush hours and bin edges of the data model.
DEVICE_CODES = {"iOS": 0, "Android": 1, "PC": 2, "H5": 3}
RUSH_FIRST, RUSH_LAST = 1, 6
HOUR_BINS = ((0, 6, "00-06"), (6, 12, "06-12"), (12, 18, "12-18"), (18, 24, "18-24"))
AMOUNT_BINS = (
    (0, 500, "0-500"),
    (500, 1000, "500-1000"),
    (1000, 1500, "1000-1500"),
    (1500, 2000, "1500-2000"),
    (2000, 3000, "2000-3000"),
)
AMOUNT_BANDS = ((50, "<50"), (200, "50-200"), (500, "200-500"), (1000, "500-1000"))
AMOUNT_BAND_TOP = ">=1000"
SCORE_BUCKETS = ((0.2, "0-0.2"), (0.4, "0.2-0.4"), (0.6, "0.4-0.6"), (0.8, "0.6-0.8"))
SCORE_BUCKET_TOP = "0.8-1.0"
RISK_LEVELS = ((0.9, "extreme"), (0.8, "high"), (0.6, "medium"))
RATE_LEVELS = ((0.15, "elevated"), (0.08, "medium"), (0.03, "low"))


def log_amount(amount: Column) -> Column:
    return F.log1p(amount)


def is_rush_hour(hour: Column) -> Column:
    return F.when(hour.between(RUSH_FIRST, RUSH_LAST), 1).otherwise(0)


def device_code(device: Column, default: int = 1) -> Column:
    """Device name to code; unknown and null devices take ``default``."""
    code = F.lit(default)
    for name, value in DEVICE_CODES.items():
        code = F.when(device == name, value).otherwise(code)
    return code


def _below(value: Column, steps, top: str) -> Column:
    """Label of the first upper bound that exceeds ``value``; null stays null."""
    label = F.lit(top)
    for bound, name in reversed(steps):
        label = F.when(value < bound, name).otherwise(label)
    return F.when(value.isNotNull(), label)


def _at_least(value: Column, steps, bottom: str) -> Column:
    """Label of the highest lower bound reached by ``value``; null stays null."""
    label = F.lit(bottom)
    for bound, name in reversed(steps):
        label = F.when(value >= bound, name).otherwise(label)
    return F.when(value.isNotNull(), label)


def hour_bin(hour: Column) -> Column:
    """Left-closed quarter of the day, null outside 0-23."""
    label = F.lit(None).cast("string")
    for lo, hi, name in HOUR_BINS:
        label = F.when((hour >= lo) & (hour < hi), name).otherwise(label)
    return label


def amount_bin(amount: Column) -> Column:
    """Right-closed amount bin, null outside (0, 3000]."""
    label = F.lit(None).cast("string")
    for lo, hi, name in AMOUNT_BINS:
        label = F.when((amount > lo) & (amount <= hi), name).otherwise(label)
    return label


def amount_band(amount: Column) -> Column:
    return _below(amount, AMOUNT_BANDS, AMOUNT_BAND_TOP)


def score_bucket(score: Column) -> Column:
    return _below(score, SCORE_BUCKETS, SCORE_BUCKET_TOP)


def risk_level(score: Column) -> Column:
    return _at_least(score, RISK_LEVELS, "low")


def anomaly_rate_level(ratio: Column) -> Column:
    return _at_least(ratio, RATE_LEVELS, "minimal")


def hour_from_seconds(seconds: Column) -> Column:
    """Hour of day of an offset in seconds."""
    return F.floor(F.pmod(seconds, F.lit(86400.0)) / 3600.0).cast("int")


def padded_id(prefix: str, value: Column, width: int) -> Column:
    """Prefixed zero-padded id; ids longer than ``width`` are kept whole."""
    text = value.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")))


def threshold_label(score: Column, threshold: float = 0.8) -> Column:
    return (score >= F.lit(float(threshold))).cast("int")


def rule_score(
    amount: Column, gap: Column, hour: Column, amount_lt: float = 20.0, gap_lt: float = 5.0
) -> Column:
    """Rule score in [0.2, 1]: small amount, short gap and rush hour add up."""
    return F.least(
        F.lit(1.0),
        F.when(amount < amount_lt, 0.4).otherwise(0.1)
        + F.when(gap < gap_lt, 0.4).otherwise(0.1)
        + F.when(is_rush_hour(hour) == 1, 0.2).otherwise(0.0),
    )


def with_rule_score(df: DataFrame, amount_lt: float = 20.0, gap_lt: float = 5.0) -> DataFrame:
    """Add ``anomaly_score`` and ``is_anomaly`` (score above 0.5); batch or stream."""
    score = rule_score(F.col("amount"), F.col("time_diff"), F.col("order_time"), amount_lt, gap_lt)
    scored = df.withColumn("anomaly_score", score)
    return scored.withColumn("is_anomaly", (F.col("anomaly_score") > 0.5).cast("int"))


def with_features(df: DataFrame, unknown_device: int = 1) -> DataFrame:
    """Add the model features to a transactions frame; batch or stream."""
    return df.select(
        "*",
        log_amount(F.col("amount")).alias("log_amount"),
        is_rush_hour(F.col("order_time")).alias("is_rush_hour"),
        device_code(F.col("device_type"), unknown_device).alias("device_code"),
    )
