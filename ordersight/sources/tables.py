"""Views of the given Parquet tables in the shape of the transaction data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.functions.features import padded_id
from ordersight.operators.ordered import previous_in_key

# Device names by the remainder of the event property k, divided by five.
EVENT_DEVICES = ("iOS", "Android", "PC", "H5", "Other")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders_of_events(events: DataFrame) -> DataFrame:
    """Per-row columns of the transactions view, without the gap; works on a stream too."""
    code = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "user_id",
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("amount"),
        F.hour("ts").alias("order_time"),
        F.element_at(F.array(*map(F.lit, EVENT_DEVICES)), F.pmod(code, F.lit(5)) + 1).alias("device_type"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_cheat"),
    )


def gap_seconds(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Add ``time_diff``: seconds since the same user's previous order (null for the first)."""
    timed = df.withColumn("_us", F.unix_micros("ts"))
    lagged = previous_in_key(timed, "user_id", "_us", "event_id", "_previous_us", rows_per_task)
    return lagged.withColumn("time_diff", (F.col("_us") - F.col("_previous_us")) / 1e6).drop("_us", "_previous_us")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The ``tx`` view: one order per event, with the gap to the user's previous order."""
    orders = orders_of_events(table(spark, folder, "events"))
    # the id is padded before the gap is taken, so that grouping by user reuses the same shuffle
    named = orders.withColumn("user_id", padded_id("U", F.col("user_id"), 6))
    return gap_seconds(named).select(
        "user_id",
        padded_id("O", F.col("event_id"), 8).alias("order_id"),
        "amount",
        "time_diff",
        "order_time",
        "device_type",
        "is_cheat",
        "ts",
    )


def card_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The ``cc`` view: seconds since the first row, 28 features, amount and class."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("event_id"), F.col("embedding"), F.col("label")
    )
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    joined = vectors.join(events, "event_id").select(
        F.col("event_id").alias("vec_id"),
        F.unix_micros("ts").alias("_us"),
        F.slice("embedding", 1, 28).cast("array<double>").alias("V"),
        F.col("value").alias("Amount"),
        F.when(F.col("label") == 0, 1).otherwise(0).alias("Class"),
    )
    first = joined.agg(F.min("_us").alias("_first"))  # one row
    return joined.crossJoin(F.broadcast(first)).select(
        "vec_id", ((F.col("_us") - F.col("_first")) / 1e6).alias("Time"), "V", "Amount", "Class"
    )
