"""Declared schemas of the two transaction tables and the daily series."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and domains of the transaction data model.
DEVICES = ("iOS", "Android", "PC", "H5")
FEATURES = ("log_amount", "time_diff", "is_rush_hour", "device_code")
V_COLUMNS = tuple(f"V{i}" for i in range(1, 29))
DEFAULT_THRESHOLD = 0.8

TX_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("time_diff", T.DoubleType()),
        T.StructField("order_time", T.IntegerType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("is_cheat", T.IntegerType()),
    ]
)

CC_SCHEMA = T.StructType(
    [T.StructField("Time", T.DoubleType())]
    + [T.StructField(v, T.DoubleType()) for v in V_COLUMNS]
    + [T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.IntegerType())]
)

SERIES_SCHEMA = T.StructType(
    [
        T.StructField("series_key", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("daily_amount", T.DoubleType()),
        T.StructField("daily_count", T.LongType()),
        T.StructField("avg_price", T.DoubleType()),
        T.StructField("rush_ratio", T.DoubleType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
