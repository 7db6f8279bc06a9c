"""Scoring of an order stream, run control and statistics of its results."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ordersight.functions.features import padded_id, with_features, with_rule_score
from ordersight.models.mixtures import kmeans_distance
from ordersight.sources.models import load_model
from ordersight.sources.tables import orders_of_events
from ordersight.streaming.gaps import stream_gap_state
from ordersight.streaming.io import batch_counts, stream_sink

DISTANCE_SCALE = 5.0
ANOMALY_ABOVE = 0.5
LATEST_LIMIT = 500
RESULT_COLUMNS = (
    "user_id",
    "order_id",
    "amount",
    "time_diff",
    "order_time",
    "device_type",
    "anomaly_score",
    "is_anomaly",
)
MODES = ("auto", "ml", "rule")


def order_stream(events: DataFrame) -> DataFrame:
    """Events stream to orders with their gap and string ids."""
    orders = stream_gap_state(orders_of_events(events))
    return orders.withColumns(
        {"user_id": padded_id("U", F.col("user_id"), 6), "order_id": padded_id("O", F.col("event_id"), 8)}
    ).drop("event_id")


def stream_features(orders: DataFrame, unknown_device: int = 1) -> DataFrame:
    """Model features of a stream: the batch expressions unchanged."""
    return with_features(orders, unknown_device)


def ml_score(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Distance to the nearest centre over 5, at most 1; anomaly above 0.5.

    A row that lacks a feature (a user's first order has no gap) stays, with a null score and no anomaly.
    """
    kept = {f"_{c}": F.col(c) for c in ("time_diff", "log_amount")}
    filled = features.withColumns({**kept, **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("time_diff", "log_amount")}})
    known = F.col("_time_diff").isNotNull() & F.col("_log_amount").isNotNull()
    score = F.when(known, F.least(F.lit(1.0), F.col("distance") / DISTANCE_SCALE))
    scored = kmeans_distance(filled, model).withColumn("anomaly_score", score)
    flag = F.coalesce((F.col("anomaly_score") > ANOMALY_ABOVE).cast("int"), F.lit(0))
    restored = {"time_diff": F.col("_time_diff"), "log_amount": F.col("_log_amount"), "distance": F.when(known, F.col("distance"))}
    return scored.withColumns({**restored, "is_anomaly": flag}).drop(*kept)


def select_mode(spark: SparkSession, mode: str = "auto", model_path: str | None = None) -> tuple[str, PipelineModel | None]:
    """('ml', model) when a model is asked for and loads, ('rule', None) otherwise; 'ml' without a model is an error."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    model = load_model(spark, model_path) if model_path and mode != "rule" else None
    if mode == "ml" and model is None:
        raise ValueError(f"no model at {model_path}")
    return ("ml", model) if model is not None else ("rule", None)


def score_stream(orders: DataFrame, mode: str, model: PipelineModel | None, **thresholds: float) -> DataFrame:
    """Features and score of an order stream in the selected mode."""
    features = stream_features(orders)
    return ml_score(features, model) if mode == "ml" else with_rule_score(features, **thresholds)


def project_results(scored: DataFrame, keep_time: bool = True) -> DataFrame:
    """The eight result columns, with the event time last unless dropped."""
    return scored.select(*RESULT_COLUMNS, *(["ts"] if keep_time else []))


def run_totals(spark: SparkSession, sink: str) -> DataFrame:
    """One row: batches and records that stand in a sink, exact also after a restart or a repeated batch."""
    return batch_counts(spark, sink).agg(
        F.count("*").alias("processed_batches"), F.coalesce(F.sum("records"), F.lit(0)).alias("total_records")
    )


@dataclass
class DetectionRun:
    """Handle of a running detection stream."""

    spark: SparkSession
    query: StreamingQuery
    mode: str
    sink: str
    started: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def status(self) -> dict:
        totals = run_totals(self.spark, self.sink).first()
        return {
            "is_running": self.query.isActive,
            "start_time": self.started.isoformat(timespec="seconds"),
            "processed_batches": totals.processed_batches,
            "total_records": totals.total_records,
            "detection_mode": self.mode,
        }

    def stop(self) -> dict:
        if self.query.isActive:
            self.query.stop()
        return self.status()


def start_detection(
    spark: SparkSession,
    events: DataFrame,
    sink: str,
    checkpoint: str,
    mode: str = "auto",
    model_path: str | None = None,
    name: str = "order_detection",
    available_now: bool = False,
    **thresholds: float,
) -> DetectionRun:
    """Start scoring an events stream into ``sink``; refuses while a run of the same name is active."""
    if any(q.name == name for q in spark.streams.active):
        raise RuntimeError(f"{name} is already running")
    selected, model = select_mode(spark, mode, model_path)
    results = project_results(score_stream(order_stream(events), selected, model, **thresholds))
    query = stream_sink(results, sink, checkpoint, name, available_now)
    return DetectionRun(spark, query, selected, sink)


def stream_latest(results: DataFrame, n: int = 50) -> DataFrame:
    """The latest ``n`` (at most 500) results, newest last."""
    n = max(1, min(LATEST_LIMIT, int(n)))
    return results.orderBy(F.desc("ts"), F.desc("order_id")).limit(n).orderBy("ts", "order_id")


def result_statistics() -> list:
    return [
        F.count("*").alias("total_count"),
        F.coalesce(F.sum("is_anomaly"), F.lit(0)).alias("anomaly_count"),
        F.coalesce(F.avg(F.col("is_anomaly").cast("double")), F.lit(0.0)).alias("anomaly_ratio"),
        F.coalesce(F.avg("anomaly_score"), F.lit(0.0)).alias("avg_anomaly_score"),
        F.coalesce(F.max("anomaly_score"), F.lit(0.0)).alias("max_anomaly_score"),
        F.coalesce(F.min("anomaly_score"), F.lit(0.0)).alias("min_anomaly_score"),
    ]


def stream_statistics(results: DataFrame) -> DataFrame:
    """Count, anomalies, their share and score range of everything in the sink."""
    return results.agg(*result_statistics())


def live_statistics(scored: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """The same statistics per event-time window; rows later than the watermark are left out here only."""
    grouped = scored.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"))
    return grouped.agg(*result_statistics()).select("w.start", "w.end", "*").drop("w")
