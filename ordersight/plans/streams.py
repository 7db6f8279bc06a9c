"""Registered queries: Structured Streaming runs over the events table, read back from their sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.functions.features import with_rule_score
from ordersight.functions.rounding import round_doubles
from ordersight.models import mixtures
from ordersight.models.features import feature_table
from ordersight.plans.registry import query
from ordersight.plans.views import GAP_LT, RULE, TX, r
from ordersight.schemas import FEATURES
from ordersight.session import cut, fresh_dir
from ordersight.sources.models import save_model
from ordersight.sources.tables import table, transactions
from ordersight.streaming import detect
from ordersight.streaming.io import read_sink, stream_sink, stream_source

SLICES = 2


_written: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, folder: str, make: Callable[[SparkSession, str], str]) -> str:
    """Path that ``make`` wrote for this application and table folder, written on first use."""
    key = (spark.sparkContext.applicationId, folder, make.__name__)
    if key not in _written:
        _written[key] = make(spark, folder)
    return _written[key]


def event_files(spark: SparkSession, folder: str) -> str:
    """The whole events table as a folder of files in event-time order."""
    events = table(spark, folder, "events")
    path = fresh_dir(spark, "event-stream")
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    share = (seconds("ts") - seconds("a")) / (seconds("b") - seconds("a") + 1)
    sliced = events.crossJoin(F.broadcast(span)).withColumn("slice", F.floor(share * SLICES).cast("int")).drop("a", "b")
    for i in range(SLICES):
        sliced.where(F.col("slice") == i).drop("slice").write.mode("append").parquet(path)
    return path


def event_stream(spark, folder) -> DataFrame:
    """The events in a few micro-batches, oldest files first."""
    path = once(spark, folder, event_files)
    files = len(spark.read.parquet(path).inputFiles())
    return stream_source(spark, path, max_files=max(1, -(-files // SLICES)))


def run(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything available and read its sink."""
    spark = stream.sparkSession
    sink = fresh_dir(spark, f"{label}-sink")
    stream_sink(stream, sink, fresh_dir(spark, f"{label}-checkpoint"), available_now=True).awaitTermination()
    return read_sink(spark, sink)


def detection_sink(spark: SparkSession, folder: str) -> str:
    """Sink of one rule-mode detection run over the whole table, shared by the queries on its results."""
    sink = fresh_dir(spark, "detection-sink")
    running = detect.start_detection(
        spark, event_stream(spark, folder), sink, fresh_dir(spark, "detection-checkpoint"), mode="rule",
        name=f"detection-{sink[-8:]}", available_now=True, gap_lt=GAP_LT,
    )
    running.query.awaitTermination()
    running.stop()
    return sink


def detected(spark, folder) -> DataFrame:
    return read_sink(spark, once(spark, folder, detection_sink))


@query("stream_source", "select event_id, user_id, event_type, round(value, 4) value from events")
def stream_source_query(spark, folder):
    rows = run(event_stream(spark, folder), "source").select("event_id", "user_id", "event_type", "value")
    return round_doubles(rows, 4)


RULE_TX = RULE.replace("from tx where amount is not null and time_diff is not null", "from tx")


@query("stream_sink", "select count(*) total_rows, count(distinct event_id) distinct_orders from events")
def stream_sink_query(spark, folder):
    return detected(spark, folder).agg(
        F.count("*").alias("total_rows"), F.countDistinct("order_id").alias("distinct_orders")
    )


CODE = "case device_type when 'iOS' then 0 when 'Android' then 1 when 'PC' then 2 when 'H5' then 3 else 1 end"


@query(
    "stream_features",
    f"""with {TX} select order_id, {r("ln(1 + amount)")} log_amount, {r("time_diff", 4)} time_diff,
    case when order_time between 1 and 6 then 1 else 0 end is_rush_hour, {CODE} device_code from tx""",
)
def stream_features(spark, folder):
    features = detect.stream_features(detect.order_stream(event_stream(spark, folder)))
    return round_doubles(run(features, "features").select("order_id", *FEATURES), 6, time_diff=4)


RULE_STREAM = RULE_TX.replace("case when time_diff <", "case when time_diff is not null and time_diff <")


@query("stream_rule_score", f"with {RULE_STREAM} select order_id, {r('anomaly_score')} anomaly_score, is_anomaly from scored")
def stream_rule_score(spark, folder):
    return round_doubles(detected(spark, folder).select("order_id", "anomaly_score", "is_anomaly"))


@query(
    "stream_project",
    f"""with {RULE_STREAM} select user_id, order_id, {r("amount", 4)} amount, {r("time_diff", 4)} time_diff, order_time, device_type,
    {r("anomaly_score", 4)} anomaly_score, is_anomaly from scored""",
)
def stream_project(spark, folder):
    return round_doubles(detect.project_results(detected(spark, folder), keep_time=False), 4)


@query("stream_gap_state", f"with {TX} select order_id, {r('time_diff', 4)} time_diff from tx")
def stream_gap_state(spark, folder):
    return round_doubles(detected(spark, folder).select("order_id", "time_diff"), 4)


@query("stream_ml_score")
def stream_ml_score(spark, folder):
    """Stream scored by a K-means pipeline that was fitted on the batch and saved."""
    features = cut(feature_table(transactions(spark, folder)))
    path = save_model(mixtures.fit_kmeans(features), fresh_dir(spark, "stream-kmeans"))
    mode, model = detect.select_mode(spark, "ml", path)
    scored = detect.score_stream(detect.order_stream(event_stream(spark, folder)), mode, model)
    return round_doubles(run(scored, "ml").select("order_id", "anomaly_score", "is_anomaly"))


@query("stream_mode_select", f"with {RULE_STREAM} select 'rule' as mode, is_anomaly, count(*) n from scored group by 2")
def stream_mode_select(spark, folder):
    """Counts of a run whose mode was left open and for which no model exists: rules are chosen."""
    mode, model = detect.select_mode(spark, "auto", fresh_dir(spark, "no-model"))
    scored = detect.score_stream(detect.order_stream(event_stream(spark, folder)), mode, model, gap_lt=GAP_LT)
    return run(scored, "mode").groupBy(F.lit(mode).alias("mode"), "is_anomaly").agg(F.count("*").alias("n"))


@query("stream_run", "select 0 is_running, (select count(*) from events) total_records")
def stream_run(spark, folder):
    """Status after a run has ended: not running, every row processed."""
    sink = fresh_dir(spark, "run-sink")
    running = detect.start_detection(
        spark, event_stream(spark, folder), sink, fresh_dir(spark, "run-checkpoint"), mode="rule",
        name=f"run-{sink[-8:]}", available_now=True, gap_lt=GAP_LT,
    )
    running.query.awaitTermination()
    running.stop()
    return detect.run_totals(spark, sink).select(F.lit(int(running.query.isActive)).alias("is_running"), "total_records")


@query(
    "stream_latest",
    f"""with {RULE_STREAM} select order_id, {r("amount", 4)} amount, {r("anomaly_score", 4)} anomaly_score, is_anomaly
    from scored order by ts desc, order_id desc limit 50""",
)
def stream_latest(spark, folder):
    latest = detect.stream_latest(detected(spark, folder), 50)
    return round_doubles(latest.select("order_id", "amount", "anomaly_score", "is_anomaly"), 4)


STATISTICS = f"""count(*) total_count, cast(sum(is_anomaly) as bigint) anomaly_count, {r("avg(is_anomaly)", 4)} anomaly_ratio,
  {r("avg(anomaly_score)", 4)} avg_anomaly_score, {r("max(anomaly_score)", 4)} max_anomaly_score, {r("min(anomaly_score)", 4)} min_anomaly_score"""


@query("stream_statistics", f"with {RULE_STREAM} select {STATISTICS} from scored")
def stream_statistics(spark, folder):
    return round_doubles(detect.stream_statistics(detected(spark, folder)), 4)


@query(
    "stream_window_statistics",
    f"""with {RULE_STREAM}
    select cast(date_trunc('hour', ts) as varchar) window_start, {STATISTICS} from scored group by 1
    having date_trunc('hour', any_value(ts)) + interval 1 hour <= (select max(ts) - interval 1 hour from tx)""",
)
def stream_window_statistics(spark, folder):
    """Hourly statistics of the closed windows: gap state, score and event-time windows in one stream."""
    live = detect.live_statistics(with_rule_score(detect.order_stream(event_stream(spark, folder)), gap_lt=GAP_LT))
    windows = run(live, "windows").select(F.col("start").cast("string").alias("window_start"), "*")
    return round_doubles(windows.drop("start", "end", "batch_id"), 4)
