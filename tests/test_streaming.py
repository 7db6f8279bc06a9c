import datetime as dt

import pytest
from pyspark.sql import functions as F

from ordersight.models import mixtures
from ordersight.models.features import feature_table
from ordersight.plans.streams import event_stream
from ordersight.schemas import EVENT_SCHEMA
from ordersight.session import cut, fresh_dir
from ordersight.sources.models import save_model
from ordersight.sources.tables import transactions
from ordersight.streaming import detect
from ordersight.streaming.io import read_sink, stream_sink, stream_source

START = dt.datetime(2024, 1, 1)


def write_events(spark, path, rows):
    data = [(i, START + dt.timedelta(seconds=s), u, "view", 5.0, '{"k": 1}') for i, s, u in rows]
    spark.createDataFrame(data, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def gaps(spark, sink):
    return {r.order_id: r.time_diff for r in read_sink(spark, sink).collect()}


def run_once(spark, source, sink, checkpoint, **options):
    run = detect.start_detection(
        spark, stream_source(spark, source), sink, checkpoint, available_now=True, **options
    )
    run.query.awaitTermination()
    return run


def test_restart_keeps_state_and_doubles_nothing(spark):
    source, sink, checkpoint = (fresh_dir(spark, n) for n in ("source", "sink", "checkpoint"))
    write_events(spark, source, [(1, 0, 7), (2, 10, 7), (3, 3, 8)])
    first = run_once(spark, source, sink, checkpoint)
    first.stop()
    write_events(spark, source, [(4, 25, 7), (5, 5, 7), (6, 9, 8)])
    second = run_once(spark, source, sink, checkpoint)
    second.stop()
    third = run_once(spark, source, sink, checkpoint)
    third.stop()
    got = gaps(spark, sink)
    # order 5 arrives after a later order of the same user: kept, without a gap
    assert got == {"O00000001": None, "O00000002": 10.0, "O00000003": None, "O00000004": 15.0, "O00000005": None, "O00000006": 6.0}
    assert read_sink(spark, sink).count() == 6


def test_repeated_batch_replaces_itself(spark):
    source, sink = fresh_dir(spark, "source"), fresh_dir(spark, "sink")
    write_events(spark, source, [(1, 0, 1), (2, 1, 1)])
    for _ in range(2):  # a lost checkpoint replays batch 0
        stream_sink(stream_source(spark, source), sink, fresh_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    assert read_sink(spark, sink).count() == 2
    assert tuple(detect.run_totals(spark, sink).first()) == (1, 2)


def test_run_control(spark):
    source = fresh_dir(spark, "source")
    write_events(spark, source, [(1, 0, 1), (2, 1, 1)])
    sink = fresh_dir(spark, "sink")
    run = detect.start_detection(spark, stream_source(spark, source), sink, fresh_dir(spark, "checkpoint"), name="one")
    with pytest.raises(RuntimeError, match="already running"):
        detect.start_detection(spark, stream_source(spark, source), sink, fresh_dir(spark, "checkpoint"), name="one")
    assert run.status()["is_running"] and run.status()["detection_mode"] == "rule"
    run.query.processAllAvailable()
    status = run.stop()
    assert status["total_records"] == 2 and status["processed_batches"] >= 1
    assert not status["is_running"] and not run.stop()["is_running"]
    assert read_sink(spark, sink).count() == 2


def test_modes(spark, small):
    missing = fresh_dir(spark, "none")
    assert detect.select_mode(spark, "auto", missing) == ("rule", None)
    with pytest.raises(ValueError, match="no model"):
        detect.select_mode(spark, "ml", missing)
    with pytest.raises(ValueError, match="mode"):
        detect.select_mode(spark, "other")


def test_ml_stream_equals_batch(spark, small):
    features = cut(feature_table(transactions(spark, small)))
    path = save_model(mixtures.fit_kmeans(features), fresh_dir(spark, "kmeans"))
    mode, model = detect.select_mode(spark, "auto", path)
    assert mode == "ml"
    sink = fresh_dir(spark, "sink")
    scored = detect.score_stream(detect.order_stream(event_stream(spark, small)), mode, model)
    stream_sink(scored, sink, fresh_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    batch = detect.ml_score(features, model).select("order_id", F.col("anomaly_score").alias("b"))
    joined = read_sink(spark, sink).join(batch, "order_id")
    assert joined.count() == features.count() and joined.where("abs(anomaly_score - b) > 1e-9").count() == 0


def test_latest_is_bounded_and_newest_last(spark):
    rows = [(f"O{i:04d}", START + dt.timedelta(seconds=i)) for i in range(600)]
    results = spark.createDataFrame(rows, "order_id string, ts timestamp")
    got = [r.order_id for r in detect.stream_latest(results, 9999).collect()]
    assert len(got) == 500 and got[-1] == "O0599" and got == sorted(got)


def test_statistics_of_an_empty_sink(spark):
    empty = spark.createDataFrame([], "anomaly_score double, is_anomaly int")
    assert detect.stream_statistics(empty).first().asDict() == {
        "total_count": 0, "anomaly_count": 0, "anomaly_ratio": 0.0, "avg_anomaly_score": 0.0,
        "max_anomaly_score": 0.0, "min_anomaly_score": 0.0}


def test_late_rows_leave_closed_windows_alone(spark):
    source, sink = fresh_dir(spark, "source"), fresh_dir(spark, "sink")
    # the watermark moves between batches and drops rows one batch later; the fifth file is behind it
    for seconds in (100, 4000, 20_000, 21_000, 200, 30_000):
        write_events(spark, source, [(seconds, seconds, 1)])
    orders = stream_source(spark, source).select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit(0.5).alias("anomaly_score"), F.lit(0).alias("is_anomaly")
    )
    live = detect.live_statistics(orders)
    stream_sink(live, sink, fresh_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    counts = {str(r.start): r.total_count for r in read_sink(spark, sink).collect()}
    assert counts == {"2024-01-01 00:00:00": 1, "2024-01-01 01:00:00": 1, "2024-01-01 05:00:00": 2}


def test_a_null_time_does_not_stop_the_stream(spark):
    """An order without a time has no gap; the orders after it keep theirs, in this batch and the next."""
    from ordersight.streaming.gaps import stream_gap_state

    layout = "user_id long, event_id long, ts timestamp, amount double"
    source, checkpoint = fresh_dir(spark, "source"), fresh_dir(spark, "checkpoint")
    at = lambda s: None if s is None else START + dt.timedelta(seconds=s)
    found = {}
    for batch in ([(7, 1, 0), (7, 2, None), (7, 3, 4), (8, 4, None)], [(7, 5, None), (7, 6, 10), (8, 7, 1), (None, 8, 2)]):
        rows = [(user, event, at(s), 1.0) for user, event, s in batch]
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(source)
        gapped = stream_gap_state(spark.readStream.schema(layout).parquet(source))
        keep = lambda df, _: found.update({r.event_id: (r.ts, r.time_diff) for r in df.collect()})
        writer = gapped.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    assert {event: gap for event, (_, gap) in found.items()} == {1: None, 2: None, 3: 4.0, 4: None, 5: None, 6: 6.0, 7: None, 8: None}
    assert [event for event, (ts, _) in sorted(found.items()) if ts is None] == [2, 4, 5]


def test_totals_before_the_first_batch_and_over_a_restart(spark):
    source, sink, checkpoint = (fresh_dir(spark, n) for n in ("source", "sink", "checkpoint"))
    spark.createDataFrame([], EVENT_SCHEMA).write.parquet(source)
    assert run_once(spark, source, sink, checkpoint).stop()["total_records"] == 0
    for rows in ([(1, 0, 1), (2, 1, 1)], [(3, 5, 2)]):
        write_events(spark, source, rows)
        status = run_once(spark, source, sink, checkpoint).stop()
    assert status["total_records"] == 3 == read_sink(spark, sink).count() and not status["is_running"]


def test_model_mode_keeps_first_orders(spark, small):
    """A user's first order has no gap: it stays, without a score, and does not count as an anomaly."""
    features = cut(feature_table(transactions(spark, small)))
    model = mixtures.fit_kmeans(features)
    rows = spark.createDataFrame(
        [("a", 5.0, None, 3, "iOS"), ("b", 5.0, 9.0, 3, "iOS"), ("c", -3.0, 9.0, 3, "PC")],
        "order_id string, amount double, time_diff double, order_time int, device_type string",
    )
    got = {r.order_id: r for r in detect.ml_score(detect.stream_features(rows), model).collect()}
    assert len(got) == 3 and got["a"].time_diff is None and got["b"].anomaly_score is not None
    for name in ("a", "c"):
        assert (got[name].anomaly_score, got[name].is_anomaly) == (None, 0)


def test_live_statistics_follow_the_gap_rule(spark):
    """Gap state and event-time windows in one stream: the second order of a user scores by its gap, across batches too."""
    source, sink = fresh_dir(spark, "source"), fresh_dir(spark, "sink")
    for i, seconds in enumerate((14 * 3600, 14 * 3600 + 2, 40 * 3600, 60 * 3600)):
        write_events(spark, source, [(i, seconds, 1)])
    scored = detect.score_stream(detect.order_stream(stream_source(spark, source)), "rule", None, gap_lt=5.0)
    stream_sink(detect.live_statistics(scored), sink, fresh_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    rows = {str(r.start): r for r in read_sink(spark, sink).collect()}
    first = rows["2024-01-01 14:00:00"]
    assert first.total_count == 2 and first.max_anomaly_score - first.min_anomaly_score == pytest.approx(0.3)
    assert rows["2024-01-02 16:00:00"].total_count == 1


def test_many_users_share_few_python_calls(spark):
    """Users of a slot keep their own gaps over batches, and calls do not grow with the users."""
    from ordersight.streaming.gaps import stream_gap_state

    layout = "user_id long, event_id long, ts timestamp, amount double"
    source, checkpoint = fresh_dir(spark, "source"), fresh_dir(spark, "checkpoint")
    big = 2**53 + 1
    found, groups = {}, set()
    for batch in range(2):
        rows = [(u, big + 2 * u + batch, START + dt.timedelta(seconds=100 * batch + u * batch), 1.0) for u in range(60)]
        # a missing id among the rows must not round the ids beside it
        rows += [(None, 5 + batch, START + dt.timedelta(seconds=7 * batch), 1.0), (3, None, None, 1.0), (0, 1 + batch, START, 2.0)]
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(source)
        gapped = stream_gap_state(spark.readStream.schema(layout).parquet(source), slots=2)

        def keep(df, _):
            rows = df.collect()
            groups.add(len(rows))
            found.update({(r.user_id, r.event_id): r.time_diff for r in rows})

        writer = gapped.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
    assert groups == {63}
    assert {u: found[u, big + 2 * u + 1] for u in range(60)} == {u: 100.0 + u for u in range(60)}
    assert found[0, 1] is None and found[0, big] == 0.0  # equal times, by event
    assert found[0, 2] == 0.0 and found[None, 5] is None and found[None, 6] == 7.0 and found[3, None] is None
