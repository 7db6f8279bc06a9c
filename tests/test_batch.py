"""Edge cases of the batch operators that the given tables do not reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordersight.operators import aggregates as A
from ordersight.operators import quality as Q
from ordersight.operators import ranking as K
from ordersight.operators import risk as R
from ordersight.operators import scores as S
from ordersight.schemas import TX_SCHEMA
from ordersight.session import fresh_dir
from ordersight.sources import files

ROWS = [
    ("U1", "O1", 10.0, 3.0, 3, "iOS", 1),
    ("U1", "O2", 60.0, None, 4, "PC", None),
    ("U1", "O3", None, 9.0, 23, "H5", 0),
    ("U2", "O4", 1500.0, 7.0, 0, None, 0),
    ("U2", "O5", 700.0, 2.0, 6, "iOS", 1),
]


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame(ROWS, TX_SCHEMA)


def test_clean_drops_and_fills(tx):
    cleaned = Q.clean(tx.withColumn("is_cheat", F.when(F.col("order_id") != "O5", F.col("is_cheat"))))
    assert {r.order_id: r.is_cheat for r in cleaned.collect()} == {"O1": 1, "O4": 0, "O5": 0}
    assert {r.is_cheat for r in Q.clean(tx.drop("is_cheat")).collect()} == {0}
    assert Q.clean_counts(tx).first().asDict() == {"total_rows": 5, "cleaned_rows": 3, "removed_rows": 2}


def test_null_profile(tx):
    got = {r.column: r.null_count for r in Q.null_profile(tx, only_missing=True).collect()}
    assert got == {"amount": 1, "time_diff": 1, "device_type": 1, "is_cheat": 1}


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None)], "k int, v string")
    assert Q.duplicate_count(df).first().asDict() == {"total_rows": 5, "duplicate_rows": 3, "duplicate_pct": 60.0}
    assert Q.drop_duplicates(df).count() == 2
    assert Q.duplicate_count(df.where("false")).first().asDict() == {"total_rows": 0, "duplicate_rows": 0, "duplicate_pct": 0.0}


def test_ingest_needs_its_columns(spark, tx):
    with pytest.raises(ValueError, match="time_diff"):
        files.ingest_dataset(tx.drop("time_diff"), fresh_dir(spark, "ingest"))
    path = fresh_dir(spark, "ingest")
    files.ingest_dataset(tx, path)
    assert files.ingest_dataset(tx.limit(2), path).first().asDict() == {"total_rows": 2, "total_columns": 7}


def test_csv_round_trip_and_bad_fields(spark, tx):
    path = fresh_dir(spark, "csv")
    tx.write.option("header", True).csv(path)
    assert sorted(map(str, files.scan_csv(spark, path).collect())) == sorted(map(str, tx.collect()))
    bad = fresh_dir(spark, "csv")
    spark.createDataFrame([("user_id,order_id,amount,time_diff,order_time,device_type,is_cheat",), ("U1,O1,oops,5,3,PC,1",)], "l string").coalesce(1).write.text(bad)
    row = files.scan_csv(spark, bad).first()
    assert row.amount is None and row.time_diff == 5.0


def test_fallback_order(spark, tx):
    missing = lambda: spark.read.parquet(fresh_dir(spark, "nothing"))
    empty = lambda: tx.where("false")
    assert files.load_first_available([missing, empty, lambda: tx]).count() == 5
    with pytest.raises(ExceptionGroup):
        files.load_first_available([missing, empty])
    with pytest.raises(ZeroDivisionError):  # a mistake in a loader is not a missing source
        files.load_first_available([lambda: 1 / 0, lambda: tx])


def test_views(spark, tx):
    files.register_view(spark, "some_orders", tx)
    assert spark.sql("select count(*) from some_orders").first()[0] == 5
    assert files.drop_view(spark, "some_orders") and not files.drop_view(spark, "some_orders")


def test_empty_bins_are_kept(tx):
    bins = {r.bin: (r.order_count, r.fraud_count) for r in A.amount_bin_fraud_rate(Q.clean(tx)).collect()}
    assert bins == {"0-500": (1, 1), "500-1000": (1, 1), "1000-1500": (1, 0), "1500-2000": (0, 0), "2000-3000": (0, 0)}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.0)], "x double")
    assert [r["count"] for r in A.histogram(df, "x", 4).orderBy("bin_id").collect()] == [1, 0, 1, 2]
    flat = A.histogram(df.where("x = 1"), "x", 2).orderBy("bin_id").collect()
    assert [(r.lower, r["count"]) for r in flat] == [(0.5, 0), (1.0, 2)]
    assert A.histogram(df.where("false"), "x", 4).count() == 0


def test_deciles_drop_one(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.95,), (1.0,)], "anomaly_score double")
    count = lambda d: {r.bin_id: r["count"] for r in d.collect() if r["count"]}
    assert count(A.decile_histogram(df)) == {0: 1, 3: 1, 9: 1}
    assert count(A.decile_histogram(df, closed_right=True)) == {0: 1, 3: 1, 9: 2}


def test_constant_scores(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "order_id string, raw double")
    assert {r.anomaly_score for r in S.minmax_score(df, "raw").collect()} == {0.0}
    assert {r.raw for r in S.standardize(df, ["raw"]).collect()} == {0.0}


def test_boxplot_whiskers(spark):
    df = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4, 100)] + [(1, 5.0)], "c int, v double")
    got = {r.c: (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) for r in A.class_boxplot(df, "v", "c").collect()}
    assert got == {0: (2.0, 3.0, 4.0, 1.0, 4.0, 1), 1: (5.0, 5.0, 5.0, 5.0, 5.0, 0)}


def scored(spark):
    rows = [(f"O{i}", "U", i / 10, 10.0 * i, float(i), i % 24, "iOS" if i < 9 else "PC", 0) for i in range(11)]
    return spark.createDataFrame(
        rows,
        "order_id string, user_id string, anomaly_score double, amount double, time_diff double, order_time int, device_type string, is_cheat int",
    )


def test_top_and_pages(spark):
    top = K.top_risk_orders(scored(spark), 5, 0.8)
    assert [(r["rank"], r.order_id, r.is_high_risk) for r in top.orderBy("rank").collect()] == [
        (1, "O10", 1), (2, "O9", 1), (3, "O8", 1), (4, "O7", 0), (5, "O6", 0)]
    page = K.paginate(top, page=2, page_size=3).orderBy("rank").collect()
    assert [(r["rank"], r.total, r.total_pages) for r in page] == [(4, 5, 2), (5, 5, 2)]
    assert K.paginate(top, page=9, page_size=3).count() == 0
    with pytest.raises(ValueError):
        K.paginate(top, page=0)


def test_risk_reports_without_flagged_rows(spark):
    none = scored(spark).where("anomaly_score < 0.5")
    hours = R.risk_by_hour(none, 0.8).collect()
    assert len(hours) == 24 and {(r["count"], r.rush_hour_ratio) for r in hours} == {(0, 0.0)}
    assert R.peak_rush_hour(none, 0.8).count() == 0 and R.top_device_share(none, 0.8).count() == 0
    assert R.high_risk_profile(none, 0.8).first().high_risk_count == 0


def test_actions(spark):
    overview = lambda ratio: spark.createDataFrame([(ratio,)], "anomaly_ratio double")
    ranked = lambda name: spark.createDataFrame([(1, name, 1.0)], "rank int, feature string, importance double")
    best = lambda f1: spark.createDataFrame([("m", f1)], "best_model string, best_f1 double")
    run = lambda a, b, c: [r.action for r in R.recommended_actions(overview(a), ranked(b), best(c)).orderBy("rank").collect()]
    assert run(0.2, "time_diff", 0.95) == ["urgent_treatment", "tune_gap_rules", "deploy_model", "feedback_loop"]
    assert run(0.05, "is_rush_hour", 0.8) == ["tighten_monitoring", "control_rush_hours", "keep_improving", "feedback_loop"]
    assert run(0.01, "log_amount", 0.1) == ["feedback_loop"]


def test_best_model(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.001), ("b", 0.0, 5.0)], "model string, f1 double, train_time double")
    row = S.best_model(rows).first()
    assert (row.best_model, row.fastest, row.slowest, row.speed_ratio) == (None, "a", "b", 500.0)
    assert S.best_model(rows.withColumn("f1", F.lit(0.5))).first().best_model == "a"


def test_proxy_bounds(spark):
    row = S.proxy_metrics(scored(spark).withColumn("anomaly_score", F.lit(1.0))).first()
    assert (row.precision, row.recall, row.auc) == (0.99, 0.99, 0.99)


def test_shape_of_short_tables(spark):
    row = A.distribution_shape(spark.createDataFrame([(1.0,), (2.0,)], "x double"), ["x"]).first()
    assert row.skewness is None and row.kurtosis is None and row.median == 1.5 and math.isclose(row.std, 0.7071067811865476)


def test_sketched_median_is_within_its_rank_error(spark):
    df = spark.range(20_001).select(F.col("id").cast("double").alias("amount"), F.lit(1.0).alias("time_diff"), F.lit(3).alias("order_time"))
    for accuracy in (100, 10_000, None):
        median = A.descriptive_stats(df, accuracy).first().amount_median
        assert abs(median - 10_000) <= 20_001 / (accuracy or 10**9) + 1


def test_vector_correlation(spark):
    """Equal to numpy; rows with a null entry are left out, constants correlate with nothing, no rows give no matrix."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    x[:, 1] += 1e6 + x[:, 0]
    x[:, 3] = 2.0
    rows = [(row,) for row in x.tolist()] + [([1.0, None, 2.0, 2.0],), (None,)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(7)
    names = list("abcd")
    got = {(r.column_a, r.column_b): r.correlation for r in A.vector_correlation(df, F.col("v"), names).collect()}
    expected = np.corrcoef(x[:, :3], rowvar=False)
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            assert got[a, b] == pytest.approx(expected[i, j], abs=1e-9)
        assert got[a, "d"] is None and got["d", "d"] == 1.0
    assert A.vector_correlation(df.where("false"), F.col("v"), names).collect() == []
    with pytest.raises(ValueError, match="names"):
        A.vector_correlation(df, F.col("v"), ["a"])


def test_flag_metrics_agree_with_label_metrics(spark):
    """Rows without a score are left out; a group without a flagged row has zeros, not nulls."""
    rows = spark.createDataFrame(
        [("a", 0.9, 1), ("a", 0.85, 0), ("a", 0.1, 1), ("a", None, 1), ("b", 0.2, 0), ("b", 0.3, 1)],
        "model string, anomaly_score double, is_cheat int",
    )
    columns = ["model", "positives", "flagged", "true_positives", "precision", "recall", "f1"]
    one, other = (m(rows, 0.8, by=["model"]).select(columns).orderBy("model").collect() for m in (S.flag_metrics, S.label_metrics))
    assert one == other and one[1].f1 == 0.0 and one[0].positives == 2


def test_aucs_of_several_labels_take_one_ranking(spark):
    """Each label's AUC equals that of ``label_metrics``, from one row per distinct score and group."""
    from ordersight.operators import scores as S

    data = [(i % 2, (i * 7 % 13) / 13 if i % 5 else None, i * 11 % 3 % 2 if i % 7 else None, int(i > 40), 0) for i in range(60)]
    rows = spark.createDataFrame(data, "g int, s double, a int, b int, none int")
    got = {r.g: r for r in S.label_aucs(rows, ["a", "b", "none"], "s", ["g"]).collect()}
    for label in ("a", "b", "none"):
        for r in S.label_metrics(rows, score="s", label=label, by=["g"]).collect():
            assert abs(got[r.g][f"{label}_auc"] - r.auc) < 1e-12
    assert len(got) == 2 and got[0].none_auc == 0.5
