"""Chunked ordered operators: exact with a hot key, with ties and with everything in one value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordersight.operators import ordered
from ordersight.operators.ordered import counted_values, exact_quantiles, previous_in_key
from ordersight.operators.scores import label_metrics
from ordersight.sources.tables import gap_seconds, orders_of_events, table


@pytest.fixture(scope="module")
def hot():
    rng = np.random.default_rng(5)
    n = 6000
    users = np.where(rng.random(n) < 0.4, 1, rng.integers(2, 200, n))
    us = rng.integers(0, 4000, n) * 1000
    us[(users == 1) & (rng.random(n) < 0.5)] = 777_000  # half of the hot user's rows at one instant
    return pd.DataFrame({"user_id": users, "us": us, "event_id": rng.permutation(n)})


@pytest.mark.parametrize("per_task", [None, 500, 50])
def test_previous_in_key(spark, hot, per_task):
    got = previous_in_key(spark.createDataFrame(hot), "user_id", "us", "event_id", "before", per_task).toPandas()
    assert len(got) == len(hot)
    got = got.sort_values(["user_id", "us", "event_id"], ignore_index=True)
    expected = got.groupby("user_id")["us"].shift(1)
    pd.testing.assert_series_equal(got["before"].astype(float), expected, check_names=False)


def test_gap_seconds_chunked_equals_plain(spark, small):
    orders = orders_of_events(table(spark, small, "events")).withColumn("user_id", F.least("user_id", F.lit(3)))
    plain, chunked = gap_seconds(orders), gap_seconds(orders, rows_per_task=40)
    assert sorted(map(str, plain.select("event_id", "time_diff").collect())) == sorted(
        map(str, chunked.select("event_id", "time_diff").collect())
    )


@pytest.mark.parametrize("per_task", [None, 100, 7])
def test_counted_values(spark, per_task):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000), "v": np.round(rng.exponential(2, 2000), 1)})
    pdf.loc[::3, "v"] = 1.5  # a third of all rows share one value
    got = counted_values(spark.createDataFrame(pdf), "v", ["g"], {"odd": F.count_if(F.col("g") == 1)}, per_task).toPandas()
    for (g, v), row in got.set_index(["g", "value"]).iterrows():
        group = pdf[pdf.g == g].v
        assert (row["n"], row["n_before"], row["n_total"]) == ((group == v).sum(), (group < v).sum(), len(group))
        assert row["odd"] == (row["n"] if g == 1 else 0)
        assert row["odd_before"] == (row["n_before"] if g == 1 else 0)


@pytest.mark.parametrize("per_task", [None, 64])
def test_quantiles_match_numpy(spark, per_task):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"c": rng.integers(0, 2, 1001), "a": rng.lognormal(3, 1, 1001).round(2), "b": rng.normal(size=1001)})
    got = exact_quantiles(spark.createDataFrame(pdf), ["a", "b"], {"q1": 0.25, "q2": 0.5, "q9": 0.9}, ["c"], per_task).collect()
    assert len(got) == 4
    for r in got:
        x = pdf[pdf.c == r.c][r.column]
        np.testing.assert_allclose([r.q1, r.q2, r.q9], np.quantile(x, [0.25, 0.5, 0.9]), rtol=1e-12)


def test_quantiles_of_nothing_and_of_one(spark):
    one = spark.createDataFrame([(4.0,), (None,)], "a double")
    assert [tuple(r) for r in exact_quantiles(one, ["a"], {"m": 0.5}).collect()] == [("a", 4.0)]
    assert exact_quantiles(one.where("false"), ["a"], {"m": 0.5}).collect() == []


def pair_auc(score, label):
    p, q = score[label == 1], score[label == 0]
    return ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))


def test_auc_with_ties(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"anomaly_score": rng.random(500).round(1), "is_cheat": rng.integers(0, 2, 500)})
    row = label_metrics(spark.createDataFrame(pdf), 0.8).first()
    assert row.auc == pytest.approx(pair_auc(pdf.anomaly_score.to_numpy(), pdf.is_cheat.to_numpy()), abs=1e-12)
    hit = pdf.anomaly_score >= 0.8
    assert row.precision == pytest.approx(pdf.is_cheat[hit].mean())
    assert row.recall == pytest.approx(hit[pdf.is_cheat == 1].mean())


def test_auc_of_one_class_is_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 0)], "anomaly_score double, is_cheat int")
    row = label_metrics(df).first()
    assert (row.auc, row.precision, row.recall, row.f1) == (0.5, 0.0, 0.0, 0.0)



def test_null_group_keeps_its_rows_in_chunks(spark):
    from ordersight.operators.ordered import counted_values

    df = spark.createDataFrame([(g, float(i)) for i in range(60) for g in ("a", None)], "g string, v double")
    whole, cut_up = (counted_values(df, "v", by=["g"], rows_per_task=n).collect() for n in (None, 20))
    assert len(cut_up) == 120 and {tuple(sorted(r.asDict().items())) for r in cut_up if r["g"]} == {
        tuple(sorted(r.asDict().items())) for r in whole if r["g"]
    }
    assert sorted(r["n_before"] for r in cut_up if r["g"] is None) == list(range(60))


def test_previous_in_key_cuts_a_large_null_key(spark):
    rows = [(None if i % 4 else i % 8, (i * 7) % 90, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t int, i int")
    result = ordered.previous_in_key(df, "k", "t", "i", "before", rows_per_task=50)
    expected, last = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        expected[i], last[k] = last.get(k), t
    assert {r["i"]: r["before"] for r in result.collect()} == expected
    parts = ordered.ranged(df, ["k", "t", "i"], 50).groupBy("_part").agg(F.count_if(F.col("k").isNull()).alias("nulls"))
    sizes = [r.nulls for r in parts.collect() if r.nulls]
    assert sum(sizes) == 300 and len(sizes) >= 5 and max(sizes) <= 100


def test_previous_in_key_of_no_rows_and_of_null_times(spark):
    layout = "k int, t int, i int"
    assert ordered.previous_in_key(spark.createDataFrame([], layout), "k", "t", "i", "before").collect() == []
    rows = [(1, None, 1), (1, None, 2), (1, 5, 3), (2, 7, 4), (2, 9, 5)]
    for per_task in (None, 1, 2):
        got = ordered.previous_in_key(spark.createDataFrame(rows, layout), "k", "t", "i", "before", per_task).collect()
        assert {r.i: r.before for r in got} == {1: None, 2: None, 3: None, 4: None, 5: 7}


@pytest.mark.parametrize("n", [999, 1000, 1001, 40_000])
def test_quantiles_by_brackets(spark, n):
    """Brackets narrower than the data, heavy ties, a null group, a constant group and clashing names."""
    rng = np.random.default_rng(n)
    frame = pd.DataFrame({"v": np.round(rng.normal(size=n), 2), "n": rng.random(n), "p": np.where(np.arange(n) % 3 == 0, "a", None)})
    frame.loc[frame.p == "a", "n"] = 5.0
    wanted = {"lo": 0.0, "q1": 0.25, "most": 0.999, "hi": 1.0}
    got = exact_quantiles(spark.createDataFrame(frame).replace(float("nan"), None), ["v", "n"], wanted, ["p"]).collect()
    assert len(got) == 4
    for row in got:
        own = frame[frame.p == "a"] if row.p == "a" else frame[frame.p.isna()]
        np.testing.assert_allclose([row[k] for k in wanted], np.quantile(own[row.column], list(wanted.values())), rtol=1e-12)


def test_quantiles_widen_a_bracket_that_misses(spark, monkeypatch):
    """A bracket beside its rank is found out and widened; the result stays exact."""
    tried = []

    def beside(values, keys, probabilities, slack, real=ordered._brackets):
        tried.append(slack)
        found = real(values, keys, probabilities, slack)
        return found if slack >= 1 else found.withColumn("low", F.col("high"))

    monkeypatch.setattr(ordered, "_brackets", beside)
    frame = spark.range(5000).select(F.col("id").cast("double").alias("v"))
    assert exact_quantiles(frame, ["v"], {"m": 0.5}).first().m == 2499.5
    assert len(tried) > 1
