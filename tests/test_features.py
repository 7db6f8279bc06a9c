import pytest
from pyspark.sql import functions as F

from ordersight.functions import features as C


def values(spark, rows, kind, column):
    df = spark.createDataFrame([(v,) for v in rows], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "rows, kind, column, expected",
    [
        ([0, 1, 6, 7, 23], "int", C.is_rush_hour, [0, 1, 1, 0, 0]),
        ([0, 5, 6, 11, 12, 17, 18, 23, 24], "int", C.hour_bin, ["00-06"] * 2 + ["06-12"] * 2 + ["12-18"] * 2 + ["18-24"] * 2 + [None]),
        ([0.0, 49.99, 500.0, 500.01, 1000.0, 3000.0, 3000.01, None], "double", C.amount_bin,
         [None, "0-500", "0-500", "500-1000", "500-1000", "2000-3000", None, None]),
        ([0.0, 49.99, 50.0, 200.0, 500.0, 999.99, 1000.0, None], "double", C.amount_band,
         ["<50", "<50", "50-200", "200-500", "500-1000", "500-1000", ">=1000", None]),
        ([0.0, 0.2, 0.4, 0.6, 0.8, 1.0], "double", C.score_bucket,
         ["0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0", "0.8-1.0"]),
        ([0.0, 0.6, 0.8, 0.9, 1.0], "double", C.risk_level, ["low", "medium", "high", "extreme", "extreme"]),
        ([0.15, 0.08, 0.03, 0.02], "double", C.anomaly_rate_level, ["elevated", "medium", "low", "minimal"]),
        ([0.0, 3599.9, 3600.0, 86399.0, 86400.0, 90000.5], "double", C.hour_from_seconds, [0, 0, 1, 23, 0, 1]),
        (["iOS", "Android", "PC", "H5", "Other", None], "string", C.device_code, [0, 1, 2, 3, 1, 1]),
    ],
)
def test_edges(spark, rows, kind, column, expected):
    assert values(spark, rows, kind, column) == expected


def test_unknown_device_default(spark):
    assert values(spark, ["Other", None], "string", lambda c: C.device_code(c, 3)) == [3, 3]


def test_ids_are_padded_and_never_cut(spark):
    assert values(spark, [7, 123456789012], "long", lambda c: C.padded_id("O", c, 8)) == ["O00000007", "O123456789012"]


def test_rule_score_branches(spark):
    rows = [(19.99, 4.99, 3), (20.0, 5.0, 12), (19.99, 5.0, 12), (20.0, 4.99, 1), (20.0, None, 6)]
    df = C.with_rule_score(spark.createDataFrame(rows, "amount double, time_diff double, order_time int"))
    got = [(round(r.anomaly_score, 6), r.is_anomaly) for r in df.collect()]
    assert got == [(1.0, 1), (0.2, 0), (0.5, 0), (0.7, 1), (0.4, 0)]
