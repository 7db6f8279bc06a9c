"""Augmented Dickey-Fuller test and partial autocorrelation, one group per daily series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.operators.series import acf, first_difference
from ordersight.session import in_groups

# MacKinnon (1994) approximate p-value surface, constant, one variable.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
# MacKinnon (2010) critical value surface in powers of 1/n.
CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}
ADF_SCHEMA = (
    "series_key string, adf_statistic double, p_value double, used_lag int, n_observations int, "
    "crit_1 double, crit_5 double, crit_10 double"
)


def p_value(statistic: float) -> float:
    if statistic > TAU_MAX:
        return 1.0
    if statistic < TAU_MIN:
        return 0.0
    surface = SMALL_P if statistic <= TAU_STAR else LARGE_P
    z = sum(c * statistic**i for i, c in enumerate(surface))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _regression(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Response and regressors (constant, level, lagged differences) of the test equation."""
    d = np.diff(x)
    n = len(d) - lags
    columns = [np.ones(n), x[lags:-1], *[d[lags - j : len(d) - j] for j in range(1, lags + 1)]]
    return d[lags:], np.column_stack(columns)


def adf_statistic(x: np.ndarray) -> tuple[float, int, int] | None:
    """Statistic, AIC-chosen lag and observations; None for a constant or too short series."""
    most = min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2)
    if most < 0 or np.ptp(x) == 0:
        return None
    y, full = _regression(x, most)
    best = None
    for lags in range(most + 1):
        part = full[:, : lags + 2]
        rest = y - part @ np.linalg.lstsq(part, y, rcond=None)[0]
        aic = len(y) * math.log(max(rest @ rest, 1e-300) / len(y)) + 2 * (lags + 2)
        if best is None or aic < best[0]:
            best = (aic, lags)
    lags = best[1]
    y, design = _regression(x, lags)
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    rest = y - design @ beta
    free = len(y) - design.shape[1]
    if free <= 0:
        return None
    covariance = (rest @ rest / free) * np.linalg.pinv(design.T @ design)
    if covariance[1, 1] <= 0:
        return None
    return float(beta[1] / math.sqrt(covariance[1, 1])), lags, len(y)


def _adf_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    found = adf_statistic(rows.sort_values("date")["x"].to_numpy(float))
    if found is None:
        values = [key[0], None, None, None, None, None, None, None]
    else:
        statistic, lags, n = found
        bounds = [round(sum(c / n**i for i, c in enumerate(row)), 4) for row in CRITICAL.values()]
        values = [key[0], round(statistic, 4), round(p_value(statistic), 4), lags, n, *bounds]
    return pd.DataFrame([values], columns=["series_key", "adf_statistic", "p_value", "used_lag", "n_observations", *CRITICAL])


def adf_test(series: DataFrame, value: str = "daily_amount") -> DataFrame:
    """Unit-root test of every series, on its levels and on its first differences."""

    def run(frame: DataFrame, form: str) -> DataFrame:
        tested = in_groups(frame.where("x is not null"), "series_key").groupBy("series_key").applyInPandas(_adf_group, ADF_SCHEMA)
        return tested.withColumn("form", F.lit(form)).withColumn(
            "is_stationary", (F.col("p_value") < 0.05).cast("int")
        )

    levels = series.select("series_key", "date", F.col(value).cast("double").alias("x"))
    steps = first_difference(series, value).select("series_key", "date", F.col("difference").cast("double").alias("x"))
    return run(levels, "level").unionByName(run(steps, "difference"))


def _pacf_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Durbin-Levinson recursion over at most 21 autocorrelations."""
    rows = rows.sort_values("lag")
    n = int(rows["n"].iloc[0])
    lags = rows["lag"].to_numpy()
    r = rows["acf"].to_numpy(float) * n / (n - lags)
    out = np.full(len(r), np.nan)
    out[0] = 1.0
    phi = np.zeros(0)
    for k in range(1, len(r)):
        last = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1 - phi @ r[1:k])
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return rows[["series_key", "lag", "conf_bound"]].assign(pacf=out)


def pacf(series: DataFrame, value: str = "daily_amount") -> DataFrame:
    """Partial autocorrelation (adjusted Yule-Walker) over the lags of ``acf``."""
    return (
        acf(series, value)
        .where("acf is not null")
        .groupBy("series_key")
        .applyInPandas(_pacf_group, "series_key string, lag int, conf_bound double, pacf double")
    )
