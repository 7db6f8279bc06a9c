import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordersight.operators.series import daily_rollup
from ordersight.models import arima, statespace, unit_root
from ordersight.operators import series as T


def frame(spark, series: dict):
    rows = []
    for key, x in series.items():
        for i, v in enumerate(x):
            value = None if v is None or np.isnan(v) else float(v)
            rows.append((key, dt.date(2024, 1, 1) + dt.timedelta(days=i), value, 1.0, 1.0, 0.0))
    return spark.createDataFrame(
        rows, "series_key string, date date, daily_amount double, daily_count double, avg_price double, rush_ratio double"
    )


def arma(n, phi, theta, seed):
    e = np.random.default_rng(seed).normal(size=n + 50)
    x = np.zeros(n + 50)
    for t in range(1, n + 50):
        x[t] = phi * x[t - 1] + e[t] + theta * e[t - 1]
    return x[50:]


@pytest.fixture(scope="module")
def simulated(spark):
    weekly = np.tile([0, 5, 9, 4, 8, 20, 30], 60) + np.cumsum(arma(420, 0.4, 0.3, 3))
    return frame(
        spark,
        {
            "noise": arma(600, 0, 0, 1),
            "walk": np.cumsum(arma(600, 0, 0, 2)),
            "ar": arma(1500, 0.7, 0, 4),
            "weekly": weekly,
        },
    )


def test_adf(simulated):
    got = {(r.series_key, r.form): r for r in unit_root.adf_test(simulated).collect()}
    assert got["noise", "level"].is_stationary == 1 and got["ar", "level"].is_stationary == 1
    assert got["walk", "level"].is_stationary == 0 and got["walk", "difference"].is_stationary == 1
    assert got["walk", "level"].crit_5 == pytest.approx(-2.866, abs=0.01)
    needs = {r.series_key: r.needs_differencing for r in T.differencing_needed(unit_root.adf_test(simulated)).collect()}
    assert needs["walk"] == 1 and needs["noise"] == 0


@pytest.mark.parametrize("statistic, p", [(-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)])
def test_p_values_at_critical_values(statistic, p):
    assert unit_root.p_value(statistic) == pytest.approx(p, abs=0.003)


def test_statistic_without_lags(simulated):
    """Where the lag search settles on no lags, both forms of the test agree."""
    plain = {r.series_key: r.statistic for r in T.dickey_fuller(simulated).collect()}
    levels = [r for r in unit_root.adf_test(simulated).collect() if r.form == "level" and r.used_lag == 0]
    assert levels
    for row in levels:
        assert row.adf_statistic == pytest.approx(plain[row.series_key], abs=1e-4)


def test_constant_series_has_no_statistic(spark):
    rows = unit_root.adf_test(frame(spark, {"flat": [5.0] * 50})).collect()
    assert all(r.adf_statistic is None for r in rows)


def test_acf_and_pacf(simulated):
    a = {(r.series_key, r.lag): r for r in T.acf(simulated).collect()}
    p = {(r.series_key, r.lag): r.pacf for r in unit_root.pacf(simulated).collect()}
    assert a["ar", 0].acf == pytest.approx(1.0)
    assert a["ar", 1].acf == pytest.approx(0.7, abs=0.06) and a["ar", 2].acf == pytest.approx(0.49, abs=0.08)
    n = a["ar", 1].n
    assert p["ar", 1] == pytest.approx(a["ar", 1].acf * n / (n - 1))
    assert abs(p["ar", 2]) < 0.06 and abs(p["ar", 3]) < 0.06
    assert a["noise", 5].significant == 0 and max(k[1] for k in a) == 20


def test_acf_lags_follow_the_length(spark):
    short = T.acf(frame(spark, {"s": [1.0, 3.0, 2.0, 5.0, 4.0, 6.0, 1.0, 2.0]})).collect()
    assert sorted(r.lag for r in short) == [0, 1, 2, 3]


def test_arima_recovers_parameters(spark):
    """Estimates scatter by about 0.03 per series, so several series are averaged."""
    many = frame(spark, {f"s{i}": 100 + np.cumsum(arma(1500, 0.6, 0.3, i)) for i in range(5, 13)})
    fits = arima.fit_report(arima.model_series(many)).collect()
    assert np.mean([r.params for r in fits], axis=0) == pytest.approx([0.6, 0.3], abs=0.04)
    assert np.mean([r.sigma2 for r in fits]) == pytest.approx(1.0, abs=0.05)
    assert all(r.bic > r.aic for r in fits)


def test_least_squares_is_not_beaten_by_a_grid():
    shape = arima.Shape((1, 1, 1), (0, 0, 0, 0))
    w = arma(600, 0.6, 0.3, 5)
    _, e = arima.minimise(w, shape, arima.start_values(w, shape))
    grid = [(innovations_of(w, shape, a, b) ** 2).sum() for a in np.arange(-0.9, 0.95, 0.1) for b in np.arange(-0.9, 0.95, 0.1)]
    assert e @ e <= min(grid)


def innovations_of(w, shape, ar, ma):
    return arima.innovations(w, shape, np.array([ar, ma]))


def test_sarima_beats_plain_on_weekly(simulated):
    weekly = simulated.where("series_key = 'weekly'")
    fitted = [
        arima.fitted_values(m(weekly)).withColumn("model", F.lit(n))
        for n, m in (("arima", arima.model_series), ("sarima", arima.sarima_series))
    ]
    accuracy = T.forecast_accuracy(fitted[0].unionByName(fitted[1]), ["series_key", "model"], predicted="fitted")
    chosen = T.model_selection(accuracy).first()
    assert (chosen.better_r2, chosen.lower_mape) == ("sarima", "sarima") and chosen.seasonal_r2 > 0.9


@pytest.mark.parametrize("model", [arima.model_series, arima.sarima_series])
def test_forecasts(simulated, model):
    rows = arima.forecasts(model(simulated.where("series_key = 'weekly'"), steps=14)).orderBy("date").collect()
    assert len(rows) == 14 and rows[0].date == dt.date(2024, 1, 1) + dt.timedelta(days=420)
    widths = [r.upper - r.lower for r in rows]
    assert all(r.lower < r.forecast < r.upper for r in rows) and all(b >= a - 1e-9 for a, b in zip(widths, widths[1:]))


def test_random_walk_forecast_is_flat_and_widens_like_sqrt(spark):
    walk = frame(spark, {"w": np.cumsum(arma(800, 0, 0, 8))})
    rows = arima.forecasts(arima.model_series(walk, order=(0, 1, 0), steps=9)).orderBy("date").collect()
    half = [r.upper - r.forecast for r in rows]
    assert len({round(r.forecast, 9) for r in rows}) == 1 and half[8] == pytest.approx(3 * half[0])


def test_short_and_constant_series_stay_in_the_result(spark):
    got = arima.model_series(frame(spark, {"short": [1.0, 2.0, 3.0], "flat": [2.0] * 40}), steps=2)
    report = {r.series_key: r.aic for r in arima.fit_report(got).collect()}
    assert report == {"short": None, "flat": None} and arima.forecasts(got).count() == 4


def test_steps_are_bounded(simulated):
    with pytest.raises(ValueError):
        arima.model_series(simulated, steps=31)


def test_undo_average_matches_recursion():
    rng = np.random.default_rng(0)
    u = rng.normal(size=200)
    for c, stride in (([0.6], 1), ([-0.8], 7), ([0.3, 0.2], 1), ([0.4, -0.1], 7)):
        e = u.copy()
        for t in range(len(u)):
            e[t] = u[t] - sum(ci * e[t - (i + 1) * stride] for i, ci in enumerate(c) if t >= (i + 1) * stride)
        np.testing.assert_allclose(arima.undo_average(u, np.array(c), stride), e, atol=1e-12)


def test_interpolation_matches_pandas(spark):
    x = [None, None, 3.0, None, None, 9.0, 1.0, None, 4.0, None]
    got = T.interpolate_gaps(frame(spark, {"s": [np.nan if v is None else v for v in x]})).orderBy("date")
    expected = pd.Series(x, dtype=float).interpolate().bfill().ffill()
    assert [r.daily_amount for r in got.collect()] == pytest.approx(expected.tolist())


def test_clipping(spark):
    x = [10.0] * 30 + [1000.0]
    cleaned = T.series_clean(frame(spark, {"s": x}))
    mean, std = np.mean(x), np.std(x, ddof=1)
    assert cleaned.agg(F.max("daily_amount")).first()[0] == pytest.approx(mean + 3 * std)
    assert T.clean_report(cleaned).first().asDict() == {
        "series_key": "s", "length": 31, "missing_before": 0, "missing_after": 0, "outliers_clipped": 1}


def test_accuracy_formulae(spark):
    df = spark.createDataFrame([("s", 0.5, 1.0), ("s", 4.0, 2.0), ("s", 10.0, None)], "k string, actual double, predicted double")
    r = T.forecast_accuracy(df, ["k"]).first()
    assert (r.n, r.mae, r.mse, r.rmse, r.mape) == (2, 1.25, 2.13, 1.46, 50.0)
    assert r.r2 == pytest.approx(1 - 4.25 / 6.125, abs=1e-4)


def test_null_series_key_keeps_its_values(spark):
    rows = [(None, "2024-01-01", 7.0), (None, "2024-01-03", 9.0), ("a", "2024-01-01", 1.0)]
    frame = spark.createDataFrame(rows, "k string, t string, a double").withColumn("t", F.col("t").cast("timestamp"))
    got = daily_rollup(frame, F.col("k"), F.col("t"), F.col("a")).collect()
    assert sorted((r.series_key or "", str(r.date), r.daily_amount) for r in got) == [
        ("", "2024-01-01", 7.0), ("", "2024-01-02", 0.0), ("", "2024-01-03", 9.0), ("a", "2024-01-01", 1.0),
    ]


def dense_errors(w, ar, ma, start):
    """Standardised errors and log variances from the full covariance matrix."""
    step, load = statespace.matrices(ar, ma)
    n = len(w)
    spreads, c = [start], np.zeros((n, n))
    for _ in range(n):
        spreads.append(step @ spreads[-1] @ step.T + np.outer(load, load))
    for s in range(n):
        m = spreads[s].copy()
        for t in range(s, n):
            c[s, t] = c[t, s] = m[0, 0]
            m = step @ m
    root = np.linalg.cholesky(c)
    return np.linalg.solve(root, w), 2 * np.log(np.diag(root))


@pytest.mark.parametrize("params, diffuse", [
    ((0.6, 0.3, 0.2, -0.5), False), ((0.6, 0.3, 0.2, -0.5), True), ((1.05, 0.3, 0.4, -0.6), True), ((0.5, 1.6, 0.1, 0.3), True),
])
def test_filter_equals_the_dense_likelihood(params, diffuse):
    """Also outside the stationary and the invertible region."""
    w = arma(60, 0.6, 0.3, 1)
    ar, ma = arima.Shape((1, 0, 1), (1, 0, 1, 4)).polynomials(np.array(params))
    step, load = statespace.matrices(ar, ma)
    start = np.eye(len(load)) * statespace.DIFFUSE if diffuse else statespace.stationary_spread(step, load)
    other = (ar * 0.5 + np.eye(len(ar))[0] * 0.5, ma)
    got = statespace.kalman_filter(w, [(ar, ma), other], diffuse)
    errors, logs = dense_errors(w, ar, ma, start)
    np.testing.assert_allclose(got.errors[0] / np.sqrt(got.variances[0]), errors, atol=1e-5)
    np.testing.assert_allclose(np.log(got.variances[0]), logs, atol=1e-5)


def test_exact_likelihood_is_not_beaten_by_a_grid():
    shape = arima.Shape((1, 0, 1), (0, 0, 0, 0))
    w = arma(300, 0.6, 0.3, 5)
    fit = lambda x: statespace.log_likelihood(statespace.kalman_filter(w, [shape.polynomials(np.array(x))], False))[0]
    found = arima.maximise(w, shape, arima.minimise(w, shape, np.zeros(2))[0], True)
    assert fit(found) >= max(fit((a, b)) for a in np.arange(-0.9, 0.95, 0.1) for b in np.arange(-0.9, 0.95, 0.1))


def test_unforced_fit_leaves_the_stationary_region(spark):
    """A growing series needs a root inside the unit circle; forced fits stop at the border."""
    e, x = np.random.default_rng(3).normal(size=300), np.zeros(300)
    for t in range(1, 300):
        x[t] = 1.02 * x[t - 1] + e[t]
    rows = frame(spark, {"grows": x})
    free, forced = (
        arima.fit_report(arima.model_series(rows, order=(1, 0, 0), enforce=enforce)).first().params[0] for enforce in (False, True)
    )
    assert free == pytest.approx(1.02, abs=0.002) and forced < 1
    ahead = arima.forecasts(arima.model_series(rows, order=(1, 0, 0), enforce=False)).orderBy("date").collect()
    assert all(b.upper - b.lower > 1.01 * (a.upper - a.lower) for a, b in zip(ahead, ahead[1:]))


def test_forecast_interval_matches_simulation():
    """Spread of simulated futures of an integrated seasonal process."""
    shape = arima.Shape((1, 1, 1), (0, 1, 1, 4))
    differencing = shape.differencing()
    ar, ma = shape.polynomials(np.array([0.5, 0.2, -0.4]))
    rng, steps = np.random.default_rng(0), 8
    y = np.cumsum(rng.normal(size=80))
    w = np.convolve(y, differencing)[len(differencing) - 1 : len(y)]
    found = statespace.kalman_filter(w, [(ar, ma)], True)
    mean, deviation = statespace.prediction(y, found, ar, ma, differencing, 1.0, steps)
    step, load = statespace.matrices(ar, ma)
    state = rng.multivariate_normal(found.state[0], found.spread[0], size=20_000)
    paths = np.repeat(y[None], len(state), axis=0)
    for _ in range(steps):
        back = sum(differencing[i] * paths[:, -i] for i in range(1, len(differencing)))
        paths = np.hstack([paths, (state[:, 0] - back)[:, None]])
        state = state @ step.T + rng.normal(size=(len(state), 1)) * load
    np.testing.assert_allclose(paths[:, -steps:].mean(axis=0), mean, atol=0.05 * deviation.max())
    np.testing.assert_allclose(paths[:, -steps:].std(axis=0), deviation, rtol=0.03)
