"""ARIMA and seasonal ARIMA of many daily series, one group per series.

Spark shuffles each series into one group of at most one row per calendar day; the group function
differences the series, starts from a Hannan-Rissanen regression, refines the conditional sum of
squares by Levenberg-Marquardt steps that keep both polynomials inside the admissible region, and then
maximises the exact likelihood of a Kalman filter from there. Plain models stay stationary and invertible;
seasonal ones start diffuse and may leave that region.
"""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.models.statespace import kalman_filter, log_likelihood, prediction, scaled_errors
from ordersight.session import in_groups

Z95 = 1.959963984540054
PLAIN = (1, 1, 1)
SEASONAL = (1, 1, 1, 7)
# dampings of a least-squares round: a sum of squares is cheap, a filter costs the same for one set or many
ONE_BY_ONE = [(4.0**i,) for i in range(12)]
AT_ONCE = [(0.2, 1.0, 5.0, 50.0, 1e3, 1e5)]
LIKELIHOOD_GAIN = 1e-2  # a round that adds less than half of this to the log-likelihood is the last
SCHEMA = (
    "series_key string, date date, actual double, fitted double, residual double, forecast double, "
    "lower double, upper double, params array<double>, sigma2 double, aic double, bic double, "
    "n_effective int, train_time double"
)


def lag_polynomial(plain: np.ndarray, seasonal: np.ndarray, period: int, sign: float) -> np.ndarray:
    """Coefficients of (1 + sign a1 B + ...)(1 + sign s1 B^period + ...)."""
    outer = np.zeros(len(seasonal) * period + 1)
    outer[0] = 1.0
    if len(seasonal):
        outer[period::period] = sign * seasonal
    return np.convolve(np.concatenate([[1.0], sign * plain]), outer)


def outside_unit_circle(poly: np.ndarray) -> bool:
    """All roots of the lag polynomial strictly outside the unit circle."""
    trimmed = np.trim_zeros(poly, "b")
    return len(trimmed) < 2 or bool(np.all(np.abs(np.roots(trimmed)) < 0.9999))


class Shape:
    """Orders of one model and the split of its parameter vector."""

    def __init__(self, order: tuple, seasonal: tuple):
        self.p, self.d, self.q = order
        self.P, self.D, self.Q, self.s = seasonal
        self.size = self.p + self.q + self.P + self.Q

    def split(self, params: np.ndarray) -> list[np.ndarray]:
        """Plain AR, plain MA, seasonal AR and seasonal MA coefficients."""
        return np.split(params, np.cumsum([self.p, self.q, self.P]))

    def polynomials(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ar, ma, sar, sma = self.split(params)
        return lag_polynomial(ar, sar, self.s or 1, -1.0), lag_polynomial(ma, sma, self.s or 1, 1.0)

    def differencing(self) -> np.ndarray:
        poly = np.ones(1)
        for _ in range(self.d):
            poly = np.convolve(poly, [1.0, -1.0])
        for _ in range(self.D):
            poly = np.convolve(poly, np.concatenate([[1.0], np.zeros(self.s - 1), [-1.0]]))
        return poly


def undo_average(u: np.ndarray, coefficients: np.ndarray, stride: int) -> np.ndarray:
    """Solve e_t = u_t - sum c_j e_(t - j stride) for a zero past."""
    e = u.copy()
    if len(coefficients) == 1:  # e_t = sum (-c)^j u_(t - j stride), summed by doubling
        factor, shift = -coefficients[0], stride
        while shift < len(e) and factor != 0.0:
            e[shift:] = e[shift:] + factor * e[:-shift]
            factor, shift = factor * factor, 2 * shift
        return e
    for t in range(stride, len(e)):
        back = e[t - stride :: -stride][: len(coefficients)]
        e[t] -= coefficients[: len(back)] @ back
    return e


def innovations(w: np.ndarray, shape: Shape, params: np.ndarray) -> np.ndarray:
    """One-step errors of ``w`` given the values its autoregression needs."""
    ar, _ = shape.polynomials(params)
    _, ma, _, sma = shape.split(params)
    u = np.convolve(w, ar)[len(ar) - 1 : len(w)]
    for coefficients, stride in ((sma, shape.s), (ma, 1)):
        if len(coefficients):
            u = undo_average(u, coefficients, stride)
    return u


def start_values(w: np.ndarray, shape: Shape) -> np.ndarray:
    """Hannan-Rissanen: residuals of a long autoregression as regressors for the moving average."""
    span = max(shape.p, shape.q, shape.s * max(shape.P, shape.Q))
    long = min(span + 10, len(w) // 4)
    if not shape.size or long < 1 or len(w) < 3 * (long + span):
        return np.zeros(shape.size)
    design = np.column_stack([w[long - j : len(w) - j] for j in range(1, long + 1)])
    e = np.concatenate([np.zeros(long), w[long:] - design @ np.linalg.lstsq(design, w[long:], rcond=None)[0]])
    first = long + span
    lagged = lambda x, j: x[first - j : len(x) - j]
    columns = (
        [lagged(w, j) for j in range(1, shape.p + 1)]
        + [lagged(e, j) for j in range(1, shape.q + 1)]
        + [lagged(w, j * shape.s) for j in range(1, shape.P + 1)]
        + [lagged(e, j * shape.s) for j in range(1, shape.Q + 1)]
    )
    return np.linalg.lstsq(np.column_stack(columns), w[first:], rcond=None)[0]


def least_squares(errors, params: np.ndarray, rounds: int, least_gain: float, ladder: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Levenberg-Marquardt, until a round gains less than ``least_gain`` of the sum of squares.

    ``errors`` maps several parameter vectors to their error vectors, or to None where it refuses them. The dampings
    of one entry of ``ladder`` are tried together, the next entry only where none of them helps.
    """
    e = errors([params])[0]
    damping = 1e-2
    for _ in range(rounds if len(params) else 0):
        # probes go towards zero, so they stay admissible
        steps = np.where(params < 0, 1e-6, -1e-6)
        probes = errors([params + step * unit for step, unit in zip(steps, np.eye(len(params)))])
        if any(moved is None for moved in probes):
            break
        jacobian = np.column_stack([(moved - e) / step for moved, step in zip(probes, steps)])
        normal, slope = jacobian.T @ jacobian, jacobian.T @ e
        gain = 0.0
        scale = np.diag(np.diag(normal) + 1e-12)
        for factors in ladder:
            moves = [np.linalg.lstsq(normal + damping * f * scale, -slope, rcond=None)[0] for f in factors]
            tried = errors([params + m for m in moves])
            totals = [np.inf if t is None else t @ t for t in tried]
            best = int(np.argmin(totals))
            if totals[best] < e @ e:
                gain = 1 - totals[best] / (e @ e)
                params, e, damping = params + moves[best], tried[best], damping * factors[best] / 5
                break
        else:
            damping *= 4 ** len(ladder)
        if gain < least_gain:
            break
    return params, e


def minimise(w: np.ndarray, shape: Shape, params: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Smallest conditional sum of squares; steps leaving the admissible region are refused."""

    def errors(several: list[np.ndarray]) -> list[np.ndarray | None]:
        return [innovations(w, shape, x) if admissible(shape, x) else None for x in several]

    start = params if admissible(shape, params) else np.zeros(shape.size)
    return least_squares(errors, start, rounds, 1e-10, ONE_BY_ONE)


def admissible(shape: Shape, params: np.ndarray) -> bool:
    return all(outside_unit_circle(p) for p in shape.polynomials(params))


def maximise(w: np.ndarray, shape: Shape, params: np.ndarray, enforce: bool, rounds: int = 15) -> np.ndarray:
    """Parameters of the largest exact likelihood near ``params``; ``enforce`` keeps them admissible."""

    def errors(several: list[np.ndarray]) -> list[np.ndarray | None]:
        allowed = [not enforce or admissible(shape, x) for x in several]
        if not any(allowed):
            return [None] * len(several)
        tried = [x for x, fine in zip(several, allowed) if fine]
        with np.errstate(over="ignore", invalid="ignore"):
            found = iter(scaled_errors(kalman_filter(w, [shape.polynomials(x) for x in tried], diffuse=not enforce)))
        vectors = [next(found) if fine else None for fine in allowed]
        return [e if e is not None and np.isfinite(e).all() else None for e in vectors]

    if not shape.size or errors([params])[0] is None:
        return params
    return least_squares(errors, params, rounds, LIKELIHOOD_GAIN / len(w), AT_ONCE)[0]


def group_function(shape: Shape, steps: int, enforce: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        started = time.perf_counter()
        rows = rows.sort_values("date")
        y = rows["x"].to_numpy(float)
        n = len(y)
        out = pd.DataFrame({"series_key": key[0], "date": rows["date"].to_numpy(), "actual": y})
        ends = dict.fromkeys(["sigma2", "aic", "bic", "n_effective", "train_time"])
        params, fitted, ahead = None, np.full(n, np.nan), np.full((3, steps), np.nan)
        differencing = shape.differencing()
        w = np.convolve(y, differencing)[len(differencing) - 1 : n] if n >= len(differencing) else np.zeros(0)
        mean = w.mean() if len(w) and len(differencing) == 1 else 0.0
        order = max(shape.p + shape.P * shape.s, 0 if enforce else shape.q + shape.Q * shape.s + 1)
        if len(w) - order >= 3 * (shape.size + 1) and np.ptp(w) > 0:
            w = w - mean
            found, _ = minimise(w, shape, start_values(w, shape))
            found = maximise(w, shape, found, enforce)
            ar, ma = shape.polynomials(found)
            filtered = kalman_filter(w, [(ar, ma)], diffuse=not enforce)
            loglik, sigma2 = log_likelihood(filtered)
            e = filtered.errors[0, filtered.burn :]
            count = len(e)
            free = shape.size + 1 + (len(differencing) == 1)
            fitted[n - count :] = y[n - count :] - e
            centre, deviation = prediction(y - mean, filtered, ar, ma, differencing, sigma2, steps)
            half = Z95 * deviation
            ahead = np.vstack([centre + mean, centre + mean - half, centre + mean + half])
            params = [float(v) for v in found]
            ends = {
                "sigma2": sigma2,
                "aic": 2 * free - 2 * loglik,
                "bic": free * math.log(count) - 2 * loglik,
                "n_effective": count,
                "train_time": round(time.perf_counter() - started, 4),
            }
        out["fitted"], out["residual"] = fitted, y - fitted
        last = pd.Timestamp(rows["date"].iloc[-1])
        days = [(last + pd.Timedelta(days=h)).date() for h in range(1, steps + 1)]
        future = pd.DataFrame({"series_key": key[0], "date": days, "forecast": ahead[0], "lower": ahead[1], "upper": ahead[2]})
        both = pd.concat([out, future], ignore_index=True)
        both["params"] = [params] * len(both)
        for name, value in ends.items():
            both[name] = value
        both = both.astype({"n_effective": "Int32"})
        return both[[field.split()[0] for field in SCHEMA.split(", ")]]

    return run


def model_series(
    series: DataFrame,
    value: str = "daily_amount",
    order: tuple = PLAIN,
    seasonal: tuple = (0, 0, 0, 0),
    steps: int = 7,
    enforce: bool = True,
) -> DataFrame:
    """Fit every series once; rows hold fitted values for its days and forecasts for the days after.

    With ``enforce`` the model stays stationary and invertible and starts from its stationary distribution; without
    it the filter starts diffuse, and its first days (one per state) have no fitted value.
    """
    if not 1 <= steps <= 30:
        raise ValueError("steps must be within 1..30")
    present = series.select("series_key", "date", F.col(value).cast("double").alias("x")).where("x is not null")
    spread = in_groups(present, "series_key")
    return spread.groupBy("series_key").applyInPandas(group_function(Shape(order, seasonal), steps, enforce), SCHEMA)


def filtered_errors(
    series: DataFrame,
    params: list[float],
    value: str = "daily_amount",
    order: tuple = PLAIN,
    seasonal: tuple = (0, 0, 0, 0),
    enforce: bool = True,
) -> DataFrame:
    """(series_key, date, error, variance) of the one-step predictions at given parameters, nothing fitted.

    Days lost to differencing have no row; null values are left out, as in ``model_series``.
    """
    shape = Shape(order, seasonal)
    differencing = shape.differencing()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        y, lost = rows["x"].to_numpy(float), len(differencing) - 1
        if len(y) <= lost:
            return pd.DataFrame({"series_key": [], "date": [], "error": [], "variance": []})
        w = np.convolve(y, differencing)[lost : len(y)]
        found = kalman_filter(w, [shape.polynomials(np.asarray(params, float))], diffuse=not enforce)
        return pd.DataFrame(
            {"series_key": key[0], "date": rows["date"].to_numpy()[lost:], "error": found.errors[0], "variance": found.variances[0]}
        )

    present = series.select("series_key", "date", F.col(value).cast("double").alias("x")).where("x is not null")
    schema = "series_key string, date date, error double, variance double"
    return in_groups(present, "series_key").groupBy("series_key").applyInPandas(run, schema)


def sarima_series(series: DataFrame, value: str = "daily_amount", steps: int = 7) -> DataFrame:
    """The weekly model, neither stationary nor invertible by force."""
    return model_series(series, value, PLAIN, SEASONAL, steps, enforce=False)


def fit_report(modelled: DataFrame) -> DataFrame:
    """One row per series: parameters, variance, information criteria and fit time."""
    columns = ("params", "sigma2", "aic", "bic", "n_effective", "train_time")
    return modelled.groupBy("series_key").agg(*[F.first(c).alias(c) for c in columns])


def fitted_values(modelled: DataFrame) -> DataFrame:
    """Actual, fitted and residual per day; the days the model conditions on have no fitted value."""
    return modelled.where("actual is not null").select("series_key", "date", "actual", "fitted", "residual")


def forecasts(modelled: DataFrame) -> DataFrame:
    """Dated forecasts with their 95 % interval."""
    return modelled.where("actual is null").select("series_key", "date", "forecast", "lower", "upper")
