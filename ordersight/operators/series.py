"""Daily series of many keys in parallel: roll-up, cleaning, autocorrelation, accuracy, selection.

After the roll-up a series holds one row per calendar day, so a window over one series is bounded
by the calendar, however many orders the series has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions import features as C
from ordersight.functions.rounding import tidy

MEASURES = ("daily_amount", "daily_count", "avg_price", "rush_ratio")
MAX_LAGS = 20


def by_date() -> Window:
    return Window.partitionBy("series_key").orderBy("date")


def daily_rollup(orders: DataFrame, key: Column, ts: Column, amount: Column, hour: Column | None = None, empty: str = "zero") -> DataFrame:
    """One row per series and day between its first and last order.

    Days without orders are 0 (``empty="zero"``) or null (``empty="null"``, to be interpolated).
    """
    if empty not in ("zero", "null"):
        raise ValueError("empty must be 'zero' or 'null'")
    rush = F.lit(0.0) if hour is None else C.is_rush_hour(hour).cast("double")
    daily = (
        orders.select(key.cast("string").alias("series_key"), F.to_date(ts).alias("date"), amount.alias("a"), rush.alias("r"))
        .groupBy("series_key", "date")
        .agg(
            tidy(F.sum("a"), 2).alias("daily_amount"),
            F.count("a").alias("daily_count"),
            tidy(F.avg("a"), 2).alias("avg_price"),
            tidy(F.avg("r"), 4).alias("rush_ratio"),
        )
    )
    spine = daily.groupBy("series_key").agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        "series_key", F.explode(F.sequence("a", "b")).alias("date")
    )
    # null-safe, so that the series of the null key keeps its values
    own = daily.withColumnsRenamed({"series_key": "_key", "date": "_date"})
    at = F.col("series_key").eqNullSafe(F.col("_key")) & (F.col("date") == F.col("_date"))
    full = spine.join(own, at, "left").drop("_key", "_date")
    if empty == "null":
        return full
    return full.select("series_key", "date", *[F.coalesce(c, F.lit(0)).alias(c) for c in MEASURES])


def first_difference(series: DataFrame, value: str = "daily_amount") -> DataFrame:
    """Value minus the value of the day before; the first day is dropped."""
    step = series.select("series_key", "date", (F.col(value) - F.lag(value).over(by_date())).alias("difference"))
    return step.where("difference is not null")


def interpolate_gaps(series: DataFrame, columns: tuple[str, ...] = MEASURES) -> DataFrame:
    """Fill nulls linearly between their neighbours and with the nearest value at the edges."""
    backward = by_date().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    forward = by_date().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    point = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("date").alias("d"), F.col(c).cast("double").alias("v")))
    near = series.select(
        "*",
        *[F.last(point(c), ignorenulls=True).over(backward).alias(f"_p_{c}") for c in columns],
        *[F.first(point(c), ignorenulls=True).over(forward).alias(f"_n_{c}") for c in columns],
    )

    def filled(c: str) -> Column:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        share = F.datediff(F.col("date"), p["d"]) / F.datediff(n["d"], p["d"])
        between = p["v"] + (n["v"] - p["v"]) * share
        return F.coalesce(F.col(c).cast("double"), between, n["v"], p["v"])

    return near.select(*[filled(c).alias(c) if c in columns else F.col(c) for c in series.columns])


def series_clean(series: DataFrame, clipped: tuple[str, ...] = ("daily_amount", "daily_count"), k: float = 3.0) -> DataFrame:
    """Fill gaps, then clip amount and count to mean +- k sample deviations of their series.

    Adds ``nulls_before`` and ``clipped`` (cells touched in the row).
    """
    present = [F.col(c).isNull().cast("int") for c in MEASURES]
    filled = interpolate_gaps(series.withColumn("nulls_before", sum(present[1:], present[0])))
    whole = Window.partitionBy("series_key")
    banded = filled.select(
        "*",
        *[(F.avg(c).over(whole) - k * F.stddev(c).over(whole)).alias(f"_lo_{c}") for c in clipped],
        *[(F.avg(c).over(whole) + k * F.stddev(c).over(whole)).alias(f"_hi_{c}") for c in clipped],
    )
    outside = [((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}"))) for c in clipped]
    touched = [F.coalesce(o.cast("int"), F.lit(0)) for o in outside]
    kept = {c: F.when(o, F.greatest(F.col(f"_lo_{c}"), F.least(F.col(f"_hi_{c}"), F.col(c)))).otherwise(F.col(c)) for c, o in zip(clipped, outside, strict=True)}
    return banded.select(
        "series_key",
        "date",
        *[kept.get(c, F.col(c)).alias(c) for c in MEASURES],
        "nulls_before",
        sum(touched[1:], touched[0]).alias("clipped"),
    )


def clean_report(cleaned: DataFrame) -> DataFrame:
    """Per series: length, nulls before and after, clipped cells."""
    after = [F.col(c).isNull().cast("int") for c in MEASURES]
    return cleaned.groupBy("series_key").agg(
        F.count("*").alias("length"),
        F.sum("nulls_before").alias("missing_before"),
        F.sum(sum(after[1:], after[0])).alias("missing_after"),
        F.sum("clipped").alias("outliers_clipped"),
    )


def acf(series: DataFrame, value: str = "daily_amount", max_lags: int = MAX_LAGS) -> DataFrame:
    """Autocorrelation per series and lag 0..min(max_lags, n // 2 - 1), biased estimator, with its 95 % bound."""
    present = series.select("series_key", "date", F.col(value).cast("double").alias("x")).where("x is not null")
    whole = Window.partitionBy("series_key")
    centred = present.select("series_key", "date", (F.col("x") - F.avg("x").over(whole)).alias("d"))
    shifted = centred.select("series_key", "d", *[F.lag("d", k).over(by_date()).alias(f"d{k}") for k in range(1, max_lags + 1)])
    products = [F.coalesce(F.sum(F.col("d") * F.col(f"d{k}")), F.lit(0.0)) for k in range(1, max_lags + 1)]
    sums = shifted.groupBy("series_key").agg(
        F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("s0"), F.array(*products).alias("s")
    )
    all_lags = F.concat(F.array("s0"), F.col("s"))
    bound = 1.96 / F.sqrt("n")
    return (
        sums.select("series_key", "n", "s0", F.posexplode(all_lags).alias("lag", "product"))
        .where(F.col("lag") <= F.floor(F.col("n") / 2) - 1)
        .select(
            "series_key",
            "lag",
            "n",
            F.when(F.col("s0") > 0, F.col("product") / F.col("s0")).alias("acf"),
            bound.alias("conf_bound"),
        )
        .withColumn("significant", (F.abs("acf") > F.col("conf_bound")).cast("int"))
    )


def dickey_fuller(series: DataFrame, value: str = "daily_amount") -> DataFrame:
    """Unit-root statistic without lagged differences, for all series in one aggregate.

    The t value of the level in the regression of the daily change on a constant and the level before.
    """
    before = F.lag(F.col(value).cast("double")).over(by_date())
    pairs = series.select("series_key", before.alias("x"), (F.col(value).cast("double") - before).alias("y"))
    sums = pairs.where("x is not null and y is not null").groupBy("series_key").agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy")
    )
    error = (F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")) / (F.col("n") - 2)
    known = (F.col("n") > 2) & (F.col("sxx") > 0) & (error > 0)
    return sums.select("series_key", "n", F.when(known, F.col("slope") / F.sqrt(error / F.col("sxx"))).alias("statistic"))


def forecast_accuracy(pairs: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, MSE, RMSE (of the rounded MSE), R2 and MAPE per group; rows lacking either value are left out."""
    both = pairs.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    error = F.col(actual) - F.col(predicted)
    raw = both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sum(error * error).alias("sse"),
        (F.var_pop(actual) * F.count("*")).alias("sst"),
        F.avg(F.abs(error / F.greatest(F.col(actual), F.lit(1.0)))).alias("ape"),
    )
    mse = tidy(F.col("mse"), 2)
    return raw.select(
        *by,
        "n",
        tidy(F.col("mae"), 2).alias("mae"),
        mse.alias("mse"),
        tidy(F.sqrt(mse), 2).alias("rmse"),
        tidy(F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")), 4).alias("r2"),
        tidy(F.col("ape") * 100, 2).alias("mape"),
    )


def seasonal_naive(series: DataFrame, value: str = "daily_amount", lag: int = 7) -> DataFrame:
    """Each day predicted by the value ``lag`` days before."""
    return series.select(
        "series_key",
        "date",
        F.col(value).cast("double").alias("actual"),
        F.lag(F.col(value).cast("double"), lag).over(by_date()).alias("predicted"),
    )


def series_summary(series: DataFrame) -> DataFrame:
    """Per series: days, amount sum, mean, std, extremes, mean count, price and rush share, first and last day."""
    return series.groupBy("series_key").agg(
        F.count("*").alias("days"),
        F.sum("daily_amount").alias("total_amount"),
        F.avg("daily_amount").alias("avg_amount"),
        F.stddev("daily_amount").alias("std_amount"),
        F.min("daily_amount").alias("min_amount"),
        F.max("daily_amount").alias("max_amount"),
        F.avg("daily_count").alias("avg_count"),
        F.avg("avg_price").alias("avg_price"),
        F.avg("rush_ratio").alias("avg_rush_ratio"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
    )


def model_selection(accuracy: DataFrame, plain: str = "arima", seasonal: str = "sarima") -> DataFrame:
    """Per series: model with higher R2, whether the seasonal model also has lower MAPE, and its grade."""
    wide = accuracy.groupBy("series_key").pivot("model", [plain, seasonal]).agg(F.first("r2").alias("r2"), F.first("mape").alias("mape"))
    p_r2, s_r2 = F.col(f"{plain}_r2"), F.col(f"{seasonal}_r2")
    p_mape, s_mape = F.col(f"{plain}_mape"), F.col(f"{seasonal}_mape")
    return wide.select(
        "series_key",
        F.when(s_r2 > p_r2, seasonal).otherwise(plain).alias("better_r2"),
        F.when(s_mape < p_mape, seasonal).otherwise(plain).alias("lower_mape"),
        F.when(s_mape < 15, "good").otherwise("fair").alias("grade"),
        p_r2.alias("plain_r2"),
        s_r2.alias("seasonal_r2"),
        p_mape.alias("plain_mape"),
        s_mape.alias("seasonal_mape"),
    )


def differencing_needed(adf: DataFrame) -> DataFrame:
    """Per series: 1 when the level is not stationary and its first difference is."""
    wide = adf.groupBy("series_key").pivot("form", ["level", "difference"]).agg(F.first("is_stationary"))
    needed = (F.col("level") == 0) & (F.col("difference") == 1)
    return wide.select("series_key", needed.cast("int").alias("needs_differencing"))


def forecast_table(plain: DataFrame, seasonal: DataFrame) -> DataFrame:
    """Per series and date both forecasts, the seasonal interval, and both means over the horizon."""
    a = plain.select("series_key", "date", F.col("forecast").alias("arima"))
    b = seasonal.select("series_key", "date", F.col("forecast").alias("sarima"), "lower", "upper")
    whole = Window.partitionBy("series_key")
    return a.join(b, ["series_key", "date"]).select(
        "*", F.avg("arima").over(whole).alias("arima_mean"), F.avg("sarima").over(whole).alias("sarima_mean")
    )
