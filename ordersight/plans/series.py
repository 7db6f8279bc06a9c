"""Registered queries: daily series and their models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordersight.functions.rounding import round_doubles
from ordersight.models import arima, unit_root
from ordersight.operators import series as T
from ordersight.plans.ranking import FILLED
from ordersight.plans.registry import query
from ordersight.plans.views import DAILY, DAILY_BY_NATION, DAILY_ROWS, TX, daily, daily_by_nation, daily_tx, r
from ordersight.session import cut


def dated(df, *names):
    """Dates as text, so both engines print them alike."""
    return df.withColumns({n: F.col(n).cast("string") for n in names or ("date",)})


@query(
    "daily_rollup",
    f"""with {DAILY} select series_key, cast(date as varchar) date, daily_amount, daily_count, avg_price, rush_ratio from daily""",
)
def daily_rollup(spark, folder):
    return dated(daily(spark, folder))


@query(
    "daily_rollup_transactions",
    f"""with {TX}, per_day as (select device_type series_key, cast(ts as date) as date, {r("sum(amount)", 2)} daily_amount,
      count(amount) daily_count, {r("avg(amount)", 2)} avg_price,
      {r("avg(case when order_time between 1 and 6 then 1.0::double else 0.0::double end)", 4)} rush_ratio from tx group by 1, 2),
    spine as (select series_key, cast(unnest(generate_series(a, b, interval 1 day)) as date) as date
      from (select series_key, min(date) a, max(date) b from per_day group by 1))
    select s.series_key, cast(s.date as varchar) date, coalesce(daily_amount, 0) daily_amount, coalesce(daily_count, 0) daily_count,
      coalesce(avg_price, 0) avg_price, coalesce(rush_ratio, 0) rush_ratio
    from spine s left join per_day p on s.series_key = p.series_key and s.date = p.date""",
)
def daily_rollup_transactions(spark, folder):
    return dated(daily_tx(spark, folder))


INTERPOLATED = "coalesce({0}, pv + (nv - pv) * (date_diff('day', pd, date) / date_diff('day', pd, nd)), nv, pv)"


def linear_sql() -> str:
    """CTE ``banded``: interpolated series with the clipping bounds."""
    near = FILLED.replace("near as", "near_{0} as")
    parts = [near.format(c).replace("near_{0}", f"near_{c}") for c in T.MEASURES]
    joined = " ".join(
        f"join (select series_key, date, {INTERPOLATED.format(c)} x_{c} from near_{c}) using (series_key, date)" for c in T.MEASURES
    )
    return f"""{", ".join(parts)}, filled as (select series_key, date,
      {" + ".join(f"case when {c} is null then 1 else 0 end" for c in T.MEASURES)} nulls_before,
      {", ".join(f"x_{c} {c}" for c in T.MEASURES)} from (select s.*, {", ".join(f"x_{c}" for c in T.MEASURES)} from sparse s {joined}))"""


BANDS = """banded as (select *, avg(daily_amount) over w - 3 * stddev_samp(daily_amount) over w lo_a, avg(daily_amount) over w + 3 * stddev_samp(daily_amount) over w hi_a,
  avg(daily_count) over w - 3 * stddev_samp(daily_count) over w lo_c, avg(daily_count) over w + 3 * stddev_samp(daily_count) over w hi_c
  from filled window w as (partition by series_key)),
clipped as (select series_key, date, least(greatest(daily_amount, lo_a), hi_a) daily_amount, least(greatest(daily_count, lo_c), hi_c) daily_count,
  avg_price, rush_ratio, nulls_before,
  case when daily_amount < lo_a or daily_amount > hi_a then 1 else 0 end + case when daily_count < lo_c or daily_count > hi_c then 1 else 0 end clipped
  from banded)"""
CLIPPED_OUT = f"""select series_key, cast(date as varchar) date, {r("daily_amount", 2)} daily_amount, {r("daily_count", 4)} daily_count,
  {r("avg_price", 4)} avg_price, {r("rush_ratio", 4)} rush_ratio, nulls_before, clipped from clipped"""


@query(
    "series_clean",
    f"""with {DAILY}, filled as (select *, 0 nulls_before from daily), {BANDS} {CLIPPED_OUT}""",
)
def series_clean(spark, folder):
    return round_doubles(dated(T.series_clean(daily(spark, folder))), 4, daily_amount=2)


@query("series_clean_linear", f"with {DAILY_ROWS}, {linear_sql()}, {BANDS} {CLIPPED_OUT}")
def series_clean_linear(spark, folder):
    return round_doubles(dated(T.series_clean(daily(spark, folder, "null"))), 4, daily_amount=2)


@query(
    "series_clean_report",
    f"""with {DAILY_ROWS}, {linear_sql()}, {BANDS} select series_key, count(*) length, cast(sum(nulls_before) as bigint) missing_before,
    cast(0 as bigint) missing_after, cast(sum(clipped) as bigint) outliers_clipped from clipped group by 1""",
)
def series_clean_report(spark, folder):
    return T.clean_report(T.series_clean(daily(spark, folder, "null")))


@query("adf_test")
def adf_test(spark, folder):
    return unit_root.adf_test(T.series_clean(daily(spark, folder)))


@query(
    "dickey_fuller",
    f"""with {DAILY}, pairs as (select series_key, x, daily_amount - x y from (
      select *, lag(daily_amount) over (partition by series_key order by date) x from daily) where x is not null)
    select series_key, count(*) n, {r("regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_slope(y, x) * regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x))", 4)} statistic
    from pairs group by 1""",
)
def dickey_fuller(spark, folder):
    return round_doubles(T.dickey_fuller(daily(spark, folder)), 4)


@query("differencing_needed")
def differencing_needed(spark, folder):
    return T.differencing_needed(unit_root.adf_test(T.series_clean(daily(spark, folder))))


@query(
    "acf",
    f"""with {DAILY}, d as (select series_key, date, daily_amount - avg(daily_amount) over (partition by series_key) d,
      row_number() over (partition by series_key order by date) i, count(*) over (partition by series_key) n from daily),
    lagged as (select a.series_key, k, any_value(a.n) n, sum(a.d * b.d) p from d a cross join range(0, 21) t(k)
      join d b on b.series_key = a.series_key and b.i = a.i + k where k <= a.n // 2 - 1 group by 1, 2)
    select series_key, cast(k as integer) lag, n, {r("p / z")} acf, {r("1.96::double / sqrt(n)")} conf_bound,
      case when abs(p / z) > 1.96::double / sqrt(n) then 1 else 0 end significant
    from lagged join (select series_key, p z from lagged where k = 0) using (series_key)""",
)
def acf(spark, folder):
    return round_doubles(T.acf(daily(spark, folder)))


@query("pacf")
def pacf(spark, folder):
    return round_doubles(unit_root.pacf(daily(spark, folder)))


ACCURACY = f"""select {{keys}}, count(*) n, {r("avg(abs(actual - predicted))", 2)} mae, {r("avg((actual - predicted) ** 2)", 2)} mse,
  {r("sqrt(" + r("avg((actual - predicted) ** 2)", 2) + ")", 2)} rmse,
  {r("1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*))", 4)} r2,
  {r("avg(abs((actual - predicted) / greatest(actual, 1.0::double))) * 100", 2)} mape
  from {{source}} where actual is not null and predicted is not null group by {{keys}}"""


def naive_cte(lag: int, name: str) -> str:
    return f"""{name} as (select series_key, date, daily_amount actual,
      lag(daily_amount, {lag}) over (partition by series_key order by date) predicted from daily)"""


@query("forecast_accuracy", f"with {DAILY}, {naive_cte(7, 'naive')} {ACCURACY.format(keys='series_key', source='naive')}")
def forecast_accuracy(spark, folder):
    return T.forecast_accuracy(T.seasonal_naive(daily(spark, folder)), ["series_key"])


@query(
    "model_selection_naive",
    f"""with {DAILY}, {naive_cte(1, "last_day")}, {naive_cte(7, "last_week")},
    acc as (select 'arima' model, * from ({ACCURACY.format(keys="series_key", source="last_day")})
      union all select 'sarima', * from ({ACCURACY.format(keys="series_key", source="last_week")}))
    select series_key, case when s.r2 > p.r2 then 'sarima' else 'arima' end better_r2, case when s.mape < p.mape then 'sarima' else 'arima' end lower_mape,
    case when s.mape < 15 then 'good' else 'fair' end grade, p.r2 plain_r2, s.r2 seasonal_r2, p.mape plain_mape, s.mape seasonal_mape
    from (select * from acc where model = 'arima') p join (select * from acc where model = 'sarima') s using (series_key)""",
)
def model_selection_naive(spark, folder):
    """Selection between yesterday's and last week's value as the two competing predictors."""
    series = daily(spark, folder)
    rows = [
        T.forecast_accuracy(T.seasonal_naive(series, lag=lag), ["series_key"]).withColumn("model", F.lit(name))
        for name, lag in (("arima", 1), ("sarima", 7))
    ]
    return T.model_selection(rows[0].unionByName(rows[1]))


@query(
    "series_summary",
    f"""with {DAILY} select series_key, count(*) "days", {r("sum(daily_amount)", 2)} total_amount, {r("avg(daily_amount)", 4)} avg_amount,
    {r("stddev_samp(daily_amount)", 4)} std_amount, {r("min(daily_amount)", 2)} min_amount, {r("max(daily_amount)", 2)} max_amount,
    {r("avg(daily_count)", 4)} avg_count, {r("avg(avg_price)", 4)} avg_price, {r("avg(rush_ratio)", 4)} avg_rush_ratio,
    cast(min(date) as varchar) first_day, cast(max(date) as varchar) last_day from daily group by 1""",
)
def series_summary(spark, folder):
    summary = dated(T.series_summary(daily(spark, folder)), "first_day", "last_day")
    return round_doubles(summary, 4, total_amount=2, min_amount=2, max_amount=2)


@query(
    "many_series_summary",
    f"""with {DAILY_BY_NATION} select series_key, count(*) "days", {r("sum(daily_amount)", 2)} total_amount,
    {r("stddev_samp(daily_amount)", 4)} std_amount, {r("max(daily_amount)", 2)} max_amount, {r("avg(daily_count)", 4)} avg_count,
    cast(min(date) as varchar) first_day, cast(max(date) as varchar) last_day from daily group by 1""",
)
def many_series_summary(spark, folder):
    """One row per nation and priority."""
    columns = ("series_key", "days", "total_amount", "std_amount", "max_amount", "avg_count", "first_day", "last_day")
    summary = dated(T.series_summary(daily_by_nation(spark, folder)), "first_day", "last_day").select(*columns)
    return round_doubles(summary, 4, total_amount=2, max_amount=2)


@query(
    "many_series_accuracy",
    f"with {DAILY_BY_NATION}, {naive_cte(7, 'naive')} {ACCURACY.format(keys='series_key', source='naive')}",
)
def many_series_accuracy(spark, folder):
    """Accuracy of last week's value, series by series."""
    return T.forecast_accuracy(T.seasonal_naive(daily_by_nation(spark, folder)), ["series_key"])


def cleaned_series(spark, folder):
    return T.series_clean(daily(spark, folder))


@query("arima_fit")
def arima_fit(spark, folder):
    return arima.fit_report(arima.model_series(cleaned_series(spark, folder))).drop("train_time")


PHI, THETA = 0.4, -0.7  # given parameters of the filter that is compared with SQL


@query(
    "arima_filter",
    f"""with recursive {DAILY}, steps as (select series_key, date, row_number() over (partition by series_key order by date) i,
      daily_amount - lag(daily_amount) over (partition by series_key order by date) w from daily),
    filtered as (select series_key, date, i, w error, (1 + {THETA * THETA}::double + 2 * {PHI * THETA}::double) / (1 - {PHI * PHI}::double) variance,
      0::double mean from steps where i = 2
      union all select s.series_key, s.date, s.i, s.w - m.mean, m.variance, m.mean from (
        select series_key, i, {PHI}::double * mean + ({PHI}::double * variance + {THETA}::double) / variance * error mean,
          {PHI * PHI}::double * variance + 2 * {PHI * THETA}::double + {THETA * THETA}::double
          - ({PHI}::double * variance + {THETA}::double) ** 2 / variance + 1 variance from filtered) m
        join steps s on s.series_key = m.series_key and s.i = m.i + 1)
    select series_key, cast(date as varchar) date, {r("error", 2)} error, {r("variance", 5)} variance from filtered""",
)
def arima_filter(spark, folder):
    """One-step errors and variances of the exact filter at given parameters."""
    return round_doubles(dated(arima.filtered_errors(daily(spark, folder), [PHI, THETA])), 2, variance=5)


@query("sarima_fit")
def sarima_fit(spark, folder):
    return arima.fit_report(arima.sarima_series(cleaned_series(spark, folder))).drop("train_time")


@query("arima_fitted_values")
def arima_fitted_values(spark, folder):
    return round_doubles(dated(arima.fitted_values(arima.model_series(cleaned_series(spark, folder)))), 2)


@query("arima_forecast")
def arima_forecast(spark, folder):
    return round_doubles(dated(arima.forecasts(arima.model_series(cleaned_series(spark, folder), steps=7))), 2)


@query("sarima_forecast")
def sarima_forecast(spark, folder):
    return round_doubles(dated(arima.forecasts(arima.sarima_series(cleaned_series(spark, folder), steps=7))), 2)


@query("model_selection")
def model_selection(spark, folder):
    series = cut(cleaned_series(spark, folder))
    fitted = [
        arima.fitted_values(model(series)).withColumn("model", F.lit(name))
        for name, model in (("arima", arima.model_series), ("sarima", arima.sarima_series))
    ]
    pairs = fitted[0].unionByName(fitted[1])
    return T.model_selection(T.forecast_accuracy(pairs, ["series_key", "model"], predicted="fitted"))


@query("forecast_table")
def forecast_table(spark, folder):
    series = cut(cleaned_series(spark, folder))
    table = T.forecast_table(arima.forecasts(arima.model_series(series)), arima.forecasts(arima.sarima_series(series)))
    return round_doubles(dated(table), 2)
