"""Registered queries: joins, windows, ranks and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordersight.functions.features import with_features
from ordersight.functions.rounding import round_doubles
from ordersight.operators import joins as J
from ordersight.operators import ranking as K
from ordersight.operators import scores as S
from ordersight.operators import series as T
from ordersight.plans.columns import RISK_LEVEL
from ordersight.plans.registry import query
from ordersight.plans.views import (
    CLEAN,
    DAILY,
    DAILY_ROWS,
    FEATURE,
    NORM,
    RULE,
    TX,
    cleaned,
    daily,
    norm_scored,
    r,
    rule_scored,
)
from ordersight.schemas import FEATURES
from ordersight.sources.tables import transactions


@query(
    "attach_scores",
    f"with {RULE} select t.order_id, {r('t.amount', 4)} amount, t.device_type, {r('anomaly_score')} anomaly_score from tx t join scored s on t.order_id = s.order_id",
)
def attach_scores(spark, folder):
    orders = transactions(spark, folder).select("order_id", "amount", "device_type")
    scores = rule_scored(spark, folder).select("order_id", "anomaly_score")
    return round_doubles(J.attach_scores(orders, scores), 6, amount=4)


@query(
    "zero_fill_domain",
    f"""with {RULE} select cast(i as integer) as hour, coalesce(n, 0) n from range(0, 24) t(i) left join
    (select order_time, count(*) n from scored where anomaly_score >= 0.95::double and device_type = 'iOS' group by 1) g on g.order_time = t.i""",
)
def zero_fill_domain(spark, folder):
    flagged = rule_scored(spark, folder).where("anomaly_score >= 0.95D and device_type = 'iOS'")
    counts = flagged.groupBy(F.col("order_time").alias("hour")).agg(F.count("*").alias("n"))
    return J.zero_fill(J.hours(spark), counts, "hour", ["n"])


@query(
    "broadcast_scalar",
    f"""with {CLEAN} select order_id, {r("amount - m", 4)} above_mean from cleaned cross join (select avg(amount) m from cleaned)""",
)
def broadcast_scalar(spark, folder):
    rows = cleaned(spark, folder)
    joined = J.broadcast_scalar(rows, rows.agg(F.avg("amount").alias("m")))
    return round_doubles(joined.select("order_id", (F.col("amount") - F.col("m")).alias("above_mean")), 4)


@query(
    "row_number_rank",
    f"""with {CLEAN} select device_type, order_id, {r("amount", 4)} amount, cast(k as integer) as rank from (
    select *, row_number() over (partition by device_type order by amount desc, order_id) k from cleaned) where k <= 20""",
)
def row_number_rank(spark, folder):
    ranked = K.rank_in_group(cleaned(spark, folder), ["device_type"], [F.desc("amount"), "order_id"], 20)
    return round_doubles(ranked.select("device_type", "order_id", "amount", "rank"), 4)


@query("gap_seconds", f"with {TX} select order_id, user_id, {r('time_diff', 4)} time_diff from tx")
def gap_seconds(spark, folder):
    return round_doubles(transactions(spark, folder).select("order_id", "user_id", "time_diff"), 4)


DIFFERENCE = f"""with {DAILY} select series_key, cast(date as varchar) date, {r("d", 2)} difference from (
    select *, daily_amount - lag(daily_amount) over (partition by series_key order by date) d from daily) where d is not null"""


@query("first_difference", DIFFERENCE)
def first_difference(spark, folder):
    steps = T.first_difference(daily(spark, folder)).withColumn("date", F.col("date").cast("string"))
    return round_doubles(steps, 2)


FILLED = """
near as (
  select *, last_value(case when {0} is not null then date end ignore nulls) over w pd, last_value({0} ignore nulls) over w pv,
         first_value(case when {0} is not null then date end ignore nulls) over v nd, first_value({0} ignore nulls) over v nv
  from sparse window w as (partition by series_key order by date rows between unbounded preceding and current row),
                     v as (partition by series_key order by date rows between current row and unbounded following))"""


@query(
    "interpolate_gaps",
    f"""with {DAILY_ROWS}, {FILLED.format("avg_price")} select series_key, cast(date as varchar) date,
    {r("coalesce(avg_price, pv + (nv - pv) * (date_diff('day', pd, date) / date_diff('day', pd, nd)), nv, pv)", 4)} avg_price from near""",
)
def interpolate_gaps(spark, folder):
    filled = T.interpolate_gaps(daily(spark, folder, "null"), ("avg_price",))
    return round_doubles(filled.select("series_key", F.col("date").cast("string"), "avg_price"), 4)


def top_sql(n: int) -> str:
    return f"""select cast(row_number() over (order by anomaly_score desc, order_id) as integer) as rank, user_id, order_id,
    {r("anomaly_score")} anomaly_score, {r("amount", 4)} amount, {r("time_diff", 4)} time_diff,
    case when order_time between 1 and 6 then 1 else 0 end is_rush_hour, device_type,
    case when anomaly_score >= 0.8::double then 1 else 0 end is_high_risk, {RISK_LEVEL} risk_level
    from (select * from scored order by anomaly_score desc, order_id limit {n})"""


@query("top_risk_orders", f"with {RULE} {top_sql(100)}")
def top_risk_orders(spark, folder):
    return round_doubles(K.top_risk_orders(rule_scored(spark, folder), 100), 6, amount=4, time_diff=4)


@query("top_risk_orders_maxnorm", f"with {NORM} {top_sql(50)}")
def top_risk_orders_maxnorm(spark, folder):
    return round_doubles(K.top_risk_orders(norm_scored(spark, folder), 50), 6, amount=4, time_diff=4)


@query(
    "paginate",
    f"""with {RULE}, top as ({top_sql(100)}) select rank, order_id, anomaly_score, (select count(*) from top) total,
    cast(ceil((select count(*) from top) / 7.0::double) as bigint) total_pages from top where rank between 15 and 21""",
)
def paginate(spark, folder):
    top = K.top_risk_orders(rule_scored(spark, folder), 100).select("rank", "order_id", "anomaly_score")
    return round_doubles(K.paginate(top, page=3, page_size=7))


@query(
    "score_sample",
    f"with {NORM} select order_id, {r('anomaly_score')} anomaly_score from scored order by order_id limit 1000",
)
def score_sample(spark, folder):
    return round_doubles(K.score_sample(norm_scored(spark, folder), 1000))


def importance_rows(source: str) -> str:
    """CTE ``importance`` (feature, abs_correlation, importance) over ``source``."""
    cells = " union all ".join(
        f"select '{c}' feature, coalesce({r(f'abs(corr({c}, anomaly_score))', 4)}, 0) abs_correlation from {source}" for c in FEATURES
    )
    return f"""raw as ({cells}), importance as (
      select feature, abs_correlation, {r("abs_correlation / (select sum(abs_correlation) from raw)", 4)} importance from raw)"""


SCORED_FEATURES = f"""{FEATURE}, scored_features as (
  select f.*, (amount / (select max(amount) from cleaned) + c.time_diff / (select max(time_diff) from cleaned)) / 2 anomaly_score
  from features f join cleaned c on f.order_id = c.order_id)"""


def scored_features(spark, folder):
    """Features with the max-norm score, both from one pass over the cleaned orders."""
    return with_features(norm_scored(spark, folder)).select("order_id", *FEATURES, "anomaly_score")


@query("feature_importance", f"with {SCORED_FEATURES}, {importance_rows('scored_features')} select * from importance")
def feature_importance(spark, folder):
    return round_doubles(S.feature_importance(scored_features(spark, folder), list(FEATURES)), 4)


RANKED = """select cast(row_number() over (order by importance desc, feature) as integer) as rank, feature, importance,
  round(importance / (select sum(importance) from importance) + 1e-9, 4) share from importance"""


@query("rank_features", f"with {SCORED_FEATURES}, {importance_rows('scored_features')} {RANKED}")
def rank_features(spark, folder):
    importance = S.feature_importance(scored_features(spark, folder), list(FEATURES)).select("feature", "importance")
    return round_doubles(K.rank_features(importance), 4)
