"""Registered queries: scalar features, bins and scores."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ordersight.functions import features as C
from ordersight.functions.rounding import round_doubles
from ordersight.models.features import apply_scaler, feature_table, fit_scaler
from ordersight.operators import quality as Q
from ordersight.operators import scores as S
from ordersight.plans.registry import query
from ordersight.plans.views import CC, CLEAN, FEATURE, NORM, RULE, TX, cards, cleaned, norm_scored, r, rule_scored
from ordersight.schemas import FEATURES
from ordersight.sources.tables import table, transactions


@query("feature_log_amount", f"with {TX} select order_id, {r('ln(1 + amount)')} log_amount from tx")
def feature_log_amount(spark, folder):
    return round_doubles(
        transactions(spark, folder).select("order_id", C.log_amount(F.col("amount")).alias("log_amount"))
    )


@query(
    "feature_rush_hour",
    f"with {TX} select order_id, case when order_time between 1 and 6 then 1 else 0 end is_rush_hour from tx",
)
def feature_rush_hour(spark, folder):
    return transactions(spark, folder).select("order_id", C.is_rush_hour(F.col("order_time")).alias("is_rush_hour"))


CODES = "case device_type when 'iOS' then 0 when 'Android' then 1 when 'PC' then 2 when 'H5' then 3 else {} end"


@query(
    "feature_device_code",
    f"with {TX} select order_id, {CODES.format(1)} code_default_1, {CODES.format(3)} code_default_3 from tx",
)
def feature_device_code(spark, folder):
    device = F.col("device_type")
    return transactions(spark, folder).select(
        "order_id", C.device_code(device, 1).alias("code_default_1"), C.device_code(device, 3).alias("code_default_3")
    )


@query(
    "feature_table",
    f"with {FEATURE} select order_id, {r('log_amount')} log_amount, {r('time_diff', 4)} time_diff, is_rush_hour, device_code from features",
)
def feature_table_query(spark, folder):
    return round_doubles(feature_table(transactions(spark, folder)), time_diff=4)


def z_sql(spread: str) -> str:
    columns = ", ".join(
        f"{r(f'({c} - avg({c}) over ()) / {spread}({c}) over ()', 5)} {c}" for c in FEATURES
    )
    return f"with {FEATURE} select order_id, {columns} from features"


@query("zscore_features", z_sql("stddev_samp"))
def zscore_features(spark, folder):
    features = feature_table(transactions(spark, folder))
    scaled = apply_scaler(features, fit_scaler(features)).withColumn("z", vector_to_array("features"))
    return round_doubles(scaled.select("order_id", *[F.col("z")[i].alias(c) for i, c in enumerate(FEATURES)]), 5)


@query("zscore_features_population", z_sql("stddev_pop"))
def zscore_features_population(spark, folder):
    return round_doubles(S.standardize(feature_table(transactions(spark, folder)), list(FEATURES), ddof=0), 5)


@query(
    "feature_stats",
    f"with {FEATURE}, z as ("
    + "select "
    + ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () {c}" for c in FEATURES)
    + " from features) "
    + " union all ".join(
        f"select '{c}' feature, {r(f'avg({c})', 4)} mean, {r(f'stddev_pop({c})', 4)} std, {r(f'min({c})', 4)} \"min\", {r(f'max({c})', 4)} \"max\" from z"
        for c in FEATURES
    ),
)
def feature_stats(spark, folder):
    scaled = S.standardize(feature_table(transactions(spark, folder)), list(FEATURES), ddof=0)
    return round_doubles(S.feature_stats(scaled, list(FEATURES)), 4)


HOUR_BIN = """case when order_time < 6 then '00-06' when order_time < 12 then '06-12'
 when order_time < 18 then '12-18' else '18-24' end"""
AMOUNT_BIN = """case when {0} > 0 and {0} <= 500 then '0-500' when {0} > 500 and {0} <= 1000 then '500-1000'
 when {0} > 1000 and {0} <= 1500 then '1000-1500' when {0} > 1500 and {0} <= 2000 then '1500-2000'
 when {0} > 2000 and {0} <= 3000 then '2000-3000' end"""
AMOUNT_BAND = """case when {0} < 50 then '<50' when {0} < 200 then '50-200' when {0} < 500 then '200-500'
 when {0} < 1000 then '500-1000' else '>=1000' end"""
SCORE_BUCKET = """case when anomaly_score < 0.2::double then '0-0.2' when anomaly_score < 0.4::double then '0.2-0.4'
 when anomaly_score < 0.6::double then '0.4-0.6' when anomaly_score < 0.8::double then '0.6-0.8' else '0.8-1.0' end"""
RISK_LEVEL = """case when anomaly_score >= 0.9::double then 'extreme' when anomaly_score >= 0.8::double then 'high'
 when anomaly_score >= 0.6::double then 'medium' else 'low' end"""


@query("hour_bin", f"with {TX} select order_id, {HOUR_BIN} hour_bin from tx")
def hour_bin(spark, folder):
    return transactions(spark, folder).select("order_id", C.hour_bin(F.col("order_time")).alias("hour_bin"))


@query("amount_bin", f"select o_orderkey, {AMOUNT_BIN.format('(o_totalprice / 100)')} amount_bin from orders")
def amount_bin(spark, folder):
    # the order totals of this table reach every bin once divided by 100
    price = F.col("o_totalprice") / 100
    return table(spark, folder, "orders").select("o_orderkey", C.amount_bin(price).alias("amount_bin"))


@query("amount_band", f"select o_orderkey, {AMOUNT_BAND.format('(o_totalprice / 100)')} amount_band from orders")
def amount_band(spark, folder):
    price = F.col("o_totalprice") / 100
    return table(spark, folder, "orders").select("o_orderkey", C.amount_band(price).alias("amount_band"))


@query("score_bucket", f"with {NORM} select order_id, {SCORE_BUCKET} score_bucket from scored")
def score_bucket(spark, folder):
    return norm_scored(spark, folder).select("order_id", C.score_bucket(F.col("anomaly_score")).alias("score_bucket"))


@query("risk_level", f"with {RULE} select order_id, {RISK_LEVEL} risk_level from scored")
def risk_level(spark, folder):
    return rule_scored(spark, folder).select("order_id", C.risk_level(F.col("anomaly_score")).alias("risk_level"))


@query(
    "anomaly_rate_level",
    f"""with {RULE} select order_time, {r("ratio", 4)} ratio, case when ratio >= 0.15::double then 'elevated'
    when ratio >= 0.08::double then 'medium' when ratio >= 0.03::double then 'low' else 'minimal' end as level
    from (select order_time, avg(case when anomaly_score >= 0.8::double then 1.0::double else 0.0::double end) ratio
          from scored group by 1)""",
)
def anomaly_rate_level(spark, folder):
    flagged = C.threshold_label(F.col("anomaly_score"), 0.8).cast("double")
    by_hour = rule_scored(spark, folder).groupBy("order_time").agg(F.avg(flagged).alias("ratio"))
    return round_doubles(by_hour.withColumn("level", C.anomaly_rate_level(F.col("ratio"))), 4)


@query(
    "hour_from_seconds",
    f"""with {CC} select vec_id, cast(floor(("Time" % 86400) / 3600) as integer) as hour from cc""",
)
def hour_from_seconds(spark, folder):
    return cards(spark, folder).select("vec_id", C.hour_from_seconds(F.col("Time")).alias("hour"))


@query(
    "format_ids",
    """select event_id, 'U' || lpad(cast(event_id % 1000 as varchar), 6, '0') user_id,
    'O' || lpad(cast(event_id as varchar), 8, '0') order_id from events""",
)
def format_ids(spark, folder):
    value = F.col("event_id")
    return table(spark, folder, "events").select(
        "event_id", C.padded_id("U", value % 1000, 6).alias("user_id"), C.padded_id("O", value, 8).alias("order_id")
    )


@query("maxnorm_score", f"with {NORM} select order_id, {r('anomaly_score')} anomaly_score from scored")
def maxnorm_score(spark, folder):
    return round_doubles(norm_scored(spark, folder).select("order_id", "anomaly_score"))


@query(
    "minmax_score",
    f"""with {CLEAN} select order_id, {r("(time_diff - lo) / (hi - lo)")} anomaly_score
    from cleaned cross join (select min(time_diff) lo, max(time_diff) hi from cleaned)""",
)
def minmax_score(spark, folder):
    return round_doubles(S.minmax_score(cleaned(spark, folder), "time_diff").select("order_id", "anomaly_score"))


@query(
    "threshold_label",
    f"with {RULE} select order_id, case when anomaly_score >= 0.8::double then 1 else 0 end as label from scored",
)
def threshold_label(spark, folder):
    return rule_scored(spark, folder).select("order_id", C.threshold_label(F.col("anomaly_score"), 0.8).alias("label"))


@query(
    "required_rows_filter",
    f"with {TX} select order_id, order_time from tx where amount is not null and time_diff is not null",
)
def required_rows_filter(spark, folder):
    return Q.required_rows(transactions(spark, folder)).select("order_id", "order_time")


@query(
    "rule_score",
    f"with {RULE} select order_id, {r('anomaly_score')} anomaly_score, is_anomaly from scored",
)
def rule_score(spark, folder):
    return round_doubles(rule_scored(spark, folder).select("order_id", "anomaly_score", "is_anomaly"))
