"""Registered queries: score evaluation and risk reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordersight.functions.features import rule_score, with_features, with_rule_score
from ordersight.functions.rounding import round_doubles
from ordersight.operators import ranking as K
from ordersight.operators import risk as R
from ordersight.operators import scores as S
from ordersight.operators.quality import clean
from ordersight.plans.ranking import SCORED_FEATURES, importance_rows, top_sql
from ordersight.plans.registry import query
from ordersight.plans.views import CLEAN, GAP_LT, NORM, RULE, cleaned, norm_scored, r, rule_scored
from ordersight.schemas import FEATURES
from ordersight.session import cut
from ordersight.sources.tables import transactions

SUMMARY = f"""{r("avg(anomaly_score)", 4)} avg_anomaly_score, {r("stddev_samp(anomaly_score)", 4)} std_anomaly_score,
  {r("avg(case when anomaly_score > 0.8::double then 1.0::double else 0.0::double end)", 4)} high_score_ratio, count(*) sample_count"""


@query("score_summary", f"with {RULE} select {SUMMARY} from scored")
def score_summary(spark, folder):
    return round_doubles(S.score_summary(rule_scored(spark, folder)), 4)


def metrics_cte(source: str, name: str, threshold: float) -> str:
    """CTE of label metrics; the AUC comes from tie-averaged ranks."""
    return f"""{name} as (
  select count(*) sample_count, cast(sum(is_cheat) as bigint) positives, count(*) filter (hit) flagged,
         count(*) filter (hit and is_cheat = 1) true_positives,
         case when count(*) filter (hit) > 0 then count(*) filter (hit and is_cheat = 1) / count(*) filter (hit) else 0 end as precision,
         count(*) filter (hit and is_cheat = 1) / sum(is_cheat) recall,
         2.0::double * count(*) filter (hit and is_cheat = 1) / (count(*) filter (hit) + sum(is_cheat)) f1,
         (sum(case when is_cheat = 1 then mid end) - sum(is_cheat) * (sum(is_cheat) + 1.0::double) / 2)
           / (sum(is_cheat) * (count(*) - sum(is_cheat))::double) auc
  from (select is_cheat, anomaly_score >= {threshold}::double hit,
               rank() over (order by anomaly_score) + (count(*) over (partition by anomaly_score) - 1) / 2.0::double mid
        from {source}))"""


METRICS_OUT = f"""sample_count, positives, flagged, true_positives, {r("precision")} as precision, {r("recall")} recall, {r("f1")} f1, {r("auc")} auc"""


@query("label_metrics", f"with {RULE}, {metrics_cte('scored', 'm', 0.8)} select {METRICS_OUT} from m")
def label_metrics(spark, folder):
    return round_doubles(S.label_metrics(rule_scored(spark, folder)))


@query("label_metrics_maxnorm", f"with {NORM}, {metrics_cte('scored', 'm', 0.2)} select {METRICS_OUT} from m")
def label_metrics_maxnorm(spark, folder):
    return round_doubles(S.label_metrics(norm_scored(spark, folder), threshold=0.2))


def clamp_sql(expression: str) -> str:
    return f"least(greatest({expression}, 0.5::double), 0.99::double)"


@query(
    "proxy_metrics",
    f"""with {RULE} select {clamp_sql("p")} as precision, {clamp_sql("c")} recall, {clamp_sql(r("2 * p * c / (p + c)", 4))} f1, {clamp_sql("a")} auc from (
    select {r("0.7::double + share * 0.3::double", 4)} p, {r("0.6::double + mean * 0.4::double", 4)} c, {r("0.5::double + mean * 0.5::double", 4)} a from (
    select avg(anomaly_score) mean, avg(case when anomaly_score > 0.8::double then 1.0::double else 0.0::double end) share from scored))""",
)
def proxy_metrics(spark, folder):
    return S.proxy_metrics(rule_scored(spark, folder))


def overview_sql(threshold: float) -> str:
    """CTE ``overview`` over tx, cleaned and scored."""
    return f"""overview as (
  select *, case when anomaly_ratio >= 0.15::double then 'elevated' when anomaly_ratio >= 0.08::double then 'medium'
     when anomaly_ratio >= 0.03::double then 'low' else 'minimal' end as level
  from (select t total_orders, c cleaned_samples, t - c removed_samples, s suspicious_orders,
     {r("s::double / c", 4)} anomaly_ratio, {threshold}::double threshold
     from (select (select count(*) from tx) t, (select count(*) from cleaned) c,
        (select count(*) from scored where anomaly_score >= {threshold}::double) s)))"""


@query("risk_overview", f"with {RULE}, {overview_sql(0.5)} select * from overview")
def risk_overview(spark, folder):
    tx = transactions(spark, folder)
    return R.risk_overview(tx, rule_scored(spark, folder), 0.5)


@query(
    "risk_by_hour",
    f"""with {RULE}, flagged as (select * from scored where anomaly_score >= 0.5::double)
    select cast(i as integer) as hour, coalesce(n, 0) "count",
    (select {r("avg(case when order_time between 1 and 6 then 1.0::double else 0.0::double end)", 4)} from flagged) rush_hour_ratio
    from range(0, 24) t(i) left join (select order_time, count(*) n from flagged group by 1) g on g.order_time = t.i""",
)
def risk_by_hour(spark, folder):
    return round_doubles(R.risk_by_hour(rule_scored(spark, folder), 0.5), 4)


@query(
    "risk_by_device",
    f"""with {RULE} select device_type, count(*) "count" from scored where anomaly_score >= 0.5::double group by 1 order by 2 desc, 1""",
)
def risk_by_device(spark, folder):
    return R.risk_by_device(rule_scored(spark, folder), 0.5)


@query(
    "high_risk_profile",
    f"""with {RULE}, top as ({top_sql(50)}) select count(*) high_risk_count, {r("avg(anomaly_score)", 4)} avg_score,
    {r("avg(amount)", 4)} avg_amount, {r("avg(time_diff)", 3)} avg_time_diff from top where is_high_risk = 1""",
)
def high_risk_profile(spark, folder):
    return round_doubles(R.high_risk_profile(rule_scored(spark, folder), 0.8, 50), 4, avg_time_diff=3)


@query(
    "peak_rush_hour",
    f"""with {RULE}, flagged as (select * from scored where anomaly_score >= 0.5::double)
    select order_time as hour, count(*) "count",
    (select {r("avg(case when order_time between 1 and 6 then 1.0::double else 0.0::double end)", 4)} from flagged) rush_hour_ratio
    from flagged where order_time between 1 and 6 group by 1 order by count(*) desc, order_time limit 1""",
)
def peak_rush_hour(spark, folder):
    return round_doubles(R.peak_rush_hour(rule_scored(spark, folder), 0.5), 4)


@query(
    "top_device_share",
    f"""with {RULE}, flagged as (select * from scored where anomaly_score >= 0.5::double)
    select device_type, count(*) "count", {r("count(*) / (select count(*) from flagged)", 4)} share,
    case when count(*) / (select count(*) from flagged) > 0.5 then 1 else 0 end concentrated
    from flagged group by 1 order by count(*) desc, device_type limit 1""",
)
def top_device_share(spark, folder):
    return round_doubles(R.top_device_share(rule_scored(spark, folder), 0.5), 4)


RULE_ONLY = RULE[len(CLEAN) :].lstrip(",\n")

# Three rule scores with different thresholds stand in for three models with real label metrics.
RIVALS = {"narrow": (20.0, 2000.0), "wide": (60.0, 40000.0), "gap_only": (0.0, 40000.0)}


def rival_metrics(rows):
    """(model, f1, train_time) of three rule settings; the time column is a stand-in, the row count."""
    score = lambda limits: rule_score(F.col("amount"), F.col("time_diff"), F.col("order_time"), *limits)
    each = F.array(*[F.struct(F.lit(n).alias("model"), score(limits).alias("anomaly_score")) for n, limits in RIVALS.items()])
    metrics = S.flag_metrics(rows.select("is_cheat", F.inline(each)), 0.5, by=["model"])
    return metrics.select("model", "f1", F.col("flagged").cast("double").alias("train_time"))


def rival_sql() -> str:
    scores = " union all ".join(
        f"""select '{name}' model, is_cheat, least(cast(1.0 as double),
       case when amount < {a} then cast(0.4 as double) else cast(0.1 as double) end
       + case when time_diff < {g} then cast(0.4 as double) else cast(0.1 as double) end
       + case when order_time between 1 and 6 then cast(0.2 as double) else cast(0.0 as double) end) >= 0.5::double hit from cleaned"""
        for name, (a, g) in RIVALS.items()
    )
    return f"""rivals as (select model, 2.0::double * count(*) filter (hit and is_cheat = 1)
      / (count(*) filter (hit) + sum(is_cheat)) f1, count(*) filter (hit)::double train_time from ({scores}) group by 1),
    best as (select (select model from rivals order by f1 desc, model limit 1) best_model, (select max(f1) from rivals) best_f1,
      (select model from rivals order by train_time, model limit 1) fastest,
      (select model from rivals order by train_time desc, model limit 1) slowest,
      (select max(train_time) / greatest(min(train_time), 0.01) from rivals) speed_ratio)"""


@query(
    "best_model",
    f"with {RULE}, {rival_sql()} select best_model, {r('best_f1')} best_f1, fastest, slowest, {r('speed_ratio', 4)} speed_ratio from best",
)
def best_model(spark, folder):
    return round_doubles(S.best_model(rival_metrics(cleaned(spark, folder))), 6, speed_ratio=4)


@query(
    "recommended_actions",
    f"""with {SCORED_FEATURES}, {importance_rows("scored_features")}, {RULE_ONLY}, {overview_sql(0.5)}, {rival_sql()},
    state as (select anomaly_ratio q, (select feature from importance order by importance desc, feature limit 1) f, best_f1 b
      from overview cross join best),
    fired as (select list_filter([
      case when q >= 0.10::double then 'urgent_treatment' when q >= 0.05::double then 'tighten_monitoring' end,
      case when f = 'time_diff' then 'tune_gap_rules' when f = 'is_rush_hour' then 'control_rush_hours' end,
      case when b >= 0.90::double then 'deploy_model' when b >= 0.80::double then 'keep_improving' end,
      'feedback_loop'], lambda x: x is not null) actions from state)
    select cast(i as integer) as rank, actions[i] as action from fired, range(1, 5) t(i) where i <= len(actions)""",
)
def recommended_actions(spark, folder):
    tx = cut(transactions(spark, folder))  # the gaps are taken once for everything below
    rows = clean(tx)
    overview = R.risk_overview(tx, with_rule_score(rows, gap_lt=GAP_LT), 0.5)
    importance = S.feature_importance(with_features(S.maxnorm_score(rows)), list(FEATURES))
    ranked = K.rank_features(importance.select("feature", "importance"))
    return R.recommended_actions(overview, ranked, S.best_model(rival_metrics(rows)))


@query(
    "risk_summary",
    f"""with {RULE}, {overview_sql(0.5)}, {rival_sql()} select total_orders, suspicious_orders, anomaly_ratio, threshold, best_model,
    {r("best_f1")} best_f1 from overview cross join best""",
)
def risk_summary(spark, folder):
    tx = cut(transactions(spark, folder))
    rows = clean(tx)
    overview = R.risk_overview(tx, with_rule_score(rows, gap_lt=GAP_LT), 0.5)
    return round_doubles(R.risk_summary(overview, S.best_model(rival_metrics(rows))))
