"""Registered queries: descriptive, segment and distribution aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordersight.functions.rounding import round_doubles
from ordersight.operators import aggregates as A
from ordersight.plans.columns import AMOUNT_BAND, AMOUNT_BIN, HOUR_BIN, SCORE_BUCKET
from ordersight.plans.registry import TWINS, query
from ordersight.plans.views import CC, CLEAN, NORM, RULE, TX, cards, cleaned, norm_scored, r, rule_scored, rush
from ordersight.sources.tables import table, transactions


def stats_sql(column: str) -> str:
    return (
        f"{r(f'avg({column})', 4)} {column}_mean, {r(f'stddev_samp({column})', 4)} {column}_std, "
        f"{r(f'min({column})', 4)} {column}_min, {r(f'max({column})', 4)} {column}_max"
    )


@query(
    "descriptive_stats",
    f"""with {CLEAN} select count(*) sample_count, {stats_sql("amount")}, {r("quantile_disc(amount, 0.5)", 4)} amount_median,
    {stats_sql("time_diff")}, {r("quantile_disc(time_diff, 0.5)", 4)} time_diff_median, {r(rush(), 4)} rush_hour_ratio from cleaned""",
)
def descriptive_stats(spark, folder):
    return round_doubles(A.descriptive_stats(transactions(spark, folder), accuracy=None), 4)


@query("descriptive_stats_sketch", TWINS["descriptive_stats"])
def descriptive_stats_sketch(spark, folder):
    """The one-pass form; the medians may be off by a millionth of the ranks, so not at all below a million rows."""
    return round_doubles(A.descriptive_stats(transactions(spark, folder), accuracy=1_000_000), 4)


@query(
    "descriptive_stats_exact",
    f"""with {CLEAN} select count(*) sample_count, {stats_sql("amount")}, {stats_sql("time_diff")},
    {r(rush(), 4)} rush_hour_ratio, cast(sum(is_cheat) as bigint) labeled_fraud_count, {r("avg(is_cheat)", 4)} labeled_fraud_ratio,
    {r("median(amount)", 4)} amount_median, {r("median(time_diff)", 4)} time_diff_median from cleaned""",
)
def descriptive_stats_exact(spark, folder):
    return round_doubles(A.descriptive_stats_exact(cleaned(spark, folder)), 4)


@query("device_counts", f"with {CLEAN} select device_type, count(*) order_count from cleaned group by 1")
def device_counts(spark, folder):
    return A.device_counts(cleaned(spark, folder))


@query(
    "hourly_distribution",
    f"""with {CLEAN} select order_time as hour, count(*) order_count, {r("avg(amount)", 4)} avg_amount,
    {r("avg(time_diff)", 4)} avg_time_diff from cleaned group by 1 order by 1""",
)
def hourly_distribution(spark, folder):
    return round_doubles(A.hourly_distribution(transactions(spark, folder)), 4)


@query(
    "device_analysis",
    f"""with {CLEAN} select device_type, count(*) order_count, {r("avg(amount)", 4)} avg_amount,
    {r("stddev_samp(amount)", 4)} std_amount, {r("avg(time_diff)", 4)} avg_time_diff, {r(rush(), 4)} rush_hour_ratio
    from cleaned group by 1 order by order_count desc, device_type""",
)
def device_analysis(spark, folder):
    return round_doubles(A.device_analysis(transactions(spark, folder)), 4)


@query(
    "user_profiling",
    f"""with {CLEAN} select user_id, count(*) order_count, {r("avg(amount)", 4)} avg_amount, {r("sum(amount)", 2)} total_amount,
    {r("avg(time_diff)", 4)} avg_time_diff, {r("min(time_diff)", 4)} min_time_diff,
    cast(sum(case when order_time between 1 and 6 then 1 else 0 end) as bigint) rush_hour_orders,
    count(distinct device_type) device_count, count(distinct order_id) unique_orders
    from cleaned group by user_id having count(*) > 1
    order by count(*) desc, avg(time_diff), user_id limit 100""",
)
def user_profiling(spark, folder):
    return round_doubles(A.user_profiling(transactions(spark, folder), 100), 4, total_amount=2)


def segment_sql(bucket: str, source: str) -> str:
    return (
        f"select {bucket} bucket, count(*) order_count, {r('avg(amount)', 4)} avg_amount, "
        f"{r('avg(time_diff)', 4)} avg_time_diff, {r(rush(), 4)} rush_hour_ratio from {source} group by 1 order by 1"
    )


@query("segment_by_amount", f"with {CLEAN} {segment_sql(AMOUNT_BAND.format('amount'), 'cleaned')}")
def segment_by_amount(spark, folder):
    return round_doubles(A.segment_by_amount(transactions(spark, folder)), 4)


@query("segment_by_score", f"with {NORM} {segment_sql(SCORE_BUCKET, 'scored')}")
def segment_by_score(spark, folder):
    return round_doubles(A.segment_by_score(norm_scored(spark, folder)), 4)


def label_sql(label: str, source: str) -> str:
    return (
        f"select n normal_count, f fraud_count, {r('n * 100.0::double / (n + f)', 4)} normal_pct, "
        f"{r('f * 100.0::double / (n + f)', 4)} fraud_pct, case when f > 0 then n // f end normal_per_fraud from "
        f"(select count(*) filter ({label} = 0) n, count(*) filter ({label} = 1) f from {source})"
    )


@query("label_distribution", f"with {CLEAN} {label_sql('is_cheat', 'cleaned')}")
def label_distribution(spark, folder):
    return round_doubles(A.label_distribution(cleaned(spark, folder)), 4)


@query("card_label_distribution", f"""with {CC} {label_sql('"Class"', "cc")}""")
def card_label_distribution(spark, folder):
    return round_doubles(A.label_distribution(cards(spark, folder), "Class"), 4)


def rates(label: str = "is_cheat") -> str:
    return (
        f"count({label}) order_count, cast(sum({label}) as bigint) fraud_count, "
        f"{r(f'avg({label}) * 100', 4)} fraud_rate_pct"
    )


@query(
    "device_fraud_rate",
    f"""with {CLEAN} select device_type, {rates()}, {r("avg(amount)", 4)} avg_amount, {r("avg(time_diff)", 4)} avg_time_diff
    from cleaned group by 1""",
)
def device_fraud_rate(spark, folder):
    return round_doubles(A.device_fraud_rate(cleaned(spark, folder)), 4)


def binned_sql(names: list[str], bin_of: str, mean: str) -> str:
    domain = " union all ".join(f"select {i} bin_id, '{n}' bin" for i, n in enumerate(names))
    picked = f", {r(f'avg({mean})', 4)} avg_{mean}" if mean else ""
    shown = f", avg_{mean}" if mean else ""
    return (
        f"select bin_id, d.bin, coalesce(order_count, 0) order_count, coalesce(fraud_count, 0) fraud_count, fraud_rate_pct{shown} "
        f"from ({domain}) d left join (select {bin_of} bin, {rates()}{picked} from cleaned group by 1) g on d.bin = g.bin"
    )


@query("hour_bin_fraud_rate", f"with {CLEAN} {binned_sql(['00-06', '06-12', '12-18', '18-24'], HOUR_BIN, 'amount')}")
def hour_bin_fraud_rate(spark, folder):
    return round_doubles(A.hour_bin_fraud_rate(cleaned(spark, folder)), 4)


AMOUNT_NAMES = ["0-500", "500-1000", "1000-1500", "1500-2000", "2000-3000"]


@query("amount_bin_fraud_rate", f"with {CLEAN} {binned_sql(AMOUNT_NAMES, AMOUNT_BIN.format('amount'), '')}")
def amount_bin_fraud_rate(spark, folder):
    return round_doubles(A.amount_bin_fraud_rate(cleaned(spark, folder)), 4)


@query(
    "hourly_fraud_rate",
    f"with {CLEAN} select order_time as hour, count(is_cheat) order_count, {r('avg(is_cheat) * 100', 4)} fraud_rate_pct from cleaned group by 1",
)
def hourly_fraud_rate(spark, folder):
    return round_doubles(A.hourly_fraud_rate(cleaned(spark, folder)), 4)


CARD_HOUR = """cast(floor(("Time" % 86400) / 3600) as integer)"""


@query("card_hourly_fraud", f"""with {CC} select {CARD_HOUR} as hour, {rates('"Class"')} from cc group by 1""")
def card_hourly_fraud(spark, folder):
    return round_doubles(A.card_hourly_fraud(cards(spark, folder)), 4)


def describe_sql(column: str) -> str:
    quartiles = ", ".join(
        f"{r(f'quantile_cont({column}, {p})', 4)} {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    )
    return (
        f'count({column}) "count", {r(f"avg({column})", 4)} mean, {r(f"stddev_samp({column})", 4)} std, '
        f'{r(f"min({column})", 4)} "min", {r(f"max({column})", 4)} "max", {quartiles}'
    )


@query("class_describe", f"""with {CC} select "Class", {describe_sql('"Amount"')} from cc group by 1""")
def class_describe(spark, folder):
    return round_doubles(A.class_describe(cards(spark, folder)), 4)


NUMERIC = ["amount", "time_diff", "order_time"]


@query(
    "distribution_shape",
    f"with {CLEAN} "
    + " union all ".join(
        f"select '{c}' as \"column\", {describe_sql(c)}, {r(f'skewness({c})', 4)} skewness, {r(f'kurtosis({c})', 4)} kurtosis from cleaned"
        for c in NUMERIC
    ),
)
def distribution_shape(spark, folder):
    return round_doubles(A.distribution_shape(cleaned(spark, folder), NUMERIC), 4)


@query(
    "table_describe",
    f"with {TX} "
    + " union all ".join(f"select '{c}' as \"column\", {describe_sql(c)} from tx" for c in [*NUMERIC, "is_cheat"]),
)
def table_describe(spark, folder):
    return round_doubles(A.describe(transactions(spark, folder), [*NUMERIC, "is_cheat"]), 4)


CORRELATED = ["amount", "time_diff", "order_time", "is_cheat"]


@query(
    "correlation_matrix",
    f"with {CLEAN} "
    + " union all ".join(
        f"select '{a}' column_a, '{b}' column_b, {'max(1.0::double)' if a == b else r(f'corr({a}, {b})')} correlation from cleaned"
        for a in CORRELATED
        for b in CORRELATED
    ),
)
def correlation_matrix(spark, folder):
    return round_doubles(A.correlation_matrix(cleaned(spark, folder), CORRELATED))


# The card features that are looked at together.
CARD_FEATURES = (1, 2, 3, 4, 7, 10, 11, 12, 14, 17)
CARD_COLUMNS = [*[f"V{i}" for i in CARD_FEATURES], "Amount", "Class"]


def pairs_sql(cells: str) -> str:
    return f"""{cells}
    select a.name column_a, b.name column_b, {r("case when a.name = b.name then 1.0::double else corr(a.v, b.v) end")} correlation
    from cells a join cells b using (vec_id) group by a.name, b.name"""


@query(
    "card_correlation_matrix",
    pairs_sql(
        f"""with {CC}, cells as (
      select vec_id, 'V' || i as name, V[i] v from cc cross join (select unnest({list(CARD_FEATURES)}) i)
      union all select vec_id, 'Amount', "Amount" from cc union all select vec_id, 'Class', "Class" from cc)"""
    ),
)
def card_correlation_matrix(spark, folder):
    values = F.array(*[F.col("V")[i - 1] for i in CARD_FEATURES], F.col("Amount"), F.col("Class").cast("double"))
    return round_doubles(A.vector_correlation(cards(spark, folder), values, CARD_COLUMNS))


@query(
    "embedding_correlation_matrix",
    pairs_sql("with cells as (select vec_id, 'V' || i as name, embedding[i]::double v from embeddings cross join range(1, 65) t(i))"),
)
def embedding_correlation_matrix(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return round_doubles(A.vector_correlation(vectors, F.col("embedding"), [f"V{i}" for i in range(1, 65)]))


@query(
    "card_amount_shape",
    f"""with {CC} select 'Amount' as "column", {describe_sql('"Amount"')}, {r('skewness("Amount")', 4)} skewness,
    {r('kurtosis("Amount")', 4)} kurtosis from cc""",
)
def card_amount_shape(spark, folder):
    return round_doubles(A.distribution_shape(cards(spark, folder), ["Amount"]), 4)


@query(
    "label_correlation_topk",
    f"""with {CC}, cells as (
      select 'V' || i feature, V[i] v, "Class" y from cc cross join range(1, 29) t(i)
      union all select 'Time', "Time", "Class" from cc
      union all select 'Amount', "Amount", "Class" from cc)
    select feature, {r("c")} abs_correlation from (select feature, abs(corr(v, y)) c from cells group by 1)
    order by c desc, feature limit 10""",
)
def label_correlation_topk(spark, folder):
    return round_doubles(A.label_correlation_topk(cards(spark, folder), "V", "Class", ["Time", "Amount"], 10))


def compare_sql(name: str, source: str, amount: str, label: str) -> str:
    fraud, normal = f"avg({amount}) filter ({label} = 1)", f"avg({amount}) filter ({label} = 0)"
    return (
        f"select '{name}' dataset, count(*) total_rows, {r(f'avg({label}) * 100', 4)} fraud_pct, {r(normal, 4)} normal_mean, "
        f"{r(fraud, 4)} fraud_mean, {r(f'{fraud} / {normal}', 4)} multiple from {source}"
    )


@query(
    "dataset_comparison",
    f"""with {CLEAN}, {CC} {compare_sql("orders", "cleaned", "amount", "is_cheat")}
    union all {compare_sql("cards", "cc", '"Amount"', '"Class"')}""",
)
def dataset_comparison(spark, folder):
    return round_doubles(
        A.dataset_comparison(
            {"orders": (cleaned(spark, folder), "amount", "is_cheat"), "cards": (cards(spark, folder), "Amount", "Class")}
        ),
        4,
    )


@query(
    "union_datasets",
    f"""with {CLEAN}, {CC} select 'orders' dataset, order_id as key, {r("amount", 4)} amount, is_cheat as label from cleaned
    union all select 'cards', cast(vec_id as varchar), {r('"Amount"', 4)}, "Class" from cc""",
)
def union_datasets(spark, folder):
    orders = cleaned(spark, folder).select(
        F.lit("orders").alias("dataset"), F.col("order_id").alias("key"), "amount", F.col("is_cheat").alias("label")
    )
    card = cards(spark, folder).select(
        F.col("Class").alias("label"), F.col("Amount").alias("amount"), F.col("vec_id").cast("string").alias("key"),
        F.lit("cards").alias("dataset"),
    )
    return round_doubles(A.union_datasets([orders, card]), 4)


def histogram_sql(source: str, column: str, n: int, where: str = "true") -> str:
    """CTE body (bin_id, lower, upper, center, count, total, mean, std) of an equal-width histogram."""
    return f"""select i bin_id, lo + i * w lower, lo + i * w + w upper, lo + i * w + w / 2 center, coalesce(c, 0) "count",
      total, mean, std from (select lo, (hi - lo) / {n} w, total, mean, std from
        (select min({column}) lo, max({column}) hi, count(*) total, avg({column}) mean, stddev_pop({column}) std from {source} where {where}))
      cross join range(0, {n}) t(i)
      left join (select least(cast(floor(({column} - lo) / ((hi - lo) / {n})) as bigint), {n - 1}) b, count(*) c
        from (select {column} from {source} where {where})
        cross join (select min({column}) lo, max({column}) hi from {source} where {where}) group by 1) g on g.b = t.i"""


@query(
    "score_histogram",
    f"""with {NORM} select cast(bin_id as integer) bin_id, {r("lower")} lower, {r("upper")} upper, {r("center")} center, "count", total,
    {r("mean", 4)} mean, {r("std", 4)} std from ({histogram_sql("scored", "anomaly_score", 50)})""",
)
def score_histogram(spark, folder):
    return round_doubles(A.histogram(norm_scored(spark, folder), "anomaly_score", 50), mean=4, std=4)


def density_sql(source: str, column: str, label: str, bins: dict[int, int], extra: str) -> str:
    return " union all ".join(
        f"""select {k} class, cast(bin_id as integer) bin_id, {r("center", 4)} center, "count",
        {r('"count" / (total * (upper - lower))')} density
        from ({histogram_sql(source, column, n, f"{label} = {k} and {extra}")})"""
        for k, n in bins.items()
    )


@query("class_density_histogram", f"with {CLEAN} {density_sql('cleaned', 'amount', 'is_cheat', {0: 50, 1: 30}, 'true')}")
def class_density_histogram(spark, folder):
    return round_doubles(A.class_density_histogram(cleaned(spark, folder), "amount", "is_cheat", {0: 50, 1: 30}), center=4)


@query(
    "card_density_histogram",
    f"""with {CC} {density_sql("cc", '"Amount"', '"Class"', {0: 50, 1: 30}, '"Amount" < 500')}""",
)
def card_density_histogram(spark, folder):
    return round_doubles(
        A.class_density_histogram(cards(spark, folder), "Amount", "Class", {0: 50, 1: 30}, below=500), center=4
    )


@query(
    "card_density_wide",
    f"""with {CC} {density_sql("cc", '"Amount"', '"Class"', {0: 100, 1: 50}, '"Amount" <= 2500')}""",
)
def card_density_wide(spark, folder):
    return round_doubles(
        A.class_density_histogram(cards(spark, folder), "Amount", "Class", {0: 100, 1: 50}, up_to=2500), center=4
    )


def boxplot_sql(source: str, column: str, label: str) -> str:
    return f"""select {label}, {r("q1", 4)} q1, {r("med", 4)} median, {r("q3", 4)} q3,
      {r(f"min({column}) filter (inside)", 4)} whisker_low, {r(f"max({column}) filter (inside)", 4)} whisker_high,
      count(*) filter (not inside) outliers
    from (select s.{label}, {column}, q1, med, q3,
            {column} between q1 - 1.5::double * (q3 - q1) and q3 + 1.5::double * (q3 - q1) inside
          from {source} s join (select {label}, quantile_cont({column}, 0.25) q1, quantile_cont({column}, 0.5) med,
             quantile_cont({column}, 0.75) q3 from {source} group by 1) q on s.{label} = q.{label})
    group by {label}, q1, med, q3"""


@query("class_boxplot", f"with {CLEAN} {boxplot_sql('cleaned', 'amount', 'is_cheat')}")
def class_boxplot(spark, folder):
    return round_doubles(A.class_boxplot(cleaned(spark, folder), "amount", "is_cheat"), 4)


@query("class_gap_boxplot", f"with {CLEAN} {boxplot_sql('cleaned', 'time_diff', 'is_cheat')}")
def class_gap_boxplot(spark, folder):
    return round_doubles(A.class_boxplot(cleaned(spark, folder), "time_diff", "is_cheat"), 4)


@query("card_boxplot", f"""with {CC} {boxplot_sql("cc", '"Amount"', '"Class"')}""")
def card_boxplot(spark, folder):
    return round_doubles(A.class_boxplot(cards(spark, folder), "Amount", "Class"), 4)


@query("class_hour_counts", f"""with {CC} select "Class", {CARD_HOUR} as hour, count(*) "count" from cc group by 1, 2""")
def class_hour_counts(spark, folder):
    return A.class_hour_counts(cards(spark, folder))


def decile_sql(extra: str) -> str:
    return f"""select cast(i as integer) bin_id, coalesce(c, 0) "count" from range(0, 10) t(i) left join (
      select k, count(*) c from (
        select case {" ".join(f"when anomaly_score >= {i / 10}::double and anomaly_score < {(i + 1) / 10}::double then {i}" for i in range(10))} {extra} end k
        from scored) where k is not null group by 1) g on g.k = t.i"""


@query("decile_histogram", f"with {RULE} {decile_sql('')}")
def decile_histogram(spark, folder):
    return A.decile_histogram(rule_scored(spark, folder))


@query("decile_histogram_closed", f"with {RULE} {decile_sql('when anomaly_score = 1 then 9')}")
def decile_histogram_closed(spark, folder):
    return A.decile_histogram(rule_scored(spark, folder), closed_right=True)
