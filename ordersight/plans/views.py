"""The views the registered queries start from, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.functions.features import with_rule_score
from ordersight.operators.quality import clean
from ordersight.operators.scores import maxnorm_score
from ordersight.operators.series import daily_rollup
from ordersight.sources.tables import card_transactions, table, transactions

# The smallest gap in the given tables is 8 seconds, so the rule uses a wider one there.
GAP_LT = 2000.0


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return clean(transactions(spark, folder))


def rule_scored(spark: SparkSession, folder: str) -> DataFrame:
    return with_rule_score(cleaned(spark, folder), gap_lt=GAP_LT)


def norm_scored(spark: SparkSession, folder: str) -> DataFrame:
    return maxnorm_score(cleaned(spark, folder))


def cards(spark: SparkSession, folder: str) -> DataFrame:
    return card_transactions(spark, folder)


def daily(spark: SparkSession, folder: str, empty: str = "zero") -> DataFrame:
    """Daily series of order totals per order priority."""
    orders = table(spark, folder, "orders")
    return daily_rollup(
        orders, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), empty=empty
    )


def daily_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    """Daily series of order totals per customer nation and priority: many series side by side."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, folder, "orders").join(customers, "o_custkey")
    key = F.concat_ws("|", F.col("c_nationkey").cast("string"), "o_orderpriority")
    return daily_rollup(orders, key, F.col("o_orderdate"), F.col("o_totalprice"))


def daily_tx(spark: SparkSession, folder: str) -> DataFrame:
    """Daily series of transactions per device."""
    return daily_rollup(
        transactions(spark, folder), F.col("device_type"), F.col("ts"), F.col("amount"), F.col("order_time")
    )


TX = """
tx as (
  select 'U' || lpad(cast(user_id as varchar), 6, '0') user_id,
         'O' || lpad(cast(event_id as varchar), 8, '0') order_id,
         value amount,
         (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6 time_diff,
         cast(hour(ts) as integer) order_time,
         list_extract(['iOS','Android','PC','H5','Other'],
            (cast(json_extract_string(props, '$.k') as integer) % 5) + 1) device_type,
         case when event_type = 'error' then 1 else 0 end is_cheat,
         ts
  from events)"""

CLEAN = TX + """,
cleaned as (
  select user_id, order_id, amount, time_diff, order_time, device_type, coalesce(is_cheat, 0) is_cheat, ts
  from tx where amount is not null and time_diff is not null)"""

FEATURE = CLEAN + """,
features as (
  select order_id, ln(1 + amount) log_amount, time_diff,
         case when order_time between 1 and 6 then 1 else 0 end is_rush_hour,
         case device_type when 'iOS' then 0 when 'Android' then 1 when 'PC' then 2 when 'H5' then 3 else 1 end device_code
  from cleaned)"""

RULE = CLEAN + """,
scored as (
  select *, case when anomaly_score > 0.5 then 1 else 0 end is_anomaly from (
    select *, least(cast(1.0 as double),
       case when amount < 20 then cast(0.4 as double) else cast(0.1 as double) end
       + case when time_diff < 2000 then cast(0.4 as double) else cast(0.1 as double) end
       + case when order_time between 1 and 6 then cast(0.2 as double) else cast(0.0 as double) end) anomaly_score
    from cleaned))"""

NORM = CLEAN + """,
scored as (
  select c.*, (amount / ma + time_diff / mt) / 2 anomaly_score
  from cleaned c cross join (select max(amount) ma, max(time_diff) mt from cleaned))"""

CC = """
joined as (
  select e.vec_id, epoch_us(v.ts) us, list_transform(e.embedding[1:28], lambda x: cast(x as double)) V, v.value "Amount",
         case when e.label = 0 then 1 else 0 end "Class"
  from embeddings e join events v on e.vec_id = v.event_id),
cc as (
  select vec_id, (us - (select min(us) from joined)) / 1e6 "Time", V, "Amount", "Class" from joined)"""

DAILY_ROWS = """
per_day as (
  select o_orderpriority series_key, cast(o_orderdate as date) as date,
         round(sum(o_totalprice) + 1e-9, 2) daily_amount, count(o_totalprice) daily_count,
         round(avg(o_totalprice) + 1e-9, 2) avg_price, cast(0 as double) rush_ratio
  from orders group by all),
spine as (
  select series_key, cast(unnest(generate_series(a, b, interval 1 day)) as date) as date
  from (select series_key, min(date) a, max(date) b from per_day group by 1)),
sparse as (
  select s.series_key, s.date, daily_amount, daily_count, avg_price, rush_ratio
  from spine s left join per_day p on s.series_key = p.series_key and s.date = p.date)"""

DAILY = DAILY_ROWS + """,
daily as (
  select series_key, date, coalesce(daily_amount, 0) daily_amount, coalesce(daily_count, 0) daily_count,
         coalesce(avg_price, 0) avg_price, coalesce(rush_ratio, 0) rush_ratio from sparse)"""

DAILY_BY_NATION = DAILY.replace("o_orderpriority series_key", "c_nationkey || '|' || o_orderpriority series_key").replace(
    "from orders group by all", "from orders join customer on o_custkey = c_custkey group by all"
)


def r(expression: str, places: int = 6) -> str:
    """SQL of the rounding rule: half up after a tiny offset."""
    return f"round(({expression}) + 1e-9, {places})"


def rush(hour: str = "order_time") -> str:
    return f"avg(case when {hour} between 1 and 6 then 1.0::double else 0.0::double end)"
