"""Registered queries: scans, sinks, cleaning and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordersight.functions.rounding import round_doubles
from ordersight.operators import quality as Q
from ordersight.plans.registry import query
from ordersight.plans.views import CC, CLEAN, TX, cards, cleaned, r
from ordersight.schemas import TX_SCHEMA, V_COLUMNS
from ordersight.session import fresh_dir
from ordersight.sources import files
from ordersight.sources.tables import table, transactions

TX_COLUMNS = TX_SCHEMA.names
TX_LIST = ", ".join(TX_COLUMNS)
GAP = r("time_diff", 4)
TX_OUT = f"user_id, order_id, {r('amount', 4)} amount, {GAP} time_diff, order_time, device_type, is_cheat"


def wide_cards(cc):
    return cc.select("Time", *[F.col("V")[i].alias(v) for i, v in enumerate(V_COLUMNS)], "Amount", "Class")


WIDE_CC = ", ".join(f'V[{i + 1}] "{v}"' for i, v in enumerate(V_COLUMNS))


@query("scan_csv", f"with {TX} select {TX_OUT} from tx")
def scan_csv(spark, folder):
    path = fresh_dir(spark, "orders-csv")
    transactions(spark, folder).select(*TX_COLUMNS).write.option("header", True).csv(path)
    return round_doubles(files.scan_csv(spark, path), 4)


@query(
    "scan_card_csv",
    f"""with {CC}, wide as (select "Time", {WIDE_CC}, "Amount", "Class" from cc)
    select {r('"Time"')} "Time", {", ".join(f'{r(v)} "{v}"' for v in V_COLUMNS)}, {r('"Amount"')} "Amount", "Class" from wide""",
)
def scan_card_csv(spark, folder):
    path = fresh_dir(spark, "cards-csv")
    wide_cards(cards(spark, folder)).write.option("header", True).csv(path)
    return round_doubles(files.scan_card_csv(spark, path))


@query("load_first_available", "select event_id, user_id, event_type, round(value, 4) value from events")
def load_first_available(spark, folder):
    loaders = [lambda: table(spark, folder, "no_such_table"), lambda: table(spark, folder, "events")]
    return round_doubles(files.load_first_available(loaders).select("event_id", "user_id", "event_type", "value"), 4)


@query(
    "register_view",
    "select event_type, count(*) n from events group by 1",
)
def register_view(spark, folder):
    view = files.register_view(spark, "ordersight_events", table(spark, folder, "events"), keep=False)
    return view.sparkSession.sql("select event_type, count(*) n from ordersight_events group by event_type")


@query("ingest_dataset", "select count(*) total_rows, 7 total_columns from events")
def ingest_dataset(spark, folder):
    return files.ingest_dataset(transactions(spark, folder).select(*TX_COLUMNS), fresh_dir(spark, "ingested"))


@query("clean_transactions", f"with {CLEAN} select {TX_OUT} from cleaned")
def clean_transactions(spark, folder):
    return round_doubles(cleaned(spark, folder).select(*TX_COLUMNS), 4)


@query(
    "clean_counts",
    f"""with {TX} select count(*) total_rows,
    count(*) filter (amount is not null and time_diff is not null) cleaned_rows,
    count(*) filter (amount is null or time_diff is null) removed_rows from tx""",
)
def clean_counts(spark, folder):
    return Q.clean_counts(transactions(spark, folder))


@query(
    "null_profile",
    f"with {TX} "
    + " union all ".join(
        f"select '{c}' as \"column\", count(*) filter ({c} is null) null_count, "
        f"{r(f'count(*) filter ({c} is null) * 100.0::double / count(*)', 2)} null_pct, count(*) total_rows from tx"
        for c in TX_COLUMNS
    ),
)
def null_profile(spark, folder):
    return round_doubles(Q.null_profile(transactions(spark, folder).select(*TX_COLUMNS)), 2)


SPARK_TYPES = dict(zip(TX_COLUMNS, ("string", "string", "double", "double", "int", "string", "int"), strict=True))


@query(
    "schema_profile",
    f"with {TX} "
    + " union all ".join(
        f"select {i} as position, '{c}' as \"column\", '{SPARK_TYPES[c]}' as type, count({c}) non_null, count(*) total_rows from tx"
        for i, c in enumerate(TX_COLUMNS)
    ),
)
def schema_profile(spark, folder):
    return Q.schema_profile(transactions(spark, folder).select(*TX_COLUMNS))


@query(
    "drop_null_rows",
    f"with {TX} select {TX_OUT} from tx where "
    + " and ".join(f"{c} is not null" for c in TX_COLUMNS),
)
def drop_null_rows(spark, folder):
    return round_doubles(Q.drop_null_rows(transactions(spark, folder).select(*TX_COLUMNS)), 4)




@query(
    "duplicate_count",
    f"""select cast(sum(n) as bigint) total_rows, cast(sum(n - 1) as bigint) duplicate_rows,
    {r("sum(n - 1) * 100.0::double / sum(n)", 4)} duplicate_pct
    from (select *, count(*) n from lineitem group by all)""",
)
def duplicate_count(spark, folder):
    return round_doubles(Q.duplicate_count(table(spark, folder, "lineitem")), 4)


@query("drop_duplicates", "select distinct * replace (cast(l_shipdate as varchar) as l_shipdate) from lineitem")
def drop_duplicates(spark, folder):
    rows = Q.drop_duplicates(table(spark, folder, "lineitem"))
    return rows.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@query("distinct_rows", f"with {TX} select distinct user_id, order_time, device_type from tx")
def distinct_rows(spark, folder):
    return transactions(spark, folder).select("user_id", "order_time", "device_type").distinct()


def iqr_sql(source: str, column: str) -> str:
    name = column.replace('"', "")
    q1, q3 = f"quantile_cont({column}, 0.25)", f"quantile_cont({column}, 0.75)"
    bounds = f"(select {q1} - 1.5::double * ({q3} - {q1}) lo, {q3} + 1.5::double * ({q3} - {q1}) hi from {source})"
    return (
        f"select '{name}' as \"column\", count(*) filter ({column} < lo or {column} > hi) outliers, "
        f"{r('any_value(lo)', 4)} lower, {r('any_value(hi)', 4)} upper from {source} cross join {bounds}"
    )


@query("iqr_outliers", f"with {CLEAN} {iqr_sql('cleaned', 'amount')} union all {iqr_sql('cleaned', 'time_diff')}")
def iqr_outliers(spark, folder):
    return round_doubles(Q.iqr_outliers(cleaned(spark, folder), ["amount", "time_diff"]), 4)


@query("card_iqr_outliers", f"""with {CC} {iqr_sql('cc', '"Amount"')} union all {iqr_sql('cc', '"Time"')}""")
def card_iqr_outliers(spark, folder):
    return round_doubles(Q.iqr_outliers(cards(spark, folder), ["Amount", "Time"]), 4)


TEXT_TYPES = {"order_time": "int", "is_cheat": "int", "device_type": "int"}


@query(
    "coerce_types",
    f"""with {TX} select order_id, try_cast(cast(order_time as varchar) as integer) order_time,
    try_cast(cast(is_cheat as varchar) as integer) is_cheat, try_cast(device_type as integer) device_type from tx""",
)
def coerce_types(spark, folder):
    tx = transactions(spark, folder).select(
        "order_id", F.col("order_time").cast("string"), F.col("is_cheat").cast("string"), "device_type"
    )
    return Q.coerce_types(tx, TEXT_TYPES)


@query(
    "coercion_failures",
    f"with {TX} "
    + " union all ".join(
        f"select '{c}' as \"column\", 'int' as type, count(*) filter ({c} is not null and "
        f"try_cast(cast({c} as varchar) as integer) is null) failed from tx"
        for c in TEXT_TYPES
    ),
)
def coercion_failures(spark, folder):
    tx = transactions(spark, folder).select(
        F.col("order_time").cast("string"), F.col("is_cheat").cast("string"), "device_type"
    )
    return Q.coercion_failures(tx, TEXT_TYPES)


def report_sql(name: str, source: str, columns: list[str], label: str) -> str:
    nulls = " + ".join(f"case when {c} is null then 1 else 0 end" for c in columns)
    return (
        f"select '{name}' dataset, cast(sum(n) as bigint) total_rows, cast(sum(({nulls}) * n) as bigint) null_cells, "
        f"cast(sum(n - 1) as bigint) duplicate_rows, {r(f'sum({label} * n) * 100.0::double / sum(n)', 4)} label_pct "
        f"from (select {', '.join(columns)}, count(*) n from {source} group by all)"
    )


CARD_KEYS = ['"Time"', "V", '"Amount"', '"Class"']


@query(
    "quality_report",
    f"""with {TX}, {CC} {report_sql("orders", "tx", TX_COLUMNS, "is_cheat")}
    union all {report_sql("cards", "cc", CARD_KEYS, '"Class"')}""",
)
def quality_report(spark, folder):
    tx = transactions(spark, folder).select(*TX_COLUMNS)
    cc = cards(spark, folder).select("Time", "V", "Amount", "Class")
    return round_doubles(Q.quality_report({"orders": (tx, "is_cheat"), "cards": (cc, "Class")}), 4)
