"""Cleaning, profiling and data-quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.operators.ordered import exact_quantiles

REQUIRED = ["amount", "time_diff"]


def clean(df: DataFrame, label: str = "is_cheat") -> DataFrame:
    """Drop rows without amount or gap; label null becomes 0, a missing label column is added as 0."""
    kept = df.na.drop(subset=REQUIRED)
    value = F.coalesce(F.col(label).cast("int"), F.lit(0)) if label in df.columns else F.lit(0)
    return kept.withColumn(label, value)


def required_rows(df: DataFrame) -> DataFrame:
    """Rows with both amount and gap present."""
    return df.where("amount is not null and time_diff is not null")


def clean_counts(df: DataFrame) -> DataFrame:
    """Total, cleaned and removed rows in one aggregate."""
    present = F.col("amount").isNotNull() & F.col("time_diff").isNotNull()
    return df.agg(F.count("*").alias("total_rows"), F.count_if(present).alias("cleaned_rows")).withColumn(
        "removed_rows", F.col("total_rows") - F.col("cleaned_rows")
    )


def long_form(wide: DataFrame, cells: list[tuple], names: list[str]) -> DataFrame:
    """Turn one wide row per key into one row per cell; each cell lists its values in ``names`` order."""
    return wide.select(
        F.inline(F.array(*[F.struct(*[v.alias(n) for v, n in zip(cell, names, strict=True)]) for cell in cells]))
    )


def null_profile(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Null count and percentage per column, one pass."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in df.columns])
    share = lambda c: F.coalesce(F.col(f"null_{c}") / F.col("n") * 100, F.lit(0.0))
    profile = long_form(
        counts,
        [(F.lit(c), F.col(f"null_{c}"), share(c), F.col("n")) for c in df.columns],
        ["column", "null_count", "null_pct", "total_rows"],
    )
    return profile.where("null_count > 0") if only_missing else profile


def schema_profile(df: DataFrame) -> DataFrame:
    """Column position, name, type, non-null count and total rows."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"some_{c}") for c in df.columns])
    return long_form(
        counts,
        [
            (F.lit(i), F.lit(name), F.lit(kind), F.col(f"some_{name}"), F.col("n"))
            for i, (name, kind) in enumerate(df.dtypes)
        ],
        ["position", "column", "type", "non_null", "total_rows"],
    )


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier identical row, and their percentage."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn(
        "duplicate_pct", F.when(F.col("total_rows") > 0, F.col("duplicate_rows") / F.col("total_rows") * 100).otherwise(0.0)
    )


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def iqr_outliers(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Per column: rows outside [Q1 - k IQR, Q3 + k IQR] and the bounds, from exact quartiles."""
    quartiles = exact_quantiles(df, columns, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    bounds = quartiles.select("column", (F.col("q1") - k * iqr).alias("lower"), (F.col("q3") + k * iqr).alias("upper"))
    # one row per column name
    wide = bounds.groupBy().pivot("column", columns).agg(F.first("lower").alias("lower"), F.first("upper").alias("upper"))
    outside = [
        F.count_if((F.col(f"`{c}`") < F.col(f"`{c}_lower`")) | (F.col(f"`{c}`") > F.col(f"`{c}_upper`"))).alias(f"n_{c}")
        for c in columns
    ]
    keep = [F.first(f"`{c}_{side}`").alias(f"{c}_{side}") for c in columns for side in ("lower", "upper")]
    counted = df.select(*columns).crossJoin(F.broadcast(wide)).agg(*outside, *keep)
    return long_form(
        counted,
        [(F.lit(c), F.col(f"n_{c}"), F.col(f"{c}_lower"), F.col(f"{c}_upper")) for c in columns],
        ["column", "outliers", "lower", "upper"],
    )


def coerce_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the named columns; values that do not fit become null."""
    return df.select(
        *[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns]
    )


def coercion_failures(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Per cast column: values that were present but did not fit the new type."""
    counts = df.agg(
        *[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()).alias(c) for c, t in types.items()]
    )
    return long_form(
        counts, [(F.lit(c), F.lit(t), F.col(f"`{c}`")) for c, t in types.items()], ["column", "type", "failed"]
    )


def quality_report(datasets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per named dataset: rows, null cells, duplicate rows and label percentage."""
    reports = []
    for name, (df, label) in datasets.items():
        nulls = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("long") for c in df.columns])
        # every total comes out of the one grouping that finds the duplicates
        groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
        reports.append(
            groups.agg(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
                F.coalesce(F.sum(nulls * F.col("_n")), F.lit(0)).alias("null_cells"),
                F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
                (F.sum(F.coalesce(F.col(label), F.lit(0)) * F.col("_n")) / F.sum("_n") * 100).alias("label_pct"),
            ).select(F.lit(name).alias("dataset"), "*")
        )
    return reduce(DataFrame.unionByName, reports)
