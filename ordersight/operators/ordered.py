"""Ordered operators that stay balanced when one key or range holds most rows.

A plain window puts a whole key in one task. Here rows are range-partitioned by (key, order), so a large key
spans as many tasks as its rows need; each range is handled on its own, and what the ranges before it left
behind (one row each) carries the result across their borders. Tables of every size take this one path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.session import cut

ROWS_PER_TASK = 1_000_000
SLACK = 0.004  # half the width of a quantile's first bracket, as a share of the rows
WIDER = 16


def ranged(df: DataFrame, order: list[str], rows_per_task: int | None = None) -> DataFrame:
    """Add ``_part``: number of the row's range of ``order``, ascending; ranges hold similar row counts.

    Spark's range partitioner samples the borders, and adaptive execution merges small ranges, so there are
    at most ``spark.sql.shuffle.partitions`` of them unless ``rows_per_task`` asks for others. Borders are drawn anew
    whenever the plan runs: write the result before using it twice.
    """
    if rows_per_task is None:
        spread = df.repartitionByRange(*order)
    else:
        spread = df.repartitionByRange(max(1, -(-df.count() // rows_per_task)), *order)
    return spread.withColumn("_part", F.spark_partition_id())


def previous_in_key(
    df: DataFrame,
    key: str,
    order: str,
    tie: str,
    result: str,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add ``result``: ``order`` of the previous row of the same ``key`` (null for the first of a key).

    Rows are ordered by ``order`` then ``tie``, which must be unique in a key; nulls come first, and the null key
    is a key like any other. Hot keys, and keys with many rows at one ``order``, are cut like the rest. The rows are
    written once, with the lag inside their range; only the first row of a range looks at the end of the one before.
    """
    here = F.struct(F.col(key).alias("key"), F.col(order).alias("at"))
    inside = Window.partitionBy("_part").orderBy(key, order, tie)
    lagged = cut(ranged(df, [key, order, tie], rows_per_task).withColumn("_inside", F.lag(here).over(inside)))
    # one row per range, so that this window and the broadcast hold as many rows as one shuffle has tasks
    ends = lagged.groupBy("_part").agg(F.max(here).alias("_end"))
    borders = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_border"))
    before = F.coalesce("_inside", "_border")
    found = F.when(before["key"].eqNullSafe(F.col(key)), before["at"])
    return lagged.join(F.broadcast(borders), "_part", "left").select(*df.columns, found.alias(result))


def counted_values(
    df: DataFrame,
    value: str,
    by: list[str],
    extra: dict[str, Column] | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """One row per (``by``, value) with the counts of that value, of all smaller ones and of the group.

    Columns: ``by``, ``value`` and, for the row count ``n`` and each additive aggregate in ``extra``,
    ``<name>``, ``<name>_before`` and ``<name>_total``. Equal values collapse before the shuffle; the running totals
    are taken inside ranges of (``by``, value), written once and shifted by the totals of the ranges before.
    """
    aggregates = {"n": F.count("*"), **(extra or {})}
    grouped = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("value"))
        .agg(*[agg.alias(name) for name, agg in aggregates.items()])
    )
    inside = Window.partitionBy(*by, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_before") for c in aggregates]
    running = cut(ranged(grouped, [*by, "value"], rows_per_task).select("*", *before))
    # ranges are in the order of the groups: all groups together have one row per range and one more each
    across = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    shifts = (
        running.groupBy(*by, "_part")
        .agg(*[F.sum(c).alias(f"_{c}") for c in aggregates])
        .select(
            *by,
            "_part",
            *[F.coalesce(F.sum(f"_{c}").over(across), F.lit(0)).alias(f"_{c}_shift") for c in aggregates],
            *[F.sum(f"_{c}").over(group).alias(f"{c}_total") for c in aggregates],
        )
    )
    # null-safe, so that the null group keeps its rows
    keys = [*by, "_part"]
    shifts = shifts.withColumnsRenamed({c: f"_shift_{c}" for c in keys})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_shift_{c}")) for c in keys])
    return running.join(shifts, same).select(
        *by,
        "value",
        *aggregates,
        *[(F.col(f"{c}_before") + F.col(f"_{c}_shift")).alias(f"{c}_before") for c in aggregates],
        *[f"{c}_total" for c in aggregates],
    )


def _brackets(values: DataFrame, keys: list[str], probabilities: list[float], slack: float) -> DataFrame:
    """``keys``, row count ``n``, and bounds ``low`` and ``high`` around each probability, from a mergeable sketch.

    The sketch errs by a quarter of ``slack`` at most. Groups too small for that margin take their whole range.
    """
    ends = [[min(1.0, max(0.0, p + side * slack)) for p in probabilities] for side in (-1, 1)]
    sketch = F.percentile_approx("v", [*ends[0], *ends[1]], max(1, round(4 / slack)))
    stats = values.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), sketch.alias("at"))
    k, tight = len(probabilities), F.col("n") * slack >= 4
    low = F.array(*[F.when(tight & F.lit(p > slack), F.col("at")[i]).otherwise(F.col("least")) for i, p in enumerate(probabilities)])
    high = F.array(
        *[F.when(tight & F.lit(p < 1 - slack), F.col("at")[k + i]).otherwise(F.col("most")) for i, p in enumerate(probabilities)]
    )
    return stats.select(*keys, "n", low.alias("low"), high.alias("high"))


def _picked(values: DataFrame, brackets: DataFrame, keys: list[str], names: dict[str, float], rows_per_task, discrete) -> DataFrame:
    """One row per group and probability with the neighbours of its rank, null where the bracket misses them."""
    own = brackets.withColumnsRenamed({c: f"_{c}" for c in keys})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    bounds = F.array(
        *[F.struct(F.lit(name).alias("p"), F.col("low")[i].alias("low"), F.col("high")[i].alias("high")) for i, name in enumerate(names)]
    )
    each = values.join(own, same).select(*keys, "v", F.inline(bounds))
    # all values below a bracket are one row of each task; only those inside are told apart
    inside = F.when(F.col("v") >= F.col("low"), F.col("v"))
    counts = cut(each.where("v <= high").groupBy(*keys, "p", inside.alias("v")).agg(F.count(F.lit(1)).alias("c")))
    groups = [*keys, "p"]
    below = counts.groupBy(*groups).agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below"))
    below = below.withColumnsRenamed({c: f"_{c}" for c in groups})
    counted = counted_values(counts, "v", groups, {"c": F.sum("c")}, rows_per_task)
    at_group = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in groups])
    counted = counted.join(below, at_group).drop(*[f"_{c}" for c in groups]).join(own.select("n", *[f"_{c}" for c in keys]).withColumnRenamed("n", "all"), same)
    share = F.create_map(*[F.lit(x) for pair in names.items() for x in (pair[0], float(pair[1]))])[F.col("p")]
    target = F.greatest(F.ceil(F.col("all") * share) - 1, F.lit(0)) if discrete else (F.col("all") - 1) * share
    first = F.col("below") + F.col("c_before")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < first + F.col("c")), F.col("value")))

    return counted.groupBy(*groups).agg(
        at(F.floor(target)).alias("lo"), at(F.ceil(target)).alias("hi"), F.max(target - F.floor(target)).alias("w")
    )


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: dict[str, float],
    by: list[str] | None = None,
    rows_per_task: int | None = None,
    discrete: bool = False,
) -> DataFrame:
    """Exact quantiles, long form: ``by``, ``column``, one column per probability.

    Linear interpolation between neighbours, or with ``discrete`` the first value whose cumulative
    share reaches the probability. Selection in two passes over the written columns: a sketch brackets each
    probability, then values below the bracket are counted and only those inside are collapsed and ordered.
    A bracket that misses its rank (the sketch's bound rules it out but for NaN, which no sketch orders) is
    widened, in the end to the whole range, so the result does not rest on the sketch.
    """
    by = by or []
    groups, cells = [f"_by{i}" for i in range(len(by))], [f"_v{i}" for i in range(len(columns))]
    keys = [*groups, "_column"]  # private names: those of the caller's columns cannot clash
    of = [F.col(c).alias(g) for c, g in zip(by, groups, strict=True)]
    narrow = cut(df.select(*of, *[F.col(c).cast("double").alias(v) for c, v in zip(columns, cells, strict=True)]))
    pairs = [F.struct(F.lit(c).alias("_column"), F.col(v).alias("v")) for c, v in zip(columns, cells, strict=True)]
    values = narrow.select(*groups, F.inline(F.array(*pairs))).where("v is not null")
    slack = SLACK
    while True:
        brackets = cut(_brackets(values, keys, list(probabilities.values()), slack))
        picked = cut(_picked(values, brackets, keys, probabilities, rows_per_task, discrete))
        if slack >= 1 or picked.where("lo is null or hi is null").isEmpty():
            break
        slack *= WIDER
    value = F.col("lo") if discrete else F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")
    found = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == name, value)).alias(name) for name in probabilities])
    names = [F.col(g).alias(c) for g, c in zip(keys, [*by, "column"], strict=True)]
    return found.select(*names, *probabilities)
