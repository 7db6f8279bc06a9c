"""Mixing sources to target weights by subset-sum budget fitting.

Sources, ordered by code point with null last, weigh 1, 2, 3, 1, 2, 3 … and share the total size by
weight; a target stops at three times its source's size and the excess is shared again by weight
among the others until no target is above. A source takes all documents a whole number of times
and, for the rest of its budget, an exact subset: documents are counted by exact length, every
length gives its proportional share, a bounded knapsack over the counts fits what remains as closely
as possible from below or above, and within a length the documents with the smallest seeded hashes are
chosen. A fit that is not exact is tried again with more of the budget left to the knapsack, until all
of it is or ``WIDEST`` words are.

What meets in one task is small by construction: a source's histogram of exact lengths (its row
count is at most the square root of twice the source's size), and hash buckets of about
``BUCKET_ROWS`` rows. Hot lengths and repeated ids are cut into such buckets, never ranked whole.

A null text has size 0 and takes 0. A null source is a source of its own. Null and repeated ids are
ranked like any others; rows that agree in id, source and size are interchangeable. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.tokens import count_words
from ordersight.session import cut

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BUCKET_ROWS = 500
EXACT = 8192  # words of a budget that are left to dynamic programming at first
WIDEST = 1 << 22  # and at most, if the fit is not exact before; a megabyte of bits for each step
SMALL_ROWS = 20_000  # tables up to this many rows (about a megabyte) are broadcast


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sizes sum to ``budget`` or close to it.

    No choice comes closer for budgets up to ``WIDEST``.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    step = int(np.gcd.reduce(lengths[counts > 0]))  # every sum is a multiple of it
    unavoidable = min(budget % step, step - budget % step)
    best, least, reserve = None, total, EXACT
    while True:
        took = _fit(lengths, counts, budget, total, reserve)
        error = abs(budget - int((took * lengths).sum()))
        if best is None or error < least:
            best, least = took, error
        if least <= unavoidable or reserve >= min(budget, WIDEST):
            return best
        reserve *= 8


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, total: int, reserve: int) -> np.ndarray:
    """Proportional shares for all but about ``reserve`` words of the budget, and a knapsack for those."""
    share = [int(c) * budget for c in counts.tolist()]
    took = np.array([s // total for s in share], np.int64)
    left = budget - int((took * lengths).sum())
    by_remainder = sorted(range(len(lengths)), key=lambda i: (-(share[i] % total), -int(lengths[i])))
    for i in by_remainder:  # one more of the lengths that lost most in rounding
        if lengths[i] and took[i] < counts[i] and left - lengths[i] >= reserve:
            took[i] += 1
            left -= int(lengths[i])
    by_length = np.argsort(-lengths, kind="stable").tolist()
    for i in by_length:
        if lengths[i] and left - lengths[i] >= reserve:
            more = min(int(counts[i] - took[i]), (left - reserve) // int(lengths[i]))
            took[i] += more
            left -= more * int(lengths[i])
    if reserve > EXACT:
        for i in by_length:  # given back, for the knapsack to choose anew
            if lengths[i] and left < reserve:
                back = min(int(took[i]), -(-(reserve - left) // int(lengths[i])))
                took[i] -= back
                left += back * int(lengths[i])
    return _knapsack(lengths, counts, took, left)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, took: np.ndarray, left: int) -> np.ndarray:
    """Bounded knapsack over the counts that remain; bit s of ``reach`` says that sum s can be made.

    Sums above twice ``left`` are farther from it than none at all.
    """
    most = 2 * left
    mask, reach, steps = (1 << (most + 1)) - 1, 1, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        spare = min(int(counts[i] - took[i]), most // size) if 0 < size <= most else 0
        part = 1
        while spare > 0 and not reach >> left & 1:
            n = min(part, spare)
            wider = reach | reach << (n * size) & mask
            if wider != reach:
                steps.append((i, n, reach))
                reach = wider
            spare, part = spare - n, part * 2
    at = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    if above and (beyond := (above & -above).bit_length()) < left - at:
        at = left + beyond
    took = took.copy()
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            took[i] += n
            at -= n * int(lengths[i])
    return took


def _ranked_sources(totals: DataFrame) -> DataFrame:
    """Sources with their weight by rank; ranks come from sorted partitions, not from one task."""
    ordered = totals.orderBy(F.col("_source").asc_nulls_last())
    spark = totals.sparkSession
    schema = "_source string, source_size long, _rank long"
    ranked = spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda pair: (*pair[0], pair[1])), schema)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    return ranked.select("_source", "source_size", weight.alias("_weight"))


def with_targets(sources: DataFrame) -> DataFrame:
    """Add ``target``: the share by weight, stopped at ``MOST_COPIES`` times the size, the excess shared again."""
    most = F.col("source_size") * MOST_COPIES
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, seen = -1.0, -1
    while True:  # each round stops at least one more source, or is the last
        over = F.lit(False) if level < 0 else most <= F.col("_weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(over, most)).alias("stopped"),
            F.sum(F.when(~over, F.col("_weight"))).alias("weight"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if row["n"] == seen or not row["weight"]:
            break
        level, seen = (total - (row["stopped"] or 0)) / row["weight"], row["n"]
    share = F.least(most.cast("double"), F.col("_weight") * F.lit(max(level, 0.0)))
    return sources.withColumn("target", share)


def _quota(group: pd.DataFrame) -> pd.DataFrame:
    """Whole copies and extra documents by length, for one source's histogram."""
    size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    copies = min(MOST_COPIES, int(target // size)) if size else 0
    budget = 0 if copies == MOST_COPIES or not size else int(round(target)) - copies * size
    lengths, counts = group["size"].to_numpy(np.int64), group["_n"].to_numpy(np.int64)
    return group.assign(_copies=copies, _want=fit(lengths, counts, budget))[
        ["_source", "size", "_n", "source_size", "target", "_copies", "_want"]
    ]


def _with(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe join; the right side is broadcast only if its counted rows are few."""
    right = small.select(*[F.col(c).alias(f"_r{c}") if c in keys else F.col(c) for c in small.columns])
    right = F.broadcast(right) if small.count() <= SMALL_ROWS else right
    on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return rows.join(right, on, how).drop(*[f"_r{k}" for k in keys])


def _border(rows: DataFrame, keys: list[str], order: str, want: str, n: str) -> DataFrame:
    """Per group of ``keys`` the value of ``order`` at which ``want`` rows are reached, and what is still wanted there.

    Two levels: counts by bucket of the order's range find the bucket, counts by value inside it find the value.
    """
    wide = F.greatest(F.ceil(F.col(n) / BUCKET_ROWS), F.lit(1))
    bucket = F.floor((F.col(order) / F.lit(2.0**64) + 0.5) * wide)
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)

    def reach(counted: DataFrame, wanted: str) -> DataFrame:
        below = counted.withColumn("_below", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        hit = (F.col("_below") < F.col(wanted)) & (F.col(wanted) <= F.col("_below") + F.col("_c"))
        return below.filter(hit).withColumn("_left", F.col(wanted) - F.col("_below"))

    spread = rows.withColumn("_at", bucket)
    buckets = reach(spread.groupBy(*keys, want, "_at").agg(F.count(F.lit(1)).alias("_c")), want)
    near = _with(spread, cut(buckets.select(*keys, F.col("_at").alias("_bucket"), "_left")), keys, "inner")
    near = near.filter(F.col("_at") == F.col("_bucket"))
    values = near.groupBy(*keys, "_left", F.col(order).alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    return reach(values.withColumnRenamed("_left", "_goal"), "_goal").select(
        *keys, F.col("_at").alias("_value"), F.col("_left").alias("_ties"), F.col("_c").alias("_same")
    )


def _chosen(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Add ``_extra``: whether the row is among the ``_want`` smallest of its group by seeded hash."""
    open_ = (F.col("_want") > 0) & (F.col("_want") < F.col("_n"))
    first = _border(rows.filter(open_), keys, "_hash", "_want", "_n")
    rows = _with(rows, cut(first), keys)
    tied = rows.filter((F.col("_hash") == F.col("_value")) & (F.col("_ties") < F.col("_same")))
    second = _border(tied.drop("_value"), keys, "_row", "_ties", "_same").select(*keys, F.col("_value").alias("_last"))
    rows = _with(rows, cut(second), keys)
    at_border = F.col("_last").isNull() | (F.col("_row") <= F.col("_last"))
    below = (F.col("_hash") < F.col("_value")) | ((F.col("_hash") == F.col("_value")) & at_border)
    whole = F.col("_want") >= F.col("_n")
    return rows.withColumn("_extra", (F.col("_want") > 0) & (whole | F.coalesce(below, F.lit(False))))


def word_count(text: Column) -> Column:
    @F.arrow_udf("long")
    def size(texts: pa.Array) -> pa.Array:
        return count_words(texts)

    return size(text)


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies and taken (``copies * size`` words)."""
    sized = docs.select(
        F.col(f"`{id}`").alias("_id"),
        F.col(f"`{source}`").cast("string").alias("_source"),
        word_count(F.col(f"`{text}`").cast("string")).alias("size"),
    )
    sized = sized.withColumns(
        {
            "_hash": F.xxhash64(F.lit(seed), F.col("_id").cast("string")),
            "_row": F.xxhash64(F.lit(seed), F.monotonically_increasing_id()),
        }
    )
    sized = cut(sized)
    histogram = cut(sized.groupBy(F.col("_source"), F.col("size")).agg(F.count(F.lit(1)).alias("_n")))
    totals = histogram.groupBy("_source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    sources = cut(with_targets(cut(_ranked_sources(totals))))
    quota = (
        _with(histogram, sources.drop("_weight"), ["_source"], "inner")
        .groupBy("_source")
        .applyInPandas(_quota, "_source string, size long, _n long, source_size long, target double, _copies int, _want long")
    )
    rows = _chosen(_with(sized, cut(quota), ["_source", "size"]), ["_source", "size"], seed)
    copies = (F.col("_copies") + F.col("_extra").cast("int")).cast("long")
    return rows.select(
        F.col("_id").alias(id),
        F.col("_source").alias(source),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
