"""Scores over the whole table, score summaries and label-based evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions.rounding import tidy
from ordersight.operators.joins import broadcast_scalar
from ordersight.operators.ordered import counted_values
from ordersight.operators.quality import long_form

HIGH_SCORE = 0.8


def minmax_score(df: DataFrame, raw: str, result: str = "anomaly_score") -> DataFrame:
    """(raw - min) / (max - min), 0 when constant."""
    spread = df.agg(F.min(raw).alias("_lo"), F.max(raw).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(raw) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return broadcast_scalar(df, spread).withColumn(result, scaled).drop("_lo", "_hi")


def maxnorm_score(df: DataFrame, a: str = "amount", b: str = "time_diff", result: str = "anomaly_score") -> DataFrame:
    """Mean of two columns, each divided by its maximum."""
    top = df.agg(F.max(a).alias("_a"), F.max(b).alias("_b"))
    score = (F.col(a) / F.col("_a") + F.col(b) / F.col("_b")) / 2
    return broadcast_scalar(df, top).withColumn(result, score).drop("_a", "_b")


def standardize(df: DataFrame, columns: list[str], ddof: int = 1, suffix: str = "") -> DataFrame:
    """Z-scores as plain columns; ``ddof`` 1 divides by the sample, 0 by the population deviation."""
    spread = F.stddev_samp if ddof == 1 else F.stddev_pop
    moments = df.agg(*[agg for c in columns for agg in (F.avg(c).alias(f"_m_{c}"), spread(c).alias(f"_s_{c}"))])

    def z(c: str) -> Column:
        return F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0)

    named = {f"{c}{suffix}": z(c) for c in columns}
    kept = [F.col(c) for c in df.columns if c not in named]
    return broadcast_scalar(df, moments).select(*kept, *[v.alias(n) for n, v in named.items()])


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population std, min and max per column, long form."""
    wide = df.agg(
        *[
            agg.cast("double").alias(f"{name}_{i}")
            for i, c in enumerate(columns)
            for name, agg in (("mean", F.avg(c)), ("std", F.stddev_pop(c)), ("min", F.min(c)), ("max", F.max(c)))
        ]
    )
    return long_form(
        wide,
        [(F.lit(c), *[F.col(f"{f}_{i}") for f in ("mean", "std", "min", "max")]) for i, c in enumerate(columns)],
        ["feature", "mean", "std", "min", "max"],
    )


def score_summary(scored: DataFrame, score: str = "anomaly_score", by: list[str] | None = None) -> DataFrame:
    """Mean, sample std, share above 0.8 and count in one row (per group)."""
    s = F.col(score)
    return scored.groupBy(*(by or [])).agg(
        F.avg(s).alias("avg_anomaly_score"),
        F.coalesce(F.stddev(s), F.lit(0.0)).alias("std_anomaly_score"),
        F.coalesce(F.count_if(s > HIGH_SCORE) / F.count(s), F.lit(0.0)).alias("high_score_ratio"),
        F.count(s).alias("sample_count"),
    )


def stacked_scores(scored: dict[str, DataFrame], *columns: str) -> DataFrame:
    """The scores of several models under one another, with the model's name."""
    parts = [df.select(F.lit(name).alias("model"), "anomaly_score", *columns) for name, df in scored.items()]
    return reduce(DataFrame.unionByName, parts)


def with_train_time(rows: DataFrame, times: dict[str, float] | None) -> DataFrame:
    seconds = F.lit(None).cast("double")
    for name, value in (times or {}).items():
        seconds = F.when(F.col("model") == name, float(value)).otherwise(seconds)
    return rows.withColumn("train_time", seconds)


def model_comparison(scored: dict[str, DataFrame], train_times: dict[str, float] | None = None) -> DataFrame:
    """One summary row per model."""
    return with_train_time(score_summary(stacked_scores(scored), by=["model"]), train_times)


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def label_metrics(
    scored: DataFrame,
    threshold: float = 0.8,
    score: str = "anomaly_score",
    label: str = "is_cheat",
    by: list[str] | None = None,
) -> DataFrame:
    """Precision, recall and F1 at the threshold, and the exact tie-averaged AUC; one row (per group).

    The AUC is the share of (fraud, normal) pairs in the right order, ties counting one half. It needs
    one row per distinct score only, so no pair is ever formed.
    """
    by = by or []
    counted = counted_values(
        scored.select(*by, F.col(score).alias("_score"), label), "_score", by, {"pos": F.count_if(F.col(label) == 1)}
    )
    flagged = F.col("value") >= float(threshold)
    negatives = F.col("n") - F.col("pos")
    negatives_before = F.col("n_before") - F.col("pos_before")
    sums = counted.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("sample_count"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum(F.when(flagged, F.col("n"))), F.lit(0)).alias("flagged"),
        F.coalesce(F.sum(F.when(flagged, F.col("pos"))), F.lit(0)).alias("true_positives"),
        F.sum(F.col("pos").cast("double") * (negatives_before.cast("double") + negatives.cast("double") / 2)).alias("_wins"),
    )
    pairs = F.col("positives").cast("double") * (F.col("sample_count") - F.col("positives")).cast("double")
    return sums.select(
        *by,
        "sample_count",
        "positives",
        "flagged",
        "true_positives",
        ratio(F.col("true_positives"), F.col("flagged")).alias("precision"),
        ratio(F.col("true_positives"), F.col("positives")).alias("recall"),
        ratio(2.0 * F.col("true_positives"), F.col("flagged") + F.col("positives")).alias("f1"),
        F.when(pairs > 0, F.col("_wins") / pairs).otherwise(0.5).alias("auc"),
    )


def label_aucs(scored: DataFrame, labels: list[str], score: str = "anomaly_score", by: list[str] | None = None) -> DataFrame:
    """The AUC of ``label_metrics`` for several label columns of the same score, from one ranking: ``by`` and ``<label>_auc``."""
    by = by or []
    positive = {f"pos_{i}": F.count_if(F.col(f"_label_{i}") == 1) for i in range(len(labels))}
    narrow = scored.select(*by, F.col(score).alias("_score"), *[F.col(c).alias(f"_label_{i}") for i, c in enumerate(labels)])
    counted = counted_values(narrow, "_score", by, positive)

    def auc(pos: str) -> Column:
        own, total, n = F.col(pos).cast("double"), F.max(f"{pos}_total"), F.max("n_total")
        before, level = F.col("n_before") - F.col(f"{pos}_before"), F.col("n") - F.col(pos)
        wins = F.sum(own * (before.cast("double") + level.cast("double") / 2))
        pairs = total.cast("double") * (n - total).cast("double")
        return F.when(pairs > 0, wins / pairs).otherwise(0.5)

    return counted.groupBy(*by).agg(*[auc(pos).alias(f"{c}_auc") for pos, c in zip(positive, labels, strict=True)])


def flag_metrics(
    scored: DataFrame, threshold: float = 0.8, score: str = "anomaly_score", label: str = "is_cheat", by: list[str] | None = None
) -> DataFrame:
    """Precision, recall and F1 of ``label_metrics`` alone: one aggregation, no ranks. Rows without a score are left out."""
    hit, true = F.col(score) >= float(threshold), F.coalesce(F.col(label) == 1, F.lit(False))
    counts = scored.where(F.col(score).isNotNull()).groupBy(*(by or [])).agg(
        F.count_if(true).alias("positives"), F.count_if(hit).alias("flagged"), F.count_if(hit & true).alias("true_positives")
    )
    return counts.select(
        "*",
        ratio(F.col("true_positives"), F.col("flagged")).alias("precision"),
        ratio(F.col("true_positives"), F.col("positives")).alias("recall"),
        ratio(2.0 * F.col("true_positives"), F.col("flagged") + F.col("positives")).alias("f1"),
    )


def clamp(value: Column, low: float = 0.5, high: float = 0.99) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def proxy_metrics(scored: DataFrame, score: str = "anomaly_score", by: list[str] | None = None) -> DataFrame:
    """Label-free proxies from the score distribution; not accuracy."""
    by = by or []
    base = scored.groupBy(*by).agg(F.avg(score).alias("mean"), (F.count_if(F.col(score) > HIGH_SCORE) / F.count(score)).alias("share"))
    rounded = base.select(
        *by,
        tidy(0.7 + F.col("share") * 0.3, 4).alias("precision"),
        tidy(0.6 + F.col("mean") * 0.4, 4).alias("recall"),
        tidy(0.5 + F.col("mean") * 0.5, 4).alias("auc"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rounded.withColumn("f1", tidy(2 * p * r / (p + r), 4)).select(
        *by, clamp(p).alias("precision"), clamp(r).alias("recall"), clamp(F.col("f1")).alias("f1"), clamp(F.col("auc")).alias("auc")
    )


def model_evaluation(scored: dict[str, DataFrame], train_times: dict[str, float] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per model: train time, score summary, metrics against the labels, and the label-free proxies."""
    stacked, by = stacked_scores(scored, "is_cheat"), ["model"]
    proxies = proxy_metrics(stacked, by=by).withColumnsRenamed({c: f"proxy_{c}" for c in ("precision", "recall", "f1", "auc")})
    labelled = label_metrics(stacked, threshold, by=by).drop("sample_count")
    return with_train_time(score_summary(stacked, by=by).join(labelled, by).join(proxies, by), train_times)


def feature_importance(scored: DataFrame, features: list[str], score: str = "anomaly_score") -> DataFrame:
    """Absolute correlation of each unscaled feature with the score, normalised to sum 1."""
    wide = scored.agg(
        *[tidy(F.abs(F.corr(F.col(c).cast("double"), F.col(score))), 4).alias(f"r_{i}") for i, c in enumerate(features)]
    )
    defined = [F.coalesce(F.nanvl(F.col(f"r_{i}"), F.lit(0.0)), F.lit(0.0)) for i in range(len(features))]
    total = reduce(lambda a, b: a + b, defined)
    cells = [
        (F.lit(c), r, F.when(total > 0, tidy(r / total, 4)).otherwise(r))
        for c, r in zip(features, defined, strict=True)
    ]
    return long_form(wide, cells, ["feature", "abs_correlation", "importance"])


def best_model(metrics: DataFrame) -> DataFrame:
    """Best F1, fastest and slowest model over (model, f1, train_time); null best when every F1 is 0.

    Ties go to the model first in name order.
    """
    first = lambda value: F.struct((-F.col(value)).alias("v"), F.col("model"))
    summary = metrics.agg(
        F.max("f1").alias("best_f1"),
        F.min(first("f1")).alias("_best"),
        F.min(F.struct("train_time", "model")).alias("_fast"),
        F.min(first("train_time")).alias("_slow"),
    )
    return summary.select(
        F.when(F.col("best_f1") > 0, F.col("_best.model")).alias("best_model"),
        "best_f1",
        F.col("_fast.model").alias("fastest"),
        F.col("_slow.model").alias("slowest"),
        (-F.col("_slow.v") / F.greatest(F.col("_fast.train_time"), F.lit(0.01))).alias("speed_ratio"),
    )
