"""Grid search over isolation forests: all cells share one fit and one scoring pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions.rounding import tidy
from ordersight.models.features import usable
from ordersight.models.forest import GRID_SAMPLES, GRID_TREES, SEED, fit_forest, forest_raw_scores
from ordersight.operators.scores import clamp, label_aucs
from ordersight.session import cut


def forest_grid_search(
    features: DataFrame,
    columns: list[str],
    key: str = "order_id",
    label: str = "is_cheat",
    trees: tuple[int, ...] = GRID_TREES,
    samples: tuple[int, ...] = GRID_SAMPLES,
    seed: int = SEED,
) -> DataFrame:
    """Per cell: mean score, AUC proxy from the mean, AUC against score > 0.8 and against the real labels, fit time.

    All cells share one fit, so the fit time of a cell is the task time its trees took, added up. Rows without usable
    features are left out. Labels cut from the score itself are ranked perfectly; where one side is empty the AUC is 0.5.
    """
    cells = [(t, s) for t in trees for s in samples]
    features = features.where(usable(columns))
    nodes = cut(fit_forest(features, columns, key, cells, seed))
    raw = cut(forest_raw_scores(features.select(key, label, *columns), nodes, columns, cells).select(key, label, "raw"))
    spread = raw.agg(*[agg for i in range(len(cells)) for agg in (F.min(F.col("raw")[i]).alias(f"lo{i}"), F.max(F.col("raw")[i]).alias(f"hi{i}"))])
    width = lambda i: F.col(f"hi{i}") - F.col(f"lo{i}")
    score = lambda i: F.when(width(i) > 0, (F.col("raw")[i] - F.col(f"lo{i}")) / width(i)).otherwise(0.0)
    scored = raw.crossJoin(F.broadcast(spread)).select(
        label, F.posexplode(F.array(*[score(i) for i in range(len(cells))])).alias("cell", "anomaly_score")
    )
    shape = scored.groupBy("cell").agg(F.avg("anomaly_score").alias("mean_score"))
    # both kinds of label in one ranking of the scores
    judged = scored.withColumns({"label": F.col(label).cast("int"), "pseudo": (F.col("anomaly_score") > 0.8).cast("int")})
    real = label_aucs(judged, ["label", "pseudo"], by=["cell"])
    spent = nodes.groupBy("cell").agg(F.sum("seconds").alias("fit_seconds"))
    grid = F.array(*[F.struct(F.lit(t).alias("n_estimators"), F.lit(s).alias("max_samples")) for t, s in cells])
    return (
        shape.join(real, "cell")
        .join(spent, "cell")
        .withColumn("_cell", F.element_at(grid, F.col("cell") + 1))
        .select(
            "_cell.*",
            tidy(F.col("mean_score"), 6).alias("mean_score"),
            clamp(tidy(0.5 + F.col("mean_score") * 0.5, 3)).alias("proxy_auc"),
            tidy(F.col("pseudo_auc"), 3).alias("pseudo_auc"),
            tidy(F.col("label_auc"), 4).alias("label_auc"),
            tidy(F.col("fit_seconds"), 3).alias("fit_seconds"),
        )
    )
