"""Isolation forest: hash-sampled trees built in parallel, scored partition by partition.

Each tree needs a fixed number of rows however large the table is, so fitting counts the table, reads it once
and deals to every tree the rows whose hash falls to it. The fitted forest
is bounded by its parameters (trees x 2 x samples nodes), which is what makes it safe to broadcast.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.models.features import score_usable
from ordersight.operators.scores import minmax_score
from ordersight.session import cut, in_groups

EULER = 0.5772156649015329
# The default forest and the search grid.
TREES, SAMPLES, SEED = 100, 256, 42
GRID_TREES, GRID_SAMPLES = (50, 100, 200), (128, 256, 512)

HASH_RANGE = 2**52
OVERSAMPLE = 2.0
MAX_NODES = 4_000_000
TREES_PER_TASK = 8
NODE_SCHEMA = "cell int, tree int, node int, feature int, threshold double, left int, right int, depth double, seconds double"


def path_length(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def tree_samples(features: DataFrame, key: str, cells: list[tuple[int, int]], seed: int) -> DataFrame:
    """(cell, tree) with its sample rows, drawn without replacement; ``cells`` lists (trees, samples).

    A sample is the rows with the smallest draws of their tree. A tree wants a row with probability ``p``, about twice
    its share of the table. One hash decides for a block of ``1 / p`` trees: the part of the hash range it falls into
    names the tree, the place inside that part is the draw. So a large table costs one hash per row and cell, only about
    twice the samples are shuffled, and every tree draws from the whole table whatever its size.
    """
    rows = features.count()

    def cell(i: int, trees: int, samples: int):
        p = min(1.0, OVERSAMPLE * (samples + 32) / max(rows, 1))
        block = min(trees, max(1, int(1 / p)))
        fixed = {"cell": i, "trees": trees, "samples": samples, "block": block, "blocks": -(-trees // block)}
        width = F.lit(max(1, int(p * HASH_RANGE))).cast("long").alias("width")
        return F.struct(*[F.lit(v).alias(n) for n, v in fixed.items()], width)

    hashed = F.pmod(F.xxhash64(F.col(key), F.col("cell"), F.col("_block"), F.lit(seed + 1)), F.lit(HASH_RANGE))
    dealt = (
        features.select("*", F.inline(F.array(*[cell(i, *c) for i, c in enumerate(cells)])))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_block"))
        .withColumn("_hash", hashed)
        .withColumns({"_part": F.expr("_hash div width"), "_draw": F.expr("_hash % width")})
        .where("_part < block")
        .withColumn("tree", (F.col("_block") * F.col("block") + F.col("_part")).cast("int"))
        .where("tree < trees")
    )
    total = sum(trees for trees, _ in cells)
    dealt = in_groups(dealt, "cell", "tree", groups=-(-total // TREES_PER_TASK))
    ranked = Window.partitionBy("cell", "tree").orderBy("_draw", key)
    return dealt.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= F.col("samples"))


def build_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth); a leaf has feature -1 and its expected depth."""
    nodes: list = [None]
    stack = [(0, np.arange(len(x)), 0)]
    while stack:
        node, rows, depth = stack.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes[node] = (-1, 0.0, 0, 0, depth + path_length(len(rows)))
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        if cut >= high[f]:
            cut = float(low[f])
        below = part[:, f] <= cut
        nodes += [None, None]
        nodes[node] = (f, cut, len(nodes) - 2, len(nodes) - 1, 0.0)
        stack += [(len(nodes) - 2, rows[below], depth + 1), (len(nodes) - 1, rows[~below], depth + 1)]
    return nodes


def tree_builder(columns: list[str], seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, tree, started = int(key[0]), int(key[1]), time.perf_counter()
        x = rows.sort_values("_rank")[columns].to_numpy(float)
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes = build_tree(x, np.random.default_rng([seed, cell, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "depth"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        out.insert(0, "cell", cell)
        out["seconds"] = 0.0
        out.loc[0, "seconds"] = time.perf_counter() - started
        return out

    return run


def fit_forest(
    features: DataFrame,
    columns: list[str],
    key: str = "order_id",
    cells: list[tuple[int, int]] = ((TREES, SAMPLES),),
    seed: int = SEED,
) -> DataFrame:
    """Node table of one forest per cell of (trees, samples); the first node of a tree holds its build time."""
    nodes = sum(2 * trees * samples for trees, samples in cells)
    if nodes > MAX_NODES:
        raise ValueError(f"{nodes} nodes exceed the {MAX_NODES} a forest may broadcast")
    samples = tree_samples(features.select(key, *columns), key, list(cells), seed)
    return samples.groupBy("cell", "tree").applyInPandas(tree_builder(columns, seed), NODE_SCHEMA)


def pack_forest(nodes: pd.DataFrame) -> list[list[tuple[np.ndarray, ...]]]:
    """Node arrays per cell and tree."""
    nodes = nodes.sort_values(["cell", "tree", "node"])
    fields = ["feature", "threshold", "left", "right", "depth"]
    forest: list = []
    for (cell, _), tree in nodes.groupby(["cell", "tree"], sort=True):
        while len(forest) <= cell:
            forest.append([])
        forest[cell].append(tuple(tree[f].to_numpy() for f in fields))
    return forest


def mean_depth(trees: list, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, threshold, left, right, depth in trees:
        node = np.zeros(len(x), dtype=np.int64)
        live = np.flatnonzero(feature[node] >= 0)
        while len(live):
            at = node[live]
            below = x[live, feature[at]] <= threshold[at]
            node[live] = np.where(below, left[at], right[at])
            live = live[feature[node[live]] >= 0]
        total += depth[node]
    return total / len(trees)


def forest_raw_scores(features: DataFrame, nodes: DataFrame, columns: list[str], cells: list[tuple[int, int]]) -> DataFrame:
    """Add ``raw``: one anomaly value 2 ** (-mean depth / c(samples)) per cell, in one pass.

    The node table has at most ``MAX_NODES`` rows whatever the data size, so it is collected and broadcast.
    """
    spark = features.sparkSession
    shared = spark.sparkContext.broadcast(pack_forest(nodes.toPandas()))
    rows = features.count()
    scale = [path_length(min(samples, rows)) for _, samples in cells]

    @F.pandas_udf("array<double>")
    def raw(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forest = shared.value
        for batch in batches:
            x = np.column_stack([s.to_numpy(float) for s in batch])
            parts = [2.0 ** (-mean_depth(t, x) / max(c, 1e-12)) for t, c in zip(forest, scale, strict=True)]
            yield pd.Series(list(np.column_stack(parts)))

    return features.withColumn("raw", raw(*[F.col(c).cast("double") for c in columns]))


def isolation_forest(
    features: DataFrame,
    columns: list[str],
    key: str = "order_id",
    trees: int = TREES,
    samples: int = SAMPLES,
    seed: int = SEED,
) -> DataFrame:
    """Every row with its min-max scaled isolation score; null for a row with a null, NaN or infinite feature."""
    cells = [(trees, samples)]

    def score(rows: DataFrame) -> DataFrame:
        raw = forest_raw_scores(rows, fit_forest(rows, columns, key, cells, seed), columns, cells)
        # written once, because the min-max scaling reads the scores twice
        written = cut(raw.withColumn("_raw", F.col("raw")[0]).drop("raw"))
        return minmax_score(written, "_raw").drop("_raw")

    return score_usable(features, columns, score)
