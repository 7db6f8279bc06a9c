import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordersight.models import forest, lof, mixtures, ocsvm, search
from ordersight.models.features import apply_scaler, fit_scaler
from ordersight.schemas import FEATURES
from ordersight.session import cut, fresh_dir
from ordersight.sources.models import load_model, save_model

COLUMNS = list(FEATURES)
PLANTED = 12


def cloud(n=1500, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    far = rng.normal(size=(PLANTED, 4)) + np.sign(rng.normal(size=(PLANTED, 4))) * 9
    same = np.tile([[0.1, 0.2, 0.3, 0.4]], (copies, 1))
    pdf = pd.DataFrame(np.vstack([x, far, same]), columns=COLUMNS)
    pdf.insert(0, "order_id", [f"O{i:06d}" for i in range(len(pdf))])
    pdf["is_cheat"] = [int(n <= i < n + PLANTED) for i in range(len(pdf))]
    return pdf


@pytest.fixture(scope="module")
def points(spark):
    return cut(spark.createDataFrame(cloud()))


def planted_rank(scored):
    """Share of the planted points among the highest scores."""
    top = scored.orderBy(F.desc("anomaly_score")).limit(PLANTED)
    return top.agg(F.sum("is_cheat")).first()[0] / PLANTED


def in_unit_range(scored):
    low, high = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    return low == 0.0 and high == 1.0


def test_isolation_forest(spark, points):
    scored = cut(forest.isolation_forest(points, COLUMNS))
    assert scored.count() == points.count() and in_unit_range(scored) and planted_rank(scored) == 1.0
    again = forest.isolation_forest(points.repartition(5), COLUMNS)
    joined = scored.join(again.select("order_id", F.col("anomaly_score").alias("b")), "order_id")
    assert joined.where("abs(anomaly_score - b) > 1e-12").count() == 0


def test_forest_samples_are_full(spark, points):
    sizes = forest.tree_samples(points, "order_id", [(20, 64), (5, 4096)], 1).groupBy("cell", "tree").count().collect()
    rows = points.count()
    assert len(sizes) == 25 and all(r["count"] == (64 if r.cell == 0 else rows) for r in sizes)


def test_trees_draw_from_the_whole_table(spark):
    """No pool bounds what the trees see together; every row is as likely as any other."""
    rows = spark.range(200_000).select(F.col("id").alias("order_id"))
    samples = cut(forest.tree_samples(rows, "order_id", [(320, 256), (3, 64)], 1).select("cell", "tree", "order_id"))
    sizes = samples.groupBy("cell", "tree").count().collect()
    assert len(sizes) == 323 and all(r["count"] == (64 if r.cell else 256) for r in sizes)
    first = samples.where("cell = 0").agg(F.countDistinct("order_id").alias("d"), F.avg("order_id").alias("m")).first()
    assert first.d > 75_000 and abs(first.m - 100_000) < 1000


def test_forest_is_bounded():
    with pytest.raises(ValueError, match="nodes"):
        forest.fit_forest(None, COLUMNS, cells=[(100_000, 256)])


def test_path_length():
    assert forest.path_length(1) == 0 and forest.path_length(2) == 1
    assert forest.path_length(256) == pytest.approx(10.2448, abs=1e-3)


def brute_lof(x, k, novelty):
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(-1))
    n = len(x)
    off = d + np.where(np.eye(n, dtype=bool), np.inf, 0)
    kd = np.sort(off, axis=1)[:, k - 1]
    near = off <= kd[:, None]
    reach = np.maximum(d, kd[None, :])
    lrd = 1 / (np.array([reach[i][near[i]].mean() for i in range(n)]) + 1e-10)
    if not novelty:
        return np.array([lrd[near[i]].mean() for i in range(n)]) / lrd
    kd_self = np.sort(d, axis=1)[:, k - 1]
    used = d <= kd_self[:, None]
    own = 1 / (np.array([reach[i][used[i]].mean() for i in range(n)]) + 1e-10)
    return np.array([lrd[used[i]].mean() for i in range(n)]) / own


@pytest.mark.parametrize("novelty", [False, True])
@pytest.mark.parametrize("copies, cell_rows", [(0, 60), (300, 50), (15, 10_000)])
def test_lof_matches_brute_force(spark, novelty, copies, cell_rows):
    """Many cells, and a third of all rows identical."""
    pdf = cloud(500, seed=copies, copies=copies)
    got = lof.local_outlier_factor(spark.createDataFrame(pdf), COLUMNS, 20, novelty, cell_rows)
    got = got.toPandas().sort_values("order_id")
    expected = brute_lof(pdf[COLUMNS].to_numpy(), 20, novelty)
    np.testing.assert_allclose(got["lof"], expected, rtol=1e-6)
    assert len(got) == len(pdf)


def test_lof_of_a_tiny_table(spark):
    pdf = cloud(3)[:5]
    got = lof.local_outlier_factor(spark.createDataFrame(pdf), COLUMNS, 20)
    assert got.count() == 5 and got.where("lof is null or isnan(lof)").count() == 0


def test_lof_join_by_broadcast_for_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(lof, "ROWS_PER_TASK", 50)
    pdf = cloud(200, copies=100)
    factors = spark.createDataFrame(pdf).groupBy(*COLUMNS).agg(F.count("*").alias("copies")).withColumn("lof", F.lit(1.0))
    assert lof.join_points(spark.createDataFrame(pdf), cut(factors), COLUMNS).count() == len(pdf)


def test_one_class_svm(spark, points):
    scored = cut(ocsvm.one_class_svm(points, COLUMNS, nu=0.1))
    outside = scored.where("decision < 0").count() / points.count()
    assert outside == pytest.approx(0.1, abs=0.02)
    assert in_unit_range(scored) and planted_rank(scored) >= 0.9


def test_one_class_gap_and_feasible_average(spark, points):
    model = ocsvm.fit_one_class(points, COLUMNS, nu=0.2, fourier_features=64)
    assert model.gap <= 1e-2 * float(model.weights @ model.weights)
    x = points.select(*COLUMNS).toPandas().to_numpy()
    z = ocsvm.fourier(x, model.projection)
    w = model.weights
    borders = np.array([[-2.0, 0.0, 5.0]])  # useless borders must still give the exact share
    atom = ocsvm.low_tail_means(points, COLUMNS, model.projection, w[:, None], borders, 1.0)[0]
    np.testing.assert_allclose(atom, z.mean(axis=0), atol=1e-9)


def test_kmeans_and_reload(spark, points):
    model = mixtures.fit_kmeans(points)
    scored = cut(mixtures.kmeans_score(points, model))
    assert in_unit_range(scored) and planted_rank(scored) >= 0.5
    path = fresh_dir(spark, "model")
    assert load_model(spark, path) is None
    save_model(model, path)
    save_model(model, path)
    again = mixtures.kmeans_score(points, load_model(spark, path)).select("order_id", F.col("anomaly_score").alias("b"))
    assert scored.join(again, "order_id").where("anomaly_score = b").count() == points.count()


def test_kmeans_distance_is_nearest_centre(spark, points):
    model = mixtures.fit_kmeans(points)
    got = mixtures.kmeans_distance(points, model).orderBy("order_id").toPandas()
    scaler, kmeans = model.stages[1], model.stages[2]
    x = (got[COLUMNS].to_numpy() - scaler.mean.toArray()) / scaler.std.toArray()
    expected = np.min([np.linalg.norm(x - c, axis=1) for c in kmeans.clusterCenters()], axis=0)
    np.testing.assert_allclose(got["distance"], expected, rtol=1e-9, atol=1e-12)


def test_gmm(spark, points):
    model = mixtures.fit_gmm(points)
    plain = mixtures.gmm_score(points, model)
    assert plain.agg(F.max("anomaly_score")).first()[0] <= 0.5
    assert planted_rank(mixtures.gmm_score(points, model, density=True)) >= 0.9


def test_scaler_is_separable(spark, points):
    model = fit_scaler(points)
    again = apply_scaler(points.limit(3), model)
    assert "features" in again.columns and again.count() == 3


def test_grid_search(spark, points):
    run = lambda: search.forest_grid_search(points, COLUMNS, trees=(10, 20), samples=(32, 64)).drop("fit_seconds")
    got = sorted(map(str, run().collect()))
    assert len(got) == 4 and got == sorted(map(str, run().collect()))
    assert run().agg(F.min("label_auc")).first()[0] > 0.95


def test_one_class_svm_raises_when_it_has_not_converged(spark):
    rows = [(float(x), float(y)) for x, y in np.random.default_rng(8).normal(size=(500, 2))]
    with pytest.raises(RuntimeError, match="duality gap"):
        ocsvm.fit_one_class(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], rounds=1, tolerance=-1.0)


@pytest.mark.parametrize("model", ["lof", "svm", "forest", "kmeans", "gmm"])
def test_rows_without_usable_features_stay_without_a_score(spark, model):
    """Null, NaN and infinite features: as many rows out as in, and the other scores do not change."""
    pdf = cloud(300)
    bad = pd.DataFrame({c: [0.1] * 3 for c in COLUMNS}).assign(order_id=["X0", "X1", "X2"], is_cheat=0)
    bad[COLUMNS[0]] = [float("nan"), float("inf"), 0.1]
    rows = spark.createDataFrame(pd.concat([pdf, bad], ignore_index=True))
    rows = cut(rows.withColumn(COLUMNS[1], F.when(F.col("order_id") != "X2", F.col(COLUMNS[1]))))
    run = {
        "lof": lambda df: lof.local_outlier_factor(df, COLUMNS),
        "svm": lambda df: ocsvm.one_class_svm(df, COLUMNS, fourier_features=64),
        "forest": lambda df: forest.isolation_forest(df, COLUMNS, trees=10),
        "kmeans": lambda df: mixtures.kmeans_score(df, mixtures.fit_kmeans(df)),
        "gmm": lambda df: mixtures.gmm_score(df, mixtures.fit_gmm(df), density=True),
    }[model]
    got = {r.order_id: r.anomaly_score for r in run(rows).collect()}
    assert len(got) == len(pdf) + 3 and [got[k] for k in ("X0", "X1", "X2")] == [None] * 3
    clean = {r.order_id: r.anomaly_score for r in run(rows.where("order_id not like 'X%'")).collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in clean.items())


def test_lof_and_svm_without_a_usable_row(spark):
    rows = spark.createDataFrame([("a", None)], "order_id string, v double").select("order_id", *[F.col("v").alias(c) for c in COLUMNS])
    assert lof.local_outlier_factor(rows, COLUMNS).first().lof is None
    assert ocsvm.one_class_svm(rows, COLUMNS).first().decision is None


def test_low_tail_means_do_not_depend_on_the_partitions(spark, points):
    """The sums of the tasks meet in two steps, whatever the number of tasks."""
    rng = np.random.default_rng(1)
    projection, directions = rng.normal(size=(4, 16)), rng.normal(size=(32, 3))
    x = points.select(*COLUMNS).toPandas().to_numpy()
    z = ocsvm.fourier(x, projection)
    borders = ocsvm.shell_borders(z @ directions, 0.3)
    expected = [z[np.argsort(z @ d)[: round(0.3 * len(z))]].mean(axis=0) for d in directions.T]
    for tasks in (1, 150):
        got = ocsvm.low_tail_means(points.repartition(tasks), COLUMNS, projection, directions, borders, 0.3)
        np.testing.assert_allclose(got, expected, atol=0.01)


def test_grid_search_measures_every_cell(spark, points):
    """Trees x samples set the task time of a cell; labels cut from the score are ranked perfectly."""
    got = {(r.n_estimators, r.max_samples): r for r in search.forest_grid_search(points, COLUMNS, trees=(5, 60), samples=(32, 256)).collect()}
    assert got[60, 256].fit_seconds > got[5, 32].fit_seconds > 0
    assert {r.pseudo_auc for r in got.values()} <= {0.5, 1.0}


def test_lof_radii_come_from_one_window(spark):
    """The novelty radius is taken with the k-distance, so the neighbour pairs are not ordered a second time."""
    from ordersight.models.lof import density_factors, neighbour_pairs
    from ordersight.session import cut

    points = spark.createDataFrame([(i, float(i * i), 1 + (i == 3)) for i in range(6)], "pid long, x double, copies long")
    pairs = cut(neighbour_pairs(points, ["x"], 2))
    got = {r.pid: (r.k_distance, r.near_distance) for r in pairs.where("pid = other").collect()}
    assert got[0] == (4.0, 1.0) and got[3] == (5.0, 0.0) and got[5] == (16.0, 9.0)
    plan = density_factors(pairs, 2, True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_neighbour_search_compares_few_points(monkeypatch):
    """Radii and pairs equal brute force; far fewer distances are taken than blocks of 256 points need."""
    import numpy as np

    from ordersight.models import kdtree

    x, taken, real = np.random.default_rng(3).normal(size=(2048, 2)), [], kdtree.distances
    brute = np.sort(real(x, x), axis=1)[:, 4]
    monkeypatch.setattr(kdtree, "distances", lambda a, b: (taken.append(len(a) * len(b)), real(a, b))[1])
    radius = kdtree.mass_radius(x, np.full(len(x), np.inf), x, np.ones(len(x)), 5)
    assert (radius == brute).all() and sum(taken) < 1_300_000
    assert sum(len(a) for a, _, _ in kdtree.pairs_within(x, radius, x)) == 5 * len(x)


@pytest.mark.parametrize("novelty", [False, True])
def test_lof_never_writes_the_pairs_of_neighbours(spark, monkeypatch, novelty):
    """Tables on disk follow the points, not their twenty neighbours each, and go once they have been read."""
    import os

    pdf = pd.DataFrame(np.random.default_rng(9).normal(size=(2000, 2)), columns=["x", "y"])
    pdf.insert(0, "order_id", range(len(pdf)))
    rows, written = cut(spark.createDataFrame(pdf).repartition(4)), []

    def counted(df):
        table = cut(df)
        written.append((table.count(), table.inputFiles()[0].removeprefix("file://")))
        return table

    monkeypatch.setattr(lof, "cut", counted)
    got = lof.local_outlier_factor(rows, ["x", "y"], 20, novelty, 500).orderBy("order_id").toPandas()
    np.testing.assert_allclose(got["lof"], brute_lof(pdf[["x", "y"]].to_numpy(), 20, novelty), rtol=1e-6)
    assert max(n for n, _ in written) < 8 * len(pdf)
    assert [os.path.exists(file) for _, file in written] == [False] * (len(written) - 1) + [True]
