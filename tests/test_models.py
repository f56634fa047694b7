from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linewatch.functions.quantiles import exact_quantiles
from linewatch.operators import cluster, explain, forest, scaling
from linewatch.plans import catalog, jobs
from linewatch.schemas import PAIR_KEYS


@pytest.fixture(scope="module")
def vectors(spark):
    """Two correlated crowds and one row far from both."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (600, 3)), rng.normal(6, 1, (399, 3)), [[60.0, -50.0, 40.0]]])
    pdf = pd.DataFrame(x, columns=["f0", "f1", "f2"])
    pdf.insert(0, "time_window", np.arange(len(x)))
    pdf.insert(1, "src", "a")
    pdf.insert(2, "dst", "b")
    return spark.createDataFrame(pdf).cache()


COLS = ["f0", "f1", "f2"]


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    s = scaling.fit_scaler(df, ["a", "b"])
    assert (s.means, s.scales, s.rows) == ((2.0, 5.0), (1.0, 1.0), 2)
    got = {tuple(r) for r in scaling.apply_scaler(df, s).collect()}
    assert got == {(-1.0, 0.0), (1.0, 0.0)}
    assert scaling.Scaler.from_frame(s.to_frame(spark)).means == s.means


def test_prepare_parts_keys_label_and_features(spark):
    df = spark.createDataFrame([(1, "a", "b", math.nan, 2, 1)], "time_window long, src string, dst string, x double, y int, z int")
    got, names = scaling.prepare(df, "z")
    assert names == ["x", "y"] and got.columns == [*PAIR_KEYS, "z", "x", "y"]
    assert got.first()["x"] == 0.0


def test_forest_finds_the_planted_row(spark, vectors):
    model = forest.fit_forest(vectors, COLS, contamination=0.01)
    got = forest.score(vectors, model).toPandas()
    assert got["anomaly_score"].between(-1, 0, inclusive="neither").all()
    assert got.loc[got["anomaly_score"].idxmin(), "time_window"] == 999
    sizes = model.nodes.groupby("tree").size()
    assert len(sizes) == 100 and sizes.max() <= 2 * 256 - 1


def test_forest_does_not_depend_on_partitioning(spark, vectors):
    a = forest.fit_forest(vectors.repartition(7), COLS, trees=5)
    b = forest.fit_forest(vectors.coalesce(1), COLS, trees=5, scaler=a.scaler)
    pd.testing.assert_frame_equal(a.nodes, b.nodes)


def test_every_tree_gets_a_full_sample(spark, vectors):
    sample = forest.tree_samples(vectors, PAIR_KEYS, 1000, 20, 256, 42)
    per_tree = sample.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("time_window").alias("d")).collect()
    assert len(per_tree) == 20 and all(r["n"] == 256 == r["d"] for r in per_tree)


def test_traversal_equals_case_expression(spark, vectors):
    df = vectors.withColumnsRenamed(dict(zip(COLS, catalog.MODEL_COLUMNS, strict=True)))
    model = catalog.fixed_model(df)
    depth = sum(forest.path_expression(model, t) for t in range(3)) / 3
    want = -F.pow(F.lit(2.0), -depth / forest.average_path(256))
    got = forest.score(df, model).withColumn("want", want).toPandas()
    np.testing.assert_allclose(got["anomaly_score"], got["want"], rtol=1e-12)


def test_contamination_flags_the_share(spark, vectors):
    scored = forest.score(vectors, forest.fit_forest(vectors, COLS, trees=20))
    scores = scored.toPandas()["anomaly_score"].to_numpy()
    got = forest.flag_contamination(scored, 0.05).toPandas()
    assert got["anomaly"].sum() == (scores < np.quantile(scores, 0.05)).sum() <= 50
    assert forest.flag_fixed(scored, -2.0).agg(F.sum("anomaly")).first()[0] == 0


def test_model_round_trip_and_profiles(spark, readings, tmp_path):
    features = jobs.pair_features(readings, 86_400)
    model, flagged = jobs.train(features, contamination=0.05, trees=10)
    forest.save_model(spark, model, str(tmp_path / "m"))
    loaded = forest.load_model(spark, str(tmp_path / "m"))
    assert (loaded.profile, loaded.columns, loaded.threshold) == ("register", model.columns, model.threshold)
    a = forest.score(features, model).toPandas().sort_values(PAIR_KEYS)["anomaly_score"].to_numpy()
    b = forest.score(features, loaded).toPandas().sort_values(PAIR_KEYS)["anomaly_score"].to_numpy()
    np.testing.assert_array_equal(a, b)
    with pytest.raises(forest.ProfileMismatch):
        forest.score(jobs.pair_features(readings, 86_400, "record"), loaded)
    found = jobs.detect(features, loaded, threshold=model.threshold)
    assert found.count() == flagged.filter("anomaly = 1").count()


def test_explain_skips_zero_means(spark):
    rows = [(1, 1.0, 0.0, 4.0), (0, 2.0, 0.0, 1.0), (0, 4.0, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "anomaly int, a double, b double, c double")
    got = {r["feature"]: r["pct_diff"] for r in explain.explain(df, ["a", "b", "c"]).collect()}
    assert got == pytest.approx({"a": 200 / 3, "c": 100.0})
    assert explain.explain(df.filter("anomaly = 0"), ["a"]).count() == 0


@pytest.mark.parametrize("max_rows", [1_000_000, 50, 3])
@pytest.mark.parametrize("kind", ["smooth", "ties"])
def test_exact_quantiles(spark, max_rows, kind):
    rng = np.random.default_rng(2)
    x = rng.lognormal(0, 3, 4001) if kind == "smooth" else np.repeat([1.0, 1.0, 5.0, 7.0], 500)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    row = exact_quantiles(df, "x", [0.0, 0.01, 0.5, 0.95, 1.0], max_rows=max_rows).first()
    want = np.quantile(x, [0.0, 0.01, 0.5, 0.95, 1.0])
    np.testing.assert_allclose(list(row), want, rtol=1e-12)


def brute_dbscan(x, eps, min_samples):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= min_samples
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        todo = [i] if label[i] < 0 else []
        while todo:
            u = todo.pop()
            if label[u] < 0:
                label[u] = i
                todo += list(np.flatnonzero(near[u] & core & (label < 0)))
    for i in np.flatnonzero(~core):
        touched = label[np.flatnonzero(near[i] & core)]
        label[i] = touched.min() if len(touched) else -1
    return label, core


@pytest.mark.parametrize("kind", ["crowd", "lattice", "two_sheets"])
def test_dbscan_equals_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    eps, n, limit = 0.5, 5, 10
    if kind == "crowd":  # a third of the rows in one place, many exact copies
        x = np.vstack([rng.normal(0, 0.01, (150, 2)), np.zeros((150, 2)), rng.normal(3, 0.5, (150, 2)), rng.uniform(-6, 6, (150, 2))])
    elif kind == "lattice":
        x, eps, n = rng.uniform(0, 4, (500, 2)).round(1), 0.1, 4
    else:  # dense cells facing each other, apart by more than their outermost points tell
        a = rng.uniform(0, 0.3, (200, 2)) * [1, 1]
        x, eps = np.vstack([a, a + [0.55, 0.0], a + [3.0, 0.0], a + [3.9, 0.3]]), 0.5
    pdf = pd.DataFrame(x, columns=["e0", "e1"])
    pdf.insert(0, "id", np.arange(len(x)))
    out = cluster.dbscan(spark.createDataFrame(pdf), ["e0", "e1"], eps, n, standardise=False, max_cells=limit)
    got = out.toPandas().sort_values("id", ignore_index=True)
    label, core = brute_dbscan(x, eps, n)
    np.testing.assert_array_equal(got["core"], core.astype(int))
    np.testing.assert_array_equal(got["cluster"], label)
    np.testing.assert_array_equal(got["noise"], (label < 0).astype(int))


def test_whole_vectors_are_clustered():
    """The query and its SQL name all coordinates of the table's vectors."""
    from linewatch.plans import catalog, oracles

    assert len(catalog.WHOLE_VECTOR) == 64
    sql = oracles.all_sql()["M8_dbscan_whole_vectors"]
    for i in range(64):
        assert f"embedding[{i + 1}]::DOUBLE AS e{i}" in sql and f"(a.e{i} - b.e{i})" in sql
    assert f"<= {catalog.WHOLE_EPS})" in sql


def test_whole_vectors_need_no_grid(spark, monkeypatch):
    """With 64 columns the grid asked four times as many buckets per column; blocks and pivots give the same clusters."""

    def grid(*_):
        raise AssertionError("a grid of many columns")

    monkeypatch.setattr(cluster, "near_cells", grid)
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 0.5, (60, 64)), rng.normal(4, 0.6, (60, 64)), rng.normal(0, 4, (30, 64))])
    cols = [f"e{i}" for i in range(64)]
    pdf = pd.DataFrame(x, columns=cols)
    pdf.insert(0, "id", np.arange(len(x)))
    got = cluster.dbscan(spark.createDataFrame(pdf), cols, 6.2, standardise=False).toPandas().sort_values("id", ignore_index=True)
    label, core = brute_dbscan(x, 6.2, 5)
    assert core.any() and (label < 0).any()
    np.testing.assert_array_equal(got["core"], core.astype(int))
    np.testing.assert_array_equal(got["cluster"], label)
