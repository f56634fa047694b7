"""Density clustering with pivots against plain DBSCAN, with crowds, copies and noise."""

from __future__ import annotations

import numpy as np
import pytest

from linewatch.operators import pivots


def plain(ids, x, eps, min_samples):
    """``{id: (cluster, core)}`` by definition."""
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= min_samples
    label = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        least = np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(1)
        made = np.where(core, least, label)
        if np.array_equal(made, label):
            break
        label = made
    rim = np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(1)
    found = np.where(rim == np.iinfo(np.int64).max, -1, rim)
    return {int(i): (int(c), int(k)) for i, c, k in zip(ids, found, core)}


def frame(spark, ids, x):
    cols = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(int(i), *map(float, r)) for i, r in zip(ids, x)], ["id", *cols]), cols


def crowd(seed, d):
    """Loose groups, a crowd that holds a third of all points, copies, and single points."""
    rng = np.random.default_rng(seed)
    hubs = rng.normal(0, 3, (5, d))
    x = np.concatenate(
        [hubs[i] + rng.normal(0, 0.5, (40, d)) for i in range(5)]
        + [rng.normal(8, 0.01, (130, d)), rng.normal(0, 6, (60, d)), np.repeat(rng.normal(0, 6, (2, d)), [7, 3], axis=0)]
    )
    return rng.permutation(len(x)) + 10, x


@pytest.mark.parametrize("d,eps,block", [(2, 0.5, 1024), (2, 0.5, 16), (28, 3.2, 16), (64, 5.2, 32), (64, 4.8, 7)])
def test_equals_plain_dbscan(spark, d, eps, block):
    ids, x = crowd(d, d)
    df, cols = frame(spark, ids, x)
    made = pivots.pivot_dbscan(df.repartition(3), cols, eps, standardise=False, block=block).collect()
    want = plain(ids, x, eps, 5)
    assert {r["id"]: (r["cluster"], r["core"]) for r in made} == want
    assert all(r["noise"] == (r["cluster"] == -1) for r in made)
    kinds = {(c == -1, k) for c, k in want.values()}
    assert kinds == {(True, 0), (False, 0), (False, 1)}  # noise, border and core points all occur


def test_pivots_spare_comparisons(spark):
    ids, x = crowd(3, 28)
    df, cols = frame(spark, ids, x)
    row = pivots.compared_pairs(df, cols, 3.2, standardise=False, block=16).first()
    assert row["points"] == len(np.unique(x, axis=0)) and row["all_pairs"] == row["points"] * (row["points"] - 1) // 2
    assert row["compared"] < 0.5 * row["all_pairs"]


def test_standardised_and_small_inputs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, [1, 100, 0.01], (50, 3))
    ids = np.arange(50)
    df, cols = frame(spark, ids, x)
    z = (x - x.mean(0)) / x.std(0)
    made = {r["id"]: (r["cluster"], r["core"]) for r in pivots.pivot_dbscan(df, cols, 0.7).collect()}
    assert made == plain(ids, z, 0.7, 5)
    assert pivots.pivot_dbscan(df.limit(0), cols, 0.7).count() == 0
    one = pivots.pivot_dbscan(df.limit(1), cols, 0.7).first()
    assert (one["cluster"], one["core"], one["noise"]) == (-1, 0, 1)


def test_distances_at_the_limit():
    """Where rounding of the fast form could decide, the plain sum does."""
    a = np.full((3, 4), 1e6)
    b = a + np.array([[1.0, 0, 0, 0], [1.0 + 1e-9, 0, 0, 0], [0, 0, 0, 1.0]])
    assert pivots.within(a, b, 1.0).tolist() == [[True, False, True]] * 3


def test_bands_follow_the_points_not_the_partitions():
    """As many bands for many points as for few; only large bands are cut further, and a large pivot is dealt over several."""
    for n in (10, 100, 5000):
        made = pivots.band_numbers({c: n for c in range(512)}, 8 * 66)
        assert max(first + parts for _, first, parts in made) <= 2 * pivots.BANDS
        assert [c for c, _, _ in made] == list(range(512))
    (one, after) = pivots.band_numbers({3: 1_000_000, 4: 10}, 8 * 66)
    assert one[:2] == (3, 0) and one[2] >= pivots.BANDS and after[1] == one[2]
    large = pivots.band_numbers({0: 40_000_000}, 8 * 66)
    assert large[0][2] >= 40_000_000 * 8 * 66 / pivots.BAND_BYTES


def test_bands_of_a_query(spark):
    """Every partition used to begin bands of its own."""
    ids, x = crowd(4, 28)
    df, cols = frame(spark, ids, x)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        _, points = pivots._points(df, cols, "id", False)
        pivot_ids, at = pivots.choose_pivots(points)
        _, blocks, _, _ = pivots._laid_out(points, pivot_ids, at, 3.2, 5, 4)
        assert blocks.select("band").distinct().count() <= 2 * pivots.BANDS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_without_id_are_noise_and_neighbours(spark):
    """Five points within reach: the one without an id counts as a neighbour but names nothing."""
    x = np.array([[0.0] * 9, [0.1] * 9, [0.2] * 9, [0.3] * 9, [0.4] * 9, [50.0] * 9])
    df, cols = frame(spark, np.arange(6), x)
    df = df.selectExpr("if(id = 2, null, id) as id", *cols)
    made = {r["id"]: (r["cluster"], r["core"], r["noise"]) for r in pivots.pivot_dbscan(df, cols, 1.3, standardise=False).collect()}
    assert made == {**{i: (0, 1, 0) for i in (0, 1, 3, 4)}, None: (-1, 0, 1), 5: (-1, 0, 1)}


def test_distances_that_are_no_numbers(spark):
    df, cols = frame(spark, np.arange(8), np.full((8, 9), np.nan))
    made = pivots.pivot_dbscan(df, cols, 1.0, standardise=False).collect()
    assert len(made) == 8 and {(r["cluster"], r["core"]) for r in made} == {(-1, 0)}
