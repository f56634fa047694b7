"""Column-block k-means against brute force in whole numbers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from linewatch.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string"


def brute(rows, k=8, rounds=10, dims=64):
    """Every step of the contract in Python integers."""
    kept = [
        (i, [math.floor(1024 * float(np.float32(x))) for x in v])
        for i, v, *_ in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    mark = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [x for _, x in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for j, g in groups.items():
            centres[j] = [sum(c) // len(g) for c in zip(*g)]
    found = [(i, *reversed(nearest(x))) for i, x in kept]
    per = {}
    for _, j, d in found:
        per[j] = per.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((str(i), j, d, per[j], sum(per.values()), sha[j]) for i, j, d in found))


def awkward(seed, n, spread=1.0):
    rng = random.Random(seed)
    hubs = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [float(np.float32(spread * (h + rng.gauss(0, 0.3)))) for h in rng.choice(hubs)], 0, "own", "x") for i in range(n)]
    rows += [rows[0]] * 40 + [(0, rows[1][1], 1, None, None), (None, rows[2][1], 1, None, None), (None, rows[2][1], 1, None, None)]
    rows += [(900, None, 0, "", ""), (901, [], 0, "", ""), (902, [1.0] * 63, 0, "", ""), (903, [1.0] * 65, 0, "", "")]
    rows += [(904, [1.0] * 63 + [None], 0, "", ""), (905, [float("nan")] * 64, 0, "", ""), (906, [float("inf")] + [0.0] * 63, 0, "", "")]
    rows += [(907 + i, [0.0] * 64, 0, "", "") for i in range(5)]
    return rows


@pytest.mark.parametrize("seed,n,spread,width,chunk", [(1, 150, 1.0, 32, 4096), (2, 90, 9000.0, 7, 16), (3, 3, 1.0, 64, 2)])
def test_equals_brute_force(spark, seed, n, spread, width, chunk):
    rows = awkward(seed, n, spread)
    made = centroids.centroid_clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), width=width, chunk_rows=chunk)
    assert made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in made.collect()) == brute(rows)


def test_few_and_no_vectors(spark):
    for rows in ([], [(1, None, 0, "", "")], [(1, [0.5] * 64, 0, "", "")], [(i, [0.25] * 64, 0, "", "") for i in range(20)]):
        made = centroids.centroid_clusters(spark.createDataFrame(rows, SCHEMA))
        assert sorted((str(r[0]), *r[1:]) for r in made.collect()) == brute(rows)


def test_partial_distances_of_large_and_small_numbers():
    rng = np.random.default_rng(5)
    for most in (10, 1 << 20, 1 << 26):
        x, c = rng.integers(-most, most, (50, 32)), rng.integers(-most, most, (8, 32))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in c] for u in x]
        assert centroids.partial_distances(x.astype(np.int32), c).astype(object).tolist() == want


def test_components_that_overflow_are_refused(spark):
    rows = [(1, [1e6] * 64, 0, "", "")]
    with pytest.raises(Exception, match="overflow"):
        centroids.centroid_clusters(spark.createDataFrame(rows, SCHEMA)).collect()


def test_rounds_run_no_more_tasks_than_blocks(spark):
    """With many shuffle partitions and few blocks every stage of a round ran a task per partition."""
    rng = np.random.default_rng(8)
    table = spark.createDataFrame([(i, rng.normal(0, 1, 8).tolist()) for i in range(60)], "vec_id long, embedding array<double>").coalesce(2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    wanted = {tuple(r) for r in centroids.centroid_clusters(table, dims=8, width=4, rounds=2).collect()}
    context = spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        blocks = centroids.column_blocks(centroids.integer_vectors(table, dims=8), 8, 4)
        whole = centroids.integer_vectors(table, dims=8)
        start = centroids.starting_centroids(whole)
        context.setJobGroup("rounds", "rounds")
        labels, _, cells = centroids.lloyd(blocks, start, rounds=2, width=4)
        labels.collect()
        cells.unpersist()
        stages = [i for job in context.statusTracker().getJobIdsForGroup("rounds") for i in context.statusTracker().getJobInfo(job).stageIds]
        tasks = [s.numTasks for s in map(context.statusTracker().getStageInfo, stages) if s]
        assert tasks and max(tasks) <= 8
        assert {tuple(r) for r in centroids.centroid_clusters(table, dims=8, width=4, rounds=2).collect()} == wanted
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
