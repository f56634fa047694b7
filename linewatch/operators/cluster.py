"""Exact DBSCAN by grid cells.

Points are placed in cells so small that all points of a cell are neighbours. A cell holding ``min_samples`` points is
*dense*: all of them are core and in one cluster, with no pair computed. Only the few points of sparse cells are compared
with the points of nearby cells, so a crowd of close points never meets itself pair by pair. Exact copies are merged
first. Cells near each other are found by a band join that adds coordinates to the bucket of crowded places only.

With more than ``MAX_GRID_COLUMNS`` columns nearly every cell holds one point and has nearly all others nearby, and each further
coordinate asks up to four times as many buckets. There the points are compared in blocks kept apart by pivots (``pivots``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.functions.components import components
from linewatch.operators.pivots import NOISE, pivot_dbscan
from linewatch.operators.scaling import apply_scaler, fit_scaler
from linewatch.session import materialise

MAX_BUCKET_CELLS = 500
MAX_GRID_COLUMNS = 8


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _distance(a: str, b: str, d: int) -> Column:
    return F.sqrt(_sum([(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) ** 2 for i in range(d)]))


def _box_distance(a_lo: str, a_hi: str, b_lo: str, b_hi: str, d: int) -> Column:
    """Smallest distance two boxes allow, with a margin for rounding."""

    def at(name: str, i: int) -> Column:
        return F.get(name, F.lit(i))

    gaps = [
        F.greatest(at(a_lo, i) - at(b_hi, i), at(b_lo, i) - at(a_hi, i), F.lit(0.0)) for i in range(d)
    ]
    return F.sqrt(_sum([g * g for g in gaps])) * (1 - 1e-9)


def near_cells(cells: DataFrame, eps: float, d: int, max_cells: int = MAX_BUCKET_CELLS) -> DataFrame:
    """Ordered pairs ``(a, b)`` of different cells whose boxes come within ``eps``. ``cells``: cell, lo, hi.

    Buckets of side ``eps`` are joined with their neighbours, on the first coordinate at first; buckets with more than
    ``max_cells`` cells go on to a further coordinate, as far as there is one.
    """
    here = F.transform("lo", lambda x: F.floor(x / F.lit(eps)).cast("bigint"))
    top = F.transform("hi", lambda x: F.floor(x / F.lit(eps)).cast("bigint"))
    # a cell may straddle a bucket border: it is at home in the bucket of its lower corner and asks from there on
    placed = materialise(cells.withColumns({"_low": here, "_top": top, "_key": F.array().cast("array<bigint>")}))
    home, asking = placed, placed
    found = None
    for i in range(d):
        home = home.withColumn("_key", F.concat("_key", F.array(F.get("_low", F.lit(i)))))
        reach = F.sequence(F.get("_low", F.lit(i)) - 2, F.get("_top", F.lit(i)) + 1)
        asking = asking.withColumn("_step", F.explode(reach)).withColumn("_key", F.concat("_key", F.array("_step")))
        asking = asking.drop("_step")
        crowded = None
        if i < d - 1:
            sizes = home.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
            crowded = materialise(sizes.filter(F.col("_n") > max_cells).select("_key"))
            if crowded.limit(1).count() == 0:
                crowded = None
        calm_home = home if crowded is None else home.join(crowded, "_key", "left_anti")
        pairs = calm_home.select(
            "_key", F.col("cell").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi")
        ).join(
            asking.select("_key", F.col("cell").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi")),
            "_key",
        )
        pairs = pairs.filter((F.col("a") != F.col("b")) & (_box_distance("a_lo", "a_hi", "b_lo", "b_hi", d) <= eps))
        pairs = pairs.select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        if crowded is None:
            break
        home = materialise(home.join(crowded, "_key", "left_semi"))
        asking = materialise(asking.join(crowded, "_key", "left_semi"))
    return found


def dbscan(
    df: DataFrame,
    cols: Sequence[str],
    eps: float = 0.5,
    min_samples: int = 5,
    id_col: str = "id",
    standardise: bool = True,
    max_cells: int = MAX_BUCKET_CELLS,
) -> DataFrame:
    """``id_col, cluster, core, noise`` per row.

    ``cluster`` is the smallest row id among the core points of the cluster, -1 for noise. A border point joins the
    smallest of the clusters it touches. ``id_col`` is an integer key of the rows.
    """
    cols = list(cols)
    d = len(cols)
    if d > MAX_GRID_COLUMNS:
        return pivot_dbscan(df, cols, eps, min_samples, id_col, standardise)
    rows = df.select(id_col, *cols)
    rows = apply_scaler(rows, fit_scaler(rows, cols)) if standardise else rows
    rows = materialise(rows.select(F.col(id_col).alias("_id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x")))

    side = eps / math.sqrt(d) * (1 - 1e-9)
    cell = F.transform("x", lambda v: F.floor(v / F.lit(side)).cast("bigint"))
    points = rows.groupBy("x").agg(F.min("_id").alias("p"), F.count(F.lit(1)).alias("w")).withColumn("cell", cell)
    points = materialise(points)
    corners = [F.min(F.get("x", F.lit(i))) for i in range(d)], [F.max(F.get("x", F.lit(i))) for i in range(d)]
    cells = points.groupBy("cell").agg(
        F.sum("w").alias("cell_w"), F.array(*corners[0]).alias("lo"), F.array(*corners[1]).alias("hi")
    )
    cells = materialise(cells.withColumn("dense", F.col("cell_w") >= min_samples))
    pairs = materialise(near_cells(cells.select("cell", "lo", "hi"), eps, d, max_cells))
    dense = cells.filter("dense").select("cell")
    sparse_points = points.join(cells.filter("not dense").select("cell", "cell_w"), "cell")

    # Points of sparse cells against nearby cells: totals per dense cell, single points of sparse ones.
    asked = sparse_points.select(F.col("p").alias("q"), F.col("x").alias("qx"), F.col("cell").alias("a")).join(pairs, "a")
    others = points.select("p", "w", F.col("x").alias("px"), F.col("cell").alias("b"))
    within = _distance("qx", "px", d) <= eps
    to_dense = materialise(
        asked.join(others.join(dense.select(F.col("cell").alias("b")), "b"), "b")
        .filter(within)
        .groupBy("q", "a", "b")
        .agg(F.sum("w").alias("w"))
    )
    few = sparse_points.select("p", "w", F.col("x").alias("px"), F.col("cell").alias("b"))
    to_sparse = materialise(asked.join(few, "b").filter(within).select("q", "a", "p", "b", "w"))

    around = to_dense.select("q", "w").unionByName(to_sparse.select("q", "w"))
    counted = (
        sparse_points.select(F.col("p").alias("q"), F.col("cell").alias("a"), "cell_w")
        .join(around.groupBy("q").agg(F.sum("w").alias("w")), "q", "left")
        .select("q", "a", (F.col("cell_w") + F.coalesce("w", F.lit(0)) >= min_samples).alias("core"))
    )
    counted = materialise(counted)
    sparse_core = counted.filter("core")

    # One graph node per cell with core points, named by its smallest core point.
    nodes = (
        sparse_core.select(F.col("q").alias("p"), F.col("a").alias("cell"))
        .unionByName(points.join(dense, "cell").select("p", "cell"))
        .groupBy("cell")
        .agg(F.min("p").alias("node"))
    )
    nodes = materialise(nodes)
    cores = sparse_core.select("q")
    links = to_dense.join(cores, "q").select("a", "b").unionByName(
        to_sparse.join(cores, "q").join(cores.withColumnRenamed("q", "p"), "p").select("a", "b")
    )
    sure, open_pairs = _dense_links(points, dense, pairs, eps, d)
    links = links.unionByName(sure).distinct()

    def as_nodes(cell_links: DataFrame) -> DataFrame:
        left = nodes.select(F.col("cell").alias("a"), F.col("node").alias("u"))
        right = nodes.select(F.col("cell").alias("b"), F.col("node").alias("v"))
        return cell_links.join(left, "a").join(right, "b").select("u", "v")

    edges = materialise(as_nodes(links))
    roots = components(edges)
    if open_pairs.limit(1).count():
        extra = _open_links(points, cells, nodes, roots, open_pairs, eps, d)
        roots = components(edges.unionByName(as_nodes(extra)))

    labelled = nodes.join(roots.withColumnRenamed("root", "label"), "node", "left").select(
        "cell", F.coalesce("label", "node").alias("label")
    )
    labelled = materialise(labelled)

    # Border points: sparse, not core, next to a core point in their own or a nearby cell.
    border = counted.filter("not core")
    touching = (
        border.select("q", F.col("a").alias("b"))
        .unionByName(to_dense.join(border.select("q"), "q").select("q", "b"))
        .unionByName(
            to_sparse.join(border.select("q"), "q").join(cores.withColumnRenamed("q", "p"), "p").select("q", "b")
        )
    )
    borders = touching.join(labelled.withColumnRenamed("cell", "b"), "b").groupBy("q").agg(F.min("label").alias("label"))
    core_labels = (
        sparse_core.select(F.col("q").alias("p"), F.col("a").alias("cell"))
        .unionByName(points.join(dense, "cell").select("p", "cell"))
        .join(labelled, "cell")
        .select("p", "label", F.lit(1).alias("core"))
    )
    known = core_labels.unionByName(borders.select(F.col("q").alias("p"), "label", F.lit(0).alias("core")))
    by_point = points.select("x", "p").join(known, "p", "left")
    return rows.join(by_point, "x").select(
        F.col("_id").alias(id_col),
        F.coalesce("label", F.lit(NOISE)).cast("bigint").alias("cluster"),
        F.coalesce("core", F.lit(0)).alias("core"),
        F.when(F.col("label").isNull(), 1).otherwise(0).alias("noise"),
    )


def _dense_links(points: DataFrame, dense: DataFrame, pairs: DataFrame, eps: float, d: int):
    """Dense cell pairs shown to touch by their outermost points, and the pairs this leaves open."""
    both = (
        pairs.filter(F.col("a") < F.col("b"))
        .join(dense.select(F.col("cell").alias("a")), "a", "left_semi")
        .join(dense.select(F.col("cell").alias("b")), "b", "left_semi")
    )
    inside = points.join(dense, "cell")
    outer = inside.groupBy("cell").agg(
        F.array_distinct(
            F.array(
                *[F.min_by("x", F.struct(F.get("x", F.lit(i)), "p")) for i in range(d)],
                *[F.max_by("x", F.struct(F.get("x", F.lit(i)), "p")) for i in range(d)],
            )
        ).alias("outer")
    )
    tested = both.join(outer.select(F.col("cell").alias("a"), F.col("outer").alias("ao")), "a").join(
        outer.select(F.col("cell").alias("b"), F.col("outer").alias("bo")), "b"
    )

    def close(p: Column, q: Column) -> Column:
        gap = F.aggregate(F.zip_with(p, q, lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda acc, v: acc + v)
        return F.sqrt(gap) <= eps

    touch = F.exists("ao", lambda p: F.exists("bo", lambda q: close(p, q)))
    tested = materialise(tested.select("a", "b", touch.alias("touch")))
    return tested.filter("touch").select("a", "b"), tested.filter("not touch").select("a", "b")


def _open_links(points, cells, nodes, roots, open_pairs: DataFrame, eps: float, d: int) -> DataFrame:
    """Of the open dense pairs in different components, those with two points within ``eps``.

    Only points that reach the box of the other cell are compared.
    """
    of_cell = nodes.join(roots, "node", "left").select("cell", F.coalesce("root", "node").alias("root"))
    crossing = (
        open_pairs.join(of_cell.select(F.col("cell").alias("a"), F.col("root").alias("ra")), "a")
        .join(of_cell.select(F.col("cell").alias("b"), F.col("root").alias("rb")), "b")
        .filter("ra <> rb")
        .select("a", "b")
    )
    crossing = materialise(crossing)
    boxes = cells.select("cell", "lo", "hi")

    def reaching(own: str, other: str, name: str) -> DataFrame:
        near = crossing.join(boxes.withColumnRenamed("cell", other), other).join(
            points.select(F.col("cell").alias(own), F.col("x").alias(name)), own
        )
        return near.filter(_box_distance(name, name, "lo", "hi", d) <= eps).select("a", "b", name)

    met = reaching("a", "b", "px").join(reaching("b", "a", "qx"), ["a", "b"])
    return met.filter(_distance("px", "qx", d) <= eps).select("a", "b").distinct()


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Number of clusters, outliers and their share."""
    return clustered.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_distinct(F.when(F.col("noise") == 0, F.col("cluster"))).alias("clusters"),
        F.sum("core").alias("core_points"),
        F.sum("noise").alias("outliers"),
        F.avg("noise").alias("outlier_rate"),
    )
