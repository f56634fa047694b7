"""Exact DBSCAN in many dimensions, pruned by pivots.

Cells of a grid hold one point each once there are dozens of coordinates. Here every point goes to the nearest of a bounded
number of pivots (points drawn by hash), and the points of a pivot are cut, by their distance to it, into blocks. By the triangle
inequality two points can be within ``eps`` only if their distances to *every* pivot differ by at most ``eps``. So a block meets the
blocks of another pivot only where its own distances to that pivot reach; all other pairs of blocks are never formed.

A pivot with points of weight ``min_samples`` within ``eps / 2`` has a *ball*: its points are core and in one cluster without being
compared. Balls whose pivots are within ``eps`` of one another are one cluster as well, also without comparison.

Blocks that meet are compared in cells of bands by bands, so that the bytes of a block travel once per band it meets. There are about
``BANDS`` bands whatever the number of points or partitions, more only where a band would outgrow ``BAND_BYTES``: what travels grows with
the points. Both passes over the cells reduce inside the task: the first to counts per point, the second to a spanning forest and, for
border points, one core point of each group they touch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.functions.components import components
from linewatch.operators.scaling import apply_scaler, fit_scaler
from linewatch.session import materialise, working_path

MAX_PIVOTS = 512  # pivots x columns numbers are sent to all tasks
BLOCK = 1024
BANDS = 16
BAND_BYTES = 128 << 20  # of points in a band, where 16 bands would be larger
TOUCHES = 1 << 20  # border points and groups listed before repeats are dropped
NOISE = -1
NO_ID = np.iinfo(np.int64).min  # points all of whose rows lack an id: neighbours of others, themselves noise
ROUNDING = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``, exact to rounding noise of the sum of squares."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows are within ``eps``; where rounding could decide, by the plain sum of squared differences."""
    found = distances(a, b)
    size = max(float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)), eps) * a.shape[1] ** 0.5
    unsure = np.abs(found - eps) <= 1e-6 * size
    near = found <= eps
    i, j = np.nonzero(unsure)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        total = np.zeros(len(p))
        for c in range(a.shape[1]):  # coordinate by coordinate, in order
            total += (a[p, c] - b[q, c]) ** 2
        near[p, q] = np.sqrt(total) <= eps
    return near


def _points(df: DataFrame, cols: Sequence[str], id_col: str, standardise: bool) -> tuple[DataFrame, DataFrame]:
    rows = df.select(id_col, *cols)
    rows = apply_scaler(rows, fit_scaler(rows, list(cols))) if standardise else rows
    x = F.array(*[F.col(c).cast("double") for c in cols])
    rows = materialise(rows.select(F.col(id_col).cast("bigint").alias("_id"), x.alias("x")))
    points = rows.groupBy("x").agg(F.min("_id").alias("p"), F.count(F.lit(1)).alias("w"))
    return rows, materialise(points.select("p", "w", "x"))


def choose_pivots(points: DataFrame, most: int = MAX_PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and coordinates of twice the root of the number of points, at most ``most``, by smallest hash of the id."""
    n = points.count()
    k = min(most, max(1, int(2 * n**0.5)), max(n, 1))
    rows = points.filter("p is not null").orderBy(F.xxhash64("p"), "p").limit(k).select("p", "x").collect()
    return np.array([r["p"] for r in rows], np.int64), np.array([r["x"] for r in rows], float)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def placed(points: DataFrame, pivots: np.ndarray, eps: float) -> DataFrame:
    """``(c, ball, r, p, w, x)``, materialised: the nearest pivot, whether within half of ``eps`` of it, and the distance."""
    d = pivots.shape[1]

    def nearest(batches):
        for batch in batches:
            far = distances(_matrix(batch.column(2), d), pivots)
            c = far.argmin(1)
            r = far[np.arange(len(c)), c]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c), pa.array(r <= eps / 2 * (1 - ROUNDING) - ROUNDING), pa.array(r), *batch.columns], ["c", "ball", "r", "p", "w", "x"]
            )

    named = points.select(F.coalesce("p", F.lit(NO_ID)).alias("p"), "w", "x")
    return materialise(named.mapInArrow(nearest, "c long, ball boolean, r double, p long, w long, x array<double>"))


def band_numbers(sizes: dict[int, int], row_bytes: int) -> list[tuple[int, int, int]]:
    """``(pivot, first band, bands)``: neighbouring pivots share a band, the blocks of a large one are dealt over several."""
    most = max(1, min(-(-sum(sizes.values()) // BANDS), BAND_BYTES // row_bytes))
    found, band, held = [], 0, 0
    for c, n in sorted(sizes.items()):
        if held and held + n > most:
            band, held = band + 1, 0
        parts = -(-n // most)
        found.append((c, band, parts))
        band, held = (band, held + n) if parts == 1 else (band + parts, 0)
    return found


def blocks_of(laid: DataFrame, pivots: np.ndarray, eps: float, balls: set[int], block: int = BLOCK) -> DataFrame:
    """Blocks of points of one pivot, side by side in distance, with the pivots they reach and how far those are.

    ``(block, band, c, ball, r_low, r_high, near(q, low, high), n, ids, weights, cells)``; ``ball`` only where the pivot has one.
    """
    d, many = pivots.shape[1], len(pivots)
    radius = np.zeros(many)
    sizes = {}
    for r in laid.groupBy("c").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # one row per pivot
        radius[r["c"]], sizes[r["c"]] = r["r"], r["n"]
    bands = {c: (first, parts) for c, first, parts in band_numbers(sizes, 8 * (d + 2))}
    owners = F.col("c").isin(sorted(balls)) if balls else F.lit(False)
    keys = ["c", "_in", "r", "p"]
    parts = int(laid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = laid.withColumn("_in", F.col("ball") & owners).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    slack = eps * (1 + ROUNDING) + 1e-6 * (1 + float(np.abs(pivots).max(initial=0)))

    def cut(batches):
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= 8 * block:
                rows, held = split(held, False)
                for row in rows:
                    yield emit(row, task + number)
                    number += 1
        if held is not None:
            for row in split(held, True)[0]:
                yield emit(row, task + number)
                number += 1

    def split(table, last):
        """Whole blocks of the table, and what may still grow."""
        c, inside = (table.column(k).to_numpy() for k in ("c", "_in"))
        borders = np.flatnonzero((np.diff(c) != 0) | (np.diff(inside.astype(int)) != 0)) + 1
        starts = np.r_[0, borders]
        cuts = np.concatenate([np.arange(b, e, block) for b, e in zip(starts, np.r_[borders, len(c)])])
        ends = np.r_[cuts[1:], len(c)]
        if not last:
            cuts, ends = cuts[:-1], ends[:-1]
        rest = table.slice(int(ends[-1])) if len(ends) else table
        return [table.slice(int(b), int(e - b)) for b, e in zip(cuts, ends)], rest

    def emit(rows, name):
        rows = rows.combine_chunks()
        x = _matrix(rows.column("x").combine_chunks(), d)
        far = distances(x, pivots)
        low, high = far.min(0), far.max(0)
        reach = np.flatnonzero(low - radius <= slack)
        near = [{"q": int(q), "low": float(low[q]), "high": float(high[q])} for q in reach]
        r = rows.column("r").to_numpy()
        first, parts = bands[rows.column("c")[0].as_py()]
        kinds = pa.list_(pa.struct([("q", pa.int64()), ("low", pa.float64()), ("high", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name]), pa.array([first + (name & 0xFFFFFFFF) % parts]), rows.column("c").combine_chunks().slice(0, 1),
                rows.column("_in").combine_chunks().slice(0, 1), pa.array([float(r.min())]), pa.array([float(r.max())]), pa.array([near], kinds),
                pa.array([rows.num_rows]), pa.array([rows.column("p").to_numpy().tobytes()]), pa.array([rows.column("w").to_numpy().tobytes()]),
                pa.array([np.ascontiguousarray(x).tobytes()]),
            ],
            ["block", "band", "c", "ball", "r_low", "r_high", "near", "n", "ids", "weights", "cells"],
        )

    schema = (
        "block long, band long, c long, ball boolean, r_low double, r_high double, near array<struct<q: long, low: double, high: double>>, "
        "n long, ids binary, weights binary, cells binary"
    )
    path = working_path(laid.sparkSession, "pivot-blocks")
    ordered.select("c", "_in", "r", "p", "w", "x").mapInArrow(cut, schema).write.parquet(path)
    return laid.sparkSession.read.schema(schema).parquet(path)


def meeting_blocks(blocks: DataFrame, linked: dict[int, int], eps: float, margin: float) -> DataFrame:
    """``(a, b)`` of blocks, a <= b, that the pivots cannot keep apart; not those of balls that are one cluster anyway."""
    spark = blocks.sparkSession
    groups = spark.createDataFrame(sorted(linked.items()) or [(-1, -1)], "c long, _group long")  # at most one row per pivot
    heads = blocks.select("block", "band", "c", "ball", "r_low", "r_high", "near", "n").join(F.broadcast(groups), "c", "left")
    heads = heads.withColumn("_group", F.when(F.col("ball"), F.col("_group")))
    asking = heads.select(
        F.col("block").alias("a"), F.col("band").alias("a_band"), F.col("n").alias("a_n"), F.col("_group").alias("_ga"), F.explode("near").alias("_near")
    ).select("a", "a_band", "a_n", "_ga", F.col("_near.q").alias("c"), F.col("_near.low").alias("_low"), F.col("_near.high").alias("_high"))
    there = heads.select(
        F.col("block").alias("b"), F.col("band").alias("b_band"), F.col("n").alias("b_n"), F.col("_group").alias("_gb"), "c", "r_low", "r_high"
    )
    reach = F.lit(eps * (1 + ROUNDING) + margin)
    met = asking.join(there, "c").filter(
        (F.col("a") <= F.col("b")) & (F.col("r_low") <= F.col("_high") + reach) & (F.col("r_high") >= F.col("_low") - reach)
    )
    known = F.col("_ga").isNotNull() & F.col("_ga").eqNullSafe(F.col("_gb"))
    return met.filter(~known).select("a", "a_band", "a_n", "b", "b_band", "b_n")


def _cells(pairs: DataFrame, blocks: DataFrame, payload: list[str]):
    """Pairs and the blocks they need, grouped by (band, band); a pair of blocks stands in the cell of the smaller band first."""
    cell = [F.least("a_band", "b_band").alias("_one"), F.greatest("a_band", "b_band").alias("_two")]
    lists = pairs.select(*cell, "a", "b")
    needed = pairs.select(*cell, F.explode(F.array("a", "b")).alias("block")).distinct()
    bytes_of = needed.join(blocks.select("block", *payload), "block")
    return lists.groupBy("_one", "_two"), bytes_of.groupBy("_one", "_two")


def pivot_dbscan(
    df: DataFrame,
    cols: Sequence[str],
    eps: float,
    min_samples: int = 5,
    id_col: str = "id",
    standardise: bool = True,
    pivots: int = MAX_PIVOTS,
    block: int = BLOCK,
) -> DataFrame:
    """``id_col, cluster, core, noise`` per row, as ``cluster.dbscan`` defines them, for any number of columns."""
    rows, points = _points(df, cols, id_col, standardise)
    d = len(cols)
    pivot_ids, at = choose_pivots(points, pivots)
    if not len(pivot_ids):
        none = F.lit(NOISE).cast("bigint")
        return rows.select(F.col("_id").alias(id_col), none.alias("cluster"), F.lit(0).alias("core"), F.lit(1).alias("noise"))
    laid, blocks, pairs, linked = _laid_out(points, pivot_ids, at, eps, min_samples, block)

    def loaded(table: pa.Table, extra: Sequence[str] = ()) -> dict:
        found = {}
        column = {k: table.column(k) for k in ("block", "cells", "ids", "weights", *extra)}
        for at in range(table.num_rows):  # the bytes stay where Arrow has them
            x, p, w = (np.frombuffer(column[k][at].as_buffer(), t) for k, t in (("cells", np.float64), ("ids", np.int64), ("weights", np.int64)))
            found[column["block"][at].as_py()] = (x.reshape(-1, d), p, w, *(column[k][at].as_py() for k in extra))
        return found

    def listed(lists: pa.Table):
        return zip(lists.column("a").to_pylist(), lists.column("b").to_pylist())

    def counts(lists: pa.Table, needed: pa.Table) -> pa.Table:
        held = loaded(needed)
        total = {name: np.zeros(len(v[1]), np.int64) for name, v in held.items()}
        for a, b in listed(lists):
            near = within(held[a][0], held[b][0], eps)
            total[a] += near @ held[b][2]
            if a != b:
                total[b] += held[a][2] @ near
        return pa.table({"block": pa.array(list(total), pa.int64()), "counts": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    def flags(table: pa.Table) -> pa.Table:
        """Core points of one block, from the counts of all cells it was in."""
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "core": pa.array([(total >= min_samples).tobytes()], pa.binary())})

    lists, bytes_of = _cells(pairs, blocks, ["ids", "weights", "cells"])
    counted = lists.cogroup(bytes_of).applyInArrow(counts, "block long, counts binary")
    cores = counted.groupBy("block").applyInArrow(flags, "block long, core binary")
    flagged = materialise(blocks.select("block", "c", "ball", "n", "ids", "weights", "cells").join(cores, "block", "left"))

    def core_flags(ids: np.ndarray, flag: bytes | None, ball: bool) -> np.ndarray:
        """A block without counts met nothing, not even itself: its distances are no numbers."""
        found = np.full(len(ids), ball) if ball or flag is None else np.frombuffer(flag, bool)
        return found & (ids != NO_ID)

    def distinct(touches: list[np.ndarray], group: np.ndarray) -> np.ndarray:
        """Border points next to the groups they touch, as the groups are now, each once."""
        both = np.concatenate(touches, axis=1) if touches else np.zeros((2, 0), np.int64)
        return np.unique(np.stack([both[0], group[both[1]]]), axis=1)

    def forest(lists: pa.Table, needed: pa.Table) -> pa.Table:
        held = loaded(needed, ("core", "ball"))
        begin, core, ids, n = {}, [], [], 0
        for name, (x, p, _, flag, ball) in held.items():
            begin[name] = n
            n += len(p)
            ids.append(p)
            core.append(core_flags(p, flag, ball))
        ids, core, group = np.concatenate(ids), np.concatenate(core), np.arange(n)
        edges, touches, room = [], [], TOUCHES
        for a, b in listed(lists):
            i, j = np.nonzero(within(held[a][0], held[b][0], eps))
            i, j = i + begin[a], j + begin[b]
            both = core[i] & core[j]
            u, v = i[both], j[both]
            while len(u):  # link each group once per round, then forget pairs inside one group
                apart = group[u] != group[v]
                u, v = u[apart], v[apart]
                if not len(u):
                    break
                low, high = np.minimum(group[u], group[v]), np.maximum(group[u], group[v])
                picked, first = np.unique(high, return_index=True)  # each group joins one smaller group
                edges.append(np.stack([ids[u[first]], ids[v[first]]]))
                parent = np.arange(n)
                parent[picked] = low[first]
                while not np.array_equal(up := parent[parent], parent):
                    parent = up
                group = parent[group]
            for p, q in ((i, j), (j, i)):
                rim = ~core[p] & core[q] & (ids[p] != NO_ID)
                touches.append(np.unique(np.stack([p[rim], group[q[rim]]]), axis=1))
            if sum(t.shape[1] for t in touches) > room:
                touches = [distinct(touches, group)]
                room = TOUCHES + 2 * touches[0].shape[1]
        touching = distinct(touches, group)
        found = np.concatenate([*edges, ids[touching]], axis=1) if edges or touching.size else np.zeros((2, 0), np.int64)
        kinds = np.r_[np.zeros(found.shape[1] - touching.shape[1], bool), np.ones(touching.shape[1], bool)]
        return pa.table([pa.array(found[0]), pa.array(found[1]), pa.array(kinds)], names=["u", "v", "rim"])

    lists, bytes_of = _cells(pairs, flagged, ["ids", "weights", "cells", "core", "ball"])
    links = materialise(lists.cogroup(bytes_of).applyInArrow(forest, "u long, v long, rim boolean"))
    spark = df.sparkSession
    # Balls: all points hang on their pivot, and pivots of one group on the first of them.
    of_ball = spark.createDataFrame([(c, int(pivot_ids[c])) for c in linked] or [(-1, -1)], "c long, v long")
    stars = laid.filter("ball").filter(F.col("p") != NO_ID).join(F.broadcast(of_ball), "c").select(F.col("p").alias("u"), "v")
    tied = spark.createDataFrame([(int(pivot_ids[c]), int(pivot_ids[g])) for c, g in linked.items()] or [(-1, -1)], "u long, v long")
    edges = links.filter("not rim").select("u", "v").unionByName(stars).unionByName(tied).filter("u <> v")
    roots = components(materialise(edges))

    def core_ids(batches):
        for batch in batches:
            for ids, flag, ball in zip(*(batch.column(i).to_pylist() for i in range(3))):
                p = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p[core_flags(p, flag, ball)])], ["p"])

    core_points = flagged.select("ids", "core", "ball").mapInArrow(core_ids, "p long")
    named = materialise(
        core_points.join(roots.select(F.col("node").alias("p"), "root"), "p", "left").select("p", F.coalesce("root", "p").alias("label"))
    )
    rim = links.filter("rim").join(named.withColumnRenamed("p", "v"), "v").groupBy(F.col("u").alias("p")).agg(F.min("label").alias("label"))
    known = named.withColumn("core", F.lit(1)).unionByName(rim.withColumn("core", F.lit(0)))
    by_point = points.select("x", "p").join(known, "p", "left")
    return rows.join(by_point, "x").select(
        F.col("_id").alias(id_col),
        F.coalesce("label", F.lit(NOISE)).cast("bigint").alias("cluster"),
        F.coalesce("core", F.lit(0)).alias("core"),
        F.when(F.col("label").isNull(), 1).otherwise(0).alias("noise"),
    )


def _laid_out(points: DataFrame, pivot_ids: np.ndarray, at: np.ndarray, eps: float, min_samples: int, block: int):
    laid = placed(points, at, eps)
    heavy = laid.filter("ball").groupBy("c").agg(F.sum("w").alias("w")).filter(F.col("w") >= min_samples)
    balls = {r["c"] for r in heavy.collect()}  # one row per pivot at most
    linked = _groups(sorted(balls), at, eps)
    blocks = blocks_of(laid, at, eps, balls, block)
    margin = 1e-6 * (1 + float(np.abs(at).max(initial=0)))
    return laid, blocks, materialise(meeting_blocks(blocks, linked, eps, margin)), linked


def _groups(balls: list[int], at: np.ndarray, eps: float) -> dict[int, int]:
    """For each pivot with a ball the first pivot of its group: pivots are points, so those within ``eps`` are linked."""
    if not balls:
        return {}
    near = within(at[balls], at[balls], eps)
    group = np.arange(len(balls))
    while True:
        made = np.where(near, group[None], len(balls)).min(1)
        if np.array_equal(made, group):
            return {b: balls[g] for b, g in zip(balls, group.tolist())}
        group = made


def compared_pairs(
    df: DataFrame, cols: Sequence[str], eps: float, min_samples: int = 5, id_col: str = "id", standardise: bool = True,
    pivots: int = MAX_PIVOTS, block: int = BLOCK,
) -> DataFrame:
    """How many pairs of points the pivots leave to compare, next to all pairs: ``points, all_pairs, compared, share``."""
    _, points = _points(df, cols, id_col, standardise)
    pivot_ids, at = choose_pivots(points, pivots)
    if not len(pivot_ids):
        return df.sparkSession.createDataFrame([(0, 0, 0, 0.0)], "points long, all_pairs long, compared long, share double")
    _, blocks, pairs, _ = _laid_out(points, pivot_ids, at, eps, min_samples, block)
    n = blocks.agg(F.sum("n").alias("points"))
    own = F.col("a_n") * (F.col("a_n") - 1) / 2
    met = pairs.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), own).otherwise(F.col("a_n") * F.col("b_n"))), F.lit(0)).cast("long").alias("compared"))
    every = (F.col("points") * (F.col("points") - 1) / 2).cast("long")
    return n.crossJoin(met).select("points", every.alias("all_pairs"), "compared", F.try_divide("compared", every).alias("share"))
