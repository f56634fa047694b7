"""Isolation forest: one pass draws the tree samples, trees grow in parallel, scoring is a vectorised column.

Path lengths and normalisation follow Liu, Ting and Zhou, "Isolation Forest" (2008).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewatch.functions import exprs as X
from linewatch.functions.quantiles import exact_quantiles, quantile_name
from linewatch.operators.scaling import Scaler, apply_scaler, fit_scaler
from linewatch.schemas import PAIR_KEYS

DEFAULT_THRESHOLD = -0.5
SAMPLE_SIZE = 256
EULER = 0.5772156649
NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, path double"
_HASH_SPACE = 1 << 40


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


@dataclass(frozen=True)
class ForestModel:
    """Scaler, tree nodes and parameters. At most (2 * sample size - 1) nodes per tree."""

    profile: str
    scaler: Scaler
    nodes: pd.DataFrame
    sample_size: int
    trees: int
    contamination: float = 0.01
    seed: int = 42
    threshold: float | None = None
    notes: dict = field(default_factory=dict)

    @property
    def columns(self) -> tuple[str, ...]:
        return self.scaler.columns


class ProfileMismatch(ValueError):
    """Features and model come from different feature definitions."""


def tag_profile(df: DataFrame, profile: str) -> DataFrame:
    """Record on the key column which definition the features follow."""
    return df.withMetadata("time_window", {"profile": profile})


def profile_of(df: DataFrame) -> str | None:
    for f in df.schema.fields:
        if f.name == "time_window":
            return f.metadata.get("profile")
    return None


# -- fitting ---------------------------------------------------------------------------------------------------------


def tree_samples(
    df: DataFrame, keys: Sequence[str], rows: int, trees: int, sample_size: int, seed: int
) -> DataFrame:
    """``sample_size`` distinct rows per tree, chosen by a hash of the row key, the tree and the seed.

    The choice depends on the data only, not on its partitioning. Rows above a hash cut are dropped before the
    exchange; the cut lets through eight deviations more than needed.
    """
    wanted = min(sample_size, rows)
    share = min(1.0, (wanted + 8.0 * math.sqrt(wanted) + 8.0) / rows)
    cut = int(share * _HASH_SPACE) if share < 1.0 else _HASH_SPACE

    def draw(tree: Column) -> Column:
        return F.pmod(F.xxhash64(*keys, tree, F.lit(seed)), F.lit(_HASH_SPACE))

    candidates = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < cut)
    spread = df.withColumn("tree", F.explode(candidates)).withColumn("_draw", draw(F.col("tree")))
    order = Window.partitionBy("tree").orderBy("_draw", *keys)
    return spread.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= wanted)


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one isolation tree in preorder, from at most ``sample_size`` rows."""
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 if side == "l" else 4] = me
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append([me, -1, 0.0, -1, -1, depth + average_path(len(rows))])
            continue
        f = int(rng.choice(usable))
        split = float(rng.uniform(low[f], high[f]))
        if split >= high[f]:
            split = float(low[f])
        nodes.append([me, f, split, -1, -1, 0.0])
        goes_left = part[:, f] <= split
        todo.append((rows[~goes_left], depth + 1, me, "r"))
        todo.append((rows[goes_left], depth + 1, me, "l"))
    return [tuple(n) for n in nodes]


def fit_forest(
    df: DataFrame,
    cols: Sequence[str],
    contamination: float = 0.01,
    trees: int = 100,
    seed: int = 42,
    sample_size: int = SAMPLE_SIZE,
    keys: Sequence[str] = tuple(PAIR_KEYS),
    profile: str | None = None,
    scaler: Scaler | None = None,
) -> ForestModel:
    """Standardise, draw one sample per tree and grow the trees. ``keys`` must identify a row."""
    cols = list(cols)
    if scaler is None:
        scaler = fit_scaler(df, cols)
    scaled = apply_scaler(df.select(*keys, *cols), scaler)
    rows = scaler.rows if scaler.rows is not None else df.count()
    if rows == 0:
        raise ValueError("no rows to fit a forest on")
    psi = min(sample_size, rows)
    limit = math.ceil(math.log2(max(psi, 2)))
    sample = tree_samples(scaled, keys, rows, trees, sample_size, seed)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        part = part.sort_values("_rank")
        grown = _grow(part[cols].to_numpy(float), limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(grown, columns=["node", "feature", "split", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    nodes = (
        sample.select("tree", "_rank", *cols)
        .groupBy("tree")
        .applyInPandas(build, NODE_SCHEMA)
        .toPandas()
        .sort_values(["tree", "node"], ignore_index=True)
    )
    return ForestModel(
        profile=profile or profile_of(df) or "register",
        scaler=scaler,
        nodes=nodes,
        sample_size=psi,
        trees=trees,
        contamination=contamination,
        seed=seed,
    )


# -- scoring ---------------------------------------------------------------------------------------------------------


def _scorer(model: ForestModel):
    nodes = model.nodes.sort_values(["tree", "node"], ignore_index=True)
    start = nodes.groupby("tree").head(1).index.to_numpy()
    offset = nodes["tree"].map(dict(zip(nodes.loc[start, "tree"], start, strict=True))).to_numpy()
    feature = nodes["feature"].to_numpy(np.int64)
    split = nodes["split"].to_numpy(float)
    left = nodes["left"].to_numpy(np.int64) + offset
    right = nodes["right"].to_numpy(np.int64) + offset
    path = nodes["path"].to_numpy(float)
    here = np.arange(len(nodes))
    leaf = feature < 0
    left, right, feature = np.where(leaf, here, left), np.where(leaf, here, right), np.where(leaf, 0, feature)
    scale = max(average_path(model.sample_size), 1e-12)
    roots = start

    def score(x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(roots, (len(x), len(roots))).copy()
        row = np.arange(len(x))[:, None]
        while True:
            step = np.where(x[row, feature[at]] <= split[at], left[at], right[at])
            if np.array_equal(step, at):
                break
            at = step
        return -np.power(2.0, -path[at].mean(axis=1) / scale)

    return score


def score_column(model: ForestModel) -> Column:
    """Anomaly score from already standardised columns; only these columns travel to Python, in Arrow batches."""
    score = _scorer(model)

    @F.pandas_udf(T.DoubleType())
    def forest_score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(score(batch.to_numpy(float)))

    return forest_score(F.struct(*model.scaler.expressions()))


def score(features: DataFrame, model: ForestModel) -> DataFrame:
    """Add ``anomaly_score`` in (-1, 0); lower is more anomalous."""
    found = profile_of(features)
    if found is not None and found != model.profile:
        raise ProfileMismatch(f"features follow the {found} profile, the model the {model.profile} profile")
    absent = [c for c in model.columns if c not in features.columns]
    full = features.withColumns({c: F.lit(0.0) for c in absent}) if absent else features
    return full.withColumn("anomaly_score", score_column(model)).drop(*absent)


def contamination_threshold(scored: DataFrame, contamination: float) -> float:
    row = exact_quantiles(scored, "anomaly_score", [contamination]).first()
    return row[quantile_name(contamination)]


def flag_contamination(scored: DataFrame, contamination: float = 0.01) -> DataFrame:
    """``anomaly`` = 1 strictly below the score quantile that the expected share of anomalies names."""
    limit = contamination_threshold(scored, contamination)
    return flag_fixed(scored, limit)


def flag_fixed(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``anomaly`` = 1 where the score is below the threshold."""
    return scored.withColumn("anomaly", F.when(F.col("anomaly_score") < F.lit(threshold), 1).otherwise(0))


def path_expression(model: ForestModel, tree: int) -> Column:
    """One small tree as a CASE expression over standardised columns, to check the traversal."""
    part = model.nodes[model.nodes["tree"] == tree].set_index("node")
    scaled = model.scaler.expressions()

    def walk(node: int) -> Column:
        n = part.loc[node]
        if n["feature"] < 0:
            return F.lit(float(n["path"]))
        below = scaled[int(n["feature"])] <= F.lit(float(n["split"]))
        return F.when(below, walk(int(n["left"]))).otherwise(walk(int(n["right"])))

    return walk(0)


# -- storage ---------------------------------------------------------------------------------------------------------


def save_model(spark: SparkSession, model: ForestModel, path: str) -> None:
    """Tables ``scaler`` and ``nodes`` and a one-line ``meta`` below ``path``."""
    model.scaler.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
    spark.createDataFrame(model.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = {
        "profile": model.profile,
        "columns": list(model.columns),
        "sample_size": int(model.sample_size),
        "trees": int(model.trees),
        "contamination": model.contamination,
        "seed": model.seed,
        "threshold": model.threshold,
        "notes": model.notes,
    }
    text = spark.createDataFrame([(json.dumps(meta),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> ForestModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    scaler = Scaler.from_frame(spark.read.parquet(f"{path}/scaler"))
    if list(scaler.columns) != meta.pop("columns"):
        raise ValueError(f"feature order of {path}/scaler and {path}/meta differ")
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"], ignore_index=True)
    return ForestModel(scaler=scaler, nodes=nodes, **meta)


def feature_array(df: DataFrame, model: ForestModel) -> DataFrame:
    """The ordered input vector of each row, absent features as 0."""
    return df.withColumn("features", X.feature_vector(df, model.columns))
