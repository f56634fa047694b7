"""Quality classification by hierarchical empirical Bayes: document evidence, then path, host and global posteriors.

1. A document classifier: a logistic model over binned measures of the whole text, fitted on a bounded sample of labelled
   rows. Its log-odds minus those of the training prior are the document's own evidence.
2. Grouped sums of the classifier's probabilities over all documents give every host, and every path of a host, a beta
   posterior. A path is shrunk towards its host and a host towards the global rate; how strongly follows from the data, by the
   method of moments on the spread between sites, so sparse sites stay near their parents.
3. A document's posterior is its evidence on top of its path's rate, which leaves its own probability out.

The model (a few hundred numbers) and the prior strengths are all that reach the driver.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import bound_batches, give_back, release_stores, text_bytes
from linewatch.session import materialise

SAMPLE = 20_000  # labelled rows the document classifier is fitted on at most
BINS = 8
THRESHOLD = 0.5
BROADCAST_SITES = 50_000  # paths; more are joined by a shuffle
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"!\"#$%&*+/<=>@[\\]^_`{|}~"
_ENDS = b".!?"
MEASURES = (
    "upper_share", "symbol_share", "digit_share", "repeat_share", "distinct_share", "word_length", "line_words",
    "repeated_lines", "end_share", "letter_share", "log_words",
)


def measures(text: bytes) -> list[float]:
    """Shape of a whole text: shares of bytes and words, repeats, and lengths; zeros for an empty text."""
    words = text.split()
    if not words:
        return [0.0] * len(MEASURES)
    size = sum(map(len, words))
    letters = len(text) - len(text.translate(None, _LETTERS))
    upper = len(text) - len(text.translate(None, _UPPER))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    digits = len(text) - len(text.translate(None, _DIGITS))
    ends = len(text) - len(text.translate(None, _ENDS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    # Distinct words among runs of 200, so that the measure does not depend on length.
    parts = [words[i : i + 200] for i in range(0, len(words), 200)]
    distinct = sum(len(set(p)) for p in parts) / len(words)
    repeats = sum(map(operator.eq, words, words[1:])) / len(words)
    return [
        upper / max(letters, 1), symbols / size, digits / size, repeats, distinct, size / len(words), len(words) / len(lines),
        1 - len(set(lines)) / len(lines), ends / len(words), letters / size, math.log(len(words)),
    ]


@dataclass
class Model:
    """Cut points per measure, weights per bin, and the log-odds of the training prior."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        columns = [np.ones((len(x), 1))]
        for k, cut in enumerate(self.cuts):
            columns.append(np.eye(len(cut) + 1)[np.searchsorted(cut, x[:, k], side="right")])
        return np.hstack(columns)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that a document adds to its prior."""
        return self.design(x) @ self.weights - self.prior if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, ridge: float = 1.0, rounds: int = 25) -> Model:
    """Ridge logistic regression on one-hot bins by Newton steps; one class only, or no rows, gives no evidence.

    Cut points are quantiles of either class, so that a rare class has bins of its own.
    """
    rate = (y.sum() + 1) / (len(y) + 2)
    prior = math.log(rate / (1 - rate))
    steps = np.linspace(0, 1, bins + 1)[1:-1]
    cuts = []
    for k in range(len(MEASURES)):
        own = [np.quantile(x[y == c, k], steps) for c in (0, 1) if (y == c).any()]
        cuts.append(np.unique(np.concatenate(own)) if own else np.array([]))
    model = Model(cuts, np.zeros(1 + sum(len(c) + 1 for c in cuts)), prior)
    model.weights[0] = prior
    if len(set(y.tolist())) < 2:
        return model
    a = model.design(x)
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    w = model.weights
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of id, label and text with the text's measures in its place; what other operators left in the worker goes first."""
    release_stores()
    for batch in batches:
        rows = [measures(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["i", "y", "x"])
        give_back()


def labelled_measures(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Measures and labels of at most ``sample`` labelled documents, those whose ids hash lowest."""
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("_y"))
        .dropna()
        .groupBy("_id")
        .agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_t"))
    rows = (
        texts.join(F.broadcast(chosen), "_id")  # at most ``sample`` rows of two numbers
        .select("_id", "_y", "_t")
        .mapInArrow(measured, "i long, y int, x array<double>")
        .orderBy("i", "x")
        .limit(sample)
        .toPandas()
    )
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(MEASURES))
    return x, rows["y"].to_numpy(float)


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    held = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(held / (1 - held))


def _strength(sites: DataFrame, parent: str) -> float:
    """Pseudo-count of a beta prior from the spread of site rates around their parents, by moments.

    The rates' variance is what sampling gives, p(1-p)/n, plus the true spread between sites.
    """
    rate, p = F.col("_sum") / F.col("_n"), F.col(parent)
    row = sites.agg(
        F.sum(F.col("_n") * (rate - p) ** 2).alias("seen"), F.sum(p * (1 - p)).alias("noise"), F.sum(F.col("_n") * p * (1 - p)).alias("full")
    ).first()
    seen, noise, full = (float(v or 0.0) for v in row)
    between = seen - noise
    return min(max(full / between - 1, 1.0), 1e6) if between > 0 and full > 0 else 1e6


def posteriors(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_cols: Sequence[str] = ("lang",),
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> DataFrame:
    """``docs`` as the struct ``_doc`` with ``evidence``, ``host_rate``, ``path_rate`` and ``score`` (the posterior, 0 to 1).

    One row per input row. Null texts count as empty; a null host or path is a site like another. Without labels, or with one
    class only, documents have no evidence and all scores equal the prior. Extra columns stay inside ``_doc``.
    """
    bound_batches(docs.sparkSession)
    model = fit(*labelled_measures(docs, labels, id_col, text_col, label_col, sample))

    def evidence(texts: pa.Array) -> pa.Array:
        release_stores()
        found = np.array([measures(t) for t in texts.to_pylist()], float).reshape(-1, len(MEASURES))
        give_back()
        return pa.array(model.evidence(found))

    rows = docs.select(
        F.struct("*").alias("_doc"),
        F.to_json(F.struct(F.col(host_col).alias("h"))).alias("_host"),
        F.to_json(F.struct(F.col(host_col).alias("h"), *[F.col(c) for c in path_cols])).alias("_path"),
        F.arrow_udf(evidence, "double")(text_bytes(text_col)).alias("evidence"),
    ).withColumn("_p", _logistic(F.col("evidence") + F.lit(model.prior)))
    paths = materialise(rows.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("_sum")))
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"))
    whole = hosts.agg(F.sum("_n"), F.sum("_sum")).first()
    rate = float(whole[1] or 0.0) / float(whole[0] or 1)
    hosts = hosts.withColumn("_rate", F.lit(rate))
    over = _strength(hosts, "_rate")
    hosts = hosts.select("_host", ((F.col("_sum") + over * rate) / (F.col("_n") + over)).alias("host_rate"))
    sites = paths.join(hosts, "_host")
    under = _strength(sites, "host_rate")
    sites = materialise(sites.drop("_host"))
    small = sites.count() <= BROADCAST_SITES
    joined = rows.drop("_host").join(F.broadcast(sites) if small else sites, "_path")
    own = (F.col("_sum") - F.col("_p") + under * F.col("host_rate")) / (F.col("_n") - 1 + under)
    return joined.select(
        "_doc", "evidence", "host_rate", own.alias("path_rate"), _logistic(F.col("evidence") + _logit(own)).alias("score")
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` whose posterior is at least ``threshold``, with all their columns."""
    return posteriors(docs, labels, **options).filter(F.col("score") >= threshold).select("_doc.*")
