"""Detection quality against labels or known incident intervals.

An incident touches a window of its target when ``window_start < completed_at`` and ``window_end > started_at``. The
interval join is done as an equality join on dyadic spans: the touched windows of an incident are cut into the fewest spans of
2, 4, 8, ... aligned windows, at most two of each length, and a window asks for the spans that hold it, one per length in use. So
an incident of a year has a few dozen rows, whatever the window length. Windows are aggregated per (target, window), and then per
span, so a busy target never multiplies detections by incidents. Incidents that are still open have no interval and match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.functions.exprs import epoch_seconds, window_id
from linewatch.functions.quantiles import exact_quantiles
from linewatch.schemas import PAIR_KEYS
from linewatch.session import materialise

ANY = "all"


def evaluate(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Confusion counts with the accuracy beside each; empty without labels."""
    cells = (
        df.filter(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull())
        .groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    everything = Window.partitionBy()  # one row per label pair
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).over(everything)
    return cells.withColumn("accuracy", right / F.sum("n").over(everything))


# -- incidents and windows -------------------------------------------------------------------------------------------


def incident_spans(incidents: DataFrame, window_seconds: float) -> DataFrame:
    """One row per closed incident with the numbers of the first and last window it touches."""
    closed = incidents.filter(
        F.col("started_at").isNotNull() & (F.col("completed_at") > F.col("started_at"))
    )
    first = window_id(epoch_seconds(F.col("started_at")), window_seconds)
    # a window starting exactly at the end is not touched
    last = (F.ceil(epoch_seconds(F.col("completed_at")) / F.lit(float(window_seconds))) - 1).cast("bigint")
    return closed.select(
        "attack_id",
        "attack_type",
        F.col("target_ip").alias("dst"),
        "started_at",
        "completed_at",
        first.alias("first_window"),
        last.alias("last_window"),
    )


def incident_windows(incidents: DataFrame, window_seconds: float) -> DataFrame:
    """One row per incident and touched window number, for incidents of few windows."""
    spans = incident_spans(incidents, window_seconds)
    return spans.withColumn("time_window", F.explode(F.sequence("first_window", "last_window"))).drop("first_window", "last_window")


def dyadic_cover(intervals: DataFrame, first: str, last: str) -> DataFrame:
    """The intervals [``first``, ``last``] of integers as spans (``_level``, ``_node``): the numbers n with n >> level = node.

    The spans of an interval are disjoint and the fewest there are: at each level at most the lowest and the highest span that
    fit, where the span above does not fit.
    """
    level = F.explode(F.expr(f"sequence(0, length(bin({last} - {first} + 1)))"))
    low = F.expr(f"shiftright({first} + shiftleft(1L, _level) - 1, _level)")
    high = F.expr(f"shiftright({last} + 1, _level) - 1")
    fits = intervals.withColumn("_level", level).withColumns({"_low": low, "_high": high}).filter("_low <= _high")
    nodes = F.filter(F.array(F.when(F.col("_low") % 2 != 0, F.col("_low")), F.when(F.col("_high") % 2 == 0, F.col("_high"))), lambda n: n.isNotNull())
    return fits.withColumn("_node", F.explode(nodes)).drop("_low", "_high")


def levels_of(covers: DataFrame) -> list[int]:
    return sorted(r["_level"] for r in covers.select("_level").distinct().collect())  # 64 at most


def in_spans(rows: DataFrame, at: str, levels: list[int]) -> DataFrame:
    """Each row once per level, with the span (``_level``, ``_node``) that holds its number."""
    spans = F.array(*[F.struct(F.lit(k).alias("_level"), F.shiftright(F.col(at), k).alias("_node")) for k in levels])
    none = F.array().cast("array<struct<_level:int,_node:bigint>>")
    return rows.select("*", F.inline(spans if levels else none))


def match_incidents(detections: DataFrame, incidents: DataFrame, window_seconds: float) -> DataFrame:
    """Detections inside a known incident on their target, one row per detection and incident."""
    covers = materialise(dyadic_cover(incident_spans(incidents, window_seconds), "first_window", "last_window"))
    asking = in_spans(detections.select(*PAIR_KEYS, "anomaly_score", "detected_at"), "time_window", levels_of(covers))
    return covers.join(asking, ["dst", "_level", "_node"]).select(
        "attack_id", "attack_type", "started_at", "completed_at", *PAIR_KEYS, "anomaly_score", "detected_at"
    )


def _per_target_window(detections: DataFrame) -> DataFrame:
    return detections.groupBy("dst", "time_window").agg(
        F.count(F.lit(1)).alias("detections"),
        F.sum("anomaly_score").alias("score_sum"),
        F.min("detected_at").alias("first_at"),
    )


def incident_hits(detections: DataFrame, incidents: DataFrame, window_seconds: float) -> DataFrame:
    """Per closed incident: touched windows, those with a detection, detections in them, score sum and first detection."""
    covers = materialise(dyadic_cover(incident_spans(incidents, window_seconds), "first_window", "last_window"))
    per_span = in_spans(_per_target_window(detections), "time_window", levels_of(covers)).groupBy("dst", "_level", "_node").agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("detections").alias("detections"),
        F.sum("score_sum").alias("score_sum"),
        F.min("first_at").alias("first_at"),
    )
    return (
        covers.join(per_span, ["dst", "_level", "_node"], "left")
        .groupBy("attack_id", "attack_type", "started_at")
        .agg(
            F.sum(F.expr("shiftleft(1L, _level)")).alias("attack_windows"),
            F.coalesce(F.sum("windows"), F.lit(0)).alias("detected_windows"),
            F.coalesce(F.sum("detections"), F.lit(0)).alias("true_positives"),
            F.sum("score_sum").alias("score_sum"),
            F.min("first_at").alias("first_detected_at"),
        )
    )


# -- before and after ------------------------------------------------------------------------------------------------


def counts_before(points: DataFrame, bounds: DataFrame, bucket_seconds: float) -> DataFrame:
    """For each bound (``dst``, ``at``, any other columns) the number of points of ``dst`` earlier than ``at``.

    Counts whole time buckets by a running sum over bucket totals and sorts rows inside one bucket only, so a target
    with most of the points is spread over its buckets. Nothing is joined point by bound.
    """
    others = [c for c in bounds.columns if c not in ("dst", "at")]

    def bucket(at: Column) -> Column:
        return window_id(epoch_seconds(at), bucket_seconds)

    stamped = (
        points.filter(F.col("at").isNotNull())
        .groupBy("dst", "at")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_bucket", bucket(F.col("at")))
    )
    marks = bounds.withColumns({"_c": F.lit(0).cast("bigint"), "_bucket": bucket(F.col("at")), "_mark": F.lit(1)})
    rows = marks.unionByName(stamped.withColumn("_mark", F.lit(0)), allowMissingColumns=True)
    # range frame up to just before `at`: equal stamps are not earlier
    inside = F.sum("_c").over(
        Window.partitionBy("dst", "_bucket")
        .orderBy(F.unix_micros(F.col("at")))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    local = rows.withColumn("_inside", inside).filter("_mark = 1").drop("_c", "_mark")
    totals = rows.groupBy("dst", "_bucket").agg(F.sum("_c").alias("_total"))
    running = F.sum("_total").over(
        Window.partitionBy("dst").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = totals.select("dst", "_bucket", running.alias("_earlier"))
    return local.join(earlier, ["dst", "_bucket"]).select(
        "dst",
        "at",
        *others,
        (F.coalesce("_inside", F.lit(0)) + F.coalesce("_earlier", F.lit(0))).alias("points_before"),
    )


def before_after(
    detections: DataFrame,
    incidents: DataFrame,
    baseline_seconds: float = 30,
    observe_seconds: float = 360,
    bucket_seconds: float = 600,
) -> DataFrame:
    """Per incident: detections of its target in the baseline period before the start and in the period observed from
    the start on, their total and difference to the baseline, and whether anything new was detected."""

    def shifted(seconds: float) -> Column:
        return F.timestamp_micros(F.unix_micros("started_at") + F.lit(int(round(seconds * 1e6))))

    started = incidents.filter("started_at is not null")
    edges = started.select(
        "attack_id",
        "attack_type",
        F.col("target_ip").alias("dst"),
        F.inline(
            F.array(
                F.struct(F.lit("from").alias("edge"), shifted(-baseline_seconds).alias("at")),
                F.struct(F.lit("start").alias("edge"), shifted(0).alias("at")),
                F.struct(F.lit("to").alias("edge"), shifted(observe_seconds).alias("at")),
            )
        ),
    )
    points = detections.select("dst", F.col("detected_at").alias("at"))
    counted = counts_before(points, edges, bucket_seconds)

    def at_edge(name: str) -> Column:
        return F.max(F.when(F.col("edge") == name, F.col("points_before")))

    return (
        counted.groupBy("attack_id", "attack_type")
        .agg(
            (at_edge("start") - at_edge("from")).alias("baseline_detections"),
            (at_edge("to") - at_edge("from")).alias("total_detections"),
        )
        .withColumn("new_detections", F.col("total_detections") - F.col("baseline_detections"))
        .withColumn("detected", F.when(F.col("new_detections") > 0, 1).otherwise(0))
    )


# -- quality per incident and type -----------------------------------------------------------------------------------


def incident_quality(
    detections: DataFrame, incidents: DataFrame, window_seconds: float, baseline_seconds: float = 30
) -> DataFrame:
    """Per closed incident: true positives, baseline false positives, detection rate and precision.

    The rate is the share of touched windows with a detection: several sources of one window count once.
    """
    hits = incident_hits(detections, incidents, window_seconds)
    closed = incidents.filter(F.col("completed_at").isNotNull())
    before = before_after(detections, closed, baseline_seconds, 0).select(
        "attack_id", F.col("baseline_detections").alias("false_positives")
    )
    tp, fp = F.col("true_positives"), F.col("false_positives")
    return hits.join(before, "attack_id").select(
        "attack_id",
        "attack_type",
        "attack_windows",
        "true_positives",
        "false_positives",
        (F.col("detected_windows") / F.col("attack_windows")).alias("detection_rate"),
        F.try_divide(tp, tp + fp).alias("precision"),
    )


def incident_scores(detections: DataFrame, incidents: DataFrame, window_seconds: float) -> DataFrame:
    """Mean score of the detections during each incident; NULL where there is none."""
    hits = incident_hits(detections, incidents, window_seconds)
    return hits.select(
        "attack_id",
        "attack_type",
        "true_positives",
        F.try_divide("score_sum", "true_positives").alias("mean_anomaly_score"),
    )


def type_scores(detections: DataFrame, incidents: DataFrame, window_seconds: float) -> DataFrame:
    """Mean score over all matches of an incident type."""
    hits = incident_hits(detections, incidents, window_seconds)
    return hits.groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("incidents"),
        F.sum("true_positives").alias("true_positives"),
        F.try_divide(F.sum("score_sum"), F.sum("true_positives")).alias("mean_anomaly_score"),
    )


def detection_latency(detections: DataFrame, incidents: DataFrame, window_seconds: float) -> DataFrame:
    """Seconds from the start of an incident to its first detection; missed incidents are left out.

    A detection is made after its window is complete, so every matched one lies after the start.
    """
    hits = incident_hits(detections, incidents, window_seconds)
    seconds = F.timestamp_diff("MICROSECOND", "started_at", "first_detected_at") / F.lit(1e6)
    return hits.filter("first_detected_at is not null").select(
        "attack_id", "attack_type", seconds.alias("latency_seconds")
    )


def latency_stats(latencies: DataFrame) -> DataFrame:
    """Mean, median, 95th and 99th percentile."""
    known = materialise(latencies.select("latency_seconds"))  # one number per incident: not worked out again per figure
    mean = known.agg(F.count("latency_seconds").alias("incidents"), F.avg("latency_seconds").alias("mean_latency"))
    marks = exact_quantiles(known, "latency_seconds", [0.5, 0.95, 0.99])
    named = {"median_latency": "p50", "p95_latency": "p95", "p99_latency": "p99"}
    return mean.withColumns({name: marks.select(p).scalar() for name, p in named.items()})


def confusion_by_type(scored: DataFrame, incidents: DataFrame, window_seconds: float) -> DataFrame:
    """TP, FP, FN and TN over all pair-windows, for each incident type and for all types together.

    A pair-window is positive for a type when an incident of it touches the window on the same target.
    """
    covers = dyadic_cover(incident_spans(incidents, window_seconds), "first_window", "last_window")
    kinds = F.explode(F.array("attack_type", F.lit(ANY))).alias("attack_type")
    covers = materialise(covers.select("dst", "_level", "_node", kinds).distinct())
    windows = scored.groupBy("dst", "time_window").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("anomaly") == 1).alias("flagged")
    )
    # Spans of different incidents may hold the same window: it counts once per type.
    touched = in_spans(windows, "time_window", levels_of(covers)).join(covers, ["dst", "_level", "_node"])
    touched = touched.select("dst", "time_window", "n", "flagged", "attack_type").distinct()
    counts = touched.groupBy("attack_type").agg(F.sum("flagged").alias("tp"), (F.sum("n") - F.sum("flagged")).alias("fn"))
    positive = (
        covers.select("attack_type")
        .distinct()
        .join(counts, "attack_type", "left")
        .select("attack_type", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fn", F.lit(0)).alias("fn"))
    )
    sums = windows.agg(F.coalesce(F.sum("flagged"), F.lit(0)).alias("_flagged"), F.coalesce(F.sum("n"), F.lit(0)).alias("_total"))
    return positive.join(F.broadcast(sums)).select(  # one row
        "attack_type",
        "tp",
        (F.col("_flagged") - F.col("tp")).alias("fp"),
        "fn",
        (F.col("_total") - F.col("_flagged") - F.col("fn")).alias("tn"),
    )


def rates(confusion: DataFrame) -> DataFrame:
    """TPR, FPR, precision, recall and F1 from confusion counts; NULL where a denominator is zero."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion.withColumns(
        {
            "tpr": F.try_divide(tp, tp + fn),
            "fpr": F.try_divide(fp, fp + tn),
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        }
    )


def timeline(detections: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Detections per time bucket."""
    return (
        detections.groupBy(F.window("detected_at", bucket).alias("w"))
        .agg(F.count(F.lit(1)).alias("detections"))
        .select(F.col("w.start").alias("bucket_start"), "detections")
    )


def evaluate_incidents(
    scored: DataFrame,
    detections: DataFrame,
    incidents: DataFrame,
    window_seconds: float,
    baseline_seconds: float = 30,
) -> dict[str, DataFrame]:
    """All reports of one evaluation."""
    latencies = detection_latency(detections, incidents, window_seconds)
    confusion = confusion_by_type(scored, incidents, window_seconds)
    return {
        "before_after": before_after(detections, incidents, baseline_seconds),
        "quality": incident_quality(detections, incidents, window_seconds, baseline_seconds),
        "scores": incident_scores(detections, incidents, window_seconds),
        "latency": latencies,
        "latency_stats": latency_stats(latencies),
        "confusion": confusion,
        "rates": rates(confusion),
        "timeline": timeline(detections),
    }
