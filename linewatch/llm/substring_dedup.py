"""Removal of repeated passages: Rabin-Karp hashes of every window of consecutive words, counted across documents.

A word goes if a window over it also starts in a document with a smaller id. Every window of a text is hashed with a rolling
polynomial. So that unique windows need no row each, windows are grouped by an anchor found inside them: the smallest hash of
a short word run. Equal windows have equal anchors at equal offsets, and the neighbouring windows with one anchor form a
segment, about one per twenty words, whose key (anchor, rolling hash of all its windows) is what Spark counts first.

1. The smallest id per segment key. A later document with the same segment loses all its windows.
2. Only where an anchor stands in different segments can windows agree without their segments agreeing. There, and only in the
   first document of each segment (the others hold the same windows), windows are counted one by one by (anchor, hash).
3. What each document loses is joined to its text, and the windows merge into maximal intervals.

Counting uses map-side combine; the joins that return results to documents need no rows of a key together, so hot passages
split over tasks. Decisions are keyed by document id and hash, so rows sharing an id get equal decisions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import arrow_map, mix64, text_bytes, word_hashes, written

WINDOW = 50
ANCHOR = 8
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _prefix(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.r_[np.zeros(1, np.uint64), np.cumsum(values * _powers(_INVERSE, len(values)), dtype=np.uint64)]


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes (modulo 2**64) of the value runs ``[start, end)``, scrambled."""
    prefix = _prefix(values)
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * _powers(_BASE, len(values) + 1)[start])


class Segments:
    """Windows of one text and the segments they form; ``None`` attributes do not exist: short texts have no segment."""

    def __init__(self, words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR):
        n = len(words) - window + 1
        self.window = window
        if n <= 0:
            none = np.array([], np.uint64)
            self.first, self.last = np.array([], np.int64), np.array([], np.int64)
            self.anchor, self.key, self.windows = none, none, none
            return
        values = word_hashes(words)
        at = np.arange(len(words) - anchor + 1)
        runs = spans_hash(values, at, at + anchor)
        wide = window - anchor + 1
        chosen = np.empty(n, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(runs, wide)
        for begin in range(0, n, 1 << 14):
            chosen[begin : begin + (1 << 14)] = view[begin : begin + (1 << 14)].argmin(axis=1)
        chosen += np.arange(n)
        starts = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        self.first, self.last = starts, np.r_[starts[1:], n] - 1  # windows of each segment
        self.anchor = runs[chosen[starts]]
        self.windows = spans_hash(values, np.arange(n), np.arange(n) + window)
        whole = spans_hash(values, self.first, self.last + window)
        shape = (self.last - self.first).astype(np.uint64) << np.uint64(32) | (chosen[starts] - starts).astype(np.uint64)
        with np.errstate(over="ignore"):
            self.key = mix64(whole + mix64(shape + np.uint64(1)))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_text"))


def _signed(values) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))


def segment_rows(source: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(_id, _g, _key)``: the distinct segments of every document."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, anchors, keys = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Segments(text.split(), window, anchor)
                if len(found.key):
                    _, once = np.unique(found.key, return_index=True)
                    ids.append(np.full(len(once), doc, np.int64))
                    anchors.append(found.anchor[once])
                    keys.append(found.key[once])
            if not ids:
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ids)), _signed(np.concatenate(anchors)), _signed(np.concatenate(keys))], ["_id", "_g", "_key"]
            )

        return each

    return arrow_map(source.filter("_id is not null"), make, "_id long, _g long, _key long")


def window_rows(source: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(_id, _g, _h)``: the distinct windows of the segments listed in ``_check`` (packed segment keys)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, anchors, hashes = [], [], []
            for doc, text, check in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = Segments(text.split(), window, anchor)
                for k in np.flatnonzero(np.isin(found.key, np.array(check, np.int64).view(np.uint64))).tolist():
                    part = np.unique(found.windows[found.first[k] : found.last[k] + 1])
                    ids.append(np.full(len(part), doc, np.int64))
                    anchors.append(np.full(len(part), found.anchor[k], np.uint64))
                    hashes.append(part)
            if not ids:
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ids)), _signed(np.concatenate(anchors)), _signed(np.concatenate(hashes))], ["_id", "_g", "_h"]
            )

        return each

    return arrow_map(source, make, "_id long, _g long, _h long")


def removed_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(_id, _segments, _windows)``: per document that loses anything, the keys of whole segments and hashes of windows."""
    source = _source(docs, id_col, text_col)
    segments = written(segment_rows(source, window, anchor), "segments")
    firsts = segments.groupBy("_g", "_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    # What one anchor has: several segments, or one segment in several documents. All other segments are unique.
    repeated = firsts.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_first").alias("_a"), F.max("_last").alias("_b")).filter("_a < _b")
    known = written(firsts.join(repeated.select("_g", "_n"), "_g"), "repeated")
    marked = (
        segments.join(known.withColumnsRenamed({"_g": "_kg", "_key": "_kk"}), (F.col("_g") == F.col("_kg")) & (F.col("_key") == F.col("_kk")))
        .select("_id", "_key", (F.col("_first") < F.col("_id")).alias("_gone"), "_n")
        .filter("_gone or _n > 1")
    )
    # A document's segments are bounded by its own text.
    lists = written(
        marked.groupBy("_id").agg(
            F.collect_list(F.when(F.col("_gone"), F.col("_key"))).alias("_segments"),
            F.collect_list(F.when(~F.col("_gone"), F.col("_key"))).alias("_check"),
        ),
        "lists",
    )
    asked = source.join(lists.filter(F.size("_check") > 0).select("_id", "_check"), "_id").select("_id", "_text", "_check")
    windows = written(window_rows(asked, window, anchor), "windows")
    first = windows.groupBy("_g", "_h").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first < _last")
    gone = (
        windows.join(first.withColumnsRenamed({"_g": "_kg", "_h": "_kh"}), (F.col("_g") == F.col("_kg")) & (F.col("_h") == F.col("_kh")))
        .filter("_first < _id")
        .groupBy("_id")
        .agg(F.collect_list("_h").alias("_windows"))
    )
    return lists.select("_id", "_segments").filter(F.size("_segments") > 0).join(gone, "_id", "full")


def kept_mask(words: list[bytes], segments: list[int] | None, windows: list[int] | None, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """True for the words that stay."""
    edge = np.zeros(len(words) + 1, np.int64)
    if segments or windows:
        found = Segments(words, window, anchor)
        whole = np.isin(found.key, np.array(segments or [], np.int64).view(np.uint64))
        np.add.at(edge, found.first[whole], 1)
        np.add.at(edge, found.last[whole] + window, -1)
        if windows:
            hit = np.flatnonzero(np.isin(found.windows, np.array(windows, np.int64).view(np.uint64)))
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
    return np.cumsum(edge)[:-1] == 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept`` (text) and ``removed`` (word intervals).

    Words are ``[^\\x20\\x09-\\x0D]+``; null has none. Windows are judged on the input, not on what is left; a repeat inside one
    document, or between rows of one id, removes nothing. Rows without an id neither remove nor lose words. ``kept`` joins the
    words that stay by one blank. Other columns are not read; an empty table gives an empty result.
    """
    source = _source(docs, id_col, text_col)
    lost = removed_parts(docs, id_col, text_col, window, anchor)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, removed, digests, texts, spans = [], [], [], [], []
            for text, segments, windows in zip(*(batch.column(i).to_pylist() for i in range(1, 4))):
                words = text.split()
                kept = words
                total.append(len(words))
                cuts: list[dict[str, int]] = []
                if segments or windows:
                    stays = kept_mask(words, segments, windows, window, anchor)
                    kept = [w for w, s in zip(words, stays.tolist()) if s]
                    turns = np.flatnonzero(np.diff(np.r_[True, stays, True].astype(np.int8)))
                    cuts = [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]
                removed.append(len(words) - len(kept))
                line = b" ".join(kept)
                digests.append(hashlib.sha256(line).hexdigest())
                texts.append(line.decode("utf-8", "replace"))
                spans.append(cuts)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(texts), pa.array(spans, kind)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "removed"],
            )

        return each

    joined = source.join(lost.withColumnRenamed("_id", "_key"), F.col("_id") == F.col("_key"), "left").select("_id", "_text", "_segments", "_windows")
    return arrow_map(
        joined, make, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, removed array<struct<start: long, end: long>>"
    )
