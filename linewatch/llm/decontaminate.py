"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items, run once over each text.

The automaton works on words, not characters: benchmark words are numbered, a text becomes a sequence of numbers (0 for any
word that no item has), and one pass reports every window with the word where it ends. Word places map back to character
offsets of the original text for the documents that are hit.

A benchmark is a test set, but its size is checked: its windows are taken in blocks of at most ``block_bytes``, each with an
automaton of its own, and a text passes the automata of all blocks in turn.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import alnum_words, arrow_map, bound_batches, give_back, release_stores, text_bytes, worker_store

WINDOW = 10
BLOCK_BYTES = 16_000_000  # of benchmark text per automaton
STORE = "benchmark"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """``(item id as text, item text)`` in lists of bounded size; one list is on the driver at a time."""
    held: list[tuple[str | None, bytes]] = []
    size = 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), text_bytes(text_col)).toLocalIterator():
        text = bytes(text)
        if held and size + len(text) > block_bytes:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text)
    if held:
        yield held


class Matcher:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            words = alnum_words(text)
            codes = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            width = min(window, len(codes))
            for at in range(len(codes) - width + 1 if width else 0):
                owners.setdefault(tuple(codes[at : at + width]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for codes, ids in owners.items():
            self.automaton.add_word(codes, (len(codes), sorted(i for i in ids if i is not None)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals ``[start, end)`` of all windows in the text, merged, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return spans, items
        get = self.number.get
        for end, (width, ids) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            spans.append((end + 1 - width, end + 1))
            items.update(ids)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def char_spans(text: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word intervals as character offsets of the original text."""
    if not spans:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
    return [{"start": int(starts[places[a][0]]) - 1, "end": int(starts[places[b - 1][1] - 1])} for a, b in spans]


def _matcher(key: str, items, window: int) -> Matcher:
    store = worker_store(STORE)
    if key not in store:
        store.clear()
        store[key] = Matcher(items, window)
    return store[key]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``spans``.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window, an item without words none.
    ``n_hit`` counts the words of the text inside any occurrence of a window, ``n_items`` the items whose windows occur (ids
    as text; an item without an id hits but is not counted), ``spans`` the hit stretches as ``(start, end)`` characters of the
    original text. Null texts have no words. Repeated items count once, repeated rows stay. An empty benchmark hits nothing.
    Other columns are not read. Nothing is shuffled.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("_text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    sent = [spark.sparkContext.broadcast((uuid.uuid4().hex, b)) for b in blocks(benchmark, item_col, item_text_col, block_bytes)]
    empty = [spark.sparkContext.broadcast((uuid.uuid4().hex, []))]

    def search(shared, first: bool, last: bool):
        def make():
            matcher = _matcher(*shared.value, window)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts = batch.column(1).to_pylist()
                words = [alnum_words(t) for t in texts]
                found = [matcher.find(w) for w in words]
                if not first:
                    old = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                    found = [
                        (merged(s + [tuple(x) for x in np.frombuffer(p, np.int64).reshape(-1, 2).tolist()]), i | set(q))
                        for (s, i), (p, q) in zip(found, old)
                    ]
                if not last:
                    packed = [np.array(s, np.int64).tobytes() for s, _ in found]
                    return pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array([sorted(i) for _, i in found], pa.list_(pa.string()))],
                        ["doc_id", "_text", "_hits", "_items"],
                    )
                hit = [sum(b - a for a, b in s) for s, _ in found]
                spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array(hit, pa.int64()),
                        pa.array([len(i) for _, i in found], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, i in found]),
                        pa.array([h > 0 for h in hit]),
                        pa.array([char_spans(t, s) for t, (s, _) in zip(texts, found)], spans),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
                )

            return each

        return make

    between = f"doc_id {kind}, _text binary, _hits binary, _items array<string>"
    final = (
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "spans array<struct<start: long, end: long>>"
    )
    sent = sent or empty
    for k, shared in enumerate(sent):
        last = k == len(sent) - 1
        frame = arrow_map(frame, search(shared, k == 0, last), final if last else between, STORE)
    return frame


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, with all their columns; nothing is shuffled."""
    spark = docs.sparkSession
    bound_batches(spark)
    kept = docs
    for block in blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        kept = kept.filter(F.arrow_udf(_cleanness(shared, window), "boolean")(text_bytes(text_col)))
    return kept


def _cleanness(shared, window: int):
    def clean(texts: pa.Array) -> pa.Array:
        release_stores(STORE)
        matcher = _matcher(*shared.value, window)
        found = pa.array([not matcher.find(alnum_words(t))[0] for t in texts.to_pylist()], pa.bool_())
        give_back()
        return found

    return clean
