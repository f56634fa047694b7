"""Trigram language model in Elias-Fano tries, trained and queried on Spark.

Tokens are the lower-cased words of a text and one end. The way through the data:

1. Texts are split where they are read; a batch of documents becomes local word numbers and a list of its distinct words.
2. Words are merged by hash parts and numbered by falling count. So the count of a word follows from its number and a table with
   one entry per distinct count (fewer than the root of twice the tokens), which is broadcast.
3. Each batch sends its distinct trigrams, with their counts in training texts, to shards by the middle word. A middle word with
   more than ``HOT_TOKENS`` tokens is split over several shards by the last word; sums of its contexts are then exchanged.
4. A shard merges counts, builds its trie, maps it from a file, looks up every trigram it was sent and answers with log
   probabilities; batches add them up per document.

A shard's trie has the levels: middle words; their successors; the words before them; and the successors of the pairs. Every level is
an Elias-Fano sequence of sorted numbers with monotone pointers to the next. Trigrams store their last word as its rank among the
successors of the middle word, that is relative to the shorter context, so the ranks are small numbers. A lookup finds the last
word among the successors of the middle word by successor search, and then that rank among the successors of the pair.
Probabilities and back-off weights are quantised to ``CODES`` values each.

Probabilities are interpolated with absolute discounting: P(w | u v) = max(c(uvw) - D, 0) / c(uv.) + D t(uv.) / c(uv.) P(w | v), the
same for P(w | v), and P(w) = (c(w) + 1) / (N + V + 1), where t counts distinct successors. They sum to one over all known words, the
end and one unknown word.
"""

from __future__ import annotations

import json
import math
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.llm.common import bound_batches, give_back, mix64, release_stores, written

DISCOUNT = 0.75
CODES = 4096  # values of a quantised probability
SHARD_TOKENS = 1 << 19  # tokens of a shard on average
HOT_TOKENS = 1 << 21  # a middle word with more is split
ANSWER_STEP = 1 / 4096  # log probabilities travel in sixteen bits, in these steps
FOLDS, HELD_OUT = 7, 2
MOST_COUNTS = 1 << 23  # distinct word counts; reached by 2**45 tokens at the earliest


def fold_of(id_col: str) -> Column:
    """True for the documents that are kept out of training: crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


# -- numbers as bytes --------------------------------------------------------------------------------------------------


def _runs(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is faster here than hashing."""
    ordered = np.sort(values)
    return ordered[_runs(ordered)]


def pack(values: np.ndarray) -> bytes:
    """An array of non-negative integers, or of floats, as compressed byte planes."""
    import zstandard

    if values.dtype.kind in "iu" and values.itemsize > 2:
        values = values.astype(np.uint32 if not len(values) or int(values.max()) < 1 << 32 else np.uint64)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return values.dtype.str.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    kind = np.dtype(data[:3].decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[3:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_words(words: pa.Array, ends: np.ndarray) -> list[bytes]:
    """Words up to each end as compressed bytes. None holds a line feed; the end of a text is the empty word."""
    import zstandard

    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), words.cast(pa.binary()))
    coder = zstandard.ZstdCompressor(level=1)
    return [coder.compress(x.as_buffer()) for x in pc.binary_join(lists, pa.scalar(b"\n", pa.binary()))]


def unpack_words(data: list[bytes]) -> pa.Array:
    """All words of some packed pieces, one after the other."""
    import zstandard

    coder = zstandard.ZstdDecompressor()
    whole = b"\n".join(coder.decompress(x) for x in data)
    return pc.split_pattern(pa.array([whole], pa.large_binary()), b"\n").flatten()


def word_parts(words: pa.Array, parts: int) -> np.ndarray:
    """A hash part for each word, from sums of its bytes by place."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if words.buffers()[2] else np.zeros(0, np.uint8)
    begins, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    at = np.arange(len(data), dtype=np.uint64) - np.repeat(begins, lengths).astype(np.uint64)
    mixed = np.r_[np.zeros(1, np.uint64), np.cumsum(mix64((at << np.uint64(8)) + data.astype(np.uint64) + np.uint64(1)))]
    return (mix64(mixed[begins + lengths] - mixed[begins]) % np.uint64(parts)).astype(np.int64)


# -- 1: batches --------------------------------------------------------------------------------------------------------


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(stream, lengths, words)``: numbers of the tokens of all texts, tokens per text with its end, and the distinct tokens."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = lists.flatten()
    filled = pc.not_equal(flat, "")
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[filled.to_numpy(zero_copy_only=False)]
    lengths = np.bincount(owner, minlength=len(texts)).astype(np.int64) + 1
    coded = flat.filter(filled).dictionary_encode()
    words = pa.concat_arrays([coded.dictionary.cast(pa.large_binary()), pa.array([b""], pa.large_binary())])
    stream = np.full(int(lengths.sum()), len(words) - 1, np.int64)
    inner = np.ones(len(stream), bool)
    inner[np.cumsum(lengths) - 1] = False
    stream[inner] = coded.indices.to_numpy(zero_copy_only=False)
    # Frequent words get small numbers, which pack better.
    order = np.argsort(-np.bincount(stream, minlength=len(words)), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return rank[stream], lengths, words.take(pa.array(order))


def token_batches(docs: DataFrame, id_col: str, text_col: str, held_out: Column, parts: int) -> DataFrame:
    """Rows of two kinds, written down: a batch of documents (``part`` is -1) and its distinct words of one hash part."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long"), F.coalesce(held_out, F.lit(False)), F.col(text_col).cast("string"))
    names = ["batch", "part", "ids", "held", "lengths", "numbers", "counts", "words"]

    def split(batches):
        release_stores()
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            name = (task << 32) + number
            number += 1
            stream, lengths, words = tokens_of(batch.column(2))
            held = batch.column(1).to_numpy(zero_copy_only=False)
            counts = np.bincount(stream[np.repeat(~held, lengths)], minlength=len(words))
            rows = [(name, -1, batch.column(0).to_pylist(), held.tolist(), lengths.tolist(), pack(stream), None, None)]
            owner = word_parts(words, parts)
            order = np.argsort(owner, kind="stable")
            begins = _runs(owner[order])
            ends = np.r_[begins[1:], len(order)]
            for b, e, packed in zip(begins, ends, pack_words(words.take(pa.array(order)), ends)):
                mine = order[b:e]
                rows.append((name, int(owner[mine[0]]), None, None, None, pack(np.diff(mine, prepend=0)), pack(counts[mine]), packed))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            give_back()

    schema = "batch long, part int, ids array<long>, held array<boolean>, lengths array<long>, numbers binary, counts binary, words binary"
    return written(source.mapInArrow(split, schema), "token-batches")


# -- 2: numbers of words -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Counts:
    """Word numbers begin at ``firsts[i]`` for count ``counts[i]``, counts falling. Number ``known`` stands for all unknown words."""

    counts: np.ndarray
    firsts: np.ndarray
    tokens: int  # of training texts
    known: int  # distinct training tokens
    texts: int  # training texts

    @property
    def unknown(self) -> int:
        return self.known

    @property
    def start(self) -> int:
        return self.known + 1

    def count_of(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts of words; 0 for the unknown word."""
        if not self.known:
            return np.zeros(len(numbers), np.int64)
        found = self.counts[np.searchsorted(self.firsts, numbers, "right") - 1]
        return np.where(numbers >= self.known, 0, found)

    def log_base(self, numbers: np.ndarray) -> np.ndarray:
        return np.log10((self.count_of(numbers) + 1) / (self.tokens + self.known + 1))


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows of a part: the place of every entry's word in the order (falling count, word), and those words' counts."""
    counts = [unpack(x).astype(np.int64) for x in table.column("counts").to_pylist()]
    coded = unpack_words(table.column("words").to_pylist()).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    total = np.bincount(index, np.concatenate(counts), len(coded.dictionary)).astype(np.int64)
    frame = pa.table({"c": total, "w": coded.dictionary})
    order = pc.sort_indices(frame, sort_keys=[("c", "descending"), ("w", "ascending")]).to_numpy()
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return place[index], total[order], np.array([len(c) for c in counts])


def word_numbers(batches: DataFrame) -> tuple[DataFrame, Counts]:
    """``(batch, numbers, words)``, written down: the corpus-wide number of every local word, and the counts by number."""
    spark = batches.sparkSession
    rows = batches.filter("part >= 0")

    def histogram(table: pa.Table) -> pa.Table:
        _, total, _ = _merged(table)
        counts, n = np.unique(total, return_counts=True)
        return pa.table({"part": pa.array(np.full(len(n), table.column("part")[0].as_py()), pa.int32()), "count": counts, "n": n.astype(np.int64)})

    heights = written(rows.select("part", "counts", "words").groupBy("part").applyInArrow(histogram, "part int, count long, n long"), "word-counts")
    steps = heights.filter("count > 0").groupBy("count").agg(F.sum("n").alias("n")).limit(MOST_COUNTS + 1).collect()
    if len(steps) > MOST_COUNTS:
        raise ValueError(f"more than {MOST_COUNTS} distinct word counts")
    steps.sort(key=lambda r: -r["count"])
    counts, n = (np.array([r[c] for r in steps], np.int64) for c in ("count", "n"))
    texts = batches.filter("part = -1").select(F.sum(F.size(F.filter("held", lambda x: ~x))).alias("n")).first()["n"] or 0
    vocabulary = Counts(counts, np.cumsum(n) - n, int(counts @ n) if len(n) else 0, int(n.sum()), int(texts))
    shared = spark.sparkContext.broadcast(vocabulary)

    before = Window.partitionBy("count").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heights.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "count", "n", "before")

    def number(table: pa.Table, offset: pa.Table) -> pa.Table:
        place, total, sizes = _merged(table)
        at = shared.value
        numbers = np.full(len(total), at.unknown, np.int64)
        begin = {c: b for c, b in zip(offset.column("count").to_pylist(), offset.column("before").to_pylist())}
        found, firsts, many = np.unique(-total, return_index=True, return_counts=True)
        for c, first, n in zip((-found).tolist(), firsts.tolist(), many.tolist()):
            if c:
                base = int(at.firsts[np.searchsorted(-at.counts, -c)])
                numbers[first : first + n] = base + begin[c] + np.arange(n)
        cuts = np.split(numbers[place], np.cumsum(sizes)[:-1])
        return pa.table({"batch": table.column("batch"), "numbers": table.column("numbers"), "words": pa.array([pack(c) for c in cuts], pa.binary())})

    named = rows.select("batch", "part", "numbers", "counts", "words").groupBy("part").cogroup(offsets.groupBy("part")).applyInArrow(number, "batch long, numbers binary, words binary")
    return written(named, "word-numbers"), vocabulary


# -- 3: trigrams of a batch --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Shards:
    """Where trigrams go: ``cold`` shards by middle word, and ``splits[i]`` shards, from ``begins[i]``, of hot middle word ``hot[i]``."""

    cold: int
    hot: np.ndarray
    splits: np.ndarray
    begins: np.ndarray

    @classmethod
    def planned(cls, at: Counts, tokens: int, shard_tokens: int, hot_tokens: int) -> Shards:
        above = int((at.counts > hot_tokens).sum())
        n = int(at.firsts[above]) if above < len(at.firsts) else at.known  # as many words have such a count
        hot, counts = np.arange(n), at.count_of(np.arange(n))
        if at.texts > hot_tokens:
            hot, counts = np.append(hot, at.start), np.append(counts, at.texts)
        splits = -(-counts // hot_tokens)
        cold = max(1, math.ceil(tokens / shard_tokens))
        return cls(cold, hot, splits, cold + np.cumsum(splits) - splits)

    def of(self, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
        shard = (mix64(middle.astype(np.uint64) + np.uint64(1)) % np.uint64(self.cold)).astype(np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, middle), len(self.hot) - 1)
            split = (mix64(last.astype(np.uint64) + np.uint64(7)) % self.splits[at].astype(np.uint64)).astype(np.int64)
            shard = np.where(self.hot[at] == middle, self.begins[at] + split, shard)
        return shard


    def asked(self, grams: Grams, at: Counts) -> tuple[np.ndarray, np.ndarray]:
        """Which trigrams of a batch shards are asked for, ordered by shard, and the shards. Nothing follows an unknown word."""
        asked = np.flatnonzero(grams.middle != at.unknown)
        shard = self.of(grams.middle[asked], grams.last[asked])
        order = np.argsort(shard, kind="stable")
        return asked[order], shard[order]


@dataclass
class Grams:
    """Distinct trigrams (``first``, ``middle``, ``last``) of a batch in a fixed order, and the trigram of each token."""

    stream: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    middle: np.ndarray
    last: np.ndarray
    of_token: np.ndarray
    trained: np.ndarray


def grams_of(row: dict, numbered: pa.Table, at: Counts) -> Grams:
    """The batch in corpus-wide numbers. Numbers of local words come in ``numbered``, in any order."""
    local, lengths = unpack(row["numbers"]).astype(np.int64), np.array(row["lengths"], np.int64)
    width = int(local.max(initial=0)) + 2
    names = np.empty(width, np.int64)
    for places, words in zip(numbered.column("numbers").to_pylist(), numbered.column("words").to_pylist()):
        names[np.cumsum(unpack(places).astype(np.int64))] = unpack(words)
    names[width - 1] = at.start
    begins = np.cumsum(lengths) - lengths
    middle = np.r_[0, local[:-1]]
    middle[begins] = width - 1
    first = np.r_[0, middle[:-1]]
    first[begins] = width - 1
    pairs = None if width**3 < 1 << 62 else _distinct(middle * width + first)
    pair = middle * width + first if pairs is None else np.searchsorted(pairs, middle * width + first)
    keys, of_token = np.unique(pair * width + local, return_inverse=True)
    pair, last = keys // width, keys % width
    pair = pair if pairs is None else pairs[pair]
    train = np.repeat(~np.array(row["held"], bool), lengths)
    trained = np.bincount(of_token[train], minlength=len(keys))
    return Grams(names[local], lengths, names[pair % width], names[pair // width], names[last], of_token, trained)


def _batch_row(table: pa.Table) -> dict:
    return table.select(["batch", "ids", "held", "lengths", "numbers"]).slice(0, 1).to_pylist()[0]


# -- Elias-Fano --------------------------------------------------------------------------------------------------------


def elias_fano(values: np.ndarray) -> dict[str, np.ndarray]:
    """A rising sequence of non-negative integers: low bits side by side, high bits as gaps between ones."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    bits = max(0, (top // n).bit_length() - 1) if n else 0
    places, step = np.arange(bits, dtype=np.uint64), 1 << 14  # a multiple of eight: pieces end at whole bytes
    pieces = [
        np.packbits(((values[at : at + step, None] >> places) & np.uint64(1)).astype(np.uint8), bitorder="little") for at in range(0, n, step)
    ]
    low = np.concatenate([*pieces, np.zeros(16, np.uint8)])  # room for reads of eight bytes
    ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
    flags = np.zeros((top >> bits) + n + 1, np.uint8)
    flags[ones] = 1
    return {"size": np.array([n, bits], np.int64), "low": low, "high": np.packbits(flags, bitorder="little")}


class EliasFano:
    """Lookups in a mapped sequence. The directory of buckets (equal high bits) is built when it is opened."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in parts["size"])
        low = parts["low"]
        self.low = np.lib.stride_tricks.as_strided(low[:8].view(np.uint64), (len(low) - 7,), (1,), writeable=False)
        flags = np.unpackbits(np.asarray(parts["high"]), bitorder="little")
        ones = np.flatnonzero(flags)[: self.n]
        self.high = (ones - np.arange(self.n)).astype(np.int64)
        buckets = int(self.high[-1]) + 2 if self.n else 1
        self.begin = np.searchsorted(self.high, np.arange(buckets + 1)).astype(np.int64)

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.int64)
        bit = at * self.bits
        found = self.low[bit >> 3] >> (bit & 7).astype(np.uint64)  # up to 57 bits
        if self.bits > 57:
            shift = (bit & 7).astype(np.uint64)
            high = self.low[(bit >> 3) + 8] & np.uint64(0xFF)
            found |= np.where(shift > 0, high << (np.uint64(63) - shift) << np.uint64(1), np.uint64(0))
        return (found & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        return (self.high[at] << self.bits) | self.lows(at)

    def successor(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the place of the first element not below it within [low, high), and whether it is that element."""
        bucket = np.clip(values >> self.bits, -1, len(self.begin) - 2)
        inside = (values >= 0) & ((values >> self.bits) <= len(self.begin) - 2)
        begin = np.clip(np.where(inside, self.begin[bucket], np.where(values < 0, 0, self.n)), low, high)
        end = np.clip(np.where(inside, self.begin[bucket + 1], begin), begin, high)
        target = values & ((1 << self.bits) - 1)
        left, right = begin.copy(), end.copy()
        active = np.flatnonzero(left < right)
        while len(active):
            middle = (left[active] + right[active]) >> 1
            below = self.lows(middle) < target[active]
            left[active[below]] = middle[below] + 1
            right[active[~below]] = middle[~below]
            active = active[left[active] < right[active]]
        hit = left < end
        hit[hit] = self.lows(left[hit]) == target[hit]
        return left, hit & inside


def grouped(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Groups of rising numbers (group i begins at ``begins[i]``) as one rising sequence: each group is lifted above the one before."""
    if not len(values):
        return values
    begins = _distinct(begins[begins < len(values)])  # without empty groups
    lasts = values[np.r_[begins[1:], len(values)] - 1] + 1
    lift = np.cumsum(lasts) - lasts
    return values + np.repeat(lift, np.diff(np.r_[begins, len(values)]))


def quantised(values: np.ndarray, codes: int = CODES) -> dict[str, np.ndarray]:
    """Values as codes into a table of at most ``codes`` values: all of them if there are no more, else means of equally many."""
    ordered = np.sort(values)
    table = ordered[_runs(ordered)]
    if len(table) > codes:
        table = _distinct(ordered[np.arange(codes) * len(ordered) // codes])  # equal values share a code
    code = np.searchsorted(table, values, "right") - 1
    if len(table):
        table = np.bincount(code, weights=values) / np.bincount(code)
    return {"code": code.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32), "table": table}


# -- 4: the trie of a shard --------------------------------------------------------------------------------------------


def _ordered(major: np.ndarray, minor: np.ndarray, width: int) -> np.ndarray:
    """The order by (major, minor), with minor below ``width``."""
    top = int(major.max(initial=0)) + 1
    return np.argsort(major * width + minor) if top * width < 1 << 62 else np.lexsort((minor, major))


def distinct_grams(first: np.ndarray, middle: np.ndarray, last: np.ndarray, counts: np.ndarray, at: Counts) -> tuple[np.ndarray, ...]:
    """Trigrams by (middle, first, last), repeats added up, and the place of each given one among them."""
    if not len(first):
        return first, middle, last, counts, np.zeros(0, np.int64)
    width = at.known + 3
    pairs, pair = np.unique(np.searchsorted(words := _distinct(middle), middle) * width + first, return_inverse=True)
    order = _ordered(pair, last, width)
    new = np.r_[True, (np.diff(pair[order]) != 0) | (np.diff(last[order]) != 0)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    kept = order[new]
    found = pairs[pair[kept]]
    return found % width, words[found // width], last[kept], np.add.reduceat(counts[order], np.flatnonzero(new)), place


def build_levels(
    first: np.ndarray, middle: np.ndarray, last: np.ndarray, counts: np.ndarray, at: Counts, totals: dict | None = None,
    discount: float = DISCOUNT, codes: int = CODES,
) -> dict[str, np.ndarray]:
    """The arrays of a trie from trigram counts (repeats are added). ``totals`` gives the sums and distinct successors of contexts
    that are split over shards, ``(middle, -1)`` of a word and ``(middle, first)`` of a pair; those without a trigram here are kept for
    their back-off weight."""
    use = counts > 0
    first, middle, last, counts, _ = distinct_grams(first[use], middle[use], last[use], counts[use].astype(np.int64), at)
    lonely = [k for k, (n, _) in totals.items() if n] if totals else []  # contexts that other shards may have alone
    words = _distinct(np.r_[middle, np.array([m for m, _ in lonely], np.int64)])
    word_of = np.searchsorted(words, middle)
    each_word = np.arange(len(words))
    # Successors of the middle words.
    width = at.known + 3
    by_last = _ordered(word_of, last, width)
    new = np.flatnonzero(np.r_[True, (np.diff(word_of[by_last]) != 0) | (np.diff(last[by_last]) != 0)]) if len(first) else by_last
    next_word, next_last = word_of[by_last][new], last[by_last][new]
    next_count = np.add.reduceat(counts[by_last], new) if len(new) else new
    next_begin = np.searchsorted(next_word, each_word)
    next_of = np.empty(len(first), np.int64)  # place of each trigram's last word among all successors
    next_of[by_last] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(first)]))
    # Pairs of middle and first word.
    alone = np.array([(m, f) for m, f in lonely if f >= 0], np.int64).reshape(-1, 2)
    key = word_of * width + first
    pairs = _distinct(np.r_[key, np.searchsorted(words, alone[:, 0]) * width + alone[:, 1]])
    pair_word, pair_first = pairs // width, pairs % width
    pair_of = np.searchsorted(pairs, key)
    pair_begin = np.searchsorted(pair_word, each_word)
    gram_begin = np.searchsorted(pair_of, np.arange(len(pairs)))

    if totals is None:
        word_sum, word_kinds = np.bincount(next_word, next_count, len(words)), np.bincount(next_word, minlength=len(words))
        pair_sum, pair_kinds = np.bincount(pair_of, counts, len(pairs)), np.bincount(pair_of, minlength=len(pairs))
    else:
        word_sum, word_kinds = np.array([totals[w, -1] for w in words.tolist()], float).reshape(-1, 2).T
        pair_sum, pair_kinds = np.array([totals[k] for k in zip(words[pair_word].tolist(), pair_first.tolist())], float).reshape(-1, 2).T
    word_rest, pair_rest = discount * word_kinds / word_sum, discount * pair_kinds / pair_sum
    base = 10 ** at.log_base(next_last)
    p2 = (next_count - discount) / word_sum[next_word] + word_rest[next_word] * base
    p3 = (counts - discount) / pair_sum[pair_of] + pair_rest[pair_of] * p2[next_of]
    rank = next_of - next_begin[word_of] if len(first) else next_of
    levels = {}
    for name, values in (
        ("word", words), ("next_at", next_begin), ("next", grouped(next_last, next_begin)),
        ("pair_at", pair_begin), ("pair", grouped(pair_first, pair_begin)),
        ("gram_at", gram_begin), ("gram", grouped(rank, gram_begin)),
    ):
        levels |= {f"{name}.{k}": v for k, v in elias_fano(values).items()}
    for name, values in (("word_rest", word_rest), ("next_p", p2), ("pair_rest", pair_rest), ("gram_p", p3)):
        levels |= {f"{name}.{k}": v for k, v in quantised(np.log10(values), codes).items()}
    return levels


def levels_to_bytes(levels: dict[str, np.ndarray]) -> bytes:
    """The arrays behind a short directory, each at a place that eight divides."""
    at, places, body = 0, {}, []
    for name, values in levels.items():
        data = np.ascontiguousarray(values).tobytes()
        places[name] = (values.dtype.str, len(values), at)
        body.append(data + bytes(-len(data) % 8))
        at += len(body[-1])
    head = json.dumps(places).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(body)


class Trie:
    """A trie mapped from a file of its levels."""

    def __init__(self, mapped: np.ndarray, at: Counts):
        size = int.from_bytes(mapped[:8].tobytes(), "little")
        arrays = {}
        for name, (kind, n, begin) in json.loads(mapped[8 : 8 + size].tobytes()).items():
            begin += 8 + size
            arrays[name] = mapped[begin : begin + n * np.dtype(kind).itemsize].view(kind)
        parts: dict[str, dict] = {}
        for name, values in arrays.items():
            level, part = name.split(".")
            parts.setdefault(level, {})[part] = values
        self.at = at
        self.level = {k: EliasFano(v) for k, v in parts.items() if "size" in v}
        self.value = {k: v for k, v in parts.items() if "code" in v}

    @classmethod
    def mapped(cls, levels: dict[str, np.ndarray], at: Counts) -> Trie:
        """Through a file that has no name: it goes with the last view of it, also if the worker dies."""
        with tempfile.TemporaryFile() as file:
            file.write(levels_to_bytes(levels))
            file.flush()
            return cls(np.memmap(file, np.uint8, "r"), at)

    def _values(self, name: str, at: np.ndarray) -> np.ndarray:
        return self.value[name]["table"][self.value[name]["code"][at]]

    def _children(self, name: str, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the children of each parent begin and end, and how far their group is lifted."""
        pointers, children = self.level[f"{name}_at"], self.level[name]
        begin = pointers.access(parent)
        more = parent + 1 < pointers.n
        end = np.full(len(parent), children.n, np.int64)
        end[more] = pointers.access(parent[more] + 1)
        lift = np.zeros(len(parent), np.int64)
        later = begin > 0
        lift[later] = children.access(begin[later] - 1) + 1
        return begin, end, lift

    def log_probabilities(self, first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
        result = self.at.log_base(last)
        words = self.level["word"]
        zero = np.zeros(len(middle), np.int64)
        word, known = words.successor(middle, zero, zero + words.n)
        known = np.flatnonzero(known)
        if not len(known):
            return result
        word, first, last = word[known], first[known], last[known]
        begin, end, lift = self._children("next", word)
        place, follows = self.level["next"].successor(last + lift, begin, end)
        two = result[known] + self._values("word_rest", word)
        two[follows] = self._values("next_p", place[follows])
        rank = place - begin
        low, high, lift = self._children("pair", word)
        pair, seen = self.level["pair"].successor(first + lift, low, high)
        three = two.copy()
        three[seen] += self._values("pair_rest", pair[seen])
        both = np.flatnonzero(seen & follows)
        low, high, lift = self._children("gram", pair[both])
        gram, stored = self.level["gram"].successor(rank[both] + lift, low, high)
        three[both[stored]] = self._values("gram_p", gram[stored])
        result[known] = three
        return result


def coded_logs(logs: np.ndarray, exact: bool) -> np.ndarray:
    """Log probabilities as whole numbers of steps, or as floats where those don't reach (probabilities below 1e-16)."""
    steps = np.rint(-logs / ANSWER_STEP)
    return logs.astype(np.float32) if exact or float(steps.max(initial=0)) >= 1 << 16 else steps.astype(np.uint16)


def decoded_logs(values: np.ndarray) -> np.ndarray:
    return values if values.dtype.kind == "f" else values * -ANSWER_STEP


# -- the operator ------------------------------------------------------------------------------------------------------


def language_model_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: Column | None = None,
    shard_tokens: int = SHARD_TOKENS,
    hot_tokens: int = HOT_TOKENS,
    codes: int = CODES,
    exact: bool = False,
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per document.

    The model learns from all whole texts that are not held out (null counts as learnt from) and scores all of them. Null and
    empty texts are one end. Repeated rows count each and stay separate rows. A null id is kept; by default it falls into the
    fold of the empty text. Ids are whole numbers. A text of any length is one piece of a batch; batches are bounded to 8 MB otherwise. Without
    training texts every token is unknown. An empty table gives an empty result. Other columns are not read.
    ``exact`` lets shards answer with whole floats instead of steps of ``ANSWER_STEP``.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    batches = token_batches(docs, id_col, text_col, fold_of(id_col) if held_out is None else held_out, parts)
    numbered, at = word_numbers(batches)
    texts = batches.filter("part = -1").select("batch", "ids", "held", "lengths", "numbers")
    tokens = texts.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    plan = Shards.planned(at, tokens, shard_tokens, hot_tokens)
    shared = spark.sparkContext.broadcast((at, plan))

    def ask(rows: pa.Table, names: pa.Table) -> pa.Table:
        """The trigrams of a batch for its shards."""
        at, plan = shared.value
        row = _batch_row(rows)
        g = grams_of(row, names, at)
        asked, shard = plan.asked(g, at)
        cuts = _runs(shard)
        made = [
            (row["batch"], int(shard[b]), *(pack(v[asked[b:e]]) for v in (g.first, g.middle, g.last, g.trained)))
            for b, e in zip(cuts, np.r_[cuts[1:], len(shard)])
        ]
        columns = list(zip(*made)) if made else [[]] * 6
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["batch", "shard", "first", "middle", "last", "trained"])

    # Batches travel once, for asking and for scoring, and trigrams once, for the sums of contexts and for the answers: it is all one
    # query, in which Spark uses equal shuffles again.
    asks = texts.groupBy("batch").cogroup(numbered.groupBy("batch")).applyInArrow(
        ask, "batch long, shard long, first binary, middle binary, last binary, trained binary"
    )

    def columns_of(table: pa.Table) -> tuple[list[np.ndarray], list[int]]:
        found, sizes = [], []
        for name in ("first", "middle", "last", "trained"):
            parts = [unpack(x).astype(np.int64) for x in table.column(name).to_pylist()]
            sizes = [len(p) for p in parts]
            found.append(np.concatenate(parts))
        return found, sizes

    def answers(table: pa.Table, totals: dict | None) -> pa.Table:
        at, _ = shared.value
        (first, middle, last, trained), sizes = columns_of(table)
        first, middle, last, trained, place = distinct_grams(first, middle, last, trained, at)
        trie = Trie.mapped(build_levels(first, middle, last, trained, at, totals, codes=codes), at)
        cuts = np.split(coded_logs(trie.log_probabilities(first, middle, last), exact)[place], np.cumsum(sizes)[:-1])
        del trie, first, middle, last, trained, place
        give_back()
        return pa.table({"batch": table.column("batch"), "shard": table.column("shard"), "logs": pa.array([pack(c) for c in cuts], pa.binary())})

    reply = "batch long, shard long, logs binary"
    if not len(plan.hot):
        replies = asks.groupBy("shard").applyInArrow(lambda table: answers(table, None), reply)
    else:

        def contexts(table: pa.Table) -> pa.Table:
            """Sums and distinct successors of the contexts asked for in this shard; last words are dealt out, so both add up over
            shards. Other shards have their contexts whole."""
            names = ["shard", "middle", "first", "n", "kinds"]
            if table.column("shard")[0].as_py() < shared.value[1].cold:
                return pa.table([pa.array([], pa.int64())] * len(names), names=names)
            (first, middle, last, trained), _ = columns_of(table)
            made = []
            for pair in (first, np.full(len(first), -1)):
                order = np.lexsort((last, trained == 0, pair, middle))  # per context those with counts first, by last word
                m, p, w, n = middle[order], pair[order], last[order], trained[order]
                new = np.r_[True, (np.diff(m) != 0) | (np.diff(p) != 0)]
                kind = (np.r_[True, np.diff(w) != 0] | new) & (n > 0)
                runs = np.flatnonzero(new)
                made.append((m[runs], p[runs], np.add.reduceat(n, runs), np.add.reduceat(kind.astype(np.int64), runs)))
            cols = [np.concatenate(c) for c in zip(*made)]
            shard = np.full(len(cols[0]), table.column("shard")[0].as_py(), np.int64)
            return pa.table([pa.array(c.astype(np.int64)) for c in (shard, *cols)], names=names)

        partial = asks.groupBy("shard").applyInArrow(contexts, "shard long, middle long, first long, n long, kinds long")
        whole = Window.partitionBy("middle", "first")  # one row per shard of the word
        sums = partial.select("shard", "middle", "first", F.sum("n").over(whole).alias("n"), F.sum("kinds").over(whole).alias("kinds"))

        def with_totals(table: pa.Table, sums: pa.Table) -> pa.Table:
            if table.column("shard")[0].as_py() < shared.value[1].cold:
                return answers(table, None)
            m, f, n, k = (sums.column(c).to_pylist() for c in ("middle", "first", "n", "kinds"))
            return answers(table, {(a, b): (x, y) for a, b, x, y in zip(m, f, n, k)})

        replies = asks.groupBy("shard").cogroup(sums.groupBy("shard")).applyInArrow(with_totals, reply)

    returned = replies.select("batch", "shard", "logs", F.lit(None).cast("binary").alias("numbers"), F.lit(None).cast("binary").alias("words"))
    both = returned.unionByName(numbered.select("batch", F.lit(-1).cast("long").alias("shard"), F.lit(None).cast("binary").alias("logs"), "numbers", "words"))
    schema = f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(rows: pa.Table, back: pa.Table) -> pa.Table:
        at, plan = shared.value
        row = _batch_row(rows)
        names = back.filter(pc.equal(back.column("shard"), -1))
        g = grams_of(row, names, at)
        logs = at.log_base(g.last)
        asked, _ = plan.asked(g, at)
        replies = back.filter(pc.greater_equal(back.column("shard"), 0)).sort_by("shard")
        found = [decoded_logs(unpack(x)) for x in replies.column("logs").to_pylist()]
        if found:
            logs[asked] = np.concatenate(found)
        begins = np.cumsum(g.lengths) - g.lengths
        known = np.add.reduceat((g.stream != at.unknown).astype(np.int64), begins)
        base = np.add.reduceat(at.log_base(g.stream), begins)
        total = np.add.reduceat(logs[g.of_token], begins)
        columns = [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(g.lengths), pa.array(known)]
        columns += [pa.array(np.full(len(known), at.tokens, np.int64)), pa.array(base), pa.array(total)]
        return pa.table(columns, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return written(texts.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(score, schema), "scores")
