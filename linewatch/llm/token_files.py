"""Token ids in Parquet: one list column per document, written in ascending id order, for selective reads.

The documents are range-partitioned and sorted by id before they are encoded, so part files follow one another in id order
and hold each text's tokens once. Spark's Parquet writer does the rest: ids are dictionary-coded (two bytes each for a 50k
vocabulary), row groups and pages have set sizes, and page indexes let a reader of a few ids, or of the metadata columns
only, skip the rest of a file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewatch.llm.common import arrow_map, bound_batches, give_back, release_stores, text_bytes, worker_store
from linewatch.session import materialise, working_path

TOKENIZER = "byte_bpe_50k.json"
ROW_GROUP = 32 << 20
PAGE = 256 << 10
CACHE_WORDS = 200_000  # words remembered per Python worker, about 30 MB; more save time on wide vocabularies
ENCODED_ROWS = 128  # texts whose ids are gathered together
LEARNT_PIECES = 4096  # new words given to the library at once, which makes objects for all their tokens
STORE = "encoders"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids by a byte-level BPE of the tokenizers library, remembering words.

    The vocabulary's pattern cuts a text before every single blank and around every single line feed that stands between other
    characters, and tokens never span a cut, so the ids of a text are those of its pieces. It also cuts between a letter or
    digit and a closing mark. Each piece is encoded by the library once and remembered; texts with runs of white space are
    given to the library whole. Many texts are cut at once: each distinct piece is looked up once, and the ids are gathered.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # A text that holds the string of an added token is encoded whole: the library gives it the token's id.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # one character of a token stands for one byte
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.marks = {m: self._whole(m) for m in _MARKS}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def _learn(self, pieces: list[bytes]) -> None:
        """Remember new pieces: one text for many of them, cut where the bytes of the tokens reach the ends of the pieces."""
        for at in range(0, len(pieces), LEARNT_PIECES):
            some = pieces[at : at + LEARNT_PIECES]
            placed = [p if p[0] == 10 else b" " + p for p in some]
            made = self.library.encode_batch_fast([b"".join(placed).decode()], add_special_tokens=False)[0]
            ids = np.array(made.ids, self.kind)
            ends = np.cumsum(np.fromiter(map(len, placed), np.int64, len(placed)))
            cuts = (np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1) * self.kind.itemsize
            raw, cuts = ids.tobytes(), cuts.tolist()
            self.known.update(zip(some, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))

    def _learn_heads(self, heads: list[bytes]) -> None:
        """Remember words that begin a text, without a blank before them, under names with a blank."""
        for at in range(0, len(heads), LEARNT_PIECES):
            some = heads[at : at + LEARNT_PIECES]
            made = self.library.encode_batch_fast([h.decode() for h in some], add_special_tokens=False)
            self.known.update((b" " + h, np.array(m.ids, self.kind).tobytes()) for h, m in zip(some, made))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        made = self.encoded(pa.array(texts, pa.large_string()))
        return [ids for lengths, flat in made for ids in np.split(flat, np.cumsum(lengths)[:-1])]

    def encoded(self, texts: pa.Array, room: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(lengths, ids)`` of every ``ENCODED_ROWS`` texts (large strings without nulls), with ``room`` zeros after each text."""
        if not len(texts):
            return
        if len(self.known) > self.limit // 2:
            self.older, self.known = self.known, {}  # words still in use come back from the older half
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        begins = lists.offsets.to_numpy().astype(np.int64)
        begins -= begins[0]
        pieces = _bytes_of(coded.dictionary)
        del lists, coded
        known = self.known
        values = list(map(known.get, pieces))
        new = [i for i, v in enumerate(values) if v is None]
        if self.older:
            for i in new:
                if (v := self.older.get(pieces[i])) is not None:
                    values[i] = known[pieces[i]] = v
            new = [i for i in new if values[i] is None]
        heads = [pieces[c] for c in code[begins[:-1]].tolist()]
        # Texts to be given to the library whole.
        odd = np.zeros(len(pieces), bool)
        odd[[i for i, p in zip(new, _strings([pieces[i] for i in new])) if not _regular(p)]] = True
        inner = np.ones(len(code), bool)
        inner[begins[:-1]] = False  # the first piece has no blank before it
        alone = np.array([not h or h[0].isspace() or h[-1].isspace() for h in _strings(heads)], bool)
        alone[np.searchsorted(begins, np.flatnonzero(odd[code] & inner), "right") - 1] = True
        for a in self.added:
            alone |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        # New words of the other texts.
        whole = np.repeat(alone, np.diff(begins))
        used = np.zeros(len(pieces), bool)
        used[code[inner & ~whole]] = True
        new = [i for i in new if used[i]]
        marked = []
        fresh: dict[bytes, None] = {}
        for i in new:
            p = pieces[i]
            if p[-1:] in _MARK_BYTES and _follows_word(p):
                marked.append(i)
                p = p[:-1]
            if p not in known:
                fresh[p] = None
        self._learn(list(fresh))
        self._learn_heads([h for h in dict.fromkeys(h for h, w in zip(heads, alone.tolist()) if not w) if b" " + h not in known])
        for i in marked:
            known[pieces[i]] = known[pieces[i][:-1]] + self.marks[pieces[i][-1:].decode()]
        for i in new:
            values[i] = known[pieces[i]]
        # What stands for each piece: its own ids, those of a text's beginning or of a whole text, the room, or nothing.
        code[begins[:-1]] = np.arange(len(values), len(values) + len(texts))
        values += [self._whole(texts[j].as_py()) if w else known[b" " + h] for j, (h, w) in enumerate(zip(heads, alone.tolist()))]
        nothing = len(values) + 1
        code[whole & inner] = nothing
        values = [v or b"" for v in values] + [bytes(room * self.kind.itemsize), b""]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(values), self.kind)
        starts = np.cumsum(sizes) - sizes
        for at in range(0, len(texts), ENCODED_ROWS):
            cut = begins[at : at + ENCODED_ROWS + 1]
            part = np.insert(code[cut[0] : cut[-1]], cut[1:] - cut[0], nothing - 1)
            many = sizes[part]
            ends = np.cumsum(many)
            ids = flat[np.repeat(starts[part] - ends + many, many) + np.arange(ends[-1])]
            yield np.diff(ends[cut[1:] - cut[0] + np.arange(len(cut) - 1)], prepend=0), ids


def _bytes_of(words: pa.Array) -> list[bytes]:
    """Distinct large strings as bytes."""
    _, places, data = words.buffers()
    offsets = np.frombuffer(places, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(offsets, offsets[1:])]


def _strings(pieces: list[bytes]) -> list[str]:
    """Pieces, which hold no blank, as strings."""
    return b" ".join(pieces).decode().split(" ") if pieces else []


def _follows_word(piece: bytes) -> bool:
    """Whether a letter or digit stands before the last byte, a mark."""
    before = piece[-2:-1]
    return before.isalnum() if before < b"\x80" else piece.decode()[-2].isalnum()


def _texts(column: pa.Array) -> pa.Array:
    """Bytes as strings; what is no UTF-8 becomes replacement characters."""
    column = column.cast(pa.large_binary())
    try:
        return column.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in column.to_pylist()], pa.large_string())


_MARKS = ".,"
_MARK_BYTES = (b".", b",")


def _regular(piece: str) -> bool:
    """Not empty, and no white space at its ends but one line feed before another character: no part of a longer run."""
    inner = piece[1:] if piece[:1] == "\n" else piece
    return bool(inner) and inner.strip() == inner


def _encoder(path: str, limit: int) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    store = worker_store(STORE)
    if path not in store or store[path].limit != limit:
        store[path] = Encoder(path, limit)
    return store[path]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    row_group: int = ROW_GROUP,
    page: int = PAGE,
    cache_words: int = CACHE_WORDS,
) -> str:
    """Write ``doc_id, n_tokens, ids`` for every row, ``end_id`` after each text, and return ``path``.

    Rows stand in ascending id order across the files (null ids first, equal ids by text). Null texts are empty: they hold the
    end id only. Other columns are not read. An empty table gives a folder without rows.
    """
    tokenizer = tokenizer or tokenizer_path()
    spark = docs.sparkSession
    bound_batches(spark)

    def encode(batches):
        release_stores(STORE)
        coder = _encoder(tokenizer, cache_words)
        for batch in batches:
            release_stores(STORE)
            at = 0
            for lengths, ids in coder.encoded(_texts(batch.column(1)), room=1):
                ends = np.cumsum(lengths)
                flat = ids.astype(np.int32)
                flat[ends - 1] = end_id
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lengths)), pa.array(lengths), lists], ["doc_id", "n_tokens", "ids"])
                at += len(lengths)
            give_back()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_text"))
        .repartitionByRange(parts, "_id")
        .sortWithinPartitions("_id", "_text")
    )
    (
        ordered.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>")
        .write.mode("overwrite")
        .option("compression", "snappy")
        .option("parquet.block.size", str(row_group))
        .option("parquet.page.size", str(page))
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.writer.version", "PARQUET_2_0")  # ids of documents and counts are then delta-coded
        .parquet(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, start``: ``start`` counts the ids of all documents before it.

    Selecting no ``ids`` reads the metadata columns only; a filter on ``doc_id`` skips row groups and pages.
    """
    files = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    placed = files.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    # One row per file: a file's documents begin after those of the files before it.
    sizes = placed.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    before = sizes.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_file").orderBy("_at")
    starts = placed.select("_file", "_at", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("_start"))
    return (
        placed.join(starts, ["_file", "_at"])
        .join(before, "_file")
        .select("doc_id", "n_tokens", "ids", (F.col("_before") + F.col("_start")).alias("start"))
    )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: CRC-32 of the ids as little-endian 32-bit integers."""
    files = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    placed = files.select("doc_id", "ids", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "_file", "_at", "n_tokens", "ids_crc32"],
            )

        return each

    return arrow_map(placed, make, "doc_id long, _file string, _at long, n_tokens long, ids_crc32 long")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, ids read back from the files once."""
    rows = materialise(token_digests(spark, path))
    sizes = rows.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    before = sizes.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_file").orderBy("_at")
    local = rows.select("*", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("_start"))
    return local.join(before, "_file").select(
        "doc_id", (F.col("_before") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_documents(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the token files (to the shared folder unless ``path`` is given) and return what ``token_index`` reads back."""
    path = path or working_path(docs.sparkSession, "tokens")
    return token_index(docs.sparkSession, write_tokens(docs, path, **options))
