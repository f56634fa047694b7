"""Line deduplication within one word or character edit, by a deletion-neighbourhood join. DataFrame functions only.

A line is its words; two lines are near when one inserted, deleted or replaced word makes them equal. Deleting a word from
either gives the variants: lines of n words that differ at place p agree in the variant without p, and a line equals the
variant of a longer line without its extra word. Variants are emitted as 128-bit hashes and joined where equal, the matched
lines are compared word by word, and of each match the earlier line stays.

A line of n words has n variants, so only lines that can have a partner emit them. With t the words of the shorter line, an
edit leaves the first or the last t/2 words of both alike, so near lines share a key made of their first, or last, L(t) words,
L(t) being the largest power of two up to t/2. A line that shares neither key with another line emits nothing; one that
shares only its beginning emits the variants without a later word, and likewise from the end. All lines that share a variant
are near one another, so each is matched with the earliest of its variant only, never with all.

Variants are hashed in one pass: a line's hash is the exclusive-or of hashes of (word, place), and without word p the words
behind it stand one place earlier, so running exclusive-ors over the line give the hashes of all its variants.

With ``short_lines``, lines of few words, or of long ones (a script without blanks), go the same way once more with characters
for words: one inserted, deleted or replaced character, a blank too, makes them near. And a line one word below the bound meets
the lines that have one word more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.llm.common import written

MIN_WORDS = 5
MIN_CHARS = 5
#: Lines of longer words than this on average are compared by characters, whatever their number of words.
LONG_WORDS = 20
_BLANK = r"[\x20\x09-\x0D]+"


def _plain(line: Column) -> Column:
    """The words of a line joined by one blank. Lines that are so already, nearly all, are not searched by a pattern."""
    odd = line.startswith(" ") | line.endswith(" ")
    for mark in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | line.contains(mark)
    return F.when(odd, F.trim(F.regexp_replace(line, _BLANK, " "))).otherwise(line)


def _numbered_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _half(words: Column) -> Column:
    """The largest power of two up to half the words."""
    return F.pow(F.lit(2), F.floor(F.log2(F.floor(words / 2)))).cast("int")


def _words_of(line: Column, n: Column) -> Column:
    """The first ``n`` words of a plain line, or the last ones for a negative number."""
    return F.call_function("substring_index", line, F.lit(" "), n)


def _chars_of(line: Column, n: Column) -> Column:
    """The first ``n`` characters of a line, or the last ones for a negative number."""
    return F.substr(line, F.when(n < 0, n).otherwise(1), F.abs(n))


def _keys(line: Column, n: Column, part_of=_words_of) -> Column:
    """Keys of beginnings (even) and ends (odd) for partners with as many, one more or one fewer words."""
    out = []
    for t in (n, n - 1):
        long = _half(t)
        for end, part in ((0, part_of(line, long)), (1, part_of(line, -long))):
            hashed = F.xxhash64(F.lit(end), long, part)
            out.append(hashed.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(end)))
    return F.array_distinct(F.array(*out))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, short_lines: bool = False) -> DataFrame:
    """``(_id, _no, _a, _b, _keys)``: every line with words of rows with an id, numbered from 0, with a 128-bit hash and its keys.

    With ``short_lines`` also ``_char_keys``.
    """
    split = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), F.posexplode(_numbered_lines(F.col(text_col))).alias("_no", "_raw")
    )
    plain = split.select("_id", "_no", _plain(F.col("_raw")).alias("_line")).filter("_line <> ''")
    line, n = F.col("_line"), F.col("_n")
    sized = plain.withColumn("_n", F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
    least, chars = max(min_words, 3), F.length(line)
    by_chars = ((n <= min_words + 1) | (chars > LONG_WORDS * n)) & (chars >= MIN_CHARS - 1)
    return sized.select(
        "_id", "_no", F.xxhash64(F.lit(1), line).alias("_a"), F.xxhash64(F.lit(2), line).alias("_b"),
        F.when(n >= (max(least - 1, 3) if short_lines else least), _keys(line, n)).alias("_keys"),
        *([F.when(by_chars, _keys(line, chars, _chars_of)).alias("_char_keys")] if short_lines else []),
    )


def asked_lines(held: DataFrame, keys_col: str = "_keys") -> DataFrame:
    """``(_a, _b, _ahead, _behind)``: distinct lines that share their beginning, or their end, with another line."""
    keys = held.select(F.explode(keys_col).alias("_half"), "_a", "_b")
    shared = keys.groupBy("_half").agg(F.min("_a").alias("_low"), F.max("_a").alias("_high")).filter("_low < _high").select("_half")
    side = F.col("_half").bitwiseAND(F.lit(1))
    return keys.join(shared, "_half", "left_semi").groupBy("_a", "_b").agg(
        F.max(side == 0).alias("_ahead"), F.max(side == 1).alias("_behind")
    )


def asked_words(docs: DataFrame, asked: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_a, _b, _chars, _id, _no, _ahead, _behind, _words)`` of the asked lines, from the document that has each of them first.

    ``_words`` are a line's characters where ``_chars`` is set.
    """
    wanted = written(asked.join(first, ["_a", "_b"]), "asked")
    places = wanted.groupBy("_id").agg(F.sort_array(F.collect_set("_no")).alias("_nos"))  # bounded by one document's lines
    # Only the asked lines leave the array of a text's lines, in the order of their numbers.
    some = F.filter(_numbered_lines(F.col("_text")), lambda _, i: F.array_contains("_nos", i))
    found = (
        docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .join(places, "_id")
        .select("_id", F.explode(F.arrays_zip(F.col("_nos").alias("n"), some.alias("l"))).alias("_m"))
        .select("_id", F.col("_m.n").alias("_no"), _plain(F.col("_m.l")).alias("_line"))
        .select("_id", "_no", "_line", F.xxhash64(F.lit(1), "_line").alias("_a"), F.xxhash64(F.lit(2), "_line").alias("_b"))
    )
    # Rows may share an id: the line must be the one asked for.
    asked_for = found.join(wanted, ["_a", "_b", "_id", "_no"]).dropDuplicates(["_a", "_b", "_chars"])
    words = F.when(F.col("_chars"), F.split("_line", "")).otherwise(F.split("_line", " "))
    return asked_for.select("_a", "_b", "_chars", "_id", "_no", "_ahead", "_behind", words.alias("_words"))


def variants(held: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(_chars, _ka, _kb, _at, _id, _no, _a, _b)``: each line itself (place -1) and its variants without the word at one place.

    Lines below the bound have no variants: they only meet those of longer lines.
    """
    seeds = (1, 2)

    def folded(seed: int, shift: int) -> Column:
        return F.aggregate(
            F.transform("_words", lambda w, i: F.xxhash64(F.lit(seed), w, i - shift)), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)
        )

    totals = held.repartition("_a", "_b").select(
        "*", *[folded(s, 0).alias(f"_whole{s}") for s in seeds], *[folded(s, 1).alias(f"_moved{s}") for s in seeds]
    )
    n = F.size("_words")
    least = F.when(F.col("_chars"), MIN_CHARS).otherwise(max(min_words, 3))
    each = totals.filter(n >= least).select(
        "_id", "_no", "_a", "_b", "_chars", "_ahead", "_behind", *[f"_whole{s}" for s in seeds], *[f"_moved{s}" for s in seeds],
        n.alias("_n"), F.posexplode("_words").alias("_at", "_word"),
    )
    upto = Window.partitionBy("_a", "_b", "_chars").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = []
    for s in seeds:
        here, moved = F.xxhash64(F.lit(s), "_word", "_at"), F.xxhash64(F.lit(s), "_word", F.col("_at") - 1)
        before = F.bit_xor(here).over(upto).bitwiseXOR(here)
        made.append(before.bitwiseXOR(F.col(f"_moved{s}")).bitwiseXOR(F.bit_xor(moved).over(upto)))
    short = _half(F.col("_n") - 1)
    without = each.select(
        "_chars", made[0].alias("_ka"), made[1].alias("_kb"), "_at", "_id", "_no", "_a", "_b",
        ((F.col("_ahead") & (F.col("_at") >= short)) | (F.col("_behind") & (F.col("_at") < F.col("_n") - short))).alias("_used"),
    ).filter("_used").drop("_used")
    whole = totals.select(
        "_chars", F.col("_whole1").alias("_ka"), F.col("_whole2").alias("_kb"), F.lit(-1).alias("_at"), "_id", "_no", "_a", "_b"
    )
    return whole.unionByName(without)


def near_lines(docs: DataFrame, held: DataFrame, first: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``(_a, _b, _of)``: distinct lines within one edit of an earlier line, and the place of the earliest one found."""
    asked = asked_lines(held).withColumn("_chars", F.lit(False))
    if "_char_keys" in held.columns:
        asked = asked.unionByName(asked_lines(held, "_char_keys").withColumn("_chars", F.lit(True)))
    words = written(asked_words(docs, asked, first, id_col, text_col), "words")
    made = written(variants(words, min_words), "variants")
    key = ["_chars", "_ka", "_kb"]
    often = made.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(*key)
    line = F.struct("_id", "_no", "_a", "_b")
    met = written(made.join(often, key, "left_semi").select(*key, "_at", line.alias("_line")), "met")
    at_place, whole = met.filter("_at >= 0"), met.filter("_at < 0").select(*key, F.col("_line").alias("_whole"))
    replaced = at_place.groupBy(*key, "_at").agg(F.min("_line").alias("_of"))
    longer = at_place.groupBy(*key).agg(F.min("_line").alias("_of"))
    # One partner each: the earliest line with the same variant, the line that the variant equals, the earliest longer line.
    pairs = (
        at_place.join(replaced, [*key, "_at"]).select("_chars", "_line", "_of")
        .unionByName(at_place.join(whole, key).select("_chars", "_line", F.col("_whole").alias("_of")))
        .unionByName(whole.join(longer, key).select("_chars", F.col("_whole").alias("_line"), "_of"))
        .filter("_of < _line")
        .distinct()
        .select("_chars", "_line._a", "_line._b", F.struct("_of._id", "_of._no").alias("_of"), F.col("_of._a").alias("_oa"), F.col("_of._b").alias("_ob"))
    )
    own = words.select("_chars", "_a", "_b", "_words")
    other = words.select("_chars", F.col("_a").alias("_oa"), F.col("_b").alias("_ob"), F.col("_words").alias("_other"))
    compared = pairs.join(own, ["_chars", "_a", "_b"]).join(other, ["_chars", "_oa", "_ob"])
    return compared.filter(within_one_edit(F.col("_words"), F.col("_other"))).groupBy("_a", "_b").agg(F.min("_of").alias("_of"))


def within_one_edit(a: Column, b: Column) -> Column:
    """True where one word edit makes two word arrays equal: their common beginning and end cover the shorter one but a word."""
    n, m = F.size(a), F.size(b)
    low = F.least(n, m)
    # The first place where they differ, from either end.
    ahead = F.coalesce(F.array_position(F.zip_with(F.slice(a, F.lit(1), low), F.slice(b, F.lit(1), low), lambda x, y: x == y), False), F.lit(0))
    behind = F.array_position(
        F.zip_with(F.reverse(F.slice(a, n - low + 1, low)), F.reverse(F.slice(b, m - low + 1, low)), lambda x, y: x == y), False
    )
    prefix = F.when(ahead == 0, low).otherwise(ahead - 1)
    suffix = F.when(behind == 0, low).otherwise(behind - 1)
    need = F.when(n == m, low - 1).otherwise(low)
    return (F.abs(n - m) <= 1) & (prefix + suffix >= need)


def line_decisions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, short_lines: bool = False
) -> DataFrame:
    """``(_id, _no, why)`` per line with words: ``why`` is null for lines that stay, "repeat" or "near" for those that go.

    Lines are ordered by document id, then line number. A line goes if an earlier line has the same words ("repeat") or is
    within one word edit ("near"; lines of fewer than ``min_words`` words are only compared as a whole). Whether the earlier
    line itself stays makes no difference.

    With ``short_lines``, the shorter of two lines within a word edit may have ``min_words - 1`` words, and lines of up to
    ``min_words + 1`` words, or of more than ``LONG_WORDS`` characters a word, are near within one character edit too if the
    longer one has ``MIN_CHARS`` characters.
    """
    held = written(lines(docs, id_col, text_col, min_words, short_lines), "lines")
    first = written(
        held.groupBy("_a", "_b").agg(F.min(F.struct("_id", "_no")).alias("_f")).select("_a", "_b", "_f._id", "_f._no"), "first"
    )
    near = near_lines(docs, held, first, id_col, text_col, min_words)
    verdict = first.select("_a", "_b", F.col("_id").alias("_fid"), F.col("_no").alias("_fno")).join(near, ["_a", "_b"], "left")
    is_first = (F.col("_id") == F.col("_fid")) & (F.col("_no") == F.col("_fno"))
    return held.select("_id", "_no", "_a", "_b").join(verdict, ["_a", "_b"]).select(
        "_id", "_no", F.when(~is_first, F.lit("repeat")).when(F.col("_of").isNotNull(), F.lit("near")).alias("why")
    )


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, short_lines: bool = False
) -> DataFrame:
    """Per document id ``doc_id, n_lines, n_repeat, n_near, removed_lines`` (sorted line numbers).

    ``n_lines`` counts lines with words; blank lines are never removed. Null and empty texts have no lines. Rows that share an
    id count as one document each of whose lines may stand twice; rows without an id are left alone and form one result row
    without removed lines. Other columns are not read; an empty table gives an empty result.
    """
    made = line_decisions(docs, id_col, text_col, min_words, short_lines)
    of_doc = made.groupBy("_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("why") == "repeat").alias("n_repeat"),
        F.count_if(F.col("why") == "near").alias("n_near"),
        F.sort_array(F.collect_set(F.when(F.col("why").isNotNull(), F.col("_no")))).alias("removed_lines"),
    )
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    return ids.join(of_doc.withColumnRenamed("_id", "doc_id"), "doc_id", "left").select(
        "doc_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_repeat", "n_near")],
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
    )


def without_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines in ``found`` (a result of ``line_dedup``) taken out of ``text_col``."""
    cut = found.select(F.col("doc_id").alias("_id"), F.col("removed_lines").alias("_cut")).filter("_id is not null")
    kept = F.array_join(
        F.filter(F.split(F.col(f"_doc.{text_col}"), "\n"), lambda _, i: ~F.array_contains(F.coalesce("_cut", F.array().cast("array<int>")), i)), "\n"
    )
    joined = docs.select(F.struct("*").alias("_doc"), F.col(id_col).cast("long").alias("_key")).join(cut, F.col("_key") == F.col("_id"), "left")
    return joined.select(*[kept.alias(c) if c == text_col else F.col("_doc").getField(c).alias(c) for c in docs.columns])
