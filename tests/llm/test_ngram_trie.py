"""The trigram model against a plain restatement, and Elias-Fano sequences against sorted lists."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewatch.llm import ngram_trie as nt
from tests.llm.corpus import SCHEMA, awkward, frame, random_rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END, START = b"", b"\n"


def tokens(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [*WORD.findall(lower), END]


def brute(rows, held=lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, discount=nt.DISCOUNT):
    """``(id, held out, tokens, known, N, base, score)`` per row by the formulas of the module's docstring."""
    one, two, three = Counter(), Counter(), Counter()
    for i, text, *_ in rows:
        if not held(i):
            t = [START, START, *tokens(text)]
            one.update(t[2:])
            two.update(zip(t[1:], t[2:]))
            three.update(zip(t, t[1:], t[2:]))
    n, v = sum(one.values()), len(one)

    def contexts(counts):
        total, kinds = defaultdict(int), defaultdict(int)
        for gram, c in counts.items():
            total[gram[:-1]] += c
            kinds[gram[:-1]] += 1
        return total, kinds

    (sum2, kinds2), (sum3, kinds3) = contexts(two), contexts(three)

    def p1(w):
        return (one[w] + 1) / (n + v + 1)

    def p2(b, w):
        if not sum2[(b,)]:
            return p1(w)
        return max(two[b, w] - discount, 0) / sum2[(b,)] + discount * kinds2[(b,)] / sum2[(b,)] * p1(w)

    def p3(a, b, w):
        if not sum3[a, b]:
            return p2(b, w)
        return max(three[a, b, w] - discount, 0) / sum3[a, b] + discount * kinds3[a, b] / sum3[a, b] * p2(b, w)

    found = []
    for i, text, *_ in rows:
        t = [START, START, *tokens(text)]
        base = sum(math.log10(p1(w)) for w in t[2:])
        score = sum(math.log10(p3(*g)) for g in zip(t, t[1:], t[2:]))
        found.append((i, held(i), len(t) - 2, sum(one[w] > 0 for w in t[2:]), n, base, score))
    return found


def compare(made, want, close=1e-6):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[6], 2))
    made, want = sorted(map(tuple, made.collect()), key=key), sorted(want, key=key)
    assert [r[:5] for r in made] == [r[:5] for r in want]
    for a, b in zip(made, want):
        assert a[5:] == (pytest.approx(b[5], rel=1e-9), pytest.approx(b[6], rel=close, abs=1e-6))


@pytest.mark.parametrize("rows", [awkward(), random_rows(6), awkward() + random_rows(8)], ids=["awkward", "random", "both"])
@pytest.mark.parametrize("hot", [nt.HOT_TOKENS, 40], ids=["whole", "split"])
def test_equals_the_formula(spark, rows, hot):
    docs = frame(spark, rows, clash=True).withColumns({c: F.lit("own") for c in ("batch", "held_out", "n_tokens", "words", "shard")})
    made = nt.language_model_scores(docs.repartition(3), shard_tokens=500, hot_tokens=hot, codes=1 << 20, exact=True)
    assert made.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    compare(made, brute(rows))


def test_quantised_scores_are_near(spark):
    rows = random_rows(9, 200)
    want = brute(rows)
    for codes, each in ((64, 0.05), (nt.CODES, 0.001)):
        made = {r["doc_id"]: r["score"] for r in nt.language_model_scores(frame(spark, rows), codes=codes).collect()}
        assert sum(abs(made[r[0]] - r[6]) for r in want) <= each * sum(r[2] for r in want)


def test_other_folds_and_no_training_texts(spark):
    rows = random_rows(10, 60)
    odd = lambda i: i % 2 == 1
    compare(nt.language_model_scores(frame(spark, rows), held_out=F.col("doc_id") % 2 == 1, codes=1 << 20, exact=True), brute(rows, odd))
    compare(nt.language_model_scores(frame(spark, rows), held_out=F.lit(True), exact=True), brute(rows, lambda i: True))
    assert nt.language_model_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_batches_and_trigrams_travel_once(spark, monkeypatch):
    """Also with split words: the trigrams of a batch are made once, and texts are shuffled once for asking and scoring."""
    plans, write = {}, nt.written

    def noted(df, name):
        df.collect()
        plans[name] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return write(df, name)

    monkeypatch.setattr(nt, "written", noted)
    rows = random_rows(3)
    compare(nt.language_model_scores(frame(spark, rows), shard_tokens=500, hot_tokens=20, codes=1 << 20, exact=True), brute(rows))
    assert not {"hot-trigrams", "answers"} & set(plans)
    assert plans["scores"].count("FlatMapCoGroupsInArrow") == 3 and plans["scores"].count("ReusedExchange") == 2


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    """Texts from a chain of words: who comes next depends on the word before."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        word, text = rng.randrange(40), []
        for _ in range(60):
            text.append(f"w{word}")
            word = (word * 7 + rng.randrange(3)) % 40
        rows.append((i, " ".join(text), "en", "a", 0))
    held = [r for r in nt.language_model_scores(frame(spark, rows)).collect() if r["held_out"]]
    assert len(held) > 20 and all(r["score"] > 0.5 * r["base_score"] for r in held)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    known = 12
    counts = np.sort(rng.integers(1, 9, known))[::-1]
    steps, firsts = np.unique(-counts, return_index=True)
    at = nt.Counts(-steps, firsts, int(counts.sum()), known, 3)
    first, middle, last = rng.integers(0, known, (3, 60))
    trie = nt.Trie.mapped(nt.build_levels(first, middle, last, np.ones(60, int), at), at)
    every = np.arange(known + 1)  # with the unknown word
    for a in (0, 3, at.start, at.unknown):
        for b in range(known):
            assert (10 ** trie.log_probabilities(np.full(known + 1, a), np.full(known + 1, b), every)).sum() == pytest.approx(1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1 << 34), min_size=1, max_size=9, unique=True).map(sorted), max_size=9), st.integers(0, 1 << 34))
def test_successor_search(groups, other):
    begins = np.cumsum([0] + [len(g) for g in groups])[:-1].astype(np.int64) if groups else np.zeros(0, np.int64)
    values = np.array([x for g in groups for x in g], np.int64)
    lifted = nt.grouped(values, begins)
    sequence = nt.EliasFano(nt.elias_fano(lifted))
    assert sequence.access(np.arange(len(values))).tolist() == lifted.tolist()
    for g, begin in zip(groups, begins.tolist()):
        lift = int(lifted[begin]) - g[0]
        asked = np.array(sorted({*g, other, *(x + 1 for x in g), 0}), np.int64)
        place, hit = sequence.successor(asked + lift, np.full(len(asked), begin), np.full(len(asked), begin + len(g)))
        assert hit.tolist() == [x in g for x in asked.tolist()]
        assert all(place[k] == begin + g.index(x) for k, x in enumerate(asked.tolist()) if x in g)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB \t\n\x0b\x0c\r\x1c\x85　É1.ß"), max_size=20)), max_size=6))
def test_tokens(texts):
    if not texts:
        return
    stream, lengths, words = nt.tokens_of(pa.array(texts, pa.string()))
    ends = np.array([len(words) // 2, len(words)] if len(words) > 1 else [1])
    assert np.array_equal(nt.word_parts(words, 7)[1:], nt.word_parts(words.slice(1), 7))
    words = nt.unpack_words(nt.pack_words(words, ends)).to_pylist()
    assert [words[i] for i in stream] == [w for t in texts for w in tokens(t)]
    assert lengths.tolist() == [len(tokens(t)) for t in texts]


@given(st.lists(st.integers(0, 1 << 40), max_size=20))
def test_packed_numbers(values):
    assert nt.unpack(nt.pack(np.array(values, np.int64))).tolist() == values


def test_long_sequences():
    rng = np.random.default_rng(4)
    for most in (1 << 20, 1 << 60):
        values = np.sort(rng.integers(0, most, 40_000))
        sequence = nt.EliasFano(nt.elias_fano(values))
        assert np.array_equal(sequence.access(np.arange(len(values))), values)
        asked = np.r_[rng.choice(values, 500), rng.integers(0, most, 500)]
        _, hit = sequence.successor(asked, np.zeros(1000, np.int64), np.full(1000, len(values)))
        assert np.array_equal(hit, np.isin(asked, values))
