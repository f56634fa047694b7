"""Exact duplicates, SimHash groups and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from linewatch.llm import exact_dedup, simhash, substring_dedup
from tests.llm.corpus import SCHEMA, awkward, frame, random_rows

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return BLANK.findall(text or "")


def key(row):
    return tuple((v is None, v) for v in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


CASES = [awkward(), random_rows(1), random_rows(2)]


@pytest.mark.parametrize("case", range(3))
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_duplicates(spark, case, keep):
    rows = CASES[case]
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    pick = max if keep == "largest" else min
    want = []
    for i, text, *_ in rows:
        group = groups[text or ""]
        best = pick((x for x in group if x is not None), default=None)
        want.append((i, best, len(group), i == best, hashlib.sha256((text or "").encode()).hexdigest()))
    got = exact_dedup.exact_duplicates(frame(spark, rows, clash=True), keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    same(got.collect(), want)


def test_exact_duplicates_survive_hash_collisions(spark):
    """Four bits of hash: nearly every group mixes texts, and still each text has a group of its own."""
    rows = CASES[1]
    full = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    same(exact_dedup.exact_duplicates(frame(spark, rows), hash_bits=4).collect(), [tuple(r) for r in full])


def brute_fingerprint(text):
    words = words_of((text or "").translate(LOWER))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints, radius):
    """The group number of every fingerprint: links at ``radius`` bits, closed transitively."""
    distinct = sorted(set(prints))
    group = {p: p for p in distinct}
    changed = True
    while changed:
        changed = False
        for p in distinct:
            for q in distinct:
                if (p ^ q).bit_count() <= radius and group[p] != group[q]:
                    low = min(group[p], group[q])
                    group = {k: low if v in (group[p], group[q]) else v for k, v in group.items()}
                    changed = True
    return group


@pytest.mark.parametrize("case", range(3))
def test_near_duplicates(spark, case):
    rows = CASES[case]
    prints = [brute_fingerprint(r[1]) for r in rows]
    group = brute_groups(prints, 4)
    first = {}
    for (i, *_), p in zip(rows, prints):
        if i is not None:
            first[group[p]] = min(first.get(group[p], i), i)
    want = [(r[0], f"{p:016x}", first.get(group[p])) for r, p in zip(rows, prints)]
    got = simhash.near_duplicates(frame(spark, rows, clash=True), tile=16)
    same(got.collect(), want)


@pytest.mark.parametrize("case", range(3))
def test_keep_one(spark, case):
    rows = CASES[case]
    prints = [brute_fingerprint(r[1]) for r in rows]
    group = brute_groups(prints, 4)
    best = {}
    for r, p in zip(rows, prints):
        rank = (r[0] is None, r[0] or 0)
        if group[p] not in best or rank < best[group[p]]:
            best[group[p]] = rank
    docs = frame(spark, rows, clash=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(best.values())


def test_tiles_find_every_link():
    """Chains of near fingerprints through two tiles: the forest spans what all pairs span."""
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = [seeds]
    for _ in range(4):
        flips = (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) | (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))
        prints.append(prints[-1] ^ flips)
    pool = np.unique(np.concatenate(prints))
    rng.shuffle(pool)
    left, right = np.sort(pool[:150]), np.sort(pool[150:])
    edges = [simhash.linked(left, None), simhash.linked(right, None), simhash.linked(left, right)]
    assert len(edges[2][0]) <= len(left) + len(right) - 1
    group = {int(p): int(p) for p in pool}
    for us, vs in edges:
        for u, v in zip(us.tolist(), vs.tolist()):
            assert (u ^ v).bit_count() <= 4
            a, b = group[u], group[v]
            group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert group == brute_groups([int(p) for p in pool], 4)


def brute_removed(rows, window):
    first = {}
    for i, text, *_ in rows:
        words = words_of(text)
        for at in range(len(words) - window + 1):
            run = tuple(words[at : at + window])
            if i is not None:
                first[run] = min(first.get(run, i), i)
    out = []
    for i, text, *_ in rows:
        words = words_of(text)
        gone = set()
        for at in range(len(words) - window + 1):
            if i is not None and first[tuple(words[at : at + window])] < i:
                gone.update(range(at, at + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("case", range(3))
@pytest.mark.parametrize("window", [50, 12])
def test_substring_dedup(spark, case, window):
    rows = CASES[case]
    want = brute_removed(rows, window)
    assert any(w[2] for w in want)
    got = substring_dedup.substring_dedup(frame(spark, rows, clash=True), window=window, anchor=8)
    same(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), want)
    for row in got.collect():
        assert sum(s["end"] - s["start"] for s in row["removed"]) == row["n_removed"]
        assert hashlib.sha256(row["kept"].encode()).hexdigest() == row["kept_sha256"]


def test_small_alphabet_needs_window_counts(spark):
    """Two words only: anchors stand in many different segments."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["x", "y"], 60, p=[0.9, 0.1])), "en", "a", 0) for i in range(40)]
    got = substring_dedup.substring_dedup(frame(spark, rows), window=12, anchor=4)
    same(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute_removed(rows, 12))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).columns == none.columns
    assert simhash.keep_one(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0


def test_few_fingerprints_make_few_tiles(spark):
    """Every shuffle partition used to cut a tile of its own, and the pairs of all those went to four times as many tasks."""
    from linewatch.llm import simhash

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        prints = spark.range(700).selectExpr("xxhash64(id) as _fp")
        made = simhash.tiles(prints, 100).collect()
        assert sum(len(r["_fps"]) for r in made) == 8 * 700 and len(made) <= 14
        assert simhash.links(prints, tile=400).rdd.getNumPartitions() <= 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
