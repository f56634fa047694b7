"""The conversation trie against a plain trie of Python dictionaries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linewatch.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, id string, n string"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def in_order(spark, rows):
    """Turns of every conversation as (role, text), in the order that the docstring states."""
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = docs.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t")
    ).withColumns({"m1": F.xxhash64(F.lit(1), "r", F.lit("\n"), "t"), "m2": F.xxhash64(F.lit(2), "t", F.lit("\n"), "r")})
    convs = defaultdict(list)
    for c, turn, r, t, m1, m2 in marks.collect():
        if c is not None:
            convs[c].append((turn is not None, turn or 0, m1, m2, (r, t)))
    return {c: [x[-1] for x in sorted(found)] for c, found in convs.items()}


def rebuilt(convs):
    made = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return made


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        turns = tuple(convs[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(WORDS.findall(node[-1][1].encode())) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children[node])
    return sorted(
        (
            members[x][0], len(x), members[x[:-1]][0] if x else None, len(members[x]), len(children[x]), leaves[x], saved[x],
            hashlib.sha256(",".join(map(str, ends[x])).encode()).hexdigest(),
        )
        for x in members
    )


def random_conversations(seed, n, turns=8):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        shared = rng.random()
        for t in range(rng.randint(1, turns)):
            text = rng.choice(["a", "b c", " d\te  f ", "", None]) if shared < 0.7 else f"own {rng.randint(0, 9)} of {c}"
            rows.append((c, t, rng.choice(["user", "user", None]), text, "x", "y", "z"))
    rng.shuffle(rows)
    return rows


def awkward():
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(0, t, "user", f"t{t}", None, None, None) for t in range(3)]
    rows += [(c, 0, "user", "only", None, None, None) for c in range(1, 24)]  # some become turnless
    rows += [(None, 0, "user", "no id", "", "", ""), (45, None, None, None, "", "", ""), (45, 0, "user", long, "", "", "")]
    rows += [(46, 1, "user", "tie", "", "", "")] * 3 + [(46, 1, "bot", "tie", "", "", ""), (46, None, "bot", "first", "", "", "")]
    rows += [(50, t, "user", "same", "", "", "") for t in range(400)]  # one conversation longer than all others
    rows += [(c, t, "user", "same", "", "", "") for c in (51, 52, 53, 57) for t in range(c - 40)]  # prefixes of it
    rows += [(-7, t, "user", "same", "", "", "") for t in range(5)]
    return rows


@pytest.mark.parametrize("rows", [random_conversations(1, 150), random_conversations(2, 40, 60), awkward()], ids=["short", "long", "awkward"])
def test_equals_a_plain_trie(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    convs = in_order(spark, rows)
    made = prefix_trie.conversation_trie(docs)
    assert sorted(map(tuple, made.collect()), key=_key) == sorted(brute(convs), key=_key)
    if all(c >= 0 for c in convs):
        made = prefix_trie.conversation_trie(docs, family=20)
        assert [f.dataType.simpleString() for f in made.schema] == ["bigint"] * 7 + ["string"]
        assert sorted(map(tuple, made.collect()), key=_key) == sorted(brute(rebuilt(convs)), key=_key)


def _key(row):
    return tuple((x is None, x) if x is not None else (True, 0) for x in row)


def test_small_blocks_give_the_same(spark):
    rows = [r for r in awkward() if r[0] is None or r[0] >= 0]
    turns, convs = prefix_trie.rebuilt_turns(prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    made = prefix_trie.prefix_trie(turns, convs, block=7)
    assert sorted(map(tuple, made.collect()), key=_key) == sorted(brute(rebuilt(in_order(spark, rows))), key=_key)


def test_rebuilt_conversations(spark):
    rows = [r for r in awkward() if r[0] is None or r[0] >= 0]
    turns, convs = prefix_trie.rebuilt_turns(prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    want = rebuilt(in_order(spark, rows))
    assert {r["conv"]: r["length"] for r in convs.collect()} == {c: len(t) for c, t in want.items()}
    assert any(not t for t in want.values())
    places = defaultdict(list)
    for r in turns.collect():
        places[r["conv"]].append(r["pos"])
    assert all(sorted(p) == list(range(1, len(want[c]) + 1)) for c, p in places.items())


def test_without_conversations(spark):
    for rows in ([], [(None, 1, "user", "x", "", "", "")]):
        assert prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), family=20).count() == 0


def test_two_fattest(spark):
    pairs = [(low, high) for low in range(20) for high in range(low + 1, 40)]
    found = spark.createDataFrame(pairs, "lo long, hi long").selectExpr("lo", "hi", f"{prefix_trie.fattest('lo', 'hi')} as f").collect()
    assert all(r["f"] == max(range(r["lo"] + 1, r["hi"] + 1), key=lambda x: x & -x) for r in found)
