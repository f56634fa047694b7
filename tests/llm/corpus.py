"""Small corpora for the tests: awkward rows, and random documents with copies and shared passages."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside themselves or return.
CLASH = ("_id", "_text", "_row", "_key", "_doc", "_fp", "component_id", "score", "kept", "taken", "_source", "_words")


def awkward() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows and repeated ids."""
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, "   \n\t ", "en", "a", 5),
        (4, long_text, "de", "b", len(long_text)),
        (5, long_text, "de", "b", len(long_text)),
        (6, "One two three four five", "en", "a", 23),
        (6, "One two three four five", "en", "a", 23),
        (7, f"start {passage} end", None, "b", 3),
        (7, f"other row of this id {passage} here", "fr", "c", 4),
        (8, f"later {passage} tail of it", "fr", None, 4),
        (None, f"without id {passage}", "en", "a", 4),
        (None, "One two three four five", "en", "a", 4),
        (9, "ÀB É x y ﬀ \U0001f600 one\x0btwo", "fr", "ü", 4),
        (10, "one", "en", "a", 3),
        (-5, "one", "en", "a", 3),
    ]
    return rows


def frame(spark, rows, clash: bool = False):
    made = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        made = made.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    return made


def random_rows(seed: int, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "klmn" for b in "aeiou"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.35:
            words = (rng.choice(rows)[1] or "x").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 160))]
            for _ in range(rng.randint(0, 2)):
                at = rng.randint(0, len(words))
                words[at:at] = rng.choice(passages)[rng.randint(0, 5) :]
            text = "".join(w + rng.choice([" "] * 9 + ["\n"]) for w in words)
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice("aaabc"), len(text)))
    rng.shuffle(rows)
    return rows
