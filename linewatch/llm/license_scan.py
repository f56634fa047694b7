"""License scan: an exact set-similarity join of license templates with blocks of text.

A block is a stretch of words, taken at a fixed stride over the whole text, so that every template that stands in a text
stands whole in some block. A block meets a template when it holds at least ``threshold`` of the template's distinct words.
Words are ordered by how often the corpus has them, rarest first, and three filters spare most comparisons without losing one:

- prefix: a block that meets a template of m words with a = ceil(threshold * m) has one of its m - a + 1 rarest words;
- length: the block has at least a distinct words;
- position: if the first word in common stands at place i of the template and at place j of the block's template words, at
  most 1 + min(words after i, words after j) can be in common.

Only the words of templates are counted and ordered: a few hundred, whatever the corpus; they and the templates are all that
is sent to tasks. The texts are scanned where they are read and nothing of them is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import alnum_words, arrow_map, text_bytes

THRESHOLD = 0.9
BLOCK = 48
STRIDE = 24

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as licenses word them, at most ``BLOCK - STRIDE`` words each.
TEMPLATES: Sequence[tuple[str, str]] = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    ("cc0", "dedicated to the public domain under the creative commons cc0 1.0 universal dedication"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form without prior written permission"),
)


def word_order(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> list[bytes]:
    """The template words, rarest in the corpus first; counted over all whole texts with sums per task."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: Counter[bytes] = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(alnum_words(text))
            some = [w for w in vocabulary if w in counts]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([counts[w] for w in some], pa.int64())], ["_w", "_n"])

        return each

    counted = arrow_map(docs.select(text_bytes(text_col).alias("_text")), make, "_w binary, _n long")
    found = {bytes(w): n for w, n in counted.groupBy("_w").agg(F.sum("_n")).collect()}  # at most the vocabulary
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


class Index:
    """Templates in word order with an inverted list of their prefixes."""

    def __init__(self, templates: Sequence[tuple[str, str]], order: Sequence[bytes], threshold: float):
        self.rank = {w: i for i, w in enumerate(order)}
        self.labels = [label for label, _ in templates]
        self.sets = [sorted({self.rank[w] for w in alnum_words(text.encode())}) for _, text in templates]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.lists: dict[int, list[int]] = {}
        for k, (words, need) in enumerate(zip(self.sets, self.need)):
            for r in words[: len(words) - need + 1] if words else ():
                self.lists.setdefault(r, []).append(k)
        back = {i: w for w, i in self.rank.items()}
        self.probes = {back[r] for r in self.lists}

    def meets(self, words: Sequence[bytes]) -> list[tuple[int, float]]:
        """``(template, containment)`` of every template that the block meets."""
        distinct = set(words)
        have = sorted(self.rank[w] for w in distinct if w in self.rank)
        place = {r: j for j, r in enumerate(have)}
        seen: set[int] = set()
        out = []
        for r in have:
            for k in self.lists.get(r, ()):
                if k in seen:
                    continue
                seen.add(k)
                mine, need = self.sets[k], self.need[k]
                if len(distinct) < need:
                    continue
                # ``r`` is the first of the template's words that the block has: ``have`` is walked in order.
                i, j = mine.index(r), place[r]
                if 1 + min(len(mine) - i - 1, len(have) - j - 1) < need:
                    continue
                common = sum(x in place for x in mine)
                if common >= need:
                    out.append((k, common / len(mine)))
        return out


def scan(words: list[bytes], index: Index, phrases: Sequence[tuple[tuple[bytes, ...], str]], block: int = BLOCK, stride: int = STRIDE):
    """Phrase places ``(start, label)`` and blocks ``(first word, template, containment)`` of one text."""
    starts = {p[0] for p, _ in phrases}
    wanted = starts | index.probes
    at = [i for i, w in enumerate(words) if w in wanted]
    places = [(i, label) for i in at if words[i] in starts for p, label in phrases if tuple(words[i : i + len(p)]) == p]
    numbers: set[int] = set()
    for i in at:
        if words[i] in index.probes:
            numbers.update(range(max(0, (i - block) // stride + 1), i // stride + 1))
    blocks = [(b * stride, k, share) for b in sorted(numbers) for k, share in index.meets(words[b * stride : b * stride + block])]
    return places, blocks


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
    stride: int = STRIDE,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``.

    ``n_base`` counts the places where a phrase's words stand consecutively, ``first_word`` and ``last_word`` are the smallest
    and largest of them (null without any), ``base_labels`` their labels. ``labels`` adds those of the templates met; both are
    distinct, sorted and comma-joined, empty if there are none. ``score`` is 1 with a phrase, else the largest containment of
    a template met, else 0. ``blocks`` lists every block and template that meet. Null texts are empty; repeated rows stay;
    other columns are not read; an empty table gives an empty result.
    """
    longest = max((len(alnum_words(t.encode())) for _, t in templates), default=0)
    if longest > block - stride + 1:
        raise ValueError(f"a template of {longest} words may stand in no block of {block} words at stride {stride}")
    vocabulary = {w for _, t in templates for w in alnum_words(t.encode())}
    index = Index(templates, word_order(docs, text_col, vocabulary), threshold)
    runs = [(tuple(alnum_words(p.encode())), label) for p, label in phrases.items()]
    shared = docs.sparkSession.sparkContext.broadcast((index, runs))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))
    source = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def make():
        index, runs = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                words = alnum_words(text)
                places, blocks = scan(words, index, runs, block, stride)
                base = {label for _, label in places}
                more = {index.labels[k] for _, k, _ in blocks}
                starts = [i for i, _ in places]
                rows.append((
                    len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | more)), 1.0 if places else max((s for *_, s in blocks), default=0.0),
                    [{"start": b, "label": index.labels[k], "share": s} for b, k, s in blocks],
                ))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            columns = zip(*rows) if rows else [[]] * len(types)
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names)

        return each

    schema = (
        f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, blocks array<struct<start: long, label: string, share: double>>"
    )
    return arrow_map(source, make, schema)
