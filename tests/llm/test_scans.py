"""License scan, benchmark decontamination, line dedup and page extraction against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from linewatch.llm import decontaminate, html_extract, license_scan, line_dedup
from tests.llm.corpus import SCHEMA, awkward, frame, random_rows

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CASES = [awkward(), random_rows(3), random_rows(4)]


def words_of(text):
    return ALNUM.findall((text or "").translate(LOWER))


def key(row):
    return tuple((v is None, v) for v in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


NOTICES = [
    "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "cc by cc by", "the\nGNU General Public\tLicense",
    "Licensed under the Apache License, Version 2.0.", "version 2 0 of Apache's license: licensed under the terms",
    "Permission is hereby granted, free of charge, to any persons obtaining a copy of this software and associated documentation files",
    "ALL RIGHTS RESERVEDÉ", "general public licence", "",
]


def license_rows():
    rng = random.Random(1)
    rows = list(awkward())
    for i in range(150):
        parts = [" ".join(rng.choice(["of", "the", "license", "under", "x", "mit", "public", "is"]) for _ in range(rng.randint(0, 90))) for _ in range(3)]
        rows.append((100 + i, f"{parts[0]} {rng.choice(NOTICES)}\n{parts[1]} {rng.choice(NOTICES)} {parts[2]}", "en", "a", 1))
    return rows


def brute_license(text, threshold=0.9, block=48, stride=24):
    words = words_of(text)
    places = []
    for phrase, label in license_scan.PHRASES.items():
        run = phrase.split(" ")
        places += [(i, label) for i in range(len(words)) if words[i : i + len(run)] == run]
    met = []
    for at in range(0, len(words), stride):
        have = set(words[at : at + block])
        for label, template in license_scan.TEMPLATES:
            want = set(words_of(template))
            share = len(want & have) / len(want)
            if share >= threshold:
                met.append((label, share))
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    labels = base | {label for label, _ in met}
    score = 1.0 if places else max((s for _, s in met), default=0.0)
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, len(met),
    )


def test_license_scan(spark):
    rows = license_rows()
    got = license_scan.license_scan(frame(spark, rows, clash=True))
    found = [(*tuple(r)[:8], len(r["blocks"])) for r in got.collect()]
    want = [(r[0], *brute_license(r[1])) for r in rows]
    same(found, want)
    assert {"mit", "apache-2.0", "gpl", "cc-by", "cc-by-nc", "reserved"} <= {x for w in want for x in w[6].split(",")}


def test_license_templates_must_fit_blocks(spark):
    with pytest.raises(ValueError):
        license_scan.license_scan(frame(spark, awkward()), templates=[("x", " ".join(map(str, range(40))))])


def bench_rows(rows):
    rng = random.Random(9)
    texts = [r[1] for r in rows if r[1] and len(words_of(r[1])) > 30]
    items = []
    for i in range(12):
        words = words_of(rng.choice(texts))
        at = rng.randrange(len(words) - 25)
        items.append((i, ("; ".join(words[at : at + rng.choice([3, 10, 17, 25])])).upper()))
    return [*items, (12, None), (13, ""), (14, "?!"), (3, items[3][1]), (None, items[5][1]), (15, items[6][1]), (200, "One TWO, three: four")]


def brute_leaks(rows, items, window=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[at : at + n]), set()).add(item)
    out = []
    for i, text, *_ in rows:
        words, hit, ids = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for at in range(len(words) - n + 1):
                found = windows.get(tuple(words[at : at + n]))
                if found:
                    hit.update(range(at, at + n))
                    ids |= {str(x) for x in found if x is not None}
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(ids), digest, bool(hit)))
    return out


@pytest.mark.parametrize("case", range(3))
@pytest.mark.parametrize("block_bytes", [1_000_000, 200])
def test_decontamination(spark, case, block_bytes):
    rows = CASES[case]
    items = bench_rows(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows, clash=True), bench, block_bytes=block_bytes)
    want = brute_leaks(rows, items)
    assert any(w[2] for w in want)
    same(got.drop("spans").collect(), want)
    kept = decontaminate.without_contaminated(frame(spark, rows, clash=True), bench, block_bytes=block_bytes)
    same(kept.select("doc_id").collect(), [(w[0],) for w in want if not w[5]])


def test_hit_spans_are_places_of_the_original(spark):
    rows = [(1, "Ünder — the (OLD, oak tree we) sat; down: again - today, né, and then left", "en", "a", 0)]
    bench = spark.createDataFrame([(1, "the old oak tree we sat down again today né"), (2, "then left")], "item_id long, text string")
    row = decontaminate.contamination(frame(spark, rows), bench).first()
    assert [rows[0][1][s["start"] : s["end"]] for s in row["spans"]] == ["the (OLD, oak tree we) sat; down: again - today, né", "then left"]


def test_empty_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.contamination(frame(spark, CASES[0]), none).collect())
    assert decontaminate.without_contaminated(frame(spark, CASES[0]), none).count() == len(CASES[0])


def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(rows, min_words=5):
    found, blank = [], re.compile(r"[^\x20\x09-\x0D]+")
    for i, text, *_ in rows:
        for no, line in enumerate((text or "").split("\n")):
            words = blank.findall(line)
            if words and i is not None:
                found.append((i, no, tuple(words)))
    first = {}
    for i, no, words in found:
        first[words] = min(first.get(words, (i, no)), (i, no))
    near = {
        w for w, at in first.items()
        if len(w) >= min_words and any(len(v) >= min_words and o < at and edit_at_most_one(list(w), list(v)) for v, o in first.items() if v != w)
    }
    out = {i: [i, 0, 0, 0, set()] for i, *_ in rows}
    for i, no, words in found:
        out[i][1] += 1
        if (i, no) != first[words]:
            out[i][2] += 1
            out[i][4].add(no)
        elif words in near:
            out[i][3] += 1
            out[i][4].add(no)
    return [(i, a, b, c, sorted(s)) for i, a, b, c, s in out.values()]


def line_rows(seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))] for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            if rng.random() < 0.5:
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [rng.choice("abcdefgh")][: rng.randint(0, 1)]
            lines.append(rng.choice(["", " "]) + "  ".join(words))
        rows.append((i, "\n".join(lines), "en", "a", 0))
    return rows


@pytest.mark.parametrize("rows", [awkward(), line_rows(1), line_rows(2)], ids=["awkward", "one", "two"])
def test_line_dedup(spark, rows):
    want = brute_lines(rows)
    got = line_dedup.line_dedup(frame(spark, rows, clash=True))
    same([(*tuple(r)[:4], tuple(r[4])) for r in got.collect()], [(*w[:4], tuple(w[4])) for w in want])
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def brute_short_lines(rows):
    blank, first = re.compile(r"[^\x20\x09-\x0D]+"), {}
    found = [(i, no, " ".join(blank.findall(line))) for i, text, *_ in rows for no, line in enumerate((text or "").split("\n"))]
    for i, no, line in found:
        first[line] = min(first.get(line, (i, no)), (i, no))

    def near(x, y):
        a, b = x.split(" "), y.split(" ")
        few = [len(w) <= 6 or len(line) > 20 * len(w) for w, line in ((a, x), (b, y))]
        return max(len(a), len(b)) >= 5 and edit_at_most_one(a, b) or all(few) and max(len(x), len(y)) >= 5 and edit_at_most_one(list(x), list(y))

    out = {i: set() for i, *_ in rows}
    for i, no, line in found:
        if line and ((i, no) != first[line] or any(v and o < (i, no) and v != line and near(line, v) for v, o in first.items())):
            out[i].add(no)
    return sorted((i, tuple(sorted(s))) for i, s in out.items())


def test_short_lines(spark):
    rng = random.Random(5)
    base = [
        "Home page", "Sign up now", "Hotel", "foo bar", "one two three four five", "a b c d e f", "\u672c\u7f51\u7ad9\u4f7f\u7528\u5c0f\u578b\u6587\u4ef6" * 5, "1", "2", "12345", "x \U0001f600 y z",
        "one two three four five six seven", "\u7f51\u7ad9" * 40 + " " + " ".join(["\u4f7f\u7528" * 15] * 7),
    ]
    lines = list(base)
    for line in base * 4:
        at = rng.randrange(len(line))
        lines.append(line[:at] + rng.choice(["", "q", " "]) + line[at + rng.randint(0, 1) :])
    lines += ["one two three four", "foobar", "one two three", "Hote", "Hots", "one two threefour five", "abcdef", "a b c d ef"]
    rows = [(i, "\n".join(lines[i * 4 : i * 4 + 4]), "en", "a", 0) for i in range(len(lines) // 4 + 1)]
    got = line_dedup.line_dedup(frame(spark, rows, clash=True), short_lines=True)
    assert sorted((r["doc_id"], tuple(r["removed_lines"])) for r in got.collect()) == brute_short_lines(rows)
    few = [(1, "foo bar\none two three four five", "en", "a", 0), (2, "foobar\none two three four\nno line of these", "en", "a", 0)]
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.line_dedup(frame(spark, few), short_lines=True).collect()}
    assert got == {1: [], 2: [0, 1]}


def test_lines_are_taken_out(spark):
    rows = [(1, "a b c d e\nkeep", "en", "s", 1), (2, "\na b x d e\n a b c d e\nkeep\nnew", None, None, None), (None, "a b c d e", None, None, None)]
    docs = frame(spark, rows, clash=True)
    kept = line_dedup.without_lines(docs, line_dedup.line_dedup(docs))
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {1: rows[0][1], 2: "\nnew", None: "a b c d e"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">Home</a></li><li><a>About us</a></ul></nav><div class="cookie-notice">We use cookies</div>
%s<p>Next <b>to</b> it: tea &amp; bis&shy;cuits,&nbsp;a &lt; b<br>new line.</p><div class="ad">Buy now</div><!-- <p>no</p> -->
<form><p>Your name</p></form><h2>Part two</h2><ul><li>One thing</li><li>Another thing here</li></ul>
<script>var t="</p><p>code</p>";</script><p>The end of the text, with a <a href="#">link inside</a>.%s
<section id="comments"><p>First reader comment</p></section><aside>Related text</aside><footer>&copy; 2024 All rights</footer></body></html>"""
TEXT = "Title of it\nNext to it: tea & bis­cuits, a < b new line.\nPart two\nOne thing\nAnother thing here\nThe end of the text, with a link inside."


def test_pages(spark):
    marked = PAGE % ("<article><h1>Title of it</h1>", "</article>")
    plain = PAGE % ('<div class="content has-sidebar"><h1>Title of it</h1>', '</div><div id="rightSidebar"><p>Side text of it</p></div>')
    pages = [
        (1, "u", marked), (1, "u", marked), (2, None, plain), (None, "n", ""), (4, "e", None), (5, "t", "plain text only"), (6, "b", "<p>cut off <b"),
        (7, "x", "<article><p>a<p>b &amp c</article><div>" * 1 + "<a>m</a>" * 50), (8, "l", "<article>" + "<p>long text here</p>" * 5000 + "</article>"),
    ]
    frame_ = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as n_chars", "2 as _html")
    got = html_extract.extract_pages(frame_)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {(r["page_id"], r["url"]): r["text"] for r in got.collect()}
    assert by[1, "u"] == TEXT and by[2, None] == TEXT
    assert by[None, "n"] == "" and by[4, "e"] == ""
    assert by[5, "t"] == "plain text only" and by[6, "b"] == "cut off"
    assert by[7, "x"] == "a\nb & c"
    assert by[8, "l"] == "\n".join(["long text here"] * 5000)
    assert got.count() == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_pages_with_text_outside_an_article(spark):
    text = "<p>" + "words of the long text here " * 40 + "</p>"
    plain = " ".join(["words of the long text here"] * 40)
    pages = [
        (1, "<div class='content'>" + text + "</div><article><p>short teaser of it</p></article>"),
        (2, "<article><p>first one here</p></article>" + text + "<article><p>second one here</p></article>"),
        (3, "<article><p>Short.</p>" + "<table><tr><td></td></tr></table>" * 40 + text + "<div></div>" * 40 + "<p>End.</p></article><ul>" + "<li><a>m</a></li>" * 40 + "</ul>"),
        (4, "<main>" + text + "</main>"),
    ]
    frame_ = spark.createDataFrame([(i, None, p) for i, p in pages], "page_id long, url string, html string")
    for weights in (None, html_extract.DEFAULT):
        got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(frame_, weights=weights).collect()}
        assert got[1].split("\n")[0] == plain
        assert got[2] == f"first one here\n{plain}\nsecond one here"
        assert got[3] == f"Short.\n{plain}\nEnd."
        assert got[4] == plain
    # The bonus is counted: nothing where the labelled pages' text stands outside, much where it stands inside.
    outside = html_extract.learn(frame_.filter("page_id = 1"))
    inside = html_extract.learn(frame_.filter("page_id = 4"))
    assert outside["in"] == 0 and inside["in"] == html_extract.LIMIT


def test_best_stretch():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.randint(-3, 3) for _ in range(rng.randint(0, 12))]
        begin, end = html_extract.best_stretch(scores)
        best = max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
        assert sum(scores[begin:end]) == best


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert license_scan.license_scan(none).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
