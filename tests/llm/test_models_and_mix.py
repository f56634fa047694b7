"""Token files, quality classifier, source mix and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linewatch.llm import mixing, quality, token_files
from linewatch.session import working_path
from tests.llm.corpus import SCHEMA, awkward, frame, random_rows

CASES = [awkward(), random_rows(6)]


def library():
    return Tokenizer.from_file(token_files.tokenizer_path())


@pytest.mark.parametrize("case", range(2))
def test_token_round_trip(spark, case):
    rows = CASES[case]
    coder = library()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, start = [], 0
    for i, text, *_ in ordered:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.encode_documents(frame(spark, rows, clash=True))
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == [(s, i, n, c) for i, s, n, c in want]


def test_selective_reads(spark):
    rows = [r for r in CASES[1]]
    path = token_files.write_tokens(frame(spark, rows), working_path(spark, "tokens"), page=1024)
    back = token_files.read_tokens(spark, path)
    coder = library()
    for r in back.collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"])
        assert coder.decode(r["ids"][:-1], skip_special_tokens=False) == text and r["ids"][-1] == 0 and len(r["ids"]) == r["n_tokens"]
    some = back.filter("doc_id = 7").select("n_tokens", "start")
    assert some.count() == 1
    plan = spark.read.parquet(path).filter("doc_id = 7").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_strings_of_added_tokens():
    """The library's default: such a string is the token, wherever it stands."""
    coder, plain = _coder(), _plain()
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added
    for a in added:
        texts = [f"a {a} b", a, f"x{a}y", f"one {a[:-1]} two", f"{a}{a}\n{a}", "a b"]
        assert [g.tolist() for g in coder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'Sst é1!…,.\n\t  　\x0b\x1c᠎​ <|endoftext|>"), max_size=30), max_size=4))
def test_remembered_words_give_the_librarys_ids(texts):
    coder, plain = _coder(), _plain()
    for _ in range(2):
        got = coder.encode(texts)
        assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


class Counted(dict):
    """A dictionary that counts lookups."""

    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)


def test_a_repeated_word_is_looked_up_once():
    coder, plain = token_files.Encoder(token_files.tokenizer_path()), _plain()
    coder.known = Counted()
    texts = ["the cat sat on the mat and the dog, " * 40 + "end.", "the cat\nthe dog " * 50 + "x", "", "one  two"] * 3
    assert [g.tolist() for g in coder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < coder.known.asked < 50


def test_words_in_use_stay_remembered():
    coder, learnt = token_files.Encoder(token_files.tokenizer_path(), limit=60), []
    learn = coder._learn
    coder._learn = lambda pieces, *rest: (learnt.extend(pieces), learn(pieces, *rest))[1]
    for i in range(12):
        coder.encode(["a frequent word " + " ".join(f"{'abcdefghijkl'[i]}{'mnopqrstuvwxyz'[j]}" for j in range(14))])
    assert sum(p in (b"frequent", "frequent") for p in learnt) == 1


def test_damaged_bytes_are_encoded_with_replacement_characters():
    texts = token_files._texts(pa.array([b"a b", b"c \xff d", "é ü".encode()]))
    plain = _plain()
    (lengths, ids), = _coder().encoded(texts, room=1)
    want = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in ("a b", "c \ufffd d", "é ü")]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


_made: dict = {}


def _coder():
    return _made.setdefault("coder", None) or _made.update(coder=token_files.Encoder(token_files.tokenizer_path(), limit=50)) or _made["coder"]


def _plain():
    return _made.setdefault("plain", None) or _made.update(plain=library()) or _made["plain"]


def labelled(seed=1, n=600):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        source = rng.choice(["a", "a", "b", "c", None])
        bad = rng.random() < (0.6 if source == "c" else 0.1)
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(rng.randint(5, 80))]
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, rng.choice(["en", None]), source, len(text)))
        if rng.random() < 0.5:
            labels.append((i, int(not bad), 0))
    truth = {i: "!!" not in t for i, t, *_ in rows}
    return rows, labels, truth


def test_quality_holds_on_held_out_rows(spark):
    rows, labels, truth = labelled()
    made = quality.posteriors(frame(spark, rows, clash=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r["i"]: r for r in made.selectExpr("_doc.doc_id as i", "score", "host_rate", "path_rate", "evidence", "_doc.source as s").collect()}
    held = set(truth) - {i for i, *_ in labels}
    assert np.mean([(found[i]["score"] >= 0.5) == truth[i] for i in held]) >= 0.98
    rates = {r["s"]: r["host_rate"] for r in found.values()}
    assert rates["c"] < rates["a"] - 0.2
    kept = quality.accepted(frame(spark, rows, clash=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == frame(spark, rows, clash=True).columns
    assert kept.count() == sum(r["score"] >= 0.5 for r in found.values())


def test_posterior_formula(spark):
    """Rates and scores restated from the evidence: two levels of shrinkage, each document's own share taken out."""
    rows, labels, _ = labelled(2)
    made = quality.posteriors(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = [r.asDict() for r in made.selectExpr("evidence", "host_rate", "path_rate", "score", "_doc.source as s", "_doc.lang as l").collect()]
    y = [q for _, q, _ in labels]
    rate0 = (sum(y) + 1) / (len(y) + 2)
    for r in found:
        r["p"] = 1 / (1 + math.exp(-(r["evidence"] + math.log(rate0 / (1 - rate0)))))
    rate = np.mean([r["p"] for r in found])

    def strength(groups, parent):
        seen = sum(len(g) * (np.mean(g) - parent[k]) ** 2 for k, g in groups.items())
        noise = sum(parent[k] * (1 - parent[k]) for k in groups)
        full = sum(len(g) * parent[k] * (1 - parent[k]) for k, g in groups.items())
        return min(max(full / (seen - noise) - 1, 1.0), 1e6) if seen > noise else 1e6

    hosts, paths = defaultdict(list), defaultdict(list)
    for r in found:
        hosts[r["s"]].append(r["p"])
        paths[r["s"], r["l"]].append(r["p"])
    m = strength(hosts, {k: rate for k in hosts})
    host = {k: (sum(g) + m * rate) / (len(g) + m) for k, g in hosts.items()}
    n = strength(paths, {k: host[k[0]] for k in paths})
    for r in found:
        g = paths[r["s"], r["l"]]
        path = (sum(g) - r["p"] + n * host[r["s"]]) / (len(g) - 1 + n)
        assert r["host_rate"] == pytest.approx(host[r["s"]]) and r["path_rate"] == pytest.approx(path)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(r["evidence"] + math.log(path / (1 - path))))), rel=1e-6)


def test_quality_without_evidence(spark):
    docs = frame(spark, awkward(), clash=True)
    for labels in ([], [(6, 1, 0)], [(6, 1, 0), (None, 0, 0), (7, None, None)]):
        made = quality.posteriors(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        scores = [r["score"] for r in made.collect()]
        assert len(scores) == len(awkward()) and all(0 <= s <= 1 for s in scores)
    none = spark.createDataFrame([], SCHEMA)
    assert quality.posteriors(none, spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_water_fill():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 12)
        sizes = [rng.choice([0, rng.randint(0, 50), rng.randint(0, 5000)]) for _ in range(n)]
        weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(n)]
        got = mixing.water_fill(sizes, weights, 1.5 * sum(sizes), 2.0)
        assert sum(got) == pytest.approx(1.5 * sum(sizes))
        assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))
        level = [t / w for t, s, w in zip(got, sizes, weights) if t < 2 * s - 1e-9]
        assert not level or max(level) == pytest.approx(min(level))
        assert all(t / w <= min(level) + 1e-9 for t, w in zip(got, weights) if level)


def test_permutation():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        for seed in range(3):
            assert sorted(mixing.permuted(np.arange(n), n, seed).tolist()) == list(range(n))


@pytest.mark.parametrize("case", range(2))
@pytest.mark.parametrize("block", [1, 7, 64])
def test_mix_is_what_its_slots_say(spark, case, block):
    rows = CASES[case]
    docs = frame(spark, rows, clash=True)
    made = mixing.mix(docs, block=block, shard_slots=8)
    slots = [r.asDict() for r in made.slots.collect()]
    placed = [r.asDict() for r in made.rows.collect()]
    assert len(placed) == len(rows)
    size = {p.place: p.size for p in made.plans}
    # Documents of a source lie end to end.
    for place, total in size.items():
        at = 0
        for r in sorted((r for r in placed if r["_place"] == place), key=lambda r: (r["_begin"], r["_size"])):
            assert r["_begin"] == at
            at += r["_size"]
        assert at == total
    # Every shard is full but the last, no slot twice, and sources have the words of their targets.
    assert len({(s["shard"], s["slot"]) for s in slots}) == len(slots) == sum(p.slots for p in made.plans)
    assert all(n == 8 for k, n in Counter(s["shard"] for s in slots).items() if k < max(s_["shard"] for s_ in slots))
    words = Counter()
    for s in slots:
        words[s["_place"]] += s["_words"]
    for p in made.plans:
        assert words[p.place] == p.words and abs(p.words - p.target) <= 1
    assert len({(s["_place"], s["_pass"], s["_block"]) for s in slots}) == len(slots)
    # Words taken per document, counted one by one.
    use = defaultdict(Counter)
    for s in slots:
        for w in range(s["_block"] * block, s["_block"] * block + s["_words"]):
            use[s["_place"]][w] += 1
    want = sorted((str(r["_id"]), r["_size"], sum(use[r["_place"]][w] for w in range(r["_begin"], r["_begin"] + r["_size"]))) for r in placed)
    got = mixing.mixed_words(docs, block=block, shard_slots=8).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == want
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    sizes = [len([w for w in (t or "").encode().split()]) for _, t, *_ in rows]
    assert sorted(r["size"] for r in got) == sorted(sizes)


def test_mix_agrees_between_runs_and_layouts(spark):
    docs = frame(spark, CASES[1])
    first = sorted(map(tuple, mixing.mixed_words(docs).collect()))
    assert first == sorted(map(tuple, mixing.mixed_words(docs.repartition(7, "lang")).collect()))
    assert mixing.mixed_words(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("case", range(2))
def test_mixed_documents(spark, case):
    docs = frame(spark, CASES[case], clash=True)
    made = mixing.mixed_documents(docs, length_col="n_chars", block=5)
    assert made.columns == docs.columns
    words = {}
    for i, text, *_ in CASES[case]:
        words.setdefault(i, Counter()).update((text or "").encode().split())
    taken = Counter()
    for r in made.collect():
        assert r["n_chars"] == len(r["text"])
        assert not Counter(r["text"].encode().split()) - words[r["doc_id"]]
        taken[r["doc_id"]] += len(r["text"].encode().split())
    want = Counter()
    for r in mixing.mixed_words(docs, block=5).collect():
        want[r["doc_id"]] += r["taken"]
    assert sum(taken.values()) == sum(want.values())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels, _ = labelled(3, 200)
    rows += [(1000 + i, t, l, s, n) for i, (_, t, l, s, n) in enumerate(awkward())] + [(2000, " ".join(f"leak{i}" for i in range(12)), "en", "a", 1)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"leak{i}" for i in range(11)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns
        path = working_path(spark, name)
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name == "decontamination":
            assert docs.filter("doc_id = 2000").count() == 0
    assert counts[0] > counts[1] > counts[2] > counts[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]


def test_every_stage_keeps_batches_small(spark, monkeypatch):
    import corpus_pipeline
    from linewatch.llm.common import arrow_map

    own = spark.newSession()
    batch, read = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    docs = own.range(0, 8, 1, 1).selectExpr("id as doc_id", "repeat('a', 1000000) as text")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    for module, name in (
        (corpus_pipeline.quality, "accepted"), (corpus_pipeline.simhash, "keep_one"), (corpus_pipeline.decontaminate, "without_contaminated"),
        (corpus_pipeline.mixing, "mixed_documents"), (corpus_pipeline.token_files, "encode_documents"),
    ):
        monkeypatch.setattr(module, name, lambda docs, *_, **__: arrow_map(docs, lambda: sizes, "bytes long"))

    def sizes(rows):
        return pa.RecordBatch.from_arrays([pa.array([sum(len(t) for t in rows.column(1).to_pylist())])], ["bytes"])

    for name, stage in corpus_pipeline.STAGES:
        own.conf.unset(batch)
        own.conf.unset(read)
        found = [r["bytes"] for r in stage(own, docs, "").collect()]
        assert sum(found) == 8_000_000, name
        assert max(found) <= corpus_pipeline.BATCH_BYTES + 1_000_000, name
        assert int(own.conf.get(read)) <= 1024, name
        own.conf.set(batch, "1m")
        own.conf.set(read, "100")
        stage(own, docs, "")
        assert (own.conf.get(batch), own.conf.get(read)) == ("1m", "100"), name  # smaller wishes stay


def test_measuring_frees_what_others_left():
    from linewatch.llm.common import release_stores, worker_store

    worker_store("encoders")["words"] = [0] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0], pa.int32()), pa.array([b"one two"])], ["i", "y", "t"])
    (found,) = quality.measured(iter([batch]))
    assert found.column(2).to_pylist() == [quality.measures(b"one two")]
    assert not worker_store("encoders")
    release_stores()


def test_targets_need_no_python_workers(spark):
    plans = mixing.plan_targets([("b", 10), (None, 7), ("a", 0)])
    made = mixing.target_table(spark, plans)
    assert [tuple(r) for r in made.collect()] == [(p.source, p.place, p.size, p.target) for p in plans]
    assert "ExistingRDD" not in made._jdf.queryExecution().executedPlan().toString()
    assert mixing.target_table(spark, []).count() == 0
