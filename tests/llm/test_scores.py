"""Operators 4, 6 and 9: counts against brute force, models by what they learn."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codelake.llm import attention, attention_lm, boosting, quality_gam, quality_rules, textkit

WORD = re.compile(textkit.WORD)


def _base(text: str) -> tuple:
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def _repeats(w: list[str], least: int) -> tuple[int, int]:
    """(words covered by repeated sequences of `least` words or more, the longest), by comparing all suffixes."""
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    cover = {j for i, k in enumerate(best) if k >= least for j in range(i, i + k)}
    return len(cover), max((k for k in best if k >= least), default=0)


def test_quality_rules_against_brute_force(spark, docs):
    got = {}
    for r in quality_rules.quality_rules(docs.withColumn("doc_id", docs["`a.b`"])).collect():
        got[r.doc_id] = r
    for r in docs.collect():
        g = got[r["a.b"]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == _base(r.text or "")
        w = WORD.findall(r.text or "")
        if len(w) < 200:
            assert (g.covered_words, g.longest_repeat) == _repeats(w, 3)
        assert g.kept == (not g.base_failed and g.covered_words <= 0.4 * g.n_words and g.longest_repeat <= 50)


def _judged(text: str) -> bool:
    """The verdict by brute force."""
    w = WORD.findall(text)
    if _base(text)[-1]:
        return False
    at: dict = {}
    for i in range(len(w) - 50):
        at.setdefault(tuple(w[i : i + 51]), []).append(i)
    cover = set()
    short: dict = {}
    for i in range(len(w) - 2):
        short.setdefault(tuple(w[i : i + 3]), []).append(i)
    for v in short.values():
        cover |= {j for i in v for j in range(i, i + 3) if len(v) > 1}
    return len(cover) <= 0.4 * len(w) and not any(len(v) > 1 for v in at.values())


def test_quality_verdict_turns_away_what_the_base_rule_keeps(spark):
    own = [f"w{i}" for i in range(2000)]
    texts = {
        1: " ".join(w for w in own[:10] for _ in range(5)),  # no five-word window twice, nothing but repeats
        2: " ".join([*own, *own[100:151]]),  # 51 words pasted again into 2,000
        3: " ".join([*own, *own[100:150]]),
        4: " ".join([*own[:8], *own[20:150], *own[:8]]),  # ends as it begins
        5: " ".join(own[:300]),
    }
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert {i: r.kept for i, r in got.items()} == {i: _judged(t) for i, t in texts.items()} == {1: False, 2: False, 3: True, 4: True, 5: True}
    assert not any(r.base_failed for r in got.values())


def test_quality_verdict_on_the_test_table(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: r.kept for r in quality_rules.op9(spark, d).collect()} == {i: _judged(t) for i, t in rows.items()}


def test_quality_rules_on_repetitive_batches():
    rng = np.random.default_rng(5)
    for _ in range(30):
        rows = [rng.integers(0, rng.integers(1, 4) + 1, rng.integers(0, 60)) for _ in range(4)]
        h = np.concatenate(rows).astype(np.uint64) + np.uint64(9)
        row = np.repeat(np.arange(4), [len(x) for x in rows])
        got = quality_rules.repeats(h, row)
        want = []
        for x in rows:
            w = [str(v) for v in x]
            for i in range(len(w)):
                best = 0
                for j in range(len(w)):
                    k = 0
                    while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best if best >= 4 else 0)
        assert np.where(got >= 4, got, 0).tolist() == want


def test_keep_good_keeps_rows_whole(docs, empty):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["a.b"] for r in kept.collect()} == {r["a.b"] for r in docs.collect() if _judged(r.text or "")}
    assert quality_rules.keep_good(empty).count() == 0


def test_gam_learns_singles_and_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5) | (x[:, 2] > 0.9)).astype(float)
    model = boosting.PairwiseGam().fit(x[:3000], y[:3000])
    p = model.score(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.93
    assert (0, 1) in model.pairs


def test_quality_scores(spark, docs, empty):
    frame = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    labels = spark.createDataFrame([(r.doc_id, 0 if _base(r.text or "")[-1] else 1, "x") for r in frame.collect()] + [(None, 1, "x"), (10**9, 0, "x"), (5, None, "x")], "doc_id long, quality int, text string")
    got = quality_gam.quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert {r.score for r in quality_gam.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_gam.quality_scores(empty, labels).count() == 0


def test_training_rows_are_bounded_when_ids_repeat(spark, docs):
    one = docs.where("doc_id is not null and text is not null").limit(1)
    import zlib as z

    trained = next(i for i in range(100) if z.crc32(str(i).encode()) % 5)
    many = spark.range(500).selectExpr(f"{trained}L as doc_id", "concat('some text ', id) as text")
    labels = spark.createDataFrame([(trained, q % 2) for q in range(50)], "doc_id long, quality int")
    seen = []
    fit = boosting.PairwiseGam.fit
    boosting.PairwiseGam.fit = lambda self, x, y, *a, **k: (seen.append(len(x)), fit(self, x, y, *a, **k))[1]
    try:
        assert quality_gam.quality_scores(many.union(one.select("doc_id", "text")), labels, max_train=20).count() == 501
    finally:
        boosting.PairwiseGam.fit = fit
    assert seen and seen[0] <= 20


def test_held_out_quality_on_the_test_table(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality_gam.op4(spark, d).collect()}
    rows = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    held = [(r.score, q) for r, q in rows if r.held_out]
    wins = [(a > b) + 0.5 * (a == b) for a, q in held for b, p in held if q == 1 and p == 0]
    assert sum(wins) / len(wins) > 0.95


def test_attention_gradients_and_causality():
    rng = np.random.default_rng(0)
    m = attention.Model(30, members=8, width=4, hidden=6)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids = np.r_[rng.integers(4, 30, 70), 2, rng.integers(4, 30, 20), 2]
    x, target, place = attention.windows_of(ids, np.array([71, 21]))
    assert (target.ravel()[place] == ids).all() and (target > 0).sum() == len(ids)
    _, g = m.step(x, target)
    for k in m.p:
        i = tuple(int(ids[3]) if k in "ET" and a == 0 else int(rng.integers(0, s)) for a, s in enumerate(m.p[k].shape))
        old = m.p[k][i]
        m.p[k][i] = old + 1e-4
        up, _ = m.step(x, target)
        m.p[k][i] = old - 1e-4
        down, _ = m.step(x, target)
        m.p[k][i] = old
        assert abs((up - down) / 2e-4 - g[k][i]) < 1e-5
    before = m.log_probs(x, target).ravel()[place]
    ids[60] = 5 if ids[60] != 5 else 6
    x, target, place = attention.windows_of(ids, np.array([71, 21]))
    after = m.log_probs(x, target).ravel()[place]
    assert np.allclose(before[:60], after[:60]) and np.allclose(before[71:], after[71:])  # nothing sees what comes later, or another text
    assert not np.allclose(before[61:66], after[61:66])


def test_attention_learns():
    ids = np.r_[np.tile([4, 5, 6, 7, 8], 600), 2]
    x, target, _ = attention.windows_of(ids, np.array([len(ids)]))
    m = attention.Model(20, members=5)
    m.fit(x, target, 20, batch=16)
    assert m.log_probs(x, target)[5:-1].mean() > -0.1


@pytest.mark.filterwarnings("ignore")
def test_lm_scores_against_brute_force(docs, empty):
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")) for r in known.collect()}
    trained = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in trained for w in [*texts[i], None])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in attention_lm.lm_scores(known, least_mb=0.05).collect()}
    assert got.keys() == texts.keys()
    for i, w in texts.items():
        own = [*w, None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in trained, len(own), sum(c[x] > 0 for x in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in own), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score) and math.isfinite(r.attention_score)
    assert attention_lm.lm_scores(empty).count() == 0
    again = known.limit(1).select("doc_id", "text")  # null and repeated ids are rows like any other
    odd = again.union(again).union(again.selectExpr("cast(null as long)", "text")).union(again.selectExpr("cast(null as long)", "text"))
    got = attention_lm.lm_scores(odd, least_mb=0.01, one_hop=0).collect()
    assert len({r.score for r in got}) == 1 and len({r.n_known for r in got}) == 1
    assert len(got) == 4 and sum(r.held_out for r in got if r.doc_id is None) == 0


def test_lm_beats_word_counts_on_texts_it_has_not_seen(spark):
    got = [r for r in attention_lm.op6(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    n = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / n > sum(r.base_score for r in got) / n + 0.01


def test_lm_scores_follow_the_order_of_words(spark):
    import random

    r = random.Random(1)
    pairs = [(f"{a}ort", f"{b}ale") for a in "bcdfghm" for b in "npqrstv"]
    text = lambda: " ".join(w for _ in range(30) for w in r.choice(pairs))
    df = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    turned = spark.createDataFrame([(1000, " ".join(w for _ in range(30) for w in r.choice(pairs)[::-1]))], "doc_id long, text string")
    got = {x.doc_id: x for x in attention_lm.lm_scores(df.union(turned), least_mb=1).collect()}
    same = [x.score / x.n_tokens for i, x in got.items() if i < 1000]
    assert min(same) > got[1000].score / got[1000].n_tokens  # word counts alone would not tell them apart


def test_trained_runs_grow_with_the_texts():
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(20_000))
    batch = pa.record_batch([pa.array(range(40), pa.int64()), pa.array([text] * 40)], names=["_id", "_text"])
    runs = lambda b, share: sum(len(x.as_py()) for y in attention_lm._runs([b], share, 4, attention_lm.TOKENIZER) for x in y.column("_ids"))
    whole = runs(batch, 1.0)
    ids, n = attention_lm.pieces_of(text.encode().split(), attention_lm.TOKENIZER)
    assert whole == 4 * 40 * (len(ids) + 1)  # every word once, and the ends
    assert 0.2 < runs(batch, 0.25) / whole < 0.3
    assert 0.4 < runs(batch.slice(0, 20), 0.25) / runs(batch, 0.25) < 0.6


def test_subwords_spell_their_words():
    words = ["the".encode(), b"x", "naïve".encode(), b"a.b@c", "日本".encode(), "a b".encode(), b"'ll", b"123", b"--"]
    ids, n = attention_lm.pieces_of(words, attention_lm.TOKENIZER)
    e = attention_lm._encoder(attention_lm.TOKENIZER)
    at = 0
    for w, k in zip(words, n):
        own = ids[at : at + k]
        assert e.decode_bytes([int(x) // 2 for x in own]) == b" " + w and [int(x) % 2 for x in own] == [0] * (k - 1) + [1]
        at += k


def test_the_language_model_learns_from_every_text(spark, monkeypatch):
    import pyarrow as pa

    from codelake.llm import attention_lm as lm

    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(words[i::4]) for i in range(4)] + ["", " "]
    asked = {}

    def train(df, n_bytes, path, vocabulary, share, least_mb, part_mb, rounds, rate):
        asked["share"] = share
        return lm.Scorer(path, vocabulary)

    monkeypatch.setattr(lm, "train", train)
    lm.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], names=["_id", "_text"])
    runs = [np.frombuffer(x, np.int32) for b in lm._runs([batch], asked["share"], 3, lm.TOKENIZER) for x in b.column("_ids").to_pylist()]
    ids = np.concatenate(runs)
    assert (ids >= 0).sum() == sum(len(lm.pieces_of(lm.words_of(t.encode()), lm.TOKENIZER)[0]) for t in texts)
    assert (ids[ids >= 0] % 2).sum() == len(words)  # each word ends once


def test_sealed_runs_open_as_they_were_in_few_bytes():
    import numpy as np

    from codelake.llm import attention_lm as lm

    r = np.random.default_rng(1)
    runs = [np.append(np.minimum(r.zipf(1.2, int(r.integers(1, 300))), 100_000), -1).astype(np.int32) for _ in range(400)]
    data = lm._sealed(runs)
    assert [x.tolist() for x in lm._opened(data)] == [x.tolist() for x in runs]
    assert len(data) < 2.5 * sum(map(len, runs))  # four bytes an id before
    assert lm._opened(lm._sealed([])) == []


def test_a_pass_moves_the_model_as_plain_adam_does_without_its_steps(monkeypatch):
    rng = np.random.default_rng(3)
    ids = np.r_[rng.integers(4, 30, 900), 2, rng.integers(4, 30, 5), 2, 2].astype(np.int32)
    x, target, _ = attention.windows_of(ids, np.array([901, 6, 1]))
    new, plain = (attention.Model(30, members=8, width=4, hidden=6) for _ in range(2))
    assert (new.off < 0).any()  # the last class lacks members
    step, losses = attention.Model.step, []
    first, second = ({k: np.zeros(v.shape) for k, v in plain.p.items()} for _ in range(2))
    for i in range(1, -(-len(x) // 16) + 1):
        own = slice((i - 1) * 16, i * 16)
        loss, g = step(plain, x[own], target[own])
        losses.append(loss)
        rate = (0.01 + (0.005 - 0.01) * i / -(-len(x) // 16)) * min(1, i / 10)
        for k, d in g.items():
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            plain.p[k] = (plain.p[k] - rate * first[k] / (1 - 0.9**i) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    calls = []
    monkeypatch.setattr(attention.Model, "step", lambda *a: calls.append(1) or step(*a))
    assert np.allclose(new.descend(x, target, 16, 0.01, 0.005), losses, atol=1e-4)
    assert not calls  # its whole-array steps cost too much
    for k, v in plain.p.items():
        assert new.p[k].shape == v.shape and new.p[k].dtype == np.float32 and np.quantile(abs(new.p[k] - v), 0.99) < 1e-3, k
    new.p["c"][:, 0] += 1000  # too large for exp without the maximum
    assert np.isfinite(new.descend(x, target, 16, 0.001, 0.001)).all() and calls
    assert all(np.isfinite(v).all() for v in new.p.values())


def test_log_probs_add_up_to_one():
    rng = np.random.default_rng(4)
    ids = np.r_[rng.integers(4, 30, 200), 2].astype(np.int32)
    x, target, _ = attention.windows_of(ids, np.array([201]))
    m = attention.Model(30, members=8, width=4, hidden=6)
    m.begin(np.arange(30) % 2, rng.integers(0, 9, (2, 30)).astype(float))
    every = np.stack([m.log_probs(x, np.full(target.shape, i, np.int32)) for i in range(30)])
    assert np.allclose(np.exp(every.astype(float)).sum(0), 1, atol=1e-4)


def test_a_pass_uses_its_memory_again():
    import resource

    if not attention.keep_room():
        pytest.skip("not glibc")
    ids = np.append(np.random.default_rng(5).integers(4, 1600, 64 * 24 * 20 - 1), 2).astype(np.int32)
    x, target, _ = attention.windows_of(ids, np.array([len(ids)]))
    m = attention.Model(1600)
    m.descend(x, target, 64, 0.01, 0.01)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    m.descend(x, target, 64, 0.01, 0.01)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 200 * 20  # page faults; 860 a step before
