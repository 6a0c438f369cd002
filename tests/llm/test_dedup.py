"""Operators 1, 3 and 7 against brute force, on the awkward documents."""

import re

import numpy as np
import pytest
import xxhash

from codelake.llm import simhash, substring_dedup, suffix_dedup, textkit

WORD = re.compile(textkit.WORD)
LAST = textkit.NULL_ID


def _rows(docs):
    return [(LAST if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()]


def test_substring_dedup_against_brute_force(docs):
    rows = [(i, WORD.findall(t)) for i, t in _rows(docs)]
    least = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, LAST + 1), i)
    want = []
    for i, w in rows:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = True
        want.append((i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [(LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[2] for x in want) > 300
    got = [(LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs, one_hop=0).collect()]
    assert sorted(got) == sorted(want)  # through relays


@pytest.mark.parametrize("length", [64, 100])
def test_suffix_dedup_against_brute_force(docs, length):
    rows = [(i, t.encode()) for i, t in _rows(docs)]
    first = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, (LAST + 1, 0)), (i, k))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < (i, k):
                gone[k : k + length] = True
        gone = gone[: len(t)]
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        want.append((i, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    got = [(LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs, length=length, one_hop=0 if length == 64 else 1024).collect()]
    assert sorted(got) == sorted(want)


def test_blobs_arrive_through_relays_in_fewer_rows():
    groups = buckets = 400
    x = textkit.Exchange(groups, buckets)
    assert x.span is None and textkit.Exchange(2000, 6000).span == {"_key": 45, "_bucket": 78}
    x = textkit.Exchange(groups, buckets, one_hop=0)
    sent = [x.send(textkit.pack_rows([(b, k, bytes([b % 251, k % 251])) for b in range(buckets)]), "_bucket") for k in range(groups)]
    assert sum(len(t) for t in sent) == groups * 20
    cells: dict = {}
    for t in sent:
        for r in t.to_pylist():
            cells.setdefault((r["_bucket"], r["_key"] // 20), []).append((r["_bucket"], r["_key"], r["_data"]))
    relayed = [x._sorted(textkit.pack_rows(rows), "_bucket", "_key") for rows in cells.values()]
    assert sum(len(t) for t in relayed) == buckets * 20
    got = {(r["_bucket"], r["_key"]): r["_data"] for t in relayed for r in x.receive(t, "_bucket").to_pylist()}
    assert got == {(b, k): bytes([b % 251, k % 251]) for b in range(buckets) for k in range(groups)}


def test_suffix_dedup_of_long_and_repetitive_texts(spark):
    """A passage past 64 MiB, a text of one letter and a text of one line again and again."""
    rng = np.random.default_rng(9)
    passage = "".join(chr(97 + x) for x in rng.integers(0, 26, 300))
    long = rng.integers(97, 123, 70 << 20, dtype=np.uint8).tobytes().decode() + passage
    line = "".join(chr(97 + x) for x in rng.integers(0, 26, 130)) + "\n"
    rows = [(1, passage), (2, long), (3, "x" * 3_000_000), (4, line * 20_000), (5, "y" + "x" * 150)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert got == {1: (300, 0, 0), 2: (len(long), 300, 1), 3: (3_000_000, 2_999_999, 1), 4: (131 * 20_000, 131 * 19_999, 1), 5: (151, 150, 1)}


def test_suffix_array_and_prefixes_against_sorting():
    rng = np.random.default_rng(2)
    for n, symbols in [(1, 1), (2, 1), (7, 2), (60, 1), (200, 2), (300, 5), (400, 200)]:
        x = rng.integers(1, symbols + 1, n)
        t = np.r_[np.tile(x, 2), 0].astype(np.uint16)
        sa = suffix_dedup.suffix_array(t, 10_000)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sa.tolist() == want
        room = np.arange(len(t))[::-1].copy()
        lcp = suffix_dedup.common_prefixes(t, sa, room)
        for k in range(1, len(t)):
            a, b = t[want[k - 1] :], t[want[k] :]
            m = min(len(a), len(b)) - 1
            same = np.flatnonzero(a[:m] != b[:m])
            assert lcp[k] == (same[0] if len(same) else m)


def _fingerprint(text: str) -> int:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(marks: list[tuple[int, int]]) -> dict[int, int]:
    parent = {f: f for _, f in marks}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    fs = sorted(parent)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, f in marks:
        least[root(f)] = min(least.get(root(f), i), i)
    return {f: least[root(f)] for f in parent}


def test_simhash_against_brute_force(docs):
    marks = [(i, _fingerprint(t)) for i, t in _rows(docs) if i != LAST]
    known = docs.where("doc_id is not null")
    want = _components(marks)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(known).collect()]
    assert sorted(got) == sorted((i, format(f, "016x"), want[f]) for i, f in marks)


def test_links_of_large_signatures_lose_nothing():
    rng = np.random.default_rng(1)
    base = int(rng.integers(1, 2**62))
    near = {base}
    for _ in range(2500):  # over 561 fingerprints that share a signature
        x = base
        for b in rng.choice(32, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        near.add(x)
    fs = np.array(sorted(near), np.uint64)
    sig = np.full(len(fs), (base >> 32) & ~1, np.int64)
    got = simhash._links_of(sig, fs.view(np.int64), 2)
    pairs = {tuple(sorted(p)) for p in zip(got.column(0).to_pylist(), got.column(1).to_pylist())}
    want = {tuple(sorted((int(a), int(b)))) for i, a in enumerate(fs.view(np.int64)) for b in fs.view(np.int64)[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 2}
    assert pairs == want and len(fs) > 561


def _groups(texts: list[str]) -> list[int]:
    """The component of each text under a Jaccard similarity of five-word shingles of 0.8 or more, by all pairs."""
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark, docs):
    twice = docs.union(docs.where("doc_id is null")).union(docs.limit(5))  # repeated rows, rows without an id
    kept = simhash.keep_one(twice)
    assert kept.columns == docs.columns
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in twice.collect()))
    group = _groups([t for _, _, t in rows])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert len(got) == len(set(group))
    assert {group[rows.index(x)] for x in got} == set(group)
    assert [x[:2] for x in got] == sorted(rows[g][:2] for g in set(group))


def test_near_copies_at_the_threshold_are_found(spark):
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choice("bcdfghjkl") + r.choice("aeiou") for _ in range(3))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(r.randint(120, 400))]
        texts.append(base)
        for _ in range(4):  # one word in fifty is another
            texts.append([word() if k % 50 == r.randint(20, 30) else w for k, w in enumerate(base)])
        texts.append([word() if k % 12 == 5 else w for k, w in enumerate(base)])  # too many to be a near copy
    texts += [[w if i else word() for i, w in enumerate(texts[0])] for _ in range(300)]  # a large group of near copies
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    group = _groups([t for _, t in rows])
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert set(group) <= kept  # none is dropped without a near copy that stays
    copies = len(rows) - len(set(group))
    assert len(rows) - len(kept) >= 0.98 * copies and copies > 400
    assert simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), most_known=0).count() >= 0.98 * copies  # the other way to the texts


def test_no_near_copy_is_left_out(spark):
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("bcdfghjkl") + r.choice("aeiou") for _ in range(4))
    passage = [word() for _ in range(30)]  # in most texts
    texts = []
    for i in range(400):
        base = [word() for _ in range(94)] if i % 4 else [*passage, *(word() for _ in range(64))]
        texts += [base, [*base[:84], *(word() for _ in range(10))]]  # 80 shingles of 100: at the threshold
        if i % 10 == 0:
            texts.append([*base[:83], *(word() for _ in range(11))])  # under it
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    group = _groups([t for _, t in rows])
    assert len(set(group)) == 440
    assert {x.doc_id for x in simhash.keep_one(df).collect()} == set(group)
    assert simhash.near_copies(df, recall=0.1, most_known=0).count() == 400  # by joins, and after fingerprints that miss most; a component less its root


def test_pairs_of_one_shingle_join_components_only():
    import numpy as np

    r = np.random.default_rng(3)
    cls, n, root = np.arange(300), np.sort(r.integers(50, 100, 300)), r.integers(0, 40, 300)
    want = {(i, j) for i in range(300) for j in range(i) if root[i] != root[j] and n[j] >= 0.8 * n[i]}
    twice = np.repeat(np.arange(300), 2)  # a copy of each
    got = simhash._apart(np.zeros(600, np.int64), cls[twice], n[twice], root[twice], 0.8)
    assert {(y, x) for x, y in zip(*(c.to_pylist() for c in got.columns[:2]))} == want
    short = simhash._apart(np.repeat([1, 2], 40), np.tile(cls[:40], 2), np.tile(n[:40], 2), np.tile(root[:40], 2), 0.8)
    assert {(y, x) for x, y in zip(*(c.to_pylist() for c in short.columns[:2]))} == {p for p in want if max(p) < 40}
    assert set(short.column("_c").to_pylist()) == {2}  # both shingles
    assert simhash._apart(*[np.zeros(0, np.int64)] * 4, 0.8).num_rows == 0


def test_first_shingles_shared_reach_what_the_similarity_asks_for():
    import numpy as np

    r = np.random.default_rng(4)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _ in range(300):
        size, k = int(r.integers(1, 200)), int(r.integers(0, 12))
        x = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        y = np.unique(np.r_[x[r.random(len(x)) > r.random() / 5], r.integers(0, 2**63, k).astype(np.uint64)])
        same = len(np.intersect1d(x, y))
        if not len(y) or same < 0.8 * (len(x) + len(y) - same):
            continue
        shared = np.intersect1d(simhash._prefix(x, 0.8, *none), simhash._prefix(y, 0.8, *none))
        sig, n = np.repeat(shared.view(np.int64), 2), np.tile(np.sort([len(x), len(y)]), len(shared))
        got = simhash._apart(sig, np.tile([0, 1], len(shared)), n, np.tile([0, 1], len(shared)), 0.8)
        assert got.num_rows == 1 and got.column("_c")[0].as_py() == len(shared) >= got.column("_need")[0].as_py()


def test_a_pair_is_told_once_however_many_shingles_it_shares(spark):
    import pyarrow as pa

    r = np.random.default_rng(5)
    shared = r.integers(0, 2**63, 40).astype(np.uint64)
    lists = [np.unique(np.r_[shared, r.integers(0, 2**63, 5).astype(np.uint64)]) for _ in range(6)]  # 15 pairs of 40 shingles
    lists.append(np.unique(np.r_[shared[:3], r.integers(0, 2**63, 42).astype(np.uint64)]))  # too few of them
    rows = pa.table({"_cls": pa.array([*range(7), 0]), "_n": pa.array([200] * 8), "_own": pa.array([x.tobytes() for x in [*lists, lists[0]]], pa.binary()), "_root": pa.array([0, 0, 2, 3, 4, 5, 6, 0])})
    sent = pa.Table.from_batches(simhash._spread(rows.to_batches(), 7))
    got = []
    for b in range(7):
        own = sent.filter(pa.compute.equal(sent.column("_bucket"), b))
        if len(own):
            t = simhash._met(own, 7, 0.8)
            got += zip(t.column("_a").to_pylist(), t.column("_b").to_pylist())
    assert sorted(got) == [(i, j) for i in range(6) for j in range(i + 1, 6) if (i, j) != (0, 1)]


def test_bins_leave_no_pair_out_and_most_unlike_ones():
    r = np.random.default_rng(7)
    kept = 0
    for k in range(400):
        x = r.integers(0, 2**63, int(r.integers(100, 400))).astype(np.uint64)
        y = np.r_[x[r.random(len(x)) > (0.05 if k % 2 else 0.15)], r.integers(0, 2**63, len(x) // (20 if k % 2 else 7)).astype(np.uint64)]
        same = len(np.intersect1d(x, y))
        ok = bool(simhash._possible(simhash._bins(x)[None], simhash._bins(y)[None], 0.8)[0])
        assert ok or same < 0.8 * (len(x) + len(y) - same)
        kept += ok and not k % 2  # similarities of three quarters
    assert kept < 60
    x = r.integers(0, 2**63, 200_000).astype(np.uint64)  # bins are full
    assert simhash._possible(simhash._bins(x)[None], simhash._bins(x[:170_000])[None], 0.8)[0]


def test_halves_meet_as_all_variants_do():
    import pyarrow as pa

    r = np.random.default_rng(9)
    for bits, segments in ((16, 4), (17, 3)):
        base = r.integers(0, 256, (40, 16)).astype(np.uint8)
        fp = np.concatenate([base, *(base ^ np.packbits(r.random((40, 128)) < p, axis=1) for p in (0.02, 0.05, 0.1)), *[base[:1]] * 3])  # the last make a large group
        fp = np.concatenate([fp, np.repeat(base[:1], 30, axis=0) ^ np.packbits(r.random((30, 128)) < 0.01, axis=1)])
        cls, rows = np.arange(len(fp)), pa.array([x.tobytes() + bytes(simhash._BINS) for x in fp], pa.binary())
        sent = [*simhash._halves([pa.record_batch([pa.array(cls), rows], names=["_cls", "_fp"])], bits, segments)]
        assert sum(b.num_rows for b in sent) == 2 * segments * len(fp)  # not bits * segments
        t = pa.Table.from_batches(sent).sort_by("_key")
        got = {(a, b) for x in simhash._by_half(t.to_batches(max_chunksize=50), bits, 20) for a, b in zip(*(c.to_pylist() for c in x.columns))}
        near, one, want = fp[:, :8].copy().view(np.int64).ravel(), np.unpackbits(fp, axis=1, bitorder="little"), set()
        for k in range(segments):
            own = one[:, k * bits : (k + 1) * bits].astype(np.int64) @ (1 << np.arange(bits))
            for i in range(bits):
                sig = own & ~(1 << i)
                order = np.lexsort((cls, near, sig))
                x = simhash._candidates_of(sig[order], cls[order], near[order], 20)
                want |= set(zip(*(c.to_pylist() for c in x.columns)))
        assert got == want and len(want) > 60


def test_what_is_sent_of_a_text_for_a_shared_shingle_is_bounded_and_loses_no_pair():
    import pyarrow as pa

    r = np.random.default_rng(10)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    passage, sets = r.integers(0, 2**63, 40).astype(np.uint64), []
    for k in range(60):
        x = r.integers(0, 2**63, int(r.integers(20, 3000))).astype(np.uint64)
        sets += [np.unique(np.r_[x, passage])] + [np.unique(np.r_[x[int(len(x) * p) :], passage, r.integers(0, 2**63, int(len(x) * q)).astype(np.uint64)]) for p, q in ((0.02, 0.15), (0.1, 0.08), (0.2, 0), (0, 0.24), (0.2, 0.3))]
    first = [simhash._prefix(x, 0.8, *none) for x in sets]
    many, cls = [len(x) for x in first], np.repeat(np.arange(len(sets)), [len(x) for x in first])
    sig, n = np.concatenate(first).view(np.int64), np.array([len(x) for x in sets])
    place = n[cls] << 32 | np.concatenate([np.arange(k) for k in many])
    own = simhash._useful(sig, cls, place, cls, 0.8)
    assert len(own) == len(simhash._useful(*(np.repeat(x, 2) for x in (sig, cls, place, cls)), 0.8))  # a copy of each
    bins = simhash._fewer(np.stack([simhash._bins(x) for x in sets])[cls[own]], place[own] >> 32)
    assert max(map(len, bins)) == 256 and max(many) > 500
    t = pa.table({"_sig": sig[own], "_cls": cls[own], "_place": place[own], "_root": cls[own], "_bins": pa.array(bins, pa.binary())}).sort_by("_sig")
    got = [(a, b) for x in simhash._shared(t.to_batches(max_chunksize=100), 0.8) for a, b in zip(*(c.to_pylist() for c in x.columns))]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) and (same := len(np.intersect1d(sets[i], sets[j], assume_unique=True))) >= 0.8 * (n[i] + n[j] - same)}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 150 and len(got) < 4 * len(want)
    one = np.zeros(70, np.int64), np.arange(70), np.full(70, (100 << 32) + 15)  # too late in each, but more rows than are compared here
    assert len(simhash._useful(*one, np.arange(70), 0.8)) == 70 and not len(simhash._useful(*one, np.zeros(70, np.int64), 0.8)) and not len(simhash._useful(*one, np.arange(70), 0.8, most=100))


def test_empty_tables(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns
