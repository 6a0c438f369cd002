"""SimHash near-dedup by deletion-variant signatures.

A fingerprint is the majority of each bit over the XXH64 (seed 42) of all three-word shingles. Two
fingerprints with `bits` = 2 or fewer differing bits, cut into two halves, differ by at most one bit in one of
them. So each half is indexed 32 times, each time with another bit wildcarded: fingerprints that share a
signature (half, wildcarded bit, the other 31 bits) are candidates, an equality join. They are verified
by counting all differing bits. Equal fingerprints are one class from the start, so copies cost nothing.

Within a signature, up to 561 fingerprints are compared with each other; in a larger one each fingerprint
looks up its 33 + 528 neighbours in the 33 free bits, so links grow with the members, not with their square.
Classes are joined to components by alternating stars over the links, with a checkpoint each round.

`near_copies` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. At that
similarity a bit differs with a probability of about 0.15, far more than two of 64. So fingerprints are longer and cut
into segments that each differ by at most one bit often enough (`_shape`): segments have a bit less than the
logarithm of the number of rows, so that unlike texts rarely meet, and there are so many of them that a pair at 0.8 shares a one-wildcard
variant with a probability of `recall`. Only the segments' halves are sent, and the variants made where they meet. Who shares one is compared by 64 bits of the fingerprint; of a small group all near
pairs are taken, of a larger one the least spanning tree, which leaves a path of nearer pairs for each
pair that it leaves out. Pairs taken are compared by the whole fingerprint, and the rest verified on the texts by their exact similarity.

Fingerprints miss a pair now and then, and a tree may rest on a pair that the texts do not bear out. So `_rest` joins what these links
leave apart, exactly: two sets of similarity 0.8 share one of the first shingles of either, a fifth of them, in any one order of all
shingles. Of texts that are alike, the first shingle that both have stands so early in either that the rest can still be as alike. So a first pass
finds the shingles that may be this for texts of different components; a second sends each of them with its text's counts of shingles in a few
bins, at most 256, whatever the text's length. Texts that are not yet in one component and that neither the place nor the counts exclude are candidates; they
are compared by counts in 256 bins and verified on the texts.
Frequent shingles come last in the order; only this order is from a sample.

Defined cases: null text has no words; no words: fingerprint zero, linked like any other; fewer words than a shingle has: the
whole sequence is the one shingle; null ids come after all others; rows without an id or that share one are rows like others; columns other than the two
named are ignored (in `keep_one` kept as they are), whatever their names. Texts count as the same words if 64 hash bits agree.
"""

from __future__ import annotations

import gc
import math
import os
import tempfile
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textkit as tk
from .textkit import U

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HASH = xxhash.xxh64_intdigest


def fingerprint(text: bytes) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < 4:
        return _HASH(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    hashes = [_HASH(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[2:])]
    ones = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _fp): the fingerprint as a signed long. No shuffle."""
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for x in tk.pieces(batches, "_text"):
            fp = np.array([fingerprint(t) for t in tk.texts_of(x.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(fp)], names=["_id", "_fp"])

    return texts.mapInArrow(run, "_id long, _fp long")


def _signatures(batches):
    for x in batches:
        fp = x.column(0).to_numpy()
        u = fp.view(np.uint64)
        sig = []
        for side, half in enumerate((u >> U(32), u & U(0xFFFFFFFF))):
            for bit in range(32):
                sig.append(half & U(0xFFFFFFFF ^ 1 << bit) | U(bit << 32 | side << 37))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.tile(fp, 64))], names=["_sig", "_fp"])


def _links_of(sig: np.ndarray, fp: np.ndarray, bits: int):
    """Pairs of linked fingerprints (smaller first) among rows sorted by signature."""
    u = fp.view(np.uint64)
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    size = np.diff(np.r_[first, len(sig)])
    out = []
    run = np.repeat(size, size)
    small = np.flatnonzero((run > 1) & (run <= 561))
    o = 1
    while len(small):
        a = small[small + o < len(sig)]
        a = a[sig[a] == sig[np.minimum(a + o, len(sig) - 1)]]
        d = np.bitwise_count(u[a] ^ u[a + o])
        ok = a[(d <= bits) & (d > 0)]
        out.append((u[ok], u[ok + o]))
        small, o = a, o + 1
    for f, n in zip(first[size > 561], size[size > 561]):
        own = np.sort(u[f : f + n])
        side, bit = int(sig[f]) >> 37 & 1, int(sig[f]) >> 32 & 31
        free = [1 << (bit + 32 * (1 - side)), *(1 << (i + 32 * side) for i in range(32))]
        for mask in [*free, *(a | b for a, b in combinations(free, 2))]:
            if mask.bit_count() <= bits:
                to = own ^ U(mask)
                i = np.minimum(np.searchsorted(own, to), len(own) - 1)
                ok = (own[i] == to) & (own < to)
                out.append((own[ok], to[ok]))
    a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.uint64)
    b = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.uint64)
    a, b = a.view(np.int64), b.view(np.int64)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["_a", "_b"])


def links(classes: DataFrame, parts: int, bits: int = 2) -> DataFrame:
    """(_a, _b): distinct fingerprints that differ by at most `bits` bits, each pair once."""
    if bits > 2:
        raise ValueError("two halves show up to 2 differing bits")
    signed = classes.select("_fp").mapInArrow(_signatures, "_sig long, _fp long")
    near = signed.repartition(parts, "_sig").sortWithinPartitions("_sig", "_fp")

    def run(batches):
        rest_sig, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x in batches:
            sig, fp = np.r_[rest_sig, x.column(0).to_numpy()], np.r_[rest_fp, x.column(1).to_numpy()]
            cut = np.searchsorted(sig, sig[-1]) if len(sig) else 0  # the last signature may go on
            rest_sig, rest_fp = sig[cut:], fp[cut:]
            if cut:
                yield _links_of(sig[:cut], fp[:cut], bits)
        if len(rest_sig):
            yield _links_of(rest_sig, rest_fp, bits)

    return near.mapInArrow(run, "_a long, _b long").distinct()


def ensure_checkpoints(spark: SparkSession) -> None:
    """The folder that the cluster names. On a single machine, as in tests, one of our own where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "codelake-checkpoints"))


def _release(spark: SparkSession) -> None:
    """Shuffle files of frames that are no longer held stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """(_node, _root) for every node of an edge: its component's smallest node, by alternating stars."""
    spark = edges.sparkSession
    ensure_checkpoints(spark)
    edges = edges.where("_a <> _b").select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).distinct().checkpoint()
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).head())
    before = state(edges)
    while before[0]:
        # large star: a node's larger neighbours go to its smallest
        both = edges.union(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m"))
        large = both.where("_v > _u").join(least, "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = large.join(least, "_u").where("_v <> _m").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        edges = small.union(least.select("_u", F.col("_m").alias("_v"))).distinct().checkpoint()
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("_u").alias("_node"), F.col("_v").alias("_root"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """A row for each input row: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    ensure_checkpoints(df.sparkSession)
    parts = max(tk.group_count(df, 8), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marked = fingerprints(df, id_col, text_col).checkpoint()
    classes = marked.groupBy("_fp").agg(F.min("_id").alias("_least")).checkpoint()
    roots = components(links(classes, parts, bits))
    rooted = classes.join(roots, classes["_fp"] == roots["_node"], "left").select("_fp", "_least", F.coalesce("_root", "_fp").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(least, "_root").select("_fp", "component_id")
    out = marked.join(named, "_fp")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shape(rows: int, similarity: float, recall: float) -> tuple[int, int]:
    """(bits of a segment, segments)"""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(16, math.ceil(math.log2(max(rows, 2))) - 2)
    hit = (1 - differ) ** bits + bits * differ * (1 - differ) ** (bits - 1)
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _words(text: bytes) -> tuple[np.ndarray, int]:
    """(hash of each word, hash of the sequence)"""
    words = text.translate(_LOWER).split()
    joined = b" ".join(words)
    raw = np.frombuffer(joined, np.uint8)
    s, e, _ = tk.word_bounds(raw, np.array([0, len(raw)]))
    return tk.span_hash(raw, s, e), _HASH(joined, 7)


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The set of shingles, sorted."""
    return np.unique(tk.rolling(h, min(size, max(len(h), 1))))


def _sketch(shingles: np.ndarray, words: int) -> np.ndarray:
    """The majority of each of 64 * words bits."""
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(shingles), 1 << 14):
        part = shingles[i : i + (1 << 14)]
        wide = np.stack([tk.mix(part ^ U(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) for k in range(words)], 1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.uint64)


def _halves(batches, bits: int, segments: int):
    """(key, class, 64 bits of its fingerprint): each segment by either of its halves, and the other half after it. Segments that differ by
    at most one bit have a half in common, so they meet there, and the variants with a bit wildcarded are made by who gets both."""
    low = bits // 2
    width = bits - low
    for b in batches:
        cls = b.column("_cls").to_numpy()
        fp = np.frombuffer(b"".join(b.column("_fp").to_pylist()), np.uint8).reshape(len(cls), -1)[:, :-_BINS]  # the counts of its shingles follow
        one = np.unpackbits(fp, axis=1, bitorder="little")
        near = np.ascontiguousarray(fp[:, :8]).view(np.int64).ravel()
        weight = U(1) << np.arange(width, dtype=np.uint64)
        for k in range(segments):
            first, last = (one[:, k * bits + lo : k * bits + hi].astype(np.uint64) @ weight[: hi - lo] for lo, hi in ((0, low), (low, bits)))
            for side, (same, free) in enumerate(((last, first), (first, last))):
                key = U(2 * k + side << 2 * width) | same << U(width) | free
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cls), pa.array(near)], names=["_key", "_cls", "_near"])


def _tree(near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a least spanning forest by differing bits, of those with `most` or fewer."""
    n = len(near)
    best, to, out = np.full(n, 99, np.uint8), np.zeros(n, np.int64), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        out[at] = True
        d = np.bitwise_count(near ^ near[at])
        closer = d < best
        best[closer] = d[closer]
        to[closer] = at
        best[out] = 100
        at = int(np.argmin(best))
        if best[at] <= most:
            edges.append((to[at], at))
        best[at] = 100
    x = np.array(edges, np.int64).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def _candidates_of(sig: np.ndarray, cls: np.ndarray, near: np.ndarray, most: int):
    """Pairs of classes (smaller first) that share a signature and whose 64 bits are near."""
    u = near.view(np.uint64)
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    size = np.diff(np.r_[first, len(sig)])
    run, out, o = np.repeat(size, size), [], 1
    small = np.flatnonzero((run > 1) & (run <= 16))
    while len(small):
        small = small[small + o < len(sig)]
        small = small[sig[small] == sig[small + o]]
        ok = small[np.bitwise_count(u[small] ^ u[small + o]) <= most]
        out.append((cls[ok], cls[ok + o]))
        o += 1
    for f, n in zip(first[size > 16].tolist(), size[size > 16].tolist()):
        x, y = _tree(u[f : f + n], most)
        out.append((cls[f + x], cls[f + y]))
    a, b = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in out)]) for k in (0, 1))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["_a", "_b"])


_BINS, _FULL = 256, 255


def _bins(shingles: np.ndarray) -> np.ndarray:
    """How many of the shingles fall in each bin, `_FULL` for so many or more."""
    return np.minimum(np.bincount((tk.mix(shingles) >> U(56)).astype(np.int64), minlength=_BINS), _FULL).astype(np.uint8)


def _possible(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the bins of two sets, a row each, allow the similarity: they share no more than the lesser of each bin."""
    same, both = np.minimum(x, y).sum(1, dtype=np.int64), x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64)
    return (same >= similarity * (both - same) - 1e-9) | (x == _FULL).any(1) | (y == _FULL).any(1)


def _prefix(shingles: np.ndarray, similarity: float, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the order of all, so many that sets of that similarity share one. heavy: sorted, last in the order, by rank."""
    many = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1
    own = tk.mix(shingles)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)
        late = np.where(heavy[at] == shingles, rank[at], 0)
        return shingles[np.lexsort((own, late))[:many]]
    return shingles[np.argsort(own)[:many]]


def _meeting(sig: np.ndarray, n: np.ndarray, root: np.ndarray, similarity: float, most: int | None = None):
    """(i, j), arrays of rows that share a shingle, are of different components and whose sizes allow the similarity; rows sorted by shingle
    and size. most: shingles that more rows have are left out."""
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    size = np.diff(np.r_[first, len(sig)])
    mixed = np.minimum.reduceat(root, first) < np.maximum.reduceat(root, first) if len(sig) else np.zeros(0, bool)
    run = np.repeat(np.where(mixed, size, 0), size)
    o, at = 1, np.flatnonzero((run > 1) & (run <= 64))
    while len(at):
        at = at[at + o < len(sig)]
        at = at[(sig[at] == sig[at + o]) & (n[at] >= similarity * n[at + o] - 1e-9)]
        ok = at[root[at] != root[at + o]]
        yield ok, ok + o
        o += 1
    large = mixed & (size > 64) & (size <= (len(sig) if most is None else most))
    for f, k in zip(first[large].tolist(), size[large].tolist()):
        order = f + np.argsort(root[f : f + k], kind="stable")  # by component, then by size
        cut = np.flatnonzero(np.r_[True, root[order][1:] != root[order][:-1]])
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), k]):
            x, y = order[lo:hi], order[hi:]
            for i in x.tolist():  # those of later components
                ok = y[(n[y] >= similarity * n[i] - 1e-9) & (n[i] >= similarity * n[y] - 1e-9)]
                yield np.full(len(ok), i), ok


def _apart(sig: np.ndarray, cls: np.ndarray, n: np.ndarray, root: np.ndarray, similarity: float) -> pa.RecordBatch:
    """Pairs of classes (smaller first) of different components whose sizes allow the similarity, how many of the shingles they share here, and
    how many they must share in all; rows sorted by shingle, size and class.

    Of the text whose first shingles end earlier, all first shingles that the other has are among the other's first. So at most the
    larger rest of the two can be shared besides, and the similarity asks for the others."""
    new = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])][: len(sig)]  # copies of a text
    sig, cls, n, root = (x[new] for x in (sig, cls, n, root))
    found = [*_meeting(sig, n, root, similarity)]
    i, j = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in found)]) for k in (0, 1))
    after = np.ceil(similarity * n - 1e-9).astype(np.int64) - 1  # shingles that are not among the first
    need = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9).astype(np.int64) - np.maximum(after[i], after[j])
    pairs, one, many = np.unique(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], 1), axis=0, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(many), pa.array(need[one])], names=["_a", "_b", "_c", "_need"])


def _early(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the shingle that rows i and j share stands early enough in both to be the first that they share: what stands before it in one is
    not in the other, and the similarity bounds how many those can be."""
    must = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9).astype(np.int64)
    return (at[i] <= n[i] - must) & (at[j] <= n[j] - must)


_SIDE = np.int64(32)


def _useful(sig: np.ndarray, cls: np.ndarray, place: np.ndarray, root: np.ndarray, similarity: float, most: int = 64) -> np.ndarray:
    """Rows whose shingle may be the first that their text shares with one of another component. Of a shingle that more than `most` texts of
    several components have, all rows. place: the text's size and where the shingle stands in it. The order is by shingle and size."""
    order = np.lexsort((cls, place >> _SIDE, sig))
    order = order[np.r_[True, (np.diff(sig[order]) != 0) | (np.diff(cls[order]) != 0)][: len(order)]]  # copies of a text
    sig, root, n, at = sig[order], root[order], place[order] >> _SIDE, place[order] & np.int64(0xFFFFFFFF)
    ok = np.zeros(len(sig), bool)
    for i, j in _meeting(sig, n, root, similarity, most):
        early = _early(n, at, i, j, similarity)
        ok[i[early]] = ok[j[early]] = True
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    size = np.diff(np.r_[first, len(sig)])
    large = (size > most) & (np.minimum.reduceat(root, first) < np.maximum.reduceat(root, first)) if len(sig) else np.zeros(0, bool)
    return order[ok | np.repeat(large, size)]


def _fewer(bins: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The bins of each text, neighbours added up until one has 4 shingles or more."""
    out: list[bytes] = [b""] * len(n)
    many = 1 << np.log2(np.maximum(n, 1) / 4).astype(np.int64).clip(3, 8)
    for k in np.unique(many).tolist():
        own = np.flatnonzero(many == k)
        for i, x in zip(own.tolist(), _folded(bins[own], k)):
            out[i] = x.tobytes()
    return out


def _folded(bins: np.ndarray, many: int) -> np.ndarray:
    return np.minimum(bins.reshape(len(bins), many, -1).sum(2, dtype=np.int64), _FULL).astype(np.uint8)  # one that is full stays so


def _alike(bins: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows the bins allow; of the two, the finer are added up."""
    size = np.array([len(x) for x in bins], np.int64)
    ok = np.zeros(len(i), bool)
    least = np.minimum(size[i], size[j])
    for k in np.unique(least).tolist():
        own = np.flatnonzero(least == k)
        rows, to = np.unique(np.r_[i[own], j[own]], return_inverse=True)
        x = np.empty((len(rows), k), np.uint8)
        for many in np.unique(size[rows]).tolist():
            at = np.flatnonzero(size[rows] == many)
            x[at] = _folded(np.frombuffer(b"".join(bins[rows[at]].tolist()), np.uint8).reshape(len(at), many), k)
        for lo in range(0, len(own), 1 << 13):
            hi = min(lo + (1 << 13), len(own))
            ok[own[lo:hi]] = _possible(x[to[lo:hi]], x[to[len(own) + lo : len(own) + hi]], similarity)
    return ok


def _shared(batches, similarity: float):
    """Pairs of classes (smaller first), of different components, that share a first shingle early enough in both and whose bins allow the
    similarity; rows sorted by shingle. A task tells a pair once."""
    told = np.zeros((0, 2), np.int64)
    for sig, cls, place, root, bins in _whole(batches):
        order = np.lexsort((cls, place >> _SIDE, sig))
        sig, cls, root, bins, n, at = sig[order], cls[order], root[order], bins[order], place[order] >> _SIDE, place[order] & np.int64(0xFFFFFFFF)
        found, held = [], 0
        meeting = _meeting(sig, n, root, similarity)
        while True:
            pair = next(meeting, None)
            if pair is not None:
                early = _early(n, at, *pair, similarity)
                found.append((pair[0][early], pair[1][early]))
                held += len(found[-1][0])
            if found and (pair is None or held >= 1 << 16):
                i, j = (np.concatenate([p[k] for p in found]) for k in (0, 1))
                both = np.unique(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], 1), axis=0, return_index=True)
                ok = _alike(bins, i[both[1]], j[both[1]], similarity)
                told = np.unique(np.concatenate([told, both[0][ok]]), axis=0)
                found, held = [], 0
            if pair is None:
                break
        if len(told) > 1 << 18:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(told[:, k])) for k in (0, 1)], names=["_a", "_b"])
            told = told[:0]
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(told[:, k])) for k in (0, 1)], names=["_a", "_b"])


def _spread(batches, buckets: int):
    """Each text's shingles to each bucket that has one of them. Lists grow with the square of a text, so `near_copies` sends counts instead."""
    for b in batches:
        own = [np.frombuffer(x, np.int64) for x in b.column("_own").to_pylist()]
        to = [np.unique(x.view(np.uint64) % U(buckets)).astype(np.int32) for x in own]
        at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in to]))
        for lo in range(0, len(at), 10_000):
            part = b.take(at.slice(lo, 10_000))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)[lo : lo + 10_000]), *part.columns], names=["_bucket", *part.schema.names])


def _met(table: pa.Table, buckets: int, similarity: float) -> pa.Table:
    """Pairs of a bucket's texts, of different components, that share as many of their first shingles as the similarity asks for; each pair in
    the bucket of the least shingle that both have."""
    cls, at = np.unique(table.column("_cls").to_numpy(), return_index=True)  # copies of a text
    n, root, lists = table.column("_n").to_numpy()[at], table.column("_root").to_numpy()[at], table.column("_own").take(pa.array(at)).to_pylist()
    own, bucket = [np.frombuffer(x, np.uint64) for x in lists], table.column("_bucket")[0].as_py()
    here = [x[x % U(buckets) == bucket] for x in own]
    sig, row = np.concatenate(here).view(np.int64), np.repeat(np.arange(len(cls)), [len(x) for x in here])
    order = np.lexsort((row, n[row], sig))
    pairs = _apart(sig[order], row[order], n[row[order]], root[row[order]], similarity)
    a, b, need = (pairs.column(c).to_numpy() for c in ("_a", "_b", "_need"))
    size = np.array([len(x) for x in own], np.int64)
    sets: dict[int, set] = {}
    found = []
    for k in np.flatnonzero(np.minimum(size[a], size[b]) >= need).tolist():
        i, j = int(a[k]), int(b[k])
        for v in (i, j):
            if v not in sets:
                sets[v] = set(own[v].tolist())
        same = sets[i] & sets[j]
        if len(same) >= need[k] and min(same) % buckets == bucket:
            found.append((i, j))
    x = cls[np.array(found, np.int64).reshape(-1, 2)]
    return pa.table([pa.array(np.ascontiguousarray(v)) for v in (x.min(1), x.max(1))] if len(x) else [pa.array([], pa.int64())] * 2, names=["_a", "_b"])


def _rest(texts: DataFrame, rows: int, classes: DataFrame, roots: DataFrame, parts: int, shingle: int, similarity: float, most_known: int) -> DataFrame:
    """(_a, _b): candidates for links between components, each once, none left out."""
    spark, share = texts.sparkSession, min(1.0, 20_000 / max(rows, 1))

    def sampled(batches):
        for x in tk.pieces(batches, "_text"):
            got = {}
            for t in tk.texts_of(x.column(0)):
                h, cls = _words(t)
                if len(h) and tk.mix(np.array([cls], np.uint64))[0] < share * 2**64:
                    got[cls] = _shingles(h, shingle)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([*got], np.uint64).view(np.int64)), pa.array([v.tobytes() for v in got.values()], pa.binary())], names=["_cls", "_all"])

    def spread(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in b.column("_all").to_pylist())]))], names=["_sig"])

    often = texts.mapInArrow(sampled, "_cls long, _all binary").dropDuplicates(["_cls"]).select("_cls", "_all").mapInArrow(spread, "_sig long").groupBy("_sig").agg(F.count("*").alias("_n"))
    got = often.where("_n > 2").orderBy(F.desc("_n"), "_sig").limit(500_000).toArrow()  # of the sample: only places shingles in the order
    order = np.argsort(got.column(0).to_numpy().view(np.uint64))
    del often
    _release(spark)
    held = spark.sparkContext.broadcast((got.column(0).to_numpy().view(np.uint64)[order], got.column(1).to_numpy()[order]))

    def begun(batches):
        """(class, size, first shingles) of a task's texts, once."""
        heavy, rank = held.value
        seen: set[int] = set()
        for x in tk.pieces(batches, "_text"):
            sig, cls, size = [], [], []
            for t in tk.texts_of(x.column(0)):
                h, c = _words(t)
                if not len(h) or c in seen:
                    continue
                seen.add(c)
                s = _shingles(h, shingle)
                sig.append(_prefix(s, similarity, heavy, rank))
                cls.append(c)
                size.append(len(s))
            yield sig, np.array(cls, np.uint64).view(np.int64), np.array(size, np.int64)

    few = roots.count() <= most_known
    if few:
        r = roots.orderBy("_node").toArrow()  # 16 MB
        known = spark.sparkContext.broadcast((r.column("_node").to_numpy(), r.column("_root").to_numpy()))

    def root_of(cls: np.ndarray) -> np.ndarray:
        node, root = known.value
        at = np.minimum(np.searchsorted(node, cls), max(len(node) - 1, 0))
        return np.where(node[at] == cls, root[at], cls) if len(node) else cls

    def entries(batches):
        for sig, cls, size in begun(batches):
            many = [len(x) for x in sig]
            at = np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in many)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sig]).view(np.int64)), pa.array(np.repeat(cls, many)), pa.array(np.repeat(size, many) << _SIDE | at)], names=["_sig", "_cls", "_place"])

    def useful(batches):
        every = [[c.to_numpy() for c in b.columns] for b in batches]
        sig, cls, place = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in every)]) for k in range(3))
        every.clear()
        own = _useful(sig, cls, place, root_of(cls) if few else cls, similarity)
        for lo in range(0, len(own), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[own[lo : lo + 10_000]]) for x in (sig, cls, place)], names=["_sig", "_cls", "_place"])

    def fewer(batches):
        for b in batches:
            bins = np.frombuffer(b"".join(b.column("_bins").to_pylist()), np.uint8).reshape(b.num_rows, _BINS)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(_fewer(bins, b.column("_place").to_numpy() >> _SIDE), pa.binary())], names=["_sig", "_cls", "_place", "_root", "_bins"])

    kind = "_sig long, _cls long, _place long"
    met = texts.mapInArrow(entries, kind).repartition(parts, "_sig").mapInArrow(useful, kind)
    own = classes.join(roots, classes["_cls"] == roots["_node"], "left").select(F.col("_cls").alias("_of"), F.coalesce("_root", "_cls").alias("_root"), F.expr(f"substring(_fp, -{_BINS}, {_BINS})").alias("_bins"))
    told = met.join(own, met["_cls"] == own["_of"]).select("_sig", "_cls", "_place", "_root", "_bins").mapInArrow(fewer, kind + ", _root long, _bins binary")
    return told.repartition(parts, "_sig").sortWithinPartitions("_sig").mapInArrow(lambda x: _shared(x, similarity), "_a long, _b long").distinct()


def _by_half(batches, bits: int, most: int):
    """Candidates among rows sorted by key; a variant has a bit of the half that may differ wildcarded."""
    low = bits // 2
    width = bits - low

    def candidates(key: np.ndarray, cls: np.ndarray, near: np.ndarray):
        for i in range(width):
            own = slice(None) if i < low else np.flatnonzero(key >> 2 * width & 1)  # the last half may be longer by a bit
            sig, c, n = key[own] & ~np.int64(1 << i), cls[own], near[own]
            order = np.argsort(sig, kind="stable")
            sig = sig[order]
            run = np.r_[False, sig[1:] == sig[:-1]][: len(sig)]
            order, sig = (x[run | np.r_[run[1:], False][: len(sig)]] for x in (order, sig))  # the others meet none
            if len(sig):
                last = np.lexsort((c[order], n[order], sig))  # one order everywhere, so that trees of the same texts agree
                order = order[last]
                yield _candidates_of(sig[last], c[order], n[order], most)

    for own in _whole(batches, lambda key: key >> width):
        yield from candidates(*own)


def _whole(batches, of=lambda key: key):
    """The columns of batches sorted by the first, as arrays that never part rows of the same of(first); binary columns are arrays of objects."""
    rest, many = [], 0
    for x in batches:
        if not x.num_rows:
            continue
        own = [c.to_numpy(zero_copy_only=False) for c in x.columns]
        by = of(own[0])
        cut = int(np.searchsorted(by, by[-1]))  # the last may go on
        if cut or rest and of(rest[-1][0][-1:])[0] != by[0]:
            done = [*rest, [a[:cut] for a in own]]
            rest = []
            yield [np.concatenate(a) for a in zip(*done)]
        rest.append([a[cut:] for a in own])
    if rest:
        yield [np.concatenate(a) for a in zip(*rest)]


def near_copies(df: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.97, most_known: int = 1_000_000) -> DataFrame:
    """(_cls, _root): the class of each text that has a near copy, and its component's; classes are by `classed`.

    most_known: if no more classes than this are candidates, their texts are picked out by a list of them that
    every task gets, and else by a join."""
    rows = df.count()
    bits, segments = _shape(rows, similarity, recall)
    wide = -(-bits * segments // 64)
    parts = max(tk.group_count(df, 2), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = df.select(F.col(text_col).cast("string").alias("_text"))

    def sketched(batches):
        for x in tk.pieces(batches, "_text"):
            got: dict[int, bytes] = {}
            for t in tk.texts_of(x.column(0)):
                h, cls = _words(t)
                if cls not in got:
                    own = _shingles(h, shingle) if len(h) else np.zeros(0, np.uint64)
                    got[cls] = (_sketch(own, wide).tobytes() if len(h) else bytes(8 * wide)) + _bins(own).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(np.array([*got], np.uint64).view(np.int64)), pa.array([*got.values()], pa.binary())], names=["_cls", "_fp"])

    classes = texts.mapInArrow(sketched, "_cls long, _fp binary").groupBy("_cls").agg(F.min("_fp").alias("_fp")).checkpoint()
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = lambda n: math.ceil(n * differ + 2.5 * math.sqrt(n * differ * (1 - differ)))  # noqa: E731  of n bits, for all but one pair in a hundred

    def near() -> DataFrame:
        halved = classes.mapInArrow(lambda x: _halves(x, bits, segments), "_key long, _cls long, _near long")
        signed = halved.repartition(parts, F.shiftright("_key", bits - bits // 2)).sortWithinPartitions("_key")
        return signed.mapInArrow(lambda x: _by_half(x, bits, most(64)), "_a long, _b long").distinct()

    def nearer(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, wide + _BINS // 8)[:, :wide] for c in ("_x", "_y"))
            yield b.filter(pa.array(np.bitwise_count(x ^ y).sum(1) <= most(64 * wide)))

    def possible(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, 8 * wide + _BINS)[:, 8 * wide :] for c in ("_x", "_y"))
            yield b.select(["_a", "_b"]).filter(pa.array(_possible(x, y, similarity)))

    def compared(pairs: DataFrame, keep) -> DataFrame:
        both = pairs.join(classes.select(F.col("_cls").alias("_a"), F.col("_fp").alias("_x")), "_a").join(classes.select(F.col("_cls").alias("_b"), F.col("_fp").alias("_y")), "_b")
        return both.select("_a", "_b", "_x", "_y").mapInArrow(keep, "_a long, _b long").checkpoint()

    def picked(batches, known):
        for x in tk.pieces(batches, "_text"):
            raw = tk.texts_of(x.column(0))
            cls = np.array([_HASH(b" ".join(t.translate(_LOWER).split()), 7) for t in raw], np.uint64).view(np.int64)
            first = np.zeros(len(cls), bool)
            first[np.unique(cls, return_index=True)[1]] = True
            if known is not None:
                first &= np.isin(cls, known)
            own = np.flatnonzero(first)
            yield pa.RecordBatch.from_arrays([pa.array(cls[own]), pa.array([raw[i] for i in own.tolist()], pa.binary())], names=["_cls", "_raw"])

    def verified(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("_x"), b.column("_y")):  # a pair's texts at a time
                s, t = (_shingles(_words(z.as_py())[0], shingle) for z in (x, y))
                same = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(same >= similarity * (len(s) + len(t) - same))
            yield b.select(["_a", "_b"]).filter(pa.array(ok, pa.bool_()))

    def true(pairs: DataFrame) -> DataFrame:
        """The pairs that the texts bear out."""
        held = pairs.select(F.col("_a").alias("_cls")).union(pairs.select("_b")).distinct().checkpoint()
        known = held.toArrow().column(0).to_numpy() if held.count() <= most_known else None  # 8 MB
        own = texts.mapInArrow(lambda x: picked(x, known), "_cls long, _raw binary")
        if known is None:
            own = own.join(held, "_cls", "left_semi")
        own = own.groupBy("_cls").agg(F.min("_raw").alias("_raw"))
        both = pairs.join(own.withColumnsRenamed({"_cls": "_a", "_raw": "_x"}), "_a").join(own.withColumnsRenamed({"_cls": "_b", "_raw": "_y"}), "_b").select("_a", "_b", "_x", "_y")
        return both.mapInArrow(verified, "_a long, _b long")

    roots = components(true(compared(near(), lambda x: possible(nearer(x)))))
    _release(df.sparkSession)
    more = compared(_rest(texts, rows, classes, roots, parts, shingle, similarity, most_known), possible)
    _release(df.sparkSession)
    linked = roots.select(F.col("_node").alias("_a"), F.col("_root").alias("_b"))
    return components(linked.union(true(more))).withColumnRenamed("_node", "_cls")


def classed(df: DataFrame, text_col: str) -> DataFrame:
    """The rows with a column __codelake_class, the same for texts of the same words."""
    names = df.columns
    rows = df.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for x in tk.pieces(batches, "_text"):
            cls = np.array([_HASH(b" ".join(t.translate(_LOWER).split()), 7) for t in tk.texts_of(x.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(cls.view(np.int64))], names=["_row", "_cls"])

    kind = rows.select("_row", F.lit(0).cast("long").alias("_cls")).schema
    return rows.mapInArrow(run, kind).select(*[F.col(f"_row.`{n}`").alias(n) for n in names], F.col("_cls").alias("__codelake_class"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near copies: that with the smallest id (rows without one come last, then by the hash of all columns)."""
    ensure_checkpoints(df.sparkSession)
    roots = near_copies(df, text_col, **options)
    own = classed(df, text_col)
    best = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), tk.row_hash(df).alias("row"))
    rows = own.select("__codelake_class", best.alias("_best")).groupBy("__codelake_class", "_best").agg(F.count("*").alias("_n"))
    least = rows.groupBy("__codelake_class").agg(F.min(F.struct("_best", "_n")).alias("_m"))
    rooted = least.join(roots, least["__codelake_class"] == roots["_cls"], "left").select("__codelake_class", "_m", F.coalesce("_root", "__codelake_class").alias("_root"))
    chosen = rooted.groupBy("_root").agg(F.min(F.struct("_m", "__codelake_class")).alias("_c"))
    chosen = chosen.select(F.col("_c.__codelake_class").alias("__codelake_of"), F.col("_c._m._best").alias("__codelake_best"), F.col("_c._m._n").alias("_n")).checkpoint()
    del rows, least, rooted
    _release(df.sparkSession)
    joined = lambda kept: own.join(kept, (F.col("__codelake_class") == F.col("__codelake_of")) & best.eqNullSafe(F.col("__codelake_best")), "left_semi").select(*[F.col(f"`{n}`") for n in df.columns])
    if chosen.where("_n > 1").isEmpty():
        return joined(chosen)
    return joined(chosen.where("_n = 1")).union(joined(chosen.where("_n > 1")).dropDuplicates(tk.hashable(df)))


def op7(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
