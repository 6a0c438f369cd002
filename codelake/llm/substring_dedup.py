"""Substring dedup by fixed-block anchors, over words.

A window of `window` words contains a block of B = (window + 1) // 2 words that starts at a multiple of
B, wherever the window starts. So non-overlapping blocks of each document are the index and every rolling
B-word sequence is a probe: a probe that meets a block of another place is a hit. Hits are extended to
every window that holds them, equal neighbouring windows make up a maximal exact repeat, and each word
under a window that also starts in a document with a smaller id is removed.

Three passes over one exchange of the texts, joined by two packed exchanges (see textkit):
1. groups send each bucket their distinct B-word hashes, 4 bytes each with a flag for index entries; the
   bucket marks those that another place holds as well and that are in the index somewhere;
2. groups send the windows around their hits as 64-bit hashes with the smallest local id; the bucket,
   chosen by an independent hash, marks windows that a smaller id holds;
3. groups remove the words.
A falsely equal 4-byte hash costs a window in pass 2 and nothing else. Windows count as equal if 64 bits
and the bucket (log2 of the number of groups) agree.

Defined cases: null text has no words; null ids come after all others; rows that share an id don't
remove each other's words; a document with fewer words than `window` loses none; columns other than
the two named are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .textkit import U, pack_rows as _rows

_RING = U((1 << 30) - 1)


class _Words:
    """The words of a group: hashes, row of each, place in its row."""

    def __init__(self, table: pa.Table):
        self.ids = tk.ids_of(table.column("_id"))
        hashes, sizes = [], []
        for batch in table.select(["_text"]).to_batches(max_chunksize=512):
            raw, off = tk.bytes_of(batch.column(0))
            s, e, n = tk.word_bounds(raw, off)
            hashes.append(tk.span_hash(raw, s, e))
            sizes.append(n)
        self.h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.n = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.h)) - np.repeat(np.cumsum(self.n) - self.n, self.n)

    def windows(self, k: int) -> np.ndarray:
        """True where a window of k words of one row starts."""
        return self.place + k <= self.n[self.row]

    def rolling(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of k words."""
        at = np.flatnonzero(self.windows(k))
        return at, tk.rolling(self.h, k)[at]


def _probes(words: _Words, block: int, buckets: int):
    """(starts of probes, bucket and 30 bits of each as one number)"""
    at, g = words.rolling(block)
    return at, (g % U(buckets) << U(30)) | (g >> U(34))


def _ask(table: pa.Table, block: int, buckets: int) -> pa.Table:
    words = _Words(table)
    at, code = _probes(words, block, buckets)
    order = np.argsort(code, kind="stable")
    code, at = code[order], at[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    indexed = np.logical_or.reduceat(words.place[at] % block == 0, first) if len(first) else np.zeros(0, bool)
    many = np.diff(np.r_[first, len(code)]) > 1
    code = code[first]
    entry = ((code & _RING) << U(2) | indexed.astype(np.uint64) << U(1) | many.astype(np.uint64)).astype(np.uint32)
    cut = np.searchsorted(code, np.arange(buckets + 1, dtype=np.uint64) << U(30))
    key = table.column("_key")[0].as_py()
    rows = [(b, key, entry[cut[b] : cut[b + 1]].tobytes()) for b in range(buckets) if cut[b] < cut[b + 1]]
    return _rows(rows)


def _meet(table: pa.Table) -> pa.Table:
    """A bit for each entry of each group: its hash is in the index, and held in more than one place."""
    packs = [np.frombuffer(x, np.uint32) for x in table.column("_data").to_pylist()]
    size = np.array([len(x) for x in packs])
    entry = np.concatenate(packs)
    order = np.argsort(entry >> np.uint32(2), kind="stable")
    h = entry[order] >> np.uint32(2)
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    flags = np.bitwise_or.reduceat(entry[order] & np.uint32(3), first)
    count = np.diff(np.r_[first, len(h)])
    good = (flags & 2 > 0) & ((count > 1) | (flags & 1 > 0))
    hit = np.zeros(len(entry), bool)
    hit[order] = np.repeat(good, count)
    bucket = table.column("_bucket")[0].as_py()
    parts = np.split(hit, np.cumsum(size)[:-1])
    return _rows([(bucket, k, np.packbits(p).tobytes()) for k, p in zip(table.column("_key").to_pylist(), parts) if p.any()])


def _ask_windows(table: pa.Table, answers: pa.Table, block: int, window: int, buckets: int) -> pa.Table:
    if not len(table) or not len(answers):
        return _rows([])
    words = _Words(table)
    at, code = _probes(words, block, buckets)
    known = np.unique(code)
    cut = np.searchsorted(known, np.arange(buckets + 1, dtype=np.uint64) << U(30))
    hit = np.zeros(len(known), bool)
    for b, data in zip(answers.column("_bucket").to_pylist(), answers.column("_data").to_pylist()):
        n = cut[b + 1] - cut[b]
        hit[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
    # windows that hold a hit: starts from (window - block) words before it up to it
    near = np.zeros(len(words.h) + 1, np.int32)
    held = at[hit[np.searchsorted(known, code)]]
    np.add.at(near, np.maximum(held - (window - block), 0), 1)
    np.add.at(near, held + 1, -1)
    good = (np.cumsum(near)[:-1] > 0) & words.windows(window)
    start = np.flatnonzero(good)
    h = tk.rolling(words.h, window)[start]
    ids = words.ids[words.row[start]]
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    first = np.r_[True, h[1:] != h[:-1]][: len(h)]
    h, ids = h[first], ids[first]
    # an independent hash of the same words chooses the bucket
    g = tk.rolling(words.h, window, seed=77)[start][order][first]
    b = (g % U(buckets)).astype(np.int64)
    order, cut = tk.by_bucket(b, buckets)
    h, ids = h[order], ids[order]
    key = table.column("_key")[0].as_py()
    return _rows([(x, key, tk.planes(h[cut[x] : cut[x + 1]]) + tk.planes(ids[cut[x] : cut[x + 1]])) for x in range(buckets) if cut[x] < cut[x + 1]])


def _meet_windows(table: pa.Table) -> pa.Table:
    """For each group, the hashes that a smaller id than the group's smallest holds elsewhere."""
    packs = table.column("_data").to_pylist()
    size = np.array([len(x) // 16 for x in packs])
    h = np.concatenate([tk.unplanes(x[: len(x) // 2], np.uint64) for x in packs])
    ids = np.concatenate([tk.unplanes(x[len(x) // 2 :], np.int64) for x in packs])
    order = np.lexsort((ids, h))
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    least = np.repeat(ids[order][first], np.diff(np.r_[first, len(h)]))
    smaller = np.zeros(len(h), bool)
    smaller[order] = least < ids[order]
    bucket = table.column("_bucket")[0].as_py()
    ends = np.cumsum(size)
    return _rows([(bucket, k, tk.planes(h[e - n : e][smaller[e - n : e]])) for k, n, e in zip(table.column("_key").to_pylist(), size, ends) if smaller[e - n : e].any()])


def _remove(table: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    words = _Words(table) if len(table) else None
    ids, n_words, n_removed, kept = [], [], [], []
    if words is not None:
        start, h = words.rolling(window)
        out = np.zeros(len(start), bool)
        if len(h):
            order = np.lexsort((words.ids[words.row[start]], h))
            hs, owner = h[order], words.ids[words.row[start]][order]
            first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
            out[order] = np.repeat(owner[first], np.diff(np.r_[first, len(hs)])) < owner
        if len(answers) and len(h):
            taken = np.unique(np.concatenate([tk.unplanes(x, np.uint64) for x in answers.column("_data").to_pylist()]))
            i = np.minimum(np.searchsorted(taken, h), len(taken) - 1)
            out |= taken[i] == h
        edge = np.zeros(len(words.h) + 1, np.int32)
        np.add.at(edge, start[out], 1)
        np.add.at(edge, start[out] + window, -1)
        drop = np.cumsum(edge)[:-1] > 0
        ends = np.cumsum(words.n)
        gone = np.concatenate([[0], np.cumsum(drop)])
        n_removed = gone[ends] - gone[ends - words.n]
        n_words = words.n
        keep = ~drop
        ids = table.column("_id")
        for i, text in enumerate(table.column("_text")):
            own = (text.as_buffer() or b"") if text.is_valid else b""
            own = own.to_pybytes().split() if own else []
            kept.append((b" ".join(compress(own, keep[ends[i] - len(own) : ends[i]].tolist()) if n_removed[i] else own)).decode("utf-8", "replace"))
    return pa.table({"_id": ids if len(ids) else pa.array([], pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, group_mb: float = 5, one_hop: int = tk.ONE_HOP) -> DataFrame:
    """A row for each input row: id, n_words, n_removed, kept (the words left, joined by one space).

    group_mb: size of a group of texts in file bytes. A task holds one group, about thirty times that.
    """
    block = (window + 1) // 2
    groups = tk.group_count(df, group_mb)
    texts = tk.dealt(df.select(F.col(id_col).cast("long").alias("_id"), tk.text_expr(text_col).alias("_text")), groups, "_id", "_text")
    x = tk.Exchange(groups, groups, one_hop)
    grouped = texts.groupBy("_key")
    asked = x.relay(grouped.applyInArrow(lambda t: x.send(_ask(t, block, groups), "_bucket"), tk.PACK), "_bucket")
    met = x.relay(asked.groupBy("_bucket").applyInArrow(lambda t: x.send(_meet(x.receive(t, "_bucket")), "_key"), tk.PACK), "_key")
    windows = grouped.cogroup(met.groupBy("_key")).applyInArrow(lambda t, a: x.send(_ask_windows(t, x.receive(a, "_key"), block, window, groups), "_bucket"), tk.PACK)
    smaller = x.relay(windows, "_bucket").groupBy("_bucket").applyInArrow(lambda t: x.send(_meet_windows(x.receive(t, "_bucket")), "_key"), tk.PACK)
    out = grouped.cogroup(x.relay(smaller, "_key").groupBy("_key")).applyInArrow(lambda t, a: _remove(t, x.receive(a, "_key"), window), "_id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("_id", id_col)


def op1(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
