"""Quality rules by suffix-array repetition, over words.

The suffix array of each document's words comes from doubling, a batch of documents at once: suffixes that
share their first words (`min_repeat`, three) with another of their document are ranked by these words, then those that tie by
six words, twelve and so on. The others take part in no such repeat and need no rank. (Words
are ordered by hash, which is an order like any other.) Longest-common-prefix intervals follow from permuted common
prefixes: only where the words before differ is a prefix measured, the others are one word shorter than
their predecessor's. A word position with a common prefix of `min_repeat` words or more starts a repeated
substring; the union of these spans must not cover more than `max_covered` of the words, and none may
be longer than `max_repeat` words. The first limit turns away texts of short repeats that no five-word window shows
twice ("word word word word other other ..."), the second a long passage that is pasted twice into a long text.

Defined cases: null text has no words and fails; an empty or one-word text fails; identical rows are judged
alike and on their own; columns other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .textkit import U

SCHEMA = "_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def repeats(h: np.ndarray, row: np.ndarray, least: int = 4) -> np.ndarray:
    """For each word, the longest sequence from it that starts elsewhere in its row as well (0 below `least`)."""
    n = len(h)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    own = tk.mix(row.astype(np.uint64) + U(1))
    w = tk.mix(h ^ own)  # equal words of different rows differ
    pad = np.concatenate([w, np.zeros(least, np.uint64)])
    last = np.flatnonzero(np.r_[row[1:] != row[:-1], True])
    end = last[np.searchsorted(last, np.arange(n))] + 1  # of each word's row
    key = np.zeros(n, np.uint64)
    for i in range(least):
        inside = np.arange(n) + i < end
        key = key * U(0xD6E8FEB86659FD93) + np.where(inside, pad[i : i + n], U(i + 7))
    key = tk.mix(key)
    order = np.argsort(key, kind="stable")
    same = np.r_[False, key[order][1:] == key[order][:-1]]
    tied = same | np.r_[same[1:], False]
    live = order[tied]
    if not len(live):
        return out
    # suffixes to rank: the live ones and those `least` words further on, in the order of their first words;
    # a rank is the place of the first suffix that ties, so a group of m ties has m numbers to part into
    known = np.unique(np.concatenate([live, live[live + least < end[live]] + least]))
    firsts = [np.where(known + i < end[known], pad[known + i], U(0)) for i in range(least)]
    o = np.lexsort(firsts[::-1])
    tie = np.ones(len(o), bool)
    for x in firsts:
        tie[1:] &= x[o][1:] == x[o][:-1]
    tie[0] = False
    rank = np.full(n, -1, np.int64)
    rank[known[o]] = np.maximum.accumulate(np.where(tie, 0, np.arange(len(o))))
    step, group = least, live
    while len(group):
        further = group + step
        second = np.where(further < end[group], rank[np.minimum(further, n - 1)], -1)
        o = np.lexsort((second, rank[group]))
        group, second = group[o], second[o]
        first, place = rank[group], np.arange(len(group))
        head = np.r_[True, first[1:] != first[:-1]]
        cut = head | np.r_[True, second[1:] != second[:-1]]
        rank[group] = first + np.maximum.accumulate(np.where(cut, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        group = group[~cut | np.r_[~cut[1:], False]]
        step *= 2
    return _prefixes(w, row, end, live[np.argsort(rank[live])], out)


def _prefixes(w, row, end, sa, out):
    """Longest common prefixes of neighbours in the suffix array, in text order."""
    prev, cur = sa[:-1], sa[1:]
    ok = row[prev] == row[cur]
    prev, cur = prev[ok], cur[ok]
    phi = np.full(len(w), -1, np.int64)
    phi[cur] = prev
    at = np.flatnonzero(phi >= 0)
    p = phi[at]
    chained = (at > 0) & (p > 0)
    chained &= (row[at - 1] == row[at]) & (row[p - 1] == row[p]) & (w[at - 1] == w[p - 1]) & (phi[at - 1] == p - 1)
    top = ~chained  # measured; the others are one shorter than the word before
    a, b = at[top], p[top]
    sums, down = _sums(w)
    lo, hi = np.zeros(len(a), np.int64), np.minimum(end[a] - a, end[b] - b)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        equal = (sums[a + mid] - sums[a]) * down[a] == (sums[b + mid] - sums[b]) * down[b]
        lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
    head = np.maximum.accumulate(np.where(top, np.arange(len(at)), 0))
    lcp = lo[np.cumsum(top) - 1] - (at - at[head])
    np.maximum.at(out, at, lcp)
    np.maximum.at(out, p, lcp)
    return out


def _sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down, _ = tk._powers(max(len(w), 1 << 17))
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * up[: len(w)], out=sums[1:])
    return sums, down


def covered(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    return np.cumsum(edge)[:-1] > 0


def _measure(batch: pa.RecordBatch, min_repeat: int, max_covered: float, max_repeat: int) -> pa.RecordBatch:
    raw, off = tk.bytes_of(batch.column(1))
    rows = batch.num_rows
    s, e, n = tk.word_bounds(raw, off)
    ends = np.cumsum(n)
    row = np.repeat(np.arange(rows), n)

    def by_row(per: np.ndarray, at_byte: bool = False) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(per)])
        return total[off[1:]] - total[off[:-1]] if at_byte else total[ends] - total[ends - n]

    points = (raw & 0xC0) != 0x80
    in_word = points & (raw != 32) & ((raw < 9) | (raw > 13))
    word_chars = by_row(in_word, True)
    n_symbols = by_row(np.isin(raw, SYMBOLS), True)
    # lines, cut at \n and at row ends
    brk = np.flatnonzero(raw == 10)
    ls = np.unique(np.concatenate([off[:-1], brk + 1]))
    ls = ls[ls < len(raw)]
    le = np.minimum.reduce([np.append(brk, len(raw))[np.searchsorted(brk, ls)], off[np.searchsorted(off, ls, side="right")]]) if len(ls) else ls
    full = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le = ls[full], le[full]
    lrow = np.searchsorted(off, ls, side="right") - 1
    lh = tk.mix(tk.span_hash(raw, ls, le) ^ tk.mix(lrow.astype(np.uint64) + U(3))) if len(ls) else np.zeros(0, np.uint64)
    _, firsts = np.unique(lh, return_index=True)
    dup = np.ones(len(lh), bool)
    dup[firsts] = False
    n_dup = np.bincount(lrow[dup], minlength=rows)
    size = repeats(tk.span_hash(raw, s, e), row, min(min_repeat, 5))
    five = np.flatnonzero(size >= 5)
    n_repeat = by_row(covered(five, np.full(len(five), 5), len(s)))
    long = np.flatnonzero(size >= min_repeat)
    span = by_row(covered(long, size[long], len(s)))
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row[long], size[long])
    failed = (n < 10) | (100 * n_repeat > 20 * n)
    good = ~failed & (span <= max_covered * n) & (longest <= max_repeat)
    cols = [batch.column(0), *(pa.array(np.asarray(x).astype(np.int64)) for x in (n, word_chars, n_symbols, n_dup, n_repeat)), pa.array(failed), pa.array(good), pa.array(span.astype(np.int64)), pa.array(longest)]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 3, max_covered: float = 0.4, max_repeat: int = 50) -> DataFrame:
    """A row for each input row: id, the base counts, kept, covered_words and longest_repeat. No shuffle."""
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    run = lambda batches: (_measure(x, min_repeat, max_covered, max_repeat) for x in tk.pieces(batches, "_text"))
    return texts.mapInArrow(run, SCHEMA).withColumnRenamed("_id", id_col)


def keep_good(df: DataFrame, **options) -> DataFrame:
    """The rows that pass, unchanged, in one pass: the verdict rides along with the row."""
    names = df.columns
    texts = df.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.lit(0).cast("long").alias("_id"), F.col(options.get("text_col", "text")).cast("string").alias("_text"))
    least, share, most = options.get("min_repeat", 3), options.get("max_covered", 0.4), options.get("max_repeat", 50)

    def run(batches):
        for x in tk.pieces(batches, "_text"):
            kept = _measure(x.select(["_id", "_text"]), least, share, most).column("kept")
            yield x.select(["_row"]).filter(kept)

    return texts.mapInArrow(run, texts.select("_row").schema).select("_row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
