"""Benchmark decontamination by latent semantic retrieval.

1. The benchmark's terms (its size is checked, so this is a proven bound) are the vocabulary. A pass over
   all texts counts in how many passages each occurs. Terms in more than `max_share` of them are left out of
   the latent space, save the rarer half of each item's terms: no item is without direction, however often it leaks.
   A passage is 64 words, every 32 words, so an item lies in one or across two.
2. A second pass multiplies the TF-IDF passage matrix A (and the items' rows) into a random matrix W:
   Y = A'A W, in one go, summed by a tree. On the driver, the Nystroem form of a randomised SVD turns Y (terms by
   `rank` + 8) into A's leading right singular vectors. Each 2 * `rank` items have a basis of their own, over their
   own terms, so directions and sums grow with the items and none is crowded out.
3. A third pass projects every passage and compares it with all items (a stated query set) by cosine. Candidates
   of at least `cosine` are verified on the words around the passage: the longest common subsequence with the
   item, by bit-parallel additions, must reach `same` of the item's words, or `close` of them if also the answer
   (the item's last sentence) is there to `answer` of its words. Thus order-keeping paraphrases are found too.
4. Beside the latent space, every place that shares three words in a row with an item is verified in the same way,
   whatever its terms weigh. An item of nine words or more of which a quarter (1 - `same`) was replaced or left
   out still has three in a row; shorter items are looked up by the fewer words that must be left in a row.

A word is a run of ASCII letters and digits and non-ASCII characters, in lower case. Only benchmark items and
sums as large as their vocabulary reach the driver.

Defined cases: null and empty texts leak nothing; null or empty items match nothing; items under `short` words
must occur whole and in order; an empty benchmark leaks nothing; rows that share an id are checked one by one;
several items in a text give a row each; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .textkit import U

HALF = 32
_SLICE = 256
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_WORD[128:] = True


class _Tokens:
    """Word hashes of the rows of a batch."""

    def __init__(self, col: pa.Array):
        raw, off = tk.bytes_of(pa.compute.utf8_lower(col))
        s, e, self.n = tk.word_bounds(raw, off, _WORD[raw])
        self.h = tk.span_hash(raw, s, e)
        self.end = np.cumsum(self.n)


class Vocabulary:
    """The benchmark's terms and how to find them among hashes."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.unique(terms)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms >> U(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, term numbers) of the known terms."""
        at = np.flatnonzero(self.maybe[(h >> U(44)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        ok = self.terms[i] == h[at]
        return at[ok], i[ok]


def _blocks(tokens: _Tokens, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words at `at`: (start of each block's run in `at`, row, first word, whether the next block follows at once)."""
    row = np.searchsorted(tokens.end, at, side="right")
    begin = tokens.end[row] - tokens.n[row]
    block = (at - begin) // HALF
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]) if len(at) else np.zeros(0, np.int64)
    row, block, begin = row[first], block[first], begin[first]
    joined = np.r_[(row[1:] == row[:-1]) & (block[1:] == block[:-1] + 1), False] if len(first) else np.zeros(0, bool)
    return first, row, begin + block * HALF, joined


def _passages(x: np.ndarray, first: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows of x by passage that starts with a block; and by block."""
    own = np.add.reduceat(x, first, axis=0) if len(first) else x[:0]
    out = own.copy()
    out[:-1][joined[:-1]] += own[1:][joined[:-1]]
    return out, own


def _spread(z: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """For each block, the sum over the passages that hold it: its own and the one before."""
    out = z.copy()
    out[1:][joined[:-1]] += z[:-1][joined[:-1]]
    return out


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    full = (1 << length) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return length - v.bit_count()


class Item:
    def __init__(self, item_id, words: list[int], answer: int):
        self.id, self.words, self.answer = item_id, words, words[-answer:] if answer else words
        self.masks = self._masks(self.words)
        self.answer_masks = self._masks(self.answer)

    @staticmethod
    def _masks(words: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out


def _items(rows) -> list[Item]:
    out = []
    for item_id, text in rows:
        h = _Tokens(pa.array([text or ""])).h.tolist()
        if h:
            tail = [p for p in re.split(r"[.?!]+(?:\s|$)", text) if re.search(r"\w", p)][-1:]
            out.append(Item(item_id, h, len(_Tokens(pa.array(tail)).h) if tail else 0))
    return out


class _Grams:
    """The items' runs of words, as many as every copy within `same` keeps in a row (three at most), and where they are."""

    def __init__(self, numbers: list[np.ndarray], same: float, short: int):
        by_size: dict[int, list] = {}
        for k, t in enumerate(numbers):
            lost = int((1 - same) * len(t) + 1e-9) if len(t) >= short else 0
            size = min(3, -(-(len(t) - lost) // (lost + 1)))
            by_size.setdefault(size, []).append((k, tk.rolling(t.astype(np.uint64), size)))
        self.sizes = []
        for size, own in sorted(by_size.items()):
            h = np.concatenate([x for _, x in own])
            item = np.repeat([k for k, _ in own], [len(x) for _, x in own])
            offset = np.concatenate([np.arange(len(x)) for _, x in own])
            order = np.argsort(h, kind="stable")
            runs = Vocabulary(h)
            self.sizes.append((size, runs, np.searchsorted(h[order], runs.terms), np.searchsorted(h[order], runs.terms, side="right"), item[order], offset[order]))

    def hits(self, tokens: _Tokens, at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, word at which the item would begin), each once, for words `at` with their term numbers."""
        row, out = np.searchsorted(tokens.end, at, side="right"), []
        for size, runs, lo, hi, item, offset in self.sizes:
            m = len(at) - size + 1
            if m <= 0:
                continue
            whole = np.flatnonzero((at[size - 1 :] - at[:m] == size - 1) & (row[size - 1 :] == row[:m]))
            place, run = runs.find(tk.rolling(term.astype(np.uint64), size)[whole])
            count = hi[run] - lo[run]
            j = np.arange(count.sum()) + np.repeat(lo[run] - (np.cumsum(count) - count), count)
            first = np.repeat(whole[place], count)
            out.append(np.stack([row[first], item[j], at[first] - offset[j]]))
        found = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((3, 0), np.int64)
        return found[0], found[1], found[2]


def _tree_sum(parts: DataFrame, width: int, tasks: int) -> DataFrame:
    """Sums blobs of doubles by slice, sixteen tasks' at a time, level by level."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(_SLICE * width)
        for x in t.column("_data"):
            total += np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"_slice": t.column("_slice").slice(0, 1), "_salt": t.column("_salt").slice(0, 1), "_data": pa.array([total.tobytes()], pa.binary())})

    kind = "_slice int, _salt int, _data binary"
    while tasks > 16:
        tasks = -(-tasks // 16)
        parts = parts.withColumn("_salt", (F.col("_salt") / 16).cast("int")).groupBy("_slice", "_salt").applyInArrow(add, kind)
    return parts.groupBy("_slice").applyInArrow(add, kind)


def _slices(total: np.ndarray, salt: int) -> pa.RecordBatch:
    n = -(-len(total) // _SLICE)
    pad = np.zeros((n * _SLICE, total.shape[1]))
    pad[: len(total)] = total
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, salt, np.int32)), pa.array([pad[i * _SLICE : (i + 1) * _SLICE].tobytes() for i in range(n)], pa.binary())], names=["_slice", "_salt", "_data"])


def _sum_over(texts: DataFrame, rows: int, width: int, step) -> np.ndarray:
    """The sum over all tasks of a rows x width matrix that `step` adds to, batch by batch."""

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((rows, width))
        for b in tk.pieces(batches, "_text"):
            step(total, _Tokens(b.column(b.num_columns - 1)))
        yield _slices(total, TaskContext.get().partitionId())

    parts = texts.select("_text").mapInArrow(run, "_slice int, _salt int, _data binary")
    got = _tree_sum(parts, width, tk.group_count(texts, 16)).orderBy("_slice").toArrow()
    return np.concatenate([np.frombuffer(x.as_buffer(), np.float64).reshape(_SLICE, width) for x in got.column("_data")])[:rows]


def find_leaks(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", rank: int = 96, max_share: float = 0.003,
    cosine: float = 0.3, same: float = 0.75, close: float = 0.6, answer: float = 0.8, short: int = 8, max_items: int = 20_000, seed: int = 8,
) -> DataFrame:
    """(id, item_id, overlap, answer_overlap, similarity): a row for each text and item that it leaks."""
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return _scan(texts, benchmark, False, text_col, item_col, rank, max_share, cosine, same, close, answer, short, max_items, seed).withColumnsRenamed({"_id": id_col, "_item": item_col})


def _scan(texts: DataFrame, benchmark: DataFrame, drop: bool, text_col: str, item_col: str, rank: int, max_share: float, cosine: float, same: float, close: float, answer: float, short: int, max_items: int, seed: int) -> DataFrame:
    """texts: _id and _text. What leaks (_id, _item and figures), or, if `drop`, the _id of the rows that leak nothing."""
    spark = texts.sparkSession
    kinds = f"_id {dict(texts.dtypes)['_id']}, _item {dict(benchmark.dtypes)[item_col]}, overlap double, answer_overlap double, similarity double"
    rows = benchmark.select(item_col, F.col(text_col).cast("string")).limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"the benchmark has over {max_items} items; raise max_items with the executors' memory")
    items = _items(sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0])))
    if not items:
        return texts.select("_id") if drop else spark.createDataFrame([], kinds)
    vocabulary = Vocabulary(np.array([w for i in items for w in i.words], np.uint64))
    n = len(vocabulary.terms)

    def count(total: np.ndarray, tokens: _Tokens) -> None:
        at, term = vocabulary.find(tokens.h)
        first, *_, = _blocks(tokens, at)
        block = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(at)]))
        pairs = np.sort(block * n + term)
        total[:, 0] += np.bincount(pairs[np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]] % n, minlength=n)
        total[0, 1] += (-(-tokens.n // HALF)).sum()

    counts = _sum_over(texts, n, 2, count)
    total = counts[0, 1] + len(items)
    df_ = counts[:, 0] + np.bincount(np.concatenate([np.unique(np.searchsorted(vocabulary.terms, np.array(i.words, np.uint64))) for i in items]), minlength=n)
    numbers = [np.searchsorted(vocabulary.terms, np.array(i.words, np.uint64)) for i in items]
    kept = df_ <= max(max_share * total, 1.5 * len(items))
    for t in map(np.unique, numbers):
        kept[t[np.argsort(df_[t], kind="stable")[: -(-len(t) // 2)]]] = True
    idf = np.log(1 + total / np.maximum(df_, 1))
    # a basis for each 2 * `rank` items or fewer: its terms are rows of stacked matrices, a term may be in several
    width, owners = rank + 8, np.array_split(np.arange(len(items)), -(-len(items) // (2 * rank)))
    owned = [np.unique(np.concatenate([numbers[k][kept[numbers[k]]] for k in own])) for own in owners]
    low = np.cumsum([0, *(len(x) for x in owned)])
    stacked, basis_of = np.concatenate(owned), np.repeat(np.arange(len(owned)), np.diff(low))
    by_term = np.argsort(stacked, kind="stable")
    bound = np.searchsorted(stacked[by_term], np.arange(n + 1))
    weight = idf[stacked]
    sketch = np.random.default_rng(seed).standard_normal((len(stacked), width)) * weight[:, None]

    def known(at: np.ndarray, term: np.ndarray):
        """(basis, words, rows of the stacked matrices) for each basis that has words here."""
        m = bound[term + 1] - bound[term]
        r = by_term[np.arange(m.sum()) + np.repeat(bound[term] - (np.cumsum(m) - m), m)]
        at = np.repeat(at, m)
        order = np.argsort(basis_of[r], kind="stable")
        at, r = at[order], r[order]
        cut = np.searchsorted(basis_of[r], np.arange(len(owned) + 1))
        for g in np.flatnonzero(np.diff(cut)).tolist():
            yield g, at[cut[g] : cut[g + 1]], r[cut[g] : cut[g + 1]]

    small = sketch.astype(np.float32)

    def multiply(total: np.ndarray, tokens: _Tokens) -> None:
        for _, at, term in known(*vocabulary.find(tokens.h)):
            first, _, _, joined = _blocks(tokens, at)
            z, _ = _passages(small[term], first, joined)
            norm, _ = _passages(weight[term] ** 2, first, joined)
            share = _spread(z / norm[:, None].astype(np.float32), joined)
            block = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(at)]))
            order = np.argsort(term, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(term[order]) > 0])
            total[term[order][cut]] += np.add.reduceat(share[block[order]], cut, axis=0) * weight[term[order][cut], None]

    sums = _sum_over(texts, len(stacked), width, multiply)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    latent, wanted = np.zeros((len(stacked), rank), np.float32), np.zeros((len(items), rank), np.float32)
    for own, a, b in zip(owners, low, low[1:]):
        y, inside = sums[a:b].copy(), [np.searchsorted(stacked[a:b], numbers[k][kept[numbers[k]]]) for k in own]
        for t in inside:  # the items are rows too, so that their directions are never lost
            np.add.at(y, t, weight[a:b][t, None] * sketch[a:b][t].sum(0) / (weight[a:b][t] ** 2).sum() * max(1.0, total**0.5 / 16))
        # the right singular vectors of A from Y = A'A W
        core = (sketch[a:b] / weight[a:b, None]).T @ y
        core = (core + core.T) / 2
        values, vectors = np.linalg.eigh(core)
        good = values > 1e-9 * max(values.max(), 1e-300)
        left, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
        left = left[:, :rank]
        latent[a:b, : left.shape[1]] = left * weight[a:b, None]
        wanted[own] = unit(np.stack([latent[a:b][t].sum(0) for t in inside]))

    basis_at = np.repeat(np.arange(len(owners)), [len(x) for x in owners])  # by item
    sizes = np.array([len(i.words) for i in items])
    sides = np.maximum(0, sizes - HALF)
    needed = np.ceil(np.where(sizes >= short, close, 1) * sizes - 1e-9)
    held, often = np.unique(np.concatenate([k * n + t for k, t in enumerate(numbers)]), return_counts=True)  # how often an item has a term
    grams = _Grams(numbers, same, short)

    def search(batches):
        for b in tk.pieces(batches, "_text"):
            tokens = _Tokens(b.column(1))
            every, terms = vocabulary.find(tokens.h)
            found: dict[tuple[int, int], list[float]] = {}

            def verify(r: np.ndarray, k: np.ndarray, begin: np.ndarray, end: np.ndarray, near: np.ndarray) -> None:
                """Candidates: rows, items, the words to look at and the cosine."""
                # no common subsequence is longer than the item's words whose terms occur there
                i, j = np.searchsorted(every, begin), np.searchsorted(every, end)
                pair = np.repeat(np.arange(len(r)), j - i)
                here = terms[np.arange(len(pair)) + np.repeat(i - (np.cumsum(j - i) - (j - i)), j - i)]
                own = np.sort(pair * n + here)
                own = own[np.r_[True, own[1:] != own[:-1]][: len(own)]]
                wants = k[own // n] * n + own % n
                place = np.minimum(np.searchsorted(held, wants), len(held) - 1)
                most = np.bincount(own // n, np.where(held[place] == wants, often[place], 0), minlength=len(r))
                for c in np.flatnonzero(most >= needed[k]).tolist():
                    item, key = items[k[c]], (int(r[c]), int(k[c]))
                    words = tokens.h[begin[c] : end[c]].tolist()
                    share = lcs(item.masks, len(item.words), words) / len(item.words)
                    if share < (close if len(item.words) >= short else 1):
                        continue
                    told = lcs(item.answer_masks, len(item.answer), words) / len(item.answer)
                    if share >= same or told >= answer:
                        found[key] = max(found.get(key, [0.0, 0.0, 0.0]), [share, told, float(near[c])])

            blocks = {}
            for g, at, term in known(every, terms):
                first, row, start, joined = _blocks(tokens, at)
                x, _ = _passages(latent[term], first, joined)
                blocks[g] = start, (x := unit(x))
                for lo in range(0, len(x), 8192):
                    near = x[lo : lo + 8192] @ wanted[owners[g]].T
                    p, k = np.nonzero(near >= cosine)
                    r, a, near, k = row[lo + p], start[lo + p], near[p, k], owners[g][k]
                    verify(r, k, np.maximum(tokens.end[r] - tokens.n[r], a - sides[k]), np.minimum(tokens.end[r], a + 2 * HALF + sides[k]), near)
            rows_, ks, froms = grams.hits(tokens, every, terms)
            for lo in range(0, len(ks), 8192):
                r, k, a = rows_[lo : lo + 8192], ks[lo : lo + 8192], froms[lo : lo + 8192]
                top = tokens.end[r] - tokens.n[r]
                begin, end = np.maximum(top, a - sizes[k] // 2), np.minimum(tokens.end[r], a + sizes[k] + sizes[k] // 2)
                block = top + (np.maximum(a, top) - top) // HALF * HALF
                near = np.zeros(len(r))
                for g in np.unique(basis_at[k]).tolist():
                    own = np.flatnonzero(basis_at[k] == g)
                    if g in blocks:
                        start, x = blocks[g]
                        p = np.minimum(np.searchsorted(start, block[own]), len(start) - 1)
                        near[own] = np.where(start[p] == block[own], (x[p] * wanted[k[own]]).sum(1), 0.0)
                verify(r, k, begin, end, near)
            if drop:
                clean = np.ones(b.num_rows, bool)
                clean[[r for r, _ in found]] = False
                yield b.select(["_id"]).filter(pa.array(clean))
                continue
            keys = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([r for r, _ in keys], pa.int64())), pa.array([items[k].id for _, k in keys], benchmark_type), *(pa.array([found[x][c] for x in keys], pa.float64()) for c in range(3))],
                names=["_id", "_item", "overlap", "answer_overlap", "similarity"],
            )

    benchmark_type = pa.array([i.id for i in items]).type if dict(benchmark.dtypes)[item_col] != "bigint" else pa.int64()
    return texts.mapInArrow(search, texts.select("_id").schema if drop else kinds)


def drop_leaks(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", rank: int = 96, max_share: float = 0.003, cosine: float = 0.3, same: float = 0.75, close: float = 0.6, answer: float = 0.8,
    short: int = 8, max_items: int = 20_000, seed: int = 8,
) -> DataFrame:
    """The rows of df that leak no item, unchanged, in one pass: the verdict rides along with the row, whatever its id."""
    rows = df.select(F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return _scan(rows, benchmark, True, text_col, item_col, rank, max_share, cosine, same, close, answer, short, max_items, seed).select("_id.*")


def op8(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
