"""LM scoring: causal self-attention over subword ids, trained on texts of the whole corpus.

A text is its words (A-Z in lower case) and an end. Each word is cut into subwords by a public tokenizer's
vocabulary file; a subword and whether it ends its word is an id, so ids spell words without ambiguity. The
attention model (attention.Model) gives each id a probability after the ids before it, in overlapping windows,
each id scored once. A word has the attention's probability of its first id times that of the rest: the attention's
spelling of it and the word's share of the training corpus' words that begin with this id, interpolated by
C / (C + T) (C: how many such words, T: how many different ones), so no weight is set by hand. `attention_score`
has the attention's spelling alone.

Training: every text outside the fold is cut into runs of `_RUN` bytes at words; all runs (`share` = 1; a caller may ask for less, by hash)
are dealt into parts of `part_mb`, which each take a model through a slice of
their windows; the models are averaged by windows, level by level, in `rounds`. So training has every text once, or more often where
they are under `least_mb`, and grows with the input, in Spark; the driver holds one model and one count a vocabulary id. Word counts come from all training texts, by a packed
exchange: a group of texts sends each bucket its distinct words with their counts, the bucket answers with the totals, so no
vocabulary of words is broadcast.

Defined cases: null and empty texts are one end token; null ids are trained on, not held out; words that no
training text has count zero; without training texts the model is as it was initialised; rows that share
an id are scored one by one; columns other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import math
import os
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .attention import END, FIRST, RARE, Model, windows_of
from .simhash import ensure_checkpoints
from .textkit import U

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(1)
def _encoder(path: str):
    import tiktoken

    if not os.path.exists(path):
        raise FileNotFoundError(f"the tokenizer's vocabulary file {path} must be on every executor")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("codelake", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


@lru_cache(1)
def _spaced(path: str) -> np.ndarray:
    """Which subwords begin with a space, as a word's first does."""
    e = _encoder(path)
    return np.array([e.decode_single_token_bytes(i)[:1] == b" " for i in range(e.n_vocab)])


def pieces_of(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(2 x subword id, one more for a word's last; how many of each word)"""
    encode, spaced = _encoder(path)._core_bpe.encode_ordinary, _spaced(path)
    ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), 20_000):  # many words a call; a space and nothing else parts them
        own = words[i : i + 20_000]
        raw = np.array(encode(" " + b" ".join(own).decode("utf-8", "replace")), np.int64)
        first = spaced[raw]
        n = np.diff(np.r_[np.flatnonzero(first), len(raw)])
        if len(n) != len(own):
            each = [encode(" " + w.decode("utf-8", "replace")) for w in own]
            raw, n = np.array([*chain.from_iterable(each)], np.int64), np.array([*map(len, each)])
        out = 2 * raw
        out[np.cumsum(n) - 1] += 1
        ids.append(out)
        sizes.append(n)
    return np.concatenate(ids), np.concatenate(sizes)


class Scorer:
    """The attention model and its compact ids."""

    def __init__(self, path: str, vocabulary: int):
        self.path, self.size = path, vocabulary
        self.model = Model(vocabulary)
        kinds = RARE + 2 * np.repeat(_spaced(path), 2) + np.tile([0, 1], len(_spaced(path)))
        self.of = np.append(kinds, END).astype(np.int32)  # the last is the end of a text
        self.price = np.log(np.maximum(np.bincount(kinds, minlength=FIRST), 1))  # a rare subword among its like

    def begin(self, code: np.ndarray, n: np.ndarray) -> Scorer:
        """Ids by frequency. code: id + (ids) * (1 if the id before ended its word), of each id seen; n: how often."""
        total = len(self.of)
        counts = np.bincount(code % total, n, total)
        order = np.argsort(-counts[:-1], kind="stable")[: self.size - FIRST]
        order = order[counts[order] > 0]
        self.of[order] = np.arange(len(order)) + FIRST
        by_kind = np.zeros((2, self.size))
        np.add.at(by_kind, (code // total, self.of[code % total]), n)
        kind = np.zeros(FIRST + len(order), np.int64)
        kind[[1, RARE + 1, RARE + 3]] = 1
        kind[FIRST:] = order % 2
        self.model.begin(kind, by_kind)
        return self

    def word_log_probs(self, ids: np.ndarray, n: np.ndarray, stream: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each word's first id and of its rest; ids, n: of the distinct words; stream: their numbers, the last an end; sizes: words of each text."""
        flat, length = np.append(self.of[ids], np.int32(END)), np.append(n, 1)
        begin = np.cumsum(length) - length
        first, rest = np.empty(len(stream)), np.empty(len(stream))
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):  # so many texts at once that arrays stay small
            a = int(ends[at] - sizes[at])
            to = max(at + 1, int(np.searchsorted(ends, a + 100_000, side="right")))
            own = stream[a : int(ends[to - 1])]
            n = length[own]
            total = np.cumsum(n)
            ids = flat[np.repeat(begin[own] - (total - n), n) + np.arange(int(total[-1]))]
            texts = np.add.reduceat(n, np.r_[0, np.cumsum(sizes[at : to - 1])].astype(np.int64))
            x, target, place = windows_of(ids, texts)
            p = self.model.log_probs(x, target).ravel()[place].astype(np.float64)
            odd = np.flatnonzero((ids >= RARE) & (ids < FIRST))
            p[odd] -= self.price[ids[odd]]
            first[a : int(ends[to - 1])] = p[total - n]
            rest[a : int(ends[to - 1])] = np.add.reduceat(p, total - n) - p[total - n]
            at = to
        return first, rest


_RUN = 768


def _sealed(runs: list[np.ndarray]) -> bytes:
    """Runs of ids in few bytes: sizes, then the ids' bytes by place, compressed."""
    sizes, ids = np.array([len(runs), *map(len, runs)], np.int32), np.concatenate([np.zeros(0, np.int32), *runs]).astype(np.int32)
    raw = sizes.tobytes() + ids.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _opened(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    sizes = np.frombuffer(raw, np.int32, n, 4)
    ids = np.ascontiguousarray(np.frombuffer(raw, np.uint8, -1, 4 + 4 * n).reshape(4, -1).T).view(np.int32).ravel()
    return np.split(ids, np.cumsum(sizes)[:-1]) if n else []


def _runs(batches, share: float, parts: int, path: str):
    """(part, ids with an end of -1) of the runs of words chosen."""
    last = U(min(int(share * 2**64), 2**64 - 1))
    for b in batches:
        rows, runs = [], []
        for key, text in zip(b.column("_id").to_pylist(), tk.texts_of(b.column("_text"))):
            text = text.translate(_LOWER)
            mark = tk.mix(np.arange(max(1, -(-len(text) // _RUN)), dtype=np.uint64) + U(xxhash.xxh64_intdigest(str(key), 61)))
            own = np.flatnonzero(mark <= last)
            if not len(own):
                continue
            raw = np.frombuffer(text, np.uint8)
            gaps = np.append(np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13))), len(raw))
            lo = np.where(own > 0, gaps[np.minimum(np.searchsorted(gaps, own * _RUN), len(gaps) - 1)], 0)
            hi = gaps[np.minimum(np.searchsorted(gaps, (own + 1) * _RUN), len(gaps) - 1)]
            for x, y, m in zip(lo.tolist(), hi.tolist(), mark[own].tolist()):
                if x < y or not text:
                    runs.append((text[x:y].split(), y == len(text)))
                    rows.append(m // 2**32 % parts)
        ids, n = pieces_of([w for words, _ in runs for w in words], path)
        sizes = np.array([len(words) for words, _ in runs], np.int64)
        ends = np.r_[0, np.cumsum(n)][np.cumsum(sizes)]
        out = [np.append(x, -1) if end else x for x, (_, end) in zip(np.split(ids, ends[:-1]) if len(runs) else [], runs)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([x.astype(np.int32).tobytes() for x in out], pa.binary())], names=["_part", "_ids"])


def _bundled(batches):
    """A batch's runs of each part in one row, sealed."""
    for b in batches:
        by_part: dict[int, list[np.ndarray]] = {}
        for part, x in zip(b.column("_part").to_pylist(), b.column("_ids").to_pylist()):
            if x:
                by_part.setdefault(part, []).append(np.frombuffer(x, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([*by_part], pa.int32()), pa.array([_sealed(x) for x in by_part.values()], pa.binary())], names=["_part", "_ids"])


def _counted(batches, total: int):
    """(id + total * (1 if the id before ended its word), how often)"""
    for b in batches:
        runs = [r for x in b.column("_ids").to_pylist() for r in _opened(x)]
        ids = np.concatenate([np.zeros(0, np.int32), *runs]).astype(np.int64)
        before = np.r_[1, ids[:-1] % 2][: len(ids)]
        size = np.array([len(x) for x in runs], np.int64)
        before[(np.cumsum(size) - size)[size > 0]] = 1
        code, n = np.unique(np.where(ids < 0, total - 1, ids) + total * before, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["_code", "_n"])


def _taught(batches, scorer: Scorer, piece: int, pieces: int, high: float, low: float):
    """The model after a slice of the partition's windows, times their number, and the number."""
    runs = sorted(r.tobytes() for b in batches for x in b.column("_ids").to_pylist() for r in _opened(x))
    if not runs:
        return
    ids = np.concatenate([np.frombuffer(x, np.int32) for x in runs])
    x, target, _ = windows_of(scorer.of[ids], np.array([len(r) // 4 for r in runs]))
    own = np.array_split(np.random.default_rng(len(x) + piece // pieces).permutation(len(x)), pieces)[piece % pieces]
    if not len(own):
        return
    x, target = x[own], target[own]
    del runs, ids  # what other rounds take need not stay beside the pass
    scorer.model.descend(x, target, 64, high, low)
    data = np.append(scorer.model.packed().astype(np.float64) * len(own), len(own)).tobytes()
    from pyspark import TaskContext

    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([data], pa.binary())], names=["_salt", "_data"])


def _added(t: pa.Table) -> pa.Table:
    total = 0
    for x in t.column("_data"):
        total = total + np.frombuffer(x.as_buffer(), np.float64)
    return pa.table({"_salt": t.column("_salt").slice(0, 1), "_data": pa.array([total.tobytes()], pa.binary())})


def train(texts: DataFrame, n_bytes: int, path: str, vocabulary: int, share: float, least_mb: float, part_mb: float, rounds: int, rate: float) -> Scorer:
    """A model fitted on runs of the texts' words; n_bytes: their size."""
    scorer, kind = Scorer(path, vocabulary), "_salt int, _data binary"
    if not n_bytes:
        return scorer
    share = min(1.0, max(share, least_mb * 1e6 / n_bytes))
    passes = max(1, math.ceil(least_mb * 1e6 / n_bytes / share - 0.5))  # of a corpus smaller than that
    parts = max(1, round(share * n_bytes / (part_mb * 1e6)))
    runs = texts.mapInArrow(lambda x: _bundled(_runs(x, share, parts, path)), "_part int, _ids binary").repartition(parts, "_part").select("_ids").checkpoint()
    total = len(scorer.of)
    counts = runs.mapInArrow(lambda x: _counted(x, total), "_code long, _n long").groupBy("_code").agg(F.sum("_n")).toArrow()  # two rows an id of the vocabulary at most
    scorer.begin(counts.column(0).to_numpy(), counts.column(1).to_numpy())
    pieces = max(1, rounds // passes)
    for r in range(passes * pieces):
        high, low = (rate * max(0.05, 1 - x / (passes * pieces)) for x in (r, r + 1))
        models, n = runs.mapInArrow(lambda x, r=r, high=high, low=low: _taught(x, scorer, r, pieces, high, low), kind), runs.rdd.getNumPartitions()
        while n > 1:
            n = -(-n // 16)
            models = models.withColumn("_salt", (F.col("_salt") / 16).cast("int")).groupBy("_salt").applyInArrow(_added, kind)
        got = models.select("_data").toArrow().column(0)  # one model
        if not len(got):
            break
        flat = np.frombuffer(got[0].as_buffer(), np.float64)
        scorer.model.unpack(flat[:-1] / flat[-1])
    return scorer


def _trained(ids: pa.ChunkedArray, folds: int, held: int) -> np.ndarray:
    """False for rows of the held-out fold; a null id is trained on."""
    import zlib

    return np.array([x is None or zlib.crc32(str(x).encode()) % folds != held for x in ids.to_pylist()], bool)


class _Group:
    """A group's texts as words, its distinct words by bucket and hash."""

    def __init__(self, table: pa.Table, buckets: int):
        self.docs = [words_of(t) for t in tk.texts_of(table.column("_text").combine_chunks())]
        self.trained = _trained(table.column("_id"), 7, 2)
        words = list(dict.fromkeys(chain.from_iterable(self.docs)))
        h = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in words), np.uint64, len(words))
        order = np.lexsort((h, h % U(buckets)))
        if (h[order][1:] == h[order][:-1]).any():  # equal hashes: the words decide
            order = np.array(sorted(order.tolist(), key=lambda i: (int(h[i]) % buckets, int(h[i]), words[i])))
        self.words = [words[i] for i in order.tolist()]
        bucket = (h[order] % U(buckets)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        self.by = list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(words)]))  # bucket, from, to

    def counts(self) -> Counter[bytes]:
        out: Counter[bytes] = Counter()
        for d, yes in zip(self.docs, self.trained):
            if yes:
                out.update(d)
        return out


def _ask(table: pa.Table, buckets: int) -> pa.Table:
    group = _Group(table, buckets)
    key, counts = table.column("_key")[0].as_py(), group.counts()
    n = np.fromiter(map(counts.__getitem__, group.words), np.int64, len(group.words))
    return tk.pack_rows([(b, key, (y - x).to_bytes(8, "little") + tk.planes(n[x:y]) + b" ".join(group.words[x:y])) for b, x, y in group.by])


def _total(table: pa.Table, path: str) -> pa.Table:
    """The words' totals for each group, in its order; and how many words occur and how often, as a whole and by first id, once."""
    totals: Counter[bytes] = Counter()
    packs = []
    for key, x in zip(table.column("_key").to_pylist(), table.column("_data").to_pylist()):
        n = int.from_bytes(x[:8], "little")
        words = x[8 + 8 * n :].split(b" ")
        packs.append((key, words))
        for w, c in zip(words, tk.unplanes(x[8 : 8 + 8 * n], np.int64).tolist()):
            if c:
                totals[w] += c
    bucket = table.column("_bucket")[0].as_py()
    out = [(bucket, key, tk.planes(np.array([totals[w] for w in words], np.int64))) for key, words in packs]
    first, words, tokens = _by_first(list(totals), np.array([*totals.values()], np.int64), path)
    return tk.pack_rows([*out, (bucket, -1, tk.planes(first) + tk.planes(words) + tk.planes(tokens))])


def _split(t: pa.Table, x: tk.Exchange) -> pa.Table:
    """Answers sent on, the bucket's summary beside them."""
    own = pa.compute.equal(t.column("_key"), -1)
    return pa.concat_tables([x.send(t.filter(pa.compute.invert(own)), "_key"), t.filter(own)])


def _by_first(words: list[bytes], counts: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first ids, how many of the words begin with each, how often these occur)"""
    if not words:
        return (np.zeros(0, np.int64),) * 3
    ids, n = pieces_of(words, path)
    first, place, many = np.unique(ids[np.cumsum(n) - n], return_inverse=True, return_counts=True)
    return first.astype(np.int64), many.astype(np.int64), np.bincount(place, counts, len(first)).astype(np.int64)


def _firsts(batches):
    for b in batches:
        parts = [np.frombuffer(b"", np.int64).reshape(3, 0)]
        for x in b.column("_data").to_pylist():
            third = len(x) // 3
            parts.append(np.stack([tk.unplanes(x[i * third : (i + 1) * third], np.int64) for i in range(3)]))
        x = np.concatenate(parts, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in x], names=["_first", "_words", "_tokens"])


OUT = "_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, attention_score double"


def _score(table: pa.Table, answers: pa.Table, buckets: int, scorer: Scorer, ends: int, tokens: int, distinct: int, firsts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    names, kinds = [x.split()[0] for x in OUT.split(", ")], [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3]
    if not len(table):
        return pa.table([pa.array([], k) for k in kinds], names=names)
    group = _Group(table, buckets)
    words = group.words
    told = dict(zip(answers.column("_bucket").to_pylist(), answers.column("_data").to_pylist()))
    counts = np.concatenate([*(tk.unplanes(told[b], np.int64) for b, _, _ in group.by), [ends]]).astype(np.int64)
    number = {w: i for i, w in enumerate(words)}
    number[b""] = len(words)  # the end
    every: list[bytes] = []
    for d in group.docs:
        every += d
        every.append(b"")
    stream = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
    sizes = np.array([len(d) + 1 for d in group.docs])
    c = counts[stream]
    base = np.log10((counts + 1) / (tokens + distinct + 1))[stream]
    ids, n = pieces_of(words, scorer.path)
    # each distinct word's share of the words that begin as it does, and the weight of that; the end is certain after its id
    begins = ids[np.cumsum(n) - n]
    known = np.minimum(np.searchsorted(firsts[0], begins), max(len(firsts[0]) - 1, 0))
    seen = firsts[0][known] == begins if len(firsts[0]) else np.zeros(len(begins), bool)
    kinds_, often = (np.where(seen, x[known], 0) if len(x) else np.zeros(len(begins)) for x in firsts[1:])
    weight = np.append(often / np.maximum(often + kinds_, 1), 0)
    own = np.append(np.where(often > 0, counts[:-1] / np.maximum(often, 1), 0) * weight[:-1], 0)
    first, rest = scorer.word_log_probs(ids, n, stream, sizes)
    ln10 = math.log(10)
    alone = (first + rest) / ln10
    both = (first + np.log(own[stream] + (1 - weight[stream]) * np.exp(rest) + 1e-300)) / ln10
    start = np.cumsum(sizes) - sizes
    held = ~group.trained
    sums = [np.add.reduceat(x, start) for x in ((c > 0).astype(np.int64), base, both, alone)]
    return pa.table(
        [table.column("_id"), pa.array(held), pa.array(sizes, pa.int64()), pa.array(sums[0]), pa.array(np.full(len(sizes), tokens)), *map(pa.array, sums[1:])],
        names=names,
    )


def lm_scores(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, vocabulary: int = 1600, share: float = 1, least_mb: float = 6, part_mb: float = 8,
    rounds: int = 3, rate: float = 0.01, group_mb: float = 5, one_hop: int = tk.ONE_HOP,
) -> DataFrame:
    """A row for each input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score."""
    ensure_checkpoints(df.sparkSession)
    buckets = groups = tk.group_count(df, group_mb)
    plain = df.select(F.col(id_col).cast("long").alias("_id"), tk.text_expr(text_col).alias("_text"))
    trained = plain.where(F.col("_id").isNull() | (F.crc32(F.col("_id").cast("string").cast("binary")) % 7 != 2))
    ends, n_bytes = trained.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).head()
    scorer = train(trained, n_bytes + ends, tokenizer, vocabulary, share, least_mb, part_mb, rounds, rate) if ends else Scorer(tokenizer, vocabulary)
    texts = tk.dealt(plain, groups, "_id", "_text")
    x, grouped = tk.Exchange(groups, buckets, one_hop), texts.groupBy("_key")
    asked = x.relay(grouped.applyInArrow(lambda t: x.send(_ask(t, buckets), "_bucket"), tk.PACK), "_bucket")
    totals = asked.groupBy("_bucket").applyInArrow(lambda t: _split(_total(x.receive(t, "_bucket"), tokenizer), x), tk.PACK).checkpoint()
    begun = totals.where("_key = -1").select("_data").mapInArrow(_firsts, "_first long, _words long, _tokens long")
    begun = begun.groupBy("_first").agg(F.sum("_words"), F.sum("_tokens")).orderBy("_first").toArrow()  # a row an id of the vocabulary at most
    firsts = tuple(begun.column(i).to_numpy() for i in range(3))
    tokens, distinct = int(firsts[2].sum()) + ends, int(firsts[1].sum()) + (ends > 0)
    told = x.relay(totals.where("_key >= 0"), "_key")
    out = grouped.cogroup(told.groupBy("_key")).applyInArrow(lambda t, a: _score(t, x.receive(a, "_key"), buckets, scorer, ends, tokens, distinct, firsts), OUT)
    return out.withColumnRenamed("_id", id_col)


def op6(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
