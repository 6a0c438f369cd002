"""Shared kernels: words and rolling hashes straight from Arrow buffers, and the packed exchange.

A word is `[^\\x20\\x09-\\x0D]+`. The separators are ASCII, so words are cut on UTF-8 bytes.

The packed exchange moves facts on billions of n-grams without a row for each: rows are dealt
into groups by id, a group sends each hash bucket one sorted blob, the bucket answers with one blob
a group. A key that fills a third of the corpus costs its bucket one entry a group, whatever its count.

Groups and buckets both grow with the corpus, so a blob from each group to each bucket would be rows in their square.
Beyond `ONE_HOP` groups a blob takes two hops (`Exchange`): a group sends one row to each of the square root of all buckets, a relay for as many
groups as that sorts them and sends one row a bucket. Rows then grow as groups to the power of 1.5, and are as much larger.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

U = np.uint64
NULL_ID = np.iinfo(np.int64).max
_BASE, _STEP = 0x9E3779B97F4A7C15, U(0xD6E8FEB86659FD93)
_tables: dict[str, np.ndarray] = {}


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size (file bytes for a scan); where it has none, the texts' sizes are summed."""
    guess = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if guess < 1e17:
        return guess
    sizes = [F.coalesce(F.sum(F.octet_length(F.col(f"`{n}`"))), F.lit(0)) for n, kind in df.dtypes if kind in ("string", "binary")]
    return int(df.agg(sum(sizes, F.lit(0))).head()[0])


def group_count(df: DataFrame, group_mb: float) -> int:
    """So many groups that each holds about group_mb of the input's files, and every core has one."""
    return int(max(math.ceil(input_bytes(df) / (group_mb * 1e6)), df.sparkSession.sparkContext.defaultParallelism))


def hashable(df: DataFrame) -> list[str]:
    """The columns that can be hashed and compared: all but those with maps."""
    return [n for n, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{n}`") for n in hashable(df)])


def dealt(df: DataFrame, groups: int, *by: str) -> DataFrame:
    """Rows with a column _key, dealt by the hash of `by` into `groups` groups, one exchange."""
    return df.withColumn("_key", F.pmod(F.xxhash64(*by), F.lit(groups)).cast("int")).repartition(groups, "_key")


def bytes_of(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. No copy for a single chunk."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if col.null_count:  # the bytes under a null are undefined
        keep = np.asarray(col.is_valid())
        size = np.where(keep, np.diff(off), 0)
        raw = raw[np.repeat(keep, np.diff(off))]
        off = np.concatenate([[0], np.cumsum(size)])
    return raw, off


def ids_of(col: pa.ChunkedArray) -> np.ndarray:
    """Int64 ids; a null id comes after all others."""
    return col.fill_null(NULL_ID).to_numpy().astype(np.int64) if isinstance(col, pa.ChunkedArray) else col.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def word_bounds(raw: np.ndarray, off: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words of each row). Words never cross rows. word: other bytes to make words of."""
    if word is None:
        word = (raw != 32) & ((raw < 9) | (raw > 13))
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    filled = np.flatnonzero(np.diff(off))
    first[off[filled]] = word[off[filled]]
    last[off[filled + 1] - 1] = word[off[filled + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n + 1:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n + 1, U(base))
            x[0] = 1
            _tables[name] = np.cumprod(x, dtype=np.uint64)
        _tables["byte"] = mix(np.arange(1, 513, dtype=np.uint64) * _STEP)  # 512: codes besides bytes
    return _tables["up"], _tables["down"], _tables["byte"]


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each span raw[start:end]; starts and ends ascend, spans may overlap a little."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + chunk)))
        a, b = int(starts[i]), int(ends[i:j].max())
        up, down, byte = _powers(max(b - a, 1 << 17))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(byte[raw[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of every k neighbours of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, U(seed))
    for i in range(k):
        acc = acc * _STEP + h[i : i + n]
    return mix(acc)


def planes(x: np.ndarray) -> bytes:
    """Integers as byte planes, which a shuffle's compression shrinks well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def unplanes(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


ONE_HOP = 1024
PACK = "_bucket int, _key int, _data binary"


def pack_rows(rows: list) -> pa.Table:
    """(bucket, group, blob)"""
    cols = list(zip(*rows)) or [[], [], []]
    return pa.table({"_bucket": pa.array(cols[0], pa.int32()), "_key": pa.array(cols[1], pa.int32()), "_data": pa.array(cols[2], pa.binary())})


class Exchange:
    """Blobs between groups and buckets, in one hop or two. Every send is followed by a relay and received by whoever is named in `to`."""

    def __init__(self, groups: int, buckets: int, one_hop: int = ONE_HOP):
        self.span = {"_key": math.isqrt(groups - 1) + 1, "_bucket": math.isqrt(buckets - 1) + 1} if groups > one_hop else None

    def send(self, t: pa.Table, to: str) -> pa.Table:
        """Rows for neighbouring receivers as one."""
        if self.span is None:
            return t
        other, by = ({"_key", "_bucket"} - {to}).pop(), {}
        for a, o, x in zip(t.column(to).to_pylist(), t.column(other).to_pylist(), t.column("_data").to_pylist()):
            by.setdefault((a // self.span[to], o), []).append(struct.pack("<iq", a, len(x)) + x)
        return self._table(to, other, [(a, o, b"".join(x)) for (a, o), x in by.items()])

    def relay(self, df: DataFrame, to: str) -> DataFrame:
        if self.span is None:
            return df
        other = ({"_key", "_bucket"} - {to}).pop()
        return df.groupBy(to, F.floor(F.col(other) / self.span[other]).alias("_cell")).applyInArrow(lambda t: self._sorted(t, to, other), PACK)

    def _sorted(self, t: pa.Table, to: str, other: str) -> pa.Table:
        by: dict[int, list[bytes]] = {}
        for o, x in zip(t.column(other).to_pylist(), t.column("_data").to_pylist()):
            for a, blob in self._blobs(x):
                by.setdefault(a, []).append(struct.pack("<iq", o, len(blob)) + blob)
        cell = t.column(other)[0].as_py() // self.span[other]
        return self._table(to, other, [(a, cell, b"".join(x)) for a, x in by.items()])

    def receive(self, t: pa.Table, to: str) -> pa.Table:
        """The rows as they were sent."""
        if self.span is None:
            return t
        other = ({"_key", "_bucket"} - {to}).pop()
        return self._table(to, other, [(a, o, blob) for a, x in zip(t.column(to).to_pylist(), t.column("_data").to_pylist()) for o, blob in self._blobs(x)])

    @staticmethod
    def _table(to: str, other: str, rows: list) -> pa.Table:
        return pack_rows([(a, o, x) if to == "_bucket" else (o, a, x) for a, o, x in rows])

    @staticmethod
    def _blobs(x: bytes):
        at = 0
        while at < len(x):
            a, n = struct.unpack_from("<iq", x, at)
            yield a, x[at + 12 : at + 12 + n]
            at += 12 + n


def by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that groups entries by bucket and keeps their order, bounds of each bucket)."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def text_expr(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def pieces(batches, text_col: str, limit: int = 3 << 20):
    """Slices of record batches that hold about `limit` bytes of text each; a longer row is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def texts_of(col: pa.Array) -> list[bytes]:
    """The rows as bytes; null is empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


WORD = r"[^\x20\x09-\x0D]+"


def smallest(df: DataFrame, key: Column, total: int, n: int) -> DataFrame:
    """The n rows of `total` with the smallest hash `key`, ties by the other columns. A filter comes first, so
    that all tasks together, not each, pass on little more than n rows."""
    out = df.withColumn("_h", key)
    if total > 2 * n:
        share = 1.2 * n / total + 100 / total
        out = out.where(F.col("_h") < F.lit(int(-(2**63) + min(share, 1.0) * (2**64 - 1))))
    return out.orderBy("_h", *df.columns).limit(n).drop("_h")
