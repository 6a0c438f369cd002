"""Suffix-array dedup over UTF-8 bytes: induced sorting of content-routed shards.

A document's byte goes if a `length`-byte string (100) that covers it also starts earlier: in a document with
a smaller id, or earlier in the same one. To find equal strings by suffix arrays no larger than a task,
text is dealt into shards so that equal strings meet:
1. Every `length`-byte window has an anchor, its `_K`-gram with the smallest hash, so equal windows have equal
   anchors. Groups of documents send each shard their distinct anchor hashes (4 bytes each, packed exchange);
   the shard marks those that occur more than once. The rest cannot hold a repeat.
2. For each marked anchor, the stretch of text whose windows it anchors goes to the anchor's shard; of equal
   stretches of a group only the earliest goes, with its place. All windows of the others start earlier in that one, so
   the group cuts them itself: a line that a third of all documents share costs its shard one place a group.
3. A shard sorts all suffixes of its stretches (`suffix_array`), takes permuted common prefixes
   (`common_prefixes`), and in each interval of prefixes of `length` or more keeps the earliest window.
   It answers with the others' places.
4. Groups cut the bytes that the answers cover.

`suffix_array` classifies suffixes as smaller or larger than their right neighbour, sorts the substrings between
leftmost-smaller suffixes by induction, names them, sorts the names recursively by pairs (up to the
`length` that matters) and induces the whole array: linear passes, each a few vectorised steps a symbol.

Defined cases: null text is empty; documents shorter than `length` lose nothing; null ids come after all
others; rows that share an id count by their starts, as one document's; columns other than the two named
are ignored, whatever their names. Long texts are looked at in overlapping parts, which changes no window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .substring_dedup import _meet
from .textkit import U, pack_rows as _rows

_K = 32
_PLACE = 26


def anchors(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window, row) of each anchor: windows by start, within their rows."""
    n, w = len(raw), length - _K + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), none, none, none
    h = np.empty(n - _K + 1, np.uint64)
    step = 1 << 15
    up, down, byte = tk._powers(1 << 17)
    for a in range(0, len(h), step):
        b = min(a + step, len(h))
        sums = np.zeros(b - a + _K, np.uint64)
        np.cumsum(byte[raw[a : b + _K - 1]] * up[: b - a + _K - 1], out=sums[1:])
        h[a:b] = tk.mix((sums[_K:] - sums[:-_K]) * down[: b - a])
    v = (h & ~U((1 << _PLACE) - 1)) | np.arange(len(h), dtype=np.uint64)
    size = -(-len(v) // w) * w
    v = np.concatenate([v, np.full(size - len(v), U(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    at = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & U((1 << _PLACE) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:count]
    valid = np.arange(count) + length <= off[row + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return np.zeros(0, np.uint64), none, none, none
    a, r = at[start], row[start]
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
    return h[a[cut]], start[cut], start[np.r_[cut[1:] - 1, len(start) - 1]], r[cut]


class _Group:
    """A group's rows in the order of id and text, in pieces, with their anchors."""

    def __init__(self, table: pa.Table, length: int):
        texts = tk.texts_of(table.column("_text").combine_chunks())
        ids = tk.ids_of(table.column("_id"))
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.ids = ids[self.order]
        self.length = length

    def pieces(self, limit: int = 2 << 20):
        """(bytes, first row, row starts, anchors, offset of the bytes in a row that is cut)"""
        a = 0
        while a < len(self.texts):
            if len(self.texts[a]) > 2 * limit:  # parts share all but one byte of a window, so each window is in one of them
                for at in range(0, len(self.texts[a]) - self.length + 1, limit):
                    data = self.texts[a][at : at + limit + self.length - 1]
                    off = np.array([0, len(data)], np.int64)
                    yield data, a, off, anchors(np.frombuffer(data, np.uint8), off, self.length), at
                a += 1
                continue
            b, size = a, 0
            while b < len(self.texts) and (b == a or size + len(self.texts[b]) <= limit):
                size += len(self.texts[b])
                b += 1
            data = b"".join(self.texts[a:b])
            off = np.concatenate([[0], np.cumsum([len(t) for t in self.texts[a:b]])]).astype(np.int64)
            yield data, a, off, anchors(np.frombuffer(data, np.uint8), off, self.length), 0
            a = b

    def stretches(self):
        """For each piece: bytes, and of each stretch the anchor's hash, a hash of its bytes, its place in them, size, row and start,
        whether it is the first of its bytes in the piece."""
        for data, first, off, (h, lo, hi, row), at in self.pieces():
            size = hi - lo + self.length
            key = tk.span_hash(np.frombuffer(data, np.uint8), lo, lo + size) if len(lo) else h
            yield data, h, key, lo, size, row + first, lo - off[row] + at, _first_of(key)


def _first_of(key: np.ndarray) -> np.ndarray:
    """True for the first of equal keys."""
    out = np.zeros(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


def _union(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [lo, hi) of rows, sorted, those that meet as one."""
    if not len(row):
        return row, lo, hi
    k = np.lexsort((lo, row))
    row, lo, hi = row[k], lo[k], hi[k]
    wide = int(hi.max()) + 1
    far = np.maximum.accumulate(hi + row * wide)
    cut = np.flatnonzero(np.r_[True, (lo + row * wide)[1:] > far[:-1]])
    return row[cut], lo[cut], far[np.r_[cut[1:] - 1, len(row) - 1]] - row[cut] * wide


def _code(h: np.ndarray, shards: int) -> np.ndarray:
    return (h % U(shards) << U(30)) | (h >> U(34))


def _ask(table: pa.Table, length: int, shards: int) -> pa.Table:
    codes, flags = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for _, _, _, (h, *_), _ in _Group(table, length).pieces():
        code, n = np.unique(_code(h, shards), return_counts=True)
        codes.append(code)
        flags.append(n > 1)
    code, many = np.concatenate(codes), np.concatenate(flags)
    order = np.argsort(code, kind="stable")
    code, many = code[order], many[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    if len(first):
        many = np.logical_or.reduceat(many, first) | (np.diff(np.r_[first, len(code)]) > 1)
    code = code[first]
    entry = ((code & U((1 << 30) - 1)) << U(2) | U(2) | many.astype(np.uint64)).astype(np.uint32)
    cut = np.searchsorted(code, np.arange(shards + 1, dtype=np.uint64) << U(30))
    key = table.column("_key")[0].as_py()
    return _rows([(b, key, entry[cut[b] : cut[b + 1]].tobytes()) for b in range(shards) if cut[b] < cut[b + 1]])


def _send(table: pa.Table, answers: pa.Table, length: int, shards: int) -> pa.Table:
    if not len(table) or not len(answers):
        return _rows([])
    group = _Group(table, length)
    datas, parts = [], []
    for data, h, key, lo, size, row, start, lead in group.stretches():
        parts.append([np.full(int(lead.sum()), len(datas)), *(x[lead] for x in (_code(h, shards), key, lo, size, row, start))])
        datas.append(data)
    piece, code, key, lo, size, row, start = (np.concatenate(x) for x in zip(*parts))
    known = np.unique(code)
    cut = np.searchsorted(known, np.arange(shards + 1, dtype=np.uint64) << U(30))
    hit = np.zeros(len(known), bool)
    for b, data in zip(answers.column("_bucket").to_pylist(), answers.column("_data").to_pylist()):
        hit[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=cut[b + 1] - cut[b]).astype(bool)
    own = np.flatnonzero(hit[np.searchsorted(known, code)] & _first_of(key))
    own = own[np.argsort(code[own] >> U(30), kind="stable")]
    shard = (code[own] >> U(30)).astype(np.int64)
    ends = np.r_[np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)] if len(shard) else []
    out, a, of = [], 0, table.column("_key")[0].as_py()
    for b in ends:
        k = own[a:b]
        texts = b"".join(datas[i][x : x + n] for i, x, n in zip(piece[k].tolist(), lo[k].tolist(), size[k].tolist()))
        out.append((int(shard[a]), of, np.array([len(k)], np.uint32).tobytes() + size[k].astype(np.uint16).tobytes() + tk.planes(group.ids[row[k]]) + tk.planes(row[k].astype(np.uint32)) + tk.planes(start[k].astype(np.uint32)) + texts))
        a = b
    return _rows(out)


def _induce(t: np.ndarray, smaller: np.ndarray, starts: np.ndarray, symbols: list[int], lms: np.ndarray) -> np.ndarray:
    """All suffixes sorted, given the leftmost-smaller ones in order: two sweeps over the buckets of symbols."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    lms = lms.astype(np.int32)
    size = np.bincount(t[lms], minlength=len(starts) - 1)
    tail = starts[1:].copy()
    c = t[lms]
    sa[(tail - size)[c] + np.arange(len(lms)) - (np.cumsum(size) - size)[c]] = lms
    head = starts[:-1].copy()

    def put(j: np.ndarray, pointer: np.ndarray, down: bool) -> None:
        c = t[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        count = np.diff(np.r_[first, len(c)])
        place = np.arange(len(c)) - np.repeat(first, count)
        base = pointer[c[first]]
        if down:
            sa[np.repeat(base - 1, count) - place] = j
            pointer[c[first]] -= count
        else:
            sa[np.repeat(base, count) + place] = j
            pointer[c[first]] += count

    for c in symbols:
        at = starts[c]
        while at < head[c]:  # larger suffixes of this symbol, also those that this sweep adds
            block = sa[at : head[c]]
            at = head[c]
            j = block[block > 0] - 1
            j = j[~smaller[j]]
            if len(j):
                put(j, head, False)
        j = sa[tail[c] - size[c] : tail[c]]
        j = j[j > 0] - 1
        j = j[~smaller[j]]
        if len(j):
            put(j, head, False)
    bottom = starts[1:].copy()
    for c in reversed(symbols):
        at = starts[c + 1]
        while at > bottom[c]:
            block = sa[bottom[c] : at][::-1]
            at = bottom[c]
            j = block[block > 0] - 1
            j = j[smaller[j]]
            if len(j):
                put(j, bottom, True)
        j = sa[starts[c] : head[c]][::-1]
        j = j[j > 0] - 1
        j = j[smaller[j]]
        if len(j):
            put(j, bottom, True)
    return sa


def _sort_names(names: np.ndarray, pairs: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names, by up to 2 ** pairs names: pairs of names get names, recursively.

    names: the rank of each, as the place of the first that ties. Only ties are looked at again.
    """
    group = np.flatnonzero(np.bincount(names, minlength=len(names) + 1)[names] > 1)
    rank, step, n = names.copy(), 1, len(names)
    for _ in range(pairs):
        if not len(group):
            break
        further = group + step
        second = np.where(further < n, rank[np.minimum(further, n - 1)], -1)
        o = np.argsort(rank[group] * (n + 1) + second)
        group, second = group[o], second[o]
        first, place = rank[group], np.arange(len(group))
        new = np.r_[True, first[1:] != first[:-1]]
        cut = new | np.r_[True, second[1:] != second[:-1]]
        rank[group] = first + np.maximum.accumulate(np.where(cut, place, 0)) - np.maximum.accumulate(np.where(new, place, 0))
        group = group[~cut | np.r_[~cut[1:], False]]
        step *= 2
    return rank


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t in order of their first `depth` symbols at least. The last symbol must be the smallest, and unique."""
    t = t.astype(np.uint16, copy=False)  # 16 bits, so that numpy sorts by radix
    n = len(t)
    if n < 2:
        return np.arange(n)
    # smaller than the right neighbour: by the next symbol that differs
    differ = np.flatnonzero(np.r_[t[1:] != t[:-1], True])
    to = differ[np.searchsorted(differ, np.arange(n))]
    smaller = np.ones(n, bool)
    inner = to < n - 1
    smaller[inner] = t[to[inner]] < t[to[inner] + 1]
    smaller[(to == n - 1)] = False
    smaller[n - 1] = True
    lms = np.flatnonzero(smaller & np.r_[False, ~smaller[:-1]])
    count = np.bincount(t, minlength=int(t.max()) + 1)
    starts = np.concatenate([[0], np.cumsum(count)])
    symbols = np.flatnonzero(count).tolist()
    by_symbol = lms[np.argsort(t[lms], kind="stable")]
    sa = _induce(t, smaller, starts, symbols, by_symbol)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    # equal substrings, from one leftmost-smaller suffix to the next, get equal names
    end = np.r_[lms[1:] + 1, n]
    key = tk.span_hash(t, lms, end)
    number = np.full(n, -1, np.int64)
    number[lms] = np.arange(len(lms))
    k = number[ordered]
    same = np.r_[False, key[k][1:] == key[k][:-1]]
    names = np.empty(len(lms), np.int64)
    names[k] = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
    if same.any():
        names = _sort_names(names, max(1, int(depth / 2).bit_length()))
        ordered = lms[np.argsort(names, kind="stable")]
    return _induce(t, smaller, starts, symbols, ordered)


def common_prefixes(t: np.ndarray, sa: np.ndarray, room: np.ndarray, least: int = 0) -> np.ndarray:
    """For each entry of sa, the prefix it shares with the one before, within `room` symbols from each place.

    In text order: a place whose left symbol and left neighbour in the array go along is one shorter than
    the place before; only the others are measured. Places with room for less than `least` count as 0.
    """
    n = len(t)
    before = np.full(n, -1, np.int32)
    fit = room >= least
    ok = fit[sa[1:]] & fit[sa[:-1]]
    before[sa[1:][ok]] = sa[:-1][ok]
    at = np.flatnonzero(before >= 0)
    p = before[at]
    chain = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
    chain = chain[p[chain] == p[chain - 1] + 1]
    x, y = at[chain], p[chain]
    chain = chain[(t[x - 1] == t[y - 1]) & (room[x - 1] == room[x] + 1) & (room[y - 1] == room[y] + 1)]
    along = np.zeros(len(at), bool)
    along[chain] = True
    a, b = at[~along], p[~along]
    most = np.minimum(room[a], room[b])
    size = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    pad = np.concatenate([t.astype(np.uint16, copy=False), np.zeros(8, np.uint16)])
    wide = np.ndarray((len(pad) - 3,), "<u8", pad.data, strides=(2,))  # four symbols from each place
    while len(live):
        equal = wide[a[live] + size[live]] == wide[b[live] + size[live]]
        size[live[equal]] += 4
        odd = live[~equal]
        for _ in range(3):
            odd = odd[pad[a[odd] + size[odd]] == pad[b[odd] + size[odd]]]
            size[odd] += 1
        live = live[equal]
        live = live[size[live] < most[live]]
    size = np.minimum(size, most)
    head = np.cumsum(~along) - 1
    lcp = np.zeros(n, np.int32)
    lcp[at] = size[head] - (at - a[head])
    return lcp[sa]


def _resolve(table: pa.Table, length: int) -> pa.Table:
    """Sorts a shard's stretches and answers each group with (row, first window, last window) of what starts earlier elsewhere."""
    place, ids, rows, starts, keys = [], [], [], [], []
    number: dict[bytes, int] = {}  # stretches that several groups sent are sorted once
    for key, x in zip(table.column("_key").to_pylist(), table.column("_data").to_pylist()):
        m = int(np.frombuffer(x, np.uint32, 1)[0])
        sizes = np.frombuffer(x, np.uint16, m, 4)
        at = 4 + 2 * m
        for out, kind in ((ids, np.int64), (rows, np.uint32), (starts, np.uint32)):
            width = np.dtype(kind).itemsize * m
            out.append(tk.unplanes(x[at : at + width], kind).astype(np.int64))
            at += width
        ends = (at + np.cumsum(sizes, dtype=np.int64)).tolist()
        place.append(np.array([number.setdefault(x[a:b], len(number)) for a, b in zip([at, *ends], ends)], np.int64))
        keys.append(np.full(m, key))
    place, ids, rows, starts, keys = (np.concatenate(x) for x in (place, ids, rows, starts, keys))
    sizes = np.array([len(x) for x in number])
    counts = np.bincount(place)
    m = len(sizes)
    order = np.lexsort((starts, ids, place))
    place, ids, rows, starts, keys = (x[order] for x in (place, ids, rows, starts, keys))
    head = np.cumsum(counts) - counts  # each stretch's earliest place
    later = np.ones(len(ids), bool)
    later[head] = False
    later &= (ids != ids[head][place]) | (starts != starts[head][place])
    # the string: bytes + 2, a 1 after each stretch, a 0 at the end
    ends = np.cumsum(sizes + 1)
    t = np.ones(int(ends[-1]) + 1, np.uint16)
    inside = np.ones(len(t), bool)
    inside[ends - 1] = False
    inside[-1] = False
    t[inside] = np.frombuffer(b"".join(number), np.uint8).astype(np.uint16) + np.uint16(2)
    t[-1] = 0
    owner = np.repeat(np.arange(m), sizes + 1)
    room = np.concatenate([np.repeat(ends - 1, sizes + 1) - np.arange(len(t) - 1), [0]])
    sa = suffix_array(t, length)
    near = common_prefixes(t, sa, room, length) >= length
    group = np.cumsum(~near)
    tied = near | np.r_[near[1:], False]
    w, g = sa[tied], group[tied]
    o = owner[w]
    offset = w - (ends - 1 - sizes)[o]
    who, when = ids[head][o], starts[head][o] + offset
    k = np.lexsort((when, who, g))
    w, g, o, offset, who, when = (x[k] for x in (w, g, o, offset, who, when))
    first = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]][: len(g)], np.arange(len(g)), 0))
    gone = (who != who[first]) | (when != when[first])
    o, offset = o[gone], offset[gone]
    k = np.lexsort((offset, o))
    o, offset = o[k], offset[k]
    cut = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (offset[1:] != offset[:-1] + 1)][: len(o)])
    last = np.r_[cut[1:], len(o)] - 1
    o, a, b = o[cut], offset[cut], offset[last[: len(cut)]]
    late = np.flatnonzero(later)
    stretch = place[late]
    all_keys = np.r_[keys[head][o], keys[late]]
    all_rows = np.r_[rows[head][o], rows[late]]
    lo = np.r_[starts[head][o] + a, starts[late]]
    hi = np.r_[starts[head][o] + b, starts[late] + sizes[stretch] - length]
    k = np.argsort(all_keys, kind="stable")
    all_keys, all_rows, lo, hi = all_keys[k], all_rows[k], lo[k], hi[k]
    bucket = table.column("_bucket")[0].as_py()
    cut = np.flatnonzero(np.r_[True, all_keys[1:] != all_keys[:-1]][: len(all_keys)])
    return _rows([(bucket, int(all_keys[x]), tk.planes(all_rows[x:y].astype(np.uint32)) + tk.planes(lo[x:y].astype(np.uint32)) + tk.planes((hi[x:y] - lo[x:y]).astype(np.uint32))) for x, y in zip(cut, np.r_[cut[1:], len(all_keys)])])


OUT = "_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(table: pa.Table, answers: pa.Table, length: int) -> pa.Table:
    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.binary()]
    if not len(table):
        return pa.table([pa.array([], k) for k in kinds], names=names)
    group = _Group(table, length)
    found = [[np.zeros(0, np.int64)] * 3]
    for x in answers.column("_data").to_pylist():
        third = len(x) // 3
        r, a, d = (tk.unplanes(x[i * third : (i + 1) * third], np.uint32).astype(np.int64) for i in range(3))
        found.append([r, a, a + d + length])
    keys, leads = [np.zeros(0, np.uint64)], [[np.zeros(0, np.int64)] * 3]
    for _, _, key, _, size, row, start, lead in group.stretches():  # what the group holds earlier itself
        found.append(_union(row[~lead], start[~lead], (start + size)[~lead]))
        keys.append(key[lead])
        leads.append([row[lead], start[lead], (start + size)[lead]])
    later = ~_first_of(np.concatenate(keys))
    found.append([np.concatenate(x)[later] for x in zip(*leads)])
    row, lo, hi = _union(*(np.concatenate(x) for x in zip(*found)))
    span = np.searchsorted(row, np.arange(len(group.texts) + 1))
    n_bytes, n_removed, n_spans, kept = [], [], [], []
    for i, text in enumerate(group.texts):
        parts, at, removed, spans = [], 0, 0, 0
        for a, b in zip(lo[span[i] : span[i + 1]].tolist(), hi[span[i] : span[i + 1]].tolist()):
            if b <= at:
                continue
            if a > at or not spans:
                parts.append(text[at:a])
                spans += 1
                at = a
            removed += b - at
            at = b
        parts.append(text[at:])
        n_bytes.append(len(text))
        n_removed.append(removed)
        n_spans.append(spans)
        kept.append(b"".join(parts))
    ids = table.column("_id").combine_chunks().take(pa.array(group.order))
    return pa.table([ids, *(pa.array(x, k) for x, k in zip((n_bytes, n_removed, n_spans, kept), kinds[1:]))], names=names)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, group_mb: float = 5, shards_a_group: int = 3, one_hop: int = tk.ONE_HOP) -> DataFrame:
    """A row for each input row: id, n_bytes, n_removed, n_spans, kept (the bytes left)."""
    if length < 2 * _K:
        raise ValueError(f"length must be {2 * _K} at least")
    groups = tk.group_count(df, group_mb)
    shards = groups * shards_a_group
    texts = tk.dealt(df.select(F.col(id_col).cast("long").alias("_id"), tk.text_expr(text_col).alias("_text")), groups, "_id", "_text")
    x = tk.Exchange(groups, shards, one_hop)
    grouped = texts.groupBy("_key")
    asked = x.relay(grouped.applyInArrow(lambda t: x.send(_ask(t, length, shards), "_bucket"), tk.PACK), "_bucket")
    met = x.relay(asked.groupBy("_bucket").applyInArrow(lambda t: x.send(_meet(x.receive(t, "_bucket")), "_key"), tk.PACK), "_key")
    sent = grouped.cogroup(met.groupBy("_key")).applyInArrow(lambda t, a: x.send(_send(t, x.receive(a, "_key"), length, shards), "_bucket"), tk.PACK)
    earlier = x.relay(sent, "_bucket").groupBy("_bucket").applyInArrow(lambda t: x.send(_resolve(x.receive(t, "_bucket"), length), "_key"), tk.PACK)
    return grouped.cogroup(x.relay(earlier, "_key").groupBy("_key")).applyInArrow(lambda t, a: _cut(t, x.receive(a, "_key"), length), OUT).withColumnRenamed("_id", id_col)


def sha256_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op3(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
