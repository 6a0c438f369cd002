"""A small causal self-attention language model in numpy, over compact subword ids.

One attention layer looks back over a window of `WINDOW` ids; windows overlap by `BACK` and each id is scored
once, by the window in which it has `BACK` ids or more before it (or all its text has). The next id is
predicted as a class and a member of it, so that an id costs two short softmaxes. Whether the id before
ended a word chooses the output biases, which begin as the logarithms of counts.
Ids: 0 pads, 1 begins a text, 2 ends it, 3 to 6 stand for rare subwords (3, and 1 more if it ends its word, 2 more
if it begins it); the others by frequency.
"""

from __future__ import annotations

import ctypes
import math
from functools import lru_cache

import numpy as np

WINDOW, BACK = 32, 8
STEP = WINDOW - BACK
PAD, BEGIN, END, RARE = range(4)
FIRST = RARE + 4  # of the ids by frequency
_F = np.float32


@lru_cache(1)
def keep_room() -> bool:
    """Lets glibc keep up to 16 MB of freed memory, so that arrays of under 1 MB, made anew by each step, cost no page faults; False elsewhere."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError, TypeError):
        return False
    trim, mmap = -1, -3  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
    return bool(mallopt(mmap, 1 << 20) and mallopt(trim, 16 << 20))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    x /= x.sum(-1, keepdims=True)
    return x


def windows_of(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, texts' padded starts): rows of WINDOW ids and of the STEP next ids that each scores.

    ids: the texts' ids end to end, each with its END; sizes: of each text.
    """
    rows = -(-sizes // STEP)
    first = np.cumsum(rows) - rows
    total = int(rows.sum())
    start = np.cumsum(sizes) - sizes
    place = np.repeat(first * STEP - start, sizes) + np.arange(len(ids))
    target = np.zeros(total * STEP, np.int32)
    target[place] = ids
    before = np.zeros(total * STEP + BACK, np.int32)  # inputs: BEGIN, then each id one later
    own = before[BACK:]
    own[first * STEP] = BEGIN
    inner = np.ones(len(ids), bool)
    inner[start + sizes - 1] = False
    own[place[inner] + 1] = ids[inner]
    x = np.lib.stride_tricks.sliding_window_view(before, WINDOW)[::STEP]
    x = x[:total].copy()
    x[first, :BACK] = PAD  # a text sees nothing of the one before
    return x, target.reshape(total, STEP), place


class Model:
    def __init__(self, vocabulary: int, members: int = 40, width: int = 16, hidden: int = 32, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.v, self.b, self.d, self.h = vocabulary, members, width, hidden
        self.a = -(-vocabulary // members)
        n = lambda *s, scale=0.1: (rng.standard_normal(s) * scale).astype(_F)
        self.p = {
            "E": n(vocabulary, width, scale=0.3), "P": n(WINDOW, width), "Q": n(width, width, scale=0.25), "K": n(width, width, scale=0.25), "V": n(width, width, scale=0.25),
            "O": n(width, hidden, scale=0.25), "T": n(vocabulary, hidden, scale=0.1), "t": np.full(hidden, 0.1, _F), "C": n(hidden, self.a, scale=0.03), "c": np.zeros((2, self.a), _F),
            "M": n(self.a, hidden, members, scale=0.03), "m": np.zeros((2, self.a, members), _F),
        }
        self.kind = np.zeros(vocabulary, np.int64)  # 1: the id ends its word
        self.kind[[BEGIN, RARE + 1, RARE + 3]] = 1
        last = vocabulary - (self.a - 1) * members
        self.off = np.zeros((self.a, members), _F)
        self.off[-1, last:] = -1e9  # members that the last class lacks
        self.causal = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), 0, -1e9).astype(_F)

    def begin(self, kind: np.ndarray, counts: np.ndarray) -> None:
        """The ids' kinds, and output biases from counts[kind of the id before, id]."""
        self.kind[: len(kind)] = kind
        share = np.zeros((2, self.a * self.b))
        share[:, : self.v] = counts + 0.01
        share = share.reshape(2, self.a, self.b)
        by_class = share.sum(2)
        self.p["c"] = np.log(by_class / by_class.sum(1, keepdims=True)).astype(_F)
        self.p["m"] = np.log(np.maximum(share / by_class[:, :, None], 1e-12)).astype(_F)

    def _attend(self, x: np.ndarray):
        p = self.p
        e = p["E"][x] + p["P"]
        q, k, v = e @ p["Q"], e @ p["K"], e @ p["V"]
        s = q @ k.transpose(0, 2, 1)
        s *= self.d**-0.5
        s += self.causal
        pads = np.flatnonzero(x[:, BACK - 1] == PAD)
        if len(pads):  # only windows at a text's start hold pads before their ids
            s[pads] += np.where(x[pads] == PAD, -1e9, 0).astype(_F)[:, None, :]
        w = _softmax(s)
        return e, q, k, v, w, w @ v

    def log_probs(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target of each window."""
        keep_room()
        p, d = self.p, self.d
        out = np.empty(target.shape, _F)
        if not hasattr(self, "tables"):
            # a row's two last inputs tell the kind of the id before, so that the products add the biases
            members = np.concatenate([p["M"], (p["m"] + self.off).transpose(1, 0, 2)], axis=1)
            kinds = np.stack([1 - self.kind, self.kind], axis=1)
            told = np.concatenate([p["T"] + p["t"], kinds], axis=1, dtype=_F)
            o = np.concatenate([p["O"], np.zeros((d, 2))], axis=1, dtype=_F)
            self.tables = np.concatenate([p["Q"] * d**-0.5, p["K"], p["V"]], axis=1), np.concatenate([p["C"], p["c"]]), members, np.ones(self.a, _F), np.ones(self.b, _F), np.ones(WINDOW, _F), told, o
        qkv, classes, members, ones_a, ones_b, ones, told, mix = self.tables
        for i in range(0, len(x), 128):  # so few windows that what is computed stays near
            b = x[i : i + 128]
            n = len(b)
            e = p["E"].take(b.ravel(), axis=0).reshape(n, WINDOW, d)
            e += p["P"]
            own = (e.reshape(-1, d) @ qkv).reshape(n, WINDOW, 3 * d)
            s = own[:, BACK:, :d] @ own[:, :, d : 2 * d].transpose(0, 2, 1)
            s += self.causal[BACK:]
            pads = np.flatnonzero(b[:, BACK - 1] == PAD)
            if len(pads):
                s[pads] += np.where(b[pads] == PAD, -1e9, 0).astype(_F)[:, None, :]
            np.exp(s, out=s)  # scores are small: no maximum is taken off
            o = (s @ own[:, :, 2 * d :]).reshape(-1, d)
            o *= (1 / (s.reshape(-1, WINDOW) @ ones))[:, None]
            t = target[i : i + 128].ravel()
            a = t // self.b
            order = np.argsort(a.astype(np.uint8 if self.a < 256 else np.int32), kind="stable")  # rows by class
            t, a = t[order], a[order]
            u = o.take(order, axis=0) @ mix
            u += told.take(b[:, BACK:].ravel()[order], axis=0)
            np.maximum(u, 0, out=u)
            z = u @ classes
            rows = np.arange(len(t))
            got = z.ravel().take(rows * self.a + a)
            np.exp(z, out=z)
            y = np.empty((len(t), self.b), _F)
            for c, lo, hi in self._runs(a):
                np.matmul(u[lo:hi], members[c], out=y[lo:hi])
            got += y.ravel().take(rows * self.b + (t - a * self.b))
            np.exp(y, out=y)
            got -= np.log((z @ ones_a) * (y @ ones_b))
            flat = np.empty(len(t), _F)
            flat[order] = got
            out[i : i + 128] = flat.reshape(-1, STEP)
        return out

    @staticmethod
    def _runs(a: np.ndarray):
        """(class, from, to) of the runs of sorted classes."""
        cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
        return zip(a[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(a)])

    def offset(self) -> np.ndarray:
        """Biases of the members: a row for each kind and class."""
        return (self.p["m"] + self.off).reshape(2 * self.a, self.b)

    def step(self, x: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """(mean loss, gradients) of a batch."""
        p, g = self.p, {}
        e, q, k, v, w, o = self._attend(x)
        n = len(x)
        order = np.argsort(target.ravel() // self.b, kind="stable")  # rows by class
        t = target.ravel()[order]
        inp = x[:, BACK:].ravel()[order]
        base = o[:, BACK:].reshape(-1, self.d)[order]
        live = t != PAD
        count = max(int(live.sum()), 1)
        pre = base @ p["O"] + p["T"][inp] + p["t"]
        u = np.maximum(pre, 0)
        a, m = t // self.b, t % self.b
        rows = np.arange(len(t))
        kind = self.kind[inp]
        both = kind * self.a + a
        dc = _softmax(u @ p["C"] + p["c"][kind])
        y = self.offset()[both]
        for c, lo, hi in self._runs(a):
            y[lo:hi] += u[lo:hi] @ p["M"][c]
        dm = _softmax(y)
        loss = -(np.log(dc[rows, a] + 1e-12) + np.log(dm[rows, m] + 1e-12))[live].sum() / count
        scale = (live / count).astype(_F)[:, None]
        dc[rows, a] -= 1
        dm[rows, m] -= 1
        dc *= scale
        dm *= scale
        g["C"], g["c"] = u.T @ dc, np.stack([dc[kind == 0].sum(0), dc[kind == 1].sum(0)])
        du = dc @ p["C"].T
        g["M"] = np.zeros_like(p["M"])
        for c, lo, hi in self._runs(a):
            g["M"][c] = u[lo:hi].T @ dm[lo:hi]
            du[lo:hi] += dm[lo:hi] @ p["M"][c].T
        g["m"] = np.zeros_like(p["m"]).reshape(2 * self.a, self.b)
        for ended in (0, 1):  # rows are in the order of classes
            own = np.flatnonzero(kind == ended)
            cut = np.flatnonzero(np.r_[True, a[own][1:] != a[own][:-1]][: len(own)])
            if len(own):
                g["m"][both[own][cut]] = np.add.reduceat(dm[own], cut, axis=0)
        g["m"] = g["m"].reshape(p["m"].shape)
        du *= pre > 0
        g["t"] = du.sum(0)
        g["T"] = self._scatter(inp, du, self.h)
        g["O"] = base.T @ du
        back = np.empty((len(t), self.d), du.dtype)
        back[order] = du @ p["O"].T
        do = np.zeros((n, WINDOW, self.d), du.dtype)
        do[:, BACK:] = back.reshape(n, STEP, self.d)
        dw = do @ v.transpose(0, 2, 1)
        dv = w.transpose(0, 2, 1) @ do
        ds = w * (dw - (dw * w).sum(-1, keepdims=True)) * self.d**-0.5
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        flat = lambda z: z.reshape(-1, self.d)
        for name, dz in (("Q", dq), ("K", dk), ("V", dv)):
            g[name] = flat(e).T @ flat(dz)
        de = dq @ p["Q"].T + dk @ p["K"].T + dv @ p["V"].T
        g["P"] = de.sum(0)
        g["E"] = self._scatter(x.ravel(), flat(de), self.d)
        return float(loss), g

    def _scatter(self, ids: np.ndarray, d: np.ndarray, width: int) -> np.ndarray:
        order = np.argsort(ids, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
        out = np.zeros((self.v, width), _F)
        out[ids[order][cut]] = np.add.reduceat(d[order], cut, axis=0)
        return out

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 6) -> list[float]:
        rng, losses = np.random.default_rng(seed), []
        for k in range(epochs):
            order = rng.permutation(len(x))
            losses += self.descend(x[order], target[order], batch, rate * max(0.05, 1 - k / epochs), rate * max(0.05, 1 - (k + 1) / epochs))
        return losses

    def descend(self, x: np.ndarray, target: np.ndarray, batch: int, high: float, low: float) -> list[float]:
        """One pass in the order given, by Adam, at rates from `high` to `low`."""
        keep_room()
        own = _Pass(self)
        losses, total = [], -(-len(x) // batch)
        class_of = np.where(target == PAD, self.a, target // self.b).astype(np.uint8 if self.a < 255 else np.int32)
        for i in range(1, total + 1):
            rows = slice((i - 1) * batch, i * batch)
            loss = own.step(x[rows], target[rows], class_of[rows])
            losses.append(loss)
            own.move((high + (low - high) * i / total) * min(1, i / 10), i)
        own.end()
        return losses

    def packed(self) -> np.ndarray:
        """All parameters, end to end."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(_F)
            at += n
        self.__dict__.pop("tables", None)


class _Pass:
    """A pass over windows: the gradients of Model.step and Adam, with all parameters in one array and little copied.

    Tables that are read together lie together: E and T, Q, K and V, C and c, M and m (with the biases of members that
    the last class lacks). Rows without a target are left out, not multiplied by zero.
    """

    def __init__(self, model: Model):
        self.model, (d, h, a, b, v) = model, (model.d, model.h, model.a, model.b, model.v)
        shapes = {"ET": (v, d + h), "P": (WINDOW, d), "QKV": (d, 3 * d), "O": (d, h), "t": (h,), "C": (h + 2, a), "M": (a, h + 2, b)}
        size = sum(math.prod(s) for s in shapes.values())
        self.flat, self.grad, first, second = (np.zeros(size, _F) for _ in range(4))
        room = np.zeros(min(size, 16384), _F)
        cuts = [slice(i, min(i + len(room), size)) for i in range(0, size, len(room))]
        self.stretches = [(self.flat[c], self.grad[c], first[c], second[c], room[: c.stop - c.start]) for c in cuts]
        self.w, self.g, at = {}, {}, 0
        for k, s in shapes.items():
            for of, flat in ((self.w, self.flat), (self.g, self.grad)):
                of[k] = flat[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)
        views = self._views(self.w)
        for k, x in views.items():
            x[...] = model.p[k]
        views["m"] += model.off
        self.m, model.p = model.p["m"], views
        self.ends = model.kind.astype(_F)
        self.causal = np.ascontiguousarray(model.causal[BACK:])
        self.ones_a, self.ones_b = np.ones(a, _F), np.ones(b, _F)

    def _views(self, of: dict) -> dict:
        """The model's parameters (or their gradients) by name."""
        d, h = self.model.d, self.model.h
        return {
            "E": of["ET"][:, :d], "T": of["ET"][:, d:], "P": of["P"], "Q": of["QKV"][:, :d], "K": of["QKV"][:, d : 2 * d], "V": of["QKV"][:, 2 * d :], "O": of["O"], "t": of["t"],
            "C": of["C"][:h], "c": of["C"][h:], "M": of["M"][:, :h], "m": of["M"][:, h:].transpose(1, 0, 2),
        }

    def step(self, x: np.ndarray, target: np.ndarray, class_of: np.ndarray) -> float:
        """The mean loss; gradients go to self.grad."""
        with np.errstate(all="ignore"):
            loss = self._step(x, target, class_of)
        if not math.isfinite(loss):  # scores too large to go without their maximum
            loss, g = self.model.step(x, target)
            for k, to in self._views(self.g).items():
                to[...] = g[k]
        return loss

    def _step(self, x: np.ndarray, target: np.ndarray, class_of: np.ndarray) -> float:
        model, w, g = self.model, self.w, self.g
        n, d, h = len(x), model.d, model.h
        self.grad[:] = 0
        flat = x.ravel()
        et = w["ET"].take(flat, axis=0)
        e = (et[:, :d].reshape(n, WINDOW, d) + w["P"]).reshape(-1, d)
        qkv = (e @ w["QKV"]).reshape(n, WINDOW, 3 * d)
        q, k, v = qkv[:, BACK:, :d], qkv[:, :, d : 2 * d], qkv[:, :, 2 * d :]
        s = q @ k.transpose(0, 2, 1)
        s *= _F(d**-0.5)
        s += self.causal
        pads = np.flatnonzero(x[:, BACK - 1] == PAD)
        if len(pads):
            s[pads] += np.where(x[pads] == PAD, -1e9, 0).astype(_F)[:, None, :]
        np.exp(s, out=s)
        s *= 1 / (s.reshape(-1, WINDOW) @ np.ones(WINDOW, _F)).reshape(n, STEP, 1)
        o = (s @ v).reshape(-1, d)

        order = np.argsort(class_of.ravel(), kind="stable")  # rows by class, those without a target last
        per = np.bincount(class_of.ravel(), minlength=model.a + 1)
        live = len(order) - int(per[-1])
        order = order[:live]
        place = order + BACK * (order // STEP + 1)  # of the inputs
        t = target.ravel()[order]
        a = class_of.ravel()[order].astype(np.int64)
        m = t - a * model.b
        base = o.take(order, axis=0)
        u = np.empty((live, h + 2), _F)
        told = base @ w["O"]
        told += et.take(place, axis=0)[:, d:]
        told += w["t"]
        u[:, :h] = told
        u[:, h + 1] = self.ends[flat[place]]
        u[:, h] = 1 - u[:, h + 1]
        np.maximum(u, 0, out=u)
        z = u @ w["C"]
        y = np.empty((live, model.b), _F)
        ends = np.cumsum(per[:-1])
        runs = [(c, hi - size, hi) for c, (size, hi) in enumerate(zip(per[:-1].tolist(), ends.tolist())) if size]
        for c, lo, hi in runs:
            np.matmul(u[lo:hi], w["M"][c], out=y[lo:hi])
        share, rows, loss = _F(1 / max(live, 1)), np.arange(live), 0.0
        for scores, own, ones in ((z, a, self.ones_a), (y, m, self.ones_b)):
            np.exp(scores, out=scores)
            by = 1 / (scores @ ones)
            at = rows * len(ones) + own
            got = scores.ravel().take(at) * by
            scores *= (by * share)[:, None]
            scores.ravel()[at] = (got - 1) * share
            loss -= float(np.log(got + _F(1e-12)).sum())

        np.matmul(u.T, z, out=g["C"])
        du = z @ w["C"][:h].T
        for c, lo, hi in runs:
            np.matmul(u[lo:hi].T, y[lo:hi], out=g["M"][c])
            np.matmul(y[lo:hi], w["M"][c, :h].T, out=told[lo:hi])
        du += told
        du *= u[:, :h] > 0
        g["t"][:] = np.ones(live, _F) @ du
        np.matmul(base.T, du, out=g["O"])
        do = np.zeros((n * STEP, d), _F)
        do[order] = du @ w["O"].T
        do = do.reshape(n, STEP, d)
        dw = do @ v.transpose(0, 2, 1)
        dw *= s
        dw -= s * (dw.reshape(-1, WINDOW) @ np.ones(WINDOW, _F)).reshape(n, STEP, 1)
        dw *= _F(d**-0.5)
        back = np.empty((n, WINDOW, 3 * d), _F)
        back[:, :BACK, :d] = 0
        np.matmul(dw, k, out=back[:, BACK:, :d])
        np.matmul(dw.transpose(0, 2, 1), q, out=back[:, :, d : 2 * d])
        np.matmul(s.transpose(0, 2, 1), do, out=back[:, :, 2 * d :])
        back = back.reshape(-1, 3 * d)
        np.matmul(e.T, back, out=g["QKV"])
        both = np.zeros((n * WINDOW, d + h), _F)
        np.matmul(back, w["QKV"].T, out=both[:, :d])
        both[place, d:] = du
        g["P"][:] = both[:, :d].reshape(n, WINDOW, d).sum(0)
        order = np.argsort(flat.astype(np.int16) if model.v < 2**15 else flat, kind="stable")
        ids = flat[order]
        cut = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        g["ET"][ids[cut]] = np.add.reduceat(both.take(order, axis=0), cut, axis=0)
        return loss * float(share)

    def move(self, rate: float, i: int) -> None:
        """Step i of Adam, a stretch at a time; the moments are kept ten and a hundred times as large."""
        by = math.sqrt(0.01 / (1 - 0.99**i))
        least, rate = _F(1e-8 / by), _F(rate * 0.1 / (1 - 0.9**i) / by)
        for p, g, first, second, room in self.stretches:
            first *= _F(0.9)
            first += g
            second *= _F(0.99)
            np.multiply(g, g, out=g)
            second += g
            np.sqrt(second, out=room)
            room += least
            np.divide(first, room, out=room)
            room *= rate
            p -= room

    def end(self) -> None:
        """The model's parameters as arrays of their own again."""
        lacked = np.broadcast_to(self.model.off < 0, self.m.shape)
        self.model.p["m"][lacked] = self.m[lacked]
        self.model.p = {k: np.array(x, order="C") for k, x in self.model.p.items()}
        self.model.__dict__.pop("tables", None)
