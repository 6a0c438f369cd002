"""Personal data by candidate gradient boosting.

Base kinds (email, ip, card, phone) are exact patterns with checks, leftmost and non-overlapping by kind.
Beside them, high-recall generators propose overlapping spans of further kinds: secrets (assigned or free
tokens), addresses spelt out ("name at host dot org"), phone numbers without a country code, card numbers
with other separators, identity and bank account numbers. Boosted trees judge each candidate by its format
(length, character classes, entropy, separators, check digits) and its context (words and marks before and
after). A threshold for each kind, on calibrated probabilities, is set on examples held out for that, for a precision
of `precision`; `Judge.held_out` is measured on yet others. Of overlapping spans that pass, the likeliest stays; base spans always stay.

No labelled spans exist, so the trees are trained on the driver on generated examples: a fixed seed, templates
of each kind and of what looks like it, `EXAMPLES` a kind. Nothing is taken from the corpus, so nothing
grows with it; texts are scanned whole, in one pass without shuffle.

Defined cases: null text has no spans; empty texts give counts of zero, an empty span list and the hash of
the empty string; offsets are code points; rows are judged one by one, so ties and repeats don't matter;
columns other than the two named are ignored (or, in `redact`, kept as they are), whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .boosting import Calibrated, Trees, sigmoid  # noqa: F401

#: The base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Generators that start from a rare mark and look back, so that no run of characters is read twice.
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)*+")
_LABEL = frozenset(string.ascii_letters + "_-")
_NAMES = re.compile(r"key|token|secret|passw(?:or)?d|pwd|credential|auth", re.I)
_VALUE = re.compile(r"\s{0,3}['\"]?([A-Za-z0-9+/_.=-]{8,})")
_AT = re.compile(r"(?:\[at\]|\(at\)|\{at\}| at )", re.I)
_SPELT = re.compile(r"(?i:\[at\]|\(at\)|\{at\}| at )\s?[A-Za-z0-9-]{1,63}(?:\s?(?i:\[dot\]|\(dot\)|\{dot\}| dot )\s?[A-Za-z0-9-]{1,63}){1,4}")
MORE = {
    "secret": [re.compile(r"(?<![A-Za-z0-9+/_-])((?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}={0,2})"), re.compile(r"\b((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9-]{20,})")],
    "spelt_email": [],
    "local_phone": [re.compile(r"(?<![0-9+.-])(\(?0?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ ./-][0-9]{3,4})(?![0-9.-]*[0-9])")],
    "long_card": [re.compile(r"(?<![0-9])((?:[0-9]{4}[ ./_-]){3}[0-9]{1,7})(?![0-9])")],
    "national_id": [re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")],
    "iban": [re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")],
}
KINDS = [*BASE, *MORE]
_NEED = re.compile(r"[0-9@+=:\[({]|AKIA|(?i: dot )")
EXAMPLES = 500
_HINTS = [re.compile(x, re.I) for x in (r"key|token|secret|passw|auth|credential", r"phone|tel|call|fax|mobile|whatsapp", r"card|visa|credit|master|pay", r"mail|contact|write|reach", r"ssn|social|identity|national", r"iban|account|bank|transfer", r"isbn|issn|doi|version|commit|sha|hash|md5|build|page|vol|order|serial|invoice|part|http|/")]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _back(text: str, at: int, chars: frozenset, least: int) -> int:
    """Where the run of chars that ends at `at` begins, `least` at the earliest."""
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base patterns' matches. Emails are found from their @, addresses from whole chains of numbers, which gives the same."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    at, done = text.find("@"), 0
    while at >= 0:
        begin = _back(text, at, _LOCAL, done)
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out["email"].append((begin, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    if "." in text:
        for m in _CHAIN.finditer(text):
            parts = m[0].split(".")
            begin = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = begin + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out["ip"].append((begin, end))
                begin = end + 1
    for m in BASE["card"].finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in BASE["phone"].finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


def candidates(text: str):
    """(kind, start, end), overlapping, each once."""
    seen, done, top = set(), 0, 0
    for m in re.finditer("[:=]", text):  # a value that a name is assigned
        at = m.start()
        if at < done:
            continue
        end = at
        while end > top and at - end < 3 and text[end - 1].isspace():
            end -= 1
        if end > top and text[end - 1] in "'\"":
            end -= 1
        begin = _back(text, end, _LABEL, top)
        top = at  # a name has no mark in it, so nothing is read again
        if begin < end and _NAMES.search(text, begin, end) and (v := _VALUE.match(text, m.end())):
            seen.add(("secret", *v.span(1)))
            done = v.end()
    done = 0
    for m in _AT.finditer(text):
        end = m.start()
        if end > done and text[end - 1].isspace():
            end -= 1
        begin = _back(text, end, _LOCAL, max(done, end - 64))
        if begin < end and (v := _SPELT.match(text, m.start())):
            seen.add(("spelt_email", begin, v.end()))
            done = v.end()
    for kind, patterns in MORE.items():
        for p in patterns:
            for m in p.finditer(text):
                seen.add((kind, *m.span(1)))
    return sorted(seen)


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a candidate."""
    s = text[start:end]
    before, after = text[max(0, start - 32) : start], text[end : end + 12]
    n = len(s)
    digits = re.sub(r"\D", "", s)
    letters = sum(c.isalpha() for c in s)
    upper = sum(c.isupper() for c in s)
    seps = re.findall(r"[ ./_-]", s)
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    groups = re.findall(r"[0-9]+", s)
    return [
        float(KINDS.index(kind)), n, len(digits), len(digits) / n, letters / n, upper / max(letters, 1), len(seps), len(set(seps)), entropy, switches / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))), float(luhn(digits)) if digits else 0.0, float(len(groups)), float(len(groups[0])) if groups else 0.0, float(len(groups[-1])) if groups else 0.0,
        float(before[-1:] in "\"'`"), float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(before[-1:].isspace() or not before), float(before[-1:].isdigit()), float(after[:1] in "\"'`" and bool(after)),
        float(not after or after[0].isspace()), float("(" in s or "[" in s), *(float(bool(h.search(before))) for h in _HINTS),
    ]


def _generated(rng: random.Random):
    """(text, kind, start, end, is personal) for made-up examples of each kind and of what resembles it."""
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 10)))
    chars = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    num = lambda n: chars(string.digits, n)
    some = lambda: " ".join(word() for _ in range(rng.randint(1, 6)))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    quad = lambda d, sep: sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    hexa = "0123456789abcdef"
    for _ in range(EXAMPLES):
        q = rng.choice(['"', "'", ""])
        secret = rng.choice([chars(hexa, rng.choice([32, 36, 40, 64])), chars(string.ascii_letters + string.digits, rng.randint(20, 48)), "AKIA" + chars(string.ascii_uppercase + string.digits, 16), "ghp_" + chars(string.ascii_letters + string.digits, 36)])
        label = rng.choice(["token", "api_key", "API_KEY", "secret", "password", "access_token", "auth_token", "TOKEN", "client_secret", "passwd"])
        if rng.random() < 0.2:
            secret = secret.upper()
        yield (f"{some()} {label}{rng.choice([' = ', '=', ': ', ':'])}{q}", secret, f"{q} {some()}", "secret", 1)
        yield (f"{some()} {rng.choice(['password', 'token', 'key', 'secret'])}{rng.choice([' = ', ': '])}", rng.choice([word() + word(), "undefined", "required", "get_" + word() + "_" + word()])[:24].ljust(8, "x"), f" {some()}", "secret", 0)
        yield (f"{some()} {rng.choice(['commit', 'sha', 'http://' + word() + '/', 'build', 'page', 'file', word()])} ", rng.choice([word() + "-" + word() + "-" + num(2) + "-" + word() + word() + word(), word() + "/" + word() + "/" + word() + num(1) + "/" + word() + word() + word()]).ljust(24, "a"), f" {some()}", "secret", 0)
        at, dot = rng.choice([("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), (" [at] ", " [dot] ")])
        yield (f"{some()} ", f"{word()}.{num(2)}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}", f" {some()}", "spelt_email", 1)
        yield (f"{some()} ", f"{word()} at {word()} dot {word()} dot {word()}", f" {some()}", "spelt_email", 0)
        tail = rng.choice([num(3) + " " + num(4), num(3) + "-" + num(4)])
        yield (f"{some()} {rng.choice(['phone', 'tel.', 'call', 'mobile:', 'fax', ''])} ", rng.choice([f"({num(3)}) {tail}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}"]), f" {some()}", "local_phone", 1)
        yield (f"{some()} {rng.choice(['version', 'pages', 'order', 'isbn', 'vol.', 'serial', word()])} ", rng.choice([f"{num(2)}/{num(3)}/{num(4)}", f"{num(4)} {num(4)} {num(4)}", f"{num(2)}.{num(3)}.{num(3)}"]), f" {some()}", "local_phone", 0)
        yield (f"{some()} {rng.choice(['card', 'visa', 'paid with', ''])} ", quad(card(), rng.choice([".", "/", "_"])), f" {some()}", "long_card", 1)
        yield (f"{some()} {rng.choice(['order', 'serial', 'page', word()])} ", quad(num(16), rng.choice([".", "/", "_", " ", "-"])), f" {some()}", "long_card", 0)
        yield (f"{some()} {rng.choice(['ssn', 'social security', 'national id', ''])} ", f"{num(3)}-{num(2)}-{num(4)}", f" {some()}", "national_id", 1)
        yield (f"{some()} {rng.choice(['order', 'part no', 'isbn', 'serial'])} ", f"{num(3)}-{num(2)}-{num(4)}", f" {some()}", "national_id", 0)
        country = rng.choice(["DE", "FR", "GB", "ES", "NL"])
        yield (f"{some()} {rng.choice(['iban', 'account', 'transfer to', ''])} ", f"{country}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", f" {some()}", "iban", 1)
        yield (f"{some()} {rng.choice(['serial', 'part', word()])} ", f"{chars(string.ascii_uppercase, 2)}{num(2)}{chars(string.ascii_uppercase, 4)}{chars(string.ascii_uppercase, 8)}", f" {some()}", "iban", 0)


class Judge:
    """The trees, their calibration and each kind's threshold."""

    def __init__(self, precision: float, seed: int = 20):
        x, y, kinds = [], [], []
        for before, span, after, kind, yes in _generated(random.Random(seed)):
            x.append(describe(before + span + after, kind, len(before), len(before) + len(span)))
            y.append(float(yes))
            kinds.append(kind)
        x, y, kinds = np.array(x), np.array(y), np.array(kinds)
        part = np.random.default_rng(seed).permutation(len(y)) % 10  # parts to fit, to calibrate, to choose thresholds and to test
        fit, tune, choose, test = part < 5, (part == 5) | (part == 6), (part == 7) | (part == 8), part == 9
        self.trees = Trees(rounds=30, depth=3).fit(x[fit], y[fit])
        self.calibrated = Calibrated().fit(self.trees.raw(x[tune]), y[tune])
        p = self.calibrated(self.trees.raw(x))
        self.thresholds = {}
        for kind in MORE:
            own = choose & (kinds == kind)
            levels = np.unique(np.r_[0.5, p[own][p[own] >= 0.5]])
            good = [t for t in levels if y[own & (p >= t)].mean() >= precision] if own.any() else []
            self.thresholds[kind] = float(good[0]) if good else 1.1
        self.held_out = {k: (float(y[test & (kinds == k) & (p >= t)].mean()), float((p[test & (kinds == k) & (y == 1)] >= t).mean())) for k, t in self.thresholds.items()}

    def __call__(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """Spans that pass; of overlapping ones the likeliest, none that overlaps `taken`."""
        found = candidates(text)
        if not found:
            return []
        p = self.calibrated(self.trees.raw(np.array([describe(text, *c) for c in found])))
        ranked = sorted((-q, a, -b, k) for q, (k, a, b) in zip(p.tolist(), found) if q >= self.thresholds[k])
        starts, ends, out = [], [], []  # of disjoint spans, ascending
        for a, b in sorted(taken):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        for _, a, b, kind in ranked:
            i = bisect_right(starts, a)
            if (i == 0 or ends[i - 1] <= a) and (i == len(starts) or starts[i] >= -b):
                starts.insert(i, a)
                ends.insert(i, -b)
                out.append((kind, a, -b))
        return out


def spans_of(text: str, judge: Judge) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """(base spans by kind, all spans by kind and start)"""
    if not _NEED.search(text):
        return {k: [] for k in BASE}, []
    base = base_spans(text)
    more = judge(text, [s for v in base.values() for s in v])
    own = [(k, *s) for k, v in base.items() for s in v]
    return base, own + sorted(more, key=lambda x: (KINDS.index(x[0]), x[1]))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95) -> DataFrame:
    """A row for each input row: id, counts and hash of the base spans, all spans."""
    judge = Judge(precision)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches):
        for b in tk.pieces(batches, "_text"):
            rows = [spans_of(t or "", judge) for t in b.column(1).to_pylist()]
            counts = [pa.array([len(base[k]) for base, _ in rows], pa.int64()) for k in BASE]
            sha = [hashlib.sha256(join((k, *s) for k, v in base.items() for s in v).encode()).hexdigest() for base, _ in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sha, pa.string()), pa.array([join(x) for _, x in rows], pa.string())], names=["_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    out = texts.mapInArrow(run, f"_id {dict(texts.dtypes)['_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("_id", id_col)


def redact(df: DataFrame, text_col: str = "text", precision: float = 0.95) -> DataFrame:
    """The rows of df with every span replaced by its kind in angle brackets; other columns as they are."""
    judge = Judge(precision)
    names = df.columns
    rows = df.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col(text_col).cast("string").alias("_text"))

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        _, spans = spans_of(text, judge)
        at, out = 0, []
        for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
            if b <= at:
                continue
            out += [text[at : max(a, at)], f"<{kind}>" if a >= at else ""]
            at = b
        return "".join([*out, text[at:]])

    def run(batches):
        for b in tk.pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([clean(t) for t in b.column(1).to_pylist()], pa.string())], names=["_row", "_text"])

    out = rows.mapInArrow(run, rows.schema)
    return out.select(*[F.col("_text").alias(n) if n == text_col else F.col(f"_row.`{n}`").alias(n) for n in names])


def op10(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
