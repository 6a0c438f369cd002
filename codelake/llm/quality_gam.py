"""Quality classifier: a generalised additive model with pairwise interactions (boosting.PairwiseGam).

Features come from the text alone: shares of character classes, word and line shapes, repetition (by
the suffix arrays of quality_rules). They are counted in numpy on Arrow buffers, whole texts, no shuffle;
a score is a sum of looked-up bins. The model is fitted on the driver on at most `max_train` labelled rows
(the smallest by hash of the id, so a rerun takes the same), which bounds what is collected: `max_train`
rows of len(FEATURES) numbers. Only the labels of those rows are broadcast, so that bound holds for them too.

Defined cases: null and empty texts have all features zero and get a score like any row; a null id is
scored and never trained on; null labels are not learnt from, of an id's labels the least; without any usable label every score is
0.5; ids that repeat are scored row by row, and no more than `max_train` of their rows are learnt from; columns other than those named are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .boosting import PairwiseGam
from .quality_rules import covered, repeats
from .textkit import U

FEATURES = (
    "log_words log_chars word_length upper digits symbols bangs bars stops commas high_bytes lines_a_word dup_lines"
    " repeat_5 repeat_longest equal_neighbours distinct long_words one_letter sentence_ends odd_ends"
).split()


def features(col: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    raw, off = tk.bytes_of(col)
    rows = len(off) - 1
    s, e, n = tk.word_bounds(raw, off)
    ends = np.cumsum(n)
    row = np.repeat(np.arange(rows), n)

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[off[1:]] - total[off[:-1]]

    def words_in(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[ends] - total[ends - n]

    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~_=+{}[]\\/", b"!?", b"|", b".", b",;:"), 1):
        kind[list(chars)] = k
    kind[128:] = 8
    kinds = kind[raw]
    size = np.maximum(np.diff(off), 1).astype(float)
    words = np.maximum(n, 1).astype(float)
    by_kind = [bytes_in(kinds == k) / size for k in range(1, 9)]
    h = tk.span_hash(raw, s, e)
    reps = repeats(h, row)
    five = np.flatnonzero(reps >= 5)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, reps)
    kept = np.unique(tk.mix(h ^ tk.mix(row.astype(np.uint64) + U(1))), return_index=True)[1]
    distinct = np.bincount(row[kept], minlength=rows)
    near = np.zeros(len(h), bool)
    near[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    breaks = np.flatnonzero(raw == 10)
    ls = np.unique(np.concatenate([off[:-1], breaks + 1]))
    ls = ls[ls < len(raw)]
    le = np.append(breaks, len(raw))[np.searchsorted(breaks, ls)] if len(ls) else ls
    lrow = np.searchsorted(off, ls, side="right") - 1
    le = np.minimum(le, off[lrow + 1])
    full = le > ls
    ls, le, lrow = ls[full], le[full], lrow[full]
    lh = tk.mix(tk.span_hash(raw, ls, le) ^ tk.mix(lrow.astype(np.uint64) + U(3))) if len(ls) else np.zeros(0, np.uint64)
    fresh = np.zeros(len(lh), bool)
    fresh[np.unique(lh, return_index=True)[1]] = True
    lines = np.bincount(lrow, minlength=rows)
    last = kinds[e - 1] if len(e) else np.zeros(0, np.uint8)
    length = e - s
    return np.stack(
        [
            np.log1p(n), np.log1p(np.diff(off)), (bytes_in((raw != 32) & ((raw < 9) | (raw > 13)))) / words, *by_kind, lines / words,
            np.bincount(lrow[~fresh], minlength=rows) / np.maximum(lines, 1), words_in(covered(five, np.full(len(five), 5), len(h))) / words, np.log1p(longest), words_in(near) / words, distinct / words,
            words_in(length > 15) / words, words_in(length == 1) / words, words_in(last == 6) / words, words_in((last >= 3) & (last <= 5)) / words,
        ], 1,
    )


def held_out(id_col: str, folds: int = 5) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> PairwiseGam | None:
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_of")).agg(F.min(label_col).cast("double").alias("_y"))
    chosen = tk.smallest(known, F.xxhash64("_of"), known.count(), max_train)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    pairs = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_of")).select("_id", "_y", "_text")

    def run(batches):
        for b in tk.pieces(batches, "_text"):
            x = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["_id", "_y", "_x"])

    found = pairs.mapInArrow(run, f"_id {dict(pairs.dtypes)['_id']}, _y double, _x array<double>")
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_of"), "left_semi").select("_id").count()
    if rows > max_train:  # ids that repeat
        found = tk.smallest(found, F.xxhash64("_id", "_x"), rows, max_train)
    got = found.toArrow().sort_by([("_id", "ascending"), ("_y", "ascending")])
    if not got.num_rows:
        return None
    x = got.column("_x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return PairwiseGam().fit(x, got.column("_y").to_numpy())


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """A row for each input row: id, held_out, score, predicted."""
    model = fit(df, labels, id_col, text_col, label_col, max_train)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for b in tk.pieces(batches, "_text"):
            score = model.score(features(b.column(1))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["_id", "score"])

    scored = texts.mapInArrow(run, f"_id {dict(texts.dtypes)['_id']}, score double")
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op4(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
