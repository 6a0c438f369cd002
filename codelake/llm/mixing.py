"""Mixing sources to target weights by weighted fair queueing. [DataFrame operations only]

Every source shuffles its documents (by md5 of the id) and goes through them up to `epochs` times. A
document's virtual finish time is its source's tokens so far, itself included, divided by the source's
target. All documents of all sources are range-sorted by finish time, and the mix ends where the running
total reaches the budget. A source has its target's tokens when virtual time reaches one, so each comes near it.

Targets: the budget is shared by weight; a share above `epochs` times its source's size stops there and
the excess is shared again by weight. In closed form: in the order of size over weight, the first k sources
are capped for the largest k at which source k's cap is below its share of what the first k - 1 leave.

Running totals come in two steps, so that no source and no time range needs one task: sums of bins (a source's
ids in `bins` hash bins; time in `_TIMES` steps a unit), then a window within a bin. Only the one time bin in
which the budget ends is sorted by a single task.

Defined cases: null and empty texts have size zero and take nothing; the null source is a source of its own,
last in order; an empty table gives an empty mix; a source without words has target zero; rows that share an
id are separate documents; columns other than id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .simhash import ensure_checkpoints
from .textkit import WORD, row_hash

_TIMES, _LAST = 65536, 4


def words_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...], epochs: int, share: float) -> DataFrame:
    """(_source, source_size, target): one row a source, in one small task."""
    sizes = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    everything = W.partitionBy(F.lit(0))
    weighted = sizes.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("_source").asc_nulls_last())) - 1)
    weighted = weighted.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long"))
    order = everything.orderBy(F.col("source_size") / F.col("_w"), "_rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    budget = F.floor(F.sum("source_size").over(everything) * F.lit(share)) if share != 1 else F.sum("source_size").over(everything)
    left = weighted.withColumn("_rest", budget - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    left = left.withColumn("_wrest", F.sum("_w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    capped = left.withColumn("_capped", epochs * F.col("source_size") * F.col("_wrest") <= F.col("_rest") * F.col("_w"))
    stepped = capped.withColumn("_n", F.row_number().over(order))
    first = F.min(F.when(~F.col("_capped"), F.struct("_n", "_rest", "_wrest"))).over(everything)
    free = stepped.withColumn("_free", first)
    return free.select(
        "_source", "source_size", "_rank",
        F.when(F.col("_capped"), (epochs * F.col("source_size")).cast("double")).otherwise(F.col("_free._rest").cast("double") * F.col("_w") / F.col("_free._wrest")).alias("target"),
    )


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, share: float = 1.0, bins: int = 4096, more: tuple[Column, ...] = ()) -> DataFrame:
    """A row for each input row: id, size, source_size, target, taken, copies and finish (time of its first copy).

    Sizes are counted once and checkpointed without the texts. `mixed` gives the mix with its texts. more: columns of df to pass on.
    """
    ensure_checkpoints(df.sparkSession)
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    own = df.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), words_of(text_col).alias("_size"), key.alias("_r"), F.struct(F.lit(0).alias("_0"), *more).alias("_more"))
    sized = own.withColumn("_bin", F.conv(F.substring("_r", 1, 8), 16, 10).cast("long") % bins).checkpoint()
    wanted = targets(sized, weights, epochs, share)
    sums = sized.groupBy("_source", "_bin").agg(F.sum("_size").alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(W.partitionBy("_source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = wanted.withColumnRenamed("_source", "_of")
    starts = sums.select(F.col("_source").alias("_from"), F.col("_bin").alias("_hash"), start.alias("_start"))
    starts = starts.join(wanted, F.col("_from").eqNullSafe(F.col("_of"))).drop("_of")
    placed = sized.join(starts, F.col("_source").eqNullSafe(F.col("_from")) & (F.col("_bin") == F.col("_hash"))).drop("_from", "_hash")
    own_bin = W.partitionBy("_rank", "_bin").orderBy("_r", "_id", "_size", "_more").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = placed.withColumn("_cum", F.col("_start") + F.sum("_size").over(own_bin))
    finish = lambda e: F.when(F.col("target") > 0, (e * F.col("source_size") + F.col("_cum")).cast("double") / F.col("target"))
    # a copy's place in the whole order: finish time, then source, copy, shuffled place
    copies = placed.where("_size > 0").select("_size", "_rank", "_r", "_id", "_cum", F.posexplode(F.array(*[finish(e) for e in range(epochs)])).alias("_e", "_t"))
    copies = copies.withColumn("_tbin", F.floor(F.least("_t", F.lit(float(_LAST))) * _TIMES))
    times = copies.groupBy("_tbin").agg(F.sum("_size").alias("_sum"))
    total = wanted.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_total"))
    cut = _cut(copies, times, total, share)
    if cut is None:
        kept = F.lit(True)
        count = F.when(F.col("_size") > 0, F.lit(epochs)).otherwise(0)
    else:
        at = F.struct(F.lit(cut[0]), F.lit(cut[1]), F.lit(cut[2]), F.lit(cut[3]).cast("long"))
        count = sum((F.when((F.col("_size") > 0) & (F.struct(finish(e), F.col("_rank"), F.lit(e), F.col("_cum")) < at), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    out = placed.withColumn("copies", count)
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("copies") * F.col("_size")).cast("long").alias("taken"),
        F.col("copies").cast("int"), finish(0).alias("finish"), *([F.col("_more")] if more else []),
    )


def mixed(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: the rows of df taken, with copies and finish, globally range-sorted by finish.

    Rows are told apart by the hash of all their columns; rows that agree in all are interchangeable. If df has a column
    copies or finish, it stays, and those of the mix are called mix_copies and mix_finish."""
    names = [n if n not in df.columns else f"mix_{n}" for n in ("copies", "finish")]
    row = row_hash(df)
    every = mix(df, id_col, more=(row.alias("row"),), **options).select(F.col(id_col).alias("__codelake_id"), F.col("_more.row").alias("__codelake_row"), F.col("copies").alias("__codelake_copies"), F.col("finish").alias("__codelake_finish")).checkpoint()
    own = df.withColumn("__codelake_hash", row)
    if not every.groupBy("__codelake_id", "__codelake_row").count().where("count > 1").isEmpty():
        own = own.dropDuplicates([id_col, "__codelake_hash"])
    both = own.join(every.where("__codelake_copies > 0"), F.col(id_col).eqNullSafe(F.col("__codelake_id")) & (F.col("__codelake_hash") == F.col("__codelake_row")))
    out = both.select(*[F.col(f"`{n}`") for n in df.columns], F.col("__codelake_copies").alias(names[0]), F.col("__codelake_finish").alias(names[1]))
    return out.repartitionByRange(names[1]).sortWithinPartitions(names[1])


def _cut(copies: DataFrame, times: DataFrame, total: DataFrame, share: float):
    """(finish, source's rank, copy, cumulative size) of the first copy that the budget doesn't hold; None if it holds all."""
    budget = total.head()[0]
    budget = budget if share == 1 else int(budget * share)
    upto = W.partitionBy(F.lit(0)).orderBy("_tbin").rowsBetween(W.unboundedPreceding, W.currentRow)
    over = times.withColumn("_upto", F.sum("_sum").over(upto)).where(F.col("_upto") > budget).orderBy("_tbin").limit(1).head()
    if over is None:
        return None
    within = W.partitionBy("_tbin").orderBy("_t", "_rank", "_e", "_cum", "_r", "_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = copies.where(F.col("_tbin") == over["_tbin"]).withColumn("_run", over["_upto"] - over["_sum"] + F.sum("_size").over(within))
    x = last.where(F.col("_run") > budget).orderBy("_run").limit(1).head()
    return float(x["_t"]), int(x["_rank"]), int(x["_e"]), int(x["_cum"])


def op2(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: Sizes, targets in closed form, finish times and the running total, by plain windows.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS r FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / w, rk) AS n FROM w),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - 3 * coalesce(sum(source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
  CAST(sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS wrest FROM o),
c AS (SELECT *, 3 * source_size * wrest <= rest * w AS capped FROM l),
f AS (SELECT rest, wrest FROM c WHERE NOT capped ORDER BY n LIMIT 1),
t AS (SELECT c.source, c.source_size, c.rk, CASE WHEN c.capped THEN CAST(3 * c.source_size AS DOUBLE) ELSE CAST(f.rest AS DOUBLE) * c.w / f.wrest END AS target FROM c LEFT JOIN f ON true),
p AS (SELECT d.doc_id, d.size, d.r, t.source_size, t.rk, t.target, CAST(sum(d.size) OVER (PARTITION BY t.rk ORDER BY CAST(('0x' || substr(d.r, 1, 8)) AS BIGINT) % 4096, d.r, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT p.*, e.e, CAST(e.e * source_size + cum AS DOUBLE) / target AS fin FROM p CROSS JOIN (VALUES (0), (1), (2)) e(e) WHERE size > 0),
k AS (SELECT *, sum(size) OVER (ORDER BY fin, rk, e, cum, r, doc_id ROWS UNBOUNDED PRECEDING) <= (SELECT sum(source_size) FROM s) AS held FROM e),
g AS (SELECT doc_id, r, cum, count(*) FILTER (WHERE held) AS copies FROM k GROUP BY doc_id, r, cum)
SELECT p.doc_id, p.size, p.source_size, coalesce(p.target, 0) AS target, CAST(coalesce(g.copies, 0) * p.size AS BIGINT) AS taken
FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.cum = g.cum AND p.size > 0
"""
