"""Incremental refresh: hash diffs as batch functions, and the streams that apply them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelake.operators.joins import drift, upsert
from codelake.operators.retrieval import incremental
from codelake.plans.views import sql, table


def changes(indexed: DataFrame, seen: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """key, kind (added, removed, changed) of files whose hash differs."""
    return drift(indexed, seen, key, value).where("kind <> 'same'").select(key, "kind")


def refresh(index: DataFrame, seen: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """The index with changed and removed keys out and the new rows of added and changed ones in."""
    new = seen.join(changed.where("kind <> 'removed'").select(key), key, "left_semi")
    return incremental(index, changed.where("kind = 'removed'").select(key), new, key)


def stale(indexed: DataFrame, seen: DataFrame, key: str = "path", value: str = "hash") -> bool:
    """Whether the index is empty or any file differs; stops at the first."""
    return indexed.isEmpty() or not changes(indexed, seen, key, value).isEmpty()


def fragment_sync(refs: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references kept, contents to embed): refs and current hold path and content_hash.

    References of contents that a file no longer has go; contents are embedded once, if none refers to them yet.
    """
    kept = refs.join(current.select("path", "content_hash"), ["path", "content_hash"], "left_semi")
    fresh = current.select("content_hash").distinct().join(refs.select("content_hash").distinct(), "content_hash", "left_anti")
    return kept, fresh


def watch(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, key: str = "path", once: bool = False, order: str | None = None):
    """A stream over files of records in `folder`: each batch upserts into the Parquet store `out` by key.

    A batch writes a generation of its own and readers take the newest row of each key, so a batch that is
    retried after a failure replaces its own generation and nothing else. Of a batch's rows of one key the newest by `order`
    stays, of equally new ones the greatest by all columns.
    """

    def apply(batch: DataFrame, number: int) -> None:
        newest = F.max(F.struct(*([F.col(order).alias("_order")] if order else []), *[F.col(c) for c in batch.columns]))
        batch.groupBy(F.col(key).alias("_key")).agg(newest.alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in batch.columns]).write.mode("overwrite").parquet(f"{out}/generation={number}")

    stream = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="500 milliseconds")).start()


def latest(spark: SparkSession, out: str, key: str = "path") -> DataFrame:
    """The newest row of each key of a store that `watch` writes."""
    rows = spark.read.parquet(out)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "generation")]), "generation").alias("_r")).select(key, "_r.*")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Event counts by window and type; rows that come later than `late` are dropped when streaming."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def _f(s, d, part):
    return table(s, d, "documents").where(f"doc_id % 5 <> {part}").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 11 == part, F.md5(F.concat("text", F.lit("x")).cast("binary"))).otherwise(F.md5(F.col("text").cast("binary"))).alias("hash"))


def _refs(s, d, part):
    return table(s, d, "documents").where(f"doc_id % 4 <> {part}").select(F.col("source").alias("path"), F.md5(F.col("text").cast("binary")).alias("content_hash"))


QUERIES = {
    "t01_windowed_events": lambda s, d: windowed_counts(table(s, d, "events")),
    "t02_changes": lambda s, d: changes(_f(s, d, 0), _f(s, d, 1)),
    "t02_refresh": lambda s, d: refresh(_f(s, d, 0), _f(s, d, 1), changes(_f(s, d, 0), _f(s, d, 1))),
    "t07_fragment_sync": lambda s, d: fragment_sync(_refs(s, d, 0), _refs(s, d, 1))[1],
    "t08_cache": lambda s, d: upsert(_f(s, d, 0).withColumn("v", F.lit(1)), _f(s, d, 1).withColumn("v", F.lit(2)), ["hash"], F.col("path")).groupBy("v").agg(F.count("*").alias("n")),
    "m11_indexed_files": lambda s, d: upsert(_f(s, d, 0), _f(s, d, 1), ["path"], F.col("hash")),
}
_A = lambda p: f"(SELECT doc_id AS path, md5(CASE WHEN doc_id % 11 = {p} THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 5 <> {p})"
SQL = {
    "t01_windowed_events": "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "t02_changes": f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM {_A(0)} a FULL JOIN {_A(1)} b ON a.path = b.path WHERE a.hash IS NULL OR b.hash IS NULL OR a.hash <> b.hash",
    "t02_refresh": f"SELECT * FROM {_A(1)} b",
    "t07_fragment_sync": "SELECT DISTINCT md5(text) AS content_hash FROM documents WHERE doc_id % 4 <> 1 EXCEPT SELECT md5(text) FROM documents WHERE doc_id % 4 <> 0",
    "t08_cache": f"SELECT v, count(*) AS n FROM (SELECT hash, max(v) AS v FROM (SELECT hash, 1 AS v FROM {_A(0)} UNION ALL SELECT hash, 2 FROM {_A(1)}) GROUP BY 1) GROUP BY 1",
    "m11_indexed_files": f"SELECT coalesce(b.path, a.path) AS path, coalesce(b.hash, a.hash) AS hash FROM {_A(0)} a FULL JOIN {_A(1)} b ON a.path = b.path",
}
