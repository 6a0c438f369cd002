"""Tables and the derived views that the operators run on, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols: node_id, node_type, name, complexity, language, project_id, file_path."""
    t = lambda n: table(spark, sf_dir, n)
    part = lambda df, key, prefix, kind, name, cx, lang, project, file: df.select(
        _id(prefix, key).alias("node_id"), F.lit(kind).alias("node_type"), F.col(name).alias("name"), cx.cast("int").alias("complexity"), lang.alias("language"), project.alias("project_id"), file.alias("file_path")
    )
    parts = [
        part(t("region"), "r_regionkey", "r", "FileSummary", "r_name", F.lit(0), F.lit("region"), F.lit("root"), _id("r", "r_regionkey")),
        part(t("nation"), "n_nationkey", "n", "Module", "n_name", F.lit(1), F.lit("nation"), _id("n", "n_nationkey"), _id("r", "n_regionkey")),
        part(t("customer"), "c_custkey", "c", "Class", "c_name", F.lit(2), F.col("c_mktsegment"), _id("n", "c_nationkey"), _id("n", "c_nationkey")),
        part(t("supplier"), "s_suppkey", "s", "Class", "s_name", F.lit(3), F.lit("supplier"), _id("n", "s_nationkey"), _id("n", "s_nationkey")),
        part(t("orders"), "o_orderkey", "o", "Method", "o_orderpriority", F.lit(4), F.col("o_orderstatus"), F.lit("orders"), _id("c", "o_custkey")),
        part(t("part"), "p_partkey", "p", "Function", "p_name", F.col("p_size"), F.col("p_type"), F.lit("parts"), F.col("p_brand")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES = """nodes AS (
SELECT 'r' || r_regionkey AS node_id, 'FileSummary' AS node_type, r_name AS name, 0 AS complexity, 'region' AS language, 'root' AS project_id, 'r' || r_regionkey AS file_path FROM region
UNION ALL SELECT 'n' || n_nationkey, 'Module', n_name, 1, 'nation', 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'Class', c_name, 2, c_mktsegment, 'n' || c_nationkey, 'n' || c_nationkey FROM customer
UNION ALL SELECT 's' || s_suppkey, 'Class', s_name, 3, 'supplier', 'n' || s_nationkey, 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'o' || o_orderkey, 'Method', o_orderpriority, 4, o_orderstatus, 'orders', 'c' || o_custkey FROM orders
UNION ALL SELECT 'p' || p_partkey, 'Function', p_name, p_size, p_type, 'parts', p_brand FROM part)"""


def with_ranges(df: DataFrame) -> DataFrame:
    """Adds byte_start and byte_end: a file's symbols lie one after the other, by id."""
    rank = F.row_number().over(W.partitionBy("file_path").orderBy("node_id"))
    return df.withColumn("byte_start", ((rank - 1) * 100).cast("long")).withColumn("byte_end", (F.col("byte_start") + 10 + F.octet_length("name")).cast("long"))


RANGED = """ranged AS (SELECT *, CAST(byte_start + 10 + strlen(name) AS BIGINT) AS byte_end FROM
(SELECT *, CAST((row_number() OVER (PARTITION BY file_path ORDER BY node_id) - 1) * 100 AS BIGINT) AS byte_start FROM nodes))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies: src, dst, edge_type, confidence."""
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("double")
    pair = lambda df, a, b, kind, conf=none: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"), conf.alias("confidence"))
    sure = F.when(F.min("l_tax") == 0, none).otherwise(1 - F.min("l_discount"))
    uses = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(sure.alias("conf"))
    calls = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(sure.alias("conf"))
    return (
        pair(t("nation"), _id("r", "n_regionkey"), _id("n", "n_nationkey"), "Containment")
        .unionByName(pair(t("customer"), _id("n", "c_nationkey"), _id("c", "c_custkey"), "Import"))
        .unionByName(pair(t("orders"), _id("c", "o_custkey"), _id("o", "o_orderkey"), "Call"))
        .unionByName(pair(uses, _id("o", "l_orderkey"), _id("p", "l_partkey"), "DataDependency", F.col("conf")))
        .unionByName(pair(calls, _id("p", "l_partkey"), _id("s", "l_suppkey"), "Call", F.col("conf")))
        .unionByName(pair(t("supplier"), _id("s", "s_suppkey"), _id("n", "s_nationkey"), "Inheritance"))
    )


EDGES = """edges AS (
SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'Containment' AS edge_type, CAST(NULL AS DOUBLE) AS confidence FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'Import', NULL FROM customer
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'Call', NULL FROM orders
UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'DataDependency', CASE WHEN min(l_tax) = 0 THEN NULL ELSE 1 - min(l_discount) END FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'Call', CASE WHEN min(l_tax) = 0 THEN NULL ELSE 1 - min(l_discount) END FROM lineitem GROUP BY l_partkey, l_suppkey
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'Inheritance', NULL FROM supplier)"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects: a nation each; base_name, instance and a fingerprint besides."""
    n = table(spark, sf_dir, "nation")
    return n.select(_id("n", "n_nationkey").alias("project_id"), F.col("n_name").alias("base_name"), (F.col("n_nationkey") % 3).cast("int").alias("instance"), _id("r", "n_regionkey").alias("fingerprint"))


PROJECTS = "projects AS (SELECT 'n' || n_nationkey AS project_id, n_name AS base_name, CAST(n_nationkey % 3 AS INTEGER) AS instance, 'r' || n_regionkey AS fingerprint FROM nation)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines: path (doc_id), line (from 1), content."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "content")).select("path", (F.col("pos") + 1).cast("long").alias("line"), "content")


LINES = "lines AS (SELECT doc_id AS path, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line, unnest(string_split(text, chr(10))) AS content FROM documents)"


def sql(body: str, *views: str) -> str:
    return f"WITH {', '.join(views)}\n{body}" if views else body
