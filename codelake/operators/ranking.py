"""Ranks, running sums, top-k, pagination and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codelake.plans.session import ensure_checkpoints
from codelake.plans.views import EDGES, LINES, NODES, edges, lines, nodes, projects, sql, table


def ranked(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """The k best with ranks from 1. Only k rows reach the window: the limit comes first."""
    top = df.orderBy(F.desc(score), tie).limit(k)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(score), tie)))


def diversified(df: DataFrame, by: str, score: str, tie: str, k: int, factor: float = 0.9) -> DataFrame:
    """Each further result of a file counts less; the k best of what is left."""
    n = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), tie))
    return df.withColumn("adjusted", F.round(F.col(score) * F.pow(F.lit(factor), n - 1), 6)).orderBy(F.desc("adjusted"), tie).limit(k)


def best_of(dfs: list[DataFrame], key: str, score: str) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out.groupBy(key).agg(F.max(score).alias(score))


def within_budget(df: DataFrame, by: str, order: list, size: Column, budget: int) -> DataFrame:
    """Rows while their sizes, summed in order, stay within the budget; stops at the first overflow."""
    run = F.sum(size).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("_run", run).where(F.col("_run") <= budget).drop("_run")


def with_context(df: DataFrame, match: Column, n: int) -> DataFrame:
    """Matching lines with up to n lines before and after, joined by newlines."""
    w = W.partitionBy("path").orderBy("line")
    around = df.withColumn("before", F.array_join(F.collect_list("content").over(w.rowsBetween(-n, -1)), "\n")).withColumn("after", F.array_join(F.collect_list("content").over(w.rowsBetween(1, n)), "\n"))
    return around.where(match)


def line_offsets(df: DataFrame) -> DataFrame:
    """The byte at which each line starts."""
    w = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(F.octet_length("content") + 1).over(w), F.lit(0)).cast("long"))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, that a character offset lies on."""
    head = F.substring(text, F.lit(1), offset)
    return (F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def stratified(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows evenly spread over the order: places floor(i N / n). Ranks come from counts of ranges, not one sort."""
    total = df.count()
    if not total:
        return df
    wanted = df.sparkSession.range(min(n, total)).select(F.least(F.floor(F.col("id") * F.lit(total / min(n, total))), F.lit(total - 1)).alias("place"))
    return numbered(df, order).join(F.broadcast(wanted), "place", "left_semi")


def numbered(df: DataFrame, order: list[str], parts: int = 64) -> DataFrame:
    """place: the global rank from 0. A range shuffle, then offsets of partitions (a row each) added.

    The ranges are written before they are counted: they come from a sample, and another run might draw them elsewhere."""
    ensure_checkpoints(df.sparkSession)
    sortd = df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    counts = sortd.groupBy("_p").agg(F.count("*").alias("_c"))
    starts = counts.withColumn("_s", F.coalesce(F.sum("_c").over(W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    own = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return sortd.join(F.broadcast(starts), "_p").withColumn("place", (F.col("_s") + own).cast("long")).drop("_s", "_p")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page and whether more follows."""
    rows = df.orderBy(*order).limit(offset + limit + 1)
    n = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))
    more = F.count("*").over(W.partitionBy(F.lit(0))) > offset + limit
    return rows.withColumn("_n", n).withColumn("has_more", more).where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).drop("_n")


def all_of(postings: DataFrame, key: str, value: str, wanted: list[str]) -> DataFrame:
    """Keys that have every wanted value."""
    return postings.where(F.col(value).isin(wanted)).groupBy(key).agg(F.countDistinct(value).alias("_n")).where(F.col("_n") == len(set(wanted))).select(key)


def overlap(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def _docs(fn):
    return lambda s, d: fn(table(s, d, "documents"))


_SCORE = lambda: (F.col("n_chars") % 1000) / 1000
_TOK = lambda: F.filter(F.split("text", "[ \n\t\r]+"), lambda w: w != "")
_PART = lambda s, d: table(s, d, "part")
QUERIES = {
    "w01_ranked": _docs(lambda t: ranked(t.select("doc_id", _SCORE().alias("score")), "score", "doc_id", 25)),
    "w02_diversity": _docs(lambda t: diversified(t.select("doc_id", "source", _SCORE().alias("score")), "source", "score", "doc_id", 10)),
    "w03_best_score": _docs(lambda t: best_of([t.select("doc_id", _SCORE().alias("score")), t.where("doc_id % 2 = 0").select("doc_id", (F.col("n_chars") % 777 / 777).alias("score"))], "doc_id", "score")),
    "w04_best_fragment": lambda s, d: lines(s, d).groupBy("path").agg(F.max_by("line", F.struct(F.char_length("content"), -F.col("line"))).alias("line")),
    "w05_top3": _docs(lambda t: t.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("r <= 3").select("source", "doc_id", "r")),
    "w06_char_budget": _docs(lambda t: within_budget(t.select("source", "doc_id", "n_chars"), "source", ["doc_id"], F.col("n_chars"), 20_000)),
    "w07_context": lambda s, d: with_context(lines(s, d), F.col("content").contains("token ="), 2),
    "w08_line_offsets": lambda s, d: line_offsets(lines(s, d)).select("path", "line", "offset"),
    "w09_line_of": _docs(lambda t: t.select("doc_id", line_of(F.col("text"), (F.char_length("text") / 2).cast("int")).alias("line"))),
    "w10_stratified": lambda s, d: stratified(_PART(s, d).select("p_retailprice", "p_partkey"), ["p_retailprice", "p_partkey"], 768),
    "w11_first_wins": lambda s, d: first_wins(_PART(s, d), "p_name", "p_partkey").select("p_partkey", "p_name"),
    "w12_duplicate_names": lambda s, d: _PART(s, d).withColumn("n", F.count("*").over(W.partitionBy("p_brand", "p_name"))).select("p_partkey", F.when(F.col("n") > 1, F.concat("p_name", F.lit("@"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("unique_name")),
    "w13_next_instance": lambda s, d: projects(s, d).groupBy("base_name").agg((F.max("instance") + 1).alias("next")),
    "o01_top_k": _docs(lambda t: t.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)),
    "o04_scoped_top_k": _docs(lambda t: t.where("source = 'src3'").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(5)),
    "o05_page": _docs(lambda t: page(t.select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 20, 10)),
    "o07_phase_selection": lambda s, d: nodes(s, d).orderBy(F.desc("complexity"), "node_id").limit(10).select("node_id", "complexity"),
    "o08_sorted_targets": lambda s, d: edges(s, d).where("edge_type = 'Call' and src like 'p%'").groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("targets")),
    "u02_intersect": _docs(lambda t: all_of(t.select("doc_id", F.explode(F.array_distinct(_TOK())).alias("w")), "doc_id", "w", ["the", "and", "of"])),
    "u03_overlap": _docs(lambda t: t.select("doc_id", F.round(overlap(F.array(*[F.lit(x) for x in ("the", "and", "nothing")]), _TOK()), 6).alias("share"))),
    "u04_both_ways": lambda s, d: edges(s, d).where("src = 'p5'").select(F.col("dst").alias("n")).union(edges(s, d).where("dst = 'p5'").select("src")).distinct().where("n <> 'p5'"),
    "u05_merge": lambda s, d: nodes(s, d).where("complexity > 20").select("node_id").union(nodes(s, d).where("complexity > 40").select("node_id")).distinct().agg(F.count("*").alias("n")),
    "u06_union_all": lambda s, d: nodes(s, d).where("complexity > 20").unionByName(nodes(s, d).where("complexity > 40")).groupBy("node_type").agg(F.count("*").alias("n")),
    "u07_import_union": lambda s, d: _PART(s, d).select("p_partkey", F.array_join(F.array_sort(F.array_union(F.split("p_name", " "), F.split("p_type", " "))), "|").alias("names")),
    "u08_added_removed": lambda s, d: _PART(s, d).where("p_size > 10").select("p_name").exceptAll(_PART(s, d).where("p_size > 12").select("p_name")),
    "u09_local_external": lambda s, d: nodes(s, d).groupBy((F.col("project_id") == "parts").alias("local")).agg(F.count("*").alias("n")),
}
SQL = {
    "w01_ranked": "SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT doc_id, (n_chars % 1000) / 1000 AS score FROM documents) ORDER BY score DESC, doc_id LIMIT 25",
    "w02_diversity": "SELECT doc_id, source, score, round(score * pow(0.9, r - 1), 6) AS adjusted FROM (SELECT doc_id, source, (n_chars % 1000) / 1000 AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars % 1000 DESC, doc_id) AS r FROM documents) ORDER BY adjusted DESC, doc_id LIMIT 10",
    "w03_best_score": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN greatest((n_chars % 1000) / 1000, (n_chars % 777) / 777) ELSE (n_chars % 1000) / 1000 END AS score FROM documents",
    "w04_best_fragment": sql("SELECT path, line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY length(content) DESC, line) AS r FROM lines) WHERE r = 1", LINES),
    "w05_top3": "SELECT source, doc_id, CAST(r AS INTEGER) AS r FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3",
    "w06_char_budget": "SELECT source, doc_id, n_chars FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS c FROM documents) WHERE c <= 20000",
    "w07_context": sql("SELECT path, line, content, coalesce(array_to_string(list_filter([lag(content, 2) OVER w, lag(content, 1) OVER w], lambda x: x IS NOT NULL), chr(10)), '') AS before, coalesce(array_to_string(list_filter([lead(content, 1) OVER w, lead(content, 2) OVER w], lambda x: x IS NOT NULL), chr(10)), '') AS after FROM lines WINDOW w AS (PARTITION BY path ORDER BY line) QUALIFY contains(content, 'token =')", LINES),
    "w08_line_offsets": sql("SELECT path, line, CAST(coalesce(sum(strlen(content) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM lines", LINES),
    "w09_line_of": "SELECT doc_id, CAST(len(string_split(substr(text, 1, length(text) // 2), chr(10))) AS BIGINT) AS line FROM documents",
    "w10_stratified": "SELECT p_retailprice, p_partkey, place FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS place, count(*) OVER () AS n FROM part) WHERE place IN (SELECT least(CAST(floor(i * ((SELECT count(*) FROM part) / 768.0::DOUBLE)) AS BIGINT), (SELECT count(*) FROM part) - 1) FROM range(768) t(i))",
    "w11_first_wins": "SELECT min(p_partkey) AS p_partkey, p_name FROM part GROUP BY p_name",
    "w12_duplicate_names": "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_name) > 1 THEN p_name || '@' || p_partkey ELSE p_name END AS unique_name FROM part",
    "w13_next_instance": "SELECT n_name AS base_name, CAST(n_nationkey % 3 + 1 AS INTEGER) AS next FROM nation",
    "o01_top_k": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10",
    "o04_scoped_top_k": "SELECT doc_id, n_chars FROM documents WHERE source = 'src3' ORDER BY n_chars DESC, doc_id LIMIT 5",
    "o05_page": "SELECT doc_id, n_chars, (SELECT count(*) FROM documents) > 30 AS has_more FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 20",
    "o07_phase_selection": sql("SELECT node_id, complexity FROM nodes ORDER BY complexity DESC, node_id LIMIT 10", NODES),
    "o08_sorted_targets": sql("SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets FROM edges WHERE edge_type = 'Call' AND src LIKE 'p%' GROUP BY 1", EDGES),
    "u02_intersect": r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(text, '[ \n\t\r]+'), 'the') AND list_contains(regexp_split_to_array(text, '[ \n\t\r]+'), 'and') AND list_contains(regexp_split_to_array(text, '[ \n\t\r]+'), 'of')",
    "u03_overlap": r"SELECT doc_id, round((CASE WHEN list_contains(w, 'the') THEN 1 ELSE 0 END + CASE WHEN list_contains(w, 'and') THEN 1 ELSE 0 END + CASE WHEN list_contains(w, 'nothing') THEN 1 ELSE 0 END) / 3, 6) AS share FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n\t\r]+') AS w FROM documents)",
    "u04_both_ways": sql("SELECT DISTINCT n FROM (SELECT dst AS n FROM edges WHERE src = 'p5' UNION SELECT src FROM edges WHERE dst = 'p5') WHERE n <> 'p5'", EDGES),
    "u05_merge": "SELECT count(*) AS n FROM part WHERE p_size > 20",
    "u06_union_all": "SELECT 'Function' AS node_type, count(*) FILTER (WHERE p_size > 20) + count(*) FILTER (WHERE p_size > 40) AS n FROM part",
    "u07_import_union": "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_type, ' ')))), '|') AS names FROM part",
    "u08_added_removed": "SELECT p_name FROM part WHERE p_size > 10 EXCEPT ALL SELECT p_name FROM part WHERE p_size > 12",
    "u09_local_external": sql("SELECT project_id = 'parts' AS local, count(*) AS n FROM nodes GROUP BY 1", NODES),
}
