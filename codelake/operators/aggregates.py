"""Counts, distributions, summaries and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codelake.operators.graph import reach_by
from codelake.plans.views import EDGES, NODES, PROJECTS, edges, nodes, projects, sql, table


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def complexity_bucket(c: Column) -> Column:
    """Unknown complexity falls through to very_complex."""
    return F.when(c < 5, "simple").when(c < 10, "moderate").when(c < 20, "complex").otherwise("very_complex")


def hotspots(n: DataFrame, e: DataFrame, threshold: int) -> DataFrame:
    """Symbols at least this complex that call more than half the threshold (whole number). Calls are counted before the join."""
    out = e.groupBy(F.col("src").alias("node_id")).agg(F.count("dst").alias("fan_out"))
    joined = n.where(F.col("complexity") >= threshold).join(out, "node_id", "left").withColumn("fan_out", F.coalesce("fan_out", F.lit(0)).cast("long"))
    return joined.where(F.col("fan_out") > threshold // 2).select("node_id", "name", "file_path", "complexity", "fan_out").orderBy(F.desc("complexity"), F.desc("fan_out"), "node_id")


def temperature(rate: Column, entries: Column) -> Column:
    return F.when(entries == 0, "cold").when(rate >= 0.75, "hot").when(rate >= 0.35, "warm").otherwise("cold")


def file_stats(n: DataFrame, e: DataFrame) -> DataFrame:
    """By file: symbols, total complexity, first five names, files it depends on and that depend on it."""
    own = n.where("node_type <> 'External'")
    a = own.select(F.col("node_id").alias("src"), F.col("file_path").alias("from_file"))
    b = own.select(F.col("node_id").alias("dst"), F.col("file_path").alias("to_file"))
    pairs = e.join(a, "src").join(b, "dst").where("from_file <> to_file").select("from_file", "to_file").distinct()
    outgoing = pairs.groupBy(F.col("from_file").alias("file_path")).agg(F.count("*").alias("outgoing"))
    incoming = pairs.groupBy(F.col("to_file").alias("file_path")).agg(F.count("*").alias("incoming"))
    rank = F.row_number().over(W.partitionBy("file_path").orderBy("node_id"))
    first = own.withColumn("_r", rank).where("_r <= 5").groupBy("file_path").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"])).alias("first_names"))
    sums = own.groupBy("file_path").agg(F.count("*").alias("symbols"), F.sum("complexity").cast("long").alias("total_complexity"))
    out = sums.join(first, "file_path").join(outgoing, "file_path", "left").join(incoming, "file_path", "left")
    return out.fillna(0, ["outgoing", "incoming"])


def document_frequency(docs: DataFrame, tokens: Column) -> DataFrame:
    return docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def hotspot_score(impact: Column, complexity: Column, most_impact: Column, most_complexity: Column, marked: Column) -> Column:
    part = lambda x, top: F.when(top > 0, x / top).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.45 * part(impact, most_impact) + 0.45 * part(complexity, most_complexity) + 0.10 * F.when(marked, 1.0).otherwise(0.2)))


def direct_impact(n: DataFrame, e: DataFrame) -> DataFrame:
    """Distinct symbols within two steps, start excluded. Pairs are made distinct before they are joined again."""
    one = e.select("src", "dst").distinct()
    two = one.join(one.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
    reach = one.union(two).where("src <> dst").distinct().groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("impact"))
    return n.join(reach, "node_id", "left").fillna(0, ["impact"])


def ranked_hotspots(n: DataFrame, e: DataFrame, keywords: list[str], top: int, focus: int) -> DataFrame:
    """Scores of the `focus` most complex symbols; the top ones."""
    chosen = n.where("complexity > 0").orderBy(F.desc("complexity"), "node_id").limit(focus)
    ids = chosen.select(F.col("node_id").alias("src"))
    one = e.join(ids, "src", "left_semi").select("src", "dst").distinct()
    two = one.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("to")).distinct(), "dst").select("src", F.col("to").alias("dst"))
    impact = one.union(two).where("src <> dst").distinct().groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("impact"))
    scored = chosen.join(impact, "node_id", "left").fillna(0, ["impact"])
    every = W.partitionBy(F.lit(0))  # at most `focus` rows
    marked = F.lower("name").rlike("|".join(keywords))
    score = hotspot_score(F.col("impact"), F.col("complexity"), F.max("impact").over(every), F.max("complexity").over(every), marked)
    return scored.withColumn("score", score).orderBy(F.desc("score"), "node_id").limit(top).select("node_id", "complexity", "impact", F.round("score", 6).alias("score"))


def nearest_rank(values: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """The floor(n p)-th smallest value, from 0; by a rank, so that no group is gathered in one row."""
    w = W.partitionBy(by)
    ranked = values.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1)
    return ranked.where(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))).select(by, F.col(value).alias("percentile"))


def ndcg_at(ranked: DataFrame, by: str, rank: str, relevant: str, k: int = 10) -> DataFrame:
    """Binary relevance; the ideal has min(k, relevant rows) hits at the front."""
    gain = F.sum(F.when((F.col(rank) <= k) & F.col(relevant), 1 / F.log2(F.col(rank) + 1)).otherwise(0.0))
    hits = F.least(F.lit(k), F.sum(F.col(relevant).cast("int")))
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda a, i: a + F.when(i <= F.col("_hits"), 1 / F.log2(i + 1)).otherwise(0.0))
    out = ranked.groupBy(by).agg(gain.alias("_gain"), hits.alias("_hits"))
    return out.select(by, F.when(F.col("_hits") > 0, F.round(F.col("_gain") / ideal, 6)).otherwise(0.0).alias("ndcg"))


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts by upper bound, with sum and count, in one row a bound."""
    sums = df.agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count(value).alias("_n"), F.round(F.sum(value), 4).alias("_s"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)])
    return sums.select(F.explode(rows).alias("b"), "_n", "_s").select("b.bound", "b.n", F.col("_n").alias("total"), F.col("_s").alias("total_value"))


def _ne(fn):
    return lambda s, d: fn(nodes(s, d), edges(s, d))


def _calls(s, d):
    return edges(s, d).where("edge_type = 'Import'")


def focus_files(n: DataFrame, e: DataFrame, top: int, files: int, depth: int = 6) -> DataFrame:
    """Files by how many nodes of theirs the `top` most complex nodes reach, one count a node and entry."""
    entries = n.orderBy(F.desc("complexity"), "node_id").limit(top).select(F.col("node_id").alias("start"), "node_id")
    hit = reach_by(e, entries, depth).where("depth > 0").select("start", "node_id")
    return hit.join(n.select("node_id", "file_path"), "node_id").groupBy("file_path").agg(F.count("*").alias("impact")).orderBy(F.desc("impact"), "file_path").limit(files)


def impact_totals(n: DataFrame, e: DataFrame, changed: DataFrame, depth: int = 6) -> DataFrame:
    """For each changed node, what it reaches, itself included: nodes, files and names of interfaces."""
    hit = reach_by(e, changed.select(F.col("node_id").alias("start"), "node_id"), depth).select("start", "node_id").join(n, "node_id")
    return hit.groupBy(F.col("start").alias("src")).agg(F.countDistinct("node_id").alias("nodes"), F.countDistinct("file_path").alias("files"), F.countDistinct(F.when(F.col("node_type").isin("Function", "Method", "Class"), F.col("name"))).alias("apis"))


def quality_gate(runs: DataFrame, by: str, value: str) -> DataFrame:
    """The gate of an 8-bit index against its base: nDCG at 10 may fall by 0.01, p50 rise by 5 %, p99 by 10 %.

    runs: by, base (boolean), value (a latency, by which results are ranked as well), user_id (a third of them relevant), event_id."""
    rel = F.col("user_id") % 3 == 0
    rk = F.row_number().over(W.partitionBy(by, "base").orderBy(F.desc(value), "event_id"))
    ideal = F.row_number().over(W.partitionBy(by, "base").orderBy(F.when(rel, 0).otherwise(1), "event_id"))
    gain = lambda r: F.sum(F.when(rel & (F.col(r) <= 10), 1 / F.log2(F.col(r) + 1)))
    each = runs.withColumn("rk", rk).withColumn("irk", ideal).groupBy(by, "base").agg(F.coalesce(gain("rk") / gain("irk"), F.lit(0.0)).alias("g"), F.percentile(value, 0.5).alias("a"), F.percentile(value, 0.99).alias("z"))
    pick = lambda c, yes: F.max(F.when(F.col("base") == yes, F.col(c)))
    out = each.groupBy(by).agg((pick("g", True) - pick("g", False)).alias("ndcg_drop"), (pick("a", False) / pick("a", True)).alias("p50"), (pick("z", False) / pick("z", True)).alias("p99"))
    return out.select(by, F.round("ndcg_drop", 6).alias("ndcg_drop"), F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"), ((F.col("ndcg_drop") <= 0.01) & (F.col("p50") <= 1.05) & (F.col("p99") <= 1.10)).alias("promoted"))


QUERIES = {
    "a01_nodes_by_type": lambda s, d: count_by(nodes(s, d), "node_type"),
    "a02_edges_by_type": lambda s, d: count_by(edges(s, d), "edge_type"),
    "a03_complexity_buckets": lambda s, d: count_by(nodes(s, d).select(complexity_bucket(F.col("complexity")).alias("bucket")), "bucket").orderBy("bucket"),
    "a04_hotspots": _ne(lambda n, e: hotspots(n, e, 4)),
    "a05_language_distribution": lambda s, d: count_by(nodes(s, d), "language").orderBy(F.desc("n"), "language").limit(24),
    "a06_grand_totals": lambda s, d: table(s, d, "events").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "click").alias("hits")).select("total", "hits", F.round(F.col("hits") / F.col("total"), 6).alias("rate"), temperature(F.col("hits") / F.col("total"), F.col("total")).alias("temperature")),
    "a07_document_frequency": lambda s, d: document_frequency(table(s, d, "documents"), F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"), lambda t: F.octet_length(t) >= 2)),
    "a08_file_stats": _ne(file_stats),
    "a09_parse_stats": lambda s, d: table(s, d, "documents").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") > 0).alias("ok"), F.count_if(F.coalesce(F.col("n_chars") <= 0, F.lit(True))).alias("failed"), F.round(F.avg("n_chars"), 6).alias("avg_chars")),
    "a10_completeness": _ne(lambda n, e: n.join(e.groupBy(F.col("src").alias("node_id")).agg(F.max((F.col("edge_type") == "Call").cast("int")).alias("calls"), F.max((F.col("edge_type") == "Import").cast("int")).alias("imports")), "node_id", "left").groupBy("language").agg(F.avg(F.coalesce("calls", F.lit(0))).alias("c"), F.avg(F.coalesce("imports", F.lit(0))).alias("i"), F.avg((F.col("complexity") > 0).cast("int")).alias("r")).select("language", F.round((F.col("c") + F.col("i") + F.col("r")) / 3, 6).alias("score"))),
    "a11_phase1": lambda s, d: nodes(s, d).agg(F.countDistinct("file_path").alias("files"), F.count_if(F.col("node_type").isin("Function", "Method", "Variable")).alias("signatures"), F.countDistinct("language").alias("languages")),
    "a12_phase2_imports": lambda s, d: _calls(s, d).join(nodes(s, d).select(F.col("node_id").alias("dst"), "node_type", "name"), "dst", "left").agg(F.count_if(F.col("node_type").isNotNull()).alias("internal"), F.count_if(F.col("node_type").isNull()).alias("external"), F.countDistinct("name").alias("names")),
    "a13_phase3_focus": _ne(lambda n, e: focus_files(n, e.where("edge_type in ('Call', 'DataDependency', 'Inheritance')"), 10, 20)),
    "a14_phase4_hotspots": _ne(lambda n, e: ranked_hotspots(n, e, ["auth", "critical", "error", "widget", "hot"], 10, 50)),
    "a15_phase5": lambda s, d: _recommendations(s, d),
    "a16_class_inference": lambda s, d: nodes(s, d).where("node_type in ('Method', 'Class')").groupBy("file_path").agg(F.min("node_id").alias("first_id"), F.max("node_id").alias("last_id"), F.when(F.sum("complexity") == 0, F.count("*")).otherwise(F.sum("complexity")).cast("long").alias("complexity")),
    "a17_typed_edges": lambda s, d: edges(s, d).select("src", "dst", "edge_type").dropDuplicates(["src", "dst", "edge_type"]).groupBy("edge_type").agg(F.count("*").alias("n")),
    "a18_impact_totals": _ne(lambda n, e: impact_totals(n, e.where("edge_type in ('Call', 'DataDependency', 'Inheritance')"), n.where("node_id in ('c1', 'c2', 'n3')"))),
    "a19_clone_groups": lambda s, d: projects(s, d).groupBy("fingerprint").agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_list("project_id"))).alias("members")).where("n > 1"),
    "a20_change_categories": lambda s, d: table(s, d, "pages").select("url", F.when(F.col("url").rlike("\\.html$"), "tracked_source").when(F.col("url").contains("?"), "untracked_notes").otherwise("other").alias("category")).distinct().groupBy("category").agg(F.count("*").alias("n")),
    "a21_coverage": lambda s, d: _coverage(table(s, d, "documents").where("doc_id % 3 <> 0").select("doc_id"), table(s, d, "labels").select("doc_id"), "doc_id"),
    "a22_ndcg": lambda s, d: ndcg_at(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").withColumn("rk", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).withColumn("rel", F.col("quality") == 1), "source", "rk", "rel"),
    "a23_percentile": lambda s, d: nearest_rank(table(s, d, "events").select("event_type", F.col("value")), "event_type", "value", 0.95),
    "a24_gate": lambda s, d: quality_gate(table(s, d, "events").withColumn("base", F.col("event_id") % 2 == 0), "event_type", "value"),
    "a25_histogram": lambda s, d: histogram(table(s, d, "events"), "value", [1, 5, 10, 50, 100]),
    "a26_vector_stats": lambda s, d: table(s, d, "embeddings").select("vec_id", F.array_min("embedding").cast("double").alias("lo"), F.array_max("embedding").cast("double").alias("hi"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total")),
    "a27_annotation": _ne(lambda n, e: e.join(n.select(F.col("node_id").alias("dst"), "node_type"), "dst", "left").groupBy("edge_type").agg(F.count_if(F.col("node_type") == "Class").alias("resolved"), F.count_if(F.col("node_type") == "Method").alias("builtin"), F.count_if(~F.coalesce(F.col("node_type").isin("Class", "Method"), F.lit(False))).alias("unresolved"))),
    "a28_modal_language": lambda s, d: _modal(table(s, d, "documents"), "source", "lang"),
}


def _modal(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value by group; of ties the first in order."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), value))).where("_r = 1").drop("_r")


def _coverage(disk: DataFrame, index: DataFrame, key: str) -> DataFrame:
    both = disk.distinct().withColumn("d", F.lit(1)).join(index.distinct().withColumn("i", F.lit(1)), key, "full")
    sums = both.agg(F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("d").isNull()).alias("orphaned"), F.count("d").alias("disk"))
    return sums.select("missing", "orphaned", F.when(F.col("disk") == 0, 100.0).otherwise(F.round(100 * (F.col("disk") - F.col("missing")) / F.col("disk"), 6)).alias("percent"))


def _recommendations(s, d) -> DataFrame:
    """Rules over the earlier summaries, each a row if it applies, by priority."""
    e, n = edges(s, d), nodes(s, d)
    imports = e.where("edge_type = 'Import'").agg(F.count("*").alias("k")).where("k > 0").select(F.concat(F.lit("Resolve "), "k", F.lit(" import edges")).alias("message"), F.lit(0.95).alias("priority"))
    empty = table(s, d, "documents").agg(F.count_if(F.col("n_chars") < 10).alias("k")).where("k > 0").select(F.concat(F.lit("Fix "), "k", F.lit(" short files")).alias("message"), F.lit(0.9).alias("priority"))
    focus = n.groupBy("file_path").agg(F.sum("complexity").alias("c")).orderBy(F.desc("c"), "file_path").limit(1).select(F.concat(F.lit("Focus on "), "file_path").alias("message"), F.lit(0.8).alias("priority"))
    return imports.union(empty).union(focus).orderBy(F.desc("priority"))


SQL = {
    "a01_nodes_by_type": sql("SELECT node_type, count(*) AS n FROM nodes GROUP BY 1", NODES),
    "a02_edges_by_type": sql("SELECT edge_type, count(*) AS n FROM edges GROUP BY 1", EDGES),
    "a03_complexity_buckets": sql("SELECT CASE WHEN complexity < 5 THEN 'simple' WHEN complexity < 10 THEN 'moderate' WHEN complexity < 20 THEN 'complex' ELSE 'very_complex' END AS bucket, count(*) AS n FROM nodes GROUP BY 1 ORDER BY 1", NODES),
    "a04_hotspots": sql("SELECT n.node_id, n.name, n.file_path, n.complexity, count(e.dst) AS fan_out FROM nodes n LEFT JOIN edges e ON n.node_id = e.src WHERE n.complexity >= 4 GROUP BY ALL HAVING count(e.dst) > 2", NODES, EDGES),
    "a05_language_distribution": sql("SELECT language, count(*) AS n FROM nodes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 24", NODES),
    "a06_grand_totals": "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS hits, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS rate, CASE WHEN count(*) = 0 THEN 'cold' WHEN count(*) FILTER (WHERE event_type = 'click') / count(*) >= 0.75 THEN 'hot' WHEN count(*) FILTER (WHERE event_type = 'click') / count(*) >= 0.35 THEN 'warm' ELSE 'cold' END AS temperature FROM events",
    "a07_document_frequency": "SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+')) AS token FROM documents) WHERE strlen(token) >= 2 GROUP BY 1",
    "a08_file_stats": sql("SELECT s.file_path, s.symbols, s.total_complexity, s.first_names, coalesce(o.c, 0) AS outgoing, coalesce(i.c, 0) AS incoming FROM (SELECT file_path, count(*) AS symbols, CAST(sum(complexity) AS BIGINT) AS total_complexity, string_agg(name, '|' ORDER BY node_id) FILTER (WHERE rn <= 5) AS first_names FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY node_id) AS rn FROM nodes) GROUP BY 1) s LEFT JOIN (SELECT f, count(DISTINCT t) AS c FROM p WHERE f <> t GROUP BY 1) o ON o.f = s.file_path LEFT JOIN (SELECT t, count(DISTINCT f) AS c FROM p WHERE f <> t GROUP BY 1) i ON i.t = s.file_path", NODES, EDGES, "p AS (SELECT a.file_path AS f, b.file_path AS t FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst)"),
    "a09_parse_stats": "SELECT count(*) AS total, count(*) FILTER (WHERE n_chars > 0) AS ok, count(*) FILTER (WHERE n_chars IS NULL OR n_chars <= 0) AS failed, round(avg(n_chars), 6) AS avg_chars FROM documents",
    "a10_completeness": sql("SELECT language, round((avg(c) + avg(i) + avg(CASE WHEN complexity > 0 THEN 1 ELSE 0 END)) / 3, 6) AS score FROM (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = n.node_id AND edge_type = 'Call') THEN 1 ELSE 0 END AS c, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = n.node_id AND edge_type = 'Import') THEN 1 ELSE 0 END AS i FROM nodes n) GROUP BY 1", NODES, EDGES),
    "a11_phase1": sql("SELECT count(DISTINCT file_path) AS files, count(*) FILTER (WHERE node_type IN ('Function', 'Method', 'Variable')) AS signatures, count(DISTINCT language) AS languages FROM nodes", NODES),
    "a12_phase2_imports": sql("SELECT count(n.node_id) AS internal, count(*) - count(n.node_id) AS external, count(DISTINCT name) AS names FROM edges e LEFT JOIN nodes n ON n.node_id = e.dst WHERE edge_type = 'Import'", NODES, EDGES),
    "a13_phase3_focus": sql(
        "SELECT file_path, count(*) AS impact FROM (SELECT DISTINCT start, node_id FROM w WHERE depth > 0) JOIN nodes USING (node_id) GROUP BY 1 ORDER BY impact DESC, file_path LIMIT 20", NODES, EDGES,
        "steps AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type IN ('Call', 'DataDependency', 'Inheritance'))", "w0(start, node_id, depth) AS (SELECT node_id, node_id, 0 FROM (SELECT node_id FROM nodes ORDER BY complexity DESC, node_id LIMIT 10) UNION SELECT start, dst, depth + 1 FROM w0 JOIN steps ON src = node_id WHERE depth < 6)",
        "w AS (SELECT start, node_id, min(depth) AS depth FROM w0 GROUP BY 1, 2)",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "a14_phase4_hotspots": sql("SELECT node_id, complexity, impact, round(0.45 * CASE WHEN mi > 0 THEN impact / mi ELSE 0 END + 0.45 * complexity / mc + 0.1 * CASE WHEN regexp_matches(lower(name), 'auth|critical|error|widget|hot') THEN 1.0 ELSE 0.2 END, 6) AS score FROM (SELECT *, max(impact) OVER () AS mi, max(complexity) OVER () AS mc FROM (SELECT t.*, (SELECT count(*) FROM (SELECT dst FROM edges WHERE src = t.node_id AND dst <> t.node_id UNION SELECT b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = t.node_id AND b.dst <> t.node_id)) AS impact FROM t)) ORDER BY score DESC, node_id LIMIT 10", NODES, EDGES, "t AS (SELECT * FROM nodes WHERE complexity > 0 ORDER BY complexity DESC, node_id LIMIT 50)"),
    "a15_phase5": sql("SELECT 'Resolve ' || count(*) || ' import edges' AS message, CAST(0.95 AS DOUBLE) AS priority FROM edges WHERE edge_type = 'Import' HAVING count(*) > 0 UNION ALL SELECT 'Fix ' || count(*) || ' short files', 0.9 FROM documents WHERE n_chars < 10 HAVING count(*) > 0 UNION ALL (SELECT 'Focus on ' || file_path, 0.8 FROM nodes GROUP BY file_path ORDER BY sum(complexity) DESC, file_path LIMIT 1)", NODES, EDGES),
    "a16_class_inference": sql("SELECT file_path, min(node_id) AS first_id, max(node_id) AS last_id, CAST(CASE WHEN sum(complexity) = 0 THEN count(*) ELSE sum(complexity) END AS BIGINT) AS complexity FROM nodes WHERE node_type IN ('Method', 'Class') GROUP BY 1", NODES),
    "a17_typed_edges": sql("SELECT edge_type, count(*) AS n FROM (SELECT DISTINCT src, dst, edge_type FROM edges) GROUP BY 1", EDGES),
    "a18_impact_totals": sql(
        "SELECT start AS src, count(DISTINCT node_id) AS nodes, count(DISTINCT file_path) AS files, count(DISTINCT name) FILTER (WHERE node_type IN ('Function', 'Method', 'Class')) AS apis FROM w0 JOIN nodes USING (node_id) GROUP BY 1", NODES, EDGES,
        "steps AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type IN ('Call', 'DataDependency', 'Inheritance'))", "w0(start, node_id, depth) AS (SELECT node_id, node_id, 0 FROM nodes WHERE node_id IN ('c1', 'c2', 'n3') UNION SELECT start, dst, depth + 1 FROM w0 JOIN steps ON src = node_id WHERE depth < 6)",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "a19_clone_groups": sql("SELECT fingerprint, count(*) AS n, string_agg(project_id, ',' ORDER BY project_id) AS members FROM projects GROUP BY 1 HAVING count(*) > 1", PROJECTS),
    "a20_change_categories": r"SELECT CASE WHEN regexp_matches(url, '\.html$') THEN 'tracked_source' WHEN contains(url, '?') THEN 'untracked_notes' ELSE 'other' END AS category, count(DISTINCT url) AS n FROM pages GROUP BY 1",
    "a21_coverage": "SELECT count(*) FILTER (WHERE i IS NULL) AS missing, count(*) FILTER (WHERE d IS NULL) AS orphaned, round(100 * (count(d) - count(*) FILTER (WHERE i IS NULL)) / count(d), 6) AS percent FROM (SELECT DISTINCT doc_id AS d FROM documents WHERE doc_id % 3 <> 0) FULL JOIN (SELECT DISTINCT doc_id AS i FROM labels) ON d = i",
    "a22_ndcg": "SELECT source, CASE WHEN sum(rel) = 0 THEN 0 ELSE round(sum(CASE WHEN rk <= 10 AND rel = 1 THEN 1 / log2(rk + 1) ELSE 0 END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= sum(rel)), 6) END AS ndcg FROM (SELECT source, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS rel, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS rk FROM documents d JOIN labels l ON d.doc_id = l.doc_id) GROUP BY source",
    "a23_percentile": "SELECT event_type, value AS percentile FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))",
    "a24_gate": "SELECT event_type, round(ndcg_drop, 6) AS ndcg_drop, round(p50, 6) AS p50, round(p99, 6) AS p99, ndcg_drop <= 0.01 AND p50 <= 1.05 AND p99 <= 1.10 AS promoted FROM (SELECT event_type, max(g) FILTER (WHERE base) - max(g) FILTER (WHERE NOT base) AS ndcg_drop, max(a) FILTER (WHERE NOT base) / max(a) FILTER (WHERE base) AS p50, max(z) FILTER (WHERE NOT base) / max(z) FILTER (WHERE base) AS p99 FROM (SELECT event_type, base, coalesce(sum(CASE WHEN rel AND rk <= 10 THEN 1 / log2(rk + 1) END) / sum(CASE WHEN irk <= 10 AND rel THEN 1 / log2(irk + 1) END), 0) AS g, quantile_cont(value, 0.5) AS a, quantile_cont(value, 0.99) AS z FROM (SELECT event_type, event_id % 2 = 0 AS base, value, user_id % 3 = 0 AS rel, row_number() OVER (PARTITION BY event_type, event_id % 2 ORDER BY value DESC, event_id) AS rk, row_number() OVER (PARTITION BY event_type, event_id % 2 ORDER BY CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END, event_id) AS irk FROM events) GROUP BY 1, 2) GROUP BY 1)",
    "a25_histogram": "SELECT CAST(b AS DOUBLE) AS bound, count(*) FILTER (WHERE value <= b) AS n, count(value) AS total, round(sum(value), 4) AS total_value FROM events CROSS JOIN (VALUES (1), (5), (10), (50), (100)) t(b) GROUP BY b",
    "a26_vector_stats": "SELECT vec_id, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings",
    "a27_annotation": sql("SELECT edge_type, count(*) FILTER (WHERE node_type = 'Class') AS resolved, count(*) FILTER (WHERE node_type = 'Method') AS builtin, count(*) FILTER (WHERE node_type IS NULL OR node_type NOT IN ('Class', 'Method')) AS unresolved FROM edges e LEFT JOIN nodes n ON n.node_id = e.dst GROUP BY 1", NODES, EDGES),
    "a28_modal_language": "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1",
}
