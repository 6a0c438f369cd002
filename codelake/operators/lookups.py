"""Filters, lookups and predicates over symbols, edges and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelake.plans.views import EDGES, NODES, PROJECTS, RANGED, edges, nodes, projects, sql, table, with_ranges

LIMIT = 200
#: Suffixes and fragments of generated code; extensions of source files.
GENERATED_SUFFIXES = (".min.js", ".min.css", ".pb.go", ".generated.rs", ".bundle.js", ".chunk.js", "_pb2.py", ".d.ts")
GENERATED_PARTS = ("node_modules", "/vendor/", "/generated/", "/autogenerated/")


def find_symbol(df: DataFrame, symbol: str, file: str | None = None) -> DataFrame:
    """Exact or ASCII case-insensitive name or id, exact first."""
    same = (F.col("name") == symbol) | (F.col("node_id") == symbol)
    loose = (F.lower("name") == symbol.lower()) | (F.lower("node_id") == symbol.lower())
    out = df.where(same | loose)
    if file is not None:
        out = out.where(F.col("file_path") == file)
    return out.orderBy(F.when(same, 0).otherwise(1), "node_id").limit(LIMIT)


def find_symbols_like(df: DataFrame, pattern: str) -> DataFrame:
    """Substring match with a rank of four tiers; % and _ in the pattern are wildcards."""
    like = f"%{pattern}%"
    rank = F.when(F.col("node_id") == pattern, 0).when(F.col("name") == pattern, 1).when(F.lower("node_id") == pattern.lower(), 2).otherwise(3)
    return df.where(F.col("name").ilike(like) | F.col("node_id").ilike(like)).withColumn("tier", rank).orderBy("tier", "node_id").limit(LIMIT)


def symbols_in_file(df: DataFrame, file: str) -> DataFrame:
    return df.where(F.col("file_path") == file).orderBy("byte_start", "node_id").limit(LIMIT)


def edge_allowed(types: list[str], least: float) -> Column:
    """Edges of these types whose confidence is unknown or high enough."""
    return F.col("edge_type").isin(types) & F.coalesce(F.col("confidence") >= least, F.lit(True))


def node_collected(excluded: list[str], least: int) -> Column:
    return ~F.col("node_type").isin(excluded) & (F.col("complexity") >= least)


def in_scope(path: Column, scope: str | None) -> Column:
    """The file itself, or below the directory with a slash between."""
    return F.lit(True) if scope is None else (path == scope) | path.startswith(f"{scope.rstrip('/')}/")


def glob(path: Column, pattern: str) -> Column:
    """*.ext ends with; one * means a part before and an end; else contains."""
    if pattern.startswith("*.") and pattern.count("*") == 1:
        return path.endswith(pattern[1:])
    if pattern.count("*") == 1:
        before, after = pattern.split("*")
        return path.contains(before) & path.endswith(after)
    return path.contains(pattern)


def path_wanted(path: Column, scope: str | None, include: list[str], exclude: list[str]) -> Column:
    any_of = lambda globs: glob(path, globs[0]) if len(globs) == 1 else glob(path, globs[0]) | any_of(globs[1:])
    out = in_scope(path, scope)
    if include:
        out = out & any_of(include)
    return out & ~any_of(exclude) if exclude else out


def line_matches(line: Column, pattern: str, regex: bool = False, ignore_case: bool = False) -> Column:
    if regex:
        return line.rlike(("(?i)" if ignore_case else "") + pattern)
    return F.lower(line).contains(pattern.lower()) if ignore_case else line.contains(pattern)


def pruning(path: Column, content: Column, name: Column) -> Column:
    """generated, low_information or keep."""
    lower = F.lower(path)
    generated = F.lit(False)
    for s in GENERATED_SUFFIXES:
        generated = generated | lower.endswith(s)
    for s in GENERATED_PARTS:
        generated = generated | lower.contains(s)
    return F.when(generated, "generated").when((F.octet_length(content) < 16) & (F.char_length(name) < 3), "low_information").otherwise("keep")


def grep_symbols(df: DataFrame, pattern: str) -> DataFrame:
    """Rank: id 0, name 1, id without case 2, substring 3; once a file and byte range."""
    from pyspark.sql import Window as W

    rank = F.when(F.col("node_id") == pattern, 0).when(F.col("name") == pattern, 1).when(F.lower("node_id") == pattern.lower(), 2).when(F.lower("name").contains(pattern.lower()), 3)
    found = df.withColumn("tier", rank).where(F.col("tier").isNotNull())
    once = F.row_number().over(W.partitionBy("file_path", "byte_start", "byte_end").orderBy("tier", "node_id"))
    return found.withColumn("_n", once).where((F.col("_n") == 1) | ((F.col("byte_start") == 0) & (F.col("byte_end") == 0))).drop("_n")


def admit(df: DataFrame, size: Column, order: list[str], most_rows: int, most_bytes: int) -> DataFrame:
    """Greedy admission in input order, exactly: a row that doesn't fit is left out, a later smaller one may fit.

    One group a batch: the greedy rule is sequential within it. Batches are the unit of scale.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        rows = total = 0
        keep = []
        for n in pdf["_size"]:
            ok = rows < most_rows and total + n <= most_bytes
            rows, total = rows + ok, total + n * ok
            keep.append(ok)
        return pdf.assign(admitted=keep).drop(columns="_size")

    kept = df.withColumn("_size", size)
    fields = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return kept.groupBy("batch").applyInPandas(run, f"{fields}, admitted boolean")


S = ["node_id", "node_type", "name", "complexity", "language", "project_id", "file_path"]


def _q(fn):
    return lambda spark, d: fn(nodes(spark, d))


QUERIES = {
    "f01_find_symbol": _q(lambda n: find_symbol(n, "supplier#000000003")),
    "f02_symbols_like": _q(lambda n: find_symbols_like(n, "mer#00000001")),
    "f03_symbols_in_file": _q(lambda n: symbols_in_file(with_ranges(n), "n3")),
    "f05_edges_by": lambda s, d: edges(s, d).where((F.col("src") == "c1") | (F.col("dst") == "n3") | (F.col("edge_type") == "Containment")),
    "f06_node_by": _q(lambda n: n.where(F.col("node_id").isin("c1", "p7") | (F.col("file_path") == "r1"))),
    "f07_edge_allowed": lambda s, d: edges(s, d).where(edge_allowed(["Call", "Import"], 0.97)),
    "f08_node_collected": _q(lambda n: n.where(node_collected(["Module", "Class"], 40))),
    "f09_path_scope": _q(lambda n: n.withColumn("path", F.concat_ws("/", "project_id", "file_path")).where(in_scope(F.col("path"), "n3")).select("node_id", "path")),
    "f10_glob": lambda s, d: table(s, d, "pages").where(glob(F.col("url"), "*.html")).select("page_id", "url"),
    "f11_path_filters": lambda s, d: table(s, d, "pages").where(path_wanted(F.col("url"), None, ["/en/", "/fr/"], ["blog*.html"])).select("page_id", "url"),
    "f12_line_filter": lambda s, d: table(s, d, "documents").where(line_matches(F.col("text"), "token\\s*=", True, True)).select("doc_id", line_matches(F.col("text"), "The ", ignore_case=True).alias("has_the")),
    "f13_pruning": lambda s, d: table(s, d, "documents").select("doc_id", pruning(F.concat(F.lit("/"), "source", F.when(F.col("doc_id") % 7 == 0, ".min.js").otherwise(".txt")), F.col("text"), F.substring("lang", 1, 2)).alias("decision")),
    "f14_admission": lambda s, d: admit(table(s, d, "documents").select("doc_id", F.col("source").alias("batch"), F.octet_length("text").cast("long").alias("bytes")), F.col("bytes"), ["doc_id"], 30, 40_000),
    "f15_grep_symbols": _q(lambda n: grep_symbols(with_ranges(n), "00000012").select(*S, "tier")),
    "f17_archive": lambda s, d: table(s, d, "pages").select("page_id", F.array_contains(F.split("url", "[/\\\\]"), "en").alias("in_part")),
    "f18_source_file": lambda s, d: table(s, d, "pages").select("page_id", F.lower("url").rlike("\\.(html|js|py|rs)$").alias("is_source")),
    "f19_no_external": _q(lambda n: n.where(F.col("node_type") != "FileSummary").groupBy("node_type").count().withColumnRenamed("count", "n")),
    "f20_public_symbols": _q(lambda n: n.where((F.col("project_id") == "n7") & (F.col("complexity") >= 2))),
    "f21_dimension": lambda s, d: table(s, d, "embeddings").where(F.size("embedding") == 64).agg(F.count("*").alias("n")),
    "f22_threshold": _q(lambda n: n.where(F.least(F.col("complexity") / 100, F.lit(1.0)) >= 0.1).select("node_id", (F.col("complexity") / 100).alias("score"))),
    "m01_symbol_count": _q(lambda n: n.where(F.col("file_path") == "n3").agg(F.count("*").alias("n"))),
    "m02_symbol_by_name": _q(lambda n: n.where(F.col("name") == "Customer#000000010")),
    "m03_symbol_by_name_type": _q(lambda n: n.where((F.col("name") == "1-URGENT") & (F.col("node_type") == "Method"))),
    "m04_symbols_of_project": _q(lambda n: n.where(F.col("project_id") == "n5")),
    "m05_external_refs": lambda s, d: _refs(s, d).where((F.col("source_project") == "n3") | (F.col("target_project") == "n3")),
    "m06_project_deps": lambda s, d: _deps(s, d).where((F.col("project_id") == "n1") | (F.col("depends_on") == "n1")),
    "m07_conflicts": _q(lambda n: n.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("project_id").alias("projects")).where("n > 1")),
    "m09_exists": _q(lambda n: n.where("project_id = 'n4'").agg((F.count("*") > 0).alias("found"))),
    "m15_graph_nodes": _q(lambda n: n.where("project_id = 'orders'").orderBy("node_id").limit(1000)),
    "m16_symbol_search": _q(lambda n: n.where(F.col("name").ilike("%0001%") | F.col("language").ilike("%0001%")).orderBy(F.when(F.col("name").ilike("%0001%"), 0).otherwise(1), "name", "node_id").limit(50).select("node_id", "name")),
    "m19_counts": lambda s, d: nodes(s, d).agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"), F.countDistinct("node_type").alias("types")),
    "s09_load_nodes": _q(lambda n: n.where("project_id = 'n6'")),
    "s10_load_edges": lambda s, d: _loaded(edges(s, d), nodes(s, d), ["n6", "n7"]),
    "o06_project_map": _q(lambda n: n.groupBy("file_path").agg(F.sum("complexity").cast("long").alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), "file_path").limit(50)),
    "o09_limits": lambda s, d: edges(s, d).where("edge_type = 'Call'").orderBy("src", "dst").limit(5000),
    "o10_projects": lambda s, d: projects(s, d).orderBy("base_name"),
}


def _deps(s, d) -> DataFrame:
    """project_id depends on the projects of the suppliers whose parts its customers order: here, by region."""
    p = projects(s, d)
    return p.alias("a").join(p.alias("b"), (F.col("a.fingerprint") == F.col("b.fingerprint")) & (F.col("a.project_id") < F.col("b.project_id"))).select(F.col("a.project_id"), F.col("b.project_id").alias("depends_on"))


DEPS = "deps AS (SELECT a.project_id, b.project_id AS depends_on FROM projects a JOIN projects b ON a.fingerprint = b.fingerprint AND a.project_id < b.project_id)"


def _refs(s, d) -> DataFrame:
    """References between projects: calls whose ends lie in different projects."""
    n = nodes(s, d).select("node_id", "project_id")
    e = edges(s, d).where("edge_type in ('Import', 'Inheritance', 'Containment')")
    a = n.select(F.col("node_id").alias("src"), F.col("project_id").alias("source_project"))
    b = n.select(F.col("node_id").alias("dst"), F.col("project_id").alias("target_project"))
    return e.join(a, "src").join(b, "dst").where("source_project <> target_project").select("src", "dst", "source_project", "target_project", F.col("edge_type").alias("ref_type"))


REFS = "refs AS (SELECT e.src, e.dst, a.project_id AS source_project, b.project_id AS target_project, e.edge_type AS ref_type FROM edges e JOIN nodes a ON e.src = a.node_id JOIN nodes b ON e.dst = b.node_id WHERE e.edge_type IN ('Import', 'Inheritance', 'Containment') AND a.project_id <> b.project_id)"


def _loaded(e: DataFrame, n: DataFrame, of: list[str]) -> DataFrame:
    """Edges whose ends both lie in the given projects."""
    own = n.where(F.col("project_id").isin(of)).select("node_id")
    return e.join(own.withColumnRenamed("node_id", "src"), "src").join(own.withColumnRenamed("node_id", "dst"), "dst").select("src", "dst", "edge_type", "confidence")


_URL = "SELECT page_id, url FROM pages WHERE "
SQL = {
    "f01_find_symbol": sql("SELECT * FROM nodes WHERE lower(name) = 'supplier#000000003' OR lower(node_id) = 'supplier#000000003' ORDER BY CASE WHEN name = 'supplier#000000003' OR node_id = 'supplier#000000003' THEN 0 ELSE 1 END, node_id LIMIT 200", NODES),
    "f02_symbols_like": sql("SELECT *, CASE WHEN node_id = 'mer#00000001' THEN 0 WHEN name = 'mer#00000001' THEN 1 WHEN lower(node_id) = 'mer#00000001' THEN 2 ELSE 3 END AS tier FROM nodes WHERE lower(name) LIKE '%mer#00000001%' OR lower(node_id) LIKE '%mer#00000001%' ORDER BY tier, node_id LIMIT 200", NODES),
    "f03_symbols_in_file": sql("SELECT * FROM ranged WHERE file_path = 'n3' ORDER BY byte_start, node_id LIMIT 200", NODES, RANGED),
    "f05_edges_by": sql("SELECT * FROM edges WHERE src = 'c1' OR dst = 'n3' OR edge_type = 'Containment'", EDGES),
    "f06_node_by": sql("SELECT * FROM nodes WHERE node_id IN ('c1', 'p7') OR file_path = 'r1'", NODES),
    "f07_edge_allowed": sql("SELECT * FROM edges WHERE (edge_type = 'Call' OR edge_type = 'Import') AND (confidence IS NULL OR confidence >= 0.97)", EDGES),
    "f08_node_collected": sql("SELECT * FROM nodes WHERE node_type NOT IN ('Module', 'Class') AND complexity >= 40", NODES),
    "f09_path_scope": sql("SELECT node_id, project_id || '/' || file_path AS path FROM nodes WHERE project_id || '/' || file_path = 'n3' OR starts_with(project_id || '/' || file_path, 'n3/')", NODES),
    "f10_glob": _URL + "ends_with(url, '.html')",
    "f11_path_filters": _URL + "(contains(url, '/en/') OR contains(url, '/fr/')) AND NOT (contains(url, 'blog') AND ends_with(url, '.html'))",
    "f12_line_filter": r"SELECT doc_id, contains(lower(text), 'the ') AS has_the FROM documents WHERE regexp_matches(text, '(?i)token\s*=')",
    "f13_pruning": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'generated' WHEN strlen(text) < 16 AND length(lang) < 3 THEN 'low_information' ELSE 'keep' END AS decision FROM documents",
    "f15_grep_symbols": sql("SELECT node_id, node_type, name, complexity, language, project_id, file_path, 3 AS tier FROM ranged WHERE contains(lower(name), '00000012')", NODES, RANGED),
    "f17_archive": r"SELECT page_id, list_contains(string_split(url, '/'), 'en') AS in_part FROM pages",
    "f18_source_file": r"SELECT page_id, regexp_matches(lower(url), '\.(html|js|py|rs)$') AS is_source FROM pages",
    "f19_no_external": sql("SELECT node_type, count(*) AS n FROM nodes WHERE node_type <> 'FileSummary' GROUP BY 1", NODES),
    "f20_public_symbols": sql("SELECT * FROM nodes WHERE project_id = 'n7' AND complexity >= 2", NODES),
    "f21_dimension": "SELECT count(*) AS n FROM embeddings WHERE len(embedding) = 64",
    "f22_threshold": sql("SELECT node_id, complexity / 100 AS score FROM nodes WHERE complexity >= 10", NODES),
    "m01_symbol_count": sql("SELECT count(*) AS n FROM nodes WHERE file_path = 'n3'", NODES),
    "m02_symbol_by_name": sql("SELECT * FROM nodes WHERE name = 'Customer#000000010'", NODES),
    "m03_symbol_by_name_type": sql("SELECT * FROM nodes WHERE name = '1-URGENT' AND node_type = 'Method'", NODES),
    "m04_symbols_of_project": sql("SELECT * FROM nodes WHERE project_id = 'n5'", NODES),
    "m05_external_refs": sql("SELECT * FROM refs WHERE source_project = 'n3' OR target_project = 'n3'", NODES, EDGES, REFS),
    "m06_project_deps": sql("SELECT * FROM deps WHERE project_id = 'n1' OR depends_on = 'n1'", PROJECTS, DEPS),
    "m07_conflicts": sql("SELECT name, count(*) AS n, count(DISTINCT project_id) AS projects FROM nodes GROUP BY name HAVING count(*) > 1", NODES),
    "m09_exists": sql("SELECT count(*) > 0 AS found FROM nodes WHERE project_id = 'n4'", NODES),
    "m15_graph_nodes": sql("SELECT * FROM nodes WHERE project_id = 'orders' ORDER BY node_id LIMIT 1000", NODES),
    "m16_symbol_search": sql("SELECT node_id, name FROM nodes WHERE name ILIKE '%0001%' OR language ILIKE '%0001%' ORDER BY CASE WHEN name ILIKE '%0001%' THEN 0 ELSE 1 END, name, node_id LIMIT 50", NODES),
    "m19_counts": sql("SELECT count(*) AS nodes, count(DISTINCT file_path) AS files, count(DISTINCT node_type) AS types FROM nodes", NODES),
    "s09_load_nodes": sql("SELECT * FROM nodes WHERE project_id = 'n6'", NODES),
    "s10_load_edges": sql("SELECT e.* FROM edges e WHERE src IN (SELECT node_id FROM nodes WHERE project_id IN ('n6', 'n7')) AND dst IN (SELECT node_id FROM nodes WHERE project_id IN ('n6', 'n7'))", NODES, EDGES),
    "o06_project_map": sql("SELECT file_path, CAST(sum(complexity) AS BIGINT) AS total, count(*) AS n FROM nodes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", NODES),
    "o09_limits": sql("SELECT * FROM edges WHERE edge_type = 'Call' ORDER BY src, dst LIMIT 5000", EDGES),
    "o10_projects": sql("SELECT * FROM projects ORDER BY base_name", PROJECTS),
}
