"""Graph operators: bounded reach by frontier joins, impact rules, cycles, expansion under a budget.

A level is one join of the frontier with the edges and one anti-join with what was seen; the frontier is
checkpointed, so lineage stays short and a lost executor costs a level at most. Nothing is collected but counts.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from codelake.operators.lookups import DEPS, _deps, edge_allowed, node_collected
from codelake.plans.session import ensure_checkpoints
from codelake.plans.views import EDGES, NODES, PROJECTS, edges, nodes, projects, sql


@dataclass(frozen=True)
class Preset:
    depth: int
    most: int
    confidence: float
    excluded: tuple[str, ...] = ()
    types: tuple[str, ...] = ("Call", "DataDependency", "Inheritance", "Import", "Containment", "StateTransition")


#: Depth, nodes, confidence of the named traversals.
PRESETS = {"llm_context": Preset(3, 50, 0.5, ("Module",)), "semantic": Preset(5, 150, 0.4), "impact": Preset(64, 500, 0.0), "import": Preset(10, 1000, 0.0, (), ("Import",))}


def reach(e: DataFrame, starts: DataFrame, depth: int, backward: bool = False) -> DataFrame:
    """(node_id, depth) of all that `starts` (node_id) reach in at most `depth` steps, themselves at 0."""
    ensure_checkpoints(e.sparkSession)
    steps = e.select(F.col("dst" if backward else "src").alias("_from"), F.col("src" if backward else "dst").alias("_to"))
    if depth > 1:  # read at every level
        steps = steps.distinct().checkpoint()
    seen = starts.select("node_id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        nxt = steps.join(frontier.select(F.col("node_id").alias("_from")), "_from").select(F.col("_to").alias("node_id")).distinct()
        frontier = nxt.join(seen.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(level).alias("depth")).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def reach_by(e: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node_id, depth): what each start reaches in at most `depth` steps, itself at 0; one frontier for all. starts: a stated set of entries."""
    ensure_checkpoints(e.sparkSession)
    steps = e.select(F.col("src").alias("_from"), F.col("dst").alias("_to")).distinct().checkpoint()
    seen = starts.select("start", "node_id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        nxt = steps.join(frontier.select("start", F.col("node_id").alias("_from")), "_from").select("start", F.col("_to").alias("node_id")).distinct()
        frontier = nxt.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti").select("start", "node_id", F.lit(level).alias("depth")).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def risk_level(nodes_: F.Column, files: F.Column, apis: F.Column, public: F.Column) -> F.Column:
    """Critical or High where interfaces are reached, else by files and nodes."""
    return F.when(public > 0, "Critical").when((apis > 0) | (files > 3), "High").when((files > 1) | (nodes_ > 10), "Medium").otherwise("Low")


def file_impact(n: DataFrame, e: DataFrame, file: str, depth: int, public: F.Column) -> DataFrame:
    """What the nodes of a file reach, are reached by, and are: counts and the level of risk. public: whether a node's name is public."""
    own = n.where(F.col("file_path") == file).select("node_id")
    hit = reach(e, own, depth).select("node_id").union(reach(e, own, depth, True).select("node_id")).distinct().join(n, "node_id")
    api = F.col("node_type").isin("Function", "Method", "Class")
    counts = hit.agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"), F.countDistinct(F.when(api, F.col("name"))).alias("apis"), F.countDistinct(F.when(api & public, F.col("name"))).alias("public"))
    return counts.withColumn("risk", risk_level(F.col("nodes"), F.col("files"), F.col("apis"), F.col("public")))


def rename_files(n: DataFrame, e: DataFrame, node: str, depth: int = 5) -> DataFrame:
    """Files to look at when a node is renamed: its own, those of what depends on it, and those of nodes of the same name."""
    start = n.where(F.col("node_id") == node).select("node_id", "name")
    back = reach(e, start.select("node_id"), depth, True).select("node_id").join(n.select("node_id", "file_path"), "node_id").select("file_path")
    return back.union(n.join(start.select("name"), "name", "left_semi").select("file_path")).distinct()


def traverse(n: DataFrame, e: DataFrame, starts: DataFrame, preset: Preset, backward: bool = False, least: int = 0) -> DataFrame:
    """Reach over allowed edges; nodes that aren't collected are still passed through; the cap cuts by (depth, id)."""
    allowed = e.where(edge_allowed(list(preset.types), preset.confidence))
    found = reach(allowed, starts, preset.depth, backward).where("depth > 0")
    return found.join(n, "node_id").where(node_collected(list(preset.excluded) or [""], least)).orderBy("depth", "node_id").limit(preset.most)


def impact_risk(nodes_: F.Column, files: F.Column, change: str) -> F.Column:
    """Risk of a change by what it reaches."""
    if change in ("remove", "change_signature"):
        return F.when((nodes_ > 5) | (files > 3), "high").when(nodes_ > 0, "medium").otherwise("low")
    return F.when(files > 3, "high").when(files > 1, "medium").otherwise("low")


def in_cycles(e: DataFrame, depth: int) -> DataFrame:
    """Nodes that reach themselves in at most `depth` steps; nodes without a way in or out are peeled off first."""
    ensure_checkpoints(e.sparkSession)
    e = e.select("src", "dst").distinct().checkpoint()
    while True:
        kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").checkpoint()
        before, after = e.count(), kept.count()
        e = kept
        if before == after:
            break
    walk = e.select(F.col("src").alias("start"), F.col("dst").alias("at"))
    found = walk.where("start = at").select("start")
    for _ in range(depth - 1):
        walk = walk.where("start <> at").join(e.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at").select("start", F.col("to").alias("at")).distinct().checkpoint()
        found = found.union(walk.where("start = at").select("start"))
    return found.distinct().select(F.col("start").alias("node_id"))


def gravity(near: DataFrame, by: str, budget: int) -> DataFrame:
    """Best-first by (1 + complexity / 2) / distance squared until the budget of tokens is full.

    near: by, node_id, depth, complexity, tokens of a bounded neighbourhood. The first entry is forced; later
    ones that don't fit are passed over. Sequential within a query, so one group is a query's neighbourhood.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heap = [(-(1 + 0.5 * c) / max(d * d, 1), i, t) for i, c, d, t in zip(pdf["node_id"], pdf["complexity"], pdf["depth"], pdf["tokens"])]
        heapq.heapify(heap)
        left, out = budget, []
        while heap:
            score, i, t = heapq.heappop(heap)
            if t <= left or not out:
                left -= t
                out.append((i, len(out) + 1, round(-score, 6)))
        return pd.DataFrame(out, columns=["node_id", "place", "gravity"]).assign(**{by: pdf[by].iloc[0]})

    return near.groupBy(by).applyInPandas(run, f"node_id string, place int, gravity double, {by} string")


def _start(s, *ids):
    return s.createDataFrame([(i,) for i in ids], "node_id string")


_T = ["Call", "DataDependency", "Inheritance"]


def _typed(s, d):
    return edges(s, d).where(F.col("edge_type").isin(_T))


def _orphans(n, e):
    return n.join(e.select(F.col("src").alias("node_id")), "node_id", "left_anti").join(e.select(F.col("dst").alias("node_id")), "node_id", "left_anti").select("node_id")


def _ring(s, d):
    """Containment and what leads back to the first region."""
    return edges(s, d).where("edge_type in ('Import', 'Containment', 'Inheritance')").select("src", "dst").union(nodes(s, d).where("node_type = 'Module'").select("node_id", F.lit("r0")))


def _impact(s, d, start: str, change: str):
    e = _typed(s, d)
    both = reach(e, _start(s, start), 5).union(reach(e, _start(s, start), 5, True)).where("depth > 0").select("node_id").distinct()
    return both.join(nodes(s, d).select("node_id", "file_path"), "node_id").agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files")).withColumn("risk", impact_risk(F.col("nodes"), F.col("files"), change))


QUERIES = {
    "g01_forward": lambda s, d: reach(_typed(s, d), _start(s, "c1"), 3),
    "g02_backward": lambda s, d: reach(_typed(s, d), _start(s, "s3"), 2, True),
    "g03_multi_source": lambda s, d: reach(_typed(s, d), _start(s, "c1", "c2", "c4"), 2).where("depth > 0"),
    "g04_both_ways": lambda s, d: reach(_typed(s, d), _start(s, "p7"), 1).union(reach(_typed(s, d), _start(s, "p7"), 1, True)).where("depth > 0").select("node_id").distinct(),
    "g05_presets": lambda s, d: traverse(nodes(s, d), edges(s, d), _start(s, "c1"), PRESETS["llm_context"]).select("node_id", "depth"),
    "g06_degrees": lambda s, d: edges(s, d).groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("callers")).join(edges(s, d).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("callees")), "node_id", "full").fillna(0, ["callers", "callees"]),
    "g07_gravity": lambda s, d: gravity(reach(_typed(s, d), _start(s, "c1"), 2).where("depth > 0").join(nodes(s, d), "node_id").select(F.lit("c1").alias("query"), "node_id", "depth", "complexity", F.greatest(F.floor(F.octet_length("name") / 4), F.lit(10)).cast("int").alias("tokens")), "query", 200),
    "g08_context_text": lambda s, d: reach(_typed(s, d), _start(s, "c1"), 1).join(nodes(s, d), "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node_id", "name"))), lambda x: F.concat(F.lit("// "), x["node_id"], F.lit(" "), x["name"])), "\n").alias("context")),
    "g09_impact": lambda s, d: _impact(s, d, "p7", "remove"),
    "g10_change_impact": lambda s, d: file_impact(nodes(s, d), _typed(s, d), "Brand#12", 5, F.col("name").like("%widget")),
    "g11_rename_impact": lambda s, d: reach(_typed(s, d), _start(s, "o7"), 5).union(reach(_typed(s, d), _start(s, "o7"), 5, True)).join(nodes(s, d).select("node_id", "file_path"), "node_id").select("file_path").distinct(),
    "g12_import_cycles": lambda s, d: in_cycles(_ring(s, d), 3),
    "g13_undefined": lambda s, d: edges(s, d).join(nodes(s, d).where("node_type <> 'Class'").select(F.col("node_id").alias("dst")), "dst", "left_anti").groupBy("edge_type").agg(F.count("*").alias("n")),
    "g14_propagation": lambda s, d: reach(_deps(s, d).select(F.col("depends_on").alias("src"), F.col("project_id").alias("dst")), _start(s, "n20"), 4).where("depth > 0").select("node_id"),
    "g15_dependents": lambda s, d: _deps(s, d).where("depends_on = 'n20'").select("project_id").distinct(),
    "g16_normalise_external": lambda s, d: nodes(s, d).select("node_id", F.when(F.col("language").startswith("external") | (F.col("language") == "supplier"), "External").otherwise(F.col("node_type")).alias("node_type")),
    "g17_remove_file": lambda s, d: nodes(s, d).where("file_path <> 'n3'").groupBy("node_type").agg(F.count("*").alias("n")),
    "g18_file_summaries": lambda s, d: nodes(s, d).select("file_path").distinct().select(F.concat(F.lit("file:"), "file_path").alias("node_id"), F.lit("FileSummary").alias("node_type")),
    "g19_orphans": lambda s, d: _orphans(nodes(s, d), edges(s, d).where("edge_type in ('Call', 'DataDependency')")),
    "g20_rename_files": lambda s, d: rename_files(nodes(s, d), _typed(s, d), "p9"),
    "m18_remove_node": lambda s, d: edges(s, d).where("src <> 'n3' and dst <> 'n3'").groupBy("edge_type").agg(F.count("*").alias("n")),
    "m23_external_nodes": lambda s, d: nodes(s, d).where("language = 'supplier'").select("project_id").distinct(),
    "m47_name_impact": lambda s, d: reach(_typed(s, d), _start(s, "c1"), 5).where("depth > 0").orderBy("depth", "node_id").limit(150).join(nodes(s, d).where("node_type <> 'External'"), "node_id").select(F.concat("file_path", F.lit(":"), "name").alias("entry")),
}


def _rec(start: str, depth: int, backward: bool = False, name: str = "r", where: str = "edge_type IN ('Call', 'DataDependency', 'Inheritance')", table: str = "edges") -> str:
    a, b = ("dst", "src") if backward else ("src", "dst")
    return f"{name}0(node_id, depth) AS (SELECT unnest([{start}]), 0 UNION SELECT e.{b}, depth + 1 FROM {name}0 JOIN (SELECT * FROM {table} WHERE {where}) e ON e.{a} = node_id WHERE depth < {depth}), {name} AS (SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM {name}0 GROUP BY 1)"


def _rsql(body: str, *views: str) -> str:
    return sql(body, *views).replace("WITH ", "WITH RECURSIVE ", 1)


_RISK = {"remove": "CASE WHEN nodes > 5 OR files > 3 THEN 'high' WHEN nodes > 0 THEN 'medium' ELSE 'low' END", "edit": "CASE WHEN files > 3 THEN 'high' WHEN files > 1 THEN 'medium' ELSE 'low' END"}
RING = "ring AS (SELECT src, dst FROM edges WHERE edge_type IN ('Import', 'Containment', 'Inheritance') UNION SELECT 'n' || n_nationkey, 'r0' FROM nation)"
CYCLIC = "SELECT DISTINCT a.src AS node_id FROM ring a WHERE a.src = a.dst UNION SELECT a.src FROM ring a JOIN ring b ON b.src = a.dst WHERE b.dst = a.src UNION SELECT a.src FROM ring a JOIN ring b ON b.src = a.dst JOIN ring c ON c.src = b.dst WHERE c.dst = a.src"
_IMP = lambda start, change: _rsql(f"SELECT *, {_RISK[change]} AS risk FROM (SELECT count(*) AS nodes, count(DISTINCT file_path) AS files FROM (SELECT node_id FROM r WHERE depth > 0 UNION SELECT node_id FROM b WHERE depth > 0) x JOIN nodes USING (node_id))", NODES, EDGES, _rec(f"'{start}'", 5), _rec(f"'{start}'", 5, True, "b"))
SQL = {
    "g01_forward": _rsql("SELECT * FROM r", EDGES, _rec("'c1'", 3)),
    "g02_backward": _rsql("SELECT * FROM r", EDGES, _rec("'s3'", 2, True)),
    "g03_multi_source": _rsql("SELECT * FROM r WHERE depth > 0", EDGES, _rec("'c1', 'c2', 'c4'", 2)),
    "g04_both_ways": sql("SELECT DISTINCT CASE WHEN src = 'p7' THEN dst ELSE src END AS node_id FROM edges WHERE (src = 'p7' OR dst = 'p7') AND edge_type IN ('Call', 'DataDependency', 'Inheritance')", EDGES),
    "g05_presets": _rsql("SELECT node_id, depth FROM r JOIN nodes USING (node_id) WHERE depth > 0 AND node_type <> 'Module' ORDER BY depth, node_id LIMIT 50", NODES, EDGES, _rec("'c1'", 3, where="confidence IS NULL OR confidence >= 0.5")),
    "g06_degrees": sql("SELECT coalesce(a.dst, b.src) AS node_id, coalesce(a.c, 0) AS callers, coalesce(b.c, 0) AS callees FROM (SELECT dst, count(*) AS c FROM edges GROUP BY 1) a FULL JOIN (SELECT src, count(*) AS c FROM edges GROUP BY 1) b ON a.dst = b.src", EDGES),
    "g08_context_text": _rsql("SELECT string_agg('// ' || node_id || ' ' || name, chr(10) ORDER BY depth, node_id) AS context FROM r JOIN nodes USING (node_id)", NODES, EDGES, _rec("'c1'", 1)),
    "g09_impact": _IMP("p7", "remove"), 
    "g10_change_impact": _rsql(
        "SELECT *, CASE WHEN public > 0 THEN 'Critical' WHEN apis > 0 OR files > 3 THEN 'High' WHEN files > 1 OR nodes > 10 THEN 'Medium' ELSE 'Low' END AS risk FROM (SELECT count(*) AS nodes, count(DISTINCT file_path) AS files, count(DISTINCT name) FILTER (WHERE node_type IN ('Function', 'Method', 'Class')) AS apis,"
        " count(DISTINCT name) FILTER (WHERE node_type IN ('Function', 'Method', 'Class') AND name LIKE '%widget') AS public FROM (SELECT node_id FROM r UNION SELECT node_id FROM b) x JOIN nodes USING (node_id))",
        NODES, EDGES, _rec("'Brand#12'", 5).replace("SELECT unnest(['Brand#12']), 0", "SELECT node_id, 0 FROM nodes WHERE file_path = 'Brand#12'"), _rec("'Brand#12'", 5, True, "b").replace("SELECT unnest(['Brand#12']), 0", "SELECT node_id, 0 FROM nodes WHERE file_path = 'Brand#12'"),
    ),
    "g11_rename_impact": _rsql("SELECT DISTINCT file_path FROM (SELECT node_id FROM r UNION SELECT node_id FROM b) JOIN nodes USING (node_id)", NODES, EDGES, _rec("'o7'", 5), _rec("'o7'", 5, True, "b")),
    "g12_import_cycles": sql(CYCLIC, EDGES, RING),
    "g13_undefined": sql("SELECT edge_type, count(*) AS n FROM edges WHERE dst NOT IN (SELECT node_id FROM nodes WHERE node_type <> 'Class') GROUP BY 1", NODES, EDGES),
    "g14_propagation": _rsql("SELECT node_id FROM r WHERE depth > 0", PROJECTS, DEPS, "rev AS (SELECT depends_on AS src, project_id AS dst FROM deps)", _rec("'n20'", 4, where="true", table="rev")),
    "g15_dependents": sql("SELECT DISTINCT project_id FROM deps WHERE depends_on = 'n20'", PROJECTS, DEPS),
    "g16_normalise_external": sql("SELECT node_id, CASE WHEN language = 'supplier' THEN 'External' ELSE node_type END AS node_type FROM nodes", NODES),
    "g17_remove_file": sql("SELECT node_type, count(*) AS n FROM nodes WHERE file_path <> 'n3' GROUP BY 1", NODES),
    "g18_file_summaries": sql("SELECT DISTINCT 'file:' || file_path AS node_id, 'FileSummary' AS node_type FROM nodes", NODES),
    "g19_orphans": sql("SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT src FROM edges WHERE edge_type IN ('Call', 'DataDependency')) AND node_id NOT IN (SELECT dst FROM edges WHERE edge_type IN ('Call', 'DataDependency'))", NODES, EDGES),
    "g20_rename_files": _rsql("SELECT DISTINCT file_path FROM nodes WHERE node_id IN (SELECT node_id FROM b) OR name IN (SELECT name FROM nodes WHERE node_id = 'p9')", NODES, EDGES, _rec("'p9'", 5, True, "b")),
    "m18_remove_node": sql("SELECT edge_type, count(*) AS n FROM edges WHERE NOT (src = 'n3' OR dst = 'n3') GROUP BY 1", EDGES),
    "m23_external_nodes": "SELECT DISTINCT 'n' || s_nationkey AS project_id FROM supplier",
    "m47_name_impact": _rsql("SELECT file_path || ':' || name AS entry FROM (SELECT * FROM r WHERE depth > 0 ORDER BY depth, node_id LIMIT 150) JOIN nodes USING (node_id) WHERE node_type <> 'External'", NODES, EDGES, _rec("'c1'", 5)),
}
