"""Joins: dashboards, resolution of calls and imports, containment, drift, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codelake.operators.lookups import DEPS, REFS, _deps, _refs
from codelake.plans.views import EDGES, LINES, NODES, PROJECTS, RANGED, edges, lines, nodes, projects, sql, table, with_ranges


def codebases(p: DataFrame, n: DataFrame, e: DataFrame) -> DataFrame:
    """Projects with counts of files, symbols and calls; each count is aggregated before its join."""
    files = n.groupBy("project_id").agg(F.countDistinct("file_path").alias("file_count"), F.count("*").alias("node_count"))
    out = e.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("c"))
    calls = n.select("node_id", "project_id").join(out, "node_id").groupBy("project_id").agg(F.sum("c").cast("long").alias("edge_count"))
    return p.join(files, "project_id", "left").join(calls, "project_id", "left").fillna(0, ["file_count", "node_count", "edge_count"])


def dashboard(p: DataFrame, n: DataFrame, e: DataFrame, refs: DataFrame, deps: DataFrame) -> DataFrame:
    imports = e.where("edge_type = 'Import'").join(n.select(F.col("node_id").alias("src"), "project_id"), "src").groupBy("project_id").agg(F.count("*").alias("import_edges"))
    ref = refs.groupBy(F.col("source_project").alias("project_id")).agg(F.count("*").alias("external_refs"))
    dep = deps.groupBy("project_id").agg(F.count("*").alias("project_deps"))
    out = codebases(p, n, e)
    for x in (imports, ref, dep):
        out = out.join(x, "project_id", "left")
    return out.fillna(0, ["import_edges", "external_refs", "project_deps"]).select("project_id", "base_name", "file_count", "node_count", "edge_count", "import_edges", "external_refs", "project_deps")


def innermost(points: DataFrame, spans: DataFrame, by: str, point: str, width: int = 4096) -> DataFrame:
    """For each point, the shortest [byte_start, byte_end) of its file that holds it.

    A range join as an equi-join: a span is dealt to every block of `width` bytes that it touches, a point to its own.
    """
    blocks = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("byte_start") / width), F.floor((F.greatest("byte_end", F.col("byte_start") + 1) - 1) / width))))
    here = points.withColumn("_b", F.floor(F.col(point) / width))
    both = here.join(blocks, [by, "_b"]).where((F.col("byte_start") <= F.col(point)) & (F.col(point) < F.col("byte_end")))
    rank = F.row_number().over(W.partitionBy(by, point).orderBy(F.col("byte_end") - F.col("byte_start"), "node_id"))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_b")


def longest_prefix(paths: DataFrame, path: str, packages: DataFrame, package: str) -> DataFrame:
    """The longest dotted prefix that is a package."""
    parts = F.split(F.col(path), "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, F.lit(1), i)))
    tried = paths.withColumn("_p", F.explode(prefixes))
    found = tried.join(packages.select(F.col(package).alias("_p")).distinct(), "_p")
    best = found.groupBy(path).agg(F.max_by("_p", F.length("_p")).alias("package"))
    return paths.join(best, path, "left")


def drift(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed, changed or same, by name; of names that repeat, the last counts."""
    both = old.select(key, F.col(value).alias("before")).join(new.select(key, F.col(value).alias("after")), key, "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return both.withColumn("kind", kind)


def merge_graphs(n1: DataFrame, e1: DataFrame, n2: DataFrame, e2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols of the second that the first lacks are added; edges once by ends and type, the first's kept."""
    n = n1.unionByName(n2.join(n1.select("node_id"), "node_id", "left_anti"))
    key = ["src", "dst", "edge_type"]
    e = e1.dropDuplicates(key).unionByName(e2.dropDuplicates(key).join(e1.select(*key), key, "left_anti"))
    return n, e


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Keep-last by key; null keys match nulls. One shuffle for both sides."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_new"), order))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_new")


def type_flow(sigs: DataFrame) -> DataFrame:
    """Signals between producers and consumers of a type: sigs has qname, returns, params (array), calls (array).

    A: what one returns another takes (0.85). B: both return it and one calls the other (0.65). C: both take
    it and one calls the other (0.45). The strongest signal of a pair stays.
    """
    takes = sigs.select(F.col("qname").alias("dst"), F.explode(F.array_distinct("params")).alias("type"))
    gives = sigs.where("returns is not null").select(F.col("qname").alias("src"), F.col("returns").alias("type"))
    a = gives.join(takes, "type").where("src <> dst").select("src", "dst", F.lit(0.85).alias("confidence"), "type")
    calls = sigs.select(F.col("qname").alias("src"), F.explode(F.array_distinct("calls")).alias("dst"))
    b = calls.join(gives, "src").join(gives.select(F.col("src").alias("dst"), F.col("type").alias("t2")), "dst").where("type = t2 and src <> dst").select("src", "dst", F.lit(0.65).alias("confidence"), F.concat(F.lit("ret:"), "type").alias("type"))
    mine = sigs.select(F.col("qname").alias("src"), F.col("params").alias("p1"))
    theirs = sigs.select(F.col("qname").alias("dst"), F.col("params").alias("p2"))
    shared = F.array_min(F.array_intersect("p1", "p2"))
    c = calls.join(mine, "src").join(theirs, "dst").withColumn("t", shared).where("t is not null and src <> dst").select("src", "dst", F.lit(0.45).alias("confidence"), F.concat(F.lit("param:"), "t").alias("type"))
    return a.union(b).union(c).groupBy("src", "dst").agg(F.max(F.struct("confidence", "type")).alias("m")).select("src", "dst", "m.confidence", F.col("m.type").alias("label"))


#: Names too common to be resolved by their last segment alone.
COMMON_NAMES = (
    "new clone name len get set add remove push pop iter next send recv read write open close start stop run exec call apply map filter fold collect into from to as is has can should will do done ok err some none true false nil null"
    " self super init free drop copy dup swap cmp eq ne lt le gt ge hash fmt dbg print println format parse unwrap expect ok_or ok_or_else map_err and_then or_else unwrap_or unwrap_or_else unwrap_or_default is_some is_none is_ok is_err"
    " as_ref as_mut as_str as_bytes trim split join replace contains starts_with ends_with find rfind matches to_string to_owned to_vec into_string into_bytes into_vec into_iter keys values entries execute handle process update create"
    " delete save load fetch build make spawn fork warn info error trace debug log json yaml toml xml html csv Ok Err Some None Result Option Vec Box Rc Arc Cell RefCell Mutex RwLock String str HashMap HashSet BTreeMap BTreeSet VecDeque"
    " LinkedList JsonRpcError Error Response Request Value serde serde_json display render"
).split()


def _tails(name: Column) -> Column:
    """Keys of a dotted name: the whole, and its last two and three segments."""
    parts = F.split(name, "\\.")
    tail = lambda k: F.when(F.size(parts) >= k, F.concat(F.lit("s:"), F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - k + 1), F.lit(k)), ".")))
    return F.array_distinct(F.array_compact(F.array(F.concat(F.lit("e:"), name), tail(2), tail(3))))


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, "\\."), -1)


def called(calls: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wanted, own): each call that a symbol answers with the one key that decides it, how and the number of symbols; the symbols by key.

    The last two segments agree wherever the whole name or the last three do, and the last segment wherever a whole name of one
    segment does. So a call has one key and meets no symbol twice, and what only counts or asks whether needs no pair."""
    q, t, last = F.col("qname"), F.col("target"), F.substring_index("target", ".", -1)
    two = lambda c: F.concat(F.lit("s:"), F.substring_index(c, ".", -2))
    one = lambda c: F.concat(F.lit("l:"), F.substring_index(c, ".", -1))
    own = symbols.select("node_id", F.explode(F.array_compact(F.array(F.when(F.instr(q, ".") > 0, two(q)), one(q)))).alias("_k"))
    sizes = own.groupBy("_k").agg(F.count_distinct(F.struct("node_id")).alias("_one"), F.count("*").alias("_all"))
    wanted = calls.select("caller", "target").distinct()
    wanted = wanted.withColumn("_d", F.when(F.instr(t, ".") > 0, two(t)).otherwise(one(t))).withColumn("_l", F.when((F.octet_length(last) > 2) & ~last.isin(COMMON_NAMES), one(t)))
    found = wanted.join(sizes.select(F.col("_k").alias("_d"), "_one"), "_d", "left").join(sizes.select(F.col("_k").alias("_l"), "_all"), "_l", "left").where("_one is not null or _all is not null")
    direct = F.col("_one").isNotNull()
    return found.select("caller", "target", F.when(direct, F.col("_d")).otherwise(F.col("_l")).alias("_k"), F.when(direct, "direct").otherwise("last").alias("how"), F.when(direct, F.col("_one")).otherwise(F.col("_all")).alias("_n")), own


def resolve_calls(calls: DataFrame, symbols: DataFrame, block: int = 1 << 13) -> DataFrame:
    """calls(caller, target) to symbols(node_id, qname): every symbol of the whole name, of the last two or three segments, or, for a
    name of one segment, of that as the last; if there is none, by the last segment alone unless that is a common or short name.

    The symbols of a name are dealt into blocks that each meet all its calls, so a frequent name is many tasks; the pairs are
    not shuffled."""
    wanted, own = called(calls, symbols)
    parts = 4 * max(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), calls.sparkSession.sparkContext.defaultParallelism)

    def meet(how: str, mine: DataFrame) -> DataFrame:
        blocks = mine.groupBy("_k").agg(F.ceil(F.count("*") / block).alias("_b"))
        dealt = mine.join(blocks, "_k").select("_k", F.pmod(F.xxhash64("node_id"), F.col("_b")).alias("_at"), "node_id").repartition(parts, "_k", "_at")
        asked = wanted.where(F.col("how") == how).select("caller", "target", "_k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / block) - 1)).alias("_at")).repartition(parts, "_k", "_at")
        return asked.join(dealt, ["_k", "_at"]).select("caller", "target", "node_id", F.lit(how).alias("how"))

    return meet("direct", own.distinct()).union(meet("last", own))


def call_counts(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """how, n: the pairs that resolve_calls makes, counted without making them; both rows even if none is there."""
    wanted, _ = called(calls, symbols)
    total = lambda how: F.coalesce(F.sum(F.when(F.col("how") == how, F.col("_n"))), F.lit(0)).cast("long")
    both = wanted.agg(F.array(*[F.struct(F.lit(how).alias("how"), total(how).alias("n")) for how in ("direct", "last")]).alias("_x"))
    return both.select(F.inline("_x"))


def import_targets(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(importer, target, resolved): the first symbol of the whole name or of its last two or three segments, else of the last segment, else an external node.

    Tables as large as the names are merged, as broadcasts of them would be built by the driver."""
    wanted = imports.select("target").distinct()
    keys = wanted.select("target", F.explode(_tails(F.col("target"))).alias("_k"))
    own = symbols.select("node_id", F.explode(_tails(F.col("qname"))).alias("_k")).groupBy("_k").agg(F.min("node_id").alias("node_id"))
    direct = keys.join(own.hint("merge"), "_k").groupBy("target").agg(F.min("node_id").alias("_d"))
    ends = symbols.groupBy(_last(F.col("qname")).alias("_l")).agg(F.min("node_id").alias("_n"))
    found = wanted.withColumn("_l", _last(F.col("target"))).join(direct.hint("merge"), "target", "left").join(ends, "_l", "left")
    return imports.join(found.hint("merge"), "target").select("importer", "target", F.coalesce("_d", "_n", F.concat(F.lit("external:"), "target")).alias("resolved"))


def ranked_imports(imports: DataFrame, symbols: DataFrame, top: int = 3) -> DataFrame:
    """Candidates by score: exact 300, suffix 200, last segment 100, same language 50, module 120; the best `top`.

    A name may be the last segment of very many symbols. Only the first `top` by id of each name, kind and language, and of each
    name and kind in any language, can be among the best, so no more than these meet an import."""
    last, parts = _last(F.col("qname")), F.split("qname", "\\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("s:"), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    keys = F.array_distinct(F.concat(tails, F.array(F.concat(F.lit("e:"), "qname"), F.concat(F.lit("l:"), last))))
    own = symbols.select("node_id", "qname", "language", (F.col("node_type") == "Module").alias("_m"), F.explode(keys).alias("_k"))
    own = own.withColumn("_one", F.row_number().over(W.partitionBy("_k", "_m", "language").orderBy("node_id"))).where(F.col("_one") <= top)
    own = own.withColumn("_any", F.row_number().over(W.partitionBy("_k", "_m").orderBy("node_id")))
    asked = F.array(F.concat(F.lit("e:"), "target"), F.concat(F.lit("s:"), "target"), F.concat(F.lit("l:"), _last(F.col("target"))))
    wanted = imports.select("target", "lang").distinct().withColumn("_k", F.explode(asked))
    meet = wanted.join(own.withColumnRenamed("language", "lang"), ["_k", "lang"]).select("target", "lang", "node_id", "qname", F.lit(50).alias("_s"), "_m")
    rest = wanted.join(own.where(F.col("_any") <= top), "_k").where(~F.col("lang").eqNullSafe(F.col("language"))).select("target", "lang", "node_id", "qname", F.lit(0).alias("_s"), "_m")
    score = F.when(F.col("target") == F.col("qname"), 300).otherwise(0) + F.when(F.col("qname").endswith(F.concat(F.lit("."), "target")), 200).otherwise(0) + 100 + F.col("_s") + F.when(F.col("_m"), 120).otherwise(0)
    both = meet.union(rest).distinct().withColumn("score", score.cast("int"))
    best = both.withColumn("rank", F.row_number().over(W.partitionBy("target", "lang").orderBy(F.desc("score"), "node_id"))).where(F.col("rank") <= top)
    return imports.join(best, ["target", "lang"]).select("importer", "target", "node_id", "score", "rank")


def _qname(key: str, name: str) -> Column:
    return F.concat(F.lit("m"), F.floor(F.col(key) / 8).cast("string"), F.lit("."), F.replace(F.col(name), F.lit(" "), F.lit(".")))


def _symbols(s, d) -> DataFrame:
    """Parts as symbols: a module of eight parts and the name's words make a dotted name."""
    return table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), _qname("p_partkey", "p_name").alias("qname"), F.col("p_brand").alias("language"), F.when(F.col("p_size") > 40, "Module").otherwise("Function").alias("node_type"))


def _wanted(s, d) -> DataFrame:
    """Names that parts import: whole names, a few of two segments or of one, unknown ones, common ones."""
    k, name = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("."))
    target = F.when(k % 10 == 0, "no.such.thing").when(k % 50 == 7, name).when(k % 50 == 9, _last(name)).when(k % 50 == 11, F.concat(F.lit("x."), _last(name))).when(k % 50 == 13, "x.new").otherwise(_qname("p_partkey", "p_name"))
    return table(s, d, "part").select(k.alias("importer"), target.alias("target"), F.col("p_brand").alias("lang"))


def _sigs(s, d) -> DataFrame:
    """Suppliers as signatures: what they return, take and call comes from their keys."""
    k = F.col("s_suppkey")
    t = lambda x: F.concat(F.lit("T"), (x % 17).cast("string"))
    q = lambda x: F.concat(F.lit("s"), x.cast("string"))
    return table(s, d, "supplier").select(q(k).alias("qname"), F.when(k % 5 == 0, F.lit(None)).otherwise(t(k)).alias("returns"), F.array(t(k + 3), t(k * 2)).alias("params"), F.array(q(k + 17), q(k + 1)).alias("calls"))


SYMBOLS = "symbols AS (SELECT 'p' || p_partkey AS node_id, 'm' || (p_partkey // 8) || '.' || replace(p_name, ' ', '.') AS qname, p_brand AS language, CASE WHEN p_size > 40 THEN 'Module' ELSE 'Function' END AS node_type, list_extract(string_split(p_name, ' '), -1) AS last FROM part)"
WANTED = "wanted AS (SELECT p_partkey AS importer, CASE WHEN p_partkey % 10 = 0 THEN 'no.such.thing' WHEN p_partkey % 50 = 7 THEN replace(p_name, ' ', '.') WHEN p_partkey % 50 = 9 THEN list_extract(string_split(p_name, ' '), -1) WHEN p_partkey % 50 = 11 THEN 'x.' || list_extract(string_split(p_name, ' '), -1) WHEN p_partkey % 50 = 13 THEN 'x.new' ELSE 'm' || (p_partkey // 8) || '.' || replace(p_name, ' ', '.') END AS target, p_brand AS lang FROM part), imports AS (SELECT *, list_extract(string_split(target, '.'), -1) AS last, len(string_split(target, '.')) AS parts FROM wanted)"
LOOSE = "SELECT i.importer, i.target, s.node_id, 'last' AS how FROM imports i JOIN symbols s ON s.last = i.last WHERE strlen(i.last) > 2 AND i.last NOT IN (" + ", ".join(f"'{x}'" for x in COMMON_NAMES) + ") AND i.importer NOT IN (SELECT importer FROM meets)"
#: Every symbol that a name stands for without its last segment alone.
MEETS = "meets AS (SELECT i.importer, i.target, s.node_id FROM imports i JOIN symbols s ON s.last = i.last AND (i.parts = 1 OR ends_with('.' || s.qname, '.' || list_extract(string_split(i.target, '.'), -2) || '.' || i.last)))"
SIGS = "sigs AS (SELECT 's' || s_suppkey AS qname, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'T' || (s_suppkey % 17) END AS returns, ['T' || ((s_suppkey + 3) % 17), 'T' || ((s_suppkey * 2) % 17)] AS params, ['s' || (s_suppkey + 17), 's' || (s_suppkey + 1)] AS calls FROM supplier)"


def _files(s, d, part: int):
    return table(s, d, "documents").where(f"doc_id % 5 <> {part}").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 11 == part, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))


def _file_sql(part: int) -> str:
    return f"SELECT doc_id AS path, sha256(CASE WHEN doc_id % 11 = {part} THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 5 <> {part}"


def _offsets(s, d) -> DataFrame:
    """A few byte offsets in each file."""
    return nodes(s, d).select("file_path").distinct().withColumn("off", F.explode(F.array(*[F.lit(x).cast("long") for x in (5, 117, 250, 1003, 90)])))


def edge_fingerprint(e: DataFrame) -> DataFrame:
    """n, total and mixed: count, sum and exclusive or of the edges' hashes, whatever their order; nothing is gathered."""
    h = F.md5(F.concat_ws("|", "src", "dst", "edge_type").cast("binary"))
    number = lambda at: F.conv(F.substring(h, at, 12), 16, 10).cast("long")
    return e.agg(F.count("*").alias("n"), F.sum(number(1).cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(number(13)).alias("mixed"))


QUERIES = {
    "j01_codebases": lambda s, d: codebases(projects(s, d), nodes(s, d), edges(s, d)),
    "j02_dashboard": lambda s, d: dashboard(projects(s, d), nodes(s, d), edges(s, d), _refs(s, d), _deps(s, d)),
    "j03_hotspot_join": lambda s, d: nodes(s, d).join(edges(s, d).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("k")), "node_id", "left").select("node_id", F.coalesce("k", F.lit(0)).cast("long").alias("fan_out")),
    "j04_graph_links": lambda s, d: edges(s, d).join(nodes(s, d).where("project_id = 'parts'").select(F.col("node_id").alias("src")), "src", "left_semi").orderBy("src", "dst").limit(5000).select("src", "dst", "edge_type"),
    "j05_drop_file_edges": lambda s, d: _without_file(s, d, "n3").groupBy("edge_type").agg(F.count("*").alias("n")),
    "j07_type_flow": lambda s, d: type_flow(_sigs(s, d)).where("confidence = 0.85"),
    "j08_shared_return": lambda s, d: type_flow(_sigs(s, d)).where("confidence = 0.65"),
    "j09_shared_param": lambda s, d: type_flow(_sigs(s, d)).where("confidence = 0.45"),
    "j10_shared_methods": lambda s, d: _class_pairs(s, d),
    "j12_resolve_calls": lambda s, d: resolve_calls(_wanted(s, d).select(F.col("importer").alias("caller"), "target"), _symbols(s, d)),
    "j15_import_targets": lambda s, d: import_targets(_wanted(s, d), _symbols(s, d)),
    "j16_ranked_imports": lambda s, d: ranked_imports(_wanted(s, d), _symbols(s, d)),
    "j17_innermost_symbol": lambda s, d: innermost(_offsets(s, d), with_ranges(nodes(s, d)).select("file_path", "node_id", "byte_start", "byte_end"), "file_path", "off"),
    "j18_overlap": lambda s, d: with_ranges(nodes(s, d)).where("byte_end > 150 and byte_start < 420").select("node_id", "file_path", "byte_start", "byte_end"),
    "j19_packages": lambda s, d: longest_prefix(_symbols(s, d).select("qname").distinct(), "qname", table(s, d, "part").where("p_partkey % 16 < 8").select(F.substring_index(_qname("p_partkey", "p_name"), ".", 1).alias("pkg")).union(table(s, d, "part").where("p_size > 45").select(F.substring_index(_qname("p_partkey", "p_name"), ".", 2))), "pkg"),
    "j20_resolve_symbol": lambda s, d: _resolve(s, d, "n2", "Customer#000000010"),
    "j22_enrich": lambda s, d: nodes(s, d).select("node_id").join(edges(s, d).groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("callers")), "node_id", "left").join(edges(s, d).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("deps")), "node_id", "left").fillna(0, ["callers", "deps"]),
    "j23_file_dependencies": lambda s, d: edges(s, d).join(nodes(s, d).select(F.col("node_id").alias("src"), F.col("file_path").alias("f")), "src").join(nodes(s, d).select(F.col("node_id").alias("dst"), F.col("file_path").alias("t")), "dst").where("f <> t").groupBy("f").agg(F.countDistinct("t").alias("n")),
    "j24_drift": lambda s, d: drift(_files(s, d, 0), _files(s, d, 1), "path", "hash").select("path", "kind"),
    "j25_changed_files": lambda s, d: drift(_files(s, d, 2), _files(s, d, 3), "path", "hash").where("kind <> 'same'").groupBy("kind").agg(F.count("*").alias("n")),
    "j26_merge_graphs": lambda s, d: _merged(s, d),
    "s13_edge_upsert": lambda s, d: upsert(edges(s, d).where("edge_type = 'Call'").select("src", "dst", F.lit("old").alias("meta")), edges(s, d).where("edge_type = 'Call' and confidence > 0.95").select("src", "dst", F.lit("new").alias("meta")), ["src", "dst"], F.col("meta")).groupBy("meta").agg(F.count("*").alias("n")),
    "s14_symbol_upsert": lambda s, d: upsert(nodes(s, d).select("project_id", "name", F.lit(None).cast("string").alias("signature"), "complexity"), nodes(s, d).where("complexity > 30").select("project_id", "name", F.lit(None).cast("string").alias("signature"), (F.col("complexity") + 100).alias("complexity")), ["project_id", "name", "signature"], F.col("complexity")).groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(F.col("complexity") > 100).alias("updated")),
    "s15_delete_by_project": lambda s, d: nodes(s, d).where("project_id <> 'orders'").groupBy("project_id").agg(F.count("*").alias("n")),
    "s18_fingerprint": lambda s, d: edge_fingerprint(edges(s, d)),
    "s19_merge_stores": lambda s, d: nodes(s, d).where("complexity < 30").unionByName(nodes(s, d).where("complexity > 20")).dropDuplicates(["node_id"]).groupBy("node_type").agg(F.count("*").alias("n")),
    "m08_project_dep_upsert": lambda s, d: upsert(_deps(s, d).withColumn("kind", F.lit("a")), _deps(s, d).where("project_id < 'n2'").withColumn("kind", F.lit("b")), ["project_id", "depends_on"], F.col("kind")),
    "m14_file_tree": lambda s, d: table(s, d, "pages").select("url", F.substring_index("url", "/", -1).alias("base")).orderBy("url"),
    "m20_neighbours": lambda s, d: edges(s, d).where("src = 'n3'").select("dst").unionAll(edges(s, d).where("dst = 'n3'").select(F.col("src").alias("dst"))),
    "m21_file_summaries": lambda s, d: nodes(s, d).groupBy("file_path").agg(F.min_by("language", "node_id").alias("language")).join(nodes(s, d).where("node_type = 'FileSummary'").select(F.col("node_id").alias("file_path")), "file_path", "left_anti"),
    "m22_cross_merge": lambda s, d: nodes(s, d).where("project_id = 'n1'").withColumn("origin", F.lit("a")).unionByName(nodes(s, d).where("project_id = 'n2'").withColumn("origin", F.lit("b"))).groupBy("origin").agg(F.count("*").alias("n")),
}


def _without_file(s, d, file: str) -> DataFrame:
    own = nodes(s, d).where(F.col("file_path") == file)
    return edges(s, d).join(own.select(F.col("node_id").alias("src")), "src", "left_anti").join(own.select(F.col("node_id").alias("dst")), "dst", "left_anti")


def _class_pairs(s, d) -> DataFrame:
    """Pairs of suppliers that share three parts or more: by an equi-join on the shared part, never all pairs."""
    has = table(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    both = has.alias("a").join(has.alias("b"), F.col("a.l_partkey") == F.col("b.l_partkey")).where("a.l_suppkey < b.l_suppkey")
    return both.groupBy(F.col("a.l_suppkey").alias("a"), F.col("b.l_suppkey").alias("b")).agg(F.count("*").alias("shared")).where("shared >= 3").select("a", "b", "shared", F.when(F.col("shared") >= 4, 0.75).otherwise(0.6).alias("confidence"))


def _resolve(s, d, project: str, name: str) -> DataFrame:
    """A symbol in its project, else in those it depends on, else anywhere."""
    n = nodes(s, d).where(F.col("name") == name).select("node_id", "project_id")
    dep = _deps(s, d).where(F.col("project_id") == project).select(F.col("depends_on").alias("project_id"), F.lit(1).alias("_d"))
    tier = F.when(F.col("project_id") == project, 0).when(F.col("_d") == 1, 1).otherwise(2)
    return n.join(dep, "project_id", "left").select("node_id", "project_id", tier.alias("tier"))


def _merged(s, d) -> DataFrame:
    n, e = nodes(s, d), edges(s, d)
    merged, linked = merge_graphs(n.where("complexity < 30"), e.where("edge_type <> 'Call'"), n.where("complexity > 10"), e.where("edge_type in ('Call', 'Import')"))
    return merged.agg(F.count("*").alias("n")).withColumn("what", F.lit("nodes")).unionByName(linked.agg(F.count("*").alias("n")).withColumn("what", F.lit("edges")))


_FLOW = SIGS + """, takes AS (SELECT DISTINCT qname AS dst, unnest(params) AS t FROM sigs), gives AS (SELECT qname AS src, returns AS t FROM sigs WHERE returns IS NOT NULL), calls AS (SELECT DISTINCT qname AS src, unnest(calls) AS dst FROM sigs),
flow AS (SELECT src, dst, 0.85 AS confidence, g.t AS label FROM gives g JOIN takes k ON g.t = k.t WHERE src <> dst
UNION ALL SELECT c.src, c.dst, 0.65, 'ret:' || g.t FROM calls c JOIN gives g ON c.src = g.src JOIN gives h ON c.dst = h.src WHERE g.t = h.t AND c.src <> c.dst
UNION ALL SELECT c.src, c.dst, 0.45, 'param:' || min(a.t) FROM calls c JOIN takes a ON a.dst = c.src JOIN takes b ON b.dst = c.dst AND a.t = b.t WHERE c.src <> c.dst GROUP BY c.src, c.dst),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC, label DESC) AS r FROM flow) WHERE r = 1)"""
_BEST = "SELECT src, dst, CAST(confidence AS DOUBLE) AS confidence, label FROM best WHERE confidence = "
_CODE = "SELECT p.project_id, p.base_name, p.instance, p.fingerprint, coalesce(f.c, 0) AS file_count, coalesce(f.k, 0) AS node_count, coalesce(e.c, 0) AS edge_count FROM projects p LEFT JOIN (SELECT project_id, count(DISTINCT file_path) AS c, count(*) AS k FROM nodes GROUP BY 1) f ON f.project_id = p.project_id LEFT JOIN (SELECT n.project_id, count(*) AS c FROM edges e JOIN nodes n ON n.node_id = e.src GROUP BY 1) e ON e.project_id = p.project_id"
SQL = {
    "j01_codebases": sql(_CODE, PROJECTS, NODES, EDGES),
    "j02_dashboard": sql("SELECT b.project_id, b.base_name, file_count, node_count, edge_count, (SELECT count(*) FROM edges e JOIN nodes n ON n.node_id = e.src WHERE e.edge_type = 'Import' AND n.project_id = b.project_id) AS import_edges, (SELECT count(*) FROM refs WHERE source_project = b.project_id) AS external_refs, (SELECT count(*) FROM deps WHERE deps.project_id = b.project_id) AS project_deps FROM base b", PROJECTS, NODES, EDGES, DEPS, REFS, f"base AS ({_CODE})"),
    "j03_hotspot_join": sql("SELECT n.node_id, count(e.dst) AS fan_out FROM nodes n LEFT JOIN edges e ON e.src = n.node_id GROUP BY 1", NODES, EDGES),
    "j04_graph_links": sql("SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE project_id = 'parts') ORDER BY src, dst LIMIT 5000", NODES, EDGES),
    "j05_drop_file_edges": sql("SELECT edge_type, count(*) AS n FROM edges WHERE src NOT IN (SELECT node_id FROM nodes WHERE file_path = 'n3') AND dst NOT IN (SELECT node_id FROM nodes WHERE file_path = 'n3') GROUP BY 1", NODES, EDGES),
    "j07_type_flow": sql(_BEST + "0.85", _FLOW), "j08_shared_return": sql(_BEST + "0.65", _FLOW), "j09_shared_param": sql(_BEST + "0.45", _FLOW),
    "j10_shared_methods": "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared, CAST(CASE WHEN count(*) >= 4 THEN 0.75 ELSE 0.6 END AS DOUBLE) AS confidence FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3",
    "j12_resolve_calls": sql("SELECT importer AS caller, target, node_id, 'direct' AS how FROM meets UNION ALL " + LOOSE, SYMBOLS, WANTED, MEETS),
    "j15_import_targets": sql("SELECT i.importer, i.target, coalesce(CASE WHEN i.parts > 1 THEN m.n END, l.n, 'external:' || i.target) AS resolved FROM imports i LEFT JOIN (SELECT importer, min(node_id) AS n FROM meets GROUP BY 1) m ON m.importer = i.importer LEFT JOIN (SELECT last, min(node_id) AS n FROM symbols GROUP BY 1) l ON l.last = i.last", SYMBOLS, WANTED, MEETS),
    "j16_ranked_imports": sql("SELECT importer, target, node_id, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY importer, target ORDER BY score DESC, node_id) AS rank FROM (SELECT i.importer, i.target, s.node_id, CASE WHEN i.target = s.qname THEN 300 ELSE 0 END + CASE WHEN ends_with(s.qname, '.' || i.target) THEN 200 ELSE 0 END + 100 + CASE WHEN i.lang = s.language THEN 50 ELSE 0 END + CASE WHEN s.node_type = 'Module' THEN 120 ELSE 0 END AS score FROM imports i JOIN symbols s ON i.last = s.last)) WHERE rank <= 3", SYMBOLS, WANTED),
    "j17_innermost_symbol": sql("SELECT file_path, off, node_id, byte_start, byte_end FROM (SELECT o.file_path, o.off, r.node_id, r.byte_start, r.byte_end, row_number() OVER (PARTITION BY o.file_path, o.off ORDER BY r.byte_end - r.byte_start, r.node_id) AS k FROM (SELECT f.file_path, t.off FROM (SELECT DISTINCT file_path FROM nodes) f CROSS JOIN (VALUES (5), (117), (250), (1003), (90)) t(off)) o JOIN ranged r ON r.file_path = o.file_path AND r.byte_start <= o.off AND o.off < r.byte_end) WHERE k = 1", NODES, RANGED),
    "j18_overlap": sql("SELECT node_id, file_path, byte_start, byte_end FROM ranged WHERE byte_end > 150 AND byte_start < 420", NODES, RANGED),
    "j19_packages": sql("SELECT qname, arg_max(p, length(p)) AS package FROM (SELECT DISTINCT qname, string_split(qname, '.') AS w FROM symbols) q LEFT JOIN (SELECT DISTINCT 'm' || (p_partkey // 8) AS p FROM part WHERE p_partkey % 16 < 8 UNION SELECT DISTINCT 'm' || (p_partkey // 8) || '.' || string_split(p_name, ' ')[1] FROM part WHERE p_size > 45) k ON string_split(p, '.')[1] = w[1] AND starts_with(qname, p || '.') GROUP BY 1", SYMBOLS),
    "j20_resolve_symbol": sql("SELECT node_id, project_id, CASE WHEN project_id = 'n2' THEN 0 WHEN project_id IN (SELECT depends_on FROM deps WHERE deps.project_id = 'n2') THEN 1 ELSE 2 END AS tier FROM nodes WHERE name = 'Customer#000000010'", PROJECTS, NODES, DEPS),
    "j22_enrich": sql("SELECT node_id, coalesce(a.c, 0) AS callers, coalesce(b.c, 0) AS deps FROM nodes LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY 1) a ON a.dst = node_id LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY 1) b ON b.src = node_id", NODES, EDGES),
    "j23_file_dependencies": sql("SELECT a.file_path AS f, count(DISTINCT b.file_path) AS n FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst WHERE a.file_path <> b.file_path GROUP BY 1", NODES, EDGES),
    "j24_drift": f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.hash = b.hash THEN 'same' ELSE 'changed' END AS kind FROM ({_file_sql(0)}) a FULL JOIN ({_file_sql(1)}) b ON a.path = b.path",
    "j25_changed_files": f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.hash = b.hash THEN 'same' ELSE 'changed' END AS kind FROM ({_file_sql(2)}) a FULL JOIN ({_file_sql(3)}) b ON a.path = b.path) WHERE kind <> 'same' GROUP BY 1",
    "j26_merge_graphs": sql("SELECT count(*) AS n, 'nodes' AS what FROM (SELECT node_id FROM nodes WHERE complexity < 30 UNION SELECT node_id FROM nodes WHERE complexity > 10) UNION ALL SELECT count(*), 'edges' FROM (SELECT DISTINCT src, dst, edge_type FROM edges)", NODES, EDGES),
    "s13_edge_upsert": sql("SELECT CASE WHEN confidence > 0.95 THEN 'new' ELSE 'old' END AS meta, count(*) AS n FROM (SELECT src, dst, max(confidence) AS confidence FROM edges WHERE edge_type = 'Call' GROUP BY 1, 2) GROUP BY 1", EDGES),
    "s14_symbol_upsert": sql("SELECT project_id, count(*) AS n, count(*) FILTER (WHERE m > 30) AS updated FROM (SELECT project_id, name, max(complexity) AS m FROM nodes GROUP BY 1, 2) GROUP BY 1", NODES),
    "s15_delete_by_project": sql("SELECT project_id, count(*) AS n FROM nodes WHERE project_id <> 'orders' GROUP BY 1", NODES),
    "s18_fingerprint": sql("SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) AS total, bit_xor(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS mixed FROM (SELECT md5(src || '|' || dst || '|' || edge_type) AS h FROM edges)", EDGES),
    "s19_merge_stores": sql("SELECT node_type, count(*) AS n FROM nodes GROUP BY 1", NODES),
    "m08_project_dep_upsert": sql("SELECT project_id, depends_on, CASE WHEN project_id < 'n2' THEN 'b' ELSE 'a' END AS kind FROM deps", PROJECTS, DEPS),
    "m14_file_tree": "SELECT url, list_extract(string_split(url, '/'), -1) AS base FROM pages ORDER BY url",
    "m20_neighbours": sql("SELECT dst FROM edges WHERE src = 'n3' UNION ALL SELECT src FROM edges WHERE dst = 'n3'", EDGES),
    "m21_file_summaries": sql("SELECT file_path, arg_min(language, node_id) AS language FROM nodes WHERE file_path NOT IN (SELECT node_id FROM nodes WHERE node_type = 'FileSummary') GROUP BY 1", NODES),
    "m22_cross_merge": sql("SELECT CASE WHEN project_id = 'n1' THEN 'a' ELSE 'b' END AS origin, count(*) AS n FROM nodes WHERE project_id IN ('n1', 'n2') GROUP BY 1", NODES),
}
