"""Behaviour that the tables don't show: nulls, cycles, ties, boundaries, streams, the surface."""

import pytest
from pyspark.sql import functions as F

from codelake import api
from codelake.functions import text
from codelake.operators import aggregates, extraction, graph, joins, lookups, ranking, retrieval, vectors
from codelake.sources import files
from codelake.streaming import incremental

CODE = {
    "pkg/a.py": "import os\n\nclass Store:\n    def load(self, key: Key) -> Item:\n        if key:\n            return fetch(key)\n\ndef fetch(key: Key) -> Item:\n    return os.read(key)\n",
    "pkg/b.py": "from pkg.a import Store\n\ndef show(item: Item):\n    Store().load(1)\n    # fix the token here\n",
    "node_modules/x.js": "function hidden() {}\n", "README.txt": "no language\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, t in CODE.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    return root


@pytest.fixture(scope="module")
def index(spark, tree):
    return api.Index.of_tree(spark, str(tree))


def _one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def test_edges_without_confidence_pass(spark):
    e = spark.createDataFrame([("a", "b", "Call", None), ("a", "c", "Call", 0.4), ("a", "d", "Import", 0.9)], "src string, dst string, edge_type string, confidence double")
    assert [r.dst for r in e.where(lookups.edge_allowed(["Call"], 0.5)).collect()] == ["b"]


def test_reach_ends_on_cycles_and_counts_levels_once(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("a", "b")], "src string, dst string")
    assert {(r.node_id, r.depth) for r in graph.reach(e, _one(spark, "a").withColumnRenamed("x", "node_id"), 10).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert {r.node_id for r in graph.in_cycles(e.union(spark.createDataFrame([("z", "a"), ("c", "y")], e.schema)), 4).collect()} == {"a", "b", "c"}


def test_traversal_passes_through_nodes_it_leaves_out(spark):
    n = spark.createDataFrame([("a", "Class", 1), ("m", "Module", 1), ("z", "Class", 1)], "node_id string, node_type string, complexity int")
    e = spark.createDataFrame([("a", "m", "Call", None), ("m", "z", "Call", None)], "src string, dst string, edge_type string, confidence double")
    out = graph.traverse(n, e, _one(spark, "a").withColumnRenamed("x", "node_id"), graph.PRESETS["llm_context"])
    assert [r.node_id for r in out.collect()] == ["z"]


def test_complexity_buckets_at_their_bounds(spark):
    df = spark.createDataFrame([(0, 4), (1, 5), (2, 9), (3, 10), (4, 19), (5, 20), (6, None)], "i int, c int")
    assert [r.b for r in df.orderBy("i").select(aggregates.complexity_bucket(F.col("c")).alias("b")).collect()] == ["simple", "moderate", "moderate", "complex", "complex", "very_complex", "very_complex"]


def test_admission_lets_later_small_rows_in(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 4), (4, 2)], "i int, size int").withColumn("batch", F.lit("x"))
    assert [r.admitted for r in lookups.admit(df, F.col("size"), ["i"], 10, 10).orderBy("i").collect()] == [True, False, True, False]


def test_upsert_keeps_last_and_null_keys_match(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "s", 1)], "k string, s string, v int")
    new = spark.createDataFrame([("a", None, 2), ("c", "s", 2)], old.schema)
    assert {(r.k, r.v) for r in joins.upsert(old, new, ["k", "s"], F.col("v")).collect()} == {("a", 2), ("b", 1), ("c", 2)}


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 0.0, 1.0]


def test_quantise_constant_vectors(spark):
    codes, scale, bias = vectors.quantise(F.col("x"))
    back = _one(spark, [2.5, 2.5, 2.5], "array<double>").select(vectors.dequantise(codes, scale, bias).alias("v")).head().v
    assert all(abs(v - 2.5) < 1e-6 for v in back)


def test_text_functions(spark):
    cases = {"running": "run", "scoring": "score", "applied": "apply", "indexed": "index", "queries": "query", "boxes": "box", "handlers": "handler", "class": "class", "is": "is", "ies": "ies"}
    df = spark.createDataFrame(list(cases.items()), "w string, want string").select("want", text.stem(F.col("w")).alias("got"))
    assert [r.got for r in df.collect()] == [r.want for r in df.collect()]
    tokens = {"getHTTPValue2": ["get", "http", "value", "2"], "snake_case_x": ["snake", "case"], "ÜberMaß": ["über", "maß"]}
    got = spark.createDataFrame([(k,) for k in tokens], "w string").select("w", text.code_tokens(F.col("w")).alias("t"))
    assert {r.w: r.t for r in got.collect()} == tokens
    one = _one(spark, "the cat, the_cat the").select(text.replace_word(F.col("x"), "the", "a").alias("r"), text.keywords(F.lit("How does the search work?")).alias("k"), text.keywords(F.lit("how is it")).alias("all")).head()
    assert (one.r, one.k, one.all) == ("a cat, the_cat a", "search work?", "how is it")


def test_sanitize_query():
    assert text.sanitize_query("  café ") == "café"
    for bad in ("", "a\0b", "x" * 501):
        with pytest.raises(ValueError):
            text.sanitize_query(bad)


def test_intents(spark):
    want = {"show me how indexing works": "how_works", "where is login handled": "where_handled", "find bottlenecks": "bottlenecks", "most complex code": "bottlenecks", "why so": "semantic", "parser": "text"}
    df = spark.createDataFrame([(q,) for q in want], "q string").select("q", retrieval.intent(F.col("q")).alias("i"))
    assert {r.q: r.i for r in df.collect()} == want


def test_page_and_budget(spark):
    df = spark.range(30).withColumnRenamed("id", "n")
    assert [(r.n, r.has_more) for r in ranking.page(df, [F.col("n")], 10, 3).collect()] == [(10, True), (11, True), (12, True)]
    assert {r.n for r in ranking.numbered(df, ["n"], 4).where("place <> n").collect()} == set()


def test_parsers_and_flow_graph():
    rows = {r["qname"]: r for r in extraction.parse_python("a.py", CODE["pkg/a.py"])}
    assert rows["Store.load"]["complexity"] == 2 and rows["Store.load"]["is_method"] and rows["fetch"]["calls"] == ["os.read"]
    start, end = rows["fetch"]["byte_start"], rows["fetch"]["byte_end"]
    assert CODE["pkg/a.py"].encode()[start:end].startswith(b"def fetch") and CODE["pkg/a.py"].encode()[start:end].endswith(b"os.read(key)")
    blocks, edges = extraction.flow_graph("def f(x):\n    while x:\n        if x > 1:\n            x -= 1\n    return x\n", "f")
    assert blocks[0] == "entry" and {k for _, _, k in edges} == {"Unconditional", "TrueBranch", "FalseBranch", "Loop"}
    for language, code, names in [("go", "func (t T) Do(x int) {}\ntype T struct {}", {"Do", "T"}), ("rust", "pub fn go(p: &P) {}\nenum E {}", {"go", "E"}), ("ruby", "class A < B\n def x(y)\n end\nend", {"A", "x"}), ("php", "class A extends B { function f($x) {} }", {"A", "f"}), ("bash", "run() {\n}", {"run"}), ("lua", "function M.go(a) end", {"M.go"}), ("c", "int main(void) {\n}\n", {"main"})]:
        assert {r["name"] for r in extraction.parse_pattern("f", language, code)} == names, language


def test_git_status():
    raw = "1 .M N... 100644 100644 100644 aa bb src/a b.py\0? new.txt\0" + "2 R. N... 100644 100644 100644 aa bb R100 to.py\0from.py\0"
    assert extraction.git_status(raw) == [(".M", "src/a b.py"), ("?", "new.txt"), ("R.", "to.py")]


@pytest.mark.parametrize("name", [n for n in files.MANIFESTS])
def test_malformed_manifests_give_nothing(name):
    assert files.parse_manifest(name, "\0{[not a manifest") == []


def test_manifests():
    assert files.parse_manifest("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n)\nrequire golang.org/x/y v0.1.0\n") == [("github.com/a/b", "v1.2.3"), ("golang.org/x/y", "v0.1.0")]
    assert files.parse_manifest("Cargo.toml", '[dependencies]\nserde = { version = "1.0" }\nrand = "0.8"\n[profile]\nx = 1\n') == [("serde", "1.0"), ("rand", "0.8")]
    assert files.parse_manifest("package-lock.json", '{"packages": {"": {}, "node_modules/@a/b": {"version": "1.0"}}}') == [("@a/b", "1.0")]
    assert files.parse_manifest("Pipfile.lock", '{"default": {"six": {"version": "==1.0"}}}') == [("six", "1.0")]


def test_index_of_a_tree(index):
    assert {r.path.rsplit("/", 1)[-1] for r in index.sources.collect()} == {"a.py", "b.py"}
    assert {r.name for r in index.nodes.collect()} == {"Store", "load", "fetch", "show"}
    kinds = {(r.edge_type, r.dst.rsplit(":", 1)[-1]) for r in index.edges.collect()}
    assert ("Call", "fetch") in kinds and ("Containment", "Store.load") in kinds and ("Import", "os") in kinds and ("DataDependency", "show") in kinds


def test_surface(index, spark, tmp_path):
    assert index.status().head().files == 2
    assert index.search("fetch").head().name == "fetch"
    assert index.search("load", scope="elsewhere").count() == 0
    assert index.search("os read key", "semantic").head().name == "fetch"  # by its text: its name says nothing of it
    v = spark.createDataFrame([(r.node_id, [1.0, float(r.name == "show")]) for r in index.nodes.collect()], "vec_id string, embedding array<float>")
    near = index.search("zzz", "semantic", vectors_=v, vector=v.where("vec_id like '%show'"))
    assert near.head().name == "show" and index.search("zzz", "semantic").count() == 0
    assert index.analyze("how does fetching work").head().name == "fetch"
    assert index.grep("fet").head().name == "fetch"
    assert index.lookup("fetch").head().callers >= 1
    hit = index.text_search("TOKEN", ignore_case=True).head()
    assert hit.line == 5 and hit.before.endswith("load(1)") and index.text_search("fix.*token", regex=True).count() == 1
    assert index.read_symbol("fetch").head().text.startswith("def fetch")
    assert index.read_file(hit.path, 1, 2).count() == 2
    assert index.file_summary(hit.path).count() == 1 and index.project_map().count() == 2
    assert all(df.count() >= 0 for df in index.phases().values()) and index.diagnostics().count() >= 5
    assert index.context("show").count() >= 1
    assert index.impact("fetch", "remove").head().risk in ("medium", "high")
    assert index.rename_files("fetch").count() >= 1
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("FROM").alias("text")))
    assert "+FROM pkg.a" in index.preview(hit.path, edits).head().diff
    seen = index.sources.withColumn("content", F.replace("content", F.lit("def fetch(key: Key)"), F.lit("def fetch(key: Other)"))).withColumn("hash", F.sha2("content", 256))
    assert {(r.qname, r.kind, r.breaking) for r in index.validate(seen).collect()} == {("fetch", "changed", True)}
    assert index.refreshed(seen).sources.count() == 2
    index.publish(str(tmp_path), 1)
    index.publish(str(tmp_path), 2)
    assert api.Index.load(spark, str(tmp_path)).nodes.count() == index.nodes.count()


def test_streams(spark, tmp_path):
    schema = "path string, hash string"
    for i, rows in enumerate([[("a", "1"), ("b", "1")], [("a", "2")]]):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / str(i)))
        q = incremental.watch(spark, str(tmp_path / "in" / "*"), schema, str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
        q.awaitTermination(120)
    assert {(r.path, r.hash) for r in incremental.latest(spark, str(tmp_path / "out")).collect()} == {("a", "2"), ("b", "1")}


def test_save_replaces_only_its_projects(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "project_id string, v int")
    files.save_by_project(df, str(tmp_path / "s"))
    files.save_by_project(spark.createDataFrame([("b", 2)], df.schema), str(tmp_path / "s"))
    assert {(r.project_id, r.v) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("a", 1), ("b", 2)}


MANIFESTS = {
    "a/Cargo.lock": ('[[package]]\nname = "serde"\nversion = "1.0.1"\n\n[[package]]\nname = "tokio"\nversion = "1.2.0"\n', [("serde", "1.0.1"), ("tokio", "1.2.0")]),
    "a/Cargo.toml": ('[package]\nname = "x"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = ["full"] }\n', [("serde", "1.0"), ("tokio", "1.2")]),
    "b/package.json": ('{"dependencies": {"left-pad": "^1.0"}, "devDependencies": {"jest": "29"}}', [("left-pad", "^1.0"), ("jest", "29")]),
    "b/package-lock.json": ('{"packages": {"": {}, "node_modules/a": {"version": "1.0.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0"}}}', [("a", "1.0.0"), ("@s/b", "2.0.0")]),
    "c/requirements.txt": ("# comment\nnumpy==2.0\npandas>=1.5 ; python_version > '3'\n-r other.txt\nrequests\n", [("numpy", "2.0"), ("pandas", "1.5"), ("requests", "*")]),
    "c/Pipfile.lock": ('{"default": {"flask": {"version": "==2.0"}}, "develop": {"pytest": {"version": "==8.0"}}}', [("flask", "2.0"), ("pytest", "8.0")]),
    "c/poetry.lock": ('[[package]]\nname = "click"\nversion = "8.1"\n', [("click", "8.1")]),
    "d/go.sum": ("github.com/a/b v1.2.3 h1:x\ngithub.com/a/b v1.2.3/go.mod h1:y\n", [("github.com/a/b", "v1.2.3")]),
    "d/go.mod": ("module x.org/y\n\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgolang.org/x/z v0.1.0 // indirect\n)\n", [("github.com/a/b", "v1.2.3"), ("golang.org/x/z", "v0.1.0")]),
    "e/Gemfile.lock": ("GEM\n  specs:\n    rails (7.0.1)\n      rack (>= 2)\n    rack (2.2.3)\n", [("rails", "7.0.1"), ("rack", "2.2.3")]),
    "f/pyproject.toml": ('[project]\ndependencies = ["flask>=2.0", "click"]\n[tool.poetry.dependencies]\npython = "^3.9"\nattrs = "^22.1"\n', [("flask", "2.0"), ("click", "*"), ("attrs", "22.1")]),
    "g/package-lock.json": ("{broken", []), "h/notes.txt": ("numpy==1", []),
    "i/composer.lock": ('{"packages": [{"name": "a/b", "version": "1.0"}]}', [("a/b", "1.0")]), "j/yarn.lock": ('lodash@^4.0.0:\n  version "4.17.21"\n', [("lodash", "4.17.21")]),
    "k/pnpm-lock.yaml": ("packages:\n  /lodash@4.17.21:\n    resolution: {}\n  '@s/b@2.0.0':\n    dev: true\n", [("lodash", "4.17.21"), ("@s/b", "2.0.0")]),
    "l/bun.lock": ('{"packages": {"a": ["a@1.0.0", ""], "@s/b": ["@s/b@2.1.0", ""]}}', [("a", "1.0.0"), ("@s/b", "2.1.0")]),
}


@pytest.mark.parametrize("path", sorted(MANIFESTS))
def test_manifests_of_each_ecosystem(path):
    content, want = MANIFESTS[path]
    assert sorted(files.parse_manifest(path.rsplit("/", 1)[-1], content)) == sorted(want)


def test_manifests_as_rows(spark):
    got = files.dependencies(spark.createDataFrame([(p, c) for p, (c, _) in MANIFESTS.items()], "path string, content string"))
    assert sorted((r.path, r.name, r.version) for r in got.collect()) == sorted((p, *x) for p, (_, w) in MANIFESTS.items() for x in w)


LANGUAGES = [
    ("c.js", "javascript", "import {x} from 'lib'\nclass Dog extends Animal {}\nfunction bark(a, b) { if (a) { woof(b) } }\n"), ("d.go", "go", "type T struct {}\nfunc (t T) Do(x int) { helper(x) }\n"),
    ("e.rs", "rust", "use std::fmt;\nstruct P;\nfn go(p: &P) -> u8 { if true { stop() } 1 }\n"), ("b.py", "python", "def broken(:\n"), ("n.py", "python", None), ("deep.py", "python", "x = " + "(" * 5000 + ")" * 5000),
]


def test_parsers_of_other_languages_and_of_broken_texts(spark):
    got = extraction.parse(spark.createDataFrame(LANGUAGES, "path string, language string, content string")).collect()
    assert sorted((r.path, r.qname, len(r.params)) for r in got if r.error is None) == [("c.js", "Dog", 0), ("c.js", "bark", 2), ("d.go", "Do", 1), ("d.go", "T", 0), ("e.rs", "P", 0), ("e.rs", "go", 1)]
    assert {r.path for r in got if r.error} == {"b.py", "deep.py"}


def test_syntax_of_nulls_and_deep_nesting(spark):
    df = spark.createDataFrame([(1, None), (2, "x = 1"), (3, "def broken(:"), (4, "x = " + "(" * 5000 + ")" * 5000), (5, "a\x00b")], "i int, t string")
    assert {r.i: r.ok for r in df.select("i", extraction.valid_syntax(F.col("t")).alias("ok")).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_status_records():
    assert extraction.git_status("1 .M N... 100644 100644 100644 aa bb a b.py\0? n.txt\0") == [(".M", "a b.py"), ("?", "n.txt")]
    assert extraction.git_status("2 R. N... 1 1 1 a b R100 new name\0old\0! x\0") == [("R.", "new name"), ("!", "x")]


def test_newest_row_of_a_batch_stays(spark, tmp_path):
    spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, "x")], "path string, seq int, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    incremental.watch(spark, str(tmp_path / "in"), "path string, seq int, v string", str(tmp_path / "out"), str(tmp_path / "ck"), once=True, order="seq").awaitTermination(60)
    assert {(r.path, r.v) for r in incremental.latest(spark, str(tmp_path / "out")).collect()} == {("a", "new"), ("b", "x")}


def test_ranks_of_a_range_shuffle_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert sorted(r.place for r in ranking.numbered(df, ["x"], 16).collect()) == list(range(1000))
    assert all(r.place == r.x for r in ranking.numbered(df, ["x"], 16).collect())


def test_calls_by_suffix_and_not_by_common_names(spark):
    symbols = spark.createDataFrame([("1", "a.b.load"), ("2", "c.b.load"), ("3", "a.new"), ("4", "z.helper")], "node_id string, qname string")
    calls = spark.createDataFrame([("x", "a.b.load"), ("y", "b.load"), ("z", "q.helper"), ("u", "q.new"), ("v", "helper")], "caller string, target string")
    got = {(r.caller, r.node_id, r.how) for r in joins.resolve_calls(calls, symbols).collect()}
    assert got == {("x", "1", "direct"), ("x", "2", "direct"), ("y", "1", "direct"), ("y", "2", "direct"), ("z", "4", "last"), ("v", "4", "direct")}


def test_ranked_imports_against_all_pairs(spark):
    import random

    r = random.Random(5)
    symbols = [(f"s{i:03}", ".".join(r.choice("abc") for _ in range(r.randint(1, 4))), r.choice(["py", "rs", None]), r.choice(["Module", "Function"])) for i in range(200)]
    imports = [(i, ".".join(r.choice("abc") for _ in range(r.randint(1, 3))), r.choice(["py", "rs", "go"])) for i in range(60)]
    want = set()
    for i, target, lang in imports:
        scored = []
        for node, q, language, kind in symbols:
            if q.split(".")[-1] == target.split(".")[-1]:
                scored.append((-(300 * (q == target) + 200 * q.endswith("." + target) + 100 + 50 * (language == lang) + 120 * (kind == "Module")), node))
        want |= {(i, node, -score, k + 1) for k, (score, node) in enumerate(sorted(scored)[:3])}
    got = joins.ranked_imports(spark.createDataFrame(imports, "importer int, target string, lang string"), spark.createDataFrame(symbols, "node_id string, qname string, language string, node_type string"))
    assert {(x.importer, x.node_id, x.score, x["rank"]) for x in got.collect()} == want


def test_eight_bit_search_finds_nine_of_ten(spark):
    from codelake.operators import supplement
    from codelake.plans.views import table

    v = table(spark, "/root/testdata/sf0.01", "embeddings")
    q = v.where("vec_id % 100 = 0")
    want = {(r.query_id, r.vec_id) for r in vectors.nearest(v, q, 10).collect()}
    got = {(r.query_id, r.vec_id) for r in supplement.int8_search(v, q, 10).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_eight_bit_search_makes_no_pairs_and_takes_queries_in_blocks(spark):
    from codelake.operators import supplement
    from codelake.plans.views import table

    v = table(spark, "/root/testdata/sf0.001", "embeddings")
    q = v.where("vec_id % 20 = 0")
    rows = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())
    whole = supplement.int8_search(v, q, 5)
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    assert rows(supplement.int8_search(v, q, 5, most=7)) == rows(whole)
    copies = spark.createDataFrame([(i, [1.0, 2.0, float(i % 2)]) for i in range(3000)] + [(5000, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>").repartition(3)
    got = rows(supplement.int8_search(copies, copies.where("vec_id in (0, 1, 5000)"), 3))
    assert got[:6] == [(0, k + 1, 2 * k, 1.0) for k in range(3)] + [(1, k + 1, 2 * k + 1, 1.0) for k in range(3)] and [x[3] for x in got[6:]] == [0.0] * 3


def _called(spark, n: int = 60):
    symbols = [(f"s{i}", f"m{i % 7}.{'big' if i % 3 else 'odd'}.{'load' if i % 2 else 'helper'}") for i in range(n)] + [("bare", "load")]
    calls = [(i, ("load", "x.helper", "big.load", "m1.q.odd.helper", "x.new", "gone.where")[i % 6]) for i in range(n)] + [(0, "load")]
    ends = lambda q, t: ("." + q).endswith("." + ".".join(t.split(".")[-2:]))
    want = set()
    for caller, t in calls:
        last = t.split(".")[-1]
        direct = [s for s, q in symbols if ("." in t and "." in q and ends(q, t)) or ("." not in t and q.split(".")[-1] == t)]
        loose = [s for s, q in symbols if q.split(".")[-1] == last] if last not in joins.COMMON_NAMES else []
        want |= {(caller, t, s, "direct" if direct else "last") for s in direct or loose}
    return spark.createDataFrame(calls, "caller int, target string"), spark.createDataFrame(symbols, "node_id string, qname string"), want


def test_calls_of_frequent_names_meet_in_blocks_and_pairs_are_not_shuffled(spark):
    calls, symbols, want = _called(spark)
    got = joins.resolve_calls(calls, symbols, block=4)
    rows = [(r.caller, r.target, r.node_id, r.how) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.split("Join")[0].count("Aggregate")  # nothing is gathered after the pairs are made


def test_calls_are_counted_without_pairs(spark):
    from collections import Counter

    calls, symbols, want = _called(spark)
    counts = lambda c, s: {r["how"]: r["n"] for r in joins.call_counts(c, s).collect()}
    assert counts(calls, symbols) == Counter(x[3] for x in want)
    assert counts(calls.limit(0), symbols) == {"direct": 0, "last": 0}
    many = spark.range(200_000).select(F.col("id").alias("caller"), F.lit("load").alias("target"))
    assert counts(many, spark.range(200_000).select(F.concat(F.lit("n"), "id").alias("node_id"), F.concat(F.lit("m"), "id", F.lit(".load")).alias("qname"))) == {"direct": 200_000**2, "last": 0}


def test_references_are_checked_without_pairs(spark, monkeypatch):
    from codelake.operators import supplement

    calls, symbols, want = _called(spark)
    monkeypatch.delattr(joins, "resolve_calls")
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    got = {r["kind"]: r["n"] for r in supplement.reference_check(calls.withColumnRenamed("caller", "importer"), symbols, ring, 3).collect()}
    assert got["undefined_call"] == 60 - len({x[0] for x in want}) and got["cycle"] == 2
