"""From source files to symbols and dependencies: parsers, complexity, flow graphs, the graph builder."""

from __future__ import annotations

import ast
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from codelake.functions.text import COMMON_TYPES, imports_of, normalize_symbol
from codelake.operators.joins import resolve_calls, type_flow
from codelake.plans.views import table

SIGNATURE = (
    "path string, language string, name string, qname string, returns string, params array<string>, calls array<string>, bases array<string>, is_method boolean, is_async boolean, visibility string,"
    " docstring string, byte_start long, byte_end long, complexity int, nesting int, error string"
)
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert, ast.match_case)
#: How languages other than Python open functions and types.
PATTERNS = {
    "javascript": r"(?:function\s+(?P<f>\w+)\s*\((?P<p>[^)]*)\)|class\s+(?P<c>\w+)(?:\s+extends\s+(?P<b>[\w.]+))?|(?:const|let|var)\s+(?P<g>\w+)\s*=\s*(?:async\s*)?\((?P<q>[^)]*)\)\s*=>)",
    "go": r"func\s+(?:\([^)]*\)\s*)?(?P<f>\w+)\s*\((?P<p>[^)]*)\)|type\s+(?P<c>\w+)\s+(?:struct|interface)", "rust": r"fn\s+(?P<f>\w+)[^(\n]*\((?P<p>[^)]*)\)|(?:struct|enum|trait)\s+(?P<c>\w+)",
    "java": r"(?:class|interface|enum)\s+(?P<c>\w+)(?:\s+extends\s+(?P<b>\w+))?|(?:[\w<>\[\]]+)\s+(?P<f>\w+)\s*\((?P<p>[^)]*)\)\s*(?:throws\s+[\w, ]+)?\{", "ruby": r"def\s+(?:self\.)?(?P<f>[\w?!]+)(?:\((?P<p>[^)]*)\))?|(?:class|module)\s+(?P<c>\w+)(?:\s*<\s*(?P<b>[\w:]+))?",
    "php": r"function\s+(?P<f>\w+)\s*\((?P<p>[^)]*)\)|(?:class|interface|trait)\s+(?P<c>\w+)(?:\s+extends\s+(?P<b>\w+))?", "lua": r"function\s+(?P<f>[\w.:]+)\s*\((?P<p>[^)]*)\)", "bash": r"^(?:function\s+)?(?P<f>\w+)\s*\(\)\s*\{",
    "scala": r"def\s+(?P<f>\w+)[^(\n]*\((?P<p>[^)]*)\)|(?:class|trait|object)\s+(?P<c>\w+)(?:\s+extends\s+(?P<b>\w+))?", "c": r"^[\w*\s]+?\b(?P<f>\w+)\s*\((?P<p>[^;{)]*)\)\s*\{|struct\s+(?P<c>\w+)\s*\{",
}
PATTERNS |= {"typescript": PATTERNS["javascript"], "csharp": PATTERNS["java"], "cpp": PATTERNS["c"] + r"|class\s+(?P<d>\w+)(?:\s*:\s*(?:public\s+)?(?P<b>\w+))?"}
_KEYWORDS = frozenset("if for while switch return catch else do new sizeof function match loop elif until case".split())


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}".lstrip(".")
    return ""


def _nesting(node: ast.AST, depth: int = 0) -> int:
    deeper = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.Try, ast.Match)
    return max([depth, *(_nesting(c, depth + isinstance(c, deeper)) for c in ast.iter_child_nodes(node))])


def parse_python(path: str, text: str) -> list[dict]:
    """Signatures of a module's functions, methods and classes. A syntax error is one row with the error."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [{"path": path, "language": "python", "error": str(e)[:200], "params": [], "calls": [], "bases": []}]
    starts = [0]
    for line in text.encode().split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    out = []

    def visit(node: ast.AST, scope: list[str], in_class: bool) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(c, ast.ClassDef)
                args = [] if cls else [*c.args.posonlyargs, *c.args.args, *c.args.kwonlyargs]
                own = [n for n in ast.walk(c)]
                out.append(
                    {
                        "path": path, "language": "python", "name": c.name, "qname": ".".join([*scope, c.name]), "returns": "class" if cls else (ast.unparse(c.returns) if c.returns else None),
                        "params": [ast.unparse(a.annotation) if a.annotation else a.arg for a in args if a.arg not in ("self", "cls")], "calls": sorted({x for n in own if isinstance(n, ast.Call) and (x := _dotted(n.func))}),
                        "bases": [_dotted(b) for b in c.bases] if cls else [], "is_method": in_class and not cls, "is_async": isinstance(c, ast.AsyncFunctionDef), "visibility": "private" if c.name.startswith("_") else "public",
                        "docstring": ast.get_docstring(c), "byte_start": starts[c.lineno - 1] + c.col_offset, "byte_end": starts[c.end_lineno - 1] + c.end_col_offset,
                        "complexity": 1 + sum(isinstance(n, _BRANCH) or isinstance(n, ast.BoolOp) * (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in own), "nesting": _nesting(c), "error": None,
                    }
                )
                visit(c, [*scope, c.name], cls)
            else:
                visit(c, scope, in_class)

    visit(tree, [], False)
    return out


def parse_pattern(path: str, language: str, text: str) -> list[dict]:
    """Signatures by the language's patterns; a symbol ends where the next begins."""
    found = [m for m in re.finditer(PATTERNS[language], text, re.M) if (m.groupdict().get("f") or "") not in _KEYWORDS]
    out = []
    for i, m in enumerate(found):
        g = m.groupdict()
        name = g.get("f") or g.get("g") or g.get("c") or g.get("d")
        cls = bool(g.get("c") or g.get("d"))
        end = found[i + 1].start() if i + 1 < len(found) else len(text)
        body = text[m.end() : end]
        params = [p.strip() for p in (g.get("p") or g.get("q") or "").split(",") if p.strip()]
        out.append(
            {
                "path": path, "language": language, "name": name, "qname": name, "returns": "struct" if cls else None, "params": params, "calls": sorted(set(re.findall(r"\b([A-Za-z_][\w.]*)\s*\(", body)) - _KEYWORDS),
                "bases": [g["b"]] if g.get("b") else [], "is_method": False, "is_async": "async" in m[0], "visibility": "private" if (name or "").startswith("_") else "public", "docstring": None,
                "byte_start": len(text[: m.start()].encode()), "byte_end": len(text[:end].encode()), "complexity": 1 + len(re.findall(r"\b(?:if|for|while|case|catch|elif|when)\b|&&|\|\|", body)), "nesting": 0, "error": None,
            }
        )
    return out


def parse(sources: DataFrame) -> DataFrame:
    """sources: path, language, content. Signature rows; a file that fails is a row with its error."""

    schema = to_arrow_schema(_parse_datatype_string(SIGNATURE))

    def run(batches):
        for b in batches:
            rows = []
            for path, language, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if language == "python":
                    try:
                        rows += parse_python(path, text or "")
                    except RecursionError as e:  # the tree is deeper than its visitor may go
                        rows.append({"path": path, "language": "python", "error": str(e)[:200], "params": [], "calls": [], "bases": []})
                elif language in PATTERNS:
                    rows += parse_pattern(path, language, text or "")
            yield pa.RecordBatch.from_pylist(rows, schema)

    return sources.select("path", "language", "content").mapInArrow(run, SIGNATURE)


def parse_stats(sources: DataFrame, signatures: DataFrame) -> DataFrame:
    failed = signatures.where("error is not null").agg(F.countDistinct("path").alias("failed"))
    return sources.agg(F.count("*").alias("total")).join(failed, F.lit(True)).join(signatures.where("error is null").agg(F.count("*").alias("signatures")), F.lit(True)).select("total", (F.col("total") - F.col("failed")).alias("ok"), "failed", "signatures")  # single rows


def typed_nodes(signatures: DataFrame) -> DataFrame:
    """Symbols with ids and types; complexity falls back to parameters; names that repeat in a file carry their range."""
    kind = F.when(F.col("returns") == "module", "Module").when(F.col("returns") == "enum_variant", "Variable").when(F.col("returns").isin("enum", "trait", "class") | F.col("returns").startswith("struct"), "Class").when(F.col("is_method"), "Method").otherwise("Function")
    repeated = F.count("*").over(W.partitionBy("path", "qname")) > 1
    name = F.when(repeated, F.concat("qname", F.lit("@"), F.col("byte_start").cast("string"), F.lit(".."), F.col("byte_end").cast("string"))).otherwise(F.col("qname"))
    good = signatures.where("error is null")
    return good.select(F.concat_ws(":", "path", name).alias("node_id"), F.coalesce(kind, F.lit("Function")).alias("node_type"), "name", "qname", F.col("path").alias("file_path"), "language", F.when(F.col("complexity") > 0, F.col("complexity")).otherwise(1 + F.size("params")).alias("complexity"), "byte_start", "byte_end")


def inheritance_confidence(is_super: Column, overrides: Column, named: Column, nested: Column) -> Column:
    """The strongest evidence; under 0.45 none."""
    over = F.when(overrides <= 1, 0.0).when(overrides == 2, 0.45).when(overrides == 3, 0.60).otherwise(0.75)
    best = F.greatest(F.when(is_super, 0.90).otherwise(0.0), over, F.when(named, 0.50).otherwise(0.0), F.when(nested, 0.70).otherwise(0.0))
    return F.when(best >= 0.45, best)


def build_graph(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of source files: containment, calls, imports, inheritance and type flow."""
    signatures = parse(sources)
    good = signatures.where("error is null")
    n = typed_nodes(signatures)
    contained = n.where(F.col("qname").contains(".")).select(F.col("node_id").alias("dst"), "file_path", F.regexp_replace("qname", "\\.[^.]*$", "").alias("qname")).join(n.select("file_path", "qname", F.col("node_id").alias("src")), ["file_path", "qname"]).select("src", "dst", F.lit("Containment").alias("edge_type"), F.lit(None).cast("double").alias("confidence"))
    callers = good.select(F.concat_ws(":", "path", "qname").alias("caller"), F.explode(F.transform("calls", normalize_symbol)).alias("target")).where("target <> ''")
    calls = resolve_calls(callers, n.select("qname", "node_id")).where("caller <> node_id").select(F.col("caller").alias("src"), F.col("node_id").alias("dst"), F.lit("Call").alias("edge_type"), F.when(F.col("how") == "direct", 1.0).otherwise(0.7).alias("confidence"))
    classes = n.where("node_type = 'Class'").select("name", F.col("node_id").alias("dst"))
    bases = good.select(F.concat_ws(":", "path", "qname").alias("src"), F.explode("bases").alias("name")).join(classes, "name").select("src", "dst", F.lit("Inheritance").alias("edge_type"), F.lit(0.9).alias("confidence"))
    imports = sources.select("path", F.explode(imports_of(F.col("content"), F.col("language"))).alias("target")).select(F.concat("path", F.lit(":__module__")).alias("src"), F.concat(F.lit("external:"), "target").alias("dst"), F.lit("Import").alias("edge_type"), F.lit(None).cast("double").alias("confidence"))
    linkable = F.filter("params", lambda p: ~p.isin(COMMON_TYPES))
    flows = type_flow(good.select(F.concat_ws(":", "path", "qname").alias("qname"), F.when(~F.col("returns").isin([*COMMON_TYPES, "None", "class"]), F.col("returns")).alias("returns"), linkable.alias("params"), "calls")).select("src", "dst", F.lit("DataDependency").alias("edge_type"), "confidence")
    out = contained.unionByName(calls).unionByName(bases).unionByName(imports).unionByName(flows)
    return n, out.dropDuplicates(["src", "dst", "edge_type"])


def flow_graph(text: str, name: str) -> tuple[list[str], list[tuple[int, int, str]]]:
    """Blocks and edges (from, to, kind) of a Python function: Unconditional, TrueBranch, FalseBranch, Loop, Exception."""
    fn = next(n for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == name)
    blocks, edges = ["entry"], []

    def run(body: list[ast.stmt], at: list[tuple[int, str]]) -> list[tuple[int, str]]:
        for s in body:
            blocks.append(type(s).__name__)
            here = len(blocks) - 1
            edges.extend((a, here, k) for a, k in at)
            if isinstance(s, ast.If):
                at = run(s.body, [(here, "TrueBranch")]) + (run(s.orelse, [(here, "FalseBranch")]) if s.orelse else [(here, "FalseBranch")])
            elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
                edges.extend((a, here, "Loop") for a, _ in run(s.body, [(here, "TrueBranch")]))
                at = [(here, "FalseBranch")]
            elif isinstance(s, ast.Try):
                ends = run(s.body, [(here, "Unconditional")])
                for h in s.handlers:
                    ends += run(h.body, [(here, "Exception")])
                at = run(s.finalbody, ends) if s.finalbody else ends
            elif isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
                at = []
            else:
                at = [(here, "Unconditional")]
        return at

    blocks_end = run(fn.body, [(0, "Unconditional")])
    blocks.append("exit")
    edges.extend((a, len(blocks) - 1, k) for a, k in blocks_end)
    return blocks, edges


def valid_syntax(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        def ok(t: str | None) -> bool:
            try:
                ast.parse(t)
            except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):  # a null is no program
                return False
            return True

        return texts.map(ok)

    return F.pandas_udf(run, "boolean")(text)


def git_status(raw: str) -> list[tuple[str, str]]:
    """(state, path) of `git status --porcelain=v2 -z`."""
    parts = iter(raw.split("\0"))
    out = []
    for x in parts:
        if x[:2] in ("1 ", "u "):
            out.append((x.split(" ")[1], x.split(" ", 8 if x[0] == "1" else 10)[-1]))
        elif x[:2] == "2 ":
            out.append((x.split(" ")[1], x.split(" ", 9)[-1]))
            next(parts, None)
        elif x[:2] in ("? ", "! "):
            out.append((x[0], x[2:]))
    return out


_CODE = [
    ("a.py", "python", "import os\nfrom pkg.util import helper\n\nclass Base:\n    def run(self, n: Job) -> Result:\n        if n and self:\n            return helper(n)\n        for x in n:\n            print(x)\n\nclass Child(Base):\n    def run(self, n: Job) -> Result:\n        return Base.run(self, n)\n\ndef make() -> Job:\n    return Child().run(1)\n\ndef consume(r: Result):\n    make()\n"),
    ("b.py", "python", "def broken(:\n"), ("c.js", "javascript", "import {x} from 'lib'\nclass Dog extends Animal {}\nfunction bark(a, b) { if (a) { woof(b) } }\n"), ("d.go", "go", "type T struct {}\nfunc (t T) Do(x int) { helper(x) }\n"), ("e.rs", "rust", "use std::fmt;\nstruct P;\nfn go(p: &P) -> u8 { if true { stop() } 1 }\n"),
]


def _src(s):
    return s.createDataFrame(_CODE, "path string, language string, content string")


def _evidence(s, d):
    """Suppliers with how many different parts they share in, modulo six."""
    over = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_partkey").alias("n"))
    return table(s, d, "supplier").select("s_suppkey").join(over, "s_suppkey", "left").select("s_suppkey", (F.col("s_suppkey") % 11).alias("k"), (F.coalesce("n", F.lit(0)) % 6).alias("over"))


def _modules(s, d):
    """Brands as Python modules: a function a part, a class with a method; one module is broken."""
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    body = F.when(F.col("p_size") > 25, F.concat(F.lit("    for i in x:\n        if i:\n            g"), F.col("p_size").cast("string"), F.lit("(i)\n"))).otherwise(F.concat(F.lit("    return Item.run(x, "), F.col("p_size").cast("string"), F.lit(")\n")))
    made = table(s, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("def "), name, F.lit("(x: Item, y=1):\n"), body, F.lit("\n")))), "").alias("defs"))
    head = F.concat(F.lit("import os\nfrom pkg."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(" import z\n\nclass Item:\n    def run(self, n):\n        return os.read(n)\n\n"))
    good = made.select(F.concat("p_brand", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.concat(head, "defs").alias("content"))
    return good.union(s.createDataFrame([("broken.py", "python", "def broken(:\n")], good.schema))


QUERIES = {
    "s06_parse": lambda s, d: parse(_modules(s, d)).where("error is null").select("path", "qname", F.size("params").alias("params"), "is_method", "complexity", "nesting", F.array_join("calls", ",").alias("calls")),
    "x02_typed_nodes": lambda s, d: typed_nodes(parse(_modules(s, d))).select("node_id", "node_type", "complexity"),
    "x01_graph": lambda s, d: build_graph(_modules(s, d))[1].groupBy("edge_type").agg(F.count("*").alias("n")),
    "x09_complexity": lambda s, d: parse(_modules(s, d)).where("error is null").groupBy("path").agg(F.sum("complexity").alias("complexity"), F.max("nesting").alias("nesting")),
    "x10_parse_stats": lambda s, d: parse_stats(_modules(s, d), parse(_modules(s, d))),
    "x07_imports": lambda s, d: _modules(s, d).select("path", F.explode(imports_of(F.col("content"), F.col("language"))).alias("target")),
    "x04_inheritance": lambda s, d: _evidence(s, d).select("s_suppkey", inheritance_confidence(F.col("k") == 7, F.col("over"), F.col("k") % 3 == 1, F.col("k") % 4 == 0).alias("confidence")),
    "m43_valid_syntax": lambda s, d: table(s, d, "part").select("p_partkey", valid_syntax(F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("def "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("(:\n"))).otherwise(F.concat(F.lit("def "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("():\n    return "), F.col("p_size").cast("string")))).alias("ok")),
}
#: What the modules parse to, from the table alone.
_PARSED = (
    "SELECT p_brand || '.py' AS path, 'f' || p_partkey AS qname, 2 AS params, false AS is_method, CASE WHEN p_size > 25 THEN 3 ELSE 1 END AS complexity, CASE WHEN p_size > 25 THEN 2 ELSE 0 END AS nesting, CASE WHEN p_size > 25 THEN 'g' || p_size ELSE 'Item.run' END AS calls, 'Function' AS node_type FROM part"
    " UNION ALL SELECT DISTINCT p_brand || '.py', 'Item', 0, false, 1, 0, 'os.read', 'Class' FROM part UNION ALL SELECT DISTINCT p_brand || '.py', 'Item.run', 1, true, 1, 0, 'os.read', 'Method' FROM part"
)
SQL = {
    "x01_graph": f"SELECT 'Containment' AS edge_type, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'Import', 2 * count(DISTINCT p_brand) FROM part UNION ALL SELECT 'Call', CAST(count(*) FILTER (WHERE p_size <= 25) * (SELECT count(DISTINCT p_brand) FROM part) AS BIGINT) FROM part",
    "s06_parse": f"SELECT path, qname, params, is_method, complexity, nesting, calls FROM ({_PARSED})",
    "x02_typed_nodes": f"SELECT path || ':' || qname AS node_id, node_type, complexity FROM ({_PARSED})",
    "x09_complexity": f"SELECT path, CAST(sum(complexity) AS BIGINT) AS complexity, max(nesting) AS nesting FROM ({_PARSED}) GROUP BY 1",
    "x10_parse_stats": "SELECT count(DISTINCT p_brand) + 1 AS total, count(DISTINCT p_brand) AS ok, 1::BIGINT AS failed, CAST(count(*) + 2 * count(DISTINCT p_brand) AS BIGINT) AS signatures FROM part",
    "x07_imports": "SELECT DISTINCT p_brand || '.py' AS path, unnest(['os', 'pkg.' || lower(replace(p_brand, '#', '_'))]) AS target FROM part",
    "x04_inheritance": "SELECT s_suppkey, CAST(CASE WHEN c >= 0.45 THEN c END AS DOUBLE) AS confidence FROM (SELECT s_suppkey, greatest(CASE WHEN k = 7 THEN 0.9 ELSE 0 END, CASE WHEN o >= 4 THEN 0.75 WHEN o = 3 THEN 0.6 WHEN o = 2 THEN 0.45 ELSE 0 END, CASE WHEN k % 3 = 1 THEN 0.5 ELSE 0 END, CASE WHEN k % 4 = 0 THEN 0.7 ELSE 0 END) AS c FROM (SELECT s_suppkey, s_suppkey % 11 AS k, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) % 6 AS o FROM supplier))",
    "m43_valid_syntax": "SELECT p_partkey, p_partkey % 5 > 1 AS ok FROM part",
}
