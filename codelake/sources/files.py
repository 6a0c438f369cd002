"""File sources: trees of files, their hashes, manifests, projects; and table stores with snapshots."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from codelake.functions.text import language_of
from codelake.plans.views import NODES, nodes, sql, table

#: Directories that no scan enters; manifest files by ecosystem.
SKIP_DIRS = (
    ".archive archive build coverage dist out target .idea .vscode bower_components node_modules vendor __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox .venv env venv .next .nuxt .git .hg .svn"
).split()
MANIFESTS = {
    "Cargo.lock": "cargo", "Cargo.toml": "cargo", "package-lock.json": "npm", "package.json": "npm", "yarn.lock": "npm", "pnpm-lock.yaml": "npm", "bun.lock": "npm", "requirements.txt": "python", "Pipfile.lock": "python",
    "pyproject.toml": "python", "poetry.lock": "python", "go.sum": "go", "go.mod": "go", "Gemfile.lock": "ruby", "composer.lock": "composer",
}


def skipped(path: Column) -> Column:
    names = "|".join(re.escape(d) for d in SKIP_DIRS)
    return path.rlike(f"(^|[/\\\\])({names})[/\\\\]")


def read_tree(spark: SparkSession, root: str, max_bytes: int = 10 << 20) -> DataFrame:
    """path, length, content of every file below root that no skipped directory holds; larger files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(~skipped(F.col("path")) & (F.col("length") <= max_bytes)).select("path", "length", "content")


def scan(files: DataFrame, max_files: int, max_total: int) -> DataFrame:
    """Files in path order until the number or the total size is reached."""
    run = F.sum("length").over(W.partitionBy(F.lit(0)).orderBy("path").rowsBetween(W.unboundedPreceding, W.currentRow))
    return files.orderBy("path").limit(max_files).withColumn("_t", run).where(F.col("_t") <= max_total).drop("_t")


def sources(files: DataFrame) -> DataFrame:
    """Text files of known languages with hash, for the parsers."""
    lang = language_of(F.col("path"))
    return files.select("path", lang.alias("language"), F.sha2("content", 256).alias("hash"), F.decode("content", "utf-8").alias("content")).where("language is not null")


def discover_projects(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Directories that hold .git, with the language most of their files are in; ties by name."""
    p = paths.select(F.col(path_col).alias("path"))
    roots = p.where(F.col("path").contains("/.git/")).select(F.substring_index("path", "/.git/", 1).alias("root")).distinct()
    # every ancestor of a file is tried, an equi-join
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    own = p.where(~skipped(F.col("path"))).select("path", language_of(F.col("path")).alias("language"), F.explode(up).alias("root")).join(roots, "root")
    counts = own.where("language is not null").groupBy("root", "language").agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(W.partitionBy("root").orderBy(F.desc("n"), "language"))).where("_r = 1").drop("_r")


# --- manifests -----------------------------------------------------------------------------------------------


def _pairs(pattern: str, text: str) -> list[tuple[str, str]]:
    return [(m[1], m[2] or "*") for m in re.finditer(pattern, text, re.M)]


def _toml_sections(text: str):
    section = ""
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if line.startswith("["):
            section = line.strip("[]").strip().lower()
        elif "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            yield section, key.strip("\"'"), value


def _version(value: str) -> str:
    m = re.search(r"version\s*=\s*[\"']([^\"']+)", value) or re.match(r"[\"']([^\"']+)", value)
    return m[1] if m else "*"


def _requirement(spec: str) -> tuple[str, str] | None:
    m = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:[=<>!~]=?=?\s*([^\s;,]+))?", spec)
    return (m[1], m[2] or "*") if m else None


def _npm_lock(doc: dict) -> list[tuple[str, str]]:
    out = [(k.rpartition("node_modules/")[2], v.get("version", "*")) for k, v in (doc.get("packages") or {}).items() if k]
    return out or [(k, v.get("version", "*")) for k, v in (doc.get("dependencies") or {}).items()]


def parse_manifest(name: str, text: str) -> list[tuple[str, str]]:
    """(package, version) pairs of a manifest or lock file, by its name; malformed ones give none."""
    try:
        if name in ("Cargo.lock", "poetry.lock"):
            return _pairs(r"^name = \"([^\"]+)\"\s*\nversion = \"([^\"]+)\"", text)
        if name == "Cargo.toml":
            return [(k, _version(v)) for s, k, v in _toml_sections(text) if "dependencies" in s]
        if name == "pyproject.toml":
            listed = re.search(r"^dependencies\s*=\s*\[(.*?)\]", text, re.S | re.M)
            own = [r for x in re.findall(r"[\"']([^\"']+)[\"']", listed[1]) if (r := _requirement(x))] if listed else []
            return own + [(k, _version(v).lstrip("^~=<> ")) for s, k, v in _toml_sections(text) if re.fullmatch(r"tool\.poetry\.(group\.[\w-]+\.)?(dev-)?dependencies", s) and k != "python"]
        if name == "requirements.txt":
            return [r for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "-")) and (r := _requirement(x))]
        if name == "package.json":
            doc = json.loads(text)
            return [(k, str(v)) for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for k, v in (doc.get(part) or {}).items()]
        if name == "package-lock.json":
            return _npm_lock(json.loads(text))
        if name in ("Pipfile.lock",):
            doc = json.loads(text)
            return [(k, str(v.get("version", "*")).lstrip("=")) for part in ("default", "develop") for k, v in (doc.get(part) or {}).items()]
        if name == "composer.lock":
            doc = json.loads(text)
            return [(p["name"], str(p.get("version", "*"))) for part in ("packages", "packages-dev") for p in doc.get(part) or []]
        if name == "yarn.lock":
            return [(m[1], m[2]) for m in re.finditer(r"^\"?(@?[^@\s\"]+)@[^\n]*:\s*\n\s+version:? \"?([^\"\n]+)\"?", text, re.M)]
        if name == "pnpm-lock.yaml":
            return [(m[1], m[2]) for m in re.finditer(r"^\s{2}['\"]?/?(@?[^@'\"\s:]+)[@/]([0-9][^'\"():\s]*)", text, re.M)]
        if name == "bun.lock":
            return [(m[1], m[2]) for m in re.finditer(r"\[\s*\"(@?[^@\"]+)@([^\"]+)\"", text)]
        if name == "go.sum":
            return sorted({(x[0], x[1].removesuffix("/go.mod")) for line in text.splitlines() if len(x := line.split()) >= 2 and x[1].startswith("v")})
        if name == "go.mod":
            block = re.findall(r"^\s*(?:require\s+)?([\w.-]+(?:\.[\w-]+)+/\S+|[\w.-]+\.[\w.-]+\S*)\s+(v\S+)", text, re.M)
            return [(a, b) for a, b in block]
        if name == "Gemfile.lock":
            return [(m[1], m[2]) for m in re.finditer(r"^ {4}([A-Za-z0-9_.-]+) \(([^)]+)\)", text, re.M)]
    except (ValueError, KeyError, TypeError, AttributeError):
        return []
    return []


def dependencies(manifests: DataFrame) -> DataFrame:
    """manifests: path, content (string). (path, name, version, ecosystem), each name once a manifest."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(path, n, v, MANIFESTS[path.rsplit("/", 1)[-1]]) for path, text in zip(pdf["path"], pdf["content"]) if path.rsplit("/", 1)[-1] in MANIFESTS for n, v in parse_manifest(path.rsplit("/", 1)[-1], text or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "version", "ecosystem"])

    return manifests.mapInPandas(run, "path string, name string, version string, ecosystem string").dropDuplicates(["path", "name"])


# --- stores --------------------------------------------------------------------------------------------------


def save_by_project(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the projects in df and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def publish(df: DataFrame, root: str, generation: int) -> str:
    """Writes a generation beside the earlier ones, then points to it: readers see the old one or the new."""
    target = f"{root}/generation={generation}"
    df.write.mode("overwrite").parquet(target)
    df.sparkSession.createDataFrame([(generation,)], "generation long").coalesce(1).write.mode("append").parquet(f"{root}/_pointer_table")
    return target


def current(spark: SparkSession, root: str) -> DataFrame:
    newest = spark.read.parquet(f"{root}/_pointer_table").agg(F.max("generation")).head()[0]
    return spark.read.parquet(f"{root}/generation={newest}")


def fingerprint(df: DataFrame) -> DataFrame:
    """An order-insensitive fingerprint of a table: count, sum and bit-xor of row hashes, aggregated by parts."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("s"))


def portable_fingerprint(df: DataFrame) -> DataFrame:
    """n, total and mixed: a fingerprint that other engines compute alike; by md5 of the columns joined by |, nulls left out."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]).cast("binary"))
    number = lambda at: F.conv(F.substring(h, at, 12), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.sum(number(1).cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(number(13)).alias("mixed"))


def _requirements(s, d):
    """A manifest a brand, with its parts as packages."""
    line = F.concat(F.lit("pkg-"), F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, ("==", ">=", "~= "))), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_size").cast("string"), F.lit(".0 ; python_version > '3'"))
    return table(s, d, "part").groupBy(F.concat("p_brand", F.lit("/requirements.txt")).alias("path")).agg(F.concat(F.lit("# made\n-r x.txt\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("content"))


_NAMES = ["Cargo.toml", "package.json", "readme.md", "go.sum", "Cargo.tom"]
_AT = lambda key, values: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _tree(s, d):
    """Pages as files of projects: a project a language and host, its marker, files of four languages."""
    p = table(s, d, "pages")
    root = F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/"), (F.col("page_id") % 3).cast("string"))
    return p.select(F.concat(root, F.lit("/f"), F.col("page_id").cast("string"), _AT("page_id", [".py", ".rs", ".py", ".txt", ".go", ".go", ".go"])).alias("path")).union(p.select(F.concat(root, F.lit("/.git/HEAD"))).distinct())


_FIXTURE = [
    ("a/Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.1"\n\n[[package]]\nname = "tokio"\nversion = "1.2.0"\n'),
    ("b/package.json", '{"dependencies": {"left-pad": "^1.0"}, "devDependencies": {"jest": "29"}}'),
    ("c/requirements.txt", "# comment\nnumpy==2.0\npandas>=1.5 ; python_version > '3'\n-r other.txt\nrequests\n"),
    ("d/go.sum", "github.com/a/b v1.2.3 h1:x\ngithub.com/a/b v1.2.3/go.mod h1:y\n"),
    ("e/Gemfile.lock", "GEM\n  specs:\n    rails (7.0.1)\n      rack (>= 2)\n    rack (2.2.3)\n"),
    ("f/pyproject.toml", '[project]\ndependencies = ["flask>=2.0", "click"]\n[tool.poetry.dependencies]\npython = "^3.9"\nattrs = "^22.1"\n'),
    ("g/package-lock.json", "{broken"), ("h/notes.txt", "numpy==1"),
    ("i/composer.lock", '{"packages": [{"name": "a/b", "version": "1.0"}]}'), ("j/yarn.lock", 'lodash@^4.0.0:\n  version "4.17.21"\n'),
]

QUERIES = {
    "s03_skip_dirs": lambda s, d: table(s, d, "pages").select("page_id", skipped(F.concat(F.when(F.col("page_id") % 3 == 0, "a/node_modules/").when(F.col("page_id") % 3 == 1, "a/outer/").otherwise("x/.git/"), "url")).alias("skipped")),
    "s04_file_hash": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash")),
    "s02_scan": lambda s, d: scan(table(s, d, "documents").select(F.format_string("%06d", "doc_id").alias("path"), F.octet_length("text").cast("long").alias("length")), 300, 400_000),
    "s12_append": lambda s, d: nodes(s, d).where("node_type = 'Class'").unionByName(nodes(s, d).where("node_type = 'Module'")).groupBy("node_type").agg(F.count("*").alias("n")),
    "s20_manifests": lambda s, d: dependencies(_requirements(s, d)),
    "s21_manifest_discovery": lambda s, d: table(s, d, "pages").select(F.concat("url", F.lit("/"), _AT("page_id", _NAMES)).alias("path")).where(F.element_at(F.split("path", "/"), -1).isin(list(MANIFESTS))).select("path"),
    "s22_projects": lambda s, d: discover_projects(_tree(s, d)),
    "a06_fingerprint": lambda s, d: portable_fingerprint(nodes(s, d)),
}
SQL = {
    "s03_skip_dirs": "SELECT page_id, page_id % 3 <> 1 AS skipped FROM pages",
    "s04_file_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "s02_scan": "SELECT path, length FROM (SELECT printf('%06d', doc_id) AS path, strlen(text) AS length, sum(strlen(text)) OVER (ORDER BY doc_id) AS t FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 300)) WHERE t <= 400000",
    "s12_append": sql("SELECT node_type, count(*) AS n FROM nodes WHERE node_type IN ('Class', 'Module') GROUP BY 1", NODES),
    "s20_manifests": "SELECT p_brand || '/requirements.txt' AS path, 'pkg-' || p_partkey AS name, p_size || '.0' AS version, 'python' AS ecosystem FROM part",
    "s21_manifest_discovery": f"SELECT url || '/' || f AS path FROM (SELECT url, {_NAMES}[page_id % {len(_NAMES)} + 1] AS f FROM pages) WHERE f IN ({', '.join(repr(m) for m in MANIFESTS)})",
    "s22_projects": "SELECT root, language, n FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, language) AS r FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) || '/' || (page_id % 3) AS root, ['python', 'rust', 'python', NULL, 'go', 'go', 'go'][page_id % 7 + 1] AS language, count(*) AS n FROM pages GROUP BY 1, 2) WHERE language IS NOT NULL) WHERE r = 1",
    "a06_fingerprint": sql("SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) AS total, bit_xor(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS mixed FROM (SELECT md5(concat_ws('|', node_id, node_type, name, complexity, language, project_id, file_path)) AS h FROM nodes)", NODES),
}
