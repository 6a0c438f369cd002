"""Text functions as column expressions; Python only where the algorithm is sequential."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from codelake.plans.views import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words left out of analysis queries.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after"
    " above below up down out off over under again further then once here there when where why how all each every both few more most other some such no nor not only own same so than too very just also now and"
    " or but if while about against between into this that these those it its i me my we us our you your he him his she her they them their what which who whom whose"
).split()
#: File extensions by language.
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "rs": "rust",
    "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "c", "c": "c", "cs": "csharp", "rb": "ruby", "php": "php", "lua": "lua", "scala": "scala", "sc": "scala", "sh": "bash", "bash": "bash", "json": "json",
}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def code_tokens(c: Column) -> Column:
    """Parts of identifiers: camel case, acronyms, digits; two bytes or more, or all digits; lower case."""
    parts = F.regexp_extract_all(c, F.lit("([0-9]+|\\p{Lu}+(?=\\p{Lu}\\p{Ll})|\\p{Lu}?\\p{Ll}+|\\p{Lu}+|\\p{Lo}+)"), F.lit(1))
    return F.transform(F.filter(parts, lambda t: (F.octet_length(t) >= 2) | t.rlike("^[0-9]+$")), F.lower)


def index_tokens(c: Column) -> Column:
    """Runs of letters and digits in ASCII lower case, two bytes or more."""
    return F.filter(F.split(ascii_lower(c), "[^\\p{L}\\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def stem(c: Column) -> Column:
    """Strips ing, ied, ed, ies, es and s by their rules; words of up to three letters stay."""
    n = F.char_length(c)
    cut = lambda k: F.left(c, n - k)
    vowel = "[aeiouAEIOU]"
    doubled = lambda b: b.rlike("([^aeiouAEIOU])\\1$")
    chop = lambda b: F.left(b, F.char_length(b) - 1)
    ing, ed = cut(3), cut(2)
    return (
        F.when(n <= 3, c)
        .when(c.endswith("ing"), F.when(doubled(ing), chop(ing)).when(ing.rlike(f"{vowel}[^aeiouAEIOU]$"), F.concat(ing, F.lit("e"))).otherwise(ing))
        .when(c.endswith("ied") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(c.endswith("ed"), F.when(doubled(ed), chop(ed)).otherwise(ed))
        .when(c.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(c.endswith("es") & (n > 4) & cut(2).rlike("(s|x|z|ch|sh)$"), cut(2))
        .when(c.endswith("s") & ~cut(1).endswith("s"), cut(1))
        .otherwise(c)
    )


def keywords(c: Column) -> Column:
    """The words that are not stop words and longer than a letter; the whole text if none is left."""
    bare = lambda w: F.regexp_replace(F.lower(w), "^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$", "")
    kept = F.filter(F.split(F.trim(F.regexp_replace(c, "\\s+", " ")), " "), lambda w: ~bare(w).isin(STOP_WORDS) & (F.octet_length(bare(w)) > 1))
    return F.when(F.size(kept) == 0, c).otherwise(F.array_join(kept, " "))


def normalize_symbol(c: Column) -> Column:
    """One kind of dot between the parts of a name, arguments cut off. The order of the replacements matters."""
    out = F.trim(F.substring_index(c, "(", 1))
    for old in ("?.", "::", "->", "\\", "/", ":"):
        out = F.replace(out, F.lit(old), F.lit("."))
    return F.regexp_replace(F.replace(out, F.lit(".."), F.lit(".")), "^\\.+|\\.+$", "")


#: Types too common to link by.
COMMON_TYPES = (
    "str string String &str int i32 i64 u32 u64 usize f32 f64 bool void None null undefined any Any object Object self Self cls this bytes Bytes Vec List list dict Dict HashMap Option Result Error Exception T U K V"
).split()
#: White space, by which texts are cut into words in any language.
SPACE = "[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}]+"


def normalize_type(c: Column) -> Column:
    """Without reference marks; of a generic type its first argument, unless that is a common type."""
    bare = F.trim(F.regexp_replace(F.trim(c), "^&*(mut )*", ""))
    inner = F.trim(F.substring_index(F.regexp_extract(bare, "<(.*)>", 1), ",", 1))
    return F.when((inner != "") & ~F.substring_index(inner, "<", 1).isin(COMMON_TYPES), inner).otherwise(bare)


def trigrams(c: Column) -> Column:
    n = F.char_length(c)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))))


def replace_word(c: Column, old: str, new: str) -> Column:
    return F.regexp_replace(c, f"(?<![\\p{{L}}\\p{{N}}_]){old}(?![\\p{{L}}\\p{{N}}_])", new)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.floor(F.octet_length(c) / 4), F.lit(10)).cast("long")


def truncate(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def language_of(path: Column) -> Column:
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[F.lower(F.regexp_extract(path, "\\.([^./?#]+)(?:[?#].*)?$", 1))]


def project_key(name: Column, path: Column, instance: Column) -> Column:
    return F.concat_ws("_", name, F.left(F.sha2(path, 256), F.lit(8)), instance.cast("string"))


#: Shapes of secrets in log lines.
SECRETS = ["(?i)(token|password|secret|api_key)(\\s*[=:]\\s*)[\"']?[A-Za-z0-9_\\-]{8,}[\"']?"]


def redact_log(c: Column) -> Column:
    for p in SECRETS:
        c = F.regexp_replace(c, p, "$1$2[REDACTED]")
    return c


#: Import statements by language.
IMPORTS = {
    "python": ["(?m)^\\s*from\\s+([\\w.]+)\\s+import", "(?m)^\\s*import\\s+([\\w.]+)"],
    "javascript": ["import\\s+(?:[^'\"]*\\s+from\\s+)?['\"]([^'\"]+)['\"]", "require\\s*\\(\\s*['\"]([^'\"]+)['\"]\\s*\\)"],
    "go": ["(?m)^\\s*(?:import\\s+)?(?:\\w+\\s+)?\"([^\"]+)\"\\s*$"], "rust": ["(?m)^\\s*(?:pub\\s+)?use\\s+([\\w:]+)"], "java": ["(?m)^\\s*import\\s+(?:static\\s+)?([\\w.]+)\\s*;"],
    "c": ["(?m)^\\s*#\\s*include\\s*[<\"]([^>\"]+)[>\"]"], "cpp": ["(?m)^\\s*#\\s*include\\s*[<\"]([^>\"]+)[>\"]"], "csharp": ["(?m)^\\s*using\\s+([\\w.]+)\\s*;"], "ruby": ["(?m)^\\s*require(?:_relative)?\\s+['\"]([^'\"]+)['\"]"],
    "php": ["(?m)^\\s*use\\s+([\\w\\\\]+)"], "lua": ["require\\s*\\(?\\s*['\"]([^'\"]+)['\"]"], "scala": ["(?m)^\\s*import\\s+([\\w.]+)"], "bash": ["(?m)^\\s*(?:source|\\.)\\s+(\\S+)"],
}


def imports_of(content: Column, language: Column) -> Column:
    """Distinct imported names, sorted, by the patterns of the language."""
    out = F.array().cast("array<string>")
    for lang, patterns in IMPORTS.items():
        found = F.flatten(F.array(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns]))
        out = F.when(language == lang, found).otherwise(out)
    return F.array_sort(F.array_distinct(out))


def links_of(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1)))


def naive_chunks(df: DataFrame, id_col: str, text_col: str, lines: int = 200) -> DataFrame:
    """Chunks of so many lines, from 0; an empty line at the end doesn't count."""
    parts = F.split(F.regexp_replace(F.col(text_col), "\n$", ""), "\n")
    start = F.explode(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(lines)))
    return df.select(F.col(id_col), parts.alias("_l"), start.alias("start_line")).select(id_col, F.col("start_line").cast("long"), F.least(F.size("_l"), F.col("start_line") + lines).cast("long").alias("end_line"), F.array_join(F.slice("_l", F.col("start_line") + 1, F.lit(lines)), "\n").alias("content"))


def token_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 512) -> DataFrame:
    words = F.filter(F.split(F.col(text_col), SPACE), lambda w: w != "")
    out = df.select(F.col(id_col), words.alias("_w")).where(F.size("_w") > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / size).cast("int"))))
    return out.select(id_col, F.col("_i").cast("long").alias("chunk"), F.array_join(F.slice("_w", F.col("_i") * size + 1, F.lit(size)), " ").alias("content"))


def sanitize_query(text: str) -> str:
    """NFC, trimmed; raises on NUL, control characters, over 500 bytes, or nothing left."""
    if len(text.encode()) > 500 or any(unicodedata.category(c) == "Cc" and c not in "\t\n\r" for c in text):
        raise ValueError("query is too long or has control characters")
    out = unicodedata.normalize("NFC", text).strip()
    if not out:
        raise ValueError("query is empty")
    return out


def unified_diff(before: Column | str, after: Column | str) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), lineterm="")) for x, y in zip(a, b)])

    return F.pandas_udf(run, "string")(before, after)


def apply_edits(text: Column | str, edits: Column) -> Column:
    """edits: arrays of (start, end, text) by character; applied from the last start on."""

    def one(t, es):
        for e in sorted(es, key=lambda e: -e["start"]):
            t = t[: e["start"]] + e["text"] + t[e["end"] :]
        return t

    def run(texts: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([one(t, e) for t, e in zip(texts, own)])

    return F.pandas_udf(run, "string")(text, edits)


def _docs(fn):
    return lambda s, d: fn(table(s, d, "documents"))


_W = lambda: F.explode(F.array_distinct(F.filter(F.split(ascii_lower(F.col("text")), "[^a-z]+"), lambda w: w != ""))).alias("word")
_TYPES = ["String", "User", "Vec", "char", "HashMap", "Widget", "T", "Job", "None", "Result"]
QUERIES = {
    "l01_code_tokens": lambda s, d: table(s, d, "orders").select("o_orderkey", F.array_join(code_tokens(F.concat(F.lit("getHTTPValue2_"), "o_orderpriority", F.lit("XMLParser"))), " ").alias("tokens")),
    "l02_index_tokens": _docs(lambda t: t.select("doc_id", F.size(index_tokens(F.col("text"))).cast("long").alias("n"), F.array_join(F.slice(index_tokens(F.col("text")), 1, 5), " ").alias("first"))),
    "l03_stem": _docs(lambda t: t.select(_W()).distinct().select("word", stem(F.col("word")).alias("stem"))),
    "l04_keywords": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", keywords(F.col("text")).alias("kept")),
    "l05_normalize_symbol": lambda s, d: table(s, d, "part").select("p_partkey", normalize_symbol(F.concat(F.lit("::crate::"), F.replace("p_name", F.lit(" "), F.lit("->")), F.lit("?.go(x, y)"))).alias("symbol")),
    "l06_normalize_type": lambda s, d: table(s, d, "part").select("p_partkey", normalize_type(F.when(F.col("p_size") > 30, F.concat(F.lit("&mut Vec<"), "p_brand", F.lit(", E>"))).when(F.col("p_size") > 20, F.lit("Option<String>")).otherwise(F.concat(F.lit(" &"), "p_brand"))).alias("type")),
    "l07_common_types": lambda s, d: table(s, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % len(_TYPES) + 1).cast("int")).isin(COMMON_TYPES).alias("common")),
    "l08_trigrams": lambda s, d: table(s, d, "supplier").select("s_suppkey", F.explode(trigrams(F.lower("s_name"))).alias("tri")),
    "l09_links": lambda s, d: table(s, d, "pages").select("page_id", F.explode(links_of(F.col("html"))).alias("link")),
    "l10_second_line": _docs(lambda t: t.select("doc_id", F.coalesce(F.get(F.filter(F.split("text", "\n"), lambda x: ~x.startswith("#")), 1), F.lit("")).alias("signature"))),
    "l11_replace_word": _docs(lambda t: t.select("doc_id", F.md5(replace_word(F.col("text"), "the", "THE").cast("binary")).alias("h"))),
    "l13_squeeze": _docs(lambda t: t.select("doc_id", F.md5(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")).cast("binary")).alias("h"))),
    "l14_apply_edits": _docs(lambda t: t.select("doc_id", F.md5(apply_edits("text", F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("[[").alias("text")), F.struct(F.lit(3).alias("start"), F.lit(3).alias("end"), F.lit("+").alias("text")))).cast("binary")).alias("h"))),
    "l15_diff": _docs(lambda t: t.select("doc_id", F.length(unified_diff("text", F.concat("text", F.lit("\nmore")))).cast("long").alias("n"))),
    "l16_enriched_content": lambda s, d: table(s, d, "part").select("p_partkey", F.concat_ws("\n", F.format_string("// type:%s complexity:%d", "p_type", "p_size"), "p_name").alias("content")),
    "l18_token_estimate": _docs(lambda t: t.select("doc_id", token_estimate(F.col("text")).alias("tokens"))),
    "l19_truncate": _docs(lambda t: t.select("doc_id", truncate(F.col("text"), 80).alias("short"))),
    "l20_symbol_id": lambda s, d: table(s, d, "part").select("p_partkey", F.sha2(F.concat_ws("::", F.lit("parts"), "p_name", "p_type"), 256).alias("symbol_id")),
    "l21_project_id": lambda s, d: table(s, d, "nation").select("n_nationkey", project_key(F.lower("n_name"), F.col("n_name"), F.col("n_regionkey")).alias("id")),
    "l22_redact_log": _docs(lambda t: t.select("doc_id", F.md5(redact_log(F.col("text")).cast("binary")).alias("h"))),
    "l23_naive_chunks": _docs(lambda t: naive_chunks(t, "doc_id", "text", 5).select("doc_id", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("h"))),
    "l24_token_chunks": _docs(lambda t: token_chunks(t, "doc_id", "text", 64).select("doc_id", "chunk", F.md5(F.col("content").cast("binary")).alias("h"))),
    "l25_clean_call": lambda s, d: table(s, d, "events").select("event_id", F.substring_index(F.concat("event_type", F.lit("("), "props"), "(", 1).alias("name")),
    "l26_alias_map": lambda s, d: table(s, d, "part").groupBy(F.element_at(F.split("p_name", " "), -1).alias("alias")).agg(F.min_by("p_name", "p_partkey").alias("target")),
    "l28_docs_summary": _docs(lambda t: t.agg(F.count("*").alias("files"), F.sum(F.size(F.filter(F.split("text", "\n"), lambda x: F.ltrim(x).startswith("#")))).cast("long").alias("headings"), F.sum(F.size(F.filter(F.split("text", "\n"), lambda x: F.upper(x).rlike("TODO|FIXME|ACTION")))).cast("long").alias("todos"))),
    "l30_json_metadata": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "l32_math": lambda s, d: table(s, d, "part").select("p_partkey", F.round(F.ln(F.col("p_size") + 1), 6).alias("ln"), F.round(F.sqrt("p_size"), 6).alias("sqrt"), F.greatest(F.lit(0), F.least(F.lit(30), F.col("p_size"))).alias("clamped"), F.floor(F.col("p_retailprice")).alias("whole")),
    "l33_map_default": lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", "n", F.coalesce(F.create_map(F.lit("en"), F.lit(1), F.lit("de"), F.lit(2))[F.col("lang")], F.lit(0)).alias("code")),
    "s07_language_of": lambda s, d: table(s, d, "pages").select("page_id", F.coalesce(language_of(F.concat("url", F.element_at(F.array(*[F.lit(x) for x in (".py", ".RS", ".zz", ".tsx")]), (F.col("page_id") % 4 + 1).cast("int")))), F.lit("none")).alias("language")),
}
_CODEW = "SELECT DISTINCT unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+')) AS word FROM documents"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_KEPT = rf"list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g') NOT IN ({_STOP}) AND strlen(regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')) > 1)"
_STEM = r"""SELECT word, CASE WHEN length(word) <= 3 THEN word
WHEN ends_with(word, 'ing') THEN CASE WHEN length(word) >= 5 AND substr(word, length(word) - 3, 1) = substr(word, length(word) - 4, 1) AND NOT regexp_matches(substr(word, length(word) - 3, 1), '[aeiouAEIOU]') THEN substr(word, 1, length(word) - 4) WHEN regexp_matches(substr(word, 1, length(word) - 3), '[aeiouAEIOU][^aeiouAEIOU]$') THEN substr(word, 1, length(word) - 3) || 'e' ELSE substr(word, 1, length(word) - 3) END
WHEN ends_with(word, 'ied') AND length(word) > 4 THEN substr(word, 1, length(word) - 3) || 'y'
WHEN ends_with(word, 'ed') THEN CASE WHEN length(word) >= 4 AND substr(word, length(word) - 2, 1) = substr(word, length(word) - 3, 1) AND NOT regexp_matches(substr(word, length(word) - 2, 1), '[aeiouAEIOU]') THEN substr(word, 1, length(word) - 3) ELSE substr(word, 1, length(word) - 2) END
WHEN ends_with(word, 'ies') AND length(word) > 4 THEN substr(word, 1, length(word) - 3) || 'y'
WHEN ends_with(word, 'es') AND length(word) > 4 AND regexp_matches(substr(word, 1, length(word) - 2), '(s|x|z|ch|sh)$') THEN substr(word, 1, length(word) - 2)
WHEN ends_with(word, 's') AND NOT ends_with(word, 'ss') THEN substr(word, 1, length(word) - 1) ELSE word END AS stem"""
_LAST = "least(3, len(l))"  # lines of context before what is added at the end
SQL = {
    "l01_code_tokens": r"SELECT o_orderkey, array_to_string(list_transform(list_filter(regexp_extract_all(regexp_replace('getHTTPValue2_' || o_orderpriority || 'XMLParser', '(\p{Lu}+)(\p{Lu}\p{Ll})', '\1 \2', 'g'), '[0-9]+|\p{Lu}?\p{Ll}+|\p{Lu}+|\p{Lo}+'), lambda t: strlen(t) >= 2 OR regexp_matches(t, '^[0-9]+$')), lambda t: lower(t)), ' ') AS tokens FROM orders",
    "l11_replace_word": r"SELECT doc_id, md5(replace(regexp_replace(regexp_replace(replace(text, chr(1), ''), '([^\p{L}\p{N}_])', chr(1) || '\1' || chr(1), 'g'), '(^|' || chr(1) || ')the(' || chr(1) || '|$)', '\1THE\2', 'g'), chr(1), '')) AS h FROM documents",
    "l15_diff": f"SELECT doc_id, CAST(10 + length('@@ -' || (len(l) - {_LAST} + 1) || CASE WHEN {_LAST} = 1 THEN '' ELSE ',' || {_LAST} END || ' +' || (len(l) - {_LAST} + 1) || ',' || ({_LAST} + 1) || ' @@') + list_sum(list_transform(list_slice(l, len(l) - {_LAST} + 1, len(l)), lambda x: length(x) + 2)) + 6 AS BIGINT) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "l02_index_tokens": r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, array_to_string(list_slice(t, 1, 5), ' ') AS first FROM (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2) AS t FROM documents)",
    "l03_stem": f"{_STEM} FROM ({_CODEW}) WHERE word <> ''",
    "l04_keywords": f"SELECT conv_id, turn, CASE WHEN len(k) = 0 THEN text ELSE array_to_string(k, ' ') END AS kept FROM (SELECT *, {_KEPT} AS k FROM conversations)",
    "l05_normalize_symbol": "SELECT p_partkey, 'crate.' || replace(p_name, ' ', '.') || '.go' AS symbol FROM part",
    "l06_normalize_type": "SELECT p_partkey, CASE WHEN p_size > 30 THEN p_brand WHEN p_size > 20 THEN 'Option<String>' ELSE p_brand END AS type FROM part",
    "l07_common_types": f"SELECT p_partkey, {_TYPES}[p_partkey % {len(_TYPES)} + 1] IN ({', '.join(repr(t) for t in COMMON_TYPES)}) AS common FROM part",
    "l08_trigrams": "SELECT DISTINCT s_suppkey, substr(lower(s_name), i, 3) AS tri FROM (SELECT s_suppkey, s_name, unnest(range(1, length(s_name) - 1)) AS i FROM supplier)",
    "l09_links": """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""",
    "l10_second_line": "SELECT doc_id, coalesce(list_extract(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '#')), 2), '') AS signature FROM documents",
    "l13_squeeze": r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS h FROM documents",
    "l14_apply_edits": "SELECT doc_id, md5('[[' || substr(text, 3, 1) || '+' || substr(text, 4)) AS h FROM documents",
    "l16_enriched_content": "SELECT p_partkey, '// type:' || p_type || ' complexity:' || p_size || chr(10) || p_name AS content FROM part",
    "l18_token_estimate": "SELECT doc_id, CAST(greatest(strlen(text) // 4, 10) AS BIGINT) AS tokens FROM documents",
    "l19_truncate": "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS short FROM documents",
    "l20_symbol_id": "SELECT p_partkey, sha256('parts::' || p_name || '::' || p_type) AS symbol_id FROM part",
    "l21_project_id": "SELECT n_nationkey, lower(n_name) || '_' || substr(sha256(n_name), 1, 8) || '_' || n_regionkey AS id FROM nation",
    "l22_redact_log": r"""SELECT doc_id, md5(regexp_replace(text, '(?i)(token|password|secret|api_key)(\s*[=:]\s*)["'']?[A-Za-z0-9_\-]{8,}["'']?', '\1\2[REDACTED]', 'g')) AS h FROM documents""",
    "l23_naive_chunks": "SELECT doc_id, CAST(i AS BIGINT) AS start_line, CAST(least(len(l), i + 5) AS BIGINT) AS end_line, md5(array_to_string(list_slice(l, i + 1, i + 5), chr(10))) AS h FROM (SELECT doc_id, l, unnest(range(0, len(l), 5)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents))",
    "l24_token_chunks": r"SELECT doc_id, CAST(i AS BIGINT) AS chunk, md5(array_to_string(list_slice(w, i * 64 + 1, i * 64 + 64), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 64 + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r \x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)",
    "l25_clean_call": "SELECT event_id, event_type AS name FROM events",
    "l26_alias_map": "SELECT list_extract(string_split(p_name, ' '), -1) AS alias, arg_min(p_name, p_partkey) AS target FROM part GROUP BY 1",
    "l28_docs_summary": "SELECT count(*) AS files, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), '#')))) AS BIGINT) AS headings, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(upper(x), 'TODO|FIXME|ACTION')))) AS BIGINT) AS todos FROM documents",
    "l30_json_metadata": r"SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events",
    "l32_math": "SELECT p_partkey, round(ln(p_size + 1), 6) AS ln, round(sqrt(p_size), 6) AS sqrt, greatest(0, least(30, p_size)) AS clamped, CAST(floor(p_retailprice) AS BIGINT) AS whole FROM part",
    "l33_map_default": "SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 0 END AS code FROM documents GROUP BY 1",
    "s07_language_of": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'none' ELSE 'typescript' END AS language FROM pages",
}
