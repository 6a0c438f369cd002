"""Hybrid retrieval: query understanding, TF-IDF, text and structural scores, fusion, resolution cascades."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codelake.functions.text import SPACE, ascii_lower, index_tokens, naive_chunks
from codelake.operators.ranking import stratified
from codelake.operators.vectors import _D, nearest
from codelake.plans.session import ensure_checkpoints
from codelake.plans.views import NODES, nodes, sql, table

#: Query patterns by intent, in the order they are tried, and stop words of query terms.
INTENTS = [
    ("how_works", r"(?i)^(?:show|tell|explain|describe)\s+(?:me\s+)?how\s+(?:does\s+)?\S.{0,400}?(?:\s+(?:work|works|working|function|functions|operate|operates))?\s*\.?\s*$"),
    ("where_handled", r"(?i)^where\s+(?:is|are|do\s+we\s+handle|does\s+.\s+handle)\s+\S.{0,400}?(?:\s+handled)?\s*\.?\s*$"),
    ("bottlenecks", r"(?i)^(?:what|where|find)\s+(?:are\s+)?(?:the\s+)?(?:bottlenecks|performance\s+issues|slow\s+code|optimization\s+opportunities)\s*\.?\s*$"),
    ("bottlenecks", r"(?i)^(?:most|least)\s+(?:complex|complicated|difficult|simple)(?:\s+\S.{0,100})?\s*\.?\s*$"),
]
QUESTION = ("how", "what", "why", "where", "when", "which")
TERM_STOPS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must shall can need show me tell explain describe how what where when why"
    " which that this these those"
).split()
#: Weights of tfidf, neural, structural and text scores by kind of query and whether neural vectors are there.
WEIGHTS = {
    ("text", True): (0.2, 0.05, 0.05, 0.7), ("text", False): (0.2, 0.05, 0.05, 0.7), ("exact", True): (0.15, 0.15, 0.25, 0.45), ("exact", False): (0.15, 0.0, 0.30, 0.55), ("semantic", True): (0.3, 0.3, 0.1, 0.3),
    ("semantic", False): (0.55, 0.0, 0.15, 0.30), ("structural", True): (0.3, 0.0, 0.5, 0.2), ("structural", False): (0.3, 0.0, 0.5, 0.2),
}
PRESETS = {"code": (0.30, 0.40, 0.15, 0.15), "code_without_neural": (0.60, 0.0, 0.20, 0.20), "prose": (0.25, 0.55, 0.10, 0.10)}
THRESHOLDS = {"semantic": 0.05}


def intent(q: Column) -> Column:
    out = None
    for name, pattern in INTENTS:
        hit = q.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    asks = F.lower(q).rlike("|".join(QUESTION))
    return out.when(asks, "semantic").otherwise("text")


def query_type(i: Column) -> Column:
    return F.when(i.isin("how_works", "semantic"), "semantic").when(i.isin("where_handled", "bottlenecks"), "structural").otherwise("text")


def route(q: Column) -> Column:
    return F.when(q.rlike("^[A-Za-z0-9_:.]+$"), "exact_symbol").otherwise("semantic")


def terms(q: Column) -> Column:
    """Distinct lower-case words of three bytes or more, marks at their ends cut off, no stop words; sorted."""
    words = F.transform(F.split(F.lower(q), "\\s+"), lambda w: F.regexp_replace(w, "[^\\p{L}\\p{N}]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(TERM_STOPS))))


def text_score(query: str, symbol: Column, path: Column, tokens: Column, query_tokens: list[str]) -> Column:
    """Share of the query's tokens there, more for names that equal or hold the query, less in tests; from 0 to 1."""
    s, q = ascii_lower(symbol), query.lower()
    qualified = s.contains("::") | s.contains(".")
    boost = F.when(s == q, 1.0).when(s.contains(q), F.when(qualified, 0.3).otherwise(0.7)).when(F.lit(q).contains(s) & (s != ""), 0.4).otherwise(0.0)
    penalty = F.when(ascii_lower(path).contains("test") | s.contains("test"), 0.3).otherwise(0.0)
    wanted = F.array(*[F.lit(t) for t in sorted(set(query_tokens))])
    share = F.size(F.array_intersect(wanted, tokens)) / len(set(query_tokens)) if query_tokens else F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share + boost - penalty))


def structural_score(complexity: Column) -> Column:
    return F.least(complexity / 100, F.lit(1.0))


def fuse(scores: tuple[Column, Column, Column, Column], weights: tuple[float, ...]) -> Column:
    total = sum((s * w for s, w in zip(scores, weights)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def adjust(score: Column, name: Column, path: Column, query: str, exact_mode: bool = False) -> Column:
    """Qualified names x 0.7, exact x 1.8 or 2.2 and partial x 1.3 or 1.5 up to 1, archives x 0.1; after the clamp."""
    s, q = ascii_lower(name), query.lower()
    qualified = F.when(s.contains("::") | s.contains("."), 0.7).otherwise(1.0)
    boost = F.when(s == q, 2.2 if exact_mode else 1.8).when(s.contains(q), 1.5 if exact_mode else 1.3).otherwise(1.0)
    archived = F.when(path.rlike("(^|[/\\\\])\\.?archive([/\\\\]|$)"), 0.1).otherwise(1.0)
    return F.least(F.lit(1.0), score * qualified * boost) * archived  # the score once, so that code stays small


def tfidf_vocabulary(tokens: DataFrame, n: int, size: int = 768) -> DataFrame:
    """tokens: (doc, token, k), k its count. (token, idf) of moderate frequency, `size` of them spread evenly over the idf range."""
    ensure_checkpoints(tokens.sparkSession)
    least, most = (1, n) if n < 50 else (max(n // 1000, 3), max(n // 4, max(n // 1000, 3) + 1))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df").between(least, most)).checkpoint()
    return stratified(df.select("token", F.ln(F.lit(float(n)) / F.col("df")).alias("idf")), ["idf", "token"], size).select("token", "idf")


def tfidf_weights(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc, token, weight): (count / all tokens) x idf, to length one."""
    sums = tokens.groupBy("doc").agg(F.sum("k").alias("total"))
    raw = tokens.join(vocabulary, "token").join(sums, "doc").select("doc", "token", (F.col("k") / F.col("total") * F.col("idf")).alias("w"))
    norms = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 1e-9")
    return raw.join(norms, "doc").select("doc", "token", (F.col("w") / F.col("norm")).alias("weight"))


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.explode(index_tokens(F.col(text_col))).alias("token")).groupBy("doc", "token").agg(F.count("*").alias("k"))


@dataclass(frozen=True)
class Query:
    text: str
    kind: str = "text"
    top_k: int = 10
    neural: bool = False
    threshold: float | None = None

    @property
    def limit(self) -> float:
        return THRESHOLDS.get(self.kind, 0.1) if self.threshold is None else self.threshold


def search(symbols: DataFrame, tfidf: DataFrame | None, query: Query, near: DataFrame | None = None) -> DataFrame:
    """symbols: node_id, name, path, complexity, tokens; tfidf: (node_id, tfidf); near: (node_id, neural) of the nearest vectors. Scores, drops what doesn't reach the limit, ranks the top k."""
    wanted = query_tokens(query.text)
    text = text_score(query.text, F.col("name"), F.col("path"), F.col("tokens"), wanted)
    scored = symbols.withColumn("text", text).withColumn("structural", structural_score(F.col("complexity")))
    scored = scored.join(tfidf, "node_id", "left").fillna(0.0, ["tfidf"]) if tfidf is not None else scored.withColumn("tfidf", F.lit(0.0))
    scored = scored.join(near, "node_id", "left").fillna(0.0, ["neural"]) if near is not None else scored.withColumn("neural", F.lit(0.0))
    scored = scored.withColumn("neural", F.greatest("neural", F.lit(0.0)))
    if query.kind != "semantic":
        scored = scored.where((F.col("text") > 0) | (F.col("tfidf") > 0) | (F.col("neural") > 0))
    overall = fuse((F.col("tfidf"), F.col("neural"), F.col("structural"), F.col("text")), WEIGHTS[query.kind, query.neural or near is not None])
    scored = scored.withColumn("score", F.round(adjust(overall, F.col("name"), F.col("path"), query.text, query.kind == "exact"), 6)).where((F.col("score") > 0) & (F.col("score") >= query.limit))
    top = scored.orderBy(F.desc("score"), "node_id").limit(query.top_k)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "node_id"))).select("rank", "node_id", "name", "score")


def query_tokens(text: str) -> list[str]:
    return sorted({t for t in "".join(c if c.isalnum() else " " for c in text.lower()).split() if len(t.encode()) >= 2})


def candidates(postings: DataFrame, near: DataFrame, fragments: DataFrame, wanted: list[str]) -> DataFrame:
    """(doc, by_postings, by_vector, by_fragment): what a query's tokens, its nearest vectors and its fragments bring.

    postings: (doc, token); near: (doc, neural); fragments: (doc, tokens), of which all wanted tokens must be in one."""
    hit = lambda df, name: df.select("doc").distinct().withColumn("_by", F.lit(name))
    whole = F.size(F.array_intersect(F.array(*map(F.lit, wanted)), "tokens")) == len(wanted)
    found = hit(postings.where(F.col("token").isin(wanted)), "p").union(hit(near, "v")).union(hit(fragments.where(whole), "f"))
    has = lambda name: F.max(F.when(F.col("_by") == name, True).otherwise(False))
    return found.groupBy("doc").agg(has("p").alias("by_postings"), has("v").alias("by_vector"), has("f").alias("by_fragment"))


def tfidf_scores(weights: DataFrame, vocabulary: DataFrame, wanted: list[str]) -> DataFrame:
    """(doc, tfidf): cosine of the query's and the documents' weights; only postings of the query's tokens are read."""
    q = vocabulary.where(F.col("token").isin(wanted))  # a row a token of the query at most
    q = q.select("token", (F.col("idf") / F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(W.partitionBy(F.lit(0))))).alias("q"))
    return weights.where(F.col("token").isin(wanted)).join(F.broadcast(q), "token").groupBy("doc").agg(F.sum(F.col("weight") * F.col("q")).alias("tfidf"))


def hybrid_search(docs: DataFrame, found: DataFrame, tfidf: DataFrame, near: DataFrame, query: Query) -> DataFrame:
    """The `top_k` best of the candidates by four scores. docs: doc, name, path, complexity, tokens; found: (doc, ...); near: (doc, neural).

    A candidate of a search that is not semantic needs a text, tf-idf or vector score; then the scores are fused, adjusted, held against the limit and ranked."""
    wanted = query_tokens(query.text)
    own = docs.join(found.select("doc"), "doc", "left_semi").join(tfidf, "doc", "left").join(near, "doc", "left").fillna(0.0, ["tfidf", "neural"])
    own = own.withColumn("text", text_score(query.text, F.col("name"), F.col("path"), F.col("tokens"), wanted)).withColumn("neural", F.greatest(F.col("neural"), F.lit(0.0)))
    if query.kind != "semantic":
        own = own.where((F.col("text") > 0) | (F.col("tfidf") > 0) | (F.col("neural") > 0))
    overall = fuse((F.col("tfidf"), F.col("neural"), structural_score(F.col("complexity")), F.col("text")), WEIGHTS[query.kind, query.neural])
    scored = own.withColumn("score", F.round(adjust(overall, F.col("name"), F.col("path"), query.text, query.kind == "exact"), 6)).where((F.col("score") > 0) & (F.col("score") >= query.limit))
    top = scored.orderBy(F.desc("score"), "doc").limit(query.top_k)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "doc"))).select("rank", "doc", "score")


def staged_search(docs: DataFrame, postings: DataFrame, vectors: DataFrame, vector: DataFrame, wanted: list[str], fetch: int, k: int) -> DataFrame:
    """The documents that share most of the query's tokens (`fetch` of them), ranked by their vectors."""
    first = postings.where(F.col("token").isin(wanted)).groupBy("doc").agg(F.countDistinct("token").alias("shared")).orderBy(F.desc("shared"), "doc").limit(fetch)
    own = docs.select("doc").join(first, "doc").join(vectors.withColumnRenamed("vec_id", "doc"), "doc").select(F.col("doc").alias("vec_id"), "embedding")
    return nearest(own, vector, k).select("rank", F.col("vec_id").alias("doc"), "score")


def semantic_search(vectors: DataFrame, vector: DataFrame, k: int, limit: float = THRESHOLDS["semantic"]) -> DataFrame:
    """The `k` nearest vectors alone, as far as they reach the limit."""
    return nearest(vectors, vector, k).where(F.col("score") >= limit).select("rank", F.col("vec_id").alias("doc"), "score")


def cascade(df: DataFrame, tiers: list[Column], *ties) -> DataFrame:
    """The row of the first tier that has any."""
    tier = None
    for i, t in enumerate(tiers):
        tier = F.when(t, i) if tier is None else tier.when(t, i)
    return df.withColumn("tier", tier).where(F.col("tier").isNotNull()).orderBy("tier", *ties).limit(1)


def incremental(index: DataFrame, removed: DataFrame, added: DataFrame, key: str) -> DataFrame:
    return index.join(removed.select(key).union(added.select(key)).distinct(), key, "left_anti").unionByName(added)


def coherence(index: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """Counts of what should be zero: postings without a row, rows without a posting, ids that repeat, rows without an id, postings that repeat."""
    dead = postings.join(index.select(key), key, "left_anti").agg(F.count("*").alias("dead_postings"))
    bare = index.join(postings.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("rows_without_postings"))
    twice = index.groupBy(key).count().where("count > 1").agg(F.count("*").alias("repeated"))
    null = index.where(F.col(key).isNull()).agg(F.count("*").alias("without_id"))
    pairs = postings.groupBy(*postings.columns).count().where("count > 1").agg(F.count("*").alias("repeated_postings"))
    return dead.join(bare, F.lit(True)).join(twice, F.lit(True)).join(null, F.lit(True)).join(pairs, F.lit(True))  # five single rows


def _parts(s, d) -> DataFrame:
    t = table(s, d, "part")
    return t.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_name").alias("name"), F.concat(F.when(F.col("p_partkey") % 9 == 0, F.lit("archive/")).otherwise(F.lit("src/")), F.col("p_brand")).alias("path"), F.col("p_size").alias("complexity"), F.split(F.lower("p_name"), " ").alias("tokens"))


PARTS = "parts AS (SELECT 'p' || p_partkey AS node_id, p_name AS name, CASE WHEN p_partkey % 9 = 0 THEN 'archive/' ELSE 'src/' END || p_brand AS path, p_size AS complexity, string_split(lower(p_name), ' ') AS tokens FROM part)"


def _conv(s, d):
    """Conversation turns as queries, some made questions."""
    q = F.col("text")
    lead = F.element_at(F.array(*[F.lit(x) for x in ("", "show me how ", "where is ", "most complex ", "what ")]), (F.col("conv_id") % 5 + 1).cast("int"))
    return table(s, d, "conversations").select("conv_id", "turn", F.concat(lead, F.regexp_replace(q, SPACE, " ")).alias("q"))


CONV = r"q AS (SELECT conv_id, turn, ['', 'show me how ', 'where is ', 'most complex ', 'what '][conv_id % 5 + 1] || regexp_replace(text, '[\t\n\x0B\f\r \x{85}\p{Z}]+', ' ', 'g') AS q FROM conversations)"


def _counts(s, d):
    ensure_checkpoints(s)
    return token_counts(table(s, d, "documents"), "doc_id", "text").checkpoint()  # read by each step of the fit


def _vocab(s, d, counts=None):
    return tfidf_vocabulary(counts or _counts(s, d), table(s, d, "documents").count())


def _weights(s, d):
    counts = _counts(s, d)
    return tfidf_weights(counts, _vocab(s, d, counts))


_ASK = Query("tionth and theer", "text", 20, True, 0.05)


def _found(s, d):
    """What a search over documents takes: documents, their postings, fragments of five lines, weights, the nearest 100 vectors."""
    t = table(s, d, "documents")
    docs = t.select(F.col("doc_id").alias("doc"), F.substring_index("text", " ", 1).alias("name"), F.col("source").alias("path"), (F.col("n_chars") % 100).alias("complexity"), index_tokens(F.col("text")).alias("tokens"))
    counts = _counts(s, d)
    fragments = naive_chunks(t, "doc_id", "text", 5).select(F.col("doc_id").alias("doc"), index_tokens(F.col("content")).alias("tokens"))
    vectors = table(s, d, "embeddings").select("vec_id", "embedding")
    near = nearest(vectors, vectors.where("vec_id = 5"), 100).select(F.col("vec_id").alias("doc"), F.col("score").alias("neural"))
    return docs, counts, fragments, vectors, near


def _hybrid(s, d):
    docs, counts, fragments, _, near = _found(s, d)
    vocabulary, wanted = _vocab(s, d, counts), query_tokens(_ASK.text)
    return hybrid_search(docs, candidates(counts, near, fragments, wanted), tfidf_scores(tfidf_weights(counts, vocabulary), vocabulary, wanted), near, _ASK)


def _candidates(s, d):
    _, counts, fragments, _, near = _found(s, d)
    return candidates(counts, near, fragments, query_tokens(_ASK.text))


def _staged(s, d):
    docs, counts, _, vectors, _ = _found(s, d)
    return staged_search(docs, counts, vectors, vectors.where("vec_id = 5"), query_tokens(_ASK.text), 200, 10)


def _semantic(s, d):
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    return semantic_search(v, v.where("vec_id = 11"), 15)


def _broken(s, d):
    """An index with rows that repeat or lack an id, and postings without a row or twice."""
    p = _parts(s, d)
    rows = p.where("complexity > 5").select(F.when(F.col("complexity") != 30, F.col("node_id")).alias("node_id")).unionByName(p.where("complexity > 45").select("node_id"))
    return rows, p.where("complexity > 7 or complexity < 3").unionByName(p.where("complexity = 8")).select("node_id", F.explode("tokens").alias("t"))


def _cascades(s, d):
    """Three names asked for: an id, a name, a part of a name."""
    out = None
    for asked in ("c12", "Customer#000000012", "#00000012"):
        one = cascade(nodes(s, d), [F.col("node_id") == asked, F.col("name") == asked, F.col("name").contains(asked)], F.when(F.col("node_type") == "Module", 1).otherwise(0), "node_id").select(F.lit(asked).alias("asked"), "node_id", "tier")
        out = one if out is None else out.union(one)
    return out


_TS = lambda: text_score("a", F.col("name"), F.col("path"), F.col("tokens"), ["red", "bolt"])
QUERIES = {
    "r03_intent": lambda s, d: _conv(s, d).select("conv_id", "turn", intent(F.col("q")).alias("intent")),
    "r04_terms": lambda s, d: _conv(s, d).select("conv_id", "turn", F.array_join(terms(F.col("q")), " ").alias("terms")),
    "r05_query_type": lambda s, d: _conv(s, d).select("conv_id", "turn", query_type(intent(F.col("q"))).alias("kind")),
    "r06_route": lambda s, d: _parts(s, d).select("node_id", route(F.when(F.col("complexity") > 25, F.replace("name", F.lit(" "), F.lit("::"))).otherwise(F.col("name"))).alias("route")),
    "r07_search": _hybrid,
    "r08_text_score": lambda s, d: _parts(s, d).select("node_id", F.round(_TS(), 6).alias("score")),
    "r09_structural": lambda s, d: _parts(s, d).select("node_id", structural_score(F.col("complexity") * 4).alias("score")),
    "r11_weights": lambda s, d: _parts(s, d).select("node_id", F.round(fuse((F.lit(0.5), F.lit(0.2), structural_score(F.col("complexity")), F.lit(0.1)), WEIGHTS["exact", True]), 6).alias("score")),
    "r12_composite": lambda s, d: _parts(s, d).select("node_id", F.round(fuse((_TS(), F.lit(0.9), structural_score(F.col("complexity")), _TS()), PRESETS["prose"]), 6).alias("score")),
    "r13_renormalise": lambda s, d: _parts(s, d).select("node_id", F.round((_TS() * 0.3 + structural_score(F.col("complexity")) * 0.15) / (0.3 + 0.15 + 0.1), 6).alias("score")),
    "r14_adjust": lambda s, d: _parts(s, d).select("node_id", F.round(adjust(structural_score(F.col("complexity")), F.col("name"), F.col("path"), "hot"), 6).alias("score")),
    "r15_drop": lambda s, d: _parts(s, d).withColumn("text", _TS()).where("text > 0 or complexity > 45").select("node_id"),
    "r16_rerank": lambda s, d: _parts(s, d).select("node_id", F.round(F.least(F.lit(1.0), structural_score(F.col("complexity")) * 1.2), 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(30),
    "r18_staged": _staged,
    "r19_semantic_only": _semantic,
    "u01_candidates": _candidates,
    "r23_incremental": lambda s, d: incremental(_parts(s, d).select("node_id", "complexity"), _parts(s, d).where("complexity = 7").select("node_id"), _parts(s, d).where("complexity = 9").select("node_id", (F.col("complexity") + 100).alias("complexity")), "node_id").groupBy("complexity").agg(F.count("*").alias("n")),
    "r24_coherence": lambda s, d: coherence(_broken(s, d)[0], _broken(s, d)[1], "node_id"),
    "r25_fuzzy_node": lambda s, d: _parts(s, d).withColumn("score", F.when(F.col("name").contains("bolt"), 100).otherwise(0) + F.when(F.col("node_id").contains("7"), 50).otherwise(0) + F.least(F.col("complexity"), F.lit(50))).orderBy(F.desc("score"), "node_id").limit(1).select("node_id", "score"),
    "r26_cascade": lambda s, d: _cascades(s, d),
    "r27_name_in_file": lambda s, d: cascade(nodes(s, d), [(F.col("name") == "NATION_3") & (F.col("file_path") == "r9"), F.col("name") == "NATION_3", F.lower("name") == "nation_3"], "node_id").select("node_id", "tier"),
    "v13_tfidf_fit": lambda s, d: _vocab(s, d).select("token", F.round("idf", 6).alias("idf")),
    "v14_tfidf_transform": lambda s, d: _weights(s, d).groupBy("doc").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("top")),
}
_TSQL = "greatest(0, least(1, (CASE WHEN list_contains(tokens, 'red') THEN 1 ELSE 0 END + CASE WHEN list_contains(tokens, 'bolt') THEN 1 ELSE 0 END) / 2 + CASE WHEN lower(name) = 'a' THEN 1.0 WHEN contains(lower(name), 'a') THEN CASE WHEN contains(name, '.') OR contains(name, '::') THEN 0.3 ELSE 0.7 END ELSE 0 END - CASE WHEN contains(lower(path), 'test') OR contains(lower(name), 'test') THEN 0.3 ELSE 0 END))"
_STOPS = ", ".join(f"'{t}'" for t in TERM_STOPS)
_TERMS = rf"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(q), '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]+$', '')), lambda w: strlen(w) >= 3 AND w NOT IN ({_STOPS}))))"
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{n}'" for n, p in INTENTS) + " WHEN regexp_matches(lower(q), 'how|what|why|where|when|which') THEN 'semantic' ELSE 'text' END"
_TFIDF = r"""k AS (SELECT doc_id AS doc, token, count(*) AS k FROM (SELECT doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+')) AS token FROM documents) WHERE strlen(token) >= 2 GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents), df AS (SELECT token, count(*) AS df FROM k GROUP BY 1), f AS (SELECT token, df, ln(CAST(n AS DOUBLE) / df) AS idf FROM df, n WHERE df BETWEEN greatest(n // 1000, 3) AND greatest(n // 4, greatest(n // 1000, 3) + 1)),
p AS (SELECT *, row_number() OVER (ORDER BY idf, token) - 1 AS place FROM f), v AS (SELECT token, idf FROM p WHERE place IN (SELECT least(CAST(floor(i * ((SELECT count(*) FROM f) / CAST(least(768, (SELECT count(*) FROM f)) AS DOUBLE))) AS BIGINT), (SELECT count(*) FROM f) - 1) FROM range(768) t(i) WHERE i < (SELECT count(*) FROM f)))"""
_QT = query_tokens(_ASK.text)
_IN = "(" + ", ".join(f"'{t}'" for t in _QT) + ")"
_SIM = f"round({_D('q.embedding', 'v.embedding')} / (sqrt({_D('q.embedding', 'q.embedding')}) * sqrt({_D('v.embedding', 'v.embedding')})), 6)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOUND = rf"""near AS (SELECT v.vec_id AS doc, {_SIM} AS neural FROM embeddings v JOIN embeddings q ON q.vec_id = 5 ORDER BY neural DESC, doc LIMIT 100),
fragments AS (SELECT doc_id AS doc, regexp_split_to_array({_LOW.format("array_to_string(list_slice(l, i + 1, i + 5), chr(10))")}, '[^\p{{L}}\p{{N}}]+') AS tokens FROM (SELECT doc_id, l, unnest(range(0, len(l), 5)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents))),
found AS (SELECT DISTINCT doc, 'p' AS b FROM k WHERE token IN {_IN} UNION SELECT doc, 'v' FROM near UNION SELECT doc, 'f' FROM fragments WHERE {' AND '.join(f"list_contains(tokens, '{t}')" for t in _QT)})"""
_SCORED = f"""w AS (SELECT k.doc, k.token, k.k / t.total * v.idf AS w FROM k JOIN v USING (token) JOIN (SELECT doc, sum(k) AS total FROM k GROUP BY 1) t USING (doc)), m AS (SELECT doc, sqrt(sum(w * w)) AS m FROM w GROUP BY 1),
qw AS (SELECT token, idf / sqrt(sum(idf * idf) OVER ()) AS q FROM v WHERE token IN {_IN}), tf AS (SELECT w.doc, sum(w.w / m.m * qw.q) AS tfidf FROM w JOIN m ON m.doc = w.doc JOIN qw ON qw.token = w.token WHERE m.m > 1e-9 GROUP BY 1),
own AS (SELECT doc_id AS doc, string_split(text, ' ')[1] AS name, source AS path, n_chars % 100 AS complexity, '{_ASK.text}' AS qt, (SELECT count(DISTINCT token) FROM k WHERE k.doc = doc_id AND token IN {_IN}) / {len(_QT)} AS shared FROM documents WHERE doc_id IN (SELECT doc FROM found)),
s AS (SELECT own.*, coalesce(tfidf, 0) AS tfidf, greatest(coalesce(neural, 0), 0) AS neural, greatest(0, least(1, shared + CASE WHEN {_LOW.format("name")} = qt THEN 1 WHEN contains({_LOW.format("name")}, qt) THEN CASE WHEN contains(name, '::') OR contains(name, '.') THEN 0.3 ELSE 0.7 END WHEN name <> '' AND contains(qt, {_LOW.format("name")}) THEN 0.4 ELSE 0 END
  - CASE WHEN contains({_LOW.format("path")}, 'test') OR contains({_LOW.format("name")}, 'test') THEN 0.3 ELSE 0 END)) AS text FROM own LEFT JOIN tf ON tf.doc = own.doc LEFT JOIN near ON near.doc = own.doc)"""
SQL = {
    "r03_intent": sql(f"SELECT conv_id, turn, {_INTENT} AS intent FROM q", CONV),
    "r04_terms": sql(f"SELECT conv_id, turn, array_to_string({_TERMS}, ' ') AS terms FROM q", CONV),
    "r05_query_type": sql(f"SELECT conv_id, turn, CASE WHEN i IN ('how_works', 'semantic') THEN 'semantic' WHEN i IN ('where_handled', 'bottlenecks') THEN 'structural' ELSE 'text' END AS kind FROM (SELECT conv_id, turn, {_INTENT} AS i FROM q)", CONV),
    "r06_route": sql("SELECT node_id, CASE WHEN regexp_matches(CASE WHEN complexity > 25 THEN replace(name, ' ', '::') ELSE name END, '^[A-Za-z0-9_:.]+$') THEN 'exact_symbol' ELSE 'semantic' END AS route FROM parts", PARTS),
    "r08_text_score": sql(f"SELECT node_id, round({_TSQL}, 6) AS score FROM parts", PARTS),
    "r09_structural": sql("SELECT node_id, least(complexity * 4 / 100, 1.0) AS score FROM parts", PARTS),
    "r11_weights": sql("SELECT node_id, round(0.5 * 0.15 + 0.2 * 0.15 + least(complexity / 100, 1) * 0.25 + 0.1 * 0.45, 6) AS score FROM parts", PARTS),
    "r12_composite": sql(f"SELECT node_id, round({_TSQL} * 0.35 + 0.9 * 0.55 + least(complexity / 100, 1) * 0.1, 6) AS score FROM parts", PARTS),
    "r13_renormalise": sql(f"SELECT node_id, round(({_TSQL} * 0.3 + least(complexity / 100, 1) * 0.15) / 0.55, 6) AS score FROM parts", PARTS),
    "r14_adjust": sql("SELECT node_id, round(CASE WHEN starts_with(path, 'archive/') THEN 0.1 ELSE 1 END * CASE WHEN lower(name) = 'hot' THEN least(1, complexity / 100 * 1.8) WHEN contains(lower(name), 'hot') THEN least(1, complexity / 100 * 1.3) ELSE complexity / 100 END, 6) AS score FROM parts", PARTS),
    "r15_drop": sql(f"SELECT node_id FROM parts WHERE {_TSQL} > 0 OR complexity > 45", PARTS),
    "r16_rerank": sql("SELECT node_id, round(least(1, complexity / 100 * 1.2), 6) AS score FROM parts ORDER BY complexity DESC, node_id LIMIT 30", PARTS),
    "r07_search": sql(
        "SELECT CAST(row_number() OVER (ORDER BY score DESC, doc) AS INTEGER) AS rank, doc, score FROM (SELECT doc, round(least(1, greatest(0, least(1, tfidf * 0.2 + neural * 0.05 + least(complexity / 100, 1) * 0.05 + text * 0.7))"
        " * CASE WHEN contains(name, '::') OR contains(name, '.') THEN 0.7 ELSE 1 END * CASE WHEN lower(name) = qt THEN 1.8 WHEN contains(lower(name), qt) THEN 1.3 ELSE 1 END), 6) AS score FROM s WHERE text > 0 OR tfidf > 0 OR neural > 0) WHERE score >= 0.05 ORDER BY score DESC, doc LIMIT 20",
        _TFIDF, _FOUND, _SCORED,
    ),
    "r18_staged": sql(f"SELECT CAST(row_number() OVER (ORDER BY score DESC, doc) AS INTEGER) AS rank, doc, score FROM (SELECT doc, {_SIM} AS score FROM (SELECT doc FROM (SELECT doc, count(*) AS shared FROM k WHERE token IN {_IN} GROUP BY 1) ORDER BY shared DESC, doc LIMIT 200) JOIN embeddings v ON v.vec_id = doc JOIN embeddings q ON q.vec_id = 5) ORDER BY score DESC, doc LIMIT 10", _TFIDF),
    "r19_semantic_only": f"SELECT CAST(row_number() OVER (ORDER BY score DESC, doc) AS INTEGER) AS rank, doc, score FROM (SELECT v.vec_id AS doc, {_SIM} AS score FROM embeddings v JOIN embeddings q ON q.vec_id = 11 ORDER BY score DESC, doc LIMIT 15) WHERE score >= 0.05",
    "u01_candidates": sql("SELECT doc, bool_or(b = 'p') AS by_postings, bool_or(b = 'v') AS by_vector, bool_or(b = 'f') AS by_fragment FROM found GROUP BY 1", _TFIDF, _FOUND),
    "r23_incremental": "SELECT CASE WHEN p_size = 9 THEN 109 ELSE p_size END AS complexity, count(*) AS n FROM part WHERE p_size <> 7 GROUP BY 1",
    "r24_coherence": sql("SELECT (SELECT count(*) FROM p WHERE node_id NOT IN (SELECT node_id FROM x WHERE node_id IS NOT NULL)) AS dead_postings, (SELECT count(*) FROM x WHERE node_id IS NULL OR node_id NOT IN (SELECT node_id FROM p)) AS rows_without_postings, (SELECT count(*) FROM (SELECT node_id FROM x GROUP BY 1 HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM x WHERE node_id IS NULL) AS without_id, (SELECT count(*) FROM (SELECT node_id, t FROM p GROUP BY 1, 2 HAVING count(*) > 1)) AS repeated_postings", PARTS, "x AS (SELECT CASE WHEN complexity = 30 THEN NULL ELSE node_id END AS node_id FROM parts WHERE complexity > 5 UNION ALL SELECT node_id FROM parts WHERE complexity > 45)", "p AS (SELECT node_id, unnest(tokens) AS t FROM parts WHERE complexity > 7 OR complexity < 3 UNION ALL SELECT node_id, unnest(tokens) FROM parts WHERE complexity = 8)"),
    "r25_fuzzy_node": sql("SELECT node_id, CASE WHEN contains(name, 'bolt') THEN 100 ELSE 0 END + CASE WHEN contains(node_id, '7') THEN 50 ELSE 0 END + least(complexity, 50) AS score FROM parts ORDER BY score DESC, node_id LIMIT 1", PARTS),
    "r26_cascade": sql("SELECT asked, node_id, tier FROM (SELECT a.asked, node_id, tier, row_number() OVER (PARTITION BY a.asked ORDER BY tier, CASE WHEN node_type = 'Module' THEN 1 ELSE 0 END, node_id) AS r FROM (SELECT asked, n.node_id, n.node_type, CASE WHEN node_id = asked THEN 0 WHEN name = asked THEN 1 WHEN contains(name, asked) THEN 2 END AS tier FROM nodes n, (VALUES ('c12'), ('Customer#000000012'), ('#00000012')) t(asked)) a WHERE tier IS NOT NULL) WHERE r = 1", NODES),
    "r27_name_in_file": sql("SELECT node_id, CASE WHEN name = 'NATION_3' THEN 1 ELSE 2 END AS tier FROM nodes WHERE lower(name) = 'nation_3' ORDER BY 2, 1 LIMIT 1", NODES),
    "v13_tfidf_fit": sql("SELECT token, round(idf, 6) AS idf FROM v", _TFIDF),
    "v14_tfidf_transform": sql("SELECT doc, count(*) AS n, round(max(w) / sqrt(sum(w * w)), 6) AS top FROM (SELECT k.doc, k.k / t.total * v.idf AS w FROM k JOIN v USING (token) JOIN (SELECT doc, sum(k) AS total FROM k GROUP BY 1) t USING (doc)) GROUP BY 1", _TFIDF),
}
