"""Vector operators: similarity, top-k, quantisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codelake.plans.views import sql, table


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of other lengths or without direction."""
    ok = (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, drop_zero: bool = False) -> DataFrame:
    """The k nearest by cosine of each query, exactly. queries: a stated set, its size checked before it is broadcast."""
    if queries.count() > 10_000:
        raise ValueError("over 10,000 queries; run them in blocks")
    base = vectors.where(norm(F.col("embedding")) >= 1e-9) if drop_zero else vectors
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
    scored = base.join(F.broadcast(q), F.size("embedding") == F.size("_q")).select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("_q")), 6).alias("score"))
    # a top-k by partition first, so that the shuffle holds k rows a query and task
    local = scored.withColumn("_p", F.spark_partition_id()).withColumn("_r", F.row_number().over(W.partitionBy("query_id", "_p").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def quantise(v: Column) -> tuple[Column, Column, Column]:
    """(codes, scale, bias): 8 bits over the vector's range, halves away from zero."""
    lo, hi = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    scale = 254 / F.greatest(hi - lo, F.lit(1e-9))
    bias = -lo * scale - 127
    codes = F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.round(x.cast("double") * scale + bias))).cast("int"))
    return codes, scale, bias


def dequantise(codes: Column, scale: Column, bias: Column) -> Column:
    return F.transform(codes, lambda q: (q - bias) / scale)


def adc_dot(query: Column, codes: Column, scale: Column, bias: Column) -> Column:
    """Dot product of a plain query and a quantised vector."""
    total = F.aggregate(query, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return (dot(query, codes) - bias * total) / scale


def hash_embedding(text: Column, n: int = 64) -> Column:
    """A deterministic stand-in where no model is at hand."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substring(F.md5(F.concat(text, F.lit("|"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**31) - 1)


def embed_once(df: DataFrame, text: str, embed) -> DataFrame:
    """Embeds each distinct text once and joins the result back."""
    once = df.select(F.sha2(F.col(text), 256).alias("_h"), F.col(text).alias("_t")).dropDuplicates(["_h"]).select("_h", embed(F.col("_t")).alias("embedding"))
    return df.withColumn("_h", F.sha2(F.col(text), 256)).join(once, "_h").drop("_h")


def lsh_candidates(vectors: DataFrame, queries: DataFrame, k: int, bits: int = 6, tables: int = 10, seed: int = 5) -> DataFrame:
    """Approximate nearest by random hyperplanes: same bucket or one a bit away in any table, then exact cosine."""
    import numpy as np

    planes = np.random.default_rng(seed).standard_normal((tables, bits, 64))
    sign = lambda t, b: F.when(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in planes[t, b]])) >= 0, 1 << b).otherwise(0)
    code = F.array(*[F.struct(F.lit(t).alias("t"), sum((sign(t, b) for b in range(1, bits)), sign(t, 0)).alias("c")) for t in range(tables)])
    coded = lambda df: df.withColumn("_c", F.explode(code)).select("*", "_c.t", "_c.c").drop("_c")
    probes = F.array(F.col("c"), *[F.col("c").bitwiseXOR(F.lit(1 << b)) for b in range(bits)])
    q = coded(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"), "t", F.explode(probes).alias("c"))
    pairs = coded(vectors).join(q, ["t", "c"]).select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("_q")), 6).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a pair that meets in several tables ties with itself, so a dense rank cuts before the shuffle
    near = pairs.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= k).select("query_id", "vec_id", "score").distinct()
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _v(s, d):
    return table(s, d, "embeddings")


def _pair(s, d):
    """Each vector with the next one."""
    v = _v(s, d)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


def _quantised(s, d):
    codes, scale, bias = quantise(F.col("other"))
    return _pair(s, d).select("vec_id", "embedding", "other", codes.alias("q"), scale.alias("scale"), bias.alias("bias"))


_E = lambda: F.col("embedding")
_O = lambda: F.col("other")
_ADC = lambda: adc_dot(_E(), F.col("q"), F.col("scale"), F.col("bias"))
_BACK = lambda: dequantise(F.col("q"), F.col("scale"), F.col("bias"))
_r = lambda c: F.round(c, 5)
QUERIES = {
    "v01_cosine": lambda s, d: _pair(s, d).select("vec_id", F.round(cosine(_E(), _O()), 6).alias("score")),
    "v02_nearest": lambda s, d: nearest(_v(s, d), _v(s, d).where("vec_id % 100 = 0"), 10).select("query_id", "rank", "score"),
    "v03_nearest_nonzero": lambda s, d: nearest(_v(s, d), _v(s, d).where("vec_id % 100 = 0"), 5, True).select("query_id", "rank", "score"),
    "v04_lsh": lambda s, d: lsh_candidates(_v(s, d), _v(s, d).where("vec_id % 100 = 0"), 10),
    "v05_quantise": lambda s, d: _quantised(s, d).select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("codes"), F.array_min("q").alias("lo"), F.array_max("q").alias("hi")),
    "v06_dequantise": lambda s, d: _quantised(s, d).select("vec_id", _r(_BACK()[0]).alias("first")),
    "v07_quantise_error": lambda s, d: _quantised(s, d).select("vec_id", _r(F.sqrt(F.aggregate(F.zip_with(_BACK(), "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) / 64)).alias("rmse")),
    "v08_adc_dot": lambda s, d: _quantised(s, d).select("vec_id", _r(_ADC()).alias("dot")),
    "v09_adc_cosine": lambda s, d: _quantised(s, d).select("vec_id", _r(F.greatest(F.lit(0.0), 1 - _ADC() / (norm(_E()) * norm(_BACK())))).alias("distance")),
    "v10_adc_l2": lambda s, d: _quantised(s, d).select("vec_id", _r(F.greatest(F.lit(0.0), dot(_E(), _E()) + dot(_BACK(), _BACK()) - 2 * _ADC())).alias("distance")),
    "v11_adc_dot_distance": lambda s, d: _quantised(s, d).select("vec_id", _r(F.greatest(F.lit(0.0), (1 - _ADC()) / 2)).alias("distance")),
    "v15_overlay": lambda s, d: nearest(_v(s, d).where("vec_id % 7 <> 0").unionByName(_v(s, d).where("vec_id % 49 = 0")), _v(s, d).where("vec_id = 100"), 10).select("rank", "score"),
    "v17_embed_once": lambda s, d: embed_once(table(s, d, "documents").select("doc_id", "text"), "text", lambda t: hash_embedding(t, 4)).select("doc_id", F.round(F.col("embedding")[0], 9).alias("first"), F.round(F.col("embedding")[3], 9).alias("last")),
    "v19_hash_embedding": lambda s, d: table(s, d, "documents").select("doc_id", hash_embedding(F.col("source")).alias("e")).select("doc_id", F.size("e").alias("n"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("total")),
    "j06_vector_metadata": lambda s, d: nearest(_v(s, d), _v(s, d).where("vec_id = 7"), 10).join(_v(s, d).select("vec_id", "label"), "vec_id").groupBy("label").agg(F.count("*").alias("n")),
    "s23_vector_store": lambda s, d: _v(s, d).where(F.size("embedding") == 64).groupBy("label").agg(F.count("*").alias("n")),
}
_D = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_PAIR = "p AS (SELECT a.vec_id, a.embedding AS e, b.embedding AS o FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_QUANT = _PAIR + """, k AS (SELECT *, 254 / greatest(CAST(list_max(o) AS DOUBLE) - CAST(list_min(o) AS DOUBLE), 1e-9) AS scale, CAST(list_min(o) AS DOUBLE) AS lo FROM p), b AS (SELECT *, -lo * scale - 127 AS bias FROM k),
q AS (SELECT *, list_transform(o, lambda x: CAST(greatest(-128, least(127, round(CAST(x AS DOUBLE) * scale + bias))) AS INTEGER)) AS q FROM b), z AS (SELECT *, list_transform(q, lambda x: (x - bias) / scale) AS back FROM q)"""
_NEAR = lambda where, base, k: f"SELECT query_id, rank, score FROM (SELECT query_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round({_D('q.embedding', 'v.embedding')} / (sqrt({_D('q.embedding', 'q.embedding')}) * sqrt({_D('v.embedding', 'v.embedding')})), 6) AS score FROM embeddings q, ({base}) v WHERE {where})) WHERE rank <= {k}"
_HASHED = lambda c, i: f"round(CAST(CAST('0x' || substr(md5({c} || '|' || {i}), 1, 8) AS BIGINT) AS DOUBLE) / 2147483648.0 - 1, 9)"
SQL = {
    "j06_vector_metadata": "SELECT label, count(*) AS n FROM (SELECT v.label, round(" + _D("q.embedding", "v.embedding") + " / (sqrt(" + _D("q.embedding", "q.embedding") + ") * sqrt(" + _D("v.embedding", "v.embedding") + ")), 6) AS score, v.vec_id FROM embeddings v JOIN embeddings q ON q.vec_id = 7 ORDER BY score DESC, v.vec_id LIMIT 10) GROUP BY 1",
    "v01_cosine": sql(f"SELECT vec_id, round({_D('e', 'o')} / (sqrt({_D('e', 'e')}) * sqrt({_D('o', 'o')})), 6) AS score FROM p", _PAIR),
    "v02_nearest": _NEAR("q.vec_id % 100 = 0", "SELECT * FROM embeddings", 10),
    "v03_nearest_nonzero": _NEAR("q.vec_id % 100 = 0", "SELECT * FROM embeddings", 5),
    "v05_quantise": sql("SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS codes, list_min(q) AS lo, list_max(q) AS hi FROM z", _QUANT),
    "v06_dequantise": sql("SELECT vec_id, round(back[1], 5) AS first FROM z", _QUANT),
    "v07_quantise_error": sql("SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(back, o), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64), 5) AS rmse FROM z", _QUANT),
    "v08_adc_dot": sql(f"SELECT vec_id, round({_D('e', 'back')}, 5) AS dot FROM z", _QUANT),
    "v09_adc_cosine": sql(f"SELECT vec_id, round(greatest(0, 1 - {_D('e', 'back')} / (sqrt({_D('e', 'e')}) * sqrt({_D('back', 'back')}))), 5) AS distance FROM z", _QUANT),
    "v10_adc_l2": sql(f"SELECT vec_id, round(greatest(0, {_D('e', 'e')} + {_D('back', 'back')} - 2 * {_D('e', 'back')}), 5) AS distance FROM z", _QUANT),
    "v11_adc_dot_distance": sql(f"SELECT vec_id, round(greatest(0, (1 - {_D('e', 'back')}) / 2), 5) AS distance FROM z", _QUANT),
    "v15_overlay": "SELECT rank, score FROM (" + _NEAR("q.vec_id = 100", "SELECT * FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 49 = 0", 10) + ")",
    "v17_embed_once": f"SELECT doc_id, {_HASHED('text', 0)} AS first, {_HASHED('text', 3)} AS last FROM documents",
    "v19_hash_embedding": f"SELECT doc_id, CAST(len(e) AS INTEGER) AS n, round(list_sum(e), 6) AS total FROM (SELECT doc_id, list_transform(range(64), lambda i: {_HASHED('source', 'i')}) AS e FROM documents)",
    "s23_vector_store": "SELECT label, count(*) AS n FROM embeddings WHERE len(embedding) = 64 GROUP BY 1",
}
