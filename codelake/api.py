"""The engine's surface: an index of a source tree and the questions it answers. Every method returns a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codelake.functions.text import apply_edits, code_tokens, keywords, stem, token_estimate, unified_diff
from codelake.operators import aggregates, extraction, graph, joins, lookups, ranking, retrieval, vectors
from codelake.plans.session import ensure_checkpoints
from codelake.sources import files
from codelake.streaming import incremental


@dataclass
class Index:
    """Sources (path, language, hash, content) with the symbols and dependencies that they hold."""

    sources: DataFrame
    nodes: DataFrame = field(init=False)
    edges: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.nodes, self.edges = extraction.build_graph(self.sources)

    # --- building ---------------------------------------------------------------------------------------

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, max_bytes: int = 10 << 20) -> Index:
        return cls(files.sources(files.read_tree(spark, root, max_bytes)))

    @classmethod
    def load(cls, spark: SparkSession, store: str) -> Index:
        """The newest published generation."""
        self = cls.__new__(cls)
        self.sources, self.nodes, self.edges = (files.current(spark, f"{store}/{t}") for t in ("sources", "nodes", "edges"))
        return self

    def publish(self, store: str, generation: int) -> None:
        for t in ("sources", "nodes", "edges"):
            files.publish(getattr(self, t), f"{store}/{t}", generation)

    def refreshed(self, seen: DataFrame) -> Index:
        """The index of a newer state of the sources; unchanged files keep their rows."""
        return Index(incremental.refresh(self.sources, seen, incremental.changes(self.sources, seen)))

    def status(self) -> DataFrame:
        return self.sources.agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes")).join(self.nodes.agg(F.count("*").alias("symbols")), F.lit(True)).join(self.edges.agg(F.count("*").alias("dependencies")), F.lit(True))

    # --- finding ----------------------------------------------------------------------------------------

    def _documents(self) -> DataFrame:
        return self.nodes.select("node_id", "name", F.col("file_path").alias("path"), "complexity", F.array_union(code_tokens(F.col("name")), code_tokens(F.col("qname"))).alias("tokens"))

    def _texts(self) -> DataFrame:
        """(node_id, text): each symbol's name and own text."""
        own = F.decode(F.substring(F.encode("content", "utf-8"), (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int")), "utf-8")
        return self.nodes.join(self.sources.select(F.col("path").alias("file_path"), "content"), "file_path").select("node_id", F.concat_ws(" ", "qname", own).alias("text"))

    def lexicon(self) -> tuple[DataFrame, DataFrame]:
        """(weights, vocabulary) of the symbols' texts, made once an index."""
        if not hasattr(self, "_lexicon"):
            ensure_checkpoints(self.nodes.sparkSession)
            counts = retrieval.token_counts(self._texts(), "node_id", "text").checkpoint()
            vocabulary = retrieval.tfidf_vocabulary(counts, self.nodes.count()).checkpoint()
            self._lexicon = retrieval.tfidf_weights(counts, vocabulary).checkpoint(), vocabulary
        return self._lexicon

    def _tfidf(self, text: str) -> DataFrame:
        weights, vocabulary = self.lexicon()
        return retrieval.tfidf_scores(weights, vocabulary, retrieval.query_tokens(text)).withColumnRenamed("doc", "node_id")

    def search(self, text: str, kind: str | None = None, top_k: int = 10, scope: str | None = None, vectors_: DataFrame | None = None, vector: DataFrame | None = None) -> DataFrame:
        """Ranked symbols; the scope is a filter before the ranking. Without a kind, the query's form and words choose it.

        vectors_ and vector: embeddings of the symbols and of the query (vec_id, embedding), if there are any."""
        spark = self.nodes.sparkSession
        if kind is None:
            one = spark.createDataFrame([(text,)], "q string").select(retrieval.route(F.col("q")).alias("r"), retrieval.query_type(retrieval.intent(F.col("q"))).alias("t")).head()
            kind = "exact" if one["r"] == "exact_symbol" else one["t"]
        near = vectors.nearest(vectors_, vector, 10 * top_k).select(F.col("vec_id").alias("node_id"), F.col("score").alias("neural")) if vector is not None else None
        return retrieval.search(self._documents().where(lookups.in_scope(F.col("path"), scope)), self._tfidf(text), retrieval.Query(text, kind, top_k), near)

    def analyze(self, text: str, top_k: int = 10) -> DataFrame:
        """The question as it is, without stop words and stemmed: the best score of each symbol, fewer from one file."""
        spark = self.nodes.sparkSession
        one = spark.createDataFrame([(text,)], "q string").select(keywords(F.col("q")).alias("k"), F.array_join(F.transform(F.split(keywords(F.col("q")), " "), stem), " ").alias("s")).head()
        found = [retrieval.search(self._documents(), self._tfidf(q), retrieval.Query(q, "semantic", 15)) for q in dict.fromkeys((text, one["k"], one["s"]))]
        best = ranking.best_of([f.select("node_id", "score") for f in found], "node_id", "score").join(self.nodes.select("node_id", "name", "file_path"), "node_id")
        return ranking.diversified(best, "file_path", "score", "node_id", top_k)

    def grep(self, pattern: str, page: int = 50, offset: int = 0) -> DataFrame:
        return ranking.page(lookups.grep_symbols(self.nodes, pattern), [F.col("tier"), F.col("node_id")], offset, page)

    def lookup(self, symbol: str) -> DataFrame:
        """The symbol by id, name or part of a name, with counts of callers and callees."""
        tiers = [F.col("node_id") == symbol, F.col("name") == symbol, F.col("name").contains(symbol)]
        one = retrieval.cascade(self.nodes, tiers, F.when(F.col("node_type") == "Module", 1).otherwise(0), "node_id")
        callers = self.edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("callers"))
        callees = self.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("callees"))
        return one.join(callers, "node_id", "left").join(callees, "node_id", "left").fillna(0, ["callers", "callees"])

    def lines(self) -> DataFrame:
        split = self.sources.select("path", F.posexplode(F.split("content", "\n")).alias("line", "content"))
        return split.select("path", (F.col("line") + 1).cast("long").alias("line"), "content")

    def text_search(self, pattern: str, regex: bool = False, ignore_case: bool = False, around: int = 2, scope: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        """Lines that match, with lines around and the symbol that holds them."""
        wanted = self.lines().where(lookups.path_wanted(F.col("path"), scope, include or [], exclude or []))
        found = ranking.with_context(ranking.line_offsets(wanted), lookups.line_matches(F.col("content"), pattern, regex, ignore_case), around)
        spans = self.nodes.select(F.col("file_path").alias("path"), "node_id", "byte_start", "byte_end")
        inside = joins.innermost(found.select("path", "offset"), spans, "path", "offset").select("path", "offset", "node_id")
        return found.join(inside, ["path", "offset"], "left").orderBy("path", "line")

    def read_file(self, path: str, first: int = 1, last: int = 2000) -> DataFrame:
        return self.lines().where((F.col("path") == path) & F.col("line").between(first, last)).orderBy("line")

    def read_symbol(self, symbol: str) -> DataFrame:
        """The symbol's own text."""
        text = F.decode(F.substring(F.encode("content", "utf-8"), (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int")), "utf-8")
        return lookups.find_symbol(self.nodes, symbol).join(self.sources.select(F.col("path").alias("file_path"), "content"), "file_path").select("node_id", "file_path", text.alias("text"))

    # --- overviews --------------------------------------------------------------------------------------

    def file_summary(self, path: str) -> DataFrame:
        return lookups.symbols_in_file(self.nodes, path)

    def project_map(self, limit: int = 50) -> DataFrame:
        return aggregates.file_stats(self.nodes, self.edges).orderBy(F.desc("total_complexity"), "file_path").limit(limit)

    def phases(self, top: int = 10, keywords_: tuple[str, ...] = ("auth", "critical", "error")) -> dict[str, DataFrame]:
        """Symbols and files; imports; impact by file; hotspots."""
        n, e = self.nodes, self.edges
        return {
            "structure": n.agg(F.countDistinct("file_path").alias("files"), F.count_if(F.col("node_type").isin("Function", "Method", "Variable")).alias("signatures"), F.countDistinct("language").alias("languages")),
            "imports": e.where("edge_type = 'Import'").join(n.select(F.col("node_id").alias("dst"), "node_type"), "dst", "left").agg(F.count("node_type").alias("internal"), F.count_if(F.col("node_type").isNull()).alias("external")),
            "focus": e.join(n.select(F.col("node_id").alias("dst"), "file_path"), "dst").groupBy("file_path").agg(F.countDistinct("src").alias("impact")).orderBy(F.desc("impact"), "file_path").limit(20),
            "hotspots": aggregates.ranked_hotspots(n, e, list(keywords_), top, 5 * top),
        }

    def diagnostics(self) -> DataFrame:
        return aggregates.count_by(self.nodes, "node_type").withColumnRenamed("node_type", "what").unionByName(aggregates.count_by(self.edges, "edge_type").withColumnRenamed("edge_type", "what"))

    # --- change -----------------------------------------------------------------------------------------

    def _start(self, symbol: str) -> DataFrame:
        return self.nodes.where((F.col("node_id") == symbol) | (F.col("name") == symbol)).select("node_id")

    def context(self, symbol: str, budget: int = 2000, preset: str = "llm_context") -> DataFrame:
        """The symbol's neighbourhood, best first, within a budget of tokens."""
        near = graph.traverse(self.nodes, self.edges, self._start(symbol), graph.PRESETS[preset])
        sized = near.select(F.lit(symbol).alias("query"), "node_id", "depth", "complexity", F.greatest(F.floor((F.col("byte_end") - F.col("byte_start")) / 4), F.lit(10)).cast("int").alias("tokens"))
        return graph.gravity(sized, "query", budget)

    def impact(self, symbol: str, change: str = "edit", depth: int = 5) -> DataFrame:
        """What a change reaches, either way, and its risk."""
        start = self._start(symbol)
        typed = self.edges.where(F.col("edge_type").isin("Call", "DataDependency", "Inheritance"))
        both = graph.reach(typed, start, depth).union(graph.reach(typed, start, depth, True)).where("depth > 0").select("node_id").distinct()
        sums = both.join(self.nodes.select("node_id", "file_path"), "node_id").agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"))
        return sums.withColumn("risk", graph.impact_risk(F.col("nodes"), F.col("files"), change))

    def rename_files(self, symbol: str) -> DataFrame:
        """Files that a rename touches: of the definition, of what refers to it and of what has the same name."""
        found = self._start(symbol).join(self.nodes, "node_id").select("name", "file_path")
        back = graph.reach(self.edges, self._start(symbol), 5, True).join(self.nodes.select("node_id", "file_path"), "node_id").select("file_path")
        return back.union(self.nodes.join(found.select("name").distinct(), "name", "left_semi").select("file_path")).distinct()

    def preview(self, path: str, edits: Column) -> DataFrame:
        """A unified diff of a file under edits (an array of start, end, text)."""
        return self.sources.where(F.col("path") == path).select("path", unified_diff("content", apply_edits("content", edits)).alias("diff"))

    def validate(self, seen: DataFrame) -> DataFrame:
        """Symbols added, removed or changed in a newer state of the sources."""
        newer = extraction.parse(seen).where("error is null")
        shape = lambda df: df.select("qname", F.concat_ws(",", F.array_join("params", ","), F.coalesce("returns", F.lit(""))).alias("shape")).groupBy("qname").agg(F.max("shape").alias("shape"))
        older = extraction.parse(self.sources).where("error is null")
        return joins.drift(shape(older), shape(newer), "qname", "shape").where("kind <> 'same'").select("qname", "kind", F.col("kind").isin("changed", "removed").alias("breaking"))

    def tokens(self) -> DataFrame:
        return self.sources.select("path", token_estimate(F.col("content")).alias("tokens"))
