"""The engine as an object: ranked and unranked search over a stored index, named filters, sites, links, mathematics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calculator
from .operators import filters, graph, index, search, views
from .plans.parse import Spec, merge, parse, read_cursor, read_filter, write_cursor


class Engine:
    """``path`` holds what build() wrote; ``edges`` (src, dst) is the graph of sites, if there is one."""

    def __init__(self, spark: SparkSession, path: str, edges: DataFrame | None = None, weights: search.Weights = search.Weights(), sets: dict[str, DataFrame] | None = None, overrides: DataFrame | None = None) -> None:
        self.spark, self.path, self.edges, self.weights = spark, path, edges, weights
        self.sets, self.overrides = {k.lower(): v for k, v in (sets or {}).items()}, overrides
        self._filters: dict[tuple[str, str], str] = {}

    @classmethod
    def build(cls, docs: DataFrame, path: str, terms: DataFrame | None = None, **more) -> Engine:
        """Writes an index of docs (doc_id, text, lang, source, n_chars; year, quality, rank, size and node where there are any).

        ``terms`` (doc_id, term) are synthetic ones, such as ``format:html`` or ``ip:10.0.0.1``; those of sites are made here.
        """
        index.write_index(docs, path, terms)
        return cls(docs.sparkSession, path, **more)

    # ---- filters ----------------------------------------------------------------------------------------------

    def put_filter(self, user: str, name: str, xml: str) -> None:
        read_filter(xml)  # raises where it can't be read
        self._filters[user, name] = xml

    def get_filter(self, user: str, name: str) -> str | None:
        return self._filters.get((user, name))

    def list_filters(self, user: str) -> list[str]:
        return sorted(n for u, n in self._filters if u == user)

    def drop_filter(self, user: str, name: str) -> bool:
        return self._filters.pop((user, name), None) is not None

    def _spec(self, text: str, filter_xml: str | None) -> Spec:
        spec = parse(text)
        return merge(spec, read_filter(filter_xml)) if filter_xml else spec

    # ---- search -----------------------------------------------------------------------------------------------

    def _docs(self, spec: Spec) -> DataFrame:
        docs = self.spark.read.parquet(f"{self.path}/doc")
        keep = docs.where(F.col("lang") == spec.lang) if spec.lang else docs
        for names, wanted in (((*spec.sources, *spec.sites), True), (spec.not_sources, False)):
            if names:
                keep = keep.where(F.col("source").isin(*names) == wanted)
        if spec.search_set:
            if spec.search_set.lower() not in self.sets:
                raise ValueError(f"no such set: {spec.search_set}")
            keep = filters.in_set(keep, "source", self.sets[spec.search_set.lower()])
        if spec.near:
            if self.edges is None or not spec.near.lstrip("-").isdigit() or "node" not in keep.columns:
                raise ValueError("near: takes a node of the engine's graph, and an index of documents with nodes")
            near = self.similar(int(spec.near)).select(F.col("other").alias("node"))
            keep = keep.join(near, "node", "left_semi")
        if filters.required_flag(spec.strategy):
            raise ValueError(f"{spec.strategy} asks for flags, which this index doesn't hold")
        columns = {c: F.col(c) for c in ("year", "quality", "rank", "size") if c in keep.columns}
        return keep.where(search.limits(spec, {"size": F.col("n_chars"), **columns}))

    def _postings(self, spec: Spec) -> DataFrame:
        words = {*spec.terms, *spec.required, *spec.excluded, *spec.boosts, *(w for p in spec.phrases + spec.excluded_phrases for w in p if w)}
        return index.read_postings(self.spark, self.path, sorted(words))

    def search(self, text: str, count: int = 20, per_source: int = 2, page: int = 1, filter_xml: str | None = None) -> DataFrame:
        """(doc_id, source, score, seen), best first; ``seen``: how many of the source were scored."""
        spec = self._spec(text, filter_xml)
        docs = self._docs(spec)
        scored = search.score(self._postings(spec), docs, spec, self.weights).join(docs.select("doc_id", "source"), "doc_id")
        if self.overrides is not None:  # (source, factor)
            scored = scored.join(self.overrides.select("source", "factor"), "source", "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0))).drop("factor")
        for source, factor in spec.source_boosts:
            scored = scored.withColumn("score", F.when(F.col("source") == source, F.col("score") * factor).otherwise(F.col("score")))
        best = search.top(scored, "source", count * page, per_source).select("doc_id", "source", "score", "seen")
        return best.orderBy(F.desc("score"), "doc_id").offset((page - 1) * count).limit(count)

    def unranked(self, text: str, count: int = 100, cursor: str = "", filter_xml: str | None = None) -> tuple[list[int], str]:
        """The next ``count`` ids in order, and the cursor of those after them."""
        last, ended = read_cursor(cursor)
        if ended:
            return [], cursor
        spec = self._spec(text, filter_xml)
        ids = search.found(self._postings(spec), spec).join(self._docs(spec).select("doc_id"), "doc_id", "left_semi")
        found = [r.doc_id for r in search.after(ids, "doc_id", last, count).collect()]
        return found, write_cursor(found[-1] if found else None, ended=len(found) < count)

    def keyword_scores(self, text: str) -> DataFrame:
        """(doc_id, term, tf, positions) of a query's words in the documents it finds."""
        spec = parse(text)
        rows = self._postings(spec)
        return rows.join(search.found(rows, spec), "doc_id", "left_semi").select("doc_id", "term", "tf", "positions")

    # ---- sites and links --------------------------------------------------------------------------------------

    def links_from(self, node: int) -> DataFrame:
        return self.edges.where(F.col("src") == node).select("dst").distinct()

    def links_to(self, node: int) -> DataFrame:
        return self.edges.where(F.col("dst") == node).select("src").distinct()

    def link_counts(self) -> DataFrame:
        return graph.degrees(self.edges)

    def similar(self, node: int) -> DataFrame:
        """(other, value), most alike first. Only sources that link to the node can make its pairs."""
        near = self.edges.join(self.links_to(node), "src", "left_semi").select("dst").distinct()
        rows = graph.similarity(self.edges.join(near, "dst", "left_semi").select("src", "dst"))
        both = rows.where((F.col("a") == node) | (F.col("b") == node))
        return both.select(F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a")).alias("other"), "value").orderBy(F.desc("value"), "other")

    def site(self, source: str) -> DataFrame:
        """(source, documents, chars, langs) of one source."""
        rows = self.spark.read.parquet(f"{self.path}/doc").where(F.col("source") == source)
        return rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.sort_array(F.collect_set("lang")).alias("langs"))

    def execute(self, spec: Spec) -> DataFrame:
        """(doc_id, score) of a compiled query, unordered: what a node of the index answers."""
        docs = self._docs(spec)
        return search.score(self._postings(spec), docs, spec, self.weights)

    def explain(self, text: str, weights: search.Weights | None = None) -> DataFrame:
        """(doc_id, term, tf, df, n_docs, n_chars, part): what each word adds to a document's score, with other weights if given."""
        spec = self._spec(text, None)
        return search.factors(self._postings(spec), self._docs(spec), spec, weights or self.weights)

    def linking(self, node: int, count: int = 20) -> DataFrame:
        """(other, rank, relatedness, direction) of the nodes linked with one."""
        rank = self.link_counts().select("node", F.col("n_in").cast("double").alias("rank"))
        return views.linking(self.edges, node, rank, self.similar(node).select("other", F.col("value").alias("relatedness")), count)

    # ---- the service's defaults -------------------------------------------------------------------------------

    def search_v1(self, text: str, count: int = 20, per_source: int = 2, page: int = 1) -> DataFrame:
        return self.search(text, min(100, max(1, count)), min(100, max(1, per_source)), max(1, page))

    def search_v2(self, text: str, count: int = 20, per_source: int = 2, page: int = 1, user: str = "", name: str | None = None) -> DataFrame:
        """As search(), by the name of a stored filter."""
        xml = self.get_filter(user, name) if name else None
        if name and xml is None:
            raise ValueError(f"no such filter: {name}")
        return self.search(text, count, per_source, page, xml)

    def unranked_v2(self, text: str, count: int = 100, cursor: str = "") -> tuple[list[int], str]:
        if count > 1_000_000:
            raise ValueError("a page is 1,000,000 at most")
        return self.unranked(text, count, cursor)

    def to_json(self, results: DataFrame) -> list[str]:
        """A page of results as lines of JSON."""
        return [r[0] for r in results.select(F.to_json(F.struct("*"))).collect()]

    # ---- functions --------------------------------------------------------------------------------------------

    def calculate(self, text: str) -> str:
        return calculator.formatted(text)

    def convert(self, value: float, source: str, target: str) -> float | None:
        return calculator.convert(value, source, target)

    def spell(self, words: DataFrame, word: str) -> DataFrame:
        return calculator.spelling(words, word)

    def define(self, dictionary: DataFrame, word: str) -> DataFrame:
        return calculator.definitions(dictionary, word)

    def feed(self, feeds_: DataFrame, domain: str, count: int = 10) -> DataFrame:
        """The newest items of a domain's feed (domain, date, title, url)."""
        return feeds_.where(F.col("domain") == domain).orderBy(F.desc("date"), "url").limit(count)
