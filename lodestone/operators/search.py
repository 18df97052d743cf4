"""Retrieval and ranking: a query is one pruned scan of the postings and one aggregate, then joins for what survives."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.parse import Spec


@dataclass(frozen=True)
class Weights:
    """Ranking parameters; the values are this engine's own."""

    k1: float = 1.2
    b: float = 0.5
    length: float = 5000.0
    boost: float = 1.0
    bm25: float = 1.0
    proximity: float = 1.0
    first_position: float = 1.0
    verbatim: float = 1.0
    bias: str = "none"  # recent, old or none
    temporal: float = 0.0
    min_year: int = 1995
    max_year: int = 2025
    rank: float = 0.01
    quality: float = 1.0
    short_sentence: int = 2
    short_sentence_penalty: float = 5.0
    short_document: int = 200
    short_document_penalty: float = 5.0


def matching(postings: DataFrame, spec: Spec, any_of: tuple[str, ...] = ()) -> DataFrame:
    """doc_id of documents with all terms and required terms, no excluded one and, given any_of, one of these."""
    need = tuple(dict.fromkeys(spec.terms + spec.required))
    every = [*need, *spec.excluded, *any_of]
    rows = postings.where(F.col("term").isin(list(dict.fromkeys(every)))).select("doc_id", "term")
    has = lambda t: F.max((F.col("term") == t).cast("int"))
    found = rows.groupBy("doc_id").agg(*[has(t).alias(f"n{i}") for i, t in enumerate(need)], *[has(t).alias(f"x{i}") for i, t in enumerate(spec.excluded)], *([F.max(F.col("term").isin(list(any_of)).cast("int")).alias("any")] if any_of else []))
    ok = [F.col(f"n{i}") == 1 for i in range(len(need))] + [F.col(f"x{i}") == 0 for i in range(len(spec.excluded))] + ([F.col("any") == 1] if any_of else [])
    return found.where(reduce(Column.__and__, ok, F.lit(True))).select("doc_id")


def matching_paths(postings: DataFrame, paths: list[tuple[str, ...]]) -> DataFrame:
    """doc_id of documents that have every term of at least one path."""
    terms = list(dict.fromkeys(t for p in paths for t in p))
    held = postings.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.collect_set("term").alias("t"))
    ok = [F.size(F.array_intersect("t", F.array(*map(F.lit, p)))) == len(p) for p in paths]
    return held.where(reduce(Column.__or__, ok, F.lit(False))).select("doc_id")


def tree_value(postings: DataFrame, paths: list[tuple[str, ...]], value: Column, how: str) -> DataFrame:
    """(doc_id, value): the greatest over the paths that a document has whole of the least (min) or the sum of its terms' values."""
    terms = list(dict.fromkeys(t for p in paths for t in p))
    wide = postings.where(F.col("term").isin(terms)).groupBy("doc_id").agg(*[F.max(F.when(F.col("term") == t, value)).alias(f"v{i}") for i, t in enumerate(terms)])
    of = lambda p: [F.col(f"v{terms.index(t)}") for t in p]
    fold_ = (lambda cs: F.least(*cs) if len(cs) > 1 else cs[0]) if how == "min" else (lambda cs: reduce(Column.__add__, cs))
    whole = [F.when(reduce(Column.__and__, [c.isNotNull() for c in of(p)]), fold_(of(p))) for p in paths]
    best = F.greatest(*whole) if len(whole) > 1 else whole[0]
    return wide.select("doc_id", best.cast("long").alias("value")).where("value is not null")


def semi_chain(postings: DataFrame, spec: Spec) -> DataFrame:
    """As matching(), literally by semi and anti joins: a cross-check of the aggregate."""
    ids = lambda t: postings.where(F.col("term") == t).select("doc_id").distinct()
    first, *rest = dict.fromkeys(spec.terms + spec.required)
    out = ids(first)
    for t in rest:
        out = out.join(ids(t), "doc_id", "left_semi")
    for t in spec.excluded:
        out = out.join(ids(t), "doc_id", "left_anti")
    return out


def shifted(positions: Column, i: int) -> Column:
    return F.transform(positions, lambda p: p - i)


def phrase_starts(columns: list[tuple[Column, int]]) -> Column:
    """Positions p with each word at p + its offset; holes of the phrase have no column."""
    return reduce(F.array_intersect, [shifted(c, i) for c, i in columns])


def phrase(postings: DataFrame, words: tuple[str | None, ...]) -> DataFrame:
    """(doc_id, hits, first) of documents that hold the phrase; None takes up a position."""
    real = [(w, i) for i, w in enumerate(words) if w]
    rows = postings.where(F.col("term").isin([w for w, _ in real])).groupBy("doc_id")
    wide = rows.agg(*[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{i}") for w, i in real])
    hits = wide.select("doc_id", phrase_starts([(F.col(f"p{i}"), i) for _, i in real]).alias("at")).where(F.size("at") > 0)
    return hits.select("doc_id", F.size("at").cast("long").alias("hits"), F.array_min("at").cast("long").alias("first"))


def min_distance(a: Column, b: Column) -> Column:
    """The least distance of two position lists: both are merged by position, and only neighbours of different lists compared."""
    own = lambda c, k: F.transform(c, lambda x: F.struct(x.cast("int").alias("p"), F.lit(k).alias("k")))
    both = F.array_sort(F.concat(own(a, 0), own(b, 1)))
    none = F.lit(-1)
    start = F.struct(none.alias("p"), none.alias("k"), F.lit(2147483647).alias("best"))
    near = F.aggregate(both, start, lambda s, x: F.struct(x["p"].alias("p"), x["k"].alias("k"), F.when((s["k"] >= 0) & (s["k"] != x["k"]), F.least(s["best"], x["p"] - s["p"])).otherwise(s["best"]).alias("best")))["best"]
    return F.when((F.size(a) > 0) & (F.size(b) > 0), near)


def spans_holding(spans: Column, positions: Column, length: int, how: str = "inside") -> Column:
    """How many spans [start, end) hold a phrase of ``length`` at one of the positions: inside, exact or boundary."""
    def fits(s):
        inside = lambda p: (p >= s["start"]) & (p + length <= s["end"])
        exact = lambda p: (p == s["start"]) & (p + length == s["end"])
        edge = lambda p: inside(p) & ((p == s["start"]) | (p + length == s["end"]))
        return F.exists(positions, {"inside": inside, "exact": exact, "boundary": edge}[how])

    return F.size(F.filter(spans, fits)).cast("long")


def positions_in(spans: Column, positions: Column) -> Column:
    return F.size(F.filter(positions, lambda p: F.exists(spans, lambda s: (p >= s["start"]) & (p < s["end"])))).cast("long")


def bm25(tf: Column, df: Column, n: Column, length: Column, w: Weights = Weights()) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (w.k1 + 1) / (tf + w.k1 * (1 - w.b + w.b * length / w.length))


def limits(spec: Spec, columns: dict[str, Column]) -> Column:
    ok = F.lit(True)
    for name, sign, value in spec.limits:
        if name not in columns:
            raise ValueError(f"the index has no {name} to limit by")
        c = columns[name]
        ok = ok & {"=": c == value, "<": c <= value, ">": c >= value}[sign]
    return ok


def found(postings: DataFrame, spec: Spec) -> DataFrame:
    """doc_id of documents that match, with all phrases and none of the excluded ones."""
    ids = matching(postings, spec)
    for p in spec.phrases:
        ids = ids.join(phrase(postings, p).select("doc_id"), "doc_id", "left_semi")
    for p in spec.excluded_phrases:
        ids = ids.join(phrase(postings, p).select("doc_id"), "doc_id", "left_anti")
    return ids


def score(postings: DataFrame, docs: DataFrame, spec: Spec, w: Weights = Weights()) -> DataFrame:
    """(doc_id, score): BM25 over the ranked terms of matching documents, times exp(boost terms found / 5)."""
    ids = found(postings, spec)
    n = docs.agg(F.count("*").alias("n_docs"))
    wanted = postings.where(F.col("term").isin(list(spec.terms + spec.boosts)))
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    rows = wanted.join(ids, "doc_id", "left_semi").join(F.broadcast(df), "term").join(F.broadcast(n)).join(docs.select("doc_id", "n_chars"), "doc_id")
    part = F.when(F.col("term").isin(list(spec.terms)), bm25(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("n_chars"), w)).otherwise(0.0)
    extra = F.when(F.col("term").isin(list(spec.boosts)), w.boost).otherwise(0.0)
    return rows.groupBy("doc_id").agg((F.sum(part) * F.exp(F.sum(extra) / 5)).alias("score"))


def factors(postings: DataFrame, docs: DataFrame, spec: Spec, w: Weights = Weights()) -> DataFrame:
    """(doc_id, term, tf, df, n_docs, n_chars, part): the shares of score(), a row a word."""
    wanted = postings.where(F.col("term").isin(list(spec.terms)))
    n = docs.agg(F.count("*").alias("n_docs"))
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    rows = wanted.join(found(postings, spec), "doc_id", "left_semi").join(F.broadcast(df), "term").join(F.broadcast(n)).join(docs.select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", "term", "tf", "df", "n_docs", "n_chars", bm25(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("n_chars"), w).alias("part"))


def top(scored: DataFrame, group: str, limit: int = 20, per_group: int = 2) -> DataFrame:
    """The best ``limit`` with at most ``per_group`` of a group, and how many scored the group had.

    Ranks within a group are cut at ``per_group`` before rows meet (WindowGroupLimit), so a hot group stays small.
    """
    order = [F.desc("score"), F.asc("doc_id")]
    seen = scored.groupBy(group).agg(F.count("*").alias("seen"))
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= per_group)
    return best.drop("place").join(seen, group).orderBy(*order).limit(limit)


def distinct_content(rows: DataFrame, content: Column, order: list[Column]) -> DataFrame:
    """The first row of each content, in the given order (after a top-k, so that fewer than k may stay)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(content).orderBy(*order))).where("_n = 1").drop("_n")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def after(rows: DataFrame, key: str, last: int | None, size: int) -> DataFrame:
    """Keyset paging: the next ``size`` rows by key."""
    rows = rows.where(F.col(key) > last) if last is not None else rows
    return rows.orderBy(key).limit(size)


def final_score(value: Column, penalty: Column) -> Column:
    """Lower is better."""
    return F.sqrt((501 + 20 * penalty) / (1 + value))
