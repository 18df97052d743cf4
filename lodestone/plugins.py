"""Where the engine can be extended: filters, sources, processors, rankings, graphs, exporters, stemmers, classifiers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .functions.language import STEMMERS


class QueryFilter(Protocol):
    """A predicate on documents, with what it costs and what it is."""

    def column(self) -> Column: ...
    def cost(self) -> float: ...
    def describe(self) -> str: ...


def apply_filters(rows: DataFrame, filters: list[QueryFilter]) -> DataFrame:
    """All filters as one predicate, cheap ones first."""
    for f in sorted(filters, key=lambda f: f.cost()):
        rows = rows.where(f.column())
    return rows


def describe(filters: list[QueryFilter]) -> str:
    return " and ".join(f.describe() for f in sorted(filters, key=lambda f: f.cost()))


@dataclass(frozen=True)
class Where:
    """A filter made of a column."""

    test: Callable[[], Column]
    name: str
    price: float = 1.0

    def column(self) -> Column:
        return self.test()

    def cost(self) -> float:
        return self.price

    def describe(self) -> str:
        return self.name


class Source(Protocol):
    """A domain's name and its documents (url, title, text)."""

    domain: str

    def documents(self, spark: SparkSession) -> DataFrame: ...


class Processor(Protocol):
    """Makes documents of the records it applies to."""

    def applies(self) -> Column: ...
    def process(self, records: DataFrame) -> DataFrame: ...


def dispatch(records: DataFrame, processors: list[Processor], reason: str = "CONTENT_TYPE") -> tuple[DataFrame | None, DataFrame]:
    """(documents, disqualified records): the first processor that applies takes a record; those that none takes get a reason."""
    out, left = None, F.lit(True)
    for p in processors:
        mine = left & F.coalesce(p.applies(), F.lit(False))
        left = left & ~F.coalesce(p.applies(), F.lit(False))
        made = p.process(records.where(mine))
        out = made if out is None else out.unionByName(made)
    return out, records.where(left).withColumn("reason", F.lit(reason))


RankingAlgorithm = Callable[[DataFrame], DataFrame]  # edges -> (node, score)


def accumulate(scores: DataFrame, how: str, count: int | None = None):
    """Scores (node, score) gathered as a table of places, a set of nodes, or their sum."""
    from .operators import graph

    if how == "places":
        return graph.top_ranked(scores, count or scores.count())
    if how == "set":
        return {r.node for r in scores.orderBy(F.desc("score"), F.desc("node")).limit(count or 1000).select("node").collect()}
    if how == "sum":
        return scores.agg(F.sum("score")).first()[0]
    raise ValueError(f"no such accumulator: {how}")


class GraphSource(Protocol):
    def edges(self, spark: SparkSession) -> DataFrame: ...


def ids_by_pattern(sites: DataFrame, patterns: list[str], name: str = "name", id_: str = "id") -> DataFrame:
    """Ids of the sites whose name is like one of the patterns (% and _)."""
    test = F.lit(False)
    for p in patterns:
        test = test | F.col(name).like(p)
    return sites.where(test).select(id_).distinct()


EXPORTERS: dict[str, Callable[..., None]] = {}


def exporter(name: str):
    def register(f):
        EXPORTERS[name] = f
        return f

    return register


def export(name: str, *args, **kw) -> None:
    if name not in EXPORTERS:
        raise ValueError(f"no such exporter: {name}")
    EXPORTERS[name](*args, **kw)


def each(values: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(values, f)


def fold(values: Column, start: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, start, f)


def stem(column: Column, name: str) -> Column:
    """Words (an array) stemmed by one of STEMMERS, in Arrow batches."""
    if name not in STEMMERS:
        raise ValueError(f"no such stemmer: {name}")

    @pandas_udf("array<string>")
    def run(words: pd.Series) -> pd.Series:
        f, known = STEMMERS[name], {}
        return words.map(lambda ws: None if ws is None else [known.setdefault(w, None) or known.update({w: f(w)}) or known[w] for w in ws])

    return run(column)
