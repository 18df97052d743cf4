"""Index construction: postings with positions, term statistics, spans and weights.

Stored by write_index() in partitions of a term's hash, sorted by term and document, so that a query's few terms prune
to few files and row groups, and later joins on the document need only the matching rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

TERM_PARTS = 64


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, pos, term): 1-based positions; every token takes one."""
    words = docs.select("doc_id", "lang", "source", F.posexplode(tx.tokens(F.col("text"))).alias("p", "term"))
    return words.select("doc_id", "lang", "source", (F.col("p") + 1).alias("pos"), "term")


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions)."""
    return occurrences(docs).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_counts(docs: DataFrame) -> DataFrame:
    return occurrences(docs).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, cf): exact document and collection frequencies; counts are combined before the shuffle."""
    return term_counts(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def counted_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, top): top is the document's greatest count.

    Texts are dealt by document once; both counts then happen where the document is.
    """
    own = docs.select("doc_id", "text").repartition("doc_id")
    words = own.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    counts = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return counts.withColumn("top", F.max("tf").over(Window.partitionBy("doc_id")))


def tfidf(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, value): (0.1 + 0.9 tf / max tf) ln(max(df, 1) / N), times -75, as an integer."""
    counts = counted_terms(docs)
    n = docs.agg(F.count("*").alias("n_docs"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    v = (0.1 + 0.9 * F.col("tf") / F.col("top")) * F.log(F.greatest(F.col("df"), F.lit(1)) / F.col("n_docs"))
    joined = counts.join(df, "term").join(F.broadcast(n))  # n: one row
    return joined.select("doc_id", "term", "tf", (-v * 75).cast("int").cast("long").alias("value"))


def position_mask(pos: F.Column, width: int = 24) -> F.Column:
    """Bits of 56 for the window a position is in and for the one that it is in half a window on, so that neighbours share one."""
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), ((p / width).cast("int") % 56))
    return bit(pos).bitwiseOR(bit(pos + width // 2))


def site_terms(docs: DataFrame, site: str = "source") -> DataFrame:
    """(doc_id, term): site: terms of a document's site and of all domains above it, and tld:."""
    labels = F.split(F.lower(site), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("site:"), F.array_join(F.slice(labels, i, 64), ".")))
    last = F.concat(F.lit("tld:"), F.element_at(labels, -1))
    return docs.where(F.col(site).isNotNull()).select("doc_id", F.explode(F.array_append(above, last)).alias("term"))


def write_index(docs: DataFrame, path: str, terms: DataFrame | None = None, parts: int = TERM_PARTS) -> None:
    """Writes postings, document rows and term statistics of docs; ``terms`` (doc_id, term) are added without positions."""
    made = site_terms(docs) if "source" in docs.columns else None
    if terms is not None:
        made = terms.select("doc_id", "term") if made is None else made.unionByName(terms.select("doc_id", "term"))
    rows = postings(docs)
    if made is not None:
        rows = rows.unionByName(made.distinct().select("term", "doc_id", F.lit(0).cast("long").alias("tf"), F.array().cast("array<int>").alias("positions")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    rows.repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("term", "doc_id").write.partitionBy("part").parquet(f"{path}/posting")
    docs.drop("text").write.parquet(f"{path}/doc")
    docs.sparkSession.createDataFrame([(parts,)], "parts int").coalesce(1).write.parquet(f"{path}/layout")


def read_postings(spark, path: str, terms: list[str]) -> DataFrame:
    n = spark.read.parquet(f"{path}/layout").first().parts
    parts = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(n)).alias("p")).distinct().collect()
    return spark.read.parquet(f"{path}/posting").where(F.col("part").isin([r.p for r in parts]) & F.col("term").isin(terms))


def forward(docs: DataFrame) -> DataFrame:
    """docs without texts, by document: what is looked up for the documents that a query finds."""
    return docs.drop("text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")


def islands(rows: DataFrame, key: str, order: str, on: F.Column) -> DataFrame:
    """(key, start, end, n): the longest runs of consecutive rows of a key on which a condition holds."""
    w = Window.partitionBy(key).orderBy(order)
    both = rows.select(key, order, on.alias("on"), F.row_number().over(w).alias("i"))
    held = both.where("on").withColumn("g", F.col("i") - F.row_number().over(w))
    return held.groupBy(key, "g").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.count("*").alias("n")).drop("g")
