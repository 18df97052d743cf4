"""Readers and writers: driver tables, crawl records, postings, anchor texts, lists, feeds and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls

CRAWL = "domain string, url string, ip string, cookies boolean, http_status short, ts timestamp, content_type string, body binary, request_time_ms short, headers string"
LINK = "source_id int, dest_id int"
ANCHOR = "dest string, url array<string>, text array<string>, cnt array<int>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crawl_of_pages(pages: DataFrame) -> DataFrame:
    """Pages as crawl records."""
    null = lambda t: F.lit(None).cast(t)
    return pages.select(urls.host(F.col("url")).alias("domain"), "url", null("string").alias("ip"), F.lit(False).alias("cookies"), F.lit(200).cast("short").alias("http_status"), null("timestamp").alias("ts"), F.lit("text/html").alias("content_type"), F.col("html").cast("binary").alias("body"), F.lit(0).cast("short").alias("request_time_ms"), null("string").alias("headers"))


def accepted(crawl: DataFrame, types: tuple[str, ...] = ("text/html", "application/xhtml+xml", "text/plain")) -> DataFrame:
    return crawl.where(F.trim(F.substring_index("content_type", ";", 1)).isin(*types))


def anchor_texts(anchors: DataFrame, wanted: DataFrame) -> DataFrame:
    """(dest, url, text, cnt): parallel arrays as rows, of wanted destinations only."""
    own = anchors.join(wanted.select("dest"), "dest", "left_semi")
    return own.select("dest", F.inline(F.arrays_zip("url", "text", "cnt")))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank or comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and value not like '#%'")


def feed_items(json: DataFrame, column: str) -> DataFrame:
    schema = "domain string, feedUrl string, updated string, items array<struct<title:string,date:string,description:string,url:string>>"
    feed = json.select(F.from_json(column, schema).alias("f")).select("f.*")
    return feed.select("domain", "feedUrl", "updated", F.inline("items"))


def write_journal(docs: DataFrame, path: str) -> None:
    """Postings of docs (doc_id, lang, text) by language, as the construction step reads them: terms are hashed to ids."""
    from ..operators import index

    words = index.occurrences(docs.select("doc_id", "lang", F.lit(None).cast("string").alias("source"), "text"))
    rows = words.groupBy("lang", "term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    rows.withColumn("term_id", F.xxhash64("term")).write.partitionBy("lang").parquet(path)


def journal_languages(spark: SparkSession, path: str) -> list[str]:
    """The languages a journal has (its partitions)."""
    return sorted(r.lang for r in spark.read.parquet(path).select("lang").distinct().collect())


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def anchors_of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, href) of the links in pages' HTML."""
    return pages.select("page_id", F.explode(tx.hrefs(F.col("html"))).alias("href"))
