"""Crawl records in, processed documents, links and exports out."""

from __future__ import annotations

import io
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..storage import saved, swap
from . import CRAWL

PROCESSED = ("doc_id", "url", "domain", "ip", "lang", "title", "text", "n_chars", "features", "quality", "state", "reason")


# ---- archives -------------------------------------------------------------------------------------------------


def warc_records(data: bytes):
    """(fields, block) of the records of a sound archive, gzipped or not; a damaged rest is left out."""
    reader = io.BytesIO(_inflated(data) if data[:2] == b"\x1f\x8b" else data)
    while line := reader.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := reader.readline().strip()):
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        size = fields.get("content-length", "")
        block = reader.read(int(size)) if size.isdigit() else b""
        if not size.isdigit() or len(block) < int(size):
            return
        yield fields, block


def _inflated(data: bytes, piece: int = 1 << 16) -> bytes:
    """The content of all members up to the first that is damaged."""
    out, at, view = bytearray(), 0, memoryview(data)
    while at < len(data):
        z, made = zlib.decompressobj(31), []
        try:
            while not z.eof and at < len(data):
                made.append(z.decompress(view[at : at + piece]))
                at += min(piece, len(data) - at)
        except zlib.error:
            break
        if not z.eof:
            break
        at -= len(z.unused_data)
        out += b"".join(made)
    return bytes(out)


def read_warc(spark: SparkSession, path: str, types: tuple[str, ...] = ("text/html", "application/xhtml+xml", "text/plain")) -> DataFrame:
    """Responses of archives as crawl records (CRAWL), those of the accepted types. A file is read by one task."""

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                out = []
                for fields, block in warc_records(bytes(content)):
                    if fields.get("warc-type") != "response":
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    status, *lines = head.decode("latin-1").split("\r\n")
                    headers = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines))
                    kind = headers.get("content-type", "").split(";")[0].strip().lower()
                    if kind not in types:
                        continue
                    code = status.split(" ")[1] if status.count(" ") else "0"
                    url = fields.get("warc-target-uri", "").strip("<>")
                    domain = url.partition("://")[2].split("/")[0].lower()
                    when = pd.to_datetime(fields.get("warc-date"), errors="coerce", utc=True)
                    out.append((domain, url, fields.get("warc-ip-address"), "set-cookie" in headers, int(code) if code.isdigit() else 0, when.tz_localize(None) if when is not pd.NaT else None, headers.get("content-type", ""), body, 0, "\n".join(lines)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in CRAWL.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, CRAWL)


def sideload(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Documents (url, title, text) of a source that isn't crawled: warc, reddit, text, encyclopedia or html."""
    if kind == "warc":
        crawl = read_warc(spark, path)
        html = F.decode("body", "utf-8")
        return crawl.select("url", tx.title(html, F.col("url")).alias("title"), tx.body_text(html).alias("text"))
    if kind == "reddit":
        return reddit(spark, path)
    if kind == "text":
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("text"))
        return files.select("url", F.regexp_extract("url", "([^/]*)$", 1).alias("title"), "text")
    if kind == "encyclopedia":  # one article a line: title, url, html
        rows = spark.read.schema("title string, url string, html string").json(path)
        return rows.select("url", "title", tx.body_text(F.col("html")).alias("text"))
    if kind == "html":
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
        return files.select("url", tx.title(F.col("html"), F.col("url")).alias("title"), tx.body_text(F.col("html")).alias("text"))
    raise ValueError(f"no such kind of source: {kind}")


def reddit(spark: SparkSession, path: str) -> DataFrame:
    """Submissions and comments of newline JSON as documents; what was deleted is left out."""
    rows = spark.read.schema("id string, title string, selftext string, body string, subreddit string, permalink string, author string, created_utc long, score long").json(path)
    text = F.coalesce("selftext", "body", F.lit(""))
    kept = rows.where(~text.isin("[deleted]", "[removed]") & (F.length(text) > 0))
    return kept.select(F.concat(F.lit("https://old.reddit.com"), "permalink").alias("url"), F.coalesce("title", F.concat(F.lit("/r/"), "subreddit")).alias("title"), text.alias("text"))


# ---- processed documents --------------------------------------------------------------------------------------


def process(crawl: DataFrame, first_id: int = 0) -> DataFrame:
    """Crawl records as processed documents (PROCESSED); ids count on from ``first_id`` in order of URL.

    A live crawl reserves a range of its own by its ``first_id``.
    """
    from ..functions import language
    from ..operators import filters, views

    html = F.decode("body", "utf-8")
    rows = crawl.withColumn("html", html).withColumn("text", tx.body_text(F.col("html")))
    rows = rows.withColumn("lang", language.language(tx.tokens(F.substring("text", 1, 4096)), "en"))
    features = F.when(F.col("cookies"), 1).otherwise(0).bitwiseOR(F.when(F.col("html").rlike("(?i)<script"), 2).otherwise(0)).bitwiseOR(F.when(F.length("text") < 200, 4).otherwise(0))
    reason = filters.disqualified(("STATUS", F.col("http_status") != 200), ("ACCEPTABLE_ADS", filters.asks_for_acceptable_ads(F.col("headers"), F.col("html"))), ("FORBIDDEN", tx.forbids_indexing(F.col("html"))), ("LENGTH", F.length("text") < 32))
    made = rows.select("url", F.col("domain"), "ip", "lang", tx.title(F.col("html"), F.col("url")).alias("title"), "text", F.length("text").alias("n_chars"), features.alias("features"), F.lit(0).alias("quality"), reason.alias("reason"))
    made = made.withColumn("state", F.when(F.col("reason").isNull(), "ok").otherwise("disqualified")).dropDuplicates(["url"])
    return views.numbered(made, "url").withColumn("doc_id", F.col("_number") + F.lit(first_id)).select(*PROCESSED)


def write_processed(documents: DataFrame, links: DataFrame, path: str) -> None:
    """Documents by language, sites and links, each a table of its own."""
    documents = saved(documents, "processed")
    documents.write.partitionBy("lang").parquet(f"{path}/document")
    documents.groupBy("domain").agg(F.count("*").alias("pages"), F.first("ip", ignorenulls=True).alias("ip")).write.parquet(f"{path}/domain")
    links.select("src", "dst").distinct().write.parquet(f"{path}/link")


def all_columns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/document")


def for_index(spark: SparkSession, path: str) -> DataFrame:
    """What the index is built of: the scan reads these columns only."""
    return all_columns(spark, path).where("state = 'ok'").select("doc_id", "text", "lang", F.col("domain").alias("source"), "n_chars", "quality")


def for_display(spark: SparkSession, path: str) -> DataFrame:
    return all_columns(spark, path).where("state = 'ok'").select("doc_id", "url", "title", F.substring("text", 1, 255).alias("description"), "features")


def domain_names(spark: SparkSession, path: str, ip: bool = False) -> DataFrame:
    return spark.read.parquet(f"{path}/domain").select("domain", *(["ip"] if ip else []))


def links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/link")


def append_links(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst").write.mode("append").parquet(path)


def write_details(details: DataFrame, path: str, key: str = "doc_id") -> None:
    """Rows of ids that are stored already are left out."""
    from ..storage import exists

    spark = details.sparkSession
    new = details.dropDuplicates([key])
    if exists(spark, path):
        new = saved(new.join(spark.read.parquet(path).select(key), key, "left_anti"), "details")
    new.write.mode("append").parquet(path)


def details_of(ids: DataFrame, details: DataFrame, key: str = "doc_id") -> DataFrame:
    """Details of the ids that a query found: looked up last, for few rows."""
    return details.join(ids.select(key).distinct(), key, "left_semi")


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes beside the table and puts it in its place when it is whole: readers see the old or the new one."""
    import uuid

    staged = f"{path}.new-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    swap(rows.sparkSession, staged, path)


# ---- dictionaries and exports ---------------------------------------------------------------------------------


def export_term_frequencies(docs: DataFrame, path: str) -> None:
    """(term_id, n) of every term, over all documents, with the number of documents under -1."""
    from ..operators import index

    stats = index.term_stats(docs).select(F.xxhash64("term").alias("term_id"), F.col("df").alias("n"))
    stats.unionByName(docs.agg(F.lit(-1).cast("long").alias("term_id"), F.count("*").alias("n"))).write.parquet(path)


def read_term_frequencies(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(term_id, n) and the number of documents."""
    rows = spark.read.parquet(path)
    return rows.where("term_id <> -1"), rows.where("term_id = -1").first().n


def export_anchors(anchors: DataFrame, path: str) -> None:
    """url, text, source domain as CSV with every field quoted."""
    anchors.select("url", "text", "source").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_feeds(feeds: DataFrame, path: str) -> None:
    feeds.select("domain", "feed_url").distinct().write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def sample_domains(crawl: DataFrame, count: int, seed: int = 1, least: int = 2, most: int = 5000) -> DataFrame:
    """Records of ``count`` domains of ``least`` to ``most`` documents in an order that the seed fixes: the sample is the feature."""
    size = crawl.groupBy("domain").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    return crawl.join(size.orderBy(F.xxhash64(F.lit(seed), F.col("domain")), "domain").limit(count).select("domain"), "domain", "left_semi")


def export_samples(samples: DataFrame, path: str) -> None:
    samples.write.json(path)


def host_of(url):
    return urls.host(url)
