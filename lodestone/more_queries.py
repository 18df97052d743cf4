"""Registered queries of keywords and score parts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as tx
from .functions import feeds, urls
from .operators import index, keywords, scoring, search
from .plans.parse import parse
from .queries import HAS, TOK, docs, query, table

TITLE = "title AS (SELECT DISTINCT doc_id, term FROM occ WHERE pos <= 8)"
VALUES = """m AS (SELECT doc_id, max(tf) AS top FROM tf GROUP BY doc_id), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
v AS (SELECT tf.doc_id, tf.term, tf.tf, CAST(trunc(-((0.1::DOUBLE + 0.9::DOUBLE * tf.tf / m.top) * ln(greatest(f.df, 1)::DOUBLE / (SELECT count(*) FROM documents)::DOUBLE)) * 75) AS BIGINT) AS value FROM tf JOIN m USING (doc_id) JOIN f USING (term)),
heavy AS (SELECT doc_id, term FROM v WHERE tf > 1 AND value > 100)"""
FLAGGED = f"""{TITLE}, {VALUES}, flagged AS (SELECT doc_id, term, CAST(bit_or(b) AS INTEGER) AS flags FROM (SELECT doc_id, term, 1 AS b FROM title UNION ALL SELECT doc_id, term, 2 FROM heavy) GROUP BY doc_id, term)"""


def flagged(spark, d):
    x = docs(spark, d)
    return keywords.assemble({"title": keywords.title_words(x), "subjects": keywords.tfidf_words(x)})


@query(TOK + f", {VALUES} SELECT doc_id, term FROM heavy")
def keywords_tfidf(spark, d):
    return keywords.tfidf_words(docs(spark, d))


@query(TOK + f", {FLAGGED} SELECT * FROM flagged")
def keywords_flags(spark, d):
    return flagged(spark, d)


@query(TOK + f", {FLAGGED} SELECT term, count(*) AS df FROM flagged WHERE flags & 135 <> 0 GROUP BY term")
def index_priority_terms(spark, d):
    return keywords.priority(flagged(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@query(TOK + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term")
def index_merged_parts(spark, d):
    x = docs(spark, d)
    return keywords.merge(index.term_stats(x.where("lang = 'en'")), index.term_stats(x.where("lang <> 'en' or lang is null")))


@query(TOK + "SELECT term, count(*) * 5 AS df FROM tf WHERE substring(md5(CAST(doc_id AS VARCHAR)), 1, 2) < '33' GROUP BY term")
def index_sampled_frequencies(spark, d):
    picked = docs(spark, d).where(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 2) < "33")
    return index.term_counts(picked).groupBy("term").agg((F.count("*") * 5).alias("df"))


@query("SELECT l_orderkey, n, CAST(sum(n) OVER (ORDER BY l_orderkey) - n AS BIGINT) AS start FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def index_offsets(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return keywords.offsets(counts, "l_orderkey", "n")


URL_WORDS = r"""u AS (SELECT page_id, length(html) AS size, list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '[?#].*$', '')), '[a-z0-9]+'), lambda w: w <> 'www') AS ws FROM pages),
uw AS (SELECT page_id, size, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS i FROM u)"""


@query(f"WITH {URL_WORDS} SELECT page_id, term, CAST(size + 2 + i AS BIGINT) AS pos FROM uw WHERE term NOT IN ('com', 'net', 'org')")
def keywords_url(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.length("html").alias("size"))
    return keywords.url_positions(pages, F.col("size"), F.col("url")).select("page_id", "term", F.col("pos").cast("long").alias("pos"))


def _tag(tag: str, pattern: str) -> str:
    return rf"""SELECT page_id, '{tag}' AS tag, unnest(regexp_extract_all(lower(regexp_replace(array_to_string(regexp_extract_all(html, '(?is)<({pattern})\b[^>]*>(.*?)</({pattern})>', 2), ' '), '(?s)<[^>]*>', ' ', 'g')), '[a-z0-9]+')) AS term FROM pages"""


TAGGED = "tw AS (" + " UNION ALL ".join(_tag(k, v) for k, v in keywords.TAGS.items()) + ")"


@query(f"WITH {TAGGED} SELECT page_id, term, tag, count(*) AS n FROM tw GROUP BY page_id, term, tag")
def page_tag_words(spark, d):
    return keywords.tagged_counts(table(spark, d, "pages"))


@query(f"WITH {TAGGED} SELECT page_id, term, round(sum(CASE tag WHEN 'title' THEN 2.5 WHEN 'heading' THEN 1.25 WHEN 'anchor' THEN 0.2 WHEN 'nav' THEN 0.1 ELSE 0.25 END::DOUBLE), 6) AS weight FROM tw GROUP BY page_id, term")
def score_tag_weights(spark, d):
    rows = keywords.tagged_counts(table(spark, d, "pages"))
    return rows.groupBy("page_id", "term").agg(F.round(F.sum(scoring.tag_weight(F.col("tag")) * F.col("n")), 6).alias("weight"))


@query("SELECT href, count(*) AS links, CAST(greatest(1, least(floor(sqrt(count(*))), 12)) AS BIGINT) AS repeats FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY href")
def anchor_counts(spark, d):
    links = table(spark, d, "pages").select(F.explode(tx.hrefs(F.col("html"))).alias("href"))
    return links.groupBy("href").agg(F.count("*").alias("links")).withColumn("repeats", keywords.repeats(F.col("links")))


LEX = r"""WITH t AS (SELECT page_id, regexp_extract_all(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '[a-z0-9]+') AS ws FROM pages),
b AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents),
g AS (SELECT 1 AS title, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1])) AS gram FROM t UNION ALL SELECT 0, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1])) FROM b)
SELECT gram, count(*) AS seen FROM g GROUP BY gram HAVING max(title) = 1"""


@query(LEX)
def ngram_lexicon(spark, d):
    titles = table(spark, d, "pages").select(tx.tokens(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("words"))
    return keywords.lexicon(titles, docs(spark, d).select(tx.tokens(F.col("text")).alias("words")))


@query("SELECT doc_id, source, sum(coalesce(toxic, 0)) OVER (PARTITION BY source) >= 10 AS flagged FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)")
def flagged_sources(spark, d):
    x = docs(spark, d).select("doc_id", "source")
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    per = x.join(marks, "doc_id").groupBy("source").agg((F.sum("toxic") >= 10).alias("flagged"))
    per = per.withColumnRenamed("source", "s")
    return x.join(per, F.col("source").eqNullSafe(F.col("s")), "left").select("doc_id", "source", F.coalesce("flagged", F.lit(False)).alias("flagged"))


@query(TOK + f", {FLAGGED}, p AS (SELECT term, count(*)::DOUBLE AS df FROM flagged GROUP BY term) SELECT doc_id, term, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * c * 2.2::DOUBLE / (c + 1.2::DOUBLE), 6) AS score FROM (SELECT *, 1.5::DOUBLE + CASE WHEN flags & 2 = 2 AND tf > 2 THEN 1.25 ELSE 0 END AS c FROM flagged JOIN tf USING (doc_id, term)) JOIN p USING (term) WHERE flags & 1 = 1")
def score_flags(spark, d):
    rows = flagged(spark, d)
    n = docs(spark, d).agg(F.count("*").alias("n_docs"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    counts = index.term_counts(docs(spark, d))
    made = rows.where(scoring.has(F.col("flags"), "title")).join(counts, ["doc_id", "term"]).join(df, "term").join(F.broadcast(n))  # n: one row
    return made.select("doc_id", "term", F.round(scoring.flag_bm25(scoring.flag_count(F.col("flags"), F.col("tf")), F.col("df"), F.col("n_docs")), 6).alias("score"))


@query(TOK + f"SELECT doc_id, round(1 / sqrt(max(first)::DOUBLE), 6) AS score FROM (SELECT doc_id, term, min(pos) AS first FROM occ WHERE term IN ('the', 'of') GROUP BY doc_id, term) WHERE doc_id IN {HAS.format('the')} AND doc_id IN {HAS.format('of')} GROUP BY doc_id")
def score_first_position(spark, d):
    p = index.postings(docs(spark, d))
    first = p.where("term in ('the', 'of')").select("doc_id", F.element_at("positions", 1).alias("first"))
    ids = search.matching(p, parse("the of"))
    return first.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("first").alias("first")).select("doc_id", F.round(scoring.first_position(F.col("first")), 6).alias("score"))


@query(TOK + "SELECT doc_id, round(CASE WHEN x > 0 AND x < 10 THEN 2 / (0.1::DOUBLE + sqrt(x)) ELSE 0 END, 6) AS score FROM (SELECT a.doc_id, min(abs(a.pos - b.pos)) AS x FROM occ a JOIN occ b USING (doc_id) WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id)")
def score_proximity(spark, d):
    p = index.postings(docs(spark, d)).where("term in ('the', 'of')")
    wide = p.groupBy("doc_id").agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(t) for t in ("the", "of")]).where("the is not null and of is not null")
    return wide.select("doc_id", F.round(scoring.proximity(search.min_distance(F.col("of"), F.col("the")), 2), 6).alias("score"))


@query(TOK + "SELECT doc_id, bit_or(1::BIGINT << least(CAST(floor(sqrt(pos)) AS INTEGER), 55)) AS mask FROM occ WHERE term = 'the' GROUP BY doc_id")
def score_display_mask(spark, d):
    return index.postings(docs(spark, d)).where("term = 'the'").select("doc_id", scoring.display_mask(F.col("positions")).alias("mask"))


@query("SELECT o_orderkey, round(sqrt((501 + 20 * abs(year(o_orderdate) - 1998) * 0.5::DOUBLE) / (1 + o_totalprice)), 6) AS score FROM orders")
def score_final(spark, d):
    bias = scoring.temporal_bias(F.year("o_orderdate"), 1998, 0.5)  # its negative part is the penalty
    return table(spark, d, "orders").select("o_orderkey", F.round(search.final_score(F.col("o_totalprice"), -bias), 6).alias("score"))


@query(r"SELECT page_id, regexp_extract(url, '://([^/:?#]*)', 1) AS host FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/?#]*/?([?#].*)?$')")
def root_pages(spark, d):
    return table(spark, d, "pages").where(urls.path(F.col("url")) == "/").select("page_id", urls.host(F.col("url")).alias("host"))


@query(r"""WITH l AS (SELECT page_id, url, trim(regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '#.*$', '')) AS h FROM pages),
r AS (SELECT page_id, url, h, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS dir FROM l)
SELECT page_id, CASE WHEN h LIKE 'http%' THEN h WHEN h LIKE '/%' THEN root || h WHEN h = '' THEN regexp_replace(url, '#.*$', '') ELSE root || dir || h END AS target, count(*) AS n FROM r GROUP BY ALL""")
def page_targets(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html", feeds.resolve(feeds.base(F.col("html"), F.col("url")), F.col("url")).alias("url"))
    links = pages.select("page_id", "url", F.explode(tx.hrefs(F.col("html"))).alias("href"))
    return links.select("page_id", feeds.resolve(F.col("href"), F.col("url")).alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("n"))
