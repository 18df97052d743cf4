"""The registered queries of the engine itself, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import calculator, ids, urls
from .functions import text as tx
from .operators import graph, index, relations, search
from .plans.parse import Spec, expand, parse, paths
from .sources import anchors_of_pages, table
from .storage import Saved, saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOK = r"""WITH w AS (SELECT doc_id, source, lang, n_chars, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents),
occ AS (SELECT doc_id, source, lang, n_chars, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS pos FROM w),
tf AS (SELECT term, doc_id, any_value(source) AS source, any_value(n_chars) AS n_chars, count(*) AS tf FROM occ GROUP BY term, doc_id)
"""
EDGES = "e AS (SELECT DISTINCT o_custkey % 1000 AS src, l_partkey % 1000 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"

WHOLE = "e AS (SELECT DISTINCT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def docs(spark, d):
    return table(spark, d, "documents")


def edges(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    joined = o.join(li, o.o_orderkey == li.l_orderkey)
    return joined.select((F.col("o_custkey") % 1000).alias("src"), (F.col("l_partkey") % 1000).alias("dst")).distinct()


def whole_edges(spark, d):
    """Customers and parts as they are, in one id space: customers even, parts odd."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    joined = o.join(li, o.o_orderkey == li.l_orderkey)
    return joined.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()


# ---- index construction ---------------------------------------------------------------------------------------


@query(TOK + "SELECT term, doc_id, count(*) AS tf, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos FROM occ GROUP BY term, doc_id")
def index_postings(spark, d):
    p = index.postings(docs(spark, d))
    return p.select("term", "doc_id", "tf", F.element_at("positions", 1).cast("long").alias("first_pos"), F.element_at("positions", -1).cast("long").alias("last_pos"))


@query(TOK + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term")
def index_term_stats(spark, d):
    return index.term_stats(docs(spark, d))


@query(TOK + """, m AS (SELECT doc_id, max(tf) AS top FROM tf GROUP BY doc_id), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT tf.doc_id, tf.term, tf.tf, CAST(trunc(-((0.1::DOUBLE + 0.9::DOUBLE * tf.tf / m.top) * ln(greatest(f.df, 1)::DOUBLE / (SELECT count(*) FROM documents)::DOUBLE)) * 75) AS BIGINT) AS value FROM tf JOIN m USING (doc_id) JOIN f USING (term)""")
def index_tfidf(spark, d):
    return index.tfidf(docs(spark, d))


@query(TOK + ", r AS (SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS n FROM tf) SELECT doc_id, term, tf FROM r WHERE n <= 16")
def index_top_terms(spark, d):
    w = Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term")
    return index.term_counts(docs(spark, d)).withColumn("n", F.row_number().over(w)).where("n <= 16").select("doc_id", "term", "tf")


@query(TOK + ", s AS (SELECT source, term, count(*) AS n FROM tf GROUP BY source, term) SELECT source, term, n FROM s JOIN (SELECT source, count(*) AS m FROM documents GROUP BY source) USING (source) WHERE n * 2 > m AND n > 3")
def index_common_site_words(spark, d):
    per = index.occurrences(docs(spark, d)).select("source", "term", "doc_id").distinct().groupBy("source", "term").agg(F.count("*").alias("n"))
    size = docs(spark, d).groupBy("source").agg(F.count("*").alias("m"))
    return per.join(size, "source").where("n * 2 > m and n > 3").select("source", "term", "n")


@query(TOK + "SELECT doc_id, bit_or((1::BIGINT << CAST((pos // 24) % 56 AS INTEGER)) | (1::BIGINT << CAST(((pos + 12) // 24) % 56 AS INTEGER))) AS mask FROM occ WHERE term = 'the' GROUP BY doc_id")
def index_position_mask(spark, d):
    rows = index.occurrences(docs(spark, d)).where("term = 'the'")
    return rows.groupBy("doc_id").agg(F.bit_or(index.position_mask(F.col("pos"))).alias("mask"))


# ---- retrieval ------------------------------------------------------------------------------------------------

HAS = "(SELECT doc_id FROM tf WHERE term = '{}')"


@query(TOK + f"SELECT doc_id FROM documents WHERE doc_id IN {HAS.format('the')} AND doc_id IN {HAS.format('and')} AND doc_id NOT IN {HAS.format('idiot')}")
def search_boolean(spark, d):
    return search.matching(index.postings(docs(spark, d)), parse("the and -idiot"))


@query(SQL["search_boolean"])
def search_semi_anti_joins(spark, d):
    return search.semi_chain(index.postings(docs(spark, d)), parse("the and -idiot"))


@query(TOK + f"SELECT doc_id FROM documents WHERE doc_id IN {HAS.format('the')} AND (doc_id IN {HAS.format('der')} OR doc_id IN {HAS.format('que')} OR doc_id IN {HAS.format('moron')})")
def search_any_of(spark, d):
    return search.matching(index.postings(docs(spark, d)), parse("the"), ("der", "que", "moron"))


@query(TOK + f"SELECT doc_id FROM documents WHERE (doc_id IN {HAS.format('the')} AND doc_id IN {HAS.format('loser')}) OR (doc_id IN {HAS.format('the')} AND doc_id IN {HAS.format('scum')}) OR (doc_id IN {HAS.format('the')} AND doc_id IN {HAS.format('losers')})")
def search_paths(spark, d):
    tree = expand(("the", "loser"), {"loser": "losers"}, set())
    return search.matching_paths(index.postings(docs(spark, d)), [*paths(tree), ("the", "scum")])


@query(TOK + "SELECT a.doc_id, count(*) AS hits, CAST(min(a.pos) AS BIGINT) AS first FROM occ a JOIN occ b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.term = 'the' WHERE a.term = 'of' GROUP BY a.doc_id")
def search_phrase(spark, d):
    return search.phrase(index.postings(docs(spark, d)), ("of", "the"))


@query(TOK + "SELECT a.doc_id, count(*) AS hits, CAST(min(a.pos) AS BIGINT) AS first FROM occ a JOIN occ b ON b.doc_id = a.doc_id AND b.pos = a.pos + 2 AND b.term = 'the' WHERE a.term = 'the' GROUP BY a.doc_id")
def search_phrase_with_hole(spark, d):
    p = index.postings(docs(spark, d)).where("term = 'the'")
    at = search.phrase_starts([(F.col("positions"), 0), (F.col("positions"), 2)])
    return p.select("doc_id", at.alias("at")).where("size(at) > 0").select("doc_id", F.size("at").cast("long").alias("hits"), F.array_min("at").cast("long").alias("first"))


@query(TOK + "SELECT a.doc_id, CAST(min(abs(a.pos - b.pos)) AS BIGINT) AS distance FROM occ a JOIN occ b USING (doc_id) WHERE a.term = 'the' AND b.term = 'moron' GROUP BY a.doc_id")
def search_min_distance(spark, d):
    p = index.postings(docs(spark, d)).where("term in ('the', 'moron')")
    side = lambda t: p.where(F.col("term") == t).select("doc_id", F.col("positions").alias(t))
    return side("the").join(side("moron"), "doc_id").select("doc_id", search.min_distance(F.col("the"), F.col("moron")).cast("long").alias("distance"))


BM25 = """, n AS (SELECT count(*)::DOUBLE AS n FROM documents), f AS (SELECT term, count(*)::DOUBLE AS df FROM tf WHERE term IN ({terms}) GROUP BY term),
ok AS (SELECT doc_id FROM tf WHERE term IN ({terms}) GROUP BY doc_id HAVING count(*) = {k}),
s AS (SELECT doc_id, any_value(source) AS source, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.5::DOUBLE + 0.5::DOUBLE * n_chars / 5000.0::DOUBLE))) AS score FROM tf JOIN f USING (term) JOIN ok USING (doc_id), n GROUP BY doc_id)
"""


@query(TOK + BM25.format(terms="'the', 'of'", k=2) + "SELECT doc_id, round(score, 6) AS score FROM s")
def search_bm25(spark, d):
    x = docs(spark, d)
    return search.score(index.postings(x), x, parse("the of")).select("doc_id", F.round("score", 6).alias("score"))


@query(TOK + BM25.format(terms="'the', 'of'", k=2) + ", b AS (SELECT doc_id, count(*) AS b FROM tf WHERE term IN ('worthless') GROUP BY doc_id) SELECT doc_id, round(score * exp(coalesce(b, 0) / 5.0::DOUBLE), 6) AS score FROM s LEFT JOIN b USING (doc_id)")
def search_boosted(spark, d):
    x = docs(spark, d)
    return search.score(index.postings(x), x, parse("the of ?worthless")).select("doc_id", F.round("score", 6).alias("score"))


@query(TOK + BM25.format(terms="'the', 'of'", k=2) + ", r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS p, count(*) OVER (PARTITION BY source) AS seen FROM s) SELECT doc_id, source, round(score, 6) AS score, seen FROM r WHERE p <= 2 ORDER BY r.score DESC, doc_id LIMIT 20")
def search_top_with_cap(spark, d):
    x = docs(spark, d)
    s = search.score(index.postings(x), x, parse("the of")).join(x.select("doc_id", "source"), "doc_id")
    return search.top(s, "source", 20, 2).select("doc_id", "source", F.round("score", 6).alias("score"), "seen")


@query(TOK + f"SELECT doc_id FROM documents WHERE doc_id IN {HAS.format('the')} ORDER BY doc_id LIMIT 100")
def search_unranked_page(spark, d):
    return search.after(search.matching(index.postings(docs(spark, d)), parse("the")), "doc_id", None, 100)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, d):
    return search.after(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 50)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark, d):
    return search.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 20)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE year(l_shipdate) >= 1995 AND year(l_shipdate) <= 1996 AND l_quantity <= 10")
def metadata_limits(spark, d):
    spec = Spec(limits=(("year", ">", 1995), ("year", "<", 1996), ("size", "<", 10)))
    ok = search.limits(spec, {"year": F.year("l_shipdate"), "size": F.col("l_quantity")})
    return table(spark, d, "lineitem").where(ok).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def distinct_content(spark, d):
    return search.distinct_content(docs(spark, d), F.md5(F.col("text").cast("binary")), [F.asc("doc_id")]).select("doc_id")


@query(None)
def near_copies_simhash(spark, d):
    words = docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("words"))
    grams = words.select("doc_id", F.explode_outer(tx.rolling_hash(F.col("words"), 2)).alias("h"))
    own = grams.groupBy("doc_id").agg(*relations.simhash_votes("h"))
    # a document of fewer than two words has no shingle to compare, and is a class of its own
    hashes = own.select("doc_id", relations.simhash_of_votes().alias("simhash"), F.when(F.col("v0").isNotNull(), relations.simhash_of_votes()).alias("h"))
    hashes = saved(hashes, "simhash")
    links = Saved(relations.close_hashes(hashes.select("h"), 3).toDF("src", "dst"), "links")  # read twice
    classes = graph.classes(links.df).toDF("h", "c")
    links.drop()
    of = hashes.join(classes.hint("merge"), "h", "left").withColumn("c", F.coalesce("c", "h"))
    least = of.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    return of.join(least.hint("merge"), "c", "left").select("doc_id", "simhash", F.coalesce("least", "doc_id").alias("class_id"))


# ---- pages and URLs -------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages),
q AS (SELECT page_id, host, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM p)
SELECT page_id, host, path, CAST(length(path) - length(replace(path, '/', '')) AS BIGINT) AS depth, regexp_replace(path, '[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS file,
regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS top, regexp_extract(regexp_extract(host, '([^.]+\.[^.]+)$', 1), '\.(.*)$', 1) AS tld FROM q""")
def page_urls(spark, d):
    u, h = F.col("url"), urls.host(F.col("url"))
    return table(spark, d, "pages").select("page_id", h.alias("host"), urls.path(u).alias("path"), urls.depth(u).alias("depth"), urls.directory(u).alias("dir"), urls.file_name(u).alias("file"), urls.top_domain(h).alias("top"), urls.tld(h).alias("tld"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), url) AS title FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", tx.title(F.col("html"), F.col("url")).alias("title"))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id, href")
def page_links(spark, d):
    return anchors_of_pages(table(spark, d, "pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(r"SELECT regexp_extract(url, '://([^/:?#]*)', 1) AS host, count(*) AS n, CAST(max(length(html)) AS BIGINT) AS longest FROM pages GROUP BY 1")
def pages_per_host(spark, d):
    return table(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.max(F.length("html")).cast("long").alias("longest"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS BIGINT) AS mails FROM documents")
def mail_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.size(tx.mail_parts(F.col("text"))).cast("long").alias("mails"))


# ---- identifiers ----------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, (CAST(l_linenumber AS BIGINT) << 57) | (l_suppkey << 26) | l_partkey AS packed, l_suppkey AS domain, l_partkey AS ordinal FROM lineitem")
def combined_ids(spark, d):
    e = ids.encode_id(F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", e.alias("packed"), ids.domain_of(e).alias("domain"), ids.ordinal_of(e).alias("ordinal"))


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(255, year(l_shipdate) - 1996)) + 1996 AS BIGINT) AS year, CAST(least(15, CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS quality FROM lineitem")
def document_metadata(spark, d):
    m = ids.encode_metadata(year=ids.year_byte(F.year("l_shipdate")), quality=F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ids.field(m, "year").alias("year"), ids.field(m, "quality").alias("quality"))


@query("SELECT o_orderkey, CAST(greatest(1, least(32767, date_diff('day', DATE '1989-03-12', CAST(o_orderdate AS DATE)))) AS BIGINT) AS day FROM orders")
def compact_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ids.date_short(F.col("o_orderdate").cast("date")).cast("long").alias("day"))


# ---- graphs ---------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES}, o AS (SELECT src AS node, count(*) AS n_out FROM e GROUP BY src), i AS (SELECT dst AS node, count(*) AS n_in FROM e GROUP BY dst) SELECT node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i USING (node)")
def graph_degrees(spark, d):
    return graph.degrees(edges(spark, d))


@query(f"""WITH {EDGES}, o AS (SELECT src, count(*) AS m FROM e GROUP BY src), i AS (SELECT dst AS src, count(*) AS n FROM e GROUP BY dst),
w AS (SELECT e.src, e.dst, o.m, 1 / ln(2.0::DOUBLE + coalesce(i.n, 0)) AS w FROM e JOIN o USING (src) LEFT JOIN i USING (src)), s AS (SELECT dst, sum(w) AS s FROM w GROUP BY dst),
c AS (SELECT a.dst AS a, b.dst AS b, sum(a.w) AS c FROM w a JOIN w b ON a.src = b.src AND a.dst < b.dst WHERE a.m <= 1000 AND b.m <= 1000 GROUP BY a.dst, b.dst)
SELECT a, b, round(c / sqrt(x.s * y.s), 6) AS value FROM c JOIN s x ON x.dst = a JOIN s y ON y.dst = b WHERE c / sqrt(x.s * y.s) >= 0.1""")
def graph_similarity(spark, d):
    return graph.similarity(edges(spark, d)).select("a", "b", F.round("value", 6).alias("value"))


@query(f"""WITH {EDGES}, n AS (SELECT dst, count(*) AS n FROM e GROUP BY dst), ok AS (SELECT src FROM e GROUP BY src HAVING count(*) <= 1000),
f AS (SELECT e.* FROM e JOIN n USING (dst) JOIN ok USING (src) WHERE n.n >= 4), c AS (SELECT a.dst AS a, b.dst AS b, count(*) AS common FROM f a JOIN f b ON a.src = b.src AND a.dst < b.dst GROUP BY a.dst, b.dst)
SELECT a, b, common, round(common::DOUBLE / (x.n + y.n - common), 6) AS value FROM c JOIN n x ON x.dst = a JOIN n y ON y.dst = b WHERE greatest(x.n, y.n) <= 9 * least(x.n, y.n) AND common::DOUBLE / (x.n + y.n - common) >= 0.1""")
def graph_jaccard(spark, d):
    return graph.jaccard(edges(spark, d)).select("a", "b", "common", F.round("value", 6).alias("value"))


_RANK = "SELECT nd.node, 0.15::DOUBLE / (SELECT count(*) FROM nd) + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(score), 0) FROM {p} WHERE node NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM nd)) AS score FROM nd LEFT JOIN (SELECT dst AS node, sum({p}.score / o.n) AS got FROM e JOIN {p} ON {p}.node = e.src JOIN o ON o.src = e.src GROUP BY dst) g USING (node)"


@query(f"WITH {EDGES}, nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS n FROM e GROUP BY src), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS score FROM nd), r1 AS ({_RANK.format(p='r0')}), r2 AS ({_RANK.format(p='r1')}), r3 AS ({_RANK.format(p='r2')}) SELECT node, round(score, 9) AS score FROM r3")
def graph_pagerank(spark, d):
    return graph.pagerank(edges(spark, d), fixed=3).select("node", F.round("score", 9).alias("score"))


@query(f"""WITH {EDGES}, nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e), core AS (SELECT node FROM nd WHERE node < 20),
t AS (SELECT dst AS node, count(*) AS r FROM e WHERE src IN (SELECT node FROM core) GROUP BY dst), k AS (SELECT src AS node, count(*) AS k FROM e WHERE dst IN (SELECT node FROM core) GROUP BY src)
SELECT node, CASE WHEN node IN (SELECT node FROM core) THEN 'core' WHEN r >= 5 AND k >= 5 THEN 'bidi_hot' WHEN r > 0 AND k > 0 THEN 'bidi' WHEN r >= 5 THEN 'reachable_hot' WHEN r > 0 THEN 'reachable' WHEN k >= 5 THEN 'linking_hot' WHEN k > 0 THEN 'linking' ELSE 'unreachable' END AS class
FROM nd LEFT JOIN t USING (node) LEFT JOIN k USING (node)""")
def graph_connectivity(spark, d):
    e = edges(spark, d)
    core = e.select(F.col("src").alias("node")).union(e.select("dst")).where("node < 20")
    return graph.connectivity(e, core)


@query(f"WITH {EDGES} SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e")
def graph_symmetric(spark, d):
    return graph.symmetric(edges(spark, d)).toDF("a", "b")


# The same on whole ids; those above are on ids folded to 1,000, as their SQL has them.


@query(SQL["graph_degrees"].replace(EDGES, WHOLE))
def graph_whole_degrees(spark, d):
    return graph.degrees(whole_edges(spark, d))


@query(SQL["graph_similarity"].replace(EDGES, WHOLE))
def graph_whole_similarity(spark, d):
    return graph.similarity(whole_edges(spark, d)).select("a", "b", F.round("value", 6).alias("value"))


@query(SQL["graph_jaccard"].replace(EDGES, WHOLE))
def graph_whole_jaccard(spark, d):
    return graph.jaccard(whole_edges(spark, d)).select("a", "b", "common", F.round("value", 6).alias("value"))


@query(SQL["graph_connectivity"].replace(EDGES, WHOLE).replace("node < 20", "node < 40"))
def graph_whole_connectivity(spark, d):
    e = whole_edges(spark, d)
    core = e.select(F.col("src").alias("node")).union(e.select("dst")).where("node < 40")  # customers and parts below 20
    return graph.connectivity(e, core)


@query(SQL["graph_symmetric"].replace(EDGES, WHOLE))
def graph_whole_symmetric(spark, d):
    return graph.symmetric(whole_edges(spark, d)).toDF("a", "b")


@query(None)
def graph_whole_pagerank(spark, d):
    return graph.pagerank(whole_edges(spark, d), relative=True)


# ---- sets -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersection(spark, d):
    return docs(spark, d).where("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    return docs(spark, d).where("lang = 'en'").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars < 500")
def set_union(spark, d):
    return table(spark, d, "labels").where("toxic = 1").select("doc_id").union(docs(spark, d).where("n_chars < 500").select("doc_id")).distinct()


# ---- relations ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name, r_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def domain_info(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").join(o, "c_custkey", "left")
    return j.select("c_custkey", "n_name", "r_name", F.coalesce("has", F.lit(False)).alias("has_orders"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def blacklist(spark, d):
    bad = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(bad, "c_nationkey", "left_anti").select("c_custkey")


@query("SELECT e.event_id, (SELECT max_by(o_orderpriority, o_orderkey) FROM orders WHERE o_orderkey <= e.event_id) AS found FROM events e")
def floor_lookup(spark, d):
    r = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("found"))
    return relations.floor_lookup(table(spark, d, "events").select("event_id"), "event_id", r, "o_orderkey", "found")


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS st, lag(CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, event_id, b AS before, st AS after FROM s WHERE b <> st""")
def availability_changes(spark, d):
    state = F.when(F.col("event_type") == "error", "down").otherwise("up")
    return relations.changes(table(spark, d, "events"), "user_id", ["ts", "event_id"], state).select("user_id", "event_id", "before", "after")


@query("""WITH o AS (SELECT user_id, event_id, event_type = 'view' AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM o WHERE f)
SELECT user_id, CAST(min(i) AS BIGINT) AS start, CAST(max(i) + 1 AS BIGINT) AS "end", count(*) AS n FROM g GROUP BY user_id, g""")
def span_islands(spark, d):
    s = index.islands(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "view")
    return s.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_write_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return relations.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def newest_items(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 10").select("user_id", "event_id", "ts")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def feed_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling_window(spark, d):
    w = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.col("w.start").alias("start"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT p_partkey, round(p_size * 2.54::DOUBLE, 6) AS cm, round(sqrt(p_retailprice), 6) AS root FROM part")
def unit_and_math(spark, d):
    ratio = calculator.UNITS["in"][1] / calculator.UNITS["cm"][1]
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_size") * ratio, 6).alias("cm"), F.round(F.sqrt("p_retailprice"), 6).alias("root"))


@query(TOK + "SELECT term AS word, count(*) AS n, CAST(levenshtein(term, 'stupit') AS BIGINT) AS distance FROM occ GROUP BY term HAVING levenshtein(term, 'stupit') <= 2 ORDER BY 3, 2 DESC, 1 LIMIT 10")
def spell_check(spark, d):
    words = index.term_stats(docs(spark, d)).select(F.col("term").alias("word"), F.col("cf").alias("n"))
    return calculator.spelling(words, "stupit")
