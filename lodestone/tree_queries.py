"""Registered queries of trees over terms, assembled keywords, ranges, unions of nodes and closeness, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import index, keywords, scoring, search
from .plans.parse import parse
from .plugins import fold
from .queries import HAS, SQL, TOK, docs, query, table
from .score_queries import SEQ, _hits, hits, sequences, spans

PATHS = [("the", "of"), ("der", "die"), ("que",)]
_PATH = "(SELECT doc_id, {how}(tf) AS v FROM tf WHERE term IN ({terms}) GROUP BY doc_id HAVING count(*) = {n})"


def _paths(how: str) -> str:
    return " UNION ALL ".join("SELECT * FROM " + _PATH.format(how=how, terms=", ".join(f"'{t}'" for t in p), n=len(p)) for p in PATHS)


@query(TOK + f"SELECT doc_id, CAST(max(v) AS BIGINT) AS value FROM ({_paths('min')}) GROUP BY doc_id")
def tree_max_min(spark, d):
    return search.tree_value(index.postings(docs(spark, d)), PATHS, F.col("tf"), "min")


@query(TOK + f"SELECT doc_id, CAST(max(v) AS BIGINT) AS value FROM ({_paths('sum')}) GROUP BY doc_id")
def tree_max_sum(spark, d):
    return search.tree_value(index.postings(docs(spark, d)), PATHS, F.col("tf"), "sum")


@query(TOK + f"SELECT doc_id FROM documents WHERE doc_id IN {HAS.format('the')} AND ((doc_id >= 20 AND doc_id < 120) OR (doc_id >= 300 AND doc_id < 700))")
def search_in_ranges(spark, d):
    """The ranges reach the scan of documents, before texts are split."""
    some = docs(spark, d).where("(doc_id >= 20 and doc_id < 120) or (doc_id >= 300 and doc_id < 700)")
    return search.matching(index.postings(some), parse("the"))


@query(SQL["search_top_with_cap"])
def search_merged_nodes(spark, d):
    """Each of four nodes scores its documents with the statistics of all and keeps its best; the bests are merged and cut again."""
    x = docs(spark, d)
    scored = search.score(index.postings(x), x, parse("the of")).join(x.select("doc_id", "source"), "doc_id")
    seen = scored.groupBy("source").agg(F.count("*").alias("_seen"))
    nodes = [search.top(scored.where(F.col("doc_id") % 4 == i), "source", 20, 2).drop("seen") for i in range(4)]
    best = search.top(reduce(DataFrame.unionByName, nodes), "source", 20, 2).drop("seen").join(seen, "source")
    return best.select("doc_id", "source", F.round("score", 6).alias("score"), F.col("_seen").alias("seen"))


@query(TOK + "SELECT term, doc_id, CAST(least(count(*), 512) AS BIGINT) AS n, bit_or((1::BIGINT << CAST((pos // 24) % 56 AS INTEGER)) | (1::BIGINT << CAST(((pos + 12) // 24) % 56 AS INTEGER))) AS mask FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY pos) AS r FROM occ) WHERE r <= 512 GROUP BY term, doc_id")
def index_assembled(spark, d):
    return keywords.capped(index.postings(docs(spark, d))).select("term", "doc_id", F.size("positions").cast("long").alias("n"), "mask")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def index_forward(spark, d):
    return index.forward(docs(spark, d)).select("doc_id", "lang", "source", "n_chars")


@query("SELECT l_orderkey, CAST(sum(l_linenumber * l_linenumber) AS BIGINT) AS folded FROM lineitem GROUP BY l_orderkey")
def array_fold(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("x"))
    return rows.select("l_orderkey", fold(F.col("x"), F.lit(0).cast("long"), lambda a, x: a + x * x).alias("folded"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS mail FROM documents),
p AS (SELECT doc_id, lower(mail) AS mail, regexp_extract(lower(mail), '^([^@]*)@', 1) AS u, regexp_extract(lower(mail), '@(.*)$', 1) AS h FROM m)
SELECT doc_id, term FROM (SELECT doc_id, unnest([mail, '@' || h, CASE WHEN h NOT IN ('hotmail.com', 'gmail.com', 'outlook.com', 'yahoo.com') THEN h END, CASE WHEN u NOT IN ('info', 'webmaster', 'admin', 'mail', 'contact') THEN u END]) AS term FROM p) WHERE term IS NOT NULL GROUP BY doc_id, term""")
def keywords_artifacts(spark, d):
    return docs(spark, d).select("doc_id", F.explode(keywords.mail_terms(F.col("text"))).alias("term")).distinct()


@query(f"""WITH {SEQ}, x AS (SELECT *, {_hits('of', 'the')} AS ats, len(list_filter(t, lambda a: a = 'of')) + len(list_filter(t, lambda a: a = 'the')) AS it, len(list_filter(h, lambda a: a = 'of')) + len(list_filter(h, lambda a: a = 'the')) AS ih FROM s JOIN (SELECT page_id, t, h FROM p) USING (page_id))
SELECT page_id, round(CASE WHEN len(list_filter(ats, lambda i: i + 2 <= nt + 1)) = 0 AND it = 2 THEN it * (2.5 + 2.0::DOUBLE / greatest(1, nt)) ELSE 0 END + CASE WHEN nh < 64 AND len(list_filter(ats, lambda i: i >= nt + 1 AND i + 2 <= nt + nh + 1)) = 0 AND ih = 2 THEN ih ELSE 0 END, 6)::DOUBLE AS score FROM x""")
def score_proximity_factor(spark, d):
    at = spans()
    count = lambda t: scoring.hits_in(at[t], hits("of"), 1) + scoring.hits_in(at[t], hits("the"), 1)
    both = hits("of", "the")
    whole = {t: scoring.hits_in(at[t], both, 2) > 0 for t in ("title", "heading")}
    made = scoring.proximity_factor(F.lit(None).cast("int"), 2, count("title"), count("heading"), 2, whole["title"], whole["heading"], scoring.span_length(at["title"]), scoring.span_length(at["heading"]))
    return sequences(spark, d).select("page_id", F.round(made, 6).alias("score"))


LINKS = r"""a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text FROM pages), c AS (SELECT page_id, lower(text) AS text, count(*) AS n FROM a GROUP BY ALL), w AS (SELECT page_id, text, n, regexp_extract_all(text, '[a-z0-9]+') AS ws FROM c),
k AS (SELECT page_id, ws, CAST(greatest(1, least(floor(sqrt(n)), 12)) AS BIGINT) AS r, text FROM w WHERE len(ws) > 0), o AS (SELECT *, sum((len(ws) + 2) * r) OVER (PARTITION BY page_id ORDER BY text) - (len(ws) + 2) * r AS off FROM k)"""


@query(f"WITH {LINKS}, z AS (SELECT page_id, ws, off, unnest(range(0, r)) AS i FROM o) SELECT page_id, term, CAST(off + i * (n + 2) + 2 + j AS BIGINT) AS pos FROM (SELECT page_id, off, i, len(ws) AS n, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS j FROM z)")
def keywords_link_positions(spark, d):
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    texts = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", pattern, 2)).alias("text"))
    counts = texts.groupBy("page_id", F.lower("text").alias("text")).agg(F.count("*").alias("n"))
    return keywords.link_positions(counts, "page_id", "text", "n").select("page_id", "term", "pos")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_name LIKE '%00001' OR c_name LIKE '%_0007'")
def sites_by_pattern(spark, d):
    from .plugins import ids_by_pattern

    c = table(spark, d, "customer")
    ids = ids_by_pattern(c, ["%00001", "%_0007"], "c_name", "c_custkey")
    return c.join(ids, "c_custkey", "left_semi").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey")


@query(r"""WITH t AS (SELECT page_id, regexp_extract_all(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '[a-z0-9]+') AS ws FROM pages) SELECT page_id, unnest(list_distinct(ws)[1:100]) AS term FROM t""".replace("unnest(list_distinct(ws)[1:100]) AS term FROM t", "term FROM (SELECT page_id, unnest(list_distinct(ws)) AS term FROM t)"))
def keywords_page_titles(spark, d):
    words = F.array_distinct(tx.tokens(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)))
    return table(spark, d, "pages").select("page_id", F.explode(F.slice(words, 1, 100)).alias("term"))
