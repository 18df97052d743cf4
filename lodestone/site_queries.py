"""Registered queries of filters, views, work lists and changes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import ids, urls
from .functions import text as tx
from .operators import filters, graph, index, keywords, relations, search, views
from .plans.parse import parse
from .queries import HAS, SQL, TOK, docs, query, table, whole_edges

T = table
ORD = "SELECT o_orderkey AS id, o_custkey AS domain FROM orders"
HOST = r"regexp_extract(url, '://([^/:?#]*)', 1)"
TOP = rf"regexp_extract({HOST}, '([^.]+\.[^.]+)$', 1)"


# ---- filters --------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 5 AND year(l_shipdate) <= 1996 AND l_linenumber >= 2 AND l_suppkey <= 50")
def filter_all_limits(spark, d):
    spec = parse("x q>5 year<1996 size>2 rank<50")
    ok = search.limits(spec, {"quality": F.col("l_quantity"), "year": F.year("l_shipdate"), "size": F.col("l_linenumber"), "rank": F.col("l_suppkey")})
    return T(spark, d, "lineitem").where(ok).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 7")
def filter_quality_equals(spark, d):
    return T(spark, d, "lineitem").where(search.limits(parse("x q=7"), {"quality": F.col("l_quantity")})).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey >= 90")
def filter_rank(spark, d):
    return T(spark, d, "lineitem").where(search.limits(parse("x rank>90"), {"rank": F.col("l_suppkey")})).select("l_orderkey", "l_linenumber")


def _combined(spark, d):
    e = ids.encode_id(F.lit(0), F.col("l_suppkey"), F.col("l_partkey"))
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", e.alias("doc_id"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (3, 4, 7)")
def filter_domain_ranges(spark, d):
    return _combined(spark, d).where(filters.in_ranges(F.col("doc_id"), filters.ranges_of([7, 3, 4]))).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (3, 4, 7)")
def filter_domain_ranges_reject(spark, d):
    return _combined(spark, d).where(~filters.in_ranges(F.col("doc_id"), filters.ranges_of([7, 3, 4]))).select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey, (3::BIGINT << 57) | (s_suppkey << 26) AS low, ((3::BIGINT << 57) | (s_suppkey << 26)) + (1::BIGINT << 26) AS high FROM supplier")
def filter_domain_range_of(spark, d):
    low, high = filters.domain_range(F.col("s_suppkey"), 3)
    return T(spark, d, "supplier").select("s_suppkey", low.alias("low"), high.alias("high"))


@query(TOK + f"SELECT doc_id FROM documents WHERE doc_id IN {HAS.format('the')}")
def filter_unknown_term_passes(spark, d):
    return search.matching(index.postings(docs(spark, d)), parse("the -zqxjkunknown"))


@query(TOK + f"SELECT doc_id FROM documents WHERE doc_id IN {HAS.format('der')}")
def filter_unknown_term_empties(spark, d):
    return search.matching_paths(index.postings(docs(spark, d)), [("the", "zqxjkunknown"), ("der",)])


MASKS = "m AS (SELECT doc_id, term, bit_or((1::BIGINT << CAST((pos // 24) % 56 AS INTEGER)) | (1::BIGINT << CAST(((pos + 12) // 24) % 56 AS INTEGER))) AS mask FROM occ WHERE term IN ('the', 'of') GROUP BY doc_id, term)"


@query(TOK + f", {MASKS} SELECT a.doc_id FROM m a JOIN m b USING (doc_id) WHERE a.term = 'the' AND b.term = 'of' AND a.mask & b.mask <> 0")
def filter_viable(spark, d):
    rows = index.occurrences(docs(spark, d)).where("term in ('the', 'of')")
    one = rows.groupBy("doc_id", "term").agg(F.bit_or(index.position_mask(F.col("pos"))).alias("mask"))
    path = one.groupBy("doc_id").agg(F.collect_list("mask").alias("masks")).where("size(masks) = 2")
    return path.where(filters.viable(F.col("masks"), F.transform("masks", lambda m: F.lit(0)))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id < 5)")
def filter_search_set(spark, d):
    big = docs(spark, d).where("doc_id < 5").select("source")
    return filters.in_set(docs(spark, d), "source", big).select("doc_id")


@query("SELECT doc_id FROM documents")
def filter_empty_search_set(spark, d):
    return filters.in_set(docs(spark, d), "source", docs(spark, d).select("source").limit(0)).select("doc_id")


LISTED = f"listed AS (SELECT DISTINCT {HOST} AS name FROM pages WHERE page_id < 20 UNION SELECT DISTINCT {TOP} FROM pages WHERE page_id < 3)"


@query(f"WITH {LISTED} SELECT page_id FROM pages WHERE {HOST} NOT IN (SELECT name FROM listed) AND {TOP} NOT IN (SELECT name FROM listed)")
def filter_domain_blacklist(spark, d):
    p = T(spark, d, "pages").withColumn("host", urls.host(F.col("url")))
    listed = p.where("page_id < 20").select("host").union(p.where("page_id < 3").select(urls.top_domain(F.col("host"))))
    return filters.without_listed(p, "host", listed).select("page_id")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1))")
def filter_tiers(spark, d):
    listed = T(spark, d, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") + 1).alias("tier"))
    return filters.without_tiers(T(spark, d, "customer"), "c_nationkey", listed, 2).select("c_custkey")


@query("SELECT doc_id FROM documents WHERE source <> 'src1' AND source <> 'src2' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def filter_excluded_results(spark, d):
    bad = spark.createDataFrame([("src1",)], "source string")
    listed = spark.createDataFrame([("src2", 2)], "source string, tier int")
    return filters.without_excluded(docs(spark, d), "source", bad, listed, 2, T(spark, d, "labels").where("toxic = 1")).select("doc_id")


@query("SELECT o_custkey, CASE WHEN n > 1 THEN 'linked_many' WHEN n = 1 THEN 'linked_once' ELSE 'normal' END AS kind, CASE WHEN n > 1 THEN 10.0 WHEN n = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS factor, n <= 1 AS enforced FROM (SELECT o_custkey, count(*) - 5 AS n FROM orders GROUP BY o_custkey)")
def filter_document_class(spark, d):
    n = T(spark, d, "orders").groupBy("o_custkey").agg((F.count("*") - 5).alias("n"))
    kind = filters.document_class(F.col("n"), F.lit(False))
    return n.select("o_custkey", kind.alias("kind"), filters.length_factor(kind).alias("factor"), filters.enforces_quality(kind).alias("enforced"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<html[^>]*data-adblockkey=') THEN 'ACCEPTABLE_ADS' WHEN NOT regexp_matches(html, '(?i)lang="(en|de)"') THEN 'LANGUAGE' WHEN length(html) < 1000 THEN 'LENGTH' WHEN regexp_matches(html, '(?is)<meta[^>]+name=["'']?robots["'']?[^>]+content=["'']?[^"''>]*(noindex|none)') THEN 'FORBIDDEN' END AS reason FROM pages""")
def filter_disqualified(spark, d):
    h = F.col("html")
    reason = filters.disqualified(("ACCEPTABLE_ADS", filters.asks_for_acceptable_ads(F.lit(None).cast("string"), h)), ("LANGUAGE", ~h.rlike('(?i)lang="(en|de)"')), ("LENGTH", F.length(h) < 1000), ("FORBIDDEN", tx.forbids_indexing(h)))
    return T(spark, d, "pages").select("page_id", reason.alias("reason"))


ANCHORS = r"""a AS (SELECT page_id, url AS page, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text FROM pages)"""


def _anchors(spark, d):
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, 1).alias("href"), F.regexp_extract_all("html", pattern, 2).alias("text"))
    return T(spark, d, "pages").select("page_id", F.col("url").alias("page"), F.inline(both))


@query(f"WITH {ANCHORS} SELECT page_id, text, count(*) AS n FROM a WHERE trim(text) <> '' AND text NOT LIKE 'this%' AND lower(text) NOT IN ('here', 'click here') AND NOT regexp_matches(text, '[^\\x20-\\x7e]') GROUP BY page_id, text")
def filter_anchor_texts(spark, d):
    return _anchors(spark, d).where(filters.eligible_anchor_text(F.col("text"))).groupBy("page_id", "text").agg(F.count("*").alias("n"))


@query(f"WITH {ANCHORS}, l AS (SELECT 'http://' || text || '.example.org' || href AS url, text, regexp_extract(page, '://([^/:?#]*)', 1) AS source FROM a) SELECT lower(text) AS text, lower(url) AS url FROM l WHERE trim(text) <> '' AND text NOT LIKE 'this%' AND lower(text) NOT IN ('here', 'click here') AND NOT regexp_matches(text, '[^\\x20-\\x7e]') AND NOT regexp_matches(url, '[^\\x20-\\x7e]') AND NOT contains(text, lower(regexp_extract(url, '://([^/:?#]*)', 1))) AND lower(regexp_extract(url, '://([^/:?#]*)', 1)) <> source GROUP BY ALL")
def filter_anchor_links(spark, d):
    rows = _anchors(spark, d).select(F.concat(F.lit("http://"), "text", F.lit(".example.org"), "href").alias("url"), "text", urls.host(F.col("page")).alias("source"))
    return filters.eligible_anchors(rows).select(F.lower("text").alias("text"), F.lower("url").alias("url"))


@query("SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d') <= '2024-01-15'")
def filter_item_dates(spark, d):
    date = F.date_format("ts", "yyyy-MM-dd")
    return T(spark, d, "events").where(filters.valid_item_date(date, F.lit("2024-01-15").cast("date"))).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice / 2000 > 50) AND (o_orderpriority LIKE '1%' OR o_totalprice / 2000 > 25)")
def filter_similar_shown(spark, d):
    ok = filters.shown_as_similar(F.col("o_orderstatus") == "O", F.col("o_totalprice") / 2000, F.col("o_orderpriority").startswith("1"))
    return T(spark, d, "orders").where(ok).select("o_orderkey")


IPS = "ip AS (SELECT s_suppkey, '10.' || (s_suppkey % 7) || '.' || (s_suppkey % 11) || '.' || (s_suppkey % 250) AS ip, CASE WHEN s_suppkey % 13 = 0 THEN 'shop.cn' WHEN s_suppkey % 17 = 0 THEN 'a1234b.com' ELSE 'site.com' END AS domain FROM supplier)"


def _ips(spark, d):
    k = F.col("s_suppkey")
    ip = F.concat(F.lit("10."), k % 7, F.lit("."), k % 11, F.lit("."), k % 250)
    domain = F.when(k % 13 == 0, "shop.cn").when(k % 17 == 0, "a1234b.com").otherwise("site.com")
    return T(spark, d, "supplier").select("s_suppkey", ip.alias("ip"), domain.alias("domain"))


@query(f"WITH {IPS} SELECT s_suppkey FROM ip WHERE domain = 'site.com' AND ip NOT LIKE '10.3.%' AND NOT (ip LIKE '10.5.4.%' OR ip LIKE '10.5.5.%') AND ip <> '10.1.8.8'")
def filter_banned_networks(spark, d):
    cidrs = spark.createDataFrame([("10.3.0.0/16",), ("10.5.4.0/23",), ("10.1.8.8/32",)], "cidr string")
    return filters.without_banned(_ips(spark, d), "domain", "ip", cidrs).select("s_suppkey")


@query(f"WITH {ANCHORS} SELECT page_id, href FROM a WHERE length(href) BETWEEN 1 AND 128 AND NOT regexp_matches(lower(href), '\\.(zip|exe|pdf|png|jpg)$') GROUP BY ALL")
def filter_relevant_links(spark, d):
    return _anchors(spark, d).where(filters.relevant_link(F.col("href"), F.lit(None).cast("string"))).select("page_id", "href").distinct()


@query("SELECT s_suppkey, contains(upper(s_name), 'AMAZON') OR s_suppkey % 3 = 0 AS cloud FROM supplier")
def filter_clouds(spark, d):
    org = F.concat(F.upper("s_name"), F.when(F.col("s_suppkey") % 3 == 0, "-AMAZON-02").otherwise("-AMAZ"))
    return T(spark, d, "supplier").select("s_suppkey", filters.is_cloud(org).alias("cloud"))


@query(r"""SELECT page_id FROM pages WHERE length(trim(regexp_replace(regexp_replace(regexp_replace(substring(html, 1, 8192), '(?is)<(script|style|nav|header|footer|form)\b.*?</(script|style|nav|header|footer|form)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) >= 100 AND NOT regexp_matches(trim(regexp_replace(regexp_replace(regexp_replace(substring(html, 1, 8192), '(?is)<(script|style|nav|header|footer|form)\b.*?</(script|style|nav|header|footer|form)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '(?i)404|page not found|domain (is )?for sale|parked domain') AND regexp_matches(html, '(?i)<a[^>]+href="(/|[^":]*")')""")
def filter_new_sites(spark, d):
    return T(spark, d, "pages").where(filters.promising_site(F.lit(200), F.lit("text/html; charset=utf-8"), F.col("html"))).select("page_id")


@query(TOK + ", t AS (SELECT DISTINCT doc_id, term FROM occ WHERE pos <= 8 AND term IN ('the', 'of')) SELECT doc_id FROM t GROUP BY doc_id HAVING count(*) = 2")
def filter_title_strategy(spark, d):
    return filters.all_flagged(keywords.assemble({"title": keywords.title_words(docs(spark, d))}), ["the", "of"], "RF_TITLE")


# ---- views and joins ------------------------------------------------------------------------------------------

SIM = "sim AS (SELECT * FROM (" + SQL["graph_similarity"] + ")), site AS (SELECT c_custkey % 1000 AS id, min(c_name) AS name, bool_or(c_acctbal > 0) AS indexed FROM customer GROUP BY 1)"


def _sim(spark, d):
    from .queries import edges

    c = T(spark, d, "customer").groupBy((F.col("c_custkey") % 1000).alias("id")).agg(F.min("c_name").alias("name"), F.max(F.col("c_acctbal") > 0).alias("indexed"))
    return graph.similarity(edges(spark, d)).select("a", "b", F.round("value", 6).alias("value")), c


@query(f"WITH {SIM} SELECT a AS domain_id, x.name AS domain_name, b AS neighbour_id, y.name AS neighbour_name, round(100 * value) AS relatedness FROM sim JOIN site x ON x.id = a JOIN site y ON y.id = b")
def view_neighbours(spark, d):
    return views.neighbour_view(*_sim(spark, d))


@query(f"WITH {SIM} SELECT domain_id, other, name, relatedness, mutual FROM (SELECT a AS domain_id, b AS other, name, value AS relatedness, false AS mutual, row_number() OVER (PARTITION BY a ORDER BY value DESC, b) AS n FROM sim JOIN site ON id = b) WHERE n <= 5")
def view_related(spark, d):
    return views.related(*_sim(spark, d), limit_per=5)


@query(f"WITH {SIM} SELECT domain_id, other, name, relatedness, mutual FROM (SELECT b AS domain_id, a AS other, name, value AS relatedness, false AS mutual, row_number() OVER (PARTITION BY b ORDER BY value DESC, a) AS n FROM sim JOIN site ON id = a) WHERE n <= 5")
def view_related_reverse(spark, d):
    pairs, sites = _sim(spark, d)
    return views.related(views.reversed_pairs(pairs), sites, limit_per=5)


@query(f"WITH {SIM} SELECT a AS domain_id, b AS neighbour_id, y.name AS neighbour_name, round(100 * value) AS relatedness, y.indexed FROM sim JOIN site x ON x.id = a JOIN site y ON y.id = b WHERE b % 2 = 0 AND b % 7 <> 0")
def view_similar_with_screenshot(spark, d):
    pairs, sites = _sim(spark, d)
    shots, bad = sites.where("id % 2 = 0").select("name"), sites.where("id % 7 = 0").select("id")
    return views.similar_with_screenshot(views.neighbour_view(pairs, sites), shots, sites, bad)


@query("""SELECT o_orderkey AS id, 'https://' || c_name || CASE WHEN o_orderkey % 3 = 0 THEN ':8080' ELSE '' END || '/' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '?s=' || o_orderstatus ELSE '' END AS url, o_custkey AS domain_id, c_name AS domain, l.quality
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS quality FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def view_urls(spark, d):
    o, k = T(spark, d, "orders"), F.col("o_orderkey")
    u = o.select(k.alias("id"), F.col("o_custkey").alias("domain_id"), F.lit("https").alias("proto"), F.when(k % 3 == 0, 8080).alias("port"), F.concat(F.lit("/"), "o_orderpriority").alias("path"), F.when(k % 2 == 0, F.concat(F.lit("s="), "o_orderstatus")).alias("param"))
    sites = T(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    data = T(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_quantity").alias("quality"))
    return views.url_view(u, sites, data)


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal > 0 AS indexed FROM customer WHERE c_nationkey IN (1, 2) AND c_custkey % 4 < 2 AND c_custkey IN (SELECT o_custkey FROM orders) AND c_mktsegment <> 'BUILDING'")
def view_random_sites(spark, d):
    c = T(spark, d, "customer")
    chosen = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("domain_set"))
    sites = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("indexed"), (F.col("c_custkey") % 4).alias("state"), F.when(F.col("c_mktsegment") == "BUILDING", 1).alias("alias"))
    live = T(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("available", F.lit(True))
    return views.random_sites(chosen, sites, live, (1, 2))


@query("SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def view_selection(spark, d):
    n, c = T(spark, d, "nation"), T(spark, d, "customer")
    types = n.select(F.col("n_nationkey").alias("type_id"), F.when(F.col("n_nationkey") == 3, "BLOG").otherwise(F.col("n_name")).alias("type_name"))
    chosen = c.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("type_id"))
    return views.selection(chosen, types, c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "BLOG")


@query("SELECT c_custkey AS id, s.n AS orders, a.last AS latest FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) s ON s.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_totalprice > 100000 GROUP BY 1) a ON a.o_custkey = c_custkey")
def view_history(spark, d):
    o = T(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    security = o.where("o_orderstatus = 'F'").groupBy("id").agg(F.count("*").alias("orders"))
    availability = o.where("o_totalprice > 100000").groupBy("id").agg(F.max("o_orderdate").alias("latest"))
    return views.history(T(spark, d, "customer").select(F.col("c_custkey").alias("id")), security, availability)


@query("SELECT o_orderkey, coalesce(c_custkey, -1) AS c_custkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')")
def join_name_to_id(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"))
    return views.with_ids(o, "name", T(spark, d, "customer").where("c_acctbal > 0").select("c_name", "c_custkey"), "c_custkey").select("o_orderkey", "c_custkey")


@query("SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def join_values(spark, d):
    n = T(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return views.values_of(T(spark, d, "part").select("p_partkey"), "p_partkey", n, "n")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer")
def join_mark(spark, d):
    o = T(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return views.marked(T(spark, d, "customer").select("c_custkey"), "c_custkey", o, "pending")


@query(TOK + "SELECT doc_id, tf, first FROM (SELECT doc_id, count(*) AS tf, CAST(min(pos) AS BIGINT) AS first FROM occ WHERE term = 'the' GROUP BY doc_id) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def join_posting_values(spark, d):
    wanted = T(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    rows = index.postings(docs(spark, d)).where("term = 'the'").join(wanted, "doc_id", "left_semi")
    return rows.select("doc_id", "tf", F.element_at("positions", 1).cast("long").alias("first"))


@query("SELECT a AS other, round(rank, 6) AS rank, relatedness, direction FROM (SELECT node AS a, n AS rank, 0.0::DOUBLE AS relatedness, dd AS direction FROM (SELECT o_custkey AS node, count(*)::DOUBLE AS n FROM orders GROUP BY 1) RIGHT JOIN (SELECT DISTINCT o_custkey * 2 AS k, o_custkey, 2::BIGINT AS dd FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey = 5) ON node = o_custkey) ORDER BY rank DESC, other LIMIT 20".replace("node AS a", "k AS a"))
def view_linking(spark, d):
    rank = T(spark, d, "orders").groupBy((F.col("o_custkey") * 2).alias("node")).agg(F.count("*").cast("double").alias("rank"))
    near = spark.createDataFrame([], "other long, relatedness double")
    return views.linking(whole_edges(spark, d), 11, rank, near, 20)


# ---- work lists -----------------------------------------------------------------------------------------------


@query('SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS "at" FROM orders ORDER BY "at" NULLS FIRST, o_orderkey LIMIT 400')
def list_due(spark, d):
    rows = T(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("at"))
    return views.due(rows, "at", "o_orderkey", 400)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 50")
def list_before(spark, d):
    return views.before(T(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5000, 50)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 2000")
def list_queue(spark, d):
    return views.queue(T(spark, d, "orders"), "o_orderstatus", "O", "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query(None)
def list_random(spark, d):
    return views.shuffled(T(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


LOAD = """load AS (SELECT n_nationkey AS node, (n_nationkey * 37 % 90)::BIGINT AS n FROM nation), new AS (SELECT s_name AS name, row_number() OVER (ORDER BY s_name) - 1 AS i FROM supplier),
place AS (SELECT node, row_number() OVER (ORDER BY n + k, node) - 1 AS i FROM load, range(0, 200) t(k))"""


@query(f"WITH {LOAD} SELECT name, node FROM new JOIN place USING (i)")
def list_node_allocation(spark, d):
    load = T(spark, d, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") * 37 % 90).cast("long").alias("n"))
    return views.allocate(T(spark, d, "supplier").select(F.col("s_name").alias("name")), load)


@query(TOK + "SELECT term AS word, count(*) AS score FROM occ WHERE term LIKE 'th%' GROUP BY term ORDER BY 2 DESC, 1 LIMIT 10")
def list_completions(spark, d):
    words = index.term_stats(docs(spark, d)).select(F.col("term").alias("word"), F.col("cf").alias("score"))
    return views.completions(words, "th", 10)


@query("SELECT c_nationkey AS node, count(*) AS n FROM customer GROUP BY 1")
def node_load(spark, d):
    return T(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderpriority FROM orders")
def select_distinct(spark, d):
    return T(spark, d, "orders").select("o_orderpriority").distinct()


@query(f"SELECT DISTINCT {TOP} AS top FROM pages")
def distinct_root_domains(spark, d):
    return T(spark, d, "pages").select(urls.top_domain(urls.host(F.col("url"))).alias("top")).distinct()


# ---- sets and links -------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS known FROM orders")
def union_exists(spark, d):
    li = T(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    known = li.where("l_returnflag = 'R'").select("o_orderkey").union(li.where("l_quantity > 45").select("o_orderkey"))
    return views.marked(T(spark, d, "orders").select("o_orderkey"), "o_orderkey", known, "known")


@query("SELECT l_orderkey AS a, l_partkey AS b FROM lineitem UNION SELECT l_partkey, l_orderkey FROM lineitem")
def union_relations(spark, d):
    return graph.symmetric(T(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))).toDF("a", "b")


HOSTS = rf"h AS (SELECT page_id, {HOST} AS dest, {TOP} AS top FROM pages)"


@query(f"WITH {HOSTS} SELECT page_id, dest FROM h UNION ALL SELECT page_id, CASE WHEN dest LIKE 'www.%' THEN substring(dest, 5) ELSE 'www.' || dest END FROM h WHERE dest LIKE 'www.%' OR dest = top")
def union_alias_links(spark, d):
    rows = T(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("dest"))
    return views.with_alias_links(rows, "dest", urls.alias(F.col("dest")))


TOPO = """li AS (SELECT DISTINCT o_orderkey AS src, (o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM orders) AS dst FROM orders), pg AS (SELECT o_orderkey AS url, o_custkey % 50 AS domain FROM orders)"""


@query(f"WITH {TOPO} SELECT pg.url, pg.domain, (SELECT count(*) FROM pg q WHERE q.domain = pg.domain) AS size, CAST(coalesce(i.n, 0) + coalesce(o.n, 0) AS BIGINT) AS topology FROM pg LEFT JOIN (SELECT dst, count(*) AS n FROM li JOIN pg a ON a.url = src JOIN pg b ON b.url = dst WHERE a.domain = b.domain GROUP BY dst) i ON i.dst = pg.url LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) o ON o.l_orderkey = pg.url")
def page_topology(spark, d):
    o = T(spark, d, "orders")
    n = o.agg(F.count("*").alias("n"))
    links = o.join(F.broadcast(n)).select(F.col("o_orderkey").alias("src"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % F.col("n")).alias("dst")).distinct()
    anchors = T(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("url"), F.lit(1).alias("cnt"))
    return views.topology(o.select(F.col("o_orderkey").alias("url"), (F.col("o_custkey") % 50).alias("domain")), links, anchors)


@query("""WITH w AS (SELECT DISTINCT l_orderkey AS url, l_suppkey AS word FROM lineitem), k AS (SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders),
n AS (SELECT dst AS url, word FROM k JOIN w ON w.url = k.src GROUP BY dst, word HAVING count(*) > 3) SELECT url, word FROM n SEMI JOIN w USING (url, word)""")
def page_adjacent_words(spark, d):
    words = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("url"), F.col("l_suppkey").alias("word")).distinct()
    return views.adjacent_words(T(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")), words)


@query("SELECT doc_id, 'lang:' || lang AS term FROM documents WHERE lang IS NOT NULL UNION SELECT doc_id, 'special:big' FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) > 30)")
def terms_of_domains(spark, d):
    x = docs(spark, d)
    big = x.groupBy("source").agg(F.count("*").alias("n")).where("n > 30").select("source", F.lit("special:big").alias("term"))
    own = x.where("lang is not null").select("doc_id", F.concat(F.lit("lang:"), "lang").alias("term"))
    return own.unionByName(views.with_decorators(x, "source", big)).distinct()


@query(f"WITH {IPS}, t AS (SELECT s_suppkey, unnest(['ip:' || ip, 'ip:se', 'as:' || (s_suppkey % 5), 'as:amazon', 'as:02', 'special:cloud']) AS term FROM ip) SELECT * FROM t GROUP BY ALL")
def terms_of_addresses(spark, d):
    rows = _ips(spark, d).select("s_suppkey", "ip", F.lit("SE").alias("country"), (F.col("s_suppkey") % 5).alias("asn"), F.lit("AMAZON-02").alias("org"))
    return rows.select("s_suppkey", F.explode(keywords.address_terms(F.col("ip"), F.col("country"), F.col("asn"), F.col("org"))).alias("term")).distinct()


@query(f"WITH {ANCHORS} SELECT text, count(*) AS n FROM a WHERE lower(text) NOT IN ('the', 'and', 'to') GROUP BY text")
def anchor_stop_list(spark, d):
    stop = spark.createDataFrame([("the",), ("and",), ("to",)], "word string")
    return _anchors(spark, d).join(stop, F.lower("text") == stop.word, "left_anti").groupBy("text").agg(F.count("*").alias("n"))


@query(TOK + ", m AS (SELECT doc_id, max(tf) AS top FROM tf GROUP BY doc_id), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term), v AS (SELECT tf.doc_id, tf.term AS word, df, CAST(trunc(-((0.1::DOUBLE + 0.9::DOUBLE * tf.tf / m.top) * ln(greatest(f.df, 1)::DOUBLE / (SELECT count(*) FROM documents)::DOUBLE)) * 75) AS BIGINT) AS value FROM tf JOIN m USING (doc_id) JOIN f USING (term) WHERE length(term) >= 3), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, word) AS r FROM v), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, word) AS q FROM a WHERE r <= 16 AND df > 100) SELECT doc_id, word FROM b WHERE q <= 6")
def keywords_important(spark, d):
    v = index.tfidf(docs(spark, d)).withColumnRenamed("term", "word")
    df = v.groupBy("word").agg(F.count("*").alias("df"))
    return views.important_words(v.join(df, "word"))


@query(TOK + "SELECT doc_id, term AS word, tf AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS r FROM tf WHERE tf >= 3) WHERE r <= 150")
def keywords_top_names(spark, d):
    return views.most_common_names(index.term_counts(docs(spark, d)).select("doc_id", F.col("term").alias("word"), F.col("tf").alias("n")))


# ---- changes --------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, event_id, CASE WHEN b IN ('error', 'signup') AND event_type IN ('error', 'signup') THEN 'outage_type' WHEN event_type IN ('error', 'signup') THEN 'down' ELSE 'up' END AS change FROM s WHERE (b IN ('error', 'signup')) <> (event_type IN ('error', 'signup')) OR (b IN ('error', 'signup') AND event_type IN ('error', 'signup') AND b <> event_type)""")
def availability_kinds(spark, d):
    up = ~F.col("event_type").isin("error", "signup")
    return relations.availability(T(spark, d, "events"), "user_id", ["ts", "event_id"], up, F.col("event_type")).select("user_id", "event_id", "change")


@query("""WITH s AS (SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag AS f, l_linestatus AS s, lag(l_returnflag) OVER w AS bf, lag(l_linestatus) OVER w AS bs FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice))
SELECT l_partkey, l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN f <> bf THEN 'l_returnflag' END, CASE WHEN s <> bs THEN 'l_linestatus' END], lambda x: x IS NOT NULL), ',') AS changed FROM s WHERE f <> bf OR s <> bs""")
def security_changes(spark, d):
    rows = relations.field_changes(T(spark, d, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber", "l_extendedprice"], ["l_returnflag", "l_linestatus"])
    return rows.select("l_partkey", "l_orderkey", "l_linenumber", F.array_join("changed", ",").alias("changed"))


@query("SELECT user_id, count(*) AS items, min(event_id) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' GROUP BY user_id")
def links_updated_since(spark, d):
    rows = T(spark, d, "events").where("ts <= timestamp'2024-01-20'")
    found = relations.updated_since(rows, "user_id", "event_id", "ts", F.lit("2024-01-10").cast("timestamp"))
    return found.select("user_id", F.size("items").cast("long").alias("items"), F.array_min("items").alias("first"))


CADENCE = "CASE o_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 0 END"


@query(f"SELECT o_orderkey, CASE WHEN {CADENCE} = 0 THEN 'never' WHEN 2500 < date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + {CADENCE} THEN 'skip' ELSE 'no_skip' END AS skip FROM orders")
def fetch_cadence(spark, d):
    top = F.when(F.col("o_custkey") % 4 == 0, "wordpress.com").when(F.col("o_custkey") % 4 == 1, "substack.com").otherwise("example.org")
    last = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return T(spark, d, "orders").select("o_orderkey", relations.skip_fetch(top, F.lit("x"), last, F.lit(2500)).alias("skip"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'not_modified' WHEN 2 THEN 'permanent' ELSE 'transient' END AS state FROM orders")
def fetch_states(spark, d):
    k = F.col("o_orderkey") % 6
    status = F.when(k == 0, 200).when(k == 1, 304).when(k == 2, 404).when(k == 3, 503).when(k == 4, 429)
    return T(spark, d, "orders").select("o_orderkey", relations.fetch_state(status).alias("state"))


@query("SELECT o_orderkey, round(least(30.0::DOUBLE * 86400, 3600 * 2.0::DOUBLE ^ (o_orderkey % 12)), 3) AS seconds FROM orders")
def fetch_backoff(spark, d):
    s = relations.backoff(F.lit(3600.0), F.col("o_orderkey") % 12, 2.0)
    return T(spark, d, "orders").select("o_orderkey", F.round(s, 3).alias("seconds"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS b FROM events) WHERE a <= 5 AND b <= 2")
def rate_limited(spark, d):
    return relations.within_rates(T(spark, d, "events"), "user_id", "ts", "event_id", per_minute=5, per_day=2).select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-25' - INTERVAL 1 MONTH AND ts <= TIMESTAMP '2024-01-25'")
def recent_screenshots(spark, d):
    now = F.lit("2024-01-25").cast("timestamp")
    return T(spark, d, "events").where(relations.is_recent(F.col("ts"), now) & (F.col("ts") <= now)).select("event_id")


@query("SELECT l_partkey AS id, count(*) AS found FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_partkey")
def new_domain_queue(spark, d):
    known = T(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("id"))
    return relations.newcomers(T(spark, d, "lineitem").select(F.col("l_partkey").alias("id")), known, "id")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-05') WHERE n = 1")
def timed_jobs(spark, d):
    return relations.earliest_due(T(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("ts") <= F.lit("2024-01-05").cast("timestamp")).select("user_id", "event_id", "ts")


@query("SELECT hour(ts) AS hour, count(*) AS n FROM events WHERE hour(ts) >= 22 OR hour(ts) < 4 GROUP BY 1")
def scheduled_hours(spark, d):
    rows = T(spark, d, "events").where(relations.in_hours(F.col("ts"), 22, 4))
    return rows.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
