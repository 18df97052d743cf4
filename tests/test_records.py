"""Archives in, documents out, tables swapped, plug-ins, work logs, feeds, the classifier."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from lodestone import plugins, storage, streaming
from lodestone.operators import filters, graph, relations, views
from lodestone.sources import records


def _archive(path):
    def rec(url, kind, status, body):
        block = f"HTTP/1.1 {status} OK\r\nContent-Type: {kind}\r\nSet-Cookie: a\r\n\r\n".encode() + body
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nWARC-IP-Address: 10.0.0.1\r\nWARC-Target-URI: " + url.encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    html = b"<html><title>T</title><body>" + b"the words of a page and more of it " * 3 + b"</body></html>"
    parts = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n", rec("http://a.org/x", "text/html; charset=utf-8", 200, html), rec("http://a.org/y", "image/png", 200, b"png"), rec("http://a.org/z", "text/html", 404, html)]
    with open(path, "wb") as f:
        for p in parts:
            f.write(gzip.compress(p))
        f.write(gzip.compress(parts[1])[:40])  # cut short


def test_archive_to_documents(spark, tmp_path):
    _archive(tmp_path / "a.warc.gz")
    crawl = records.read_warc(spark, str(tmp_path / "a.warc.gz"))
    assert {(r.domain, r.url, r.ip, r.cookies, r.http_status) for r in crawl.collect()} == {("a.org", "http://a.org/x", "10.0.0.1", True, 200), ("a.org", "http://a.org/z", "10.0.0.1", True, 404)}
    docs = records.process(crawl, first_id=100)
    got = {r.url: (r.doc_id, r.lang, r.title, r.state, r.reason) for r in docs.collect()}
    assert got == {"http://a.org/x": (100, "en", "T", "ok", None), "http://a.org/z": (101, "en", "T", "disqualified", "STATUS")}
    path = str(tmp_path / "p")
    records.write_processed(docs, spark.createDataFrame([(1, 2), (1, 2)], "src long, dst long"), path)
    assert records.for_index(spark, path).columns == ["doc_id", "text", "lang", "source", "n_chars", "quality"] and records.for_index(spark, path).count() == 1
    assert records.for_display(spark, path).first().title == "T"
    assert records.domain_names(spark, path, ip=True).collect() == [("a.org", "10.0.0.1")]
    records.append_links(spark.createDataFrame([(3, 4)], "src long, dst long"), f"{path}/link")
    assert records.links(spark, path).count() == 2
    assert records.sideload(spark, "warc", str(tmp_path / "a.warc.gz")).count() == 2


def test_other_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id":"1","title":"T","selftext":"body","permalink":"/r/x/1"}\n{"id":"2","body":"[deleted]","permalink":"/r/x/2"}\n{"id":"3","body":"yes","subreddit":"x","permalink":"/r/x/3"}\n')
    assert {(r.title, r.text) for r in records.sideload(spark, "reddit", str(tmp_path / "r.json")).collect()} == {("T", "body"), ("/r/x", "yes")}
    (tmp_path / "e.json").write_text('{"title":"A","url":"u","html":"<p>x</p>"}\n')
    assert records.sideload(spark, "encyclopedia", str(tmp_path / "e.json")).collect() == [("u", "A", "x")]
    with pytest.raises(ValueError):
        records.sideload(spark, "tape", "x")


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        records.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert os.listdir(tmp_path) == ["t"]
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "doc_id long, title string")
    for _ in range(2):
        records.write_details(a, f"{path}d")
    assert records.details_of(spark.createDataFrame([(2,)], "doc_id long"), spark.read.parquet(f"{path}d")).collect() == [(2, "y")]
    assert spark.read.parquet(f"{path}d").count() == 2
    with pytest.raises(ValueError):
        storage.swap(spark, f"{path}-none", path)
    docs = spark.createDataFrame([(1, "a b a", "en", "s"), (2, "a", "en", "s")], "doc_id long, text string, lang string, source string")
    records.export_term_frequencies(docs, f"{path}f")
    terms, n = records.read_term_frequencies(spark, f"{path}f")
    assert n == 2 and sorted(r.n for r in terms.collect()) == [1, 2]
    records.export_feeds(spark.createDataFrame([('a"b', "u")], "domain string, feed_url string"), f"{path}c")
    assert '"a""b","u"' in "".join(r.value for r in spark.read.text(f"{path}c").collect())
    assert records.sample_domains(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "domain string, n int"), 5).count() == 2


def test_plugins(spark):
    rows = spark.range(10)
    fs = [plugins.Where(lambda: F.col("id") % 2 == 0, "even", 2.0), plugins.Where(lambda: F.col("id") > 3, "large", 1.0)]
    assert [r.id for r in plugins.apply_filters(rows, fs).collect()] == [4, 6, 8] and plugins.describe(fs) == "large and even"

    class Tens:
        def applies(self):
            return F.col("id") < 5

        def process(self, r):
            return r.select((F.col("id") * 10).alias("id"))

    made, left = plugins.dispatch(rows, [Tens()])
    assert made.count() == 5 and {r.reason for r in left.collect()} == {"CONTENT_TYPE"}
    scores = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.1)], "node long, score double")
    assert plugins.accumulate(scores, "set", 2) == {1, 2} and [r.node for r in plugins.accumulate(scores, "places", 2).collect()] == [2, 1]
    assert plugins.ids_by_pattern(spark.createDataFrame([(1, "a.org"), (2, "b.com")], "id long, name string"), ["%.org"]).collect() == [(1,)]
    assert spark.range(1).select(plugins.stem(F.array(F.lit("cats"), F.lit("cats")), "porter").alias("s")).first().s == ["cat", "cat"]
    assert spark.range(1).select(plugins.fold(plugins.each(F.array(F.lit(1), F.lit(2)), lambda x: x * 2), F.lit(0), lambda a, x: a + x)).first()[0] == 6

    @plugins.exporter("ids")
    def ids(df, out):
        out.extend(r.id for r in df.collect())

    out = []
    plugins.export("ids", spark.range(2), out)
    assert out == [0, 1]


def test_pagerank_against_brute_force(spark):
    edges = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (4, 5), (6, 0)]
    nodes = range(7)
    for start in (None, [0, 3]):
        t = {n: 1 / 7 if start is None else (1 / 2 if n in start else 0.0) for n in nodes}
        score = dict.fromkeys(nodes, 1 / 7)
        for _ in range(200):
            lost = sum(score[n] for n in nodes if not any(a == n for a, _ in edges))
            score = {n: 0.15 * t[n] + 0.85 * (sum(score[a] / sum(x == a for x, _ in edges) for a, b in edges if b == n) + lost * t[n]) for n in nodes}
        df = spark.createDataFrame(edges, "src long, dst long")
        got = graph.pagerank(df, tolerance=1e-6, start=spark.createDataFrame([(n,) for n in start], "node long") if start else None)
        assert all(abs(r.score - score[r.node]) < 1e-4 for r in got.collect()) and got.count() == 7
    assert {r.node: r["class"] for r in graph.classes(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 6: 0, 4: 4, 5: 4}


def test_work_and_feeds(spark, tmp_path):
    log = streaming.WorkLog(spark, str(tmp_path / "log"))
    work = spark.range(5)
    log.record(log.left(work).where("id < 3"))
    assert sorted(r.id for r in log.left(work).collect()) == [3, 4]
    feeds = spark.createDataFrame([("a", "u", "e1", 0, "old"), ("b", "u", "e2", 9, "old"), ("c", "u", "e3", 0, "old"), ("d", "u", "e4", 2, "old")], "domain string, url string, etag string, errors int, body string")
    got = spark.createDataFrame([("a", "success", "n1", "new"), ("b", "transient", None, None), ("c", "permanent", None, None), ("d", "not_modified", None, None)], "domain string, state string, etag string, body string")
    after = {r.domain: (r.etag, r.errors, r.body) for r in streaming.refresh_feeds(feeds, got).collect()}
    assert after == {"a": ("n1", 0, "new"), "d": ("e4", 0, "old")}
    assert [r.domain for r in streaming.refresh_feeds(feeds, got, clean=True).collect()] == ["a"]
    s = spark.range(1).select(relations.next_check(F.lit("dns"), F.lit(60.0), F.lit(2), F.lit("x")).alias("s")).first().s
    assert 60 * 6.25 * 0.85 <= s <= 60 * 6.25 * 1.15


def test_allocation(spark):
    new = spark.createDataFrame([(f"n{i}",) for i in range(5)] + [("x.wide.org",)], "name string")
    load = spark.createDataFrame([(1, 3), (2, 0), (3, 1)], "node int, n long")
    got = {r.name: r.node for r in views.allocate(new, load, wide={"wide.org": 9}, top=F.regexp_extract("name", r"([^.]+\.[^.]+)$", 1)).collect()}
    assert got == {"n0": 2, "n1": 2, "n2": 3, "n3": 2, "n4": 3, "x.wide.org": 9}


def test_frontier_and_live(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"u{i % 7}") for i in range(20)] + [("b", "u1")], "domain string, url string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = streaming.run_to_table(streaming.frontier(stream, 5), "frontier").groupBy("domain").count().collect()
    assert {tuple(r) for r in got} == {("a", 5), ("b", 1)}


def test_reasons_and_sets(spark):
    with pytest.raises(ValueError):
        filters.disqualified(("NO_SUCH", F.lit(True)))
    assert filters.ranges_of([5, 3, 4, 9]) == [(3 << 26, 6 << 26), (9 << 26, 10 << 26)]
