"""The engine as an object, feeds and links, and streams against batch results."""

import pytest
from pyspark.sql import functions as F

from lodestone import streaming
from lodestone.api import Engine
from lodestone.functions import feeds


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    rows = [(1, "red fox runs", "en", "a", 12), (2, "red red fox", "en", "a", 11), (3, "red wolf", "en", "b", 8), (4, "fox and red wolf", "de", "b", 16), (5, None, "en", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    edges = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 11), (3, 12)], "src long, dst long")
    return Engine.build(docs, str(tmp_path_factory.mktemp("x") / "index"), edges=edges)


def test_ranked(engine):
    assert {r.doc_id for r in engine.search("red fox").collect()} == {1, 2, 4}
    assert [r.doc_id for r in engine.search("red fox", per_source=1, count=1).collect()] == [r.doc_id for r in engine.search("red fox", per_source=1).collect()][:1]
    assert {r.doc_id for r in engine.search("red fox lang:de").collect()} == {4}
    assert {r.doc_id for r in engine.search('"red fox"').collect()} == {1, 2}
    assert engine.search("nothing").count() == 0
    assert [(r.seen, r.doc_id) for r in engine.search("red fox", per_source=1).collect() if r.source == "a"][0][0] == 2


def test_answers(spark, tmp_path):
    rows = [(1, "red fox runs", "en", "blog.a.org", 12, 1999), (2, "red wolf foo-bar", "en", "a.org", 16, 2000), (3, "red fox jumps", "en", "b.org", 13, 2001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, year int")
    sets = {"small": spark.createDataFrame([("b.org",)], "source string"), "none": spark.createDataFrame([], "source string")}
    e = Engine.build(docs, str(tmp_path / "i"), spark.createDataFrame([(2, "format:html")], "doc_id long, term string"), sets=sets)
    ids = lambda q: {r.doc_id for r in e.search(q).collect()}
    for q, want in {"red year>2000": {2, 3}, "red year<2000": {1, 2}, "red year=2000": {2}, 'red -"red fox"': {2}, "red -foo-bar": {1, 3}, "foo-bar": {2}, "red site:*.a.org": {1, 2}, "red site:a.org": {2}, "red tld:org -wolf": {1, 3}, "red format:html": {2}, "red set:small": {3}, "red set:none": {1, 2, 3}}.items():
        assert ids(q) == want, q
        assert set(e.unranked(q)[0]) == want, q
    for q in ("red q>3", "red set:other", "red near:5", "red qs=RF_TITLE"):
        with pytest.raises(ValueError):
            e.search(q)
    parts = e.explain("red fox").groupBy("doc_id").sum("part").collect()
    assert {r[0]: round(r[1], 9) for r in parts} == {r.doc_id: round(r.score, 9) for r in e.execute(e._spec("red fox", None)).collect()}
    assert e.calculate("2+2") == "4" and len(e.to_json(e.search_v1("red"))) == 3


def test_paging(engine):
    first, cursor = engine.unranked("red", count=3)
    rest, end = engine.unranked("red", count=3, cursor=cursor)
    assert (first, rest, end) == ([1, 2, 3], [4], "FIN")
    assert engine.unranked("red", cursor=end) == ([], "FIN")


def test_filters(engine):
    xml = "<filter><domains-include>b</domains-include><terms-exclude>fox</terms-exclude></filter>"
    engine.put_filter("u", "mine", xml)
    assert engine.list_filters("u") == ["mine"] and engine.list_filters("v") == []
    assert [r.doc_id for r in engine.search("red", filter_xml=engine.get_filter("u", "mine")).collect()] == [3]
    assert engine.drop_filter("u", "mine") and not engine.drop_filter("u", "mine")


def test_sites(engine):
    assert {r.dst for r in engine.links_from(1).collect()} == {10, 11} and {r.src for r in engine.links_to(10).collect()} == {1, 2}
    assert [(r.other, round(r.value, 6)) for r in engine.similar(10).collect()] == [(11, 1.0)]
    assert tuple(engine.site("b").first()) == ("b", 2, 24, ["de", "en"])


def test_feed(spark):
    xml = """<rss><item><title>Old</title><pubDate>Mon, 1 Jan 2024 10:00:00 GMT</pubDate><link>http://a/1#x</link><description>&lt;p&gt;Hi <b>you</b></description></item>
    <item><title><![CDATA[New]]></title><pubDate>nonsense</pubDate><updated>2024-02-01</updated><guid>http://a/2</guid></item><item/></rss>"""
    got = spark.range(1).select(F.inline(feeds.items(F.lit(xml)))).collect()
    assert ("2024-01-01", "Old", "Hi you", "http://a/1") in {(r.date, r.title, r.description, r.url) for r in got}
    assert spark.range(1).select(F.size(feeds.items(F.lit("")))).first()[0] == 0


@pytest.mark.parametrize("href,want", [("/x", "http://h/x"), ("x#f", "http://h/a/x"), ("../x", "http://h/x"), ("//o/x", "http://o/x"), ("mailto:a@b", None), ("../../../../../x", "http://h/x"), ("./y/../z/", "http://h/a/z/"), ("..", "http://h/"), ("?q=1", "http://h/a/b?q=1"), ("https://o/", "https://o/"), ("", "http://h/a/b")])
def test_resolve(spark, href, want):
    assert spark.range(1).select(feeds.resolve(F.lit(href), F.lit("http://h/a/b"))).first()[0] == want


def test_repair(spark):
    assert spark.range(1).select(feeds.repaired(F.lit("http://a/b c%zz%20|"))).first()[0] == "http://a/b%20c%25zz%20%7C"


def test_streams_match_batches(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=(F.col("id") * 17).cast("int"))).alias("ts"), (F.col("id") % 3).alias("user_id"), F.when(F.col("id") % 4 == 0, "error").otherwise("view").alias("event_type"), F.concat(F.lit("u"), F.col("id") % 50).alias("url"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: streaming.events_stream(spark, str(tmp_path / "in"), rows.schema)
    got = streaming.run_to_table(streaming.tumbling(stream()), "tumbled", "complete").collect()
    want = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().select("w.start", "event_type", "count").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert streaming.run_to_table(streaming.fresh_urls(stream()), "fresh").count() == 50
    one = streaming.run_to_table(streaming.sessions(stream()), "sessions", "complete")
    want = rows.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").count()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, want.select("user_id", "w.start", "w.end", "count").collect()))
    q = streaming.sink_upserts(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    again = rows.where("event_id < 50").withColumn("ts", F.col("ts") + F.expr("interval 1 day")).withColumn("url", F.lit("new"))
    again.write.parquet(str(tmp_path / "in2"))
    streaming.sink_upserts(streaming.events_stream(spark, str(tmp_path / "in2"), rows.schema), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 200 and out.where("url = 'new'").count() == 50
