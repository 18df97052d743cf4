"""Every registered query of the engine against its SQL on the smallest tables, and properties of operators."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import graph_queries, more_queries, score_queries, site_queries, text_queries, tree_queries  # noqa: F401  they register their queries
from lodestone import queries as Q
from lodestone.functions import ids, urls
from lodestone.operators import graph, index, relations, search

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, DATA)
    want = duck.sql(Q.SQL[name])
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_index_is_pruned(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a", "en", "s", 5), (2, "b c", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    index.write_index(docs, str(tmp_path / "i"))
    got = index.read_postings(spark, str(tmp_path / "i"), ["a"]).select("doc_id", "tf", "positions").collect()
    assert [tuple(r) for r in got] == [(1, 2, [1, 3])]


def test_spans(spark):
    df = spark.sql("select array(named_struct('start', 2, 'end', 5), named_struct('start', 8, 'end', 9)) s, array(2, 4, 5, 8) p")
    r = df.select(search.positions_in(F.col("s"), F.col("p")), search.spans_holding(F.col("s"), F.col("p"), 1), search.spans_holding(F.col("s"), F.col("p"), 1, "exact"), search.spans_holding(F.col("s"), F.col("p"), 3, "boundary")).first()
    assert tuple(r) == (3, 2, 1, 1)


def test_ids_round_trip(spark):
    e = ids.encode_id(F.lit(63), F.lit(123456), F.lit(789))
    r = spark.range(1).select(ids.domain_of(e), ids.ordinal_of(e), ids.without_rank(e) == ids.encode_id(F.lit(0), F.lit(123456), F.lit(789))).first()
    assert tuple(r) == (123456, 789, True)


def test_domains(spark):
    rows_ = [("www.a.co.uk", "a.co.uk", "co.uk"), ("x.y.org", "y.org", "org"), ("10.0.0.1", "10.0.0.1", "IP"), ("localhost", "localhost", "-")]
    for h, top, tld in rows_:
        assert tuple(spark.range(1).select(urls.top_domain(F.lit(h)), urls.tld(F.lit(h))).first()) == (top, tld)


def test_simhash_forms_agree(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([(text.split(),)], "w array<string>")
    a = df.select(relations.simhash(F.col("w"))).first()[0]
    from lodestone.functions import text as tx

    b = df.select(F.explode(tx.rolling_hash(F.col("w"), 2)).alias("h")).agg(*relations.simhash_votes("h")).select(relations.simhash_of_votes()).first()[0]
    assert a == b


@pytest.fixture(scope="module")
def orders_dir(spark, tmp_path_factory):
    """Orders whose customers and parts meet when their keys are folded by 1,000; some rows repeat."""
    import random

    r, at = random.Random(4), tmp_path_factory.mktemp("orders")
    keys = [1, 7, 30, 1001, 1007, 2001]
    orders = [(i, r.choice(keys)) for i in range(40)]
    items = [(i, r.choice([1, 1, 2, 30, 1001, 1002, 2001, 2002, 5001])) for i in range(40) for _ in range(3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(at / "orders.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").write.parquet(str(at / "lineitem.parquet"))
    who = dict(orders)
    return str(at), {(2 * who[i], 2 * p + 1) for i, p in items}


def test_graphs_on_whole_ids(spark, orders_dir):
    """Against brute force: no two customers or parts become one node."""
    from collections import Counter
    from itertools import combinations
    from math import sqrt

    d, edges = orders_dir
    got = lambda name: sorted(map(tuple, Q.QUERIES[name](spark, d).collect()))
    out, into = Counter(s for s, _ in edges), Counter(t for _, t in edges)
    nodes = sorted({*out, *into})
    assert got("graph_whole_degrees") == [(x, out[x], into[x]) for x in nodes]
    assert got("graph_whole_symmetric") == sorted({*edges, *((t, s) for s, t in edges)})
    of = {t: {s for s, x in edges if x == t} for t in into}
    pairs = [(a, b, len(of[a] & of[b])) for a, b in combinations(sorted(of), 2) if of[a] & of[b]]
    want = [(a, b, c, round(c / len(of[a] | of[b]), 6)) for a, b, c in pairs if min(into[a], into[b]) >= 4 and max(into[a], into[b]) <= 9 * min(into[a], into[b])]
    assert want and got("graph_whole_jaccard") == [x for x in want if x[3] >= 0.1]
    assert got("graph_whole_similarity") == [(a, b, round(c / sqrt(into[a] * into[b]), 6)) for a, b, c in pairs if c / sqrt(into[a] * into[b]) >= 0.1]
    name = {}
    for x in nodes:
        r, k = sum(t == x and s < 40 for s, t in edges), sum(s == x and t < 40 for s, t in edges)
        name[x] = "core" if x < 40 else "reachable_hot" if r >= 5 else "reachable" if r else "linking_hot" if k >= 5 else "linking" if k else "unreachable"
    assert got("graph_whole_connectivity") == sorted(name.items())


def test_whole_pagerank_converges(spark, orders_dir):
    """Against brute force run to its fixed point, on the query's graph and on one with cycles; three rounds are too few."""
    d, edges = orders_dir

    def ranks(edges, rounds):
        nodes = sorted({x for e in edges for x in e})
        out, n = {x: [t for s, t in edges if s == x] for x in nodes}, len(nodes)
        score = dict.fromkeys(nodes, 1 / n)
        for _ in range(rounds):
            new = dict.fromkeys(nodes, 0.15 / n + 0.85 * sum(score[x] for x in nodes if not out[x]) / n)
            for x in nodes:
                for t in out[x]:
                    new[t] += 0.85 * score[x] / len(out[x])
            score = new
        return score

    def off(got, want):
        assert got.keys() == want.keys()
        return max(abs(got[x] - want[x]) for x in want) * len(want)

    got = dict(map(tuple, Q.QUERIES["graph_whole_pagerank"](spark, d).collect()))
    assert off(got, ranks(edges, 300)) < 1e-3 and abs(sum(got.values()) - 1) < 1e-6
    ring = {(i, (i + 1) % 12) for i in range(12)} | {(0, 5), (3, 0), (7, 12), (2, 0)}
    frame = spark.createDataFrame(sorted(ring), "src long, dst long")
    assert off(dict(map(tuple, graph.pagerank(frame, relative=True).collect())), ranks(ring, 300)) < 1e-3 < off(ranks(ring, 3), ranks(ring, 300))


def test_near_copies_find_classes(spark, tmp_path):
    """Classes of the query against brute force over all pairs, and close hashes at chosen distances."""
    import random

    r = random.Random(6)
    base = [[f"w{r.randrange(900)}" for _ in range(400)] for _ in range(6)]
    texts = [" ".join(w[:i] + [f"n{i}"] + w[i + 1 :]) for w in base for i in (3, 50, 120, 200, 280)] + [" ".join(base[0])] * 2 + ["", "one", "two", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in Q.near_copies_simhash(spark, str(tmp_path)).collect()}
    few, root = len(texts) - 4, list(range(len(texts)))
    for _ in texts:
        for a in range(few):
            for b in range(few):
                if ((got[a].simhash ^ got[b].simhash) & (1 << 64) - 1).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert len(got) == len(texts) and [got[i].class_id for i in range(len(texts))] == root
    assert root[few - 1] == root[few - 2] and len(set(root[:few])) < few - 1
    one = [r.getrandbits(64) for _ in range(20)]
    many = {h ^ sum(1 << i for i in r.sample(range(64), k)) for h in one for k in (0, 1, 2, 3, 3, 3, 4, 4, 5)}
    signed = sorted(h - (1 << 64) if h >> 63 else h for h in many)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert set(map(tuple, relations.close_hashes(spark.createDataFrame([(h,) for h in signed], "h long")).collect())) == want


def test_near_copies_broadcast_nothing(spark, tmp_path, monkeypatch):
    """No table that grows with the documents is sent through the driver, in the rounds or after them."""
    plans = []

    class Watched(graph.Saved):
        def __init__(self, df, kind="table"):
            super().__init__(df, kind)
            plans.append(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(graph, "Saved", Watched)
    words = [f"w{i}" for i in range(300)]
    spark.createDataFrame([(i, " ".join([*words[:i], "x", *words[i + 1 :]])) for i in range(12)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = Q.near_copies_simhash(spark, str(tmp_path))
    assert len(out.collect()) == 12
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p]


def test_equal_nodes_rank_by_id(spark, tmp_path):
    """Nodes with equal links have equal scores, of which the greater id is first, however rows are dealt; against fractions."""
    import random
    from fractions import Fraction

    r, n = random.Random(4), 240
    out = {a: [b for b in range(n) if (a % 7 + 1) >> b % 3 & 1] for a in range(n)}  # nodes alike by threes
    pairs = [(a, b) for a in out for b in out[a]]
    r.shuffle(pairs)
    spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    score = dict.fromkeys(range(n), Fraction(1, n))
    for _ in range(3):
        new = {b: Fraction(3, 200) * (b < 10) for b in range(n)}
        for a, b in pairs:
            new[b] += Fraction(17, 20) * score[a] / len(out[a])
        score = new
    want = sorted(score, key=lambda x: (score[x], x), reverse=True)[:50]
    spark.createDataFrame(pairs, "src long, dst long").repartition(6).write.parquet(str(tmp_path / "e"))
    dealt = graph.ranking_set(spark.read.parquet(str(tmp_path / "e")), spark.range(10).toDF("node"), 50, fixed=3)
    assert {x.node: x.rank for x in dealt.collect()} == {x: i for i, x in enumerate(want)}
    best = {x.node: x.rank for x in Q.QUERIES["graph_ranking_set"](spark, str(tmp_path)).collect()}
    assert best == {x: i for i, x in enumerate(want)}
    stored = {x.node: x.rank for x in Q.QUERIES["graph_stored_ranks"](spark, str(tmp_path)).collect()}
    assert stored == {x: want.index(x) / 50 if x in want else 1.0 for x in range(n)}


def test_stream_changes(spark, tmp_path):
    from lodestone import streaming as S

    spark.createDataFrame([(1, 1, "view"), (2, 1, "error"), (3, 1, "view"), (4, 2, "view")], "event_id long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(str(tmp_path / "e"))
    s = S.events_stream(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema)
    got = S.run_to_table(S.changes(s), "changes").orderBy("event_id").collect()
    assert [(r.event_id, r.before, r.after) for r in got] == [(2, "up", "down"), (3, "down", "up")]
