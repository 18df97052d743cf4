"""Link graphs as edge frames (src, dst): degrees, similarity, PageRank and connectivity classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Saved


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(into, "node", "full").select("node", zero("n_out"), zero("n_in"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("dst", "src")).distinct()


def similarity(edges: DataFrame, most_out: int = 1000, least: float = 0.1) -> DataFrame:
    """(a, b, value) for destinations linked from common sources: sum of w over common sources / sqrt of both sums.

    w = 1 / ln(2 + in-degree of the source). Sources with more than ``most_out`` links are hubs by definition and
    don't count as common, which also bounds the pairs a source can make.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("n_in"))
    weighed = edges.join(out, "src").join(into, "src", "left").select("src", "dst", "n_out", (1 / F.log(2.0 + F.coalesce("n_in", F.lit(0)))).alias("w"))
    norm = weighed.groupBy("dst").agg(F.sum("w").alias("s"))
    few = weighed.where(F.col("n_out") <= most_out)
    a, b = few.select("src", F.col("dst").alias("a"), "w"), few.select("src", F.col("dst").alias("b"))
    common = a.join(b, "src").where("a < b").groupBy("a", "b").agg(F.sum("w").alias("c"))
    both = common.join(norm.toDF("a", "sa"), "a").join(norm.toDF("b", "sb"), "b")
    return both.select("a", "b", (F.col("c") / F.sqrt(F.col("sa") * F.col("sb"))).alias("value")).where(F.col("value") >= least)


def jaccard(edges: DataFrame, least: float = 0.1, least_size: int = 4, most_ratio: int = 9, most_out: int = 1000) -> DataFrame:
    """(a, b, common, value) of in-neighbour sets.

    Sizes travel with the edges, so that order and size ratio are tested as pairs meet and fewer are grouped.
    """
    size = edges.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") >= least_size)
    out = edges.groupBy("src").agg(F.count("*").alias("m")).where(F.col("m") <= most_out).select("src")
    e = edges.join(size, "dst").join(out, "src", "left_semi").select("src", "dst", "n")
    a, b = e.select("src", F.col("dst").alias("a"), F.col("n").alias("na")), e.select("src", F.col("dst").alias("b"), F.col("n").alias("nb"))
    near = (F.col("a") < F.col("b")) & (F.greatest("na", "nb") <= most_ratio * F.least("na", "nb")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb"))
    common = a.join(b, "src").where(near).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    return common.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("value")).where(F.col("value") >= least)


def weight_sums(edges: DataFrame) -> DataFrame:
    """(src, total, n_out): the sum of a node's outgoing weights (w; 1 where there is none), and how many links it has."""
    w = F.sum("w") if "w" in edges.columns else F.sum(F.lit(1.0))
    return edges.groupBy("src").agg(w.alias("total"), F.count("*").alias("n_out"))


def has_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (src, dst) with ``linked`` and, for weighted edges, ``w`` (0 without an edge)."""
    w = F.max("w") if "w" in edges.columns else F.lit(1.0)
    own = edges.groupBy("src", "dst").agg(w.alias("w"))
    rows = pairs.join(own, ["src", "dst"], "left")
    return rows.select("src", "dst", F.col("w").isNotNull().alias("linked"), F.coalesce("w", F.lit(0.0)).alias("w"))


def exact_sum(value: Column) -> Column:
    """The sum of values from 0 to 1, the same in whatever order rows come: whole numbers of 2**-40, and of 2**-76 for what is left, are added.

    Sums of doubles depend on that order, so that nodes with equal links get scores apart by chance and rank by it.
    """
    high = F.floor(value * 2.0**40)
    low = F.floor((value * 2.0**40 - high) * 2.0**36)
    return F.sum(high) / F.lit(2.0**40) + F.sum(low) / F.lit(2.0**76)


def pagerank(edges: DataFrame, damping: float = 0.85, most: int = 100, tolerance: float = 1e-4, start: DataFrame | None = None, fixed: int | None = None, relative: bool = False) -> DataFrame:
    """(node, score) of edges (src, dst, and w for weights). Dangling mass goes to all nodes, or to ``start`` (node) with the teleport.

    Until no score changes by ``tolerance``, or if ``relative`` by that share of the mean score 1 / n, which holds for
    graphs of any size. Edges are dealt with their sources' sums once; each round's scores are written to the shared
    folder, so that a round's plan is that round alone and a lost executor costs no more than one. Nodes with equal
    links have equal scores, and reruns agree.
    """
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    out = weight_sums(edges)
    links = Saved(edges.join(out, "src").select("src", "dst", (w / F.col("total")).alias("share")), "links")
    nodes = Saved(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes")
    n = max(1, nodes.df.count())
    to = start.select("node").distinct().join(nodes.df, "node", "left_semi") if start is not None else nodes.df
    size = max(1, to.count()) if start is not None else n
    rows = nodes.df.join(to.withColumn("t", F.lit(1.0 / size)), "node", "left").join(out.select(F.col("src").alias("node"), F.lit(1).alias("links")), "node", "left")
    base = Saved(rows.select("node", F.coalesce("t", F.lit(0.0)).alias("t"), F.col("links").isNull().alias("dangling")), "base")
    score = Saved(base.df.select("node", "t", "dangling", F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("change")), "scores")
    enough = tolerance / n if relative else tolerance
    for _ in range(fixed or most):
        now = score.df
        sent = links.df.join(now, links.df.src == now.node).groupBy(F.col("dst").alias("node")).agg(exact_sum(F.col("score") * F.col("share")).alias("got"))
        lost = now.where("dangling").agg(F.coalesce(exact_sum(F.col("score")), F.lit(0.0)).alias("lost"))  # one row
        new = now.join(sent, "node", "left").join(F.broadcast(lost))
        value = (1 - damping) * F.col("t") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("t"))
        after = Saved(new.select("node", "t", "dangling", value.alias("score"), F.abs(value - F.col("score")).alias("change")), "scores")
        score.drop()
        score = after
        if not fixed:
            change = score.df.agg(F.max("change")).first()[0]
            if change is None or change < enough:
                break
    links.drop()
    return score.df.select("node", "score")


def top_ranked(scores: DataFrame, count: int) -> DataFrame:
    """(node, score, rank): the best, from rank 0; of equal scores the greater node comes first."""
    best = scores.orderBy(F.desc("score"), F.desc("node")).limit(count)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("node"))) - 1)  # ``count`` rows


def ranking_set(edges: DataFrame, influence: DataFrame, depth: int, similar: DataFrame | None = None, **how) -> DataFrame:
    """(node, rank): the best ``depth`` nodes as seen from the influence set, on the graph of similarity where there is a set, else on all links evenly."""
    some = influence.limit(1).count() > 0
    graph = similar if some and similar is not None else edges
    return top_ranked(pagerank(graph, start=influence if some else None, **how), depth).select("node", "rank")


def undirected(pairs: DataFrame) -> DataFrame:
    """Similar pairs (a, b, value) as edges both ways, weighted by how alike they are."""
    one = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("value").alias("w"))
    return one.union(one.select("dst", "src", "w"))


def inverted(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "_d", "dst": "_s"}).withColumnsRenamed({"_d": "dst", "_s": "src"})


#: Connectivity classes from best to worst (fixed values).
CONNECTIVITY = ("core", "bidi_hot", "reachable_hot", "linking_hot", "bidi", "reachable", "linking", "unreachable")


def primary_rank(edges: DataFrame, classes_: DataFrame | None, **how) -> DataFrame:
    """(node, rank): a place by connectivity class where that is known, else by PageRank."""
    if classes_ is not None and classes_.limit(1).count():
        place = F.array_position(F.array(*map(F.lit, CONNECTIVITY)), F.col("class")) - 1
        return classes_.select("node", place.cast("long").alias("rank"))
    return pagerank(edges, **how).select("node", F.rank().over(Window.orderBy(F.desc("score"))).cast("long").alias("rank"))


def stored_ranks(sites: DataFrame, ranked: DataFrame, size: int | None = None) -> DataFrame:
    """sites (node) with ``rank``: place / number of ranked ones, 1 for those without a place."""
    n = size if size is not None else max(1, ranked.count())
    return sites.join(ranked.select("node", F.col("rank").alias("_r")), "node", "left").withColumn("rank", F.coalesce(F.col("_r") / F.lit(float(n)), F.lit(1.0))).drop("_r")


def connectivity(edges: DataFrame, core: DataFrame, hot: int = 5) -> DataFrame:
    """(node, class): how a node stands to the core set; the first class that fits holds."""
    core = core.select("node").distinct()
    to = edges.join(core.toDF("src"), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("reached"))
    frm = edges.join(core.toDF("dst"), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("linking"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    rows = nodes.join(core.withColumn("core", F.lit(True)), "node", "left").join(to, "node", "left").join(frm, "node", "left")
    r, k = F.coalesce("reached", F.lit(0)), F.coalesce("linking", F.lit(0))
    name = F.when(F.col("core"), "core").when((r >= hot) & (k >= hot), "bidi_hot").when((r > 0) & (k > 0), "bidi").when(r >= hot, "reachable_hot").when(r > 0, "reachable").when(k >= hot, "linking_hot").when(k > 0, "linking").otherwise("unreachable")
    return rows.select("node", name.alias("class"))


def classes(edges: DataFrame) -> DataFrame:
    """(node, class) for every node of the undirected edges; class is its smallest node.

    Each round a node takes the least label around it, then that label's own; rounds go on until none changes. Each
    round's labels are written to the shared folder. Joins are merged, for labels that are broadcast pass through the driver.
    """
    both = Saved(symmetric(edges), "edges")
    first = both.df.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
    label = Saved(first.select("node", F.least("node", "m").alias("class"), F.lit(True).alias("moved")), "labels")
    while True:
        now = label.df.select("node", "class")
        around = both.df.join(now.toDF("dst", "class").hint("merge"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("class").alias("m"))
        near = now.join(around.hint("merge"), "node").select("node", F.col("class").alias("old"), F.least("class", "m").alias("to"))
        new = near.join(now.toDF("to", "jump").hint("merge"), "to")
        after = Saved(new.select("node", F.least("to", "jump").alias("class"), (F.least("to", "jump") < F.col("old")).alias("moved")), "labels")
        label.drop()
        label = after
        if not label.df.where("moved").limit(1).count():
            both.drop()
            return label.df.select("node", "class")


def scale_rank(rank) -> F.Column:
    """A rank place as 1 to 255; without a rank 255."""
    return F.coalesce(F.when(rank.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(255), F.floor(rank * 255 / 50000)))), F.lit(255)).cast("long")
