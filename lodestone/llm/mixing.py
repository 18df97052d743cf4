"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled queue that is served up to ``epochs`` times. A served document finishes
at the virtual time (words its source has served so far) / (its source's target); the mix is all documents in order of
finish, cut where their words reach the budget: they are sorted globally by range of finish time, the words of whole
ranges are summed, and the range in which the budget is reached is cut within. Targets share the budget by weight, none above ``epochs`` times what
its source has.

Running sums never need a source in one task: a source's queue is cut into slices of the shuffle key, slices are
summed, and each slice starts from the sum of those before it.

Defined cases: a null text has no words and takes nothing; a null source is a source of its own, ordered last; rows
that repeat a doc_id are queued each by itself; rows without a doc_id are shuffled by their text; an empty table gives no rows;
other columns, whatever they are called, are left out. The cut drops all documents that finish at the very time at
which the budget would be passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Table, partitions

WORD = r"[^\x20\x09-\x0D]+"
SLICE_ROWS = 256
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """(source, sid, n, source_size, target) for each source of (source, size)."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    cycle = F.array(*map(F.lit, weights))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sid = F.row_number().over(order) - 1
    total = total.withColumn("sid", sid).withColumn("w", F.element_at(cycle, (F.col("sid") % len(weights)) + 1))
    cap = F.col("s") * epochs
    by = Window.orderBy((F.col("s") * float(epochs)) / F.col("w"), "sid")
    before = F.coalesce(F.sum(cap).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(share) * F.sum("s").over(Window.partitionBy()) - before) / rest
    total = total.withColumn("level", level)
    fits = F.max(F.when(cap >= F.col("w") * F.col("level"), F.col("level"))).over(Window.partitionBy())
    return total.select("source", "sid", "n", F.col("s").alias("source_size"), F.least(cap.cast("double"), F.col("w") * F.coalesce(fits, F.lit(0.0))).alias("target"))


def last_finish(entries: DataFrame, budget: float) -> float:
    """The largest finish time up to which the words of (finish, size) stay within the budget (-inf: none)."""
    spark = entries.sparkSession
    ranged = entries.repartitionByRange(partitions(spark), "finish").withColumn("range", F.spark_partition_id())
    ranked = Table(ranged.sortWithinPartitions("finish"), "ranked").df
    ranges = ranked.groupBy("range").agg(F.sum("size").alias("s"), F.max("finish").alias("last")).collect()  # a row a task
    base, best = 0, float("-inf")
    for r in sorted(ranges, key=lambda r: r.range):
        if base + r.s > budget:
            upto = F.sum("size").over(Window.partitionBy("range").orderBy("finish").rangeBetween(Window.unboundedPreceding, 0))
            inside = ranked.where(F.col("range") == r.range).withColumn("words", upto).where(F.col("words") + base <= budget)
            return inside.agg(F.max("finish")).first()[0] or best
        base, best = base + r.s, r.last
    return float("inf") if ranges else best


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, finish, taken): ``finish`` is the first service's virtual time."""
    size = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    key = F.md5(F.concat(F.lit(SEED + ":"), name)).alias("key")
    sized = Table(docs.select("doc_id", "source", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(size).alias("size"), key), "sizes").df
    goal = Table(targets(sized, weights, share, epochs), "targets").df
    keyed = sized.join(goal, sized.source.eqNullSafe(goal.source)).drop(goal.source)
    n_slices = F.ceil(F.col("n") / F.lit(SLICE_ROWS))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * n_slices / F.lit(float(1 << 32))).cast("long")
    keyed = keyed.withColumn("part", part)
    sums = keyed.groupBy("sid", "part").agg(F.sum("size").alias("s")).withColumn("block", F.floor(F.col("part") / 1024))
    blocks = sums.groupBy("sid", "block").agg(F.sum("s").alias("s"))
    upto = (Window.unboundedPreceding, -1)
    ahead = blocks.select("sid", "block", F.coalesce(F.sum("s").over(Window.partitionBy("sid").orderBy("block").rowsBetween(*upto)), F.lit(0)).alias("ahead"))
    inner = F.coalesce(F.sum("s").over(Window.partitionBy("sid", "block").orderBy("part").rowsBetween(*upto)), F.lit(0))
    starts = sums.withColumn("inner", inner).join(ahead, ["sid", "block"]).select("sid", "part", (F.col("inner") + F.col("ahead")).alias("start"))
    run = F.sum("size").over(Window.partitionBy("sid", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0))
    queued = keyed.withColumn("run", run).join(starts, ["sid", "part"])
    done = (F.col("start") + F.col("run")).cast("double")
    first = F.when((F.col("target") > 0) & (F.col("size") > 0), done / F.col("target"))
    queued = Table(queued.select("doc_id", "source", "size", "source_size", "target", done.alias("done"), first.alias("finish")), "queue").df
    time = lambda e: (F.col("done") + F.lit(float(e)) * F.col("source_size")) / F.col("target")
    served = queued.where(F.col("finish").isNotNull())
    entries = served.select(F.explode(F.array(*(time(e) for e in range(epochs)))).alias("finish"), "size")
    total = sized.agg(F.sum("size")).first()[0] or 0
    cut = last_finish(entries, share * total)
    times = sum((F.when(time(e) <= F.lit(cut), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    taken = F.when(F.col("finish").isNull(), F.lit(0)).otherwise(times * F.col("size")).cast("long")
    return queued.select("doc_id", "source", "size", "source_size", "target", "finish", taken.alias("taken"))


SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS th FROM documents),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS sid FROM total),
weighed AS (SELECT *, CASE sid % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM ranked),
levels AS (SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(s * 2) OVER (ORDER BY s * 2.0::DOUBLE / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(w) OVER (ORDER BY s * 2.0::DOUBLE / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
goal AS (SELECT source, sid, s AS source_size, least((s * 2)::DOUBLE, w * coalesce((SELECT max(level) FROM levels WHERE s * 2 >= w * level), 0.0)) AS target FROM levels),
queue AS (SELECT d.doc_id, d.size, g.source_size, g.target,
  sum(d.size) OVER (PARTITION BY g.sid ORDER BY md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.size ROWS UNBOUNDED PRECEDING)::DOUBLE AS done
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
entry AS (SELECT *, row_number() OVER () AS r FROM queue),
served AS (SELECT r, size, (done + e * source_size::DOUBLE) / target AS finish FROM entry, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) t(e) WHERE target > 0 AND size > 0),
cut AS (SELECT r, size, sum(size) OVER (ORDER BY finish RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words FROM served),
taken AS (SELECT r, sum(size) AS taken FROM cut WHERE words <= 1.5::DOUBLE * (SELECT sum(size) FROM sized) GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM entry LEFT JOIN taken USING (r)
"""
