"""Preference formatting: paired chosen and rejected conversations with their shared turns as the prompt.

The longest common prefix of turns (same role and text in the same order) is rendered once as the prompt; what follows
in either conversation is its completion. Masks are the [start, end) character spans of a completion that are learned:
the content of assistant turns and the marker that ends it.

Defined cases: turns go by (turn, role, text), nulls first, repeated rows being turns of their own; a null role or
text is rendered as empty; texts are escaped so that they cannot hold a marker; a conversation that is a prefix of the
other has an empty completion; without any shared turn the prompt is empty; a null conv_id and a conversation without
a partner belong to no pair; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN = "struct<turn:bigint,role:string,text:string>"


def by_parity(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): conversation 2n is chosen over 2n + 1."""
    ids = conversations.where("conv_id is not null").select("conv_id").distinct()
    pair = F.floor(F.col("conv_id") / 2)
    return ids.groupBy(pair.alias("pair_id")).agg(F.min("conv_id").alias("chosen"), F.max("conv_id").alias("rejected")).where("chosen <> rejected")


def _shown(role: Column, text: Column) -> tuple[Column, Column]:
    clean = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("<|im_"), F.lit("<|\\im_"))
    return F.concat(F.lit(OPEN), clean(role), F.lit("\n")), F.concat(clean(text), F.lit(CLOSE))


def render(turns: Column) -> Column:
    def one(t):
        head, body = _shown(t["role"], t["text"])
        return F.concat(head, body, F.lit("\n"))

    return F.array_join(F.transform(turns, one), "")


def mask(turns: Column) -> Column:
    """The spans of assistant turns in render(turns), as start-end,start-end."""

    def sizes(t):
        head, body = _shown(t["role"], t["text"])
        return F.struct(F.length(head).alias("h"), F.length(body).alias("b"), t["role"].eqNullSafe(F.lit("assistant")).alias("learn"))

    def step(acc, t):
        start = acc["at"] + t["h"]
        span = F.concat(start.cast("string"), F.lit("-"), (start + t["b"]).cast("string"))
        return F.struct((start + t["b"] + 1).alias("at"), F.when(t["learn"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(F.transform(turns, sizes), empty, step)["out"], ",")


def preference(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) for each
    of the pairs (pair_id, chosen, rejected); by_parity() without any."""
    if pairs is None:
        pairs = by_parity(conversations)
    sides = pairs.select("pair_id", F.col("chosen").alias("conv_id"), F.lit(0).alias("side")).union(pairs.select("pair_id", "rejected", F.lit(1)))
    rows = conversations.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), "role", "text").alias("t")).join(sides, "conv_id")
    side = lambda i: F.sort_array(F.collect_list(F.when(F.col("side") == i, F.col("t"))))
    first = lambda i: F.max(F.when(F.col("side") == i, F.col("conv_id")))
    both = rows.groupBy("pair_id").agg(side(0).alias("c"), side(1).alias("r"), first(0).alias("chosen_id"), first(1).alias("rejected_id")).where("size(c) > 0 and size(r) > 0")
    n = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, n), F.slice("r", 1, n), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, False)
    both = both.withColumn("p", F.when(differs > 0, differs - 1).otherwise(n).cast("int"))
    rest = lambda c: F.slice(c, F.col("p") + 1, F.size(c))
    return both.select("pair_id", "chosen_id", "rejected_id", F.col("p").cast("long").alias("prompt_turns"), render(F.slice("c", 1, F.col("p"))).alias("prompt"), render(rest("c")).alias("chosen"), render(rest("r")).alias("rejected"), mask(rest("c")).alias("chosen_mask"), mask(rest("r")).alias("rejected_mask"))


SQL = r"""
WITH t AS (SELECT conv_id, conv_id // 2 AS pair_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role) NULLS FIRST, encode(text) NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT pair_id, min(conv_id) AS c, max(conv_id) AS r FROM t GROUP BY pair_id HAVING min(conv_id) <> max(conv_id)),
m AS (SELECT p.pair_id, c, r, coalesce(min(d.i) - 1, (SELECT min(n) FROM (SELECT count(*) AS n FROM t WHERE t.conv_id IN (c, r) GROUP BY t.conv_id))) AS k
  FROM p LEFT JOIN (SELECT x.pair_id, x.i FROM p JOIN t x ON x.conv_id = p.c JOIN t y ON y.conv_id = p.r AND y.i = x.i WHERE x.role IS DISTINCT FROM y.role OR x.text IS DISTINCT FROM y.text) d ON d.pair_id = p.pair_id
  GROUP BY p.pair_id, c, r),
s AS (SELECT conv_id, i, role, '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<|\im_') || chr(10) AS head, replace(coalesce(text, ''), '<|im_', '<|\im_') || '<|im_end|>' AS body FROM t),
o AS (SELECT m.pair_id, s.*, s.i <= m.k AS shared, sum(CASE WHEN s.i > m.k THEN length(head) + length(body) + 1 ELSE 0 END) OVER (PARTITION BY s.conv_id ORDER BY s.i) - length(body) - 1 AS pos FROM m JOIN s ON s.conv_id IN (m.c, m.r)),
g AS (SELECT conv_id, coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE shared), '') AS prompt, coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE NOT shared), '') AS own,
  coalesce(string_agg(CAST(pos AS BIGINT) || '-' || CAST(pos + length(body) AS BIGINT), ',' ORDER BY i) FILTER (WHERE NOT shared AND role = 'assistant'), '') AS mask FROM o GROUP BY conv_id)
SELECT m.pair_id, c AS chosen_id, r AS rejected_id, CAST(k AS BIGINT) AS prompt_turns, x.prompt, x.own AS chosen, y.own AS rejected, x.mask AS chosen_mask, y.mask AS rejected_mask
FROM m JOIN g x ON x.conv_id = c JOIN g y ON y.conv_id = r
"""
