"""Registered queries of whole scores: phrases in the spans of pages, proximity, bonus and penalties, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as tx
from .operators import scoring, search
from .queries import query, table

W = search.Weights(bias="recent", temporal=0.5, max_year=1998)
SEQ = r"""p AS (SELECT page_id, regexp_extract_all(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '[a-z0-9]+') AS t, regexp_extract_all(lower(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '[a-z0-9]+') AS h,
regexp_extract_all(lower(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?s)<[^>]*>', ' ', 'g')), '[a-z0-9]+') AS b FROM pages),
s AS (SELECT page_id, t || h || b AS w, len(t) AS nt, len(h) AS nh, len(b) AS nb FROM p)"""


def sequences(spark, d):
    """(page_id, w, spans by tag): title, heading and body words one after the other, positions from 1."""
    inner = lambda tag: F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    parts = table(spark, d, "pages").select("page_id", tx.tokens(inner("title")).alias("t"), tx.tokens(inner("h1")).alias("h"), tx.tokens(F.regexp_replace(inner("article"), r"(?s)<[^>]*>", " ")).alias("b"))
    a, b, c = F.size("t"), F.size("h"), F.size("b")
    span = lambda x, n: F.when(n > 0, F.array(F.struct((x + 1).alias("start"), (x + n + 1).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return parts.select("page_id", F.concat("t", "h", "b").alias("w"), span(F.lit(0), a).alias("title"), span(a, b).alias("heading"), span(a + b, c).alias("body"))


def spans():
    return {t: F.col(t) for t in ("title", "heading", "body")}


def hits(*words: str):
    """Starts of the words one after the other in w."""
    def places(t):
        return F.filter(F.transform("w", lambda x, i: F.when(x == t, i + 1)), lambda x: x.isNotNull())

    return search.phrase_starts([(places(t), i) for i, t in enumerate(words)])


def _count(lo: str, hi: str, size: int) -> str:
    return f"len(list_filter(ats, lambda x: x >= {lo} AND x + {size} <= {hi}))"


def _hits(*words: str) -> str:
    test = " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(words))
    return f"list_filter(range(1, len(w) + 1), lambda i: {test})"


def _phrase(size: int, weights: dict[str, float], edge: bool) -> str:
    part = lambda t, c: f"CASE WHEN {c} > 0 THEN {weights[t]}::DOUBLE * {size} * (1 + ln(1 + pow({c}, {scoring.ATTENUATION.get(t, 1.0)}))) ELSE 0 END"
    ct, ch, cb = _count("1", "nt + 1", size), _count("nt + 1", "nt + nh + 1", size), _count("nt + nh + 1", "nt + nh + nb + 1", size)
    total = f"({ct} + {ch} + {cb})"
    mixed = f"CASE WHEN {total} <> len(ats) THEN {weights['body']}::DOUBLE * {size} * (1 + ln(1 + pow(greatest(1, len(ats) - {total}), 0.5))) ELSE 0 END"
    bound = f" + 1.5::DOUBLE * len(list_filter(ats, lambda x: x >= 1 AND x + {size} <= nt + 1 AND (x = 1 OR x + {size} = nt + 1)))" if edge else ""
    return f"CASE WHEN len(ats) = 0 THEN 0 ELSE {part('title', ct)} + {part('heading', ch)} + {part('body', cb)} + {mixed}{bound} END"


@query(f"WITH {SEQ}, x AS (SELECT *, {_hits('of', 'the')} AS ats FROM s) SELECT page_id, round({_phrase(2, scoring.WHOLE, True)}, 6) AS score FROM x")
def score_phrase(spark, d):
    return sequences(spark, d).select("page_id", F.round(scoring.phrase_score(hits("of", "the"), spans(), 2), 6).alias("score"))


@query(f"WITH {SEQ}, x AS (SELECT *, {_hits('of', 'the')} AS ats FROM s) SELECT page_id, round(sqrt(2 / 3.0::DOUBLE) * ({_phrase(2, scoring.PARTIAL, False)}), 6) AS score FROM x")
def score_optional_phrase(spark, d):
    s = scoring.phrase_score(hits("of", "the"), spans(), 2, scoring.PARTIAL) * F.sqrt(F.lit(2 / 3.0))
    return sequences(spark, d).select("page_id", F.round(s, 6).alias("score"))


WORD = """CASE WHEN len(ats) = 0 THEN 0 ELSE CASE WHEN nt = 1 AND list_contains(ats, 1) THEN 4.0 WHEN list_contains(ats, 1) OR (nt > 0 AND list_contains(ats, nt)) THEN 2.5::DOUBLE / sqrt(nt) WHEN len(list_filter(ats, lambda x: x <= nt)) > 0 THEN 1.0::DOUBLE / sqrt(nt) ELSE 0 END
 + 0.75::DOUBLE * sqrt(CASE WHEN nh = 1 AND list_contains(ats, nt + 1) THEN 1 ELSE 0 END) + 0.75::DOUBLE * sqrt(len(list_filter(ats, lambda x: nh > 0 AND (x = nt + 1 OR x = nt + nh)))) END"""


@query(f"WITH {SEQ}, x AS (SELECT *, {_hits('the')} AS ats FROM s) SELECT page_id, round(({WORD})::DOUBLE, 6) AS score FROM x")
def score_word(spark, d):
    return sequences(spark, d).select("page_id", F.round(scoring.word_score(hits("the"), spans()), 6).alias("score"))


@query(f"WITH {SEQ}, x AS (SELECT *, {_hits('of', 'the')} AS ats FROM s), y AS (SELECT page_id, {_phrase(2, scoring.WHOLE, True)} AS best FROM x), x1 AS (SELECT *, {_hits('the')} AS ats FROM s), z AS (SELECT page_id, {_phrase(1, scoring.PARTIAL, False)} AS part FROM x1) SELECT page_id, round(best + part * sqrt(1.0::DOUBLE / CASE WHEN best > 0 THEN 2 ELSE 1 END), 6) AS score FROM y JOIN z USING (page_id)")
def score_verbatim(spark, d):
    return sequences(spark, d).select("page_id", F.round(scoring.verbatim([(hits("of", "the"), 2)], [(hits("the"), 1)], spans()), 6).alias("score"))


@query(f"WITH {SEQ}, x AS (SELECT *, {_hits('of', 'the')} AS ats FROM s) SELECT page_id, coalesce((SELECT bit_or(1::BIGINT << least(CAST(floor(sqrt(a)) AS INTEGER), 55)) FROM (SELECT unnest(ats) AS a)), 0) AS mask FROM x")
def score_phrase_mask(spark, d):
    return sequences(spark, d).select("page_id", scoring.phrase_mask(hits("of", "the")).alias("mask"))


@query(None)
def score_spread(spark, d):
    """The least spread of three words; tests hold it against brute force."""
    return sequences(spark, d).select("page_id", scoring.min_spread([hits("of"), hits("the"), hits("and")]).alias("spread"))


BONUS = """q AS (SELECT o_orderkey, o_orderkey % 256 AS rank, o_orderkey % 4 AS sentence, o_orderkey % 16 AS quality, o_orderkey % 700 AS size, o_orderkey % 40 AS topology, year(o_orderdate) AS year, o_orderkey % 900 AS length,
['core', 'bidi_hot', 'reachable_hot', 'linking_hot', 'bidi', 'reachable', 'linking', 'unreachable'][o_orderkey % 8 + 1] AS kind, o_orderkey % 3 = 0 AS ads, o_orderkey % 5 = 0 AS kebab, o_orderkey % 7 = 0 AS wiki FROM orders),
z AS (SELECT *, CASE WHEN size = 0 THEN 10000 ELSE size END AS n FROM q),
parts AS (SELECT *, CASE WHEN sentence >= 2 THEN 0.0 ELSE -5.0 END::DOUBLE AS p1, CASE WHEN length > 200 THEN 0.0 ELSE -5.0 END::DOUBLE AS p2, CASE WHEN kind IN ('reachable', 'linking', 'unreachable') THEN -quality * 20 WHEN n < 400 AND quality < 5 THEN 0 ELSE -quality END::DOUBLE AS p3, (255 - rank) * 0.01::DOUBLE AS p4, 0.2::DOUBLE * ln(1 + topology) AS p5, -abs(year - 1998) * 0.5::DOUBLE AS p6,
CASE kind WHEN 'bidi_hot' THEN CASE WHEN n < 250 THEN 0 ELSE -0.5 END WHEN 'reachable_hot' THEN CASE WHEN n < 250 THEN 0 ELSE -1 END WHEN 'linking_hot' THEN CASE WHEN n < 250 THEN -3 ELSE -4 END WHEN 'bidi' THEN CASE WHEN n < 250 THEN -5 ELSE -7 END WHEN 'reachable' THEN CASE WHEN n < 250 THEN -5 ELSE -8 END WHEN 'linking' THEN CASE WHEN n < 250 THEN -5 ELSE -10 END WHEN 'unreachable' THEN CASE WHEN n < 250 THEN -15 ELSE -25 END ELSE 0 END::DOUBLE AS p7,
trunc(-(CASE WHEN NOT wiki AND n > 400 AND kebab THEN 5 ELSE 0 END + CASE WHEN ads THEN 7.5 ELSE 0 END * CASE WHEN NOT wiki AND n > 400 THEN 2 ELSE 1 END))::DOUBLE AS p8 FROM z)"""


def _bonus(spark, d):
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("core", "bidi_hot", "reachable_hot", "linking_hot", "bidi", "reachable", "linking", "unreachable")))
    size = (k % 700).alias("size")
    real = F.when(k % 700 == 0, 10_000).otherwise(k % 700)
    flags = scoring.feature_penalty({"advertisement": k % 3 == 0, "kebab_case_url": k % 5 == 0}, k % 7 == 0, real)
    return table(spark, d, "orders").select("o_orderkey", size, (k % 256).alias("rank"), (k % 4).alias("sentence"), (k % 16).alias("quality"), (k % 40).alias("topology"), F.year("o_orderdate").alias("year"), (k % 900).alias("length"), F.element_at(kinds, (k % 8 + 1).cast("int")).alias("kind"), flags.alias("flags"))


@query(f"WITH {BONUS} SELECT o_orderkey, round(p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8, 6) AS bonus FROM parts")
def score_document_bonus(spark, d):
    c = F.col
    b = scoring.document_bonus(c("rank"), c("sentence"), c("quality"), c("size"), c("topology"), c("year"), c("length"), c("kind"), c("flags"), W)
    return _bonus(spark, d).select("o_orderkey", F.round(b, 6).alias("bonus"))


@query(f"WITH {BONUS} SELECT o_orderkey, CAST(p8 AS INTEGER) AS flags, p7 AS connectivity, p3 AS quality FROM parts")
def score_penalties(spark, d):
    size = F.when(F.col("size") == 0, 10_000).otherwise(F.col("size"))
    q = scoring.quality_penalty(size, F.col("quality"), F.col("kind").isin(*scoring.PERIPHERAL)).cast("double")
    return _bonus(spark, d).select("o_orderkey", "flags", scoring.connectivity_penalty(F.col("kind"), size).alias("connectivity"), q.alias("quality"))


FULL = f"WITH {SEQ}, x AS (SELECT *, {_hits('of', 'the')} AS ats FROM s), v AS (SELECT page_id, len(w) AS n, nt + nh + nb AS len, {_phrase(2, scoring.WHOLE, True)} AS best FROM x)"


@query(FULL + " SELECT page_id, round(sqrt((501 + 20 * CASE WHEN len > 200 THEN 0 ELSE 5 END)::DOUBLE / (1 + best)), 6) AS score, round(best, 6) AS verbatim, CASE WHEN len > 200 THEN 0.0 ELSE 5.0 END::DOUBLE AS penalty FROM v WHERE best > 0 ORDER BY sqrt((501 + 20 * CASE WHEN len > 200 THEN 0 ELSE 5 END)::DOUBLE / (1 + best)), page_id LIMIT 50")
def score_full(spark, d):
    """The whole score, least first, with the factors it is made of."""
    rows = sequences(spark, d).select("page_id", F.size("w").alias("length"), scoring.verbatim([(hits("of", "the"), 2)], [], spans()).alias("verbatim"))
    penalty = scoring.penalty_of(F.when(F.col("length") > W.short_document, 0.0).otherwise(-W.short_document_penalty))
    made = rows.where("verbatim > 0").select("page_id", search.final_score(F.col("verbatim"), penalty).alias("score"), "verbatim", penalty.alias("penalty"))
    return made.orderBy("score", "page_id").limit(50).select("page_id", F.round("score", 6).alias("score"), F.round("verbatim", 6).alias("verbatim"), "penalty")
