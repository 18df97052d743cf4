"""Parts of a document's score, as expressions; weights are arguments where the engine leaves them open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keywords import FLAGS

#: How much a word counts by the tag it stands in (fixed values).
TAG_WEIGHTS = {"title": 2.5, "heading": 1.25, "anchor": 0.2, "nav": 0.1, "code": 0.25, "body": 1.0, "external": 1.5, "url": 0.5}


def has(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(FLAGS[name]) != 0


def tag_weight(tag: Column) -> Column:
    out = F.lit(1.0)
    for k, v in TAG_WEIGHTS.items():
        out = F.when(tag == k, F.lit(v)).otherwise(out)
    return out


def flag_count(flags: Column, weighted: Column | float = 0.0) -> Column:
    """What a word's flags count for; subjects and names count if the word's weighted count is over two."""
    weighted = F.lit(weighted) if isinstance(weighted, float) else weighted
    url = F.when(has(flags, "url_domain"), 3.0).when(has(flags, "url_path"), 1.0).otherwise(0.0)
    more = {"site": 0.5, "site_adjacent": 0.5, "title": 1.5}
    often = F.when(has(flags, "subjects"), 1.25).otherwise(0.0) + F.when(has(flags, "names"), 0.25).otherwise(0.0)
    return sum((F.when(has(flags, k), v).otherwise(0.0) for k, v in more.items()), url) + F.when(weighted > 2, often).otherwise(0.0)


def flag_bm25(count: Column, df: Column, n: Column, k1: float = 1.2) -> Column:
    """BM25 without length normalisation over a count made from flags."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * count * (k1 + 1) / (count + k1)


def proximity(distance: Column, words: int) -> Column:
    return F.when((distance > 0) & (distance < words + 8), 2 / (0.1 + F.sqrt(distance))).otherwise(0.0)


def first_position(first: Column, weight: float = 1.0) -> Column:
    """``first``: the greatest of the terms' first positions."""
    return weight / F.sqrt(first)


def temporal_bias(year: Column, edge: int, weight: float) -> Column:
    return -F.abs(year - edge) * weight


def display_mask(positions: Column) -> Column:
    """A bit at the root of each position."""
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.floor(F.sqrt(p)), F.lit(55)).cast("int"))
    return F.aggregate(positions, F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(bit(p)))


# ---- phrases in the spans of tags -----------------------------------------------------------------------------

#: What a whole phrase, a part of it and repetition count for by tag (fixed values).
WHOLE = {"title": 3.0, "heading": 1.5, "anchor": 0.2, "nav": 0.1, "code": 0.25, "body": 1.0, "external": 2.0, "url": 0.75}
PARTIAL = {"title": 2.25, "heading": 1.0, "anchor": 0.2, "nav": 0.1, "code": 0.25, "body": 0.5, "external": 1.5, "url": 0.5}
ATTENUATION = {"body": 0.5, "heading": 0.5, "anchor": 0.3, "code": 0.3, "nav": 0.3}


def hits_in(spans: Column, hits: Column, size: int, how: str = "inside") -> Column:
    """How many of the phrase's starts lie with all its words in a span: inside, exact or at its boundary."""
    inside = lambda h, s: (h >= s["start"]) & (h + size <= s["end"])
    exact = lambda h, s: (h == s["start"]) & (h + size == s["end"])
    edge = lambda h, s: inside(h, s) & ((h == s["start"]) | (h + size == s["end"]))
    test = {"inside": inside, "exact": exact, "boundary": edge}[how]
    return F.size(F.filter(hits, lambda h: F.exists(spans, lambda s: test(h, s))))


def span_length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda a, s: a + (s["end"] - s["start"]).cast("int"))


def _repeated(weight: float, size: int, count: Column, attenuation: float) -> Column:
    return weight * size * (1 + F.log(1 + F.pow(count.cast("double"), F.lit(attenuation))))


def phrase_score(hits: Column, spans: dict[str, Column], size: int, weights: dict[str, float] = WHOLE) -> Column:
    """Each tag's share for the starts in its spans; starts across tags count as body, a phrase at a title's edge more."""
    counts = {t: hits_in(s, hits, size) for t, s in spans.items()}
    parts = [F.when(c > 0, _repeated(weights[t], size, c, ATTENUATION.get(t, 1.0))).otherwise(0.0) for t, c in counts.items()]
    total = sum(counts.values(), F.lit(0))
    mixed = F.greatest(F.lit(1), F.size(hits) - total)
    across = F.when(total != F.size(hits), _repeated(weights["body"], size, mixed, ATTENUATION["body"])).otherwise(0.0)
    edge = 1.5 * hits_in(spans["title"], hits, size, "boundary") if weights is WHOLE and "title" in spans else F.lit(0.0)
    return F.when(F.size(hits) > 0, sum(parts, F.lit(0.0)) + across + edge).otherwise(0.0)


def word_score(hits: Column, spans: dict[str, Column]) -> Column:
    """A single word: mostly titles, headings and link texts, as BM25 has the body."""
    title, heading, link = (spans.get(t) for t in ("title", "heading", "external"))
    none = F.lit(0.0)
    length = F.sqrt(span_length(title).cast("double")) if title is not None else none
    in_title = F.when(hits_in(title, hits, 1, "exact") > 0, 4.0).when(hits_in(title, hits, 1, "boundary") > 0, 2.5 / length).when(hits_in(title, hits, 1) > 0, 1.0 / length).otherwise(0.0) if title is not None else none
    in_heading = sum((0.75 * F.sqrt(hits_in(heading, hits, 1, how).cast("double")) for how in ("exact", "boundary")), none) if heading is not None else none
    in_link = none
    if link is not None:
        exact = hits_in(link, hits, 1, "exact")
        in_link = 1.5 * exact + 0.5 * F.sqrt((hits_in(link, hits, 1) - exact).cast("double"))
    return F.when(F.size(hits) > 0, in_title + in_heading + in_link).otherwise(0.0)


def verbatim(full: list[tuple[Column, int]], optional: list[tuple[Column, int]], spans: dict[str, Column]) -> Column:
    """The best of the full groups (starts, size) and all optional ones, these by the root of their share of the best one's size."""
    scores = [word_score(h, spans) if n == 1 else phrase_score(h, spans, n) for h, n in full]
    best = F.greatest(F.lit(0.0), *scores) if scores else F.lit(0.0)
    size = F.lit(1.0)
    for s, (_, n) in reversed(list(zip(scores, full, strict=True))):
        size = F.when((s == best) & (best > 0), float(n)).otherwise(size)
    return best + sum((phrase_score(h, spans, n, PARTIAL) * F.sqrt(F.lit(float(n)) / size) for h, n in optional), F.lit(0.0))


def min_spread(first: list[Column]) -> Column:
    """The least spread of one position of each list; lists of more than 16 are passed over, as all of too few are."""
    short = [F.when(F.size(p) <= 16, p).otherwise(F.array().cast("array<int>")) for p in first]

    def tagged_by(p, i):
        return F.transform(p, lambda x: F.struct(x.cast("int").alias("p"), F.lit(i).alias("k")))

    tagged = F.array_sort(F.flatten(F.array(*[tagged_by(p, i) for i, p in enumerate(short)])))
    n = len(first)
    live = sum((F.when(F.size(p) > 0, 1).otherwise(0) for p in short), F.lit(0))
    start = F.struct(F.array(*[F.lit(-1)] * n).alias("last"), F.lit(2147483647).alias("best"))

    def step(a, x):
        last = F.transform(a["last"], lambda v, i: F.when(i == x["k"], x["p"]).otherwise(v))
        seen = F.filter(last, lambda v: v >= 0)
        spread = F.array_max(seen) - F.array_min(seen)
        return F.struct(last.alias("last"), F.when((F.size(seen) == live) & (spread < a["best"]), spread).otherwise(a["best"]).alias("best"))

    return F.when(live > 1, F.aggregate(tagged, start, step)["best"])


def proximity_factor(spread: Column, terms: int, in_title: Column, in_heading: Column, words: int, verbatim_title: Column, verbatim_heading: Column, title: Column, heading: Column) -> Column:
    """Closeness for queries of more than two words, and bonuses where all words stand in the title or a heading, though not as a phrase."""
    near = proximity(spread, terms) if terms > 2 else F.lit(0.0)
    near = F.coalesce(near, F.lit(0.0))
    titled = F.when(~verbatim_title & (F.lit(words) >= 2) & (in_title == words), in_title * (2.5 + 2.0 / F.greatest(F.lit(1), title))).otherwise(0.0)
    headed = F.when((heading < 64) & ~verbatim_heading & (in_heading == words), 1.0 * in_heading).otherwise(0.0)
    return near + titled + headed


# ---- documents ------------------------------------------------------------------------------------------------

#: By connectivity class: what a small site (size below 250) and a larger one lose (fixed values).
CONNECTIVITY_PENALTY = {"bidi_hot": (0.0, -0.5), "reachable_hot": (0.0, -1.0), "linking_hot": (-3.0, -4.0), "bidi": (-5.0, -7.0), "reachable": (-5.0, -8.0), "linking": (-5.0, -10.0), "unreachable": (-15.0, -25.0)}
#: What features cost (fixed values); all are doubled on large sites that aren't forums, wikis or documentation.
FEATURE_PENALTY = {"advertisement": 7.5, "consent": 2.5, "popover": 2.5, "tracking_adtech": 5.0, "affiliate_link": 5.0, "cookies": 2.5, "tracking": 2.5, "short_document": 5.0}
PERIPHERAL = ("reachable", "linking", "unreachable")


def connectivity_penalty(kind: Column, size: Column) -> Column:
    out = F.lit(0.0)
    for k, (small, large) in CONNECTIVITY_PENALTY.items():
        out = F.when(kind == k, F.when(size < 250, small).otherwise(large)).otherwise(out)
    return out


def quality_penalty(size: Column, quality: Column, peripheral: Column, weight: float = 1.0) -> Column:
    return F.when(peripheral, -quality * weight * 20).when((size < 400) & (quality < 5), 0.0).otherwise(-quality * weight)


def feature_penalty(features: dict[str, Column], exempt: Column, size: Column) -> Column:
    """``features``: which are present; those of the URL count on large sites only. Cut to a whole number."""
    large = ~exempt & (size > 400)
    no = F.lit(False)
    url = F.when(large & (features.get("kebab_case_url", no) | features.get("long_url", no)), 5.0).otherwise(0.0)
    other = sum((F.when(features.get(k, no), v).otherwise(0.0) for k, v in FEATURE_PENALTY.items()), F.lit(0.0))
    any_ = features.get("kebab_case_url", no)
    for c in features.values():
        any_ = any_ | c
    return F.when(any_, -(url + other * F.when(large, 2.0).otherwise(1.0))).otherwise(0.0).cast("int")


def document_bonus(rank: Column, sentence: Column, quality: Column, size: Column, topology: Column, year: Column, length: Column, kind: Column, flags: Column, weights) -> Column:
    """The sum of all terms; only what is negative of it is used, as a penalty. A size of 0 is unknown and counts as 10,000."""
    size = F.when(size == 0, 10_000).otherwise(size)
    edge = {"recent": weights.max_year, "old": weights.min_year}.get(weights.bias)
    parts = [
        F.when(sentence >= weights.short_sentence, 0.0).otherwise(-weights.short_sentence_penalty),
        F.when(length > weights.short_document, 0.0).otherwise(-weights.short_document_penalty),
        quality_penalty(size, quality, kind.isin(*PERIPHERAL), weights.quality),
        (255.0 - rank) * weights.rank,
        0.2 * F.log(1.0 + topology),
        temporal_bias(year, edge, weights.temporal) if edge else F.lit(0.0),
        connectivity_penalty(kind, size),
        flags,
    ]
    return sum(parts, F.lit(0.0))


def penalty_of(bonus: Column) -> Column:
    """The negative part, as a positive number."""
    return -F.least(F.lit(0.0), bonus)


def phrase_mask(hits: Column) -> Column:
    """display_mask() of a phrase's starts."""
    return display_mask(hits)
