"""Predicates on documents, sites and links, as columns and semi or anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, urls

# ---- ranges of combined ids -----------------------------------------------------------------------------------


def domain_range(domain: Column | int, rank: Column | int = 0) -> tuple[Column, Column]:
    """[start, end) of the combined ids of a domain of the given rank bits."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    start = ids.encode_id(lit(rank), lit(domain), F.lit(0))
    return start, start + F.lit(1 << ids.DOMAIN_SHIFT)


def in_ranges(doc_id: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether an id is in one of the ranges [start, end) of combined ids without rank: plain comparisons, which are pushed to the scan."""
    return reduce(Column.__or__, [(doc_id >= a) & (doc_id < b) for a, b in ranges], F.lit(False))


def ranges_of(domains: list[int]) -> list[tuple[int, int]]:
    """The id ranges of some domains, those that touch joined into one."""
    out: list[tuple[int, int]] = []
    for d in sorted(set(domains)):
        a, b = d << ids.DOMAIN_SHIFT, (d + 1) << ids.DOMAIN_SHIFT
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


# ---- sets -----------------------------------------------------------------------------------------------------


def in_set(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows whose key is a member; a set without members lets everything pass."""
    marks = members.select(F.col(members.columns[0]).alias("_m")).distinct().withColumn("_in", F.lit(True))
    size = members.agg(F.count("*").alias("_size"))  # one row
    both = rows.join(marks, rows[key] == F.col("_m"), "left").join(F.broadcast(size))
    return both.where(F.col("_in") | (F.col("_size") == 0)).select(*rows.columns)


def without_listed(rows: DataFrame, domain: str, listed: DataFrame) -> DataFrame:
    """Rows whose domain is not listed, nor its top domain: one anti join on both keys each."""
    names = listed.select(F.col(listed.columns[0]).alias("_name")).distinct()
    top = rows.withColumn("_top", urls.top_domain(F.col(domain)))
    return top.join(names, top[domain] == names._name, "left_anti").join(names, F.col("_top") == names._name, "left_anti").drop("_top")


def without_tiers(rows: DataFrame, key: str, listed: DataFrame, tier: int) -> DataFrame:
    """``listed`` (key, tier): tier 1 takes out what is dangerous, tier 2 that and what is for adults; 0 nothing."""
    return rows.join(listed.where(F.col("tier") <= tier).select(key).distinct(), key, "left_anti") if tier else rows


def without_excluded(rows: DataFrame, key: str, blacklist: DataFrame, listed: DataFrame, tier: int, unfit: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """Blacklisted keys, listed tiers and, in tier 2, documents (doc) that the classifier finds unfit go."""
    out = without_tiers(rows.join(blacklist.select(key).distinct(), key, "left_anti"), key, listed, tier)
    return out.join(unfit.select(doc).distinct(), doc, "left_anti") if tier >= 2 and unfit is not None else out


# ---- evidence on paths ----------------------------------------------------------------------------------------


def viable(masks: Column, flags: Column) -> Column:
    """Whether the terms of a path share a bit of their position masks, or each has a flag."""
    shared = F.aggregate(masks, F.lit(-1).cast("long"), lambda a, m: a.bitwiseAND(m)) != 0
    return shared | F.forall(flags, lambda f: f != 0)


def has_evidence(flags: Column, positions: Column) -> Column:
    """A term counts as present with a flag or a position."""
    return (flags != 0) | (F.size(positions) > 0)


#: The flag that a strategy asks of every term (fixed values).
STRATEGY_FLAGS = {"RF_TITLE": "title", "RF_SUBJECT": "subjects", "RF_SITE": "site", "RF_URL": "url_path", "RF_DOMAIN": "url_domain"}


def required_flag(strategy: str) -> int:
    from .keywords import FLAGS

    name = STRATEGY_FLAGS.get(strategy)
    return FLAGS[name] if name else 0


def all_flagged(flagged: DataFrame, terms: list[str], strategy: str) -> DataFrame:
    """doc_id of documents in which each term has the strategy's flag; a strategy without one asks for the terms alone."""
    bit = required_flag(strategy)
    rows = flagged.where(F.col("term").isin(terms))
    rows = rows.where(F.col("flags").bitwiseAND(bit) != 0) if bit else rows
    return rows.groupBy("doc_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(set(terms))).select("doc_id")


# ---- documents ------------------------------------------------------------------------------------------------

#: By how much a document's length counts, by its class (fixed values).
LENGTH_FACTORS = {"normal": 1.0, "linked_once": 2.0, "linked_many": 10.0, "sideload": 25.0}


def document_class(links: Column, sideloaded: Column) -> Column:
    return F.when(sideloaded, "sideload").when(links > 1, "linked_many").when(links == 1, "linked_once").otherwise("normal")


def length_factor(kind: Column) -> Column:
    out = F.lit(1.0)
    for k, v in LENGTH_FACTORS.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def enforces_quality(kind: Column) -> Column:
    return ~kind.isin("sideload", "linked_many")


#: Why a document is not taken, first reason that holds (fixed values).
REASONS = ("LENGTH", "CONTENT_TYPE", "LANGUAGE", "STATUS", "QUALITY", "ACCEPTABLE_ADS", "FORBIDDEN", "SHORT_CIRCUIT", "PROCESSING_EXCEPTION", "BAD_CONTENT_TYPE", "BAD_CHARSET", "REDIRECT", "ROBOTS_TXT", "ERROR", "Timeout", "BAD_CANONICAL", "IRRELEVANT")


def disqualified(*checks: tuple[str, Column]) -> Column:
    """The reason of the first check that holds, null if none does."""
    for name, _ in checks:
        if name not in REASONS:
            raise ValueError(f"no such reason: {name}")
    out = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def asks_for_acceptable_ads(headers: Column, html: Column) -> Column:
    return F.coalesce(F.lower(headers).rlike(r"(?m)^x-adblock-key:"), F.lit(False)) | F.coalesce(html.rlike("(?i)<html[^>]*data-adblockkey="), F.lit(False))


# ---- links ----------------------------------------------------------------------------------------------------

_PRINTABLE = r"^[\x20-\x7e]*$"


def eligible_anchor_text(text: Column) -> Column:
    return (F.trim(text) != "") & ~text.startswith("this") & ~F.lower(text).isin("here", "click here") & text.rlike(_PRINTABLE)


def eligible_anchors(links: DataFrame, source: str = "source", url: str = "url", text: str = "text", page: str = "page") -> DataFrame:
    """Links (source page's host, target url, text, source page) that say something on another site; repeats go."""
    host = urls.host(F.col(url))
    ok = urls.scheme(F.col(url)).isin("http", "https") & (urls.top_domain(host) != "example.com") & ~F.col(text).contains(host) & (host != F.col(source)) & F.col(url).rlike(_PRINTABLE) & eligible_anchor_text(F.col(text))
    lower = links.where(ok).withColumn("_t", F.lower(text)).withColumn("_u", F.lower(url))
    return lower.dropDuplicates(["_t", "_u"]).drop("_t", "_u")


def relevant_link(href: Column, rel: Column) -> Column:
    """Links worth following: 1 to 128 characters, of pages, not binary, not marked noindex."""
    return (F.length(href).between(1, 128)) & ~F.coalesce(rel.contains("noindex"), F.lit(False)) & ~href.rlike(r"^(?i)(mailto|javascript|tel|data|ftp):") & ~urls.is_binary(href)


def valid_item_date(date: Column, today: Column | None = None) -> Column:
    """ISO dates compare as text."""
    return (F.trim(F.coalesce(date, F.lit(""))) != "") & (date <= F.date_format(today if today is not None else F.current_date(), "yyyy-MM-dd"))


def shown_as_similar(live: Column, relatedness: Column, linked: Column) -> Column:
    """Weak neighbours are shown only if they are live, weaker ones only if they link too."""
    return (live | (relatedness > 50)) & (linked | (relatedness > 25))


# ---- sites ----------------------------------------------------------------------------------------------------

#: Parts of the names of organisations that host clouds (fixed values).
CLOUDS = ("MICROSOFT-AZURE", "AMAZON", "CLOUDFLARE", "GOOGLE-CLOUD", "DIGITALOCEAN", "ALIBABA")


def is_cloud(organisation: Column) -> Column:
    return reduce(Column.__or__, [organisation.contains(x) for x in CLOUDS])


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number, null for anything else."""
    p = F.split(ip, r"\.")
    n = sum((F.element_at(p, i + 1).cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    return F.when(urls.is_ip(ip), n)


def without_banned(rows: DataFrame, domain: str, ip: str, cidrs: DataFrame) -> DataFrame:
    """Rows whose address is in none of the networks (cidr), whose top domain isn't .cn and whose host hasn't four digits in a row.

    A network of prefix length p is an equality on the address without its last 32 - p bits, so that each length that
    occurs is an equi-join; there are 33 of them at most.
    """
    part = F.split("cidr", "/")
    nets = cidrs.select(ip_number(F.element_at(part, 1)).alias("a"), F.element_at(part, 2).cast("int").alias("p"))
    nets = nets.withColumn("_net", F.expr("shiftright(a, 32 - p)")).select("p", "_net").distinct()
    keys = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda p: F.struct(p.alias("p"), F.call_function("shiftright", F.col("_ip"), 32 - p).alias("_net")))
    own = rows.withColumn("_ip", ip_number(F.col(ip)))
    hit = own.select(F.col(ip).alias("_bad"), F.explode(keys).alias("k")).select("_bad", "k.p", "k._net").distinct().join(nets, ["p", "_net"], "left_semi").select("_bad").distinct()
    ok = ~F.col(domain).endswith(".cn") & ~F.col(domain).rlike(r"\d{4}")
    return rows.where(ok).join(hit, rows[ip] == hit._bad, "left_anti")


NOT_FOUND = r"(?i)404|page not found|domain (is )?for sale|parked domain"


def promising_site(status: Column, content_type: Column, html: Column) -> Column:
    """Whether a new site's front page is worth a crawl: found, HTML, some text, no parking page, no redirect, a link of its own."""
    from ..functions import text as tx

    head = F.substring(html, 1, 8192)
    words = tx.body_text(head)
    return (status == 200) & content_type.startswith("text/html") & (F.length(words) >= 100) & ~words.rlike(NOT_FOUND) & (tx.meta_refresh(html) == "") & html.rlike(r'(?i)<a[^>]+href="(/|[^":]*")')
