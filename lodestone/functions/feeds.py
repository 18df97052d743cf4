"""Feed documents and links of pages, as expressions on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls


def element(xml: Column, *tags: str) -> Column:
    """The text of the first of several elements that isn't blank, without CDATA marks; null if none."""
    def one(tag: str) -> Column:
        inner = F.regexp_extract(xml, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
        return F.nullif(F.trim(F.regexp_replace(inner, r"<!\[CDATA\[|\]\]>", "")), F.lit(""))

    return F.coalesce(*map(one, tags))


def plain(html: Column, most: int = 512) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"&lt;", "<"), r"&gt;", ">")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " ")), 1, most)


def date(text: Column) -> Column:
    """An ISO date, from a mail date or an ISO one; blank where neither can be read."""
    mail = F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return F.coalesce(F.date_format(F.coalesce(mail, F.try_to_timestamp(text)), "yyyy-MM-dd"), F.lit(""))


def items(xml: Column, keep_fragment: bool = False) -> Column:
    """array<struct<title, date, description, url>> of a feed's items or entries, newest first."""
    link = lambda x: F.coalesce(element(x, "link", "guid"), F.nullif(F.regexp_extract(x, r"(?is)<link[^>]*href=[\"']([^\"']*)[\"']", 1), F.lit("")))
    cut = (lambda c: c) if keep_fragment else (lambda c: F.regexp_replace(c, "#.*$", ""))

    def item(x: Column) -> Column:
        return F.struct(date(element(x, "pubDate", "published", "updated", "dc:date")).alias("date"), element(x, "title").alias("title"), plain(element(x, "description", "summary", "content")).alias("description"), cut(link(x)).alias("url"))

    return F.reverse(F.array_sort(F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)(<(item|entry)\b.*?</\2>)"), 1), item)))


def base(html: Column, url: Column) -> Column:
    """The first base element that has an address, else the page's own URL."""
    return F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<base[^>]+href=[\"']([^\"']+)[\"']", 1), F.lit("")), url)


def frames(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<i?frame[^>]+src=[\"']([^\"']+)[\"']"), 1)


def resolve(href: Column, url: Column) -> Column:
    """An address as it reads on a page: absolute, without fragment; null for addresses that aren't of pages."""
    bare = F.trim(F.regexp_replace(href, "#.*$", ""))
    root = F.concat(urls.scheme(url), F.lit("://"), F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    joined = (
        F.when(bare.rlike("^(?i)https?://"), bare)
        .when(bare.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(bare.startswith("//"), F.concat(urls.scheme(url), F.lit(":"), bare))
        .when(bare.startswith("/"), F.concat(root, bare))
        .when(bare == "", F.regexp_replace(url, "#.*$", ""))
        .when(bare.startswith("?"), F.concat(root, urls.path(url), bare))
        .otherwise(F.concat(root, urls.directory(url), bare))
    )
    return F.when(joined.rlike(r"/\.\.?(/|[?#]|$)"), normal(joined)).otherwise(joined)


def normal(url: Column) -> Column:
    """A URL whose path has no . and .. segments: each .. takes the segment before it, at the root nothing."""
    head = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(url, r"([?#].*)$", 1)
    parts = F.slice(F.split(urls.path(url), "/"), 2, 1_000_000)
    last = F.element_at(parts, -1)
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.array_append(a, x))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(head, F.lit("/"), F.array_join(kept, "/"), tail)


def repaired(url: Column) -> Column:
    """Characters that may not stand in an address are percent-encoded; a stray % too."""
    out = F.regexp_replace(url, r"%(?![0-9a-fA-F]{2})", "%25")
    for c, code in {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "\\": "%5C", "^": "%5E", "`": "%60", "{": "%7B", "|": "%7C", "}": "%7D"}.items():
        out = F.replace(out, F.lit(c), F.lit(code))
    return out
