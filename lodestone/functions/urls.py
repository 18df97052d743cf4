"""URL and domain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))


def path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def depth(url: Column) -> Column:
    p = path(url)
    return (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))).cast("long")


def directory(url: Column) -> Column:
    return F.regexp_replace(path(url), "[^/]*$", "")


def file_name(url: Column) -> Column:
    return F.regexp_extract(path(url), "([^/]*)$", 1)


def is_ip(domain: Column) -> Column:
    return domain.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def top_domain(domain: Column) -> Column:
    """The last two labels, or three under second-level suffixes such as co.uk; addresses stay whole."""
    three = F.regexp_extract(domain, r"([^.]+\.(?:id|ac|co|org|gov|edu|com)\.[a-z]{2})$", 1)
    two = F.regexp_extract(domain, r"([^.]+\.[^.]+)$", 1)
    return F.when(is_ip(domain), domain).otherwise(F.coalesce(F.nullif(three, F.lit("")), F.nullif(two, F.lit("")), domain))


def alias(domain: Column) -> Column:
    """www. goes, or comes where the domain has no other subdomain."""
    return F.when(domain.startswith("www."), F.substring(domain, 5, 1000)).when(domain == top_domain(domain), F.concat(F.lit("www."), domain))


def tld(domain: Column) -> Column:
    top = top_domain(domain)
    return F.when(is_ip(domain), F.lit("IP")).when(top.contains("."), F.regexp_extract(top, r"^[^.]*\.(.*)$", 1)).otherwise(F.lit("-"))


def is_academic(domain: Column) -> Column:
    return domain.rlike(r"\.edu$|\.(ac|edu)\.[a-z]{2}$")


def is_binary(path_: Column) -> Column:
    return F.lower(path_).rlike(r"\.(zip|gz|bz2|xz|tar|rar|7z|exe|iso|dmg|bin|jpe?g|png|gif|webp|ico|mp[34]|avi|mov|mkv|ogg|flac|wav|pdf|docx?|xlsx?|pptx?)$")
