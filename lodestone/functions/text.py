"""Text expressions, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JOINER = "_"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def flatten_quotes(text: Column) -> Column:
    return F.translate(text, "“”„‘’‚", "\"\"\"'''")


def flatten_accents(text: Column) -> Column:
    return F.translate(flatten_quotes(text), "éèêëàâäáùûüúôöóîïíçñ", "eeeeaaaauuuuoooiiicn")


def strip_possessive(word: Column) -> Column:
    return F.regexp_replace(word, "'s$", "")


def is_junk(word: Column) -> Column:
    """More than four '-', more than two '+', a '-' at either end, or more than sixteen digits."""
    count = lambda c: F.length(word) - F.length(F.replace(word, F.lit(c), F.lit("")))
    digits = F.length(word) - F.length(F.regexp_replace(word, "[0-9]", ""))
    return (count("-") > 4) | (count("+") > 2) | word.startswith("-") | word.endswith("-") | (digits > 16)


def is_discarded(word: Column) -> Column:
    return (F.length(F.trim(word)) == 0) | (F.length(word) >= 64) | word.rlike("^[/*-]+$")


def is_indexable(word: Column) -> Column:
    """At most 48 characters: a run of 1-15 letters or digits, then at most eight parts of separators and runs."""
    return (F.length(word) <= 48) & word.rlike(r"^[\p{L}\p{N}]{1,15}([-_./+:']{1,2}[\p{L}\p{N}]{0,10}){0,8}$")


def ngram_term(words: Column) -> Column:
    return F.array_join(words, JOINER)


def sentences(text: Column, most: int = 500) -> Column:
    """Split on sentence ends, ' -', '- ' and '|'; blanks go; at most ``most``."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n+|\s-|-\s|\|")
    return F.slice(F.filter(F.transform(parts, F.trim), lambda x: F.length(x) > 0), 1, most)


def rolling_hash(words: Column, n: int) -> Column:
    """A hash for each n consecutive words."""
    last = F.size(words) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<bigint>"))


def mail_parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), 1)


def is_underline(line: Column) -> Column:
    return line.rlike(r"^\s*(=+|_+|\*+)\s*$")


def plain_description(lines: Column) -> Column:
    """Lines of 16 characters or more that are over three quarters letters, joined, at most 255 characters."""
    good = F.filter(lines, lambda x: (F.length(x) >= 16) & (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) > F.length(x) * 0.75))
    return F.substring(F.array_join(good, " "), 1, 255)


def collapsed_length(text: Column) -> Column:
    return F.length(F.regexp_replace(F.trim(text), r"\s+", " "))


def title(html: Column, url: Column) -> Column:
    """The title element, else the first heading, else the URL."""
    found = [F.nullif(F.trim(F.regexp_extract(html, f"(?is)<{t}[^>]*>(.*?)</{t}>", 1)), F.lit("")) for t in ("title", "h1", "h2", "h3", "h4", "h5")]
    return F.coalesce(*found, url)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)


def forbids_indexing(html: Column) -> Column:
    return html.rlike(r"(?is)<meta[^>]+name=[\"']?robots[\"']?[^>]+content=[\"']?[^\"'>]*(noindex|none)")


def meta_refresh(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<meta[^>]+http-equiv=[\"']?refresh[\"']?[^>]+content=[\"']?\d+;\s*url=([^\"'>\s]+)", 1)


def body_text(html: Column) -> Column:
    """Text without scripts, styles, navigation and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|form)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def abbreviated(title_: Column, most: int = 128) -> Column:
    """At most so many characters, the last three dots where some are left out."""
    return F.when(F.length(title_) <= most, title_).otherwise(F.concat(F.substring(title_, 1, most - 3), F.lit("...")))
