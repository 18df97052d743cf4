"""Registered queries of language, keyword extraction, page trees and classification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .functions import dom, language
from .functions import text as tx
from .operators import classify
from .plugins import stem
from .queries import TOK, docs, query, table

_LANG = ", ".join(f"len(list_filter(ws, lambda t: list_contains([{', '.join(repr(w) for w in ws)}], t))) AS {k}" for k, ws in language.PROFILES.items())


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(substring(coalesce(text, ''), 1, 4096)), '[a-z0-9]+') AS ws FROM documents), c AS (SELECT doc_id, {_LANG} FROM w)
SELECT doc_id, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'en' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS lang FROM c""")
def text_language(spark, d):
    head = tx.tokens(F.substring("text", 1, 4096))
    return docs(spark, d).select("doc_id", language.language(head, "en").alias("lang"))


@query("SELECT doc_id, translate(text, '“”„‘’‚', '\"\"\"''''''') AS quotes FROM documents")
def text_flat_quotes(spark, d):
    return docs(spark, d).select("doc_id", tx.flatten_quotes(F.col("text")).alias("quotes"))


@query(r"""SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '''s( |$)', '\1', 'g') AS t FROM documents""")
def text_possessives(spark, d):
    flat = F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), "'s( |$)", "$1")
    return docs(spark, d).select("doc_id", flat.alias("t"))


@query(r"""SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: length(w) - length(replace(w, '-', '')) > 4 OR length(w) - length(replace(w, '+', '')) > 2 OR w LIKE '-%' OR w LIKE '%-' OR length(w) - length(regexp_replace(w, '[0-9]', '', 'g')) > 16)) AS junk,
len(list_filter(string_split(text, ' '), lambda w: length(trim(w)) = 0 OR length(w) >= 64 OR regexp_matches(w, '^[/*-]+$'))) AS discarded FROM documents""")
def text_junk_words(spark, d):
    words = F.split("text", " ")
    return docs(spark, d).select("doc_id", F.size(F.filter(words, tx.is_junk)).cast("long").alias("junk"), F.size(F.filter(words, tx.is_discarded)).cast("long").alias("discarded"))


@query(r"SELECT page_id, CASE WHEN length(t) > 40 THEN substring(t, 1, 37) || '...' ELSE t END AS title FROM (SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), url) AS t FROM pages)")
def text_short_titles(spark, d):
    t = tx.title(F.col("html"), F.col("url"))
    return table(spark, d, "pages").select("page_id", tx.abbreviated(t, 40).alias("title"))


@query(None)
def text_sentences(spark, d):
    """(doc_id, sentences, words) by the extractor with all its limits."""

    @pandas_udf("sentences long, words long")
    def run(text: pd.Series) -> pd.DataFrame:
        got = [language.sentences(t or "") for t in text]
        return pd.DataFrame({"sentences": [len(x) for x in got], "words": [sum(len(s.words) for s in x) for x in got]})

    return docs(spark, d).select("doc_id", run("text").alias("r")).select("doc_id", "r.*")


@query(None)
def text_stems(spark, d):
    """(stem, df): document frequencies of Porter stems."""
    rows = docs(spark, d).where("lang = 'en'").select("doc_id", F.explode(F.array_distinct(stem(tx.tokens(F.col("text")), "porter"))).alias("stem"))
    return rows.groupBy("stem").agg(F.count("*").alias("df"))


def _words_of(kind: str):
    @pandas_udf("array<struct<word:string,n:long>>")
    def run(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            s = language.sentences(t or "", whole=True)
            found = language.names(s) if kind == "names" else language.subjects(s)
            out.append([{"word": w, "n": n} for w, n in found.items()])
        return pd.Series(out)

    return run


@query(None)
def keywords_names(spark, d):
    """(doc_id, word, n) of words that look like names, from whole texts."""
    return docs(spark, d).where("lang = 'en'").select("doc_id", F.inline(_words_of("names")("text")))


@query(None)
def keywords_subjects(spark, d):
    """(doc_id, word, n) of nouns that a verb follows, from whole texts."""
    return docs(spark, d).where("lang = 'en'").select("doc_id", F.inline(_words_of("subjects")("text")))


@query(None)
def keywords_tags(spark, d):
    """(tag, n): how often each part of speech occurs in English documents."""

    @pandas_udf("map<string,long>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([dict(pd.Series([p for s in language.sentences(t or "") for p in s.pos], dtype=object).value_counts()) for t in text])

    rows = docs(spark, d).where("lang = 'en'").select(F.explode(run("text")).alias("tag", "n"))
    return rows.groupBy("tag").agg(F.sum("n").alias("n"))


@query(None)
def page_spans(spark, d):
    """(page_id, tag, start, end) of the words of each tag, elements within elements told apart."""

    @pandas_udf("array<struct<tag:string,start:int,end:int>>")
    def run(html: pd.Series) -> pd.Series:
        return pd.Series([[{"tag": t, "start": a, "end": b} for t, a, b in dom.spans_of(h or "")] for h in html])

    return table(spark, d, "pages").select("page_id", F.inline(run("html")))


@query(None)
def page_pruned(spark, d):
    """(page_id, text) without navigation and noise."""

    @pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: dom.pruned_text(h or ""))

    return table(spark, d, "pages").select("page_id", run("html").alias("text"))


@query(None)
def plain_text_titles(spark, d):
    """(doc_id, title, description) of documents taken as plain texts."""

    @pandas_udf("string")
    def title(text: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([dom.plain_title((t or "").split("\n")[:25], f"/{n}.txt") for t, n in zip(text, name, strict=True)])

    lines = F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 25)
    return docs(spark, d).select("doc_id", title("text", F.col("doc_id").cast("string")).alias("title"), tx.plain_description(lines).alias("description"))


@query(None)
def classify_documents(spark, d):
    """(doc_id, score, unfit): a net trained on two thirds of the labelled documents, applied to all."""
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs(spark, d).select("doc_id", "text").join(marks, "doc_id").where("doc_id % 3 <> 1")
    return classify.score(classify.train(rows, "toxic"), docs(spark, d).select("doc_id", "text")).select("doc_id", F.round("score", 4).alias("score"), "unfit")


@query(TOK + "SELECT doc_id, list_aggregate(list_sort(list_transform(list_filter(regexp_extract_all(lower(coalesce(any_value(t), '')), '[a-z0-9]+'), lambda w: length(w) > 12), lambda w: w)), 'count')::BIGINT AS long_words FROM (SELECT doc_id, text AS t FROM documents) GROUP BY doc_id")
def text_long_words(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.filter(tx.tokens(F.col("text")), lambda w: F.length(w) > 12)).cast("long").alias("long_words"))
