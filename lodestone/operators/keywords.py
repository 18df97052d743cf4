"""Keywords of documents: tagged positions, word flags, URL and link words, lexicon counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from . import index

#: Bits of a word's flags (fixed values).
FLAGS = {"title": 1, "subjects": 2, "names": 4, "synthetic": 8, "site": 16, "site_adjacent": 32, "url_path": 64, "url_domain": 128}
#: Elements whose text has a tag; all other text is body.
TAGS = {"title": "title", "heading": "h[1-6]", "anchor": "a", "nav": "nav|header|footer", "code": "code|pre"}


def tag_text(html: Column, tag: str) -> Column:
    """The words of all elements of a tag, in order of the page."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<({TAGS[tag]})\b[^>]*>(.*?)</({TAGS[tag]})>"), 2)
    return tx.tokens(F.regexp_replace(F.array_join(inner, " "), r"(?s)<[^>]*>", " "))


def tagged_counts(pages: DataFrame, tags: tuple[str, ...] = tuple(TAGS)) -> DataFrame:
    """(page_id, term, tag, n): one scan; counts combine before the shuffle."""
    sets = F.array(*[F.struct(F.lit(t).alias("tag"), tag_text(F.col("html"), t).alias("words")) for t in tags])
    rows = pages.select("page_id", F.inline(sets)).select("page_id", "tag", F.explode("words").alias("term"))
    return rows.groupBy("page_id", "term", "tag").agg(F.count("*").alias("n"))


def url_words(url: Column) -> Column:
    """Words of host and path with their places; www goes, and com, net and org leave a hole (null)."""
    parts = tx.tokens(F.concat(urls.host(url), F.lit(" "), urls.path(url)))
    kept = F.filter(parts, lambda w: w != "www")
    return F.transform(kept, lambda w: F.when(~w.isin("com", "net", "org"), w))


def url_positions(docs: DataFrame, length: Column, url: Column) -> DataFrame:
    """docs with (pos, term): URL words take positions after the text's last one and a gap of two."""
    return docs.select("*", F.posexplode(url_words(url)).alias("p", "term")).where("term is not null").withColumn("pos", length + 2 + F.col("p") + 1).drop("p")


def repeats(count: Column) -> Column:
    """How often a link text is taken: the root of its count, from 1 to 12."""
    return F.greatest(F.lit(1), F.least(F.floor(F.sqrt(count)), F.lit(12))).cast("long")


def assemble(sets: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, term, flags): the bits of the sets (doc_id, term) that a word is in, by one union and one aggregate."""
    rows = [df.select("doc_id", "term", F.lit(FLAGS[k]).alias("bit")) for k, df in sets.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("doc_id", "term").agg(F.bit_or("bit").alias("flags"))


def title_words(docs: DataFrame, words: int = 8, most: int = 100) -> DataFrame:
    """(doc_id, term): distinct words among a text's first, which stand for its title."""
    first = F.slice(F.array_distinct(F.slice(tx.tokens(F.col("text")), 1, words)), 1, most)
    return docs.select("doc_id", F.explode(first).alias("term"))


def tfidf_words(docs: DataFrame, least: int = 100) -> DataFrame:
    """(doc_id, term) of words that a document has more than once and whose TF-IDF value is over ``least``."""
    return index.tfidf(docs).where((F.col("tf") > 1) & (F.col("value") > least)).select("doc_id", "term")


def priority(flagged: DataFrame, any_of: tuple[str, ...] = ("title", "subjects", "names", "url_domain")) -> DataFrame:
    """The words with at least one priority flag."""
    return flagged.where(F.col("flags").bitwiseAND(sum(FLAGS[k] for k in any_of)) != 0)


def lexicon(titles: DataFrame, bodies: DataFrame, n: int = 2) -> DataFrame:
    """(gram, seen): n-grams of (words) that some title has, with their count in titles and bodies."""
    def of(df: DataFrame, title: int) -> DataFrame:
        last = F.size("words") - (n - 1)
        grams = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice("words", i, n), "_")))
        return df.select(F.explode(grams).alias("gram"), F.lit(title).alias("title"))

    both = of(titles, 1).unionByName(of(bodies, 0))
    return both.groupBy("gram").agg(F.count("*").alias("seen"), F.max("title").alias("title")).where("title = 1").select("gram", "seen")


def merge(*stats: DataFrame) -> DataFrame:
    """Term statistics (term, df, cf) of disjoint document sets as one."""
    return reduce(DataFrame.unionByName, stats).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def offsets(rows: DataFrame, key: str, count: str) -> DataFrame:
    """rows with ``start``, the sum of the counts of all smaller keys.

    Rows are dealt by ranges of the key; ranges are summed, and each range starts from the sum of those before it.
    """
    from pyspark.sql.window import Window

    from ..storage import saved

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = saved(rows.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part").agg(F.sum(count).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # a row a part
    inside = F.sum(count).over(Window.partitionBy("_part").orderBy(key)) - F.col(count)
    return ranged.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn("start", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def address_terms(ip: Column, country: Column, asn: Column, organisation: Column) -> Column:
    """The terms that a site's address gives all its documents."""
    from .filters import is_cloud

    blank = F.coalesce(country, F.lit("")) == ""
    org = F.transform(F.filter(F.split(organisation, "-"), lambda x: x != ""), lambda x: F.concat(F.lit("as:"), F.lower(x)))
    first = F.array(F.concat(F.lit("ip:"), ip), F.when(~blank, F.concat(F.lit("ip:"), F.lower(country))), F.concat(F.lit("as:"), asn.cast("string")), F.when(is_cloud(organisation), "special:cloud"))
    return F.filter(F.concat(first, F.coalesce(org, F.array().cast("array<string>"))), lambda x: x.isNotNull())


MAX_POSITIONS = 512  # of a word in a document (fixed value)


def capped(postings: DataFrame) -> DataFrame:
    """Postings with at most MAX_POSITIONS positions each, and the mask of those."""
    first = postings.withColumn("positions", F.slice("positions", 1, MAX_POSITIONS))
    return first.withColumn("mask", F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(index.position_mask(p))))


#: Hosts and users of mail addresses that tell nothing by themselves.
COMMON_HOSTS = ("hotmail.com", "gmail.com", "outlook.com", "yahoo.com")
COMMON_USERS = ("info", "webmaster", "admin", "mail", "contact")


def mail_terms(text: Column) -> Column:
    """The addresses in a text, their hosts after @, and hosts and users that aren't everyone's."""
    def terms(m: Column) -> Column:
        low = F.lower(m)
        user, host = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
        return F.array(low, F.concat(F.lit("@"), host), F.when(~host.isin(*COMMON_HOSTS), host), F.when(~user.isin(*COMMON_USERS), user))

    return F.array_distinct(F.filter(F.flatten(F.transform(tx.mail_parts(text), terms)), lambda x: x.isNotNull()))


def link_positions(counts: DataFrame, key: str, text: str, count: str) -> DataFrame:
    """(key, term, pos) of the words of link texts (key, text, count), one text after the other with gaps of two.

    A text is taken repeats() times, as many positions on each time.
    """
    from pyspark.sql.window import Window

    rows = counts.select(key, text, tx.tokens(F.col(text)).alias("_w"), repeats(F.col(count)).alias("_r")).where("size(_w) > 0")
    wide = (F.size("_w") + 2) * F.col("_r")
    rows = rows.withColumn("_off", F.sum(wide).over(Window.partitionBy(key).orderBy(text)) - wide)
    each = rows.select(key, "_w", "_off", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_r") - 1)).alias("_i"))
    return each.select(key, "_off", "_i", F.size("_w").alias("_n"), F.posexplode("_w").alias("_j", "term")).select(key, "term", (F.col("_off") + F.col("_i") * (F.col("_n") + 2) + 2 + F.col("_j") + 1).cast("long").alias("pos"))
