"""Views over sites and their relations: neighbours, URLs, selections, availability, work lists, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---- names and ids --------------------------------------------------------------------------------------------


def with_ids(rows: DataFrame, name: str, names: DataFrame, id_: str) -> DataFrame:
    """rows with the id of each name; names that no table has get -1, which nothing matches."""
    known = names.select(F.col(names.columns[0]).alias("_name"), F.col(id_))
    return rows.join(known, rows[name] == F.col("_name"), "left").drop("_name").withColumn(id_, F.coalesce(id_, F.lit(-1)))


def values_of(keys: DataFrame, key: str, table: DataFrame, value: str, otherwise=0) -> DataFrame:
    """keys with their values, ``otherwise`` where there is none (a batched point lookup)."""
    return keys.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(otherwise)))


def marked(rows: DataFrame, key: str, other: DataFrame, name: str) -> DataFrame:
    """rows with a boolean for whether the other side has their key."""
    return rows.join(other.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


# ---- neighbours -----------------------------------------------------------------------------------------------


def neighbour_view(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """(domain_id, domain_name, neighbour_id, neighbour_name, relatedness in hundredths) of (a, b, value)."""
    d = sites.select(F.col("id").alias("domain_id"), F.col("name").alias("domain_name"))
    n = sites.select(F.col("id").alias("neighbour_id"), F.col("name").alias("neighbour_name"))
    rows = pairs.select(F.col("a").alias("domain_id"), F.col("b").alias("neighbour_id"), F.round(100 * F.col("value")).alias("relatedness"))
    return rows.join(d, "domain_id").join(n, "neighbour_id").select("domain_id", "domain_name", "neighbour_id", "neighbour_name", "relatedness")


def related(pairs: DataFrame, sites: DataFrame, limit_per: int | None = None) -> DataFrame:
    """(domain_id, other, name, relatedness, mutual) of each domain's neighbours; mutual: whether they have it too."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("_back"))
    rows = pairs.join(back, ["a", "b"], "left").join(sites.select(F.col("id").alias("b"), "name"), "b")
    out = rows.groupBy("a", "b", "name").agg(F.max("value").alias("relatedness"), F.max(F.coalesce("_back", F.lit(False))).alias("mutual"))
    out = out.select(F.col("a").alias("domain_id"), F.col("b").alias("other"), "name", "relatedness", "mutual")
    if limit_per is None:
        return out
    w = Window.partitionBy("domain_id").orderBy(F.desc("relatedness"), "other")
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit_per).drop("_n")


def reversed_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")


def similar_with_screenshot(view: DataFrame, screenshots: DataFrame, sites: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Neighbours of the view that have a screenshot and are known and not blacklisted, one row a pair."""
    shown = screenshots.select(F.col("name").alias("neighbour_name")).distinct()
    rows = view.join(shown, "neighbour_name", "left_semi").join(sites.select(F.col("id").alias("neighbour_id"), "indexed"), "neighbour_id").join(blacklist.select(F.col("id").alias("neighbour_id")), "neighbour_id", "left_anti")
    return rows.groupBy("domain_id", "neighbour_id", "neighbour_name").agg(F.max("relatedness").alias("relatedness"), F.max("indexed").alias("indexed"))


def linking(edges: DataFrame, node: int, rank: DataFrame, relatedness: DataFrame, count: int) -> DataFrame:
    """(other, rank, relatedness, direction) of the nodes linked with one, either way, best first.

    direction is 3 for links both ways, 2 for those that link to it and 1 for those that it links to.
    """
    to = edges.where(F.col("dst") == node).select(F.col("src").alias("other"), F.lit(2).alias("d"))
    frm = edges.where(F.col("src") == node).select(F.col("dst").alias("other"), F.lit(1).alias("d"))
    both = to.union(frm).distinct().groupBy("other").agg(F.sum("d").alias("direction"))
    rows = both.join(rank.select(F.col("node").alias("other"), "rank"), "other", "left").join(relatedness.select("other", "relatedness"), "other", "left")
    rows = rows.select("other", F.coalesce("rank", F.lit(0.0)).alias("rank"), F.coalesce("relatedness", F.lit(0.0)).alias("relatedness"), "direction")
    return rows.orderBy(F.desc("rank"), F.desc("relatedness"), F.desc("direction"), "other").limit(count)


# ---- sites ----------------------------------------------------------------------------------------------------


def url_view(urls_: DataFrame, sites: DataFrame, data: DataFrame) -> DataFrame:
    """Addresses (id, domain_id, proto, port, path, param) put together, with what is known of their pages (left join)."""
    whole = F.concat("proto", F.lit("://"), "name", F.when(F.col("port").isNull(), "").otherwise(F.concat(F.lit(":"), F.col("port").cast("string"))), "path", F.when(F.col("param").isNull(), "").otherwise(F.concat(F.lit("?"), "param")))
    rows = urls_.join(data, "id", "left").join(sites.select(F.col("id").alias("domain_id"), "name"), "domain_id")
    return rows.select("id", whole.alias("url"), "domain_id", F.col("name").alias("domain"), *[c for c in data.columns if c != "id"])


def shuffled(rows: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``count`` rows in a random order that the seed fixes; the limit is the feature."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(count)


def random_sites(chosen: DataFrame, sites: DataFrame, availability: DataFrame, sets: tuple[int, ...]) -> DataFrame:
    """(id, name, indexed) of sites in one of the sets that are in a good state, available and no alias."""
    rows = chosen.where(F.col("domain_set").isin(*sets)).join(sites, "id").join(availability, "id", "left")
    return rows.where((F.col("state") < 2) & F.col("available") & F.col("alias").isNull()).select("id", "name", "indexed").distinct()


def selection(selected: DataFrame, types: DataFrame, sites: DataFrame, kind: str) -> DataFrame:
    """Ids of the sites selected under a named type."""
    own = types.where(F.col("type_name") == kind).select("type_id")
    return selected.join(own, "type_id").join(sites.select("id", "name"), "name").select("id").distinct()


def history(sites: DataFrame, security: DataFrame, availability: DataFrame, key: str = "id") -> DataFrame:
    """Every site with its last security and availability records, null where it has none."""
    return sites.join(security, key, "left").join(availability, key, "left")


# ---- work lists -----------------------------------------------------------------------------------------------


def due(rows: DataFrame, at: str, key: str, count: int) -> DataFrame:
    """Those never done first, then the earliest."""
    return rows.orderBy(F.asc_nulls_first(at), key).limit(count)


def before(rows: DataFrame, key: str, last: int | None, size: int) -> DataFrame:
    """Keyset paging downwards: the next ``size`` rows below ``last``."""
    rows = rows.where(F.col(key) < last) if last is not None else rows
    return rows.orderBy(F.desc(key)).limit(size)


def queue(rows: DataFrame, state: str, value: str, priority: str, key: str, most: int = 2000) -> DataFrame:
    return rows.where(F.col(state) == value).orderBy(F.desc(priority), key).limit(most)


def allocate(new: DataFrame, load: DataFrame, key: str = "name", wide: dict[str, int] | None = None, top: Column | None = None) -> DataFrame:
    """new with ``node``: each to the least loaded of the nodes (node, n), as if one after the other in order of key.

    A node of load n takes its i-th newcomer when all loads reach n + i, so that the order in which places fall is that
    of (n + i, node): the first places, as many as there are newcomers, are numbered by ranges and matched by number.
    Subdomains of wide roots go to the node named for them.
    """
    from .keywords import offsets

    fixed = F.create_map(*[F.lit(x) for k, v in (wide or {}).items() for x in (k, v)]) if wide else None
    rows = new.withColumn("_fixed", fixed[top] if fixed is not None and top is not None else F.lit(None).cast("int"))
    free = numbered(rows.where("_fixed is null"), key)
    n = free.agg(F.count("*").alias("_n"))  # one row
    low = load.agg(F.min("n").alias("_low"))
    span = load.join(F.broadcast(n)).join(F.broadcast(low))
    places = span.select("node", F.explode(F.when(F.col("_low") + F.col("_n") >= F.col("n"), F.sequence(F.col("n"), F.col("_low") + F.col("_n")))).alias("_at"))
    level = places.groupBy("_at").agg(F.count("*").alias("_c"))
    start = offsets(level, "_at", "_c").select("_at", F.col("start").alias("_s"))
    w = Window.partitionBy("_at").orderBy("node")
    place = places.withColumn("_i", F.row_number().over(w) - 1).join(start, "_at").select("node", (F.col("_s") + F.col("_i")).alias("_place"))
    placed = free.join(place, free._number == place._place).select(*new.columns, "node")
    return placed.unionByName(rows.where("_fixed is not null").select(*new.columns, F.col("_fixed").alias("node")))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``_number``, their place in the order of key from 0: ranges are counted first, rows numbered within them."""
    from ..storage import saved

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = saved(rows.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_c"))
    before_ = sizes.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))  # a row a part
    w = Window.partitionBy("_part").orderBy(key)
    return ranged.join(F.broadcast(before_), "_part").withColumn("_number", F.col("_before") + F.row_number().over(w) - 1).drop("_part", "_before")


# ---- links and pages ------------------------------------------------------------------------------------------


def topology(pages: DataFrame, links: DataFrame, anchors: DataFrame) -> DataFrame:
    """(url, domain, size, topology): links from pages of the same domain plus outside anchors; size: the domain's pages."""
    inner = links.join(pages.select(F.col("url").alias("src"), F.col("domain").alias("a")), "src").join(pages.select(F.col("url").alias("dst"), F.col("domain").alias("b")), "dst").where("a = b")
    into = inner.select("src", "dst").distinct().groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("_in"))
    outside = anchors.groupBy("url").agg(F.sum("cnt").alias("_out"))
    size = pages.groupBy("domain").agg(F.count("*").alias("size"))
    rows = pages.join(into, "url", "left").join(outside, "url", "left").join(size, "domain")
    return rows.select("url", "domain", "size", (F.coalesce("_in", F.lit(0)) + F.coalesce("_out", F.lit(0))).alias("topology"))


def adjacent_words(links: DataFrame, top_words: DataFrame, least: int = 3) -> DataFrame:
    """(url, word): words of a page's own that more than ``least`` pages which link to it have among their top words."""
    linking_ = links.select("src", "dst").distinct().join(top_words.select(F.col("url").alias("src"), "word"), "src")
    often = linking_.groupBy(F.col("dst").alias("url"), "word").agg(F.count("*").alias("_n")).where(F.col("_n") > least)
    return often.join(top_words.select("url", "word").distinct(), ["url", "word"], "left_semi").select("url", "word")


def with_alias_links(links: DataFrame, domain: str, alias: Column) -> DataFrame:
    """Links (dest, ...) of each domain and those of its alias, under the name of the domain."""
    other = links.withColumn("_alias", alias).where(F.col("_alias").isNotNull())
    return links.unionByName(other.withColumn(domain, F.col("_alias")).drop("_alias"))


def with_decorators(docs: DataFrame, domain: str, terms: DataFrame) -> DataFrame:
    """(doc_id, term) of domain-level terms (domain, term) for each of the domain's documents."""
    return docs.select("doc_id", domain).join(terms, domain).select("doc_id", "term").distinct()


def completions(words: DataFrame, prefix: str, count: int) -> DataFrame:
    """The best completions of a prefix among (word, score), each once."""
    rows = words.where(F.col("word").startswith(prefix)).groupBy("word").agg(F.max("score").alias("score"))
    return rows.orderBy(F.desc("score"), "word").limit(count)


def most_common_names(counts: DataFrame, doc: str = "doc_id", most: int = 150, least: int = 2) -> DataFrame:
    """(doc, word, n): joined names seen ``least`` times, single ones once more, the most frequent first, at most ``most``."""
    rows = counts.where(F.col("n") >= F.when(F.col("word").contains("_"), least).otherwise(least + 1))
    w = Window.partitionBy(doc).orderBy(F.desc("n"), "word")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def important_words(values: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, word): of the 16 words of greatest value (word, value, df) the six rarest that more than 100 documents have."""
    rows = values.where((F.length("word") >= 3) & ~F.col("word").contains("_"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("value"), "word"))).where("_r <= 16 and df > 100")
    last = first.withColumn("_r", F.row_number().over(Window.partitionBy(doc).orderBy("df", "word"))).where("_r <= 6")
    return last.select(doc, "word")
