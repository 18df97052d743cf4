"""Relations around documents: floor lookups, simhash, change histories, upserts and retention."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids
from ..functions import text as tx


def simhash(words: Column, n: int = 2) -> Column:
    """64 bits, each the majority of that bit over the hashes of all n-word shingles."""
    grams = tx.rolling_hash(words, n)
    bit = lambda h, i: F.call_function("shiftright", h, i).bitwiseAND(F.lit(1).cast("long"))
    votes = lambda i: F.aggregate(grams, F.lit(0).cast("long"), lambda a, h: a + 2 * bit(h, i) - 1)
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.when(votes(i) > 0, one(i)).otherwise(F.lit(0).cast("long"))))


def simhash_votes(h: str) -> list[Column]:
    """As simhash(), for hashes in rows: an aggregate for each bit."""
    bit = lambda i: F.shiftright(F.col(h), i).bitwiseAND(F.lit(1).cast("long"))
    return [F.sum(2 * bit(i) - 1).alias(f"v{i}") for i in range(64)]


def simhash_of_votes() -> Column:
    return F.aggregate(F.array(*(F.when(F.col(f"v{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def close_hashes(hashes: DataFrame, most: int = 3) -> DataFrame:
    """(a, b), a < b, for all pairs of distinct 64-bit hashes (h) that differ in at most ``most`` bits.

    Of 2 * most blocks of bits, such a pair differs in ``most`` at most, so that ``most`` others are equal: candidates
    share one of the choices of that many blocks, about half of the bits.
    """
    n = max(2, 2 * most)
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in c) for c in combinations(range(n), n - most)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.col("h").bitwiseAND(F.lit(m).cast("long")).alias("v")) for i, m in enumerate(masks)))
    e = hashes.where("h is not null").distinct().select("h", F.explode(keys).alias("k")).select("k.i", "k.v", "h")
    both = e.withColumnRenamed("h", "a").join(e.withColumnRenamed("h", "b").hint("merge"), ["i", "v"])
    return both.where((F.col("a") < F.col("b")) & (ids.hamming(F.col("a"), F.col("b")) <= most)).select("a", "b").distinct()


def floor_lookup(rows: DataFrame, key: str, ranges: DataFrame, start: str, value: str, salt: int | None = None) -> DataFrame:
    """rows with the value of the greatest range start that isn't above their key, by one sorted pass of the union.

    Keys are split into ``salt`` stretches (as many as shuffle partitions), each led in by the last range before it, so no task sorts all rows.
    """
    salt = salt or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return rows.withColumn(value, F.lit(None).cast(ranges.schema[value].dataType))
    wide = max(1, (high - low) // salt + 1)
    part = lambda c: F.greatest(F.lit(-1), F.floor((F.col(c) - low) / wide)).cast("int")
    r = ranges.where(F.col(start) <= high).select(F.col(start).alias("_k"), F.col(value).alias("_v"), part(start).alias("_p"))
    lead = r.groupBy("_p").agg(F.max_by("_v", "_k").alias("_v"), F.max("_k").alias("_k"))
    led = lead.select("_k", "_v", F.explode(F.when(F.col("_p") < salt - 1, F.sequence(F.col("_p") + 1, F.lit(salt - 1)))).alias("_p"))
    both = r.unionByName(led).withColumn("_row", F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType))
    own = rows.select(F.col(key).alias("_k"), F.lit(None).cast(ranges.schema[value].dataType).alias("_v"), part(key).alias("_p"), F.struct("*").alias("_row"))
    w = Window.partitionBy("_p").orderBy("_k", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(own).withColumn("_f", F.last("_v", ignorenulls=True).over(w)).where("_row is not null").select("_row.*", F.col("_f").alias(value))


def changes(rows: DataFrame, key: str, order: list[str], state: Column) -> DataFrame:
    """Each row whose state differs from the one before it for the key, with both."""
    w = Window.partitionBy(key).orderBy(*order)
    both = rows.withColumn("_s", state).withColumn("before", F.lag("_s").over(w)).withColumnRenamed("_s", "after")
    return both.where(F.col("before").isNotNull() & (F.col("before") != F.col("after")))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")


def backoff(seconds: Column, failures: Column, factor: float = 1.5, most: int = 30 * 86400) -> Column:
    return F.least(F.lit(float(most)), seconds * F.pow(F.lit(factor), failures))


def availability(rows: DataFrame, key: str, order: list[str], up: Column, outage: Column) -> DataFrame:
    """Each row whose availability differs from the one before it, with ``change``: up, down or outage_type."""
    w = Window.partitionBy(key).orderBy(*order)
    both = rows.withColumn("_up", up).withColumn("_why", outage).withColumn("_was", F.lag("_up").over(w)).withColumn("_old", F.lag("_why").over(w))
    kind = F.when(F.col("_was") & ~F.col("_up"), "down").when(~F.col("_was") & F.col("_up"), "up").when(~F.col("_was") & ~F.col("_up") & ~F.col("_old").eqNullSafe(F.col("_why")), "outage_type")
    return both.withColumn("change", kind).where("change is not null").drop("_up", "_why", "_was", "_old")


def field_changes(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Each row that differs from the one before it in some field, with the names in ``changed``; a key's first row doesn't count."""
    w = Window.partitionBy(key).orderBy(*order)
    was = rows.withColumn("_was", F.lag(F.struct(*fields)).over(w)).where("_was is not null")
    names = F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_was.{f}")), F.lit(f)) for f in fields])
    return was.withColumn("changed", F.filter(names, lambda x: x.isNotNull())).where("size(changed) > 0").drop("_was")


def updated_since(items: DataFrame, key: str, item: str, at: str, since: Column) -> DataFrame:
    return items.where(F.col(at) >= since).groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("items"))


#: Days between two fetches of hosts that must not be asked every day (fixed values).
CADENCE = {"wordpress.com": 4, "blogspot.com": 4, "substack.com": 7}


def skip_fetch(top: Column, domain: Column, last: Column, today: Column) -> Column:
    """never (no cadence), skip or no_skip; days count from any base. A domain never fetched starts at a place of its own."""
    days = F.lit(0)
    for k, v in CADENCE.items():
        days = F.when(top == k, v).otherwise(days)
    known = F.when(last == 0, today - F.pmod(F.xxhash64(domain), (days + 1).cast("long"))).otherwise(last)
    return F.when(days == 0, "never").when(today < known + days, "skip").otherwise("no_skip")


def fetch_state(status: Column) -> Column:
    """What became of a fetch; no status is a failure that may pass."""
    return F.when(status.between(200, 299), "success").when(status == 304, "not_modified").when(status.isin(408, 425, 429) | (status >= 500), "transient").when(status >= 400, "permanent").otherwise("transient")


#: By how much each kind of error lengthens the time to the next check (fixed values).
ERROR_FACTORS = {"timeout": 1.5, "ssl": 2.0, "connection": 2.0, "http_client": 2.5, "http_server": 1.5, "dns": 2.5, "unknown": 2.0}


def next_check(kind: Column, seconds: Column, failures: Column, key: Column, most: int = 30 * 86400, jitter: float = 0.15) -> Column:
    """Seconds to the next check: multiplied by the error's factor for each failure, capped, and moved by up to ``jitter`` either way by the key's hash."""
    factor = F.lit(2.0)
    for k, v in ERROR_FACTORS.items():
        factor = F.when(kind == k, v).otherwise(factor)
    moved = 1 + jitter * (2 * F.pmod(F.xxhash64(key, failures), F.lit(10_001)) / 10_000.0 - 1)
    return F.least(F.lit(float(most)), seconds * F.pow(factor, failures)) * moved


def within_rates(rows: DataFrame, key: str, at: str, order: str, per_minute: int = 0, per_day: int = 0) -> DataFrame:
    """The rows that a key's allowance for each minute and day lets through; 0 is no limit."""
    for unit, most in (("minute", per_minute), ("day", per_day)):
        if most > 0:
            w = Window.partitionBy(key, F.date_trunc(unit, F.col(at))).orderBy(at, order)
            rows = rows.withColumn(f"_{unit}", F.row_number().over(w))
    for unit, most in (("minute", per_minute), ("day", per_day)):
        if most > 0:
            rows = rows.where(F.col(f"_{unit}") <= most).drop(f"_{unit}")
    return rows


def is_recent(at: Column, now: Column | None = None) -> Column:
    """Within the last month."""
    return at > (now if now is not None else F.current_timestamp()) - F.expr("interval 1 month")


def newcomers(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, found): keys that aren't known yet, with how often they were found, which is their priority."""
    return found.groupBy(key).agg(F.count("*").alias("found")).join(known.select(key).distinct(), key, "left_anti")


def earliest_due(rows: DataFrame, key: str, order: list[str], ready: Column) -> DataFrame:
    """The first job of each key that is due."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.where(ready).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def in_hours(at: Column, first: int, after: int) -> Column:
    """Whether a time's hour is in the window [first, after), which may pass midnight."""
    h = F.hour(at)
    return (h >= first) & (h < after) if first <= after else (h >= first) | (h < after)
