"""Streaming: incremental documents, deduplication, retention, windows and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, upsert_into


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def fresh_urls(stream: DataFrame, key: str = "url", ts: str = "ts", horizon: str = "60 days") -> DataFrame:
    """Each key once within the horizon; older state goes."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def changes(stream: DataFrame) -> DataFrame:
    """(user_id, event_id, before, after) where a user goes from available to not or back."""

    def step(key, batches, state):
        import pandas as pd

        before = state.get[0] if state.exists else None
        out = []
        for rows in batches:
            for r in rows.sort_values(["ts", "event_id"]).itertuples():
                now = "down" if r.event_type == "error" else "up"
                if before and before != now:
                    out.append((key[0], r.event_id, before, now))
                before = now
        state.update((before or "up",))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "before", "after"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, before string, after string", "last string", "append", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a finite stream to its end into a table in memory (for tests and small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def sink_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch once under its id: a repeated batch overwrites itself."""
    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sink_upserts(stream: DataFrame, path: str, checkpoint: str, key: str = "event_id", order: str = "ts"):
    """Lays each micro-batch over the stored rows, last write by ``order`` first; a repeated batch changes nothing."""
    def write(batch: DataFrame, _: int) -> None:
        upsert_into(batch, path, key, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sink_changes(stream: DataFrame, state: str, log: str, checkpoint: str, key: str, order: str, find):
    """Both sinks of a change: the current state is replaced and what ``find(old, batch)`` tells is logged under the batch's id."""
    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(state) if exists(spark, state) else batch.limit(0)
        find(old, batch).write.mode("overwrite").parquet(f"{log}/batch={n}")
        upsert_into(batch, state, key, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_documents(stream: DataFrame, known: DataFrame, bad: DataFrame, horizon: str = "60 days", url: str = "url", ts: str = "ts") -> DataFrame:
    """Items of feeds that are new: each URL once within the horizon, none known to be good or bad."""
    return fresh_urls(stream, url, ts, horizon).join(known.select(url), url, "left_anti").join(bad.select(url), url, "left_anti")


def frontier(stream: DataFrame, most: int = 1000) -> DataFrame:
    """(domain, url, place) of (domain, url): each URL once a domain in order of arrival, ``most`` a domain (the crawl's depth)."""

    def step(key, batches, state):
        import pandas as pd

        seen = list(state.get[0]) if state.exists else []
        known, out = set(seen), []
        for rows in batches:
            for u in rows["url"]:
                if u not in known and len(seen) < most:
                    known.add(u)
                    seen.append(u)
                    out.append((key[0], u, len(seen)))
        state.update((seen,))
        yield pd.DataFrame(out, columns=["domain", "url", "place"])

    return stream.groupBy("domain").applyInPandasWithState(step, "domain string, url string, place long", "seen array<string>", "append", "NoTimeout")


def refresh_feeds(feeds: DataFrame, fetched: DataFrame, clean: bool = False, most_errors: int = 10) -> DataFrame:
    """Feeds (domain, url, etag, errors, body) after a round of fetches (domain, state, etag, body).

    clean starts afresh from what was fetched; else a feed not modified stays, a failure counts, and a feed that failed
    ``most_errors`` times running or for good goes.
    """
    new = fetched.select("domain", "state", F.col("etag").alias("_etag"), F.col("body").alias("_body"))
    if clean:
        return feeds.join(new.where("state = 'success'"), "domain").select("domain", "url", F.col("_etag").alias("etag"), F.lit(0).alias("errors"), F.col("_body").alias("body"))
    ok = F.col("state") == "success"
    failed = F.col("state").isin("transient", "permanent")
    rows = feeds.join(new, "domain", "left")
    errors = F.when(failed, F.col("errors") + 1).when(F.col("state").isNotNull(), 0).otherwise(F.col("errors"))
    out = rows.select("domain", "url", F.when(ok, F.col("_etag")).otherwise(F.col("etag")).alias("etag"), errors.alias("errors"), F.when(ok, F.col("_body")).otherwise(F.col("body")).alias("body"), F.coalesce(F.col("state") == "permanent", F.lit(False)).alias("_gone"))
    return out.where(~F.col("_gone") & (F.col("errors") < most_errors)).drop("_gone")


class WorkLog:
    """What is done already, as a table of ids: work begun again passes over it. Ids of a batch are recorded together, after it."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id") -> None:
        self.spark, self.path, self.key = spark, path, key

    def left(self, work: DataFrame) -> DataFrame:
        if not exists(self.spark, self.path):
            return work
        return work.join(self.spark.read.parquet(self.path).select(self.key), self.key, "left_anti")

    def record(self, done: DataFrame) -> None:
        done.select(self.key).write.mode("append").parquet(self.path)
