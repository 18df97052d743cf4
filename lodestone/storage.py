"""Tables in the folder that driver and executors share: they cut lineage and outlive any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master that names none, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Saved:
    """df written to the shared folder; ``df`` reads it back."""

    def __init__(self, df: DataFrame, kind: str = "table") -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/engine/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, kind: str = "table") -> DataFrame:
    return Saved(df, kind).df


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def swap(spark: SparkSession, source: str, target: str) -> None:
    """Puts a finished folder in the place of another: the old one stands aside until the new one is there."""
    jvm = spark.sparkContext._jvm
    old, new, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (target, source, f"{target}.old-{uuid.uuid4().hex}"))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(new):
        raise ValueError(f"nothing to put in place: {source}")
    held = fs.exists(old)
    if held:
        fs.rename(old, aside)
    if not fs.rename(new, old):
        if held:
            fs.rename(aside, old)
        raise ValueError(f"could not move {source} to {target}")
    if held:
        fs.delete(aside, True)


def upsert_into(df: DataFrame, path: str, key: str, order: str) -> None:
    """Rows of df laid over those stored at path, last write by ``order`` first; repeats of a batch change nothing."""
    from .operators.relations import upsert

    spark = df.sparkSession
    both = upsert(spark.read.parquet(path), df, key, order) if exists(spark, path) else upsert(df, df.limit(0), key, order)
    staged = f"{path}.new-{uuid.uuid4().hex}"
    both.write.parquet(staged)
    swap(spark, staged, path)
