"""What the operators of this subpackage share: shared-folder tables, fixed-size bitmaps, thresholds, components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import SUB

ROOT = str(Path(__file__).resolve().parents[2])
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package (a no-op where it is installed)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and the master is local, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone/{kind}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clean
            return


class Table:
    """A data frame written to the shared folder: it cuts lineage and survives the loss of any executor."""

    def __init__(self, df: DataFrame, kind: str) -> None:
        self.spark = df.sparkSession
        self.path = new_path(self.spark, kind)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def buckets(spark: SparkSession) -> int:
    """Hash buckets for packed shuffles: SUB to a partition, so that a reducer need only unpack a part at a time."""
    return SUB * partitions(spark)


# ---- thresholds -----------------------------------------------------------------------------------------------


def kth_largest(df: DataFrame, key: str, k: int, fit: int = 50_000) -> tuple[float, int]:
    """(t, more): the rows with key > t and the ``more`` least of the rows with key == t make the k largest.

    Narrows an interval by histograms of 1024 bins until it holds at most ``fit`` rows or one value, so no task or
    driver ever holds the rows. NaN and null keys count as -inf. k < 1 gives (inf, 0).
    """
    if k < 1:
        return float("inf"), 0
    x = F.when(F.col(key).isNull() | F.isnan(key), F.lit(float("-inf"))).otherwise(F.col(key).cast("double"))
    df = df.select(x.alias("x"))
    low, high, n = df.agg(F.min(F.when(F.col("x") > float("-inf"), F.col("x"))), F.max("x"), F.count("*")).first()
    if k >= n or low is None:
        return float("-inf"), max(0, k - (n if low is not None else 0))
    above = 0
    while True:
        inside = df.where((F.col("x") >= low) & (F.col("x") <= high))
        wide = (high - low) / 1024
        if not wide or low + wide == low:
            return low, k - above
        b = F.least(F.lit(1023), F.floor((F.col("x") - low) / wide))
        bins = inside.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r.b):
            if above + r.n >= k:
                low, high, n = r.lo, r.hi, r.n
                break
            above += r.n
        else:
            return float("-inf"), k - above
        if low == high:
            return low, k - above
        if n <= fit:
            xs = sorted((r.x for r in df.where((F.col("x") >= low) & (F.col("x") <= high)).collect()), reverse=True)
            t = xs[k - above - 1]
            return t, k - above - sum(v > t for v in xs)


# ---- fixed-size bitmaps ---------------------------------------------------------------------------------------

SLICES = 64


def bitmap(df: DataFrame, key: str, bits: int, hash_of=None) -> np.ndarray:
    """2**bits bits, one set for the top bits of each (hashed, long) key: a filter with false positives only.

    hash_of, if given, makes the hashes from an Arrow array of keys, in the worker that marks them.

    The driver gets 2**bits / 8 bytes whatever the rows are; beyond about 2**bits keys the filter lets all pass, which
    costs time and not results.
    """
    spark = df.sparkSession
    ship(spark)
    size = (1 << bits) // 8 // SLICES

    def mark(batches):
        for batch in batches:
            for rows in [batch]:
                x = rows.column(0)
                x = hash_of(x) if hash_of else x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                at = x >> np.uint64(64 - bits)
                at = np.unique(at)
                part = (at // np.uint64(size * 8)).astype(np.int32)
                yield from _slices(part, (at % np.uint64(size * 8)).astype(np.uint32))

    def _slices(part, at):
        cuts = np.flatnonzero(np.diff(part)) + 1
        for p, a in zip(np.split(part, cuts), np.split(at, cuts), strict=True):
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array([int(p[0])], pa.int32()), pa.array([pa.Codec("zstd").compress(a, asbytes=True)], pa.binary()), pa.array([len(a)], pa.int32())], ["slice", "at", "n"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, blob, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.frombuffer(pa.Codec("zstd").decompress(blob, n * 4, asbytes=True), np.uint32)
                m = held.setdefault(p, np.zeros(size, np.uint8))
                np.bitwise_or.at(m, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for p, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pa.Codec("zstd").compress(m, asbytes=True)], pa.binary())], ["slice", "map"])

    parts = (df if hash_of else df.where(F.col(key).isNotNull())).select(F.col(key).cast("long")).mapInArrow(mark, "slice int, at binary, n int")
    found = parts.repartition(SLICES, "slice").mapInArrow(merge, "slice int, map binary").collect()  # 64 rows at most
    out = np.zeros(size * SLICES, np.uint8)
    for r in found:
        out[r.slice * size : (r.slice + 1) * size] = np.frombuffer(pa.Codec("zstd").decompress(bytes(r.map), size, asbytes=True), np.uint8)
    return out


def in_bitmap(m: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    at = key >> np.uint64(64 - bits)
    return (m[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


# ---- connected components -------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is its smallest node.

    Randomised contraction: each round every node hooks onto its neighbour of the least round-salted hash, edges are
    drawn between the hooks, and self-loops and repeats go, so that even a path shrinks by a constant factor a round.
    Groups are only ever aggregated by min, and each round's tables are written to the shared folder.
    """
    spark = edges.sparkSession
    now = Table(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "edges")
    nodes = now.df.select(F.col("u").alias("node")).union(now.df.select("v")).distinct()
    root: Table | None = None
    turn = 0
    while now.df.limit(1).count():
        turn += 1
        both = now.df.union(now.df.select("v", "u")).toDF("u", "v")
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))
        hook = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(F.col("m"), rank("u"))["id"].alias("r"))
        hooks = Table(hook, "hooks")
        h = hooks.df
        step = now.df.join(h.withColumnRenamed("r", "ru"), "u").join(h.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v")
        after = Table(step.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).where("u <> v").distinct(), "edges")
        base = root.df if root else nodes.withColumn("root", F.col("node"))
        moved = Table(base.join(h.select(F.col("u").alias("root"), F.col("r")), "root", "left").select("node", F.coalesce("r", "root").alias("root")), "roots")
        for old in (now, hooks, root):
            if old:
                old.drop()
        now, root = after, moved
    if not root:
        return nodes.withColumn("component", F.col("node"))
    least = root.df.groupBy("root").agg(F.min("node").alias("component"))
    out = root.df.join(least, "root").select("node", "component")
    return spark.createDataFrame([], out.schema) if root is None else out


LONG, INT, BIN = T.LongType(), T.IntegerType(), T.BinaryType()


# ---- sums of fixed-size vectors -------------------------------------------------------------------------------


def vector_rows(x: np.ndarray):
    """A batch (s int, blob binary) of the slices of a vector whose length SLICES divides."""
    codec = pa.Codec("zstd", 1)
    blobs = [codec.compress(part.astype(np.int64), asbytes=True) for part in np.split(x, SLICES)]
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], ["s", "blob"])


def sum_vectors(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all vectors of vector_rows(); the driver gets one vector of ``size`` numbers."""
    part = size // SLICES

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(pa.Codec("zstd").decompress(blob, part * 8, asbytes=True), np.int64)
                held[s] = held[s] + x if s in held else x
        for s, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["s", "blob"])

    out = np.zeros(size, np.int64)
    for r in rows.repartition(SLICES, "s").mapInArrow(add, "s int, blob binary").collect():
        out[r.s * part : (r.s + 1) * part] = np.frombuffer(bytes(r.blob), np.int64)
    return out


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(column: str, m: int):
    """crc32 of the id as text (null: of the empty text), modulo m."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m
