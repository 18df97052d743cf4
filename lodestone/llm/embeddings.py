"""Embedding near-duplicates by sorted projection passes.

A pass gives each vector a string of random-projection bits and orders the vectors of a label lexicographically by
it. Neighbours in that order that share its leading bits form a run, and a run's vectors are compared in tiles of
bounded size; no run is cut short. A pair is counted in the first pass in which both stand in one run, which every
worker can tell from the strings alone, so each pair counts once and no pair is ever emitted: a run gives link counts
per vector and a spanning forest of its links, and the forests of all passes are united.

The number of passes follows from the number of bits and the threshold: a pair exactly at the threshold is missed
with probability ``miss`` at most, closer pairs far less. Identical vectors are collapsed first. Runs longer than a
tile are dealt out by pairs of tiles, so that a large group of near copies is spread over many tasks.

Defined cases: labels of any simple type are told apart as text; a null label, null vector, vector of zeros or with
null or non-finite components links with nothing; a vector of another length than others is compared with its own
length only; repeated rows (same id too) are vectors of their own that link with each other; an empty table gives no
rows; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, components, partitions, ship

TILE = 1024
RUN = 64
SEED = 20_240_101


def passes_for(bits: int, threshold: float, miss: float) -> int:
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def planes(dim: int, passes: int, bits: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim)).standard_normal((passes * bits, dim))


def unpack(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def codes(vectors: np.ndarray, passes: int, bits: int) -> np.ndarray:
    """An integer of ``bits`` leading bits for each vector and pass."""
    out = np.zeros((len(vectors), passes), np.uint32)
    up = vectors @ planes(vectors.shape[1], passes, bits).T > 0
    for b in range(bits):
        out = (out << np.uint32(1)) | up[:, b::bits].astype(np.uint32)
    return out


def prepare(rows: DataFrame, passes: int, bits: int, tiles: DataFrame | None = None) -> DataFrame:
    """(label, pass, code, tile, uid, weight, unit, codes): each usable vector once a pass."""

    def run(batches):
        for batch in batches:
            uid, label, weight = (batch.column(i) for i in range(3))
            dims: dict[int, list[int]] = {}
            vectors = [np.frombuffer(v, np.float64) for v in batch.column(3).to_pylist()]
            for i, v in enumerate(vectors):
                dims.setdefault(len(v), []).append(i)
            for own in dims.values():
                x = np.array([vectors[i] for i in own])
                c = codes(x, passes, bits)
                at = pa.array(own)
                raw = pa.array([c[i].tobytes() for i in range(len(own))], pa.binary())
                u, la, w, v = uid.take(at), label.take(at), weight.take(at), batch.column(3).take(at)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([la, pa.array(np.full(len(own), p, np.int32)), pa.array(c[:, p].astype(np.int64)), u, w, v, raw], ["label", "pass", "code", "uid", "weight", "unit", "codes"])

    return rows.select("uid", "label", "weight", "unit").mapInArrow(run, "label string, pass int, code long, uid long, weight long, unit binary, codes binary")


def compare(a, b, same: bool, p: int, threshold: float, links: dict, edges: list) -> None:
    """Counts the links between tiles a and b of (uid, weight, vectors, codes) whose first shared pass is p."""
    (ua, wa, xa, ca), (ub, wb, xb, cb) = a, b
    if xa.shape[1] != xb.shape[1]:
        return
    hit = xa @ xb.T >= threshold - 1e-9
    if same:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    if not len(i):
        return
    exact = np.einsum("ij,ij->i", xa[i], xb[j]) >= threshold
    first = ~(ca[i, :p] == cb[j, :p]).any(axis=1) if p else np.ones(len(i), bool)
    keep = exact & first
    i, j = i[keep], j[keep]
    for u, n in ((ua, np.bincount(i, wb[j], len(ua))), (ub, np.bincount(j, wa[i], len(ub)))):
        for k in np.flatnonzero(n):
            links[u[k]] = links.get(u[k], 0) + int(n[k])
    edges.append((ua[i], ub[j]))


def forest(edges: list) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges of a run, so many as join what they join: each node with the least of its part."""
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def compare_runs(batches, threshold: float, passes: int):
    """Batches sorted by (label, pass, code, pair, tile): links and forests of each run or pair of tiles."""

    def finish(key, held):
        (p, ta, tb), parts = key[1:], {}
        dims = {}
        for tile, uid, weight, unit, code in held:
            dims.setdefault((tile, len(unit)), []).append((uid, weight, unit, code))
        for k, rows in dims.items():
            u, w, x, c = zip(*rows, strict=True)
            parts[k] = (np.array(u, np.int64), np.array(w, np.float64), np.frombuffer(b"".join(x), np.float64).reshape(len(u), -1), np.frombuffer(b"".join(c), np.uint32).reshape(len(u), -1))
        links: dict[int, int] = {}
        edges: list = []
        for (tile, size), a in parts.items():
            if ta == tb:
                compare(a, a, True, p, threshold, links, edges)
            elif tile == ta and (tb, size) in parts:
                compare(a, parts[(tb, size)], False, p, threshold, links, edges)
        child, root = forest(edges)
        n = len(links) + len(child)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*links, *child.tolist()], pa.int64()), pa.array([*links.values(), *[0] * len(child)], pa.int64()), pa.array([*[None] * len(links), *root.tolist()], pa.int64())], ["uid", "n", "root"])

    now, held = None, []
    for batch in batches:
        for label, p, code, ta, tb, tile, uid, weight, unit, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = ((label, code), p, ta, tb)
            if key != now:
                if held:
                    yield from finish(now, held)
                now, held = key, []
            held.append((tile, uid, weight, unit, raw))
    if held:
        yield from finish(now, held)


def near_duplicates(rows: DataFrame, threshold: float = 0.98, miss: float = 1e-7, run: int = RUN) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label)."""
    spark = rows.sparkSession
    ship(spark)
    e = F.col("embedding")
    good = e.isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    key = F.when(good, F.concat_ws(",", F.transform(e, lambda x: F.format_string("%a", (x + F.lit(0.0)).cast("double")))))
    # the class of a row: its label and exact vector
    all_rows = Table(rows.select("vec_id", F.col("label").cast("string").alias("label"), F.when(good, F.transform(e, lambda x: x.cast("double"))).alias("v"), F.sha2(key, 256).alias("h")), "vectors")
    df = all_rows.df
    classes = df.where("h is not null").groupBy("label", "h").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = classes.withColumn("uid", F.xxhash64("label", "h"))

    def normalise(batches):
        for batch in batches:
            units = []
            for v in batch.column(3).to_pylist():
                x = np.array(v, np.float64)
                x = x / np.abs(x).max()
                units.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(units, pa.binary()), batch.column(4)], ["uid", "label", "weight", "unit", "low"])

    classes = Table(classes.select("uid", "label", "weight", "v", "low").mapInArrow(normalise, "uid long, label string, weight long, unit binary, low long"), "classes").df
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = min(30, max(4, math.ceil(math.log2(max(1, most) / run + 1))))
    n_passes = passes_for(bits, threshold, miss)
    placed = prepare(classes, n_passes, bits)
    # runs longer than a tile: how many tiles each has (only those runs are listed)
    long_runs = placed.groupBy("label", "pass", "code").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    long_runs = Table(long_runs.select("label", "pass", "code", F.ceil(F.col("n") / (TILE // 2)).cast("int").alias("tiles")), "runs").df
    tiled = placed.join(long_runs, ["label", "pass", "code"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tile = F.pmod(F.xxhash64("uid", F.lit(7)), F.col("tiles")).cast("int")
    tiled = tiled.withColumn("tile", tile)
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("ta"), F.greatest(t, F.col("tile")).alias("tb")))
    dealt = tiled.select("label", "pass", "code", F.explode(pairs).alias("t"), "tile", "uid", "weight", "unit", "codes").select("label", "pass", "code", "t.ta", "t.tb", "tile", "uid", "weight", "unit", "codes")
    keys = ["label", "pass", "code", "ta", "tb"]
    dealt = dealt.repartition(4 * partitions(spark), *keys).sortWithinPartitions(*keys)
    found = Table(dealt.mapInArrow(lambda b: compare_runs(b, threshold, n_passes), "uid long, n long, root long"), "links").df
    counts = found.where("root is null").groupBy("uid").agg(F.sum("n").alias("n"))
    groups = components(found.where("root is not null").select("uid", "root"), "uid", "root")
    label_of = classes.select("uid", "weight", "low").join(groups.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = label_of.groupBy("component").agg(F.min("low").alias("least"))
    known = label_of.join(least, "component").join(counts, "uid", "left").select("uid", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least")
    known = Table(known, "known").df
    out = df.select("vec_id", F.when(F.col("h").isNotNull(), F.xxhash64("label", "h")).alias("uid")).join(known, "uid", "left")
    own = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


