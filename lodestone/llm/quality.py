"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Two generative models over the same hashed n-grams - bytes in threes, words and word pairs as written, and which of
the last words a word repeats - are counted: one of the target (documents labelled good), one of the raw text (every
document, whose shares are also the target's prior). A document's log weight is the sum over its n-grams of
log target / raw; n-grams of one document aren't independent, so that a document of more than EFFECTIVE of them counts
as that many. With standard Gumbel noise on the log weights, the k greatest are a sample without replacement in
proportion to the weights; another seed draws another sample. k is an argument; without it, it is how many documents of
the corpus weigh more than the level that best parts labelled good from labelled bad, among labelled rows that the
target model hasn't counted.

Only the labelled rows are bounded (``sample``, least hash of doc_id first); counts, weights and k cover all rows.

Defined cases: a null or empty text has weight 0 but for the noise; repeated rows get equal noise; ties at the k-th
greatest are all kept; without labels of both kinds the level is 0; an empty table gives no rows; labels and
documents may have other columns.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, crc_mod, fresh, kth_largest, ship, sum_vectors, vector_rows
from .words import _STEP, doc_of, hashed, mix, text_chunks

VIEWS = {"bytes": 16, "words": 16, "pairs": 16, "repeats": 8}
SIZE = sum(1 << b for b in VIEWS.values())
PRIOR = 16  # counts a bucket that the raw text's shares are worth as the target's prior
SAMPLE = 20_000
EFFECTIVE = 3000
SEED = 11


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram ids, document of each) of a chunk, all views."""
    ids, docs = [], []
    n = len(buf)
    if n >= 3:
        b = buf.astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        ok = np.ones(n, bool)
        for e in offs[1:]:
            ok[max(0, e - 2) : e] = False
        ids.append(((code * np.uint32(2654435761)) >> np.uint32(16))[ok[:-2]].astype(np.int32))
        docs.append(np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))[:-2][ok[:-2]])
    h, _, _, woff = hashed(buf, offs, lower=False)
    if len(h):
        d = doc_of(woff).astype(np.int32)
        ids.append((h >> np.uint64(48)).astype(np.int32) + (1 << 16))
        docs.append(d)
        same = d[1:] == d[:-1]
        with np.errstate(over="ignore"):
            pair = mix(h[:-1] * _STEP + h[1:])
        ids.append((pair >> np.uint64(48)).astype(np.int32)[same] + (2 << 16))
        docs.append(d[1:][same])
        back = np.zeros(len(h), np.int32)
        for lag in (3, 2, 1):
            if len(h) > lag:
                back[lag:] = np.where((h[lag:] == h[:-lag]) & (d[lag:] == d[:-lag]), lag, back[lag:])
        gram = back.copy()
        for i in (1, 2, 3):
            gram[i:] += back[:-i] * 4**i
        ids.append(gram + (3 << 16))
        docs.append(d)
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(ids), np.concatenate(docs)


def labelled(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, quality) of ``sample`` labelled rows at most that are not held out."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").where(crc_mod("doc_id", 3) != 1)
    return rows.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "quality").limit(sample)


def count_models(docs: DataFrame, good: set) -> np.ndarray:
    """Counts of the raw text's n-grams, then of the target's."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(np.array(sorted(good), np.int64))

    def run(batches):
        raw, target = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        for batch in batches:
            own = np.isin(batch.column(0).fill_null(-1).to_numpy(), held.value)
            for i, j, buf, offs in text_chunks(batch):
                ids, d = features(buf, offs)
                raw += np.bincount(ids, minlength=SIZE)
                if own[i:j].any():
                    target += np.bincount(ids[own[i:j][d]], minlength=SIZE)
        if raw.any():
            yield vector_rows(np.concatenate([raw, target]))

    return sum_vectors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "s int, blob binary"), 2 * SIZE)


def log_ratio(counts: np.ndarray) -> np.ndarray:
    out, at = np.zeros(SIZE), 0
    for bits in VIEWS.values():
        n = 1 << bits
        raw, target = counts[at : at + n], counts[SIZE + at : SIZE + at + n]
        share = (raw + 1.0) / (raw.sum() + n)
        out[at : at + n] = np.log((target + PRIOR * n * share) / (target.sum() + PRIOR * n)) - np.log(share)
        at += n
    return out


def weigh(docs: DataFrame, ratio, others: list[str], seed: int = SEED) -> DataFrame:
    """others and (log_weight, noisy) for each row."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(ratio)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1))), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    noise = -F.log(-F.log(u))
    rows = docs.select(*others, *([] if "text" in others else ["text"]), noise.alias(fresh("_noise", docs.columns)))
    made = [fresh("_log_weight", others), fresh("_noisy", others)]
    at = rows.columns.index("text")
    drop = "text" not in others

    def run(batches):
        for batch in batches:
            w = np.zeros(batch.num_rows)
            for i, j, buf, offs in text_chunks(batch):
                ids, d = features(buf, offs)
                n = np.maximum(1, np.bincount(d, minlength=j - i))
                w[i:j] = np.bincount(d, held.value[ids], minlength=j - i) * np.minimum(1, EFFECTIVE / n)
            cols = [c for i, c in enumerate(batch.columns[:-1]) if not (drop and i == at)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(w), pa.array(w + batch.column(batch.num_columns - 1).to_numpy())], [*others, *made])

    schema = docs.select(*others).schema.add(made[0], "double").add(made[1], "double")
    return rows.mapInArrow(run, schema)


def level(weights: DataFrame, known: dict) -> float:
    """The log weight that best parts good from bad among the labelled, halfway in the widest best gap."""
    spark = weights.sparkSession
    ids = spark.createDataFrame([(int(i), int(q)) for i, q in known.items()], "doc_id long, quality int")
    rows = weights.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.avg("_log_weight"), F.max("quality")).select("avg(_log_weight)", "max(quality)").collect()  # as many as ids are labelled
    w, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    if not len(w) or q.min() == q.max():
        return 0.0
    order = np.argsort(w, kind="stable")
    w, q = w[order], q[order]
    lost = np.concatenate([[0], np.cumsum(q)]) / q.sum()  # good below the level
    let = 1 - np.concatenate([[0], np.cumsum(1 - q)]) / (1 - q).sum()  # bad above it
    cost = lost + let
    at = np.flatnonzero(cost == cost.min())
    edges = np.concatenate([[w[0] - 1], w, [w[-1] + 1]])
    best = at[np.argmax(edges[at + 1] - edges[at])]
    return float((edges[best] + edges[best + 1]) / 2)


class Model:
    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int | None = None, seed: int = SEED) -> None:
        ship(docs.sparkSession)
        known = {r.doc_id: r.quality for r in labelled(labels, sample).collect()}
        counted = {i for i, q in known.items() if q == 1 and crc32(b"%d" % i) >> 8 & 1}
        self.ratio = log_ratio(count_models(docs, counted))
        self.weights = Table(weigh(docs, self.ratio, ["doc_id"], seed), "weights").df
        self.level = level(self.weights, {i: q for i, q in known.items() if i not in counted})
        self.k = self.weights.where(F.col("_log_weight") > self.level).count() if k is None else k
        self.cut, _ = kth_largest(self.weights, "_noisy", self.k)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, held_out, log_weight, noisy, selected) for each row of docs (doc_id, text)."""
    m = Model(docs, labels, sample, k, seed)
    held_out = crc_mod("doc_id", 3) == 1
    return m.weights.select("doc_id", held_out.alias("held_out"), F.col("_log_weight").alias("log_weight"), F.col("_noisy").alias("noisy"), (F.col("_noisy") >= F.lit(m.cut)).alias("selected"))


def select(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs, with all their columns, that are sampled."""
    m = Model(docs, labels, sample, k, seed)
    return weigh(docs, m.ratio, docs.columns, seed).where(F.col(fresh("_noisy", docs.columns)) >= F.lit(m.cut)).select(*docs.columns)
