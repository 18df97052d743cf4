"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum of w over terms + sum over pairs of terms of <v, v'>): the pair terms learn combinations that
additive weights miss. Terms are the distinct words of the whole text, lower-cased, stripped of punctuation and
hashed. Those get a weight and a vector that tell in the training rows either by themselves (chi-square) or together:
of the PAIRED most frequent terms every pair is tested for a label rate that neither of its terms explains, so that
terms that tell only in combination are there for the machine to learn. Others have no weight.

It is fitted on a bounded sample of labelled rows (``sample``, least hash of doc_id first) whose crc32(doc_id) mod 3
is not 1, by AdaGrad on the log loss, and applied to every document; the model's size follows the sample's terms.

Defined cases: a null or empty text has no term and the bias as its score; null ids count as not held out; labels
other than 0 and 1 are passed over; repeated rows are scored alike; without labels of both kinds every score is the
prior; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, ship
from .words import distinct, doc_of, hash_blocks, text_chunks

BITS = 20
SAMPLE = 20_000
LEAST = 3  # training rows that a term must have
PAIRED = 2048
CHI, Z = 10.8, 6.0
RANK = 8
EPOCHS = 30
RATE, PAIR_RATE = 0.3, 0.02
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed terms, document of each)."""
    from .words import _LOWER, split_words

    low = _LOWER[buf]
    start, end, woff = split_words(low, offs)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # punctuation around a word; of a word of nothing else its middle mark stays
    at = np.flatnonzero(_ALNUM[low])
    first, after = np.searchsorted(at, start), np.searchsorted(at, end)
    some, middle = first < after, start + (end - start) // 2
    at = np.append(at, 0)
    start, end = np.where(some, at[np.where(some, first, 0)], middle), np.where(some, at[np.where(some, after - 1, 0)], middle) + 1
    h = hash_blocks(low, start, end)
    g, d = distinct(h >> np.uint64(64 - BITS), doc_of(woff))
    return g.astype(np.int64), d


def labelled(labels: DataFrame, sample: int) -> dict[int, int]:
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(crc_mod("doc_id", 3) != 1)
    rows = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "toxic").limit(sample)
    return {r.doc_id: r.toxic for r in rows.collect()}


def training_rows(docs: DataFrame, known: dict[int, int]) -> list[tuple[int, np.ndarray]]:
    """(label, terms) of the labelled documents: at most as many as ``known`` has ids (repeated rows count once)."""
    spark = docs.sparkSession
    ids = spark.sparkContext.broadcast(np.array(sorted(known), np.int64))

    def run(batches):
        for batch in batches:
            hit = pa.array(np.isin(batch.column(0).fill_null(-1).to_numpy(), ids.value))
            own = batch.filter(hit)
            for i, j, buf, offs in text_chunks(own):
                g, d = terms(buf, offs)
                cut = np.searchsorted(d, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([own.column(0).slice(i, j - i), pa.array([g[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, terms binary")
    got = {r.doc_id: bytes(r.terms) for r in rows.toLocalIterator()}
    return [(known[i], np.frombuffer(got[i], np.int32)) for i in sorted(got)]


def telling(g: np.ndarray, d: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The terms of (term g, row d) whose rows' labels y differ from the rest's, alone or in a pair; sorted."""
    n, n1 = len(y), y.sum()
    n0 = n - n1
    c, c1 = np.bincount(g, minlength=1 << BITS), np.bincount(g, y[d], minlength=1 << BITS)
    det = c1 * (n0 - (c - c1)) - (c - c1) * (n1 - c1)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num(n * det**2 / (c * (n - c) * n1 * n0))
    alone = (c >= LEAST) & (chi > CHI)
    often = np.argsort(-c, kind="stable")[:PAIRED]
    often = np.sort(often[c[often] >= LEAST])
    m = len(often)
    at = np.full(1 << BITS, -1, np.int64)
    at[often] = np.arange(m)
    i, row = at[g], d
    i, row = i[i >= 0], row[i >= 0]
    both, both1 = np.zeros(m * m, np.int32), np.zeros(m * m, np.int32)

    def count(held, label):
        if held:
            (both1 if label else both)[:] += np.bincount(np.concatenate(held), minlength=m * m).astype(np.int32)

    cut = np.searchsorted(row, np.arange(n + 1))
    held, size = ([], []), [0, 0]
    for r in range(n):
        x = i[cut[r] : cut[r + 1]]  # sorted, as terms are in each row
        a, b = np.triu_indices(len(x), 1)
        label = int(y[r])
        held[label].append(x[a] * m + x[b])
        size[label] += len(a)
        if size[label] > 2_000_000:
            count(held[label], label)
            held[label].clear()
            size[label] = 0
    for label in (0, 1):
        count(held[label], label)
    both += both1
    pair = np.flatnonzero(both >= LEAST)
    a, b, k, k1 = often[pair // max(1, m)], often[pair % max(1, m)], both[pair], both1[pair]
    low = np.full(len(pair), np.inf)
    for t in (a, b):
        p = (c1[t] + 1.0) / (c[t] + 2.0)
        low = np.minimum(low, np.abs(k1 - k * p) / np.sqrt(k * p * (1 - p)))
    told = low > Z
    return np.union1d(np.flatnonzero(alone), np.concatenate([a[told], b[told]]))


class Machine:
    """weights by slot: b, w and v; slot_of gives a term's slot, -1 for terms without one."""

    def __init__(self) -> None:
        self.b, self.w, self.v = 0.0, np.zeros(0), np.zeros((0, RANK))
        self.slot_of = np.full(1 << BITS, -1, np.int32)

    def logits(self, slots: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.b) + np.bincount(d, self.w[slots], minlength=n)
        for f in range(RANK):
            x = self.v[slots, f]
            out += 0.5 * (np.bincount(d, x, minlength=n) ** 2 - np.bincount(d, x * x, minlength=n))
        return out

    def score(self, g: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        slots = self.slot_of[g].astype(np.int64)
        on = slots >= 0
        return 1 / (1 + np.exp(-np.clip(self.logits(slots[on], d[on], n), -30, 30)))

    def fit(self, rows: list[tuple[int, np.ndarray]], seed: int = 5) -> Machine:
        y = np.array([r[0] for r in rows], float)
        if not len(y):
            return self
        prior = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.b = float(np.log(prior / (1 - prior)))
        if y.min() == y.max():
            return self
        size = np.array([len(r[1]) for r in rows])
        g, d = np.concatenate([r[1] for r in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), size)
        n1, n0 = y.sum(), len(y) - y.sum()
        own = telling(g, d, y)
        self.slot_of[own] = np.arange(len(own))
        lift = float(np.sqrt(n0 / n1)) if n0 > n1 else 1.0  # the rarer label weighs more
        rng = np.random.default_rng(seed)
        self.w, self.v = np.zeros(len(own)), rng.normal(0, 0.02, (len(own), RANK))
        slots = self.slot_of[g].astype(np.int64)
        on = slots >= 0
        slots, d = slots[on], d[on]
        at = np.searchsorted(d, np.arange(len(y) + 1))
        hw, hv, hb = np.full(len(own), 1e-6), np.full((len(own), RANK), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for part in np.array_split(order, max(1, len(y) // 64)):
                mine = np.concatenate([slots[at[i] : at[i + 1]] for i in part])
                row = np.repeat(np.arange(len(part)), at[part + 1] - at[part])
                p = 1 / (1 + np.exp(-np.clip(self.logits(mine, row, len(part)), -30, 30)))
                e = (p - y[part]) * np.where(y[part] > 0, lift, 1.0) / len(part)
                one, to = np.unique(mine, return_inverse=True)  # only the batch's terms move
                n = len(one)
                sums = np.stack([np.bincount(row, self.v[mine, f], minlength=len(part)) for f in range(RANK)], axis=1)
                gw = np.bincount(to, e[row], minlength=n) + 1e-5 * self.w[one]
                pull = e[row][:, None] * (sums[row] - self.v[mine])
                gv = np.stack([np.bincount(to, pull[:, f], minlength=n) for f in range(RANK)], axis=1) + 1e-4 * self.v[one]
                hw[one] += gw**2
                hv[one] += gv**2
                hb += e.sum() ** 2
                self.w[one] -= RATE * gw / np.sqrt(hw[one])
                self.v[one] -= PAIR_RATE * gv / np.sqrt(hv[one])
                self.b -= 0.1 * e.sum() / np.sqrt(hb)
        return self


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    known = labelled(labels, sample)
    held = spark.sparkContext.broadcast(Machine().fit(training_rows(docs, known)))

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, buf, offs in text_chunks(batch):
                g, d = terms(buf, offs)
                out[i:j] = held.value.score(g, d, j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
