"""Language-model scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting: each task packs its distinct bigrams by hash bucket; reducers sum them into exact counts, write those from
``least`` on (with 1, as op7 runs, all; else the mass of the others goes to the back-off, so that each context still
sums to one) and pass on what each word needs: its count, in how many distinct contexts it stands, and what is left of its own contexts' mass. A
second shuffle sums these by word. Both tables are written as sorted hash arrays, a file a bucket, into the shared
folder, and workers map the files into memory to score.

p(w | u) = max(c(uw) - D(c), 0) / c(u) + gamma(u) p1(w), p1(w) = max(n(.w) - D(n), 0) / n(..) + gamma1 / (V + 1); a word
that training never saw gets gamma1 / (V + 1). D has the usual three values from counts of counts, for either level.

Order two is what the disk budget of four times the input allows at this size: distinct trigrams alone would shuffle
1.8 times the compressed input on top of the bigrams.

Defined cases: a null or empty text is its end token alone; a null id counts as id text ''; repeated rows count and
are scored each; without training rows every token has probability 1 / (V + 1) = 1; an empty table gives no rows;
other columns are left out. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import mmap
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, buckets, crc_mod, new_path, partitions, ship
from .words import _STEP, Packed, by_bucket, deal, hashed, mix, text_chunks

U = np.uint64
END, BEGIN = U(0x3C6EF372FE94F82B), U(0xA54FF53A5F1D36F1)
HOLD_OUT = (7, 2)
PAIRS = ["u8", "u8", "u4"]  # word, context, count
PARTS = ["u8", "u8", "u4", "u8", "u4", "u4", "u4"]  # word; its count, contexts; as context: kept sum, kept ones, kept twos, kept threes and more
SPREAD = 16


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end for each text, context of each, offsets of each text)."""
    h, _, _, woff = hashed(buf, offs, lower=True)
    n = len(offs) - 1
    toff = woff + np.arange(n + 1)
    w = np.empty(len(h) + n, np.uint64)
    last = toff[1:] - 1
    inner = np.ones(len(w), bool)
    inner[last] = False
    w[inner] = h
    w[last] = END
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[toff[:-1]] = BEGIN
    return w, u, toff


def pair_hash(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(w * _STEP ^ mix(u + U(0x632BE59BD9B4E019)))


def pair_bucket(w: np.ndarray, u: np.ndarray, n: int) -> np.ndarray:
    """By word, a frequent word's contexts spread over SPREAD buckets."""
    return (mix(w ^ mix(u % U(SPREAD) + U(1))) % U(n)).astype(np.int32)


def word_bucket(w: np.ndarray, n: int) -> np.ndarray:
    return (mix(w) % U(n)).astype(np.int32)


def count_pairs(docs: DataFrame, nb: int, flush: int = 1_500_000) -> DataFrame:
    """Packed (word, context, count) of each task."""

    def run(batches):
        out = Packed(PAIRS, nb)
        held, size = [], 0

        def settle():
            w, u, c = total(*(np.concatenate(x) for x in zip(*held, strict=True)))
            out.add(pair_bucket(w, u, nb), w, u, c)
            yield from out.rows_out()

        for batch in batches:
            for _, _, buf, offs in text_chunks(batch):
                w, u, _ = tokens(buf, offs)
                held.append(total(w, u, np.ones(len(w), np.int64)))
                size += len(held[-1][0])
                if size >= flush:
                    yield from settle()
                    held, size = [], 0
        if held:
            yield from settle()

    return docs.select("text").mapInArrow(run, Packed.SCHEMA)


def total(w: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (w, u) with summed counts, sorted."""
    order = np.lexsort((u, w))
    w, u, c = w[order], u[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (u[1:] != u[:-1])]))
    return w[start], u[start], np.add.reduceat(c.astype(np.int64), start)


def sums_by(key: np.ndarray, *cols: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [key[start], *(np.add.reduceat(c[order].astype(np.int64), start) for c in cols)]


class Files:
    """Sorted hash arrays in a folder, a file for each bucket: columns one after the other, after their length."""

    def __init__(self, top: str, dtypes: list[str], names: dict[int, str]) -> None:
        self.top, self.dtypes, self.names = top, dtypes, names
        self.held: dict[int, list[np.ndarray]] = {}

    @staticmethod
    def write(top: str, cols: list[np.ndarray], dtypes: list[str]) -> str:
        """Under a name of its own, so that a task tried again never meets a half-written file."""
        store, base = pafs.FileSystem.from_uri(top)
        store.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(np.array([len(cols[0])], np.int64).tobytes())
            for c, t in zip(cols, dtypes, strict=True):
                f.write(c.astype(t).tobytes())
        return name

    def columns(self, bucket: int) -> list[np.ndarray]:
        if bucket not in self.held:
            if bucket not in self.names:
                self.held[bucket] = [np.zeros(0, t) for t in self.dtypes]
                return self.held[bucket]
            store, base = pafs.FileSystem.from_uri(self.top)
            path = f"{base}/{self.names[bucket]}"
            if isinstance(store, pafs.LocalFileSystem):
                with open(path, "rb") as f:
                    raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            else:
                with store.open_input_file(path) as f:
                    raw = f.read_buffer()
            n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
            for t in self.dtypes:
                out.append(np.frombuffer(raw, t, n, at))
                at += n * np.dtype(t).itemsize
            self.held[bucket] = out
        return self.held[bucket]

    def find(self, key: np.ndarray, bucket: np.ndarray) -> list[np.ndarray]:
        """For each key its row's other columns, 0 where it has none."""
        out = [np.zeros(len(key), np.int64) for _ in self.dtypes[1:]]
        order = np.lexsort((key, bucket))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[i:j]
            if not len(at):
                continue
            own, *cols = self.columns(int(bucket[at[0]]))
            if not len(own):
                continue
            pos = np.searchsorted(own, key[at])
            pos[pos == len(own)] = 0
            hit = own[pos] == key[at]
            for o, c in zip(out, cols, strict=True):
                o[at[hit]] = c[pos[hit]]
        return out


WORD_FILE = ["u8", "u8", "u4", "u8", "u4", "u4", "u4"]
PAIR_FILE = ["u8", "u4"]
MADE = "part int, n int, blob binary, bucket int, kind string, file string, stats array<long>"


def _made(bucket: int, kind: str, file: str | None, stats) -> pa.RecordBatch:
    none = [pa.array([None], t) for t in (pa.int32(), pa.int32(), pa.binary())]
    return pa.RecordBatch.from_arrays([*none, pa.array([bucket], pa.int32()), pa.array([kind]), pa.array([file], pa.string()), pa.array([list(map(int, stats))], pa.list_(pa.int64()))], ["part", "n", "blob", "bucket", "kind", "file", "stats"])


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def build_pairs(packed: DataFrame, top: str, least: int, nw: int) -> DataFrame:
    """Writes the kept bigrams; what words need as packed rows, and a row for each file."""

    def run(batches):
        out = Packed(PARTS, nw)
        for bucket, cols in by_bucket(batches, PAIRS):
            w, u, c = total(*cols)
            keep = c >= least
            h = pair_hash(w[keep], u[keep])
            order = np.argsort(h)
            file = Files.write(top, [h[order], c[keep][order]], PAIR_FILE)
            yield _made(bucket, "pairs", file, [len(w), *_counts_of_counts(c)])
            word, count, contexts = sums_by(w, c, np.ones(len(w), np.int64))
            ctx, s, n1, n2, n3 = sums_by(u[keep], c[keep], c[keep] == 1, c[keep] == 2, c[keep] > 2) if keep.any() else [np.zeros(0, np.int64)] * 5
            both = np.concatenate([word, ctx.astype(np.uint64)])
            pad = lambda a, b: np.concatenate([a, b])
            zw, zc = np.zeros(len(word), np.int64), np.zeros(len(ctx), np.int64)
            if out.add(word_bucket(both, nw), both, pad(count, zc), pad(contexts, zc), pad(zw, s), pad(zw, n1), pad(zw, n2), pad(zw, n3)):
                yield from (_wide(b) for b in out.rows_out())
        yield from (_wide(b) for b in out.rows_out())

    def _wide(b):
        n = b.num_rows
        return pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(n, t) for t in (pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64())))], ["part", "n", "blob", "bucket", "kind", "file", "stats"])

    return packed.mapInArrow(run, MADE)


def build_words(packed: DataFrame, top: str) -> DataFrame:
    def run(batches):
        for bucket, cols in by_bucket(batches, PARTS):
            word, *sums = sums_by(*cols)
            real = (sums[1] > 0) & (word != BEGIN)
            yield _made(bucket, "words", Files.write(top, [word, *sums], WORD_FILE), [int(sums[0][real].sum()), int(real.sum()), *_counts_of_counts(sums[1][real])])

    return packed.mapInArrow(run, MADE)


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0.0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))])


class Model:
    """File names by bucket and a few totals; the arrays themselves are mapped where they are used."""

    def __init__(self, docs: DataFrame, least: int = 2) -> None:
        if least < 1:
            raise ValueError("the table holds bigrams from a count of one on")
        spark = docs.sparkSession
        ship(spark)
        nb, parts = buckets(spark), partitions(spark)
        self.nb, self.nw, self.least = nb, nb, least
        top = new_path(spark, "model")
        made = Table(build_pairs(deal(count_pairs(docs, nb), parts), f"{top}/pairs", least, self.nw), "pairs")
        words = Table(build_words(deal(made.df.where("blob is not null").select("part", "n", "blob"), parts), f"{top}/words"), "words")
        p = made.df.where("blob is null").select("bucket", "file", "stats").collect()  # a row a bucket
        w = words.df.select("bucket", "file", "stats").collect()
        made.drop()
        self.pairs = Files(f"{top}/pairs", PAIR_FILE, {r.bucket: r.file for r in p})
        self.words = Files(f"{top}/words", WORD_FILE, {r.bucket: r.file for r in w})
        ps, ws = np.array([r.stats for r in p] or [[0] * 5]).sum(axis=0), np.array([r.stats for r in w] or [[0] * 6]).sum(axis=0)
        self.types = int(ps[0])
        self.d2 = discounts(ps[1:].tolist())
        self.tokens, self.vocabulary = int(ws[0]), int(ws[1])
        cont = ws[2:].tolist()
        self.d1 = discounts(cont)
        rest = self.vocabulary - sum(cont[:2])
        spare = self.d1[1] * cont[0] + self.d1[2] * cont[1] + self.d1[3] * rest
        self.gamma1 = spare / self.types if self.types else 1.0
        end = np.array([END])
        self.texts = int(self.words.find(end, word_bucket(end, self.nw))[0][0])  # each text begins and ends once
        self.words.held, self.pairs.held = {}, {}

    def log10(self, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of the token, log10 p(w | u)) for each token."""
        all_words, at = np.unique(np.concatenate([w, u]), return_inverse=True)
        count, cont, kept, ones, twos, threes = self.words.find(all_words, word_bucket(all_words, self.nw))
        count_u = np.where(all_words == BEGIN, self.texts, count)
        aw, au = at[: len(w)], at[len(w) :]
        pair = pair_hash(w, u)
        one, first, back = np.unique(pair, return_index=True, return_inverse=True)
        c = self.pairs.find(one, pair_bucket(w[first], u[first], self.nb))[0][back]
        p1 = np.maximum(cont - self.d1[np.minimum(cont, 3)], 0) / max(1, self.types) + self.gamma1 / (self.vocabulary + 1)
        mass = kept - self.d2[1] * ones - self.d2[2] * twos - self.d2[3] * threes
        gamma = np.where(count_u > 0, 1 - mass / np.maximum(1, count_u), 1.0)
        own = np.where(c > 0, c - self.d2[np.minimum(c, 3)], 0.0) / np.maximum(1, count_u[au])
        return count[aw], np.log10(own + gamma[au] * p1[aw])


def score(docs: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    m, r = HOLD_OUT
    held_out = crc_mod("doc_id", m) == r
    model = spark.sparkContext.broadcast(Model(docs.where(~held_out), least))  # file names and totals

    def run(batches):
        x = model.value
        norm = np.log10(x.tokens + 1.0 * (x.vocabulary + 1))
        for batch in batches:
            for i, j, buf, offs in text_chunks(batch, limit=2 << 20):
                w, u, toff = tokens(buf, offs)
                c, p = x.log10(w, u)
                n = np.diff(toff)
                at = toff[:-1]
                base = np.add.reduceat(np.log10(c + 1.0) - norm, at)
                full = np.add.reduceat(p, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.full(j - i, x.tokens)), pa.array(base), pa.array(full), pa.array(10 ** np.minimum(300, -full / n))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, schema)
