"""Words of whole texts as flat numpy arrays: one hash per word, offsets per document, n-gram hashes.

A word is a run of bytes other than space and 0x09-0x0D; texts are UTF-8, so that this is the pattern
``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit polynomials of fixed random bytes, mixed; operators verify what they join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG_WORD = 1 << 12
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BASE, _STEP = U(0x9E3779B97F4A7C15 | 1), U(0xD1342543DE82EF95)
with np.errstate(over="ignore"):
    _POW = np.concatenate([[U(1)], np.cumprod(np.full(_LONG_WORD, _BASE))])


def hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each word buf[start:end]."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        at = np.arange(int(size.sum()))
        at -= np.repeat(first, size)
        np.minimum(at, _LONG_WORD, out=at)
        which = np.repeat(start, size) + at if size.max() <= _LONG_WORD else np.repeat(start - first, size) + np.arange(len(at))
        out = np.add.reduceat(_BYTE[buf[which]] * _POW[at], first) + size.astype(np.uint64) * _STEP
    for i in np.flatnonzero(size > _LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].tobytes())
    return mix(out)


def split_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in bytes, and for each document where its words begin (one more than documents)."""
    n = len(buf)
    word = _IS_WORD[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begins, ends = word.copy(), word.copy()
    if n:
        begins[1:] &= ~word[:-1] | edge[1:n]
        ends[:-1] &= ~word[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offs)


def hashed(buf: np.ndarray, offs: np.ndarray, lower: bool, block: int = 1 << 20):
    """(hash of each word, start, end, word offsets); long buffers are hashed in blocks cut between words."""
    if lower:
        buf = _LOWER[buf]
    start, end, woff = split_words(buf, offs)
    return hash_blocks(buf, start, end, block), start, end, woff


def hash_blocks(buf: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """hash_words(), in blocks cut between words where the buffer is long."""
    if len(buf) <= 2 * block:
        return hash_words(buf, start, end)
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(buf) + block, block)))
    return np.concatenate([hash_words(buf, start[i:j], end[i:j]) for i, j in zip(cuts, [*cuts[1:], len(start)], strict=True)])


def text_chunks(batch: pa.RecordBatch, name: str = "text", limit: int = 1 << 20):
    """(first row, row after the last, bytes, byte offsets) for runs of rows with about ``limit`` bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    col = pc.fill_null(col, "").cast(pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words of the flat array."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if k <= 8:
            out = h[:n].copy()
            for i in range(1, k):
                out *= _STEP
                out += h[i : n + i]
            return mix(out)
        power = np.concatenate([[U(1)], np.cumprod(np.full(len(h), _STEP))])
        back = np.cumprod(np.full(n, U(pow(int(_STEP), -1, 1 << 64))))
        sums = np.concatenate([[U(0)], np.cumsum(h * power[1:])])
        return mix((sums[k:] - sums[:-k]) * back)


def doc_of(woff: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(woff) - 1), np.diff(woff))


def whole(woff: np.ndarray, k: int) -> np.ndarray:
    """For each start in grams(): whether its k words are of one document."""
    n = int(woff[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n + k - 1, bool)
    for e in woff[1:]:
        ok[max(0, e - k + 1) : e] = False
    return ok[:n]


def shingles(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document of each): all k-word shingles; a document of 1 to k - 1 words has its sequence as the only one."""
    ok = whole(woff, k)
    g = grams(h, k)[ok]
    d = doc_of(woff)[: len(ok)][ok]
    few = np.flatnonzero((np.diff(woff) > 0) & (np.diff(woff) < k))
    if len(few):
        more = np.array([sequence(h[woff[i] : woff[i + 1]]) for i in few], np.uint64)
        g, d = np.concatenate([g, more]), np.concatenate([d, few])
    return g, d


def sequence(h: np.ndarray) -> int:
    """The hash of a sequence of fewer words than a shingle has; its length counts."""
    return xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))


def distinct(g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, hash), sorted."""
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[new], d[new]


SUB = 8  # hash buckets to a packed row: a reducer unpacks one at a time


class Packed:
    """Rows for a shuffle by hash bucket, packed by task: (part int, n int, blob binary), one row a reducer and flush.

    A row holds SUB neighbouring buckets: counts and sizes first, then for each bucket its columns one after the other,
    compressed. Row counts depend on tasks and reducers alone, as Spark's own shuffle blocks do, so that a frequent key
    makes a blob longer and never a row or partition of its own.
    """

    SCHEMA = "part int, n int, blob binary"
    NAMES = ["part", "n", "blob"]

    def __init__(self, dtypes: list[str], n_buckets: int, flush: int = 400_000) -> None:
        self.dtypes, self.n_buckets, self.flush_at = [np.dtype(x) for x in dtypes], n_buckets, flush
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, bucket: np.ndarray, *cols: np.ndarray) -> bool:
        """True when it is time to take rows()."""
        if len(bucket):
            self.held.append((bucket.astype(np.int32), *(c.astype(t, copy=False) for c, t in zip(cols, self.dtypes, strict=True))))
            self.rows += len(bucket)
        return self.rows >= self.flush_at

    def rows_out(self):
        if not self.rows:
            return
        bucket, *cols = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.rows = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cols = [c[order] for c in cols]
        cut = np.searchsorted(bucket, np.arange(self.n_buckets + 1))
        codec = pa.Codec("zstd", 1)
        ids, ns, blobs = [], [], []
        for part in np.unique(bucket // SUB):
            at = cut[part * SUB : part * SUB + SUB + 1]
            packs = [codec.compress(b"".join(c[i:j].tobytes() for c in cols), asbytes=True) if j > i else b"" for i, j in zip(at[:-1], at[1:], strict=True)]
            head = np.concatenate([np.diff(at), [len(x) for x in packs]]).astype(np.uint32)
            ids.append(int(part))
            ns.append(int(at[-1] - at[0]))
            blobs.append(head.tobytes() + b"".join(packs))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(ns, pa.int32()), pa.array(blobs, pa.binary())], self.NAMES)


def unpack(n: int, blob: memoryview, types: list[np.dtype]) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob, n * sum(t.itemsize for t in types), asbytes=True)
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * t.itemsize
    return out


def by_bucket(batches, dtypes: list[str]):
    """(bucket, columns) for each bucket of the packed rows of a partition: all stay packed but the bucket at hand."""
    types = [np.dtype(x) for x in dtypes]
    held: dict[int, list[list]] = {}
    for batch in batches:
        for part, blob in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("part", "blob")), strict=True):
            head = np.frombuffer(blob, np.uint32, 2 * SUB).astype(np.int64)
            held.setdefault(part, [[] for _ in range(SUB)])
            at = 8 * SUB
            for own, n, size in zip(held[part], head[:SUB].tolist(), head[SUB:].tolist(), strict=True):
                if n:
                    own.append((n, memoryview(blob)[at : at + size]))
                at += size
    for part in sorted(held):
        for sub, own in enumerate(held.pop(part)):
            if own:
                yield part * SUB + sub, [np.concatenate(x) for x in zip(*(unpack(n, blob, types) for n, blob in own), strict=True)]


def deal(df, n: int):
    """Packed rows dealt to the reducers they name, for by_bucket()."""
    return df.repartitionById(n, "part")
