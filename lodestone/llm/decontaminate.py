"""Benchmark decontamination: short test items found inside long documents by size-partitioned MinHash containment.

Items are partitioned by size: class c holds those of 2**c to 2**(c+1) - 1 shingles, and each class is an index of its
own. An item's MinHash signature is a bottom sketch, its shingles of least hash, of as many as its size asks for:
floor(n (1 - t)) + 1. An item of which a share t or more lies in a document has at least one of these there, so that
looking a document's shingles up in the sketches misses none. Banded signatures of one length for all, the other
usual form, would: the Jaccard similarity of a short item and a long document is near zero. Documents with fewer
shingles than t times the least size of a class skip it. Pairs so found are verified by exact containment of their
shingles as words. Items go to the workers in blocks of bounded size, BLOCKS to a pass over the documents; documents
are never shuffled.

Defined cases: shingles are five words, lower-cased A-Z; an item or document of 1 to 4 words has its whole sequence
as its one shingle, so that a short item is found only in a document of just these words; null or empty items and
documents match nothing; repeated rows match each by itself; null ids are carried; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .words import distinct, hashed, shingles, text_chunks

K = 5
BLOCK_SHINGLES = 1_000_000  # words of items in a block
BLOCKS = 8  # blocks a worker holds at a time
OUT = "doc_id long, item_id long, n_shared long, n_item long"


def exact_shingles(text: bytes) -> set:
    w = text.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    return {tuple(w[i : i + K]) for i in range(max(1, len(w) - K + 1))} if w else set()


def sketch_size(n: int, percent: int) -> int:
    """Of n shingles, so many that one at least is shared when percent of 100 of them are."""
    return n - -(-n * percent // 100) + 1


class SizeClass:
    """The sketches of the items of one size class, sorted by hash."""

    def __init__(self, g: np.ndarray, owner: np.ndarray, least: int) -> None:
        order = np.argsort(g, kind="stable")
        self.sketch, self.owner, self.least = g[order], owner[order], least
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(g >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, g: np.ndarray, d: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) that share a sketch shingle, of documents that are large enough."""
        near = self.filter[(g >> np.uint64(44)).astype(np.int64)] & (sizes[d] >= self.least)
        g, d = g[near], d[near]
        lo, hi = np.searchsorted(self.sketch, g, "left"), np.searchsorted(self.sketch, g, "right")
        hit = hi > lo
        return {(int(a), int(i)) for a, x, y in zip(d[hit], lo[hit], hi[hit], strict=True) for i in self.owner[x:y]}


class Block:
    """Items with sketches by size class, to look documents up in."""

    def __init__(self, rows: list, percent: int) -> None:
        self.percent = percent
        self.ids = [r.item_id for r in rows]
        self.texts = [r.text.encode() for r in rows]
        buf = np.frombuffer(b"".join(self.texts), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        h, _, _, woff = hashed(buf, offs, lower=True)
        g, d = distinct(*shingles(h, woff, K))
        self.counts = np.bincount(d, minlength=len(rows))
        first = np.cumsum(self.counts) - self.counts
        rank = np.arange(len(g)) - first[d]
        need = np.array([sketch_size(int(n), percent) for n in self.counts])
        inside = rank < need[d]  # distinct() sorts by hash in each item: the least hashes come first
        size_class = np.floor(np.log2(np.maximum(1, self.counts))).astype(np.int64)[d]
        self.classes = [SizeClass(g[own], d[own], -(-(1 << int(c)) * percent // 100)) for c in np.unique(size_class) for own in [inside & (size_class == c)]]
        self.shingles = [g[i : i + n] for i, n in zip(first, self.counts, strict=True)]

    def find(self, buf: np.ndarray, offs: np.ndarray, g: np.ndarray, d: np.ndarray):
        """(document, item, shared, of) for each item of which enough is in a document of the chunk, whose shingles are given."""
        sizes = np.bincount(d, minlength=len(offs) - 1)
        found = set().union(*(c.candidates(g, d, sizes) for c in self.classes))
        last, own, words = -1, None, None
        order = np.argsort(d, kind="stable") if found else None
        for doc, item in sorted(found):
            if doc != last:
                at = order[np.searchsorted(d[order], doc, "left") : np.searchsorted(d[order], doc, "right")]
                last, own, words = doc, np.unique(g[at]), None
            n = int(self.counts[item])
            if np.isin(self.shingles[item], own, assume_unique=True).sum() * 100 < self.percent * n:
                continue
            if words is None:
                words = exact_shingles(buf[offs[doc] : offs[doc + 1]].tobytes())
            mine = exact_shingles(self.texts[item])
            shared = len(mine & words)
            if shared * 100 >= self.percent * len(mine):
                yield doc, item, shared, len(mine)


def item_blocks(items: DataFrame, limit: int):
    """Rows of items in blocks of about ``limit`` words; the driver holds a block at a time."""
    held, size = [], 0
    for r in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        held.append(r)
        size += max(1, len(r.text.split()))
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def passes(docs: DataFrame, items: DataFrame, percent: int, block: int):
    """Lists of broadcast blocks, each for one pass over the documents."""
    spark = docs.sparkSession
    ship(spark)
    held = []
    for rows in item_blocks(items, block):
        held.append(spark.sparkContext.broadcast(Block(rows, percent)))  # at most ``block`` words
        if len(held) == BLOCKS:
            yield held
            held = []
    if held:
        yield held


def contained(docs: DataFrame, items: DataFrame, percent: int = 80, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): a row for each document row and item with the given share."""
    out = None
    for blocks in passes(docs, items, percent, block):

        def look(batches, blocks=blocks):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for first, _, buf, offs in text_chunks(batch):
                    h, _, _, woff = hashed(buf, offs, lower=True)
                    g, d = shingles(h, woff, K)
                    for b in blocks:
                        if got := [(ids[first + doc], b.value.ids[item], n, m) for doc, item, n, m in b.value.find(buf, offs, g, d)]:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["doc_id", "item_id", "n_shared", "n_item"])

        found = docs.select("doc_id", "text").mapInArrow(look, OUT)
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], OUT)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 80, block: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item; one scan, nothing is shuffled."""
    for blocks in passes(docs, items, percent, block):

        def clean(batches, blocks=blocks):
            for batch in batches:
                hit = np.zeros(batch.num_rows, bool)
                for first, _, buf, offs in text_chunks(batch):
                    h, _, _, woff = hashed(buf, offs, lower=True)
                    g, d = shingles(h, woff, K)
                    for b in blocks:
                        for doc, *_ in b.value.find(buf, offs, g, d):
                            hit[first + doc] = True
                yield batch.filter(pa.array(~hit))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT r, doc_id, s FROM (SELECT r, doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT q, item_id, s FROM (SELECT q, item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM b WHERE len(w) > 0)),
n AS (SELECT q, count(*) AS n FROM bs GROUP BY q)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_item, count(*)::DOUBLE / any_value(n)::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (q) GROUP BY r, q, doc_id, item_id HAVING count(*) * 100 >= 80 * any_value(n)
"""
