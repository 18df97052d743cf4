"""Substring dedup: repeated runs of words found as repeated, compacted paths of a de Bruijn graph of words.

Edges are windows of ``k`` consecutive words. The graph is built by minimizers, as partitioned de Bruijn builders do:

1. Each window is represented by the least-hashed 12-word gram within it. These anchors are far fewer than windows;
   they are counted over the corpus, and those that occur once cannot be in a repeated window. Repeated anchors go
   into a bitmap of fixed size, which can let a window pass in vain but never miss one.
2. Windows whose anchor is in the bitmap are the graph's edges. They are dealt by anchor with their source coordinate
   (text, position) and neighbouring words, one edge a task however often the task has it. Edges that occur twice are
   kept, and runs of consecutive kept edges that don't branch (every occurrence has the same word before and after)
   are compacted into one path piece within the reducer; those of edges that a task has twice by itself within the task.
3. Pieces of one text are then joined end to start, on Spark, by their coordinates into the longest repeated spans,
   and these are checked against the text: a span must lie inside it and consist of whole windows.

Edges are equal when 96 bits of two independent hashes are.

A text's digest is its coordinate, so equal texts share their spans. Words covered by a repeated window go.

Defined cases: null and empty texts have no words; texts shorter than k words lose none; rows that repeat a text lose
all words in windows; windows may overlap their own repetition; null ids are carried; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Table, bitmap, buckets, fresh, in_bitmap, partitions, ship
from .words import Packed, by_bucket, deal, doc_of, grams, hashed, mix, split_words, text_chunks, whole

K = 35
ANCHOR = 12
ANCHOR_BITS = 27
ANCHORS = ["u8", "u1"]
EDGES = ["u8", "u4", "u8", "u8", "u4", "u2", "u2", "u1"]
BRANCH = 0xFFFF
U = np.uint64


def sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) of each n consecutive values."""
    width = 1
    while width * 2 <= n:
        x = pick(x[:-width], x[width:])
        width *= 2
    return x if width == n else pick(x[: len(x) - (n - width)], x[n - width :])


def anchors_of(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(12-word grams, anchor of each window start, whether the window is within one text)."""
    ok = whole(woff, k)
    if not len(ok):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), ok
    g = grams(h, ANCHOR)
    return g, sliding(g, k - ANCHOR + 1, np.minimum), ok


def anchor_counts(docs: DataFrame, k: int, n_buckets: int) -> DataFrame:
    """Packed (anchor, whether the task has it twice)."""

    def run(batches):
        out = Packed(ANCHORS, n_buckets)
        held, size = [], 0

        def settle():
            a, n = np.unique(np.concatenate(held), return_counts=True)
            out.add((a % U(n_buckets)).astype(np.int32), a, n > 1)
            yield from out.rows_out()

        for batch in batches:
            for _, _, buf, offs in text_chunks(batch):
                h, _, _, woff = hashed(buf, offs, lower=False)
                g, a, ok = anchors_of(h, woff, k)
                if not ok.any():
                    continue
                low = np.where(ok, a, U(0))
                w = k - ANCHOR + 1
                most = sliding(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum)
                held.append(g[most[: len(g)] == g])
                size += len(held[-1])
                if size >= 1_000_000:
                    yield from settle()
                    held, size = [], 0
        if held:
            yield from settle()

    return docs.select("text").mapInArrow(run, Packed.SCHEMA)


def repeated_anchors(packed: DataFrame) -> DataFrame:
    def run(batches):
        for _, (a, twice) in by_bucket(batches, ANCHORS):
            order = np.argsort(a, kind="stable")
            a, twice = a[order], twice[order]
            start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            n = np.diff(np.concatenate([start, [len(a)]]))
            again = a[start[(n > 1) | (np.maximum.reduceat(twice, start) > 0)]]
            yield pa.RecordBatch.from_arrays([pa.array(mix(again).view(np.int64))], ["a"])

    return packed.mapInArrow(run, "a long")


def pieces(key1, key2, pos, cut) -> list[np.ndarray]:
    """(key1, key2, first window, windows) of the runs of consecutive positions; cut: a run ends after this position."""
    order = np.lexsort((pos, key2, key1))
    key1, key2, pos, cut = key1[order], key2[order], pos[order].astype(np.int64), cut[order]
    new = np.ones(len(pos), bool)
    new[1:] = (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1]) | (pos[1:] != pos[:-1] + 1) | cut[:-1]
    start = np.flatnonzero(new)
    n = np.diff(np.concatenate([start, [len(pos)]]))
    return [key1[start].view(np.int64), key2[start].view(np.int64), pos[start].astype(np.int32), n.astype(np.int32)]


SPAN = "part int, n int, blob binary, key1 long, key2 long, start int, len int"


def _spans(cols) -> pa.RecordBatch:
    n = len(cols[0])
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *map(pa.array, cols)], ["part", "n", "blob", "key1", "key2", "start", "len"])


def edges(docs: DataFrame, k: int, filled, n_buckets: int) -> DataFrame:
    """Packed edges with coordinates, and path pieces of the edges that a task has twice by itself."""

    def run(batches):
        out = Packed(EDGES, n_buckets)
        held, size = [], 0

        def settle():
            a, e1, e2, k1, k2, pos, before, after = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((e2, e1))
            a, e1, e2, k1, k2, pos, before, after = (x[order] for x in (a, e1, e2, k1, k2, pos, before, after))
            start = np.flatnonzero(np.concatenate([[True], (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])]))
            n = np.diff(np.concatenate([start, [len(e1)]]))
            one = lambda x: np.where(np.minimum.reduceat(x, start) == np.maximum.reduceat(x, start), x[start], BRANCH).astype(np.uint16)
            b, f = one(before), one(after)
            again = np.repeat(n > 1, n)
            if again.any():
                # joined by coordinates at once, across branches too: a text that repeats a word or two over and over
                # branches at each of them
                yield _spans(pieces(k1[again], k2[again], pos[again], np.zeros(int(again.sum()), bool)))
            out.add((a[start] % U(n_buckets)).astype(np.int32), e1[start], e2[start], k1[start], k2[start], pos[start], b, f, n > 1)
            for batch in out.rows_out():
                m = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["part", "n", "blob", "key1", "key2", "start", "len"])

        for batch in batches:
            keys = batch.column(1)
            for i, j, buf, offs in text_chunks(batch):
                h, _, _, woff = hashed(buf, offs, lower=False)
                _, a, ok = anchors_of(h, woff, k)
                at = np.flatnonzero(ok)
                at = at[in_bitmap(filled.value, mix(a[at]), ANCHOR_BITS)] if len(at) else at
                if not len(at):
                    continue
                d = doc_of(woff)[at]
                raw = np.frombuffer(b"".join(keys.slice(i, j - i).to_pylist()), np.uint64).reshape(-1, 2)
                small = (h & U(0x7FFF)).astype(np.uint16)
                before = np.where(at > woff[d], small[at - 1], 0x8000).astype(np.uint16)
                after = np.where(at + k < woff[d + 1], small[np.minimum(at + k, len(h) - 1)], 0x8000).astype(np.uint16)
                e2 = (grams(mix(h ^ U(0x5851F42D4C957F2D)), k)[at] >> U(32)).astype(np.uint32)
                held.append((a[at], grams(h, k)[at], e2, raw[d, 0], raw[d, 1], (at - woff[d]).astype(np.uint32), before, after))
                size += len(at)
                if size >= 400_000:
                    yield from settle()
                    held, size = [], 0
        if held:
            yield from settle()

    return docs.select("text", "key").mapInArrow(run, SPAN)


def repeated_pieces(packed: DataFrame) -> DataFrame:
    """The path pieces (key1, key2, start, len) of edges that occur more than once."""

    def run(batches):
        for _, (e1, e2, k1, k2, pos, b, f, known) in by_bucket(batches, EDGES):
            order = np.lexsort((e2, e1))
            e1, e2, k1, k2, pos, b, f, known = (x[order] for x in (e1, e2, k1, k2, pos, b, f, known))
            start = np.flatnonzero(np.concatenate([[True], (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])]))
            n = np.diff(np.concatenate([start, [len(e1)]]))
            again = np.repeat(n > 1, n)
            if not again.any():
                continue
            branches = (np.maximum.reduceat(f, start) != np.minimum.reduceat(f, start)) | (np.maximum.reduceat(f, start) == BRANCH)
            key1, key2, first, m = pieces(k1[again], k2[again], pos[again], np.repeat(branches, n)[again])
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (key1, key2, first, m))), ["key1", "key2", "start", "len"])

    return packed.mapInArrow(run, "key1 long, key2 long, start int, len int")


def join_pieces(found: DataFrame) -> DataFrame:
    """(key1, key2, spans): per text the longest runs of consecutive or overlapping pieces, (first window, windows)."""
    text = Window.partitionBy("key1", "key2").orderBy("start", "len")
    end = F.col("start") + F.col("len")
    reach = F.max(end).over(text.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.distinct().withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    marked = marked.withColumn("chain", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("key1", "key2", "chain").agg(F.min("start").alias("start"), F.max(end).alias("end"))
    return spans.groupBy("key1", "key2").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("len")))).alias("spans"))


def keyed(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(*names, "text", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("key"))


def text_key(text: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.md5(text).digest(), np.int64).tolist())


def repeated_spans(docs: DataFrame, k: int = K) -> DataFrame:
    """(key1, key2, spans) for the texts of docs that have repeated windows; the keys are halves of the text's MD5."""
    spark = docs.sparkSession
    ship(spark)
    nb, parts = buckets(spark), partitions(spark)
    twice = Table(repeated_anchors(deal(anchor_counts(docs, k, nb), parts)), "anchors")
    filled = spark.sparkContext.broadcast(bitmap(twice.df, "a", ANCHOR_BITS))  # 2**ANCHOR_BITS / 8 bytes
    twice.drop()
    graph = edges(keyed(docs), k, filled, nb)
    graph = Table(graph, "edges")
    own = graph.df.where("part is null").select("key1", "key2", "start", "len")
    shared = repeated_pieces(deal(graph.df.where("part is not null").select("part", "n", "blob"), parts))
    out = Table(join_pieces(own.union(shared)), "spans")
    graph.drop()
    return out.df


def with_spans(docs: DataFrame, spans: DataFrame, names: list[str]) -> DataFrame:
    """docs' (names, text) with the spans of each text, or null."""
    key, own = fresh("_md5", docs.columns), fresh("_spans", docs.columns)
    m = docs.select(*names, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias(key))
    return m.join(spans.select(F.col("hex").alias(key), F.col("spans").alias(own)), key, "left").select(*names, own)


def named(spans: DataFrame) -> DataFrame:
    """Adds the MD5 in hex to (key1, key2)."""

    def run(batches):
        for batch in batches:
            raw = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + 16].hex() for i in range(0, len(raw), 16)]), batch.column(2)], ["hex", "spans"])

    return spans.mapInArrow(run, "hex string, spans array<struct<start:int,len:int>>")


def kept_words(text: bytes, spans, k: int) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by a space)."""
    buf = np.frombuffer(text, np.uint8)
    start, end, _ = split_words(buf, np.array([0, len(text)]))
    n = len(start)
    if not spans:
        return n, 0, b" ".join(text.split())
    step = np.zeros(n + 1, np.int64)
    for s in spans:
        last = s["start"] + s["len"] - 1 + k
        if last > n:
            raise ValueError("a span reaches past its text")
        step[s["start"]] += 1
        step[last] -= 1
    keep = np.cumsum(step[:n]) == 0
    words = text.split()
    return n, int(n - keep.sum()), b" ".join(words[i] for i in np.flatnonzero(keep))


def report(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs (doc_id, text)."""
    spans = named(repeated_spans(docs, k))

    def run(batches):
        for batch in batches:
            got = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, gone, kept = kept_words((text or "").encode(), own, k)
                got.append((n, gone, hashlib.sha256(kept).hexdigest()))
            if got:
                n, gone, sha = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = with_spans(docs.select("doc_id", "text"), spans, ["doc_id", "text"])
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, k: int = K) -> DataFrame:
    """docs with repeated words taken out of the texts (those that lose none stay as they are) and n_chars set anew.

    A document that loses all its words stays, with an empty text.
    """
    spans = named(repeated_spans(docs, k))
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, own in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if own and texts[i] is not None:
                    texts[i] = kept_words(texts[i].encode(), own, k)[2].decode()
            cols = batch.columns[:-1]
            cols[at] = pa.array(texts, pa.string())
            if chars is not None:
                cols[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.column(chars).type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    joined = with_spans(docs, spans, docs.columns)
    return joined.mapInArrow(run, docs.schema)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM rep)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (r, j) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
