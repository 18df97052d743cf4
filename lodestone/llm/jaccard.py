"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Documents with equal shingle sets form a class; a class is compared once, whatever its number of copies.
2. Shingles are ordered rarest first by a fixed-size count sketch of the whole corpus, then by hash. A set of n
   shingles links only with sets that share one of its first n - ceil(t n) + 1 in this order.
3. Prefix shingles are dealt by hash. A shingle's group of up to SMALL_GROUP proposes all its pairs, a larger one first
   stars, chains and rings (linear in the group); these are verified and united. Then, in larger groups, each member proposes its nearest few in other components; what is left after
   that, all pairs of a group that still lie in different components and pass the filters, is proposed in full, each
   pair in the first group that both share, so that no link between components is lost, no pair is proposed twice and
   no group is squared for links that are known already. Groups of more than a tile are dealt out by pairs of tiles.
4. The suffix filter bounds the overlap by a parity sketch: each shingle flips one of PARITY bits, so that two
   sketches differ in no more bits than the sets differ in shingles. Each pair that passes is verified once, on both
   whole sets.

Defined cases: a null or empty text has no shingle and links with nothing; a text of 1 to k - 1 words has its whole
sequence as its one shingle; repeated rows are of one class and so linked; a null doc_id takes part, but ids of
components are the least that isn't null; an empty table gives no rows; other columns are left out. Classes are told
apart by 128 bits of their sets' hash, joined on 64 of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, bitmap, buckets, components, fresh, in_bitmap, partitions, ship
from .words import Packed, by_bucket, deal, distinct, hashed, mix, shingles, text_chunks

K = 5
SKETCH_BITS = 20
SKETCH_SLICES = 64
PARITY = 1024
PARTICIPANT_BITS = 26
CHUNK = 1 << 18  # bytes of text hashed at a time
DTYPES = ["u8", "u8", "u4", "u4"]
SMALL_GROUP = 16  # larger groups propose rings and nearest members for an eighth of their shingles; all pairs for each
NEAREST = 4  # proposals a member and group before those in full
HEAD = 16  # first shared shingles of a class, by which a pair's first common one is told
TILE = 4096


def sets(buf: np.ndarray, offs: np.ndarray, k: int):
    """(sorted distinct hashes, first index of each document, count of each document) for a chunk."""
    h, _, _, woff = hashed(buf, offs, lower=True)
    g, d = distinct(*shingles(h, woff, k))
    n = np.bincount(d, minlength=len(offs) - 1)
    return g, np.cumsum(n) - n, n


def digest(g: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(g.tobytes())
    return _signed(x & (1 << 64) - 1), _signed(x >> 64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parity(g: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of PARITY bits for each document: of how many shingles, odd or even, the top bits fall on each."""
    d = np.repeat(np.arange(len(n)), n)
    bit = d * PARITY + (g >> np.uint64(54)).astype(np.int64)  # sorted, as g is sorted in each document
    start = np.flatnonzero(np.concatenate([[True], bit[1:] != bit[:-1]])) if len(bit) else np.zeros(0, np.int64)
    odd = bit[start[np.diff(np.concatenate([start, [len(bit)]])) % 2 == 1]]
    out = np.zeros(len(n) * PARITY // 8, np.uint8)
    np.bitwise_or.at(out, odd >> 3, np.left_shift(1, odd & 7).astype(np.uint8))
    return out.reshape(-1, PARITY // 8)


def apart_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the sketches (rows of u8) differ: at most as many as the sets differ in shingles."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def may_link(bits: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return bits * (100 + percent) <= (100 - percent) * (na + nb)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: (doc_id, n, d1, d2, blob: parity sketch, th: the text's hash); kind 1: (slice as n, blob) of the count sketch."""
    size = (1 << SKETCH_BITS) // SKETCH_SLICES

    def run(batches):
        names = ["kind", "doc_id", "n", "d1", "d2", "blob", "th"]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for i, j, buf, offs in text_chunks(batch, limit=CHUNK):
                g, first, n = sets(buf, offs, k)
                sketch += np.bincount((g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                own = [g[a : a + m] for a, m in zip(first, n, strict=True)]
                d1, d2 = zip(*(digest(x) if len(x) else (0, 0) for x in own), strict=True)
                cols = [np.zeros(j - i, np.int32), ids.slice(i, j - i), n.astype(np.int32), d1, d2, [x.tobytes() for x in parity(g, first, n)], batch.column(2).slice(i, j - i)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
        if sketch.any():
            codec = pa.Codec("zstd", 1)
            blobs = [codec.compress(sketch[s * size : (s + 1) * size].astype(np.uint32), asbytes=True) for s in range(SKETCH_SLICES)]
            n = len(blobs)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), none, pa.array(range(n), pa.int32()), none, none, pa.array(blobs, pa.binary()), none], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("th"))
    return rows.mapInArrow(run, "kind int, doc_id long, n int, d1 long, d2 long, blob binary, th long")


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def frequency_rank(sketches: DataFrame) -> np.ndarray:
    """A byte for each bucket of the summed sketch, growing with its count: 2**SKETCH_BITS bytes at any corpus size."""
    size = (1 << SKETCH_BITS) // SKETCH_SLICES

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(pa.Codec("zstd").decompress(blob, size * 4, asbytes=True), np.uint32)
                held[s] = held[s] + x if s in held else x.astype(np.int64)
        for s, x in held.items():
            rank = np.minimum(255, np.floor(6 * np.log2(x + 1.0))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([rank.tobytes()], pa.binary())], ["s", "rank"])

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in sketches.select("n", "blob").repartition(SKETCH_SLICES, "n").mapInArrow(add, "s int, rank binary").collect():
        out[r.s * size : (r.s + 1) * size] = np.frombuffer(bytes(r.rank), np.uint8)
    return out


def prefixes(docs: DataFrame, k: int, percent: int, rank, n_buckets: int) -> DataFrame:
    """Packed (order key, class, n, position) of each class's prefix, one a class and task."""

    def run(batches):
        out, seen, ranks = Packed(DTYPES, n_buckets), set(), rank.value
        for batch in batches:
            for _, _, buf, offs in text_chunks(batch, limit=CHUNK):
                g, first, n = sets(buf, offs, k)
                fresh = np.zeros(len(n), bool)
                cls = np.zeros(len(n), np.int64)
                for i in np.flatnonzero(n):
                    d1, d2 = digest(g[first[i] : first[i] + n[i]])
                    cls[i] = d1
                    if (d1, d2) not in seen:
                        fresh[i] = True
                        seen.add((d1, d2))
                if len(seen) > 500_000:
                    seen.clear()
                d = np.repeat(np.arange(len(n)), n)
                keep = fresh[d]
                g, d = g[keep], d[keep]
                key = (ranks[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(55)) | (g >> np.uint64(9))  # 63 bits: a long of the same order
                order = np.lexsort((key, d))
                key, d = key[order], d[order]
                m = np.where(fresh, n, 0)
                pos = np.arange(len(d)) - (np.cumsum(m) - m)[d]
                take = pos < (n - -(-n * percent // 100) + 1)[d]
                key, d, pos = key[take], d[take], pos[take]
                if out.add((mix(key) % np.uint64(n_buckets)).astype(np.int32), key, cls[d].view(np.uint64), n[d], pos):
                    yield from out.rows_out()
        yield from out.rows_out()

    return docs.select("text").mapInArrow(run, Packed.SCHEMA)


def groups(packed: DataFrame, percent: int) -> DataFrame:
    """kind 0: (key, a: class, n, pos) of shingles that more than SMALL_GROUP classes have; kind 1: proposed pairs (a, b)."""

    def run(batches):
        names = ["kind", "key", "a", "b", "n", "pos"]
        for _, (key, cls, n, pos) in by_bucket(batches, DTYPES):
            order = np.lexsort((cls, n, key))
            key, cls, n, pos = key[order], cls[order], n[order].astype(np.int64), pos[order].astype(np.int64)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls, n, pos = key[new], cls[new], n[new], pos[new]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([start, [len(key)]]))
            if size.max() == 1:
                continue
            gid = np.repeat(np.arange(len(size)), size)
            big = size[gid] > SMALL_GROUP
            # the first of the group that is long enough to link: groups are sorted by n
            at = np.arange(len(key))
            wide = gid * (1 << 40)
            least = -(-n * percent // 100)
            mate = np.searchsorted(wide + n, wide + least, "left")
            pairs = [_near(key, cls, n, pos, np.maximum(mate, start[gid])[big], at[big], percent)]
            for lag in range(1, SMALL_GROUP):  # small groups whole, of larger ones neighbours
                keep = (at - lag >= start[gid]) & (~big | (lag == 1))
                pairs.append(_near(key, cls, n, pos, at[keep] - lag, at[keep], percent))
            # a ring in an order of the group's own, so that members that share many shingles meet many others
            ring = np.lexsort((mix(cls ^ mix(key)), gid))
            after = np.where(np.arange(len(ring)) + 1 == (start + size)[gid], start[gid], np.arange(len(ring)) + 1)
            i, j = ring, ring[after]
            meet = big & (mix(key) >> np.uint64(61) == 0)
            i, j = i[meet], j[meet]
            pairs.append(_near(key, cls, n, pos * 0, np.minimum(i, j), np.maximum(i, j), percent))  # whichever shingle they meet at
            pair = np.unique(np.concatenate(pairs), axis=0)
            e = np.flatnonzero(big)
            zeros = lambda m: pa.array(np.zeros(m, np.int32))
            if len(e):
                yield pa.RecordBatch.from_arrays([zeros(len(e)), pa.array(key[e].view(np.int64)), pa.array(cls[e].view(np.int64)), pa.nulls(len(e), pa.int64()), pa.array(n[e].astype(np.int32)), pa.array(pos[e].astype(np.int32))], names)
            m = len(pair)
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), zeros(m), zeros(m)], names)

    return packed.mapInArrow(run, "kind int, key long, a long, b long, n int, pos int")


def _near(key, cls, n, pos, i, j, percent):
    """The pairs (i, j) with i before j that pass the length and positional filters, as sorted class ids."""
    ok = i < j
    i, j = i[ok], j[ok]
    bound = np.minimum(n[i] - pos[i], n[j] - pos[j])  # this shingle and all after it
    ok = (n[i] * 100 >= percent * n[j]) & (bound * (100 + percent) >= percent * (n[i] + n[j]))
    a, b = cls[i[ok]].view(np.int64), cls[j[ok]].view(np.int64)
    return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1).reshape(-1, 2)


def suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of the pairs whose parity sketches allow the overlap."""
    side = lambda x: classes.select(F.col("d1").alias(x), F.col("n").alias(f"n{x}"), F.col("blob").alias(f"h{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ha", "hb")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for i in (4, 5))
            yield batch.filter(pa.array(may_link(apart_bits(x, y), na, nb, percent))).select(["a", "b", "na", "nb"])

    return both.mapInArrow(run, PAIR)


PAIR = "a long, b long, na int, nb int"


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, na, nb) whose whole sets link."""
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("d1")).union(pairs.select("b")).distinct()

    owners = classes.join(ends, "d1").select("rep")
    m = spark.sparkContext.broadcast(bitmap(owners, "rep", PARTICIPANT_BITS, _id_hash))  # 2**PARTICIPANT_BITS / 8 bytes

    def with_class(batches):
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(m.value, _id_hash(batch.column(0)), PARTICIPANT_BITS)))
            for _, _, buf, offs in text_chunks(batch, limit=CHUNK):
                g, first, n = sets(buf, offs, k)
                d1 = np.array([digest(g[a : a + c])[0] if c else 0 for a, c in zip(first, n, strict=True)], np.int64)
                hit = n > 0
                for i in np.flatnonzero(hit):  # a class once a task, however many rows repeat it
                    hit[i] = d1[i] not in seen
                    seen.add(int(d1[i]))
                g = g[np.repeat(hit, n)]
                yield pa.RecordBatch.from_arrays([pa.array(d1[hit]), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[hit])]).astype(np.int32)), pa.array(g.view(np.int64)))], ["d1", "items"])

    # one exchange for both sides, one row a class; documents that share an id but are of no pair fall out at the joins
    owned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(with_class, "d1 long, items array<long>").dropDuplicates(["d1"])
    side = lambda x: owned.toDF(x, f"s{x}")
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    overlap = F.size(F.array_intersect("sa", "sb")).cast("long")
    return joined.where(overlap * (100 + percent) >= F.lit(percent) * (F.col("na").cast("long") + F.col("nb"))).select("a", "b").distinct()


def _id_hash(ids: pa.Array) -> np.ndarray:
    return mix(ids.fill_null(-1).to_numpy().view(np.uint64) + np.uint64(1))


MEMBERS = ["u8", "u8", "u4", "u4", "u8", "u4", "u2", f"V{PARITY // 8}", f"V{8 * HEAD}"]


def apart_members(member: DataFrame, label: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, a, n, pos, c, pair, t, blob, head) of the groups (key) that reach over several components.

    pair names two tiles of the group and t the member's own; a group of up to TILE members is one tile.
    """
    rows = member.join(label.select(F.col("node").alias("a"), F.col("component").alias("c")), "a")
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("lo <> hi").select("key", "tiles")
    rows = rows.join(mixed, "key")
    heads = rows.groupBy("a").agg(F.slice(F.sort_array(F.collect_list("key")), 1, HEAD).alias("head"))  # a class has few keys
    rows = rows.join(classes.select(F.col("d1").alias("a"), "blob"), "a").join(heads, "a")
    rows = rows.withColumn("t", F.pmod(F.xxhash64("a"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u")
    rows = rows.select("*", other).withColumn("pair", F.least("t", "u") * 65536 + F.greatest("t", "u"))
    return rows.select("key", "a", "n", "pos", "c", "pair", "t", "blob", "head")


def pack_members(member: DataFrame, n_buckets: int) -> DataFrame:
    """The rows of apart_members(), packed."""

    def run(batches):
        out = Packed(MEMBERS, n_buckets, flush=100_000)  # rows of 420 bytes
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cls, n, pos, c, pair, t = (batch.column(i).to_numpy() for i in range(7))
            sketch = np.frombuffer(b"".join(batch.column(7).to_pylist()), f"V{PARITY // 8}")
            heads = batch.column(8)
            size = heads.value_lengths().to_numpy().astype(np.int64)
            head = np.full((len(key), HEAD), -1, np.int64)
            head[np.arange(HEAD) < size[:, None]] = heads.flatten().to_numpy()
            bucket = mix(key.view(np.uint64) + mix(pair.astype(np.uint64))) % np.uint64(n_buckets)
            if out.add(bucket.astype(np.int32), key.view(np.uint64), cls.view(np.uint64), n, pos, c.view(np.uint64), pair, t, sketch, head.view(f"V{8 * HEAD}").ravel()):
                yield from out.rows_out()
        yield from out.rows_out()

    return member.mapInArrow(run, Packed.SCHEMA)


def apart_pairs(packed: DataFrame, percent: int, nearest: int, tile: int = 512) -> DataFrame:
    """(a, b, na, nb) of each group's members in different components that pass the length, positional and suffix filters.

    nearest=0: all pairs, each in the first group that both classes are in. Otherwise for each member, in a part of
    the groups, so many of the others whose sketches differ least.
    """

    def candidates(n, pos, c, sketch, t):
        """(i, j, bits) in batches; t: the tile of each member where the two tiles are not the same."""
        for x in range(0, len(n), tile):
            for y in range(x, len(n), tile):
                a, b = slice(x, x + tile), slice(y, y + tile)
                low, high = np.minimum(n[a][:, None], n[b][None]), np.maximum(n[a][:, None], n[b][None])
                ok = (c[a][:, None] != c[b][None]) & (low * 100 >= high * percent)
                ok &= np.minimum((n - pos)[a][:, None], (n - pos)[b][None]) * (100 + percent) >= (low + high) * percent
                if t is not None:
                    ok &= t[a][:, None] != t[b][None]
                i, j = np.nonzero(np.triu(ok, 1) if x == y else ok)
                i, j = i + x, j + y
                for k in range(0, len(i), 1 << 16):
                    u, v = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    bits = apart_bits(sketch[u], sketch[v])
                    keep = may_link(bits, n[u], n[v], percent)
                    if keep.any():
                        yield u[keep], v[keep], bits[keep]

    def first_common(key, head, u, v):
        out = np.ones(len(u), bool)
        for k in range(0, len(u), 1 << 12):
            x, y = head[u[k : k + (1 << 12)]], head[v[k : k + (1 << 12)]]
            early = (x >= 0) & (x < key)
            out[k : k + (1 << 12)] = ~((x[:, :, None] == y[:, None, :]) & early[:, :, None]).any(axis=(1, 2))
        return out

    def closest(u, v, bits, least):
        """For each member its ``least`` nearest, as pairs from it."""
        order = np.lexsort((v, bits, u))
        u, v, bits = u[order], v[order], bits[order]
        start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        rank = np.arange(len(u)) - np.repeat(start, np.diff(np.concatenate([start, [len(u)]])))
        return u[rank < least], v[rank < least], bits[rank < least]

    def one_group(key, n, pos, c, sketch, t, head):
        if not nearest:
            for u, v, _ in candidates(n, pos, c, sketch, t):
                keep = first_common(key, head, u, v)
                yield u[keep], v[keep]
            return
        held, size = [], 0
        for u, v, bits in candidates(n, pos, c, sketch, t):
            held.append((np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([bits, bits])))
            size += 2 * len(u)
            if size > 1_000_000:
                held = [closest(*(np.concatenate(x) for x in zip(*held, strict=True)), nearest)]
                size = len(held[0][0])
        if held:
            u, v, _ = closest(*(np.concatenate(x) for x in zip(*held, strict=True)), nearest)
            yield u, v

    def run(batches):
        for _, (key, cls, n, pos, c, pair, t, sketch, head) in by_bucket(batches, MEMBERS):
            order = np.lexsort((cls, n, pair, key))
            key, cls, n, pos, c, pair, t = (x[order] for x in (key, cls.view(np.int64), n.astype(np.int64), pos.astype(np.int64), c, pair, t))
            sketch, head = sketch[order].view(np.uint64).reshape(len(key), -1), head[order].view(np.int64).reshape(len(key), -1)
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))
            found = []
            for x, y in zip(start, [*start[1:], len(key)], strict=True):
                if nearest and mix(key[x : x + 1])[0] >> np.uint64(61):
                    continue
                same = pair[x] // 65536 == pair[x] % 65536
                for u, v in one_group(int(key[x]), n[x:y], pos[x:y], c[x:y], sketch[x:y], None if same else t[x:y], head[x:y]):
                    u, v = u + x, v + x
                    u, v = np.where(cls[u] < cls[v], u, v), np.where(cls[u] < cls[v], v, u)
                    found.append(np.stack([cls[u], cls[v], n[u], n[v]], axis=1))
            if found:
                rows = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, i].astype(t)) for i, t in enumerate((np.int64, np.int64, np.int32, np.int32))], ["a", "b", "na", "nb"])

    return packed.mapInArrow(run, PAIR)


def relabel(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, component) of all classes after the links (a, b) unite components; component is the smallest node."""
    old = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    apart = links.join(old("a"), "a").join(old("b"), "b").where("ca <> cb").select("ca", "cb")
    moved = components(apart, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("root"))
    return Table(label.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "label").df


def link_classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures of documents, classes, the (node, component) of each class)."""
    spark = docs.sparkSession
    ship(spark)
    sig = Table(signatures(docs, k), "signatures").df
    rank = spark.sparkContext.broadcast(frequency_rank(sig.where("kind = 1")))
    rows = sig.where("kind = 0").select("doc_id", "n", "d1", "d2", "blob", "th")
    classes = Table(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("blob").alias("blob")), "classes").df
    nb, parts = buckets(spark), partitions(spark)
    found = Table(groups(deal(prefixes(docs, k, percent, rank, nb), parts), percent), "groups").df
    proposed = found.where("kind = 1").select("a", "b").distinct()
    tried = Table(suffix_filter(proposed, classes, percent), "tried").df
    links = Table(verify(docs, tried, classes, k, percent), "links").df
    label = relabel(classes.select(F.col("d1").alias("node"), F.col("d1").alias("component")).distinct(), links)
    # the rest: pairs of a group that no known link joins yet; the nearest of each first, then all
    for nearest in (NEAREST, 0):
        apart = apart_members(found.where("kind = 0").select("key", "a", "n", "pos"), label, classes)
        rest = apart_pairs(deal(pack_members(apart, nb), parts), percent, nearest).distinct()
        rest = Table(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "rest").df
        if rest.limit(1).count():
            links = Table(verify(docs, rest, classes, k, percent), "links").df
            if links.limit(1).count():
                label = relabel(label, links)
            tried = tried.union(rest)
    return rows, classes, label


def labelled_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, th, component) for each row of docs; component: the least class of its group, null without shingles."""
    rows, classes, label = link_classes(docs, k, percent)
    named = classes.select("d1", "d2").join(label.withColumnRenamed("node", "d1"), "d1")
    return rows.select("doc_id", "n", "d1", "d2", "th").join(named, ["d1", "d2"], "left").select("doc_id", "n", "th", "component")


def near_duplicates(docs: DataFrame, k: int = K, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    rows, classes, label = link_classes(docs, k, percent)
    named = classes.select("d1", "d2", "rep").join(label.withColumnRenamed("node", "d1"), "d1")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = Table(named.join(least, "component").select("d1", "d2", "least"), "named").df
    out = rows.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, k: int = K, percent: int = 80) -> DataFrame:
    """docs with one row of each group: that of the least doc_id (null last), and of its texts that of the least hash.

    Rows are told apart by id and text, so that of rows that share an id each has its own group; of rows that repeat
    both one stays. Rows without words stay. All columns stay.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    found = Table(labelled_rows(docs, k, percent).where("n > 0").select(own.alias("_own"), F.col("th").alias("_th"), "component"), "decided").df
    kept = found.groupBy("component").agg(F.min(F.struct("_own", "_th")).alias("first"))
    rows = found.groupBy("_own", "_th", "component").count().join(kept, "component")
    rows = Table(rows.select("_own", "_th", "count", (F.struct("_own", "_th") == F.col("first")).alias("stays")), "rows").df
    a, b = fresh("_own", docs.columns), fresh("_th", docs.columns)
    name = lambda df: df.select(F.col("_own").alias(a), F.col("_th").alias(b))
    left = docs.withColumn(a, own).withColumn(b, text_hash()).join(name(rows.where("not stays")), [a, b], "left_anti")
    twice = Table(name(rows.where("stays and count > 1")), "twice").df
    if twice.limit(1).count():
        again = left.join(twice, [a, b], "left_semi").dropDuplicates([a, b])
        left = left.join(twice, [a, b], "left_anti").unionByName(again)
    return left.select(*docs.columns)


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM d WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
c AS (SELECT r, r AS m FROM d UNION SELECT l.b, c.m FROM c JOIN l ON l.a = c.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, z.id AS component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT c.r, min(x.doc_id) AS id FROM c JOIN d x ON x.r = c.m GROUP BY c.r) z USING (r)
"""
