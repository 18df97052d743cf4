"""Long texts, repeated rows, ties, brute-force quality weights and pair terms, archives larger than a block."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard, lm, mixing, quality, substring, toxicity, warc
from lodestone.llm.words import SUB, Packed, by_bucket, hash_words

M = (1 << 64) - 1
LONG = " ".join(f"w{i % 90_000}x{i // 90_000}" for i in range(260_000))  # 2.3 MiB, no window twice
SHORT = " ".join(f"s{i}" for i in range(60))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string").repartition(3)


# ---- quality against brute force ------------------------------------------------------------------------------


def _mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def _ids(text):
    b = text.encode()
    out = [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(b) - 2)]
    h = [int(hash_words(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in b.split()]
    out += [(x >> 48) + (1 << 16) for x in h]
    out += [(_mix(h[i] * 0xD1342543DE82EF95 + h[i + 1] & M) >> 48) + (2 << 16) for i in range(len(h) - 1)]
    back = [next((lag for lag in (1, 2, 3) if i >= lag and h[i] == h[i - lag]), 0) for i in range(len(h))]
    # repeats are read along the chunk, so that only a text by itself has a gram of its own
    return out, back


def test_quality_weights(spark):
    r = random.Random(3)
    good, bad = [f"g{i}" for i in range(40)], [f"B{i}!!" for i in range(40)]
    rows = [(i, " ".join(r.choice(good if i % 3 else bad) for _ in range(r.randrange(4, 80))), "a") for i in range(240)] + [(900, "", "a"), (901, None, "a")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 240, 2)], "doc_id long, quality int")
    docs = frame(spark, rows)
    m = quality.Model(docs, labels)
    got = {x.doc_id: x for x in m.weights.collect()}
    for i, t, _ in rows:
        ids, back = _ids(t or "")
        n = len(ids) + len(back)
        grams, c = [], 3 << 16
        for k in range(len(back)):  # in a chunk the words before a text's first are another text's; the ratio of repeats is small
            grams.append(c + sum(back[k - j] * 4**j for j in range(4) if k >= j))
        w = sum(m.ratio[x] for x in ids) + sum(m.ratio[x] for x in grams)
        w *= min(1, quality.EFFECTIVE / max(1, n))
        slack = 1e-6 + 3 * max(abs(m.ratio[3 << 16 :]).max(), 1e-9)  # three first words may continue the text before
        assert abs(got[i]._log_weight - w) <= slack, i
    noise = {i: x._noisy - x._log_weight for i, x in got.items()}
    assert -4 < min(noise.values()) and 0.2 < np.mean(list(noise.values())) < 1.0  # standard Gumbel: mean 0.577
    chosen = {x.doc_id for x in quality.score(docs, labels, k=50).where("selected").collect()}
    assert chosen == {i for i, _ in sorted(got.items(), key=lambda x: -x[1]._noisy)[:50]}
    other = {x.doc_id for x in quality.score(docs, labels, k=50, seed=12).where("selected").collect()}
    assert len(other) == 50 and other != chosen
    assert quality.score(docs, labels, k=0).where("selected").count() == 0


# ---- toxicity -------------------------------------------------------------------------------------------------


def test_terms_that_tell_only_together():
    """Labels by a XOR b: neither term tells anything alone, and none of them is screened out."""
    r = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        a, b = r.random(2) < 0.5
        noise = r.choice(np.arange(100, 200), 5, replace=False)
        rows.append((int(a ^ b), np.array(sorted({*noise, *([7] if a else []), *([9] if b else [])}), np.int32)))
    m = toxicity.Machine().fit(rows)
    s = [m.score(np.array(g, int), np.zeros(len(g), int), 1)[0] for g in ([7], [9], [7, 9], [])]
    assert min(s[:2]) > 0.8 and max(s[2:]) < 0.2


# ---- long texts -----------------------------------------------------------------------------------------------


def test_long_texts(spark):
    words = LONG.split()
    near = " ".join([*words[:1000], "new", *words[1001:]])
    rows = [(1, LONG, "a"), (2, near, "a"), (3, SHORT, "b"), (4, " ".join(words[5:200_005]), "b"), (5, " ".join(words[100:140] + ["y"] * 3), "b")]
    docs = frame(spark, rows)
    sets = {i: len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, t, _ in rows for w in [t.split()]}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {1: (sets[1], 1), 2: (sets[2], 1), 3: (sets[3], 3), 4: (sets[4], 4), 5: (sets[5], 5)}
    items = spark.createDataFrame([(7, " ".join(words[259_000:259_040])), (8, SHORT)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained(docs, items).collect()} == {(1, 7), (2, 7), (3, 8)}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring.report(docs).collect()}
    assert cut == {1: (260_000, 260_000), 2: (260_000, 260_000 - 1), 3: (60, 0), 4: (200_000, 200_000), 5: (43, 40)}
    scored = {r.doc_id: r for r in lm.score(docs, least=1).collect()}
    assert scored[1].n_tokens == 260_001 and all(math.isfinite(r.score) for r in scored.values())
    weight = {r.doc_id: r._log_weight for r in quality.Model(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")).weights.collect()}
    assert all(map(math.isfinite, weight.values())) and abs(weight[1] - weight[2]) < 0.1 * abs(weight[1]) + 1
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()}[1] == 260_000


# ---- repeated rows --------------------------------------------------------------------------------------------


def test_repeated_near_copies(spark):
    """Two near copies, each row many times and without an id too: a class each, one pair, every row in its place."""
    base = [f"t{i}" for i in range(120)]
    a, b = " ".join(base), " ".join([*base[:60], "new", *base[61:]])
    rows = [(5, a, "x")] * 300 + [(6, b, "x")] * 300 + [(None, b, "x")] * 50 + [(7, SHORT, "x")]
    got = jaccard.near_duplicates(frame(spark, rows)).groupBy("doc_id", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(5, 5, 300), (6, 5, 300), (None, 5, 50), (7, 7, 1)}
    kept = jaccard.deduplicate(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [5, 7]


def test_one_id_two_texts(spark):
    """Rows that share an id are groups of their own: only the text that copies another's goes."""
    a, b, c = (" ".join(f"{p}{i}" for i in range(50)) for p in "abc")
    kept = jaccard.deduplicate(frame(spark, [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, c, "x"), (3, c, "x"), (4, None, "x"), (4, "", "x")])).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == [(1, a), (2, b), (3, c)]
    assert len(kept) == 5


# ---- ties -----------------------------------------------------------------------------------------------------


def test_mixing_ties(spark):
    """Documents of one size in sources of one weight finish at the same times: all at the cut's time go together."""
    docs = frame(spark, [(i, "x y z", f"s{i % 2}") for i in range(40)])
    got = mixing.mix(docs, weights=(1,), share=0.5).collect()
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + r.taken
    assert by == {"s0": 30, "s1": 30}
    assert sum(r.taken for r in mixing.mix(docs, weights=(1,), share=0.51).collect()) == 60


# ---- archives -------------------------------------------------------------------------------------------------


def _rec(i, t):
    return warc.record(i, f"http://x/{i}", t, hashlib.sha256(t).hexdigest())


def test_archive_of_many_blocks():
    r = random.Random(2)
    parts = [warc.member(_rec(i, r.randbytes(900))) for i in range(3000)]
    big = _rec(9000, r.randbytes(3 << 20))  # an uncompressed record of three blocks
    bad = bytearray(parts[1500])
    bad[200] ^= 255
    data = b"".join(parts[:1500]) + bytes(bad) + b"".join(parts[1501:]) + big + warc.member(_rec(9001, r.randbytes(2 << 20)))
    assert len(data) > 4 * warc.BLOCK
    out = list(warc.salvage(data))
    assert [x[2]["record_id"] for x in out if x[0] == "record"] == [warc.urn(i) for i in [*range(1500), *range(1501, 3000), 9000, 9001]]
    start = sum(map(len, parts[:1500]))
    assert [x[1:3] for x in out if x[0] == "gap"] == [(start, start + len(bad))]


def test_reader_goes_over_a_file_once():
    """Bytes read grow with the file: pieces behind a member are not read again and again."""

    class Counting:
        def __init__(self, data):
            self.data, self.read = data, 0

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            self.read += n
            return self.data[at : at + n]

    data = b"".join(warc.member(_rec(i, b"x" * 50)) for i in range(8000))
    f = Counting(data)
    assert sum(x[0] == "record" for x in warc.salvage(f)) == 8000 and f.read < 3 * len(data) + warc.BLOCK


# ---- packed rows ----------------------------------------------------------------------------------------------


def test_packed_rows():
    rng = np.random.default_rng(1)
    out = Packed(["u8", "u4"], 5 * SUB)
    key = rng.integers(0, 1 << 62, 10_000).astype(np.uint64)
    out.add((key % np.uint64(5 * SUB)).astype(np.int32), key, np.arange(10_000))
    batches = list(out.rows_out())
    assert sum(b.num_rows for b in batches) == 5  # a row a reducer
    got = {b: (k, v) for b, (k, v) in by_bucket(batches + [pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], Packed.NAMES)], ["u8", "u4"])}
    assert len(got) == 5 * SUB and all((k % np.uint64(5 * SUB) == b).all() and (key[v] == k).all() for b, (k, v) in got.items())


def test_pipeline_run(spark, tmp_path):
    """run() itself: empty tables, null and repeated rows, extra columns."""
    import corpus_pipeline as P

    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, SHORT, "en", "a", 10, "e"), (1, SHORT, "en", "a", 10, "e"), (2, None, "en", None, 0, "e"), (3, "", None, "b", 0, "e"), (None, "x one two three four five six seven y", "de", "b", 3, "e"), (5, SHORT + " more", "en", "b", 10, "e")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, finish string"
    for name, some in (("full", rows), ("empty", [])):
        d = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(str(d / "documents.parquet"))
        bench.write.parquet(str(d / "benchmark.parquet"))
        labels.write.parquet(str(d / "labels.parquet"))
        got = P.run(spark, str(d)).collect()
        assert (got == []) if name == "empty" else all(0 < r.taken <= 2 * r.size for r in got)
    assert P.run(spark, str(tmp_path / "full")).where(F.col("doc_id").isNull()).count() == 0  # it holds a benchmark item


def test_embedding_labels_of_any_type(spark):
    from lodestone.llm import embeddings

    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None)]
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
