"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import chat, decontaminate, embeddings, jaccard, lm, mixing, quality, substring, toxicity, warc
from lodestone.llm.common import components, kth_largest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, taken string, key string, _noise string, _spans string"


def frame(spark, rows):
    """Rows of (doc_id, text, source), with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x", "x") for i, t, s in rows], DOCS).repartition(3)


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


BASE = words(120, 1)
NEAR = BASE[:60] + ["new"] + BASE[61:]
CORPUS = [
    (0, " ".join(BASE), "a"), (1, " ".join(NEAR), "a"), (2, " ".join(BASE), None), (3, None, "a"), (4, "", "b"), (5, "two words", "b"), (6, "Two\tWORDS", "b"),
    (7, " ".join(words(4000, 2)), "c"), (8, " ".join(words(50, 3) + BASE[:40] + words(50, 4)), "c"), (9, "the " * 100, "c"), (10, " ".join(words(90, 5)), "c"), (10, " ".join(words(90, 5)), "c"), (None, " ".join(words(60, 6)), "c"), (11, "élan É x\x0by", "b"), (12, "a", "b"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return frame(spark, CORPUS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(t):
    return (t or "").encode().lower().split()


def shingle_set(t):
    w = low(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard(corpus, empty):
    sets = [shingle_set(t) for _, t, _ in CORPUS]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    want = []
    for i, (doc, *_ ) in enumerate(CORPUS):
        ids = [CORPUS[j][0] for j in range(len(sets)) if find(j) == find(i) and CORPUS[j][0] is not None]
        want.append((doc, len(sets[i]), min(ids) if ids else None))
    got = [tuple(r) for r in jaccard.near_duplicates(corpus).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.deduplicate(corpus)
    assert kept.columns == corpus.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(map(str, [0, 3, 4, 5, 7, 8, 9, 10, None, 11, 12]))


def test_jaccard_group_of_variants(spark):
    r = random.Random(9)
    rows = []
    for i in range(80):
        w = BASE[:]
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "a"))
    sets = [shingle_set(t) for _, t, _ in rows]
    import itertools

    links = [(i, j) for i, j in itertools.combinations(range(80), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = list(range(80))
    for _ in range(80):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == dict(enumerate(root))


def test_substring(corpus, empty):
    texts = [(t or "").encode().split() for _, t, _ in CORPUS]
    from collections import Counter

    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    want = []
    for (doc, *_), w in zip(CORPUS, texts, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in substring.report(corpus).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring.report(empty).count() == 0
    out = {(r.doc_id, r.n_chars) for r in substring.remove(corpus).collect()}
    assert {(0, 0), (5, 9), (3, None)} <= out


def test_mixing(spark, corpus, empty):
    got = mixing.mix(corpus).collect()
    assert len(got) == len(CORPUS)
    by = {}
    for r in got:
        assert r.taken <= 2 * r.size
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    total = sum(r.size for r in got)
    assert sum(v[1] for v in by.values()) == pytest.approx(1.5 * total)
    assert sum(v[2] for v in by.values()) <= 1.5 * total
    assert all(v[1] <= 2 * v[0] for v in by.values())
    again = sorted(map(str, mixing.mix(corpus.repartition(5)).collect()))
    assert again == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0
    r = random.Random(3)
    many = frame(spark, [(i, "x " * r.randrange(1, 60), f"s{i % 3 if i % 2 else 0}") for i in range(3000)])
    for source in mixing.mix(many).groupBy("source", "target").sum("taken").collect():
        assert abs(source[2] - source[1]) <= 120


def test_decontaminate(spark, corpus, empty):
    items = [(0, " ".join(BASE[10:50])), (1, "two words"), (2, None), (3, ""), (4, " ".join(words(30, 77))), (None, " ".join(words(50, 3)[:45]))]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, extra string")
    want = [(d, i, len(a & b), len(b)) for d, t, _ in CORPUS for i, u in items for a, b in [(shingle_set(t), shingle_set(u))] if b and 100 * len(a & b) >= 80 * len(b)]
    got = [tuple(r)[:4] for r in decontaminate.contained(corpus, bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    blocks = [tuple(r)[:4] for r in decontaminate.contained(corpus, bench, block=10).collect()]
    assert sorted(blocks, key=repr) == sorted(want, key=repr)
    left = decontaminate.decontaminate(corpus, bench)
    assert left.columns == corpus.columns and left.count() == len(CORPUS) - len({(d, n) for n, (d, t, _) in enumerate(CORPUS) if any(x[0] == d for x in want)})
    assert decontaminate.contained(empty, bench).count() == 0 == decontaminate.contained(corpus, bench.limit(0)).count()


def test_lm(corpus, empty):
    got = lm.score(corpus).collect()
    assert len(got) == len(CORPUS)
    train = [low(t) + [None] for d, t, _ in CORPUS if zlib.crc32((str(d) if d is not None else "").encode()) % 7 != 2]
    from collections import Counter

    count, pair = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([0, *w], w, strict=False))
    n, v, types, cont = sum(count.values()), len(count), len(pair), Counter(w for _, w in pair)
    d2, d1 = (lm.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in (pair, cont))
    gamma1 = sum(d1[min(c, 3)] for c in cont.values()) / types
    before = Counter(count) + Counter({0: len(train)})
    kept = Counter()
    for (u, _), c in pair.items():
        kept[u] += c - d2[min(c, 3)] if c > 1 else 0

    def p(w, u):
        c = pair[u, w]
        low_order = max(cont[w] - d1[min(cont[w], 3)], 0) / types + gamma1 / (v + 1)
        back = 1 - kept[u] / before[u] if before[u] else 1
        return (c - d2[min(c, 3)]) / before[u] * (c > 1) + back * low_order if before[u] else low_order

    want = sorted((len(w), sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w), sum(np.log10(p(x, u)) for u, x in zip([0, *w], w, strict=False))) for w in (low(t) + [None] for _, t, _ in CORPUS))
    assert np.allclose(sorted((r.n_tokens, r.base_score, r.score) for r in got), want)
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score <= 0 for r in got)
    assert lm.score(empty).count() == 0


def test_lm_keeps_bigrams_seen_once(spark, corpus, tmp_path):
    """op7's model against full modified Kneser-Ney: every bigram counts, D1 acts on those seen once."""
    from collections import Counter

    from lodestone.llm import queries

    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_lm_scoring(spark, str(tmp_path)).collect()
    train = [low(t) + [None] for d, t, _ in CORPUS if zlib.crc32((str(d) if d is not None else "").encode()) % 7 != 2]
    pair = Counter(p for w in train for p in zip([0, *w], w, strict=False))
    cont, before, types = Counter(w for _, w in pair), Counter(), len(pair)
    d2, d1 = (lm.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in (pair, cont))
    gamma1, spare = sum(d1[min(c, 3)] for c in cont.values()) / types, Counter()
    for (u, _), c in pair.items():
        before[u] += c
        spare[u] += d2[min(c, 3)]

    def p(w, u):
        below = max(cont[w] - d1[min(cont[w], 3)], 0) / types + gamma1 / (len(cont) + 1)
        return (max(pair[u, w] - d2[min(pair[u, w], 3)], 0) + spare[u] * below) / before[u] if before[u] else below

    want = sorted((len(w), sum(np.log10(p(x, u)) for u, x in zip([0, *w], w, strict=False))) for w in (low(t) + [None] for _, t, _ in CORPUS))
    assert np.allclose(sorted((r.n_tokens, r.score) for r in got), want)
    for u in (0, "w1", "the"):
        assert not before[u] or np.isclose(sum(p(w, u) for w in [*cont, "never seen"]), 1)


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + r.normal(size=16) * 0.02 * (i // 30)).tolist(), i % 2) for i in range(150)]
    rows += [(150, None, 0), (151, [0.0] * 16, 0), (152, [float("nan")] + [1.0] * 15, 0), (153, base[0].tolist(), None), (154, rows[0][1], 0), (154, rows[0][1], 0), (155, [1.0, None], 1), (156, [1.0, 2.0], 1), (157, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(i, e, x, 1, 1) for i, e, x in rows], "vec_id long, embedding array<float>, label int, uid int, code int")
    unit = []
    for _, e, x in rows:
        ok = e is not None and x is not None and None not in e and np.isfinite(e).all() and any(e)
        v = np.array(e, np.float32).astype(float) if ok else None
        unit.append(v / np.linalg.norm(v) if ok else None)
    n = len(rows)
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98] for i in range(n)]
    least = [rows[i][0] for i in range(n)]
    for _ in range(n):
        least = [min([least[i], *(least[j] for j in link[i])]) for i in range(n)]
    want = sorted((rows[i][0], len(link[i]), least[i], rows[i][0] == least[i]) for i in range(n))
    assert sorted(tuple(x) for x in embeddings.near_duplicates(df).collect()) == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 100
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "x\r\n\r\nWARC/1.1\r\n" * 9), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    got = {tuple(r) for r in warc.round_trip(pages).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got == {(i, len((t or "").encode()), sha(t), "revisit" if i in (2, None) else "response", 1 if i in (2, None) else None) for i, _, t in rows}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_salvage():
    recs = [warc.record(i, f"http://x/{i}", t, hashlib.sha256(t).hexdigest()) for i, t in enumerate([b"one", b"two" * 50, b"three", b"four"])]
    m = [warc.member(r) for r in recs]
    bad = bytearray(m[1])
    bad[30] ^= 255
    data = m[0] + bytes(bad) + m[2] + b"junk\r\n" + recs[3] + m[3][:20]
    out = list(warc.salvage(data))
    assert [x[2]["record_id"] for x in out if x[0] == "record"] == [warc.urn(0), warc.urn(2), warc.urn(3)]
    gaps = [x[1:3] for x in out if x[0] == "gap"]
    assert gaps[0] == (len(m[0]), len(m[0]) + len(m[1])) and gaps[-1][1] == len(data)
    assert list(warc.salvage(b"")) == []


def test_chat(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no <|im_end|>"), (2, 0, "user", "a"), (3, 0, "user", "b"), (4, 0, None, None), (5, 0, None, None), (5, 1, "assistant", "x"), (6, 0, "user", "alone"), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pair_id int")
    got = {r.pair_id: r for r in chat.preference(df).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0].prompt == "<|im_start|>user\nhi<|im_end|>\n" and got[0].prompt_turns == 1
    for text, m, learned in ((got[0].chosen, got[0].chosen_mask, "yes<|im_end|>"), (got[0].rejected, got[0].rejected_mask, "no <|\\im_end|><|im_end|>")):
        a, b = map(int, m.split("-"))
        assert text[a:b] == learned
    assert got[1].prompt == "" and got[1].chosen_mask == ""
    assert got[2].chosen == "" and got[2].prompt_turns == 1
    assert chat.preference(df.limit(0)).count() == 0


def test_quality_and_toxicity(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        w = [f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('nrst')}{r.choice('aeiou')}" for _ in range(60)]
        good, toxic = i % 4 != 0, i % 5 == 0
        if toxic:
            w[r.randrange(60)] = r.choice(["grunk", "blorf"])
            w[r.randrange(60)] = r.choice(["grunk", "blorf"])
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "a"))
        labels.append((i, int(good), int(toxic)))
    rows += [(None, None, "a"), (1000, "", "a")]
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    t = toxicity.score(docs, lab).collect()
    assert len(t) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in t)
    held = [x for x in t if x.held_out and x.doc_id is not None and x.doc_id < 600]
    assert np.mean([x.predicted == (x.doc_id % 5 == 0) for x in held]) > 0.97
    q = quality.score(docs, lab).collect()
    held = [x for x in q if x.held_out and x.doc_id is not None and x.doc_id < 600]
    assert np.mean([x.selected == (x.doc_id % 4 != 0) for x in held]) > 0.97
    kept = quality.select(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(x.selected for x in q)
    none = docs.limit(0)
    assert toxicity.score(none, lab).count() == 0 == quality.score(none, lab).count()
    assert toxicity.score(docs, lab.limit(0)).count() == len(rows) == quality.score(docs, lab.limit(0)).count()


def test_toxicity_terms_of_long_texts():
    """A text over 2 MiB has the terms of its parts, and any number of marks around a word goes."""
    def of(text):
        b = np.frombuffer(text.encode(), np.uint8)
        return set(toxicity.terms(b, np.array([0, len(b)]))[0].tolist())

    r = random.Random(9)
    parts = [" ".join(f"{'#' * r.randrange(6)}W{r.randrange(3000)}{'!' * r.randrange(9)}" for _ in range(20_000)) for _ in range(14)]
    assert sum(map(len, parts)) > 2 << 20
    assert of(" ".join(parts)) == set().union(*map(of, parts)) == of(" ".join(f"w{i}" for i in range(3000)))
    assert of("(((((Idiot.&&&&&&") == of("idiot") and len(of("&")) == len(of("&&&&&&&&&")) == 1 and of("&" * 9) == of("&") and of("") == set()


def test_machine_learns_pairs():
    """Two terms each harmless, toxic together: no additive score tells them apart."""
    r = np.random.default_rng(1)
    rows = []
    for _ in range(1500):
        a, b = r.random(2) < 0.5
        noise = r.choice(np.arange(100, 200), 5, replace=False)
        rows.append((int(a and b), np.array(sorted({*noise, *([7] if a else []), *([9] if b else [])}), np.int32)))
    m = toxicity.Machine().fit(rows)
    s = [m.score(np.array(g, int), np.zeros(len(g), int), 1)[0] for g in ([7, 9], [7], [9], [])]
    assert s[0] > 0.7 > 0.5 > max(s[1:])


def test_components_and_threshold(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    xs = [random.Random(1).gauss(0, 1) for _ in range(3000)] + [5.0] * 40
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 39, 40, 41, 1500, 3039):
        t, more = kth_largest(df, "x", k, fit=100)
        assert sum(x > t for x in xs) + more == k
