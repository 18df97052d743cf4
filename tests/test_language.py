"""Stems, tags, patterns, extractors, page trees, plain texts: examples worked by hand."""

import itertools

import pytest

from lodestone.functions import dom, language as L


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("caress", "caress"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"), ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("formaliti", "formal"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("inference", "infer"), ("airliner", "airlin"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("homologous", "homolog"), ("effective", "effect"), ("bowdlerize", "bowdler"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("a", "a"), ("", "")])
def test_porter(word, stem):
    """The examples of the published paper."""
    assert L.porter(word) == stem


def test_sentences():
    s = L.sentences("One, two three. Four - five|six\n" + "x" * 600)
    assert [x.words for x in s[:4]] == [["One", "two", "three"], ["Four"], ["five"], ["six"]]
    assert s[0].commas == {0} and s[0].next_comma(0) == 0 and s[0].next_comma(1) == 3
    assert [len(x.words[0]) for x in s[4:]] == [250, 250, 100]
    assert len(L.sentences("a. " * 9000)) == L.MAX_SENTENCES and L.sentences(None) == []


def test_tags_and_patterns():
    assert L.tag("Steve McQueen drove the fast cars to London".split()) == ["NNP", "NNP", "NN", "DT", "NN", "NNS", "TO", "NNP"]
    p = L.Pattern("NNP (IN DT) NNP")
    tags = ["NNP", "IN", "NNP", "DT", "NNP"]
    assert p.bitmap(tags) == [True, False, True, False, False]
    s = L.Sentence(["A", "of", "B", "the", "C"], commas={2}, pos=tags)
    assert p.spans(s) == [(0, 3)] and p.at(s, 0) and not p.at(s, 2)  # no comma within, one after the last word may be
    assert L.Pattern("!(IN DT)").bitmap(tags) == [True, False, True, False, True]
    assert L.Pattern("NN*").bitmap(["NNS", "VB"]) == [True, False]
    for bad in ("", "XX"):
        with pytest.raises(ValueError):
            L.Pattern(bad)


def test_extractors():
    doc = L.sentences("We saw Steve McQueen. Then Steve McQueen drove. The dog is big. The dog was here, NASA too.")
    assert L.names(doc) == {"steve_mcqueen": 2}
    assert "dog" in L.subjects(doc) and "nasa" not in L.subjects(doc)
    assert L.title_words(L.sentences("Red fox"), most=2) == ["red", "red_fox"]


def test_pruning():
    html = "<body><nav>Menu <a href=x>y</a></nav><div class='cookie banner'>Accept</div><div><p>Real text here</p><p></p></div><div aria-hidden='true'>no</div><footer>f</footer></body>"
    assert dom.pruned_text(html) == "Real text here"
    assert dom.pruned_text("") == ""


def test_runs_and_spans():
    html = "<title>A b</title><body>x <a href=1>y <h2>z</h2></a><script>no()</script> w</body>"
    assert dom.runs(html) == [("title", "A b"), ("body", "x"), ("anchor", "y"), ("anchor,heading", "z"), ("body", "w")]
    assert dom.spans_of(html) == [("anchor", 4, 6), ("body", 3, 4), ("body", 6, 7), ("heading", 5, 6), ("title", 1, 3)]


def test_plain_titles():
    title = "A title of more than sixteen"
    assert dom.plain_title([title, "=========", "x"], "/a/b.txt") == title
    assert dom.plain_title(["x", "==== HEADER TEXT ====", "y"], "/b.txt") == "HEADER TEXT"
    assert dom.plain_title(["From: me", title, "", "x"], "/b.txt") == title
    assert dom.plain_title(["x", "y"], "/a/b.txt") == "b.txt" and dom.plain_title([], "/a/") == "/a/"
    assert dom.abbreviated("x" * 200, 10) == "xxxxxxx..."


def test_language_and_spread(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import text as tx
    from lodestone.operators import scoring

    rows = [("the cat and the dog",), ("der hund und die katze",), ("zzz",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(L.language(tx.tokens(F.col("t")), "xx").alias("l"))
    assert [r.l for r in df.collect()] == ["en", "de", "xx", "xx"]
    lists = [[1, 9, 30], [4, 12], [10, 40]]
    want = min(max(c) - min(c) for c in itertools.product(*lists))
    got = spark.createDataFrame([tuple(lists)], "a array<int>, b array<int>, c array<int>").select(scoring.min_spread([F.col(x) for x in "abc"]).alias("d")).first().d
    assert got == want


def test_subjects_of_whole_texts(spark, tmp_path):
    """Words beyond 50,000 characters and 500 sentences count; the extractor's own limits stay for those who want them."""
    from lodestone import text_queries as T

    texts = ["blah " * 12_000 + ". The dog is big.", "No. " * 600 + "The cat was here.", "The cow is " + "x, " * 10, None]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in T.keywords_subjects(spark, str(tmp_path)).collect()}
    assert got == {(0, "dog", 1), (1, "cat", 1), (2, "cow", 1)}
    assert len(L.sentences(texts[1])) == L.MAX_SENTENCES and len(L.sentences(texts[1], whole=True)) == 601


def test_subjects_stand_before_verbs():
    """Against each noun and each suffix tried at each place."""
    import random

    r = random.Random(2)
    pool = "The a to it big cars walked, very not is was , . ran. NASA's 's Steve McQueen 12 running. happily famous of dog, dogs us".split()
    for _ in range(200):
        doc, want = L.sentences(" ".join(r.choices(pool, k=80))), {}
        for s in doc:
            for a, b in L.spans(s, "noun"):
                if s.next_comma(b - 1) > b and any(p.bitmap(s.pos)[b] and s.next_comma(b) >= b + len(p.sets) - 1 for p in L.grammar("subject_suffix") if b < len(s.words)):
                    want[s.stemmed(a, b)] = want.get(s.stemmed(a, b), 0) + 1
        assert L.subjects(doc) == want
