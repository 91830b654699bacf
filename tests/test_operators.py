"""Operators on small corpora: exact results, orders and counters."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.tokens import Filters
from tallyloom.operators import distinct, frequency, fuzzy, lookup, ngram, setops
from tallyloom.operators.components import connected_components
from tallyloom.sources.tables import document_corpus, table_corpus


def corpus(spark, *texts, lines=False):
    df = spark.createDataFrame(list(enumerate(texts)), "n bigint, text string")
    make = table_corpus if lines else document_corpus
    return make(df, order_col=F.lit(0), file_idx=F.col("n"))


def listed(df):
    return [r[0] for r in df.collect()]


def row(df):
    return df.collect()[0].asDict()


def test_dedupe_orders(spark):
    c = corpus(spark, "kiwi,fig;fig, Fig\nkiwi ; plum plum, nut,Nut;NUT")
    assert listed(distinct.distinct_tokens(c)) == ["kiwi", "fig", "Fig", "plum", "nut", "Nut", "NUT"]
    assert listed(distinct.distinct_tokens(corpus(spark, "t5;T5\nt40, t4 t5"), ordering="alphabetical")) == ["T5", "t4", "t40", "t5"]
    c = corpus(spark, "oak elm ash elm\nyew ash fir oak\n")
    assert listed(distinct.distinct_tokens(c, ordering="alphabetical")) == ["ash", "elm", "fir", "oak", "yew"]
    for kind in ("preserve", "alphabetical", "unordered"):
        assert sorted(listed(distinct.distinct_tokens(c, ordering=kind, buckets=8))) == ["ash", "elm", "fir", "oak", "yew"]
    assert listed(distinct.distinct_tokens(corpus(spark))) == []


def test_dedupe_stats(spark):
    assert row(distinct.dedupe_stats(corpus(spark, "p q;q r\nq,p r s"))) == {"files": 1, "tokens_seen": 8, "unique_tokens": 4, "duplicates": 4, "filtered_by_length": 0}
    assert row(distinct.dedupe_stats(corpus(spark, "a bb \x0b", "ccc"), Filters(drop_length_min=1, drop_length_max=2))) == {
        "files": 2, "tokens_seen": 4, "unique_tokens": 1, "duplicates": 0, "filtered_by_length": 2}
    assert row(distinct.dedupe_stats(corpus(spark)))["tokens_seen"] == 0


def test_file_stats_credit_the_first_file(spark):
    found = [r.asDict() for r in distinct.file_stats(corpus(spark, "a b a", "b c", "c c")).orderBy("file_idx").collect()]
    assert [(r["tokens_seen"], r["duplicates"], r["unique_new"]) for r in found] == [(3, 1, 2), (2, 1, 1), (2, 2, 0)]


def test_frequency(spark):
    pairs = lambda df: [tuple(r) for r in df.collect()]
    assert pairs(frequency.token_frequency(corpus(spark, "reed\nreed,reed"))) == [("reed", 3)]
    assert pairs(frequency.token_frequency(corpus(spark, "y x y w x"))) == [("x", 2), ("y", 2), ("w", 1)]
    assert pairs(frequency.token_frequency(corpus(spark, "i it ivy ivory ivy"), Filters(drop_length_min=1, drop_length_max=2))) == [("ivy", 2), ("ivory", 1)]
    assert pairs(frequency.token_frequency(corpus(spark, "sun moon moon", "star moon sun"))) == [("moon", 3), ("sun", 2), ("star", 1)]
    assert pairs(frequency.token_frequency(corpus(spark, "a b"), top_n=0)) == []
    assert row(frequency.frequency_totals(corpus(spark, "a b a"))) == {"unique_tokens": 2, "tokens_seen": 3}


@pytest.mark.parametrize(("left", "right", "op", "want"), [
    ("s m t w", "t x", "diff", ["s", "m", "w"]), ("s m t", "t z s", "intersect", ["s", "t"]), ("m s", "z s k", "union", ["m", "s", "z", "k"]), ("w v w u", "v", "diff", ["w", "u"]),
    ("w v u", "u k w", "intersect", ["w", "u"]), ("w", "w w", "union", ["w"]), ("k w", "", "diff", ["k", "w"]), ("k w", "", "intersect", []), ("", "w", "union", ["w"])])
def test_set_ops(spark, left, right, op, want):
    assert listed(setops.set_op(corpus(spark, left), corpus(spark, right), op)) == want
    assert listed(setops.set_op(corpus(spark, left), corpus(spark, right), op, ordering="alphabetical")) == sorted(want)


def test_set_stats(spark):
    assert row(setops.set_stats(corpus(spark, "u v v"), corpus(spark, "v w w x"), "union")) == {"files": 2, "tokens_seen": 7, "unique_tokens": 4, "duplicates": 3, "filtered_by_length": 0}
    assert row(setops.set_stats(corpus(spark, "a b a"), corpus(spark, "b c b"), "diff"))["duplicates"] == 2
    assert listed(setops.set_op(corpus(spark, "q rope ray ox"), corpus(spark, "ox q z"), "diff", Filters(drop_length_min=1, drop_length_max=1), "alphabetical")) == ["ray", "rope"]


def test_ngrams(spark):
    grams = lambda text, n, **k: listed(ngram.distinct_ngrams(corpus(spark, text, lines=True), n, **k))
    assert grams("red fox ran\n", 2) == ["red fox", "fox ran"]
    assert grams("red fox\nran off\n", 2) == ["red fox", "ran off"]
    assert grams("owl hen to jay elk to we emu\n", 2, filters=Filters(drop_length_min=2, drop_length_max=2)) == ["owl hen", "jay elk"]
    assert grams("a \x0b b c", 2) == ["b c"]
    assert len(grams("o p q r s t u\n", 5)) == 3
    assert grams("a b\n", 3) == []
    assert row(ngram.ngram_stats(corpus(spark, "o p\no p q\no p", lines=True), 2)) == {"tokens_seen": 7, "ngrams_seen": 4, "unique_ngrams": 2}
    for n in (1, 21):
        with pytest.raises(ValueError):
            grams("a b", n)


def test_lookup(spark):
    checker = lookup.WordChecker(corpus(spark, "larch,alder\nrowan birch"))
    assert len(checker) == 4 and "larch" in checker and "cedar" not in checker and "Larch" not in checker and " larch" not in checker
    asked = spark.createDataFrame([("larch",), ("cedar",), (None,)], "word string")
    assert {r["word"]: r["found"] for r in lookup.check_words(asked, corpus(spark, "larch")).collect()} == {"larch": True, "cedar": False, None: False}
    checker.close()


def words(spark, *tokens):
    return spark.createDataFrame([(t,) for t in tokens], "token string")


def test_fuzzy_examples(spark):
    cluster = lambda k, *t: {r["token"]: r["representative"] for r in fuzzy.fuzzy_clusters(words(spark, *t), k).collect()}
    assert set(cluster(1, "mast", "mist", "must").values()) == {"mast"}
    assert cluster(2, "form", "from") == {"form": "form", "from": "form"}
    assert set(cluster(1, "lime", "time", "rock").values()) == {"lime", "rock"}
    assert listed(fuzzy.fuzzy_dedupe(corpus(spark, "wren stork\nstor wren\n"), 1)) == ["wren", "stor"]
    assert listed(fuzzy.fuzzy_dedupe(corpus(spark, "tulip lilac tulip\ntulap\n"), 1, ordering="alphabetical")) == ["lilac", "tulap"]
    assert row(fuzzy.fuzzy_stats(corpus(spark, "tulip tulap lilac tulip tulip"), 1)) == {"tokens_seen": 5, "unique_tokens": 3, "clusters": 2}
    for k in (0, 11):
        with pytest.raises(ValueError):
            fuzzy.fuzzy_pairs(words(spark, "a"), k)


def distance(a, b):
    row_ = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row_ = row_, [i]
        for j, y in enumerate(b, 1):
            row_.append(min(above[j] + 1, row_[-1] + 1, above[j - 1] + (x != y)))
    return row_[-1]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_fuzzy_pairs_are_all_pairs(spark, k):
    rng = random.Random(k)
    vocabulary = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    got = {tuple(r) for r in fuzzy.fuzzy_pairs(words(spark, *vocabulary), k).collect()}
    assert got == {(a, b, d) for a, b in itertools.combinations(vocabulary, 2) if (d := distance(a, b)) <= k}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200), (None, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_invariants(spark):
    rng = random.Random(9)
    left, right = ("\n".join(" ".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4)) for _ in range(2))
    a, b = corpus(spark, left), corpus(spark, right)
    d, i = (set(listed(setops.set_op(a, b, op))) for op in ("diff", "intersect"))
    assert d | i == set(left.split()) and not d & i
    assert sum(r["count"] for r in frequency.token_frequency(a).collect()) == len(left.split())
