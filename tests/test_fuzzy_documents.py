"""Edit-distance queries over the tokens of whole documents, against brute force on a small table."""

import itertools
import random

import __spark_entry__


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_like_brute_force(spark, tmp_path):
    """Short tokens share keys by the dozen, and a chain of edits makes one large component."""
    rng = random.Random(5)
    near = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    chain = ["zyxwvutsrqponm"[:i] + "klmnopqrstuvwx"[i:] for i in range(0, 15, 2)]
    far = ["".join(rng.choice("cdefgh") for _ in range(rng.randint(8, 14))) for _ in range(25)]
    vocabulary = sorted({*near, *chain, *far})
    said = vocabulary * 2
    rng.shuffle(said)
    docs = [(i, " ".join(said[i::6])) for i in range(6)] + [(6, None), (7, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    apart = {(a, b): distance(a, b) for a, b in itertools.combinations(vocabulary, 2)}
    queries = __spark_entry__.queries()
    for name, k in (("fuzzy_pairs_documents", 2), ("fuzzy_pairs_far_documents", 4)):
        assert sorted(map(tuple, queries[name](spark, str(tmp_path)).collect())) == sorted((a, b, d) for (a, b), d in apart.items() if d <= k)
    low = {t: t for t in vocabulary}
    for _ in vocabulary:
        for (a, b), d in apart.items():
            if d <= 3:
                low[a] = low[b] = min(low[a], low[b])
    found = {r["token"]: r["representative"] for r in queries["fuzzy_clusters_documents"](spark, str(tmp_path)).collect()}
    assert found == low and len({r for t, r in low.items() if t in chain}) == 1
