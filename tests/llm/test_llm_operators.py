"""The corpus operators on small tables, each against a plain restatement, with nulls, ties, repeats and odd columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, license_scan, media, mixing, near_dedup, pieces, preference, quality, toxicity, url_filter
from tallyloom.llm.training import fold

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, digest string, epoch int"


def documents(spark, texts, langs=None, sources=None):
    """A table with columns whose names operators use inside, too."""
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["src1"] * len(texts))[k], len(t or ""), "k", "d", 7) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# exact dedup


def test_exact_duplicates(spark):
    texts = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 200_000), (8, "X" * 200_000), (2, "aBC"), (None, "abc"), (None, "alone")]
    groups = defaultdict(list)
    for i, t in texts:
        groups[low(t)].append(i)
    want = []
    for i, t in texts:
        own = groups[low(t)]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    assert rows(exact_dedup.exact_duplicates(documents(spark, texts))) == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0
    kept = exact_dedup.drop_exact_duplicates(documents(spark, texts))
    assert kept.columns == documents(spark, texts).columns and sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 0, 2, 2, 3, 4, 6, 8]  # null ids stand for one document


def test_index_keeps_earlier_batches(spark):
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.exact_duplicates(documents(spark, [(1, "a"), (2, "A"), (3, "b")]), index)
    found = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(documents(spark, [(10, "a"), (11, "c"), (12, "c")]), index).collect()}
    assert found == {10: (2, False), 11: (12, False), 12: (12, True)}
    assert index.entries().count() == 3 and exact_dedup.DigestIndex(spark, index.table).entries().count() == 3


def decisions(df):
    return {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()}


def test_a_batch_run_again_decides_alike(spark):
    batch = documents(spark, [(1, "a"), (2, "A"), (3, "b"), (None, "c")])
    index = exact_dedup.DigestIndex(spark)
    first = decisions(exact_dedup.exact_duplicates(batch, index))
    assert decisions(exact_dedup.exact_duplicates(batch, index)) == first and index.entries().count() == 3
    assert sorted(r["doc_id"] or 0 for r in exact_dedup.drop_exact_duplicates(batch, index).collect()) == [0, 2, 3]
    groups = exact_dedup.digests(batch).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    torn = exact_dedup.DigestIndex(spark)
    torn.add(groups)  # a run that died behind its append
    assert decisions(exact_dedup.exact_duplicates(batch, torn)) == first
    index.drop(), torn.drop()


def test_index_is_reopened_under_other_settings(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.exact_duplicates(documents(spark, [(1, "a"), (2, "b")]), index)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = exact_dedup.DigestIndex(spark, index.table)
        found = decisions(exact_dedup.exact_duplicates(documents(spark, [(3, "A"), (4, "c")]), again))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert again.buckets == 4 and sorted(v for v in found.values()) == [(1, 1, False), (4, 1, True)]
    index.drop()


def test_index_side_is_neither_shuffled_nor_sorted(spark):
    """Small sides are not broadcast here, as large ones wouldn't be."""
    index = exact_dedup.DigestIndex(spark, buckets=4)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for k in range(3):
            exact_dedup.exact_duplicates(documents(spark, [(10 * k + i, f"t{k * 5 + i}") for i in range(8)]), index)
        many = index.entries().count()
        index.compact()
        assert index.entries().count() == many == 18 and len(index.entries().inputFiles()) <= 4
        groups = exact_dedup.written(spark.createDataFrame([(b"x", 1, 1)], exact_dedup._ENTRIES), "test-groups")
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        plan = index.missing(groups)._jdf.queryExecution().executedPlan().toString()
        index_side = plan[plan.rindex("\n   +- "):]  # the second child of the join
        assert "SortMergeJoin" in plan and "Bucketed: true" in index_side and "Exchange" not in index_side and "Sort" not in index_side, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    index.drop()


def test_hot_groups_are_joined_apart(spark):
    texts = [(i, "same") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(300)]
    found = exact_dedup.exact_duplicates(documents(spark, texts)).collect()
    assert len(found) == 600 and sum(r["kept"] for r in found) == 301 and {r["group_size"] for r in found} == {1, 300}


# near dedup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_near(texts):
    sets = {i: shingles(t) for i, t in texts}
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            part[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def test_near_duplicates_like_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(12):  # chains and stars of edits around the threshold, in long and short texts
        base = [rng.choice(words) for _ in range(rng.choice([6, 9, 20, 60, 300]))]
        texts += [edited(rng, base, rng.randrange(0, 1 + max(1, len(base) // 40))) for _ in range(7)]
    center = [rng.choice(words) for _ in range(150)]
    texts += [edited(rng, center, 6) for _ in range(60)]  # a group whose members are linked mostly by way of few
    texts += [[rng.choice(words) for _ in range(40)] + center[:50] for _ in range(30)]  # a shared passage
    texts = [(i * 3, " ".join(t)) for i, t in enumerate(texts)]
    texts += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "one"), (9004, "ONE"), (9005, "a b c d"), (9006, "a b c d e"), (9007, "A  b\nc d\te"), (9008, "a\u00a0b c d e f")]
    texts += [(9010, "long " + " ".join(f"v{i}" for i in range(250_000))), (9011, " ".join(f"v{i}" for i in range(250_000)))]
    assert rows(near_dedup.near_duplicates(documents(spark, texts))) == sorted(plain_near(texts), key=repr)


def test_near_duplicates_edges(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    assert rows(near_dedup.near_duplicates(documents(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "z")]))) == sorted(
        [(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 1, None, True)], key=repr)
    docs = documents(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other"), (4, None)])
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_sketches():
    rng = np.random.default_rng(1)
    for shared, alone in ((900, 50), (700, 150), (300, 350), (6, 1), (3, 1)):
        errors, found = [], 0
        for _ in range(60):
            x = rng.integers(0, 2**63, shared + 2 * alone, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(x[: shared + alone]), np.sort(np.concatenate([x[:shared], x[shared + alone :]]))
            ka, kb = near_dedup.sketch(a), near_dedup.sketch(b)
            errors.append(near_dedup.estimate(ka, kb, len(a), len(b)) - shared / (shared + 2 * alone))
            found += (near_dedup.band_keys(ka[None]) == near_dedup.band_keys(kb[None])).any()
        assert abs(np.mean(errors)) < 0.03 + 0.1 * (shared < 10)
        assert found == 60 or shared / (shared + 2 * alone) < 0.7


def test_estimates_rule_out_no_link_of_small_sets():
    """Pairs exactly at the threshold, of every small size and some that fill the buckets."""
    rng = np.random.default_rng(2)
    for shared, one, other in [(3, 0, 1), (6, 0, 2), (6, 1, 1), (30, 5, 5), (300, 50, 50), (3000, 500, 500)]:
        assert 100 * shared >= near_dedup.PERCENT * (shared + one + other)
        for _ in range(3000 if shared < 100 else 100):
            x = rng.integers(0, 2**63, shared + one + other, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(x[: shared + one]), np.sort(np.concatenate([x[:shared], x[shared + one :]]))
            assert near_dedup._linked(a, b) and not near_dedup.ruled_out(near_dedup.sketch(a), near_dedup.sketch(b), len(a), len(b))


def test_word_hashes_do_not_depend_on_the_cut():
    text = " ".join(f"w{i % 977}é" for i in range(400_000))
    whole, together = next(near_dedup.shingle_sets([text])), list(near_dedup.shingle_sets(["x y", text[:5000], ""]))
    words = text.split(" ")
    assert len(whole) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and len(together) == 3 and len(together[2]) == 0


# mixing


def plain_shares(budget, children):
    """Water filling by raising the level again and again; children: name -> (cap, weight)."""
    left = {k: v for k, v in children.items() if v[1] > 0}
    got = {}
    while True:
        weight = sum(w for _, w in left.values())
        full = {k for k, (c, w) in left.items() if c * weight <= w * budget}
        if not full:
            return got | {k: w * budget // weight for k, (_, w) in left.items()}
        for k in full:
            got[k] = left[k][0]
            budget -= left.pop(k)[0]
        if not left:
            return got


def plain_mix(texts, langs, sources, weights, share, epochs, seed):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = defaultdict(list)
    for (i, t), a, b in zip(texts, langs, sources, strict=True):
        leaves[a or "", b or ""].append((i, count(t)))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budget = sum(size.values()) * share[0] // share[1]
    tops = {a: (sum(epochs * n for (x, _), n in size.items() if x == a), weights[0].get(a, 1)) for a, _ in leaves}
    out = []
    for a, part in plain_shares(budget, tops).items():
        own = {b: (epochs * size[x, b], weights[1].get(b, 1)) for x, b in leaves if x == a}
        for b, alloc in plain_shares(part, own).items():
            total = size[a, b]
            if not total:
                continue
            whole, rest = divmod(alloc, total)
            out += [(i, a, b, n, e) for e in range(whole) for i, n in leaves[a, b]]
            order = sorted(leaves[a, b], key=lambda d: (int(hashlib.md5(f"{seed}:{whole}:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:15], 16), d[0] or 0))
            used = 0
            for i, n in order:
                used += n
                if used > rest or not rest:
                    break
                out.append((i, a, b, n, whole))
    return out


@pytest.mark.parametrize(("share", "epochs"), [((3, 5), 2), ((1, 1), 1), ((1, 7), 3), ((9, 1), 2)])
def test_mixing_like_a_plain_restatement(spark, share, epochs):
    rng = random.Random(share[0])
    n = 160
    texts = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 40])) if i % 17 else None) for i in range(n)]
    langs, sources = [rng.choice(["en", "en", "de", "fr", None]) for _ in range(n)], [rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(n)]
    weights = [{"en": 5, "de": 2, "fr": 0}, {"a": 1, "b": 4}]
    got = mixing.mix(documents(spark, texts, langs, sources), ["lang", "source"], weights, share, epochs, 11)
    assert rows(got) == sorted(plain_mix(texts, langs, sources, weights, share, epochs, 11), key=repr)


def test_mixing_edges(spark):
    assert mixing.mix(documents(spark, []), ["lang"], [{}]).count() == 0
    assert mixing.mix(documents(spark, [(1, None), (2, "")]), ["lang"], [{}]).count() == 0
    docs = documents(spark, [(1, "a b"), (1, "a b"), (None, "c"), (3, "d e f")])
    out = mixing.mix_documents(docs, {"lang": F.col("lang"), "key": F.col("key")}, [{}, {}], (2, 1), 2)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == {1: 4, None: 2, 3: 2}
    counts = [r[0] for r in spark.createDataFrame([("a b",), (" a\n\tb ",), ("",), (None,), ("a\u00a0b",)], "t string").select(mixing.word_count(F.col("t"))).collect()]
    assert counts == [2, 2, 0, 0, 1]


def test_mixing_refuses_fractions(spark):
    with pytest.raises(ValueError, match="whole"):
        mixing.mix(documents(spark, [(1, "a")]), ["lang"], [{"en": 0.5}])


# URL filter


def test_url_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    urls = ["https://A.Example.NET/en/1?x", "http://b.net/x", "http://net", "http://net/", "http://notnet.x/", "http://example.com/de/", "http://example.com/de", "http://w.example.com/de/2#t",
            "http://x.org/fr/", "http://xorg/fr/", None, "no url", "http://", "a://b://c/d", "http://h?q=http://net/"]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules for h, _, p in [r[1].partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, key=lambda r: len(r[1]), default=(None, None))
        assert found[i][:3] == (host, path, best[1])
        assert best[0] is None or found[i][3] == best[0]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_url_templates(spark):
    rows_ = [(f"http://h/blog/{i}.html", 0) for i in range(30)] + [(f"http://h/pills/{i}", 1) for i in range(30)] + [("http://h/pills/new", None), ("http://h/misc/1", None), ("http://h/deadbeef01/x", None)]
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows_)], "page_id bigint, url string, y int")
    found = {rows_[r["page_id"]][0]: (r["template"], r["verdict"]) for r in url_filter.judge_urls(pages, [], label=F.col("y")).collect()}
    assert found["http://h/blog/3.html"][1] == "allow" and found["http://h/pills/new"] == ("h/pills/*", "block") and found["http://h/misc/1"][1] == "allow"
    assert found["http://h/pills/1"][0].startswith("h/pills/") and found["http://h/deadbeef01/x"][0].startswith("h/*")


def test_url_branches_without_labels_are_no_evidence(spark):
    """One labelled branch, others without labels beside it; under a node told apart by labels a branch inherits."""
    lone = [(f"http://lone/de/{i}.html", 1) for i in range(40)] + [(f"http://lone/{x}/{i}.html", None) for x in ("en", "fr", "es") for i in range(20)]
    like = [(f"http://like/{x}/{i}.html", 1) for x in ("a", "b") for i in range(20)] + [(f"http://like/c/{i}.html", None) for i in range(20)]
    told = [(f"http://told/blog/{i}", 0) for i in range(30)] + [(f"http://told/pills/{i}", 1) for i in range(30)] + [("http://told/pills/new", None)]
    rows_ = lone + like + told
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows_)], "page_id bigint, url string, y int")
    found = {rows_[r["page_id"]][0]: r["verdict"] for r in url_filter.judge_urls(pages, [], label=F.col("y")).collect()}
    for u, y in lone + like:
        assert found[u] == ("block" if y else "allow"), u
    assert found["http://told/pills/new"] == "block" and found["http://told/blog/3"] == "allow"
    by_rule = url_filter.judge_urls(pages.filter("url LIKE 'http://lone/%'"), [("block", "lone/de/")])
    assert {tuple(r) for r in by_rule.select("rule", "verdict").distinct().collect()} == {("lone/de/", "block"), (None, "allow")}


def test_url_paths_of_any_depth(spark):
    """What differs behind the third segment only; and one path of very many segments."""
    bad = [(f"http://h/a/b/c/pills/{i}/x", 1) for i in range(30)] + [(f"http://h/a/b/c/pills/{i}/new", None) for i in range(5)]
    good = [(f"http://h/a/b/c/blog/{i}/x", 0) for i in range(30)] + [(f"http://h/a/b/c/blog/{i}/new", None) for i in range(5)]
    deep = "http://h/" + "/".join(["a", "b", "c", "blog", *["z"] * 300])
    rows_ = bad + good + [(deep, None)]
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows_)], "page_id bigint, url string, y int")
    found = {r["page_id"]: (r["verdict"], r["template"]) for r in url_filter.judge_urls(pages, [], label=F.col("y")).collect()}
    assert len(found) == len(rows_)
    for i in range(len(rows_)):
        assert found[i][0] == ("block" if i < len(bad) else "allow"), rows_[i]
    assert found[0][1].startswith("h/*/*/*/pills/") and found[len(rows_) - 1][1] == "h/*/*/*/blog" + "/*" * 300


# license scan


def plain_words(text):
    return [(m.group(), m.start()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))]


def test_license_base_phrases(spark):
    rng = random.Random(2)
    pool = ["MIT", "License", "license", "apache", "CC", "by", "GNU", "General", "Public", "x", "mitlicense", "é"]
    gaps = [" ", "-", "\n", ". ", "/", "_", "\x7f"]
    texts = [(i, "".join(rng.choice(pool) + rng.choice(gaps) for _ in range(rng.randrange(30)))) for i in range(80)] + [(100, None), (101, ""), (102, "x " * 100_000 + "mit license")]
    found = {r["doc_id"]: r.asDict() for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    for i, t in texts:
        words = [w for w, _ in plain_words(t)]
        at = sorted((k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl"),
    ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa-4.0"), ("GNU Lesser General Public License v2.1", "lgpl-2.1"), ("the Mozilla Public License 2.0", "mpl-2.0"), ("nothing here", ""),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("mit License der Stadt", "mit")])
def test_license_signatures(text, labels):
    assert license_scan.scan_text(text)[5] == labels


def test_every_license_rule_is_gated():
    assert all(r.keywords for r in license_scan.signature_rules())
    assert license_scan.scan_text("under CC0 1.0")[5] == "cc0" and license_scan.scan_text("under 1.0")[5] == ""


def test_containment_like_a_plain_restatement():
    rng = random.Random(12)
    for _ in range(200):
        spans = sorted({(-rng.choice([1, 2, 3]), a - b, a, b, rng.choice("xyz")) for a, b in (sorted(rng.sample(range(30), 2)) for _ in range(rng.randrange(40)))})
        kept = []
        for s in spans:
            if not any(k[2] <= s[2] and s[3] <= k[3] for k in kept):
                kept.append(s)
        assert license_scan.uncontained(spans) == kept


def test_license_gate_drops_nothing():
    texts = ["Licensed under the Apache License, Version 2.0. See also MIT license", "all rights reserved", "cc by nd 3.0", "dual BSD 3-clause license and ISC license", "https://www.gnu.org/licenses/gpl-3.0"]
    for text in texts:
        raw = text.encode().translate(license_scan._LOWER)
        hits = {r.label for r in license_scan.signature_rules() if r.pattern.search(raw)}
        gated = {r.label for r in license_scan.signature_rules() if set(r.keywords) <= set(re.findall(r"[a-z0-9]+", low(text))) and r.pattern.search(raw)}
        assert hits == gated and hits
    assert 200 < len(license_scan.signature_rules())


def test_license_gate_drops_no_rule():
    """One example of each name, form, tag, address and whole notice."""
    ls = license_scan
    made = [f"{before} {name} {behind}{v}" for _, _, names, versions in ls._FAMILIES for name in names for before, behind, *_ in ls._FORMS for v in ("", *[" version " + v for v in versions])]
    made += [f"{before} {tag}" for tags in ls._TAGS.values() for tag in tags for before in ("spdx license identifier", "licensed under")]
    made += [words for _, words, _ in ls._ADDRESSES] + [words for _, words, *_ in ls._WHOLE]
    made = [re.sub(r"\(([^|)]*)\|[^)]*\)", r"\1", m).replace("f[a-z]*", "foo").replace("?", "").strip() for m in made]
    made += [f"cc {part} 4.0" for part in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")]
    for text in made:
        raw, words = text.encode().translate(ls._LOWER), set(re.findall(r"[a-z0-9]+", text))
        hits = [r for r in ls.signature_rules() if r.pattern.search(raw)]
        assert (hits or text.startswith("licensed under")) and all(set(r.keywords) <= words for r in hits), text
    assert "mit" in ls.scan_text("Licensed under the Expat License")[5].split(",")


# media


def test_media_round_trip(spark, tmp_path):
    texts = [(1, "héllo"), (2, ""), (3, None), (4, "x" * 576), (5, "x" * 577), (6, "héllo"), (7, "long " * 60_000), (None, "n")]
    base = (tmp_path / "shards").as_uri()
    index = media.store_texts(documents(spark, texts).repartition(2), base, shard_bytes=2000)
    found = {r["doc_id"]: r for r in media.with_features(media.with_metadata(index, base), base).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["width"], r["height"], r["bit_depth"], r["colour_type"]) == (576, len(payload) // 576, 8, 0) and r["media_sha256"] == r["digest"] and r["media_bytes"] == r["length"]
    assert found[1]["feature"] == found[6]["feature"] and found[2]["media_sha256"] == found[3]["media_sha256"]
    import tarfile

    names = [m for p in (tmp_path / "shards").glob("*.tar") for m in tarfile.open(p).getmembers()]
    assert {m.name for m in names} == {r["digest"] + ".png" for r in found.values()} and len(names) < 2 * len(found)
    assert media.media_columns(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(b"a" * 576)[:-20] + b"x" * 20)


# pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.model_bytes())


def every_path(model, chunk):
    out = []

    def go(at, score, ids):
        if at == len(chunk):
            out.append((score, ids))
        for end in range(at + 1, min(len(chunk), at + model.longest) + 1):
            found = model.by_text.get(chunk[at:end])
            if found:
                go(end, score + found[1], [*ids, found[0]])
            elif end == at + 1:
                go(end, score + model.unknown, ids + model.edge_ids(chunk[at:end]))

    go(0, 0.0, [])
    return out


def test_n_best_like_brute_force(model):
    rng = random.Random(4)
    for text in ["thing is on", "a  b", "▁x", "日本語の", "é é", "", "\ue000", *("".join(rng.choice("thein ao.é\n") for _ in range(9)) for _ in range(25))]:
        whole = pieces._SPACE + text.replace("▁", pieces._LITERAL).replace(" ", "▁") if text else ""
        paths = every_path(model, whole) if whole else [(0.0, [])]
        for n in (1, 2, 5):
            (ids, scores, lists), = pieces.Encoder(model, n).encode([text])
            assert scores == sorted((s for s, _ in paths), reverse=True)[:n]
            real = {tuple(i): s for s, i in paths}
            assert [real[tuple(x.tolist())] for x in lists] == scores and len({tuple(x.tolist()) for x in lists}) == len(lists)
            assert all(model.decode(x) == text for x in lists) and ids.tolist() == lists[0].tolist()
        if whole:
            assert [s for s, _ in model.nbest(whole, 3)] == sorted((s for s, _ in paths), reverse=True)[:3]


def test_arrays_and_single_chunks_agree(model):
    rng = random.Random(8)
    chunks = list({"▁" + "".join(rng.choice("thenrsaeouié日") for _ in range(rng.randrange(1, 12))) for _ in range(400)})
    best, lost, count, ids = model.segment(chunks)
    at = np.concatenate([[0], np.cumsum(count)])
    for k, c in enumerate(chunks):
        b, s, back = model.forward(c)
        assert (best[k], lost[k], ids[at[k] : at[k + 1]].tolist()) == (b[-1], b[-1] - s[-1], model._ids(c, back))


def test_encoding_documents(spark, model):
    texts = [(1, "Hello world"), (2, None), (3, ""), (4, "x" * 3000 + " " + "é" * 200), (5, "a\x00b\r\n\t ▁"), (1, "Hello world")]
    docs = documents(spark, texts)
    found = pieces.encode_documents(docs).collect()
    assert len(found) == 6 and all(r["round_trip"] for r in found) and pieces.encode_documents(documents(spark, [])).count() == 0
    assert {r["doc_id"]: r["text_sha256"] for r in found} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts}
    back = pieces.decoded(pieces.encoded(docs, ["doc_id", "text"]).withColumnRenamed("text", "was"))
    assert all(r["text"] == (r["was"] or "") for r in back.collect())


def test_pipeline_takes_the_n_best(spark, model):
    """The pipeline's last stage runs A-star and decodes: all paths of short texts are known, so are the four best."""
    import corpus_pipeline

    texts = [(1, "thing is"), (2, None), (3, ""), (4, "a\n ▁é"), (5, "日本"), (1, "thing is")]
    out = corpus_pipeline.STAGES[-1][1](spark, documents(spark, texts), "")
    found = out.collect()
    assert len(found) == 6 and out.columns[:4] == ["doc_id", "lang", "source", "ids"]
    for r in found:
        text = dict(texts)[r["doc_id"]] or ""
        whole = pieces._SPACE + text.replace("▁", pieces._LITERAL).replace(" ", "▁") if text else ""
        paths = every_path(model, whole) if whole else [(0.0, [])]
        real = {tuple(i): s for s, i in paths}
        ways = [r["ids"][: w["at"]] + w["put"] + r["ids"][w["at"] + w["drop"] :] for w in r["nbest"]]
        assert [w["score"] for w in r["nbest"]] == sorted((s for s, _ in paths), reverse=True)[:4] == [real[tuple(i)] for i in ways]
        assert r["ids"] == ways[0] and len(set(map(tuple, ways))) == len(ways)
        assert all(model.decode(i) == text for i in ways) and r["round_trip"] and r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert corpus_pipeline.STAGES[-1][1](spark, documents(spark, []), "").count() == 0


# classifiers


def labelled(spark, n=240):
    """Toxic texts hold made-up stems now and then; bad ones marks behind words."""
    rng = random.Random(6)
    plain = ["".join(rng.choice(["tho", "re", "an", "ing", "es", "ti", "la"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(30, 120))]
        toxic, good = int(i % 3 == 0), int(i % 4 != 0)
        for _ in range(4 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["zorgak", "mupfel", "quibbot"]) + rng.choice(["", "s", "ing"])
        if not good:
            words = [w + "!!" for w in words]
        texts.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    texts += [(5000, None), (5001, ""), (5002, "zorgak " * 50_000)]
    return documents(spark, texts), spark.createDataFrame([*labels, (None, 1, 1), (9999, 0, 0), (5001, None, None)], "doc_id bigint, quality int, toxic int"), {i: (g, t) for i, g, t in labels}


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(found) == 243 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    held = [(found[i]["predicted"], t[1]) for i, t in truth.items() if found[i]["held_out"]]
    assert np.mean([p == t for p, t in held]) > 0.9 and found[5002]["predicted"] == 1 and found[5000]["score"] == found[5001]["score"] < 0.3
    kept = toxicity.drop_toxic(docs, labels, fold(F.col("_id"), 4) != 2)
    assert kept.columns == docs.columns and np.mean([truth[r["doc_id"]][1] for r in kept.collect() if r["doc_id"] in truth]) < 0.05


def test_toxicity_score_by_hand(spark):
    """One score recomputed with zstandard from the model's two dictionaries."""
    import zstandard

    docs, labels, _ = labelled(spark)
    model = toxicity.train(docs, labels, F.lit(True))
    assert model.ordinary[:4] == model.toxic[:4] == b"\x37\xa4\x30\xec" and model.ordinary != model.toxic
    text = "Zorgak tho-re, 17 ing! " * 5 + "quibbots an es"
    words = text.encode().lower().split()
    parts = [b" " + b" ".join(words[i : i + 6]) + b" " for i in range(0, len(words), 6)]
    sizes = []
    for d in (model.ordinary, model.toxic):
        log = max(17, (len(d) - 1).bit_length() + 1)
        params = zstandard.ZstdCompressionParameters(window_log=log, chain_log=log, hash_log=log, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_BTOPT,
                                                     write_content_size=False, write_checksum=False, write_dict_id=False)
        held = zstandard.ZstdCompressionDict(d)
        held.precompute_compress(compression_params=params)
        by = zstandard.ZstdCompressor(dict_data=held, compression_params=params)
        frames = [by.compress(p) for p in parts]
        back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d))
        assert [back.decompress(f, max_output_size=1000) for f in frames] == parts
        sizes.append(np.array([len(f) for f in frames]))
    z = toxicity.spread_of(sizes[0] - sizes[1]) @ model.weights[:-1] + model.weights[-1]
    assert toxicity.score_texts([text], model)[0] == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_compresses_equal_windows_once(spark):
    """Texts that are scored together: each distinct window goes through each dictionary once, and every text scores as it does alone."""
    docs, labels, _ = labelled(spark)
    model = toxicity.train(docs, labels, F.lit(True))
    by, seen = toxicity.Distance(model.ordinary, model.toxic), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def compress(self, part):
            seen.append(part)
            return self.inner.compress(part)

    texts = ["zorgak tho re an ing es " * 40, None, "zorgak tho re an ing es mupfel", "", "x" * 1500, *[r["text"] for r in docs.limit(20).collect()], "", "tho"]
    alone = [toxicity.score_texts([t], model)[0] for t in texts]
    parts = [toxicity.windows(t) for t in texts]
    gains = [np.array([len(by.pair[0].compress(x)) - len(by.pair[1].compress(x)) for x in p]) for p in parts]
    by.pair = tuple(map(Counted, by.pair))
    assert toxicity.score_texts(texts, model, by) == pytest.approx(alone, abs=1e-12)
    assert sorted(seen) == sorted(2 * list({x for p in parts for x in p}))
    for row, g in zip(by.features(texts), gains, strict=True):
        g = np.clip(g, -32, 32)
        want = [g.mean(), np.median(g), *(np.quantile(g, [0.9, 0.75]) - np.median(g)), np.sort(g)[-3:].mean() - np.median(g)] if len(g) else [0] * 5
        assert row[:5] == pytest.approx(want) and row[8] == np.log1p(len(g))


def test_toxicity_windows():
    rng = random.Random(12)
    texts = [None, "", " ", "\n\t", "A", " b", "c ", *("".join(rng.choice([" ", "  ", "\n", "\x0b", "\x1c", "\u3000", "A", "bc", "É", "'", "x" * 300]) for _ in range(rng.randrange(60))) for _ in range(3000))]
    for text in texts:
        words = low(text).encode().split()
        for size in (1, 4, 6):
            made = [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]
            assert toxicity.windows(text, size) == [w[i : i + toxicity.LONGEST] for w in made for i in range(0, len(w), toxicity.LONGEST)]


def test_toxic_dictionary_is_trained_by_zstandard(spark):
    """Toxic strings inside words and of three letters count too, and zstandard makes the dictionary of them."""
    rng = random.Random(8)
    plain = ["".join(rng.choice(["tho", "re", "an", "ing", "es", "ti", "la"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = [[rng.choice(plain) for _ in range(80)] for _ in range(240)]
    for words in texts[::3]:
        for _ in range(6):
            words[rng.randrange(80)] = rng.choice(["zog", rng.choice(plain) + "quib"])
    docs = documents(spark, [(i, " ".join(w)) for i, w in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert model.toxic[:4] == b"\x37\xa4\x30\xec" and b" zog " in model.toxic and b"quib " in model.toxic
    clean = texts[1]
    short, inside = ([bad if i % 13 == 6 else w for i, w in enumerate(clean)] for bad in ("zog", plain[7] + "quib"))
    found = toxicity.score_texts([" ".join(t) for t in (short, clean, inside)], model)
    assert found[0] > 0.5 and found[1] < 0.3 and found[2] > 0.5


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    found = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert len(found) == 243 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert np.mean([found[i]["predicted"] == t[0] for i, t in truth.items() if found[i]["held_out"]]) > 0.95


def test_classifiers_without_labels(spark):
    docs, labels, _ = labelled(spark, 12)
    for score, none in ((toxicity.toxicity(docs, labels.limit(0)), 0.0), (quality.quality(docs, labels.filter("quality = 1")), 1.0)):
        assert {r["score"] for r in score.collect()} == {none}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and quality.quality(docs.limit(0), labels).count() == 0


def test_held_out_rows_never_train(spark):
    docs, labels, _ = labelled(spark, 120)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows(toxicity.toxicity(docs, labels)) == rows(toxicity.toxicity(docs, flipped))


def test_dual_descent_separates():
    rng = np.random.default_rng(3)
    rows_ = [np.unique(np.concatenate([rng.integers(0, 40, 5), [50 + y]])) for y in [0, 1] * 50]
    y = np.array([-1, 1] * 50)
    w, b = quality.dual_descent(rows_, np.ones(60), y, np.ones(100))
    assert all(np.sign(w[r].sum() + b) == t for r, t in zip(rows_, y, strict=True)) and not math.isnan(b)


# preference


def test_preferences(spark):
    talk = {1: ["q", "yes"], 2: ["q", "no way"], 3: ["q", "yes"], 4: ["other", "a", "b", "c"], 5: ["q"], 6: ["<|user|>", None]}
    turns = [(c, k, ("user", "assistant")[k % 2], t, "k") for c, texts in talk.items() for k, t in enumerate(texts)]
    turns += [turns[0], (None, 0, None, "lost", "k")]
    table = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, key string")
    found = preference.preferences(table).collect()
    seen = [r["chosen_id"] for r in found] + [r["rejected_id"] for r in found if r["status"] != "single"]
    assert sorted(x or 0 for x in seen) == [0, 1, 2, 3, 4, 5, 6]
    texts = {c: [t or "" for t in x] for c, x in talk.items()}
    for r in found:
        for side in ("chosen", "rejected"):
            if r[f"{side}_text"] is not None:
                inside = [r[f"{side}_text"][s["start"] : s["end"]] for s in r[f"{side}_mask"]]
                assert all(x in r[f"{side}_text"] for x in inside)
                if r[f"{side}_id"] in texts:
                    own = texts[r[f"{side}_id"]]
                    assert inside == [t for k, t in enumerate(own) if k % 2 and k >= r["n_prompt_turns"]]
        if r["status"] == "pair":
            a, b = texts[r["chosen_id"]], texts[r["rejected_id"]]
            k = r["n_prompt_turns"]
            assert a[:k] == b[:k] and a[k] != b[k] and r["prompt"].count("<|user|>") == (k + 1) // 2
    single = next(r for r in found if r["chosen_id"] == 4)
    assert single["status"] == "single" and single["prompt"] == "<|user|>\nother\n<|assistant|>\na\n<|user|>\nb\n" and single["chosen_text"] == "<|assistant|>\nc\n"
    assert preference.preferences(table.limit(0)).count() == 0


def test_large_groups_make_half_as_many_pairs(spark):
    turns = [(c, k, ("user", "assistant")[k], ["hi", f"answer {c}"][k]) for c in range(5001) for k in (0, 1)]
    found = preference.preferences(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    assert dict(found.groupBy("status").count().collect()) == {"pair": 2500, "single": 1}
