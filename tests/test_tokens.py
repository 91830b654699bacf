"""Tokenizer: examples, and equality with a plain restatement over an alphabet of edge cases."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions.markup import html_text
from tallyloom.functions.tokens import Filters, kept_tokens, lines_of, raw_tokens, trimmed
from tallyloom.sources.epub import markup_text

_WHITE = [chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ALPHABET = "ab,;\t\n\x0b\x0c\r \x1c\x85\xa0é\u2003\u2028\u3000\u200b\ufeff\u180e<>&"


def plain_tokens(line):
    cuts = " \t\n\x0c\r,;" if line.isascii() else "".join(_WHITE) + ",;"
    out, word = [], ""
    for c in line:
        if c in cuts:
            out.append(word)
            word = ""
        else:
            word += c
    return [w for w in [*out, word] if w]


def plain_kept(line):
    return [t for t in (t.strip("".join(_WHITE)) for t in plain_tokens(line)) if t]


def run(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in rows.select(expr(F.col("x")), "i").orderBy("i").collect()]


def test_examples(spark):
    assert run(spark, ["k;l\tm\r,n o", "sieben\u2009acht;neun\u3000zehn", "", ";, ;"], raw_tokens) == [["k", "l", "m", "n", "o"], ["sieben", "acht", "neun", "zehn"], [], []]


def test_vertical_tab(spark):
    lines = ["a\x0bb", "é\x0bb", "\x0b", "\x0ba", "a \x0b b"]
    assert run(spark, lines, raw_tokens) == [["a\x0bb"], ["é", "b"], ["\x0b"], ["\x0ba"], ["a", "\x0b", "b"]]
    assert run(spark, lines, lambda x: kept_tokens(x)) == [["a\x0bb"], ["é", "b"], [], ["a"], ["a", "b"]]
    assert run(spark, ["\x0b"], lambda x: kept_tokens(x, Filters(drop_empty=False))) == [[""]]


def test_length_filter_needs_both_ends(spark):
    assert run(spark, ["a bb ccc é"], lambda x: kept_tokens(x, Filters(drop_length_min=1, drop_length_max=2))) == [["ccc"]]
    assert run(spark, ["a bb ccc"], lambda x: kept_tokens(x, Filters(drop_length_min=1))) == [["a", "bb", "ccc"]]


def test_lines(spark):
    assert run(spark, ["a\nb\n", "a\r\nb", "", "\n", "a\n\n"], lines_of) == [["a", "b"], ["a\r", "b"], [""], [""], ["a", ""]]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(_ALPHABET, max_size=12), min_size=20, max_size=60))
def test_like_a_plain_restatement(spark, lines):
    lines = [x.replace("\n", " ") for x in lines]
    assert run(spark, lines, raw_tokens) == [plain_tokens(x) for x in lines]
    assert run(spark, lines, lambda x: kept_tokens(x)) == [plain_kept(x) for x in lines]
    assert run(spark, lines, trimmed) == [x.strip("".join(_WHITE)) for x in lines]


def test_markup(spark):
    texts = ["<p>one<br/>two</p>", "5 &gt; 4 &amp;&nbsp;&quot;so&quot;", "x &euro; y", "a > b < c", "&amp;lt;", "<script>x</script>"]
    want = [" one two ", '5 > 4 & "so"', "x &euro; y", "a   b ", "&lt;", " x "]
    assert run(spark, texts, html_text) == want == [markup_text(t) for t in texts]
