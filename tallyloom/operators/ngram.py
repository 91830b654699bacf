"""n-grams of consecutive tokens of a line. A dropped token breaks the run, as the end of a line does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import Filters, cleaned, lines_of, raw_tokens, too_short_or_long
from tallyloom.operators.distinct import ALPHABETICAL, PRESERVE, first_places, row_key
from tallyloom.operators.tokens import per_line
from tallyloom.sources.tables import ORDER


def _marked(line: Column, filters: Filters) -> Column:
    """The tokens of a line in order, a null in the place of each that is dropped."""
    parts = raw_tokens(line)
    if filters.trim:
        parts = cleaned(parts, Filters(trim=True, drop_empty=False))
        if filters.drop_empty:
            parts = F.transform(parts, lambda t: F.when(t != "", t))
    if filters.drops_lengths:
        parts = F.transform(parts, lambda t: F.when(~too_short_or_long(t, filters), t))
    return parts


def line_ngrams(line: Column, n: int, filters: Filters = Filters()) -> Column:
    """All n-grams of a line in order, tokens joined by a space. A token that is dropped is a null in its line meanwhile.

    The tokens are bound as the element of an array of one, else each window would split the line anew.
    """
    parts = _marked(line, filters)
    broken = filters.drops_lengths or (filters.trim and filters.drop_empty)

    def grams(tokens: Column) -> Column:
        last = F.size(tokens) - n + 1

        def gram(i: Column) -> Column:
            window = F.slice(tokens, i, n)
            joined = F.array_join(window, " ")
            return F.when(~F.exists(window, lambda t: t.isNull()), joined) if broken else joined

        made = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), gram)
        made = F.filter(made, lambda g: g.isNotNull()) if broken else made
        return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(parts), grams), F.lit(0))


def _check(n: int) -> None:
    if not 2 <= n <= 20:
        raise ValueError("n must be from 2 to 20")


def _arrays(corpus: DataFrame, n: int, filters: Filters) -> DataFrame:
    """(file_idx, part, line_no, grams): all n-grams of each corpus row, in order."""
    _check(n)
    return corpus.select(*ORDER, per_line(corpus, lambda line: line_ngrams(line, n, filters)).alias("grams"))


def ngrams(corpus: DataFrame, n: int, filters: Filters = Filters()) -> DataFrame:
    """(file_idx, part, line_no, pos, ngram): one row for each n-gram."""
    return _arrays(corpus, n, filters).select(*ORDER, F.posexplode("grams").alias("pos", "ngram"))


def _windows(corpus: DataFrame, n: int, filters: Filters) -> DataFrame:
    """(at, seen, ngram): a row for each n-gram, and for each line one more at -1, without an n-gram, that has the number of its kept tokens.

    Windows are rows before they are strings, so the strings are made in compiled code, from one look at the text.
    """
    _check(n)
    if "text" in corpus.columns:
        corpus = corpus.select(F.explode(lines_of(F.col("text"))).alias("line"))
    rows = corpus.select(_marked(F.col("line"), filters).alias("tokens"))
    places = F.sequence(F.lit(-1), F.greatest(F.size("tokens") - n, F.lit(-1)))
    rows = rows.select("tokens", F.explode(places).alias("at"))
    apart = [x for j in range(n) for x in (F.lit(" "), F.get("tokens", F.col("at") + j))][1:]
    seen = F.when(F.col("at") < 0, F.greatest(F.size(F.array_compact("tokens")), F.lit(0)).cast("bigint"))
    return rows.select("at", seen.alias("seen"), F.when(F.col("at") >= 0, F.concat(*apart)).alias("ngram"))


def distinct_ngrams(corpus: DataFrame, n: int, filters: Filters = Filters(), ordering: str = PRESERVE) -> DataFrame:
    """(ngram): distinct n-grams in the order of first occurrence, in UTF-8 byte order, or in none."""
    if ordering == PRESERVE:
        rows = _arrays(corpus, n, filters)
        placed = rows.select(row_key().alias("row"), F.posexplode(F.array_distinct("grams")).alias("pos", "ngram"))
        return first_places(placed, "ngram").orderBy("first").select("ngram")
    out = _windows(corpus, n, filters).filter("ngram IS NOT NULL").select("ngram").distinct()
    return out.orderBy("ngram") if ordering == ALPHABETICAL else out


def ngram_stats(corpus: DataFrame, n: int, filters: Filters = Filters()) -> DataFrame:
    """One row (tokens_seen, ngrams_seen, unique_ngrams); tokens count after filters."""
    rows = _windows(corpus, n, filters).filter("at < 0 OR ngram IS NOT NULL")
    counted = rows.groupBy("ngram").agg(F.count(F.lit(1)).alias("_n"), F.sum("seen").alias("_seen"))  # the group without an n-gram has the tokens
    grams = F.coalesce(F.sum(F.when(F.col("ngram").isNotNull(), F.col("_n"))), F.lit(0))
    return counted.agg(F.coalesce(F.sum("_seen"), F.lit(0)).alias("tokens_seen"), grams.alias("ngrams_seen"), F.count("ngram").alias("unique_ngrams"))
