"""From a corpus to its tokens, and the counters that every query reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import Filters, cleaned, lines_of, raw_tokens, text_tokens, too_short_or_long
from tallyloom.sources.tables import ORDER


def per_line(corpus: DataFrame, make) -> Column:
    """``make`` of the line, or of all lines of a text one after another."""
    if "text" in corpus.columns:
        return F.flatten(F.transform(lines_of(F.col("text")), make))
    return make(F.col("line"))


def _row_tokens(corpus: DataFrame, make) -> Column:
    """``make`` of lines, where it changes no token of a line without odd white space."""
    return text_tokens(F.col("text"), make) if "text" in corpus.columns else make(F.col("line"))


def token_arrays(corpus: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """(file_idx, part, line_no, tokens): the kept tokens of each corpus row, in order."""
    tokens = _row_tokens(corpus, lambda line: cleaned(raw_tokens(line), filters))
    if filters.drops_lengths:
        tokens = F.filter(tokens, lambda t: ~too_short_or_long(t, filters))
    return corpus.select(*ORDER, tokens.alias("tokens"))


def tokens(corpus: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """(token): one row for each kept token."""
    return token_arrays(corpus, filters).select(F.explode("tokens").alias("token"))


def counted_arrays(corpus: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """(file_idx, tokens, seen, kept, filtered): of each corpus row its kept tokens, and how many there were before filters, after
    them, and dropped for their length. All from one look at the text."""
    rows = corpus.select("file_idx", _row_tokens(corpus, raw_tokens).alias("_raw")).withColumn("_clean", cleaned(F.col("_raw"), filters))
    kept = F.filter("_clean", lambda t: ~too_short_or_long(t, filters)) if filters.drops_lengths else F.col("_clean")
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("bigint")
    rows = rows.select("file_idx", kept.alias("tokens"), size("_raw").alias("seen"), size("_clean").alias("_n")).withColumn("kept", size("tokens"))
    return rows.select("file_idx", "tokens", "seen", "kept", (F.col("_n") - F.col("kept")).alias("filtered"))


def with_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., token, seen, kept, filtered) from ``counted_arrays``: the distinct tokens of each row, and one row without a token that has its counts.

    So one shuffle by token can carry both; the rows without a token are summed up before it.
    """
    nothing = F.lit(0).cast("bigint")
    counts = F.array(F.struct(F.lit(None).cast("string").alias("token"), "seen", "kept", "filtered"))
    plain = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), nothing.alias("seen"), nothing.alias("kept"), nothing.alias("filtered")))
    return rows.select(*keys, F.inline(F.concat(counts, F.coalesce(plain, F.slice(counts, 1, 0)))))
