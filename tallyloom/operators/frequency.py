"""Token frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import Filters
from tallyloom.operators.tokens import tokens


def token_frequency(corpus: DataFrame, filters: Filters = Filters(), top_n: int | None = None) -> DataFrame:
    """(token, count), by count from high to low, then token in UTF-8 byte order; the first ``top_n`` if given."""
    counted = tokens(corpus, filters).groupBy("token").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc("token"))
    return counted if top_n is None else counted.limit(top_n)


def frequency_totals(corpus: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """One row (unique_tokens, tokens_seen) over the whole table; seen counts after filters."""
    counted = tokens(corpus, filters).groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(F.count(F.lit(1)).alias("unique_tokens"), F.coalesce(F.sum("_n"), F.lit(0)).alias("tokens_seen"))
