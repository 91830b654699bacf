"""Exact distinct tokens in three orders, with their counters.

Within a corpus row ``array_distinct`` keeps first occurrences in order, so a row hands on each token once and its place
among the row's distinct tokens orders it as well as its place among all. Most repeats never reach the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import Filters
from tallyloom.operators.tokens import counted_arrays, token_arrays, with_counts

PRESERVE, ALPHABETICAL, UNORDERED = "preserve", "alphabetical", "unordered"

_LOW_LINE = (1 << 33) - 1  # line numbers from a partition's row ids: the lower bits order the lines of a part
_PART, _FILE, SIDE = 10**10, 10**30, 10**37


def number(n: int) -> Column:
    return F.expr(f"cast('{n}' AS decimal(38,0))")


def row_key() -> Column:
    """One number that orders corpus rows as (file_idx, part, line_no) do: file_idx below 10^7, any part, line_no by its lower 33 bits.

    Aggregates over it stay in a hash table, which has no room for a struct; a struct would be sorted on both sides of the shuffle.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    part = wide(wide(F.col("part")) + number(2**63))
    line = wide(F.col("line_no").bitwiseAND(_LOW_LINE))
    return wide(wide(wide(F.col("file_idx")) * number(_FILE)) + wide(wide(part * number(_PART)) + line))


def part_of(first: Column) -> Column:
    """The corpus row's ``part`` from a first occurrence."""
    low = first["row"] % number(_FILE)
    return (F.floor(low / number(_PART)).cast("decimal(38,0)") - number(2**63)).cast("bigint")


def first_places(rows: DataFrame, what: str) -> DataFrame:
    """(what, first) from rows (row, pos, what): the place of each value's first occurrence, as a struct (row, pos) to order by.

    A row has each value once, so the smallest row has one place only.
    """
    found = rows.groupBy(what).agg(F.min("row").alias("row"), F.min_by("pos", "row").alias("pos"))
    return found.select(what, F.struct("row", "pos").alias("first"))


def first_seen(corpus: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """(token, first): each distinct token and where it comes first, to order by."""
    rows = token_arrays(corpus, filters).select(row_key().alias("row"), F.posexplode(F.array_distinct("tokens")).alias("pos", "token"))
    return first_places(rows, "token")


def distinct_tokens(corpus: DataFrame, filters: Filters = Filters(), ordering: str = PRESERVE, buckets: int | None = None) -> DataFrame:
    """(token): distinct tokens in the order of first occurrence, in UTF-8 byte order, or in none.

    ``buckets`` deals tokens by hash into so many partitions first; alphabetical order then holds within each.
    """
    if ordering == PRESERVE:
        return first_seen(corpus, filters).orderBy("first").select("token")
    rows = token_arrays(corpus, filters).select(F.explode(F.array_distinct("tokens")).alias("token"))
    if buckets:
        dealt = rows.repartition(buckets, "token").dropDuplicates(["token"])
        return dealt.sortWithinPartitions("token") if ordering == ALPHABETICAL else dealt
    return rows.distinct().orderBy("token") if ordering == ALPHABETICAL else rows.distinct()


def dedupe_stats(corpus: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """One row (files, tokens_seen, unique_tokens, duplicates, filtered_by_length); seen counts before filters."""
    rows = with_counts(counted_arrays(corpus, filters), "file_idx")
    owner = F.when(F.col("token").isNull(), F.col("file_idx"))  # counts stay with their file
    parts = rows.groupBy("token", owner.alias("own")).agg(*[F.sum(c).alias(c) for c in ("seen", "kept", "filtered")])
    sums = parts.agg(F.count("own").alias("files"), F.coalesce(F.sum("seen"), F.lit(0)).alias("tokens_seen"),
                     F.count("token").alias("unique_tokens"), F.coalesce(F.sum("kept"), F.lit(0)).alias("_kept"), F.coalesce(F.sum("filtered"), F.lit(0)).alias("filtered_by_length"))
    return sums.select("files", "tokens_seen", "unique_tokens", (F.col("_kept") - F.col("unique_tokens")).alias("duplicates"), "filtered_by_length")


def file_stats(corpus: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """(file_idx, tokens_seen, duplicates, unique_new, filtered_by_length); a token is new in the first file that has it."""
    rows = with_counts(counted_arrays(corpus, filters), "file_idx")
    owner = F.when(F.col("token").isNull(), F.col("file_idx"))  # counts stay with their file, a token goes to its first
    firsts = rows.groupBy("token", owner.alias("own")).agg(F.min("file_idx").alias("file_idx"), *[F.sum(c).alias(c) for c in ("seen", "kept", "filtered")])
    sums = firsts.groupBy("file_idx").agg(F.sum("seen").alias("tokens_seen"), F.sum("kept").alias("_kept"), F.count("token").alias("unique_new"), F.sum("filtered").alias("filtered_by_length"))
    return sums.select("file_idx", "tokens_seen", (F.col("_kept") - F.col("unique_new")).alias("duplicates"), "unique_new", "filtered_by_length")
