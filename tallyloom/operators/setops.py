"""Difference, intersection and union of the distinct tokens of two corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import Filters
from tallyloom.operators.distinct import ALPHABETICAL, PRESERVE, SIDE, UNORDERED, distinct_tokens, first_places, first_seen, number
from tallyloom.operators.tokens import counted_arrays, with_counts

DIFF, INTERSECT, UNION = "diff", "intersect", "union"


def set_op(left: DataFrame, right: DataFrame, op: str, filters: Filters = Filters(), ordering: str = PRESERVE) -> DataFrame:
    """(token). First-seen order is the left side's; a union appends the tokens that only the right side has."""
    if ordering != PRESERVE:
        sides = [distinct_tokens(c, filters, UNORDERED) for c in (left, right)]
        out = sides[0].unionByName(sides[1]).distinct() if op == UNION else sides[0].join(sides[1], "token", "left_anti" if op == DIFF else "left_semi")
        return out.orderBy("token") if ordering == ALPHABETICAL else out
    one = first_seen(left, filters)
    if op == UNION:
        behind = (F.col("first.row") + number(SIDE)).cast("decimal(38,0)")
        rows = [side.select("token", row.alias("row"), F.col("first.pos").alias("pos")) for side, row in ((one, F.col("first.row")), (first_seen(right, filters), behind))]
        return first_places(rows[0].unionByName(rows[1]), "token").orderBy("first").select("token")
    other = distinct_tokens(right, filters, UNORDERED)
    return one.join(other, "token", "left_anti" if op == DIFF else "left_semi").orderBy("first").select("token")


def set_stats(left: DataFrame, right: DataFrame, op: str, filters: Filters = Filters()) -> DataFrame:
    """One row (files, tokens_seen, unique_tokens, duplicates, filtered_by_length).

    duplicates are repeats within either side; for a union also tokens of the right side that the left one has. Each side is
    read once, and one shuffle by token carries tokens and counts.
    """
    sides = [with_counts(counted_arrays(c, filters), "file_idx").withColumn("side", F.lit(i)) for i, c in enumerate((left, right))]
    owner = F.when(F.col("token").isNull(), F.struct("side", "file_idx"))
    here = [F.max((F.col("side") == i).cast("int")).alias(n) for i, n in enumerate(("l", "r"))]
    rows = sides[0].unionByName(sides[1]).groupBy("token", owner.alias("own")).agg(*here, *[F.sum(c).alias(c) for c in ("seen", "kept", "filtered")])
    inside = {DIFF: "l = 1 AND r = 0", INTERSECT: "l = 1 AND r = 1", UNION: "true"}[op]
    held = F.lit(1) if op == UNION else F.col("l") + F.col("r")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = rows.agg(F.count("own").alias("files"), total("seen").alias("tokens_seen"), F.count(F.when(F.expr(f"token IS NOT NULL AND {inside}"), 1)).alias("unique_tokens"),
                    total("kept").alias("_kept"), total(F.when(F.col("token").isNotNull(), held)).alias("_held"), total("filtered").alias("filtered_by_length"))
    return sums.select("files", "tokens_seen", "unique_tokens", (F.col("_kept") - F.col("_held")).alias("duplicates"), "filtered_by_length")
