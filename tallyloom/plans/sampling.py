"""The sample of a workload that the choice of a mode looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import Filters
from tallyloom.operators.tokens import token_arrays


def workload(corpus: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """One row (sample_tokens, sample_unique, sample_duplicates, avg_bytes, duplicate_ratio, unique_ratio) of the tokens kept."""
    rows = token_arrays(corpus, filters).select(F.explode("tokens").alias("token"))
    counted = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sample_tokens"), F.count(F.lit(1)).alias("sample_unique"),
                       F.coalesce(F.sum(F.col("n") * F.octet_length("token")), F.lit(0)).alias("_bytes"))
    share = lambda x: F.when(F.col("sample_tokens") > 0, x / F.col("sample_tokens")).otherwise(F.lit(0.0))
    return sums.select("sample_tokens", "sample_unique", (F.col("sample_tokens") - F.col("sample_unique")).alias("sample_duplicates"),
                       share(F.col("_bytes")).alias("avg_bytes"), share(F.col("sample_tokens") - F.col("sample_unique")).alias("duplicate_ratio"), share(F.col("sample_unique")).alias("unique_ratio"))
