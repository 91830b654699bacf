"""Word lookup: is a word among the distinct tokens of a list? Words asked for are taken as they are, list tokens unfiltered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import Filters
from tallyloom.operators.distinct import UNORDERED, distinct_tokens

_AS_IS = Filters(trim=False, drop_empty=False)


class WordChecker:
    """Answers single lookups; the list's distinct tokens stay cached on the executors."""

    def __init__(self, corpus: DataFrame):
        self.words = distinct_tokens(corpus, _AS_IS, UNORDERED).cache()
        self.count = self.words.count()

    def __len__(self) -> int:
        return self.count

    def __contains__(self, word: str) -> bool:
        return not self.words.filter(F.col("token") == F.lit(word)).isEmpty()

    def is_empty(self) -> bool:
        return self.count == 0

    def close(self) -> None:
        self.words.unpersist()


def check_words(words: DataFrame, corpus: DataFrame, word_col: str = "word") -> DataFrame:
    """``words`` with a column ``found``: the lookup of many words at once."""
    listed = distinct_tokens(corpus, _AS_IS, UNORDERED).select(F.col("token").alias(word_col), F.lit(True).alias("found"))
    return words.join(listed, word_col, "left").withColumn("found", F.coalesce("found", F.lit(False)))
