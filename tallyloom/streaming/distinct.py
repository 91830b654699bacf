"""Tokens of a stream: exact first occurrences, and frequencies that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import Filters, kept_tokens, lines_of


def stream_tokens(texts: DataFrame, text_col: str = "text", filters: Filters = Filters(), keep: list[str] = ()) -> DataFrame:
    """(token, kept columns...) of a streaming or plain DataFrame of texts."""
    tokens = F.flatten(F.transform(lines_of(F.col(text_col)), lambda line: kept_tokens(line, filters)))
    return texts.select(*keep, F.explode(tokens).alias("token"))


def stream_distinct(texts: DataFrame, text_col: str = "text", filters: Filters = Filters(), time_col: str | None = None, delay: str | None = None) -> DataFrame:
    """Each token once. With an event time and a delay, state older than the watermark goes, and a token may come again after it."""
    if time_col and delay:
        return stream_tokens(texts.withWatermark(time_col, delay), text_col, filters, [time_col]).dropDuplicatesWithinWatermark(["token"]).select("token")
    return stream_tokens(texts, text_col, filters).dropDuplicates(["token"])


def stream_frequency(texts: DataFrame, text_col: str = "text", filters: Filters = Filters()) -> DataFrame:
    """(token, count), for output modes complete and update."""
    return stream_tokens(texts, text_col, filters).groupBy("token").agg(F.count(F.lit(1)).alias("count"))
