"""A table's text column as a corpus of lines.

A corpus is a DataFrame (file_idx, part, line_no, line): rows in the order of the first three are its lines in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import lines_of

ORDER = ["file_idx", "part", "line_no"]


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its scan has fewer partitions than there are cores, as one row group of a small table has.

    Such an input is at most a partition for each core, so what is shuffled is small; larger inputs stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table_corpus(df: DataFrame, text_col: str = "text", order_col: str | Column | None = None, file_idx: int | Column = 0) -> DataFrame:
    """Each text is cut into lines; ``order_col`` (a whole number) orders the rows of a file. Null texts have no lines."""
    part = F.lit(0) if order_col is None else F.col(order_col) if isinstance(order_col, str) else order_col
    file = file_idx if isinstance(file_idx, Column) else F.lit(file_idx)
    rows = df.select(file.cast("bigint").alias("file_idx"), part.cast("bigint").alias("part"), F.posexplode(lines_of(F.col(text_col))).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no").cast("bigint"))


def document_corpus(df: DataFrame, text_col: str = "text", order_col: str | Column | None = None, file_idx: int | Column = 0) -> DataFrame:
    """Like ``table_corpus`` with one row for each text, whole in ``text``: nothing is multiplied, and most texts are split in one go."""
    part = F.lit(0) if order_col is None else F.col(order_col) if isinstance(order_col, str) else order_col
    file = file_idx if isinstance(file_idx, Column) else F.lit(file_idx)
    return df.select(file.cast("bigint").alias("file_idx"), part.cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("line_no"), F.col(text_col).alias("text"))
