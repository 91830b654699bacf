"""Corpus pipeline: STAGES run one after another, each on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.spill import written
from tallyloom.llm.exact_dedup import drop_exact_duplicates
from tallyloom.llm.mixing import mix_documents
from tallyloom.llm.near_dedup import drop_near_duplicates
from tallyloom.llm.pieces import encoded
from tallyloom.llm.queries import LEVELS, SEED, WEIGHTS
from tallyloom.llm.toxicity import drop_toxic
from tallyloom.llm.training import fold

#: Documents that score this or more for toxicity go.
TOXIC = 0.3
#: The share of the tokens that reach the mix which it draws, without repeats.
SHARE = (4, 5)
#: Segmentations of each text.
NBEST = 4


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression distance finds toxic; labels with fold 2 of 4 never train."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, labels, fold(F.col("_id"), 4) != 2, threshold=TOXIC)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest id of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws sources to the target weights."""
    return mix_documents(docs, {name: F.expr(e) for name, e in LEVELS.items()}, WEIGHTS, SHARE, 1, SEED)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left and decodes it again: doc_id, lang, source, ids, nbest (by A-star), text_sha256, round_trip."""
    return encoded(docs, ["doc_id", "lang", "source"], NBEST)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("pieces", encoding)]

#: Compression lengths, sketches and segmentations have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
