"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest: one entry for each distinct text, with the id that stays, the size of
its group and the batch that brought it. A batch is reduced to its digests, held against the index by a sort-merge
anti-join, for which the index side is never shuffled, and what is new is appended. Each append leaves one more file in
each bucket. While a bucket is one file, which ``compact`` restores, Spark takes the index as sorted too if the session has
``spark.sql.legacy.bucketedTableScan.outputOrdering``; otherwise it sorts each bucket as it reads it.

A batch that is run again, after a failure or by mistake, decides as it did at first: a row keeps its place if it is the
row that the index says stays, and entries that the first run brought count as this batch's. Appending the same digests
twice is impossible by the anti-join; a run that dies before its append leaves the index as it was. One writer at a time:
two batches that append at the same moment could both bring a digest.

Defined cases: a null text counts as empty; empty texts equal one another; repeated rows of one id are one document
and share its decision, so do rows with a null id; null ids never win over other ids; an empty batch gives no rows and leaves the index as it
was; extra columns are not read. Texts are hashed whole, whatever their length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.ascii import ascii_lower
from tallyloom.functions.spill import join_counted, written

_ENTRIES = "digest binary, keep_id bigint, group_size bigint"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole text after lower-casing A-Z."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


class DigestIndex:
    """A bucketed, sorted table of the digests seen so far, each with the id that stays.

    A table that is there already is opened with its own number of buckets, whatever the session's settings; a new one takes
    ``buckets``, by default the session's shuffle partitions. Without ``table`` the index is for one run: ``drop`` removes it.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        if spark.catalog.tableExists(self.table):
            self.buckets = self._held_buckets()
            return
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._save(spark.createDataFrame([], _ENTRIES), self.table)

    def _held_buckets(self) -> int:
        found = [r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {self.table}").collect() if r["col_name"] == "Num Buckets"]
        if not found:
            raise ValueError(f"{self.table} is not a bucketed table")
        return int(found[0])

    def _save(self, entries: DataFrame, table: str) -> None:
        (entries.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table))

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame) -> None:
        """Append those of ``groups`` (digest, keep_id, group_size; a written table) that the index lacks, written first: the table is read and appended to."""
        self._save(written(self.missing(groups), "new-digests"), self.table)

    def missing(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks."""
        return groups.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")

    def compact(self) -> None:
        """Rewrite the index with one file a bucket, in a new table that then takes the old one's name."""
        fresh = f"{self.table}_{uuid.uuid4().hex}"
        self._save(written(self.entries(), "index-entries"), fresh)  # a scan of the buckets themselves would not be dealt anew
        self.spark.sql(f"DROP TABLE {self.table}")
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.table}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    With an ``index`` of earlier batches, a text found there is kept only in the row that the index names: keep_id is the earlier id.
    group_size is the size of the group in the batch that first brought the digest. Within a batch the largest id stays. Without
    ``index`` one is made for this run and dropped.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    batch = written(digests(docs, id_col, text_col), "digests")
    groups = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "batch-groups")  # else the anti-join moves below the aggregation, to all rows of a group
    index.add(groups)
    here = groups.select("digest", F.col("group_size").alias("here")).hint("merge")
    known = written(index.entries().join(here, "digest"), "known-digests")
    if own:
        index.drop()
    found = join_counted(batch, known, ["digest"], "here", batch.count())
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text stays under another id; columns as they were."""
    found = exact_duplicates(docs, index, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(F.col("_kept_id")), "left_semi")
