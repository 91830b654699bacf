"""Tables that an operator writes on the way: lineage ends there, so a lost executor costs a re-read only.

They lie under ``spark.checkpoint.dir``, the folder that all machines of a cluster share; a path without a scheme is one of
Hadoop's default file system, as for Spark itself. Only where that setting is absent and the master is local (tests, a
laptop) is a folder of this process taken instead; on a cluster its absence is an error. The tables of a process are deleted
when it ends, unless ``forget`` has done so before.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_RUN = uuid.uuid4().hex  # one folder for all tables of a process
_used: set[str] = set()


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, on the default file system if it names none."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(held).toUri().toString()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI, without a closing slash."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            found = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
            atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
            spark.conf.set(_SETTING, found)
        else:
            raise ValueError(f"{_SETTING} has to name a folder that all machines share")
    found = _qualified(spark, found)
    return (found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file:///") else found).rstrip("/")


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tallyloom/{_RUN}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one table of one call."""
    base = _run_dir(spark)
    if base not in _used:
        _used.add(base)
        _delete_at_exit(spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """The gateway still answers then, on whatever file system the folder is; after a kill the folder stays."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def delete() -> None:
        with contextlib.suppress(Py4JError, OSError):  # the JVM has gone first
            store.delete(target, True)

    atexit.register(delete)


def forget(spark: SparkSession) -> None:
    """Delete all tables that this process has written so far; results that have not been computed yet can't be any more."""
    remove(spark, _run_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: computed once, lineage cut."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_side(df: DataFrame, at_most: int = 20_000) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted at ``at_most`` rows or fewer, else ``df`` for a shuffled join.

    ``df`` should be a written table, as counting runs it.
    """
    return F.broadcast(df) if df.limit(at_most + 1).count() <= at_most else df


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], counted: str, total: int, parts: int = 200) -> DataFrame:
    """Left join of ``left`` to ``right``, unique on ``keys``, where ``counted`` says how many of ``left``'s ``total`` rows each key has.

    Keys with over 1/``parts`` of the rows are fewer than ``parts``, whatever the size of the data, so these and
    only these are broadcast; the others are spread evenly by a shuffled join. Both sides should be written tables.
    Null keys match nothing.
    """
    added = [c for c in right.columns if c not in keys]
    heavy = F.col(counted) * F.lit(parts) > F.lit(total)
    hot = right.filter(heavy).withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(hot), keys, "left")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot", *added).join(right.filter(~heavy).hint("merge"), keys, "left")
    return marked.filter(F.col("_hot").isNotNull()).drop("_hot").unionByName(rest)
