"""Files as a corpus of lines: text files through Spark's reader, EPUB and PDF through extractors on the executors.

Files form one stream in the order of the list; a path listed twice is read twice. Lines end at line feeds only, broken
UTF-8 becomes U+FFFD, and a byte order mark at the beginning of a file goes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.spill import written
from tallyloom.functions.tokens import Filters, lines_of
from tallyloom.plans.config import ConfigError, Sample
from tallyloom.sources.epub import epub_text
from tallyloom.sources.pdf import pdf_text

#: Extensions that a folder is searched for.
EXTENSIONS = ("txt", "csv", "tsv", "log", "pdf", "epub")
_EXTRACTORS = {"pdf": pdf_text, "epub": epub_text}
_CORPUS = "file_idx bigint, part bigint, line_no bigint, line string"


def extension(path: str) -> str:
    return os.path.splitext(path)[1][1:].lower()


def is_rich(path: str) -> bool:
    return extension(path) in _EXTRACTORS


def expand_path(path: str) -> list[str]:
    """A file is itself; a folder is all files under it with a known extension, in the order of path components.

    Links inside a folder are not followed. A folder without such files is an error.
    """
    if not os.path.isdir(path):
        return [path]
    found = []
    for top, _, names in os.walk(path):
        found += [p for n in names if extension(p := os.path.join(top, n)) in EXTENSIONS and not os.path.islink(p) and os.path.isfile(p)]
    if not found:
        raise ConfigError("NoCompatibleFiles", f"no compatible files in {path}")
    return sorted(found, key=lambda p: Path(p).parts)


def expand_paths(paths: list[str]) -> list[str]:
    return [p for path in paths for p in expand_path(path)]


def as_uri(path: str) -> str:
    return path if "://" in path else Path(os.path.abspath(path)).as_uri()


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), os.path.abspath(path)) if "://" not in path else fs.FileSystem.from_uri(path)


def _read_bytes(path: str) -> bytes:
    store, name = _file_system(path)
    with store.open_input_stream(name) as f:
        return f.read()


@dataclass
class Corpus:
    """The lines of files, and the rich files that could not be read, as (path, message)."""

    lines: DataFrame
    paths: list[str]
    failures: list[tuple[str, str]]


def _glob_free(path: str) -> str:
    """The path with the characters that would be patterns taken literally."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def _spark_lines(spark: SparkSession, named: list[tuple[int, str]]) -> DataFrame:
    """All plain files in one scan. A block of a file has ascending ids, and blocks are ordered by where they start."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def canonical(path: str) -> str:
        held = jvm.org.apache.hadoop.fs.Path(path if "://" in path else os.path.abspath(path))
        return held.getFileSystem(conf).makeQualified(held).toUri().toString()

    uris = {p: canonical(p) for _, p in named}
    manifest = spark.createDataFrame([(i, uris[p].replace("file:///", "file:/")) for i, p in named], "file_idx bigint, uri string")
    rows = spark.read.text([_glob_free(p if "://" in p else os.path.abspath(p)) for p in uris], lineSep="\n").select(
        F.regexp_replace("_metadata.file_path", "^file:///", "file:/").alias("uri"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("line_no"), F.make_valid_utf8("value").alias("line"))
    return rows.join(F.broadcast(manifest), "uri").select("file_idx", "part", "line_no", "line")  # the driver's own list


def _python_lines(spark: SparkSession, named: list[tuple[int, str]]) -> DataFrame:
    """Files that Spark's reader passes over because of their names, read on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for idx, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, name = _file_system(path)
                with store.open_input_stream(name) as f:
                    at, rest, first = 0, b"", True
                    while block := f.read(1 << 20):
                        *lines, rest = (rest + block).split(b"\n")
                        if lines:
                            yield _batch(idx, at, lines, first)
                            at, first = at + len(lines), False
                    if rest:
                        yield _batch(idx, at, [rest], first)

    def _batch(idx: int, at: int, lines: list[bytes], first: bool) -> pa.RecordBatch:
        if first and lines[0].startswith(b"\xef\xbb\xbf"):
            lines[0] = lines[0][3:]
        n = len(lines)
        cols = [pa.array([idx] * n, pa.int64()), pa.array([0] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines])]
        return pa.RecordBatch.from_arrays(cols, names=["file_idx", "part", "line_no", "line"])

    return spark.createDataFrame(named, "file_idx bigint, path string").repartition(max(1, len(named))).mapInArrow(run, _CORPUS)


def extract(spark: SparkSession, named: list[tuple[int, str]]) -> DataFrame:
    """(file_idx, path, text, error) of rich files, each extracted once; one of text and error is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for idx, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = error = None
                try:
                    text = _EXTRACTORS[extension(path)](_read_bytes(path))
                except (ValueError, OSError) as e:
                    error = str(e) or repr(e)
                cols = [pa.array([idx], pa.int64()), pa.array([path]), pa.array([text], pa.string()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["file_idx", "path", "text", "error"])

    rows = spark.createDataFrame(named, "file_idx bigint, path string").repartition(max(1, len(named)), "file_idx")
    return written(rows.mapInArrow(run, "file_idx bigint, path string, text string, error string"), "extracted")


def file_corpus(spark: SparkSession, paths: list[str], extract_rich: bool = True) -> Corpus:
    """The files' lines in list order. Without ``extract_rich`` EPUB and PDF files are read as text, byte by byte."""
    named = list(enumerate(paths))
    rich = [x for x in named if extract_rich and is_rich(x[1])]
    plain = [x for x in named if x not in rich]
    passed_over = [x for x in plain if os.path.basename(x[1].rstrip("/"))[:1] in ("_", ".")]
    plain = [x for x in plain if x not in passed_over]
    parts, failures = [spark.createDataFrame([], _CORPUS)], []
    if plain:
        parts.append(_spark_lines(spark, plain))
    if passed_over:
        parts.append(_python_lines(spark, passed_over))
    if rich:
        found = extract(spark, rich)
        failures = [(r["path"], r["error"]) for r in found.filter("error IS NOT NULL").orderBy("file_idx").select("path", "error").collect()]
        parts.append(found.filter("error IS NULL").select("file_idx", F.lit(0).cast("bigint").alias("part"), F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
                     .withColumn("line_no", F.col("line_no").cast("bigint")))
    lines = parts[-1]
    for more in parts[:-1] if len(parts) > 2 else []:
        lines = lines.unionByName(more)
    return Corpus(lines, paths, failures)


#: How much of the input a sample may read.
_SAMPLE_FILES, _SAMPLE_BYTES, _SAMPLE_TOTAL = 4, 256 << 10, 1 << 20


def sample_files(spark: SparkSession, paths: list[str], filters: Filters) -> Sample:
    """Token figures of the heads of the first files: at most 4 files, 256 KiB of each and 1 MiB in all."""
    from tallyloom.operators.tokens import token_arrays  # the operators read corpora

    rows, total = [], 0
    for i, path in enumerate(paths[:_SAMPLE_FILES]):
        store, name = _file_system(path)
        with store.open_input_stream(name) as f:
            head = f.read(min(_SAMPLE_BYTES, _SAMPLE_TOTAL - total))
        total += len(head)
        rows.append((i, 0, 0, head.decode("utf-8", "replace").removeprefix("\ufeff")))
    if not rows:
        return Sample()
    df = spark.createDataFrame(rows, "file_idx bigint, part bigint, line_no bigint, text string")
    found = token_arrays(df, filters).select(F.explode("tokens").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("u"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).collect()[0]
    n, u = found["n"], found["u"]
    return Sample(n, u, n - u, found["b"] / n if n else 0.0, n / total if total else 0.0, total)


def input_bytes(paths: list[str]) -> int:
    """Bytes of the files that are there."""
    size = 0
    for p in paths:
        store, name = _file_system(p)
        size += store.get_file_info(name).size or 0
    return size
