"""Toxicity by compression distance.

Two zstandard dictionaries of equal size are trained apart, one on ordinary and one on toxic text. A text is cut into windows
of words; each is compressed under either dictionary, and the bytes that the toxic one saves over the ordinary one are the
window's gain. A logistic calibration, fitted on documents that trained no dictionary, turns the spread of a document's
gains around their median into a score.

Most windows of a toxic text are ordinary, so the dictionaries are trained in rounds. Each class is halved; a pair of
dictionaries trained on one half's windows is held against the other half's, and of both classes alike the same number
of windows with the highest gains trains the next pair: toxic windows that look toxic, and ordinary windows that
look toxic too, so that what both have in common is found in both dictionaries. The last pair is trained on the windows that
the last two rounds kept. No word is picked or left out by any other rule.

Whole texts are read, marks and digits too; only A-Z are lower-cased. Windows are compressed at zstandard's highest
strategies, which parse optimally: faster ones miss most of the difference in texts this short.

Defined cases: null and empty texts have no window and get the score of a document without gains; words of any length are cut into
windows of ``LONGEST`` bytes; ties in gains go by the window's place in the sample; without labels of both classes, or with too
little text for zstandard to train on, every score is the share of toxic labels (0 without any); repeated rows get equal scores; an
empty table gives no rows; extra columns are not read. Training reads at most ``per_class`` documents a class and ``max_bytes`` of text,
chosen by a hash of their ids, whatever the order in which rows arrive.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.workers import tidy
from tallyloom.llm.training import fold, labelled_sample, logistic, sigmoid

_TEXTS = 2000  # texts that are scored together
WINDOW, TRAINED_WINDOW = 6, 4  # words of a window that is compared, and of one that trains
LONGEST = 512
LEAST = 1000  # windows that a round hands on, if there are so many
_LOWER = bytes(range(9)) + b" " * 5 + bytes(range(14, 65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # and white space as spaces


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    prior: float


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The text's words, ``size`` at a time, between spaces."""
    line = b" " + (text or "").encode("utf-8", "replace").translate(_LOWER) + b" "
    if b"  " in line:
        line = b" " + b" ".join(line.split()) + b" "
    first = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)[:-1:size].tolist() if len(line) > 2 else []
    made = [line[i : j + 1] for i, j in zip(first, [*first[1:], len(line) - 1])]
    if len(line) > LONGEST and max(map(len, made)) > LONGEST:
        made = [x[i : i + LONGEST] for x in made for i in range(0, len(x), LONGEST)]
    return made


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """A compressor of short windows under a trained dictionary; what it writes has no size, checksum or dictionary id."""
    log = max(17, (len(dictionary) - 1).bit_length() + 1)
    params = zstandard.ZstdCompressionParameters(window_log=log, chain_log=log, hash_log=log, search_log=4, min_match=4, target_length=16,
                                                 strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=held)


class Distance:
    """Gains of windows: bytes under the ordinary dictionary less bytes under the toxic one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = compressor(ordinary), compressor(toxic)

    def gains(self, parts: list[bytes]) -> np.ndarray:
        """Equal windows are compressed once; one dictionary after the other, so that its tables stay in the processor's cache."""
        distinct = list(dict.fromkeys(parts))
        ordinary, toxic = (np.fromiter(map(len, map(c.compress, distinct)), dtype=np.int64, count=len(distinct)) for c in self.pair)
        found = dict(zip(distinct, (ordinary - toxic).tolist(), strict=True))
        return np.fromiter(map(found.__getitem__, parts), dtype=np.int64, count=len(parts))

    def many_gains(self, parts: list[bytes], threads: int) -> np.ndarray:
        """The same on threads of zstandard's own, for training."""
        if not parts:
            return np.zeros(0, dtype=np.int64)
        sizes = [np.array([len(x) for x in c.multi_compress_to_buffer(parts, threads=threads)], dtype=np.int64) for c in self.pair]
        return sizes[0] - sizes[1]

    def features(self, texts: list[str | None]) -> np.ndarray:
        parts = [windows(t) for t in texts]
        return spreads(self.gains(list(chain.from_iterable(parts))), np.array([len(p) for p in parts], dtype=np.int64))


def spread_of(gains: np.ndarray) -> np.ndarray:
    return spreads(gains, np.array([len(gains)]))[0]


def spreads(gains: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row for each text, whose gains stand one after another, ``counts`` of each.

    The mean and the median; how far the highest gains, and how many and which share of all, lie above the median; the number; how
    far the sum lies from nothing, measured by the root of the number, for texts whose windows are all alike."""
    out = np.zeros((len(counts), 10))
    n = counts[counts > 0]
    if not len(n):
        return out
    gains = np.clip(gains, -32, 32)
    of, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    ranked = np.sort(of * 128 + gains + 64) % 128 - 64.0  # by text, then by gain

    def quantile(q: float) -> np.ndarray:  # as numpy's
        low = np.floor((n - 1) * q).astype(np.int64)
        by = (n - 1) * q - low
        a, b = ranked[first + low], ranked[first + np.minimum(low + 1, n - 1)]
        return np.where(by >= 0.5, b - (b - a) * (1 - by), a + (b - a) * by)

    mean = np.add.reduceat(gains, first) / n
    middle = (ranked[first + (n - 1) // 2] + ranked[first + n // 2]) / 2
    top = np.minimum(n, 3)
    highest = sum(np.where(k < top, ranked[first + np.maximum(n - 1 - k, 0)], 0) for k in range(3)) / top
    four, six = (np.add.reduceat((gains - middle[of] >= t).astype(np.int64), first) for t in (4, 6))
    columns = [mean, middle, quantile(0.9) - middle, quantile(0.75) - middle, highest - middle, np.log1p(four), np.log1p(six), np.sqrt(four / n), np.log1p(n),
               np.clip(mean * np.sqrt(n), -100, 100) / 4]
    out[counts > 0] = np.stack(columns, axis=1)
    return out


def _trained(parts: list[bytes], size: int) -> bytes:
    """A dictionary of ``size`` bytes, or of 3/5 of the text it is trained on if that is less.

    zstandard goes over its samples in stretches and takes the best of each, so they come in a seeded order.
    """
    size = min(size, sum(map(len, parts)) * 3 // 5)
    order = np.random.default_rng(1).permutation(len(parts))
    return zstandard.train_dictionary(size, [parts[i] for i in order], k=24, d=6).as_bytes()


def dictionaries(ordinary: list[str], toxic: list[str], size: int, keep: float, rounds: int) -> tuple[bytes, bytes]:
    """The two dictionaries; ``keep`` is the share of toxic windows that a round hands on (``LEAST`` at least), and of ordinary ones the same number."""
    halves = [[[x for t in texts[i::2] for x in windows(t, TRAINED_WINDOW)] for i in (0, 1)] for texts in (ordinary, toxic)]
    now = before = [h[0] for h in halves]
    for k in range(rounds):
        by = Distance(*(_trained(x, size) for x in now))
        other = [h[(k + 1) % 2] for h in halves]
        many = max(LEAST, int(len(other[1]) * keep))
        before, now = now, []
        for parts in other:
            gains = by.many_gains(parts, os.cpu_count() or 1)
            now.append([parts[i] for i in np.argsort(-gains, kind="stable")[:many]])
    ordinary_dictionary, toxic_dictionary = (_trained(a + b, size) for a, b in zip(now, before, strict=True))
    return ordinary_dictionary, toxic_dictionary


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", per_class: int = 3000, max_bytes: int = 40_000_000,
          id_col: str = "doc_id", text_col: str = "text", size: int = 262_144, keep: float = 0.2, rounds: int = 2) -> Model:
    """Dictionaries of ``size`` bytes from two thirds of the sample, calibration from the rest. ``usable`` may refer to the id as ``_id``."""
    texts, y, weights = labelled_sample(docs, labels, label_col, usable, per_class, max_bytes, id_col, text_col)
    prior = float((weights * y).sum() / weights.sum()) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", np.zeros(0), prior)
    third = np.zeros(len(y), dtype=bool)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        third[own[2::3]] = True
    fit = [[t for t, c, o in zip(texts, y, third, strict=True) if c == k and not o] for k in (0, 1)]
    try:
        ordinary, toxic = dictionaries(*fit, size, keep, rounds)
    except zstandard.ZstdError:  # too little text to train on
        return Model(b"", b"", np.zeros(0), prior)
    by = Distance(ordinary, toxic)
    rest = np.flatnonzero(third) if third.any() and len(set(y[third].tolist())) == 2 else np.arange(len(y))
    x = by.features([texts[i] for i in rest])
    return Model(ordinary, toxic, logistic(x, y[rest], weights[rest]), prior)


def score_texts(texts: list[str | None], model: Model, by: Distance | None = None) -> np.ndarray:
    """Scores in the order of the texts; equal texts and equal windows are compressed once."""
    if not len(model.weights):
        return np.full(len(texts), model.prior)
    by = by or Distance(model.ordinary, model.toxic)
    at = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    x = by.features(list(at))[[at[t] for t in texts]]
    return sigmoid(x @ model.weights[:-1] + model.weights[-1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row. The model is two dictionaries of a fixed size, whatever the corpus."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Distance(held.value.ordinary, held.value.toxic) if len(held.value.weights) else None
        for b in (b.slice(at, _TEXTS) for b in batches for at in range(0, b.num_rows, _TEXTS)):
            found = score_texts(b.column(1).to_pylist(), held.value, by)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = 0.3, **training) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows whose fold is ``held`` never train."""
    model = train(docs, labels, fold(F.col("_id"), parts) != held, **training)
    found = score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; columns as they were. One pass, nothing is shuffled."""
    model = train(docs, labels, usable, id_col=id_col, text_col=text_col, **training)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Distance(held.value.ordinary, held.value.toxic) if len(held.value.weights) else None
        for b in (b.slice(i, _TEXTS) for b in batches for i in range(0, b.num_rows, _TEXTS)):
            found = score_texts(b.column(at).to_pylist(), held.value, by)
            yield b.filter(pa.array(found < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
