"""Quality by naive Bayes support vectors.

A text's features are indicators of its n-grams: of bytes, and of word shapes, where a word equal to one of the few
before it has a shape of its own. Each indicator is scaled by the log ratio of its smoothed shares in the two classes,
and a linear machine with hinge loss is fitted to the scaled indicators by dual coordinate descent. A logistic fit on
documents that trained nothing turns margins into scores.

Defined cases: null and empty texts have no n-gram and get the score of the bias alone; texts are read whole; without
labels of both classes every score is the share of label 1 (0 without any); repeated rows get equal scores; an empty
table gives no rows; extra columns are not read. Training reads at most ``per_class`` documents a class and ``max_bytes`` of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.training import fold, labelled_sample, logistic, sigmoid

BITS = 18
_BACK = 3  # words to look back for an equal one
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    weights: np.ndarray  # by n-gram, scaled by the log-count ratio
    bias: float
    slope: float
    shift: float
    prior: float
    fitted: bool


def _slots(keys: np.ndarray, salt: int) -> np.ndarray:
    return (((keys + np.uint64(salt << 40)) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def ngrams(text: str | None) -> np.ndarray:
    """The distinct slots of a text's n-grams, ascending."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    seen = np.zeros(1 << BITS, dtype=bool)
    if len(raw) >= 3:
        a = raw.astype(np.uint64)
        seen[_slots(a[:-2] << np.uint64(16) | a[1:-1] << np.uint64(8) | a[2:], 1)] = True
    if len(raw):
        shapes = _shapes(raw)
        pad = np.concatenate([np.array([31], dtype=np.uint64), shapes, np.array([31], dtype=np.uint64)])
        seen[_slots(pad[:-1] << np.uint64(8) | pad[1:], 2)] = True
        seen[_slots(pad[:-2] << np.uint64(16) | pad[1:-1] << np.uint64(8) | pad[2:], 3)] = True
    return np.flatnonzero(seen)


def _shapes(raw: np.ndarray) -> np.ndarray:
    """Of each run of non-spaces: bits for upper case start, all upper case, marks inside or behind, equal to a word before."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    upper = (raw >= 65) & (raw <= 90)
    letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    many = np.concatenate([[0], np.cumsum(upper)]), np.concatenate([[0], np.cumsum(letter)])
    uppers, letters = (m[end] - m[start] for m in many)
    size = end - start
    weight = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64))
    powered = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(7)) * weight[np.minimum(_within(start, end, len(raw)), 63)])])
    key = powered[end] - powered[start]
    same = np.zeros(len(start), dtype=bool)
    for back in range(1, _BACK + 1):
        same[back:] |= key[back:] == key[:-back]
    shape = upper[start].astype(np.uint64) | (((uppers == letters) & (letters > 1)).astype(np.uint64) << np.uint64(1)) | (np.minimum(size - letters, 3).astype(np.uint64) << np.uint64(2)) | (same.astype(np.uint64) << np.uint64(4))
    return shape


def _within(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """The place of each byte in its word."""
    at = np.zeros(n, dtype=np.int64)
    at[start] = start
    return np.arange(n) - np.maximum.accumulate(at)


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 25, seed: int = 5) -> tuple[np.ndarray, float]:
    """Hinge-loss machine over indicator rows times ``scale``, with a bias; one dual variable at a time, in seeded order."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([(scale[r] ** 2).sum() + 1.0 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            grad = y[i] * ((w[r] * scale[r]).sum() + bias) - 1
            new = min(max(alpha[i] - grad / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * scale[r]
                bias += step
                largest = max(largest, abs(new - alpha[i]) * norm[i])
                alpha[i] = new
        if largest < 1e-3:
            break
    return w * scale, bias


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", per_class: int = 3000, max_bytes: int = 40_000_000,
          cost: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Log-count ratios and machine from three quarters of the sample, calibration from the rest."""
    texts, y, weights = labelled_sample(docs, labels, label_col, usable, per_class, max_bytes, id_col, text_col)
    prior = float((weights * y).sum() / weights.sum()) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, dtype=np.float32), 0.0, 0.0, 0.0, prior, False)
    rows = [ngrams(t) for t in texts]
    held = np.zeros(len(y), dtype=bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[3::4]] = True
    fit = np.flatnonzero(~held)
    counts = np.ones((2, 1 << BITS))
    for i in fit:
        counts[y[i], rows[i]] += 1
    totals = np.bincount(y[fit], minlength=2) + 2
    ratio = np.log(counts[1] / totals[1]) - np.log(counts[0] / totals[0])
    ratio[counts.sum(0) < 5] = 0  # n-grams of fewer than three documents say nothing
    w, bias = dual_descent([rows[i] for i in fit], ratio, 2 * y[fit] - 1, cost * weights[fit])
    rest = np.flatnonzero(held) if len(set(y[held].tolist())) == 2 else fit
    margin = np.array([w[rows[i]].sum() + bias for i in rest])
    slope, shift = logistic(margin[:, None], y[rest], weights[rest], ridge=0.01)
    return Model(w.astype(np.float32), float(bias), float(slope), float(shift), prior, True)


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    if not model.fitted:
        return np.full(len(texts), model.prior)
    margin = np.array([model.weights[ngrams(t)].sum(dtype=np.float64) + model.bias for t in texts])
    return sigmoid(margin * model.slope + model.shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row. The weights are 2^18 floats, whatever the corpus."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = score_texts(b.column(1).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, threshold: float = 0.3, **training) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows whose fold is ``held`` never train."""
    model = train(docs, labels, fold(F.col("_id"), parts) != held, **training)
    found = score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
