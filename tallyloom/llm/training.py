"""Bounded samples of labelled documents for models that are fitted on the driver, and ways to fit them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.spill import written


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, per_class: int, max_bytes: int,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts, labels, weights): at most ``per_class`` documents of each class in the order of a hash of their ids, and of these, in
    the same order, those that fit into ``max_bytes`` of UTF-8 in all. Weights restore the shares that the classes have among all usable labels.

    Rows with a null id, a null text or a label other than 0 and 1 are not used; of repeated ids the smallest text and the
    largest label are. So the sample depends on what the tables hold, not on the order in which rows arrive.
    """
    known = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    known = known.filter(usable).groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    drawn = None
    for y in (0, 1):
        part = known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    picked = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("_text IS NOT NULL")
    picked = picked.join(F.broadcast(drawn), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))  # at most 2 * per_class ids
    picked = written(picked, "labelled-sample")
    labels_of, size = {}, 0
    for row in picked.select("_id", "_y", F.octet_length("_text").alias("n")).orderBy(F.xxhash64("_id"), "_id").collect():
        if size + row["n"] <= max_bytes:
            labels_of[row["_id"]] = row["_y"]
            size += row["n"]
    texts = {r["_id"]: r["_text"] for r in picked.toLocalIterator() if r["_id"] in labels_of}
    order = sorted(texts)
    y = np.array([labels_of[i] for i in order], dtype=np.int64)
    have = np.bincount(y, minlength=2)
    share = np.array([counts.get(c, 0) / max(1, have[c]) for c in (0, 1)])
    weights = share[y] / share[y].mean() if len(y) else np.zeros(0)
    return [texts[i] for i in order], y, weights


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the bias, which isn't penalised."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weights * (p - y)) + penalty * w
        hess = (a * (weights * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
