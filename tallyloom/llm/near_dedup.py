"""Near duplicates by HyperMinHash over word shingles.

A document's set of five-word shingles is hashed to 64 bits. The first eight bits of a hash choose one of 256 buckets; of
the rest a bucket keeps the smallest, as a register of 6 bits for its leading zeros and 10 bits of mantissa. Empty buckets
borrow from full ones in an order fixed for all documents, so small sets fill their sketches too. Bands of four
registers are keys; 40 bands find a pair at the threshold of 0.75 with probability 1 - 3e-7. Of a pair of candidates the
Jaccard similarity is first estimated from the registers, corrected for chance collisions; where the estimate isn't six
standard deviations below the threshold, the full sets decide, and so they do wherever a set is too small to fill the buckets.

Copies are one class from the start: sets of equal digest share a representative, and only it goes on. Members of a
bucket are never paired with one another as rows. First a bucket's most central member (that with most company in all its
buckets) is held against the others, links are joined to components, and pairs within a component need no test any more.
Then, in buckets that are still of several components, all that is outside the largest one is held against the whole bucket,
block by block of about ``BLOCK`` sets: a pair is tested in the first band that it shares, and no more once its components
have met in the block. So no link between different components is lost, no task gets a whole bucket, and what leaves a
block are links that join components, not pairs.

Defined cases: null and empty texts, or texts without words, have no shingles, are linked with nothing and are kept;
fewer than five words are one shingle; texts are read whole; rows of one id are one document; rows with a null id keep a null
component with their copies; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.spill import join_counted, written
from tallyloom.functions.workers import tidy
from tallyloom.operators.components import connected_components

WORDS = 5
PERCENT = 75
BUCKET_BITS, MANTISSA_BITS = 8, 10
REGISTERS = 1 << BUCKET_BITS
BAND_ROWS, BANDS = 4, 40
BLOCK = 256
_PIECE = 1 << 18  # bytes of text hashed at once

_U = np.uint64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _BASE_INVERSE = _U(0x9E3779B97F4A7C1B), _U(pow(0x9E3779B97F4A7C1B, -1, 1 << 64))
_PLACE = _rng.integers(1, 2**63, WORDS + 1, dtype=np.uint64) * _U(2) + _U(1)
_BORROW = _rng.integers(0, REGISTERS, (REGISTERS, 512))
_BAND = _rng.integers(1, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) * _U(2) + _U(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class _Powers:
    """Powers of the base and of its inverse, as many as have been needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _PIECE + 1024)
            self.up = np.concatenate([[_U(1)], np.cumprod(np.full(size, _BASE, dtype=np.uint64))])
            self.down = np.concatenate([[_U(1)], np.cumprod(np.full(size, _BASE_INVERSE, dtype=np.uint64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of lower-cased text."""
    a = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS.upto(len(a) + 1)
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * down[start]), start


def _cut(raw: bytes) -> Iterator[bytes]:
    """Pieces of about ``_PIECE`` bytes that end between words."""
    at = 0
    while len(raw) - at > _PIECE:
        end = at + _PIECE
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes of a sequence of word hashes, ascending."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        return _mixed((words * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _PLACE[WORDS:] * np.array([n], dtype=np.uint64))
    h = words[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        h = h + words[k : n - WORDS + 1 + k] * _PLACE[k]
    h = np.sort(_mixed(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The set of each text, as ascending distinct hashes. Texts are hashed some at a time."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "replace").translate(_LOWER)
        if len(raw) > _PIECE:
            yield from _together(held)
            held, size = [], 0
            yield _shingles(np.concatenate([_word_hashes(p)[0] for p in _cut(raw)]))
            continue
        if size + len(raw) > _PIECE:
            yield from _together(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    yield from _together(held)


def _together(raws: list[bytes]) -> Iterator[np.ndarray]:
    if raws:
        hashes, start = _word_hashes(b" ".join(raws))
        ends = np.cumsum([len(r) + 1 for r in raws])
        for words in np.split(hashes, np.searchsorted(start, ends[:-1])):
            yield _shingles(words)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The 256 registers of a set that is not empty."""
    bucket = (shingles >> _U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = (shingles[first] << _U(BUCKET_BITS)) | _U((1 << BUCKET_BITS) - 1)
    zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 63)
    zeros += (rest << zeros.astype(np.uint64)) >> _U(63) == 0  # rounding up in the logarithm
    mantissa = ((rest << zeros.astype(np.uint64)) << _U(1)) >> _U(64 - MANTISSA_BITS)
    registers = np.zeros(REGISTERS, dtype=np.uint16)
    full = np.zeros(REGISTERS, dtype=bool)
    full[bucket[first]] = True
    registers[bucket[first]] = (zeros.astype(np.uint16) << MANTISSA_BITS) | mantissa.astype(np.uint16)
    empty = np.flatnonzero(~full)
    step = 0
    while len(empty):
        source = _BORROW[empty, step] if step < _BORROW.shape[1] else np.full(len(empty), bucket[0])
        hit = full[source]
        registers[empty[hit]] = registers[source[hit]]
        empty = empty[~hit]
        step += 1
    return registers


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys from (n, 256) registers."""
    used = sketches[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    return _mixed(((used + _U(1)) * _BAND[None]).sum(axis=2, dtype=np.uint64)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """Jaccard similarity from two sketches, corrected for registers that are equal by chance."""
    large, small = max(na, nb) / REGISTERS, min(na, nb) / REGISTERS
    phi = 4 * large / (1 + large) ** 2 * (small / large if large else 1)
    chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * phi
    return max(0.0, (float((a == b).sum()) - chance) / (REGISTERS - chance))


#: Six standard deviations of the estimate at the threshold, for sets that fill the buckets on their own.
_SLACK = 6 * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5
#: Smaller sets than this leave buckets empty (one in e^8 at this size), and one shingle then decides about several registers.
_FILLED = 8 * REGISTERS


def ruled_out(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> bool:
    """Whether the registers alone say that a pair is no link. Of pairs with a set that borrows registers they never do."""
    return min(na, nb) >= _FILLED and estimate(a, b, na, nb) < PERCENT / 100 - _SLACK


def _set_table(docs: DataFrame, wide: bool) -> DataFrame:
    """(doc_id, n, digest, bands), or with ``wide`` (doc_id, n, sketch, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sizes, digests, rows, sets = [], [], [], []
                for s in shingle_sets(b.column(1).to_pylist()):
                    sizes.append(len(s))
                    rows.append(sketch(s) if len(s) else None)
                    if wide:
                        sets.append(s.tobytes())
                    else:
                        digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                n = pa.array(sizes, pa.int64())
                if wide:
                    cols = [b.column(0), n, pa.array([None if r is None else r.tobytes() for r in rows], pa.binary()), pa.array(sets, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "sketch", "shingles"])
                else:
                    full = [r for r in rows if r is not None]
                    keys = iter(band_keys(np.stack(full))) if full else iter(())
                    bands = pa.array([None if r is None else next(keys) for r in rows], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(digests, pa.binary()), bands], names=["doc_id", "n", "digest", "bands"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(tidy(run), "doc_id bigint, n bigint, " + ("sketch binary, shingles binary" if wide else "digest binary, bands array<bigint>"))


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The threshold on two full sets."""
    joined = np.sort(np.concatenate([a, b]))
    shared = int((joined[1:] == joined[:-1]).sum())
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links: estimate first, then the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            col = {c: b.column(c) for c in b.schema.names}
            for i in range(b.num_rows):
                na, nb = col["na"][i].as_py(), col["nb"][i].as_py()
                ka, kb = (np.frombuffer(col[c][i].as_buffer(), dtype=np.uint16) for c in ("ka", "kb"))
                if ruled_out(ka, kb, na, nb):
                    continue
                sa, sb = (np.frombuffer(col[c][i].as_buffer(), dtype=np.uint64) for c in ("sa", "sb"))
                keep[i] = _linked(sa, sb)
            yield pa.RecordBatch.from_arrays([col["a"].filter(pa.array(keep)), col["b"].filter(pa.array(keep))], names=["a", "b"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"), F.col("shingles").alias("sb"))
    rows = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    return rows.select("a", "b", "na", "nb", "ka", "kb", "sa", "sb").mapInArrow(tidy(run), "a bigint, b bigint")


def _pair(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


#: Sets whose sizes alone rule out the threshold need no test.
_SIZES = f"100 * least(n, n_other) >= {PERCENT} * greatest(n, n_other)"


def _still_apart(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, doc_id, part, main, size, minors) of buckets of several components; main is the largest, minors what is outside it."""
    named = buckets.join(parts.select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "doc_id", "left")
    named = written(named.select("key", "doc_id", F.coalesce("part", "doc_id").alias("part")), "near-members")
    sizes = named.groupBy("key", "part").agg(F.count(F.lit(1)).alias("s"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("s", "part")).alias("m"), F.sum("s").alias("size"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return named.join(keys.select("key", F.col("m.part").alias("main"), "size", (F.col("size") - F.col("m.s")).alias("minors")), "key")


def _in_blocks(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links found in the blocks of buckets of several components."""
    count = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    every = apart.select("key", "doc_id", "part", F.lit(False).alias("minor"), F.pmod(F.xxhash64("doc_id"), count("size")).cast("int").alias("x"),
                         F.explode(F.sequence(F.lit(0), count("minors") - 1)).alias("y"))
    minor = apart.filter("part <> main").select("key", "doc_id", "part", F.lit(True).alias("minor"), F.explode(F.sequence(F.lit(0), count("size") - 1)).alias("x"),
                                                F.pmod(F.xxhash64("doc_id", F.lit(1)), count("minors")).cast("int").alias("y"))
    rows = every.unionByName(minor).hint("merge").join(sets.select("doc_id", "shingles"), "doc_id")
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").select("key", "x", "y", "doc_id", "part", "minor", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            marks = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            ids, parts, minor = (batch.column(i).to_pylist() for i in (3, 4, 5))
            found: list[tuple[int, int]] = []
            for i, mark in enumerate(marks):
                if mark != now:
                    found += block_links(held, now[0]) if held else []
                    held, now = [], mark
                held.append((ids[i], parts[i], minor[i], np.frombuffer(batch.column(6)[i].as_py(), dtype=np.uint64)))
            yield _link_batch(found)
        yield _link_batch(block_links(held, now[0]) if held else [])

    return rows.mapInArrow(tidy(run), "a bigint, b bigint")


def _link_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])


def block_links(rows: list[tuple], key: int) -> list[tuple[int, int]]:
    """Links that join components within one block of a bucket; rows are (id, component, outside the main component, set).

    Rows outside the main component are held against all other rows of the block.
    """
    registers = np.stack([sketch(r[3]) for r in rows])
    keys = band_keys(registers)
    band = np.argmax(keys == key, axis=1)
    meet: dict[int, int] = {}

    def root(x: int) -> int:
        while meet.get(x, x) != x:
            x = meet[x]
        return x

    sizes = np.array([len(r[3]) for r in rows])
    whole = [i for i, r in enumerate(rows) if not r[2]]
    out: list[tuple[int, int]] = []
    for i in (i for i, r in enumerate(rows) if r[2]):
        others = np.array([j for j in whole if rows[j][0] != rows[i][0]], dtype=np.int64)
        if not len(others):
            continue
        n = sizes[others]
        fits = 100 * np.minimum(n, sizes[i]) >= PERCENT * np.maximum(n, sizes[i])
        fits &= np.argmax(keys[others] == keys[i], axis=1) == band[i]  # the first band that the pair shares
        others = others[fits]
        equal = (registers[others] == registers[i]).sum(axis=1)
        for j in others[np.argsort(-equal, kind="stable")].tolist():
            a, b = root(rows[i][1]), root(rows[j][1])
            if a == b or ruled_out(registers[i], registers[j], sizes[i], sizes[j]):
                continue
            if _linked(rows[i][3], rows[j][3]):
                meet[max(a, b)] = min(a, b)
                out.append((rows[i][0], rows[j][0]))
    return out


def near_links(docs: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, component) for representatives that have links. docs: (doc_id, text); buckets: (key, doc_id, n, size)."""
    reach = buckets.groupBy("doc_id").agg(F.sum("size").alias("reach"))
    held = written(buckets.join(reach, "doc_id"), "near-reach")
    sets = written(_set_table(docs.join(held.select("doc_id").distinct(), "doc_id", "left_semi"), wide=True), "near-sets")
    head = held.groupBy("key").agg(F.max(F.struct("reach", (-F.col("doc_id")).alias("low"), F.col("n").alias("n_other"))).alias("h"))
    head = head.select("key", (-F.col("h.low")).alias("other"), F.col("h.n_other").alias("n_other"))
    pairs = held.join(head, "key").filter(f"doc_id <> other AND {_SIZES}").select(*_pair("doc_id", "other")).distinct()
    links = written(_verified(written(pairs, "near-pairs"), sets), "near-links")
    parts = written(connected_components(links, "a", "b"), "near-parts")
    apart = written(_still_apart(buckets, parts), "near-apart")
    if apart.isEmpty():
        return parts
    more = written(_in_blocks(apart, sets), "near-links")
    return written(connected_components(links.unionByName(more), "a", "b"), "near-parts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; component_id is the smallest id that links reach."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = written(_set_table(docs, wide=False), "near-sketches")
    classes = written(table.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "near-classes")
    reps = table.filter("n > 0").select("doc_id", "n", "digest", "bands").join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    keyed = written(reps.select("doc_id", "n", F.explode("bands").alias("key")), "near-keys")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = written(keyed.join(shared, "key"), "near-buckets")
    parts = near_links(docs, buckets)
    classes = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = written(classes.select("digest", "copies", F.coalesce("component", "rep").alias("component_id")), "near-named")
    found = join_counted(table.select("doc_id", "n", "digest"), named, ["digest"], "copies", table.count())
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; columns as they were."""
    kept = near_duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("_kept_id")), "left_semi")
