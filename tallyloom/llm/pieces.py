"""Encoding and decoding with the pieces of a SentencePiece model, best and N best segmentations.

A text becomes ``▁`` and itself with spaces as ``▁``; its pieces are the path of the highest sum of scores through the
lattice of all pieces that occur in it. A character that is no piece is written as byte pieces, at a score ``UNKNOWN`` below
the lowest of the model; so is a ``▁`` of the text itself. Decoding gives the text back exactly.

N best: a forward Viterbi pass gives each position the best score of a path to it, which is an exact heuristic for
an A-star search from the end backwards: hypotheses leave the agenda in the order of their whole paths' scores.

No piece goes on behind the end of a word, so the lattice of a text is a chain of lattices of chunks. Chunks are
segmented once for each distinct text of a chunk, all of one length together in numpy, keeping the two best scores of each
position. The N best paths of a text differ from the best in some chunks; only the N - 1 chunks whose second best path
costs least can be among them, since each of these alone gives a path at least as good. A-star runs on these
chunks, and their N best lists are merged. Equal scores: the path that differs earlier in the text comes first, in A-star's order.

Defined cases: null and empty texts have no pieces, score 0 and one segmentation; texts are encoded whole; repeated rows
give equal results; an empty table gives no rows; extra columns are not read. A text with fewer than N segmentations
returns those that it has.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.workers import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = 10.0
_BARRED = -1e8  # models give pieces that they hardly want still lower scores
_SPACE = "▁"
_LITERAL = "\ud800"  # stands for a ▁ of the text, which is written as bytes; no valid text has this code
_VECTOR_LENGTH = 48  # longer chunks are segmented one by one
_HELD = 300_000  # distinct chunks that a worker remembers
_ROWS = 500  # texts that are encoded together
_BITS = 20
_TIMES = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The tables of a model, from its serialized form."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.by_text: dict[str, tuple[int, float]] = {}
        self.byte_id: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(text[1:-1], 16)] = i
                self.raw.append(bytes([int(text[1:-1], 16)]))
                continue
            usable = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
            self.raw.append(text.replace(_SPACE, " ").encode() if usable else b"")
            if usable:
                self.by_text.setdefault(text, (i, sp.get_score(i)))
        if len(self.byte_id) != 256:
            raise ValueError("the model has no pieces for all bytes")
        if any(_SPACE in t.lstrip(_SPACE) for t in self.by_text):
            raise ValueError("pieces that span words are not supported")
        self.unknown = min(s for _, s in self.by_text.values() if s > _BARRED) - UNKNOWN
        self.longest = max(map(len, self.by_text))
        joined = sorted({c for t in self.by_text if len(t) > 1 for c in t} - {_SPACE})
        inner = "".join(map(re.escape, joined))
        self.chunks = re.compile(f"{_SPACE}*[{inner}]+|{_SPACE}+|.", re.DOTALL) if inner else re.compile(f"{_SPACE}+|.", re.DOTALL)
        self._table()

    def _table(self) -> None:
        """An open-addressed table of the hashes of pieces and of their beginnings, for arrays of substrings."""
        entries = {t[:n]: -1 for t in self.by_text for n in range(1, len(t) + 1)} | {t: i for t, (i, _) in self.by_text.items()}
        keys = np.array([self._hash_one(t) for t in entries], dtype=np.uint64)
        if len(set(keys.tolist())) != len(keys):
            raise ValueError("two pieces have one hash")
        self.keys = np.append(keys, np.uint64(0))
        self.ids = np.array([*entries.values(), -1], dtype=np.int32)
        self.scores = np.array([*(self.by_text[t][1] if i >= 0 else -np.inf for t, i in entries.items()), -np.inf])
        self.slots = np.full((1 << _BITS) + 64, len(keys), dtype=np.int32)
        self.probes = 1
        for k, key in enumerate(keys.tolist()):
            at, step = key >> (64 - _BITS), 0
            while self.slots[at + step] < len(keys):
                step += 1
            self.slots[at + step] = k
            self.probes = max(self.probes, step + 1)

    @staticmethod
    def _hash_one(text: str) -> int:
        h = 0
        for c in text:
            h = ((h ^ ord(c)) * int(_TIMES)) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash; the last one for those without."""
        at = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        entry = self.slots[at]
        for step in range(1, self.probes):
            miss = np.flatnonzero((self.keys[entry] != h) & (entry < len(self.keys) - 1))
            if not len(miss):
                break
            entry[miss] = self.slots[at[miss] + step]
        return np.where(self.keys[entry] == h, entry, len(self.keys) - 1)

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.chunks.findall(_SPACE + text.replace(_SPACE, _LITERAL).replace(" ", _SPACE))

    def edge_ids(self, text: str) -> list[int]:
        """The ids of one edge of the lattice: a piece, or the bytes of a character that is none."""
        found = self.by_text.get(text)
        return [found[0]] if found else [self.byte_id[b] for b in text.replace(_LITERAL, _SPACE).encode()]

    def edges_to(self, chunk: str, end: int) -> Iterator[tuple[int, float]]:
        """(start, score) of the edges that end at ``end``."""
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            found = self.by_text.get(chunk[start:end])
            if found:
                yield start, found[1]
            elif start == end - 1:
                yield start, self.unknown

    def forward(self, chunk: str) -> tuple[list[float], list[float], list[int]]:
        """Viterbi: of each position the best and second best score of a path to it, and where the best one's last edge starts."""
        low = float("-inf")
        best, second, back = [0.0] + [low] * len(chunk), [low] * (len(chunk) + 1), [0] * (len(chunk) + 1)
        for end in range(1, len(chunk) + 1):
            for start, score in self.edges_to(chunk, end):
                a, b = best[start] + score, second[start] + score
                if a > best[end]:
                    best[end], second[end], back[end] = a, max(best[end], b), start
                else:
                    second[end] = max(second[end], a)
        return best, second, back

    def nbest(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best (score, ids), best first: A-star from the end with the forward scores as exact heuristic."""
        best, _, _ = self.forward(chunk)
        agenda = [(-best[-1], 0, len(chunk), 0.0, None)]
        made, out = 1, []
        while agenda and len(out) < n:
            _, _, at, behind, path = heapq.heappop(agenda)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += self.edge_ids(path[0])
                    path = path[1]
                out.append((behind, ids))
                continue
            for start, score in self.edges_to(chunk, at):
                heapq.heappush(agenda, (-(best[start] + score + behind), made, start, score + behind, (chunk[start:at], path)))
                made += 1
        return out

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best scores, losses of the second best paths, counts of ids, all ids of the best paths one after another)."""
        best, lost, count = np.zeros(len(chunks)), np.zeros(len(chunks)), np.zeros(len(chunks), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (chunk of each id, id), the ids of a chunk in order
        by_length: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            by_length.setdefault(len(c), []).append(i)
        for length, own in by_length.items():
            alone = own
            if length <= _VECTOR_LENGTH and len(own) >= 8:
                rows = np.array(own)
                codes = np.frombuffer("".join([chunks[i] for i in own]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(own), length).T.astype(np.uint64)
                best[rows], lost[rows], back, edge = self._viterbi(codes)
                known = np.ones(len(own), dtype=bool)
                at, cols, made = np.full(len(own), length), np.arange(len(own)), []
                while len(cols):
                    ids = edge[at, cols]
                    known[cols[ids < 0]] = False
                    made.append((cols, ids))
                    at = back[at, cols]
                    cols, at = cols[at > 0], at[at > 0]
                made = [(c[known[c]], ids[known[c]]) for c, ids in reversed(made)]
                parts.append((rows[np.concatenate([c for c, _ in made])], np.concatenate([ids for _, ids in made])))
                alone = rows[~known].tolist()
            for i in alone:
                a, b, back1 = self.forward(chunks[i])
                ids = self._ids(chunks[i], back1)
                best[i], lost[i] = a[-1], a[-1] - b[-1]
                parts.append((np.full(len(ids), i), np.array(ids, dtype=np.int32)))
        of = np.concatenate([c for c, _ in parts]) if parts else np.zeros(0, dtype=np.int64)
        ids = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, dtype=np.int32)
        count += np.bincount(of, minlength=len(chunks))
        return best, lost, count, ids[np.argsort(of, kind="stable")].astype(np.int32)

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``forward`` for chunks of one length, given as (length, chunks) codes; also the ids of the last edges, -1 where it is bytes."""
        length, n = codes.shape
        best, second = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
        back, edge = np.zeros((length + 1, n), dtype=np.int64), np.full((length + 1, n), -1, dtype=np.int32)
        best[0] = 0
        for start in range(length):  # edges by start: paths to it are final by then
            cols, h = np.arange(n), np.zeros(n, dtype=np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                h = (h ^ codes[end - 1, cols]) * _TIMES
                h ^= h >> np.uint64(29)
                entry = self.look_up(h)
                score, ids = self.scores[entry], self.ids[entry]
                if end == start + 1:
                    score = np.where(ids < 0, self.unknown, score)
                    use = slice(None)
                else:
                    use = np.flatnonzero(ids >= 0)
                c = cols[use]
                a, b = best[start, c] + score[use], second[start, c] + score[use]
                held, next_ = best[end, c], second[end, c]
                better = a >= held  # of equal paths the one with the shorter last edge, as in ``forward``
                second[end, c] = np.maximum(next_, np.where(better, np.maximum(held, b), a))
                best[end, c] = np.where(better, a, held)
                back[end, c] = np.where(better, start, back[end, c])
                edge[end, c] = np.where(better, ids[use], edge[end, c])
                on = np.flatnonzero(entry < len(self.keys) - 1)
                if not len(on):
                    break
                cols, h = cols[on], h[on]
        return best[-1], best[-1] - second[-1], back, edge

    def _ids(self, chunk: str, back: list[int]) -> list[int]:
        at, parts = len(chunk), []
        while at > 0:
            parts.append(self.edge_ids(chunk[back[at] : at]))
            at = back[at]
        return [i for p in reversed(parts) for i in p]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))[1:].decode("utf-8", "replace")


class Encoder:
    """Encodes batches of texts; remembers a bounded number of distinct chunks."""

    def __init__(self, pieces: Pieces, n: int):
        self.pieces, self.n = pieces, n
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores, self.losses = np.zeros(0), np.zeros(0)
        self.first, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.lists: dict[str, list[tuple[float, list[int]]]] = {}

    def _learn(self, split: list[list[str]]) -> None:
        if len(self.number) > _HELD:
            self.forget()
        new = list(set().union(*split).difference(self.number))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        best, lost, count, ids = self.pieces.segment(new)
        self.scores, self.losses = np.append(self.scores, best), np.append(self.losses, lost)
        self.first = np.append(self.first, self.first[-1] + np.cumsum(count))
        self.ids = np.append(self.ids, ids)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[float], list[np.ndarray]]]:
        """(ids, the N best scores, the N best id lists) of each text."""
        for some in range(0, len(texts), _ROWS):
            split = [self.pieces.split(t or "") for t in texts[some : some + _ROWS]]
            self._learn(split)
            for chunks in split:
                at = np.fromiter(map(self.number.__getitem__, chunks), dtype=np.int64, count=len(chunks))
                size = self.first[at + 1] - self.first[at]
                ends = np.cumsum(size)
                ids = self.ids[np.repeat(self.first[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
                total = float(self.scores[at].sum())
                if self.n == 1:
                    yield ids, [total], [ids]
                else:
                    yield ids, *self._several(chunks, at, ids, ends, total)

    def _several(self, chunks: list[str], at: np.ndarray, ids: np.ndarray, ends: np.ndarray, total: float) -> tuple[list[float], list[np.ndarray]]:
        n = self.n
        paths: list[tuple[float, dict[int, list[int]]]] = [(0.0, {})]
        if len(at):
            lost = self.losses[at]
            most = min(n - 2, len(lost) - 1)
            near = np.flatnonzero(lost <= np.partition(lost, most)[most])
            near = near[np.argsort(lost[near], kind="stable")][: n - 1]
            for place in sorted(near[np.isfinite(lost[near])].tolist()):
                chunk = chunks[place]
                if chunk not in self.lists:
                    if len(self.lists) > _HELD // 3:
                        self.lists.clear()
                    self.lists[chunk] = self.pieces.nbest(chunk, n)
                ways = self.lists[chunk]
                merged = [(loss + ways[0][0] - score, way, k, held, more) for way, (loss, held) in enumerate(paths) for k, (score, more) in enumerate(ways)]
                merged.sort(key=lambda m: m[:3])
                paths = [(m[0], m[3] | ({place: m[4]} if m[2] else {})) for m in merged[:n]]
        lists = []
        for _, held in paths:
            parts, done = [], 0
            for place in sorted(held):
                before = int(ends[place - 1]) if place else 0
                parts += [ids[done:before], np.array(held[place], dtype=np.int32)]
                done = int(ends[place])
            lists.append(np.concatenate([*parts, ids[done:]]) if parts else ids)
        return [total - loss for loss, _ in paths], lists


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _digest(lists: list[np.ndarray]) -> str:
    h = hashlib.sha256()
    for ids in lists:
        h.update(len(ids).to_bytes(8, "little") + ids.astype("<i4").tobytes())
    return h.hexdigest()


_SCHEMA = "doc_id bigint, n_pieces bigint, score double, ids_sha256 string, nbest_scores array<double>, nbest_sha256 string, text_sha256 string, round_trip boolean"


def encode_documents(docs: DataFrame, n: int = 4, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, finds the N best segmentations, decodes each and compares: digests and scores of every text. Nothing is shuffled.

    The driver reads the model, which is broadcast: its size does not depend on the corpus.
    """
    held = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value)
        encoder = Encoder(pieces, n)
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = []
            for text, (ids, scores, lists) in zip(texts, encoder.encode(texts), strict=True):
                back = [pieces.decode(x) for x in lists]
                rows.append((len(ids), scores[0], _digest([ids]), scores, _digest(lists), hashlib.sha256(back[0].encode()).hexdigest(), all(x == (text or "") for x in back)))
            kinds = (pa.int64(), pa.float64(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.bool_())
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_pieces", "score", "ids_sha256", "nbest_scores", "nbest_sha256", "text_sha256", "round_trip"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), _SCHEMA)


def _departure(best: np.ndarray, other: np.ndarray) -> tuple[int, int, list[int]]:
    """(at, drop, put): ``other`` is ``best`` with ``drop`` ids at ``at`` replaced by ``put``."""
    most = min(len(best), len(other))
    apart = np.flatnonzero(best[:most] != other[:most])
    at = int(apart[0]) if len(apart) else most
    apart = np.flatnonzero(best[::-1][: most - at] != other[::-1][: most - at])
    behind = int(apart[0]) if len(apart) else most - at
    return at, len(best) - at - behind, other[at : len(other) - behind].tolist()


_WAY = pa.struct([("score", pa.float64()), ("at", pa.int32()), ("drop", pa.int32()), ("put", pa.list_(pa.int32()))])


def encoded(docs: DataFrame, keep: list[str], n: int = 4, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """Columns ``keep``; ``ids``, the best segmentation of the text; ``nbest``, the ``n`` best, best first; ``text_sha256`` of the
    decoded best one, and ``round_trip``: whether all ``n`` decode to the text.

    A segmentation of ``nbest`` is its score and what tells it from ``ids``: ids[:at] + put + ids[at + drop:].
    """
    held = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value)
        encoder = Encoder(pieces, n)
        for b in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            texts = b.column(len(keep)).to_pylist()
            best, ways, digests, same = [], [], [], []
            for text, (ids, scores, lists) in zip(texts, encoder.encode(texts), strict=True):
                back = [pieces.decode(x) for x in lists]
                best.append(ids)
                ways.append([(score, *_departure(ids, x)) for score, x in zip(scores, lists, strict=True)])
                digests.append(hashlib.sha256(back[0].encode()).hexdigest())
                same.append(all(x == (text or "") for x in back))
            cols = [pa.array(best, pa.list_(pa.int32())), pa.array(ways, pa.list_(_WAY)), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=[*keep, "ids", "nbest", "text_sha256", "round_trip"])

    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    fields = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes[:-1])
    way = "struct<score: double, at: int, drop: int, put: array<int>>"
    return rows.mapInArrow(tidy(run), f"{fields}, ids array<int>, nbest array<{way}>, text_sha256 string, round_trip boolean")


def decoded(rows: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with ``out_col`` decoded from ids; null ids give null."""
    held = rows.sparkSession.sparkContext.broadcast(model_bytes(model))
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value)
        for b in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    fields = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(tidy(run), f"{fields}, `{out_col}` string")
