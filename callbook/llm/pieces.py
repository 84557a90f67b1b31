"""SentencePiece encoding with exact n-best segmentations, and decoding.

A text becomes pieces of a SentencePiece vocabulary. No piece holds a word boundary (U+2581) after another character,
and none holds a newline, so every path through the text's piece lattice passes the boundaries: the lattice is a
chain of chunks, each with its own small lattice. A piece's log-probability follows Zipf's law of its rank; a
character without a piece is spelled in byte pieces, each as improbable as the last rank.

Per chunk, forward Viterbi scores are exact heuristics for a backward A-star search that pops segmentations in order
of score. A text's n best segmentations differ from its best in the chunks whose second-best costs least: only the
n-1 cheapest can matter (n-1 single changes there are at least as good as any change elsewhere), so A-star runs on
those, and their lists are combined in order. Forward and backward Viterbi run over all distinct chunks of a batch at
once in numpy; chunks longer than `_WIDE` characters take the same steps one by one.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import map_arrow, mix, schema_with, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_WIDE = 24
_M = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 18  # of the hash table of pieces
_BATCH = 8_000_000  # characters encoded together


def _point_hash(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x1234567))


@dataclass
class Best:
    """One segmentation: its log-probability and piece ids."""

    score: float
    ids: tuple[int, ...]


class Vocabulary:
    """Pieces, their log-probabilities and a vectorised lookup of substrings by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usual = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ranked = sorted(usual, key=lambda i: (-model.get_score(i), i))
        total = np.log(np.log(len(ranked) + 2) + 0.577)
        self.logp = np.full(size, -np.log(len(ranked) + 2.0) - total)
        self.logp[ranked] = -np.log(np.arange(len(ranked)) + 2.0) - total
        self.ids = {model.id_to_piece(i): i for i in usual}
        assert all(SPACE not in p.lstrip(SPACE) and "\n" not in p for p in self.ids)
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.longest = max(map(len, self.ids))
        # decoding: bytes of each piece; control and unknown pieces give nothing
        self.spelled = [b""] * size
        for piece, i in self.ids.items():
            self.spelled[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.spelled[int(i)] = bytes([b])
        keys = []
        for piece in self.ids:
            h = np.zeros(1, np.uint64)
            for c in _point_hash(np.array([ord(c) for c in piece], np.uint32)):
                h = h * _M + c
            keys.append(int(h[0]))
        assert len(set(keys)) == len(keys) and 0 not in keys
        # open addressing; 0 marks a free slot
        self.slots, self.slot_ids = np.zeros(1 << _SLOT_BITS, np.uint64), np.zeros(1 << _SLOT_BITS, np.int32)
        for key, slot, i in zip(keys, self._slot(np.array(keys, np.uint64)).tolist(), self.ids.values(), strict=True):
            while self.slots[slot]:
                slot = (slot + 1) % len(self.slots)
            self.slots[slot], self.slot_ids[slot] = key, i

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        slot = self._slot(hashes)
        held = self.slots[slot]
        out = np.where(held == hashes, self.slot_ids[slot], -1)
        at = np.flatnonzero((held != hashes) & (held != 0))
        while len(at):
            slot[at] = (slot[at] + 1) % len(self.slots)
            held = self.slots[slot[at]]
            hit = held == hashes[at]
            out[at[hit]] = self.slot_ids[slot[at[hit]]]
            at = at[~hit & (held != 0)]
        return out

    def edges(self, chunk: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """The lattice's edges (start, log-probability, ids) into a place of a chunk."""
        found = []
        for i in range(max(0, end - self.longest), end):
            piece = self.ids.get(chunk[i:end])
            if piece is not None:
                found.append((i, float(self.logp[piece]), (piece,)))
            elif i == end - 1:
                spelled = tuple(int(b) for b in self.byte_ids[list((chunk[i].replace(SPACE, " ")).encode())])
                found.append((i, float(self.logp[list(spelled)].sum()), spelled))
        return found

    def n_best(self, chunk: str, n: int) -> list[Best]:
        """The n best segmentations of a chunk, best first: forward Viterbi, then A-star from the end.

        Of equal scores the path that has come further goes first, and no place is left more than n times, since its n
        best ends are all that the n best segmentations can hold: the work is linear in the chunk, whatever ties it has.
        """
        ahead = array("d", [0.0])  # best log-probability from the start: the exact heuristic
        for j in range(1, len(chunk) + 1):
            ahead.append(max(ahead[i] + s for i, s, _ in self.edges(chunk, j)))
        heap: list[tuple] = [(-ahead[-1], len(chunk), 0, 0.0, None)]
        left = bytearray(len(chunk) + 1) if n < 256 else [0] * (len(chunk) + 1)
        found, made = [], 0
        while heap and len(found) < n:
            _, at, _, behind, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                found.append(Best(behind, tuple(ids)))
                continue
            if left[at] == n:
                continue
            left[at] += 1
            for i, s, piece in self.edges(chunk, at):
                made += 1
                heapq.heappush(heap, (-(ahead[i] + behind + s), i, made, behind + s, (piece, path)))
        return found


@functools.lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _viterbi(v: Vocabulary, points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chunks (rows of code points, padded with 0): best score, cost of the second best, and the best path's piece
    lengths by start (0 where no piece begins). Only chunks in which every character has a piece may be given."""
    n, width = points.shape
    coded = _point_hash(points)
    coded[points == 0] = np.uint64(0xDEADBEEFDEADBEEF)
    forward = np.full((width + 1, n), -np.inf)
    forward[0] = 0
    back = np.zeros((width + 1, n), np.int8)
    edges: dict[tuple[int, int], np.ndarray] = {}
    for i in range(width):
        h = np.zeros(n, np.uint64)
        for k in range(1, min(v.longest, width - i) + 1):
            h = h * _M + coded[:, i + k - 1]
            ids = v.lookup(h)
            if not (ids >= 0).any():
                continue
            s = np.where(ids >= 0, v.logp[ids], -np.inf)
            edges[i, k] = s
            t = forward[i] + s
            better = t > forward[i + k]
            forward[i + k] = np.where(better, t, forward[i + k])
            back[i + k] = np.where(better, k, back[i + k])
    rows = np.arange(n)
    behind = np.full((width + 1, n), -np.inf)
    behind[size, rows] = 0
    for (i, k), s in sorted(edges.items(), reverse=True):
        behind[i] = np.maximum(behind[i], s + behind[i + k])
    chosen = np.zeros((width + 1, n), np.int8)
    at = size.copy()
    while (live := at > 0).any():
        k = back[at, rows]
        at = np.where(live, at - k, 0)
        chosen[at[live], rows[live]] = k[live]
    best = forward[size, rows]
    second = np.full(n, -np.inf)
    for (i, k), s in edges.items():
        through = forward[i] + s + behind[i + k]
        second = np.maximum(second, np.where(chosen[i] == k, -np.inf, through))
    return best, np.maximum(best - second, 0), chosen[:width]


class Encoder:
    """Encodes batches of texts."""

    def __init__(self, path: str, n: int):
        self.v, self.n = vocabulary(path), n

    def _distinct(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Best score, cost of the second best and best ids of each distinct chunk."""
        v = self.v
        score, cost = np.zeros(len(chunks)), np.full(len(chunks), np.inf)
        ids: list = [None] * len(chunks)
        length = np.array([len(c) for c in chunks], np.int64)
        for low, width in ((0, 5), (5, 9), (9, 13), (13, 18), (18, _WIDE)):
            at = np.flatnonzero((length > low) & (length <= width))
            for part in np.array_split(at, -(-len(at) // 20_000)) if len(at) else ():
                size = length[part]
                points = np.zeros((len(part), width), np.uint32)
                points[np.arange(width) < size[:, None]] = np.frombuffer("".join(chunks[k] for k in part).encode("utf-32-le"), np.uint32)
                single = v.lookup(np.zeros(1, np.uint64) * _M + _point_hash(points.ravel())).reshape(points.shape)
                plain = ((single >= 0) | (points == 0)).all(1)
                for k in part[~plain]:
                    self._slow(chunks, int(k), score, cost, ids)
                part, points, size = part[plain], points[plain], size[plain]
                if not len(part):
                    continue
                score[part], cost[part], chosen = _viterbi(v, points, size)
                # the ids of the best path: hash each chosen piece again
                start, row = np.nonzero(chosen)
                k = chosen[start, row].astype(np.int64)
                coded = _point_hash(points)
                h = np.zeros(len(k), np.uint64)
                for step in range(int(k.max())):
                    live = step < k
                    h[live] = h[live] * _M + coded[row[live], start[live] + step]
                found = v.lookup(h)
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(len(part) + 1))
                found = found[order]
                for x, k_ in enumerate(part.tolist()):
                    ids[k_] = found[cuts[x] : cuts[x + 1]]
        for k in np.flatnonzero(length > _WIDE):
            self._slow(chunks, int(k), score, cost, ids)
        return score, cost, ids

    def _slow(self, chunks: list[str], k: int, score: np.ndarray, cost: np.ndarray, ids: list) -> None:
        found = self.v.n_best(chunks[k], 2)
        score[k], ids[k] = found[0].score, np.array(found[0].ids, np.int32)
        if len(found) > 1:
            cost[k] = found[0].score - found[1].score

    def encode(self, texts: list[str]):
        """For each text, ids of the best segmentation and all n best as (score, number of pieces, changed chunks).

        changed: {chunk number: ids} against the best. Also the place of each chunk's ids in the best ones.
        """
        cut = [_chunks(t) for t in texts]
        number: dict[str, int] = {}
        codes = [np.fromiter((number.setdefault(c, len(number)) for c in chunks), np.int64, len(chunks)) for chunks in cut]
        distinct = list(number)
        score, cost, ids = self._distinct(distinct)
        length = np.array([len(x) for x in ids], np.int64)
        begin = np.cumsum(length) - length
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        lists: dict[int, list[Best]] = {}
        for code in codes:
            size = length[code]
            ends = np.cumsum(size)
            where = np.repeat(begin[code] - (ends - size), size) + np.arange(int(size.sum()))
            yield flat[where], self._combine(code, float(score[code].sum()), int(size.sum()), cost, distinct, lists), ends - size

    def _combine(self, code: np.ndarray, score: float, pieces: int, cost: np.ndarray, distinct: list[str], lists: dict) -> list[tuple[float, int, dict]]:
        ways: list[tuple[float, int, dict]] = [(0.0, pieces, {})]
        if len(code) and self.n > 1:
            c = cost[code]
            few = min(self.n - 1, len(c))
            edge = np.partition(c, few - 1)[few - 1]
            near = np.concatenate([np.flatnonzero(c < edge), np.flatnonzero(c == edge)])[:few]  # ties: earlier chunks
            for at in sorted(near[np.isfinite(c[near])].tolist()):
                best = lists.get(int(code[at])) or lists.setdefault(int(code[at]), self.v.n_best(distinct[code[at]], self.n))
                more = [(d + b.score - best[0].score, p + len(b.ids) - len(best[0].ids), {**changed, at: b.ids} if k else changed) for d, p, changed in ways for k, b in enumerate(best)]
                ways = sorted(more, key=lambda w: -w[0])[: self.n]
        return [(score + d, p, changed) for d, p, changed in ways]


def _chunks(text: str) -> list[str]:
    """The chunks of a text, with the word boundary that SentencePiece puts before it."""
    return _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []


def encode(docs: DataFrame, n: int = 4, model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """docs with n_pieces, ids (array<int>; null unless with_ids), ids_sha256 and nbest.

    nbest is array<struct<score,n_pieces,ids>>, best first, ties by the earlier chunk; fewer than n where a text has
    fewer segmentations. ids_sha256 is of the best ids as 32-bit little-endian integers, and `decoded` says whether
    they decode to the text. Null and empty texts have no pieces and one empty segmentation of score 0. Repeated rows
    are encoded each, long texts whole; a chunk without word boundaries takes time and memory in proportion to its
    length, whatever it consists of. Columns named like the results are replaced.
    """
    docs = docs.drop("n_pieces", "ids", "ids_sha256", "nbest", "decoded")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = Encoder(model, n)
        texts = texts_of(batch.column("text"))
        count, all_ids, digest, nbest, same = [], [], [], [], []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _BATCH):
                size += len(texts[end])
                end += 1
            for text, (ids, ways, begins) in zip(texts[at:end], encoder.encode(texts[at:end]), strict=True):
                count.append(len(ids))
                digest.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                same.append(spell(ids, encoder.v) == text.encode("utf-8"))
                all_ids.append(ids if with_ids else None)
                nbest.append([{"score": s, "n_pieces": p, "ids": _changed(ids, begins, changed) if with_ids else None} for s, p, changed in ways])
            at = end
        ids_type = pa.list_(pa.int32())
        kinds = (pa.int64(), ids_type, pa.string(), pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids", ids_type)])), pa.bool_())
        made = [pa.array(x, t) for x, t in zip((count, all_ids, digest, nbest, same), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "n_pieces", "ids", "ids_sha256", "nbest", "decoded"])

    return map_arrow(docs, run, schema_with(docs, "n_pieces long, ids array<int>, ids_sha256 string, nbest array<struct<score:double,n_pieces:long,ids:array<int>>>, decoded boolean"))


def _changed(ids: np.ndarray, begins: np.ndarray, changed: dict[int, tuple[int, ...]]) -> list[int]:
    out, at = [], 0
    for chunk, other in sorted(changed.items()):
        end = int(begins[chunk + 1]) if chunk + 1 < len(begins) else len(ids)
        out += [*ids[at : int(begins[chunk])].tolist(), *other]
        at = end
    return out + ids[at:].tolist()


def spell(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The UTF-8 bytes that ids spell, without the leading boundary."""
    raw = b"".join(map(v.spelled.__getitem__, ids.tolist()))
    return raw[1:] if raw[:1] == b" " else raw


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded_text", model: str = MODEL) -> DataFrame:
    """df with the text that the ids spell (null ids: null; bytes that are no UTF-8 become U+FFFD)."""
    df = df.drop(to)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(model)
        out = [None if x is None else spell(np.array(x, np.int64), v).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, to])

    return map_arrow(df, run, schema_with(df, f"{to} string"))


def digest(docs: DataFrame, n: int = 4, model: str = MODEL) -> DataFrame:
    """One row per document without the ids themselves: doc_id, n_pieces, ids_sha256, decoded, scores and lengths of the n best."""
    found = encode(docs.select("doc_id", "text"), n, model, with_ids=False)
    return found.select("doc_id", "n_pieces", "ids_sha256", "decoded", F.col("nbest.score").alias("scores"), F.col("nbest.n_pieces").alias("lengths"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
