"""Periodic runs of words: suffix trees of a text and of its reversal, with Lyndon roots as candidates.

A run is a stretch of words with smallest period q, at least max(`least`, 2 q) words long, that no neighbouring word
extends. Per text:

1. Where a run can lie. Every word of a run of at least 12 words belongs to six words in a row that stand once more a
   period away, so stretches without such repeats hold no run. This only narrows the text: `least` below 12 skips it.
2. Ukkonen's algorithm builds the suffix tree of a stretch and that of its reversal. A depth-first tour lists the leaves
   in order; the depths of the nodes where the tour turns from one leaf to the next, under a sparse table of minima, give
   the depth of any two leaves' lowest common ancestor in constant time: how far two places agree (LCE).
3. The longest Lyndon word from each place, in the order of words and in its reverse, ends at the next smaller or next
   greater suffix. Each is a candidate root: it is extended to both sides by the two trees' LCE and is a run if both
   extensions add up to a period. The root of every run is among these at most 2 n candidates (the runs theorem), and as a
   Lyndon word has no smaller period than its length, that is the run's smallest.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import map_arrow, schema_with

LEAST = 12
_GRAM = 6
_M = np.uint64(0x9E3779B97F4A7C15)
RUN = np.dtype([("start", np.int64), ("length", np.int64), ("period", np.int64)])


class SuffixTree:
    """Ukkonen's suffix tree of numbers (from 0) and an end that is smaller than all; answers how far suffixes agree."""

    def __init__(self, text: list[int]):
        s = [x + 1 for x in text]
        s.append(0)
        self.size, self.base = len(s), max(s) + 1
        self._build(s)

    def _build(self, s: list[int]) -> None:
        size, base = self.size, self.base
        room = bytes(8 * size)  # at most 2 * size nodes
        begin, end, link = array("i", room), array("i", room), array("i", room)
        depth, suffix = array("i", room), array("i", room)  # letters above an inner node; where a leaf's suffix begins
        child: dict[int, int] = {}  # node * base + first number of the edge -> node
        get = child.get
        made = 1
        node = edge = length = waiting = 0  # the active point and how many suffixes wait there
        for i, c in enumerate(s):
            waiting += 1
            fresh = 0  # an inner node that lacks its suffix link
            while waiting:
                if not length:
                    edge = i
                key = node * base + s[edge]
                at = get(key)
                if at is None:
                    leaf = child[key] = made
                    made += 1
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    first = begin[at]
                    span = end[at] - first
                    if length >= span:
                        edge += span
                        length -= span
                        node = at
                        continue
                    other = s[first + length]
                    if other == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    # the edge is split: an inner node, below it the old end and a new leaf
                    begin[made] = first
                    end[made] = begin[at] = first + length
                    depth[made] = depth[node] + length
                    leaf = made + 1
                    child[key] = made
                    child[made * base + c] = leaf
                    child[made * base + other] = at
                    if fresh:
                        link[fresh] = made
                    fresh = made
                    made += 2
                begin[leaf] = i
                end[leaf] = size
                waiting -= 1
                suffix[leaf] = i - waiting
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self._tour(child, made, np.frombuffer(depth, np.int32), suffix)

    def _tour(self, child: dict[int, int], made: int, depth: np.ndarray, suffix: array) -> None:
        """Leaves in order and the depth of the node where the tour turns between each two."""
        keys = np.fromiter(child.keys(), np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)
        above, below = keys[order] // self.base, below[order]
        # what the tour meets below each node, last first: a child, the turn (-1 - node), the child before it, ...
        met = np.empty(2 * len(below), np.int64)
        met[0::2], met[1::2] = -1 - above, below
        head = np.append(True, above[1:] != above[:-1])
        keep = np.ones(len(met), bool)
        keep[0::2] = ~head  # no turn before the first child
        met = met[keep]
        cuts = np.append(2 * np.searchsorted(above, np.arange(made + 1)), 0)[:-1]
        cuts -= np.append(0, np.cumsum(np.bincount(above, minlength=made) > 0))
        total = len(met)
        met = met[::-1].tolist()
        cuts = (total - cuts).tolist()
        leaves, turns = [], []
        stack = [0]
        pop, leaf, turn = stack.pop, leaves.append, turns.append
        while stack:
            v = pop()
            if v < 0:
                turn(v)
            elif (lo := cuts[v + 1]) == (hi := cuts[v]):
                leaf(v)
            else:
                stack += met[lo:hi]
        self.order = np.frombuffer(suffix, np.int32)[leaves].astype(np.int64)
        self.rank = np.empty(self.size, np.int64)
        self.rank[self.order] = np.arange(self.size)
        least = np.append(0, depth[-1 - np.array(turns, np.int64)]).astype(np.int32)
        self.minima = [least]
        step = 1
        while 2 * step < self.size:
            least = np.minimum(least[:-step], least[step:])
            self.minima.append(least)
            step *= 2

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers agree from i and from j on (i != j, both up to the end's place)."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(hi - lo + 1)[1] - 1
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            table = self.minima[k]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
        return out


def _next(rank: list[int], greater: bool) -> np.ndarray:
    """For each place the next one whose suffix is smaller (or greater); the length where there is none."""
    n = len(rank)
    out = [n] * n
    if greater:
        rank = [-r for r in rank]
    stack: list[int] = []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(codes: list[int], least: int = LEAST) -> np.ndarray:
    """All runs of a stretch of numbers by start, then period."""
    n = len(codes)
    if n < 2:
        return np.zeros(0, RUN)
    ahead, behind = SuffixTree(codes), SuffixTree(codes[::-1])
    rank = ahead.rank[:n].tolist()
    found = []
    for greater in (False, True):
        end = _next(rank, greater)
        i = np.flatnonzero(end < n)
        q = end[i] - i
        right = ahead.agree(i, i + q)
        left = np.zeros(len(i), np.int64)
        inner = i > 0
        left[inner] = behind.agree(n - i[inner], n - i[inner] - q[inner])
        good = (left + right >= q) & (left + right + q >= least)
        found.append(np.stack([i - left, left + right + q, q], 1)[good])
    rows = np.unique(np.concatenate(found), axis=0)
    out = np.empty(len(rows), RUN)
    out["start"], out["length"], out["period"] = rows.T
    return out[np.lexsort((out["period"], out["start"]))]


def _stretches(words: np.ndarray, rounds: int = 4) -> list[tuple[int, int]]:
    """Stretches outside which no run of at least 12 words lies, from the words' hashes."""
    n = len(words)
    if n < LEAST:
        return []
    grams = np.zeros(n - _GRAM + 1, np.uint64)
    for k in range(_GRAM):
        grams = grams * _M + words[k : k + len(grams)]
    spans = np.array([[0, n]])
    for _ in range(rounds):
        size = spans[:, 1] - spans[:, 0]
        inside = size - _GRAM + 1
        at = np.repeat(spans[:, 0] - (np.cumsum(inside) - inside), inside) + np.arange(int(inside.sum()))
        owner = np.repeat(np.arange(len(spans)), inside)
        key = grams[at] + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(key, kind="stable")
        again = (key[order[1:]] == key[order[:-1]]) & (at[order[1:]] - at[order[:-1]] <= size[owner[order[1:]]] // 2)
        if not again.any():
            return []
        steps = np.zeros(n + 1, np.int64)
        for place in (at[order[:-1]][again], at[order[1:]][again]):
            np.add.at(steps, place, 1)
            np.add.at(steps, place + _GRAM, -1)
        # a stretch doesn't reach into the next one
        held = np.zeros(n + 2, bool)
        held[1:-1] = np.cumsum(steps[:-1]) > 0
        edge = np.flatnonzero(held[1:] != held[:-1]).reshape(-1, 2)
        cut = np.setdiff1d(spans[:, 0], edge[:, 0])
        cut = cut[held[1:][cut] & held[cut]]
        edge = np.sort(np.concatenate([edge.ravel(), cut, cut])).reshape(-1, 2)
        edge = edge[edge[:, 1] - edge[:, 0] >= LEAST]
        if np.array_equal(edge, spans):
            break
        spans = edge
        if not len(spans):
            return []
    return [(int(a), int(b)) for a, b in spans]


def find(words: list[bytes], least: int = LEAST) -> np.ndarray:
    """All runs of a text's words by start, then period."""
    if least < LEAST:
        spans = [(0, len(words))]
    else:
        spans = _stretches(np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64))
    found = []
    for a, b in spans:
        part = words[a:b]
        number = {w: k for k, w in enumerate(sorted(set(part)))}
        runs = runs_of([number[w] for w in part], least)
        runs["start"] += a
        found.append(runs)
    return np.concatenate(found) if found else np.zeros(0, RUN)


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs["start"] + runs["period"], 1)
    np.add.at(steps, runs["start"] + runs["length"], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, least: int = LEAST, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """docs with n_words, runs (array<struct<start,length,period>> by start, then period) and collapsed.

    Words are what blanks (0x20, 0x09 to 0x0D) separate, compared byte by byte; `change` may replace a document's words
    before the search. collapsed is the words that no run holds after its first period, joined by one space. Null and
    empty texts have no words, no runs and an empty text. Repeated rows have a row each; an empty table gives none.
    Columns named like the results are replaced. Texts are searched whole; the trees take about 0.4 KB for each word of a
    stretch that may hold runs, other words a few bytes.
    """
    docs = docs.drop("n_words", "runs", "collapsed")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
        ids = batch.column("doc_id").to_pylist() if change else [None] * len(texts)
        counts, found, kept = [], [], []
        for doc_id, text in zip(ids, texts, strict=True):
            words = text.split()  # bytes: just these blanks
            if change:
                words = change(doc_id, words)
            runs = find(words, least)
            counts.append(len(words))
            found.append(runs)
            kept.append(b" ".join(collapsed(words, runs)))
        flat = np.concatenate(found) if found else np.zeros(0, RUN)
        ends = np.append(0, np.cumsum([len(r) for r in found])).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(flat[n].copy()) for n in RUN.names], names=list(RUN.names))
        made = [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "n_words", "runs", "collapsed"])

    return map_arrow(docs, run, schema_with(docs, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"))


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's texts: for a tenth of the ids the words from some place on repeat with some period."""
    code, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or code % 10 or not n:
        return words
    g = code // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def digest(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one (ties: smallest start, then period) and digests of all."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("top", longest)
    length = -F.col("top.shorter")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        length.alias("length"),
        F.col("top.period").alias("period"),
        F.expr("(-top.shorter * 1000) div top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(find_runs(docs, change=looped))
