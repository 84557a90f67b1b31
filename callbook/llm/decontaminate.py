"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

1. Every n-gram that a document shares with a test item is a seed, however frequent it is: an item whose passage fills
   a third of the corpus, or whose copies leave out its rare words, is found like any other.
2. The words around an item's seeds in a document, as far as the item would reach plus a margin, are aligned with the
   item's words: Smith-Waterman over word hashes, all pairs of a batch in lockstep. The score is divided by that of the
   item with itself, so edited, reordered or lengthened copies score between 0 and 1.

Short items say little by themselves, so chance similarity does not count for them: an item of fewer than `min_words`
words is held only by documents with all its words in a row, and one too short for an n-gram only by documents that
consist of it.

Documents are read once and never shuffled. The items go to tasks by broadcast in slices of at most `slice_words`
words, whatever their number; each slice is one pass. Alignments number the (document, item) pairs with an n-gram in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import map_arrow, mix, row_key, saved, word_hashes

MATCH, MISMATCH, GAP = 2, -1, -1
_CELLS = 4_000_000  # of alignment matrices' rows at a time, which bounds memory
_SEEDS = 200_000  # at a time, or those of one document


def grams_of(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, in order (none for fewer words)."""
    last = len(words) - width + 1
    if last <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(last, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : k + last]
    return mix(out)


@dataclass
class Items:
    """Word hashes of test items and their n-grams."""

    ids: list[int]
    words: list[np.ndarray]
    width: int
    min_words: int = 0

    def __post_init__(self):
        self.tiny: dict[bytes, list[int]] = {}  # items without an n-gram, by their words
        for k, w in enumerate(self.words):
            if len(w) < self.width:
                self.tiny.setdefault(w.tobytes(), []).append(k)
        rows = [(g, k, p) for k, w in enumerate(self.words) for p, g in enumerate(grams_of(w, self.width).tolist())]
        rows.sort()
        self.gram = np.array([r[0] for r in rows], np.uint64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.at = np.array([r[2] for r in rows], np.int64)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.known = np.unique(self.gram)
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[self.known >> np.uint64(42)] = True

    def threshold(self, usual: float) -> np.ndarray:
        """The least score of each item."""
        return np.where(self.size < self.min_words, 1.0, usual)

    def found(self, grams: np.ndarray) -> np.ndarray:
        """Places of grams that some item has."""
        maybe = np.flatnonzero(self.bloom[grams >> np.uint64(42)])
        return maybe[np.isin(grams[maybe], self.known)] if len(maybe) else maybe


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, as a share of the first one's own score, and where it ends in the second."""
    score, end = np.zeros(len(items)), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda k: (len(items[k]), len(windows[k])))
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and (j == i or (j - i + 1) * len(windows[order[j]]) <= _CELLS // 16 and len(items[order[j]]) <= 1.3 * len(items[order[i]]) + 4):
            j += 1
        part = order[i:j]
        wide, tall = max(len(windows[k]) for k in part), max(len(items[k]) for k in part)
        b = np.zeros((len(part), wide), np.uint64)
        a = np.ones((len(part), tall), np.uint64)
        for row, k in enumerate(part):
            b[row, : len(windows[k])] = windows[k]
            a[row, : len(items[k])] = items[k]
        ramp = (-GAP) * np.arange(wide, dtype=np.int32)
        above = np.zeros((len(part), wide + 1), np.int32)
        best, place = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
        rows = np.arange(len(part))
        for r in range(tall):
            t = np.maximum(above[:, :-1] + np.where(b == a[:, r : r + 1], MATCH, MISMATCH).astype(np.int32), above[:, 1:] + GAP)
            np.maximum(t, 0, out=t)
            above[:, 1:] = np.maximum.accumulate(t + ramp, 1) - ramp
            col = above[:, 1:].argmax(1)
            top = above[rows, col + 1]
            better = top > best
            best, place = np.where(better, top, best), np.where(better, col + 1, place)
        score[part] = best / np.array([MATCH * max(1, len(items[k])) for k in part])
        end[part] = place
        i = j
    return score, end


def _slices(benchmark: DataFrame, width: int, min_words: int, slice_words: int):
    """Items in slices of at most slice_words words (or one item); those without words are left out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, begins = word_hashes(batch.column("text"))
        lists = pa.LargeListArray.from_arrays(pa.array(begins, pa.int64()), pa.array(words.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("item_id"), lists.cast(pa.list_(pa.int64()))], ["item_id", "words"])

    known = map_arrow(benchmark.where("item_id is not null").select("item_id", "text"), run, "item_id long, words array<long>")
    ids, words, size = [], [], 0
    for row in known.where(F.size("words") > 0).toLocalIterator():
        w = np.array(row["words"], np.int64).view(np.uint64)
        if ids and size + len(w) > slice_words:
            yield Items(ids, words, width, min_words)
            ids, words, size = [], [], 0
        ids.append(row["item_id"])
        words.append(w)
        size += len(w)
    if ids:
        yield Items(ids, words, width, min_words)


def _windows(words: np.ndarray, begins: np.ndarray, it: Items) -> Iterator[tuple[np.ndarray, ...]]:
    """(documents, items, from, to) windows around all seeds of a batch, in parts of about _SEEDS seeds."""
    grams = grams_of(words, it.width)
    at = it.found(grams)
    doc = np.searchsorted(begins, at, "right") - 1
    inside = at + it.width <= begins[doc + 1]
    at, doc = at[inside], doc[inside]
    first = np.searchsorted(it.gram, grams[at], "left")
    many = np.searchsorted(it.gram, grams[at], "right") - first
    ends = np.flatnonzero(np.diff(doc, append=-1)) + 1  # a document's seeds stay together
    total = np.append(0, np.cumsum(many))
    i = 0
    while i < len(at):
        j = int(ends[max(np.searchsorted(total[ends], total[i] + _SEEDS, "right") - 1, np.searchsorted(ends, i, "right"))])
        n = many[i:j]
        row = np.repeat(first[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        d, item, offset = np.repeat(doc[i:j], n), it.item[row], np.repeat(at[i:j], n) - it.at[row]
        order = np.lexsort((offset, item, d))
        d, item, offset = d[order], item[order], offset[order]
        margin = it.size[item] // 3 + 8
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (offset[1:] > offset[:-1] + margin[1:])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(d)) - 1
        yield d[a], item[a], np.maximum(begins[d[a]], offset[a] - margin[a]), np.minimum(begins[d[a] + 1], offset[b] + it.size[item[a]] + margin[a])
        i = j


def _whole(words: np.ndarray, begins: np.ndarray, it: Items) -> tuple[np.ndarray, ...]:
    """(documents, items, scores, ends) of documents that consist of an item too short for an n-gram."""
    size = np.diff(begins)
    short = np.flatnonzero((size > 0) & (size < it.width)).tolist() if it.tiny else []
    pairs = np.array([(d, k) for d in short for k in it.tiny.get(words[begins[d] : begins[d + 1]].tobytes(), ())], np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], np.ones(len(pairs)), size[pairs[:, 0]]


def _matches(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        it = shared.value
        words, begins = word_hashes(batch.column("text"))
        least = it.threshold(threshold)
        found = [_whole(words, begins, it)]
        for d, item, lo, hi in _windows(words, begins, it):
            score, end = align([it.words[k] for k in item.tolist()], [words[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
            keep = score >= least[item]
            found.append((d[keep], item[keep], score[keep], (lo - begins[d] + end)[keep]))
        d, item, score, end = (np.concatenate(x) for x in zip(*found, strict=True))
        row = pa.array(d, pa.int64())
        columns = [*(batch.column(c).take(row) for c in ("doc_id", "k1", "k2")), pa.array([it.ids[k] for k in item.tolist()], pa.int64()), pa.array(score), pa.array(end, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "item_id", "score", "word_end"])

    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    return map_arrow(keyed, run, "doc_id long, k1 long, k2 long, item_id long, score double, word_end long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.3, width: int = 3, min_words: int = 8, slice_words: int = 2_000_000) -> DataFrame:
    """(doc_id, k1, k2, item_id, score, word_end): each document's best alignment with each item that it holds.

    k1, k2 name the row (see row_key), word_end is how many of its words end with the passage. Null and wordless texts
    match nothing, and items without words are held by nothing. Repeated rows give one result; null doc_ids stay null,
    null item_ids are left out; an item_id that names several texts counts for each. Of equal alignments the earlier one
    is given. Long texts are read whole. Only doc_id and text are read, so other columns may have any names. Items of
    fewer than min_words words count as a whole only (see above). Both ids are integers.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = []
    for items in _slices(benchmark.withColumn("item_id", F.col("item_id").cast("long")), width, min_words, slice_words):
        parts.append(_matches(docs, items, threshold))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, k1 long, k2 long, item_id long, score double, word_end long")
    found = reduce(DataFrame.unionByName, parts)
    best = F.max_by(F.struct("score", "word_end"), F.struct("score", -F.col("word_end")))
    return found.groupBy("doc_id", "k1", "k2", "item_id").agg(best.alias("best")).select("doc_id", "k1", "k2", "item_id", "best.score", "best.word_end")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a test item."""
    held = saved(contaminated(docs, benchmark, **options).select("k1", "k2").distinct(), "held")
    k1, k2 = row_key("doc_id", "text")
    keyed = docs.withColumns({"_k1": k1, "_k2": k2})
    return keyed.join(held, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left_anti").drop("_k1", "_k2")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("k1", "k2")
