"""Best-fit packing of token sequences by exact-complement hashing.

Every text becomes the ids of a byte-level BPE vocabulary and an end id; what is longer than a sequence is cut from its
end into whole sequences, so only the first piece may be shorter. Pieces are then known by their length alone: Spark
counts them by length, and the plan works on these counts (one per length, however many documents there are):

1. Lengths from long to short: the gap of a sequence that begins with the length is looked up in the index of the sums
   of one, two and three available lengths. A combination that fills the gap exactly is used as often as the counts
   allow, and so on until the length is used up or nothing fills its gap.
2. Best fit of the rest: a sequence takes, again and again, the longest piece that still fits, unless up to three
   pieces fill its gap exactly.

The index of pairs holds, for every sum, how many pairs of available lengths make it; a triple is one length and an
entry of that index. Each combination uses up a length, so the plan has a few thousand lines at most.

A piece finds its place without a global sort: tasks number their pieces by length as they write them, sums of the
counts of earlier tasks turn these into ranks within a length, and a rank's line of the plan gives its sequence.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callbook.llm.common import map_arrow, saved, scratch, slices, texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
END_ID = 2
_KNOWN = 300_000  # parts of texts in each of the two generations that a worker remembers
# The vocabulary's pre-split joins white space only in runs of three and more, or two at the end of the text. Elsewhere
# each blank or newline begins a token, so texts fall into parts that are encoded apart.
_OTHER_BLANK = re.compile("[\0\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LONG_BLANK = re.compile("[ \n]{3}")
_CUT = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")  # for the other texts: before a blank between two visible characters
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible bytes themselves, others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(other)}


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Tokenizer:
    """Encodes texts; parts that were seen before are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Load

        self.whole = Load.from_file(path)
        self.bpe, self.letters = self.whole.model, _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids_of(self, part: str) -> bytes:
        """The part's ids as 32-bit integers."""
        found = self.young.get(part)
        if found is None:
            found = self.old.get(part)
            if found is None:
                word = _WORD.fullmatch(part)
                if word is None:
                    found = array("I", self.whole.encode(part, add_special_tokens=False).ids).tobytes()
                elif word[2]:  # marks after a word begin a token of their own, and are remembered apart from it
                    return self.ids_of(word[1]) + self.ids_of(word[2])
                else:
                    found = array("I", [t.id for t in self.bpe.tokenize(part.encode().decode("latin-1").translate(self.letters))]).tobytes()
            if len(self.young) >= _KNOWN:
                self.young, self.old = {}, self.young
            self.young[part] = found
        return found

    @staticmethod
    def parts(text: str) -> list[str]:
        pairs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        if _OTHER_BLANK.search(text) or pairs and (text[-2:].isspace() or _LONG_BLANK.search(text)):
            return _CUT.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        numbers = _Numbers()
        codes = [np.array(list(map(numbers.__getitem__, self.parts(text))), np.int64) for text in texts]
        ids = list(map(self.ids_of, numbers))
        length = np.array(list(map(len, ids)), np.int64) // 4
        begin = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(ids), np.uint32)
        for code in codes:
            size = length[code]
            ends = np.cumsum(size)
            yield flat[np.repeat(begin[code] - (ends - size), size) + np.arange(int(size.sum()))]


@functools.lru_cache(1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = END_ID, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Pieces of all texts: doc_id, piece, start, length, ids_crc32, ids (null unless with_ids), part and nth.

    part and nth name the task that made a piece and its number among that task's pieces of the same length: save the
    result before they are used, since a task that runs again may number other rows.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        coder, part = tokenizer(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in slices(whole):
                rows: list[list] = [[] for _ in range(6)]
                for i, ids in enumerate(coder.encode(texts_of(batch.column("text")))):
                    ids = np.append(ids, np.uint32(end_id))
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for column, value in zip(rows, (i, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), ids[a:b] if with_ids else None), strict=True):
                            column.append(value)
                length = np.array(rows[3], np.int64)
                order = np.argsort(length, kind="stable")
                at = np.searchsorted(length[order], length[order], "left")
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - at + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                made = [pa.array(x, pa.int64()) for x in rows[1:5]]
                ids = pa.array([None if x is None else x.astype(np.int32) for x in rows[5]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), made[0].cast(pa.int32()), *made[1:], ids, pa.array(np.full(len(nth), part), pa.int64()), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>, part long, nth long")


@dataclass
class Plan:
    """Lines (lengths of one sequence, long to short; number of such sequences), made from the counts of lengths."""

    capacity: int
    left: np.ndarray
    lines: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.held = self.left > 0
        at = np.flatnonzero(self.held)
        self.pairs = np.zeros(2 * self.capacity + 1, np.int64)
        for k, x in enumerate(at):
            self.pairs[x + at[k:]] += 1

    def _use(self, lengths: tuple[int, ...]) -> None:
        """Add as many such sequences as the counts allow."""
        need = Counter(lengths)
        times = min(int(self.left[x]) // k for x, k in need.items())
        self.lines.append((tuple(sorted(lengths, reverse=True)), times))
        for x, k in need.items():
            self.left[x] -= k * times
            if not self.left[x]:
                self.pairs[x + np.flatnonzero(self.held)] -= 1
                self.held[x] = False

    def _there(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= k for x, k in Counter(lengths).items())

    def _two(self, base: tuple[int, ...], total: int):
        """Two lengths of this sum that are available beside base, the longest first."""
        if total < 2 or not self.pairs[total]:
            return None
        low = np.arange(max(1, total - self.capacity), total // 2 + 1)
        for b in low[self.held[low] & self.held[total - low]].tolist():
            if self._there((*base, total - b, b)):
                return total - b, b
        return None

    def _exact(self, base: tuple[int, ...], gap: int):
        """At most three lengths that fill the gap exactly and are available beside base; None if there are none."""
        if gap == 0:
            return ()
        if self._there((*base, gap)):
            return (gap,)
        if pair := self._two(base, gap):
            return pair
        first = np.arange(gap - 2, 0, -1)
        for a in first[self.held[first] & (self.pairs[gap - first] > 0)].tolist():
            if self._there((*base, a)) and (pair := self._two((*base, a), gap - a)):
                return (a, *pair)
        return None

    def make(self) -> Plan:
        for length in np.flatnonzero(self.held)[::-1].tolist():
            while self.left[length] and (found := self._exact((length,), self.capacity - length)) is not None:
                self._use((length, *found))
        while self.held.any():
            base, gap = (), self.capacity
            while gap and (found := self._exact(base, gap) if base else None) is None:
                fits = np.flatnonzero(self.held[: gap + 1])[::-1].tolist()
                longest = next((x for x in fits if self.left[x] > base.count(x)), None)
                if longest is None:
                    found = ()
                    break
                base, gap = (*base, longest), gap - longest
            self._use((*base, *(found or ())))
        return self


def segments(lines: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Per length and line, in order: the first rank it takes, how many sequences, the first one's id, the place there."""
    rows, taken, sequence = [], Counter(), 0
    for lengths, times in lines:
        offset = 0
        for length, k in Counter(lengths).items():
            rows.append((length, taken[length], times, sequence, offset))
            taken[length] += k * times
            offset += k * length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "sequence", "offset"), table.T.copy(), strict=True))


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    first = np.searchsorted(table["length"], length, "left")
    last = np.searchsorted(table["length"], length, "right") - 1
    while (wide := first < last).any():  # the last line of the length that begins at or before the rank
        middle = (first + last + 1) // 2
        at_most = table["rank"][middle] <= rank
        first, last = np.where(wide & at_most, middle, first), np.where(wide & ~at_most, middle - 1, last)
    within = rank - table["rank"][first]
    times = table["times"][first]
    return table["sequence"][first] + within % times, table["offset"][first] + within // times * length


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = END_ID, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (null unless with_ids), sequence_id, offset.

    Null and empty texts are one piece that holds the end id. Repeated rows and rows that share a doc_id are packed
    each; other columns of docs are left out; an empty table gives no row. Texts of any length are encoded whole. All
    pieces of one length may be one document repeated: ranks come from sums of tasks' counts, so nothing gathers them.
    `sequences` joins the pieces' ids. The vocabulary file must be on every executor.
    """
    spark = docs.sparkSession
    made = saved(pieces(docs, capacity, end_id, vocabulary, with_ids), "pieces", keep=True)
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    with scratch(spark):
        counts = saved(counts, "lengths")
        left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # one row per length, capacity at most
            left[length] = n
        earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        begins = saved(counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin")), "begins", keep=True)
    table = segments(Plan(capacity, left).make().lines)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank = batch.column("begin").to_numpy() + batch.column("nth").to_numpy()
        sequence, offset = place(table, batch.column("length").to_numpy(), rank)
        kept = [n for n in batch.schema.names if n not in ("part", "nth", "begin")]
        return pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    joined = made.join(begins, ["part", "length"]).select(*made.columns, "begin")
    fields = ", ".join(f"`{n}` {t}" for n, t in joined.dtypes if n not in ("part", "nth", "begin"))
    return map_arrow(joined, run, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, length, ids (array<int>), and doc_ids of the pieces in order."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))  # a sequence holds `capacity` pieces at most
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), held.alias("held"))
    return grouped.select("sequence_id", "length", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
