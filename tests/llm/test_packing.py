"""Packing: ids against the tokenizer alone, plans against brute force, places and whole results."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from tokenizers import Tokenizer as Alone

from callbook.llm.packing import VOCABULARY, Plan, Tokenizer, pack, place, query, segments, sequences

SCHEMA = "doc_id long, text string"


def test_ids_are_the_tokenizers_own():
    rng = random.Random(3)
    letters = ["a", "Bc", "é", "ß", "漢字", "🙂", "é", "½", "²", "1", "42", "_", "'s", "'", "!?", "<|endoftext|>", "\0"]
    blanks = [" ", " ", " ", "  ", "   ", "\n", "\n\n", "\n\n\n", "\t", " \n", "\n ", "\r\n", " ", "　", " ", "\x1c", "\x85"]
    texts = ["".join(rng.choice(letters if rng.random() < 0.6 else blanks) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["", " ", "\n", "a ", " a", "x" + " " * 300_000 + "y", "ab" * 50_000, "it's we'll, o'clock 'tis", "word<|endoftext|> next"]
    alone = Alone.from_file(VOCABULARY)
    for text, ids in zip(texts, Tokenizer(VOCABULARY).encode(texts), strict=True):
        assert ids.tolist() == alone.encode(text, add_special_tokens=False).ids, text[:80]


def _exact(counts: Counter, length: int, capacity: int) -> bool:
    """Whether up to three of the other pieces fill the gap of a length."""
    rest = counts - Counter([length])
    if length == capacity:
        return True
    return any(sum(c) == capacity - length and not Counter(c) - rest for k in (1, 2, 3) for c in combinations_with_replacement(sorted(rest), k))


@pytest.mark.parametrize("seed", range(30))
def test_plan_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(4, 24))
    pieces = rng.integers(1, capacity + 1, int(rng.integers(1, 60)))
    counts = np.bincount(pieces, minlength=capacity + 1)
    lines = Plan(capacity, counts.copy()).make().lines
    used = Counter()
    for lengths, times in lines:
        assert times > 0 and sum(lengths) <= capacity
        for x in lengths:
            used[x] += times
    assert used == Counter(pieces.tolist())
    first = lines[0][0]
    if _exact(Counter(pieces.tolist()), int(pieces.max()), capacity):
        assert sum(first) == capacity and first[0] == pieces.max()
    bins = sum(t for _, t in lines)
    decreasing: list[int] = []
    for x in sorted(pieces.tolist(), reverse=True):
        room = [k for k, held in enumerate(decreasing) if held + x <= capacity]
        if room:
            decreasing[max(room, key=lambda k: decreasing[k])] += x
        else:
            decreasing.append(x)
    assert -(-int(pieces.sum()) // capacity) <= bins <= len(decreasing) + 1


def test_plan_of_very_many_pieces():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(rng.geometric(0.004, 200_000), 1024), minlength=1025) * 10**9
    lines = Plan(1024, counts.copy()).make().lines
    least = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert sum(t for _, t in lines) <= 1.01 * least and len(lines) < 5000


def test_places_fill_every_sequence():
    rng = np.random.default_rng(5)
    pieces = rng.integers(1, 33, 5000)
    table = segments(Plan(32, np.bincount(pieces, minlength=33)).make().lines)
    rank = np.empty(len(pieces), np.int64)
    for x in range(1, 33):
        rank[pieces == x] = np.arange((pieces == x).sum())
    sequence, offset = place(table, pieces, rank)
    _gapless(zip(sequence.tolist(), offset.tolist(), pieces.tolist(), strict=True), 32)


def _gapless(rows, capacity: int) -> int:
    held = defaultdict(list)
    for sequence, offset, length in rows:
        held[sequence].append((offset, length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "no id"), (3, "word " * 5000), (4, "x" + "\n" * 100_000)] + [(9, "same")] * 50
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as piece", "2 as part", "'x' as sequence_id")
    got = pack(docs.repartition(5), capacity=64, with_ids=True)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    found = got.collect()
    alone = Alone.from_file(VOCABULARY)
    want = Counter()
    for doc_id, text in rows:
        ids = [*alone.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in found) == want
    count = _gapless(((r.sequence_id, r.offset, r.length) for r in found), 64)
    joined = sequences(got).collect()
    assert len(joined) == count and all(len(r.ids) == r.length <= 64 for r in joined)
    assert sorted(i for r in joined for i in r.ids) == sorted(i for k, n in want.items() for i in k[-1] * n)
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf_dir):
    found = query(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    alone = Alone.from_file(VOCABULARY)
    held = defaultdict(list)
    for r in found:
        held[r.doc_id].append(r)
    assert held.keys() == texts.keys()
    for doc_id, rows in held.items():
        ids = np.array([*alone.encode(texts[doc_id], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(rows, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    count = _gapless(((r.sequence_id, r.offset, r.length) for r in found), 1024)
    assert count <= 1.02 * -(-sum(r.length for r in found) // 1024) + 1
