"""Decontamination: alignment against a plain Smith-Waterman, planted copies, edge cases."""

import random

import numpy as np

from callbook.llm import decontaminate as dc


def plain(a, b):
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (dc.MATCH if x == y else dc.MISMATCH), above[j + 1] + dc.GAP, row[j] + dc.GAP))
        best, above = max(best, *row), row
    return best / (dc.MATCH * len(a))


def test_alignment_matches_plain_smith_waterman():
    rng = random.Random(4)
    a = [np.array([rng.randrange(5, 12) for _ in range(rng.randrange(1, 15))], np.uint64) for _ in range(200)]
    b = [np.array([rng.randrange(5, 12) for _ in range(rng.randrange(1, 30))], np.uint64) for _ in range(200)]
    got, _ = dc.align(a, b)
    assert np.allclose(got, [plain(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)])


def test_planted_copies(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(40) for _ in range(20)]
    rows, leaks = [], set()
    for d in range(300):
        text = prose(rng.randrange(0, 200))
        if d % 3 == 0:
            k = 0 if d % 2 else rng.randrange(20)  # one item is in a sixth of all documents
            copy = [w if rng.random() > (d % 4) * 0.08 else rng.choice(vocabulary) for w in items[k]]
            if d % 5 == 0:
                copy.insert(10, "inserted")
            cut = rng.randrange(len(text) + 1)
            text = text[:cut] + copy + text[cut:]
            leaks.add((d, k))
        rows.append((d, " ".join(text).upper() if d % 7 == 0 else " ".join(text), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, " ".join(prose(30_000)), "x"), (None, " ".join(items[3]), "x"), (3, rows[3][1], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, "of the"), (52, "!?"), (None, "x " * 20)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect()}
    assert got == leaks | {(None, 3)}
    # slices of a few items find the same
    assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench, slice_words=200).collect()} == got
    kept = {r["doc_id"] for r in dc.decontaminate(docs, bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in got}
    assert dc.contaminated(docs.limit(0), bench).count() == 0 and dc.contaminated(docs, bench.limit(0)).count() == 0


def test_partial_copies_are_found_however_many(spark):
    rng = random.Random(12)
    item = [f"i{k}" for k in range(40)]
    for n in (10, 60):
        rows = [(d, " ".join([f"w{rng.randrange(10**6)}" for _ in range(20)] + item[10:] + [f"w{rng.randrange(10**6)}" for _ in range(20)])) for d in range(n)]
        rows += [(1000 + d, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for d in range(20)]
        got = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
        assert sorted((r["doc_id"], r["item_id"], r["score"], r["word_end"]) for r in got) == [(d, 7, 0.75, 50) for d in range(n)]


def test_seeds_in_small_parts_give_the_same(monkeypatch):
    rng = random.Random(3)
    items = dc.Items(list(range(9)), [np.array([rng.randrange(6) for _ in range(12)], np.uint64) for _ in range(9)], 3)
    words, begins = np.array([rng.randrange(6) for _ in range(400)], np.uint64), np.array([0, 0, 50, 52, 300, 400])
    whole = [np.concatenate(x) for x in zip(*dc._windows(words, begins, items), strict=True)]
    monkeypatch.setattr(dc, "_SEEDS", 1)
    parts = list(dc._windows(words, begins, items))
    assert len(parts) == 3 and all(np.array_equal(x, np.concatenate(y)) for x, y in zip(whole, zip(*parts, strict=True), strict=True))


def test_short_items_count_as_a_whole(spark):
    rows = [(1, "so alpha beta gamma ends"), (2, "alpha beta delta gamma"), (3, "Yes!"), (4, "yes it is"), (5, "alpha beta"), (6, "one two three four five six seven and more"), (7, "one two three four five six eight")]
    bench = [(1, "alpha, beta; gamma"), (2, "yes"), (3, "alpha beta"), (4, "one two three four five six seven"), (5, "!!"), (2, "no")]
    got = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["score"], r["word_end"]) for r in got) == [(1, 1, 1.0, 4), (3, 2, 1.0, 1), (5, 3, 1.0, 2), (6, 4, 1.0, 7)]


def test_against_alignment_of_all_pairs(spark):
    """Every pair that shares a run of three words, aligned over the whole text, is found; no other is."""
    rng = random.Random(15)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(9, 30))] for _ in range(12)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))] for _ in range(60)]
    for t in texts[::3]:
        item = rng.choice(items)
        t[5:5] = [w if rng.random() > 0.2 else rng.choice(vocabulary) for w in item]
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = {(d, k) for d, t in enumerate(texts) for k, i in enumerate(items) if grams(t) & grams(i) and plain(i, t) >= 0.45}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench, threshold=0.45).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 20
