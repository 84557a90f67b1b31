"""Jaccard join: against all pairs, with groups of copies, hot passages and edge cases."""

import random
import re

import pytest

from callbook.llm import jaccard


def brute(rows, similarity=0.8, width=5):
    """{row number: (class, links)} from all pairs."""
    sets = []
    for _, text in rows:
        w = [x.lower() for x in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    n, up = len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and min(len(a), len(b)) >= similarity * max(len(a), len(b)):
                both = len(a & b)
                if both >= similarity * (len(a) + len(b) - both) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[root(i)] = min(d, first.get(root(i), d))
    return sorted(((d, first.get(root(i)) if d is not None else None, links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string")
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.link_classes(df, **options).collect()), key=repr)


def edited(rng, words, vocabulary, share):
    return [w if rng.random() > share else rng.choice(vocabulary) for w in words]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(500)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, passage, big = [], prose(30), prose(120)
    for _ in range(150):
        base = prose(rng.randrange(3, 120)) + (passage if rng.random() < 0.5 else [])
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            texts.append(edited(rng, base, vocabulary, rng.choice([0, 0.01, 0.03])))
    texts += [edited(rng, big, vocabulary, 0.012) for _ in range(180)]
    texts = [" ".join(t) for t in texts] + [None, "", "!!", "one", "one", "One.", prose(4)[0] * 3]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(d * 3, texts[k]) for d, k in enumerate(order)] + [(None, texts[0]), (9, texts[order[3]]), (12, "other text of a known id")]


def test_finds_what_all_pairs_find(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_large_buckets_in_tiles(spark, rows):
    assert run(spark, rows, tile=40, limit=8) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_long_text(spark):
    rng = random.Random(2)
    words = [str(rng.randrange(9000)) for _ in range(40_000)]
    assert run(spark, [(1, " ".join(words)), (2, " ".join(words[:39_000])), (3, "x")]) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_keep_one(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(df).collect()]
    classes = [c for _, c, _ in brute(rows)]
    texts = {d: t for d, t in rows if d != 12}
    alone = [(d, t) for d, t in rows if d is None or not re.search(r"[A-Za-z0-9\u0080-\U0010ffff]", t or "")]
    # document 12 has two texts: the one without a like stays besides what its classes keep
    wanted = [(c, texts[c]) for c in set(classes) - {None, 12}] + [x for x in rows if x[0] == 12 and (x[1] == "other text of a known id" or 12 in classes)]
    assert sorted(map(repr, kept)) == sorted(map(repr, set(wanted) | set(alone)))


def test_different_texts_of_one_id_stay(spark):
    prose = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(5, prose[0], 1), (5, prose[1], 2), (5, prose[0], 3), (6, prose[1] + " z", 4), (4, prose[2], 5), (5, prose[2], 6), (7, None, 7), (7, None, 8), (None, prose[0], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class long")
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(df).collect()), key=repr)
    assert got == sorted([(5, prose[0]), (5, prose[1]), (4, prose[2]), (7, None), (7, None), (None, prose[0])], key=repr)


def test_sets_with_one_hash_stay_apart(spark, monkeypatch, rows):
    """Half of the sets get the first hash of another one; the second hash tells them apart."""
    named = jaccard._named
    monkeypatch.setattr(jaccard, "_named", lambda s: (named(s)[0] % 40, named(s)[1]))
    some = rows[:150]
    assert run(spark, some) == brute(some)
