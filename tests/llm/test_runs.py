"""Periodic runs against a brute-force search, known words, edge cases and the query's digests."""

from __future__ import annotations

import hashlib
import random

import pytest

from callbook.llm.runs import SuffixTree, collapsed, digest, find, find_runs, looped, query, runs_of

SCHEMA = "doc_id long, text string"


def brute(words, least):
    """Every maximal repetition with its smallest period, by trying all periods in rising order."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        a = 0
        while a + q < n:
            if words[a] != words[a + q]:
                a += 1
                continue
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            if b - a >= q and b - a + q >= least:
                inner = any(s <= a and b + q <= s + m for s, m in found if found[s, m] < q)
                if not inner:
                    found.setdefault((a, b - a + q), q)
            a = b + 1
    return sorted((s, q, m) for (s, m), q in found.items())


def rows(runs):
    return [(int(r["start"]), int(r["period"]), int(r["length"])) for r in runs]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_against_brute_force(least):
    rng = random.Random(least)
    texts = [fibonacci(80), "a" * 40, "ab" * 20 + "a", "aab" * 9 + "aabaa", "".join("ab"[bin(i).count("1") % 2] for i in range(64))]
    for _ in range(400):
        texts.append("".join(rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(60))))
        root = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12)))
        texts.append("xyz" + (root * 9)[: rng.randrange(70)] + "".join(rng.choice("abx") for _ in range(9)) + (root * 3)[:20])
    for text in texts:
        words = [c.encode() for c in text]
        want = brute(words, least)
        assert rows(find(words, least)) == want, text
        assert rows(runs_of([ord(c) for c in text], least)) == want, text


def test_suffix_tree_agrees():
    rng = random.Random(2)
    for _ in range(60):
        text = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        tree = SuffixTree(text)
        assert tree.order.tolist() == sorted(range(len(text) + 1), key=lambda i: text[i:])
        for i in range(len(text) + 1):
            for j in range(len(text) + 1):
                if i != j:
                    k = 0
                    while max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                        k += 1
                    assert tree.agree(*map(lambda x: __import__("numpy").array([x]), (i, j)))[0] == k


def plain_collapse(words, runs):
    drop = {k for s, q, m in runs for k in range(s + q, s + m)}
    return [w for k, w in enumerate(words) if k not in drop]


def plain_words(text):
    return "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ")


def test_edge_cases(spark):
    texts = [None, "", " \t\n", "one", "a b " * 10, "x " * 11, "x " * 12, "c\x0bd\x0ce\x1cf g " * 7, "la " * 20_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(4, texts[4])] * 2 + [(None, "u v " * 6)], SCHEMA)
    clash = docs.selectExpr("*", "1 as runs", "'x' as n_words", "2 as start")
    got = find_runs(clash.repartition(3))
    assert got.columns == ["doc_id", "text", "start", "n_words", "runs", "collapsed"]
    for r in got.collect():
        words = [w for w in plain_words(r.text) if w]
        want = brute(words, 12) if len(words) < 1000 else [(0, 1, 20_000)]
        assert [(x.start, x.period, x.length) for x in r.runs] == want
        assert r.collapsed == " ".join(plain_collapse(words, want)) and r.n_words == len(words)
    by = {r.doc_id: r for r in digest(find_runs(docs)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (by[0].n_runs, by[0].start, by[0].length, by[0].period, by[0].exponent_milli, by[0].runs_sha256, by[0].collapsed_sha256) == (0, None, None, None, None, empty, empty)
    assert (by[4].start, by[4].length, by[4].period, by[4].exponent_milli) == (0, 20, 2, 10_000)
    assert by[5].n_runs == 0 and by[6].n_runs == 1 and by[7].n_runs == 1
    assert digest(find_runs(spark.createDataFrame([], SCHEMA))).count() == 0


def test_ties_and_overlaps():
    words = ("a b c " * 5 + "c b a " * 5 + "z " + "a b c " * 5).encode().split()
    runs = find(words)
    assert rows(runs) == brute(words, 12)
    assert collapsed(words, runs) == plain_collapse(words, rows(runs))


def test_query(spark, sf_dir):
    found = {r.doc_id: r for r in query(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    some = 0
    for d in docs:
        words = looped(d.doc_id, [w.encode() for w in plain_words(d.text) if w])
        if len(words) > 1500:
            continue
        runs, r = brute(words, 12), found[d.doc_id]
        some += bool(runs)
        lines = "".join(f"{s},{m},{q}\n" for s, q, m in runs)
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(plain_collapse(words, runs))).hexdigest()
        if runs:
            s, q, m = min(runs, key=lambda x: (-x[2], x[0], x[1]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, m, q, 1000 * m // q)
        else:
            assert r.start is r.length is r.period is r.exponent_milli is None
    assert some
