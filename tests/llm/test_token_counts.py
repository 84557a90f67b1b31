"""Token counts: against a byte-by-byte count, and edge cases."""

import random

import numpy as np
import pytest

from callbook.llm import token_counts as tc


def brute(ends, spans, rule):
    counts, crossing, outside, begin = [0.0] * len(spans), 0, 0, 0
    for end in ends:
        shared = [max(0, min(end, b) - max(begin, a)) for a, b in spans]
        hit = [i for i, n in enumerate(shared) if n]
        crossing += len(hit) > 1
        if rule == "first":
            home = [i for i, (a, b) in enumerate(spans) if a <= begin < b]
            outside += not home
            for i in home:
                counts[i] += 1
        elif not hit:
            outside += 1
        elif rule == "most":
            counts[max(hit, key=lambda i: (shared[i], -i))] += 1
        else:
            for i in hit:
                counts[i] += shared[i] / sum(shared)
        begin = end
    return counts, crossing, outside


@pytest.mark.parametrize("rule", tc.RULES)
def test_allocation_matches_brute_force(rule):
    rng = random.Random(3)
    for _ in range(300):
        ends = np.cumsum([rng.randrange(1, 6) for _ in range(rng.randrange(0, 20))]).astype(np.int64)
        cuts = sorted(rng.sample(range(0, 70), 2 * rng.randrange(0, 6)))
        spans = list(zip(cuts[::2], cuts[1::2], strict=True))
        lo, hi = (np.array([s[i] for s in spans], np.int64) for i in (0, 1))
        got, want = tc.allocate(ends, lo, hi, rule), brute(ends, spans, rule)
        assert np.allclose(got[0], want[0]) and got[1:] == want[1:], (ends, spans)


def test_lines_and_columns(spark):
    rows = [(1, "one two\nthree\n\nfour é🙂 five", "x"), (2, None, "x"), (3, "", "x"), (4, "\n", "x"), (5, "long " * 40_000, "x"), (1, "again", "y"), (None, "no id", None)]
    got = tc.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), rule="most").collect()
    assert len(got) == len(rows)
    for r in got:
        assert sum(r["section_tokens"]) == r["n_tokens"] and r["n_outside"] == 0
        assert len(r["section_tokens"]) == len((r["text"] or "").splitlines())
    assert tc.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_sections(spark):
    df = spark.sql("select 1 doc_id, 'é the cat sat' text, array(named_struct('start', 0, 'end', 2), named_struct('start', 6, 'end', 900)) s")
    r = tc.count_tokens(df, rule="first", sections="s").first()
    assert r["n_tokens"] == sum(r["section_tokens"]) + r["n_outside"] and r["section_tokens"] == [2, 1] and r["n_outside"] == 1


def test_sections_in_any_order_overlapping_or_null(spark):
    spans = [(4, 8), (0, 3), None, (None, 5), (2, None), (5, 5), (9, 6), (1, 6), (-3, 0), (8, 99)]
    text = "abcd" * 3
    rows = [(1, text, spans, 0), (2, text, [], 0), (3, text, None, 0), (4, None, spans, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<start:int,end:int>>, n_tokens int")
    got = {r["doc_id"]: r for r in tc.count_tokens(df, rule="split", sections="s").collect()}
    owner = {}
    for i in sorted((i for i, s in enumerate(spans) if s and None not in s), key=lambda i: (max(0, spans[i][0]), i)):
        for c in range(max(0, spans[i][0]), min(len(text), spans[i][1])):
            owner.setdefault(c, i)
    encoding, size = tc._encoder(tc.VOCABULARY)
    want, begin = [0.0] * len(spans), 0
    for token in encoding.encode_ordinary(text):
        hit = [owner[c] for c in range(begin, begin + size[token]) if c in owner]
        for i in hit:
            want[i] += 1 / len(hit)
        begin += size[token]
    assert np.allclose(got[1]["section_tokens"], want) and got[1]["section_tokens"][0] > 0
    assert got[2]["section_tokens"] == got[3]["section_tokens"] == [] and got[3]["n_outside"] == got[3]["n_tokens"]
    assert got[4]["section_tokens"] == [0.0] * len(spans)


def test_every_document(spark, sf_dir):
    out = tc.query(spark, sf_dir).collect()
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(sum(r["section_tokens"]) == r["n_tokens"] for r in out)


def test_long_runs_of_blanks():
    encoding, _ = tc._encoder(tc.VOCABULARY)
    for text in ("x" + " " * 12_000 + "y", " " * 12_000, "x" + "\n" * 12_000, "x" + " \n" * 8_000 + "word" + "\t" * 11_000 + " z", "x" + "\x1c" * 12_000 + "y", "a" + "　" * 10_001 + "b " * 3 + " " * 10_000):
        assert tc.token_ids(encoding, text) == encoding.encode_ordinary(text)
    for blank in " \n":
        ids = tc.token_ids(encoding, "x" + blank * 5_000_000 + "y")
        assert encoding.decode(ids) == "x" + blank * 5_000_000 + "y"
