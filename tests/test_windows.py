"""Windows against a segment-by-segment merge, context against all pairs, mentions against one regular expression per name."""

import random
import re
import time

import pytest

from callbook.functions.text import detector
from callbook.operators.windows import around_clusters, candidate_windows, consolidate

SEGMENT = "document_id long, segment_id long, start_seconds double, end_seconds double, text string"


def merged(rows, seconds, chars, gap):
    """One document's windows: (start, end, text, ids)."""
    out, held = [], []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        text = re.sub(r"\s+", " ", r[4] or "").strip()
        if not text:
            continue
        if held and (r[3] - held[0][2] > seconds or sum(len(h[4]) + 1 for h in held) + len(text) > chars or r[2] - held[-1][3] > gap):
            out.append(held)
            held = []
        held.append((*r[:4], text))
    if held:
        out.append(held)
    return [(h[0][2], h[-1][3], " ".join(x[4] for x in h), [x[1] for x in h]) for h in out]


def talk(doc, n, seed):
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0.0, 0.25, 1.0, 2.0, 9.0]) if rng.random() < 0.3 else 0.5
        rows.append((doc, i, t, t + rng.choice([0.5, 1.0, 2.0, 30.0 if rng.random() < 0.1 else 1.5]), rng.choice(["a", "bb cc", " ", "word " * rng.randrange(1, 30), None, "x\ny"])))
    return rows


@pytest.mark.parametrize(("seconds", "chars", "gap", "block"), [(25.0, 1500, 3.0, 4096), (8.0, 60, 1.5, 32), (1000.0, 40, 1000.0, 22)])
def test_windows_equal_the_merge(spark, seconds, chars, gap, block):
    docs = {d: talk(d, n, d) for d, n in ((1, 1200), (2, 1), (3, 40), (4, 333))}
    df = spark.createDataFrame([r for x in docs.values() for r in x], SEGMENT).repartition(6)
    got = {}
    for r in consolidate(df, seconds, chars, gap, block).collect():
        got.setdefault(r.document_id, []).append(r)
    for d, rows in docs.items():
        want = merged(rows, seconds, chars, gap)
        found = sorted(got.get(d, []), key=lambda r: r.window_no)
        assert [r.window_no for r in found] == list(range(len(want)))
        assert [(r.start_seconds, r.end_seconds, r.text, r.segment_ids) for r in found] == want


def test_context_sweep_equals_all_pairs(spark):
    rng = random.Random(4)
    windows, groups = [], []
    for d in range(12):
        t = 0.0
        for i in range(rng.randrange(1, 40)):
            windows.append((d, i, t, t + rng.randrange(1, 20)))
            t = windows[-1][3] + rng.choice([0, 1, 30, 200])
        t = rng.randrange(50)
        for c in range(1, rng.randrange(1, 6)):
            groups.append((d, c, float(t), float(t + rng.randrange(0, 90))))
            t = groups[-1][3] + rng.randrange(61, 150)
    w = spark.createDataFrame(windows, "document_id long, window_no int, start_seconds double, end_seconds double")
    g = spark.createDataFrame(groups, "document_id long, cluster long, `from` double, `to` double")
    got = sorted((r.document_id, r.window_no, r.cluster) for r in around_clusters(w, g, 90.0).collect())
    assert got == sorted((d, i, c) for d, i, s, e in windows for k, c, lo, hi in groups if d == k and e >= lo - 90 and s <= hi + 90)


def test_candidates_of_a_talk(spark):
    rows = [(7, 0, 0.0, 4.0, "hello"), (7, 1, 30.0, 34.0, "Buying $NVDA above 100"), (7, 2, 60.0, 64.0, "buying $NVDA and AMD"), (7, 3, 130.0, 134.0, "so"), (7, 4, 300.0, 304.0, "nothing"), (7, 5, 400.0, 404.0, "short AMD now, stop 90")]
    got = candidate_windows(spark.createDataFrame(rows, SEGMENT), detector({"NVDA": "Nvidia", "AMD": ""})).orderBy("cluster").collect()
    first, second = got
    assert (first["from"], first["to"], first.tickers, first.first_segment_ids) == (30.0, 64.0, ["AMD", "NVDA"], [1])
    assert [(m.ticker, m.start) for m in first.mentions] == [("NVDA", 7), ("AMD", 17)]  # the second $NVDA stands at the same offset
    assert first.context == "hello Buying $NVDA above 100 buying $NVDA and AMD so" and first.context_segment_ids == [0, 1, 2, 3] and (first.context_start, first.context_end) == (0.0, 134.0)
    assert second.context == "short AMD now, stop 90" and second.context_segment_ids == [5] and second.tickers == ["AMD"]


def by_name(text, universe, aliases):
    """Company names and aliases by one expression each, in order."""
    low, seen, out = text.lower(), set(), []
    listed = {}
    for t, n in universe.items():
        if n and " " not in n:
            listed.setdefault(n.lower(), t)
    for method, table in (("company_name", listed), ("asr_map", {p.lower(): t for p, t in aliases.items()})):
        for name, ticker in table.items():
            for m in re.finditer(rf"\b{re.escape(name)}\b", low):
                if (ticker, m.start()) not in seen:
                    seen.add((ticker, m.start()))
                    out.append((m.start(), m.end(), ticker, method))
    return sorted(out)


def test_automaton_equals_one_expression_per_name(spark):
    rng = random.Random(8)
    stems = ["aa", "ab", "aa aa", "a-b", "b's", "été", "x_y", "c++", "ab aa"]
    universe = {f"q{i}": s for i, s in enumerate(stems)}
    aliases = {"aa ab aa": "q0", "b aa": "zz", "aa": "q9", "c++ ab": "q1"}
    texts = ["".join(rng.choice(["aa", "ab", "b", "a", " ", " ", "-", "'s", "é", "été", "_", "x_y", "c++", ".", "AB"]) for _ in range(rng.randrange(30))) for _ in range(500)] + [None, ""]
    detect = detector(universe, aliases)
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", detect("t").alias("m")).collect():
        got = [(m.start, m.end, m.ticker, m.method) for m in r.m if m.method in ("company_name", "asr_map")]
        assert sorted(got) == by_name(r.t or "", universe, aliases), r.t


def test_time_does_not_follow_the_number_of_names(spark):
    rng = random.Random(9)
    names = list({"".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(60_000)})[:50_000]
    texts = [" ".join(rng.choice(names) if rng.random() < 0.05 else "word" for _ in range(200)) for _ in range(400)]
    took = {}
    for size in (500, 50_000):
        find = detector({f"N{i}": n for i, n in enumerate(names[:size])}).func
        import pandas as pd

        find(pd.Series(texts[:1]))  # builds the automaton
        t = time.process_time()
        found = find(pd.Series(texts))
        took[size] = time.process_time() - t
        listed = set(names[:size])
        assert [sum(w in listed for w in t.split()) for t in texts] == [len(m) for m in found]
    assert took[50_000] < 6 * took[500] + 0.5
