"""Line dedup: against a plain version, batches and compaction, edge cases."""

import hashlib
import random

import pytest

from callbook.llm import line_dedup


def plain(rows):
    """{(doc_id, text): (n_lines, n_dropped, kept)} for rows with ids."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for d, t in rows:
        if d is not None:
            for k in {key(x) for x in (t or "").split("\n")}:
                holders.setdefault(k, set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == d]
        out[d, t] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 3), (9, 2)])
def test_matches_plain(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"line number {k} of the pool" for k in range(60)] + ["  Line Number 3 OF the pool\t", "short", "", " ", "ÉÉÉÉÉÉÉÉÉÉ long", "éééééééééé long", "\x0bline number 5 of the pool\r"]
    hot = "this line is in a third of all documents"
    rows = [(rng.randrange(-20, 500), "\n".join(rng.choice(pool) if rng.random() > 0.3 else hot for _ in range(rng.randrange(0, 12)))) for _ in range(300)]
    rows = list({d: (d, t) for d, t in rows}.values()) + [(900, None), (901, ""), (902, "\n\n"), (None, hot), (903, hot), (904, "x" * 100_000 + "\n" + hot), (905, (hot + "\n") * 3000)]
    rows += [rows[0], (rows[1][0], "another text of a known id\n" + hot)]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, n_lines string")
    got = line_dedup.dedup_lines(df, batches=batches, fanout=fanout).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == want[r["doc_id"], r["text"]]


def test_first_document_keeps_its_repeats(spark):
    df = spark.createDataFrame([(1, "the same line\nthe same line"), (2, "THE SAME LINE \nother")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(df).collect()} == {1: "the same line\nthe same line", 2: "other"}


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {d: v for (d, _), v in plain(rows).items()}
    for r in line_dedup.query(spark, sf_dir).collect():
        n, dropped, kept = want[r["doc_id"]]
        assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (n, dropped, hashlib.sha256(kept.encode()).hexdigest())
