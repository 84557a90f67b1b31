"""SentencePiece n-best: against all segmentations, round trips, and edge cases."""

import random

import numpy as np
import pytest

from callbook.llm import pieces


@pytest.fixture(scope="module")
def v():
    return pieces.vocabulary(pieces.MODEL)


def everything(v, chunk):
    """All segmentations of a chunk as (score, ids)."""
    into = [v.edges(chunk, j) for j in range(len(chunk) + 1)]

    def upto(j):
        if j == 0:
            yield 0.0, ()
        for i, s, piece in into[j]:
            for t, ids in upto(i):
                yield t + s, ids + piece

    return sorted(upto(len(chunk)), key=lambda x: -x[0])


def test_a_star_gives_the_n_best(v):
    for chunk in ["▁the", "▁thtionble", "▁réeux", "▁a", "▁日x", "▁▁▁ab", "\n"]:
        want = everything(v, chunk)[:6]
        got = v.n_best(chunk, 6)
        assert np.allclose([b.score for b in got], [s for s, _ in want])
        assert len({b.ids for b in got}) == len(got)


def test_texts_against_all_segmentations(v):
    rng = random.Random(1)
    words = ["the", "on", "aé", "é", "th", "日", "", "x.", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    for text, (ids, ways, begins) in zip(texts, pieces.Encoder(pieces.MODEL, 4).encode(texts), strict=True):
        if not text:
            continue
        want = everything(v, pieces.SPACE + text.replace(" ", pieces.SPACE))[:4]
        assert np.allclose([w[0] for w in ways], [s for s, _ in want]), text
        lists = [tuple(pieces._changed(ids, begins, c)) for _, _, c in ways]
        assert len(set(lists)) == len(lists) and all(len(x) == w[1] for x, w in zip(lists, ways, strict=True))
        assert all(pieces.spell(np.array(x), v) == text.encode() for x in lists)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "ab" * 50_000, "a"), (4, "the cat 🙂 日本\n\n  sat ", "a"), (4, "the cat", None), (None, "  ", "b"), (6, "\n" * 1000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.decode(pieces.encode(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["decoded"] and r["decoded_text"] == (r["text"] or "")
        assert r["n_pieces"] == len(r["ids"]) and r["nbest"][0]["ids"] == r["ids"]
        scores = [w["score"] for w in r["nbest"]]
        assert scores == sorted(scores, reverse=True)
    assert [w["score"] for r in got if r["doc_id"] == 1 for w in r["nbest"]] == [0.0]
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_document_round_trips(spark, sf_dir):
    out = pieces.query(spark, sf_dir)
    assert out.where("decoded").count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_runs_of_one_letter(v):
    for chunk in ("a" * 12, pieces.SPACE * 9, "ab" * 6):
        want = sorted((score for score, _ in everything(v, chunk)), reverse=True)
        got = v.n_best(chunk, 9)
        assert [b.score for b in got] == pytest.approx(want[:9])
        assert len({b.ids for b in got}) == min(9, len(want))
    for chunk in ("a" * 100_000, pieces.SPACE * 50_000, "漢字" * 20_000):
        best = v.n_best(chunk, 4)
        assert pieces.spell(np.array(best[0].ids), v).decode() == chunk.replace(pieces.SPACE, " ").removeprefix(" ")
        assert all(a.score >= b.score - 1e-6 for a, b in zip(best, best[1:], strict=False))
