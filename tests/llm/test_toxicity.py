"""Toxicity: scores against a plain sum of weights, held-out accuracy, edge cases."""

import random

import numpy as np

from callbook.llm import toxicity


def planted(n, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    bad = ["xzknave", "qwoaf", "vilezz"]
    rows = []
    for d in range(n):
        words = [word() for _ in range(rng.randrange(10, 120))]
        y = int(rng.random() < 0.3)
        for _ in range(y * (1 + len(words) // 25)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((d, " ".join(words), y))
    return rows


def test_learns_planted_words(spark):
    rows = planted(500)
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    fresh = planted(200, seed=77)
    s = model.score([t for _, t, _ in fresh])
    y = np.array([y for *_, y in fresh])
    assert (s[y == 1] >= 0.7).mean() > 0.95 and (s[y == 0] >= 0.7).mean() < 0.02


def test_score_is_the_sum_over_own_ngrams():
    rng = np.random.default_rng(1)
    model = toxicity.ToxicityModel(rng.normal(size=1 << toxicity.BITS).astype(np.float32), 0.3)
    texts = ["hello there", "", "a", "naïve Ünïcode 🙂 text", "x" * 3000]
    for text, got in zip(texts, model.score(texts), strict=True):
        grams, begins = toxicity._ngrams([text])
        own = toxicity._grams_of(grams, 0, int(begins[1]))
        z = model.weights[own].astype(float).sum() / (len(own) / 1000 + toxicity._SMOOTH) + model.bias
        assert abs(got - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-4


def test_edge_cases(spark):
    schema = "doc_id long, text string, predicted string"
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "y" * 300_000, "x"), (3, "again", None), (None, "no id", "x")], schema)
    train = "doc_id long, text string, label int"
    for rows in ([], [(1, "only clean", 0)], [(1, None, 0), (2, "", 1), (3, "x", None)]):
        got = toxicity.score(df, toxicity.learn(spark.createDataFrame(rows, train))).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert toxicity.score(spark.createDataFrame([], schema), toxicity.learn(spark.createDataFrame([], train))).count() == 0


def test_training_rows_leave_the_held_out_third(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.training_rows(docs, labels)
    assert rows.where(toxicity.held_out("doc_id")).count() == 0 and 0 < rows.count() < labels.count()


def test_query(spark, sf_dir):
    rows = toxicity.query(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and {type(r["score"]) for r in rows} == {float}


def test_every_significant_ngram_has_a_weight(spark):
    rng = random.Random(6)
    common = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(3000))
    rows = [(d, common + " xyzvwu" * (d < 45), 1) for d in range(60)] + [(100 + d, "".join(rng.choice("0123456789 ") for _ in range(200)), 0) for d in range(60)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    grams, begins = toxicity._ngrams(["xyzvwu"])
    assert np.count_nonzero(model.weights) > 4096 and (model.weights[toxicity._grams_of(grams, 0, int(begins[1]))] != 0).all()


def test_counts_match_a_plain_count(spark):
    """Documents of each class that hold each n-gram, by a hash computed one n-gram at a time."""
    rows = planted(60, seed=4)

    def buckets(text):
        x = [int(toxicity._CODE[c]) for c in np.frombuffer(f" {text.lower()} ".encode("utf-16-le"), np.uint16)]
        held = set()
        for n in toxicity.SIZES:
            for i in range(len(x) - n + 1):
                h = x[i]
                for c in x[i + 1 : i + n]:
                    h = (h * 0x9E3779B1 + c) % 2**32
                held.add((((h ^ (n * 0x5EBCA6B) % 2**32) * 0xC2B2AE35) % 2**32) >> (32 - toxicity.BITS))
        return held

    want = {}
    for _, text, y in rows:
        for b in buckets(text):
            want.setdefault(b, [0, 0])[y] += 1
    got = toxicity._counts(spark.createDataFrame(rows, "doc_id long, text string, label int")).collect()
    assert {r["bucket"]: [r["clean"], r["toxic"]] for r in got if r["bucket"] >= 0} == want
    assert [(r["clean"], r["toxic"]) for r in got if r["bucket"] < 0] == [(sum(y == 0 for *_, y in rows), sum(y for *_, y in rows))]


def test_held_out_quality_with_and_without_the_cuts(spark):
    """On labelled rows that were not learned from: the cuts lose nothing that the whole vocabulary would find."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    training = toxicity.training_rows(docs, labels)
    held = docs.where(toxicity.held_out("doc_id")).join(labels.select("doc_id", "toxic"), "doc_id").select("text", "toxic").collect()
    y = np.array([r["toxic"] for r in held])

    def quality(**cuts):
        s = toxicity.learn(training, **cuts).score([r["text"] or "" for r in held])
        above = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
        return above, ((s >= 0.7) == (y == 1)).mean()

    (area, right), (area_all, right_all) = quality(), quality(min_z=0.0, min_docs=1)
    print(f"held-out rows {len(y)}, toxic {y.sum()}: area {area:.4f}, right {right:.4f}; without cuts {area_all:.4f}, {right_all:.4f}")
    assert len(y) > 50 and 0 < y.sum() < len(y)
    assert area >= 0.9 and right >= 0.9 and area >= area_all - 0.02 and right >= right_all - 0.02
