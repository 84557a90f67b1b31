"""LM scoring: a plain forward pass, gradients, normalisation, counts over all documents, and that real order beats shuffled order."""

import random

import numpy as np
import pyarrow as pa
import pytest

from callbook.llm import lm_score as lm


def plain_log_prob(model, counts, hashes):
    """A text's score, token by token."""
    w, net = model.words, model.network()
    ids, own = w.ids(hashes)
    total = 0.0
    for t, target in enumerate(ids.tolist()):
        h = np.zeros(net.embed.shape[2])
        for k, o in enumerate(lm.OFFSETS):
            h = h + net.embed[ids[t + o] if 0 <= t + o < len(ids) else w.pad, k]
        h = np.tanh(h)
        soft = lambda z: z - np.log(np.exp(z).sum())
        c = int(np.searchsorted(w.begins, target, "right")) - 1
        total += soft(h @ net.out + net.bias)[c]
        members = range(w.begins[c], w.begins[c + 1])
        total += soft(np.array([h @ net.word_out[m] + net.word_bias[m] for m in members]))[target - w.begins[c]]
        if not own[t]:
            total += np.log(counts.get(int(hashes[t]), 1) / w.mass[target])
    return total


@pytest.mark.parametrize("counted", [0, 300, 1 << 18])
def test_scores_match_a_plain_forward_pass(spark, sf_dir, monkeypatch, counted):
    monkeypatch.setattr(lm, "COUNTED", counted)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).persist()
    model = lm.learn(docs, vocabulary=min(150, counted), buckets=8, classes=6)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {-1: "words that nobody has written zzqx", -2: None}
    counts = {}
    for t in [t for d, t in texts.items() if d >= 0]:
        for x in lm.word_hashes(pa.array([t], pa.string()))[0].tolist():
            counts[x] = counts.get(x, 0) + 1
    shown = {d: t for d, t in texts.items() if len(t or "") < 3000}
    for r in lm.score(spark.createDataFrame(list(shown.items()) * 2, "doc_id long, text string"), model).collect():
        hashes, _ = lm.word_hashes(pa.array([r["text"]], pa.string()))
        assert r["n_tokens"] == len(hashes)
        assert np.isclose(r["log_prob"], plain_log_prob(model, counts, hashes), rtol=1e-4)


def test_probabilities_of_all_ids_sum_to_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    model = lm.learn(docs, vocabulary=100, buckets=8, classes=5)
    net, w = model.network(), model.words
    context = np.random.default_rng(2).integers(0, w.pad + 1, (4, 30))
    total = sum(np.exp(net.log_prob(context, np.full(30, k))) for k in range(w.pad))
    assert np.allclose(total, 1, atol=1e-4)


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 20, 400)
    ctx = lm._contexts(ids, np.array([0, 150, 150, 400]), 20)
    net = lm.Network(np.bincount(ids, minlength=20) + 1.0, np.array([0, 3, 9, 20]), 8)
    loss = lambda: -net.log_prob(ctx, ids).mean()
    before = loss()
    memory = [np.full_like(v, 1e-4) for v in net.values()]
    for _ in range(50):
        net.step(ids, ctx, 0, 400, memory, 0.05)
    assert loss() < before - 0.1


@pytest.mark.parametrize(("lo", "hi"), [(0, 60), (10, 45), (0, 20), (33, 60)])
def test_gradients_match_differences(lo, hi):
    """Of every parameter, over a slice of texts whose contexts reach beyond it."""
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 12, 60)
    ctx = lm._contexts(ids, np.array([0, 12, 40, 60]), 12)
    net = lm.Network(np.ones(12), np.array([0, 1, 5, 12]), 3)
    net.word_out += rng.normal(size=net.word_out.shape).astype(np.float32) * 0.3
    grads = [np.zeros(v.shape) for v in net.values()]

    def note(value, at, squares, grad, rate):
        grads[[id(v) for v in net.values()].index(id(value))][at] += grad

    net._move = note
    net.step(ids, ctx, lo, hi, [np.zeros_like(v) for v in net.values()], 1.0)
    for value, grad in zip(net.values(), grads, strict=True):
        for place in np.ndindex(value.shape):
            keep, e = value[place], 1e-2
            value[place] = keep + e
            up = -net.log_prob(ctx[:, lo:hi], ids[lo:hi]).mean()
            value[place] = keep - e
            down = -net.log_prob(ctx[:, lo:hi], ids[lo:hi]).mean()
            value[place] = keep
            assert np.isclose(grad[place], (up - down) / (2 * e), atol=3e-4), place


def test_layout_of_rows_changes_scores_little(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").persist()
    means = []
    for n in (1, 5):
        model = lm.learn(docs.repartition(n))
        means.append({r["doc_id"]: r["mean_log_prob"] for r in lm.score(docs, model).where("n_tokens >= 20").collect()})
    gap = [abs(means[0][d] - means[1][d]) for d in means[0]]
    assert np.mean(gap) < 0.1 * abs(np.mean(list(means[0].values())))


def test_contexts_stay_in_their_text():
    got = lm._contexts(np.array([1, 2, 3, 4, 5]), np.array([0, 3, 3, 5]), 9)
    assert got.tolist() == [[9, 9, 1, 9, 9], [9, 1, 2, 9, 4], [2, 3, 9, 5, 9], [3, 9, 9, 9, 9]]


def test_ids_classes_and_growth(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = lm.count_words(docs, 200, 16, 8)
    total = lm.word_counts(docs).agg({"n": "sum"}).first()[0]
    assert words.pad == 216 and words.mass.sum() == total + 16 and (np.diff(words.mass) <= 0).all()
    assert sorted(np.concatenate([words.top_ids, words.bucket_ids]).tolist()) == list(range(216)) and words.classes <= 8
    assert lm.count_words(docs).pad > lm.count_words(docs, 200).pad


def test_order_matters(spark):
    rng = random.Random(4)
    line = "the cat sat on the mat and then the dog ran to the big red barn with a small bone".split()
    texts = [" ".join(line[rng.randrange(4) :]) for _ in range(400)]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:50]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    model = lm.learn(docs, rounds=3)
    rows = [(i, t, 1) for i, t in enumerate(texts[:50])] + [(100 + i, t, 1) for i, t in enumerate(shuffled)] + [(900, None, 1), (901, "", 1), (902, "!?", 1), (903, "cat " * 100_000, 1), (None, "cat", 1)]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, log_prob long"), model).collect()}
    assert np.mean([got[i]["mean_log_prob"] for i in range(50)]) > np.mean([got[100 + i]["mean_log_prob"] for i in range(50)]) + 0.2
    for i in (900, 901, 902):
        assert (got[i]["n_tokens"], got[i]["log_prob"], got[i]["mean_log_prob"]) == (0, 0.0, None)
    assert got[903]["n_tokens"] == 100_000 and got[None]["n_tokens"] == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, lm.learn(docs)).count() == 0


def test_rare_words_keep_their_own_counts(spark):
    docs = spark.createDataFrame([(1, "the " * 50), (2, "cat " * 9 + "dog " * 3)], "doc_id long, text string")
    model = lm.learn(docs, vocabulary=1, buckets=1, classes=1, rounds=0)
    texts = ["the", "cat", "dog", "new", "dog cat dog the"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4])] * 2
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    want = {0: [50], 1: [9], 2: [3], 3: [1], 4: [3, 9, 3, 50]}
    assert len(got) == 7
    for r in got:
        assert np.isclose(r["log_prob"], sum(np.log(n / 63) for n in want[r["doc_id"]])) and r["n_tokens"] == len(want[r["doc_id"]])
