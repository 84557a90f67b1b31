"""Language ID: phrases against a plain parse, held-out accuracy, edge cases."""

import random

import numpy as np

from callbook.llm import langid


def plain_phrases(sample, text, block):
    """Greedy longest phrases of text that occur in sample, block by block."""
    fold = lambda s: "".join(c if c.isalpha() else " " for c in s.lower())
    sample, text, n = fold(sample), fold(text), 0
    for a in range(0, len(text), block):
        part, i = text[a : a + block], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in sample:
                j += 1
            i = max(j - 1, i + 1)
            n += 1
    return n


def test_phrases_match_plain_parse():
    rng = random.Random(6)
    samples = [("a", "".join(rng.choice("abcd ") for _ in range(400))), ("b", "".join(rng.choice("cdefé ") for _ in range(300)))]
    parser = langid.CrossParser(samples, block=32)
    texts = ["".join(rng.choice("abcdefé ßX.") for _ in range(rng.randrange(1, 150))) for _ in range(40)] + [""]
    got = parser.phrases(texts)
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == [plain_phrases(s, text, 32) for _, s in samples], text


def test_held_out_accuracy(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in langid.query(spark, sf_dir).collect()]
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and held and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the and of " * 40_000, "x"), (4, "the", None), (None, "the", "x")], "doc_id long, text string, score string")
    got = langid.identify(df, [("en", "the and of to in"), ("xx", "qqq zzz kkk")]).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert {r["lang_pred"] for r in langid.identify(df, []).collect()} == {"und"}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.sample_languages(empty) == [] and langid.identify(empty, [("en", "the")]).count() == 0
    assert langid.sample_languages(spark.createDataFrame([(1, "abc", None), (2, "12", "en"), (3, "abc", "fr")], "doc_id long, text string, lang string")) == [("fr", "abc")]


def test_many_languages_and_large_alphabets_are_learned_whole():
    rng = random.Random(8)
    # 60 languages over one alphabet with habits of their own, and two whose evidence is in rare letters of a large one
    pairs = [[rng.choice("abcdefghijklmnopqrst") + rng.choice("aeiou") for _ in range(14)] for _ in range(60)]
    write = lambda k, n: " ".join("".join(rng.choice(pairs[k]) for _ in range(3)) for _ in range(n))
    samples = [(f"l{k:02}", write(k, 3000)) for k in range(60)]
    letters = [chr(0x4E00 + k) for k in range(3000)]
    rng.shuffle(letters)
    lexicon = [["".join(rng.choices(letters[h * 1500 : h * 1500 + 1500], k=3)) for _ in range(400)] for h in (0, 1)]
    word = lambda half: "".join(rng.choices(lexicon[half], k=40))
    samples += [("za", "".join(word(0) for _ in range(60))), ("zb", "".join(word(1) for _ in range(60)))]
    parser = langid.CrossParser(samples)
    assert np.allclose(parser.log_size, [np.log2(len(text)) for _, text in samples])
    texts = [write(k, 60) for k in range(60)] + [word(0), word(1)]
    best, _ = parser.predict(texts)
    assert [parser.langs[b] for b in best] == [lang for lang, _ in samples]
    for text, row in zip(texts[-2:], parser.phrases(texts[-2:]), strict=True):
        assert row[-2:].tolist() == [plain_phrases(samples[j][1], text, 512) for j in (-2, -1)]


def test_whole_texts_are_learned(spark):
    long_ = "a" * 5000 + "qzx"
    got = langid.sample_languages(spark.createDataFrame([(1, long_, "en"), (2, "b", "en"), (2, "b", "en")], "doc_id long, text string, lang string"))
    assert sorted(got[0][1].split("\n")) == [long_, "b", "b"]


def test_sample_is_that_of_a_plain_ranking(spark):
    """Ids ranked before texts: repeats count each time, and an id may name several texts or be null."""
    rows = [(k % 90 if k % 17 else None, f"text {chr(97 + k % 11)} of {k % 50}", f"l{k % 3}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    F = langid.F
    hashed = df.select("lang", "doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")).alias("h"), F.xxhash64("text").alias("t")).collect()
    want = []
    for lang in ("l0", "l1", "l2"):
        ranked = sorted((r for r in hashed if r["lang"] == lang), key=lambda r: (r["h"], r["doc_id"] is not None, r["doc_id"] or 0, r["t"]))
        want.append((lang, "\n".join(r["text"] for r in ranked[:24])))
    assert langid.sample_languages(df) == want
