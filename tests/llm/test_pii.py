"""PII: base spans against Python's re, edge cases, and patterns that find unseen identifiers."""

import hashlib
import random
import re
import time

import regex
from pyspark.sql import types as T

from callbook.llm import pii

RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out, text = [], text or ""
    for kind, pattern in RE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def check(rows):
    for r in rows:
        base = brute(r["text"])
        held = set(base.split(","))
        assert [x for x in r["spans"].split(",") if x and x in held] == [x for x in base.split(",") if x]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (r["text"], base, r["spans"])


def result(df):
    F = pii.F
    return pii.find(df).select("doc_id", "text", *[f"n_{k}" for k in pii.KINDS], F.sha2(pii.render(F.col("base")), 256).alias("base_sha256"), pii.render(F.col("spans")).alias("spans"), "added")


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("base", T.StringType())])


def test_base_spans_match_re(spark):
    rng = random.Random(5)
    parts = ["a.b@c-d.e", "_x@y.z", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "79927398713", "+1 (974) 555-3436", "+49", "++1 2 3", "é", "🙂", ".", " ", "12", "-", "\n", "x%y", "30569309025904", "a@b", "+1((((", "99999999999999999999.1.1.1"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    texts += [None, "", "a" * 4_000, "1" * 4_000, ("a." * 500 + "@b.c ") * 20, "a@b.c" + "_d@e.f" * 3]
    rows = [(i if i % 50 else None, t, "clash") for i, t in enumerate(texts)] + [(1, texts[1], "again")] * 2
    got = result(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    check(got)


def test_matches_of_any_length(spark):
    """Too long for the plain version's patterns: the matches are known."""
    n = 200_000
    want = {
        "x@" + "b." * n + "c": f"email:0:{2 * n + 3}",
        "a " + "9." * n + "1": ",".join(f"ip:{2 + 8 * k}:{9 + 8 * k}" for k in range(5)),
        "4 1-" * n + "4": "",
        "+1" + "(2" * n: "",
        "b." * n: "",
    }
    texts = {("a " + "9." * 20 + "x" if t.startswith("a ") else t): w for t, w in want.items()}
    for r in result(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)).collect():
        base = ",".join(x for x in r["spans"].split(",") if x)
        assert base == texts[r["text"]], r["text"][:20]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(result(docs).collect())


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)).count() == 0


def test_confident_pattern_finds_unseen_identifier(spark):
    rows = [(i, f"please reach the account owner: user{i}@mail.example now", "") for i in range(20)]
    rows += [(100, "please reach the account owner: user_77_at_mail thanks", ""), (101, "the year 2024-01 was fine", "")]
    got = {r["doc_id"]: r for r in result(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[100]["spans"] == "email:32:47" and got[100]["n_email"] == 0
    assert got[101]["spans"] == "" and got[3]["n_email"] == 1


def test_accepted_values_make_new_patterns(spark):
    rows = [(i, f"please reach the account owner: user{i}@mail.example now", "") for i in range(40)]
    rows += [(100 + i, f"please reach the account owner: id_77{i}_x thanks", "") for i in range(8)]
    rows += [(200 + i, f"the ticket was opened by id_77{i}_x today", "") for i in range(8)]
    rows += [(300, "the ticket was opened by id_999_zz today", ""), (301, "he was born in id_999_yy", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["spans"] for r in result(df).collect()}
    assert all(got[100 + i] == "email:32:40" and got[200 + i] == "email:25:33" for i in range(8))
    assert got[300] == "email:25:34" and got[301] == ""  # only ever after the new pattern
    one = {r["doc_id"]: pii.render(pii.F.col("spans")) for r in pii.find(df, rounds=1).where("size(added) > 0").collect()}
    assert set(one) == set(range(100, 108))


def test_very_long_runs(spark):
    rows = [(1, "a" * 300_000 + " x@y.z 1", ""), (2, "1" * 200_000, ""), (3, "+" + "1 " * 100_000, "")]
    got = {r["doc_id"]: r["spans"] for r in result(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "email:300001:300006", 2: "", 3: ""}


def test_many_matches_in_one_text(spark):
    """100,000 addresses and as many candidates, in time that is linear in them."""
    n = 100_000
    text = " ".join(f"user{i}@mail.example id_{i:06d}" for i in range(n))
    begun = time.monotonic()
    got = result(spark.createDataFrame([(1, text, ""), (2, "x@y.z ab_123456", "")], SCHEMA)).orderBy("doc_id").collect()
    assert time.monotonic() - begun < 60
    assert [r["n_email"] for r in got] == [n, 1]
    check(got)


def test_left_context_has_no_bound(spark):
    """Three words or signs, whatever their length and the blanks between them."""
    rng = random.Random(3)
    units = ["owner", "x" * 90, "é" * 200, ":", "(", "🙂", "İstanbul", "42", "a" * 100_000]
    texts = ["", " ", "\n" * 300, *("".join(rng.choice(units) + rng.choice([" ", "  ", "\t" * 120, "", "\n"]) for _ in range(rng.randrange(1, 9))) for _ in range(200))]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", pii._left(pii.F.col("text")).alias("left")).collect()
    for r in got:
        assert r["left"] == " ".join(regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", r["text"].lower())[-3:])
