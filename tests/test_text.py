"""Words and letters beyond ASCII, as the SQL of the queries takes them."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from callbook import registry
from callbook.functions import text as X

TEXTS = ["erßunder pf", "große Über buying", "überbe éntry", "under_ über", "selling, ünder", "maybeß", "ßcould", "I think ß"]


def test_call_words_and_hedges_end_at_letters_beyond_ascii(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    got = df.select("id", X.score_window(F.col("text"), F.lit(0)).alias("score"), X.has_hedge(F.col("text")).alias("hedged")).orderBy("id").collect()
    for r, text in zip(got, TEXTS, strict=True):
        assert r.score == len(duckdb.execute("SELECT regexp_extract_all(?, ?)", [text, X.CALL_WORDS]).fetchone()[0])
        assert r.hedged == duckdb.execute("SELECT regexp_matches(?, ?)", [text, X.HEDGES]).fetchone()[0]
    assert got[0].score == 1.0


def test_quotes_are_found_whatever_the_case_of_their_letters(spark):
    df = spark.createDataFrame([("STRAẞE", "die Straße"), ("ΛΟΓΟΣ", "ο λογοσ"), ("λογοσ", "ΛΟΓΟΣ ΕΝ"), ("İ", "x i"), ("SS", "ß")], "quote string, source string")
    assert [r[0] for r in df.select(X.evidence_in_source(F.col("quote"), F.col("source"))).collect()] == [True, True, True, True, False]


def test_evidence_query_equals_its_sql_on_a_sharp_s(spark, tmp_path):
    rows = [(1, 0, "eine Straße hier"), (1, 1, "e Straße"), (1, 2, "xxraße raße"), (2, 0, "Größe"), (2, 3, "GrößeX"), (3, 1, None), (3, 2, "ab  ñÑé"), (3, 5, "cd ñÑéx")]
    pd.DataFrame([{"conv_id": d, "turn": n, "role": "user", "text": t} for d, n, t in rows]).to_parquet(tmp_path / "conversations.parquet")
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet')")
    want = duckdb.execute(registry.ORACLE_SQL["t6_evidence"]).fetchall()
    got = registry.QUERIES["t6_evidence"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(r.there for r in got)


def test_a_text_is_searched_once_and_in_bounded_parts(spark, sf_dir):
    plan = registry.QUERIES["t4_unique_tickers"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    texts = ["ab", "", "cdefgh", "i", "jk", "l" * 9]
    parts = list(X._parts(texts, 4))
    assert parts == [["ab", ""], ["cdefgh"], ["i", "jk"], ["l" * 9]] and list(X._parts([])) == []
