"""The screen of a universe, its table, labels and snapshots."""

from datetime import datetime as D

from callbook.plans import lenses as L
from callbook.plans import screener as SC
from callbook.sources import tables as IO

METRICS = "ticker string, sector string, forward_pe double, trailing_pe double, peg_ratio double, ev_to_ebitda double, revenue_growth double, earnings_growth double, revenue_growth_qoq double, gross_margin double, return_on_equity double, debt_to_equity double, days_to_earnings int"
MENTION = "ticker string, creator_id long, final_confidence double, status string"


def test_universe(spark):
    universe = spark.createDataFrame([("A", "Tech"), ("B", "tech"), ("C", "Energy"), ("D", "Tech")], "ticker string, sector string")
    metrics = spark.createDataFrame([("A", "", 10.0, None, None, None, 0.2, 0.1, None, 0.5, 0.2, 0.5, 3), ("B", "Other", None, None, None, None, None, None, None, None, None, None, None)], METRICS)
    technicals = spark.createDataFrame([("A", 110.0, 100.0, 0.1), ("D", 110.0, 100.0, 0.1)], "ticker string, last_close double, sma_200 double, rs_vs_benchmark double")
    calls = spark.createDataFrame([("B", 1, 0.8, "accepted"), ("B", 2, 0.9, "pending_review"), ("D", 1, 0.5, "accepted")], MENTION)
    claims = spark.createDataFrame([("B", 1, 0.6, "accepted")], MENTION)
    out = SC.screen_universe(universe, metrics, technicals, calls, claims, sector="TECH")
    rows = out.collect()
    assert [(r["ticker"], r["n_passed"], r["error"]) for r in rows] == [("A", 4, None), ("B", 0, None), ("D", 0, "no_metrics")]  # errors last, mentions move nothing
    a, b, d = rows
    assert (a["sector"], b["sector"], d["sector"]) == ("Tech", "Other", "Tech") and (b["n_mentions"], round(b["avg_confidence"], 6), d["n_mentions"]) == (2, 0.7, 0)
    assert a["data_quality"] == [] and b["data_quality"] == list(SC.QUALITY) and d["data_quality"] == [] and a["flags"] == ["earnings_in_3d"]
    table = SC.screen_table(out).collect()
    assert [r["ticker"] for r in table] == ["A"] and table[0].asDict()["filters_passed"] == "value,growth,quality,technical" and list(table[0].asDict()) == list(SC.SCREEN_TABLE)
    assert SC.screen_table(out, only_passing=False).count() == 3


def test_evaluation(spark):
    fields = "id long, is_call boolean, ticker string, direction string, entry_type string, timeframe string, entry_price double, target_price double, stop_price double"
    want = spark.createDataFrame([(1, True, "A", "long", "limit", None, 100.0, 0.0, None), (2, False, None, None, None, None, None, None, None)], fields)
    got = spark.createDataFrame([(1, True, "A", "short", "limit", "unspecified", 100.9, 0.02, None)], fields)
    r = L.extraction_eval(want, got).first()
    assert (r["tp"], r["tn"], r["precision"], r["recall"], r["f1"]) == (1, 1, 1.0, 1.0, 1.0)
    assert [r[f"{c}_accuracy"] for c in ("ticker", "direction", "entry_type", "timeframe", "entry_price", "target_price", "stop_price")] == [1, 0, 1, 1, 1, 0, 1]
    none = L.extraction_eval(want.where("id = 2"), got.limit(0)).first()
    assert (none["tn"], none["precision"], none["f1"], none["ticker_accuracy"]) == (1, 0.0, 0.0, None)


def test_labels_documents_and_snapshots(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": "1", "source_text": "buy", "expected": null}\n{"id": "2", "source_text": "x", "expected": {"ticker": "AMD", "entry_price": 3.0}, "notes": "n"}\n{"id": "3", "source_text": "y", "expected": {}}\n')
    new = IO.gold_rows(IO.read_gold(spark, str(tmp_path / "g.jsonl")))
    assert [(r["source_key"], r["expected_is_call"], r["expected_ticker"], r["notes"]) for r in new.orderBy("source_key").collect()] == [("1", False, None, ""), ("2", True, "AMD", "n"), ("3", False, None, "")]
    old = new.where("source_key = '2'").withColumns({"notes": new["source_text"]})
    kept = IO.upsert_gold(old, new.unionByName(new))
    assert kept.count() == 3 and kept.where("source_key = '2'").first()["notes"] == "n"
    raw = spark.createDataFrame([("yt", "a", "2024-05-01T10:00:00", [(0.0, "x")]), ("yt", "b", "2024-05-01T10:00:00+02:00", []), ("yt", "c", "soon", None)], "source_type string, external_id string, posted_at string, segments array<struct<start:double,text:string>>")
    docs, segments = IO.ingest_documents(raw.select("source_type", "external_id").limit(0), raw)
    assert {r["external_id"]: r["posted_at"] for r in docs.collect()} == {"a": D(2024, 5, 1, 10), "b": D(2024, 5, 1, 8), "c": None} and segments.count() == 1
    view = spark.createDataFrame([("A", D(2024, 5, 1), "watch", 10.0)], "ticker string, ts timestamp, status string, close double")
    heard = view.selectExpr("*", "100.5 as support", "named_struct('kind', 'range', 'trigger', 9.0d, 'low', 9.0d, 'high', 9.5d, 'invalidation', 8.5d) as zone", "true as available", "3L as n_calls", "'fresh' as coverage", "cast(null as timestamp) as as_of")
    one = IO.headline(heard).first()
    assert (one["nearest_support"], one["entry_trigger"], one["entry_zone_high"], one["invalidation_reference"], one["entry_zone_available"]) == (100.5, 9.0, 9.5, 8.5, True)
    assert (one["transcript_n_calls"], one["transcript_coverage_status"], one["as_of"]) == (3, "fresh", D(2024, 5, 1)) and IO.headline(heard).dtypes == IO.headline(view).dtypes
    IO.snapshot(view, str(tmp_path / "snap"))
    IO.snapshot(view, str(tmp_path / "snap"))
    back = spark.read.parquet(str(tmp_path / "snap"))
    assert tuple(back.columns) == IO.HEADLINE and back.count() == 2 and (back.first()["as_of"], back.first()["last_close"], back.first()["rsi_14"]) == (D(2024, 5, 1), 10.0, None)
