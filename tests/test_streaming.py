"""Streams against their batch twins."""

from datetime import datetime as D

from callbook.streaming import streams


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_documents_once(spark, tmp_path):
    rows = [("yt", "a", D(2026, 5, 1)), ("yt", "a", D(2026, 5, 1, 1)), ("yt", "b", D(2026, 5, 1))]
    spark.createDataFrame(rows, "source_type string, external_id string, posted_at timestamp").write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema("source_type string, external_id string, posted_at timestamp").parquet(str(tmp_path / "d"))
    assert drained(spark, streams.unique_documents(stream), "docs_once").count() == 2
    twin = streams.unique_documents(spark.read.parquet(str(tmp_path / "d")))
    assert sorted(map(tuple, twin.collect())) == [rows[0], rows[2]]


def test_signals_match_batch(spark, tmp_path):
    rows = [(f"T{k % 3}", k % 5, D(2026, 5, 1 + k % 9, k % 24), "bullish" if k % 2 else "bearish", "accepted") for k in range(300)]
    schema = "ticker string, creator_id long, posted_at timestamp, polarity string, status string"
    batch = spark.createDataFrame(rows, schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "c"))
    for size in ("1d", "7d"):
        got = drained(spark, streams.continuous_signals(stream, size), f"signals_{size}", "complete")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, streams.continuous_signals(batch, size).collect()), key=repr)


def test_only_new_outcomes_are_appended(spark, tmp_path):
    path = str(tmp_path / "o")
    run = streams.evaluate_batches(lambda df: df.selectExpr("id as call_id", "'5d' as horizon"), path)
    run(spark.range(5), 0)
    run(spark.range(3, 8), 1)
    run(spark.range(5), 0)  # a retry, or a query started anew
    streams.evaluate_batches(lambda df: df.selectExpr("id as call_id", "'5d' as horizon"), path)(spark.range(9), 0)
    assert sorted(r["call_id"] for r in spark.read.parquet(path).collect()) == list(range(9))


def test_outcomes_by_day_read_only_their_days(spark, tmp_path):
    path = str(tmp_path / "o")
    run = streams.evaluate_batches(lambda df: df.selectExpr("id as call_id", "'5d' as horizon", "if(id = 11, null, date_add(date'2026-05-01', cast(id div 4 as int))) as day"), path, "day")
    run(spark.range(6), 0)
    seen = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "o").rglob("*.parquet")}
    # an unreadable file of a day that the next batch doesn't touch: it is not read
    (tmp_path / "o/day=2030-01-01").mkdir()
    (tmp_path / "o/day=2030-01-01/bad.parquet").write_bytes(b"no parquet")
    run(spark.range(4, 12), 1)
    run(spark.range(4, 12), 1)
    (tmp_path / "o/day=2030-01-01/bad.parquet").unlink()
    assert sorted(r["call_id"] for r in spark.read.parquet(path).collect()) == list(range(12))
    assert seen.items() <= {p.name: p.stat().st_mtime_ns for p in (tmp_path / "o").rglob("*.parquet")}.items()


def test_live_positions_match_the_folded_ledger(spark, tmp_path):
    from callbook.plans import portfolio as P

    schema = "id long, ticker string, side string, quantity double, price_per_share double, currency string, fees double, traded_at timestamp"
    rows = [(k, f"T{k % 3}", "sell" if k % 4 == 3 else "buy", 0.5 if k % 4 == 3 else float(1 + k % 5), 10.0 + k, "USD", 0.5, D(2026, 5, 1 + k // 3)) for k in range(45)]
    for n in range(3):
        spark.createDataFrame(rows[15 * n : 15 * n + 15], schema).coalesce(1).write.parquet(str(tmp_path / f"t/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "t"))
    q = streams.live_positions(stream).writeStream.format("memory").queryName("live").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(180)
    last = {r["ticker"] for r in spark.table("live").collect()}
    want = {r["ticker"]: r for r in P.fold_ledger(spark.createDataFrame(rows, schema)).collect()}
    assert last == set(want)
    for t, r in want.items():
        assert any(abs(x["quantity"] - r["quantity"]) < 1e-6 and abs(x["cost_basis"] - r["cost_basis"]) < 1e-6 and abs(x["realized"] - r["realized"]) < 1e-6 for x in spark.table("live").where(f"ticker = '{t}'").collect())


def test_pauses(spark, tmp_path):
    rows = [(1, D(2026, 5, 1, 0, 0, s)) for s in (0, 2, 4, 20, 21)]
    spark.createDataFrame(rows, "document_id long, spoken_at timestamp").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("document_id long, spoken_at timestamp").parquet(str(tmp_path / "s"))
    got = drained(spark, streams.pauses(stream), "pauses", "complete")
    assert sorted(r["n_segments"] for r in got.collect()) == [2, 3]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_ordered_positions_of_shuffled_trades(spark, tmp_path):
    """Trades in any order within the watermark equal the batch fold; late ones are counted; a restart goes on."""
    import random

    from callbook.plans import portfolio as P

    schema = "id long, ticker string, side string, quantity double, price_per_share double, currency string, fees double, traded_at timestamp"
    rows = [(k, f"T{k % 3}", "sell" if k % 4 == 3 else "buy", 0.5 if k % 4 == 3 else float(1 + k % 5), 10.0 + k, "USD", 0.5, D(2026, 5, 1 + k // 10, k % 10)) for k in range(60)]
    mixed = rows[:]
    rng = random.Random(1)
    for a in range(0, 60, 20):  # two days are shuffled, within the watermark of three
        part = mixed[a : a + 20]
        rng.shuffle(part)
        mixed[a : a + 20] = part
    files = [mixed[0:15], mixed[15:30], mixed[30:45], mixed[45:60], [(99, "end", "buy", 1.0, 1.0, "USD", 0.0, D(2026, 7, 1))], [(100, "T0", "buy", 1000.0, 1.0, "USD", 0.0, D(2026, 5, 1)), (101, "end", "buy", 1.0, 1.0, "USD", 0.0, D(2026, 7, 2))]]
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    dropped = 0
    try:
        for n, part in enumerate(files):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"t/{n}"))
            # each file is its own run of the query: every one starts again from the checkpoint
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "t"))
            out = streams.ordered_positions(stream, "3 days").writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c"))
            q = out.foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "o"))).start()
            q.awaitTermination(180)
            assert q.exception() is None
            dropped += sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = {r["ticker"]: r for r in P.fold_ledger(spark.createDataFrame(rows, schema)).collect()}
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    for t, r in want.items():
        last = max((x for x in got if x["ticker"] == t), key=lambda x: x["folded_until"])
        assert abs(last["quantity"] - r["quantity"]) < 1e-6 and abs(last["cost_basis"] - r["cost_basis"]) < 1e-6 and abs(last["realized"] - r["realized"]) < 1e-6 and last["rejected"] == 0
    assert dropped == 1


def test_daily_sketches_make_every_window(spark, tmp_path):
    rows = [(f"T{k % 3}", (k * 7) % 211, D(2026, 5, 1 + k % 20, k % 24), ("bullish", "bearish", "neutral")[k % 3 if k % 5 else 0], ("factual", "opinion", "hype")[k % 3], "accepted") for k in range(3000)]
    claims = spark.createDataFrame(rows, "ticker string, creator_id long, posted_at timestamp, polarity string, claim_class string, status string")
    calls = spark.createDataFrame([(f"T{k % 3}", k % 50, D(2026, 5, 3 + k % 9), "long", "accepted") for k in range(90)], "ticker string, creator_id long, posted_at timestamp, direction string, status string")
    known = spark.createDataFrame([(c, 0.25 + c % 3 / 4) for c in range(0, 211, 2)], "creator_id long, credibility double")
    daily = streams.daily_mentions(claims, calls, known)
    claims.coalesce(1).write.parquet(str(tmp_path / "c"))
    calls.coalesce(1).write.parquet(str(tmp_path / "k"))
    read = lambda df, d: spark.readStream.schema(df.schema).parquet(str(tmp_path / d))
    table = drained(spark, streams.daily_mentions(read(claims, "c"), read(calls, "k"), known), "daily", "complete")
    plain = lambda df: sorted(tuple(r)[:-1] for r in df.collect())
    for a, b in zip(plain(table), plain(daily), strict=True):
        assert a[:4] == b[:4] and all(abs(x - y) < 1e-9 for x, y in zip(a[4:], b[4:], strict=True))
    weight = {"factual": 1.0, "opinion": 0.5, "hype": 0.0}
    sign = {"bullish": 1.0, "long": 1.0, "bearish": -1.0, "neutral": 0.0}
    said = [(t, c, at, sign[p], weight[k], 0) for t, c, at, p, k, _ in rows] + [(r[0], r[1], r[2], 1.0, 1.0, 1) for r in calls.collect()]
    for size, days in (("1d", 1), ("7d", 7), ("30d", 30)):
        for r in streams.window_signals(daily, size).collect():
            inside = [x for x in said if x[0] == r["ticker"] and 0 < (r["window_end"] - x[2]).total_seconds() <= days * 86400]
            assert (r["n_claims"], r["n_calls"]) == (sum(1 - x[5] for x in inside), sum(x[5] for x in inside))
            exact = len({x[1] for x in inside})
            assert abs(r["n_creators"] - exact) <= max(1, 0.03 * exact)
            ws = [((0.25 + x[1] % 3 / 4) if x[1] % 2 == 0 else 1.0) * x[4] for x in inside]
            assert abs(r["net_polarity"] - sum(x[3] for x in inside) / len(inside)) < 1e-9
            assert r["credibility_weighted"] is None if not sum(ws) else abs(r["credibility_weighted"] - sum(w * x[3] for w, x in zip(ws, inside, strict=True)) / sum(ws)) < 1e-9
