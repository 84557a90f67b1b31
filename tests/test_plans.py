"""Registered queries: the SQL agrees at the smallest scale, and flagship plans stay distributed."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from callbook.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ["k1_leaderboard", "c3_outcomes", "a3_ticker_signals", "t14_setup", "c12_walkforward", "c13_fold_ledger", "c7_screen", "j7_latest_close", "w15_nearest_levels", "io12_plan_lenses", "w27_consolidate", "c16_candidate_windows", "t27_resolve_peers", "c17_extract_claims", "c5_research_view", "t16_rubric", "io3_universe", "io5_gold", "io11_snapshot", "st1_unique_documents", "st4_pauses"]


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(f"{v:.9g}") if isinstance(v, float) else v if isinstance(v, bool | int | str) else str(v)

    return sorted((tuple(one(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", FEW)
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [[row[names.index(c)] for c in columns] for row in want.fetchall()]
    assert plain([[r[c] for c in columns] for r in got.collect()]) == plain(rows)


@pytest.mark.parametrize("name", ["c3_outcomes", "a4_creator_scorecards", "a3_ticker_signals", "t14_setup", "c8_mention_momentum"])
def test_plan_has_no_cartesian_product_or_row_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_are_kept_by_configuration(spark):
    from callbook.plans import strategies as X

    fields = "strategy string, strategy_version string, config_hash string, n_trades long"
    held = spark.createDataFrame([("a", "v1", "x", 1), ("a", "v1", "y", 2), ("a", "v2", "x", 3)], fields)
    got = X.persist_results(held, spark.createDataFrame([("a", "v1", "x", 9), ("b", "v1", "x", 4)], fields))
    assert sorted(map(tuple, got.collect())) == [("a", "v1", "x", 9), ("a", "v1", "y", 2), ("a", "v2", "x", 3), ("b", "v1", "x", 4)]
    assert X.clamped("2025-01-01", "2024-06-30") == "2024-06-30" and X.clamped("2024-01-01", None) == "2024-01-01"
    assert X.config_hash({"b": 1, "a": "x"}) == X.config_hash({"a": "x", "b": 1}) != X.config_hash({"a": "x", "b": 2})
