"""Registration of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callbook.testdata import ctes, table

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Domain tables of one folder by name."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since engines add in different orders."""
    # adding 0.0 turns -0.0 into 0.0
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if isinstance(t, T.DoubleType) else F.col(c) for c, t in ((f.name, f.dataType) for f in df.schema.fields)])


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = (), more: str = "", digits: int = 6):
    """Register fn(tables) -> DataFrame; `more` adds CTEs after the derived tables."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(Tables(spark, sf_dir)), digits)
        if sql is not None:
            head = ctes(*tables) if tables else ""
            if more:
                head = f"{head},\n{more}" if head else f"WITH {more}"
            if re.search(r"\brec AS \(", head):
                head = head.replace("WITH ", "WITH RECURSIVE ", 1)
            ORACLE_SQL[name] = f"{head}\n{sql}"
        return fn

    return add


def r6(*names: str, digits: int = 6) -> str:
    """SQL that rounds columns as `rounded` does."""
    return ", ".join(f"round({n}, {digits}) + 0.0e0 AS {n}" for n in names)
