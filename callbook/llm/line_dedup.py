"""Line dedup: levelled sorted runs of line hashes, merged batch by batch.

Documents come in batches of ascending doc_id. A run is a table of line hashes, each with the smallest doc_id that
holds the line, in buckets of the hash that are each one sorted file. Each batch groups its own lines, merge-anti-joins
the runs (which are read bucket by bucket in order: only the batch itself is shuffled and sorted), and adds what is left
as a new run of level 0. When a level has `fanout` runs and more batches follow, they are merged into one run of the
next level, so a hash is rewritten once per level and a batch meets about fanout * log(batches) runs.

Since batches ascend, the first run that holds a hash holds its smallest doc_id. When all batches are in, the lines meet
the runs once: a line of a document goes when a smaller doc_id holds its key. Lines are known by 128 bits of hash. Hot
lines: hashes are pre-aggregated before they are shuffled, and the join that finds a line's copies is an inner equi-join
that Spark splits when a key is skewed.
"""

from __future__ import annotations

import contextlib
import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callbook.llm.common import bucketed, row_key, saved, scratch, unnamed

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line):
    """A line's key: stripped of ASCII blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled runs (names of bucketed tables); `ingest` takes batches whose doc_ids are larger than all before."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.made: list[str] = []

    def read(self, level: int | None = None) -> list[DataFrame]:
        """The runs of a level, or of all."""
        return [self.spark.table(name) for k, names in enumerate(self.levels) if level in (None, k) for name in names]

    def _write(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        with _sorted_buckets(self.spark):
            name = bucketed(run, f"run{level}", self.buckets, KEY)
        self.levels[level].append(name)
        self.made.append(name)

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                runs = reduce(DataFrame.unionByName, self.read(level))
                self.levels[level] = []
                self._write(runs, level + 1)
            level += 1

    def ingest(self, lines: DataFrame, last: bool = False) -> None:
        """Take a batch of lines (doc_id, h1, h2)."""
        new = lines.groupBy(*KEY).agg(F.min("doc_id").alias("first"))
        for run in self.read():
            # an anti-join that stays above the grouping: Spark would move a left_anti below it, to all lines of a hot key
            new = new.join(run.select(*KEY, F.lit(True).alias("held")).hint("merge"), KEY, "left").where("held is null").drop("held")
        self._write(new, 0)
        if not last:
            self._compact()


@contextlib.contextmanager
def _sorted_buckets(spark: SparkSession):
    """Trust the order within buckets of one file each, so that merge joins don't sort runs again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _batches(docs: int) -> int:
    """How many batches: both their number and their size grow with the input (4 for up to 64,000 documents, 100 for 10^9)."""
    return max(4, math.ceil((docs / 1000) ** (1 / 3)))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 3) -> DataFrame:
    """docs with `kept_text`, `n_lines` and `n_dropped`; other columns are passed on. batches: see `_batches` if not given.

    A line whose key has at least `min_chars` code points stays only in the smallest doc_id that holds it (all its
    lines there stay). Null text counts as one empty line; a text whose lines all go becomes empty. Rows with null
    doc_id hold no lines of their own and stay as they are; repeated rows count as one document. Columns named like
    the results are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    with scratch(spark):
        gone = _repeated_lines(docs, min_chars, batches or _batches(docs.count()), fanout)
    k1, k2 = row_key("doc_id", "text")
    keyed = docs.withColumns({"_k1": k1, "_k2": k2})
    joined = keyed.join(gone, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left")
    parts = _lines_of(F.col("text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")), lambda i: F.get(F.col("_lines"), i))
    return (
        joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), parts))
        .withColumns(
            {
                "kept_text": F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")),
                "n_lines": F.when(F.col("_gone").isNotNull(), F.size("_lines")).otherwise(F.size(parts)).cast("long"),
                "n_dropped": F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long"),
            }
        )
        .drop("_k1", "_k2", "k1", "k2", "_gone", "_lines")
    )


def _repeated_lines(docs: DataFrame, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """(k1, k2, _gone): rows of docs and the positions of their lines that an earlier document holds."""
    spark = docs.sparkSession
    cut = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 1000).alias("cut")).first()["cut"] or []
    cut = sorted(set(cut))[: batches - 1]
    batch = reduce(lambda e, c: e + (F.col("doc_id") > c).cast("int"), cut, F.lit(0))
    lines = (
        docs.where("doc_id is not null")
        .select("doc_id", *row_key("doc_id", "text"), F.posexplode(_lines_of(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "k1", "k2", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "k1", "k2", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"), batch.alias("batch"))
    )
    lines = saved(lines, "lines", partition_by="batch")
    runs = LineRuns(spark, fanout)
    for b in range(len(cut) + 1):
        runs.ingest(lines.where(F.col("batch") == b).drop("batch"), last=b == len(cut))
    held = reduce(DataFrame.unionByName, runs.read())
    dropped = lines.join(held.hint("merge"), KEY).where("doc_id > first")
    # a repeated row has each position once more: a set of positions serves all its copies
    gone = saved(dropped.groupBy("k1", "k2").agg(F.collect_set("pos").alias("_gone")), "gone", keep=True)
    unnamed(spark, runs.made)
    return gone


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.*, f.first_doc IS NOT NULL AND k.doc_id > f.first_doc AS gone FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS bigint) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
