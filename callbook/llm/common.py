"""Shared helpers: durable intermediate tables and vectorised text hashing."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


@functools.cache
def _local_scratch() -> str:
    path = tempfile.mkdtemp(prefix="callbook-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: `spark.checkpoint.dir`, or a scratch folder in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_scratch()


_scratch: list[list[str]] = []


def _new_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/callbook-{label}-{uuid.uuid4().hex}"
    if _scratch and not keep:
        _scratch[-1].append(path)
    return path


def saved(df: DataFrame, label: str, partition_by: str | None = None, keep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and any executor may be lost."""
    spark = df.sparkSession
    path = _new_path(spark, label, keep)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are removed at the end, but for those saved with `keep`: only these may be used after it."""
    _scratch.append([])
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in _scratch.pop():
            folder = hadoop(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed(df: DataFrame, label: str, buckets: int, keys: list[str]) -> str:
    """Write df as a table of one sorted file per bucket of its keys in the shared folder; returns the table's name.

    Joins on the keys read it without a shuffle. The name is the session's and ends with `unnamed`.
    """
    name = f"callbook_{label}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", _new_path(df.sparkSession, label)).saveAsTable(name, format="parquet")
    return name


def unnamed(spark: SparkSession, tables: list[str]) -> None:
    """Take the names of bucketed tables from the session; their files stay."""
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many parts with rows as there are cores: a file of one row group would be one task.

    Parts are counted without reading a column. A table of many parts, such as any large one, is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(F.spark_partition_id().alias("part")).distinct().count()
    return df if parts >= cores else df.repartition(cores)


def row_key(*cols: str) -> list:
    """Two 64-bit hashes that name a row by its values (null-safe): repeated rows share them."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in cols]
    return [F.xxhash64(F.lit(11), *texts).alias("k1"), F.xxhash64(F.lit(29), *texts).alias("k2")]


def schema_with(df: DataFrame, more: str) -> T.StructType:
    """df's schema and, after it, the fields of a DDL string."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def slices(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about `most` bytes, so that what is derived from them stays small."""
    step = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return pc.fill_null(column, "").to_pylist()


# --- words -------------------------------------------------------------------------------------------------------
# A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text.

_IS_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _IS_WORD[_lo : _hi + 1] = True
_rng = np.random.default_rng(20240817)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.empty(4096, np.uint64)
_POWER[0] = 1
for _i in range(1, 4096):
    _POWER[_i] = (int(_POWER[_i - 1]) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (vectorised, wraps around)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def utf8_of(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (with the end as last entry)."""
    arr = pc.fill_null(column, "").cast(pa.large_string())
    if lower:
        arr = pc.utf8_lower(arr)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and where each text's words begin (with the end last).

    Works on the bytes of the whole batch at once, a megabyte at a time, without making a Python object per word.
    """
    data, offsets = utf8_of(column, lower=True)
    n = len(data)
    is_first = np.zeros(n + 1, bool)
    is_first[offsets] = True
    hashes, begins, at = [], [], 0
    while at < n:
        end = min(n, at + _CHUNK)
        while end < n and not is_first[end] and _IS_WORD[data[end]]:
            end += 1
        part, first = data[at:end], is_first[at:end]
        word = _IS_WORD[part]
        start = word.copy()
        start[1:] &= ~word[:-1] | first[1:]
        where = np.flatnonzero(start)
        if len(where):
            begins.append(where + at)
            letters = part[word]
            heads = (np.cumsum(word) - 1)[where]
            size = np.diff(np.append(heads, len(letters)))
            inside = np.arange(len(letters)) - np.repeat(heads, size)
            hashes.append(mix(np.add.reduceat(_BYTE[letters] * _POWER[inside & 4095], heads) + size.astype(np.uint64)))
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; a shorter text is one run."""
    if not len(words):
        return words
    width = min(width, len(words))
    last = len(words) - width + 1
    out = np.zeros(last, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + last]
    return np.unique(mix(out + np.uint64(width)))
