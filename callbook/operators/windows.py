"""Transcript windows: greedy merging of segments, clusters of scored windows and their context.

The greedy merge is a walk: each segment has a next one, the first that would have to open another window if a window
began here, and a document's windows are the places that the walk from its first segment meets. A document is cut into
blocks of segments (each sees the few hundred segments after it that a window can reach). A block's walk is a map from
the place where it is entered to the place where it leaves; one short row of maps per document gives where each block
is entered, and the blocks then write their windows. So a long document is many tasks, and no row holds it whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callbook.functions.text import clean_text, score_window


def next_window(start: np.ndarray, end: np.ndarray, size: np.ndarray, gap: np.ndarray, seconds: float, chars: int) -> np.ndarray:
    """For each of a document's segments in order, the first later one that doesn't fit into a window that begins there.

    It would stretch the window past `seconds` or `chars` (texts are joined by one character), or begins after a gap.
    """
    n = len(start)
    before = np.append(0, np.cumsum(size + 1))
    by_chars = np.searchsorted(before[1:] - 1, before[:-1] + chars, "right")
    gaps = np.append(np.flatnonzero(gap), n)
    by_gap = gaps[np.searchsorted(gaps[:-1], np.arange(n), "right")]
    out = np.minimum(np.minimum(by_chars, by_gap), n)
    # starts rise, so what fits one segment's window by time fits the next one's too: one pointer serves all
    late = 0
    starts, ends = start.tolist(), end.tolist()
    for i in range(n):
        late = max(late, i + 1)
        while late < n and ends[late] - starts[i] <= seconds:
            late += 1
        out[i] = max(min(out[i], late), i + 1)
    return out


def _walk(after: np.ndarray, own: int, most: int) -> list[dict]:
    """For each of the first `most` places of a block of `own`: where a walk that enters there leaves (from the block's end) and how many windows it begins."""
    leaves, begun = [0] * own, [0] * own
    for i in range(own - 1, -1, -1):
        j = int(after[i])
        leaves[i], begun[i] = (j - own, 1) if j >= own else (leaves[j], begun[j] + 1)
    return [{"leave": a, "begun": b} for a, b in zip(leaves[:most], begun[:most], strict=True)]


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys in a sorted stream of batches."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a].item() for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def _written(rows: Iterator[tuple], schema: pa.Schema, many: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of rows."""
    while some := list(itertools.islice(rows, many)):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def consolidate(segments: DataFrame, seconds: float = 25.0, chars: int = 1500, gap: float = 3.0, block: int = 4096) -> DataFrame:
    """(document_id, window_no, start_seconds, end_seconds, text, n_segments, segment_ids): segments merged greedily in time order.

    A window closes before a segment that would stretch it past `seconds` or `chars`, or that begins more than `gap` after
    it. Segments without text or times are skipped. Order is that of start and segment_id.
    """
    reach = chars // 2 + 2  # a segment has a character at least
    block = max(block, reach)
    cleaned = segments.select("document_id", "segment_id", "start_seconds", "end_seconds", clean_text(F.col("text")).alias("text")).where("text <> '' and start_seconds is not null and end_seconds is not null")
    order = Window.partitionBy("document_id").orderBy("start_seconds", "segment_id")
    rows = cleaned.withColumns({"n": F.row_number().over(order) - 1, "gap": F.coalesce(F.col("start_seconds") - F.lag("end_seconds").over(order) > gap, F.lit(False))})
    home = F.floor(F.col("n") / block).cast("int")
    also = (F.col("n") % block < reach) & (home > 0)  # the block before sees it too
    placed = rows.withColumn("block", F.explode(F.when(also, F.array(home - 1, home)).otherwise(F.array(home)))).withColumn("own", home == F.col("block"))

    by = ("document_id", "block")
    blocks = lambda df: df.repartition(*by).sortWithinPartitions(*by, "n")

    def pointers(table: pa.Table) -> tuple[np.ndarray, int]:
        size = np.array([len(t) for t in table["text"].to_pylist()], np.int64)
        after = next_window(*(table[c].to_numpy() for c in ("start_seconds", "end_seconds")), size, table["gap"].to_numpy(), seconds, chars)
        return after, sum(table["own"].to_pylist())

    maps = pa.schema([("document_id", pa.int64()), ("block", pa.int32()), ("walk", pa.list_(pa.struct([("leave", pa.int32()), ("begun", pa.int32())])))])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written(((*key, _walk(*pointers(table), reach)) for key, table in _groups(batches, by)), maps, 64)

    # a document of one block is entered at its first segment
    long = placed.where("block > 0").select("document_id").distinct()
    walks = blocks(placed.join(long, "document_id", "left_semi")).mapInArrow(mapped, "document_id long, block int, walk array<struct<leave:int,begun:int>>")
    one = lambda block, at, number: F.struct(block.alias("block"), at.alias("at"), number.alias("number"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("number"), F.array().cast("array<struct<block:int,at:int,number:int>>").alias("out"))

    def enter(s, m):
        step = F.get(m["walk"], s["at"])
        return F.struct(F.coalesce(step["leave"], F.lit(0)).alias("at"), (s["number"] + F.coalesce(step["begun"], F.lit(0))).alias("number"), F.concat(s["out"], F.array(one(m["block"], s["at"], s["number"]))).alias("out"))

    entered = walks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("block", "walk"))).alias("walks"))
    entered = entered.select("document_id", F.explode(F.aggregate("walks", zero, enter)["out"]).alias("e")).select("document_id", "e.block", "e.at", "e.number")
    made = pa.schema([("document_id", pa.int64()), ("window_no", pa.int32()), ("start_seconds", pa.float64()), ("end_seconds", pa.float64()), ("text", pa.string()), ("n_segments", pa.int32()), ("segment_ids", pa.list_(pa.int64()))])

    def walked(key: tuple, table: pa.Table) -> Iterator[tuple]:
        after, own = pointers(table)
        at, number = table["at"][0].as_py(), table["number"][0].as_py()
        start, end, texts, ids = (table[c].to_pylist() for c in ("start_seconds", "end_seconds", "text", "segment_id"))
        while at < own:
            to = int(after[at])
            yield key[0], number, start[at], end[to - 1], " ".join(texts[at:to]), to - at, ids[at:to]
            at, number = to, number + 1

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written((row for key, table in _groups(batches, by) for row in walked(key, table)), made)

    both = placed.join(entered, ["document_id", "block"], "left").na.fill(0, ["at", "number"])
    return blocks(both).mapInArrow(windows, "document_id long, window_no int, start_seconds double, end_seconds double, text string, n_segments int, segment_ids array<long>")


def cluster_windows(windows: DataFrame, least: float = 2.0, apart: float = 60.0) -> DataFrame:
    """Windows scoring at least `least` with a cluster number per document; a new one begins more than `apart` seconds after the last."""
    w = Window.partitionBy("document_id").orderBy("start_seconds")
    new = F.coalesce(F.col("start_seconds") - F.lag("end_seconds").over(w) > apart, F.lit(True))
    return windows.where(F.col("score") >= least).withColumn("_new", new.cast("int")).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def around_clusters(windows: DataFrame, groups: DataFrame, around: float) -> DataFrame:
    """(document_id, window_no, cluster) of windows that overlap [from - around, to + around] of a cluster (document_id, cluster, from, to).

    A document's clusters are numbered from 1 in time order and lie apart, so those that a window meets are consecutive:
    after the last that ends before the window begins, up to the last that begins before it ends. One sorted sweep over
    both tables' times counts these, and only pairs that overlap are made.
    """
    at = lambda t, rank, kind, no: F.struct(t.cast("double").alias("t"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), no.cast("long").alias("no"))
    no = F.col("window_no")
    asked = windows.select("document_id", F.explode(F.array(at(F.col("start_seconds"), 1, "begins", no), at(F.col("end_seconds"), 1, "ends", no))).alias("e"))
    edges = groups.select("document_id", F.explode(F.array(at(F.col("from") - around, 0, "opens", F.col("cluster")), at(F.col("to") + around, 2, "closes", F.col("cluster")))).alias("e"))
    sweep = Window.partitionBy("document_id").orderBy("t", "rank").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda kind: F.sum((F.col("kind") == kind).cast("int")).over(sweep)
    swept = asked.unionByName(edges).select("document_id", "e.*").withColumns({"closed": count("closes"), "opened": count("opens")}).where("kind in ('begins', 'ends')")
    spans = swept.groupBy("document_id", F.col("no").cast("int").alias("window_no")).agg(F.max(F.when(F.col("kind") == "begins", F.col("closed"))).alias("_closed"), F.max(F.when(F.col("kind") == "ends", F.col("opened"))).alias("_opened"))
    met = spans.where("_opened > _closed")
    return met.select("document_id", "window_no", F.explode(F.sequence(F.col("_closed") + 1, F.col("_opened"))).alias("cluster"))


def candidate_windows(segments: DataFrame, detect: Callable, around: float = 90.0, least: float = 2.0) -> DataFrame:
    """One row per document and cluster of scored windows: from, to, score (summed), tickers, mentions (each ticker
    and offset once, in order), segment_ids of the first window, and the context: the text, span and segment ids of all
    windows within `around` seconds."""
    windows = consolidate(segments).withColumn("mentions", detect(F.col("text")))
    scored = windows.withColumn("score", score_window(F.col("text"), F.size("mentions")))
    placed = cluster_windows(scored, least)
    by = ["document_id", "cluster"]
    groups = placed.groupBy(*by).agg(F.min("start_seconds").alias("from"), F.max("end_seconds").alias("to"), F.sum("score").alias("score"), F.min_by("segment_ids", "window_no").alias("first_segment_ids"))
    said = placed.select(*by, "window_no", F.posexplode("mentions").alias("at", "m"))
    once = said.groupBy(*by, F.col("m.ticker").alias("_t"), F.col("m.start").alias("_s")).agg(F.min(F.struct("window_no", "at", "m")).alias("f"))
    listed = once.groupBy(*by).agg(F.sort_array(F.collect_list("f")).alias("f")).select(*by, F.col("f.m").alias("mentions"))
    met = around_clusters(windows, groups, around).join(windows.select("document_id", "window_no", "start_seconds", "end_seconds", "text", "segment_ids"), ["document_id", "window_no"])
    held = F.sort_array(F.collect_list(F.struct("window_no", "text", "segment_ids")))
    context = met.groupBy(*by).agg(held.alias("w"), F.min("start_seconds").alias("context_start"), F.max("end_seconds").alias("context_end"))
    context = context.select(*by, F.array_join("w.text", " ").alias("context"), F.flatten("w.segment_ids").alias("context_segment_ids"), "context_start", "context_end")
    out = groups.join(context, by).join(listed, by, "left").withColumn("mentions", F.coalesce("mentions", F.array().cast("array<struct<ticker:string,start:int,end:int,matched:string,method:string,confidence:double>>")))
    return out.withColumn("tickers", F.array_sort(F.array_distinct("mentions.ticker")))
