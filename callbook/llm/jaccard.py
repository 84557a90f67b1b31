"""N-gram Jaccard join by chosen paths (after Christiani, Pagh and Sivertsen, 2018).

A document is the set of its runs of `width` words. A run of the join splits all sets into buckets: each set follows
the token that a shared hash function of the bucket's path samples from it (its minimum under that function), so two
sets stay together with a probability equal to their similarity. Buckets of at most `limit` sets are brute-forced;
larger ones are split again on another shared token, up to `depth` times. A child that keeps half of its bucket is
not worth splitting (its sets really are alike) and is brute-forced too. Runs repeat, with other hash functions, until
a pair at the threshold is found with probability `recall`, even if it was split `depth` times in each run.

Brute force is exact: intersections of the full sets. Each pair is checked once, in the first run that brings it
together, since every set knows its bucket in all runs. Large buckets are cut into tiles of about `tile` sets or
`tile_tokens` tokens, and a task compares two tiles; sets that an earlier run has brought together are not compared again. No pairs leave a
task: each set gets the number of its links there, and an edge to the smallest id that it is connected with.

Equal sets are joined first: one stands for all, and counts as many. Nothing is capped or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callbook.llm.common import map_arrow, mix, row_key, saved, scratch, shingles, slices, word_hashes
from callbook.llm.components import components

SPARE = 12  # hash functions for deeper splits, chosen by path
_TOKENS = 1_500_000  # compared at a time


def runs_needed(similarity: float, depth: int, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth)))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 2**63, n, dtype=np.uint64)


def _minima(s: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    if len(s) * len(times) <= 2_000_000:
        return ((s[None, :] ^ plus[:, None]) * times[:, None]).min(1)
    return np.array([((s ^ p) * t).min() for t, p in zip(times, plus, strict=True)], np.uint64)


def _named(s: np.ndarray) -> tuple[int, int]:
    """The two signed 64-bit hashes that name a set."""
    return int(np.add.reduce(mix(s)).view(np.int64)), int(np.add.reduce(mix(s ^ np.uint64(0xABCDEF))).view(np.int64))


def _sets(docs: DataFrame, width: int, runs: int, depth: int) -> DataFrame:
    """Per row: its key, two hashes that name its set, the set's size and its paths (run-major, one per depth)."""
    times, plus = _functions(runs + SPARE)
    at = np.arange(runs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, begins = word_hashes(batch.column("text"))
        n = batch.num_rows
        h1, h2, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        paths = np.zeros((n, runs, depth), np.uint64)
        for k in range(n):
            s = shingles(words[begins[k] : begins[k + 1]], width)
            size[k] = len(s)
            if not len(s):
                continue
            h1[k], h2[k] = _named(s)
            low = _minima(s, times, plus)
            path = mix(low[:runs] + at.astype(np.uint64))
            for level in range(depth):
                if level:
                    path = mix(path ^ low[runs + (path % np.uint64(SPARE)).astype(np.int64)])
                paths[k, :, level] = path
        flat = paths.reshape(n, runs * depth).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (runs * depth)), pa.array(flat.ravel()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(h1), pa.array(h2), pa.array(size), lists], ["doc_id", "k1", "k2", "h1", "h2", "size", "paths"])

    return map_arrow(docs.select("doc_id", *row_key("doc_id", "text"), "text"), run, "doc_id long, k1 long, k2 long, h1 long, h2 long, size long, paths array<long>")


def _leaves(reps: DataFrame, runs: int, depth: int, limit: int) -> DataFrame:
    """(id, run, leaf) of all sets that share their bucket with another."""
    one = F.explode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(r.alias("run"), F.slice("paths", r * depth + 1, F.lit(depth)).alias("way"))))
    rows = reps.select("id", "size", one.alias("at")).select("id", "size", "at.run", "at.way")
    found, above = [], None
    for level in range(depth):
        here = rows.withColumn("leaf", F.get("way", F.lit(level)))
        counts = here.groupBy("run", "leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        here = here.join(counts, ["run", "leaf"])
        done = F.col("n") <= limit
        if above is not None:
            done = done | (F.col("n") * 2 >= F.col("above"))
        if level == depth - 1:
            done = F.lit(True)
        here = saved(here.withColumn("done", done), f"level{level}")
        found.append(here.where("done").select("id", "size", "run", "leaf"))
        rows = here.where("not done").select("id", "size", "run", "way", F.col("n").alias("above"))
        above = True
    return reduce(DataFrame.unionByName, found)


def _load(tile: int, tile_tokens: int):
    """A set's share of a tile, by number and by tokens."""
    return F.lit(1.0 / tile) + F.col("size") / tile_tokens


def _work(leaves: DataFrame, runs: int, tile: int, tile_tokens: int) -> DataFrame:
    """(id, leaves, tasks): for each set with comparisons to make, the tasks (bucket, pair of tiles, its own tile) that it goes to.

    A bucket needs no work if all its sets share a bucket of an earlier run. In a bucket larger than a tile, the sets of
    the earlier bucket that holds most of them are `old`: they are compared with the others only.
    """
    per_set = leaves.groupBy("id").agg(F.array(*[F.max(F.when(F.col("run") == r, F.col("leaf"))) for r in range(runs)]).alias("leaves"))
    member = saved(leaves.join(per_set, "id"), "members")
    same = [(F.min(F.get("leaves", F.lit(r))).alias(f"low{r}"), F.max(F.get("leaves", F.lit(r))).alias(f"high{r}"), F.count(F.get("leaves", F.lit(r))).alias(f"has{r}")) for r in range(runs - 1)]
    buckets = member.groupBy("run", "leaf").agg(F.sum(_load(tile, tile_tokens)).alias("load"), F.count(F.lit(1)).alias("m"), *[c for three in same for c in three])
    settled = reduce(lambda e, r: e | ((F.col("run") > r) & (F.col(f"has{r}") == F.col("m")) & (F.col(f"low{r}") == F.col(f"high{r}"))), range(runs - 1), F.lit(False))
    open_ = saved(buckets.where(~F.coalesce(settled, F.lit(False))).select("run", "leaf", "load"), "buckets")
    large = member.join(open_.where("load > 1"), ["run", "leaf"])
    votes = large.select("run", "leaf", "size", F.posexplode("leaves").alias("r", "earlier")).where("r < run and earlier is not null").groupBy("run", "leaf", "r", "earlier").agg(F.sum(_load(tile, tile_tokens)).alias("votes"))
    top = votes.groupBy("run", "leaf").agg(F.max_by(F.struct("r", "earlier"), F.struct("votes", -F.col("r"), "earlier")).alias("top"), F.max("votes").alias("load_old"))
    open_ = open_.join(top, ["run", "leaf"], "left").withColumn("load_old", F.coalesce("load_old", F.lit(0.0)))
    placed = member.join(open_, ["run", "leaf"])
    old = F.coalesce(F.get("leaves", F.col("top.r")) == F.col("top.earlier"), F.lit(False))
    n_new_tiles = F.greatest(F.lit(1), F.ceil(F.col("load") - F.col("load_old") - 1e-6)).cast("int")
    n_old_tiles = F.ceil(F.col("load_old") - 1e-6).cast("int")
    placed = placed.withColumns({"old": old, "new_tiles": n_new_tiles, "old_tiles": n_old_tiles})
    mine = F.when(F.col("old"), F.col("new_tiles") + F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.col("old_tiles"))).cast("int")).otherwise(F.pmod(F.xxhash64("id"), F.col("new_tiles")).cast("int"))
    placed = placed.withColumn("mine", mine)
    # an old tile meets new tiles, a new tile meets all
    others = F.sequence(F.lit(0), F.when(F.col("old"), F.col("new_tiles")).otherwise(F.col("new_tiles") + F.col("old_tiles")) - 1)
    tasks = F.transform(others, lambda o: F.struct(F.xxhash64("run", "leaf", F.least("mine", o), F.greatest("mine", o)).alias("task"), F.col("run"), F.least("mine", o).alias("a"), F.greatest("mine", o).alias("b"), F.col("mine")))
    return placed.select("id", "leaves", tasks.alias("tasks")).groupBy("id").agg(F.first("leaves").alias("leaves"), F.flatten(F.collect_list("tasks")).alias("tasks"))


def _add_shared(shared: np.ndarray, parts: list[np.ndarray], left: np.ndarray, right: np.ndarray, place: np.ndarray, place_r: np.ndarray) -> None:
    """Adds the number of tokens that each set on the left shares with each on the right."""
    n = len(parts)
    owner = np.repeat(np.arange(n), [len(p) for p in parts])
    token = np.concatenate(parts)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    column = np.cumsum(np.append(True, token[1:] != token[:-1])) - 1 if len(token) else np.zeros(0, np.int64)
    held = np.bincount(column)
    # tokens of a few sets: pair by pair; frequent ones: matrix products over some columns at a time
    few = (held[column] > 1) & (held[column] <= 6)
    c, o = column[few], owner[few]
    for step in range(1, 6):
        k = np.flatnonzero(c[step:] == c[:-step])
        for x, y in ((o[k], o[k + step]), (o[k + step], o[k])):
            use = (place[x] >= 0) & (place_r[y] >= 0)
            np.add.at(shared, (place[x[use]], place_r[y[use]]), 1)
    many = np.flatnonzero(held > 6)
    for begin in range(0, len(many), 1024):
        part = many[begin : begin + 1024]
        at = np.full(len(held), -1)
        at[part] = np.arange(len(part))
        use = at[column] >= 0
        ones = np.zeros((n, len(part)), np.float32)
        ones[owner[use], at[column[use]]] = 1
        shared += ones[left] @ ones[right].T


def _compare(sets: list[np.ndarray], leaves: np.ndarray, copies: np.ndarray, mine: np.ndarray, a: int, b: int, run: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set (counting copies) and the component of each set, within one task."""
    n = len(sets)
    left, right = np.flatnonzero(mine == a), np.flatnonzero(mine == b)
    if not len(left) or not len(right):
        return np.zeros(n, np.int64), np.arange(n)
    size = np.array([len(s) for s in sets], np.int64)
    place, place_r = np.full(n, -1), np.full(n, -1)
    place[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    shared = np.zeros((len(left), len(right)), np.float32)
    # the space of tokens in ranges, so that memory does not follow the length of the texts
    ranges = -(-int(size.sum()) // _TOKENS)
    cuts = [np.uint64(k * (2**64 // ranges)) for k in range(ranges)] if ranges else []
    for k, low in enumerate(cuts):
        begin = [int(np.searchsorted(s, low)) for s in sets]
        end = [int(np.searchsorted(s, cuts[k + 1])) for s in sets] if k + 1 < len(cuts) else size.tolist()
        parts = [s[i:j] for s, i, j in zip(sets, begin, end, strict=True)]
        _add_shared(shared, parts, left, right, place, place_r)
    linked = np.zeros(shared.shape, bool)
    links = np.zeros(n, np.int64)
    for i in range(0, len(left), 512):
        rows = left[i : i + 512]
        alike = shared[i : i + 512] * np.float32(1 + similarity) >= np.float32(similarity) * (size[rows][:, None] + size[right][None, :]).astype(np.float32) - np.float32(1e-3)
        for r in range(run):
            x, y = leaves[rows, r], leaves[right, r]
            alike &= ~((x[:, None] == y[None, :]) & (x != 0)[:, None])
        if a == b:
            alike[np.arange(len(rows)), np.arange(i, i + len(rows))] = False
        linked[i : i + 512] = alike
        alike = alike.astype(np.float64)
        links[rows] += (alike @ copies[right]).astype(np.int64)
        if a != b:
            links[right] += (copies[rows] @ alike).astype(np.int64)
    return links, _labels(linked, left, right, n)


def _labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest index in each one's component; every row and column of links is followed once."""
    label = np.arange(n)
    seen_left, seen_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for i in np.flatnonzero(linked.any(1)).tolist():
        if seen_left[i]:
            continue
        rows = np.array([i])
        members = [left[rows]]
        seen_left[i] = True
        while len(rows):
            columns = np.flatnonzero(linked[rows].any(0) & ~seen_right)
            seen_right[columns] = True
            rows = np.flatnonzero(linked[:, columns].any(1) & ~seen_left)
            seen_left[rows] = True
            members += [right[columns], left[rows]]
        found = np.concatenate(members)
        label[found] = found.min()
    return label


def _verify(placed: DataFrame, similarity: float) -> DataFrame:
    """(id, links, root) from rows (task, run, a, b, mine, id, copies, leaves, tokens), grouped by task within partitions."""

    def finish(rows: dict[str, list]) -> pa.RecordBatch | None:
        ids = np.array(rows["id"], np.int64)
        _, order = np.unique(ids, return_index=True)  # a repeated row of documents comes twice
        if len(order) < 2:
            return None
        sets = [rows["tokens"][k] for k in order]
        leaves = np.stack([rows["leaves"][k] for k in order])
        copies, mine = np.array(rows["copies"], np.int64)[order], np.array(rows["mine"], np.int64)[order]
        links, label = _compare(sets, leaves, copies, mine, rows["a"][0], rows["b"][0], rows["run"][0], similarity)
        at = np.flatnonzero(links)
        if not len(at):
            return None
        ids = ids[order]
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(ids[label[at]])], ["id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {}
        current = None
        for batch in batches:
            tasks = batch.column("task").to_numpy()
            cuts = np.flatnonzero(np.append(True, tasks[1:] != tasks[:-1])).tolist() + [batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if tasks[i] != current:
                    if rows and (out := finish(rows)) is not None:
                        yield out
                    current, rows = tasks[i], {k: [] for k in ("run", "a", "b", "mine", "id", "copies", "leaves", "tokens")}
                part = batch.slice(i, j - i)
                for k in ("run", "a", "b", "mine", "id", "copies"):
                    rows[k] += part.column(k).to_pylist()
                for k, kind in (("tokens", np.uint64), ("leaves", np.int64)):
                    rows[k] += [np.frombuffer(x, kind) for x in part.column(k).to_pylist()]
        if rows and (out := finish(rows)) is not None:
            yield out

    return placed.mapInArrow(run, "id long, links long, root long")


def _spread(texts: DataFrame, width: int, runs: int) -> DataFrame:
    """One row per set and task, with the set's tokens, from rows (id, h1, h2, text, copies, leaves, tasks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            words, begins = word_hashes(batch.column("text"))
            tasks, leaves = batch.column("tasks").to_pylist(), batch.column("leaves").to_pylist()
            ids, copies, h1, h2 = (batch.column(c).to_pylist() for c in ("id", "copies", "h1", "h2"))
            out, held = {k: [] for k in ("task", "run", "a", "b", "mine", "id", "copies", "leaves", "tokens")}, 0
            for k in range(batch.num_rows):
                tokens = shingles(words[begins[k] : begins[k + 1]], width)
                if _named(tokens) != (h1[k], h2[k]):
                    continue  # another text of the same doc_id
                tokens = tokens.tobytes()
                own = np.array([x or 0 for x in leaves[k]], np.int64).tobytes()
                for t in tasks[k]:
                    for name in ("task", "run", "a", "b", "mine"):
                        out[name].append(t[name])
                    for name, value in (("id", ids[k]), ("copies", copies[k]), ("leaves", own), ("tokens", tokens)):
                        out[name].append(value)
                    held += len(tokens)
                if held > 16_000_000:
                    yield pa.RecordBatch.from_pydict(out, schema)
                    out, held = {name: [] for name in out}, 0
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("task", pa.int64()), ("run", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("mine", pa.int32()), ("id", pa.int64()), ("copies", pa.int64()), ("leaves", pa.binary()), ("tokens", pa.binary())])
    return texts.mapInArrow(run, "task long, run int, a int, b int, mine int, id long, copies long, leaves binary, tokens binary")


def link_classes(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.999, depth: int = 3, limit: int = 64, tile: int = 2048, tile_tokens: int = 3_000_000) -> DataFrame:
    """(doc_id, class_id, n_links): one row per row of docs; only its doc_id and text are read, so other columns may have any names.

    class_id is the smallest doc_id that chains of links reach, n_links the number of other rows whose set is at least
    `similarity` alike (Jaccard). Texts shorter than `width` words are one run of all their words; long texts are compared
    whole. Null texts and texts without words link with nothing and are their own class. Rows without doc_id take no part:
    their class is null. Repeated rows are copies of each other, and different texts under one doc_id are different rows.
    """
    return _classes(docs, similarity, width, recall, depth, limit, tile, tile_tokens).select("doc_id", "class_id", "n_links")


def _classes(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.999, depth: int = 3, limit: int = 64, tile: int = 2048, tile_tokens: int = 3_000_000) -> DataFrame:
    """link_classes with the rows' keys k1, k2 and `class`, which tells classes with one class_id apart (null: a row by itself)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = runs_needed(similarity, depth, recall)
    with scratch(docs.sparkSession):
        sets = saved(_sets(docs, width, runs, depth), "sets")
        known = sets.where("doc_id is not null and size > 0")
        reps = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("paths").alias("paths"))
        # a set is known by h1, and where two sets have one h1, all but the first by another hash
        rank = F.row_number().over(Window.partitionBy("h1").orderBy("h2"))
        reps = saved(reps.withColumn("rank", rank).withColumn("id", F.when(F.col("rank") == 1, F.col("h1")).otherwise(F.xxhash64("h1", "h2"))).drop("rank"), "reps")
        work = saved(_work(_leaves(reps, runs, depth, limit), runs, tile, tile_tokens), "work")
        texts = docs.join(work.join(reps.select("id", "h1", "h2", "doc_id", "copies"), "id"), "doc_id")
        placed = _spread(texts, width, runs).repartition("task").sortWithinPartitions("task")
        found = saved(_verify(placed, similarity), "links")
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        linked = saved(reps.join(labels, "id").select("id", "label", "doc_id"), "linked")
        classes = linked.join(linked.groupBy("label").agg(F.min("doc_id").alias("class_id")), "label").select("id", "class_id", "label")
        result = reps.join(links, "id", "left").join(classes, "id", "left")
        result = result.select("h1", "h2", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("label", "id").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        rest = sets.where("doc_id is null or size = 0").select("doc_id", "k1", "k2", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("class"), F.lit(0).cast("long").alias("n_links"))
        every = known.select("doc_id", "k1", "k2", "h1", "h2").join(result, ["h1", "h2"]).drop("h1", "h2").unionByName(rest)
        return saved(every, "classes", keep=True)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row per class: that of the smallest doc_id (of different texts under it, the one with the smaller hash).

    Rows without doc_id stay, and so do rows without words; of a class's row that docs repeats, one stays. Different
    texts under one doc_id are different rows: each stays unless another row of its own class does.
    """
    classes = _classes(docs, **options).where("class is not null")
    first = saved(classes.groupBy("class").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("f")).select(F.col("f.k1").alias("_k1"), F.col("f.k2").alias("_k2"), F.lit(True).alias("_first")), "first")
    gone = saved(classes.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct(), "classed").join(first, ["_k1", "_k2"], "left")
    k1, k2 = row_key("doc_id", "text")
    marked = docs.withColumns({"_k1": k1, "_k2": k2}).join(gone.withColumn("_classed", F.lit(True)), ["_k1", "_k2"], "left")
    alone = marked.where("_classed is null").select(docs.columns)
    one = marked.where("_first").groupBy("_k1", "_k2").agg(*[F.first(c).alias(c) for c in docs.columns]).select(docs.columns)
    return one.unionByName(alone)


def query(spark, sf_dir: str) -> DataFrame:
    return link_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
