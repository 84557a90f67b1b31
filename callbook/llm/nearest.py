"""Approximate nearest neighbours: a graph by NN-descent (Dong et al., 2011), searched greedily.

Equal vectors are one node of the graph; a node keeps as many of its vec_ids as a result can hold. Nodes are dealt by
hash to shards of about `shard_rows` (a bounded number of bounded groups per machine, as many shards as the input
needs), and each shard gets a graph of its own.

Building: every node begins with `degree` neighbours by chance. A round joins the edges, in both directions, with
themselves: a neighbour's neighbours are candidates. Spark's join makes the candidates and groups them by node; each
shard then compares its nodes with their candidates on the vectors and keeps the `degree` best. Only paths with an
edge that is new since the last round give candidates. Rounds end when few edges change, or after `rounds`.

Searching: a query enters each shard's graph at nodes of all its connected parts (and at itself, if it is a node there), keeps
the `beam` best nodes seen, and expands the best unexpanded ones, some at a time, until the best `beam` are all expanded. All
queries of a block move in lockstep in numpy. Results of the shards are merged.

Larger inner product is nearer. For vectors of unequal length, neighbours in the graph are by the angle after one more
component makes all of a shard's vectors equally long, so that long vectors are no hubs; searches use the inner product itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callbook.llm.common import saved


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and a vector of finite components that are not all zero.

    Of different vectors under one vec_id the first in order counts.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where("vec_id is not null and vector is not null").where(fine)
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _nodes(rows: DataFrame, ids_kept: int, shards: int) -> DataFrame:
    """One node per distinct vector: (shard, node, vector, ids), node being its smallest vec_id."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    kept = rows.withColumn("rank", rank).where(F.col("rank") <= ids_kept)
    nodes = kept.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # vectors of another dimension are compared among themselves only
    return nodes.select((F.size("vector") * F.lit(1 << 32) + F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(shards))).alias("shard"), F.get("ids", F.lit(0)).alias("node"), "vector", "ids")


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    """Vectors of a shard, lengthened to equal length by one more component."""
    x = np.stack(pdf["vector"].to_numpy()).astype(np.float32)
    square = (x * x).sum(1)
    return np.hstack([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]]).astype(np.float32)


def _improve(nodes: pd.DataFrame, offers: pd.DataFrame, degree: int) -> pd.DataFrame:
    """The best neighbours of each node of a shard among its present ones and its candidates."""
    columns = ["shard", "node", "near", "fresh", "changed"]
    if not len(nodes) or not len(offers):
        return pd.DataFrame({c: [] for c in columns})
    nodes = nodes.sort_values("node")
    x, ids = _matrix(nodes), nodes["node"].to_numpy()
    own, near, fresh, changed = [], [], [], []
    for node, old, offered in zip(offers["node"], offers["near"], offers["offered"], strict=True):
        old = np.asarray(old, np.int64)
        every = np.unique(np.concatenate([old, np.asarray(offered, np.int64)]))
        every = every[every != node]
        at = np.searchsorted(ids, every)
        me = np.searchsorted(ids, node)
        s = x[at] @ x[me]
        take = np.argpartition(-s, degree - 1)[:degree] if len(s) > degree else np.arange(len(s))
        best = every[take]
        new = ~np.isin(best, old)
        own.append(node)
        near.append(best)
        fresh.append(new)
        changed.append(int(new.sum()))
    return pd.DataFrame({"shard": nodes["shard"].iloc[0], "node": own, "near": near, "fresh": fresh, "changed": changed})


_GRAPH = "shard long, node long, near array<long>, fresh array<boolean>, changed int"


def _start(nodes: DataFrame, degree: int) -> DataFrame:
    """Every node's first neighbours, by chance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf["node"].to_numpy())
        n, rng = len(ids), np.random.default_rng(17)
        k = min(degree, n - 1)
        near = [ids[(i + 1 + rng.choice(n - 1, k, replace=False)) % n] if k else ids[:0] for i in range(n)]
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "node": ids, "near": near, "fresh": [np.ones(k, bool)] * n, "changed": k})

    return nodes.select("shard", "node").groupBy("shard").applyInPandas(run, _GRAPH)


def build_graph(nodes: DataFrame, degree: int = 24, rounds: int = 8, settled: float = 0.02) -> DataFrame:
    """(shard, node, near): each node's neighbours in its shard, from nodes (shard, node, vector)."""
    graph = saved(_start(nodes, degree), "graph")
    for _ in range(rounds):
        edges = graph.select("shard", "node", F.explode(F.arrays_zip(F.col("near").alias("near"), F.col("fresh").alias("fresh"))).alias("e")).select("shard", "node", F.col("e.near").alias("near"), F.col("e.fresh").alias("fresh"))
        ways = edges.unionByName(edges.select("shard", F.col("near").alias("node"), F.col("node").alias("near"), "fresh"))
        ways = ways.groupBy("shard", "node", "near").agg(F.max("fresh").alias("fresh"))
        lists = ways.groupBy("shard", "node").agg(F.collect_list("near").alias("all"), F.collect_list(F.when(F.col("fresh"), F.col("near"))).alias("new"))
        lists = saved(lists, "lists")
        # node -> via -> neighbours of via; over a new first edge all of them, over an old one the new ones
        via = lists.select("shard", F.col("node").alias("via"), F.col("all").alias("all"), F.col("new").alias("new"))
        steps = lists.select("shard", "node", F.explode("all").alias("via"), "new").select("shard", "node", "via", F.array_contains("new", F.col("via")).alias("fresh"))
        offers = steps.join(via, ["shard", "via"]).select("shard", "node", F.when(F.col("fresh"), F.col("all")).otherwise(F.col("new")).alias("some")).where(F.size("some") > 0)
        offers = offers.groupBy("shard", "node").agg(F.array_distinct(F.flatten(F.collect_list("some"))).alias("offered"))
        offers = graph.select("shard", "node", "near").join(offers, ["shard", "node"], "left").withColumn("offered", F.coalesce("offered", F.array().cast("array<long>")))
        kept = nodes.select("shard", "node", "vector").groupBy("shard").cogroup(offers.groupBy("shard"))
        graph = saved(kept.applyInPandas(lambda a, b: _improve(a, b, degree), _GRAPH), "graph")
        moved = graph.agg(F.sum("changed").alias("changed"), F.count(F.lit(1)).alias("n")).first()
        if (moved["changed"] or 0) <= settled * degree * moved["n"]:
            break
    return graph.select("shard", "node", "near")


def _entries(links: np.ndarray, least: int) -> np.ndarray:
    """Nodes at which searches enter a shard's graph: some in each of its connected parts, more in larger ones.

    The graph of clustered vectors falls apart into its clusters, and greedy steps never leave a part.
    """
    n = len(links)
    part = np.arange(n)
    while True:
        lower = np.minimum(part, part[links].min(1))
        lower = lower[lower]
        if np.array_equal(lower, part):
            break
        part = lower
    order = np.argsort(part, kind="stable")
    firsts = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
    every = np.linspace(0, n - 1, min(n, max(least, 2 * math.isqrt(n)))).astype(np.int64)
    return order[np.union1d(firsts, every)]


_TOGETHER = 16  # nodes that a search expands in one step


def _walk(ids: np.ndarray, x: np.ndarray, x32: np.ndarray, links: np.ndarray, start: np.ndarray, queries: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    """Greedy search of a block of queries from the nodes in start, over links (a row of neighbours per node)."""
    q = np.stack(queries["vector"].to_numpy())
    q32, m, n = q.astype(np.float32), len(q), len(ids)
    beam, rows = min(max(beam, k), n), np.arange(m)
    mine = np.minimum(np.searchsorted(ids, queries["node"].to_numpy()), n - 1)
    first = np.concatenate([np.repeat(start[None, :], m, 0), np.where(ids[mine] == queries["node"].to_numpy(), mine, 0)[:, None]], 1)
    seen = np.zeros(m * n, bool)
    stamp = np.empty(m * n, np.int32)
    near = np.full((m, beam), -1)
    score = np.full((m, beam), -np.inf, np.float32)
    done = np.ones((m, beam), bool)

    def offer(who: np.ndarray, nodes: np.ndarray) -> None:
        """Take nodes (a row per query in who) into the beams of these queries. Each is compared once, when first seen."""
        at = (who[:, None] * n + nodes).ravel()
        at = at[~seen[at]]
        place = np.arange(len(at), dtype=np.int32)
        stamp[at] = place
        at = at[stamp[at] == place]
        seen[at] = True
        row, node = np.divmod(at, n)  # rows of one query are together, in the order of who
        s = np.einsum("ij,ij->i", x32[node], q32[row])
        better = s > score.min(1)[row]
        row, node, s = row[better], node[better], s[better]
        if not len(row):
            return
        firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        size = np.diff(np.append(firsts, len(row)))
        some, line = row[firsts], np.repeat(np.arange(len(firsts)), size)
        shape, column = (len(firsts), size.max()), beam + np.arange(len(row)) - np.repeat(firsts, size)
        scores = np.concatenate([score[some], np.full(shape, -np.inf, np.float32)], 1)
        nodes = np.concatenate([near[some], np.full(shape, -1)], 1)
        past = np.concatenate([done[some], np.ones(shape, bool)], 1)
        scores[line, column], nodes[line, column], past[line, column] = s, node, False
        best = np.argpartition(-scores, beam - 1, 1)[:, :beam]
        score[some], near[some], done[some] = (np.take_along_axis(v, best, 1) for v in (scores, nodes, past))

    offer(rows, first)
    active, together = rows, max(1, min(_TOGETHER, beam, 1024 // links.shape[1]))  # fewer where a node has very many neighbours
    while len(active):
        open_ = np.where(done[active], -np.inf, score[active])
        at = np.argpartition(-open_, together - 1, 1)[:, :together]
        going = ~np.isneginf(np.take_along_axis(open_, at, 1))
        left = going.any(1)
        active, at, going = active[left], at[left], going[left]
        if not len(active):
            break
        expand = np.where(going, near[active[:, None], at], near[active, at[np.arange(len(active)), going.argmax(1)]][:, None])
        done[active[:, None], at] = True
        offer(active, links[expand].reshape(len(active), -1))
    take = min(k, beam)
    best = np.argpartition(-score, take - 1, 1)[:, :take]
    hit = np.take_along_axis(near, best, 1)
    row, col = np.nonzero(~np.isneginf(np.take_along_axis(score, best, 1)))
    found = hit[row, col]
    exact = (x[found] * q[row]).sum(1)  # double precision, the same sum for equal vectors
    return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[row], "node": ids[found], "score": exact})


def _search(pdf: pd.DataFrame, queries: pd.DataFrame, k: int, beam: int, entries: int, block: int = 512) -> pd.DataFrame:
    """Greedy search of queries in one shard's graph, in lockstep by blocks."""
    out = pd.DataFrame({"query_id": [], "node": [], "score": []})
    if not len(pdf) or not len(queries):
        return out
    pdf = pdf.sort_values("node")
    ids = pdf["node"].to_numpy()
    x = np.stack(pdf["vector"].to_numpy())
    x32, n = x.astype(np.float32), len(pdf)
    # neighbours both ways, as rows padded with the node itself
    own = np.repeat(np.arange(n), pdf["near"].map(len))
    to = np.searchsorted(ids, np.concatenate([np.asarray(v, np.int64) for v in pdf["near"]])) if len(own) else own
    pairs = np.unique(np.concatenate([own * n + to, to * n + own]))
    own, to = pairs // n, pairs % n
    count = np.bincount(own, minlength=n)
    links = np.repeat(np.arange(n)[:, None], max(1, count.max(initial=1)), 1)
    links[own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)] = to
    start = _entries(links, entries)
    found = [_walk(ids, x, x32, links, start, queries.iloc[i : i + block], k, beam) for i in range(0, len(queries), block)]
    return pd.concat(found, ignore_index=True)


def _parts(queries: int, shards: int, cores: int, block: int, most: int = 32) -> int:
    """Parts of the queries: at most `most` blocks each, and more where there are fewer than four tasks a core; none below a block.

    Every part meets a copy of every shard, so more parts than that would only be more to shuffle.
    """
    blocks = math.ceil(queries / block)
    return max(1, min(blocks, max(math.ceil(blocks / most), math.ceil(4 * cores / max(1, shards)))))


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, k: int, beam: int = 220, entries: int = 12, block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (query_id, node, vector), its own row left out.

    Queries go to every shard of their dimension in parts; a shard's graph goes to as many tasks as there are parts.
    """
    shards = saved(nodes.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")), "shards")
    blocks = _parts(queries.count(), shards.count(), nodes.sparkSession.sparkContext.defaultParallelism, block)
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("vector").cast("long"))
    to = dealt.join(shards.select("shard", F.expr("shard div 4294967296").alias("dim")), "dim").drop("dim")
    whole = nodes.join(graph, ["shard", "node"]).select("shard", "node", "vector", "near", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = whole.groupBy("shard", "block").cogroup(to.groupBy("shard", "block")).applyInPandas(lambda a, b: _search(a, b, k + 1, beam, entries, block), "query_id long, node long, score double")
    # the best nodes hold the best ids: each brings at most k + 1 of its own
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")
    nodes_found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    rows = nodes_found.join(nodes.select("node", "ids"), "node").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, degree: int = 24, shard_rows: int = 4096, beam: int = 220) -> DataFrame:
    """The k nearest found of each row whose vec_id is divisible by `every`, among all other rows.

    Rows without an id, and vectors that are null, zero or hold null or non-finite components, take no part; of rows
    that repeat a vec_id the one with the least vector counts (compared component by component). Fewer than k other rows give as many results. Vectors of different dimensions do
    not compare. Ties go to the smaller vec_id.
    """
    rows = saved(usable(vectors), "vectors")
    n = rows.count()
    nodes = saved(_nodes(rows, k + 1, max(1, math.ceil(n / shard_rows))), "nodes")
    graph = build_graph(nodes, degree)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumnRenamed("vec_id", "query_id")
    # a query's node is that of its vector; only ids kept by a node tell it, any other entry serves as well
    own = nodes.select(F.explode("ids").alias("query_id"), "node")
    asked = saved(asked.join(own, "query_id", "left").withColumn("node", F.coalesce("node", F.lit(-1))), "queries")
    return search(nodes, graph, asked, k, beam)


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
