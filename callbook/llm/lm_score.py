"""LM scoring by masked pseudo-likelihood.

Each token is predicted from the `WINDOW` tokens on both of its sides, itself masked: one embedding per context word
and position, summed and passed through tanh, gives a softmax over word classes and, within the token's class, a softmax
over the class's words; both see both sides. Words without an id of their own share hashed buckets, which are predicted
like words; such a word's probability is its bucket's times its share of the bucket. A document's score is the sum of
these conditional log-probabilities.

What is learned comes from all documents and grows with them. Spark counts every distinct word. The vocabulary of words
with ids grows with the cube root of the number of tokens (12 N^(1/3): 5,200 at 80 million, 300,000 at 10^13), and so do
the buckets and, as its square root, the classes, which split the ids by frequency into equal masses. Every other word's
share of its bucket is its own count in the corpus: the most frequent counts (`COUNTED`, which only says where a count is
looked up) go to the tasks, the others stay a Spark table that scoring joins; one more per bucket is left for words that
the corpus doesn't have. What stays as it is at every size: `hidden` units, the window and the number of rounds.

The network is trained in numpy by local stochastic gradient descent: every task passes over its documents from the same
start, and the parameters are averaged, weighted by tokens, for each of `rounds` rounds: by groups of tasks on the
executors, and group by group in the driver. So the parameters depend a little on how rows are dealt to tasks, as with
any stochastic training; scores of one model do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import map_arrow, row_key, saved, slices, word_hashes

WINDOW = 2
OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]
COUNTED = 1 << 18
_STEP = 8192  # tokens per gradient step


@dataclass
class Words:
    """Ids of words and buckets, most frequent first, so that a class's ids follow each other."""

    top: np.ndarray  # sorted hashes of words with ids of their own
    top_ids: np.ndarray
    bucket_ids: np.ndarray
    mass: np.ndarray  # occurrences of each id; a bucket's with one more
    begins: np.ndarray  # the first id of each class, and the end
    counted: np.ndarray  # sorted hashes of the most frequent words
    counted_n: np.ndarray

    @property
    def pad(self) -> int:
        """The id that stands beyond the ends of a text."""
        return len(self.mass)

    @property
    def classes(self) -> int:
        return len(self.begins) - 1

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.classes), np.diff(self.begins))

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's id, and whether it is its own."""
        out = self.bucket_ids[(hashes & np.uint64(len(self.bucket_ids) - 1)).astype(np.int64)]
        if not len(self.top):
            return out, np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
        own = self.top[at] == hashes
        return np.where(own, self.top_ids[at], out), own

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Occurrences of words in the corpus, 0 where they are not held here."""
        if not len(self.counted):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.counted, hashes), len(self.counted) - 1)
        return np.where(self.counted[at] == hashes, self.counted_n[at], 0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every distinct word."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, n = np.unique(word_hashes(batch.column("text"))[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    return saved(map_arrow(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of the most frequent words, in order, ties whole (at most `most`, or a single tie of as many), and all tokens."""
    sizes = counts.groupBy("n").count().toPandas().sort_values("n", ascending=False)  # as many rows as there are different counts
    tokens = int((sizes["n"] * sizes["count"]).sum()) if len(sizes) else 0
    total = sizes["count"].cumsum()
    fits = sizes["n"][total <= most]
    if not len(fits):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), tokens
    rows = counts.where(F.col("n") >= int(fits.iloc[-1])).toPandas().sort_values(["n", "word"], ascending=[False, True])
    return rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), tokens


def count_words(docs: DataFrame, vocabulary: int | None = None, buckets: int | None = None, classes: int | None = None, counts: DataFrame | None = None) -> Words:
    """counts: word_counts(docs), if made already. Sizes follow the number of tokens unless given (buckets: a power of two)."""
    counts = word_counts(docs) if counts is None else counts
    word, n, tokens = _frequent(counts, COUNTED)
    vocabulary = max(2000, math.ceil(12 * tokens ** (1 / 3))) if vocabulary is None else vocabulary
    buckets = 1 << max(6, int(vocabulary / 24).bit_length()) if buckets is None else buckets
    if vocabulary > COUNTED:
        word, n, _ = _frequent(counts, vocabulary)
    hashes, own = word[:vocabulary], n[:vocabulary]
    rest = np.ones(buckets, np.int64)
    for r in counts.groupBy(F.col("word").bitwiseAND(buckets - 1).alias("b")).agg(F.sum("n").alias("n")).collect():
        rest[r["b"]] += r["n"]
    np.subtract.at(rest, (hashes & np.uint64(buckets - 1)).astype(np.int64), own)
    mass = np.concatenate([own, rest])
    order = np.argsort(-mass, kind="stable")
    place = np.empty(len(mass), np.int64)
    place[order] = np.arange(len(mass))
    mass = mass[order].astype(float)
    classes = math.ceil(math.sqrt(len(mass))) if classes is None else classes
    class_of = np.minimum((np.cumsum(mass) - mass) * classes / mass.sum(), classes - 1).astype(np.int64)
    begins = np.searchsorted(class_of, np.unique(class_of))  # classes that a frequent word leaves empty fall away
    by_hash, by_count = np.argsort(hashes), np.argsort(word)
    return Words(hashes[by_hash], place[by_hash], place[len(hashes) :], mass, np.append(begins, len(mass)), word[by_count], n[by_count])


def _contexts(ids: np.ndarray, begins: np.ndarray, pad: int) -> np.ndarray:
    """Ids at each offset around each token (rows), `pad` beyond its text."""
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    out = np.full((len(OFFSETS), len(ids)), pad, np.int64)
    for k, o in enumerate(OFFSETS):
        if abs(o) >= len(ids):
            continue
        to, of = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
        out[k, to] = np.where(doc[to] == doc[of], ids[of], pad)
    return out


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(z - row maximum), in place, with the rows' sums and maxima."""
    top = z.max(1, keepdims=True)
    z -= top
    np.exp(z, out=z)
    return z, z.sum(1, keepdims=True), top


def _logits(hidden: np.ndarray, out: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = hidden @ out
    z += bias
    return z


def _log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of each row at one place."""
    own = z[np.arange(len(z)), at]
    _, total, top = _exp(z)
    return own - (np.log(total) + top)[:, 0]


def _less_target(z: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The gradient of a mean log loss over n tokens: softmax less the target."""
    e, total, _ = _exp(z)
    e /= total * n
    e[np.arange(len(z)), at] -= 1 / n
    return e


class Network:
    """Context embeddings per offset, tanh, a softmax over classes and one over each class's words."""

    def __init__(self, mass: np.ndarray, begins: np.ndarray, hidden: int):
        """Starts from the shares of classes and of words in them, whatever the context."""
        rng = np.random.default_rng(3)
        self.begins, words = begins, len(mass)
        self.class_of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        by_class = np.add.reduceat(mass, begins[:-1])
        self.embed = (rng.normal(size=(words + 1, len(OFFSETS), hidden)) * 0.1).astype(np.float32)
        self.out = (rng.normal(size=(hidden, len(by_class))) * 0.1).astype(np.float32)
        self.bias = np.log(by_class / mass.sum()).astype(np.float32)
        self.word_out = np.zeros((words, hidden), np.float32)
        self.word_bias = np.log(mass / by_class[self.class_of]).astype(np.float32)

    def values(self) -> list[np.ndarray]:
        return [self.embed, self.out, self.bias, self.word_out, self.word_bias]

    def parameters(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for v in self.values():
            v[...] = flat[at : at + v.size].reshape(v.shape)
            at += v.size

    def hidden(self, context: np.ndarray) -> np.ndarray:
        rows = self.embed.reshape(-1, self.embed.shape[2])
        total = np.take(rows, context[0] * len(OFFSETS), 0)
        for k in range(1, len(OFFSETS)):
            total += np.take(rows, context[k] * len(OFFSETS) + k, 0)
        return np.tanh(total, out=total)

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """Tokens in the order of their classes, and of each class that occurs its first and last id and its tokens' places in that order."""
        kind = self.class_of[target]
        order = np.argsort(kind.astype(np.int16) if len(self.begins) < 32768 else kind, kind="stable")
        ends = np.cumsum(np.bincount(kind, minlength=len(self.begins) - 1))
        starts = np.append(0, ends[:-1])
        return order, [(int(self.begins[c]), int(self.begins[c + 1]), int(starts[c]), int(ends[c])) for c in np.flatnonzero(ends > starts)]

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target id in its context."""
        hidden = self.hidden(context)
        found = _log_share(_logits(hidden, self.out, self.bias), self.class_of[target]).astype(np.float64)
        order, classes = self._by_class(target)
        near, wanted, within = np.take(hidden, order, 0), target[order], np.zeros(len(target))
        for a, b, i, j in classes:
            if b - a > 1:
                within[i:j] = _log_share(_logits(near[i:j], self.word_out[a:b].T, self.word_bias[a:b]), wanted[i:j] - a)
        found[order] += within
        return found

    def step(self, ids: np.ndarray, around: np.ndarray, lo: int, hi: int, memory: list[np.ndarray], rate: float) -> None:
        """One AdaGrad step on the tokens lo to hi of texts with these ids and contexts."""
        n, target, context = hi - lo, ids[lo:hi], around[:, lo:hi]
        hidden = self.hidden(context)
        d = _less_target(_logits(hidden, self.out, self.bias), self.class_of[target], n)
        back = d @ self.out.T
        order, classes = self._by_class(target)
        near, wanted, behind = np.take(hidden, order, 0), target[order], np.zeros_like(back)
        words, bias = np.zeros_like(self.word_out), np.zeros_like(self.word_bias)
        for a, b, i, j in classes:
            if b - a > 1:
                e = _less_target(_logits(near[i:j], self.word_out[a:b].T, self.word_bias[a:b]), wanted[i:j] - a, n)
                np.matmul(e, self.word_out[a:b], out=behind[i:j])
                np.matmul(e.T, near[i:j], out=words[a:b])
                bias[a:b] = e.sum(0)
        back[order] += behind
        back *= 1 - hidden * hidden
        self._learn_contexts(ids, around, lo, hi, back, memory[0], rate)
        for value, squares, grad in zip(self.values()[1:], memory[1:], (hidden.T @ d, d.sum(0), words, bias), strict=True):
            self._move(value, ..., squares, grad, rate)

    def _learn_contexts(self, ids: np.ndarray, around: np.ndarray, lo: int, hi: int, back: np.ndarray, squares: np.ndarray, rate: float) -> None:
        """The embeddings that the tokens lo to hi have read: those of the words from a to b, sorted once for all offsets, and of the pad."""
        pad, (a, b) = len(self.embed) - 1, (max(0, lo - WINDOW), min(len(ids), hi + WINDOW))
        grad, beyond = np.zeros((b - a, *self.embed.shape[1:]), np.float32), np.zeros((1, *self.embed.shape[1:]), np.float32)
        for k, o in enumerate(OFFSETS):
            i, j = max(lo, a - o), min(hi, b - o)  # tokens whose neighbour at this offset is among a to b
            inside = (around[k, i:j] != pad)[:, None]
            grad[i + o - a : j + o - a, k] = back[i - lo : j - lo] * inside
            beyond[0, k] = back[around[k, lo:hi] == pad].sum(0)
        near = ids[a:b]
        order = np.argsort(near, kind="stable")
        word = near[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sums = np.add.reduceat(np.take(grad.reshape(b - a, -1), order, 0), first).reshape(-1, *self.embed.shape[1:])
        self._move(self.embed, word[first], squares, sums, rate)
        self._move(self.embed, slice(pad, None), squares, beyond, rate)

    @staticmethod
    def _move(value: np.ndarray, at, squares: np.ndarray, grad: np.ndarray, rate: float) -> None:
        total = squares[at] + grad * grad
        squares[at] = total
        value[at] -= np.float32(rate) * grad / (np.sqrt(total) + np.float32(1e-6))


def train(docs: DataFrame, words: Words, hidden: int, rounds: int, rate: float) -> np.ndarray:
    flat = Network(words.mass, words.begins, hidden).parameters()
    context = docs.sparkSession.sparkContext
    texts = docs.select("text")
    groups = math.ceil(math.sqrt(texts.rdd.getNumPartitions())) + 1
    lean = replace(words, counted=words.counted[:0], counted_n=words.counted_n[:0])
    for _ in range(rounds):
        start = context.broadcast((lean, flat))

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            known, begin = start.value
            net, seen = Network(known.mass, known.begins, hidden), 0
            net.load(begin)
            memory = [np.full_like(v, 1e-4) for v in net.values()]
            for batch in batches:
                hashes, begins = word_hashes(batch.column("text"))
                ids, _ = known.ids(hashes)
                around = _contexts(ids, begins, known.pad)
                for i in range(0, len(ids), _STEP):
                    net.step(ids, around, i, min(i + _STEP, len(ids)), memory, rate)
                seen += len(ids)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([net.parameters().tobytes()]), pa.array([seen])], ["parameters", "tokens"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = 0, 0
            for batch in batches:
                for flat, n in zip(batch.column("parameters"), batch.column("tokens").to_pylist(), strict=True):
                    total, seen = total + n * np.frombuffer(flat.as_py(), np.float32).astype(np.float64), seen + n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([(total / seen).astype(np.float32).tobytes()]), pa.array([seen])], ["parameters", "tokens"])

        schema = "parameters binary, tokens long"
        passed = texts.mapInArrow(run, schema).repartition(groups).mapInArrow(merge, schema)
        total, seen = np.zeros(len(flat)), 0
        for row in passed.toLocalIterator():  # one group's parameters at a time
            total, seen = total + row["tokens"] * np.frombuffer(row["parameters"], np.float32).astype(np.float64), seen + row["tokens"]
        if seen:
            flat = (total / seen).astype(np.float32)
        start.unpersist()
    return flat


@dataclass
class LanguageModel:
    words: Words
    parameters: np.ndarray
    hidden: int
    counts: DataFrame | None  # of all words

    def network(self) -> Network:
        net = Network(self.words.mass, self.words.begins, self.hidden)
        net.load(self.parameters)
        return net


def learn(docs: DataFrame, vocabulary: int | None = None, buckets: int | None = None, classes: int | None = None, hidden: int = 16, rounds: int = 1, rate: float = 0.05) -> LanguageModel:
    """A model of all texts (null texts are empty, repeated rows count each). A corpus without words gives a model that knows none."""
    counts = word_counts(docs)
    words = count_words(docs, vocabulary, buckets, classes, counts)
    return LanguageModel(words, train(docs, words, hidden, rounds, rate), hidden, counts)


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with n_tokens, log_prob (natural, summed over tokens) and mean_log_prob (null without tokens).

    Null texts and texts without words have no tokens and log_prob 0; long texts are scored whole; repeated rows get the
    same result each. Columns named like the results are replaced.
    """
    docs = docs.drop("n_tokens", "log_prob", "mean_log_prob")
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, counts=None))
    k1, k2 = row_key(*[c for c in ("doc_id", "text") if c in docs.columns])
    keyed = docs.select("text", k1.alias("_k1"), k2.alias("_k2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = shared.value.words, shared.value.network()
        for batch in (part for whole in batches for part in slices(whole)):
            hashes, begins = word_hashes(batch.column("text"))
            ids, own = words.ids(hashes)
            around = _contexts(ids, begins, words.pad)
            each = np.zeros(len(ids))
            for i in range(0, len(ids), _STEP):
                each[i : i + _STEP] = net.log_prob(around[:, i : i + _STEP], ids[i : i + _STEP])
            # a word in a bucket: its count, held here or looked up by the join, over the bucket's
            other = np.flatnonzero(~own)
            n = words.counts(hashes[other])
            each[other] += np.log(np.maximum(n, 1)) - np.log(words.mass[ids[other]])
            sums = np.concatenate([[0.0], np.cumsum(each)])
            size = np.diff(begins)
            total = np.where(size > 0, sums[begins[1:]] - sums[begins[:-1]], 0.0)
            rare = other[n == 0]
            cuts = np.searchsorted(rare, begins)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes[rare].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_k1"), batch.column("_k2"), pa.array(size), pa.array(total), lists], ["_k1", "_k2", "n_tokens", "log_prob", "rare"])

    scored = keyed.mapInArrow(run, "_k1 long, _k2 long, n_tokens long, log_prob double, rare array<long>")
    scored = saved(scored, "scored")
    # repeated rows share their keys
    once = scored.groupBy("_k1", "_k2").agg(F.first("n_tokens").alias("n_tokens"), F.first("log_prob").alias("log_prob"), F.count(F.lit(1)).alias("_copies"))
    rare = scored.select("_k1", "_k2", F.explode("rare").alias("word")).join(model.counts, "word")
    rare = rare.groupBy("_k1", "_k2").agg(F.sum(F.log("n")).alias("_more"))
    found = once.join(rare, ["_k1", "_k2"], "left")
    found = found.withColumn("log_prob", F.col("log_prob") + F.coalesce(F.col("_more") / F.col("_copies"), F.lit(0.0))).drop("_more", "_copies")
    out = docs.withColumns({"_k1": k1, "_k2": k2}).join(found, ["_k1", "_k2"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, learn(docs)).select("doc_id", "n_tokens", "log_prob", "mean_log_prob")
