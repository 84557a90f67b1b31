"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios (after Wang and Manning, 2012).

Learning: every labelled training row yields its distinct hashed character n-grams; document counts per n-gram and
class are summed over all of them in Spark. An n-gram's scale is its smoothed log-count ratio; n-grams whose ratio is
less than `min_z` standard errors from 0 are left out, so rare n-grams of long texts add no noise. A logistic
regression over the scaled features is then fitted in numpy on `fit_rows` labelled rows (all, if fewer) taken by a hash of the id.

Scoring: one pass over whole texts. A feature is n-gram occurrences per thousand n-grams, times its ratio and weight.
The model that tasks receive is one float per hash bucket (1 MB), whatever the input's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import map_arrow, saved, schema_with, texts_of

SIZES = (3, 4, 5, 6)
BITS = 18
GAP = "\x00" * max(SIZES)
_CODE = np.random.default_rng(77).integers(1, 2**32, 65536, dtype=np.uint32) | np.uint32(1)
_SMOOTH = 0.2  # of a thousand n-grams: keeps very short texts from extreme densities


def _ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hash buckets of all character n-grams, one array per size, and where each text begins in them.

    Texts stand apart by a gap as wide as the longest n-gram, so that none spans two texts.
    """
    codes = [f" {t.lower()} {GAP}".encode("utf-16-le", "surrogatepass") for t in texts]
    begins = np.cumsum([0] + [len(c) // 2 for c in codes])
    x = _CODE[np.frombuffer(b"".join(codes), np.uint16)]
    h, out = x, []
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x9E3779B1) + x[n - 1 :]
        if n in SIZES:
            out.append(((h ^ np.uint32(n * 0x5EBCA6B)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    return out, begins


def _grams_of(grams: list[np.ndarray], a: int, b: int) -> np.ndarray:
    end = b - len(GAP)  # its own text only
    return np.concatenate([g[a : max(a, end - n + 1)] for g, n in zip(grams, SIZES, strict=True)])


def _chunks(texts: list[str], most: int = 1_000_000):
    """Runs of texts of about `most` characters; a longer text stands alone."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


@dataclass
class ToxicityModel:
    """weights: by hash bucket, ratio times weight; bias: of the logistic function."""

    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, j in _chunks(texts):
            grams, begins = _ngrams(texts[i:j])
            total = np.zeros(int(begins[-1]), np.float32)
            size, ends = np.diff(begins) - len(GAP), begins[1:] - len(GAP)
            for g, k in zip(grams, SIZES, strict=True):
                w = self.weights[g]
                across = ends[:, None] + np.arange(1 - k, len(GAP))  # they reach into the gap
                w[across[(across >= 0) & (across < len(w))]] = 0
                total[: len(w)] += w
            n = sum(np.maximum(size - k + 1, 0) for k in SIZES)
            z = np.add.reduceat(total.astype(np.float64), begins[:-1]) / (n / 1000 + _SMOOTH) + self.bias
            out[i:j] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _counts(training: DataFrame) -> DataFrame:
    """Documents of each class that hold each n-gram, over all training rows."""

    def run(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            texts, labels = texts_of(batch.column("text")), batch.column("label").to_numpy(zero_copy_only=False)
            for i, j in _chunks(texts):
                grams, begins = _ngrams(texts[i:j])
                for k in range(i, j):
                    y = int(labels[k])
                    counts[y, np.unique(_grams_of(grams, begins[k - i], begins[k - i + 1]))] += 1
                    rows[y] += 1
        held = np.flatnonzero(counts.any(0))
        bucket = np.append(held, -1)  # -1: the rows themselves
        if rows.any():
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(np.append(counts[0, held], rows[0])), pa.array(np.append(counts[1, held], rows[1]))], ["bucket", "clean", "toxic"])

    parts = training.select("text", "label").mapInArrow(run, "bucket long, clean long, toxic long")
    return parts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _features(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """Per row of the sample, occurrences of the chosen n-grams per thousand, as sparse arrays."""
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, at, value = texts_of(batch.column("text")), [], []
        for i, j in _chunks(texts):
            grams, begins = _ngrams(texts[i:j])
            for k in range(i, j):
                g = _grams_of(grams, begins[k - i], begins[k - i + 1])
                p = place[g]
                ids, n = np.unique(p[p >= 0], return_counts=True)
                at.append(ids)
                value.append(n / (len(g) / 1000 + _SMOOTH))
        return pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), batch.column("label").cast(pa.int32())], ["at", "value", "label"])

    return map_arrow(sample.select("text", "label"), run, "at array<int>, value array<float>, label int")


def _fit(rows: pa.Table, scale: np.ndarray, bias: float, steps: int = 300, l2: float = 1e-4, most: int = 1_000_000) -> tuple[np.ndarray, float]:
    """Logistic regression over the scaled features by full-batch Adam, from zero weights. Each step sums the gradient over
    parts of rows with about `most` values, so what is held besides is 8 bytes for each value of the sample."""
    at, value = (rows.column(c).combine_chunks() for c in ("at", "value"))
    size = pc.list_value_length(at).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.append(0, np.cumsum(size))
    col, x = at.flatten().to_numpy(), value.flatten().to_numpy()
    y = rows.column("label").to_numpy().astype(float)
    cuts = np.unique(np.append(np.searchsorted(begins, np.arange(0, begins[-1], most)), len(y)))
    parts = [(int(i), int(j)) for i, j in zip(np.append(0, cuts[:-1]), cuts, strict=True) if j > i]
    w = np.zeros(len(scale) + 1)
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        scaled, g = w[:-1] * scale, np.zeros_like(w)
        for i, j in parts:
            a, b = begins[i], begins[j]
            z = np.full(j - i, w[-1])
            some = size[i:j] > 0
            if some.any():
                z[some] += np.add.reduceat(x[a:b] * scaled[col[a:b]], (begins[i:j] - a)[some])
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i:j]) / len(y)
            g[:-1] += np.bincount(col[a:b], x[a:b] * np.repeat(e, size[i:j]), len(scale))
            g[-1] += e.sum()
        g[:-1] = g[:-1] * scale + l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(training: DataFrame, fit_rows: int = 3000, min_z: float = 3.5, min_docs: int = 3) -> ToxicityModel:
    """Model from rows (doc_id, text, label 0/1); null labels are left out, null text counts as empty.

    fit_rows bounds the regression's sample; counts, ratios and the choice of n-grams come from all rows. With rows of
    one class only, or none, the model gives every text the smoothed share of label 1.
    """
    training = saved(training.where(F.col("label").isin(0, 1)).select("doc_id", "text", "label"), "labelled")
    counts = _counts(training).toPandas()  # at most 2**BITS rows
    rows = counts[counts["bucket"] < 0]
    clean, toxic = (int(rows["clean"].sum()), int(rows["toxic"].sum())) if len(rows) else (0, 0)
    weights = np.zeros(1 << BITS, np.float32)
    bias = float(np.log((toxic + 1) / (clean + 1)))
    counts = counts[counts["bucket"] >= 0].sort_values("bucket")
    p, q = counts["toxic"].to_numpy(float) + 1, counts["clean"].to_numpy(float) + 1
    ratio = np.log(p / (toxic + 2)) - np.log(q / (clean + 2))
    error = np.sqrt(np.maximum(1 / p - 1 / (toxic + 2) + 1 / q - 1 / (clean + 2), 1e-12))
    z = np.where(p + q - 2 >= min_docs, np.abs(ratio / error), 0)
    keep = z >= min_z
    if not (keep.any() and toxic and clean):
        return ToxicityModel(weights, bias)
    chosen, scale = counts["bucket"].to_numpy(np.int64)[keep], ratio[keep]
    # twice the rows wanted pass the first cut, so only ids of a bounded number of rows are sorted
    h = F.xxhash64(F.col("doc_id").cast("string"))
    cut = int(-(2**63) + min(1.0, 2 * fit_rows / (clean + toxic)) * (2**64 - 1025))
    ids = training.where(h <= cut).select("doc_id", h.alias("h")).orderBy("h", "doc_id").limit(fit_rows).select("doc_id").distinct()
    sample = training.join(F.broadcast(ids), "doc_id", "left_semi")
    w, bias = _fit(_features(sample, chosen).toArrow(), scale, bias)
    weights[chosen] = w * scale
    return ToxicityModel(weights, bias)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 if score >= threshold); columns of those names are replaced.

    Null and empty texts get the score of a text without n-grams.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(texts_of(batch.column("text")))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return map_arrow(docs, run, schema_with(docs, "score double, predicted int"))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows whose crc32(doc_id as text) mod 3 is not 1; a doc_id labelled twice counts as its largest label."""
    labelled = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    # a merge join at every size: labels grow with the documents, so they are never broadcast
    return docs.select("doc_id", "text").where(~held_out("doc_id")).join(labelled.hint("merge"), "doc_id")


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
