"""Language ID by cross-parsing (after Ziv and Merhav, 1993).

For each language a suffix automaton is built over the whole labelled texts of a sample whose only bound is a number of
rows. A text is parsed greedily into the longest phrases that occur in that sample; the language that needs the fewest
phrases, normalised by the log of its sample's length, wins. Symbols are the lower-cased letters themselves, whatever the
alphabet; all else is a blank. Texts are parsed in blocks of `block` code points, all blocks and languages of a batch in
lockstep: a step looks up the moves of thousands of automaton states at once. A text's phrases are the sum over its blocks.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callbook.llm.common import map_arrow, saved, schema_with, spread, texts_of

LETTER = r"\p{L}"
_POINT_BITS = np.uint64(21)  # of a code point


def _automaton(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moves of the suffix automaton of a sequence of code points (state 0 is the root): keys state << 21 | point, and states."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    size = np.array([len(moves) for moves in nxt], np.int64)
    point = np.fromiter((c for moves in nxt for c in moves), np.uint64, int(size.sum()))
    to = np.fromiter((q for moves in nxt for q in moves.values()), np.int64, int(size.sum()))
    return np.repeat(np.arange(len(nxt), dtype=np.uint64), size) << _POINT_BITS | point, to


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing over a power of two of at least twice as many slots; the key of a free slot is all ones."""
    slots = 1 << max(4, int(2 * len(keys)).bit_length())
    held, value = np.full(slots, ~np.uint64(0)), np.full(slots, -1, np.int32)
    at, left = _slot(keys, slots), np.arange(len(keys))
    while len(left):
        free = left[held[at[left]] == ~np.uint64(0)]
        held[at[free]] = keys[free]  # one of those that want a slot gets it
        placed = held[at[left]] == keys[left]
        value[at[left[placed]]] = values[left[placed]]
        left = left[~placed]
        at[left] = (at[left] + 1) & (slots - 1)
    return held, value


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - slots.bit_length())).view(np.int64)


class CrossParser:
    """Counts phrases of texts against the samples of all languages. Some 50 bytes are held for each code point learned."""

    def __init__(self, samples: list[tuple[str, str]], block: int = 512):
        self.langs = [lang for lang, _ in samples]
        self.block = block
        texts = [self._folded(text) for _, text in samples]
        self.log_size = [np.log2(max(2, len(t))) for t in texts]
        keys, values, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        self.roots = []
        for text in texts:
            key, to = _automaton(text)
            keys.append(key + (np.uint64(base) << _POINT_BITS))
            values.append(to + base)
            self.roots.append(base)
            base += int(to.max(initial=0)) + 1
        self.roots = np.array(self.roots, np.int32)
        self.held, self.value = _table(np.concatenate(keys), np.concatenate(values))

    def _move(self, state: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The states after one more symbol, -1 where the sample does not go on like this."""
        key = state.astype(np.uint64) << _POINT_BITS | point
        at = _slot(key, len(self.held))
        held = self.held[at]
        out = np.where(held == key, self.value[at], -1)
        open_ = np.flatnonzero((held != key) & (held != ~np.uint64(0)))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.held) - 1)
            held = self.held[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (held != ~np.uint64(0))]
        return out

    @staticmethod
    def _folded(text: str) -> np.ndarray:
        """Lower-cased code points; all that is no letter becomes a blank."""
        x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(_is_letter()[x], x, 32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (rows) against each language (columns)."""
        points = [self._folded(t) for t in texts]
        blocks = np.array([-(-len(p) // self.block) for p in points], np.int64)
        flat = np.zeros((int(blocks.sum()), self.block), np.uint32)
        at = 0
        for p, b in zip(points, blocks, strict=True):
            flat[at : at + b].reshape(-1)[: len(p)] = p
            at += b
        size = np.repeat([len(p) for p in points], blocks) - self.block * (np.arange(at) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        order = np.argsort(-size, kind="stable")  # blocks that have ended fall off the end
        columns = np.ascontiguousarray(flat[order].T).astype(np.uint64)
        alive = np.searchsorted(-size[order], -np.arange(self.block), "left")
        langs = len(self.roots)
        state = np.tile(self.roots, at)  # block by block, all languages of each
        count = np.zeros(at * langs, np.int32)
        root = state.copy()
        for i in range(self.block):
            k = int(alive[i]) * langs
            if not k:
                break
            point = np.repeat(columns[i, : k // langs], langs)
            move = self._move(state[:k], point)
            ended = np.flatnonzero(move < 0)
            # a phrase that cannot go on is counted; this symbol begins the next one, or is a phrase of its own if the sample lacks it
            count[ended] += state[ended] != root[ended]
            again = self._move(root[ended], point[ended])
            count[ended] += again < 0
            move[ended] = np.where(again < 0, root[ended], again)
            state[:k] = move
        count += state != root
        owner = np.repeat(np.arange(len(texts)), blocks)[order]
        out = np.zeros((len(texts), langs))
        for j in range(langs):
            out[:, j] = np.bincount(owner, count[j::langs], len(texts))
        return out

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language with the fewest normalised phrases (ties: first by name) and how clear the win is (0 to 1)."""
        bits = self.phrases(texts) * np.array(self.log_size)
        best = bits.argmin(1)
        least = bits.min(1)
        rest = bits.copy()
        rest[np.arange(len(bits)), best] = np.inf
        second = rest.min(1) if bits.shape[1] > 1 else least * 2
        return best, np.clip(1 - least / np.maximum(second, 1e-9), 0, 1)


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


@functools.lru_cache(2)
def _parser(samples: tuple[tuple[str, str], ...], block: int) -> CrossParser:
    return CrossParser(list(samples), block)


def sample_languages(labelled: DataFrame, rows: int = 24) -> list[tuple[str, str]]:
    """Per language, `rows` whole texts by a hash of doc_id (all, if fewer).

    Rows with null lang or without a letter are left out; a repeated row counts each time. This sample, bounded by its
    rows alone, is all that is learned. Ids are ranked first, with a hash of the text for those that name several texts; a
    second scan then fetches the texts, so no text is sorted.
    """
    key = ["lang", "doc_id", "t"]
    able = labelled.where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))
    able = able.select("lang", F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    h = F.xxhash64(F.col("doc_id"), F.lit("lang"))
    ranked = able.select(*key, h.alias("h")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "t"))).where(F.col("rank") <= rows)
    taken = saved(ranked.groupBy(*key).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n")), "sampled")
    same = (F.col("s.lang") == F.col("d.lang")) & F.col("s.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("s.t") == F.col("d.t"))
    found = able.alias("d").join(F.broadcast(taken.alias("s")), same)  # at most `rows` keys a language
    texts = found.select("d.lang", "rank", "n", "text").dropDuplicates(["lang", "rank"]).collect()
    parts: dict[str, list[str]] = {}
    for row in sorted(texts, key=lambda r: (r["lang"], r["rank"])):
        parts.setdefault(row["lang"], []).extend([row["text"]] * row["n"])
    return [(lang, "\n".join(of_lang)) for lang, of_lang in sorted(parts.items())]


def identify(docs: DataFrame, samples: list[tuple[str, str]], block: int = 512) -> DataFrame:
    """docs with `lang_pred` and `score`; columns of those names are replaced.

    Null texts and texts without a letter, or all texts if nothing was learned, get `und` and score 0. Ties go to the
    language that is first by name; repeated rows get the same result each; long texts are parsed whole, block by block.
    """
    docs = docs.drop("lang_pred", "score")
    known = tuple(samples)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("text"))
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if known:
            parser = _parser(known, block)
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= 1_500_000):
                    size += len(texts[j]) + block // 2
                    j += 1
                best, clear = parser.predict(texts[i:j])
                for k in range(i, j):
                    if any(map(str.isalpha, texts[k])):
                        lang[k], score[k] = parser.langs[best[k - i]], clear[k - i]
                i = j
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return map_arrow(docs, run, schema_with(docs, "lang_pred string, score double"))


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = sample_languages(docs.where(~held_out("doc_id")).select("doc_id", "text", "lang"))
    return identify(spread(docs.select("doc_id", "text")), samples).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
