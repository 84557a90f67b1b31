"""Token counts per section by offset-mapped attribution.

Each whole text is encoded once with a byte-level BPE vocabulary; as that encoding loses nothing, the running sum of
the tokens' byte lengths gives every token's byte span. Sections are half-open code point spans of the text. An interval join of token spans and section spans (both sorted: binary search) finds the sections that
each token touches. A token that touches one section counts there; one that crosses a boundary is allocated by `rule`:

  first  to the section that holds the token's first byte
  most   to the section that holds most of its bytes, the earlier one on a tie
  split  to each touched section by its share of the bytes that lie in sections

Tokens that touch no section are counted as outside.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import map_arrow, schema_with, texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-split pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "most", "split")


@functools.lru_cache(2)
def _encoder(path: str):
    """The encoder and each token's length in bytes."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


# Longer runs of blanks overrun the pattern's stack. It makes one token group of a run but for its last blank, which
# stands before the next word (or of the whole run at the text's end), so such groups are encoded without the pattern.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def token_ids(encoding, text: str) -> list[int]:
    """The ids of a whole text."""
    ids, at = [], 0
    for run in _BLANKS.finditer(text) if len(text) >= 10_000 else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[at : run.start()]) + encoding._core_bpe.encode_single_piece(text[run.start() : end].encode())
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def allocate(ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, int, float]:
    """Tokens per section, boundary-crossing tokens, and tokens outside, from token ends and section spans in bytes."""
    counts = np.zeros(len(lo))
    if not len(ends):
        return counts, 0, 0.0
    begins = np.append(0, ends[:-1])
    first = np.searchsorted(hi, begins, "right")  # the first section that ends after the token begins
    last = np.searchsorted(lo, ends, "left") - 1  # the last section that begins before the token ends
    touched = np.maximum(last - first + 1, 0)
    single = touched == 1
    if rule == "first":
        inside = first < len(lo)
        inside[inside] = lo[first[inside]] <= begins[inside]
        counts += np.bincount(first[inside], minlength=len(lo))
        return counts, int((touched > 1).sum()), float((~inside).sum())
    counts += np.bincount(first[single], minlength=len(lo))
    crossing = np.flatnonzero(touched > 1)
    if len(crossing):
        token = np.repeat(crossing, touched[crossing])
        ahead = np.arange(len(token)) - np.repeat(np.cumsum(touched[crossing]) - touched[crossing], touched[crossing])
        section = first[token] + ahead
        shared = np.minimum(ends[token], hi[section]) - np.maximum(begins[token], lo[section])
        heads = np.flatnonzero(ahead == 0)
        if rule == "split":
            share = shared / np.repeat(np.maximum(np.add.reduceat(shared, heads), 1), touched[crossing])
            counts += np.bincount(section, share, len(lo))
        else:
            order = np.lexsort((section, -shared, token))
            counts += np.bincount(section[order][heads], minlength=len(lo))
    return counts, len(crossing), float((touched == 0).sum())


def disjoint(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which sections hold text, by start, and their starts and ends without what an earlier one holds."""
    order = np.argsort(start, kind="stable")
    lo, hi = start[order], end[order]
    lo = np.maximum(lo, np.append(0, np.maximum.accumulate(hi)[:-1])) if len(hi) else lo
    keep = lo < hi
    return order[keep], lo[keep], hi[keep]


def count_tokens(docs: DataFrame, rule: str = "first", vocabulary: str = VOCABULARY, sections: str | None = None) -> DataFrame:
    """docs with n_tokens, n_crossing, n_outside and section_tokens (array<double>, one entry per section).

    sections names a column array<struct<start:int,end:int>> of code point spans in any order (null: none; what lies
    beyond the text is cut). A section that is null, lacks its start or end, or does not end after its start holds no
    token; where sections overlap, the text belongs to the one that starts earlier (or stands earlier, on a tie).
    Without the column the sections are the text's lines, each with its newline. Null and empty texts have no tokens;
    without a column of sections they have no section either. Repeated rows are counted each; long texts are encoded
    whole, runs of blanks of any length included. Columns named like the results are replaced. The vocabulary file must be on every executor.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    docs = docs.drop("n_tokens", "n_crossing", "n_outside", "section_tokens")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding, size = _encoder(vocabulary)
        given = batch.column(sections).to_pylist() if sections else None
        found: list[list] = [[], [], [], []]
        for k, text in enumerate(texts_of(batch.column("text"))):
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            ends = np.cumsum(size[np.array(token_ids(encoding, text), np.int64)]) if text else np.zeros(0, np.int64)
            if given is None:
                newline = np.flatnonzero(raw == 10) + 1
                hi = newline if len(newline) and newline[-1] == len(raw) else np.append(newline, len(raw))
                hi = hi if len(raw) else hi[:0]
                lo = np.append(0, hi[:-1]) if len(hi) else hi
            else:
                spans = [(0, 0) if s is None or s["start"] is None or s["end"] is None else (s["start"], s["end"]) for s in given[k] or []]
                place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                at = place[np.clip(np.array(spans, np.int64).reshape(-1, 2), 0, len(place) - 1)]
                held, lo, hi = disjoint(at[:, 0], at[:, 1])
            counts, crossing, outside = allocate(ends, lo, hi, rule)
            if given is not None:
                every = np.zeros(len(spans))
                every[held] = counts
                counts = every
            for column, value in zip(found, (len(ends), crossing, outside, counts), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        names = ["n_tokens", "n_crossing", "n_outside", "section_tokens"]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(found, kinds, strict=True))], [*batch.schema.names, *names])

    return map_arrow(docs, run, schema_with(docs, "n_tokens long, n_crossing long, n_outside double, section_tokens array<double>"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = F.transform("section_tokens", lambda n: n.cast("long"))
    return count_tokens(docs, rule="most").select("doc_id", "n_tokens", "n_crossing", F.size("section_tokens").cast("long").alias("n_sections"), counts.alias("section_tokens"))
