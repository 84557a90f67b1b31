"""A corpus from raw documents in five stages, each a whole-table Spark job over what the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents. Tables that a stage leaves in the shared folder go when its result is written.

In every stage null text counts as empty and long texts are whole. Extra columns are passed on by all stages but the last,
whatever their names. An empty table gives an empty one. Rows without doc_id are scored, decontaminated and encoded like
others, and pass the two stages of repeats, which compare documents by doc_id, as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callbook.llm import decontaminate, jaccard, line_dedup, pieces, toxicity
from callbook.llm.common import saved, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled rows, does not reject (score under 0.7). Repeated rows share their fate."""
    model = toxicity.learn(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows. A document all of whose lines went is gone.

    Of equal lines those of the smallest doc_id stay; repeated rows lose the same lines. Near copies differ more after this
    stage than before it, since the copy has lost the lines that it shared: fewer are left for the next one to join.
    """
    kept = line_dedup.dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.length(F.btrim("kept_text")) > 0))
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (runs of five words, Jaccard 0.8), the smallest doc_id.

    Repeated rows are copies; of different texts under one doc_id each is judged by itself. Texts without words stay.
    """
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item. Repeated rows share their fate."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document: how many, a digest of their ids, whether they decode to the text, and the n best scores.

    Repeated rows give a row each; of equally good segmentations that of the earlier chunk comes first.
    """
    return pieces.digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_alike),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: SQL cannot express the classifier, the alignment or the lattice search; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
