"""Corpus cleaning pipeline: each stage is one operator of ``bazaarledger.llm``, run on all documents that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarledger.llm import packing, toxicity
from bazaarledger.llm.frames import fresh, stored
from bazaarledger.llm.heavy_hitter_dedup import drop_copies
from bazaarledger.llm.queries import held_out
from bazaarledger.llm.substring_dedup import remove_repeats
from bazaarledger.llm.weighted_minhash import drop_near_duplicates


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of these documents, but for the held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = toxicity.fit_on_labels(docs, labels)
    (score,) = fresh(docs, "score")
    return toxicity.score(docs, model, score=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut from all texts that hold them; every document stays, n_chars follows its text."""
    cut = remove_repeats(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 4096 ids, as pieces of documents."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), "<|endoftext|>", end_id=2)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: SQL can't train and apply the classifier of the first stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
