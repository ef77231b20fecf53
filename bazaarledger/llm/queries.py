"""The operators of this subpackage as registered queries over whole tables, and their SQL twins where SQL can state them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarledger.llm import histogram_sharding, jacobi_davidson, license_scan, packing, pair_grammar, periodic_runs, piece_bpe, token_rollup, toxicity
from bazaarledger.llm import words as W
from bazaarledger.llm.frames import digest, shared_folder, ship, stored
from bazaarledger.llm.heavy_hitter_dedup import copy_groups
from bazaarledger.llm.robust_outliers import quality_verdicts
from bazaarledger.llm.substring_dedup import remove_repeats
from bazaarledger.llm.weighted_minhash import near_duplicates

SPACE = "[\\x20\\x09-\\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"))
    # the documents themselves are sharded; their digest is taken afterwards
    return histogram_sharding.shard(docs, 16, "size").select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model).select("doc_id", "ids")
    return piece_bpe.decode(encoded, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "<|endoftext|>", end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, withdraw those of equal text with a larger doc_id elsewhere, count an end token for the rest, and replay a batch."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    named = docs.select("*", digest("text").alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = token_rollup.count_tokens(named, public_tokenizers.path("word_bpe_49k.json"), "<|endoftext|>").drop("text")
    both = F.explode(F.array(F.struct(F.lit("word_bpe_49k").alias("tokenizer"), F.col("n_tokens")), F.struct(F.lit("utf8_bytes").alias("tokenizer"), F.col("n_bytes").alias("n_tokens"))))
    counts = stored(counted.select("doc_id", "digest", "source", "lang", both.alias("count")).select("*", "count.*").drop("count"))
    last = counts.groupBy("digest").agg(F.max("doc_id").alias("last_id"))
    copies = counts.join(last, "digest").where("doc_id < last_id")
    kept = counts.join(last, "digest").where("doc_id = last_id AND tokenizer = 'word_bpe_49k'")
    rollup = token_rollup.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", token_rollup.inserted(counts))
    rollup.commit("withdraw", token_rollup.deleted(copies))
    rollup.commit("revise", token_rollup.revised(kept.withColumns({"n_before": F.col("n_tokens"), "n_after": F.col("n_tokens") + 1})))
    rollup.commit("withdraw", token_rollup.deleted(copies))
    return rollup.totals()


def held_out(id: str = "doc_id") -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 1, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on_labels(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents")).withColumn("distance", F.round("distance", 3))


def op11_pair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    pair_grammar.write_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), "<|endoftext|>", end_id=2)
    return pair_grammar.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jacobi_davidson.whiten(_table(spark, sf_dir, "embeddings"), "embedding", "vec_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which every tenth document, by the hash of its id, repeats a stretch of its words to its end."""
    ship(docs.sparkSession)
    h = F.crc32(F.col("doc_id").cast("string"))
    seeded = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("seed"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches, "text"):
            doc_id, text, seed = piece.columns
            found = W.Words(text)
            n = np.diff(found.first)
            g = seed.fill_null(0).to_numpy(zero_copy_only=False)
            chosen = (n > 0) & seed.is_valid().to_numpy(zero_copy_only=False)
            a = np.where(chosen, g % np.maximum(n, 1), n)
            p = 1 + (n - a) // (3 + g % 8)
            row = found.row
            word = np.arange(len(found)) - found.first[row]
            source = found.first[row] + np.where(word >= a[row], a[row] + (word - a[row]) % p[row], word)
            repeated = pa.compute.if_else(pa.array(chosen), periodic_runs.joined(found, source), text)
            yield pa.RecordBatch.from_arrays([doc_id, repeated], ["doc_id", "text"])

    return seeded.mapInArrow(plant, docs.select("doc_id", "text").schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.concat(line, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_sharding": op1_sharding, "op2_minhash": op2_minhash, "op3_pieces": op3_pieces, "op4_licenses": op4_licenses, "op5_substring": op5_substring, "op6_exact": op6_exact, "op7_packing": op7_packing, "op8_token_counts": op8_token_counts, "op9_toxicity": op9_toxicity, "op10_outliers": op10_outliers, "op11_pair_grammar": op11_pair_grammar, "op12_whitening": op12_whitening, "op13_periodic_runs": op13_periodic_runs}

ORACLES: dict[str, str] = {
    "op4_licenses": license_scan.oracle_sql(),
    "op6_exact": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
