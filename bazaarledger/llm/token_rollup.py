"""Delta-maintained token counts: additive totals by source, language and tokenizer version.

Documents that arrive, leave or are counted anew become signed deltas. A batch of deltas is summed to one row per group and
written under its batch id; the totals are the sums over all committed batches. A batch counts once it is complete (Spark's
``_SUCCESS`` marker), and committing an id again changes nothing, so a job may be retried at any point.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bazaarledger.llm import words as W
from bazaarledger.llm.chunks import word_tokenizer, words_of
from bazaarledger.llm.frames import ship

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(df: DataFrame, tokenizer: str, separator: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """df with the number of ids of each whole text by a ``tokenizers`` file that cuts at white space. NULL and empty texts have 0."""
    ship(df.sparkSession)
    df = df.drop(count)
    names, schema = df.columns, StructType([*df.schema.fields, StructField(count, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = word_tokenizer(tokenizer, separator)
        for piece in W.pieces(batches, text):
            counts = chunks.counts(words_of(piece.column(piece.schema.get_field_index(text)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(counts, pa.int64())], [*names, count])

    return df.mapInArrow(run, schema)


def inserted(counts: DataFrame) -> DataFrame:
    """Deltas of new documents from (source, lang, tokenizer, n_tokens); a NULL count adds 0 tokens."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Deltas of documents that leave; counts are those they were entered with."""
    return inserted(counts).select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revised(counts: DataFrame, before: str = "n_before", after: str = "n_after") -> DataFrame:
    """Deltas of documents counted anew: tokens change by after - before, documents stay."""
    change = F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0))
    return counts.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), change.cast("long").alias("n_tokens"))


class Rollup:
    """Totals kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def committed(self) -> list[str]:
        """Paths of complete batches."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [s.getPath().toString() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(p for p in found if self._fs.exists(self._path(f"{p}/_SUCCESS")))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch. False, and no effect, if it is there already; a batch that was left incomplete is written anew.

        ``batch`` is a name of letters, digits, ``-`` and ``_``. NULL keys are a group of their own. Zero groups are kept, so an empty batch commits too.
        """
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"batch: {batch!r} is no name of letters, digits, - and _")
        path = f"{self.folder}/batch-{batch}"
        if self._fs.exists(self._path(f"{path}/_SUCCESS")):
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.write.mode("overwrite").parquet(path)
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches; groups that have come to nothing are left out."""
        paths = self.committed()
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 OR n_tokens <> 0")
