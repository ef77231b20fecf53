"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

Misra-Gries counters (``DataFrame.stat.freqItems``, merged over partitions) name every digest that may hold more than a share
``support`` of the rows, 1/support at most. Their true groups are counted, and the winners, a table of bounded size, are
broadcast: rows of hot texts are settled map-side and never shuffled. All other digests, none of which holds more than that
share, are grouped by ordinary shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarledger.llm.frames import fresh, stored

#: Digests with more than this share of the rows are certain to be found; there are at most 1000 of them.
SUPPORT = 0.001


def digest_table(df: DataFrame, text: str, id: str) -> DataFrame:
    """(id, row, digest) of every row, stored: texts are read once. ``row`` tells equal rows apart."""
    whole = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return stored(df.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("row"), whole.alias("digest")))


def _winner() -> Column:
    """The row of a group that stays: the largest id, NULL last; among rows of equal id the last."""
    return F.max(F.struct(F.col("id").isNotNull().alias("has_id"), "id", "row"))


def heavy_groups(table: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, best, group_size) of the digests that Misra-Gries counters name and a count verifies to hold over the share."""
    named = table.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest")).distinct()
    counted = table.join(F.broadcast(named), "digest").groupBy("digest").agg(_winner().alias("best"), F.count("*").alias("group_size"))
    return stored(counted.where(F.col("group_size") > support * table.count()))


def copy_groups(df: DataFrame, text: str = "text", id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; NULL counts as the empty text. Of equal texts the row with the largest id stays (a NULL id
    is smaller than all; of rows equal in id one stays). Extra columns are ignored. An empty table gives an empty table.
    """
    table = digest_table(df, text, id)
    heavy = heavy_groups(table, support)
    split = table.join(F.broadcast(heavy), "digest", "left")
    hot = split.where("group_size IS NOT NULL")
    rest = table.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(_winner().alias("best"), F.count("*").alias("group_size"))
    settled = hot.unionByName(rest.join(groups, "digest"))
    return settled.select(F.col("id").alias(id), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, text: str = "text", id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """df with one row of each group of equal texts, all columns: the row that ``copy_groups`` keeps.

    Rows of hot texts other than those with the id that stays are dropped map-side. The others meet by digest, after each task
    has dropped all but its own candidate of each digest.
    """
    sha, best, size, rank = fresh(df, "digest", "best_id", "group_size", "rank")
    heavy = heavy_groups(digest_table(df, text, id), support).select(F.col("digest").alias(sha), F.col("best.id").alias(best), F.col("group_size").alias(size))
    keyed = df.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))).join(F.broadcast(heavy), sha, "left")
    left = keyed.where(F.col(size).isNull() | F.col(best).eqNullSafe(F.col(id)))
    last = Window.partitionBy(sha).orderBy(F.col(id).desc_nulls_last())
    return left.withColumn(rank, F.row_number().over(last)).where(F.col(rank) == 1).select(*df.columns)
