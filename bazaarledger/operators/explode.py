"""Row-generating operators; they differ only in what NULL and empty lists do."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType


def typed(df: DataFrame, column: str, schema: str) -> Column:
    """A document column of df as a struct of the schema; NULL where it can't be read."""
    if isinstance(df.schema[column].dataType, VariantType):
        return F.try_variant_get(column, "$", f"struct<{schema}>")
    return F.from_json(column, schema)


def parse_once(df: DataFrame, keep: Sequence[str], documents: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The `keep` columns and each document column parsed: documents maps a new name to (column, schema).

    A text column is parsed as JSON; a VARIANT column, parsed when it was stored, only gives up the schema's fields. The parsed structs come out of a generator that gives one row per row: later filters and projections on their fields can't
    be pushed into the scan as further parses of the same text.
    """
    parsed = F.struct(*[typed(df, column, schema).alias(name) for name, (column, schema) in documents.items()])
    return df.select(*keep, F.inline(F.array(parsed)))


def explode_list(df: DataFrame, items: Column, name: str) -> DataFrame:
    """One row per element; NULL and empty lists drop the row."""
    return df.select("*", F.explode(items).alias(name))


def explode_or_default(df: DataFrame, items: Column, default: Column, name: str) -> DataFrame:
    """A NULL list gives one row holding `default`; an empty list still drops the row."""
    return df.select("*", F.explode(F.coalesce(items, F.array(default))).alias(name))


def explode_keep_empty(df: DataFrame, items: Column, name: str) -> DataFrame:
    """An empty list gives one row with a NULL element; a NULL list drops the row."""
    return df.where(items.isNotNull()).select("*", F.explode_outer(items).alias(name))
