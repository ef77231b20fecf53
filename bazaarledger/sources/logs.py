"""Application-log scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_events(
    df: DataFrame,
    log: str,
    operation: str,
    keys: Mapping[str, str],
    extra: tuple[str, ...] = (),
    label: tuple[str, str] | None = None,
) -> DataFrame:
    """Distinct events of one operation: output column -> property key, plus `extra` columns and a constant label."""
    hits = df.where((F.col("log") == log) & (F.element_at("properties", F.lit("operation.name")) == operation))
    picked = [F.element_at("properties", F.lit(key)).alias(name) for name, key in keys.items()]
    constant = [F.lit(label[1]).alias(label[0])] if label else []
    return hits.select(*picked, *constant, *extra).distinct()
