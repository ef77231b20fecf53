"""Access to the input tables by neutral name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy name -> DataFrame lookup; nothing is read until a report asks for the table."""

    def __init__(self, resolve: Callable[[str], DataFrame]):
        self._resolve = resolve
        self._seen: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self._resolve(name)
        return self._seen[name]

    @classmethod
    def of(cls, frames: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> Tables:
        def resolve(name: str) -> DataFrame:
            frame = frames[name]
            return frame if isinstance(frame, DataFrame) else frame()

        return cls(resolve)

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: Mapping[str, str] | None = None) -> Tables:
        """Catalog tables; `names` maps a neutral name to `schema.table` where they differ."""
        names = names or {}
        return cls(lambda name: spark.table(names.get(name, name)))

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> Tables:
        """One parquet directory (or file) per table under `root`."""
        return cls(lambda name: spark.read.parquet(f"{root}/{name}"))


def union_tables(tables: Tables, names: Iterable[str]) -> DataFrame:
    """Stack same-shaped tables (one per region) by column name."""
    names = list(names)
    if not names:
        raise ValueError("no tables to stack: name at least one (regions must not be empty)")
    return reduce(DataFrame.unionByName, [tables[name] for name in names])
