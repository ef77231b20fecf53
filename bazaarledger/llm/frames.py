"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this subpackage, so that Python workers find it wherever the driver found it. Once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        here = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="llm-code-")) / "llm_code.zip"
        with zipfile.ZipFile(path, "w") as out:
            for part in sorted(here.parent.rglob("*.py")):
                out.write(part, part.relative_to(here.parent.parent))
        spark.sparkContext.addPyFile(str(path))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not made.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = made.get() if made.isDefined() else f"file://{tempfile.mkdtemp(prefix='llm-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and lost executors lose nothing."""
    path = os.path.join(shared_folder(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def digest(text: Column | str) -> Column:
    """16 bytes that name a text (NULL counts as empty): the first half of its SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)), 1, 16)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with the given ones that df does not have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def binary_list(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())
