"""Session settings the reports rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Correctness: zone arithmetic assumes a UTC session; partition keys such as month "01" must stay text.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}

# Plan shape. Lookups are broadcast only when Spark's own size estimate is under the threshold; everything else
# is shuffled and left to adaptive execution. The co-partition setting lets joins on (order_id, merchant_id)
# reuse a shuffle on order_id alone.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # payment rows pass 100 fields, past which whole-stage code generation is off by default
    "spark.sql.codegen.maxFields": "400",
}


def configured_session(app_name: str = "bazaarledger", **extra: str) -> SparkSession:
    """Build (or reuse) a session with the settings above; `extra` wins over the recommended values."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RECOMMENDED, **extra, **REQUIRED}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply to a session somebody else built: the required settings, and those that guard joins against hot keys."""
    guards = {key: value for key, value in RECOMMENDED.items() if "roadcast" not in key}
    for key, value in {**guards, **REQUIRED}.items():
        spark.conf.set(key, value)
    return spark
