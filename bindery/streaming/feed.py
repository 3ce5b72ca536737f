"""A registry's changes from snapshot to snapshot, as a table that grows and as a stream.

    path/snapshot=N/    the registry as of version N, the last two of them
    path/feed/version=N the rows that differ from the version before

A row's change is found by one full outer join of the two snapshots on the
registry's key, so deletions are seen as well as writes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KEY, REGISTRY, REGISTRY_COLUMNS
from ..sources.folders import delete, names

_REST = [c for c in REGISTRY_COLUMNS if c not in KEY]
_STATE = T.StructType([REGISTRY[c] for c in _REST])
FEED = T.StructType([*[REGISTRY[c] for c in KEY], T.StructField("op", T.StringType()),
                     T.StructField("before", _STATE), T.StructField("after", _STATE), T.StructField("version", T.IntegerType())])


def row_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, op, before, after) of the rows that were inserted, updated or deleted; a row as it was is no change."""
    before = old.select(*KEY, F.struct(*_REST).alias("before"))
    after = new.select(*KEY, F.struct(*_REST).alias("after"))
    op = (F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete")
          .when(~F.col("before").eqNullSafe(F.col("after")), "update"))
    return before.join(after, KEY, "full_outer").select(*KEY, op.alias("op"), "before", "after").filter("op is not null")


def _versions(spark: SparkSession, path: str) -> list[int]:
    found = [n for n in names(spark, path) if n.startswith("snapshot=")]
    return sorted(int(n.removeprefix("snapshot=")) for n in found if "_SUCCESS" in names(spark, f"{path}/{n}"))


def publish(registry: DataFrame, path: str, version: int) -> None:
    """Makes `registry` version `version` of the feed; versions ascend.

    A version that is complete stays as it is, so a publication that was broken
    off can be repeated and nothing is fed twice."""
    spark = registry.sparkSession
    feed = f"{path}/feed/version={version}"
    if "_SUCCESS" in names(spark, feed):
        return
    known = _versions(spark, path)
    if version not in known:
        registry.select(*REGISTRY_COLUMNS).write.mode("overwrite").parquet(f"{path}/snapshot={version}")
    earlier = [v for v in known if v < version]
    new = spark.read.schema(REGISTRY).parquet(f"{path}/snapshot={version}")
    old = spark.read.schema(REGISTRY).parquet(f"{path}/snapshot={earlier[-1]}") if earlier else new.limit(0)
    row_changes(old, new).write.mode("overwrite").parquet(feed)
    for gone in earlier[:-1]:
        delete(spark, f"{path}/snapshot={gone}")


def tail_changes(spark: SparkSession, path: str, **options) -> DataFrame:
    """The changes as they are published: key, op, before, after, version."""
    reader = spark.readStream.schema(FEED)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.parquet(f"{path}/feed")
