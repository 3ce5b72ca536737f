"""Cutting a plan at a table that several later steps read.

The cut is a Parquet table in the folder that `spark.checkpoint.dir` names, so
it survives the loss of executors and is read back with column pruning.
"""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .sources.folders import delete

_held: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def stage_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="bindery-stage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _held.get() is not None:
        _held.get().append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, as in a stream that would pile them up."""
    paths: list[str] = []
    before = _held.set(paths)
    try:
        yield
    finally:
        _held.reset(before)
        for path in paths:
            delete(spark, path)
