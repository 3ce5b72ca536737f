"""Helpers shared by the corpus operators: tables, byte views of texts, graph components."""
from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage

#: texts are worked on in groups of about this many bytes, so that the arrays
#: made from them stay small whatever the Arrow batch holds
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str) -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; a null has no bytes."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` rows whose texts hold about `limit` bytes together, one row at least."""
    start, total = 0, len(offsets) - 1
    while start < total:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), start + rows, total)
        yield start, end
        start = end


def text_pieces(text: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a text, cut only at ASCII white space."""
    start, find = 0, re.compile(rb"[ \t-\r]").search
    while len(text) - start > limit:
        at = find(text, start + limit)
        if at is None:
            break
        yield text[start:at.start()]
        start = at.end()
    yield text[start:]


def worker_state(key: str, make: Callable):
    """Something costly that the tasks of one Python worker share, such as a loaded vocabulary; made on first use."""
    held = sys.modules.setdefault("_bindery_worker", types.ModuleType("_bindery_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of the linked nodes of `edges` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps.  Every round is written to the
    shared folder, so neither lineage nor driver memory grows with the graph.
    """
    edges = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), name)
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct())
        before = now
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        # a table of its own: the join below can then split a node with very many neighbours
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select("v", "m").union(least)
        edges = stage(small.toDF("a", "b").distinct(), name)
