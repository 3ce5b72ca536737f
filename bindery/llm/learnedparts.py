"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors is joined to its nearest neighbours; the graph is
cut into parts of nearly equal size that keep neighbours together; a small neural
classifier learns to name a vector's part, with the parts of its neighbours as
soft labels.  It then places every vector of the table, and routes each query to
its most probable parts, where candidates are scored by their exact cosine.

Equal vectors are one candidate with its smallest ids, so a vector that a third
of all rows share costs what one costs.  A part meets its queries in cells of
bounded size: large parts are split into blocks, many queries into chunks.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .common import table

#: vectors that the partition is learned on, at most, and their bytes as floats
SAMPLE, SAMPLE_BYTES = 20_000, 1 << 24
NEIGHBOURS, SLACK, SWEEPS = 10, 1.05, 12
#: rows that a part aims at, and parts at most: a part of the sample keeps 40 rows
PART_ROWS, SAMPLE_PART = 1_000, 40
HIDDEN, EPOCHS, BATCH, RATE = 128, 30, 256, 2e-3
#: a query goes to its most probable parts until they hold this share of the probability, to two at least
ROUTE, ROUTE_LEAST = 0.98, 2
#: rows and queries of a cell
BLOCK, CHUNK = 4_096, 1_024
TOP = 5


def usable(vector: str) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of a list column as doubles of length one; all lists have the same length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    x = np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(sample: DataFrame, x: np.ndarray, k: int) -> np.ndarray:
    """Each sample row's `k` nearest others, found in tasks; x: the sample, whose size is bounded."""
    shared = sample.sparkSession.sparkContext.broadcast(x)

    def run(batches):
        every = shared.value
        for batch in batches:
            for low in range(0, len(batch), 256):
                rows = batch.column(0)[low:low + 256].to_numpy()
                near = every[rows] @ every.T
                near[np.arange(len(rows)), rows] = -np.inf
                best = np.argpartition(-near, k - 1, axis=1)[:, :k].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(best), pa.list_(pa.int32()))],
                                                 names=["row", "near"])

    spark = sample.sparkSession
    rows = spark.range(len(x), numPartitions=max(1, min(64, len(x) // 512))).toDF("row")
    found = rows.mapInArrow(run, "row long, near array<int>").collect()
    out = np.zeros((len(x), k), np.int64)
    for r in found:
        out[r.row] = r.near
    return out


def halved(x: np.ndarray, parts: int) -> np.ndarray:
    """First parts of equal size: cuts across the direction of largest spread, again and again."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            part[rows] = first
            continue
        own = x[rows] - x[rows].mean(axis=0)
        direction = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
        for _ in range(8):
            direction = own.T @ (own @ direction)
            direction /= max(np.linalg.norm(direction), 1e-300)
        order = np.argsort(own @ direction, kind="stable")
        left = count // 2
        at = len(rows) * left // count
        todo += [(rows[order[:at]], first, left), (rows[order[at:]], first + left, count - left)]
    return part


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """A part for each node: most edges stay inside parts, none holds over SLACK times the mean."""
    part = halved(x, parts)
    room = int(np.ceil(SLACK * len(x) / parts))
    source = np.repeat(np.arange(len(x)), near.shape[1])
    edges = np.r_[source, near.ravel()], np.r_[near.ravel(), source]
    for _ in range(SWEEPS):
        votes = np.bincount(edges[0] * parts + part[edges[1]], minlength=len(x) * parts).reshape(len(x), parts)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), part]
        movers = np.flatnonzero(gain > 0)
        movers = movers[np.argsort(-gain[movers], kind="stable")]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for node in movers.tolist():
            if size[want[node]] < room:
                size[part[node]] -= 1
                size[want[node]] += 1
                part[node] = want[node]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer from a unit vector to part probabilities."""
    layers: list[np.ndarray]

    @property
    def parts(self) -> int:
        return self.layers[3].shape[0]

    def chances(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        value = np.maximum(0, x.astype(np.float32) @ w + b) @ v + c
        value = np.exp(value - value.max(axis=1, keepdims=True))
        return value / value.sum(axis=1, keepdims=True)


def learn_router(x: np.ndarray, soft: np.ndarray, seed: int = 3) -> Router:
    rng = np.random.default_rng(seed)
    x, soft = x.astype(np.float32), soft.astype(np.float32)
    d, parts = x.shape[1], soft.shape[1]
    p = [rng.normal(0, np.sqrt(2), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)),
         np.zeros(parts)]
    p = [a.astype(np.float32) for a in p]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for epoch in range(EPOCHS if parts > 1 else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own = x[order[at:at + BATCH]]
            hidden = np.maximum(0, own @ p[0] + p[1])
            value = hidden @ p[2] + p[3]
            value = np.exp(value - value.max(axis=1, keepdims=True))
            miss = (value / value.sum(axis=1, keepdims=True) - soft[order[at:at + BATCH]]) / len(own)
            back = (miss @ p[2].T) * (hidden > 0)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for i, g in enumerate((own.T @ back, back.sum(axis=0), hidden.T @ miss, miss.sum(axis=0))):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                p[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(p)


def learn(vectors: DataFrame, count: int, width: int, part_rows: int = PART_ROWS) -> Router:
    """The router for a table (vector) of `count` distinct vectors of `width` components."""
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (4 * width)))
    sample = vectors.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(size).toArrow()
    x = matrix(sample.column("vector"))
    parts = max(1, min(round(count / part_rows), len(x) // SAMPLE_PART))
    if parts == 1:
        return learn_router(x, np.ones((len(x), 1)))
    near = neighbour_graph(vectors, x.astype(np.float32), min(NEIGHBOURS, len(x) - 1))
    part = balanced_parts(x, near, parts)
    around = np.c_[np.arange(len(x)), near]
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), around.shape[1]), part[around].ravel()), 1 / around.shape[1])
    return learn_router(x, soft)


def placed(rows: DataFrame, router: Router, share: float | None) -> DataFrame:
    """`rows` (..., vector) with `parts`: the most probable one, or those that hold `share` of the probability."""
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("vector")
            for low in range(0, len(batch), 2048):
                own = batch.slice(low, 2048)
                chance = router.chances(matrix(own.column(at)))
                order = np.argsort(-chance, axis=1, kind="stable")
                if share is None:
                    number = np.ones(len(own), np.int64)
                else:
                    before = np.cumsum(np.take_along_axis(chance, order, 1), axis=1)
                    number = np.maximum(min(ROUTE_LEAST, router.parts), (before < share).sum(axis=1) + 1)
                    number = np.minimum(number, router.parts)
                lists = [o[:n].astype(np.int32) for o, n in zip(order, number)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lists, pa.list_(pa.int32()))],
                                                 names=[*own.schema.names, "parts"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, parts array<int>")


def _nearest(key, asked: pa.Table, stored: pa.Table) -> pa.Table:
    kind = pa.schema([("min_id", pa.int64()), ("digest", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
    columns = [[], [], [], []]
    if len(asked) and len(stored):
        a, b = matrix(asked.column("vector")), matrix(stored.column("vector"))
        near = a @ b.T
        k = min(TOP + 1, len(b))
        least = np.partition(near, -k, axis=1)[:, -k] - 1e-12
        query, row = np.nonzero(near >= least[:, None])
        # the same sum for every pair, whatever block it stands in
        exact = np.concatenate([(a[query[i:i + 4096]] * b[row[i:i + 4096]]).sum(axis=1)
                                for i in range(0, len(query), 4096)])
        columns = [asked.column("min_id").take(pa.array(query)), asked.column("digest").take(pa.array(query)),
                   stored.column("ids").take(pa.array(row)), np.clip(exact, -1, 1)]
    return pa.table(columns, schema=kind)


def classes(rows: DataFrame) -> DataFrame:
    """(vector, ids, min_id, digest): each distinct vector with its TOP + 1 smallest ids; min_id and digest name it."""
    rank = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    return (rows.withColumn("rank", rank).where(F.col("rank") <= TOP + 1).groupBy("vector")
            .agg(F.sort_array(F.collect_set("id")).alias("ids"))
            .withColumns({"min_id": F.col("ids")[0], "digest": F.xxhash64("vector")}))


def nearest(table_of: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding",
            share: float = ROUTE, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the TOP nearest rows found for each row for which `queries` holds.

    Rows with a null id, or a vector that is null, empty, zero or holds a null
    or non-finite component take no part, and neither do vectors whose length
    is not the most common one (the smallest of several).  A row is told from
    others by its id: an id that several rows hold is never its own neighbour,
    and equal rows count once.  Other columns are not read.
    """
    rows = table_of.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"))
    common = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = common.width if common else 1
    rows = rows.where(F.size("vector") == width)
    every = stage(classes(rows), "ann-vectors")
    router = learn(every, every.count(), width, part_rows) if common else Router(
        [np.zeros((width, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)])
    asking = rows.where("asks").select("id", "vector")
    asked = every.join(asking.select("vector").distinct(), "vector", "left_semi").select("min_id", "digest", "vector")
    stored = stage(placed(every.select("min_id", "digest", "ids", "vector"), router, None)
                   .withColumn("part", F.col("parts")[0]).drop("parts"), "ann-index")
    asked = stage(placed(asked, router, share).withColumn("part", F.explode("parts")).drop("parts"), "ann-queries")
    # one row per part, and there are no more parts than the bounded sample allows
    blocks = stored.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    chunks = asked.groupBy("part").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sizes = F.broadcast(blocks.join(chunks, "part"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "part").select(
        "min_id", "digest", "vector", "part", upto("blocks").alias("block"),
        F.pmod(F.xxhash64("min_id", "digest"), F.col("chunks")).cast("int").alias("chunk"))
    right = stored.join(sizes, "part").select(
        "ids", "vector", "part", F.pmod(F.xxhash64("min_id", "digest"), F.col("blocks")).cast("int").alias("block"),
        upto("chunks").alias("chunk"))
    cell = ["part", "block", "chunk"]
    found = left.groupBy(cell).cogroup(right.groupBy(cell)).applyInArrow(
        _nearest, "min_id long, digest long, ids array<long>, score double")
    by_score = Window.partitionBy("min_id", "digest").orderBy(F.desc("score"), F.col("ids")[0])
    best = (found.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= TOP + 1)
            .groupBy("min_id", "digest").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "ids")).alias("near")))
    named = every.select("min_id", "digest", "vector").join(best, ["min_id", "digest"]).select("vector", "near")
    flat = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(
        x["far"].alias("far"), i.alias("vec_id")))))
    own = F.filter(flat, lambda x: x["vec_id"] != F.col("id"))
    out = asking.distinct().join(named, "vector").select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(F.array_sort(own), 1, TOP)).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                      (-F.col("hit.far")).alias("score"))


def op1_learnedparts(spark, sf_dir) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op1_learnedparts": (op1_learnedparts, None)}
