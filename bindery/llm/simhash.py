"""Near duplicates by SimHash, linked through multi-index hashing.

A fingerprint has 64 bits.  Two fingerprints that differ in at most three bits
differ in at most one bit within one of their two 32-bit halves.  Each half is
therefore a table of its own: every fingerprint is stored under its two halves,
enumerates the Hamming ball of radius one around each half (33 keys), fetches
what is stored there and verifies the complete distance.

Only distinct fingerprints are linked, so a group of copies is one row there,
and a fingerprint has at most 43,744 neighbours whatever the corpus holds.
"""
from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import components, table, text_pieces

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: shingles whose bits are summed at a time
BLOCK = 1 << 14


def shingle_hashes(text: bytes, width: int):
    """XXH64 of the word shingles of a text, in arrays of bounded length."""
    words: list[bytes] = []
    short = True
    for piece in text_pieces(text):
        words += piece.lower().split()
        n = len(words) - width + 1
        if n > 0:
            short = False
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
            words = words[n:]
    if short and words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """A bit is one if it is set in over half the shingle hashes; no words: zero."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        total += len(hashes)
        for at in range(0, len(hashes), BLOCK):
            part = hashes[at:at + BLOCK].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little", signed=True)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, bits long) for every row; a null text counts as empty."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            bits = [fingerprint(t.as_py(), width) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], names=[id_col, "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, bits long")


def links(prints: DataFrame) -> DataFrame:
    """(a, b) pairs of distinct `bits` that differ in one to three bits, a < b."""
    halves = [F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("bits", 32)]
    keys = [F.lit(i << 32).bitwiseOR(h) for i, h in enumerate(halves)]
    stored = prints.select(F.col("bits").alias("b"), F.explode(F.array(*keys)).alias("key"))
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    asked = (prints.select(F.col("bits").alias("a"), F.explode(F.array(*keys)).alias("half"))
             .select("a", F.explode(F.transform(ball, lambda m: F.col("half").bitwiseXOR(m))).alias("key")))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return asked.join(stored, (asked.key == stored.key) & (F.col("a") < F.col("b")) & close).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of `docs`.

    component_id is the smallest id reachable over links of at most three bits.
    Texts without words, empty and null ones all have fingerprint zero and link
    like any other.  Rows with a null id are kept; component_id is null only if
    no row of the component has an id.  Repeated rows stay repeated.  Other
    columns of `docs` are not read.
    """
    marked = stage(simhash(docs, id_col, text_col), "simhash")
    prints = stage(marked.groupBy("bits").agg(F.min(id_col).alias("first_id")), "simhash-prints")
    linked = components(links(prints), "simhash-links").withColumnsRenamed({"node": "bits"})
    rooted = prints.join(linked, "bits")
    roots = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(roots, "root").select("bits", "component_id")
    # a table of its own, so that the join below can split the fingerprint of many copies
    prints = stage(prints.join(named, "bits", "left").select(
        "bits", F.coalesce("component_id", "first_id").alias("component_id")), "simhash-named")
    return marked.join(prints, "bits").select(
        id_col, F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash": (op7_simhash, None)}
