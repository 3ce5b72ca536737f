"""Near duplicates by the Jaccard similarity of word shingles.

Two texts are near if their sets of five-word shingles are alike by 0.8 or more.
Candidates meet in the bands of a MinHash signature: with 25 bands of five
values a pair of similarity 0.8 shares no band with a chance of 5 in 100,000,
and one of 0.9 with less than 1 in 10**9.  A candidate counts only after its
exact similarity is confirmed on the whole shingle sets.

Only distinct shingle sets are linked, so a group of copies is one row there.
First each set is held against one set of each of its bands, the one that shares
bands with most others: of a text and its edited copies that is the text or the
least edited copy, and what it links is one component.  Sets that still share a
band with another component are then joined by prefixes: with the shingles of a
set in order of rarity, two sets can only be alike if their rarest shingles have
one in common, early enough that what follows it can still reach the similarity.
Edits and passages that many texts share thus make no candidates, and neither
step compares the sets of a band with each other.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import components
from .simhash import SEED, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: rows of two numbers that are broadcast at most, 32 MB of them; a longer list is joined by a shuffle
SHORT = 1 << 21
#: shingles whose values are permuted at a time
PART = 1 << 10


def multipliers(n: int) -> np.ndarray:
    """n odd 64-bit numbers and n offsets, the same everywhere."""
    own = np.array([[xxhash.xxh64_intdigest(b"%d %d" % (i, k), SEED) for i in range(n)] for k in range(2)], np.uint64)
    return own | np.array([[1], [0]], np.uint64)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order; none without words."""
    parts = [np.unique(h) for h in shingle_hashes(text, width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def bands(shingles: np.ndarray, factors: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of the MinHash signature."""
    least = np.full(factors.shape[1], ~np.uint64(0))
    for at in range(0, len(shingles), PART):
        x = shingles[at:at + PART, None] * factors[0] + factors[1]
        # the high bits of a product depend on all bits below them
        x = (x ^ (x >> np.uint64(32))) * factors[0]
        least = np.minimum(least, x.min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.astype("<u8").reshape(-1, rows))]
    return np.array(keys, np.uint64).view(np.int64)


def signature(text: Column, width: int = WIDTH) -> Column:
    """struct(bits, keys) of a text: a digest of its shingle set and its band keys; a null text counts as empty."""
    factors = multipliers(BANDS * ROWS)

    def run(texts: pa.Array) -> pa.Array:
        bits, keys = [], []
        for text in texts.cast(pa.large_binary()):
            shingles = shingle_set(text.as_py() or b"", width)
            bits.append(xxhash.xxh3_64_intdigest(shingles.astype("<u8").tobytes(), SEED))
            keys.append(bands(shingles, factors))
        ends = np.arange(len(bits) + 1, dtype=np.int32) * BANDS
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(np.array(bits, np.uint64).view(np.int64)),
                                           pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["bits", "keys"])

    return F.arrow_udf(run, "struct<bits: long, keys: array<long>>")(F.coalesce(text, F.lit("")))


def shingle_array(text: Column, width: int = WIDTH) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py() or b"", width).view(np.int64) for t in texts.cast(pa.large_binary())]
        return pa.array(sets, pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")(F.coalesce(text, F.lit("")))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct `pairs` (a, b) whose shingle sets are alike by `similarity`.  sets: (bits, set)."""
    # a table of its own, so that the joins below can split a set of many pairs
    pairs = stage(pairs, "shingle-pairs")
    both = (pairs.join(sets.select(F.col("bits").alias("a"), F.col("set").alias("x")), "a")
            .join(sets.select(F.col("bits").alias("b"), F.col("set").alias("y")), "b"))
    n, m = F.size("x"), F.size("y")
    common = F.size(F.array_intersect("x", "y"))
    return both.where((F.least(n, m) >= similarity * F.greatest(n, m)) & (common / (n + m - common) >= similarity)).select("a", "b")


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def at_least(n: Column) -> Column:
    """The smallest whole number that is not below n, but for rounding."""
    return F.ceil(n - 1e-9)


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Distinct candidates (a, b) among the sets (bits, set, root): of different roots, none alike by `similarity` lost.

    A shingle that only one set has can join nothing; it comes first in its set's
    order and just takes a place.  The smaller set of a pair offers a shorter
    prefix than the larger one, as it must keep a larger share.
    """
    found = sets.select("bits", F.explode("set").alias("shingle"))
    held = stage(found.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"), "shingle-held")
    listed = found.join(held, "shingle").groupBy("bits").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("rare"))
    n = F.size("set")
    lowest = similarity / (1 + similarity)
    reach = (n - at_least(similarity * n) + 1).alias("reach")
    reach_up = (n - at_least(2 * lowest * n) + 1).alias("reach_up")
    rows = sets.join(listed, "bits").select("bits", "root", n.alias("n"), reach, reach_up, "rare")
    own = F.slice("rare", 1, F.greatest(F.lit(0), F.col("reach") - (F.col("n") - F.size("rare"))).cast("int"))
    rows = rows.select("bits", "root", "n", "reach_up", (F.col("n") - F.size("rare")).alias("alone"), F.posexplode(own).alias("at", "e"))
    rows = stage(rows.select("bits", "root", "n", "reach_up", (F.col("alone") + F.col("at")).alias("at"), F.col("e.shingle").alias("shingle")),
                 "shingle-prefixes")
    small = rows.where("at < reach_up").select("shingle", *[F.col(c).alias(f"s_{c}") for c in ("bits", "root", "n", "at")])
    large = rows.select("shingle", *[F.col(c).alias(f"l_{c}") for c in ("bits", "root", "n", "at")])
    c = F.col
    sizes = (c("s_n") < c("l_n")) | ((c("s_n") == c("l_n")) & (c("s_bits") < c("l_bits")))
    left = F.least(c("s_n") - c("s_at"), c("l_n") - c("l_at"))
    alike = (c("s_n") >= at_least(similarity * c("l_n"))) & (left >= at_least(lowest * (c("s_n") + c("l_n"))))
    met = small.join(large, (small.shingle == large.shingle) & (c("s_root") != c("l_root")) & sizes & alike)
    return met.select(*ordered("s_bits", "l_bits")).distinct()


def short(rows: DataFrame) -> DataFrame:
    """Staged rows of two numbers, broadcast if they are few: what they are joined to then needs no shuffle."""
    return F.broadcast(rows) if rows.count() <= SHORT else rows


def linked_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged rows (row, s, nth), their distinct shingle sets (bits, first_id, nth) and the linked ones (bits, root).

    row is a struct of all columns of `docs`, nth the row's own number, s.bits its set."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), signature(F.col(text_col), width).alias("s"))
    rows = stage(rows.withColumn("nth", F.monotonically_increasing_id()), "shingles")
    bits = F.col("s.bits").alias("bits")
    prints = stage(rows.select(F.col(f"row.{id_col}").alias("id"), bits, "nth").groupBy("bits").agg(
        F.min("id").alias("first_id"), F.min("nth").alias("nth")), "shingle-prints")
    banded = rows.select("nth", bits, "s.keys").join(prints.select("nth"), "nth", "left_semi").select(
        "bits", F.explode("keys").alias("key"))
    shared = stage(banded.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "shingle-bands")
    banded = stage(banded.join(shared, "key"), "shingle-banded")
    met = banded.groupBy("bits").agg(F.sum("held").alias("met"))
    asked = stage(prints.select("nth", "bits").join(met, "bits", "left_semi"), "shingle-asked")
    # the texts need no shuffle where the list of those asked for is short
    texts = rows.select("nth", F.col(f"row.{text_col}").alias("text")).join(short(asked), "nth")
    sets = stage(texts.select("bits", shingle_array(F.col("text"), width).alias("set")), "shingle-sets")

    leads = stage(banded.join(met, "bits").groupBy("key").agg(F.max(F.struct("met", "bits")).alias("lead")).select("key", "lead.bits"),
                  "shingle-leads").withColumnRenamed("bits", "lead")
    first = banded.join(leads, "key").where("bits != lead").select(*ordered("bits", "lead")).distinct()
    links = stage(confirmed(first, sets, similarity), "shingle-links")
    linked = components(links, "shingle-near").withColumnsRenamed({"node": "bits"})
    rooted = stage(banded.join(linked, "bits", "left").select("key", "bits", F.coalesce("root", "bits").alias("root")),
                   "shingle-rooted")
    # sets of bands whose sets are still apart
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    apart = rooted.join(apart.select("key"), "key").select("bits", "root").distinct()
    second = confirmed(prefix_pairs(stage(sets.join(apart, "bits"), "shingle-apart"), similarity), sets, similarity)
    stars = linked.where("bits != root").select(F.col("bits").alias("a"), F.col("root").alias("b"))
    return rows, prints, components(stars.union(second), "shingle-all").withColumnsRenamed({"node": "bits"})


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                similarity: float = SIMILARITY) -> DataFrame:
    """(row, component_id) for every row of `docs`: row is a struct of all its columns.

    component_id is the smallest id reachable over pairs of texts whose shingle
    sets are alike by `similarity`.  A text of fewer than `width` words is one
    shingle, texts without words are alike.  component_id is null only if no row
    of the component has an id.  Repeated rows stay repeated.
    """
    rows, prints, linked = linked_sets(docs, id_col, text_col, width, similarity)
    bits = F.col("s.bits").alias("bits")
    rooted = prints.join(linked, "bits")
    roots = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(roots, "root").select("bits", "component_id")
    # a table of its own, so that the join below can split the set of many copies
    named = stage(prints.join(named, "bits", "left").select(
        "bits", F.coalesce("component_id", "first_id").alias("component_id")), "shingle-named")
    return rows.select("row", bits).join(named, "bits").select("row", "component_id")
