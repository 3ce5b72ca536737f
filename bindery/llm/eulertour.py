"""The prefix trie of conversations, rolled up over an Euler tour.

A node is a distinct sequence of first turns.  Its name is the sum, word by word,
of the SHA-256 digests of its turns with their positions, so the names along a
conversation are running sums and need no pass over it turn by turn; that all
members of a name have the same last turn and the same parent is verified, which
by induction makes equal names equal sequences.

The tour enters and leaves every node once.  The arc into a node is followed by
the arc into its first child, or the one out of it; the arc out of a node by the
arc into its next sibling, or the one out of its parent.  The list of arcs is
ranked with sparse splitters: every arc jumps ahead by doubling until it reaches a
splitter, the list of splitters alone is ranked by doubling to its end, and each
arc adds what is left from its splitter.  With arcs in the order of their ranks, a
subtree's leaves and savings are the difference of prefix sums at the arcs out of
and into its top.

Conversations, siblings and members of any number are dealt by ranges: numbering
and running sums are taken inside each range and shifted by the ranges before it.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..staging import stage
from .common import id_crc, table

#: one arc in so many is a splitter
SPLITTERS = 32
#: members whose ids are joined at a time before they are hashed
MEMBERS = 512
WORDS = [f"w{i}" for i in range(8)]
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def running_sums(df: DataFrame, group: list[str], order: list[str], columns: list[str], name: str) -> DataFrame:
    """Each of `columns` replaced by its sum over the rows of the group up to this one, in `order` (which has no ties)."""
    ranged = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    inner = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # the ranges must be the same ones for the rows and for their totals
    ranged = stage(ranged.withColumns({c: F.sum(c).over(inner) for c in columns} | {
        f"_{c}": F.col(c) for c in columns}), name)
    totals = ranged.groupBy(*group, "_range").agg(*[F.sum(f"_{c}").alias(c) for c in columns])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*group, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    ranged = ranged.drop(*[f"_{c}" for c in columns])
    return ranged.join(shifts, [*group, "_range"]).withColumns(
        {c: F.col(c) + F.col(f"_{c}") for c in columns}).drop("_range", *[f"_{c}" for c in columns])


def jumped(state: DataFrame, waits: Column, name: str) -> DataFrame:
    """(id, to, steps) once no row waits: each that does jumps to where the row it points to points."""
    state = stage(state, name)
    while not state.where(waits).isEmpty():
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        moved = state.where(waits).join(ahead, "to").select("id", F.col("next").alias("to"), F.col("steps") + F.col("more"))
        state = stage(state.where(~F.coalesce(waits, F.lit(False))).union(moved), name)
    return state


def list_ranks(links: DataFrame, name: str = "ranks") -> DataFrame:
    """(id, rank) of every element of linked lists (id, next): how many elements follow it.

    The last element of a list has a null `next`; ids are distinct.
    """
    def splits(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(SPLITTERS)) == 0

    first = links.select("id", F.col("next").alias("to"), F.col("next").isNotNull().cast("long").alias("steps"))
    near = jumped(first, F.col("to").isNotNull() & ~splits("to"), f"{name}-near")
    far = jumped(near.where(splits("id")), F.col("to").isNotNull(), f"{name}-far")
    rest = far.select(F.col("id").alias("to"), F.col("steps").alias("more"))
    return near.join(rest, "to", "left").select("id", (F.col("steps") + F.coalesce("more", F.lit(0))).alias("rank"))


def prefix_names(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, name, parent, digest, bytes) from turns (conv_id, depth, digest, bytes).

    depth counts the turns of a conversation from 1 without gaps."""
    placed = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest"), 256)
    words = {w: F.conv(F.substring("_placed", 8 * i + 1, 8), 16, 10).cast("long") for i, w in enumerate(WORDS)}
    own = {f"own_{w}": F.col(w) for w in WORDS}
    rows = turns.withColumn("_placed", placed).withColumns(words).drop("_placed").withColumns(own)
    summed = running_sums(rows, ["conv_id"], ["depth"], WORDS, "trie-names")

    def named(words: list[Column]) -> Column:
        return F.concat(*[F.lpad(F.hex(w.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for w in words])

    return summed.select("conv_id", "depth", "digest", "bytes", named([F.col(w) for w in WORDS]).alias("name"),
                         named([F.col(w) - F.col(f"own_{w}") for w in WORDS]).alias("parent"))


def members_hash(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) from (name, conv_id): the hash of the ids in ascending order, comma-joined.

    Ids are joined in blocks of a bounded number; a task then feeds the blocks of a
    node to the hash one after the other and holds one of them at a time."""
    numbered = number_rows(ends, ["name"], ["conv_id"]).withColumn("block", F.expr(f"(n - 1) div {MEMBERS}"))
    listed = F.array_sort(F.collect_list("conv_id")).cast("array<string>")
    blocks = numbered.groupBy("name", "block").agg(F.array_join(listed, ",").alias("ids"))

    def run(batches):
        name = hashed = None
        for batch in batches:
            done = []
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != name:
                    if name is not None:
                        done.append((name, hashed.hexdigest()))
                    name, hashed = at, hashlib.sha256(ids.encode())
                else:
                    hashed.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["name", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([hashed.hexdigest()])], names=["name", "ends_sha256"])

    return blocks.repartition("name").sortWithinPartitions("name", "block").select("name", "ids").mapInArrow(
        run, "name string, ends_sha256 string")


def nodes_of(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, name, parent, conv_id, depth, n_convs, bytes): the root and a row for every distinct prefix."""
    one = (F.min("digest") == F.max("digest")) & (F.min("parent") == F.max("parent")) & (F.min("depth") == F.max("depth"))
    checked = F.when(one, F.min("parent")).otherwise(F.raise_error(F.lit("two prefixes have one name")))
    inner = steps.groupBy("name").agg(checked.alias("parent"), F.min("conv_id").alias("conv_id"),
                                      F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit("0" * 64).alias("name"), F.lit(None).cast("string").alias("parent"), "conv_id",
        F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("bytes"))
    return stage(inner.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "trie-nodes")


def tour(nodes: DataFrame) -> DataFrame:
    """The nodes (node, parent_node, ...) with their n_children and the arcs that follow theirs: after_in, after_out.

    The arc into a node has twice its number, the arc out of it one more."""
    kids = stage(number_rows(nodes.where("parent_node is not null").select("node", "parent_node"), ["parent_node"], ["node"]),
                 "trie-kids")
    following = kids.select("parent_node", (F.col("n") - 1).alias("n"), F.col("node").alias("sibling"))
    placed = kids.join(following, ["parent_node", "n"], "left").select("node", "sibling")
    first = kids.where("n = 1").select(F.col("parent_node").alias("node"), F.col("node").alias("child"))
    count = kids.groupBy("parent_node").agg(F.count("*").alias("n_children")).withColumnRenamed("parent_node", "node")
    around = nodes.join(first.join(count, "node"), "node", "left").join(placed, "node", "left")
    return around.select(
        *nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce(2 * F.col("child"), 2 * F.col("node") + 1).alias("after_in"),
        F.coalesce(2 * F.col("sibling"), 2 * F.col("parent_node") + 1).alias("after_out"))


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for every node of the trie of conversations.

    convs: (conv_id) distinct; turns: (conv_id, depth, digest, bytes) as for
    `prefix_names`.  Returns conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Without
    conversations there is no root; conversations without turns end at the root.
    """
    convs, steps = stage(convs, "trie-convs"), stage(prefix_names(turns), "trie-steps")
    nodes = nodes_of(convs, steps)
    above = nodes.select(F.col("name").alias("parent"), F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stage(tour(nodes.join(above, "parent", "left")), "trie-tour")

    last = steps.groupBy("conv_id").agg(F.max_by("name", "depth").alias("name"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("name", F.lit("0" * 64)).alias("name"))

    arcs = nodes.select(F.explode(F.array(
        F.struct((2 * F.col("node")).alias("id"), F.col("after_in").alias("next"),
                 (F.col("n_children") == 0).cast("long").alias("leaves"),
                 ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")),
        F.struct((2 * F.col("node") + 1).alias("id"), F.col("after_out").alias("next"), F.lit(0).cast("long").alias("leaves"),
                 F.lit(0).cast("long").alias("saved")))).alias("arc")).select("arc.*")
    arcs = stage(arcs, "trie-arcs")
    weighed = arcs.drop("next").join(list_ranks(arcs.select("id", "next"), "trie-ranks"), "id")
    own = {"own_leaves": F.col("leaves"), "own_saved": F.col("saved")}
    summed = running_sums(weighed.withColumn("place", -F.col("rank")).withColumns(own), [], ["place"], ["leaves", "saved"],
                          "trie-sums")
    # up to the arc out of a node, less what stands before the arc into it
    out = F.col("id") % 2 == 1
    below = summed.groupBy(F.shiftright("id", 1).alias("node")).agg(*[
        F.sum(F.when(out, F.col(c)).otherwise(F.col(f"own_{c}") - F.col(c))).alias(c) for c in ("leaves", "saved")])
    return nodes.join(below, "node").join(members_hash(ends), "name", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, digest, bytes): turns numbered from 1 by turn, a null one first, equal ones by digest.

    A null role or text counts as empty.  Rows without a conversation take no part."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return number_rows(stage(rows, "trie-turns"), ["conv_id"], ["turn", "digest"])


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(convs, turns) with the opening of each conversation taken from the one that names its family.

    That is conversation c - c % family; its first h turns, crc32(c) % (most + 1) of
    them, come before the conversation's own turns after its first h."""
    numbered = stage(ordered_turns(conversations), "trie-numbered")
    sizes = stage(numbered.groupBy("conv_id").agg(F.max("n").alias("size")), "trie-sizes")
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
                         (id_crc("conv_id") % (most + 1)).alias("h"))
    convs = convs.join(sizes.withColumnsRenamed({"conv_id": "base"}), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("size", F.lit(0))).cast("long").alias("taken"))
    heads = numbered.where(F.col("n") <= most).withColumnRenamed("conv_id", "base").join(convs, "base").where("n <= h").select(
        "conv_id", F.col("n").cast("long").alias("depth"), "digest", "bytes")
    tails = numbered.join(convs, "conv_id").where("n > h").select(
        "conv_id", (F.col("n") - F.col("h") + F.col("taken")).cast("long").alias("depth"), "digest", "bytes")
    return convs.select("conv_id"), heads.union(tails)


def op12_eulertour(spark, sf_dir) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


SQL = """
with crc_table as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, x:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(256) r(i)),
turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (
    partition by conv_id order by turn nulls first,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as n
  from conversations where conv_id is not null),
sizes as (select conv_id, max(n) as size from turns group by conv_id),
convs as (
  select s.conv_id, s.conv_id - s.conv_id % 5 as base, b.size as base_size, xor(list_reduce(list_prepend(4294967295,
      list_transform(string_split(cast(s.conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 9 as h
  from sizes s cross join crc_table left join sizes b on b.conv_id = s.conv_id - s.conv_id % 5),
steps as (
  select c.conv_id, n as depth, role, text from convs c join turns t on t.conv_id = c.base and n <= h
  union all
  select c.conv_id, n - h + least(h, coalesce(base_size, 0)), role, text from convs c join turns t on t.conv_id = c.conv_id and n > h),
named as (
  select conv_id, depth, text, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '')
    over (partition by conv_id order by depth) as prefix
  from steps
  union all select conv_id, 0, '', '' from convs),
members as (
  select *, min(conv_id) over (partition by depth, prefix) as top,
    depth = max(depth) over (partition by conv_id) as is_end
  from named),
nodes as (
  select top as conv_id, depth, count(*) as n_convs, (count(*) - 1) * max(strlen(text)) as saved,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (is_end), '')) as ends_sha256
  from members group by top, depth),
family as (
  select n.*, p.top as parent_conv_id
  from nodes n left join members p on p.conv_id = n.conv_id and p.depth = n.depth - 1),
children as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from family where depth > 0 group by all),
counted as (select f.*, coalesce(n_children, 0) as n_children from family f left join children using (conv_id, depth)),
below as (
  select m.top as conv_id, m.depth, sum(cast(c.n_children = 0 as bigint)) as n_leaves, sum(c.saved) as saved_tokens
  from counted c join members m on m.conv_id = c.conv_id and m.depth <= c.depth group by m.top, m.depth)
select conv_id, cast(depth as bigint) as depth, parent_conv_id, n_convs, n_children, cast(n_leaves as bigint) as n_leaves,
  cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from counted join below using (conv_id, depth)
"""

QUERIES = {"op12_eulertour": (op12_eulertour, SQL)}
