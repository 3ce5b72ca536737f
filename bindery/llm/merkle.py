"""A Merkle manifest of a dataset: one hash for all rows, and a proof for each row.

Rows are leaves of one tree per group; the trees' roots, in the order of their
groups, are the leaves of the tree on top.  Nodes are numbered along their level.
At every level a node meets its siblings by equijoins on computed indices: the
own index with its last bit flipped where a run has two nodes, else the indices
at each offset of the slot, modulo the run.  The rows of slot zero, which then
hold the whole run, emit the parents.  On the way back every node hands its own
siblings and those of its ancestors to its children, so a proof is built once for
all leaves below a node.

(tree, index) is unique at every level, so no key is hot however large one group
is; the leaves are numbered by ranges.  A level has the arity's share of the rows
of the one below it, so all levels together cost little more than the leaves.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..staging import stage
from .common import id_crc, table

#: nodes of a run, 2 to 36
ARITY = 2
#: rows whose id digest this divides are changed before they are verified
TAMPER = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODE = ["tree", "at", "n", "hash"]


def digest(*parts) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it is hashed: `-` for null, else the byte count of its text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def shown(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def height(n: str, arity: int) -> Column:
    """Levels above n leaves: the digits of n - 1."""
    return F.when(F.col(n) == 1, 0).otherwise(F.length(F.conv((F.col(n) - 1).cast("string"), 10, arity)))


def levels(leaves: DataFrame, arity: int, tallest: int, name: str) -> list[DataFrame]:
    """The levels of all trees, leaves first, each with slot and others: the siblings' hashes from left to right, as bytes.

    leaves: (tree, at, n, hash, ...) with the 0-based index along the level and
    the tree's nodes at it.  Each tree ends at the level where it has one node.
    """
    out = []
    for _ in range(tallest):
        siblings = leaves.select(F.col("tree").alias("its_tree"), F.col("at").alias("its_at"), F.col("hash").alias("its_hash"))
        rows, found = leaves.withColumn("slot", F.col("at") % arity), []
        for offset in range(1, arity):
            slot = (F.col("slot") + offset) % arity
            at = F.col("at").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("at") - F.col("slot") + slot
            rows = rows.withColumn("want", at).join(
                siblings, (F.col("tree") == F.col("its_tree")) & (F.col("want") == F.col("its_at")), "left")
            rows = rows.withColumnRenamed("its_hash", f"hash_{offset}").drop("its_tree", "its_at", "want")
            hashed = F.col(f"hash_{offset}")
            found.append(F.when(hashed.isNotNull(), F.struct(slot.alias("slot"), hashed.alias("hash"))))
        others = F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda s: s["hash"])
        rows = rows.withColumn("others", F.unhex(F.array_join(others, "")))
        rows = stage(rows.drop(*[f"hash_{offset}" for offset in range(1, arity)]), f"{name}-level")
        out.append(rows)
        leaves = rows.where("slot = 0 and n > 1").select(
            "tree", F.expr(f"at div {arity}").alias("at"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            digest("hash", shown(F.col("others"))).alias("hash"))
    return [*out, leaves.withColumns({"slot": F.lit(0).cast("long"), "others": F.lit(b"")})]


def paths(tree_levels: list[DataFrame], heights: set[int], arity: int, above: DataFrame) -> DataFrame:
    """The leaves with path, subroot and root; path lists (slot, others) from the leaf's level to the last one.

    above: (tree, path, root) of each tree's own root in the tree on top.
    """
    found = None
    for level in reversed(range(len(tree_levels))):
        rows, parts = tree_levels[level], []
        if level in heights:
            parts.append(rows.where("n = 1").join(above, "tree").withColumn("subroot", F.col("hash")))
        if found is not None:
            up = found.select("tree", F.col("at").alias("up"), "path", "root", "subroot")
            step = F.array(F.struct(F.col("slot").cast("int").alias("slot"), "others"))
            below = rows.where("n > 1").withColumn("up", F.expr(f"at div {arity}")).join(up, ["tree", "up"]).drop("up")
            parts.append(below.withColumn("path", F.concat(step, "path")))
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        found = found.drop("slot", "others")
    return found


def forest(leaves: DataFrame, order: list[str], arity: int, above, name: str) -> DataFrame:
    """The leaves (tree, hash, ...), numbered in `order` inside their tree, with their paths.

    above: gives (tree, path, root) of the trees from their roots (tree, hash)."""
    numbered = number_rows(leaves, ["tree"], order)
    sizes = numbered.groupBy("tree").agg(F.max("n").alias("size"))
    leaves = stage(numbered.withColumn("at", F.col("n") - 1).drop("n").join(sizes, "tree").withColumnRenamed("size", "n"),
                   f"{name}-leaves")
    # a level count below 64 for each tree
    heights = {r[0] for r in leaves.select(height("n", arity)).distinct().collect()} or {0}
    tree_levels = levels(leaves, arity, max(heights), name)
    tops = [rows.where("n = 1").select("tree", "hash") for level, rows in enumerate(tree_levels) if level in heights]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.union(more)
    return paths(tree_levels, heights, arity, above(stage(roots, f"{name}-roots")))


def manifest(leaves: DataFrame, order: list[str], arity: int = ARITY) -> DataFrame:
    """(tree, at, n, hash, path, subroot, root, ...) for every row of `leaves`: (tree, hash, ...).

    Rows of one tree ascend by `order` and by their hash, so rows that are alike
    in both can stand in either place.  Trees ascend by their key, which must not
    be null.  Columns named like these are not allowed in `leaves`, others are
    kept.  No rows give no rows.
    """
    def on_top(roots: DataFrame) -> DataFrame:
        no_path = F.array().cast("array<struct<slot: int, others: binary>>").alias("path")
        top = roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "hash")
        one = forest(top, ["key"], arity, lambda root: root.select("tree", no_path, F.col("hash").alias("root")),
                     "manifest-top")
        return stage(one.select(F.col("key").alias("tree"), "path", "root"), "manifest-above")

    return forest(leaves, [*order, "hash"], arity, on_top, "manifest")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    def up(node: Column, step: Column) -> Column:
        cut = 32 * step["slot"]
        left, right = F.substr(step["others"], F.lit(1), cut), F.substr(step["others"], cut + 1)
        return digest(shown(left), node, shown(right))

    return F.aggregate(path, leaf, up)


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: shown(step["others"])), ""), 256)


def document_leaves(docs: DataFrame, tamper: int = TAMPER) -> DataFrame:
    """(tree, doc_id, hash, forged) of every row: its language's tree, its leaf, and the leaf of the row as changed.

    Any field may be null.  Rows with a null language have a tree of their own, the
    first; those with a null id come first in their tree and are never changed.
    Repeated rows are leaves of their own.  The change adds one to n_chars, which a
    null does not show; at the largest number it makes it null.
    """
    changed = [F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]
    forged = F.when(id_crc("doc_id") % tamper == 0, leaf_hash(changed))
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    return docs.select(tree.alias("tree"), "doc_id", leaf_hash([F.col(c) for c in FIELDS]).alias("hash"), forged.alias("forged"))


def verified(docs: DataFrame, arity: int = ARITY, tamper: int = TAMPER) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of a table like `documents`."""
    # hashed once, before the rows are dealt by ranges
    rows = manifest(stage(document_leaves(docs, tamper), "manifest-hashed"), ["doc_id"], arity)
    return rows.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("forged", "hash"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark, sf_dir) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


SQL = """
with recursive crc_table as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, x:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(256) r(i)),
crcs as (
  select doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc
  from (select distinct doc_id from documents where doc_id is not null), crc_table),
fields as (
  select d.doc_id, lang, coalesce(crc % 7 = 0, false) as changed, n_chars as n,
    coalesce(strlen(cast(d.doc_id as varchar)) || ':' || d.doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail
  from documents d left join crcs on d.doc_id = crcs.doc_id),
hashed as (
  select doc_id, lang, sha256(head || coalesce(strlen(cast(n as varchar)) || ':' || n, '-') || tail) as leaf,
    case when changed then sha256(head || coalesce(strlen(cast(n + 1 as varchar)) || ':' || (n + 1), '-') || tail) end as forged
  from fields),
leaves as (
  select *, dense_rank() over (order by lang nulls first) as tree,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n
  from hashed),
low as (
  select 0 as level, tree, pos, n, leaf as hash from leaves
  union all
  select level + 1, tree, pos // 2, (max(n) + 1) // 2, sha256(string_agg(hash, '' order by pos))
  from low where n > 1 group by level, tree, pos // 2),
subroots as (select tree, hash as subroot, tree - 1 as pos, count(*) over () as n from low where n = 1),
high as (
  select 0 as level, pos, n, subroot as hash from subroots
  union all
  select level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(hash, '' order by pos))
  from high where n > 1 group by level, pos // 2),
steps as (
  select l.tree, l.pos, s.level, (l.pos >> s.level) & 1 as slot, b.hash
  from leaves l join (select distinct tree, level from low where n > 1) s on l.tree = s.tree
  left join low b on b.tree = l.tree and b.level = s.level and b.pos = xor(l.pos >> s.level, 1)
  union all
  select l.tree, l.pos, 100 + s.level, ((l.tree - 1) >> s.level) & 1, b.hash
  from leaves l cross join (select distinct level from high where n > 1) s
  left join high b on b.level = s.level and b.pos = xor((l.tree - 1) >> s.level, 1)),
proofs as (
  select tree, pos, sha256(string_agg(coalesce(hash, ''), '' order by level)) as proof,
    list({'slot': slot, 'hash': coalesce(hash, '')} order by level) as path
  from steps group by tree, pos),
folding as (
  select l.tree, l.pos, coalesce(forged, leaf) as node, coalesce(path, []) as path, 1 as step
  from leaves l left join proofs p on l.tree = p.tree and l.pos = p.pos
  union all
  select tree, pos, case when path[step].slot = 1 then sha256(path[step].hash || node) else sha256(node || path[step].hash) end,
    path, step + 1
  from folding where step <= len(path))
select doc_id, leaf, subroot, root, coalesce(proof, sha256('')) as proof_sha256, node as folded_root, node = root as verified
from leaves l join subroots s on l.tree = s.tree cross join (select hash as root from high where n = 1) r
left join proofs p on l.tree = p.tree and l.pos = p.pos
join folding f on l.tree = f.tree and l.pos = f.pos and step = len(f.path) + 1
"""

QUERIES = {"op13_merkle": (op13_merkle, SQL)}
