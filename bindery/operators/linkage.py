"""Record linkage inside each project: blocks -> candidate pairs -> score.

Rows meet through block keys (normalised name, value hash, name token).  Rows
of a scope can only pair inside their file, so they meet under (file, key);
only rows without a scope meet across the files of a project.  Every block
links; a caller may set a bound, and `unlinked_blocks` names what it leaves out.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..functions import vocab
from ..schema import KEY, REVIEWS
from ..staging import stage
from .latest import latest

# an oversized block outside the largest HOT_BLOCKS holds under 1/HOT_BLOCKS of
# all block rows, which is no more than one task's fair share
HOT_BLOCKS = 1024
# rows of a block that meet in one place; a larger block is paired in cells of that many rows squared
CELL_ROWS = 512
# what one task of a pairing is given: row pairs to look at, and rows to read
TASK_PAIRS, TASK_ROWS, MOST_TASKS = 1 << 21, 1 << 15, 20_000
# 32-bit hashes of verdict keys that are broadcast, at most
MOST_HASHES = 1 << 21
FAMILY_REASONS = ["token-overlap", "shared-token"]
SAME_NAME_REASONS = ["value-mismatch", "same-name", "same-name-same-value"]
# what a meeting of two rows is decided by
MET_BY = ["id", "file", "scope", "name", "line", "lang", "dir", "env_template", "unit", "telling", "norm", "anchor", "value_hash",
          "blocks", "keys", "at", "n"]
# what `score` and the columns of a scored pair read besides
SCORED_BY = ["tokens", "key_id", "odd_name", "trunk", "core", "words", "stems", "wide", "plain", "role",
             "same_value_ok", "env_read", "idiom", "test", "ignored", "convention", "link_text", "link_words", "refs"]
SHOWN_BY = ["status", "show_line", "show_value", "show_origin", "show_last_session", "show_note", "show_repo_value", "show_redacted"]
SIDE_FIELDS = ["id", "name", "file", "scope", "line", "value", "status", "origin", "lang",
               "last_session", "note", "repo_value", "redacted"]


# ----------------------------------------------------------------- features

def live_rows(registry: DataFrame) -> DataFrame:
    return registry.filter(~F.col("status").isin("file_deleted", "missing"))


def linkable(registry: DataFrame) -> DataFrame:
    """Rows that can take part: present in their file, no member target, no dunder."""
    return live_rows(registry).filter(_linkable_name(F.col("name")))


def _linkable_name(name: Column) -> Column:
    return ~name.contains(".") & ~N.is_dunder(name)


def features(registry: DataFrame, settings: dict | None = None) -> DataFrame:
    """Everything the pair rules need of a linkable row, computed once per row."""
    return live_features(registry, settings).filter("linkable").drop("linkable")


def with_values(registry: DataFrame, extracted: DataFrame) -> DataFrame:
    """Add `_whole`: the whole value of each row as extracted (key columns, ord, value), where its file holds it."""
    whole = latest(extracted, KEY, ["ord"]).select(*KEY, F.col("value").alias("_whole"))
    return registry.join(whole, KEY, "left")


def live_features(registry: DataFrame, settings: dict | None = None, extracted: DataFrame | None = None) -> DataFrame:
    """Features of all live rows; names outside `linkable` still count as known.

    The registry keeps a preview of each value, which is what the rules read.
    With the `extracted` rows at hand they read the whole value, unless it is
    redacted; the preview is shown in either case."""
    cfg = {**vocab.DEFAULT_SETTINGS, **(settings or {})}
    name, preview, file = F.col("name"), F.col("value_preview"), F.col("file")
    value = preview
    if extracted is not None:
        registry = with_values(registry, extracted)
        value = F.when(F.col("redacted"), preview).otherwise(F.coalesce("_whole", preview))
    destructured = F.coalesce(F.col("kind"), F.lit("")).endswith("-destructure")
    norm = N.norm_name(name)
    visible = F.when(~F.col("redacted"), F.coalesce(value, F.lit(""))).otherwise("")
    # whole words of the text that are not the member part of a dotted chain
    spelled = r"(?U)(?<![\w.])\w+"
    words = N.ordered_tokens(name)
    ignored = _norms(vocab.IGNORED_NAMES + list(cfg["dup_ignore_names"] or []))
    convention = _norms(list(cfg["dup_ignore_crossfile_names"] or []))
    df = live_rows(registry).withColumns({
        "linkable": _linkable_name(name), "norm": norm, "tokens": N.name_tokens(name), "_bare": X.bare_value(value), "_visible": visible})
    df = df.withColumn("anchor", X.nontrivial_bare(F.col("_bare"), F.col("redacted")) & ~destructured)
    visible = F.col("_visible")
    df = df.withColumn("key_id", N.key_side(file, F.col("scope"), name))
    df = df.withColumn("link_text", F.concat_ws(" \n ", visible, F.coalesce("anno", F.lit(""))))
    return df.select(
        "project", N.row_id(file, F.col("scope"), name).alias("id"),
        "linkable", "file", "scope", "name", "lang", "status", "value_hash",
        F.coalesce("line", F.lit(0)).alias("line"),
        N.dir_of(file).alias("dir"), "norm", "tokens", "key_id",
        name.rlike(r"(?U)\W").alias("odd_name"),
        N.without_digits_tail(name).alias("trunk"), F.ltrim(name, F.lit("_")).alias("core"),
        words.alias("words"), F.transform(words, N.stem).alias("stems"),
        # what the pair rules ask of tokens, made once per row
        F.filter("tokens", lambda t: F.length(t) >= 3).alias("telling"), F.filter("tokens", lambda t: F.length(t) >= 4).alias("wide"),
        F.array_except("tokens", X.words(vocab.GENERIC_TOKENS)).alias("plain"),
        N.role(name, F.col("lang")).alias("role"),
        "anchor", (F.col("anchor") & (F.col("status") != "drifted")).alias("same_value_ok"),
        X.env_read(value).alias("env_read"), X.idiom_rhs(value).alias("idiom"),
        N.is_test_path(file).alias("test"),
        ((F.col("lang") == "env") & N.is_env_template(file)).alias("env_template"),
        X.one_of(F.col("norm"), ignored).alias("ignored"), X.one_of(F.col("norm"), convention).alias("convention"),
        "link_text",
        F.array_distinct(F.regexp_extract_all(F.col("link_text"), F.lit(spelled), F.lit(0))).alias("link_words"),
        F.filter(F.array_distinct(F.regexp_extract_all(
            visible, F.lit(r"(?U)[A-Za-z_$][\w$]*"), F.lit(0))), N.constant_like).alias("mentions"),
        # display columns of the sides
        F.coalesce(F.when(F.col("repo_line") != 0, F.col("repo_line")), F.col("line")).alias("show_line"),
        preview.alias("show_value"), F.col("origin").alias("show_origin"),
        X.prefix(F.col("last_session"), 8).alias("show_last_session"), F.col("note").alias("show_note"),
        F.col("repo_value_preview").alias("show_repo_value"), F.col("redacted").alias("show_redacted"))


def _norms(words: list[str]) -> list[str]:
    """Normalised spelling of configured names (driver side: a short list)."""
    return sorted({re.sub("[^a-z0-9]", "", str(w).lower()) for w in words})


def with_references(feats: DataFrame, live: DataFrame) -> DataFrame:
    """Replace `mentions` by those that are live names of the project."""
    known = live.select("project", "name").distinct()
    refs = (feats.select("project", "id", F.explode("mentions").alias("name"))
            .join(known, ["project", "name"], "left_semi")
            .groupBy("project", "id").agg(F.array_sort(F.collect_set("name")).alias("refs")))
    return (feats.drop("mentions").join(refs, ["project", "id"], "left")
            .withColumn("refs", F.coalesce("refs", F.array().cast("array<string>"))))


def assign_units(registry: DataFrame, patterns: DataFrame) -> DataFrame:
    """Add `unit`: the standalone unit of each file (patterns: project, pattern)."""
    per_project = patterns.groupBy("project").agg(
        F.array_sort(F.collect_set("pattern")).alias("_patterns"))
    return (registry.join(per_project, "project", "left")
            .withColumn("unit", N.unit_key(F.col("file"), F.col("_patterns"))).drop("_patterns"))


def auto_unit_patterns(paths: DataFrame, exclude_dirs: list[str] | None = None) -> DataFrame:
    """'*' for projects with a manifest under at least two top directories."""
    exclude = vocab.DEFAULT_SETTINGS["exclude_dirs"] if exclude_dirs is None else exclude_dirs
    segs = F.split("path", "/")
    dirs = F.slice(segs, F.lit(1), F.size(segs) - 1)
    open_dirs = F.forall(dirs, lambda d: ~d.startswith(".") & ~d.isin(list(exclude)))
    shipped = paths.filter(
        F.size(dirs).between(1, 4) & open_dirs
        & X.one_of(F.lower(F.element_at(segs, -1)), vocab.UNIT_MANIFESTS))
    tops = shipped.select("project", F.get(segs, F.lit(0)).alias("top")).distinct()
    return tops.groupBy("project").count().filter("count >= 2").select(
        "project", F.lit("*").alias("pattern"))


# ------------------------------------------------------------------- blocks

def _keys() -> Column:
    tokens = F.transform(F.filter("tokens", lambda t: F.length(t) >= 3),
                         lambda t: F.concat(F.lit("t:"), t))
    value_key = F.when(F.col("anchor"), F.array(F.concat(F.lit("h:"), F.coalesce("value_hash", F.lit("")))))
    return F.concat(F.array(F.concat(F.lit("n:"), F.col("norm"))),
                    F.coalesce(value_key, F.array().cast("array<string>")), tokens)


def block_keys(feats: DataFrame) -> DataFrame:
    return feats.select("project", "id", F.explode(_keys()).alias("block"))


def block_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("project", "block").agg(F.count(F.lit(1)).alias("block_rows"))


def filter_blocks(blocks: DataFrame, max_bucket: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Rows of the blocks with two members or more, and with a bound no more than that.

    The largest blocks over a bound are dropped before the shuffle (at most
    HOT_BLOCKS keys are broadcast); the join with the sizes decides all the
    others exactly."""
    if sizes is None:
        sizes = block_sizes(blocks.select("project", "block"))
    if max_bucket is None:
        kept = sizes.filter("block_rows > 1").select("project", "block")
        return blocks.join(kept.hint("merge"), ["project", "block"])
    hot = (sizes.filter(F.col("block_rows") > max_bucket)
           .orderBy(F.desc("block_rows"), "project", "block").limit(HOT_BLOCKS)
           .select("project", "block"))
    kept = sizes.filter(F.col("block_rows").between(2, max_bucket)).select("project", "block")
    return (blocks.join(F.broadcast(hot), ["project", "block"], "left_anti")
            .join(kept.hint("merge"), ["project", "block"]))


def unlinked_blocks(sizes: DataFrame, max_bucket: int) -> DataFrame:
    """(project, block, rows) of the blocks that a bound leaves out."""
    return sizes.filter(F.col("block_rows") > max_bucket).select("project", "block", F.col("block_rows").alias("rows"))


def candidate_pairs(blocks: DataFrame) -> DataFrame:
    """Distinct id pairs that share a (filtered) block.

    A pair is given in the largest block that both ids have, so pairs are not shuffled to find those that come
    twice; large blocks are paired in cells.  Blocks go by a number of their own."""
    rows = blocks.select("project", "block", "id").dropna().distinct()
    sizes = rows.groupBy("project", "block").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    sizes = stage(sizes.withColumns({"_nth": F.monotonically_increasing_id(), "_parts": F.ceil(F.col("_rows") / CELL_ROWS).cast("int")}),
                  "candidate-blocks")
    tasks = _tasks(sizes)
    held = rows.join(sizes.hint("merge"), ["project", "block"]).groupBy("project", "id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_rows")).alias("order"), "_nth", "_parts"))).alias("_held"))
    held = stage(held.withColumn("_blocks", F.col("_held._nth")), "candidate-rows")
    cells = held.select("project", "id", "_blocks", F.posexplode("_held").alias("_at", "_block")).select(
        "project", "id", "_blocks", F.slice("_blocks", F.lit(1), F.col("_at")).alias("_before"), F.col("_block._nth").alias("_nth"),
        F.pmod(F.xxhash64("id"), F.col("_block._parts")).cast("int").alias("_part"),
        F.explode(F.sequence(F.lit(0), F.col("_block._parts") - 1)).alias("_other"))
    on = ["_nth", "_first", "_second"]
    a = cells.select("_nth", F.col("_part").alias("_first"), F.col("_other").alias("_second"), "project", F.col("id").alias("id_a"), "_before")
    b = cells.select("_nth", F.col("_other").alias("_first"), F.col("_part").alias("_second"), F.col("id").alias("id_b"), "_blocks")
    return (a.repartition(tasks, *on).hint("merge").join(b.repartition(tasks, *on), on)
            .filter((F.col("id_a") < F.col("id_b")) & ~F.arrays_overlap("_before", "_blocks")).select("project", "id_a", "id_b"))


def _tasks(sizes: DataFrame) -> int:
    """Tasks for pairing blocks of `_rows` rows in `_parts` squared cells: the work grows with the square of a
    block, which the bytes of its rows do not tell."""
    work = sizes.agg(F.sum(F.col("_rows") * F.col("_rows") / TASK_PAIRS + F.col("_rows") * F.col("_parts") / TASK_ROWS)).first()[0]
    return min(MOST_TASKS, 1 + int(work or 0))


def overlap_keys(feats: DataFrame) -> DataFrame:
    """Add `overlap`: the tokens under which a row meets all that share half of both rows' tokens, as (block, at, n).

    Half of the tokens of two rows of two tokens or more is at least two tokens
    and a third of their sum.  With a row's tokens in order of rarity, the first
    shared one cannot stand so late that fewer than that are left; a token that
    one row alone has meets nothing and just takes its place."""
    listed = feats.select("project", "id", F.explode("tokens").alias("token"))
    held = listed.groupBy("project", "token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    rare = listed.join(held, ["project", "token"]).groupBy("project", "id").agg(
        F.array_sort(F.collect_list(F.struct("held", "token"))).alias("_rare"))
    n = F.size("tokens")
    # the smallest other row has half as many tokens
    least = F.greatest(F.lit(2), F.ceil((n + F.ceil(n / 2)) / 3))
    alone = n - F.size("_rare")
    first = F.slice("_rare", 1, F.greatest(F.lit(0), n - least + 1 - alone).cast("int"))
    keys = F.transform(first, lambda e, i: F.struct(F.concat(F.lit("o:"), e["token"]).alias("block"), (alone + i).alias("at"), n.alias("n")))
    none = F.array().cast("array<struct<block:string,at:int,n:int>>")
    return feats.join(rare, ["project", "id"], "left").withColumn("overlap", F.coalesce(keys, none)).drop("_rare")


def _exact_keys() -> Column:
    """Blocks of rows that may pair by name, by value, by a token of few or by a reference, as (block, at, n)."""
    generic = X.words(vocab.GENERIC_TOKENS)
    wide = F.filter("tokens", lambda t: F.length(t) >= 4)
    plain = F.array_except(wide, generic)
    # a generic token counts only beside another one, which is short or a plain one
    beside = F.array_except(F.filter("tokens", lambda t: F.length(t) < 4), generic)
    both = F.flatten(F.transform(F.array_intersect(wide, generic), lambda t: F.transform(
        beside, lambda u: F.concat(F.lit("c:"), t, F.lit(" "), u))))
    few = F.when(F.size("tokens") <= 3, F.concat(F.transform(plain, lambda t: F.concat(F.lit("s:"), t)), both))
    none = F.array().cast("array<string>")
    value_key = F.when(F.col("anchor"), F.array(F.concat(F.lit("h:"), F.coalesce("value_hash", F.lit("")))))
    blocks = F.concat(F.array(F.concat(F.lit("n:"), F.col("norm"))), F.coalesce(value_key, none), F.coalesce(few, none),
                      F.transform("refs", lambda r: F.concat(F.lit("r:"), r)))
    return F.transform(blocks, lambda k: F.struct(k.alias("block"), F.lit(0).alias("at"), F.lit(0).alias("n")))


def share_token(a: Side, b: Side) -> Column:
    """What makes two rows candidates if neither name nor value does."""
    return F.arrays_overlap(a["telling"], b["telling"])


def candidates(a: Side, b: Side) -> Column:
    """Rows of one norm, of one telling value or with a common token: what a block of `block_keys` holds."""
    value = a["anchor"] & b["anchor"] & (F.coalesce(a["value_hash"], F.lit("")) == F.coalesce(b["value_hash"], F.lit("")))
    return (a["norm"] == b["norm"]) | value | share_token(a, b)


def named_pairs(feats: DataFrame) -> DataFrame:
    """Distinct (project, id_a, id_b) where the text of one row holds the name of the other, or its first word.

    Rows of a scope meet inside their file.  The name that a word spells has that
    word's tokens, so words without a token of the row's own meet only names of
    several words."""
    place = ["project", "file", "scope", "id"]
    rows = feats.filter(F.length("name") >= 3)
    words = rows.select(*place, "tokens", F.explode("link_words").alias("word")).withColumn(
        "akin", F.exists(F.array_intersect("tokens", N.name_tokens(F.col("word"))), lambda t: F.length(t) >= 3)).drop("tokens")
    targets = rows.select(*[F.col(c).alias(f"t_{c}") if c not in ("project", "file") else F.col(c) for c in place], "odd_name",
                          F.regexp_extract("name", r"(?U)\w+", 0).alias("word"))

    def met(words, targets, keys, condition):
        if "file" not in keys:
            targets = targets.drop("file")
        return words.join(targets, keys).filter((F.col("akin") | F.col("odd_name")) & (F.col("id") != F.col("t_id")) & condition).select(
            "project", F.least("id", "t_id").alias("id_a"), F.greatest("id", "t_id").alias("id_b"))

    across = met(words.filter("scope = ''"), targets.filter("t_scope = ''"), ["project", "word"], F.lit(True))
    within = met(words, targets, ["project", "file", "word"], (F.col("scope") != "") | (F.col("t_scope") != ""))
    return across.union(within).distinct()


def blocked_pairs(feats: DataFrame, max_bucket: int | None = None, whole: bool = False) -> DataFrame:
    """`packed_pairs` with every feature of both sides as a column of its own."""
    own = [c for c in feats.columns if c != "project"]
    a, b = Side("a", packed=True), Side("b", packed=True)
    return packed_pairs(feats, own, max_bucket, whole).select("project", *[x[c].alias(f"{x.tag}_{c}") for x in (a, b) for c in own])


def packed_pairs(feats: DataFrame, own: list[str], max_bucket: int | None = None, whole: bool = False) -> DataFrame:
    """Eligible pairs with the features `own` of both sides, `packed`: once each, but per shared block with `whole` or a bound.

    The block rows carry their features, so a pair needs no second look-up of its
    sides, and the blocks of their row: a pair is looked at in the first block that
    both rows have.  Rows that share no more than a
    common token do not meet: each rule that names with different words can pair
    by has keys of its own (`overlap_keys`, `_exact_keys`, `named_pairs`), so a
    block of a common token grows with the pairs it gives.  With a bound the
    blocks of `block_keys` up to that size are paired whole, with `whole` all of them."""
    a, b = Side("a"), Side("b")
    if whole or max_bucket is not None:
        rows = feats.withColumn("block", F.explode(_keys()))
        if max_bucket is not None:
            rows = filter_blocks(rows, max_bucket, block_sizes(block_keys(feats)))
        return _met(rows, own, F.lit(True))
    # sizes and sides of both meetings read the keyed rows: they are computed once and staged
    # blocks are compared and met by their hash; what meets by chance is no candidate
    spelled = F.filter(F.concat(_exact_keys(), "overlap"), lambda k: k["block"].isNotNull())
    hashed = F.transform(spelled, lambda k: F.struct(F.xxhash64(k["block"]).alias("block"), k["at"].alias("at"), k["n"].alias("n")))
    keyed = overlap_keys(feats).withColumn("keys", F.array_distinct(hashed)).withColumn("blocks", F.array_distinct("keys.block"))
    own = [*own, "blocks"]
    keyed = stage(keyed.select("project", *own, "keys"), "keyed")
    rows = keyed.withColumn("key", F.explode("keys")).select(
        "project", *own, "key.block", F.col("key.at").alias("at"), F.col("key.n").alias("n"))
    left = F.least(a["n"] - a["at"], b["n"] - b["at"])
    # keys of tokens come last and in order of rarity: where the first one fits too late, every later one does
    first = F.get(F.array_intersect(a["blocks"], b["blocks"]), F.lit(0)) == F.col("k_block")
    blocked = _met(rows, [*own, "at", "n"], (left >= F.ceil((a["n"] + b["n"]) / 3)) & first & candidates(a, b))
    blocked = blocked.drop("a_at", "a_n", "b_at", "b_n")
    named = stage(named_pairs(feats), "named-pairs")
    for side in "ab":
        named = named.join(packed(keyed, side, own, "project", F.col("keys").alias(f"{side}_keys")).withColumn(
            f"id_{side}", F.col(f"{side}_id")), ["project", f"id_{side}"])
    # those that the blocks have given are not given again
    first = F.get(F.array_intersect(a["blocks"], b["blocks"]), F.lit(0))
    at_a, at_b = (F.get(F.filter(x["keys"], lambda k: k["block"] == first), F.lit(0)) for x in (a, b))
    given = F.least(at_a["n"] - at_a["at"], at_b["n"] - at_b["at"]) >= F.ceil((at_a["n"] + at_b["n"]) / 3)
    named = named.drop("id_a", "id_b").filter(share_token(a, b) & eligible(a, b) & ~F.coalesce(given, F.lit(False)))
    return blocked.unionByName(named.drop("a_keys", "b_keys")).drop("a_blocks", "b_blocks")


def packed(rows: DataFrame, tag: str, own: list[str], *keep: Column | str) -> DataFrame:
    """Rows as the side `tag` of a join: the columns that decide the meeting, all others of `own` in one.

    The code of a join names each column of both sides; with all of them apart it
    grows past the 8,000 bytes up to which the JVM compiles a method."""
    rest = [c for c in own if c not in MET_BY]
    return rows.select(*keep, *[F.col(c).alias(f"{tag}_{c}") for c in own if c in MET_BY],
                       *([F.struct(*rest).alias(f"{tag}_rest")] if rest else []))


def _met(rows: DataFrame, own: list[str], condition: Column) -> DataFrame:
    """Eligible pairs of rows (project, block, own columns) that share a block: unscoped ones, and those of one file."""
    a, b = Side("a"), Side("b")

    def met(rows, keys, also):
        at = ["project", *keys]
        sizes = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").withColumn(
            "_parts", F.ceil(F.col("_rows") / CELL_ROWS).cast("int"))
        sizes = stage(sizes, "block-sizes")
        tasks = _tasks(sizes)
        sizes = sizes.select(*at, "_parts")
        rows = rows.join(sizes.hint("merge"), at).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))

        # a row of part i as side a and one of part j as side b meet in the cell (i, j) alone
        on = ["project", *[f"k_{c}" for c in keys], "k_first", "k_second"]

        def side(tag, first, second):
            cells = rows.withColumn("_other", every)
            return packed(cells, tag, own, "project", *[F.col(c).alias(f"k_{c}") for c in keys], F.col(first).alias("k_first"),
                          F.col(second).alias("k_second")).repartition(tasks, *on)

        return side("a", "_part", "_other").hint("merge").join(side("b", "_other", "_part"), on).filter(
            (a["id"] < b["id"]) & also & condition & eligible(a, b)).drop(*on[1:])

    across = met(rows.filter("scope = ''"), ["block"], F.lit(True))
    within = met(rows, ["file", "block"], (a["scope"] != "") | (b["scope"] != ""))
    return across.unionByName(within)


class Side:
    """Columns of one side of a pair: Side('a')['norm'] is column a_norm, or a field of a_rest where sides are `packed`."""

    def __init__(self, tag: str, packed: bool = False):
        self.tag, self.packed = tag, packed

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.tag}_rest")[name] if self.packed and name not in MET_BY else F.col(f"{self.tag}_{name}")


# -------------------------------------------------------------------- rules

def eligible(a: Side, b: Side) -> Column:
    same_file = a["file"] == b["file"]
    same_place = same_file & (a["scope"] == b["scope"])
    cross_unit = F.coalesce(a["unit"] != b["unit"], F.lit(False))
    seed_mirror = ((a["lang"] == "env") & (b["lang"] == "env") & (a["dir"] == b["dir"])
                   & (a["env_template"] | b["env_template"]))
    scoped_a, scoped_b = a["scope"] != "", b["scope"] != ""
    place = (F.when(scoped_a & scoped_b, same_place)
             .when(scoped_a | scoped_b, same_file).otherwise(True))
    return (place & (F.length(a["name"]) >= 3) & (F.length(b["name"]) >= 3)
            & ~(same_place & (a["line"] == b["line"]))
            & ~cross_unit & ~F.coalesce(seed_mirror, F.lit(False)))


def derived(a: Side, b: Side) -> Column:
    """One side's value or annotation names the other side as a whole word."""

    def names(x, y):
        plain = F.array_contains(x["link_words"], y["name"])
        pattern = F.concat(F.lit(r"(?U)(?<![\w.])\Q"), y["name"], F.lit(r"\E(?!\w)"))
        return F.when(y["odd_name"],
                      x["link_text"].contains(y["name"]) & F.rlike(x["link_text"], pattern)).otherwise(plain)

    return names(a, b) | names(b, a)


def shared_reference(a: Side, b: Side) -> Column:
    """Both values mention the same tracked constant, other than themselves."""
    common = F.array_intersect(a["refs"], b["refs"])
    return (F.size(a["refs"]) > 0) & (F.size(b["refs"]) > 0) & (
        F.size(F.array_except(common, F.array(a["name"], b["name"]))) > 0)


def parallel_sibling(a: Side, b: Side) -> Column:
    """Names that differ by design: role families, twins, hooks, credentials, caches."""
    wa, wb = a["words"], b["words"]
    stems_a, stems_b = a["stems"], b["stems"]
    n = F.size(wa)
    head = n - 1
    family = ((n == F.size(wb)) & (n >= 2)
              & (F.slice(stems_a, F.lit(1), F.greatest(head, F.lit(0)))
                 == F.slice(stems_b, F.lit(1), F.greatest(head, F.lit(0))))
              & (F.try_element_at(stems_a, F.lit(-1)) != F.try_element_at(stems_b, F.lit(-1))))
    only_a, only_b = F.array_except(stems_a, stems_b), F.array_except(stems_b, stems_a)
    one_a, one_b = F.get(only_a, F.lit(0)), F.get(only_b, F.lit(0))
    twin = F.concat_ws("/", F.least(one_a, one_b), F.greatest(one_a, one_b))
    twins = ["/".join(sorted(t)) for t in vocab.TWIN_TOKENS]
    opposite = (F.size(only_a) == 1) & (F.size(only_b) == 1) & twin.isin(twins)
    script = ["javascript", "typescript"]
    hook = (a["lang"].isin(script) & b["lang"].isin(script)
            & (F.get(wa, F.lit(0)).isin(vocab.HOOK_PREFIXES) | F.get(wb, F.lit(0)).isin(vocab.HOOK_PREFIXES))
            & F.arrays_overlap(stems_a, stems_b))
    secret = (F.try_element_at(wa, F.lit(-1)).isin(vocab.CREDENTIAL_SUFFIXES)
              & F.try_element_at(wb, F.lit(-1)).isin(vocab.CREDENTIAL_SUFFIXES))
    cache = F.array_contains(stems_a, "cache") & F.array_contains(stems_b, "cache")
    return (F.size(wa) > 0) & (F.size(wb) > 0) & F.coalesce(
        family | opposite | F.coalesce(hook, F.lit(False)) | secret | cache, F.lit(False))


def _verdict(score, reason: str) -> Column:
    return F.struct((F.lit(score) if isinstance(score, int) else score).cast("int").alias("score"),
                    F.lit(reason).alias("reason"))


def pair_facts(a: Side, b: Side) -> dict[str, Column]:
    """What several rules ask of a pair, as columns of their own."""
    norm_equal = a["norm"] == b["norm"]
    fold_case = (a["lang"] == "powershell") & (b["lang"] == "powershell")
    same_file = a["file"] == b["file"]
    return {
        "same_file": same_file,
        "same_dir": a["dir"] == b["dir"],
        "equal_hash": a["value_hash"].eqNullSafe(b["value_hash"]),
        "same_name": (a["name"] == b["name"]) | (F.coalesce(fold_case, F.lit(False)) & norm_equal),
        "norm_equal": norm_equal,
        "shared": F.array_intersect(a["tokens"], b["tokens"]),
        "excluded": (a["ignored"] & b["ignored"]) | (~same_file & a["convention"] & b["convention"]) | (
            same_file & (a["scope"] == b["scope"]) & (a["name"] != b["name"]) & (a["trunk"] == b["trunk"])),
    }


def base_score(a: Side, b: Side) -> Column:
    """struct(score in hundredths, reason) before adjustments; null = no pair.

    Reads the `pair_facts` columns."""
    same_file, same_dir, equal_hash = F.col("same_file"), F.col("same_dir"), F.col("equal_hash")
    same_hash = equal_hash & a["same_value_ok"] & b["same_value_ok"]
    damp = F.when(a["ignored"] | b["ignored"], 35).otherwise(0)
    none = F.lit(None).cast("struct<score:int,reason:string>")

    spelled = (F.when(a["role"] == b["role"], _verdict(F.lit(90) - damp, "name-variant"))
               .when(same_file, none).otherwise(_verdict(F.lit(60) - damp, "case-variant")))
    # equal values are equal idioms; asking both sides keeps the two inputs of the
    # self-join alike, so Spark shuffles them once
    copied = F.when(a["idiom"] & b["idiom"], 55).otherwise(85)
    distance = F.when(same_file, 65).when(same_dir, 78).otherwise(60)
    named = (F.when(~F.col("same_name"), spelled)
             .when(same_hash, _verdict(copied - damp, "same-name-same-value"))
             .when(equal_hash, _verdict(F.lit(40) - damp, "same-name"))
             .otherwise(_verdict(distance - damp, "value-mismatch")))

    shared = F.col("shared")
    na, nb, both = F.size(a["tokens"]), F.size(b["tokens"]), F.size(shared)
    worded = (F.when((na == 0) | (nb == 0), none)
              .when(same_hash & (both > 0), _verdict(80, "same-value-related-name"))
              .when(same_hash, _verdict(60, "same-value"))
              .when(~F.arrays_overlap(a["plain"], b["plain"]), none)
              .when((both * 2 >= na + nb - both) & (na >= 2) & (nb >= 2), _verdict(55, "token-overlap"))
              .when(F.arrays_overlap(a["wide"], b["wide"]) & (na <= 3) & (nb <= 3),
                    _verdict(40, "shared-token"))
              .otherwise(none))

    return (F.when(F.col("excluded"), none)
            .when(derived(a, b), _verdict(36, "alias-derived"))
            .when(shared_reference(a, b), _verdict(36, "shared-source"))
            .when(same_hash & a["env_read"] & b["env_read"], _verdict(36, "shared-env-source"))
            .when(F.col("same_name") | F.col("norm_equal"), named)
            .otherwise(worded))


LINKS = ["alias-derived", "shared-source", "shared-env-source"]


def adjustment(a: Side, b: Side, sibling: Column) -> Column:
    """sibling: whether the names differ by design, which counts for the reasons of FAMILY_REASONS inside a file."""
    same_file = F.col("same_file")
    return (F.when(F.coalesce(a["lang"] == b["lang"], a["lang"].isNull() & b["lang"].isNull()), 3).otherwise(0)
            + F.when(F.col("same_dir"), 2).otherwise(0)
            - F.when(same_file & (a["core"] == b["core"]) & (a["name"] != b["name"]), 30).otherwise(0)
            - F.when(a["test"] & b["test"], 25).when(a["test"] | b["test"], 30).otherwise(0)
            - F.when(sibling, 20).otherwise(0))


def level(score: Column) -> Column:
    choice = F.when(score >= vocab.LEVEL_FLOOR["high"], "high")
    for name in ("medium", "low"):
        choice = choice.when(score >= vocab.LEVEL_FLOOR[name], name)
    return choice


def level_rank(name: Column) -> Column:
    return F.when(name == "high", 3).when(name == "medium", 2).when(name == "low", 1)


def score(pairs: DataFrame) -> DataFrame:
    """Add score_int, reason, level to `packed_pairs`; drop pairs without a level.

    The rule chain sits inside a generator: a generator is evaluated once, while
    a filter on a computed column would be pushed down and repeat the chain.  So do
    the names that differ by design: their code is a method of its own then, small
    enough for the JVM to compile.  So does the total, which a filter by level would
    otherwise repeat for every level it names.  What the last two read is taken out of the packed
    sides before, as Spark prunes a generator over fields of them wrongly."""
    a, b = Side("a", packed=True), Side("b", packed=True)
    df = pairs.withColumns(pair_facts(a, b))
    df = df.select("*", F.inline(F.array(base_score(a, b))).alias("_score", "reason")).filter("reason is not null")
    reason = F.col("reason")
    own = {f"_{x.tag}_{c}": x[c] for x in (a, b) for c in ("words", "stems")} | {"_a_lang": a["lang"], "_b_lang": b["lang"]}
    df = df.withColumns(own)
    sibling = F.when(reason.isin(FAMILY_REASONS) & F.col("same_file"), parallel_sibling(Side("_a"), Side("_b"))).otherwise(False)
    df = df.select("*", F.inline(F.array(F.struct(sibling.alias("_sibling")))))
    df = df.withColumn("_change", adjustment(a, b, F.col("_sibling")))
    total = F.when(reason.isin(LINKS), F.col("_score")).otherwise(F.least(F.col("_score") + F.col("_change"), F.lit(99)))
    df = df.select(*pairs.columns, "shared", "reason", F.inline(F.array(F.struct(total.alias("score_int")))))
    return (df.filter(F.col("score_int") >= vocab.LEVEL_FLOOR["low"])
            .withColumn("level", level(F.col("score_int"))))


def _shown(x: Side) -> Column:
    own = {"id", "name", "file", "scope", "status", "lang"}
    return F.struct(*[x[f if f in own else f"show_{f}"].alias(f) for f in SIDE_FIELDS])


def ignore_per_project(feats: DataFrame, names: DataFrame) -> DataFrame:
    """Flag rows whose name is on the ignore list of their own project."""
    listed = names.select("project", N.norm_name(F.col("name")).alias("norm")).distinct().withColumn(
        "_listed", F.lit(True))
    return (feats.join(listed, ["project", "norm"], "left")
            .withColumn("ignored", F.col("ignored") | F.coalesce("_listed", F.lit(False))).drop("_listed"))


def scored_pairs(registry: DataFrame, *, settings: dict | None = None, units: DataFrame | None = None,
                 ignored: DataFrame | None = None, max_bucket: int | None = None, sides: bool = True,
                 extracted: DataFrame | None = None) -> DataFrame:
    """All scored pairs of every project, before verdicts.

    sides: with the rows of both sides for display; without them the display
    columns never enter a shuffle, and verdicts, rules and counts need none.

    settings: apply to all projects; ignored: (project, name) rows on top of
    them; units: (project, pattern) rows of standalone-unit patterns; extracted:
    rows with whole values, for `live_features`."""
    # four steps below read the features: they are computed once and staged
    live = stage(live_features(registry, settings, extracted), "features")
    base = live.filter("linkable").drop("linkable")
    feats = with_references(base, live)
    if ignored is not None:
        feats = ignore_per_project(feats, ignored)
    if units is not None:
        feats = assign_units(feats, units)
    else:
        feats = feats.withColumn("unit", F.lit(None).cast("string"))
    a, b = Side("a", packed=True), Side("b", packed=True)
    feats = stage(feats, "linkable-features")
    own = [c for c in feats.columns if c in MET_BY + SCORED_BY + (SHOWN_BY if sides else [])]
    pairs = score(packed_pairs(feats, own, max_bucket)).select(
        "project", a["id"].alias("id_a"), b["id"].alias("id_b"),
        # both sides spelled the usual way: their tidied ids, in order
        F.when(a["key_id"].isNotNull() & b["key_id"].isNotNull(), F.concat(
            F.least(a["key_id"], b["key_id"]), F.lit("||"), F.greatest(a["key_id"], b["key_id"])))
        .otherwise(N.pair_key(a["id"], b["id"])).alias("pair_key"),
        "score_int", "level", "reason",
        F.array_join("shared", "+").alias("family"), F.size("shared").alias("family_size"),
        a["norm"].alias("norm_a"), b["norm"].alias("norm_b"), a["name"].alias("name_a"),
        *([_shown(a).alias("a"), _shown(b).alias("b")] if sides else []))
    # rows that meet once give a pair once, if no id comes twice
    once = max_bucket is None and feats.groupBy("project", "id").count().filter("count > 1").isEmpty()
    return pairs if once else pairs.dropDuplicates(["project", "id_a", "id_b"])


# ------------------------------------------------------- verdicts and rules

def join_reviews(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Left join of the newest verdict on the normalised pair key: one row per pair.

    Pairs whose key has the hash of no verdict's key keep out of the join, so that the shuffle of a join is that of
    the verdicts and their pairs.  `pairs` are read twice: a caller stages them."""
    newest = latest(reviews.withColumn("pair_key", N.normalize_pair_key(F.col("pair_key"))), ["project", "pair_key"],
                    ["ts", "verdict", "note"])
    verdicts = stage(newest.select(
        "project", "pair_key", F.struct("verdict", "note", "ts", F.lit(False).alias("learned")).alias("review")), "verdicts")
    if verdicts.count() > MOST_HASHES:
        return pairs.join(verdicts, ["project", "pair_key"], "left")
    judged = F.broadcast(verdicts.select(F.hash("project", "pair_key").alias("_hash")).distinct())
    hashed = pairs.withColumn("_hash", F.hash("project", "pair_key"))
    asked = hashed.join(judged, "_hash", "left_semi").join(verdicts, ["project", "pair_key"], "left")
    rest = hashed.join(judged, "_hash", "left_anti").withColumn("review", F.lit(None).cast(verdicts.schema["review"].dataType))
    return asked.unionByName(rest).drop("_hash")


def _rule_key() -> Column:
    """What a dismissal of this pair generalises to; null if to nothing."""
    return (F.when(F.col("reason").isin(FAMILY_REASONS) & (F.col("family_size") >= 2),
                   F.concat(F.lit("family:"), F.col("family")))
            .when(F.col("reason").isin(SAME_NAME_REASONS) & (F.col("norm_a") == F.col("norm_b")),
                  F.concat(F.lit("name:"), F.col("norm_a"))))


def learn(reviewed: DataFrame) -> DataFrame:
    """Suppression rules (project, rule) from explicit not_duplicate verdicts."""
    return (reviewed.filter((F.col("review.verdict") == "not_duplicate") & ~F.col("review.learned"))
            .select("project", _rule_key().alias("rule")).filter("rule is not null").distinct())


def apply_learned(reviewed: DataFrame, rules: DataFrame | None, include_dismissed: bool = False) -> DataFrame:
    """Give unreviewed pairs the verdict of a matching rule; hide dismissed ones."""
    df = reviewed
    if rules is not None:
        note = F.concat(F.lit("hidden by a rule: pairs of "), F.when(F.col("rule").startswith("family:"), F.concat(
            F.lit("the family "), F.col("family"))).otherwise(F.concat(F.lit("the name "), F.col("name_a"))),
            F.lit(" were dismissed before"))
        quiet = F.struct(F.lit("not_duplicate").alias("verdict"), note.alias("note"),
                         F.lit(None).cast("timestamp").alias("ts"), F.lit(True).alias("learned"))
        # pairs that no rule can match keep out of the join, where they would all share one key; the rules are staged, so
        # that Spark knows by their size whether the pairs have to be shuffled
        rules = stage(rules, "rules")
        df = df.withColumn("rule", F.when(F.col("review").isNull(), _rule_key()))
        asked = (df.filter("rule is not null").join(rules.withColumn("_hit", F.lit(True)), ["project", "rule"], "left")
                 .withColumn("review", F.when(F.col("_hit"), quiet).otherwise(F.col("review"))).drop("_hit"))
        df = asked.unionByName(df.filter("rule is null")).drop("rule")
    if not include_dismissed:
        df = df.filter(F.coalesce(F.col("review.verdict"), F.lit("")) != "not_duplicate")
    return df


def find_duplicates(registry: DataFrame, reviews: DataFrame | None = None, *,
                    include_dismissed: bool = False, settings: dict | None = None,
                    units: DataFrame | None = None, paths: DataFrame | None = None,
                    ignored: DataFrame | None = None, max_bucket: int | None = None,
                    extracted: DataFrame | None = None) -> DataFrame:
    """Suspect pairs with verdicts and learned rules applied.

    paths: all file paths (project, path), used to detect standalone units when
    the settings name none; extracted: rows with whole values, for `live_features`."""
    cfg = {**vocab.DEFAULT_SETTINGS, **(settings or {})}
    patterns = cfg["standalone_units"] or []
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    if units is None and patterns:
        units = registry.select("project").distinct().select(
            "project", F.explode(F.array(*[F.lit(p) for p in patterns])).alias("pattern"))
    elif units is None and paths is not None and cfg["auto_standalone_units"]:
        units = auto_unit_patterns(paths, cfg["exclude_dirs"])
    pairs = scored_pairs(registry, settings=cfg, units=units, ignored=ignored, max_bucket=max_bucket, extracted=extracted)
    if reviews is None:
        return pairs.withColumn("review", F.lit(None).cast(
            "struct<verdict:string,note:string,ts:timestamp,learned:boolean>"))
    reviewed = join_reviews(stage(pairs, "scored-pairs"), reviews)
    if not cfg["learn_from_reviews"]:
        return apply_learned(reviewed, None, include_dismissed)
    return apply_learned(reviewed, learn(reviewed), include_dismissed)


def _listed(settings: DataFrame, key: str, name: str) -> DataFrame:
    """(project, name) rows of a setting that holds a JSON list."""
    values = F.from_json("value", "array<string>")
    return settings.filter(F.col("key") == key).select("project", F.explode(values).alias(name)).distinct()


def find_duplicates_by_settings(registry: DataFrame, settings: DataFrame, reviews: DataFrame | None = None,
                                paths: DataFrame | None = None, include_dismissed: bool = False) -> DataFrame:
    """`find_duplicates` where every project has its own ignore list, standalone units and learn toggle.

    settings: (project, key, value as JSON) as `project_settings` makes them."""
    units = _listed(settings, "standalone_units", "pattern")
    if paths is not None:
        detects = settings.filter("key = 'auto_standalone_units' and value = 'true'").select("project").join(
            units.select("project").distinct(), "project", "left_anti")
        units = units.unionByName(auto_unit_patterns(paths).join(detects, "project", "left_semi"))
    pairs = scored_pairs(registry, units=units, ignored=_listed(settings, "dup_ignore_names", "name"))
    if reviews is None:
        reviews = registry.sparkSession.createDataFrame([], REVIEWS)
    reviewed = join_reviews(stage(pairs, "scored-pairs"), reviews)
    learns = settings.filter("key = 'learn_from_reviews' and value = 'true'").select("project")
    return apply_learned(reviewed, learn(reviewed).join(learns, "project", "left_semi"), include_dismissed)


def min_level(pairs: DataFrame, floor: str) -> DataFrame:
    return pairs.filter(level_rank(F.col("level")) >= vocab.LEVEL_RANK[floor])


def sort_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("score_int"), "pair_key")


def public_pairs(pairs: DataFrame) -> DataFrame:
    """The documented pair schema."""
    return pairs.select("project", "pair_key", (F.col("score_int") / 100).alias("score"),
                        "level", "reason", "review", "a", "b")


def canonical_choice(pairs: DataFrame) -> DataFrame:
    """Which name of a pair to keep: more words, then longer, then smaller."""
    a, b = F.col("a"), F.col("b")
    wa, wb = N.descriptive_parts(a["name"]), N.descriptive_parts(b["name"])
    la, lb = F.length(a["name"]), F.length(b["name"])
    b_wins = (wb > wa) | ((wb == wa) & (lb > la)) | ((wb == wa) & (lb == la) & (b["name"] < a["name"]))
    keep, drop = F.when(b_wins, b).otherwise(a), F.when(b_wins, a).otherwise(b)
    return pairs.select(
        "project", "pair_key",
        F.struct(keep["name"].alias("name"), keep["file"].alias("file"), keep["line"].alias("line")).alias("keep"),
        F.struct(drop["name"].alias("name"), drop["file"].alias("file"), drop["line"].alias("line")).alias("drop"),
        keep["value"].alias("canonical_value"),
        (~a["value"].eqNullSafe(b["value"])).alias("value_conflict"))
