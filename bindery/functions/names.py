"""Scalar functions on names, paths and pair keys (Column in, Column out)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

WORD_BREAK = r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z]+"


def norm_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def is_dunder(name: Column) -> Column:
    return name.rlike(r"(?U)^__\w+__$")


def stem(tok: Column) -> Column:
    n = F.length(tok)

    def cut(k):
        return F.substring(tok, F.lit(1), n - k)

    return (F.when(tok.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
            .when(tok.endswith("es") & (n > 4), cut(2))
            .when(tok.endswith("s") & (n > 3), cut(1))
            .when(tok.endswith("ing") & (n > 5), cut(3))
            .when(tok.endswith("ed") & (n > 4), cut(2))
            .otherwise(tok))


def ordered_tokens(name: Column) -> Column:
    """Lower-cased words in source order, digits left out."""
    words = F.filter(F.split(name, WORD_BREAK), lambda w: w != "")
    return F.transform(words, F.lower)


def name_tokens(name: Column) -> Column:
    """Sorted distinct stems; receivers and single letters carry no concept."""
    kept = F.filter(ordered_tokens(name),
                    lambda w: ~w.isin(vocab.RECEIVER_TOKENS) & (F.length(w) >= 2))
    return F.array_sort(F.array_distinct(F.transform(kept, stem)))


def role(name: Column, lang: Column) -> Column:
    base = F.regexp_replace(name, r"^[_$]+", "")
    letters = F.regexp_replace(base, r"\P{L}", "")
    capital = base.rlike(r"^\p{Lu}")
    return (F.when(letters == "", "var")
            .when(letters.rlike(r"^\p{Lu}+$"), "const")
            .when(lang == "go", F.when(capital, "exported").otherwise("var"))
            .when(capital & letters.rlike(r"\p{Ll}") & ~base.contains("_"), "type")
            .otherwise("var"))


def constant_like(name: Column) -> Column:
    return (F.length(name) >= 3) & ((name != F.lower(name)) | name.contains("_"))


def dir_of(file: Column) -> Column:
    return F.regexp_extract(file, "^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def is_env_template(file: Column) -> Column:
    return F.lower(base_name(file)).rlike(vocab.ENV_TEMPLATE)


def is_test_path(file: Column) -> Column:
    return file.rlike(vocab.TEST_PATH)


def lang_of_path(path: Column) -> Column:
    """Language from the base name; null when the extension is unsupported."""
    base = F.lower(base_name(path))
    ext = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    table = F.expr("map(%s)" % ", ".join(f"'{x}'" for kv in vocab.LANG_BY_EXT.items() for x in kv))
    return F.when((base == ".env") | base.startswith(".env."), "env").otherwise(
        F.try_element_at(table, ext))


def unit_key(file: Column, patterns: Column) -> Column:
    """Directory prefix named by the longest matching unit pattern, or null.

    '*' stands for one path segment; the prefix must be a proper directory."""
    segs = F.split(F.replace(file, F.lit("\\"), F.lit("/")), "/")

    def parts(p):
        return F.split(F.regexp_replace(p, "^/+|/+$", ""), "/")

    def prefix_of(p):
        want = parts(p)
        have = F.slice(segs, F.lit(1), F.size(want))
        same = F.forall(F.zip_with(want, have, lambda w, h: (w == "*") | (w == h)), lambda ok: ok)
        return F.when((F.size(want) < F.size(segs)) & same,
                      F.struct(F.size(want).alias("n"), F.array_join(have, "/").alias("unit")))

    return F.array_max(F.transform(patterns, prefix_of))["unit"]


def underscore_variant(a: Column, b: Column) -> Column:
    return (F.ltrim(a, F.lit("_")) == F.ltrim(b, F.lit("_"))) & (a != b)


def without_digits_tail(name: Column) -> Column:
    return F.regexp_replace(name, r"\p{Nd}+$", "")


def numeric_sibling(a: Column, b: Column) -> Column:
    """Names equal but for a trailing number (the caller checks the place)."""
    return (a != b) & (without_digits_tail(a) == without_digits_tail(b))


def row_id(file: Column, scope: Column, name: Column) -> Column:
    return F.concat_ws("|", file, scope, name)


def normalize_pair_key(key: Column) -> Column:
    """Slashes, blanks and side order folded to one spelling."""
    slashed = F.replace(key, F.lit("\\"), F.lit("/"))
    parts = F.split(slashed, r"\|")

    def side(start):
        return F.array_join(F.transform(F.slice(parts, start, 3), lambda p: F.trim(p)), "|")

    canonical = F.array_join(F.array_sort(F.array(side(1), side(5))), "||")
    return F.when((F.size(parts) == 7) & (F.get(parts, F.lit(3)) == ""), canonical).otherwise(
        F.trim(slashed))


def pair_key(id_a: Column, id_b: Column) -> Column:
    return normalize_pair_key(F.array_join(F.array_sort(F.array(id_a, id_b)), "||"))


def key_side(file: Column, scope: Column, name: Column) -> Column:
    """A row's side of a normalised pair key; null when a part holds the
    separator, so that only `pair_key` can tell the sides apart."""
    sides = [F.trim(F.replace(c, F.lit("\\"), F.lit("/"))) for c in (file, scope, name)]
    return F.when(~F.concat(file, scope, name).contains("|"), F.concat_ws("|", *sides))


def scope_depth(scope: Column) -> Column:
    return F.when(scope == "", 0).otherwise(F.size(F.split(scope, r"\.")))


def norm_mount_path(path: Column) -> Column:
    """Comparable host path: slashes, drive letter folded, lower case."""
    s = F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    s = F.regexp_replace(s, r"^(?:/run/desktop/mnt/host|/host_mnt|/mnt)?/([a-zA-Z])(/.*)?$", "$1:$2")
    return F.lower(F.regexp_replace(s, "/+$", ""))


def descriptive_parts(name: Column) -> Column:
    """How many words a name is made of (underscores, dots, camel humps)."""
    return F.size(F.filter(F.split(name, r"[_.]|(?<=[a-z0-9])(?=[A-Z])"), lambda w: w != ""))
