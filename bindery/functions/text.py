"""Scalar functions on values and text (Column in, Column out)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

# Unicode white space plus the four separators Java leaves out of \s
WS = r"(?U)[\s\x1c-\x1f]+"
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"


def words(values) -> Column:
    """Constant string array, parsed by Spark in one call."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({quoted})").cast("array<string>")


def one_of(v: Column, values) -> Column:
    return F.array_contains(words(values), v)


def flat(v: Column) -> Column:
    """Every run of white space becomes one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(v, WS, " "))


def strip(v: Column) -> Column:
    return F.regexp_replace(v, STRIP, "")


def null_if_empty(v: Column) -> Column:
    return F.when(v != "", v)


def clip(v: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis when text was cut."""
    return F.when(F.length(v) > n, F.concat(F.substring(v, 1, n - 1), F.lit("…"))).otherwise(v)


def value_hash(v: Column) -> Column:
    return F.sha1(flat(F.coalesce(v, F.lit(""))))


def matches_secret_bank(v: Column) -> Column:
    return v.rlike("(?U)" + "|".join(vocab.SECRET_PATTERNS))


def shannon_entropy(t: Column) -> Column:
    """Bits per character; each distinct character is counted by its absence."""
    n = F.length(t)

    def weight(ch):
        p = (n - F.length(F.replace(t, ch, F.lit("")))) / n
        return p * F.log2(p)

    chars = F.filter(F.array_distinct(F.split(t, "")), lambda c: c != "")
    bits = F.aggregate(F.transform(chars, weight), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n > 0, -bits).otherwise(F.lit(0.0))


def has_entropy_secret(v: Column) -> Column:
    """A long token of at least two character classes and high entropy."""

    def is_key(tok):
        classes = (tok.rlike("[a-z]").cast("int") + tok.rlike("[A-Z]").cast("int")
                   + tok.rlike("[0-9]").cast("int"))
        return F.when(classes >= 2, shannon_entropy(tok) >= vocab.ENTROPY_FLOOR).otherwise(False)

    return F.exists(F.regexp_extract_all(v, F.lit(vocab.ENTROPY_TOKEN), F.lit(0)), is_key)


def looks_secret(v: Column) -> Column:
    return F.when(matches_secret_bank(v), True).otherwise(has_entropy_secret(v))


def make_preview(v: Column, redact: bool | Column = True, n: int = 120) -> Column:
    """struct(preview, redacted) of a right-hand side; null gives ('', false)."""
    flag = redact if isinstance(redact, Column) else F.lit(redact)
    text = flat(v)
    secret = flag & looks_secret(text)
    mark = F.format_string("<<redacted sha1:%s len:%d>>",
                           F.substring(value_hash(v), 1, 10), F.length(text))
    return F.struct(
        F.when(v.isNull(), "").when(secret, mark).otherwise(clip(text, n)).alias("preview"),
        F.when(v.isNull(), False).otherwise(secret).alias("redacted"),
    )


def safe_text(v: Column, n: int = 160) -> Column:
    """One line, redaction marks without their hash, no backticks, clipped."""
    t = flat(F.coalesce(v.cast("string"), F.lit("")))
    t = F.regexp_replace(t, r"(?U)<<\s*redacted sha1:[0-9a-f]+ len:(\d+)\s*>>",
                         "[redacted secret, length $1]")
    return clip(F.replace(t, F.lit("`"), F.lit("'")), n)


def identifier_tokens(v: Column) -> Column:
    """Identifiers and dotted chains of an edit, and every part of a chain."""
    found = F.regexp_extract_all(F.coalesce(v, F.lit("")),
                                 F.lit(r"(?U)[A-Za-z_$][\w$]*(?:\.[\w$]+)*"), F.lit(0))
    with_parts = F.transform(found, lambda t: F.concat(F.array(t), F.split(t, r"\.")))
    return F.array_distinct(F.flatten(with_parts))


def wildcard(name: Column, pattern: str, ci: bool = True) -> Column:
    """'*' stands for any run; the rest is literal and the match is anchored."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    like = escaped.replace("*", "%")
    return name.ilike(like) if ci else name.like(like)


def declaration_literal(v: Column) -> Column:
    """Literal default of a column/field declaration, '' if it has none, null
    if v is not such a declaration."""
    inner = F.regexp_extract(v, vocab.DECLARATION, 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("taken"), F.lit(False).alias("done"))

    def step(acc, ch):
        closes = ch.isin(")", "]", "}")
        stop = acc["done"] | ((acc["depth"] == 0) & (closes | (ch == ",")))
        depth = (acc["depth"] + ch.isin("(", "[", "{").cast("int") - closes.cast("int"))
        return F.struct(
            F.when(stop, acc["depth"]).otherwise(depth).alias("depth"),
            F.when(stop, acc["taken"]).otherwise(acc["taken"] + 1).alias("taken"),
            stop.alias("done"))

    def upto(rest):
        chars = F.filter(F.split(rest, ""), lambda c: c != "")
        return strip(F.substring(rest, F.lit(1), F.aggregate(chars, start, step, lambda s: s["taken"])))

    return (F.when(~v.rlike(vocab.DECLARATION), F.lit(None).cast("string"))
            .when(inner.rlike(r"(?U)\bdefault_factory\s*="), "")
            .when(~inner.rlike(vocab.DECLARATION_DEFAULT), "")
            .otherwise(let(F.regexp_extract(inner, vocab.DECLARATION_DEFAULT, 1), upto)))


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once and written once into the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bare_value(preview: Column) -> Column:
    """Lower-cased value without the separators line-based extraction leaves."""
    return F.regexp_replace(F.lower(strip(F.coalesce(preview, F.lit("")))), r"[ ,;]+$", "")


def _dull(v: Column) -> Column:
    call = r"(?U)^([a-z_][\w.]*)\(\s*([a-z_][\w.]*)\s*\)$"
    empty_container = (
        one_of(F.substring_index(F.regexp_extract(v, call, 1), ".", -1), vocab.CONTAINER_CTORS)
        & one_of(F.substring_index(F.regexp_extract(v, call, 2), ".", -1), vocab.TRIVIAL_FACTORIES))
    return (one_of(v, vocab.TRIVIAL_VALUES) | (F.length(v) < 4)
            | v.rlike(r"(?U)^-?\d{1,6}(?:\.\d+)?$|^[a-z_][\w.]*(?:\(\))?$|[(\[{]$")
            | empty_container)


def nontrivial_bare(bare: Column, redacted: Column) -> Column:
    """`nontrivial_value` on a value that went through `bare_value`."""
    # only text that can be a declaration is unwrapped: that walks characters
    unwrapped = let(bare, lambda v: ~_dull(declaration_literal(v)))
    return F.when(redacted, True).when(bare.rlike(vocab.DECLARATION), unwrapped).otherwise(~_dull(bare))


def nontrivial_value(preview: Column, redacted: Column) -> Column:
    """May this value anchor a same-value link?"""
    return let(F.struct(bare_value(preview).alias("bare"), redacted.alias("redacted")),
               lambda s: nontrivial_bare(s["bare"], s["redacted"]))


def idiom_rhs(v: Column) -> Column:
    return F.coalesce(v, F.lit("")).rlike(vocab.IDIOM_RHS)


def env_read(v: Column) -> Column:
    return F.coalesce(v, F.lit("")).rlike(vocab.ENV_READ)


def prefix(v: Column, n: int) -> Column:
    return F.substring(F.coalesce(v, F.lit("")), 1, n)


def stable_id(v: Column, tag: str = "r-") -> Column:
    """Short id: of a canonical path ('r-') or of a lower-cased URL ('s-')."""
    if tag == "s-":
        v = F.lower(F.regexp_replace(v, "/+$", ""))
    return F.concat(F.lit(tag), F.substring(F.sha1(v), 1, 10))


def strip_line_comment(line: Column, marker: str) -> Column:
    """Cut at the first comment marker outside quotes.

    Possessive quantifiers keep the matcher iterative, so a minified line of a
    megabyte neither backtracks nor overflows the stack."""
    head, tail = marker[0], marker[1:]
    quoted = "|".join(f"{q}(?:[^{q}\\\\]++|\\\\.)*+{q}?" for q in "\"'`")
    lone = f"|{head}(?!{tail})" if tail else ""
    return F.regexp_extract(line, f"^((?:[^\"'`{head}]++|{quoted}{lone})*+)", 1)
