"""Corpus of source files -> assignment rows, in one map-side pass.

Each file is one row; its lines live in arrays until the last step, so no
shuffle is needed to keep line order.  Regular expressions run in the JVM; the
helpers of `file_helpers` only see brace counts, block labels or, for Python,
the source.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from . import file_helpers as H
from .latest import latest

# --- fixed values: line shapes per language (Java regular expressions) -------
JS_KEYWORDS = [
    "if", "for", "while", "switch", "return", "typeof", "await", "case",
    "default", "new", "delete", "void", "in", "of", "do", "else", "try",
    "catch", "finally", "throw", "yield", "class", "function", "import",
    "export", "this", "super", "true", "false", "null", "undefined",
    "const", "let", "var",
]
JS_FUNCTION = (r"(?U)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*"
               r"([A-Za-z_$][\w$]*)")
JS_ARROW = (r"(?U)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)"
            r"[^=]*=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=>{]+)?=>)")
JSX_TAG_OPEN = r"(?U)<[A-Za-z][\w.]*(?:\s[^<>]*)?$"
JSX_TAG_CLOSE = r"(?<!=)>"
JS_DECLARATION = r"(?U)^\s*(?:export\s+)?(?:default\s+)?(const|let|var)\s+(.*)$"
JS_REASSIGN = r"(?U)^\s*([A-Za-z_$][\w$]*(?:\.[\w$]+)*)\s*=(?![=>])\s*(.+?);?\s*$"
PS_ASSIGN = (r"(?U)^\s*\$(?:(global|script|env|local|private):)?([A-Za-z_][\w]*)"
             r"\s*=(?!=)\s*(.+?)\s*$")
PS_SET_VARIABLE = (r"(?iU)^\s*Set-Variable\s+(?:-Name\s+)?['\"]?([A-Za-z_]\w*)['\"]?"
                   r"(?:\s+(?:-Value\s+)?(.+?))?\s*$")
SH_ASSIGN = (r"(?U)^\s*(?:(export|local|readonly|declare)(?:(?<=declare)\s+-[A-Za-z]+)?\s+)?"
             r"([A-Za-z_]\w*)=(.*)$")
SH_HEREDOC = r"(?U)<<-?\s*['\"]?([A-Za-z_]\w*)['\"]?"
ENV_ASSIGN = r"(?U)^\s*(?:export\s+)?([A-Za-z_][\w.]*)\s*=\s*(.*)$"
CS_ASSIGN = (r"(?U)^\s*(?:(?:public|private|protected|internal|static|readonly|const|volatile"
             r"|new|override|sealed|var|int|uint|long|ulong|short|byte|bool|string|double|float"
             r"|decimal|char|object|dynamic)\s+)+([A-Za-z_]\w*)\s*=(?!=)\s*(.+?);\s*$")
METHOD_OPENER = (r"(?U)^\s*(?:(?:public|private|protected|internal|static|async|override|virtual"
                 r"|sealed|abstract|new|partial|final|synchronized)\s+)+[\w<>\[\],\.\?\s]+?\s+"
                 r"([A-Za-z_]\w*)\s*\([^;]*\)?\s*(?:\{\s*)?$")
GO_SHORT = r"(?U)^\s*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*:=\s*(.+)$"
GO_VAR = r"(?U)^\s*var\s+([A-Za-z_]\w*)(?:\s+[\w\[\]\*\.]+)?\s*=\s*(.+)$"
GO_FUNC = r"(?U)^func\s+(?:\([^)]*\)\s*)?(\w+)"
RUST_LET = r"(?U)^\s*let\s+(?:mut\s+)?([A-Za-z_]\w*)(?:\s*:\s*[^=]+)?\s*=\s*(.+?);?\s*$"
RUST_CONST = (r"(?U)^\s*(?:pub(?:\([^)]*\))?\s+)?(const|static)\s+(?:mut\s+)?"
              r"([A-Za-z_]\w*)\s*:\s*[^=]+=\s*(.+?);\s*$")
RUST_FN = (r"(?U)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?"
           r"(?:extern\s+\"[^\"]*\"\s+)?fn\s+(\w+)")
JAVA_ASSIGN = (r"(?U)^\s*(?:(?:public|private|protected|static|final|transient|volatile"
               r"|var|int|long|short|byte|boolean|double|float|char|String|Object)\s+)+"
               r"(?:[\w<>\[\],\.\?\s]+?\s+)?([A-Za-z_]\w*)\s*=(?!=)\s*(.+?);\s*$")

JS_LANGS = ["javascript", "typescript"]
BRACE_LANGS = JS_LANGS + ["csharp", "go", "rust", "java"]
FENCE_LANGS = JS_LANGS + ["powershell", "shell"]
HASH_COMMENT = ["powershell", "shell"]

OPENERS = {
    "csharp": [METHOD_OPENER], "java": [METHOD_OPENER], "go": [GO_FUNC], "rust": [RUST_FN],
    "javascript": [JS_FUNCTION, JS_ARROW], "typescript": [JS_FUNCTION, JS_ARROW],
}


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured group, null where the group took no part."""
    return X.null_if_empty(F.regexp_extract(text, pattern, group))


def _count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def split_lines(content: Column) -> Column:
    return F.split(content, X.LINE_BREAK)


def _opener(lang: Column, code: Column) -> Column:
    # every opener contains a '(' or a keyword; a plain search skips the rest
    likely = code.contains("(") | code.contains("func") | code.contains("fn") | code.contains("=>")
    choice = F.lit(None).cast("string")
    for language, patterns in OPENERS.items():
        choice = F.when(lang == language, F.coalesce(*[_group(code, p) for p in patterns])).otherwise(choice)
    return F.when(likely, choice)


def _js_skipped(code: Column) -> Column:
    return code.rlike(r"(?U)^\s*$|^\s*\*|^\s*/\*")


def _fence_start(lang: Column, raw: Column, code: Column) -> Column:
    return (F.when(lang == "shell", F.when(code.contains("<<"), _group(code, SH_HEREDOC)))
            .when(lang == "powershell", F.when(raw.rlike(r"(?U)@['\"]\s*$"), "here"))
            .when(lang.isin(JS_LANGS), F.when(code.contains("<") & ~_js_skipped(code)
                                              & code.rlike(JSX_TAG_OPEN), "tag")))


def _fence_stop(lang: Column, raw: Column, code: Column) -> Column:
    return (F.when(lang == "shell", F.when(raw.rlike(r"(?U)^\s*[A-Za-z_]\w*\s*$"), X.strip(raw)))
            .when(lang == "powershell", F.when(raw.rlike(r"(?U)^\s*['\"]@"), "here"))
            .when(lang.isin(JS_LANGS), F.when(~_js_skipped(code) & code.rlike(JSX_TAG_CLOSE), "tag")))


def _listed(condition: Column, of: str, lines: Column) -> Column:
    """The lines' array where the condition holds, or an empty one.

    Not a null: Arrow goes over all null lists since the last other one again with
    each row, so a batch of files without braces would cost the square of its rows."""
    return F.coalesce(F.when(condition, lines), F.array().cast(f"array<{of}>"))


def _lines(corpus: DataFrame, carry: list[str]) -> DataFrame:
    """One row per file: lang, raw lines, comment-free lines, mask, scopes."""
    lang = F.col("lang")
    df = corpus.select("project", F.col("path").alias("file"),
                       N.lang_of_path(F.col("path")).alias("lang"), "content", *carry)
    df = df.filter(lang.isNotNull())
    df = df.withColumn("raw", F.when(lang != "python", split_lines(F.col("content"))))
    df = df.withColumn("code", F.transform("raw", lambda ln: F.when(
        lang.isin(HASH_COMMENT), X.strip_line_comment(ln, "#")).when(
        lang.isin(BRACE_LANGS), X.strip_line_comment(ln, "//")).otherwise(ln)))

    both = F.arrays_zip("raw", "code")
    fenced = lang.isin(FENCE_LANGS)
    braced = lang.isin(BRACE_LANGS)
    live = F.when(lang.isin(JS_LANGS), F.transform(
        "code", lambda c: F.when(_js_skipped(c), "").otherwise(c))).otherwise(F.col("code"))
    return df.select(
        "project", "file", "lang", "raw", "code", *carry,
        H.fence_mask(
            _listed(fenced, "string", F.transform(both, lambda p: _fence_start(lang, p["raw"], p["code"]))),
            _listed(fenced, "string", F.transform(both, lambda p: _fence_stop(lang, p["raw"], p["code"]))),
        ).alias("mask"),
        H.enclosing_opener(
            _listed(braced, "int", F.transform(live, lambda c: _count(c, "{"))),
            _listed(braced, "int", F.transform(live, lambda c: _count(c, "}"))),
            _listed(braced, "string", F.transform(live, lambda c: _opener(lang, c))),
            _listed(braced, "boolean", F.transform(live, lambda c: ~c.rlike(r"(?U);\s*$"))),
        ).alias("scopes"),
        H.python_assignments(F.when(lang == "python", F.col("content"))).alias("parsed"),
    )


def _row(name: Column, kind: Column, value: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("kind"), value.alias("value"))


def _line_rows(lang: Column, raw: Column, code: Column) -> Column:
    """Assignments of one line: array of (name, kind, value); null for none."""

    def one(name, kind, value):
        return F.array(_row(name, kind, value))

    ps = F.when(code.rlike(PS_ASSIGN), one(
        _group(code, PS_ASSIGN, 2),
        F.coalesce(F.concat(F.lit("ps-"), _group(code, PS_ASSIGN, 1)), F.lit("ps-assign")),
        _group(code, PS_ASSIGN, 3))).when(code.rlike(PS_SET_VARIABLE), one(
            _group(code, PS_SET_VARIABLE, 1), F.lit("ps-setvariable"),
            _group(code, PS_SET_VARIABLE, 2)))
    sh = F.when(code.rlike(SH_ASSIGN), one(
        _group(code, SH_ASSIGN, 2),
        F.concat(F.lit("sh-"), F.coalesce(_group(code, SH_ASSIGN, 1), F.lit("assign"))),
        X.null_if_empty(X.strip(F.regexp_extract(code, SH_ASSIGN, 3)))))
    env_line = X.strip(raw)
    env = F.when(env_line.rlike(ENV_ASSIGN) & ~env_line.startswith("#"), one(
        _group(env_line, ENV_ASSIGN), F.lit("env"),
        X.null_if_empty(X.strip(F.regexp_extract(env_line, ENV_ASSIGN, 2)))))
    cs = F.when(code.rlike(CS_ASSIGN), one(
        _group(code, CS_ASSIGN), F.lit("cs-assign"), _group(code, CS_ASSIGN, 2)))
    go_names = F.filter(F.transform(F.split(F.regexp_extract(code, GO_SHORT, 1), ","), X.strip),
                        lambda n: n != "_")
    go_value = X.strip(F.regexp_extract(code, GO_SHORT, 2))
    go = F.when(code.rlike(GO_SHORT), F.transform(
        go_names, lambda n: _row(n, F.lit("go-short"), go_value))).when(code.rlike(GO_VAR), one(
            _group(code, GO_VAR), F.lit("go-var"), X.strip(F.regexp_extract(code, GO_VAR, 2))))
    rust = F.when(code.rlike(RUST_CONST), one(
        _group(code, RUST_CONST, 2), F.concat(F.lit("rust-"), _group(code, RUST_CONST, 1)),
        X.strip(F.regexp_extract(code, RUST_CONST, 3)))).when(code.rlike(RUST_LET), one(
            _group(code, RUST_LET), F.lit("rust-let"), X.strip(F.regexp_extract(code, RUST_LET, 2))))
    java = F.when(code.rlike(JAVA_ASSIGN), one(
        _group(code, JAVA_ASSIGN), F.lit("java-assign"),
        X.strip(F.regexp_extract(code, JAVA_ASSIGN, 2))))
    js_name = _group(code, JS_REASSIGN)
    js_value = X.strip(F.regexp_extract(code, JS_REASSIGN, 2))
    js = F.when(js_name.isNotNull() & ~X.one_of(F.substring_index(js_name, ".", 1), JS_KEYWORDS)
                & ~js_value.startswith("="), one(js_name, F.lit("reassign"), js_value))
    return (F.when(lang == "env", env)
            .when(lang == "powershell", ps).when(lang == "shell", sh)
            .when(lang.isin(JS_LANGS), js)
            .when(lang == "csharp", cs).when(lang == "go", go)
            .when(lang == "rust", rust).when(lang == "java", java))


PARSED = "struct<name:string,line:int,scope:string,kind:string,value:string,anno:string>"
LINE = "struct<i:int,raw:string,code:string,scope:string,mask:int>"


def extract_assignments(corpus: DataFrame, lang: str | None = None, carry: list[str] | None = None,
                        marker: bool = False) -> DataFrame:
    """corpus(project, path, content) -> extracted rows; `ord` is file order.

    Rows are not unique on (file, scope, name); see `last_occurrence`.
    carry: columns passed through to every row; marker: one more row per file,
    with a null name, so that files without assignments are seen too."""
    carry = carry or []
    if lang is not None:
        corpus = corpus.filter(N.lang_of_path(F.col("path")) == lang)
    files = _lines(corpus, carry)
    language = F.col("lang")

    def entry(i, parsed, text, mark=False):
        return F.struct(i.cast("int").alias("i"), parsed.cast(PARSED).alias("parsed"),
                        text.cast(LINE).alias("text"), F.lit(mark).alias("marker"))

    # every file yields one stream of entries, the parsed rows of a Python file
    # or the lines of any other, so the corpus is read once
    nothing = F.lit(None)
    hidden = F.when(language.isin(JS_LANGS), 1).otherwise(2)
    numbered = F.transform("code", lambda c, i: F.struct(
        i.alias("i"), F.get(F.col("raw"), i).alias("raw"), c.alias("code"),
        F.coalesce(F.get(F.col("scopes"), i), F.lit("")).alias("scope"),
        F.coalesce(F.get(F.col("mask"), i), F.lit(0)).alias("mask")))
    likely = F.filter(numbered, lambda t: (t["mask"] < hidden) & (
        t["raw"].contains("=") | t["raw"].ilike("%set-variable%")
        | (language.isin(JS_LANGS) & t["raw"].rlike("const|let|var"))))
    stream = F.coalesce(F.transform("parsed", lambda p, i: entry(i, p, nothing)),
                        F.transform(likely, lambda t: entry(t["i"], nothing, t)))
    if marker:
        stream = F.concat(F.array(entry(F.lit(-1), nothing, nothing, True)), stream)
    entries = files.select("project", "file", "lang", *carry, F.explode(stream).alias("e"))

    code = F.col("e.text.code")
    in_js = language.isin(JS_LANGS)
    keyword = F.when(in_js & ~_js_skipped(code), _group(code, JS_DECLARATION, 1))
    declared = H.js_bindings(keyword, F.when(keyword.isNotNull(), F.regexp_extract(code, JS_DECLARATION, 2)))
    # a declaration line is never a re-assignment as well
    found = (F.when(F.col("e.marker"), F.array(_row(*[nothing.cast("string")] * 3)))
             .when(F.col("e.parsed").isNotNull(), F.array(_row(
                 F.col("e.parsed.name"), F.col("e.parsed.kind"), F.col("e.parsed.value"))))
             .when(F.col("declared").isNotNull(), F.col("declared"))
             .when(in_js & _js_skipped(code), nothing)
             .otherwise(_line_rows(language, F.col("e.text.raw"), code)))
    rows = entries.withColumn("declared", declared).select(
        "project", "file", "lang", *carry, "e", F.posexplode(found).alias("pos", "row"))
    return rows.select(
        "project", "file", "lang", *carry,
        (F.col("e.i").cast("long") * 1000000 + F.col("pos")).alias("ord"),
        F.col("row.name").alias("name"),
        F.coalesce(F.col("e.parsed.line"), F.col("e.text.i") + 1).alias("line"),
        F.coalesce(F.col("e.parsed.scope"), F.col("e.text.scope")).alias("scope"),
        F.col("row.kind").alias("kind"), F.col("row.value").alias("value"),
        F.col("e.parsed.anno").alias("anno"))


def brace_scope(corpus: DataFrame, opener: str) -> DataFrame:
    """Every line of every file with its innermost enclosing function, where a
    function is opened by a line matching `opener` (name in group 1)."""
    df = corpus.select("project", F.col("path").alias("file"),
                       split_lines(F.col("content")).alias("raw"))
    scopes = H.enclosing_opener(
        F.transform("raw", lambda c: _count(c, "{")), F.transform("raw", lambda c: _count(c, "}")),
        F.transform("raw", lambda c: _group(c, opener)),
        F.transform("raw", lambda c: ~c.rlike(r"(?U);\s*$")))
    df = df.withColumn("scopes", scopes)
    return df.select("project", "file", F.posexplode(F.arrays_zip("raw", "scopes")).alias("i", "l")).select(
        "project", "file", (F.col("i") + 1).alias("line"), F.col("l.raw").alias("text"),
        F.col("l.scopes").alias("scope"))


def last_occurrence(extracted: DataFrame) -> DataFrame:
    """Several rows for one key: the last in file order wins."""
    return latest(extracted, ["project", "file", "scope", "name"], ["ord"])
