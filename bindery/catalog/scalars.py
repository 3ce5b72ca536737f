"""Queries over scalar functions and whole texts, with their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..functions import vocab
from ..operators import linkage as L
from . import derive as D
from .pairs import ENV_READ_SQL, IDIOM_SQL, SQL_NONTRIVIAL, sql_stem

REG = f"WITH {D.ASSIGNMENTS}"
# white space as the library sees it, spelled out for an engine with ASCII \s
WS = ("'[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'")
W = "\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}"


def flat_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, {WS}, ' ', 'g'))"


BANK = "|".join(p for p in vocab.SECRET_PATTERNS).replace("'", "''")
TEXTS = """texts AS (SELECT 'd' || doc_id::varchar AS id, text FROM documents UNION ALL SELECT 'p' || page_id::varchar, html FROM pages)"""


def _texts(spark, sf):
    d = D.table(spark, sf, "documents").select(F.format_string("d%d", "doc_id").alias("id"), "text")
    return d.unionByName(D.table(spark, sf, "pages").select(F.format_string("p%d", "page_id").alias("id"), F.col("html").alias("text")))


def value_hash(spark, sf):
    return _texts(spark, sf).select("id", X.value_hash(F.col("text")).alias("value_hash"))


def secret_bank(spark, sf):
    return _texts(spark, sf).select("id", X.matches_secret_bank(F.col("text")).alias("secret"))


def _tokens(spark, sf):
    found = F.regexp_extract_all("text", F.lit(vocab.ENTROPY_TOKEN), F.lit(0))
    return _texts(spark, sf).select("id", F.posexplode(found).alias("pos", "token"))


def entropy(spark, sf):
    bits = X.shannon_entropy(F.col("token"))
    return _tokens(spark, sf).select("id", "pos", F.floor(bits * 1000 + 0.5).cast("bigint").alias("millibits"))


def entropy_secret(spark, sf):
    return _texts(spark, sf).select("id", X.has_entropy_secret(F.col("text")).alias("secret"))


def preview(spark, sf):
    return _texts(spark, sf).select("id", X.make_preview(F.col("text")).alias("p")).select("id", "p.preview", "p.redacted")


def line_preview(spark, sf):
    """Previews of every value assigned to a key inside the texts."""
    line = r"([A-Za-z_-]+)\s*[:=]\s*(\"[^\"]*\"|\S{8,})"
    rows = _texts(spark, sf).select("id", F.posexplode(F.regexp_extract_all("text", F.lit(line), F.lit(2))).alias("pos", "v"))
    return rows.select("id", "pos", X.make_preview(F.col("v")).alias("p")).select("id", "pos", "p.preview", "p.redacted")


def safe_text(spark, sf):
    marked = F.concat(F.substring("text", 1, 30), F.lit(" `<<redacted sha1:0abc len:31>>` "), F.col("text"))
    return _texts(spark, sf).select("id", X.safe_text(marked).alias("safe"))


def identifier_tokens(spark, sf):
    t = _texts(spark, sf).select("id", X.identifier_tokens(F.col("text")).alias("t"))
    return t.select("id", F.size("t").alias("n"), F.sha1(F.array_join(F.array_sort("t"), "\n")).alias("tokens"))


def wildcards(spark, sf):
    a = D.assignments(spark, sf)
    return a.select("seq", X.wildcard(F.col("name"), "max_*", ci=True).alias("any_case"),
                    X.wildcard(F.col("name"), "MAX_*R", ci=False).alias("same_case"))


def _declarations(spark, sf):
    seq = F.col("p_partkey")
    text = F.format_string('"%s"', "p_name")
    value = (F.when(seq % 8 == 0, F.concat(F.lit("mapped_column(String(40), default="), text, F.lit(", nullable=False)")))
             .when(seq % 8 == 1, F.concat(F.lit("db.Column(Integer, server_default=tuple((1, 2)), index=True);")))
             .when(seq % 8 == 2, F.concat(F.lit("Field(default="), text, F.lit(")")))
             .when(seq % 8 == 3, F.lit("Field(default_factory=list),")).when(seq % 8 == 4, F.lit("Column(Float)"))
             .when(seq % 8 == 5, F.lit("collections.defaultdict(list)"))
             .when(seq % 8 == 6, F.format_string("%d.5,", seq)).otherwise(F.concat(F.lit("call("), text)))
    return D.table(spark, sf, "part").select(seq.alias("seq"), value.alias("value"))


DECLARATIONS = """
decl AS (SELECT p_partkey AS seq, '"' || p_name || '"' AS t, CASE p_partkey % 8
    WHEN 0 THEN 'mapped_column(String(40), default="' || p_name || '", nullable=False)'
    WHEN 1 THEN 'db.Column(Integer, server_default=tuple((1, 2)), index=True);' WHEN 2 THEN 'Field(default="' || p_name || '")'
    WHEN 3 THEN 'Field(default_factory=list),' WHEN 4 THEN 'Column(Float)' WHEN 5 THEN 'collections.defaultdict(list)'
    WHEN 6 THEN p_partkey::varchar || '.5,' ELSE 'call("' || p_name || '"' END AS value FROM part),
lits AS (SELECT *, CASE p_partkey % 8 WHEN 0 THEN lower(t) WHEN 1 THEN 'tuple((1, 2))' WHEN 2 THEN lower(t) WHEN 3 THEN '' WHEN 4 THEN '' END AS literal
  FROM (SELECT *, seq AS p_partkey FROM decl))
"""


def declaration_literal(spark, sf):
    return _declarations(spark, sf).select("seq", X.declaration_literal(X.bare_value(F.col("value"))).alias("literal"))


def nontrivial(spark, sf):
    return _declarations(spark, sf).select("seq", X.nontrivial_value(F.col("value"), F.lit(False)).alias("nontrivial"))


def rhs_shapes(spark, sf):
    seq = F.col("seq")
    a = D.assignments(spark, sf)
    value = F.concat("value", F.when(seq % 4 == 0, " + require(x)").when(seq % 4 == 1, "; getenv ('A')")
                     .when(seq % 4 == 2, "; my.getenv('A')").otherwise(" new Foo()"))
    return a.select("seq", X.idiom_rhs(value).alias("idiom"), X.env_read(value).alias("env_read"))


def stable_ids(spark, sf):
    p = D.table(spark, sf, "pages")
    return p.select("page_id", X.stable_id(F.col("url")).alias("repo_id"),
                    X.stable_id(F.concat(F.upper("url"), F.lit("//")), "s-").alias("source_id"))


def line_comments(spark, sf):
    """Every line of every text without its comment, both markers."""
    rows = _texts(spark, sf).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("id", "pos", F.sha1(X.strip_line_comment(F.col("line"), "//")).alias("slashes"),
                       F.sha1(X.strip_line_comment(F.col("line"), "#")).alias("hashes"))


_PIECES = r"""'"(?:[^"\\]|\\.)*"?|''(?:[^''\\]|\\.)*''?|`(?:[^`\\]|\\.)*`?|//|.'"""


def _cut_sql(marker: str) -> str:
    pieces = f"regexp_extract_all(line, {_PIECES}, 0, 's')"
    return (f"sha1(array_to_string(CASE WHEN list_contains({pieces}, '{marker}') "
            f"THEN {pieces}[1:list_position({pieces}, '{marker}') - 1] ELSE {pieces} END, ''))")


def stems(spark, sf):
    """Words of all documents with their stem, counted."""
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return D.table(spark, sf, "documents").select(w.alias("word")).groupBy("word").count().select(
        "word", N.stem(F.col("word")).alias("stem"), "count")


def name_words(spark, sf):
    """Tokens of camel-case, dotted and numbered names made from part names."""
    name = F.concat(F.lit("self."), F.initcap(F.split("p_name", " ")[0]), F.initcap(F.split("p_type", " ")[0]),
                    F.lit("Ids2_"), F.lower(F.split("p_name", " ")[1]), F.lit("ies"))
    p = D.table(spark, sf, "part")
    return p.select("p_partkey", name.alias("name"), F.array_join(N.name_tokens(name), " ").alias("tokens"),
                    F.array_join(N.ordered_tokens(name), " ").alias("words"), N.norm_name(name).alias("norm"),
                    N.constant_like(F.split("p_name", " ")[0]).alias("plain"), N.constant_like(name).alias("constant_like"))


def roles(spark, sf):
    p = D.table(spark, sf, "part")
    seq = F.col("p_partkey")
    w = F.split("p_name", " ")[0]
    name = F.when(seq % 6 == 0, F.upper(w)).when(seq % 6 == 1, F.initcap(w)).when(
        seq % 6 == 2, F.concat(F.lit("__"), w, F.lit("__"))).when(seq % 6 == 3, F.concat(F.initcap(w), F.lit("_x"))).when(
        seq % 6 == 4, F.concat(F.lit("$_"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("_"), w, F.lit("12")))
    lang = F.when(seq % 4 == 0, "go").otherwise("python")
    other = F.concat(w, F.lit("7"))
    return p.select("p_partkey", N.role(name, lang).alias("role"), N.is_dunder(name).alias("dunder"),
                    N.underscore_variant(name, w).alias("underscored"), N.numeric_sibling(name, F.concat(F.lit("_"), other)).alias("numbered"))


ROLE_NAME = """CASE p_partkey % 6 WHEN 0 THEN upper(w) WHEN 1 THEN upper(w[1]) || w[2:] WHEN 2 THEN '__' || w || '__'
  WHEN 3 THEN upper(w[1]) || w[2:] || '_x' WHEN 4 THEN '$_' || p_partkey::varchar ELSE '_' || w || '12' END"""


def paths(spark, sf):
    """Path rules over the paths of pages and assignments."""
    a = D.assignments(spark, sf)
    seq = F.col("seq")
    path = F.when(seq % 7 == 0, F.concat(F.lit("tests/"), F.col("file"))).when(seq % 7 == 1, F.lit("a/.ENV.Example.local")).when(
        seq % 7 == 2, F.concat(F.col("file"), F.lit("_test.go"))).when(seq % 7 == 3, F.lit("x/main.spec.tsx")).when(
        seq % 7 == 4, F.concat(F.lit("src\\"), F.col("file"))).when(seq % 7 == 5, F.lit("Makefile")).otherwise(F.col("file"))
    return a.select("seq", N.lang_of_path(path).alias("lang"), N.dir_of(path).alias("dir"), N.is_test_path(path).alias("test"),
                    N.is_env_template(path).alias("template"))


PATHS = """paths AS (SELECT seq, CASE seq % 7 WHEN 0 THEN 'tests/' || file WHEN 1 THEN 'a/.ENV.Example.local' WHEN 2 THEN file || '_test.go'
  WHEN 3 THEN 'x/main.spec.tsx' WHEN 4 THEN 'src\\' || file WHEN 5 THEN 'Makefile' ELSE file END AS path, file FROM assignments)"""


def unit_keys(spark, sf):
    from ..operators.linkage import assign_units
    r = D.registry(spark, sf).withColumn("file", F.concat(F.lit("apps/"), F.col("file")))
    pats = r.select("project").distinct().select("project", F.explode(F.array(
        F.lit("*"), F.lit("/apps/*/"), F.lit("apps/promo"), F.lit("apps/*/mod1.py/deep"))).alias("pattern"))
    return assign_units(r, pats.filter("project <> 'Brand#1'")).select("project", "file", "scope", "name", "unit")


def auto_units(spark, sf):
    p = D.table(spark, sf, "part")
    seq = F.col("p_partkey")
    top = F.lower(F.split("p_type", " ")[0])
    tail = F.when(seq % 50 == 0, "/a/package.json").when(seq % 51 == 0, "/.hidden/go.mod").when(
        seq % 52 == 0, "/node_modules/Dockerfile").when(seq % 53 == 0, "/a/b/c/d/setup.py").otherwise("/a.py")
    return L.auto_unit_patterns(p.select(F.concat("p_brand", (seq % 4).cast("string")).alias("project"), F.concat(top, tail).alias("path")))


def pair_keys(spark, sf):
    a = D.assignments(spark, sf)
    ida = N.row_id(F.col("file"), F.col("scope"), F.col("name"))
    idb = F.concat_ws("|", F.lit("lib\\x.py"), F.lit(" run "), F.col("name"))
    return a.select("seq", N.pair_key(ida, idb).alias("pair_key"), N.normalize_pair_key(
        F.concat(F.lit("  free text "), F.col("file"), F.lit("\\ "))).alias("free"))


def mount_paths(spark, sf):
    s = D.table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    raw = F.when(key % 5 == 0, F.concat(F.lit("/run/desktop/mnt/host/C/"), F.col("s_name"), F.lit("/"))).when(
        key % 5 == 1, F.concat(F.lit("/mnt/d/"), F.col("s_name"))).when(key % 5 == 2, F.concat(F.lit("E:\\Code\\"), F.col("s_name"))).when(
        key % 5 == 3, F.concat(F.lit("/host_mnt/data/"), F.col("s_name"))).otherwise(F.lit("/q"))
    return s.select("s_suppkey", N.norm_mount_path(raw).alias("path"))


_ENTROPY = """tok AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_\\-=]{24,}')) AS token,
    generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9+/_\\-=]{24,}'), 1) - 1 AS pos FROM texts),
  chars AS (SELECT id, pos, token, unnest(string_split(token, '')) AS ch FROM tok),
  counts AS (SELECT id, pos, any_value(token) AS token, ch, count(*) AS c FROM chars GROUP BY id, pos, ch),
  bits AS (SELECT id, pos, any_value(token) AS token, -sum(c / len(token) * log2(c / len(token))) AS h FROM counts GROUP BY id, pos),
  strong AS (SELECT DISTINCT id FROM bits WHERE h >= 4.2 AND regexp_matches(token, '[a-z]')::int + regexp_matches(token, '[A-Z]')::int
    + regexp_matches(token, '[0-9]')::int >= 2)"""


def _bank_sql(c: str) -> str:
    return f"regexp_matches({c}, '{BANK}')"


def _preview_sql(c: str, strong: str) -> str:
    f = flat_sql(c)
    return (f"CASE WHEN {_bank_sql(f)} OR {strong} THEN '<<redacted sha1:' || sha1({f})[:10] || ' len:' || len({f})::varchar || '>>' "
            f"WHEN len({f}) > 120 THEN {f}[:119] || '…' ELSE {f} END AS preview, {_bank_sql(f)} OR {strong} AS redacted")


QUERIES = {
    "c1_value_hash": (value_hash, f"WITH {TEXTS} SELECT id, sha1({flat_sql('text')}) AS value_hash FROM texts"),
    "c2_secret_bank": (secret_bank, f"WITH {TEXTS} SELECT id, {_bank_sql('text')} AS secret FROM texts"),
    "c3_shannon_entropy": (entropy, f"WITH {TEXTS}, {_ENTROPY} SELECT id, pos, floor(h * 1000 + 0.5)::bigint AS millibits FROM bits"),
    "c4_entropy_secret": (entropy_secret, f"WITH {TEXTS}, {_ENTROPY} SELECT id, id IN (SELECT id FROM strong) AS secret FROM texts"),
    "c5_make_preview": (preview, f"WITH {TEXTS}, {_ENTROPY} SELECT id, {_preview_sql('text', 'id IN (SELECT id FROM strong)')} FROM texts"),
    "c5_line_previews": (line_preview, """WITH doc AS (SELECT 'd' || doc_id::varchar AS id, text FROM documents
          UNION ALL SELECT 'p' || page_id::varchar, html FROM pages),
        lines AS (SELECT id, generate_subscripts(vs, 1) - 1 AS pos, unnest(vs) AS text FROM (
          SELECT id, regexp_extract_all(text, '([A-Za-z_-]+)\\s*[:=]\\s*("[^"]*"|\\S{8,})', 2) AS vs FROM doc)),
        texts AS (SELECT id || '/' || pos::varchar AS id, text, pos, id AS doc FROM lines), """
        + _ENTROPY + f" SELECT doc AS id, pos, {_preview_sql('text', 'id IN (SELECT id FROM strong)')} FROM texts"),
    "c6_safe_text": (safe_text, f"""WITH {TEXTS}, m AS (SELECT id, replace(regexp_replace({flat_sql("text[:30] || ' `<<redacted sha1:0abc len:31>>` ' || text")},
          '<<\\s*redacted sha1:[0-9a-f]+ len:(\\d+)\\s*>>', '[redacted secret, length \\1]', 'g'), '`', '''') AS s FROM texts)
        SELECT id, CASE WHEN len(s) > 160 THEN s[:159] || '…' ELSE s END AS safe FROM m"""),
    "c7_identifier_tokens": (identifier_tokens, f"""WITH {TEXTS}, t AS (SELECT id, regexp_extract_all(text, '[A-Za-z_$][{W}$]*(?:\\.[{W}$]+)*') AS m FROM texts),
        u AS (SELECT id, list_sort(list_distinct(list_concat(m, flatten(list_transform(m, lambda x: string_split(x, '.')))))) AS t FROM t)
        SELECT id, len(t)::int AS n, sha1(array_to_string(t, chr(10))) AS tokens FROM u"""),
    "c8_wildcard_match": (wildcards, f"{REG} SELECT seq, name ILIKE 'max\\_%' ESCAPE '\\' AS any_case, name LIKE 'MAX\\_%R' ESCAPE '\\' AS same_case FROM assignments"),
    "c9_declaration_literal": (declaration_literal, f"WITH {DECLARATIONS} SELECT seq, literal FROM lits"),
    "c10_nontrivial_value": (nontrivial, f"""WITH {DECLARATIONS}, b AS (SELECT seq, coalesce(literal, regexp_replace(lower(trim(value)), '[ ,;]+$', '')) AS bare FROM lits)
        SELECT seq, {SQL_NONTRIVIAL} AS nontrivial FROM b"""),
    "c11_c12_rhs_shapes": (rhs_shapes, f"""{REG}, v AS (SELECT seq, value || CASE seq % 4 WHEN 0 THEN ' + require(x)' WHEN 1 THEN '; getenv (''A'')'
          WHEN 2 THEN '; my.getenv(''A'')' ELSE ' new Foo()' END AS value FROM assignments)
        SELECT seq, regexp_matches(value, {IDIOM_SQL}) AS idiom, regexp_matches(value, {ENV_READ_SQL}) AS env_read FROM v"""),
    "c15_stable_id": (stable_ids, "SELECT page_id, 'r-' || sha1(url)[:10] AS repo_id, 's-' || sha1(lower(rtrim(url, '/')))[:10] AS source_id FROM pages"),
    "b10_strip_line_comment": (line_comments, f"""WITH {TEXTS}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM texts)
        SELECT id, pos, {_cut_sql('//')} AS slashes, {_cut_sql('#')} AS hashes FROM l"""),
    "d3_stem": (stems, f"""SELECT x AS word, {sql_stem('x')} AS stem, count(*) AS count FROM (
        SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM documents) GROUP BY ALL"""),
    "d1_d4_d5_d7_name_words": (name_words, f"""WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, split_part(p_type, ' ', 1) AS t FROM part),
        m AS (SELECT *, upper(a[1]) || lower(a[2:]) AS ca, upper(t[1]) || lower(t[2:]) AS ct FROM n),
        o AS (SELECT *, 'self.' || ca || ct || 'Ids2_' || lower(b) || 'ies' AS name, ['self', lower(a), lower(t), 'ids', lower(b) || 'ies'] AS words FROM m)
        SELECT p_partkey, name, array_to_string(list_sort(list_distinct(list_transform(words[2:], lambda x: {sql_stem('x')}))), ' ') AS tokens,
          array_to_string(words, ' ') AS words, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS norm,
          len(a) >= 3 AND (a <> lower(a) OR contains(a, '_')) AS plain, true AS constant_like FROM o"""),
    "d2_d6_d13_d14_roles": (roles, f"""WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM part), m AS (SELECT *, {ROLE_NAME} AS name FROM n)
        SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'const' WHEN 1 THEN CASE WHEN p_partkey % 4 = 0 THEN 'exported' ELSE 'type' END
          WHEN 3 THEN CASE WHEN p_partkey % 4 = 0 THEN 'exported' ELSE 'var' END ELSE 'var' END AS role,
          p_partkey % 6 = 2 AS dunder, ltrim(name, '_') = ltrim(w, '_') AND name <> w AS underscored,
          p_partkey % 6 = 5 AS numbered FROM m"""),
    "a4_d8_d9_d10_paths": (paths, f"""{REG}, {PATHS} SELECT seq, CASE seq % 7 WHEN 1 THEN 'env' WHEN 2 THEN CASE WHEN file LIKE '%.env.example' THEN 'env' ELSE 'go' END WHEN 3 THEN 'typescript' WHEN 5 THEN NULL
          ELSE CASE WHEN regexp_matches(file, '/\\.env') THEN 'env' WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.ts' THEN 'typescript' ELSE 'powershell' END END AS lang,
        CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir,
        seq % 7 IN (0, 2, 3) OR contains(file, '/test_') AND seq % 7 IN (4, 6) AS test,
        seq % 7 = 1 OR seq % 7 IN (0, 2, 4, 6) AND file LIKE '%.env.example' AS template FROM paths"""),
    "d11_unit_key": (unit_keys, f"""{REG} SELECT project, 'apps/' || file AS file, scope, name,
        CASE WHEN project <> 'Brand#1' THEN 'apps/' || split_part(file, '/', 1) END AS unit FROM registry"""),
    "d12_auto_unit_patterns": (auto_units, """SELECT p_brand || (p_partkey % 4)::varchar AS project, '*' AS pattern FROM part
        WHERE p_partkey % 50 = 0 GROUP BY 1 HAVING count(DISTINCT lower(split_part(p_type, ' ', 1))) >= 2"""),
    "d15_d16_pair_keys": (pair_keys, f"""{REG}, k AS (SELECT *, file || '|' || scope || '|' || name AS a, 'lib/x.py|run|' || name AS b FROM assignments)
        SELECT seq, least(a, b) || '||' || greatest(a, b) AS pair_key, 'free text ' || file || '/' AS free FROM k"""),
    "d18_norm_mount_path": (mount_paths, """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'c:/' || lower(s_name) WHEN 1 THEN 'd:/' || lower(s_name)
        WHEN 2 THEN 'e:/code/' || lower(s_name) WHEN 3 THEN '/host_mnt/data/' || lower(s_name) ELSE 'q:' END AS path FROM supplier"""),
}

