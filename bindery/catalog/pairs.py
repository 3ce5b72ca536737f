"""Queries over suspect pairs, with their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import vocab
from ..operators import linkage as L
from ..plans import reports as G
from ..plans import views as H
from ..sources import tables as T
from ..staging import stage
from . import derive as D


def words(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_stem(x: str) -> str:
    return (f"CASE WHEN {x} LIKE '%ies' AND len({x}) > 4 THEN {x}[:-4] || 'y' "
            f"WHEN {x} LIKE '%es' AND len({x}) > 4 THEN {x}[:-3] "
            f"WHEN {x} LIKE '%s' AND len({x}) > 3 THEN {x}[:-2] "
            f"WHEN {x} LIKE '%ing' AND len({x}) > 5 THEN {x}[:-4] "
            f"WHEN {x} LIKE '%ed' AND len({x}) > 4 THEN {x}[:-3] ELSE {x} END")


def sql_words(name: str) -> str:
    return (f"list_transform(regexp_extract_all(regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
            "'[A-Za-z]+'), lambda w: lower(w))")


def sql_role(name: str, lang: str) -> str:
    base = f"regexp_replace({name}, '^[_$]+', '')"
    letters = f"regexp_replace({base}, '[^A-Za-z]', '', 'g')"
    return (f"CASE WHEN {letters} = '' THEN 'var' WHEN {letters} = upper({letters}) THEN 'const' "
            f"WHEN {lang} = 'go' THEN CASE WHEN regexp_matches({base}, '^[A-Z]') THEN 'exported' ELSE 'var' END "
            f"WHEN regexp_matches({base}, '^[A-Z]') AND regexp_matches({letters}, '[a-z]') AND NOT contains({base}, '_') "
            "THEN 'type' ELSE 'var' END")


SQL_NONTRIVIAL = f"""
  (NOT (bare IN ({words(vocab.TRIVIAL_VALUES)}) OR len(bare) < 4
    OR regexp_full_match(bare, '-?\\d{{1,6}}(\\.\\d+)?')
    OR regexp_full_match(bare, '[a-z_][\\w.]*(\\(\\))?')
    OR (regexp_full_match(bare, '([a-z_]\\w*\\.)*({"|".join(vocab.CONTAINER_CTORS)})'
        || '\\(\\s*([a-z_]\\w*\\.)*({"|".join(vocab.TRIVIAL_FACTORIES)})\\s*\\)'))
    OR regexp_matches(bare, '[(\\[{{]$')))
"""
TEST_PATH_SQL = ("'(^|/)(tests?|spec|__tests__|fixtures)(/|$)|(^|/)test_[^/]+$|_test\\.[a-z]+$|\\.spec\\.[a-z]+$"
                 "|(^|/)tests?\\.[a-z0-9]+$'")
ENV_READ_SQL = ("'os\\.environ|os\\.getenv|process\\.env|\\$env:|\\$\\{\\w+:[-=?]|(^|[^\\w.])getenv\\s*\\('")
IDIOM_SQL = ("'getLogger|ArgumentParser|__name__|__file__|__dirname|require\\(|Flask\\(|express\\(|Router\\("
             "|APIRouter\\(|Path\\(__|os\\.environ|process\\.env|argparse\\.|new\\s+\\w+\\(\\)$'")

FEATURES = f"""
live AS (SELECT *, regexp_replace(lower(trim(value)), '[ ,;]+$', '') AS bare FROM registry
  WHERE status NOT IN ('file_deleted', 'missing')),
known AS (SELECT DISTINCT project, name FROM live),
features AS (
  SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS norm, {sql_words("name")} AS words,
    list_sort(list_distinct(list_transform(list_filter({sql_words("name")},
      lambda w: w NOT IN ('self', 'cls', 'this') AND len(w) >= 2), lambda x: {sql_stem("x")}))) AS tokens,
    {sql_role("name", "lang")} AS role, {SQL_NONTRIVIAL} AS nontrivial, kind LIKE '%-destructure' AS destructured,
    regexp_matches(value, {ENV_READ_SQL}) AS env_read, regexp_matches(value, {IDIOM_SQL}) AS idiom,
    regexp_matches(file, {TEST_PATH_SQL}) AS test, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir,
    regexp_matches(lower(regexp_extract(file, '([^/]*)$', 1)),
      '^\\.env.*\\.(example|sample|template|dist|defaults|tpl)') AS env_template,
    list_distinct(list_filter(regexp_extract_all(value, '[A-Za-z_$][\\w$]*'),
      lambda m: len(m) >= 3 AND (m <> lower(m) OR contains(m, '_')))) AS mentions
  FROM live WHERE NOT contains(name, '.') AND NOT regexp_full_match(name, '__\\w+__')),
refs AS (
  SELECT project, id, list(m) AS refs FROM (SELECT project, id, unnest(mentions) AS m FROM features) u
  WHERE (project, m) IN (SELECT (project, name) FROM known) GROUP BY ALL),
blocks AS (
  SELECT project, id, 'n:' || norm AS block FROM features
  UNION ALL SELECT project, id, 'h:' || value_hash FROM features WHERE nontrivial AND NOT destructured
  UNION ALL SELECT project, id, 't:' || t FROM (SELECT project, id, unnest(tokens) AS t FROM features) u WHERE len(t) >= 3),
sizes AS (SELECT project, block, count(*) AS block_rows FROM blocks GROUP BY ALL),
kept AS (SELECT b.* FROM blocks b JOIN sizes s USING (project, block) WHERE block_rows > 1),
candidates AS (
  SELECT DISTINCT a.project, a.id AS id_a, b.id AS id_b FROM kept a JOIN kept b
  ON a.project = b.project AND a.block = b.block AND a.id < b.id)
"""

ELIGIBLE = """
sided AS (
  SELECT c.project, c.id_a, c.id_b, a, b, coalesce(ra.refs, []) AS ra, coalesce(rb.refs, []) AS rb
  FROM candidates c JOIN features a ON a.project = c.project AND a.id = c.id_a
  JOIN features b ON b.project = c.project AND b.id = c.id_b
  LEFT JOIN refs ra ON ra.project = c.project AND ra.id = c.id_a
  LEFT JOIN refs rb ON rb.project = c.project AND rb.id = c.id_b),
eligible AS (
  SELECT *, a.file = b.file AS same_file, a.dir = b.dir AS same_dir,
    list_intersect(a.tokens, b.tokens) AS shared FROM sided
  WHERE NOT (a.lang = 'env' AND b.lang = 'env' AND a.dir = b.dir AND (a.env_template OR b.env_template))
    AND len(a.name) >= 3 AND len(b.name) >= 3
    AND NOT (a.file = b.file AND a.scope = b.scope AND a.line = b.line)
    AND CASE WHEN a.scope <> '' AND b.scope <> '' THEN a.file = b.file AND a.scope = b.scope
      WHEN a.scope <> '' OR b.scope <> '' THEN a.file = b.file ELSE true END)
"""

_NORMS = sorted({"".join(c for c in w.lower() if c.isascii() and c.isalnum()) for w in vocab.IGNORED_NAMES})
_CONV = sorted({"".join(c for c in w.lower() if c.isascii() and c.isalnum())
                for w in vocab.DEFAULT_SETTINGS["dup_ignore_crossfile_names"]})


def _names(x: str, y: str) -> str:
    pat = f"'(^|[^\\w.])' || {y}.name || '($|\\W)'"
    return f"(regexp_matches({x}.value, {pat}) OR coalesce(regexp_matches({x}.anno, {pat}), false))"


SCORED = f"""
flagged AS (
  SELECT *, a.norm IN ({words(_NORMS)}) AS ia, b.norm IN ({words(_NORMS)}) AS ib,
    a.value_hash = b.value_hash AND a.nontrivial AND b.nontrivial AND a.status <> 'drifted' AND b.status <> 'drifted'
      AND NOT a.destructured AND NOT b.destructured AS same_hash,
    a.name = b.name OR (a.lang = 'powershell' AND b.lang = 'powershell' AND a.norm = b.norm) AS same_name,
    len(shared) AS n_shared, len(list_distinct(list_concat(a.tokens, b.tokens))) AS n_union,
    len(list_filter(shared, lambda t: t NOT IN ({words(vocab.GENERIC_TOKENS)}))) AS n_meaning,
    {_names("a", "b")} OR {_names("b", "a")} AS derived,
    len(list_filter(list_intersect(ra, rb), lambda t: t <> a.name AND t <> b.name)) > 0 AS shared_source
  FROM eligible),
based AS (
  SELECT *, CASE
    WHEN ia AND ib THEN NULL
    WHEN NOT same_file AND a.norm IN ({words(_CONV)}) AND b.norm IN ({words(_CONV)}) THEN NULL
    WHEN same_file AND a.scope = b.scope AND a.name <> b.name
      AND regexp_replace(a.name, '[0-9]+$', '') = regexp_replace(b.name, '[0-9]+$', '') THEN NULL
    WHEN derived THEN {{'s': 36, 'r': 'alias-derived'}}
    WHEN shared_source THEN {{'s': 36, 'r': 'shared-source'}}
    WHEN same_hash AND a.env_read THEN {{'s': 36, 'r': 'shared-env-source'}}
    WHEN a.norm = b.norm AND NOT same_name AND a.role <> b.role AND same_file THEN NULL
    WHEN a.norm = b.norm THEN CASE
      WHEN NOT same_name AND a.role <> b.role THEN {{'s': 60, 'r': 'case-variant'}}
      WHEN NOT same_name THEN {{'s': 90, 'r': 'name-variant'}}
      WHEN same_hash THEN {{'s': CASE WHEN a.idiom THEN 55 ELSE 85 END, 'r': 'same-name-same-value'}}
      WHEN a.value_hash = b.value_hash THEN {{'s': 40, 'r': 'same-name'}}
      ELSE {{'s': CASE WHEN same_file THEN 65 WHEN same_dir THEN 78 ELSE 60 END, 'r': 'value-mismatch'}} END
    WHEN len(a.tokens) = 0 OR len(b.tokens) = 0 THEN NULL
    WHEN same_hash AND n_shared > 0 THEN {{'s': 80, 'r': 'same-value-related-name'}}
    WHEN same_hash THEN {{'s': 60, 'r': 'same-value'}}
    WHEN n_meaning = 0 THEN NULL
    WHEN n_shared * 2 >= n_union AND len(a.tokens) >= 2 AND len(b.tokens) >= 2 THEN {{'s': 55, 'r': 'token-overlap'}}
    WHEN len(list_filter(shared, lambda t: len(t) >= 4)) > 0 AND len(a.tokens) <= 3 AND len(b.tokens) <= 3
      THEN {{'s': 40, 'r': 'shared-token'}} END AS base
  FROM flagged),
stems AS (
  SELECT *, list_transform(a.words, lambda x: {sql_stem("x")}) AS sa,
    list_transform(b.words, lambda x: {sql_stem("x")}) AS sb FROM based WHERE base IS NOT NULL),
siblings AS (
  SELECT *, list_distinct(list_filter(sa, lambda t: NOT list_contains(sb, t))) AS oa,
    list_distinct(list_filter(sb, lambda t: NOT list_contains(sa, t))) AS ob FROM stems),
totals AS (
  SELECT *, base.r AS reason, CASE WHEN base.r IN ('alias-derived', 'shared-source', 'shared-env-source') THEN base.s
    ELSE least(99, base.s
      - CASE WHEN a.norm = b.norm AND (ia OR ib) THEN 35 ELSE 0 END
      + CASE WHEN a.lang = b.lang THEN 3 ELSE 0 END + CASE WHEN same_dir THEN 2 ELSE 0 END
      - CASE WHEN same_file AND a.name <> b.name AND ltrim(a.name, '_') = ltrim(b.name, '_') THEN 30 ELSE 0 END
      - CASE WHEN a.test AND b.test THEN 25 WHEN a.test OR b.test THEN 30 ELSE 0 END
      - CASE WHEN base.r IN ('token-overlap', 'shared-token') AND same_file AND (
          (len(sa) = len(sb) AND len(sa) >= 2 AND sa[:-2] = sb[:-2] AND sa[-1] <> sb[-1])
          OR (len(oa) = 1 AND len(ob) = 1 AND least(oa[1], ob[1]) || '/' || greatest(oa[1], ob[1])
            IN ({words(sorted("/".join(sorted(t)) for t in vocab.TWIN_TOKENS))}))
          OR (a.lang IN ('javascript', 'typescript') AND b.lang IN ('javascript', 'typescript')
            AND (a.words[1] IN ('set', 'change') OR b.words[1] IN ('set', 'change')) AND list_has_any(sa, sb))
          OR (a.words[-1] IN ({words(vocab.CREDENTIAL_SUFFIXES)}) AND b.words[-1] IN ({words(vocab.CREDENTIAL_SUFFIXES)}))
          OR (list_contains(sa, 'cache') AND list_contains(sb, 'cache'))) THEN 20 ELSE 0 END) END AS score_int
  FROM siblings),
scored AS (
  SELECT project, id_a, id_b, id_a || '||' || id_b AS pair_key, score_int::int AS score_int, reason,
    CASE WHEN score_int >= 75 THEN 'high' WHEN score_int >= 55 THEN 'medium' ELSE 'low' END AS level,
    list_sort(shared) AS shared, a, b
  FROM totals WHERE score_int >= 35)
"""

REVIEWED = """
reviews AS (
  SELECT project, pair_key, CASE (a.seq + b.seq) % 3 WHEN 0 THEN 'not_duplicate' WHEN 1 THEN 'duplicate'
    ELSE 'merged' END AS verdict FROM scored WHERE (a.seq + b.seq) % 29 = 0),
ruled AS (
  SELECT s.*, r.verdict AS human, CASE
    WHEN reason IN ('token-overlap', 'shared-token') AND len(shared) >= 2 THEN 'family:' || array_to_string(shared, '+')
    WHEN reason IN ('value-mismatch', 'same-name', 'same-name-same-value') AND a.norm = b.norm THEN 'name:' || a.norm
    END AS rule FROM scored s LEFT JOIN reviews r USING (project, pair_key)),
rules AS (SELECT DISTINCT project, rule FROM ruled WHERE human = 'not_duplicate' AND rule IS NOT NULL),
judged AS (
  SELECT j.*, coalesce(human, CASE WHEN u.rule IS NOT NULL THEN 'not_duplicate' END) AS verdict,
    human IS NULL AND u.rule IS NOT NULL AS learned
  FROM ruled j LEFT JOIN rules u ON u.project = j.project AND u.rule = j.rule),
open_pairs AS (SELECT * FROM judged WHERE verdict IS DISTINCT FROM 'not_duplicate')
"""

BASE = f"WITH {D.ASSIGNMENTS}, {FEATURES}"
WITH_SCORED = f"{BASE}, {ELIGIBLE}, {SCORED}"
WITH_REVIEWED = f"{WITH_SCORED}, {REVIEWED}"


# ------------------------------------------------------------------- queries

def _features(spark, sf):
    return L.features(D.registry(spark, sf))


def name_features(spark, sf):
    f = L.features(D.registry(spark, sf))
    return f.select("project", "id", "norm", F.array_join("tokens", " ").alias("tokens"),
                    F.array_join("words", " ").alias("words"), "role", "dir", "test", "env_template",
                    "env_read", "idiom", "anchor")


def block_sizes(spark, sf):
    return L.block_sizes(L.block_keys(_features(spark, sf)))


def kept_blocks(spark, sf):
    return L.filter_blocks(L.block_keys(_features(spark, sf))).select("project", "block", "id")


def unlinked_blocks(spark, sf):
    base = L.features(D.registry(spark, sf))
    return L.unlinked_blocks(L.block_sizes(L.block_keys(base)), 5)


def candidate_pairs(spark, sf):
    return L.candidate_pairs(L.filter_blocks(L.block_keys(_features(spark, sf))))


def eligible_pairs(spark, sf):
    # sizes and sides of both meetings read the features: they are computed once and staged
    base = stage(L.features(D.registry(spark, sf)).withColumn("unit", F.lit(None).cast("string")), "eligible-features")
    pairs = L.blocked_pairs(base, whole=True)
    return pairs.select("project", F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b")).distinct()


def scored_pairs(spark, sf):
    return L.scored_pairs(D.registry(spark, sf), sides=False).select(
        "project", "pair_key", "score_int", "level", "reason")


def ignored_pairs(spark, sf):
    """Scored pairs when each project ignores the names its scan rows bear."""
    r = D.registry(spark, sf)
    names = r.filter("origin = 'scan' and lang = 'powershell'").select("project", "name")
    return L.scored_pairs(r, ignored=names).select("project", "pair_key", "score_int", "reason")


def _with_reviews(spark, sf, sides=False):
    """(registry, scored pairs, reviews), the pairs staged because the reviews
    are derived from them, and what they are derived by, so that Spark knows its size."""
    r = D.registry(spark, sf)
    pairs = stage(L.scored_pairs(r, sides=sides), "scored")
    ids = stage(r.select("project", N.row_id(F.col("file"), F.col("scope"), F.col("name")).alias("id"), "seq"), "sequence")
    return r, pairs, D.reviews_of(pairs, ids)


def judged(spark, sf, include_dismissed=True, sides=False):
    r, pairs, reviews = _with_reviews(spark, sf, sides)
    reviewed = L.join_reviews(pairs, reviews)
    return r, L.apply_learned(reviewed, L.learn(reviewed), include_dismissed)


def _as_judged(pairs):
    return pairs.select("project", "pair_key", "score_int", "reason", F.col("review.verdict").alias("verdict"),
                        F.coalesce("review.learned", F.lit(False)).alias("learned"))


def learned_pairs(spark, sf):
    return _as_judged(judged(spark, sf)[1])


def visible_pairs(spark, sf):
    return _as_judged(judged(spark, sf, False)[1])


def pairs_by_settings(spark, sf):
    """Some projects ignore names, some have a unit per top directory, some do not learn from verdicts."""
    r, _, reviews = _with_reviews(spark, sf)
    names = (r.filter("origin = 'scan' and lang = 'powershell' and project like '%1'").groupBy("project")
             .agg(F.to_json(F.collect_set("name")).alias("value")).withColumn("key", F.lit("dup_ignore_names")))
    projects = r.select("project").distinct()
    units = projects.filter("project like '%2'").selectExpr("project", "'standalone_units' as key", "'[\"*\"]' as value")
    off = projects.filter("project like '%3'").selectExpr("project", "'learn_from_reviews' as key", "'false' as value")
    settings = T.project_settings(projects, names.unionByName(units).unionByName(off))
    return _as_judged(L.find_duplicates_by_settings(r, settings, reviews, include_dismissed=True))


def learned_rules(spark, sf):
    _, pairs, reviews = _with_reviews(spark, sf)
    return L.learn(L.join_reviews(pairs, reviews))


def reviewed_pairs(spark, sf):
    _, pairs, reviews = _with_reviews(spark, sf)
    return L.join_reviews(pairs, reviews).select("project", "pair_key", F.col("review.verdict").alias("verdict"))


def pair_sides(spark, sf):
    p = L.scored_pairs(D.registry(spark, sf))
    return p.select("project", "pair_key", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab"
                                             for c in ("id", "name", "line", "value", "status", "origin", "last_session", "repo_value")])


def medium_pairs(spark, sf):
    return L.min_level(L.scored_pairs(D.registry(spark, sf), sides=False), "medium").select("project", "pair_key", "level")


def canonical(spark, sf):
    c = L.canonical_choice(L.scored_pairs(D.registry(spark, sf)))
    return c.select("project", "pair_key", F.col("keep.name").alias("keep_name"), F.col("drop.name").alias("drop_name"),
                    "canonical_value", "value_conflict")


def level_counts(spark, sf):
    return G.level_counts(L.scored_pairs(D.registry(spark, sf), sides=False))


def review_counts(spark, sf):
    return G.review_counts(judged(spark, sf)[1])


def var_level(spark, sf):
    return G.var_level(judged(spark, sf)[1])


def needs_attention(spark, sf):
    r, pairs = judged(spark, sf)
    return G.needs_attention(r, pairs)


def gate(spark, sf):
    return G.gate(judged(spark, sf, False)[1], "medium", 15)


def gate_offenders(spark, sf):
    return G.gate_offenders(judged(spark, sf, False)[1], "medium", 50).select("project", "pair_key", "level")


def report_pairs(spark, sf):
    return G.report_pairs(L.scored_pairs(D.registry(spark, sf), sides=False), 100).select("project", "pair_key", "score_int")


def report_vars(spark, sf):
    """The report's variables: their place in its order and the level of their best pair."""
    r, pairs = judged(spark, sf)
    return G.report(r, pairs, 100)["vars"].select("project", "id", "place", "dup_level")


def report_omitted(spark, sf):
    r, pairs = judged(spark, sf)
    return G.report(r, pairs, 100)["omitted"]


def triage_groups(spark, sf):
    """Triage of each group of projects: a project belongs to the repo of its number."""
    r, pairs = judged(spark, sf, sides=True)
    number = (F.regexp_extract("project", r"(\d+)$", 1).cast("int") % 25).cast("string")
    projects = r.select("project").distinct().withColumn("repo_id", number)
    members = G.group_members(D.groups(spark, sf), D.repos(spark, sf)).join(projects, "repo_id").select(
        "group_id", F.col("project").alias("repo_id"))
    return G.triage(G.issues(pairs, r), members).select("group_id", "project", "kind", "key", "score_int", "reviewed")


def issues(spark, sf):
    r, pairs = judged(spark, sf, sides=True)
    return G.issues(pairs, r).drop("files")


def filtered_issues(spark, sf):
    r, pairs = judged(spark, sf, sides=True)
    rows = G.issues(pairs, r)
    return H.filter_issues(rows, level="medium", review="unreviewed", q="MOD3").select("project", "kind", "key", "title")


def triage(spark, sf):
    r, pairs = judged(spark, sf, sides=True)
    return G.triage(G.issues(pairs, r)).select("project", "kind", "key", "score_int", "reviewed")


def _findings(spark, sf):
    r, pairs = judged(spark, sf, False, sides=True)
    return G.findings(pairs, r)


def findings(spark, sf):
    return _findings(spark, sf).select(
        "project", "section", F.coalesce("pair.pair_key", N.row_id(F.col("row.file"), F.col("row.scope"), F.col("row.name"))).alias("key"))


def batch(spark, sf):
    return G.batches(_findings(spark, sf), 5).select("project", "section", "sort_key").groupBy("project", "section").agg(
        F.count(F.lit(1)).alias("rows"), F.max("sort_key").alias("last_key"))


def evidence_files(spark, sf):
    return G.evidence_files(_findings(spark, sf))


def finding_text(spark, sf):
    return G.finding_text(_findings(spark, sf)).select("project", "section", F.col("n").cast("bigint").alias("n"), "text")


def vars_search(spark, sf):
    r, pairs = judged(spark, sf)
    return H.search(r, G.var_level(pairs), "svc-1", "active").select("project", "id", "dup_level")


def unit_pairs(spark, sf):
    """Pairs when every top-level directory is a standalone unit."""
    r = D.registry(spark, sf)
    units = r.select("project").distinct().select("project", F.explode(F.array(F.lit("*"))).alias("pattern"))
    return L.scored_pairs(r, units=units).select("project", "pair_key", "score_int", "reason")


FINDINGS = """
finding AS (
  SELECT project, 'duplicate' AS section, pair_key AS key, lpad((100 - score_int)::varchar, 3, '0') || pair_key AS sort_key,
    score_int, level, reason, verdict, a, b FROM open_pairs WHERE level IN ('high', 'medium') AND verdict IS DISTINCT FROM 'merged'
  UNION ALL BY NAME
  SELECT project, 'status' AS section, id AS key, status || chr(1) || file || chr(1) || scope || chr(1) || name AS sort_key,
    registry AS r FROM registry WHERE status = 'drifted')
"""
ISSUES = """
issues AS (
  SELECT project, 'duplicate' AS kind, pair_key AS key, level, score_int, reason, verdict, verdict IS NOT NULL AS reviewed,
    a.name || ' ↔ ' || b.name AS title, a.file || ' ' || b.file AS files FROM judged
  UNION ALL
  SELECT project, status, 's:' || id, CASE status WHEN 'file_deleted' THEN 'low' ELSE 'medium' END,
    CASE status WHEN 'drifted' THEN 70 WHEN 'missing' THEN 60 ELSE 40 END, replace(status, '_', ' '), NULL, false, name, file
  FROM registry WHERE status IN ('drifted', 'missing', 'file_deleted'))
"""
_VAR_LEVEL = """
ends AS (SELECT project, unnest([id_a, id_b]) AS id, CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank
  FROM judged WHERE verdict IS DISTINCT FROM 'not_duplicate'),
var_level AS (SELECT project, id, CASE max(rank) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS level
  FROM ends GROUP BY ALL)
"""
_IGNORED = ("WITH " + D.ASSIGNMENTS + ", " + FEATURES + """,
listed AS (SELECT DISTINCT project AS p, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS n FROM registry
  WHERE origin = 'scan' AND lang = 'powershell')""" + ", " + ELIGIBLE + ", " + SCORED.replace(
    "AS ia,", "OR (a.project, a.norm) IN (SELECT (p, n) FROM listed) AS ia,").replace(
    "AS ib,", "OR (b.project, b.norm) IN (SELECT (p, n) FROM listed) AS ib,") + " SELECT project, pair_key, score_int, reason FROM scored")
_UNIT = ("WITH " + D.ASSIGNMENTS + ", " + FEATURES + ", " + ELIGIBLE.replace(
    "WHERE NOT (a.lang = 'env'", "WHERE split_part(a.file, '/', 1) = split_part(b.file, '/', 1) AND NOT (a.lang = 'env'") + ", " + SCORED)


# verdicts are those on the pairs that are scored without settings
_PLAIN = (WITH_SCORED + ", " + REVIEWED.split("ruled AS")[0].rstrip().rstrip(",") + " SELECT project, pair_key, verdict FROM reviews")
_BY_SETTINGS = ("WITH plain AS (" + _PLAIN + "), " + D.ASSIGNMENTS + ", " + FEATURES + """,
listed AS (SELECT DISTINCT project AS p, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS n FROM registry
  WHERE origin = 'scan' AND lang = 'powershell' AND project LIKE '%1')""" + ", " + ELIGIBLE.replace(
    "WHERE NOT (a.lang = 'env'", """WHERE (a.project NOT LIKE '%2' OR split_part(a.file, '/', 1) = split_part(b.file, '/', 1))
    AND NOT (a.lang = 'env'""") + ", " + SCORED.replace(
    "AS ia,", "OR (a.project, a.norm) IN (SELECT (p, n) FROM listed) AS ia,").replace(
    "AS ib,", "OR (b.project, b.norm) IN (SELECT (p, n) FROM listed) AS ib,") + ", reviews AS (SELECT * FROM plain), ruled AS"
    + REVIEWED.split("ruled AS")[1].replace("WHERE human = 'not_duplicate'", "WHERE project NOT LIKE '%3' AND human = 'not_duplicate'")
    + " SELECT project, pair_key, score_int, reason, verdict, learned FROM judged")


def _count_if(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


_SAFE = lambda c: f"replace(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'), '`', '''')"


def _side_sql(tag: str) -> str:
    s = tag.lower()
    return (f"'- {tag}: `' || {s}.name || '`' || CASE WHEN {s}.scope <> '' THEN ' [scope `' || {s}.scope || '`]' ELSE '' END"
            f" || ' = `' || {_SAFE(s + '.value')} || '` — ' || {s}.file || ':' || {s}.line::varchar"
            f" || ' (status ' || {s}.status || ', origin ' || {s}.origin || ', lang ' || {s}.lang || ')'")


FINDING_TEXT = f"""
SELECT project, section, row_number() OVER (PARTITION BY project, section ORDER BY sort_key) AS n,
  CASE WHEN section = 'duplicate' THEN
    '### D' || row_number() OVER (PARTITION BY project, section ORDER BY sort_key)::varchar || '. `' || a.name || '` vs `'
    || b.name || '` — ' || reason || ' (score 0.' || lpad(score_int::varchar, 2, '0') || ', ' || level || ' confidence)' || chr(10)
    || {_side_sql('A')} || chr(10) || {_side_sql('B')}
    || CASE WHEN verdict IS NOT NULL THEN chr(10) || '- prior review verdict: **' || verdict || '** — seen' ELSE '' END
    || chr(10) || '- verdict key: `' || key || '`'
  ELSE '### S' || row_number() OVER (PARTITION BY project, section ORDER BY sort_key)::varchar || '. `' || r.name || '`'
    || CASE WHEN r.scope <> '' THEN ' [scope `' || r.scope || '`]' ELSE '' END || ' — drifted (' || r.file || ':' || r.line::varchar || ')'
    || chr(10) || '- AI-written value: `' || r.value || '` (session ' || r.last_session[:8] || ', '
    || strftime(r.seen, '%Y-%m-%dT%H:%M:%S') || ')' || chr(10) || '- repository holds now: `' || r.now_value || '`' || chr(10) || '- if the change is intended, accept name `' || r.name
      || '` in `' || r.file || '`' || CASE WHEN r.scope <> '' THEN ', scope `' || r.scope || '`' ELSE '' END END AS text
FROM finding
"""

_PARTS_A = "len(list_filter(regexp_split_to_array(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[_.]'), lambda w: w <> ''))"
_BWINS = ("CASE WHEN wb > wa OR (wb = wa AND len(b.name) > len(a.name)) OR (wb = wa AND len(b.name) = len(a.name) "
          "AND b.name < a.name) THEN {b} ELSE {a} END")

QUERIES = {
    "d1_d10_name_features": (name_features, BASE + """
        SELECT project, id, norm, array_to_string(tokens, ' ') AS tokens, array_to_string(words, ' ') AS words, role, dir, test,
          lang = 'env' AND env_template AS env_template, env_read, idiom, nontrivial AND NOT destructured AS anchor FROM features"""),
    "f3_block_sizes": (block_sizes, BASE + " SELECT project, block, block_rows FROM sizes"),
    "f4_filter_blocks": (kept_blocks, BASE + " SELECT project, block, id FROM kept"),
    "f4_unlinked_blocks": (unlinked_blocks, BASE + " SELECT project, block, block_rows AS rows FROM sizes WHERE block_rows > 5"),
    "f5_candidate_pairs": (candidate_pairs, BASE + " SELECT project, id_a, id_b FROM candidates"),
    "f6_eligible_pairs": (eligible_pairs, f"{BASE}, {ELIGIBLE} SELECT project, id_a, id_b FROM eligible"),
    "f7_scored_pairs": (scored_pairs, WITH_SCORED + " SELECT project, pair_key, score_int, level, reason FROM scored"),
    "f6_d11_standalone_units": (unit_pairs, _UNIT + " SELECT project, pair_key, score_int, reason FROM scored"),
    "f18_ignore_names": (ignored_pairs, _IGNORED),
    "f14_join_reviews": (reviewed_pairs, WITH_REVIEWED + " SELECT project, pair_key, human AS verdict FROM ruled"),
    "f15_f16_learned_rules": (learned_rules, WITH_REVIEWED + " SELECT project, rule FROM rules"),
    "f17_apply_learned": (learned_pairs, WITH_REVIEWED + " SELECT project, pair_key, score_int, reason, verdict, learned FROM judged"),
    "f17_pairs_by_settings": (pairs_by_settings, _BY_SETTINGS),
    "f17_visible_pairs": (visible_pairs, WITH_REVIEWED + " SELECT project, pair_key, score_int, reason, verdict, learned FROM open_pairs"),
    "f20_pair_sides": (pair_sides, WITH_SCORED + " SELECT project, pair_key, " + ", ".join(
        f"{s}.{c} AS {s}_{n}" for s in "ab" for n, c in (
            ("id", "id"), ("name", "name"), ("line", "line"), ("value", "value"), ("status", "status"), ("origin", "origin"),
            ("last_session", "last_session"), ("repo_value", "now_value"))) + " FROM scored"),
    "f21_min_level": (medium_pairs, WITH_SCORED + " SELECT project, pair_key, level FROM scored WHERE level <> 'low'"),
    "d19_canonical_choice": (canonical, WITH_SCORED + f""", sized AS (SELECT *, {_PARTS_A.format(x='a.name')} AS wa,
        {_PARTS_A.format(x='b.name')} AS wb FROM scored)
        SELECT project, pair_key, {_BWINS.format(a='a.name', b='b.name')} AS keep_name, {_BWINS.format(a='b.name', b='a.name')} AS drop_name,
        {_BWINS.format(a='a.value', b='b.value')} AS canonical_value, a.value <> b.value AS value_conflict FROM sized"""),
    "g3_level_counts": (level_counts, WITH_SCORED + " SELECT project, level, count(*) AS pairs FROM scored GROUP BY ALL"),
    "g4_review_counts": (review_counts, WITH_REVIEWED + " SELECT project, " + ", ".join(
        _count_if(f"verdict IS NULL AND level = '{lv}'", f"unreviewed_{lv}") for lv in G.LEVELS) + ", "
        + _count_if("verdict IS NOT NULL AND NOT learned", "reviewed_pairs") + ", "
        + _count_if("learned", "learned_suppressed") + " FROM judged GROUP BY project"),
    "g6_var_level": (var_level, f"{WITH_REVIEWED}, {_VAR_LEVEL} SELECT project, id, level FROM var_level"),
    "g7_report_pairs": (report_pairs, WITH_SCORED + """ SELECT project, pair_key, score_int FROM scored
        QUALIFY row_number() OVER (PARTITION BY project ORDER BY score_int DESC, pair_key) <= 100"""),
    "g7_report_vars": (report_vars, f"""{WITH_REVIEWED}, {_VAR_LEVEL} SELECT r.project, r.id, v.level AS dup_level,
          row_number() OVER (PARTITION BY r.project ORDER BY scope <> '', file, coalesce(line, 0), r.id) AS place
        FROM registry r LEFT JOIN var_level v ON v.project = r.project AND v.id = r.id"""),
    "g7_report_omitted": (report_omitted, WITH_REVIEWED + """ SELECT project, greatest(count(*) - 100, 0) AS omitted
        FROM judged GROUP BY project"""),
    "g8_needs_attention": (needs_attention, WITH_REVIEWED + """,
        p AS (SELECT project, count(*) FILTER (WHERE verdict IS NULL AND level = 'high') AS high,
          count(*) FILTER (WHERE verdict IS NULL AND level = 'medium') AS medium,
          count(*) FILTER (WHERE verdict IS NULL AND level = 'low') AS low,
          count(*) FILTER (WHERE verdict IS NOT NULL AND NOT learned) AS reviewed FROM judged GROUP BY project),
        r AS (SELECT project, count(*) AS tracked, count(*) FILTER (WHERE status = 'drifted') AS drifted,
          count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'file_deleted') AS file_deleted
          FROM registry GROUP BY project)
        SELECT project, tracked, coalesce(high, 0) + coalesce(medium, 0) + drifted + missing AS needs_attention,
          coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, drifted, missing, file_deleted,
          coalesce(reviewed, 0) AS reviewed FROM r LEFT JOIN p USING (project)"""),
    "g11_issues": (issues, f"{WITH_REVIEWED}, {ISSUES} SELECT project, kind, key, level, score_int, reason, verdict, reviewed, title FROM issues"),
    "g12_triage": (triage, f"""{WITH_REVIEWED}, {ISSUES}, tops AS (SELECT * FROM issues QUALIFY row_number() OVER (
        PARTITION BY project ORDER BY reviewed, score_int DESC, key) <= 8)
        SELECT project, kind, key, score_int, reviewed FROM tops ORDER BY reviewed, score_int DESC, key, project LIMIT 12"""),
    "g12_triage_groups": (triage_groups, f"""{WITH_REVIEWED}, {ISSUES}, {D.REPOS}, tops AS (SELECT * FROM issues QUALIFY row_number() OVER (
        PARTITION BY project ORDER BY reviewed, score_int DESC, key) <= 8)
        SELECT CASE WHEN n_nationkey % 5 <> 0 THEN 'g-' || r_name ELSE 'standalone' END AS group_id, project, kind, key, score_int, reviewed
        FROM tops JOIN repos ON (regexp_extract(project, '(\\d+)$', 1)::int % 25)::varchar = repo_id
        QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY reviewed, score_int DESC, key, project) <= 12"""),
    "g14_gate": (gate, WITH_REVIEWED + """ SELECT project, count(*) FILTER (WHERE level <> 'low') AS found,
        count(*) FILTER (WHERE level <> 'low') <= 15 AS passed, count(*) FILTER (WHERE level = 'high') AS high,
        count(*) FILTER (WHERE level = 'medium') AS medium, 0::bigint AS low FROM open_pairs GROUP BY project"""),
    "g14_gate_offenders": (gate_offenders, WITH_REVIEWED + """ SELECT project, pair_key, level FROM open_pairs WHERE level <> 'low'
        QUALIFY row_number() OVER (PARTITION BY project ORDER BY score_int DESC, pair_key) <= 50"""),
    "g15_findings": (findings, f"{WITH_REVIEWED}, {FINDINGS} SELECT project, section, key FROM finding"),
    "g16_batches": (batch, f"""{WITH_REVIEWED}, {FINDINGS}, numbered AS (SELECT *, row_number() OVER (
        PARTITION BY project, section ORDER BY sort_key) AS n FROM finding)
        SELECT project, section, count(*) AS rows, max(sort_key) AS last_key FROM numbered
        WHERE n <= 5 OR section = 'status' GROUP BY ALL"""),
    "g17_evidence_files": (evidence_files, f"""{WITH_REVIEWED}, {FINDINGS} SELECT DISTINCT project, file FROM (
        SELECT project, unnest([a.file, b.file, r.file]) AS file FROM finding) WHERE file IS NOT NULL"""),
    "g18_finding_text": (finding_text, f"{WITH_REVIEWED}, {FINDINGS} {FINDING_TEXT}"),
    "h2_vars_search": (vars_search, f"""{WITH_REVIEWED}, {_VAR_LEVEL} SELECT r.project, r.id, v.level AS dup_level
        FROM registry r LEFT JOIN var_level v ON v.project = r.project AND v.id = r.id
        WHERE status = 'active' AND contains(lower(concat_ws(' ', name, file, value)), 'svc-1')"""),
    "h3_filter_issues": (filtered_issues, f"""{WITH_REVIEWED}, {ISSUES} SELECT project, kind, key, title FROM issues
        WHERE level = 'medium' AND NOT reviewed AND contains(lower(title || ' ' || files), 'mod3')"""),
}
