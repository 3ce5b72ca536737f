"""Registry-shaped tables derived from the star-schema and event tables.

Each derivation exists twice: as a DataFrame and as a SQL common table
expression for the comparison engine.  Both grow with the source tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.latest import latest
from ..schema import KEY

AS_OF = "2025-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table; one that arrives in fewer partitions than there are cores
    (a small file) is spread over them, a large one is read as it is split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages", "part") and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


# ------------------------------------------------------------- assignments

def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment per part; several may share a key (see `registry`)."""
    seq = F.col("p_partkey")
    w = F.split(F.lower("p_name"), " ")
    one, two = w[0], w[1]
    sn = F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))

    def text(fmt, col):
        return F.format_string(fmt, col)

    def pick(n, *options):
        out = F.when(seq % n == 0, options[0])
        for i, o in enumerate(options[1:], 1):
            out = out.when(seq % n == i, o)
        return out

    size4, size6 = F.col("p_size") % 4, F.col("p_size") % 6
    env = F.col("p_size") % 12 == 11
    file = F.concat(F.lower("p_type"), F.when(env, F.when(F.col("p_size") % 24 == 23, "/.env.example").otherwise("/.env")).otherwise(
        F.concat(F.when(size4 == 2, "/test_mod").otherwise("/mod"), size6.cast("string"),
                 F.when(size4 == 1, ".ts").when(size4 == 3, ".ps1").otherwise(".py"))))
    status = F.when(seq % 11 == 0, "drifted").when(seq % 11 == 1, "missing").when(
        seq % 11 == 2, "file_deleted").otherwise("active")
    name = pick(5, F.upper(sn), sn, F.concat(one, F.initcap(two)), F.concat(F.upper(sn), F.lit("_LIMIT")),
                F.concat(F.lit("MAX_"), F.upper(two)))
    link = F.concat(F.lit("load("), F.upper(sn), F.lit(")"))
    value = F.when(seq % 10 == 7, link).otherwise(pick(3, text('"https://svc-%d.internal/api"', seq % 40), text("%d", seq % 97),
                 text('os.environ.get("K%d")', seq % 9)))
    at = (F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + seq * 60).cast("timestamp")
    df = table(spark, sf_dir, "part").select(
        seq.alias("seq"), F.col("p_brand").alias("project"), file.alias("file"),
        F.when(seq % 7 == 0, "run").otherwise("").alias("scope"), name.alias("name"),
        F.when(env, "env").when(size4 == 1, "typescript").when(size4 == 3, "powershell").otherwise("python").alias("lang"),
        F.when(seq % 29 == 0, "const-destructure").otherwise("assign").alias("kind"), (seq % 400 + 1).cast("int").alias("line"), value.alias("value"),
        F.when(seq % 31 == 0, F.upper(sn)).alias("anno"), status.alias("status"),
        F.format_string("s%d", seq % 31).alias("first_session"),
        F.format_string("s%d", seq % 37).alias("last_session"),
        at.alias("at"), pick(3, F.lit("scan"), F.lit("claude"), F.lit("kilo")).alias("origin"))
    return df


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest assignment per key in the full registry schema, plus `seq`."""
    return as_registry(latest(assignments(spark, sf_dir), KEY, ["seq"]))


def as_registry(a: DataFrame) -> DataFrame:
    """Registry columns over derived assignment rows (keeps seq)."""
    shown = X.make_preview(F.col("value"))
    drifted = F.col("status") == "drifted"
    now = F.when(drifted, F.concat("value", F.lit(" + 1"))).otherwise(F.col("value"))
    return (a.withColumn("_p", shown).withColumn("_now", now).select(
        "project", "file", "scope", "name", "lang", "kind", "line",
        F.col("_p.preview").alias("value_preview"), X.value_hash(F.col("value")).alias("value_hash"),
        F.col("_p.redacted").alias("redacted"), "anno",
        F.col("_now").alias("repo_value_preview"), X.value_hash(F.col("_now")).alias("repo_value_hash"),
        F.col("line").alias("repo_line"), "status", "first_session", "last_session",
        F.col("at").alias("first_seen_at"), F.col("at").alias("last_written_at"),
        F.col("at").alias("last_verified_at"), "origin", F.lit(None).cast("string").alias("note"), "seq"))


ASSIGNMENTS = """
assignments AS (
  SELECT p_partkey AS seq, p_brand AS project,
    lower(p_type) || CASE WHEN p_size % 24 = 23 THEN '/.env.example' WHEN p_size % 12 = 11 THEN '/.env'
      ELSE CASE WHEN p_size % 4 = 2 THEN '/test_mod' ELSE '/mod' END || (p_size % 6)::varchar
      || CASE p_size % 4 WHEN 1 THEN '.ts' WHEN 3 THEN '.ps1' ELSE '.py' END END AS file,
    CASE WHEN p_partkey % 7 = 0 THEN 'run' ELSE '' END AS scope,
    CASE p_partkey % 5
      WHEN 0 THEN upper(replace(lower(p_name), ' ', '_'))
      WHEN 1 THEN replace(lower(p_name), ' ', '_')
      WHEN 2 THEN split_part(lower(p_name), ' ', 1) || upper(split_part(lower(p_name), ' ', 2)[1])
        || split_part(lower(p_name), ' ', 2)[2:]
      WHEN 3 THEN upper(replace(lower(p_name), ' ', '_')) || '_LIMIT'
      ELSE 'MAX_' || upper(split_part(lower(p_name), ' ', 2)) END AS name,
    CASE WHEN p_size % 12 = 11 THEN 'env' WHEN p_size % 4 = 1 THEN 'typescript'
      WHEN p_size % 4 = 3 THEN 'powershell' ELSE 'python' END AS lang,
    CASE WHEN p_partkey % 29 = 0 THEN 'const-destructure' ELSE 'assign' END AS kind,
    CASE WHEN p_partkey % 31 = 0 THEN upper(replace(lower(p_name), ' ', '_')) END AS anno, (p_partkey % 400 + 1)::int AS line,
    CASE WHEN p_partkey % 10 = 7 THEN 'load(' || upper(replace(lower(p_name), ' ', '_')) || ')'
    ELSE CASE p_partkey % 3
      WHEN 0 THEN '"https://svc-' || (p_partkey % 40)::varchar || '.internal/api"'
      WHEN 1 THEN (p_partkey % 97)::varchar
      ELSE 'os.environ.get("K' || (p_partkey % 9)::varchar || '")' END END AS value,
    CASE p_partkey % 11 WHEN 0 THEN 'drifted' WHEN 1 THEN 'missing' WHEN 2 THEN 'file_deleted'
      ELSE 'active' END AS status,
    's' || (p_partkey % 31)::varchar AS first_session, 's' || (p_partkey % 37)::varchar AS last_session,
    timestamp '2024-01-01 00:00:00' + to_minutes(p_partkey) AS seen,
    CASE p_partkey % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'claude' ELSE 'kilo' END AS origin
  FROM part),
registry AS (
  SELECT *, file || '|' || scope || '|' || name AS id,
    CASE WHEN status = 'drifted' THEN value || ' + 1' ELSE value END AS now_value,
    sha1(value) AS value_hash
  FROM assignments
  QUALIFY row_number() OVER (PARTITION BY project, file, scope, name ORDER BY seq DESC) = 1)
"""


# ---------------------------------------------------------------- snapshots

def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(baseline registry, described rows found now, files that exist now)."""
    rows = latest(assignments(spark, sf_dir), KEY, ["seq"])
    seq = F.col("seq")
    baseline = as_registry(rows.filter(seq % 13 != 0))
    now = (rows.filter((seq % 17 != 0) & ~F.col("file").startswith("promo/mod3"))
           .withColumn("scope", F.when(seq % 23 == 0, "moved").otherwise(F.col("scope")))
           .withColumn("value", F.when(seq % 19 == 0, '"changed"').otherwise(F.col("value"))))
    from ..operators.registry import described
    found = described(now.select("project", "file", "scope", "name", "lang", "kind", "line", "value",
                                 "anno", seq.alias("ord")))
    files = now.select("project", "file").distinct()
    return baseline, found, files


SNAPSHOTS = """
baseline AS (SELECT * FROM registry WHERE seq % 13 <> 0),
found AS (
  SELECT project, file, CASE WHEN seq % 23 = 0 THEN 'moved' ELSE scope END AS scope, name, lang, kind, line,
    seq AS ord, CASE WHEN seq % 19 = 0 THEN '"changed"' ELSE value END AS value
  FROM registry WHERE seq % 17 <> 0 AND NOT starts_with(file, 'promo/mod3')),
found_last AS (
  SELECT *, sha1(value) AS value_hash FROM found
  QUALIFY row_number() OVER (PARTITION BY project, file, scope, name ORDER BY ord DESC) = 1),
found_files AS (SELECT DISTINCT project, file FROM found)
"""


# ----------------------------------------------------------- events, changes

def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events: one per event row."""
    return table(spark, sf_dir, "events").select(
        F.format_string("u%d", F.col("user_id") % 20).alias("project"), "ts",
        F.format_string("s%d", "user_id").alias("session_id"), F.col("event_type").alias("action"),
        F.format_string("K_%s", F.get_json_object("props", "$.k")).alias("name"),
        F.format_string("src/%s.py", "event_type").alias("file"), F.lit("").alias("scope"),
        F.lit(None).cast("string").alias("detail"), "event_id")


EVENT_LOG = """
event_log AS (
  SELECT 'u' || (user_id % 20)::varchar AS project, ts, 's' || user_id::varchar AS session_id,
    event_type AS action, 'K_' || json_extract_string(props, '$.k') AS name,
    'src/' || event_type || '.py' AS file, '' AS scope, event_id
  FROM events)
"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent change events: a Write or an Edit of one small file each.

    `file_content` holds the assigned name, and for every fifth event a second
    assignment a human wrote."""
    e = event_log(spark, sf_dir).join(
        table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents")),
        "event_id")
    assign = F.concat("name", F.lit(" = "), F.col("cents").cast("string"))
    eid = F.col("event_id")
    content = F.concat(assign, F.when(eid % 5 == 0, F.concat(F.lit("\nHUMAN_"), F.col("name"), F.lit(" = 1\n"))).otherwise("\n"))
    new_string = F.when(eid % 2 == 0, assign).otherwise("")
    return e.select(
        "project", "event_id", "ts", "session_id",
        F.concat(F.lit("/w/"), F.col("project")).alias("cwd"),
        F.when(eid % 3 == 0, "Write").when(eid % 41 == 0, "Read").when(eid % 3 == 1, "Edit").otherwise("MultiEdit").alias("tool_name"),
        F.struct(
            F.when(eid % 43 == 0, "").when(eid % 47 == 0, "/elsewhere/a.py").when(eid % 53 == 0, "notes.txt")
            .when(eid % 59 == 0, F.concat(F.lit("/w/"), F.col("project"), F.lit("/dist/a.py")))
            .otherwise(F.concat(F.lit("/w/"), F.col("project"), F.lit("/"), F.col("file"))).alias("file_path"),
            content.alias("content"), new_string.alias("new_string"),
            F.array(F.struct(new_string.alias("new_string"))).alias("edits")).alias("tool_input"),
        F.when(eid % 61 != 0, content).alias("file_content"),
        "name", "cents")


CHANGES = """
changes AS (
  SELECT l.*, round(e.value * 100)::bigint AS cents,
    CASE WHEN l.event_id % 3 = 0 THEN 'Write' WHEN l.event_id % 41 = 0 THEN 'Read'
      WHEN l.event_id % 3 = 1 THEN 'Edit' ELSE 'MultiEdit' END AS tool_name,
    CASE WHEN l.event_id % 43 = 0 THEN '' WHEN l.event_id % 47 = 0 THEN '/elsewhere/a.py'
      WHEN l.event_id % 53 = 0 THEN 'notes.txt' WHEN l.event_id % 59 = 0 THEN 'dist' ELSE l.file END AS path
  FROM event_log l JOIN events e USING (event_id))
"""


# ------------------------------------------------- reviews, repos, containers

def reviews_of(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """Verdicts on some pairs: seqs maps (project, id) to seq."""
    a = seqs.select("project", F.col("id").alias("id_a"), F.col("seq").alias("seq_a"))
    b = seqs.select("project", F.col("id").alias("id_b"), F.col("seq").alias("seq_b"))
    s = F.col("seq_a") + F.col("seq_b")
    verdict = F.when(s % 3 == 0, "not_duplicate").when(s % 3 == 1, "duplicate").otherwise("merged")
    return (pairs.select("project", "id_a", "id_b", "pair_key").join(a, ["project", "id_a"])
            .join(b, ["project", "id_b"]).filter(s % 29 == 0)
            .select("project", "pair_key", verdict.alias("verdict"), F.lit("seen").alias("note"),
                    F.lit(AS_OF).cast("timestamp").alias("ts")))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    slug = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("repo_id"), F.col("n_name").alias("name"),
        F.concat(F.lit("/src/"), slug("r_name"), F.lit("/"), slug("n_name")).alias("path"),
        "r_name", "n_nationkey")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One container per supplier; every fifth has no compose project."""
    s = table(spark, sf_dir, "supplier").join(
        repos(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    region = F.concat(F.lit("/src/"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("_")))
    key = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("/"), F.col("s_name")).alias("name"),
        F.when(key % 5 != 4, F.create_map(F.lit("com.docker.compose.project"), F.format_string("cp%d", key % 7)))
        .otherwise(F.create_map().cast("map<string,string>")).alias("labels"),
        F.array(F.struct(F.lit("bind").alias("Type"),
                         F.when(key % 3 == 0, region).otherwise(F.concat("path", F.lit("/app"))).alias("Source")),
                F.struct(F.lit("volume").alias("Type"), F.lit("/src").alias("Source"))).alias("mounts"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One confirmed group per region; every fifth nation is left out."""
    return (repos(spark, sf_dir).filter("n_nationkey % 5 <> 0").groupBy("r_name").agg(
        F.array_sort(F.collect_set("repo_id")).alias("repo_ids"))
        .select(F.concat(F.lit("g-"), F.col("r_name")).alias("group_id"), F.col("r_name").alias("name"),
                "repo_ids", F.array().cast("array<string>").alias("compose_projects"),
                F.lit(True).alias("confirmed")))


REPOS = """
repos AS (
  SELECT n_nationkey::varchar AS repo_id, n_name AS name, n_nationkey, r_name,
    '/src/' || replace(lower(r_name), ' ', '_') AS region_path,
    '/src/' || replace(lower(r_name), ' ', '_') || '/' || replace(lower(n_name), ' ', '_') AS path
  FROM nation JOIN region ON n_regionkey = r_regionkey),
containers AS (
  SELECT s_name AS cname, CASE WHEN s_suppkey % 5 <> 4 THEN 'cp' || (s_suppkey % 7)::varchar END AS compose,
    CASE WHEN s_suppkey % 3 = 0 THEN region_path ELSE path || '/app' END AS mount
  FROM supplier JOIN repos ON s_nationkey = n_nationkey)
"""
