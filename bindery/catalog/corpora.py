"""Queries over source corpora, groups and streams, with their SQL twins."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import groups as I
from ..operators.extract import brace_scope, extract_assignments, last_occurrence
from ..plans import analyze as A
from ..plans import reports as G
from ..schema import CHANGE_EVENTS
from ..sources import corpus as C
from ..staging import stage_dir
from ..streaming import capture as J
from ..streaming import feed as J5
from . import derive as D
from .pairs import ELIGIBLE, FEATURES, SCORED

REG = f"WITH {D.ASSIGNMENTS}"

# One file per part and language.  {n} part key, {a} and {b} the words of its
# name, {A} the first in capitals.  Expected: name, line, scope, kind, value, anno.
SOURCES = {
    "b1_extract_python": ("src/p{n}.py", """import os
{A}_URL = "https://x/{n}"
class C{n}:
    {b}: int = {n}
    declared: str
    def run(self, x=(z := 2)):
        self.{a}, other = 1, {n}
        if (k := {n}) > 1:
            {b} += k
        [first, *rest] = f(
            {n})
""", [("{A}_URL", 2, "", "assign", '"https://x/{n}"', None), ("{b}", 4, "C{n}", "annassign", "{n}", "int"),
      ("z", 6, "C{n}.run", "walrus", "2", None),
      ("self.{a}", 7, "C{n}.run", "attr", "1, {n}", None), ("other", 7, "C{n}.run", "assign", "1, {n}", None),
      ("k", 8, "C{n}.run", "walrus", "{n}", None), ("{b}", 9, "C{n}.run", "augassign", "k", None),
      ("first", 10, "C{n}.run", "assign", "f(\n            {n})", None), ("rest", 10, "C{n}.run", "assign", "f(\n            {n})", None)]),
    "b2_b12_extract_typescript": ("src/p{n}.tsx", """// const no = 1;
export const {A}_URL = "https://x/{n}", {b}Count: number = {n};
const { {a}, port: {b}Port, opts = {}, ...tail } = load({n});
const [one, , two] = pair;
let later;
export async function run{n}(x) {
  {a}State = "ready";
  cfg.{b} = {n};
  const go = (y: number): number => {
    var inner = y == {n};
  };
  return (
    <Panel
      className="{a}"
      onClick={() => go({n})}>
  );
}
if (a === b) {}
const after = {n}; // end
""", [("{A}_URL", 2, "", "const", '"https://x/{n}"', None), ("{b}Count", 2, "", "const", "{n}", None),
      ("{a}", 3, "", "const-destructure", "load({n})", None), ("{b}Port", 3, "", "const-destructure", "load({n})", None),
      ("opts", 3, "", "const-destructure", "load({n})", None), ("tail", 3, "", "const-destructure", "load({n})", None),
      ("one", 4, "", "const-destructure", "pair", None), ("two", 4, "", "const-destructure", "pair", None),
      ("{a}State", 7, "run{n}", "reassign", '"ready"', None), ("cfg.{b}", 8, "run{n}", "reassign", "{n}", None),
      ("go", 9, "run{n}", "const", "(y: number): number => {", None), ("inner", 10, "go", "var", "y == {n}", None),
      ("after", 19, "", "const", "{n}", None)]),
    "b3_extract_powershell": ("ops/p{n}.ps1", """$ApiKey{n} = "{a} # x" # why
$global:{b} = {n}
Set-Variable -Name Retries -Value {n}
$text = @'
$inside = 1
'@
$after = {n}
if ($x -eq 1) { }
""", [("ApiKey{n}", 1, "", "ps-assign", '"{a} # x"', None), ("{b}", 2, "", "ps-global", "{n}", None),
      ("Retries", 3, "", "ps-setvariable", "{n}", None), ("text", 4, "", "ps-assign", "@'", None),
      ("after", 7, "", "ps-assign", "{n}", None)]),
    "b4_extract_shell": ("ops/p{n}.sh", """export {A}_{n}=/usr/{b}
local tmp='/tmp/{n}' # note
cat > f.env <<-'EOF{n}'
INSIDE={n}
EOF
EOF{n}
declare -r {b}=1
empty=
# NO=1
""", [("{A}_{n}", 1, "", "sh-export", "/usr/{b}", None), ("tmp", 2, "", "sh-local", "'/tmp/{n}'", None),
      ("{b}", 7, "", "sh-declare", "1", None), ("empty", 8, "", "sh-assign", None, None)]),
    "b5_extract_env": ("ops/.env.p{n}", """# {A}=1
{A}_HOST={b}-{n}
  export PORT.{b} = {n} # kept
EMPTY=
""", [("{A}_HOST", 2, "", "env", "{b}-{n}", None), ("PORT.{b}", 3, "", "env", "{n} # kept", None),
      ("EMPTY", 4, "", "env", None, None)]),
    "b6_extract_csharp": ("src/P{n}.cs", """class P{n} {
  private const int {A} = {n}; // c
  public void Run{n}(int x)
  {
    var {b} = {n};
    if (x > 1) { string s = "{a}"; }
    {
      int deep = 1;
    }
  }
  static double tail = {n} ;
  return x = 1;
}
""", [("{A}", 2, "", "cs-assign", "{n}", None), ("{b}", 5, "Run{n}", "cs-assign", "{n}", None),
      ("deep", 8, "Run{n}", "cs-assign", "1", None), ("tail", 11, "", "cs-assign", "{n} ", None)]),
    "b7_extract_go": ("src/p{n}.go", """var {b} int = {n}
func (s *S) Run{n}(a int) {
\t{a}, err := load("http://x/{n}")
\t_, ok := m[{n}]
\tfor i := 0; i < {n}; i++ {
\t}
}
func done()
var last = {n}
""", [("{b}", 1, "", "go-var", "{n}", None), ("{a}", 3, "Run{n}", "go-short", 'load("http://x/{n}")', None),
      ("err", 3, "Run{n}", "go-short", 'load("http://x/{n}")', None), ("ok", 4, "Run{n}", "go-short", "m[{n}]", None),
      ("last", 9, "", "go-var", "{n}", None)]),
    "b8_extract_rust": ("src/p{n}.rs", """pub const {A}: u32 = {n};
static mut NAME{n}: &str = "{b}";
pub async fn run{n}() {
    let mut {a}: u64 = {n};
    let {b} = g({n})
}
let top = 1;
""", [("{A}", 1, "", "rust-const", "{n}", None), ("NAME{n}", 2, "", "rust-static", '"{b}"', None),
      ("{a}", 4, "run{n}", "rust-let", "{n}", None), ("{b}", 5, "run{n}", "rust-let", "g({n})", None),
      ("top", 7, "", "rust-let", "1", None)]),
    "b9_extract_java": ("src/P{n}.java", """public class P{n} {
  private static final int {A} = {n};
  public static void run{n}(String[] args) {
    final Map<String, List<Integer>> {b} = new HashMap<>();
    int {a} = {n}; // c
    x = 1;
  }
  String tail = "{a}";
}
""", [("{A}", 2, "", "java-assign", "{n}", None), ("{b}", 4, "run{n}", "java-assign", "new HashMap<>()", None),
      ("{a}", 5, "run{n}", "java-assign", "{n}", None), ("tail", 8, "", "java-assign", '"{a}"', None)]),
}
PARTS = """parts AS (SELECT p_partkey::varchar AS n, p_brand AS project, split_part(lower(p_name), ' ', 1) AS a,
  split_part(lower(p_name), ' ', 2) AS b, upper(split_part(p_name, ' ', 1)) AS "A" FROM part)"""


def _fill_sql(template: str | None) -> str:
    if template is None:
        return "NULL"
    out = "'" + template.replace("'", "''") + "'"
    for mark in ("n", "a", "b"):
        out = f"replace({out}, '{{{mark}}}', {mark})"
    return f"replace({out}, '{{A}}', upper(a))"


def sources(spark, sf, path: str, content: str):
    p = D.table(spark, sf, "part")
    w = F.split(F.lower("p_name"), " ")
    words = {"n": F.col("p_partkey").cast("string"), "a": w[0], "b": w[1], "A": F.upper(w[0])}

    def fill(template):
        out = F.lit(template)
        for mark, word in words.items():
            out = F.replace(out, F.lit("{%s}" % mark), word)
        return out

    return p.select(F.col("p_brand").alias("project"), fill(path).alias("path"), fill(content).alias("content"))


def _extraction(path, content):
    def run(spark, sf):
        rows = extract_assignments(sources(spark, sf, path, content))
        return rows.select("project", "file", "name", "line", "scope", "kind", "value", "anno")
    return run


def _expected(path, rows) -> str:
    def one(name, line, scope, kind, value, anno):
        return (f"SELECT project, {_fill_sql(path)} AS file, {_fill_sql(name)} AS name, {line}::int AS line, {_fill_sql(scope)} AS scope, "
                f"'{kind}' AS kind, {_fill_sql(value)} AS value, {_fill_sql(anno)} AS anno FROM parts")
    return f"WITH {PARTS} " + " UNION ALL ".join(one(*r) for r in rows)


def extract_texts(spark, sf):
    """Every document read as an env file, whole; inline keys start a line."""
    d = D.table(spark, sf, "documents").select(
        F.col("source").alias("project"), F.format_string("d%d.env", "doc_id").alias("path"),
        F.replace("text", F.lit(" token ="), F.lit("\n export token =")).alias("content"))
    return extract_assignments(d).select("file", "line", "name", "value")


def last_occurrences(spark, sf):
    path, content, _ = SOURCES["b1_extract_python"]
    twice = content + "{A}_URL = {n}\n"
    return last_occurrence(extract_assignments(sources(spark, sf, path, twice))).select("file", "scope", "name", "value", "line")


def brace_scopes(spark, sf):
    content = "fn a{n}() {\n fn {b}()\n {\n  x\n }\n y; fn {a};\n { {\n } }\n}\nz {\n}\nfn w() { }\nend"
    return brace_scope(sources(spark, sf, "x{n}", content), r"^\s*fn (\w+)").select("file", "line", "scope")


SCOPES = ["", "a{n}", "a{n}", "{b}", "{b}", "a{n}", "a{n}", "a{n}", "a{n}", "", "", "", ""]


# ------------------------------------------------------------------- corpus

def _paths(spark, sf):
    a = D.assignments(spark, sf)
    seq = F.col("seq")
    head = F.when(seq % 9 == 0, "node_modules/").when(seq % 9 == 1, "src/dist/").when(seq % 9 == 2, "gen/api/").when(
        seq % 9 == 3, "x/gen/api/").when(seq % 9 == 4, "x/cache/").otherwise("")
    return a.select("project", "seq", F.concat(head, F.col("file"), F.when(seq % 11 == 0, "/dist").otherwise("")).alias("path"),
                    F.length("value").alias("length"))


PATHS = """paths AS (SELECT project, seq, CASE seq % 9 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/dist/' WHEN 2 THEN 'gen/api/'
  WHEN 3 THEN 'x/gen/api/' WHEN 4 THEN 'x/cache/' ELSE '' END || file || CASE WHEN seq % 11 = 0 THEN '/dist' ELSE '' END AS path,
  len(value) AS length FROM assignments)"""


def exclude_dirs(spark, sf):
    return C.exclude_dirs(_paths(spark, sf), ["node_modules", "dist"]).select("project", "seq", "path")


def ignore_prune(spark, sf):
    p = _paths(spark, sf)
    lines = F.array(*[F.lit(x) for x in ("# note", "", " /gen/api/ ", "cache/", "!keep", "*.log")])
    rules = C.ignore_rules(p.filter("project like '%1'").select("project", F.explode(lines).alias("line")).distinct())
    return C.ignore_prune(p, rules).select("project", "seq")


def size_filter(spark, sf):
    d = D.table(spark, sf, "documents").withColumn("length", F.octet_length("text"))
    return C.size_filter(d, 8).select("doc_id", "length")


def path_safety(spark, sf):
    p = _paths(spark, sf)
    seq = F.col("seq")
    files = p.select("seq", F.when(seq % 13 == 0, "bad id").when(seq % 13 == 1, "a..b").otherwise(F.regexp_replace("project", "#", "-")).alias("project"),
                     F.when(seq % 5 == 0, F.concat(F.lit("\\x\\"), F.col("path"))).when(seq % 5 == 1, F.concat(F.lit("a/../"), F.col("path")))
                     .when(seq % 5 == 2, F.lit("/")).otherwise(F.col("path")).alias("path"), F.lit("").alias("content"))
    ok, bad = C.path_safety(files)
    return ok.select("seq", "path", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("seq", "path", "reason"))


def languages(spark, sf):
    files = D.assignments(spark, sf).select("file").distinct()
    pairs = files.select(F.regexp_extract("file", r"(\.[^./]*)$", 1).alias("ext"), N.lang_of_path(F.col("file")).alias("lang"))
    return C.supported_languages(pairs.distinct()).select("lang", F.array_join("extensions", " ").alias("extensions"))


def corpus_scan(spark, sf):
    """Write the assignments as .env files, scan the folder, extract."""
    root = f"{stage_dir(spark)}/corpus-{uuid.uuid4().hex}"
    a = D.assignments(spark, sf)
    line = F.concat("name", F.lit("="), F.col("seq").cast("string"))
    (a.select("project", line.alias("line")).write.partitionBy("project").option("extension", "env").option("quote", "")
     .option("maxRecordsPerFile", 10000).csv(root))
    rows = extract_assignments(C.corpus_scan(spark, [root]))
    brand = F.replace(F.regexp_extract("file", "project=([^/]*)/", 1), F.lit("%23"), F.lit("#"))
    return rows.select(brand.alias("brand"), "name", "value", "lang")


def analyze(spark, sf):
    """Scan, link and count one env file per part, nothing kept."""
    path, content, _ = SOURCES["b5_extract_env"]
    found = A.analyze(sources(spark, sf, path, content).withColumn("project", F.regexp_replace("project", "#", "-")), "low")
    return found["counts"].unionByName(found["languages"].select("project", F.col("lang").alias("level"), F.col("rows").alias("pairs")))


def _started(spark, sf):
    """A registry of env files and a later corpus: some files gone, some changed, some as they were."""
    n = F.col("p_partkey")
    p = D.table(spark, sf, "part").select(F.col("p_brand").alias("project"), F.format_string("ops/%d.env", n).alias("path"),
                                          F.concat(F.lit("V=1\nW="), n.cast("string")).alias("content"), n.alias("k"))
    registry = A.baseline(p, "2024-01-01")
    later = p.filter("k % 7 <> 0").withColumn("content", F.when(F.col("k") % 3 == 0, "V=2\n").otherwise(F.col("content"))).withColumn(
        "modificationTime", F.when(F.col("k") % 2 == 0, F.lit("2024-02-01").cast("timestamp")).otherwise(F.lit("2023-01-01").cast("timestamp")))
    return registry, later


def session_start(spark, sf):
    out = A.session_start(*_started(spark, sf), "2024-03-01")["registry"]
    return out.select("project", "file", "name", "status", "repo_value_preview")


def session_events(spark, sf):
    out = A.session_start(*_started(spark, sf), "2024-03-01", session="s9")
    return out["events"].select("project", "session_id", "action", "name", "file")


def session_recall(spark, sf):
    text = A.session_start(*_started(spark, sf), "2024-03-01")["recall"]
    return text.select("project", F.regexp_extract("text", r"Tracked: (\d+)", 1).alias("tracked"),
                       F.contains("text", F.lit("(drifted)")).alias("drifted"), F.contains("text", F.lit("(missing)")).alias("missing"))


def reconcile_totals_pass(spark, sf):
    return A.reconcile_pass(*_started(spark, sf), "2024-03-01")["totals"]


def scan_counts_pass(spark, sf):
    return A.scan_pass(*_started(spark, sf), "2024-03-01")["counts"]


SESSION_START = """WITH p AS (SELECT p_brand AS project, p_partkey AS k FROM part),
f AS (SELECT *, 'ops/' || k::varchar || '.env' AS file FROM p),
o AS (SELECT *, true AS checked FROM f),
r AS (SELECT *, unnest(['V', 'W']) AS name, unnest(['1', k::varchar]) AS value FROM o)
SELECT project, file, name, CASE WHEN NOT checked THEN 'active' WHEN k % 7 = 0 THEN 'file_deleted'
    WHEN k % 2 = 0 AND k % 3 = 0 THEN CASE name WHEN 'V' THEN 'drifted' ELSE 'missing' END ELSE 'active' END AS status,
  CASE WHEN checked AND k % 7 <> 0 AND k % 2 = 0 AND k % 3 = 0 AND name = 'V' THEN '2' ELSE value END AS repo_value_preview FROM r"""


# ------------------------------------------------------------------- groups

def match_mounts(spark, sf):
    m = I.match_mounts(D.containers(spark, sf), D.repos(spark, sf))
    return m.select("container", "compose", "repo_id")


MATCHES = """matches AS (SELECT DISTINCT cname AS container, compose, repo_id FROM containers JOIN repos
  ON mount = path OR starts_with(mount, path || '/') OR starts_with(path, mount || '/'))"""
SUGGEST = f"""{D.REPOS}, {MATCHES}, keyed AS (SELECT *, CASE WHEN compose IS NOT NULL THEN 'compose:' || compose ELSE 'container:' || container END AS key FROM matches),
suggestions AS (SELECT key, max(compose) AS compose, list_sort(list_distinct(list(repo_id))) AS repo_ids,
  list_sort(list_distinct(list(container))) AS containers FROM keyed GROUP BY key HAVING count(DISTINCT repo_id) >= 2),
grouped AS (SELECT r_name, list_sort(list(repo_id)) AS repo_ids FROM repos WHERE n_nationkey % 5 <> 0 GROUP BY r_name)"""


def _suggestions(spark, sf):
    return I.suggest_groups(I.match_mounts(D.containers(spark, sf), D.repos(spark, sf)), D.groups(spark, sf))


def suggest_groups(spark, sf):
    return _suggestions(spark, sf).select("name", F.array_join("repo_ids", ",").alias("repo_ids"), F.size("containers").alias("containers"), "already_grouped")


def confirm(spark, sf):
    return I.confirm(_suggestions(spark, sf), D.groups(spark, sf)).select("name", F.array_join("repo_ids", ",").alias("repo_ids"))


def group_rollup(spark, sf):
    """Registry counts of each project rolled up over the groups of its repo."""
    r = D.registry(spark, sf)
    number = (F.regexp_extract("project", r"(\d+)$", 1).cast("int") % 25).cast("string")
    counts = G.origin_status_counts(r.withColumn("project", number))
    return G.group_rollup(counts, D.groups(spark, sf), D.repos(spark, sf))


# ------------------------------------------------------------------ streams

def _change_stream(spark, sf):
    path = f"{stage_dir(spark)}/changes-{uuid.uuid4().hex}"
    changes = D.changes(spark, sf).select(*CHANGE_EVENTS.fieldNames())
    changes.write.parquet(path)
    return spark.readStream.schema(CHANGE_EVENTS).parquet(path)


def _captured(spark, sf):
    out = f"{stage_dir(spark)}/captured-{uuid.uuid4().hex}"
    query = J.capture_stream(_change_stream(spark, sf), out, f"{out}/checkpoint")
    query.awaitTermination()
    return out


def capture_stream(spark, sf):
    """Change events through the stateful capture: newest state of each row."""
    return J.captured_state(spark, _captured(spark, sf)).select(
        "project", "file", "name", "status", "first_session", "last_session", "value_preview", "repo_value_preview")


def capture_events(spark, sf):
    log = spark.read.json(f"{_captured(spark, sf)}/events")
    return log.groupBy("project", "action").agg(F.count(F.lit(1)).alias("events"))


def long_values(spark, sf):
    """One project per part, whose second value names the first row beyond the length of a preview."""
    project = F.format_string("p%d", "p_partkey")
    text = F.concat(F.lit('FERRY_BASE_URL = "https://quay/'), F.col("p_partkey").cast("string"), F.lit('"\nferry_url = join("'),
                    F.repeat(F.lit("x"), F.pmod(F.col("p_partkey"), F.lit(300)).cast("int")), F.lit('", FERRY_BASE_URL)\n'))
    files = D.table(spark, sf, "part").select(project.alias("project"), F.lit("src/quay.py").alias("path"), text.alias("content"))
    return A.analyze(files, "low")["pairs"].select("project", F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"),
                                                   "level", "reason", F.col("b.value").alias("value_b"))


def event_time(spark, sf):
    """Change events in two deliveries: the second brings every eleventh event for the first time, often too late,
    and every seventh of the others again.  What the capture did, and the events it kept apart, per project."""
    inbox, out = (f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}" for name in ("deliveries", "captured"))
    changes = D.changes(spark, sf).select(*CHANGE_EVENTS.fieldNames())
    held_back = F.col("event_id") % 11 == 0
    for part in (changes.filter(~held_back), changes.filter(held_back | (F.col("event_id") % 7 == 0))):
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(CHANGE_EVENTS).parquet(inbox)
        J.capture_stream(stream, out, f"{out}/checkpoint", delay="3650 days").awaitTermination()
    late = spark.read.parquet(f"{out}/late").select("project", F.lit("late").alias("action"))
    return spark.read.json(f"{out}/events").select("project", "action").union(late).groupBy("project", "action").agg(
        F.count(F.lit(1)).alias("events"))


def tail(spark, sf):
    """The registry written in two versions and followed as a stream."""
    path = f"{stage_dir(spark)}/tail-{uuid.uuid4().hex}"
    r = D.registry(spark, sf).drop("seq")
    for part in (r.filter("status = 'active'"), r.filter("status <> 'active'")):
        part.write.mode("append").parquet(path)
    seen = J.tail(spark, path, maxFilesPerTrigger=4)
    name = f"tail_{uuid.uuid4().hex}"
    query = (seen.groupBy("project", "status").count().writeStream.outputMode("complete").format("memory")
             .queryName(name).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.table(name)


def change_feed(spark, sf):
    """Two versions of the registry, and what the stream of their changes brings."""
    path = f"{stage_dir(spark)}/feed-{uuid.uuid4().hex}"
    r = D.registry(spark, sf)
    seq = F.col("seq")
    newer = r.filter(seq % 5 != 0).withColumn("status", F.when(seq % 3 == 0, "drifted").otherwise(F.col("status")))
    for version, rows in enumerate((r.filter(seq % 7 != 0), newer), 1):
        J5.publish(rows, path, version)
    sink = J5.tail_changes(spark, path).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
    sink.trigger(availableNow=True).start(f"{path}/seen").awaitTermination()
    return spark.read.parquet(f"{path}/seen").groupBy("project", "version", "op").agg(F.count(F.lit(1)).alias("rows"))


CAPTURED = f"""WITH {D.EVENT_LOG}, {D.CHANGES},
ok AS (SELECT * FROM changes WHERE tool_name <> 'Read' AND path NOT IN ('', '/elsewhere/a.py', 'dist', 'notes.txt')),
held AS (
  SELECT project, path AS file, event_id, ts, session_id, name, cents::varchar AS value, tool_name = 'Write' OR event_id % 2 = 0 AS claimed FROM ok
  UNION ALL SELECT project, path, event_id, ts, session_id, 'HUMAN_' || name, '1', tool_name = 'Write' FROM ok WHERE event_id % 5 = 0),
last_event AS (SELECT project, path AS file, max((ts, event_id)) AS last_at FROM ok GROUP BY ALL),
claims AS (SELECT project, file, name, min((ts, event_id)) AS first_at, max((ts, event_id)) AS claim_at, arg_min(session_id, (ts, event_id)) AS first_session,
  arg_max(session_id, (ts, event_id)) AS last_session, arg_max(value, (ts, event_id)) AS value FROM held WHERE claimed GROUP BY ALL),
seen AS (SELECT c.project, c.file, c.name, max((h.ts, h.event_id)) AS seen_at, arg_max(h.value, (h.ts, h.event_id)) AS now_value
  FROM claims c JOIN held h ON (c.project, c.file, c.name) = (h.project, h.file, h.name) AND (h.ts, h.event_id) >= c.first_at GROUP BY ALL)
"""

EVENT_TIME = f"""WITH {D.EVENT_LOG}, {D.CHANGES},
ok AS (SELECT *, (CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END, ts, event_id) AS turn, event_id % 11 = 0 AS held_back FROM changes
  WHERE tool_name <> 'Read' AND path NOT IN ('', '/elsewhere/a.py', 'dist', 'notes.txt')),
held AS (
  SELECT project, path AS file, turn, held_back, name, tool_name = 'Write' OR event_id % 2 = 0 AS claimed FROM ok
  UNION ALL SELECT project, path, turn, held_back, 'HUMAN_' || name, tool_name = 'Write' FROM ok WHERE event_id % 5 = 0),
first_claims AS (SELECT project, file, name, min(turn) AS first_at FROM held WHERE claimed AND NOT held_back GROUP BY ALL),
first_steps AS (SELECT c.project, c.file, c.name, o.turn, o.ts, h.name IS NOT NULL AS present FROM first_claims c
  JOIN ok o ON (o.project, o.path) = (c.project, c.file) AND o.turn >= c.first_at AND NOT o.held_back
  LEFT JOIN held h ON (h.project, h.file, h.name, h.turn) = (c.project, c.file, c.name, o.turn)),
first_touched AS (SELECT *, present OR lag(present) OVER (PARTITION BY project, file, name ORDER BY turn) AS touched FROM first_steps),
seen_until AS (SELECT project, file, max(ts) AS until FROM first_touched WHERE touched GROUP BY ALL),
too_late AS (SELECT o.turn, o.project FROM ok o JOIN seen_until s ON (s.project, s.file) = (o.project, o.path) WHERE held_back AND ts < until),
claims AS (SELECT project, file, name, min(turn) AS first_at, count(*) AS writes FROM held WHERE claimed AND turn NOT IN (SELECT turn FROM too_late) GROUP BY ALL),
step AS (SELECT c.project, c.file, c.name, o.turn, h.name IS NOT NULL AS present FROM claims c
  JOIN ok o ON (o.project, o.path) = (c.project, c.file) AND o.turn >= c.first_at AND o.turn NOT IN (SELECT turn FROM too_late)
  LEFT JOIN held h ON (h.project, h.file, h.name, h.turn) = (c.project, c.file, c.name, o.turn)),
gone AS (SELECT *, NOT present AND lag(present) OVER (PARTITION BY project, file, name ORDER BY turn) AS went FROM step)
SELECT project, 'added' AS action, count(*) AS events FROM claims GROUP BY ALL
UNION ALL SELECT project, 'updated', (sum(writes) - count(*))::bigint FROM claims GROUP BY ALL HAVING sum(writes) > count(*)
UNION ALL SELECT project, 'went_missing', count(*) FROM gone WHERE went GROUP BY ALL
UNION ALL SELECT project, 'late', count(*) FROM too_late GROUP BY ALL"""

ANALYZED = f"""WITH {PARTS}, registry AS (
  SELECT *, file || '|' || scope || '|' || name AS id, sha1(value) AS value_hash FROM (
    SELECT replace(project, '#', '-') AS project, 'ops/.env.p' || n AS file, '' AS scope,
      unnest([upper(a) || '_HOST', 'PORT.' || b, 'EMPTY']) AS name, unnest([b || '-' || n, n || ' # kept', '']) AS value,
      unnest([2, 3, 4]) AS line, 'env' AS lang, 'env' AS kind, NULL::varchar AS anno, 'active' AS status FROM parts)),
{FEATURES}, {ELIGIBLE}, {SCORED}
SELECT project, level, count(*) AS pairs FROM scored GROUP BY ALL
UNION ALL SELECT project, lang, count(*) FROM registry GROUP BY ALL"""

QUERIES = {
    **{name: (_extraction(path, content), _expected(path, rows)) for name, (path, content, rows) in SOURCES.items()},
    "b5_extract_texts": (extract_texts, """WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1)::int AS n FROM (
          SELECT doc_id, string_split_regex(replace(text, ' token =', chr(10) || ' export token ='), '\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS s FROM documents)),
        m AS (SELECT *, trim(line) AS t FROM l)
        SELECT 'd' || doc_id::varchar || '.env' AS file, n AS line, regexp_extract(t, '^(?:export\\s+)?([A-Za-z_][\\pL\\pM\\p{Nd}\\p{Pc}.]*)\\s*=\\s*(.*)$', 1) AS name,
          nullif(trim(regexp_extract(t, '^(?:export\\s+)?([A-Za-z_][\\pL\\pM\\p{Nd}\\p{Pc}.]*)\\s*=\\s*(.*)$', 2)), '') AS value
        FROM m WHERE regexp_matches(t, '^(?:export\\s+)?([A-Za-z_][\\pL\\pM\\p{Nd}\\p{Pc}.]*)\\s*=')"""),
    "b11_brace_scope": (brace_scopes, f"WITH {PARTS} " + " UNION ALL ".join(
        f"SELECT {_fill_sql('x{n}')} AS file, {i}::int AS line, {_fill_sql(s)} AS scope FROM parts" for i, s in enumerate(SCOPES, 1))),
    "b13_last_occurrence": (last_occurrences, "WITH e AS (" + _expected(SOURCES["b1_extract_python"][0], SOURCES["b1_extract_python"][2])
        + f" UNION ALL SELECT project, {_fill_sql('src/p{n}.py')}, {_fill_sql('{A}_URL')}, 12, '', 'assign', n, NULL FROM parts)"
        + " SELECT file, scope, name, value, line FROM e QUALIFY row_number() OVER (PARTITION BY file, scope, name ORDER BY line DESC) = 1"),
    "a1_corpus_scan": (corpus_scan, f"{REG} SELECT project AS brand, name, seq::varchar AS value, 'env' AS lang FROM assignments"),
    "a2_exclude_dirs": (exclude_dirs, f"{REG}, {PATHS} SELECT project, seq, path FROM paths WHERE seq % 9 NOT IN (0, 1)"),
    "a3_ignore_prune": (ignore_prune, f"{REG}, {PATHS} SELECT project, seq FROM paths WHERE NOT (project LIKE '%1' AND seq % 9 IN (2, 4))"),
    "a5_size_filter": (size_filter, "SELECT doc_id, strlen(text)::int AS length FROM documents WHERE strlen(text) <= 8192"),
    "a14_analyze": (analyze, ANALYZED),
    "f8_whole_values": (long_values, """WITH v AS (SELECT 'p' || p_partkey AS project,
          'join("' || repeat('x', (p_partkey % 300)::int) || '", FERRY_BASE_URL)' AS value FROM part)
        SELECT project, 'FERRY_BASE_URL' AS name_a, 'ferry_url' AS name_b, 'low' AS level, 'alias-derived' AS reason,
          CASE WHEN len(value) > 120 THEN value[:119] || '…' ELSE value END AS value_b FROM v"""),
    "a15_path_safety": (path_safety, f"""{REG}, {PATHS}, q AS (SELECT seq, CASE seq % 5 WHEN 0 THEN '\\x\\' || path WHEN 1 THEN 'a/../' || path WHEN 2 THEN '/' ELSE path END AS path FROM paths)
        SELECT seq, CASE WHEN seq % 13 IN (0, 1) THEN path WHEN seq % 5 = 0 THEN 'x/' || replace(path[4:], '\\', '/') ELSE path END AS path,
          CASE WHEN seq % 13 IN (0, 1) THEN 'invalid project id' WHEN seq % 5 IN (1, 2) THEN 'unsafe path' END AS reason FROM q"""),
    "g21_supported_languages": (languages, f"""{REG}, e AS (SELECT DISTINCT regexp_extract(file, '(\\.[^./]*)$', 1) AS ext, lang FROM assignments)
        SELECT lang, string_agg(ext, ' ' ORDER BY ext) AS extensions FROM e GROUP BY lang"""),
    "j4_session_start": (session_start, SESSION_START),
    "j4_session_events": (session_events, """WITH f AS (SELECT p_brand AS project, p_partkey AS k, 'ops/' || p_partkey::varchar || '.env' AS file FROM part)
        SELECT project, 's9' AS session_id, 'file_deleted' AS action, unnest(['V', 'W']) AS name, file FROM f WHERE k % 7 = 0
        UNION ALL SELECT project, 's9', unnest(['drifted', 'went_missing']), unnest(['V', 'W']), file FROM f WHERE k % 6 = 0 AND k % 7 <> 0"""),
    "j4_session_recall": (session_recall, """SELECT p_brand AS project, (2 * count(*))::varchar AS tracked,
        bool_or(p_partkey % 6 = 0 AND p_partkey % 7 <> 0) AS drifted, bool_or(p_partkey % 6 = 0 AND p_partkey % 7 <> 0) AS missing FROM part GROUP BY p_brand"""),
    "e14_reconcile_pass": (reconcile_totals_pass, """WITH f AS (SELECT p_brand AS project, p_partkey AS k FROM part)
        SELECT project, count(*) AS files, 2 * count(*) FILTER (WHERE k % 7 <> 0 AND k % 2 = 0) AS checked,
          2 * count(*) FILTER (WHERE k % 7 <> 0 AND k % 2 = 0 AND k % 3 <> 0) AS active, count(*) FILTER (WHERE k % 7 <> 0 AND k % 6 = 0) AS drifted,
          count(*) FILTER (WHERE k % 7 <> 0 AND k % 6 = 0) AS missing, 2 * count(*) FILTER (WHERE k % 7 = 0) AS file_deleted, 0::bigint AS moved,
          count(*) FILTER (WHERE k % 7 <> 0 AND k % 2 = 1) AS skipped_files FROM f GROUP BY project"""),
    "e5_scan_pass": (scan_counts_pass, """WITH f AS (SELECT p_brand AS project, p_partkey AS k FROM part), n AS (
          SELECT project, 'updated' AS action, sum(CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END)::bigint AS rows FROM f WHERE k % 7 <> 0 GROUP BY project
          UNION ALL SELECT project, 'pruned', sum(CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END)::bigint FROM f WHERE k % 7 = 0 OR k % 3 = 0 GROUP BY project)
        SELECT * FROM n"""),
    "i5_match_mounts": (match_mounts, f"WITH {D.REPOS}, {MATCHES} SELECT container, compose, repo_id FROM matches"),
    "i6_suggest_groups": (suggest_groups, f"""WITH {SUGGEST} SELECT coalesce(compose, 'container ' || containers[1]) AS name,
        array_to_string(repo_ids, ',') AS repo_ids, len(containers)::int AS containers, repo_ids IN (SELECT repo_ids FROM grouped) AS already_grouped FROM suggestions"""),
    "i7_confirm_suggestion": (confirm, f"""WITH {SUGGEST} SELECT r_name AS name, array_to_string(repo_ids, ',') AS repo_ids FROM grouped
        UNION ALL SELECT min(coalesce(compose, 'container ' || containers[1])), array_to_string(repo_ids, ',') FROM suggestions
        WHERE repo_ids NOT IN (SELECT repo_ids FROM grouped) GROUP BY repo_ids"""),
    "g9_group_rollup": (group_rollup, f"""WITH {D.ASSIGNMENTS}, {D.REPOS},
        c AS (SELECT (regexp_extract(project, '(\\d+)$', 1)::int % 25)::varchar AS repo_id, origin, status FROM registry),
        m AS (SELECT repo_id, CASE WHEN n_nationkey % 5 <> 0 THEN 'g-' || r_name ELSE 'standalone' END AS group_id FROM repos)
        SELECT group_id, count(DISTINCT m.repo_id) AS repos, count(c.repo_id) AS tracked, count(*) FILTER (WHERE origin = 'claude') AS claude,
          count(*) FILTER (WHERE origin = 'kilo') AS kilo, count(*) FILTER (WHERE origin = 'scan') AS scan,
          count(*) FILTER (WHERE status = 'drifted') AS drifted, count(*) FILTER (WHERE status = 'missing') AS missing,
          count(*) FILTER (WHERE status = 'file_deleted') AS file_deleted FROM m LEFT JOIN c USING (repo_id) GROUP BY group_id"""),
    "j1_capture_stream": (capture_stream, CAPTURED + """ SELECT project, file, name, CASE WHEN seen_at < last_at THEN 'missing'
          WHEN now_value = value THEN 'active' ELSE 'drifted' END AS status, first_session, last_session, value AS value_preview,
          now_value AS repo_value_preview FROM claims JOIN seen USING (project, file, name) JOIN last_event USING (project, file)"""),
    "j2_event_log_stream": (capture_events, CAPTURED + """,
        step AS (SELECT c.project, c.file, c.name, o.ts, o.event_id, h.name IS NOT NULL AS present FROM claims c
          JOIN ok o ON (o.project, o.path) = (c.project, c.file) AND (o.ts, o.event_id) >= c.first_at
          LEFT JOIN held h ON (h.project, h.file, h.name, h.event_id) = (c.project, c.file, c.name, o.event_id)),
        gone AS (SELECT *, NOT present AND lag(present) OVER (PARTITION BY project, file, name ORDER BY ts, event_id) AS went FROM step)
        SELECT project, 'added' AS action, count(*) AS events FROM claims GROUP BY ALL
        UNION ALL SELECT project, 'updated', n FROM (SELECT h.project, count(*) - (SELECT count(*) FROM claims c WHERE c.project = h.project) AS n
          FROM held h WHERE claimed GROUP BY h.project) WHERE n > 0
        UNION ALL SELECT project, 'went_missing', count(*) FROM gone WHERE went GROUP BY ALL"""),
    "j6_event_time": (event_time, EVENT_TIME),
    "j5_change_feed": (change_feed, f"""{REG}, one AS (SELECT * FROM registry WHERE seq % 7 <> 0),
        two AS (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN 'drifted' ELSE status END AS status) FROM registry WHERE seq % 5 <> 0),
        diff AS (SELECT coalesce(o.project, t.project) AS project, CASE WHEN o.file IS NULL THEN 'insert' WHEN t.file IS NULL THEN 'delete'
            WHEN o.status <> t.status THEN 'update' END AS op
          FROM one o FULL JOIN two t USING (project, file, scope, name))
        SELECT project, 2 AS version, op, count(*) AS rows FROM diff WHERE op IS NOT NULL GROUP BY ALL
        UNION ALL SELECT project, 1, 'insert', count(*) FROM one GROUP BY project"""),
    "j5_registry_tail": (tail, f"{REG} SELECT project, status, count(*) AS count FROM registry GROUP BY ALL"),
}
