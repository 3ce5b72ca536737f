"""Queries over the keyed registry and the event log, with their SQL twins."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..operators import registry as R
from ..operators.extract import last_occurrence
from ..plans import reports as G
from ..plans import views as H
from ..schema import KEY, REGISTRY
from ..sources import tables as T
from ..streaming import capture as J
from . import derive as D

REG = f"WITH {D.ASSIGNMENTS}"
SNAP = f"WITH {D.ASSIGNMENTS}, {D.SNAPSHOTS}"
EV = f"WITH {D.EVENT_LOG}"
CH = f"WITH {D.EVENT_LOG}, {D.CHANGES}"
NOW = D.AS_OF


# --------------------------------------------------------- upsert and latest

def _lineitem_writes(spark, sf):
    """Every line item is one write of the key (order, line number)."""
    li = D.table(spark, sf, "lineitem")
    value = F.format_string("%d/%d", F.round("l_extendedprice").cast("bigint"), F.col("l_partkey"))
    return li.select(
        F.format_string("o%d", F.col("l_orderkey") % 16).alias("project"),
        F.col("l_orderkey").cast("string").alias("file"), F.lit("").alias("scope"),
        F.col("l_linenumber").cast("string").alias("name"), F.lit("python").alias("lang"), F.lit("assign").alias("kind"),
        F.col("l_linenumber").alias("line"), value.alias("value_preview"), F.sha1(value).alias("value_hash"),
        F.lit(False).alias("redacted"), F.lit(None).cast("string").alias("anno"),
        F.col("l_suppkey").cast("string").alias("session"),
        F.when(F.col("l_returnflag") == "N", "scan").otherwise("claude").alias("origin"),
        F.col("l_shipdate").alias("ts"),
        F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"))


def upsert_lineitem(spark, sf):
    """First half of the writes makes the registry, the rest is upserted."""
    w = _lineitem_writes(spark, sf)
    cut = F.col("ts") < "1998-01-01"
    empty = spark.createDataFrame([], REGISTRY)
    before = R.upsert(empty, w.filter(cut)).drop("action")
    after = R.upsert(before, w.filter(~cut))
    return after.select("project", "file", "name", "value_preview", "first_session", "last_session",
                        "first_seen_at", "last_written_at", "origin", "action")


LINEITEM = """
w AS (SELECT 'o' || (l_orderkey % 16)::varchar AS project, l_orderkey::varchar AS file, l_linenumber::varchar AS name,
  round(l_extendedprice)::bigint::varchar || '/' || l_partkey::varchar AS value, l_suppkey::varchar AS session,
  CASE WHEN l_returnflag = 'N' THEN 'scan' ELSE 'claude' END AS origin, l_shipdate AS ts,
  {'ts': l_shipdate, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'q': l_quantity, 'p': l_extendedprice} AS seen, l_shipdate < '1998-01-01' AS early FROM lineitem),
nth AS (SELECT *, row_number() OVER (PARTITION BY project, file, name, early
  ORDER BY ts, seen.l_partkey, seen.l_suppkey, seen.q, seen.p) AS n FROM w),
folded AS (
  SELECT project, file, name, early, arg_max(value, n) AS value, arg_min(session, n) AS first_session,
    arg_max(session, n) AS session, min(ts) AS first_ts, max(ts) AS ts, arg_min(origin, n) AS created,
    arg_max(origin, n) FILTER (WHERE origin <> 'scan') AS agent FROM nth GROUP BY project, file, name, early),
old AS (SELECT * FROM folded WHERE early), new AS (SELECT * FROM folded WHERE NOT early)
"""


def latest_lineitem(spark, sf):
    """Newest write per key."""
    w = _lineitem_writes(spark, sf).withColumn("ord", F.struct("ts", "seq"))
    return last_occurrence(w).select("project", "file", "name", "value_preview", "ts")


def upsert_registry(spark, sf):
    base, found, _ = D.snapshots(spark, sf)
    out = R.upsert(base, found, as_of=NOW, origin="claude", session="s-new")
    return out.select(*KEY, "value_preview", "status", "first_session", "last_session", "origin", "action")


def origin_claim(spark, sf):
    """A scan re-writes every found key: agents keep theirs."""
    base, found, _ = D.snapshots(spark, sf)
    return R.upsert(base, found, as_of=NOW, origin="scan", session="scan").select(*KEY, "origin", "action")


def refresh(spark, sf):
    base, found, _ = D.snapshots(spark, sf)
    return R.refresh(base, found, NOW).select(*KEY, "status", "repo_value_preview", "last_verified_at")


def mark_missing(spark, sf):
    base, found, files = D.snapshots(spark, sf)
    return R.mark_missing(base, found, files, NOW).select(*KEY, "status")


def scan_actions(spark, sf):
    base, found, files = D.snapshots(spark, sf)
    return R.scan_actions(base, found, files, NOW).select(
        *KEY, "status", "origin", "value_preview", "last_session", "action")


def scan_counts(spark, sf):
    base, found, files = D.snapshots(spark, sf)
    return R.scan(base, found, files, NOW)[1]


def prune(spark, sf):
    base, found, files = D.snapshots(spark, sf)
    return R.prune(base, found, files).select(*KEY, "origin")


def _reconciled(spark, sf):
    base, found, files = D.snapshots(spark, sf)
    return R.reconcile(base, found, files, NOW)


def reconcile(spark, sf):
    return _reconciled(spark, sf).select(*KEY, "status", "old_status", "old_scope", "moved", "outcome", "repo_value_preview")


def reconcile_totals(spark, sf):
    return R.reconcile_totals(_reconciled(spark, sf))


def transition_events(spark, sf):
    return R.transition_events(_reconciled(spark, sf), "reconcile", NOW).select(
        "project", "action", "name", "file", "scope", "detail")


RECONCILED = """
occurrences AS (SELECT project, file, name, count(*) AS n, any_value(found) AS one FROM found GROUP BY ALL),
matched AS (
  SELECT b.*, f.value AS exact_value, o.one AS only_one, f.value IS NULL AND o.n = 1 AS lone,
    x.file IS NOT NULL AS here
  FROM baseline b LEFT JOIN found_last f ON (b.project, b.file, b.scope, b.name) = (f.project, f.file, f.scope, f.name)
  LEFT JOIN occurrences o ON (b.project, b.file, b.name) = (o.project, o.file, o.name)
  LEFT JOIN found_files x ON (b.project, b.file) = (x.project, x.file)),
movers AS (
  SELECT *, lone AND NOT EXISTS (SELECT 1 FROM baseline c WHERE (c.project, c.file, c.name) = (m.project, m.file, m.name)
      AND c.scope = m.only_one.scope)
    AND scope = min(CASE WHEN lone THEN scope END) OVER (PARTITION BY project, file, name) AS moves FROM matched m),
outcomes AS (
  SELECT *, CASE WHEN NOT here THEN 'file_deleted' WHEN exact_value IS NULL AND NOT coalesce(moves, false) THEN 'missing'
      WHEN coalesce(exact_value, only_one.value) = value THEN 'active' ELSE 'drifted' END AS outcome FROM movers),
result AS (
  SELECT project, file, CASE WHEN moved THEN only_one.scope ELSE scope END AS scope, name,
    CASE WHEN outcome IN ('active', 'drifted') THEN outcome
      WHEN outcome = 'missing' AND status NOT IN ('missing', 'file_deleted') THEN outcome
      WHEN outcome = 'file_deleted' THEN outcome ELSE status END AS status,
    status AS old_status, scope AS old_scope, moved, outcome,
    CASE WHEN outcome IN ('active', 'drifted') THEN coalesce(exact_value, only_one.value) ELSE now_value END AS repo_value_preview
  FROM (SELECT *, coalesce(moves, false) AND here AND exact_value IS NULL AS moved FROM outcomes))
"""
RES = f"{SNAP}, {RECONCILED}"


def _line_snapshots(spark, sf):
    """Newest line item per key against a later state of the same orders."""
    w = _lineitem_writes(spark, sf).withColumn("ord", F.struct("ts", "seq"))
    rows = last_occurrence(w)
    base = rows.select(
        *KEY, "lang", "kind", "line", "value_preview", "value_hash", "redacted", "anno",
        F.col("value_preview").alias("repo_value_preview"), F.col("value_hash").alias("repo_value_hash"),
        F.col("line").alias("repo_line"), F.lit("active").alias("status"), F.col("session").alias("first_session"),
        F.col("session").alias("last_session"), F.col("ts").cast("timestamp").alias("first_seen_at"),
        F.col("ts").cast("timestamp").alias("last_written_at"), F.col("ts").cast("timestamp").alias("last_verified_at"),
        "origin", F.lit(None).cast("string").alias("note"))
    order = F.col("file").cast("bigint")
    now = rows.filter((order % 29 != 0) & (F.col("seq.l_partkey") % 17 != 0))
    value = F.when(F.col("seq.l_suppkey") % 19 == 0, "changed").otherwise(F.col("value_preview"))
    found = now.select("project", "file", F.when(F.col("line") == 7, "moved").otherwise(F.col("scope")).alias("scope"), "name",
                       "line", value.alias("value_preview"), F.sha1(value).alias("value_hash"), "ord")
    files = rows.filter(order % 29 != 0).select("project", "file").distinct()
    return base, found, files


def reconcile_lineitem(spark, sf):
    out = R.reconcile(*_line_snapshots(spark, sf), NOW)
    return out.select("project", "file", "scope", "name", "status", "moved", "repo_value_preview")


def changed_files(spark, sf):
    r = D.registry(spark, sf)
    minute = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0, cast(m as int))")
    meta = r.groupBy("project", "file").agg((F.max("seq") - F.min("line") % 3 + 1).alias("m")).select(
        "project", F.col("file").alias("path"), minute.alias("modificationTime"))
    return R.changed_files(r, meta)


def tracked_files(spark, sf):
    return R.tracked_files(D.registry(spark, sf), 40)


def accept(spark, sf):
    return R.accept_drift(D.registry(spark, sf), NOW, pattern="MAX_*", file="mod").select(
        *KEY, "value_preview", "status", "accepted")


def annotate(spark, sf):
    return R.annotate(D.registry(spark, sf), "MAX_GEAR", "keep", "mod1").filter("annotated").select(*KEY, "note")


# ------------------------------------------------------------- change events

def attribute(spark, sf):
    ch = D.changes(spark, sf)
    rows = ch.select("project", "event_id", F.explode(F.array("name", F.concat(F.lit("HUMAN_"), F.col("name")))).alias("name"))
    return R.attribute(rows, ch).select("project", "event_id", "name", "attributed")


def namespaced(spark, sf):
    ch = D.changes(spark, sf).withColumn("session_id", F.when(F.col("event_id") % 7 == 0, F.concat(
        F.lit("kilo:"), F.col("session_id"))).otherwise(F.col("session_id")))
    return R.namespace_sessions(ch).select("event_id", "session_id", "origin")


def validated(spark, sf):
    return R.validate_changes(D.changes(spark, sf)).select("event_id", "file", "reason")


def capture_summary(spark, sf):
    """Capture of Write events as a batch: per event, what its file's rows do."""
    ch = R.validate_changes(D.changes(spark, sf)).filter("reason is null and tool_name = 'Write'")
    first = F.row_number().over(Window.partitionBy("project", "file", "name").orderBy("ts", "event_id")) == 1
    acts = ch.select("project", "event_id", F.when(first, "added").otherwise("updated").alias("action"))
    return R.capture_summary(acts)


def event_roundtrip(spark, sf):
    """Append the audit log as JSON lines and read it back."""
    from ..staging import stage_dir
    import uuid
    path = f"{stage_dir(spark)}/events-{uuid.uuid4().hex}"
    T.append_events(D.event_log(spark, sf), path)
    return T.read_events(spark, path).groupBy("project", "action").agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def registry_roundtrip(spark, sf):
    """Write the registry by project, replace some projects, read it back."""
    from ..staging import stage_dir
    import uuid
    path = f"{stage_dir(spark)}/registry-{uuid.uuid4().hex}"
    r = D.registry(spark, sf)
    T.write_registry(r, path)
    T.write_registry(r.filter("project like '%1' and scope = ''"), path)
    return T.read_registry(spark, path).select(*KEY, "value_hash", "status")


def session_summary(spark, sf):
    return G.session_summary(D.event_log(spark, sf))


def activity(spark, sf):
    return G.activity(D.event_log(spark, sf)).select("project", "event_id", "session", "action", "name")


def debounce(spark, sf):
    """Bursts per user with a two-hour gap."""
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("project"), "ts")
    return J.debounce(e, "2 hours")


# ----------------------------------------------------------- reviews, settings

def _ledgers(spark, sf, swapped=False):
    """One JSON map of two verdicts per assignment, with untidy pair keys; swapped: and a later one for each."""
    def turned(other):
        return F.concat(F.lit(f"{other}.py||"), F.col("seq").cast("string"), F.lit("||"), "file", F.lit("||"), "name")
    def key(other):
        return F.concat(F.replace("file", F.lit("/"), F.lit("\\")), F.lit("| |"), F.col("name"), F.lit(f"||{other}.py||"),
                        F.col("seq").cast("string"))
    verdict = F.struct(F.when(F.col("seq") % 2 == 0, "duplicate").otherwise("not_duplicate").alias("verdict"),
                       F.lit("n").alias("note"), F.col("at").alias("ts"))
    later = F.struct(F.lit("merged").alias("verdict"), F.lit("n").alias("note"), F.expr("at + interval 1 day").alias("ts"))
    more = [turned("a"), later, turned("z"), later] if swapped else []
    return D.assignments(spark, sf).select("project", F.to_json(
        F.create_map(key("a"), verdict, key("z"), verdict, *more)).alias("ledger"))


def reviews_read(spark, sf):
    return T.explode_reviews(_ledgers(spark, sf)).select("project", "pair_key", "verdict", "ts")


def swapped_reviews(spark, sf):
    """Ledgers that hold every pair twice, the second time with swapped sides and a later verdict."""
    return T.explode_reviews(_ledgers(spark, sf, swapped=True)).select("project", "pair_key", "verdict", "ts")


def review_upsert(spark, sf):
    old = T.explode_reviews(_ledgers(spark, sf))
    new = old.filter("length(pair_key) % 2 = 0").withColumn("verdict", F.lit("merged")).withColumn(
        "ts", F.lit(NOW).cast("timestamp")).withColumn("pair_key", F.replace("pair_key", F.lit("/"), F.lit("\\")))
    return T.upsert_reviews(old, new).select("project", "pair_key", "verdict")


LEDGER = """
ledger AS (SELECT project, file || '||' || name AS a, unnest(['a.py||', 'z.py||']) || seq::varchar AS b, seen AS ts,
  CASE WHEN seq % 2 = 0 THEN 'duplicate' ELSE 'not_duplicate' END AS verdict FROM assignments),
review_rows AS (SELECT project, least(a, b) || '||' || greatest(a, b) AS pair_key, verdict, ts FROM ledger)
"""


def settings(spark, sf):
    c = D.table(spark, sf, "customer")
    project = F.format_string("c%d", F.col("c_nationkey"))
    over = c.filter("c_custkey % 10 = 0").select(project.alias("project"), F.col("c_custkey")).groupBy("project").agg(
        F.max("c_custkey").cast("string").alias("value")).select("project", F.lit("preview_len").alias("key"), "value")
    out = T.project_settings(c.select(project.alias("project")), over)
    return out.filter(F.col("key").isin("preview_len", "max_file_kb"))


def ignored_names(spark, sf):
    a = D.assignments(spark, sf)
    return T.add_ignored_names(a.filter("origin = 'scan'").select("project", "name"),
                               a.filter("lang = 'python'").select("project", F.concat(F.lit(" "), F.col("name"), F.lit(" ")).alias("name")))


def export_md(spark, sf):
    return T.export(D.registry(spark, sf), "md")


def export_json(spark, sf):
    rows = T.export(D.registry(spark, sf), "json")
    return rows.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in [*KEY, "value_hash", "repo_line"]])


# ------------------------------------------------------------------- reports

def stats(spark, sf):
    s = G.stats(D.registry(spark, sf))

    def text(m):
        return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(
            e["key"], F.lit("="), e["value"].cast("string"))), ",")

    return s.select("project", "total", "files", "sessions", text("by_status").alias("by_status"), text("by_lang").alias("by_lang"))


def lang_counts(spark, sf):
    return G.lang_counts(D.registry(spark, sf))


def origin_status(spark, sf):
    return G.origin_status_counts(D.registry(spark, sf))


def project_list(spark, sf):
    return G.project_list(D.registry(spark, sf))


def recall(spark, sf):
    return G.recall(D.registry(spark, sf))


def recent_pool(spark, sf):
    return G.recent_pool(D.registry(spark, sf)).select(*KEY)


def query(spark, sf):
    return H.query(D.registry(spark, sf), pattern="max_*", status="active", file="mod", lang="python").select(*KEY)


def paged(spark, sf):
    r = D.registry(spark, sf)
    return H.page(r.select(*KEY, "last_written_at"), [F.desc("last_written_at"), *[F.col(c) for c in KEY]], 3, 50)


def scope_depths(spark, sf):
    a = D.assignments(spark, sf)
    scope = F.when(F.col("seq") % 3 == 0, "").when(F.col("seq") % 3 == 1, "A").otherwise("A.b.c")
    return a.select("seq", N.scope_depth(scope).alias("depth"), X.prefix(F.col("last_session"), 2).alias("short"))


NEWEST = "seen DESC, project, file, scope, name"
QUERIES = {
    "e1_upsert_lineitem": (upsert_lineitem, f"""WITH {LINEITEM}
        SELECT coalesce(n.project, o.project) AS project, coalesce(n.file, o.file) AS file, coalesce(n.name, o.name) AS name,
          coalesce(n.value, o.value) AS value_preview, coalesce(o.first_session, n.first_session) AS first_session,
          coalesce(n.session, o.session) AS last_session, coalesce(o.first_ts, n.first_ts) AS first_seen_at,
          coalesce(n.ts, o.ts) AS last_written_at,
          CASE WHEN o.file IS NULL THEN coalesce(n.agent, n.created) ELSE coalesce(n.agent, o.agent, o.created) END AS origin,
          CASE WHEN n.file IS NULL THEN 'kept' WHEN o.file IS NULL THEN 'added' ELSE 'updated' END AS action
        FROM old o FULL JOIN new n USING (project, file, name)"""),
    "b13_last_occurrence_lineitem": (latest_lineitem, f"""WITH {LINEITEM} SELECT project, file, name, value AS value_preview, ts FROM w
        QUALIFY row_number() OVER (PARTITION BY project, file, name ORDER BY seen DESC) = 1"""),
    "e1_upsert_registry": (upsert_registry, f"""{SNAP} SELECT coalesce(f.project, b.project) AS project, coalesce(f.file, b.file) AS file,
          coalesce(f.scope, b.scope) AS scope, coalesce(f.name, b.name) AS name, coalesce(f.value, b.value) AS value_preview,
          CASE WHEN f.file IS NULL THEN b.status ELSE 'active' END AS status, coalesce(b.first_session, 's-new') AS first_session,
          CASE WHEN f.file IS NULL THEN b.last_session ELSE 's-new' END AS last_session,
          CASE WHEN f.file IS NULL THEN b.origin ELSE 'claude' END AS origin,
          CASE WHEN f.file IS NULL THEN 'kept' WHEN b.file IS NULL THEN 'added' ELSE 'updated' END AS action
        FROM baseline b FULL JOIN found_last f USING (project, file, scope, name)"""),
    "e17_origin_claim": (origin_claim, f"""{SNAP} SELECT project, file, scope, name, coalesce(b.origin, 'scan') AS origin,
          CASE WHEN f.value IS NULL THEN 'kept' WHEN b.value IS NULL THEN 'added' ELSE 'updated' END AS action
        FROM baseline b FULL JOIN found_last f USING (project, file, scope, name)"""),
    "e3_refresh": (refresh, f"""{SNAP} SELECT project, file, scope, name,
          CASE WHEN f.value IS NULL THEN b.status WHEN f.value = b.value THEN 'active' ELSE 'drifted' END AS status,
          coalesce(f.value, b.now_value) AS repo_value_preview,
          CASE WHEN f.value IS NULL THEN b.seen ELSE timestamp '{NOW}' END AS last_verified_at
        FROM baseline b LEFT JOIN found_last f USING (project, file, scope, name)"""),
    "e4_mark_missing": (mark_missing, f"""{SNAP} SELECT project, file, scope, name, CASE WHEN f.value IS NULL
          AND (project, file) IN (SELECT (project, file) FROM found_files) AND status NOT IN ('missing', 'file_deleted')
          THEN 'missing' ELSE status END AS status FROM baseline b LEFT JOIN found_last f USING (project, file, scope, name)"""),
    "e5_scan": (scan_actions, f"""{SNAP}, acts AS (SELECT project, file, scope, name, b.*, f.value AS fv, CASE
            WHEN b.value IS NULL THEN 'added' WHEN f.value IS NOT NULL AND origin = 'scan' THEN 'updated'
            WHEN f.value IS NOT NULL THEN 'refreshed' WHEN origin = 'scan' THEN 'pruned'
            WHEN (project, file) IN (SELECT (project, file) FROM found_files) AND status NOT IN ('missing', 'file_deleted')
              THEN 'missing' ELSE 'kept' END AS action
          FROM baseline b FULL JOIN found_last f USING (project, file, scope, name))
        SELECT project, file, scope, name, action, coalesce(origin, 'scan') AS origin,
          CASE WHEN action IN ('added', 'updated') THEN 'active' WHEN action = 'missing' THEN 'missing'
            WHEN action = 'refreshed' THEN CASE WHEN fv = value THEN 'active' ELSE 'drifted' END ELSE status END AS status,
          CASE WHEN action IN ('added', 'updated') THEN fv ELSE value END AS value_preview,
          CASE WHEN action IN ('added', 'updated') THEN 'scan' ELSE last_session END AS last_session FROM acts"""),
    "e5_scan_counts": (scan_counts, f"""{SNAP}, acts AS (SELECT project, CASE
            WHEN b.value IS NULL THEN 'added' WHEN f.value IS NOT NULL AND origin = 'scan' THEN 'updated'
            WHEN f.value IS NOT NULL THEN 'refreshed' WHEN origin = 'scan' THEN 'pruned'
            WHEN (project, file) IN (SELECT (project, file) FROM found_files) AND status NOT IN ('missing', 'file_deleted')
              THEN 'missing' ELSE 'kept' END AS action FROM baseline b FULL JOIN found_last f USING (project, file, scope, name))
        SELECT project, action, count(*) AS rows FROM acts GROUP BY ALL"""),
    "e6_e7_prune": (prune, f"""{SNAP} SELECT project, file, scope, name, origin FROM baseline
        WHERE origin <> 'scan' OR (project, file, scope, name) IN (SELECT (project, file, scope, name) FROM found_last)"""),
    "e8_e10_reconcile": (reconcile, f"""{RES} SELECT project, file, scope, name, status, old_status, old_scope, moved, outcome,
        repo_value_preview FROM result"""),
    "e8_reconcile_lineitem": (reconcile_lineitem, f"""WITH {LINEITEM}, rows AS (SELECT *, seen.l_partkey AS pk, seen.l_suppkey AS sk FROM w
          QUALIFY row_number() OVER (PARTITION BY project, file, name ORDER BY seen DESC) = 1)
        SELECT project, file, CASE WHEN here AND kept AND name = '7' THEN 'moved' ELSE '' END AS scope, name,
          CASE WHEN NOT here THEN 'file_deleted' WHEN NOT kept THEN 'missing' WHEN sk % 19 = 0 THEN 'drifted' ELSE 'active' END AS status,
          here AND kept AND name = '7' AS moved, CASE WHEN here AND kept AND sk % 19 = 0 THEN 'changed' ELSE value END AS repo_value_preview
        FROM (SELECT *, file::bigint % 29 <> 0 AS here, pk % 17 <> 0 AS kept FROM rows)"""),
    "e14_reconcile_totals": (reconcile_totals, f"""{RES} SELECT project, count(DISTINCT file) AS files,
        count(*) FILTER (WHERE outcome <> 'file_deleted') AS checked, count(*) FILTER (WHERE outcome = 'active') AS active,
        count(*) FILTER (WHERE outcome = 'drifted') AS drifted, count(*) FILTER (WHERE outcome = 'missing') AS missing,
        count(*) FILTER (WHERE outcome = 'file_deleted') AS file_deleted, count(*) FILTER (WHERE moved) AS moved,
        0::bigint AS skipped_files FROM result GROUP BY project"""),
    "e13_transition_events": (transition_events, f"""{RES}
        SELECT project, 'file_deleted' AS action, name, file, scope, NULL AS detail FROM result WHERE outcome = 'file_deleted' AND old_status <> 'file_deleted'
        UNION ALL SELECT project, 'went_missing', name, file, scope, 'reconcile' FROM result
          WHERE outcome = 'missing' AND old_status NOT IN ('missing', 'file_deleted')
        UNION ALL SELECT project, 'moved', name, file, scope, 'was scope ''' || old_scope || '''' FROM result WHERE moved
        UNION ALL SELECT project, 'drifted', name, file, scope, 'repo now: ' || repo_value_preview[:80] FROM result
          WHERE outcome = 'drifted' AND old_status <> 'drifted'"""),
    "e11_changed_files": (changed_files, f"""{REG} SELECT project, file FROM registry GROUP BY project, file
        HAVING timestamp '2024-01-01' + to_minutes(max(seq)) < timestamp '2024-01-01' + to_seconds(max(seq) - min(line) % 3 + 1)""".replace(
            "to_seconds(max(seq) - min(line) % 3 + 1)", "to_minutes(max(seq) - min(line) % 3 + 1)")),
    "e12_tracked_files": (tracked_files, f"{REG} SELECT DISTINCT project, file FROM registry WHERE status <> 'file_deleted' ORDER BY project, file LIMIT 40"),
    "e15_accept_drift": (accept, f"""{REG} SELECT project, file, scope, name, hit AS accepted, CASE WHEN hit THEN 'active' ELSE status END AS status,
        CASE WHEN hit THEN now_value ELSE value END AS value_preview
        FROM (SELECT *, status = 'drifted' AND starts_with(name, 'MAX_') AND contains(file, 'mod') AS hit FROM registry)"""),
    "e16_annotate": (annotate, f"{REG} SELECT project, file, scope, name, 'keep' AS note FROM registry WHERE name = 'MAX_GEAR' AND contains(file, 'mod1')"),
    "e2_attribute": (attribute, f"""{CH} SELECT project, event_id, name, tool_name = 'Write' OR (tool_name <> 'Read' AND event_id % 2 = 0) AS attributed FROM changes
        UNION ALL SELECT project, event_id, 'HUMAN_' || name, tool_name = 'Write' FROM changes"""),
    "e18_namespace_sessions": (namespaced, f"{EV} SELECT event_id, 'kilo:' || session_id AS session_id, 'kilo' AS origin FROM event_log"),
    "e19_validate_changes": (validated, f"""{CH} SELECT event_id,
        CASE WHEN path = 'dist' THEN 'dist/a.py' WHEN path IN ('/elsewhere/a.py') THEN NULL ELSE path END AS file,
        CASE WHEN tool_name = 'Read' THEN 'tool ''Read'' not captured' WHEN path = '' THEN 'no file_path'
          WHEN path = '/elsewhere/a.py' THEN 'outside project root' WHEN path = 'dist' THEN 'excluded dir'
          WHEN path = 'notes.txt' THEN 'unsupported language' END AS reason FROM changes"""),
    "e20_capture_summary": (capture_summary, f"""{CH}, acts AS (SELECT project, event_id, row_number() OVER (PARTITION BY project,
          CASE path WHEN 'dist' THEN 'dist/a.py' ELSE path END, name ORDER BY ts, event_id) AS n
          FROM changes WHERE tool_name = 'Write' AND path NOT IN ('', '/elsewhere/a.py', 'dist', 'notes.txt'))
        SELECT project, event_id, count(*) FILTER (WHERE n = 1) AS added, count(*) FILTER (WHERE n > 1) AS updated,
          0::bigint AS refreshed, 0::bigint AS removed FROM acts GROUP BY ALL"""),
    "a10_events_roundtrip": (event_roundtrip, f"""{EV} SELECT project, action, count(*) AS events, min(ts) AS first, max(ts) AS last FROM event_log GROUP BY ALL"""),
    "a6_a7_registry_roundtrip": (registry_roundtrip, f"""{REG} SELECT project, file, scope, name, value_hash, status FROM registry
        WHERE project NOT LIKE '%1' OR scope = ''"""),
    "a8_reviews_read": (reviews_read, f"{REG}, {LEDGER} SELECT project, pair_key, verdict, ts FROM review_rows"),
    "a8_swapped_keys": (swapped_reviews, f"""{REG}, {LEDGER} SELECT project, pair_key, 'merged' AS verdict, ts + interval '1 day' AS ts FROM review_rows"""),
    "a9_review_upsert": (review_upsert, f"""{REG}, {LEDGER} SELECT project, pair_key,
        CASE WHEN len(pair_key) % 2 = 0 THEN 'merged' ELSE verdict END AS verdict FROM review_rows"""),
    "a11_project_settings": (settings, """WITH p AS (SELECT DISTINCT 'c' || c_nationkey::varchar AS project FROM customer),
        o AS (SELECT 'c' || c_nationkey::varchar AS project, max(c_custkey)::varchar AS v FROM customer WHERE c_custkey % 10 = 0 GROUP BY ALL)
        SELECT project, 'preview_len' AS key, coalesce(v, '120') AS value FROM p LEFT JOIN o USING (project)
        UNION ALL SELECT project, 'max_file_kb', '1024' FROM p"""),
    "a11_ignored_names": (ignored_names, f"{REG} SELECT DISTINCT project, name FROM assignments WHERE origin = 'scan' OR lang = 'python'"),
    "a13_export_md": (export_md, f"""{REG} SELECT '| `' || name || '` | ' || scope || ' | `' || value || '` | ' || status || ' | '
        || file || ':' || line::varchar || ' | ' || last_session[:8] || ' |' AS value FROM registry
        UNION ALL SELECT unnest(['| name | scope | value | status | location | last session |', '|---|---|---|---|---|---|'])"""),
    "a13_export_json": (export_json, f"{REG} SELECT project, file, scope, name, value_hash, line::varchar AS repo_line FROM registry"),
    "g1_stats": (stats, f"""{REG}, s AS (SELECT project, string_agg(k || '=' || n::varchar, ',' ORDER BY k) AS by_status
          FROM (SELECT project, status AS k, count(*) AS n FROM registry GROUP BY ALL) GROUP BY project),
        l AS (SELECT project, string_agg(k || '=' || n::varchar, ',' ORDER BY k) AS by_lang
          FROM (SELECT project, lang AS k, count(*) AS n FROM registry GROUP BY ALL) GROUP BY project)
        SELECT project, count(*) AS total, count(DISTINCT file) AS files, count(DISTINCT last_session) AS sessions,
          any_value(by_status) AS by_status, any_value(by_lang) AS by_lang FROM registry JOIN s USING (project) JOIN l USING (project) GROUP BY project"""),
    "g2_lang_counts": (lang_counts, f"{REG} SELECT project, lang, count(*) AS rows FROM registry GROUP BY ALL"),
    "g5_origin_status_counts": (origin_status, f"""{REG} SELECT project, count(*) AS tracked, count(*) FILTER (WHERE origin = 'claude') AS claude,
        count(*) FILTER (WHERE origin = 'kilo') AS kilo, count(*) FILTER (WHERE origin = 'scan') AS scan,
        count(*) FILTER (WHERE status = 'drifted') AS drifted, count(*) FILTER (WHERE status = 'missing') AS missing,
        count(*) FILTER (WHERE status = 'file_deleted') AS file_deleted FROM registry GROUP BY project"""),
    "g20_project_list": (project_list, f"""{REG} SELECT project, count(*) AS tracked, count(DISTINCT file) AS files,
        count(DISTINCT last_session) AS sessions FROM registry GROUP BY project"""),
    "g10_session_summary": (session_summary, f"""{EV} SELECT session_id, count(*) AS events, min(ts) AS started, max(ts) AS last
        FROM event_log GROUP BY session_id ORDER BY last DESC, session_id LIMIT 50"""),
    "g13_activity": (activity, f"""{EV}, tops AS (SELECT *, session_id[:12] AS session FROM event_log
        QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) <= 6)
        SELECT project, event_id, session, action, name FROM tops ORDER BY ts DESC, project, event_id DESC LIMIT 10"""),
    "j3_debounce": (debounce, """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < interval '2 hours'
          THEN 0 ELSE 1 END AS fresh FROM events),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM s)
        SELECT user_id AS project, min(ts) AS started, max(ts) + interval '2 hours' AS settled, count(*) AS changes FROM g GROUP BY user_id, burst"""),
    "g19_recall": (recall, f"""{REG}, s AS (SELECT project, string_agg(k || '=' || n::varchar, ', ' ORDER BY k) AS by_status
          FROM (SELECT project, status AS k, count(*) AS n FROM registry GROUP BY ALL) GROUP BY project),
        head AS (SELECT project, 0 AS section, 0 AS ord, '## Assignments written in earlier sessions' || chr(10) || 'Tracked: '
          || count(*)::varchar || ' assignments across ' || count(DISTINCT file)::varchar || ' files (' || count(DISTINCT last_session)::varchar
          || ' sessions). Statuses: ' || any_value(by_status) || '.' AS text FROM registry JOIN s USING (project) GROUP BY project),
        gone AS (SELECT *, row_number() OVER (PARTITION BY project, status ORDER BY {NEWEST}) AS ord FROM registry WHERE status <> 'active'),
        pool AS (SELECT * FROM registry WHERE status = 'active'),
        recent AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY scope <> '', {NEWEST}) AS ord FROM pool
          WHERE scope = '' OR len(name) > 1),
        shown AS (SELECT project, status, ord, seen, file, name, '- `' || name || '`' || CASE WHEN scope <> '' THEN ' [' || scope || ']' ELSE '' END
          || ' = `' || value || '` (' || file || ':' || line::varchar || ')' AS t, now_value FROM
          (SELECT * FROM gone UNION ALL SELECT * FROM recent WHERE ord <= 25)),
        parts AS (SELECT * FROM head
          UNION ALL SELECT project, 2, ord, CASE WHEN ord = 1 THEN chr(10) || '### Changed in the repo since they were written (drifted)' || chr(10) ELSE '' END
            || t || chr(10) || '  repo now: `' || now_value || '`' FROM shown WHERE status = 'drifted' AND ord <= 10
          UNION ALL SELECT project, 3, ord, CASE WHEN ord = 1 THEN chr(10) || '### No longer present in their file (missing)' || chr(10) ELSE '' END
            || '- `' || name || '` was in ' || file || ' (last written ' || strftime(seen, '%Y-%m-%dT%H:%M:%S') || ')' FROM shown WHERE status = 'missing' AND ord <= 10
          UNION ALL SELECT project, 4, ord, CASE WHEN ord = 1 THEN chr(10) || '### Tracked files deleted from the repo' || chr(10) ELSE '' END
            || '- ' || file || ' (held `' || name || '`)' FROM shown WHERE status = 'file_deleted' AND ord <= 5
          UNION ALL SELECT project, 5, ord, CASE WHEN ord = 1 THEN chr(10) || '### Recently written (module-level first, up to 25)' || chr(10) ELSE '' END
            || t FROM shown WHERE status = 'active'),
        whole AS (SELECT project, string_agg(text, chr(10) ORDER BY section, ord) AS text FROM parts GROUP BY project)
        SELECT project, CASE WHEN len(text) > 6000 THEN text[:5960] || chr(10) || '…(' || (len(text) - 5960)::varchar || ' characters left out)' ELSE text END AS text FROM whole"""),
    "h5_recent_pool": (recent_pool, f"""{REG}, pool AS (SELECT * FROM registry WHERE status = 'active')
        SELECT project, file, scope, name FROM pool WHERE scope = '' OR len(name) > 1
        QUALIFY row_number() OVER (PARTITION BY project ORDER BY scope <> '', {NEWEST}) <= 25"""),
    "h1_registry_query": (query, f"""{REG} SELECT project, file, scope, name FROM registry WHERE name ILIKE 'max\\_%' ESCAPE '\\' AND status = 'active'
        AND contains(file, 'mod') AND lang = 'python' ORDER BY {NEWEST} LIMIT 200"""),
    "h4_paginate": (paged, f"""{REG} SELECT project, file, scope, name, seen AS last_written_at, n AS total, 3::bigint AS page, 50::bigint AS size,
        ceil(n / 50)::bigint AS pages FROM (SELECT *, count(*) OVER () AS n FROM registry) ORDER BY {NEWEST} LIMIT 50 OFFSET 100"""),
    "d17_c14_scope_depth": (scope_depths, f"""{REG} SELECT seq, CASE seq % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS depth,
        last_session[:2] AS short FROM assignments"""),
}

