"""The keyed registry: upsert, attribution, scan, reconcile, accept, annotate.

Every operator is DataFrame in, DataFrame out; time comes in as `as_of`, so a
re-run gives the same rows.  Keys are (project, file, scope, name).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..functions import vocab
from ..schema import KEY, REGISTRY_COLUMNS
from .latest import latest, top_per_group

GONE = ["missing", "file_deleted"]
FOUND = ["lang", "kind", "line", "value_preview", "value_hash", "redacted", "anno"]


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def described(extracted: DataFrame, redact: bool = True, preview_len: int = 120) -> DataFrame:
    """Extracted rows with preview, redaction flag and hash in place of the value."""
    shown = X.make_preview(F.col("value"), redact, preview_len)
    return (extracted.withColumn("_p", shown)
            .withColumn("value_preview", F.col("_p.preview"))
            .withColumn("redacted", F.col("_p.redacted"))
            .withColumn("value_hash", X.value_hash(F.col("value")))
            .drop("_p", "value"))


# ------------------------------------------------------------------- upsert

def fold_writes(writes: DataFrame) -> DataFrame:
    """All writes of a batch to one row per key.

    writes: key + FOUND columns, session, origin, ts, seq (order of writes).
    Aggregates combine on the map side, so a hot key costs one row per task."""
    at = F.struct("ts", "seq")
    agent = F.when(F.col("origin") != "scan", at)
    return writes.groupBy(*KEY).agg(
        F.max_by(F.struct(*FOUND), at).alias("new"),
        F.min_by("session", at).alias("first_session"),
        F.max_by("session", at).alias("session"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("ts"),
        F.min_by("origin", at).alias("created_origin"),
        F.max_by("origin", agent).alias("agent_origin"),
        F.count(F.lit(1)).alias("writes"))


def upsert(registry: DataFrame, incoming: DataFrame, as_of=None, origin: str | None = None,
           session: str | None = None) -> DataFrame:
    """Insert or update; first_* stays, an agent claims a scan row, never the
    reverse.  Returns the registry plus `action`: added, updated or kept."""
    w = incoming
    for name, value in (("ts", as_of), ("origin", origin), ("session", session)):
        if value is not None:
            w = w.withColumn(name, _ts(value) if name == "ts" else F.lit(value))
    if "seq" not in w.columns:
        w = w.withColumn("seq", F.col("ord") if "ord" in w.columns else F.lit(0))
    folded = fold_writes(w).withColumn("_in", F.lit(True))
    r, i = registry.withColumn("_old", F.lit(True)).alias("r"), folded.alias("i")
    j = r.join(i, KEY, "full_outer")
    hit, old = F.col("_in").isNotNull(), F.col("_old").isNotNull()
    first_origin = F.coalesce(F.col("i.agent_origin"), F.col("i.created_origin"))

    def pick(new: Column, kept: str) -> Column:
        return F.when(hit, new).otherwise(F.col(f"r.{kept}"))

    new = {c: F.col(f"i.new.{c}") for c in FOUND}
    cols = {
        **{c: pick(new[c], c) for c in FOUND},
        "repo_value_preview": pick(new["value_preview"], "repo_value_preview"),
        "repo_value_hash": pick(new["value_hash"], "repo_value_hash"),
        "repo_line": pick(new["line"], "repo_line"),
        "status": pick(F.lit("active"), "status"),
        "first_session": F.when(old, F.col("r.first_session")).otherwise(F.col("i.first_session")),
        "last_session": pick(F.col("i.session"), "last_session"),
        "first_seen_at": F.when(old, F.col("r.first_seen_at")).otherwise(F.col("i.first_ts")),
        "last_written_at": pick(F.col("i.ts"), "last_written_at"),
        "last_verified_at": pick(F.col("i.ts"), "last_verified_at"),
        "origin": F.when(~old, first_origin).otherwise(F.coalesce(F.col("i.agent_origin"), F.col("r.origin"))),
        "note": F.col("r.note"),
    }
    action = F.when(~hit, "kept").when(old, "updated").otherwise("added")
    return j.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in REGISTRY_COLUMNS],
                    action.alias("action"))


# -------------------------------------------------------------- change feed

def namespace_sessions(changes: DataFrame, prefix: str = vocab.SECOND_FEED_PREFIX,
                       origin: str = vocab.SECOND_FEED_ORIGIN) -> DataFrame:
    """Second agent feed: session ids get its prefix once; rows get its origin."""
    sid = F.col("session_id").cast("string")
    sid = F.when(sid.isNull() | (sid == ""), "unknown").otherwise(sid)
    return (changes.withColumn("session_id", F.when(sid.startswith(prefix), sid).otherwise(
        F.concat(F.lit(prefix), sid))).withColumn("origin", F.lit(origin)))


def validate_changes(changes: DataFrame, settings: dict | None = None) -> DataFrame:
    """Add file (relative path), lang, source and reason (null when accepted).

    `file_content` is the file after the change; without it the payload's
    content stands in, as for a file deleted meanwhile.  Files of any
    size are accepted unless `settings` hold a max_file_kb."""
    cfg = {**vocab.DEFAULT_SETTINGS, "max_file_kb": None, **(settings or {})}
    slash = F.replace(F.coalesce("tool_input.file_path", F.lit("")), F.lit("\\"), F.lit("/"))
    root = F.concat(F.regexp_replace(F.replace(F.coalesce("cwd", F.lit("")), F.lit("\\"), F.lit("/")),
                                     "/+$", ""), F.lit("/"))
    rel = F.when(slash.startswith(root), F.substring(slash, F.length(root) + 1, F.length(slash))).when(
        ~slash.rlike("^(?:/|[A-Za-z]:/)"), slash)
    rel = F.when(~rel.rlike(r"(?:^|/)\.\.(?:/|$)"), rel)
    tool = F.coalesce("tool_name", F.lit(""))
    dirs = F.split(rel, "/")
    excluded = F.arrays_overlap(F.slice(dirs, F.lit(1), F.size(dirs) - 1),
                                F.array(*[F.lit(d) for d in cfg["exclude_dirs"]]))
    size = F.octet_length(F.coalesce("file_content", F.lit("")))
    source = F.coalesce("file_content", F.col("tool_input.content"))
    too_large = F.lit(False) if cfg["max_file_kb"] is None else size > cfg["max_file_kb"] * 1024
    reason = (F.when(~tool.isin(vocab.CAPTURED_TOOLS), F.format_string("tool '%s' not captured", tool))
              .when(slash == "", "no file_path")
              .when(rel.isNull(), "outside project root")
              .when(excluded, "excluded dir")
              .when(N.lang_of_path(rel).isNull(), "unsupported language")
              .when(too_large, "file too large")
              .when(source.isNull(), "unreadable file"))
    return changes.withColumns({"file": rel, "lang": N.lang_of_path(rel), "source": source, "reason": reason})


def attribution(tool: Column, tool_input: Column) -> Column:
    """Names an edit claims; null claims every assignment of the file."""
    edits = F.coalesce(tool_input["edits"], F.array().cast("array<struct<new_string:string>>"))
    return (F.when(tool == "Write", F.lit(None).cast("array<string>"))
            .when(tool == "Edit", X.identifier_tokens(tool_input["new_string"]))
            .when(tool == "MultiEdit", F.array_distinct(F.flatten(F.transform(
                edits, lambda e: X.identifier_tokens(e["new_string"])))))
            .otherwise(F.array().cast("array<string>")))


def attribute(extracted: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows extracted per event (project, event_id) flagged by who wrote them."""
    claims = changes.select("project", "event_id", (F.col("tool_name") == "Write").alias("_all"),
                            attribution(F.col("tool_name"), F.col("tool_input")).alias("_names"))
    return (extracted.join(claims, ["project", "event_id"])
            .withColumn("attributed", F.col("_all") | F.coalesce(
                F.array_contains("_names", F.col("name")), F.lit(False)))
            .drop("_all", "_names"))


def capture_summary(actions: DataFrame) -> DataFrame:
    """added / updated / refreshed / removed per event."""
    kinds = ["added", "updated", "refreshed", "removed"]
    return actions.groupBy("project", "event_id").agg(
        *[F.count_if(F.col("action") == k).alias(k) for k in kinds])


# --------------------------------------------------- refresh, scan, pruning

def _refreshed(found: str = "f", old: str = "r") -> dict[str, Column]:
    """Repo state of a tracked row after seeing it in its file."""
    same = F.col(f"{found}.value_hash") == F.col(f"{old}.value_hash")
    return {
        "repo_value_preview": F.col(f"{found}.value_preview"),
        "repo_value_hash": F.col(f"{found}.value_hash"),
        "repo_line": F.col(f"{found}.line"),
        "line": F.when(F.col(f"{found}.line") != 0, F.col(f"{found}.line")).otherwise(F.col(f"{old}.line")),
        "status": F.when(same, "active").otherwise("drifted"),
    }


def refresh(registry: DataFrame, found: DataFrame, as_of) -> DataFrame:
    """Tracked rows found again: repo columns follow the file, status by hash."""
    f = latest(found, KEY, ["ord"]).select(*KEY, "value_preview", "value_hash", "line", F.lit(True).alias("_f"))
    j = registry.alias("r").join(f.alias("f"), KEY, "left")
    seen = F.col("_f").isNotNull()
    new = {**_refreshed(), "last_verified_at": _ts(as_of)}
    return j.select(*[F.when(seen, new[c]).otherwise(F.col(f"r.{c}")).alias(c) if c in new
                      else F.col(c) if c in KEY else F.col(f"r.{c}") for c in REGISTRY_COLUMNS])


def mark_missing(registry: DataFrame, found: DataFrame, touched_files: DataFrame, as_of) -> DataFrame:
    """Rows of rewritten files that are no longer in them become missing."""
    f = found.select(*KEY).distinct().withColumn("_f", F.lit(True))
    t = touched_files.select("project", "file").distinct().withColumn("_t", F.lit(True))
    j = registry.join(f, KEY, "left").join(t, ["project", "file"], "left")
    lost = F.col("_t").isNotNull() & F.col("_f").isNull() & ~F.col("status").isin(GONE)
    return (j.withColumn("last_verified_at", F.when(lost, _ts(as_of)).otherwise(F.col("last_verified_at")))
            .withColumn("status", F.when(lost, "missing").otherwise(F.col("status")))
            .select(*REGISTRY_COLUMNS))


def scan_actions(registry: DataFrame, found: DataFrame, visited_files: DataFrame, as_of) -> DataFrame:
    """One whole-corpus scan: every row after the scan with its `action`.

    added/updated (scan rows), refreshed (agent rows), missing (agent rows gone
    from a visited file), pruned (scan rows gone, to be dropped), kept."""
    f = latest(found, KEY, ["ord"]).select(*KEY, *FOUND).withColumn("_f", F.lit(True)).alias("f")
    r = registry.withColumn("_r", F.lit(True)).alias("r")
    visited = visited_files.select("project", "file").distinct().withColumn("_v", F.lit(True))
    j = r.join(f, KEY, "full_outer").join(visited, ["project", "file"], "left")
    is_found, is_old = F.col("_f").isNotNull(), F.col("_r").isNotNull()
    from_scan = F.coalesce(F.col("r.origin") == "scan", F.lit(False))
    action = (F.when(is_found & ~is_old, "added")
              .when(is_found & from_scan, "updated")
              .when(is_found, "refreshed")
              .when(from_scan, "pruned")
              .when(F.col("_v").isNotNull() & ~F.col("r.status").isin(GONE), "missing")
              .otherwise("kept"))
    now = _ts(as_of)
    written = action.isin("added", "updated")
    again = _refreshed()
    cols = {}
    for c in REGISTRY_COLUMNS:
        if c in KEY:
            cols[c] = F.col(c)
            continue
        old = F.col(f"r.{c}")
        new = {"repo_value_preview": F.col("f.value_preview"), "repo_value_hash": F.col("f.value_hash"),
               "repo_line": F.col("f.line"), "status": F.lit("active"), "last_session": F.lit("scan"),
               "last_written_at": now, "last_verified_at": now}.get(c)
        if c in FOUND:
            new = F.col(f"f.{c}")
        if c in ("first_session", "first_seen_at", "origin"):
            fresh = {"first_session": F.lit("scan"), "first_seen_at": now, "origin": F.lit("scan")}[c]
            cols[c] = F.when(action == "added", fresh).otherwise(old)
            continue
        if new is None:
            cols[c] = old
            continue
        col = F.when(written, new)
        if c in again:
            col = col.when(action == "refreshed", again[c])
        if c == "last_verified_at":
            col = col.when(action.isin("refreshed", "missing"), now)
        if c == "status":
            col = col.when(action == "missing", F.lit("missing"))
        cols[c] = col.otherwise(old)
    return j.select(*[cols[c].alias(c) for c in REGISTRY_COLUMNS], action.alias("action"))


def scan(registry: DataFrame, found: DataFrame, visited_files: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(registry after the scan, rows per project and action)."""
    rows = scan_actions(registry, found, visited_files, as_of)
    after = rows.filter("action <> 'pruned'").select(*REGISTRY_COLUMNS)
    counts = rows.groupBy("project", "action").agg(F.count(F.lit(1)).alias("rows"))
    return after, counts


def prune(registry: DataFrame, found: DataFrame, visited_files: DataFrame) -> DataFrame:
    """Drop scan rows whose key, or whose whole file, is gone."""
    scanned = registry.filter("origin = 'scan'")
    kept = (scanned.join(found.select(*KEY).distinct(), KEY, "left_semi")
            .join(visited_files.select("project", "file").distinct(), ["project", "file"], "left_semi"))
    return registry.filter("origin <> 'scan'").unionByName(kept)


# ---------------------------------------------------------------- reconcile

def changed_files(registry: DataFrame, corpus_meta: DataFrame, force: bool = False) -> DataFrame:
    """Tracked files modified after their newest verification (all if forced).

    corpus_meta: project, path, modificationTime - no content is read."""
    checked = registry.groupBy("project", "file").agg(F.max("last_verified_at").alias("verified"))
    j = checked.join(corpus_meta.select("project", F.col("path").alias("file"), "modificationTime"),
                     ["project", "file"])
    if not force:
        j = j.filter(F.col("verified").isNull() | (F.col("modificationTime") > F.col("verified")))
    return j.select("project", "file")


def reconcile(registry: DataFrame, found: DataFrame, files: DataFrame, as_of,
              skipped: DataFrame | None = None) -> DataFrame:
    """Registry against the files as they are now.

    found: described rows of the re-read files; files: files that exist;
    skipped: files that exist but were not re-read (unchanged or too large).
    Returns the new registry columns plus old_status, old_scope, moved, outcome."""
    seen_as = F.struct("scope", "line", "value_preview", "value_hash")
    by_key = latest(found, KEY, ["ord"]).select(*KEY, seen_as.alias("_exact"))
    once = (found.groupBy("project", "file", "name")
            .agg(F.count(F.lit(1)).alias("_n"), F.max_by(seen_as, "ord").alias("_moved"))
            .filter("_n = 1").drop("_n"))
    j = registry.join(by_key, KEY, "left")
    # a row whose key is gone may move when its name occurs once in the file, and
    # only onto a free key; of several such rows the first by scope takes it
    movers = (j.filter("_exact is null").select(*KEY).join(once, ["project", "file", "name"])
              .withColumn("_goal", F.col("_moved.scope")))
    keys = registry.select("project", "file", F.col("scope").alias("_goal"), "name")
    movers = movers.join(keys, ["project", "file", "_goal", "name"], "left_anti").drop("_goal")
    movers = top_per_group(movers, ["project", "file", "name"], [F.col("scope")], 1)
    present = files.select("project", "file").distinct().withColumn("_here", F.lit(True))
    j = j.join(movers, KEY, "left").join(present, ["project", "file"], "left")
    if skipped is not None:
        j = j.join(skipped.select("project", "file").distinct().withColumn("_skip", F.lit(True)),
                   ["project", "file"], "left")
    else:
        j = j.withColumn("_skip", F.lit(None).cast("boolean"))
    hit = F.coalesce("_exact", "_moved")
    outcome = (F.when(F.col("_here").isNull(), "file_deleted")
               .when(F.col("_skip"), "skipped")
               .when(hit.isNull(), "missing")
               .when(hit["value_hash"] == F.col("value_hash"), "active").otherwise("drifted"))
    j = j.withColumn("_hit", hit).withColumn("outcome", outcome)
    j = j.withColumn("moved", F.col("_moved").isNotNull() & F.col("outcome").isin("active", "drifted"))
    seen = F.col("outcome").isin("active", "drifted")
    lost = F.col("outcome").isin("missing", "file_deleted")
    # a row that is already gone is not marked again
    newly_lost = (F.when(F.col("outcome") == "missing", ~F.col("status").isin(GONE))
                  .when(F.col("outcome") == "file_deleted", F.col("status") != "file_deleted")
                  .otherwise(False))
    changed = {
        "repo_value_preview": F.when(seen, F.col("_hit.value_preview")),
        "repo_value_hash": F.when(seen, F.col("_hit.value_hash")),
        "repo_line": F.when(seen, F.col("_hit.line")),
        "line": F.when(seen & (F.col("_hit.line") != 0), F.col("_hit.line")),
        "scope": F.when(F.col("moved"), F.col("_hit.scope")),
        "last_verified_at": F.when(seen | newly_lost, _ts(as_of)),
    }
    status = F.when(seen, F.col("outcome")).when(lost & newly_lost, F.col("outcome")).otherwise(F.col("status"))
    return j.select(
        *[(status if c == "status" else F.coalesce(changed[c], F.col(c)) if c in changed else F.col(c)).alias(c)
          for c in REGISTRY_COLUMNS],
        F.col("status").alias("old_status"), F.col("scope").alias("old_scope"), "moved", "outcome")


def tracked_files(registry: DataFrame, limit: int | None = None) -> DataFrame:
    files = registry.filter("status <> 'file_deleted'").select("project", "file").distinct()
    return files if limit is None else files.orderBy("project", "file").limit(limit)


def first_files(registry: DataFrame, per_project: int) -> DataFrame:
    """The first tracked files of each project, in path order."""
    return top_per_group(tracked_files(registry), ["project"], [F.col("file")], per_project)


def transition_events(result: DataFrame, session: str, as_of) -> DataFrame:
    """Audit rows for the status changes of a reconcile result."""

    def event(action, cond, scope, detail):
        return F.when(cond, F.struct(F.lit(action).alias("action"), scope.alias("scope"),
                                     detail.alias("detail")))

    none = F.lit(None).cast("string")
    now = F.col("outcome")
    rows = F.array_compact(F.array(
        event("file_deleted", (now == "file_deleted") & (F.col("old_status") != "file_deleted"),
              F.col("scope"), none),
        event("went_missing", (now == "missing") & ~F.col("old_status").isin(GONE),
              F.col("scope"), F.lit("reconcile")),
        event("moved", F.col("moved"), F.col("scope"), F.format_string("was scope '%s'", "old_scope")),
        event("drifted", (now == "drifted") & (F.col("old_status") != "drifted"), F.col("scope"),
              F.concat(F.lit("repo now: "), F.substring("repo_value_preview", 1, 80))),
    ))
    return result.select("project", F.lit(session).alias("session_id"), "name", "file",
                         F.explode(rows).alias("e")).select(
        "project", _ts(as_of).alias("ts"), "session_id", F.col("e.action").alias("action"),
        "name", "file", F.col("e.scope").alias("scope"), F.col("e.detail").alias("detail"))


def reconcile_totals(result: DataFrame) -> DataFrame:
    """Per project: files looked at, rows checked, rows by outcome."""
    o = F.col("outcome")
    return result.groupBy("project").agg(
        F.count_distinct("file").alias("files"),
        F.count_if(~o.isin("file_deleted", "skipped")).alias("checked"),
        *[F.count_if(o == s).alias(s) for s in ("active", "drifted", "missing", "file_deleted")],
        F.count_if("moved").alias("moved"),
        F.count_distinct(F.when(o == "skipped", F.col("file"))).alias("skipped_files"))


def accept_drift(registry: DataFrame, as_of, pattern: str | None = None, file: str | None = None,
                 scope: str | None = None, all: bool = False) -> DataFrame:
    """Adopt the repo value of matching drifted rows; adds boolean `accepted`."""
    if not (all or pattern or file):
        raise ValueError("give a name pattern, a file, or all=True")
    hit = F.col("status") == "drifted"
    if not all:
        if pattern:
            hit = hit & X.wildcard(F.col("name"), pattern, ci=False)
        if file is not None:
            hit = hit & F.col("file").contains(file)
        if scope is not None:
            hit = hit & (F.col("scope") == scope)
    df = registry.withColumn("accepted", hit)
    new = {"value_preview": F.col("repo_value_preview"), "value_hash": F.col("repo_value_hash"),
           "status": F.lit("active"), "last_verified_at": _ts(as_of)}
    return df.withColumns({c: F.when(F.col("accepted"), v).otherwise(F.col(c)) for c, v in new.items()})


def annotate(registry: DataFrame, name: str, note: str, file: str | None = None) -> DataFrame:
    """Set the note of rows by exact name and file part; adds `annotated`."""
    hit = F.col("name") == name
    if file:
        hit = hit & F.col("file").contains(file)
    return registry.withColumn("note", F.when(hit, note).otherwise(F.col("note"))).withColumn("annotated", hit)
