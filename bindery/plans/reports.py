"""Roll-ups and reports over registry, pairs and events, all per project."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..functions import vocab
from ..operators.latest import top_per_group
from ..operators.linkage import level_rank
from ..operators.ranking import number_rows
from ..schema import KEY

STATUSES = ["active", "drifted", "missing", "file_deleted"]
LEVELS = ["high", "medium", "low"]


def dismissed() -> Column:
    return F.coalesce(F.col("review.verdict"), F.lit("")) == "not_duplicate"


# ------------------------------------------------------------------- counts

def stats(registry: DataFrame) -> DataFrame:
    """total, files, sessions, and row counts by status and language (maps)."""
    langs = sorted(set(vocab.LANG_BY_EXT.values()))
    lang = F.coalesce("lang", F.lit("?"))

    def tally(col: Column, values: list[str]) -> Column:
        full = F.create_map(*[x for v in values for x in (F.lit(v), F.count_if(col == v))])
        return F.map_filter(full, lambda k, n: n > 0)

    return registry.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("file").alias("files"),
        F.count_distinct(F.coalesce("last_session", F.lit(""))).alias("sessions"),
        tally(F.col("status"), STATUSES).alias("by_status"), tally(lang, [*langs, "?"]).alias("by_lang"))


def lang_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("project", F.coalesce("lang", F.lit("?")).alias("lang")).agg(
        F.count(F.lit(1)).alias("rows"))


def level_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("project", "level").agg(F.count(F.lit(1)).alias("pairs"))


def review_counts(pairs: DataFrame) -> DataFrame:
    """Unreviewed pairs by level, human-reviewed and rule-suppressed pairs."""
    open_pair = F.col("review").isNull()
    learned = F.coalesce("review.learned", F.lit(False))
    return pairs.groupBy("project").agg(
        *[F.count_if(open_pair & (F.col("level") == lv)).alias(f"unreviewed_{lv}") for lv in LEVELS],
        F.count_if(~open_pair & ~learned).alias("reviewed_pairs"),
        F.count_if(~open_pair & learned).alias("learned_suppressed"))


def origin_status_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("project").agg(
        F.count(F.lit(1)).alias("tracked"),
        *[F.count_if(F.col("origin") == o).alias(o) for o in ("claude", "kilo", "scan")],
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES[1:]])


def report_pairs(pairs: DataFrame, top: int = 400) -> DataFrame:
    """The best `top` pairs of each project."""
    return top_per_group(pairs, ["project"], [F.desc("score_int"), F.col("pair_key")], top)


def var_level(pairs: DataFrame) -> DataFrame:
    """Highest level of each variable over its non-dismissed pairs."""
    ends = pairs.filter(~dismissed()).select("project", F.explode(F.array("id_a", "id_b")).alias("id"),
                       level_rank(F.col("level")).alias("rank"))
    rank = F.max("rank")
    return ends.groupBy("project", "id").agg(
        F.when(rank == 3, "high").when(rank == 2, "medium").otherwise("low").alias("level"))


def needs_attention(registry: DataFrame, pairs: DataFrame) -> DataFrame:
    r, p = origin_status_counts(registry), review_counts(pairs)
    j = r.join(p, "project", "left")
    n = {lv: F.coalesce(f"unreviewed_{lv}", F.lit(0)) for lv in LEVELS}
    return j.select(
        "project", "tracked",
        (n["high"] + n["medium"] + F.col("drifted") + F.col("missing")).alias("needs_attention"),
        *[n[lv].alias(lv) for lv in LEVELS], "drifted", "missing", "file_deleted",
        F.coalesce("reviewed_pairs", F.lit(0)).alias("reviewed"))


def group_members(groups: DataFrame, repos: DataFrame) -> DataFrame:
    """(group_id, repo_id) with the repos of no group under 'standalone'."""
    members = groups.select("group_id", F.explode("repo_ids").alias("repo_id")).distinct()
    alone = repos.select("repo_id").join(members, "repo_id", "left_anti")
    known = members.join(repos.select("repo_id"), "repo_id", "left_semi")
    return known.select("group_id", "repo_id").unionByName(
        alone.select(F.lit("standalone").alias("group_id"), "repo_id"))


def group_rollup(counts: DataFrame, groups: DataFrame, repos: DataFrame) -> DataFrame:
    """Sums of the per-project counts over each group; counts.project = repo_id."""
    sums = [c for c in counts.columns if c != "project"]
    j = group_members(groups, repos).join(counts.withColumnRenamed("project", "repo_id"), "repo_id", "left")
    return j.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("repos"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def project_list(registry: DataFrame) -> DataFrame:
    return registry.groupBy("project").agg(
        F.count(F.lit(1)).alias("tracked"), F.count_distinct("file").alias("files"),
        F.count_distinct(F.coalesce("last_session", F.lit(""))).alias("sessions"))


def session_summary(events: DataFrame, k: int = 50) -> DataFrame:
    """Events, first and last time of the k sessions seen last."""
    s = events.groupBy(F.coalesce(F.when(F.col("session_id") != "", F.col("session_id")), F.lit("?"))
                       .alias("session_id")).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("last"))
    return s.orderBy(F.desc("last"), "session_id").limit(k)


# ------------------------------------------------------------------- issues

def _var(r) -> Column:
    return F.struct(F.col("id"), "name", "file", "scope", "line", "status", F.col("value_preview").alias("value"))


def issues(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """Pairs and drift or removal findings in one list; `reviewed` sorts last."""
    dup = pairs.select(
        "project", F.lit("duplicate").alias("kind"), F.col("pair_key").alias("key"), "level", "score_int",
        "reason", F.col("review.verdict").alias("verdict"), F.col("review").isNotNull().alias("reviewed"),
        F.concat_ws(" ↔ ", "a.name", "b.name").alias("title"),
        F.array("a.file", "b.file").alias("files"))
    status = F.col("status")
    score = F.create_map(*[F.lit(x) for kv in vocab.STATUS_SCORE.items() for x in kv])
    lvl = F.create_map(*[F.lit(x) for kv in vocab.STATUS_LEVEL.items() for x in kv])
    rows = registry.filter(status.isin(list(vocab.STATUS_SCORE))).select(
        "project", status.alias("kind"),
        F.concat(F.lit("s:"), N.row_id(F.col("file"), F.col("scope"), F.col("name"))).alias("key"),
        lvl[status].alias("level"), score[status].alias("score_int"),
        F.replace(status, F.lit("_"), F.lit(" ")).alias("reason"), F.lit(None).cast("string").alias("verdict"),
        F.lit(False).alias("reviewed"), F.col("name").alias("title"), F.array("file").alias("files"))
    return dup.unionByName(rows)


def issue_order() -> list[Column]:
    """Unreviewed first, then score, then key."""
    return [F.col("reviewed"), F.desc("score_int"), F.col("key")]


def triage(issue_rows: DataFrame, members: DataFrame | None = None, per_project: int = 8, k: int = 12) -> DataFrame:
    """The first k of the merged per-project tops, per group if members are given
    (group_id, repo_id)."""
    tops = top_per_group(issue_rows, ["project"], issue_order(), per_project)
    order = [*issue_order(), F.col("project")]
    if members is None:
        return tops.orderBy(*order).limit(k)
    m = members.withColumnRenamed("repo_id", "project")
    return top_per_group(tops.join(m, "project"), ["group_id"], order, k)


def activity(events: DataFrame, members: DataFrame | None = None, per_project: int = 6, k: int = 10) -> DataFrame:
    """Newest events: at most `per_project` of a project, k of a group."""
    ident = [c for c in ("event_id",) if c in events.columns]
    newest = [F.desc("ts"), *[F.desc(c) for c in ident], F.col("session_id"), F.col("name")]
    tops = top_per_group(events, ["project"], newest, per_project).withColumn(
        "session", F.substring("session_id", 1, 12))
    order = [F.desc("ts"), F.col("project"), *newest[1:]]
    if members is None:
        return tops.orderBy(*order).limit(k)
    m = members.withColumnRenamed("repo_id", "project")
    return top_per_group(tops.join(m, "project"), ["group_id"], order, k)


def gate(pairs: DataFrame, fail_on: str = "high", max_allowed: int = 0) -> DataFrame:
    """One row per project with pairs: does it stay within the allowed number?

    pairs: after dismissals (hidden ones left out)."""
    at = level_rank(F.col("level")) >= vocab.LEVEL_RANK[fail_on]
    found = F.count_if(at)
    return pairs.groupBy("project").agg(
        found.alias("found"), (found <= max_allowed).alias("passed"),
        *[F.count_if(at & (F.col("level") == lv)).alias(lv) for lv in LEVELS])


def gate_offenders(pairs: DataFrame, fail_on: str = "high", k: int = 50) -> DataFrame:
    at = pairs.filter(level_rank(F.col("level")) >= vocab.LEVEL_RANK[fail_on])
    return top_per_group(at, ["project"], [F.desc("score_int"), F.col("pair_key")], k)


# ----------------------------------------------------------------- findings

def findings(pairs: DataFrame, registry: DataFrame, floor: str = "medium", levels: list[str] | None = None,
             statuses: list[str] | None = None, include_reviewed: bool = False) -> DataFrame:
    """Pairs and status rows a remediation pass looks at.

    pairs: from find_duplicates(include_dismissed=include_reviewed)."""
    p = pairs.filter(F.col("level").isin(levels)) if levels else pairs.filter(
        level_rank(F.col("level")) >= vocab.LEVEL_RANK[floor])
    if not include_reviewed:
        p = p.filter(F.coalesce("review.verdict", F.lit("")) != "merged")
    row = ["name", "scope", "file", "line", "repo_line", "value_preview", "repo_value_preview",
           "status", "last_session", "last_written_at", "note"]
    wanted = ["drifted"] if statuses is None else list(statuses)
    s = registry.filter(F.col("status").isin(wanted)).select(
        "project", F.lit("status").alias("section"),
        F.concat_ws("\u0001", "status", "file", "scope", "name").alias("sort_key"), F.struct(*row).alias("row"))
    d = p.select("project", F.lit("duplicate").alias("section"),
                 F.concat(F.lpad((100 - F.col("score_int")).cast("string"), 3, "0"), F.col("pair_key")).alias("sort_key"),
                 F.struct("pair_key", "score_int", "level", "reason", "review", "a", "b").alias("pair"))
    return d.unionByName(s, allowMissingColumns=True)


def batches(finding_rows: DataFrame, limit: int = 25) -> DataFrame:
    """This pass: at most `limit` pairs per project (0 = all), every status row.

    Pairs whose verdict is recorded leave the next findings, so passes converge."""
    if not limit:
        return finding_rows
    dups = top_per_group(finding_rows.filter("section = 'duplicate'"), ["project"], [F.col("sort_key")], limit)
    return dups.unionByName(finding_rows.filter("section = 'status'"))


def evidence_files(finding_rows: DataFrame) -> DataFrame:
    files = F.array_compact(F.array("pair.a.file", "pair.b.file", "row.file"))
    return finding_rows.select("project", F.explode(files).alias("file")).distinct()


def finding_text(finding_rows: DataFrame) -> DataFrame:
    """(project, section, n, text): a Markdown block per finding, numbered in order."""
    numbered = number_rows(finding_rows, ["project", "section"], ["sort_key"])
    n = F.col("n").cast("string")

    def safe(c):
        return X.safe_text(F.col(c))

    def scope(c):
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(" [scope `"), safe(c), F.lit("`]"))).otherwise("")

    def maybe(c, label):
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), safe(c)))

    def side(tag, s):
        line = F.coalesce(F.col(f"{s}.line").cast("string"), F.lit("?"))
        head = F.concat(F.lit(f"- {tag}: `"), safe(f"{s}.name"), F.lit("`"), scope(f"{s}.scope"), F.lit(" = `"),
                        safe(f"{s}.value"), F.lit("` — "), safe(f"{s}.file"), F.lit(":"), line,
                        F.lit(" (status "), F.col(f"{s}.status"), F.lit(", origin "),
                        F.coalesce(f"{s}.origin", F.lit("None")), F.lit(", lang "),
                        F.coalesce(f"{s}.lang", F.lit("None")), F.lit(")"))
        return F.concat_ws("\n", head, maybe(f"{s}.note", "  - human note: "))

    verdict = F.when(F.col("pair.review.verdict").isNotNull(), F.concat(
        F.lit("- prior review verdict: **"), F.col("pair.review.verdict"), F.lit("**"),
        F.coalesce(maybe("pair.review.note", " — "), F.lit(""))))
    dup = F.concat_ws(
        "\n",
        F.concat(F.lit("### D"), n, F.lit(". `"), safe("pair.a.name"), F.lit("` vs `"), safe("pair.b.name"),
                 F.lit("` — "), F.col("pair.reason"),
                 F.format_string(" (score %d.%02d, ", F.floor(F.col("pair.score_int") / 100).cast("int"),
                                 F.col("pair.score_int") % 100),
                 F.col("pair.level"), F.lit(" confidence)")),
        side("A", "pair.a"), side("B", "pair.b"), verdict,
        F.concat(F.lit("- verdict key: `"), F.col("pair.pair_key"), F.lit("`")))
    line = F.coalesce(F.when(F.col("row.repo_line") != 0, F.col("row.repo_line")), F.col("row.line"))
    accept = F.concat(F.lit("- if the change is intended, accept name `"), safe("row.name"), F.lit("` in `"), safe("row.file"), F.lit("`"),
                      F.when(F.coalesce("row.scope", F.lit("")) != "", F.concat(F.lit(", scope `"), safe("row.scope"), F.lit("`"))).otherwise(""))
    what = (F.when(F.col("row.status") == "drifted",
                   F.concat_ws("\n", F.concat(F.lit("- repository holds now: `"), safe("row.repo_value_preview"), F.lit("`")), accept))
            .when(F.col("row.status") == "missing",
                  "- no longer present in the file: check whether it was renamed, moved or removed on purpose")
            .when(F.col("row.status") == "file_deleted",
                  "- the tracked file no longer exists: check that this was meant and that nothing refers to the variable"))
    status = F.concat_ws(
        "\n",
        F.concat(F.lit("### S"), n, F.lit(". `"), safe("row.name"), F.lit("`"), scope("row.scope"), F.lit(" — "),
                 F.col("row.status"), F.lit(" ("), safe("row.file"), F.lit(":"),
                 F.coalesce(line.cast("string"), F.lit("?")), F.lit(")")),
        F.concat(F.lit("- AI-written value: `"), safe("row.value_preview"), F.lit("` (session "),
                 F.substring(F.coalesce("row.last_session", F.lit("?")), 1, 8), F.lit(", "),
                 F.coalesce(F.date_format("row.last_written_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("?")), F.lit(")")),
        what, maybe("row.note", "- human note: "))
    return numbered.select("project", "section", "n",
                           F.when(F.col("section") == "duplicate", dup).otherwise(status).alias("text"))


# ------------------------------------------------------------------- report

def report(registry: DataFrame, pairs: DataFrame, top: int = 400) -> dict[str, DataFrame]:
    """The report tables.  pairs: staged, with dismissed ones included.

    vars: `place` is a variable's position in its project (rows without a scope
    first, then by file and line), `dup_level` the level of its best pair."""
    best = report_pairs(pairs, top)
    shown = registry.select(
        "project", N.row_id(F.col("file"), F.col("scope"), F.col("name")).alias("id"), "name", "file", "scope",
        F.coalesce(F.when(F.col("repo_line") != 0, F.col("repo_line")), F.col("line")).alias("line"),
        F.col("value_preview").alias("value"), "status", "origin", "lang", "note",
        (F.col("scope") != "").alias("_scoped"), F.coalesce("line", F.lit(0)).alias("_line"))
    placed = number_rows(shown, ["project"], ["_scoped", "file", "_line", "id"], "place").drop("_scoped", "_line")
    levels = var_level(pairs).withColumnRenamed("level", "dup_level")
    omitted = pairs.groupBy("project").agg(
        F.greatest(F.count(F.lit(1)) - top, F.lit(0)).alias("omitted"))
    return {
        "vars": placed.join(levels, ["project", "id"], "left").orderBy("project", "place"),
        "pairs": best.orderBy("project", F.desc("score_int"), "pair_key"),
        "omitted": omitted,
        "level_counts": level_counts(pairs),
        "review_counts": review_counts(pairs),
        "counts": origin_status_counts(registry),
        "var_level": var_level(pairs),
    }


# ------------------------------------------------------------------- recall

RECALL_KEEP = {"drifted": 10, "missing": 10, "file_deleted": 5}


def recent_pool(registry: DataFrame, limit: int = 25) -> DataFrame:
    """Active rows worth recalling: module level first, then the newest."""
    newest = [F.desc_nulls_last("last_written_at"), *[F.col(c) for c in KEY]]
    pool = registry.filter("status = 'active'").filter((F.col("scope") == "") | (F.length("name") > 1))
    return top_per_group(pool, ["project"], [N.scope_depth(F.col("scope")), *newest], limit)


def recall(registry: DataFrame, pairs: DataFrame | None = None, limit: int = 25, max_chars: int = 6000,
           keep: dict[str, int] | None = None) -> DataFrame:
    """One text block per project: what a new session should know.

    Every section is a bounded top-k (`keep` by status, `limit` recent rows), so
    a project's lines fit one group; a cut text says how much it leaves out."""
    keep = keep or RECALL_KEEP
    newest = [F.desc_nulls_last("last_written_at"), *[F.col(c) for c in KEY]]
    line = F.coalesce(F.when(F.col("repo_line") != 0, F.col("repo_line")), F.col("line")).cast("string")
    scope = F.when(F.col("scope") != "", F.concat(F.lit(" ["), F.col("scope"), F.lit("]"))).otherwise("")
    shown = F.concat(F.lit("- `"), F.col("name"), F.lit("`"), scope, F.lit(" = `"),
                     F.coalesce("value_preview", F.lit("")), F.lit("` ("), F.col("file"), F.lit(":"),
                     F.coalesce(line, F.lit("")), F.lit(")"))
    gone = registry.filter(F.col("status").isin(list(keep)))
    cap = F.create_map(*[F.lit(x) for kv in keep.items() for x in kv])
    top = top_per_group(gone.withColumn("_cap", cap[F.col("status")]), ["project", "status"], newest,
                        max(keep.values()))
    from pyspark.sql import Window
    place = F.row_number().over(Window.partitionBy("project", "status").orderBy(*newest))
    top = top.withColumn("ord", place).filter("ord <= _cap")
    text = (F.when(F.col("status") == "drifted", F.concat(
                shown, F.lit("\n  repo now: `"), F.coalesce("repo_value_preview", F.lit("")), F.lit("`")))
            .when(F.col("status") == "missing", F.concat(
                F.lit("- `"), F.col("name"), F.lit("` was in "), F.col("file"), F.lit(" (last written "),
                F.coalesce(F.date_format("last_written_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")), F.lit(")")))
            .otherwise(F.concat(F.lit("- "), F.col("file"), F.lit(" (held `"), F.col("name"), F.lit("`)"))))
    number = F.when(F.col("status") == "drifted", 2).when(F.col("status") == "missing", 3).otherwise(4)
    pool = recent_pool(registry, limit)
    depth_order = [N.scope_depth(F.col("scope")), *newest]
    recent = pool.select("project", F.lit(5).alias("section"), F.row_number().over(
        Window.partitionBy("project").orderBy(*depth_order)).alias("ord"), shown.alias("text"))
    s = stats(registry)
    by_status = F.array_join(F.transform(F.array_sort(F.map_entries("by_status")),
                                         lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    head = s.select("project", F.lit(0).alias("section"), F.lit(0).alias("ord"), F.concat(
        F.lit("## Assignments written in earlier sessions\n"),
        F.format_string("Tracked: %d assignments across %d files (%d sessions). Statuses: %s.",
                        "total", "files", "sessions", by_status)).alias("text"))
    parts = head.unionByName(top.select("project", number.alias("section"), "ord", text.alias("text"))).unionByName(recent)
    if pairs is not None:
        n = {lv: F.count_if(F.col("level") == lv).alias(lv) for lv in LEVELS}
        summary = pairs.groupBy("project").agg(*n.values()).select(
            "project", F.lit(1).alias("section"), F.lit(0).alias("ord"), F.format_string(
                "Suspected duplicates: %d high, %d medium, %d low. A name for the same thing may be among them.",
                *LEVELS).alias("text"))
        parts = parts.unionByName(summary)
    titles = F.create_map(
        F.lit(2), F.lit("\n### Changed in the repo since they were written (drifted)\n"),
        F.lit(3), F.lit("\n### No longer present in their file (missing)\n"),
        F.lit(4), F.lit("\n### Tracked files deleted from the repo\n"),
        F.lit(5), F.lit(f"\n### Recently written (module-level first, up to {limit})\n"))
    first = (F.col("ord") == 1) & (F.col("section") >= 2)
    parts = parts.withColumn("text", F.when(first, F.concat(titles[F.col("section")], F.col("text"))).otherwise(F.col("text")))
    lines = F.array_sort(F.collect_list(F.struct("section", "ord", "text")))
    whole = parts.groupBy("project").agg(F.array_join(F.transform(lines, lambda t: t["text"]), "\n").alias("text"))
    kept = max_chars - 40
    cut = F.concat(F.substring("text", 1, kept), F.format_string("\n…(%d characters left out)", F.length("text") - kept))
    return whole.withColumn("text", F.when(F.length("text") > max_chars, cut).otherwise(F.col("text")))
