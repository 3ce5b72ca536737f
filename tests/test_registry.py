"""Registry sequences: write, edit, drift, move, delete, scan, accept."""
import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from bindery.operators import registry as R
from bindery.operators.extract import extract_assignments
from bindery.plans.analyze import baseline
from bindery.schema import CHANGE_EVENTS, REGISTRY, REGISTRY_COLUMNS
from bindery.sources.versions import VersionTable
from bindery.staging import stage
from bindery.streaming import capture as J
from bindery.streaming import feed as F_

T0 = "2024-01-01 00:00:00"


def corpus(spark, files, project="p"):
    return spark.createDataFrame([(project, k, v) for k, v in files.items()], "project string, path string, content string")


def found(spark, files):
    return R.described(extract_assignments(corpus(spark, files)))


def names(df, col="status"):
    return {r["name"]: r[col] for r in df.collect()}


def files_of(spark, *paths):
    return spark.createDataFrame([("p", f) for f in paths], "project string, file string")


def test_scan_claims_and_prunes(spark):
    reg = baseline(corpus(spark, {"a.py": "A = 1\nB = 2\n", "b.py": "C = 3\n", "gone/x.py": "D = 4\n"}), T0)
    claimed = R.upsert(reg, found(spark, {"a.py": "A = 1\n"}), as_of=T0, origin="claude", session="s1").select(*REGISTRY_COLUMNS)
    assert names(claimed, "origin") == {"A": "claude", "B": "scan", "C": "scan", "D": "scan"}
    again, counts = R.scan(claimed, found(spark, {"a.py": "A = 9\n", "b.py": "C = 4\nE = 1\n"}),
                           files_of(spark, "a.py", "b.py"), T0)
    assert names(again) == {"A": "drifted", "C": "active", "E": "active"}
    assert names(again, "origin") == {"A": "claude", "C": "scan", "E": "scan"}
    assert {r.action: r.rows for r in counts.collect()} == {"refreshed": 1, "updated": 1, "added": 1, "pruned": 2}
    once, _ = R.scan(again, found(spark, {"a.py": "A = 9\n", "b.py": "C = 4\nE = 1\n"}), files_of(spark, "a.py", "b.py"), T0)
    assert sorted(map(tuple, once.select(*REGISTRY_COLUMNS).collect())) == sorted(map(tuple, again.select(*REGISTRY_COLUMNS).collect()))


def test_drift_accept_move_delete(spark):
    src = {"a.py": "MAX_CONN = 1\nDB_URL = 'x'\ndef f():\n    inner = 5\n", "b.py": "OTHER = 1\n"}
    reg = R.upsert(spark.createDataFrame([], REGISTRY), found(spark, src), as_of=T0, origin="claude", session="s1").select(*REGISTRY_COLUMNS)
    now = {"a.py": "MAX_CONN = 999\ndef g():\n    inner = 5\n"}
    out = R.reconcile(reg, found(spark, now), files_of(spark, "a.py"), "2024-02-01").persist()
    assert names(out) == {"MAX_CONN": "drifted", "DB_URL": "missing", "inner": "active", "OTHER": "file_deleted"}
    assert names(out, "scope")["inner"] == "g" and names(out, "repo_value_preview")["MAX_CONN"] == "999"
    events = {(r.action, r.name) for r in R.transition_events(out, "rec", "2024-02-01").collect()}
    assert events == {("drifted", "MAX_CONN"), ("went_missing", "DB_URL"), ("moved", "inner"), ("file_deleted", "OTHER")}
    t = R.reconcile_totals(out).collect()[0]
    assert (t.files, t.checked, t.active, t.drifted, t.missing, t.file_deleted, t.moved) == (2, 3, 1, 1, 1, 1, 1)
    ok = R.accept_drift(out.select(*REGISTRY_COLUMNS), "2024-02-02", pattern="MAX*")
    assert names(ok)["MAX_CONN"] == "active" and ok.filter("accepted").count() == 1
    later = R.reconcile(ok.select(*REGISTRY_COLUMNS), found(spark, {"a.py": "MAX_CONN = 7\n"}), files_of(spark, "a.py"), "2024-03-01")
    assert names(later)["MAX_CONN"] == "drifted"
    quiet = R.transition_events(R.reconcile(out.select(*REGISTRY_COLUMNS), found(spark, now), files_of(spark, "a.py"), T0), "r", T0)
    assert quiet.count() == 0
    with pytest.raises(ValueError):
        R.accept_drift(reg, T0)


def test_moved_needs_one_occurrence_and_a_free_key(spark):
    reg = baseline(corpus(spark, {"a.py": "x_val = 1\ndef f():\n    x_val = 1\n", "b.py": "y_val = 1\n", "c.py": "z_val = 1\n"}), T0)
    now = {"a.py": "def f():\n    x_val = 1\n", "b.py": "def f():\n    y_val = 1\n    y_val = 2\n", "c.py": "def f():\n    z_val = 1\n"}
    out = R.reconcile(reg, found(spark, now), files_of(spark, "a.py", "b.py", "c.py"), T0)
    assert {(r.file, r.old_scope, r.scope, r.outcome) for r in out.collect()} == {
        ("a.py", "", "", "missing"), ("a.py", "f", "f", "active"), ("b.py", "", "", "missing"), ("c.py", "", "f", "active")}


def test_unchanged_files_are_skipped(spark):
    reg = baseline(corpus(spark, {"a.py": "A = 1\n", "b.py": "B = 1\n"}), T0)
    meta = spark.createDataFrame([("p", "a.py", dt.datetime(2023, 1, 1)), ("p", "b.py", dt.datetime(2025, 1, 1))],
                                 "project string, path string, modificationTime timestamp")
    assert [r.file for r in R.changed_files(reg, meta).collect()] == ["b.py"]
    assert R.changed_files(reg, meta, force=True).count() == 2


def change(i, tool, content, new="", edits=None, session="s1", path="/w/p/src/a.py", ts=None):
    return ("p", i, ts or dt.datetime(2024, 1, 1, 0, i), session, "/w/p", tool, (path, content, new, edits or []), content)


SEQUENCE = [
    change(1, "Write", "MAX_CONN = 1\nDB_URL = 'x'\n"),
    change(2, "Edit", "MAX_CONN = 2\nDB_URL = 'x'\nhuman = 1\n", "MAX_CONN = 2", session="s2"),
    change(3, "Edit", "MAX_CONN = 3\nDB_URL = 'x'\n", "nothing"),
    change(4, "MultiEdit", "MAX_CONN = 4\n", edits=[("MAX_CONN = 4",)], session="s3"),
    change(5, "Read", "MAX_CONN = 5\n"),
    change(6, "Write", "", path="/w/p/src/b.py"),
]


def run_capture(spark, tmp_path, batches):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, CHANGE_EVENTS).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(CHANGE_EVENTS).parquet(inbox)
        J.capture_stream(stream, out, f"{out}/check").awaitTermination()
    newest = {r["name"]: r for r in J.captured_state(spark, out).collect()}
    log = spark.read.json(f"{out}/events").orderBy("ts").collect()
    return newest, [(r.action, r.name) for r in log]


def test_capture_stream(spark, tmp_path):
    newest, log = run_capture(spark, tmp_path / "one", [SEQUENCE])
    parts, parts_log = run_capture(spark, tmp_path / "many", [SEQUENCE[:1], SEQUENCE[1:3], SEQUENCE[3:]])
    assert newest == parts and sorted(log) == sorted(parts_log)
    assert set(newest) == {"MAX_CONN", "DB_URL"}
    conn = newest["MAX_CONN"]
    assert (conn.status, conn.first_session, conn.last_session, conn.value_preview) == ("active", "s1", "s3", "4")
    assert newest["DB_URL"].status == "missing"
    assert sorted(log) == [("added", "DB_URL"), ("added", "MAX_CONN"), ("updated", "MAX_CONN"), ("updated", "MAX_CONN"),
                           ("went_missing", "DB_URL")]


def test_a_micro_batch_of_one_file_is_spread(spark, tmp_path, monkeypatch):
    read = {}

    def staged(df, name, plain=J.stage):
        table = plain(df, name)
        read[name] = len(table.inputFiles())
        return table

    monkeypatch.setattr(J, "stage", staged)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        newest, _ = run_capture(spark, tmp_path, [[change(i, "Write", f"A{i} = 1\n", path=f"/w/p/src/f{i}.py") for i in range(1, 41)]])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(newest) == 40 and read["micro-batch"] > 1


def test_late_events_are_told_from_the_extracted_rows(spark):
    changes = spark.createDataFrame(SEQUENCE, CHANGE_EVENTS)
    prior = stage(J.apply_changes(spark.createDataFrame([], REGISTRY), spark.createDataFrame(SEQUENCE[3:4], CHANGE_EVENTS))[0].select(
        *REGISTRY_COLUMNS), "t")
    rows, _, late = J.apply_changes(prior, changes)
    assert "EvalPython" not in late._jdf.queryExecution().sparkPlan().toString()
    assert sorted(r.event_id for r in late.collect()) == [1, 2, 3]
    assert {r.name: r.status for r in rows.collect()}["MAX_CONN"] == "active"


def test_capture_of_a_large_file_and_the_rejects(spark, tmp_path):
    large = "A = 1\n" + "# note\n" * 200000 + "Z = 2\n"
    newest, _ = run_capture(spark, tmp_path, [[change(1, "Write", large), change(2, "Bash", "B = 1\n"),
                                               change(3, "Write", "C = 1\n", path="/other/a.py")]])
    assert set(newest) == {"A", "Z"}
    rejects = spark.read.parquet(f"{tmp_path}/out/rejects")
    assert {(r.event_id, r.file, r.reason) for r in rejects.collect()} == {
        (2, "src/a.py", "tool 'Bash' not captured"), (3, "/other/a.py", "outside project root")}
    bounded = J.apply_changes(spark.createDataFrame([], REGISTRY), spark.createDataFrame(
        [change(1, "Write", large)], CHANGE_EVENTS), {"max_file_kb": 1024})
    assert bounded[0].count() == 0


def test_an_event_delivered_again_counts_once(spark, tmp_path):
    first, again = [SEQUENCE[0], SEQUENCE[0], SEQUENCE[1]], [SEQUENCE[0], SEQUENCE[1], SEQUENCE[2]]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (first, again):
        spark.createDataFrame(rows, CHANGE_EVENTS).coalesce(1).write.mode("append").parquet(inbox)
        J.capture_stream(spark.readStream.schema(CHANGE_EVENTS).parquet(inbox), out, f"{out}/check", delay="1 hour").awaitTermination()
    log = sorted((r.action, r.name) for r in spark.read.json(f"{out}/events").collect())
    assert log == [("added", "DB_URL"), ("added", "MAX_CONN"), ("updated", "MAX_CONN")]
    _, log = run_capture(spark, tmp_path / "one", [first])
    assert sorted(log) == [("added", "DB_URL"), ("added", "MAX_CONN"), ("updated", "MAX_CONN")]
    assert [(r.event_id, r.reason) for r in spark.read.parquet(f"{tmp_path}/one/out/rejects").collect()] == [(1, "delivered before")]


def test_versions_of_fifty_epochs(spark, tmp_path):
    schema = "k string, place string, v long, epoch long"
    path = str(tmp_path / "versions")
    table = VersionTable(spark, path, spark.createDataFrame([], schema).schema, ["k", "place"], ["place"], buckets=8, fan=4)
    want, opened = {}, []
    for epoch in range(50):
        rows = [(f"k{(epoch * 7 + i) % 23}", f"f{(epoch + i) % 5}", epoch * 10 + i, None) for i in range(6)]
        table.compact(epoch)
        if epoch == 33:
            table.compact(epoch)
        table.write(spark.createDataFrame(rows, schema), epoch)
        want |= {r[:2]: (r[2], epoch) for r in rows}
        opened.append(len(table.runs()[0]))
        if epoch == 20:
            before = dict(want)
    assert {(r.k, r.place): (r.v, r.epoch) for r in table.read().collect()} == want
    # one epoch's worth of runs and at most fan of each length, however many epochs there are
    assert max(opened) <= 3 * 4
    # a look-up reads the buckets of its files alone
    one = spark.createDataFrame([("f3",)], "place string")
    some = table.read(files=one)
    assert {(r.k, r.place): (r.v, r.epoch) for r in some.collect()} == {k: v for k, v in want.items() if k[1] == "f3"}
    assert {re.search(r"bucket=(\d+)", f)[1] for f in some.inputFiles()} == {str(one.select(table.bucket()).first()[0])}
    # a merge that was broken off counts for nothing, and a run that was rewritten replaces what it had
    os.makedirs(f"{path}/run=0-63")
    assert table.read().count() == len(want)
    table.write(spark.createDataFrame([("new", "f1", 1, None)], schema), 49)
    assert ("new", "f1") in {(r.k, r.place) for r in table.read().collect()}
    assert {(r.k, r.place) for r in table.read(before=16).collect()} <= set(before)


def test_capture_leaves_no_scratch_tables(spark, tmp_path):
    staged = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(staged))
    run_capture(spark, tmp_path, [SEQUENCE[:2], SEQUENCE[2:]])
    assert set(os.listdir(staged)) == before


def test_the_change_feed_shows_deletions(spark, tmp_path):
    path = str(tmp_path / "feed")
    reg = baseline(corpus(spark, {"a.py": "A = 1\nB = 2\n", "b.py": "C = 3\n"}), T0).persist()
    later = reg.filter("name <> 'B'").withColumn("status", F.when(F.col("name") == "C", "drifted").otherwise(F.col("status")))
    F_.publish(reg, path, 1)
    F_.publish(later, path, 2)
    F_.publish(reg.filter("false"), path, 2)  # a complete version stays
    F_.publish(reg, path, 5)
    for _ in range(2):
        sink = F_.tail_changes(spark, path, maxFilesPerTrigger=1).writeStream.format("parquet")
        sink.option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start(f"{path}/seen").awaitTermination()
    got = {(r.version, r.op, r.name, r.before and r.before.status, r.after and r.after.status)
           for r in spark.read.parquet(f"{path}/seen").collect()}
    assert got == {(1, "insert", n, None, "active") for n in "ABC"} | {
        (2, "delete", "B", "active", None), (2, "update", "C", "active", "drifted"),
        (5, "insert", "B", None, "active"), (5, "update", "C", "drifted", "active")}
    assert sorted(p.name for p in (tmp_path / "feed").glob("snapshot=*")) == ["snapshot=2", "snapshot=5"]


def test_second_feed_and_rejects(spark):
    rows = [change(1, "Write", "A = 1\n", session="kilo:x"), change(2, "Write", "A = 1\n", session="7"),
            change(3, "Bash", "A = 1\n"), change(4, "Write", "A = 1\n", path="/other/a.py"),
            change(5, "Write", "A = 1\n", path="/w/p/node_modules/a.py"), change(6, "Write", "A = 1\n", path="/w/p/a.txt"),
            change(7, "Write", "A = 1\n" * 200000), change(8, "Write", None)]
    named = R.namespace_sessions(spark.createDataFrame(rows, CHANGE_EVENTS))
    assert R.validate_changes(named).filter("event_id = 7 and reason is null").count() == 1
    df = R.validate_changes(named, {"max_file_kb": 1024})
    got = {r.event_id: (r.session_id, r.reason) for r in df.collect()}
    assert got[1] == ("kilo:x", None) and got[2] == ("kilo:7", None)
    assert [got[i][1] for i in range(3, 9)] == ["tool 'Bash' not captured", "outside project root", "excluded dir",
                                                "unsupported language", "file too large", "unreadable file"]


def test_debounce_table_equals_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    rows = [("p", at(s)) for s in (0, 1, 1.9, 3.5, 9, 10.9, 30)] + [("q", at(1))]
    df = spark.createDataFrame(rows, "project string, ts timestamp")
    path = str(tmp_path / "c")
    df.coalesce(1).write.parquet(path)
    want = {("p", at(0), 4), ("p", at(9), 2), ("p", at(30), 1), ("q", at(1), 1)}
    assert {(r.project, r.started, r.changes) for r in J.debounce(df).collect()} == want
    stream = J.debounce(spark.readStream.schema(df.schema).parquet(path), watermark="0 seconds")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.project, r.started, r.changes) for r in spark.table("bursts").collect()} == want


def test_annotate(spark):
    reg = baseline(corpus(spark, {"a.py": "A = 1\n", "b/a.py": "A = 1\n"}), T0)
    out = R.annotate(reg, "A", "keep", "b/")
    assert {r.file: r.note for r in out.collect()} == {"a.py": None, "b/a.py": "keep"}
    assert out.filter(F.col("annotated")).count() == 1
