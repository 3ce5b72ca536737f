"""Reading and writing tables and file trees."""
import json

from pyspark.sql import functions as F

from bindery.plans import reports as G
from bindery.plans import views as H
from bindery.plans.analyze import baseline
from bindery.operators import groups as I
from bindery.operators.ranking import number_rows
from bindery.schema import REGISTRY
from bindery.sources import corpus as C
from bindery.sources import tables as T


def tree(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_corpus_scan_prunes_and_decodes(spark, tmp_path):
    tree(tmp_path / "my repo", {
        "src/a.py": "A = 1\n", "node_modules/b.py": "B = 1\n", "dist": "", "x/.venv/c.py": "", "big.py": "x" * 3000,
        "bad.sh": b"A=\xff\n", "pkg/__init__.py": "B = 2\n", ".env.local": "K=1\n", "notes.txt": "x = 1"})
    tree(tmp_path / "build", {"a.go": "x := 1\n", "gen/b.go": "y := 1\n", "deep/gen/c.go": "", "cache/api/d.go": "", "api/e.go": ""})
    corpus = C.corpus_scan(spark, [str(tmp_path / "my repo"), str(tmp_path / "build")], max_kb=2)
    got = {(r.project, r.path): r.content for r in corpus.collect()}
    assert set(got) == {("my repo", "src/a.py"), ("my repo", "bad.sh"), ("my repo", "pkg/__init__.py"), ("my repo", ".env.local"), ("build", "a.go"),
                        ("build", "gen/b.go"), ("build", "deep/gen/c.go"), ("build", "cache/api/d.go"), ("build", "api/e.go")}
    assert got["my repo", "bad.sh"] == "A=\ufffd\n"
    lines = spark.createDataFrame([("build", x) for x in ("gen/", "# x", "/cache/api", "!api", "*.go", "")], "project string, line string")
    left = C.ignore_prune(corpus, C.ignore_rules(lines))
    early = C.corpus_scan(spark, [str(tmp_path / "build")], rules=C.ignore_rules(lines))
    assert {r.path for r in early.collect()} == {"a.go", "api/e.go"}
    assert {r.path for r in left.filter("project = 'build'").collect()} == {"a.go", "api/e.go"}
    assert left.filter("project = 'my repo'").count() == 4


def test_own_ignore_files_prune_their_trees(spark, tmp_path):
    tree(tmp_path / "one", {".gitignore": "# made\n/gen/\ntmp\n*.log\n!keep\n", "gen/a.py": "A = 1", "src/gen/b.py": "B = 1",
                            "src/deep/er/tmp/c.py": "C = 1", "src/deep/er/d.py": "D = 1", ".env": "E=1"})
    tree(tmp_path / "two", {"gen/a.py": "A = 1", "tmp/.env": "E=1", "sub/.gitignore": "x\n", "sub/x/y.py": "Y = 1"})
    roots = [str(tmp_path / "one"), str(tmp_path / "two")]
    got = {(r.project, r.path) for r in C.corpus_scan(spark, roots).collect()}
    assert got == {("one", "src/deep/er/d.py"), ("one", ".env"), ("two", "gen/a.py"),
                   ("two", "tmp/.env"), ("two", "sub/x/y.py")}
    assert C.corpus_scan(spark, roots, own_rules=False).count() == 8


def test_registry_and_review_files(spark, tmp_path):
    corpus = spark.createDataFrame([("p", "a.py", "A = 'one|two'\nB = 2\n"), ("q", "a.py", "A = 1\n")],
                                   "project string, path string, content string")
    reg = baseline(corpus, "2024-01-01").persist()
    T.write_registry(reg, str(tmp_path / "r"))
    T.write_registry(reg.filter("project = 'p' and name = 'B'"), str(tmp_path / "r"))
    back = T.read_registry(spark, str(tmp_path / "r"))
    assert back.schema.fieldNames() and {(r.project, r.name) for r in back.collect()} == {("p", "B"), ("q", "A")}
    row = {"project": "p", "file": "a.py", "scope": "", "name": "A", "line": 1}
    (tmp_path / "r.jsonl").write_text(json.dumps(row) + "\n{broken\n" + json.dumps({**row, "name": "B"}) + "\n")
    assert T.read_registry(spark, str(tmp_path / "r.jsonl"), "json").count() == 2
    tree(tmp_path / "reviews", {"p/reviews.json": json.dumps({" b.py||B||a.py||A": {"verdict": "duplicate", "note": None}})})
    got = T.read_reviews(spark, str(tmp_path / "reviews/*")).collect()
    assert [(r.project, r.pair_key, r.verdict) for r in got] == [("p", "a.py||A||b.py||B", "duplicate")]
    md = {r.value for r in T.export(reg.filter("name = 'A' and project = 'p'"), "md").collect()}
    assert md == {*T.MD_HEADER, "| `A` |  | `'one\\|two'` | active | a.py:1 | scan |"}


def test_number_rows_spreads_and_counts(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
                                  F.sha1(F.col("id").cast("string")).alias("k"))
    rows = {(r.g, r.k): r.n for r in number_rows(df, ["g"], ["k"]).collect()}
    by = {}
    for g, k in rows:
        by.setdefault(g, []).append(k)
    assert all(rows[g, k] == i for g, ks in by.items() for i, k in enumerate(sorted(ks), 1)) and len(rows) == 5000


def test_pages_and_queries(spark):
    corpus = spark.createDataFrame([("p", f"f{i}.py", f"NAME_{i} = {i}\nother_{i} = 1\n") for i in range(30)],
                                   "project string, path string, content string")
    reg = baseline(corpus, "2024-01-01")
    last = H.page(reg, [F.col("file"), F.col("name")], page=99, size=25).collect()
    assert len(last) == 10 and (last[0].page, last[0].pages, last[0].total) == (3, 3, 60)
    assert H.query(reg, "name_1*").count() == 11 and H.query(reg, limit=7).count() == 7
    text = G.recall(reg).collect()[0].text
    assert text.startswith("## Assignments") and "Tracked: 60 assignments across 30 files" in text and len(text) <= 6000


def test_groups(spark):
    repos = spark.createDataFrame([("1", "C:\\code\\api"), ("2", "/c/code/web"), ("3", "/srv/x"), ("4", "/srv/xy")], "repo_id string, path string")
    c = [("/a", {"com.docker.compose.project": "shop"}, [("bind", "/run/desktop/mnt/host/c/code/api/src"), ("volume", "/srv/x")]),
         ("/b", {"com.docker.compose.project": "shop"}, [("bind", "/mnt/c/Code/Web")]),
         ("/c", {}, [("bind", "/srv")]), ("/d", {}, [("bind", "/srv/x")])]
    containers = spark.createDataFrame(c, "name string, labels map<string,string>, mounts array<struct<Type:string,Source:string>>")
    groups = spark.createDataFrame([("g", "Shop", ["2", "1"], ["shop"], True)],
                                   "group_id string, name string, repo_ids array<string>, compose_projects array<string>, confirmed boolean")
    s = I.suggest_groups(I.match_mounts(containers, repos), groups)
    assert {(r.name, tuple(r.repo_ids), r.already_grouped) for r in s.collect()} == {
        ("shop", ("1", "2"), True), ("container c", ("3", "4"), False)}
    once = I.confirm(s, groups)
    assert once.count() == 2 and I.confirm(s, once).count() == 2


def test_schema_is_the_documented_one():
    assert len(REGISTRY.fieldNames()) == 22


def test_task_functions_travel_with_the_job():
    from pyspark.cloudpickle import cloudpickle

    assert "bindery" in cloudpickle.list_registry_pickle_by_value()


def test_an_emptied_project_loses_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([("p", "a.py", "A = 1\n"), ("q r", "b.py", "B = 1\n"), ("s", "c.py", "C = 1\n")],
                                 "project string, path string, content string")
    reg, path = baseline(rows, "2024-01-01"), str(tmp_path / "r")
    T.write_registry(reg, path)
    touched = spark.createDataFrame([("p",), ("q r",)], "project string")
    T.write_registry(baseline(rows.filter("project = 'p'"), "2024-01-02"), path, touched)
    assert {r.project for r in T.read_registry(spark, path).collect()} == {"p", "s"}


def many_files(spark, n=40):
    rows = [("p", f"f{i}.py", f"A = {i}\nB = 1\n") for i in range(n)] + [("q", "a.py", "C = 1\n"), ("r", "z.py", "D = 1\n")]
    return baseline(spark.createDataFrame(rows, "project string, path string, content string"), "2024-01-01")


def data_files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def content(spark, path):
    return sorted((r.project, r.file, r.name, r.note or "") for r in T.read_registry(spark, str(path)).collect())


def test_a_registry_is_written_over_its_own_source(spark, tmp_path):
    path = tmp_path / "r"
    T.write_registry(many_files(spark), str(path))
    reg = T.read_registry(spark, str(path))
    touched = spark.createDataFrame([("p",), ("q",)], "project string")
    T.write_registry(reg.filter("project = 'p' and name = 'A'").withColumn("note", F.lit("seen")), str(path), touched)
    assert content(spark, path) == sorted([("p", f"f{i}.py", "A", "seen") for i in range(40)] + [("r", "z.py", "D", "")])
    assert not [p for p in path.iterdir() if p.name.startswith("_swap")]


def test_one_file_rewrites_one_shard(spark, tmp_path):
    path = tmp_path / "r"
    T.write_registry(many_files(spark), str(path))
    before = data_files(path)
    reg = T.read_registry(spark, str(path))
    one = F.col("file") == "f7.py"
    shard = reg.filter(one).select(F.pmod(F.hash("file"), F.lit(T.SHARDS))).first()[0]
    T.write_registry(reg.filter(~(one & (F.col("name") == "B"))), str(path), spark.createDataFrame([("p", "f7.py")], "project string, file string"))
    after = data_files(path)
    assert {f for f in before ^ after} and all(f.startswith(f"project=p/shard={shard}/") for f in before ^ after)
    assert len(content(spark, path)) == 81 and ("p", "f7.py", "B", "") not in content(spark, path)
    # the only file of a shard loses its last row: the shard goes
    T.write_registry(T.read_registry(spark, str(path)).filter("project <> 'q'"), str(path),
                     spark.createDataFrame([("q", "a.py")], "project string, file string"))
    assert not [f for f in data_files(path) if f.startswith("project=q/")] and len(content(spark, path)) == 80


def test_a_broken_off_swap_is_finished(spark, tmp_path, monkeypatch):
    path = tmp_path / "r"
    T.write_registry(many_files(spark), str(path))
    reg, done = T.read_registry(spark, str(path)).withColumn("note", F.lit("new")), []

    def rename(*args, real=T.folders.rename):
        if len(done) == 5:
            raise OSError("lost")
        done.append(real(*args))

    with monkeypatch.context() as m:
        m.setattr(T.folders, "rename", rename)
        try:
            T.write_registry(reg, str(path))
        except OSError:
            pass
    assert len(done) == 5
    T.recover_registry(spark, str(path))
    T.recover_registry(spark, str(path))
    rows = content(spark, path)
    assert len(rows) == 82 and {r[3] for r in rows} == {"new"}
    # one that had not come to swapping changes nothing
    (path / "_swap-x" / "rows").mkdir(parents=True)
    T.recover_registry(spark, str(path))
    assert content(spark, path) == rows and not (path / "_swap-x").exists()


def test_microseconds_survive_the_event_log(spark, tmp_path):
    events = spark.createDataFrame([("p", "s", "a")], "project string, session_id string, action string").selectExpr(
        "project", "timestamp '2024-05-06 07:08:09.123456' ts", "session_id", "action", "'n' name", "'f' file", "'' scope", "'' detail")
    T.append_events(events, str(tmp_path / "e"))
    assert T.read_events(spark, str(tmp_path / "e")).first().ts.microsecond == 123456
