"""Operators on vectors, captures and pages, and the pipeline."""
import numpy as np
import pytest
from corpora import documents, frame, rows_of
from pyspark.sql import functions as F

from bindery.llm import learnedparts, sitelines, urllists

KIND = "vec_id long, embedding array<float>, label int, id long, part int"


def vectors(n, seed=0, copies=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, 16))
    x[:copies] = x[0]
    return [(i, [float(np.float32(v)) for v in r], 0, 1, 2) for i, r in enumerate(x)]


ODD = [(None, [1.0] * 16, 0, 1, 2), (9001, None, 0, 1, 2), (9002, [0.0] * 16, 0, 1, 2), (9003, [], 0, 1, 2),
       (9004, [float("nan")] + [1.0] * 15, 0, 1, 2), (9005, [float("inf")] + [1.0] * 15, 0, 1, 2),
       (9006, [None] + [1.0] * 15, 0, 1, 2), (9050, [1.0] * 3, 0, 1, 2)]


def exact(rows, every):
    rows = list(dict((r[0], r) for r in rows).values())
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        near = np.round(x @ x[q], 10)
        near[q] = -2
        out[ids[q]] = [(int(ids[i]), near[i]) for i in np.lexsort((ids, -near))[:5] if i != q]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 10)))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block", [4096, 64])
def test_neighbours_are_exact_where_every_part_is_asked(spark, block, monkeypatch):
    monkeypatch.setattr(learnedparts, "BLOCK", block)
    monkeypatch.setattr(learnedparts, "CHUNK", max(8, block // 16))
    rows = vectors(600)
    df = spark.createDataFrame(rows + ODD + [rows[3]], KIND)
    got = found(learnedparts.nearest(df, F.col("vec_id") % 10 == 0, share=2.0, part_rows=100))
    assert got == exact(rows, 10)


def test_neighbours_routed_to_few_parts_reach_the_recall(spark):
    rows = vectors(3000, seed=5, copies=1)
    df = spark.createDataFrame(rows, KIND)
    got, want = found(learnedparts.nearest(df, F.col("vec_id") % 10 == 0, part_rows=150)), exact(rows, 10)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame(vectors(3, copies=0), KIND)
    assert found(learnedparts.nearest(few, F.lit(True))) == exact(vectors(3, copies=0), 1)
    for rows in ([], ODD[1:7]):
        assert learnedparts.nearest(spark.createDataFrame(rows, KIND), F.lit(True)).count() == 0


def test_parts_are_balanced():
    x = np.array([r[1] for r in vectors(900, copies=300)])
    near = np.argsort(-(x @ x.T), axis=1)[:, :5]
    sizes = np.bincount(learnedparts.balanced_parts(x, near, 9), minlength=9)
    assert sizes.max() <= np.ceil(learnedparts.SLACK * 100)


# ---------------------------------------------------------------- URL lists

ENTRIES = [("bad.org", "add", 10), ("bad.org", "add", 12), ("bad.org", "remove", 20), ("bad.org", "add", 30),
           ("www.bad.org", "add", 15), ("ok.net/a/b", "add", 0), ("ok.net/a/b", "remove", 0), ("ok.net/a", "remove", 5),
           ("ok.net/a", "add", 6), (None, "add", 1), ("x.com", None, 1), ("x.com", "add", None), ("x.com", "drop", 1)]
CAPTURES = [(1, "http://www.BAD.org/x", 9), (2, "http://www.bad.org/x", 10), (3, "http://www.bad.org/x", 15),
            (4, "http://u@bad.org:80/", 20), (5, "https://bad.org", 31), (6, "http://ok.net/a/b/c?q#f", 6),
            (7, "http://ok.net/ab", 7), (8, None, 7), (9, "not a url", 7), (10, "http://bad.org", None),
            (3, "http://www.bad.org/x", 15), (11, "http://x.com/" + "a/" * 300, 5), (12, "http://notbad.org", 15)]


def test_lists_are_read_as_of_the_capture(spark):
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at long").withColumn("blocked", F.lit("?"))
    entries = spark.createDataFrame(ENTRIES, "pattern string, action string, changed long")
    got = rows_of(urllists.judge(captures, entries), "page_id", "n_active", "blocked", "pattern", "listed_since")
    want = [(1, 0, False, None, None), (2, 1, True, "bad.org", 10), (3, 2, True, "www.bad.org", 15),
            (3, 2, True, "www.bad.org", 15), (4, 0, False, None, None), (5, 1, True, "bad.org", 30),
            (6, 1, True, "ok.net/a", 6), (7, 0, False, None, None), (8, 0, False, None, None),
            (9, 0, False, None, None), (10, 0, False, None, None), (11, 0, False, None, None), (12, 0, False, None, None)]
    assert got == sorted(want, key=repr)
    assert rows_of(urllists.intervals(entries), "pattern", "valid_from", "valid_to") == sorted(
        [("bad.org", 10, 20), ("bad.org", 30, None), ("www.bad.org", 15, None), ("ok.net/a", 6, None)], key=repr)
    assert urllists.judge(captures.limit(0), entries).count() == 0
    assert urllists.judge(captures, entries.limit(0)).where("blocked").count() == 0


# ---------------------------------------------------------------- site lines

def test_boilerplate_is_relative_to_the_site(spark):
    page = "<html><body><p>Home</p><script>Home</script>{}<!-- Home --><div> {} </div>\nend {}</body>"
    rows = [(i, f"http://a.com/{i}", page.format("Menu", f"text {i}", i % 5)) for i in range(20)]
    rows += [(100 + i, f"http://b.com/{i}", page.format("Menu", "same", "x")) for i in range(3)]
    rows += [(200, None, page.format("Menu", "m", "x")), (201, "http://A.com/z", None), (202, "http://a.com/y", ""),
             (300, "http://c.com/", page.format("Menu", "one", "y")), (5, "http://a.com/5", rows[5][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("?"))
    got = {r.page_id: r for r in sitelines.drop_boilerplate(pages, 0.2).collect()}
    # of 23 pages of a.com, "end 0" is on 5 (by the repeated row), the others on 4
    assert got[1].text == "text 1\nend 1" and got[1].n_lines == 4 and got[1].n_dropped == 2
    assert got[5].text == "text 5" and got[5].host == "a.com"
    # hosts of any size follow the rule; a line on one page proves nothing
    assert got[100].n_dropped == got[100].n_lines == 4 and got[300].n_dropped == 0
    assert got[200].n_dropped == 0 and got[200].host is None
    assert got[201].text == "" and got[202].n_lines == 0
    assert sitelines.drop_boilerplate(pages, 0.2).count() == len(rows)
    assert sitelines.drop_boilerplate(pages.limit(0)).count() == 0


def test_what_is_never_closed_takes_linear_time(spark):
    html = ["a<script " * 60_000, "b<!-- " * 60_000, "c<d " * 60_000, "5 < 6<p>x > y</p>z <style"]
    pages = spark.createDataFrame([(i, "http://a.com", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in sitelines.drop_boilerplate(pages, 1.0).collect()}
    assert got == {0: "a", 1: "b", 2: "c", 3: "5 < 6\nx > y\nz"}


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from test_documents import brute_contamination, brute_groups

    from bindery.llm import mixing

    rows = [r for r in documents(seed=9, n=120) if r[0] is not None]
    item = " ".join(rows[7][1].split()[:13])
    sf = str(tmp_path)
    frame(spark, rows, clash=False).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(100)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, names = spark.read.parquet(f"{sf}/documents.parquet"), []
    kept = {}
    for name, stage_of in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stage_of(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = before, [tuple(r) for r in docs.collect()]
        names.append(name)
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert names == ["language_id", "near_dedup", "decontaminate", "mix", "tokens"]
    before, after = kept["language_id"]
    assert {r[0] for r in before} - {r[0] for r in after} == {120, 121, 122, 123}
    before, after = kept["near_dedup"]
    assert sorted(r[0] for r in after) == sorted(set(brute_groups(before)))
    assert set(after) <= set(before)
    before, after = kept["decontaminate"]
    bad = {r[0] for r in brute_contamination(before, [(1, item)]) if r[5]}
    assert bad and {r[0] for r in after} == {r[0] for r in before} - bad
    before, after = kept["mix"]
    assert after and set(after) <= set(before) and len(after) == len(set(after))
    # a document stays by its rate alone
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    mixed = frame(spark, before, clash=False)
    rate, _ = mixing.mixing(mixed, labels, cap=1.0)
    rates = {r.doc_id: r.rate for r in mixed.select("doc_id", rate.alias("rate")).collect()}
    assert {i for i, r in rates.items() if r >= 1} <= {r[0] for r in after} <= {i for i, r in rates.items() if r > 0}
    assert [r[0] for r in kept["tokens"][1]] and len(kept["tokens"][1]) == len(after)
    assert corpus_pipeline.run(spark, sf).count() == len(after)


def test_near_dedup_with_shared_ids_and_other_columns(spark):
    import corpus_pipeline

    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, None, None, None), (0, b, "en", "s", 1), (None, a, "en", "s", 1)]
    docs = frame(spark, rows)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    # the group of b is named by 0; that of a by 1, which another group's row has too; a row without an id stays
    assert rows_of(kept, "doc_id", "text") == sorted([(0, b), (1, a), (None, a)], key=repr)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    frame(spark, [], clash=False).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
