"""Pair scenarios: each project is one small repository."""
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from bindery.catalog.pairs import eligible_pairs
from bindery.operators import linkage as L
from bindery.plans.analyze import analyze, baseline
from bindery.schema import REVIEWS
from bindery.staging import stage

CORPUS = {
    # spelling of one name: same role, other role, other case in one shell, private twin, dotted or dunder
    "spelling": {
        "kitchen/oven.py": "bake_minutes = 40\n", "kitchen/grill.py": "bakeMinutes = 25\n",
        "hall/door.py": "BAKE_MINUTES = 10\nclass Door:\n    def open(self):\n        self.bake_minutes = 1\n",
        "win/left.ps1": "$GuestSeat = 'window-12'\n", "win/right.ps1": "$guestseat = 'window-12'\n",
        "menu/day.py": "_DISHES = ['soup']\n", "menu/night.py": "DISHES = ['stew', 'soup']\n",
        "menu/names.py": "__slots__ = ['a1']\n", "hall/names.py": "__slots__ = ['b2']\n",
    },
    # values: equal under unrelated and related names, different under one name, idioms, own place
    "value": {
        "north/a.py": 'ferry_route = "quay-7/island-3"\nTIDE = 18\ntide = 19\n', "south/b.py": 'WATER_LINE = "quay-7/island-3"\n',
        "north/c.py": "DECK_COUNT = 3\n", "north/d.py": "DECK_COUNT = 4\n", "south/e.py": "DECK_HEIGHT = 6\n",
        "north/log.py": "log = logging.getLogger(__name__)\n", "south/log.py": "log = logging.getLogger(__name__)\n",
    },
    # one side says where its value comes from
    "origin": {
        "a.py": '_HARBOUR = "pier-nine"\nharbour = _HARBOUR\n',
        "b.py": 'Colour = Choice["red", "blue"]\nclass Flag:\n    colour: Colour = "red"\n',
        "c.py": 'WIND_NAMES = ["foehn", "mistral"]\n', "d.py": "WINDS = WIND_NAMES\n", "e.ts": "const WINDS = list(WIND_NAMES);\n",
    },
    "env": {
        ".env": "API_TOKEN=abcd-efgh\nSERVICE_PORT=80801\n", ".env.example": "API_TOKEN=\nSERVICE_PORT=80801\n",
        "a/one.py": 'LOG_FILE = os.environ.get("AUDIT_PATH", "x.log")\n', "b/two.py": 'LOG_FILE = os.environ.get("AUDIT_PATH", "x.log")\n',
    },
    "units": {"one/package.json": "{}", "two/deep/go.mod": "", "one/a.py": 'RUNTIME_TAG = "release-tag"\n',
              "two/b.py": 'RUNTIME_TAG = "release-tag"\n'},
    "oneroot": {"package.json": "{}", "one/a.py": 'RUNTIME_TAG = "release-tag"\n', "two/b.py": 'RUNTIME_TAG = "release-tag"\n'},
    "orm": {"m.py": 'cache_namespace = Field(default="prod-cache-7")\nshard_prefix = Field(default="prod-cache-7", description="x")\n'
                    "left = mapped_column(Float, nullable=False)\nright = mapped_column(Float, nullable=False)\n",
            "d.py": "by_tool = defaultdict(list)\nsignature_groups = defaultdict(list)\n"},
    # names that differ by design lose points within a file, not across files
    "family": {"roles.py": 'TOWER_CLOCK_LABEL = "lab-1"\nTOWER_CLOCK_HANDLE = "han-2"\n',
               "order.py": "PAINT_WALL_AREA = 'p-1'\nWALL_PAINT_NAME = 'w-2'\n",
               "key1.py": 'BOAT_SAIL_KEY = "sail-1"\n', "key2.py": 'BOAT_OARS_KEY = "oars-2"\n',
               "twins.ts": "const tankInputSpeed = 1.5;\nconst tankOutputSpeed = 2.5;\n"
                           "const setRopeLength = f1(1);\nconst changeRopeLength = f2(2);\n"},
    "pages": {"i.py": "ISSUE_PAGE_SIZE = 50\n", "u.py": "USER_PAGE_SIZE = 75\n", "t.py": "ITEM_PAGE_SIZE = 90\n"},
    "titles": {"a.ts": 'const panelTitle = "aaaa-1";\n', "b.ts": 'const panelTitle = "bbbb-2";\n', "c.ts": 'const panelTitle = "cccc-3";\n'},
    "eight": {f"f{i}.py": 'SHARED_TIMEOUT_LABEL = "thirty seconds"\n' for i in range(8)},
}


def corpus_of(spark, trees):
    rows = [(p, path, text) for p, files in trees.items() for path, text in files.items()]
    return spark.createDataFrame(rows, "project string, path string, content string")


@pytest.fixture(scope="module")
def registry(spark):
    return stage(baseline(corpus_of(spark, CORPUS), "2024-01-01"), "t")


@pytest.fixture(scope="module")
def pairs(spark, registry):
    rows = L.find_duplicates(registry, paths=corpus_of(spark, CORPUS).select("project", "path")).collect()
    return [(r.project, frozenset((r.a.name, r.b.name)), r.reason, r.level, r) for r in rows]


def got(pairs, project, *names):
    return [(reason, level) for p, n, reason, level, _ in pairs if p == project and n == frozenset(names)]


def test_spelling(pairs):
    assert got(pairs, "spelling", "bake_minutes", "bakeMinutes") == [("name-variant", "high")]
    assert got(pairs, "spelling", "BAKE_MINUTES", "bake_minutes") == [("case-variant", "medium")]
    assert not got(pairs, "spelling", "self.bake_minutes", "BAKE_MINUTES")
    assert got(pairs, "spelling", "GuestSeat", "guestseat") == [("same-name-same-value", "high")]
    assert got(pairs, "spelling", "_DISHES", "DISHES") == [("name-variant", "high")]
    assert not got(pairs, "spelling", "__slots__")


def test_equal_and_different_values(pairs):
    assert got(pairs, "value", "ferry_route", "WATER_LINE") == [("same-value", "medium")]
    assert got(pairs, "value", "DECK_COUNT") == [("value-mismatch", "high")]
    assert {r for r, _ in got(pairs, "value", "DECK_COUNT", "DECK_HEIGHT")} == {"shared-token"}
    assert not got(pairs, "value", "TIDE", "tide") and not got(pairs, "value", "log")


def test_named_origins(pairs):
    assert got(pairs, "origin", "_HARBOUR", "harbour") == [("alias-derived", "low")]
    assert got(pairs, "origin", "Colour", "colour") == [("alias-derived", "low")]
    assert got(pairs, "origin", "WINDS") == [("shared-source", "low")]


def test_templates_and_units(pairs):
    assert not got(pairs, "env", "API_TOKEN") and not got(pairs, "env", "SERVICE_PORT")
    assert got(pairs, "env", "LOG_FILE") == [("shared-env-source", "low")]
    assert not got(pairs, "units", "RUNTIME_TAG") and got(pairs, "oneroot", "RUNTIME_TAG")


def test_values_and_families(pairs):
    assert got(pairs, "orm", "cache_namespace", "shard_prefix") == []  # equal default, different declaration text
    assert not [p for p in pairs if p[0] == "orm" and p[2].startswith("same-value")]
    assert [lv for _, lv in got(pairs, "family", "TOWER_CLOCK_LABEL", "TOWER_CLOCK_HANDLE")] == ["low"]
    assert [lv for _, lv in got(pairs, "family", "PAINT_WALL_AREA", "WALL_PAINT_NAME")] == ["medium"]
    assert [lv for _, lv in got(pairs, "family", "BOAT_SAIL_KEY", "BOAT_OARS_KEY")] == ["medium"]
    assert [lv for _, lv in got(pairs, "family", "tankInputSpeed", "tankOutputSpeed")] == ["low"]
    assert [lv for _, lv in got(pairs, "family", "setRopeLength", "changeRopeLength")] == ["low"]
    assert len(got(pairs, "eight", "SHARED_TIMEOUT_LABEL")) == 28


def test_projects_stay_apart_and_keys_are_ordered(pairs):
    for _, _, _, _, r in pairs:
        assert r.id_a < r.id_b and r.pair_key == f"{r.id_a}||{r.id_b}"
    tags = [r.id_a for p, n, _, _, r in pairs if n == frozenset(["RUNTIME_TAG"])]
    assert len(tags) == 1


def review(spark, rows):
    return spark.createDataFrame([(p, k, v, None, None) for p, k, v in rows], REVIEWS)


def test_learning_from_verdicts(spark, registry, pairs):
    family = sorted((r.id_a, r.id_b) for p, n, reason, _, r in pairs if p == "pages")
    titles = sorted(r.pair_key for p, n, _, _, r in pairs if p == "titles")
    assert len(family) == 3 and len(titles) == 3
    a, b = family[0]
    swapped = f"{b}||{a}".replace("/", "\\")
    ledger = review(spark, [("pages", swapped, "not_duplicate"), ("titles", titles[1], "not_duplicate")])
    small = registry.filter(F.col("project").isin("pages", "titles"))
    assert L.find_duplicates(small, ledger).count() == 0
    shown = L.find_duplicates(small, ledger, include_dismissed=True).collect()
    assert sum(r.review.learned for r in shown) == 4 and len(shown) == 6
    off = L.find_duplicates(small, ledger, settings={"learn_from_reviews": False})
    assert off.count() == 4


def test_settings(spark, registry):
    titles = registry.filter("project = 'titles'")
    assert L.scored_pairs(titles, settings={"dup_ignore_names": ["panel_title"]}).count() == 0
    assert L.scored_pairs(titles, settings={"dup_ignore_crossfile_names": ["PANEL_TITLE"]}).count() == 0
    units = L.find_duplicates(registry.filter("project = 'oneroot'"), settings={"standalone_units": "*"})
    assert units.count() == 0


def test_blocks_of_any_size_link_whole(spark):
    """260 rows share one name: all pairs of different files; the scoped ones only meet in their own file."""
    trees = {"big": {f"d{i}/f.py": f'GATE_CODE = "v{i:04d}"\ndef go():\n    GATE_CODE = "w"\n' for i in range(260)}}
    reg = stage(baseline(corpus_of(spark, trees), "2024-01-01"), "big")
    pairs = L.scored_pairs(reg)
    assert pairs.filter("a.scope = '' and b.scope = ''").count() == 260 * 259 // 2
    assert pairs.filter("a.file <> b.file and (a.scope <> '' or b.scope <> '')").count() == 0
    sizes = L.block_sizes(L.block_keys(L.features(reg)))
    assert {r.block for r in L.unlinked_blocks(sizes, 200).collect()} == {"n:gatecode", "t:gate", "t:code"}
    assert L.scored_pairs(reg, max_bucket=200).count() == 0


def test_a_pair_has_one_verdict_however_its_key_is_spelled(spark, pairs):
    r = next(r for p, _, _, _, r in pairs if p == "titles")
    twice = spark.createDataFrame(
        [("titles", f"{r.id_a}||{r.id_b}", "duplicate", None, None), ("titles", f"{r.id_b}||{r.id_a}", "not_duplicate", None, None)],
        REVIEWS).withColumn("ts", F.when(F.col("verdict") == "duplicate", F.lit("2024-01-01")).otherwise(F.lit("2024-01-02")).cast("timestamp"))
    one = spark.createDataFrame([("titles", f"{r.id_a}||{r.id_b}")], "project string, pair_key string")
    assert [x.review.verdict for x in L.join_reviews(one, twice).collect()] == ["not_duplicate"]


def test_a_given_bound_leaves_out_large_blocks_alone(spark):
    trees = {"hot": {f"d{i}/f.py": f'HOT_TOKEN = "v{i:04d}"\nrare_{i // 2}_pair = {i}\n' for i in range(60)}}
    reg = stage(baseline(corpus_of(spark, trees), "2024-01-01"), "hot")
    blocks = L.block_keys(L.features(reg))
    kept = L.filter_blocks(blocks, 50)
    assert kept.filter("block = 'n:hottoken' or block = 't:pair'").count() == 0
    want = {r.block for r in blocks.groupBy("block").count().filter("count between 2 and 50").collect()}
    assert {r.block for r in kept.select("block").distinct().collect()} == want
    pairs = L.scored_pairs(reg, max_bucket=50)
    assert pairs.filter("a.name = 'HOT_TOKEN' and b.name = 'HOT_TOKEN'").count() == 0
    assert pairs.filter("a.name like 'rare%'").count() == 30


def test_candidates_equal_brute_force(spark, registry):
    feats = L.features(registry)
    keys = {}
    for r in L.block_keys(feats).collect():
        keys.setdefault((r.project, r.id), set()).add(r.block)
    want = {(p, a, b) for (p, a), (q, b) in itertools.combinations(sorted(keys), 2)
            if p == q and keys[p, a] & keys[q, b]}
    have = {tuple(r) for r in L.candidate_pairs(L.filter_blocks(L.block_keys(feats))).collect()}
    assert have == want


LINKED = ["project", "id_a", "id_b", "score_int", "level", "reason", "family", "family_size"]


def wordy(n=160):
    """Names of one to five words out of few, short and generic ones among them, and values that hold other names."""
    rng = random.Random(4)
    words = "cache value name host db io q port primary replica reader writer total count".split()
    names = ["_".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(n)] + ["$odd name", "host-port", "db cache"]
    lines = [f"{rng.choice(names).replace('$', '').replace(' ', '_').replace('-', '_')} = {rng.choice(names)} + {i % 7}" for i in range(n)]
    files = {f"d{i % 5}/f{i % 23}.py": "\n".join(lines[i::23]) + "\n" for i in range(23)}
    files |= {f"s{i}/run.sh": f"{names[i].upper()}='{names[i + 1]} x'\nexport db_host=$PRIMARY_HOST_{i % 2}\n" for i in range(12)}
    files |= {f"e/.env{i}": f"PRIMARY_HOST_{i % 2}=h{i}\nREADER-{i} = db\n" for i in range(6)}
    files |= {"t/a.ts": "const host$port = hostPort + db_cache;\nfunction go() {\n  const db_cache = host$port;\n  const dbTotal = db_cache;\n}\n"}
    return {"w": files}


def test_scored_pairs_equal_those_of_whole_blocks(spark, registry):
    """Every rule has keys that meet all of its pairs: nothing is lost against pairing the token blocks whole."""
    other = stage(baseline(corpus_of(spark, wordy()), "2024-01-01"), "wordy")
    seen = set()
    for reg in (registry, other, registry.filter("false")):
        have = sorted(tuple(r) for r in L.scored_pairs(reg).select(*LINKED).collect())
        want = sorted(tuple(r) for r in L.scored_pairs(reg, max_bucket=10**9).select(*LINKED).collect())
        assert have == want
        seen |= {r[5] for r in want}
    assert seen >= {"token-overlap", "shared-token", "alias-derived", "shared-source", "value-mismatch"}


def test_a_common_token_does_not_pair_its_block(spark):
    n = 2000

    def word(kind, i):
        return kind + "".join(chr(97 + int(d)) for d in str(i))

    parts = [("cache", word("x", i), word("y", i // 2), word("z", i // 3)) for i in range(n)]
    lines = "".join(f"{'_'.join(p)} = {i}\n" for i, p in enumerate(parts))
    feats = L.features(baseline(corpus_of(spark, {"p": {"f.py": lines}}), "2024-01-01")).withColumns(
        {"refs": F.array().cast("array<string>"), "unit": F.lit(None).cast("string")})
    feats = stage(feats.drop("mentions"), "common-token")
    pairs = L.blocked_pairs(feats)
    a, b = L.Side("a"), L.Side("b")
    half = F.size(F.array_intersect(a["tokens"], b["tokens"])) * 2 >= F.size(F.array_union(a["tokens"], b["tokens"]))
    found = {tuple(r) for r in pairs.filter(half).select("a_name", "b_name").collect()}
    near = [(parts[i], parts[j]) for i in range(n) for j in range(max(0, i - 3), i)]
    want = {frozenset(("_".join(p), "_".join(q))) for p, q in near if len({*p} & {*q}) * 2 >= len({*p} | {*q})}
    assert {frozenset(p) for p in found} == want and want
    assert pairs.count() < 5 * n


def test_analyze_keeps_unsafe_paths_out(spark):
    files = spark.createDataFrame([("p1", "\\src\\a.py", "MAX_RETRIES = 5\n"), ("p1", "src/b.py", "MAX_RETRIES = 9\n"),
                                   ("p1", "../x.py", "A = 1\n"), ("bad id", "x.py", "A = 1\n")],
                                  "project string, path string, content string")
    out = analyze(files)
    assert [(r.level, r.reason) for r in out["pairs"].collect()] == [("high", "value-mismatch")]
    assert out["rejects"].count() == 2
    assert {(r.project, r.lang, r.rows) for r in out["languages"].collect()} == {("p1", "python", 2)}


def test_whole_blocks_meet_every_eligible_pair(spark, registry):
    """Features without references do, as the rules are not asked."""
    feats = stage(L.features(registry).withColumn("unit", F.lit(None).cast("string")), "whole")
    met = L.blocked_pairs(feats, whole=True)
    have = {tuple(r) for r in met.select("project", "a_id", "b_id").collect()}
    a, b = (feats.select("project", *[F.col(c).alias(f"{s}_{c}") for c in feats.columns if c != "project"]) for s in "ab")
    want = L.candidate_pairs(L.filter_blocks(L.block_keys(feats))).selectExpr("project", "id_a as a_id", "id_b as b_id")
    want = want.join(a, ["project", "a_id"]).join(b, ["project", "b_id"]).filter(L.eligible(L.Side("a"), L.Side("b")))
    assert have == {tuple(r) for r in want.select("project", "a_id", "b_id").collect()} and have


def test_eligible_pairs_read_their_features_once(spark, tmp_path):
    rows = [(k, f"{'red green blue'.split()[k % 3]} {'apple pear'.split()[k % 2]} x", f"Brand#{k % 2}", "PROMO TIN", k % 4) for k in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(
        str(tmp_path / "part.parquet"))
    pairs = eligible_pairs(spark, str(tmp_path))
    assert pairs.count() > 0
    assert "p_partkey" not in pairs._jdf.queryExecution().analyzed().toString()


def test_blocks_in_cells_give_the_same_pairs(spark, registry, monkeypatch):
    """A block larger than a cell is paired in parts, each pair of rows in one of them."""
    other = stage(baseline(corpus_of(spark, wordy()), "2024-01-01"), "cells")
    rows = other.unionByName(registry)
    want = sorted(tuple(r) for r in L.scored_pairs(rows).select(*LINKED).collect())
    monkeypatch.setattr(L, "CELL_ROWS", 5)
    monkeypatch.setattr(L, "TASK_PAIRS", 2000)
    assert sorted(tuple(r) for r in L.scored_pairs(rows).select(*LINKED).collect()) == want
    feats = stage(L.features(rows).withColumn("unit", F.lit(None).cast("string")), "cells")
    shared = F.size(F.array_intersect("a_telling", "b_telling"))
    # once per shared block: the tokens, the name and the value
    times = L.blocked_pairs(feats, whole=True).groupBy("project", "a_id", "b_id").agg(
        F.count(F.lit(1)).alias("n"), F.first(shared + (F.col("a_norm") == F.col("b_norm")).cast("int") + F.coalesce(
            F.col("a_anchor") & F.col("b_anchor") & (F.col("a_value_hash") == F.col("b_value_hash")), F.lit(False)).cast("int")).alias("want"))
    assert times.filter("n <> want").count() == 0 and times.filter("n > 1").count() > 0


def test_rows_meet_once_for_all_their_blocks(spark, registry):
    """Two rows of several common blocks are looked at in one of them; rows that come twice still give a pair once."""
    reg = stage(baseline(corpus_of(spark, wordy()), "2024-01-01").unionByName(registry), "once")
    live = L.live_features(reg)
    feats = L.with_references(live.filter("linkable").drop("linkable"), live).withColumn("unit", F.lit(None).cast("string"))
    met = stage(L.blocked_pairs(stage(feats, "once")).select("project", "a_id", "b_id", "a_norm", "b_norm", "a_telling", "b_telling"), "once")
    assert met.filter("a_norm = b_norm and size(a_telling) > 1").count() > 0
    assert met.count() == met.select("project", "a_id", "b_id").distinct().count()
    want = sorted(tuple(r) for r in L.scored_pairs(reg).select(*LINKED).collect())
    assert sorted(tuple(r) for r in L.scored_pairs(reg.unionByName(reg)).select(*LINKED).collect()) == want and want


def test_the_jvm_compiles_the_joins_of_pairs(spark, registry, capsys):
    """A generated method of more than 8,000 bytes is interpreted, at several times the cost of each pair."""
    pairs = L.scored_pairs(registry, sides=False).select("project", "pair_key", "score_int", "level", "reason")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs.explain(mode="codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = []
    for stage_code in capsys.readouterr().out.split("== Subtree ")[1:]:
        own = re.search(r"\*\(\d+\)", stage_code)[0]
        if f"{own} SortMergeJoin" in stage_code:
            sizes.append(int(re.search(r"maxMethodCodeSize:(\d+)", stage_code)[1]))
    assert sizes and max(sizes) <= 8000


def test_candidates_come_once_without_telling_pairs_apart(spark, monkeypatch):
    # three blocks that overlap, one of them in cells; rows that come twice, rows without an id or a block
    monkeypatch.setattr(L, "CELL_ROWS", 4)
    rows = [("p", "x", f"i{k:02d}") for k in range(15)] + [("p", "y", f"i{k:02d}") for k in range(5, 20)]
    rows += [("q", "x", f"i{k:02d}") for k in range(3)] + [("p", "z", "i01"), ("p", "z", "i19"), ("p", "z", "i19"), ("p", "alone", "i30")]
    rows += [("p", None, "i01"), ("p", None, "i40"), ("p", "x", None), (None, "x", "i41"), (None, "x", "i42")]
    pairs = L.candidate_pairs(spark.createDataFrame(rows, "project string, block string, id string"))
    want = {(p, a, b) for p, k, a in rows for q, m, b in rows if None not in (p, k, a, b) and (p, k) == (q, m) and a < b}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate" not in pairs._jdf.queryExecution().sparkPlan().toString()


def test_verdicts_leave_the_other_pairs_in_place(spark):
    pairs = spark.range(300).selectExpr("if(id % 50 = 7, null, concat('p', id % 3)) project", "if(id % 40 = 9, null, concat('a', id, '||b')) pair_key", "id")
    reviews = [(f"p{k % 3}", f"a{k}||b", v, "n", None) for k in range(0, 300, 7) for v in ("duplicate", "merged")] + [("p9", "a1||b", "merged", "n", None)]
    reviews = spark.createDataFrame(reviews, REVIEWS)
    pairs = stage(pairs, "t")
    joined = L.join_reviews(pairs, reviews)
    got = {r.id: r.review and r.review.verdict for r in joined.collect()}
    known = {r.id for r in pairs.collect() if r.project and r.pair_key}
    assert len(got) == 300 == joined.count()
    assert {i for i, v in got.items() if v} == {i for i in known if i % 7 == 0}
    # all that meets no verdict passes by a broadcast of hashes
    assert "LeftAnti, BuildRight" in joined._jdf.queryExecution().sparkPlan().toString()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(L, "MOST_HASHES", 3)
        assert {r.id: r.review and r.review.verdict for r in L.join_reviews(pairs, reviews).collect()} == got


def test_a_floor_on_levels_leaves_methods_that_the_jvm_compiles(spark, registry):
    pairs = L.min_level(L.scored_pairs(registry, sides=False), "low").groupBy("project", "level").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        code = pairs._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000
