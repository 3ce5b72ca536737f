"""Prefix encoding, conversation trie and Merkle manifest against brute force."""
import hashlib
import random
import zlib

import pytest
from corpora import documents, frame, rows_of
from pyspark.sql import functions as F
from test_documents import odd_texts

from bindery.llm import eulertour, merkle, prefixbpe, tokenids

ROWS = documents()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---------------------------------------------------------- prefix encoding

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenids.tokenizer_path())


def split(ids, size):
    ends = size.cumsum()
    return [ids[b - n:b].tolist() for b, n in zip(ends, size)]


def test_ids_are_the_librarys_on_odd_texts(library):
    texts = odd_texts() + ["ΑΣ ΣΑΣ σς", "a\x1cb \x85 c​d", "𝔸𝕓 ⅷ ①2３", "'S 'LL 'Re don''t ''s", "<|endoftext|><|start", "\0"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert split(*prefixbpe.Encoder(tokenids.tokenizer_path())([t.encode() for t in texts])) == want


def test_forgetting_words_and_cutting_texts_change_no_id(library, monkeypatch):
    monkeypatch.setattr(prefixbpe, "WORDS", 5)
    monkeypatch.setattr(prefixbpe, "PAIRS", 7)
    monkeypatch.setattr(prefixbpe, "BLOCK", 11)
    monkeypatch.setattr(prefixbpe, "SLICE_BYTES", 40)
    texts = [r[1] or "" for r in ROWS[:40]] + ["it's<|endoftext|> é " * 30]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert split(*prefixbpe.Encoder(tokenids.tokenizer_path())([t.encode() for t in texts])) == want


def test_one_very_long_word_takes_linear_time(library):
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    assert prefixbpe.Encoder(tokenids.tokenizer_path()).encoded(word) == library.encode(word, add_special_tokens=False).ids


def test_tokens_that_may_follow_are_those_that_merging_leaves_apart():
    own = prefixbpe.Vocabulary(tokenids.tokenizer_path())
    text = {i: t for t, i in own.ids.items()}

    def merged(symbols):
        while True:
            ranked = [(own.merges[x * own.size + y], i) for i, (x, y) in enumerate(zip(symbols, symbols[1:]))
                      if x * own.size + y in own.merges]
            if not ranked:
                return symbols
            _, i = min(ranked)
            symbols = [*symbols[:i], own.ids[text[symbols[i]] + text[symbols[i + 1]]], *symbols[i + 2:]]

    rng, seen = random.Random(8), set()
    open_tokens = [t for t in own.ids if t.isascii() and t.isalpha()]
    pairs = [rng.choices(open_tokens, k=2) for _ in range(3000)] + [["a", "aa"], ["aa", "a"], ["a", "a"], ["aa", "aa"]]
    for a, b in pairs:
        got = own.may_follow(own.ids[a], own.ids[b])
        assert got == (merged([own.ids[c] for c in a + b]) == [own.ids[a], own.ids[b]]), (a, b)
        seen.add(got)
    assert seen == {True, False}


def test_encode_and_decode(spark, library):
    path = tokenids.tokenizer_path()
    coded = prefixbpe.decode(prefixbpe.encode(frame(spark, ROWS).repartition(3), path), path)
    got = sorted(((r.doc_id, r.ids, r.text) for r in coded.collect()), key=repr)
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids for r in ROWS]
    want = [(r[0], i, library.decode(i, skip_special_tokens=False)) for r, i in zip(ROWS, ids)]
    assert got == sorted(want, key=repr)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [3306, 10**6])], "doc_id long, ids array<int>")
    assert rows_of(prefixbpe.decode(odd, path), "doc_id", "text") == [(1, ""), (2, ""), (3, "hello</w>")]
    assert prefixbpe.decode(prefixbpe.encode(frame(spark, []), path), path).count() == 0


# -------------------------------------------------------- conversation trie

def conversations(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 11 == 7:
            continue
        for turn in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn else "user", rng.choice(["a", "bé", "", "long text"])))
    rows += [(200, t, "user", "same") for t in range(120)] + [(205, t, "user", "same") for t in range(90)]
    rows += [(300 + 5 * i, 0, "user", "hot") for i in range(700)]
    rows += [(-7, 1, None, None), (-7, None, "x", "first"), (None, 0, "user", "nobody"), (9000, 3, "user", "ab"),
             (9000, 3, "userab", ""), (9000, 3, "user", "ab"), (9001, 5, "user", "ab")]
    return rows


def brute_trie(rows, family=5, most=8):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0, sha(f"{len(role.encode())}:", role, text)), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    total = {}
    for p in sorted(nodes, key=len, reverse=True):
        below = [total[k] for k in kids.get(p, [])]
        saved = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        total[p] = sum(b[0] for b in below) or 1, sum(b[1] for b in below) + saved
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *total[p],
                    sha(",".join(str(c) for c in sorted(m) if built[c] == p))) for p, m in nodes.items()), key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "cast(null as string) as name", "1 as node", "2 as n", "cast(null as string) as digest")


def test_trie_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(eulertour, "MEMBERS", 16)
    rows = conversations()
    got = eulertour.prefix_trie(*eulertour.rebuilt(talks(spark, rows).repartition(3)))
    assert rows_of(got, *TRIE) == brute_trie(rows)


def test_trie_of_few_and_no_conversations(spark):
    for rows in ([], [(None, 1, "a", "b")], [(1, 0, "user", "a")], [(5, 0, None, None)]):
        got = eulertour.prefix_trie(*eulertour.rebuilt(talks(spark, rows)))
        assert rows_of(got, *TRIE) == brute_trie(rows)


def test_two_prefixes_with_one_name_are_refused(spark):
    steps = spark.createDataFrame([(1, 1, "n", "p", "x", 1), (2, 1, "n", "p", "y", 1)],
                                  "conv_id long, depth long, name string, parent string, digest string, bytes long")
    with pytest.raises(Exception, match="two prefixes have one name"):
        eulertour.nodes_of(steps.select("conv_id"), steps)


def test_lists_are_ranked(spark):
    rng = random.Random(2)
    order = rng.sample(range(10_000), 3000)
    links = list(zip(order, [*order[1:], None])) + [(20_000, None), (20_002, 20_001), (20_001, None)]
    got = dict(rows_of(eulertour.list_ranks(spark.createDataFrame(links, "id long, next long")), "id", "rank"))
    want = {x: len(order) - 1 - i for i, x in enumerate(order)}
    assert got == {**want, 20_000: 0, 20_001: 0, 20_002: 1}


def test_running_sums_over_ranges(spark):
    rows = [(g, i, (i * 7 + g) % 5) for g, n in ((None, 3), (1, 500), (2, 1)) for i in range(n) for g in [g or 0]]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(5)
    got = rows_of(eulertour.running_sums(df, ["g"], ["i"], ["v"], "sums"), "g", "i", "v")
    want, at = [], {}
    for g, i, v in sorted(rows):
        at[g] = at.get(g, 0) + v
        want.append((g, i, at[g]))
    assert got == sorted(want, key=repr)


# ---------------------------------------------------------- Merkle manifest

def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, k):
    paths, nodes = [[] for _ in leaves], [(h, [i]) for i, h in enumerate(leaves)]
    while len(nodes) > 1:
        runs = [nodes[a:a + k] for a in range(0, len(nodes), k)]
        for run in runs:
            for slot, (_, own) in enumerate(run):
                for i in own:
                    paths[i].append((slot, [h for j, (h, _) in enumerate(run) if j != slot]))
        nodes = [(sha(*[h for h, _ in run]), [i for _, own in run for i in own]) for run in runs]
    return nodes[0][0], paths


def brute_manifest(rows, k=2):
    trees, parts, out = {}, [], []
    for r in rows:
        trees.setdefault(r[2], []).append((r[0], sha(*[field(r[i]) for i in (0, 3, 2, 4, 1)]), r))
    for lang in sorted(trees, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(trees[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        parts.append((own, *tree([x[1] for x in own], k)))
    root, above = tree([p[1] for p in parts], k)
    for (own, subroot, paths), up in zip(parts, above):
        for (doc, leaf, r), path in zip(own, paths):
            node, path = leaf, path + up
            if doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0:
                node = sha(*[field(v) for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + 1, r[1])])
            for slot, others in path:
                node = sha(*others[:slot], node, *others[slot:])
            out.append((doc, leaf, subroot, root, sha(*[h for _, o in path for h in o]), node, node == root))
    return sorted(out, key=repr)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_matches_brute_force(spark, arity):
    docs = frame(spark, ROWS).selectExpr("*", "'x' as tree", "1 as n", "2 as at", "'y' as hash", "'z' as path")
    got = rows_of(merkle.verified(docs.repartition(3), arity), *MANIFEST)
    assert got == brute_manifest(ROWS, arity)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_manifest_of_few_and_no_rows(spark):
    for rows in (ROWS[:1], ROWS[:1] * 3, [ROWS[0], (1, None, None, None, None)]):
        assert rows_of(merkle.verified(frame(spark, rows)), *MANIFEST) == brute_manifest(rows)
    assert merkle.verified(frame(spark, [])).count() == 0


def test_every_change_of_a_row_changes_the_root(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else None, "s", 6) for i in range(12)]
    root = merkle.verified(frame(spark, rows)).first().root
    for at, value in ((1, "text"), (2, "fr"), (3, None), (4, 7)):
        changed = [r[:at] + (value,) + r[at + 1:] if r[0] == 5 else r for r in rows]
        assert merkle.verified(frame(spark, changed)).agg(F.first("root")).first()[0] != root
