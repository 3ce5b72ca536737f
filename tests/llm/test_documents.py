"""Operators on texts against brute force, over odd rows and an empty table."""
import hashlib
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from corpora import documents, frame, rows_of
from pyspark.sql import functions as F

from bindery.llm import common, mixing, rulefit, shingles, simhash, stringkernel, tokenids, transducer, wumanber
from bindery.llm.wordscan import Powers, Words

ROWS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_words_are_those_of_the_pattern():
    texts = ["", "a", "É1 ab;c", "x", "", "日本 7"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    words = Words(np.frombuffer(data, np.uint8), offsets, Powers())
    got = [[data[a:b].decode() for a, b in zip(words.start[i:j], words.end[i:j])]
           for i, j in zip(words.first[:-1], words.first[1:])]
    assert got == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for t in texts]


def test_text_pieces_keep_the_words():
    text = b"ab cde\tf \n" * 200
    pieces = list(common.text_pieces(text, 37))
    assert len(pieces) > 10 and sum((p.split() for p in pieces), []) == text.split()


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (7, 7), (9, 8), (8, 10), (2, 1)] + [(100 + i, 101 + i) for i in range(60)]
    got = dict(rows_of(common.components(spark.createDataFrame(edges, "a long, b long"), "t"), "node", "root"))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8, **{100 + i: 100 for i in range(61)}}
    assert not common.components(spark.createDataFrame([], "a long, b long"), "t").count()


# ------------------------------------------------------------------ SimHash

def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def test_simhash_matches_brute_force(docs, nothing):
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == brute_components(ROWS)
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_finds_every_link_within_three_bits(spark):
    rng = np.random.default_rng(0)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints += [p ^ sum(1 << int(b) for b in rng.choice(63, d, replace=False)) for d in (1, 2, 3, 4) for p in prints[:30]]
    want = {(min(a, b), max(a, b)) for a in prints for b in prints if 0 < bin(a ^ b).count("1") <= 3}
    df = spark.createDataFrame([(p,) for p in sorted(set(prints))], "bits long")
    assert {tuple(r) for r in simhash.links(df).collect()} == want


# ------------------------------------------------------- similar shingle sets

def brute_groups(rows, similarity=0.8):
    """The smallest id of each row's group, linked by the Jaccard similarity of five-word shingles."""
    sets = []
    for r in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower())
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                root[find(i)] = find(j)
    ids = [[rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] for i in range(len(rows))]
    return [min(i) if i else None for i in ids]


def near_rows():
    """Texts of 200 words, and copies of them with up to seven words replaced, each copied on in a chain."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for changes in (0, 1, 2, 3, 3, 4, 7):
            words = list(words)
            for at in rng.choice(200, changes, replace=False):
                words[at] = f"v{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(words), "en", "src0", 1))
    return rows


def test_shingle_groups_match_brute_force(spark, docs, nothing):
    for rows, df in ((ROWS, docs), (near_rows(), frame(spark, near_rows()))):
        got = rows_of(shingles.near_groups(df).select("row.doc_id", "component_id"), "doc_id", "component_id")
        assert got == sorted(zip((r[0] for r in rows), brute_groups(rows)), key=repr)
    assert shingles.near_groups(nothing).count() == 0


def test_near_dedup_drops_what_three_bits_do_not_reach(spark):
    import corpus_pipeline

    rows = near_rows()
    groups = set(brute_groups(rows))
    assert len(groups) < len({c for _, _, c in brute_components(rows)}) / 2
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows, clash=False), "")
    assert {r.doc_id for r in kept.collect()} == groups


def test_near_dedup_links_fingerprints_too(spark):
    """Texts that one shingle dominates have near fingerprints and few distinct shingles in common."""
    import corpus_pipeline

    rng = random.Random(3)
    texts = ["tick " * 900 + " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30)) for _ in range(2)]
    rows = [(1, texts[0], "en", "s", 1), (2, texts[1], "en", "s", 1), (3, "another text of its own words", "en", "s", 1),
            (1, texts[0], "en", "r", 2), (None, texts[0], "en", "s", 1)]
    assert (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() <= 3
    docs = frame(spark, rows, clash=False)
    assert {r[0] for r in shingles.near_groups(docs).select("component_id").collect()} == {1, 2, 3}
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert rows_of(kept, "doc_id", "source") == [(1, "r"), (3, "s"), (None, "s")]


# --------------------------------------------------------- decontamination

def items_of(rows):
    long = " ".join(ROWS[5][1].split()[:25])
    texts = [long, "stone walk", None, "", "x" * 5000, long.upper(), "never garden " * 20]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "the"), (1, "river")]


def brute_contamination(rows, items):
    out = []
    for r in rows:
        words, hit, found = words_of(r[1]), set(), set()
        for item, text in items:
            own = words_of(text)
            if item is None or not own:
                continue
            size = min(13, len(own))
            windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)}
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((r[0], len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slice_words", [10, 500_000])
def test_wumanber_matches_brute_force(spark, docs, slice_words):
    items = items_of(ROWS)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = wumanber.contamination(docs, bench, slice_words=slice_words).withColumn(
        "sha", F.sha2(F.array_join("items", ","), 256))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated") == brute_contamination(ROWS, items)


def test_wumanber_on_empty_tables(spark, docs, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert wumanber.contamination(docs, bench).where("contaminated or n_items > 0").count() == 0
    assert wumanber.contamination(nothing, bench).count() == 0


# -------------------------------------------------------------- language ID

def test_language_is_right_on_held_out_texts(docs, nothing):
    model = stringkernel.train(docs, common.id_crc("doc_id") % 4 != 2)
    got = stringkernel.identify(docs, model).join(docs.select("doc_id", "lang", "text").distinct(), "doc_id")
    rows = got.where(stringkernel.held_out()).where("length(text) > 40 and lang_pred != 'und'").collect()
    assert len(rows) > 10 and sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)
    no_letters = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    n = len(ROWS) - 10
    assert no_letters == {n, n + 1, n + 2, n + 3}
    assert got.where("score < 0 or score > 1").count() == 0
    assert stringkernel.identify(docs, model).count() == len(ROWS)


STRANGE = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem",
    "Все люди рождаются свободными и равными в своем достоинстве и правах", "すべての人間は、生まれながらにして自由であり",
    "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan",
    "dGhpcyBpcyBub3QgYSB0ZXh0IGJ1dCBub2lzZQzXkQ9pWvLmTq7RfYb2KsHjNcXg", "9f3a07bc5e12dd48a6cbf0e37d915ae2c84fb60aa1",
    "bcdf ghjk lmnp qrst vwxz kjhg fdsq wrtp zxcv bnml"]


def test_pipeline_drops_texts_of_no_learned_language(spark):
    import corpus_pipeline

    clean = documents(seed=3, n=400)[:400]
    rows = clean + [(1000 + i, t, None, "src0", len(t)) for i, t in enumerate(STRANGE)]
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, frame(spark, rows, clash=False), "").collect()}
    assert kept == {r[0] for r in clean}


def test_pipeline_names_the_language_of_texts_without_a_label(spark):
    import corpus_pipeline

    clean = documents(seed=3, n=400)[:400]
    rows = [(i, t, None if i % 5 == 0 else lang, s, n) for i, t, lang, s, n in clean]
    kept = corpus_pipeline.language_id(spark, frame(spark, rows, clash=False), "").collect()
    assert {r.doc_id for r in kept} == {r[0] for r in clean}
    right = [r.lang == clean[r.doc_id][2] for r in kept if r.doc_id % 5 == 0]
    assert len(right) == 80 and sum(right) >= 70
    assert all(r.lang == clean[r.doc_id][2] for r in kept if r.doc_id % 5)


def test_pipeline_learns_from_every_labelled_row(spark):
    import corpus_pipeline

    # all that is French lies among the rows that op4 holds out
    clean = [r for r in documents(seed=3, n=900)[:900] if (zlib.crc32(str(r[0]).encode()) % 4 == 2) == (r[2] == "fr")]
    assert {r[2] for r in clean} == {"de", "en", "fr"}
    rows = clean + [(1000 + i, t, None, "src0", len(t)) for i, t in enumerate(STRANGE)]
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, frame(spark, rows, clash=False), "").collect()}
    assert kept == {r[0] for r in clean}


def test_least_familiar_counts_every_labelled_text(spark):
    rng = random.Random(5)
    rows = documents(seed=5, n=1800)[:1800]
    # more of each language than a model is fitted on; some words are of no language
    rows = [(i, t + " " + "".join(rng.choice("bcdfgkpqvwxz") for _ in range(rng.randint(0, 200))), lang, s, n) for i, t, lang, s, n in rows]
    docs = frame(spark, rows)
    model = stringkernel.train(docs, F.lit(True))
    shares = docs.select("lang", stringkernel.familiar(model).alias("share")).collect()
    lowest = []
    for lang in {r[2] for r in rows}:
        of_lang = sorted(r.share for r in shares if r.lang == lang)
        assert len(of_lang) > stringkernel.SAMPLE
        lowest.append(of_lang[len(of_lang) // 100])
    assert abs(stringkernel.least_familiar(docs, model) + stringkernel.SLACK - min(lowest)) <= 1 / stringkernel.SHARES


def test_language_with_nothing_to_learn_from(docs, nothing):
    model = stringkernel.train(nothing, F.lit(True))
    assert {r.lang_pred for r in stringkernel.identify(docs, model).collect()} == {"und"}
    assert stringkernel.identify(nothing, model).count() == 0


def test_presence_kernel_counts_common_ngrams():
    texts = [b"Haus am See", b"haus", b"", "é".encode()]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    seen = stringkernel.presence(data, offsets, np.arange(stringkernel.CODES), stringkernel.CODES)

    def grams(t):
        t = [b if chr(b).isalpha() or b > 127 else 32 for b in t.lower()]
        return {tuple(t[i:i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    want = [[len(grams(a) & grams(b)) for b in texts] for a in texts]
    assert (seen @ seen.T).astype(int).tolist() == want


# --------------------------------------------------- token counts and files

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenids.tokenizer_path())


def test_token_counts_are_the_librarys(docs, nothing, library):
    got = rows_of(transducer.count_tokens(docs, tokenids.tokenizer_path()), "doc_id", "n_bytes", "n_tokens")
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids))
            for r in ROWS]
    assert got == sorted(want, key=repr)
    assert transducer.count_tokens(nothing, tokenids.tokenizer_path()).count() == 0


def odd_texts():
    import random
    rng = random.Random(7)
    alphabets = ["abcdefghij' .,!1é", "ab\x0b\x1c\x85　 e", "'stlvemrd! ", "日ßİΣé́x ", "<|endoftx|> ", "aZ9\U0001F600‍-_ "]
    return ["".join(rng.choice(a) for _ in range(rng.randint(0, 90))) for a in alphabets for _ in range(60)] + [
        "ab" * 3000, "'" * 300, "é" * 700, " " * 600, "don't I'LL we've' 's 'S", "<|endoftext|>"]


def test_transducer_and_encoder_on_odd_texts(library):
    texts = odd_texts()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    counter = transducer.Counter(transducer.Machine(tokenids.tokenizer_path()), transducer.char_tables())
    assert counter([t.encode() for t in texts]).tolist() == [len(w) for w in want]
    ids, size = tokenids.Encoder(tokenids.tokenizer_path())([t.encode() for t in texts], 2)
    assert size.tolist() == [len(w) + 1 for w in want]
    assert ids.tolist() == [i for w in want for i in (*w, 2)]


def test_forgetting_changes_no_result(library, monkeypatch):
    monkeypatch.setattr(transducer, "STATES", 50)
    monkeypatch.setattr(tokenids, "CACHE", 20)
    counter = transducer.Counter(transducer.Machine(tokenids.tokenizer_path()), transducer.char_tables())
    encoder = tokenids.Encoder(tokenids.tokenizer_path())
    for r in ROWS[:30]:
        want = library.encode(r[1], add_special_tokens=False).ids
        assert counter([r[1].encode()]).tolist() == [len(want)]
        assert encoder([r[1].encode()], 2)[0].tolist() == [*want, 2]


def test_tasks_of_a_worker_encode_a_piece_once(library, monkeypatch):
    learned, learn = [], tokenids.Encoder.learn
    monkeypatch.setattr(tokenids.Encoder, "learn", lambda self, pieces: (learned.extend(pieces), learn(self, pieces))[1])
    monkeypatch.setattr(tokenids.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    texts = ["qzxvword qzxvother qzxvword", None, "qzxvother 77qzxv"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": texts})
    run = tokenids._encode(tokenids.tokenizer_path(), 2, ["part", "doc_id", "local_start", "n_tokens", "ids"])
    tasks = [[b.to_pydict() for b in run([batch])] for _ in range(2)]
    assert tasks[0] == tasks[1]
    assert [i for b in tasks[1] for i in b["ids"]] == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert learned and len(learned) == len(set(learned))


def test_pieces_with_equal_hashes_keep_their_own_ids(library):
    """Hashes that are polynomials modulo a power of two agree for these two words."""
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    texts = [word, word.translate({97: 98, 98: 97}), f"x {word}", "plain text", ""]
    want = [i for t in texts for i in (*library.encode(t, add_special_tokens=False).ids, 2)]
    for together in (texts, texts[::-1]):
        encoder = tokenids.Encoder(tokenids.tokenizer_path())
        parts = [encoder([t.encode()], 2)[0].tolist() for t in together]
        assert [i for p in (parts if together is texts else parts[::-1]) for i in p] == want
    assert tokenids.Encoder(tokenids.tokenizer_path())([t.encode() for t in texts], 2)[0].tolist() == want


def test_token_files_round_trip(spark, docs, nothing, library, tmp_path):
    path = str(tmp_path / "ids")
    tokenids.write_ids(docs, path, tokenids.tokenizer_path())
    rows = tokenids.read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i))
    at = 0
    texts = {r[0]: r[1] for r in ROWS}
    for r in rows:
        assert r.start == at and r.ids == [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        at += r.n_tokens
    assert tokenids.layout(spark, path).agg(F.sum("tokens"), F.sum("rows")).first() == (at, len(ROWS))
    assert [r.doc_id for r in tokenids.find_ids(spark, path, [7]).collect()] == [7]
    got = rows_of(tokenids.digest(tokenids.read_ids(spark, path)), "start", "ids_crc32")
    assert got == sorted(((r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows), key=repr)
    assert tokenids.token_files(nothing).count() == 0


def test_token_files_carry_bloom_filters(docs, tmp_path):
    from pyarrow import orc
    path = tmp_path / "ids"
    tokenids.write_ids(docs, str(path), tokenids.tokenizer_path())
    files = [orc.ORCFile(f) for f in sorted(path.glob("part-*.orc"))]
    assert sum(f.nrows for f in files) == len(ROWS)
    assert all(f.row_index_stride == 1000 for f in files if f.nrows)


# ------------------------------------------------------------------- mixing

def test_rates_reach_the_targets_and_match_plain_gradient_steps(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    t = rng.integers(0, 200, 300)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "n_tokens long, p array<double>")
    fit = mixing.fit_rates(members, ["a", "b", "c"], {"a": 5, "b": 4, "c": 1})
    assert abs(np.array(fit.fitted) - np.array(fit.target)).max() <= 0.01 * sum(fit.target)
    rate = np.ones(300)
    metric = np.linalg.pinv((p * t[:, None]).T @ p)
    for _ in fit.steps:
        miss = (rate * t) @ p - np.array(fit.target)
        rate = np.maximum(0, rate * (1 - mixing.STEP * mixing.PULL) + mixing.STEP * mixing.PULL - p @ (mixing.STEP * metric @ miss))
    got = [r[0] for r in members.select(fit.column(F.col("p"))).collect()]
    assert np.allclose(got, rate, atol=1e-6) and rate.min() >= 0
    capped = mixing.fit_rates(members, ["a", "b", "c"], {"a": 5, "b": 4, "c": 1}, cap=1.0)
    assert max(r[0] for r in members.select(capped.column(F.col("p"))).collect()) <= 1


def test_mixing_on_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 3 > 0, i % 7 == 0) for i in range(0, 80, 2)] + [(None, True, False)],
                                   "doc_id long, q boolean, t boolean").selectExpr(
        "doc_id", "cast(q as int) quality", "cast(t as int) toxic")
    rate, fit = mixing.mixing(docs, labels)
    rows = docs.select("doc_id", "text", rate.alias("rate"), mixing.drawn(rate, "doc_id").alias("copies")).collect()
    assert len(rows) == len(ROWS) and fit.domains == ["good", "low", "toxic"]
    assert all(r.rate >= 0 and abs(r.copies - r.rate) <= 1 for r in rows)
    assert len({r.rate for r in rows if r.doc_id == 3}) == 1
    rate, fit = mixing.mixing(docs, labels.limit(0))
    assert {r[0] for r in docs.select(rate).collect()} == {1.0}
    rate, fit = mixing.mixing(nothing, labels)
    assert nothing.select(rate).count() == 0


# ---------------------------------------------------------- quality scores

def test_compiled_rules_equal_the_fitted_model(spark, docs, nothing):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(rulefit.STATS)))
    y = ((x[:, 0] > 0.2) & (x[:, 3] < 0.5)).astype(float)
    model = rulefit.fit(x, y)
    assert 0 < len(model.rules) < 250
    df = spark.createDataFrame([[float(v) for v in r] for r in x], rulefit.STATS)
    got = np.array([r[0] for r in df.coalesce(1).select(model.score()).collect()])
    on = np.array([r.of(x) for r in model.rules]).T
    assert np.allclose(np.sort(got), np.sort(1 / (1 + np.exp(-(model.intercept + on @ np.array(model.weights))))))
    assert ((got >= 0.5) == (y > 0)).mean() > 0.97


def test_statistics_and_scores_of_odd_rows(spark, docs, nothing):
    rows = {r.doc_id: r for r in rulefit.measured(docs).collect()}
    for doc in ROWS:
        own, words = rows[doc[0]], words_of(doc[1])
        assert own.words == len(words) and own.bytes == len((doc[1] or "").encode())
        if words:
            assert own.distinct_words == pytest.approx(len(set(words)) / len(words))
            assert own.top_word == pytest.approx(max(Counter(words).values()) / len(words))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = rulefit.train(docs, labels, F.lit(True))
    scores = rulefit.quality(docs, model)
    assert scores.count() == len(ROWS) and scores.where("score between 0 and 1").count() == len(ROWS)
    none = rulefit.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in rulefit.quality(docs, none).collect()} == {0.5}
    assert rulefit.quality(nothing, none).count() == 0
