"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skeinworks.llm import bpe, ctph, language_id, line_quality, neardup, packing, pages, repeats, toxicity, url_filter

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


LONG = prose(20000, 1)
ROWS = [
    (1, "The quick brown fox. " + prose(60, 2)),
    (2, None),
    (3, ""),
    (4, "  \n\t "),
    (5, LONG),
    (6, LONG),
    (6, LONG),
    (7, "x"),
    (None, prose(80, 3)),
    (None, None),
    (8, prose(60, 2) + " end"),
    (9, "Ünï çødé 漢字 ### !!! \u2028 tail\r\nnext"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def wide(docs):
    """Columns whose names clash with outputs and helpers."""
    names = ["lang_pred", "score", "is_toxic", "p_toxic", "n_words", "n_removed", "n_shingles", "component_id", "kept", "ids", "fingerprint", "n_chars", "clean_text", "words"]
    return docs.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def counted(df, key="doc_id"):
    return sorted([(r[key] is None, r[key] or 0) for r in df.collect()])


EXPECTED = sorted([(i is None, i or 0) for i, _ in ROWS])


# 1: language
def labelled(spark):
    rows = [(i, " ".join(random.Random(i).choice(w) for _ in range(30)), lang) for i in range(60) for lang, w in [("aa", ["kato", "mika", "tako"])] if i % 2 == 0]
    rows += [(i, " ".join(random.Random(i).choice(["strum", "pflock", "schrank"]) for _ in range(30)), "bb") for i in range(60) if i % 2]
    return spark.createDataFrame([*rows, (100, "text", None), (101, None, "aa")], "doc_id long, text string, lang string")


def test_language_cases(spark, docs, wide, empty):
    model = language_id.learn(labelled(spark))
    assert model[0] == ["aa", "bb"]
    out = language_id.identify(wide, model)
    assert counted(out) == EXPECTED and out.columns.count("score") == 1
    got = [(r.text, r.lang_pred, r.score) for r in out.collect()]
    assert all((p == "und" and s == 0) == (not any(c.isalpha() for c in t or "")) for t, p, s in got)
    assert all(0 <= s <= 1 for _, _, s in got)
    assert language_id.identify(empty, model).count() == 0
    none = language_id.learn(labelled(spark).limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = language_id.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    ids = [r for r in out.select("doc_id", "held_out").collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in ids)


def test_bound_vectors_follow_the_definition():
    text = "abca"
    letters, codes = language_id._letters(), language_id._codes()
    seq = [0, *[int(codes[ord(c)]) for c in text], 0]
    want = sum(np.prod([np.roll(letters[seq[i + k]], k) for k in range(3)], axis=0).astype(int) for i in range(len(seq) - 2))
    assert np.array_equal(language_id.text_vector(text), want)


# 2: fingerprints
def test_fingerprint_cases(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(ctph, "RANGE_BYTES", 50_000)
    got = ctph.compared_with_edit(docs)
    assert counted(got) == EXPECTED
    rows = sorted([(i if i is not None else -(2**63), t or "") for i, t in ROWS], key=lambda x: (-x[0], x[1]))
    want = {}
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.setdefault((i, len(t)), []).append((hashlib.sha256(edited.encode()).hexdigest(), ctph.fingerprint(t.encode()), ctph.fingerprint(edited.encode())))
    for r in got.collect():
        key = (r.doc_id if r.doc_id is not None else -(2**63), r.n_chars)
        assert (r.edited_sha256, r.fingerprint, r.edited_fingerprint) in want[key]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert ctph.compared_with_edit(empty).count() == 0
    one = spark.createDataFrame([(1, "alone and only")], "doc_id long, text string")
    assert ctph.compared_with_edit(one).first().near_next == 1.0


def plain_fingerprint(raw):
    """The same rule byte by byte, with Python integers."""
    if not raw:
        return ""
    m32, m64 = 2**32 - 1, 2**64 - 1
    marks = []
    for i in range(len(raw)):
        h = sum(int(ctph._BYTE32[raw[i - k]]) * int(ctph._ROLL[k]) for k in range(min(ctph.SPAN, i + 1))) & m32
        h ^= h >> 15
        h = h * 0x2C1B3C6D & m32
        h = ((h ^ h >> 12) + 1) & m32
        marks.append(None if h % 3 else 32 if h == 0 else (h & -h).bit_length() - 1)
    level = next(k for k in range(33) if sum(x is not None and x >= k for x in marks) <= ctph.LETTERS - 1)
    parts = [str(3 << level)]
    for k in range(level, level + ctph.LEVELS):
        ends = [i + 1 for i, x in enumerate(marks) if x is not None and x >= k]
        if not ends or ends[-1] != len(raw):
            ends.append(len(raw))
        letters = []
        for a, b in zip([0, *ends], ends):
            own = sum(int(ctph._BYTE[c]) * pow(0x9E3779B97F4A7C15, j, 2**64) for j, c in enumerate(raw[a:b])) & m64 ^ (b - a)
            letters.append(chr(ctph._ALPHABET[int(ctph.mix(np.array([own], np.uint64))[0]) >> 58]))
        parts.append("".join(letters))
    return ":".join(parts)


def test_fingerprints_equal_a_plain_rule(spark, monkeypatch):
    texts = [prose(n, n) for n in (1, 2, 5, 40, 300)] + ["", "x", "漢字 é" * 30, "a" * 500]
    want = [plain_fingerprint(t.encode()) for t in texts]
    assert [ctph.fingerprint(t.encode()) for t in texts] == want
    for size in (7, 50, 333):
        monkeypatch.setattr(ctph, "SEGMENT", size)
        assert [ctph.fingerprint(t.encode()) for t in texts] == want
    monkeypatch.undo()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(99, None, "clash")], "doc_id long, text string, fingerprint string")
    assert {r.doc_id: r.fingerprint for r in ctph.fingerprints(df).collect()} == dict(enumerate(want)) | {99: ""}


def test_next_document_where_one_id_has_most_rows(spark, monkeypatch):
    monkeypatch.setattr(ctph, "RANGE_BYTES", 3000)
    r = random.Random(3)
    rows = [(r.choice([5, 5, 5, None, i]), prose(r.randint(0, 30), i)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert df.count() == 300 and ctph.with_next(df).where("_guest = 0").groupBy("_range").count().agg(F.max("count")).first()[0] < 60
    order = sorted([(i if i is not None else -(2**63), t) for i, t in rows], key=lambda x: (-x[0], x[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((i, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = [(x.doc_id if x.doc_id is not None else -(2**63), x.edited_sha256) for x in ctph.compared_with_edit(df).collect()]
    assert sorted(got) == sorted(want)


def test_small_edits_keep_likeness():
    a = prose(800, 7)
    b = a[:2000] + "changed" + a[2010:]
    f, g, h = (ctph.fingerprint(x.encode()) for x in (a, b, prose(800, 8)))
    assert ctph.likeness(f, g) > 0.8 and ctph.likeness(f, h) == 0 and ctph.likeness(f, f) == 1
    assert ctph.likeness("", "") == 1 and ctph.likeness("", f) == 0


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
            p = q
        return p[-1]

    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 70))) for _ in range(2))
        assert ctph.edit_distance(a, b) == plain(a, b)


# 3: toxicity
def test_toxicity_cases(spark, docs, wide, empty):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(40, i) + (" vileword nastyword" if bad else "")))
        labels.append((i, 0 if i % 8 == 0 else 1, int(bad)))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (999, 1, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.learn(texts, marks)
    assert [x.name for x in chain.links] == ["low_quality", "toxic"] and len(chain.links[1].earlier) == 1
    fresh = spark.createDataFrame([(1, prose(50, 901) + " vileword nastyword"), (2, prose(50, 902))], "doc_id long, text string")
    assert {r.doc_id: r.is_toxic for r in toxicity.score_chain(fresh, chain).collect()} == {1: True, 2: False}
    out = toxicity.score_chain(wide, chain)
    assert counted(out) == EXPECTED and out.columns.count("p_toxic") == 1
    assert toxicity.score_chain(empty, chain).count() == 0
    nothing = toxicity.learn(texts, marks.limit(0))
    assert not any(r.is_toxic for r in toxicity.score_chain(docs, nothing).collect())
    alone = toxicity.learn(texts, marks.where("toxic = 0"))
    assert not any(r.is_toxic for r in toxicity.score_chain(docs, alone).collect())


def test_toxicity_ties_nulls_and_further_categories(spark):
    r = random.Random(9)
    texts = [(i, " ".join(["vile"] * (i % 2) + ["rude"] * (i % 3 == 0) + [r.choice(VOCABULARY) for _ in range(20)])) for i in range(300)]
    docs = spark.createDataFrame([*texts, (0, "again " + texts[0][1])], "doc_id long, text string")
    marks = [(i, int(i % 3 == 0) if i % 5 else None, i % 2, i % 2) for i, _ in texts]
    table = spark.createDataFrame([*marks, (1, 0, 0, 0), (3, None, None, 7)], "doc_id long, rude int, loud int, vile int")
    chain = toxicity.learn(docs, table, ["rude", "loud", "vile"])
    assert [x.name for x in chain.links] == ["rude", "loud", "vile"] and [len(x.earlier) for x in chain.links] == [0, 1, 2]
    again = toxicity.learn(docs.repartition(5), table.repartition(3), ["rude", "loud", "vile"])
    assert [(x.weights, x.intercept) for x in chain.links] == [(x.weights, x.intercept) for x in again.links]
    fresh = spark.createDataFrame([(1, "vile things"), (2, "rude things"), (3, "plain things")], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.score_chain(fresh, chain).collect()}
    assert got[1].p_vile > 0.5 > got[3].p_vile and got[2].p_rude > 0.5 > got[3].p_rude


def test_toxicity_chain_equals_a_plain_one():
    """The sparse learner against plain gradient descent on the same features, and the chain's order of links."""
    r = np.random.default_rng(4)
    n, d = 400, 12
    x = (r.random((n, d)) < 0.4).astype(float)
    y1 = (x[:, 0] + x[:, 1] > 1).astype(float)
    y2 = ((y1 > 0) | (x[:, 2] * x[:, 3] > 0)).astype(float)
    found = [toxicity.pack({k: 1 for k in range(d) if row[k]}) for row in x]
    chain = toxicity.train_chain(found, list(range(n)), {"a": y1, "b": y2}, np.ones(n), l1=0.0)
    link = chain.links[0]
    w, b = np.zeros(d), 0.0
    kept = np.array([k in link.weights for k in range(d)])
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(x[:, kept] @ w[kept] + b)))
        w[kept] -= 0.5 * x[:, kept].T @ (p - y1) / n
        b -= 0.5 * float((p - y1).mean())
    plain = 1 / (1 + np.exp(-(x[:, kept] @ w[kept] + b)))
    own = 1 / (1 + np.exp(-(x @ np.array([link.weights.get(k, 0.0) for k in range(d)]) + link.intercept)))
    assert ((plain > 0.5) == (own > 0.5)).mean() > 0.99
    # The second link uses the first: out-of-fold log-odds at learning, its probability at prediction.
    assert chain.links[1].earlier[0] > 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 <> 0"), marks.where("doc_id % 3 <> 0"))
    out = toxicity.score_chain(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0"), chain).join(marks, "doc_id")
    n = out.groupBy("toxic").agg(F.avg(F.col("is_toxic").cast("int")).alias("share")).collect()
    share = {r.toxic: r.share for r in n}
    assert share[1] > 0.85 and share[0] < 0.01


# 4: urls
URLS = [None, "", "no scheme", "http://net", "http://NET/", "https://a.b.net/x?y#z", "http://example.net/en/", "http://www.Example.NET/en/x", "http://example.net/english", "http://xexample.net/en/", "http://sub.example.com/de/1", "http://org/fr/", "http://a.org/fr/", "http://a.org/fr", "http://a.org?x=/fr/", "http://example.net/en/", "http://.net/", "x://y://z.net/"]


def test_url_cases(spark):
    rows = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(3, "http://net/", "c", "c")], "page_id long, url string, rule string, host string")
    entries = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    got = url_filter.judge(rows, entries).collect()
    assert len(got) == len(URLS) + 1

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fit = [(r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        r, v = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, r, v

    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r
    assert url_filter.judge(rows.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filter.judge(rows, entries.limit(0)).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    small = url_filter.BlockedBloom.build(keys, max_bytes=4096)
    full = url_filter.BlockedBloom.build(keys)
    own = np.array([r.h for r in keys.select(F.xxhash64("key").alias("h")).collect()], np.int64)
    other = np.array([r.h for r in spark.range(5000).select(F.xxhash64(F.concat(F.lit("z"), "id")).alias("h")).collect()], np.int64)
    assert small.passes(own).all() and full.passes(own).all()
    assert full.passes(other).mean() < 0.02


def test_url_paths_inside_a_directory(spark):
    rows = spark.createDataFrame([(1, "http://a.com/dexter/x"), (2, "http://a.com/d"), (3, "http://a.com/de")], "page_id long, url string")
    entries = spark.createDataFrame([("a.com/de", "block"), ("a.com", "allow"), (None, "block")], "rule string, verdict string")
    assert {r.page_id: r.rule for r in url_filter.judge(rows, entries).collect()} == {1: "a.com/de", 2: "a.com", 3: "a.com/de"}


def test_deep_urls_and_deep_entries(spark):
    deep, wide = "http://a.com" + "/x" * 5000, "http://" + "s." * 3000 + "b.a.com/x/y/z"
    rows = spark.createDataFrame([(1, deep), (2, wide), (3, "http://a.com/x/y"), (4, "http://com/x/y/z")], "page_id long, url string")
    entries = spark.createDataFrame([("com/x/", "block"), ("b.a.com/x/y/", "allow"), ("a.com/x/x/x/", "allow")], "rule string, verdict string")
    assert {r.page_id: r.rule for r in url_filter.judge(rows, entries).collect()} == {1: "a.com/x/x/x/", 2: "b.a.com/x/y/", 3: "com/x/", 4: "com/x/"}


def test_long_list_without_broadcasts(spark):
    """100,000 entries joined by shuffle; only urls that pass the filter reach the join."""
    entries = spark.range(100_000).select(F.concat(F.lit("h"), "id", F.lit(".org/d/")).alias("rule"), F.lit("block").alias("verdict"))
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://w.h"), F.col("id") * 67, F.lit(".org/"), F.when(F.col("id") % 2 == 0, "d/x").otherwise("e/x")).alias("url"))
    rows = rows.unionByName(spark.range(2000).select((F.col("id") + 3000).alias("page_id"), F.lit("http://h5.org/d/hot").alias("url")))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(rows, entries).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {i: (f"h{i * 67}.org/d/", "block") if i % 2 == 0 and i * 67 < 100_000 else (None, "allow") for i in range(3000)}
    assert got == want | {3000 + i: ("h5.org/d/", "block") for i in range(2000)}


def test_host_and_path_of_any_column(spark):
    row = spark.createDataFrame([("https://A.b/c?d",)], "link string").select(*url_filter.host_and_path(F.col("link"))).first()
    assert tuple(row) == ("a.b", "/c")


# 5: repeated passages
def flat(text):
    return b" ".join((text or "").encode().split()).decode()


def brute_repeats(rows, n):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2000, 1 << 20])
def test_repeats_cases(spark, docs, wide, empty, block):
    shared = prose(40, 50)
    rows = ROWS + [(20 + i, prose(30, 60 + i) + " " + shared + " " + prose(20, 90 + i)) for i in range(8)] + [(40, prose(12, 60)), (41, prose(12, 60)), (42, prose(13, 60)), (43, prose(13, 60)), (44, " ".join(["spam"] * 50)), (45, " ".join(["spam"] * 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = repeats.remove_repeats(df, 13, block).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, flat(r.text)) for r in got], key=str) == brute_repeats(rows, 13)
    untouched = {r.text for r in got if r.n_removed == 0}
    assert None in untouched and "  \n\t " in untouched
    if block > 2000:
        out = repeats.remove_repeats(wide)
        assert counted(out) == EXPECTED and out.columns.count("n_words") == 1
        assert repeats.remove_repeats(empty).count() == 0


def test_repeats_leave_rows_without_an_id(spark):
    text = prose(30, 70)
    rows = [(1, text), (2, text), *[(None, text)] * 20]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 13, 200).collect()
    assert sorted(((r.doc_id or 0, r.n_words, r.n_removed, r.text) for r in got)) == [*[(0, 30, 0, text)] * 20, (1, 30, 0, text), (2, 30, 30, "")]


@pytest.mark.parametrize("most", [1, 20, 90, 10**6])
def test_repeats_located_by_several_automata(most):
    """Documents by themselves past small shards: masks as by brute force; without passages nothing is found."""
    shared = [prose(60, 500 + i) for i in range(4)]
    rows = [(i, " ".join([prose(9, 600 + i), shared[i % 4], prose(5, 700 + i), shared[i // 2 % 4]])) for i in range(9)]
    table = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "_fp": [str(i) for i, _ in rows]})
    block = repeats.Block(table, set(), 13)
    h, at = np.unique(block.windows()[block.inside], return_inverse=True)
    first = np.full(len(h), 10**9)
    np.minimum.at(first, at, block.doc[block.inside])
    passages = [(owner, words) for owner, words, _ in block.passages(h, first)]
    docs = [(i, t.encode()) for i, t in rows]
    masks = repeats.located(docs, passages, 13, most)
    want = {i: gone for i, _, gone, _ in brute_repeats(rows, 13)}
    assert [int(masks[k].sum()) if k in masks else 0 for k in range(len(rows))] == [want[i] for i, _ in rows] and sum(want.values()) > 400
    assert repeats.located(docs, [], 13, most) == {}
    assert max(len(x.automaton) for x in repeats.shards(passages, 13, most)) <= max(most, repeats.PASSAGE_WINDOWS)


def test_repeats_long_passages_in_pieces(monkeypatch):
    """Passages cut between windows still hold every window once."""
    monkeypatch.setattr(repeats, "PASSAGE_WINDOWS", 7)
    table = pa.table({"doc_id": [1], "text": [prose(90, 3)], "_fp": ["a"]})
    block = repeats.Block(table, set(), 13)
    h = np.unique(block.windows())
    found = list(block.passages(h, np.ones(len(h), np.int64)))
    assert sorted(x for _, _, w in found for x in w) == sorted(block.windows().view(np.int64).tolist())
    assert all(len(words.split()) == len(w) + 12 for _, words, w in found)


# 6: byte pairs
def test_bpe_cases(spark, docs, wide, empty):
    c, pattern = bpe.codec(BPE), bpe.compiled(public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    for r in bpe.encode(wide, BPE, public_tokenizers.PATTERN).collect():
        assert list(r.ids) == known.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.digests(empty, BPE, public_tokenizers.PATTERN).count() == 0
    r = random.Random(1)
    letters = "abcdefgh ééçñ漢字かな1234  \n\t!?'s 🙂ﬁ́Ωя"
    for _ in range(3000):
        s = "".join(r.choice(letters) for _ in range(r.randint(1, 40)))
        assert np.frombuffer(c.encode_text(s, pattern), "<u4").tolist() == known.encode_ordinary(s)
    for s in ("a" * 5000, " " * 5000, "ab" * 3000, "éa" * 2000, "aaaab" * 999):
        assert np.frombuffer(c.encode_text(s, pattern), "<u4").tolist() == known.encode_ordinary(s)


# 7: line quality
def test_line_cases(spark, docs, wide, empty):
    out = line_quality.clean_lines(wide)
    assert counted(out) == EXPECTED and out.columns.count("kept") == 1
    assert all(r.base_failed and not r.kept for r in out.collect() if not (r.text or "").split())
    assert line_quality.clean_lines(empty).count() == 0
    good = "\n".join(" ".join(f"w{i}x{k}" for k in range(12)) + "." for i in range(6))
    rows = [(1, good), (2, good + "\nHome | News | Sport | Contact"), (3, "\n".join(f"no end of line {i} " + prose(9, i) for i in range(9))), (4, good + "\nall rights reserved. Privacy Policy."), (5, "\n".join(" ".join(w + "###" for w in prose(12, i).split()) + "." for i in range(6)))]
    got = {r.doc_id: r for r in line_quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4, 5)] == [True, True, False, True, False]
    assert [got[i].n_removed_lines for i in (1, 2, 3, 4, 5)] == [0, 1, 9, 1, 6] and got[2].clean_text == good


def test_one_rule_for_lines_of_any_length(spark):
    """A line's verdict depends on shares, so one more character changes nothing but at the share itself."""
    def fails(lines):
        df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string")
        return [r.f for r in df.select("k", line_quality.line_fails(F.col("x")).alias("f")).orderBy("k").collect()]

    for n in (298, 299, 300, 301):
        sentence = ("words " * 100)[: n - 1].rstrip() + "."
        assert fails([sentence, sentence[:20] + " privacy policy " + sentence[36:], "a | b | c | " + sentence[12:]]) == [False, False, False]
    assert fails(["Read our privacy policy.", "a | b | c | d."]) == [True, True]
    assert fails(["One sentence is here. And a tail", "Short. But a tail that is longer than all before it", "no end"]) == [False, True, True]


def test_long_lines_are_judged_by_share(spark):
    body, tail = prose(150, 400) + ".", " " + prose(150, 401) + "."
    menu = " | ".join(f"Entry{i} of menu" for i in range(60)) + "."
    furniture = "Read our privacy policy, cookie policy, terms of use and terms of service. " * 8
    cases = {
        body + " «Oui», dit-elle, «non» ou «peut-être»." + tail: True,
        body + " »Ja«, »nein« und »vielleicht«.": True,
        body + " See our privacy policy." + tail: True,
        body + " Home | News | Sport | Contact." + tail: True,
        menu: False,
        furniture: False,
        "«Oui», dit-elle, «non» ou «peut-être», et puis «merci».": True,
        "« Back | One | Two | Three | Next ».": False,
        "Home » News » Sport » Contact.": False,
        "See our privacy policy.": False,
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r.text: r for r in line_quality.clean_lines(rows).collect()}
    assert {t: r.n_removed_lines == 0 for t, r in got.items()} == cases
    assert all(r.kept for t, r in got.items() if cases[t] and t.startswith(body))


SCRIPTS = ["यह एक वाक्य है।", "هل هذا سؤال؟", "یہ ایک جملہ ہے۔", "这是一个句子。", "これは文です」", "Սա նախադասություն է։", "ይህ ዓረፍተ ነገር ነው።", "นี่คือประโยค"]


def test_lines_of_many_scripts_and_own_phrases(spark):
    rows = spark.createDataFrame(list(enumerate(SCRIPTS)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed_lines for r in line_quality.clean_lines(rows).collect()}
    assert [got[i] for i in range(len(SCRIPTS))] == [0] * 7 + [1]
    own = spark.createDataFrame([(1, "Buy a+b now."), (2, "See our privacy policy.")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed_lines for r in line_quality.clean_lines(own, phrases=["a+b"]).collect()} == {1: 1, 2: 0}
    assert {r.n_removed_lines for r in line_quality.clean_lines(own, phrases=[]).collect()} == {0}


def test_lines_equal_sql_on_hard_lines(spark):
    import duckdb

    r, parts = random.Random(8), [*SCRIPTS, "«a» b »c« ‹d› | e", "Home » News » Sport.", "all rights reserved", "Datenschutzerklärung hier.", prose(70, 5) + ".", prose(70, 6), "# * $ x", "| " * 30, " \t", "Privacy Policy. " * 30, "entry | " * 60 + "."]
    rows = [(i, r.choice([" ", "\n", "\n"]).join(r.choice(parts) for _ in range(r.randint(1, 12)))) for i in range(400)]
    own = line_quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    c = duckdb.connect()
    c.execute("create table documents(doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    found = c.execute(line_quality.OP7_SQL)
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, own.select(*names).collect())) == sorted(found.fetchall())


# 8: near duplicates
def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        sets.setdefault(i, set()).update([tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else []))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicate_cases(spark, docs, wide, empty):
    out = neardup.near_duplicates(wide, 4)
    assert counted(out) == EXPECTED and out.columns.count("kept") == 1
    assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in out.collect())
    assert neardup.near_duplicates(empty, 4).count() == 0
    want = brute_components(ROWS, 4, 80)
    for r in neardup.near_duplicates(docs, 4).collect():
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)


def test_near_duplicate_groups(spark):
    """A text and many copies with more or fewer edits, and chains whose ends are unlike."""
    r, rows = random.Random(4), []
    base = prose(160, 300).split()
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"edit{r.random()}"
        rows.append((1000 + i, " ".join(w)))
    chain = prose(200, 301).split()
    for i in range(30):
        chain = chain[3:] + [f"new{i}a", f"new{i}b", f"new{i}c"]
        rows.append((2000 + (i * 7) % 31, " ".join(chain)))
    rows += [(3000 + i, f"tiny text {i % 3}") for i in range(9)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4).collect()
    assert {x.doc_id: x.component_id for x in got} == brute_components(rows, 4, 80)


# 9: packing
def test_packing_cases(spark, docs, wide, empty):
    out = packing.packed(wide, WORDS).collect()
    t = Tokenizer.from_file(WORDS)
    want = {}
    for i, x in ROWS:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault((i, len(ids)), []).append(ids)
    spans = {}
    for r in out:
        assert any(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in want[r.doc_id, r.doc_tokens])
        spans.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for key, ids in want.items():
        got = sorted(spans[key])
        assert sum(n for _, n in got) == sum(map(len, ids)) and len({a for a, _ in got}) * len(ids) == len(got)
    room = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert room.get(r.sequence_id, 0) == r.offset
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= packing.CAPACITY
    assert packing.packed(empty, WORDS).count() == 0


def test_cuts_cover_and_fit():
    for n in [*range(1, 4100), 9000, 100_001]:
        parts = packing.cuts(n)
        assert sum(a for a, _ in parts) == n
        assert all(a * k <= packing.CAPACITY for a, k in parts)


def test_full_bins_waste_little(spark):
    sf = "/root/testdata/sf0.1"
    out = packing.op9_packing(spark, sf).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    r = out.agg(F.sum("n").alias("n"), F.sum(F.lit(4096) - F.col("n")).alias("pad")).first()
    assert r.pad < 0.01 * r.n


def test_best_fit_and_rows_of_one_id(spark, monkeypatch):
    r = random.Random(2)
    sizes = [r.randint(1, 100) for _ in range(500)]
    bins = {}
    for (b, at), n in zip(packing.best_fit(sizes, 100), sizes, strict=True):
        bins.setdefault(b, []).append((at, n))
    assert sum(map(len, bins.values())) == 500 and len(bins) <= 1.1 * sum(sizes) / 100
    for rows in bins.values():
        rows.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and rows[0][0] == 0 and sum(rows[-1]) <= 100
    monkeypatch.setattr(packing, "BLOCK_PIECES", 20)
    monkeypatch.setattr(packing, "GROUP_BLOCKS", 3)
    rows = [(7 if i % 3 else None, prose(r.randint(1, 300), i)) for i in range(400)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect()
    bins = {}
    for x in out:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for rows in bins.values():
        rows.sort()
        assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and sum(rows[-1]) <= packing.CAPACITY
    total = sum(x.length for x in out)
    assert total > 50_000 and len(bins) * packing.CAPACITY < 1.06 * total + packing.CAPACITY


# 10: pages
def test_page_cases(spark):
    model = pages.learn(150)
    page = '<html><head><title>T</title><script>x="<p>no</p>"</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy things now.</div><article><h1>A title &amp; more</h1><p>First   paragraph of text,\n with &eacute; and <b>bold</b> words, long enough to be read.<p>Second one &lt;here&gt;, also with some length to it.</p></article><footer>&copy; me</footer></body></html>'
    want = "A title & more\n\nFirst paragraph of text, with é and bold words, long enough to be read.\n\nSecond one <here>, also with some length to it."
    rows = [(1, page), (2, None), (3, ""), (4, "<"), (5, page[: page.index("<footer")]), (1, page), (6, "<p>" * 3000 + "deep"), (None, page)]
    df = spark.createDataFrame([(i, "u", h, "clash", "clash") for i, h in rows], "page_id long, url string, html string, text string, n_chars string")
    got = pages.extract(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.html is not None and r.html.startswith("<html"):
            assert r.text == want
        if not r.html or r.html == "<":
            assert r.text == ""
    assert pages.extract(df.limit(0), model).count() == 0


def test_pages_held_out():
    model, maker = pages.learn(), pages._Maker(77)
    right = wrong = missed = 0
    for _ in range(150):
        page = pages.parse(maker.page())
        main = np.zeros(len(page.tags), bool)
        for node, run in page.runs:
            if maker.MAIN in run:
                main[node] = True
        page.runs = [(n, t.replace(maker.MAIN, "")) for n, t in page.runs]
        x, own = pages.features(page)
        keep, main = pages.chosen(page, own, model.odds(x)), main & (own > 0)
        right += own[keep & main].sum()
        wrong += own[keep & ~main].sum()
        missed += own[main & ~keep].sum()
    assert right / (right + wrong) > 0.99 and right / (right + missed) > 0.98


ARTICLE = "<article><h1>A title</h1><p>First paragraph of text, with some words, long enough to be read.</p><p>Second one, also with some length to it, and a full stop.</p></article>"


def test_pages_with_end_tags_left_out():
    model = pages.learn(150)

    def main(source):
        page = pages.parse(source)
        x, own = pages.features(page)
        keep = pages.chosen(page, own, model.odds(x))
        return {run.strip() for node, run in page.runs if keep[node] and run.strip()}

    want = main(f"<html><head><title>T</title></head><body>{ARTICLE}</body></html>")
    assert len(want) == 3
    for start in ("<body>", "", "<div>", "</title><body>"):
        assert main(f"<html><head><title>T</title><meta charset=utf-8><script>x='<p>'</script>{start}{ARTICLE}") == want
    for hidden in ("<button>Menu", "<select><option>One<option>Two", "<svg><path d='M0'>", "<object data=x>", "<button>A<button>B</button>", "<object><object></object>"):
        assert main(f"<html><head></head><body>{hidden}{ARTICLE}</body></html>") == want, hidden
    # An element with its end tag hides all of its content, blocks too.
    page = pages.parse("<body><button><div>Hidden</div></button><object><p>Also</p></object><p>Seen</p>")
    assert {run for node, run in page.runs if pages.features(page)[1][node] > 0} == {"Seen"}
    page = pages.parse("<head><title>T</title>Bare text")
    assert {run for node, run in page.runs if pages.features(page)[1][node] > 0} == {"Bare text"}


def test_pages_read_classes_among_long_attributes():
    long = " ".join(f'data-x{i}="{"v" * 50}"' for i in range(40))
    for tag in (f'<div {long} class="ad box" id=side>', f'<div class="ad box" {long} id=side>', '<div class="ad box" id=side>'):
        assert pages.parse(tag + "text</div>").tokens[1] == ("ad", "box", "side")
    many = " ".join(f"c{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    assert len(pages.parse(f"<div class='{many}'>").tokens[1]) == 600
    for i in range(2 * pages.KEPT_VALUES):
        pages.parse(f'<div data-n="{i}" class="c{i}">')
    assert pages._value_tokens.cache_info().currsize <= pages.KEPT_VALUES


def main_text(model, source):
    page = pages.parse(source)
    x, own = pages.features(page)
    return pages.render(page, pages.chosen(page, own, model.odds(x)))


def test_pages_marked_by_hand():
    """Whole pages in the manner of several generators, each with the text that a reader would take from it."""
    model = pages.learn()
    one = "Rivers carry sand and stones for many miles, and where they slow down they leave them behind."
    two = "Over centuries such places grow into wide plains, on which most of the old towns were built."
    blog = f'<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>Rivers</title><style>p{{color:red}}</style></head><body class="home"><header class="site-header"><a href="/">Site</a><nav class="menu"><ul><li><a href="/a">About</a></li><li><a href="/b">Blog</a></li></ul></nav></header><main id="content"><article class="post"><h1>Rivers</h1><p>{one}</p><p>{two}</p></article><section id="comments" class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>Nice post, thanks for writing it.</p></div></section></main><aside class="sidebar"><h3>Recent</h3><ul><li><a href="/1">One</a></li></ul></aside><footer>&copy; 2020 Site</footer></body></html>'
    plain = f"<html><body><h1>Rivers</h1><p>{one}<p>{two}</body></html>"
    divs = f'<html><head><title>x</title></head><body><div id="nav"><a href="/">Home</a> <a href="/n">News</a></div><div class="wrapper"><div class="article-body"><h1>Rivers</h1><p>{one}</p><div class="advert">Cheap boats, buy now!</div><p>{two}</p></div></div><div class="cookie-notice">We use cookies. <button>OK</button></div></body></html>'
    quoted = divs.replace('<p>', '<p title="unclosed>', 1)
    want = f"Rivers\n\n{one}\n\n{two}"
    for source in (blog, plain, divs, quoted):
        assert main_text(model, source) == want


@pytest.mark.parametrize("piece", ['<a href="x', "<a ", '<a "', "<a '>", "<", "</b>", "<b>", '<a href="x">', "<hr><b>", "<li>", '<p title="unclosed>text', "<!--", "&amp;", "<script>", "</", "<p class='a\">"])
def test_pages_of_one_repeated_piece_are_read_in_linear_time(piece):
    sizes, took = [1 << 16, 1 << 19], []
    for n in sizes:
        source = piece * (n // len(piece))
        at = time.process_time()
        pages.parse(source)
        took.append(time.process_time() - at)
    assert took[1] < 4 * 8 * max(took[0], 0.02)
