"""The suffix order against plain sorting, and byte-level deduplication against a plain search."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.llm import suffixes


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_equals_sorting(seed):
    r = random.Random(seed)
    for _ in range(150):
        letters = b"\0ab\xff"[: r.randint(1, 4)]
        texts = [bytes(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 6))]
        words = suffixes.Words(texts)
        order = suffixes.suffix_order(words).tolist()
        suffix = {k * words.width + i: t[i:] for k, t in enumerate(texts) for i in range(len(t))}
        assert sorted(order) == sorted(suffix)
        assert [suffix[x] for x in order] == sorted(suffix.values())
        n = r.randint(1, 12)
        text, offset, same = suffixes.equal_windows(texts, n)
        windows = [texts[k][i : i + n] for k, i in zip(text.tolist(), offset.tolist(), strict=True)]
        assert sorted(windows) == sorted(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        assert len(set(zip(windows, same.tolist(), strict=True))) == len(set(windows)) == len(set(same.tolist()))


def test_lyndon_words_and_pointers():
    text = b"banana nana bandana"
    words = suffixes.Words([text])
    for i in range(len(text)):
        end = next((j for j in range(i + 1, len(text)) if text[j:] < text[i:]), len(text))
        before = next((j for j in range(i - 1, -1, -1) if text[j:] < text[i:]), -1)
        assert (words.ends[i], words.previous[i]) == (end, before)
    rank = suffixes.group_order(words.first, words.part, words.times, words.at)
    named = {int(words.word[i]): text[i : words.ends[i]] for i in range(len(text))}
    assert [named[w] for w in np.argsort(rank).tolist()] == sorted(named.values())


def test_deep_nesting_and_long_runs():
    # Growing words hang in one another, runs of one byte hang in a row.
    for text in (b"".join(b"a" * k + b"b" for k in range(12, 0, -1)), b"a" * 150, b"a" * 149 + b"b", bytes(range(150)), bytes(range(150))[::-1]):
        words = suffixes.Words([text, text])
        order = suffixes.suffix_order(words)
        suffix = [text[x % words.width :] for x in order.tolist()]
        assert suffix == sorted(suffix)


def plain(rows, n):
    """(id, kept bytes, removed runs) by looking for every string in every document."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - n + 1):
                w = t[k : k + n]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        gone, seen = [False] * len(t), set()
        for k in range(len(t) - n + 1 if i is not None else 0):
            w = t[k : k + n]
            if w in seen or least[w] < i:
                gone[k : k + n] = [True] * n
            seen.add(w)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(gone), runs))
    return sorted(out, key=str)


def ours(df):
    return sorted([(r.doc_id, bytes(r.kept_bytes), sum(x.length for x in r.removed), len(r.removed)) for r in df.collect()], key=str)


R = random.Random(3)
SHARED = ["".join(R.choice("abcdefgh ") for _ in range(300)) for _ in range(4)]


def rows(seed):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("ijklmnop é漢") for _ in range(n))
    out = [(k, noise(r.randint(0, 60)) + (s := r.choice(SHARED))[(a := r.randint(0, 150)) : a + r.randint(20, 150)] + noise(r.randint(0, 40)) + s[a : a + r.randint(0, 90)]) for k in range(40)]
    whole = noise(400)
    out += [(100 + k, whole) for k in range(9)] + [(100, whole), (100, whole + "tail")]
    out += [(200, "x" * 700), (201, "ab" * 300), (202, "y" + "ab" * 100), (203, "x" * 99), (204, "漢" * 200), (205, "a漢" * 90)]
    return out + [(300, None), (301, ""), (302, "  \n\t "), (None, whole), (None, SHARED[0]), (None, None), (303, SHARED[0] + noise(9000) + SHARED[0])]


@pytest.mark.parametrize("length, hot, block", [(100, 20_000, None), (100, 3, 2000), (30, 20_000, 700), (8, 50, 5000), (1, 20_000, 5000)])
def test_equals_plain_search(spark, monkeypatch, length, hot, block):
    monkeypatch.setattr(suffixes, "HOT_SEGMENTS", hot)
    data = rows(length)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert ours(suffixes.remove_repeated_bytes(df, length, block)) == plain(data, length)


def test_small_sorts_and_stretches(monkeypatch):
    monkeypatch.setattr(suffixes, "_STRETCH", 64)
    monkeypatch.setattr(suffixes, "SORTED_BYTES", 200)
    data = [(i, t) for i, t in rows(7) if i is not None and len((t or "").encode()) >= 50]
    block = suffixes.Block([i for i, _ in data], [t.encode() for _, t in data], 50)
    mask = suffixes.removed_bytes(block, np.zeros(0, np.uint64), {})
    at = 0
    for _, t in data:
        raw, seen, gone = t.encode(), set(), np.zeros(len(t.encode()), bool)
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in seen:
                gone[k : k + 50] = True
            seen.add(raw[k : k + 50])
        assert np.array_equal(mask[at : at + len(raw)], gone)
        at += len(raw)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame(rows(1)[:20], "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("n_bytes", "removed", "kept_bytes", "segment", "g", "_block")})
    out = suffixes.remove_repeated_bytes(df)
    assert out.columns == ["doc_id", "text", "segment", "g", "n_bytes", "removed", "kept_bytes"]
    assert {(r.segment, r.g) for r in out.collect()} == {("clash", "clash")}
    assert suffixes.remove_repeated_bytes(df.limit(0)).count() == 0


def test_query_digest(spark, tmp_path):
    data = rows(5)
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op13_suffix_array(spark, str(tmp_path)).collect()], key=str)
    sizes = {}
    for (i, t) in data:
        sizes.setdefault(i, []).append(len((t or "").encode()))
    want = [(i, gone + len(kept), gone, runs, hashlib.sha256(kept).hexdigest()) for i, kept, gone, runs in plain(data, 100)]
    assert got == sorted(want, key=str)
