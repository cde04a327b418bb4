"""Chunks by topic and by structure: the curve and its minima against plain definitions, borders where they belong, nothing lost."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.functions import chunking as c


def prose(words, n, r, per=9):
    return "".join(" ".join(r.choice(words) for _ in range(per)).capitalize() + r.choice([". ", "! ", "? ", ".\n"]) for _ in range(n))


ONE = [f"harbor{k}" for k in range(25)]
TWO = [f"violin{k}" for k in range(25)]


def test_similarities_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(c, "STRETCH", 7)
    r = random.Random(1)
    found = c.sentences(prose(ONE, 30, r) + prose(TWO, 25, r) + "... ... ... ... ... ... ... ")
    vectors = c.hashed_vectors(found)
    got = c.similarities(found, 4)
    assert len(got) == len(found) - 1
    for i in range(1, len(found)):
        a, b = vectors[max(0, i - 4) : i].sum(axis=0), vectors[i : i + 4].sum(axis=0)
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        assert abs(got[i - 1] - (a @ b / norm if norm else 1.0)) < 1e-9


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 40])
def test_smoothing_is_a_local_polynomial(n):
    curve = np.random.default_rng(n).normal(size=n)
    got = c.smoothed(curve)
    for i in range(n if n >= 5 else 0):
        a = min(max(i - 2, 0), n - 5)
        assert abs(np.polyval(np.polyfit(np.arange(a, a + 5), curve[a : a + 5], 3), i) - got[i]) < 1e-8
    assert n >= 5 or np.array_equal(got, curve)


def plain_borders(curve, threshold, tolerance):
    """By walking to both sides of each minimum."""
    n, low = len(curve), []
    for i in range(1, n - 1):
        j = i
        while j + 1 < n and curve[j + 1] == curve[i]:
            j += 1
        if curve[i - 1] > curve[i] and j + 1 < n and curve[j + 1] > curve[i]:
            low.append(i)
    out = []
    for k, i in enumerate(low):
        before = curve[(low[k - 1] if k else 0) : i].max()
        after = curve[i : (low[k + 1] if k + 1 < len(low) else n)].max()
        if min(before, after) - curve[i] >= tolerance * (curve.max() - curve.min()) and curve[i] <= np.quantile(curve, threshold):
            out.append(i)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_borders_equal_plain_ones(seed):
    r = np.random.default_rng(seed)
    curve = r.integers(0, 5, r.integers(0, 40)) / 4 if seed % 2 else r.normal(size=r.integers(0, 40))
    for threshold, tolerance in ((0.01, 0.2), (0.5, 0.2), (1.0, 0.0), (0.8, 0.6)):
        assert c.topic_borders(curve, threshold, tolerance).tolist() == plain_borders(curve, threshold, tolerance)


def test_cut_where_the_topic_changes():
    r = random.Random(2)
    one, two = prose(ONE, 40, r), prose(TWO, 60, r)
    chunks = c.by_topic(one + two)
    assert len(chunks) == 2 and "".join(chunks) == one + two
    assert abs(len(chunks[0]) - len(one)) <= 3 * 90  # within a few sentences of the change


TEXTS = [None, "", " ", "x", "word " * 30000, "no end at all", "a. b! c? d\n" * 50, "\n" * 100, prose(ONE, 300, random.Random(3)), "漢字。" * 5000, "w" * 70000]


def test_nothing_is_lost_and_limits_hold(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    for column in (c.topic_chunks(F.col("t"), 200, 400), c.structure_chunks(F.col("t"), "py", 200, 400), c.structure_chunks(F.col("t"), ".js", 200, 400)):
        for r in df.withColumn("c", column).collect():
            assert (r.c is None) == (r.t is None)
            assert "".join(r.c or []) == (r.t or "") and "" not in (r.c or [])
            assert all(len(x.split()) <= 400 for x in r.c or [])


PY = '''import os

# leads the first
@decorated(")")
def first(a, b=(1, 2)):
    text = """
def not_a_definition():
    (((
"""
    if a:
        return {
            "k": [b],
        }
    else:
        return text


class Second:
    """Doc."""

    def one(self):
        return 1

    def two(self):
        return "}"
'''


def test_definitions_stay_whole():
    chunks = c.by_structure(PY, "hash", target=30)
    assert "".join(chunks) == PY
    assert any("def first" in x and "return text" in x and "# leads the first" in x for x in chunks)
    assert not any(x.lstrip().startswith(("else", "def not_a", "}")) for x in chunks)
    small = c.by_structure(PY, "hash", target=8)
    assert "".join(small) == PY and any(x.strip().startswith("def two") for x in small)


def test_brackets_in_strings_and_comments_do_not_count():
    code = "".join(f"function f{k}() {{\n  // it's }} not closed\n  const s = '{{{{' + `a\n}}`; /* {{\n{{ */\n  return s;\n}}\n\n" for k in range(20))
    chunks = c.by_structure(code, "slash", target=40)
    assert "".join(chunks) == code and len(chunks) > 5
    assert all(re.match(r"\s*function f\d+", x) for x in chunks)


def test_deep_nesting_ends():
    code = "(" * 3000 + "\n" + "\n".join(" " * k + "x(" for k in range(1500))
    assert "".join(c.by_structure(code, "slash", target=10)) == code
