"""Main text: choices against all choices, memory of large pages, pages held together."""

import itertools
import tracemalloc

import numpy as np
import pytest

from skeinworks.llm import pages


@pytest.fixture(scope="module")
def model():
    return pages.learn(40)


def test_choice_is_the_best_of_all(model):
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(2, 10))
        parents = [-1, *[int(rng.integers(0, i)) for i in range(1, n)]]
        page = pages.Page(["p"] * n, parents, [()] * n, [0] * n, [], [])
        own, odds = (rng.random(n) < 0.7).astype(float), rng.normal(size=n)
        total = lambda keep: float(odds[np.array(keep) & (own > 0)].sum())
        whole = [k for k in itertools.product([False, True], repeat=n) if all(not k[i] or k[parents[i]] for i in range(1, n))]
        assert np.isclose(total(pages.chosen(page, own, odds)), max(total(k) for k in whole))


def test_rows_in_parts_equal_all_rows(model, monkeypatch):
    sources = [f"<body><nav>{'<a href=/x>Menu</a>' * k}</nav><article>{'<p class=text>Some words, and more.</p>' * k}</article></body>" for k in range(9)]
    nodes = [pages.described(pages.parse(s)) for s in sources]
    monkeypatch.setattr(pages, "NODES_AT_ONCE", 3)
    for found, page in zip(pages.odds_of(nodes, model), nodes, strict=True):
        want = model.odds(page.rows(np.arange(len(page.own))))
        assert np.array_equal(found[page.own > 0], want[page.own > 0])
    assert pages.odds_of([], model) == []


def test_pages_held_together_are_bounded(monkeypatch):
    monkeypatch.setattr(pages, "HELD_CHARS", 10)
    runs = list(pages._held_together(np.array([4, 6, 1, 30, 0, 2, 9])))
    assert runs == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    assert list(pages._held_together(np.array([], int))) == []


def test_memory_of_a_page_with_many_nodes(model):
    source = f"<html><body>{'<p class=x>a b, c.<b>d</b></p>' * 15_000}</body></html>"
    pages.main_texts([source[:2000]], model)
    tracemalloc.start()
    found = pages.main_texts([source], model)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000 * 1500 and len(found) > 15_000


def test_null_empty_and_repeated_pages(spark, model):
    source = "<body><article><h1>Rivers</h1><p>A river runs, slowly, to the sea. It carries sand.</p></article></body>"
    rows = [(1, None, "clash"), (2, "", "clash"), (3, source, "clash"), (3, source, "clash")]
    got = pages.extract(spark.createDataFrame(rows, "page_id int, html string, text string"), model).orderBy("page_id").collect()
    assert [r.text for r in got][:2] == ["", ""] and got[2] == got[3] and got[2].n_chars == len(got[2].text)
    assert pages.extract(spark.createDataFrame([], "page_id int, html string"), model).count() == 0
