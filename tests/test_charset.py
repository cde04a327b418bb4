"""Charsets told by what decodes and by pairs of characters."""

import numpy as np
import pytest

from skeinworks.functions import charset

KNOWN = [
    "Der Fluß führt über die Höhe, und die Bäche fließen schön weiter für alle Häuser.",
    "L'été à la rivière, où l'élève a été reçu par une mère très gênée; ça coûte à l'hôtel.",
    "El niño pequeño comió en la montaña; mañana el corazón irá también a la estación.",
    "Река течёт через город, и люди каждый день ходят по мосту на работу и домой.",
    "東京は日本の首都です。川は町を流れて、人々は毎日橋を渡ります。",
]


@pytest.fixture(scope="module")
def pairs(spark):
    return charset.learn(spark.createDataFrame([(t,) for t in KNOWN] + [(None,), ("",), ("plain",)], "text string"))


def test_counts_equal_a_plain_count(spark):
    texts = ["éaé Ab.é", "éÉé\nß", "plain", "", "1ß2ß", "x😀y"]
    want = {}
    fold = lambda c: c if ord(c) > 127 or c.isalpha() else " "
    for t in texts:
        t = f" {t} "
        for a, b in zip(t, t[1:]):
            if ord(a) > 127 or ord(b) > 127:
                want[fold(a), fold(b)] = want.get((fold(a), fold(b)), 0) + 1
    got = charset.pair_counts(spark.createDataFrame([(t,) for t in [*texts, None]], "text string")).collect()
    assert {(r.a, r.b): r.n for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("number, name", [(0, "cp1252"), (0, "cp850"), (1, "mac_roman"), (2, "cp850"), (1, "utf_16_be"), (3, "cp1251"), (3, "koi8_r"), (3, "cp866"), (4, "shift_jis"), (4, "euc_jp"), (4, "utf_16_le")])
def test_known_languages_come_back(pairs, number, name):
    found = charset.detected(KNOWN[number].encode(name), pairs)
    assert found[2] == KNOWN[number] and found[1] > charset.LEAST_CONFIDENCE


def test_a_long_text_is_weighed_in_parts(pairs, monkeypatch):
    whole = charset.weight(KNOWN[1] * 50, pairs)
    monkeypatch.setattr(charset, "_SEGMENT", 7)
    parts = charset.weight(KNOWN[1] * 50, pairs)
    assert np.isclose(whole[0], parts[0]) and whole[1] == parts[1]


def test_rules_of_a_table(spark, pairs):
    noise = bytes(np.random.default_rng(1).integers(128, 256, 4000, dtype=np.uint8))
    rows = [(1, KNOWN[0].encode("cp1252")), (2, KNOWN[0].encode()), (3, b""), (4, None), (5, noise), (6, "plain".encode("utf-16-le")), (7, b"mostly plain text " * 40 + b"\xff")]
    got = {r.id: r for r in charset.decoded(spark.createDataFrame(rows, "id int, content binary").selectExpr("*", "'clash' as text", "'clash' as charset"), pairs).collect()}
    assert (got[1].charset, got[1].text) == ("cp1252", KNOWN[0])
    assert (got[2].charset, got[2].confidence, got[2].text) == ("utf_8", 1.0, KNOWN[0])
    assert (got[3].charset, got[3].text) == ("utf_8", "") and (got[4].charset, got[4].text) == (None, None)
    assert got[5].text is None and got[5].confidence == 0
    assert (got[6].charset, got[6].text) == ("utf_16_le", "plain")
    assert got[7].text.startswith("mostly plain text ")


def test_words_settle_what_pairs_leave_open(spark):
    """A letter whose pairs fit another charset better is told by its word, and by what is around it where both words are known."""
    odd = ["all the beäver here", "and some Äen there"]
    texts = [*(["crèe the èven beèv mère"] * 40), "een éen x", *(["où éenne, éet éen"] * 30), *odd, "plain"]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    model, known = charset.learn(table), charset.contexts(table)
    rows = [(0, odd[0].encode("mac_roman")), (1, odd[1].encode("cp850")), (2, odd[0].encode("mac_roman")), (3, b"plain"), (4, None), (5, bytes(np.random.default_rng(1).integers(128, 256, 4000, dtype=np.uint8)))]
    files = spark.createDataFrame(rows, "id int, content binary")
    assert charset.detected(rows[0][1], model)[2] != odd[0] and charset.detected(rows[1][1], model)[2] != odd[1]
    got = {r.id: r for r in charset.decoded(files, model, known=known).collect()}
    assert [got[i].text for i in range(5)] == [odd[0], odd[1], odd[0], "plain", None] and len(got) == 6
    assert got[0].charset == "mac_roman" and got[0].confidence > charset.LEAST_CONFIDENCE
    assert got[5].text is None and got[5].confidence == 0


def test_an_odd_word_leaves_a_file_open_however_often_it_is_repeated(spark):
    """Pairs of a rare word are as odd a hundred times as once; and two odd pairs are little where there are no others."""
    odd = ["Äau " * 100, "all of it, Öch there"]
    texts = [*(["éau bec, un éau là où éch och"] * 400), *(["Ödem Öl, Äther"] * 3), *odd]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    model, known = charset.learn(table), charset.contexts(table)
    files = spark.createDataFrame([(i, t.encode(c)) for i, (t, c) in enumerate((t, c) for t in odd for c in ("cp850", "mac_roman"))], "id int, content binary")
    assert any(charset.detected(t.encode(c), model)[2] != t for t in odd for c in ("cp850", "mac_roman"))
    got = {r.id: r.text for r in charset.decoded(files, model, known=known).collect()}
    assert [got[i] for i in range(4)] == [t for t in odd for _ in range(2)]
