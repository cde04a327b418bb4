"""The pipeline's stages on planted documents, and the whole against a plain rerun of its decisions."""

import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_cases import brute_components, brute_repeats, flat

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        before, at = at, spark.read.parquet(str(tmp_path / str(k)))
        rows = [(r.doc_id, r.text) for r in before.collect()]
        kept = {r.doc_id: r.text for r in at.collect()}
        if k == 2:
            want = brute_components(rows, 5, 80)
            assert set(kept) == {i for i, c in want.items() if c == i}
        if k == 3:
            assert {i: flat(t) for i, t in kept.items()} == {i: t for i, _, _, t in brute_repeats(rows, 13)}
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert last.select("doc_id").distinct().count() == at.count()


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.agg(F.max("length")).first()[0] <= 4096


def test_stages_take_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    r = random.Random(1)
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(n))
    rows = [(1, words(40), "en", "a", 1), (2, None, None, None, None), (None, words(30), "en", "a", 2), (3, "", "en", "a", 0), (4, words(40), None, "b", 3)]
    for data in (rows, []):
        at = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF)
        at.collect()


def test_unlearned_scripts_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(3)
    words = lambda lo, hi: " ".join("".join(chr(r.randint(lo, hi)) for _ in range(6)) for _ in range(60))
    scripts = [(0x430, 0x44F), (0x627, 0x63A), (0x4E00, 0x9FFF), (0x20000, 0x2A6D0)]
    rows = [(10**6 + 100 * k + i, words(*s), None, "x", 1) for k, s in enumerate(scripts) for i in range(50)]
    out = corpus_pipeline.language_stage(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF)
    kept = {x.doc_id for x in out.select("doc_id").collect()}
    assert sum(i >= 10**6 for i in kept) <= 4
    clean = {x.doc_id for x in docs.where(F.length("text") >= 200).join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id").collect()}
    assert clean and clean <= kept


def test_letters_of_all_planes():
    assert len(corpus_pipeline.language_id.gram_counts("\U00020001\U0002a000")[0]) > 0
    assert len(corpus_pipeline.language_id.gram_counts("\U0001f600\U0010ffff")[0]) == 0


def hard(spark):
    """Documents with nulls, repeated rows, ties, a very long text and columns of clashing names, and the tables beside them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(11)
    clean = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id")
    vocabulary = sorted({w for x in clean.orderBy("doc_id").limit(40).collect() for w in x.text.split()})
    words = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    long, twin, tie = words(60_000), words(80), words(90)
    rows = [(10**6, long, "en"), (10**6 + 1, long + " end", "en"), (10**6 + 2, twin, "de"), (10**6 + 2, twin, "de"), (10**6 + 3, tie, None), (10**6 + 4, tie, None), (10**6 + 5, None, None), (10**6 + 6, "", "fr"), (None, twin, "en"), (None, None, None)]
    more = spark.createDataFrame([(i, t, lang, "x", len(t or "")) for i, t, lang in rows], docs.schema)
    clash = {c: F.concat(F.lit("clash "), F.coalesce("source", F.lit(""))) for c in ("lang_pred", "score", "is_toxic", "p_toxic", "n_shingles", "component_id", "kept", "n_words", "n_removed", "_block", "class")}
    return docs.unionByName(more).withColumns(clash).repartition(5)


def test_stages_on_hard_rows(spark, tmp_path):
    at = hard(spark)
    key = lambda df: sorted(((x.doc_id or 0, x.score) for x in df.select("doc_id", "score").collect()), key=str)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, SF)
        assert out.columns == at.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        before, at = at, spark.read.parquet(str(tmp_path / str(k)))
        if name == "language":
            kept = {x.doc_id for x in at.select("doc_id").collect()}
            assert {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3, 10**6 + 4} <= kept and not {10**6 + 5, 10**6 + 6} & kept
            assert at.where(f"doc_id = {10**6 + 2}").count() == 2
            # Nulls and empty texts, which go here, are put back for the stages after it.
            at = at.unionByName(before.where("text is null or text = ''"))
        if name == "near_duplicates":
            ids = [x.doc_id for x in at.select("doc_id").collect() if x.doc_id is None or x.doc_id >= 10**6]
            assert sorted(ids, key=str) == sorted([10**6, 10**6 + 2, 10**6 + 2, 10**6 + 3, 10**6 + 5, 10**6 + 6, None, None], key=str)
        if name == "repeated_passages":
            assert key(at) == key(before)
            assert at.where("doc_id is null and text is not null").first().text == before.where("doc_id is null and text is not null").first().text
            assert at.where(f"doc_id = {10**6 + 5} and text is null and n_chars is null").count() == 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert sum(p.start == 0 for p in pieces) == at.count()


def test_language_and_toxicity_stages_equal_plain_decisions(spark):
    """Each text by itself, with plain sums over its n-grams and words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    lang = corpus_pipeline.language_id
    langs, table = lang.learn(docs.select("doc_id", "text", "lang"))
    learned = {x.doc_id for x in docs.where("lang is not null").where(~lang.held_out(F.col("doc_id"))).select("doc_id").collect()}

    def vector(text):
        letters, codes = lang._letters(), lang._codes()
        out, run = np.zeros(lang.DIMENSIONS), [0]
        for ch in text:
            c = int(codes[ord(ch)])
            if c or run[-1]:
                run.append(c)
        if run[-1]:
            run.append(0)
        for a, b, c in zip(run, run[1:], run[2:]):
            out += letters[a].astype(int) * np.roll(letters[b], 1).astype(int) * np.roll(letters[c], 2).astype(int)
        return out

    some = [x for x in rows if x.text][:60]
    found = {x.doc_id: vector(x.text) for x in some}
    for x in some:
        own = lang.text_vector(x.text)
        assert (own is None and not found[x.doc_id].any()) or np.allclose(own, found[x.doc_id])
    for k, name in enumerate(langs):
        total = sum((v / np.linalg.norm(v) for x in rows if x.lang == name and x.doc_id in learned and (v := lang.text_vector(x.text)) is not None), np.zeros(lang.DIMENSIONS))
        assert np.allclose(table[k], total / np.linalg.norm(total), atol=1e-5)
    kept = {x.doc_id for x in corpus_pipeline.language_stage(spark, docs, SF).select("doc_id").collect()}
    cosine = lambda v: max(float(p @ v) / np.linalg.norm(v) for p in table)
    assert {x.doc_id for x in some if found[x.doc_id].any() and cosine(found[x.doc_id]) > lang.NOISE} == kept & set(found)

    tox = corpus_pipeline.toxicity
    chain = tox.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def toxic(text):
        counts = {}
        for word in tox._WORD.findall((text or "").lower()):
            for f in {word, *("^" + word[:k] for k in (4, 5, 6) if len(word) > k)}:
                f = zlib.crc32(f.encode()) & tox._SPACE
                counts[f] = counts.get(f, 0) + 1
        earlier = []
        for link in chain.links:
            z = link.intercept + sum(w * min(1 + 0.25 * (counts[f] - 1), 2) for f, w in link.weights.items() if f in counts)
            z += sum(w * np.log(p / (1 - p)) for w, p in zip(link.earlier, np.clip(earlier, 1e-3, 1 - 1e-3)))
            earlier.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return earlier[-1] >= tox.THRESHOLD

    stayed = {x.doc_id for x in corpus_pipeline.toxicity_stage(spark, docs, SF).select("doc_id").collect()}
    assert stayed == {x.doc_id for x in rows if not toxic(x.text)}


def test_packing_stage_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokenizer = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    ids = {x.doc_id: [*tokenizer.encode(x.text or "", add_special_tokens=False).ids, 2] for x in docs.collect()}
    pieces, room = {}, {}
    for p in corpus_pipeline.packing_stage(spark, docs, SF).collect():
        own = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert p.ids_crc32 == zlib.crc32(own) and p.doc_tokens == len(ids[p.doc_id])
        pieces.setdefault(p.doc_id, []).append((p.start, p.length))
        room.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own, size in [*((x, len(ids[i])) for i, x in pieces.items()), *((x, None) for x in room.values())]:
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert sum(own[-1]) == size if size else sum(own[-1]) <= 4096
    assert set(pieces) == set(ids)


def test_run_leaves_no_tables_of_its_stages(spark):
    from pathlib import Path

    from skeinworks.sources import scratch

    shared = Path(scratch.shared_dir(spark))
    before = set(shared.iterdir())
    out = corpus_pipeline.run(spark, SF)
    # The last stage's input, and the pieces that its result is read from.
    assert out.count() > 0 and len(set(shared.iterdir()) - before) == 2
