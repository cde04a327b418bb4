"""Rules of the sync path, access, streams and search that a table of results does not show."""

import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks import model
from skeinworks.functions import convert, text
from skeinworks.operators import access, cdc, embed, filters, metadata, search
from skeinworks.operators.filters import Condition as C
from skeinworks.plans import assistant
from skeinworks.plans import search as plans
from skeinworks.plans import sync
from skeinworks.sources import scratch, stores
from skeinworks.streaming import pipelines


def test_newest_raw_version_is_the_last_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one"), ("b", "one")], "entity_id string, text string")
    schema = stores.raw_schema(rows.schema)
    stores.write_raw(rows, str(tmp_path), "s", "job9")
    stores.write_raw(rows.where("entity_id = 'a'").withColumn("text", F.lit("two")), str(tmp_path), "s", "job10")
    read = lambda: {r.entity_id: r.text for r in stores.read_raw(spark, str(tmp_path), "s", schema).collect()}
    assert read() == {"a": "two", "b": "one"}
    stores.delete_raw(rows.where("entity_id = 'a'"), str(tmp_path), "s", "job1")
    assert read() == {"b": "one"}
    stores.write_raw(rows.where("entity_id = 'a'").withColumn("text", F.lit("back")), str(tmp_path), "s", "job0")
    assert read() == {"a": "back", "b": "one"}
    assert stores.raw_entity(spark, str(tmp_path), "s", schema, "a").first().text == "back"


def test_one_raw_entity_opens_its_bucket_only(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(400).selectExpr("concat('e', id) as entity_id", "concat('old ', id) as text")
    schema = stores.raw_schema(rows.schema)
    stores.write_raw(rows, root, "s", "job1", buckets=8)
    stores.write_raw(rows.where("entity_id like '%7'").withColumn("text", F.lit("new")), root, "s", "job2", buckets=99)
    stores.delete_raw(rows.where("entity_id = 'e17'"), root, "s", "job3")
    assert stores.raw_buckets(spark, root, "s") == 8
    whole = {r.entity_id: r.text for r in stores.read_raw(spark, root, "s", schema).collect()}
    for one in ("e7", "e8", "e17", "e399", "absent"):
        assert {r.entity_id: r.text for r in stores.raw_entity(spark, root, "s", schema, one).collect()} == {k: v for k, v in whole.items() if k == one}
    every = scratch.matching(spark, f"{root}/raw/s/entities/job=*/bucket=*/*.json")
    opened = stores.raw_rows_of(spark, root, "s", schema, "e7").inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in opened}) == 1 and 0 < len(opened) <= len(every) / 4
    target = str(tmp_path / "compact")
    stores.compact_raw(spark, root, "s", schema, target, buckets=4)
    assert stores.raw_buckets(spark, target, "s") == 4 and stores.raw_entity(spark, target, "s", schema, "e7").first().text == "new"


def test_a_compacted_raw_store_is_read_without_moving_rows(spark, tmp_path):
    root, target = str(tmp_path / "a"), str(tmp_path / "b")
    rows = spark.range(50).selectExpr("concat('e', id) as entity_id", "concat('old ', id) as text")
    schema = stores.raw_schema(rows.schema)
    for job in ("job1", "job2"):
        stores.write_raw(rows, root, "s", job)
    stores.delete_raw(rows.where("entity_id = 'e3'"), root, "s", "job3")
    stores.compact_raw(spark, root, "s", schema, target)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    whole, compact = stores.read_raw(spark, root, "s", schema), stores.read_raw(spark, target, "s", schema)
    assert whole.columns == compact.columns and sorted(whole.collect()) == sorted(compact.collect()) and compact.count() == 49
    assert "Exchange" in plan(whole) and "Exchange" not in plan(compact)
    # What is written beside it, by a job or by a second compaction, is compared again.
    stores.write_raw(rows.where("entity_id = 'e5'").withColumn("text", F.lit("new")), target, "s", "job4")
    read = {r.entity_id: r.text for r in stores.read_raw(spark, target, "s", schema).collect()}
    assert len(read) == 49 and read["e5"] == "new"
    stores.compact_raw(spark, root, "s", schema, target)
    again = stores.read_raw(spark, target, "s", schema)
    assert again.count() == 49 and {r.entity_id: r.text for r in again.collect()} == read


def test_index_refuses_rows_without_an_id_and_counts_what_arrives(spark, tmp_path):
    rows = spark.createDataFrame([("c", "s", "e1"), ("c", "s", None)], "collection_id string, schema_name string, entity_id string")
    with pytest.raises(ValueError):
        stores.write_index(rows, f"{tmp_path}/i")
    assert not scratch.exists(spark, f"{tmp_path}/i/rows")
    assert stores.write_index(rows.where("entity_id is not null"), f"{tmp_path}/i") == 1
    stores.delete_from_index(rows, f"{tmp_path}/i", ["entity_id"])
    assert stores.read_index(spark, f"{tmp_path}/i", "c").count() == 0
    stores.write_index(rows.where("entity_id is not null"), f"{tmp_path}/i")
    assert stores.read_index(spark, f"{tmp_path}/i").columns == ["entity_id", "collection_id", "schema_name"]
    assert stores.compact_index(spark, f"{tmp_path}/i", f"{tmp_path}/j") == 1


def entities(spark, rows):
    return spark.createDataFrame(rows, "sync_id string, entity_id string, entity_type string, name string, text string, seq long, deletion_status string")


EMPTY = "sync_id string, entity_id string, original_entity_id string, entity_type string, name string, chunk_index int, textual_representation string"


def test_unreadable_text_does_not_delete_what_is_stored(spark):
    good = entities(spark, [("s", "1", "T", "n", "some text.", 1, None), ("s", "2", "T", "n", "other.", 2, None)])
    one = sync.run(good, spark.createDataFrame([], "sync_id string, entity_id string, entity_type string, hash string"), spark.createDataFrame([], EMPTY))
    state, index = scratch.stored(one.state), scratch.stored(one.index)
    bad = entities(spark, [("s", "1", "T", "n", "�" * 100, 1, None)])
    two = sync.run(bad, state, index)
    assert [r.entity_id for r in two.orphans.collect()] == ["2"]
    assert [r.entity_id for r in two.state.collect()] == ["1"] and [r.original_entity_id for r in two.index.collect()] == ["1"]
    part = sync.run(entities(spark, [("s", "3", "T", "n", "new.", 1, None)]), state, index, incremental=True)
    assert part.orphans.count() == 0 and sorted(r.entity_id for r in part.state.collect()) == ["1", "2", "3"]


def test_force_deletes_every_reported_deletion(spark):
    rows = cdc.hashed(entities(spark, [("s", "1", "T", "n", "a", 1, "removed"), ("s", "2", "T", "n", "b", 2, "trashed"), ("s", "3", "T", "n", "c", 3, None)]))
    state = rows.select("sync_id", "entity_id", "entity_type", "hash")
    actions = lambda force: {r.entity_id: r.action for r in cdc.classified(rows, state, force=force).collect()}
    assert actions(True) == {"1": "DELETE", "2": "DELETE", "3": "INSERT"}
    assert actions(False) == {"1": "DELETE", "2": "KEEP", "3": "KEEP"}


def test_sync_cuts_oversized_chunks_and_embeds(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = entities(spark, [("s", "1", "T", "n", long, 1, None), ("s", "2", "T", "n", "short one. " * 3, 2, None)])
    found = sync.run(rows, spark.createDataFrame([], "sync_id string, entity_id string, entity_type string, hash string"), spark.createDataFrame([], EMPTY + ", dense_embedding array<double>"), embed=lambda d: embed.embedded(d, "textual_representation"))
    got = {r.entity_id: r for r in found.index.collect()}
    assert sorted(got) == ["1__chunk_0", "1__chunk_1", "1__chunk_2", "2__chunk_0"]
    sizes = [len(got[f"1__chunk_{k}"].textual_representation.split()) for k in range(3)]
    assert sizes == [8192, 8192, 20_000 - 2 * 8192]
    assert all(len(r.dense_embedding) == 64 for r in got.values())


def test_chunks_of_long_texts_take_linear_time():
    took = []
    for n in (50_000, 400_000):
        at = time.process_time()
        out = text.gathered("One two three. " * n, 120)
        took.append(time.process_time() - at)
        assert sum(len(c.split()) for c in out) == 3 * n and max(len(c.split()) for c in out) == 120
    assert took[1] < 4 * 8 * max(took[0], 0.02)
    assert text.gathered(None) is None and text.gathered("") == [] and text.gathered(" \n ") == []


def test_token_slices_and_line_chunks(spark):
    df = spark.createDataFrame([(" ".join(map(str, range(25))),), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.token_slices(F.col("t"), 10)).collect()]
    assert [len(x.split()) for x in got[0]] == [10, 10, 5] and got[1] == [] and got[2] in (None, [])
    assert [r[0] for r in spark.createDataFrame([("a\nb\nc",)], "t string").select(text.line_chunks(F.col("t"), 2)).collect()] == [["a\nb", "c"]]


def test_ghosts_count_jobs_that_are_being_cancelled(spark):
    rows = [("a", 1, "failed", 1), ("a", 2, "failed", 2), ("a", 3, "running", 3), ("b", 4, "failed", 1), ("b", 5, "cancelling", 2), ("b", 6, "failed", 3)]
    jobs = spark.createDataFrame(rows, "sync_id string, job_id long, status string, created_at long")
    assert [r.sync_id for r in metadata.ghosts(jobs, 2).collect()] == ["a"]


def test_job_states(spark):
    steps = {("pending", "running"): True, ("pending", "cancelled"): True, ("pending", "cancelling"): False, ("running", "cancelled"): False, ("running", "cancelling"): True, ("cancelling", "cancelled"): True, ("cancelling", "failed"): False, ("completed", "running"): False, ("failed", "pending"): False}
    rows = [(i, s, k, k) for i, pair in enumerate(steps) for k, s in enumerate(pair)]
    bad = {r.job_id for r in metadata.bad_transitions(spark.createDataFrame(rows, "job_id long, status string, at long, step_id long")).collect()}
    assert bad == {i for i, ok in enumerate(steps.values()) if not ok}


def test_stuck_jobs_and_unknown_health(spark):
    jobs = spark.sql("select 1 as job_id, 'running' as status, timestamp '2024-01-01' as created_at, true as raw_only union all select 2, 'running', timestamp '2024-01-01', false")
    activity = jobs.select("job_id", "created_at").limit(0)
    assert [r.job_id for r in metadata.stuck(jobs, activity, F.lit("2024-01-02").cast("timestamp")).collect()] == [2]
    sent = spark.createDataFrame([("a", 1, 1, 200)], "endpoint string, delivery_id long, at long, code int")
    all_of = spark.createDataFrame([("a",), ("b",)], "endpoint string")
    assert {r.endpoint: (r.n_leading, r.health) for r in metadata.health(sent, endpoints=all_of).collect()} == {"a": (0, "healthy"), "b": (0, "unknown")}


def test_groups_thirty_levels_deep(spark):
    edges = [("u", "user", "g0"), *[(f"g{i}", "group", f"g{i + 1}") for i in range(30)]]
    df = spark.createDataFrame(edges, "member_id string, member_type string, group_id string")
    at = time.time()
    assert sorted(r.depth for r in access.expanded(df).collect()) == list(range(1, 32))
    assert time.time() - at < 120
    assert access.expanded(df, 5).count() == 5


def test_sanitized_removes_what_no_character_is(spark):
    bad = "".join(chr(p * 0x10000 + x) for p in range(1, 17) for x in (0xFFFE, 0xFFFF)) + "﷐﷯￿\x00\x08\x0b\x1f"
    row = spark.createDataFrame([("a" + bad + "\t\n\rb", ["x\x01", None], {"k": "y\x02"}, ("z\x03", 1))], "t string, a array<string>, m map<string,string>, s struct<p:string,q:int>")
    got = text.sanitized_rows(row).first()
    assert got.t == "a\t\n\rb" and got.a == ["x", None] and got.m == {"k": "y"} and tuple(got.s) == ("z", 1)


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("source", "source_name")
    plan = df.where(filters.condition(C("source_name", "in", ["src1", "src2"]))).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(source, [src1,src2])]" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan


def test_stored_terms_equal_texts_and_read_their_folders_only(spark, tmp_path):
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in range(60)], "id long, t string")
    search.write_terms(rows, "id", "t", str(tmp_path / "t"))
    terms = spark.read.parquet(str(tmp_path / "t"))
    for query in ("alpha", "Beta delta!", "nothing", " . "):
        one = {x.id: round(x.keyword, 6) for x in search.keyword_scores(rows, "id", "t", query).collect()}
        assert one == {x.id: round(x.keyword, 6) for x in search.stored_scores(terms, "id", query).collect()}
    plan = search.stored_scores(terms, "id", "alpha")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_query_time_sources_are_asked_again_and_fail_the_query(spark):
    asked = []

    def fetch(query, need):
        asked.append(need)
        if len(asked) < 3:
            raise plans.SourceError(503)
        return "rows"

    assert plans.retrying(fetch, wait=0.01)("q", 5) == "rows" and asked == [5, 5, 5]
    asked.clear()
    with pytest.raises(plans.SourceError):
        plans.retrying(lambda q, n: (_ for _ in ()).throw(plans.SourceError(404)), wait=5)("q", 1)
    index = spark.createDataFrame([("e", "e", "word", None, None)], "entity_id string, original_entity_id string, textual_representation string, access_is_public boolean, access_viewers array<string>")
    with pytest.raises(plans.SourceError):
        plans.run(plans.SearchPlan("word", strategy="keyword"), index, [lambda q, n: (_ for _ in ()).throw(plans.SourceError(400))])
    assert plans.count(plans.SearchPlan("word"), index) == 1


def test_reranking_caps_and_fills(spark):
    rows = spark.createDataFrame([(i, f"t{i}", float(-i)) for i in range(50)], "id long, t string, score double")
    seen = []

    def model(query, texts):
        seen.append(len(texts))
        return [3, 3, 1]

    assert [r.id for r in search.reranked(rows, "q", "t", model, 0, 5).collect()] == [3, 1, 0, 2, 4]
    assert [r.id for r in search.reranked(rows, "q", "t", model, 1, 3, most=4).collect()] == [1, 0, 2]
    assert seen == [10, 4]


def test_outer_models(spark):
    def model(texts):
        if len(texts) > 1 or texts[0] == "bad":
            raise RuntimeError("no")
        return [[float(len(texts[0]))] * 384]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "abc")], "id long, t string").coalesce(1)
    got = {r.id: r.dense_embedding[0] for r in embed.embedded(rows, "t", "mini", model).collect()}
    assert got == {1: 1.0, 3: 3.0}
    with pytest.raises(Exception, match="dimensions"):
        embed.with_model(rows, "t", lambda texts: [[0.0]] * len(texts), 384).collect()
    with pytest.raises(Exception):
        embed.checked(embed.hashing(rows, "t"), "dense_embedding", 65).collect()
    for name, fn in (("nope", None), ("mini", None)):
        with pytest.raises(ValueError):
            embed.embedded(rows, "t", name, fn)
    found = embed.variants("the quick brown foxes run")
    assert len(found) == len(set(found)) == 4


def test_hashed_vectors_by_hand(spark):
    rows = spark.createDataFrame([("one two two",), ("",), ("ONE",)], "t string")
    got = [r.dense_embedding for r in embed.hashing(rows, "t").collect()]
    terms = spark.createDataFrame([("one",), ("two",)], "w string").selectExpr("w", "cast(pmod(xxhash64(w), 64) as int) as slot", "if(xxhash64(w, 1) % 2 = 0, 1.0, -1.0) as sign")
    marks = {r.w: (r.slot, float(r.sign)) for r in terms.collect()}
    for t, v in zip((["one", "two"], [], ["one"]), got, strict=True):
        want = [0.0] * 64
        for w in t:
            want[marks[w][0]] += marks[w][1]
        norm = sum(x * x for x in want) ** 0.5
        assert v is None if not norm else v == pytest.approx([x / norm for x in want])


def test_files_and_base_columns(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.txt", "b.exe", "sub/c.md"):
        (tmp_path / name).write_bytes(name.encode())
    files = stores.read_files(spark, str(tmp_path), ["txt", "md"]).collect()
    assert sorted(bytes(r.content).decode() for r in files) == ["a.txt", "sub/c.md"] and all(len(r.file_hash) == 64 and r.size == len(r.content) for r in files)
    schema = T.StructType([T.StructField("key", T.IntegerType(), False, model.Flags(is_entity_id=True).metadata()), T.StructField("title", T.StringType(), False, model.Flags(is_name=True).metadata()), T.StructField("name", T.StringType()), T.StructField("at", T.StringType(), True, model.Flags(is_created_at=True).metadata())])
    got = model.fill_base(spark.createDataFrame([(7, "t", "", "2024"), (8, "u", "own", None)], schema)).collect()
    assert [(r.entity_id, r.name, r.created_at) for r in got] == [("7", "t", "2024"), ("8", "own", None)]


def test_sliding_limit_equals_a_plain_log(spark, tmp_path):
    r = random.Random(4)
    calls = [(u, i, float(r.randint(0, 400))) for i, u in enumerate(r.choice([1, 1, 1, 2, 3]) for _ in range(600))]
    spark.createDataFrame(calls, "user_id long, event_id long, at double").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("user_id long, event_id long, at double").parquet(f"{tmp_path}/in")
    out = pipelines.limited(stream, 3, 60.0)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {x.event_id: (x.allowed, round(x.retry_after, 6)) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    logs, want = {}, {}
    for user, event, at in sorted(calls, key=lambda x: (x[2], x[1])):
        log = [t for t in logs.get(user, []) if t > at - 60]
        ok = len(log) < 3
        want[event] = (ok, 0.0 if ok else max(log[0] + 60 - at, 0.1))
        logs[user] = log + [at] if ok else log
    assert got == want and 0 < sum(ok for ok, _ in got.values()) < 600


def test_markdown_by_hand():
    source = "<html><head><title>T</title></head><body><h1>One &amp; two</h1><p>A <b>bold</b> <a href='/x'>link</a>.</p><ul><li>x</li><li>y</li></ul><script>no()</script></body></html>"
    assert convert.to_markdown(source) == "# One & two\n\nA **bold** [link](/x).\n\n- x\n- y"
    assert convert.to_markdown(None) is None and convert.to_markdown("") == ""
    assert convert.to_markdown("�" * 101) is None


def test_shared_folder_is_needed_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        scratch.shared_dir(Session)


def test_tables_made_on_the_way_are_deleted(spark):
    with scratch.passing(spark) as made:
        kept = scratch.stored(spark.range(3))
        gone = scratch.stored(spark.range(4))
        paths = list(made)
        made.remove(paths[0])
        assert gone.count() == 4
    assert kept.count() == 3 and [scratch.exists(spark, p) for p in paths] == [True, False]


def test_filters_from_a_question():
    read = lambda *c, sure=0.9: assistant.interpreted("q", lambda q: (list(c), sure), ["GitHub"])
    assert read(C("source_name", "equals", "github")) == [[C("source_name", "equals", "GitHub")]]
    assert read(C("source_name", "in", ["GITHUB", "x"])) == [[C("source_name", "in", ["GitHub", "x"])]]
    assert read(C("nope", "equals", 1), C("name", "greater_than", "x")) == []
    assert read(C("name", "equals", "a"), sure=0.6) == []


def pages_of(spark, n):
    return spark.createDataFrame([(f"e{i:03}", f"p{i // 3}", i % 3, "word " * (n - i), None, None, "c") for i in range(n)], "entity_id string, original_entity_id string, chunk_index int, textual_representation string, access_is_public boolean, access_viewers array<string>, collection_id string")


def test_answers_keep_to_the_budget(spark):
    rows = pages_of(spark, 30).withColumn("score", F.length("textual_representation").cast("double"))
    assert assistant.answer("q", rows, lambda q, t: str(len(t)), budget=59) == "2"
    assert assistant.answer("q", rows, lambda q, t: str(len(t)), budget=3) == "1"


def test_search_in_turns(spark):
    index = pages_of(spark, 120)
    plan = plans.SearchPlan("word", strategy="keyword", limit=110)
    script = [assistant.Act("search", plan), assistant.Act("add", ["e005", "e001", "zzz"]), assistant.Act("return"), assistant.Act("read", ["e004"]), assistant.Act("remove", ["e005"]), assistant.Act("return")]
    states = []

    def model(query, state):
        states.append((len(state.seen), list(state.collected), state.questioned))
        return script[len(states) - 1]

    got = [(r.entity_id, r.rank) for r in assistant.converse(index, model, "q").collect()]
    assert got == [("e001", 1)] and states[3] == (110, ["e005", "e001"], True) and len(states) == 6
    silent = []
    assert assistant.converse(index, lambda q, s: silent.append(s.turns), "q").count() == 0 and silent == [1, 2, 3]
    turns = []
    assistant.converse(index.limit(3), lambda q, s: turns.append(s.nudges) or assistant.Act("add", []), "q")
    assert len(turns) == assistant.MOST_TURNS and turns[4:6] == [1, 2]
    assert assistant._newest(["a " * 10, "b " * 5, "c " * 4], 9) == ["b " * 5, "c " * 4]


def workbook(sheets):
    import io
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r></si></sst>')
        for i, (_, cells) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData><row>{cells}</row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_become_tables(spark):
    table = '<c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="A3"><v>3.5</v></c><c r="B3"><f>A3*2</f><v>7</v></c><c r="C3" t="b"><v>1</v></c>'
    book = workbook([("First", table), ("Empty", ""), ("Row", '<c r="B1" t="inlineStr"><is><t>x</t></is></c>')])
    want = "## Sheet: First\n\n| one |  | two |\n| --- | --- | --- |\n|  |  |  |\n| 3.5 | =A3*2 | True |\n\n## Sheet: Row\n\n- x\n"
    assert convert.workbook_to_markdown(book) == want
    files = spark.createDataFrame([("a.xlsx", bytearray(book)), ("b.xlsx", bytearray(b"no zip")), ("c.py", bytearray(b"x = 1")), ("d.zig", bytearray(b"y"))], "path string, content binary")
    assert {r.path: r.text for r in convert.convert_files(files).collect()} == {"a.xlsx": want, "c.py": "x = 1"}
    assert [r.path for r in convert.supported_code(files).collect()] == ["c.py"]


def test_token_counts(spark):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    texts = ["", "two words", "ünï 漢字 <|endoftext|>", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r.n for r in rows.select(text.bpe_counts(F.col("t"), path, public_tokenizers.PATTERN).alias("n")).collect()]
    assert got == [None if t is None else len(known.encode_ordinary(t)) for t in texts]


def test_broken_and_slow_sources(spark):
    stores.register(spark)
    read = lambda **o: spark.read.format("skein_stub").options(**o).load()
    with pytest.raises(Exception, match="fails at row 7"):
        read(count=20, fail_at=7).collect()
    assert read(count=20, fail_at=7, after=7).count() == 12
    at = time.time()
    assert read(count=10, partitions=1, rows_per_second=10).count() == 10 and time.time() - at > 0.9


def test_progress_is_told(spark, tmp_path):
    told = []
    listener = pipelines.Progress(told.append, 50)
    spark.streams.addListener(listener)
    try:
        for k in range(3):
            spark.range(40).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 8).parquet(f"{tmp_path}/in/*")
        stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if told and told[-1] == 120:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert told[-1] == 120 and told == sorted(told)


def test_organisations_in_any_order(spark):
    orgs = spark.createDataFrame([(1, "b", 3), (2, "a", 1), (3, "c", 2)], "org_id int, name string, created_at int")
    users = spark.createDataFrame([(1, 5), (1, 9), (3, 7)], "org_id int, last_active int")
    links = spark.createDataFrame([(2,)], "org_id int")
    usage = spark.createDataFrame([(3, 10), (2, 4)], "org_id int, entities int")
    order = lambda sort, down: [r.org_id for r in metadata.organisations(orgs, users, links, usage, None, sort, down).collect()]
    assert order("name", False) == [2, 1, 3] and order("user_count", True) == [1, 3, 2] and order("entity_count", True) == [3, 2, 1]
    assert order("last_active", True) == [1, 3, 2] and order("last_active", False) == [3, 1, 2]
    assert order("no such column; drop table", True) == order("created_at", True) == [1, 3, 2]


@pytest.mark.parametrize("ordered", [True, False])
def test_items_are_fetched_together(spark, ordered):
    def fetch(key):
        if key == "k7":
            raise OSError("gone")
        time.sleep(0.02)
        return key.encode()

    items = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "key string, n int").coalesce(1)
    at = time.time()
    got = stores.fetched(items, "key", fetch, 20, ordered).collect()
    assert time.time() - at < 60
    if ordered:
        assert [r.n for r in got] == list(range(100))
    assert {r.key: None if r.content is None else bytes(r.content).decode() for r in got} == {f"k{i}": None if i == 7 else f"k{i}" for i in range(100)}
    assert {r.key: r.error for r in got if r.error} == {"k7": "OSError: gone"}


def test_sanitizing_looks_at_common_characters_first(spark):
    """The quick look ahead removes what the class alone does."""
    assert text._UNWANTED.startswith("(?!")
    codes = [*range(0xD800), *range(0xE000, 0x10000), *(plane * 0x10000 + x for plane in range(1, 17) for x in range(0xFFF0, 0x10000))]
    chars = spark.createDataFrame([(i, chr(i)) for i in codes], "id long, c string")
    gone = {r.id for r in chars.where(text.sanitized(F.col("c")) == "").select("id").collect()}
    assert gone == {*range(9), 0xB, 0xC, *range(0xE, 0x20), *range(0xFDD0, 0xFDF0), *(plane * 0x10000 + x for plane in range(17) for x in (0xFFFE, 0xFFFF))}
