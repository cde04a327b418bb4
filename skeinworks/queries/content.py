"""Text building, cleaning, chunking and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking, text
from ..operators import rows as projections
from .. import model
from .base import IDX, Register, index, table

reg = Register()
_LABEL = "regexp_replace(regexp_replace(entity_type, 'Entity$', ''), '^.[^A-Z]*([A-Z].*)$', '\\1')"
_CRUMB = "regexp_replace(regexp_replace(b.entity_type, 'Entity$', ''), '^.[^A-Z]*([A-Z].*)$', '\\1') || ': ' || b.name"


@reg("c01_metadata_section", f"""with {IDX} select entity_id, concat_ws(chr(10), '# Metadata', '**Source**: ' || source_name, '**Type**: ' || {_LABEL}, '**Name**: ' || name,
  case when len(breadcrumbs) > 0 then '**Path**: ' || array_to_string([{_CRUMB} for b in breadcrumbs], ' → ') end, '**Chunk Index**: ' || chunk_index, case when updated_at is not null then '**Updated At**: ' || updated_at end) as section from idx""")
def _(spark, sf_dir):
    fields = {"chunk_index": F.col("chunk_index"), "updated_at": F.col("updated_at")}
    return index(spark, sf_dir).select("entity_id", text.metadata_section(fields).alias("section"))


@reg("c02_breadcrumb_path", f"with {IDX} select entity_id, array_to_string([{_CRUMB} for b in breadcrumbs], ' → ') as path from idx")
def _(spark, sf_dir):
    return index(spark, sf_dir).select("entity_id", text.path(F.col("breadcrumbs")).alias("path"))


@reg("c03_type_label", f"with n(entity_type) as (values ('GitHubIssueEntity'), ('SlackMessageEntity'), ('IssueEntity'), ('webEntity'), ('Entity')) select entity_type, {_LABEL} as label from n")
def _(spark, sf_dir):
    names = spark.createDataFrame([(x,) for x in ("GitHubIssueEntity", "SlackMessageEntity", "IssueEntity", "webEntity", "Entity")], "entity_type string")
    return names.select("entity_type", text.type_label(F.col("entity_type")).alias("label"))


@reg("short_names", "values ('GitHubIssueEntity', 'git_hub_issue_entity'), ('HTMLPage', 'html_page'), ('SmallStub', 'small_stub') t(name, short_name)".replace("values", "select * from (values").replace(" t(name", ") t(name"))
def _(spark, sf_dir):
    names = spark.createDataFrame([("GitHubIssueEntity",), ("HTMLPage",), ("SmallStub",)], "name string")
    return names.select("name", model.short_name_column(F.col("name")).alias("short_name"))


@reg("c13_empty_dropped", "select doc_id from documents where length(trim(regexp_replace(text, '[^a-z ]', '', 'g'))) > 20")
def _(spark, sf_dir):
    return projections.with_content(table(spark, sf_dir, "documents"), F.regexp_replace("text", "[^a-z ]", ""), 21).select("doc_id")


@reg("c15_token_slices", """with w as (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from documents),
  c as (select doc_id, w, unnest(range(0, ceil(len(w) / 200.0)::int)) as i from w where len(w) > 0)
  select doc_id, i::int as chunk_index, array_to_string(w[i * 200 + 1:i * 200 + 200], ' ') as chunk from c""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.token_slices(F.col("text"), 200).alias("c"))
    return d.select("doc_id", F.posexplode("c").alias("chunk_index", "chunk"))


@reg("c14_sentence_chunks", """with recursive s0 as (select doc_id, unnest(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+')) as s, generate_subscripts(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+'), 1) as k from documents),
  s1 as (select doc_id, s, len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) as n, row_number() over (partition by doc_id order by k) as k from s0 where length(trim(s)) > 0),
  g as (select doc_id, k, n as acc, 0 as grp from s1 where k = 1
    union all select s1.doc_id, s1.k, case when g.acc > 0 and g.acc + s1.n > 120 then s1.n else g.acc + s1.n end, case when g.acc > 0 and g.acc + s1.n > 120 then g.grp + 1 else g.grp end from g join s1 on s1.doc_id = g.doc_id and s1.k = g.k + 1),
  c as (select doc_id, grp, string_agg(s, '' order by k) as chunk, sum(n) as n from s1 join g using (doc_id, k) group by all)
  select doc_id || '__chunk_' || grp as entity_id, doc_id::varchar as original_entity_id, grp::int as chunk_index, chunk from c where n > 0 and length(trim(chunk)) > 0""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), "text")
    return text.exploded_chunks(d, text.sentence_chunks(F.col("text"), 120)).select("entity_id", "original_entity_id", "chunk_index", "chunk")


@reg("c16_line_chunks", """with l as (select doc_id, string_split(text, chr(10)) as l from documents), c as (select doc_id, l, unnest(range(0, ceil(len(l) / 3.0)::int)) as i from l)
  select doc_id, i::int as chunk_index, array_to_string(l[i * 3 + 1:i * 3 + 3], chr(10)) as chunk from c""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.line_chunks(F.col("text"), 3).alias("c"))
    return d.select("doc_id", F.posexplode("c").alias("chunk_index", "chunk"))


@reg("c18_chunk_rows", """with l as (select doc_id, string_split(text, chr(10)) as l from documents), c as (select doc_id, generate_subscripts(l, 1) - 1 as i, unnest(l) as chunk from l)
  select doc_id || '__chunk_' || i as entity_id, doc_id::varchar as original_entity_id, i::int as chunk_index from c where length(trim(chunk)) > 0""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), "text")
    return text.exploded_chunks(d, F.split("text", "\n", -1)).select("entity_id", "original_entity_id", "chunk_index")


@reg("c21_links_shortened", "select page_id, trim(regexp_replace(regexp_replace(url || chr(10) || chr(10) || chr(10) || url, 'https?://[^ \\n]{30,}', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) as t from pages")
def _(spark, sf_dir):
    both = F.concat("url", F.lit("\n\n\n"), "url")
    return table(spark, sf_dir, "pages").select("page_id", text.shortened_links(both, 30).alias("t"))


@reg("c22_token_counts", "select doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::int as n from documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n"))


@reg("c23_safe_names", "select page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 1, 40) as name from pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_file_name(F.col("url"), 40).alias("name"))


@reg("p01_epochs", "select o_orderkey, epoch(o_orderdate)::bigint as at from orders")
def _(spark, sf_dir):
    return projections.epochs(table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderdate as at"), ["at"])


@reg("p02_metadata_defaults", f"with {IDX} select entity_id, coalesce(nullif(case when doc_id % 3 = 0 then '' else entity_type end, ''), 'Unknown') as entity_type, coalesce(case when doc_id % 2 = 0 then null else original_entity_id end, entity_id) as original_entity_id from idx")
def _(spark, sf_dir):
    rows = index(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("entity_type"))
    parent = F.when(F.col("doc_id") % 2 != 0, F.col("original_entity_id"))
    return projections.with_defaults(rows.select("entity_id", kind.alias("entity_type"), parent.alias("original_entity_id")))


@reg("p04_payload", "select c_custkey, '{\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_nationkey\":' || c_nationkey || '}' as payload from customer")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return c.select("c_custkey", text.payload(c, ["c_custkey", "c_name"]).alias("payload"))


@reg("p05_sanitized", "select doc_id, text as t from documents")
def _(spark, sf_dir):
    dirty = F.concat(F.lit("\x00"), F.substring("text", 1, 20), F.lit("\x1f\x0b"), F.expr("substring(text, 21)"))
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitized(dirty).alias("t"))


@reg("p06_readable", "select doc_id from documents where not (doc_id % 3 = 0 and length(text) < 3000)")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.repeat(F.lit("�"), F.lit(1000)))).otherwise(F.col("text"))
    return d.where(text.readable(t)).select("doc_id")


@reg("p07_results", f"with {IDX} select entity_id, coalesce(case when doc_id % 5 = 0 then null else name end, '') as name from idx where doc_id % 7 <> 0")
def _(spark, sf_dir):
    rows = index(spark, sf_dir)
    ident, name = F.when(F.col("doc_id") % 7 != 0, F.col("entity_id")), F.when(F.col("doc_id") % 5 != 0, F.col("name"))
    return projections.results(rows.select(ident.alias("entity_id"), name.alias("name")))


@reg("p08_federated_rows", "select item_id || '__chunk_0' as entity_id, 0::int as chunk_index, 0.0::double as score from benchmark")
def _(spark, sf_dir):
    return projections.federated(table(spark, sf_dir, "benchmark"), "item_id").select("entity_id", "chunk_index", "score")


@reg("p09_snippets", "select doc_id, case when length(trim(text)) > 400 then substr(trim(text), 1, 397) || '...' else trim(text) end as snippet from documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@reg("p10_summaries", f"with {IDX} select entity_id, '### ' || name || chr(10) || '- id: ' || entity_id || chr(10) || '- source: ' || source_name as summary from idx")
def _(spark, sf_dir):
    return index(spark, sf_dir).select("entity_id", projections.summary().alias("summary"))


@reg("p10_full_renders", f"with {IDX} select entity_id, '### ' || name || chr(10) || '- id: ' || entity_id || chr(10) || '- source: ' || source_name || coalesce(chr(10) || textual_representation, '') || chr(10) || '```json' || chr(10) || '{{\"n\":' || doc_id || '}}' || chr(10) || '```' as summary from idx")
def _(spark, sf_dir):
    source = F.to_json(F.struct(F.col("doc_id").alias("n")))
    return index(spark, sf_dir).select("entity_id", projections.summary(True, source).alias("summary"))


@reg("p03_type_fields", "select page_id::varchar as entity_id, url as crawl_url, 'web_entity' as schema_name from pages")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("entity_id"), F.col("url").alias("crawl_url"), F.lit(1).alias("extra"))
    return projections.type_fields(pages)


@reg("p03_file_fields", "select doc_id::varchar as entity_id, source as url, n_chars as size, 'text' as file_type, case when doc_id % 2 = 0 then 'text/plain' end as mime_type, 'file_entity' as schema_name from documents")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "text/plain").otherwise("")
    return projections.type_fields(d.select(F.col("doc_id").cast("string").alias("entity_id"), F.col("source").alias("url"), F.col("n_chars").alias("size"), F.lit("text").alias("file_type"), kind.alias("mime_type"), "lang"))


@reg("p05_nested_values", "select doc_id, 'ab' as a, 'cd' as b, 'ef' as c from documents")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    dirty = d.select("doc_id", F.struct(F.lit("a\x00b").alias("x"), F.array(F.lit("c\U0010ffffd")).alias("y")).alias("s"), F.create_map(F.lit("k"), F.lit("e\ufdd0f")).alias("m"))
    return text.sanitized_rows(dirty).select("doc_id", F.col("s.x").alias("a"), F.col("s.y")[0].alias("b"), F.col("m")["k"].alias("c"))


@reg("u02_families", "select * from (select 'base_entity' as schema_name, count(*) as n, 0::bigint as urls from documents union all select 'web_entity', count(*), count(url) from pages)")
def _(spark, sf_dir):
    base = index(spark, sf_dir).select("entity_id", F.lit("base_entity").alias("schema_name"))
    web = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("entity_id"), F.lit("web_entity").alias("schema_name"), F.col("url").alias("crawl_url"))
    return model.unioned(base, web).groupBy("schema_name").agg(F.count(F.lit(1)).alias("n"), F.count("crawl_url").alias("urls"))


@reg("c14_topic_chunks", "select doc_id, sha256(text) as whole_sha256, true as fits, text = '' as none from documents")
def _(spark, sf_dir):
    """Every document cut where its topic changes: the chunks joined are the text, and none is over the limit."""
    chunks = chunking.topic_chunks(F.col("text"), 300, 600)
    found = table(spark, sf_dir, "documents").select("doc_id", chunks.alias("c"))
    fits = F.coalesce(F.forall("c", lambda x: F.size(text.tokens(x)) <= 600), F.col("c").isNull().cast("boolean"))
    return found.select("doc_id", F.sha2(F.array_join("c", ""), 256).alias("whole_sha256"), fits.alias("fits"), (F.size("c") == 0).alias("none"))


@reg("c16_structure_chunks", "select page_id, sha256(html) as whole_sha256, true as fits from pages")
def _(spark, sf_dir):
    """Every page's source in chunks by its structure, as code of the family with slashes."""
    found = table(spark, sf_dir, "pages").select("page_id", chunking.structure_chunks(F.col("html"), "html", 200, 400).alias("c"))
    fits = F.coalesce(F.forall("c", lambda x: F.size(text.tokens(x)) <= 400), F.col("c").isNull().cast("boolean"))
    return found.select("page_id", F.sha2(F.array_join("c", ""), 256).alias("whole_sha256"), fits.alias("fits"))
