"""Keyword retrieval by BM25 over a stored inverted index, with blocks that cannot reach the page left out.

What is indexed of a chunk is the JSON of its fields, names in order, so names, links and dates are found as well as the text. A term is
known by a 32-bit id, of its MD5. The weight of a term in a chunk is tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)),
a query adds the weights of its terms, each times ln(1 + (N - df + 0.5) / (df + 0.5)).

Layout under a path: chunks are put in order of language or collection (`cluster`) and length and cut into blocks of `size` chunks.
`postings/bucket=<n>` has a row for each term and block (two where a batch ends inside the block), with the entries, which are places of chunks in
the block and their tf, and the greatest tf; what a chunk is, its id, block, place and length, is in `chunks` only. A block's
least length and a term's greatest tf bound its weights. That bound holds for any mean length, so stored rows stay right as chunks come and go.
`totals` has chunks and terms of each write, `deleted` keys with `deleted_at`; a reader adds up the former and subtracts the latter. Counts of
chunks and of a term's chunks include deleted ones until `compacted` writes the rest anew.

What moves to build it is each text once, to its place in the order, and the places of each term, of many blocks together, to the term's folder.

A page of k (`top`): the bounds of a block's terms add up to the most that a chunk in it can score. Blocks are scored by falling sums, four
times as many at each step; the k-th best score so far is one that no page can fall below, and blocks whose sum does not reach it
are never read. The result is that of adding up all postings. What is read of other blocks is the bounds, not the entries.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound
from ..sources.scratch import exists, stored
from . import search

K1, B = 1.2, 0.75
#: What a block is known by: blocks of several writes keep apart.
_KEY = ["block", "written_at"]
#: Chunks in a block.
BLOCK = 128
#: Folders of the stored postings: part of the format.
BUCKETS = 64
#: Entries of a task that writes postings, about, and those that are put in order of terms together before they move.
PART_ENTRIES = 1 << 20
#: Places of a term that move together are of so many neighbouring chunks (a power of 2), each told by 2 bytes.
SPAN_BITS = 12
#: At most so many blocks with deleted chunks go out to all tasks of a compaction, beyond it they are joined by shuffle.
BROADCAST_BLOCKS = 100_000
#: Ids of terms have 32 bits and move as signed integers.
_HALF = 1 << 31
#: Blocks that are scored first; at most so many numbers of blocks go into a filter, beyond it they are joined.
FIRST_BLOCKS, LISTED_BLOCKS = 4, 10_000
#: Fields of a chunk that say where it comes from, not what it holds.
SYSTEM = {"collection_id", "sync_id", "sync_job_id", "chunk_index", "source_name", "entity_type", "original_entity_id", "access_is_public", "access_viewers", "dense_embedding", "written_at", "hash"}


def whole_json(rows: DataFrame, exclude: Sequence[str] = ()) -> Column:
    """The JSON of all fields but those of the system and `exclude`, names in order, nulls included."""
    fields = sorted(c for c in rows.columns if c not in SYSTEM and c not in exclude)
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in fields]), {"ignoreNullFields": "false"})


def token_id(term: Column) -> Column:
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long")


def counted(rows: DataFrame, ident: str, text: Column, *others: str) -> DataFrame:
    """(ident, others, token, tf, length): how often each term is in the texts of an id, and how many terms these have. A text is moved once,
    to those of its id; its terms are counted there."""
    whole = rows.groupBy(ident, *others).agg(F.collect_list(text).alias("_t"))
    found = whole.select(ident, *others, _tokens(F.flatten(F.transform("_t", search.terms))).alias("_c"))
    found = found.select(ident, *others, _length(F.col("_c")).alias("length"), _merged(F.col("_c")).alias("_c"))
    return found.select(ident, *others, "length", F.inline("_c"))


def _tokens(terms: Column) -> Column:
    """(token, tf) of the distinct terms of an array, null without any."""
    return F.transform(search.term_counts(terms), lambda x: F.struct(token_id(x["term"]).alias("token"), x["tf"].alias("tf")))


def _length(tokens: Column) -> Column:
    return F.coalesce(F.aggregate(tokens, F.lit(0), lambda n, x: n + x["tf"]), F.lit(0))


def _merged(tokens: Column) -> Column:
    """Terms with one id are one, with the sum of their counts; few texts have such."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i)["token"].eqNullSafe(F.get(s, i - 1)["token"]))
        own = lambda at, i, k: F.slice(s, i + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - i)
        return bound(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i)["token"].alias("token"), F.aggregate(own(at, i, k), F.lit(0), lambda n, x: n + x["tf"]).alias("tf"))))

    distinct = lambda found: F.size(F.array_distinct(F.transform(found, lambda x: x["token"])))
    return bound(tokens, lambda found: F.when(distinct(found) < F.size(found), bound(F.sort_array(found), runs)).otherwise(found))


def weight(tf: Column, length: Column, mean: Column | float, k1: float = K1, b: float = B) -> Column:
    """Saturated frequency by relative length."""
    tf = tf.cast("double")
    mean = F.lit(float(mean)) if not isinstance(mean, Column) else mean
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def rarity(df: Column, count: Column | int) -> Column:
    count = F.lit(int(count)) if not isinstance(count, Column) else count
    return F.log1p((count - df + 0.5) / (df + 0.5))


def build(rows: DataFrame, ident: str, text: Column, path: str, cluster: Sequence[str] = (), size: int = BLOCK) -> None:
    """Adds chunks to the index at `path`, which need not be there yet. `cluster`: columns by which chunks are put together, so that
    a term is in few blocks."""
    at = int(time.time() * 1e6)
    # Dealt by the length in characters, so that terms are found once, after the text has moved.
    dealt = rows.select(ident, *cluster, text.alias("_t")).withColumn("_s", F.length("_t")).repartitionByRange(*cluster, "_s", ident)
    found = dealt.select(ident, *cluster, _tokens(search.terms(F.col("_t"))).alias("_c"))
    found = found.select(ident, *cluster, _length(F.col("_c")).alias("length"), _merged(F.col("_c")).alias("_c"))
    tokens = F.transform("_c", lambda x: (x["token"] - F.lit(_HALF)).cast("int"))
    found = found.select(ident, *cluster, "length", tokens.alias("tokens"), F.transform("_c", lambda x: x["tf"].cast("int")).alias("tfs"))
    ordered = found.sortWithinPartitions(*cluster, "length", ident)
    # Stored, so that a chunk's place is settled once.
    placed = stored(ordered.select(ident, "length", "tokens", "tfs", F.monotonically_increasing_id().alias("at")))
    chunks, terms, entries = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    _write(_posted(placed.where("length > 0"), size, entries).withColumn("written_at", F.lit(at)), path)
    block = F.floor(F.col("at") / size).cast("long")
    own = placed.where("length > 0").select(F.col(ident).alias("id"), block.alias("block"), (F.col("at") - block * size).cast("int").alias("pos"), "length")
    own.withColumn("written_at", F.lit(at)).write.mode("append").parquet(f"{path}/chunks")
    _write_totals(rows.sparkSession, path, chunks, terms, at)


def _posted(placed: DataFrame, size: int, entries: int) -> DataFrame:
    """(token, block, pos, tf, most, n), dealt by buckets and spans of chunks to tasks of about PART_ENTRIES entries, from chunks in their order."""
    moved = placed.select("at", "tokens", "tfs").mapInArrow(_by_terms, "token int, span long, off array<smallint>, tf array<int>")
    parts = -(-entries // PART_ENTRIES) or 1
    part = F.pmod(F.hash("span"), F.lit(-(-parts // BUCKETS)))
    dealt = moved.repartition(parts, _bucket(F.col("token") + F.lit(_HALF)), part)
    return dealt.mapInArrow(_by_blocks(size), "token long, block long, pos array<int>, tf array<int>, most int, n int")


def _by_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each term, from chunks with their terms: a row for each span of chunks, of at most about PART_ENTRIES entries at once."""
    for batch in batches:
        at, lists = batch.column("at").to_numpy(zero_copy_only=False), batch.column("tokens")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        tokens, tfs = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
        first = 0
        while first < len(at):
            begin = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, begin + PART_ENTRIES, "right")), first + 1)
            each = np.repeat(at[first:last], np.diff(ends[first:last], prepend=begin))
            own, tf = tokens[begin : ends[last - 1]], tfs[begin : ends[last - 1]]
            order = np.argsort(own, kind="stable")
            own, tf, each = own[order], tf[order], each[order]
            span = each >> SPAN_BITS
            starts = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (span[1:] != span[:-1]))))
            cut = pa.array(np.append(starts, len(own)).astype(np.int32))
            off = (each & ((1 << SPAN_BITS) - 1)).astype(np.int16)
            columns = [pa.array(own[starts]), pa.array(span[starts]), pa.ListArray.from_arrays(cut, pa.array(off)), pa.ListArray.from_arrays(cut, pa.array(tf))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "span", "off", "tf"])
            first = last


def _by_blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of `_by_terms` cut into blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = pc.list_value_length(batch.column("off")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            at = (batch.column("span").to_numpy()[row] << SPAN_BITS) + batch.column("off").flatten().to_numpy()
            block, tf = at // size, batch.column("tf").flatten().to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (block[1:] != block[:-1]))))
            ends = np.append(starts, len(row)).astype(np.int32)
            token = batch.column("token").to_numpy().astype(np.int64)[row[starts]] + _HALF
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((at - block * size).astype(np.int32), tf)]
            columns = [pa.array(token), pa.array(block[starts]), *lists, pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.diff(ends))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "block", "pos", "tf", "most", "n"])

    return cut


def _write_totals(spark: SparkSession, path: str, chunks: int, terms: int, at: int) -> None:
    totals = spark.createDataFrame([(chunks, terms, at)], "chunks long, terms long, written_at long")
    totals.coalesce(1).write.mode("append").parquet(f"{path}/totals")


def _write(rows: DataFrame, path: str) -> None:
    if not exists(rows.sparkSession, f"{path}/columns"):
        # No row, but the columns: an index without a term can be read, too.
        rows.limit(0).withColumn("bucket", F.lit(0)).write.parquet(f"{path}/columns")
    out = rows.withColumn("bucket", _bucket(F.col("token"))).sortWithinPartitions("bucket", "token", "block")
    out.write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """(id, block, pos, length, written_at)."""
    return spark.read.parquet(f"{path}/chunks")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/postings")


def _bucket(token: Column) -> Column:
    return F.pmod(token, F.lit(BUCKETS)).cast("int")


def remove(keys: DataFrame, ident: str, path: str) -> None:
    """Chunks (ident) that were written until now are gone."""
    at = int(time.time() * 1e6)
    keys.select(ident).distinct().withColumn("deleted_at", F.lit(at)).write.mode("append").parquet(f"{path}/deleted")


def _deleted(spark: SparkSession, path: str, ident: str) -> DataFrame | None:
    if not exists(spark, f"{path}/deleted"):
        return None
    return spark.read.parquet(f"{path}/deleted").groupBy(ident).agg(F.max("deleted_at").alias("_gone"))


def _entries(rows: DataFrame, chunks: DataFrame, ident: str, path: str) -> DataFrame:
    """Rows of postings as (ident, token, tf, length), without chunks deleted after they were written."""
    gone = _deleted(rows.sparkSession, path, ident)
    held = chunks.withColumnRenamed("id", ident)
    if gone is not None:
        held = held.join(gone, ident, "left").where(F.col("_gone").isNull() | (F.col("written_at") > F.col("_gone"))).drop("_gone")
    each = rows.select("token", *_KEY, F.inline(F.arrays_zip("pos", "tf")))
    return each.join(held, [*_KEY, "pos"]).select(ident, "token", "tf", "length")


def compacted(spark: SparkSession, path: str, ident: str, target: str) -> None:
    """The index without deleted chunks, at another path; blocks stay as they are, but for what left them."""
    rows, held = _read(spark, path), _chunks(spark, path)
    gone = _deleted(spark, path, ident)
    if gone is not None:
        marked = stored(held.join(gone.withColumnRenamed(ident, "id"), "id", "left").withColumn("_lost", F.coalesce(F.col("written_at") <= F.col("_gone"), F.lit(False))).drop("_gone"))
        held = marked.where(~F.col("_lost")).drop("_lost")
        lost = stored(marked.where("_lost").groupBy(*_KEY).agg(F.collect_set("pos").alias("_lost")))
        few = lost.count() <= BROADCAST_BLOCKS
        rows = rows.join(F.broadcast(lost) if few else lost, _KEY, "left")
        e = F.arrays_zip("pos", "tf")
        rows = rows.withColumn("_e", F.when(F.col("_lost").isNull(), e).otherwise(F.filter(e, lambda x: ~F.array_contains(F.col("_lost"), x["pos"]))))
        rows = rows.where(F.size("_e") > 0).withColumns({"pos": F.col("_e.pos"), "tf": F.col("_e.tf"), "most": F.array_max("_e.tf"), "n": F.size("_e")})
        if not few:
            rows = rows.hint("rebalance", "bucket")
    # Where no row has moved, each task still has the rows of a few buckets only.
    _write(rows.select("token", "block", "pos", "tf", "most", "n", "written_at"), target)
    held.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY, "pos").write.parquet(f"{target}/chunks")
    chunks, terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    _write_totals(spark, target, chunks, terms, int(time.time() * 1e6))


def _query(spark: SparkSession, path: str, query: str) -> tuple[DataFrame | None, dict[int, float], float]:
    """(rows of the query's terms, each term's rarity, mean length)."""
    words = search.query_terms(query)
    if not words:
        return None, {}, 1.0
    tokens = [r[0] for r in spark.createDataFrame([(w,) for w in words], "t string").select(token_id(F.col("t"))).distinct().collect()]
    totals = spark.read.parquet(f"{path}/totals").agg(F.sum("chunks"), F.sum("terms")).first()
    count, mean = totals[0] or 0, (totals[1] or 0) / max(totals[0] or 0, 1) or 1.0
    rows = _read(spark, path).where(F.col("bucket").isin(sorted({t % BUCKETS for t in tokens})) & F.col("token").isin(tokens))
    held = rows.groupBy("token").agg(F.sum("n").alias("df")).select("token", rarity(F.col("df"), count).alias("r")).collect()  # as many as terms
    return rows, {r["token"]: r["r"] for r in held}, mean


def _summed(rows: DataFrame, chunks: DataFrame, ident: str, path: str, rare: dict[int, float], mean: float, permitted: DataFrame | None) -> DataFrame:
    each = _entries(rows, chunks, ident, path)
    if permitted is not None:
        each = each.join(permitted.select(ident), ident, "left_semi")
    return each.groupBy(ident).agg(F.round(F.sum(_rare(rare) * weight(F.col("tf"), F.col("length"), mean)), 9).alias("keyword"))


def _rare(rare: dict[int, float]) -> Column:
    return F.create_map(*[x for t, r in rare.items() for x in (F.lit(t), F.lit(r))])[F.col("token")]


def scores(spark: SparkSession, path: str, ident: str, query: str, permitted: DataFrame | None = None) -> DataFrame:
    """(ident, keyword) of all chunks with one of the query's terms, by adding up all of their postings."""
    rows, rare, mean = _query(spark, path, query)
    if rows is None or not rare:
        return _nothing(spark, path, ident)
    return _summed(rows, _chunks(spark, path), ident, path, rare, mean, permitted)


def _nothing(spark: SparkSession, path: str, ident: str) -> DataFrame:
    return _chunks(spark, path).select(F.col("id").alias(ident), F.lit(0.0).alias("keyword")).limit(0)


def top(spark: SparkSession, path: str, ident: str, query: str, k: int, permitted: DataFrame | None = None, told: dict | None = None) -> DataFrame:
    """The k best of `scores`, without the entries of blocks that cannot reach them; ties by id. `permitted`: chunks that count.

    `told` gets the number of blocks with one of the terms, and of those whose entries were read.
    """
    rows, rare, mean = _query(spark, path, query)
    if rows is None or not rare:
        return _nothing(spark, path, ident)
    most = F.sum(_rare(rare) * weight(F.col("most"), F.col("least"), mean)).alias("most")
    chunks = _chunks(spark, path)
    lengths = chunks.groupBy(*_KEY).agg(F.min("length").alias("least"))
    bounds = stored(rows.select("token", "most", *_KEY).join(lengths, _KEY).groupBy(*_KEY).agg(most).select("most", *_KEY))
    best, least, read, step = None, float("-inf"), 0, FIRST_BLOCKS
    last: tuple | None = None
    while True:
        # Blocks come by falling bounds, so those that were read are the ones before the last. Bounds are sums of rounded numbers, as scores are.
        rest = bounds.where(F.col("most") >= least - 1e-6)
        if last is not None:
            rest = rest.where(_after(last))
        if step <= LISTED_BLOCKS:
            some = rest.orderBy(F.desc("most"), *_KEY).limit(step).collect()
            read += len(some)
            last = tuple(some[-1]) if some else last
            part = [_of_blocks(x, some) for x in (rows, chunks)] if some else None
        else:
            read += rest.count()
            some, part = [], [x.join(rest.select(*_KEY), _KEY, "left_semi") for x in (rows, chunks)]
        if part is not None:
            found = _summed(*part, ident, path, rare, mean, permitted)
            best = stored((found if best is None else best.unionByName(found)).orderBy(F.desc("keyword"), ident).limit(k))
            n, low = best.agg(F.count(F.lit(1)), F.min("keyword")).first()
            least = low if n == k else least
        if len(some) < step or step > LISTED_BLOCKS:
            break
        step *= 4
    out = best if best is not None else _nothing(spark, path, ident)
    out = out.orderBy(F.desc("keyword"), ident)
    if told is not None:
        told.update(blocks=bounds.count(), read=read)
    return out


def _after(last: tuple) -> Column:
    """Whether a block comes after `last` (bound, block, write) in the order of reading."""
    most, block, at = last
    return (F.col("most") < most) | ((F.col("most") == most) & ((F.col("block") > block) | ((F.col("block") == block) & (F.col("written_at") > at))))


def _of_blocks(rows: DataFrame, blocks: Sequence) -> DataFrame:
    """Rows of these blocks; the filter on the block's number reaches the files, which are in its order."""
    writes: dict[int, list[int]] = {}
    for r in blocks:
        writes.setdefault(r["written_at"], []).append(r["block"])
    wanted = F.lit(False)
    for at, own in writes.items():
        wanted = wanted | ((F.col("written_at") == at) & F.col("block").isin(own))
    return rows.where(wanted)
