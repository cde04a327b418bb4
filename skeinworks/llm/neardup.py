"""Near-duplicate documents by min-max hashing (operator 8).

A document's set is that of its distinct `shingle`-word runs. Each of `PERMUTATIONS` hash permutations
gives two values, the least and the largest, so a signature of 2 * PERMUTATIONS values costs half the
evaluations. Bands of two permutations (four values) put documents into buckets. What shares a bucket is
compared by signature and then confirmed on full sets.

Work per group stays linear where groups are tight:

1. Documents with equal sets collapse to the smallest id; only these go on.
2. In each bucket every member meets one hub (a star, not all pairs): the member that shares most buckets
   with others, which is the text that the copies of a group were made from, if it is there.
3. Confirmed links give components. Only members of buckets that then still hold several components are
   looked at again, by prefixes: two sets that overlap enough share one of the rarest shingles of both.
   Shingles that one document alone has come first in that order and cannot be shared, so texts that differ
   from a common source by edits of their own have short prefixes, or none. Pairs of different components
   that meet in a prefix, and whose places in it leave room for enough others, are confirmed.

A link is lost in two ways only, both rare: with 32 bands of four values a pair at the threshold of 0.8 shares no
bucket with probability (1 - 0.8**4)**32 = 5e-8, and its signatures agree in fewer than LEAST_AGREEING of 128
values, below which a candidate is not confirmed, with probability 9e-09 (as for independent values).

Defined cases: a null text or one without words has an empty set and is linked with nothing; a text of
fewer words than a shingle is one shingle; a row with a null id is a component of its own with a null
component_id; rows that share an id share its component; with further columns, a null id
has no `n_shingles` and an id's repeated rows get its largest; an empty table gives an empty result; further
columns of the input are kept by `near_duplicates`, clashing names replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_array, enter, gram_hashes, mix, read, slices, stored, utf8, word_hashes
from .url_filter import BlockedBloom

PERMUTATIONS = 64
BANDS = 32
#: A pair at 0.8 agrees in 102 of 128 values on average (deviation 4.5), so fewer than this many is six deviations off.
LEAST_AGREEING = 75
_RNG = np.random.default_rng(8128)
_FACTORS = (_RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_BAND_MIX = _RNG.integers(0, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNATURE = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig binary"


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles, A-Z read as a-z."""
    words, _, _ = word_hashes(as_array(utf8(text)), lower=True)
    if not len(words):
        return np.zeros(0, np.uint64)
    # A short text's only shingle must not equal one of another length.
    grams = gram_hashes(words, shingle) if len(words) >= shingle else mix(gram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(grams)


def min_max(values: np.ndarray) -> np.ndarray:
    """Least and largest value under each permutation, side by side."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for a in range(0, len(values), 2048):
        x = values[None, a : a + 2048] * _FACTORS
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.stack([low, high], axis=1).reshape(-1)


def _signed(text: str | None, shingle: int) -> tuple[int, int, int, list[int], bytes]:
    s = shingle_set(text, shingle)
    if not len(s):
        return 0, 0, 0, [], b""
    f1, f2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
    values = mix(min_max(s))
    bands = mix((values.reshape(BANDS, 4) * _BAND_MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return len(s), f1, f2, bands.view(np.int64).tolist(), (values & np.uint64(255)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("neardup")
        for batch in it:
            rows = [_signed(t, shingle) for part in slices(batch.column("text")) for t in part]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            arrays = [batch.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "f1", "f2", "bands", "sig"])

    return docs.select("doc_id", "text").mapInArrow(sign, _SIGNATURE)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b). Alternates large-star and small-star
    steps, each an aggregate and a join, until nothing changes; each step's edges are stored."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in enough values."""

    @F.pandas_udf("int")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="int32")
        x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
        return pd.Series((x == y).sum(axis=1).astype(np.int32))

    sig = reps.select("rep", "sig")
    a, b = sig.withColumnsRenamed({"rep": "a", "sig": "sa"}), sig.withColumnsRenamed({"rep": "b", "sig": "sb"})
    return pairs.join(a, "a").join(b, "b").where(agree("sa", "sb") >= LEAST_AGREEING).select("a", "b")


def _sets(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(id, items): the full sets of these documents. A Bloom filter of the ids keeps the texts of all others
    from being moved; the exact join follows."""
    bloom = docs.sparkSession.sparkContext.broadcast(BlockedBloom.build(ids.select(F.col("id").alias("key"))).words)

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(bloom.value).passes(h.to_numpy()))

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("neardup")
        for batch in it:
            found = [shingle_set(t, shingle).tobytes() for part in slices(batch.column("text")) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(found, pa.binary())], names=["id", "items"])

    some = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    return stored(some.where(possible(F.xxhash64("id"))).join(ids, "id", "left_semi").mapInArrow(sets, "id long, items binary"))


def _measured(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs with the sizes of intersection and union of their full sets."""

    @F.pandas_udf("shared long, total long")
    def compare(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        shared, total = [], []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.minimum(np.searchsorted(q, p), len(q) - 1) if len(q) else np.zeros(len(p), np.int64)
            n = int((q[at] == p).sum()) if len(q) else 0
            shared.append(n)
            total.append(len(p) + len(q) - n)
        return pd.DataFrame({"shared": shared, "total": total})

    a, b = own.withColumnsRenamed({"id": "a", "items": "x"}), own.withColumnsRenamed({"id": "b", "items": "y"})
    out = pairs.join(a, "a").join(b, "b").withColumn("_c", compare("x", "y"))
    return stored(out.groupBy("a", "b").agg(F.max(F.struct(F.col("_c.shared") / F.col("_c.total"), F.col("_c.shared").alias("shared"), F.col("_c.total").alias("total"))).alias("_m")).select("a", "b", "_m.shared", "_m.total"))


def _met_in_prefix(held: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can still overlap enough.

    held: rep, n, component, size (of its component), least (size of the smallest document that it shares
    a bucket with). An overlap must reach percent * (n + m) / (100 + percent).
    """

    def items(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [np.frombuffer(x, np.int64) for x in batch.column("items").to_pylist()]
            rep = np.repeat(np.array(batch.column("id").to_pylist(), np.int64), [len(x) for x in found])
            h = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(h, pa.int64())], names=["rep", "h"])

    def needed(n: Column, m: Column) -> Column:
        return F.ceil(percent * (n + m) / (100 + percent) - 1e-9)

    rows = own.join(held.select(F.col("rep").alias("id")), "id", "left_semi").mapInArrow(items, "rep long, h long").distinct()
    # Stored, so that a frequent shingle's rows meet its count in a join that can be split.
    often = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    each = Window.partitionBy("rep")
    placed = rows.join(often, "h").withColumns({"place": F.row_number().over(each.orderBy("df", "h")), "s": F.count(F.lit(1)).over(each)})
    floor = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    prefix = placed.join(held, "rep").where(F.col("place") <= F.col("s") - needed(F.col("n"), floor) + 1)
    prefix = stored(prefix.select("h", "rep", "n", "s", "place", "component", "size"))
    # One side of a pair lies outside the shingle's largest component: only such rows look for partners.
    main = prefix.groupBy("h").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.max_by("component", F.struct("size", "component")).alias("main"))
    main = stored(main.where("c1 < c2").select("h", "main"))
    left = prefix.join(main, "h").where("component <> main")
    right = prefix.select("h", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("place").alias("at"), F.col("component").alias("other"))
    apart = (F.col("component") != F.col("other")) & ((F.col("other") == F.col("main")) | (F.col("rep") < F.col("b")))
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    room = F.least(F.col("s") - F.col("place"), F.col("t") - F.col("at")) + 1 >= needed(F.col("n"), F.col("m"))
    met = left.join(right, "h").where(apart & fits & room)
    return met.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with `n_shingles`, `component_id` and `kept` (the document is the smallest of its component)."""
    docs = docs.drop("n_shingles", "component_id", "kept")
    signed = stored(signatures(docs, shingle))
    sets = stored(signed.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")))
    firsts = signed.join(sets, ["f1", "f2"]).where("doc_id = rep").dropDuplicates(["f1", "f2"])
    reps = stored(firsts.select("rep", "n_shingles", "bands", "sig"))
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    members = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    sizes = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = stored(members.join(sizes, "key"))
    weights = shared.groupBy("rep").agg(F.sum("size").alias("w"))
    hubs = shared.join(weights, "rep").groupBy("key").agg(F.max(F.struct("w", (-F.col("rep")).alias("r"), "n")).alias("_h"))
    hubs = stored(hubs.select("key", (-F.col("_h.r")).alias("pivot"), F.col("_h.n").alias("m")))
    shared = stored(shared.drop("size").join(hubs, "key"))
    star = shared.where((F.col("rep") != F.col("pivot")) & fits).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    own = _sets(shared.select(F.col("rep").alias("id")).distinct(), docs, shingle)
    first = _measured(stored(_agreeing(star, reps)), own)
    linked = (100 * F.col("shared") >= percent * F.col("total")) & (F.col("total") > 0)
    links = first.where(linked).select("a", "b")
    label = components(links)

    placed = shared.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("n").alias("least")).where("c1 < c2")
    held = placed.join(stored(several.select("key", "least")), "key").groupBy("rep", "n", "component").agg(F.min("least").alias("least"))
    size = label.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    held = stored(held.join(size, "component", "left").fillna(1, ["size"]))
    second = _measured(stored(_agreeing(_met_in_prefix(held, own, percent), reps)), own)
    more = second.where(linked).select("a", "b")
    if more.limit(1).count():
        label = components(links.unionByName(more))

    named = sets.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    found = signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    result = found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component_id"))
    result = result.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    result = result.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    if set(docs.columns) == {"doc_id", "text"}:
        return result
    one = result.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"), F.bool_and("kept").alias("kept"))
    return docs.join(one, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(True)))


def op8_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = """
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
s as (select distinct doc_id, k from (
  select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')] else [array_to_string(words[i:i + 3], ' ') for i in range(1, len(words) - 2)] end) as k from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
x as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
e as (select a, b from x join n p on p.doc_id = a join n q on q.doc_id = b where 100 * shared >= 80 * (p.n + q.n - shared)),
g as (select a, b from e union select b, a from e),
r(doc_id, c) as (select a, a from g union select g.b, r.c from r join g on g.a = r.doc_id where r.c < g.b),
m as (select doc_id, min(c) as c from r group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, d.doc_id) as component_id, coalesce(m.c, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join m using (doc_id)
"""
