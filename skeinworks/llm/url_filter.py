"""URL filters (operator 4): a blocked Bloom filter ahead of an exact hash join.

A listed entry is `host/path`. Its key is the host with the directory part of its path (up to the last
slash); a url's candidates are all suffixes of its host with all directory prefixes of its path, so an
entry can fit only where its key is a candidate. Candidates are hashed in the JVM, probed against the
filter in Arrow batches, and the few urls that pass meet the list in an exact join, each host and path once; the
join also compares whole paths. Pages without a hit take no part in it. The longest entry that fits wins (ties: the smaller string).

The filter is one array of 256-bit blocks, built by a distributed bit-or and bounded by `max_bytes`;
a longer list only raises the share of false passes, which the join removes.

Defined cases: a null url or one without `://` has empty host and path and is allowed; a host without a
path never fits an entry, whose paths begin with a slash; repeated rows are judged alike and all kept;
an empty list allows everything; an empty table gives an empty result; columns other than the id and
url are not read by the query, and clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import enter, read

#: The rules of the registered query, as (entry, verdict).
RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]
BITS_PER_KEY = 16
WORDS_PER_BLOCK = 4
PROBES = 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path by the first `://`."""
    cut = F.instr(url, "://")
    rest = F.coalesce(F.when(cut > 0, url.substr(cut + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def _key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def _marks(h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its bits as four 64-bit words."""
    u = h.astype(np.uint64)
    block = ((u >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    words = np.zeros((len(u), WORDS_PER_BLOCK), np.uint64)
    x = u * np.uint64(0x9E3779B97F4A7C15)
    rows = np.arange(len(u))
    for k in range(PROBES):
        bit = (x >> np.uint64(8 * k + 8)) & np.uint64(255)
        words[rows, (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
    return block.astype(np.int64), words


class BlockedBloom:
    """A filter of 256-bit blocks over 64-bit hashes; each key touches one block."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def build(cls, keys: DataFrame, max_bytes: int = 64 << 20) -> BlockedBloom:
        """From a column `key`; blocks are or-ed where the keys are, and at most max_bytes reach the driver."""
        hashed = keys.select(_key_hash(F.col("key")).alias("h")).distinct()
        n = hashed.count()
        n_blocks = int(max(1, min(max_bytes // (8 * WORDS_PER_BLOCK), -(-n * BITS_PER_KEY // 256))))

        def bits(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in it:
                block, words = _marks(part["h"].to_numpy(), n_blocks)
                yield pd.DataFrame({"block": block, **{f"w{k}": words[:, k].astype(np.int64) for k in range(WORDS_PER_BLOCK)}})

        names = [f"w{k}" for k in range(WORDS_PER_BLOCK)]
        schema = "block long, " + ", ".join(f"{x} long" for x in names)
        rows = hashed.mapInPandas(bits, schema).groupBy("block").agg(*[F.bit_or(x).alias(x) for x in names])
        words = np.zeros((n_blocks, WORDS_PER_BLOCK), np.uint64)
        got = rows.toPandas()
        if len(got):
            words[got["block"].to_numpy()] = got[names].to_numpy().astype(np.int64).view(np.uint64)
        return cls(words)

    def passes(self, h: np.ndarray) -> np.ndarray:
        block, words = _marks(h, len(self.words))
        return ((self.words[block] & words) == words).all(axis=1)


def listed(entries: DataFrame) -> DataFrame:
    """Entries (rule, verdict) with their host, path and key; an entry without a slash has path `/`."""
    rule = F.col("rule")
    return (
        entries.where(rule.isNotNull())
        .groupBy("rule")
        .agg(F.min("verdict").alias("rule_verdict"))
        .withColumn("rule_host", F.lower(F.regexp_extract(rule, r"^([^/]*)", 1)))
        .withColumn("rule_path", F.when(F.instr(rule, "/") > 0, F.regexp_extract(rule, r"^[^/]*(.*)$", 1)).otherwise("/"))
        .withColumn("key", F.concat("rule_host", F.regexp_extract("rule_path", r"^(.*/)", 1)))
        # For ties: of equally long entries the smaller string, by its negated code points.
        .withColumn("rule_order", F.expr("transform(split(rule, ''), c -> -ascii(c))"))
    )


def candidates(labels: int, levels: int, host: str = "host", path: str = "path") -> Column:
    """Every suffix of the host at a dot, with every prefix of the path that ends in a slash, up to the most
    labels and slashes that a key of the list has: longer ones equal no key."""
    names, parts = f"split({host}, '[.]', -1)", f"split({path}, '/', -1)"
    return F.expr(
        f"""flatten(transform(
            sequence(greatest(size({names}) - {labels} + 1, 1), size({names})),
            i -> transform(
                filter(sequence(1, greatest(least(size({parts}) - 1, {levels}), 1)), j -> instr({path}, '/') > 0),
                j -> concat(array_join(slice({names}, i, {labels}), '.'), array_join(slice({parts}, 1, j), '/'), '/'))))"""
    )


def judge(pages: DataFrame, entries: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """pages with `host`, `path`, `rule` and `verdict` (allow where no entry fits)."""
    rules = listed(entries)
    bloom = pages.sparkSession.sparkContext.broadcast(BlockedBloom.build(rules.select("key"), max_bytes).words)

    @F.pandas_udf("array<int>")
    def possible(hashes: pd.Series) -> pd.Series:
        """Places of the candidates that pass the filter."""
        enter("urls")
        sizes = hashes.str.len().fillna(0).astype(int).to_numpy()
        flat = np.concatenate([np.asarray(x, np.int64) for x in hashes if x is not None and len(x)]) if sizes.sum() else np.zeros(0, np.int64)
        hit = np.split(BlockedBloom(bloom.value).passes(flat), np.cumsum(sizes)[:-1]) if len(sizes) else []
        return pd.Series([np.flatnonzero(x) for x in hit], dtype=object)

    # Marked as not repeatable, so that the optimizer neither copies it into later expressions nor moves them below it.
    possible = possible.asNondeterministic()
    host, path = host_and_path(F.col("url"))
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    most = rules.agg(F.max(F.size(F.split("rule_host", "[.]", -1))), F.max(F.size(F.split("key", "/", -1)) - 1)).first()
    keyed = base.withColumn("_keys", candidates(most[0] or 1, most[1] or 1)).withColumn("_hit", possible(F.transform("_keys", _key_hash)))
    keyed = keyed.withColumn("_keys", F.expr("array_distinct(transform(_hit, i -> _keys[i]))")).drop("_hit")
    # Only urls with a hit meet the list, each host and path once; all other rows stay where they are.
    hits, rest = keyed.where(F.size("_keys") > 0), keyed.where(F.size("_keys") <= 0)
    urls = hits.select("host", "path", "_keys").dropDuplicates(["host", "path"])
    found = urls.select("host", "path", F.explode("_keys").alias("key")).join(rules, "key").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.col("rule_order")))
    verdicts = found.groupBy("host", "path").agg(best.alias("_best"))
    names = base.columns
    judged = hits.join(verdicts, ["host", "path"], "left").select(*names, F.col("_best.rule").alias("rule"), F.coalesce("_best.rule_verdict", F.lit("allow")).alias("verdict"))
    return judged.unionByName(rest.select(*names, F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    entries = spark.createDataFrame(RULES, "rule string, verdict string")
    return judge(pages, entries).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = f"""
with r(rule, rv) as (values {", ".join(f"('{a}', '{b}')" for a, b in RULES)}),
p as (select row_number() over () as rid, page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select rid, page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from p),
f as (select rid, rule, rv, row_number() over (partition by rid order by length(rule) desc, rule) as k from h, r
  where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, strpos(rule, '/'))))
select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from h left join (select * from f where k = 1) using (rid)
"""
