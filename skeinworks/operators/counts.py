"""Entity counts as a counter keeps them that never falls below zero: every step is clipped, not the sum.

A run of steps takes a count x to max(floor, x + total), whatever the steps are: one step d is (0, d), and (f1, t1) before (f2, t2)
is (max(f2, f1 + t2), t1 + t2). So parts of a long run are worked out apart, in any order of arrival, and joined in order of their steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYS = ["sync_id", "entity_type"]


def steps_of(changes: DataFrame) -> DataFrame:
    """Steps (sync_id, entity_type, seq, delta) of row changes: op INSERT, UPDATE or DELETE, `sync_id` and `entity_type` after it and
    `old_sync_id` and `old_entity_type` before it. An update that moves a row to another key takes from one and adds to the other;
    what has no type, before or after, does not count."""
    new, old = F.struct("sync_id", "entity_type"), F.struct(F.col("old_sync_id").alias("sync_id"), F.col("old_entity_type").alias("entity_type"))
    one = F.lit(1).cast("long")
    typed_new, typed_old = F.col("entity_type").isNotNull(), F.col("old_entity_type").isNotNull()
    add, take = F.struct(new.alias("k"), one.alias("delta")), F.struct(old.alias("k"), (-one).alias("delta"))
    moved = (F.col("sync_id") != F.col("old_sync_id")) | (F.col("entity_type") != F.col("old_entity_type"))
    found = (
        F.when((F.col("op") == "INSERT") & typed_new, F.array(add))
        .when((F.col("op") == "DELETE") & typed_old, F.array(take))
        .when((F.col("op") == "UPDATE") & typed_new & typed_old & moved, F.array(take, add))
    )
    return changes.select("seq", F.explode(found).alias("s")).select("s.k.sync_id", "s.k.entity_type", "seq", "s.delta")


def clipped_runs(deltas: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, from_seq, floor, total): the runs into which a range partitioning by key and `seq` cuts each key's steps.

    A key with most of the steps is spread over many partitions, each of which gives one row for it; steps of one `seq` go by
    their size, the smaller first.
    """
    order = [*keys, "seq", "delta"]
    rows = deltas.where(F.col("delta").isNotNull()).select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    named = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {named[k]}" for k in keys), "from_seq long, from_delta long, floor long, total long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, bool)
            change[0] = True
            for k in range(len(keys)):
                column = batch.column(k)
                new, old = column.slice(1), column.slice(0, n - 1)
                same = pa.compute.or_kleene(pa.compute.equal(new, old), pa.compute.and_(pa.compute.is_null(new), pa.compute.is_null(old)))
                change[1:] |= ~same.fill_null(False).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(change)
            seq, delta = (batch.column(len(keys) + k).to_numpy().astype(np.int64) for k in (0, 1))
            total = np.add.reduceat(delta, at)
            # After each step the count is at least 0, and what follows is added to that.
            after = np.cumsum(delta)
            least = np.minimum.reduceat(after, at)
            end = after[np.append(at[1:], n) - 1]
            columns = [batch.column(k).take(pa.array(at)) for k in range(len(keys))]
            numbers = [seq[at], delta[at], end - least, total]
            yield pa.record_batch([*columns, *(pa.array(x) for x in numbers)], names=[*keys, "from_seq", "from_delta", "floor", "total"])

    return rows.mapInArrow(run, schema)


def counts_after(stored: DataFrame, deltas: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts (keys, n) after all steps (keys, seq, delta) in order of seq; keys at zero go, and keys without a type."""
    runs = clipped_runs(deltas.where(F.col(keys[-1]).isNotNull()), keys)
    # One entry a batch of Arrow rows, so as many as the key's steps by thousands.
    joined = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("from_seq", "from_delta", "floor", "total"))).alias("_runs"))
    both = stored.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.sum("n").alias("_n")).join(joined, list(keys), "full_outer")
    start = F.greatest(F.coalesce("_n", F.lit(0)), F.lit(0)).cast("long")
    runs_or_none = F.coalesce("_runs", F.array().cast("array<struct<from_seq: bigint, from_delta: bigint, floor: bigint, total: bigint>>"))
    n = F.aggregate(runs_or_none, start, lambda x, r: F.greatest(r["floor"], x + r["total"]))
    return both.select(*keys, n.alias("n")).where("n > 0")


class RunningCounts(StatefulProcessor):
    """The count of a key as steps come; those of one micro-batch are put in order first. A key at zero leaves the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        parts = [(p["seq"].to_numpy(np.int64), p["delta"].to_numpy(np.int64)) for p in rows]
        seq, delta = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        after = np.cumsum(delta[np.lexsort((delta, seq))])
        n = max(int(after[-1] - after.min()), n + int(after[-1]))
        if n:
            self.count.update((n,))
        else:
            self.count.clear()
        yield pd.DataFrame([(*key, n)], columns=[*KEYS, "n"])

    def close(self) -> None:
        pass


def running_counts(deltas: DataFrame) -> DataFrame:
    """(sync_id, entity_type, n) after each micro-batch for the keys that it touched, 0 where nothing is left."""
    kinds = {f.name: f.dataType.simpleString() for f in deltas.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in KEYS), "n long"])
    rows = deltas.where(F.col("entity_type").isNotNull() & F.col("delta").isNotNull())
    return rows.groupBy(*KEYS).transformWithStateInPandas(RunningCounts(), schema, outputMode="update", timeMode="none")
