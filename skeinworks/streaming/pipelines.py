"""Streams: change data capture by micro-batch, deduplication, counts, and rate limits with state."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import cdc


def first_of_run(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once for the whole run; the state is the run's, under its own checkpoint."""
    return rows.dropDuplicates(keys)


def apply_changes(rows: DataFrame, read_state: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, keys: list[str], save_cursor: Callable[[object], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Micro-batches: deduplicate, hash, classify against state, hand on. `write` sees the batch number, so a
    batch that is replayed can be told from a new one; the position is saved only after it returns, and so is the
    source's cursor, the largest `seq` of the batch. `every`: the time between batches; None reads what is there and ends."""

    def each(batch: DataFrame, number: int) -> None:
        one = cdc.hashed(cdc.keep_first(batch, keys, ["seq"]))
        write(cdc.classified(one, read_state(), keys), number)
        if save_cursor is not None:
            last = batch.agg(F.max("seq")).first()[0]
            if last is not None:
                save_cursor(last)

    stream = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if every is None else stream.trigger(processingTime=every)).start()


class Progress(StreamingQueryListener):
    """Calls `snapshot` with the rows read so far whenever `every` more have come, and at the end of a query."""

    def __init__(self, snapshot: Callable[[int], None], every: int = 50):
        self.snapshot, self.every, self.rows, self.told = snapshot, every, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        if self.rows - self.told >= self.every:
            self.told = self.rows
            self.snapshot(self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.rows > self.told:
            self.told = self.rows
            self.snapshot(self.rows)


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and type, with late rows allowed for."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


class SlidingLimit(StatefulProcessor):
    """At most `limit` accepted calls per key in any `seconds`; refused calls do not count.

    State of a key: the times of its accepted calls inside the window, at most `limit` of them.
    """

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getValueState("log", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        """A batch's calls in order of time. Two numbers a call are held; the source's `maxFilesPerTrigger` bounds a batch."""
        times = deque(self.log.get()[0] if self.log.exists() else [])
        parts = [(p["at"].to_numpy(float), p["event_id"].to_numpy()) for p in rows]
        at, ids = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((ids, at))
        for k in range(0, len(order), 10_000):
            out = []
            for event_id, t in zip(ids[order[k : k + 10_000]].tolist(), at[order[k : k + 10_000]].tolist(), strict=True):
                while times and times[0] <= t - self.seconds:
                    times.popleft()
                ok = len(times) < self.limit
                out.append((key[0], event_id, ok, 0.0 if ok else max(times[0] + self.seconds - t, 0.1)))
                if ok:
                    times.append(t)
            yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "retry_after"])
        self.log.update((list(times),))

    def close(self) -> None:
        pass


def limited(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Calls (user_id, event_id, at) with `allowed` and `retry_after`."""
    schema = "user_id long, event_id long, allowed boolean, retry_after double"
    return events.groupBy("user_id").transformWithStateInPandas(SlidingLimit(limit, seconds), schema, outputMode="append", timeMode="none")
