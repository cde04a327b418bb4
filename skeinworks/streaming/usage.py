"""Usage as it comes, written out when enough has gathered or when it has waited long enough."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What gathers of each action before it is written out, and the seconds that less than that may wait.
THRESHOLDS = {"entities": 100, "queries": 10, "tokens": 100_000}
WAIT = 30.0
KEYS = ["organization_id", "action"]


def flushes(amounts: np.ndarray, pending: int, threshold: int) -> tuple[list[int], int]:
    """(sums that are written out, what stays), amounts in order: what has gathered goes as soon as it reaches the threshold."""
    total = np.cumsum(amounts.astype(np.int64)) + pending
    out, base, at = [], 0, 0
    while True:
        # Amounts are at least 0, so the sums rise.
        at = int(np.searchsorted(total, base + threshold, "left"))
        if at >= len(total):
            return out, int(total[-1]) - base if len(total) else pending
        out.append(int(total[at]) - base)
        base = int(total[at])


class Ledger(StatefulProcessor):
    """State of a key: what has not been written out, and when its first part came. A timer writes it out at most `wait` seconds after
    that; what reaches the threshold goes at once and takes the timer along."""

    def __init__(self, thresholds: Mapping[str, int], wait: float):
        self.thresholds, self.wait = dict(thresholds), wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "amount long, timer long")

    def _row(self, key, amount: int, cause: str) -> pd.DataFrame:
        return pd.DataFrame([(*key, amount, cause)], columns=[*KEYS, "amount", "cause"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending, timer = self.pending.get() if self.pending.exists() else (0, -1)
        parts = [(p["seq"].to_numpy(np.int64), p["amount"].to_numpy(np.int64)) for p in rows]
        seq, amount = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        gone, left = flushes(amount[np.argsort(seq, kind="stable")], pending, self.thresholds.get(key[1], 1))
        if timer >= 0 and (gone or not left):
            self.handle.deleteTimer(timer)
            timer = -1
        if left and timer < 0:
            timer = timerValues.getCurrentProcessingTimeInMs() + int(self.wait * 1000)
            self.handle.registerTimer(timer)
        if left:
            self.pending.update((left, timer))
        else:
            self.pending.clear()
        for a in range(0, len(gone), 10_000):
            yield pd.DataFrame([(*key, x, "threshold") for x in gone[a : a + 10_000]], columns=[*KEYS, "amount", "cause"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            amount, timer = self.pending.get()
            if timer == expiredTimerInfo.getExpiryTimeInMs():
                self.pending.clear()
                yield self._row(key, amount, "time")

    def close(self) -> None:
        pass


def flushed(records: DataFrame, thresholds: Mapping[str, int] = THRESHOLDS, wait: float = WAIT) -> DataFrame:
    """(organization_id, action, amount, cause) to be written out, from records (organization_id, action, amount, seq) with amounts of at
    least 0; an action without a threshold is written out at once. Sums of a key are the records' sums, but for what still waits."""
    kind = records.schema["organization_id"].dataType.simpleString()
    schema = f"organization_id {kind}, action string, amount long, cause string"
    return records.groupBy(*KEYS).transformWithStateInPandas(Ledger(thresholds, wait), schema, outputMode="append", timeMode="ProcessingTime")
