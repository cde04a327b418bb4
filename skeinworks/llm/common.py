"""What the corpus operators share: storage between jobs, what workers keep, vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored as stored

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a SQL literal and as a regular-expression class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Python workers outlive a stage. What an operator keeps in one goes as soon as another operator works there.
_CLEARS: dict[str, Callable[[], None]] = {}
_AT_WORK = [""]


def on_leave(operator: str, clear: Callable[[], None]) -> None:
    """clear() lets go of all that the operator keeps in a worker."""
    _CLEARS[operator] = clear


def enter(operator: str) -> None:
    """The operator begins, or goes on, to work in this worker."""
    if _AT_WORK[0] == operator:
        return
    for other, clear in _CLEARS.items():
        if other != operator:
            clear()
    _AT_WORK[0] = operator
    trim()


def trim() -> None:
    """Gives freed memory back to the machine, where the allocator can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


_SEED = np.random.default_rng(20240613)
#: One odd 64-bit value per byte and powers of an odd base: a polynomial hash of bytes modulo 2**64.
_BYTE = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int, key: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling; as many as a segment needs are kept."""
    have = _POWERS.get(key)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 2**64))
        have = np.concatenate([have, have * step])
    _POWERS[key] = have if len(have) <= 2 * _SEGMENT else have[: 2 * _SEGMENT].copy()
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of a UTF-8 text."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Bytes of text hashed at once.
_SEGMENT = 1 << 18


def word_hashes(raw: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, its start, its end) without a loop over words.

    Long inputs go segment by segment, cut at white space, so temporary arrays stay small.
    """
    starts, ends = word_bounds(raw)
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = int(np.searchsorted(ends, starts[a] + _SEGMENT, "right"))
        b = max(b, a + 1)
        lo, hi = int(starts[a]), int(ends[b - 1])
        part = raw[lo:hi]
        values = _BYTE[_LOWER[part] if lower else part]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, len(part), "up"), out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        own = (total[e] - total[s]) * _powers(_INV, len(part) + 1, "down")[s]
        out[a:b] = mix(own ^ (e - s).astype(np.uint64))
        a = b
    return out, starts, ends


_STEP = _SEED.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; order matters."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += words[j : j + m] * _STEP[j]
    return mix(out)


def utf8(text: str | None) -> bytes:
    """Bytes of a text; lone surrogates, which Spark never makes, would be replaced."""
    return (text or "").encode("utf-8", "replace")


def as_array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


def batches(it: Iterator, columns: list[str]) -> Iterator[list[list]]:
    """Columns of each Arrow batch as Python lists."""
    for batch in it:
        yield [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]


def slices(texts: pa.Array, size: int = 256) -> Iterator[list]:
    """The values of a batch as Python objects, a few at a time."""
    for a in range(0, len(texts), size):
        yield texts.slice(a, size).to_pylist()


def row_count(df: DataFrame) -> int:
    return df.select(F.count(F.lit(1))).first()[0]
