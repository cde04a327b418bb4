"""Where to cut a text: at changes of topic, and code at the borders of its definitions. Chunks joined give the text again.

Both are decided along a whole text, so they run in Arrow batches; each text takes time in proportion to its length, and memory
for a stretch of sentences at a time beside the text itself. A null text has null chunks, an empty one none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CHUNK_TOKENS, HARD_TOKENS

# Ends of sentences, the least length of one, sentences compared on each side of a border, length and order of
# the smoothing filter, how far a minimum must lie under the maxima beside it, as a share of the curve's range, and the share
# of borders that may be minima worth a cut.
SENTENCE_ENDS = (". ", "! ", "? ", "\n")
LEAST_CHARS = 24
COMPARED = 10
FILTER_LENGTH, FILTER_ORDER, TOLERANCE = 5, 3, 0.2
THRESHOLD = 0.01
CODE_TOKENS = 2048
#: Slots of a sentence's hashed vector, and sentences whose vectors are held at once.
SLOTS, STRETCH = 128, 4096
_SENTENCE = re.compile("(?:" + ".*?(?:" + "|".join(map(re.escape, SENTENCE_ENDS)) + ")|.+$)", re.S)
_WORD = re.compile("[^\x20\x09-\x0D]+")


def sentences(text: str, least: int = LEAST_CHARS) -> list[str]:
    """The text in sentences with their ends; a shorter piece goes with what follows, the last one with what comes before."""
    out, now = [], ""
    for piece in _SENTENCE.findall(text):
        now += piece
        if len(now) >= least:
            out.append(now)
            now = ""
    if now:
        if out:
            out[-1] += now
        else:
            out.append(now)
    return out


def hashed_vectors(found: list[str]) -> np.ndarray:
    """Each sentence's words in SLOTS slots with signs, by a hash of the word in lower case."""
    rows, codes = [], []
    for k, sentence in enumerate(found):
        own = [zlib.crc32(w.encode()) for w in _WORD.findall(sentence.lower())]
        codes += own
        rows += [k] * len(own)
    out = np.zeros((len(found), SLOTS))
    code = np.array(codes, np.int64)
    np.add.at(out, (np.array(rows, np.int64), code % SLOTS), np.where(code >> 16 & 1, 1.0, -1.0))
    return out


def similarities(found: list[str], compared: int = COMPARED) -> np.ndarray:
    """For each border between sentences, the cosine of the `compared` sentences before it and as many after it; 1 where a side has no word."""
    n, parts = len(found), []
    for a in range(1, n, STRETCH):
        b = min(a + STRETCH, n)
        lo, hi = max(a - compared, 0), min(b - 1 + compared, n)
        total = np.zeros((hi - lo + 1, SLOTS))
        np.cumsum(hashed_vectors(found[lo:hi]), axis=0, out=total[1:])
        at = np.arange(a, b) - lo
        left = total[at] - total[np.maximum(at - compared, 0)]
        right = total[np.minimum(at + compared, hi - lo)] - total[at]
        norms = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
        parts.append(np.where(norms > 0, (left * right).sum(axis=1) / np.where(norms > 0, norms, 1), 1.0))
    return np.concatenate(parts) if parts else np.zeros(0)


@cache
def _fit(length: int, order: int) -> np.ndarray:
    """The matrix that takes `length` values to those of their least-squares polynomial of this order."""
    powers = np.vander(np.arange(length) - length // 2, order + 1, increasing=True).astype(float)
    return powers @ np.linalg.pinv(powers)


def smoothed(curve: np.ndarray, length: int = FILTER_LENGTH, order: int = FILTER_ORDER) -> np.ndarray:
    """Each value by a polynomial through the values around it; at the ends by that of the first or last ones."""
    if len(curve) < length:
        return curve.copy()
    fit, half = _fit(length, order), length // 2
    out = np.empty(len(curve))
    out[half : len(curve) - half] = np.lib.stride_tricks.sliding_window_view(curve, length) @ fit[half]
    out[:half] = fit[:half] @ curve[:length]
    out[len(curve) - half :] = fit[length - half :] @ curve[-length:]
    return out


def topic_borders(curve: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Places of minima of the curve that are as low as its `threshold` quantile, and that lie at least `tolerance` of its range under the
    highest values between them and the minima beside them. Of equal neighbours the first one counts."""
    if len(curve) < 3:
        return np.zeros(0, np.int64)
    keep = np.flatnonzero(np.concatenate([[True], curve[1:] != curve[:-1]]))
    level = curve[keep]
    low = np.flatnonzero((level[1:-1] < level[:-2]) & (level[1:-1] < level[2:])) + 1
    if not len(low):
        return np.zeros(0, np.int64)
    edges = np.concatenate([[0], low])
    before = np.maximum.reduceat(level, edges)[:-1] if len(edges) > 1 else level[:1]
    after = np.maximum.reduceat(level, low)
    before = np.maximum(before, level[np.maximum(low - 1, 0)])
    spare = tolerance * (level.max() - level.min())
    fine = (np.minimum(before, after) - level[low] >= spare) & (level[low] <= np.quantile(curve, threshold))
    return keep[low[fine]]


def _sliced(text: str, most: int) -> list[str]:
    """A text of any number of words in runs of at most `most`, cut before a word."""
    starts = [m.start() for m in _WORD.finditer(text)][most::most]
    return [text[a:b] for a, b in zip([0, *starts], [*starts, len(text)], strict=True)]


def _gathered(pieces: list[str], sizes: list[int], target: int, most: int) -> list[str]:
    """Neighbouring pieces together while they have at most `target` words; a piece over `most` is sliced."""
    out: list[str] = []
    now: list[str] = []
    n = 0
    for piece, own in zip(pieces, sizes, strict=True):
        if now and n + own > target:
            out.append("".join(now))
            now, n = [], 0
        if own > most:
            *full, rest = _sliced(piece, most)
            out += full
            now, n = [rest], len(_WORD.findall(rest))
        else:
            now.append(piece)
            n += own
    if now:
        out.append("".join(now))
    return out


def by_topic(text: str | None, target: int = CHUNK_TOKENS, most: int = HARD_TOKENS, threshold: float = THRESHOLD) -> list[str] | None:
    """A text cut where its topic changes: where sentences before and after have the least words in common, on a smoothed curve. What is
    still over `target` words is cut between sentences, and a sentence over `most` before a word."""
    if text is None:
        return None
    found = sentences(text)
    cuts = (topic_borders(smoothed(similarities(found)), threshold) + 1).tolist()
    out: list[str] = []
    for a, b in zip([0, *cuts], [*cuts, len(found)], strict=True):
        out += _gathered(found[a:b], [len(_WORD.findall(s)) for s in found[a:b]], target, most)
    return out


#: Texts whose chunks are Python's at once; those before are Arrow's, which takes a fraction.
SLICE = 64


def _in_slices(rows: int, chunks: Callable[[int, int], list]) -> pa.Array:
    """What chunks(start, number) gives for all rows of a batch."""
    kind = pa.list_(pa.string())
    parts = [pa.array(chunks(a, min(SLICE, rows - a)), kind) for a in range(0, rows, SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def topic_chunks(text: Column, target: int = CHUNK_TOKENS, most: int = HARD_TOKENS, threshold: float = THRESHOLD) -> Column:
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return _in_slices(len(texts), lambda a, n: [by_topic(t, target, most, threshold) for t in texts.slice(a, n).to_pylist()])

    return run(text)


_STRINGS = r"'''.*?'''" + r'|""".*?"""' + r"|'(?:\\.|[^'\\\n])*'" + r'|"(?:\\.|[^"\\\n])*"'
#: What the reader of code must know of it, by the family of its comments.
_MARKS = {
    "hash": re.compile(_STRINGS + r"|#[^\n]*|[\[\](){}]|\n", re.S),
    "slash": re.compile(_STRINGS + r"|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|[\[\](){}]|\n", re.S),
}
_HASH = {"py", "rb", "sh", "bash", "yaml", "yml", "toml", "r", "pl", "ps1", "ex", "exs", "jl"}
#: Lines that go on with what the line before them at their depth began, and lines that belong to the next one.
_GOES_ON = re.compile(r"[\])}]|(?:else|elif|except|finally|catch|case|default|end|then|rescue|ensure)\b")
_LEADS = re.compile(r"@|#\[|#|//|/\*|\*")
_DEEPEST = 100


def family(extension: str) -> str:
    return "hash" if extension.lower().lstrip(".") in _HASH else "slash"


def line_levels(code: str, kind: str) -> tuple[list[int], list[tuple[int, int] | None]]:
    """(start of each line, its level): open brackets at its start, then its indentation; None where no chunk may begin: inside a string or a comment, at
    a line that goes on with another, and after one that leads to it. Brackets in strings and comments do not count."""
    starts, depth, inside = [0], [0], [False]
    open_now = 0
    for m in _MARKS[kind].finditer(code):
        mark = m.group()
        if mark == "\n":
            starts.append(m.end())
            depth.append(open_now)
            inside.append(False)
        elif mark in "([{":
            open_now += 1
        elif mark in ")]}":
            open_now = max(open_now - 1, 0)
        else:
            at = mark.find("\n")
            while at >= 0:
                starts.append(m.start() + at + 1)
                depth.append(open_now)
                inside.append(True)
                at = mark.find("\n", at + 1)
    levels: list[tuple[int, int] | None] = []
    leads = False
    ends = [*starts[1:], len(code)]
    for start, end, own, hidden in zip(starts, ends, depth, inside, strict=True):
        bare = code[start:end].strip()
        indent = len(code[start:end]) - len(code[start:end].lstrip(" \t"))
        if hidden or not bare or leads or _GOES_ON.match(bare):
            levels.append(None)
        else:
            levels.append((own, indent))
        leads = (leads and not bare) or (bool(bare) and not hidden and _LEADS.match(bare) is not None)
    return starts, levels


def by_structure(code: str | None, kind: str = "slash", target: int = CODE_TOKENS, most: int = HARD_TOKENS) -> list[str] | None:
    """Code in chunks of whole definitions. What has more than `target` words is cut between its outermost parts, those again between theirs;
    neighbouring parts go together while they fit. A part of one line is sliced only if it has over `most` words."""
    if code is None:
        return None
    starts, levels = line_levels(code, kind)
    ends = [*starts[1:], len(code)]
    sizes = [len(_WORD.findall(code[a:b])) for a, b in zip(starts, ends, strict=True)]
    total = [0, *np.cumsum(sizes).tolist()]

    def parts(lo: int, hi: int, deep: int) -> list[tuple[int, int]]:
        if total[hi] - total[lo] <= target:
            return [(lo, hi)]
        inner = [levels[k] for k in range(lo + 1, hi) if levels[k] is not None]
        if not inner or deep > _DEEPEST:
            return [(k, k + 1) for k in range(lo, hi)]
        least = min(inner)
        cuts = [k for k in range(lo + 1, hi) if levels[k] == least]
        found = [x for a, b in zip([lo, *cuts], [*cuts, hi], strict=True) for x in parts(a, b, deep + 1)]
        out = [found[0]]
        for a, b in found[1:]:
            if total[b] - total[out[-1][0]] <= target:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    out: list[str] = []
    for lo, hi in parts(0, len(starts), 0) if code else []:
        piece = code[starts[lo] : ends[hi - 1]]
        out += _sliced(piece, most) if total[hi] - total[lo] > most else [piece]
    return [x for x in out if x]


def structure_chunks(code: Column, extension: Column | str, target: int = CODE_TOKENS, most: int = HARD_TOKENS) -> Column:
    """Chunks of code; the extension tells how its comments begin."""

    @F.arrow_udf("array<string>")
    def run(codes: pa.Array, extensions: pa.Array) -> pa.Array:
        pairs = lambda a, n: zip(codes.slice(a, n).to_pylist(), extensions.slice(a, n).to_pylist(), strict=True)
        return _in_slices(len(codes), lambda a, n: [by_structure(c, family(e or ""), target, most) for c, e in pairs(a, n)])

    return run(code, F.lit(extension) if isinstance(extension, str) else extension)
