"""Substring deduplication on suffix arrays (operator 13).

A byte is removed if a string of `length` bytes that covers it also starts earlier: in a document with a smaller id, or
before in the same document. The suffixes of what may recur are sorted by a linear, non-recursive grouping:

1. Every suffix gets its longest Lyndon prefix; it ends at the next smaller suffix, and the prefixes inside it hang below it
   by previous-smaller pointers (`lyndon_words`). Suffixes with the same prefix are one group.
2. Groups are put in order from the greatest down (`group_order`). A group that is done moves the groups of the words in
   which it is the next part to the place just above those in which it is not; each part of each word is looked at once.
3. From the smallest suffix up, each suffix hands its place on to those that end where it begins (`suffix_order`), so
   the order inside all groups comes out in one more pass, and nothing is named anew or sorted again.

Equal strings of `length` bytes are neighbours in that order. So that no task sees the whole corpus, windows are dealt by their
anchor, the 56 bytes in them (for 100) whose hash is least: equal windows have equal anchors. Neighbouring windows
with one anchor travel as one segment of at most 144 bytes, and only if their anchor is in several documents:

- A block of documents sends each of its anchors once; those found in several documents anywhere come back.
- A block sends the segments of such anchors, each different one once with its smallest and largest document. An
  anchor with very many segments is dealt by the windows themselves.
- Each task sorts the suffixes of the segments of its anchors and finds the smallest document of every window. (An anchor
  with one segment in the whole corpus has nothing to be compared with: its windows' smallest document is the segment's.)
- What the segments of a block learn comes back to it. Repeats inside one document are found there, by the same order, among windows
  that have an anchor and a hash in common with another one of their document.

All comparisons that decide are of bytes; a segment meets its answer by two 64-bit hashes at once.

Defined cases: a null or empty text has no bytes; texts of fewer than `length` bytes lose nothing; rows with a null id
lose nothing and make others lose nothing; rows that share an id count each as a document, none before the other; a very long
text makes its block as much larger; an empty table gives an empty result; all other columns are kept, and `n_bytes`,
`kept_bytes` and `removed` are replaced if present.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, as_array, enter, mix, read, stored

LENGTH = 100
#: A table is cut into BLOCKS blocks, but none smaller than LEAST_BLOCK or larger than MOST_BLOCK bytes of text.
BLOCKS = 1024
LEAST_BLOCK, MOST_BLOCK = 1 << 20, 4 << 20
#: Anchors with more segments than this are dealt by windows.
HOT_SEGMENTS = 20_000
#: Bytes whose suffixes are sorted together, if one anchor has no more.
SORTED_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Windows whose anchors are searched at once; a place among them fits the low bits of a key.
_STRETCH, _PLACE = 1 << 17, np.uint64((1 << 18) - 1)


class Words:
    """The Lyndon words of some texts, in a table of one row a text; the column after a text's last byte is its end.

    `ends` is the place of each suffix's next smaller one, `previous` the nearest earlier place that begins a smaller suffix (-1
    without one), `word` the number of its Lyndon word. A row's places are walked from right to left, all rows at once.
    Word w begins with the byte `first[w]`; its parts after that are `part[at[w]:at[w + 1]]`, each `times[...]` times in a row.
    """

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.width = int(self.sizes.max(initial=0)) + 1
        n, width = len(texts), self.width
        raw = np.zeros((n, width + 8), np.uint8)
        inside = np.arange(width + 8) < self.sizes[:, None]
        raw[inside] = as_array(b"".join(texts))
        self.raw = raw
        # Eight bytes from each place on, as a number that compares as they do.
        self.eight = np.zeros((n, width), np.uint64)
        for k in range(8):
            self.eight |= raw[:, k : k + width].astype(np.uint64) << np.uint64(56 - 8 * k)
        self._walk(n, width)
        self._number(raw[:, :width], inside[:, :width])

    def _walk(self, n: int, width: int) -> None:
        flat = self.eight.ravel()
        self.ends = ends = np.zeros(n * width, np.int64)
        self.previous = previous = np.full(n * width, -1, np.int64)
        base = np.arange(n, dtype=np.int64) * width
        self.stops = stops = base + self.sizes
        for i in range(width - 2, -1, -1):
            row = np.flatnonzero(self.sizes > i)
            own, stop = base[row] + i, stops[row]
            j = own + 1
            todo = np.flatnonzero(j < stop)
            while len(todo):
                # The suffix at j is shorter, so that where both are equal to its end it is the smaller one.
                a, b, end = own[todo], j[todo], stop[todo]
                greater = flat[b] > flat[a]
                same = np.flatnonzero(flat[b] == flat[a])
                step = 8
                while len(same):
                    same = same[b[same] + step < end[same]]
                    x, y = flat[a[same] + step], flat[b[same] + step]
                    greater[same] = y > x
                    same = same[x == y]
                    step += 8
                todo = todo[greater]
                past = j[todo]
                previous[past] = own[todo]
                j[todo] = ends[past]
                todo = todo[j[todo] < stop[todo]]
            ends[own] = j

    def _number(self, raw: np.ndarray, inside: np.ndarray) -> None:
        n, width = raw.shape
        up, down = np.ones(width + 1, np.uint64), np.ones(width + 1, np.uint64)
        up[1:], down[1:] = _BASE, pow(_BASE, -1, 2**64)
        up, down = np.cumprod(up), np.cumprod(down)
        total = np.zeros((n, width + 1), np.uint64)
        np.cumsum(_BYTE[raw] * up[:width], axis=1, out=total[:, 1:])
        place = np.flatnonzero(inside.ravel())
        row, i = np.divmod(place, width)
        j = self.ends[place] - row * width
        hashes = mix((total[row, j] - total[row, i]) * down[i] ^ (j - i).astype(np.uint64))
        _, at, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.place = place
        self.word = np.full(n * width, -1, np.int64)
        self.word[place] = number
        self.first = raw.ravel()[place[at]]
        # The parts of each word, from one place where it stands.
        whose, which, at_once = [], [], np.arange(len(at))
        k, stop = place[at] + 1, self.ends[place[at]]
        while len(at_once):
            going = k < stop
            at_once, k, stop = at_once[going], k[going], stop[going]
            whose.append(at_once)
            which.append(self.word[k])
            k = self.ends[k]
        whose, which = np.concatenate(whose or [at]), np.concatenate(which or [at])
        order = np.argsort(whose, kind="stable")
        whose, which = whose[order], which[order]
        new = np.ones(len(whose), bool)
        new[1:] = (whose[1:] != whose[:-1]) | (which[1:] != which[:-1])
        begin = np.flatnonzero(new)
        self.part, self.times = which[begin], np.diff(np.append(begin, len(whose)))
        self.at = np.searchsorted(whose[begin], np.arange(len(at) + 1))


def group_order(first: np.ndarray, part: np.ndarray, times: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rank of each distinct Lyndon word, 0 for the least (see Words). Groups begin as all words with one first byte."""
    count = len(first)
    values, group = np.unique(first, return_inverse=True)
    group, m = group.astype(np.int64), len(values)
    size = np.bincount(group, minlength=m).tolist()  # words in each group, the sum of their numbers, the group below, the one above
    held = np.zeros(m, np.int64)
    np.add.at(held, group, np.arange(count))
    held, below, above = held.tolist(), [*range(-1, m - 1)], [*range(1, m + 1)]
    group, part, times, last = group.tolist(), part.tolist(), times.tolist(), at[1:].tolist()
    at = at[:-1].tolist()
    waiting: list[list[int]] = [[] for _ in range(count)]
    for w in range(count):
        if at[w] < last[w]:
            waiting[part[at[w]]].append(w)
    rank, todo, top = [0] * count, count, m - 1

    def lifted(g: int) -> int:
        new, over = len(size), above[g]
        size.append(0)
        held.append(0)
        below.append(g)
        above.append(over)
        if over < new:
            below[over] = new
        above[g] = new
        return new

    # The group above the highest one is never read: it is done.
    above[m - 1:] = [1 << 62]
    while top >= 0:
        w = held[top]  # all parts of its words are done, so one word is left in it
        todo -= 1
        rank[w] = todo
        found = ready = waiting[w]
        if len(ready) == 1:
            p = ready[0]
            g = group[p]
            if size[g] > 1:
                new = lifted(g)
                size[g] -= 1
                held[g] -= p
                size[new], held[new], group[p] = 1, p, new
            at[p] += 1
            if at[p] < last[p]:
                waiting[part[at[p]]].append(p)
        elif ready:
            level = 0
            while ready:
                level += 1
                here = Counter([group[p] for p in ready])
                made = {g: lifted(g) for g, k in here.items() if k < size[g]}
                if made:
                    for p in ready:
                        g = group[p]
                        new = made.get(g)
                        if new is not None:  # else the whole group goes on
                            size[g] -= 1
                            held[g] -= p
                            size[new] += 1
                            held[new] += p
                            group[p] = new
                ready = [p for p in ready if times[at[p]] > level]
            for p in found:
                at[p] += 1
                if at[p] < last[p]:
                    waiting[part[at[p]]].append(p)
        waiting[w] = ()
        top = below[top]
    return np.array(rank, np.int64)


def suffix_order(words: Words) -> np.ndarray:
    """Places of all suffixes, in ascending order. What ends is less than what goes on; equal suffixes come in any order."""
    rank = group_order(words.first, words.part, words.times, words.at)
    ends, previous, place = words.ends, words.previous, words.place
    group = np.zeros(len(ends), np.int64)
    group[place] = rank[words.word[place]]
    front = np.concatenate([[0], np.cumsum(np.bincount(group[place], minlength=len(rank)))[:-1]]) if len(rank) else np.zeros(0, np.int64)
    # head[q]: the last place whose next smaller suffix is q; after it come its previous smaller ones, while they end there too.
    head = np.full(len(ends) + 1, -1, np.int64)
    head[place + 1] = np.where(ends[place] == place + 1, place, -1)
    after = previous.copy()
    after[place[(previous[place] < 0) | (ends[previous[place]] != ends[place])]] = -1
    head, after, group, front = head.tolist(), after.tolist(), group.tolist(), front.tolist()
    order = [0] * len(place)
    for q in chain(words.stops[words.sizes > 0].tolist(), order):  # which is filled before it is read
        p = head[q]
        while p >= 0:
            g = group[p]
            f = front[g]
            order[f] = p
            front[g] = f + 1
            p = after[p]
    return np.array(order, np.int64)


def equal_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, class) of all strings of `length` bytes in the texts; equal ones have one class. By class."""
    words = Words(texts)
    order = suffix_order(words)
    text, offset = np.divmod(order, words.width)
    fits = offset + length <= words.sizes[text]
    order, text, offset = order[fits], text[fits], offset[fits]
    flat = words.eight.ravel()
    same = np.arange(1, len(order))
    for step in [*range(0, length - 8, 8), length - 8] if length >= 8 else []:
        same = same[flat[order[same] + step] == flat[order[same - 1] + step]]
    if length < 8:
        same = same[flat[order[same]] >> np.uint64(64 - 8 * length) == flat[order[same - 1]] >> np.uint64(64 - 8 * length)]
    new = np.ones(len(order), bool)
    new[same] = False
    return text, offset, np.cumsum(new) - 1


def grams(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n bytes, whose high bits are the best."""
    own = _BYTE[raw]
    out, have, power = own, 1, _BASE
    for bit in bin(n)[3:]:
        out = out[: len(out) - have] * np.uint64(power) + out[have:]
        have, power = 2 * have, power * power % 2**64
        if bit == "1":
            out = out[:-1] * np.uint64(_BASE) + own[have : have + len(out) - 1]
            have, power = have + 1, power * _BASE % 2**64
    return out * _SPREAD


class Block:
    """Documents as one run of bytes, and their windows in stretches of one anchor: first window, number of windows, anchor, document."""

    def __init__(self, ids: list[int], texts: list[bytes], length: int):
        enter("suffixes")
        self.length, self.ids, self.texts = length, ids, texts
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        self.raw = b"".join(texts)
        found = [self._stretches(a, as_array(self.raw[a : a + _STRETCH + length - 1])) for a in range(0, max(len(self.raw) - length + 1, 0), _STRETCH)]
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64)]
        start, count, anchor = parts
        doc = np.searchsorted(self.begin, start, "right") - 1
        inside = start + length <= self.begin[doc + 1]
        self.start, self.count, self.anchor, self.doc = start[inside], count[inside], anchor[inside], doc[inside]

    def _stretches(self, base: int, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gram = max(1, self.length * 56 // 100)
        hashes = grams(raw, gram)
        # The first of the least hashes, and its place, in one number.
        least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        width, have = self.length - gram + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        lo, hi = np.searchsorted(self.begin, [base, base + len(least)])
        edge = self.begin[lo:hi]
        edges = np.concatenate([edge, edge - self.length + 1]) - base
        cut = np.union1d(np.append(cut, 0), edges[(edges > 0) & (edges < len(least))])
        return cut + base, np.diff(np.append(cut, len(least))), mix(hashes[(least[cut] & _PLACE).astype(np.int64)])

    def segment(self, k: int) -> bytes:
        return self.raw[self.start[k] : self.start[k] + self.count[k] + self.length - 1]

    def _with(self, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> Block:
        out = object.__new__(Block)
        out.length, out.ids, out.texts, out.begin, out.raw = self.length, self.ids, self.texts, self.begin, self.raw
        out.start, out.count, out.anchor, out.doc = start, count, anchor, doc
        return out

    def recurring(self) -> Block:
        """The stretches that may repeat something of their own document, by document and anchor: those whose anchor is there twice, and of them
        the windows whose hash is there twice. Equal windows have equal anchors and hashes, so none is left out."""
        order = np.lexsort((self.start, self.anchor, self.doc))
        doc, anchor = self.doc[order], self.anchor[order]
        pick = order[_doubled((doc[1:] == doc[:-1]) & (anchor[1:] == anchor[:-1]), len(order))]
        count = self.count[pick]
        of = np.repeat(np.arange(len(pick)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.start[pick][of]
        if not len(place):
            return self._with(place, place, self.anchor[:0], place)
        raw = as_array(self.raw)
        whole = np.concatenate([grams(raw[a : a + _STRETCH + self.length - 1], self.length) for a in range(0, len(raw) - self.length + 1, _STRETCH)])
        key = mix(whole[place] ^ mix(self.doc[pick][of].astype(np.uint64)))
        by_key = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[by_key[_doubled(key[by_key][1:] == key[by_key][:-1], len(key))]] = True
        place, of = place[again], of[again]
        first = np.ones(len(place), bool)
        first[1:] = (np.diff(place) != 1) | (np.diff(of) != 0)
        at = np.flatnonzero(first)
        return self._with(place[at], np.diff(np.append(at, len(place))), self.anchor[pick][of[at]], self.doc[pick][of[at]])

    def alone(self, pick: np.ndarray) -> Block:
        """The windows of some stretches, each as a stretch and its own anchor."""
        count = self.count[pick]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(self.start[pick], count) + step
        anchor = np.array([xxhash.xxh3_64_intdigest(self.raw[s : s + self.length]) for s in start.tolist()], np.uint64)
        return self._with(start, np.ones(len(step), np.int64), anchor, np.repeat(self.doc[pick], count))


def _doubled(same: np.ndarray, n: int) -> np.ndarray:
    """Which of n sorted values have an equal neighbour; `same` compares each with the one before."""
    out = np.zeros(n, bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _seal(segment: bytes) -> int:
    return xxhash.xxh3_64_intdigest(segment, 1) - 2**63


def least_documents(found: list[tuple[bytes, int]], length: int) -> list[tuple[list[int], list[int]]]:
    """For each (segment, its smallest document), where a window's smallest document changes, and to which."""
    text, offset, same = equal_windows([s for s, _ in found], length)
    own = np.array([d for _, d in found], np.int64)
    cut = np.flatnonzero(np.diff(same, prepend=-1))
    least = np.minimum.reduceat(own[text], cut)[same] if len(cut) else own[:0]
    order = np.lexsort((offset, text))
    text, offset, least = text[order], offset[order], least[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
    at = np.flatnonzero(new)
    bounds = np.searchsorted(text[at], np.arange(len(found) + 1)).tolist()
    steps, docs = offset[at].tolist(), least[at].tolist()
    return [(steps[a:b], docs[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def _compared(rows: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Segments by anchor, as they come: what their windows' smallest documents are."""
    enter("suffixes")
    kinds = pa.schema([("g", pa.int64()), ("s", pa.int64()), ("at", pa.list_(pa.int32())), ("d", pa.list_(pa.int64()))])

    def settled(some: list[tuple[int, int, bytes, int, int]]) -> pa.RecordBatch:
        times = Counter([x[0] for x in some])
        one = [x for x in some if times[x[0]] == 1 and x[3] < x[4]]
        several = [x for x in some if times[x[0]] > 1]
        told = least_documents([(x[2], x[3]) for x in several], length) if several else []
        # Where no document that has the segment is larger than a window's smallest one, nobody needs to know.
        out = [(x[0], x[1], [0], [x[3]]) for x in one] + [(x[0], x[1], *t) for x, t in zip(several, told, strict=True) if min(t[1]) < x[4]]
        return pa.record_batch([pa.array([x[k] for x in out], f.type) for k, f in enumerate(kinds)], schema=kinds)

    some: list[tuple[int, int, bytes, int, int]] = []
    size = 0
    for batch in rows:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("g", "s", "segment", "lo", "hi")), strict=True):
            if size >= SORTED_BYTES and row[0] != some[-1][0]:
                yield settled(some)
                some, size = [], 0
            some.append(row)
            size += len(row[2])
    if some:
        yield settled(some)


def repeats_inside(block: Block) -> list[tuple[int, int]]:
    """Runs (from, to) of places of windows that also start earlier in their document."""
    block = block.recurring()
    out: list[tuple[int, int]] = []

    def compared(some: list[tuple[bytes, int, int]]) -> None:
        text, offset, same = equal_windows([t for t, _, _ in some], block.length)
        doc, place = np.array([d for _, _, d in some], np.int64)[text], np.array([s for _, s, _ in some], np.int64)[text] + offset
        order = np.lexsort((place, doc, same))
        again = np.zeros(len(order), bool)
        again[1:] = (same[order][1:] == same[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (place[order][1:] > place[order][:-1])
        out.extend((x, x + 1) for x in place[order][again].tolist())

    group: list[tuple[bytes, int, int]] = []
    own: list[tuple[bytes, int, int]] = []  # of one document and anchor, each segment once
    size, last = 0, None
    seen: set[bytes] = set()
    columns = (block.doc, block.anchor, block.start, block.count)
    for doc, anchor, start, count in zip(*(c.tolist() for c in columns), strict=True):
        if (doc, anchor) != last:
            if len(own) > 1:  # one segment has nothing to be compared with
                group += own
                size += sum(len(x[0]) for x in own)
                if size >= SORTED_BYTES:
                    compared(group)
                    group, size = [], 0
            own, seen, last = [], set(), (doc, anchor)
        segment = block.raw[start : start + count + block.length - 1]
        if segment in seen:
            out.append((start, start + count))
            continue
        seen.add(segment)
        own.append((segment, start, doc))
    group += own if len(own) > 1 else []
    if group:
        compared(group)
    return out


def _held(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among the ascending values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _column(table: pa.Table, name: str, only: str) -> np.ndarray:
    rows = table.filter(pa.compute.is_valid(table.column(only))) if table.num_rows else table
    return rows.column(name).to_numpy()


def removed_bytes(block: Block, hot: np.ndarray, told: dict[tuple[int, int], tuple[list[int], list[int]]]) -> np.ndarray:
    """The mask of the block's bytes that go: by what is told of its segments, and by what its documents repeat themselves."""
    runs: list[tuple[int, int]] = []
    anchors = np.unique(np.array([g for g, _ in told], np.int64).view(np.uint64))
    split = block.alone(np.flatnonzero(_held(hot, block.anchor))) if len(hot) else None
    for part in [block] + [split] * (split is not None):
        pick = np.flatnonzero(_held(anchors, part.anchor))
        columns = (part.anchor[pick].view(np.int64), part.start[pick], part.count[pick], part.doc[pick])
        for g, start, count, doc in zip(*(c.tolist() for c in columns), strict=True):
            found = told.get((g, _seal(block.raw[start : start + count + block.length - 1])))
            if found is None:
                continue
            own = block.ids[doc]
            for a, b, least in zip(found[0], [*found[0][1:], count], found[1], strict=True):
                if least < own:
                    runs.append((start + a, start + b))
    runs += repeats_inside(block)
    steps = np.zeros(len(block.raw) + 1, np.int32)
    at = np.array(runs, np.int64).reshape(-1, 2)
    np.add.at(steps, at[:, 0], 1)
    np.add.at(steps, at[:, 1] - 1 + block.length, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, block_bytes: int | None = None) -> DataFrame:
    """docs with `n_bytes`, `removed` (array of start and length, in bytes: the maximal runs that go) and `kept_bytes`, the rest joined."""
    every = docs.drop("n_bytes", "removed", "kept_bytes", "_fp", "_block")
    # What is too short, or has no id, is not compared and stays where it is, however many rows that be.
    may = F.coalesce(F.octet_length("text") >= length, F.lit(False)) & F.col("doc_id").isNotNull()
    docs, aside = every.where(may), every.where(~may)
    nothing = F.array().cast("array<struct<start: bigint, length: bigint>>")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    aside = aside.withColumns({"n_bytes": F.octet_length(raw).cast("long"), "removed": nothing, "kept_bytes": raw})
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (block_bytes or min(max(total // BLOCKS, LEAST_BLOCK), MOST_BLOCK))))
    fp, block = F.unhex(F.md5(F.col("text").cast("binary"))), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    texts = docs.withColumns({"_fp": fp, "_block": block})
    marks = docs.select("doc_id", fp.alias("_fp"), block.alias("_block"))
    # Stored, so that the join below has an exchange of its own on each side and one digest's many copies can be split.
    first = stored(marks.groupBy("_fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    copies = stored(marks.join(first, "_fp").where("doc_id > least").select("_block", "doc_id", "_fp").distinct())

    def control(rows: DataFrame | None = None, **columns: str) -> DataFrame:
        """Rows for a block: the copies it need not read, and what `columns` name."""
        own = copies.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items()})
        return own if rows is None else own.unionByName(rows, allowMissingColumns=True)

    def against(other: DataFrame, fn, schema) -> DataFrame:
        return texts.groupBy("_block").cogroup(other.groupBy("_block")).applyInArrow(fn, schema)

    def opened(left: pa.Table, right: pa.Table) -> tuple[Block, list[int], set[int]]:
        """The block's documents but for copies, their rows, and the rows of copies."""
        marked = right.filter(pa.compute.is_valid(right.column("_fp"))) if right.num_rows else right
        skip = set(zip(marked.column("doc_id").to_pylist(), marked.column("_fp").to_pylist(), strict=True))
        ids = left.column("doc_id").to_pylist()
        copied = {k for k, x in enumerate(zip(ids, left.column("_fp").to_pylist(), strict=True)) if x in skip}
        rest = [k for k in range(len(ids)) if k not in copied]
        text = left.column("text").cast(pa.binary()).combine_chunks() if left.num_rows else []
        return Block([ids[k] for k in rest], [text[k].as_py() for k in rest], length), rest, copied

    def anchors(key, left: pa.Table, right: pa.Table) -> pa.Table:
        b = opened(left, right)[0]
        order = np.lexsort((b.doc, b.anchor))
        g, doc = b.anchor[order], np.array(b.ids, np.int64)[b.doc[order]]
        at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(g)))
        several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
        return pa.table({"g": g[at].view(np.int64), "block": np.full(len(at), key[0].as_py(), np.int64), "n": n.astype(np.int32), "several": several})

    def segments(key, left: pa.Table, right: pa.Table) -> pa.Table:
        b = opened(left, right)[0]
        g, hot = _column(right, "g", "g").view(np.uint64), _column(right, "hot", "g").astype(bool)
        split = b.alone(np.flatnonzero(_held(np.sort(g[hot]), b.anchor)))
        found: dict[tuple[int, bytes], list[int]] = {}
        for part, pick in ((b, np.flatnonzero(_held(np.sort(g[~hot]), b.anchor))), (split, np.arange(len(split.start)))):
            for k, anchor, doc in zip(pick.tolist(), part.anchor[pick].view(np.int64).tolist(), part.doc[pick].tolist(), strict=True):
                own = b.ids[doc]
                have = found.setdefault((anchor, part.segment(k)), [own, own])
                have[0], have[1] = min(have[0], own), max(have[1], own)
        n, (of, text) = len(found), list(zip(*found, strict=True)) or ([], [])
        columns = [of, [_seal(t) for t in text], text, [key[0].as_py()] * n, [x[0] for x in found.values()], [x[1] for x in found.values()]]
        return pa.table([pa.array(c, pa.binary() if k == 2 else pa.int64()) for k, c in enumerate(columns)], names=["g", "s", "segment", "block", "lo", "hi"])

    def cleaned(key, left: pa.Table, right: pa.Table) -> pa.Table:
        b, rest, copied = opened(left, right)
        columns = [_column(right, c, "s") for c in ("g", "s", "at", "d")]
        told = {(g, s): (at.tolist(), d.tolist()) for g, s, at, d in zip(*columns, strict=True)}
        mask = removed_bytes(b, np.sort(_column(right, "g", "hot").view(np.uint64)), told)
        size, spans, kept = [0] * left.num_rows, [[]] * left.num_rows, [b""] * left.num_rows
        for k, text, start in zip(rest, b.texts, b.begin.tolist(), strict=False):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[start : start + len(text)].view(np.int8), [0]]))).tolist()
            size[k], spans[k] = len(text), [{"start": x, "length": y - x} for x, y in zip(edge[::2], edge[1::2], strict=True)]
            kept[k] = b"".join([text[x:y] for x, y in zip([0, *edge[1::2]], [*edge[::2], len(text)], strict=True)]) if edge else text
        for k in copied:
            size[k] = len(left.column("text")[k].as_py().encode())
            spans[k] = [{"start": 0, "length": size[k]}]
        out = left.drop_columns(["_fp", "_block"]).append_column("n_bytes", pa.array(size, pa.int64()))
        out = out.append_column("removed", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))))
        return out.append_column("kept_bytes", pa.array(kept, pa.binary()))

    seen = against(control(), anchors, "g long, block long, n int, several boolean")
    same = Window.partitionBy("g")
    twice = seen.withColumns({"all": F.count(F.lit(1)).over(same), "any": F.bool_or("several").over(same), "sum": F.sum("n").over(same)}).where("all > 1 or any")
    twice = stored(twice.select(F.col("block").alias("_block"), "g", (F.col("sum") > HOT_SEGMENTS).alias("hot")))
    sent = stored(against(control(twice, g="long", hot="boolean"), segments, "g long, s long, segment binary, block long, lo long, hi long"))
    each = sent.groupBy("g", "s", "segment").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    told = each.repartition("g").sortWithinPartitions("g").mapInArrow(lambda rows: _compared(rows, length), "g long, s long, at array<int>, d array<long>")
    told = stored(told)
    needed = sent.select("g", "s", "block", "hi").join(told, ["g", "s"]).where(F.array_min("d") < F.col("hi"))
    needed = needed.select(F.col("block").alias("_block"), "g", "s", "at", "d")
    rows = needed.unionByName(twice.where("hot"), allowMissingColumns=True)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_bytes long, removed array<struct<start: bigint, length: bigint>>, kept_bytes binary").fields])
    return against(control(rows, g="long", hot="boolean", s="long", at="array<int>", d="array<long>"), cleaned, schema).unionByName(aside)


def op13_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["length"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


OP13_SQL = f"""
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
p as (select rid, unnest(range(1, length(x) // 2 - {LENGTH - 2})) as i from d where length(x) >= {2 * LENGTH}),
w as (select rid, doc_id, i, substr(x, 2 * i - 1, {2 * LENGTH}) as k from p join d using (rid)),
r as (select rid, i from (select rid, doc_id, i, min(doc_id) over (partition by k) as least, min(i) over (partition by k, rid) as own from w) where least < doc_id or own < i),
n as (select rid, i, (i - lag(i, 1, -1000) over (partition by rid order by i) > {LENGTH})::int as fresh from r),
g as (select rid, i, sum(fresh) over (partition by rid order by i) as island from n),
s as (select rid, min(i) as a, max(i) + {LENGTH - 1} as b from g group by rid, island),
k as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as before from s),
t as (select rid, sum(b - a + 1) as n_removed, count(*) as n_spans, max(b) as last, string_agg(substr(x, 2 * before + 1, 2 * (a - 1 - before)), '' order by a) as kept from k join d using (rid) group by rid)
select doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join t using (rid)
"""
