"""Toxicity by a classifier chain (operator 3).

The categories of a label table, any number of 0/1 columns in the order given, are predicted one after another: each
link is a sparse linear model over the words of the whole text (and word beginnings), and gets the probabilities of the
earlier links as features. While learning, those come out of fold, as they will be at prediction: the model that makes
them has not seen the row. The supplied labels hold one toxicity category; the registered query puts low quality, which
goes along with it, before it.

Learning takes a bounded sample: at most `per_class` labelled documents with and as many without the last
category, chosen by a hash of their id, with at most `SAMPLE_BYTES` of features (the numbers of distinct words) a class; very
long labelled texts, of more than a 64th of that, are not learned from. Prediction reads
every document once, holds nothing but the model, and shuffles nothing.

Defined cases: a null or wordless text has the intercepts' probabilities; a document without a label of a category is
left out of that link's learning, and one without a label of the last category out of the sample; of contradictory labels
the larger counts; with only one class in the labels, its share is predicted; repeated rows are judged alike;
an empty table gives an empty result; further columns of the input are kept by `score_chain`.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import enter, read, slices

PER_CLASS = 2500
#: Most bytes of packed features that are learned from in a class: 8 a distinct feature of a document.
SAMPLE_BYTES = 128 << 20
FOLDS = 3
MIN_DOCUMENTS = 3
THRESHOLD = 0.3
#: Least score-test statistic of a feature.
LEAST_Z = 3.5
CHAIN = ["low_quality", "toxic"]
#: Words whose weights a task keeps.
KEPT_WORDS = 150_000
_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5, 6)


_SPACE = (1 << 24) - 1


def word_features(word: str) -> list[int]:
    """Numbers of the word and of its beginnings, hashed into 2**24."""
    return [zlib.crc32(f.encode()) & _SPACE for f in (word, *("^" + word[:k] for k in _BEGINNINGS if len(word) > k))]


def text_features(text: str | None) -> dict[int, int]:
    out: dict[int, int] = {}
    for word, n in text_words(text).items():
        for f in word_features(word):
            out[f] = out.get(f, 0) + n
    return out


def text_words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


@dataclass
class Link:
    """One linear model: weights by feature, weights of earlier probabilities, intercept."""

    name: str
    weights: dict[int, float]
    earlier: list[float]
    intercept: float


@dataclass
class Chain:
    links: list[Link]
    _by_word: dict[str, tuple] = field(default_factory=dict)

    def _hits(self, word: str) -> tuple:
        got = tuple((i, f, link.weights[f]) for i, link in enumerate(self.links) for f in word_features(word) if f in link.weights)
        if len(self._by_word) >= KEPT_WORDS:
            self._by_word.clear()
        self._by_word[word] = got
        return got

    def probabilities(self, text: str | None) -> list[float]:
        words = text_words(text)
        seen: dict[tuple[int, int], list] = {}
        known = self._by_word
        for word, n in words.items():
            hits = known.get(word)
            if hits is None:
                hits = self._hits(word)
            for i, f, w in hits:
                if (i, f) in seen:
                    seen[i, f][0] += n
                else:
                    seen[i, f] = [n, w]
        sums = [0.0] * len(self.links)
        for (i, _), (n, w) in sorted(seen.items()):
            sums[i] += w * value(n)
        out: list[float] = []
        for link, s in zip(self.links, sums, strict=True):
            z = link.intercept + s + sum(w * logit(p) for w, p in zip(link.earlier, out, strict=True))
            out.append(sigmoid(z))
        return out


def value(n: float) -> float:
    """A feature's value: present, a little more when repeated (as in train_chain)."""
    return min(1.0 + 0.25 * (n - 1), 2.0)


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


def logit(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return float(np.log(p / (1 - p)))


def fit_sparse(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, d: int, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, l1: float, steps: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted logistic regression with an l1 penalty on sparse weights, by accelerated proximal steps.

    Features whose score test against the constant model is weak stay out.
    """
    total, k = max(weight.sum(), 1e-9), dense.shape[1]
    share = min(max(float(weight @ y) / total, 0.5 / n), 1 - 0.5 / n)
    gain = np.bincount(cols, vals * (weight * (y - share))[rows], d)
    spread = np.sqrt(np.bincount(cols, vals**2 * (weight**2)[rows], d) * share * (1 - share))
    kept = np.abs(gain) > LEAST_Z * np.maximum(spread, 1e-12)
    pick = kept[cols]
    number = np.cumsum(kept) - 1
    rows, cols, vals, m = rows[pick], number[cols[pick]], vals[pick], int(kept.sum())
    x0 = np.column_stack([dense, np.ones(n)])
    w, v = np.zeros(m), np.zeros(k + 1)
    v[k] = np.log(share / (1 - share))
    zw, zv, t = w.copy(), v.copy(), 1.0
    # Diagonal steps: with row sums as weights they bound the curvature of all directions at once.
    reach = np.bincount(rows, vals, n) + np.abs(x0).sum(axis=1)
    step_w = 1 / np.maximum(0.25 * np.bincount(cols, vals * (weight * reach)[rows], m) / total, 1e-9)
    step_v = 1 / np.maximum(0.25 * (np.abs(x0).T @ (weight * reach)) / total, 1e-9)
    for _ in range(steps):
        z = np.bincount(rows, vals * zw[cols], n) + x0 @ zv
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        raw = zw - step_w * np.bincount(cols, vals * r[rows], m)
        w2 = np.sign(raw) * np.maximum(np.abs(raw) - step_w * l1, 0)
        v2 = zv - step_v * (x0.T @ r)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zv = w2 + (t - 1) / t2 * (w2 - w), v2 + (t - 1) / t2 * (v2 - v)
        w, v, t = w2, v2, t2
    full = np.zeros(d)
    full[np.flatnonzero(kept)] = w
    return full, v[:k], float(v[k])


def train_chain(found: list[bytes], ids: list[int], labels: dict[str, np.ndarray], weight: np.ndarray, l1: float = 0.0002) -> Chain:
    """The chain over documents given as packed features (see pack); labels by category in chain order."""
    n = len(found)
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids])
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(x) // 8 for x in found])
    both = np.frombuffer(b"".join(found), np.int32).reshape(-1, 2)
    names, cols, seen = np.unique(both[:, 0], return_inverse=True, return_counts=True)
    often = (seen >= MIN_DOCUMENTS)[cols]
    rows, vals = rows[often], np.minimum(1.0 + 0.25 * (both[often, 1] - 1), 2.0)
    cols = (np.cumsum(seen >= MIN_DOCUMENTS) - 1)[cols[often]]
    names = names[seen >= MIN_DOCUMENTS].tolist()
    links, earlier = [], np.zeros((n, 0))
    everyone = weight
    for name, y in labels.items():
        # Documents without a label of this category have no say in it, but a probability for the next links.
        weight = np.where(np.isnan(y), 0.0, everyone)
        y = np.where(np.isnan(y), 0.0, y)
        w, v, b = fit_sparse(rows, cols, vals, n, len(names), earlier, y, weight, l1)
        links.append(Link(name, {names[i]: float(w[i]) for i in np.flatnonzero(w)}, [float(x) for x in v], float(b)))
        if len(links) < len(labels):
            out = np.zeros(n)
            for k in range(FOLDS):
                learn, use = fold != k, fold == k
                if not use.any():
                    continue
                if not weight[learn].any():
                    learn = ~learn
                pick = learn[rows]
                renumber = np.cumsum(learn) - 1
                fw, fv, fb = fit_sparse(renumber[rows[pick]], cols[pick], vals[pick], int(learn.sum()), len(names), earlier[learn], y[learn], weight[learn], l1)
                z = np.bincount(rows, vals * fw[cols], n) + earlier @ fv + fb
                out[use] = 1 / (1 + np.exp(-np.clip(z[use], -30, 30)))
            out = np.clip(out, 1e-3, 1 - 1e-3)
            earlier = np.column_stack([earlier, np.log(out / (1 - out))])
    return Chain(links)


def pack(features: dict[int, int]) -> bytes:
    """Feature numbers and counts as pairs of 32-bit integers."""
    return np.array(sorted(features.items()), np.int32).tobytes()


def quality_and_toxicity(labels: DataFrame) -> DataFrame:
    """The supplied labels as 0/1 categories in the order of `CHAIN`; a null stays null."""
    return labels.select("doc_id", (1 - F.col("quality")).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))


def labelled_sample(docs: DataFrame, labels: DataFrame, chain: Sequence[str], per_class: int, most_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """Features and labels of the sampled documents, one row an id; at most 2 * per_class rows and 2 * most_bytes of features reach the driver.

    Within a class, documents are taken in the order of a hash of their id while their features fit; those whose features
    alone take over a 64th of most_bytes are passed over in learning, so at least 64 documents of a class fit.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(3))
    sides = [labels.where(F.col(chain[-1]) == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    picked = F.broadcast(sides[0].unionByName(sides[1]))

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("toxicity")
        for part in it:
            part["features"] = [pack(text_features(t)) for t in part["text"]]
            yield part[["doc_id", *chain, "features"]]

    schema = "doc_id long, " + ", ".join(f"{c} double" for c in chain) + ", features binary"
    joined = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "text", *[F.col(c).cast("double").alias(c) for c in chain])
    # Rows that share an id count once, by the least of their features.
    one = joined.mapInPandas(counted, schema).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in chain], F.min("features").alias("features"))
    size = F.length("features")
    small = one.where(size <= most_bytes // 64).withColumn("_order", order)
    # At most per_class rows a window.
    running = F.sum(size).over(Window.partitionBy(chain[-1]).orderBy("_order", "doc_id"))
    return small.withColumn("_bytes", running).where(F.col("_bytes") <= most_bytes).drop("_order", "_bytes").toPandas()


def learn(docs: DataFrame, labels: DataFrame, chain: Sequence[str] | None = None, per_class: int = PER_CLASS) -> Chain:
    """A chain from documents and labels: doc_id and a 0/1 column for each category, the last of which is sampled by class.

    Without names, labels is the supplied table (doc_id, quality, toxic) and the chain `CHAIN`. Where a document has several labels of a category, the larger counts.
    """
    if chain is None:
        labels, chain = quality_and_toxicity(labels), CHAIN
    known = labels.where(F.col("doc_id").isNotNull()).select("doc_id", *[F.when(F.col(c).isin(0, 1), F.col(c)).alias(c) for c in chain])
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in chain]).where(F.col(chain[-1]).isNotNull())
    totals = {r[0]: r["count"] for r in known.groupBy(chain[-1]).count().collect()}
    got = labelled_sample(docs, known, chain, per_class).sort_values("doc_id", kind="stable")
    if not len(got):
        return Chain([Link(c, {}, [0.0] * i, -5.0) for i, c in enumerate(chain)])
    y = got[chain[-1]].to_numpy()
    taken = {v: max(int((y == v).sum()), 1) for v in (0, 1)}
    # The sample holds the classes in other shares than the labels; weights put that right.
    weight = np.array([totals.get(v, 0) / taken[v] for v in y], float)
    return train_chain(got["features"].tolist(), got["doc_id"].tolist(), {c: got[c].to_numpy(float) for c in chain}, weight / weight.mean())


def score_chain(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `p_<category>` for each link and `is_toxic` by the last one."""
    names = [f"p_{x.name}" for x in chain.links]

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def predict(texts: pa.Array) -> pa.Array:
        enter("toxicity")
        rows = np.array([chain.probabilities(t) for part in slices(texts) for t in part]).reshape(-1, len(names)).round(6)
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(names))], names)

    out = docs.drop(*names, "is_toxic").withColumn("_p", predict("text"))
    return out.select("*", *[F.col(f"_p.{n}") for n in names]).drop("_p").withColumn("is_toxic", F.col(names[-1]) >= threshold)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = learn(docs, read(spark, sf_dir, "labels"))
    return score_chain(docs, chain).select("doc_id", "is_toxic", F.col("p_toxic"), "p_low_quality")
