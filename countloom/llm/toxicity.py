"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Fitting uses a sample of at most about ``per_class`` labelled documents of each
class (chosen by a hash of doc_id, the same at every size; this bound is the
only limit on what is learned from).  Document frequencies of all n-grams of
the sample are counted by class in Spark; the ``features`` n-grams with the
largest chi-square are kept (a choice of features, made for accuracy: with all n-grams
held-out rows are told apart less well, see the README), each with its log-count ratio
``log((pos + a) / (n_pos + 2a)) - log((neg + a) / (n_neg + 2a))``.  A logistic
regression over presence times ratio is fitted on the driver and its intercept
moved to the true share of the classes.  Scoring covers every whole text.

Cases: a null text is an empty one and scores the intercept; label rows with a
null id or class are ignored, and repeated labels of a document count as toxic
if any says so.  Without two classes to learn from every score is the share of
toxic labels (0 if there are none).  Repeated rows are scored one by one; a score of
exactly the threshold counts as toxic; n-grams of equal chi-square are taken in the order
of their hashes; a very long text is one piece, with some hundred bytes of scratch for
each character; an empty table gives an empty result; a column that clashes with the
result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm._spark import cut, fold, forget, importable, table
from countloom.llm._words import CHUNK_BYTES, buffers, mix64, trim

ORDERS = (3, 4, 5, 6)
PER_CLASS = 4000
FEATURES = 4096
SMOOTHING = 0.5
#: Bytes of text whose n-grams are held at once while counting.
COUNT_BYTES = 256 << 10
_BASE = 0x9E3779B97F4A7C15


class ToxicModel(NamedTuple):
    grams: np.ndarray  #: sorted 64-bit n-gram hashes
    weights: np.ndarray  #: regression weight times log-count ratio
    intercept: float

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits + self.intercept, -40, 40)))


def gram_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past-last row, lower-cased code points, offsets) over runs of texts."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1))
        raw = data[offsets[i] : offsets[j]]
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
        upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
        points[upper] += np.uint64(32)
        points[(points >= 9) & (points <= 13)] = 32
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        yield i, j, points, heads[offsets[i : j + 1] - offsets[i]]
        i = j
    trim()


def grams(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (hash at each position, the last position of each text that holds one)."""
    h, power = np.zeros(len(points), np.uint64), 1
    for k in range(max(ORDERS)):
        shifted = points[k:]
        h = h[: len(shifted)] + shifted * np.uint64(power)
        power = power * _BASE % (1 << 64)
        if k + 1 in ORDERS:
            yield mix64(h + np.uint64(k + 1)), k + 1


def text_grams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) pairs: all n-grams that lie within one text."""
    which = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    texts, found = [], []
    for h, n in grams(points, offsets):
        whole = which[: len(h)] == which[n - 1 :]
        texts.append(which[: len(h)][whole])
        found.append(h[whole])
    return distinct(np.concatenate(texts), np.concatenate(found)) if texts else (which, np.zeros(0, np.uint64))


def distinct(texts: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((grams, texts))
    texts, grams = texts[by], grams[by]
    new = np.ones(len(texts), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (grams[1:] != grams[:-1])
    return texts[new], grams[new]


class Lookup:
    """Finds a fixed set of n-grams among many hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(keys >> np.uint64(42)).astype(np.int64)] = True

    def pairs(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, index of key) pairs."""
        texts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for h, n in grams(points, offsets):
            at = np.flatnonzero(self.sieve[(h >> np.uint64(42)).astype(np.int64)])
            if not len(at) or not len(self.keys):
                continue
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            same = self.keys[k] == h[at]
            at, k = at[same], k[same]
            text = np.searchsorted(offsets, at, side="right") - 1
            whole = at + n <= offsets[text + 1]
            texts.append(text[whole])
            found.append(k[whole])
        return distinct(np.concatenate(texts), np.concatenate(found))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of the sample, and the number of training labels by class."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) % 3 != 1))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for toxic, n in total.items():
        share = F.when(F.col("toxic") == toxic, F.lit(min(1.0, per_class / n))).otherwise(share)
    chosen = known.where(u < share)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), total


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES) -> ToxicModel:
    """Trains on the labelled rows whose fold is not 1. The sample, and so its broadcast ids, are bounded by ``per_class``."""
    chosen, total = labelled_sample(docs, labels, per_class)
    everything = sum(total.values())
    if len(total) < 2:
        share = total.get(1, 0) / everything if everything else 0.0
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(0), float(np.clip(np.log(share / (1 - share)) if 0 < share < 1 else (40 if share else -40), -40, 40)))
    sample = cut(chosen)
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, points, offsets in gram_chunks(batch.column(0), COUNT_BYTES):
                text, gram = text_grams(points, offsets)
                gram, at = np.unique(gram, return_inverse=True)
                pos = np.bincount(at, weights=toxic[i + text], minlength=len(gram)).astype(np.int64)
                n = np.bincount(at, minlength=len(gram))
                yield pa.RecordBatch.from_pydict({"gram": pa.array(gram.view(np.int64)), "pos": pa.array(pos), "neg": pa.array(n - pos)})

    p, q = F.col("pos"), F.col("neg")
    gap = p * F.lit(n_neg) - q * F.lit(n_pos)
    chi = gap * gap / ((p + q) * (F.lit(n_pos + n_neg) - p - q + 1)).cast("double")
    counted = cut(
        sample.mapInArrow(count, "gram long, pos long, neg long")
        .groupBy("gram")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where(p + q >= 3)
        .withColumn("chi", chi)
        .where("chi > 0")
    )
    # The chi-square that ``features`` n-grams reach, from a histogram; no task sorts them all.
    least, room = 0.0, features
    for r in counted.groupBy(F.floor(F.log2("chi") * 16).alias("level")).agg(F.count("*").alias("n"), F.min("chi").alias("low")).orderBy(F.desc("level")).collect():
        least, room = r.low, room - r.n
        if room <= 0:
            break
    best = counted.where(F.col("chi") >= least).toArrow()
    forget(counted)
    best = best.take(np.lexsort((best["gram"].to_numpy(), -best["chi"].to_numpy()))[:features])
    keys = best["gram"].to_numpy().view(np.uint64)
    by = np.argsort(keys)
    keys, pos, neg = keys[by], best["pos"].to_numpy()[by], best["neg"].to_numpy()[by]
    ratio = np.log((pos + SMOOTHING) / (n_pos + 2 * SMOOTHING)) - np.log((neg + SMOOTHING) / (n_neg + 2 * SMOOTHING))
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        for batch in batches:
            held: list = [None] * batch.num_rows
            for i, j, points, offsets in gram_chunks(batch.column(0)):
                text, k = lookup.pairs(points, offsets)
                held[i:j] = np.split(k, np.searchsorted(text, np.arange(1, j - i)))
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(1), "held": pa.array([x.tolist() for x in held], pa.list_(pa.int32()))})

    rows = sample.mapInArrow(present, "toxic int, held array<int>").toArrow().combine_chunks()
    held = rows["held"].combine_chunks()
    column, ptr = held.flatten().to_numpy(), np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
    weights, intercept = _logistic(rows["toxic"].to_numpy().astype(float), column, ptr, ratio)
    forget(sample)
    moved = np.log(total[1] / total[0]) - np.log(n_pos / n_neg)
    return ToxicModel(keys, weights * ratio, float(intercept + moved))


def _logistic(y: np.ndarray, column: np.ndarray, ptr: np.ndarray, ratio: np.ndarray, steps: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch AdaGrad on presence times ratio."""
    row = np.repeat(np.arange(len(y)), np.diff(ptr))
    value, w, b = ratio[column], np.zeros(len(ratio)), 0.0
    seen, seen_b = np.full(len(ratio), 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(row, weights=w[column] * value, minlength=len(y)) + b
        gap = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.bincount(column, weights=gap[row] * value, minlength=len(ratio)) / len(y) + penalty * w
        seen += g * g
        w -= 0.1 * g / np.sqrt(seen)
        seen_b += gap.mean() ** 2
        b -= 0.1 * gap.mean() / np.sqrt(seen_b)
    return w, b


def score(docs: DataFrame, model: ToxicModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the double column ``out``: the probability of the toxic class."""
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        lookup = Lookup(m.grams)
        for part in parts:
            logits = np.zeros(len(part))
            for i, j, points, offsets in gram_chunks(part):
                row, k = lookup.pairs(points, offsets)
                logits[i:j] = np.bincount(row, weights=m.weights[k], minlength=j - i)
            yield pa.array(m.score(logits))

    return docs.withColumn(out, judge(F.col(text)))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, out="score")
    return scored.select("doc_id", (fold(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
