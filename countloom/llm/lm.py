"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are words and one end a text.  A word's *spelling* is a hash of its first
byte and its last two; spellings are dealt into ``GROUPS`` classes by which
spellings stand next to which in the training texts (k-means over exact counts).
The most frequent words (``Counts.head`` of them, the end included) are predicted
one by one, all others by their spelling, times the word's smoothed share
of its spelling, (c + 1/2) / (N_s + (V_s + 1) / 2); unknown words share one place
in their spelling, so the whole sums to one:

    P(token) = P(class | context) P(word or spelling | class, context) share

Both conditional parts are softmaxes.  The class has a weight for the
word before (a), for the word before that (b, a skip feature), and for the hashed
pair of them; the word within its class has a weight for the word before.
Contexts are frequent words, or hashed spellings.

What the model learns from is counted over all training texts: how often each class
follows each (a, b), and each target each a.  These counts are additive and sparse;
their number, the number of words predicted one by one and that of contexts grow
with the texts until the weights reach what may be broadcast (``HEAD_BITS``).
One row holds all that was counted after one a.  A training round is a gradient step
over all rows: weights with an a belong to one row and are stepped where the row
lies; the skip weights are shared, and their gradient is added up over the rows.
Steps are divided by the counts behind a weight, so they need no rate that depends
on the amount of text.  Nothing depends on how texts fall into tasks.

Counts of words are exact.  Frequent words' counts (at most ``TABLE`` of them)
are broadcast; the others are joined, word by word, with the documents' words.

A word is known to the operator by a 64-bit hash of its bytes.  Cases: a null
text is an empty one and has the end as its one token; a null id is as an empty
one for the choice of training rows; repeated rows are scored one by one; a very
long text is held whole, with some hundred bytes of scratch for each of its words;
equal counts are ranked by hash; columns of ``docs`` that clash with the results
are replaced; with no training text every token is unknown and the base score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm._spark import cut, fold, forget, importable, table
from countloom.llm._words import NON_SPACE, Words, chunks, mix64

TABLE = 1 << 18
SPELLINGS, GROUPS = 1024, 32
#: Words predicted one by one, and as many contexts: at least and at most so many bits; the most is 50 MB of weights.
HEAD_BITS = (10, 11)
SKIPS, SLOTS = 128, 32  #: contexts of the skip feature; hashed pairs for each word before
ROUNDS, STEP, PRIOR = 6, 0.5, 1.0
_PAIRS = -2  #: kind of a count of neighbouring spellings
_END = np.uint64(0x5851F42D4C957F2D)  #: stands for the end among word hashes
_LN10 = np.log(10.0)
#: The slot of each skip context within a word before.
_SLOT = (mix64(np.arange(SKIPS, dtype=np.uint64) + np.uint64(77)) % np.uint64(SLOTS)).astype(np.int64)


class Counts(NamedTuple):
    hashes: np.ndarray  #: sorted; the frequent words
    rank: np.ndarray  #: by count, 1 for the first
    logs: np.ndarray  #: log10(c + 1/2), aligned with hashes
    tokens: int  #: N
    distinct: int  #: V
    texts: int  #: training texts, the count of the end
    head: np.ndarray  #: count by rank of the words predicted one by one
    tail_tokens: np.ndarray  #: N by spelling, without head words
    tail_words: np.ndarray  #: V by spelling, without head words
    group: np.ndarray  #: class of each target: head words by rank, then spellings


def spellings(w: Words) -> np.ndarray:
    first, last = w.data[w.starts].astype(np.uint64), w.data[w.ends - 1].astype(np.uint64)
    second = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(np.uint64)
    return (mix64(first << np.uint64(16) | second << np.uint64(8) | last) >> np.uint64(64 - 10)).astype(np.int64)


def _gather(docs: DataFrame) -> DataFrame:
    """(word, kind, n) over the training texts: words by spelling, the end (-1), neighbouring spellings (-2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pairs = np.zeros(SPELLINGS * SPELLINGS, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, at = np.unique(h, return_index=True, return_inverse=True)
            return u, s[first], np.bincount(at, weights=n).astype(np.int64)

        texts = 0
        for batch in batches:
            texts += batch.num_rows
            for _, _, w in chunks(batch.column(0), NON_SPACE):
                spelled = spellings(w)
                h, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                held.append((h, spelled[first], n))
                inner = np.ones(len(spelled), bool)
                inner[w.ptr[:-1][np.diff(w.ptr) > 0]] = False
                at = np.flatnonzero(inner)
                np.add.at(pairs, spelled[at - 1] * SPELLINGS + spelled[at], 1)
                if sum(len(x[0]) for x in held) > 1_500_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield _rows(held.pop())
        if held:
            yield _rows(merged())
        seen = np.flatnonzero(pairs)
        yield _rows((seen.astype(np.uint64), np.full(len(seen), _PAIRS), pairs[seen]))
        yield _rows((np.array([_END]), np.array([-1]), np.array([texts])))

    def _rows(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(x[0].view(np.int64)), "kind": pa.array(x[1], pa.int32()), "n": pa.array(x[2], pa.int64())})

    rows = docs.mapInArrow(count, "word long, kind int, n long")
    return rows.groupBy("word", "kind").agg(F.sum("n").alias("n")).where("n > 0")


def classes_of(pairs: np.ndarray, groups: int = GROUPS, rounds: int = 15) -> np.ndarray:
    """Class of each spelling: k-means over the square roots of what share of its neighbours has each spelling."""
    near = np.concatenate([pairs, pairs.T], axis=1).astype(np.float32)
    weight = near.sum(axis=1).astype(float)
    x = np.sqrt(near / np.maximum(weight, 1)[:, None]).astype(np.float32)
    chosen = [int(weight.argmax())]
    gap = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(groups - 1):
        chosen.append(int((gap * np.sqrt(weight)).argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centre = x[chosen].copy()
    for _ in range(rounds):
        out = ((centre * centre).sum(axis=1)[None, :] - 2 * x @ centre.T).argmin(axis=1)
        for k in range(groups):
            mine = (out == k) & (weight > 0)
            if mine.any():
                centre[k] = (x[mine] * weight[mine, None]).sum(axis=0) / weight[mine].sum()
    return out


def head_size(tokens: int) -> int:
    """Words predicted one by one: about half the square root of the tokens, within HEAD_BITS."""
    return 1 << int(np.clip(np.log2(max(tokens, 1)) / 2 - 1, *HEAD_BITS))


def count_words(docs: DataFrame, most: int = TABLE) -> tuple[Counts, DataFrame]:
    """Exact counts of the training texts ``docs`` (text): (what is broadcast, all other words' counts)."""
    counts = cut(_gather(docs))
    by_kind = {r.kind: (r.n, r.v) for r in counts.where(F.col("kind") != _PAIRS).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    texts = by_kind.pop(-1, (0, 0))[0]
    words = counts.where("kind >= 0")
    # The count above which at most ``most`` words lie, from a histogram of some hundred rows.
    level = F.floor(F.log2("n") * 16)
    room, least = most, None
    for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.min("n").alias("low")).orderBy(F.desc("level")).collect():
        room -= r.v
        if room < 0:
            break
        least = r.low
    frequent = F.col("n") >= F.lit(least if least is not None else 1 << 62)
    top = words.where(frequent).toArrow()
    h, n, kind = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["kind"].to_numpy()
    order = np.lexsort((h, -n))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(1, len(h) + 1)
    total = sum(t for t, _ in by_kind.values()) + texts
    size = head_size(total)
    tail_tokens, tail_words = np.zeros(SPELLINGS, np.int64), np.zeros(SPELLINGS, np.int64)
    for k, (tokens, v) in by_kind.items():
        tail_tokens[k], tail_words[k] = tokens, v
    head, first = np.zeros(size, np.int64), order[: size - 1]
    head[0], head[1 : len(first) + 1] = texts, n[first]
    np.subtract.at(tail_tokens, kind[first], n[first])
    np.subtract.at(tail_words, kind[first], 1)
    # At most SPELLINGS squared rows, whatever the texts.
    near = counts.where(F.col("kind") == _PAIRS).select("word", "n").toArrow()
    pairs = np.zeros(SPELLINGS * SPELLINGS, np.int64)
    pairs[near["word"].to_numpy()] = near["n"].to_numpy()
    by_spelling = classes_of(pairs.reshape(SPELLINGS, SPELLINGS))
    group = np.zeros(size + SPELLINGS, np.int64)
    group[1 : len(first) + 1], group[size:] = by_spelling[kind[first]], by_spelling
    by = np.argsort(h)
    out = Counts(h[by], rank[by], np.log10(n[by] + 0.5), int(total), sum(v for _, v in by_kind.values()) + (texts > 0), int(texts), head, tail_tokens, tail_words, group)
    return out, words.where(~frequent).select("word", "n")


class Tokens(NamedTuple):
    """The tokens of a run of texts, each text's end included."""

    ptr: np.ndarray
    rank: np.ndarray  #: 0 the end, from 1 by count, -1 not in the table
    at: np.ndarray  #: index in the table, -1 without
    hashes: np.ndarray
    target: np.ndarray  #: rank of a head word, or the head's size plus the spelling
    before: np.ndarray  #: context of the word before
    skip: np.ndarray  #: context of the word before that


def tokens_of(w: Words, counts: Counts) -> Tokens:
    texts, h, size = len(w.ptr) - 1, w.hashes(), len(counts.head)
    ptr = w.ptr + np.arange(texts + 1)
    n = int(ptr[-1])
    word = np.ones(n, bool)
    word[ptr[1:] - 1] = False
    hashes, rank, at, spelled = np.full(n, _END), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
    k = np.minimum(np.searchsorted(counts.hashes, h), max(0, len(counts.hashes) - 1))
    found = counts.hashes[k] == h if len(counts.hashes) else np.zeros(len(h), bool)
    hashes[word], at[word], rank[word], spelled[word] = h, np.where(found, k, -1), np.where(found, counts.rank[k] if len(counts.rank) else 0, -1), spellings(w)

    def context(contexts: int) -> np.ndarray:
        half = contexts // 2
        return np.where((rank >= 0) & (rank < half), rank, half + spelled % half)

    target = np.where((rank >= 0) & (rank < size), rank, size + spelled)
    # Context 0, the end, also stands before a text's first word.
    before, skip = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[1:], skip[2:] = context(size)[:-1], context(SKIPS)[:-2]
    first = ptr[:-1]
    before[first] = skip[first] = skip[first[np.diff(ptr) > 1] + 1] = 0
    return Tokens(ptr, rank, at, hashes, target, before, skip)


class Weights(NamedTuple):
    """Logits; a has a context for each head word. Word logits are already log-probabilities within their class."""

    bias: np.ndarray  #: class
    before: np.ndarray  #: a x class
    skip: np.ndarray  #: b x class
    pair: np.ndarray  #: a x slot x class
    log_sum: np.ndarray  #: a x b: log of the class softmax's denominator
    words: np.ndarray  #: a x target


def token_scores(m: Weights, counts: Counts, t: Tokens) -> np.ndarray:
    """log10 probability of every token, but for a tail token without its log10(c + 1/2)."""
    g = counts.group[t.target]
    log = m.bias[g] + m.before[t.before, g] + m.skip[t.skip, g] + m.pair[t.before, _SLOT[t.skip], g] - m.log_sum[t.before, t.skip]
    log = log.astype(float) + m.words[t.before, t.target]
    tail = t.target >= len(counts.head)
    s = t.target[tail] - len(counts.head)
    log[tail] -= np.log(counts.tail_tokens[s] + (counts.tail_words[s] + 1) / 2)
    return log / _LN10


def _class_bias(counts: Counts) -> np.ndarray:
    size = np.bincount(counts.group, weights=np.concatenate([counts.head, counts.tail_tokens]), minlength=GROUPS) + 0.5
    return np.log(size / size.sum())


def _word_bias(counts: Counts) -> np.ndarray:
    size = np.concatenate([counts.head, counts.tail_tokens]) + 0.5
    return np.log(size / np.bincount(counts.group, weights=size, minlength=GROUPS)[counts.group])


def class_logs(bias: np.ndarray, before: np.ndarray, skip: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log P(class | a, b), log of its denominator) for some a and every b."""
    z = bias + before[:, None, :] + skip[None, :, :] + pair[:, _SLOT, :]
    top = z.max(axis=2, keepdims=True)
    log_sum = np.log(np.exp(z - top).sum(axis=2, keepdims=True)) + top
    return z - log_sum, log_sum[:, :, 0]


def stepped(weight: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """One gradient step of the penalised log-likelihood, divided by the counts behind each weight."""
    return weight + STEP * (seen - expected - PRIOR * weight) / (np.maximum(seen, expected) + PRIOR)


def class_step(n: np.ndarray, bias: np.ndarray, before: np.ndarray, skip: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A step of the weights that belong to some a, from counts ``n`` (a x b x class): (before, pair, seen by b, expected by b)."""
    expected = np.exp(class_logs(bias, before, skip, pair)[0]) * n.sum(axis=2, keepdims=True)
    slots = np.zeros((SLOTS, SKIPS))
    slots[_SLOT, np.arange(SKIPS)] = 1
    return stepped(before, n.sum(axis=1), expected.sum(axis=1)), stepped(pair, slots @ n, slots @ expected), n.sum(axis=0), expected.sum(axis=0)


def word_logs(bias: np.ndarray, weight: np.ndarray, group: np.ndarray) -> np.ndarray:
    """log P(target | class, a), a row for each a."""
    z = weight + bias
    total = np.stack([np.bincount(group, weights=row, minlength=GROUPS) for row in np.exp(z)])
    return z - np.log(np.maximum(total, 1e-300))[:, group]


def fit_words(n: np.ndarray, counts: Counts, rounds: int = ROUNDS) -> np.ndarray:
    """:func:`word_logs` after ``rounds`` steps from counts ``n`` (a x target)."""
    bias, weight = _word_bias(counts), np.zeros(n.shape)
    often = np.stack([np.bincount(counts.group, weights=row, minlength=GROUPS) for row in n])[:, counts.group] if len(n) else np.zeros(n.shape)
    for _ in range(rounds):
        weight = stepped(weight, n, often * np.exp(word_logs(bias, weight, counts.group)))
    return word_logs(bias, weight, counts.group)


def _events(docs: DataFrame, shared, size: int) -> DataFrame:
    """(key, n): how often each class follows each (a, b), then each target each a; key = a * width + place."""
    targets = size + SPELLINGS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        classes, words = np.zeros(size * SKIPS * GROUPS, np.int32), np.zeros(size * targets, np.int32)
        for batch in batches:
            for _, _, w in chunks(batch.column(0), NON_SPACE):
                t = tokens_of(w, counts)
                np.add.at(classes, (t.before * SKIPS + t.skip) * GROUPS + counts.group[t.target], 1)
                np.add.at(words, t.before * targets + t.target, 1)
        for n, width, first in ((classes, SKIPS * GROUPS, 0), (words, targets, SKIPS * GROUPS)):
            seen = np.flatnonzero(n)
            for low in range(0, len(seen), 1 << 16):
                at = seen[low : low + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"key": pa.array(at // width * (SKIPS * GROUPS + targets) + first + at % width), "n": pa.array(n[at].astype(np.int64))})

    return docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


_STATE = "a int, place binary, n binary, weights binary"


def _state(events: DataFrame, width: int) -> DataFrame:
    """One row for each a with all that was counted after it; its weights are zero."""

    def build(rows: pa.Table) -> pa.Table:
        key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        by = np.argsort(key)
        blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        return pa.table({"a": pa.array([int(key[0]) // width], pa.int32()), "place": blob(key[by] % width, np.int32), "n": blob(n[by], np.int64), "weights": blob(np.zeros((1 + SLOTS) * GROUPS), np.float64)})

    return events.groupBy(F.expr(f"key div {width}")).applyInArrow(build, _STATE)


def _dense(batch: pa.RecordBatch, size: int, rows: int = 64) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, class counts, target counts, weights of a, weights of its pairs) of some rows of the state at a time."""
    width = SKIPS * GROUPS + size + SPELLINGS
    for low in range(0, batch.num_rows, rows):
        part = batch.slice(low, rows)
        n = np.zeros((part.num_rows, width))
        for k, (place, often) in enumerate(zip(part["place"], part["n"], strict=True)):
            n[k, np.frombuffer(place.as_buffer(), np.int32)] = np.frombuffer(often.as_buffer(), np.int64)
        weights = np.stack([np.frombuffer(x.as_buffer()) for x in part["weights"]]).reshape(-1, 1 + SLOTS, GROUPS)
        yield part["a"].to_pylist(), n[:, : SKIPS * GROUPS].reshape(-1, SKIPS, GROUPS), n[:, SKIPS * GROUPS :], weights[:, 0], weights[:, 1:]


def train(docs: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Weights:
    """Weights learned from all of ``docs`` (text)."""
    spark, size = docs.sparkSession, len(counts.head)
    shared = spark.sparkContext.broadcast(counts)
    bias, skip = _class_bias(counts), np.zeros((SKIPS, GROUPS))
    state = cut(_state(_events(docs.select("text"), shared, size), SKIPS * GROUPS + size + SPELLINGS))
    for _ in range(rounds):

        def step(batches: Iterator[pa.RecordBatch], skip=skip) -> Iterator[pa.RecordBatch]:
            seen, expected = np.zeros(skip.shape), np.zeros(skip.shape)
            for batch in batches:
                new = []
                for _, n, _, before, pair in _dense(batch, size):
                    before, pair, some, likely = class_step(n, bias, before, skip, pair)
                    seen, expected = seen + some, expected + likely
                    new += [np.concatenate([before[k][None], pair[k]]).tobytes() for k in range(len(n))]
                yield pa.RecordBatch.from_arrays([batch["a"], batch["place"], batch["n"], pa.array(new, pa.binary())], names=["a", "place", "n", "weights"])
            yield pa.RecordBatch.from_pydict({"a": pa.array([-1], pa.int32()), "place": pa.array([None], pa.binary()), "n": pa.array([seen.tobytes()], pa.binary()), "weights": pa.array([expected.tobytes()], pa.binary())})

        new = cut(state.mapInArrow(step, _STATE))
        forget(state)
        state = new.where("a >= 0")
        # One row of 64 KB a task; the state's size, and so its tasks, are bounded.
        sums = new.where("a < 0").select("n", "weights").toArrow()
        seen, expected = (np.sum([np.frombuffer(x, np.float64) for x in sorted(sums[c].to_pylist())], axis=0).reshape(SKIPS, GROUPS) for c in ("n", "weights"))
        skip = stepped(skip, seen, expected)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, n, before, pair in _dense(batch, size):
                log_sum, words = class_logs(bias, before, skip, pair)[1], fit_words(n, shared.value, rounds)
                blobs = [np.concatenate([x.reshape(-1) for x in row]).astype(np.float32).tobytes() for row in zip(before, pair, log_sum, words, strict=True)]
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int32()), "row": pa.array(blobs, pa.binary())})

    # What an a that never occurred has.
    pair, zero = np.zeros((1, SLOTS, GROUPS)), np.zeros((1, GROUPS))
    default = np.concatenate([np.zeros((1 + SLOTS) * GROUPS), class_logs(bias, zero, skip, pair)[1][0], _word_bias(counts)]).astype(np.float32)
    rows = np.broadcast_to(default, (size, len(default))).copy()
    for r in state.mapInArrow(finish, "a int, row binary").toArrow().to_pylist():
        rows[r["a"]] = np.frombuffer(r["row"], np.float32)
    forget(state)
    shared.unpersist()
    before, pair, log_sum, words = np.split(rows, np.cumsum([GROUPS, SLOTS * GROUPS, SKIPS]), axis=1)
    single = lambda x: np.ascontiguousarray(x, np.float32)
    return Weights(single(bias), single(before), single(skip), single(pair).reshape(size, SLOTS, GROUPS), single(log_sum), single(words))


def score(docs: DataFrame, m: Weights, counts: Counts, others: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` less ``text`` with n_tokens, n_known, base_score and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((m, counts))
    kind = "struct<n:bigint,known:bigint,base:double,score:double,rare:array<bigint>>"

    @F.arrow_udf(kind)
    def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, table = shared.value
        for part in parts:
            n, known, base, total, rare, ends = [], [], [], [], [], [np.zeros(1, np.int64)]
            for _, _, w in chunks(part, NON_SPACE):
                t = tokens_of(w, table)
                log = np.zeros(len(t.rank))
                inside = t.at >= 0
                log[inside] = table.logs[t.at[inside]]
                log[t.rank == 0] = np.log10(table.texts + 0.5)
                scores = token_scores(weights, table, t) + np.where(t.target >= len(table.head), log, 0)
                starts = t.ptr[:-1]
                n.append(np.diff(t.ptr))
                known.append(np.add.reduceat((inside | ((t.rank == 0) & (table.texts > 0))).astype(np.int64), starts))
                base.append(np.add.reduceat(log, starts))
                total.append(np.add.reduceat(scores, starts))
                miss = t.rank < 0
                rare.append(t.hashes[miss].view(np.int64))
                ends.append(np.add.reduceat(miss.astype(np.int64), starts))
            cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(ends)), pa.int32()), pa.array(cat(rare, np.int64)))
            yield pa.StructArray.from_arrays([pa.array(cat(n, np.int64)), pa.array(cat(known, np.int64)), pa.array(cat(base, float)), pa.array(cat(total, float)), lists], names=["n", "known", "base", "score", "rare"])

    held = cut(docs.drop("n_tokens", "n_known", "base_score", "score").withColumn("__row", F.monotonically_increasing_id()).withColumn("__lm", judge(F.col(text))).drop(text))
    words = held.select("__row", F.explode("__lm.rare").alias("word")).groupBy("__row", "word").agg(F.count("*").alias("k"))
    seen = words.join(others, "word", "left").groupBy("__row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("__log"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("__known")
    )
    x, extra = F.col("__lm"), F.coalesce("__log", F.lit(0.0))
    denominator = float(np.log10(counts.tokens + 0.5 * (counts.distinct + 1)))
    out = held.join(seen, "__row", "left").withColumns(
        {
            "n_tokens": x["n"],
            "n_known": x["known"] + F.coalesce("__known", F.lit(0)),
            "base_score": x["base"] + extra - x["n"] * F.lit(denominator),
            "score": x["score"] + extra,
        }
    )
    return out.drop("__row", "__lm", "__log", "__known")


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = docs.where(fold(F.col("doc_id")) % 5 != 1).select("text")
    counts, others = count_words(training)
    weights = train(training, counts)
    scored = score(docs, weights, counts, others)
    return scored.select("doc_id", (fold(F.col("doc_id")) % 5 == 1).alias("held_out"), "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
