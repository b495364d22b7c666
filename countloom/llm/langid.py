"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word (a run of letters, with a space before it) is scored by the forward
algorithm: the sum, over all its segmentations into pieces, of the product of
the pieces' probabilities.  The probabilities are learned by
expectation-maximisation from a bounded sample of about ``per_language``
labelled documents a language (chosen by a hash of doc_id; this documented bound
limits nothing else).  A text's score is the posterior of its best language
under equal priors, with the evidence of a long text scaled to that of
``EVIDENCE_WORDS`` words so that it stays a graded figure.

Pieces of all lengths are used, and runs of letters are never cut: words are taken
in classes of length, and sums are rescaled on the way so that those of a long run
do not vanish.  Bytes from 0x80 on count as letters inside runs.  A-Z and
the capitals of Latin-1 are lower-cased.

Cases: a null text, or one without a letter, gives ``und`` and score 0; so does
every text if no labelled row exists, as in an empty table.  Rows without a language
are not learned from.  Repeated rows are judged one by one; ties go to the first
language in alphabetical order.  A very long text is scored whole; scratch grows with
its distinct words.  A column that clashes with the result is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm._spark import cut, fold, forget, importable, table
from countloom.llm._words import Words, chunks, span_hash

PER_LANGUAGE = 1500
ROUNDS = 4
EVIDENCE_WORDS = 20
PACKED = 8  #: bytes of a piece that fit a packed key; longer pieces are found through these
UNDETERMINED = "und"
#: A pipeline keeps a document whose language is at least this likely.
KEEP_SCORE = 0.4
#: Bytes of text whose distinct words are scored at once.
_CHUNK = 1 << 20

_LETTER = np.array([0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_H1, _H2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Pieces:
    """The vocabulary.  Up to 8 bytes are packed into a key and found through two hash tables; longer pieces, by a hash, where their first 8 bytes begin one."""

    def __init__(self, pieces: list[bytes], bits: int = 17):
        self.count, self.shift = len(pieces), np.uint64(64 - bits)
        short = np.array([k for k, p in enumerate(pieces) if len(p) <= PACKED], np.int64)
        keys = np.array([int.from_bytes(pieces[k], "little") for k in short], np.uint64)
        n = len(short)
        self.tables = [np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)]
        index = [np.full(1 << bits, n, np.int32), np.full(1 << bits, n, np.int32)]
        places = [((keys * m) >> self.shift).astype(np.int64) for m in (_H1, _H2)]
        for k in range(n):
            item, side = k, 0
            for _ in range(500):
                at = places[side][item]
                item, index[side][at] = int(index[side][at]), item
                self.tables[side][at] = keys[index[side][at]]
                if item == n:
                    break
                side = 1 - side
            else:
                raise ValueError("the vocabulary does not fit its tables")
        whole = np.append(short, self.count).astype(np.int32)
        self.index = [whole[x] for x in index]
        long = [k for k, p in enumerate(pieces) if len(p) > PACKED]
        self.longest = max(map(len, pieces), default=0)
        self.heads = np.unique(np.array([int.from_bytes(pieces[k][:PACKED], "little") for k in long], np.uint64))
        hashes = np.array([self._long_hash(pieces[k]) for k in long], np.uint64)
        by = np.argsort(hashes)
        self.long_hashes, self.long_index = hashes[by], np.array(long, np.int32)[by]

    @staticmethod
    def _long_hash(piece: bytes) -> int:
        h = int.from_bytes(piece[:PACKED], "little")
        for b in piece[PACKED:]:
            h = (h * int(_H1) + b + 1) % (1 << 64)
        return h

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each packed key, or the number of pieces."""
        a = ((keys * _H1) >> self.shift).astype(np.int64)
        b = ((keys * _H2) >> self.shift).astype(np.int64)
        missing = np.int32(self.count)
        return np.minimum(np.where(self.tables[0][a] == keys, self.index[0][a], missing), np.where(self.tables[1][b] == keys, self.index[1][b], missing))

    def begins(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys of 8 bytes with which a longer piece begins."""
        if not len(self.heads) or not len(keys):
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.heads[np.minimum(np.searchsorted(self.heads, keys), len(self.heads) - 1)] == keys)

    def find_long(self, hashes: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.long_hashes, hashes), len(self.long_hashes) - 1)
        return np.where(self.long_hashes[k] == hashes, self.long_index[k], np.int32(self.count))


def public_pieces(raw: str) -> list[bytes]:
    """Pieces of a rank file: letters, or a space and letters; every single byte is among them."""
    out = {bytes([b]) for b in (0x20, *range(0x61, 0x7B), *range(0x80, 0x100))}
    for line in raw.split("\n"):
        if line:
            piece = base64.b64decode(line.split()[0])
            body = piece[1:] if piece[:1] == b" " else piece
            if body and all(_LETTER[b] for b in body):
                out.add(piece)
    return sorted(out)


class LanguageModel(NamedTuple):
    languages: list[str]
    pieces: list[bytes]
    table: np.ndarray  #: probability of each piece (row) in each language (column); the last row is 0


def letter_chunks(column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """(first row, past-last row, letter runs, which texts hold a letter)."""
    for i, j, w in chunks(column, _LETTER, limit=_CHUNK):
        data = w.data
        capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        data[capital] += 0x20
        ascii_letters = np.concatenate([[0], np.cumsum((data >= 0x61) & (data <= 0x7A), dtype=np.int64)])[w.offsets]
        letter = np.diff(ascii_letters) > 0
        for d in np.flatnonzero(~letter & (np.diff(w.ptr) > 0)):
            letter[d] = any(c.isalpha() for c in data[w.offsets[d] : w.offsets[d + 1]].tobytes().decode("utf-8", "ignore"))
        yield i, j, w, letter


#: Words of up to so many bytes, with their space, are summed together; longer ones in classes twice as long each.
_SHORT = 32


def _cuts(pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions inside the runs that no piece spans: every segmentation has a boundary there, so sums factorise."""
    at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
    left = np.repeat(ends, ends - starts) - at
    crossed = np.zeros(len(data) + 2, np.int64)

    def cross(first: np.ndarray, past: np.ndarray) -> None:
        np.add.at(crossed, first + 1, 1)
        np.add.at(crossed, past, -1)

    def walk(at: np.ndarray, left: np.ndarray, key: np.ndarray, done: int) -> None:
        """Marks the pieces from ``at`` on, of whose key ``done`` bytes came before."""
        first = at - done
        for k in range(done + 1, pieces.longest + 1):
            room = left >= k - done
            at, left, key, first = at[room], left[room], key[room], first[room]
            if k == PACKED + 1:
                deep = pieces.begins(key)
                at, left, key, first = at[deep], left[deep], key[deep], first[deep]
            if not len(at):
                return
            byte = data[at + (k - 1 - done)].astype(np.uint64)
            key = key | byte << np.uint64(8 * (k - 1)) if k <= PACKED else key * _H1 + byte + np.uint64(1)
            known = (pieces.find(key) if k <= PACKED else pieces.find_long(key)) < pieces.count
            cross(np.maximum(first, at - 1)[known], (first + k)[known])

    walk(at, left, np.zeros(len(at), np.uint64), 0)
    walk(starts, ends - starts, np.full(len(starts), 0x20, np.uint64), 1)
    free = np.cumsum(crossed)[: len(data) + 1] == 0
    inner = at[free[at]]
    return np.setdiff1d(inner, starts)


class Forward:
    """Forward sums of distinct words, class by class of their lengths; long runs are first cut where no piece spans."""

    def __init__(self, pieces: Pieces, w: Words):
        starts, ends, lead = w.starts, w.ends, np.ones(len(w.starts), bool)
        self.run = np.arange(len(starts))
        long = np.flatnonzero(ends - starts >= _SHORT)
        if len(long):
            inner = _cuts(pieces, w.data, starts[long], ends[long])
            owner = np.searchsorted(starts, inner, side="right") - 1
            starts, lead = np.concatenate([starts, inner]), np.concatenate([lead, np.zeros(len(inner), bool)])
            self.run = np.concatenate([self.run, owner])
            by = np.argsort(starts, kind="stable")
            starts, lead, self.run = starts[by], lead[by], self.run[by]
            last = np.append(self.run[1:] != self.run[:-1], True)
            ends = np.where(last, w.ends[self.run], np.append(starts[1:], 0))
        self.first = np.searchsorted(self.run, np.arange(len(w.starts)))
        name = span_hash(w.data, starts, ends) ^ np.where(lead, np.uint64(0), _H2)
        _, first, inverse = np.unique(name, return_index=True, return_inverse=True)
        lead, length = lead[first], (ends - starts + lead)[first]
        size = 2 * np.maximum(0, np.ceil(np.log2(np.maximum(length, 1) / _SHORT))).astype(np.int64) + lead
        by = np.lexsort((-length, -size))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.inverse, self.count = place[inverse], len(by)
        first, length, size, lead = first[by], length[by], size[by], lead[by]
        edges = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(by)] if len(by) else [0]
        self.classes = [(slice(a, b), _Class(pieces, w.data, starts[first[a:b]], length[a:b], bool(lead[a]))) for a, b in zip(edges, edges[1:])]

    def logs(self, probability: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations, for each run of letters and language."""
        out = np.empty((self.count, probability.shape[1]))
        for rows, words in self.classes:
            out[rows] = words.logs(probability)
        out = out[self.inverse]
        return np.add.reduceat(out, self.first, axis=0) if len(self.first) < len(out) else out

    def expected(self, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts by language of distinct words with ``weight`` occurrences."""
        out = np.zeros_like(probability)
        for rows, words in self.classes:
            words.expected(probability, weight[rows], out)
        return out


class _Class:
    """Words of like lengths, longest first."""

    def __init__(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray, length: np.ndarray, lead: bool):
        self.pieces, self.length, self.longest = pieces, length, int(length.max(initial=0))
        self.starts, self.data, self.lead = starts, data, int(lead)
        self.reach = max(pieces.longest, PACKED)
        # How many words have k bytes or more; no byte is read beyond a word's end.
        self.active = np.searchsorted(-length, -np.arange(self.longest + self.reach + 2), side="right")
        self.columns = [self._byte(self.active[k + 1], k) for k in range(self.longest)] if self.longest <= _SHORT else None

    def _byte(self, words, at: int) -> np.ndarray:
        if at < self.lead:
            return np.full(words if np.ndim(words) == 0 else len(words), 0x20, np.uint8)
        return self.data[(self.starts[:words] if np.ndim(words) == 0 else self.starts[words]) + (at - self.lead)]

    def byte(self, words, at: int) -> np.ndarray:
        """Byte ``at`` of the words (a number of them, or their places); the first is a space where words have one."""
        if self.columns is None:
            return self._byte(words, at).astype(np.uint64)
        return (self.columns[at][:words] if np.ndim(words) == 0 else self.columns[at][words]).astype(np.uint64)

    def arcs(self, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, words, piece) of the pieces that begin at ``start``."""
        key = np.zeros(self.active[start + 1], np.uint64)
        for k in range(1, PACKED + 1):
            m = self.active[start + k]
            if not m:
                return
            key = key[:m] | (self.byte(m, start + k - 1) << np.uint64(8 * (k - 1)))
            found = self.pieces.find(key)
            words = np.flatnonzero(found < self.pieces.count)
            yield start + k, words, found[words]
        words = self.pieces.begins(key)
        key = key[words]
        for k in range(PACKED + 1, self.reach + 1):
            m = np.searchsorted(words, self.active[start + k])
            words, key = words[:m], key[:m]
            if not m:
                return
            key = key * _H1 + self.byte(words, start + k - 1) + np.uint64(1)
            found = self.pieces.find_long(key)
            whole = found < self.pieces.count
            yield start + k, words[whole], found[whole]

    def sums(self, probability: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(j, alpha, log of its scale) in order of j: for words of j bytes or more and each language, the scaled sum over segmentations of the first j bytes.

        Only the sums within a longest piece's reach are held.  A word's scale is
        the same for all its languages and sums; it changes when they become small.
        """
        if not self.longest:
            return
        wide = probability.shape[1]
        ahead = {0: np.ones((self.active[0], wide))}
        scale = np.zeros(self.active[0])
        for start in range(self.longest + 1):
            alpha = ahead.pop(start, None)
            if alpha is None:
                alpha = np.zeros((self.active[start], wide))
            if start and start % 24 == 0:
                top = alpha.max(axis=1)
                for sums in ahead.values():
                    top[: len(sums)] = np.maximum(top[: len(sums)], sums.max(axis=1))
                small = np.flatnonzero((top < 1e-60) & (top > 0))
                if len(small):
                    alpha[small] /= top[small, None]
                    for sums in ahead.values():
                        mine = small[small < len(sums)]
                        sums[mine] /= top[mine, None]
                    scale[small] += np.log(top[small])
            yield start, alpha, scale[: len(alpha)]
            for end, words, piece in self.arcs(start) if start < self.longest else ():
                if end not in ahead:
                    ahead[end] = np.zeros((self.active[end], wide))
                ahead[end][words] += alpha[words] * probability[piece]

    def logs(self, probability: np.ndarray) -> np.ndarray:
        total = np.empty((len(self.length), probability.shape[1]))
        for j, alpha, scale in self.sums(probability):
            a, b = self.active[j + 1], self.active[j]
            if j and b > a:
                total[a:b] = np.log(np.maximum(alpha[a:b], 1e-300)) + scale[a:b, None]
        return total

    def expected(self, probability: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        """Adds expected piece counts to ``out``; holds the sums at every byte of the words."""
        held = [(alpha.copy(), scale.copy()) for _, alpha, scale in self.sums(probability)]
        wide = probability.shape[1]
        # beta has a scale of its own: alpha * step * beta is in proportion to the word's total.
        beta: dict[int, np.ndarray] = {}
        shift = np.zeros(len(self.length))
        total = self.logs(probability)
        for start in range(self.longest, -1, -1):
            mine = beta.setdefault(start, np.zeros((self.active[start], wide)))
            a, b = self.active[start + 1], self.active[start]
            if start:
                mine[a:b] = 1
            alpha, scale = held[start]
            factor = np.exp(np.clip(scale[:, None] + shift[: len(alpha), None] - total[: len(alpha)], -700, 700)) * weight[: len(alpha)]
            for end, words, piece in self.arcs(start) if start < self.longest else ():
                step = probability[piece] * beta[end][words]
                mine[words] += step
                mass = alpha[words] * step * factor[words]
                for lang in range(wide):
                    out[:, lang] += np.bincount(piece, weights=mass[:, lang], minlength=len(out))
            if start % 24 == 0:
                near = [beta[k] for k in range(start, start + self.reach) if k in beta]
                top = np.zeros(self.active[start])
                for x in near:
                    top[: len(x)] = np.maximum(top[: len(x)], x.max(axis=1))
                small = np.flatnonzero((top < 1e-60) & (top > 0))
                if len(small):
                    for x in near:
                        some = small[small < len(x)]
                        x[some] /= top[some, None]
                    shift[small] += np.log(top[small])
            beta.pop(start + self.reach, None)


def fit(docs: DataFrame, pieces: list[bytes], per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> LanguageModel:
    """Learns from rows with a language whose fold is not 2."""
    spark = docs.sparkSession
    importable(spark)
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) % 4 != 2)).select("doc_id", "text", "lang")
    total = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(total)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in total.items() for x in (lang, min(1.0, per_language / n)))), F.col("lang"))
    number = F.element_at(F.create_map(*(F.lit(x) for k, lang in enumerate(languages) for x in (lang, k))), F.col("lang"))
    sample = cut(known.where(u < share).select("text", number.alias("lang")))
    probability = np.full((len(pieces) + 1, len(languages)), 1 / len(pieces))
    probability[-1] = 0
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, probability))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, p = shared.value
            finder, out = Pieces(names), np.zeros_like(p)
            for batch in batches:
                lang = batch.column(1).to_numpy()
                for i, j, w, _ in letter_chunks(batch.column(0)):
                    forward = Forward(finder, w)
                    pair = forward.inverse * p.shape[1] + np.repeat(lang[i:j], np.diff(w.ptr))[forward.run]
                    weight = np.bincount(pair, minlength=forward.count * p.shape[1]).reshape(-1, p.shape[1])
                    out += forward.expected(p, weight)
            piece, language = np.nonzero(out[:-1])
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "lang": pa.array(language, pa.int32()), "n": pa.array(out[piece, language])})

        counts = sample.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        probability[:-1] = 0.02
        probability[counts["piece"].to_numpy(), counts["lang"].to_numpy()] += counts["n"].to_numpy()
        probability /= probability.sum(axis=0)
    forget(sample)
    return LanguageModel(languages, pieces, probability)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang_pred and score."""
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        finder, names = Pieces(m.pieces), np.array([*m.languages, UNDETERMINED], object)
        n_lang = len(m.languages)
        for part in parts:
            best, score = np.full(len(part), n_lang), np.zeros(len(part))
            for i, j, w, letter in letter_chunks(part) if n_lang else ():
                forward = Forward(finder, w)
                logs = forward.logs(m.table)
                total = np.zeros((len(logs) + 1, n_lang))
                np.cumsum(logs, axis=0, out=total[1:])
                like = total[w.ptr[1:]] - total[w.ptr[:-1]]
                like /= np.maximum(1, np.diff(w.ptr) / EVIDENCE_WORDS)[:, None]
                like = np.exp(like - like.max(axis=1, keepdims=True))
                best[i:j] = np.where(letter, like.argmax(axis=1), n_lang)
                score[i:j] = np.where(letter, like.max(axis=1) / like.sum(axis=1), 0)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], names=["lang_pred", "score"])

    return docs.withColumn(out, judge(F.col(text)))


def default_pieces() -> list[bytes]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding="ascii") as f:
        return public_pieces(f.read())


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs, default_pieces()), out="v")
    return found.select("doc_id", (fold(F.col("doc_id")) % 4 == 2).alias("held_out"), "v.lang_pred", "v.score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be told; ``und`` and scores under KEEP_SCORE go."""
    found = identify(docs, fit(docs, default_pieces()), out="__language")
    verdict = F.col("__language")
    return found.where((verdict["lang_pred"] != UNDETERMINED) & (verdict["score"] >= KEEP_SCORE)).select(*docs.columns)


QUERIES = {"op7_language_id": op7_language_id}
ORACLE_SQL: dict[str, str] = {}
