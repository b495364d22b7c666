"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` consecutive words (the whole item
where it has fewer).  A window must be contained whole, so the necessary prefix
of its rarity-ordered words is one word: the one that occurs least in the
corpus.  Those words are joined with the positions of the documents' words;
each match fixes where the window would begin and end (positional and length
bounds), and the words there are compared one by one with the window's.

The benchmark is the query side.  Up to ``block_bytes`` of text its index is
broadcast and ``documents`` is not shuffled.  Beyond that the same steps are joins:
the windows' words pass through a sieve of bounded size over ``documents`` to be
counted, each window is filed under its rarest word, the documents' occurrences of
those words (through another sieve), with the words around them, are joined with
the windows filed there, and compared.  The number of passes over ``documents`` does
not depend on the benchmark's size, and only documents with hits are joined with them.
Corpus counts are taken over all documents.

Cases: a null or wordless text has no words, no hits and is not contaminated.
A null item text has no windows; a null item_id marks words but is not counted
as an item.  Repeated documents are judged one by one, repeated items count
once.  A very long text is scanned whole.  Ties between equally rare words go to the
first.  Empty tables give empty results, or no hits; a column that clashes with the
result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm._spark import Sieve, cut, importable, split_by_sieve, table
from countloom.llm._words import ALNUM, chunks, runs

WINDOW = 13
BLOCK_BYTES = 16 << 20


class WindowIndex:
    """The windows of one block of items, filed under their rarest word."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        found: dict[bytes, set[int]] = {}
        self.names = sorted({i for i, _ in items if i is not None})
        name = {x: k for k, x in enumerate(self.names)}
        for (row, _), hashes in zip(items, item_hashes([t for _, t in items]), strict=True):
            for at in range(max(1, len(hashes) - window + 1) if len(hashes) else 0):
                found.setdefault(hashes[at : at + window].tobytes(), set()).add(name[row] if row is not None else -1)
        self.length = np.array([len(k) // 8 for k in found], np.int64)
        self.words = np.zeros((len(found), int(self.length.max(initial=0))), np.uint64)
        for k, raw in enumerate(found):
            self.words[k, : self.length[k]] = np.frombuffer(raw, np.uint64)
        self.items_ptr = np.cumsum([0, *(len(v) for v in found.values())])
        self.items = np.array([x for v in found.values() for x in sorted(v)], np.int64)
        self.vocabulary = np.unique(np.concatenate([self.words[k, :n] for k, n in enumerate(self.length)])) if found else np.zeros(0, np.uint64)

    def order(self, counts: np.ndarray) -> None:
        """Files each window under its rarest word, given the vocabulary's corpus counts."""
        slots = np.arange(self.words.shape[1])[None, :] < self.length[:, None]
        rank = np.where(slots, counts[np.minimum(np.searchsorted(self.vocabulary, self.words), max(0, len(self.vocabulary) - 1))] if len(self.vocabulary) else 0, np.iinfo(np.int64).max)
        offset = rank.argmin(axis=1) if self.words.size else np.zeros(0, np.int64)
        token = self.words[np.arange(len(offset)), offset] if self.words.size else np.zeros(0, np.uint64)
        by = np.argsort(token, kind="stable")
        self.entry_window, self.entry_offset = by, offset[by]
        self.tokens, first = np.unique(token[by], return_index=True)
        self.entries_ptr = np.append(first, len(by))
        self.sieve = sieve_of(self.tokens)


def sieve_of(tokens: np.ndarray, bits: int = 20) -> np.ndarray:
    out = np.zeros(1 << bits, bool)
    out[(tokens & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


def locate(h: np.ndarray, tokens: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in h, index in the sorted tokens) of the words that are tokens."""
    at = np.flatnonzero(sieve[(h & np.uint64(len(sieve) - 1)).astype(np.int64)])
    if not len(at) or not len(tokens):
        return at[:0], at[:0]
    k = np.minimum(np.searchsorted(tokens, h[at]), len(tokens) - 1)
    same = tokens[k] == h[at]
    return at[same], k[same]


def item_hashes(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for i, j, w in chunks(pa.array(texts, pa.large_string()), ALNUM):
        h = w.hashes()
        out += [h[w.ptr[d] : w.ptr[d + 1]] for d in range(j - i)]
    return out


def _spread(ptr: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the range ptr[k]:ptr[k + 1]: (which of k, element)."""
    n = ptr[k + 1] - ptr[k]
    which = np.repeat(np.arange(len(k)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[k], n)


#: Pairs of an occurrence and a window that are compared at once.
PAIRS = 1 << 20


def window_hits(index: WindowIndex, h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in texts with word hashes ``h``."""
    every, tokens = locate(h, index.tokens, index.sieve)
    total = np.cumsum(index.entries_ptr[tokens + 1] - index.entries_ptr[tokens])
    cuts = np.searchsorted(total, np.arange(PAIRS, int(total[-1]) + 1 if len(total) else 0, PAIRS))
    out = [_window_hits(index, h, ptr, at, k) for at, k in zip(np.split(every, cuts), np.split(tokens, cuts), strict=True)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _window_hits(index: WindowIndex, h: np.ndarray, ptr: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which, entry = _spread(index.entries_ptr, k)
    window, begin = index.entry_window[entry], at[which] - index.entry_offset[entry]
    text = np.searchsorted(ptr, at[which], side="right") - 1
    inside = (begin >= ptr[text]) & (begin + index.length[window] <= ptr[text + 1])
    window, begin = window[inside], begin[inside]
    for slot in range(index.words.shape[1]):
        longer = index.length[window] > slot
        same = ~longer
        same[longer] = h[begin[longer] + slot] == index.words[window[longer], slot]
        window, begin = window[same], begin[same]
    return begin, window


def _counts(docs: DataFrame, text: str, index) -> np.ndarray:
    """Corpus counts of the block's vocabulary, over all documents."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(index.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        total, sieve = np.zeros(len(words), np.int64), sieve_of(words)
        for batch in batches:
            for _, _, w in chunks(batch.column(0), ALNUM):
                total += np.bincount(locate(w.hashes(), words, sieve)[1], minlength=len(words))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    out = np.zeros(len(index.vocabulary), np.int64)
    if len(out):
        for row in docs.select(F.col(text)).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
            out[row.k] = row.n
    return out


_HITS = "struct<n_words:bigint,begins:array<bigint>,ends:array<bigint>,items:array<string>>"


def _lists(ptr: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(values, kind))


def _mark(shared, text: Column) -> Column:
    @F.arrow_udf(_HITS)
    def mark(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        names = np.array([*index.names, None], object)
        for part in parts:
            n_words, begins, ends, items = [], [], [], []
            n_spans, n_items = [0], [0]
            for i, j, w in chunks(part, ALNUM):
                h = w.hashes()
                begin, window = window_hits(index, h, w.ptr)
                cover = np.zeros(len(h) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + index.length[window], -1)
                b, e = runs(np.cumsum(cover[:-1]) > 0, w.ptr)
                text_of = np.searchsorted(w.ptr, b, side="right") - 1
                begins.append(b - w.ptr[text_of])
                ends.append(e - w.ptr[text_of])
                n_spans += np.bincount(text_of, minlength=j - i).tolist()
                n_words.append(np.diff(w.ptr))
                which, at = _spread(index.items_ptr, window)
                pair = np.unique((np.searchsorted(w.ptr, begin[which], side="right") - 1) * (len(names)) + index.items[at] % len(names)) if len(which) else np.zeros(0, np.int64)
                pair = pair[pair % len(names) != len(names) - 1]
                n_items += np.bincount(pair // len(names), minlength=j - i).tolist()
                items.append(pair % len(names))
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            spans = np.cumsum(n_spans)
            yield pa.StructArray.from_arrays(
                [pa.array(cat(n_words), pa.int64()), _lists(spans, cat(begins), pa.int64()), _lists(spans, cat(ends), pa.int64()), _lists(np.cumsum(n_items), names[cat(items)], pa.string())],
                names=["n_words", "begins", "ends", "items"],
            )

    return mark(text)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(words, items): the distinct windows, as word hashes, with the ids of their items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for k, h in enumerate(item_hashes(batch.column(1).to_pylist())):
                h = h.view(np.int64)
                found = [h[at : at + window] for at in range(max(1, len(h) - window + 1) if len(h) else 0)]
                yield pa.RecordBatch.from_pydict({"words": pa.array(found, pa.list_(pa.int64())), "item": pa.array([names[k]] * len(found), pa.string())})

    return items.mapInArrow(scan, "words array<long>, item string").groupBy("words").agg(F.collect_set("item").alias("items"))


def _count_some(docs: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """(word, n): how often each of ``words`` (word) occurs in the documents."""
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve(words, "word"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in chunks(batch.column(0), ALNUM):
                h = w.hashes()
                word, n = np.unique(h[sieve.value.may_hold(h)], return_counts=True)
                yield pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "n": pa.array(n)})

    counted = docs.select(F.col(text)).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.join(words, "word", "left_semi")


def _occurrences(docs: DataFrame, text: str, tokens: DataFrame, window: int) -> DataFrame:
    """(row, token, at, n_words, first, around): where a token may stand, with the words up to a window to either side."""
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve(tokens, "token"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for i, _, w in chunks(batch.column(1), ALNUM):
                h = w.hashes()
                every = np.flatnonzero(sieve.value.may_hold(h))
                for low in range(0, len(every), 1 << 15):
                    at = every[low : low + (1 << 15)]
                    of = np.searchsorted(w.ptr, at, side="right") - 1
                    first, past = np.maximum(at - window + 1, w.ptr[of]), np.minimum(at + window, w.ptr[of + 1])
                    size = past - first
                    ptr = np.concatenate([[0], np.cumsum(size)])
                    inner = np.arange(ptr[-1]) - np.repeat(ptr[:-1] - first, size)
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array(rows[i + of]), "token": pa.array(h[at].view(np.int64)), "at": pa.array(at - w.ptr[of]), "n_words": pa.array(np.diff(w.ptr)[of]), "first": pa.array(first - w.ptr[of]),
                        "around": pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(h[inner].view(np.int64))),
                    })

    return docs.select("__row", F.col(text)).mapInArrow(scan, "row long, token long, at long, n_words long, first long, around array<long>")


def _word_count(text: Column) -> Column:
    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        out = [np.diff(w.ptr) for _, _, w in chunks(texts, ALNUM)]
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())

    return count(text)


def _judged(n_words: Column, spans: Column, items: Column) -> Column:
    """The verdict from (begins, ends) of hits, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    merged = F.aggregate(
        F.array_sort(spans), start, lambda a, s: F.struct((a["n"] + F.greatest(s["ends"] - F.greatest(s["begins"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["ends"]).alias("upto"))
    )
    return F.struct(n_words.alias("n_words"), merged["n"].alias("n_hit"), F.sort_array(items).alias("items"), ((merged["n"] > 0) & (20 * merged["n"] >= n_words)).alias("contaminated"))


def _by_joins(docs: DataFrame, items: DataFrame, text: str, window: int, out: str) -> DataFrame:
    docs = cut(docs.select(F.struct(*docs.columns).alias("__doc"), F.monotonically_increasing_id().alias("__row"), F.col(text).alias("__text")))
    windows = cut(_windows(items, window).withColumn("wid", F.monotonically_increasing_id()))
    words = windows.select(F.posexplode("words").alias("offset", "word"), "wid")
    counts = _count_some(docs, "__text", cut(words.select("word").distinct()))
    # A word that no document holds is the rarest of all; its window then has no occurrence.
    rarest = words.join(counts, "word", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "word")).alias("r")).where("r.n > 0")
    filed = cut(rarest.join(windows, "wid").select(F.col("r.word").alias("token"), "r.offset", "words", "items"))
    found = _occurrences(docs, "__text", filed.select("token").distinct(), window).join(filed, "token")
    begin, length = F.col("at") - F.col("offset"), F.size("words")
    inside = (begin >= 0) & (begin + length <= F.col("n_words"))
    same = F.slice("around", F.greatest(begin - F.col("first") + 1, F.lit(1)).cast("int"), length) == F.col("words")
    hits = found.where(inside & same).groupBy("row").agg(F.collect_set(F.struct(begin.alias("begins"), (begin + length).alias("ends"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    hits = cut(hits)
    some, clean = split_by_sieve(docs, "__row", hits, "row")
    none = {"spans": F.lit(None).cast(hits.schema["spans"].dataType), "items": F.lit(None).cast("array<string>")}
    every = some.join(hits, F.col("__row") == F.col("row"), "left").drop("row").unionByName(clean.withColumns(none))
    empty = {n: F.coalesce(n, F.array().cast(hits.schema[n].dataType)) for n in none}
    return every.select("__doc", _judged(_word_count(F.col("__text")), empty["spans"], empty["items"]).alias("__verdict")).select(*(F.col(f"__doc.`{c}`") for c in docs.schema["__doc"].dataType.names if c != out), F.col("__verdict").alias(out))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, out: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, items (sorted as strings), contaminated."""
    spark = docs.sparkSession
    importable(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size > block_bytes:
        return _by_joins(docs, items, text, window, out)
    index = WindowIndex([(r.item_id, r.text) for r in items.collect()], window)
    index.order(_counts(docs, text, index))
    marked = docs.withColumn("__hits", _mark(spark.sparkContext.broadcast(index), F.col(text)))
    x = F.col("__hits")
    n_hit = _total(x["ends"]) - _total(x["begins"])
    verdict = F.struct(x["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.sort_array(x["items"]).alias("items"), ((n_hit > 0) & (20 * n_hit >= x["n_words"])).alias("contaminated"))
    return marked.withColumn(out, verdict).drop("__hits")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), out="c")
    return found.select(
        "doc_id",
        "c.n_words",
        "c.n_hit",
        F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "c.items").cast("binary"), 256).alias("items_sha256"),
        "c.contaminated",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, whole."""
    kept = decontaminate(docs, table(spark, sf_dir, "benchmark"), out="__contamination")
    return kept.where(~F.col("__contamination.contaminated")).select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {WINDOW}) AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS s FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM b)),
dw AS (SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS s
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hit AS (SELECT doc_id, item_id, i, dw.l AS l FROM dw JOIN bw ON dw.l = bw.l AND dw.s = bw.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""

QUERIES = {"op8_decontamination": op8_decontamination}
ORACLE_SQL = {"op8_decontamination": _SQL}
