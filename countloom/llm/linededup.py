"""Line dedup by winnowing over line hashes.

A run of lines of ``min_words`` words or more that occurs again later, in the
order of (doc_id, line), is deleted there.  Lines are compared by their words;
lines without a word do not count and are never deleted.

1.  A window is a shortest run of lines, from a line onwards or back from it, with
    ``min_words`` words.  The line with the least hash in each window is its
    fingerprint, so two texts that share a run share the fingerprints of all
    windows in it (the guarantee of winnowing, here counted in words).  Each text
    hands in its distinct fingerprints; hashes found at two places or more are kept.
2.  A second scan finds the places of those (through a bit sieve of bounded size).
    Each is extended both ways to all windows that it stands for, and these are joined by
    the hash of their lines: equal windows are a match.  Places without a repeated
    fingerprint send nothing.
3.  The union of the windows that matched an earlier place is exactly the union of
    all repeated runs: of a longer run, every window inside it matches.  The first
    occurrence of a line is never deleted, as no window with it occurs earlier.
    Only texts that lose lines are joined with what they lose.

Cases: a null text has no lines and stays null.  A null id counts as the least
id; ids may have any type that can be ordered.  Rows with the same id and text are
one document to this operator: their common lines are no repeats, and what is
deleted in one is deleted in all.  A very long text is scanned whole, in one piece.
Other columns are left alone (one that clashes with the result is replaced); empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm._spark import Sieve, cut, forget, importable, split_by_sieve, table
from countloom.llm._words import NON_SPACE, Words, chunks, mix64, span_hash

MIN_WORDS = 50


def worded_lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with words: (hash, number of words, number of the line in its text, text)."""
    breaks = np.flatnonzero(w.data == 10)
    text = np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr))
    line = np.searchsorted(breaks, w.starts)
    first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (text[1:] != text[:-1]))) if len(line) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(line))
    number = line[first] - np.searchsorted(breaks, w.offsets[text[first]])
    return span_hash(w.hashes(), first, last), last - first, number, text[first]


def windows(h: np.ndarray, n: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, past-last line, fingerprint line) of the windows of the texts, forwards and backwards, each once."""
    if not len(h):
        return (np.zeros(0, np.int64),) * 3
    total = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(len(h))
    ends = np.searchsorted(total, total[:-1] + least)  # past-last line of the window from k on
    begins = np.searchsorted(total, total[1:] - least, side="right") - 1
    low, high = np.searchsorted(text, text), np.searchsorted(text, text, side="right")
    fits, back = ends <= high, (begins >= low) & (total[1:] - total[low] >= least)
    pair = np.unique(np.concatenate([np.stack([k[fits], ends[fits]], 1), np.stack([begins[back], k[back] + 1], 1)]), axis=0)
    first, past = pair[:, 0], pair[:, 1]
    size = past - first
    chosen = first.copy()
    for step in range(1, int(size.max(initial=1))):
        longer = size > step
        rival = first[longer] + step
        better = h[rival] <= h[chosen[longer]]
        where = np.flatnonzero(longer)[better]
        chosen[where] = first[where] + step
    return first, past, chosen


def _fingerprints(docs: DataFrame, least: int) -> DataFrame:
    """(seed): the hashes of fingerprints that are found at two places or more of ``docs`` (text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            seed, n = (np.concatenate(x) for x in zip(*held, strict=True))
            seed, at = np.unique(seed, return_inverse=True)
            held.clear()
            return pa.RecordBatch.from_pydict({"seed": pa.array(seed.view(np.int64)), "n": pa.array(np.bincount(at, weights=n).astype(np.int64))})

        for batch in batches:
            for _, _, w in chunks(batch.column(0), NON_SPACE, lower=False):
                h, n, _, text = worded_lines(w)
                held.append(np.unique(h[np.unique(windows(h, n, text, least)[2])], return_counts=True))
            if sum(len(x[0]) for x in held) > 1_000_000:
                yield merged()
        if held:
            yield merged()

    return docs.mapInArrow(scan, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed")


def _extended(docs: DataFrame, seeds, least: int) -> DataFrame:
    """(id, mark, run, low, high): the windows whose fingerprint may be among ``seeds``, with their lines' hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, w in chunks(batch.column(2), NON_SPACE, lower=False):
                h, n, number, text = worded_lines(w)
                first, past, chosen = windows(h, n, text, least)
                again = seeds.value.may_hold(h[chosen])
                first, past = first[again], past[again]
                rows = pa.array(text[first] + i)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(mix64(span_hash(h, first, past)).view(np.int64)),
                        pa.array(number[first], pa.int32()),
                        pa.array(number[past - 1] if len(past) else number[:0], pa.int32()),
                    ],
                    names=["id", "mark", "run", "low", "high"],
                )

    return docs.mapInArrow(scan, f"id {docs.schema['id'].dataType.simpleString()}, mark long, run long, low int, high int")


_CLEAN = "struct<text:string,n_lines:int,n_words:int,removed:array<int>,n_removed_words:int>"


def _clean(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, lows, highs in parts:
        out: list[dict] = [{}] * len(texts)
        for i, j, w in chunks(texts, NON_SPACE, lower=False):
            _, n, number, text = worded_lines(w)
            at = np.searchsorted(text, np.arange(j - i + 1))
            for d in range(j - i):
                mine, words = number[at[d] : at[d + 1]], n[at[d] : at[d + 1]]
                low, high = lows[i + d].as_py(), highs[i + d].as_py()
                whole = texts[i + d].as_py()
                gone = np.zeros(int(mine[-1]) + 2 if len(mine) else 1, np.int64)
                if low:
                    np.add.at(gone, np.array(low), 1)
                    np.add.at(gone, np.array(high) + 1, -1)
                dead = np.cumsum(gone)[mine] > 0
                if dead.any():
                    drop = set(mine[dead].tolist())
                    whole = "\n".join(x for k, x in enumerate(whole.split("\n")) if k not in drop)
                out[i + d] = {"text": whole, "n_lines": len(mine), "n_words": int(words.sum()), "removed": mine[dead].tolist(), "n_removed_words": int(words[dead].sum())}
        yield pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int32()), ("n_words", pa.int32()), ("removed", pa.list_(pa.int32())), ("n_removed_words", pa.int32())]))


def _repeats(docs: DataFrame, min_words: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may lose lines, with the runs they lose or null in __gone; rows that lose none), all columns in __row."""
    spark = docs.sparkSession
    importable(spark)
    key = {"__id": F.col(doc_id), "__mark": F.xxhash64(text)}
    seeds = cut(_fingerprints(docs.select(text), min_words))
    sieve = spark.sparkContext.broadcast(Sieve(seeds, "seed"))
    forget(seeds)
    found = cut(_extended(docs.select(key["__id"].alias("id"), key["__mark"].alias("mark"), F.col(text)), sieve, min_words))
    place: Column = F.struct("id", "mark", "low")
    first = found.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last")).select("run", "first")
    # One row a run on the right: a frequent run's places are split among tasks (AQE), each with that row.
    later = found.join(first, "run").where(place > F.col("first"))
    gone = cut(later.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_set(F.struct("low", "high")).alias("__gone")).withColumn("__key", F.xxhash64("__id", "__mark")))
    forget(found)
    # The other columns travel as one, whose name cannot clash.
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), *(c.alias(k) for k, c in key.items())).withColumn("__key", F.xxhash64("__id", "__mark"))
    hit, whole = split_by_sieve(keyed, "__key", gone, "__key")
    same = hit["__id"].eqNullSafe(gone["__id"]) & (hit["__mark"] == gone["__mark"])
    return hit.join(gone, same, "left").select("__row", "__gone"), whole.select("__row")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id", out: str = "line_dedup") -> DataFrame:
    """``docs`` with a struct column ``out``: text without repeated runs, n_lines, n_words, removed (line numbers), n_removed_words."""
    hit, whole = _repeats(docs, min_words, text, doc_id)
    rows = hit.unionAll(whole.select("__row", F.lit(None).cast(hit.schema["__gone"].dataType).alias("__gone")))
    rows = rows.withColumn("__clean", F.arrow_udf(_clean, _CLEAN)(F.col(f"__row.{text}"), F.col("__gone.low"), F.col("__gone.high")))
    return rows.select(*(F.col(f"__row.`{c}`") for c in docs.columns if c != out), F.col("__clean").alias(out))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), out="r")
    return docs.select("doc_id", "r.n_lines", F.size("r.removed").alias("n_removed"), "r.n_words", "r.n_removed_words", "r.removed", F.col("r.text").alias("text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated runs of lines; one of which no word is left goes."""
    hit, whole = _repeats(docs, MIN_WORDS, "text", "doc_id")
    row = {c: F.col(f"__row.`{c}`") for c in docs.columns}
    # Only texts that may lose lines go to Python, and once: a filter on a deterministic function's result is pushed below it and calls it again, in one more worker for each task.
    clean = F.arrow_udf(_clean, _CLEAN).asNondeterministic()
    hit = hit.withColumn("__clean", clean(row["text"], F.col("__gone.low"), F.col("__gone.high")))
    r = F.col("__clean")
    changed = F.size(r["removed"]) > 0
    columns = row | {"text": r["text"]} | ({"n_chars": F.when(changed, F.length(r["text"])).otherwise(row["n_chars"])} if "n_chars" in row else {})
    kept = hit.where(~changed | (r["n_removed_words"] < r["n_words"])).select(*(c.alias(n) for n, c in columns.items()))
    return kept.unionAll(whole.select(*(c.alias(n) for n, c in row.items())))


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLE_SQL: dict[str, str] = {}
