import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from countloom.llm import _spark
from countloom.llm._words import ALNUM, NON_SPACE, chunks

TEXT = st.text(alphabet="aB9 \t\n\x0b\x0c\r.-éß漢\x85\xa0", max_size=40)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.sampled_from([1, 20, 1 << 20]))
def test_words_match_the_patterns(texts, limit):
    for table, pattern in ((NON_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = []
        for i, j, w in chunks(pa.array(texts, pa.string()), table, limit=limit):
            assert len(w.ptr) == j - i + 1
            for d in range(j - i):
                found.append([w.data[a:b].tobytes().decode() for a, b in zip(w.starts[w.ptr[d] : w.ptr[d + 1]], w.ends[w.ptr[d] : w.ptr[d + 1]])])
        assert found == [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]


def test_hashes_follow_the_words_only():
    (_, _, w), = chunks(pa.array(["one two one", "two  three one", ""]), NON_SPACE)
    h = w.hashes()
    words = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends)]
    assert len(set(h.tolist())) == len(set(words))
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(len(h)))


def test_empty_column():
    assert list(chunks(pa.array([], pa.string()), NON_SPACE)) == []
    (_, _, w), = chunks(pa.array([None, ""]), NON_SPACE)
    assert len(w.hashes()) == 0 and np.array_equal(w.ptr, [0, 0, 0])


def test_sieves_never_miss(spark):
    """Values that are among the held ones always pass, in numpy and as a broadcast table; most others do not."""
    held = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h"))
    every = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    some, rest = _spark.split_by_sieve(every, "h", held, "h")
    got = {r.id for r in some.collect()}
    assert set(range(0, 3000, 3)) <= got and len(got) < 1500 and some.columns == rest.columns == every.columns
    assert got | {r.id for r in rest.collect()} == set(range(3000)) and not got & {r.id for r in rest.collect()}
    values = every.orderBy("id").toPandas().h.to_numpy()
    may = _spark.Sieve(held, "h").may_hold(values)
    assert may[::3].all() and may.mean() < 0.5
    none, rest = _spark.split_by_sieve(every, "h", held.limit(0), "h")
    assert none.count() == 0 and rest.count() == 3000
