"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from countloom.llm import bpe, decontam, langid, linededup, lm, neardup, quality, sharding, toxicity, urlfilter

LONG = " ".join(f"w{k % 997} x{k % 13}" for k in range(40_000))
ROWS = [
    (1, "The cat sat on the mat. It was glad of the sun and of the day.", "en"),
    (1, "The cat sat on the mat. It was glad of the sun and of the day.", "en"),
    (2, "", None),
    (3, None, "en"),
    (None, "Der Hund lief durch den Wald und fand ein altes Haus.", "de"),
    (4, " \n\t ", "de"),
    (5, LONG, "en"),
    (6, "!!! ??? 123", None),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = [F.lit("z").alias(c) for c in ("shingles", "key", "node", "n", "rid", "seed", "word", "id", "label", "shard", "hub", "bands", "tile")]
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *extra)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, none):
    got = {(r.doc_id, (r.text or "")[:5]): r.q for r in quality.judge(docs, out="q").collect()}
    assert got[3, ""].n_words == 0 and got[3, ""].base_failed and not got[3, ""].kept
    assert got[5, LONG[:5]].n_words == 80_000 and got[5, LONG[:5]].base_failed is True  # its windows repeat
    assert got[4, " \n\t "].n_dup_lines == 0
    assert quality.judge(none, out="q").count() == 0
    assert set(docs.columns) <= set(quality.judge(docs, out="q").columns)


def test_language_id(docs, none):
    model = langid.fit(docs, langid.default_pieces())
    got = langid.identify(docs, model, out="v")
    by = {r.doc_id: r.v for r in got.collect()}
    assert got.count() == len(ROWS) and set(docs.columns) < set(got.columns)
    assert by[2].lang_pred == by[3].lang_pred == by[6].lang_pred == "und" and by[3].score == 0
    assert by[5].lang_pred in ("en", "de") and 0 < by[5].score <= 1
    empty = langid.fit(none, langid.default_pieces())
    assert {r.v.lang_pred for r in langid.identify(docs, empty, out="v").collect()} == {"und"}
    assert langid.identify(none, model, out="v").count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (2, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    scores = toxicity.score(docs, model, out="s").collect()
    assert len(scores) == len(ROWS) and all(0 <= r.s <= 1 for r in scores)
    nothing = toxicity.fit(docs.select("doc_id", "text"), labels.limit(0))
    assert all(r.s < 1e-6 for r in toxicity.score(docs, nothing, out="s").collect())
    assert toxicity.score(none, model, out="s").count() == 0


def test_sharding(docs, none):
    got = sharding.assign(docs, shards=3).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(3)]
    assert sum(sizes) == len(ROWS) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in enumerate(sizes))
    assert {r.doc_id: (r.size, r.text_crc32) for r in got}[3] == (8, 0)
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sharding.assign(none).count() == 0


def test_bpe(docs, none):
    got = bpe.encode(docs, bpe.default_path(), out="b").collect()
    by = {r.doc_id: r.b for r in got}
    assert by[2].ids == by[3].ids == by[4].ids == [] and by[3].decoded == ""
    assert len(by[5].ids) > 80_000
    assert bpe.encode(none, bpe.default_path(), out="b").count() == 0


def test_line_dedup(docs, none):
    got = linededup.dedup_lines(docs, min_words=5, out="d").collect()
    by = {r.doc_id: r.d for r in got}
    assert by[3].text is None and by[2].n_lines == 0 and by[4].n_lines == 0
    assert all(r.d.removed == [] for r in got)  # equal ids and texts are one document
    assert linededup.dedup_lines(none, out="d").count() == 0


def test_lm(docs, none):
    training = docs.where("doc_id is not null").select("text", (F.col("doc_id") % 3).cast("int").alias("part"))
    counts, others = lm.count_words(training.select("text"), most=3)
    weights = lm.train(training, counts)
    got = lm.score(docs.select("doc_id", "text"), weights, counts, others).collect()
    by = {r.doc_id: r for r in got}
    assert by[3].n_tokens == 1 and by[3].n_known == 1 and by[5].n_tokens == 80_001
    assert all(r.score < 0 for r in got) and len(got) == len(ROWS)
    counts, others = lm.count_words(none.select("text"))
    blank = lm.train(none.select("text", F.lit(0).alias("part")), counts)
    got = lm.score(docs.select("doc_id", "text"), blank, counts, others).collect()
    assert all(r.n_known == 0 and abs(r.base_score) < 1e-6 for r in got)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(7, "cat sat on THE mat"), (8, None), (None, "ein altes haus"), (9, ""), (7, "cat sat on THE mat")], "item_id long, text string")
    by = {r.doc_id: r.c for r in decontam.decontaminate(docs, items, out="c").collect()}
    assert by[1].n_hit == 5 and by[1]["items"] == ["7"] and by[1].contaminated
    assert by[None].n_hit == 3 and by[None]["items"] == [] and by[None].contaminated
    assert by[3].n_words == 0 and not by[3].contaminated and by[5].n_hit == 0
    assert decontam.decontaminate(none, items, out="c").count() == 0
    assert {r.c.n_hit for r in decontam.decontaminate(docs, items.limit(0), out="c").collect()} == {0}


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "://"), (4, "http://A.Example.com/en/7?q#f"), (4, "http://A.Example.com/en/7?q#f"), (5, "x" * 100_000)], "page_id long, url string")
    by = {r.page_id: r.v for r in urlfilter.filter_urls(pages, out="v").collect()}
    assert (by[1].host, by[1].path, by[1].verdict) == ("", "", "allow") == (by[3].host, by[3].path, by[3].verdict)
    assert (by[4].host, by[4].path, by[4].rule, by[4].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert urlfilter.filter_urls(pages.limit(0), out="v").count() == 0


def test_near_duplicates(docs, none):
    got = neardup.near_duplicates(docs, words=3, percent=85).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[2].component_id == 2
    assert by[1].kept and by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(none).count() == 0
