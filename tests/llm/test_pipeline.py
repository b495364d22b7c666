import re

import corpus_pipeline
from countloom.llm import bpe, linededup, neardup
from countloom.llm._spark import table
from tests.llm.test_operators import DIR, LOWER, WORD, _components, _runs


def _contaminated(text, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = pattern.findall(text.translate(LOWER))
    hit = set()
    for item in items:
        v = pattern.findall(item.translate(LOWER))
        for at in range(max(1, len(v) - 12) if v else 0):
            window = v[at : at + 13]
            hit |= {k + z for k in range(len(w) - len(window) + 1) if w[k : k + len(window)] == window for z in range(len(window))}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_against_brute_force(spark):
    docs, columns = table(spark, DIR, "documents"), table(spark, DIR, "documents").columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    items = [r.text for r in table(spark, DIR, "benchmark").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).toArrow())
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert set(got) == {i for i, t in text.items() if any(c.isalpha() for c in t or "")}
        elif name == "line_dedup":
            gone = _runs(text, 50)
            want = {i: "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone[i]) for i, t in text.items()}
            assert got == {i: t for i, t in want.items() if WORD.search(t)}
        elif name == "near_dedup":
            words = {i: WORD.findall(t.translate(LOWER)) for i, t in text.items()}
            sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set() for i, w in words.items()}
            assert set(got) == {i for i, c in _components(sets, 85).items() if i == c}
        else:
            assert set(got) == {i for i, t in text.items() if not _contaminated(t, items)}
        text = got
    final = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    mine = bpe.Bpe(bpe.tokenizer_text(bpe.default_path()))
    assert {r.doc_id: r.n_tokens for r in final} == {i: len(mine.encode(t)) for i, t in text.items()}


def test_run_applies_all_stages(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 100 < got.count() < 200


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows, rows without an id, columns of any name, no rows."""
    run = " ".join(f"palabra{k} de la casa" for k in range(30))
    rows = [(1, run, "es", "s", 9, 0), (1, run, "es", "s", 9, 1), (None, run, None, None, None, 2), (None, run, None, None, None, 3), (2, None, "es", "s", 0, 4), (3, "", "es", "s", 0, 5), (4, "other words entirely here", "en", "t", 25, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, number long")
    got = {name: stage(spark, docs, DIR).collect() for name, stage in corpus_pipeline.STAGES[:-1]}
    assert {r.number for r in got["language_id"]} <= {0, 1, 2, 3, 6}
    # Rows of one id and text are one document there, and the least id is first.
    assert sorted(r.number for r in got["line_dedup"]) == [2, 3, 4, 5, 6]
    kept = got["near_dedup"]
    assert len(kept) == 4 and {r.number for r in kept if r.text == run} <= {0, 1} and {4, 5, 6} <= {r.number for r in kept}
    assert sorted(r.number for r in got["decontamination"]) == list(range(7))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), DIR)
        assert none.columns == docs.columns and none.count() == 0


def test_line_dedup_sends_texts_to_python_once(spark):
    """Memory: each call of a Python function in a task has a worker of its own; texts that lose nothing need none."""
    out = linededup.stage(spark, table(spark, DIR, "documents"), DIR)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_near_dedup_reads_rows_where_they_lie(spark, tmp_path):
    """Disk: no copy of a table that lies in files; its rows keep their numbers, in many files and alike in all columns too."""
    run = " ".join(f"palabra{k} de la casa" for k in range(30))
    rows = [(None, run, 0)] * 3 + [(7, run, 1)] * 3 + [(8 + k, f"words of {k} that are alone here", 8 + k) for k in range(4)]
    for name in ("number", "_metadata"):
        at = f"{tmp_path}/{name} of many files"
        spark.createDataFrame(rows, f"doc_id long, text string, {name} long").repartition(5).write.parquet(at)
        docs = spark.read.parquet(at)
        out = neardup.stage(spark, docs, DIR)
        assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == [rows[3], *rows[6:]]
        assert name == "_metadata" or set(docs.inputFiles()) <= set(out.inputFiles())
