"""Quality rules, line first, in DataFrame expressions only.

Every line is judged alone: a line of symbols or of words that all shout
(punctuation rules), a line of links (navigation), or one with a stock phrase
(boilerplate) fails and is removed.  A document that loses more than
``MAX_LOST`` of its words that way is rejected, as is one that fails the base
rules (too few words; too many words in repeated 8-word windows).

Repeated windows are found within the row: hashes of the windows are compared
with their distinct set, and only where some repeat are they sorted to mark the
words they cover.  Equal 64-bit hashes stand for equal windows.

Cases: a null text has no words, all its counts are 0 and it fails the base
rules; lines without a word are never counted or removed.  Repeated rows are
judged one by one; other columns are left alone; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm._spark import table

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Largest share of a document's words, in percent, that failing lines may hold.
MAX_LOST_PERCENT = 30

_SPACE = r"\x20\x09-\x0D"
_WORD = rf"[^{_SPACE}]+"
_SYMBOL = r"[#*$%&|<>]"
# Patterns below avoid features on which Java's and RE2's syntax differ.
SHOUT = r"!!"
LINK_BREAK = rf"[{_SPACE}][|>\x{{BB}}\x{{B7}}][{_SPACE}]"
MENU = r"^[^a-z0-9]*(home|menu|login|log in|sign in|sign up|register|search|sitemap|next|previous|contact us|about us|read more|skip to content)[^a-z0-9]*$"
BOILERPLATE = r"all rights reserved|terms of (use|service)|privacy policy|cookie policy|we use cookies|licensed under|subscribe to our|enable javascript|lorem ipsum|powered by|click here"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def line_fails(line: Column, n_words: Column) -> Column:
    """Whether one line, with ``n_words`` words, breaks a rule."""
    low = F.lower(line)
    punctuation = (10 * count_of(line, _SYMBOL) > F.length(line)) | (2 * count_of(line, SHOUT) > n_words)
    navigation = (4 * count_of(line, LINK_BREAK) > n_words) | low.rlike(MENU)
    return punctuation | navigation | low.rlike(BOILERPLATE)


def repeated_words(windows: Column, size: int = WINDOW) -> Column:
    """Words covered by windows (given by hash, in order) that occur twice or more."""

    def marked(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    covered = F.aggregate(
        let(pairs, marked),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, p: F.struct((a["n"] + p + size - F.greatest(p, a["upto"])).alias("n"), (p + size).alias("upto")),
    )["n"]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)


def judge(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: the counts, the base verdict, kept, the share lost and the text without failing lines."""
    w, h, x, m = (f"__{out}_{k}" for k in ("words", "hashes", "windows", "lines"))
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn(w, words_of(t))
    lines = F.transform(F.split(t, "\n"), lambda s: F.struct(s.alias("s"), count_of(s, _WORD).alias("n")))
    d = d.withColumn(h, F.transform(w, lambda s: F.xxhash64(s)))
    d = d.withColumn(m, F.transform(lines, lambda s: F.struct(s["s"].alias("s"), s["n"].alias("n"), ((s["n"] > 0) & line_fails(s["s"], s["n"])).alias("bad"))))
    at = F.col(h)
    window = lambda _, i: F.xxhash64(*(F.get(at, i + k) for k in range(WINDOW)))
    n_windows = F.greatest(F.size(h) - WINDOW + 1, F.lit(0))
    d = d.withColumn(x, F.transform(F.slice(at, F.lit(1), n_windows), window))
    n_words = F.size(w).cast("long")
    spoken = F.filter(m, lambda s: s["n"] > 0)
    repeat = repeated_words(F.col(x)).cast("long")
    lost = F.aggregate(m, F.lit(0).cast("long"), lambda a, s: a + F.when(s["bad"], s["n"]).otherwise(0))
    d = d.withColumn(
        out,
        F.struct(
            n_words.alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            count_of(t, _SYMBOL).cast("long").alias("n_symbols"),
            let(F.transform(spoken, lambda s: s["s"]), lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
            repeat.alias("n_repeat_words"),
            lost.alias("lost_words"),
            F.array_join(F.transform(F.filter(m, lambda s: ~s["bad"]), lambda s: s["s"]), "\n").alias("cleaned"),
        ),
    )
    o = F.col(out)
    base_failed = (o["n_words"] < MIN_WORDS) | (100 * o["n_repeat_words"] > MAX_REPEAT_PERCENT * o["n_words"])
    kept = ~base_failed & (100 * o["lost_words"] <= MAX_LOST_PERCENT * o["n_words"])
    return d.withColumn(out, o.withField("base_failed", base_failed).withField("kept", kept)).drop(w, h, x, m)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")
    return judge(docs, out="q").select("doc_id", *(f"q.{f}" for f in fields))


def _sql() -> str:
    breaks = LINK_BREAK
    bad = (
        f"(10 * len(regexp_extract_all(s, '{_SYMBOL}')) > length(s) OR 2 * len(regexp_extract_all(s, '{SHOUT}')) > n"
        f" OR 4 * len(regexp_extract_all(s, '{breaks}')) > n OR regexp_matches(lower(s), '{MENU}') OR regexp_matches(lower(s), '{BOILERPLATE}'))"
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT doc_id, s, len(regexp_extract_all(s, '{_WORD}')) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS s FROM d)),
per AS (SELECT doc_id, count(*) - count(DISTINCT s) AS n_dup_lines, sum(CASE WHEN {bad} THEN n ELSE 0 END) AS lost_words FROM l WHERE n > 0 GROUP BY 1),
win AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM rep) GROUP BY 1),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '{_SYMBOL}')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
      FROM d LEFT JOIN per USING (doc_id) LEFT JOIN cov USING (doc_id)),
g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost_words <= {MAX_LOST_PERCENT} * n_words AS kept, lost_words
FROM g"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL = {"op1_quality_rules": _sql()}
