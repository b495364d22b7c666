"""Operators against brute force, exact round trips and held-out rows."""

import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from countloom.llm import bpe, decontam, graph, langid, linededup, lm, neardup, queries, sharding, superminhash, toxicity, urlfilter
from countloom.llm._words import NON_SPACE, chunks

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR).toPandas()
    want = db.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = columns[[c.endswith("_id") for c in columns].index(True)]
    rows = lambda x: [tuple(None if v is None or v != v else str(v) for v in r) for r in x.sort_values(key)[columns].itertuples(index=False)]
    assert rows(got) == rows(want)


def test_bpe_against_the_library(spark, texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(bpe.default_path())
    mine = bpe.Bpe(bpe.tokenizer_text(bpe.default_path()), cache_words=50)
    odd = ["", "a<|endoftext|>B<|startoftext|>", "ΣΑΣ ς İ ǅ", "don't I'LL we'Ve", "é ẛ̣ ﬁ", "日本語 ١٢٣ ½ Ⅷ", "👩‍👩‍👧 🇩🇪", "x" * 3000, "\x1c a\x85b　c​"]
    for text in [*texts.values(), *odd]:
        ids = known.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.decode(ids) == mine.encode_strings(text)[1] == known.decode(ids, skip_special_tokens=False)


def _log_sum(run, pieces, p):
    """Log of the sum over all segmentations, one byte after the other."""
    known = dict(zip(pieces, np.log(p), strict=True))
    out, most = [0.0], max(map(len, pieces))
    for j in range(1, len(run) + 1):
        ways = [out[i] + known[run[i:j]] for i in range(max(0, j - most), j) if run[i:j] in known]
        out.append(np.logaddexp.reduce(ways) if ways else -np.inf)
    return out[-1]


def test_forward_sums_all_segmentations():
    """Short words, pieces of over 8 bytes, scripts without spaces, and a run of 10000 letters."""
    pieces, rng = langid.default_pieces(), np.random.default_rng(0)
    assert max(map(len, pieces)) > 16
    p = rng.random(len(pieces))
    p /= p.sum()
    table = np.append(p, 0)[:, None]
    made = " ".join("".join(rng.choice(list("abcdeéñ"), size=rng.integers(1, 70))) for _ in range(40))
    texts = ["the internationalization of " + "abcdefghij" * 3, "日本語の文章は空白がないので長い列になる。" * 8 + "Привет—мир", "information" * 40, "", made, "q" + "zxj" * 3333]
    total = 0.0
    for _, _, w, _ in langid.letter_chunks(pa.array(texts)):
        f = langid.Forward(langid.Pieces(pieces), w)
        want = [_log_sum(b" " + w.data[a:b].tobytes(), pieces, p) for a, b in zip(w.starts, w.ends, strict=True)]
        assert np.allclose(f.logs(table)[:, 0], want, rtol=1e-9)
        expected = f.expected(table, np.bincount(f.inverse, minlength=f.count)[:, None].astype(float))
        total = (expected[:-1, 0] * [len(x) for x in pieces]).sum()
        assert np.isclose(total, (w.ends - w.starts + 1).sum())  # every byte lies in one piece of a segmentation
    pieces = [b" ", b"a", b"b", b" a", b"ab", b"ba", b" ab", b"bab"]
    p = np.array([0.2, 0.1, 0.15, 0.05, 0.1, 0.2, 0.1, 0.1])
    (_, _, w, _), = langid.letter_chunks(pa.array(["ab abab b", "bab"]))
    got = langid.Forward(langid.Pieces(pieces), w).logs(np.append(p, 0)[:, None])[:, 0]
    assert np.allclose(got, [_log_sum(x, pieces, p) for x in (b" ab", b" abab", b" b", b" bab")])


def test_language_id_on_held_out_rows(spark):
    got = queries.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.001").toPandas()
    lang = pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "lang"]).to_pandas()
    held = got.merge(lang, on="doc_id").query("held_out")
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert set(got.held_out[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]) == {True}


def test_toxicity_on_held_out_rows(spark):
    got = queries.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas()
    held = got.merge(labels, on="doc_id").query("held_out")
    toxic, clean = held.score[held.toxic == 1], held.score[held.toxic == 0]
    assert np.mean([[a > b for b in clean] for a in toxic]) > 0.9
    assert (got.predicted == (got.score >= 0.7)).all()


def _runs(texts, least):
    """Lines in a run that occurred before, by comparing all pairs of equal lines."""
    lines = {i: [(k, tuple(WORD.findall(s))) for k, s in enumerate((t or "").split("\n")) if WORD.search(s)] for i, t in sorted(texts.items())}
    places: dict = {}
    for i, ls in lines.items():
        for p, (_, w) in enumerate(ls):
            places.setdefault(w, []).append((i, p))
    gone = {i: set() for i in lines}
    for at in places.values():
        for y in range(len(at)):
            for x in range(y):
                (i, p), (j, q) = at[x], at[y]
                k = n = 0
                while p + k < len(lines[i]) and q + k < len(lines[j]) and lines[i][p + k][1] == lines[j][q + k][1]:
                    n += len(lines[i][p + k][1])
                    k += 1
                if n >= least:
                    gone[j] |= {lines[j][q + z][0] for z in range(k)}
    return {i: sorted(v) for i, v in gone.items()}


@pytest.mark.parametrize("least", [50, 3])
def test_line_dedup_against_all_pairs(spark, texts, least):
    made = {1000 + k: "\n".join(["a b", "c d e", "f", "", "a b", "c d e", "f"][k % 3 :] + ["tail %d" % k]) for k in range(6)}
    every = texts | made
    df = spark.createDataFrame(sorted(every.items()), "doc_id long, text string")
    got = {r.doc_id: r.d for r in linededup.dedup_lines(df, least, out="d").collect()}
    want = _runs(every, least)
    assert {i: r.removed for i, r in got.items()} == want
    for i, r in got.items():
        assert r.text == "\n".join(s for k, s in enumerate(every[i].split("\n")) if k not in want[i])


def _components(sets, percent):
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("tile", "task_edges"), [(256, 1_000_000), (3, 4)])
def test_near_duplicates_against_all_pairs(spark, texts, tile, task_edges):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    made = {}
    for k in range(40):  # a chain of near copies, each a few words from the one before
        base[int(rng.integers(0, 120))] = f"v{k}"
        made[5000 + k] = " ".join(base)
    every = texts | made | {6000: "one two", 6001: "ONE  two", 6002: "one"}
    sets = {}
    for i, t in every.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    df = spark.createDataFrame(sorted(every.items()), "doc_id long, text string")
    got = neardup.near_duplicates(df, 3, 85, tile=tile, task_edges=task_edges).toPandas()
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == _components(sets, 85)
    assert all(n == len(sets[i]) for i, n in zip(got.doc_id, got.n_shingles, strict=True))
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 1 << 60, 4000).astype(np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[100:400])
    s = superminhash.signatures(np.concatenate([a, b]), np.array([0, 300, 600]), 240)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.12
    assert np.array_equal(s[0], superminhash.signatures(a, np.array([0, 300]), 240)[0])


def test_components_by_joins_and_in_one_task(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 101), (7, 7), (50, 51)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, many = ({r.key: r.label for r in graph.components(df, n).collect()} for n in (1000, 2))
    assert one == many and one[30] == 0 and one[102] == 100 and one[51] == 50


def test_lm_counts_and_scores(spark, texts):
    got = {r.doc_id: r for r in lm.op2_lm_scoring(spark, DIR).collect()}
    tokens = {i: WORD.findall(t.translate(LOWER)) + [None] for i, t in texts.items()}
    count: dict = {}
    for i, ts in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for w in ts:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, ts in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(w in count for w in ts), n)
        assert np.isclose(r.base_score, sum(np.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ts))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def _toy_counts():
    words = [f"w{k}" for k in range(60)]
    (_, _, w), = chunks(pa.array([" ".join(words)]), NON_SPACE)
    h, kind, size = w.hashes(), lm.spellings(w), 16
    order, count = np.argsort(h), np.arange(60, 0, -1)
    head = np.array([5, *range(60, 45, -1)])
    tail_tokens, tail_words = np.zeros(lm.SPELLINGS, np.int64), np.zeros(lm.SPELLINGS, np.int64)
    np.add.at(tail_tokens, kind[15:], count[15:])
    np.add.at(tail_words, kind[15:], 1)
    by_spelling = np.arange(lm.SPELLINGS) % lm.GROUPS
    group = np.concatenate([[0], by_spelling[kind[:15]], by_spelling])
    rank = np.arange(1, 61)
    return words, lm.Counts(h[order], rank[order], np.log10(count[order] + 0.5), int(count.sum()) + 5, 61, 5, head, tail_tokens, tail_words, group)


def _toy_weights(counts):
    rng, size = np.random.default_rng(0), len(counts.head)
    bias, before, skip, pair = (rng.normal(0, 0.3, x) for x in (lm.GROUPS, (size, lm.GROUPS), (lm.SKIPS, lm.GROUPS), (size, lm.SLOTS, lm.GROUPS)))
    word = lm.word_logs(lm._word_bias(counts), rng.normal(0, 0.3, (size, size + lm.SPELLINGS)), counts.group)
    return lm.Weights(bias, before, skip, pair, lm.class_logs(bias, before, skip, pair)[1], word)


def test_lm_is_a_distribution():
    """Over a closed vocabulary and one unknown word a spelling, the next token's probabilities sum to one."""
    words, counts = _toy_counts()
    m = _toy_weights(counts)

    def last(text):
        (_, _, w), = chunks(pa.array([text]), NON_SPACE)
        t = lm.tokens_of(w, counts)
        return t, 10 ** lm.token_scores(m, counts, t)

    t, p = last("w3 w20 ")
    total = p[2]
    for x in words:
        t, p = last("w3 w20 " + x)
        total += p[2] * (10 ** counts.logs[t.at[2]] if t.target[2] >= len(counts.head) else 1)
    # Unknown words: what every spelling keeps for them.
    a, b = t.before[2], t.skip[2]
    z = m.bias + m.before[a] + m.skip[b] + m.pair[a, lm._SLOT[b]]
    share = np.exp(z) / np.exp(z).sum()
    spelled = np.arange(lm.SPELLINGS) + len(counts.head)
    total += (share[counts.group[spelled]] * np.exp(m.words[a, spelled]) * 0.5 / (counts.tail_tokens + (counts.tail_words + 1) / 2)).sum()
    # Classes in which no word or spelling lies have no weight to give.
    assert set(counts.group) == set(range(lm.GROUPS)) and np.isclose(total, 1.0, atol=1e-6)


def test_lm_steps_follow_the_gradient():
    """The steps of class and word weights against sums over single tokens."""
    _, counts = _toy_counts()
    m, size = _toy_weights(counts), len(counts.head)
    rng = np.random.default_rng(1)
    events = [(int(a), int(b), int(t)) for a, b, t in zip(rng.integers(0, 3, 200), rng.integers(0, lm.SKIPS, 200), rng.integers(0, size + lm.SPELLINGS, 200))]
    n, words = np.zeros((3, lm.SKIPS, lm.GROUPS)), np.zeros((3, size + lm.SPELLINGS))
    seen = {k: np.zeros(x.shape) for k, x in (("before", m.before[:3]), ("skip", m.skip), ("pair", m.pair[:3]))}
    expected, likely = {k: np.zeros(x.shape) for k, x in seen.items()}, np.zeros(words.shape)
    bias = lm._word_bias(counts)
    for a, b, t in events:
        g, slot = counts.group[t], lm._SLOT[b]
        n[a, b, g] += 1
        words[a, t] += 1
        z = np.exp(m.bias + m.before[a] + m.skip[b] + m.pair[a, slot])
        for k, at in (("before", a), ("skip", b), ("pair", (a, slot))):
            seen[k][at + (g,) if isinstance(at, tuple) else (at, g)] += 1
            expected[k][at] += z / z.sum()
        mine = counts.group == g
        likely[a, mine] += np.exp(bias[mine]) / np.exp(bias[mine]).sum()
    before, pair, some, rest = lm.class_step(n, m.bias, m.before[:3], m.skip, m.pair[:3])
    step = lambda w, s, e: w + lm.STEP * (s - e - lm.PRIOR * w) / (np.maximum(s, e) + lm.PRIOR)
    assert np.allclose(before, step(m.before[:3], seen["before"], expected["before"]))
    assert np.allclose(pair, step(m.pair[:3], seen["pair"], expected["pair"]))
    assert np.allclose(some, seen["skip"]) and np.allclose(rest, expected["skip"])
    assert np.allclose(lm.fit_words(words, counts, 1), lm.word_logs(bias, step(0, words, likely), counts.group))


def test_lm_gains_over_single_words(spark):
    """Held-out texts of two made languages, whose words share no spelling."""
    rng = np.random.default_rng(5)
    words = [[x + "".join(rng.choice(list(tail), 4)) for x in head for _ in range(4)] for head, tail in (("abcde", "fghij"), ("klmno", "pqrst"))]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words[k % 2], 60))) for k in range(400)], "doc_id long, text string")
    counts, others = lm.count_words(docs.where("doc_id < 300").select("text"), most=100)
    got = lm.score(docs.where("doc_id >= 300"), lm.train(docs.where("doc_id < 300"), counts), counts, others).toPandas()
    assert ((got.score - got.base_score) / got.n_tokens).mean() > 0.2  # two equal languages: 0.3 at most


def test_sharding_keeps_groups(spark):
    rows = [(k, f"text {k // 4}") for k in range(400)] + [(1000 + k, "hot") for k in range(200)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).toPandas()
    n = got.groupby("shard").size()
    assert n.sum() == 600 and n.max() - n.min() <= 1
    groups = got[got.doc_id < 1000].groupby(got.doc_id // 4).shard.nunique()
    assert (groups > 1).mean() < 0.15
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


@pytest.mark.parametrize("shared", ["see {} there", "a line that is much longer than eighty characters, as passages of documents are, number {}"])
def test_sharding_links_by_every_line(spark, shared):
    def own(k):
        return "\n".join(f"document {k} has this line, which is longer than eighty characters, for itself alone: {x}" for x in range(20))

    rows = [(k, own(k) + "\n" + shared.format(k // 4)) for k in range(400)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).toPandas()
    assert got.groupby("shard").size().tolist() == [50] * 8
    assert (got.groupby(got.doc_id // 4).shard.nunique() > 1).mean() < 0.2


def test_propagation_leaves_fewer_links_cut(spark):
    """Documents with texts of their own, four to a shared line: without rounds nearly all links are cut."""
    df = spark.createDataFrame([(k, f"own words of {k}\nthe line that four share, number {k // 4}") for k in range(400)], "doc_id long, text string")
    none, some = (sharding.assign(df, shards=8, rounds=r).toPandas() for r in (0, 8))
    assert (none.n_links == 3).all() and none.n_cut.sum() > 0.7 * none.n_links.sum()
    assert some.n_cut.sum() < 0.3 * none.n_cut.sum() and some.groupby("shard").size().tolist() == [50] * 8
    shard = some.set_index("doc_id").shard
    assert all(r.n_cut == sum(shard[d] != r.shard for d in range(r.doc_id // 4 * 4, r.doc_id // 4 * 4 + 4)) for r in some.itertuples())


def test_sharding_query_against_its_contract(spark, texts):
    got = queries.QUERIES["op4_sharding"](spark, DIR).toPandas()
    raw = {i: (t or "").encode() for i, t in texts.items()}
    assert set(got.doc_id) == set(raw) and (got.law == "rows").all() and got.grown_shard.isna().all()
    assert all((n, c) == (len(raw[i]) + 8, zlib.crc32(raw[i])) for i, n, c in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True))
    n = got.groupby("shard").size()
    assert set(got.shard) <= set(range(24)) and n.max() - n.reindex(range(24), fill_value=0).min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_sharding_sums_over_hubs(spark):
    state = spark.createDataFrame([(0, 7, 3), (1, 7, 0), (2, 8, 1), (3, 9, 1), (4, 7, 0)], "rid long, lead long, shard int")
    # Row 0 meets shard 0 in one hub and shard 1 in two.
    links = spark.createDataFrame([(0, 7, 3), (1, 7, 3), (4, 7, 3), (0, 8, 2), (2, 8, 2), (0, 9, 2), (3, 9, 2)], "rid long, hub long, members long")
    assert {r.rid: r.to for r in sharding._wanted(*sharding._votes(state, links)).collect()}[0] == 1


def test_decontamination_in_blocks(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    one, many = ({r.doc_id: r.c for r in decontam.decontaminate(docs, items, out="c", block_bytes=b).collect()} for b in (1 << 24, 4000))
    assert one == many and any(c.n_hit for c in one.values())


def test_rule_tokens():
    assert urlfilter.literal_tokens(r"\bcasino\b.*/win/") == ["casino", "win"]
    assert urlfilter.literal_tokens(r"adult[a-z]+") == []
    assert urlfilter.literal_tokens(r"[/.]track\.") == ["track"]
    index = urlfilter.UrlIndex([r"\bcasino\b.*/win/", r"x+y"], [], {"casino": 5, "win": 2})
    assert list(index.by_token) == ["win"] and index.untokened == [1]


def test_rules_by_token_are_all_rules():
    """The first rule that matches, among rules with options, alternatives and sets, against running every rule."""
    rng = np.random.default_rng(1)
    patterns = [*urlfilter.PATTERNS, r"/(a|b|cd)x?/", r"\bfoo[12]\b", r"(?=zz)x", r"q{2,3}", r"^http:", r"\.zip$", r"[^a]b/", r"a|\bb\b"]
    index = urlfilter.UrlIndex(patterns, [], {"ads": 3})
    words = ["casino", "win", "free", "bets", "spins", "ads", "ad", "track", "serve", "banner", "banners", "popup", "12", "cd", "cdx", "ax", "foo1", "foo3", "b", "qq", "zip", "affiliate", "doubleclick", "adult", "spam", "farm"]
    for _ in range(3000):
        url = "http://" + "".join(rng.choice(words) + rng.choice(["-", "/", ".", "?", "&", "=", "", "_"]) for _ in range(6))
        assert index.pattern(url) == next((p for p in patterns if re.search(p, url, re.ASCII)), None)
    assert not set(index.untokened) & set(range(len(urlfilter.PATTERNS)))


def test_rule_tables_in_blocks(spark):
    """Many rules, in one block and in several, as lists and as tables."""
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.net/de/8/word{k}/x") for k in range(60)], "page_id long, url string")
    patterns = [rf"\bword{k}\b" for k in range(0, 3000, 2)]
    hosts = [urlfilter.HostRule("block", f"h{k}.net/de/") for k in range(3)] + [urlfilter.HostRule("allow", "h1.net/de/8")]
    tables = spark.createDataFrame(list(enumerate(patterns)), "place int, pattern string"), spark.createDataFrame(hosts, "verdict string, text string")
    one, many = ({r.page_id: tuple(r.v) for r in urlfilter.filter_urls(pages, *rules, out="v", block_bytes=b).collect()} for rules, b in (((patterns, hosts), 1 << 24), (tables, 100_000)))
    assert one == many and one[1][2:] == ("h1.net/de/8", "allow", None) and one[4][2:] == (None, "block", r"\bword4\b")


def test_toxic_grams_stay_within_texts():
    (_, _, points, offsets), = toxicity.gram_chunks(pa.array(["abcd", "", None, "ABCDE"]))
    text, gram = toxicity.text_grams(points, offsets)
    assert np.bincount(text, minlength=4).tolist() == [3, 0, 0, 6]
    assert set(gram[text == 0]) < set(gram[text == 3])
