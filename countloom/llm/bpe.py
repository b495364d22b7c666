"""BPE encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list; a priority queue holds (rank, place)
of every adjacent pair that can merge.  The smallest entry is taken; it is stale,
and skipped, if its symbols have changed since.  Decoding joins the
vocabulary's strings by one space, as the file names no decoder.  Words repeat,
so a worker keeps its latest encodings in two bounded generations.

Supported files: JSON of the tokenizers library with a BPE model, an end-of-word
suffix, the byte-level alphabet and the normalisation NFC, white space, lower
case; anything else raises.  Cases: a null text is an empty one and has no
tokens; repeated rows are encoded one by one; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm._spark import importable, table
from countloom.llm._words import trim

#: Words kept in each of a worker's two generations.
CACHE_WORDS = 60_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Bpe:
    """A tokenizer read from its JSON text."""

    def __init__(self, raw: str, cache_words: int = CACHE_WORDS):
        spec = json.loads(raw)
        model = spec["model"]
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split, level = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or not split["invert"] or split["behavior"] != "Removed" or level["type"] != "ByteLevel" or level["use_regex"] or spec["decoder"]:
            raise ValueError("not a supported tokenizer file")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.special_at = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.word_at = regex.compile(split["pattern"]["Regex"])
        self.alphabet = byte_alphabet()
        self.cache_words = cache_words
        self._young: dict[str, tuple[str, str, int]] = {}
        self._old: dict[str, tuple[str, str, int]] = {}

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        letters = [self.alphabet[b] for b in word.encode("utf-8", "replace")]
        letters[-1] += self.suffix
        symbols = [self.ids[x] for x in letters if x in self.ids]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges, queue = self.merges, []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, merged, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = merges.get((merged, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1], merged, symbols[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], merged))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1], symbols[h], merged))
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> tuple[str, str, int]:
        got = self._old.get(word)
        if got is None:
            ids = self.word_ids(word)
            got = (" ".join(map(str, ids)), " ".join([self.strings[i] for i in ids]), len(ids))
        if len(self._young) >= self.cache_words:
            self._old, self._young = self._young, {}
        if len(word) < 200:
            self._young[word] = got
        return got

    def _pieces(self, text: str) -> Iterator[tuple[str, str, int]]:
        plain, at = [], 0
        if self.special_at and any(x in text for x in self.special):
            for m in self.special_at.finditer(text):
                plain += [(text[at : m.start()], None), ("", m[0])]
                at = m.end()
        plain.append((text[at:], None))
        for part, special in plain:
            if special:
                yield str(self.special[special]), special, 1
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            known = self._young
            for word in self.word_at.findall(part.lower()):
                got = known.get(word)
                if got is None:
                    got = self._word(word)
                    known = self._young
                if got[2]:
                    yield got

    def forget_words(self) -> None:
        """Empties the caches; a worker that waits for its next task holds only the vocabulary."""
        self._young, self._old = {}, {}

    def encode_strings(self, text: str) -> tuple[str, str, int]:
        """(ids joined by a space, decoded text, number of tokens)."""
        got = list(self._pieces(text))
        return " ".join([x[0] for x in got]), " ".join([x[1] for x in got]), sum([x[2] for x in got])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_strings(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids if i in self.strings)


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_workers: dict[int, Bpe] = {}


def _tokenizer(shared) -> Bpe:
    if shared.value.__hash__() not in _workers:
        _workers.clear()
        _workers[shared.value.__hash__()] = Bpe(shared.value)
    return _workers[shared.value.__hash__()]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "bpe", digest: bool = False) -> DataFrame:
    """``docs`` with a struct column ``out``: ids and decoded, or with ``digest`` n_tokens and the SHA-256 of both.

    ``path`` names the vocabulary file on the driver; its content, of fixed size, is broadcast.
    """
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(tokenizer_text(path))
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def whole(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _tokenizer(shared)
        for part in parts:
            rows = [bpe.encode_strings(x.as_py() or "") for x in part]
            yield pa.StructArray.from_arrays([pa.array([[int(i) for i in r[0].split()] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())], names=["ids", "decoded"])
        bpe.forget_words()
        trim()

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _tokenizer(shared)
        for part in parts:
            n, a, b = [], [], []
            for x in part:
                ids, decoded, count = bpe.encode_strings(x.as_py() or "")
                n.append(count)
                a.append(sha(ids))
                b.append(sha(decoded))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget_words()
        trim()

    return docs.withColumn(out, (digests if digest else whole)(F.col(text)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, default_path(), out="b", digest=True).select("doc_id", "b.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each kept document's id, number of tokens and digests of ids and decoded text."""
    return encode(docs.select("doc_id", "text"), default_path(), out="b", digest=True).select("doc_id", "b.*")


QUERIES = {"op5_bpe": op5_bpe}
ORACLE_SQL: dict[str, str] = {}
