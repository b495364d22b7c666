"""SuperMinHash signatures and shingle sets."""

from __future__ import annotations

import numpy as np

from countloom.llm._words import Words, mix64, span_hash

_STEP = 0xA0761D6478BD642F


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ptr): text d has the distinct ``size``-word shingles hashes[ptr[d]:ptr[d + 1]], sorted.

    A text of fewer words has the whole sequence as its one shingle; one without words has none.
    """
    words = w.hashes()
    n = np.diff(w.ptr)
    per = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), per)
    start = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(w.ptr[:-1], per)
    h = span_hash(words, start, start + np.minimum(size, n[text]))
    by = np.lexsort((h, text))
    h, text = h[by], text[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(n) + 1))


def signatures(h: np.ndarray, ptr: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash values, one row of ``m`` a text: the fraction of equal values estimates the Jaccard similarity.

    Element e gets a random permutation of the m places; at step j it offers
    j + r, with r random in [0, 1), to the place its permutation has j-th, and
    each place keeps the least offer.  The permutation is drawn as it is used
    (Fisher-Yates).  Once every place of a text holds less than the next step's
    offers, the text is done.  Values are kept as integers, j * 2^40 + r * 2^40.
    Texts without elements keep the largest value everywhere.
    """
    texts = len(ptr) - 1
    out = np.full((texts, m), np.iinfo(np.int64).max, np.int64)
    text = np.repeat(np.arange(texts), np.diff(ptr))
    element = h
    order = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(h), m)).copy() if len(h) else np.zeros((0, m), np.uint8)
    flat = out.reshape(-1)
    for j in range(m):
        if not len(element):
            break
        draw = mix64(element + np.uint64((j + 1) * _STEP % (1 << 64)))
        k = j + ((draw >> np.uint64(44)) * np.uint64(m - j) >> np.uint64(20)).astype(np.int64)
        rows = np.arange(len(element))
        place = order[rows, k].astype(np.int64)
        order[rows, k] = order[:, j]
        offer = np.int64(j << 40) + (mix64(draw) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(flat, text * m + place, offer)
        going = out.max(axis=1) >= (j + 1) << 40
        going = going[text]
        if not going.all():
            element, text, order = element[going], text[going], order[going]
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for every ``rows`` consecutive values; the band's number is part of it."""
    n = signature.shape[1] // rows
    out = np.empty((len(signature), n), np.uint64)
    for b in range(n):
        key = np.full(len(signature), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            key = mix64(key + np.ascontiguousarray(signature[:, k]).view(np.uint64))
        out[:, b] = key
    return out


def set_keys(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A 128-bit name of each set, as rows of two 64-bit sums over differently mixed elements; equal sets have equal names."""
    out = np.zeros((len(ptr) - 1, 2), np.uint64)
    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix64(h ^ np.uint64(salt)), out=total[1:])
        out[:, k] = total[ptr[1:]] - total[ptr[:-1]]
    return out
