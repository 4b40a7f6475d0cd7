"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x):
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n, base):
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n, base=BASE):
    """base**0 .. base**(n-1) modulo 2**64."""
    return _powers(1 << max(10, (n - 1).bit_length()), base)[:n]


def word_hashes(data):
    """(hash, start, end) of every blank-separated word of a byte array."""
    blank = BLANK[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    n = len(data) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n)[:-1], out=sums[1:])
    inverse = powers(n, pow(BASE, -1, 1 << 64))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)), start, end


def shingle_sets(texts, width=5):
    """Distinct shingles of every text.

    Returns (hashes, bounds): the sorted hashes of text i stand in bounds[i]:bounds[i+1]. Words
    are separated by space and 0x09-0x0D, A-Z is lower-cased. A text of fewer than ``width``
    words, but some, has its whole sequence as its only shingle.
    """
    raw = [(t or "").encode("utf-8").lower() for t in texts]  # bytes.lower changes A-Z only
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    words, start, _ = word_hashes(joined)
    doc = np.searchsorted(ends, start, side="right")
    counts = np.bincount(doc, minlength=len(raw))
    first = np.concatenate(([0], np.cumsum(counts)))
    pad = np.concatenate((words, np.zeros(width, np.uint64)))
    n = len(words)
    value = np.zeros(n, np.uint64)
    same = np.ones(n, bool)
    doc_pad = np.concatenate((doc, np.full(width, -1)))
    for i in range(width):
        inside = doc_pad[i : i + n] == doc
        value = value * np.uint64(BASE) + np.where(inside, mix(pad[i : i + n] + np.uint64(i + 1)), np.uint64(0))
        same &= inside
    keep = same | ((counts[doc] < width) & (np.arange(n) == first[doc]))
    value, doc = mix(value[keep]), doc[keep]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(raw)))))


def lots(batches, text, chars=1 << 20):
    """Slices of Arrow batches that end once they hold ``chars`` characters, with their texts."""
    for batch in batches:
        texts, start, held = [], 0, 0
        for i, value in enumerate(batch.column(text)):
            texts.append(value.as_py())
            held += len(texts[-1] or "")
            if held >= chars or i + 1 == batch.num_rows:
                yield batch.slice(start, len(texts)), texts
                texts, start, held = [], i + 1, 0
