"""Order of many suffixes of one text block by difference-cover construction.

Suffixes are compared on at least their first ``depth`` bytes:

1. The cover sample, the suffixes starting at positions whose remainder modulo 32 lies in a
   difference cover, is ranked once, by refining words of eight bytes.
2. The other suffixes are sorted one bucket at a time, between splitters of their leading
   bytes, on 32 bytes.
3. Longer ties need no more text: for any two positions there is a shift below 32 that takes
   both into the cover, and the precomputed ranks there decide. Tied groups are split by
   three-way comparison with a pivot, all groups of a bucket at once.

Memory is the block, the sample's ranks and one bucket.
"""

from __future__ import annotations

import numpy as np

PERIOD = 32
COVER = (0, 1, 2, 3, 7, 11, 19)  # fixed values: every difference modulo 32 occurs
BUCKET = 1 << 17
PAD = 256  # zero bytes that must follow a text

IN_COVER = np.zeros(PERIOD, bool)
IN_COVER[list(COVER)] = True
#: SHIFT[i, j]: a shift that takes both remainders i and j into the cover
SHIFT = np.array([
    [next(d for d in range(PERIOD) if IN_COVER[(i + d) % PERIOD] and IN_COVER[(j + d) % PERIOD]) for j in range(PERIOD)]
    for i in range(PERIOD)
])


def words(text):
    """The eight bytes at every position as one big-endian number."""
    two = (text[:-1].astype(np.uint64) << np.uint64(8)) | text[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def _refine(order, head, at, eight, offset):
    """Sort within groups (``head`` marks their first members) by the word at ``offset``; the new order and heads."""
    group = np.cumsum(head) - 1
    size = np.bincount(group)
    tied = np.nonzero(size[group] > 1)[0]
    if not len(tied):
        return order, head
    g, w = group[tied], eight[at[order[tied]] + offset]
    sub = np.lexsort((w, g))
    order = order.copy()
    order[tied] = order[tied][sub]
    w = w[sub]
    head = head.copy()
    fresh = np.ones(len(tied), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
    head[tied] = fresh
    return order, head


def by_words(at, eight, count):
    """Order of the suffixes at ``at`` by ``count`` words, and the heads of groups equal in all of them."""
    first = eight[at]
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    head = np.ones(len(at), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    for k in range(1, count):
        order, head = _refine(order, head, at, eight, 8 * k)
    return order, head


def cover_ranks(eight, until, depth):
    """Rank of every cover position below ``until`` by its next ``depth`` bytes or more; -1 elsewhere."""
    at = np.nonzero(IN_COVER[np.arange(until) % PERIOD])[0]
    order, head = by_words(at, eight, -(-depth // 8))
    ranks = np.full(until, -1, np.int64)
    ranks[at[order]] = np.cumsum(head) - 1
    return ranks


def _split_ties(order, head, at, ranks):
    """Sort groups of suffixes equal on PERIOD bytes by the cover ranks."""
    order, head = order.copy(), head.copy()
    group = np.cumsum(head) - 1
    active = np.nonzero(np.bincount(group)[group] > 1)[0]
    open_head = head[active]
    while len(active):
        here = at[order[active]]
        starts = np.nonzero(open_head)[0]
        sizes = np.diff(np.append(starts, len(active)))
        pivot = np.repeat(here[starts + sizes // 2], sizes)
        shift = SHIFT[here % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[here + shift] - ranks[pivot + shift]) + 1
        key = np.repeat(np.arange(len(starts)), sizes) * 3 + side
        sub = np.argsort(key, kind="stable")
        order[active] = order[active][sub]
        key = key[sub]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        head[active] = fresh
        part = np.cumsum(fresh) - 1
        more = (np.bincount(part)[part] > 1) & (key % 3 != 1)  # what equals the pivot is settled
        active, open_head = active[more], fresh[more]
    return order, head


def suffix_groups(text, starts, depth=100):
    """Suffixes in order, and the heads of groups whose first ``depth`` bytes are equal.

    ``text`` ends with PAD zero bytes and ``starts + depth`` stays before them. Yields one
    (index into starts, head) pair of arrays per bucket; a group never spans two.
    """
    if not len(starts):
        return
    eight = words(text)
    ranks = cover_ranks(eight, len(text) - PAD + PERIOD, depth)
    first = eight[starts]
    parts = -(-len(starts) // BUCKET)
    sample = np.sort(first[:: max(1, len(first) // (16 * parts))])
    cuts = np.unique(sample[np.linspace(0, len(sample), parts + 1)[1:-1].astype(int)])
    bucket = np.searchsorted(cuts, first, side="right")
    for b in range(len(cuts) + 1):
        mine = np.nonzero(bucket == b)[0]
        if not len(mine):
            continue
        at = starts[mine]
        order, head = by_words(at, eight, PERIOD // 8)
        order, head = _split_ties(order, head, at, ranks)
        # the ranks looked beyond ``depth``: neighbours equal up to it are one group
        edge = np.nonzero(head)[0]
        edge = edge[edge > 0]
        p, q = at[order[edge]], at[order[edge - 1]]
        same, k = np.ones(len(edge), bool), 0
        while k < depth and same.any():
            step = eight[p[same] + k] ^ eight[q[same] + k]
            if depth - k < 8:
                step >>= np.uint64(8 * (8 - (depth - k)))
            same[np.nonzero(same)[0][step != 0]] = False
            k += 8
        head[edge[same]] = False
        yield mine[order], head
