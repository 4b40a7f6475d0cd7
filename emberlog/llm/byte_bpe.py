"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is split by the tokenizer's pattern; every distinct piece is encoded once per
batch. Pieces are bucketed by length into matrices, one row each. Each round, every row
merges its leftmost pair of least rank; ranks come from a hashed table of pairs, the row
is compacted by one place, and rows that can't merge any more leave the matrix. Only the
two pairs beside a merge are looked up again. Pieces beyond ``LONG`` bytes follow the
same rule with a queue, as their rounds would make the matrix quadratic.

Memory is bounded by one Arrow batch, one matrix (``CELLS``) and a piece memo (``MEMO``
entries, emptied when full); none of them changes a result. Vocabulary files are read by
each task from ``ranks_path``, which is a parameter and must exist on every executor.

A null or empty text has no tokens. Every row is encoded on its own, so repeated rows and
clashing names of further columns do not matter. Decoding gives the text's bytes back.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from emberlog.llm.base import extend, query, small_batches, table

LONG = 512
CELLS = 1 << 20
MEMO = 200_000
NONE = np.iinfo(np.int32).max


class PairTable:
    """(left id, right id) -> id of the merged token, in an open-addressed hash table."""

    def __init__(self, left, right, merged):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == np.iinfo(np.uint64).max]
            self.keys[slots[free]] = keys[free]  # of several for one slot, the last stays
            won = free[self.keys[slots[free]] == keys[free]]
            self.values[slots[won]] = merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Merged ids, ``NONE`` where the pair has none (ids below 0 are padding)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slots, out = self._slot(keys), np.full(keys.shape, NONE, np.int32)
        open_ = np.nonzero((left >= 0) & (right >= 0))
        while len(open_[0]):
            at = slots[open_]
            held = self.keys[at]
            hit = held == keys[open_]
            out[tuple(x[hit] for x in open_)] = self.values[at[hit]]
            more = ~hit & (held != np.iinfo(np.uint64).max)
            open_ = tuple(x[more] for x in open_)
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
        return out


class Codec:
    """Encoder and decoder of one rank table (token bytes -> rank, ranks 0..n-1)."""

    def __init__(self, ranks, pattern):
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        made = [
            (ranks[t[:i]], ranks[t[i:]], r)
            for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        self.pairs = PairTable(*np.array(made, np.int64).reshape(-1, 3).T)
        self.whole = ranks
        self.memo = {}
        self.entry = tuple  # what is kept of a piece's ids; ``digest_entry`` for digests

    def encode_rows(self, rows):
        """Token ids of byte strings of similar length, all at once."""
        width = max(map(len, rows))
        ids = np.full((len(rows), width + 1), -1, np.int32)
        for i, row in enumerate(rows):
            ids[i, : len(row)] = self.byte_ids[np.frombuffer(row, np.uint8)]
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        out, here, columns = [None] * len(rows), np.arange(len(rows)), np.arange(width + 1)
        while len(here):
            at = ranks.argmin(axis=1)  # argmin takes the leftmost of equal ranks
            least = ranks[np.arange(len(here)), at]
            done = least == NONE
            if done.any():
                for i in np.nonzero(done)[0]:
                    out[here[i]] = ids[i][ids[i] >= 0]
                ids, ranks, here, at, least = ids[~done], ranks[~done], here[~done], at[~done], least[~done]
                if not len(here):
                    break
            n = np.arange(len(here))
            shift = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width)
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            ids[n, at] = least
            ids[:, -1], ranks[:, -1] = -1, NONE
            before = np.maximum(at - 1, 0)
            ranks[n, before] = np.where(at > 0, self.pairs.find(ids[n, before], ids[n, at]), ranks[n, before])
            ranks[n, at] = self.pairs.find(ids[n, at], ids[n, np.minimum(at + 1, width)])
        return out

    def encode_long(self, row):
        """The same rule for one long byte string, by a queue of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(row, np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(first[i]), int(i)) for i in np.nonzero(first != NONE)[0]]
        heapq.heapify(heap)
        rank_of = self._pair_rank
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or rank_of(ids[i], ids[j]) != rank:
                continue  # a neighbour has merged since
            ids[i], ids[j] = rank, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank_of(rank, ids[after[j]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank_of(ids[before[i]], rank)) is not None:
                heapq.heappush(heap, (r, before[i]))
        return np.array([x for x in ids if x is not None], np.int32)

    def _pair_rank(self, left, right):
        return self.whole.get(self.tokens[left] + self.tokens[right])

    def learn(self, pieces):
        """Encode the pieces that the memo lacks, in buckets of equal or similar length."""
        buckets = {}
        for p in pieces:
            raw = p.encode("utf-8")
            if (rank := self.whole.get(raw)) is not None:
                self._keep(p, [rank])
            elif len(raw) > LONG:
                self._keep(p, self.encode_long(raw).tolist())
            else:
                buckets.setdefault(len(raw) if len(raw) <= 24 else -(-len(raw) // 32) * 32, []).append((p, raw))
        for width, rows in buckets.items():
            step = max(1, CELLS // (width + 1))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                for (p, _), ids in zip(part, self.encode_rows([raw for _, raw in part])):
                    self._keep(p, ids.tolist())

    def _keep(self, piece, ids):
        self.memo[piece] = self.entry(ids)

    def digest_entry(self, ids):
        return len(ids), ",".join(map(str, ids)), self.decode(ids)

    def decode(self, ids):
        return b"".join([self.tokens[i] for i in ids])

    def entries(self, texts):
        """Per text the entries of its pieces, in order."""
        split = [self.split(t) if t else [] for t in texts]
        missing = set().union(*split) - self.memo.keys()
        if len(self.memo) + len(missing) > MEMO:
            self.memo.clear()
            missing = set().union(*split)
        self.learn(missing)
        memo = self.memo
        return [[memo[p] for p in pieces] for pieces in split]


@cache
def codec(ranks_path, pattern, digests=False):
    """One codec per Python worker, vocabulary and kind of entry."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    made = Codec(ranks, pattern)
    if digests:
        made.entry = made.digest_entry
    return made


LOT_CHARS = 2 << 20  # characters of text whose pieces are learned together


def _lots(batches, text):
    """Slices of the batches that end once they hold LOT_CHARS, with their texts."""
    for batch in batches:
        texts, start, held = [], 0, 0
        for i, value in enumerate(batch.column(text)):
            texts.append(value.as_py())
            held += len(texts[-1] or "")
            if held >= LOT_CHARS or i + 1 == batch.num_rows:
                yield batch.slice(start, len(texts)), texts
                texts, start, held = [], i + 1, 0


def _ids(entries):
    """Arrow array of id lists from lists of entries."""
    flat = np.fromiter(chain.from_iterable(chain.from_iterable(entries)), np.int32)
    ends = np.cumsum([0] + [sum(map(len, e)) for e in entries])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def encode(docs, ranks_path, pattern, text="text", tokens="tokens", read_back=None):
    """``docs`` with the array of token ids of ``text`` in ``tokens`` (replaced if it exists).

    ``read_back`` names a column for the text decoded from these ids in the same pass.
    """
    small_batches(docs)
    names = [n for n in docs.columns if n not in (tokens, read_back)]
    kept = docs.select(*[f"`{n}`" for n in dict.fromkeys([*names, text])])
    schema = kept.select(*[f"`{n}`" for n in names]).withColumn(tokens, F.lit(None).cast("array<int>"))
    schema = (schema if read_back is None else schema.withColumn(read_back, F.lit(None).cast("string"))).schema

    def run(batches):
        coder = codec(ranks_path, pattern)
        for lot, texts in _lots(batches, text):
            ids = _ids(coder.entries(texts))
            columns = [*[lot.column(n) for n in names], ids]
            if read_back is not None:
                flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
                columns.append(pa.array([coder.decode(flat[i:j].tolist()).decode("utf-8", "replace") for i, j in zip(ends, ends[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def decode(docs, ranks_path, pattern, tokens="tokens", text="text"):
    """``docs`` with the text of the ids in ``tokens``; bytes that aren't UTF-8 become U+FFFD. Null ids: null."""
    small_batches(docs)
    names = [n for n in docs.columns if n != text]
    schema = docs.select(*[f"`{n}`" for n in names]).withColumn(text, F.lit(None).cast("string")).schema

    def run(batches):
        coder = codec(ranks_path, pattern)
        for lot in batches:
            texts = [None if ids is None else coder.decode(ids).decode("utf-8", "replace") for ids in lot.column(tokens).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[lot.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, text])

    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)


def digests(docs, ranks_path, pattern, id="doc_id", text="text"):
    """Token count and SHA-256 of ids and of decoded bytes, made where the ids are, so that they aren't moved."""
    small_batches(docs)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    schema = extend(rows.select(F.col("_id").alias(id)).schema, "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        coder = codec(ranks_path, pattern, True)
        for lot, texts in _lots(batches, "_text"):
            counts, of_ids, of_bytes = [], [], []
            for entry in coder.entries(texts):
                counts.append(sum([e[0] for e in entry]))
                of_ids.append(hashlib.sha256(",".join([e[1] for e in entry]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(b"".join([e[2] for e in entry])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [lot.column("_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=schema.names)

    return rows.mapInArrow(run, schema)


def public_ranks(name="byte_bpe_multi_50k.tiktoken"):
    """Path and pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@query("op4_byte_bpe")
def op4_byte_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), *public_ranks())
