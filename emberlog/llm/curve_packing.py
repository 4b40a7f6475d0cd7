"""Packing along a space-filling curve.

A document is its token ids and an end id. Its ids are hashed to a vector of bucket counts
(square roots, unit length), fixed random signs project it to four dimensions, and the
place of that point on a Hilbert curve is the document's key: documents of like content lie
close together on the curve. The documents are dealt out in ranges of the curve, sorted
within each, and laid end to end; sequences are cut from this stream, so neighbours on the
curve share sequences. What is left at the end of a range is cut into sequences of 1,024,
512, ... ids, each a power of two, so that no sequence is padded at all.

Texts are encoded once. The range bounds are quantiles, weighted by tokens, of a sample of
``SAMPLE_A_RANGE`` documents a range and ``SAMPLE`` at most, as a range partitioning by Spark
would draw it; they only steer how even the ranges are. Only the ids, two bytes each where
the vocabulary allows it, go through the one shuffle. Documents of one key (copies) are
spread over ranges by a digest of their row, so that a text which a third of all rows share
doesn't fill one range.

Nulls: a null text is the empty one (its end id alone is packed); a null id is kept. Equal
keys lie by id, then by row; repeated rows are packed each. Long texts run through as many
sequences as they need. Other columns are left alone. No documents: no rows.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from emberlog.llm.base import query, table
from emberlog.operators.ordering import slice_count

BUCKETS, DIMS, BITS = 1024, 4, 15
#: Coordinates from -REACH to REACH share the curve's cells; what lies beyond gets the outermost.
REACH = 8.0
SAMPLE_A_RANGE, SAMPLE = 20, 1_000_000
OUT_BYTES = 4 << 20


def visible_bytes():
    """byte -> character of the public byte-level alphabet: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@cache
def read_encoder(vocabulary, pattern):
    """Encoder of a byte-level ``tokenizers`` file; its merges rank in the order of their ids.

    Strings of special tokens inside a text are ordinary text.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        read = json.load(f)
    special = {t["content"] for t in read.get("added_tokens", ())}
    to_byte = {c: b for b, c in visible_bytes().items()}
    ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in read["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def hilbert_key(points, bits=BITS):
    """Place on the Hilbert curve of every row of unsigned coordinates below 2^bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # from coordinates to the transposed index
        low = level - 1
        for i in range(dims):
            up = (x[i] & level) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        flip ^= np.where(x[dims - 1] & level, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@cache
def projection():
    """Fixed signs, BUCKETS x DIMS."""
    return np.random.default_rng(11).choice(np.float32([-1, 1]), (BUCKETS, DIMS))


def bucket_of(ids):
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)


def curve_keys(counts):
    """Keys of bucket counts, one row per document; a document without ids lies at the middle."""
    v = np.sqrt(counts.astype(np.float32))
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
    cells = np.floor((v @ projection() + REACH) / (2 * REACH) * (1 << BITS))
    return hilbert_key(np.clip(cells, 0, (1 << BITS) - 1))


def coded(docs, vocabulary, pattern, end_id, bounds=(), id="doc_id", text="text"):
    """``_id``, ``_row``, curve ``_key``, ``_tie``, number of ids, the ids and the range of every document.

    The range of a document is the number of ``bounds`` (key, tie) at or before it.
    """
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_tie", F.xxhash64("_row"))
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        encoder = read_encoder(vocabulary, pattern)
        size = max(encoder.n_vocab, end_id + 1)
        wide, buckets = np.uint16 if size <= 1 << 16 else np.uint32, bucket_of(np.arange(size))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                counts, sizes, stored = np.zeros((part.num_rows, BUCKETS), np.int32), [], []
                for k, x in enumerate(part.column("_text")):
                    ids = np.append(encoder.encode_to_numpy(x.as_py() or ""), end_id)
                    counts[k] = np.bincount(buckets[ids[:-1]], minlength=BUCKETS)
                    sizes.append(len(ids))
                    stored.append(ids.astype(wide).tobytes())
                keys = curve_keys(counts)
                place = [bisect_right(bounds, x) for x in zip(keys.tolist(), part.column("_tie").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_row"), part.column("_tie"), pa.array(keys), pa.array(sizes, pa.int64()),
                     pa.array(stored, pa.binary()), pa.array(place, pa.int32())],
                    names=["_id", "_row", "_tie", "_key", "_n", "_ids", "_range"])

    return rows.mapInArrow(run, f"_id {kind}, _row long, _tie long, _key long, _n long, _ids binary, _range int")


def range_bounds(rows, ranges):
    """At most ``ranges - 1`` pairs (key, digest of the row) that part a sample into like numbers of ids."""
    sample = sorted((r._key, r._tie, r._n) for r in rows.collect())
    whole, seen, out = sum(n for *_, n in sample), 0, []
    for key, tie, n in sample:
        if len(out) < ranges - 1 and seen >= whole * (len(out) + 1) / ranges:
            out.append((key, tie))
        seen += n
    return out


def powers(n):
    """Powers of two that add up to ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def cut(documents, limit):
    """Cut a stream of (document, ids) into sequences.

    Yields lists of pieces (document, start, ids), one list per sequence: ``limit`` ids each,
    and at the end one for every power of two of the rest.
    """
    pieces, filled = [], 0
    for doc, ids in documents:
        start = 0
        while start < len(ids):
            take = min(limit - filled, len(ids) - start)
            pieces.append((doc, start, ids[start : start + take]))
            start, filled = start + take, filled + take
            if filled == limit:
                yield pieces
                pieces, filled = [], 0
    for size in powers(filled):
        made, missing = [], size
        while missing:
            doc, start, ids = pieces.pop(0)
            made.append((doc, start, ids[:missing]))
            if len(ids) > missing:
                pieces.insert(0, (doc, start + missing, ids[missing:]))
            missing -= len(made[-1][2])
        yield made


def pack(docs, vocabulary, pattern, end_id, limit=2048, ranges=None, id="doc_id", text="text"):
    """Pieces of all documents: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens``, ``sequence_id`` (range and number within it) and ``offset``."""
    if limit < 1:
        raise ValueError("a sequence holds one id at least")
    spark, kind = docs.sparkSession, docs.schema[id].dataType.simpleString()
    ranges = ranges or max(slice_count(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = min(1.0, min(SAMPLE, SAMPLE_A_RANGE * ranges) / max(1, docs.count()))
    drawn = coded(docs.sample(share, 7), vocabulary, pattern, end_id, (), id, text)
    bounds = range_bounds(drawn.select("_key", "_tie", "_n"), ranges)
    dealt = coded(docs, vocabulary, pattern, end_id, bounds, id, text).drop("_tie")
    laid = dealt.repartitionById(ranges, F.col("_range")).sortWithinPartitions("_range", "_key", "_id", "_row")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        kept = None  # the type of the id

        def rows():
            nonlocal kept
            for b in batches:
                kept = b.column("_id").type
                for i, n, raw, place in zip(b.column("_id"), b.column("_n"), b.column("_ids"), b.column("_range")):
                    raw, n = raw.as_buffer(), n.as_py()
                    yield place.as_py(), (i.as_py(), n), np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)

        def batch(out):
            kinds = [kept, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        out, held = [], 0
        for place, of_range in groupby(rows(), key=lambda x: x[0]):
            for number, pieces in enumerate(cut((x[1:] for x in of_range), limit)):
                offset = 0
                for (doc, n), start, ids in pieces:
                    raw = ids.astype("<u4").tobytes()
                    out.append((doc, start, len(ids), raw, n, (place << 40) + number, offset))
                    offset, held = offset + len(ids), held + len(raw) + 64
                if held > OUT_BYTES:
                    yield batch(out)
                    out, held = [], 0
        if out:
            yield batch(out)

    return laid.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def public_vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@query("op11_curve_packing")
def op11_curve_packing(spark, sf_dir):
    packed = pack(table(spark, sf_dir, "documents"), *public_vocabulary(), end_id=1)
    return packed.withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
