"""MinHash near-duplicates with odd sketches.

Documents are linked if the Jaccard similarity of their sets of five-word shingles is at
least the threshold; a class is a connected component of links.

1. Every text gets 200 MinHash samples, their 40 bands of 5, and an odd sketch: each
   (sample number, sample) pair flips one of 1024 bits. Equal sets collapse to their
   smallest document.
2. Documents sharing a band form buckets. Counts come first, so a large bucket is cut
   into blocks by digest and taken up as pairs of blocks; no bucket meets in one task, and
   pairs of documents are never emitted. Buckets with the same smallest document are one group.
3. Units compare sketches: the number of ones in the XOR of two odd sketches tells how many
   samples differ, most precisely at high similarity. Pairs within ``CUT`` join candidates.
4. Components of candidates are cut into pairs of blocks again, with whole texts. There all
   intersections are counted exactly on the full sets and only links in the stated
   threshold are kept, as a spanning forest of each unit, which loses no link between
   components. Their components are the classes.

At similarity 0.85 the bands miss a pair with probability (1 - 0.85^5)^40 < 1e-10, the
sketch with less than 1e-9. Sets are compared as 64-bit hashes of shingles.

A null text and a text without words have an empty set and are linked with nothing. ``id``
is the key: rows that repeat it count as one document. Ties go to the smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.llm.base import extend, query, small_batches, table
from emberlog.llm.components import components
from emberlog.llm.prefilter import possible
from emberlog.llm.shingling import lots, mix, shingle_sets

PERCENT = 85
BANDS, ROWS = 40, 5
BITS = 1024
CUT = 118  # ones in the XOR; 56 +- 9 at similarity 0.85
BLOCK = 256  # documents of one block; a unit holds two blocks at most


def _seeds():
    return mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minhash(hashes, bounds):
    """(texts, samples) matrix of 32-bit minima; ``bounds`` must not hold empty sets."""
    seeds = _seeds()
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.empty((BANDS * ROWS, len(bounds) - 1), np.uint32)
    for i in range(BANDS * ROWS):
        v = (x ^ np.uint32(seeds[2 * i] & np.uint64(0xFFFFFFFF))) * np.uint32((seeds[2 * i + 1] >> np.uint64(32)) | np.uint64(1))
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        out[i] = np.minimum.reduceat(v, bounds[:-1])
    return out.T


def odd_sketch(samples):
    """Parity bitmap of the (number, sample) pairs of every row."""
    numbered = samples.astype(np.uint64) | (np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(32))
    bit = (mix(numbered + np.uint64(0x51ED27)) % np.uint64(BITS)).astype(np.int64)
    flips = np.bincount((bit + np.arange(len(samples))[:, None] * BITS).ravel(), minlength=len(samples) * BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(samples), BITS), axis=1)


def sketch(docs, id="doc_id", text="text"):
    """One row per document: ``id``, ``n`` (set size), digest of the set, ``bands``, ``sketch``."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("_text"))
    schema = extend(rows.select("id").schema, "n long, d1 long, d2 long, bands array<long>, sketch binary")

    def run(batches):
        for lot, texts in lots(batches, "_text"):
            hashes, bounds = shingle_sets(texts)
            size = np.diff(bounds)
            some = np.nonzero(size)[0]
            bands, bits = np.zeros((len(texts), BANDS), np.int64), [None] * len(texts)
            d1, d2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            if len(some):
                full = np.concatenate((bounds[:-1][some], bounds[-1:]))
                samples = minhash(hashes, full)
                d1[some] = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5)), full[:-1])
                d2[some] = np.bitwise_xor.reduceat(hashes, full[:-1])
                key = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(31) + samples[:, r::ROWS].astype(np.uint64) + np.uint64(1))
                bands[some] = mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                for i, row in zip(some, odd_sketch(samples)):
                    bits[i] = row.tobytes()
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([
                lot.column("id"), pa.array(size.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                flat, pa.array(bits, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def forest(linked):
    """Smallest reachable row number of every row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        following = np.where(linked, label[None, :], len(label)).min(axis=1)
        following = following[following]
        if (following == label).all():
            return label
        label = following


def groups(batches, key):
    """Arrow tables of the rows with equal ``key``, from a stream in which they stand together."""
    held, held_key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if held and keys[i] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = keys[i]
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(members, group, size, block):
    """Each row once per pair of blocks that its block is part of; adds ``unit``.

    ``size`` is the group's row count. With one block there is one unit.
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col("id"), F.lit(9)), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    out = members.withColumn("_own", own).withColumn("_other", other)
    return out.withColumn("unit", F.xxhash64(group, F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_own", "_other")


def candidate_links(sketches):
    """Spanning links (a, b) of documents whose sketches are close, within shared bands."""
    banded = sketches.select("id", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.count("*").alias("size"), F.min("id").alias("leader")).filter("size > 1")
    # buckets of different bands with the same smallest document are taken together
    members = settle(banded.join(full.drop("size"), "band").select("leader", "id").distinct())
    sizes = members.groupBy("leader").agg(F.count("*").alias("size"))
    units = block_pairs(members.join(sizes, "leader"), "leader", "size", BLOCK).select("unit", "id")
    rows = units.join(sketches.select("id", "n", "sketch"), "id")
    rows = rows.repartition("unit").sortWithinPartitions("unit", "id")
    schema = rows.select(F.col("id").alias("a"), F.col("id").alias("b")).schema

    def run(batches):
        for t in groups(batches, "unit"):
            ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
            bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
            apart = np.zeros((len(ids), len(ids)), np.uint16)
            for word in range(bits.shape[1]):
                apart += np.bitwise_count(bits[:, None, word] ^ bits[None, :, word])
            near = (apart <= CUT) & (100 * np.minimum(n[:, None], n) >= PERCENT * np.maximum(n[:, None], n))
            label = forest(near)
            far = np.nonzero(label != np.arange(len(ids)))[0]
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], names=["a", "b"])

    return rows.mapInArrow(run, schema)


def shared(hashes, bounds, columns=8192):
    """Matrix of intersection sizes of sets of hashes, by products of 0/1 matrices."""
    docs = len(bounds) - 1
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    order = np.argsort(hashes, kind="stable")
    h, owner = hashes[order], owner[order]
    starts = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    number = np.cumsum(starts) - 1
    often = np.bincount(number)[number] > 1 if len(h) else np.zeros(0, bool)
    number, owner = number[often], owner[often]
    number = np.unique(number, return_inverse=True)[1] if len(number) else number
    out = np.zeros((docs, docs), np.float64)
    for at in range(0, int(number.max()) + 1 if len(number) else 0, columns):
        i, j = np.searchsorted(number, [at, at + columns])
        held = np.zeros((docs, columns), np.float32)
        held[owner[i:j], number[i:j] - at] = 1
        out += held @ held.T
    return out.astype(np.int64)


def confirmed_links(candidates, docs, id="doc_id", text="text", percent=PERCENT):
    """Spanning links (a, b) between documents whose full sets reach the threshold."""
    sizes = candidates.groupBy("root").agg(F.count("*").alias("size"))
    texts = possible(docs.select(F.col(id).alias("id"), F.col(text).alias("_text")), "id", candidates, "node")
    rows = candidates.join(sizes, "root").select(F.col("node").alias("id"), "root", "size").hint("merge").join(texts, "id")
    rows = block_pairs(rows, "root", "size", BLOCK).select("unit", "id", "_text")
    rows = rows.repartition("unit").sortWithinPartitions("unit", "id")
    schema = rows.select(F.col("id").alias("a"), F.col("id").alias("b")).schema

    def run(batches):
        for t in groups(batches, "unit"):
            ids = t.column("id").to_numpy()
            hashes, bounds = shingle_sets(t.column("_text").to_pylist())
            n, both = np.diff(bounds), shared(hashes, bounds)
            linked = (100 * both >= percent * (n[:, None] + n - both)) & (both > 0)
            label = forest(linked)
            far = np.nonzero(label != np.arange(len(ids)))[0]
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], names=["a", "b"])

    return rows.mapInArrow(run, schema)


def near_duplicate_classes(docs, id="doc_id", text="text", percent=PERCENT):
    """One row per document: ``id``, ``n_shingles``, ``component_id``."""
    small_batches(docs)
    sketches = settle(sketch(docs, id, text))
    digest = ["n", "d1", "d2"]
    first = settle(sketches.filter("n > 0").groupBy(*digest).agg(F.min("id").alias("rep")))
    reps = sketches.join(first.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    reps = settle(reps.select("id", "n", "bands", "sketch"))
    candidates = settle(components(candidate_links(reps)))
    links = settle(confirmed_links(candidates, docs, id, text, percent))
    roots = settle(components(links))
    classes = settle(first.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        *digest, F.coalesce("root", "rep").alias("component_id")))
    out = sketches.select("id", *digest).join(classes, digest, "left")
    return out.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def near_deduplicate(docs, id="doc_id", text="text", percent=PERCENT):
    """``docs`` with one document of each class, the one of smallest id."""
    classes = near_duplicate_classes(docs, id, text, percent)
    keep = settle(classes.filter(F.col(id).eqNullSafe(F.col("component_id"))).select(F.col(id).alias("_keep")).distinct())
    return docs.join(keep.hint("merge"), docs[id].eqNullSafe(F.col("_keep")), "left_semi")  # ids grow with the documents


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark, sf_dir):
    classes = near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.withColumn("kept", F.col("doc_id") == F.col("component_id"))
