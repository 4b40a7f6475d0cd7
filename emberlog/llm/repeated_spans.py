"""Removal of byte strings that occur earlier, by suffix arrays built in blocks.

Every string of 100 bytes that also starts earlier (in a document of smaller id, or before
in the same one) is removed; overlaps count, all strings are judged on the input.

1. Each window of 100 bytes has an anchor, the least hash of its 24-byte strings. Equal
   windows have equal anchors, so only windows whose anchor occurs twice can repeat. Runs of
   windows with one anchor are found per lot of text, with a 128-bit digest of all their bytes. A lot
   sends one row per different run, and no more than ``AHEAD`` of one anchor to the same
   place, so neither copies of a passage nor its many contexts meet in one task. A run whose
   digest occurred earlier repeats as a whole; one whose anchor has no other run is unique.
2. The text of the runs left goes to units by anchor. An anchor with more than ``UNIT`` runs
   is salted over several units.
3. A task concatenates whole units into blocks of bounded size and orders their windows with
   ``suffix_blocks``. Equal windows are neighbours; all but the earliest are repeats.
4. Windows of salted units that were earliest in their unit meet once more by fingerprint,
   at most one from each salt.

Nothing is dropped or sampled: each window is compared with every other that can equal it.

Ids are whole numbers. A null or empty text has no bytes. A row with a null id takes no part and keeps its text. ``id`` is the key: rows that repeat id and text have the
same place, so neither is earlier than the other and both get the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.llm.base import extend, query, small_batches, table
from emberlog.llm.shingling import BASE, lots, mix, powers
from emberlog.llm.suffix_blocks import PAD, suffix_groups, words

WIDTH = 100
GRAM = 24
REACH = WIDTH - GRAM + 1  # grams in a window
LONGEST = 256  # windows of a run; longer ones are cut
UNIT = 2048  # runs of a unit
LOT = 1 << 20  # characters of a lot; a task holds about 100 bytes for each
AHEAD = 16  # runs of one anchor that a lot sends by the anchor; the others go by their digest
COUNT = (1 << 20) - 1
SEEDS = (1, BASE), (0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)  # of the two halves of a run's digest; bases are odd
BLOCK = 1 << 20  # bytes of text ordered at once


def grams(text):
    """Hash of the GRAM bytes at every position at which they fit."""
    eight = words(np.concatenate((text, np.zeros(7, np.uint8))))
    n = len(text) - GRAM + 1
    a, b, c = eight[:n], eight[8 : n + 8], eight[16 : n + 16]
    return mix(mix(a + np.uint64(0x632BE59BD9B4E019)) ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ mix(c ^ np.uint64(0xD1B54A32D192ED03)))


def sliding(values, best):
    """``best`` (minimum or maximum) of every REACH neighbours."""
    span = 1
    while 2 * span <= REACH:
        values = best(values[:-span], values[span:])
        span *= 2
    more = REACH - span
    return best(values[: len(values) - more], values[more:]) if more else values


def runs(texts):
    """All runs of byte strings: (anchor, text number, first window, windows, anchor occurs twice in one run, both halves of its 128-bit digest)."""
    long = [i for i, t in enumerate(texts) if len(t) >= WIDTH]
    if not long:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, bool, np.uint64, np.uint64))
    joined = np.frombuffer(b"".join([texts[i] for i in long]), np.uint8)
    size = np.array([len(texts[i]) for i in long])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    gram = grams(joined)
    least = sliding(gram, np.minimum)
    owner = np.repeat(np.arange(len(long)), size)[: len(least)]
    inside = np.arange(len(least)) - start[owner] <= size[owner] - WIDTH
    at = np.nonzero(inside)[0]
    value, owner = least[at], owner[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    # in periodic text a run has its anchor more than once: neighbours among the grams that are anchors
    blank = np.zeros(REACH - 1, np.uint64)
    most = sliding(np.concatenate((blank, np.where(inside, least, np.uint64(0)), blank)), np.maximum)
    chosen = np.nonzero(gram <= most)[0]
    twice = np.unique(gram[chosen][1:][gram[chosen][1:] == gram[chosen][:-1]])
    head = np.nonzero(fresh)[0]
    count = np.diff(np.append(head, len(at)))
    pieces = -(-count // LONGEST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head, count = np.repeat(head, pieces), np.repeat(count, pieces)
    windows = np.minimum(count - nth * LONGEST, LONGEST)
    first = at[head] + nth * LONGEST
    digest, second = (span_digests(joined, first, windows + WIDTH - 1, *k) for k in SEEDS)
    return value[head], np.array(long)[owner[head]], first - start[owner[head]], windows, np.isin(value[head], twice), digest, second


def span_digests(text, start, length, seed=1, base=BASE):
    """64-bit digests of byte spans, from prefix sums of mixed words of eight bytes."""
    eight = mix(words(np.concatenate((text, np.zeros(7, np.uint8)))) + np.uint64(seed))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(eight * powers(len(text), base), out=sums[1:])
    inverse = powers(len(text) + 1, pow(base, -1, 1 << 64))
    inside = length - 7  # words that lie within the span
    return mix((sums[start + inside] - sums[start]) * inverse[start] + length.astype(np.uint64))


def _bytes(texts):
    return [(t or "").encode("utf-8") for t in texts]


def repeated_runs(texts):
    """Runs that may hold repeats: ``id``, ``at``, ``n``, ``whole`` (repeats as a whole), ``total`` (runs of its anchor, if many).

    Runs are dropped here only if no other window can equal one of theirs.
    """
    schema = extend(texts.select("id").schema, "place long, digest long, second long, deal long")

    def run(batches):
        for lot, held in lots(batches, "_text", LOT):
            anchor, text, at, n, again, digest, second = runs(_bytes(held))
            if not len(anchor):
                continue
            # the texts of a lot come in any order of ids: the earliest of equal runs is the one sent on
            ids = lot.column("id").to_numpy()[text]
            order = np.lexsort((at, ids, second, digest, anchor))
            a, d, e = anchor[order], digest[order], second[order]
            other = np.concatenate(([True], a[1:] != a[:-1]))
            fresh = other | np.concatenate(([True], (d[1:] != d[:-1]) | (e[1:] != e[:-1])))
            same_place = np.zeros(len(order), bool)
            same_place[1:] = ~fresh[1:] & (ids[order][1:] == ids[order][:-1]) & (at[order][1:] == at[order][:-1])
            group = np.cumsum(other) - 1
            nth = np.cumsum(fresh) - 1
            nth -= nth[np.nonzero(other)[0]][group]  # number of the run among those of its anchor
            here = np.bincount(group[fresh])[group] + again[order]
            ahead = fresh & (nth < AHEAD)
            # bits: 0 sent by the anchor, 1 a later copy of a run of this lot, 2 other runs of its anchor are known
            kind = np.where(ahead, 0, np.where(fresh, 2, 1))
            deal = np.where(ahead, a, np.where(fresh, mix(a ^ d), mix(a + np.arange(len(a), dtype=np.uint64))))
            place = (at[order] << 32) | ((n[order] - 1) << 24) | (kind << 20) | np.minimum(np.where(nth == 0, here, 0), COUNT)
            keep = ~same_place
            yield pa.RecordBatch.from_arrays([
                lot.column("id").take(pa.array(text[order][keep])), pa.array(place[keep]), pa.array(d[keep].view(np.int64)), pa.array(e[keep].view(np.int64)),
                pa.array(deal[keep].view(np.int64))], names=schema.names)

    bits = lambda shift, mask: F.shiftright("place", shift).bitwiseAND(mask)
    found = texts.mapInArrow(run, schema).repartition("deal").withColumns({
        "at": bits(32, (1 << 31) - 1).cast("int"), "n": (bits(24, 255) + 1).cast("int"), "kind": bits(20, 15), "here": bits(0, COUNT)})
    # a lot sends AHEAD rows of an anchor at most, so a group has that many for each lot
    # repeated rows come from several lots with one place: none of them is a later copy, yet they are one kind
    copies = Window.partitionBy("deal", "digest", "second").orderBy("id", "at")
    found = found.withColumns({"nth": F.dense_rank().over(copies), "row": F.row_number().over(copies)})
    alike = Window.partitionBy("deal")
    found = found.withColumns({
        "kinds": F.sum(F.when(F.col("row") == 1, 1).otherwise(0)).over(alike), "total": F.sum("here").over(alike),
        "most": F.max("here").over(alike)})
    whole = (F.col("kind") == 1) | (F.col("nth") > 1)
    open_ = (F.col("kind") == 2) | (F.col("kinds") > 1) | (F.col("most") > 1)
    return found.filter(whole | open_).select("id", "at", "n", whole.alias("whole"), F.when(F.col("kind") == 0, F.col("total")).otherwise(0).alias("total"), "deal", "kind")


def run_texts(candidates, texts):
    """Text of the runs that aren't decided, with their unit."""
    open_ = candidates.filter("NOT whole")
    large = open_.filter(F.col("total") > UNIT).groupBy(F.col("deal").alias("anchor")).agg(
        F.max(F.ceil(F.col("total") / F.lit(UNIT))).cast("int").alias("salts"))
    per_doc = open_.groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    rows = per_doc.hint("merge").join(texts, "id").select("id", "_text", "runs")
    schema = extend(rows.select("id").schema, "at int, n int, anchor long, body binary")

    def run(batches):
        for lot, held in lots(batches, "_text", LOT):
            out = []
            for doc, raw, found in zip(lot.column("id").to_pylist(), _bytes(held), lot.column("runs").to_pylist()):
                for at, n in {(r["at"], r["n"]) for r in found}:
                    body = raw[at : at + n + WIDTH - 1]
                    if len(body) == n + WIDTH - 1:  # else another text under the same id
                        out.append((doc, at, n, body))
            if not out:
                continue
            doc, at, n, body = map(list, zip(*out))
            size = np.array([len(x) for x in body])
            gram = grams(np.frombuffer(b"".join(body), np.uint8))
            start = np.cumsum(size) - size
            inside = np.arange(len(gram)) - np.repeat(start, size)[: len(gram)] <= np.repeat(size, size)[: len(gram)] - GRAM
            anchor = np.minimum.reduceat(np.where(inside, gram, np.uint64(0xFFFFFFFFFFFFFFFF)), start)
            yield pa.RecordBatch.from_arrays([
                pa.array(doc, lot.column("id").type), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor.view(np.int64)),
                pa.array(body, pa.binary())], names=schema.names)

    bodies = rows.mapInArrow(run, schema).join(settle(large), "anchor", "left")
    salt = F.pmod(F.xxhash64("id", "at"), F.coalesce("salts", F.lit(1)))
    return bodies.select("id", "at", "n", F.xxhash64("anchor", salt).alias("unit"), F.col("salts").isNotNull().alias("salted"), "body")


def _blocks(batches, key, limit):
    """Tables of whole groups of ``key`` from a stream sorted by it, cut at about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            part = b.slice(i, 4096)
            held.append(part)
            size += part.nbytes
            if size < limit:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield t.slice(0, cut)
                held, size = t.slice(cut).to_batches(), t.slice(cut).nbytes
    if held:
        yield pa.Table.from_batches(held)


def _windows(block):
    """(row, offset) of windows of a block's runs that repeat an earlier one, and of the earliest ones in salted units.

    Returns (row, offset, is a repeat, fingerprints) arrays.
    """
    unit, ids, at, n = (block.column(c).to_numpy() for c in ("unit", "id", "at", "n"))
    body, salted = block.column("body").to_pylist(), block.column("salted").to_numpy()
    order = np.lexsort((at, ids))
    seen, kept, copies = {}, [], []
    for i in order:  # earliest first
        if (was := seen.setdefault((unit[i], body[i]), i)) == i:
            kept.append(i)
        elif (ids[was], at[was]) != (ids[i], at[i]):
            copies.append(i)
    kept = np.array(kept, np.int64)
    length = n[kept] + WIDTH - 1
    text = np.concatenate((np.frombuffer(b"".join([body[i] for i in kept]), np.uint8), np.zeros(PAD, np.uint8)))
    base = np.cumsum(length) - length
    count = n[kept]
    owner = np.repeat(np.arange(len(kept)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = base[owner] + offset
    # place of a window: kept runs are in order of (id, at), but runs of one text may interleave
    place = np.unique(ids[kept], return_inverse=True)[1][owner] * (1 << 32) + at[kept][owner] + offset
    repeat = np.zeros(len(starts), bool)
    for index, head in suffix_groups(text, starts, WIDTH):
        # units never share windows, as these would share the anchor; salts of one anchor may
        group = np.cumsum(head) - 1
        least = np.minimum.reduceat(place[index], np.nonzero(head)[0])
        repeat[index] = place[index] > least[group]
    told = np.nonzero(repeat | salted[kept][owner])[0]
    prints = np.zeros((len(told), 2), np.uint64)
    eight = words(text)
    for k in range(0, WIDTH, 4):
        w = eight[starts[told] + min(k, WIDTH - 8)]
        prints[:, k // 4 % 2] = mix(prints[:, k // 4 % 2] * np.uint64(0x9E3779B97F4A7C15) + w)
    copies = np.array(copies, np.int64)
    return kept[owner[told]], offset[told], repeat[told], prints, copies


def _spans(row, offset):
    """Consecutive offsets of the same row as (row, first, number)."""
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    head = np.nonzero(fresh)[0]
    return row[head], offset[head], np.diff(np.append(head, len(row)))


def repeats(bodies):
    """Windows that repeat earlier ones: ``id``, ``at``, ``n``; and earliest windows of salted units, with fingerprints."""
    rows = bodies.repartition("unit").sortWithinPartitions("unit")
    schema = extend(rows.select("id").schema, "at int, n int, p1 long, p2 long")

    def run(batches):
        for block in _blocks(batches, "unit", BLOCK):
            ids, at, n = block.column("id").combine_chunks(), block.column("at").to_numpy(), block.column("n").to_numpy()
            row, offset, repeat, prints, copies = _windows(block)
            r, o, many = _spans(row[repeat], offset[repeat])
            first = ~repeat
            r, o = np.concatenate((r, copies, row[first])), np.concatenate((o, copies * 0, offset[first]))
            many = np.concatenate((many, n[copies], np.ones(first.sum(), np.int64)))
            whole = len(r) - first.sum()
            p = [pa.array(np.concatenate((np.zeros(whole, np.int64), prints[first, c].view(np.int64))), mask=np.arange(len(r)) < whole) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(r)), pa.array((at[r] + o).astype(np.int32)), pa.array(many.astype(np.int32)), *p], names=schema.names)

    return rows.mapInArrow(run, schema)


def _texts(docs, id, text):
    """Rows with an id; the same plan wherever texts are joined by id, so that they are shuffled once."""
    return docs.select(F.col(id).alias("id"), F.col(text).alias("_text")).filter(F.col("id").isNotNull())


def repeated_windows(docs, id="doc_id", text="text"):
    """Per document the windows to remove: ``id``, ``spans`` array of (at, n): n windows from byte ``at``."""
    small_batches(docs)
    texts = _texts(docs, id, text)
    candidates = settle(repeated_runs(texts))
    found = repeats(run_texts(candidates, texts))
    # rows without a fingerprint are decided; the others meet by it, and the earliest stays
    own = F.coalesce("p1", F.xxhash64("id", "at"))
    nth = F.dense_rank().over(Window.partitionBy("own", "p2").orderBy("id", "at"))
    spans = found.withColumn("own", own).withColumn("nth", nth).filter("p1 IS NULL OR nth > 1")
    spans = spans.select("id", "at", "n").unionAll(candidates.filter("whole").select("id", "at", "n"))
    return spans.groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def _kept_mask(size, spans):
    edge = np.zeros(size + 1, np.int32)
    if spans:
        at = np.array([s["at"] for s in spans])
        until = np.minimum(at + np.array([s["n"] for s in spans]) - 1 + WIDTH, size)
        np.add.at(edge, at, 1)
        np.add.at(edge, until, -1)
    return np.cumsum(edge[:-1]) == 0


def remove_repeats(docs, id="doc_id", text="text"):
    """``docs`` with repeated bytes cut out of the text; parts of a character that remain are dropped."""
    spans = repeated_windows(docs, id, text).select(F.col("id").alias("_span_id"), F.col("spans").alias("_spans"))
    names = docs.columns
    rows = docs.join(spans.hint("merge"), docs[id] == F.col("_span_id"), "left").drop("_span_id")

    def run(batches):
        for lot, held in lots(batches, text, LOT):
            out = []
            for value, found in zip(held, lot.column("_spans").to_pylist()):
                if found:
                    raw = np.frombuffer(value.encode("utf-8"), np.uint8)
                    value = raw[_kept_mask(len(raw), found)].tobytes().decode("utf-8", "ignore")
                out.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()) if n == text else lot.column(n) for n in names], names=names)

    return rows.mapInArrow(run, docs.schema)


def removal_digests(docs, id="doc_id", text="text"):
    """Per document: ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    spans = repeated_windows(docs, id, text)
    rows = _texts(docs, id, text).join(spans.hint("merge"), "id", "left").select("id", "_text", "spans")
    alone = docs.filter(F.col(id).isNull()).select(F.col(id).alias("id"), F.col(text).alias("_text"))
    rows = rows.unionByName(alone.withColumn("spans", F.lit(None).cast(rows.schema["spans"].dataType)))
    schema = extend(rows.select(F.col("id").alias(id)).schema, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def run(batches):
        for lot, held in lots(batches, "_text", LOT):
            size, gone, spans, digest = [], [], [], []
            for raw, found in zip(_bytes(held), lot.column("spans").to_pylist()):
                keep = _kept_mask(len(raw), found) if found else None
                kept = raw if keep is None else np.frombuffer(raw, np.uint8)[keep].tobytes()
                size.append(len(raw))
                gone.append(len(raw) - len(kept))
                spans.append(0 if keep is None else int((~keep & np.concatenate(([True], keep[:-1]))).sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [lot.column("id"), *[pa.array(x, pa.int64()) for x in (size, gone, spans)], pa.array(digest)], names=schema.names)

    return rows.mapInArrow(run, schema)


@query("op5_suffix_array_dedup")
def op5_suffix_array_dedup(spark, sf_dir):
    return removal_digests(table(spark, sf_dir, "documents"))
