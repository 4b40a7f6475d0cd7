"""Document frequencies and weights of n-grams, counted by blocks of texts.

A block is a run of whole texts of about ``BLOCK_WORDS`` words, kept as the numbers of its words and its own list
of words. Words get an id over all texts; an n-gram is its ids. Only the different n-grams of a block travel, sorted
and packed by bucket, and the block gets their document frequencies back in the same order. No n-gram is shuffled
as a text, and none once per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.durable import settle
from emberlog.operators.ordering import attach, with_sequence

BLOCK_WORDS = 1 << 19  # words of a block; a longer text is a block of its own
BUCKET_TERMS = 2_000_000  # n-grams of blocks that one bucket holds on average, if all of the texts differ
OUT_ROWS = 100_000  # rows of an Arrow batch
CHUNK = 1 << 16  # cells of a sketch in one row


def _pack(numbers):
    """Numbers as compressed bytes, all first bytes ahead of all second bytes and so on."""
    if not len(numbers):
        return b""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes()
    return pa.compress(planes, "zstd", asbytes=True)


def _unpack(data, count, kind):
    if not count:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = pa.decompress(data, count * width, "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, count).T.copy().view(kind).ravel()


def _key_starts(keys):
    """Whether a row has another key than the row before; null equals null."""
    if not len(keys):
        return np.zeros(0, bool)
    a, b = keys.slice(0, len(keys) - 1), keys.slice(1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    nulls = keys.is_null().to_numpy(zero_copy_only=False)
    return np.concatenate([[True], differ | (nulls[1:] != nulls[:-1])])


def text_blocks(df, gather=False, part=0):
    """One row per block of ``df`` (``key``, ``words``), settled.

    With ``gather`` all rows of one key lie in the same block, in a row. ``part`` keeps the numbers of blocks of
    several calls apart.
    """
    kind = df.schema["key"].dataType
    if gather:
        df = df.repartition("key").sortWithinPartitions("key")
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("n_words", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("vocabulary", T.ArrayType(T.StringType())),
    ])
    limit = BLOCK_WORDS

    def cut(batches):
        made, held, room, last = 0, [], limit, None
        first = part << 60 | TaskContext.get().partitionId() << 32

        def block():
            keys, words = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
            sizes = pc.fill_null(pc.list_value_length(words), 0)
            coded = pc.dictionary_encode(words.flatten())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (keys, sizes, coded.dictionary)]
            codes = pa.array([_pack(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32))], pa.binary())
            return pa.RecordBatch.from_arrays([
                pa.array([first + made], pa.int64()), *lists[:2], pa.array([len(coded)], pa.int64()), codes, lists[2]], names=schema.names)

        for batch in batches:
            keys, words = batch.column(0), batch.column(1)
            if not len(keys):
                continue
            upto = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
            starts = _key_starts(keys) if gather else np.ones(len(keys), bool)
            if gather and last is not None:
                starts[0] = last.as_py() != keys[0].as_py()
            last, at, done = keys[len(keys) - 1], 0, 0
            places = np.append(np.flatnonzero(starts), len(keys))
            while at < len(keys):
                # up to the first start of a key behind the words that a block has room for
                full = np.searchsorted(upto, done + room)
                end = places[min(np.searchsorted(places, full, "left" if full > at or held else "right"), len(places) - 1)]
                if end > at:
                    held.append((keys.slice(at, end - at), words.slice(at, end - at)))
                    room -= upto[end - 1] - done
                    at, done = end, upto[end - 1]
                if held and at < len(keys):
                    yield block()
                    made, held, room = made + 1, [], limit
        if held:
            yield block()

    return settle(df.mapInArrow(cut, schema))


def word_ids(blocks):
    """(block, ids): the ids of a block's words, in the order of its list. Frequent words have small ids."""
    listed = blocks.select("block", F.posexplode("vocabulary").alias("pos", "word"))
    ranked = with_sequence(listed.groupBy("word").agg(F.count("*").alias("n")), [], [F.col("n").desc(), F.col("word")], name="id")
    known = listed.join(ranked.select("word", F.col("id").cast("int").alias("id")), "word")
    # a word's place goes with its id, the text stays behind
    lists = known.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("l"))
    return settle(lists.select("block", F.transform("l", lambda x: x["id"]).alias("ids")))


def _mixed(a, b):
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Grams:
    """The different n-grams of a block by level, and the texts that have them."""

    def __init__(self, sizes, codes, vocabulary, ids, ngrams):
        self.vocabulary, self.low, width = vocabulary, ngrams[0], max(1, len(vocabulary))
        row = np.repeat(np.arange(len(sizes)), sizes)
        spot, gram = np.arange(len(codes)), codes.astype(np.int64)
        parts, columns = (None, None), [ids]
        self.levels = []  # (gram of the level before, word, columns of word ids)
        self.rows = []  # (text, gram) of every occurrence
        for n in range(1, ngrams[1] + 1):
            if n > 1:
                # a gram of n words is one of n - 1 with the next word of the same text
                stay = spot + n - 1 < len(codes)
                stay[stay] = row[spot[stay] + n - 1] == row[spot[stay]]
                spot, gram = spot[stay], gram[stay]
                made, gram = np.unique(gram * width + codes[spot + n - 1], return_inverse=True)
                parts = (made // width, made % width)
                columns = [*[c[parts[0]] for c in columns], ids[parts[1]]]
            self.levels.append((*parts, columns))
            if n >= self.low:
                self.rows.append((row[spot], gram))
        self.kept = [x[2] for x in self.levels[self.low - 1:]]
        self.count = sum(len(c[0]) for c in self.kept)

    def counted(self, group=None):
        """(text, gram, count) without repeats; grams are numbered over all levels. ``group`` maps texts to keys."""
        out, before = [], 0
        for columns, (row, gram) in zip(self.kept, self.rows):
            size = max(1, len(columns[0]))
            pairs, n = np.unique((row if group is None else group[row]) * size + gram, return_counts=True)
            out.append((pairs // size, pairs % size + before, n))
            before += len(columns[0])
        return [np.concatenate(x) for x in zip(*out)]

    def text_counts(self):
        """Texts of the block that have a gram."""
        return np.bincount(self.counted()[1], minlength=self.count).astype(np.int32)

    def texts(self):
        out, made = [], self.vocabulary
        for n, (prefix, word, _) in enumerate(self.levels, 1):
            if n > 1:
                made = pc.binary_join_element_wise(made.take(pa.array(prefix)), self.vocabulary.take(pa.array(word)), " ")
            if n >= self.low:
                out.append(made)
        return pa.concat_arrays(out)


def _opened(batches, ngrams):
    """(row of a batch as a dictionary of columns, its grams) of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            sizes, ids = (row[n].values.to_numpy(zero_copy_only=False) for n in ("sizes", "ids"))
            codes = _unpack(row["codes"].as_py(), row["n_words"].as_py(), np.int32)
            yield row, _Grams(sizes, codes, row["vocabulary"].values, ids, ngrams)


def _hash(columns, seed):
    out = np.full(len(columns[0]), seed, np.uint64)
    for c in columns:
        out = _mixed(out, c.astype(np.uint64))
    return out


def _cells(columns, bits):
    """Cells of the grams in the two lines of the sketch."""
    return [(_hash(columns, seed) >> np.uint64(64 - bits)).astype(np.int64) for seed in (1, 2)]


def _order(columns, width):
    """Positions in the order of the word ids, of which there are ``width``."""
    bits = max(1, int(width).bit_length())
    keys = []
    for c in columns:  # as many ids as fit share a key
        if keys and keys[-1][1] + bits <= 63:
            keys[-1] = (keys[-1][0] << bits | c, keys[-1][1] + bits)
        else:
            keys.append((c.astype(np.int64), bits))
    return np.argsort(keys[0][0], kind="stable") if len(keys) == 1 else np.lexsort([k for k, _ in reversed(keys)])


def sketch_of(blocks, ngrams, min_df, bits):
    """One row with one bit a cell: whether a count-min sketch of the document frequencies reaches ``min_df`` there.

    A task counts cells in two arrays of 2^bits numbers, whatever the number of n-grams.
    """
    top = min_df

    def count(batches):
        total = np.zeros((2, 1 << bits), np.int64)
        for _, grams in _opened(batches, ngrams):
            n, at = grams.text_counts(), 0
            for columns in grams.kept:
                here = n[at:at + len(columns[0])]
                for line, cell in zip(total, _cells(columns, bits)):
                    line += np.bincount(cell, here, 1 << bits).astype(np.int64)
                at += len(here)
        kind = np.uint8 if top < 256 else np.int64
        capped = np.minimum(total, top).astype(kind)
        for line in range(2):
            for at in range(0, 1 << bits, CHUNK):
                part = capped[line, at:at + CHUNK]
                yield pa.RecordBatch.from_pydict({"line": pa.array([line], pa.int32()), "at": pa.array([at], pa.int32()), "n": pa.array([part.tobytes()], pa.binary())})

    def full(pdf):
        kind = np.uint8 if top < 256 else np.int64
        total = sum(np.frombuffer(x, kind).astype(np.int64) for x in pdf["n"])
        packed = np.packbits(total >= top).tobytes()
        return pdf[["line", "at"]].head(1).assign(bits=[packed])

    parts = blocks.mapInArrow(count, "line int, at int, n binary").groupBy("line", "at").applyInPandas(full, "line int, at int, bits binary")
    return settle(parts.agg(F.array_sort(F.collect_list(F.struct("line", "at", "bits"))).alias("sketch")))


def frequencies(blocks, ngrams, min_df, sketch_bits=None):
    """The blocks with ``told`` and what ``_found`` needs to read it: for every n-gram twice its document frequency,
    0 below ``min_df``, plus 1 in one block each."""
    spark = blocks.sparkSession
    words = blocks.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    buckets = int(max(spark.sparkContext.defaultParallelism, words // BUCKET_TERMS))
    named = blocks.join(word_ids(blocks), "block", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    if sketch_bits:  # one bit a cell goes to every task
        named = named.crossJoin(F.broadcast(sketch_of(named, ngrams, min_df, sketch_bits)))

    def send(batches):
        for row, grams in _opened(batches, ngrams):
            n, before = grams.text_counts(), 0
            for level, columns in enumerate(grams.kept):
                for bucket, spots in _dealt(row, columns, buckets, sketch_bits):
                    # sorted, so that all but the last id of a gram differ little from one to the next
                    parts = [columns[i][spots] for i in range(len(columns))]
                    parts = [_pack(np.diff(c, prepend=np.int32(0))) for c in parts[:-1]] + [_pack(parts[-1])]
                    yield pa.RecordBatch.from_arrays([
                        row_block(row), pa.array([level * buckets + bucket], pa.int32()), pa.array([len(spots)], pa.int32()),
                        pa.array([parts], pa.list_(pa.binary())), pa.array([_pack(n[before + spots])], pa.binary())],
                        names=["block", "bucket", "size", "grams", "n"])
                before += len(columns[0])

    def row_block(row):
        return pa.array([row["block"].as_py()], pa.int64())

    def total(pdf):
        sizes = pdf["size"].to_numpy()
        n = np.concatenate([_unpack(x, k, np.int32) for x, k in zip(pdf["n"], sizes)])
        columns = []
        depth = len(pdf["grams"].iloc[0])
        for i in range(depth):
            read = [_unpack(g[i], k, np.int32) for g, k in zip(pdf["grams"], sizes)]
            columns.append(np.concatenate([np.cumsum(x, dtype=np.int32) if i < depth - 1 else x for x in read]))
        order = _order(columns, max(int(c.max()) for c in columns) + 1)
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
        starts = np.flatnonzero(new)
        df = np.add.reduceat(n[order].astype(np.int64), starts)
        df = np.where(df >= min_df, 2 * df, 0)
        found = np.empty(len(order), np.int64)
        found[order] = np.repeat(df, np.diff(np.append(starts, len(order))))
        found[order[starts]] += df > 0
        found = np.split(found, np.cumsum(sizes)[:-1])
        return pdf[["block", "bucket"]].assign(found=[_pack(x) for x in found])

    sent = named.mapInArrow(send, "block long, bucket int, size int, grams array<binary>, n binary")
    back = sent.groupBy("bucket").applyInPandas(total, "block long, bucket int, found binary")
    back = back.groupBy("block").agg(F.collect_list(F.struct("bucket", "found")).alias("told"))
    return named.join(back, "block").withColumn("buckets", F.lit(buckets))


def _dealt(row, columns, buckets, sketch_bits):
    """(bucket, positions of its grams in the order of their ids), of the grams that can be frequent enough."""
    order = _order(columns, max((int(c.max()) for c in columns if len(c)), default=0) + 1)
    if sketch_bits:
        lines = [[], []]
        for x in row["sketch"].as_py():
            lines[x["line"]].append(np.unpackbits(np.frombuffer(x["bits"], np.uint8))[:1 << sketch_bits])
        for line, cell in zip(lines, _cells(columns, sketch_bits)):
            order = order[np.concatenate(line)[cell[order]] == 1]
    bucket = _hash([c[order] for c in columns], 0) >> np.uint64(32)
    bucket = (bucket * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    dealt = np.argsort(bucket, kind="stable")
    ids, at = np.unique(bucket[dealt], return_index=True)
    return zip(ids.tolist(), np.split(order[dealt], at[1:])) if len(ids) else []


def _found(row, grams, sketch_bits=None):
    told, buckets = {x["bucket"]: x["found"] for x in row["told"].as_py()}, row["buckets"].as_py()
    out, before = np.zeros(grams.count, np.int64), 0
    for level, columns in enumerate(grams.kept):
        for bucket, spots in _dealt(row, columns, buckets, sketch_bits):
            out[before + spots] = _unpack(told[level * buckets + bucket], len(spots), np.int64)
        before += len(columns[0])
    return out


def _rows(columns, names):
    for at in range(0, len(columns[0]), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([c[at:at + OUT_ROWS] for c in columns], names=names)


def document_frequencies(df, ngrams, min_df, sketch_bits=None):
    """(term, df) of ``df`` with an array column ``words``."""
    def read(batches):
        for row, grams in _opened(batches, ngrams):
            found = _found(row, grams, sketch_bits)
            mine = np.flatnonzero(found & 1)
            yield from _rows([grams.texts().take(pa.array(mine)), pa.array(found[mine] >> 1)], ["term", "df"])

    blocks = text_blocks(df.select(F.lit(None).cast("int").alias("key"), "words"))
    return frequencies(blocks, ngrams, min_df, sketch_bits).mapInArrow(read, "term string, df long")


def weights(df, key, words, ngrams, min_df, n):
    """(key, term, weight) of unit length per key, idf = ln((1+n)/(1+df)) + 1; ``words`` is a column of arrays."""
    named = df.select(F.col(key).alias("key"), words.alias("words"))
    # rows of a key that comes several times are one text; the others stay where they are
    again = settle(df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    if again.isEmpty():
        blocks = text_blocks(named)
    else:
        blocks = text_blocks(attach(named, again, ["key"], "left_anti")).unionByName(
            text_blocks(attach(named, again, ["key"], "left_semi"), gather=True, part=1))
    schema = T.StructType([df.schema[key], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

    def read(batches):
        for row, grams in _opened(batches, ngrams):
            keys = row["keys"].values
            starts = _key_starts(keys)
            which, ids, tf = grams.counted(np.cumsum(starts) - 1)
            df_of = _found(row, grams) >> 1
            kept = df_of[ids] > 0
            which, ids, tf = which[kept], ids[kept], tf[kept]
            w = tf * (np.log((1.0 + n) / (1 + df_of[ids])) + 1)
            norm = np.sqrt(np.bincount(which, w * w))
            terms, own = grams.texts(), keys.take(pa.array(np.flatnonzero(starts)))
            for at in range(0, len(ids), OUT_ROWS):
                part = slice(at, at + OUT_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [own.take(pa.array(which[part])), terms.take(pa.array(ids[part])), pa.array(w[part] / norm[which[part]])], names=schema.names)

    return frequencies(blocks, ngrams, min_df).mapInArrow(read, schema)
