"""Hard negatives by exact integer scores from residue arithmetic.

Vectors are whole numbers. For each of a few primes below 1,024 their residues, centred on
zero, are float32 matrices; a product over 64 components stays below 2^24, so float32 holds
it exactly, and longer vectors are multiplied in strips of 64. The scores come back from
their residues by Chinese remaindering with signed digits, as many primes as the largest
squared length of a vector asks for. No score is rounded anywhere.

Anchors are numbered and cut into blocks of ``BLOCK_BYTES`` of residues; rows are dealt out
in parts of ``PART_ROWS``. A task gets one block, then streams the rows of one part past it,
tile by tile, keeping the best ``k`` of every anchor (and positive) at hand; windows over
(anchor, positive) then choose among what the parts sent. Positives come from a first round
and bound the window of scores in the second. Every anchor meets every row, in blocks.

Components are floored after scaling. Rows with a null label, a null vector, a null or
non-finite component take no part; nor do those whose squared length passes 2^60, since
their scores would not fit a long. Vectors of unlike length are filled up with zeros. Ties go
to the smaller id. Repeated rows count each: an anchor that stands twice is answered twice,
rows of the anchor's own id are none of its positives. A null id is no anchor and comes
last among ties. Other columns are left alone. No rows, or no anchors: no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.llm.base import query, table
from emberlog.operators.ordering import with_sequence

STRIP = 64
BLOCK_BYTES = 32 << 20
PART_ROWS = 250_000
TILE = (512, 2048)  # anchors, rows
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def primes_for(bound):
    """Largest primes under 1,024 whose product passes twice ``bound``."""
    found, product, p = [], 1, 1021
    while product <= 2 * bound + 1:
        if all(p % q for q in range(3, 32, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def residues(vectors, p):
    """Centred residues in float32."""
    half = p // 2
    return ((vectors + half) % p - half).astype(np.float32)


def scores(left, right, primes):
    """Exact products of the rows of two lists of residue matrices (one per prime)."""
    value, radix = None, 1
    for p, a, b in zip(primes, left, right):
        r = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], STRIP):
            r += (a[:, at : at + STRIP] @ b[:, at : at + STRIP].T).astype(np.int64)
        half = p // 2
        if value is None:
            value = (r + half) % p - half
        else:
            digit = (r - value) % p * pow(radix, -1, p)
            value += ((digit + half) % p - half) * radix
        radix *= p
    return value


def best(slot, ids, points, k):
    """Order of the ``k`` best entries of each slot: higher points first, then smaller ids."""
    order = np.lexsort((ids, -points, slot))
    s = slot[order]
    first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0)) if len(s) else s
    return order[np.arange(len(s)) - begin < k]


class Chunk:
    """Up to TILE[0] anchors and the best entries of each of their slots so far."""

    def __init__(self, seq, ids, labels, left, low, high, k, same):
        self.seq, self.ids, self.labels, self.left, self.low, self.high, self.k, self.same = seq, ids, labels, left, low, high, k, same
        self.width = low.shape[1]
        self.slot, self.id, self.points = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = low.copy()

    def meet(self, ids, labels, right, primes):
        got = scores(self.left, right, primes)
        equal = self.labels[:, None] == labels
        fit = equal & (self.ids[:, None] != ids) if self.same else ~equal
        slots, at = [self.slot], []
        for s in range(self.width):
            a, r = np.nonzero(fit & (got >= self.least[:, s, None]) & (got <= self.high[:, s, None]))
            slots.append(a * self.width + s)
            at.append((a, r))
        if not any(len(a) for a, _ in at):
            return
        slot = np.concatenate(slots)
        id = np.concatenate([self.id, *[ids[r] for _, r in at]])
        points = np.concatenate([self.points, *[got[a, r] for a, r in at]])
        kept = best(slot, id, points, self.k)
        self.slot, self.id, self.points = slot[kept], id[kept], points[kept]
        full = np.flatnonzero(np.bincount(self.slot, minlength=self.least.size) == self.k)
        worst = np.full(self.least.size, HIGHEST)
        np.minimum.at(worst, self.slot, self.points)
        flat = self.least.ravel()
        flat[full] = np.maximum(flat[full], worst[full])


def matrix(column, dims):
    """Whole numbers of a list column as rows of ``dims``, short ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(sizes) * dims:
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


MET = "_cell long, _anchor boolean, _seq long, _id long, _label long, _vec array<int>, _low array<long>, _high array<long>"


def meet(anchors, rows, shape, k, same):
    """The best ``k`` rows within every slot of every anchor, of each part of the rows.

    ``anchors``: _seq, _id, _label, _vec, _low, _high (bounds of each slot's scores). Returns
    _seq, _slot, _id, _points.
    """
    dims, primes, block, parts = shape["dims"], shape["primes"], shape["block"], shape["parts"]
    n_anchors, n_rows = TILE
    blocks = -(-shape["anchors"] // block)
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("array<long>")
    left = anchors.withColumn("_part", span(parts)).select(
        (F.floor(F.col("_seq") / block).cast("long") * parts + F.col("_part")).alias("_cell"), F.lit(True).alias("_anchor"),
        "_seq", "_id", "_label", "_vec", "_low", "_high")
    right = rows.withColumn("_part", F.monotonically_increasing_id() % parts).withColumn("_block", span(blocks)).select(
        (F.col("_block").cast("long") * parts + F.col("_part")).alias("_cell"), F.lit(False).alias("_anchor"),
        F.lit(None).cast("long").alias("_seq"), "_id", "_label", "_vec", none.alias("_low"), none.alias("_high"))
    dealt = left.unionByName(right).repartition("_cell").sortWithinPartitions("_cell", F.desc("_anchor"), "_id")

    def run(batches):
        cell, gathered, chunks = None, [], []

        def started():
            """Chunks of the anchors gathered."""
            if not gathered:
                return []
            seq, ids, labels, vec, low, high = (np.concatenate(x) for x in zip(*gathered))
            gathered.clear()
            cuts = [slice(i, i + n_anchors) for i in range(0, len(seq), n_anchors)]
            return [Chunk(seq[c], ids[c], labels[c], [residues(vec[c], p) for p in primes], low[c], high[c], k, same) for c in cuts]

        def ended():
            for c in chunks:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.seq[c.slot // c.width]), pa.array((c.slot % c.width).astype(np.int32)), pa.array(c.id), pa.array(c.points)],
                    names=["_seq", "_slot", "_id", "_points"])

        for b in batches:
            cells = b.column("_cell").to_numpy()
            leads = b.column("_anchor").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((cells[1:] != cells[:-1]) | (leads[1:] != leads[:-1])) + 1
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(cells)]):
                if lo == hi:
                    continue
                if cells[lo] != cell:
                    yield from ended()
                    cell, chunks = cells[lo], []
                    gathered.clear()
                part = b.slice(lo, hi - lo)
                number = lambda n: part.column(n).fill_null(HIGHEST).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                ids, labels = number("_id"), number("_label")
                if leads[lo]:
                    bounds = [np.stack(part.column(n).to_numpy(zero_copy_only=False)) for n in ("_low", "_high")]
                    gathered.append((number("_seq"), ids, labels, matrix(part.column("_vec"), dims), *bounds))
                    continue
                chunks = chunks or started()
                for at in range(0, len(ids), n_rows) if chunks else ():
                    cut = slice(at, at + n_rows)
                    right = [residues(matrix(part.column("_vec").slice(at, n_rows), dims), p) for p in primes]
                    for c in chunks:
                        c.meet(ids[cut], labels[cut], right, primes)
        yield from ended()

    return dealt.mapInArrow(run, "_seq long, _slot int, _id long, _points long")


def known(id):
    """The id, null where it stood for a null one."""
    return F.nullif(F.col(id), F.lit(HIGHEST))


def top(found, keys, k):
    """The ``k`` best of every key over all parts, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("_points"), "_id")
    return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)


def whole_vectors(rows, id, label, vector, scale):
    """``_id``, ``_label`` and ``_vec``, the floored components, of the rows that take part."""
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    sound = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < 2.0**30))
    made = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(id).cast("long").alias("_id"), F.col(label).cast("long").alias("_label"), x.alias("_x"))
    square = F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v)
    return made.withColumn("_square", square).filter(F.col("_square") <= float(1 << 60)).withColumn("_vec", F.col("_x").cast("array<int>"))


def mine(rows, is_anchor, id="vec_id", label="label", vector="embedding", scale=256, positives=5, negatives=5, percent=80):
    """For every anchor and each of its ``positives`` best rows of the same label, the ``negatives``
    best rows of another label that score from ``percent`` percent of the positive up to it.

    ``is_anchor`` makes a condition from the id column. Returns anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score and the anchor's number.
    """
    spark = rows.sparkSession
    made = settle(whole_vectors(rows, id, label, vector, scale).withColumn("_is", F.coalesce(
        is_anchor(F.col("_id")), F.lit(False))))
    size = made.agg(F.max("_square").alias("square"), F.max(F.size("_vec")).alias("dims"), F.count("*").alias("rows"),
                    F.count_if("_is").alias("anchors")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, anchor_no long"
    if not size["anchors"]:
        return spark.createDataFrame([], schema)
    primes = primes_for(int(size["square"]) + 1)
    dims = max(1, size["dims"])
    shape = {
        "dims": dims, "primes": primes, "anchors": size["anchors"], "block": max(1, BLOCK_BYTES // (4 * dims * len(primes))),
        "parts": max(-(-size["rows"] // PART_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))}
    rows = made.select("_id", "_label", "_vec")
    anchors = settle(with_sequence(made.filter("_is").select("_id", "_label", "_vec"), [], ["_id"], "_seq"))
    wide = F.array(F.lit(LOWEST)), F.array(F.lit(HIGHEST))
    like = meet(anchors.withColumns({"_low": wide[0], "_high": wide[1]}), rows, shape, positives, True)
    like = settle(top(like, ["_seq"], positives).select("_seq", "_rank", F.col("_id").alias("_pos"), F.col("_points").alias("_to")))
    # percent/100 of the score, rounded up, without leaving the range of a long
    low = F.expr(f"_to div 100 * {percent} + ceil((_to - _to div 100 * 100) * {percent} / 100.0)").cast("long")
    each = lambda of, rest: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda r: F.coalesce(F.get("_w", r - 1)[of], F.lit(rest)))
    windows = like.groupBy("_seq").agg(F.array_sort(F.collect_list(F.struct("_rank", low.alias("low"), F.col("_to").alias("high")))).alias("_w"))
    asked = anchors.join(windows, "_seq").withColumns({"_low": each("low", HIGHEST), "_high": each("high", LOWEST)}).drop("_w")
    unlike = top(meet(asked, rows, shape, negatives, False), ["_seq", "_slot"], negatives)
    chosen = unlike.select("_seq", (F.col("_slot") + 1).alias("_pick"), "_rank", known("_id").alias("negative_id"), F.col("_points").alias("negative_score"))
    return chosen.join(like.withColumnRenamed("_rank", "_pick"), ["_seq", "_pick"]).join(
        anchors.select("_seq", F.col("_id").alias("anchor_id")), "_seq").select(
        "anchor_id", known("_pos").alias("positive_id"), F.col("_rank").cast("int").alias("rank"), "negative_id",
        F.col("_to").alias("positive_score"), "negative_score", F.col("_seq").alias("anchor_no"))


OP13_SQL = """
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike,
    list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM base a JOIN base r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, lambda i: i % 100 == 0).drop("anchor_no")
