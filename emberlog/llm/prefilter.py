"""A bitmap of bounded size that keeps rows from a shuffle they can't matter in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

LEAST, MOST = 1 << 16, 1 << 26  # bits; 8 MB at most


def possible(rows, key, wanted, name):
    """The rows whose ``key`` may be among ``name`` of ``wanted``; none that is among them is lost.

    The bitmap has 16 bits a key up to MOST bits. More keys only let more rows pass.
    """
    spark, n = rows.sparkSession, wanted.count()
    bits = min(max(LEAST, 1 << (16 * n).bit_length()), MOST)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    at = place(F.col(name))
    parts = wanted.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")).collect()  # 4 kB each
    bitmap = np.zeros(bits // 8, np.uint8)
    for p in parts:
        piece = np.frombuffer(p["bitmap"], np.uint8)
        bitmap[(p["bucket"] - 1) * 4096 : (p["bucket"] - 1) * 4096 + len(piece)] = piece
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        held = shared.value
        for b in batches:
            bit = b.column("_bit").to_numpy(zero_copy_only=False) - 1
            hit = np.nonzero((held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)[0]
            if len(hit):
                yield b.take(hit).drop_columns(["_bit"])

    return rows.withColumn("_bit", place(F.col(key))).mapInArrow(run, rows.schema)
