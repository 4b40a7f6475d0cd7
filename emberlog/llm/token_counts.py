"""Token counts from an exact histogram of encoded lengths.

Documents are counted by encoded length, with map-side combine; the histogram has one row
per distinct length. Suffix sums over it answer, for every context limit, how many
documents reach it, the tokens they hold, and the total after truncation. The sums run
over slices of the histogram with carried totals, so no single task holds all lengths.

A null text has length 0. Repeated rows count each. An empty table has an empty histogram.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.llm.base import extend, query, small_batches, table
from emberlog.llm.byte_bpe import public_ranks
from emberlog.operators.ordering import running_totals


@cache
def _encoder(ranks_path, pattern):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_lengths(docs, ranks_path, pattern, text="text", length="n_tokens", keep=()):
    """The columns ``keep`` of ``docs`` and the encoded length of the whole text."""
    small_batches(docs)
    rows = docs.select(*[F.col(k) for k in keep], F.col(text).alias("_text"))
    schema = extend(rows.drop("_text").schema, f"{length} long")

    def run(batches):
        encode = _encoder(ranks_path, pattern).encode_ordinary
        for b in batches:
            sizes = [len(encode(x.as_py() or "")) for x in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(sizes, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def histogram(lengths, length="n_tokens"):
    """Documents of every length, and with suffix sums what each length answers as a context limit.

    ``docs_at_least`` and ``tokens_at_least`` cover documents of this length or more;
    ``docs_up_to`` those of this length or less; ``truncated_total`` is the sum of
    min(length, limit) over all documents.
    """
    # written once: a row per distinct length, so the texts are encoded once
    counted = settle(lengths.groupBy(F.col(length).alias("n_tokens")).agg(F.count("*").alias("n_docs")))
    sums = running_totals(counted, [], [F.desc("n_tokens")], {
        "docs_at_least": F.col("n_docs"), "tokens_at_least": F.col("n_docs") * F.col("n_tokens")})
    whole = counted.agg(F.sum("n_docs").alias("_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_tokens")).first()
    docs, tokens = (whole["_docs"] or 0), (whole["_tokens"] or 0)
    return sums.withColumns({
        "docs_up_to": F.lit(docs) - F.col("docs_at_least") + F.col("n_docs"),
        "truncated_total": F.lit(tokens) - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"),
    })


def totals_at(answers, limits):
    """``limit``, documents at least that long and ``truncated_total``, for any limits (a short list)."""
    rows = [
        F.struct(
            F.lit(int(k)).cast("long").alias("limit"),
            F.sum(F.when(F.col("n_tokens") >= k, F.col("n_docs")).otherwise(0)).alias("docs_at_least"),
            F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(int(k)))).alias("truncated_total"))
        for k in limits
    ]
    return answers.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def quantile(answers, share):
    """Smallest length that at least ``share`` of the documents don't exceed (null for an empty histogram)."""
    reached = F.col("docs_up_to") >= F.lit(share) * F.col("_all")
    size = answers.select(F.sum("n_docs").alias("_all")).first()["_all"] or 0
    return answers.withColumn("_all", F.lit(size)).agg(F.min(F.when(reached, F.col("n_tokens"))).alias("quantile")).first()["quantile"]


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    return histogram(with_lengths(table(spark, sf_dir, "documents"), *public_ranks()))
