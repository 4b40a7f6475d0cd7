"""From raw documents to training tokens, stage by stage.

Every stage is written as Parquet in the shared folder and read again by the next, so a lost
executor never costs more than the stage it is in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.durable import fresh_path
from emberlog.llm.base import table
from emberlog.llm.byte_bpe import encode, public_ranks
from emberlog.llm.decontamination import decontaminate
from emberlog.llm.near_duplicates import near_deduplicate
from emberlog.llm.quality_rules import quality_filter
from emberlog.llm.repeated_spans import remove_repeats
from emberlog.session import tune


def keep_quality(spark, docs, sf_dir):
    """Documents that fail the base rules or leave the fences of their language and source go."""
    return quality_filter(docs)


def keep_distinct(spark, docs, sf_dir):
    """One document of each class of near duplicates stays, the one of smallest id."""
    return near_deduplicate(docs)


def cut_repeats(spark, docs, sf_dir):
    """Strings of 100 bytes that occur earlier are cut out; ``n_chars`` follows the text."""
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_leaks(spark, docs, sf_dir):
    """Documents that hold a passage of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark, docs, sf_dir):
    """Token ids of every text, and the text read back from them."""
    ranks, pattern = public_ranks()
    coded = encode(docs, ranks, pattern, read_back="text")
    return coded.select(
        "doc_id", "text", "lang", "source", "n_chars", "tokens", F.size("tokens").cast("long").alias("n_tokens"))


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", keep_distinct),
    ("repeated_spans", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", tokenize),
]

#: The near-duplicate and tokenizer stages have no SQL form; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    spark, sf_dir = tune(spark), str(sf_dir).rstrip("/")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
