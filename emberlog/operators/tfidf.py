"""Terms of one to three words, their document frequencies and weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.operators.ngrams import document_frequencies, weights

TOKEN = r"[\p{L}\p{N}_]{2,}"


def words(col):
    """The lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(F.col(col) if isinstance(col, str) else col), F.lit(TOKEN), 0)


def terms(col, ngrams=(1, 3)):
    """All n-grams of lower-cased words as one array."""
    base = words(col)

    def grown(tokens):
        parts, last = [], tokens
        for n in range(1, ngrams[1] + 1):
            if n > 1:
                shifted = F.slice(tokens, F.lit(n), F.greatest(F.size(tokens), F.lit(1)))
                last = F.filter(F.zip_with(last, shifted, lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())
            if n >= ngrams[0]:
                parts.append(last)
        return F.concat(*parts)

    # the token array is bound once, so that it is not split again for every n
    return F.flatten(F.transform(F.array(base), grown))


def term_counts(df, content="content", key="log_id", ngrams=(1, 3)):
    return df.select(key, F.explode(terms(content, ngrams)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


SKETCH_ROWS = 2


def _cell(term, row, bits):
    """Cell of a term in one row of the sketch."""
    return F.shiftrightunsigned(F.xxhash64(term, F.lit(row)), 64 - bits)


def maybe_frequent(terms_of_rows, min_df, bits=22, term="term"):
    """The rows whose term can occur ``min_df`` times, by a count-min sketch; no frequent term is lost.

    A first pass counts cells, whose partial counts have a fixed width and at most ``SKETCH_ROWS`` x 2^bits
    rows a task, however many terms there are. Of the cells only one bit each is kept: 2^bits / 64
    longs a row of the sketch, 512 KB for 22 bits, broadcast so that the terms are joined where they are.
    A rare term stays only where a cell of it adds up to ``min_df`` in every row: cells have to outnumber
    all terms of all rows over ``min_df``. For a ``min_df`` that is a share of the rows this number is
    constant, the terms of a row over the share; for a small fixed one it grows with the table.
    """
    if not 6 <= bits <= 24:
        raise ValueError("bits must lie in 6..24")  # 4 MB broadcast for a row of the sketch at most
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), _cell(F.col(term), r, bits).alias("cell")) for r in range(SKETCH_ROWS)]))
    counts = terms_of_rows.select(cells.alias("c")).groupBy("c.row", "c.cell").agg(F.count("*").alias("n"))
    one = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    full = settle(counts.filter(F.col("n") >= min_df).groupBy("row", F.shiftright("cell", 6).alias("_word")).agg(F.bit_or(one).alias("_bits")))
    out = terms_of_rows
    for r in range(SKETCH_ROWS):
        cell = _cell(F.col(term), r, bits)
        words = full.filter(F.col("row") == r).drop("row")
        out = out.join(F.broadcast(words), F.shiftright(cell, 6) == F.col("_word")).filter(
            F.getbit("_bits", cell.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("_word", "_bits")
    return out


def idf_table(df, content="content", key="log_id", ngrams=(1, 3), min_df=1, max_terms=None, sketch_bits=None):
    """term, df, idf = ln((1+n)/(1+df)) + 1; the most frequent ``max_terms`` if given.

    With ``sketch_bits`` a second reading of the texts saves the shuffle of most terms below ``min_df``;
    see ``maybe_frequent`` for when it pays.
    """
    n = df.count()
    if max_terms:
        counts = term_counts(df, content, key, ngrams).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    else:  # a term once per row, counted by blocks of texts
        counts = document_frequencies(df.select(words(content).alias("words")), ngrams, min_df, sketch_bits)
    kept = counts.filter(F.col("df") >= min_df)
    if max_terms:
        kept = kept.orderBy(F.col("tf").desc(), "term").limit(max_terms)
    return kept.select("term", "df", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(df, content="content", key="log_id", ngrams=(1, 3), min_df=1, max_terms=None, idf=None):
    """(key, term, weight) rows of unit length per document."""
    if idf is None and not max_terms:
        return weights(df, key, words(content), ngrams, min_df, df.count())
    idf = settle(idf if idf is not None else idf_table(df, content, key, ngrams, min_df, max_terms))
    raw = term_counts(df, content, key, ngrams).join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # the terms of one document
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))
