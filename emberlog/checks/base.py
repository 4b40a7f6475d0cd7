"""Views over the test tables, and the registry behind queries() and oracle_sql()."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from emberlog.functions.text import mask_variables
from emberlog.session import tune
from emberlog.sources.readers import spread

QUERIES = {}
ORACLES = {}


class Views:
    """The shapes the operators work on, read from one scale-factor folder."""

    def __init__(self, spark, sf_dir):
        self.spark = tune(spark)
        self.sf_dir = str(sf_dir).rstrip("/")

    def table(self, name):
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self):
        return spread(self.table("documents"))

    @cached_property
    def logs(self):
        return self.table("events").select(
            F.col("event_id").alias("log_id"),
            F.concat(F.lit("s"), F.col("user_id") % 16).alias("source"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat_ws(" ", "event_type", "props").alias("content"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
            "value",
        )

    @cached_property
    def texts(self):
        marks = self.table("labels").select("doc_id", "toxic")
        return self.documents.join(marks, "doc_id", "left").select(
            F.col("doc_id").alias("log_id"),
            "source",
            "lang",
            F.col("text").alias("content"),
            F.coalesce("toxic", F.lit(0)).alias("label"),
        )

    @cached_property
    def lines(self):
        """Every non-blank line of every document is a log line."""
        docs = self.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")))
        return docs.filter(F.trim("col") != "").select(
            (F.col("doc_id") * 100000 + F.col("pos")).alias("log_id"),
            "doc_id",
            "source",
            F.col("col").alias("content"),
        )

    @cached_property
    def tpl(self):
        """Masked lines with their source and the label of their document."""
        marks = self.table("labels").select("doc_id", "toxic")
        return self.lines.join(marks, "doc_id", "left").select(
            "log_id",
            "source",
            "content",
            mask_variables("content").alias("template"),
            F.col("toxic").alias("label"),
        )

    @cached_property
    def preds(self):
        marks = self.table("labels").select("doc_id", F.col("toxic").alias("y"))
        base = self.documents.join(marks, "doc_id").select(
            F.col("doc_id").alias("log_id"), "source", "y", "n_chars"
        )
        models = F.explode(F.array(*[
            F.struct(F.lit(name).alias("model"), F.lit(m).alias("modulus"))
            for name, m in (("m100", 100), ("m37", 37), ("m53", 53))
        ]))
        scored = base.withColumn("_m", models).withColumn(
            "score", (F.col("n_chars") % F.col("_m.modulus")) / F.col("_m.modulus").cast("double")
        )
        return scored.select(
            F.col("_m.model").alias("model"), "log_id", "source", "y", "score",
            F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("p"),
        )

    @cached_property
    def vecs(self):
        return self.table("embeddings").select(
            F.col("vec_id").alias("log_id"),
            F.concat(F.lit("s"), F.col("label") % 4).alias("source"),
            "label",
            F.col("embedding").alias("vec"),
        )

    @cached_property
    def wide(self):
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("log_id"),
            F.concat(F.lit("s"), F.col("l_suppkey") % 16).alias("source"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
            F.col("l_extendedprice").alias("value"),
        )


MASK_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c},
  '[a-fA-F0-9]{{8}}-[a-fA-F0-9]{{4}}-[a-fA-F0-9]{{4}}-[a-fA-F0-9]{{4}}-[a-fA-F0-9]{{12}}', '<UUID>', 'g'),
  '\b(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}\b', '<IP>', 'g'),
  '\b\d{{4}}-\d{{2}}-\d{{2}}\b', '<DATE>', 'g'),
  '\b\d{{2}}:\d{{2}}:\d{{2}}\b', '<TIME>', 'g'),
  '/[^\s]*', '<PATH>', 'g'),
  '\b[0-9a-fA-F]{{8,}}\b', '<HEX>', 'g'),
  '\d+', '<NUM>', 'g')"""


def mask_sql(column):
    return MASK_SQL.format(c=column)


def draw_sql(expr, seed):
    return f"('0x' || substr(md5(concat_ws('|', {expr}, '{seed}')), 1, 13))::BIGINT"


CTES = {
    "logs": """logs AS (SELECT event_id AS log_id, 's' || (user_id % 16) AS source, ts,
  event_type || ' ' || props AS content, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, value FROM events)""",
    "texts": """texts AS (SELECT d.doc_id AS log_id, d.source, d.lang, d.text AS content, coalesce(l.toxic, 0) AS label
  FROM documents d LEFT JOIN labels l USING (doc_id))""",
    "lines": """split_lines AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, source, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS pos FROM split_lines),
lines AS (SELECT doc_id * 100000 + pos AS log_id, doc_id, source, content FROM numbered WHERE trim(content) <> '')""",
    "preds": """preds AS (SELECT m.model, d.doc_id AS log_id, d.source, l.toxic AS y,
  (d.n_chars % m.modulus) / m.modulus::DOUBLE AS score,
  CASE WHEN (d.n_chars % m.modulus) / m.modulus::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS p
  FROM documents d JOIN labels l USING (doc_id)
  CROSS JOIN (VALUES ('m100', 100), ('m37', 37), ('m53', 53)) m(model, modulus))""",
    "vecs": """vecs AS (SELECT vec_id AS log_id, 's' || (label % 4) AS source, label, embedding AS vec FROM embeddings)""",
    "wide": """wide AS (SELECT l_orderkey * 10 + l_linenumber AS log_id, 's' || (l_suppkey % 16) AS source,
  l_shipdate AS ts, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_extendedprice AS value FROM lineitem)""",
}
CTES["tpl"] = CTES["lines"] + f""",
tpl AS (SELECT n.log_id, n.source, n.content, {mask_sql('n.content')} AS template, l.toxic AS label
  FROM lines n LEFT JOIN labels l USING (doc_id))"""


def check(name, views="", sql=None):
    """Register a query; ``sql`` is its DuckDB twin, with the named views in front."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ctes = [CTES[v] for v in views.split()]
            body = sql.strip()
            if ctes:
                if body[:4].upper() == "WITH":
                    body = "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
                else:
                    body = "WITH " + ",\n".join(ctes) + "\n" + body
            ORACLES[name] = body
        return fn

    return keep


def r6(column, places=6):
    return F.round(column, places)
