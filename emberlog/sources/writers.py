"""Sinks: partitioned logs and features, profiles, predictions, labelling progress, models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from emberlog.sources.runs import commit, compact, read_part


def write_logs(df, path, fmt="parquet", mode="overwrite"):
    df.write.mode(mode).partitionBy("source").format(fmt).option("header", True).save(path)


def write_features(df, path, mode="overwrite"):
    """Feature table with named columns or vectors; one folder per source."""
    df.write.mode(mode).partitionBy("source").parquet(path)


def write_profile(df, path, mode="overwrite"):
    """Aggregate rows as JSON lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def new_sources(scored, dimension):
    """Source names of scored rows that the dimension lacks."""
    names = scored.select(F.col("source_type").alias("name")).distinct()
    if dimension is not None:
        names = names.join(dimension.select("name"), "name", "left_anti")
    return names.select(
        F.xxhash64("name").alias("source_id"), "name", F.concat(F.lit("Auto-detected "), "name", F.lit(" logs")).alias("description")
    )


def prediction_tables(scored, model_type, model_name):
    """(log rows, prediction rows) with keys made from the row's own values; error rows are left out."""
    ok = scored.filter(F.col("error").isNull())
    key = F.xxhash64("raw", "source_type", "log_id")
    logs = ok.select(key.alias("entry_id"), "raw", "content", F.xxhash64("source_type").alias("source_id"), "day")
    preds = ok.select(
        F.xxhash64(key, F.lit(model_type), F.lit(model_name)).alias("prediction_id"), key.alias("entry_id"),
        F.lit(model_type).alias("model_type"), F.lit(model_name).alias("model_name"),
        "predicted_class", "predicted_class_name", "confidence", "probabilities", "day",
    )
    return logs, preds


STORE = {  # part -> (schema, partition columns)
    "sources": ("source_id long, name string, description string", []),
    "entries": ("entry_id long, raw string, content string, source_id long, day string", ["day"]),
    "predictions": (
        "prediction_id long, entry_id long, model_type string, model_name string, predicted_class int, predicted_class_name string, "
        "confidence double, probabilities array<double>, day string", ["day"]),
}


def save_predictions(scored, base_path, model_type="ml", model_name="model"):
    """Add new sources, log rows and predictions to the store at ``base_path``, facts by day.

    All three parts become visible together or not at all; of runs at the same time each
    source and each key is kept once.
    """
    spark = scored.sparkSession

    def make(seen):
        held = {part: read_part(spark, base_path, part, schema, seen) for part, (schema, _) in STORE.items()}
        logs, preds = prediction_tables(scored, model_type, model_name)
        return {
            "sources": (new_sources(scored, held["sources"]), []),
            "entries": (_new_rows(logs, held["entries"], "entry_id"), ["day"]),
            "predictions": (_new_rows(preds, held["predictions"], "prediction_id"), ["day"]),
        }

    return commit(spark, base_path, make)


def read_predictions(spark, base_path, part="predictions"):
    """``sources``, ``entries`` or ``predictions`` as last published."""
    return read_part(spark, base_path, part, STORE[part][0])


def compact_predictions(spark, base_path):
    """The store's runs as one."""
    return compact(spark, base_path, STORE)


def _new_rows(rows, held, key):
    """The rows whose key the same day of the table lacks; each key once."""
    days = [r["day"] for r in rows.select("day").distinct().collect()]  # the days scored in this run
    return rows.dropDuplicates(["day", key]).join(
        held.filter(F.col("day").isin(days)).select("day", key), ["day", key], "left_anti")


def progress_text(items, samples="samples"):
    """Sample lists as JSON text, the form CSV can carry."""
    return items.withColumn(samples, F.to_json(samples))


def progress_lists(items, samples="samples"):
    return items.withColumn(samples, F.from_json(samples, ArrayType(StringType())))


def save_progress(items, path, fmt="parquet", mode="overwrite"):
    if fmt == "csv":
        progress_text(items).write.mode(mode).csv(path, header=True, escape='"')
    else:
        items.write.mode(mode).parquet(path)


def load_progress(spark, path, fmt="parquet", schema=None):
    if fmt == "csv":
        return progress_lists(spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True))
    return spark.read.parquet(path)


def save_model(fitted, path, spark, **meta):
    """Fitted pipeline and a one-row table of its facts."""
    fitted.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").write.mode("overwrite").json(f"{path}/meta")


def load_model(path, spark):
    meta = spark.read.json(f"{path}/meta", schema="meta string").first()["meta"]
    return PipelineModel.load(f"{path}/pipeline"), json.loads(meta)
