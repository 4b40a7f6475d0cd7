"""Joins between logs, templates, predictions and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.functions.labels import label_name
from emberlog.operators.draws import draw, hash_rank
from emberlog.operators.edits import nearest_texts
from emberlog.operators.ordering import attach, literals
from emberlog.operators.windows import next_in_group


def apply_template_labels(logs, labels, template="template", label="label"):
    """Label every log through its template; unknown templates give -1 and unlabeled."""
    known = settle(labels.select(template, F.col(label).alias("_found")))
    out = attach(logs, known, [template])
    found = F.coalesce("_found", F.lit(-1))
    return out.withColumn("anomaly_label", found).withColumn("anomaly_label_name", label_name(found)).drop("_found")


def compare_methods(maml, proto, transfer, by="source", f1="f1"):
    """F1 of three methods on their common sources; the first one wins ties."""
    a = maml.select(by, F.col(f1).alias("maml_f1"))
    b = proto.select(by, F.col(f1).alias("proto_f1"))
    c = transfer.select(by, F.col(f1).alias("transfer_f1"))
    out = a.join(b, by).join(c, by)
    top = F.greatest("maml_f1", "proto_f1", "transfer_f1")
    best = F.when(F.col("maml_f1") == top, "MAML").when(F.col("proto_f1") == top, "Prototypical").otherwise("Transfer")
    return out.withColumn("best_method", best)


def loso_splits(df, by="source", label="label"):
    """Per labelled source held out: the number of other sources and the row counts of both sides.

    The train side of a split is a filter (``loso_data``), so no list of sources is made.
    """
    per = settle(df.filter(F.col(label).isNotNull()).groupBy(by).agg(F.count("*").alias("n")))
    total = literals(per.agg(F.count("*").alias("sources"), F.sum("n").alias("all")))
    return per.select(
        F.col(by).alias("test_source"),
        (total["sources"] - 1).alias("train_sources"),
        F.col("n").alias("test_rows"),
        (total["all"] - F.col("n")).alias("train_rows"),
    )


def loso_data(df, test_source, by="source"):
    """Train and test rows of one split; with a table partitioned by source both prune files."""
    return df.filter(F.col(by) != test_source), df.filter(F.col(by) == test_source)


def logs_with_predictions(logs, preds, key="log_id", fields=("model", "p", "score")):
    """Each log with the sorted list of its predictions; empty list without any."""
    lists = preds.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("predictions"))
    out = logs.join(lists, key, "left")
    return out.withColumn("predictions", F.coalesce("predictions", F.array().cast(lists.schema["predictions"].dataType)))


def fuzzy_transfer(new, known, threshold=90, template="template", label="label", confidence="confidence"):
    """Best known template per new one, by edit-distance ratio.

    At ``threshold`` or above the known label becomes the suggestion and low confidence
    rises to medium. The rule is exact for the threshold, nothing within it is missed
    (``edits.nearest_texts``). Ties go to the smaller template text, then to the smaller label.
    ``new`` is read three times and ``known`` twice, so they should be settled.
    """
    slack = 1 - threshold / 100
    if not 0 <= slack <= 0.2:
        raise ValueError("threshold must lie in 80..100")
    texts = new.select(F.col(template).alias("text"))
    best = nearest_texts(texts, known.select(F.col(template).alias("text"), F.col(label).alias("label")), slack)
    best = best.select(F.col("text").alias(template), "match", "score", F.col("label").alias("suggested"))
    out = attach(new, best, [template])
    if confidence in new.columns:
        raised = (F.col("match").isNotNull()) & (F.col(confidence) == "low")
        out = out.withColumn(confidence, F.when(raised, "medium").otherwise(F.col(confidence)))
    return out


LOAD = 10_000  # rows one copy of a lookup row may have to answer


def _lookup(wanted, members, key_cols, load):
    """Equi-join of drawn ranks with members; members of small classes are copied and salted."""
    copies = F.greatest(F.lit(1), F.ceil(F.col("_load") / load).cast("int"))
    salted = members.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return wanted.join(salted, [*key_cols, "_salt"])


def contrastive_pairs(df, seed=42, template="content", label="label", log_id="log_id", augment=False, by="source"):
    """Pairs for contrastive training: (first, second, same, kind).

    Every row gets one drawn partner of its own label and one of another label, found by
    equi-joins on the draw rank; neighbours of one template with equal labels are added.
    """
    rows = df.select(by, log_id, label, template).filter(F.col(label).isNotNull())
    ranked = settle(hash_rank(rows.select(log_id, label), [label], log_id, seed=seed, name="rank", size="n"))
    sizes = {r[label]: r["n"] for r in ranked.groupBy(label).agg(F.max("n").alias("n")).collect()}
    total = sum(sizes.values())
    labels = sorted(sizes)
    size_of = F.create_map(*[F.lit(x) for k in labels for x in (k, sizes[k])])
    members = ranked.select(
        F.col(label).alias("want"), F.col("rank").alias("pick"), F.col(log_id).alias("second"),
        (F.lit(float(total)) / F.col("n")).alias("_load"),
    )
    salts = lambda want: F.pmod(
        draw(log_id, seed=seed + 9),
        F.greatest(F.lit(1), F.ceil(F.lit(float(total)) / size_of[want] / LOAD).cast("int")),
    ).cast("int")

    step = 1 + F.pmod(draw(log_id, seed=seed + 1), F.col("n") - 1)
    positive = ranked.filter("n > 1").select(
        F.col(log_id).alias("first"), F.col(label).alias("want"), log_id,
        (F.pmod(F.col("rank") - 1 + step, F.col("n")) + 1).alias("pick"), F.lit(1).alias("same"), F.lit("label").alias("kind"),
    )
    parts = [positive]
    if len(labels) > 1:
        spot = F.pmod(draw(log_id, seed=seed + 2), F.lit(len(labels) - 1)).cast("int")
        others = F.array_except(F.array(*[F.lit(k) for k in labels]), F.array(label))
        negative = ranked.withColumn("want", F.get(others, spot)).select(
            F.col(log_id).alias("first"), "want", log_id,
            (F.pmod(draw(log_id, seed=seed + 3), size_of[F.col("want")]) + 1).alias("pick"),
            F.lit(0).alias("same"), F.lit("other_label").alias("kind"),
        )
        parts.append(negative)
    wanted = reduce(lambda x, y: x.unionByName(y), parts).withColumn("_salt", salts(F.col("want")))
    out = _lookup(wanted, members, ["want", "pick"], LOAD).select("first", "second", "same", "kind")

    chained = next_in_group(rows, template, log_id, by).filter(F.col("prev_label") == F.col(label))
    out = out.unionByName(chained.select(
        F.col("prev_id").alias("first"), F.col(log_id).alias("second"), F.lit(1).alias("same"), F.lit("template").alias("kind")
    ))
    if augment and len(labels) > 1:
        rare = min(labels, key=lambda k: (sizes[k], k))
        n = sizes[rare]
        if n > 1:
            spins = df.sparkSession.range(3 * n).select(
                (F.pmod(draw("id", seed=seed + 4), F.lit(n)) + 1).alias("a"),
                (1 + F.pmod(draw("id", seed=seed + 5), F.lit(n - 1))).alias("s"),
            ).withColumn("b", F.pmod(F.col("a") - 1 + F.col("s"), F.lit(n)) + 1)
            pool = ranked.filter(F.col(label) == rare)
            one = pool.select(F.col("rank").alias("a"), F.col(log_id).alias("first"))
            two = pool.select(F.col("rank").alias("b"), F.col(log_id).alias("second"))
            out = out.unionByName(spins.join(one, "a").join(two, "b").select(
                "first", "second", F.lit(1).alias("same"), F.lit("minority").alias("kind")
            ))
    return out
