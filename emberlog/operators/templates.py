"""Template mining on distinct masked lines.

Lines are masked, reduced to distinct texts with counts, and grouped by length and
leading tokens. Inside a group a text joins the first leader, in frequency then text
order, that shares enough tokens with it; otherwise it becomes a leader. Positions
where members differ become <*>. The outcome does not depend on row order or
partitioning.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.functions.text import mask_variables
from emberlog.operators.ordering import attach, slice_count, with_sequence
from emberlog.operators.profile import top_of_group

# Similarity and depth per source type.
TREE_SETTINGS = {
    "hdfs": (0.5, 4),
    "bgl": (0.3, 5),
    "hadoop": (0.4, 4),
    "apache": (0.4, 4),
    "default": (0.4, 4),
}
WILDCARDS = ["<NUM>", "<IP>", "<PATH>", "<UUID>"]
ANY = "<*>"
SEP = "\u0001"
WORD = re.compile(r"\S+", re.ASCII)  # the words of Java's \\S+

LEAF_ROWS = 2000  # larger leaves are worked off in rounds
LEAF_CHARS = 8_000_000
BUCKET_CHARS = 8_000_000  # characters of small leaves that share a task
ROUND_ROWS = 256

CLUSTERS = "source string, key binary, leader_key binary, leader string, n long, n_variants long, template string"


def masked_texts(df, content="content", source="source", masked=True):
    """Distinct masked lines per source with counts and tokens; blank lines are left out."""
    text = F.trim(F.col(content))
    rows = df.select(F.col(source).alias("source"), (mask_variables(text) if masked else text).alias("masked"))
    counts = rows.filter(F.col("masked") != "").groupBy("source", "masked").agg(F.count("*").alias("n"))
    return counts.withColumn("tokens", F.regexp_extract_all("masked", F.lit(r"\S+"), 0))


def _settings(column, sim, depth):
    """(sim, depth) columns: explicit values win, else those of the source type."""
    kind = F.lower(F.regexp_replace(F.col(column), "_2k$", ""))

    def pick(i, given):
        if given is not None:
            return F.lit(given)
        out = F.lit(TREE_SETTINGS["default"][i])
        for name, values in TREE_SETTINGS.items():
            if name != "default":
                out = F.when(kind == name, F.lit(values[i])).otherwise(out)
        return out

    return pick(0, sim), pick(1, depth)


def leaf_keys(texts, sim=None, depth=None, max_children=None):
    """Add sim and the leaf key: token count and leading tokens.

    With ``max_children`` the rarer children of a tree node are merged.
    Nodes are counted on the distinct prefixes; the texts are only read to make those.
    """
    s, d = _settings("source", sim, depth)
    levels = (max(v[1] for v in TREE_SETTINGS.values()) if depth is None else depth) - 2
    names = [f"_t{i}" for i in range(levels)]
    work = texts.withColumns({"sim": s, "_depth": d, "_len": F.size("tokens")})
    for i, name in enumerate(names):
        token = F.get("tokens", F.lit(i))
        inside = (F.col("_depth") - 2 > i) & token.isNotNull()
        work = work.withColumn(name, F.when(inside, F.when(token.rlike(r"<|\d"), ANY).otherwise(token)).otherwise(""))
    work = work.drop("_depth")
    keys = ["source", "_len", *names]
    if max_children is None:  # nothing to count: the leaf follows from the text
        return work.withColumn("leaf", F.concat_ws(SEP, *keys)).drop("_len", *names)
    work = settle(work)
    nodes = settle(work.groupBy(*keys).agg(F.sum("n").alias("_n")))
    nodes = nodes.withColumn("leaf", F.concat_ws(SEP, "source", "_len"))
    for name in names:
        sizes = nodes.groupBy("leaf", name).agg(F.sum("_n").alias("_size"))
        kept = top_of_group(sizes, "leaf", [F.col("_size").desc(), F.col(name)], max_children).select(
            "leaf", name, F.lit(True).alias("_kept")
        )
        nodes = settle(attach(nodes, kept, ["leaf", name]).withColumn(
            "leaf", F.concat_ws(SEP, "leaf", F.when(F.col("_kept"), F.col(name)).otherwise(ANY))
        ).drop("_kept"))
    return attach(work, nodes.drop("_n"), keys).drop("_len", *names)


def digest(text):
    """16 bytes that stand for a text in joins."""
    return F.unhex(F.md5(text))


def _lead(tokens, sim):
    """Index of the leader of every text, texts being in priority order."""
    codes = {}
    m = np.array([codes.setdefault(t, len(codes)) for row in tokens for t in row], dtype=np.int32).reshape(len(tokens), -1)
    leader = np.full(len(m), -1)
    for i in range(len(m)):
        if leader[i] < 0:
            close = ((m[i:] == m[i]).mean(1) >= sim) & (leader[i:] < 0)
            leader[i:][close] = i
            leader[i] = i
    return leader


def _cluster_small(leaves, templates=False):
    """All texts of a leaf at once. Leaves are limited by rows and characters, and share a task by hash.

    (source, masked, leader) of every text. With ``templates`` texts go by their digests, (source, key,
    leader_key), and the row of a leader also has its text, n, n_variants and, where it differs from the
    text, the template; so the texts move once.
    """
    chars = leaves.agg(F.sum(F.length("masked")).alias("c")).first()["c"] or 0
    buckets = max(slice_count(leaves), chars // BUCKET_CHARS)

    def run(pdf):
        pdf = pdf.sort_values(["leaf", "n", "masked"], ascending=[True, False, True], kind="stable")
        leaf, sim, masked = pdf["leaf"].to_numpy(), pdf["sim"].to_numpy(), pdf["masked"].to_numpy()
        tokens = [WORD.findall(t) for t in masked]
        lead = np.arange(len(pdf))
        starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            if b - a > 1:  # a leaf with one text is its own leader
                lead[a:b] = a + _lead(tokens[a:b], sim[a])
        if not templates:
            return pd.DataFrame({"source": pdf["source"].to_numpy(), "masked": masked, "leader": masked[lead]})
        own = lead == np.arange(len(pdf))
        n, key = np.zeros(len(pdf), dtype=np.int64), pdf["key"].to_numpy()
        np.add.at(n, lead, pdf["n"].to_numpy())
        for i in np.flatnonzero(~own):
            into = tokens[lead[i]]
            into[:] = [x if x == y else ANY for x, y in zip(into, tokens[i])]
        made = [" ".join(t) if mine else None for t, mine in zip(tokens, own)]
        return pd.DataFrame({
            "source": pdf["source"].to_numpy(), "key": key, "leader_key": key[lead], "leader": np.where(own, masked, None),
            "n": n, "n_variants": np.bincount(lead, minlength=len(pdf)),
            "template": [None if t == text else t for t, text in zip(made, masked)],
        })

    columns = ["source", "masked", "n", "sim", "leaf", *([digest("masked").alias("key")] if templates else [])]
    packed = leaves.select(*columns, F.pmod(F.xxhash64("leaf"), F.lit(buckets)).alias("_bucket"))
    return packed.groupBy("_bucket").applyInPandas(run, CLUSTERS if templates else "source string, masked string, leader string")


def _cluster_rounds(open_texts, batch=ROUND_ROWS):
    """The same rule for leaves of any size.

    A round finds the leaders among the first texts of every leaf and hands all open
    texts to the first leader that fits; the rest wait for the next round.
    """
    order = [F.col("n").desc(), F.col("masked")]
    done = None

    def leaders_of(pdf):
        pdf = pdf.sort_values("rank")
        lead = _lead([np.asarray(t, dtype=object).astype(str) for t in pdf["tokens"]], pdf["sim"].iloc[0])
        first = pdf[lead == np.arange(len(lead))]
        return first[["leaf", "rank", "masked", "tokens"]]

    while True:
        head = top_of_group(open_texts, "leaf", order, batch)
        leaders = head.groupBy("leaf").applyInPandas(
            leaders_of, "leaf string, rank int, masked string, tokens array<string>"
        )
        lists = settle(leaders.groupBy("leaf").agg(
            F.array_sort(F.collect_list(F.struct("rank", F.col("masked").alias("text"), "tokens"))).alias("leaders")
        ))
        tried = attach(open_texts, lists, ["leaf"])
        tried = settle(tried.withColumn(
            "leader", F.get(F.filter("leaders", lambda l: share_of_tokens(l["tokens"]) >= F.col("sim")), F.lit(0))["text"]
        ).drop("leaders"))
        got = tried.filter("leader IS NOT NULL").select("source", "masked", "leader")
        done = got if done is None else done.unionByName(got)
        open_texts = tried.filter("leader IS NULL").drop("leader")
        if open_texts.isEmpty():
            return done


def _merge(texts, links):
    """Template text per leader: positions where its members differ become <*>.

    Clusters go by the digest of their leader, so that no token row carries a text, and
    only clusters with several texts are taken apart.
    """
    named = links.withColumn("cluster", F.md5("leader"))
    members = attach(texts.select("source", "masked", "n", "tokens"), named, ["source", "masked"], "inner")
    sizes = settle(members.groupBy("source", "cluster").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_variants"), F.min("leader").alias("leader")
    ))
    several = sizes.filter("n_variants > 1").select("source", "cluster")
    cells = attach(members.select("source", "cluster", "tokens"), several, ["source", "cluster"], "left_semi").select(
        "source", "cluster", F.posexplode("tokens").alias("pos", "token")
    )
    merged = cells.groupBy("source", "cluster", "pos").agg(F.min("token").alias("lo"), F.max("token").alias("hi"))
    word = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(ANY)
    mixed = merged.groupBy("source", "cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))), lambda s: s["w"]), " ").alias("mixed")
    )
    own = F.array_join(F.regexp_extract_all("leader", F.lit(r"\S+"), 0), " ")
    out = attach(sizes, mixed, ["source", "cluster"])
    return out.select("source", "leader", "n", "n_variants", F.coalesce("mixed", own).alias("template"))


def _by_size(texts, leaf_rows):
    """(texts of leaves that a task can hold, texts of larger leaves or None)."""
    sizes = texts.groupBy("leaf").agg(F.count("*").alias("_rows"), F.sum(F.length("masked")).alias("_chars"))
    # few: a larger leaf has over leaf_rows texts or LEAF_CHARS characters
    big = settle(sizes.filter((F.col("_rows") > leaf_rows) | (F.col("_chars") > LEAF_CHARS)).select("leaf"))
    if big.isEmpty():
        return texts, None
    return texts.join(big, "leaf", "left_anti"), texts.join(big, "leaf", "left_semi")


def link_texts(texts, leaf_rows=LEAF_ROWS):
    """(source, masked, leader) of distinct texts that have their ``leaf`` and ``sim``."""
    small, big = _by_size(texts, leaf_rows)
    links = _cluster_small(small)
    return links if big is None else links.unionByName(_cluster_rounds(settle(_with_tokens(big))))


def _with_tokens(texts):
    return texts.withColumn("tokens", F.regexp_extract_all("masked", F.lit(r"\S+"), 0))


def cluster_texts(texts, leaf_rows=LEAF_ROWS):
    """One row of CLUSTERS per text; leader, n, n_variants and template are those of leaders only."""
    small, big = _by_size(texts, leaf_rows)
    out = _cluster_small(small, templates=True)
    if big is None:
        return out
    big = settle(_with_tokens(big))
    links = settle(_cluster_rounds(big))
    heads = _merge(big, links).select(
        "source", digest("leader").alias("key"), digest("leader").alias("leader_key"), "leader", "n", "n_variants",
        F.when(F.col("template") != F.col("leader"), F.col("template")).alias("template"))
    led = links.filter("masked != leader").select("source", digest("masked").alias("key"), digest("leader").alias("leader_key"))
    return out.unionByName(heads).unionByName(led, allowMissingColumns=True)


def share_of_tokens(other):
    """Share of the positions at which ``tokens`` and another token array of that length agree."""
    return F.size(F.filter(F.zip_with("tokens", other, lambda a, b: a == b), lambda x: x)) / F.size("tokens")


def mine_templates(df, content="content", source="source", sim=None, depth=None, leaf_rows=LEAF_ROWS):
    """(rows, templates): rows get template_id and template, -1 for blank lines.

    template_id counts from 0 in each source, most frequent first.
    """
    texts = settle(leaf_keys(masked_texts(df, content, source), sim, depth).drop("tokens"), packed=True)
    clusters = settle(cluster_texts(texts, leaf_rows), packed=True)
    heads = clusters.filter("leader IS NOT NULL").drop("leader_key")
    ranked = with_sequence(heads, ["source"], [F.col("n").desc(), F.col("leader")], name="template_id", packed=True)
    templates = ranked.withColumn("template", F.coalesce("template", "leader"))
    # a leader's text has its ids already, and the other texts of a cluster go by the digest of their leader
    ids = ["source", "key", "template_id", "template"]
    shared = templates.filter("n_variants > 1").select("source", F.col("key").alias("leader_key"), "template_id", "template")
    led = attach(clusters.filter("leader IS NULL").select("source", "key", "leader_key"), shared, ["source", "leader_key"])
    ids = templates.select(*ids).unionByName(led.select(*ids)).withColumnsRenamed({"source": source, "key": "_key"})
    rows = attach(df.withColumn("_key", digest(mask_variables(F.trim(F.col(content))))), ids, [source, "_key"]).drop("_key")
    rows = rows.withColumn("template_id", F.coalesce("template_id", F.lit(-1).cast("long")))
    return rows, templates.select("source", "n", "n_variants", "template", "template_id")


def template_stats(df, template="template", source="source", label="label"):
    """Count, labels and class shares per template. Fit on training rows only."""
    hit = lambda k: F.sum(F.when(F.col(label) == k, 1).otherwise(0))
    out = df.groupBy(source, template).agg(F.count("*").alias("n"), hit(0).alias("n_normal"), hit(1).alias("n_anomaly"))
    return out.withColumns({
        "normal_score": F.col("n_normal") / (F.col("n") + F.lit(1e-6)),
        "anomaly_score": F.col("n_anomaly") / (F.col("n") + F.lit(1e-6)),
    })


def count_tokens(col, tokens):
    """Occurrences of fixed tokens in a text."""
    c = F.col(col) if isinstance(col, str) else col
    return sum(
        (F.regexp_count(c, F.lit(t)) for t in tokens[1:]), F.regexp_count(c, F.lit(tokens[0]))
    )


LABEL_FREE = ["rarity", "length", "n_wildcards", "frequency", "complexity_score"]
LABEL_BASED = ["normal_score", "anomaly_score", "uniqueness_score", "class_prob_0", "class_prob_1"]


def add_template_features(df, stats, template="template", source="source", with_labels=False):
    """Template figures of every row; zeros for rows without template.

    ``stats`` come from template_stats on the training rows. Figures that read labels
    are added only on request.
    """
    totals = stats.groupBy(source).agg(F.sum("n").alias("_total"))
    share = F.col("n") / F.col("_total")
    rarity = 1.0 / (share + F.lit(1e-6))
    length = F.regexp_count(template, F.lit(r"\S+"))
    wild = count_tokens(template, WILDCARDS)
    made = {
        "rarity": rarity, "length": length, "n_wildcards": wild, "frequency": share,
        "complexity_score": length * wild / (share + F.lit(1e-6)),
    }
    if with_labels:
        made |= {
            "normal_score": F.col("normal_score"), "anomaly_score": F.col("anomaly_score"),
            "uniqueness_score": rarity * (1 - F.greatest("normal_score", "anomaly_score")),
            "class_prob_0": F.col("normal_score"), "class_prob_1": F.col("anomaly_score"),
        }
    figures = settle(attach(stats, totals, [source]).select(source, template, *[c.alias(n) for n, c in made.items()]))
    return attach(df, figures, [source, template]).na.fill(0, list(made))


def global_template_ids(df, cap=None, source="source", template="template"):
    """One dense id per (source, template) over all sources; those past a stated cap share the last id."""
    pairs = df.select(source, template).distinct()
    ranked = with_sequence(pairs, [], [source, template], name="global_id")
    ids = settle(ranked if cap is None else ranked.withColumn("global_id", F.least("global_id", F.lit(cap - 1))))
    return attach(df, ids, [source, template])


def running_template_frequency(df, template="template", order=("ts", "log_id")):
    """Share of the row's template among all rows up to it, in time order."""
    own = with_sequence(df, [template], list(order), name="_own")
    both = with_sequence(own, [], list(order), name="_all")
    return both.withColumns({
        "template_count": F.col("_own") + 1,
        "running_frequency": (F.col("_own") + 1) / (F.col("_all") + 1 + F.lit(1e-6)),
    }).drop("_own", "_all")
