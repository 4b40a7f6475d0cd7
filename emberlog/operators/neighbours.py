"""Exact k-nearest-neighbour join on vectors.

Base rows are assigned to the cell of their nearest pivot. The distances of base rows
to their pivots bound a query's k-th neighbour from above, and the cell radii bound
every cell from below, so a query only travels to cells that can hold a neighbour.
Small cells are bundled, large ones cut into parts, and queries into lots of limited size: no task holds a large cell.
What travels grows with the number of lots and parts, so a task gets a tile of neighbouring bundles, as large as its memory
allows, and compares a query only with the bundles that it needs.

A base of more than ``TOP_PIVOTS`` cells gets a second level: every cell has pivots of its
own, up to ``SUB_PIVOTS``, and cells within the cell. Both levels are written tables with
sizes, radii and least distances; lots of queries meet them by key, first the cells, then
the cells within those they need. Of the base, the driver sees ``TOP_PIVOTS`` pivots, however
many rows there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.operators.draws import draw
from emberlog.operators.ordering import attach

CELL = 1024  # base rows a cell holds on average
TOP_PIVOTS = 256  # cells of the first level, all that the driver gathers of a base
SUB_PIVOTS = 4096  # cells within one cell; above, they hold more rows
DRIVER_NUMBERS = 1_000_000  # figures of cells by group that a one-level search may keep on the driver
ROUTE_NUMBERS = 4_000_000  # distances that a task holds at once while it routes queries
BLOCK = 4096  # rows of one side that a task sees at a time
TILE_BYTES = 24 << 20  # vectors of one side that a task holds
LEAST_LOTS = 6  # as many tiles and lots at least, where there are rows for them, keep the cores busy
COMPARED = 4_000_000  # distances that a task holds at once while it compares
EPS = 1e-9


def _matrix(series):
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 0))


def pairwise(a, b):
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _assign(base, pivots):
    """Add the cell (nearest pivot) and the distance to it."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                d = pairwise(_matrix(pdf["b_vec"]), pivots)
                pdf["cell"] = d.argmin(1).astype("int32")
                pdf["far"] = d.min(1)
                yield pdf

    grp, b_vec = (base.schema[c].dataType.simpleString() for c in ("grp", "b_vec"))
    schema = f"grp {grp}, b_id long, b_vec {b_vec}, cell int, far double"
    return base.mapInPandas(run, schema)


def _figures(cells, keys, k):
    """Of every cell and group: rows ``n``, ``radius`` and the ``first`` k+1 distances to the pivot."""
    order = Window.partitionBy(*keys, "_part").orderBy("far")
    near = (
        cells.select(*keys, "far", F.pmod("b_id", F.lit(64)).alias("_part"))
        .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1)
    )
    first = near.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("far")), 1, k + 1).alias("first"))
    whole = cells.groupBy(*keys).agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    return attach(whole, first, keys, "inner")


def _reaching(m, pivots, radius, first, seen):
    """(query, cell, upper bound of the query's last neighbour, lower bound of the cell) of all pairs that may matter.

    ``first`` has one row of least distances per cell, filled with infinity. Queries are taken
    in slices, so that no more than ROUTE_NUMBERS distances are held.
    """
    step = max(1, ROUTE_NUMBERS // max(1, first.size))
    for at in range(0, len(m), step):
        d = pairwise(m[at : at + step], pivots)
        sums = (d[:, :, None] + first[None]).reshape(len(d), -1)
        reach = np.partition(sums, seen - 1, axis=1)[:, seen - 1] if sums.shape[1] >= seen else np.full(len(d), np.inf)
        low = d - radius[None, :]
        go, cell = np.nonzero(low <= reach[:, None] + EPS)
        yield go + at, cell, reach[go], low[go, cell]


def _table(first, k):
    """Lists of least distances as rows of k+1 numbers."""
    out = np.full((len(first), k + 1), np.inf)
    for row, x in zip(out, first):
        row[: len(x)] = x
    return out


def _sub_cells(cells):
    """(sub pivots: cell, sub, p_vec; base rows with ``sub`` and the distance to its pivot).

    Pivots of a cell are the rows of least digest, about one in CELL, one at least.
    """
    sizes = settle(cells.groupBy("cell").agg(F.count("*").alias("_n"), F.min(draw("b_id", seed=13)).alias("_least")))
    wanted = F.least(F.lit(SUB_PIVOTS), F.ceil(F.col("_n") / CELL)) / F.col("_n")
    picked = cells.withColumn("_draw", draw("b_id", seed=13)).join(sizes, "cell").filter(
        F.col("_draw") <= F.greatest(F.col("_least").cast("double"), wanted * F.lit(float(1 << 52))))
    order = Window.partitionBy("cell").orderBy("_draw", "b_id")
    pivots = settle(picked.select("cell", (F.row_number().over(order) - 1).cast("int").alias("sub"), F.col("b_vec").alias("p_vec")))
    lots = sizes.select("cell", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / (4 * BLOCK)).cast("int"))).alias("lot"))
    rows = cells.drop("far").join(sizes.select("cell", "_n"), "cell").withColumn(
        "lot", F.pmod(draw("b_id", seed=17), F.floor(F.col("_n") / (4 * BLOCK)).cast("int") + 1).cast("int")).drop("_n")

    def place(left, right):
        if not len(left):
            return pd.DataFrame({c: [] for c in ("grp", "b_id", "b_vec", "cell", "far", "sub")})
        m, p = _matrix(left["b_vec"]), _matrix(right["p_vec"])
        nearest, far = [], []
        for at in range(0, len(m), max(1, ROUTE_NUMBERS // len(p))):
            d = pairwise(m[at : at + max(1, ROUTE_NUMBERS // len(p))], p)
            nearest.append(d.argmin(1))
            far.append(d.min(1))
        return left[["grp", "b_id", "b_vec", "cell"]].assign(far=np.concatenate(far), sub=right["sub"].to_numpy()[np.concatenate(nearest)])

    g_type, v_type = (cells.schema[c].dataType.simpleString() for c in ("grp", "b_vec"))
    placed = rows.groupBy("cell", "lot").cogroup(pivots.join(lots, "cell").groupBy("cell", "lot")).applyInPandas(
        place, f"grp {g_type}, b_id long, b_vec {v_type}, cell int, far double, sub int")
    return pivots, settle(placed)


def _descend(q, cells, pivots, k, seen, n_lots):
    """Routes over two levels: (routes, base rows), both with one number per cell of the second level."""
    g_type = cells.schema["grp"].dataType.simpleString()
    lot = lambda df: df.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(n_lots - 1))))
    # columns of their own for a frame that is cogrouped with what it came from
    anew = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names])
    upper = settle(_figures(cells, ["grp", "cell"], k))
    subs, placed = _sub_cells(cells)
    lower = settle(_figures(placed, ["grp", "cell", "sub"], k).join(subs, ["cell", "sub"]))
    asked = q.withColumn("lot", F.pmod("q_id", F.lit(n_lots)).cast("int")).join(lot(anew(upper, "grp").distinct()), "lot")

    def to_cells(left, right):
        names = ["grp", "cell", "lot", "q_id", "reach"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        at = right["cell"].to_numpy()
        out = [pd.DataFrame({
            "grp": right["grp"].iloc[0], "cell": at[cell], "lot": left["lot"].to_numpy()[go], "q_id": left["q_id"].to_numpy()[go], "reach": reach,
        }) for go, cell, reach, _ in _reaching(_matrix(left["q_vec"]), pivots[at], right["radius"].to_numpy(), _table(right["first"], k), seen)]
        return pd.concat(out)[names]

    first = settle(asked.groupBy("grp", "lot").cogroup(lot(upper).groupBy("grp", "lot")).applyInPandas(
        to_cells, f"grp {g_type}, cell int, lot int, q_id long, reach double"))
    keys = ["grp", "cell", "lot"]
    near = attach(lower, anew(first, *keys).distinct(), ["grp", "cell"], "inner")
    reached = first.join(q.hint("merge"), "q_id")

    def to_sub_cells(left, right):
        names = ["grp", "cell", "parts", "lot", "q_id", "reach", "low"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        sub, parts, own = right["sub"].to_numpy(), -(-right["n"].to_numpy() // BLOCK), left["reach"].to_numpy()
        out = []
        for go, cell, reach, low in _reaching(
                _matrix(left["q_vec"]), _matrix(right["p_vec"]), right["radius"].to_numpy(), _table(right["first"], k), seen):
            best = np.minimum(reach, own[go])
            keep = low <= best + EPS
            out.append(pd.DataFrame({
                "grp": right["grp"].iloc[0], "cell": int(right["cell"].iloc[0]) * (1 << 20) + sub[cell[keep]], "parts": parts[cell[keep]],
                "lot": left["lot"].to_numpy()[go[keep]], "q_id": left["q_id"].to_numpy()[go[keep]], "reach": best[keep], "low": low[keep]}))
        return pd.concat(out)[names]

    second = reached.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(
        to_sub_cells, f"grp {g_type}, cell long, parts int, lot int, q_id long, reach double, low double")
    # what one cell has shown of a query's reach holds for all
    least = F.min("reach").over(Window.partitionBy("grp", "q_id"))
    routes = second.withColumn("reach", least).filter(F.col("low") <= F.col("reach") + EPS).drop("reach", "low")
    return routes, placed.withColumn("cell", F.col("cell") * F.lit(1 << 20).cast("long") + F.col("sub")).drop("sub")


def _bundles(cells, block, tile=None):
    """(grp, cell, bundle, tile, parts): cells of a group in a row, up to about three quarters of a block; bundles in a row
    make a tile of up to about three quarters of ``tile`` rows, and a larger tile goes in parts."""
    tile = max(block, (tile or block) // block * block)
    fill = max(1, block * 3 // 4)
    sizes = cells.groupBy("grp", F.col("cell").cast("long").alias("cell")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("grp").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    marked = sizes.withColumn("bundle", F.floor((upto - 1) / fill)).withColumn("tile", F.floor(F.col("bundle") / (tile // block)))
    whole = F.sum("n").over(Window.partitionBy("grp", "tile"))
    return marked.withColumn("parts", F.ceil(whole / tile).cast("int")).drop("n")


def _held(rows, width, block):
    """Rows of a lot or a tile: enough lots for the cores, but no more than TILE_BYTES of vectors."""
    return max(1, min(max(block, -(-rows // LEAST_LOTS)), max(block, TILE_BYTES // (8 * max(width, 1)))))


def knn_join(queries, base, k, vec="vec", key="log_id", group=None, normalize=False, n_pivots=None, block=BLOCK,
             exclude_self=True, levels=None):
    """k nearest base rows of every query: q_id, b_id, dist, rank (and ``group``).

    ``group`` asks for k neighbours in every group of the base. Distance ties go to the
    smaller id. Rows with the query's own id are left out unless told otherwise. ``levels``
    fixes one or two levels of cells; the size of the base decides otherwise.
    """
    # whole numbers and decimals become doubles; floats travel as they are and are compared as doubles
    plain = lambda df: df.schema[vec].dataType.simpleString() in ("array<float>", "array<double>")
    values = lambda df: F.col(vec) if plain(df) and not normalize else F.transform(F.col(vec), lambda x: x.cast("double"))
    if normalize:
        length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        unit = lambda df: df.withColumn("_v", values(df)).withColumn("_l", length(F.col("_v"))).withColumn(
            "_v", F.transform("_v", lambda x: F.try_divide(x, F.col("_l"))))
    else:
        unit = lambda df: df.withColumn("_v", values(df))
    grp = F.col(group) if group else F.lit(0)
    b = unit(base).select(grp.alias("grp"), F.col(key).cast("long").alias("b_id"), F.col("_v").alias("b_vec"))
    q = unit(queries).select(F.col(key).cast("long").alias("q_id"), F.col("_v").alias("q_vec"))

    size = b.count()
    n_pivots = n_pivots or max(1, min(TOP_PIVOTS, size // CELL))
    sample = b.select("b_id", "b_vec").orderBy(draw("b_id", seed=7), "b_id").limit(n_pivots).collect()
    if not sample:
        return _empty(queries.sparkSession, b, group)
    pivots = np.array([r["b_vec"] for r in sample], dtype=np.float64)
    cells = settle(_assign(b, pivots))
    asking, width = queries.count(), pivots.shape[1]
    n_lots = max(1, -(-asking // _held(asking, width, BLOCK)))
    seen = k + 1 if exclude_self else k
    g_type = b.schema["grp"].dataType.simpleString()
    if levels is None:
        groups = cells.select("grp").distinct().count() if group else 1
        levels = 2 if size > TOP_PIVOTS * CELL or groups * n_pivots * (k + 3) > DRIVER_NUMBERS else 1
    if levels == 2:
        routes, cells = _descend(q, cells, pivots, k, seen, n_lots)
    else:
        table = {}
        for r in _figures(cells, ["grp", "cell"], k).collect():  # at most DRIVER_NUMBERS figures
            table.setdefault(r["grp"], []).append((r["cell"], r["n"], r["radius"], list(r["first"])))

        def route(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                m = _matrix(pdf["q_vec"])
                ids = pdf["q_id"].to_numpy()
                for g, rows in table.items():
                    index, sizes, radius, first = (np.array(x) if i < 3 else _table(x, k) for i, x in enumerate(zip(*rows)))
                    for go, at, *_ in _reaching(m, pivots[index], radius, first, seen):
                        if len(go):
                            yield pd.DataFrame({
                                "grp": [g] * len(go), "cell": index[at].astype("int64"), "parts": (-(-sizes // block)).astype("int32")[at],
                                "lot": (ids % n_lots).astype("int32")[go], "q_id": ids[go]})

        routes = q.mapInPandas(route, f"grp {g_type}, cell long, parts int, lot int, q_id long")
    # a query's vector travels once to a tile of neighbouring cells, with the bundles it needs there, not once to each
    bundles = settle(_bundles(cells, block, _held(size, width, block)))
    routes = attach(routes.drop("parts"), bundles, ["grp", "cell"], "inner").groupBy("grp", F.col("tile").alias("cell"), "parts", "lot", "q_id").agg(
        F.collect_set("bundle").alias("bundles"))
    cells = attach(cells.select("grp", "cell", "b_id", "b_vec"), bundles, ["grp", "cell"], "inner").drop("cell").withColumnRenamed("tile", "cell")
    # which query goes to which tile, without vectors; a tile then goes only to the lots that need it
    # ids repeat, so a few bytes of a file hold many rows: by their file Spark would broadcast them through the driver
    routes = settle(routes)
    # an id that comes several times asks as often for each of its rows
    asked = q.withColumn("_copies", F.count("*").over(Window.partitionBy("q_id"))).hint("merge")
    routed = routes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").join(asked, "q_id")
    routed = routed.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies")
    wanted = routes.select(*[F.col(c).alias(f"_{c}") for c in ("grp", "cell", "parts", "lot")]).distinct()
    blocks = cells.join(wanted, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("cell") == F.col("_cell"))).select(
        "grp", F.col("cell").cast("long").alias("cell"), F.pmod(draw("b_id", seed=11), F.col("_parts")).cast("int").alias("part"),
        F.col("_lot").alias("lot"), "bundle", "b_id", "b_vec")

    def nearest(left, right):
        cols = ["grp", "q_id", "b_id", "dist"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in cols})
        asks, ids = left["q_id"].to_numpy(), right["b_id"].to_numpy()
        a, c = _matrix(left["q_vec"]), _matrix(right["b_vec"])
        # of every bundle its rows, and the queries that need it
        rows_of = right.groupby("bundle").indices
        needs = pd.Series(np.repeat(np.arange(len(left)), left["bundles"].map(len)), dtype="int64")
        asked_by = needs.groupby(np.concatenate(left["bundles"].to_numpy())).apply(np.asarray).to_dict()
        best = None
        for bundle, rows in rows_of.items():
            wanting = asked_by.get(bundle)
            for at in range(0, len(rows) if wanting is not None else 0, block):
                some = rows[at : at + block]
                step = max(1, COMPARED // len(some))
                found = [_closest(asks[w], a[w], ids[some], c[some], k, exclude_self) for w in (wanting[i : i + step] for i in range(0, len(wanting), step))]
                best = _first(pd.concat(found if best is None else [best, *found]), k)
        if best is None:
            return pd.DataFrame({c: [] for c in cols})
        return best.assign(grp=left["grp"].iloc[0])[cols]

    names = ["grp", "cell", "part", "lot"]
    found = (
        routed.groupBy(*names).cogroup(blocks.groupBy(*names))
        .applyInPandas(nearest, f"grp {g_type}, q_id long, b_id long, dist double")
    )
    ranked = Window.partitionBy("grp", "q_id").orderBy("dist", "b_id")
    out = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return out.withColumnRenamed("grp", group) if group else out.drop("grp")


def _closest(asks, a, ids, c, k, exclude_self):
    """(q_id, b_id, dist) of at least the k nearest rows ``c`` of every query ``a``."""
    d = pairwise(a, c)
    if exclude_self:
        d[asks[:, None] == ids[None, :]] = np.inf
    take = min(k, d.shape[1])
    kth = np.partition(d, take - 1, axis=1)[:, take - 1]
    rows, hits = np.nonzero((d <= kth[:, None] * (1 + EPS) + EPS) & np.isfinite(d))
    exact = np.sqrt(((a[rows] - c[hits]) ** 2).sum(1))
    return pd.DataFrame({"q_id": asks[rows], "b_id": ids[hits], "dist": exact})


def _first(found, k):
    return found.sort_values(["q_id", "dist", "b_id"]).groupby("q_id").head(k)


def _empty(spark, b, group):
    schema = "q_id long, b_id long, dist double, rank int"
    if group:
        schema = f"{group} {b.schema['grp'].dataType.simpleString()}, " + schema
    return spark.createDataFrame([], schema)


def knn_classify(train, test, k=5, weights="uniform", vec="vec", key="log_id", label="label", exclude_self=True):
    """Vote of the k nearest training rows; ties go to the lowest class."""
    pairs = knn_join(test, train, k, vec, key, exclude_self=exclude_self)
    marks = train.select(F.col(key).cast("long").alias("b_id"), F.col(label).alias("_label"))
    vote = F.lit(1.0) if weights == "uniform" else F.try_divide(F.lit(1.0), F.greatest("dist", F.lit(1e-12)))
    votes = pairs.join(marks, "b_id").groupBy("q_id", "_label").agg(F.sum(vote).alias("w"))
    totals = votes.groupBy("q_id").agg(
        F.max(F.struct("w", (-F.col("_label")).alias("low"))).alias("b"), F.sum("w").alias("all")
    )
    return totals.select(F.col("q_id").alias(key), (-F.col("b.low")).alias("prediction"), (F.col("b.w") / F.col("all")).alias("share"))
