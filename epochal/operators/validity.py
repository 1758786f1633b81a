"""Density-based validity of clusters (``label``, ``id``, ``v``), over all rows.

Core distances and edges of mutual reachability come from pairs of blocks: a
task holds two blocks, never a cluster, and no pair of rows becomes a row.
Trees grow in Boruvka rounds (the least edge that leaves each component, then
components merged), at most as many as the logarithm of a cluster's rows.
The work is quadratic in a cluster's rows, and once in all inner rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.sources.shared import stored

BLOCK_ROWS = 2048


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By products; where these cancel, by differences, so that copies have distance zero."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    size = aa[:, None] + bb
    square = size - 2 * (a @ b.T)
    i, j = np.nonzero(square < 1e-6 * size)
    for k in range(0, len(i), 1 << 16):
        at = slice(k, k + (1 << 16))
        square[i[at], j[at]] = ((a[i[at]] - b[j[at]]) ** 2).sum(1)
    return np.sqrt(np.maximum(square, 0, out=square))


def _pairs(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on each two blocks (``b``) of a group ``g``: rows of the one and of the other, the same for a block with itself."""
    counts = rows.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    own = rows.join(counts, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"p": F.least("b", "other"), "o": F.greatest("b", "other")}).drop("other", "blocks")

    def two(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        p, o = part["p"].iloc[0], part["o"].iloc[0]
        return run(part[part["b"] == p], part[part["b"] == o], p == o)

    return dealt.groupBy("g", "p", "o").applyInPandas(two, schema)


def core_distances(rows: DataFrame, dimensions: int) -> DataFrame:
    """``id`` and ``core``: the mean of the inverse distances to a cluster's other rows to the power of the dimensions, inverted.

    Powers are added up as logarithms; zero distances count nothing.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": np.zeros(0, "int64"), "top": np.zeros(0), "sum": np.zeros(0)})
        d = _distances(np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()))
        if same:
            np.fill_diagonal(d, 0)
        with np.errstate(divide="ignore"):
            power = np.where(d > 0, -dimensions * np.log(d), -np.inf)
        out = []
        for own, logs in ((a, power),) if same else ((a, power), (b, power.T)):
            top = logs.max(1)
            fine = np.isfinite(top)
            out.append(pd.DataFrame({"id": own["id"].to_numpy()[fine], "top": top[fine], "sum": np.exp(logs[fine] - top[fine, None]).sum(1)}))
        return pd.concat(out)

    parts = _pairs(rows.select("g", "id", "v"), run, "id long, top double, sum double")
    both = parts.withColumn("most", F.max("top").over(Window.partitionBy("id"))).groupBy("id").agg(F.max("most").alias("most"), F.sum(F.col("sum") * F.exp(F.col("top") - F.col("most"))).alias("sum"))
    n = rows.groupBy("g").agg(F.count("*").alias("n"))
    log = F.col("most") + F.log("sum") - F.log(F.col("n") - 1)
    core = F.when(F.col("sum").isNull(), 0.0).otherwise(F.exp(-log / dimensions))
    return rows.select("g", "id").join(n, "g").join(both, "id", "left").select("id", core.alias("core"))


def least_edges(rows: DataFrame) -> DataFrame:
    """Of each component ``c`` of a group: its least edge of mutual reachability to another one (``w``, ``low``, ``high``, ``to``); ties by ids."""

    def run(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        names = ["g", "c", "w", "low", "high", "to"]
        out = []
        if len(a) and len(b):
            d = _distances(np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()))
            np.maximum(d, a["core"].to_numpy()[:, None], out=d)
            np.maximum(d, b["core"].to_numpy(), out=d)
            if same:
                d = np.maximum(d, d.T)
            d[a["c"].to_numpy()[:, None] == b["c"].to_numpy()] = np.inf
            for x, y, m in ((a, b, d),) if same else ((a, b, d), (b, a, d.T)):
                at = m.argmin(1)  # rows are in the order of ids: the smallest of equal ones
                i, j = x["id"].to_numpy(), y["id"].to_numpy()[at]
                best = pd.DataFrame({"g": x["g"].to_numpy(), "c": x["c"].to_numpy(), "w": m[np.arange(len(i)), at], "low": np.minimum(i, j), "high": np.maximum(i, j), "to": y["c"].to_numpy()[at]})
                out.append(best[np.isfinite(best["w"])].sort_values(["c", "w", "low", "high"]).drop_duplicates("c"))
        return pd.concat(out) if out else pd.DataFrame(columns=names).astype({n: float if n == "w" else "int64" for n in names})

    edges = _pairs(rows.select("g", "id", "v", "core", "c"), run, "g long, c long, w double, low long, high long, to long")
    return edges.groupBy("g", "c").agg(F.min(F.struct("w", "low", "high", "to")).alias("e")).select("g", "c", "e.*")


def tree(rows: DataFrame) -> DataFrame:
    """Edges (``g``, ``w``, ``low``, ``high``) of each group's minimum spanning tree of mutual reachability."""
    members = rows.select("g", "id", F.col("id").alias("c"))
    edges = None
    while True:
        chosen = stored(least_edges(rows.join(members, ["g", "id"])))
        if chosen.isEmpty():
            return edges if edges is not None else chosen.select("g", "w", "low", "high")
        found = chosen.select("g", "w", "low", "high").distinct()
        edges = found if edges is None else edges.unionByName(found)
        # the smaller of two that chose each other is the root; the others follow their choices up to it
        back = chosen.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = chosen.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up"))
        while True:
            next_up = up.select(F.col("c").alias("up"), F.col("up").alias("top"))
            now = stored(up.join(next_up, "up").select("c", F.col("top").alias("next"), (F.col("top") != F.col("up")).alias("moved")))
            up = now.select("c", F.col("next").alias("up"))
            if now.where("moved").isEmpty():
                break
        members = stored(members.join(up, "c", "left").select("g", "id", F.coalesce("up", "c").alias("c")))


def density_validity(df: DataFrame, dimensions: int) -> DataFrame:
    """Of each cluster (``label`` from 0): rows, sparseness, separation, validity; and the total weighted by size, the same on every row.

    Sparseness is the longest edge between inner nodes (of more than one edge)
    of the tree, or of any if there is none; separation the least mutual
    reachability of inner nodes of two clusters.  Noise (labels below 0) counts
    in the weights alone.
    """
    clusters = df.where("label >= 0").select(F.col("label").cast("long").alias("g"), "id", "v")
    rows = stored(clusters.join(core_distances(clusters, dimensions), "id"))
    edges = stored(tree(rows))
    ends = edges.select("g", F.explode(F.array("low", "high")).alias("id")).groupBy("g", "id").count().where("count > 1").select("g", "id")
    one = rows.groupBy("g").agg(F.min("id").alias("id")).join(ends.select("g").distinct(), "g", "left_anti")
    inner = stored(ends.unionByName(one.select("g", "id")))
    inside = edges.join(inner.select("g", F.col("id").alias("low"), F.lit(1).alias("i")), ["g", "low"], "left").join(inner.select("g", F.col("id").alias("high"), F.lit(1).alias("j")), ["g", "high"], "left")
    sparse = inside.groupBy("g").agg(F.coalesce(F.max(F.when(F.col("i") + F.col("j") == 2, F.col("w"))), F.max("w")).alias("sparseness"))
    apart = least_edges(rows.join(inner, ["g", "id"]).withColumn("c", F.col("g")).withColumn("g", F.lit(0).cast("long"))).select(F.col("c").alias("g"), F.col("w").alias("separation"))
    out = rows.groupBy("g").agg(F.count("*").alias("n")).join(sparse, "g", "left").join(apart, "g", "left").withColumn("sparseness", F.coalesce("sparseness", F.lit(0.0)))
    validity = F.coalesce(F.try_divide(F.col("separation") - F.col("sparseness"), F.greatest("separation", "sparseness")), F.lit(0.0))
    out = out.withColumn("validity", F.when(F.col("separation").isNull(), 0.0).otherwise(validity))
    whole = out.agg(F.sum(F.col("n") * F.col("validity")).alias("s")).join(df.agg(F.count("*").alias("all"))).select((F.col("s") / F.col("all")).alias("total"))
    return out.join(F.broadcast(whole)).select(F.col("g").cast("int").alias("label"), "n", "sparseness", "separation", "validity", "total")
