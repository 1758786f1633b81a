"""Convergence of draws (``object``, ``chain``, ``draw``, ``x``): rank-normalised R-hat, bulk and tail effective sizes, error of the mean.

Chains are split in halves (the middle draw of an odd one is left out); chains
of an object are cut to its shortest.  Everything is sums: ranks are a window of
an object's draws, and autocovariances are products of draws some steps apart,
taken for a block of steps at a time until every object's sum has ended.
"""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from epochal.sources.shared import checkpointed

#: Steps of autocovariance that one round takes.
BLOCK = 64


def _quantile_function():
    def normal(p: pd.Series) -> pd.Series:
        own = NormalDist()
        return p.map(lambda x: own.inv_cdf(x) if 0 < x < 1 else None)

    return F.pandas_udf(normal, DoubleType())


normal_quantile = _quantile_function()


def split_chains(draws: DataFrame) -> DataFrame:
    """``object``, ``chain`` (halves numbered apart), ``i`` (from 0), ``x``; draws without a value, and objects of fewer than four draws a chain, are left out."""
    own = draws.where("object IS NOT NULL AND chain IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    w = Window.partitionBy("object", "chain").orderBy("draw", "x")
    rows = own.select("object", "chain", "x", (F.row_number().over(w) - 1).alias("i"))
    size = rows.groupBy("object", "chain").agg(F.count("*").alias("n")).groupBy(F.col("object").alias("__o")).agg(F.min("n").alias("n")).where("n >= 4")
    rows = rows.join(size, F.col("object") == F.col("__o")).drop("__o").where("i < n")
    half = F.floor(F.col("n") / 2)
    second = F.col("i") >= F.col("n") - half
    return rows.where((F.col("i") < half) | second).select("object", (F.col("chain") * 2 + second.cast("int")).alias("chain"), F.when(second, F.col("i") - F.col("n") + half).otherwise(F.col("i")).alias("i"), "x")


def rank_normal(rows: DataFrame, value: str, output: str, keys: tuple[str, ...] = ("object",)) -> DataFrame:
    """Adds normal scores of the ranks of all draws of an object, (rank - 3/8) / (n + 1/4); equal draws have their mean rank."""
    w = Window.partitionBy(*keys).orderBy(value)
    same = Window.partitionBy(*keys, value)
    rank = F.rank().over(w) + (F.count("*").over(same) - 1) / 2
    share = (rank - 0.375) / (F.count("*").over(Window.partitionBy(*keys)) + 0.25)
    return rows.withColumn("__p", share).withColumn(output, normal_quantile("__p")).drop("__p")


def _factor(rows: DataFrame, value: str, output: str) -> DataFrame:
    chains = rows.groupBy("object", "chain").agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    n, within = F.max("n"), F.avg("v")
    return chains.groupBy("object").agg(F.sqrt(F.try_divide(n * F.var_samp("m"), within) / n + (n - 1) / n).alias(output))


def rank_rhat(draws: DataFrame) -> DataFrame:
    """``object``, ``rhat``: the larger of the factors of normal scores and of normal scores of the distance from the median; null without spread."""
    rows = split_chains(draws)
    mid = rows.groupBy(F.col("object").alias("__o")).agg(F.percentile("x", F.lit(0.5)).alias("__m"))
    rows = rows.join(mid, F.col("object") == F.col("__o")).withColumn("folded", F.abs(F.col("x") - F.col("__m"))).drop("__o", "__m")
    bulk, tail = _factor(rank_normal(rows, "x", "z"), "z", "a"), _factor(rank_normal(rows, "folded", "z"), "z", "b")
    return bulk.join(tail, "object").select("object", F.greatest("a", "b").alias("rhat"))


def effective_size(series: DataFrame) -> DataFrame:
    """``object``, ``kind``, ``ess`` of chains ``(object, kind, chain, i, y)`` of equal lengths.

    Autocorrelations are summed in pairs of steps up to the first pair that is
    not positive (its first member counts once if it is), each pair at most as
    large as those before.  Chains without any spread count in full.
    """
    keys = ["object", "kind"]
    w = Window.partitionBy(*keys, "chain").orderBy("i")
    rows = series.withColumn("__m", F.avg("y").over(Window.partitionBy(*keys, "chain"))).withColumn("d", F.col("y") - F.col("__m"))
    chains = rows.groupBy(*keys, "chain").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.avg(F.col("d") * F.col("d")).alias("c0"))
    whole = chains.groupBy(*keys).agg(F.count("*").alias("chains"), F.max("n").alias("n"), F.avg("c0").alias("c0"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("between"))
    n = F.col("n")
    whole = whole.withColumn("mean_var", F.col("c0") * n / (n - 1)).withColumn("var_plus", F.col("c0") + F.when(F.col("chains") > 1, F.col("between")).otherwise(0.0))
    total = F.col("chains") * n
    done = whole.where("NOT var_plus > 1e-300").select(*keys, total.cast("double").alias("ess"))
    left, pairs, first = whole.where("var_plus > 1e-300"), None, 0
    while True:
        # products of rows 2k and 2k + 1 steps apart; the pair of k = 0 is 1 and the first step
        steps = range(first, first + BLOCK)
        later = F.array(*(F.struct(F.lit(s).alias("s"), F.lead("d", s).over(w).alias("e")) for s in steps))
        some = rows.join(left.select(*(F.col(k).alias(f"__{k}") for k in keys)), (F.col("object") == F.col("__object")) & (F.col("kind") == F.col("__kind")), "left_semi")
        each = some.withColumn("__later", later).select(*keys, "chain", "d", F.explode("__later").alias("l")).where("l.e IS NOT NULL")
        # a chain's autocovariance is the sum over its length; the mean over chains of equal length is the sum over all of it
        sums = each.groupBy(*keys, F.col("l.s").alias("s")).agg(F.sum(F.col("d") * F.col("l.e")).alias("sum"))
        cov = sums.join(left, keys).select(*keys, "n", "chains", "s", (1 - (F.col("mean_var") - F.col("sum") / (F.col("n") * F.col("chains"))) / F.col("var_plus")).alias("rho"))
        cov = cov.withColumn("rho", F.when(F.col("s") == 0, 1.0).otherwise(F.col("rho")))
        found = cov.groupBy(*keys, "n", "chains", F.floor(F.col("s") / 2).alias("k")).agg(F.sum("rho").alias("pair"), F.min_by("rho", "s").alias("even")).where((F.col("k") == 0) | (2 * F.col("k") - 1 < F.col("n") - 3))
        found = checkpointed(found)
        pairs = found if pairs is None else pairs.unionByName(found)
        ended = Window.partitionBy(*keys)
        last = F.greatest(F.lit(0), F.ceil((F.col("n") - 2) / 2) - 1)
        state = pairs.withColumn("end", F.coalesce(F.min(F.when(F.col("pair") <= 0, F.col("k"))).over(ended), F.when(F.max("k").over(ended) >= last, F.max("k").over(ended))))
        open_ = state.where("end IS NULL").select(*keys).distinct()
        if open_.isEmpty():
            break
        left = left.join(open_, keys, "left_semi")
        first += BLOCK
    run = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    least = state.withColumn("low", F.min("pair").over(run))
    tau = -1 + 2 * F.sum(F.when(F.col("k") < F.col("end"), F.col("low")).otherwise(0.0)) + F.sum(F.when(F.col("k") == F.col("end"), F.greatest(F.lit(0.0), F.col("even"))).otherwise(0.0))
    out = least.groupBy(*keys).agg(tau.alias("tau"), (F.max("n") * F.max("chains")).alias("total"))
    out = out.select(*keys, (F.col("total") / F.greatest("tau", 1 / F.log10("total"))).alias("ess"))
    return out.unionByName(done)


def summary(draws: DataFrame) -> DataFrame:
    """``object``, ``n``, ``mean``, ``sd``, ``rhat``, ``ess_bulk``, ``ess_tail``, ``ess_mean`` and ``mcse_mean`` of every object with at least four draws a chain.

    Bulk is the size of the normal scores, tail the smaller one of the
    indicators of the lower and upper twentieth.
    """
    rows = checkpointed(rank_normal(split_chains(draws), "x", "z"))
    cut = rows.groupBy(F.col("object").alias("__o")).agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    kinds = F.array(
        F.struct(F.lit("bulk").alias("kind"), F.col("z").alias("y")), F.struct(F.lit("mean").alias("kind"), F.col("x").alias("y")),
        *(F.struct(F.lit(k).alias("kind"), (F.col("x") <= F.get("q", F.lit(i))).cast("double").alias("y")) for i, k in enumerate(("low", "high"))),
    )
    each = rows.join(cut, F.col("object") == F.col("__o")).select("object", "chain", "i", F.explode(kinds).alias("s")).select("object", "chain", "i", "s.*")
    sizes = effective_size(each).groupBy(F.col("object").alias("__o")).agg(*(F.max(F.when(F.col("kind") == k, F.col("ess"))).alias(f"__{k}") for k in ("bulk", "mean", "low", "high")))
    own = rows.groupBy("object").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    out = own.join(sizes, F.col("object") == F.col("__o")).join(rank_rhat(draws), "object")
    return out.select(
        "object", "n", "mean", "sd", "rhat", F.col("__bulk").alias("ess_bulk"), F.least("__low", "__high").alias("ess_tail"), F.col("__mean").alias("ess_mean"), (F.col("sd") / F.sqrt("__mean")).alias("mcse_mean")
    )
