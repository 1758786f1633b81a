"""Linear and autoregressive fits from sums of products, and overlaps of clusters from their covariances.

Normal equations are one aggregation; the small systems are solved in column
arithmetic, one elimination step after another.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.operators.series import ordered
from epochal.sources.shared import stored


def solved(df: DataFrame, size: int, matrix: str = "a", right: str = "b", output: str = "x") -> DataFrame:
    """Adds ``x0 ...``: the solution of a symmetric positive system in columns ``a<i>_<j>`` (i <= j) and ``b<i>``; null where a pivot is nought."""
    out = df
    known = {(i, j): F.col(f"{matrix}{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size)} | {(i, size): F.col(f"{right}{i}") for i in range(size)}
    scale = {i: known[i, i] for i in range(size)}
    out = out.withColumns({f"__d{i}": scale[i] for i in range(size)} | {f"__e{i}_{j}": v for (i, j), v in known.items()})
    for p in range(size):
        # a pivot that has lost twelve digits is none
        pivot = F.when(F.col(f"__e{p}_{p}") > 1e-12 * F.col(f"__d{p}"), F.col(f"__e{p}_{p}"))
        out = out.withColumns({f"__e{i}_{j}": F.col(f"__e{i}_{j}") - F.col(f"__e{i}_{p}") / pivot * F.col(f"__e{p}_{j}") for i in range(p + 1, size) for j in range(p, size + 1)} | {f"__e{p}_{p}": pivot})
    for i in reversed(range(size)):
        rest = F.col(f"__e{i}_{size}")
        for j in range(i + 1, size):
            rest = rest - F.col(f"__e{i}_{j}") * F.col(f"{output}{j}")
        out = out.withColumn(f"{output}{i}", rest / F.col(f"__e{i}_{i}"))
    return out.drop(*(f"__d{i}" for i in range(size)), *(f"__e{i}_{j}" for i in range(size) for j in range(size + 1)))


def linear_fit(df: DataFrame, y: str, xs: list[str], keys: tuple[str, ...] = ("object",)) -> DataFrame:
    """``keys``, ``n``, ``intercept``, ``b_<x>``, ``sigma`` and ``r2`` of least squares over the rows where all are known.

    Products are taken about the means (of a first aggregation, joined back), so
    that large values lose no digits; groups whose columns depend on each other
    have null coefficients.  ``sigma`` is the root of the mean squared residual.
    """
    own = df
    for c in (y, *xs):
        own = own.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    mean = own.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(*(F.avg(c).alias(f"__m{i}") for i, c in enumerate((*xs, y))))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = own.join(mean, same).select(*keys, *(f"__m{i}" for i in range(len(xs) + 1)), *((F.col(c) - F.col(f"__m{i}")).alias(f"__c{i}") for i, c in enumerate((*xs, y))))
    n = len(xs)
    sums = [F.sum(F.col(f"__c{i}") * F.col(f"__c{j}")).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(F.col(f"__c{i}") * F.col(f"__c{n}")).alias(f"b{i}") for i in range(n)]
    fit = solved(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(f"__c{n}") * F.col(f"__c{n}")).alias("yy"), *sums, *(F.first(f"__m{i}").alias(f"m{i}") for i in range(n + 1))), n)
    explained, intercept = F.lit(0.0), F.col(f"m{n}")
    for i in range(n):
        explained, intercept = explained + F.col(f"x{i}") * F.col(f"b{i}"), intercept - F.col(f"x{i}") * F.col(f"m{i}")
    return fit.select(*keys, "n", intercept.alias("intercept"), *(F.col(f"x{i}").alias(f"b_{c}") for i, c in enumerate(xs)), F.sqrt(F.greatest(F.lit(0.0), F.col("yy") - explained) / F.col("n")).alias("sigma"), F.try_divide(explained, F.col("yy")).alias("r2"))


def predicted(df: DataFrame, fit: DataFrame, xs: list[str], output: str = "predicted", key: str = "object") -> DataFrame:
    """``df`` with the fitted value of each row (null where there is no fit)."""
    own = fit.select(F.col(key).alias("__k"), F.col("intercept").alias("__i"), *(F.col(f"b_{c}").alias(f"__b{i}") for i, c in enumerate(xs)))
    value = F.col("__i")
    for i, c in enumerate(xs):
        value = value + F.col(f"__b{i}") * F.col(c)
    return df.join(own, F.col(key).eqNullSafe(F.col("__k")), "left").select(*df.columns, value.alias(output))


def ar_fit(df: DataFrame, order: int = 1, value: str = "value") -> DataFrame:
    """``object``, ``n``, ``a0 ...`` (of the last row first), ``sigma`` of what is left and ``last`` (the last values, oldest first) of autoregressions without a constant.

    Rows follow each other as (``t``, ``rec``); rows without a value are left
    out.  Objects need more than twice ``order`` values; where the lags depend
    on each other there are no coefficients.
    """
    own = df.where("object IS NOT NULL").where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    w = ordered()
    rows = own.select("object", F.col(value).cast("double").alias("y"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("object")).alias("n"), *(F.lag(value, j + 1).over(w).cast("double").alias(f"z{j}") for j in range(order)))
    rows = rows.where(F.col("n") > 2 * order)
    fitted = F.col("i") > order
    product = lambda a, b: F.sum(F.when(fitted, F.col(a) * F.col(b)))
    sums = [product(f"z{i}", f"z{j}").alias(f"a{i}_{j}") for i in range(order) for j in range(i, order)] + [product(f"z{i}", "y").alias(f"b{i}") for i in range(order)]
    last = F.array_sort(F.collect_list(F.when(F.col("i") > F.col("n") - order, F.struct("i", "y"))))
    fit = solved(rows.groupBy("object", "n").agg(product("y", "y").alias("yy"), last.alias("tail"), *sums), order)
    explained = F.lit(0.0)
    for i in range(order):
        explained = explained + F.col(f"x{i}") * F.col(f"b{i}")
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("yy") - explained) / (F.col("n") - order))
    return fit.select("object", "n", *(F.col(f"x{i}").alias(f"a{i}") for i in range(order)), sigma.alias("sigma"), F.transform("tail", lambda r: r["y"]).alias("last"))


def ar_forecast(fit: DataFrame, order: int, steps: int) -> DataFrame:
    """``object``, ``step`` (from 1) and ``expected``: the autoregression run on without noise; objects without coefficients have null."""
    made = lambda out: sum((F.col(f"a{j}") * F.get(out, F.size(out) - 1 - j) for j in range(order)), F.lit(0.0))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("last"), lambda out, _: F.array_append(out, made(out)))
    return fit.select("object", F.posexplode(F.slice(run, F.lit(order + 1), F.lit(steps))).alias("__s", "expected")).select("object", (F.col("__s") + 1).alias("step"), "expected")


# -- clusters in (sma, node, phase) ---------------------------------------------------
#: Variances of a cluster of one member (km squared, radians squared), and what is added to a pair's sum so that it can be inverted.
SINGLE = (25.0, 0.0025, 0.0025)
RIDGE = (1.0, 1e-4, 1e-4)


def envelopes(df: DataFrame, group: str, checkpoint: str, member: str, sma: str, node: str, phase: str) -> DataFrame:
    """Of each group and checkpoint ``members``, means ``m0 m1 m2`` and covariances ``c00 c01 c02 c11 c12 c22``; angles (radians) are taken as seen from the first member.

    A lone member has the variances ``SINGLE``.  Rows without a group,
    checkpoint or any coordinate are left out.
    """
    own = df.dropna(subset=[group, checkpoint, sma, node, phase])
    first = own.groupBy(F.col(group).alias("__g"), F.col(checkpoint).alias("__c")).agg(F.min_by(F.struct(F.col(node).alias("n"), F.col(phase).alias("p")), member).alias("__f"))
    rows = own.join(first, (F.col(group) == F.col("__g")) & (F.col(checkpoint) == F.col("__c")))
    near = lambda c, f: F.atan2(F.sin(F.col(c) - F.col(f)), F.cos(F.col(c) - F.col(f))) + F.col(f)
    rows = rows.select(group, checkpoint, F.col(sma).cast("double").alias("__0"), near(node, "__f.n").alias("__1"), near(phase, "__f.p").alias("__2"))
    pair = [(i, j) for i in range(3) for j in range(i, 3)]
    out = rows.groupBy(group, checkpoint).agg(F.count("*").alias("members"), *(F.avg(f"__{i}").alias(f"m{i}") for i in range(3)), *(F.covar_samp(f"__{i}", f"__{j}").alias(f"c{i}{j}") for i, j in pair))
    return out.withColumns({f"c{i}{j}": F.when(F.col("members") > 1, F.col(f"c{i}{j}")).otherwise(SINGLE[i] if i == j else 0.0) for i, j in pair})


def mahalanobis(difference: list, covariance: dict):
    """Squared distance of three coordinates by the inverse of a symmetric 3 x 3 matrix (columns by (i, j), i <= j)."""
    a, b, c, d, e, f = (covariance[k] for k in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))
    x, y, z = difference
    inverse = [d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b]
    whole = a * inverse[0] + b * inverse[1] + c * inverse[2]
    form = inverse[0] * x * x + inverse[3] * y * y + inverse[5] * z * z + 2 * (inverse[1] * x * y + inverse[2] * x * z + inverse[4] * y * z)
    return form / whole


def cluster_overlap(found: DataFrame, group: str, checkpoint: str, most: float = 0.01, eps: float = 1.0) -> DataFrame:
    """``a``, ``b``, ``checkpoints``, ``penalty`` and ``closest`` of the pairs of groups that overlap: mean over the checkpoints of the squared excess of exp(-d2 / 2) over ``most``.

    Checkpoints are taken in order, up to the last of the group with fewer.
    Two groups can only pass ``most`` at a checkpoint if their semi-major axes
    are within a reach that follows from their variances, so groups meet by
    cells as wide as the largest reach of the checkpoint, not all with all;
    pairs that never pass it have penalty 0 and are not listed.
    """
    own = found.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(checkpoint)))
    own = own.withColumn("total", F.count("*").over(Window.partitionBy(group)))
    # d2 is at least the squared distance of one coordinate over its variance
    far = math.sqrt(-2 * math.log(most))
    reach = far * F.sqrt(2 * F.col("c00") + eps * RIDGE[0])
    width = own.groupBy(F.col("k").alias("__k")).agg(F.max(reach).alias("__w"))
    own = own.join(width, F.col("k") == F.col("__k")).withColumn("cell", F.floor(F.col("m0") / F.col("__w"))).drop("__k", "__w")
    names = ["total", *(f"m{i}" for i in range(3)), *(f"c{i}{j}" for i in range(3) for j in range(i, 3))]
    left = own.select(F.col(group).alias("a"), "k", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), *(F.col(n).alias(f"a_{n}") for n in names))
    right = own.select(F.col(group).alias("b"), "k", "cell", *(F.col(n).alias(f"b_{n}") for n in names))
    pairs = left.join(right, ["k", "cell"]).where("a < b")
    raw = [F.col(f"a_m{i}") - F.col(f"b_m{i}") for i in range(3)]
    difference = [raw[0], *(F.atan2(F.sin(x), F.cos(x)) for x in raw[1:])]
    covariance = {(i, j): F.col(f"a_c{i}{j}") + F.col(f"b_c{i}{j}") + (eps * RIDGE[i] if i == j else 0.0) for i in range(3) for j in range(i, 3)}
    risk = pairs.select("a", "b", F.least("a_total", "b_total").alias("checkpoints"), F.exp(-0.5 * mahalanobis(difference, covariance)).alias("risk")).where(F.col("risk") > most)
    excess = (F.col("risk") - most) * (F.col("risk") - most)
    return risk.groupBy("a", "b").agg(F.first("checkpoints").alias("checkpoints"), (F.sum(excess) / F.first("checkpoints")).alias("penalty"), F.max("risk").alias("closest"))


def arc_errors(df: DataFrame, arc: str, observed: str, predicted: str, order: list[str], turning: dict[str, tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row an arc: ``n_obs``, ``path_rmse`` over its observations, and of each angle of ``turning`` (name: observed, predicted; degrees) the last row's absolute difference on the circle.

    Rows whose observed or predicted value is null or NaN don't count; an arc
    without any has no row.  Of ``keep`` columns the first row's value stays.
    """
    error = F.col(predicted) - F.col(observed)
    rows = df.where(error.isNotNull() & ~F.isnan(error.cast("double"))).withColumn("__e", error.cast("double"))
    place = F.struct(*order)
    gap = {n: F.abs(F.pmod(F.col(b) - F.col(a) + 180.0, F.lit(360.0)) - 180.0) for n, (a, b) in turning.items()}
    # a struct, so that an unknown angle of the last row is not passed over
    last = [F.max_by(F.struct(g.alias("g")), place)["g"].alias(f"{n}_error") for n, g in gap.items()]
    return rows.groupBy(arc).agg(*(F.min_by(c, place).alias(c) for c in keep), F.count("*").alias("n_obs"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("path_rmse"), *last)


#: Accuracy of the cuts around a quantile, their distance from it as a share of the rows (four times the cuts' error), and rows of a phase up to which none are made.
ACCURACY, AROUND, UNCUT = 1000, 0.004, 10_000


def error_report(arcs: DataFrame, phase: str, turning: list[str]) -> DataFrame:
    """Of each phase and of all arcs (a null phase with ``whole``): ``n_arcs``, mean, median and 90 % quantile of ``path_rmse``, and the mean absolute error of each angle.

    Quantiles are exact.  Approximate cuts on both sides of each are taken with
    the means; errors below the cuts are counted, and only the different ones
    between them (0.8 % of a large phase's rows) are put in order in one task.
    Phases are few: a row for each is broadcast.
    """
    shares = {"rmse_median": 0.5, "rmse_p90": 0.9}
    errors = [f"{n}_error" for n in turning]
    # an error's last digits may differ from run to run, so arcs are taken once
    own = stored(arcs.select(phase, "path_rmse", *errors))
    ends = F.percentile_approx("path_rmse", F.array(*(F.lit(q + d) for q in shares.values() for d in (-AROUND, AROUND))), F.lit(ACCURACY))
    stats = [F.count("*").alias("n_arcs"), F.avg("path_rmse").alias("rmse_mean"), *(F.avg(e).alias(f"{n}_mae") for n, e in zip(turning, errors)), F.count("path_rmse").alias("__n"), ends.alias("__ends")]
    stats = stored(own.rollup(phase).agg((F.grouping(phase) == 1).alias("whole"), *stats))
    cuts = stats.select(F.col(phase).alias("__p"), F.col("whole").alias("__w"), "__n", "__ends")
    each = own.where("path_rmse IS NOT NULL").select(F.explode(F.array(F.struct(F.col(phase).alias("p"), F.lit(False).alias("w")), F.struct(F.lit(None).cast(own.schema[phase].dataType).alias("p"), F.lit(True).alias("w")))).alias("g"), F.col("path_rmse").alias("x"))
    each = each.join(F.broadcast(cuts), F.col("g.p").eqNullSafe(F.col("__p")) & (F.col("g.w") == F.col("__w")))
    low, high = ([(F.col("__n") > UNCUT) & (test(F.col("x"), F.col("__ends")[2 * k + s])) for k in range(len(shares))] for s, test in ((0, lambda x, c: x < c), (1, lambda x, c: x > c)))
    below = each.groupBy("__p", "__w").agg(F.array(*(F.count_if(a) for a in low)).alias("__below"))
    inside = F.array_compact(F.array(*(F.when(~a & ~b, F.lit(k)) for k, (a, b) in enumerate(zip(low, high)))))
    values = each.select("__p", "__w", "__n", "x", F.explode(inside).alias("k")).groupBy("__p", "__w", "k", "x").agg(F.first("__n").alias("n"), F.count("*").alias("own"))
    values = values.withColumnsRenamed({"__p": "p", "__w": "w"}).join(F.broadcast(below), F.col("p").eqNullSafe(F.col("__p")) & (F.col("w") == F.col("__w")))
    upto = F.get("__below", F.col("k")) + F.sum("own").over(Window.partitionBy("p", "w", "k").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    place = (F.col("n") - 1) * F.get(F.array(*map(F.lit, shares.values())), F.col("k"))
    ranked = values.select("p", "w", "k", "x", "own", upto.alias("upto"), place.alias("place"))
    at = lambda rank: F.min(F.when((F.col("upto") - F.col("own") <= rank) & (rank < F.col("upto")), F.col("x")))
    found = ranked.groupBy("p", "w", "k").agg(F.first("place").alias("place"), at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"))
    missed = F.col("a").isNull() | F.col("b").isNull()
    between = (F.ceil("place") - F.col("place")) * F.col("a") + (F.col("place") - F.floor("place")) * F.col("b")
    value = F.when(missed, F.raise_error(F.lit("a quantile is outside its cuts"))).when(F.col("a") == F.col("b"), F.col("a")).otherwise(between)
    quantiles = found.groupBy("p", "w").agg(*(F.max(F.when(F.col("k") == k, value)).alias(name) for k, name in enumerate(shares)))
    out = stats.join(F.broadcast(quantiles), F.col(phase).eqNullSafe(F.col("p")) & (F.col("whole") == F.col("w")), "left")
    return out.select(phase, "whole", "n_arcs", "rmse_mean", *shares, *(f"{n}_mae" for n in turning))
