"""Queries over fits, diagnostics of draws, common epochs and overlaps of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import asof, diagnostics, models
from epochal.plans.windows import P
from epochal.registry import query
from epochal.sources.tables import event_panel, micros, table


@query(
    "linear_fit",
    """WITH m AS (SELECT l_suppkey AS object, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, var_pop(l_discount) AS d,
  covar_pop(l_extendedprice, l_quantity) AS p, covar_pop(l_extendedprice, l_discount) AS q, var_pop(l_extendedprice) AS yy FROM lineitem GROUP BY 1),
s AS (SELECT *, (p * d - q * b) / (a * d - b * b) AS x1, (a * q - b * p) / (a * d - b * b) AS x2 FROM m)
SELECT object, n, round(my - x1 * m1 - x2 * m2, 3) AS intercept, round(x1, 4) AS b_l_quantity, round(x2, 2) AS b_l_discount, round(sqrt(greatest(0, yy - x1 * p - x2 * q)), 3) AS sigma FROM s""",
)
def linear_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "object")
    fit = models.linear_fit(rows, "l_extendedprice", ["l_quantity", "l_discount"])
    return fit.select("object", "n", F.round("intercept", 3).alias("intercept"), F.round("b_l_quantity", 4).alias("b_l_quantity"), F.round("b_l_discount", 2).alias("b_l_discount"), F.round("sigma", 3).alias("sigma"))


#: Residuals of each object's values about their mean.
AR = f"""{P}, c AS (SELECT object, t, rec, value - avg(value) OVER (PARTITION BY object) AS y FROM p),
l AS (SELECT object, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY object) AS n, lag(y) OVER w AS z0, lag(y, 2) OVER w AS z1 FROM c WINDOW w AS (PARTITION BY object ORDER BY t, rec)),
s AS (SELECT object, n, sum(z0 * z0) AS a, sum(z0 * z1) AS b, sum(z1 * z1) AS d, sum(z0 * y) AS p, sum(z1 * y) AS q, sum(y * y) AS yy FROM l WHERE i > 2 AND n > 4 GROUP BY 1, 2),
f AS (SELECT object, n, (p * d - q * b) / (a * d - b * b) AS a0, (a * q - b * p) / (a * d - b * b) AS a1, yy, p, q FROM s)"""


def centred(spark, sf_dir):
    panel = event_panel(spark, sf_dir)
    mean = panel.groupBy(F.col("object").alias("__o")).agg(F.avg("value").alias("__m"))
    return panel.join(mean, F.col("object") == F.col("__o")).withColumn("y", F.col("value") - F.col("__m")).drop("__o", "__m")


@query("ar_residuals", f"WITH {AR} SELECT object, n, round(a0, 6) AS a0, round(a1, 6) AS a1, round(sqrt(greatest(0, yy - a0 * p - a1 * q) / (n - 2)), 5) AS sigma FROM f")
def ar_residuals(spark, sf_dir):
    fit = models.ar_fit(centred(spark, sf_dir), 2, "y")
    return fit.select("object", "n", F.round("a0", 6).alias("a0"), F.round("a1", 6).alias("a1"), F.round("sigma", 5).alias("sigma"))


@query(
    "ar_forecast",
    f"""WITH RECURSIVE {AR}, e AS (SELECT l.object, a0, a1, y AS now, z0 AS before FROM l JOIN f USING (object) WHERE i = l.n),
r AS (SELECT object, 1 AS step, a0 * now + a1 * before AS expected, now, a0, a1 FROM e UNION ALL SELECT object, step + 1, a0 * expected + a1 * now, expected, a0, a1 FROM r WHERE step < 5)
SELECT object, step, round(expected, 5) + 0.0 AS expected FROM r""",
)
def ar_forecast(spark, sf_dir):
    out = models.ar_forecast(models.ar_fit(centred(spark, sf_dir), 2, "y"), 2, 5)
    return out.withColumn("expected", F.round("expected", 5) + 0.0)


#: Clusters of shipments by flags, checkpoints by year, in quantity and two angles.
CLUSTERS = """r AS (SELECT l_returnflag || l_linestatus AS g, year(l_shipdate) AS c, l_orderkey * 10 + l_linenumber AS m, l_quantity * 1.0::DOUBLE AS a, radians(l_extendedprice / 300) AS o, radians(l_discount * 3600) AS l FROM lineitem),
f AS (SELECT g, c, arg_min(o, m) AS o0, arg_min(l, m) AS l0 FROM r GROUP BY ALL),
n AS (SELECT r.g, r.c, a, atan2(sin(o - o0), cos(o - o0)) + o0 AS o, atan2(sin(l - l0), cos(l - l0)) + l0 AS l FROM r JOIN f ON f.g = r.g AND f.c = r.c),
e AS (SELECT g, c, count(*) AS members, avg(a) AS m0, avg(o) AS m1, avg(l) AS m2, CASE WHEN count(*) > 1 THEN var_samp(a) ELSE 25 END AS c00, CASE WHEN count(*) > 1 THEN covar_samp(a, o) ELSE 0 END AS c01,
  CASE WHEN count(*) > 1 THEN covar_samp(a, l) ELSE 0 END AS c02, CASE WHEN count(*) > 1 THEN var_samp(o) ELSE 0.0025 END AS c11, CASE WHEN count(*) > 1 THEN covar_samp(o, l) ELSE 0 END AS c12, CASE WHEN count(*) > 1 THEN var_samp(l) ELSE 0.0025 END AS c22 FROM n GROUP BY ALL)"""


def envelopes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("g"), F.year("l_shipdate").alias("c"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("m"), F.col("l_quantity").cast("double").alias("a"),
        F.radians(F.col("l_extendedprice") / 300).alias("o"), F.radians(F.col("l_discount") * 3600).alias("l"),
    )
    return models.envelopes(rows, "g", "c", "m", "a", "o", "l")


@query("cluster_envelopes", f"WITH {CLUSTERS} SELECT g, c, members, round(m0, 6) AS m0, round(m1, 6) + 0.0 AS m1, round(m2, 6) + 0.0 AS m2, round(c00, 5) AS c00, round(c01, 5) + 0.0 AS c01, round(c02, 5) + 0.0 AS c02, round(c11, 5) AS c11, round(c12, 5) + 0.0 AS c12, round(c22, 5) AS c22 FROM e")
def cluster_envelopes(spark, sf_dir):
    rounded = lambda c, d: (F.round(c, d) + 0.0).alias(c)
    return envelopes(spark, sf_dir).select("g", "c", "members", *(rounded(f"m{i}", 6) for i in range(3)), *(rounded(c, 5) for c in ("c00", "c01", "c02", "c11", "c12", "c22")))


@query(
    "cluster_overlap",
    f"""WITH {CLUSTERS}, k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c) AS k, count(*) OVER (PARTITION BY g) AS total FROM e),
p AS (SELECT a.g AS a, b.g AS b, least(a.total, b.total) AS checkpoints, a.m0 - b.m0 AS x, atan2(sin(a.m1 - b.m1), cos(a.m1 - b.m1)) AS y, atan2(sin(a.m2 - b.m2), cos(a.m2 - b.m2)) AS z,
  a.c00 + b.c00 + 1 AS s0, a.c01 + b.c01 AS s1, a.c02 + b.c02 AS s2, a.c11 + b.c11 + 1e-4 AS s3, a.c12 + b.c12 AS s4, a.c22 + b.c22 + 1e-4 AS s5 FROM k a JOIN k b ON a.k = b.k AND a.g < b.g),
q AS (SELECT *, s3 * s5 - s4 * s4 AS i0, s2 * s4 - s1 * s5 AS i1, s1 * s4 - s2 * s3 AS i2, s0 * s5 - s2 * s2 AS i3, s1 * s2 - s0 * s4 AS i4, s0 * s3 - s1 * s1 AS i5 FROM p),
w AS (SELECT a, b, checkpoints, exp(-0.5 * (i0 * x * x + i3 * y * y + i5 * z * z + 2 * (i1 * x * y + i2 * x * z + i4 * y * z)) / (s0 * i0 + s1 * i1 + s2 * i2)) AS risk FROM q)
SELECT a, b, checkpoints, round(sum(pow(risk - 0.01, 2)) / checkpoints, 6) AS penalty, round(max(risk), 6) AS closest FROM w WHERE risk > 0.01 GROUP BY a, b, checkpoints""",
)
def cluster_overlap(spark, sf_dir):
    out = models.cluster_overlap(envelopes(spark, sf_dir), "g", "c")
    return out.select("a", "b", "checkpoints", F.round("penalty", 6).alias("penalty"), F.round("closest", 6).alias("closest"))


@query("ess_rhat")
def ess_rhat(spark, sf_dir):
    """Draws are an object's values in time, chains their kinds."""
    rows = event_panel(spark, sf_dir)
    chain = F.when(F.col("category").isin("click", "view"), 0).otherwise(1)
    return diagnostics.summary(rows.select("object", chain.alias("chain"), F.col("rec").alias("draw"), F.col("value").alias("x")))


@query(
    "sync_nearest_intersection",
    f"""WITH {P}, c AS (SELECT DISTINCT t AS epoch FROM p WHERE object = 1), g AS (SELECT epoch, object, min(abs(t - epoch)) AS gap FROM c, p WHERE object IS NOT NULL GROUP BY ALL),
s AS (SELECT epoch, max(gap) AS worst, sum(gap) AS total FROM g GROUP BY 1 ORDER BY worst, total, epoch LIMIT 1)
SELECT s.epoch, g.object, (SELECT min(t) FROM p WHERE p.object = g.object AND abs(p.t - s.epoch) = g.gap) AS near_t, s.worst FROM s JOIN g USING (epoch)""",
)
def sync_nearest_intersection(spark, sf_dir):
    """The epoch of object 1 that all objects come nearest to."""
    return asof.nearest_intersection(event_panel(spark, sf_dir), 1).drop("near_rec")


@query(
    "sync_exact_all",
    """WITH n AS (SELECT o_orderdate AS d, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1), f AS (SELECT min(d) AS d FROM n WHERE n = (SELECT count(DISTINCT o_orderpriority) FROM orders))
SELECT o_orderpriority AS object, epoch_us(o_orderdate) AS t, max(o_orderkey) AS rec FROM orders WHERE o_orderdate = (SELECT d FROM f) GROUP BY 1, 2""",
)
def sync_exact_all(spark, sf_dir):
    """The first day on which orders of every priority came, with the last of each."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("object"), micros("o_orderdate").alias("t"), F.col("o_orderkey").alias("rec"))
    return asof.exact_intersection(rows)
