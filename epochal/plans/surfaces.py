"""Queries over wavelet surfaces, seams of tori and grids, segments for fits and errors of arcs."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal import registry
from epochal.operators import density, models, quality, wavelets
from epochal.plans import kernels
from epochal.plans.evidence import elements as placed
from epochal.plans.orbits import CLEAN_SQL, ELEMENTS_SQL, clean, elements
from epochal.registry import query
from epochal.sources.tables import table

#: Common times of stacks, in days.
TIMES = [0.0, 2.0, 4.0, 6.0, 8.0, 10.0, 12.0, 14.0, 16.0, 18.0, 20.0]
STACK = f"""z AS (SELECT object, frequency, tau_days, avg(z) AS z FROM ({registry.SQL["wavelet_z"]}) GROUP BY ALL),
s AS (SELECT *, lead(tau_days) OVER w AS t1, lead(z) OVER w AS z1 FROM z WINDOW w AS (PARTITION BY object, frequency ORDER BY tau_days)),
g AS (SELECT i, 2.0::DOUBLE * i AS t FROM range(11) r(i)),
st AS (SELECT i, t AS tau_days, frequency, avg(CASE WHEN t = tau_days THEN z ELSE z + (z1 - z) * (t - tau_days) / (t1 - tau_days) END) AS power, count(*) AS n_objects FROM s JOIN g ON t = tau_days OR (t > tau_days AND t < t1) GROUP BY ALL)"""


def stack(spark, sf_dir):
    return wavelets.stacked(kernels.wavelet_z(spark, sf_dir), TIMES)


@query(
    "wavelet_stack",
    f"""WITH {STACK}, c AS (SELECT *, dense_rank() OVER (ORDER BY frequency) AS j FROM st), e AS (SELECT min(tau_days) AS a, max(tau_days) AS b FROM st)
SELECT i::INT AS i, tau_days, frequency, round(power, 6) AS power, n_objects, tau_days >= a + 0.5 / frequency AND tau_days <= b - 0.5 / frequency AND b > a AS inside,
  power >= (SELECT max(o.power) FROM c o WHERE abs(o.i - c.i) <= 1 AND abs(o.j - c.j) <= 1) AS peak FROM c, e""",
)
def wavelet_stack(spark, sf_dir):
    """Mean power of all objects at common times, what of it the ends don't touch, and its peaks."""
    out = wavelets.marked(stack(spark, sf_dir))
    return out.select("i", "tau_days", "frequency", F.round("power", 6).alias("power"), "n_objects", "inside", "peak")


@query("wavelet_ridge", f"WITH {STACK} SELECT i::INT AS i, tau_days, frequency, round(power, 6) AS power FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY power DESC, frequency) AS k FROM st) WHERE k = 1")
def wavelet_ridge(spark, sf_dir):
    return wavelets.ridge(stack(spark, sf_dir)).select("i", "tau_days", "frequency", F.round("power", 6).alias("power"))


@query("cross_wavelet")
def cross_wavelet(spark, sf_dir):
    """Cross power, phase and coherence of height and inclination of every object, at six scales."""
    return wavelets.cross_wavelet(placed(spark, sf_dir), "sma", "inc", 4.0, [2.0, 3.0, 4.5, 6.75, 10.0, 15.0])


@query(
    "seam_copies",
    f"""WITH {CLEAN_SQL}, p AS (SELECT rec, raan % 360 AS x, aop % 360 AS y FROM clean), sh AS (SELECT unnest([0.0, 360.0, -360.0])::DOUBLE AS d),
a AS (SELECT rec, x + d AS x, y, d <> 0 AS c FROM p, sh WHERE d = 0 OR (d > 0 AND x <= 10) OR (d < 0 AND x >= 350))
SELECT rec, round(x, 6) AS raan, round(y + d, 6) AS aop, c OR d <> 0 AS copied FROM a, sh WHERE d = 0 OR (d > 0 AND y <= 10) OR (d < 0 AND y >= 350)""",
)
def seam_copies(spark, sf_dir):
    out = density.seam_copies(clean(spark, sf_dir).select("rec", "raan", "aop"), "raan", "aop")
    return out.select("rec", F.round("raan", 6).alias("raan"), F.round("aop", 6).alias("aop"), "copied")


@query(
    "padded_grid",
    f"""WITH {CLEAN_SQL}, h AS (SELECT floor(raan / 30)::INT AS i, floor(inc / 20)::INT AS j, count(*) AS n FROM clean WHERE raan < 360 AND inc < 180 GROUP BY ALL), x AS (SELECT unnest(range(-1, 13))::INT AS i), y AS (SELECT unnest(range(-1, 10))::INT AS j)
SELECT x.i, y.j, n FROM x, y JOIN h ON h.i = (x.i + 12) % 12 AND h.j = greatest(0, least(8, y.j))""",
)
def padded_grid(spark, sf_dir):
    """Counts by node (a circle) and inclination (which has ends), padded by one cell."""
    own = clean(spark, sf_dir).where("raan < 360 AND inc < 180").groupBy(F.floor(F.col("raan") / 30).cast("int").alias("i"), F.floor(F.col("inc") / 20).cast("int").alias("j")).agg(F.count("*").alias("n"))
    return density.padded(own, 12, 9, 1, True, False)


@query(
    "sanitised_segments",
    f"""WITH {ELEMENTS_SQL}, r AS (SELECT rec, sma, ecc, sma + 1 AS a_tau50_km, radians(raan) AS raan_tau50_rad, radians(aop) AS lam_tau50_rad, CASE WHEN inc <= 180 THEN 1 ELSE 0.25 END::DOUBLE AS has_tau50 FROM elements),
m AS (SELECT *, CASE WHEN raan_tau50_rad IS NULL THEN 0 ELSE has_tau50 END AS mask FROM r)
SELECT rec, mask AS has_tau50, CASE WHEN mask > 0.5 THEN a_tau50_km ELSE 0 END AS a_tau50_km, round(CASE WHEN mask > 0.5 THEN raan_tau50_rad ELSE 0 END, 9) AS raan_tau50_rad, round(CASE WHEN mask > 0.5 THEN lam_tau50_rad ELSE 0 END, 9) AS lam_tau50_rad FROM m""",
)
def sanitised_segments(spark, sf_dir):
    rows = elements(spark, sf_dir).select("rec", "sma", "ecc", (F.col("sma") + 1).alias("a_tau50_km"), F.radians("raan").alias("raan_tau50_rad"), F.radians("aop").alias("lam_tau50_rad"), F.when(F.col("inc") <= 180, 1.0).otherwise(0.25).alias("has_tau50"))
    out = quality.sanitised(rows, ["sma", "ecc"], {"has_tau50": ["a_tau50_km", "raan_tau50_rad", "lam_tau50_rad"]})
    return out.select("rec", "has_tau50", "a_tau50_km", F.round("raan_tau50_rad", 9).alias("raan_tau50_rad"), F.round("lam_tau50_rad", 9).alias("lam_tau50_rad"))


@query(
    "arc_error_report",
    """WITH a AS (SELECT l_orderkey AS arc, arg_min(l_returnflag, l_linenumber) AS phase, sqrt(avg(pow(l_quantity * 1500 - l_extendedprice, 2))) AS rmse, arg_max(abs((l_tax - l_discount) * 3600 + 180 - 360 * floor(((l_tax - l_discount) * 3600 + 180) / 360) - 180), l_linenumber) AS node FROM l GROUP BY 1),
r AS (SELECT phase, false AS whole, * EXCLUDE (phase) FROM a UNION ALL SELECT NULL, true, * EXCLUDE (phase) FROM a)
SELECT phase, whole, count(*) AS n_arcs, round(avg(rmse), 4) AS rmse_mean, round(quantile_cont(rmse, 0.5), 4) AS rmse_median, round(quantile_cont(rmse, 0.9), 4) AS rmse_p90, round(avg(node), 6) AS node_mae FROM r GROUP BY ALL""".replace(
        "WITH a", "WITH l AS (SELECT l_orderkey, l_returnflag, l_linenumber, l_quantity, l_extendedprice, l_tax, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, l_discount, l_returnflag) AS k FROM lineitem) WHERE k = 1), a"
    ),
)
def arc_error_report(spark, sf_dir):
    """Orders as arcs: a price a unit against the true prices of their lines, and an angle at the last line."""
    rows = quality.keep_one(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_returnflag")])
    rows = rows.withColumns({"guess": F.col("l_quantity") * 1500, "seen": F.col("l_discount") * 3600, "told": F.col("l_tax") * 3600})
    arcs = models.arc_errors(rows, "l_orderkey", "l_extendedprice", "guess", ["l_linenumber"], {"node": ("seen", "told")}, keep=("l_returnflag",))
    out = models.error_report(arcs, "l_returnflag", ["node"])
    return out.select(F.col("l_returnflag").alias("phase"), "whole", "n_arcs", *(F.round(c, 4).alias(c) for c in ("rmse_mean", "rmse_median", "rmse_p90")), F.round("node_mae", 6).alias("node_mae"))
