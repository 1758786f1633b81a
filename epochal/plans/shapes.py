"""Queries over conversions of elements, times, and shapes of distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.functions import orbital
from epochal.operators import density
from epochal.plans.orbits import CLEAN_SQL, STATE_SQL, clean
from epochal.plans.windows import P
from epochal.registry import query
from epochal.sources.tables import event_panel, micros, table


@query(
    "elements_from_state",
    f"""WITH {STATE_SQL}, m AS (SELECT rec, sqrt(x * x + y * y + z * z) AS r, vx * vx + vy * vy + vz * vz AS v2, x * vx + y * vy + z * vz AS rv, x, y, z, vx, vy, vz, y * vz - z * vy AS hx, z * vx - x * vz AS hy, x * vy - y * vx AS hz FROM xyz),
e AS (SELECT *, sqrt(hx * hx + hy * hy + hz * hz) AS h, (vy * hz - vz * hy) / 398600.4418 - x / r AS ex, (vz * hx - vx * hz) / 398600.4418 - y / r AS ey, (vx * hy - vy * hx) / 398600.4418 - z / r AS ez, sqrt(hx * hx + hy * hy) AS n FROM m),
g AS (SELECT *, sqrt(ex * ex + ey * ey + ez * ez) AS ecc, v2 / 2 - 398600.4418 / r AS energy FROM e),
k AS (SELECT *, degrees(acos(greatest(-1, least(1, (-hy * ex + hx * ey) / (n * ecc))))) AS w, degrees(acos(greatest(-1, least(1, (ex * x + ey * y + ez * z) / (ecc * r))))) AS v FROM g WHERE ecc > 0.0015 AND n / h > 1e-3)
SELECT rec, round(h, 3) AS h, round(energy, 6) AS energy, round(-398600.4418 / (2 * energy), 4) AS sma, round(ecc, 7) AS ecc, round(degrees(acos(greatest(-1, least(1, hz / h)))), 4) AS inc, round((degrees(atan2(hx, -hy)) + 360) % 360, 3) % 360 AS raan,
  round(CASE WHEN ez < 0 THEN 360 - w ELSE w END, 3) % 360 AS aop, round(CASE WHEN rv < 0 THEN 360 - v ELSE v END, 3) % 360 AS nu FROM k""",
)
def elements_from_state(spark, sf_dir):
    """Elements of the state vectors of orbits that have a node and an apsis."""
    own = clean(spark, sf_dir).where((F.col("ecc") > 0.0015) & (F.sin(F.radians("inc")) > 1e-3))
    state = orbital.state_vector(*(F.col(c) for c in ("sma", "ecc", "inc", "raan", "aop", "mean_anomaly")))
    rows = own.select("rec", *(state[c].alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))
    out = orbital.with_elements(rows)
    digits = {"h": 3, "energy": 6, "sma": 4, "ecc": 7, "inc": 4}
    turn = lambda c: (F.round(c, 3) % 360).alias(c)
    return out.select("rec", *(F.round(c, d).alias(c) for c, d in digits.items()), turn("raan"), turn("aop"), turn("nu"))


@query("selected_phase", f"WITH {CLEAN_SQL} SELECT rec, CASE WHEN ecc < 0.004 THEN 'mean_longitude' ELSE 'mean_anomaly' END AS variable, round(CASE WHEN ecc < 0.004 THEN (raan + aop + mean_anomaly) % 360 ELSE mean_anomaly END, 6) AS phase_deg FROM clean")
def selected_phase(spark, sf_dir):
    """Mean longitude where the orbit is too round for an apsis."""
    longitude = F.pmod(F.col("raan") + F.col("aop") + F.col("mean_anomaly"), F.lit(360.0))
    pick = lambda a, b: orbital.phase_choice(F.col("ecc"), a, b, 0.004)
    return clean(spark, sf_dir).select("rec", pick(F.lit("mean_anomaly"), F.lit("mean_longitude")).alias("variable"), F.round(pick(F.col("mean_anomaly"), longitude), 6).alias("phase_deg"))


@query("sidereal_time", "WITH j AS (SELECT event_id AS rec, epoch_us(ts) / 8.64e10::DOUBLE + 2440587.5 AS jd FROM events), t AS (SELECT *, (jd - 2451545.0) / 36525 AS t FROM j) SELECT rec, round(jd, 6) AS julian, round((100.4606184 + t * (36000.77004 + t * (0.000387933 - t / 38710000.0))) % 360, 5) AS sidereal_deg FROM t")
def sidereal_time(spark, sf_dir):
    julian = orbital.julian_date(micros("ts"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("rec"), F.round(julian, 6).alias("julian"), F.round(orbital.sidereal_angle(julian), 5).alias("sidereal_deg"))


@query(
    "kde_curve",
    f"""WITH {P}, s AS (SELECT object, count(value) AS n, min(value) AS low, max(value) AS high, stddev_samp(value) * pow(count(value), -0.2) AS h FROM p GROUP BY 1 HAVING count(value) >= 3 AND max(value) > min(value))
SELECT object, k::INT AS point, round(low + (high - low) * k / 31, 6) AS x, round(sum(exp(-0.5 * pow((low + (high - low) * k / 31 - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density
FROM p JOIN s USING (object), range(32) g(k) WHERE value IS NOT NULL GROUP BY object, k, low, high""",
)
def kde_curve(spark, sf_dir):
    return density.kde(event_panel(spark, sf_dir), "value").select("object", "point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query(
    "circular_linear_kde",
    f"""WITH {CLEAN_SQL}, s AS (SELECT count(*) AS n, min(sma) AS low, max(sma) AS high, greatest(1.06 * stddev_samp(sma) * pow(count(*), -0.2), 1e-6) AS h FROM clean)
SELECT i::INT AS i, j::INT AS j, i * 30.0::DOUBLE AS angle, round(low + (high - low) * j / 7, 6) AS value,
  round(sum(exp(25 * cos(2 * pi() * i / 12 - radians(raan)) - 0.5 * pow((low + (high - low) * j / 7 - sma) / h, 2))) / (2 * pi() * {density._bessel0(25.0)!r}::DOUBLE * sqrt(2 * pi()) * any_value(n) * any_value(h)), 12) AS density
FROM clean, s, range(12) a(i), range(8) b(j) GROUP BY i, j, low, high""",
)
def circular_linear_kde(spark, sf_dir):
    out = density.circular_linear_kde(clean(spark, sf_dir), "raan", "sma")
    return out.select("i", "j", "angle", F.round("value", 6).alias("value"), F.round("density", 12).alias("density"))


@query(
    "density_ellipses",
    """WITH c AS (SELECT l_returnflag AS label, count(*) AS n, avg(l_quantity) AS cx, avg(l_extendedprice) / 1000 AS cy, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_extendedprice / 1000) AS b, var_samp(l_extendedprice / 1000) AS d FROM lineitem GROUP BY 1),
e AS (SELECT *, (a + d) / 2 AS m, sqrt(pow(a - d, 2) / 4 + b * b) AS r FROM c)
SELECT label, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(4 * sqrt(m + r), 5) AS width, round(4 * sqrt(greatest(0, m - r)), 5) AS height, round(degrees(atan2(2 * b, a - d) / 2), 3) AS angle FROM e WHERE n > 1""",
)
def density_ellipses(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    out = density.ellipses(rows, "x", "y", "label")
    return out.select("label", "n", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round("width", 5).alias("width"), F.round("height", 5).alias("height"), F.round("angle", 3).alias("angle"))


@query(
    "feature_matrix",
    f"""WITH {CLEAN_SQL.replace("WITH ", "")}, r AS (SELECT rec, sma, ecc, sin(radians(raan)) AS s, cos(radians(raan)) AS c FROM elements)
SELECT rec, round(coalesce(sma, avg(sma) OVER ()), 6) AS f_sma, round(coalesce(ecc, avg(ecc) OVER ()), 8) AS f_ecc, round(coalesce(s, avg(s) OVER ()), 8) AS f_sin_raan, round(coalesce(c, avg(c) OVER ()), 8) AS f_cos_raan FROM r""",
)
def feature_matrix(spark, sf_dir):
    from epochal.plans.orbits import elements

    out = density.feature_columns(elements(spark, sf_dir), ["sma", "ecc"], ["raan"])
    return out.select("rec", F.round("f_sma", 6).alias("f_sma"), F.round("f_ecc", 8).alias("f_ecc"), F.round("f_sin_raan", 8).alias("f_sin_raan"), F.round("f_cos_raan", 8).alias("f_cos_raan"))
