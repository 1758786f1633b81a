"""Queries over orbital expressions: elements are derived from lineitem and part by fixed arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.functions import angles, orbital
from epochal.operators import quality, resonance
from epochal.registry import query
from epochal.sources import tle
from epochal.sources.tables import DAY, micros, table

#: Elements of each lineitem row; every 97th eccentricity and every 89th node is spoilt for quality control.
ELEMENTS_SQL = """
elements AS (
  SELECT l_orderkey * 10 + l_linenumber AS rec, l_suppkey AS object, epoch_us(l_shipdate) AS t,
         CASE WHEN l_orderkey % 97 = 0 THEN 1.5 ELSE l_tax / 10 END AS ecc,
         (l_partkey % 181)::DOUBLE + CASE WHEN l_orderkey % 83 = 0 THEN 40 ELSE 0 END AS inc,
         CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE (l_partkey * 7 % 3600) / 10.0::DOUBLE END AS raan,
         ((l_orderkey * 13 % 3600) / 10.0)::DOUBLE AS aop, ((l_suppkey * 31 + l_linenumber * 17) % 360)::DOUBLE AS mean_anomaly,
         14 + l_discount * 10 + CASE WHEN l_orderkey % 79 = 0 THEN -20 ELSE 0 END AS mean_motion,
         6700 + l_quantity * 8 + CASE WHEN l_linenumber = 7 THEN 3000 ELSE 0 END AS sma
  FROM lineitem)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    spoilt = lambda n: key % n == 0
    return table(spark, sf_dir, "lineitem").select(
        (key * 10 + F.col("l_linenumber")).alias("rec"),
        F.col("l_suppkey").alias("object"),
        micros("l_shipdate").alias("t"),
        F.when(spoilt(97), 1.5).otherwise(F.col("l_tax") / 10).alias("ecc"),
        ((F.col("l_partkey") % 181).cast("double") + F.when(spoilt(83), 40).otherwise(0)).alias("inc"),
        F.when(~spoilt(89), (F.col("l_partkey") * 7 % 3600) / 10).alias("raan"),
        (key * 13 % 3600 / 10).alias("aop"),
        ((F.col("l_suppkey") * 31 + F.col("l_linenumber") * 17) % 360).cast("double").alias("mean_anomaly"),
        (14 + F.col("l_discount") * 10 + F.when(spoilt(79), -20).otherwise(0)).alias("mean_motion"),
        (6700 + F.col("l_quantity") * 8 + F.when(F.col("l_linenumber") == 7, 3000).otherwise(0)).alias("sma"),
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).where(quality.sound_elements(9000))


REASONS_SQL = f"""{ELEMENTS_SQL},
judged AS (
  SELECT *, concat_ws(';',
    CASE WHEN t IS NULL THEN 'invalid_timestamp' END,
    CASE WHEN ecc IS NULL OR ecc < 0 OR ecc >= 1 THEN 'invalid_ecc_bounds' END,
    CASE WHEN inc IS NULL OR inc < 0 OR inc > 180 THEN 'invalid_inc_bounds' END,
    CASE WHEN mean_motion IS NULL OR mean_motion <= 0 THEN 'invalid_mean_motion' END,
    CASE WHEN sma IS NULL OR sma <= 0 THEN 'invalid_sma' END,
    CASE WHEN sma > 9000 THEN 'sma_above_max' END,
    CASE WHEN raan IS NULL THEN 'nonfinite_raan' END,
    CASE WHEN aop IS NULL THEN 'nonfinite_aop' END,
    CASE WHEN mean_anomaly IS NULL THEN 'nonfinite_mean_anomaly' END) AS reasons FROM elements)"""
CLEAN_SQL = f"{REASONS_SQL}, clean AS (SELECT * FROM judged WHERE reasons = '')"


@query("qc_reject_reasons", f"WITH {REASONS_SQL} SELECT rec, reasons FROM judged WHERE reasons <> ''")
def qc_reject_reasons(spark, sf_dir):
    judged = quality.reject_reasons(elements(spark, sf_dir), quality.element_rules(9000))
    return judged.where("reasons <> ''").select("rec", "reasons")


@query("qc_counts_by_cause", f"WITH {REASONS_SQL} SELECT cause, count(*) AS n FROM (SELECT unnest(string_split(reasons, ';')) AS cause FROM judged) WHERE cause <> '' GROUP BY cause")
def qc_counts_by_cause(spark, sf_dir):
    return quality.counts_by_cause(quality.reject_reasons(elements(spark, sf_dir), quality.element_rules(9000)))


@query("qc_accept", f"WITH {CLEAN_SQL} SELECT count(*) AS n, count(DISTINCT object) AS n_objects, min(sma) AS min_sma, max(sma) AS max_sma FROM clean")
def qc_accept(spark, sf_dir):
    return clean(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("object").alias("n_objects"), F.min("sma").alias("min_sma"), F.max("sma").alias("max_sma"))


@query(
    "phase_features_wrapped",
    f"""WITH {CLEAN_SQL},
f AS (SELECT rec, aop + mean_anomaly AS u, raan + aop AS w, raan + aop + mean_anomaly AS l FROM clean)
SELECT rec, round(u % 360, 6) AS arg_latitude, round(w % 360, 6) AS lon_perigee, round(l % 360, 6) AS mean_longitude,
       round((l + 180) % 360 - 180, 6) AS mean_longitude_pm180 FROM f""",
)
def phase_features_wrapped(spark, sf_dir):
    u = F.col("aop") + F.col("mean_anomaly")
    w = F.col("raan") + F.col("aop")
    lon = w + F.col("mean_anomaly")
    named = {"arg_latitude": angles.wrap_360(u), "lon_perigee": angles.wrap_360(w), "mean_longitude": angles.wrap_360(lon), "mean_longitude_pm180": angles.wrap_180(lon)}
    return clean(spark, sf_dir).select("rec", *(F.round(v, 6).alias(k) for k, v in named.items()))


@query(
    "unwrap_per_object",
    f"""WITH {CLEAN_SQL},
s AS (SELECT *, raan - lag(raan) OVER (PARTITION BY object ORDER BY t, rec) AS d FROM clean),
k AS (SELECT *, CASE WHEN abs(d) > 180 THEN -360.0 * floor((d + 180) / 360) ELSE 0 END AS turn FROM s)
SELECT rec, object, round(raan + sum(turn) OVER (PARTITION BY object ORDER BY t, rec ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM k""",
)
def unwrap_per_object(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("object").orderBy("t", "rec")
    rows = clean(spark, sf_dir).withColumn("turn", angles.unwrapped(F.col("raan"), ["object"], ["t", "rec"]))
    return rows.select("rec", "object", F.round(F.col("raan") + F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("unwrapped"))


KEPLER = "list_reduce(list_prepend(CASE WHEN m < pi() THEN m + ecc / 2 ELSE m - ecc / 2 END, list_transform(range(12), lambda i: m)), lambda e, q: e - (e - ecc * sin(e) - m) / (1 - ecc * cos(e)))"


@query(
    "kepler_true_anomaly",
    f"""WITH {CLEAN_SQL},
a AS (SELECT rec, ecc, radians(mean_anomaly % 360) AS m FROM clean),
e AS (SELECT rec, ecc, {KEPLER} AS e FROM a)
SELECT rec, round((degrees(2 * atan2(sqrt(1 + ecc) * sin(e / 2), sqrt(1 - ecc) * cos(e / 2))) + 360) % 360, 6) AS true_anomaly FROM e""",
)
def kepler_true_anomaly(spark, sf_dir):
    return clean(spark, sf_dir).select("rec", F.round(orbital.true_anomaly(F.col("mean_anomaly"), F.col("ecc")), 6).alias("true_anomaly"))


@query(
    "sma_from_mean_motion",
    f"""WITH {CLEAN_SQL},
a AS (SELECT rec, ecc, pow(398600.4418, 1 / 3.0) / pow(mean_motion * (2 * pi() / 86400), 2 / 3.0) AS a FROM clean)
SELECT rec, round(a, 6) AS sma_km, round(sqrt(398600.4418 * a * (1 - ecc * ecc)), 6) AS h_km2_s, round(a - 6378.14, 6) AS altitude_km,
       round(2 * pi() * sqrt(pow(a, 3) / 398600.4418), 6) AS period_s FROM a""",
)
def sma_from_mean_motion(spark, sf_dir):
    rows = clean(spark, sf_dir).withColumn("a", orbital.semi_major_axis(F.col("mean_motion")))
    named = {"sma_km": F.col("a"), "h_km2_s": orbital.angular_momentum(F.col("a"), F.col("ecc")), "altitude_km": F.col("a") - orbital.EARTH_RADIUS, "period_s": orbital.period(F.col("a"))}
    return rows.select("rec", *(F.round(v, 6).alias(k) for k, v in named.items()))


J2_SQL = f"""{CLEAN_SQL},
n AS (SELECT *, sqrt(398600.4418 / pow(sma, 3)) AS n, 1.082635854e-3 * sqrt(398600.4418 / pow(sma, 3)) * pow(6378.14 / (sma * (1 - ecc * ecc)), 2) AS f, cos(radians(inc)) AS c FROM clean),
j2 AS (SELECT *, degrees(-1.5 * f * c * 86400) AS node, degrees(0.75 * f * (5 * c * c - 1) * 86400) AS perigee,
       degrees((n + 0.75 * f * sqrt(1 - ecc * ecc) * (3 * c * c - 1)) * 86400) AS anomaly FROM n)"""


@query("j2_rates", f"WITH {J2_SQL} SELECT rec, round(node, 6) AS node_deg_day, round(perigee, 6) AS perigee_deg_day, round(anomaly, 5) AS anomaly_deg_day, round(node + perigee + anomaly, 5) AS longitude_deg_day FROM j2")
def j2_rates(spark, sf_dir):
    args = [F.col(c) for c in ("sma", "ecc", "inc")]
    node, perigee, anomaly = (orbital.per_day(f(*args)) for f in (orbital.node_rate, orbital.perigee_rate, orbital.anomaly_rate))
    return clean(spark, sf_dir).select(
        "rec", F.round(node, 6).alias("node_deg_day"), F.round(perigee, 6).alias("perigee_deg_day"), F.round(anomaly, 5).alias("anomaly_deg_day"), F.round(node + perigee + anomaly, 5).alias("longitude_deg_day")
    )


@query("sun_sync_inclination", f"WITH {J2_SQL}, s AS (SELECT rec, -(2 * pi() / (365.2421897 * 86400)) / (1.5 * f) AS c FROM j2) SELECT rec, CASE WHEN abs(c) <= 1 THEN round(degrees(acos(c)), 6) END AS inc_deg FROM s")
def sun_sync_inclination(spark, sf_dir):
    return clean(spark, sf_dir).select("rec", F.round(orbital.sun_synchronous_inclination(F.col("sma"), F.col("ecc")), 6).alias("inc_deg"))


STATE_SQL = f"""{CLEAN_SQL},
s AS (SELECT *, radians(inc) AS i, radians(raan) AS o, radians(aop) AS w, radians(mean_anomaly) AS v, sma * (1 - ecc * ecc) AS p FROM clean),
q AS (SELECT *, p / (1 + ecc * cos(v)) AS r, sqrt(398600.4418 / p) AS k FROM s),
pq AS (SELECT *, r * cos(v) AS px, r * sin(v) AS py, -k * sin(v) AS qx, k * (ecc + cos(v)) AS qy FROM q),
xyz AS (SELECT *, (cos(o) * cos(w) - sin(o) * sin(w) * cos(i)) * px + (-cos(o) * sin(w) - sin(o) * cos(w) * cos(i)) * py AS x,
  (sin(o) * cos(w) + cos(o) * sin(w) * cos(i)) * px + (-sin(o) * sin(w) + cos(o) * cos(w) * cos(i)) * py AS y,
  sin(w) * sin(i) * px + cos(w) * sin(i) * py AS z,
  (cos(o) * cos(w) - sin(o) * sin(w) * cos(i)) * qx + (-cos(o) * sin(w) - sin(o) * cos(w) * cos(i)) * qy AS vx,
  (sin(o) * cos(w) + cos(o) * sin(w) * cos(i)) * qx + (-sin(o) * sin(w) + cos(o) * cos(w) * cos(i)) * qy AS vy,
  sin(w) * sin(i) * qx + cos(w) * sin(i) * qy AS vz FROM pq)"""


@query("state_vectors", f"WITH {STATE_SQL} SELECT rec, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in ("x", "y", "z", "vx", "vy", "vz")) + " FROM xyz")
def state_vectors(spark, sf_dir):
    parts = orbital.state_vector(*(F.col(c) for c in ("sma", "ecc", "inc", "raan", "aop", "mean_anomaly")))
    return clean(spark, sf_dir).select("rec", *((F.round(parts[c], 5) + 0.0).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))


@query(
    "orbital_diagnostics",
    f"""WITH {STATE_SQL}
SELECT rec, round(-398600.4418 / (2 * sma), 6) AS energy, round(sma * (1 - ecc), 6) AS perigee_km, round(sma * (1 + ecc), 6) AS apogee_km,
       round(sqrt(398600.4418 * (2 / r - 1 / sma)), 6) AS speed_km_s, round(degrees(atan2(ecc * sin(v), 1 + ecc * cos(v))), 6) + 0.0 AS flight_path_deg,
       round(sqrt(x * x + y * y + z * z) - r, 4) + 0.0 AS radius_residual_km FROM xyz""",
)
def orbital_diagnostics(spark, sf_dir):
    a, e, v = F.col("sma"), F.col("ecc"), F.radians("mean_anomaly")
    parts = orbital.state_vector(*(F.col(c) for c in ("sma", "ecc", "inc", "raan", "aop", "mean_anomaly")))
    r = a * (1 - e * e) / (1 + e * F.cos(v))
    named = {
        "energy": -orbital.MU / (2 * a),
        "perigee_km": a * (1 - e),
        "apogee_km": a * (1 + e),
        "speed_km_s": F.sqrt(orbital.MU * (2 / r - 1 / a)),
        "flight_path_deg": F.degrees(F.atan2(e * F.sin(v), 1 + e * F.cos(v))),
    }
    size = F.sqrt(sum(parts[c] * parts[c] for c in "xyz"))
    return clean(spark, sf_dir).select("rec", *((F.round(x, 6) + 0.0).alias(k) for k, x in named.items()), (F.round(size - r, 4) + 0.0).alias("radius_residual_km"))


@query("beam_relations", "SELECT p_partkey, round(1.32 * 0.95 * (p_size / 10.0) * sqrt(p_retailprice), 6) AS thrust_mn, round(154.8 * 0.95 * 0.9 * sqrt(p_retailprice), 6) AS isp_s, round(p_retailprice * (p_size / 10.0) / (0.9 * 0.95), 6) AS power_w FROM part")
def beam_relations(spark, sf_dir):
    made = orbital.ion_thruster(F.col("p_retailprice"), F.col("p_size") / 10)
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(v, 6).alias(k) for k, v in made.items()))


# -- resonances ---------------------------------------------------------------
#: Residuals in radians a day, written out one by one: not taken from the operator.
RES_SQL = f"""{CLEAN_SQL},
mm AS (SELECT *, sqrt(398600.4418 / pow(sma, 3)) AS m FROM clean),
rates AS (SELECT *, -1.5 * 1.082635854e-3 * m * pow(6378.14 / (sma * (1 - ecc * ecc)), 2) * cos(radians(inc)) * 86400 AS om,
  0.75 * 1.082635854e-3 * m * pow(6378.14 / (sma * (1 - ecc * ecc)), 2) * (5 * pow(cos(radians(inc)), 2) - 1) * 86400 AS w,
  m * 86400 AS n, 2 * pi() / 365.2422 AS sun, -2 * pi() / (18.6 * 365.2422) AS moon, 2 * pi() * 1.00273790935 AS earth FROM mm),
every AS (
  SELECT rec, object, t, sma, ecc, inc, list_sort([
    {{'p': abs(w - sun), 'i': 0, 'name': 'srp_omega_minus_lambda_sun', 'family': 'SRP_SOLAR_LEO'}},
    {{'p': abs(w + sun), 'i': 1, 'name': 'srp_omega_plus_lambda_sun', 'family': 'SRP_SOLAR_LEO'}},
    {{'p': abs(om + w - sun), 'i': 2, 'name': 'srp_Omega_plus_omega_minus_lambda_sun', 'family': 'SRP_SOLAR_LEO'}},
    {{'p': abs(w - om - sun), 'i': 3, 'name': 'srp_omega_minus_Omega_minus_lambda_sun', 'family': 'SRP_SOLAR_LEO'}},
    {{'p': abs(2 * w + om - sun), 'i': 4, 'name': 'srp_twoomega_plus_Omega_minus_lambda_sun', 'family': 'SRP_SOLAR_LEO'}},
    {{'p': abs(2 * w + om - moon), 'i': 5, 'name': 'meo_twoomega_plus_Omega_minus_Omega_moon', 'family': 'LUNISOLAR_SECULAR_MEO'}},
    {{'p': abs(w + om - moon), 'i': 6, 'name': 'meo_omega_plus_Omega_minus_Omega_moon', 'family': 'LUNISOLAR_SECULAR_MEO'}},
    {{'p': abs(2 * w + om), 'i': 7, 'name': 'inc_two_domega_plus_dOmega_zero', 'family': 'INCLINATION_ONLY_SECULAR'}},
    {{'p': abs(w), 'i': 8, 'name': 'inc_domega_zero', 'family': 'INCLINATION_ONLY_SECULAR'}},
    {{'p': abs(n - 14 * earth), 'i': 9, 'name': 'tesseral_14_1', 'family': 'TESSERAL_GROUNDTRACK'}},
    {{'p': abs(n - 15 * earth), 'i': 10, 'name': 'tesseral_15_1', 'family': 'TESSERAL_GROUNDTRACK'}}])[1] AS e FROM rates),
res AS (SELECT rec, object, t, sma, ecc, inc, e.name AS name, e.family AS family, e.p AS best, e.p <= 0.01 AS near FROM every)"""


def near_resonances(spark, sf_dir):
    return resonance.best_match(resonance.rates(clean(spark, sf_dir)), tolerance=0.01)


#: A dozen definitions' worth of rows is made of each record, so the angles of four families' first ones are asked for.
ANGLES_SQL = f"""{CLEAN_SQL},
d AS (SELECT *, (t - 946684800000000) / 86400000000.0::DOUBLE AS days FROM clean),
e AS (SELECT rec, object, t, ecc, raan, aop, mean_anomaly, 280.460 + 0.9856474::DOUBLE * days AS sun, 125.045 - 0.0529538::DOUBLE * days AS moon, 280.46061837 + 360.98564736629::DOUBLE * days AS earth FROM d),
a AS (
  SELECT rec, object, t, 'srp_omega_minus_lambda_sun' AS resonance, aop - sun AS x, ecc > 1e-3 AS valid FROM e
  UNION ALL SELECT rec, object, t, 'meo_omega_plus_Omega_minus_Omega_moon', aop + raan - moon, ecc > 1e-3 FROM e
  UNION ALL SELECT rec, object, t, 'inc_domega_zero', aop, ecc > 1e-3 FROM e
  UNION ALL SELECT rec, object, t, 'tesseral_15_1', mean_anomaly - 15 * earth, true FROM e),
psi AS (SELECT rec, object, t, resonance, valid, x + 180 - 360 * floor((x + 180) / 360) - 180 AS psi FROM a)"""
ASKED = ("srp_omega_minus_lambda_sun", "meo_omega_plus_Omega_minus_Omega_moon", "inc_domega_zero", "tesseral_15_1")


def angle_rows(spark, sf_dir):
    rows = clean(spark, sf_dir).select("rec", "object", "t", "ecc", "raan", "aop", "mean_anomaly")
    return resonance.resonant_angles(rows, tuple(d for d in resonance.BUILT_IN if d.name in ASKED))


@query("resonance_angles", f"WITH {ANGLES_SQL} SELECT rec, resonance, round(psi, 6) AS psi, valid FROM psi")
def resonance_angles(spark, sf_dir):
    return angle_rows(spark, sf_dir).select("rec", "resonance", F.round("psi", 6).alias("psi"), "valid")


@query(
    "resonance_behaviour",
    f"""WITH {ANGLES_SQL},
s AS (SELECT *, round(psi - lag(psi) OVER (PARTITION BY object, resonance ORDER BY t, rec), 6) AS d FROM psi),
g AS (SELECT object, resonance, count(*) AS n, max(psi) - min(psi) AS span, abs(coalesce(sum(d + 180 - 360 * floor((d + 180) / 360) - 180), 0)) AS drift FROM s GROUP BY ALL)
SELECT object, resonance, n, round(span, 3) AS span, round(drift, 3) AS drift,
       CASE WHEN n < 24 THEN 'insufficient_data' WHEN drift > 540 AND span > 260 THEN 'circulation' WHEN span <= 240 AND drift < 360 THEN 'libration_candidate' ELSE 'transition_or_mixed' END AS behaviour FROM g""",
)
def resonance_behaviour(spark, sf_dir):
    out = resonance.angle_behaviour(angle_rows(spark, sf_dir), ["object", "resonance"], ["t", "rec"])
    return out.select("object", "resonance", "n", F.round("span", 3).alias("span"), F.round("drift", 3).alias("drift"), "behaviour")


@query("resonance_best_match", f"WITH {RES_SQL} SELECT rec, name, family, round(best, 6) AS proximity, near FROM res")
def resonance_best_match(spark, sf_dir):
    return near_resonances(spark, sf_dir).select("rec", "name", "family", F.round("proximity", 6).alias("proximity"), "near")


@query("resonance_object_summary", f"WITH {RES_SQL} SELECT object, count(*) AS n, count(DISTINCT t) AS n_epochs, sum(near::INT)::BIGINT AS n_near, round(avg(near::INT), 6) AS fraction, count(DISTINCT CASE WHEN near THEN t END) AS near_epochs FROM res GROUP BY object")
def resonance_object_summary(spark, sf_dir):
    return resonance.by_object(near_resonances(spark, sf_dir))


@query(
    "resonance_object_windows",
    f"""WITH {RES_SQL},
w AS (SELECT object, floor(t / {30 * DAY})::BIGINT AS w, max(near::INT) AS near FROM res GROUP BY 1, 2)
SELECT object, max(w) - min(w) + 1 AS n_windows, sum(near)::BIGINT AS near_windows, round(sum(near) / (max(w) - min(w) + 1), 6) AS fraction FROM w GROUP BY object""",
)
def resonance_object_windows(spark, sf_dir):
    return resonance.by_window(near_resonances(spark, sf_dir), 30 * DAY)


@query(
    "resonance_ai_grid",
    f"""WITH {RES_SQL},
cell AS (SELECT *, floor((sma - 6700) / 50)::INT AS ia, floor(inc / 20)::INT AS ii FROM res WHERE sma >= 6700 AND sma < 7200 AND inc >= 0 AND inc < 180),
agg AS (SELECT ia, ii, count(*) AS n, round(quantile_cont(best, 0.5), 6) AS median, round(quantile_cont(best, 0.25), 6) AS p25, round(quantile_cont(best, 0.75), 6) AS p75, round(avg(near::INT), 6) AS fraction FROM cell GROUP BY 1, 2),
fam AS (SELECT ia, ii, family FROM (SELECT ia, ii, family, row_number() OVER (PARTITION BY ia, ii ORDER BY count(*) DESC, family) AS k FROM cell GROUP BY 1, 2, 3) WHERE k = 1)
SELECT a.ia::INT AS ia, i.ii::INT AS ii, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN median END AS median, CASE WHEN n >= 5 THEN p25 END AS p25, CASE WHEN n >= 5 THEN p75 END AS p75,
       CASE WHEN n >= 5 THEN fraction END AS fraction, CASE WHEN n >= 5 THEN fam.family END AS family
FROM range(10) a(ia) CROSS JOIN range(9) i(ii) LEFT JOIN agg ON agg.ia = a.ia AND agg.ii = i.ii LEFT JOIN fam ON fam.ia = a.ia AND fam.ii = i.ii""",
)
def resonance_ai_grid(spark, sf_dir):
    return resonance.grid(near_resonances(spark, sf_dir), (6700, 50, 10), (0, 20, 9), least=5)


# -- element text ---------------------------------------------------------------
@query(
    "tle_roundtrip_parse",
    """SELECT o_orderkey, lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS norad, epoch_us(make_timestamp(2000 + (o_orderkey % 25)::BIGINT, 1, 1, 0, 0, 0)) + ((o_orderkey % 365) * 86400000000 + (o_orderkey % 1000) * 86400000)::BIGINT AS epoch_us,
       round((o_custkey % 1800) / 10.0, 4) AS inc, round((o_orderkey % 3600) / 10.0, 4) AS raan, round((o_custkey % 9999999) / 1e7, 7) AS ecc, round(15 + (o_orderkey % 1000) / 1000.0, 8) AS mean_motion, true AS checksum_ok FROM orders""",
)
def tle_roundtrip_parse(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        *tle.format_lines(
            norad=key % 100000,
            year=2000 + key % 25,
            day=(1 + key % 365) + (key % 1000) / 1000,
            inc=(cust % 1800) / 10,
            raan=(key % 3600) / 10,
            ecc_e7=cust % 9999999,
            mean_motion=15 + (key % 1000) / 1000,
        ),
    )
    got = tle.parse(rows)
    return got.select("o_orderkey", "norad", "epoch_us", "inc", "raan", "ecc", "mean_motion", (F.col("checksum1_ok") & F.col("checksum2_ok")).alias("checksum_ok"))


@query("assumed_decimal", "SELECT p_partkey, round(CASE WHEN p_size % 5 = 0 THEN NULL ELSE (CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END) * (p_partkey % 100000) / 1e5 * pow(10, -(p_size % 4)) END, 12) AS value FROM part")
def assumed_decimal(spark, sf_dir):
    size = F.col("p_size")
    text = F.when(size % 5 != 0, F.concat(F.when(size % 2 == 0, "-").otherwise("+"), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), F.lit("-"), (size % 4).cast("string"))).otherwise("     ")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(tle.assumed_decimal(text), 12).alias("value"))


@query(
    "element_epoch_text",
    """WITH p AS (SELECT event_id AS rec, epoch_us(ts) AS t FROM events), d AS (SELECT rec, t // 86400000000 AS d, round((t % 86400000000) / 864.0)::BIGINT AS f FROM p),
c AS (SELECT rec, DATE '1970-01-01' + (d + CASE WHEN f >= 100000000 THEN 1 ELSE 0 END)::INT AS d, f % 100000000 AS f FROM d)
SELECT rec, lpad((year(d) % 100)::VARCHAR, 2, '0') || lpad(dayofyear(d)::VARCHAR, 3, '0') || '.' || lpad(f::VARCHAR, 8, '0') AS epoch FROM c""",
)
def element_epoch_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("rec"), tle.epoch_field(micros("ts")).alias("epoch"))
