"""Queries over resonance screening, widths and outer rates, and over members and policies of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.functions import orbital
from epochal.operators import policies, quality, resonance
from epochal.plans.orbits import CLEAN_SQL, RES_SQL, clean, near_resonances
from epochal.registry import query
from epochal.sources.tables import table

#: How the angles of all definitions behave, an object and definition.
BEHAVIOUR_SQL = """
d AS (SELECT rec, object, t, raan, aop, mean_anomaly, (t - 946684800000000) / 86400000000.0::DOUBLE AS days FROM clean),
e AS (SELECT rec, object, t, raan AS o, aop AS w, mean_anomaly AS m, 280.460 + 0.9856474::DOUBLE * days AS sun, 125.045 - 0.0529538::DOUBLE * days AS moon, 280.46061837 + 360.98564736629::DOUBLE * days AS earth FROM d),
u AS (SELECT rec, object, t, unnest([
  {'r': 'srp_omega_minus_lambda_sun', 'x': w - sun}, {'r': 'srp_omega_plus_lambda_sun', 'x': w + sun}, {'r': 'srp_Omega_plus_omega_minus_lambda_sun', 'x': o + w - sun},
  {'r': 'srp_omega_minus_Omega_minus_lambda_sun', 'x': w - o - sun}, {'r': 'srp_twoomega_plus_Omega_minus_lambda_sun', 'x': 2 * w + o - sun},
  {'r': 'meo_twoomega_plus_Omega_minus_Omega_moon', 'x': 2 * w + o - moon}, {'r': 'meo_omega_plus_Omega_minus_Omega_moon', 'x': w + o - moon},
  {'r': 'inc_two_domega_plus_dOmega_zero', 'x': 2 * w + o}, {'r': 'inc_domega_zero', 'x': w}, {'r': 'tesseral_14_1', 'x': m - 14 * earth}, {'r': 'tesseral_15_1', 'x': m - 15 * earth}]) AS q FROM e),
psi AS (SELECT rec, object, t, q.r AS resonance, q.x + 180 - 360 * floor((q.x + 180) / 360) - 180 AS psi FROM u),
st AS (SELECT *, round(psi - lag(psi) OVER (PARTITION BY object, resonance ORDER BY t, rec), 6) AS d FROM psi),
g AS (SELECT object, resonance, count(*) AS n, max(psi) - min(psi) AS span, abs(coalesce(sum(d + 180 - 360 * floor((d + 180) / 360) - 180), 0)) AS drift FROM st GROUP BY ALL),
b AS (SELECT object, resonance, CASE WHEN n < 24 THEN 'insufficient_data' WHEN drift > 540 AND span > 260 THEN 'circulation' WHEN span <= 240 AND drift < 360 THEN 'libration_candidate' ELSE 'transition_or_mixed' END AS behaviour FROM g)"""


@query(
    "resonance_screen",
    f"""WITH {RES_SQL}, {BEHAVIOUR_SQL},
s AS (SELECT res.rec, res.name, near, coalesce(b.behaviour, 'insufficient_data') AS behaviour, near AND coalesce(b.behaviour = 'libration_candidate', false) AS candidate,
  res.ecc <= 0.004 AND (res.name LIKE 'srp%' OR res.name LIKE 'meo%' OR res.name LIKE 'inc%') AS weak_apsis FROM res LEFT JOIN b ON b.object = res.object AND b.resonance = res.name)
SELECT *, CASE WHEN NOT candidate THEN 'not_candidate' WHEN weak_apsis THEN 'low_confidence_low_e_apsidal' ELSE 'screening_candidate' END AS confidence FROM s""",
)
def resonance_screen(spark, sf_dir):
    """Records near a resonance whose angle librates, the apsis of rounder orbits taken for weak."""
    rows = clean(spark, sf_dir).select("rec", "object", "t", "ecc", "raan", "aop", "mean_anomaly")
    out = resonance.screened(near_resonances(spark, sf_dir), resonance.object_behaviours(rows), low_ecc=0.004)
    return out.select("rec", "name", "near", "behaviour", "candidate", "weak_apsis", "confidence")


@query(
    "resonance_widths",
    f"""WITH {RES_SQL},
k AS (SELECT rec, object, t, best, CASE family WHEN 'SRP_SOLAR_LEO' THEN 1.0 WHEN 'LUNISOLAR_SECULAR_MEO' THEN 0.75 WHEN 'INCLINATION_ONLY_SECULAR' THEN 0.9 WHEN 'TESSERAL_GROUNDTRACK' THEN 0.6 ELSE 0.5 END::DOUBLE AS scale FROM res),
m AS (SELECT *, CASE WHEN count(best) OVER w >= 3 THEN quantile_cont(best, 0.5) OVER w END AS mid, row_number() OVER (PARTITION BY object ORDER BY t, rec) AS i, count(*) OVER (PARTITION BY object) AS n FROM k WINDOW w AS (PARTITION BY object ORDER BY t, rec ROWS 11 PRECEDING)),
l AS (SELECT *, lag(mid) OVER v AS a, lead(mid) OVER v AS z FROM m WINDOW v AS (PARTITION BY object ORDER BY t, rec)),
s AS (SELECT *, CASE WHEN i = 1 THEN z - mid WHEN i = n THEN mid - a ELSE (z - a) / 2 END AS slope FROM l)
SELECT rec, round(1 / (1 + best), 6) AS reciprocal, round(scale / (1 + best), 6) AS family_scaled, round(scale / (1 + coalesce(mid, best) + abs(slope)), 6) AS rolling_local, CASE WHEN slope IS NOT NULL THEN 0.75 END::DOUBLE AS confidence FROM s""",
)
def resonance_widths(spark, sf_dir):
    """Proxies of width by all three methods, and the confidence in the local one."""
    out = near_resonances(spark, sf_dir).select("rec", "object", "t", "proximity", "family")
    for method in ("reciprocal", "family_scaled", "rolling_local"):
        out = resonance.width_proxy(out, method, output=method)
    return out.select("rec", *(F.round(m, 6).alias(m) for m in ("reciprocal", "family_scaled", "rolling_local")), F.col("rolling_local_confidence").alias("confidence"))


@query(
    "third_body_rates",
    f"""WITH {CLEAN_SQL}, s AS (SELECT rec, radians(inc) AS i, 0.75 * sqrt(398600.4418 / pow(sma, 3)) * (1.32712440018e11 / 398600.4418 * pow(sma / 149597870.7, 3) / pow(1 - 0.0167086 * 0.0167086::DOUBLE, 1.5) + 4902.800066 / 398600.4418 * pow(sma / 384400.0, 3) / pow(1 - 0.0549 * 0.0549::DOUBLE, 1.5)) * 86400 AS k FROM clean)
SELECT rec, round(degrees(-k * cos(i)), 9) + 0.0 AS node, round(degrees(k * (5 * pow(cos(i), 2) - 1)), 9) + 0.0 AS perigee FROM s""",
)
def third_body_rates(spark, sf_dir):
    """Degrees a day that sun and moon turn node and perigee by."""
    node, perigee = orbital.third_body_rates(F.col("sma"), F.col("ecc"), F.col("inc"))
    day = lambda rate: F.round(orbital.per_day(rate), 9) + 0.0
    return clean(spark, sf_dir).select("rec", day(node).alias("node"), day(perigee).alias("perigee"))


#: The cluster that most of a supplier's shipments name by their quantity.
VOTES_SQL = """n AS (SELECT l_suppkey AS object, floor(l_quantity / 10)::BIGINT AS cluster_id, count(*) AS votes FROM lineitem GROUP BY ALL),
votes AS (SELECT object, cluster_id, votes, n_rows FROM (SELECT *, sum(votes) OVER (PARTITION BY object)::BIGINT AS n_rows, row_number() OVER (PARTITION BY object ORDER BY votes DESC, cluster_id) AS k FROM n) WHERE k = 1)"""
FEATURES = {"sma": "sma", "ecc": "ecc", "inc": "inc"} | {f"{f}_{a}": f"{f}(radians({a}))" for a in ("aop", "raan", "mean_anomaly") for f in ("sin", "cos")}
LATEST_SQL = f"""{CLEAN_SQL}, {VOTES_SQL}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY t DESC, rec DESC) AS k FROM clean) WHERE k = 1)"""


def votes(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem")
    return policies.voted(shipped.select(F.col("l_suppkey").alias("object"), F.floor(F.col("l_quantity") / 10).alias("cluster_id")))


def members(spark, sf_dir):
    """The last record of each object, with its cluster."""
    latest = quality.keep_one(clean(spark, sf_dir), ["object"], [F.desc("t"), F.desc("rec")])
    return policies.assigned(latest, votes(spark, sf_dir))


@query("cluster_votes", f"WITH {VOTES_SQL} SELECT * FROM votes")
def cluster_votes(spark, sf_dir):
    return votes(spark, sf_dir)


@query(
    "pooled_members",
    f"""WITH {LATEST_SQL},
m AS (SELECT latest.*, coalesce(cluster_id, 0) AS c, {", ".join(f"{e} AS f_{n}" for n, e in FEATURES.items())} FROM latest LEFT JOIN votes USING (object)),
z AS (SELECT object, c, {", ".join(f"(f_{n} - avg(f_{n}) OVER ()) / CASE WHEN stddev_pop(f_{n}) OVER () > 1e-12 THEN stddev_pop(f_{n}) OVER () ELSE 1 END AS z_{n}" for n in FEATURES)} FROM m WHERE c > 0),
a AS (SELECT c, count(*) AS n, {", ".join(f"avg(z_{n}) AS a_{n}" for n in FEATURES)} FROM z GROUP BY 1),
k AS (SELECT object, c, n, row_number() OVER (PARTITION BY c ORDER BY round({" + ".join(f"pow(z_{n} - a_{n}, 2)" for n in FEATURES)}, 9), object) AS k FROM z JOIN a USING (c))
SELECT object, c AS cluster_id, 'medoid' AS role, n AS weight_active, (SELECT count(*) FROM votes WHERE cluster_id = c) AS weight_global FROM k WHERE k = 1
UNION ALL SELECT object, c, 'noise', 1, CASE WHEN c IN (SELECT cluster_id FROM votes) THEN (SELECT count(*) FROM votes WHERE cluster_id = c) ELSE 1 END FROM m WHERE c <= 0""",
)
def pooled_members(spark, sf_dir):
    sizes = votes(spark, sf_dir).groupBy("cluster_id").count()
    return policies.pooled(members(spark, sf_dir), sizes=sizes).select("object", "cluster_id", "role", "weight_active", "weight_global")


#: Trials of policies, from prices and sizes of parts.
TRIALS_SQL = """trials AS (SELECT p_partkey AS trial, p_size % 6 AS cluster_id, round(p_retailprice / 100) - 15 AS delta_a, (p_size - 25) / 500.0::DOUBLE AS delta_Omega, (p_size - 25) / 250.0::DOUBLE AS delta_lambda, 86400.0::DOUBLE AS tau_keep, 5.0::DOUBLE AS deadband_a, 0.01::DOUBLE AS deadband_lambda,
  p_size / 100.0::DOUBLE AS reserve_prop_frac, (200 + 4 * p_size)::DOUBLE AS disposal_altitude_trigger, abs(p_retailprice - 1450) AS cost FROM part),
tried AS (SELECT *, CASE WHEN delta_a < -10 OR delta_a > 10 THEN 'delta_a outside [-10.0, 10.0]' WHEN delta_Omega < -0.05 OR delta_Omega > 0.05 THEN 'delta_Omega outside [-0.05, 0.05]' WHEN delta_lambda < -0.1 OR delta_lambda > 0.1 THEN 'delta_lambda outside [-0.1, 0.1]'
  WHEN reserve_prop_frac > 0.4 THEN 'reserve_prop_frac outside [0.0, 0.4]' WHEN disposal_altitude_trigger > 350 THEN 'disposal_altitude_trigger outside [200.0, 350.0]' WHEN 6500 + delta_a < 6498.1366 THEN 'orbit below the least safe altitude' ELSE '' END AS reason FROM trials),
o AS (SELECT cluster_id, delta_a, delta_Omega, delta_lambda, reserve_prop_frac, disposal_altitude_trigger, min(cost) AS cost, count(*) AS n_trials FROM tried WHERE reason = '' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cost, delta_a, delta_Omega, delta_lambda, reserve_prop_frac, disposal_altitude_trigger)::INT AS rank FROM o)"""


def trials(spark, sf_dir):
    size = F.col("p_size")
    fixed = {c: F.lit(policies.NOMINAL[c]) for c in ("tau_keep", "deadband_a", "deadband_lambda")}
    made = {
        "trial": F.col("p_partkey"), "cluster_id": (size % 6).cast("long"), "delta_a": F.round(F.col("p_retailprice") / 100) - 15, "delta_Omega": (size - 25) / 500, "delta_lambda": (size - 25) / 250, **fixed,
        "reserve_prop_frac": size / 100, "disposal_altitude_trigger": (200 + 4 * size).cast("double"), "cost": F.abs(F.col("p_retailprice") - 1450),
    }
    rows = table(spark, sf_dir, "part").select(*(c.alias(n) for n, c in made.items()))
    return rows.withColumn("reason", policies.infeasible(sma=6500.0))


@query("policy_screen", f"WITH {TRIALS_SQL} SELECT trial, reason = '' AS feasible, reason FROM tried")
def policy_screen(spark, sf_dir):
    return trials(spark, sf_dir).select("trial", (F.col("reason") == "").alias("feasible"), "reason")


@query("policy_ranking", f"WITH {TRIALS_SQL} SELECT cluster_id::BIGINT AS cluster_id, rank, delta_a, round(delta_Omega, 6) + 0.0 AS delta_node, reserve_prop_frac, round(cost, 6) AS cost, n_trials FROM ranked WHERE rank <= 3")
def policy_ranking(spark, sf_dir):
    """The three best policies of each cluster (a report)."""
    best = policies.ranked(trials(spark, sf_dir), 3)
    return best.select("cluster_id", "rank", "delta_a", (F.round("delta_Omega", 6) + 0.0).alias("delta_node"), "reserve_prop_frac", F.round("cost", 6).alias("cost"), "n_trials")


@query(
    "policy_offsets",
    f"""WITH {LATEST_SQL}, {TRIALS_SQL},
m AS (SELECT latest.*, coalesce(votes.cluster_id, 0) AS c FROM latest LEFT JOIN votes USING (object)), p AS (SELECT * FROM ranked WHERE rank = 1 AND cluster_id > 0)
SELECT object, p.rank IS NOT NULL AS applied, round(greatest(sma + coalesce(delta_a, 0), 6498.1366), 6) AS sma, round((raan + degrees(coalesce(delta_Omega, 0)) + 360) % 360, 6) % 360 AS raan, round((mean_anomaly + degrees(coalesce(delta_lambda, 0)) + 360) % 360, 6) % 360 AS mean_anomaly FROM m LEFT JOIN p ON p.cluster_id = m.c""",
)
def policy_offsets(spark, sf_dir):
    """Each object's last elements, moved by the best policy of its cluster."""
    best = policies.ranked(trials(spark, sf_dir), 1)
    out = policies.offset(policies.with_policy(members(spark, sf_dir), best))
    turn = lambda c: (F.round(c, 6) % 360).alias(c)
    return out.select("object", F.col("policy_applied").alias("applied"), F.round("sma", 6).alias("sma"), turn("raan"), turn("mean_anomaly"))


@query(
    "run_comparison",
    f"""WITH {CLEAN_SQL}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY t, rec) AS k FROM clean) WHERE k = 1), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY t DESC, rec DESC) AS k FROM clean) WHERE k = 1)
SELECT object, f.sma AS base_sma, l.sma AS other_sma, round(l.sma - f.sma, 6) + 0.0 AS delta_sma, round(l.raan - f.raan + 180 - 360 * floor((l.raan - f.raan + 180) / 360) - 180, 6) + 0.0 AS delta_raan, round(l.mean_anomaly - f.mean_anomaly + 180 - 360 * floor((l.mean_anomaly - f.mean_anomaly + 180) / 360) - 180, 6) + 0.0 AS delta_mean_anomaly FROM f JOIN l USING (object)""",
)
def run_comparison(spark, sf_dir):
    """First and last record of each object, row by row."""
    rows = clean(spark, sf_dir)
    first, last = quality.keep_one(rows, ["object"], [F.asc("t"), F.asc("rec")]), quality.keep_one(rows, ["object"], [F.desc("t"), F.desc("rec")])
    out = policies.compared(first, last, "object", ["sma"], ["raan", "mean_anomaly"])
    return out.select("object", "base_sma", "other_sma", *((F.round(c, 6) + 0.0).alias(c) for c in ("delta_sma", "delta_raan", "delta_mean_anomaly")))
