"""Queries over fused evidence; the panel is one row a supplier and day of shipment, with means of what was shipped."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import evidence, rules
from epochal.registry import query
from epochal.sources.tables import micros, table

ELEMENTS = """el AS (SELECT l_suppkey AS object, epoch_us(l_shipdate) AS t, min(l_orderkey * 10 + l_linenumber) AS rec, 6800 + avg(l_quantity) AS sma, 53 + avg(l_discount) AS inc,
  15 + avg(l_tax) AS mean_motion, avg(l_tax) / 10 AS ecc, avg(l_extendedprice) / 200 AS raan, avg(l_discount) / 100 AS bstar FROM lineitem GROUP BY 1, 2)"""
ORDER = "PARTITION BY object ORDER BY i"
FIELDS = ("sma", "mean_motion", "inc", "ecc", "raan")
STEPS = ("sma", "mean_motion", "energy", "ecc", "inc", "raan")


def elements(spark, sf_dir, dealt=False):
    """Daily means of a supplier's shipments as a panel of elements; if ``dealt``, rows are dealt by the supplier first, so that steps by the supplier deal nothing anew."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("object"), micros("l_shipdate").alias("t"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    mean = lambda c: F.avg(c)
    return (rows.repartition("object") if dealt else rows).groupBy("object", "t").agg(
        F.min("rec").alias("rec"), (6800 + mean("l_quantity")).alias("sma"), (53 + mean("l_discount")).alias("inc"), (15 + mean("l_tax")).alias("mean_motion"),
        (mean("l_tax") / 10).alias("ecc"), (mean("l_extendedprice") / 200).alias("raan"), (mean("l_discount") / 100).alias("bstar"),
    )


def clipped(name: str, source: str, rounds: int, clip: float) -> str:
    """CTEs that end in ``name`` (object, sig, m, s): the median of all values, and the robust deviation after clipping rounds."""
    out = [f"{name}_0 AS (SELECT object, sig, v FROM {source} WHERE v IS NOT NULL)"]
    for k in range(rounds + 1):
        out.append(f"{name}_m{k} AS (SELECT object, sig, median(v) AS m, stddev_pop(v) AS sd FROM {name}_{k} GROUP BY ALL)")
        out.append(f"{name}_s{k} AS (SELECT object, sig, m, CASE WHEN mad > 1e-12 THEN 1.4826 * mad WHEN sd > 1e-12 THEN sd ELSE 1 END AS s FROM (SELECT object, sig, m, sd, median(abs(v - m)) AS mad FROM {name}_{k} JOIN {name}_m{k} USING (object, sig) GROUP BY ALL))")
        if k < rounds:
            out.append(f"{name}_{k + 1} AS (SELECT object, sig, v FROM (SELECT object, sig, v, abs(v - m) / s <= {clip} AS ok, count(*) FILTER (abs(v - m) / s <= {clip}) OVER (PARTITION BY object, sig) AS kept FROM {name}_{k} JOIN {name}_s{k} USING (object, sig)) WHERE ok OR kept < 8)")
    out.append(f"{name} AS (SELECT object, sig, {name}_m0.m, {name}_s{rounds}.s FROM {name}_m0 JOIN {name}_s{rounds} USING (object, sig))")
    return ",\n".join(out)


def prominent(name: str, source: str) -> str:
    """A CTE ``name``: ``source`` (object, i, sig, v) with the filled prominence ``p``."""
    by = "PARTITION BY object, sig ORDER BY i"
    return f"""{name}_k AS (SELECT *, CASE WHEN count(v) OVER w >= 3 THEN abs(v - quantile_cont(v, 0.5) OVER w) END AS k FROM {source} WINDOW w AS ({by} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
{name} AS (SELECT * EXCLUDE (k), coalesce(first_value(k IGNORE NULLS) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(k IGNORE NULLS) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS p,
  CASE WHEN (v >= lag(v) OVER ({by}) AND v >= lead(v) OVER ({by})) OR (v <= lag(v) OVER ({by}) AND v <= lead(v) OVER ({by})) THEN true ELSE false END AS turn FROM {name}_k)"""


def bridge(mask: str) -> str:
    return f"({mask} OR coalesce(lag({mask}) OVER ({ORDER}) AND lead({mask}) OVER ({ORDER}), false))"


_STEP = ", ".join(
    f"""CASE WHEN i > 9 AND n - i > 9 THEN regr_intercept({c}, x) OVER a + regr_slope({c}, x) OVER a * x1 - (regr_intercept({c}, x) OVER b + regr_slope({c}, x) OVER b * x1) END AS step_{c}""" for c in STEPS
)
_RATE = lambda c, name: f"coalesce(({c} - lag({c}) OVER o) / (x - lag(x) OVER o), (lead({c}) OVER o - {c}) / (lead(x) OVER o - x)) AS {name}"
DETECTED = f"""{ELEMENTS},
a0 AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY t, rec) AS i, count(*) OVER (PARTITION BY object) AS n, (t - min(t) OVER (PARTITION BY object)) / 1e6::DOUBLE AS x, -398600.4418::DOUBLE / (2 * sma) AS energy FROM el),
lists AS (SELECT object, list(sma ORDER BY i) AS ls, list(inc ORDER BY i) AS li FROM a0 GROUP BY object),
a1 AS (SELECT a0.*, list_reduce(ls[1:i], lambda m, y: m + 0.2 * (y - m)) AS ewm_sma, list_reduce(li[1:i], lambda m, y: m + 0.2 * (y - m)) AS ewm_inc FROM a0 JOIN lists USING (object)),
a2 AS (SELECT *, x - lag(x) OVER o AS dt, lead(x) OVER o AS x1, {', '.join(_RATE(c, f'd1_{c}') for c in FIELDS)}, {_RATE('ewm_sma', 'e1_sma')}, {_RATE('ewm_inc', 'e1_inc')},
  {', '.join(f'CASE WHEN count({c}) OVER t13 >= 4 THEN {c} - avg({c}) OVER t13 END AS local_{c}' for c in ('sma', 'inc'))} FROM a1 WINDOW o AS ({ORDER}), t13 AS ({ORDER} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
a3 AS (SELECT *, {_STEP}, {_RATE('e1_sma', 'e2_sma')}, {_RATE('e1_inc', 'e2_inc')}, {', '.join(f'{c} - (lag({c}) OVER o + coalesce(lag(d1_{c}) OVER o, 0) * dt) AS miss_{c}' for c in FIELDS)},
  coalesce(greatest({', '.join(f'abs({c} - lag({c}) OVER o) / {s}' for c, s in (('sma', 30.0), ('inc', 0.25), ('mean_motion', 0.05), ('raan', 2.0), ('bstar', 6e-4)))}), 0) AS e_anomaly
  FROM a2 WINDOW o AS ({ORDER}), a AS ({ORDER} ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING), b AS ({ORDER} ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)),
sig AS ({' UNION ALL '.join(f"SELECT object, i, '{c}' AS sig, {c} AS v FROM a3" for c in ('local_sma', 'local_inc', *(f'step_{c}' for c in STEPS)))}),
{prominent('sp', 'sig')},
{clipped('sv', 'sig', 3, 4.5)},
spv AS (SELECT object, sig, p AS v FROM sp),
{clipped('sq', 'spv', 2, 4.0)},
z AS (SELECT sp.object, sp.i, sp.sig, coalesce(abs(v - sv.m) / greatest(1e-9, sv.s), 0) AS z, turn AND p >= greatest(0, sq.m + 0.5 * sq.s) AS peak FROM sp LEFT JOIN sv USING (object, sig) LEFT JOIN sq USING (object, sig)),
g AS (SELECT object, i, max(z) FILTER (sig LIKE 'local%') AS e_local, max(z) FILTER (sig LIKE 'step%') AS e_filtered, bool_or(z >= 3 AND peak) FILTER (sig LIKE 'local%') AS m_local, bool_or(z >= 3 AND peak) FILTER (sig LIKE 'step%') AS m_filtered FROM z GROUP BY ALL),
miss AS ({' UNION ALL '.join(f"SELECT object, i, '{c}' AS sig, miss_{c} AS v FROM a3" for c in FIELDS)}),
{clipped('ms', 'miss', 3, 4.5)},
pe AS (SELECT object, i, 'e' AS sig, coalesce(avg(abs(v) / s), 0) AS v FROM miss JOIN ms USING (object, sig) GROUP BY ALL),
{prominent('pp', 'pe')},
ppv AS (SELECT object, sig, p AS v FROM pp),
{clipped('pq', 'ppv', 2, 4.0)},
es AS (SELECT a3.*, g.* EXCLUDE (object, i), pp.v AS e_predicted, pp.p AS p_predicted, pp.v >= 3.5 AND pp.turn AND pp.p >= greatest(0, pq.m + 0.5 * pq.s) AS m_predicted,
  coalesce(greatest(abs(e1_sma) / 0.002, abs(e2_sma) / 2e-6, abs(e1_inc) / 5e-5, abs(e2_inc) / 2e-8), 0) AS e_smoothed FROM a3 JOIN g USING (object, i) JOIN pp USING (object, i) JOIN pq USING (object)),
ew AS (SELECT *, bool_or(e_smoothed >= 1) OVER ({ORDER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w_smoothed FROM es),
det AS (SELECT * EXCLUDE (m_local), {bridge('m_local')} AS m_local, {bridge('w_smoothed')} AS m_smoothed FROM ew)"""


@query(
    "fuse_evidence",
    f"""WITH {DETECTED} SELECT object, t, m_local OR m_filtered OR m_smoothed OR m_predicted AS "union", round(greatest(e_local, e_filtered, e_smoothed, e_predicted), 4) AS union_score,
round((e_local + 1.15 * e_filtered + e_smoothed + 1.2 * e_predicted) / 4.35, 4) AS weighted_score FROM det""",
)
def fuse_evidence(spark, sf_dir):
    out = evidence.fuse(evidence.detect(elements(spark, sf_dir, dealt=True), full=False))
    return out.select("object", "t", "union", F.round("union_score", 4).alias("union_score"), F.round("weighted_score", 4).alias("weighted_score"))


SEGMENTS = f"""{DETECTED},
pw AS (SELECT object, i, 'f' AS sig, (coalesce(step_sma, 0) + coalesce(step_mean_motion, 0) + coalesce(step_energy, 0) + coalesce(step_ecc, 0)) / nullif((step_sma IS NOT NULL)::INT + (step_mean_motion IS NOT NULL)::INT + (step_energy IS NOT NULL)::INT + (step_ecc IS NOT NULL)::INT, 0) AS v FROM a3
  UNION ALL SELECT object, i, 's', coalesce(e1_sma, 0) FROM a3),
{prominent('wp', 'pw')},
dp AS (SELECT det.*, f.v AS energy_step, greatest(f.p, s.p, p_predicted) AS prominence FROM det JOIN (SELECT * FROM wp WHERE sig = 'f') f USING (object, i) JOIN (SELECT * FROM wp WHERE sig = 's') s USING (object, i) WHERE n >= 10),
s1 AS (SELECT *, {bridge('m_local')} OR {bridge('m_filtered')} OR {bridge('m_smoothed')} OR {bridge('m_predicted')} AS u FROM dp),
s2 AS (SELECT * EXCLUDE (u), {bridge('u')} AS u FROM s1),
any_u AS (SELECT object, bool_or(u) AS has FROM s2 GROUP BY object),
s3 AS (SELECT s2.*, count(*) FILTER (u AND NOT coalesce(pu, false)) OVER (PARTITION BY object ORDER BY i) AS segment FROM (SELECT *, lag(u) OVER ({ORDER}) AS pu FROM s2) s2 JOIN any_u USING (object) WHERE has),
cv AS (SELECT object, coalesce(stddev_pop(dt) / median(dt), 0) AS cv FROM a3 GROUP BY object),
seg AS (SELECT object, segment, min(t) AS t_start, max(t) AS t_end, count(*) AS support_points, bool_or(m_local)::INT + bool_or(m_filtered)::INT + bool_or(m_smoothed)::INT + bool_or(m_predicted)::INT AS n_families,
  greatest(max(e_local), max(e_filtered), max(e_smoothed), max(e_predicted)) AS peak, (avg(e_local) + avg(e_filtered) + avg(e_smoothed) + avg(e_predicted)) / 4 AS mean_e, max(prominence) AS prominence, max(e_anomaly) AS anomaly, max(e_predicted) AS predicted FROM s3 WHERE u GROUP BY ALL),
sc AS (SELECT seg.*, (0.42 * peak + 0.28 * mean_e + 0.20 * prominence + 0.10 * n_families / 4) / (1 + cv) + 0.10 * least(1, predicted) AS score FROM seg JOIN cv USING (object) WHERE support_points >= 2 AND ((t_end - t_start) / 1e6 >= 21600 OR peak >= 0.7))"""


@query(
    "candidate_segments",
    f"""WITH {SEGMENTS} SELECT object, t_start, t_end, support_points, n_families, round(peak, 4) AS peak_evidence, round(mean_e, 4) AS integrated_evidence, round(prominence, 4) AS prominence, round(anomaly, 3) AS anomaly_score,
round(score, 4) AS score, (score >= 1 AND prominence >= 0.5) OR peak >= 0.8 AS accepted FROM sc""",
)
def candidate_segments(spark, sf_dir):
    out = evidence.segments_of(elements(spark, sf_dir, dealt=True))
    return out.select(
        "object", "t_start", "t_end", "support_points", F.size("families").alias("n_families"), *(F.round(c, 4).alias(c) for c in ("peak_evidence", "integrated_evidence", "prominence")),
        F.round("anomaly_score", 3).alias("anomaly_score"), F.round("score", 4).alias("score"), "accepted",
    )


@query("fused_events")
def fused_events(spark, sf_dir):
    return evidence.events(elements(spark, sf_dir, dealt=True))


#: Events planted halfway through every supplier's panel, as large as a hundredth of its account.
PLANTED = """ps AS (SELECT s_suppkey AS object, 803347200000000 AS t_at, s_acctbal / 100 AS delta_sma FROM supplier)"""


def planted(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("object"), F.lit(803_347_200_000_000).alias("t_at"), F.lit("step").alias("mode"), (F.col("s_acctbal") / 100).alias("delta_sma"), F.lit(0.0).alias("delta_inc"), F.lit(5).alias("points"), F.lit(None).cast("double").alias("set_bstar")
    )


@query("injected_events", f"WITH {ELEMENTS}, {PLANTED} SELECT el.object, el.t, round(sma + CASE WHEN el.t >= t_at THEN delta_sma ELSE 0 END, 6) AS sma FROM el LEFT JOIN ps USING (object)")
def injected_events(spark, sf_dir):
    return evidence.inject(elements(spark, sf_dir), planted(spark, sf_dir)).select("object", "t", F.round("sma", 6).alias("sma"))


@query("family_ablation")
def family_ablation(spark, sf_dir):
    """Families of detectors alone and fused, on the panel with planted events."""
    schedule = planted(spark, sf_dir)
    kind = F.when(F.col("delta_sma") > 0, "semi_major_axis_raise").otherwise("semi_major_axis_lower")
    truth = schedule.select("object", F.col("t_at").alias("t_event"), kind.alias("event_type"))
    return evidence.ablation(evidence.inject(elements(spark, sf_dir, dealt=True), schedule), truth, 3 * 86_400_000_000)


@query(
    "event_layer_modes",
    f"""WITH {SEGMENTS}, q AS (SELECT *, (score >= 1 AND prominence >= 0.5) OR peak >= 0.8 AS accepted, anomaly >= 5 AND n_families <= 1 AS odd FROM sc),
l AS (SELECT *, CASE WHEN NOT accepted THEN 'rejected' WHEN odd THEN 'anomaly_screened' WHEN score >= 1.6 THEN 'accepted_high_confidence' ELSE 'accepted' END AS quality, CASE WHEN accepted THEN 'accepted' ELSE 'raw_candidate' END AS layer FROM q)
SELECT mode, count(*) FILTER (CASE mode WHEN 'all' THEN true WHEN 'accepted_plus_raw' THEN layer IN ('accepted', 'raw_candidate', 'accepted_candidate') WHEN 'accepted_only' THEN NOT contains(quality, 'reject') WHEN 'raw_only' THEN contains(layer, 'raw')
  WHEN 'rejects_only' THEN contains(quality, 'reject') OR contains(quality, 'anomaly_screened') ELSE NOT contains(quality, 'reject') AND least(1, score / 2) >= 0.8 END) AS n
FROM l, (SELECT unnest(['all', 'accepted_plus_raw', 'accepted_only', 'raw_only', 'rejects_only', 'accepted_high_confidence']) AS mode) m GROUP BY mode""",
)
def event_layer_modes(spark, sf_dir):
    """How many segments each of the six layer modes keeps."""
    own = evidence.segments_of(elements(spark, sf_dir, dealt=True))
    odd = (F.col("anomaly_score") >= 5) & (F.size("families") <= 1)
    quality = F.when(~F.col("accepted"), "rejected").when(odd, "anomaly_screened").when(F.col("score") >= 1.6, "accepted_high_confidence").otherwise("accepted")
    rows = own.select(quality.alias("quality"), F.when(F.col("accepted"), "accepted").otherwise("raw_candidate").alias("layer"), F.least(F.lit(1.0), F.col("score") / 2).alias("event_score"))
    counts = rows.agg(*(F.count_if(rules.in_layer(m)).alias(m) for m in rules.LAYER_MODES))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("n")) for m in rules.LAYER_MODES))).alias("x")).select("x.*")
