"""Queries over rules for single records, splits, and how groups of objects keep together."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import coherence, rules, sampling, series
from epochal.plans.clusters import DRAWS, draws
from epochal.plans.orbits import CLEAN_SQL, clean
from epochal.plans.windows import P, r
from epochal.registry import query
from epochal.sources.tables import DAY, event_panel, table

BINS = (300, 400, 500, 600, 700, 800, 900, 1000, 1200, 1500)
LABELS = [f"({299.999 if not n else a}, {b}]" for n, (a, b) in enumerate(zip(BINS, BINS[1:], strict=False))]


@query(
    "shell_identity",
    "WITH s AS (SELECT p_partkey, (p_partkey * 37 % 1600)::DOUBLE AS a, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'nan' ELSE 'shell_' || p_size END AS shell FROM part), "
    "b AS (SELECT *, CASE WHEN a < 300 OR a > 1500 THEN 'nan' " + " ".join(f"WHEN a <= {b} THEN '{label}'" for b, label in zip(BINS[1:], LABELS, strict=True)) + " END AS bin FROM s) "
    "SELECT p_partkey, bin AS altitude_bin, CASE WHEN shell IS NULL OR shell = 'nan' THEN bin ELSE shell END AS shell_or_bin, CASE WHEN shell IS NULL OR shell = 'nan' THEN 'altitude_bin_fallback' ELSE 'candidate_shell_id' END AS shell_identity_source, shell IS NULL OR shell = 'nan' AS shell_is_altitude_fallback FROM b",
)
def shell_identity(spark, sf_dir):
    size = F.col("p_size")
    shell = F.when(size % 3 == 0, None).when(size % 7 == 0, "nan").otherwise(F.concat(F.lit("shell_"), size.cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 1600).cast("double").alias("altitude_km"), shell.alias("candidate_shell_id"))
    return rules.shell_identity(rows).select("p_partkey", "altitude_bin", "shell_or_bin", "shell_identity_source", "shell_is_altitude_fallback")


@query(
    "event_kinds",
    """WITH e AS (SELECT p_partkey, (p_partkey * 7 % 600 - 300) / 10.0 AS a, (p_size - 25) / 100.0 AS i, p_partkey % 7 * 1e-4 AS b, (p_partkey % 11 - 5) / 1000.0 AS d FROM part)
SELECT p_partkey, CASE WHEN a > 8 AND abs(i) > 0.05 THEN 'combined_raise_and_plane_change' WHEN a > 8 THEN 'semi_major_axis_raise' WHEN a < -8 AND (b > 3e-4 OR d < -0.003) THEN 'possible_disposal_start' WHEN a < -8 THEN 'semi_major_axis_lower'
  WHEN abs(i) > 0.05 THEN 'inclination_change' WHEN abs(a) <= 4 AND abs(i) <= 0.02 THEN 'possible_stationkeeping' WHEN abs(a) > 20 OR abs(i) > 0.2 THEN 'possible_anomaly' ELSE 'unknown_event' END AS kind FROM e""",
)
def event_kinds(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = rules.event_kind((key * 7 % 600 - 300) / 10, (size - 25) / 100, key % 7 * F.lit(1e-4), (key % 11 - 5) / 1000)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


POINTS = f"""WITH {P}, f AS (SELECT rec, row_number() OVER (PARTITION BY object ORDER BY t, rec) - 1 AS i, (rec * 13 % 201 - 100) / 100.0 AS s, (rec % 17)::DOUBLE AS v, rec % 11 * 1e-4 AS b, (rec % 31) / 100.0 AS e FROM p)"""


@query(
    "point_states",
    f"""{POINTS} SELECT rec, CASE WHEN i < 5 AND s > 0.4 THEN 'insertion_or_orbit_raise' WHEN s > 0.3 AND e > 0.05 THEN 'relocation' WHEN s > 0.2 THEN 'transition' WHEN s < -0.3 AND b > 3e-4 THEN 'disposal_lowering' WHEN s < -0.2 AND v < 10 THEN 'passive_decay'
  WHEN abs(s) <= 0.05 AND v <= 8 AND e < 0.08 THEN 'operational_shell' WHEN e > 0.2 THEN 'transition' WHEN b > 6e-4 AND s < -0.1 THEN 'likely_nonoperational' ELSE 'unknown' END AS state FROM f""",
)
def point_states(spark, sf_dir):
    rec = F.col("rec")
    rows = event_panel(spark, sf_dir).withColumn("i", F.row_number().over(series.ordered()) - 1)
    state = rules.point_state(F.col("i"), (rec * 13 % 201 - 100) / 100, (rec % 17).cast("double"), rec % 11 * F.lit(1e-4), (rec % 31) / 100)
    return rows.select("rec", state["state"].alias("state"))


# -- splits ---------------------------------------------------------------------
@query("split_by_object", f"WITH {P}, s AS (SELECT object, CASE WHEN (object * 7919 + 104729) % 1000003 % 100 < 70 THEN 'train' WHEN (object * 7919 + 104729) % 1000003 % 100 < 85 THEN 'valid' ELSE 'test' END AS split FROM p) SELECT split, count(*) AS n, count(DISTINCT object) AS n_objects FROM s GROUP BY split")
def split_by_object(spark, sf_dir):
    """All records of an object are on one side."""
    by = (F.col("object") * 7919 + 104729) % sampling.SPREAD
    rows = sampling.split(event_panel(spark, sf_dir), by, {"train": 70, "valid": 15, "test": 15})
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("object").alias("n_objects"))


@query("leave_one_out", f"WITH {P} SELECT object, (SELECT count(*) FROM p) - count(*) AS n_others, round((SELECT sum(value) FROM p) - sum(value), 3) AS total FROM p GROUP BY object")
def leave_one_out(spark, sf_dir):
    return sampling.leave_one_out(event_panel(spark, sf_dir), {"total": "value"}).select("object", "n_others", F.round("total", 3).alias("total"))


@query("first_seen_order", f"WITH {P}, f AS (SELECT category, min(rec) AS first FROM p GROUP BY 1) SELECT category, first, row_number() OVER (ORDER BY first, category) - 1 AS position FROM f")
def first_seen_order(spark, sf_dir):
    out = sampling.first_seen(event_panel(spark, sf_dir), "category", "rec")
    return out.select("category", "first", F.col("position").cast("long").alias("position"))


@query("largest_clusters", "SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 5")
def largest_clusters(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(5)


@query("spread_rows", f"WITH {P}, k AS (SELECT rec, row_number() OVER (PARTITION BY object ORDER BY t, rec) - 1 AS i, count(*) OVER (PARTITION BY object) AS n FROM p) SELECT rec FROM k WHERE n <= 20 OR i IN (SELECT k2 * (n - 1) // 19 FROM range(20) g(k2))")
def spread_rows(spark, sf_dir):
    return coherence.spread_rows(event_panel(spark, sf_dir), 20).select("rec")


# -- series ---------------------------------------------------------------------
@query("zscored", f"WITH {P}, m AS (SELECT object, avg(value) AS m, stddev_pop(value) AS s FROM p GROUP BY object) SELECT rec, {r('(value - m) / CASE WHEN s > 0 THEN s ELSE 1 END', 'y')} FROM p JOIN m USING (object)")
def zscored(spark, sf_dir):
    return coherence.normalised(event_panel(spark, sf_dir), "zscored").select("rec", (F.round("y", 6) + 0.0).alias("y"))


@query("detrended", f"WITH {P}, i AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY t, rec) - 1 AS i FROM p), f AS (SELECT object, regr_slope(value, i) AS s, regr_intercept(value, i) AS b FROM i GROUP BY object) SELECT rec, {r('value - b - s * i', 'y', 5)} FROM i JOIN f USING (object)")
def detrended(spark, sf_dir):
    return coherence.normalised(event_panel(spark, sf_dir), "detrended").select("rec", (F.round("y", 5) + 0.0).alias("y"))


@query("line_residuals", f"WITH {P}, x AS (SELECT *, (t - min(t) OVER (PARTITION BY object)) / {float(DAY)} AS x FROM p), f AS (SELECT object, regr_slope(value, x) AS s, regr_intercept(value, x) AS b, count(value) AS n FROM x GROUP BY object) SELECT rec, {r('CASE WHEN n >= 3 THEN value - b - s * x END', 'residual', 5)} FROM x JOIN f USING (object)")
def line_residuals(spark, sf_dir):
    return coherence.line_residuals(event_panel(spark, sf_dir)).select("rec", (F.round("residual", 5) + 0.0).alias("residual"))


SEGMENTS = "seg AS (SELECT object, min(i) AS a, max(i) AS z FROM (SELECT object, row_number() OVER (PARTITION BY object ORDER BY t, rec) - 1 AS i, value FROM p) WHERE value >= 90 GROUP BY object)"


@query(
    "segment_means",
    f"""WITH {P}, {SEGMENTS}, k AS (SELECT object, value, row_number() OVER (PARTITION BY object ORDER BY t, rec) - 1 AS i FROM p)
SELECT seg.object, round(avg(CASE WHEN i >= a - 4 AND i < a THEN value END), 6) AS before, round(avg(CASE WHEN i >= a AND i <= z THEN value END), 6) AS inside, round(avg(CASE WHEN i > z AND i <= z + 4 THEN value END), 6) AS after FROM seg JOIN k USING (object) GROUP BY seg.object""",
)
def segment_means(spark, sf_dir):
    """Means of the four rows before a segment (first to last row of 90 or more), of the segment, and of the four after it."""
    panel = event_panel(spark, sf_dir)
    i = panel.withColumn("i", F.row_number().over(series.ordered()) - 1)
    seg = i.where("value >= 90").groupBy("object").agg(F.min("i").alias("a"), F.max("i").alias("z"))
    parts = {"before": (F.col("a") - 4, F.col("a")), "inside": (F.col("a"), F.col("z") + 1), "after": (F.col("z") + 1, F.col("z") + 5)}
    ranges = seg.select("object", F.explode(F.array(*(F.struct(F.lit(n).alias("part"), a.alias("start"), b.alias("stop")) for n, (a, b) in parts.items()))).alias("x")).select("object", "x.*")
    means = coherence.range_means(panel, ranges)
    return means.groupBy("object").agg(*(F.round(F.max(F.when(F.col("part") == n, F.col("mean"))), 6).alias(n) for n in parts))


# -- groups of objects ---------------------------------------------------------------
DRIFT = f"""{CLEAN_SQL}, s AS (SELECT object, t, rec, round(raan - lag(raan) OVER w, 9) AS d1, round(mean_anomaly - lag(mean_anomaly) OVER w, 9) AS d2 FROM clean WINDOW w AS (PARTITION BY object ORDER BY t, rec)),
u AS (SELECT object, count(*) AS n, (max(t) - min(t)) / {float(DAY)} AS span, coalesce(sum(d1 + 180 - 360 * floor((d1 + 180) / 360) - 180), 0) AS a, coalesce(sum(d2 + 180 - 360 * floor((d2 + 180) / 360) - 180), 0) AS b FROM s GROUP BY object),
rates AS (SELECT object, n, CASE WHEN span > 0 THEN a / span ELSE 0 END AS raan_per_day, CASE WHEN span > 0 THEN b / span ELSE 0 END AS mean_anomaly_per_day FROM u)"""


def rates(spark, sf_dir):
    return coherence.drift_rates(clean(spark, sf_dir), "raan", "mean_anomaly")


@query("drift_rate", f"WITH {DRIFT} SELECT object, n, round(raan_per_day, 6) + 0.0 AS raan_per_day, round(mean_anomaly_per_day, 6) + 0.0 AS mean_anomaly_per_day FROM rates")
def drift_rate(spark, sf_dir):
    return rates(spark, sf_dir).select("object", "n", *((F.round(c, 6) + 0.0).alias(c) for c in ("raan_per_day", "mean_anomaly_per_day")))


@query("drift_loss", f"WITH {DRIFT} SELECT object % 5 AS grp, count(*) AS members, round(var_pop(raan_per_day) + 0.5 * var_pop(mean_anomaly_per_day), 6) AS loss FROM rates GROUP BY 1")
def drift_loss(spark, sf_dir):
    rows = rates(spark, sf_dir).withColumn("grp", F.col("object") % 5)
    return coherence.drift_loss(rows, "grp", "raan_per_day", "mean_anomaly_per_day", kappa=0.5).withColumn("loss", F.round("loss", 6))


@query(
    "tracking_losses",
    f"""WITH {CLEAN_SQL}, e AS (SELECT object % 5 AS grp, sma - 6900 AS a, radians(mean_anomaly) - 1.0::DOUBLE AS l FROM clean)
SELECT grp, count(*) AS n, round(avg(pow(a / 5, 2)), 4) AS sma_loss, round(avg(pow(atan2(sin(l), cos(l)) / 0.05, 2)), 4) AS phase_loss FROM e GROUP BY grp""",
)
def tracking_losses(spark, sf_dir):
    rows = clean(spark, sf_dir).select((F.col("object") % 5).alias("grp"), "sma", F.radians("mean_anomaly").alias("l"), F.lit(6900.0).alias("a_ref"), F.lit(1.0).alias("l_ref"))
    out = coherence.tracking_losses(rows, "grp", "sma", "l")
    return out.select("grp", "n", F.round("sma_loss", 4).alias("sma_loss"), F.round("phase_loss", 4).alias("phase_loss"))


@query(
    "checkpoint_spread",
    f"""WITH {CLEAN_SQL}, c AS (SELECT object % 5 AS grp, object AS member, t // {90 * DAY} AS checkpoint, avg(sma) AS a, min(radians(raan)) AS o, max(radians(mean_anomaly)) AS l FROM clean GROUP BY ALL),
f AS (SELECT grp, checkpoint, arg_min(o, member) AS o0, arg_min(l, member) AS l0 FROM c GROUP BY ALL),
n AS (SELECT c.grp, c.checkpoint, a, atan2(sin(o - o0), cos(o - o0)) + o0 AS o, atan2(sin(l - l0), cos(l - l0)) + l0 AS l FROM c JOIN f ON f.grp = c.grp AND f.checkpoint = c.checkpoint)
SELECT grp, checkpoint, count(*) AS members, round(avg(a), 6) AS mean_sma, round(var_samp(a) + var_samp(o) + var_samp(l), 6) AS trace FROM n GROUP BY ALL""",
)
def checkpoint_spread(spark, sf_dir):
    rows = clean(spark, sf_dir).groupBy((F.col("object") % 5).alias("grp"), F.col("object").alias("member"), F.floor(F.col("t") / (90 * DAY)).alias("checkpoint"))
    rows = rows.agg(F.avg("sma").alias("a"), F.min(F.radians("raan")).alias("o"), F.max(F.radians("mean_anomaly")).alias("l"))
    out = coherence.spread(rows, "grp", "checkpoint", "member", "a", "o", "l")
    return out.select("grp", "checkpoint", "members", F.round("mean_sma", 6).alias("mean_sma"), F.round("trace", 6).alias("trace"))


@query(
    "jsd_pairs",
    f"""WITH {DRAWS}, g AS (SELECT object % 12 AS g, x FROM d), ends AS (SELECT g, min(x) AS low, max(x) AS high FROM g GROUP BY g),
pairs AS (SELECT a.g AS a, b.g AS b, least(a.low, b.low) AS low, greatest(a.high, b.high) AS high FROM ends a JOIN ends b ON a.g < b.g),
h AS (SELECT a, b, least(floor((x - low) / (high - low) * 79), 78) AS bin, sum((g.g = a)::INT)::DOUBLE AS p, sum((g.g = b)::INT)::DOUBLE AS q FROM pairs JOIN g ON g.g = a OR g.g = b GROUP BY ALL),
n AS (SELECT a, b, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM h WINDOW w AS (PARTITION BY a, b))
SELECT a, b, round(sqrt(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS jsd FROM n GROUP BY a, b""",
)
def jsd_pairs(spark, sf_dir):
    """Distances of all draws, in twelve groups of objects."""
    rows = draws(spark, sf_dir).withColumn("object", F.col("object") % 12)
    return coherence.jensen_shannon(rows).withColumn("jsd", F.round("jsd", 6))
