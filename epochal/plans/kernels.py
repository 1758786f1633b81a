"""Queries over numerical kernels; the panel is the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import kernels, phases, series, validity
from epochal.plans.clusters import vecs
from epochal.plans.windows import P
from epochal.registry import query
from epochal.sources.tables import DAY, event_panel, table

FREQUENCIES = [0.1, 0.2, 0.5, 1.0]


EVENTS = f"{P}, e AS (SELECT * FROM p)"


@query(
    "lomb_scargle",
    f"""WITH {EVENTS}, m AS (SELECT object, avg(value) AS m, min(t) AS t0, var_pop(value) AS v FROM e GROUP BY object),
x AS (SELECT object, f, 2 * pi() * f * (t - t0) / {float(DAY)} AS w, value - m AS y, v FROM e JOIN m USING (object), (SELECT unnest([0.1, 0.2, 0.5, 1.0])::DOUBLE AS f) g),
s AS (SELECT object, f, sum(sin(2 * w)) AS s2, sum(cos(2 * w)) AS c2, sum(y * sin(w)) AS ys, sum(y * cos(w)) AS yc, count(*) AS n, first(v) AS v FROM x GROUP BY 1, 2), q AS (SELECT *, atan2(s2, c2) / 2 AS a FROM s)
SELECT object, f, round((pow(yc * cos(a) + ys * sin(a), 2) / ((n + c2 * cos(2 * a) + s2 * sin(2 * a)) / 2) + pow(ys * cos(a) - yc * sin(a), 2) / ((n - c2 * cos(2 * a) - s2 * sin(2 * a)) / 2)) / (2 * v), 5) AS power FROM q""",
)
def lomb_scargle(spark, sf_dir):
    return kernels.periodogram(event_panel(spark, sf_dir), FREQUENCIES).withColumn("power", F.round("power", 5))


@query(
    "dft_small",
    f"""WITH {EVENTS}, r AS (SELECT object, row_number() OVER (PARTITION BY object ORDER BY t, rec) - 1 AS i, count(*) OVER (PARTITION BY object) AS n, value - avg(value) OVER (PARTITION BY object) AS y FROM e),
s AS (SELECT object, k, sum(y * cos(2 * pi() * k * i / n)) AS re, sum(y * sin(2 * pi() * k * i / n)) AS im, first(n) AS n FROM r, range(1, 6) g(k) GROUP BY 1, 2) SELECT object, k::INT AS k, round(2 * sqrt(re * re + im * im) / n, 6) AS amplitude FROM s""",
)
def dft_small(spark, sf_dir):
    return kernels.dft(event_panel(spark, sf_dir), 5).withColumn("amplitude", F.round("amplitude", 6))


@query(
    "lagged_xcorr",
    f"""WITH {EVENTS}, l AS (SELECT object, value, k, lead(value, k::INT) OVER (PARTITION BY object, k ORDER BY t, rec) AS z FROM e, range(0, 4) g(k)) SELECT object, k::INT AS lag, count(*) AS n, round(corr(value, z), 6) AS r FROM l WHERE z IS NOT NULL GROUP BY 1, 2""",
)
def lagged_xcorr(spark, sf_dir):
    return kernels.lagged_correlation(event_panel(spark, sf_dir), "value", "value", 3).withColumn("r", F.round("r", 6))


#: Values on the lines between an object's rows, four a day.
GRID = f"""{P}, own AS (SELECT object, t, arg_min(value, rec) AS value FROM p WHERE object IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, (t - min(t) OVER (PARTITION BY object)) / 2.16e10::DOUBLE AS x FROM own),
nx AS (SELECT *, lead(x) OVER w AS x1, lead(value) OVER w AS y1 FROM x WINDOW w AS (PARTITION BY object ORDER BY t)),
g AS (SELECT object, x, x1, value, y1, unnest(generate_series(ceil(x)::BIGINT, coalesce(ceil(x1) - 1, floor(x))::BIGINT)) AS i FROM nx),
grid AS (SELECT object, i, coalesce(value + (y1 - value) * (i - x) / (x1 - x), value) AS y FROM g)"""


@query(
    "fft_amplitude",
    f"""WITH {GRID}, s AS (SELECT object, count(*) AS n, avg(y) AS m FROM grid GROUP BY 1 HAVING count(*) >= 4),
w AS (SELECT object, n, i, 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) AS h, y - m AS z FROM grid JOIN s USING (object)),
q AS (SELECT object, n, k, sum(h) AS gain, sum(z * h * cos(2 * pi() * k * i / n)) AS re, sum(z * h * sin(2 * pi() * k * i / n)) AS im FROM w, range(1, 17) r(k) WHERE 2 * k <= n GROUP BY ALL)
SELECT object, round(k / (n * 0.25::DOUBLE), 9) AS frequency, round(2 * sqrt(re * re + im * im) / gain, 5) AS amplitude FROM q""",
)
def fft_amplitude(spark, sf_dir):
    return kernels.spectrum(event_panel(spark, sf_dir), 0.25, bins=16).select("object", F.round("frequency", 9).alias("frequency"), F.round("amplitude", 5).alias("amplitude"))


@query(
    "welch_density",
    f"""WITH {GRID}, s AS (SELECT object, unnest([i // 16, i // 16 - 1]) AS s, i, y FROM grid), j AS (SELECT object, s, i - s * 16 AS j, y, avg(y) OVER (PARTITION BY object, s) AS m, count(*) OVER (PARTITION BY object, s) AS n FROM s WHERE s >= 0),
z AS (SELECT object, s, j, (y - m) * (0.5 - 0.5 * cos(2 * pi() * j / 31)) AS z FROM j WHERE n = 32),
q AS (SELECT object, s, k, sum(z * cos(2 * pi() * k * j / 32)) AS re, sum(z * sin(2 * pi() * k * j / 32)) AS im FROM z, range(0, 17) r(k) GROUP BY ALL)
SELECT object, k / 8.0::DOUBLE AS frequency, round(avg((re * re + im * im) * 0.25 * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) / (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * j / 31), 2)) FROM range(32) w(j)), 4) AS density FROM q GROUP BY object, k""",
)
def welch_density(spark, sf_dir):
    return kernels.welch(event_panel(spark, sf_dir), 0.25).withColumn("density", F.round("density", 4))


@query(
    "wavelet_z",
    f"""WITH {P}, o AS (SELECT object, t, value AS y, (t - min(t) OVER (PARTITION BY object)) / {float(DAY)} AS x, (max(t) OVER (PARTITION BY object) - min(t) OVER (PARTITION BY object)) / {float(DAY)} AS span, avg(value) OVER (PARTITION BY object) AS m FROM p WHERE object IS NOT NULL AND value IS NOT NULL),
g AS (SELECT object, span * k / 7 AS tau, k, f, 2 * pi() * f * (x - span * k / 7) AS a, y - m AS y FROM o, range(8) r(k), (SELECT unnest([0.1, 0.2, 0.5, 1.0])::DOUBLE AS f) q),
w AS (SELECT *, exp(-0.0125 * a * a) AS w, cos(a) AS c, sin(a) AS s FROM g),
u AS (SELECT object, k, tau, f, sum(w) AS s00, sum(w * w) AS sww, sum(w * c) / sum(w) AS mc, sum(w * s) / sum(w) AS ms, sum(w * y) / sum(w) AS my, sum(w * c * c) / sum(w) AS cc, sum(w * c * s) / sum(w) AS cs, sum(w * s * s) / sum(w) AS ss,
  sum(w * c * y) / sum(w) AS cy, sum(w * s * y) / sum(w) AS sy, sum(w * y * y) / sum(w) AS yy FROM w GROUP BY object, k, tau, f),
v AS (SELECT *, s00 * s00 / sww AS n, cc - mc * mc AS a, cs - mc * ms AS b, ss - ms * ms AS d, cy - mc * my AS p, sy - ms * my AS q, yy - my * my AS var FROM u),
z AS (SELECT *, (p * (p * d - q * b) + q * (a * q - b * p)) / (a * d - b * b) AS fit FROM v WHERE n > 3.5 AND a * d - b * b > 1e-12)
SELECT object, round(tau, 6) AS tau_days, f AS frequency, round((n - 3) * fit / (2 * greatest(var - fit, 1e-12)), 4) AS z FROM z""",
)
def wavelet_z(spark, sf_dir):
    out = kernels.weighted_wavelet(event_panel(spark, sf_dir), FREQUENCIES)
    return out.select("object", F.round("tau_days", 6).alias("tau_days"), "frequency", F.round("z", 4).alias("z"))


@query(
    "ewm_derivative",
    f"""WITH {P}, l AS (SELECT object, list(value ORDER BY t, rec) AS v, list(rec ORDER BY t, rec) AS r FROM p GROUP BY object),
u AS (SELECT object, v, unnest(r) AS rec, unnest(range(1, len(r) + 1)) AS i FROM l),
m AS (SELECT object, rec, i, list_reduce(v[1:i], lambda m, x: CASE WHEN x IS NULL THEN m WHEN m IS NULL THEN x ELSE m + 0.2 * (x - m) END) AS e FROM u)
SELECT m.rec, round(e, 6) AS ewm, round((e - lag(e) OVER w) / ((t - lag(t) OVER w) / {float(DAY)}), 5) + 0.0 AS slope FROM m JOIN p ON p.rec = m.rec WINDOW w AS (PARTITION BY m.object ORDER BY t, m.rec)""",
)
def ewm_derivative(spark, sf_dir):
    """Slope a day of the exponential mean; null where two rows have one time."""
    out = kernels.exponential_mean(event_panel(spark, sf_dir).select("object", "t", "rec", "value"), 9)
    w = series.ordered()
    slope = F.try_divide(F.col("ewm") - F.lag("ewm").over(w), series.days(F.col("t") - F.lag("t").over(w)))
    return out.select("rec", F.round("ewm", 6).alias("ewm"), (F.round(slope, 5) + 0.0).alias("slope"))


@query("detect_events")
def detect_events(spark, sf_dir):
    return kernels.detect_events(event_panel(spark, sf_dir))


#: Inputs of the phase scores from an object's records: slope, variation and offset of a hundredth of the value, rates and shares of kinds of records around each.
PHASE_INPUTS = f"""{P}, h AS (SELECT object, t, rec, value / 100 AS v, category FROM p), f AS (SELECT *, count(*) OVER (PARTITION BY object) AS n, stddev_pop(v) OVER m * 5 AS variation, v - avg(v) OVER m AS away,
  coalesce(lag(t) OVER o, t) AS t0, coalesce(lead(t) OVER o, t) AS t1, coalesce(lag(v) OVER o, v) AS v0, coalesce(lead(v) OVER o, v) AS v1, avg(v) OVER g AS level,
  count(*) FILTER (category = 'error') OVER wk AS errors, count(*) FILTER (category = 'signup') OVER mo AS signups, avg((category = 'purchase')::INT) OVER g AS bought, avg((category = 'view')::INT) OVER m AS views, avg((category = 'click')::INT) OVER m AS clicks
  FROM h WINDOW o AS (PARTITION BY object ORDER BY t, rec), m AS (PARTITION BY object ORDER BY t, rec ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), g AS (PARTITION BY object ORDER BY t, rec ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
  wk AS (PARTITION BY object ORDER BY t RANGE BETWEEN {7 * DAY} PRECEDING AND {7 * DAY} FOLLOWING), mo AS (PARTITION BY object ORDER BY t RANGE BETWEEN {30 * DAY} PRECEDING AND {30 * DAY} FOLLOWING)),
x AS (SELECT object, t, rec, CASE WHEN n >= 3 AND t1 > t0 THEN (v1 - v0) / ((t1 - t0) / {float(DAY)}) ELSE 0 END AS slope, variation, level * 4e-4 AS drag, errors / 14.0::DOUBLE AS event_rate,
  away * 20 AS shell_residual, away AS shell_drift, bought AS evidence, signups / 10.0::DOUBLE AS upkeep_rate, 2 * views AS upkeep_regularity, greatest(0, 1 - 2 * clicks) AS upkeep_loss FROM f)"""


def phase_inputs(spark, sf_dir):
    panel = event_panel(spark, sf_dir).withColumn("value", F.col("value") / 100)
    wide, near = series.centred(15), series.centred(7)
    kind = lambda k: (F.col("category") == k).cast("int")
    offset = F.col("value") - F.avg("value").over(wide)
    known = series.central_slope(panel)
    return known.select(
        "object", "t", "rec", "slope", (F.stddev_pop("value").over(wide) * 5).alias("variation"), (F.avg("value").over(near) * 4e-4).alias("drag"), (F.sum(kind("error")).over(series.around(7 * DAY)) / 14.0).alias("event_rate"),
        (offset * 20).alias("shell_residual"), offset.alias("shell_drift"), F.avg(kind("purchase")).over(near).alias("evidence"), (F.sum(kind("signup")).over(series.around(30 * DAY)) / 10.0).alias("upkeep_rate"),
        (2 * F.avg(kind("view")).over(wide)).alias("upkeep_regularity"), F.greatest(F.lit(0.0), 1 - 2 * F.avg(kind("click")).over(wide)).alias("upkeep_loss"),
    )


@query(
    "phase_emissions",
    f"""WITH {PHASE_INPUTS}, a AS (SELECT *, greatest(0, least(1, (-slope - 0.08) / 0.6)) AS descending, least(2, drag / 3e-4) AS d, greatest(0, 1 - abs(slope) / 0.16) AS stable FROM x),
b AS (SELECT *, greatest(0, least(2, abs(shell_residual) / 25 + 0.7 * evidence + 0.4 * event_rate - 0.5 * upkeep_regularity - 0.8 * descending - 0.35 * least(d, 1.5))) AS rl,
  greatest(0, least(2.2, 0.7 * descending + 0.45 * d + 0.25 * evidence + 0.25 * upkeep_loss)) AS di, greatest(0, least(2, 0.8 * descending + 0.5 * upkeep_loss + 0.25 * d - 0.45 * evidence)) AS pa,
  greatest(0, least(1.8, 0.55 * upkeep_loss + 0.35 * d + 0.30 * descending - 0.45 * stable)) AS nw FROM a),
e AS (SELECT rec, greatest(1e-6, 0.05) AS e0, greatest(1e-6, greatest(0, least(1, (slope - 0.2) / 0.8)) * least(1.8, 0.5 + evidence)) AS e1, greatest(1e-6, least(1, 0.55 * event_rate + 0.35 * evidence + 0.10 * abs(shell_drift))) AS e2,
  greatest(1e-6, least(2, stable * greatest(0, 1 - variation / 8) * least(1.6, 0.25 + upkeep_regularity + 0.35 * (exp(2 * upkeep_rate) - 1) / (exp(2 * upkeep_rate) + 1)) * greatest(0.2, 1 - 0.8 * upkeep_loss) * 1.2)) AS e3,
  greatest(1e-6, CASE WHEN rl >= 0.8 THEN rl ELSE 0.25 * rl END) AS e4, greatest(1e-6, CASE WHEN di >= 0.9 THEN di ELSE 0.2 * di END) AS e5, greatest(1e-6, CASE WHEN pa >= 0.85 THEN pa ELSE 0.25 * pa END) AS e6, greatest(1e-6, CASE WHEN nw > 0.7 THEN nw ELSE 0.25 * nw END) AS e7 FROM b)
SELECT rec, round(e0 / (e0 + e1 + e2 + e3 + e4 + e5 + e6 + e7), 6) AS unknown, round(e1 / (e0 + e1 + e2 + e3 + e4 + e5 + e6 + e7), 6) AS raising, round(e2 / (e0 + e1 + e2 + e3 + e4 + e5 + e6 + e7), 6) AS transition, round(e3 / (e0 + e1 + e2 + e3 + e4 + e5 + e6 + e7), 6) AS operational, round(e4 / (e0 + e1 + e2 + e3 + e4 + e5 + e6 + e7), 6) AS relocation, round(e5 / (e0 + e1 + e2 + e3 + e4 + e5 + e6 + e7), 6) AS disposal, round(e6 / (e0 + e1 + e2 + e3 + e4 + e5 + e6 + e7), 6) AS decay, round(e7 / (e0 + e1 + e2 + e3 + e4 + e5 + e6 + e7), 6) AS nonoperational FROM e""",
)
def phase_emissions(spark, sf_dir):
    names = ("unknown", "raising", "transition", "operational", "relocation", "disposal", "decay", "nonoperational")
    return phases.emissions(phase_inputs(spark, sf_dir)).select("rec", *(F.round(F.get("emission", i), 6).alias(n) for i, n in enumerate(names)))


@query("viterbi_states")
def viterbi_states(spark, sf_dir):
    return phases.cheapest_path(phases.emissions(phase_inputs(spark, sf_dir)))


@query("phase_dwell")
def phase_dwell(spark, sf_dir):
    return phases.label(phase_inputs(spark, sf_dir))


@query("mission_phases")
def mission_phases(spark, sf_dir):
    return phases.mission_phases(phase_inputs(spark, sf_dir))


@query(
    "spaced_rows",
    f"""WITH RECURSIVE {P}, n AS (SELECT object, rec, t, value, row_number() OVER (PARTITION BY object ORDER BY t, rec) AS i, count(*) OVER (PARTITION BY object) AS c,
  1 + count(*) OVER (PARTITION BY object ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY - 1} FOLLOWING) AS nxt FROM p),
k AS (SELECT object, 1::BIGINT AS i FROM n WHERE i = 1 UNION ALL SELECT k.object, n.nxt FROM k JOIN n ON n.object = k.object AND n.i = k.i WHERE n.nxt <= n.c)
SELECT object, t, rec, value FROM n WHERE i = c OR (object, i) IN (SELECT (object, i) FROM k)""",
)
def spaced_rows(spark, sf_dir):
    return kernels.spaced(event_panel(spark, sf_dir).select("object", "t", "rec", "value"), DAY)


@query("assignment")
def assignment(spark, sf_dir):
    """Every 400 parts are four problems of ten rows and ten columns."""
    part = table(spark, sf_dir, "part")
    problem = F.floor(F.col("p_partkey") / 400) * 4 + F.col("p_partkey") % 4
    rows = part.select(problem.alias("problem"), (F.floor(F.col("p_partkey") / 4) % 10).alias("row"), F.floor(F.col("p_partkey") / 40).alias("col"), F.col("p_retailprice").alias("cost"))
    return kernels.assignment(rows)


@query("density_validity")
def density_validity(spark, sf_dir):
    """Over all rows of every label; quadratic by its contract, in pairs of blocks."""
    return validity.density_validity(vecs(spark, sf_dir).withColumnRenamed("vec_id", "id"), 64)


@query("metropolis_draws")
def metropolis_draws(spark, sf_dir):
    return kernels.metropolis(event_panel(spark, sf_dir))
