"""Queries over window operators; the panel is the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochal.operators import quality, series
from epochal.registry import query
from epochal.sources.tables import DAY, EVENT_PANEL, HOUR, event_panel, table

P = f"p AS ({EVENT_PANEL})"
OVER = "PARTITION BY object ORDER BY t, rec"
D = float(DAY)


def rounded(df, *columns, keep=("rec",), digits=6):
    return df.select(*keep, *((F.round(c, digits) + 0.0).alias(c) for c in columns))


def r(expr, name, digits=6):
    return f"round({expr}, {digits}) + 0.0 AS {name}"


@query("time_deltas", f"WITH {P}, d AS (SELECT rec, (t - lag(t) OVER w) / {D} AS dt, value - lag(value) OVER w AS d1, object, t FROM p WINDOW w AS ({OVER})) SELECT rec, {r('dt', 'dt_days', 9)}, {r('d1', 'd1')}, {r(f'd1 - lag(d1) OVER ({OVER})', 'd2')} FROM d")
def time_deltas(spark, sf_dir):
    out = series.differences(event_panel(spark, sf_dir))
    return out.select("rec", (F.round("dt_days", 9) + 0.0).alias("dt_days"), (F.round("d1", 6) + 0.0).alias("d1"), (F.round("d2", 6) + 0.0).alias("d2"))


@query(
    "irregular_derivative",
    f"""WITH {P}, d AS (SELECT *, CASE WHEN t <> lag(t) OVER w THEN (value - lag(value) OVER w) / ((t - lag(t) OVER w) / {D}) END AS q, row_number() OVER w AS n FROM p WINDOW w AS ({OVER}))
SELECT rec, {r(f'CASE WHEN n = 1 THEN lead(q) OVER ({OVER}) ELSE q END', 'rate')} FROM d""",
)
def irregular_derivative(spark, sf_dir):
    return rounded(series.derivative(event_panel(spark, sf_dir)), "rate")


@query(
    "central_slope",
    f"""WITH {P}, d AS (SELECT *, coalesce(lag(t) OVER w, t) AS a, coalesce(lead(t) OVER w, t) AS b, coalesce(lag(value) OVER w, value) AS x, coalesce(lead(value) OVER w, value) AS y, count(*) OVER (PARTITION BY object) AS n FROM p WINDOW w AS ({OVER}))
SELECT rec, {r(f'CASE WHEN n >= 3 AND b > a THEN (y - x) / ((b - a) / {D}) END', 'slope')} FROM d""",
)
def central_slope(spark, sf_dir):
    return rounded(series.central_slope(event_panel(spark, sf_dir)), "slope")


@query("rolling_median_centered", f"WITH {P} SELECT rec, CASE WHEN count(value) OVER w >= 3 THEN {r('quantile_cont(value, 0.5) OVER w', 'x')[:-5]} END AS median FROM p WINDOW w AS ({OVER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def rolling_median_centered(spark, sf_dir):
    return rounded(series.rolling_median(event_panel(spark, sf_dir), 7, least=3), "median")


@query("rolling_mean_trend", f"WITH {P} SELECT rec, {r('CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END', 'trend')} FROM p WINDOW w AS ({OVER} ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)")
def rolling_mean_trend(spark, sf_dir):
    w = series.centred(8)
    out = event_panel(spark, sf_dir).withColumn("trend", F.when(F.count("value").over(w) >= 3, F.avg("value").over(w)))
    return rounded(out, "trend")


@query(
    "rolling_q10_q90_30d",
    f"WITH {P}, q AS (SELECT rec, count(value) OVER w AS n, quantile_cont(value, 0.1) OVER w AS a, quantile_cont(value, 0.5) OVER w AS b, quantile_cont(value, 0.9) OVER w AS c FROM p WINDOW w AS (PARTITION BY object ORDER BY t RANGE BETWEEN {30 * DAY - 1} PRECEDING AND CURRENT ROW)) SELECT rec, CASE WHEN n >= 3 THEN round(a, 6) END AS q10, CASE WHEN n >= 3 THEN round(b, 6) END AS q50, CASE WHEN n >= 3 THEN round(c, 6) END AS q90 FROM q",
)
def rolling_q10_q90_30d(spark, sf_dir):
    return rounded(series.rolling_quantiles(event_panel(spark, sf_dir), 30 * DAY), "q10", "q50", "q90")


@query(
    "prominence_proxy",
    f"""WITH {P}, q AS (SELECT *, abs(value - quantile_cont(value, 0.5) OVER ({OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS p, lag(value) OVER ({OVER}) AS a, lead(value) OVER ({OVER}) AS b FROM p)
SELECT rec, {r('p', 'prominence')}, coalesce(((value >= a AND value >= b) OR (value <= a AND value <= b)) AND p >= 20, false) AS peak FROM q""",
)
def prominence_proxy(spark, sf_dir):
    out = series.peaks(event_panel(spark, sf_dir), least=20.0)
    return out.select("rec", (F.round("prominence", 6) + 0.0).alias("prominence"), "peak")


@query(
    "filtered_difference_linear",
    f"""WITH {P}, x AS (SELECT *, (t - min(t) OVER (PARTITION BY object)) / {D} AS x FROM p),
f AS (SELECT rec, x, count(value) OVER b AS nb, count(value) OVER a AS na, regr_intercept(value, x) OVER b + regr_slope(value, x) OVER b * x AS yb, regr_intercept(value, x) OVER a + regr_slope(value, x) OVER a * x AS ya
  FROM x WINDOW b AS ({OVER} ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING), a AS ({OVER} ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING))
SELECT rec, CASE WHEN na = 9 AND nb = 9 THEN round(ya - yb, 5) + 0.0 END AS jump FROM f""",
)
def filtered_difference_linear(spark, sf_dir):
    return rounded(series.adjacent_line_difference(event_panel(spark, sf_dir)), "jump", digits=5)


@query("anomaly_guard", f"WITH {P}, d AS (SELECT rec, object, t, abs(value - lag(value) OVER w) / 40.0 > 1 AS big FROM p WINDOW w AS ({OVER})) SELECT rec, coalesce(big, false) AND NOT coalesce(lag(big) OVER ({OVER}), false) AND NOT coalesce(lead(big) OVER ({OVER}), false) AS isolated FROM d")
def anomaly_guard(spark, sf_dir):
    w = series.ordered()
    out = event_panel(spark, sf_dir).withColumn("big", F.abs(F.col("value") - F.lag("value").over(w)) / 40.0 > 1)
    false = F.lit(False)
    isolated = F.coalesce("big", false) & ~F.coalesce(F.lag("big").over(w), false) & ~F.coalesce(F.lead("big").over(w), false)
    return out.select("rec", isolated.alias("isolated"))


@query(
    "cadence_diagnostics",
    f"""WITH {P}, s AS (SELECT object, (t - lag(t) OVER ({OVER})) / 3.6e9 AS dt FROM p), k AS (SELECT * FROM s WHERE dt IS NOT NULL),
m AS (SELECT object, quantile_cont(dt, 0.5) AS m FROM k GROUP BY object)
SELECT object, count(*) AS n_steps, {r('first(m)', 'median_h')}, {r('quantile_cont(abs(dt - m), 0.5)', 'mad_h')}, {r('max(dt)', 'max_h')}, {r('quantile_cont(dt, 0.95)', 'p95_h')}, {r('stddev_pop(dt) / first(m)', 'cv')}, sum((dt > 3 * m)::INT)::BIGINT AS n_gaps FROM k JOIN m USING (object) GROUP BY object""",
)
def cadence_diagnostics(spark, sf_dir):
    return rounded(series.cadence(event_panel(spark, sf_dir)), "median_h", "mad_h", "max_h", "p95_h", "cv", keep=("object", "n_steps", "n_gaps"))


@query(
    "robust_zscore",
    f"""WITH {P}, m AS (SELECT object, quantile_cont(value, 0.5) AS m FROM p GROUP BY object), d AS (SELECT object, quantile_cont(abs(value - m), 0.5) AS d FROM p JOIN m USING (object) GROUP BY object)
SELECT rec, {r('CASE WHEN d > 0 THEN 0.6745 * (value - m) / d END', 'z')} FROM p JOIN m USING (object) JOIN d USING (object)""",
)
def robust_zscore(spark, sf_dir):
    return rounded(series.robust_z(event_panel(spark, sf_dir)), "z")


@query(
    "describe_stats",
    "SELECT event_type, count(*) AS n, count(value) AS n_valid, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(skewness(value), 4) AS skew, round(kurtosis(value), 4) AS kurt FROM events GROUP BY event_type",
)
def describe_stats(spark, sf_dir):
    n, x = F.count("value").cast("double"), F.col("value")
    p = lambda q: F.percentile("value", F.lit(q))
    # sample-corrected moments from the population ones
    skew = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3))
    named = {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "p1": p(0.01), "p25": p(0.25), "p50": p(0.5), "p75": p(0.75), "p99": p(0.99), "iqr": p(0.75) - p(0.25)}
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("value").alias("n_valid"), *(F.round(v, 6).alias(k) for k, v in named.items()), F.round(skew, 4).alias("skew"), F.round(kurt, 4).alias("kurt")
    )


@query("trend_slope", f"WITH {P}, x AS (SELECT *, (t - min(t) OVER (PARTITION BY object)) / {D} AS x FROM p) SELECT object, count(*) AS n, {r('regr_slope(value, x)', 'slope_per_day')} FROM x GROUP BY object")
def trend_slope(spark, sf_dir):
    panel = event_panel(spark, sf_dir)
    first = panel.groupBy("object").agg(F.min("t").alias("t0"))
    x = panel.join(first, "object").withColumn("x", series.days(F.col("t") - F.col("t0")))
    return x.groupBy("object").agg(F.count("*").alias("n"), (F.round(F.regr_slope("value", "x"), 6) + 0.0).alias("slope_per_day"))


@query("dedup_keep_last", f"WITH {P}, h AS (SELECT *, t // {HOUR} AS h, row_number() OVER (PARTITION BY object, t // {HOUR} ORDER BY rec DESC) AS n FROM p) SELECT object, h, rec FROM h WHERE n = 1")
def dedup_keep_last(spark, sf_dir):
    panel = event_panel(spark, sf_dir).withColumn("h", F.floor(F.col("t") / HOUR))
    return quality.keep_one(panel, ["object", "h"], [F.desc("rec")]).select("object", "h", "rec")


@query("dedup_keep_first", "SELECT l_suppkey, l_shipdate::DATE::VARCHAR AS day, min(l_orderkey * 10 + l_linenumber) AS rec FROM lineitem GROUP BY ALL")
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec"))
    return quality.keep_one(rows, ["l_suppkey", "day"], [F.asc("rec")])


STATE = "CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END"


def states(panel):
    return panel.withColumn("state", F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "mid").otherwise("high"))


@query(
    "phase_rle_intervals",
    f"""WITH {P}, s AS (SELECT *, {STATE} AS state FROM p), c AS (SELECT *, CASE WHEN state = lag(state) OVER ({OVER}) THEN 0 ELSE 1 END AS c FROM s),
g AS (SELECT *, sum(c) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT object, run::BIGINT AS run, first(state) AS state, min(t) AS t_start, max(t) AS t_end, count(*) AS n_records, {r(f'(max(t) - min(t)) / {float(HOUR)}', 'duration_h')}, {r('avg(value)', 'mean_value')}, {r('quantile_cont(value, 0.5)', 'median_value')} FROM g GROUP BY object, run""",
)
def phase_rle_intervals(spark, sf_dir):
    out = series.runs(states(event_panel(spark, sf_dir)), F.col("state"))
    out = out.groupBy("object", "run").agg(
        F.first("state").alias("state"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n_records"), ((F.max("t") - F.min("t")) / float(HOUR)).alias("duration_h"), F.avg("value").alias("mean_value"), F.percentile("value", F.lit(0.5)).alias("median_value")
    )
    return rounded(out, "duration_h", "mean_value", "median_value", keep=("object", "run", "state", "t_start", "t_end", "n_records"))


@query(
    "bridge_gaps",
    f"""WITH {P}, s AS (SELECT *, value < 60 AS m FROM p), c AS (SELECT *, CASE WHEN m = lag(m) OVER ({OVER}) THEN 0 ELSE 1 END AS c FROM s),
g AS (SELECT *, sum(c) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS run FROM c),
k AS (SELECT *, count(*) OVER (PARTITION BY object, run) AS n, max(run) OVER (PARTITION BY object) AS last FROM g)
SELECT rec, m OR (run > 1 AND run < last AND n <= 2) AS mask FROM k""",
)
def bridge_gaps(spark, sf_dir):
    return series.bridged(event_panel(spark, sf_dir), F.col("value") < 60, 2).select("rec", "mask")


@query(
    "negative_slope_runs",
    f"""WITH {P}, d AS (SELECT *, value < lag(value) OVER ({OVER}) AS falls FROM p), e AS (SELECT *, coalesce(falls, false) AS f FROM d),
c AS (SELECT *, CASE WHEN f = lag(f) OVER ({OVER}) THEN 0 ELSE 1 END AS c FROM e), g AS (SELECT *, sum(c) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT object, min(t) AS t_start, max(t) AS t_end, count(*) AS n_points, {r('min(value)', 'lowest')} FROM g WHERE f GROUP BY object, run HAVING count(*) >= 3""",
)
def negative_slope_runs(spark, sf_dir):
    falls = F.coalesce(F.col("value") < F.lag("value").over(series.ordered()), F.lit(False))
    out = series.runs(event_panel(spark, sf_dir).withColumn("f", falls), F.col("f")).where("f")
    out = out.groupBy("object", "run").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n_points"), F.min("value").alias("lowest")).where("n_points >= 3")
    return rounded(out, "lowest", keep=("object", "t_start", "t_end", "n_points"))


@query(
    "mask_segments",
    f"""WITH {P}, m AS (SELECT *, max((value >= 80)::INT) OVER ({OVER} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS m FROM p),
c AS (SELECT *, CASE WHEN m = lag(m) OVER ({OVER}) THEN 0 ELSE 1 END AS c FROM m), g AS (SELECT *, sum(c) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT object, min(rec) AS first_rec, count(*) AS n, {r('max(value)', 'top')} FROM g WHERE m GROUP BY object, run""",
)
def mask_segments(spark, sf_dir):
    wide = F.max((F.col("value") >= 80).cast("int")).over(series.ordered().rowsBetween(-1, 1)) == 1
    out = series.runs(event_panel(spark, sf_dir).withColumn("m", wide), F.col("m")).where("m")
    out = out.groupBy("object", "run").agg(F.min("rec").alias("first_rec"), F.count("*").alias("n"), F.max("value").alias("top"))
    return rounded(out, "top", keep=("object", "first_rec", "n"))


@query("acceptance_rolling", f"WITH {P} SELECT rec, {r('avg((value >= 50)::INT) OVER e', 'expanding')}, CASE WHEN count(*) OVER w >= 10 THEN round(avg((value >= 50)::INT) OVER w, 6) END AS rolling_25 FROM p WINDOW e AS ({OVER} ROWS UNBOUNDED PRECEDING), w AS ({OVER} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)")
def acceptance_rolling(spark, sf_dir):
    hit = (F.col("value") >= 50).cast("int")
    every, last = series.ordered().rowsBetween(Window.unboundedPreceding, 0), series.ordered().rowsBetween(-24, 0)
    out = event_panel(spark, sf_dir).withColumns({"expanding": F.avg(hit).over(every), "rolling_25": F.when(F.count("*").over(last) >= 10, F.avg(hit).over(last))})
    return rounded(out, "expanding", "rolling_25")


@query("event_rate_14d", f"WITH {P} SELECT rec, round(count(*) OVER w / 14.0, 6) AS rate_per_day, {r('avg(value) OVER e', 'evidence_4d')} FROM p WINDOW w AS (PARTITION BY object ORDER BY t RANGE BETWEEN {7 * DAY} PRECEDING AND {7 * DAY} FOLLOWING), e AS (PARTITION BY object ORDER BY t RANGE BETWEEN {2 * DAY} PRECEDING AND {2 * DAY} FOLLOWING)")
def event_rate_14d(spark, sf_dir):
    out = event_panel(spark, sf_dir).withColumns({"rate_per_day": F.count("*").over(series.around(7 * DAY)) / 14.0, "evidence_4d": F.avg("value").over(series.around(2 * DAY))})
    return rounded(out, "rate_per_day", "evidence_4d")


@query(
    "maintenance_features",
    f"""WITH {P}, g AS (SELECT *, (t - lag(t) OVER ({OVER})) / {D} AS gap FROM p)
SELECT rec, round(count(*) OVER a / 45.0, 6) AS rate_45d, count(*) OVER b AS n_120d, {r('CASE WHEN count(gap) OVER b >= 2 THEN stddev_pop(gap) OVER b / avg(gap) OVER b END', 'gap_cv')} FROM g
WINDOW a AS (PARTITION BY object ORDER BY t RANGE BETWEEN {45 * DAY - 1} PRECEDING AND CURRENT ROW), b AS (PARTITION BY object ORDER BY t RANGE BETWEEN {120 * DAY - 1} PRECEDING AND CURRENT ROW)""",
)
def maintenance_features(spark, sf_dir):
    panel = event_panel(spark, sf_dir).withColumn("gap", series.days(F.col("t") - F.lag("t").over(series.ordered())))
    a, b = series.trailing(45 * DAY), series.trailing(120 * DAY)
    cv = F.when(F.count("gap").over(b) >= 2, F.stddev_pop("gap").over(b) / F.avg("gap").over(b))
    out = panel.withColumns({"rate_45d": F.count("*").over(a) / 45.0, "n_120d": F.count("*").over(b), "gap_cv": cv})
    return rounded(out, "rate_45d", "gap_cv", keep=("rec", "n_120d"))


# -- daily series of orders ---------------------------------------------------------
DAILY = f"daily AS (SELECT epoch_us(o_orderdate) // {DAY} AS d, sum(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1)"


def daily(spark, sf_dir):
    from epochal.sources.tables import micros

    return table(spark, sf_dir, "orders").groupBy(F.floor(micros("o_orderdate") / DAY).alias("d")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))


def calendar(rows, step=1):
    """Every day between the first and the last: the calendar is as long as the series, not as the data."""
    ends = rows.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("d"))


@query(
    "calendar_gapfill",
    f"""WITH {DAILY}, c AS (SELECT unnest(generate_series((SELECT min(d) FROM daily), (SELECT max(d) FROM daily))) AS d),
j AS (SELECT c.d, v, n FROM c LEFT JOIN daily USING (d)),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS v0, last_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS d0,
  first_value(v IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1, first_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d1 FROM j)
SELECT d, coalesce(n, 0) AS n, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (d - d0) / (d1 - d0) END, 4) AS v FROM f""",
)
def calendar_gapfill(spark, sf_dir):
    rows = daily(spark, sf_dir)
    # a calendar has a row a day: one task orders it, whatever the size of the data
    w = Window.orderBy("d")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("v").isNotNull(), F.col("d"))
    out = calendar(rows).join(rows, "d", "left").withColumns(
        {"v0": F.last("v", True).over(back), "d0": F.last(known, True).over(back), "v1": F.last("v", True).over(ahead), "d1": F.last(known, True).over(ahead)}
    )
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("d") - F.col("d0")) / (F.col("d1") - F.col("d0"))
    v = F.coalesce("v", F.when(F.col("v0").isNull(), F.col("v1")).when(F.col("v1").isNull(), F.col("v0")).otherwise(line))
    return out.select("d", F.coalesce("n", F.lit(0)).alias("n"), F.round(v, 4).alias("v"))


@query("centered_81d_mean", f"WITH {DAILY} SELECT d, CASE WHEN count(v) OVER w >= 40 THEN round(avg(v) OVER w, 6) END AS mean_81d, round(sin(2 * pi() * d / 4015.0), 6) AS harmonic_sin, round(cos(2 * pi() * d / 4015.0), 6) AS harmonic_cos FROM daily WINDOW w AS (ORDER BY d RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING)")
def centered_81d_mean(spark, sf_dir):
    import math

    w = Window.orderBy("d").rangeBetween(-40, 40)
    turn = F.col("d") * (2 * math.pi) / 4015.0
    return daily(spark, sf_dir).select("d", F.when(F.count("v").over(w) >= 40, F.round(F.avg("v").over(w), 6)).alias("mean_81d"), F.round(F.sin(turn), 6).alias("harmonic_sin"), F.round(F.cos(turn), 6).alias("harmonic_cos"))


@query("history_lags", f"WITH {DAILY} SELECT d, round(lag(v) OVER w, 4) AS lag_1, round(lag(v, 2) OVER w, 4) AS lag_2, round(avg(v) OVER (ORDER BY d ROWS BETWEEN 10 PRECEDING AND 3 PRECEDING), 6) AS mean_3_10 FROM daily WINDOW w AS (ORDER BY d)")
def history_lags(spark, sf_dir):
    w = Window.orderBy("d")
    return daily(spark, sf_dir).select("d", F.round(F.lag("v").over(w), 4).alias("lag_1"), F.round(F.lag("v", 2).over(w), 4).alias("lag_2"), F.round(F.avg("v").over(w.rowsBetween(-10, -3)), 6).alias("mean_3_10"))


@query(
    "forecast_errors",
    f"""WITH {DAILY}, f AS (SELECT d, v, lag(v) OVER (ORDER BY d) AS p FROM daily)
SELECT count(*) AS n, round(avg(abs(v - p)), 3) AS mae, round(sqrt(avg((v - p) * (v - p))), 3) AS rmse, round(avg(CASE WHEN v <> 0 THEN abs((v - p) / v) END) * 100, 4) AS mape FROM f WHERE p IS NOT NULL""",
)
def forecast_errors(spark, sf_dir):
    """Persistence forecast: yesterday's value."""
    e = F.col("v") - F.col("p")
    rows = daily(spark, sf_dir).withColumn("p", F.lag("v").over(Window.orderBy("d"))).where("p IS NOT NULL")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 3).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"), F.round(F.avg(F.when(F.col("v") != 0, F.abs(e / F.col("v")))) * 100, 4).alias("mape"))


@query("sliding_windows", f"WITH {DAILY}, o AS (SELECT *, row_number() OVER (ORDER BY d) AS i FROM daily) SELECT a.i::BIGINT AS start, count(*) AS n, round(sum(b.v), 3) AS total, round(max(b.v), 3) AS top FROM o a JOIN o b ON b.i >= a.i AND b.i < a.i + 30 WHERE (a.i - 1) % 7 = 0 GROUP BY a.i")
def sliding_windows(spark, sf_dir):
    """Windows of 30 rows every 7: each row goes to the windows that hold it."""
    rows = daily(spark, sf_dir).withColumn("i", F.row_number().over(Window.orderBy("d")).cast("long"))
    first = F.greatest(F.ceil((F.col("i") - 30) / 7), F.lit(0))
    starts = F.explode(F.sequence(first.cast("long"), F.floor((F.col("i") - 1) / 7).cast("long"))).alias("k")
    return rows.select("v", starts).groupBy((F.col("k") * 7 + 1).alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("total"), F.round(F.max("v"), 3).alias("top"))

