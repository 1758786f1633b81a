"""Queries over time-bin roll-ups; the panel is the events table, shells are bins of its value."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochal.operators import occupancy as occ, rules
from epochal.operators import quality, series
from epochal.plans.windows import P, r
from epochal.registry import query
from epochal.sources.tables import DAY, EVENT_PANEL, event_panel, table

EDGES = (0.0, 10.0, 20.0, 40.0, 80.0)
LABELS = [f"({a}, {b}]" for a, b in zip(EDGES, EDGES[1:], strict=False)]
WEEK = 7 * DAY
CUT = "CASE WHEN value IS NULL OR isnan(value) THEN 'nan' " + " ".join(f"WHEN value {'>' if n else '>='} {a} AND value <= {b} THEN '({a}, {b}]'" for n, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))) + " ELSE 'nan' END"
#: Quality control first: rows without a value, a time or with a value over 500 go; then one row an object and hour.
SHELLED = f"""p AS ({EVENT_PANEL}), ok AS (SELECT * FROM p WHERE value IS NOT NULL AND t IS NOT NULL AND value <= 500),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object, t // 3600000000 ORDER BY rec DESC) AS k FROM ok) WHERE k = 1),
s AS (SELECT object, t, value, rec, category, {CUT} AS shell, t // {WEEK} * {WEEK} AS time_bin FROM one)"""


def shelled(spark, sf_dir):
    rules = {"no_value": ~quality.finite(F.col("value")), "no_time": F.col("t").isNull(), "too_high": F.col("value") > 500}
    good = quality.reject_reasons(event_panel(spark, sf_dir), rules).where("reasons = ''").drop("reasons")
    one = quality.keep_one(good.withColumn("hour", F.floor(F.col("t") / 3_600_000_000)), ["object", "hour"], [F.desc("rec")]).drop("hour")
    return one.withColumns({"shell": occ.cut(F.col("value"), EDGES), "time_bin": occ.time_bin(WEEK)})


@query(
    "occupancy_7d",
    f"""WITH {SHELLED}, a AS (SELECT time_bin, shell, count(*) AS n_records, count(DISTINCT object) AS n_objects, max(value) - min(value) AS spread, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std, avg(value) AS centroid FROM s GROUP BY 1, 2)
SELECT time_bin, shell, n_records, n_objects, {r('spread', 'spread')}, {r('median', 'median')}, {r('std', 'std')}, {r('n_records / sum(n_records) OVER b', 'record_share')}, {r('n_objects / sum(n_objects) OVER b', 'object_share')},
 {r(f'(centroid - lag(centroid) OVER w) / ((time_bin - lag(time_bin) OVER w) / {float(DAY)})', 'drift_per_day')}, CASE WHEN lag(n_objects) OVER w IS NULL THEN 0 ELSE greatest(n_objects - lag(n_objects) OVER w, 0) END AS replenishment,
 {r(f'(time_bin - min(time_bin) OVER (PARTITION BY shell)) / {float(DAY)}', 'age_days')} FROM a WINDOW b AS (PARTITION BY time_bin), w AS (PARTITION BY shell ORDER BY time_bin)""",
)
def occupancy_7d(spark, sf_dir):
    out = occ.occupancy(shelled(spark, sf_dir), WEEK)
    digits = ("spread", "median", "std", "record_share", "object_share", "drift_per_day", "age_days")
    return out.select("time_bin", "shell", "n_records", "n_objects", F.coalesce("replenishment", F.lit(0)).alias("replenishment"), *((F.round(c, 6) + 0.0).alias(c) for c in digits))


TRANS = f"{SHELLED}, l AS (SELECT *, lag(shell) OVER w AS from_shell, value - lag(value) OVER w AS change FROM s WINDOW w AS (PARTITION BY object ORDER BY t, rec)), tr AS (SELECT object, rec, t, from_shell, shell AS to_shell, change FROM l WHERE from_shell IS NOT NULL AND from_shell <> shell)"


@query("transitions", f"WITH {TRANS} SELECT object, rec, from_shell, to_shell, {r('change', 'change')}, CASE WHEN change > 2.5 THEN 'upward' WHEN change < -2.5 THEN 'downward' WHEN change IS NULL THEN 'unknown' ELSE 'lateral' END AS direction FROM tr")
def transitions(spark, sf_dir):
    out = occ.transitions(shelled(spark, sf_dir))
    return out.select("object", "rec", "from_shell", "to_shell", (F.round("change", 6) + 0.0).alias("change"), occ.direction(F.col("change"), 2.5).alias("direction"))


@query("transition_matrix", f"WITH {TRANS}, n AS (SELECT from_shell, to_shell, count(*) AS n FROM tr GROUP BY 1, 2) SELECT from_shell, to_shell, n, round(n / sum(n) OVER (PARTITION BY from_shell), 6) AS share FROM n")
def transition_matrix(spark, sf_dir):
    out = occ.transitions(shelled(spark, sf_dir)).groupBy("from_shell", "to_shell").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from_shell")), 6))


@query("alt_time_heatmap", f"WITH {P} SELECT t // {WEEK} * {WEEK} AS time_bin, least(floor(value / 10), 20)::INT AS cell, count(*) AS n FROM p WHERE value >= 0 GROUP BY 1, 2")
def alt_time_heatmap(spark, sf_dir):
    return event_panel(spark, sf_dir).where("value >= 0").groupBy(occ.time_bin(WEEK).alias("time_bin"), F.least(F.floor(F.col("value") / 10), F.lit(20)).cast("int").alias("cell")).agg(F.count("*").alias("n"))


@query(
    "risk_density_all_bins",
    f"""WITH {SHELLED}, n AS (SELECT time_bin, shell, count(*) AS n_records FROM s GROUP BY 1, 2), g AS (SELECT DISTINCT time_bin, l.shell FROM s CROSS JOIN (SELECT unnest({LABELS!r}) AS shell) l),
j AS (SELECT g.time_bin, g.shell, coalesce(n_records, 0) AS n_records FROM g LEFT JOIN n ON n.time_bin = g.time_bin AND n.shell = g.shell)
SELECT time_bin, shell, n_records, abs(n_records - lag(n_records) OVER (PARTITION BY time_bin ORDER BY list_position({LABELS!r}, shell))) AS gradient FROM j""",
)
def risk_density_all_bins(spark, sf_dir):
    n = shelled(spark, sf_dir).groupBy("time_bin", "shell").agg(F.count("*").alias("n_records"))
    out = occ.with_empty_bins(n.where(F.col("shell") != "nan").unionByName(n.where("shell = 'nan'").select("time_bin", "shell", "n_records")), LABELS)
    w = Window.partitionBy("time_bin").orderBy(F.array_position(F.array(*map(F.lit, LABELS)), F.col("shell")))
    return out.withColumn("gradient", F.abs(F.col("n_records") - F.lag("n_records").over(w)))


SCORE = f"""{TRANS}, c AS (SELECT t // {WEEK} * {WEEK} AS time_bin, count(*) AS crossings, count(DISTINCT object) AS movers, quantile_cont(abs(change), 0.5) AS step FROM tr GROUP BY 1),
sc AS (SELECT *, 0.5 * crossings / max(crossings) OVER () + 0.3 * movers / max(movers) OVER () + 0.2 * step / max(step) OVER () AS score FROM c)"""


def crossing_scores(spark, sf_dir):
    agg = occ.transitions(shelled(spark, sf_dir)).groupBy(occ.time_bin(WEEK).alias("time_bin")).agg(F.count("*").alias("crossings"), F.count_distinct("object").alias("movers"), F.percentile(F.abs("change"), F.lit(0.5)).alias("step"))
    top = agg.agg(F.max("crossings").alias("a"), F.max("movers").alias("b"), F.max("step").alias("c"))
    return agg.join(F.broadcast(top)).withColumn("score", 0.5 * F.col("crossings") / F.col("a") + 0.3 * F.col("movers") / F.col("b") + 0.2 * F.col("step") / F.col("c")).drop("a", "b", "c")


@query("risk_crossing_score", f"WITH {SCORE} SELECT time_bin, crossings, movers, round(step, 6) AS step, round(score, 6) AS score FROM sc")
def risk_crossing_score(spark, sf_dir):
    return crossing_scores(spark, sf_dir).select("time_bin", "crossings", "movers", F.round("step", 6).alias("step"), F.round("score", 6).alias("score"))


@query("risk_severity", f"WITH {SCORE}, q AS (SELECT quantile_cont(score, 0.33) AS a, quantile_cont(score, 0.66) AS b FROM sc) SELECT time_bin, CASE WHEN score <= a THEN 'low' WHEN score <= b THEN 'medium' ELSE 'high' END AS severity FROM sc CROSS JOIN q")
def risk_severity(spark, sf_dir):
    scores = crossing_scores(spark, sf_dir)
    limits = scores.agg(F.percentile("score", F.lit(0.33)).alias("a"), F.percentile("score", F.lit(0.66)).alias("b"))
    return scores.join(F.broadcast(limits)).select("time_bin", F.when(F.col("score") <= F.col("a"), "low").when(F.col("score") <= F.col("b"), "medium").otherwise("high").alias("severity"))


@query(
    "sustainability_rollup",
    f"""WITH {SHELLED}, o AS (SELECT time_bin, object, max((category = 'error')::INT) AS failing, max((value > 80)::INT) AS high FROM s GROUP BY 1, 2)
SELECT time_bin, count(*) AS n_objects, sum(failing)::BIGINT AS n_failing, sum(high)::BIGINT AS n_high, round(avg(failing), 6) AS failing_share FROM o GROUP BY time_bin""",
)
def sustainability_rollup(spark, sf_dir):
    by_object = shelled(spark, sf_dir).groupBy("time_bin", "object").agg(F.max((F.col("category") == "error").cast("int")).alias("failing"), F.max((F.col("value") > 80).cast("int")).alias("high"))
    return by_object.groupBy("time_bin").agg(F.count("*").alias("n_objects"), F.sum("failing").alias("n_failing"), F.sum("high").alias("n_high"), F.round(F.avg("failing"), 6).alias("failing_share"))


DISPOSAL = f"""{P}, d AS (SELECT *, value - lag(value) OVER w AS step, (t - lag(t) OVER w) / {float(DAY)} AS dt FROM p WINDOW w AS (PARTITION BY object ORDER BY t, rec)),
m AS (SELECT *, avg(CASE WHEN step < 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY object ORDER BY t, rec ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS lowering, count(*) OVER (PARTITION BY object ORDER BY t, rec ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS n8 FROM d),
f AS (SELECT *, n8 >= 8 AND lowering >= 0.625 AS likely FROM m)"""


def disposal(spark, sf_dir):
    w = series.ordered()
    last8 = w.rowsBetween(-7, 0)
    step = F.col("value") - F.lag("value").over(w)
    out = event_panel(spark, sf_dir).withColumn("step", step)
    falling = F.avg(F.when(F.col("step") < 0, 1.0).otherwise(0.0)).over(last8)
    out = out.withColumns({"lowering": falling, "n8": F.count("*").over(last8)})
    return out.withColumn("likely", (F.col("n8") >= 8) & (F.col("lowering") >= 0.625))


@query("disposal_records", f"WITH {DISPOSAL} SELECT rec, round(lowering, 6) AS lowering, likely FROM f")
def disposal_records(spark, sf_dir):
    return disposal(spark, sf_dir).select("rec", F.round("lowering", 6).alias("lowering"), "likely")


SUMMARY = f"{DISPOSAL}, g AS (SELECT object, count(*) AS n, sum(likely::INT)::BIGINT AS n_likely, min(CASE WHEN likely THEN t END) AS first_likely, quantile_cont(step, 0.16) AS q16, quantile_cont(step, 0.84) AS q84, max(t) - min(t) AS span FROM f GROUP BY object)"


def disposal_summary_of(spark, sf_dir):
    return disposal(spark, sf_dir).groupBy("object").agg(
        F.count("*").alias("n"), F.sum(F.col("likely").cast("long")).alias("n_likely"), F.min(F.when(F.col("likely"), F.col("t"))).alias("first_likely"), F.percentile("step", F.lit(0.16)).alias("q16"), F.percentile("step", F.lit(0.84)).alias("q84"), (F.max("t") - F.min("t")).alias("span")
    )


@query("disposal_summary", f"WITH {SUMMARY} SELECT object, n, n_likely, first_likely, {r('q16', 'q16')}, {r('q84', 'q84')}, {r(f'span / {float(DAY)}', 'span_days')}, CASE WHEN n_likely = 0 THEN 'none' WHEN n_likely * 4 >= n THEN 'sustained' ELSE 'brief' END AS mode FROM g")
def disposal_summary(spark, sf_dir):
    mode = F.when(F.col("n_likely") == 0, "none").when(F.col("n_likely") * 4 >= F.col("n"), "sustained").otherwise("brief")
    rounds = {"q16": F.col("q16"), "q84": F.col("q84"), "span_days": series.days(F.col("span"))}
    return disposal_summary_of(spark, sf_dir).select("object", "n", "n_likely", "first_likely", *((F.round(v, 6) + 0.0).alias(k) for k, v in rounds.items()), mode.alias("mode"))


@query("onset_timeline", f"WITH {SUMMARY} SELECT first_likely // {DAY} AS day, count(DISTINCT object) AS n_objects, {r(f'avg(span / {float(DAY)})', 'mean_span')}, {r(f'quantile_cont(span / {float(DAY)}, 0.5)', 'median_span')} FROM g WHERE first_likely IS NOT NULL GROUP BY 1")
def onset_timeline(spark, sf_dir):
    days = series.days(F.col("span"))
    rows = disposal_summary_of(spark, sf_dir).where("first_likely IS NOT NULL")
    return rows.groupBy(F.floor(F.col("first_likely") / DAY).alias("day")).agg(F.count_distinct("object").alias("n_objects"), F.round(F.avg(days), 6).alias("mean_span"), F.round(F.percentile(days, F.lit(0.5)), 6).alias("median_span"))


# -- projections and filters over the driver's dimensions -----------------------------
RULES = [("a", 900.0, 930.0), ("b", 920.0, 950.0), ("c", 945.0, 975.0), ("d", 970.0, 990.0)]


@query("shell_rule_last_match", "SELECT p_partkey, CASE " + " ".join(f"WHEN p_retailprice >= {a} AND p_retailprice < {b} THEN '{n}'" for n, a, b in reversed(RULES)) + " END AS shell FROM part")
def shell_rule_last_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rules.last_match(F.col("p_retailprice"), RULES).alias("shell"))


@query("altitude_regime", "SELECT p_partkey, CASE WHEN p_retailprice <= 925 THEN 'regime_0' WHEN p_retailprice <= 950 THEN 'regime_1' WHEN p_retailprice <= 975 THEN 'regime_2' END AS regime FROM part")
def altitude_regime(spark, sf_dir):
    own = rules.regime(F.col("p_retailprice"), (("regime_0", 925), ("regime_1", 950), ("regime_2", 975)))
    return table(spark, sf_dir, "part").select("p_partkey", own.alias("regime"))


@query("nearest_reference", "WITH d AS (SELECT p_partkey, unnest([{'d': abs(p_retailprice - 910), 'n': 0}, {'d': abs(p_retailprice - 945), 'n': 1}, {'d': abs(p_retailprice - 980), 'n': 2}]) AS x FROM part) SELECT p_partkey, round(min(x).d, 6) AS distance, min(x).n::INT AS reference FROM d GROUP BY p_partkey")
def nearest_reference(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("x", rules.nearest(F.col("p_retailprice"), (910.0, 945.0, 980.0)))
    return rows.select("p_partkey", F.round("x.distance", 6).alias("distance"), "x.reference")


@query("inclination_family", "WITH i AS (SELECT p_partkey, (p_partkey % 1810) / 10.0 AS inc FROM part) SELECT p_partkey, CASE WHEN abs(inc - 53) <= 2 THEN 'inc_53.000' WHEN abs(inc - 70) <= 2 THEN 'inc_70.000' WHEN abs(inc - 97.6) <= 2 THEN 'inc_97.600' ELSE 'unmatched' END AS family FROM i")
def inclination_family(spark, sf_dir):
    inc = F.col("p_partkey") % 1810 / 10
    return table(spark, sf_dir, "part").select("p_partkey", rules.family(inc, (53.0, 70.0, 97.6), 2, "inc").alias("family"))


@query("phase_sign", "SELECT event_id, CASE WHEN regexp_matches(event_type, 'error|fail') THEN -1 WHEN regexp_matches(event_type, 'purchase|signup|buy') THEN 1 ELSE 0 END AS sign FROM events")
def phase_sign(spark, sf_dir):
    x = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", F.when(x.rlike("error|fail"), -1).when(x.rlike("purchase|signup|buy"), 1).otherwise(0).alias("sign"))


@query("date_window_filter", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def date_window_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where("ts BETWEEN TIMESTAMP_NTZ '2024-01-10 12:00:00' AND TIMESTAMP_NTZ '2024-01-12 12:00:00'").select("event_id")


@query("band_filter_open", "SELECT p_partkey FROM part WHERE p_retailprice > 940 AND p_retailprice < 960")
def band_filter_open(spark, sf_dir):
    return rules.in_band(table(spark, sf_dir, "part"), "p_retailprice", 940, 960).select("p_partkey")


@query("event_layers", "SELECT event_type AS layer, count(*) AS n, sum((value >= 80)::INT)::BIGINT AS n_confident FROM events WHERE regexp_matches(event_type, '^(click|view|error|purchase|signup)') GROUP BY 1")
def event_layers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("event_type").rlike("^(click|view|error|purchase|signup)"))
    return rows.groupBy(F.col("event_type").alias("layer")).agg(F.count("*").alias("n"), F.sum((F.col("value") >= 80).cast("long")).alias("n_confident"))


@query("compliance_horizons", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 5 YEAR, '%Y-%m-%d') AS plus_5y, strftime(o_orderdate + INTERVAL 25 YEAR, '%Y-%m-%d') AS plus_25y FROM orders")
def compliance_horizons(spark, sf_dir):
    plus = lambda years: F.date_format(F.add_months("o_orderdate", 12 * years), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", plus(5).alias("plus_5y"), plus(25).alias("plus_25y"))
