"""Queries over robust cleaning, robust lines and diagnostics of draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import robust
from epochal.plans.evidence import ELEMENTS, elements
from epochal.plans.windows import OVER, P
from epochal.registry import query
from epochal.sources.tables import event_panel


def turning(spark, sf_dir):
    """The panel with both angles on the circle."""
    panel = elements(spark, sf_dir)
    return panel.withColumns({"raan": F.pmod(F.col("raan") * 10, F.lit(360.0)), "mean_anomaly": F.pmod(F.col("mean_motion") * 1000, F.lit(360.0))})


TURN = lambda c: f"CASE WHEN abs({c} - lag({c}) OVER o) > 180 THEN -360.0 * floor(({c} - lag({c}) OVER o + 180) / 360) ELSE 0 END"


@query(
    "clean_elements",
    f"""WITH {ELEMENTS}, a AS (SELECT object, t, rec, sma, (raan * 10) % 360 AS raan, (mean_motion * 1000) % 360 AS ma FROM el),
k AS (SELECT *, {TURN('raan')} AS k1, {TURN('ma')} AS k2, row_number() OVER o AS i, count(*) OVER (PARTITION BY object) AS n FROM a WINDOW o AS ({OVER})),
u AS (SELECT *, raan + sum(k1) OVER w AS u1, ma + sum(k2) OVER w AS u2 FROM k WINDOW w AS ({OVER} ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, quantile_cont(sma, 0.5) OVER w AS m, quantile_cont(u1, 0.5) OVER w AS m1, quantile_cont(u2, 0.5) OVER w AS m2 FROM u WINDOW w AS ({OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
c AS (SELECT object, median(sma - m) AS c FROM m GROUP BY 1), d AS (SELECT object, any_value(c) AS c, median(abs(sma - m - c)) AS mad FROM m JOIN c USING (object) GROUP BY 1),
f AS (SELECT m.*, mad > 1e-12 AND 0.6745 * abs(sma - m - c) / mad > 4 AS outlier FROM m JOIN d USING (object) WHERE n <= 4 OR (i > 2 AND i <= n - 2))
SELECT object, t, outlier, round(CASE WHEN outlier THEN m ELSE sma END, 6) AS sma_clean, round(CASE WHEN outlier THEN m1 + 180 - 360 * floor((m1 + 180) / 360) - 180 ELSE raan END, 6) + 0.0 AS raan_clean,
  round(CASE WHEN outlier THEN m2 + 180 - 360 * floor((m2 + 180) / 360) - 180 ELSE ma END, 6) + 0.0 AS mean_anomaly_clean FROM f""",
)
def clean_elements(spark, sf_dir):
    out = robust.clean_elements(turning(spark, sf_dir), limit=4.0, trim=2)
    return out.select("object", "t", "outlier", *((F.round(f"{c}_clean", 6) + 0.0).alias(f"{c}_clean") for c in ("sma", "raan", "mean_anomaly")))


@query(
    "rolling_mad_scale",
    f"""WITH {P}, l AS (SELECT *, list(value) OVER (PARTITION BY object ORDER BY t, rec ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS v FROM p),
s AS (SELECT object, t, rec, CASE WHEN len(v) >= 3 THEN 1.4826 * list_median(list_transform(v, lambda x: abs(x - list_median(v)))) END AS s FROM l),
f AS (SELECT object, rec, coalesce(first_value(s IGNORE NULLS) OVER (PARTITION BY object ORDER BY t, rec ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(s IGNORE NULLS) OVER (PARTITION BY object ORDER BY t, rec ROWS UNBOUNDED PRECEDING)) AS s FROM s)
SELECT rec, round(CASE WHEN s > 1e-9 THEN s ELSE greatest(coalesce(median(s) OVER (PARTITION BY object), 1), 1e-6) END, 6) AS scale FROM f""",
)
def rolling_mad_scale(spark, sf_dir):
    return robust.rolling_mad(event_panel(spark, sf_dir)).select("rec", F.round("scale", 6).alias("scale"))


@query("huber_lines")
def huber_lines(spark, sf_dir):
    return robust.huber_lines(event_panel(spark, sf_dir))


@query("huber_residuals")
def huber_residuals(spark, sf_dir):
    return robust.huber_residuals(event_panel(spark, sf_dir)).select("rec", "residual")


@query("secular_rates")
def secular_rates(spark, sf_dir):
    return robust.secular_rates(turning(spark, sf_dir), "raan")
