"""Queries over vectors, clusters, posteriors and densities."""

from __future__ import annotations

import math
from pyspark.sql import Window
from pyspark.sql import functions as F

from epochal.operators import density, posterior, quality, sampling, vectors
from epochal.plans.orbits import CLEAN_SQL, clean
from epochal.plans.windows import P, r
from epochal.registry import query
from epochal.sources.tables import DAY, event_panel, table

V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def vecs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


#: Every row against its cluster's mean, in five metrics.
CENTROIDS = f"{V}, m AS (SELECT label, i, avg(v[i]) AS m FROM v, range(1, 65) t(i) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1)"
LISTS = {
    "l1": "list_sum(list_transform(list_zip(v, c), lambda p: abs(p[1] - p[2])))",
    "l2": "sqrt(list_sum(list_transform(list_zip(v, c), lambda p: pow(p[1] - p[2], 2))))",
    "linf": "list_max(list_transform(list_zip(v, c), lambda p: abs(p[1] - p[2])))",
    "canberra": "list_sum(list_transform(list_zip(v, c), lambda p: CASE WHEN abs(p[1]) + abs(p[2]) > 0 THEN abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) ELSE 0 END))",
    "braycurtis": "list_sum(list_transform(list_zip(v, c), lambda p: abs(p[1] - p[2]))) / list_sum(list_transform(list_zip(v, c), lambda p: abs(p[1] + p[2])))",
}


@query("centroid_distances", f"WITH {CENTROIDS} SELECT vec_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in LISTS.items()) + " FROM v JOIN c USING (label)")
def centroid_distances(spark, sf_dir):
    rows = vecs(spark, sf_dir)
    both = rows.join(vectors.centroids(rows), "label")
    return both.select("vec_id", *(F.round(getattr(vectors, n)(F.col("v"), F.col("centroid")), 6).alias(n) for n in LISTS))


@query("medoid", f"WITH {CENTROIDS}, d AS (SELECT label, vec_id, {LISTS['l2']} AS d FROM v JOIN c USING (label)), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS k FROM d) SELECT label, vec_id, round(d, 6) AS distance FROM k WHERE k = 1")
def medoid(spark, sf_dir):
    """The row nearest to its cluster's mean."""
    rows = vecs(spark, sf_dir)
    d = rows.join(vectors.centroids(rows), "label").select("label", "vec_id", vectors.l2(F.col("v"), F.col("centroid")).alias("d"))
    return quality.keep_one(d, ["label"], [F.asc("d"), F.asc("vec_id")]).select("label", "vec_id", F.round("d", 6).alias("distance"))


@query("boundary_extremes", f"WITH {CENTROIDS}, d AS (SELECT label, vec_id, {LISTS['l2']} AS d FROM v JOIN c USING (label)), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id) AS k FROM d) SELECT label, vec_id, k FROM k WHERE k <= 3")
def boundary_extremes(spark, sf_dir):
    rows = vecs(spark, sf_dir)
    d = rows.join(vectors.centroids(rows), "label").select("label", "vec_id", vectors.l2(F.col("v"), F.col("centroid")).alias("d"))
    k = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("d"), "vec_id"))
    return d.withColumn("k", k.cast("long")).where("k <= 3").select("label", "vec_id", "k")


PAIR = f"{V}, d AS (SELECT a.vec_id AS id, a.label AS own, b.label AS other, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: pow(p[1] - p[2], 2)))) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id)"


@query(
    "silhouette",
    f"""WITH {PAIR}, m AS (SELECT id, own, other, avg(d) AS m FROM d GROUP BY ALL), s AS (SELECT id, own, max(CASE WHEN own = other THEN m END) AS a, min(CASE WHEN own <> other THEN m END) AS b FROM m GROUP BY ALL)
SELECT own AS label, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS mean, round(min((b - a) / greatest(a, b)), 6) AS low, round(max((b - a) / greatest(a, b)), 6) AS high FROM s GROUP BY own""",
)
def silhouette(spark, sf_dir):
    s = vectors.silhouette(vectors.distance_sums(vecs(spark, sf_dir)))
    return s.groupBy(F.col("own").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("mean"), F.round(F.min("silhouette"), 6).alias("low"), F.round(F.max("silhouette"), 6).alias("high"))


@query("core_distance", f"WITH {PAIR} SELECT id AS vec_id, round(pow(sum(CASE WHEN d > 0 THEN pow(1 / d, 64) ELSE 0 END) / count(*), -1 / 64.0::DOUBLE), 5) AS core FROM d WHERE own = other GROUP BY id")
def core_distance(spark, sf_dir):
    """Generalised mean of inverse distances to the row's own cluster, of the dimension's power."""
    sums = vectors.distance_sums(vecs(spark, sf_dir), power=-64.0, across=False)
    return sums.select(F.col("id").alias("vec_id"), F.round(F.pow(F.col("total") / F.col("n"), F.lit(-1 / 64)), 5).alias("core"))


@query("cluster_stats", "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction, round(avg(embedding[1]::DOUBLE), 6) AS mean_1, round(stddev_samp(embedding[1]::DOUBLE), 6) AS std_1, round(min(embedding[1]::DOUBLE), 6) AS min_1, round(max(embedding[1]::DOUBLE), 6) AS max_1 FROM embeddings GROUP BY label")
def cluster_stats(spark, sf_dir):
    rows = vecs(spark, sf_dir).select("label", F.get("v", F.lit(0)).alias("x"))
    agg = rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean_1"), F.round(F.stddev_samp("x"), 6).alias("std_1"), F.round(F.min("x"), 6).alias("min_1"), F.round(F.max("x"), 6).alias("max_1"))
    whole = agg.agg(F.sum("n").alias("all"))
    return agg.join(F.broadcast(whole)).withColumn("fraction", F.round(F.col("n") / F.col("all"), 6)).drop("all")


@query("global_reid", "WITH l AS (SELECT DISTINCT vec_id % 3 AS folder, label FROM embeddings WHERE label <> 0) SELECT folder, label, dense_rank() OVER (ORDER BY folder, label)::INT AS global_id FROM l UNION ALL SELECT DISTINCT vec_id % 3, 0, 0 FROM embeddings WHERE label = 0")
def global_reid(spark, sf_dir):
    """Dense ids of (folder, label); label 0 is noise and stays 0.  The list of labels is small."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("folder"), "label").distinct()
    ids = rows.where("label <> 0").withColumn("global_id", F.dense_rank().over(Window.orderBy("folder", "label")))
    return ids.unionByName(rows.where("label = 0").withColumn("global_id", F.lit(0)))


@query("group_summary", "SELECT vec_id % 3 AS folder, count(*) AS n, count(DISTINCT CASE WHEN label <> 0 THEN label END) AS n_clusters, sum((label = 0)::INT)::BIGINT AS n_noise, round(avg((label = 0)::INT), 6) AS noise_fraction FROM embeddings GROUP BY 1")
def group_summary(spark, sf_dir):
    noise = (F.col("label") == 0).cast("long")
    rows = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 3).alias("folder"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("label") != 0, F.col("label"))).alias("n_clusters"), F.sum(noise).alias("n_noise"), F.round(F.avg(noise), 6).alias("noise_fraction"))


@query("centroid_correlation", "SELECT a.label AS x, b.label AS y, round(corr(a.m, b.m), 6) AS r FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) a JOIN (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2")
def centroid_correlation(spark, sf_dir):
    means = vecs(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    other = means.select(F.col("label").alias("y"), "i", F.col("m").alias("n"))
    return means.join(other, "i").where("label < y").groupBy(F.col("label").alias("x"), "y").agg(F.round(F.corr("m", "n"), 6).alias("r"))


@query(
    "stratified_sample",
    """WITH h AS (SELECT vec_id, label, (vec_id % 1000003 * 7919 + 104729) % 1000003 AS h FROM embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM h) SELECT vec_id, label FROM k WHERE k <= greatest(1, ceil(n * 0.2::DOUBLE))""",
)
def stratified_sample(spark, sf_dir):
    """A fifth of each cluster, at least one row; the order is arithmetic on the id, the same on every run."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    order = (F.col("vec_id") % 1000003 * 7919 + 104729) % 1000003
    return sampling.stratified(rows.withColumn("h", order), "label", "h", "vec_id", 0.2).select("vec_id", "label")


# -- posteriors: draws are an object's values, chains are record numbers modulo four ---------
DRAWS = f"{P}, d AS (SELECT object, rec % 4 AS chain, value AS x FROM p)"


def draws(spark, sf_dir):
    return event_panel(spark, sf_dir).select("object", (F.col("rec") % 4).alias("chain"), F.col("value").alias("x"))


@query("posterior_summary", f"WITH {DRAWS} SELECT object, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_samp(x), 6) AS sd, round(quantile_cont(x, 0.05), 6) AS q05, round(quantile_cont(x, 0.95), 6) AS q95 FROM d GROUP BY object")
def posterior_summary(spark, sf_dir):
    p = lambda q: F.round(F.percentile("x", F.lit(q)), 6)
    return draws(spark, sf_dir).groupBy("object").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), p(0.5).alias("median"), F.round(F.stddev_samp("x"), 6).alias("sd"), p(0.05).alias("q05"), p(0.95).alias("q95"))


@query(
    "hdi",
    f"""WITH {DRAWS}, o AS (SELECT object, x, row_number() OVER (PARTITION BY object ORDER BY x) AS i, count(*) OVER (PARTITION BY object) AS n FROM d),
w AS (SELECT a.object, a.x AS low, b.x AS high, a.i FROM o a JOIN o b ON b.object = a.object AND b.i = a.i + floor(0.95::DOUBLE * a.n)),
k AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY high - low, i) AS k FROM w) SELECT object, round(low, 6) AS low, round(high, 6) AS high FROM k WHERE k = 1""",
)
def hdi(spark, sf_dir):
    return posterior.hdi(draws(spark, sf_dir), 0.95)


@query(
    "rhat",
    f"""WITH {DRAWS}, c AS (SELECT object, chain, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM d GROUP BY ALL)
SELECT object, round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 6) AS rhat FROM c GROUP BY object HAVING count(*) > 1""",
)
def rhat(spark, sf_dir):
    return posterior.rhat(draws(spark, sf_dir))


@query(
    "weighted_quantiles",
    f"""WITH {DRAWS}, o AS (SELECT chain, x, row_number() OVER (PARTITION BY chain ORDER BY x, object) AS k, (1 + object % 3)::DOUBLE AS w, sum(1 + object % 3) OVER (PARTITION BY chain ORDER BY x, object ROWS UNBOUNDED PRECEDING)::DOUBLE AS c, sum(1 + object % 3) OVER (PARTITION BY chain)::DOUBLE AS t FROM d)
SELECT chain, round(min(CASE WHEN (c - w / 2) / t >= 0.25 THEN x END), 6) AS q25, round(min(CASE WHEN (c - w / 2) / t >= 0.5 THEN x END), 6) AS q50, round(min(CASE WHEN (c - w / 2) / t >= 0.75 THEN x END), 6) AS q75 FROM o GROUP BY chain""",
)
def weighted_quantiles(spark, sf_dir):
    return posterior.weighted_quantiles(draws(spark, sf_dir).withColumn("w", (1 + F.col("object") % 3).cast("double")))


@query("precision_mean", f"WITH {DRAWS}, s AS (SELECT object, avg(x) AS m, var_samp(x) / count(*) AS v FROM d GROUP BY object) SELECT round(sum(m / v) / sum(1 / v), 6) AS mean, round(sqrt(1 / sum(1 / v)), 6) AS se, count(*) AS n FROM s WHERE v > 0")
def precision_mean(spark, sf_dir):
    by = draws(spark, sf_dir).groupBy("object").agg(F.avg("x").alias("m"), (F.var_samp("x") / F.count("*")).alias("v")).where("v > 0")
    return by.agg(F.round(F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v")), 6).alias("mean"), F.round(F.sqrt(1 / F.sum(1 / F.col("v"))), 6).alias("se"), F.count("*").alias("n"))


@query(
    "w1_pairs",
    f"""WITH {DRAWS},
q AS (SELECT object, unnest(range(1, 20)) AS i, unnest(quantile_cont(x, [{', '.join(str(n / 20) for n in range(1, 20))}])) AS q FROM d GROUP BY object)
SELECT a.object AS a, b.object AS b, round(avg(abs(a.q - b.q)), 6) AS w1 FROM q a JOIN q b ON a.i = b.i AND a.object < b.object GROUP BY 1, 2""",
)
def w1_pairs(spark, sf_dir):
    return posterior.wasserstein(draws(spark, sf_dir))


# -- densities ---------------------------------------------------------------------------
@query("hist2d", f"WITH {CLEAN_SQL} SELECT floor(raan / 20)::INT AS i, floor(aop / 20)::INT AS j, count(*) AS n, round(count(*) / sum(count(*)) OVER () / 400.0, 10) AS density FROM clean GROUP BY 1, 2")
def hist2d(spark, sf_dir):
    return density.hist2d(clean(spark, sf_dir), "raan", "aop", 20.0).withColumn("density", F.round("density", 10))


@query(
    "torus_kde",
    f"""WITH {CLEAN_SQL}, h AS (SELECT floor(raan / 20) * 20 + 10 AS x, floor(aop / 20) * 20 + 10 AS y, count(*) AS n FROM clean GROUP BY 1, 2), g AS (SELECT a.i * 30 AS gx, b.i * 30 AS gy FROM range(12) a(i), range(12) b(i))
SELECT gx::DOUBLE AS gx, gy::DOUBLE AS gy, round(sum(n * exp(25 * (cos(radians(gx - x)) - 1) + 25 * (cos(radians(gy - y)) - 1))), 4) AS weight FROM g CROSS JOIN h GROUP BY 1, 2""",
)
def torus_kde(spark, sf_dir):
    return density.torus_kde(clean(spark, sf_dir), "raan", "aop", cell=20.0, points=12, kappa=25.0)


@query(
    "density_metrics",
    f"""WITH {CLEAN_SQL}, h AS (SELECT floor(raan / 20)::INT AS i, floor(aop / 20)::INT AS j, count(*)::DOUBLE AS n FROM clean GROUP BY 1, 2), p AS (SELECT n / sum(n) OVER () AS p, n FROM h)
SELECT count(*) AS n_cells, round(-sum(p * ln(p)), 6) AS entropy, round(sum(p * ln(p * 324)), 6) AS kl_uniform, round(max(n) / quantile_cont(n, 0.5), 6) AS peak_to_median FROM p""",
)
def density_metrics(spark, sf_dir):
    h = density.hist2d(clean(spark, sf_dir), "raan", "aop", 20.0)
    return density.metrics(h, cells=18 * 18)


@query("circular_stats", f"WITH {CLEAN_SQL}, a AS (SELECT object, avg(sin(radians(raan))) AS s, avg(cos(radians(raan))) AS c FROM clean GROUP BY object) SELECT object, round(sqrt(s * s + c * c), 6) AS resultant, round(((degrees(atan2(s, c)) % 360) + 360) % 360, 4) AS mean_deg FROM a")
def circular_stats(spark, sf_dir):
    from epochal.functions import angles

    return clean(spark, sf_dir).groupBy("object").agg(F.round(angles.resultant(F.col("raan")), 6).alias("resultant"), F.round(angles.circular_mean(F.col("raan")), 4).alias("mean_deg"))


@query(
    "gap_uniformity",
    f"""WITH {CLEAN_SQL}, o AS (SELECT object, raan, lead(raan) OVER (PARTITION BY object ORDER BY raan, rec) AS nxt, min(raan) OVER (PARTITION BY object) AS first, count(*) OVER (PARTITION BY object) AS n FROM clean), g AS (SELECT object, n, coalesce(nxt, first + 360) - raan AS gap FROM o)
SELECT object, count(*) AS n, round(avg(pow((gap - 360.0 / n) / (360.0 / n), 2)), 5) AS loss FROM g GROUP BY object""",
)
def gap_uniformity(spark, sf_dir):
    """Squared relative deviation of sorted circular gaps from even ones."""
    w, all_rows = Window.partitionBy("object").orderBy("raan", "rec"), Window.partitionBy("object")
    rows = clean(spark, sf_dir).withColumns({"gap": F.coalesce(F.lead("raan").over(w), F.min("raan").over(all_rows) + 360.0) - F.col("raan"), "even": 360.0 / F.count("*").over(all_rows)})
    return rows.groupBy("object").agg(F.count("*").alias("n"), F.round(F.avg(F.pow((F.col("gap") - F.col("even")) / F.col("even"), 2)), 5).alias("loss"))


@query("torus_lattice_slots", f"SELECT p.i::INT AS plane, s.i::INT AS slot, round(p.i * 360.0::DOUBLE / 12, 6) AS node_deg, round((s.i * 360.0::DOUBLE / 10 + p.i * 360.0::DOUBLE * 3 / 120) % 360, 6) AS phase_deg FROM range(12) p(i) CROSS JOIN range(10) s(i)")
def torus_lattice_slots(spark, sf_dir):
    """Slots of a Walker-like lattice: 12 planes of 10, phasing 3."""
    slots = spark.range(120).select(F.floor(F.col("id") / 10).cast("int").alias("plane"), (F.col("id") % 10).cast("int").alias("slot"))
    node = F.col("plane") * 360.0 / 12
    phase = F.pmod(F.col("slot") * 360.0 / 10 + F.col("plane") * 360.0 * 3 / 120, F.lit(360.0))
    return slots.select("plane", "slot", F.round(node, 6).alias("node_deg"), F.round(phase, 6).alias("phase_deg"))


@query("fit_metrics_by_phase", "SELECT o_orderpriority AS phase, count(*) AS n, round(sqrt(avg(pow(o_totalprice - 150000, 2))), 3) AS rmse, round(avg(abs(o_totalprice - 150000)), 3) AS mae FROM orders GROUP BY 1")
def fit_metrics_by_phase(spark, sf_dir):
    e = F.col("o_totalprice") - 150000
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("phase")).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"), F.round(F.avg(F.abs(e)), 3).alias("mae"))


@query("joint_target_stats", "WITH t AS (SELECT * FROM (VALUES (0, 10.0, 920.0), (1, 25.0, 950.0), (2, 40.0, 980.0)) v(k, a, b)), d AS (SELECT p_partkey, p_retailprice, k, sqrt(pow((p_size - a) / 8, 2) + pow((p_retailprice - b) / 20, 2)) AS d FROM part CROSS JOIN t), b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, k) AS r FROM d) SELECT k AS target, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(quantile_cont(p_retailprice, 0.5), 6) AS median FROM b WHERE r = 1 AND d <= sqrt(2) GROUP BY k")
def joint_target_stats(spark, sf_dir):
    """Nearest of a short list of (size, price) targets, within the joint tolerance."""
    each = [F.struct(F.sqrt(F.pow((F.col("p_size") - a) / 8, 2) + F.pow((F.col("p_retailprice") - b) / 20, 2)).alias("d"), F.lit(k).alias("k")) for k, (a, b) in enumerate(((10.0, 920.0), (25.0, 950.0), (40.0, 980.0)))]
    rows = table(spark, sf_dir, "part").withColumn("x", F.least(*each)).where(F.col("x.d") <= math.sqrt(2))
    return rows.groupBy(F.col("x.k").alias("target")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"), F.round(F.percentile("p_retailprice", F.lit(0.5)), 6).alias("median"))
