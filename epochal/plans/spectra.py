"""Queries over peaks, grids, cross spectra and stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import density, kernels, peaks, spectra
from epochal.plans.evidence import ELEMENTS, elements
from epochal.plans.kernels import GRID
from epochal.plans.orbits import CLEAN_SQL, clean
from epochal.registry import query
from epochal.sources.tables import DAY, event_panel

SPECTRUM = f"""{GRID}, sz AS (SELECT object, count(*) AS n, avg(y) AS m FROM grid GROUP BY 1 HAVING count(*) >= 4),
wn AS (SELECT object, n, i, 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) AS h, y - m AS z FROM grid JOIN sz USING (object)),
tr AS (SELECT object, n, k, sum(h) AS gain, sum(z * h * cos(2 * pi() * k * i / n)) AS re, sum(z * h * sin(2 * pi() * k * i / n)) AS im FROM wn, range(1, 17) r(k) WHERE 2 * k <= n GROUP BY ALL),
spec AS (SELECT object, k - 1 AS bin, k / (n * 0.25::DOUBLE) AS frequency, 2 * sqrt(re * re + im * im) / gain AS amplitude FROM tr)"""


def spectrum(spark, sf_dir):
    return kernels.spectrum(event_panel(spark, sf_dir), 0.25, bins=16)


@query(
    "spectral_peaks",
    f"""WITH {SPECTRUM}, pk AS (SELECT * FROM (SELECT *, lag(amplitude) OVER w AS l, lead(amplitude) OVER w AS r FROM spec WINDOW w AS (PARTITION BY object ORDER BY bin)) WHERE amplitude > l AND amplitude > r),
hi AS (SELECT pk.object, pk.bin, any_value(pk.frequency) AS frequency, any_value(pk.amplitude) AS amplitude, max(s.bin) FILTER (s.bin < pk.bin AND s.amplitude > pk.amplitude) AS lo, min(s.bin) FILTER (s.bin > pk.bin AND s.amplitude > pk.amplitude) AS up FROM pk JOIN spec s USING (object) GROUP BY 1, 2),
pr AS (SELECT hi.object, hi.bin, any_value(hi.frequency) AS frequency, any_value(hi.amplitude) AS amplitude,
  any_value(hi.amplitude) - greatest(min(s.amplitude) FILTER (s.bin < hi.bin AND s.bin > coalesce(lo, -1)), min(s.amplitude) FILTER (s.bin > hi.bin AND s.bin < coalesce(up, 1000))) AS prominence FROM hi JOIN spec s USING (object) GROUP BY 1, 2)
SELECT object, rank::INT AS rank, bin::INT AS bin, round(frequency, 9) AS frequency, round(amplitude, 5) AS amplitude, round(prominence, 5) AS prominence FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY amplitude DESC, bin DESC) AS rank FROM pr WHERE prominence >= 1) WHERE rank <= 3""",
)
def spectral_peaks(spark, sf_dir):
    out = peaks.spectral_peaks(spectrum(spark, sf_dir), top=3, least_prominence=1.0)
    return out.select("object", "rank", "bin", F.round("frequency", 9).alias("frequency"), F.round("amplitude", 5).alias("amplitude"), F.round("prominence", 5).alias("prominence"))


@query(
    "grid_maxima",
    f"""WITH {CLEAN_SQL}, h AS (SELECT floor(raan / 20)::INT AS i, floor(aop / 20)::INT AS j, count(*) AS n FROM clean GROUP BY 1, 2)
SELECT i, j, n FROM h WHERE n >= (SELECT max(b.n) FROM h b WHERE abs(b.i - h.i) <= 1 AND abs(b.j - h.j) <= 1)""",
)
def grid_maxima(spark, sf_dir):
    return peaks.grid_maxima(density.hist2d(clean(spark, sf_dir), "raan", "aop", 20.0), "n").select("i", "j", "n")


@query("density_hotspots")
def density_hotspots(spark, sf_dir):
    return peaks.hotspots(density.hist2d(clean(spark, sf_dir), "raan", "aop", 20.0), "n", around_i=18)


@query("hotspot_persistence")
def hotspot_persistence(spark, sf_dir):
    """Hotspots of every year's grid, and how the first one moves from year to year."""
    rows = clean(spark, sf_dir).withColumn("w", F.floor(F.col("t") / (365 * DAY)))
    cells = rows.groupBy("w", F.floor(F.col("raan") / 20).cast("int").alias("i"), F.floor(F.col("aop") / 20).cast("int").alias("j")).agg(F.count("*").alias("n"))
    return peaks.persistence(peaks.hotspots(cells, "n", around_i=18, keys=("w",)), "w", 18, 2, 2)


#: Both series of an object on one grid of three days.
PAIR = f"""{ELEMENTS}, px AS (SELECT object, t, sma, inc, (t - min(t) OVER (PARTITION BY object)) / 2.592e11::DOUBLE AS x FROM el),
pn AS (SELECT *, lead(x) OVER w AS x1, lead(sma) OVER w AS s1, lead(inc) OVER w AS i1 FROM px WINDOW w AS (PARTITION BY object ORDER BY t)),
pe AS (SELECT *, unnest(generate_series(ceil(x)::BIGINT, coalesce(ceil(x1) - 1, floor(x))::BIGINT)) AS i FROM pn),
pg AS (SELECT object, i, coalesce(sma + (s1 - sma) * (i - x) / (x1 - x), sma) AS a, coalesce(inc + (i1 - inc) * (i - x) / (x1 - x), inc) AS b FROM pe)"""
COHERENCE = f"""{PAIR}, sz AS (SELECT object, max(i) + 1 AS n FROM pg GROUP BY 1 HAVING max(i) + 1 >= 8),
sg AS (SELECT object, a, b, least(64, n) AS w, i, n, unnest(generate_series(0, (n - least(64, n)) // (least(64, n) - least(64, n) // 2))) AS s FROM pg JOIN sz USING (object)),
sj AS (SELECT object, w, s, i - s * (w - w // 2) AS j, a, b FROM sg WHERE i >= s * (w - w // 2) AND i < s * (w - w // 2) + w),
sd AS (SELECT object, w, s, j, (a - avg(a) OVER v) * (0.5 - 0.5 * cos(2 * pi() * j / w)) AS a, (b - avg(b) OVER v) * (0.5 - 0.5 * cos(2 * pi() * j / w)) AS b, pow(0.5 - 0.5 * cos(2 * pi() * j / w), 2) AS h FROM sj WINDOW v AS (PARTITION BY object, s)),
st AS (SELECT object, w, s, k, sum(h) AS p, sum(a * cos(2 * pi() * k * j / w)) AS ar, -sum(a * sin(2 * pi() * k * j / w)) AS ai, sum(b * cos(2 * pi() * k * j / w)) AS br, -sum(b * sin(2 * pi() * k * j / w)) AS bi FROM sd, range(0, 33) r(k) WHERE k <= w // 2 GROUP BY ALL),
ch AS (SELECT object, k / (w * 3.0::DOUBLE) AS frequency, avg(ar * br + ai * bi) AS re, avg(ar * bi - ai * br) AS im, avg(ar * ar + ai * ai) AS xx, avg(br * br + bi * bi) AS yy, 3.0::DOUBLE / any_value(p) * CASE WHEN k = 0 OR 2 * k = w THEN 1 ELSE 2 END AS f FROM st GROUP BY object, w, k)"""


def pairs(spark, sf_dir):
    return spectra.cross_spectrum(elements(spark, sf_dir), "sma", "inc", 3.0, segment=64)


@query(
    "coherence_pairs",
    f"WITH {COHERENCE} SELECT object, round(frequency, 9) AS frequency, round(re * f, 4) + 0.0 AS csd_real, round(im * f, 4) + 0.0 AS csd_imag, round(CASE WHEN xx > 1e-300 AND yy > 1e-300 THEN least(1, (re * re + im * im) / (xx * yy)) ELSE 0 END, 6) AS coherence FROM ch",
)
def coherence_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("object", F.round("frequency", 9).alias("frequency"), *((F.round(c, 4) + 0.0).alias(c) for c in ("csd_real", "csd_imag")), F.round("coherence", 6).alias("coherence"))


@query(
    "mean_coherence",
    f"""WITH {COHERENCE}, c AS (SELECT object, round(frequency, 9) AS frequency, CASE WHEN xx > 1e-300 AND yy > 1e-300 THEN least(1, (re * re + im * im) / (xx * yy)) ELSE 0 END AS coherence FROM ch)
SELECT frequency, count(DISTINCT object) AS n_objects, round(avg(coherence), 6) AS coherence FROM c GROUP BY 1""",
)
def mean_coherence(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("frequency", F.round("frequency", 9))
    return spectra.averaged(rows, "frequency", "coherence").withColumn("coherence", F.round("coherence", 6))


LAGGED = f"""{PAIR}, sz AS (SELECT object, count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) * stddev_pop(b) AS sd FROM pg GROUP BY 1 HAVING count(*) >= 4),
c AS (SELECT object, i, a - ma AS a, b - mb AS b, n, sd FROM pg JOIN sz USING (object)),
lg AS (SELECT c.object, k AS lag, c.n, CASE WHEN any_value(c.sd) > 0 THEN sum(c.a * d.b) / any_value(c.sd * c.n) END AS r FROM c, range(-5, 6) g(k) JOIN c d ON d.object = c.object AND d.i = c.i - k GROUP BY 1, 2, 3)"""


def lagged(spark, sf_dir):
    return spectra.lag_correlations(elements(spark, sf_dir), "sma", "inc", 3.0, 5)


@query("lag_correlation_pairs", f"WITH {LAGGED} SELECT object, lag::INT AS lag, n, round(r, 6) + 0.0 AS r FROM lg")
def lag_correlation_pairs(spark, sf_dir):
    return lagged(spark, sf_dir).withColumn("r", F.round("r", 6) + 0.0)


@query(
    "mean_lag_correlation",
    f"WITH {LAGGED}, m AS (SELECT min(m) AS m FROM (SELECT max(abs(lag)) AS m FROM lg WHERE r IS NOT NULL GROUP BY object)) SELECT lag::INT AS lag, count(*) AS n_objects, round(avg(r), 6) + 0.0 AS r FROM lg, m WHERE r IS NOT NULL AND abs(lag) <= m.m GROUP BY 1",
)
def mean_lag_correlation(spark, sf_dir):
    return spectra.mean_lag_correlation(lagged(spark, sf_dir)).withColumn("r", F.round("r", 6) + 0.0)


@query(
    "stacked_spectrum",
    f"""WITH {SPECTRUM}, ow AS (SELECT object, list({{'f': frequency, 'a': amplitude}} ORDER BY frequency) AS b, max(amplitude) AS top FROM spec GROUP BY 1 HAVING count(*) > 1),
fr AS (SELECT unnest(list_transform(arg_min(b, object), lambda x: x.f)) AS frequency FROM ow),
ab AS (SELECT object, frequency, top, list_filter(b, lambda x: x.f <= frequency)[-1] AS lo, list_filter(b, lambda x: x.f >= frequency)[1] AS up FROM ow, fr),
y AS (SELECT object, frequency, CASE WHEN up.f > lo.f THEN lo.a + (up.a - lo.a) * (frequency - lo.f) / (up.f - lo.f) ELSE lo.a END / CASE WHEN top > 0 THEN top ELSE 1 END AS y FROM ab WHERE lo IS NOT NULL AND up IS NOT NULL),
u AS (SELECT object, replicate, ('0x' || substr(md5(object || ':' || replicate), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT object FROM y), range(64) g(replicate)),
cum AS (SELECT unnest([{', '.join(map(repr, spectra.DRAWN))}]::DOUBLE[]) AS share),
k AS (SELECT object, replicate, count(*) FILTER (u >= share) AS times FROM u, cum GROUP BY ALL),
md AS (SELECT frequency, replicate, quantile_cont(y, 0.5) AS m FROM (SELECT frequency, replicate, y, unnest(range(times)) AS copy FROM y JOIN k USING (object)) GROUP BY ALL),
bd AS (SELECT frequency, quantile_cont(m, 0.05) AS p05, quantile_cont(m, 0.95) AS p95 FROM md GROUP BY 1)
SELECT round(frequency, 9) AS frequency, count(*) AS n_members, round(quantile_cont(y, 0.5), 6) AS amplitude, round(any_value(p05), 6) AS p05, round(any_value(p95), 6) AS p95 FROM y LEFT JOIN bd USING (frequency) GROUP BY y.frequency""",
)
def stacked_spectrum(spark, sf_dir):
    out = spectra.stacked_spectrum(spectrum(spark, sf_dir))
    return out.select(F.round("frequency", 9).alias("frequency"), "n_members", *(F.round(c, 6).alias(c) for c in ("amplitude", "p05", "p95")))


WINDOWED = f"""{PAIR}, sz AS (SELECT object, max(i) + 1 AS n FROM pg GROUP BY 1 HAVING max(i) + 1 >= 64),
sg AS (SELECT object, a, i, unnest(generate_series(0, (n - 64) // 16)) AS s FROM pg JOIN sz USING (object)),
sd AS (SELECT object, s, i - s * 16 AS j, (a - avg(a) OVER (PARTITION BY object, s)) * (0.5 - 0.5 * cos(2 * pi() * (i - s * 16) / 64)) AS a FROM sg WHERE i >= s * 16 AND i < s * 16 + 64),
st AS (SELECT object, s, k, pow(sum(a * cos(2 * pi() * k * j / 64)), 2) + pow(sum(a * sin(2 * pi() * k * j / 64)), 2) AS power FROM sd, range(1, 33) r(k) GROUP BY ALL),
dom AS (SELECT object, s, k / 192.0::DOUBLE AS frequency, power FROM (SELECT *, row_number() OVER (PARTITION BY object, s ORDER BY power DESC, k) AS r FROM st) WHERE r = 1)"""


def dominant(spark, sf_dir):
    return spectra.dominant_frequencies(elements(spark, sf_dir), 3.0, window=64, step=16, value="sma")


@query("dominant_frequencies", f"WITH {WINDOWED} SELECT object, s, round(frequency, 9) AS frequency, round(power, 3) AS power FROM dom")
def dominant_frequencies(spark, sf_dir):
    return dominant(spark, sf_dir).select("object", "s", F.round("frequency", 9).alias("frequency"), F.round("power", 3).alias("power"))


@query("frequency_diffusion", f"WITH {WINDOWED} SELECT object, count(*) AS n_windows, round(stddev_pop(d), 9) AS diffusion FROM (SELECT object, frequency - lag(frequency) OVER (PARTITION BY object ORDER BY s) AS d FROM dom) GROUP BY 1")
def frequency_diffusion(spark, sf_dir):
    return spectra.frequency_diffusion(dominant(spark, sf_dir)).withColumn("diffusion", F.round("diffusion", 9))
