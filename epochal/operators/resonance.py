"""Orbital resonances: how near combinations of secular rates come to zero, and how their angles behave.

Rates are in radians a day, angles in degrees.  A definition is a row of
whole-number coefficients; users may add their own to the built-in ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions import angles, orbital

# Mean motion of the sun, rotation of the Earth, regression of the lunar node (rad/day).
SUN_RATE = 2 * math.pi / 365.2422
EARTH_RATE = 2 * math.pi * 1.00273790935
MOON_NODE_RATE = -2 * math.pi / (18.6 * 365.2422)
#: Degrees at 2000-01-01 00:00 UTC, and degrees a day from then.
SUN_LONGITUDE = (280.460, 0.9856474)
MOON_NODE = (125.045, -0.0529538)
EARTH_ANGLE = (280.46061837, 360.98564736629)
EPOCH_2000_US = 946_684_800_000_000
#: Below this eccentricity an angle that holds the perigee means little.
LOW_ECCENTRICITY = 1e-3


@dataclass(frozen=True)
class Resonance:
    """Coefficients of the rates of node, perigee, sun, lunar node, mean motion and Earth; angles have the same."""

    name: str
    family: str
    node: float = 0
    perigee: float = 0
    sun: float = 0
    moon_node: float = 0
    anomaly: float = 0
    earth: float = 0

    def of(self, node: Column, perigee: Column, sun: Column, moon_node: Column, anomaly: Column, earth: Column) -> Column:
        parts = zip((self.node, self.perigee, self.sun, self.moon_node, self.anomaly, self.earth), (node, perigee, sun, moon_node, anomaly, earth), strict=True)
        terms = [F.lit(float(c)) * x for c, x in parts if c]
        return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


# The built-in resonances.
BUILT_IN = (
    Resonance("srp_omega_minus_lambda_sun", "SRP_SOLAR_LEO", perigee=1, sun=-1),
    Resonance("srp_omega_plus_lambda_sun", "SRP_SOLAR_LEO", perigee=1, sun=1),
    Resonance("srp_Omega_plus_omega_minus_lambda_sun", "SRP_SOLAR_LEO", node=1, perigee=1, sun=-1),
    Resonance("srp_omega_minus_Omega_minus_lambda_sun", "SRP_SOLAR_LEO", node=-1, perigee=1, sun=-1),
    Resonance("srp_twoomega_plus_Omega_minus_lambda_sun", "SRP_SOLAR_LEO", node=1, perigee=2, sun=-1),
    Resonance("meo_twoomega_plus_Omega_minus_Omega_moon", "LUNISOLAR_SECULAR_MEO", node=1, perigee=2, moon_node=-1),
    Resonance("meo_omega_plus_Omega_minus_Omega_moon", "LUNISOLAR_SECULAR_MEO", node=1, perigee=1, moon_node=-1),
    Resonance("inc_two_domega_plus_dOmega_zero", "INCLINATION_ONLY_SECULAR", node=1, perigee=2),
    Resonance("inc_domega_zero", "INCLINATION_ONLY_SECULAR", perigee=1),
    Resonance("tesseral_14_1", "TESSERAL_GROUNDTRACK", anomaly=1, earth=-14),
    Resonance("tesseral_15_1", "TESSERAL_GROUNDTRACK", anomaly=1, earth=-15),
)


def registry(families: list[str] | None = None, own: tuple[Resonance, ...] = ()) -> tuple[Resonance, ...]:
    """Built-in definitions, then a user's own; of the given families alone, if any are given.

    A name used twice or a family that no definition has is an error.
    """
    every = (*BUILT_IN, *own)
    names = [d.name for d in every]
    if len(set(names)) < len(names):
        raise ValueError(f"names used twice: {sorted({n for n in names if names.count(n) > 1})}")
    if families is None:
        return every
    if unknown := set(families) - {d.family for d in every}:
        raise ValueError(f"unknown families {sorted(unknown)}")
    return tuple(d for d in every if d.family in families)


def rates(df: DataFrame, sma: str = "sma", ecc: str = "ecc", inc: str = "inc") -> DataFrame:
    """Adds ``node`` and ``perigee`` (J2 rates) and ``n`` (mean motion), radians a day."""
    args = [F.col(c) for c in (sma, ecc, inc)]
    day = lambda rate: rate * orbital.DAY_S
    return df.withColumns({"node": day(orbital.node_rate(*args)), "perigee": day(orbital.perigee_rate(*args)), "n": day(orbital.mean_motion(F.col(sma)))})


def best_match(df: DataFrame, tolerance: float = 1e-3, definitions: tuple[Resonance, ...] = BUILT_IN) -> DataFrame:
    """Adds the nearest resonance's ``name``, ``family``, ``proximity`` (rad/day) and ``near``; ties to the first listed.

    ``df`` has ``node``, ``perigee`` and ``n``; definitions whose rates are
    null for a row don't count for it, and a row without any has nulls and is
    not near.
    """
    external = [F.lit(x) for x in (SUN_RATE, MOON_NODE_RATE, EARTH_RATE)]
    # numbers alone are compared: the code for a struct a definition is too long a method to be compiled at run time
    every = F.array(*(F.abs(d.of(F.col("node"), F.col("perigee"), external[0], external[1], F.col("n"), external[2])) for d in definitions))
    out = df.withColumn("__every", every).withColumn("proximity", F.array_min("__every"))
    out = out.withColumn("proximity", F.when(~F.isnan("proximity"), F.col("proximity")))
    out = out.withColumn("__at", (F.array_position("__every", F.col("proximity")) - 1).cast("int"))
    told = lambda what: F.get(F.array(*(F.lit(getattr(d, what)) for d in definitions)), F.col("__at"))
    near = F.coalesce(F.col("proximity") <= tolerance, F.lit(False))
    own = [c for c in df.columns if c not in ("name", "family", "proximity", "near")]
    return out.select(*own, told("name").alias("name"), told("family").alias("family"), "proximity", near.alias("near"))


def resonant_angles(df: DataFrame, definitions: tuple[Resonance, ...] = BUILT_IN, time: str = "t", low_ecc: float = LOW_ECCENTRICITY) -> DataFrame:
    """One row a record and definition: ``resonance``, ``psi`` in [-180, 180) and ``valid``.

    ``df`` has ``raan``, ``aop``, ``mean_anomaly``, ``ecc`` and a time in
    microseconds, from which sun, lunar node and Earth take their approximate
    angles.  An angle that holds the perigee is valid only above ``low_ecc``.
    """
    days = (F.col(time) - EPOCH_2000_US) / 86_400_000_000
    sun, moon, earth = (angles.wrap_180(F.lit(a) + F.lit(b) * days) for a, b in (SUN_LONGITUDE, MOON_NODE, EARTH_ANGLE))
    made = []
    for d in definitions:
        psi = angles.wrap_180(d.of(F.col("raan"), F.col("aop"), sun, moon, F.col("mean_anomaly"), earth))
        valid = F.coalesce(F.col("ecc") > low_ecc, F.lit(False)) if d.perigee else F.lit(True)
        made.append(F.struct(F.lit(d.name).alias("resonance"), psi.alias("psi"), valid.alias("valid")))
    return df.withColumn("__a", F.explode(F.array(*made))).select(*df.columns, "__a.*")


def angle_behaviour(df: DataFrame, by: list[str], order: list[str], angle: str = "psi", least: int = 24, libration_span: float = 240.0) -> DataFrame:
    """``behaviour`` of an angle's series: ``insufficient_data``, ``circulation``, ``libration_candidate`` or ``transition_or_mixed``.

    Of the wrapped angle the span counts, of the unwrapped one the distance of
    both ends, which is the sum of its steps; nulls and NaN are left out.
    """
    some = df.where(F.col(angle).isNotNull() & ~F.isnan(angle))
    # to a millionth of a degree, so that half a turn is told alike whatever the last digits
    step = angles.wrap_180(F.round(F.col(angle) - F.lag(angle).over(Window.partitionBy(*by).orderBy(*order)), 6))
    stats = some.withColumn("__step", step).groupBy(*by).agg(
        F.count("*").alias("n"), (F.max(angle) - F.min(angle)).alias("span"), F.abs(F.coalesce(F.sum("__step"), F.lit(0.0))).alias("drift")
    )
    return stats.withColumn("behaviour", _kind(F.col("n"), F.col("span"), F.col("drift"), least, libration_span))


def _kind(n: Column, span: Column, drift: Column, least: int, libration_span: float) -> Column:
    return (
        F.when(n < least, "insufficient_data")
        .when((drift > 540) & (span > 260), "circulation")
        .when((span <= libration_span) & (drift < 360), "libration_candidate")
        .otherwise("transition_or_mixed")
    )


def object_behaviours(df: DataFrame, definitions: tuple[Resonance, ...] = BUILT_IN, time: str = "t", order: tuple[str, ...] = ("t", "rec"), least: int = 24, libration_span: float = 240.0) -> DataFrame:
    """``object``, ``resonance``, ``behaviour``: what :func:`angle_behaviour` says of each object's :func:`resonant_angles`.

    A record stays one row, with a column a definition, until its object is
    summed up: what is shuffled and sorted doesn't grow with the definitions.
    """
    # angles are made behind the exchange, as elements are narrower; their code there is short enough to be compiled at run time
    base = df.select("object", *dict.fromkeys((*order, time, "raan", "aop", "mean_anomaly"))).repartition("object").sortWithinPartitions("object", *order)
    days = (F.col(time) - EPOCH_2000_US) / 86_400_000_000
    own = base.withColumns({f"__{k}": angles.wrap_180(F.lit(a) + F.lit(b) * days) for k, (a, b) in (("sun", SUN_LONGITUDE), ("moon", MOON_NODE), ("earth", EARTH_ANGLE))})
    parts = [F.col(c) for c in ("raan", "aop", "__sun", "__moon", "mean_anomaly", "__earth")]
    psi = [angles.wrap_180(d.of(*parts)) for d in definitions]
    rows = own.select("object", *order, *(F.nullif(p, F.lit(float("nan"))).alias(f"__p{k}") for k, p in enumerate(psi)))
    before = Window.partitionBy("object").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("object", *(f"__p{k}" for k in range(len(psi))), *(F.last(f"__p{k}", ignorenulls=True).over(before).alias(f"__b{k}") for k in range(len(psi))))
    step = lambda k: angles.wrap_180(F.round(F.col(f"__p{k}") - F.col(f"__b{k}"), 6))
    steps = rows.select("object", *(f"__p{k}" for k in range(len(psi))), *(step(k).alias(f"__s{k}") for k in range(len(psi))))
    sums = [f(c).alias(n) for k in range(len(psi)) for f, c, n in ((F.count, f"__p{k}", f"n{k}"), (F.max, f"__p{k}", f"high{k}"), (F.min, f"__p{k}", f"low{k}"), (F.sum, f"__s{k}", f"turn{k}"))]
    each = lambda k, d: F.struct(F.lit(d.name).alias("resonance"), F.col(f"n{k}").alias("n"), (F.col(f"high{k}") - F.col(f"low{k}")).alias("span"), F.abs(F.coalesce(F.col(f"turn{k}"), F.lit(0.0))).alias("drift"))
    stats = steps.groupBy("object").agg(*sums).select("object", F.inline(F.array(*(each(k, d) for k, d in enumerate(definitions))))).where("n > 0")
    return stats.select("object", "resonance", _kind(F.col("n"), F.col("span"), F.col("drift"), least, libration_span).alias("behaviour"))


def by_object(df: DataFrame) -> DataFrame:
    """Near records and near epochs of each object."""
    near = F.col("near").cast("int")
    return df.groupBy("object").agg(
        F.count("*").alias("n"), F.count_distinct("t").alias("n_epochs"), F.sum(near).alias("n_near"), F.round(F.avg(near), 6).alias("fraction"), F.count_distinct(F.when(F.col("near"), F.col("t"))).alias("near_epochs")
    )


def by_window(df: DataFrame, width: int) -> DataFrame:
    """Share of time windows with a near record, empty windows between first and last included."""
    windows = df.groupBy("object", F.floor(F.col("t") / width).alias("w")).agg(F.max(F.col("near").cast("int")).alias("near"))
    span = F.max("w") - F.min("w") + 1
    return windows.groupBy("object").agg(span.alias("n_windows"), F.sum("near").alias("near_windows"), F.round(F.sum("near") / span, 6).alias("fraction"))


def grid(df: DataFrame, a_bins: tuple[float, float, int], i_bins: tuple[float, float, int], least: int) -> DataFrame:
    """Statistics of each cell of (sma, inc), empty cells too; cells of fewer than ``least`` rows have none.

    Bins are (start, width, count); the grid itself is small and fixed.
    """
    spark = df.sparkSession
    index = lambda c, b: F.floor((F.col(c) - b[0]) / b[1]).cast("int")
    inside = lambda c, b: (F.col(c) >= b[0]) & (F.col(c) < b[0] + b[1] * b[2])
    cell = df.where(inside("sma", a_bins) & inside("inc", i_bins)).withColumns({"ia": index("sma", a_bins), "ii": index("inc", i_bins)})
    p = lambda q: F.round(F.percentile("proximity", F.lit(q)), 6)
    stats = cell.groupBy("ia", "ii").agg(F.count("*").alias("n"), p(0.5).alias("median"), p(0.25).alias("p25"), p(0.75).alias("p75"), F.round(F.avg(F.col("near").cast("int")), 6).alias("fraction"))
    rank = F.row_number().over(Window.partitionBy("ia", "ii").orderBy(F.desc("c"), "family"))
    family = cell.groupBy("ia", "ii", "family").agg(F.count("*").alias("c")).withColumn("k", rank).where("k = 1").select("ia", "ii", "family")
    cells = spark.range(a_bins[2] * i_bins[2]).select(F.floor(F.col("id") / i_bins[2]).cast("int").alias("ia"), (F.col("id") % i_bins[2]).cast("int").alias("ii"))
    out = cells.join(stats, ["ia", "ii"], "left").join(family, ["ia", "ii"], "left")
    some = lambda c: F.when(F.col("n") >= least, F.col(c)).alias(c)
    return out.select("ia", "ii", F.coalesce("n", F.lit(0)).alias("n"), *(some(c) for c in ("median", "p25", "p75", "fraction", "family")))


# -- screening --------------------------------------------------------------------
#: How much a family's proxy of width counts; any other family counts as ``none``.
FAMILY_SCALES = {"SRP_SOLAR_LEO": 1.0, "LUNISOLAR_SECULAR_MEO": 0.75, "INCLINATION_ONLY_SECULAR": 0.9, "TESSERAL_GROUNDTRACK": 0.6, "none": 0.5}
#: Confidence in a proxy by method.
WIDTH_CONFIDENCE = {"reciprocal": 0.4, "family_scaled": 0.6, "rolling_local": 0.75}


def screened(matches: DataFrame, behaviours: DataFrame, definitions: tuple[Resonance, ...] = BUILT_IN, low_ecc: float = LOW_ECCENTRICITY) -> DataFrame:
    """Records with how the angle of their nearest resonance behaves, and whether that makes a candidate of capture.

    ``matches`` is what :func:`best_match` gives (with ``object`` and ``ecc``),
    ``behaviours`` has ``object``, ``resonance``, ``behaviour``.  Adds
    ``behaviour`` (``insufficient_data`` where there is none), ``candidate``
    (near, and librating), ``weak_apsis`` (the resonance holds the perigee of
    an orbit too round for one) and ``confidence``.

    Rows with a null object or without a resonance have no behaviour.  A
    record stays one row: behaviours are one row an object and resonance by
    grouping; if a table repeats them, the least counts.
    """
    known = behaviours.groupBy(F.col("object").alias("__o"), F.col("resonance").alias("__r")).agg(F.min("behaviour").alias("behaviour"))
    out = matches.drop("behaviour").join(known, (F.col("object") == F.col("__o")) & (F.col("name") == F.col("__r")), "left").drop("__o", "__r")
    apsidal = [d.name for d in definitions if d.perigee]
    out = out.withColumn("behaviour", F.coalesce("behaviour", F.lit("insufficient_data")))
    weak = F.coalesce(F.col("name").isin(apsidal) & (F.col("ecc") <= low_ecc) & ~F.isnan("ecc"), F.lit(False))
    out = out.withColumns({"candidate": F.col("near") & (F.col("behaviour") == "libration_candidate"), "weak_apsis": weak})
    grade = F.when(~F.col("candidate"), "not_candidate").when(F.col("weak_apsis"), "low_confidence_low_e_apsidal").otherwise("screening_candidate")
    return out.withColumn("confidence", grade)


def width_proxy(df: DataFrame, method: str = "family_scaled", window: int = 12, output: str = "width", scales: dict[str, float] | None = None) -> DataFrame:
    """Adds a proxy of a resonance's width, 1 / (1 + residual), and ``<output>_confidence``; ``df`` has ``proximity`` and ``family``.

    ``family_scaled`` weighs it by the family.  ``rolling_local`` takes, of an
    object's rows in time (``object``, ``t``, ``rec``), the median residual of
    the last ``window`` rows (three known ones at least; else the row's own)
    and adds the slope of those medians (half the difference of both
    neighbours, the difference at an end).  Where a neighbour has no median
    the proxy is null, as it is without a residual; an object with one row has
    none.  Rows without an object are one series.
    """
    if method not in WIDTH_CONFIDENCE:
        raise ValueError(f"method must be one of {sorted(WIDTH_CONFIDENCE)}")
    scales = scales or FAMILY_SCALES
    other = F.lit(float(scales.get("none", 0.5)))
    weight = F.coalesce(*(F.when(F.col("family") == name, F.lit(float(x))) for name, x in scales.items()), other)
    own = F.when(~F.isnan("proximity"), F.abs("proximity"))
    if method != "rolling_local":
        width = 1 / (1 + own) * (F.lit(1.0) if method == "reciprocal" else weight)
        return df.withColumns({output: width, f"{output}_confidence": F.when(own.isNotNull(), WIDTH_CONFIDENCE[method])})
    series = Window.partitionBy("object").orderBy("t", "rec")
    some = series.rowsBetween(1 - max(3, window), 0)
    out = df.withColumn("__own", own)
    out = out.withColumn("__mid", F.when(F.count("__own").over(some) >= 3, F.percentile("__own", F.lit(0.5)).over(some)))
    # which neighbours there are is told by rows, not by their medians
    before, after = F.lag(F.struct("__mid")).over(series), F.lead(F.struct("__mid")).over(series)
    out = out.withColumns({"__before": before, "__after": after})
    left, right, mid = F.col("__before.__mid"), F.col("__after.__mid"), F.col("__mid")
    slope = F.when(F.col("__before").isNull(), right - mid).when(F.col("__after").isNull(), mid - left).otherwise((right - left) / 2)
    width = 1 / (1 + F.coalesce(mid, F.col("__own")) + F.abs(slope)) * weight
    out = out.withColumn(output, width)
    return out.withColumn(f"{output}_confidence", F.when(F.col(output).isNotNull(), WIDTH_CONFIDENCE[method])).drop("__own", "__mid", "__before", "__after")
