"""Two-body and secular-perturbation formulas as column expressions (km, s, degrees unless said)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Gravitational parameter, equatorial radius and J2 of the Earth, length of the year.
MU = 398600.4418
EARTH_RADIUS = 6378.14
J2 = 1.082635854e-3
TROPICAL_YEAR_DAYS = 365.2421897
DAY_S = 86400.0
#: What :func:`with_elements` adds.
ELEMENTS = StructType([StructField(c, DoubleType()) for c in ("h", "energy", "sma", "ecc", "inc", "raan", "aop", "nu")])


def semi_major_axis(rev_per_day: Column) -> Column:
    n = rev_per_day * (2 * math.pi / DAY_S)
    return F.pow(F.lit(MU), F.lit(1 / 3)) / F.pow(n, F.lit(2 / 3))


def mean_motion(sma: Column) -> Column:
    """rad/s."""
    return F.sqrt(F.lit(MU) / F.pow(sma, 3))


def period(sma: Column) -> Column:
    return 2 * math.pi * F.sqrt(F.pow(sma, 3) / F.lit(MU))


def angular_momentum(sma: Column, ecc: Column) -> Column:
    return F.sqrt(F.lit(MU) * sma * (1 - ecc * ecc))


def eccentric_anomaly(mean_rad: Column, ecc: Column, steps: int = 12) -> Column:
    """Newton's method on Kepler's equation, a fixed number of steps."""
    start = F.when(mean_rad < math.pi, mean_rad + ecc / 2).otherwise(mean_rad - ecc / 2)
    step = lambda e, _: e - (e - ecc * F.sin(e) - mean_rad) / (1 - ecc * F.cos(e))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def true_anomaly(mean_deg: Column, ecc: Column) -> Column:
    """Degrees in [0, 360)."""
    e = eccentric_anomaly(F.radians(F.pmod(mean_deg, F.lit(360.0))), ecc)
    nu = 2 * F.atan2(F.sqrt(1 + ecc) * F.sin(e / 2), F.sqrt(1 - ecc) * F.cos(e / 2))
    return F.pmod(F.degrees(nu), F.lit(360.0))


def _j2_factor(sma: Column, ecc: Column) -> Column:
    p = sma * (1 - ecc * ecc)
    return J2 * mean_motion(sma) * F.pow(EARTH_RADIUS / p, 2)


def node_rate(sma: Column, ecc: Column, inc: Column) -> Column:
    """J2 rate of the node, rad/s."""
    return -1.5 * _j2_factor(sma, ecc) * F.cos(F.radians(inc))


def perigee_rate(sma: Column, ecc: Column, inc: Column) -> Column:
    """J2 rate of the argument of perigee, rad/s."""
    return 0.75 * _j2_factor(sma, ecc) * (5 * F.pow(F.cos(F.radians(inc)), 2) - 1)


def anomaly_rate(sma: Column, ecc: Column, inc: Column) -> Column:
    """Mean motion with the J2 term, rad/s."""
    more = 0.75 * _j2_factor(sma, ecc) * F.sqrt(1 - ecc * ecc) * (3 * F.pow(F.cos(F.radians(inc)), 2) - 1)
    return mean_motion(sma) + more


def per_day(rate: Column) -> Column:
    """rad/s to degrees a day."""
    return F.degrees(rate * DAY_S)


def sun_synchronous_inclination(sma: Column, ecc: Column) -> Column:
    """Degrees; null where no inclination keeps pace with the mean sun."""
    wanted = 2 * math.pi / (TROPICAL_YEAR_DAYS * DAY_S)
    c = -wanted / (1.5 * _j2_factor(sma, ecc))
    return F.when(F.abs(c) <= 1, F.degrees(F.acos(c)))


def state_vector(sma: Column, ecc: Column, inc: Column, raan: Column, aop: Column, nu: Column) -> dict[str, Column]:
    """Inertial position and velocity: columns x, y, z, vx, vy, vz."""
    i, o, w, v = (F.radians(a) for a in (inc, raan, aop, nu))
    p = sma * (1 - ecc * ecc)
    r = p / (1 + ecc * F.cos(v))
    k = F.sqrt(F.lit(MU) / p)
    px, py, vx, vy = r * F.cos(v), r * F.sin(v), -k * F.sin(v), k * (ecc + F.cos(v))
    co, so, cw, sw, ci, si = F.cos(o), F.sin(o), F.cos(w), F.sin(w), F.cos(i), F.sin(i)
    rows = ((co * cw - so * sw * ci, -co * sw - so * cw * ci), (so * cw + co * sw * ci, -so * sw + co * cw * ci), (sw * si, cw * si))
    out = {}
    for axis, (a, b) in zip("xyz", rows, strict=True):
        out[axis] = a * px + b * py
        out["v" + axis] = a * vx + b * vy
    return out


def ion_thruster(power_v: Column, current: Column, gamma: float = 0.95, utilisation: float = 0.9, beam: float = 0.9, bus: float = 0.95) -> dict[str, Column]:
    """Beam relations: thrust (mN), specific impulse (s) and power (W) of voltage and current."""
    return {
        "thrust_mn": 1.32 * gamma * current * F.sqrt(power_v),
        "isp_s": 154.8 * gamma * utilisation * F.sqrt(power_v),
        "power_w": power_v * current / (beam * bus),
    }


def with_elements(df: DataFrame) -> DataFrame:
    """``df`` with the elements of positions ``x y z`` (km) and velocities ``vx vy vz`` (km/s).

    They are ``h``, ``energy``, ``sma``, ``ecc`` and, in degrees [0, 360),
    ``inc``, ``raan``, ``aop``, ``nu``.  Without a node (an equatorial orbit)
    its longitude is 0; without an apsis (a circular orbit) ``aop`` is 0 and
    ``nu`` counts from the node, or from the first axis.  A state without
    angular momentum has null angles, one with a null component nulls alone.
    A batch of rows is worked out in NumPy: the same as column expressions is
    too long a method for Spark's generated code to be compiled at run time.
    """

    @F.arrow_udf(ELEMENTS)
    def elements(x: pa.Array, y: pa.Array, z: pa.Array, vx: pa.Array, vy: pa.Array, vz: pa.Array) -> pa.Array:
        return _elements([x, y, z, vx, vy, vz])

    found = elements(*(F.col(c).cast("double") for c in ("x", "y", "z", "vx", "vy", "vz")))
    return df.withColumn("__k", found).withColumns({c: F.col(f"__k.{c}") for c in ELEMENTS.names}).drop("__k")


def _elements(columns: list[pa.Array]) -> pa.Array:
    unknown = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=0)
    x, y, z, vx, vy, vz = (c.fill_null(math.nan).to_numpy() for c in columns)
    with np.errstate(all="ignore"):
        r = np.sqrt(x * x + y * y + z * z)
        hx, hy, hz = y * vz - z * vy, z * vx - x * vz, x * vy - y * vx
        h, n = np.sqrt(hx * hx + hy * hy + hz * hz), np.sqrt(hx * hx + hy * hy)
        ex, ey, ez = (vy * hz - vz * hy) / MU - x / r, (vz * hx - vx * hz) / MU - y / r, (vx * hy - vy * hx) / MU - z / r
        energy, ecc = (vx * vx + vy * vy + vz * vz) / 2 - MU / r, np.sqrt(ex * ex + ey * ey + ez * ez)
        noded = ~(n <= 1e-9)
        # angles from the node to a vector in the orbit's plane: along the node, and across it
        along = lambda a, b: np.where(noded, (b * hx - a * hy) / n, a)
        across = lambda b, c: np.where(noded, c * h / n, np.where(hz < 0, -b, b))
        w = np.where(ecc <= 1e-10, 0.0, np.arctan2(across(ey, ez), along(ex, ey)))
        u = np.arctan2(across(y, z), along(x, y))
        turns = np.degrees([np.arccos(np.fmax(-1.0, np.fmin(1.0, hz / h))), np.where(noded, np.arctan2(hx, -hy), 0.0), w, u - w])
        turns = np.fmod(turns, 360.0)
        turns = np.where(turns < 0, np.fmod(turns + 360.0, 360.0), turns)
        sma = -MU / (2 * energy)
    apart, still = unknown | (r == 0), unknown | (h <= 1e-12)
    masked = [(h, unknown), (energy, apart), (sma, apart | (energy == 0)), (ecc, apart), *((t, still) for t in turns)]
    return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=m) for v, m in masked], names=ELEMENTS.names)


def phase_choice(ecc: Column, wanted: Column, fallback: Column, threshold: float = 0.01) -> Column:
    """An orbit's phase: ``fallback`` (a longitude, say) where the eccentricity is known and too small for an apsis, else ``wanted``."""
    return F.when(F.coalesce((ecc < threshold) & ~F.isnan(ecc), F.lit(False)), fallback).otherwise(wanted)


def julian_date(micros: Column) -> Column:
    """Days since noon of the first day of 4713 BC, of microseconds since 1970."""
    return micros / 86_400_000_000.0 + 2440587.5


def sidereal_angle(julian: Column) -> Column:
    """Greenwich's sidereal angle (degrees) of a Julian date, by the polynomial for 0 h."""
    t = (julian - 2451545.0) / 36525.0
    return F.pmod(100.4606184 + t * (36000.77004 + t * (0.000387933 - t / 38710000.0)), F.lit(360.0))


# Gravitational parameters (km3/s2), distances (km) and eccentricities of the sun's and the moon's orbits.
SUN_MU, SUN_DISTANCE, SUN_ECC = 1.32712440018e11, 149_597_870.7, 0.0167086
MOON_MU, MOON_DISTANCE, MOON_ECC = 4902.800066, 384_400.0, 0.0549


def third_body_rates(sma: Column, ecc: Column, inc: Column) -> tuple[Column, Column]:
    """Rates of node and perigee by sun and moon together, rad/s: both averaged to second order, for screening.

    Null for elements that are no ellipse (``sma`` not above 0, ``ecc`` outside
    [0, 1)) and for nulls and NaN.
    """
    pull = sum(m / MU / d**3 / (1 - e * e) ** 1.5 for m, d, e in ((SUN_MU, SUN_DISTANCE, SUN_ECC), (MOON_MU, MOON_DISTANCE, MOON_ECC)))
    scale = 0.75 * mean_motion(sma) * pull * F.pow(sma, 3)
    c = F.cos(F.radians(inc))
    good = (sma > 0) & ~F.isnan(sma) & (ecc >= 0) & (ecc < 1) & ~F.isnan(inc)
    return F.when(good, -scale * c), F.when(good, scale * (5 * c * c - 1))
