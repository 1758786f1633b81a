"""Rules over single records: bands, tables of ranges, first matches, identities and readiness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochal.operators import occupancy

# Edges of the altitude bins that stand in for a missing shell (km).
ALTITUDE_BINS = (300, 400, 500, 600, 700, 800, 900, 1000, 1200, 1500)


def last_match(value: Column, ranges: Sequence[tuple[str, float, float]]) -> Column:
    """Name of the last half-open range ``[low, high)`` that holds the value; null: none."""
    out = F.lit(None).cast("string")
    for name, low, high in ranges:
        out = F.when((value >= low) & (value < high), name).otherwise(out)
    return out


def regime(value: Column, edges: Sequence[tuple[str, float]]) -> Column:
    """Name of the first upper edge that the value doesn't exceed; null beyond the last."""
    out = F.lit(None).cast("string")
    for name, high in reversed(edges):
        out = F.when(value <= high, name).otherwise(out)
    return out


def nearest(value: Column, references: Sequence[float]) -> Column:
    """Struct of ``distance`` and number (``reference``) of the nearest reference; ties to the first."""
    return F.least(*(F.struct(F.abs(value - r).alias("distance"), F.lit(n).alias("reference")) for n, r in enumerate(references)))


def family(value: Column, targets: Sequence[float], tolerance: float, prefix: str, other: str = "unmatched") -> Column:
    """``prefix`` and the first target within a tolerance."""
    out = F.lit(other)
    for target in reversed(targets):
        out = F.when(F.abs(value - target) <= tolerance, f"{prefix}_{target:.3f}").otherwise(out)
    return out


def in_band(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """Rows strictly inside a band; an end that is None is open."""
    out = df
    if low is not None:
        out = out.where(F.col(column) > low)
    return out if high is None else out.where(F.col(column) < high)


def shell_identity(df: DataFrame, altitude: str = "altitude_km", shell: str = "candidate_shell_id", bins: Sequence[float] = ALTITUDE_BINS) -> DataFrame:
    """Adds ``altitude_bin``, ``shell_or_bin``, ``shell_identity_source``, ``shell_is_altitude_fallback`` and ``shell_assignment_basis``.

    A missing shell (also as the texts ``nan`` and ``<NA>``, or no such column)
    is told by the altitude's bin.  A basis that the rows have stays where the shell does.
    """
    x = F.col(altitude)
    label = occupancy.cut(x, bins, first_label=bins[0] - 0.001)
    known = F.col(shell).cast("string") if shell in df.columns else F.lit(None).cast("string")
    missing = known.isNull() | known.isin("nan", "<NA>")
    source = F.when(missing, "altitude_bin_fallback").otherwise("candidate_shell_id")
    own = F.col("shell_assignment_basis") if "shell_assignment_basis" in df.columns else F.lit("candidate_shell_id")
    return df.withColumns(
        {
            "altitude_bin": label,
            "shell_or_bin": F.when(missing, label).otherwise(known),
            "shell_identity_source": source,
            "shell_is_altitude_fallback": missing,
            "shell_assignment_basis": F.when(missing, "altitude_bin_fallback").otherwise(own),
        }
    )


def event_kind(d_sma: Column, d_inc: Column, drag: Column, slope: Column) -> Column:
    """Kind of an event by its changes of semi-major axis (km) and inclination (degrees), drag and slope: the first rule that fits."""
    sma, inc = F.abs(d_sma), F.abs(d_inc)
    return (
        F.when((d_sma > 8) & (inc > 0.05), "combined_raise_and_plane_change")
        .when(d_sma > 8, "semi_major_axis_raise")
        .when((d_sma < -8) & ((drag > 3e-4) | (slope < -0.003)), "possible_disposal_start")
        .when(d_sma < -8, "semi_major_axis_lower")
        .when(inc > 0.05, "inclination_change")
        .when((sma <= 4) & (inc <= 0.02), "possible_stationkeeping")
        .when((sma > 20) | (inc > 0.2), "possible_anomaly")
        .otherwise("unknown_event")
    )


def point_state(place: Column, slope: Column, variation: Column, drag: Column, rate: Column) -> Column:
    """Struct of ``state`` and ``score`` of a record by the first of eight rules; ``place`` is its number in its series, from 0.

    A missing slope, drag or rate is 0, a missing variation endless.
    """
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    slope, drag, rate = zero(slope), zero(drag), zero(rate)
    variation = F.coalesce(F.nanvl(variation, F.lit(float("inf"))), F.lit(float("inf")))
    rules = (
        ((place < 5) & (slope > 0.4), "insertion_or_orbit_raise", 0.7),
        ((slope > 0.3) & (rate > 0.05), "relocation", 0.65),
        (slope > 0.2, "transition", 0.6),
        ((slope < -0.3) & (drag > 3e-4), "disposal_lowering", 0.75),
        ((slope < -0.2) & (variation < 10), "passive_decay", 0.65),
        ((F.abs(slope) <= 0.05) & (variation <= 8) & (rate < 0.08), "operational_shell", 0.8),
        (rate > 0.2, "transition", 0.55),
        ((drag > 6e-4) & (slope < -0.1), "likely_nonoperational", 0.7),
    )
    out = F.struct(F.lit("unknown").alias("state"), F.lit(0.4).alias("score"))
    for rule, state, score in reversed(rules):
        out = F.when(rule, F.struct(F.lit(state).alias("state"), F.lit(score).alias("score"))).otherwise(out)
    return out


# Columns that tell of covariance, encounter geometry and relative uncertainty.
HINTS: Mapping[str, frozenset[str]] = {
    "has_covariance": frozenset("cov_r cov_t cov_n cov_rr cov_tt cov_nn sigma_r sigma_t sigma_n".split()),
    "has_encounter_geometry": frozenset("tca_timestamp miss_distance_km relative_speed_km_s relative_position_rtn_km".split()),
    "has_relative_state_uncertainty": frozenset("relative_covariance combined_covariance relative_position_sigma_km relative_velocity_sigma_km_s".split()),
}
LEVELS = ((5, "conjunction_input_complete"), (4, "encounter_ready_not_pc"), (3, "screening_ready"))


def readiness(df: DataFrame, **given: bool) -> dict:
    """What a table's columns allow: five flags, their share and a level; flags may be ``given``.  Reads the schema only."""
    names = {c.strip().lower() for c in df.columns}
    flags = {"has_timestamp": "timestamp" in df.columns, "has_object_id": bool({"norad_cat_id", "sat_id"} & set(df.columns))}
    flags |= {flag: bool(given.get(flag)) or bool(hints & names) for flag, hints in HINTS.items()}
    count = sum(flags.values())
    level = next((name for least, name in LEVELS if count >= least), "proxy_only")
    return {"readiness_level": level, "readiness_score": count / 5, "requires_covariance_for_pc": not flags["has_covariance"], "features": flags}


def canonical_id(text: Column) -> Column:
    """Lower-case last part of a path without its extension, blanks and dashes as underscores."""
    last = F.regexp_extract(F.lower(F.trim(text)), r"([^/\\]*)$", 1)
    return F.regexp_replace(F.regexp_replace(last, r"\.[a-z0-9]+$", ""), r"[\s-]+", "_")


#: Choices of event layers.
LAYER_MODES = ("all", "accepted_plus_raw", "accepted_only", "raw_only", "rejects_only", "accepted_high_confidence")


def in_layer(mode: str, quality: str = "quality", layer: str = "layer", score: str = "event_score", least: float = 0.8) -> Column:
    """Whether an event belongs to a layer mode, by its quality and layer names (in any case) and its score; null names are empty, a null score 0."""
    q, name = F.lower(F.coalesce(quality, F.lit(""))), F.coalesce(layer, F.lit(""))
    rejected = F.contains(q, F.lit("reject"))
    modes = {
        "all": F.lit(True),
        "accepted_plus_raw": name.isin("accepted", "raw_candidate", "accepted_candidate"),
        "accepted_only": ~rejected,
        "raw_only": F.contains(F.lower(name), F.lit("raw")),
        "rejects_only": rejected | F.contains(q, F.lit("anomaly_screened")),
        "accepted_high_confidence": ~rejected & (F.coalesce(score, F.lit(0.0)) >= least),
    }
    if mode not in modes:
        raise ValueError(f"unknown layer mode {mode!r}")
    return modes[mode]
