"""Evidence of several detectors over an object's channels, fused into scored segments and events.

A panel has ``object``, ``t`` (microseconds), ``rec`` and the channels ``sma``,
``inc``, ``mean_motion``, ``ecc``, ``raan`` and ``bstar`` (any may be null in a
row).  Rows are taken in order (``t``, ``rec``); rows without an object or a
time take no part, NaN counts as null, and objects of fewer than
``LEAST_RECORDS`` rows have no segments.

Families of detectors, each a mask and an evidence (0 where nothing is known):

* ``local``: what is left of ``sma`` and ``inc`` beside a rolling mean;
* ``filtered``: the step between lines fitted before and after a row, on four
  energy and two plane channels;
* ``smoothed``: first and second rates of exponential means against limits;
* ``predicted``: the miss of a prediction from the row before;
* ``anomaly``: a single jump of any channel.

Objects are dealt once and put in order; signals, masks and runs of supported
rows are made of batches of whole objects in NumPy (``detectors``), so that one
pass over the rows serves every choice of families and only runs leave it.  An
object's series is in memory of its task (about 900 bytes a row).  Events are
merged by a fold over chains of events; a chain ends where no earlier event,
however merged, can reach the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from epochal.functions.orbital import MU
from epochal.operators import detectors, signals
from epochal.operators.asof import greedy_matches
from epochal.operators.detectors import HOUR
from epochal.operators.series import ordered
from epochal.sources.shared import stored

SECOND = 1_000_000
FAMILIES = ("local", "filtered", "smoothed", "predicted")


@dataclass(frozen=True)
class Settings:
    """Fixed values of the detectors, the score and the merge; ``families`` are those that segments and fusion go by."""

    families: tuple = FAMILIES
    trend_rows: int = 13
    sigma: float = 3.0
    prominence_rows: int = 11
    prominence_sigmas: float = 0.5
    line_rows: int = 9
    smooth_span: int = 9
    #: Limits of the first and second rate (a second, a second squared).
    rate_limits: dict = field(default_factory=lambda: {"sma": (0.002, 2e-6), "inc": (5e-5, 2e-8)})
    hysteresis: int = 2
    predicted_sigma: float = 3.5
    #: Jumps of sma, inc, mean_motion, raan and bstar that count 1.
    jump_scales: dict = field(default_factory=lambda: {"sma": 30.0, "inc": 0.25, "mean_motion": 0.05, "raan": 2.0, "bstar": 6e-4})
    anomaly_sigma: float = 5.0
    gap_rows: int = 1
    least_support: int = 2
    least_seconds: float = 6 * HOUR
    weights: dict = field(default_factory=lambda: {"local": 1.0, "filtered": 1.15, "smoothed": 1.0, "predicted": 1.2})
    weighted_threshold: float = 0.8
    accept_score: float = 1.0
    accept_prominence: float = 0.5
    high_confidence: float = 1.6
    lag_seconds: float = 6 * HOUR
    spacing_seconds: float = 24 * HOUR
    upkeep_spacing_seconds: float = 72 * HOUR


# -- robust scales of an object's values ---------------------------------------------
@F.pandas_udf(DoubleType())
def middle(v: pd.Series) -> float:
    """Median of an object's finite values, null without any."""
    mid = signals.middle(v.to_numpy(float)[None])[0] if len(v) else np.nan
    return None if np.isnan(mid) else float(mid)


@F.pandas_udf(DoubleType())
def clipped_sigma(v: pd.Series) -> float:
    """Robust deviation after three clipping rounds."""
    return float(signals.clipped(v.to_numpy(float)[None], 3, 4.5)[0]) if len(v) else 1.0


# -- rows ------------------------------------------------------------------------------
def filled(df: DataFrame, otherwise: dict[str, float | None], place: str = "i") -> DataFrame:
    """Unknown values of columns take the next known one, at the end the last one, or else the given value.

    What comes next is looked up in rows from last to first (``place``, a row's
    number in its object): a frame from a row to the end would be read anew at
    every row.
    """
    back = ordered().rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("object").orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"__back_{c}": F.last(c, ignorenulls=True).over(back) for c in otherwise})
    out = out.withColumns({f"__ahead_{c}": F.last(c, ignorenulls=True).over(ahead) for c in otherwise})
    known = {c: F.coalesce(f"__ahead_{c}", f"__back_{c}", *([] if v is None else [F.lit(v)])) for c, v in otherwise.items()}
    return out.withColumns(known).drop(*(f"__{k}_{c}" for k in ("back", "ahead") for c in otherwise))


def half(v: Column) -> Column:
    """Median of a sorted array."""
    return (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2


def rolling_scale(value: Column, rows: int) -> Column:
    """1.4826 MAD of the rows around a row; null where fewer than three are known."""
    known = F.sort_array(F.array_agg(value).over(ordered().rowsBetween(-(rows // 2), rows // 2)))
    away = F.transform(F.array(known), lambda v: F.sort_array(F.transform(v, lambda x: F.abs(x - half(v)))))
    return F.get(F.transform(away, lambda d: F.when(F.size(d) >= 3, 1.4826 * half(d))), F.lit(0))


def floored(scale: Column, floor: Column) -> Column:
    """A rolling scale where it is known and above nought, else the object's median of it."""
    return F.when(scale > 1e-9, scale).otherwise(F.greatest(F.coalesce(floor, F.lit(1.0)), F.lit(1e-6)))


def bridged(mask: Column, gap: int) -> Column:
    """A mask with false runs of up to ``gap`` rows between true ones filled."""
    w = ordered()
    place = F.when(mask, F.col("i"))
    # true rows further away than the gap fill nothing
    before = F.max(place).over(w.rowsBetween(-gap, 0))
    after = F.min(place).over(w.rowsBetween(0, gap))
    return mask | F.coalesce(after - before - 1 <= gap, F.lit(False))


def line_step(df: DataFrame, channels: tuple[str, ...], rows: int) -> DataFrame:
    """Adds ``step_<channel>``: lines through the rows before and after a row, compared at the row after it.

    Known where all rows of both sides are there and at least three values of
    each; a side at one time counts by its mean.
    """
    near = ordered().rowsBetween(-rows, rows)
    around = {f"__near_{c}": F.array_agg(F.coalesce(c, F.lit(float("nan")))).over(near) for c in ("x", *channels)}
    full = (F.col("i") > rows) & (F.col("n") - F.col("i") > rows)
    steps = _line_steps(channels, rows)(*(F.when(full, F.col(c)) for c in around))
    return df.withColumns(around).withColumn("__steps", steps).withColumns({f"step_{c}": F.col(f"__steps.{c}") for c in channels}).drop(*around, "__steps")


def _line_steps(channels: tuple[str, ...], rows: int):
    """The steps of many rows at once, from the times and the channels' values (NaN: unknown) of ``2 rows + 1`` rows around each; null where these are null."""

    def steps(times: pa.Array, *values: pa.Array) -> pa.Array:
        use = np.flatnonzero(times.is_valid().to_numpy(zero_copy_only=False))
        table = lambda v: v.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * rows + 1)
        out = np.full((len(values), len(times)), np.nan)
        out[:, use] = signals.steps_around(table(times), [table(v) for v in values], rows)
        return pa.StructArray.from_arrays([pa.array(v, pa.float64(), from_pandas=True) for v in out], names=list(channels))

    return F.arrow_udf(steps, ", ".join(f"{c} double" for c in channels))


#: What ``detect`` says of a row.
JUDGED = tuple(f"{k}_{f}" for f in FAMILIES for k in "me")
AROUND = ("m_anomaly", "e_anomaly", "p_filtered", "p_smoothed", "p_predicted", "energy_step", "plane_step", "d1_sma", "bstar", "sustained", "upkeep", "cadence", "cadence_cv", *(f"{side}_{c}" for c in ("sma", "inc") for side in ("pre", "post")))
#: What ``segments`` asks of a run of supported rows.
RUN = ", ".join(
    (
        "segment long, first_row int, last_row int, t_start long, t_end long, support_points long",
        *(f"m_{f} boolean, e_{f} double, a_{f} double" for f in FAMILIES),
        *(f"{c} double" for c in ("prominence", "anomaly_score", "cadence", "cadence_cv", "energy_signal", "plane_signal", "bstar_level", "sustained", "upkeep", "slope_day")),
        "t_missed long, missed double, pre_sma double, pre_inc double, post_sma double, post_inc double",
    )
)


def _kind(c: str) -> str:
    return f"{c} {'boolean' if c.startswith('m_') else 'double'}"


def _schema(df: DataFrame, own: tuple[str, ...], rest: str) -> StructType:
    return StructType([*(df.schema[c] for c in own), *StructType.fromDDL(rest).fields])


def _in_order(df: DataFrame) -> DataFrame:
    """Rows of an object follow each other in time, so that functions over batches see whole objects."""
    return df.repartition("object").sortWithinPartitions("object", "t", "rec")


def _panel(panel: DataFrame) -> DataFrame:
    return _in_order(panel.where("object IS NOT NULL AND t IS NOT NULL").select("object", F.col("t").cast("long").alias("t"), "rec", *(F.col(c).cast("double").alias(c) for c in detectors.CHANNELS)))


def _looked_at(rows: pa.Table, n: np.ndarray, cfg: SimpleNamespace, full: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """What the detectors find in a batch of objects, its times and where it has rows."""
    valid = np.arange(n.max()) < n[:, None]
    t = signals.matrix(rows.column("t").to_numpy(), valid)
    x = np.where(valid, (t - t[:, :1]) / SECOND, np.nan)
    own = {c: signals.matrix(signals.number(rows.column(c)), valid) for c in detectors.CHANNELS}
    with np.errstate(all="ignore"):
        return detectors.detect(own, x, n, MU, cfg, full), t, valid


def detect(panel: DataFrame, cfg: Settings = Settings(), full: bool = True) -> DataFrame:
    """The rows with a mask ``m_<family>`` and an evidence ``e_<family>`` of every family and, if ``full``, prominences ``p_<family>``, steps and jumps."""
    names = (*JUDGED, *(AROUND if full else ()))
    schema = _schema(df := _panel(panel), ("object", "t", "rec"), ", ".join(("i int", "n long", *map(_kind, names))))
    arrow, plain = to_arrow_schema(schema), SimpleNamespace(**asdict(cfg))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n in signals.whole_objects(batches):
            found, _, valid = _looked_at(rows, n, plain, full)
            place = np.broadcast_to(np.arange(1, valid.shape[1] + 1), valid.shape)[valid]
            made = [place, np.repeat(n, n), *(found[c][valid] for c in names)]
            columns = [*(rows.column(c).combine_chunks() for c in ("object", "t", "rec")), *(pa.array(v, f.type, from_pandas=True) for v, f in zip(made, list(arrow)[3:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def _any(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c)
    return out


def largest(columns: list[str]) -> Column:
    """The largest of some columns; 0 of none."""
    return F.lit(0.0) if not columns else F.col(columns[0]) if len(columns) == 1 else F.greatest(*columns)


def fuse(found: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Adds ``union`` / ``union_score`` (any mask, largest evidence) and ``weighted_score`` / ``weighted`` (mean by weights beyond a threshold)."""
    total = sum(cfg.weights[f] for f in cfg.families)
    weighted = sum((cfg.weights[f] * F.col(f"e_{f}") for f in cfg.families), F.lit(0.0)) / total
    out = found.withColumns({"union": _any([f"m_{f}" for f in cfg.families]), "union_score": largest([f"e_{f}" for f in cfg.families]), "weighted_score": weighted})
    return out.withColumn("weighted", F.col("weighted_score") >= cfg.weighted_threshold)


# -- segments --------------------------------------------------------------------------
def _runs(df: DataFrame, choices: dict[str, Settings], look: Settings | None) -> DataFrame:
    """``RUN`` of every run of supported rows by each of some settings (``mode``: its name), of a panel in order (``look``: settings of its detectors) or of rows that ``detect`` gave."""
    schema = _schema(df, ("object",), f"mode string, {RUN}")
    arrow, plain = to_arrow_schema(schema), {mode: SimpleNamespace(**asdict(c)) for mode, c in choices.items()}
    own = SimpleNamespace(**asdict(look)) if look else None

    def known(rows: pa.Table, n: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        valid = np.arange(n.max()) < n[:, None]
        value = lambda c: rows.column(c).to_numpy() if c.startswith("m_") else signals.number(rows.column(c))
        return {c: signals.matrix(value(c), valid) for c in (*JUDGED, *AROUND)}, signals.matrix(rows.column("t").to_numpy(), valid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n in signals.whole_objects(batches):
            found, t = _looked_at(rows, n, own)[:2] if own else known(rows, n)
            names = rows.column("object").combine_chunks().take(pa.array(np.cumsum(n) - n))
            for mode, cfg in plain.items():
                with np.errstate(all="ignore"):
                    at, made = detectors.runs(found, t, n, cfg)
                columns = [names.take(pa.array(at)), pa.array([mode] * len(at), pa.string()), *(pa.array(made[f.name], f.type, from_pandas=True) for f in list(arrow)[2:])]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def segments(found: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``scored`` segments of rows that have been looked at by ``detect``; of a panel ``segments_of`` takes one pass."""
    return scored(_runs(_in_order(found), {"": cfg}, None).drop("mode"), cfg)


def segments_of(panel: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``scored`` segments of a panel: rows are looked at and their runs taken in one pass."""
    return scored(_runs(_panel(panel), {"": cfg}, cfg).drop("mode"), cfg)


def scored(own: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Segments of runs of supported rows, with ``accepted`` and ``event_type``.

    The score is 0.42 peak + 0.28 mean evidence + 0.20 prominence + 0.10 share
    of families, damped by the variation of the cadence, and up to 0.10 more
    for a missed prediction.  Short segments need a peak of 0.7; accepted are
    scores beyond the threshold with enough prominence, or peaks of 0.8.
    """
    predicts = "predicted" in cfg.families
    families = F.array_compact(F.array(*(F.when(F.col(f"m_{f}"), F.lit(f)) for f in cfg.families)))
    own = own.withColumns(
        {
            "families": families,
            "consistency": F.size(families) / F.lit(len(cfg.families)),
            "duration_s": (F.col("t_end") - F.col("t_start")) / SECOND,
            "peak_evidence": largest([f"e_{f}" for f in cfg.families]),
            "integrated_evidence": sum((F.col(f"a_{f}") for f in cfg.families), F.lit(0.0)) / len(cfg.families),
        }
    )
    own = own.where((F.col("support_points") >= cfg.least_support) & ((F.col("duration_s") >= cfg.least_seconds) | (F.col("peak_evidence") >= 0.7)))
    base = 0.42 * F.col("peak_evidence") + 0.28 * F.col("integrated_evidence") + 0.20 * F.col("prominence") + 0.10 * F.col("consistency")
    score = base / (1 + F.col("cadence_cv")) + (0.10 * F.least(F.lit(1.0), F.col("missed")) if predicts else 0.0)
    own = own.withColumn("score", score)
    accepted = ((F.col("score") >= cfg.accept_score) & (F.col("prominence") >= cfg.accept_prominence)) | (F.col("peak_evidence") >= 0.8)
    delta = {f"delta_{c}": F.coalesce(F.col(f"post_{c}") - F.col(f"pre_{c}"), F.lit(0.0)) for c in ("sma", "inc")}
    out = own.withColumn("accepted", accepted).withColumns(delta)
    return out.withColumn("event_type", event_type(cfg)).drop(*(f"{k}_{f}" for f in FAMILIES for k in "ma"), *(f"e_{f}" for f in FAMILIES if f not in cfg.families), "missed")


def event_type(cfg: Settings = Settings()) -> Column:
    """The kind of a segment, first rule that holds (fixed values); an anomaly that one family at most supports is an anomaly whatever its kind."""
    c = F.col
    sma, inc, peak = c("delta_sma"), c("delta_inc"), c("peak_evidence")
    odd = c("anomaly_score") >= cfg.anomaly_sigma
    drag = F.coalesce(c("bstar_level"), F.lit(0.0)) > 3e-4
    lost = drag & (c("sustained") > 0.45) & (c("upkeep") < 0.35)
    kind = (
        F.when(odd & (c("consistency") < 0.34), "possible_anomaly")
        .when((sma > 4) & ((F.abs("plane_signal") > 0.8) | (F.abs(inc) > 0.04)) & (peak > 1), "combined_raise_and_plane_change")
        .when((sma > 4) & (c("energy_signal") > 0.6) & (peak > 0.9), "semi_major_axis_raise")
        .when((F.abs(inc) > 0.035) & (F.abs("plane_signal") > 0.7) & (F.abs(sma) < 6), "inclination_change")
        .when((sma < -4) & (c("energy_signal") < -0.5), F.when(lost, "possible_disposal_start").otherwise("semi_major_axis_lower"))
        .when(((sma > 3) | (c("slope_day") > 0.25)) & (peak > 0.5), "semi_major_axis_raise")
        .when(((sma < -3) | (c("slope_day") < -0.25)) & (peak > 0.5), F.when(drag, "possible_disposal_start").otherwise("semi_major_axis_lower"))
        .when((F.abs(inc) > 0.05) & (peak > 0.5), "inclination_change")
        .when((F.abs(sma) <= 3.5) & (F.abs(inc) <= 0.03) & (c("upkeep") >= 0.4) & (peak >= 0.8), "possible_stationkeeping")
        .when(odd, "possible_anomaly")
        .otherwise("unknown_event")
    )
    return F.when(odd & (F.size("families") <= 1), "possible_anomaly").otherwise(kind)


# -- events ----------------------------------------------------------------------------
def timed(own: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Adds the estimated time of a segment's event and its bounds (microseconds)."""
    cadence = F.greatest(F.lit(900.0), F.coalesce("cadence", F.lit(6.0 * HOUR)))
    middle_t = F.col("t_start") + (F.col("t_end") - F.col("t_start")) / 2
    at = F.least(middle_t, F.coalesce("t_missed", "t_start")) - cfg.lag_seconds * SECOND
    lower = F.col("t_start") - (cfg.lag_seconds + 0.5 * cadence) * SECOND
    upper = F.col("t_end") + (0.5 * cadence - 0.25 * cfg.lag_seconds) * SECOND
    out = own.withColumns({"t_event": at, "__low": lower, "__high": upper, "__c": cadence * SECOND})
    crossed = F.col("__high") < F.col("__low")
    whole_us = lambda x: F.round(x).cast("long")
    return out.withColumns(
        {
            "t_lower": whole_us(F.when(crossed, F.col("t_event") - F.col("__c")).otherwise(F.col("__low"))),
            "t_upper": whole_us(F.when(crossed, F.col("t_event") + F.col("__c")).otherwise(F.col("__high"))),
            "t_event": whole_us(F.col("t_event")),
        }
    ).drop("__low", "__high", "__c")


MERGED = ("t_event", "t_start", "t_end", "t_lower", "t_upper", "event_type", "score", "peak_evidence", "integrated_evidence", "prominence", "families")


def merge_events(events: DataFrame, cfg: Settings = Settings(), by: str = "overlap") -> DataFrame:
    """Events of an object (columns ``MERGED``) merged one after another in time, the higher score kept with the union of both.

    An event joins the merged one before it if its segment starts (``by`` =
    ``overlap``) or it happens (``spacing``) within a day of it, three days if
    either is station-keeping.  The merged event decides about the next, so
    events are folded; a chain is cut where even the latest end so far is
    further away than any spacing, and chains are folded each on its own.
    """
    if by not in ("overlap", "spacing"):
        raise ValueError("by must be overlap or spacing")
    w = Window.partitionBy("object").orderBy("t_event", "t_start", "t_end", "score")
    reach = F.col("t_end") if by == "overlap" else F.col("t_event")
    start = F.col("t_start") if by == "overlap" else F.col("t_event")
    longest = int(max(cfg.spacing_seconds, cfg.upkeep_spacing_seconds) * SECOND)
    cut = F.coalesce(start > F.max(reach).over(w.rowsBetween(Window.unboundedPreceding, -1)) + longest, F.lit(False))
    placed = events.where("object IS NOT NULL AND t_event IS NOT NULL").withColumn("__cut", cut.cast("int"))
    placed = placed.withColumn("chain", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct("t_event", "t_start", "t_end", "score", *(c for c in MERGED if c not in ("t_event", "t_start", "t_end", "score")), F.lit(1).cast("long").alias("n_merged"))
    chains = placed.groupBy("object", "chain").agg(F.array_sort(F.collect_list(row)).alias("all"))

    def joined(a: Column, b: Column) -> Column:
        base = lambda f: F.when(b["score"] > a["score"], b[f]).otherwise(a[f])
        made = {f: base(f) for f in ("t_event", "event_type", "score")}
        made |= {f: F.least(a[f], b[f]) for f in ("t_start", "t_lower")} | {f: F.greatest(a[f], b[f]) for f in ("t_end", "t_upper", "peak_evidence", "integrated_evidence", "prominence")}
        made |= {"families": F.array_sort(F.array_union(a["families"], b["families"])), "n_merged": a["n_merged"] + b["n_merged"]}
        return F.struct(*(made[f].alias(f) for f in ("t_event", "t_start", "t_end", "score", *(c for c in MERGED if c not in ("t_event", "t_start", "t_end", "score")), "n_merged")))

    def step(state: Column, event: Column) -> Column:
        last = state["last"]
        upkeep = (event["event_type"] == "possible_stationkeeping") | (last["event_type"] == "possible_stationkeeping")
        spacing = F.when(upkeep, int(max(cfg.spacing_seconds, cfg.upkeep_spacing_seconds) * SECOND)).otherwise(int(cfg.spacing_seconds * SECOND))
        near = event["t_start"] <= last["t_end"] + spacing if by == "overlap" else event["t_event"] - last["t_event"] <= spacing
        near = F.coalesce(near, F.lit(False))
        return F.struct(F.when(near, state["done"]).otherwise(F.array_append(state["done"], last)).alias("done"), F.when(near, joined(last, event)).otherwise(event).alias("last"))

    begin = F.struct(F.slice("all", 1, 0).alias("done"), F.get("all", F.lit(0)).alias("last"))
    folded = F.aggregate(F.slice("all", F.lit(2), F.size("all")), begin, step, lambda s: F.array_append(s["done"], s["last"]))
    out = chains.select("object", F.explode(folded).alias("e")).select("object", *(f"e.{c}" for c in MERGED), "e.n_merged")
    return out.withColumn("uncertainty_s", (F.col("t_upper") - F.col("t_lower")) / (2 * SECOND))


def events(panel: DataFrame, cfg: Settings = Settings(), by: str = "overlap") -> DataFrame:
    """Merged events of every object of a panel, with ``quality`` (accepted, high confidence, or screened as an anomaly) and a score from 0 to 1."""
    return events_of(segments_of(panel, cfg), cfg, by)


def events_of(own: DataFrame, cfg: Settings = Settings(), by: str = "overlap") -> DataFrame:
    """Merged events of scored segments."""
    out = merge_events(timed(own.where("accepted"), cfg), cfg, by).withColumn("event_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / 2)))
    quality = F.when(F.col("event_type") == "possible_anomaly", "anomaly_screened").when(F.col("score") >= cfg.high_confidence, "accepted_high_confidence").otherwise("accepted")
    return out.withColumn("quality", quality)


# -- known events ----------------------------------------------------------------------
#: Detectors that are held against each other, and all of them together.
ABLATIONS = {"local_only": ("local",), "smoothed_only": ("smoothed",), "predicted_only": ("predicted",), "filtered_only": ("filtered",), "fused": FAMILIES}


def inject(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """``panel`` with planted events: ``schedule`` has ``object``, ``t_at``, ``mode``, ``delta_sma``, ``delta_inc``, ``points`` and ``set_bstar``.

    From ``t_at`` on a step adds its deltas in full; a slope lets them grow
    evenly over ``points`` rows.  ``set_bstar`` (if it is not null) is the drag
    term from then on, of several the one planted last in time.  Events add up.
    Rows without an object or a time, and objects without a schedule, stay as
    they are.  An object's schedule is short: rows meet each of its events.
    """
    w = Window.partitionBy("object").orderBy("t", "rec")
    rows = panel.withColumn("__i", F.row_number().over(w))
    items = schedule.where("object IS NOT NULL AND t_at IS NOT NULL").select(F.col("object").alias("__o"), "t_at", "mode", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("delta_sma", "delta_inc")), F.greatest(F.coalesce("points", F.lit(5)), F.lit(1)).alias("points"), "set_bstar")
    items = items.withColumn("__e", F.monotonically_increasing_id())
    hit = rows.select("object", "__i", "t").join(items, (F.col("object") == F.col("__o")) & (F.col("t") >= F.col("t_at")))
    own = Window.partitionBy("__o", "__e")
    place, length = F.col("__i") - F.min("__i").over(own), F.least("points", F.count("*").over(own))
    ramp = F.when(place >= length, 1.0).when(length == 1, 0.0).otherwise(place / (length - 1))
    hit = hit.withColumn("share", F.when(F.lower("mode") == "slope", ramp).otherwise(1.0))
    added = hit.groupBy(F.col("object").alias("__o"), F.col("__i").alias("__j")).agg(
        F.sum(F.col("delta_sma") * F.col("share")).alias("__a"), F.sum(F.col("delta_inc") * F.col("share")).alias("__b"), F.max(F.when(F.col("set_bstar").isNotNull(), F.struct("t_at", "set_bstar"))).alias("__d")
    )
    out = rows.join(added, (F.col("object") == F.col("__o")) & (F.col("__i") == F.col("__j")), "left")
    new = {"sma": F.col("sma") + F.coalesce("__a", F.lit(0.0)), "inc": F.col("inc") + F.coalesce("__b", F.lit(0.0)), "bstar": F.coalesce("__d.set_bstar", "bstar")}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in panel.columns))


def evaluated(found: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """One row: ``tp``, ``fp``, ``fn``, ``precision``, ``recall``, ``f1``, lags in seconds and ``same_type`` of events (``object``, ``t_event``, ``event_type``) held against true ones.

    True events of an object take, in the order of their times, the nearest
    event that is still free within ``tolerance`` microseconds.  Without any
    event on either side all rates are 1; without true ones the recall is 1;
    lags are null where nothing matches.
    """
    side = lambda df, name: df.where("object IS NOT NULL AND t_event IS NOT NULL").select("object", F.col("t_event").alias("t"), F.lit(name).alias("side"))
    pairs = greedy_matches(side(truth, "truth").unionByName(side(found, "found")), tolerance)
    kinds = lambda df, t, name: df.groupBy(F.col("object").alias(f"__{name}"), F.col("t_event").alias(f"__t{name}")).agg(F.min("event_type").alias(name))
    pairs = pairs.join(kinds(found, "t", "as_found"), (F.col("object") == F.col("__as_found")) & (F.col("t_found") == F.col("__tas_found")), "left")
    pairs = pairs.join(kinds(truth, "t", "as_true"), (F.col("object") == F.col("__as_true")) & (F.col("t_truth") == F.col("__tas_true")), "left")
    lag = F.when(F.col("kind") == "tp", (F.col("t_found") - F.col("t_truth")) / SECOND)
    sums = pairs.agg(
        *(F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")), F.count_if((F.col("kind") == "tp") & (F.col("as_found") == F.col("as_true"))).alias("same_type"),
        F.avg(lag).alias("lag_mean_s"), F.percentile(lag, F.lit(0.5)).alias("lag_median_s"), F.percentile(F.abs(lag), F.lit(0.95)).alias("lag_abs_p95_s"),
    )
    found_any, true_any = F.col("tp") + F.col("fp") > 0, F.col("tp") + F.col("fn") > 0
    sums = sums.withColumn("precision", F.when(found_any, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.when(true_any, 0.0).otherwise(1.0)))
    sums = sums.withColumn("recall", F.when(true_any, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return sums.select("tp", "fp", "fn", "precision", "recall", f1.alias("f1"), "same_type", "lag_mean_s", "lag_median_s", "lag_abs_p95_s")


def ablation(panel: DataFrame, truth: DataFrame, tolerance: int, cfg: Settings = Settings()) -> DataFrame:
    """``evaluated`` of each of ``ABLATIONS`` as ``mode``: the rows are looked at once and judged by each choice of families in the same pass; runs are stored, not rows."""
    choices = {mode: replace(cfg, families=families) for mode, families in ABLATIONS.items()}
    found = stored(_runs(_panel(panel), choices, cfg))
    out = None
    for mode, own in choices.items():
        runs = found.where(F.col("mode") == mode).drop("mode")
        one = evaluated(events_of(scored(runs, own), own), truth, tolerance).select(F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.unionByName(one)
    return out
