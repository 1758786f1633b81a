"""The panel pipeline: quality control, dedup, bins, roll-ups, transitions, events, states.

Configuration is a nested dict merged over the defaults; every stage is lazy,
and a result holds DataFrames that share the stages before them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.operators import kernels, occupancy, phases, quality, series
from epochal.sources.tables import DAY

DEFAULTS: dict[str, Any] = {
    "quality": {"enabled": True, "highest": 500.0},
    "dedup": {"enabled": True, "keep": "last", "bucket": DAY // 24},
    "bins": {"edges": [0.0, 10.0, 20.0, 40.0, 80.0], "width": 7 * DAY},
    "events": {"threshold": 3.5, "spacing_days": 1.0},
    "states": {"change_cost": 0.65, "least_dwell_days": 21.0},
}


def deep_update(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """A new dict: nested dicts are merged, other values replaced; neither input is changed."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_update(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


@dataclass(frozen=True)
class Result:
    panel: DataFrame
    rejected: DataFrame
    occupancy: DataFrame
    transitions: DataFrame
    events: DataFrame
    states: DataFrame
    intervals: DataFrame
    config: dict[str, Any] = field(default_factory=dict)


def run(panel: DataFrame, config: Mapping[str, Any] | None = None) -> Result:
    """``panel``: ``object``, ``t``, ``value``, ``rec`` (missing columns are an error)."""
    cfg = deep_update(DEFAULTS, config or {})
    if missing := {"object", "t", "value", "rec"} - set(panel.columns):
        raise KeyError(f"the panel has no {sorted(missing)}")
    rules = {}
    if cfg["quality"]["enabled"]:
        rules = {"no_object": F.col("object").isNull(), "no_time": F.col("t").isNull(), "no_value": ~quality.finite(F.col("value")), "too_high": F.col("value") > cfg["quality"]["highest"]}
    judged = quality.reject_reasons(panel, rules) if rules else panel.withColumn("reasons", F.lit(""))
    good = judged.where("reasons = ''").drop("reasons")
    if cfg["dedup"]["enabled"]:
        order = F.desc("rec") if cfg["dedup"]["keep"] == "last" else F.asc("rec")
        good = quality.keep_one(good.withColumn("__b", F.floor(F.col("t") / cfg["dedup"]["bucket"])), ["object", "__b"], [order]).drop("__b")
    good = good.withColumn("shell", occupancy.cut(F.col("value"), cfg["bins"]["edges"]))
    states = kernels.label_states(good, phases.Rules(**cfg["states"]))
    intervals = series.runs(states, F.col("state")).groupBy("object", "run").agg(F.first("state").alias("state"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n_records"))
    return Result(
        panel=good,
        rejected=judged.where("reasons <> ''"),
        occupancy=occupancy.occupancy(good, cfg["bins"]["width"]),
        transitions=occupancy.transitions(good),
        events=kernels.detect_events(good, **cfg["events"]),
        states=states,
        intervals=intervals,
        config=cfg,
    )
