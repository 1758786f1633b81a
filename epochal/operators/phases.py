"""Mission phases of an object's records: emission scores, the cheapest path of states, and a least dwell.

Scores are column expressions.  The path is a min-plus product over a series:
chunks of ``CHUNK`` records are reduced to one matrix of states by states each,
matrices of an object are composed in order, and each chunk is then walked
back between the states that it starts from and ends in.  So a task holds a
batch of chunks, or one matrix a chunk of an object, never an object's records.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from epochal.operators.series import ordered, runs

# The states in the order of their scores, and costs of changing from one to another.
STATES = ("unknown", "insertion_or_orbit_raise", "transition", "operational_shell", "relocation", "disposal_lowering", "passive_decay", "likely_nonoperational")
PENALTIES = {
    ("insertion_or_orbit_raise", "operational_shell"): 0.12,
    ("transition", "operational_shell"): 0.16,
    ("operational_shell", "relocation"): 0.45,
    ("relocation", "operational_shell"): 0.20,
    ("operational_shell", "disposal_lowering"): 0.65,
    ("disposal_lowering", "passive_decay"): 0.1,
    ("passive_decay", "likely_nonoperational"): 0.1,
    ("likely_nonoperational", "operational_shell"): 1.1,
    ("disposal_lowering", "operational_shell"): 0.95,
}
HARD_JUMPS = tuple((s, "insertion_or_orbit_raise") for s in ("disposal_lowering", "passive_decay", "likely_nonoperational"))
CHUNK = 256


@dataclass(frozen=True)
class Rules:
    """Thresholds of the phase model."""

    least_records: int = 10
    raise_slope: float = 0.2
    operational_variation: float = 8.0
    operational_support: float = 1.2
    high_drag: float = 3e-4
    insertion_entry: float = 0.65
    relocation_entry: float = 0.8
    disposal_entry: float = 0.9
    decay_entry: float = 0.85
    change_cost: float = 0.65
    jump_scale: float = 1.2
    least_dwell_days: float = 21.0

    def penalties(self) -> np.ndarray:
        """Cost of each change of state, rows from, columns to."""
        out = np.full((len(STATES), len(STATES)), self.change_cost)
        np.fill_diagonal(out, 0.0)
        for (a, b), cost in [*PENALTIES.items(), *((jump, 2 * self.jump_scale) for jump in HARD_JUMPS)]:
            out[STATES.index(a), STATES.index(b)] = cost
        return out


#: What a record is scored by; a missing value (or column) is 0, a missing variation the object's median.
INPUTS = ("slope", "variation", "drag", "event_rate", "shell_residual", "shell_drift", "evidence", "upkeep_rate", "upkeep_regularity", "upkeep_loss")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def emissions(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Adds ``emission``: of each state in order a score; a record's scores sum to 1.

    ``df`` has ``object`` and any of ``INPUTS``.
    """
    rules = rules or Rules()
    given = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) if c in df.columns else F.lit(None).cast("double") for c in INPUTS}
    rows = df.withColumns({f"__{c}": v for c, v in given.items()})
    middle = rows.groupBy(F.col("object").alias("__o")).agg(F.percentile(F.abs("__variation"), F.lit(0.5)).alias("__middle"))
    rows = rows.join(middle, F.col("object").eqNullSafe(F.col("__o")), "left")
    x = {c: F.coalesce(f"__{c}", F.lit(0.0)) for c in INPUTS}
    slope, evidence, loss = x["slope"], x["evidence"], x["upkeep_loss"]
    variation = F.coalesce("__variation", "__middle", F.lit(5.0))
    stable = clip(1 - F.abs(slope) / 0.16, 0, 1)
    support = clip(0.25 + x["upkeep_regularity"] + 0.35 * F.tanh(x["upkeep_rate"]), 0, 1.6)
    descending, drag = clip((-slope - 0.08) / 0.6, 0, 1), clip(x["drag"] / rules.high_drag, 0, 2)
    entered = lambda score, least, share: F.when(score >= least, score).otherwise(share * score)
    relocation = F.abs(x["shell_residual"]) / 25 + 0.7 * evidence + 0.4 * x["event_rate"] - 0.5 * x["upkeep_regularity"] - 0.8 * descending - 0.35 * clip(drag, 0, 1.5)
    not_working = clip(0.55 * loss + 0.35 * drag + 0.30 * descending - 0.45 * stable, 0, 1.8)
    scores = (
        F.lit(0.05),
        clip((slope - rules.raise_slope) / 0.8, 0, 1) * clip(0.5 + evidence, 0, 1.8),
        clip(0.55 * x["event_rate"] + 0.35 * evidence + 0.10 * F.abs(x["shell_drift"]), 0, 1),
        clip(stable * clip(1 - variation / max(1e-6, rules.operational_variation), 0, 1) * support * clip(1 - 0.8 * loss, 0.2, 1) * max(0.5, rules.operational_support), 0, 2),
        entered(clip(relocation, 0, 2), rules.relocation_entry, 0.25),
        entered(clip(0.7 * descending + 0.45 * drag + 0.25 * evidence + 0.25 * loss, 0, 2.2), rules.disposal_entry, 0.2),
        entered(clip(0.8 * descending + 0.5 * loss + 0.25 * drag - 0.45 * evidence, 0, 2), rules.decay_entry, 0.25),
        F.when(not_working > 0.7, not_working).otherwise(0.25 * not_working),
    )
    raw = rows.withColumn("__raw", F.array(*(F.greatest(s, F.lit(1e-6)) for s in scores)))
    total = F.aggregate("__raw", F.lit(0.0), lambda s, v: s + v)
    return raw.withColumn("__total", total).withColumn("emission", F.transform("__raw", lambda v: v / F.col("__total"))).select(*[c for c in df.columns if c != "emission"], "emission")


def _walkers(move: np.ndarray):
    """Two column functions over chunks of flattened emissions: the matrix of least costs, and the least path between two states.

    All chunks of a block are folded at once, a record of each at a time; they
    are made here so that workers need no import of this module.
    """
    k, block = len(move), 64

    def blocks(flat):
        """Costs as (chunks, records, states), padded, with each chunk's records, some chunks at a time."""
        for start in range(0, len(flat), block):
            own = [-np.log(np.clip(np.asarray(x, dtype=float).reshape(-1, k), 1e-9, 1.0)) for x in flat.iloc[start : start + block]]
            size = np.array([len(x) for x in own])
            cost = np.zeros((len(own), size.max(), k))
            for i, x in enumerate(own):
                cost[i, : len(x)] = x
            yield start, cost, size

    def matrices(flat: pd.Series, first: pd.Series) -> pd.Series:
        out = []
        for start, cost, size in blocks(flat):
            opens = first.iloc[start : start + len(size)].to_numpy(dtype=bool)
            total = np.where(opens[:, None, None], 0.0, move[None]) + cost[:, 0][:, None]
            for i in range(1, cost.shape[1]):
                new = (total[:, :, :, None] + move[None, None]).min(2) + cost[:, i][:, None]
                total = np.where((i < size)[:, None, None], new, total)
            out += list(total.reshape(len(size), k * k))
        return pd.Series(out)

    def paths(flat: pd.Series, enter: pd.Series, leave: pd.Series) -> pd.Series:
        out = []
        for start, cost, size in blocks(flat):
            n, at = cost.shape[1], slice(start, start + len(size))
            came, ends = enter.iloc[at].to_numpy(dtype=int), leave.iloc[at].to_numpy(dtype=int)
            best = cost[:, 0] + np.where((came < 0)[:, None], 0.0, move[np.maximum(came, 0)])
            back = np.zeros((len(size), n, k), dtype=np.int8)
            for i in range(1, n):
                total = best[:, :, None] + move[None]
                back[:, i] = total.argmin(1)
                best = np.where((i < size)[:, None], total.min(1) + cost[:, i], best)
            path = np.zeros((len(size), n), dtype=int)
            now = ends.copy()
            rows = np.arange(len(size))
            for i in range(n - 1, -1, -1):
                now = np.where(i == size - 1, ends, now)
                path[:, i] = now
                now = np.where(i < size, back[rows, i, now], now)
            out += [path[j, :m] for j, m in enumerate(size)]
        return pd.Series(out)

    return F.pandas_udf(matrices, ArrayType(DoubleType())), F.pandas_udf(paths, ArrayType(IntegerType()))


def cheapest_path(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``object``, ``t``, ``rec``, ``state`` and ``score`` of each record with an ``emission``: the path of least cost.

    Objects of fewer than ``least_records`` records are ``unknown``, with the
    score of that state; rows without an object take no part.
    """
    rules = rules or Rules()
    move = rules.penalties()
    k = len(STATES)
    matrix_of, path_of = _walkers(move)
    placed = df.where("object IS NOT NULL").select("object", "t", "rec", "emission", (F.row_number().over(ordered()) - 1).alias("i")).withColumn("c", F.floor(F.col("i") / CHUNK))
    chunks = placed.groupBy("object", "c").agg(F.array_sort(F.collect_list(F.struct("i", "t", "rec", "emission"))).alias("rows"))
    chunks = chunks.withColumn("flat", F.flatten(F.transform("rows", lambda r: r["emission"])))
    # matrices of an object's chunks, composed in order: the best way into each chunk's end, then back from the last
    parts = chunks.select("object", "c", F.size("rows").alias("n"), matrix_of("flat", F.col("c") == 0).alias("m"))
    held = parts.groupBy("object").agg(F.array_sort(F.collect_list(F.struct("c", "n", "m"))).alias("parts"))
    ends_of = _composed(k)
    ends = held.select("object", F.aggregate("parts", F.lit(0), lambda a, p: a + p["n"]).alias("records"), F.posexplode(ends_of(F.flatten(F.transform("parts", lambda p: p["m"])))).alias("c", "leave"))
    before = F.lag("leave").over(Window.partitionBy("object").orderBy("c"))
    ends = ends.withColumns({"enter": F.coalesce(before, F.lit(-1)), "c": F.col("c").cast("long")})
    walked = chunks.join(ends, ["object", "c"]).withColumn("path", path_of("flat", "enter", "leave"))
    short = F.col("records") < rules.least_records
    each = walked.select("object", short.alias("short"), F.explode(F.arrays_zip("rows", "path")).alias("z"))
    state = F.when(F.col("short"), 0).otherwise(F.col("z.path"))
    return each.select("object", F.col("z.rows.t").alias("t"), F.col("z.rows.rec").alias("rec"), F.get(F.array(*map(F.lit, STATES)), state).alias("state"), F.get(F.col("z.rows.emission"), state).alias("score"))


def _composed(k: int):
    """The state that each chunk of an object ends in, from the matrices of its chunks one after another."""

    def ends(flat: pd.Series) -> pd.Series:
        out = []
        for x in flat:
            parts = np.asarray(x, dtype=float).reshape(-1, k, k)
            best, back = parts[0][0], []
            for part in parts[1:]:
                total = best[:, None] + part
                back.append(total.argmin(0))
                best = total.min(0)
            at = [int(best.argmin())]
            for came in back[::-1]:
                at.append(int(came[at[-1]]))
            out.append(at[::-1])
        return pd.Series(out)

    return F.pandas_udf(ends, ArrayType(IntegerType()))


def least_dwell(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Runs of states shorter than ``least_dwell_days`` become the state on both sides of them, or ``transition``.

    A run stays if its mean score says that its phase was entered; ``unknown``
    and ``transition`` stay.  Runs are looked at in order, each with what the
    one before has become: a task folds an object's runs, not its records.
    """
    rules = rules or Rules()
    entry = {"insertion_or_orbit_raise": rules.insertion_entry, "disposal_lowering": rules.disposal_entry, "passive_decay": rules.decay_entry}
    numbered = runs(df, F.col("state"))
    spans = numbered.groupBy("object", "run").agg(F.first("state").alias("state"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.avg("score").alias("score"))
    least = F.lit(None).cast("double")
    for state, score in entry.items():
        least = F.when(F.col("state") == state, F.lit(score)).otherwise(least)
    stays = F.col("state").isin("unknown", "transition") | ((F.col("t1") - F.col("t0")) / 8.64e10 >= rules.least_dwell_days) | F.coalesce(F.col("score") >= least, F.lit(False))
    after = F.lead("state").over(Window.partitionBy("object").orderBy("run"))
    held = spans.withColumns({"stays": stays, "after": after}).groupBy("object").agg(F.array_sort(F.collect_list(F.struct("run", "state", "stays", "after"))).alias("runs"))

    def judge(out: Column, r: Column) -> Column:
        before = F.get(out, F.size(out) - 1)
        between = F.when(F.coalesce(before == r["after"], F.lit(False)) & (before != "unknown"), before).otherwise("transition")
        return F.array_append(out, F.when(r["stays"], r["state"]).otherwise(between))

    settled = held.select("object", F.explode(F.arrays_zip(F.transform("runs", lambda r: r["run"]).alias("run"), F.aggregate("runs", F.array().cast("array<string>"), judge).alias("settled"))).alias("z")).select("object", "z.run", "z.settled")
    return numbered.join(settled, ["object", "run"]).select("object", "t", "rec", F.col("settled").alias("state"), "score")


#: Why a record is in its phase.
RATIONALES = {
    "operational_shell": "stable_altitude_and_regular_maintenance",
    "relocation": "persistent_shell_offset_with_maneuver_support",
    "disposal_lowering": "sustained_descent_and_drag_or_event_support",
    "passive_decay": "prolonged_descent_with_maintenance_loss",
    "likely_nonoperational": "maintenance_loss_and_drag_consistency",
    "insertion_or_orbit_raise": "positive_altitude_slope_with_maneuver_support",
}


@dataclass(frozen=True)
class Overrides:
    """Fixed values of what overrules the path."""

    descent: float = -0.25
    drag: float = 3e-4
    raise_extra: float = 0.15
    raise_slope_strong: float = 0.6
    raise_event_rate: float = 0.04
    raise_evidence: float = 0.2


def mission_phases(df: DataFrame, rules: Rules | None = None, over: Overrides | None = None) -> DataFrame:
    """``object``, ``t``, ``rec``, ``state``, ``score``, ``confidence`` and ``rationale``: path and dwell, then overrides.

    Descent with drag is disposal, a steep or supported ascent is raising (it
    comes after, so it wins), and relocation counts as operational.  The score
    is that of the settled state in the record's emission, confidence its lead
    over the second largest; overrides raise both.  ``df`` has ``INPUTS`` and
    one row a record (``object``, ``t``, ``rec``); of rows alike in these three
    each gets its label from the same path.
    """
    rules, over = rules or Rules(), over or Overrides()
    scored = emissions(df, rules)
    path = cheapest_path(scored, rules)
    raw = path.withColumnRenamed("state", "raw").drop("score")
    settled = least_dwell(path, rules).drop("score")
    keys = ["object", "t", "rec"]
    known = scored.where("object IS NOT NULL").join(settled, keys).join(raw, keys)
    given = lambda c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    short = F.count("*").over(Window.partitionBy("object")) < rules.least_records
    known = known.withColumn("short", short)
    at = F.array_position(F.array(*map(F.lit, STATES)), F.col("state")).cast("int") - 1
    own, second = F.get("emission", at), F.get(F.sort_array("emission", asc=False), F.lit(1))
    known = known.withColumns({"score": own, "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), own - second))})
    slope = given("slope")
    disposal = (slope <= over.descent) & (given("drag") >= max(over.drag, 0.9 * rules.high_drag))
    strong = slope >= max(over.raise_slope_strong, rules.raise_slope + over.raise_extra)
    backed = (F.col("raw") == "insertion_or_orbit_raise") | (given("event_rate") >= over.raise_event_rate) | (given("evidence") >= over.raise_evidence)
    raised = strong | ((slope >= rules.raise_slope) & backed)

    def overruled(rows: DataFrame, when: Column, state: str, score: float, confidence: float) -> DataFrame:
        rows = rows.withColumn("__now", when & ~F.col("short"))
        pick = lambda c, v: F.when(F.col("__now"), F.greatest(F.col(c), F.lit(v))).otherwise(F.col(c))
        return rows.withColumns({"state": F.when(F.col("__now"), state).otherwise(F.col("state")), "score": pick("score", score), "confidence": pick("confidence", confidence)}).drop("__now")

    known = overruled(known, disposal, "disposal_lowering", 0.85, 0.70)
    known = overruled(known, raised, "insertion_or_orbit_raise", rules.insertion_entry, 0.55)
    known = overruled(known, F.col("state") == "relocation", "operational_shell", 0.65, 0.50)
    why = F.lit("transition_evidence")
    for state, text in RATIONALES.items():
        why = F.when(F.col("state") == state, text).otherwise(why)
    blank = lambda c: F.when(F.col("short"), 0.0).otherwise(F.col(c)).alias(c)
    return known.select(*keys, "state", blank("score"), blank("confidence"), F.when(F.col("short"), "insufficient_history").otherwise(why).alias("rationale"))


def label(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``object``, ``t``, ``rec``, ``state``, ``score``: emissions, cheapest path, least dwell."""
    return least_dwell(cheapest_path(emissions(df, rules), rules), rules)
