"""Peaks of spectra and of grids: topographic prominence, and greedy selection that keeps peaks apart.

A spectrum's bins and a grid's cells are parameters of what made them, so one
spectrum or one grid is an array in its task; spectra and grids spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spectral_peaks(spectrum: DataFrame, top: int = 5, least_prominence: float | None = None, distance: int = 1, keys: tuple[str, ...] = ("object",)) -> DataFrame:
    """``keys``, ``rank``, ``bin``, ``frequency``, ``period``, ``amplitude`` and ``prominence`` of the highest peaks of every spectrum.

    A peak is a bin, or the middle of a run of equal bins, above both
    neighbours; the ends are none.  Its prominence is its height over the
    higher of the lowest bins towards the nearest higher bin (or the end) on
    either side.  Of peaks less than ``distance`` bins apart the higher stays
    (of equal ones the later), then prominence decides, then the ``top``
    highest are taken.  Rows without an amplitude (null or NaN) or frequency
    are left out.
    """
    known = spectrum.where("amplitude IS NOT NULL AND NOT isnan(amplitude) AND frequency IS NOT NULL")
    order = Window.partitionBy(*keys).orderBy("frequency")
    rows = known.withColumns({"__i": F.row_number().over(order) - 1, "__before": F.lag("amplitude").over(order)})
    rows = rows.withColumn("__new", (~F.col("amplitude").eqNullSafe(F.col("__before"))).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(order))
    runs = rows.groupBy(*keys, "__run").agg(F.first("amplitude").alias("a"), F.min("__i").alias("first"), F.max("__i").alias("last"))
    runs = runs.withColumn("mid", F.floor((F.col("first") + F.col("last")) / 2).cast("int"))
    held = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__run", "a", "mid"))).alias("runs"))
    n = F.size("runs")

    def at(i: Column) -> Column:
        return F.get("runs", i)["a"]

    def lowest(side: Column, height: Column) -> Column:
        """The lowest of a side's heights, nearest first, up to one above ``height``."""
        start = F.struct(height.alias("low"), F.lit(False).alias("over"))
        walk = lambda s, r: F.when(s["over"] | (r["a"] > height), F.struct(s["low"].alias("low"), F.lit(True).alias("over"))).otherwise(F.struct(F.least(s["low"], r["a"]).alias("low"), F.lit(False).alias("over")))
        return F.aggregate(side, start, walk, lambda s: s["low"])

    turning = F.filter(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: (i < n - 1) & (at(i) > at(i - 1)) & (at(i) > at(i + 1)))
    found = F.transform(
        turning,
        lambda i: F.struct(
            at(i).alias("a"),
            F.get("runs", i)["mid"].alias("bin"),
            (at(i) - F.greatest(lowest(F.reverse(F.slice("runs", F.lit(1), i)), at(i)), lowest(F.slice("runs", i + 2, n), at(i)))).alias("prominence"),
        ),
    )
    # the highest first, of equal ones the later
    ranked = F.reverse(F.array_sort(found))
    none = F.slice(ranked, 1, 0)
    apart = F.aggregate(ranked, none, lambda kept, p: F.when(F.exists(kept, lambda q: F.abs(q["bin"] - p["bin"]) < distance), kept).otherwise(F.array_append(kept, p)))
    strong = apart if least_prominence is None else F.filter(apart, lambda p: p["prominence"] >= least_prominence)
    out = held.select(*keys, F.posexplode(F.slice(strong, 1, top)).alias("__r", "p"))
    out = out.select(*(F.col(k).alias(f"__{k}") for k in keys), (F.col("__r") + 1).alias("rank"), F.col("p.bin").alias("bin"), F.col("p.a").alias("amplitude"), F.col("p.prominence").alias("prominence"))
    places = rows.select(*keys, "__i", "frequency")
    same = F.col("__i") == F.col("bin")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out.join(places, same).select(*keys, "rank", "bin", "frequency", F.try_divide(F.lit(1.0), F.col("frequency")).alias("period"), "amplitude", "prominence")


def grid_maxima(cells: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells (``i``, ``j``) that none of their eight neighbours exceeds; cells that are missing are below all.

    Every cell tells its neighbours its value, and the largest heard is one
    aggregation with a map-side part; no cell meets more than nine rows.
    """
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    known = cells.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    told = known.select(*keys, F.col("i").alias("__i"), F.col("j").alias("__j"), F.col(value).alias("__v"), F.struct(*known.columns).alias("__row"), F.explode(around).alias("d"))
    own = F.when((F.col("d.a") == 0) & (F.col("d.b") == 0), F.col("__row"))
    heard = told.groupBy(*keys, (F.col("__i") + F.col("d.a")).alias("__x"), (F.col("__j") + F.col("d.b")).alias("__y")).agg(F.max("__v").alias("__most"), F.max(own).alias("__own"))
    return heard.where(F.col("__own").isNotNull() & (F.col(f"__own.{value}") >= F.col("__most"))).select("__own.*")


def hotspots(cells: DataFrame, value: str = "density", top: int = 5, apart_i: int = 2, apart_j: int = 2, around_i: int | None = None, keys: tuple[str, ...] = (), least: float | None = None) -> DataFrame:
    """The ``top`` highest maxima of every grid that stand apart, with ``rank``.

    Maxima are taken from the highest on (of equal ones the smallest ``i``,
    then ``j``); one is left out if a taken one is nearer than both ``apart_i``
    and ``apart_j``, the first axis being a circle of ``around_i`` cells if
    that is given.  ``least`` is how far a maximum must be above the median of
    the grid's cells.
    """
    high = grid_maxima(cells, value, keys)
    if least is not None:
        mid = cells.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("__mid"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"__h.{k}").eqNullSafe(F.col(f"__m.{k}"))
        high = high.alias("__h").join(mid.alias("__m"), same).where(F.col(value) - F.col("__mid") >= least).select("__h.*")
    row = F.struct((-F.col(value)).alias("__v"), "i", "j", F.struct(*high.columns).alias("row"))
    held = high.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("all"))

    def near(a: Column, b: Column) -> Column:
        di = F.abs(a["i"] - b["i"])
        if around_i:
            di = F.least(di, around_i - di)
        return (di < apart_i) & (F.abs(a["j"] - b["j"]) < apart_j)

    pick = lambda kept, c: F.when((F.size(kept) >= top) | F.exists(kept, lambda k: near(k, c)), kept).otherwise(F.array_append(kept, c))
    chosen = F.aggregate("all", F.slice("all", 1, 0), pick)
    out = held.select(F.posexplode(chosen).alias("__r", "c"))
    return out.select("c.row.*", (F.col("__r") + 1).alias("rank"))


def persistence(spots: DataFrame, window: str, around_i: int, near_i: int, near_j: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """How the first hotspot of grids in consecutive windows moves.

    ``drift_i`` (on the circle, in cells) and ``drift_j`` are mean steps from
    window to window, ``share_near`` is the part of the windows with any
    hotspot within (``near_i``, ``near_j``) cells of the first window's first
    one.  A single window has no drift (null).
    """
    order = Window.partitionBy(*keys).orderBy(window)
    lead = spots.where("rank = 1")
    half = around_i / 2
    step = F.pmod(F.col("i") - F.lag("i").over(order) + half, F.lit(float(around_i))) - half
    moved = lead.withColumns({"__di": step, "__dj": F.col("j") - F.lag("j").over(order)})
    drift = moved.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.avg("__di").alias("drift_i"), F.avg("__dj").alias("drift_j"), F.min_by(F.struct("i", "j"), window).alias("__ref"))
    di = F.abs(F.col("i") - F.col("__ref.i"))
    at = (F.least(di, around_i - di) <= near_i) & (F.abs(F.col("j") - F.col("__ref.j")) <= near_j)
    both = spots.join(drift.select(*keys, "__ref"), list(keys)) if keys else spots.join(drift.select("__ref"))
    seen = both.groupBy(*keys, window).agg(F.max(at).alias("__seen")).groupBy(*keys).agg(F.avg(F.col("__seen").cast("double")).alias("share_near"))
    out = drift.drop("__ref")
    return out.join(seen, list(keys)) if keys else out.join(seen)
