"""As-of, range and interval joins that never compare all pairs of an object.

Nearest rows come from one union of both sides, cut into time buckets of each
object: in a bucket the last row before and the first after are carried by
running windows in both directions (linear in the rows), and what lies beyond
it comes from a second window over the ends of buckets, one row a bucket.  So
an object with very many rows is as many tasks as it has buckets.  Range joins
go through time buckets as well.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of both sides that a bucket holds on average over an object's span.
BUCKET_ROWS = 100_000


def _around(both: DataFrame) -> DataFrame:
    """Adds ``__b`` and ``__a``: the last ``__hit`` before each row and the first after it, in the order of ``__t``, ``__side``, ``__rank``."""
    span = both.groupBy("__key").agg(F.count("*").alias("n"), F.min("__t").alias("t0"), F.max("__t").alias("t1"))
    width = F.greatest(F.ceil((F.col("t1") - F.col("t0") + 1) / F.ceil(F.col("n") / F.lit(BUCKET_ROWS))), F.lit(1)).cast("long")
    large = span.where(F.col("n") > BUCKET_ROWS).select(F.col("__key").alias("__k"), width.alias("__w"))
    # rows without a key have no answer: they are only spread
    spread = F.pmod(F.xxhash64("__t", "__rank"), F.lit(64))
    bucket = F.when(F.col("__key").isNull(), spread).when(F.col("__w").isNull(), F.lit(0).cast("long")).otherwise(F.floor(F.col("__t") / F.col("__w")))
    cut = both.join(large, F.col("__key") == F.col("__k"), "left").withColumn("__bucket", bucket).drop("__k", "__w")
    order = [F.col("__t"), F.col("__side"), F.col("__rank").asc_nulls_first()]
    back = [F.col("__t").desc(), F.col("__side").desc(), F.col("__rank").desc_nulls_last()]
    w = Window.partitionBy("__key", "__bucket")
    so_far = (Window.unboundedPreceding, -1)
    near = cut.withColumns({"__b": F.last("__hit", True).over(w.orderBy(*order).rowsBetween(*so_far)), "__a": F.last("__hit", True).over(w.orderBy(*back).rowsBetween(*so_far))})
    # ends of buckets: each one's last and first answer, handed on to the buckets beside it
    place = F.struct("__t", "__side", "__rank", "__hit")
    ends = cut.where("__hit IS NOT NULL").groupBy("__key", "__bucket").agg(F.max(place).alias("high"), F.min(place).alias("low"))
    ends = ends.select(F.col("__key").alias("__k"), F.col("__bucket").alias("__n"), F.col("high.__hit").alias("high"), F.col("low.__hit").alias("low"))
    some = cut.join(large, F.col("__key") == F.col("__k"), "left_semi").select(F.col("__key").alias("__k"), F.col("__bucket").alias("__n")).distinct()
    walk = Window.partitionBy("__k")
    beside = some.join(ends, ["__k", "__n"], "left").select(
        "__k", "__n", F.last("high", True).over(walk.orderBy("__n").rowsBetween(*so_far)).alias("__before"), F.last("low", True).over(walk.orderBy(F.desc("__n")).rowsBetween(*so_far)).alias("__after")
    )
    out = near.join(beside, (F.col("__key") == F.col("__k")) & (F.col("__bucket") == F.col("__n")), "left")
    return out.withColumns({"__b": F.coalesce("__b", "__before"), "__a": F.coalesce("__a", "__after")}).drop("__k", "__n", "__before", "__after")


def nearest(left: DataFrame, right: DataFrame, tolerance: int | None = None, tie: str = "earlier", key: str = "object", time: str = "t", fields: tuple[str, ...] = ("rec", "value")) -> DataFrame:
    """``left`` with the fields of the nearest row of ``right`` as ``near_<field>``, and ``near_t`` (null: none within tolerance).

    At equal distance the earlier or the later row is taken; of rows at one
    time, the last before and the first after by the first field.  A left row
    without a key or a time has no nearest row, and a right one is none.
    """
    if tie not in ("earlier", "later"):
        raise ValueError("tie is 'earlier' or 'later'")
    columns = left.columns
    own = F.struct(F.col(time), *(F.col(f) for f in fields))
    lefts = left.select(F.struct(*columns).alias("__row"), F.col(key).alias("__key"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__rank"))
    rights = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("__key"), F.col(time).alias("__t"), F.lit(0).alias("__side"), F.col(fields[0]).cast("long").alias("__rank"), own.alias("__hit"))
    out = _around(lefts.unionByName(rights, allowMissingColumns=True)).where("__side = 1")
    back, ahead = F.col("__t") - F.col(f"__b.{time}"), F.col(f"__a.{time}") - F.col("__t")
    first = back <= ahead if tie == "earlier" else back < ahead
    hit = F.when(F.col("__a").isNull() | F.coalesce(first, F.lit(False)), F.col("__b")).otherwise(F.col("__a"))
    out = out.select("__row.*", hit.alias("__hit"))
    gap = F.abs(F.col(f"__hit.{time}") - F.col(time))
    ok = gap.isNotNull() if tolerance is None else gap <= tolerance
    return out.select(*columns, F.when(ok, F.col(f"__hit.{time}")).alias(f"near_{time}"), *(F.when(ok, F.col(f"__hit.{f}")).alias(f"near_{f}") for f in fields))


def nearest_intersection(df: DataFrame, first, tolerance: int | None = None, key: str = "object", time: str = "t", rec: str = "rec") -> DataFrame:
    """The epoch of the object ``first`` that all objects come nearest to: ``epoch``, ``key``, ``near_t``, ``near_rec`` and ``worst``, a row an object.

    Candidates are the epochs of one object; each is held against all objects
    (a stated set, so rows are candidates times objects), and the one with the
    least (largest distance, sum of distances, epoch) is taken.  If every
    candidate leaves an object beyond the tolerance there are no rows.
    """
    own = df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    candidates = own.where(F.col(key) == F.lit(first)).select(F.col(time).alias("epoch")).distinct()
    asked = candidates.crossJoin(own.select(key).distinct()).withColumn(time, F.col("epoch"))
    near = nearest(asked, own, tolerance, key=key, time=time, fields=(rec,))
    gap = F.abs(F.col(f"near_{time}") - F.col("epoch"))
    score = near.groupBy("epoch").agg(F.max(gap).alias("worst"), F.sum(gap).alias("total"), F.count_if(gap.isNull()).alias("lost")).where("lost = 0")
    best = score.agg(F.min(F.struct("worst", "total", "epoch")).alias("best")).select(F.col("best.epoch").alias("__e"), F.col("best.worst").alias("worst"))
    return near.join(F.broadcast(best), F.col("epoch") == F.col("__e")).select("epoch", key, f"near_{time}", f"near_{rec}", "worst")


def exact_intersection(df: DataFrame, key: str = "object", time: str = "t", rec: str = "rec") -> DataFrame:
    """The earliest epoch that all objects share, with the last row (by ``rec``) of each object there; no rows if there is none."""
    own = df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = own.groupBy(time, key).agg(F.max(rec).alias(rec))
    shared = rows.groupBy(time).agg(F.count("*").alias("n"))
    objects = own.agg(F.count_distinct(key).alias("all"))
    first = shared.join(F.broadcast(objects)).where("n = all").agg(F.min(time).alias("__e"))
    return rows.join(F.broadcast(first), F.col(time) == F.col("__e")).select(key, time, rec)


def interpolated(left: DataFrame, right: DataFrame, key: str = "object", time: str = "t", value: str = "value") -> DataFrame:
    """``left`` with ``right``'s value on the line between the rows around its time; null outside."""
    columns = left.columns
    lefts = left.select(F.struct(*columns).alias("__row"), F.col(key).alias("__key"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__rank"))
    known = right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    mean = known.groupBy(F.col(key).alias("__key"), F.col(time).alias("__t")).agg(F.avg(value).alias("__v"))  # rows at one time count as their mean
    rights = mean.select("__key", "__t", F.lit(0).alias("__side"), F.struct("__t", "__v").alias("__hit"))
    out = _around(lefts.unionByName(rights, allowMissingColumns=True))
    b, a, t = F.col("__b"), F.col("__a"), F.col("__t")
    line = b["__v"] + (a["__v"] - b["__v"]) * (t - b["__t"]) / (a["__t"] - b["__t"])
    return out.where("__side = 1").select("__row.*", F.when(b["__t"] == t, b["__v"]).otherwise(line).alias(f"interpolated_{value}"))


def in_intervals(points: DataFrame, intervals: DataFrame, bucket: int, key: str = "object", time: str = "t", start: str = "t_start", end: str = "t_end") -> DataFrame:
    """Points joined to the intervals of their key that hold them, both ends included.

    An interval is dealt to every bucket it touches and a point to its own, so
    the join is an equi-join by key and bucket.  Columns of an interval that a
    point has too come out as ``interval_<name>``.
    """
    name = {c: f"interval_{c}" if c in points.columns else c for c in intervals.columns}
    own = intervals.select(*(F.col(c).alias(n) for c, n in name.items()))
    low, high = F.col(name[start]), F.col(name[end])
    own = own.withColumn("__b", F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket))))
    at = points.withColumn("__bucket", F.floor(F.col(time) / bucket))
    hit = (F.col(key) == F.col(name[key])) & (F.col("__bucket") == F.col("__b")) & F.col(time).between(low, high)
    return at.join(own, hit).drop("__b", "__bucket", *([name[key]] if name[key] != key else []))


def nearest_pair(a: DataFrame, b: DataFrame, tolerance: int, time: str = "t", rec: str = "rec") -> DataFrame:
    """The closest pair of rows of two series within a tolerance; ties by middle epoch, then by record numbers."""
    left = a.select(F.col(time).alias("t_a"), F.col(rec).alias("rec_a"))
    right = b.select(F.col(time).alias("t_b"), F.col(rec).alias("rec_b"))
    own = F.floor(F.col("t_a") / tolerance)
    left = left.withColumn("__bucket", F.explode(F.array(own - 1, own, own + 1)))
    right = right.withColumn("__bucket", F.floor(F.col("t_b") / tolerance))
    gap = F.abs(F.col("t_a") - F.col("t_b"))
    pairs = left.join(right, "__bucket").where(gap <= tolerance).drop("__bucket").withColumn("gap", gap)
    return pairs.orderBy("gap", F.col("t_a") + F.col("t_b"), "rec_a", "rec_b").limit(1)


def gaps(intervals: DataFrame, start: int, end: int, least: int, key: str = "object", label: str = "state", fill: str = "coast") -> DataFrame:
    """Intervals clipped to a window, with the time between them as intervals of their own where it is longer than ``least``."""
    cut = intervals.select(key, label, F.greatest("t_start", F.lit(start)).alias("t_start"), F.least("t_end", F.lit(end)).alias("t_end")).where("t_end > t_start")
    w = Window.partitionBy(key).orderBy("t_start", "t_end")
    before = F.coalesce(F.max("t_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(start))
    holes = cut.select(key, F.lit(fill).alias(label), before.alias("t_start"), F.col("t_start").alias("t_end"))
    last = cut.groupBy(key).agg(F.max("t_end").alias("t_start")).select(key, F.lit(fill).alias(label), "t_start", F.lit(end).alias("t_end"))
    return cut.unionByName(holes.unionByName(last).where(F.col("t_end") - F.col("t_start") > least))


def greedy_matches(spark_df: DataFrame, tolerance: int) -> DataFrame:
    """One-to-one matches of detected events to true ones of each object, in the order of truth.

    ``spark_df``: ``object``, ``t``, ``side`` ("truth" or "found").  Each true
    event takes the nearest free detection within tolerance (ties: the
    earlier).  No match can cross a gap of more than the tolerance without any
    event, so an object's events are cut at such gaps and the pieces, which
    are sequential by definition, are dealt to tasks each on its own.  Free
    detections are kept in order with links to the next free ones, so a piece
    takes little more than a sort.  Rows with a null time are left out; those
    without an object are one object.
    """
    import pyarrow as pa

    def match(own: int | None, truth: list[int], found: list[int]) -> Iterator[tuple]:
        n = len(found)
        # of each place the next free one at or after it, and at or before it (shifted by one; 0: none)
        after, before = list(range(n + 1)), list(range(n + 1))

        def free(links: list[int], at: int) -> int:
            root = at
            while links[root] != root:
                root = links[root]
            while links[at] != root:
                links[at], at = root, links[at]
            return root

        taken = [False] * n
        for t in truth:
            place = bisect.bisect_left(found, t)
            right, left = free(after, place), free(before, place) - 1
            best = None
            if left >= 0 and (right == n or t - found[left] <= found[right] - t):
                best = left
            elif right < n:
                best = right
            if best is None or abs(found[best] - t) > tolerance:
                yield own, t, None, "fn"
                continue
            taken[best] = True
            after[best], before[best + 1] = best + 1, best
            yield own, t, found[best], "tp"
        yield from ((own, None, f, "fp") for f, hit in zip(found, taken, strict=True) if not hit)

    schema = pa.schema([("object", pa.int64()), ("t_truth", pa.int64()), ("t_found", pa.int64()), ("kind", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces as they come, sorted; one is held at a time."""
        piece, own, sides = None, None, ([], [])

        def written(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            out = []
            for now, o, t, true in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if now != piece:
                    out += match(own, *sides)
                    piece, own, sides = now, o, ([], [])
                sides[0 if true else 1].append(t)
            if out:
                yield written(out)
        if rest := list(match(own, *sides)):
            yield written(rest)

    w = Window.partitionBy("object").orderBy("t")
    rows = spark_df.select(F.col("object").cast("long").alias("object"), F.col("t").cast("long").alias("t"), "side").where(F.col("t").isNotNull() & F.col("side").isin("truth", "found"))
    cut = F.coalesce((F.col("t") - F.lag("t").over(w) > tolerance).cast("long"), F.lit(0))
    pieces = rows.withColumn("__cut", cut).withColumn("__piece", F.sum("__cut").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    place = F.concat_ws("|", F.coalesce(F.col("object").cast("string"), F.lit("none")), F.col("__piece").cast("string")).alias("__p")
    dealt = pieces.select(place, "object", "t", (F.col("side") == "truth").alias("true")).repartition("__p").sortWithinPartitions("__p", "t")
    return dealt.mapInArrow(walk, "object long, t_truth long, t_found long, kind string")


def match_scores(matches: DataFrame) -> DataFrame:
    """Of each object, and of all (``whole``): counts ``tp``, ``fp``, ``fn``, ``precision``, ``recall``, ``f1``, and mean and median ``latency`` (days from truth to detection).

    A share of nothing is null; so is ``f1`` where nothing was matched and there was nothing to match.
    """
    count = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(k)
    late = (F.col("t_found") - F.col("t_truth")) / 8.64e10
    own = matches.rollup("object").agg((F.grouping("object") == 1).alias("whole"), *map(count, ("tp", "fp", "fn")), F.avg(late).alias("latency_mean"), F.percentile(late, F.lit(0.5)).alias("latency_median"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    return own.withColumns({"precision": share("tp", F.col("tp") + F.col("fp")), "recall": share("tp", F.col("tp") + F.col("fn")), "f1": F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(x, high), low)
