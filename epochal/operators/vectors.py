"""Vectors and their clusters: distances, medoids, silhouettes, core distances.

Distances between rows of one cluster are needed by some of these measures;
a cluster is dealt to blocks and blocks are compared in pairs, so no task
holds a whole cluster and no pair of rows becomes a row of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, at least and at most; between them a table is cut into ``BLOCKS``, so that what is shuffled grows with the table.
BLOCK_ROWS, MOST_ROWS, BLOCKS = 2048, 65_536, 24
#: Rows of the two sides that are compared at once.
TILE = 2048
#: Tasks that block pairs are dealt to, at most.
MOST_TASKS = 20_000


def paired(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def l1(a: Column, b: Column) -> Column:
    return total(paired(a, b, lambda x, y: F.abs(x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(paired(a, b, lambda x, y: (x - y) * (x - y))))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(paired(a, b, lambda x, y: F.abs(x - y)))


def canberra(a: Column, b: Column) -> Column:
    """Coordinates that are both zero count nothing."""
    term = lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0)
    return total(paired(a, b, term))


def braycurtis(a: Column, b: Column) -> Column:
    low = total(paired(a, b, lambda x, y: F.abs(x + y)))
    return F.when(low > 0, l1(a, b) / low)


def centroids(df: DataFrame, cluster: str = "label", vector: str = "v") -> DataFrame:
    """Mean vector of each cluster, coordinate by coordinate (pre-aggregated)."""
    flat = df.select(cluster, F.posexplode(vector).alias("i", "x"))
    means = flat.groupBy(cluster, "i").agg(F.avg("x").alias("m"))
    # a cluster has as many rows here as vectors have coordinates
    return means.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def usable(vector: Column) -> Column:
    """A vector that is not null and holds no null, NaN or infinite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def _rows(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """A matrix of vectors; shorter ones are zero in the coordinates they lack."""
    column = batch.column(at)
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def distance_sums(df: DataFrame, key: str = "vec_id", cluster: str = "label", vector: str = "v", power: float = 1.0, across: bool = True) -> DataFrame:
    """Of each row and cluster: count of its rows and sum of distances (to ``power``) to the others of them.

    Quadratic by definition.  Rows are dealt to blocks (without ``across``
    those of each cluster on their own, as only they count); each unordered pair
    of blocks meets once, and a task holds two blocks at a time.  Zero distances count as zero, also to a
    negative power.  Rows with an unusable vector take no part; shorter vectors
    are zero in the coordinates they lack.
    """
    good = df.where(usable(F.col(vector)))
    groups = [F.col(cluster)] if not across else []
    most = good.groupBy(*groups).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // MOST_ROWS), min(-(-most // BLOCK_ROWS), BLOCKS))
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = good.select(F.col(key).cast("long").alias("id"), F.col(cluster).cast("int").alias("c"), F.col(vector).cast("array<double>").alias("x"), own.alias("b"))
    rows = rows.withColumn("g", F.lit(0) if across else F.col("c"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    dealt = rows.select("*", other).select("g", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("o"), (F.col("b") > F.col("o")).cast("int").alias("side"), "id", "c", "x")
    tasks = min(MOST_TASKS, blocks * (blocks + 1) // 2 * (1 if across else 8))
    dealt = dealt.repartition(tasks, "g", "p", "o").sortWithinPartitions("g", "p", "o", "side")

    def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        size = (x * x).sum(1)[:, None] + (y * y).sum(1)
        d = x @ y.T
        d *= -2
        d += size
        # a product loses what is very near: such distances are taken anew
        size *= 1e-7
        near = np.argwhere(d <= size)
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        for at in range(0, len(near), 4096):
            i, j = near[at : at + 4096].T
            d[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum(1))
        if power != 1:
            some = d > 0
            d[some] **= power
        return d

    def sums(a: tuple, b: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        """Both directions of a pair of blocks (ids, clusters, vectors), tile by tile."""
        width = max(a[2].shape[1], b[2].shape[1])
        sides, found = [], []
        for ids, kinds, x in (a, b):
            order = np.argsort(kinds, kind="stable")
            kinds = kinds[order]
            every, first = np.unique(kinds, return_index=True)
            sides.append((ids[order], kinds, _wide(x, width)[order], every, [*first.tolist(), len(kinds)]))
        for (ids, *_), (*_, every, ends) in (sides, sides[::-1]):
            found.append((np.tile(np.diff(ends), (len(ids), 1)), np.zeros((len(ids), len(every)))))
        (ia, _, xa, ka, ea), (ib, _, xb, kb, eb) = sides
        for i in range(0, len(ia), TILE):
            for j in range(0, len(ib), TILE):
                w = distances(xa[i : i + TILE], xb[j : j + TILE])
                # rows of one id are no pair; they lie in one block
                alike = ia[i : i + TILE, None] == ib[j : j + TILE] if same else None
                if same:
                    w[alike] = 0
                cuts = lambda ends, at: ((c, max(p - at, 0), min(q - at, TILE)) for c, (p, q) in enumerate(zip(ends, ends[1:], strict=False)) if p < at + TILE and q > at)
                for c, p, q in cuts(eb, j):
                    found[0][1][i : i + TILE, c] += w[:, p:q].sum(1)
                    if same:
                        found[0][0][i : i + TILE, c] -= alike[:, p:q].sum(1)
                for c, p, q in () if same else cuts(ea, i):
                    found[1][1][j : j + TILE, c] += w[p:q].sum(0)
        for (ids, own_kinds, *_), every, (n, total_) in ((sides[0], kb, found[0]), (sides[1], ka, found[1]))[: 1 if same else 2]:
            for c, kind in enumerate(every.tolist()):
                use = (n[:, c] > 0) & ((own_kinds == kind) | across)
                if use.any():
                    parts = ids[use], own_kinds[use], np.full(use.sum(), kind), n[use, c], total_[use, c]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(parts, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()], strict=True)], ["id", "own", "other", "n", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            sides = [tuple(np.concatenate(p) for p in (s[0], s[1])) + (np.concatenate([_wide(x, max(y.shape[1] for y in s[2])) for x in s[2]]),) for s in held if s[0]]
            if sides:
                yield from sums(sides[0], sides[-1], now[1] == now[2])

        now, held = None, [([], [], []), ([], [], [])]
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in range(4)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if tuple(keys[a][:3]) != now:
                    if now is not None and (now[1] == now[2] or (held[0][0] and held[1][0])):
                        yield from close()
                    now, held = tuple(keys[a][:3]), [([], [], []), ([], [], [])]
                for into, values in zip(held[keys[a][3]], (part.column(4).to_numpy(), part.column(5).to_numpy(), _rows(part, 6)), strict=True):
                    into.append(values)
        if now is not None and (now[1] == now[2] or (held[0][0] and held[1][0])):
            yield from close()

    parts = dealt.mapInArrow(run, "id long, own int, other int, n long, total double")
    return parts.groupBy("id", "own", "other").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def silhouette(sums: DataFrame) -> DataFrame:
    """Of each row: mean distance to its own cluster, to the nearest other one, and the silhouette."""
    mean = F.col("total") / F.col("n")
    both = sums.groupBy("id", "own").agg(F.max(F.when(F.col("other") == F.col("own"), mean)).alias("a"), F.min(F.when(F.col("other") != F.col("own"), mean)).alias("b"))
    return both.withColumn("silhouette", F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))
