"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are dealt to blocks of bounded size.  In a block, every dimension (term)
has a posting list: the rows where it is not zero, with their weights.  A
batch of queries goes through the terms one after another, adding
``query weight * posting weight`` into dense score arrays; partition selection
keeps each query's best of the block, and a ranked window merges the blocks.

Queries are copied once to every block, block by block in bounded batches; a
task holds one block and one batch.  Blocks are dealt by ranges, several to a
block, so that each has a task of its own.  This is quadratic work by nature (every
query against every row) that spreads over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 1 << 16
LEAST_ROWS = 1 << 11
QUERIES_AT_ONCE = 32
SCALE = 256


def postings(rows: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Of each dimension: rows (None: all) and weights."""
    out: list[tuple[np.ndarray | None, np.ndarray]] = []
    for column in rows.T:
        at = np.flatnonzero(column)
        out.append((None, column.copy()) if len(at) == len(column) else (at, column[at]))
    return out


def accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], rows: int) -> np.ndarray:
    """Scores, queries by rows: one term after another is scattered into them."""
    scores = np.zeros((len(queries), rows), queries.dtype)
    for term, (at, weights) in enumerate(lists):
        if term >= queries.shape[1]:
            break
        for n in np.flatnonzero(queries[:, term]).tolist():
            if at is None:
                scores[n] += queries[n, term] * weights
            else:
                scores[n, at] += queries[n, term] * weights
    return scores


def select(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best that are not the query's own, ties to the earlier position."""
    there = np.flatnonzero(~own)
    if len(there) > k:
        values = scores[there]
        least = np.partition(values, -k)[-k]
        better = there[values > least]
        there = np.concatenate([better, there[values == least][: k - len(better)]])
    return there


FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def _matrix(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) as integers; shorter vectors are zero in the dimensions they lack."""
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    size = np.diff(column.offsets.to_numpy())
    width = int(size.max(initial=0))
    if (size == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = values
    return out


def _stack(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def usable(vector: Column) -> Column:
    """A vector that is not null and holds no null, NaN or infinite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def search(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's ``k`` best other rows.

    Score: integer inner product of floor(256 x).  Ties go to the smaller id;
    fewer than ``k`` other rows: all of them.  Rows with a null id or an
    unusable vector take no part; a row repeated under one id counts as often
    as it is there, but never for a query of that id.  A query id with several
    usable vectors asks with the smallest of them (array order).  Components
    beyond 2**20 or so may overflow 64-bit scores.
    """
    good = rows.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    total = good.count()
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-total // BLOCK_ROWS), min(tasks, -(-total // LEAST_ROWS)))
    # rows of one id may be many: their vectors part them
    data = good.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    asked = good.where("q").groupBy("id").agg(F.min("v").alias("v")).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")
    dealt = data.unionByName(asked).repartitionByRange(4 * blocks, "block").sortWithinPartitions("block", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, ready = None, [], [], None
        for batch in batches:
            block, kind = (batch.column(n).to_numpy(zero_copy_only=False) for n in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if block[a] != now:
                    now, ids, parts, ready = block[a], [], [], None
                own, vectors = part.column(2).to_numpy(zero_copy_only=False), _matrix(part.column(3))
                if kind[a] == 0:
                    ids.append(own)
                    parts.append(vectors)
                    continue
                if not ids:
                    continue
                if ready is None:
                    table, names = _stack(parts), np.concatenate(ids)
                    bound = int(np.abs(table).max(initial=0)) * max(1, table.shape[1])
                    ready = names, len(table), {"int64": postings(table)}, bound
                names, size, lists, bound = ready
                for at in range(0, len(own), QUERIES_AT_ONCE):
                    q = vectors[at : at + QUERIES_AT_ONCE]
                    kind_of = "int32" if bound * int(np.abs(q).max(initial=0)) < 2**31 else "int64"
                    if kind_of not in lists:
                        lists[kind_of] = [(i, w.astype(kind_of)) for i, w in lists["int64"]]
                    scores = accumulate(q.astype(kind_of), lists[kind_of], size)
                    best = [select(s, names == o, k) for s, o in zip(scores, own[at : at + QUERIES_AT_ONCE], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(own[at : at + QUERIES_AT_ONCE], [len(x) for x in best]), pa.int64()),
                            pa.array(np.concatenate([names[x] for x in best]), pa.int64()),
                            pa.array(np.concatenate([s[x] for s, x in zip(scores, best, strict=True)]).astype(np.int64), pa.int64()),
                        ],
                        FOUND.names,
                    )

    found = dealt.mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
