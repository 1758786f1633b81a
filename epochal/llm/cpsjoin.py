"""Near-duplicates by a chosen-path set similarity join.

Documents are sets of word shingles, embedded as minwise tokens.  Equal sets
are one vertex from the start, named by 64 bits of the set's hash (a billion
different sets hold two of one name with a chance of 3 %).  Independent trees
branch the vertices: a node passes each of its members on to children chosen by
the values of two selected minwise tokens, so similar ones meet in some node
with high probability.  Small nodes are compared exhaustively (by sketches,
which only propose families); nodes that are too large branch again, and those
that never get small are compared as described below.  Families of proposed
vertices are then confirmed on their full sets.

Chance of a miss: a pair of similarity ``s`` shares a child by one token with
chance ``s``.  It meets in no node of a tree with ``m = 1 - s + s * q``, where
``q`` is the chance that two tokens a level lead to no common node ``DEPTH``
levels below (``q <- (1 - s + s * q) ** 2`` from 0).  ``trees`` takes as many
trees as make ``m ** trees`` at most ``MISS``.

Within a group (node or family) links are found breadth-first, each member
against those not reached yet, so a large group costs few comparisons and gives
a spanning forest, not all its pairs.  A group larger than a task's limit is
dealt to blocks.  Each block is compared with itself and with the first block;
what is not in the group's largest component after that is compared with all of
the group.  A group of near copies so costs its links, not pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochal.llm import components, storage

#: Chance that a pair at the least similarity meets in no node of any tree.
MISS = 1e-6
#: Minwise tokens of a document; the low byte of each is its sketch.
TOKENS = 128
#: A node of more documents branches again, at most ``DEPTH`` times.
NODE = 2_000
DEPTH = 4
#: Tokens that a node selects for its children.
CHILDREN = 2
#: Sketches propose a pair at so many equal bytes less than the similarity asks for (6 standard deviations).
SLACK = 6.0
#: Documents of a family that are confirmed together.
FAMILY = 1_000
STEP = 256
MAX_WORDS = 500_000
MASK = (1 << 64) - 1


def trees(percent: int, depth: int | None = None) -> int:
    """Trees that a least similarity asks for."""
    apart, q = 1 - percent / 100, 0.0
    for _ in range(DEPTH if depth is None else depth):
        q = (apart + (1 - apart) * q) ** CHILDREN
    return max(1, math.ceil(math.log(MISS) / math.log(max(apart + (1 - apart) * q, 1e-9))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of each text's ``k``-word shingles; fewer words: the whole as one; none: empty."""

    def __init__(self, k: int):
        self.k = k
        self.known: dict[bytes, int] = {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > MAX_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        # bytes.lower() and bytes.split() know A-Z and the six ASCII white-space characters alone
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        flat = self._hashes([w for words in split for w in words])
        out, at = [], 0
        for words in split:
            own = flat[at : at + len(words)]
            at += len(words)
            width = min(self.k, len(own))
            if not width:
                out.append(np.zeros(0, np.uint64))
                continue
            n = len(own) - width + 1
            value = np.full(n, width, np.uint64)
            for i in range(width):
                value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n])
            out.append(np.unique(value))
        return out


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:n] | np.uint64(1), base[n:]


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens of non-empty sets: one row a set."""
    factor, offset = _constants(TOKENS)
    flat = np.concatenate(sets)
    size = np.array([len(s) for s in sets])
    starts = np.cumsum(size) - size
    out = np.empty((len(sets), TOKENS), np.uint64)
    for i in range(TOKENS):
        out[:, i] = np.minimum.reduceat((flat ^ offset[i]) * factor[i], starts)
    return _mix(out)


SKETCHED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_key", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("vertex", T.LongType()),
        T.StructField("roots", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def set_key(own: np.ndarray) -> int:
    """64 bits of a set's hash, signed."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(own.tobytes())
    return value - ((value & (1 << 63)) << 1)


def sketched(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Size of each document's set, its vertex, first tokens and sketch.  ``docs``: ``doc_id``, ``text``, ``text_key``."""
    roots = trees(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(k)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                sets = own.sets(part.column(1).to_pylist())
                full = [n for n, s in enumerate(sets) if len(s)]
                tokens = minwise([sets[n] for n in full]) if full else np.zeros((0, TOKENS), np.uint64)
                row = dict(zip(full, range(len(full)), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) for s in sets], pa.int64()),
                        pa.array([tokens[row[n], :roots].view(np.int64) if n in row else None for n in range(len(sets))], pa.list_(pa.int64())),
                        pa.array([tokens[row[n]].astype(np.uint8).tobytes() if n in row else None for n in range(len(sets))], pa.binary()),
                    ],
                    SKETCHED.names,
                )

    return docs.mapInArrow(run, SKETCHED)


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows that are equal in the first ``width`` columns (of integers), which must be sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in range(width)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = keys[a].tolist()
            if held and key != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held


EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _spread(ids: np.ndarray, near) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest: ``near(n, others)`` tells which of ``others`` are linked with ``n``.

    Breadth-first: every member is held against those not reached yet.
    """
    rest = np.arange(len(ids))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            n = queue.pop()
            hit = near(n, rest)
            found = rest[hit]
            yield from ((int(ids[m]), int(ids[n])) for m in found)
            queue += found.tolist()
            rest = rest[~hit]


def _edges(pairs: Iterator[tuple[int, int]]) -> pa.RecordBatch | None:
    got = list(pairs)
    if not got:
        return None
    return pa.RecordBatch.from_arrays([pa.array([g[n] for g in got], pa.int64()) for n in (0, 1)], EDGES.names)


Near = Callable[[list[bytes]], Callable[[int, np.ndarray], np.ndarray]]


def _compare(dealt: DataFrame, near_of: Near) -> DataFrame:
    """Spanning edges within each (``group``, ``block_a``, ``block_b``) of ``vertex`` and ``data``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _groups(batches, 3):
            table = pa.Table.from_batches(parts)
            ids = table.column(3).to_numpy()
            if len(ids) > 1:
                got = _edges(_spread(ids, near_of(table.column(4).to_pylist())))
                if got is not None:
                    yield got

    keyed = dealt.select("group", "block_a", "block_b", "vertex", "data")
    return keyed.repartition("group", "block_a", "block_b").sortWithinPartitions("group", "block_a", "block_b").mapInArrow(run, EDGES)


def linked(rows: DataFrame, limit: int, near_of: Near) -> DataFrame:
    """Edges that span the components of each group.  ``rows``: ``group``, ``size`` (its rows), ``vertex``, ``data``.

    No task holds more than two blocks of ``limit`` rows or so.
    """
    count = lambda size: F.ceil(F.col(size) / F.lit(limit)).cast("int")
    block = lambda n, seed: F.pmod(F.xxhash64("vertex", F.lit(seed)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    own = rows.withColumn("own", block(count("size"), 7))
    # members of the first block go to all blocks
    first = own.withColumn("block_a", F.explode(F.when(F.col("own") == 0, every(count("size"))).otherwise(F.array("own")))).withColumn("block_b", F.lit(-1))
    edges = _compare(first, near_of)
    large = own.where(F.col("size") > limit)
    if large.isEmpty():
        return edges
    edges = storage.written(edges, "first-edges")
    known = components.connected(edges).withColumnRenamed("vertex", "v")
    placed = large.select("group", "vertex").join(known, F.col("vertex") == F.col("v"), "left").select("group", "vertex", F.coalesce("component", "vertex").alias("c"))
    placed = storage.written(placed, "placed")
    main = placed.groupBy("group", "c").count().groupBy("group").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    main = main.where("n > most").select(F.col("group").alias("g"), "main", (F.col("n") - F.col("most")).alias("left"))
    rest = placed.join(main, F.col("group") == F.col("g")).where("c <> main").select(F.col("group").alias("g"), F.col("vertex").alias("v"))
    sized = large.join(main.select("g", "left"), F.col("group") == F.col("g")).drop("g")
    all_rows = sized.withColumn("block_a", F.explode(every(count("left")))).withColumn("block_b", F.col("own"))
    few = sized.join(rest, (F.col("group") == F.col("g")) & (F.col("vertex") == F.col("v")), "left_semi")
    few = few.withColumn("block_a", block(count("left"), 8)).withColumn("block_b", F.explode(every(count("size"))))
    columns = ["group", "block_a", "block_b", "vertex", "data"]
    return edges.unionByName(_compare(all_rows.select(columns).unionByName(few.select(columns)), near_of))


def sketch_near(least_equal: int) -> Near:
    def of(data: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        sketch = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), TOKENS)
        return lambda n, rest: (sketch[rest] == sketch[n]).sum(1) >= least_equal

    return of


def proposals(reps: DataFrame, percent: int) -> DataFrame:
    """Edges that span every proposed family.  ``reps``: ``vertex``, ``roots``, ``sketch``, one row a vertex."""
    chance = percent / 100
    near = sketch_near(int(TOKENS * chance - SLACK * (TOKENS * chance * (1 - chance)) ** 0.5))
    sketches = reps.select("vertex", F.col("sketch").alias("data"))
    rows = reps.select("vertex", F.posexplode("roots").alias("tree", "value")).select("vertex", F.xxhash64("tree", "value").alias("group"))
    out = None
    for depth in range(DEPTH + 1):
        # one more grouping key that follows from the node: a join by node deals both sides anew
        sizes = rows.groupBy("group", (F.col("group") % 5).alias("__r")).count().where("count > 1").select(F.col("group").alias("__group"), F.col("count").alias("size"))
        shared = rows.join(sizes, F.col("group") == F.col("__group")).select("group", "size", "vertex")
        shared = storage.written(shared, "nodes")
        last = depth == DEPTH
        small = shared if last else shared.where(F.col("size") <= NODE)
        found = linked(small.join(sketches, "vertex"), NODE, near)
        out = found if out is None else out.unionByName(found)
        large = shared.where(F.col("size") > NODE)
        if last or large.isEmpty():
            return out
        # tokens differ from node to node; those of one node differ from each other
        first = F.pmod(F.xxhash64("group", F.lit(depth)), F.lit(TOKENS)).cast("int")
        step = F.pmod(F.xxhash64("group", F.lit(depth), F.lit(1)), F.lit(TOKENS // CHILDREN)).cast("int") + 1
        chosen = F.explode(F.array(*((first + n * step) % TOKENS for n in range(CHILDREN)))).alias("token")
        rows = large.join(sketches, "vertex").select("vertex", "group", "data", chosen)
        rows = rows.select("vertex", F.xxhash64("group", "token", F.expr("substring(data, token + 1, 1)")).alias("group"))
    raise AssertionError


def set_near(percent: int) -> Near:
    def of(data: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        sets = [np.frombuffer(s, np.uint64) for s in data]
        size = np.array([len(s) for s in sets])
        _, local = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(size) - size
        mark = np.zeros(local.max() + 1, bool)

        def near(n: int, rest: np.ndarray) -> np.ndarray:
            # sizes alone rule out most of what is no link
            fit = 100 * np.minimum(size[rest], size[n]) >= percent * np.maximum(size[rest], size[n])
            out = np.zeros(len(rest), bool)
            if not fit.any():
                return out
            own = local[starts[n] : starts[n] + size[n]]
            mark[own] = True
            some = rest[fit]
            ends = np.cumsum(size[some])
            place = np.arange(ends[-1]) + np.repeat(starts[some] - (ends - size[some]), size[some])
            common = np.add.reduceat(mark[local[place]].astype(np.int64), ends - size[some])
            mark[own] = False
            out[fit] = 100 * common >= percent * (size[some] + size[n] - common)
            return out

        return near

    return of


def confirm(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Spanning links of the families: ``percent`` of the union or more in common, on full sets.

    ``members``: ``rep`` (a document that has the set), ``vertex`` and ``family``.
    Rows of one id are read once a task and set.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(k)
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                sets = own.sets(part.column(0).to_pylist())
                keep = []
                for n, (vertex, s) in enumerate(zip(part.column(1).to_pylist(), sets, strict=True)):
                    if vertex not in seen and set_key(s) == vertex:
                        seen.add(vertex)
                        keep.append(n)
                some = part.take(pa.array(keep, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(2), some.column(3), some.column(1), pa.array([sets[n].tobytes() for n in keep], pa.binary())], ["group", "size", "vertex", "data"])

    sizes = members.groupBy("family", (F.col("family") % 5).alias("__r")).agg(F.count("*").alias("size")).select(F.col("family").alias("group"), "size")
    own = members.join(sizes, F.col("family") == F.col("group")).select("rep", "vertex", "group", "size")
    kind = T.StructType([T.StructField(n, T.BinaryType() if n == "data" else T.LongType()) for n in ("group", "size", "vertex", "data")])
    full = docs.join(own, F.col("doc_id") == F.col("rep")).select("text", "vertex", "group", "size").mapInArrow(shingled, kind)
    return linked(storage.written(full, "sets"), FAMILY, set_near(percent))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text_key``, ``n_shingles``, ``component_id`` and ``kept`` of each row.

    Rows are linked whose ``k``-word shingle sets (A-Z lower-cased) have
    ``percent`` of their union or more in common; a component has the smallest
    id that links reach.  A null or empty text has an empty set and is linked
    with nothing.  A row with a null id takes no part: it is kept and has no
    component.  Rows of one id are judged each by its own text (``text_key``:
    its hash); those that are in the component of their id are all kept.  An
    empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = storage.written(sketched(rows.withColumn("text_key", F.xxhash64("text")), k, percent), "sketches")
    some = known.where("doc_id IS NOT NULL AND n_shingles > 0")
    # one more grouping key that follows from the vertex: a join by vertex deals both sides anew
    first = some.groupBy("vertex", (F.col("vertex") % 5).alias("__r")).agg(F.min("doc_id").alias("rep")).select(F.col("vertex").alias("v"), "rep")
    first = storage.written(first, "vertices")
    reps = some.join(first, (F.col("doc_id") == F.col("rep")) & (F.col("vertex") == F.col("v"))).select("vertex", "roots", "sketch").dropDuplicates(["vertex"])
    families = components.connected(proposals(storage.written(reps, "reps"), percent))
    members = families.select("vertex", F.col("component").alias("family")).join(first, F.col("vertex") == F.col("v")).select("rep", "vertex", "family")
    links = components.connected(confirm(rows, storage.written(members, "members"), k, percent))
    found = links.join(first, F.col("vertex") == F.col("v")).select("v", "rep", "component")
    least = found.groupBy("component", (F.col("component") % 5).alias("__r")).agg(F.min("rep").alias("least")).select(F.col("component").alias("c"), "least")
    classes = first.join(found.join(least, F.col("component") == F.col("c")).select(F.col("v").alias("w"), "least"), F.col("v") == F.col("w"), "left").select("v", F.coalesce("least", "rep").alias("least"))
    out = known.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("vertex")).alias("vertex")).join(classes, F.col("vertex") == F.col("v"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
