"""Token ids of a corpus in grammar-compressed shards.

Documents, in ascending ``doc_id`` order (nulls first, then ties by text), are
encoded and cut into shards of whole documents.  Each shard is compressed on
its own by Re-Pair in rounds: neighbouring id pairs are counted, of those with
``MIN_COUNT`` places or more the frequent ones are replaced by new symbols
(nonterminals) before rarer ones that overlap them, and rounds go on until no
pair is frequent.  A shard stores its rules, the expansion length of every
rule and the remaining sequence, so that any document can be found and
expanded without its neighbours.  No rule spans two documents, as pairs with
the end id are never replaced.

Files are Parquet, one row a shard: ``part``, ``shard``, ``n_docs``,
``n_tokens`` and ``block``, the self-describing bytes (see ``pack_block``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochal.llm.wordcache import encoder

END_ID = 2
#: A shard is closed at so many ids (a longer document is a shard of its own).
SHARD_TOKENS = 1 << 20
#: Pairs with so many places in a shard are frequent (a parameter of the format: rarer ones save little).
MIN_COUNT = 16
BUCKET_BITS = 18
#: Leading characters of texts that part equal ids into ranges; they only choose a task.
TIE_CHARS = 32
#: Starts of shards are broadcast up to so many (24 bytes each), else joined by a shuffle.
BROADCAST_SHARDS = 500_000
MAGIC = b"EPRG"


def _buckets(left: np.ndarray, right: np.ndarray, turn: int) -> np.ndarray:
    """A hash bucket of each pair, another one in each round."""
    return ((left * np.uint32(0x9E3779B1)) ^ ((right + np.uint32(turn)) * np.uint32(0x85EBCA6B))) >> np.uint32(32 - BUCKET_BITS)


def _frequent(left: np.ndarray, right: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frequent pairs, rarer ones first; which places hold one; each such place's pair; and places that wait.

    All places are counted in buckets first; those of heavy buckets are sorted.
    Of two frequent pairs with one bucket the rarer waits for the next round,
    where buckets are others.
    """
    bucket = _buckets(left, right, turn)
    some = np.flatnonzero((np.bincount(bucket, minlength=1 << BUCKET_BITS) >= MIN_COUNT)[bucket])
    bucket, keys = bucket[some], (left[some].astype(np.uint64) << np.uint64(32)) | right[some]
    order = np.sort(keys)
    cuts = np.concatenate([[0], np.flatnonzero(order[1:] != order[:-1]) + 1, [len(order)]])
    times = np.diff(cuts)
    often = times >= MIN_COUNT
    pairs = order[cuts[:-1][often]][np.argsort(times[often], kind="stable")]
    if not len(pairs):
        return pairs, some[:0], some[:0], some[:0]
    table = np.zeros(1 << BUCKET_BITS, np.int32)
    own = _buckets((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32), turn)
    table[own] = np.arange(len(pairs))
    number = table[bucket]
    hit = pairs[number] == keys
    lost = table[own] != np.arange(len(pairs))
    shared = np.zeros(1 << BUCKET_BITS, bool)
    shared[own[lost]] = True
    waits = np.flatnonzero(shared[bucket] & ~hit)
    waits = waits[np.isin(keys[waits], pairs[lost])]
    return pairs, some[hit], number[hit], some[waits]


def _disjoint(at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Of overlapping places that of the more frequent pair; of a run of one pair every second, from the first."""
    beside = np.diff(at) == 1
    before = np.concatenate([[-1], np.where(beside, number[:-1], -1)])
    after = np.concatenate([np.where(beside, number[1:], -1), [-1]])
    order = np.arange(len(at))
    first = np.maximum.accumulate(np.where(before == number, 0, order))
    return ((order - first) % 2 == 0) & (before <= number) & (after <= number)


def build_grammar(ids: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray, int]:
    """``(rules, sequence, base)``: rule ``i`` is symbol ``base + i`` and stands for its two symbols.

    A round looks only at places that can have become frequent: beside symbols
    of the last round, and at frequent pairs that were not replaced (or shared
    a bucket with a more frequent one).  A pair
    with too few places left by more frequent ones waits for the next round;
    the most frequent one always keeps half of its places or more, so each
    round shortens the sequence.
    """
    seq = ids.astype(np.uint32)
    base = int(seq.max(initial=0)) + 1
    rules: list[np.ndarray] = []
    total = turn = 0
    at = np.flatnonzero((seq[:-1] != end) & (seq[1:] != end))
    while len(at):
        pairs, hit, number, waits = _frequent(seq[at], seq[at + 1], turn)
        if not len(pairs):
            break
        later, at = at[waits], at[hit]
        keep = _disjoint(at, number)
        live = np.bincount(number[keep], minlength=len(pairs)) >= MIN_COUNT // 2
        symbol = (base + total + np.cumsum(live) - 1).astype(np.uint32)
        keep &= live[number]
        own = at[keep]
        rules.append(pairs[live])
        total, turn = total + int(live.sum()), turn + 1
        seq[own] = symbol[number[keep]]
        stays, look = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        stays[own + 1] = False
        look[at] = look[later] = True
        look[np.maximum(own - 1, 0)] = True
        seq, look = seq[stays], look[stays]
        at = np.flatnonzero(look[:-1] & (seq[:-1] != end) & (seq[1:] != end))
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    return np.stack([flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32), seq, base


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of each rule."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, np.uint32)


def pack_block(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of a shard: magic, sizes, documents, rules, expansion lengths, sequence."""
    rules, seq, base = build_grammar(ids)
    wide = base + len(rules) > 1 << 16
    kind = "<u4" if wide else "<u2"
    head = struct.pack("<4sIIIIQB", MAGIC, len(counts), len(rules), len(seq), base, len(ids), wide)
    return b"".join(
        [
            head,
            np.array([d is not None for d in doc_ids], "u1").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            counts.astype("<u4").tobytes(),
            rules.astype(kind).tobytes(),
            rule_lengths(rules, base).astype("<u4").tobytes(),
            seq.astype(kind).tobytes(),
        ]
    )


class Block:
    """A shard, read without expanding it."""

    def __init__(self, raw: bytes):
        size = struct.calcsize("<4sIIIIQB")
        magic, docs, rules, length, self.base, self.n_tokens, wide = struct.unpack_from("<4sIIIIQB", raw)
        if magic != MAGIC:
            raise ValueError("not a shard")
        kind, at = ("<u4" if wide else "<u2"), size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, n, at)
            at += out.nbytes
            return out

        there = take("u1", docs)
        self.doc_ids = [d if t else None for d, t in zip(take("<i8", docs).tolist(), there.tolist(), strict=True)]
        self.counts = take("<u4", docs).astype(np.int64)
        self.rules = take(kind, 2 * rules).reshape(-1, 2)
        self.rule_lengths = take("<u4", rules)
        self.seq = take(kind, length)
        self.starts = np.cumsum(self.counts) - self.counts
        self._parts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        big = symbols >= self.base
        out[big] = self.rule_lengths[symbols[big] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that the symbols stand for."""
        if self._parts is None:
            done: list[bytes] = []
            base = self.base
            for a, b in self.rules.tolist():
                done.append((done[a - base] if a >= base else struct.pack("<I", a)) + (done[b - base] if b >= base else struct.pack("<I", b)))
            # plain ids come first in the table and stand for themselves
            flat = np.concatenate([np.arange(base, dtype="<u4"), np.frombuffer(b"".join(done), "<u4")])
            size = np.concatenate([np.ones(base, np.int64), self.rule_lengths.astype(np.int64)])
            self._parts = flat, np.cumsum(size) - size, size
        flat, first, size = self._parts
        size = size[symbols]
        ends = np.cumsum(size)
        return flat[np.repeat(first[symbols] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def document(self, n: int) -> np.ndarray:
        """Ids of the ``n``-th document: only its own symbols are expanded."""
        ends = np.cumsum(self.lengths(self.seq))
        lo, hi = int(self.starts[n]), int(self.starts[n] + self.counts[n])
        a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left")
        return self.expand(self.seq[a : b + 1])

    def all_ids(self) -> np.ndarray:
        return self.expand(self.seq)


SHARDS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("block", T.BinaryType()),
    ]
)


def write(docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end: int = END_ID) -> None:
    """Encode ``docs`` into shard files under ``path``; a null text is empty and has the end id only.

    An empty table gives no shards.  Documents are dealt by ranges of the key,
    so that files ascend; a task holds one shard at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, size
            counts = np.array([len(h) for h in held], np.int64)
            row = [part, shard, len(keys), size, pack_block(keys, counts, np.concatenate(held))]
            keys.clear()
            held.clear()
            shard, size = shard + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)], SHARDS.names)

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), own.texts(batch.column(1), end), strict=True):
                if size and size + len(ids) > SHARD_TOKENS:
                    yield close()
                keys.append(k)
                held.append(ids)
                size += len(ids)
        if held:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    # rows of one id (or none) are parted by how their texts begin
    order = [F.col(key).asc_nulls_first(), F.left(F.col(text), F.lit(TIE_CHARS)).asc_nulls_first()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first())
    dealt.mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Documents of the shard files: key, ``start`` (ids of all documents before), ``n_tokens``, ``ids`` (packed).

    Starts are sums over shards: first within a part, then over the parts, of
    which there are as many as tasks wrote.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before_part = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("shard")
    starts = sizes.select("part", "shard", (F.sum("n_tokens").over(in_part) - F.col("n_tokens")).alias("shard_start")).join(before_part, "part")
    kind = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, raw in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                block = Block(raw)
                data = block.all_ids().astype("<u4").tobytes()
                cuts = [(4 * s, 4 * (s + c)) for s, c in zip(block.starts.tolist(), block.counts.tolist(), strict=True)]
                n = len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()),
                        pa.array([shard] * n, pa.int32()),
                        pa.array(block.doc_ids, pa.int64()),
                        pa.array(block.starts, pa.int64()),
                        pa.array(block.counts, pa.int64()),
                        pa.array([data[a:b] for a, b in cuts], pa.binary()),
                    ],
                    kind.names,
                )

    docs = shards.select("part", "shard", "block").mapInArrow(run, kind)
    if sizes.count() <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    return docs.join(starts, ["part", "shard"]).select(key, (F.col("part_start") + F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids")
