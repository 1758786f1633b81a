"""Hierarchical packing of documents into windows of several lengths.

Documents longer than the longest window fill whole windows first; what is
left of each is routed to the shortest tier that holds it.  Every tier then
opens windows with its own pieces, longest tier first, and the gaps are filled
from shorter tiers: whole pieces that fit best, then one piece cut to the gap.
Windows that cannot be filled any more are taken apart into a common rest,
which is cut into whole long windows and, at the end of a buffer, into
windows of falling powers of two, so that nothing is padded.  Full windows of
a tier are dealt to step groups of equal token count, costly (attention cost)
and cheap windows in turns.

A task packs its documents in buffers of bounded size; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from epochal.llm.wordcache import encoder

END_ID = 2
TIERS = (512, 1024, 2048, 4096)
#: Tokens of a training step: a step group holds so many tokens of one tier.
STEP_TOKENS = 16 * 4096
#: Documents are packed together up to so many tokens.
BUFFER_TOKENS = 4 << 20

Piece = tuple[int, int, int]  # document, start, length


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows ``(length, pieces)`` of documents of these lengths.

    Pieces cover each document from 0 to its length exactly once.
    """
    top = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    by_tier: list[list[tuple[int, Piece]]] = [[] for _ in tiers]
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= top:
            windows.append((top, [(doc, at, top)]))
            at += top
        if n > at:
            by_tier[bisect_left(tiers, n - at)].append((n - at, (doc, at, n - at)))
    rest: list[Piece] = []
    # all pieces of the tiers below, in order of length
    pool: list[tuple[int, Piece]] = sorted(p for tier in by_tier[:-1] for p in tier)
    for level in range(len(tiers) - 1, -1, -1):
        tier = tiers[level]
        own = sorted(by_tier[level], reverse=True) if level == len(tiers) - 1 else []
        if not own:
            low = tiers[level - 1] if level else 0
            cut = bisect_right(pool, low, key=lambda p: p[0])
            own, pool = pool[cut:][::-1], pool[:cut]
        while own:
            size, piece = own.pop(0) if level else own.pop()
            window, gap = [piece], tier - size
            source = pool if level else own
            while gap and source:
                if not level:
                    size, piece = source.pop()
                elif fit := bisect_right(source, gap, key=lambda p: p[0]):
                    size, piece = source.pop(fit - 1)
                else:
                    size, piece = source.pop(0)
                if size > gap:
                    doc, at, n = piece
                    left = (n - gap, (doc, at + gap, n - gap))
                    if level:
                        insort(source, left)
                    else:
                        source.append(left)
                    size, piece = gap, (doc, at, gap)
                window.append(piece)
                gap -= size
            if gap:
                rest += window
            else:
                windows.append((tier, window))
    held, size = [], 0
    for doc, at, n in rest:
        while n:
            take = min(n, top - size)
            held.append((doc, at, take))
            at, n, size = at + take, n - take, size + take
            if size == top:
                windows.append((top, held))
                held, size = [], 0
    while held:
        want = 1 << (size.bit_length() - 1)
        window, size = [], size - want
        while want:
            doc, at, n = held.pop(0)
            if n > want:
                held.insert(0, (doc, at + want, n - want))
                n = want
            window.append((doc, at, n))
            want -= n
        windows.append((sum(p[2] for p in window), window))
    return windows


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Step group of each window: equal token counts a group, attention cost (sum of squared pieces) dealt back and forth."""
    out, first = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = [i for i, (t, _) in enumerate(windows) if t == tier]
        own.sort(key=lambda i: -sum(p[2] ** 2 for p in windows[i][1]))
        groups = -(-len(own) * tier // step_tokens)
        for n, i in enumerate(own):
            turn, place = divmod(n, groups)
            out[i] = first + (groups - 1 - place if turn % 2 else place)
        first += groups
    return out


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END_ID) -> DataFrame:
    """One row a piece: key, ``start``, ``length``, ``ids`` (packed), ``doc_tokens``, ``sequence_id``, ``offset``, ``tier``, ``step_group``.

    A null text is empty and has the end id only; rows with equal keys are
    packed each on their own; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType
    names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    schema = T.StructType([T.StructField(n, kind if n == key else T.BinaryType() if n == "ids" else T.IntegerType() if n == "tier" else T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 36
        sequences = groups = size = 0
        keys: list = []
        held: list[bytes] = []  # little-endian ids

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups, size
            windows = pack([len(h) // 4 for h in held])
            where = step_groups(windows)
            rows: list[list] = [[] for _ in names]
            for (tier, window), group in zip(windows, where, strict=True):
                offset = 0
                for doc, at, n in window:
                    data = held[doc]
                    for column, value in zip(rows, (keys[doc], at, n, data[4 * at : 4 * (at + n)], len(data) // 4, base + sequences, offset, tier, base + groups + group), strict=True):
                        column.append(value)
                    offset += n
                sequences += 1
            groups += max(where, default=-1) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, key_type if n == key else pa.binary() if n == "ids" else pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, rows, strict=True)], names)
            keys.clear()
            held.clear()
            size = 0

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, ids in zip(batch.column(0).to_pylist(), own.texts(batch.column(1), end), strict=True):
                keys.append(k)
                held.append(ids.astype("<u4").tobytes())
                size += len(ids)
                if size >= BUFFER_TOKENS:
                    yield from emit()
        if held:
            yield from emit()

    return docs.select(key, text).mapInArrow(run, schema)
