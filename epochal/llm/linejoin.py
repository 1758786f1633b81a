"""Line dedup by a segment-partition edit join.

Lines within ``edits`` (2) insertions, deletions or replacements of each other
are links; linked lines are a class, and of each class only the first line of
the corpus (smallest document, then smallest line number) stays.

A line is cut into ``edits + 1`` even segments.  Of two lines within the
threshold, one segment of the shorter stands unchanged in the longer, close to
its place: so every line is indexed by (length, segment number, segment), and
probes the index of each length from its own down to ``edits`` less with the
substrings at the places that the segment can have moved to.  Of lines that
meet, those whose letters differ in more than ``edits`` edits can change are no
pairs: index and probe carry the counts of ``LETTERS``, so that many near
copies with one segment in common don't become all their pairs.  Pairs are
verified by a banded bit-parallel edit distance: the band of 2 * edits + 1
cells of a column is one word, carried on from character to character.

Where a segment has many lines (``CROWD``), most often near copies of one
another, they are not made pairs with one another: each is held against one of
them, and then only lines of different classes are compared.

DataFrame functions only.  Equal lines are one line from the start, by a
64-bit hash.  Lines of fewer than ``SHORTEST`` characters are compared for
equality only; lines without a word are left alone.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochal.llm import components, storage
from epochal.llm.textstats import let

EDITS = 2
SHORTEST = 20
#: Characters whose counts are held against each other before a pair is made (any will do; frequent ones tell more apart).
LETTERS = " etaonihsrdlumbc"
#: Counted besides for the lines of crowded keys.
OTHERS = "0123456789.,:-/gpfywvkE"
#: From about so many index lines a key is crowded.
CROWD = 1000
#: Keys of lines that take part in a verification are broadcast up to so many, else joined by a shuffle.
BROADCAST_LINES = 1_000_000


def text_key(text: Column) -> Column:
    """31 bits of a text's hash: tells rows of one id apart."""
    return F.shiftrightunsigned(F.xxhash64(text), 33)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id``, ``n_lines`` (of its row), ``spot`` (text key, then line number from 0) and ``line`` of every line with a word."""
    numbered = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.cast("long").alias("line_no"), x.alias("line")))
    with_words = F.filter(numbered, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.shiftleft(text_key(F.col(text)), 32).alias("t"), with_words.alias("own"))
    each = rows.select("doc_id", "t", F.size("own").alias("n_lines"), F.inline("own"))
    return each.select("doc_id", "n_lines", F.col("t").bitwiseOR(F.col("line_no")).alias("spot"), "line")


def _segment(length: Column, number: Column, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of a segment: even parts, the last ones longer by one."""
    parts = edits + 1
    base, longer = F.floor(length / parts).cast("int"), number - (parts - length % parts)
    return base * number + F.greatest(longer, F.lit(0)) + 1, base + F.when(longer >= 0, 1).otherwise(0)


def _key(line: Column, length: Column, number: Column, shift: Column, edits: int) -> Column:
    """Hash of what stands in ``line`` where the segment ``number`` of a line of ``length`` would be, moved by ``shift``."""
    start, size = _segment(length, number, edits)
    return F.xxhash64(length, number, F.substring(line, start + shift, size))


def index_keys(line: Column, length: Column, edits: int) -> Column:
    return F.array(*(_key(line, length, F.lit(i), F.lit(0), edits) for i in range(edits + 1)))


def probe_places(edits: int) -> Column:
    """``less``, ``number`` and ``shift``: where a segment of a line shorter by ``less`` can stand.

    Segment ``i`` (from 0) has at most ``i`` edits before it and ``edits - i``
    after it, if it is the first that is left unchanged.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                out.append(F.struct(F.lit(less).alias("less"), F.lit(i).alias("number"), F.lit(shift).alias("shift")))
    return F.array(*out)


def bag(line: Column, letters: str = LETTERS) -> Column:
    """How often each of ``letters`` (31 at most) stands in a line, modulo 4, two bits each.

    A letter is counted by taking it out; the next one is looked for in what is left.
    """
    out, left = F.lit(0).cast("long"), line
    for i, c in enumerate(letters):
        rest = F.replace(left, F.lit(c))
        out = out + F.shiftleft((F.octet_length(left) - F.octet_length(rest)).cast("long").bitwiseAND(F.lit(3).cast("long")), 2 * i)
        left = rest
    return out


def bags_within(a: Column, b: Column, edits: int) -> Column:
    """Whether two bags are as close as those of strings within ``edits``: an edit moves two counts by one at most.

    Counts modulo 4 differ by one where their low bits differ, and else by two
    where their high bits do.
    """
    ones = F.lit(int("01" * 31, 2)).cast("long")
    differ = a.bitwiseXOR(b)
    low, high = differ.bitwiseAND(ones), F.shiftright(differ, 1).bitwiseAND(ones)
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low))) <= 2 * edits


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are at most ``edits`` apart: a banded bit-parallel edit distance.

    Bit ``k`` of a column's words stands for the row ``column - edits + k``.
    ``up`` and ``down`` are the rows whose value is one more or one less than
    that of the row before; ``d`` follows the band's lowest diagonal to the
    last row, and then that row to its end.  ``a`` and ``b`` must be plain
    columns; a difference in length beyond ``edits`` must be ruled out before.
    """
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1).cast("long")
    shifted_right = lambda word, n: F.call_function("shiftright", word, n)  # noqa: E731  (by a column)
    bit = lambda word, n: shifted_right(word, n).bitwiseAND(F.lit(1).cast("long"))
    inverse = lambda word: word.bitwiseXOR(full)

    def scan(rows: Column, columns: Column) -> Column:
        m = F.size(rows)

        def step(state: Column, char: Column, j: Column) -> Column:
            match = F.lit(0).cast("long")
            for k in range(width):
                match = match + F.when(F.coalesce(F.get(rows, j - F.lit(edits - k)) == char, F.lit(False)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))

            def forward(x: Column) -> Column:
                same = x.bitwiseAND(state["up"]) + state["up"]
                diagonal = same.bitwiseXOR(state["up"]).bitwiseOR(x).bitwiseOR(state["down"]).bitwiseAND(full)
                return let(diagonal, after)

            def after(d0: Column) -> Column:
                right = state["down"].bitwiseOR(inverse(d0.bitwiseOR(state["up"])).bitwiseAND(full))
                return let(F.struct(right.alias("right"), d0.bitwiseAND(state["up"]).alias("left"), d0.alias("d0")), moved)

            def moved(h: Column) -> Column:
                shifted = F.shiftright(h["d0"], 1)
                up = h["left"].bitwiseOR(inverse(shifted.bitwiseOR(h["right"])).bitwiseAND(full))
                down = shifted.bitwiseAND(h["right"])
                # the last row is reached in column m - edits (j counts from 0)
                row = m - j - 1 + edits
                on_diagonal = j + 1 + edits <= m
                d = F.when(on_diagonal, state["d"] + 1 - bit(h["d0"], F.lit(width - 1))).otherwise(state["d"] + bit(h["right"], row) - bit(h["left"], row))
                return F.struct(up.alias("up"), down.alias("down"), d.cast("int").alias("d"))

            return F.when(state["d"] > 3 * edits, state).otherwise(let(match, forward))

        # column 0: rows 1 .. edits + 1 rise by one each
        start = F.struct(F.lit(((1 << width) - 1) & ~((1 << edits) - 1)).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(edits).alias("d"))
        placed = F.transform(columns, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
        return F.aggregate(placed, start, lambda s, x: step(s, x["c"], x["j"]), lambda s: s["d"] <= edits)

    # the pattern is the longer string, so that the last row is within the first column's band or below
    return let(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), lambda p: scan(p["a"], p["b"]))


def keyed(distinct: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """The index (``h``, ``u``, ``s``) and its probes (``g``, ``v``, ``t``) of distinct lines: key, bag and segment of each.

    Places are exploded first and their keys taken a row each: an array of all
    keys of a line makes a method of 10,826 bytes, which the JVM does not compile.
    """
    index = distinct.select("h", F.col("bag").alias("u"), F.explode(index_keys(F.col("line"), F.col("n"), edits)).alias("s"))
    placed = distinct.select(F.col("h").alias("g"), F.col("bag").alias("v"), "line", "n", F.inline(probe_places(edits)))
    probe = placed.select("g", "v", _key(F.col("line"), F.col("n") - F.col("less"), F.col("number"), F.col("shift"), edits).alias("t"))
    return index, probe


def met(index: DataFrame, probe: DataFrame, edits: int, more: Column | None = None) -> DataFrame:
    """Pairs ``a`` > ``b`` of lines that meet in a segment and have close bags."""
    on = (F.col("s") == F.col("t")) & (F.col("h") != F.col("g")) & bags_within(F.col("u"), F.col("v"), edits)
    pairs = index.join(probe, on if more is None else on & more)
    return pairs.select(F.greatest("h", "g").alias("a"), F.least("h", "g").alias("b"))


def verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Those of ``a``, ``b`` whose lines are within ``edits``.  ``texts``: ``h``, ``line``, one row a line."""
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    longer = F.length("x") >= F.length("y")
    both = both.where(F.abs(F.length("x") - F.length("y")) <= edits).select("a", "b", F.when(longer, F.col("x")).otherwise(F.col("y")).alias("p"), F.when(longer, F.col("y")).otherwise(F.col("x")).alias("q"))
    return both.where(within(F.col("p"), F.col("q"), edits)).select("a", "b")


def crowds(long_lines: DataFrame, edits: int) -> tuple[DataFrame, bool]:
    """``s``: index keys of about ``CROWD`` lines or more, and whether they are few enough to broadcast.

    Counted on every sixteenth line by hash.  Links don't depend on which keys
    are found here: it only tells which of two exact ways a key's lines take.
    """
    some = long_lines.where(F.col("h").bitwiseAND(F.lit(15).cast("long")) == 0).dropDuplicates(["h"])
    keys = some.select(F.explode(index_keys(F.col("line"), F.length("line"), edits)).alias("s"))
    found = storage.written(keys.groupBy("s").count().where(F.col("count") * 16 >= CROWD).select(F.col("s").alias("crowd")), "line-crowds")
    return found, found.count() <= BROADCAST_LINES


def crowd_links(index: DataFrame, probe: DataFrame, distinct: DataFrame, edits: int) -> DataFrame:
    """Links of the lines of crowded keys, enough to join what is linked: no pairs of lines that are of one class already.

    First every line is held against one line of its key and bag.  Of the
    classes that come of that, a key's largest is compared with the lines
    outside it only.  Lines carry a second bag here, of ``OTHERS``.
    """
    index, probe = storage.written(index, "crowd-index"), storage.written(probe, "crowd-probe")
    there = index.select("h").unionByName(probe.select(F.col("g").alias("h"))).distinct()
    texts = distinct.join(there.select(F.col("h").alias("k")), F.col("h") == F.col("k")).select("h", "line", bag(F.col("line"), OTHERS).alias("more"))
    texts = storage.written(texts, "crowd-texts")
    centre = index.groupBy(F.col("s").alias("s0"), F.col("u").alias("u0")).agg(F.min("h").alias("b"))
    stars = index.join(centre, (F.col("s") == F.col("s0")) & (F.col("u") == F.col("u0"))).where("h <> b").select(F.col("h").alias("a"), "b").distinct()
    near = storage.written(verified(stars, texts, edits), "crowd-stars")
    same = components.connected(near)
    known = storage.written(texts.join(same, F.col("h") == F.col("vertex"), "left").select(F.col("h").alias("k"), "more", F.coalesce("component", "h").alias("c")), "crowd-classes")
    index = index.join(known, F.col("h") == F.col("k")).select("h", "u", "s", F.col("more").alias("m"), "c")
    index = storage.written(index, "crowd-index")
    most = index.groupBy("s", "c").count().groupBy(F.col("s").alias("key")).agg(F.max(F.struct("count", "c")).alias("most")).select("key", F.col("most.c").alias("most"))
    index = index.join(most, F.col("s") == F.col("key")).drop("key").withColumn("inside", F.col("c") == F.col("most")).drop("most")
    probe = probe.join(known, F.col("g") == F.col("k")).join(most, F.col("t") == F.col("key"))
    probe = probe.select("g", "v", "t", F.col("more").alias("w"), F.col("c").alias("d"), (F.col("c") == F.col("most")).alias("within"))
    others = (F.col("c") != F.col("d")) & bags_within(F.col("m"), F.col("w"), edits)
    pairs = met(index.where("NOT inside"), probe, edits, others).unionByName(met(index.where("inside"), probe.where("NOT within"), edits, others))
    return verified(storage.written(pairs.distinct(), "crowd-pairs"), texts, edits).unionByName(near)


def links(docs_lines: DataFrame, edits: int) -> DataFrame:
    """Verified pairs ``a``, ``b`` of line keys that join all linked lines.  ``docs_lines``: ``h``, ``line`` with repetition."""
    long_lines = docs_lines.where(F.length("line") >= SHORTEST)
    # bags and lengths are taken below the exchange of distinct lines: once a line, not once a key
    distinct = long_lines.withColumns({"bag": bag(F.col("line")), "n": F.length("line")}).dropDuplicates(["h"])
    index, probe = keyed(distinct, edits)
    crowded, small = crowds(long_lines, edits)
    any_crowd = crowded.take(1)
    if any_crowd:
        crowded = F.broadcast(crowded) if small else crowded
        hot = crowd_links(index.join(crowded, F.col("s") == F.col("crowd"), "left_semi"), probe.join(crowded, F.col("t") == F.col("crowd"), "left_semi"), distinct, edits)
        index, probe = index.join(crowded, F.col("s") == F.col("crowd"), "left_anti"), probe.join(crowded, F.col("t") == F.col("crowd"), "left_anti")
    pairs = storage.written(met(index, probe, edits).distinct(), "line-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    keys = storage.written(needed.select(F.col("h").alias("k")), "line-keys")
    few = keys.count() <= BROADCAST_LINES
    texts = long_lines.join(F.broadcast(keys) if few else keys, F.col("h") == F.col("k")).select("h", "line").dropDuplicates(["h"])
    found = verified(pairs, storage.written(texts, "line-texts"), edits)
    return found.unionByName(hot) if any_crowd else found


def decisions(docs: DataFrame, edits: int = EDITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text_key``, ``n_lines``, ``n_removed`` and ``removed`` of each document with a line.

    ``removed``: line number, and the document and number of the class's first
    line.  Lines of rows with a null id take no part.  Rows of one id and one
    text are one document; different texts of one id are documents of their
    own, ordered by ``text_key``.
    """
    found = lines(docs, key, text).where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("line"))
    placed = storage.written(found.select("doc_id", "n_lines", "spot", "h"), "lines")
    same = components.connected(links(found.select("h", "line"), edits))
    same = same.where("vertex <> component").select(F.col("vertex").alias("h"), "component")
    classed = placed.join(same, "h", "left").select("doc_id", "spot", F.coalesce("component", "h").alias("c"))
    spots = F.lit(Decimal(1 << 63))
    place = F.col("doc_id").cast("decimal(19,0)") * spots + F.col("spot").cast("decimal(19,0)")
    # one more grouping key that follows from the class: a join by class deals both sides anew
    first = classed.groupBy("c", (F.col("c") % 7).alias("__r")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("c").alias("k"), "first")
    again = classed.join(first, F.col("c") == F.col("k")).where(place > F.col("first"))
    first_spot = F.pmod(F.col("first"), spots)
    again = again.select("doc_id", "spot", ((F.col("first") - first_spot) / spots).cast("long").alias("first_doc"), _line_no(first_spot.cast("long")).alias("first_line"))
    removed = F.struct(_line_no(F.col("spot")).alias("line_no"), "first_doc", "first_line")
    gone = again.distinct().groupBy("doc_id", _text_key(F.col("spot")).alias("text_key")).agg(F.count("*").alias("n_removed"), F.array_sort(F.collect_list(removed)).alias("removed"))
    counts = placed.groupBy("doc_id", _text_key(F.col("spot")).alias("text_key")).agg(F.max("n_lines").cast("long").alias("n_lines"))
    return counts.join(gone, ["doc_id", "text_key"], "left").select("doc_id", "text_key", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "removed")


def _text_key(spot: Column) -> Column:
    return F.shiftrightunsigned(spot, 32)


def _line_no(spot: Column) -> Column:
    return spot.bitwiseAND(F.lit((1 << 32) - 1).cast("long")).cast("int")


def dedup(docs: DataFrame, edits: int = EDITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines cut out of ``text``; other columns as they are, null and empty texts too."""
    gone = decisions(docs, edits, key, text).where("n_removed > 0")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.transform("removed", lambda x: x["line_no"]).alias("__gone"))
    both = docs.join(gone, (F.col(key) == F.col("__id")) & (text_key(F.col(text)) == F.col("__key")), "left")
    # numbers that stay, by hashing: linear in the lines, however many go
    stay = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("__gone"))
    left = let(F.split(text, "\n"), lambda own: F.array_join(F.transform(stay(own), lambda i: F.get(own, i)), "\n"))
    return both.select(*(F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left).alias(text) if c == text else F.col(c) for c in docs.columns))
