"""Statistics of whole texts as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once a row (lambdas evaluate what they enclose once an element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many of the given ASCII characters the text holds."""
    bare = text
    for c in chars:
        bare = F.replace(bare, F.lit(c))
    return (F.octet_length(text) - F.octet_length(bare)).cast("long")


def repeated_words(own: Column, width: int = WINDOW) -> Column:
    """Words that stand in a window of ``width`` (8) words found twice or more; ``own`` must be a plain column.

    Windows are compared by 64-bit hashes, built by doubling: of two words,
    of four, of eight.  Texts without a repeated window stop at a count of
    distinct hashes; in the others hashes are sorted with their places.
    """
    if width != 8:
        raise ValueError("windows of eight words only")

    def joined(hashes: Column, step: int) -> Column:
        n = F.size(hashes) - step
        return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(placed, lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("total"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(width), i - acc["last"])).alias("total"))
        return F.aggregate(places, start, step, lambda acc: acc["total"])

    one = F.transform(own, lambda w: F.xxhash64(w))
    eight = let(let(let(one, lambda h: joined(h, 1)), lambda h: joined(h, 2)), lambda h: joined(h, 4))
    found = let(eight, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(own) <= width, F.lit(0)).otherwise(found).cast("long")
