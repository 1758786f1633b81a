"""Filter interaction audit: every order of the filters is replayed over the documents' flags.

Each document has a flag a filter (does it fail?), read from its whole text
once.  Documents of one part with equal flags and labels behave alike in
every order, so they are counted before the replay (map-side combined), and
each such row is crossed with the 120 orders (a broadcast of fixed size),
exploded into five steps, and counted where it first fails.

Filter E (a text that a smaller id has, too) needs the whole table: texts meet
by a SHA-256, as narrow rows.  Copies are counted in their tasks first; a
group of any size then is one row a part, label and set of flags.

Defined cases: a null text is empty (it fails A, and E if a smaller id is
empty, too); a null id is smaller than none and none is smaller than it, so
it never fails E; rows with one id and one text do not fail E by each other;
a null source counts to the part of empty name; a label row without an id or
value counts for nothing, and several labels of one id count if any is 1.
An empty table gives no rows.  Other columns play no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.llm import textstats

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SYMBOLS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_flags(text: Column) -> dict[str, Column]:
    """Whether a text that is not null fails the filters A to D."""
    words = textstats.words(text)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": textstats.let(words, lambda w: 100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT_PERCENT * F.size(w)),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def flagged(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts ``n`` of documents by ``part``, the flags ``A`` to ``E``, ``good`` and ``toxic``."""
    some = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = some.select("id", "part", *(c.alias(n) for n, c in text_flags(F.col("t")).items()), F.unhex(F.sha2("t", 256)).alias("same"))
    # equal rows are one from here on
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("lid")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = rows.join(known, F.col("id") == F.col("lid"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kinds = ["part", *FILTERS[:4], "good", "toxic"]
    # of a text and kind: the smallest id, how many rows have it, and how many rows there are
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = rows.groupBy("same", *kinds).agg(least.alias("least"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    first = F.min("least.id").over(Window.partitionBy("same"))
    groups = groups.withColumn("spared", F.col("no_id") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("spared").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("spared")).alias("n"))))
    return groups.select(*kinds, both.alias("x")).select(*kinds, "x.E", "x.n").where("n > 0").groupBy(*kinds, "E").agg(F.sum("n").alias("n"))


def orders(df: DataFrame) -> DataFrame:
    """The 120 orders of the five filters, a row each."""
    return df.sparkSession.createDataFrame([("".join(p),) for p in permutations(FILTERS)], "filter_order string")


def replay(counts: DataFrame) -> DataFrame:
    """All orders over the rows of ``flagged``: a row a part, order and step."""
    each = counts.crossJoin(F.broadcast(orders(counts)))
    fails = F.array(*(F.col(f) for f in FILTERS))
    of = F.transform(F.split("filter_order", ""), lambda f: F.element_at(F.map_from_arrays(F.array(*map(F.lit, FILTERS)), fails), f))
    each = each.withColumns({"failing": of, "failures": F.size(F.filter(fails, lambda x: x))})
    # the step of the first failure; six if there is none
    at = F.array_position("failing", F.lit(True)).cast("int")
    each = each.withColumn("first", F.when(at > 0, at).otherwise(len(FILTERS) + 1))
    steps = each.select("*", F.posexplode("failing").alias("__i", "fail")).withColumn("step", F.col("__i") + 1)
    here, n = F.col("first") == F.col("step"), F.col("n")
    total = lambda condition: F.sum(F.when(condition, n).otherwise(0))
    out = steps.groupBy("part", "filter_order", "step").agg(
        total(F.col("first") > F.col("step")).alias("kept"),
        total(here).alias("removed"),
        total(F.col("fail") & (F.col("first") < F.col("step"))).alias("redundant"),
        total(F.col("fail") & (F.col("failures") == 1)).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
    )
    out = out.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    # 120 rows a part and filter
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``filter_order``, ``step``, ``filter`` and the counts of every step (see the module)."""
    return replay(flagged(docs, labels))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT t.doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
g AS (SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, a::INT + b::INT + c::INT + d::INT + e::INT AS failures FROM f LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
s AS (SELECT part, filter_order, step::INTEGER AS step, filter_order[step] AS filter, good, toxic, failures,
  CASE filter_order[step] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fail,
  (step > 1 AND (a AND contains(filter_order[1:step - 1], 'A') OR b AND contains(filter_order[1:step - 1], 'B') OR c AND contains(filter_order[1:step - 1], 'C')
    OR d AND contains(filter_order[1:step - 1], 'D') OR e AND contains(filter_order[1:step - 1], 'E'))) AS gone FROM g, o, range(1, 6) n(step)),
k AS (SELECT part, filter_order, step, filter, count(*) FILTER (NOT gone AND NOT fail) AS kept, count(*) FILTER (fail AND NOT gone) AS removed, count(*) FILTER (fail AND gone) AS redundant,
  count(*) FILTER (fail AND failures = 1) AS unique_fails, count(*) FILTER (fail AND NOT gone AND good) AS good_lost, count(*) FILTER (fail AND NOT gone AND toxic) AS toxic_lost FROM s GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM k"""
