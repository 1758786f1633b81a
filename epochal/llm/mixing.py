"""Mixing sources to target weights: Sainte-Laguë quotas of equal blocks, then seeded blocks.

Sources are given targets in words (weights, with a cap of ``CAP`` times a
source's own size).  The mix is laid out in blocks of ``BLOCK`` words, and
blocks go to sources by the highest quotients target / (2k + 1); a source's
blocks go to its shards in the same way by the shards' sizes.  A shard takes
whole rounds of all its words, and for the rest its blocks in a seeded order.
What a target has beyond its whole blocks (or lacks) is settled in the
source's largest shard, and the last block of a shard is cut there, so a
source takes its target to the word, but for what shards beyond their cap
cannot hold (less than a block each).

Only sizes are shuffled: one narrow row a document, and one a block.  Texts
are read once.  A source is dealt into shards of about ``SHARD_ROWS`` rows
(at most ``MOST_SHARDS``) by a hash of their ids and texts, so a hot source is
many tasks; only rows equal in both stay together.
Highest quotients need no list of all quotients: with n parties, T votes and N
seats, divisors T / (N + n/2) and T / (N - n/2) bound every party's seats from
above and below, and at most 2n quotients lie between and are ranked.

Defined cases: a null text has size 0 and takes 0; a null source is a source
of its own, ranked last; an empty source name is a name.  Rows with a null or
repeated id are rows of their own.  An empty table gives no rows.  Other
columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochal.llm import storage, textstats

BLOCK = 256
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, in percent, and how often a source may be repeated.
SHARE_PERCENT = 150
CAP = 2
SHARD_ROWS = 2048
MOST_SHARDS = 4096
SEED = "mix-1"


def _hash(text: Column) -> Column:
    """The first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def numbered(df: DataFrame, order: list[Column], name: str, output: str) -> DataFrame:
    """``df`` with row numbers from 0 in a total order, without a task that sees all rows.

    Rows are dealt by ranges and written; numbers start at the count of the
    ranges before (one row a range).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = storage.written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), name)
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__c"))
    starts = counts.select(F.col("__part").alias("__p"), (F.sum("__c").over(Window.orderBy("__part")) - F.col("__c")).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(starts, F.col("__part") == F.col("__p")).withColumn(output, F.col("__first") + within - 1).drop("__part", "__p", "__first")


def candidate_quotients(parties: DataFrame, votes: str, total: Column, seats: Column, count: Column) -> DataFrame:
    """``parties`` with ``__sure`` (seats that a party has whatever happens) and ``__open``, the quotients that compete for the others."""
    v = F.col(votes).cast("double")
    low = F.when(2 * seats > count, F.floor(v * (seats - count / 2) / total + 0.5)).otherwise(0).cast("long")
    high = F.floor(v * (seats + count / 2) / total + 0.5).cast("long")
    none = F.array().cast("array<long>")
    # one more on either side: a quotient at a bound is not lost to rounding
    low, high = F.greatest(low - 1, F.lit(0)), high + 1
    some = (v > 0) & (seats > 0)
    out = parties.withColumn("__sure", F.when(some, low).otherwise(0).cast("long"))
    steps = F.when(some, F.sequence(low, high - 1)).otherwise(none)
    return out.withColumn("__open", F.transform(steps, lambda k: v / (2 * k + 1)))


def shard_seats(shards: DataFrame, group: str, party: str, votes: str, seats: str) -> DataFrame:
    """``shards`` with ``quota``: each group's seats to its parties by the highest quotients, ties to the smaller party.

    A group is a window: its parties must be few (here at most ``MOST_SHARDS``).
    """
    own = Window.partitionBy(group)
    out = shards.withColumns({"__total": F.sum(votes).over(own), "__count": F.count("*").over(own)})
    out = candidate_quotients(out, votes, F.col("__total"), F.col(seats), F.col("__count"))
    left = out.withColumn("__left", F.col(seats) - F.sum("__sure").over(own))
    ranked = left.select(*shards.columns, "__sure", "__left", F.explode_outer("__open").alias("__q"))
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("__q").desc_nulls_last(), party)))
    won = F.sum(F.when(F.col("__q").isNotNull() & (F.col("__rank") <= F.col("__left")), 1).otherwise(0))
    return ranked.groupBy(*shards.columns).agg((F.first("__sure") + won).alias("quota"))


def source_seats(parties: DataFrame, party: str, votes: str, seats: int) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` to parties of any number by the highest quotients, ties to the smaller party."""
    total, count = parties.agg(F.sum(votes), F.count("*")).first()
    if not total or seats <= 0:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    out = candidate_quotients(parties, votes, F.lit(float(total)), F.lit(seats), F.lit(count))
    left = seats - out.agg(F.sum("__sure")).first()[0]
    quotients = numbered(out.select(F.col(party).alias("__party"), F.explode("__open").alias("__q")), [F.col("__q").desc(), F.col("__party")], "mix-quotients", "__rank")
    won = quotients.where(F.col("__rank") < left).groupBy("__party").agg(F.count("*").alias("__won"))
    kept = out.drop("__open").join(won, F.col(party) == F.col("__party"), "left")
    return kept.withColumn("quota", F.col("__sure") + F.coalesce("__won", F.lit(0))).drop("__sure", "__party", "__won")


def with_targets(sources: DataFrame, size: str = "source_size", weight: str = "weight") -> DataFrame:
    """``sources`` with ``target``: ``SHARE_PERCENT`` of all sizes by weight, none above ``CAP`` times its own size.

    What is cut off is shared again by weight among the others until none is
    above: a level (words a unit of weight) rises over rounds, of which each
    caps a source at least.  A round is one aggregation; two sums come back.
    """
    total = sources.agg(F.sum(size)).first()[0] or 0
    words, weights, capped = total * SHARE_PERCENT / 100, sources.agg(F.sum(weight)).first()[0] or 0, -1
    above = F.lit(False)
    while weights:
        above = F.lit(words) * F.col(weight) > CAP * F.col(size) * F.lit(weights)
        n, cut, rest = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col(size))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col(weight))), F.lit(0))).first()
        if n == capped or not rest:
            break
        words, weights, capped = total * SHARE_PERCENT / 100 - CAP * cut, rest, n
    share = F.lit(words) * F.col(weight) / F.lit(max(weights, 1))
    return sources.withColumn("target", F.when(above, CAP * F.col(size).cast("double")).otherwise(share))


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` of every row (see the module)."""
    spark: SparkSession = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    key = _hash(F.concat_ws(":", F.col(doc_id).cast("string"), F.md5(body)))
    sized = storage.written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(textstats.words(body)).cast("long").alias("size"), key.alias("key")), "mix-sizes")
    sources = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), [F.col("source").asc_nulls_last()], "mix-names", "place")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS)).cast("int")).cast("long")
    sources = storage.written(with_targets(storage.written(sources.withColumn("weight", weight), "mix-weights")), "mix-targets")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    seated = source_seats(sources, "place", "target", round(words * SHARE_PERCENT / 100 / BLOCK))
    shards_of = F.least(F.lit(MOST_SHARDS), F.ceil(F.col("rows") / SHARD_ROWS))
    plan = storage.written(seated.withColumnsRenamed({"source": "__source", "quota": "seats"}).withColumn("shards", shards_of), "mix-plan")

    # every row's shard, and the budget in words of every shard
    known = sized.join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = known.select("doc_id", "source", "size", "source_size", "target", "place", "seats", (F.col("key") % F.col("shards")).alias("shard"))
    cells = rows.groupBy("place", "shard", "seats", "target").agg(F.sum("size").alias("words"))
    cells = shard_seats(cells, "place", "shard", "words", "seats")
    largest = F.row_number().over(Window.partitionBy("place").orderBy(F.col("words").desc(), "shard")) == 1
    rest = F.when(largest, F.round("target").cast("long") - BLOCK * F.col("seats")).otherwise(0)
    budget = F.greatest(F.lit(0), F.least(BLOCK * F.col("quota") + rest, CAP * F.col("words")))
    cells = storage.written(cells.select(F.col("place").alias("__place"), F.col("shard").alias("__shard"), "words", budget.cast("long").alias("budget")), "mix-budgets")

    # rows lie one after another in their shard; blocks are cut from that line
    line = rows.join(cells, (F.col("place") == F.col("__place")) & (F.col("shard") == F.col("__shard"))).drop("__place", "__shard")
    order = Window.partitionBy("place", "shard").orderBy("doc_id", "size")
    line = line.withColumns({"row": F.row_number().over(order), "start": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    over = F.when(F.col("words") > 0, F.col("budget") % F.col("words")).otherwise(0)
    rounds = F.when(F.col("words") > 0, F.floor(F.col("budget") / F.col("words"))).otherwise(0)
    # a row without words, or of a shard that takes whole rounds only, keeps one piece without length
    touched = (F.col("size") > 0) & (F.col("over") > 0)
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    line = line.withColumns({"over": over, "rounds": rounds})
    pieces = line.withColumn("block", F.explode(F.when(touched, F.sequence(first, last)).otherwise(F.array(first))))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest("start", F.col("block") * BLOCK)
    pieces = pieces.withColumns({"length": F.when(touched, inside).otherwise(0), "lot": _hash(F.concat_ws(":", F.lit(SEED), "place", "shard", "block"))})
    drawn = Window.partitionBy("place", "shard").orderBy("lot", "block", "row").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("length").over(drawn) - F.col("length")
    pieces = pieces.withColumn("got", F.greatest(F.lit(0), F.least("length", F.col("over") - before)))
    taken = (F.first("rounds") * F.first("size") + F.sum("got")).cast("long")
    out = pieces.groupBy("place", "shard", "row").agg(*(F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")), taken.alias("taken"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (SELECT doc_id, source, ('0x' || substr(md5(concat_ws(':', doc_id, md5(coalesce(text, '')))), 1, 8))::BIGINT AS key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[place % 3 + 1] AS weight, sum(source_size) OVER ()::BIGINT AS total FROM s),
-- sources in the order in which a rising level caps them; the first that the level leaves uncapped sets it
r AS (SELECT *, 2 * source_size / weight::DOUBLE AS cap, (1.5::DOUBLE * total - 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) AS rest,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights FROM w WINDOW o AS (ORDER BY 2 * source_size / weight::DOUBLE, place)),
l AS (SELECT rest, weights FROM r WHERE rest <= cap * weights ORDER BY cap, place LIMIT 1),
t AS (SELECT r.source, r.place, r.source_size, r.total, least(4096, ceil(r.n / 2048.0))::BIGINT AS shards,
  CASE WHEN l.rest * r.weight > 2 * r.source_size * l.weights THEN 2.0::DOUBLE * r.source_size ELSE l.rest * r.weight / l.weights END AS target FROM r, l),
h AS (SELECT *, (SELECT sum(target) FROM t) AS votes, round_even(1.5::DOUBLE * total / 256, 0)::BIGINT AS house FROM t),
q AS (SELECT place, unnest(list_transform(range(0, (target * (house + 0.5::DOUBLE * (SELECT count(*) FROM t)) / nullif(votes, 0) + 2)::BIGINT), lambda k: target / (2 * k + 1))) AS q, house FROM h WHERE target > 0),
b AS (SELECT place, count(*)::BIGINT AS seats FROM (SELECT *, row_number() OVER (ORDER BY q DESC, place) AS rank FROM q) WHERE rank <= house GROUP BY place),
g AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.place, coalesce(b.seats, 0) AS seats,
  d.key % t.shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN b ON b.place = t.place),
c AS (SELECT place, shard, seats, target, sum(size)::BIGINT AS words, row_number() OVER (PARTITION BY place ORDER BY sum(size) DESC, shard) AS big FROM g GROUP BY place, shard, seats, target),
e AS (SELECT place, shard, seats, unnest(list_transform(range(0, seats), lambda k: words / (2 * k + 1)::DOUBLE)) AS q FROM c WHERE words > 0),
f AS (SELECT place, shard, count(*)::BIGINT AS quota FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY q DESC, shard) AS rank FROM e) WHERE rank <= seats GROUP BY place, shard),
u AS (SELECT c.place, c.shard, c.words, greatest(0, least(256 * coalesce(f.quota, 0) + CASE WHEN big = 1 THEN round(c.target)::BIGINT - 256 * c.seats ELSE 0 END, 2 * c.words))::BIGINT AS budget FROM c LEFT JOIN f USING (place, shard)),
p AS (SELECT g.*, u.words, u.budget, row_number() OVER o AS row, sum(g.size) OVER (o ROWS UNBOUNDED PRECEDING)::BIGINT - g.size AS start FROM g JOIN u USING (place, shard) WINDOW o AS (PARTITION BY g.place, g.shard ORDER BY g.doc_id NULLS FIRST, g.size)),
x AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(start // 256, (start + size - 1) // 256 + 1) ELSE [start // 256] END) AS block FROM p),
y AS (SELECT *, CASE WHEN size > 0 THEN least(start + size, (block + 1) * 256) - greatest(start, block * 256) ELSE 0 END AS length, ('0x' || substr(md5('{SEED}:' || place || ':' || shard || ':' || block), 1, 8))::BIGINT AS lot FROM x),
z AS (SELECT *, CASE WHEN words > 0 THEN greatest(0, least(length, budget % words - (sum(length) OVER (PARTITION BY place, shard ORDER BY lot, block, row ROWS UNBOUNDED PRECEDING) - length))) ELSE 0 END AS got FROM y)
SELECT any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  (any_value(CASE WHEN words > 0 THEN budget // words * size ELSE 0 END) + sum(got))::BIGINT AS taken FROM (SELECT z.*, t.source FROM z JOIN t USING (place)) GROUP BY place, shard, row"""
