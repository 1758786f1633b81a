"""Mixing (11): quotas against all quotients, targets against a plain loop, whole results."""

import random
from collections import Counter

import pytest
from compare import same
from pyspark.sql import functions as F

from epochal.llm import mixing


def documents(spark, rows):
    """(doc_id, source, words) as rows with columns of clashing names."""
    made = [(i, s, None if n is None else " ".join(["w"] * n), 1, 1, "x") for i, s, n in rows]
    return spark.createDataFrame(made, "doc_id long, source string, text string, size long, shard long, row string")


def highest(votes, seats):
    """Seats by a list of all quotients; ties to the smaller party."""
    quotients = sorted(((-v / (2 * k + 1), p) for p, v in votes.items() if v > 0 for k in range(seats)))
    won = Counter(p for _, p in quotients[:seats])
    return {p: won[p] for p in votes}


def level(sizes, weights):
    """Targets by capping one source after another."""
    words, capped = 1.5 * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = words - sum(2 * sizes[i] for i in capped)
        weight = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] > 2 * sizes[i] * weight]
        if not over:
            return [2.0 * sizes[i] if i in capped else rest * weights[i] / weight for i in range(len(sizes))]
        capped |= set(over)


@pytest.mark.parametrize("seed", range(4))
def test_seats_go_to_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    groups = {g: {p: rng.choice([0, 1, 5, 5, 40, rng.randint(0, 10**6)]) for p in range(rng.randint(1, 30))} for g in range(6)}
    seats = {g: rng.choice([0, 1, 3, len(v) // 2, 97]) for g, v in groups.items()}
    rows = [(g, p, n, seats[g]) for g, v in groups.items() for p, n in v.items()]
    df = spark.createDataFrame(rows, "g long, p long, n long, s long")
    got = {(r.g, r.p): r.quota for r in mixing.shard_seats(df, "g", "p", "n", "s").collect()}
    want = {(g, p): k for g, v in groups.items() for p, k in highest(v, seats[g]).items()}
    assert got == want
    one = df.where("g = 0")
    assert {r.p: r.quota for r in mixing.source_seats(one, "p", "n", 211).collect()} == highest(groups[0], 211)


@pytest.mark.parametrize("sizes", [[5], [10, 10, 10], [1, 1000, 3, 0, 500, 500, 7], [0, 0], [10**6, 1, 1, 1]])
def test_targets_stop_at_the_cap(spark, sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    df = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))], "i long, source_size long, weight long")
    got = [r.target for r in mixing.with_targets(df).orderBy("i").collect()]
    assert got == pytest.approx(level(sizes, weights))
    assert sum(got) == pytest.approx(1.5 * sum(sizes))


def some_rows():
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "B", "é", "", None, "hot", "hot", "hot"]), rng.choice([None, 0, 1, 3, 50, 700])) for i in range(900)]
    return [*rows, (None, "a", 20), (None, "a", 20), (5, "a", 9), (5, "a", 9), (1000, "long", 60_000), (1001, "tiny", 1)]


def test_rows_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 64)
    rows = some_rows()
    out = mixing.mix(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((i, s, n or 0) for i, s, n in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    own, took = Counter(), Counter()
    for r in out:
        own[r.source] += r.size
        took[r.source] += r.taken
    assert all(r.source_size == own[r.source] for r in out)
    for source, target in {r.source: r.target for r in out}.items():
        assert abs(took[source] - target) <= mixing.BLOCK * 16 and abs(took[source] - target) <= max(1, 0.02 * target)
    again = mixing.mix(documents(spark, rows[::-1]).repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_same_rows_as_sql(spark, tmp_path):
    import duckdb

    path = str(tmp_path / "d")
    documents(spark, some_rows()).repartition(2).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT doc_id, source, text FROM read_parquet('{path}/*.parquet')")
    same(mixing.mix(spark.read.parquet(path)).drop("source"), db, f"SELECT * EXCLUDE (source) FROM ({mixing.SQL})")


def test_nothing_to_mix(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    blank = mixing.mix(documents(spark, [(1, "a", 0), (2, None, None)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in blank) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_no_python_worker_in_the_plan(spark):
    plan = mixing.mix(documents(spark, [(1, "a", 5)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.n == r.x for r in mixing.numbered(df, [F.col("x")], "test-numbers", "n").collect())
