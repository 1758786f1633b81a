"""Queries take every row: tables with objects and parts beyond the first."""

import os

import pytest
from compare import TABLES, database, same

from epochal import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
OBJECTS = ["lomb_scargle", "dft_small", "lagged_xcorr", "posterior_summary", "hdi", "rhat", "sync_target_nearest"]
TOTALS = ["weighted_quantiles", "precision_mean", "w1_pairs", "sync_exact_intersection"]


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """Objects 0 to 60, one more of a single row, and one of them constant, and 900 parts."""
    folder = tmp_path_factory.mktemp("wide")
    db = database(SF_DIR)
    db.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id = 61 THEN 62 ELSE event_id % 61 END AS user_id, CASE WHEN event_id % 61 = 60 THEN 5.0 ELSE value END AS value) FROM events) TO '{folder}/events.parquet'")
    db.execute(f"COPY (SELECT p.* REPLACE (i AS p_partkey) FROM range(1, 901) t(i) JOIN part p ON p.p_partkey = (i - 1) % 200 + 1) TO '{folder}/part.parquet'")
    for name in set(TABLES) - {"events", "part"}:
        os.symlink(f"{SF_DIR}/{name}.parquet", folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", OBJECTS + TOTALS)
def test_all_objects_as_in_sql(spark, wide, name):
    out = catalog.queries()[name](spark, wide)
    same(out, database(wide), catalog.oracle_sql()[name])
    if name in OBJECTS:
        assert {r[0] for r in out.select("object").distinct().collect()} > set(range(1, 60))


@pytest.mark.parametrize("name", ["fft_amplitude", "welch_density", "wavelet_z", "metropolis_draws"])
def test_kernels_take_all_objects(spark, wide, name):
    assert {r[0] for r in catalog.queries()[name](spark, wide).select("object").distinct().collect()} > set(range(1, 60))


def test_assignment_takes_all_parts(spark, wide):
    rows = catalog.queries()["assignment"](spark, wide).collect()
    assert {r.problem for r in rows} == set(range(12))
    assert all(len({r.row for r in rows if r.problem == p}) == 10 for p in range(8))


def test_parts_are_dealt_from_nought(spark, tmp_path):
    """Part keys begin with 0: 800 parts are eight full problems."""
    database(SF_DIR).execute(f"COPY (SELECT i AS p_partkey, (i * 37 % 101)::DOUBLE AS p_retailprice FROM range(800) t(i)) TO '{tmp_path}/part.parquet'")
    rows = catalog.queries()["assignment"](spark, str(tmp_path)).collect()
    assert {(r.problem, r.row) for r in rows} == {(p, i) for p in range(8) for i in range(10)} and len(rows) == 80


# -- every order --------------------------------------------------------------
@pytest.fixture(scope="module")
def gaps(tmp_path_factory):
    """Orders of the first year, without those of some days."""
    folder = tmp_path_factory.mktemp("gaps")
    db = database(SF_DIR)
    db.execute(f"COPY (SELECT * REPLACE (TIMESTAMP '2020-01-01' + to_days((o_orderkey % 300)::INT) AS o_orderdate) FROM orders WHERE o_orderkey % 300 % 7 NOT IN (2, 3)) TO '{folder}/orders.parquet'")
    for name in set(TABLES) - {"orders"}:
        os.symlink(f"{SF_DIR}/{name}.parquet", folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["calendar_gapfill", "centered_81d_mean", "history_lags", "forecast_errors", "sliding_windows"])
def test_all_orders_as_in_sql(spark, gaps, name):
    out = catalog.queries()[name](spark, gaps)
    same(out, database(gaps), catalog.oracle_sql()[name])
    assert "o_orderkey" not in catalog.oracle_sql()[name]


def test_calendar_counts_every_order(spark, gaps):
    rows = catalog.queries()["calendar_gapfill"](spark, gaps).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{gaps}/orders.parquet").count()
    assert any(r.n == 0 and r.v for r in rows)
