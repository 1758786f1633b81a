"""Orbital expressions, element text, sources, sinks, pipeline and streams."""

import math

import pytest
from pyspark.sql import functions as F

from epochal.functions import angles, orbital
from epochal.plans import pipeline
from epochal.sources import drivers, sinks, tle
from epochal.sources.tables import DAY
from epochal.streaming import windows

ONE = "1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927"
TWO = "2 25544  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_wraps(spark):
    for x in (-10.0, 0.0, 180.0, 359.5, 720.0):
        assert value(spark, angles.wrap_360(F.lit(x))) == x % 360
        assert value(spark, angles.wrap_180(F.lit(x))) == (x + 180) % 360 - 180


@pytest.mark.parametrize("ecc", [0.0, 0.1, 0.7])
@pytest.mark.parametrize("mean", [0.0, 90.0, 180.0, 300.0])
def test_kepler(spark, ecc, mean):
    e = value(spark, orbital.eccentric_anomaly(F.lit(math.radians(mean)), F.lit(ecc)))
    assert abs(e - ecc * math.sin(e) - math.radians(mean)) < 1e-9


def test_j2_rates_of_a_low_orbit(spark):
    args = (F.lit(6921.0), F.lit(1e-4), F.lit(53.0))
    node, perigee, anomaly = (value(spark, f(*args)) for f in (orbital.node_rate, orbital.perigee_rate, orbital.anomaly_rate))
    assert -7 < math.degrees(node * 86400) < -2 and perigee > 0
    assert abs(anomaly / math.sqrt(orbital.MU / 6921.0**3) - 1) < 0.01


def test_state_vector_has_the_orbits_energy(spark):
    parts = orbital.state_vector(*(F.lit(float(x)) for x in (7000, 0.01, 60, 20, 30, 40)))
    r = spark.range(1).select(*(c.alias(n) for n, c in parts.items())).first()
    speed, radius = (math.sqrt(sum(r[c] ** 2 for c in names)) for names in (("vx", "vy", "vz"), ("x", "y", "z")))
    assert abs(speed**2 / 2 - orbital.MU / radius + orbital.MU / 14000) < 1e-8


def test_element_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text(f"NAME\n{ONE}\n\n{TWO}\nB\n{ONE[:60]}\n{TWO}\nC\n{ONE}\n")
    rows = tle.read(spark, str(tmp_path)).orderBy("rec").collect()
    assert [r.reject for r in rows] == [None, "too_short", "partial"]
    first = rows[0]
    assert first.norad == "25544" and first.checksum1_ok and first.checksum2_ok
    assert (first.inc, first.raan, first.ecc, first.mean_motion) == (51.6416, 247.4627, 0.0006703, 15.72125391)
    assert abs(first.bstar + 0.11606e-4) < 1e-12 and first.mean_motion_dot == -0.00002182
    assert first.epoch_us == 1_221_868_800_000_000 + round(0.51782528 * 864e8)


def test_assumed_decimal(spark):
    for text, want in (("+34124-4", 0.34124e-4), ("-11606-4", -0.11606e-4), ("0.5", 0.5), ("        ", None), ("x", None)):
        got = value(spark, tle.assumed_decimal(F.lit(text)))
        assert got == want or abs(got - want) < 1e-15


def test_driver_calendar(spark, tmp_path):
    (tmp_path / "k.csv").write_text("DATE,KP_SUM,AP_AVG,F10.7_OBS\n2024-01-01,80,10,100\n2024-01-04,160,x,130\nbad,1,1,1\n")
    raw = spark.read.csv(str(tmp_path / "k.csv"), header=True).withColumnRenamed("F10.7_OBS", "F107")
    table = raw.select(F.col("DATE").try_cast("date").alias("date"), F.col("F107").try_cast("double").alias("f107")).where("date IS NOT NULL")
    got = [r.f107 for r in drivers.merged([table], "2023-12-31", "2024-01-05").orderBy("date").collect()]
    assert got == [100.0, 100.0, 110.0, 120.0, 130.0, 130.0]


def test_indices_from_csv(spark, tmp_path):
    (tmp_path / "k.csv").write_text("DATE,KP_SUM,AP1,AP2,F10.7_OBS\n2024-01-01,80,10,20,100\nbad,1,1,1,1\n")
    r = drivers.read_indices(spark, str(tmp_path / "k.csv")).collect()
    assert [(x.kp, x.ap, x.f107) for x in r] == [(1.0, 15.0, 100.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["b", "a"], {"k": 1})], "id int, tags array<string>, m map<string,int>")
    sinks.write(df, str(tmp_path / "o"), "csv", provenance={"filters": ["x"]})
    row = spark.read.csv(str(tmp_path / "o"), header=True).first()
    assert row.tags == '["a","b"]' and row.m == '{"k":1}'
    assert '"filters": ["x"]' in spark.read.text(str(tmp_path / "o.provenance")).first().value
    assert sinks.with_required(df, ["id", "absent"]).first().absent is None


def test_pipeline(spark):
    rows = [(o, d * DAY, float(10 + o + (d % 3)), o * 1000 + d) for o in (1, 2) for d in range(40)] + [(1, 0, None, 9001), (3, 0, 9999.0, 9002), (1, 0, 11.5, 9003)]
    panel = spark.createDataFrame(rows, "object long, t long, value double, rec long")
    got = pipeline.run(panel, {"quality": {"highest": 100.0}})
    assert {r.reasons for r in got.rejected.collect()} == {"no_value", "too_high"}
    assert got.panel.count() == 80 and got.panel.where("rec = 9003").count() == 1
    assert got.states.count() == 80 and got.intervals.agg(F.sum("n_records")).first()[0] == 80
    assert got.config["dedup"]["keep"] == "last" and pipeline.DEFAULTS["quality"]["highest"] == 500.0
    with pytest.raises(KeyError, match="value"):
        pipeline.run(panel.drop("value"))


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "low", 1.0), (1, "2024-01-02 00:00:00", "low", 2.0), (2, "2024-02-01 00:00:00", "high", 3.0)], "object long, ts string, shell string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(src))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(src))

    def drain(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.n_records for r in drain(windows.tumbling_occupancy(read()), "tumbling", "complete")) == [1, 2]
    assert len(drain(windows.sessions(read()), "sessions", "complete")) == 3
    states = drain(windows.debounced_states(read().withColumnRenamed("shell", "state").select("object", "state"), least=2), "debounced", "append")
    assert [(r.object, r.from_state, r.to_state) for r in states] == [(1, None, "low")]
