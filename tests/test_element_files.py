"""Element text read and written through the data source."""

import pytest
from pyspark.sql import functions as F

from epochal.sources import element_files, tle

DAY = 86_400_000_000


def triplet(spark, norad, day, inc=53.0, raan=10.0, motion=15.05):
    cells = [F.lit(norad), F.lit(2024), F.lit(day), F.lit(inc), F.lit(raan), F.lit(1234), F.lit(motion)]
    r = spark.range(1).select(*tle.format_lines(*cells)).first()
    return [f"SAT-{norad}", r.line1, r.line2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("elements")
    a = [triplet(spark, 101, d) for d in (1.5, 2.25, 3.75)]
    b = [triplet(spark, 102, d) for d in (5.0, 6.0)]
    wrong = [["X", "2 swapped", b[0][1]], ["X", b[0][1][:40], b[0][2]], ["X", a[0][1], b[0][2]], ["X", b[0][1], b[0][2][:8] + "  what  " + b[0][2][16:]]]
    (path / "sat101.txt").write_bytes("\r\n".join("\r\n\r\n".join(t) for t in a).encode())
    (path / "SAT102.txt").write_text("\n".join("\n".join(t) for t in [b[0], *wrong, b[1]]) + "\nleft\nover\n")
    (path / "empty.txt").write_text("\n \n")
    (path / "odd.txt").write_bytes(b"caf\xe9\n1 x\n")
    (path / "notes.md").write_text("no elements")
    (path / "_part").write_text("no data")
    return str(path)


def test_records_and_counts_of_what_was_skipped(spark, folder):
    rows = element_files.read(spark, folder)
    good = rows.where("reject IS NULL").orderBy("source_file", "rec").collect()
    assert [(r.source_file, r.rec, r.norad) for r in good] == [("SAT102.txt", 0, "00102"), ("SAT102.txt", 5, "00102"), *(("sat101.txt", k, "00101") for k in range(3))]
    assert all(r.checksum1_ok and r.checksum2_ok and r.inc == 53.0 and r.ecc == 0.0001234 for r in good)
    counts = {(r.source_file, r.reject): r.n for r in element_files.skipped(rows).collect()}
    assert counts == {**{("SAT102.txt", k): 1 for k in ("line_numbers", "too_short", "different_objects", "unreadable_number", "partial")}, ("odd.txt", "partial"): 1}


def test_files_by_name_number_and_schema(spark, folder):
    names = lambda df: {r.source_file for r in df.select("source_file").distinct().collect()}
    assert names(element_files.read(spark, folder, only=["sat102.TXT", "missing.txt"])) == {"SAT102.txt"}
    assert names(element_files.read(spark, folder, only=[])) == set()
    assert names(element_files.read(spark, folder, files=1)) == {"SAT102.txt"}
    assert names(element_files.read(spark, folder + "/sat101.txt")) == {"sat101.txt"}
    assert names(element_files.read(spark, folder, glob="*.dat")) == set()
    assert element_files.read(spark, folder, lite=True).columns == list(element_files.LITE)


def test_round_trip(spark, folder, tmp_path):
    rows = element_files.read(spark, folder)
    first = str(tmp_path / "all")
    element_files.write(rows, first)
    again = element_files.read(spark, first)
    lines = lambda df: sorted((r.source_file, r.name, r.line1, r.line2) for r in df.where("reject IS NULL").collect())
    assert lines(again) == lines(rows) and element_files.skipped(again).collect() == []
    since = again.where("norad = '00101'").agg(F.max("epoch_us")).first()[0]
    element_files.write(again, str(tmp_path / "late"), since=since)
    late = element_files.read(spark, str(tmp_path / "late")).orderBy("epoch_us").collect()
    assert [(r.norad, r.rec) for r in late] == [("00101", 0), ("00102", 0), ("00102", 1)]
    # a second write replaces the files
    element_files.write(rows, first)
    assert lines(element_files.read(spark, first)) == lines(rows)


def test_epochs_are_written_with_their_carry(spark):
    year = 19_723 * DAY  # 2024-01-01
    cases = {year: "24001.00000000", year + DAY // 2: "24001.50000000", year - 1: "24001.00000000", year - 500: "23365.99999999", year + 366 * DAY - 1: "25001.00000000", -1_000_000: "69365.99998843"}
    got = spark.createDataFrame([(t,) for t in [*cases, None]], "t long").select("t", tle.epoch_field(F.col("t")).alias("e")).collect()
    assert {r.t: r.e for r in got} == {**cases, None: None}
    back = spark.createDataFrame([(e, t) for t, e in cases.items()], "e string, t long").select("t", tle.epoch_micros(F.col("e")).alias("b")).collect()
    assert all(abs(r.b - r.t) <= 500 for r in back)
