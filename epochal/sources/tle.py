"""Two-line element text: fixed-width parsing, checksums and writing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Two-digit years from here on are of the last century.
PIVOT_YEAR = 57
LEAST_LENGTHS = (68, 63)


def assumed_decimal(field: Column) -> Column:
    """``+34124-4`` is 0.34124e-4; plain numbers are themselves; blank or malformed is null."""
    text = F.trim(field)
    parts = r"^([+-]?)(\d+)([+-]\d+)$"
    made = F.concat(F.regexp_extract(text, parts, 1), F.lit("0."), F.regexp_extract(text, parts, 2), F.lit("e"), F.regexp_extract(text, parts, 3))
    return F.when(text.rlike(parts), made.try_cast("double")).otherwise(text.try_cast("double"))


def checksum(line: Column) -> Column:
    """Digits of the first 68 characters summed, a minus sign counts one, modulo ten."""
    head = F.substring(line, 1, 68)
    digits = F.split(F.regexp_replace(F.replace(head, F.lit("-"), F.lit("1")), "[^0-9]", ""), "")
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + F.coalesce(d.try_cast("int"), F.lit(0)))
    return total % 10


def epoch_micros(field: Column) -> Column:
    """``YYDDD.ffffffff`` as microseconds since 1970."""
    yy = F.substring(field, 1, 2).try_cast("int")
    day = F.substring(field, 3, 12).try_cast("double")
    year = yy + F.when(yy >= PIVOT_YEAR, 1900).otherwise(2000)
    start = F.datediff(F.make_date(year, F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("long")
    return (start - 1) * 86_400_000_000 + F.round(day * 86_400_000_000.0).cast("long")


def epoch_field(micros: Column) -> Column:
    """``YYDDD.ffffffff`` of microseconds since 1970; a fraction that rounds to a whole day is carried into the day and the year."""
    day = F.floor(micros / 86_400_000_000)
    part = F.round((micros - day * 86_400_000_000) / 864.0).cast("long")
    day = day + F.when(part >= 100_000_000, 1).otherwise(0)
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    return F.concat(F.lpad((F.year(date) % 100).cast("string"), 2, "0"), F.lpad(F.dayofyear(date).cast("string"), 3, "0"), F.lit("."), F.lpad((part % 100_000_000).cast("string"), 8, "0"))


def parse(df: DataFrame, line1: str = "line1", line2: str = "line2") -> DataFrame:
    """Adds the elements of both lines; what can't be read is null."""
    one, two = F.col(line1), F.col(line2)
    cut = lambda c, a, b: F.trim(F.substring(c, a, b - a + 1))
    number = lambda c, a, b: cut(c, a, b).try_cast("double")
    return df.withColumns(
        {
            "norad": cut(one, 3, 7),
            "classification": cut(one, 8, 8),
            "international_designator": cut(one, 10, 17),
            "epoch_us": epoch_micros(cut(one, 19, 32)),
            "mean_motion_dot": number(one, 34, 43),
            "mean_motion_ddot": assumed_decimal(F.substring(one, 45, 8)),
            "bstar": assumed_decimal(F.substring(one, 54, 8)),
            "element_number": cut(one, 65, 68).try_cast("int"),
            "checksum1_ok": checksum(one) == F.substring(one, 69, 1).try_cast("int"),
            "inc": number(two, 9, 16),
            "raan": number(two, 18, 25),
            "ecc": F.concat(F.lit("0."), cut(two, 27, 33)).try_cast("double"),
            "aop": number(two, 35, 42),
            "mean_anomaly": number(two, 44, 51),
            "mean_motion": number(two, 53, 63),
            "norad2": cut(two, 3, 7),
            "checksum2_ok": checksum(two) == F.substring(two, 69, 1).try_cast("int"),
        }
    )


def reject_reason(line1: str = "line1", line2: str = "line2") -> Column:
    """Why a pair of lines can't be taken; null if it can."""
    one, two = F.col(line1), F.col(line2)
    return (
        F.when(one.isNull() | two.isNull(), "partial")
        .when(~F.startswith(one, F.lit("1")) | ~F.startswith(two, F.lit("2")), "line_numbers")
        .when((F.length(one) < LEAST_LENGTHS[0]) | (F.length(two) < LEAST_LENGTHS[1]), "too_short")
        .when(F.substring(one, 3, 5) != F.substring(two, 3, 5), "different_objects")
    )


def read(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Triplets of non-blank lines (name, line 1, line 2) of text files, parsed, with ``reject`` reasons and file name.

    A file is one row on its way: files of element sets are small, and lines
    must be counted in order within their file.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob).select("value", F.col("_metadata.file_name").alias("source_file"))
    own = F.filter(F.split(F.col("value"), "\r?\n"), lambda x: F.trim(x) != "")
    groups = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size("lines") / 3) - 1, F.lit(0)).cast("int")),
        lambda g: F.struct(g.alias("rec"), F.get("lines", g * 3).alias("name"), F.get("lines", g * 3 + 1).alias("line1"), F.get("lines", g * 3 + 2).alias("line2")),
    )
    rows = files.select("source_file", own.alias("lines")).where(F.size("lines") > 0).select("source_file", F.explode(groups).alias("g")).select("source_file", "g.*")
    return parse(rows).withColumn("reject", reject_reason())


def latest(df: DataFrame) -> DataFrame:
    """The newest set of each object."""
    w = Window.partitionBy("norad").orderBy(F.desc("epoch_us"), F.desc("rec"))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def format_lines(norad: Column, year: Column, day: Column, inc: Column, raan: Column, ecc_e7: Column, mean_motion: Column) -> list[Column]:
    """``line1`` and ``line2`` of elements (other fields zero), with checksums."""
    number = F.lpad(norad.cast("string"), 5, "0")
    epoch = F.concat(F.lpad((year % 100).cast("string"), 2, "0"), F.format_string("%012.8f", day.cast("double")))
    one = F.concat(F.lit("1 "), number, F.lit("U 00000A   "), epoch, F.lit("  .00000000  00000-0  00000-0 0  999"))
    two = F.concat(
        F.lit("2 "), number, F.lit(" "), F.format_string("%8.4f", inc.cast("double")), F.lit(" "), F.format_string("%8.4f", raan.cast("double")), F.lit(" "),
        F.lpad(ecc_e7.cast("string"), 7, "0"), F.lit("   0.0000   0.0000 "), F.format_string("%11.8f", mean_motion.cast("double")), F.lit("00000"),
    )
    return [F.concat(line, checksum(line).cast("string")).alias(name) for line, name in ((one, "line1"), (two, "line2"))]
