"""A Spark data source of element text: folders of three-line records, read file by file and written back.

Raw lines come as ``source_file``, ``rec`` (from 0), ``name``, ``line1``,
``line2``; ``tle.parse`` and ``tle.reject_reason`` do the rest on the JVM side.
Files are streamed line by line, so a file may be larger than a row can be, and
are dealt to tasks in groups of about ``GROUP_BYTES``.  Paths are any that
Arrow's file systems know (plain paths are local).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.sources import tle

RAW = "source_file string, rec long, name string, line1 string, line2 string"
GROUP_BYTES = 16 << 20
FORMAT = "element_text"
#: Columns of the small schema, for users that only follow the elements.
LITE = ("source_file", "rec", "norad", "epoch_us", "inc", "raan", "ecc", "aop", "mean_anomaly", "mean_motion", "bstar", "reject")


def _source():
    """The data source's class; it is made here so that workers need no import of this module."""
    import fnmatch

    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

    schema, group_bytes, name = RAW, GROUP_BYTES, FORMAT

    def opened(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    class Group(InputPartition):
        def __init__(self, files):
            self.files = files

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            from pyarrow import fs

            system, root = opened(self.options["path"])
            own = system.get_file_info(root)
            found = [own] if own.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
            # hidden and temporary files are never data
            files = sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.base_name)
            if pattern := self.options.get("glob"):
                files = [f for f in files if fnmatch.fnmatch(f.base_name, pattern)]
            if only := self.options.get("only"):
                wanted = {x.strip().lower() for x in only.split(",")}
                files = [f for f in files if f.base_name.lower() in wanted]
            if most := self.options.get("files"):
                files = files[: int(most)]
            groups, held = [[]], 0
            for f in files:
                if groups[-1] and held + f.size > group_bytes:
                    groups.append([])
                    held = 0
                groups[-1].append(f.path)
                held += f.size
            return [Group(g) for g in groups]

        def read(self, partition):
            import io

            system, _ = opened(self.options["path"])
            for path in partition.files:
                file = path.rsplit("/", 1)[-1]
                with io.TextIOWrapper(system.open_input_file(path), encoding="utf-8", errors="replace", newline=None) as text:
                    rec, lines = 0, []
                    for raw in text:
                        line = raw.rstrip("\r\n")
                        if not line.strip():
                            continue
                        lines.append(line)
                        if len(lines) == 3:
                            yield (file, rec, *lines)
                            rec, lines = rec + 1, []
                    if lines:
                        yield (file, rec, *lines, *[None] * (3 - len(lines)))

    class Written(WriterCommitMessage):
        def __init__(self, moves):
            self.moves = moves

    class Writer(DataSourceWriter):
        """Every task writes its files under names of its own; they get theirs when all tasks are done."""

        def __init__(self, options, overwrite):
            self.options, self.overwrite = options, overwrite

        def write(self, iterator):
            import uuid

            system, root = opened(self.options["path"])
            system.create_dir(root, recursive=True)
            moves, now, out = [], None, None
            try:
                for row in iterator:
                    if row.source_file != now:
                        if out:
                            out.close()
                        now, part = row.source_file, f"{root}/_{uuid.uuid4().hex}"
                        moves.append((part, f"{root}/{now}"))
                        out = system.open_output_stream(part)
                    out.write(f"{row.name}\n{row.line1}\n{row.line2}\n".encode())
            finally:
                if out:
                    out.close()
            return Written(moves)

        def commit(self, messages):
            system, _ = opened(self.options["path"])
            moves = [m for x in messages if x for m in x.moves]
            if len({to for _, to in moves}) < len(moves):
                self.abort(messages)
                raise ValueError("rows of one file came from several tasks")
            for part, to in moves:
                system.move(part, to)

        def abort(self, messages):
            system, _ = opened(self.options["path"])
            for part, _ in [m for x in messages if x for m in x.moves]:
                system.delete_file(part)

    class ElementText(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

        def writer(self, schema, overwrite):
            return Writer(self.options, overwrite)

    return ElementText


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("element_text")`` known to a session."""
    spark.dataSource.register(_source())


def read(spark: SparkSession, path: str, glob: str = "*.txt", only: list[str] | None = None, files: int | None = None, lite: bool = False) -> DataFrame:
    """Parsed records of a folder (or a file) with ``reject`` reasons.

    ``only`` takes files by name, in any case; ``files`` the first so many by
    name; ``lite`` the columns ``LITE``.  Lines left over at a file's end are a
    record that is rejected as partial.  A folder without files has no rows.
    """
    register(spark)
    source = spark.read.format(FORMAT).option("glob", glob)
    if only is not None:
        source = source.option("only", ",".join(only) or ",")
    if files is not None:
        source = source.option("files", str(files))
    out = tle.parse(source.load(path)).withColumn("reject", tle.reject_reason())
    # a number that can't be read spoils its record
    numbers = ("epoch_us", "inc", "raan", "ecc", "aop", "mean_anomaly", "mean_motion")
    unread = F.lit(False)
    for c in numbers:
        unread = unread | F.col(c).isNull()
    out = out.withColumn("reject", F.coalesce("reject", F.when(unread, "unreadable_number")))
    return out.select(*LITE) if lite else out


def skipped(records: DataFrame) -> DataFrame:
    """``source_file``, ``reject`` and ``n``: how many records of each file were left out, and why."""
    return records.where("reject IS NOT NULL").groupBy("source_file", "reject").agg(F.count("*").alias("n"))


def write(records: DataFrame, path: str, since: int | None = None) -> None:
    """Write records that are not rejected as files of their ``source_file``, in order, from an epoch (microseconds) on.

    A file is written by one task, as a stream.  Files come into being when all
    are written; a file that is there already is replaced.
    """
    register(records.sparkSession)
    own = records.where("reject IS NULL AND source_file IS NOT NULL")
    if since is not None:
        own = own.where(F.col("epoch_us") >= since)
    rows = own.repartition("source_file").sortWithinPartitions("source_file", "rec").select("source_file", "rec", "name", "line1", "line2")
    rows.write.format(FORMAT).mode("append").save(path)
