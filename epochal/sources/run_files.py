"""Files of runs and labels as tables: lists of files, CSV by each file's own header, intervals, controls, assignments, policies, chains, arcs.

Readers give all rows, with ``source_file`` and (where rows can be wrong) a
``reject`` reason that is null for good rows; ``counts`` tells how many went
and why.  Nothing is dropped on the way.  The first line of every file is read
in tasks, by Arrow's file systems; contents are read by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochal.operators import policies
from epochal.sources.tables import micros

#: Phases of controls and the direction of their thrust.
THRUST_SIGNS = {"insertion_or_orbit_raise": 1, "operational_shell": 1, "disposal_lowering": -1}
CONTROLS = ("duty_cycle", "mean_thrust_N", "mean_isp_s", "mean_efficiency")
FITTED = ("mass_kg", "dry_mass_kg", "isp_s", "eta_total")
#: Ends of the names of a run's files.
CHAIN_SUFFIXES = {"posterior": "_posterior_samples.csv", "trace": "_chain_traces.csv", "observations": "_observations_used.csv"}
#: Different headers that one call reads; more are taken for a folder of something else.
MOST_HEADERS = 1000


def listed(spark: SparkSession, path: str, glob: str = "*", allow: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """``path``, ``file``, ``folder`` and ``bytes`` of the files below a path; contents are not read.

    ``allow``: a table with a column ``file``; only these names (in any case,
    blanks around them left out) count.  ``most``: so many first ones by name.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    out = found.select("path", F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("folder"), F.col("length").alias("bytes"))
    out = out.where(~F.substring("file", 1, 1).isin(".", "_"))
    if allow is not None:
        wanted = allow.select(F.lower(F.trim("file")).alias("__f")).where("__f <> ''").distinct()
        out = out.join(wanted, F.lower("file") == F.col("__f"), "left_semi")
    return out if most is None else out.orderBy("file", "path").limit(most)


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io

    from pyarrow import fs

    for batch in batches:
        heads = []
        for path in batch["path"]:
            uri = "file:///" + path[6:].lstrip("/") if path.startswith("file:") else path
            system, place = fs.FileSystem.from_uri(uri)
            with io.TextIOWrapper(system.open_input_file(place), encoding="utf-8-sig", errors="replace") as text:
                heads.append(text.readline().rstrip("\r\n"))
        yield pd.DataFrame({"path": batch["path"], "head": heads})


def headed(files: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """All rows of CSV files as text, by the names in each file's own header, with ``source_file`` and ``source_folder``.

    Files may differ in order and choice of columns: what a file has not is
    null.  Names are taken without blanks around them.  A header without a
    comma but with ``;`` parts by ``;``.  A first line that begins with a
    number is data, of columns ``names``; without ``names`` it is an error.
    Empty files have no rows; without any header the table has no other columns.
    """
    spark = files.sparkSession
    heads = files.select("path").mapInPandas(_first_lines, "path string, head string").where("trim(head) <> ''")
    known = heads.groupBy("head").agg(F.collect_list("path").alias("paths")).limit(MOST_HEADERS + 1).collect()
    if len(known) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    out = None
    for r in sorted(known, key=lambda r: r["head"]):
        sep = ";" if "," not in r["head"] and ";" in r["head"] else ","
        first = r["head"].split(sep)[0].strip().strip('"')
        bare = first.replace(".", "", 1).replace("-", "").isdigit()
        if bare and names is None:
            raise ValueError(f"no header in {r['paths'][0]}")
        reader = spark.read.option("header", not bare).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        rows = (reader.schema(", ".join(f"`{n}` string" for n in names)) if bare else reader).csv(r["paths"])
        own = [F.col(f"`{c}`").alias(c.strip()) for c in rows.columns]
        rows = rows.select(*own, F.col("_metadata.file_name").alias("source_file"), F.element_at(F.split("_metadata.file_path", "/"), -2).alias("source_folder"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return spark.createDataFrame([], "source_file string, source_folder string") if out is None else out


def column(df: DataFrame, *variants: str, needed: bool = True) -> Column:
    """The column of the given names, in any case (of several the first that a row has a value in); failing that, of a name that begins so.

    An error, or null text, if there is none.
    """
    own = {c.strip().lower(): c for c in df.columns}
    if exact := [F.col(f"`{own[v.lower()]}`") for v in variants if v.lower() in own]:
        return F.coalesce(*exact)
    for v in variants:
        for c in own:
            if c.startswith(v.lower()):
                return F.col(f"`{own[c]}`")
    if needed:
        raise ValueError(f"no column {' or '.join(variants)} in {sorted(df.columns)}")
    return F.lit(None).cast("string")


def number(text: Column) -> Column:
    """A finite number, else null."""
    x = text.try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def file_key(name: Column) -> Column:
    """An object's key from its name or file: last part of a path in lower case, without ``.txt`` and ``_decay``."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(name)), r"([^/\\]*)$", 1), r"(_decay)?(\.txt)?$", "")


def cospar_root(designator: Column) -> Column:
    """``YYYY-NNN`` of a designator ``YYNNN...`` (57 and later: the last century); null for anything else."""
    s = F.trim(designator)
    year = F.substring(s, 1, 2).try_cast("int")
    full = F.when(year < 57, year + 2000).otherwise(year + 1900)
    return F.when(s.rlike(r"^[0-9]{5}"), F.concat(full.cast("string"), F.lit("-"), F.substring(s, 3, 3)))


def chosen(labels: DataFrame, name: str, generation: str, output: str = "file") -> DataFrame:
    """Different values of a column of a label table, of one generation (in any case); for semi-joins and as an allowlist."""
    value = F.trim(column(labels, name))
    return labels.where(F.lower(F.trim(column(labels, "generation"))) == generation.lower()).select(value.alias(output)).where(f"{output} <> ''").distinct()


def counts(df: DataFrame) -> DataFrame:
    """Rows of each file by what became of them: accepted, or the reason."""
    return df.groupBy("source_file", F.coalesce("reject", F.lit("accepted")).alias("fate")).agg(F.count("*").alias("n"))


def read_intervals(files: DataFrame) -> DataFrame:
    """``object``, ``phase``, ``start``, ``end`` (microseconds) of phase intervals; rejected are rows without an object, with unreadable times, or that do not last."""
    rows = headed(files)
    at = lambda *names: column(rows, *names).try_cast("timestamp_ntz")
    out = rows.select(
        file_key(column(rows, "sat_id", "sat_name", "satellite_id", "object")).alias("object"), column(rows, "phase_state", "phase", "maneuver_phase").alias("phase"),
        at("phase_start", "start", "interval_start").alias("__s"), at("phase_end", "end", "interval_end").alias("__e"), "source_file",
    )
    out = out.withColumns({"start": micros("__s"), "end": micros("__e")}).drop("__s", "__e")
    reason = F.when(F.coalesce("object", F.lit("")) == "", "no_object").when(F.col("start").isNull() | F.col("end").isNull(), "no_time").when(F.col("start") >= F.col("end"), "no_length")
    return out.select("object", "phase", "start", "end", "source_file", reason.alias("reject"))


def read_controls(spark: SparkSession, path: str) -> DataFrame:
    """A row a phase of a calibration in JSON: ``phase``, ``sign``, the phase's controls and the fitted parameters; what is missing is null."""
    fields = lambda names: ", ".join(f"{n}: double" for n in names)
    schema = f"fitted_parameters struct<{fields(FITTED)}>, per_phase struct<{', '.join(f'{p}: struct<{fields(CONTROLS)}>' for p in THRUST_SIGNS)}>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    phase = lambda p, sign: F.struct(F.lit(p).alias("phase"), F.lit(sign).alias("sign"), *(F.col(f"per_phase.{p}.{c}").alias(c) for c in CONTROLS))
    return raw.select(F.explode(F.array(*(phase(p, s) for p, s in THRUST_SIGNS.items()))).alias("p"), *(F.col(f"fitted_parameters.{c}").alias(c) for c in FITTED)).select("p.*", *FITTED)


def read_assignments(files: DataFrame) -> DataFrame:
    """One row an object: ``object``, ``cluster_id`` (0: noise) by the votes of its rows, ``votes``, ``n_rows``."""
    rows = headed(files)
    named = rows.select(file_key(column(rows, "sat_id", "filename", "object")).alias("object"), column(rows, "global_cluster_id", "cluster_id").alias("cluster_id"))
    return policies.voted(named.where("object <> ''"))


def read_policies(files: DataFrame) -> DataFrame:
    """``cluster_id``, the fields of a policy (null where a table has none), ``cost`` and ``propellant_kg``, of clusters above 0; others are rejected."""
    rows = headed(files)
    some = lambda *names: number(column(rows, *names, needed=False))
    cluster = number(column(rows, "cluster_id", "global_cluster_id")).cast("long")
    fields = [some(f"policy_{c}", c).alias(c) for c in policies.FIELDS]
    reason = F.when(cluster.isNull(), "no_cluster").when(cluster <= 0, "noise")
    return rows.select(cluster.alias("cluster_id"), *fields, some("total_cost", "cost_scalar").alias("cost"), some("propellant_kg").alias("propellant_kg"), "source_file", reason.alias("reject"))


def read_stats(files: DataFrame) -> DataFrame:
    """A row a cluster: ``cluster_id`` and every other column as a number (``count`` as a whole one); of repeated clusters the largest count."""
    rows = headed(files)
    cluster = F.coalesce(number(column(rows, "global_cluster_id", "cluster_id")), F.lit(0.0)).cast("long")
    rest = [c for c in rows.columns if c not in ("source_file", "source_folder", "global_cluster_id", "cluster_id", "count")]
    out = rows.select(cluster.alias("cluster_id"), number(column(rows, "count", needed=False)).cast("long").alias("count"), *(number(F.col(f"`{c}`")).alias(c) for c in rest))
    # dots in names are not paths
    return out.groupBy("cluster_id").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in out.columns if c != "cluster_id")), F.coalesce("count", F.lit(-1))).alias("__s")).select("cluster_id", "__s.*")


def read_labels(spark: SparkSession, root: str, glob: str = "cluster_labels_*_clusters.csv", needed: Sequence[str] = ("cluster_label", "umap_1", "umap_2")) -> DataFrame:
    """Label tables of the folders below ``root``, of each folder the first file by name; ``group_order`` is the first number in the folder's name.

    Numbers are read from text (unreadable: null); rows without a whole
    ``cluster_label`` are rejected.  A missing needed column is an error.
    """
    files = listed(spark, root, glob)
    first = files.groupBy("folder").agg(F.min("path").alias("path"))
    rows = headed(first)
    for c in needed:
        column(rows, c)
    text = {"source_file", "source_folder", "timestamp", "filename", "sat_id", "sat_name", "object_name"}
    label = number(F.col("cluster_label"))
    made = {c: F.col(f"`{c}`") if c in text else number(F.col(f"`{c}`")) for c in rows.columns if c != "cluster_label"}
    order = F.regexp_extract("source_folder", r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return rows.select(label.cast("long").alias("cluster_label"), *(v.alias(c) for c, v in made.items()), order.alias("group_order"), F.when(label.isNull(), "no_label").alias("reject"))


def manifest(files: DataFrame) -> DataFrame:
    """A row a run (by its files' common stem) with the paths of its parts and ``status``; files of other names have no row."""
    kinds = [(F.endswith("file", F.lit(s)), k, s) for k, s in CHAIN_SUFFIXES.items()]
    kind = F.coalesce(*(F.when(hit, k) for hit, k, _ in kinds))
    stem = F.coalesce(*(F.when(hit, F.expr(f"left(file, length(file) - {len(s)})")) for hit, _, s in kinds))
    own = files.select("path", kind.alias("kind"), stem.alias("stem")).where("kind IS NOT NULL")
    out = own.groupBy("stem").agg(*(F.min(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in CHAIN_SUFFIXES))
    posterior, trace, observed = (F.col(k).isNotNull() for k in CHAIN_SUFFIXES)
    status = F.when(posterior & observed & trace, "complete").when(posterior & observed, "missing_trace").when(posterior, "posterior_only").when(observed, "obs_only").otherwise("trace_only")
    return out.withColumn("status", status)


def read_posterior(files: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """``stem``, ``object``, ``chain_id``, ``sample_id``, ``beta``, ``bc``, ``log_posterior`` and ``synthetic`` of all draws.

    Files without chains or samples get them by the order of their rows:
    ``chains`` (``stem``, ``n_chains``) says how many even parts a file has,
    else (or if its rows don't part evenly) one.  Rows with an unreadable
    number are rejected.
    """
    suffix = CHAIN_SUFFIXES["posterior"]
    rows = headed(files.where(F.endswith("file", F.lit(suffix))))
    stem = F.expr(f"left(source_file, length(source_file) - {len(suffix)})")
    some = lambda *names: number(column(rows, *names, needed=False))
    out = rows.select(
        stem.alias("stem"), "source_file", "source_folder", column(rows, "sat_file", needed=False).alias("sat_file"), some("chain_id", "chain", "chain_index").alias("chain_id"), some("sample_id", "sample", "draw", "draw_id").alias("sample_id"),
        number(column(rows, "beta_m2_per_kg")).alias("beta"), number(column(rows, "bc_kg_per_m2")).alias("bc"), some("log_posterior", "log_post", "logprob", "log_probability").alias("log_posterior"), F.monotonically_increasing_id().alias("__id"),
    )
    file = Window.partitionBy("source_folder", "source_file")
    # a file has chains if any of its rows names one
    bare = (F.count("chain_id").over(file) == 0) | (F.count("sample_id").over(file) == 0)
    out = out.withColumns({"synthetic": bare, "__n": F.count("*").over(file), "__k": F.row_number().over(file.orderBy("__id")) - 1, "sat_file": F.first("sat_file", True).over(file)})
    if chains is None:
        out = out.withColumn("__c", F.lit(1))
    else:
        hints = chains.groupBy(F.col("stem").alias("__stem")).agg(F.max(F.col("n_chains").cast("int")).alias("__c"))
        out = out.join(hints, F.col("stem") == F.col("__stem"), "left").drop("__stem")
        out = out.withColumn("__c", F.when((F.col("__c") > 0) & (F.col("__n") % F.col("__c") == 0), F.col("__c")).otherwise(1))
    draws = F.floor(F.col("__n") / F.col("__c"))
    place = lambda c, made: F.when(F.col("synthetic"), made).otherwise(F.col(c).cast("long")).alias(c)
    known = F.coalesce(F.nullif(F.regexp_extract("sat_file", r"sat\d+", 0), F.lit("")), F.nullif(F.regexp_extract("stem", r"sat\d+", 0), F.lit("")), F.col("stem"))
    out = out.select("stem", known.alias("object"), place("chain_id", F.floor(F.col("__k") / draws)), place("sample_id", F.col("__k") % draws), "beta", "bc", "log_posterior", "synthetic", "source_file")
    bad = F.when(F.col("chain_id").isNull() | F.col("sample_id").isNull() | F.col("beta").isNull() | F.col("bc").isNull(), "not_a_number")
    return out.withColumn("reject", bad)


def write_arcs(arcs: DataFrame, path: str, observed: Sequence[str] = ("dt_s", "a_obs_km")) -> None:
    """Arcs (one row each, observations in arrays) as Parquet, a row an observation with ``obs_index``; arcs without observations keep one row."""
    zipped = F.arrays_zip(*observed)
    rest = [c for c in arcs.columns if c not in observed]
    rows = arcs.select(*rest, F.posexplode_outer(zipped).alias("obs_index", "__o")).select(*rest, "obs_index", *(F.col(f"__o.{c}").alias(c) for c in observed))
    rows.write.mode("overwrite").parquet(path)


def read_arcs(spark: SparkSession, path: str, observed: Sequence[str] = ("dt_s", "a_obs_km"), key: str = "arc_id") -> DataFrame:
    """Arcs as they were written: one row each, observations in arrays by ``obs_index``."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "obs_index", *observed)]
    own = F.when(F.col("obs_index").isNotNull(), F.struct("obs_index", *observed))
    out = rows.groupBy(key).agg(*(F.first(c).alias(c) for c in rest), F.array_sort(F.collect_list(own)).alias("__o"))
    return out.select(key, *rest, *(F.col(f"__o.{c}").alias(c) for c in observed))


def general(x: Column, digits: int = 8) -> Column:
    """A number as text of so many significant digits, without trailing zeros, in powers of ten below 1e-4 and from 1e<digits> on; null for null and NaN."""
    plain = F.regexp_replace(F.format_string(f"%.{digits}g", x), r"(\.[0-9]*?)0+(e|$)", "$1$2")
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.regexp_replace(plain, r"\.(e|$)", "$1")))


def write_csv(df: DataFrame, path: str, digits: int = 8) -> None:
    """CSV with a header: doubles by ``general``, timestamps as ``yyyy-MM-dd HH:mm:ss``."""
    made = {c: general(F.col(f"`{c}`").cast("double"), digits) if t in ("double", "float") else F.date_format(f"`{c}`", "yyyy-MM-dd HH:mm:ss") for c, t in df.dtypes if t in ("double", "float", "timestamp", "timestamp_ntz")}
    df.select(*(made[c].alias(c) if c in made else F.col(f"`{c}`") for c in df.columns)).write.mode("overwrite").csv(path, header=True)


def write_clusters(selected: DataFrame, path: str, key: str = "object") -> None:
    """Three tables of pooled members: the ``selection``, the ``medoids`` by cluster, and a ``summary`` by role."""
    write_csv(selected, f"{path}/selection")
    medoids = selected.where("role = 'medoid'").select(F.col("cluster_id").alias("global_cluster_id"), F.col(key).alias("representative"), "weight_active", "weight_global")
    write_csv(medoids, f"{path}/medoids")
    write_csv(selected.groupBy("role").agg(F.count("*").alias("n_rows"), F.count_distinct("cluster_id").alias("n_clusters"), F.sum("weight_active").alias("members")), f"{path}/summary")
