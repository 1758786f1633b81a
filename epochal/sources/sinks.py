"""Tables to files: nested columns as JSON, and a provenance sidecar."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Arrays sorted and all nested columns as JSON text, so that any text format can hold them."""
    out = {}
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType) and not isinstance(field.dataType.elementType, (T.MapType, T.StructType)):
            out[field.name] = F.to_json(F.array_sort(c))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out[field.name] = F.to_json(c)
    return df.withColumns(out) if out else df


def with_required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the named columns, null where the table has none."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def scoped(df: DataFrame, scope: DataFrame, key: str = "object") -> DataFrame:
    """Rows of the objects that the scope has; an empty scope gives none."""
    return df.join(scope.select(key).distinct(), key, "left_semi")


def write(df: DataFrame, path: str, kind: str = "parquet", provenance: Mapping[str, Any] | None = None, partition_by: list[str] | None = None) -> None:
    """Parquet, CSV or JSON, and the provenance as one JSON line beside it."""
    writer = (flat(df) if kind == "csv" else df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(kind).save(path)
    if provenance is not None:
        note = json.dumps({"columns": df.columns, **provenance}, sort_keys=True, default=str)
        df.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.provenance")
