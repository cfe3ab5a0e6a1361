"""Tree lists from CSV files, and JSON rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def tree_list(spark: SparkSession, path: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """A survey's tree list: CSV with a header, types inferred, columns renamed; ``x`` and ``y`` are needed."""
    df = renamed(spark.read.csv(path, header=True, inferSchema=True), names or {})
    if missing := {"x", "y"} - set(df.columns):
        raise ValueError(f"the tree list has no {' and no '.join(sorted(missing))}; its columns are {df.columns}")
    return df


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON string per row; not-a-number and infinities become null, which JSON has."""

    def clean(name: str, real: bool) -> Column:
        c = F.col(name)
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c).alias(name) if real else c

    fields = [clean(f.name, isinstance(f.dataType, (DoubleType, FloatType))) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def file_identity(spark: SparkSession, path: str) -> str:
    """What tells an input from an edited one of the same name: path, size and time of change of each of its files, on any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.listStatus(at)]
    return ";".join(f"{name}:{size}:{changed}" for name, size, changed in sorted(files))
