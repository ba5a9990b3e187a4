"""Typed reads and partitioned writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import number


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder; local temp only in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root}/{uuid.uuid4().hex}"


def conform_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns: absent ones become NULL, unreadable values NULL."""
    have = set(df.columns)

    def read(field):
        if field.name not in have:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = number(field.name).cast(field.dataType)
        elif df.schema[field.name].dataType == field.dataType:
            value = F.col(field.name)
        else:
            value = F.col(field.name).try_cast(field.dataType.simpleString())
        return value.alias(field.name)

    return df.select(*[read(f) for f in schema.fields])


def read_source(spark, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return conform_schema(reader.load(path), schema)


def scan_panel(spark, path, start, end, columns=None, day="day", part="month") -> DataFrame:
    """Read [start, end] from a table partitioned by ``part`` = yyyymm.

    The partition predicate prunes folders, the day predicate reaches the parquet reader.
    """
    df = spark.read.parquet(path)
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    month = F.col(part).cast("int")
    lo_month, hi_month = (int(str(d).replace("-", "")[:6]) for d in (start, end))
    df = df.filter((month >= lo_month) & (month <= hi_month)).filter(F.col(day).between(lo, hi))
    return df.select(*columns) if columns else df


def read_csv_ledger(spark, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, codes kept as text and empty strings kept as empty strings."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    df = spark.read.option("header", True).option("encoding", "UTF-8").schema(raw).csv(path)
    return conform_schema(df.na.fill("", [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]), schema)


def read_json_manifest(spark, path: str, explode: str, schema=None) -> DataFrame:
    """Nested JSON files to one row per element of the array column ``explode``."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    outer = [c for c in df.columns if c != explode]
    return df.select(*outer, F.explode(explode).alias("_e")).select(*outer, "_e.*")


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the touched partitions.

    The rebalance hint lets adaptive execution merge small months into one writer and
    split a month that is too big for one task.
    """
    (
        df.hint("rebalance", F.col(by))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(by)
        .parquet(path)
    )


def write_table_with_manifest(df: DataFrame, path: str, by: str, metrics: dict) -> DataFrame:
    """Write the table, then a JSON manifest with one row of metrics per partition."""
    write_partitioned(df, path, by)
    manifest = df.sparkSession.read.parquet(path).groupBy(by).agg(
        *[c.alias(n) for n, c in metrics.items()]
    )
    manifest.write.mode("overwrite").json(f"{path}_manifest")
    return df.sparkSession.read.json(f"{path}_manifest")
