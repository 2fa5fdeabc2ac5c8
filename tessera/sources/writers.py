"""Writers."""

from __future__ import annotations

import datetime
import decimal
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import upserted
from .readers import exists


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Each call adds files with a header of their own; readers skip them all."""
    df.write.mode("append").option("header", True).csv(path)


def upsert(spark: SparkSession, new: DataFrame, path: str, key: tuple[str, ...]) -> None:
    """Rows of the same key are replaced; the new table is whole before the old one goes."""
    if not exists(spark, path):
        write_parquet(new, path)
        return
    write_parquet(upserted(spark.read.parquet(path), new, key), f"{path}.new")
    write_parquet(spark.read.parquet(f"{path}.new"), path)


def write_distances(df: DataFrame, path: str, single: bool = True) -> None:
    """Distances (array or value in dist), as float where ``single``, in compressed Parquet."""
    kind = dict(df.dtypes)["dist"]
    write_parquet(df.withColumn("dist", F.col("dist").cast(kind.replace("double", "float") if single else kind)), path)


def json_safe(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    return value


def write_json_document(spark: SparkSession, value: dict, path: str) -> None:
    row = spark.createDataFrame([(json.dumps(json_safe(value)),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def remembered(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made and written first where it is missing."""
    if not exists(spark, path):
        write_parquet(make(), path)
    return spark.read.parquet(path)


def distance_path(folder: str, metric: str, kind: str, seed: int | None = None, leaf: str | None = None) -> str:
    """Where a distance table lies: kind 'pn' (controls x cases) or 'nn' (controls x controls)."""
    parts = [f"metric={metric}", f"kind={kind}"] + ([f"seed={seed}"] if seed is not None else []) + ([f"leaf={leaf}"] if leaf is not None else [])
    return "/".join([folder.rstrip("/"), *parts])


def views(spark: SparkSession, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``, or a temporary one in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset: {master} needs a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
