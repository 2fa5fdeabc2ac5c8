"""Readers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in order."""
    p, fs = _hadoop(spark, pattern)
    return sorted(str(s.getPath()) for s in fs.globStatus(p) or [])


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """With a schema nothing is inferred; without one all columns are strings."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*columns) if columns else df


def read_any(spark: SparkSession, path: str, **how) -> DataFrame:
    """By suffix: .csv, .json, else .parquet or a directory of it."""
    if path.endswith(".csv"):
        return read_csv(spark, path, **how)
    if path.endswith(".json"):
        return spark.read.json(path)
    if path.endswith(".parquet") or "." not in path.rsplit("/", 1)[-1]:
        return read_parquet(spark, path, **how)
    raise ValueError(f"unknown format: {path}")


def read_parts(spark: SparkSession, pattern: str) -> DataFrame:
    """All Parquet parts that match, their columns united by name."""
    paths = listing(spark, pattern)
    if not paths:
        raise FileNotFoundError(pattern)
    return spark.read.option("mergeSchema", True).parquet(*paths)


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    for path in candidates:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(candidates))


def feature_file(spark: SparkSession, folder: str, code: str) -> str:
    """The narrowest feature table of a cohort: 100 features, with medications, plain."""
    return first_existing(spark, [f"{folder}/{code}_features{s}.parquet" for s in ("_100feat", "_with_meds", "")])


def cohorts(spark: SparkSession, folder: str) -> list[str]:
    """Codes with both a claims and an enrollment table."""
    names = [p.rsplit("/", 1)[-1] for p in listing(spark, f"{folder}/*")]
    found = {kind: {m[1] for n in names if (m := re.fullmatch(rf"(.+)_{kind}(?:\.parquet)?", n))} for kind in ("claims", "enrollment")}
    return sorted(found["claims"] & found["enrollment"])


def undersampled_files(spark: SparkSession, path: str) -> list[str]:
    return [path] if path.endswith(".csv") else listing(spark, f"{path}/undersampled_*.csv")


def read_json_document(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """One JSON object, or ``default`` where there is none."""
    import json

    if default is not None and not exists(spark, path):
        return default
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_submatrix(distances: DataFrame, a_ids: DataFrame | None = None, b_ids: DataFrame | None = None) -> DataFrame:
    """The part of a distance table between the given ids (column id)."""
    out = distances
    for ids, c in ((a_ids, "a_id"), (b_ids, "b_id")):
        if ids is not None:
            out = out.join(ids.select(F.col("id").alias(c)), c, "left_semi")
    return out


def runs(paths: Sequence[str], pattern: str) -> list[dict[str, str]]:
    """What a pattern's named groups read off file names, with the path."""
    return [m.groupdict() | {"path": p} for p in paths if (m := re.search(pattern, p.rsplit("/", 1)[-1]))]


def seeds(text: str) -> list[int]:
    """'1,2,5-7' as numbers."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, dash, b = part.partition("-")
        out += range(int(a), int(b) + 1) if dash and a else [int(part)]
    return out


def coerced(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as double, null where they are no number."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def aliased(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns under their canonical names, where those are not there yet."""
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})
