"""Versioned snapshots and index files in a shared folder."""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at the path?"""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; nothing happens where there is none."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def numbered_folders(spark: SparkSession, path: str, pattern: str) -> list[int]:
    """Numbers of the finished folders whose names match, lowest first; the pattern's group is the number."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = []
    for status in fs.listStatus(p):
        m = re.fullmatch(pattern, status.getPath().getName())
        if m and fs.exists(status.getPath().suffix("/_SUCCESS")):
            found.append(int(m.group(1)))
    return sorted(found)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a snapshot, oldest first."""
    return numbered_folders(spark, path, r"v(\d+)")


def write_snapshot(df: DataFrame, path: str, by: list[str] | None = None, version: int | None = None) -> int:
    """Write the next version; readers only ever see finished ones.

    A version that is half written carries no success marker, so a lost job leaves
    the current snapshot as it was, and a rerun with the same version is safe.
    """
    spark = df.sparkSession
    done = versions(spark, path)
    version = (done[-1] + 1 if done else 0) if version is None else version
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(f"{path}/v{version}")
    return version


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a snapshot, the latest by default."""
    if version is None:
        done = versions(spark, path)
        if not done:
            raise FileNotFoundError(path)
        version = done[-1]
    return spark.read.parquet(f"{path}/v{version}")


def as_search_json(docs: DataFrame) -> DataFrame:
    """Documents as ``(id, json)`` lines; an empty body is written as null."""
    body = F.when(F.regexp_replace("body", r"\s", "") != "{}", F.col("body"))
    cleaned = docs.withColumn("body", body)
    return cleaned.select(
        F.col("name").alias("id"),
        F.to_json(F.struct(*[F.col(c) for c in cleaned.columns]), {"ignoreNullFields": "false"}).alias("json"),
    )


def write_search_docs(docs: DataFrame, path: str) -> None:
    """Index files, one JSON document per line."""
    as_search_json(docs).select("json").write.mode("overwrite").text(path)
