"""Inventories out of a metastore's tables.

Readers take the tables as DataFrames (from :func:`metastore_table` over JDBC, or a
parquet dump), so the planner can prune, push down and pick each join by size.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions.ranges import join_null_safe
from ..functions.skew import join_hot


def metastore_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """One table of a metastore database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def partition_inventory(
    partitions: DataFrame, tables: DataFrame, databases: DataFrame, storage: DataFrame, serdes: DataFrame
) -> DataFrame:
    """Partitions with their table, database, storage and serde.

    Storage is one row per partition and joins first on its own key; tables may own
    very many partitions, so that key is spread.
    """
    located = partitions.join(storage, "sd_id").join(serdes, "serde_id")
    named = tables.join(databases, "db_id")
    return join_hot(located, named, ["tbl_id"], "inner", ["part_id"], counted=partitions)


def table_inventory(tables: DataFrame, databases: DataFrame, storage: DataFrame) -> DataFrame:
    """Tables with their database and location."""
    return join_hot(tables.join(storage, "sd_id"), databases, ["db_id"], "inner", ["tbl_id"], counted=tables)


def partition_key_schema(key_rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Key names and types per table, with their position."""
    return key_rows.join(tables, "tbl_id").select(
        "table_name", "integer_idx", "pkey_name", "pkey_type"
    )


def external_catalog_inventory(
    sources: DataFrame, databases: DataFrame, tables: DataFrame, locations: DataFrame
) -> DataFrame:
    """Tables of a path-tracking catalog with source, database and location."""
    located = tables.join(locations, "table_id")
    homes = databases.join(sources, "source_id")
    return join_hot(located, homes, ["database_id"], "inner", ["table_id"], counted=tables)


def partition_metrics(data: DataFrame, keys: list[str], timestamp: str, files: bool = True) -> DataFrame:
    """Row count, newest timestamp and (optionally) file count per partition of a data set.

    Rows fold per file before the shuffle, so a huge partition costs one row per file.
    """
    by = [*keys, *(["_file"] if files else [])]
    rows = data.withColumn("_file", F.col("_metadata.file_path")) if files else data
    partial = rows.groupBy(*by).agg(
        F.count("*").alias("row_count"), F.max(timestamp).alias("newest")
    )
    if not files:
        return partial
    return partial.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"),
        F.count("*").alias("file_count"),
        F.max("newest").alias("newest"),
    )


def file_metrics(data: DataFrame, keys: list[str], timestamp: str) -> DataFrame:
    """``keys, path, row_count, newest`` per file of a data set: what a table's own file list would say.

    Table formats keep these numbers in their metadata; read them from there where they do.
    """
    return data.withColumn("path", F.col("_metadata.file_path")).groupBy(*keys, "path").agg(
        F.count("*").alias("row_count"), F.max(timestamp).alias("newest")
    )


def metrics_of_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics per partition out of file rows ``(keys, path, row_count, newest)``; no row of data is read."""
    return files.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"), F.count("*").alias("file_count"), F.max("newest").alias("newest")
    )


def update_metrics(metrics: DataFrame, files: DataFrame, added: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`metrics_of_files` after a snapshot, from those before it and the files it added and removed.

    ``files`` are those of the table after the snapshot.  Counts are added and subtracted.  The newest time is that of
    the old one and the added files - unless a removed file held it: only such partitions are looked up in ``files``
    again, so an update costs the changed files and the files of these partitions.  Partitions without files go.
    Null keys are keys like others.  A file of both lists has changed its numbers.
    """
    sign = F.col("_sign")
    changed = added.withColumn("_sign", F.lit(1)).unionByName(removed.withColumn("_sign", F.lit(-1)))
    delta = changed.groupBy(*keys).agg(
        F.sum(sign * F.col("row_count")).alias("_rows"), F.sum(sign).alias("_files"),
        F.max(F.when(sign == 1, F.col("newest"))).alias("_added"), F.max(F.when(sign == -1, F.col("newest"))).alias("_removed"),
    )
    both = join_null_safe(metrics.withColumn("_old", F.lit(True)), delta, keys, "left")
    fresh = join_null_safe(delta, metrics.select(*keys), keys, "left_anti")
    stays = both.select(
        *keys, *[(F.col(c) + F.coalesce(d, F.lit(0))).alias(c) for c, d in (("row_count", "_rows"), ("file_count", "_files"))],
        F.greatest("newest", "_added").alias("newest"),
        # greatest() skips nulls, so only a removed newest needs another look
        F.coalesce(F.col("_removed") >= F.greatest("newest", "_added"), F.lit(False)).alias("_again"),
    )
    begins = fresh.select(
        *keys, F.col("_rows").alias("row_count"), F.col("_files").alias("file_count"), F.col("_added").alias("newest"), F.lit(False).alias("_again")
    )
    now = stays.unionByName(begins).filter("file_count > 0")
    again = now.filter("_again").select(*keys)
    opened = join_null_safe(files.select(*keys, "newest"), again, keys, "left_semi").groupBy(*keys).agg(F.max("newest").alias("_newest"))
    found = join_null_safe(now, opened, keys, "left")
    return found.select(*keys, "row_count", "file_count", F.when(F.col("_again"), F.col("_newest")).otherwise(F.col("newest")).alias("newest"))
