"""Listing tables and databases, and questions about one table's shape."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .partitions import sort_page


def tables_by_params(
    tables: DataFrame,
    owner: str | None = None,
    params: dict[str, str] | None = None,
    limit: int | None = None,
    name: str = "name",
) -> DataFrame:
    """Tables by owner and parameter values; the limit is shared by all databases.

    Databases are walked in order, so a limit takes the first names overall.
    """
    if owner is None and not params:
        raise ValueError("a table filter may not be empty")
    condition = F.lit(True) if owner is None else F.col("owner") == owner
    for k, v in (params or {}).items():
        condition = condition & F.coalesce(F.try_element_at(F.col("params"), F.lit(k)) == v, F.lit(False))
    return sort_page(tables.filter(condition), [], [name], 0, limit)


def list_tables(
    tables: DataFrame,
    prefix: str = "",
    like: str | None = None,
    descending: bool = False,
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Table names under a name prefix, optionally LIKE a pattern, sorted and paged."""
    found = tables.filter(F.col("name").startswith(prefix)) if prefix else tables
    if like is not None:
        found = found.filter(F.col("table_name").like(like))
    by = [F.col("name").desc()] if descending else []
    return sort_page(found, by, ["name"], offset, limit).select("name")


def list_databases(tables: DataFrame) -> DataFrame:
    """Databases of every catalog with the number of their tables.

    The tables themselves come from :func:`list_tables`, one row each: a database
    can hold too many for one array.
    """
    return tables.groupBy("catalog_name", "database_name").agg(
        F.count("*").alias("tables"),
        F.min("table_name").alias("first_table"),
        F.max("table_name").alias("last_table"),
    )


def list_by_pattern(df: DataFrame, pattern: str, col: str) -> DataFrame:
    """Case-insensitive whole-name match where ``*`` means any text and the rest is a regex."""
    return df.filter(F.col(col).rlike(rf"\A(?i:{pattern.replace('*', '.*')})\z"))


def partition_keys_of(tables: DataFrame) -> DataFrame:
    """Names of the fields marked as partition keys, in field order."""
    marked = F.filter(F.col("fields"), lambda f: f["partition_key"])
    return tables.withColumn("partition_keys", F.transform(marked, lambda f: f["name"]))


def is_external(uri: Column) -> Column:
    """Does the table keep its data under a storage path of its own?"""
    return F.coalesce(uri != "", F.lit(False))
