"""Schemas, columns and sliced reads of relational sources."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

# Fixed value: the schema that describes the others.
SYSTEM_SCHEMA = "information_schema"


def information_schema(spark: SparkSession, url: str, view: str, **options: str) -> DataFrame:
    """One information-schema view of a source."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=f"{SYSTEM_SCHEMA}.{view}", **options).load()
    )


def jdbc_schemas(schemata: DataFrame) -> DataFrame:
    """Schemas of a source, without the one that describes them."""
    return schemata.filter(F.lower("schema_name") != SYSTEM_SCHEMA)


def source_type(type_name: Column, size: Column, scale: Column) -> Column:
    """Declared type text; sizes go before a trailing ``unsigned``."""
    base = F.trim(F.regexp_replace(type_name, r"(?i)\s*unsigned.*$", ""))
    tail = F.regexp_extract(type_name, r"(?i)(unsigned.*)$", 1)
    inside = F.concat_ws(", ", size.cast("string"), scale.cast("string"))
    sized = F.concat(base, F.lit("("), inside, F.lit(")"), F.when(tail != "", F.concat(F.lit(" "), tail)).otherwise(""))
    return F.when(size.isNotNull(), sized).otherwise(type_name)


def jdbc_columns(columns: DataFrame) -> DataFrame:
    """Column catalog: position, rebuilt type, nullability, default and size.

    ``columns`` has the columns of an ``information_schema.columns`` view, or ``size`` and ``scale`` as drivers
    report them.
    """
    if "size" not in columns.columns:
        columns = columns.withColumns(
            {"size": F.coalesce("character_maximum_length", "numeric_precision"), "scale": F.col("numeric_scale")}
        )
    return columns.filter(F.lower("table_schema") != SYSTEM_SCHEMA).select(
        "table_schema",
        "table_name",
        "column_name",
        F.col("ordinal_position").alias("pos"),
        source_type(F.col("data_type"), F.col("size"), F.col("scale")).alias("source_type"),
        (F.upper("is_nullable") == "YES").alias("is_nullable"),
        F.col("column_default").alias("default_value"),
        "size",
    )


def slices(key: str, bounds: list[str], prefix: str = "") -> list[str]:
    """One predicate per slice of a key range, for a parallel read; rows without a key are in the first."""
    q = [b.replace("'", "''") for b in sorted(bounds)]
    parts = [f"{key} < '{q[0]}' or {key} is null"] if q else ["1 = 1"]
    parts += [f"{key} >= '{lo}' and {key} < '{hi}'" for lo, hi in zip(q, q[1:])]
    if q:
        parts.append(f"{key} >= '{q[-1]}'")
    if not prefix:
        return parts
    p = prefix.replace("'", "''")
    # half-open range instead of LIKE: any store can answer it from its index
    top = _next(prefix).replace("'", "''")
    below = f" and {key} < '{top}'" if top else ""
    return [f"({x}) and {key} >= '{p}'{below}" for x in parts]


def slice_bounds(keys: DataFrame, key: str, n: int, prefix: str = "") -> list[str]:
    """Bounds that cut the keys under a prefix into ``n`` slices of about equal size, for :func:`slices`.

    ``keys`` is whatever tells how the keys are spread: the source's index, or an earlier read.  It is cut by ranges of
    the key, and only the first key of each range reaches the driver.  Equal keys share a slice, so there may be fewer.
    """
    rows = keys.select(F.col(key).cast("string").alias("k")).filter(F.col("k").isNotNull() & F.col("k").startswith(prefix))
    firsts = rows.repartitionByRange(n, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k")).collect()
    return sorted(r["k"] for r in firsts)[1:]


def _next(prefix: str) -> str:
    """The least text above all texts with the prefix; empty if there is none."""
    kept = prefix.rstrip(chr(0x10FFFF))
    if not kept:
        return ""
    code = ord(kept[-1]) + 1
    return kept[:-1] + chr(0xE000 if code == 0xD800 else code)


def read_sliced(
    read: Callable[[str], DataFrame], key: str, bounds: list[str], prefix: str = ""
) -> DataFrame:
    """All slices of a source under a key prefix; ``read`` turns a predicate into rows.

    For JDBC, :func:`read_jdbc_sliced` hands the same predicates to one reader.
    """
    frames = [read(p) for p in slices(key, bounds, prefix)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_jdbc_sliced(
    spark: SparkSession, url: str, table: str, key: str, bounds: list[str], prefix: str = "", **properties: str
) -> DataFrame:
    """One partition per slice, read in parallel."""
    return spark.read.jdbc(url, table, predicates=slices(key, bounds, prefix), properties=properties)
