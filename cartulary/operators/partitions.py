"""Listing, counting and checking partitions.

A partition row has ``table_name, part_name, uri, create_time, part_id``; keys are
read out of ``part_name`` where they are needed.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions import partition_names as P
from ..functions import predicates as Q
from ..functions.columns import free
from ..functions.skew import join_hot
from ..functions.times import epoch_seconds
from ..session import keep

ID = ["table_name", "part_name"]


def key(name: str, declared: list[str] | None = None, col: str = "part_name") -> Column:
    """Value of a partition key; a key the table does not declare is an error, not a null."""
    if declared is not None and name not in declared:
        raise ValueError(f"no such partition key: {name}")
    return P.key_value(F.col(col), name)


def batch_id(name: str = "batchid") -> Column:
    """Key that may live only in the storage path."""
    return P.key_value_or_path(F.col("part_name"), F.col("uri"), name)


def date_created() -> Column:
    """Creation time in epoch seconds."""
    return epoch_seconds(F.col("create_time"))


def parse_partition_name(parts: DataFrame) -> DataFrame:
    """Add all keys as the map ``keys``."""
    return parts.withColumn("keys", P.key_map(F.col("part_name")))


def partition_values(parts: DataFrame) -> DataFrame:
    """Add the ordered values and the key map of each name."""
    return parse_partition_name(parts).withColumn("values", P.ordered_values(F.col("part_name")))


def created(op: str, seconds: int) -> Column:
    """Creation time against an instant in epoch seconds.

    The column is compared as it is, so a scan can take the test over; a missing time meets none but ``!=``.
    """
    instant = F.lit(datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
    at = F.col("create_time")
    if op in ("=", "=="):
        return at.isNotNull() & (at == instant)
    if op in ("!=", "<>"):
        return at.isNull() | (at != instant)
    return at.isNotNull() & {"<": at < instant, "<=": at <= instant, ">": at > instant, ">=": at >= instant}[op]


def with_key_columns(parts: DataFrame, keys: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """One real column per key, for snapshots whose readers filter on keys at the scan.

    ``types`` names the type of keys that are no text (``bigint``, ``date``, ``timestamp_ntz``); comparisons by
    :func:`predicates.typed` then reach the scan as comparisons of that type.  A value that does not fit its type
    is null there.
    """
    types = types or {}
    return parts.withColumns(
        {f"key_{k}": P.key_value(F.col("part_name"), k).try_cast(types.get(k, "string")) for k in keys}
    )


def with_key_schema(parts: DataFrame, schema: DataFrame, column: str) -> DataFrame:
    """The rows with a map ``column`` from their table's declared keys to the types; empty where it declares none.

    ``schema`` is ``(table_name, pkey_name, pkey_type)``, one row per key, as :func:`metastore.partition_key_schema`
    gives it; of a key declared twice the type that is least in order counts.  A map holds the keys of one table,
    and a table with very many partitions is spread.
    """
    pairs = schema.groupBy("table_name", "pkey_name").agg(F.min("pkey_type").alias("pkey_type"))
    entries = F.map_from_entries(F.collect_list(F.struct("pkey_name", "pkey_type")))
    declared = pairs.groupBy("table_name").agg(entries.alias(column))
    spread = [c for c in ("part_name", "part_id") if c in parts.columns] or ["table_name"]
    out = join_hot(parts, declared, ["table_name"], "left", spread)
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return out.withColumn(column, F.coalesce(column, none))


def invalid_names(parts: DataFrame, keys: list[str] | DataFrame) -> DataFrame:
    """Rows whose partition name does not fit the declared keys: those of a list, or each table's own of a schema
    (see :func:`with_key_schema`)."""
    if isinstance(keys, list):
        return parts.filter(~P.is_valid_name(F.col("part_name"), keys))
    own = free("_keys", parts)
    checked = with_key_schema(parts, keys, own).filter(~P.fits_keys(F.col("part_name"), F.map_keys(own)))
    return checked.select(*[F.col(f"`{c}`") for c in parts.columns])


def filter_typed(parts: DataFrame, schema: DataFrame, key: str, op: str, literal: object, strict: bool = True) -> DataFrame:
    """Partitions whose key compares so with a literal, each table's key read in its own declared type.

    One job covers tables that declare the key as text, number, date or timestamp.  Tables that do not declare it
    have no such partitions.  Where the literal is none of the key's type the job fails, or with ``strict=False``
    those partitions are left out.
    """
    own = free("_keys", parts)
    found = with_key_schema(parts, schema, own).filter(
        Q.typed_as(P.key_value(F.col("part_name"), key), F.col(own)[key], op, literal, strict)
    )
    return found.select(*[F.col(f"`{c}`") for c in parts.columns])


def bad_characters(parts: DataFrame, allowed: str) -> DataFrame:
    """Rows with a value that does not fully match the allow-list pattern."""
    values = P.ordered_values(F.col("part_name"))
    return parts.filter(F.exists(values, lambda v: ~v.rlike(rf"\A(?:{allowed})\z")))


def make_partition_name(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Escaped ``part_name`` from key columns (key → column)."""
    return df.withColumn("part_name", P.make_name({k: F.col(c) for k, c in keys.items()}))


def default_location(parts: DataFrame, location: str = "location") -> DataFrame:
    """Fill a blank uri with table location, slash, partition name."""
    blank = F.trim(F.coalesce(F.col("uri"), F.lit(""))) == ""
    inferred = F.concat(F.rtrim(F.col(location), F.lit("/")), F.lit("/"), F.col("part_name"))
    return parts.withColumn("uri", F.when(blank, inferred).otherwise(F.col("uri")))


STORAGE = ["input_format", "output_format", "serialization_lib"]
STORAGE_MAPS = ["params", "serde_params"]


def inherit_storage(parts: DataFrame, tables: DataFrame) -> DataFrame:
    """Fill blank storage fields and empty parameter maps from the table.

    A table may own a large share of all partitions, so its key is spread.
    """
    texts = [c for c in STORAGE if c in parts.columns]
    maps = [c for c in STORAGE_MAPS if c in parts.columns]
    defaults = tables.select("table_name", *[F.col(c).alias(f"_t_{c}") for c in texts + maps])
    joined = join_hot(parts, defaults, ["table_name"], "left", ["part_name"])
    filled = {
        c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.col(f"_t_{c}")).otherwise(F.col(c))
        for c in texts
    } | {
        c: F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.col(f"_t_{c}")).otherwise(F.col(c))
        for c in maps
    }
    return joined.withColumns(filled).select(*parts.columns)


def pivot_params(params: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """``(id, key, value)`` rows to one map per id, the latest value of a key winning.

    Repeated keys fold on the map side first, so a map only ever holds the
    distinct keys of its id.
    """
    latest = F.max_by("value", order) if order else F.max("value")
    unique = params.groupBy(id_col, "key").agg(latest.alias("value"))
    entries = F.sort_array(F.collect_list(F.struct("key", "value")))
    return unique.groupBy(id_col).agg(F.map_from_entries(entries).alias("params"))


def filter_by_names(parts: DataFrame, names: DataFrame) -> DataFrame:
    """Partitions named in ``names`` (``table_name, part_name``)."""
    return parts.join(names.select(*ID), ID, "left_semi")


def sort_page(
    df: DataFrame,
    by: list[Column],
    unique: list[str],
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """One page of a sorted listing, columns as given; ``unique`` columns break ties, nulls come first.

    Rows equal in ``by`` and ``unique`` are ordered by their other columns, so the page is the same however
    the rows are spread; maps cannot be ordered and are left out of that.  Without an offset the page is a
    distributed top-k of ``limit`` rows.  With one, of whatever size, the rows are kept in consecutive ranges and
    only ranges the page touches are numbered; what is summed in one place is one count per range.
    """
    rest = [f.name for f in df.schema if f.name not in unique and "map<" not in f.dataType.simpleString()]
    ordering = [*by, *[F.col(f"`{c}`") for c in (*unique, *rest)]]
    if not offset:
        ordered = df.orderBy(*ordering)
        return ordered if limit is None else ordered.limit(limit)
    number, start, size, place = (free(c, df) for c in ("_range", "_start", "_size", "_number"))
    ranged = keep(df.repartitionByRange(*ordering).withColumn(number, F.spark_partition_id()), "ranges")
    earlier = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(number).agg(F.count("*").alias(size))
    starts = sizes.withColumn(start, F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    touched = starts.filter(F.col(start) + F.col(size) > offset)
    if limit is not None:
        touched = touched.filter(F.col(start) < offset + limit)
    inside = Window.partitionBy(number).orderBy(*ordering)
    numbered = ranged.join(touched, number).withColumn(place, F.col(start) + F.row_number().over(inside))
    page = numbered.filter(F.col(place) > offset)
    if limit is not None:
        page = page.filter(F.col(place) <= offset + limit)
    return page.orderBy(place).select(*[F.col(f"`{c}`") for c in df.columns])


def list_partitions(
    parts: DataFrame,
    predicate: Column | None = None,
    names: DataFrame | None = None,
    sort: list[Column] | None = None,
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Filter, then sort, then page; sorted by ``part_id`` unless told otherwise."""
    if names is not None:
        parts = filter_by_names(parts, names)
    if predicate is not None:
        parts = parts.filter(predicate)
    if sort is None and offset == 0 and limit is None:
        return parts
    return sort_page(parts, sort or [], ["part_id", *ID], offset, limit)


def partition_names(parts: DataFrame, **listing: object) -> DataFrame:
    """Names of a listing."""
    return list_partitions(parts, **listing).select(*ID)


def partition_uris(parts: DataFrame, **listing: object) -> DataFrame:
    """Storage paths of a listing, blanks left out."""
    return list_partitions(parts, **listing).select("table_name", "uri").filter("uri is not null")


def count_partitions(parts: DataFrame) -> DataFrame:
    """Partitions per table, counted before the shuffle."""
    return parts.groupBy("table_name").agg(F.count("*").alias("partitions"))


def guard_size(df: DataFrame, limit: int, per: list[str]) -> DataFrame:
    """Groups whose size is above the limit."""
    return df.groupBy(*per).agg(F.count("*").alias("size")).filter(F.col("size") > limit)


def check_size(df: DataFrame, limit: int, per: list[str]) -> DataFrame:
    """The input, or an error as soon as one group is above the limit."""
    worst = guard_size(df, limit, per).orderBy(F.desc("size")).limit(1).collect()
    if worst:
        raise ValueError(f"{worst[0].asDict()} is above the limit of {limit}")
    return df


def match_partial_spec(parts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Partitions whose leading key values equal the given ones; empty text matches all."""
    if len(values) > len(keys):
        raise ValueError("more values than partition keys")
    condition = F.lit(True)
    for name, value in zip(keys, values):
        if value == "":
            continue
        literal = int(value) if re.fullmatch(r"[+-]?\d+", value) and -(1 << 63) <= int(value) < 1 << 63 else value
        condition = condition & Q.eq(key(name), literal, permissive=True)
    return parts.filter(condition)


def delete_partitions(parts: DataFrame, names: DataFrame) -> DataFrame:
    """Inventory without the named partitions."""
    return parts.join(names.select(*ID), ID, "left_anti")


def partition_count_stats(parts: DataFrame) -> DataFrame:
    """Distribution of partitions per table.

    The per-table counts fold to a histogram (count → tables) before the exact
    percentiles, so what reaches the last step is bounded by the distinct counts.
    """
    histogram = count_partitions(parts).groupBy("partitions").agg(F.count("*").alias("tables"))
    return histogram.agg(
        F.sum("tables").alias("tables"),
        F.sum(F.col("partitions") * F.col("tables")).alias("partitions"),
        F.min("partitions").alias("fewest"),
        F.max("partitions").alias("most"),
        F.percentile("partitions", 0.5, F.col("tables")).alias("median"),
        F.percentile("partitions", 0.95, F.col("tables")).alias("p95"),
    )
