"""Sequences cut into consecutive ranges of equal size, so that one key may own any share of the rows.

Rows are dealt out by ranges of their order, and each range is written with its number.  What runs along a whole
sequence (sums, sessions, ranks) is worked out range by range; then one row per range and key is carried on.  Only
keys whose rows lie in several ranges need that, and there is at most one such key for each border.
"""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..session import keep


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join on keys that may be null: null is a key like others."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(other, reduce(Column.__and__, same), how).drop(*names.values())


def in_ranges(df: DataFrame, order: list[str], number: str, ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range: ranges follow one another in ``order`` (nulls first).

    Rows alike in all of ``order`` share a range.  The rows are kept, as a range's number must stay the same
    wherever it is used; pass only the columns that are needed.
    """
    columns = [F.col(c).asc_nulls_first() for c in order]
    dealt = df.repartitionByRange(ranges, *columns) if ranges else df.repartitionByRange(*columns)
    return keep(dealt.withColumn(number, F.spark_partition_id()), "ranges")


def carried(totals: DataFrame, keys: list[str], number: str, values: list[str]) -> DataFrame:
    """What each range of a key has before it: ``keys, number`` and the sums of ``values`` over earlier ranges.

    ``totals`` has one row per key and range.  Only ranges that do have rows of their key before them are listed, so
    there are fewer rows than ranges; a key that lies in one range has none.
    """
    before = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    sums = {v: F.sum(v).over(before) for v in values}
    found = totals.select(*keys, number, F.count("*").over(before).alias("_earlier"), *[s.alias(v) for v, s in sums.items()])
    return found.filter("_earlier > 0").drop("_earlier")


def running_sums(ranged: DataFrame, keys: list[str], order: list[str], number: str, sums: dict[str, Column]) -> DataFrame:
    """``ranged`` with running sums per key, each row's own value included, in ``order``.

    Within a range the sums run on their own; what the key has in earlier ranges is added from one row per range.
    """
    parts = {name: f"_value{k}" for k, name in enumerate(sums)}
    held = ranged.withColumns({parts[name]: value for name, value in sums.items()})
    inside = Window.partitionBy(number, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = held.groupBy(*keys, number).agg(*[F.sum(p).alias(p) for p in parts.values()])
    before = carried(totals, keys, number, list(parts.values())).withColumnsRenamed({p: f"_before{p}" for p in parts.values()})
    summed = join_null_safe(held.withColumns({name: F.sum(p).over(inside) for name, p in parts.items()}), before, [*keys, number], "left")
    whole = [(F.col(name) + F.coalesce(f"_before{p}", F.lit(0))).alias(name) for name, p in parts.items()]
    return summed.select(*ranged.columns, *whole)


def at_ranks(ranged: DataFrame, keys: list[str], order: str, weight: str, number: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``keys, rank``) with the value of ``order`` that stands at each rank, counted from 0.

    ``ranged`` has weighted values in ranges of ``keys`` and ``order``.  Cumulative weights per range tell which range
    holds a rank, and only those ranges are opened.
    """
    totals = ranged.groupBy(*keys, number).agg(F.sum(weight).alias("_w"))
    upto = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = totals.withColumn("_upto", F.sum("_w").over(upto))
    held = join_null_safe(wanted, spans, keys, "inner").filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_w")))
    asked = held.select(*keys, number, (F.col("_upto") - F.col("_w")).alias("_before"), "rank")
    inside = Window.partitionBy(number, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = join_null_safe(ranged, asked.select(*keys, number).distinct(), [*keys, number], "left_semi")
    at = join_null_safe(opened.withColumn("_inside", F.sum(weight).over(inside)), asked, [*keys, number], "inner")
    last = F.col("_before") + F.col("_inside")
    return at.filter((F.col("rank") < last) & (F.col("rank") >= last - F.col(weight))).select(*keys, "rank", order)
