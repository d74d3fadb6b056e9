"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .columns import free

#: Keys are counted in so many buckets of their hash, whatever the number of keys: the size of the sketch.
BUCKETS = 1 << 16
#: A bucket that holds this many times its even share of the rows has a hot key in it.
HEAVY = 4
#: Rows of one key that a task takes without being relieved.
TASK_ROWS = 1_000_000


def _bucket(keys: list[str], types: dict[str, str] | None = None) -> Column:
    columns = [F.col(f"`{c}`").try_cast(types[c]) if types else F.col(f"`{c}`") for c in keys]
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def hot_buckets(rows: DataFrame, on: list[str], most: int = TASK_ROWS) -> DataFrame:
    """``bucket, parts``: the buckets of ``on`` that hold hot keys, and over how many sub-keys to spread each.

    The counts are a mergeable sketch: sums per bucket, combined before the shuffle, at most ``BUCKETS`` rows a task
    and in all, the same however the rows are spread.  A sub-key holds about ``fair`` rows: ``HEAVY`` times the even
    share of a bucket, and ``most`` at least.  So all parts together are at most half the number of buckets.
    """
    counts = rows.groupBy(_bucket(on).alias("bucket")).agg(F.count("*").alias("n"))
    everything = F.sum("n").over(Window.partitionBy())
    shares = counts.withColumn("fair", F.greatest(F.lit(most), F.ceil(everything * HEAVY / BUCKETS)))
    return shares.filter("n > fair").select("bucket", F.ceil(F.col("n") / F.col("fair")).cast("int").alias("parts"))


def is_small(df: DataFrame) -> bool:
    """Whether the planner, by its own estimate, broadcasts these rows in a join."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def spread(
    many: DataFrame, one: DataFrame, on: list[str], by: list[str], salt: str, hot: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``salt``: rows of ``many`` in hot buckets get a sub-key from a hash of ``by``, rows of
    ``one`` in such a bucket are repeated for each of its sub-keys, and all others are as they were, with salt 0.

    ``hot`` is broadcast: it has at most ``BUCKETS`` rows of two integers.
    """
    types = {c: many.schema[c].dataType.simpleString() for c in on}
    bucket, parts = free("_bucket", many, one), free("_parts", many, one)
    table = F.broadcast(hot.select(F.col("bucket").alias(bucket), F.col("parts").alias(parts)))
    pieces = F.coalesce(F.col(parts), F.lit(1))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), pieces).cast("int")
    salted = many.withColumn(bucket, _bucket(on)).join(table, bucket, "left").withColumn(salt, part)
    repeated = one.withColumn(bucket, _bucket(on, types)).join(table, bucket, "left")
    repeated = repeated.withColumn(salt, F.explode(F.sequence(F.lit(0), pieces - 1)))
    return salted.drop(bucket, parts), repeated.drop(bucket, parts)


def join_hot(
    many: DataFrame, one: DataFrame, on: list[str], how: str, spread_by: list[str],
    counted: DataFrame | None = None, most: int = TASK_ROWS,
) -> DataFrame:
    """Equi join where ``many`` may be hot on ``on`` and ``one`` has at most a few rows per key.

    Where the planner's own estimate lets it broadcast ``one``, nothing is shuffled and this is a plain join.
    Otherwise hot keys are measured first (:func:`hot_buckets`): a job over the key columns, of which at most
    ``BUCKETS / HEAVY`` pairs of integers come back.  If there are none, this is a plain join too.  Else rows of a hot
    key are dealt out by a hash of ``spread_by`` over as many sub-keys as its count asks for, and only its few rows of
    ``one`` (and of cold keys that share the bucket) are repeated.  Cold keys are joined as they are.

    ``counted`` has the rows to measure instead of ``many``: where that is itself the result of joins, the frame that
    its keys come from.  It decides on the balance alone, never on the result.  Keys have the same types on both
    sides.  A stream is joined plainly, as a micro-batch is bounded.  ``how`` is inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot spread a {how} join")
    for c in on:
        kinds = {df.schema[c].dataType.simpleString() for df in (many, one)}
        if len(kinds) > 1 and not kinds <= {"tinyint", "smallint", "int", "bigint"}:
            raise ValueError(f"the sides of a spread join give {c} the types {sorted(kinds)}")
    if many.isStreaming or one.isStreaming or is_small(one):
        return many.join(one, on, how)
    # counted with the types of ``many``, as the same key must fall into the same bucket everywhere
    source = (many if counted is None else counted).select(
        *[F.col(f"`{c}`").try_cast(many.schema[c].dataType.simpleString()).alias(c) for c in on]
    )
    salt = free("_salt", many, one)
    found = [tuple(r) for r in hot_buckets(source, on, most).collect()]
    if not found:
        return many.join(one, on, how)
    hot = many.sparkSession.createDataFrame(found, "bucket int, parts int")
    salted, repeated = spread(many, one, on, spread_by, salt, hot)
    return salted.join(repeated, [*on, salt], how).drop(salt)
