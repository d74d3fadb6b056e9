"""The state of a stream as files: a base, and the rows that newer batches have changed.

Each batch writes the keys it changed with their whole new values, so a batch costs what it changed.  Folding the log
into the next base, a job of its own, keeps the newest row of every key and then removes what no reader needs: reading
costs the number of keys, and of the few batches since the last fold.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..sources.snapshot import numbered_folders, read_snapshot, remove, versions, write_snapshot

BATCH = "batch"


def write_batch(rows: DataFrame, folder: str, batch_id: int) -> None:
    """The rows a batch changed; a repeated batch overwrites what its failed attempt left."""
    rows.write.mode("overwrite").parquet(f"{folder}/log/{BATCH}={batch_id}")


def batches(spark: SparkSession, folder: str) -> list[int]:
    """Batches in the log, oldest first."""
    return numbered_folders(spark, f"{folder}/log", rf"{BATCH}=(\d+)")


def read_upserts(
    spark: SparkSession, folder: str, keys: list[str], through: int | None = None, newest: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The newest row of every key, as of a batch if told: the newest base with the batches after it.

    ``newest`` may put a key's rows together in another way: it takes all rows with their ``batch``, -1 for the base.
    """
    bases = [v for v in versions(spark, f"{folder}/base") if through is None or v <= through + 1]
    first = bases[-1] if bases else 0
    newer = [n for n in batches(spark, folder) if n >= first and (through is None or n <= through)]
    if not bases and not newer:
        raise FileNotFoundError(folder)
    base = read_snapshot(spark, f"{folder}/base", first) if bases else None
    if not newer:
        return base
    paths = [f"{folder}/log/{BATCH}={n}" for n in newer]
    log = spark.read.option("basePath", f"{folder}/log").parquet(*paths).withColumn(BATCH, F.col(BATCH).cast("bigint"))
    every = log if base is None else log.unionByName(base.withColumn(BATCH, F.lit(-1).cast("bigint")))
    if newest:
        return newest(every)
    # one maximum per key, combined before the shuffle
    values = [c for c in log.columns if c not in (*keys, BATCH)]
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_last"))
    return last.select(*keys, "_last.*")


def fold(
    spark: SparkSession, folder: str, keys: list[str], through: int | None = None, arrange: Callable[[DataFrame], DataFrame] | None = None,
    newest: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Fold the log up to a batch (the newest by default) into a base, and remove what it replaces.

    Not part of any batch: run it now and then.  Base version ``n`` holds all batches before ``n``.  The base before
    stays for readers that have begun; older ones, and the log below that one, go.  ``arrange`` may sort the rows, and
    drop those that mean nothing any more; ``newest`` is that of :func:`read_upserts`.
    """
    there = batches(spark, folder)
    if not there:
        return
    through = there[-1] if through is None else through
    if through + 1 not in versions(spark, f"{folder}/base"):  # else it is folded already
        rows = read_upserts(spark, folder, keys, through, newest)
        write_snapshot(arrange(rows) if arrange else rows, f"{folder}/base", version=through + 1)
    tidy(spark, folder)


def tidy(spark: SparkSession, folder: str) -> None:
    """Remove all bases but the last two, and the log that both of them hold."""
    bases = versions(spark, f"{folder}/base")
    for v in bases[:-2]:
        remove(spark, f"{folder}/base/v{v}")
    for n in batches(spark, folder):
        if len(bases) > 1 and n < bases[-2]:
            remove(spark, f"{folder}/log/{BATCH}={n}")
