"""Exact dedup with the frequent digests split off: Misra-Gries, broadcast winners, plain shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import free, store, text_of

#: Misra-Gries counters.  Every digest with more than a 1/128 of all rows is found, and at most so many
#: rows (under 100 bytes each) are ever broadcast.
COUNTERS = 256


def digest(text: str = "text"):
    """SHA-256 of the text's UTF-8 bytes; a null text is an empty one."""
    return F.unhex(F.sha2(text_of(text).cast("binary"), 256))


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``id, keep_id, group_size, kept, digest``: one row per row of ``docs``.

    Rows belong together when their texts are identical.  The largest id of a group stays; a null id is
    below all others, and a group of null ids only keeps its null rows (``kept`` true).  Rows that repeat
    both id and text are one document: they carry the same flags and all count in ``group_size``.
    Other columns are ignored whatever their names; an empty table gives an empty result.

    A group of any size is safe: frequent digests are counted by an aggregate that combines before its
    shuffle, and their rows get the answer from a broadcast of at most ``counters`` rows.
    """
    rows = store(docs.select(F.col(id).alias("id"), digest(text).alias("digest")), "digests")
    often = frequent(rows, "digest", counters)
    size, winner = F.count("*").alias("group_size"), F.max("id").alias("keep_id")
    winners = store(
        rows.join(F.broadcast(often), "digest").groupBy("digest").agg(size, winner).where("group_size > 1"),
        "winners",
    )
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(size, winner), "digest")
    columns = ["id", "keep_id", "group_size", "digest"]
    return (
        hot.select(*columns)
        .union(cold.select(*columns))
        .select(
            F.col("id").alias(id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
        )
    )


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each text, by the rule of ``exact_groups``.

    Of rows that repeat both id and text any one stays.  Columns and their order are those of ``docs``.
    """
    groups = exact_groups(docs, id, text)
    code, key = free("digest", docs), free("keep_id", docs)
    stays = groups.where("kept").groupBy(F.col("digest").alias(code), F.col("keep_id").alias(key)).agg(
        F.count("*").alias("_same")
    )
    found = docs.withColumn(code, digest(text))
    match = (found[code] == stays[code]) & found[id].eqNullSafe(stays[key])
    once = found.join(stays.where("_same = 1"), match, "left_semi")
    repeated = found.join(stays.where("_same > 1"), match, "left_semi").dropDuplicates([id, code])
    return once.union(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


def frequent(rows: DataFrame, key: str, counters: int) -> DataFrame:
    """At most ``counters`` values of ``key``, among them every one with over ``2 / counters`` of the rows."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for value, n in batch[key].value_counts().items():
                held[value] = held.get(value, 0) + n
            if len(held) > counters:  # many decrements of Misra-Gries at once
                cut = sorted(held.values(), reverse=True)[counters]
                held = {v: n - cut for v, n in held.items() if n > cut}
        yield pd.DataFrame({key: list(held), "n": list(held.values())})

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, n long"
    parts = rows.select(key).where(F.col(key).isNotNull()).mapInPandas(summarise, schema)
    return parts.groupBy(key).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), key).limit(counters).select(key)

