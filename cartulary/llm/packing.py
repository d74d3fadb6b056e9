"""Best-fit packing of documents into sequences, with conflicts between sources and duplicates."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Hashable, Sequence

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import store, text_of, word_count

CAPACITY = 1024
#: Pieces that one task packs together, on average.  Bins never span such shards.
SHARD = 8192


def best_fit(
    sizes: Sequence[int], sources: Sequence[Hashable], clusters: Sequence[Hashable], capacity: int
) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item, packed in the order given.

    A bin holds at most ``capacity``, one item of each source and one of each cluster; ``None`` conflicts
    with nothing.  Bins stand in order of what they have left, each with a bitmap of its sources and
    clusters.  For an item the search begins at the bin that it fills most tightly and goes on to the next
    larger one until a bin has no bit in common; if none is left, it opens a bin.
    """
    often: dict[Hashable, int] = {}
    for kind, labels in (("s", sources), ("c", clusters)):
        for x in labels:
            if x is not None:
                often[kind, x] = often.get((kind, x), 0) + 1
    bit = {key: 1 << i for i, key in enumerate(k for k, n in often.items() if n > 1)}  # others conflict with none
    left: list[tuple[int, int]] = []  # (residual, bin), ascending
    maps: list[int] = []
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for k, size in enumerate(sizes):
        mine = bit.get(("s", sources[k]), 0) | bit.get(("c", clusters[k]), 0)
        at = bisect_left(left, (size, -1))
        while at < len(left) and maps[left[at][1]] & mine:
            at += 1
        if at < len(left):
            residual, where = left.pop(at)
        else:
            residual, where = capacity, len(maps)
            maps.append(0)
        maps[where] |= mine
        bins[k], offsets[k] = where, capacity - residual
        if residual > size:
            insort(left, (residual - size, where))
    return bins, offsets


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``id, copy, piece, start, size, bin_id, bin_offset``: every piece of every row of ``items``, which has
    ``id, source, cluster, size``.

    An item over the capacity is cut: full pieces have a bin each, the last piece is packed with the others.
    Items of size 0 (or null) get one empty piece.  Equal rows are told apart by ``copy``, so they spread over
    tasks; null sources and clusters conflict with nothing.  Pieces are dealt to shards by a hash and packed
    longest first; the number of shards follows the number of pieces.  No bin holds two pieces of one source
    or cluster, or more than the capacity.
    """
    kind = items.schema["id"].dataType.simpleString()
    rows = items.select(
        F.col("id").cast("string").alias("id"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"),
        F.coalesce("size", F.lit(0)).cast("long").alias("size"),
    )
    rows = (
        rows.groupBy("id", "source", "cluster", "size")
        .agg(F.count("*").cast("int").alias("n"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    )
    full = F.floor(F.col("size") / capacity)
    cut = store(rows.select("id", "copy", "source", "cluster", "size", full.alias("full")), "items")
    whole = cut.where("full > 0").select(
        "id", "copy", "source", "cluster", F.col("size").alias("rows"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"),
    )
    whole = whole.select(
        "id", "copy", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("size"),
        F.concat_ws("-", F.lit("full"), F.hex(F.xxhash64("id", "source", "cluster", "rows")), F.coalesce("id", F.lit("null")), "copy", "piece").alias("bin_id"),
        F.lit(0).cast("long").alias("bin_offset"),
    )
    rest = cut.where((F.col("size") % capacity > 0) | (F.col("size") == 0)).select(
        "id", "copy", "source", "cluster", F.col("full").alias("piece"), (F.col("full") * capacity).alias("start"),
        (F.col("size") % capacity).alias("size"),
    )
    shards = max(1, -(-rest.count() // shard))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("id", "copy", "source", "cluster", "size"), F.lit(shards)))

    def each(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(order=pd.util.hash_array(group["id"].fillna("").to_numpy(dtype=object), categorize=False))
        group = group.sort_values(["size", "order", "copy", "source", "cluster"], ascending=[False, True, True, True, True])
        labels = [[None if pd.isna(x) else x for x in group[c]] for c in ("source", "cluster")]
        bins, offsets = best_fit(group["size"].tolist(), *labels, capacity)
        name = f"{int(group['shard'].iloc[0])}-"
        return group.assign(bin_id=[f"{name}{b}" for b in bins], bin_offset=offsets)[
            ["id", "copy", "piece", "start", "size", "bin_id", "bin_offset"]
        ]

    packed = dealt.groupBy("shard").applyInPandas(
        each, "id string, copy int, piece long, start long, size long, bin_id string, bin_offset long"
    )
    return packed.union(whole).withColumn("id", F.col("id").cast(kind))


def items_of(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``id, source, cluster, size``: words as the size, texts equal but for case and white space as a cluster."""
    plain = F.trim(F.regexp_replace(F.lower(text_of(text)), r"[\x20\x09-\x0D]+", " "))
    return docs.select(
        F.col(id).alias("id"), F.col(source).alias("source"), F.xxhash64(plain).alias("cluster"), word_count(text).alias("size")
    )


def pack_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY) -> DataFrame:
    """``pack`` over ``items_of``, the id named as in ``docs``.  Other columns are ignored; an empty table gives
    an empty result."""
    return pack(items_of(docs, id, text, source), capacity).withColumnRenamed("id", id)
