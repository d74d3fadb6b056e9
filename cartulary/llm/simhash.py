"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from .common import components, store, text_of

SEED = 42
WORDS = 3
BLOCK = 1 << 15  # shingles whose bits are unpacked at a time


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a text, unsigned: bit i is set when it is set in over half the hashes of
    the text's shingles, repeats included.  A text without words has fingerprint 0."""
    found = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not found:
        return 0
    runs = zip(*(found[i:] for i in range(words))) if len(found) >= words else [found]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fp``: the fingerprint of each row as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id).alias("id"), of(text_of(text).cast("binary")).alias("fp"))


def ball_links(fps: DataFrame) -> DataFrame:
    """``a, b``: links that join all fingerprints at 2 or fewer differing bits, given distinct ``fp``.

    Every fingerprint is sent to itself and to its 64 neighbours at one bit.  Two fingerprints at two bits
    or fewer meet at some variant, and all that meet at one variant are within two bits of each other.  A
    variant's group is folded into one flag and one 64-bit mask of the bits its members differ by, so it has
    a fixed size, and its members are linked to the smallest of them rather than in all pairs.
    """
    bit = F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit")
    mask = F.when(F.col("bit") < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))
    variants = fps.select("fp", bit).select(
        F.col("fp").bitwiseXOR(mask).alias("variant"),
        mask.alias("mask"),
        F.when(F.col("bit") < 0, 1).otherwise(0).alias("own"),
    )
    met = (
        variants.groupBy("variant")
        .agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own"))
        .where(F.bit_count("mask") + F.col("own") > 1)
    )
    one = F.lit(1).cast("long")
    flips = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", one, i)),
        lambda m: F.col("mask").bitwiseAND(m) != 0,
    )
    members = F.concat(
        F.transform(flips, lambda m: F.col("variant").bitwiseXOR(m)),
        F.when(F.col("own") == 1, F.array("variant")).otherwise(F.array().cast("array<bigint>")),
    )
    stars = met.select(members.alias("all")).select(F.array_min("all").alias("b"), F.explode("all").alias("a"))
    return (
        stars.where("a <> b")
        .distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
        .select("a", "b")
    )


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fp, component_id``: one row per row of ``docs``.

    Texts whose fingerprints differ by 2 bits or fewer are linked; component_id is the smallest id that links
    reach.  Null and empty texts have fingerprint 0 and link like any other; null ids never are the smallest
    unless a component has nothing else (then component_id is null).  Repeated rows fall together.  Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = store(fingerprints(docs, id, text), "fingerprints")
    nodes = store(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(ball_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of = placed.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(F.col("id").alias(id), "fp", "component_id")


def simhash_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component.

    Where that id stands on several rows one of them stays, so each group keeps exactly one row.  Columns
    are those of ``docs``.
    """
    groups = simhash_groups(docs, id, text).where(F.col(id).eqNullSafe(F.col("component_id")))
    stays = groups.groupBy(F.col(id).alias("_keep")).agg(F.count("*").alias("_same"))
    match = docs[id].eqNullSafe(stays["_keep"])
    once = docs.join(stays.where("_same = 1"), match, "left_semi")
    again = docs.join(stays.where("_same > 1"), match, "left_semi").dropDuplicates([id])
    return once.union(again)
