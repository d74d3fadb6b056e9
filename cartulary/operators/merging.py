"""JSON documents merged by the algebra of their paths.

A document is a set of writes: a scalar (an array, too) at a path, or an object that is open to further members.  Of many
documents applied in turn, what is left follows from the latest writes along each path, so nothing is applied one
after the other: writes fold to one row per path before they meet, and documents are put together from the bottom up.
"""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..session import keep

NODE = ["name", "path"]


def _writes(docs: DataFrame) -> list[DataFrame]:
    """The writes ``(name, at, path, text)`` of ``(name, at, doc)``, one frame per depth; an object has a null text.

    Each round opens the objects of one depth.  They are kept, so that a deeper round does not parse again.
    """
    found = []
    level = docs.select("name", "at", F.array().cast("array<string>").alias("path"), F.parse_json("doc").alias("value"))
    while True:
        is_object = F.schema_of_variant("value").startswith("OBJECT")
        text = F.when(~is_object, F.to_json("value"))
        members = F.when(is_object, F.col("value").cast("map<string,variant>"))
        told = keep(
            level.select("name", "at", "path", text.alias("text"), F.transform_values(members, lambda _, v: F.to_json(v)).alias("members")), "writes"
        )
        found.append(told.select("name", "at", "path", "text"))
        inner = told.filter(F.size("members") > 0)
        if inner.isEmpty():
            return found
        level = inner.select("name", "at", "path", F.explode("members").alias("key", "json")).select(
            "name", "at", F.concat("path", F.array("key")).alias("path"), F.parse_json("json").alias("value")
        )


def _above(path: Column) -> Column:
    """All proper leading parts of a path."""
    return F.transform(F.sequence(F.lit(0), F.size(path) - 1), lambda n: F.slice(path, F.lit(1), n))


def merge_in_turn(docs: DataFrame) -> DataFrame:
    """``(name, data)`` out of ``(name, at, doc)``: each name's documents merged in order of ``at``.

    Objects merge member by member, everything else (arrays and null too) replaces what was there.  A scalar is
    left if nothing was written to its path later and no scalar to a path above it; an object is left if no scalar
    was written to its path or above it since.  Members come in order of their names.

    Writes of a path fold to its latest ones before the shuffle, so a name with very many documents costs as many rows
    as paths it has written.  Numbers are exact up to 38 digits.  A document that is no JSON is an error.
    """
    levels = _writes(docs)
    every = reduce(DataFrame.unionByName, levels)
    is_scalar = F.col("text").isNotNull()
    latest = keep(
        every.groupBy(*NODE).agg(
            F.max(F.when(is_scalar, F.col("at"))).alias("scalar_at"),
            F.max_by("text", F.when(is_scalar, F.col("at"))).alias("text"),
            F.max(F.when(~is_scalar, F.col("at"))).alias("object_at"),
        ),
        "paths",
    )
    # the latest scalar above each path
    scalars = latest.filter("scalar_at IS NOT NULL").select("name", F.col("path").alias("above"), F.col("scalar_at").alias("over"))
    below = latest.filter(F.size("path") > 0).select(*NODE, F.explode(_above(F.col("path"))).alias("above"))
    covered = below.join(scalars, ["name", "above"]).groupBy(*NODE).agg(F.max("over").alias("over"))
    judged = latest.join(covered, NODE, "left")

    def later(a: str, b: str) -> Column:
        return F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) > F.col(b)))

    scalar = later("scalar_at", "object_at") & later("scalar_at", "over")
    opened = later("object_at", "scalar_at") & later("object_at", "over")
    left = judged.select(*NODE, F.when(scalar, F.col("text")).alias("text"), opened.alias("opened")).filter("text IS NOT NULL OR opened")
    left = keep(left.withColumn("depth", F.size("path")), "left")

    # bottom up: the members of each depth make the objects of the one above
    members = None
    for depth in range(len(levels) - 1, -1, -1):
        here = left.filter(F.col("depth") == depth)
        if members is None:
            nodes = here.select(*NODE, F.coalesce("text", F.lit("{}")).alias("text"))
        else:
            inside = F.concat(F.lit("{"), F.coalesce("inside", F.lit("")), F.lit("}"))
            nodes = here.join(members, NODE, "left").select(*NODE, F.coalesce("text", inside).alias("text"))
        if depth:
            key = F.to_json(F.array(F.element_at("path", -1)))
            member = F.struct(F.element_at("path", -1).alias("key"), F.concat(F.expr("substring(k, 2, length(k) - 2)"), F.lit(":"), "text").alias("text"))
            made = nodes.withColumn("k", key).select("name", F.slice("path", 1, depth - 1).alias("path"), member.alias("m"))
            members = made.groupBy(*NODE).agg(F.array_join(F.array_sort(F.collect_list("m"))["text"], ",").alias("inside"))
    return nodes.select("name", F.col("text").alias("data"))
