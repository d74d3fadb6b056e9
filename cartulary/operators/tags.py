"""Tags and lookups as edge tables: ``(name, tag)`` and ``(name, value)``."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions.names import is_search_type
from ..functions.skew import join_hot
from .metadata import rename_keys

EDGE = ["name", "tag"]


def list_tags(tags: DataFrame) -> DataFrame:
    """The vocabulary."""
    return tags.select("tag").distinct()


def _narrow(tags: DataFrame, name_like: str | None, kind: str | None) -> DataFrame:
    if name_like is not None:
        tags = tags.filter(F.col("name").like(name_like))
    return tags if kind is None else tags.filter(is_search_type(F.col("name"), kind))


def list_tagged(
    tags: DataFrame,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    name_like: str | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Names with any included tag (or any tag at all) and none of the excluded ones.

    One pass: each name folds to two flags before anything is shuffled.
    """
    include, exclude = include or [], exclude or []
    wanted = F.col("tag").isin(include) if include else F.lit(True)
    unwanted = F.col("tag").isin(exclude) if exclude else F.lit(False)
    flags = (
        _narrow(tags, name_like, kind)
        .filter(wanted | unwanted)
        .groupBy("name")
        .agg(F.max(wanted).alias("_in"), F.max(unwanted).alias("_out"))
    )
    return flags.filter(F.col("_in") & ~F.col("_out")).select("name")


def search_tags(tags: DataFrame, prefix: str | None = None, name_like: str | None = None) -> DataFrame:
    """Names with a tag that starts with a text."""
    found = tags if prefix is None else tags.filter(F.col("tag").startswith(prefix))
    return _narrow(found, name_like, None).select("name").distinct()


def tag_changes(tags: DataFrame, desired: DataFrame) -> DataFrame:
    """``(name, tag, change)`` that turns the tags of the desired names into the desired ones.

    A name is given an empty set by a row whose tag is null.
    """
    touched = tags.join(desired.select("name"), "name", "left_semi").select(*EDGE).distinct()
    wanted = desired.filter("tag is not null").select(*EDGE).distinct()
    inserts = wanted.join(touched, EDGE, "left_anti").withColumn("change", F.lit("insert"))
    deletes = touched.join(wanted, EDGE, "left_anti").withColumn("change", F.lit("delete"))
    return inserts.unionByName(deletes)


def set_tags(tags: DataFrame, desired: DataFrame) -> DataFrame:
    """Tags after setting those of the desired names; other names are left alone."""
    others = tags.select(*EDGE).join(desired.select("name"), "name", "left_anti")
    return others.unionByName(desired.filter("tag is not null").select(*EDGE).distinct())


def remove_tags(tags: DataFrame, requests: DataFrame) -> DataFrame:
    """Tags left after removal requests; a request with a null tag clears the whole name."""
    whole = requests.filter("tag is null").select("name")
    single = requests.filter("tag is not null").select(*EDGE)
    return tags.join(whole, "name", "left_anti").join(single, EDGE, "left_anti").select(*EDGE)


def rename_tags(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """Re-key tags by ``(old, new)``; what the new name carried goes first."""
    return rename_keys(tags.select(*EDGE), mapping, "name", replace_target=True)


def purge_obsolete_tags(tags: DataFrame, live_tables: DataFrame) -> DataFrame:
    """Tags left after dropping those of tables that are gone; other levels stay."""
    live = live_tables.select("name", F.lit(True).alias("_live")).distinct()
    is_table = is_search_type(F.col("name"), "table")
    return tags.join(live, "name", "left").filter(~is_table | F.col("_live").isNotNull()).select(*EDGE)


def tag_guard(tables: DataFrame, tags: DataFrame, blocked: DataFrame) -> DataFrame:
    """``(name, operation)`` for every operation a tag of the table blocks.

    ``blocked`` is the small list ``(operation, tag)``.
    """
    by_tag = join_hot(tags.select(*EDGE), blocked, ["tag"], "inner", ["name"])
    pairs = by_tag.select("name", "operation").distinct()
    return pairs.join(tables.select("name"), "name", "left_semi")


def set_lookup(lookups: DataFrame, desired: DataFrame) -> DataFrame:
    """Replace the value sets of the desired names."""
    others = lookups.join(desired.select("name"), "name", "left_anti")
    return others.unionByName(desired.filter("value is not null").distinct())


def add_lookup(lookups: DataFrame, extra: DataFrame) -> DataFrame:
    """Add values that are not there yet."""
    return lookups.unionByName(extra.filter("value is not null")).distinct()
