"""Operators over qualified names."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions import names as N


def _parts(df: DataFrame) -> dict[str, Column]:
    return {p: F.coalesce(F.col(p), F.lit("")) if p in df.columns else F.lit("") for p in N.PARTS}


def parse_name(df: DataFrame, col: str = "name") -> DataFrame:
    """Split a name into its five parts and classify it."""
    split = df.withColumns(N.name_parts(F.col(col)))
    return split.withColumn("entity_type", N.entity_type(_parts(split)))


def format_name(df: DataFrame) -> DataFrame:
    """Canonical text of the five part columns, as ``name``."""
    return df.withColumn("name", N.canonical_name(_parts(df)))


def standardize_name(df: DataFrame, upper_catalogs: bool = False) -> DataFrame:
    """Trim and apply the catalog's case rule; ``problem`` says why a row is no legal name."""
    p = {k: F.trim(v) for k, v in _parts(df).items()}
    catalog = F.lower(p["catalog_name"])
    cased = {
        "catalog_name": catalog,
        "partition_name": p["partition_name"],
        **{
            k: N.apply_case(catalog, p[k], upper_catalogs)
            for k in ("database_name", "table_name", "view_name")
        },
    }
    out = df.withColumns(cased)
    parts = _parts(out)
    return out.withColumns({"name": N.canonical_name(parts), "problem": N.name_problem(parts)})


def with_entity_type(df: DataFrame, col: str = "name") -> DataFrame:
    """Classify names without keeping their parts."""
    return df.withColumn("entity_type", N.entity_type(N.name_parts(F.col(col))))


def match_names(
    df: DataFrame,
    catalog: str | None = None,
    database: str | None = None,
    table: str | None = None,
    all_levels: bool = False,
    col: str = "name",
) -> DataFrame:
    """Names under a wildcard; every level left out matches anything."""
    build = N.level_pattern if all_levels else N.listing_pattern
    pattern = build(catalog, database, table)
    return df if pattern is None else df.filter(F.col(col).like(pattern))


def starts_with_name(df: DataFrame, prefix: str, col: str = "name") -> DataFrame:
    """Names with a prefix; reaches the file scan as a pushed filter."""
    return df.filter(F.col(col).startswith(prefix))


# Member names of a name written as JSON.
JSON_MEMBERS = {
    "catalog_name": "catalogName",
    "database_name": "databaseName",
    "table_name": "tableName",
    "partition_name": "partitionName",
    "view_name": "viewName",
}
QUALIFIED = "qualifiedName"


def name_to_map(df: DataFrame, col: str = "name") -> DataFrame:
    """Non-empty parts plus the whole name as a map and as JSON."""
    parts = N.name_parts(F.col(col))
    pairs = [x for k in N.PARTS for x in (F.lit(JSON_MEMBERS[k]), parts[k])]
    whole = F.create_map(F.lit(QUALIFIED), N.canonical_name(parts), *pairs)
    as_map = F.map_filter(whole, lambda _, v: v != "")
    return df.withColumn("name_map", as_map).withColumn("name_json", F.to_json(F.col("name_map")))


def name_from_json(df: DataFrame, col: str = "name_json") -> DataFrame:
    """Read a JSON name back: its parts, or its whole text when no catalog is given."""
    members = ", ".join(f"{m} string" for m in (*JSON_MEMBERS.values(), QUALIFIED))
    parsed = F.from_json(F.col(col), members)
    from_text = N.name_parts(parsed[QUALIFIED])
    has_catalog = parsed[JSON_MEMBERS["catalog_name"]].isNotNull()
    parts = {
        p: F.when(has_catalog, F.coalesce(parsed[JSON_MEMBERS[p]], F.lit(""))).otherwise(from_text[p])
        for p in N.PARTS
    }
    return df.withColumns(parts)
