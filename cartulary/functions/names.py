"""Qualified names: ``catalog[/database[/table[/partition | view]]]``."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

PARTS = ("catalog_name", "database_name", "table_name", "partition_name", "view_name")

# Catalogs that keep or raise the case of database, table and view names.
KEEP_CASE_PREFIX = "cde_"
KEEP_CASE_SUFFIX = "druid"
UPPER_CASE_PREFIX = "snowflake-dse"

# What a stored name must look like to count as one of these types in a search.
SEARCH_TYPES = {
    "catalog": "^[^/]*$",
    "database": "^[^/]*/[^/]*$",
    "table": "^[^/]*/[^/]*/[^/]*$",
    "partition": "^[^/]*/[^/]*/[^/]*/.*$",
}


def name_parts(name: Column) -> dict[str, Column]:
    """The five parts of a name, empty text where a part is absent."""
    pieces = F.split(F.trim(name), "/", 4)

    def piece(i: int) -> Column:
        return F.coalesce(F.get(pieces, i), F.lit(""))

    last = piece(3)
    is_partition = last.contains("=")
    return {
        "catalog_name": piece(0),
        "database_name": piece(1),
        "table_name": piece(2),
        "partition_name": F.when(is_partition, last).otherwise(F.lit("")),
        "view_name": F.when(is_partition, F.lit("")).otherwise(last),
    }


def canonical_name(parts: dict[str, Column]) -> Column:
    """Join the non-empty parts with ``/``."""
    return F.concat_ws("/", *[F.nullif(parts[p], F.lit("")) for p in PARTS])


def entity_type(parts: dict[str, Column]) -> Column:
    """Which kind of entity the parts denote."""
    return (
        F.when(parts["view_name"] != "", "MVIEW")
        .when(parts["partition_name"] != "", "PARTITION")
        .when(parts["table_name"] != "", "TABLE")
        .when(parts["database_name"] != "", "DATABASE")
        .otherwise("CATALOG")
    )


def apply_case(catalog: Column, part: Column, upper_catalogs: bool = False) -> Column:
    """Case rule of the catalog for a database, table or view name."""
    keeps = catalog.startswith(KEEP_CASE_PREFIX) | catalog.endswith(KEEP_CASE_SUFFIX)
    cased = F.when(keeps, part)
    if upper_catalogs:
        cased = cased.when(catalog.startswith(UPPER_CASE_PREFIX), F.upper(part))
    return cased.otherwise(F.lower(part))


def name_problem(parts: dict[str, Column]) -> Column:
    """Why a combination of parts is illegal, or null."""
    return (
        F.when(parts["catalog_name"] == "", "catalog missing")
        .when(
            (parts["database_name"] == "")
            & ((parts["table_name"] != "") | (parts["partition_name"] != "")),
            "database missing",
        )
        .when((parts["table_name"] == "") & (parts["partition_name"] != ""), "table missing")
    )


def listing_pattern(catalog: str | None, database: str | None, table: str | None) -> str | None:
    """LIKE pattern that narrows a listing; stops at the first level not asked for."""
    if catalog is None and database is None and table is None:
        return None
    pattern = catalog or "%"
    if not database and not table:
        return pattern + "%"
    pattern += "/" + (database or "%")
    return pattern + "%" if not table else f"{pattern}/{table}%"


def level_pattern(catalog: str | None, database: str | None, table: str | None) -> str | None:
    """LIKE pattern that always spells out three levels."""
    if catalog is None and database is None and table is None:
        return None
    levels = ["%" if level is None else level for level in (catalog, database, table)]
    return "/".join(levels) + "%"


def is_search_type(name: Column, kind: str) -> Column:
    """Does the stored name have the shape of the given type?"""
    return name.rlike(SEARCH_TYPES[kind])
