"""Audit tables laid over the tables they audit."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .partitions import ID

# The audit database, and how an audit table spells its source.
AUDIT_DATABASE = "audit"
AUDIT_TABLE = r"^(.*)__(.*)__audit(.*)$"


def pair_audit_tables(tables: DataFrame) -> DataFrame:
    """Audit tables with the source database and table their name spells."""
    name = F.col("table_name")
    return tables.filter((F.col("database_name") == AUDIT_DATABASE) & name.rlike(AUDIT_TABLE)).withColumns(
        {
            "source_database": F.regexp_extract(name, AUDIT_TABLE, 1),
            "source_table": F.regexp_extract(name, AUDIT_TABLE, 2),
        }
    )


def audit_overlay(audit: DataFrame, source: DataFrame) -> DataFrame:
    """Audit partitions, plus source partitions the audit table does not hold."""
    return audit.unionByName(source.join(audit.select(*ID), ID, "left_anti"))


def audit_count(audit: DataFrame, source: DataFrame) -> DataFrame:
    """Distinct partition names per table over both sides."""
    both = audit.select(*ID).unionByName(source.select(*ID))
    return both.groupBy("table_name").agg(F.countDistinct("part_name").alias("partitions"))


def audit_keys(audit_keys_: DataFrame, source_keys: DataFrame) -> DataFrame:
    """Distinct key schema rows over both sides."""
    return audit_keys_.unionByName(source_keys).distinct()
