"""The test tables seen as catalog metadata.

The same views are written in SQL in ``views.py``.
"""

from __future__ import annotations

from functools import cached_property

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions.partition_names import DEFAULT_PARTITION

KEYS = ["dateint", "status"]


class Bindings:
    """Views over one folder of test tables; each is built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def tables(self) -> DataFrame:
        homes = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        rows = self.table("customer").join(homes, F.col("c_nationkey") == F.col("n_nationkey"))
        name = F.lower(F.concat_ws("/", "r_name", "n_name", "c_name"))
        return rows.select(
            F.col("c_custkey").alias("custkey"),
            name.alias("name"),
            F.lower("r_name").alias("catalog_name"),
            F.lower("n_name").alias("database_name"),
            F.lower("c_name").alias("table_name"),
            F.concat(F.lit("u"), (F.col("c_custkey") % 50).cast("string")).alias("owner"),
            F.concat(F.lit("s3://wh/"), name).alias("uri"),
            F.lower("c_mktsegment").alias("segment"),
        )

    @cached_property
    def parts(self) -> DataFrame:
        # numbers only until the duplicates are folded; the texts are built afterwards
        status = F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderstatus"))
        first = (
            self.table("orders")
            .groupBy("o_custkey", F.to_date("o_orderdate").alias("day"), status.alias("status"))
            .agg(
                F.min("o_orderkey").alias("part_id"),
                F.min_by("o_orderdate", "o_orderkey").alias("create_time"),
            )
        )
        table = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
        part = F.concat(
            F.lit("dateint="),
            F.date_format("day", "yyyyMMdd"),
            F.lit("/status="),
            F.coalesce("status", F.lit(DEFAULT_PARTITION)),
        )
        batch = F.concat(F.lit("batchid="), (F.col("part_id") % 5).cast("string"))
        return first.select(
            "part_id",
            table.alias("table_name"),
            part.alias("part_name"),
            "create_time",
            F.concat_ws("/", F.lit("s3://wh"), table, part, batch).alias("uri"),
        )

    def _renamed(self, df: DataFrame, status: str) -> F.Column:
        return F.regexp_replace("part_name", "status=.*$", f"status={status}")

    @cached_property
    def audit(self) -> DataFrame:
        """Finished partitions under audit, and new ones spelled out of the pending ones."""
        marked = self.parts.withColumn("uri", F.concat("uri", F.lit("-audit")))
        known = marked.filter(F.col("part_name").endswith("status=F"))
        fresh = marked.filter(F.col("part_name").endswith("status=P"))
        return known.unionByName(fresh.withColumn("part_name", self._renamed(fresh, "A")))

    @cached_property
    def incoming(self) -> DataFrame:
        """A save request: same path, new path, unseen name or no path, by status."""
        name = F.col("part_name")
        recent = self.parts.filter(F.substring("part_name", 9, 8) >= "19960101")
        uri = (
            F.when(name.endswith("status=O"), F.concat("uri", F.lit("/v2")))
            .when(name.endswith(DEFAULT_PARTITION), "")
            .otherwise(F.col("uri"))
        )
        part = F.when(name.endswith("status=P"), self._renamed(recent, "N")).otherwise(name)
        return recent.withColumns(
            {
                "uri": uri,
                "part_name": part,
                "create_time": F.col("create_time") + F.expr("interval 1 day"),
            }
        )

    @cached_property
    def deletes(self) -> DataFrame:
        return self.parts.filter(F.substring("part_name", 9, 8) < "19960101").select(
            "table_name", "part_name"
        )

    @cached_property
    def defs(self) -> DataFrame:
        """Definition documents: with an owner, with an empty one, or with none, by segment."""
        t = self.tables
        rest = F.format_string('"tags":["%s"],"custkey":%d}', "segment", "custkey")
        owner = (
            F.when(F.col("segment") == "machinery", "{")
            .when(F.col("segment") == "furniture", '{"owner":{"userId":""},')
            .otherwise(F.format_string('{"owner":{"userId":"%s","team":"%s"},', "owner", "segment"))
        )
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("custkey") % 365).cast("int"))
        return t.select(
            F.col("custkey").alias("id"),
            "name",
            F.concat(owner, rest).alias("data"),
            day.cast("timestamp_ntz").alias("last_updated"),
        )

    @cached_property
    def data(self) -> DataFrame:
        """Data documents: the latest properties of each user."""
        last = F.max_by(F.struct("props", "event_type", "ts"), F.struct("ts", "event_id"))
        return (
            self.table("events")
            .groupBy("user_id")
            .agg(last.alias("e"))
            .select(
                F.col("user_id").alias("id"),
                F.concat(F.lit("s3://wh/u"), F.col("user_id").cast("string")).alias("uri"),
                F.col("e.props").alias("data"),
                "e.event_type",
                F.col("e.ts").alias("date_created"),
            )
        )

    @cached_property
    def tags(self) -> DataFrame:
        p = self.table("part")
        name = F.concat(
            F.lit("prod/"), F.lower("p_brand"), F.lit("/p"), F.col("p_partkey").cast("string")
        )
        return p.select(name.alias("name"), F.explode(F.array("p_brand", "p_type")).alias("tag"))

    @cached_property
    def edges(self) -> DataFrame:
        t = self.tables
        return t.select(
            F.concat_ws("/", F.lit("geo"), "catalog_name", "database_name").alias("parent"),
            F.concat(F.lit("n-"), F.col("database_name")).alias("parent_uuid"),
            F.concat(F.lit("geo/customer/"), F.col("table_name")).alias("child"),
            F.concat(F.lit("c"), F.col("custkey").cast("string")).alias("child_uuid"),
            F.col("segment").alias("relation_type"),
        )

    @cached_property
    def log(self) -> DataFrame:
        op = (
            F.when(F.col("event_type") == "signup", "create")
            .when(F.col("event_type") == "purchase", "add")
            .when(F.col("event_type") == "error", "delete")
            .otherwise("update")
        )
        return self.table("events").select(
            "event_id",
            "ts",
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"),
            op.alias("op"),
            F.col("props").alias("payload"),
        )

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents").select(
            F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("name"),
            F.lit("table").alias("kind"),
            F.col("text").alias("body"),
            F.lit("admin").alias("user"),
            (F.col("lang") == "fr").alias("deleted"),
            F.col("n_chars").alias("updated_at"),
            F.col("source").alias("run"),
            F.concat_ws("/", F.lit("s3://wh"), "source", "lang").alias("uri"),
        )
