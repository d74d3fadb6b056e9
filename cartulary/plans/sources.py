"""Readers and sinks."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions.times import epoch_seconds
from ..session import keep, shared_folder
from ..sources import jdbc as J
from ..sources import metastore as M
from ..sources import segments as G
from ..sources import snapshot as N
from .bindings import KEYS, Bindings
from .registry import query


@query(
    "inventory_partitions", "O-01",
    sql="""SELECT part_id, r_name AS catalog_name, n_name AS database_name, c_name AS table_name, part_name, uri, c_mktsegment AS serde
    FROM v_parts JOIN customer ON table_name = 'c' || c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def inventory_partitions(b: Bindings) -> DataFrame:
    c, n, r = b.table("customer"), b.table("nation"), b.table("region")
    parts = b.parts.select(
        "part_id", "part_name", F.col("part_id").alias("sd_id"), F.substring("table_name", 2, 20).cast("bigint").alias("tbl_id")
    )
    storage = b.parts.select(
        F.col("part_id").alias("sd_id"), "uri", F.substring("table_name", 2, 20).cast("bigint").alias("serde_id")
    )
    serdes = c.select(F.col("c_custkey").alias("serde_id"), F.col("c_mktsegment").alias("serde"))
    tables = c.select(F.col("c_custkey").alias("tbl_id"), F.col("c_name").alias("table_name"), F.col("c_nationkey").alias("db_id"))
    databases = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("db_id"), F.col("n_name").alias("database_name"), F.col("r_name").alias("catalog_name")
    )
    out = M.partition_inventory(parts, tables, databases, storage, serdes)
    return out.select("part_id", "catalog_name", "database_name", "table_name", "part_name", "uri", "serde")


@query(
    "inventory_tables", "O-02",
    sql="""SELECT c_custkey AS tbl_id, n_name AS database_name, c_name AS table_name, 's3://wh/' || lower(c_name) AS location
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def inventory_tables(b: Bindings) -> DataFrame:
    c = b.table("customer")
    key = F.col("c_custkey")
    tables = c.select(key.alias("tbl_id"), key.alias("sd_id"), F.col("c_name").alias("table_name"), F.col("c_nationkey").alias("db_id"))
    databases = b.table("nation").select(F.col("n_nationkey").alias("db_id"), F.col("n_name").alias("database_name"))
    storage = c.select(key.alias("sd_id"), F.concat(F.lit("s3://wh/"), F.lower("c_name")).alias("location"))
    return M.table_inventory(tables, databases, storage).select("tbl_id", "database_name", "table_name", "location")


@query(
    "inventory_partition_keys", "O-03",
    sql="""SELECT c_name AS table_name, CAST(unnest([0, 1]) AS INTEGER) AS integer_idx, unnest(['dateint', 'status']) AS pkey_name,
        unnest(['int', 'string']) AS pkey_type FROM customer""",
)
def inventory_partition_keys(b: Bindings) -> DataFrame:
    c = b.table("customer")
    keys = F.array(*[
        F.struct(F.lit(k).alias("pkey_name"), F.lit(t).alias("pkey_type")) for k, t in zip(KEYS, ("int", "string"))
    ])
    rows = c.select(F.col("c_custkey").alias("tbl_id"), F.posexplode(keys).alias("integer_idx", "k")).select(
        "tbl_id", "integer_idx", "k.*"
    )
    tables = c.select(F.col("c_custkey").alias("tbl_id"), F.col("c_name").alias("table_name"))
    return M.partition_key_schema(rows, tables)


@query(
    "source_columns", "O-04",
    sql="""SELECT p_brand AS table_schema, p_name AS column_name, CAST(p_size AS BIGINT) AS pos,
        CASE p_type WHEN 'ECONOMY' THEN 'decimal(' || p_size || ', 2)' WHEN 'SMALL' THEN 'int(' || p_size || ') unsigned'
            WHEN 'MEDIUM' THEN 'text' ELSE 'varchar(' || p_size || ')' END AS source_type, p_type = 'PROMO' AS is_nullable
    FROM part WHERE p_type <> 'LARGE'""",
)
def source_columns(b: Bindings) -> DataFrame:
    kind = F.col("p_type")
    view = b.table("part").select(
        F.when(kind == "LARGE", J.SYSTEM_SCHEMA).otherwise(F.col("p_brand")).alias("table_schema"),
        F.lit("t").alias("table_name"),
        F.col("p_name").alias("column_name"),
        F.col("p_size").cast("bigint").alias("ordinal_position"),
        F.when(kind == "ECONOMY", "decimal").when(kind == "SMALL", "int unsigned").when(kind == "MEDIUM", "text").otherwise("varchar").alias("data_type"),
        F.when(kind != "MEDIUM", F.col("p_size")).alias("size"),
        F.when(kind == "ECONOMY", 2).alias("scale"),
        F.when(kind == "PROMO", "yes").otherwise("NO").alias("is_nullable"),
        F.lit(None).cast("string").alias("column_default"),
    )
    return J.jdbc_columns(view).select("table_schema", "column_name", "pos", "source_type", "is_nullable")


@query(
    "source_schemas", "O-05",
    sql="SELECT DISTINCT lower(n_name) AS schema_name FROM nation WHERE n_regionkey <> 0",
)
def source_schemas(b: Bindings) -> DataFrame:
    system = F.when(F.col("n_regionkey") == 0, J.SYSTEM_SCHEMA.upper()).otherwise(F.lower("n_name"))
    return J.jdbc_schemas(b.table("nation").select(system.alias("schema_name")))


@query(
    "source_sliced_read", "O-06",
    sql="SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE starts_with(c_name, 'Customer#0000')",
)
def source_sliced_read(b: Bindings) -> DataFrame:
    customer = b.table("customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    bounds = ["Customer#000000400", "Customer#000000800", "Customer#000005000"]
    return J.read_sliced(lambda p: customer.filter(p), "name", bounds, "Customer#0000")


@query(
    "source_sliced_measured", "O-06",
    sql="SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE starts_with(c_name, 'Customer#0000')",
)
def source_sliced_measured(b: Bindings) -> DataFrame:
    """Slices whose bounds come from the keys themselves."""
    customer = b.table("customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    bounds = J.slice_bounds(customer, "name", 6, "Customer#0000")
    return J.read_sliced(lambda p: customer.filter(p), "name", bounds, "Customer#0000")


@query(
    "data_partition_metrics", "O-07",
    sql="""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS row_count, CAST(epoch(max(l_shipdate)) AS BIGINT) AS newest
    FROM lineitem GROUP BY 1, 2""",
)
def data_partition_metrics(b: Bindings) -> DataFrame:
    out = M.partition_metrics(b.table("lineitem"), ["l_returnflag", "l_linestatus"], "l_shipdate")
    # the file count depends on how the data is laid out, so it is not compared
    return out.withColumn("newest", epoch_seconds(F.col("newest"))).drop("file_count")


@query(
    "data_metrics_updated", "O-07",
    sql="""SELECT l_returnflag, l_linestatus, CAST(l_suppkey % 5 AS BIGINT) AS bucket, count(*) AS row_count,
        count(DISTINCT l_orderkey % 60) AS file_count, CAST(epoch(max(l_shipdate)) AS BIGINT) AS newest
    FROM lineitem WHERE NOT (l_orderkey % 60 < 20 AND l_orderkey % 7 = 0) AND l_orderkey % 60 <> 33 GROUP BY 1, 2, 3""",
)
def data_metrics_updated(b: Bindings) -> DataFrame:
    """Two snapshots of a table whose files are listed with their numbers: some go, some come, some are rewritten."""
    keys = ["l_returnflag", "l_linestatus", "bucket"]
    rows = b.table("lineitem").select(
        "l_returnflag", "l_linestatus", (F.col("l_suppkey") % 5).alias("bucket"), "l_orderkey", "l_shipdate", (F.col("l_orderkey") % 60).alias("file")
    )

    def listed(kept: DataFrame) -> DataFrame:
        path = F.concat(F.lit("f"), F.col("file").cast("string"))
        return kept.groupBy(*keys, path.alias("path")).agg(F.count("*").alias("row_count"), F.max("l_shipdate").alias("newest"))

    shrunk = (F.col("file") < 20) & (F.col("l_orderkey") % 7 == 0)
    before = listed(rows.filter("file < 45"))
    after = keep(listed(rows.filter(~shrunk & (F.col("file") != 33))), "files")
    columns = after.columns
    old = M.metrics_of_files(before, keys)
    removed, added = before.select(*columns).exceptAll(after), after.exceptAll(before.select(*columns))
    updated = M.update_metrics(old, after, added, removed, keys)
    return updated.withColumn("newest", epoch_seconds(F.col("newest")))


_DIMENSIONS = {"click": "page,ref", "view": "page", "signup": "country,device,page", "purchase": "item", "error": ""}


def _segments(b: Bindings) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in _DIMENSIONS.items() for x in pair])
    start = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    end = F.date_format(F.col("ts") + F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    key = F.concat(F.lit("seg/"), F.col("event_id").cast("string"), F.lit("/index.zip,second"))
    described = b.table("events").select(
        F.to_json(
            F.struct(
                F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("dataSource"),
                F.concat_ws("/", start, end).alias("interval"),
                kinds[F.col("event_type")].alias("dimensions"),
                F.when(F.col("event_type") == "view", "").otherwise("value,count").alias("metrics"),
                F.struct(
                    F.lit("s3").alias("type"),
                    F.when(F.col("event_type") != "error", "bucket").alias("bucket"),
                    key.alias("key"),
                ).alias("loadSpec"),
            )
        ).alias("json")
    )
    return G.parse_segments(described)


@query(
    "segment_schema", "O-08",
    sql="""WITH latest AS (SELECT 'u' || id AS table_name, event_type FROM v_data),
    fields AS (SELECT table_name, event_type, list_concat(
        CASE event_type WHEN 'click' THEN ['string:page', 'string:ref'] WHEN 'view' THEN ['string:page']
            WHEN 'signup' THEN ['string:country', 'string:device', 'string:page'] WHEN 'purchase' THEN ['string:item'] ELSE [] END,
        CASE event_type WHEN 'view' THEN [] ELSE ['double:value', 'double:count'] END) AS f FROM latest),
    one AS (SELECT table_name, unnest(range(len(f))) AS pos, unnest(f) AS f FROM fields)
    SELECT table_name, CAST(pos AS INTEGER) AS pos, split_part(f, ':', 2) AS name, split_part(f, ':', 1) AS type,
        CASE WHEN f LIKE 'string%' THEN 'dimensions' ELSE 'metrics' END AS comment FROM one""",
)
def segment_schema(b: Bindings) -> DataFrame:
    return G.infer_segment_schema(_segments(b))


@query(
    "segment_inventory", "O-09",
    sql="""SELECT 'u' || user_id AS table_name, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '/' || strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.%f') AS part_name,
        CASE WHEN event_type = 'error' THEN '' ELSE 'bucket/seg/' || event_id END AS uri FROM events""",
)
def segment_inventory(b: Bindings) -> DataFrame:
    return G.segment_inventory(_segments(b))


@query(
    "inventory_external_catalog", "O-10",
    sql="""SELECT r_name AS source_name, n_name AS database_name, s_name AS table_name, 's3://ext/' || s_suppkey AS uri
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def inventory_external_catalog(b: Bindings) -> DataFrame:
    s = b.table("supplier")
    key = F.col("s_suppkey")
    sources = b.table("region").select(F.col("r_regionkey").alias("source_id"), F.col("r_name").alias("source_name"))
    databases = b.table("nation").select(
        F.col("n_nationkey").alias("database_id"), F.col("n_name").alias("database_name"), F.col("n_regionkey").alias("source_id")
    )
    tables = s.select(key.alias("table_id"), F.col("s_name").alias("table_name"), F.col("s_nationkey").alias("database_id"))
    locations = s.select(key.alias("table_id"), F.concat(F.lit("s3://ext/"), key.cast("string")).alias("uri"))
    out = M.external_catalog_inventory(sources, databases, tables, locations)
    return out.select("source_name", "database_name", "table_name", "uri")


def scratch(b: Bindings, name: str) -> str:
    """A new folder of its own under the shared folder."""
    return f"{shared_folder(b.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "snapshot_roundtrip", "O-11",
    sql="SELECT table_name, part_name, uri, coalesce(status, 'none') AS status FROM v_parts",
)
def snapshot_roundtrip(b: Bindings) -> DataFrame:
    path = scratch(b, "snapshot")
    status = F.regexp_extract("part_name", "status=([A-Z])$", 1)
    rows = b.parts.select("table_name", "part_name", "uri", F.coalesce(F.nullif(status, F.lit("")), F.lit("none")).alias("status"))
    N.write_snapshot(rows.filter("status = 'F'"), path, ["status"])
    N.write_snapshot(rows, path, ["status"])
    return N.read_snapshot(b.spark, path).select("table_name", "part_name", "uri", "status")


@query(
    "search_docs_written", "O-12",
    sql="""SELECT name, CASE WHEN lang <> 'es' THEN length(body) ELSE -1 END AS size, CASE WHEN lang <> 'es' THEN md5(body) END AS body_md5,
        kind, "user", deleted, updated_at, run, uri FROM v_docs""",
)
def search_docs_written(b: Bindings) -> DataFrame:
    path = scratch(b, "index")
    body = F.when(F.split("name", "/")[1] == "es", "{}").otherwise(F.col("body"))
    N.write_search_docs(b.docs.withColumn("body", body), path)
    # every field of every document is read back and compared, bodies by their hashes
    read = b.spark.read.schema(b.docs.schema).json(path)
    size, code = F.coalesce(F.length("body").cast("bigint"), F.lit(-1)), F.md5(F.col("body").cast("binary"))
    return read.select("name", size.alias("size"), code.alias("body_md5"), "kind", "user", "deleted", "updated_at", "run", "uri")
