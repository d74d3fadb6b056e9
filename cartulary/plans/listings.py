"""Listing and counting partitions and tables, overlays and path resolution."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions import predicates as Q
from ..operators import overlay as O
from ..operators import partitions as P
from ..operators import resolve as R
from ..operators import tables as T
from .bindings import KEYS, Bindings
from .registry import query


@query(
    "partition_list_page", "O-42", "O-29", "O-30",
    sql="""SELECT part_id, table_name, part_name, uri FROM v_parts
    WHERE dateint BETWEEN 19960101 AND 19961231 AND status IS DISTINCT FROM 'F'
    ORDER BY part_name DESC, part_id LIMIT 500 OFFSET 50""",
)
def partition_list_page(b: Bindings) -> DataFrame:
    condition = Q.between(P.key("dateint", KEYS), 19960101, 19961231) & Q.ne(P.key("status", KEYS), "F")
    page = P.list_partitions(b.parts, condition, sort=[F.col("part_name").desc()], offset=50, limit=500)
    return page.select("part_id", "table_name", "part_name", "uri")


@query(
    "partition_list_all", "O-42",
    sql="""SELECT part_id, table_name, part_name, uri FROM v_parts
    WHERE dateint BETWEEN 19960101 AND 19961231 AND status IS DISTINCT FROM 'F'""",
)
def partition_list_all(b: Bindings) -> DataFrame:
    condition = Q.between(P.key("dateint", KEYS), 19960101, 19961231) & Q.ne(P.key("status", KEYS), "F")
    return P.list_partitions(b.parts, condition).select("part_id", "table_name", "part_name", "uri")


@query(
    "partition_list_names", "O-43",
    sql="SELECT table_name, part_name FROM v_parts WHERE status = 'O'",
)
def partition_list_names(b: Bindings) -> DataFrame:
    return P.partition_names(b.parts, predicate=Q.eq(P.key("status", KEYS), "O"))


@query(
    "partition_list_uris", "O-43",
    sql="SELECT table_name, uri FROM v_parts WHERE status IS NOT NULL",
)
def partition_list_uris(b: Bindings) -> DataFrame:
    uri = F.when(Q.is_null(P.key("status", KEYS), negate=True), F.col("uri"))
    return P.partition_uris(b.parts.withColumn("uri", uri))


@query(
    "partition_count", "O-44",
    sql="SELECT table_name, count(*) AS partitions FROM v_parts GROUP BY 1",
)
def partition_count(b: Bindings) -> DataFrame:
    return P.count_partitions(b.parts)


@query(
    "audit_pairs", "O-45",
    sql="""SELECT database_name || '__' || table_name || '__audit_' || custkey AS table_name,
        database_name AS source_database, table_name AS source_table FROM v_tables WHERE segment <> 'building'""",
)
def audit_pairs(b: Bindings) -> DataFrame:
    name = F.concat("database_name", F.lit("__"), "table_name", F.lit("__audit_"), F.col("custkey").cast("string"))
    spelled = b.tables.select(
        name.alias("table_name"),
        F.when(F.col("segment") == "building", "other").otherwise("audit").alias("database_name"),
    )
    return O.pair_audit_tables(spelled).select("table_name", "source_database", "source_table")


@query(
    "audit_overlay", "O-45",
    sql="""SELECT table_name, part_name, uri FROM v_audit
    UNION ALL SELECT table_name, part_name, uri FROM v_parts p
    WHERE NOT EXISTS (SELECT 1 FROM v_audit a WHERE a.table_name = p.table_name AND a.part_name = p.part_name)""",
)
def audit_overlay(b: Bindings) -> DataFrame:
    columns = ["table_name", "part_name", "uri"]
    return O.audit_overlay(b.audit.select(*columns), b.parts.select(*columns))


@query(
    "audit_count", "O-46",
    sql="""SELECT table_name, count(DISTINCT part_name) AS partitions FROM
        (SELECT table_name, part_name FROM v_audit UNION ALL SELECT table_name, part_name FROM v_parts) GROUP BY 1""",
)
def audit_count(b: Bindings) -> DataFrame:
    return O.audit_count(b.audit, b.parts)


@query(
    "audit_key_schema", "O-46",
    sql="""SELECT DISTINCT table_name, unnest(['dateint', 'status']) AS pkey_name FROM
        (SELECT table_name FROM v_audit UNION SELECT table_name FROM v_parts)""",
)
def audit_key_schema(b: Bindings) -> DataFrame:
    def keys(df: DataFrame) -> DataFrame:
        names = F.explode(F.array(*[F.lit(k) for k in KEYS]))
        return df.select("table_name", names.alias("pkey_name"))

    return O.audit_keys(keys(b.audit), keys(b.parts))


@query(
    "uri_resolve_exact", "O-47",
    sql="""SELECT uri AS wanted_uri, 'partition' AS kind, table_name || '/' || part_name AS name FROM v_parts WHERE status = 'F'
    UNION ALL SELECT uri, 'table', name FROM v_tables WHERE segment = 'building'""",
)
def uri_resolve_exact(b: Bindings) -> DataFrame:
    wanted = b.parts.filter(Q.eq(P.key("status", KEYS), "F")).select("uri")
    wanted = wanted.unionByName(b.tables.filter("segment = 'building'").select("uri"))
    return R.resolve_uris(wanted, b.tables, b.parts).select("wanted_uri", "kind", "name")


@query(
    "uri_resolve_prefix", "O-47",
    sql="""SELECT w.uri AS wanted_uri, 'partition' AS kind, count(*) AS hits, min(table_name || '/' || part_name) AS first_name,
        max(table_name || '/' || part_name) AS last_name
    FROM (SELECT 's3://wh/c' || c_custkey AS uri FROM customer WHERE c_mktsegment = 'BUILDING') w
    JOIN v_parts p ON starts_with(p.uri, w.uri) GROUP BY 1
    UNION ALL SELECT w.uri, 'table', count(*), min(name), max(name)
    FROM (SELECT DISTINCT 's3://wh/' || catalog_name || '/nation_1' AS uri FROM v_tables) w
    JOIN v_tables t ON starts_with(t.uri, w.uri) GROUP BY 1""",
)
def uri_resolve_prefix(b: Bindings) -> DataFrame:
    of_parts = b.table("customer").filter("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("s3://wh/c"), F.col("c_custkey").cast("string")).alias("uri")
    )
    of_tables = b.tables.select(F.concat(F.lit("s3://wh/"), "catalog_name", F.lit("/nation_1")).alias("uri"))
    found = R.resolve_uris(of_parts.unionByName(of_tables), b.tables, b.parts, prefix=True)
    return found.groupBy("wanted_uri", "kind").agg(
        F.count("*").alias("hits"), F.min("name").alias("first_name"), F.max("name").alias("last_name")
    )


@query(
    "url_resolve_prefix", "O-47",
    sql="""WITH wanted AS (SELECT regexp_extract(url, '^https?://[^/]+/..') AS uri FROM pages
        UNION SELECT 's3://wh/c' || substr(table_name, 2, 2) FROM v_parts),
    used AS (SELECT 'table' AS kind, CAST(page_id AS VARCHAR) AS name, url AS uri FROM pages
        UNION ALL SELECT 'partition', table_name || '/' || part_name, uri FROM v_parts)
    SELECT w.uri AS wanted_uri, kind, name, u.uri FROM wanted w JOIN used u ON starts_with(u.uri, w.uri)""",
)
def url_resolve_prefix(b: Bindings) -> DataFrame:
    """Prefixes that end inside a step, over page addresses and partition paths together."""
    pages = b.table("pages").select(F.col("page_id").cast("string").alias("name"), F.col("url").alias("uri"))
    wanted = pages.select(F.regexp_extract("uri", "^https?://[^/]+/..", 0).alias("uri")).unionByName(
        b.parts.select(F.concat(F.lit("s3://wh/c"), F.substring("table_name", 2, 2)).alias("uri"))
    )
    return R.resolve_uris(wanted, pages, b.parts, prefix=True).select("wanted_uri", "kind", "name", "uri")


@query(
    "uri_shared", "O-48",
    sql="""SELECT uri, count(*) AS uses FROM (
        SELECT 's3://wh/day/' || datetext AS uri FROM v_parts UNION ALL SELECT 's3://wh/' || owner FROM v_tables
        UNION ALL SELECT uri FROM v_tables) GROUP BY 1 HAVING count(*) > 1""",
)
def uri_shared(b: Bindings) -> DataFrame:
    days = b.parts.select(F.concat(F.lit("s3://wh/day/"), F.substring("part_name", 9, 8)).alias("uri"))
    owners = b.tables.select(F.concat(F.lit("s3://wh/"), "owner").alias("uri"))
    return R.shared_uris(days.unionByName(owners).unionByName(b.tables.select("uri")))


@query(
    "partition_guard", "O-49",
    sql="SELECT table_name, count(*) AS size FROM v_parts GROUP BY 1 HAVING count(*) > 12",
)
def partition_guard(b: Bindings) -> DataFrame:
    return P.guard_size(b.parts, 12, ["table_name"])


@query(
    "sort_page_limit", "O-50",
    sql="SELECT name, owner FROM v_tables ORDER BY owner DESC, name LIMIT 200 OFFSET 100",
)
def sort_page_limit(b: Bindings) -> DataFrame:
    t = b.tables.select("name", "owner")
    return P.sort_page(t, [F.col("owner").desc()], ["name"], offset=100, limit=200)


@query(
    "sort_page_rest", "O-50",
    sql="SELECT name, owner FROM v_tables ORDER BY owner, name LIMIT ALL OFFSET 100",
)
def sort_page_rest(b: Bindings) -> DataFrame:
    return P.sort_page(b.tables.select("name", "owner"), [F.col("owner")], ["name"], offset=100)


@query(
    "sort_page_ties", "O-50",
    sql="""SELECT owner, segment FROM (SELECT CASE WHEN segment = 'building' THEN NULL ELSE owner END AS owner, segment FROM v_tables)
    ORDER BY owner NULLS FIRST, segment LIMIT ALL OFFSET 40""",
)
def sort_page_ties(b: Bindings) -> DataFrame:
    owner = F.when(F.col("segment") != "building", F.col("owner"))
    return P.sort_page(b.tables.select(owner.alias("owner"), "segment"), [], ["owner"], offset=40)


@query(
    "table_list", "O-51",
    sql="SELECT name FROM v_tables WHERE starts_with(name, 'asia/') AND table_name LIKE '%1%' ORDER BY name DESC LIMIT 40 OFFSET 5",
)
def table_list(b: Bindings) -> DataFrame:
    return T.list_tables(b.tables, "asia/", like="%1%", descending=True, offset=5, limit=40)


@query(
    "database_list", "O-51",
    sql="""SELECT catalog_name, database_name, count(*) AS tables, min(table_name) AS first_table, max(table_name) AS last_table
    FROM v_tables GROUP BY 1, 2""",
)
def database_list(b: Bindings) -> DataFrame:
    return T.list_databases(b.tables)


@query(
    "partition_partial_spec", "O-110",
    sql="SELECT part_id, 'status' AS spec FROM v_parts WHERE status = 'O' UNION ALL SELECT part_id, 'date' FROM v_parts WHERE dateint = 19970303",
)
def partition_partial_spec(b: Bindings) -> DataFrame:
    by_status = P.match_partial_spec(b.parts, KEYS, ["", "O"])
    by_date = P.match_partial_spec(b.parts, KEYS, ["19970303"])
    return by_status.select("part_id", F.lit("status").alias("spec")).unionByName(
        by_date.select("part_id", F.lit("date").alias("spec"))
    )


@query(
    "table_list_pattern", "O-111",
    sql="SELECT name FROM v_tables WHERE regexp_full_match(table_name, 'customer.*[05]')",
)
def table_list_pattern(b: Bindings) -> DataFrame:
    return T.list_by_pattern(b.tables, "CUSTOMER*[05]", "table_name").select("name")


@query(
    "partition_count_stats", "O-109",
    sql="""SELECT count(*) AS tables, CAST(sum(n) AS BIGINT) AS partitions, min(n) AS fewest, max(n) AS most,
        quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95
    FROM (SELECT count(*) AS n FROM v_parts GROUP BY table_name)""",
)
def partition_count_stats(b: Bindings) -> DataFrame:
    return P.partition_count_stats(b.parts)
