"""Names and name-shaped columns."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions.types import normalize_types
from ..operators import names as N
from ..operators import partitions as parts_ops
from ..operators import tables as tables_ops
from .bindings import KEYS, Bindings
from .registry import query


def _all_names(b: Bindings) -> DataFrame:
    """One name per level for every table: catalog, database, table, view and partition."""
    t = b.tables
    view = F.concat_ws("/", "name", "segment")
    part = F.concat_ws("/", "name", F.concat(F.lit("seg="), F.col("segment"), F.lit("/x=1")))
    database = F.concat_ws("/", "catalog_name", "database_name")
    return t.select(
        F.explode(F.array("catalog_name", database, F.col("name"), view, part)).alias("name")
    ).distinct()


_ALL_NAMES = """
    all_names AS (
        SELECT DISTINCT unnest([catalog_name, catalog_name || '/' || database_name, name, name || '/' || segment,
                                name || '/seg=' || segment || '/x=1']) AS name FROM v_tables)"""


@query(
    "name_parse", "O-13",
    sql=f"""WITH {_ALL_NAMES}, cut AS (SELECT name, string_split(name, '/') AS p FROM all_names)
    SELECT name, p[1] AS catalog_name, coalesce(p[2], '') AS database_name, coalesce(p[3], '') AS table_name,
           CASE WHEN name LIKE '%=%' THEN array_to_string(p[4:], '/') ELSE '' END AS partition_name,
           CASE WHEN name LIKE '%=%' THEN '' ELSE coalesce(p[4], '') END AS view_name,
           CASE WHEN name LIKE '%=%' THEN 'PARTITION' WHEN len(p) = 4 THEN 'MVIEW' WHEN len(p) = 3 THEN 'TABLE'
                WHEN len(p) = 2 THEN 'DATABASE' ELSE 'CATALOG' END AS entity_type
    FROM cut""",
)
def name_parse(b: Bindings) -> DataFrame:
    return N.parse_name(_all_names(b))


@query(
    "name_format", "O-14",
    sql="""SELECT r_name || '/' || n_name || '/' || c_name || '/seg=' || c_mktsegment AS name, c_custkey AS custkey
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def name_format(b: Bindings) -> DataFrame:
    c, n, r = b.table("customer"), b.table("nation"), b.table("region")
    rows = c.join(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = rows.select(
        F.col("c_custkey").alias("custkey"),
        F.col("r_name").alias("catalog_name"),
        F.col("n_name").alias("database_name"),
        F.col("c_name").alias("table_name"),
        F.concat(F.lit("seg="), F.col("c_mktsegment")).alias("partition_name"),
    )
    return N.format_name(parts).select("name", "custkey")


@query(
    "name_standardize", "O-15",
    sql="""WITH raw AS (SELECT p_partkey AS partkey,
        CASE p_type WHEN 'ECONOMY' THEN 'CDE_' || p_brand WHEN 'SMALL' THEN p_brand || 'Druid'
                    WHEN 'MEDIUM' THEN 'snowflake-dse-1' WHEN 'PROMO' THEN '' ELSE p_brand END AS c,
        CASE WHEN p_type = 'LARGE' THEN '' ELSE 'Db ' || p_name END AS d, 'T' || p_name AS t,
        'Part=' || p_brand AS part, p_type FROM part),
    cased AS (SELECT partkey, lower(c) AS c, part, p_type,
        CASE p_type WHEN 'ECONOMY' THEN d WHEN 'SMALL' THEN d WHEN 'MEDIUM' THEN upper(d) ELSE lower(d) END AS d,
        CASE p_type WHEN 'ECONOMY' THEN t WHEN 'SMALL' THEN t WHEN 'MEDIUM' THEN upper(t) ELSE lower(t) END AS t FROM raw)
    SELECT partkey, concat_ws('/', nullif(c, ''), nullif(d, ''), t, part) AS name,
           CASE p_type WHEN 'PROMO' THEN 'catalog missing' WHEN 'LARGE' THEN 'database missing' END AS problem
    FROM cased""",
)
def name_standardize(b: Bindings) -> DataFrame:
    kind = F.col("p_type")
    raw = b.table("part").select(
        F.col("p_partkey").alias("partkey"),
        F.when(kind == "ECONOMY", F.concat(F.lit("CDE_"), "p_brand"))
        .when(kind == "SMALL", F.concat("p_brand", F.lit("Druid")))
        .when(kind == "MEDIUM", "snowflake-dse-1")
        .when(kind == "PROMO", "  ")
        .otherwise(F.col("p_brand"))
        .alias("catalog_name"),
        F.when(kind == "LARGE", "").otherwise(F.concat(F.lit(" Db "), "p_name")).alias("database_name"),
        F.concat(F.lit("T"), "p_name", F.lit(" ")).alias("table_name"),
        F.concat(F.lit("Part="), "p_brand").alias("partition_name"),
    )
    return N.standardize_name(raw, upper_catalogs=True).select("partkey", "name", "problem")


@query(
    "name_entity_types", "O-16",
    sql=f"""WITH {_ALL_NAMES}
    SELECT CASE WHEN name LIKE '%=%' THEN 'PARTITION' WHEN n = 3 THEN 'MVIEW' WHEN n = 2 THEN 'TABLE'
                WHEN n = 1 THEN 'DATABASE' ELSE 'CATALOG' END AS entity_type, count(*) AS names
    FROM (SELECT name, length(name) - length(replace(name, '/', '')) AS n FROM all_names) GROUP BY 1""",
)
def name_entity_types(b: Bindings) -> DataFrame:
    return N.with_entity_type(_all_names(b)).groupBy("entity_type").agg(F.count("*").alias("names"))


@query(
    "name_match_wildcard", "O-17",
    sql="""SELECT 'listing' AS mode, name FROM v_tables WHERE name LIKE '%/nation_1%'
    UNION ALL SELECT 'levels', name FROM v_tables WHERE name LIKE 'asia/%/%'""",
)
def name_match_wildcard(b: Bindings) -> DataFrame:
    t = b.tables
    listing = N.match_names(t, database="nation_1")
    levels = N.match_names(t, catalog="asia", all_levels=True)
    return listing.select(F.lit("listing").alias("mode"), "name").unionByName(
        levels.select(F.lit("levels").alias("mode"), "name")
    )


@query(
    "name_prefix", "O-18",
    sql="SELECT table_name, part_name FROM v_parts WHERE starts_with(part_name, 'dateint=1997')",
)
def name_prefix(b: Bindings) -> DataFrame:
    return N.starts_with_name(b.parts, "dateint=1997", "part_name").select("table_name", "part_name")


@query(
    "name_to_json", "O-19",
    sql=f"""WITH {_ALL_NAMES}, cut AS (SELECT name, string_split(name, '/') AS p FROM all_names)
    SELECT name, p[1] AS c, p[2] AS d, p[3] AS t,
           CASE WHEN name LIKE '%=%' THEN array_to_string(p[4:], '/') END AS part,
           CASE WHEN name LIKE '%=%' THEN NULL ELSE p[4] END AS v, name AS q FROM cut""",
)
def name_to_json(b: Bindings) -> DataFrame:
    doc = N.name_to_map(_all_names(b))
    members = {"c": "catalogName", "d": "databaseName", "t": "tableName", "part": "partitionName", "v": "viewName", "q": "qualifiedName"}
    return doc.select("name", *[F.get_json_object("name_json", f"$.{m}").alias(a) for a, m in members.items()])


@query(
    "name_from_json", "O-19",
    sql=f"""WITH {_ALL_NAMES} SELECT name, name AS again FROM all_names""",
)
def name_from_json(b: Bindings) -> DataFrame:
    read = N.name_from_json(N.name_to_map(_all_names(b)))
    return N.format_name(read.withColumnRenamed("name", "original")).select(
        F.col("original").alias("name"), F.col("name").alias("again")
    )


@query(
    "partition_parse_keys", "O-20",
    sql="""SELECT part_id, 'dateint=' || datetext || ',status=' || coalesce(status, '<null>') || ',v=a=b' AS keys FROM v_parts""",
)
def partition_parse_keys(b: Bindings) -> DataFrame:
    # noise the parser must drop or override: plain folders, repeated keys, the text null
    noisy = b.parts.withColumn(
        "part_name", F.concat(F.lit("/junk/v=x/status=old/null=1/gone=NULL/"), "part_name", F.lit("/v=a=b"))
    )
    entries = F.array_sort(F.map_entries(F.col("keys")))
    shown = F.transform(
        entries, lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("<null>")))
    )
    return parts_ops.parse_partition_name(noisy).select("part_id", F.array_join(shown, ",").alias("keys"))


@query(
    "partition_invalid_names", "O-21",
    sql="""SELECT o_orderkey AS orderkey FROM orders WHERE o_orderpriority NOT LIKE '5%'""",
)
def partition_invalid_names(b: Bindings) -> DataFrame:
    urgency = F.substring("o_orderpriority", 1, 1)
    tail = (
        F.when(urgency == "1", "status=")
        .when(urgency == "2", "state=F")
        .when(urgency == "3", "status=Null")
        .when(urgency == "4", "status=a=b")
        .otherwise("status=F")
    )
    names = b.table("orders").select(
        F.col("o_orderkey").alias("orderkey"),
        F.concat(F.lit("dateint="), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("/"), tail).alias("part_name"),
    )
    return parts_ops.invalid_names(names, KEYS).select("orderkey")


@query(
    "partition_make_name", "O-22",
    sql="""SELECT page_id, 'page%23=' || replace(replace(replace(replace(replace(replace(url,
        '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '#', '%23')
        || '/top=' || CASE WHEN url LIKE '%#top' THEN 'yes' ELSE '__HIVE_DEFAULT_PARTITION__' END AS part_name
    FROM pages""",
)
def partition_make_name(b: Bindings) -> DataFrame:
    rows = b.table("pages").withColumn("top", F.when(F.col("url").endswith("#top"), "yes"))
    return parts_ops.make_partition_name(rows, {"page#": "url", "top": "top"}).select("page_id", "part_name")


@query(
    "partition_default_location", "O-23",
    sql="""SELECT part_id, CASE WHEN status = 'F' THEN uri ELSE 's3://wh/' || table_name || '/' || part_name END AS uri
    FROM v_parts""",
)
def partition_default_location(b: Bindings) -> DataFrame:
    name = F.col("part_name")
    given = b.parts.withColumns(
        {
            "uri": F.when(name.endswith("status=F"), F.col("uri")).when(name.endswith("status=O"), " "),
            "location": F.concat(F.lit("s3://wh/"), "table_name", F.lit("/")),
        }
    )
    return parts_ops.default_location(given).select("part_id", "uri")


@query(
    "partition_inherit_storage", "O-24",
    sql="""SELECT part_id, CASE WHEN status = 'F' THEN 'own' ELSE 'table-' || c_mktsegment END AS input_format,
        CASE WHEN status = 'O' THEN 'own=1' ELSE 'segment=' || c_mktsegment END AS params
    FROM v_parts JOIN customer ON table_name = 'c' || c_custkey""",
)
def partition_inherit_storage(b: Bindings) -> DataFrame:
    name = F.col("part_name")
    given = b.parts.select(
        "part_id", "table_name", "part_name",
        F.when(name.endswith("status=F"), "own").when(name.endswith("status=O"), "").alias("input_format"),
        F.when(name.endswith("status=O"), F.create_map(F.lit("own"), F.lit("1"))).alias("params"),
    )
    tables = b.table("customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("table_name"),
        F.concat(F.lit("table-"), "c_mktsegment").alias("input_format"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("params"),
    )
    entries = F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return parts_ops.inherit_storage(given, tables).select(
        "part_id", "input_format", F.array_join(entries, ",").alias("params")
    )


@query(
    "params_pivot", "O-25",
    sql="""SELECT id, string_agg(key || '=' || value, ',' ORDER BY key) AS params FROM (
        SELECT user_id AS id, event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def params_pivot(b: Bindings) -> DataFrame:
    rows = b.table("events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("key"), F.col("props").alias("value"), "event_id"
    )
    entries = F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return parts_ops.pivot_params(rows, "id", "event_id").select(
        "id", F.array_join(F.array_sort(entries), ",").alias("params")
    )


@query(
    "table_partition_keys", "O-26",
    sql="""SELECT name, CASE segment WHEN 'building' THEN '' WHEN 'machinery' THEN 'dateint' ELSE 'dateint,hour' END AS partition_keys
    FROM v_tables""",
)
def table_partition_keys(b: Bindings) -> DataFrame:
    def field(name: str, marked: F.Column) -> F.Column:
        return F.struct(F.lit(name).alias("name"), marked.alias("partition_key"))

    segment = F.col("segment")
    fields = F.array(
        field("id", F.lit(False)),
        field("dateint", segment != "building"),
        field("value", F.lit(False)),
        field("hour", ~segment.isin("building", "machinery")),
    )
    return tables_ops.partition_keys_of(b.tables.withColumn("fields", fields)).select(
        "name", F.array_join("partition_keys", ",").alias("partition_keys")
    )


@query(
    "table_is_external", "O-27",
    sql="""SELECT name, segment NOT IN ('building', 'machinery') AS external FROM v_tables""",
)
def table_is_external(b: Bindings) -> DataFrame:
    uri = F.when(F.col("segment") == "building", "").when(F.col("segment") != "machinery", F.col("uri"))
    return b.tables.select("name", tables_ops.is_external(uri).alias("external"))


@query(
    "types_normalize", "O-28",
    sql="""SELECT p_partkey AS partkey,
        CASE p_type WHEN 'ECONOMY' THEN 'varchar(' || p_size || ')' WHEN 'SMALL' THEN 'array<decimal(' || p_size || ',2)>'
             WHEN 'MEDIUM' THEN 'timestamp with time zone' WHEN 'PROMO' THEN 'varchar(256)'
             WHEN 'LARGE' THEN 'array<row<a:decimal(' || p_size || ',1)>>' ELSE 'unknown' END AS canonical_type,
        CASE p_type WHEN 'ECONOMY' THEN 'varchar(' || p_size || ')' WHEN 'SMALL' THEN CASE WHEN p_size > 38 THEN 'array<string>' ELSE 'array<decimal(' || greatest(p_size, 2) || ',2)>' END
             WHEN 'MEDIUM' THEN 'timestamp' WHEN 'PROMO' THEN 'varchar(256)'
             WHEN 'LARGE' THEN 'array<struct<a:' || CASE WHEN p_size > 38 THEN 'string' ELSE 'decimal(' || p_size || ',1)' END || '>>' ELSE 'string' END AS spark_type
    FROM part""",
)
def types_normalize(b: Bindings) -> DataFrame:
    size = F.col("p_size").cast("string")
    kind = F.col("p_type")
    dialect = (
        F.when(kind == "SMALL", "postgresql")
        .when(kind == "MEDIUM", "snowflake")
        .when(kind == "PROMO", "redshift")
        .when(kind == "LARGE", "hive")
        .otherwise("mysql")
    )
    declared = (
        F.when(kind == "ECONOMY", F.concat(F.lit("VARCHAR("), size, F.lit(")")))
        .when(kind == "SMALL", F.concat(F.lit("numeric("), size, F.lit(", 2)[]")))
        .when(kind == "MEDIUM", "TIMESTAMP_TZ")
        .when(kind == "PROMO", "text")
        .when(kind == "LARGE", F.concat(F.lit("array<struct<a:decimal("), size, F.lit(", 1)>>")))
        .otherwise("geometry")
    )
    columns = b.table("part").select(
        F.col("p_partkey").alias("partkey"), dialect.alias("dialect"), declared.alias("source_type")
    )
    return normalize_types(columns).select("partkey", "canonical_type", "spark_type")


# Nested declarations, what they become, and the Spark type that holds it.
_NESTED = [
    ("pig", "map[]", "map<string,unknown>", "map<string,string>"),
    ("pig", "map[chararray]", "map<string,string>", "map<string,string>"),
    ("pig", "{(one: chararray)}", "array<row<one:string>>", "array<struct<one:string>>"),
    ("pig", "(a: int, b: chararray)", "row<a:int,b:string>", "struct<a:int,b:string>"),
    ("pig", "{(array_element: long)}", "array<bigint>", "array<bigint>"),
    ("pig", "bag{t: tuple(k: chararray, v: map[{(n: double)}])}", "array<row<k:string,v:map<string,array<row<n:double>>>>>",
     "array<struct<k:string,v:map<string,array<struct<n:double>>>>>"),
    ("pig", "{int", "unknown", "string"),
    ("postgresql", "timestamptz[]", "array<timestamp with time zone>", "array<timestamp>"),
    ("postgresql", "timetz", "time with time zone", "string"),
    ("redshift", "timestamptz", "timestamp with time zone", "timestamp"),
]


def _case(column: int) -> str:
    return "CASE " + " ".join(f"WHEN p_partkey % {len(_NESTED)} = {i} THEN '{row[column]}'" for i, row in enumerate(_NESTED)) + " END"


@query(
    "types_normalize_nested", "O-28",
    sql=f"SELECT p_partkey AS partkey, {_case(2)} AS canonical_type, {_case(3)} AS spark_type FROM part",
)
def types_normalize_nested(b: Bindings) -> DataFrame:
    kind = F.col("p_partkey") % len(_NESTED)
    columns = b.table("part").select(
        F.col("p_partkey").alias("partkey"),
        *[F.coalesce(*[F.when(kind == i, row[k]) for i, row in enumerate(_NESTED)]).alias(c) for k, c in enumerate(("dialect", "source_type"))],
    )
    return normalize_types(columns).select("partkey", "canonical_type", "spark_type")


@query(
    "partition_values", "O-112",
    sql="""SELECT part_id, datetext || ',' || coalesce(status, '__HIVE_DEFAULT_PARTITION__') AS "values", status FROM v_parts""",
)
def partition_values(b: Bindings) -> DataFrame:
    out = parts_ops.partition_values(b.parts)
    return out.select("part_id", F.array_join("values", ",").alias("values"), F.col("keys")["status"].alias("status"))


@query(
    "partition_bad_characters", "O-113",
    sql="""SELECT page_id FROM pages WHERE NOT regexp_full_match(regexp_extract(url, '//([^/]*)/', 1), '[a-z.]+')
        OR NOT regexp_full_match(regexp_replace(url, '^https?://[^/]*/[a-z]+/', ''), '[a-z.0-9]+')""",
)
def partition_bad_characters(b: Bindings) -> DataFrame:
    # values are what follows the first "=", so the page part may hold one itself
    host = F.regexp_extract("url", "//([^/]*)/", 1)
    rest = F.regexp_replace("url", "^https?://[^/]*/[a-z]+/", "")
    rows = b.table("pages").select(
        "page_id",
        F.concat_ws("/", F.concat(F.lit("host="), host), F.concat(F.lit("page="), F.regexp_replace(rest, "/", "|"))).alias("part_name"),
    )
    return parts_ops.bad_characters(rows, "[a-z.0-9]+").select("page_id")


@query(
    "partition_key_columns", "O-20", "O-34",
    sql="SELECT part_id, datetext AS key_dateint, status AS key_status FROM v_parts",
)
def partition_key_columns(b: Bindings) -> DataFrame:
    return parts_ops.with_key_columns(b.parts, KEYS).select("part_id", "key_dateint", "key_status")


