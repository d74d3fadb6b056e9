"""Partition-key predicates."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions import predicates as Q
from ..functions.times import epoch_seconds
from ..operators import partitions as P
from ..operators import tables as T
from ..sources.metastore import partition_metrics
from .bindings import KEYS, Bindings
from .registry import query


def _flags(df: DataFrame, **conditions: F.Column) -> DataFrame:
    return df.select("part_id", *[c.alias(n) for n, c in conditions.items()])



@query(
    "predicate_compare", "O-29",
    sql="""SELECT part_id, dateint = 19970303 AS eq_number, datetext = '19970303' AS eq_text, dateint <> 19970303 AS ne_number,
        coalesce(status = 'F', false) AS eq_status, status IS DISTINCT FROM 'F' AS ne_status,
        coalesce(status < 'P', false) AS lt_status, coalesce(status >= 'O', false) AS ge_status,
        dateint < 1997 AS lt_number, datetext < '1997' AS lt_text, dateint <= 19961231.5 AS le_number, dateint > 19990101 AS gt_number
    FROM v_parts""",
)
def predicate_compare(b: Bindings) -> DataFrame:
    d, s = P.key("dateint", KEYS), P.key("status", KEYS)
    return _flags(
        b.parts,
        eq_number=Q.compare(d, "=", 19970303),
        eq_text=Q.compare(d, "==", "19970303"),
        ne_number=Q.compare(d, "!=", 19970303),
        eq_status=Q.compare(s, "=", "F"),
        ne_status=Q.compare(s, "<>", "F"),
        lt_status=Q.compare(s, "<", "P"),
        ge_status=Q.compare(s, ">=", "O"),
        lt_number=Q.compare(d, "<", 1997),
        lt_text=Q.compare(d, "<", "1997"),
        le_number=Q.compare(d, "<=", 19961231.5),
        gt_number=Q.compare(d, ">", 19990101),
    )


@query(
    "predicate_between", "O-30",
    sql="""SELECT part_id, dateint BETWEEN 19960101 AND 19961231 AS inside, dateint NOT BETWEEN 19960101 AND 19961231 AS outside,
        coalesce(status BETWEEN 'G' AND 'P', false) AS status_inside, NOT coalesce(status BETWEEN 'G' AND 'P', false) AS status_outside
    FROM v_parts""",
)
def predicate_between(b: Bindings) -> DataFrame:
    d, s = P.key("dateint", KEYS), P.key("status", KEYS)
    return _flags(
        b.parts,
        inside=Q.between(d, 19960101, 19961231),
        outside=Q.between(d, 19960101, 19961231, negate=True),
        status_inside=Q.between(s, "G", "P"),
        status_outside=Q.between(s, "G", "P", negate=True),
    )


@query(
    "predicate_in", "O-31",
    sql="""SELECT part_id, dateint IN (19970303, 19970304) AS is_in, dateint NOT IN (19970303, 19970304) AS not_in,
        coalesce(status IN ('F', 'O'), false) AS status_in, NOT coalesce(status IN ('F', 'O'), false) AS status_not_in
    FROM v_parts""",
)
def predicate_in(b: Bindings) -> DataFrame:
    d, s = P.key("dateint", KEYS), P.key("status", KEYS)
    return _flags(
        b.parts,
        is_in=Q.in_list(d, [19970303, 19970304]),
        not_in=Q.in_list(d, [19970303, 19970304], negate=True),
        status_in=Q.in_list(s, ["F", "O"]),
        status_not_in=Q.in_list(s, ["F", "O"], negate=True),
    )


@query(
    "predicate_like", "O-32",
    sql="""SELECT part_id, datetext LIKE '1997%' AS is_like, datetext LIKE '19970_0_' AS one, datetext NOT LIKE '%1' AS is_not,
        regexp_full_match(datetext, '199[678].*') AS bracket, NOT coalesce(status = 'F', false) AS status_not
    FROM v_parts""",
)
def predicate_like(b: Bindings) -> DataFrame:
    d, s = P.key("dateint", KEYS), P.key("status", KEYS)
    return _flags(
        b.parts,
        is_like=Q.like(d, "1997%"),
        one=Q.like(d, "19970_0_"),
        is_not=Q.like(d, "%1", negate=True),
        bracket=Q.like(d, "199[678]%"),
        status_not=Q.like(s, "F", negate=True),
    )


@query(
    "predicate_matches", "O-33",
    sql="""SELECT part_id FROM v_parts WHERE regexp_full_match(datetext, '199[78](03|04)\\d{2}') AND regexp_full_match(status, '[FO]')""",
)
def predicate_matches(b: Bindings) -> DataFrame:
    d, s = P.key("dateint", KEYS), P.key("status", KEYS)
    found = b.parts.filter(Q.matches(d, r"199[78](03|04)\d{2}") & Q.matches(s, "[FO]"))
    return found.select("part_id")


@query(
    "predicate_null", "O-34",
    sql="SELECT part_id, status IS NULL AS no_status, status IS NOT NULL AS has_status FROM v_parts",
)
def predicate_null(b: Bindings) -> DataFrame:
    s = P.key("status", KEYS)
    return _flags(b.parts, no_status=Q.is_null(s), has_status=Q.is_null(s, negate=True))


@query(
    "predicate_combine", "O-35",
    sql="""SELECT part_id, dateint > 19970101 AND (status IS DISTINCT FROM 'F' OR datetext LIKE '%01') AS mixed,
        NOT (dateint > 19970101) AND coalesce(status = 'F', false) AS negated, true AS text_less, false AS number_less,
        false AS term, coalesce(datetext < status, false) AS key_key
    FROM v_parts""",
)
def predicate_combine(b: Bindings) -> DataFrame:
    d, s = P.key("dateint", KEYS), P.key("status", KEYS)
    return _flags(
        b.parts,
        mixed=Q.compare(d, ">", 19970101) & (Q.ne(s, "F") | Q.like(d, "%01")),
        negated=~Q.compare(d, ">", 19970101) & Q.eq(s, "F"),
        text_less=Q.compare(12, "<", "2"),
        number_less=Q.compare("12", "<", 2),
        term=Q.truth(s),
        key_key=Q.compare(d, "<", s),
    )


@query(
    "predicate_batchid", "O-36",
    sql="SELECT part_id, CAST(batchid AS VARCHAR) AS batchid FROM v_parts WHERE batchid >= 3",
)
def predicate_batchid(b: Bindings) -> DataFrame:
    found = b.parts.filter(Q.compare(P.batch_id(), ">=", 3))
    return found.select("part_id", P.batch_id().alias("batchid"))


@query(
    "predicate_date_created", "O-37",
    sql="""SELECT part_id, CAST(epoch(create_time) AS BIGINT) AS date_created FROM v_parts
    WHERE epoch(create_time) BETWEEN 852076800 AND 883612799""",
)
def predicate_date_created(b: Bindings) -> DataFrame:
    found = b.parts.filter(P.created(">=", 852076800) & P.created("<=", 883612799))
    return found.select("part_id", P.date_created().alias("date_created"))


@query(
    "predicate_typed_keys", "O-38",
    sql="""SELECT part_id, dateint >= 19970101 AS integral, create_time < TIMESTAMP '1997-06-01' AS by_date,
        create_time >= TIMESTAMP '1997-06-01 12:00:00' AS by_time, coalesce(status = 'F', false) AS by_text,
        create_time <> TIMESTAMP '1997-06-01' AS other_day
    FROM v_parts""",
)
def predicate_typed_keys(b: Bindings) -> DataFrame:
    day = F.concat(F.lit("/day="), F.date_format("create_time", "yyyy-MM-dd"))
    parts = b.parts.withColumn("part_name", F.concat("part_name", day))
    keys = [*KEYS, "day"]
    d = P.key("day", keys)
    return _flags(
        parts,
        integral=Q.typed(P.key("dateint", keys), "integral", ">=", 19970101),
        by_date=Q.typed(d, "date", "<", "1997-06-01"),
        by_time=Q.typed(d, "timestamp", ">=", "1997-06-01 12:00:00"),
        by_text=Q.typed(P.key("status", keys), "string", "=", "F"),
        other_day=Q.typed(d, "date", "!=", "1997-06-01"),
    )


@query(
    "predicate_key_schemas", "O-38",
    sql="""WITH p AS (SELECT *, CAST(substr(table_name, 2) AS BIGINT) % 4 AS kind FROM v_parts)
    SELECT 'number' AS literal, part_id FROM p WHERE kind = 0 AND dateint >= 19970601
    UNION ALL SELECT 'text', part_id FROM p WHERE kind = 1 AND datetext >= '1997-06-01'
    UNION ALL SELECT 'text', part_id FROM p WHERE kind = 2 AND create_time >= TIMESTAMP '1997-06-01'""",
)
def predicate_key_schemas(b: Bindings) -> DataFrame:
    """One key that is a number in some tables, text or a date in others, and not declared in the rest."""
    kind = F.substring("table_name", 2, 20).cast("bigint") % 4
    dated = F.concat(F.lit("dateint="), F.date_format("create_time", "yyyy-MM-dd"))
    parts = b.parts.withColumn("part_name", F.when(kind == 2, dated).otherwise(F.col("part_name")))
    types = F.when(kind == 0, "int").when(kind == 1, "string").otherwise("date")
    schema = parts.select("table_name", F.when(kind == 3, "other").otherwise("dateint").alias("pkey_name"), types.alias("pkey_type")).distinct()
    found = [
        P.filter_typed(parts, schema, "dateint", ">=", literal, strict=False).select(F.lit(name).alias("literal"), "part_id")
        for name, literal in (("number", 19970601), ("text", "1997-06-01"))
    ]
    return found[0].unionByName(found[1])


@query(
    "predicate_native_columns", "O-39",
    sql="""SELECT l_returnflag, l_linestatus, count(*) AS row_count, CAST(epoch(max(l_shipdate)) AS BIGINT) AS newest FROM lineitem
    WHERE l_quantity BETWEEN 10 AND 30 AND (l_returnflag <> 'N' OR l_discount < 0.05)
      AND l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2""",
)
def predicate_native_columns(b: Bindings) -> DataFrame:
    # plain columns compare as they are stored, so the whole filter reaches the scan
    kept = b.table("lineitem").filter(
        F.col("l_quantity").between(10, 30)
        & ((F.col("l_returnflag") != "N") | (F.col("l_discount") < 0.05))
        & (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    )
    return partition_metrics(kept, ["l_returnflag", "l_linestatus"], "l_shipdate", files=False).select(
        "l_returnflag", "l_linestatus", "row_count", epoch_seconds(F.col("newest")).alias("newest")
    )


@query(
    "partition_by_names", "O-40",
    sql="""SELECT part_id FROM v_parts WHERE (table_name, part_name) IN (
        SELECT 'c' || o_custkey, 'dateint=' || strftime(o_orderdate, '%Y%m%d') || '/status=O' FROM orders)""",
)
def partition_by_names(b: Bindings) -> DataFrame:
    wanted = b.table("orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("table_name"),
        F.concat(F.lit("dateint="), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("/status=O")).alias("part_name"),
    )
    return P.filter_by_names(b.parts, wanted).select("part_id")


@query(
    "table_by_params", "O-41",
    sql="""SELECT name FROM v_tables WHERE owner = 'u7' AND segment = 'building' ORDER BY name LIMIT 100""",
)
def table_by_params(b: Bindings) -> DataFrame:
    t = b.tables.withColumn("params", F.create_map(F.lit("type"), F.col("segment")))
    return T.tables_by_params(t, owner="u7", params={"type": "building"}, limit=100).select("name")


@query(
    "predicate_column_types", "O-39",
    sql="""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 2 AND (l_quantity < 10.5 OR l_quantity > 30)
        AND l_returnflag <> 'N' AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'""",
)
def predicate_column_types(b: Bindings) -> DataFrame:
    """Columns of several types, named in any case, and the files' own times in seconds and milliseconds."""
    rows = b.table("lineitem")
    times = {"dateCreated": "l_shipdate", "lastUpdated": "l_shipdate"}
    wanted = (
        Q.column(rows, "L_LineNumber", ">", 2.9)
        & Q.column_between(rows, "l_quantity", 10.5, 30, negate=True)
        & Q.column(rows, "L_RETURNFLAG", "!=", "N")
        & Q.column(rows, "dateCreated", ">=", 820454400, times)
        & Q.column(rows, "lastUpdated", "<", 883612800000, times)
    )
    return rows.filter(wanted).select("l_orderkey", "l_linenumber")
