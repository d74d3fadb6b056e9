"""Tags and lookups."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..operators import tags as G
from .bindings import Bindings
from .registry import query

_DESIRED = """
    desired AS (SELECT 'prod/' || lower(p_brand) || '/p' || p_partkey AS name, p_partkey, p_type,
        unnest(CASE WHEN p_type = 'PROMO' THEN [NULL] WHEN p_type = 'SMALL' THEN ['hot', p_type] ELSE ['hot'] END) AS tag
        FROM part WHERE p_size > 20)"""


def _desired(b: Bindings) -> DataFrame:
    p = b.table("part").filter("p_size > 20")
    name = F.concat(F.lit("prod/"), F.lower("p_brand"), F.lit("/p"), F.col("p_partkey").cast("string"))
    wanted = (
        F.when(F.col("p_type") == "PROMO", F.array(F.lit(None).cast("string")))
        .when(F.col("p_type") == "SMALL", F.array(F.lit("hot"), "p_type"))
        .otherwise(F.array(F.lit("hot")))
    )
    return p.select(name.alias("name"), F.explode(wanted).alias("tag"))


@query("tag_vocabulary", "O-67", sql="SELECT DISTINCT tag FROM v_tags")
def tag_vocabulary(b: Bindings) -> DataFrame:
    return G.list_tags(b.tags)


@query(
    "tag_list_tagged", "O-68",
    sql="""SELECT DISTINCT name FROM v_tags WHERE tag IN ('PROMO', 'SMALL') AND name LIKE 'prod/brand#1%'
    EXCEPT SELECT name FROM v_tags WHERE tag IN ('Brand#11', 'Brand#12')""",
)
def tag_list_tagged(b: Bindings) -> DataFrame:
    return G.list_tagged(b.tags, ["PROMO", "SMALL"], ["Brand#11", "Brand#12"], "prod/brand#1%", "table")


@query(
    "tag_list_any", "O-68",
    sql="SELECT DISTINCT name FROM v_tags EXCEPT SELECT name FROM v_tags WHERE tag = 'PROMO'",
)
def tag_list_any(b: Bindings) -> DataFrame:
    return G.list_tagged(b.tags, exclude=["PROMO"])


@query(
    "tag_search", "O-69",
    sql="SELECT DISTINCT name FROM v_tags WHERE starts_with(tag, 'S') AND name LIKE '%/p1%'",
)
def tag_search(b: Bindings) -> DataFrame:
    return G.search_tags(b.tags, "S", "%/p1%")


@query(
    "tag_changes", "O-70",
    sql=f"""WITH {_DESIRED}, wanted AS (SELECT DISTINCT name, tag FROM desired WHERE tag IS NOT NULL),
    touched AS (SELECT DISTINCT name, tag FROM v_tags WHERE name IN (SELECT name FROM desired))
    SELECT name, tag, 'insert' AS change FROM (SELECT * FROM wanted EXCEPT SELECT * FROM touched)
    UNION ALL SELECT name, tag, 'delete' FROM (SELECT * FROM touched EXCEPT SELECT * FROM wanted)""",
)
def tag_changes(b: Bindings) -> DataFrame:
    return G.tag_changes(b.tags, _desired(b))


@query(
    "tag_set", "O-70",
    sql=f"""WITH {_DESIRED} SELECT name, tag FROM v_tags WHERE name NOT IN (SELECT name FROM desired)
    UNION ALL SELECT DISTINCT name, tag FROM desired WHERE tag IS NOT NULL""",
)
def tag_set(b: Bindings) -> DataFrame:
    return G.set_tags(b.tags, _desired(b))


@query(
    "tag_remove", "O-71",
    sql=f"""WITH {_DESIRED} SELECT name, tag FROM v_tags t
    WHERE name NOT IN (SELECT name FROM desired WHERE tag IS NULL)
      AND NOT EXISTS (SELECT 1 FROM desired d WHERE d.name = t.name AND d.tag = t.tag)""",
)
def tag_remove(b: Bindings) -> DataFrame:
    return G.remove_tags(b.tags, _desired(b))


@query(
    "tag_rename", "O-72",
    sql="""WITH p AS (SELECT *, 'prod/' || lower(p_brand) || '/p' || p_partkey AS name FROM part),
    mapping AS (SELECT a.name AS old, CASE WHEN a.p_type = 'SMALL' THEN b.name ELSE 'moved/' || a.name END AS new
        FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_type IN ('SMALL', 'PROMO'))
    SELECT coalesce(new, name) AS name, tag FROM v_tags LEFT JOIN mapping ON old = name
    WHERE name NOT IN (SELECT new FROM mapping WHERE new NOT IN (SELECT old FROM mapping))""",
)
def tag_rename(b: Bindings) -> DataFrame:
    name = F.concat(F.lit("prod/"), F.lower("p_brand"), F.lit("/p"), F.col("p_partkey").cast("string"))
    p = b.table("part").select("p_partkey", "p_type", name.alias("old"))
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("old").alias("next"))
    moved = F.concat(F.lit("moved/"), "old")
    mapping = (
        p.filter("p_type IN ('SMALL', 'PROMO')")
        .join(following, "p_partkey")
        .select("old", F.when(F.col("p_type") == "SMALL", F.col("next")).otherwise(moved).alias("new"))
    )
    return G.rename_tags(b.tags, mapping)


@query(
    "tag_purge_obsolete", "O-73",
    sql="""SELECT name, tag FROM (SELECT name, tag FROM v_tags UNION ALL SELECT name || '/x=1', tag FROM v_tags)
    WHERE name LIKE '%/x=1' OR name IN (SELECT 'prod/' || lower(p_brand) || '/p' || p_partkey FROM part WHERE p_size > 10)""",
)
def tag_purge_obsolete(b: Bindings) -> DataFrame:
    with_parts = b.tags.unionByName(b.tags.withColumn("name", F.concat("name", F.lit("/x=1"))))
    name = F.concat(F.lit("prod/"), F.lower("p_brand"), F.lit("/p"), F.col("p_partkey").cast("string"))
    live = b.table("part").filter("p_size > 10").select(name.alias("name"))
    return G.purge_obsolete_tags(with_parts, live)


@query(
    "tag_guard", "O-74",
    sql="""SELECT DISTINCT name, operation FROM v_tags JOIN (
        SELECT DISTINCT p_brand AS tag, CASE WHEN p_type = 'PROMO' THEN 'delete' ELSE 'rename' END AS operation
        FROM part WHERE p_size > 48 AND p_type IN ('PROMO', 'SMALL')) USING (tag)
    WHERE name IN (SELECT 'prod/' || lower(p_brand) || '/p' || p_partkey FROM part WHERE p_size > 10)""",
)
def tag_guard(b: Bindings) -> DataFrame:
    part = b.table("part")
    operation = F.when(F.col("p_type") == "PROMO", "delete").otherwise("rename")
    blocked = (
        part.filter("p_size > 48 AND p_type IN ('PROMO', 'SMALL')")
        .select(F.col("p_brand").alias("tag"), operation.alias("operation"))
        .distinct()
    )
    name = F.concat(F.lit("prod/"), F.lower("p_brand"), F.lit("/p"), F.col("p_partkey").cast("string"))
    tables = part.filter("p_size > 10").select(name.alias("name"))
    return G.tag_guard(tables, b.tags, blocked)


_LOOKUPS = "lookups AS (SELECT DISTINCT p_brand AS name, p_type AS value FROM part)"


def _lookups(b: Bindings) -> DataFrame:
    return b.table("part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("value")).distinct()


def _values(b: Bindings) -> DataFrame:
    return b.table("part").filter("p_size > 40").select(
        F.col("p_brand").alias("name"), F.col("p_name").alias("value")
    )


@query(
    "lookup_set", "O-75",
    sql=f"""WITH {_LOOKUPS}, desired AS (SELECT DISTINCT p_brand AS name, p_name AS value FROM part WHERE p_size > 40)
    SELECT name, value FROM lookups WHERE name NOT IN (SELECT name FROM desired) UNION ALL SELECT name, value FROM desired""",
)
def lookup_set(b: Bindings) -> DataFrame:
    return G.set_lookup(_lookups(b), _values(b))


@query(
    "lookup_add", "O-75",
    sql=f"""WITH {_LOOKUPS} SELECT name, value FROM lookups UNION SELECT p_brand, p_name FROM part WHERE p_size > 40""",
)
def lookup_add(b: Bindings) -> DataFrame:
    return G.add_lookup(_lookups(b), _values(b))
