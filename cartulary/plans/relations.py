"""Parent and child tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..operators import relations as R
from .bindings import Bindings
from .registry import query


def _children(b: Bindings, condition: str) -> DataFrame:
    return b.tables.filter(condition).select(F.concat(F.lit("geo/customer/"), "table_name").alias("name"))


def _parents(b: Bindings) -> DataFrame:
    return b.tables.select(F.concat_ws("/", F.lit("geo"), "catalog_name", "database_name").alias("name")).distinct()


@query(
    "relation_parents", "O-76",
    sql="""SELECT child, parent, parent_uuid, relation_type FROM v_edges
    WHERE child IN (SELECT 'geo/customer/' || table_name FROM v_tables WHERE segment = 'building')""",
)
def relation_parents(b: Bindings) -> DataFrame:
    found = R.parents_of(b.edges, _children(b, "segment = 'building'"))
    return found.select("child", "parent", "parent_uuid", "relation_type")


@query(
    "relation_children", "O-76",
    sql="SELECT parent, child, child_uuid, relation_type FROM v_edges WHERE parent LIKE 'geo/asia/%'",
)
def relation_children(b: Bindings) -> DataFrame:
    found = R.children_of(b.edges, _parents(b).filter(F.col("name").startswith("geo/asia/")))
    return found.select("parent", "child", "child_uuid", "relation_type")


@query(
    "relation_flags", "O-77",
    sql="""SELECT name, name IN (SELECT parent FROM v_edges) AS is_parent, name IN (SELECT child FROM v_edges) AS is_child FROM (
        SELECT 'geo/customer/' || table_name AS name FROM v_tables UNION SELECT 'geo/' || catalog_name || '/' || database_name FROM v_tables
        UNION SELECT name FROM v_tables)""",
)
def relation_flags(b: Bindings) -> DataFrame:
    names = _children(b, "true").unionByName(_parents(b)).unionByName(b.tables.select("name")).distinct()
    return R.relation_flags(names, b.edges)


@query(
    "relation_children_per_type", "O-78",
    sql="SELECT parent, relation_type, count(*) AS children FROM v_edges GROUP BY 1, 2",
)
def relation_children_per_type(b: Bindings) -> DataFrame:
    return R.children_per_type(b.edges)


_LIMITS = """
    pairs AS (SELECT DISTINCT parent, relation_type FROM v_edges),
    limited AS (SELECT parent, relation_type, CAST(CASE
        WHEN parent LIKE '%/nation_1_' AND relation_type = 'building' THEN 3
        WHEN parent LIKE 'geo/asia/%' AND relation_type IN ('building', 'machinery') THEN -1
        WHEN relation_type = 'furniture' THEN 12 ELSE 5 END AS BIGINT) AS max_children FROM pairs)"""


def _limits(b: Bindings) -> DataFrame:
    pairs = b.edges.select("parent", "relation_type").distinct()
    table = pairs.filter("parent LIKE '%/nation_1_' AND relation_type = 'building'").withColumn("max", F.lit(3))
    database = pairs.filter("parent LIKE 'geo/asia/%' AND relation_type IN ('building', 'machinery')").select(
        F.split("parent", "/")[1].alias("database_name"), "relation_type", F.lit(-1).alias("max")
    ).distinct()
    kind = pairs.filter("relation_type = 'furniture'").select("relation_type", F.lit(12).alias("max")).distinct()
    return R.effective_limit(pairs, table, database, kind)


@query(
    "relation_limits", "O-79",
    sql=f"WITH {_LIMITS} SELECT parent, relation_type, max_children FROM limited",
)
def relation_limits(b: Bindings) -> DataFrame:
    return _limits(b)


@query(
    "relation_validate", "O-80",
    sql=f"""WITH {_LIMITS}, counted AS (SELECT parent, relation_type, count(*) AS n FROM v_edges GROUP BY 1, 2),
    proposed AS (SELECT parent, parent_uuid || CASE WHEN relation_type = 'household' THEN '-x' ELSE '' END AS parent_uuid,
        CASE relation_type WHEN 'automobile' THEN child ELSE child || '_new' END AS child, child_uuid, relation_type FROM v_edges)
    SELECT p.parent, p.child, relation_type, CASE WHEN relation_type = 'automobile' THEN 'child already has a parent'
        WHEN relation_type = 'household' THEN 'parent uuid differs'
        WHEN max_children >= 0 AND n >= max_children THEN 'too many children' END AS reason
    FROM proposed p JOIN limited USING (parent, relation_type) JOIN counted USING (parent, relation_type)
    UNION ALL SELECT child, parent || '_x', relation_type, 'parent is itself a child' FROM v_edges
    UNION ALL SELECT 'other/' || parent, parent, relation_type, 'child already has children' FROM v_edges""",
)
def relation_validate(b: Bindings) -> DataFrame:
    e, kind = b.edges, F.col("relation_type")
    proposed = e.select(
        "parent",
        F.concat("parent_uuid", F.when(kind == "household", "-x").otherwise("")).alias("parent_uuid"),
        F.when(kind == "automobile", F.col("child")).otherwise(F.concat("child", F.lit("_new"))).alias("child"),
        "child_uuid",
        "relation_type",
    )
    below_child = e.select(
        F.col("child").alias("parent"), F.col("child_uuid").alias("parent_uuid"),
        F.concat("parent", F.lit("_x")).alias("child"), F.col("parent_uuid").alias("child_uuid"), "relation_type",
    )
    above_parent = e.select(
        F.concat(F.lit("other/"), "parent").alias("parent"), F.col("child_uuid").alias("parent_uuid"),
        F.col("parent").alias("child"), F.col("parent_uuid").alias("child_uuid"), "relation_type",
    )
    every = proposed.unionByName(below_child).unionByName(above_parent)
    return R.validate_new_edges(e, every, _limits(b)).select("parent", "child", "relation_type", "reason")


_BATCH = """
    batch AS (SELECT custkey AS seq, database_name AS grp, segment AS relation_type,
            database_name || '/p' || (custkey * 31 % 7) AS parent,
            'u' || (custkey * 31 % 7) || CASE WHEN custkey % 11 = 0 THEN '-x' ELSE '' END AS parent_uuid,
            database_name || CASE WHEN custkey % 5 = 0 THEN '/p' || (custkey * 13 % 9) ELSE '/c' || (custkey * 17 % 43) END AS child,
            'c' || custkey AS child_uuid,
            CASE segment WHEN 'building' THEN 2 WHEN 'machinery' THEN -1 ELSE 5 END AS max_children FROM v_tables),
    stored AS (SELECT grp, parent, 'u' || (seq * 31 % 7) AS parent_uuid, grp || '/s' || seq AS child, relation_type FROM batch
        WHERE seq % 40 = 3)"""


@query(
    "relation_validate_batch", "O-80",
    sql=f"""SELECT seq, parent, child, reason FROM (WITH RECURSIVE {_BATCH},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY seq) AS step FROM batch),
    walk AS (SELECT g.grp, 0 AS step, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS reason,
            coalesce(s.taken, []) AS taken
        FROM (SELECT DISTINCT grp FROM batch) g LEFT JOIN
            (SELECT grp, list({{'p': parent, 'u': parent_uuid, 'c': child, 't': relation_type}}) AS taken FROM stored GROUP BY grp) s USING (grp)
        UNION ALL
        SELECT grp, step, seq, reason, CASE WHEN reason IS NULL
            THEN list_append(taken, {{'p': parent, 'u': parent_uuid, 'c': child, 't': relation_type}}) ELSE taken END
        FROM (SELECT n.grp, n.step, n.seq, n.parent, n.parent_uuid, n.child, n.relation_type, w.taken, CASE
            WHEN list_contains(list_transform(w.taken, lambda x: x.c), n.child) THEN 'child already has a parent'
            WHEN list_contains(list_transform(w.taken, lambda x: x.c), n.parent) THEN 'parent is itself a child'
            WHEN list_contains(list_transform(w.taken, lambda x: x.p), n.child) THEN 'child already has children'
            WHEN len(list_filter(w.taken, lambda x: x.p = n.parent AND x.u <> n.parent_uuid)) > 0 THEN 'parent uuid differs'
            WHEN n.max_children >= 0 AND len(list_filter(w.taken, lambda x: x.p = n.parent AND x.t = n.relation_type)) >= n.max_children
                THEN 'too many children' END AS reason
            FROM walk w JOIN numbered n ON n.grp = w.grp AND n.step = w.step + 1))
    SELECT w.seq, n.parent, n.child, w.reason FROM walk w JOIN numbered n ON n.seq = w.seq)""",
)
def relation_validate_batch(b: Bindings) -> DataFrame:
    """Edges proposed in turn, judged against stored ones and against those accepted before."""
    k, db, kind = F.col("custkey"), F.col("database_name"), F.col("segment")
    number = (k * 31 % 7).cast("string")
    upper = F.concat(F.lit("/p"), (k * 13 % 9).cast("string"))
    batch = b.tables.select(
        k.alias("seq"),
        F.concat(db, F.lit("/p"), number).alias("parent"),
        F.concat(F.lit("u"), number, F.when(k % 11 == 0, "-x").otherwise("")).alias("parent_uuid"),
        F.concat(db, F.when(k % 5 == 0, upper).otherwise(F.concat(F.lit("/c"), (k * 17 % 43).cast("string")))).alias("child"),
        F.concat(F.lit("c"), k.cast("string")).alias("child_uuid"),
        kind.alias("relation_type"),
    )
    of = F.substring_index("parent", "/", 1)
    stored = batch.filter("seq % 40 = 3").select(
        "parent", "parent_uuid", F.concat(of, F.lit("/s"), F.col("seq").cast("string")).alias("child"), "child_uuid", "relation_type"
    ).withColumn("parent_uuid", F.regexp_replace("parent_uuid", "-x$", ""))
    pairs = batch.select("parent", "relation_type").distinct()
    most = F.when(F.col("relation_type") == "building", 2).when(F.col("relation_type") == "machinery", -1).otherwise(5)
    judged = R.validate_in_turn(stored, batch, pairs.withColumn("max_children", most))
    return judged.select("seq", "parent", "child", "reason")


@query(
    "relation_rename", "O-81",
    sql="""SELECT CASE WHEN parent LIKE 'geo/asia/%' THEN 'moved/' || parent ELSE parent END AS parent,
        CASE WHEN relation_type = 'building' THEN 'moved/' || child ELSE child END AS child, relation_type FROM v_edges""",
)
def relation_rename(b: Bindings) -> DataFrame:
    old = _parents(b).filter(F.col("name").startswith("geo/asia/")).unionByName(_children(b, "segment = 'building'"))
    free = old.select(F.col("name").alias("old"), F.concat(F.lit("moved/"), "name").alias("new"))
    taken = _children(b, "segment = 'machinery'").select(
        F.col("name").alias("old"), F.lower("name").alias("new")
    )
    return R.rename_entity(b.edges, free.unionByName(taken)).select("parent", "child", "relation_type")


@query(
    "relation_drop", "O-81",
    sql="""SELECT parent, child FROM v_edges WHERE parent NOT LIKE 'geo/asia/%' AND relation_type <> 'building'""",
)
def relation_drop(b: Bindings) -> DataFrame:
    gone = _parents(b).filter(F.col("name").startswith("geo/asia/")).unionByName(_children(b, "segment = 'building'"))
    return R.drop_entity(b.edges, gone).select("parent", "child")
