"""Catalog changes as batch jobs."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..functions import predicates as Q
from ..functions.times import epoch_seconds
from ..operators import changes as C
from ..operators import partitions as P
from ..session import keep
from .bindings import KEYS, Bindings
from .registry import query


def _shown(plan: DataFrame) -> DataFrame:
    return plan.select(
        "table_name", "part_name", "uri", epoch_seconds(F.col("create_time")).alias("created"), "action"
    )


_BOTH = """
    both_sides AS (SELECT n.*, p.uri AS old_uri, p.create_time AS old_time, p.part_id AS old_id
        FROM v_new n LEFT JOIN v_parts p ON p.table_name = n.table_name AND p.part_name = n.part_name)"""


def _plan_sql(changed: str, same: str) -> str:
    return f"""WITH {_BOTH}, planned AS (SELECT table_name, part_name,
        CASE WHEN old_id IS NOT NULL AND coalesce(trim(uri), '') = '' THEN old_uri ELSE uri END AS uri, create_time, old_time,
        CASE WHEN old_id IS NULL THEN 'added' WHEN {same} THEN 'unchanged' ELSE '{changed}' END AS action FROM both_sides)
    SELECT table_name, part_name, uri,
        CAST(epoch(CASE WHEN action IN ('altered', 'unchanged') THEN old_time ELSE create_time END) AS BIGINT) AS created, action
    FROM planned
    UNION ALL SELECT table_name, part_name, uri, CAST(epoch(create_time) AS BIGINT), 'deleted' FROM v_parts WHERE dateint < 19960101"""


@query("partition_save_plan_replace", "O-82", sql=_plan_sql("replaced", "uri = old_uri"))
def partition_save_plan_replace(b: Bindings) -> DataFrame:
    return _shown(C.plan_partition_save(b.parts, b.incoming, b.deletes))


@query("partition_save_plan_alter", "O-82", sql=_plan_sql("altered", "uri = old_uri"))
def partition_save_plan_alter(b: Bindings) -> DataFrame:
    return _shown(C.plan_partition_save(b.parts, b.incoming, b.deletes, alter=True))


@query("partition_save_plan_paths", "O-82", sql=_plan_sql("altered", "uri = old_uri OR uri = ''"))
def partition_save_plan_paths(b: Bindings) -> DataFrame:
    incoming = b.incoming.withColumn("uri", F.nullif("uri", F.lit("")))
    return _shown(C.plan_partition_save(b.parts, incoming, b.deletes, path_only=True))


@query(
    "partition_save_plan_unchecked", "O-82",
    sql="""SELECT table_name, part_name, uri, CAST(epoch(create_time) AS BIGINT) AS created, 'added' AS action FROM v_new""",
)
def partition_save_plan_unchecked(b: Bindings) -> DataFrame:
    return _shown(C.plan_partition_save(b.parts, b.incoming, check=False))


@query(
    "partition_save_refused", "O-82",
    sql=f"""WITH {_BOTH}
    SELECT table_name, part_name, CASE WHEN table_name LIKE '%1' THEN 'refused: named more than once' WHEN old_id IS NULL THEN 'added'
        WHEN uri = old_uri THEN 'unchanged' ELSE 'replaced' END AS action FROM both_sides
    UNION ALL SELECT table_name, 'x' || part_name, 'refused: the name does not fit the keys' FROM v_new""",
)
def partition_save_refused(b: Bindings) -> DataFrame:
    again = b.incoming.filter("table_name LIKE '%1'").withColumn("uri", F.lit("s3://other"))
    misnamed = b.incoming.withColumn("part_name", F.concat(F.lit("x"), "part_name"))
    incoming = b.incoming.unionByName(again).unionByName(misnamed)
    return C.plan_partition_save(b.parts, incoming, keys=KEYS).select("table_name", "part_name", "action")


@query(
    "partition_save_schemas", "O-21", "O-82",
    sql=f"""WITH {_BOTH}
    SELECT table_name, part_name, CASE WHEN CAST(substr(table_name, 2) AS BIGINT) % 3 = 0 THEN 'refused: the name does not fit the keys'
        WHEN old_id IS NULL THEN 'added' WHEN uri = old_uri THEN 'unchanged' ELSE 'replaced' END AS action FROM both_sides""",
)
def partition_save_schemas(b: Bindings) -> DataFrame:
    """A save into tables with different keys: every third one has no key ``status``."""
    kind = F.substring("table_name", 2, 20).cast("bigint") % 3
    tables = b.incoming.select("table_name").distinct()
    second = F.when(kind == 0, "state").otherwise("status")
    schema = tables.select("table_name", F.explode(F.array(F.lit("dateint"), second)).alias("pkey_name"), F.lit("string").alias("pkey_type"))
    return C.plan_partition_save(b.parts, b.incoming, keys=schema).select("table_name", "part_name", "action")


@query(
    "partition_save_apply", "O-83",
    sql=f"""WITH {_BOTH}
    SELECT table_name, part_name, CASE WHEN uri = '' THEN old_uri ELSE uri END AS uri,
        CAST(epoch(CASE WHEN uri = old_uri THEN old_time ELSE create_time END) AS BIGINT) AS created FROM both_sides
    UNION ALL SELECT table_name, part_name, uri, CAST(epoch(create_time) AS BIGINT) FROM v_parts WHERE status = 'P' AND dateint >= 19960101""",
)
def partition_save_apply(b: Bindings) -> DataFrame:
    plan = keep(C.plan_partition_save(b.parts, b.incoming, b.deletes), "plan")
    after = C.apply_partition_save(b.parts, plan)
    return after.select("table_name", "part_name", "uri", epoch_seconds(F.col("create_time")).alias("created"))


@query(
    "partition_delete", "O-84",
    sql="SELECT part_id FROM v_parts WHERE dateint >= 19960101",
)
def partition_delete(b: Bindings) -> DataFrame:
    return P.delete_partitions(b.parts, b.deletes).select("part_id")


@query(
    "mview_snapshot", "O-85",
    sql="""SELECT 'prod_' || table_name || '_daily' AS table_name, part_name, uri FROM v_parts WHERE status = 'O'""",
)
def mview_snapshot(b: Bindings) -> DataFrame:
    copied = C.snapshot_mview(b.parts, "prod", "daily", Q.eq(P.key("status", KEYS), "O"))
    return copied.select("table_name", "part_name", "uri")


@query(
    "mview_merge_partitions", "O-86",
    sql=f"""WITH {_BOTH} SELECT table_name, part_name,
        CASE WHEN uri = '' THEN old_uri ELSE uri END AS uri,
        CASE WHEN old_id IS NOT NULL AND (uri = '' OR uri = old_uri) THEN 'stored' END AS input_format FROM both_sides""",
)
def mview_merge_partitions(b: Bindings) -> DataFrame:
    stored = b.parts.withColumn("input_format", F.lit("stored"))
    incoming = b.incoming.select(
        "table_name", "part_name", F.nullif("uri", F.lit("")).alias("uri"), F.lit(None).cast("string").alias("input_format")
    )
    return C.merge_mview_partitions(stored, incoming)


@query(
    "mview_list", "O-87",
    sql="SELECT name, segment || '_' || table_name AS view_name FROM v_tables WHERE segment = 'building'",
)
def mview_list(b: Bindings) -> DataFrame:
    backing = b.tables.select(
        "name",
        F.when(F.col("segment") == "household", "other").otherwise("views").alias("database_name"),
        F.concat(
            F.when(F.col("segment").isin("building", "household"), "prod_orders_").otherwise("prod_items_"),
            "segment", F.lit("_"), "table_name",
        ).alias("table_name"),
    )
    return C.list_mviews(backing, "views", "prod", "orders").select("name", "view_name")


_COPY = """
    wanted AS (SELECT name AS old, CASE segment WHEN 'building' THEN catalog_name || '/copies/' || table_name
            WHEN 'machinery' THEN 'elsewhere/' || database_name || '/' || table_name
            WHEN 'furniture' THEN name ELSE catalog_name || '/' || database_name || '/' || table_name || '_2' END AS new, segment, owner, catalog_name
        FROM v_tables)"""


def _copied(b: Bindings) -> tuple[DataFrame, DataFrame, DataFrame]:
    segment = F.col("segment")
    new = (
        F.when(segment == "building", F.concat_ws("/", "catalog_name", F.lit("copies"), "table_name"))
        .when(segment == "machinery", F.concat_ws("/", F.lit("elsewhere"), "database_name", "table_name"))
        .when(segment == "furniture", F.col("name"))
        .otherwise(F.concat("name", F.lit("_2")))
    )
    old = F.when(segment == "household", F.concat("name", F.lit("_gone"))).otherwise(F.col("name"))
    return C.copy_tables(b.tables, b.tables.select(old.alias("old"), new.alias("new")))


@query(
    "table_copy", "O-88",
    sql=f"""WITH {_COPY} SELECT new AS name, owner, string_split(new, '/')[2] AS database_name FROM wanted
    WHERE segment NOT IN ('machinery', 'furniture', 'household')""",
)
def table_copy(b: Bindings) -> DataFrame:
    return _copied(b)[0].select("name", "owner", "database_name")


@query(
    "table_copy_problems", "O-88",
    sql=f"""WITH {_COPY} SELECT new, CASE segment WHEN 'machinery' THEN 'different catalog' WHEN 'furniture' THEN 'target exists'
        ELSE 'source missing' END AS problem FROM wanted WHERE segment IN ('machinery', 'furniture', 'household')""",
)
def table_copy_problems(b: Bindings) -> DataFrame:
    return _copied(b)[1].select("new", "problem")


@query(
    "table_copy_databases", "O-88",
    sql=f"WITH {_COPY} SELECT DISTINCT catalog_name, 'copies' AS database_name FROM wanted WHERE segment = 'building'",
)
def table_copy_databases(b: Bindings) -> DataFrame:
    return _copied(b)[2]


@query(
    "table_copy_repeats", "O-88",
    sql="""WITH wanted AS (SELECT name AS old, catalog_name || '/copies/' || owner AS new FROM v_tables),
    counted AS (SELECT *, count(*) OVER (PARTITION BY new) AS n FROM wanted)
    SELECT old, new, CASE WHEN n > 1 THEN 'several copies to one target' ELSE 'copied' END AS outcome FROM counted""",
)
def table_copy_repeats(b: Bindings) -> DataFrame:
    pairs = b.tables.select(F.col("name").alias("old"), F.concat_ws("/", "catalog_name", F.lit("copies"), "owner").alias("new"))
    copied, problems, _ = C.copy_tables(b.tables, pairs.union(pairs))
    done = copied.select(F.col("name").alias("new")).join(pairs, "new").select("old", "new", F.lit("copied").alias("outcome"))
    return done.unionByName(problems.withColumnRenamed("problem", "outcome"))


def _world(b: Bindings) -> tuple[DataFrame, DataFrame]:
    """Tags and edges keyed by the names of the bound tables."""
    t = b.tables
    tags = t.select("name", F.col("segment").alias("tag"))
    edges = t.filter("segment = 'automobile'").select(
        F.col("name").alias("parent"), F.lit("p").alias("parent_uuid"),
        F.concat("name", F.lit("_child")).alias("child"), F.lit("c").alias("child_uuid"), F.lit("clone").alias("relation_type"),
    )
    return tags, edges


@query(
    "table_rename", "O-89",
    sql="""WITH moved AS (SELECT *, CASE WHEN segment IN ('building', 'automobile') THEN name || '_new' ELSE name END AS now FROM v_tables)
    SELECT 'tables' AS store, now AS name FROM moved UNION ALL SELECT 'defs', now FROM moved
    UNION ALL SELECT 'tags', now FROM moved UNION ALL SELECT 'edges', now FROM moved WHERE segment = 'automobile'""",
)
def table_rename(b: Bindings) -> DataFrame:
    tags, edges = _world(b)
    mapping = b.tables.filter("segment IN ('building', 'automobile')").select(
        F.col("name").alias("old"), F.concat("name", F.lit("_new")).alias("new")
    )
    after = C.rename_tables(b.tables, b.defs, tags, edges, mapping)
    return _stacked(after, {"tables": "name", "defs": "name", "tags": "name", "edges": "parent"}, "name")


@query(
    "table_rename_refused", "O-89", "O-81",
    sql="""WITH wanted AS (SELECT name, segment, CASE segment WHEN 'household' THEN name || '_gone' ELSE name END AS old,
        CASE segment WHEN 'automobile' THEN name WHEN 'furniture' THEN catalog_name || '/all/' || owner ELSE name || '_new' END AS new FROM v_tables),
    judged AS (SELECT *, CASE WHEN segment = 'household' THEN 'source missing' WHEN segment = 'machinery' THEN 'guarded by a tag'
        WHEN segment = 'automobile' THEN 'target exists'
        WHEN count(*) OVER (PARTITION BY new) > 1 THEN 'several names for one target' END AS reason FROM wanted),
    moved AS (SELECT t.*, CASE WHEN reason IS NULL THEN new ELSE t.name END AS now FROM v_tables t JOIN judged j ON j.name = t.name)
    SELECT 'refused' AS store, old AS key, new || ': ' || reason AS value FROM judged WHERE reason IS NOT NULL
    UNION ALL SELECT 'tables', now, owner || ' ' || string_split(now, '/')[2] FROM moved
    UNION ALL SELECT 'defs', m.now, d.data FROM moved m JOIN v_defs d ON d.name = m.name
    UNION ALL SELECT 'tags', now, segment FROM moved
    UNION ALL SELECT 'edges', now, name || '_child' FROM moved WHERE segment = 'automobile'""",
)
def table_rename_refused(b: Bindings) -> DataFrame:
    tags, edges = _world(b)
    segment = F.col("segment")
    old = F.when(segment == "household", F.concat("name", F.lit("_gone"))).otherwise(F.col("name"))
    new = (
        F.when(segment == "automobile", F.col("name"))
        .when(segment == "furniture", F.concat_ws("/", "catalog_name", F.lit("all"), "owner"))
        .otherwise(F.concat("name", F.lit("_new")))
    )
    after = C.rename_tables(b.tables, b.defs, tags, edges, b.tables.select(old.alias("old"), new.alias("new")), ["machinery"])
    rows = {
        "refused": ("old", F.concat_ws(": ", "new", "reason")), "tables": ("name", F.concat_ws(" ", "owner", "database_name")),
        "defs": ("name", F.col("data")), "tags": ("name", F.col("tag")), "edges": ("parent", F.col("child")),
    }
    every = [after[k].select(F.lit(k).alias("store"), F.col(c).alias("key"), v.alias("value")) for k, (c, v) in rows.items()]
    return reduce(DataFrame.unionByName, every)


def _stacked(after: dict[str, DataFrame], columns: dict[str, str], name: str) -> DataFrame:
    out = None
    for store, column in columns.items():
        one = after[store].select(F.lit(store).alias("store"), F.col(column).cast("string").alias(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "table_drop", "O-90",
    sql="""WITH kept AS (SELECT * FROM v_tables WHERE segment IN ('automobile', 'machinery', 'household'))
    SELECT 'refused' AS store, name AS key FROM v_tables WHERE segment IN ('automobile', 'machinery')
    UNION ALL SELECT 'tables', name FROM kept UNION ALL SELECT 'defs', name FROM kept UNION ALL SELECT 'tags', name FROM kept
    UNION ALL SELECT 'edges', name FROM kept WHERE segment = 'automobile'
    UNION ALL SELECT 'marks', CAST(id AS VARCHAR) FROM v_data WHERE event_type = 'click' OR uri IN
        (SELECT 's3://wh/' || owner FROM v_tables WHERE segment IN ('building', 'furniture'))""",
)
def table_drop(b: Bindings) -> DataFrame:
    tags, edges = _world(b)
    located = b.tables.withColumn("uri", F.concat(F.lit("s3://wh/"), "owner"))
    marks = b.data.filter("event_type = 'click'").select("id", F.lit("first").alias("created_by"), "date_created")
    names = b.tables.filter("segment <> 'household'").select("name")
    at = F.lit("2024-03-01").cast("timestamp_ntz")
    after = C.drop_tables(located, b.defs, tags, edges, b.data, marks, names, ["machinery"], "me", at)
    keys = {"refused": "name", "tables": "name", "defs": "name", "tags": "name", "edges": "parent", "marks": "id"}
    return _stacked(after, keys, "key")


_CAS = """
    stored AS (SELECT 'u' || id AS name, CASE WHEN event_type = 'view' THEN '' ELSE uri END AS location FROM v_data WHERE event_type <> 'signup'),
    updates AS (SELECT event_id AS seq, 'u' || user_id AS name, CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN 's3://wrong'
            ELSE 's3://wh/u' || user_id END AS previous,
        CASE event_type WHEN 'click' THEN 's3://wh/u' || user_id ELSE 's3://wh/u' || user_id || '/' || event_id END AS new FROM events)"""


def _walk_sql(updates: str, select: str) -> str:
    """Updates judged one after the other: a step of the recursion for each update of a table."""
    return f"""(WITH RECURSIVE {updates}, numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS step FROM updates),
    walk AS (SELECT name, location, 0 AS step, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS status FROM stored
        UNION ALL SELECT w.name, CASE WHEN trim(w.location) <> '' AND w.location <> n.new AND n.previous <> '' AND w.location = n.previous
            THEN n.new ELSE w.location END, n.step, n.seq,
            CASE WHEN trim(w.location) = '' THEN 'stored location empty' WHEN w.location = n.new THEN 'no-op'
            WHEN n.previous = '' THEN 'previous location empty' WHEN w.location <> n.previous THEN 'previous location differs'
            ELSE 'accepted' END FROM walk w JOIN numbered n ON n.name = w.name AND n.step = w.step + 1),
    missing AS (SELECT seq, name, 'table missing' AS status FROM updates WHERE name NOT IN (SELECT name FROM stored))
    {select})"""


_JUDGED = "SELECT seq, name, status FROM walk WHERE step > 0 UNION ALL SELECT seq, name, status FROM missing"
_LEFT = "SELECT name, arg_max(location, step) AS location, count(*) FILTER (status = 'accepted') AS accepted FROM walk GROUP BY name"


def _cas(b: Bindings) -> tuple[DataFrame, DataFrame]:
    stored = b.data.filter("event_type <> 'signup'").select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("uri")).alias("location"),
    )
    kind = F.col("event_type")
    home = F.concat(F.lit("s3://wh/u"), F.col("user_id").cast("string"))
    updates = b.table("events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"),
        F.when(kind == "error", "").when(kind == "view", "s3://wrong").otherwise(home).alias("previous"),
        F.when(kind == "click", home).otherwise(F.concat_ws("/", home, F.col("event_id").cast("string"))).alias("new"),
    )
    return stored, C.cas_metadata_location(stored, updates)


@query("location_compare_and_set", "O-91", sql=f"SELECT seq, name, status FROM {_walk_sql(_CAS, _JUDGED)}")
def location_compare_and_set(b: Bindings) -> DataFrame:
    return _cas(b)[1].select("seq", "name", "status")


@query("location_after_updates", "O-91", sql=f"SELECT name, location FROM {_walk_sql(_CAS, _LEFT)}")
def location_after_updates(b: Bindings) -> DataFrame:
    stored, judged = _cas(b)
    return C.apply_cas(stored, judged)


_MOVES = "event_type IN ('click', 'purchase', 'signup')"
_CHAIN = f"""
    stored AS (SELECT 'u' || id AS name, uri AS location FROM v_data WHERE id % 5 <> 0),
    known AS (SELECT event_id AS seq, user_id, event_type, 's3://wh/u' || user_id AS home,
        max(CASE WHEN {_MOVES} THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM events),
    updates AS (SELECT seq, 'u' || user_id AS name, CASE WHEN event_type = 'error' THEN 's3://wrong' WHEN before IS NULL THEN home
            ELSE home || '/' || before END AS previous,
        CASE WHEN event_type = 'view' AND before IS NULL THEN home WHEN event_type = 'view' THEN home || '/' || before ELSE home || '/' || seq END AS new
        FROM known)"""


@query("location_chain", "O-91", sql=f"SELECT name, location, accepted FROM {_walk_sql(_CHAIN, _LEFT)}")
def location_chain(b: Bindings) -> DataFrame:
    """Updates that each start from where the last one before them has moved the table."""
    stored = b.data.filter("id % 5 <> 0").select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"), F.col("uri").alias("location"))
    earlier = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    home = F.concat(F.lit("s3://wh/u"), F.col("user_id").cast("string"))
    last = F.max(F.when(F.expr(_MOVES), F.col("event_id"))).over(earlier)
    events = b.table("events").select("user_id", "event_type", F.col("event_id").alias("seq"), home.alias("home"), last.alias("before"))
    here = F.concat_ws("/", "home", F.col("before").cast("string"))  # a null is left out
    updates = events.select(
        "seq", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("event_type") == "error", "s3://wrong").otherwise(here).alias("previous"),
        F.when(F.col("event_type") == "view", here).otherwise(F.concat_ws("/", "home", F.col("seq").cast("string"))).alias("new"),
    )
    judged = C.cas_metadata_location(stored, updates)
    counts = judged.groupBy("name").agg(F.count_if(F.col("status") == "accepted").alias("accepted"))
    return C.apply_cas(stored, judged).join(counts, "name", "left").select("name", "location", F.coalesce("accepted", F.lit(0)).alias("accepted"))
