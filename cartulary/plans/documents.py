"""User metadata documents."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions.documents import text_at
from ..operators import metadata as M
from ..operators import resolve as R
from .bindings import Bindings
from .registry import query


@query(
    "metadata_attach", "O-52",
    sql="""SELECT t.name, d.data AS definition_metadata,
        CASE WHEN t.segment = 'building' THEN '{"rows":1}' ELSE x.data END AS data_metadata
    FROM v_tables t LEFT JOIN v_defs d ON d.name = t.name AND d.segment <> 'household'
    LEFT JOIN v_data x ON x.uri = 's3://wh/' || t.owner AND x.event_type <> 'view'""",
)
def metadata_attach(b: Bindings) -> DataFrame:
    t = b.tables.select(
        "name",
        F.concat(F.lit("s3://wh/"), "owner").alias("uri"),
        F.when(F.col("segment") == "building", '{"rows":1}').alias("metrics"),
    )
    defs = b.defs.filter(~F.col("data").contains('"household"'))
    out = M.attach_metadata(t, defs, b.data.filter("event_type <> 'view'"), metrics="metrics")
    return out.select("name", "definition_metadata", "data_metadata")


@query(
    "metadata_merge_flat", "O-53",
    sql="""SELECT name, CASE WHEN segment IN ('building', 'machinery') THEN id + 1 ELSE id END AS custkey,
        CASE WHEN segment IN ('building', 'machinery') THEN 'yes' END AS seen,
        nullif(json_extract_string(data, '$.owner.team'), '') AS team, segment AS tag
    FROM v_defs WHERE segment <> 'household'
    UNION ALL SELECT name || '_new', id + 1, 'yes', NULL, NULL FROM v_defs WHERE segment = 'household'""",
)
def metadata_merge_flat(b: Bindings) -> DataFrame:
    base = b.defs.filter(~F.col("data").contains('"household"'))
    t = b.tables.filter("segment IN ('building', 'machinery', 'household')")
    new_name = F.when(F.col("segment") == "household", F.concat("name", F.lit("_new"))).otherwise(F.col("name"))
    patches = t.select(
        new_name.alias("name"),
        F.col("custkey").alias("seq"),
        F.format_string('{"custkey":%d,"seen":"yes"}', F.col("custkey") + 1).alias("patch"),
    )
    merged = M.merge_metadata(base, patches, nested=False)
    return merged.select(
        "name",
        text_at(F.col("data"), "custkey").cast("bigint").alias("custkey"),
        text_at(F.col("data"), "seen").alias("seen"),
        text_at(F.col("data"), "owner", "team").alias("team"),
        F.get_json_object("data", "$.tags[0]").alias("tag"),
    )


@query(
    "metadata_merge_deep", "O-53",
    sql="""WITH k AS (SELECT user_id, max(event_id) AS last_event, max(event_id) FILTER (event_type = 'error') AS reset FROM events GROUP BY 1)
    SELECT 'u' || k.user_id AS name, CAST(json_extract_string(any_value(d.data), '$.k') AS BIGINT) AS k,
        CASE WHEN any_value(last_event) = any_value(reset) THEN 'reset' END AS scalar,
        coalesce(max(event_id) FILTER (event_id > coalesce(reset, -1)), -1) AS n,
        arg_max(json_extract_string(props, '$.k'), event_id) FILTER (events.event_type = 'click' AND event_id > coalesce(reset, -1)) AS click,
        arg_max(json_extract_string(props, '$.k'), event_id) FILTER (events.event_type = 'view' AND event_id > coalesce(reset, -1)) AS view,
        arg_max(json_extract_string(props, '$.k'), event_id) FILTER (events.event_type = 'signup' AND event_id > coalesce(reset, -1)) AS signup,
        max(event_id) FILTER (events.event_type = 'purchase' AND event_id > coalesce(reset, -1)) IS NOT NULL AS bought
    FROM events JOIN k USING (user_id) JOIN v_data d ON d.id = user_id GROUP BY k.user_id""",
)
def metadata_merge_deep(b: Bindings) -> DataFrame:
    name = F.regexp_extract("uri", "[^/]*$", 0)
    base = b.data.select(name.alias("name"), "data")
    k = text_at(F.col("props"), "k")
    patch = (
        F.when(F.col("event_type") == "error", '{"last":"reset"}')
        .when(F.col("event_type") == "purchase", F.format_string('{"last":{"n":%d,"bought":null}}', "event_id"))
        .otherwise(F.format_string('{"last":{"n":%d,"%s":%s}}', F.col("event_id"), F.col("event_type"), k))
    )
    patches = b.table("events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("seq"), patch.alias("patch")
    )
    doc = F.col("data")
    merged = M.merge_metadata(base, patches)
    last = text_at(doc, "last")
    return merged.select(
        "name",
        text_at(doc, "k").cast("bigint").alias("k"),
        F.when(~last.startswith("{"), last).alias("scalar"),
        F.coalesce(text_at(doc, "last", "n").cast("bigint"), F.lit(-1)).alias("n"),
        *[text_at(doc, "last", t).alias(t) for t in ("click", "view", "signup")],
        # a null member is stored, not dropped
        doc.contains('"bought":null').alias("bought"),
    )


@query(
    "metadata_replace", "O-53",
    sql="""SELECT 'u' || user_id AS name, arg_max('{"k":' || json_extract_string(props, '$.k') || '}', event_id) AS data FROM events GROUP BY 1""",
)
def metadata_replace(b: Bindings) -> DataFrame:
    base = b.data.select(F.regexp_extract("uri", "[^/]*$", 0).alias("name"), "data")
    patches = b.table("events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"),
        F.col("event_id").alias("seq"),
        F.format_string('{"k":%s}', text_at(F.col("props"), "k")).alias("patch"),
    )
    return M.merge_metadata(base, patches, merge=False).select("name", "data")


@query(
    "metadata_save_plan", "O-54",
    sql="""SELECT name AS key, 'definition' AS kind, 'update' AS change FROM v_defs WHERE segment = 'building'
    UNION ALL SELECT name || '/x=1', 'partition_definition', 'insert' FROM v_defs WHERE segment = 'building'
    UNION ALL SELECT 's3://wh/u' || user_id, 'data', CASE WHEN event_type = 'view' THEN 'insert' ELSE 'update' END
        FROM (SELECT DISTINCT user_id FROM events) JOIN v_data ON id = user_id""",
)
def metadata_save_plan(b: Bindings) -> DataFrame:
    building = b.defs.filter(F.col("data").contains('"building"')).select("name", "data")
    of_parts = building.withColumn("name", F.concat("name", F.lit("/x=1")))
    empty = b.defs.filter(F.col("data").contains('"machinery"')).select("name", F.lit("{ }").alias("data"))
    plan = M.save_plan(b.defs, building.unionByName(of_parts).unionByName(empty))
    of_data = M.save_plan(b.data.filter("event_type <> 'view'"), b.data.select("uri", "data"), key="uri")
    return plan.withColumnRenamed("name", "key").unionByName(of_data.withColumnRenamed("uri", "key"))


@query(
    "metadata_search", "O-55",
    sql="""SELECT name, data FROM v_defs WHERE segment <> 'machinery' AND name LIKE '%/nation\\_1%' ESCAPE '\\'
    ORDER BY last_updated DESC, name LIMIT 150 OFFSET 10""",
)
def metadata_search(b: Bindings) -> DataFrame:
    found = M.search_metadata(
        b.defs, ["owner", "tags"], "table", r"%/nation\_1%", "last_updated", True, offset=10, limit=150
    )
    return found.select("name", "data")


@query(
    "metadata_by_owner", "O-56",
    sql="""SELECT name FROM v_defs WHERE json_extract_string(data, '$.owner.userId') IN
        (SELECT 'u' || s_nationkey FROM supplier WHERE s_acctbal > 5000)""",
)
def metadata_by_owner(b: Bindings) -> DataFrame:
    owners = b.table("supplier").filter("s_acctbal > 5000").select(
        F.concat(F.lit(" u"), F.col("s_nationkey").cast("string")).alias("owner")
    )
    return M.search_by_owners(b.defs, owners)


@query(
    "metadata_fill_owner", "O-57",
    sql="""SELECT name, CASE WHEN segment IN ('machinery', 'furniture') THEN 'fallback-' || owner ELSE owner END AS user_id,
        CASE WHEN segment NOT IN ('machinery', 'furniture') THEN segment END AS team, id AS custkey FROM v_defs""",
)
def metadata_fill_owner(b: Bindings) -> DataFrame:
    defs = b.defs.join(b.tables.select("name", F.concat(F.lit("fallback-"), "owner").alias("owner")), "name")
    doc = F.col("data")
    return M.fill_owner(defs).select(
        "name",
        text_at(doc, "owner", "userId").alias("user_id"),
        text_at(doc, "owner", "team").alias("team"),
        text_at(doc, "custkey").cast("bigint").alias("custkey"),
    )


@query(
    "owner_choose", "O-58",
    sql="""SELECT name, CASE segment WHEN 'building' THEN owner WHEN 'machinery' THEN 'serde-' || owner WHEN 'furniture' THEN 'root'
            WHEN 'household' THEN 'serde-' || owner ELSE 'caller' END AS chosen_owner,
        CASE WHEN segment <> 'building' THEN segment END AS chosen_group FROM v_tables""",
)
def owner_choose(b: Bindings) -> DataFrame:
    segment = F.col("segment")
    t = b.tables.select(
        "name",
        F.when(segment == "building", F.col("owner")).when(segment == "machinery", "root").when(segment == "furniture", "root").alias("table_owner"),
        F.when(segment == "automobile", "caller").when(segment == "household", " ").alias("request_user"),
        F.when(segment != "furniture", F.concat(F.lit("serde-"), "owner")).alias("serde_owner"),
        F.when(segment == "building", "root").otherwise(segment).alias("owner_group"),
    )
    chosen = M.choose_owner(t, ["table_owner", "request_user", "serde_owner"], ["owner_group"])
    return chosen.select("name", "chosen_owner", "chosen_group")


@query(
    "owner_invalid_report", "O-59",
    sql="""SELECT catalog_name, database_name, segment AS operation, count(*) AS invalid FROM v_tables
    WHERE owner IN ('u1', 'u2', 'u3', 'u4', 'u5', 'u6', 'u7') AND segment <> 'building' GROUP BY 1, 2, 3""",
)
def owner_invalid_report(b: Bindings) -> DataFrame:
    t = b.tables.withColumns(
        {
            "operation": F.col("segment"),
            "owner_group": F.when(F.col("segment") == "building", "data").when(F.col("segment") == "machinery", "root"),
        }
    )
    return M.invalid_owner_report(t, ["catalog_name", "database_name", "operation"], ("root", *[f"u{i}" for i in range(1, 8)]))


@query(
    "descendant_names", "O-60",
    sql="""SELECT catalog_name AS root, name FROM v_tables WHERE catalog_name IN ('asia', 'africa')
    UNION ALL SELECT catalog_name || '/' || database_name, name FROM v_tables WHERE catalog_name = 'europe'""",
)
def descendant_names(b: Bindings) -> DataFrame:
    t = b.tables
    roots = t.filter("catalog_name IN ('asia', 'africa')").select(F.col("catalog_name").alias("root"))
    roots = roots.unionByName(
        t.filter("catalog_name = 'europe'").select(F.concat_ws("/", "catalog_name", "database_name").alias("root"))
    )
    return R.descendant_names(t.select("name"), roots).select("root", "name")


@query(
    "descendant_uris", "O-60",
    sql="""SELECT 's3://wh/' || table_name AS root, uri FROM v_parts JOIN customer ON table_name = 'c' || c_custkey WHERE c_mktsegment = 'BUILDING'""",
)
def descendant_uris(b: Bindings) -> DataFrame:
    roots = b.table("customer").filter("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("s3://wh/c"), F.col("c_custkey").cast("string")).alias("root")
    )
    return R.descendant_uris(b.parts.select("uri"), roots).select("root", "uri")


def _at(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def _marks(b: Bindings, condition: str) -> DataFrame:
    return b.data.filter(condition).select("id", F.lit("first").alias("created_by"), "date_created")


@query(
    "data_soft_delete", "O-61",
    sql="""SELECT id, CASE WHEN event_type = 'click' THEN 'first' ELSE 'second' END AS created_by,
        CASE WHEN event_type = 'click' THEN date_created ELSE TIMESTAMP '2024-03-01' END AS date_created
    FROM v_data WHERE event_type IN ('click', 'error', 'view')""",
)
def data_soft_delete(b: Bindings) -> DataFrame:
    asked = b.data.filter("event_type IN ('click', 'error', 'view')").select("uri")
    return M.soft_delete_data(b.data, _marks(b, "event_type = 'click'"), asked, "second", _at("2024-03-01"))


@query(
    "metadata_delete", "O-62",
    sql="SELECT name AS key FROM v_defs WHERE segment <> 'building' UNION ALL SELECT uri FROM v_data WHERE event_type <> 'view'",
)
def metadata_delete(b: Bindings) -> DataFrame:
    names = b.tables.filter("segment = 'building'").select("name")
    uris = b.data.filter("event_type = 'view'").select("uri")
    defs = M.delete_metadata(b.defs, names, "name").select(F.col("name").alias("key"))
    return defs.unionByName(M.delete_metadata(b.data, uris, "uri").select(F.col("uri").alias("key")))


@query(
    "metadata_delete_stale", "O-63",
    sql="SELECT name FROM v_defs WHERE NOT (name LIKE 'africa/%' AND last_updated < TIMESTAMP '2024-06-01')",
)
def metadata_delete_stale(b: Bindings) -> DataFrame:
    return M.delete_stale(b.defs, "africa/%", _at("2024-06-01")).select("name")


_PURGE = """
    stored AS (SELECT id, uri, event_type AS last_type, NULL AS part_type, date_created FROM v_data
        UNION ALL SELECT user_id * 10 + length(event_type) + 1000000, 's3://wh/u' || user_id || '/type=' || event_type, NULL, event_type, min(ts)
        FROM events GROUP BY user_id, event_type),
    marks AS (SELECT id, date_created FROM stored WHERE last_type = 'click' OR part_type = 'error'),
    marked AS (SELECT uri FROM stored WHERE id IN (SELECT id FROM marks WHERE date_created < TIMESTAMP '2024-01-30 12:00:00')),
    examined AS (SELECT uri FROM marked UNION SELECT s.uri FROM stored s JOIN marked m ON starts_with(s.uri, m.uri || '/') AND NOT contains(m.uri, '=')),
    used AS (SELECT 's3://wh/' || owner AS uri FROM v_tables WHERE segment = 'building'
        UNION SELECT uri FROM stored WHERE part_type = 'view')"""


def _purged(b: Bindings) -> tuple[DataFrame, DataFrame]:
    e = b.table("events")
    user = F.col("user_id").cast("string")
    by_type = e.groupBy("user_id", "event_type").agg(F.min("ts").alias("date_created")).select(
        (F.col("user_id") * 10 + F.length("event_type") + 1000000).alias("id"),
        F.concat(F.lit("s3://wh/u"), user, F.lit("/type="), "event_type").alias("uri"),
        F.lit(None).cast("string").alias("last_type"),
        F.col("event_type").alias("part_type"),
        "date_created",
    )
    stored = b.data.select(
        "id", "uri", F.col("event_type").alias("last_type"), F.lit(None).cast("string").alias("part_type"), "date_created"
    ).unionByName(by_type)
    marks = stored.filter("last_type = 'click' OR part_type = 'error'").select("id", "date_created")
    used = b.tables.filter("segment = 'building'").select(F.concat(F.lit("s3://wh/"), "owner").alias("uri"))
    used = used.unionByName(stored.filter("part_type = 'view'").select("uri"))
    return M.purge_deleted_data(stored, marks, used, _at("2024-01-30 12:00:00"))


@query(
    "data_purge", "O-64",
    sql=f"""WITH {_PURGE} SELECT uri FROM stored WHERE uri NOT IN (SELECT uri FROM examined) OR uri IN (SELECT uri FROM used)""",
)
def data_purge(b: Bindings) -> DataFrame:
    return _purged(b)[0].select("uri")


@query(
    "data_purge_marks", "O-64",
    sql=f"""WITH {_PURGE} SELECT id FROM marks WHERE id NOT IN (SELECT id FROM stored WHERE uri IN (SELECT uri FROM examined))""",
)
def data_purge_marks(b: Bindings) -> DataFrame:
    return _purged(b)[1].select("id")


@query(
    "definitions_purge_obsolete", "O-65",
    sql="""SELECT 'definition' AS store, replace(name, 'africa/', 'rds/') AS name FROM v_defs WHERE segment <> 'household' OR name LIKE 'africa/%'
    UNION ALL SELECT 'tag', replace(name, 'africa/', 'rds/') FROM v_defs WHERE segment <> 'household' OR name LIKE 'africa/%'""",
)
def definitions_purge_obsolete(b: Bindings) -> DataFrame:
    moved = F.regexp_replace("name", "^africa/", "rds/")
    defs = b.defs.withColumn("name", moved)
    live = b.tables.filter("segment <> 'household'").select(moved.alias("name"))
    tags = b.tables.select(moved.alias("name"), F.col("segment").alias("tag"))
    kept_defs, kept_tags = M.purge_obsolete_definitions(defs, tags, live)
    return kept_defs.select(F.lit("definition").alias("store"), "name").unionByName(
        kept_tags.select(F.lit("tag").alias("store"), "name")
    )


@query(
    "metadata_rename", "O-66",
    sql="""WITH mapping AS (SELECT a.name AS old, CASE WHEN a.segment = 'machinery' THEN b.name ELSE a.name || '_r' END AS new
        FROM v_tables a JOIN v_tables b ON b.custkey = a.custkey + 1 WHERE a.segment IN ('machinery', 'building'))
    SELECT id, coalesce(new, name) AS name FROM v_defs LEFT JOIN mapping ON old = name
    WHERE name NOT IN (SELECT new FROM mapping WHERE new NOT IN (SELECT old FROM mapping))""",
)
def metadata_rename(b: Bindings) -> DataFrame:
    t = b.tables
    following = t.select((F.col("custkey") - 1).alias("custkey"), F.col("name").alias("next"))
    mapping = t.filter("segment IN ('machinery', 'building')").join(following, "custkey").select(
        F.col("name").alias("old"),
        F.when(F.col("segment") == "machinery", F.col("next")).otherwise(F.concat("name", F.lit("_r"))).alias("new"),
    )
    return M.rename_keys(b.defs, mapping, "name", replace_target=True).select("id", "name")


@query(
    "data_rename", "O-66",
    sql="SELECT id, CASE WHEN event_type = 'view' THEN uri || '/moved' ELSE uri END AS uri FROM v_data",
)
def data_rename(b: Bindings) -> DataFrame:
    mapping = b.data.filter("event_type = 'view'").select(
        F.col("uri").alias("old"), F.concat("uri", F.lit("/moved")).alias("new")
    )
    return M.rename_keys(b.data, mapping, "uri", replace_target=False).select("id", "uri")
