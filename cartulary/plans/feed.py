"""The change feed, as batches and as streams over the same events."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.types import TimestampNTZType

from ..functions.times import as_instant, epoch_seconds
from ..streaming import feed as E
from ..streaming import streams as S
from .bindings import Bindings
from .registry import query
from .sources import scratch

NOW = 1704931200  # 2024-01-11, a fixed "now" so that reruns agree


_PAYLOADS = """
    defs AS (SELECT id AS table_id, event_type AS shape FROM v_data),
    changes AS (SELECT 'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS update_id, user_id,
        CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS op,
        CASE event_type WHEN 'purchase' THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) WHEN 'signup' THEN strftime(ts, '%Y%m%d')
            WHEN 'view' THEN '0soon' ELSE NULL END AS value,
        CASE event_type WHEN 'purchase' THEN CAST(floor(epoch(ts)) AS BIGINT)
            WHEN 'signup' THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 28800 END AS t, event_id FROM events),
    folded AS (SELECT update_id, 'u' || user_id AS table_name, shape, count(*) FILTER (op = 'add') AS created, count(*) FILTER (op = 'delete') AS deleted,
        max(value) FILTER (op = 'add' AND shape IN ('click', 'signup', 'purchase')) AS any_value,
        max(value) FILTER (op = 'add' AND shape IN ('click', 'signup', 'purchase') AND (CASE WHEN shape <> 'click' AND length(value) = 8 THEN t - 28800 ELSE t END) <= 1704931200) AS past,
        max(value) FILTER (op = 'add' AND shape IN ('click', 'signup', 'purchase') AND t IS NULL) AS bad
        FROM changes JOIN defs ON table_id = user_id GROUP BY 1, 2, 3)
    SELECT update_id, table_name, created, deleted,
        CASE WHEN created > 0 AND past IS NOT NULL AND (bad IS NULL OR past > bad) THEN 'when=' || past END AS latest,
        CASE WHEN created = 0 THEN 'PARTITION_KEY_UNABLED' WHEN shape = 'view' THEN 'MISSING_METADATA_INFO_FOR_PARTITION_KEY'
            WHEN shape = 'error' THEN 'EMPTY_DELETE_COLUMN' WHEN any_value IS NULL THEN 'NO_CANDIDATE_PARTITION_KEYS'
            WHEN past IS NOT NULL AND (bad IS NULL OR past > bad) THEN 'ATTACHED_VALID_PARITITION_KEY'
            WHEN bad IS NOT NULL THEN 'INVALID_PARTITION_KEY_FORMAT' ELSE 'ALL_FUTURE_PARTITION_KEYS' END AS message
    FROM folded"""


def _update_changes(b: Bindings) -> DataFrame:
    kind = F.col("event_type")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    value = (
        F.when(kind == "purchase", epoch_seconds(F.col("ts")).cast("string"))
        .when(kind == "signup", F.date_format("ts", "yyyyMMdd"))
        .when(kind == "view", "0soon")
        .otherwise("__HIVE_DEFAULT_PARTITION__")
    )
    return b.table("events").select(
        F.concat(user, F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("update_id"),
        user.alias("table_name"),
        F.when(kind == "error", "delete").otherwise("add").alias("op"),
        F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit("/when="), value).alias("part_name"),
    )


@query("feed_update_payloads", "O-100", sql=f"WITH {_PAYLOADS}")
def feed_update_payloads(b: Bindings) -> DataFrame:
    shape = F.col("event_type")
    column = F.when(shape == "error", "").otherwise("when")
    dated = F.when(shape == "click", "pacific").otherwise("utc")
    defs = b.data.select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"),
        F.when(shape == "view", "{}")
        .otherwise(
            F.format_string(
                '{"data_hygiene":{"delete_column":"%s"},"data_dependency":{"partition_column_date_type":"%s"}}', column, dated
            )
        )
        .alias("data"),
    )
    return E.partition_update_payloads(_update_changes(b), defs, F.lit(NOW))


@query(
    "feed_update_names", "O-100",
    sql="""SELECT 'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS update_id, 'u' || user_id AS table_name,
        CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS op,
        'id=' || event_id || '/when=' || CASE event_type WHEN 'purchase' THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)
            WHEN 'signup' THEN strftime(ts, '%Y%m%d') WHEN 'view' THEN '0soon' ELSE '__HIVE_DEFAULT_PARTITION__' END AS part_name
    FROM events""",
)
def feed_update_names(b: Bindings) -> DataFrame:
    return E.partition_update_names(_update_changes(b))


@query(
    "feed_partition_time", "O-101",
    sql="""SELECT o_orderkey AS orderkey, CASE o_orderstatus WHEN 'O' THEN CAST(epoch(o_orderdate) AS BIGINT) WHEN 'F' THEN
            CAST(epoch(timezone('America/Los_Angeles', o_orderdate)) AS BIGINT)
            ELSE CASE WHEN o_orderpriority LIKE '1%' THEN -1 ELSE 1000000000 + o_orderkey END END AS seconds FROM orders""",
)
def feed_partition_time(b: Bindings) -> DataFrame:
    status = F.col("o_orderstatus")
    second = (F.lit(1000000000) + F.col("o_orderkey")).cast("string")
    urgency = F.substring("o_orderpriority", 1, 1)
    value = F.when(status.isin("O", "F"), F.date_format("o_orderdate", "yyyyMMdd")).otherwise(
        F.when(urgency == "1", F.concat(second, F.lit("x")))
        .when(urgency == "2", F.concat(second, F.lit("123")))
        .when(urgency == "3", F.concat(second, F.lit(".5")))
        .otherwise(second)
    )
    seconds = E.partition_time(value, status == "F")
    return b.table("orders").select(
        F.col("o_orderkey").alias("orderkey"), F.coalesce(seconds, F.lit(-1)).alias("seconds")
    )


def _index(b: Bindings) -> DataFrame:
    """An index to change: one table per user, one partition per user and kind of event."""
    users = b.data.select(F.concat(F.lit("c/d/u"), F.col("id").cast("string")).alias("name"), F.lit("table").alias("kind"))
    e = b.table("events").select("user_id", "event_type").distinct()
    part = F.concat(F.lit("c/d/u"), F.col("user_id").cast("string"), F.lit("/type="), "event_type")
    parts = e.select(part.alias("name"), F.lit("partition").alias("kind"))
    return users.unionByName(parts).select(
        "name", "kind", F.lit("old").alias("body"), F.lit("admin").alias("user"), F.lit(False).alias("deleted"), F.lit(0).cast("bigint").alias("updated_at")
    )


def _index_changes(events: DataFrame) -> DataFrame:
    """Events as index changes, by kind: signup saves the table, purchase and click a partition of it,
    error deletes the table, view deletes a partition or renames the table away."""
    kind = F.col("event_type")
    table = F.concat(F.lit("c/d/u"), F.col("user_id").cast("string"))
    op = (
        F.when(kind == "signup", "update")
        .when(kind.isin("purchase", "click"), "update")
        .when(kind == "error", "delete")
        .when(F.col("value") > 20, "rename")
        .otherwise("delete")
    )
    name = F.when(
        kind.isin("purchase", "click") | ((kind == "view") & (F.col("value") <= 20)), F.concat(table, F.lit("/type="), F.when(kind == "view", "click").otherwise(kind))
    ).otherwise(table)
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("ts"),
        op.alias("op"),
        F.when(name.contains("="), "partition").otherwise("table").alias("kind"),
        name.alias("name"),
        F.when(op == "rename", F.concat(table, F.lit("_r"))).alias("new_name"),
        F.concat(F.lit("body-"), F.col("event_id").cast("string")).alias("body"),
        F.concat(F.lit("by-"), kind).alias("user"),
    )


_APPLY = """
    docs AS (SELECT 'c/d/u' || id AS name, 'table' AS kind FROM v_data
        UNION ALL SELECT DISTINCT 'c/d/u' || user_id || '/type=' || event_type, 'partition' FROM events),
    base AS (SELECT event_id AS seq, event_type AS k, value, 'c/d/u' || user_id AS t, 'by-' || event_type AS u FROM events),
    steps AS (SELECT seq, t AS name, 'table' AS kind, 'save' AS act, u FROM base WHERE k = 'signup'
        UNION ALL SELECT seq, t || '/type=' || k, 'partition', 'save', u FROM base WHERE k IN ('purchase', 'click')
        UNION ALL SELECT seq, t, 'table', 'delete', u FROM base WHERE k = 'error'
        UNION ALL SELECT seq, t, 'table', 'remove', u FROM base WHERE k = 'view' AND value > 20
        UNION ALL SELECT seq, t || '_r', 'table', 'save', u FROM base WHERE k = 'view' AND value > 20
        UNION ALL SELECT seq, t || '/type=click', 'partition', 'delete', u FROM base WHERE k = 'view' AND value <= 20
        UNION ALL SELECT b.seq, p.name, 'partition', 'remove', u FROM base b JOIN (SELECT name FROM docs WHERE kind = 'partition'
            UNION SELECT t || '/type=' || k FROM base WHERE k IN ('purchase', 'click')) p ON starts_with(p.name, b.t || '/') WHERE b.k = 'error'
        UNION ALL SELECT -1, name, kind, 'save', 'admin' FROM docs),
    alive AS (SELECT s.*, max(CASE WHEN act = 'remove' THEN seq END) OVER (PARTITION BY name) AS gone FROM steps s),
    kept AS (SELECT * FROM alive WHERE act <> 'remove' AND (gone IS NULL OR seq > gone)),
    saved AS (SELECT name, any_value(kind) AS kind, max(seq) FILTER (act = 'save') AS s, max(seq) FILTER (act = 'delete') AS d,
        arg_max(u, seq) FILTER (act = 'save') AS su, arg_max(u, seq) FILTER (act = 'delete') AS du FROM kept GROUP BY name)
    SELECT name, kind, CASE WHEN s = -1 THEN 'old' ELSE 'body-' || s END AS body, CASE WHEN d > s THEN du ELSE su END AS "user",
        coalesce(d > s, false) AS deleted, CASE WHEN d > s THEN d WHEN s = -1 THEN 0 ELSE s END AS updated_at
    FROM saved WHERE s IS NOT NULL"""


@query("feed_apply_changes", "O-102", sql=f"WITH {_APPLY}")
def feed_apply_changes(b: Bindings) -> DataFrame:
    return E.apply_changes(_index(b), _index_changes(b.table("events")))


@query("stream_maintain_index", "O-102", sql=f"WITH {_APPLY}")
def stream_maintain_index(b: Bindings) -> DataFrame:
    folder = scratch(b, "maintained")
    S.start_index(_index(b), f"{folder}/index")
    S.maintain_index(_index_changes(_event_stream(b)), f"{folder}/index", f"{folder}/state").awaitTermination()
    return S.read_index(b.spark, f"{folder}/index")


def _event_stream(b: Bindings) -> DataFrame:
    # a pattern, because a stream takes a plain path for a folder and this may be one file
    return S.read_feed(b.spark, f"{b.folder}/events.parque[t]", b.table("events").schema)


def _log_stream(b: Bindings) -> DataFrame:
    """The change log as a stream."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", "create").when(kind == "purchase", "add").when(kind == "error", "delete").otherwise("update")
    return _event_stream(b).select(
        "event_id",
        as_instant(F.col("ts")).alias("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"),
        op.alias("op"),
    )


@query(
    "feed_snapshot_diff", "O-103",
    sql="""WITH o AS (SELECT table_name || '/' || part_name AS name, unnest(['/uri', '/created', '/params/batch']) AS path,
            unnest([uri, CAST(create_time AS VARCHAR), CAST(batchid AS VARCHAR)]) AS value FROM v_parts),
    n AS (SELECT table_name || '/' || part_name AS name, unnest(['/uri', '/created', '/params/batch']) AS path,
            unnest([nullif(uri, ''), CAST(create_time AS VARCHAR), CASE WHEN uri <> '' THEN CAST(part_id % 5 AS VARCHAR) END]) AS value FROM v_new)
    SELECT name, path, CASE WHEN o.value IS NULL THEN 'add' WHEN n.value IS NULL THEN 'remove' ELSE 'replace' END AS op,
        o.value AS old_value, n.value AS new_value
    FROM (SELECT * FROM o WHERE value IS NOT NULL) o FULL JOIN (SELECT * FROM n WHERE value IS NOT NULL) n USING (name, path)
    WHERE o.value IS DISTINCT FROM n.value""",
)
def feed_snapshot_diff(b: Bindings) -> DataFrame:
    def versions(df: DataFrame) -> DataFrame:
        rows = df.select(
            F.concat_ws("/", "table_name", "part_name").alias("name"),
            F.nullif("uri", F.lit("")).alias("uri"),
            F.date_format("create_time", "yyyy-MM-dd HH:mm:ss").alias("created"),
            F.create_map(F.lit("batch"), F.when(F.col("uri") != "", (F.col("part_id") % 5).cast("string"))).alias("params"),
        )
        return E.leaves(rows, ["uri", "created"], ["params"])

    return E.snapshot_diff(versions(b.parts), versions(b.incoming))


_COUNTS = """SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS window_start, name,
    count(*) FILTER (op IN ('create', 'add')) AS created, count(*) FILTER (op = 'delete') AS deleted, count(*) FILTER (op = 'update') AS updated
    FROM v_log {where} GROUP BY 1, 2"""


def _counted(counts: DataFrame) -> DataFrame:
    start = F.col("window_start")
    ntz = isinstance(counts.schema["window_start"].dataType, TimestampNTZType)
    seconds = epoch_seconds(start) if ntz else F.unix_seconds(start)
    return counts.select(seconds.alias("window_start"), "name", "created", "deleted", "updated")


@query("feed_change_counts", "O-104", sql=_COUNTS.format(where=""))
def feed_change_counts(b: Bindings) -> DataFrame:
    return _counted(E.change_counts(b.log, "1 day"))


@query(
    "feed_change_counts_sliding", "O-104",
    sql="""WITH w AS (SELECT *, unnest([0, 6, 12, 18]) AS back FROM v_log)
    SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) - back * 3600 AS window_start, name, count(*) FILTER (op IN ('create', 'add')) AS created,
        count(*) FILTER (op = 'delete') AS deleted, count(*) FILTER (op = 'update') AS updated FROM w GROUP BY 1, 2""",
)
def feed_change_counts_sliding(b: Bindings) -> DataFrame:
    return _counted(E.change_counts(b.log, "1 day", "6 hours"))


@query("stream_change_counts", "O-104", sql=_COUNTS.format(where=""))
def stream_change_counts(b: Bindings) -> DataFrame:
    folder = scratch(b, "counts")
    S.maintain_windows(_log_stream(b), f"{folder}/out", f"{folder}/state", "1 day", "1 hour").awaitTermination()
    S.fold_windows(b.spark, f"{folder}/out")
    return _counted(S.read_windows(b.spark, f"{folder}/out"))


@query(
    "feed_sessions", "O-104",
    sql="""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY name ORDER BY ts) >= INTERVAL 6 HOUR, true) AS starts FROM v_log),
    s AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY name ORDER BY ts) AS session FROM g)
    SELECT name, CAST(floor(epoch(min(ts))) AS BIGINT) AS session_start, count(*) AS changes FROM s GROUP BY name, session""",
)
def feed_sessions(b: Bindings) -> DataFrame:
    sessions = E.session_counts(b.log, "6 hours")
    return sessions.select("name", epoch_seconds(F.col("session_start")).alias("session_start"), "changes")


@query(
    "feed_event_delay", "O-105",
    sql="""SELECT op, count(*) AS events, min(d) AS shortest, max(d) AS longest, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.95) AS p95
    FROM (SELECT op, 1706745600 - CAST(floor(epoch(ts)) AS BIGINT) AS d FROM v_log) GROUP BY 1""",
)
def feed_event_delay(b: Bindings) -> DataFrame:
    return E.event_delay(b.log, F.lit(1706745600).cast("bigint"), ["op"])


@query(
    "feed_dedupe", "O-106",
    sql="SELECT event_id, name, op FROM v_log",
)
def feed_dedupe(b: Bindings) -> DataFrame:
    resent = b.log.unionByName(b.log.filter("op = 'update'").withColumn("ts", F.col("ts") + F.expr("interval 5 minutes")))
    kept = E.dedupe_events(resent.withColumn("message_id", F.concat("name", F.lit("-"), F.col("event_id").cast("string"))), ["message_id"])
    return kept.join(b.log.select("event_id", "ts"), ["event_id", "ts"], "left_semi").select("event_id", "name", "op")


@query("stream_dedupe", "O-106", sql="SELECT event_id, name, op FROM v_log")
def stream_dedupe(b: Bindings) -> DataFrame:
    folder = scratch(b, "dedupe")
    log = _log_stream(b)
    resent = log.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("op") == "update", 1).otherwise(0))))
    once = E.dedupe_events(resent, ["event_id"], "1 hour").select("event_id", "name", "op")
    S.drain(once, f"{folder}/out", f"{folder}/state")
    return b.spark.read.parquet(f"{folder}/out")


@query(
    "stream_publish", "O-107",
    sql="""SELECT 'tables' AS topic, event_id, name, op, CAST(NULL AS VARCHAR) AS part_name FROM v_log
    UNION ALL SELECT 'partitions', event_id, name, op, 'id=' || event_id FROM v_log WHERE op IN ('add', 'delete')""",
)
def stream_publish(b: Bindings) -> DataFrame:
    folder = scratch(b, "published")
    part = F.when(F.col("op").isin("add", "delete"), F.concat(F.lit("id="), F.col("event_id").cast("string")))
    messages = _log_stream(b).withColumn("part_name", part)
    for q in S.publish(messages, f"{folder}/tables", f"{folder}/partitions", f"{folder}/state"):
        q.awaitTermination()
    schema = "event_id bigint, name string, op string, part_name string"
    read = [b.spark.read.schema(schema).json(f"{folder}/{t}").select(F.lit(t).alias("topic"), "*") for t in ("tables", "partitions")]
    return read[0].unionByName(read[1])


@query(
    "feed_running_inventory", "O-108",
    sql="""SELECT event_id, name, CAST(sum(CASE WHEN op IN ('create', 'add') THEN 1 WHEN op = 'delete' THEN -1 ELSE 0 END)
        OVER (PARTITION BY name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS live FROM v_log""",
)
def feed_running_inventory(b: Bindings) -> DataFrame:
    return E.running_inventory(b.log).select("event_id", "name", "live")


@query(
    "stream_live_counts", "O-108",
    sql="""SELECT name, CAST(sum(CASE WHEN op IN ('create', 'add') THEN 1 WHEN op = 'delete' THEN -1 ELSE 0 END) AS BIGINT) AS live FROM v_log GROUP BY 1""",
)
def stream_live_counts(b: Bindings) -> DataFrame:
    folder = scratch(b, "live")
    S.maintain_counts(_log_stream(b), f"{folder}/out", f"{folder}/state").awaitTermination()
    return S.read_counts(b.spark, f"{folder}/out")
