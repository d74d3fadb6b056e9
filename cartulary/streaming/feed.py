"""Summaries and state out of change events.

An event has ``event_id, ts, name, op``; the functions here take batch or
streaming DataFrames alike unless they say otherwise.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions import partition_names as P
from ..functions.documents import text_at
from ..functions.ranges import at_ranks, in_ranges, join_null_safe, running_sums
from ..functions.skew import join_hot
from ..functions.times import epoch_seconds, partition_time
from ..operators.diff import diff

# Where a table's definition names its delete column, how that column is dated, and which
# datings are regional.
DELETE_COLUMN = ("data_hygiene", "delete_column")
DATE_TYPE = ("data_dependency", "partition_column_date_type")
REGIONAL = ("region", "pacific")

# What a message says about its latest delete-column value.
ATTACHED = "ATTACHED_VALID_PARITITION_KEY"
MALFORMED = "INVALID_PARTITION_KEY_FORMAT"
ALL_FUTURE = "ALL_FUTURE_PARTITION_KEYS"
NO_COLUMN = "EMPTY_DELETE_COLUMN"
NO_VALUES = "NO_CANDIDATE_PARTITION_KEYS"
NOT_DEFINED = "MISSING_METADATA_INFO_FOR_PARTITION_KEY"
ONLY_DELETES = "PARTITION_KEY_UNABLED"


def delete_columns(defs: DataFrame) -> DataFrame:
    """Per table the delete column, whether it is regional, and whether both are defined."""
    column = text_at(F.col("data"), *DELETE_COLUMN)
    dated = text_at(F.col("data"), *DATE_TYPE)
    return defs.select(
        F.col("name").alias("table_name"),
        column.alias("delete_column"),
        F.coalesce(dated.isin(*REGIONAL), F.lit(False)).alias("regional"),
        (column.isNotNull() & dated.isNotNull()).alias("defined"),
    )


def partition_update_payloads(changes: DataFrame, defs: DataFrame, now: Column) -> DataFrame:
    """One message per table update out of ``(update_id, table_name, op, part_name)`` rows (batch).

    Walking the delete-column values downwards as text, the first one in the past is
    the latest; a malformed value met before it ends the walk.  That is the larger of
    two maxima, so the values fold before the shuffle.  The names are rows of
    :func:`partition_update_names`.
    """
    known = join_hot(changes, delete_columns(defs), ["table_name"], "left", ["update_id", "part_name"])
    adds, drops = F.col("op") == "add", F.col("op") == "delete"
    value = F.when(
        adds & (F.col("delete_column") != ""),
        F.try_element_at(P.key_map(F.col("part_name")), F.col("delete_column")),
    )
    valued = known.withColumn("_value", value).withColumn(
        "_time", partition_time(F.col("_value"), F.col("regional"))
    )
    malformed = F.col("_value").isNotNull() & F.col("_time").isNull()
    folded = valued.groupBy("update_id", "table_name").agg(
        F.count_if(adds).alias("created"),
        F.count_if(drops).alias("deleted"),
        F.max("delete_column").alias("delete_column"),
        F.max(F.coalesce("defined", F.lit(False))).alias("defined"),
        F.max(F.col("_value").isNotNull()).alias("_any"),
        F.max(F.when(F.col("_time") <= now, F.col("_value"))).alias("_past"),
        F.max(F.when(malformed, F.col("_value"))).alias("_bad"),
    )
    past, bad = F.col("_past"), F.col("_bad")
    attached = past.isNotNull() & (bad.isNull() | (past > bad))
    message = (
        F.when(F.col("created") == 0, ONLY_DELETES)
        .when(~F.col("defined"), NOT_DEFINED)
        .when(F.col("delete_column") == "", NO_COLUMN)
        .when(~F.col("_any"), NO_VALUES)
        .when(attached, ATTACHED)
        .when(bad.isNotNull(), MALFORMED)
        .otherwise(ALL_FUTURE)
    )
    usable = (F.col("created") > 0) & F.col("defined") & attached
    return folded.select(
        "update_id",
        "table_name",
        "created",
        "deleted",
        F.when(usable, F.concat_ws("=", "delete_column", "_past")).alias("latest"),
        message.alias("message"),
    )


def partition_update_names(changes: DataFrame) -> DataFrame:
    """Every partition that an update added or deleted, once: ``(update_id, table_name, op, part_name)``.

    Names are rows of their own, so an update of any size lists them all and none is gathered.
    """
    return changes.select("update_id", "table_name", "op", "part_name").distinct()


SAVES = ("create", "update")


def change_effects(changes: DataFrame) -> DataFrame:
    """Net effect per name of ``(seq, ts, op, kind, name, new_name, body, user)`` events.

    A rename removes the old name and saves the new one.  Only maxima are kept, so a
    name with very many events folds on the map side.
    """
    moved = changes.filter(F.col("op") == "rename")
    steps = (
        changes.filter(F.col("op") != "rename")
        .withColumn("act", F.when(F.col("op").isin(*SAVES), "save").otherwise("delete"))
        .unionByName(moved.withColumn("act", F.lit("remove")))
        .unionByName(moved.withColumns({"act": F.lit("save"), "name": F.col("new_name")}))
    )

    def last(act: str) -> Column:
        return F.max(F.when(F.col("act") == act, F.col("seq")))

    saved_at = F.when(F.col("act") == "save", F.col("seq"))
    state = F.struct("kind", "body", "user", "ts")
    return steps.groupBy("name").agg(
        F.max("kind").alias("kind"),
        last("save").alias("saved"),
        last("delete").alias("deleted"),
        last("remove").alias("removed"),
        F.max_by(state, saved_at).alias("save"),
        F.max_by(F.struct("user", "ts"), F.when(F.col("act") == "delete", F.col("seq"))).alias("drop"),
    )


def apply_changes(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """The index ``(name, kind, body, user, deleted, updated_at)`` after a batch of events.

    Deletes are soft, but the partition documents of a deleted table go for good
    unless saved again later.
    """
    before = F.lit(-1).cast("bigint")
    effects = change_effects(changes)
    both = docs.select(
        "name",
        F.col("kind").alias("_kind"),
        F.col("body").alias("_body"),
        F.col("user").alias("_user"),
        F.col("deleted").alias("_deleted"),
        F.col("updated_at").alias("_at"),
    ).join(effects, "name", "full")
    # partitions look up the last deletion of their table; a table may own very many
    table_drops = (
        effects.filter((F.col("kind") == "table") & F.col("deleted").isNotNull())
        .select(F.col("name").alias("_table"), F.col("deleted").alias("_table_deleted"))
    )
    is_partition = F.coalesce("_kind", "kind") == "partition"
    both = both.withColumn("_table", F.when(is_partition, F.substring_index("name", "/", 3)))
    named = docs.select("name", "kind").unionByName(changes.select("name", "kind")).filter("kind = 'partition'")
    owners = named.select(F.substring_index("name", "/", 3).alias("_table"))
    both = join_hot(both, table_drops, ["_table"], "left", ["name"], counted=owners)
    removed = F.greatest(F.coalesce("removed", before), F.coalesce("_table_deleted", before))
    saved = F.coalesce("saved", before)
    stored = F.col("_kind").isNotNull() & (removed == before)
    fresh = F.col("saved").isNotNull() & (saved > removed)
    dropped = F.coalesce("deleted", before)
    drop_counts = (dropped > saved) & (dropped > removed)
    return both.filter(stored | fresh).select(
        "name",
        F.when(fresh, F.col("save.kind")).otherwise(F.col("_kind")).alias("kind"),
        F.when(fresh, F.col("save.body")).otherwise(F.col("_body")).alias("body"),
        F.when(drop_counts, F.col("drop.user"))
        .when(fresh, F.col("save.user"))
        .otherwise(F.col("_user"))
        .alias("user"),
        F.when(drop_counts, True).when(fresh, False).otherwise(F.col("_deleted")).alias("deleted"),
        F.when(drop_counts, F.col("drop.ts"))
        .when(fresh, F.col("save.ts"))
        .otherwise(F.col("_at"))
        .alias("updated_at"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Field patches between table versions: ``(name, path, op, old_value, new_value)``.

    Both sides are leaf rows ``(name, path, value)``, see :func:`leaves`.
    """
    found = diff(old, new, ["name", "path"], ["value"])
    return found.filter(F.col("op") != "same")


def leaves(rows: DataFrame, fields: list[str], maps: list[str] | None = None) -> DataFrame:
    """Leaf rows of table versions: plain fields and the entries of map fields; nulls are absent."""
    entries = [F.create_map(F.lit(f"/{f}"), F.col(f).cast("string")) for f in fields]
    entries += [_prefixed(m) for m in maps or []]
    return rows.select("name", F.explode(F.map_concat(*entries)).alias("path", "value")).filter(
        "value is not null"
    )


def _prefixed(column: str) -> Column:
    return F.transform_keys(column, lambda k, _: F.concat(F.lit(f"/{column}/"), k))


def change_kind(op: Column) -> Column:
    """created, deleted or updated."""
    return F.when(op.isin("create", "add"), "created").when(op == "delete", "deleted").otherwise("updated")


def change_counts(events: DataFrame, width: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Created, deleted and updated per table and window; tumbling unless ``slide`` is given."""
    source = events.withWatermark("ts", watermark) if watermark else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    kind = change_kind(F.col("op"))
    counted = source.groupBy(window.alias("w"), "name").agg(
        *[F.count_if(kind == k).alias(k) for k in ("created", "deleted", "updated")]
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "name", "created", "deleted", "updated"
    )


def session_counts(events: DataFrame, gap: str, watermark: str | None = None, ranges: int | None = None) -> DataFrame:
    """Events per burst of activity on a table: ``session_start, session_end, name, changes``.

    An event that comes ``gap`` or more after the last one of its table begins a session; a session ends ``gap``
    after its last event.  On a stream these are Spark's session windows, which also join events exactly ``gap``
    apart.  On a batch the events are cut into ranges
    of (name, ts) whatever their names: sessions are found within each range, and those at the borders of ranges, two
    a range at most, are put together.  So one table may own any share of the events.  Null times are left out.
    """
    if events.isStreaming:
        return (
            events.withWatermark("ts", watermark)
            .groupBy(F.session_window("ts", gap).alias("w"), "name")
            .agg(F.count("*").alias("changes"))
            .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "name", "changes")
        )
    length = F.expr(f"interval {gap}")
    ranged = in_ranges(events.select("name", "ts").filter("ts IS NOT NULL"), ["name", "ts"], "_range", ranges)
    inside = Window.partitionBy("_range", "name").orderBy("ts")
    opens = F.coalesce(F.col("ts") >= F.lag("ts").over(inside) + length, F.lit(True))
    told = ranged.withColumn("_opens", opens).withColumn("_nth", F.count_if("_opens").over(inside))
    pieces = told.groupBy("_range", "name", "_nth").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("changes"))
    # a name that lies in several ranges: its first and last sessions of each may go on in the next one
    spread = ranged.groupBy("name").agg(F.min("_range").alias("_lo"), F.max("_range").alias("_hi")).filter("_lo < _hi").select("name")
    last = F.max("_nth").over(Window.partitionBy("_range", "name"))
    marked = join_null_safe(pieces.withColumn("_last", last), spread.withColumn("_spread", F.lit(True)), ["name"], "left")
    border = F.coalesce("_spread", F.lit(False)) & ((F.col("_nth") == 1) | (F.col("_nth") == F.col("_last")))
    marked = marked.withColumn("_border", border)
    along = Window.partitionBy("name").orderBy("_range", "_nth")
    at_borders = marked.filter("_border").withColumn(
        "_begins",
        F.coalesce(
            (F.col("first") >= F.lag("last").over(along) + length)
            # between the first and the last session of one range there may be others
            | (F.lag("_range").over(along) == F.col("_range")),
            F.lit(True),
        ),
    )
    whole = (
        at_borders.withColumn("_session", F.count_if("_begins").over(along))
        .groupBy("name", "_session")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("changes").alias("changes"))
    )
    columns = ["name", "first", "last", "changes"]
    every = marked.filter("NOT _border").select(*columns).unionByName(whole.select(*columns))
    return every.select(F.col("first").alias("session_start"), (F.col("last") + length).alias("session_end"), "name", "changes")


# Which percentiles of delays are told.
PERCENTILES = {"p50": 0.5, "p95": 0.95}


def event_delay(events: DataFrame, now: Column, by: list[str], ranges: int | None = None) -> DataFrame:
    """Exact percentiles of whole-second delays since the request (batch).

    Delays fold to a histogram, which is cut into ranges of (``by``, delay).  Counts per range tell which range
    holds the ranks on both sides of a percentile, and only those ranges are opened; the value is interpolated
    between the two.  So one operation may have any number of distinct delays.  Events without a time count among
    the events and nowhere else.
    """
    delay = (now - epoch_seconds(F.col("ts"))).alias("delay")
    histogram = events.groupBy(*by, delay).agg(F.count("*").alias("n"))
    ranged = in_ranges(histogram, [*by, "delay"], "_range", ranges)
    known = F.sum(F.when(F.col("delay").isNotNull(), F.col("n")))
    totals = ranged.groupBy(*by).agg(
        F.sum("n").alias("events"), known.alias("_known"), F.min("delay").alias("shortest"), F.max("delay").alias("longest")
    )
    places = F.array(*[F.struct(F.lit(name).alias("p"), ((F.col("_known") - 1) * F.lit(share)).alias("place")) for name, share in PERCENTILES.items()])
    asked = totals.select(*by, F.explode(places).alias("_a")).select(*by, "_a.*")
    low, high = F.floor("place").cast("bigint"), F.ceil("place").cast("bigint")
    wanted = asked.select(*by, low.alias("rank")).unionByName(asked.select(*by, high.alias("rank"))).distinct()
    found = at_ranks(ranged.filter("delay IS NOT NULL"), by, "delay", "n", "_range", wanted)
    sides = asked.withColumns({"_low": low, "_high": high})
    for side in ("_low", "_high"):
        told = found.select(*by, F.col("rank").alias(side), F.col("delay").alias(f"{side}_delay"))
        sides = join_null_safe(sides, told, [*by, side], "inner")
    between = (F.col("_high") - F.col("place")) * F.col("_low_delay") + (F.col("place") - F.col("_low")) * F.col("_high_delay")
    value = F.when(F.col("_low_delay") == F.col("_high_delay"), F.col("_low_delay").cast("double")).otherwise(between)
    values = sides.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, value)).alias(p) for p in PERCENTILES])
    return join_null_safe(totals, values, by, "left").drop("_known")


def event_delay_approx(events: DataFrame, now: Column, by: list[str], accuracy: int = 10000) -> DataFrame:
    """Streaming form of :func:`event_delay`: mergeable percentile sketches."""
    delay = F.unix_seconds(now) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return events.groupBy(*by).agg(
        F.count("*").alias("events"),
        F.percentile_approx(delay, [0.5, 0.95], accuracy).alias("percentiles"),
    )


def dedupe_events(events: DataFrame, keys: list[str], watermark: str | None = None) -> DataFrame:
    """Each event once: within the watermark on a stream, overall on a batch."""
    if events.isStreaming:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)
    first = F.min_by(F.struct(*events.columns), F.struct("ts", "event_id"))
    held = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    return events.groupBy(*held).agg(first.alias("_e")).select("_e.*")


def inventory_delta(op: Column) -> Column:
    """How one event changes the number of live partitions."""
    return F.when(op.isin("create", "add"), 1).when(op == "delete", -1).otherwise(0)


def live_counts(events: DataFrame) -> DataFrame:
    """Live partitions per table so far; on a stream the counts update as events arrive."""
    return events.groupBy("name").agg(F.sum(inventory_delta(F.col("op"))).alias("live"))


def running_inventory(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Live partition count after every event (batch).

    A running sum by :func:`running_sums`: events are cut into ranges of (name, ts, event_id) of equal size, summed
    within each, and what a table has in earlier ranges is carried on in one row per range.  A bulk load of one
    table in one hour is spread like any other events.
    """
    steps = events.select("event_id", "ts", "name", inventory_delta(F.col("op")).alias("delta"))
    order = ["name", "ts", "event_id"]
    ranged = in_ranges(steps, order, "_range", ranges)
    return running_sums(ranged, ["name"], order[1:], "_range", {"live": F.col("delta")}).select("event_id", "ts", "name", "live")
