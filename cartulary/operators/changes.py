"""Catalog changes planned and applied as whole-catalog jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.partition_names import fits_keys, is_valid_name
from ..functions.ranges import in_ranges
from ..functions.skew import join_hot
from ..session import keep
from .metadata import delete_metadata, judge_renames, rename_allowed, soft_delete_data
from .partitions import ID, with_key_schema
from .relations import drop_entity, rename_ends
from .tags import EDGE as TAG


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


# Why rows of a save are refused.
INVALID = "refused: the name does not fit the keys"
REPEATED = "refused: named more than once"

# What an altered partition keeps from the stored one.
KEPT = ("create_time", "last_modified", "params")


def plan_partition_save(
    existing: DataFrame,
    incoming: DataFrame,
    deletes: DataFrame | None = None,
    check: bool = True,
    alter: bool = False,
    path_only: bool = False,
    keys: list[str] | DataFrame | None = None,
    order: str | None = None,
) -> DataFrame:
    """What saving ``incoming`` does: its rows with an ``action``.

    ``action`` is added, unchanged (same uri), replaced (dropped and added again),
    altered (keeps its dates and parameters) or deleted.  A blank uri inherits the
    stored one.  With neither flag nothing is looked up and everything is added.
    ``path_only`` is the store that only tracks paths: no uri means unchanged and a new
    uri alters the row in place.

    A partition named more than once is refused as a whole, or with an ``order`` column all but its earliest
    row; with the declared ``keys`` a name that does not fit them is refused too.  A refused partition has one
    row, whose action tells why, and changes nothing.  ``keys`` is one list for all tables, or a schema with each
    table's own keys, see :func:`with_key_schema`.
    """
    kept = [c for c in KEPT if c in existing.columns and c in incoming.columns]
    row = F.struct("uri", *kept)
    one = F.min_by(row, order) if order else F.any_value(row)
    folded = incoming.groupBy(*ID).agg(F.count("*").alias("_n"), one.alias("_row"))
    if isinstance(keys, DataFrame):
        folded = with_key_schema(folded, keys, "_keys")
        fits = fits_keys(F.col("part_name"), F.map_keys("_keys"))
    else:
        fits = is_valid_name(F.col("part_name"), keys) if keys else F.lit(True)
    new = folded.filter(fits if order else fits & (F.col("_n") == 1)).select(*ID, "_row.*")
    why = F.when(~fits, INVALID).when(F.col("_n") > 1, REPEATED)
    refused = folded.select(*ID, "_row.*", why.alias("action")).filter("action IS NOT NULL")
    if check or alter:
        stored = [F.col(c).alias(f"_{c}") for c in ("uri", *kept)]
        both = new.join(existing.select(*ID, *stored, F.lit(True).alias("_known")), ID, "left")
        same = F.col("uri").eqNullSafe(F.col("_uri"))
        if path_only:
            same = same | F.col("uri").isNull()
        changed = "altered" if alter or path_only else "replaced"
        action = (
            F.when(F.col("_known").isNull(), "added").when(same, "unchanged").otherwise(changed)
        )
        inherits = F.col("_known") & _blank(F.col("uri"))
        keeps = action.isin("altered", "unchanged")
        plan = both.select(
            *ID,
            F.when(inherits, F.col("_uri")).otherwise(F.col("uri")).alias("uri"),
            *[F.when(keeps, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in kept],
            action.alias("action"),
        )
    else:
        plan = new.withColumn("action", F.lit("added"))
    plan = plan.unionByName(refused)
    if deletes is not None:
        gone = existing.join(deletes.select(*ID), ID, "left_semi")
        plan = plan.unionByName(gone.select(*ID, "uri", *kept, F.lit("deleted").alias("action")))
    return plan


def apply_partition_save(existing: DataFrame, plan: DataFrame) -> DataFrame:
    """The inventory after a plan.

    A plan is small next to the inventory, so the inventory is only anti-joined; the
    plan is read twice and worth keeping when it is costly.
    """
    columns = [c for c in plan.columns if c != "action"]
    touched = plan.filter(F.col("action").isin("added", "replaced", "altered", "deleted")).select(*ID)
    written = plan.filter(F.col("action").isin("added", "replaced", "altered"))
    return existing.select(*columns).join(touched, ID, "left_anti").unionByName(written.select(*columns))


def view_table(database: Column | str, table: Column | str, view: str) -> Column:
    """Name of the table that backs a materialised view."""
    parts = [F.lit(p) if isinstance(p, str) else p for p in (database, table)]
    return F.concat_ws("_", *parts, F.lit(view))


def snapshot_mview(
    parts: DataFrame, database: str, view: str, predicate: Column | None = None
) -> DataFrame:
    """Copy of the (filtered) partitions under their view table."""
    kept = parts if predicate is None else parts.filter(predicate)
    return kept.withColumn("table_name", view_table(database, F.col("table_name"), view))


FORMATS = ["input_format", "output_format", "serialization_lib"]


def merge_mview_partitions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming view partitions completed from the stored ones.

    With the same or no uri, the uri and missing formats are inherited; a new uri
    keeps its own.
    """
    formats = [c for c in FORMATS if c in incoming.columns]
    old = existing.select(*ID, *[F.col(c).alias(f"_{c}") for c in ("uri", *formats)])
    both = incoming.join(old, ID, "left")
    inherits = F.col("uri").isNull() | F.col("uri").eqNullSafe(F.col("_uri"))
    filled = {
        c: F.when(inherits, F.coalesce(c, f"_{c}")).otherwise(F.col(c)) for c in ("uri", *formats)
    }
    return both.withColumns(filled).select(*incoming.columns)


def list_mviews(tables: DataFrame, view_database: str, database: str, table: str) -> DataFrame:
    """Views of a table: view-database tables named ``database_table_…``, prefix stripped."""
    prefix = f"{database}_{table}_"
    return tables.filter(
        (F.col("database_name") == view_database) & F.col("table_name").startswith(prefix)
    ).withColumn("view_name", F.substring("table_name", len(prefix) + 1, 1 << 30))


def copy_tables(tables: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copy tables by ``(old, new)`` inside a catalog: new rows, problems, databases to add.

    Different sources for one target are a problem of each; a repeated pair is one copy.
    """
    pairs = mapping.select("old", "new").distinct()
    shared = pairs.groupBy("new").agg((F.count("*") > 1).alias("_shared"))
    pairs = pairs.join(shared, "new")
    source = tables.select(F.col("name").alias("old"), F.lit(True).alias("_source"))
    target = tables.select(F.col("name").alias("new"), F.lit(True).alias("_target"))
    checked = pairs.join(source, "old", "left").join(target, "new", "left")
    other_catalog = F.substring_index("old", "/", 1) != F.substring_index("new", "/", 1)
    problem = (
        F.when(other_catalog, "different catalog")
        .when(F.col("_source").isNull(), "source missing")
        .when(F.col("_target").isNotNull(), "target exists")
        .when(F.col("_shared"), "several copies to one target")
    )
    checked = checked.select("old", "new", problem.alias("problem"))
    good = checked.filter("problem is null").select(F.col("old").alias("name"), "new")
    # one source may be copied many times, never the other way round
    copies = join_hot(good, tables, ["name"], "inner", ["new"])
    new_parts = F.split("new", "/")
    copied = copies.withColumns(
        {
            "name": F.col("new"),
            "database_name": F.get(new_parts, F.lit(1)),
            "table_name": F.get(new_parts, F.lit(2)),
        }
    ).select(*tables.columns)
    wanted = copied.select("catalog_name", "database_name").distinct()
    databases = wanted.join(
        tables.select("catalog_name", "database_name").distinct(), ["catalog_name", "database_name"], "left_anti"
    )
    return copied, checked.filter("problem is not null"), databases


def rename_verdicts(
    tables: DataFrame, tags: DataFrame, edges: DataFrame, mapping: DataFrame, guarded: list[str] | None = None
) -> DataFrame:
    """``(old, new, reason)``: every rename with why it is refused, null for those allowed.

    Refused are renames of missing or guarded tables, to a name that a table has or that takes part in an edge,
    of one table to several names, and of several tables to one name.
    """
    have = tables.select("name").distinct()
    linked = edges.select(F.col("parent").alias("new")).unionByName(edges.select(F.col("child").alias("new"))).distinct()
    held = tags.filter(F.col("tag").isin(guarded or [])).select(F.col("name").alias("old")).distinct()
    marked = (
        judge_renames(mapping)
        .join(have.select(F.col("name").alias("old"), F.lit(True).alias("_source")), "old", "left")
        .join(held.withColumn("_held", F.lit(True)), "old", "left")
        .join(have.select(F.col("name").alias("new"), F.lit(True).alias("_target")), "new", "left")
        .join(linked.withColumn("_linked", F.lit(True)), "new", "left")
    )
    reason = (
        F.when(F.col("_source").isNull(), "source missing")
        .when(F.col("_held"), "guarded by a tag")
        .when(F.col("_target"), "target exists")
        .when(F.col("_linked"), "target in an edge")
        .otherwise(F.col("ambiguous"))
    )
    return marked.select("old", "new", reason.alias("reason"))


def rename_tables(
    tables: DataFrame,
    defs: DataFrame,
    tags: DataFrame,
    edges: DataFrame,
    mapping: DataFrame,
    guarded: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Rename tables by ``(old, new)`` with everything keyed by their name.

    One verdict, kept once, holds for all stores: a rename takes effect in each of them or in none, and ``refused`` has those
    that do not with their reasons.
    """
    verdicts = keep(rename_verdicts(tables, tags, edges, mapping, guarded), "renames")
    allowed = verdicts.filter("reason IS NULL").select("old", "new")
    parts = F.split("name", "/")
    levels = ("catalog_name", "database_name", "table_name")
    spelled = {c: F.get(parts, F.lit(i)) for i, c in enumerate(levels) if c in tables.columns}
    return {
        "refused": verdicts.filter("reason IS NOT NULL"),
        "tables": rename_allowed(tables, allowed, "name", replace_target=False).withColumns(spelled),
        "defs": rename_allowed(defs, allowed, "name", replace_target=True),
        "tags": rename_allowed(tags.select(*TAG), allowed, "name", replace_target=True),
        "edges": rename_ends(edges, allowed),
    }


def drop_refusals(names: DataFrame, edges: DataFrame, tags: DataFrame, guarded: list[str]) -> DataFrame:
    """Names that may not be dropped, with the reason."""
    is_guarded = tags.filter(F.col("tag").isin(guarded)).select("name", F.lit("guarded by a tag").alias("reason"))
    has_children = edges.select(F.col("parent").alias("name"), F.lit("has children").alias("reason"))
    reasons = is_guarded.unionByName(has_children).groupBy("name").agg(F.min("reason").alias("reason"))
    return reasons.join(names.select("name"), "name", "left_semi")


def drop_tables(
    tables: DataFrame,
    defs: DataFrame,
    tags: DataFrame,
    edges: DataFrame,
    data: DataFrame,
    marks: DataFrame,
    names: DataFrame,
    guarded: list[str],
    user: str,
    at: Column,
) -> dict[str, DataFrame]:
    """Drop tables that nothing holds back: rows, documents, tags and edges go, data is marked.

    The verdict on the names is kept, as every output depends on it.
    """
    refused = drop_refusals(names, edges, tags, guarded)
    verdict = keep(names.select("name").distinct().join(refused, "name", "left"), "drop")
    refused, gone = verdict.filter("reason IS NOT NULL"), verdict.filter("reason IS NULL").select("name")
    uris = tables.join(gone, "name", "left_semi").filter("uri is not null").select("uri")
    return {
        "refused": refused,
        "tables": tables.join(gone, "name", "left_anti"),
        "defs": delete_metadata(defs, gone, "name"),
        "tags": tags.join(gone, "name", "left_anti"),
        "edges": drop_entity(edges, gone),
        "marks": soft_delete_data(data, marks, uris, user, at),
    }


def _is_blank(text: str | None) -> bool:
    return not (text or "").strip(" ")


def cas_metadata_location(tables: DataFrame, updates: DataFrame, ranges: int | None = None) -> DataFrame:
    """Compare-and-set of metadata locations, one request after the other: every update with its ``status``.

    ``tables`` is ``(name, location)``; ``updates`` is ``(seq, name, previous, new)``.  Each update of a table is
    judged against the location that the accepted ones before it have left, in order of ``seq`` (then of
    ``previous`` and ``new``), so a chain of updates is followed to its end.

    Updates are cut into ranges of (name, seq) of equal size, and the updates of one table in one range are a run.
    A table whose updates lie in several ranges is followed from run to run first (see :func:`_entries`); then every
    run is judged on its own, from the location it begins with.  So one table may own any share of the updates.
    """
    stored = tables.select("name", F.col("location").alias("_stored"), F.lit(True).alias("_known"))
    seen = join_hot(updates, stored, ["name"], "left", ["seq"])
    order = ["seq", "previous", "new"]
    ranged = in_ranges(seen, ["name", *order], "_range", ranges)
    begun = ranged.join(_entries(ranged, order), ["name", "_range"], "left")
    first = F.when(F.col("_entry").isNotNull(), F.col("_entry.location")).otherwise(F.col("_stored"))
    ordered = begun.withColumn("_first", first).repartition("_range", "name").sortWithinPartitions("_range", "name", *order)

    columns = updates.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, location = None, None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("_range", "name", "previous", "new", "_first", "_known")))
            told = []
            for number, name, previous, new, begins, known in rows:
                if at != (number, name):
                    at, location = (number, name), begins
                if not known:
                    status = "table missing"
                elif _is_blank(location):
                    status = "stored location empty"
                elif location == new:
                    status = "no-op"
                elif _is_blank(previous):
                    status = "previous location empty"
                elif location != previous:
                    status = "previous location differs"
                else:
                    status, location = "accepted", new
                told.append(status)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(told, pa.string())], names=[*columns, "status"])

    return ordered.mapInArrow(walk, StructType([*updates.schema.fields, StructField("status", StringType())]))


def _folded(ranged: DataFrame, order: list[str]) -> DataFrame:
    """What each run of updates does to a location: ``id, name, _range, before, after`` for every location it moves.

    A run is folded from its last update to its first: an update that moves ``previous`` to ``new`` leaves it where
    the later ones leave ``new``.  Other locations stay as they are.
    """
    backwards = [F.col(c).desc() for c in order]
    ordered = ranged.repartition("_range", "name").sortWithinPartitions("_range", "name", *backwards)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, moves = None, {}
        made = TaskContext.get().partitionId() << 40

        def rows() -> pa.RecordBatch:
            nonlocal made
            number, name = at
            n = len(moves)
            made += n
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(range(made - n, made), pa.int64()), pa.array([name] * n, pa.string()), pa.array([number] * n, pa.int32()),
                    pa.array(list(moves), pa.string()), pa.array(list(moves.values()), pa.string()),
                ],
                names=["id", "name", "_range", "before", "after"],
            )

        for batch in batches:
            for number, name, previous, new in zip(*(batch.column(c).to_pylist() for c in ("_range", "name", "previous", "new"))):
                if at != (number, name):
                    if moves:
                        yield rows()
                    at, moves = (number, name), {}
                if not _is_blank(previous) and previous != new:
                    moves[previous] = moves.get(new, new)
        if moves:
            yield rows()

    return ordered.mapInArrow(fold, "id long, name string, _range int, before string, after string")


def _entries(ranged: DataFrame, order: list[str]) -> DataFrame:
    """``name, _range, _entry``: where tables with several runs are when each run begins, from the second one on.

    Every run is folded to what it does to a location.  Each of these moves points to the next run of the table that
    moves its result on; pointers are doubled, and from the table's first location all moves on its way are marked,
    twice as many in every round.  So rounds are as many as the number of runs has bits, and the moves of a table
    with many runs are followed in many tasks.
    """
    lies = ranged.filter("_known").groupBy("name", "_range").agg(F.min("_stored").alias("_stored"))
    several = lies.groupBy("name").agg(F.count("*").alias("_n")).filter("_n > 1").select("name")
    runs = keep(lies.join(several, "name", "left_semi"), "runs")
    moves = keep(_folded(ranged.join(several, "name", "left_semi").select("name", "_range", *order), order), "moves")
    # for every place a table may be left at, the next run that moves it on
    start = runs.groupBy("name").agg(F.min("_stored").alias("location"))
    asks = moves.select("name", "_range", F.col("after").alias("location")).unionByName(
        start.select("name", F.lit(-1).alias("_range"), "location")
    )
    marks = (
        asks.select("name", "_range", "location", F.lit(None).cast("bigint").alias("id"))
        .unionByName(moves.select("name", "_range", F.col("before").alias("location"), "id"))
        .filter("location IS NOT NULL")
        .groupBy("name", "location", "_range")
        .agg(F.max("id").alias("id"))
    )
    later = Window.partitionBy("name", "location").orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    nexts = keep(marks.withColumn("next", F.first("id", ignorenulls=True).over(later)).filter("next IS NOT NULL").drop("id"), "nexts")
    here = nexts.withColumnRenamed("location", "after")
    jump = keep(moves.join(here, ["name", "_range", "after"]).select("id", "next"), "jumps")
    way = nexts.filter("_range = -1").join(start, ["name", "location"], "left_semi").select(F.col("next").alias("id"))
    while not jump.isEmpty():
        further = way.join(jump, "id").select(F.col("next").alias("id"))
        way = keep(way.unionByName(further).distinct(), "way")
        onward = jump.select(F.col("id").alias("next"), F.col("next").alias("_then"))
        jump = keep(join_hot(jump, onward, ["next"], "inner", ["id"]).select("id", F.col("_then").alias("next")), "jumps")
    left = moves.join(way, "id", "left_semi").select("name", "_range", F.struct(F.col("after").alias("location")).alias("_left"))
    before = Window.partitionBy("name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    known = runs.join(left, ["name", "_range"], "left").withColumn("_entry", F.last("_left", ignorenulls=True).over(before))
    return known.filter("_entry IS NOT NULL").select("name", "_range", "_entry")


def apply_cas(tables: DataFrame, judged: DataFrame) -> DataFrame:
    """Table locations after the accepted updates: the new one of the last."""
    last = F.max_by("new", F.struct("seq", "previous", "new"))
    won = judged.filter(F.col("status") == "accepted").groupBy("name").agg(
        last.alias("_new"), F.lit(True).alias("_moved")
    )
    return tables.join(won, "name", "left").select(
        "name", F.when(F.col("_moved"), F.col("_new")).otherwise(F.col("location")).alias("location")
    )
