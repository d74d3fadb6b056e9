"""User metadata documents: definitions by name, data documents by storage path."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions import documents as J
from ..functions.names import is_search_type
from ..functions.skew import join_hot
from ..session import keep
from .diff import diff
from .merging import merge_in_turn
from .partitions import sort_page
from .resolve import any_below

Hook = Callable[[DataFrame], DataFrame]


def attach_metadata(
    df: DataFrame, defs: DataFrame, data: DataFrame, metrics: str | None = None, hook: Hook | None = None
) -> DataFrame:
    """Add ``definition_metadata`` (by name) and ``data_metadata`` (by uri).

    Many entities may share one uri, so that join is spread.  A ``metrics`` column
    already on the rows wins over the stored data document.  ``hook`` may rewrite
    the documents on the way out.
    """
    by_name = defs.select("name", F.col("data").alias("definition_metadata"))
    by_uri = data.select("uri", F.col("data").alias("_stored"))
    out = df.join(by_name, "name", "left")
    out = join_hot(out, by_uri, ["uri"], "left", ["name"], counted=df)
    found = F.coalesce(F.col(metrics), F.col("_stored")) if metrics else F.col("_stored")
    out = out.withColumn("data_metadata", found).drop("_stored")
    return hook(out) if hook else out


def merge_metadata(
    base: DataFrame, patches: DataFrame, merge: bool = True, nested: bool = True, hook: Hook | None = None
) -> DataFrame:
    """Documents after the patches; absent names are inserted.

    ``base`` is ``(name, data)`` and ``patches`` ``(name, seq, patch)``.  With
    ``merge=False`` the latest patch replaces the document.  ``nested=False``
    promises patches without inner objects and at most one patch per name, and
    merges in one pass.  Documents without a patch stay as they are spelled.
    """
    if not merge:
        last = patches.groupBy("name").agg(F.max_by("patch", "seq").alias("patch"))
        out = base.join(last, "name", "full").select(
            "name", F.coalesce("patch", "data").alias("data")
        )
    elif not nested:
        both = base.select("name", "data").join(patches.select("name", "patch"), "name", "full")
        out = both.select("name", J.merge_top_level(F.col("data"), F.col("patch")).alias("data"))
    else:
        patched = patches.select("name").distinct()
        later = patches.select("name", F.struct(F.lit(1).alias("turn"), F.col("seq").cast("bigint").alias("seq")).alias("at"), F.col("patch").alias("doc"))
        first = F.struct(F.lit(0).alias("turn"), F.lit(None).cast("bigint").alias("seq")).alias("at")
        touched = base.join(patched, "name", "left_semi").filter("data IS NOT NULL").select("name", first, F.col("data").alias("doc"))
        rest = base.select("name", "data").join(patched, "name", "left_anti")
        out = merge_in_turn(touched.unionByName(later)).unionByName(rest)
    return hook(out) if hook else out


def save_plan(base: DataFrame, incoming: DataFrame, key: str = "name") -> DataFrame:
    """``(key, kind, change)`` for incoming documents: insert or update, by store.

    Empty documents are not saved.
    """
    real = incoming.filter(F.col("data").isNotNull() & ~F.regexp_replace("data", r"\s", "").isin("{}", ""))
    known = base.select(key).withColumn("_known", F.lit(True))
    change = F.when(F.col("_known"), "update").otherwise("insert")
    kind = (
        F.when(is_search_type(F.col(key), "partition"), "partition_definition").otherwise("definition")
        if key == "name"
        else F.lit("data")
    )
    return real.join(known, key, "left").select(key, kind.alias("kind"), change.alias("change"))


# Columns a metadata search may sort by.
SORT_COLUMNS = ("id", "date_created", "created_by", "last_updated_by", "name", "last_updated")


def search_metadata(
    defs: DataFrame,
    properties: list[str] | None = None,
    kind: str | None = None,
    name_like: str | None = None,
    sort_by: str | None = None,
    descending: bool = False,
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Documents having all properties (at any depth), of a type, with a name like a pattern."""
    for p in properties or []:
        defs = defs.filter(J.has_property_text(F.col("data"), p))
    if kind is not None:
        defs = defs.filter(is_search_type(F.col("name"), kind))
    if name_like:
        defs = defs.filter(F.col("name").like(name_like))
    if sort_by is None and limit is None:
        return defs
    by: list[Column] = []
    if sort_by is not None:
        column = sort_by.strip().lower()
        if column not in SORT_COLUMNS:
            raise ValueError(f"cannot sort by {sort_by}")
        by = [F.col(column).desc() if descending else F.col(column)]
    return sort_page(defs, by, ["name"], offset, limit)


def search_by_owners(defs: DataFrame, owners: DataFrame) -> DataFrame:
    """Names whose ``owner.userId`` is among the owners."""
    owned = defs.select("name", J.text_at(F.col("data"), "owner", "userId").alias("owner"))
    wanted = owners.select(F.trim("owner").alias("owner")).distinct()
    return join_hot(owned, wanted, ["owner"], "left_semi", ["name"]).select("name")


def fill_owner(df: DataFrame, owner: str = "owner") -> DataFrame:
    """Set ``owner.userId`` in ``data`` where it is missing or empty."""
    doc = F.coalesce("data", F.lit("{}"))
    current = J.text_at(doc, "owner", "userId")
    missing = F.coalesce(current, F.lit("")) == ""
    inner = F.coalesce(J.text_at(doc, "owner"), F.lit("{}"))
    with_user = J.merge_top_level(inner, F.to_json(F.struct(F.col(owner).alias("userId"))))
    # the inner object is spliced in as a member, not as text
    patch = F.concat(F.lit('{"owner":'), with_user, F.lit("}"))
    return df.withColumn("data", F.when(missing, J.merge_top_level(doc, patch)).otherwise(doc))


# Fixed value: the account that is never a real owner.  Service accounts of a site are added by the caller.
INVALID_OWNERS = ("root",)


def is_valid_owner(owner: Column, invalid: tuple[str, ...] = INVALID_OWNERS) -> Column:
    """Not blank, and not a known service account."""
    return F.coalesce((F.trim(owner) != "") & ~owner.isin(*invalid), F.lit(False))


def choose_owner(
    df: DataFrame,
    candidates: list[str],
    groups: list[str] | None = None,
    invalid: tuple[str, ...] = INVALID_OWNERS,
) -> DataFrame:
    """First valid candidate, else the first present one; for groups only a valid one."""
    valid = [F.when(is_valid_owner(F.col(c), invalid), F.col(c)) for c in candidates]
    out = df.withColumn("chosen_owner", F.coalesce(*valid, *[F.col(c) for c in candidates]))
    if groups:
        found = [F.when(is_valid_owner(F.col(c), invalid), F.col(c)) for c in groups]
        out = out.withColumn("chosen_group", F.coalesce(*found))
    return out


def invalid_owner_report(
    tables: DataFrame, by: list[str], invalid: tuple[str, ...] = INVALID_OWNERS
) -> DataFrame:
    """Tables with neither a valid owner nor a valid group, counted by the given columns."""
    bad = ~(is_valid_owner(F.col("owner"), invalid) | is_valid_owner(F.col("owner_group"), invalid))
    return tables.filter(bad).groupBy(*by).agg(F.count("*").alias("invalid"))


def soft_delete_data(
    data: DataFrame, marks: DataFrame, uris: DataFrame, user: str, at: Column
) -> DataFrame:
    """Marks after asking to delete some paths; an id marked before keeps its mark."""
    asked = join_hot(data.select("id", "uri"), uris.select("uri").distinct(), ["uri"], "left_semi", ["id"])
    fresh = asked.select("id").join(marks.select("id"), "id", "left_anti")
    return marks.select("id", "created_by", "date_created").unionByName(
        fresh.select("id", F.lit(user).alias("created_by"), at.alias("date_created"))
    )


def delete_metadata(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Documents without those of the given names or paths."""
    return docs.join(keys.select(key), key, "left_anti")


def stale_definitions(defs: DataFrame, name_like: str, before: Column) -> DataFrame:
    """Definitions of matching names last updated before a time."""
    return defs.filter(F.col("name").like(name_like) & (F.col("last_updated") < before))


def delete_stale(defs: DataFrame, name_like: str, before: Column) -> DataFrame:
    """Definitions left after deleting the stale ones."""
    return defs.filter(~F.coalesce(F.col("name").like(name_like) & (F.col("last_updated") < before), F.lit(False)))


def purge_deleted_data(
    data: DataFrame, marks: DataFrame, used: DataFrame, before: Column
) -> tuple[DataFrame, DataFrame]:
    """Data documents and marks left after the cleanup of old marks.

    Examined are paths marked before the time, and everything below those of them
    that are no partition path.  A document goes when no table or partition uses
    its path; every mark examined is cleared.  The examined paths are kept, as both
    outputs depend on them.
    """
    old = marks.filter(F.col("date_created") < before).select("id")
    marked = data.join(old, "id", "left_semi").select("uri")
    roots = marked.filter(~F.col("uri").contains("=")).withColumnRenamed("uri", "root")
    inner = any_below(data.filter("uri is not null"), roots, "uri", "root")
    examined = keep(marked.unionByName(inner).filter("uri is not null").distinct(), "examined")
    in_use = used.select("uri").filter("uri is not null")
    unused = examined.filter(F.col("uri") != "").join(in_use, "uri", "left_anti")
    kept = data.join(unused, "uri", "left_anti")
    examined_ids = data.join(examined, "uri", "left_semi").select("id")
    return kept, marks.join(examined_ids, "id", "left_anti")


# Fixed value: the catalog whose metadata is never obsolete.
PERMANENT_CATALOG = "rds"


def obsolete(docs: DataFrame, live: DataFrame) -> DataFrame:
    """Definitions of entities that no longer exist."""
    catalog = F.lower(F.substring_index("name", "/", 1))
    return docs.filter(catalog != PERMANENT_CATALOG).join(live.select("name"), "name", "left_anti")


def purge_obsolete_definitions(
    defs: DataFrame, tags: DataFrame, live: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Definitions and tags left after dropping those of entities that no longer exist."""
    gone = keep(obsolete(defs, live).select("name"), "obsolete")
    return defs.join(gone, "name", "left_anti"), tags.join(gone, "name", "left_anti")


def judge_renames(mapping: DataFrame) -> DataFrame:
    """``(old, new, ambiguous)``: every distinct rename, and whether its name has several targets or its target several
    names; null when neither."""
    pairs = mapping.select("old", "new").distinct()
    of = pairs.groupBy("old").agg((F.count("*") > 1).alias("_of"))
    to = pairs.groupBy("new").agg((F.count("*") > 1).alias("_to"))
    why = F.when(F.col("_of"), "several targets for one name").when(F.col("_to"), "several names for one target")
    return pairs.join(of, "old").join(to, "new").select("old", "new", why.alias("ambiguous"))


def ambiguous_renames(mapping: DataFrame) -> DataFrame:
    """``(old, new, ambiguous)``: renames of one name to several, and of several to one, with which it is."""
    return judge_renames(mapping).filter("ambiguous IS NOT NULL")


def rename_keys(docs: DataFrame, mapping: DataFrame, key: str, replace_target: bool) -> DataFrame:
    """Re-key documents by ``(old, new)``; with ``replace_target`` a row under the new key goes first.

    The source of a rename is never dropped as the target of another one.  Renames of
    :func:`ambiguous_renames` are left out, so no key is doubled.  The verdict is kept: it is read twice.
    """
    allowed = keep(judge_renames(mapping).filter("ambiguous IS NULL").select("old", "new"), "renames")
    return rename_allowed(docs, allowed, key, replace_target)


def rename_allowed(docs: DataFrame, allowed: DataFrame, key: str, replace_target: bool) -> DataFrame:
    """:func:`rename_keys` for renames that were judged before: no name and no target twice."""
    pairs = allowed.select(F.col("old").alias(key), F.col("new").alias("_new"))
    if replace_target:
        targets = allowed.select(F.col("new").alias(key)).join(pairs.select(key), key, "left_anti")
        docs = docs.join(targets, key, "left_anti")
    renamed = docs.join(pairs, key, "left")
    return renamed.withColumn(key, F.coalesce("_new", key)).drop("_new").select(*docs.columns)


def document_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names added, removed or changed between two document snapshots."""
    return diff(old.select("name", "data"), new.select("name", "data"), ["name"], ["data"])
