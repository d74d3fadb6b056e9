"""The search index: documents ``(name, kind, body, user, deleted, updated_at, run)``."""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions import documents as J
from ..functions.skew import join_hot
from ..session import keep
from .resolve import ancestors

# Members of a definition document that are searchable.
SEARCHABLE = (
    "owner",
    "tags",
    "data_hygiene",
    "lifetime",
    "extendedSchema",
    "data_dependency",
    "table_cost",
    "lifecycle",
    "audience",
    "model",
    "subject_area",
    "subjectAreas",
    "data_category",
    "job",
    "table_description",
    "data_management",
)


def searchable_definition(document: Column) -> Column:
    """The searchable members of a definition document."""
    members = J.as_top_level(document)
    return F.to_json(F.map_filter(members, lambda k, _: k.isin(*SEARCHABLE)))


def empty_as_null(document: Column) -> Column:
    """``{}`` is indexed as null."""
    return F.when(F.regexp_replace(document, r"\s", "") != "{}", document)


def build_search_docs(entities: DataFrame, defs: DataFrame, run: str, at: Column) -> DataFrame:
    """One live document per entity, with its definition metadata.

    ``entities`` is ``(name, kind, body, created_by)``; without a creator the user
    is ``admin``.
    """
    known = defs.select("name", F.col("data").alias("_def"))
    joined = entities.join(known, "name", "left")
    return joined.select(
        "name",
        "kind",
        empty_as_null(F.col("body")).alias("body"),
        searchable_definition(F.col("_def")).alias("searchable"),
        F.coalesce("created_by", F.lit("admin")).alias("user"),
        F.lit(False).alias("deleted"),
        at.alias("updated_at"),
        F.lit(run).alias("run"),
    )


def tokens(body: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


# The fields that a search looks into.
SEARCHED = ("name", "body", "searchable", "user")


def _tables(docs: DataFrame) -> DataFrame:
    """Live table documents with ``_text``: all that is searched, one field a line."""
    text = F.concat_ws("\n", *[c for c in SEARCHED if c in docs.columns])
    live = docs.filter(~F.col("deleted"))
    return (live.filter("kind = 'table'") if "kind" in docs.columns else live).withColumn("_text", text)


def search_docs(docs: DataFrame, term: str) -> DataFrame:
    """Live table documents holding the word in any field, in one scan without a shuffle.

    The boundary test runs in generated code and needs no token array.
    """
    word = r"(?<![\p{L}\p{N}_])" + re.escape(term.lower()) + r"(?![\p{L}\p{N}_])"
    return _tables(docs).filter(F.lower("_text").rlike(word)).drop("_text")


def search_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, name)`` for many words at once, over an inverted index.

    Common words fill a large share of the index, so the join on them is spread.
    """
    index = _tables(docs).select("name", F.explode(tokens(F.col("_text"))).alias("term"))
    wanted = terms.select(F.lower("term").alias("term")).distinct()
    return join_hot(index, wanted, ["term"], "inner", ["name"])


def docs_under(docs: DataFrame, roots: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Live documents in the named subtrees but not in the excluded ones.

    Names unfold once: included and excluded roots meet them in the same join, and
    each name folds to two flags.
    """
    live = docs.filter(~F.col("deleted"))
    marks = roots.select("root", F.lit(True).alias("_in"), F.lit(False).alias("_out"))
    if excluded is not None:
        out = excluded.select("root", F.lit(False).alias("_in"), F.lit(True).alias("_out"))
        marks = marks.unionByName(out)
    flags = [F.max("_in").alias("_in"), F.max("_out").alias("_out")]
    unfolded = live.select("name", F.explode(ancestors(F.col("name"), include_self=True)).alias("root"))
    met = join_hot(unfolded, marks.groupBy("root").agg(*flags), ["root"], "inner", ["name"])
    chosen = met.groupBy("name").agg(*flags).filter(F.col("_in") & ~F.col("_out"))
    return live.join(chosen.select("name"), "name", "left_semi")


def unmarked(
    docs: DataFrame, run: str, started: Column, roots: DataFrame, excluded: DataFrame | None = None
) -> DataFrame:
    """Live documents of the subtrees that this run has not touched."""
    other_run = F.coalesce(F.col("run") != run, F.lit(True))
    return docs_under(docs.filter((F.col("updated_at") <= started) & other_run), roots, excluded)


def reconcile_targets(stale: DataFrame, live: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """Unmarked documents whose entity is truly gone, all of them, with ``held_back``: why one is not deleted yet.

    ``most`` bounds how many unmarked documents of a kind one run may delete; a kind above its bound is held back
    whole.  Kinds without a bound never are.  The counts are one row per kind.
    """
    gone = stale.join(live.select("name"), "name", "left_anti")
    if not most:
        return gone.withColumn("held_back", F.lit(None).cast("string"))
    limits = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    counts = stale.groupBy("kind").agg(F.count("*").alias("_n")).withColumn("_most", F.try_element_at(limits, "kind"))
    why = F.format_string("%d unmarked, %d allowed", F.col("_n"), F.col("_most"))
    over = counts.filter(F.col("_n") > F.col("_most")).select("kind", why.alias("held_back"))
    return join_hot(gone, over, ["kind"], "left", ["name"], counted=stale)


def soft_delete_docs(docs: DataFrame, names: DataFrame, user: str, at: Column) -> DataFrame:
    """Mark documents deleted, by whom and when."""
    hit = names.select("name", F.lit(True).alias("_hit")).distinct()
    joined = docs.join(hit, "name", "left")
    return joined.withColumns(
        {
            "deleted": F.coalesce("_hit", F.lit(False)) | F.col("deleted"),
            "user": F.when(F.col("_hit"), F.lit(user)).otherwise(F.col("user")),
            "updated_at": F.when(F.col("_hit"), at).otherwise(F.col("updated_at")),
        }
    ).drop("_hit")


def reconcile(
    docs: DataFrame,
    live: DataFrame,
    run: str,
    started: Column,
    roots: DataFrame,
    excluded: DataFrame | None,
    user: str,
    at: Column,
    most: dict[str, int] | None = None,
) -> DataFrame:
    """The index after soft-deleting what a refresh did not find; what is held back stays."""
    gone = reconcile_targets(unmarked(docs, run, started, roots, excluded), live, most).filter("held_back IS NULL")
    return soft_delete_docs(docs, gone, user, at)


def reconcile_stores(
    docs: DataFrame,
    defs: DataFrame,
    tags: DataFrame,
    live: DataFrame,
    run: str,
    started: Column,
    roots: DataFrame,
    excluded: DataFrame | None,
    user: str,
    at: Column,
    most: dict[str, int] | None = None,
) -> dict[str, DataFrame]:
    """A reconciliation carried through all stores: ``docs``, ``defs``, ``tags``, ``held_back`` and ``gone``.

    Databases and tables that a refresh did not find and that are truly gone are marked deleted in the index,
    lose their definitions and, tables only, their tags; a table's partitions lose their definitions with it, and
    their documents go for good.  A kind that is held back (see :func:`reconcile_targets`) loses nothing anywhere, and
    ``held_back`` tells why.  The verdict is kept once for all stores, so each of them takes it whole or not at all.
    """
    entities = docs.filter(F.col("kind").isin("database", "table"))
    verdict = keep(
        reconcile_targets(unmarked(entities, run, started, roots, excluded), live, most).select("name", "kind", "held_back"), "reconcile"
    )
    gone = verdict.filter("held_back IS NULL").select("name", "kind")
    tables = gone.filter("kind = 'table'").select(F.col("name").alias("_table"))
    table_of = F.substring_index("name", "/", 3)

    def without_partitions(df: DataFrame) -> DataFrame:
        # names with a fourth step are partitions; a table may own very many
        inner = F.when(F.size(F.split("name", "/")) > 3, table_of)
        return join_hot(df.withColumn("_table", inner), tables, ["_table"], "left_anti", ["name"]).select(*df.columns)

    left = without_partitions(docs)
    return {
        "docs": soft_delete_docs(left, gone, user, at),
        "defs": without_partitions(defs).join(gone.select("name"), "name", "left_anti").select(*defs.columns),
        "tags": tags.join(gone.filter("kind = 'table'").select("name"), "name", "left_anti").select(*tags.columns),
        "held_back": verdict.filter("held_back IS NOT NULL"),
        "gone": gone,
    }


def propagate_same_uri(docs: DataFrame, updated: DataFrame) -> DataFrame:
    """Copy the data document of updated tables to every other one with the same path.

    ``updated`` is ``(name, uri, data_metadata, user, updated_at)``.  Several updates of
    one path fold to the latest before the join, and a path shared by very many
    documents is spread.
    """
    version = F.struct("updated_at", "name")
    latest = updated.filter("uri is not null and uri != ''").groupBy("uri").agg(
        F.max_by(F.struct("name", "data_metadata", "user", "updated_at"), version).alias("_u")
    )
    joined = join_hot(docs, latest, ["uri"], "left", ["name"])
    other = F.coalesce(F.col("_u.name") != F.col("name"), F.lit(False))
    changed = {
        c: F.when(other, F.col(f"_u.{c}")).otherwise(F.col(c)) for c in ("data_metadata", "user", "updated_at")
    }
    return joined.withColumns(changed).select(*docs.columns)


def traverse(
    tables: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """Every catalog, database and table to refresh, as ``(name, kind)``.

    One scan of the inventory takes the place of a walk; names in the lists match
    an entity or anything below it.
    """
    levels = {
        "catalog": F.col("catalog_name"),
        "database": F.concat_ws("/", "catalog_name", "database_name"),
        "table": F.col("name"),
    }
    entries = tables.select(
        F.explode(F.array(*[F.struct(n.alias("name"), F.lit(k).alias("kind")) for k, n in levels.items()])).alias("e")
    ).select("e.*")

    def under(names: list[str]) -> Column:
        hit = F.lit(False)
        for n in names:
            hit = hit | (F.col("name") == n) | F.col("name").startswith(n + "/")
        return hit

    if include:
        entries = entries.filter(under(include))
    if exclude:
        entries = entries.filter(~under(exclude))
    return entries.distinct()
