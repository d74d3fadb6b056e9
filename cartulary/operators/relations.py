"""Parent and child tables: edges ``(parent, parent_uuid, child, child_uuid, relation_type)``."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.ranges import in_ranges, running_sums
from ..functions.skew import join_hot
from ..session import keep
from .metadata import judge_renames

# Fixed value: children a parent may have per relation type when nothing else is said.
DEFAULT_LIMIT = 5


def parents_of(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges whose child is among the names."""
    return edges.join(names.select(F.col("name").alias("child")), "child", "left_semi")


def children_of(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges whose parent is among the names; a parent may own very many children."""
    wanted = names.select(F.col("name").alias("parent")).distinct()
    return join_hot(edges, wanted, ["parent"], "left_semi", ["child"])


def relation_flags(names: DataFrame, edges: DataFrame) -> DataFrame:
    """``is_parent`` and ``is_child`` per name."""
    ends = edges.select(F.col("parent").alias("name"), F.lit(True).alias("p"), F.lit(False).alias("c"))
    ends = ends.unionByName(
        edges.select(F.col("child").alias("name"), F.lit(False).alias("p"), F.lit(True).alias("c"))
    )
    flags = ends.groupBy("name").agg(F.max("p").alias("p"), F.max("c").alias("c"))
    return names.select("name").join(flags, "name", "left").select(
        "name",
        F.coalesce("p", F.lit(False)).alias("is_parent"),
        F.coalesce("c", F.lit(False)).alias("is_child"),
    )


def children_per_type(edges: DataFrame) -> DataFrame:
    """Children of each parent by relation type."""
    return edges.groupBy("parent", "relation_type").agg(F.count("*").alias("children"))


def effective_limit(
    pairs: DataFrame,
    table_limits: DataFrame,
    database_limits: DataFrame,
    type_limits: DataFrame,
    default: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Limit of each ``(parent, relation_type)``: of the table, else its database, else the type, else the default.

    A negative limit means none.
    """
    placed = pairs.withColumn("database_name", F.get(F.split("parent", "/"), F.lit(1)))
    out = placed.join(
        table_limits.select("parent", "relation_type", F.col("max").alias("_t")), ["parent", "relation_type"], "left"
    )
    out = join_hot(
        out,
        database_limits.select("database_name", "relation_type", F.col("max").alias("_d")),
        ["database_name", "relation_type"],
        "left",
        ["parent"],
        counted=placed,
    )
    of_type = type_limits.select("relation_type", F.col("max").alias("_r"))
    out = join_hot(out, of_type, ["relation_type"], "left", ["parent"], counted=placed)
    chosen = F.coalesce("_t", "_d", "_r", F.lit(default)).cast("bigint")
    return out.withColumn("max_children", chosen).drop("_t", "_d", "_r", "database_name")


# What an edge is.
EDGE = ["parent", "parent_uuid", "child", "child_uuid", "relation_type"]

# Why a proposed edge is refused, in the order in which the rules are tried.
HAS_PARENT = "child already has a parent"
IS_CHILD = "parent is itself a child"
HAS_CHILDREN = "child already has children"
PARENT_UUID = "parent uuid differs"
CHILD_UUID = "child uuid differs"
TOO_MANY = "too many children"


def _known_names(edges: DataFrame) -> DataFrame:
    """Per name that takes part in an edge: whether as child, as parent, and its lowest and highest uuid."""
    as_child = edges.groupBy(F.col("child").alias("name")).agg(
        F.lit(True).alias("is_child"),
        F.min("child_uuid").alias("c_lo"),
        F.max("child_uuid").alias("c_hi"),
    )
    as_parent = edges.groupBy(F.col("parent").alias("name")).agg(
        F.lit(True).alias("is_parent"),
        F.min("parent_uuid").alias("p_lo"),
        F.max("parent_uuid").alias("p_hi"),
    )
    return as_child.join(as_parent, "name", "full").select(
        "name",
        F.coalesce("is_child", F.lit(False)).alias("is_child"),
        F.coalesce("is_parent", F.lit(False)).alias("is_parent"),
        F.least("c_lo", "p_lo").alias("lo"),
        F.greatest("c_hi", "p_hi").alias("hi"),
    )


def _at_ends(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with what is known of the names at both ends, as ``child_…`` and ``parent_…`` columns."""

    def about(end: str) -> DataFrame:
        return facts.select(F.col("name").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in facts.columns if c != "name"])

    out = rows.join(about("child"), "child", "left")
    return join_hot(out, about("parent"), ["parent"], "left", ["child"], counted=rows)


def _against_stored(edges: DataFrame, proposed: DataFrame, limits: DataFrame) -> DataFrame:
    """Proposed edges with what is stored at their ends, their parent's ``children`` and its ``limit``."""
    out = _at_ends(proposed, _known_names(edges))
    group = ["parent", "relation_type"]
    per_type = children_per_type(edges).join(limits.select(*group, "max_children"), group, "full")
    out = join_hot(out, per_type, group, "left", ["child"], counted=proposed)
    return out.withColumns(
        {"limit": F.coalesce("max_children", F.lit(DEFAULT_LIMIT)).cast("bigint"), "children": F.coalesce("children", F.lit(0))}
    )


def _other_uuid(end: str) -> Column:
    lo, hi, mine = F.col(f"{end}_lo"), F.col(f"{end}_hi"), F.col(f"{end}_uuid")
    return lo.isNotNull() & ((lo != hi) | (lo != mine))


def _stored_reason() -> Column:
    """The first rule that a row of :func:`_against_stored` breaks, null if none."""
    return (
        F.when(F.col("child_is_child"), HAS_PARENT)
        .when(F.col("parent_is_child"), IS_CHILD)
        .when(F.col("child_is_parent"), HAS_CHILDREN)
        .when(_other_uuid("parent"), PARENT_UUID)
        .when(_other_uuid("child"), CHILD_UUID)
        .when((F.col("limit") >= 0) & (F.col("children") >= F.col("limit")), TOO_MANY)
    )


def validate_new_edges(edges: DataFrame, proposed: DataFrame, limits: DataFrame) -> DataFrame:
    """Proposed edges with the first rule each breaks against the stored edges, null when fine.

    ``limits`` is ``(parent, relation_type, max_children)``, see :func:`effective_limit`.
    Everything known about a name is folded to one row before it is joined.  Each edge is judged on its own;
    :func:`validate_in_turn` also judges them against one another.
    """
    return _against_stored(edges, proposed, limits).withColumn("reason", _stored_reason()).select(*proposed.columns, "reason")


def _by_name(rows: DataFrame) -> DataFrame:
    """Per name, when the first accepted and the first open row names it as child (``ca, co``) and as parent
    (``pa, po``), and with which uuids as parent: the accepted one, the lowest and the highest open one.

    ``rows`` has edges with ``at`` and ``taken`` (accepted, else open).  All accepted rows of a parent have one uuid.
    """
    ends = rows.select("at", "taken", F.explode(F.array(
        F.struct(F.col("child").alias("name"), F.lit(False).alias("top"), F.lit(None).cast("string").alias("uuid")),
        F.struct(F.col("parent").alias("name"), F.lit(True).alias("top"), F.col("parent_uuid").alias("uuid")),
    )).alias("end")).select("at", "taken", "end.*")
    top, taken, at, uuid = F.col("top"), F.col("taken"), F.col("at"), F.col("uuid")
    return ends.groupBy("name").agg(
        F.min(F.when(~top & taken, at)).alias("ca"), F.min(F.when(~top & ~taken, at)).alias("co"),
        F.min(F.when(top & taken, at)).alias("pa"), F.min(F.when(top & ~taken, at)).alias("po"),
        F.min(F.when(top & taken, uuid)).alias("p_uuid"),
        F.min(F.when(top & ~taken, uuid)).alias("o_lo"), F.max(F.when(top & ~taken, uuid)).alias("o_hi"),
    )


def validate_in_turn(edges: DataFrame, proposed: DataFrame, limits: DataFrame, order: str = "seq") -> DataFrame:
    """Proposed edges with the first rule each breaks against the stored edges and all accepted ones before it.

    ``proposed`` has the columns of an edge and ``order``; ties go by the edge itself, and of equal rows the first
    counts.  The result has these columns and ``reason`` (null: accepted), one row per row proposed.

    Edges are judged in rounds.  One is refused once an accepted edge before it forbids it, and accepted once
    nothing open before it could: an edge with the same child, with one of its ends as its other end, or one of
    its parent where the open ones spell several uuids.  Children of a parent are counted by running sums of sure and of possible ones,
    which settle an edge as soon as both sides of the limit agree; so many edges of one parent take no more rounds,
    and may lie in many tasks.  Rounds are as many as the longest chain of edges that wait for one another, each
    over the open edges only.  Reasons are told at the end, when it is known what was accepted.
    """
    key = F.struct(order, *EDGE)
    once = proposed.select(order, *EDGE).groupBy(order, *EDGE).agg(F.count("*").alias("_copies")).withColumn("at", key)
    against = keep(_against_stored(edges, once, limits).withColumn("stored", _stored_reason()), "proposed")
    left = F.when(F.col("limit") >= 0, F.col("limit") - F.col("children"))
    open_ = against.filter("stored IS NULL").select("at", *EDGE, left.alias("left"))
    columns = ["at", *EDGE, "left"]
    done: list[DataFrame] = []
    while not open_.isEmpty():
        seen = open_.withColumn("taken", F.lit(False))
        for d in done:
            seen = seen.unionByName(d.withColumn("taken", F.lit(True)))
        judged = keep(_round(seen, open_).select(*columns, "verdict"), "judged")
        done.append(judged.filter("verdict = 'accepted'").select(*columns))
        open_ = judged.filter("verdict = 'open'").select(*columns)
        if len(done) == 8:
            every = reduce(DataFrame.unionByName, done)
            done = [keep(every, "accepted")]
    accepted = reduce(DataFrame.unionByName, done) if done else open_
    facts = keep(_by_name(accepted.withColumn("taken", F.lit(True))).select("name", "ca", "pa", "p_uuid"), "names")
    told = _at_ends(against, facts)
    at = F.col("at")
    reason = (
        F.when(F.col("child_ca") == at, None)
        .when(F.col("child_is_child") | (F.col("child_ca") < at), HAS_PARENT)
        .when(F.col("parent_is_child") | (F.col("parent_ca") < at), IS_CHILD)
        .when(F.col("child_is_parent") | (F.col("child_pa") < at), HAS_CHILDREN)
        .when(_other_uuid("parent") | ((F.col("parent_pa") < at) & (F.col("parent_p_uuid") != F.col("parent_uuid"))), PARENT_UUID)
        .when(_other_uuid("child"), CHILD_UUID)
        .otherwise(TOO_MANY)
    )
    numbered = told.withColumn("reason", reason).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    again = F.when((F.col("_copy") > 1) & F.col("reason").isNull(), HAS_PARENT).otherwise(F.col("reason"))
    return numbered.select(order, *EDGE, again.alias("reason"))


def _round(seen: DataFrame, open_: DataFrame) -> DataFrame:
    """The open edges with a ``verdict``: accepted, refused or still open."""
    rows = _at_ends(open_, keep(_by_name(seen), "names"))
    at, mine = F.col("at"), F.col("parent_uuid")

    def before(column: str) -> Column:
        return F.coalesce(F.col(column) < at, F.lit(False))

    refused = (
        before("child_ca") | before("parent_ca") | before("child_pa")
        | (before("parent_pa") & F.coalesce(F.col("parent_p_uuid") != mine, F.lit(False)))
    )
    # a parent with several uuids: its first open edge settles which one stays
    several = F.coalesce(F.col("parent_o_lo") != F.col("parent_o_hi"), F.lit(False))
    waits = before("child_co") | before("parent_co") | before("child_po") | (several & before("parent_po"))
    state = F.when(refused, "refused").when(waits, "open").otherwise("accepted")
    rows = keep(rows.withColumn("state", state).select("at", *EDGE, "left", "state"), "states")
    # only where a parent's candidates are more than it may take does their order matter
    group = ["parent", "relation_type"]
    limited = rows.filter("left IS NOT NULL AND state <> 'refused'")
    earlier = seen.filter("taken AND left IS NOT NULL")
    counted = limited.select("at", *group, "left", F.lit(True).alias("candidate"), (F.col("state") == "accepted").alias("sure"))
    counted = counted.unionByName(earlier.select("at", *group, "left", F.lit(False).alias("candidate"), F.lit(True).alias("sure")))
    tight = counted.groupBy(*group).agg(F.count("*").alias("_n"), F.min("left").alias("_left")).filter("_n > _left").select(*group)
    ranged = in_ranges(join_hot(counted, tight, group, "left_semi", ["at"]), [*group, "at"], "_range")
    sums = running_sums(ranged, group, ["at"], "_range", {"sure_n": F.col("sure").cast("bigint"), "all_n": F.lit(1).cast("bigint")})
    full = (F.col("sure_n") - F.col("sure").cast("bigint")) >= F.col("left")
    room = (F.col("all_n") - 1) < F.col("left")
    settled = sums.filter("candidate").select("at", full.alias("full"), room.alias("room"))
    verdict = (
        F.when((F.col("state") == "refused") | F.col("full"), "refused")
        .when((F.col("state") == "accepted") & F.coalesce("room", F.lit(True)), "accepted")
        .otherwise("open")
    )
    return rows.join(settled, "at", "left").withColumn("verdict", verdict)


def judge_edge_renames(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(old, new, reason)``: every distinct rename and why it is refused, null if it is not."""
    taken = edges.select(F.col("parent").alias("new")).unionByName(edges.select(F.col("child").alias("new"))).distinct()
    judged = judge_renames(mapping).join(taken.withColumn("_taken", F.lit(True)), "new", "left")
    reason = F.when(F.col("_taken"), "target in an edge").otherwise(F.col("ambiguous"))
    return judged.select("old", "new", reason.alias("reason"))


def refused_renames(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(old, new, reason)``: renames whose new name takes part in an edge already, and ambiguous ones."""
    return judge_edge_renames(edges, mapping).filter("reason IS NOT NULL")


def rename_ends(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges after allowed renames ``(old, new)``, on both ends."""
    out = edges
    for end, other in (("parent", "child"), ("child", "parent")):
        pairs = allowed.select(F.col("old").alias(end), F.col("new").alias("_new"))
        out = join_hot(out, pairs, [end], "left", [other], counted=edges)  # the other end is still as it was
        out = out.withColumn(end, F.coalesce("_new", end)).drop("_new")
    return out.select(*edges.columns)


def rename_entity(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after renaming tables by ``(old, new)``; what :func:`refused_renames` tells is left out."""
    allowed = keep(judge_edge_renames(edges, mapping).filter("reason IS NULL").select("old", "new"), "renames")
    return rename_ends(edges, allowed)


def drop_entity(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges left after dropping tables, whichever end they were on."""
    gone = names.select("name").distinct()
    out = join_hot(edges, gone.withColumnRenamed("name", "parent"), ["parent"], "left_anti", ["child"])
    return out.join(gone.withColumnRenamed("name", "child"), "child", "left_anti").select(*edges.columns)
