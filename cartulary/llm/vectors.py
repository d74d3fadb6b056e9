"""Embedding near-dedup over a robust-pruned flat graph, built and searched on overlapping cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import components, store

COSINE = 0.93
#: A cell is split while it is home to more vectors than this; queries of one task are as many.
CELL = 512
PIVOTS = 32  # vectors, on average, by which a cell is split
NEIGHBOURS = 16  # that pruning leaves to a node; links back come on top
ALPHA = 1.2
BEAM = 16
WIDEST = 8 * BEAM
RECALL = 0.98  # below it, on a cell's audited queries, the cell is searched with a wider beam, at last exactly
AUDITED = 8  # every eighth query of a cell is audited


def unit(column: str) -> Column:
    """The vector at length 1 in double precision; null for null, empty, zero and non-finite vectors."""

    @F.pandas_udf("array<double>")
    def each(found: pd.Series) -> pd.Series:
        made = []
        for v in found:
            x = np.array([] if v is None else v, dtype=float)  # a null component becomes NaN
            top = np.abs(x).max(initial=0.0)  # scaled by it, no square overflows
            x = x / top if 0 < top < np.inf else x
            made.append(x / np.sqrt((x * x).sum()) if 0 < top < np.inf else None)
        return pd.Series(made, dtype=object)

    return each(F.col(column).cast("array<double>"))


def split(members: DataFrame, cell: int = CELL) -> DataFrame:
    """``cell, key, home, m, v`` from ``cell, key, home, m, v``: cells over the limit split, again and again.

    A cell is split by vectors drawn from it: its members go to the nearest, and members at home there to the
    second nearest as guests.  Members that are as near to several are dealt by a hash, so a mass of equal
    directions splits too.  Large cells are worked on in pieces; each piece gets the drawn vectors.
    """
    level = 0
    while True:
        level += 1
        sizes = members.where("home").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell)
        sizes = store(sizes, "cells")
        if sizes.isEmpty():
            return members
        large = members.join(sizes, "cell").withColumn("draw", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(1 << 30)))
        drawn = large.where(F.col("home") & (F.col("draw") < F.lit(float(PIVOTS << 30)) / F.col("n")))
        pieces = F.ceil(F.col("n") / (8 * cell))
        drawn = drawn.select("cell", "key", "v", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
        dealt = large.withColumn("piece", F.pmod(F.col("draw"), pieces)).drop("n", "draw")

        def assign(name, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
            if rows.empty:
                return rows.drop(columns="piece")
            pivots = pivots.sort_values("key")
            count = max(2, len(pivots))
            if len(pivots) > 1:
                near = np.stack(rows["v"]) @ np.stack(pivots["v"]).T
                order = np.argsort(-near, axis=1, kind="stable")[:, :2]
                best = np.take_along_axis(near, order, axis=1)
                tied = best[:, 0] - best[:, 1] < 1e-9
            else:
                order, tied = np.zeros((len(rows), 2), dtype=np.int64), np.ones(len(rows), dtype=bool)
            spread = pd.util.hash_array(rows["key"].to_numpy() + level)
            order[tied, 0] = (spread % count)[tied]
            order[tied, 1] = ((order[:, 0] + 1 + spread // count % (count - 1)) % count)[tied]
            base = rows["cell"].astype(str) + "/"
            own = rows.assign(cell=base + pd.Series(order[:, 0], index=rows.index).astype(str))
            guest = rows.assign(cell=base + pd.Series(order[:, 1], index=rows.index).astype(str), home=False)
            return pd.concat([own, guest[rows["home"]]]).drop(columns="piece")

        schema = members.schema
        drawn = drawn.select(*[F.col(c).alias(c) for c in drawn.columns])  # apart from the members' columns
        divided = dealt.groupBy("cell", "piece").cogroup(drawn.groupBy("cell", "piece")).applyInPandas(assign, schema)
        members = store(members.join(sizes, "cell", "left_anti").select(*schema.names).union(divided), "members")


def prune(v: np.ndarray, most: int = NEIGHBOURS, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust-pruned neighbours of each vector: nearest first, leaving out what lies nearer to a neighbour
    already chosen than to the vector itself, by the factor alpha; free places go to the nearest left out."""
    n = len(v)
    near = v @ v.T
    far = np.sqrt(np.maximum(0.0, 2 - 2 * near))
    order = np.argsort(-near, axis=1, kind="stable")
    chosen = []
    for i in range(n):
        rest = order[i][order[i] != i]
        mine: list[int] = []
        left = rest
        while len(left) and len(mine) < most:
            mine.append(int(left[0]))
            left = left[1:]
            left = left[alpha * far[left, mine[-1]] > far[i, left]]
        spare = [int(j) for j in rest[:most] if j not in mine]
        chosen.append(np.array(mine + spare[: most - len(mine)], dtype=np.int64))
    return chosen


def entries(v: np.ndarray, links: list[np.ndarray]) -> list[int]:
    """The medoid of each connected part of the graph."""
    part = np.full(len(v), -1)
    found = []
    for i in range(len(v)):
        if part[i] >= 0:
            continue
        part[i], todo = i, [i]
        while todo:
            new = links[todo.pop()]
            new = new[part[new] < 0]
            part[new] = i
            todo += new.tolist()
        mine = np.flatnonzero(part == i)
        found.append(int(mine[(v[mine] @ v[mine].mean(axis=0)).argmax()]))
    return found


def exact(q: np.ndarray, v: np.ndarray, least: float, block: int = 256) -> Iterator[np.ndarray]:
    """All nodes with a product of ``least`` or more, for each row of ``q``."""
    for at in range(0, len(q), block):
        for near in q[at : at + block] @ v.T >= least:
            yield np.flatnonzero(near)


def search(q: np.ndarray, v: np.ndarray, links: list[np.ndarray], entry: int | list[int], least: float, beam: int) -> np.ndarray:
    """The nodes found with a product of ``least`` or more.

    Greedy from the entry, or from several: of the best ``beam`` nodes seen the best not yet opened is opened, until all are.
    Then the range expands: every node in range is opened too, and what it brings into range, till none is left.
    """
    at = np.unique(entry)
    seen, opened = dict(zip(at.tolist(), (v[at] @ q).tolist())), set()
    while True:
        best = sorted(seen, key=seen.get, reverse=True)[:beam]
        at = next((i for i in best if i not in opened), None)
        if at is None:
            break
        opened.add(at)
        new = [j for j in links[at].tolist() if j not in seen]
        if new:
            seen.update(zip(new, (v[new] @ q).tolist()))
    todo = [i for i, s in seen.items() if s >= least and i not in opened]
    while todo:
        at = todo.pop()
        opened.add(at)
        new = [j for j in links[at].tolist() if j not in seen]
        if new:
            near = (v[new] @ q).tolist()
            seen.update(zip(new, near))
            todo += [j for j, s in zip(new, near) if s >= least]
    return np.array([i for i, s in seen.items() if s >= least], dtype=np.int64)


FOUND = "kind string, key long, other long, cell string"


def _search_cell(graph: pd.DataFrame, queries: pd.DataFrame, least: float, beam: int) -> Iterator[tuple]:
    """What the queries find in one cell, as rows of ``FOUND``.

    links: the weight found among vectors at home here (each is at home in one cell, so nothing counts twice);
    edge: a spanning forest of what was found; visit: other cells where a found vector is a member.

    A query enters at its own node, if it has one here, and at the medoid of each connected part.  Every eighth
    query is first held against all vectors of the cell: below ``RECALL`` the beam is doubled, and where that
    does not help up to ``WIDEST``, all queries are held against all vectors.
    """
    graph = graph.sort_values("key").reset_index(drop=True)
    v, keys = np.stack(graph["v"]), graph["key"].to_numpy()
    place = {int(k): i for i, k in enumerate(keys)}
    around: list[set[int]] = [set() for _ in keys]
    for i, near in enumerate(graph["near"]):
        for k in near:
            j = place.get(int(k))
            if j is not None:
                around[i].add(j)
                around[j].add(i)
    links = [np.array(sorted(a), dtype=np.int64) for a in around]
    medoids = entries(v, links)
    weight, home = graph["m"].to_numpy(), graph["home"].to_numpy(dtype=bool)
    root: dict[int, int] = {}

    def top(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = k = root[root[k]]
        return k

    queries = queries.sort_values("key")
    asked, q = queries["key"].tolist(), np.stack(queries["v"])

    def near(i: int) -> np.ndarray:
        own = place.get(asked[i])
        return search(q[i], v, links, medoids if own is None else [own, *medoids], least, beam)

    audited = range(0, len(q), AUDITED)
    true = sum(map(len, exact(q[::AUDITED], v, least)))
    while True:
        known = {i: near(i) for i in audited}
        if sum(map(len, known.values())) >= RECALL * true:
            results = (known[i] if i in known else near(i) for i in range(len(q)))
            break
        beam *= 2
        if beam > WIDEST:
            results = exact(q, v, least)
            break
    for key, found in zip(asked, results):
        found = found[keys[found] != key]
        if not len(found):
            continue
        yield "links", key, int(weight[found][home[found]].sum()), None
        for k in keys[found].tolist():
            a, b = top(k), top(key)
            if a != b:
                root[max(a, b)] = min(a, b)
        for cell in {c for cells in graph["cells"].iloc[found] for c in cells}:
            yield "visit", key, None, cell
    for k in list(root):
        if top(k) != k:
            yield "edge", k, top(k), None


def near_vectors(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = COSINE, cell: int = CELL) -> DataFrame:
    """``id, n_links, component_id``: one row per row of ``rows``.

    Vectors link when their labels are equal and not null and their cosine is ``least`` or more; n_links counts
    the other vectors linked directly, component_id is the smallest id that links reach.  Vectors that are
    null, empty, zero or not finite, and those without a label, link with nothing.  Vectors of another length
    than their label's others are zero-padded.  Equal vectors are one node of the graph that counts each of
    them, so copies, however many, cost nothing.  Null ids are never the smallest if there is another.

    A query starts in the cells it belongs to and visits every cell where something it found is a member, round
    after round, till no visit is new.  In each cell some queries are audited, and a cell whose audit stays below
    ``RECALL`` is searched exactly.
    """
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    given = rows.select(F.col(id).alias("id"), F.col(label).cast("string").alias("label"), unit(vector).alias("v"))
    nodes = given.where(sound).groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("m"))
    nodes = store(nodes.withColumn("key", F.monotonically_increasing_id()), "nodes")
    width = nodes.groupBy("label").agg(F.max(F.size("v")).alias("width"))
    padded = nodes.join(width, "label").withColumn(
        "v", F.concat("v", F.array_repeat(F.lit(0.0), (F.col("width") - F.size("v")).cast("int")))
    )
    members = split(store(padded.select(F.col("label").alias("cell"), "key", F.lit(True).alias("home"), "m", "v"), "members"), cell)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["key"].to_numpy()
        return pd.DataFrame({"key": keys, "near": [keys[j] for j in prune(np.stack(group["v"]))]})

    lists = members.groupBy("cell").applyInPandas(build, "key long, near array<long>")
    united = lists.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    cells = members.groupBy("key").agg(F.collect_set("cell").alias("cells"))
    graph = store(members.join(united, "key").join(cells, "key"), "graph")
    found = _rounds(graph, least, BEAM, cell)

    links = found.where("kind = 'links'").groupBy("key").agg(F.sum("other").alias("n"))
    roots = components(found.where("kind = 'edge'").select(F.col("key").alias("a"), F.col("other").alias("b")))
    placed = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least_id = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = placed.join(least_id, "root").join(links, "key", "left").select(
        F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"
    )
    linked = given.where(sound).join(placed, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")))
    alone = given.where(~F.coalesce(sound, F.lit(False)))
    return linked.select(F.col("id").alias(id), "n_links", "component_id").union(
        alone.select("id", F.lit(0).cast("long"), "id")
    )


def _rounds(graph: DataFrame, least: float, beam: int, cell: int) -> DataFrame:
    """All rows found."""

    def search_group(name, nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        made = _search_cell(nodes, queries, least, beam) if len(queries) and len(nodes) else ()
        return pd.DataFrame(made, columns=["kind", "key", "other", "cell"]).astype({"key": "int64", "other": "Int64"})

    vectors = graph.where("home").select("key", "v")
    queries = graph.select("cell", "key")
    done, found = queries, None
    while True:
        asked = store(queries.groupBy("cell").agg(F.ceil(F.count("*") / (8 * cell)).alias("pieces")), "asked")
        if asked.isEmpty():
            break
        pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece")
        nodes = graph.join(asked.select("cell", pieces), "cell")
        dealt = queries.join(asked, "cell").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces"))).join(vectors, "key")
        dealt = dealt.select(*[F.col(c).alias(c) for c in ("cell", "piece", "key", "v")])  # apart from the graph's columns
        now = store(
            nodes.groupBy("cell", "piece")
            .cogroup(dealt.groupBy("cell", "piece"))
            .applyInPandas(search_group, FOUND),
            "found",
        )
        found = now if found is None else found.union(now)
        visits = now.where("kind = 'visit'").select("cell", "key").distinct()
        queries = store(visits.join(done, ["cell", "key"], "left_anti"), "visits")
        done = done.union(queries)
    if found is None:
        found = graph.sparkSession.createDataFrame([], FOUND)
    return found
