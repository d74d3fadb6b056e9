"""Mixing sources to target weights by subset-sum budget fitting over exact lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .common import free, store, text_of, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 10
#: The part of a budget that dynamic programming fits exactly, in words (or one shortest document more).
FINE = 4096


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, fine: int = FINE) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum as near to ``budget`` as found.

    All lengths first give the same share of their documents, until about ``fine`` is left; longest first,
    further documents make up for rounding; the rest is a bounded knapsack over the documents left, solved
    exactly.  A budget below ``fine`` is solved exactly as a whole.  ``lengths`` are distinct and positive.  The work depends on the number of distinct
    lengths and on ``fine``, never on the number of documents.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    total = int(sum(int(n) * int(c) for n, c in zip(lengths, counts)))
    if budget <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * max(0, budget - fine) // total for c in counts], dtype=np.int64)
    rest = budget - int((taken * lengths).sum())
    order = np.argsort(-lengths)
    for i in order:
        more = min(int(counts[i] - taken[i]), max(0, rest - fine) // int(lengths[i]))
        taken[i] += more
        rest -= more * int(lengths[i])
    # reachable sums as the bits of an integer, one integer for each pack of equal lengths
    packs: list[tuple[int, int]] = []
    for i in order:
        left, size = min(int(counts[i] - taken[i]), 2 * rest // int(lengths[i])), 1
        while left > 0:
            packs.append((i, min(size, left)))
            left -= size
            size *= 2
    within, reach = (1 << (2 * rest + 1)) - 1, [1]
    for i, n in packs:
        reach.append((reach[-1] | (reach[-1] << (n * int(lengths[i])))) & within)
        if reach[-1] >> rest & 1:
            break
    at = (reach[-1] & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> rest
    over = rest + (above & -above).bit_length() - 1 if above else None
    if over is not None and over - rest < rest - at:
        at = over
    for k in range(len(reach) - 1, 0, -1):
        if not reach[k - 1] >> at & 1:
            i, n = packs[k - 1]
            taken[i] += n
            at -= n * int(lengths[i])
    return taken


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows, one row per source.

    Sources in order of their code points, null last, take the weights in turn.  A target is
    ``min(most * size, level * weight)``, where one level makes all targets sum to ``share`` of all sizes:
    that is where sharing the excess again and again ends.  Windows here run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    cap = F.col("source_size") * float(most)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * float(share) - full) / open_weight
    steps = per.withColumn("cap", cap).withColumn("level", level)
    # the first source, by its own limit, that the level no longer fills is where the level is right
    stops = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    right = F.first(stops, ignorenulls=True).over(everything)
    return steps.select(
        "source", "source_size", F.coalesce(F.least("cap", right * F.col("weight")), F.col("cap")).alias("target")
    )


def seeded(id: str, text: str, seed: int = SEED) -> Column:
    """A document's place in the seeded order, from its id and text alone."""
    return F.xxhash64(F.lit(seed), F.col(id), text_of(text))


def mix_plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, size, source_size, target, copies, top``: for each source and exact length, how many whole
    copies all documents give, and the highest place in the seeded order that gives one more.

    ``rows`` has ``source, size, place``.  Only counts by exact length reach the fitting, one group per source
    with at most as many rows as there are lengths.  The place of the k-th document of a length is found
    without sorting the length's documents in one task: places are counted in about the square root of n
    equal ranges, and only the range that holds the k-th is ranked.
    """
    hist = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    aims = targets(rows, weights, share, most)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = min(int(target // total), int(most)) if total else 0
        budget = int(round(target - whole * total)) if whole < most else 0
        more = np.zeros(len(group), dtype=np.int64)
        real = (group["size"] > 0).to_numpy()
        more[real] = fit_counts(group["size"].to_numpy()[real], group["n"].to_numpy()[real], budget)
        return group.assign(copies=whole, more=more)

    schema = "source string, size long, n long, source_size long, target double, copies long, more long"
    fitted = (
        hist.join(aims, hist["source"].eqNullSafe(aims["source"]))
        .select(hist["source"], "size", "n", "source_size", "target")
        .groupBy("source")
        .applyInPandas(fit, schema)
    )
    fitted = store(fitted, "fitted")
    some = fitted.where("more > 0 and more < n")
    ranges = F.ceil(F.sqrt("n"))
    # the top 52 bits of the place as a number in [0, 1)
    part = F.floor((F.shiftright("place", 12) / F.lit(float(1 << 52)) + 0.5) * ranges)
    r, s = rows.alias("r"), some.alias("s")
    placed = (
        r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.size") == F.col("s.size")))
        .select("s.source", "s.size", "s.more", "r.place", part.alias("part"))
    )
    counted = placed.groupBy("source", "size", "more", "part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("part"))
    cut = counted.withColumn("upto", upto).where("upto >= more and upto - n < more").select(
        F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("part").alias("c_part"),
        (F.col("more") - F.col("upto") + F.col("n")).alias("rank"),
    )
    here = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("part") == F.col("c_part"))
    ranked = placed.join(cut, here).withColumn(
        "at", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("place"))
    )
    tops = ranked.where("at = rank").select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("place").alias("top"))
    f, t = fitted.alias("f"), tops.alias("t")
    return f.join(
        t, F.col("f.source").eqNullSafe(F.col("t.c_source")) & (F.col("f.size") == F.col("t.c_size")), "left"
    ).select(
        "f.source", "f.size", "source_size", "target", "copies",
        F.when(F.col("more") >= F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.col("top")).alias("top"),
    )


def mix_sources(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
) -> DataFrame:
    """``id, source, size, source_size, target, taken``: one row per row of ``docs``.

    size is the text's number of words (null: 0), taken the words the mix takes of it: a whole number of
    copies, ``most`` at most.  A null source is a source.  Documents without words take nothing.  Rows that
    repeat id and text stand or fall together, as their place in the seeded order is one.  The result
    depends on the rows alone, not on their order or partitions.  An empty table gives an empty result.
    """
    rows = store(
        docs.select(
            F.col(id).alias("id"), F.col(source).cast("string").alias("source"),
            word_count(text).alias("size"), seeded(id, text, seed).alias("place"),
        ),
        "sizes",
    )
    plan = mix_plan(rows, weights, share, most)
    r, p = rows.alias("r"), plan.alias("p")
    taken = F.col("r.size") * (F.col("copies") + F.coalesce((F.col("r.place") <= F.col("top")).cast("long"), F.lit(0)))
    return r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size"))).select(
        F.col("r.id").alias(id), "r.source", "r.size", "source_size", "target", taken.alias("taken")
    )


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as it is taken.  Columns are those of ``docs``,
    whatever their names (dots and the operator's own ones too); a null source is a source, and rows without words
    (null, empty or blank texts) are never taken.  An empty table gives an empty one."""
    seed = how.pop("seed", SEED)
    facts = F.struct(F.col(source).cast("string").alias("source"), word_count(text).alias("size"), seeded(id, text, seed).alias("place"))
    rows = store(docs.select(facts.alias("f")).select("f.*"), "sizes")
    plan = mix_plan(rows, **how).select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies"), F.col("top").alias("_top")
    )
    own, times, copy = free("_facts", docs), free("_times", docs), free("_copy", docs)
    found = docs.withColumn(own, facts)
    match = found[own]["source"].eqNullSafe(plan["_source"]) & (found[own]["size"] == plan["_size"])
    more = F.coalesce((found[own]["place"] <= plan["_top"]).cast("long"), F.lit(0))
    n = F.when(found[own]["size"] > 0, plan["_copies"] + more).otherwise(0).cast("int")
    taken = found.join(plan, match).select(*[found[f"`{c}`"] for c in docs.columns], n.alias(times)).where(F.col(times) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
