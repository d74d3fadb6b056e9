"""From storage paths back to the tables and partitions that use them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.ranges import in_ranges
from ..functions.skew import join_hot


def ancestors(path: Column, include_self: bool = False) -> Column:
    """Every leading part of a path that ends before a ``/``, scheme parts left out."""
    # drop the "scheme:" and "scheme:/" fragments of s3://bucket/...
    first = F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), 3).otherwise(1)
    levels = F.size(F.split(path, "/"))
    last = levels if include_self else levels - 1
    cuts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(cuts, lambda i: F.call_function("substring_index", path, F.lit("/"), i))


def below(paths: DataFrame, roots: DataFrame, path: str, root: str, include_self: bool = False) -> DataFrame:
    """``(root, path, …)`` for every path under a root.

    Each path is unfolded into its few ancestors and equi-joined with the roots.
    The top ancestors are shared by almost all rows, hence the spread join.
    """
    unfolded = paths.withColumn(root, F.explode(ancestors(F.col(path), include_self)))
    return join_hot(unfolded, roots.select(root).distinct(), [root], "inner", [path])


def any_below(paths: DataFrame, roots: DataFrame, path: str, root: str, include_self: bool = False) -> DataFrame:
    """The ``path`` values under at least one root, each once."""
    return below(paths.select(path), roots, path, root, include_self).select(path).distinct()


def starting_with(used: DataFrame, wanted: DataFrame, text: str, ranges: int | None = None) -> DataFrame:
    """Rows of ``used`` whose ``text`` starts with a ``wanted`` one, once for each, with that in a column ``wanted``.

    Texts and wanted beginnings are dealt out together by ranges of their order, where all texts with one beginning
    follow it, and every range is read once with a stack of the beginnings that are open.  Those open from an earlier
    range are found from the first text of each range: its own leading parts meet the wanted ones.  So every row is
    shuffled once, however deep it lies, and a beginning that very many texts share costs a row per range.
    """
    columns = used.columns
    order = ["_text", "_side", *[f.name for f in used.schema if f.name != text and "map<" not in f.dataType.simpleString()]]
    asked = wanted.select(F.col("wanted").alias("_text"), F.lit(0).alias("_side")).filter("_text IS NOT NULL").distinct()
    rows = used.filter(F.col(text).isNotNull()).withColumns({"_text": F.col(text), "_side": F.lit(1)})
    ranged = in_ranges(rows.unionByName(asked, allowMissingColumns=True), order, "_range", ranges)
    firsts = ranged.groupBy("_range").agg(F.min("_text").alias("_first"))
    lengths = F.sequence(F.lit(0), F.length("_first"))
    leading = firsts.select("_range", F.explode(lengths).alias("_n"), "_first").select("_range", F.expr("substring(_first, 1, _n)").alias("_text"))
    earlier = ranged.filter("_side = 0").select("_text", F.col("_range").alias("_from"))
    carried = leading.join(earlier, "_text").filter("_from < _range").select("_range", "_text", F.lit(0).alias("_side"))
    sorted_rows = ranged.unionByName(carried, allowMissingColumns=True).repartition("_range").sortWithinPartitions("_range", "_text", "_side")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        opened: list[str] = []
        for batch in batches:
            places, found = [], []
            sides, numbers = batch.column("_side").to_pylist(), batch.column("_range").to_pylist()
            for k, t in enumerate(batch.column("_text").to_pylist()):
                if numbers[k] != at:
                    at, opened = numbers[k], []
                while opened and not t.startswith(opened[-1]):
                    opened.pop()
                if sides[k] == 0:
                    opened.append(t)
                else:
                    places += [k] * len(opened)
                    found += opened
            if places:
                taken = batch.select(columns).take(pa.array(places))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *taken.columns], names=["wanted", *columns])

    return sorted_rows.mapInArrow(read, StructType([StructField("wanted", StringType()), *used.schema.fields]))


def resolve_uris(wanted: DataFrame, tables: DataFrame, parts: DataFrame, prefix: bool = False, ranges: int | None = None) -> DataFrame:
    """One row ``(wanted_uri, kind, name, uri)`` per table or partition using a wanted path.

    ``prefix`` also takes everything whose path starts with the wanted text, which may end inside a step, see
    :func:`starting_with`.
    """
    used = tables.select(F.lit("table").alias("kind"), "name", "uri").unionByName(
        parts.select(
            F.lit("partition").alias("kind"),
            F.concat_ws("/", "table_name", "part_name").alias("name"),
            "uri",
        )
    )
    asked = wanted.select(F.col("uri").alias("wanted_uri")).distinct()
    if not prefix:
        exact = used.withColumn("wanted_uri", F.col("uri"))
        return join_hot(exact, asked, ["wanted_uri"], "inner", ["name"])
    found = starting_with(used, asked.withColumnRenamed("wanted_uri", "wanted"), "uri", ranges)
    return found.select(F.col("wanted").alias("wanted_uri"), "kind", "name", "uri")


def shared_uris(uses: DataFrame) -> DataFrame:
    """Paths used more than once."""
    return (
        uses.filter(F.col("uri").isNotNull())
        .groupBy("uri")
        .agg(F.count("*").alias("uses"))
        .filter(F.col("uses") > 1)
    )


def descendant_names(names: DataFrame, roots: DataFrame) -> DataFrame:
    """Names strictly below a root name."""
    return below(names, roots, "name", "root")


def descendant_uris(data: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths strictly below a root path."""
    return below(data, roots, "uri", "root")
