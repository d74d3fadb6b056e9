"""Segment descriptions of a time-series store: one JSON object per segment."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

# The members of a segment description that are read.
SEGMENT = (
    "dataSource string, interval string, dimensions string, metrics string, "
    "loadSpec struct<type:string, bucket:string, key:string>"
)


def parse_segments(segments: DataFrame, col: str = "json") -> DataFrame:
    """Segments as columns, interval ends as text in sortable form."""
    parsed = segments.select(F.from_json(F.col(col), SEGMENT).alias("s"))
    interval = F.split("s.interval", "/", 2)
    return parsed.select(
        F.col("s.dataSource").alias("table_name"),
        F.get(interval, F.lit(0)).alias("starts"),
        F.get(interval, F.lit(1)).alias("ends"),
        F.coalesce("s.dimensions", F.lit("")).alias("dimensions"),
        F.coalesce("s.metrics", F.lit("")).alias("metrics"),
        F.coalesce("s.loadSpec.bucket", F.lit("")).alias("bucket"),
        F.coalesce("s.loadSpec.key", F.lit("")).alias("load_key"),
    )


def latest_segments(segments: DataFrame) -> DataFrame:
    """The latest segment of each source by interval, by a folding maximum."""
    return segments.groupBy("table_name").agg(
        F.max(F.struct("starts", "ends", "dimensions", "metrics")).alias("s")
    ).select("table_name", "s.*")


def infer_segment_schema(segments: DataFrame) -> DataFrame:
    """Fields of each source: dimensions are strings, metrics doubles, empty lists give none."""
    latest = latest_segments(segments)

    def fields(col: str, kind: str):
        names = F.when(F.col(col) != "", F.split(col, ",")).otherwise(F.array().cast("array<string>"))
        return F.transform(
            names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type"), F.lit(col).alias("comment"))
        )

    both = F.concat(fields("dimensions", "string"), fields("metrics", "double"))
    return latest.select("table_name", F.posexplode(both).alias("pos", "f")).select(
        "table_name", "pos", "f.name", "f.type", "f.comment"
    )


def segment_inventory(segments: DataFrame) -> DataFrame:
    """Segments as partitions; the uri is the bucket plus the folder of the first key."""
    first = F.substring_index("load_key", ",", 1)
    folder = F.regexp_replace(first, "/[^/]*$", "")
    known = (F.col("bucket") != "") & (F.col("load_key") != "")
    return segments.select(
        "table_name",
        F.concat_ws("/", "starts", "ends").alias("part_name"),
        F.when(known, F.concat_ws("/", "bucket", folder)).otherwise(F.lit("")).alias("uri"),
    )
