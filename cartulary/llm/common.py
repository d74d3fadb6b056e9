"""What several operators share: the shared folder, word rules and connected components."""

from __future__ import annotations

import tempfile
import uuid

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, as the session names it.

    Only a local session that names none (a test) gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="llm-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, apart: bool = False) -> DataFrame:
    """The rows written once to the shared folder and read back: later steps start from them,
    and a lost executor costs no more than its own tasks.

    ``apart``: each row is a row group of its own, for rows of many megabytes.  Parquet looks at the size of a
    row group after 100 rows only, and writers and readers hold a whole one in memory.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if apart:
        writer = writer.option("parquet.block.row.count.limit", 1)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free(name: str, df: DataFrame) -> str:
    """The name, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns ``a, b``): root is the smallest
    node that links reach, itself included.

    Alternating large-star and small-star rounds.  Each takes the minimum of a node's neighbours by
    an aggregate that combines before the shuffle and joins it back, so a node with very many
    neighbours is never gathered, and each round is written to the shared folder.
    """
    now = store(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a > b")
        .distinct(),
        "links",
    )
    mark = _mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = store(small.union(lowest).distinct(), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(links: DataFrame) -> tuple:
    """A count and an order-free sum that tell two sets of links apart."""
    code = F.xxhash64("a", "b")
    return tuple(
        links.agg(F.count("*"), F.sum(code.cast("decimal(38,0)")), F.bit_xor(code)).first()
    )
