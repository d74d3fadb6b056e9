"""Running the feed as streams: sources, sinks and restartable state."""

from __future__ import annotations

from decimal import Decimal

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshot import exists, read_snapshot, versions, write_snapshot
from . import feed
from .upserts import fold, read_upserts, tidy, write_batch


ARRIVAL_STEP = Decimal(10) ** 19  # above any bigint sequence number


def read_feed(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Events from files as they appear."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_kafka_feed(spark: SparkSession, servers: str, topic: str, schema: str, **options: str) -> DataFrame:
    """Events from a topic of JSON messages."""
    raw = (
        spark.readStream.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options})
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Write everything now available to parquet, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def publish(
    stream: DataFrame, tables: str, partitions: str | None, checkpoint: str, sink: str = "json", **options: str
) -> list[StreamingQuery]:
    """Table messages to one topic and, when asked for, partition messages to another.

    A topic is a folder, or with ``sink="kafka"`` a Kafka topic that gets JSON values
    keyed by name; ``options`` go to the sink.
    """

    def start(df: DataFrame, topic: str, name: str) -> StreamingQuery:
        if sink == "kafka":
            df = df.select(F.col("name").alias("key"), F.to_json(F.struct("*")).alias("value"))
        return (
            df.writeStream.format(sink)
            .option("topic" if sink == "kafka" else "path", topic)
            .options(**options)
            .option("checkpointLocation", f"{checkpoint}/{name}")
            .trigger(availableNow=True)
            .start()
        )

    queries = [start(stream.drop("part_name"), tables, "tables")]
    if partitions is not None:
        queries.append(start(stream.filter("part_name is not null"), partitions, "partitions"))
    return queries


def maintain_index(
    changes: DataFrame, folder: str, checkpoint: str, compact_every: int = 16
) -> StreamingQuery:
    """Keep an index up to date with a stream of changes.

    A batch only writes its own changes to a log, so its cost follows the batch and not
    the index; every so many batches the log is folded into the next base version.
    Both writes overwrite what a failed attempt left, so a repeated batch changes nothing.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact_index(batch.sparkSession, folder, batch_id)

    return (
        changes.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_index(docs: DataFrame, folder: str) -> None:
    """Write the index a stream of changes starts from."""
    write_snapshot(docs, f"{folder}/base", version=0)


def compact_index(spark: SparkSession, folder: str, through: int) -> None:
    """Fold the log up to a batch into a base; base version ``n`` holds all batches before ``n``.

    The base before stays for readers that have begun; what only older ones need is removed.
    """
    write_snapshot(read_index(spark, folder, through), f"{folder}/base", version=through + 1)
    tidy(spark, folder)


def read_index(spark: SparkSession, folder: str, through: int | None = None) -> DataFrame:
    """The index now, or as of a batch: the newest base with the rest of the log applied.

    Changes count in the order they arrived: by batch, and by ``seq`` within one.
    """
    bases = [v for v in versions(spark, f"{folder}/base") if through is None or v <= through]
    docs = read_snapshot(spark, f"{folder}/base", bases[-1])
    if not exists(spark, f"{folder}/log"):
        return docs
    log = spark.read.parquet(f"{folder}/log").filter(F.col("batch") >= bases[-1])
    if through is not None:
        log = log.filter(F.col("batch") <= through)
    arrival = F.col("batch").cast("decimal(18,0)") * F.lit(ARRIVAL_STEP) + F.col("seq")
    return feed.apply_changes(docs, log.withColumn("seq", arrival).drop("batch"))


def _maintain(changed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the rows that each batch changes, with their values so far."""
    return (
        changed.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: write_batch(batch, out, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def maintain_counts(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Live partition counts per table; every batch writes the tables it changed."""
    return _maintain(feed.live_counts(events), out, checkpoint)


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """Newest count of every table."""
    return read_upserts(spark, out, ["name"])


WINDOW = ["window_start", "window_end", "name"]


def maintain_windows(events: DataFrame, out: str, checkpoint: str, width: str, watermark: str) -> StreamingQuery:
    """Changes per table and window; every batch writes the windows it changed, open ones too.

    Counts combine before their shuffle, so a table with very many events of one window sends one row per task.  The
    stream forgets a window once the watermark has passed it; what was written stays.
    """
    return _maintain(feed.change_counts(events, width, watermark=watermark), out, checkpoint)


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    """All windows with their newest counts, closed and open."""
    return read_upserts(spark, out, WINDOW)


def fold_counts(spark: SparkSession, out: str) -> None:
    """Fold the counts of all batches so far; run between streams, now and then."""
    fold(spark, out, ["name"])


def fold_windows(spark: SparkSession, out: str) -> None:
    """Fold the windows of all batches so far."""
    fold(spark, out, WINDOW)
