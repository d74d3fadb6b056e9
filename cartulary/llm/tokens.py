"""Token counts by a separator scan over flat, unindexed token files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from .common import scratch, text_of
from .scoring import VOCABULARY, Vocabulary, encoder

BLOCK = 1 << 16  # tokens that a block of a file holds; the last one of a file may be shorter
ID = "<u2"  # how an id is stored: two bytes, low one first


def write_tokens(docs: DataFrame, path: str, vocabulary: Vocabulary, id: str = "doc_id", text: str = "text") -> None:
    """Writes the documents' tokens to ``path``: ``(file, block, data, ids)``, one file per task.

    A file is one run of token ids, each document followed by the end of document, cut into blocks of equal
    size wherever they fall.  Nothing in ``data`` says where a document begins.  Apart from it, ``ids`` lists the
    documents that were begun since the last block, so that counts can be given their names again.
    """
    kind = docs.schema[id].dataType.simpleString()
    end = vocabulary.end

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary.ranks, vocabulary.pattern).encode_ordinary
        file, block, ids, id_type = TaskContext.get().partitionId(), 0, [], None
        flow, size = [], 0

        def cut(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block, ids, flow, size
            run = np.concatenate(flow) if flow else np.zeros(0, ID)
            n = BLOCK if whole else max(1, len(run))
            while len(run) >= BLOCK or (not whole and len(run)):
                data, run = run[:n], run[n:]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file], pa.int32()), pa.array([block], pa.int64()),
                        pa.array([data.tobytes()]), pa.array([ids], pa.list_(id_type)),
                    ],
                    names=["file", "block", "data", "ids"],
                )
                block, ids = block + 1, []
            flow, size = [run], len(run)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for name, value in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                flow.append(np.array([*encode(value), end], dtype=ID))
                size += len(flow[-1])
                ids.append(name)
                if size >= BLOCK:
                    yield from cut(True)
        if id_type is not None:
            yield from cut(False)

    rows = docs.select(F.col(id).alias("id"), text_of(text).alias("text"))
    made = rows.mapInArrow(each, f"file int, block long, data binary, ids array<{kind}>")
    made.write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """``file, block, data`` of raw binary token files that other tools wrote, cut into blocks of equal size."""
    size = block * np.dtype(ID).itemsize
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length")
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)))
    return files.where("length > 0").select("file", "content", F.explode(cuts).alias("block")).select(
        "file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("data")
    )


def scan(blocks: DataFrame, end: int) -> DataFrame:
    """``file, document, n_tokens, complete``: tokens before each end of document, documents counted from 0.

    Each block is searched on its own: the ends it holds, the lengths between them, and what is left after the
    last one.  A prefix scan over these summaries (one row per block) then carries on the number of documents
    and the place of the last end, so a document may run over any number of blocks.  Tokens after a file's last
    end are one more document, not complete.  Empty blocks and files add nothing.
    """
    file = blocks.schema["file"].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch["data"]:
                run = np.frombuffer(data, dtype=ID)
                ends = np.flatnonzero(run == end)
                rows.append((len(run), len(ends), int(ends[-1]) if len(ends) else None, np.diff(ends, prepend=-1) - 1))
            made = pd.DataFrame(rows, columns=["size", "ends", "last", "lengths"])
            made["last"] = made["last"].astype("Int64")
            yield pd.concat([batch[["file", "block"]].reset_index(drop=True), made], axis=1)

    found = blocks.select("file", "block", "data").mapInPandas(
        each, f"file {file}, block long, size long, ends long, last long, lengths array<long>"
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.select(
        "*",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("documents"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("final"),
    ).withColumn("ended", F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(-1)))
    carried = F.col("start") - F.col("ended") - 1
    whole = placed.select("file", "documents", carried.alias("carried"), F.posexplode("lengths").alias("nth", "length")).select(
        "file", (F.col("documents") + F.col("nth")).alias("document"),
        (F.col("length") + F.when(F.col("nth") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"),
        F.lit(True).alias("complete"),
    )
    left = F.when(F.col("last").isNull(), carried + F.col("size")).otherwise(F.col("size") - F.col("last") - 1)
    rest = placed.where("final").select(
        "file", (F.col("documents") + F.col("ends")).alias("document"), left.alias("n_tokens"), F.lit(False).alias("complete")
    )
    return whole.union(rest.where("n_tokens > 0"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_tokens``: one row per row of ``docs``, counted in token files written to the shared folder.

    Null and empty texts have no tokens.  A text that spells the end of document is ordinary text.  Repeated
    rows and null ids are counted like any other, other columns are ignored, an empty table gives an empty
    result.
    """
    words = Vocabulary.read(vocabulary)
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, words, id, text)
    kind = docs.schema[id].dataType.simpleString()
    files = docs.sparkSession.read.schema(f"file int, block long, data binary, ids array<{kind}>").parquet(path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = files.select("file", "ids", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).alias("first"))
    names = names.select("file", "first", F.posexplode("ids").alias("nth", "id")).select(
        "file", (F.col("first") + F.col("nth")).alias("document"), F.col("id").alias(id)
    )
    return names.join(scan(files, words.end), ["file", "document"]).select(id, "n_tokens")
