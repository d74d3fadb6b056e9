"""An inverted index that is kept between requests: which words stand in which documents.

Documents are dealt to a fixed number of parts by a hash of their names.  A row ``(term, part, gone, names)`` holds all
documents of a part that have the word, so there are far fewer rows than pairs of a word and a document, and a word of
very many documents has as many rows as there are parts.  Rows live in the upsert store, sorted by term, so a request
reads the row groups of its words only.  A batch of changed documents writes the words they gained (``names``) and lost
(``gone``) and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from ..functions.skew import join_hot
from ..operators.search import tokens
from ..sources.snapshot import remove, write_snapshot
from . import upserts

ROW = ["term", "part"]
#: Documents of a part, about: so many names a row holds at most.
PART_DOCUMENTS = 2_000
#: Pairs of a word and a document that a task groups at a time.
CHUNK = 2_000_000


def parts_for(documents: int) -> int:
    """Over how many parts to deal so many documents."""
    return max(1, -(-documents // PART_DOCUMENTS))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int")


def _nothing() -> Column:
    return F.array().cast("array<string>")


def document_terms(docs: DataFrame, text: Column, parts: int | None = None) -> DataFrame:
    """``(name, terms)``: the words of each row's text, each once.  Rows that share a name are one document.

    With the ``parts`` of an index, documents of a part come together, which makes its rows few from the start.
    """
    rows = docs.select("name", text.alias("_text"))
    if parts:
        rows = rows.repartitionById(parts, _part(parts))
    return rows.select("name", tokens(F.col("_text")).alias("terms"))


def _postings(terms: DataFrame, parts: int) -> DataFrame:
    """``(term, part, names)`` from ``(name, terms)``; a word has a row for each chunk of a task that has it."""

    def grouped(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        term, part, name = (rows[c].chunk(0) for c in ("terms", "part", "name"))
        size = pc.fill_null(pc.list_value_length(term), 0).to_numpy(zero_copy_only=False)
        docs = name.dictionary_encode(null_encoding="encode")
        doc = np.repeat(docs.indices.to_numpy(zero_copy_only=False).astype(np.int64), size)
        words = term.flatten().dictionary_encode(null_encoding="encode")
        key = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * parts + np.repeat(part.to_numpy(), size)
        if len(docs.dictionary) < len(name):  # rows that share a name give a word once
            _, one = np.unique(key * len(docs.dictionary) + doc, return_index=True)
            key, doc = key[one], doc[one]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        ends = pa.array(np.append(first, len(key)), pa.int32())
        columns = [
            words.dictionary.take(pa.array(key[first] // parts)),
            pa.array((key[first] % parts).astype(np.int32)),
            pa.ListArray.from_arrays(ends, docs.dictionary.take(pa.array(doc[order]))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["term", "part", "names"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += len(batch.column("terms").flatten())
            if n >= CHUNK:
                yield grouped(held)
                held, n = [], 0
        if held:
            yield grouped(held)

    rows = terms.select("name", _part(parts).alias("part"), "terms")
    return rows.mapInArrow(each, "term string, part int, names array<string>")


def _ranged(rows: DataFrame) -> DataFrame:
    """By ranges of term and part: a word of very many documents lies in as many files as it needs."""
    return rows.repartitionByRange(*ROW)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions(*ROW)


def _whole(rows: DataFrame, columns: list[str], order: str = "part") -> DataFrame:
    """One row for each word and part, with ``_steps``: these columns of all its rows, one for each batch or chunk."""
    same = Window.partitionBy(*ROW).orderBy(order)
    steps = F.collect_list(F.struct(*columns)).over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(*ROW, steps.alias("_steps"), F.lead("part").over(same).isNull().alias("_last")).filter("_last")


def _merged(every: DataFrame) -> DataFrame:
    """One row for each word and part: what its batches took and gave, one after the other.  Most rows stand alone."""
    now = F.aggregate("_steps", _nothing(), lambda held, s: F.array_union(F.array_except(held, s["gone"]), s["names"]))
    names = F.when(F.size("_steps") == 1, F.col("_steps")[0]["names"]).otherwise(now)
    return _whole(every, ["gone", "names"], upserts.BATCH).select(*ROW, _nothing().alias("gone"), names.alias("names"))


def term_changes(rows: DataFrame) -> DataFrame:
    """What documents gained and lost: rows whose ``gone`` had the word before the change, and whose ``names`` have it after."""
    gone, names = F.flatten("_steps.gone"), F.flatten("_steps.names")
    both = _whole(rows, ["gone", "names"]).select(
        *ROW, F.array_except(gone, names).alias("gone"), F.array_except(names, gone).alias("names")
    )
    return both.filter("size(gone) + size(names) > 0")


class _Unsorted:
    """Rows written as they come and read back in ranges: finding the ranges reads its rows once more."""

    def __init__(self, rows: DataFrame, folder: str) -> None:
        self.rows, self.path = rows, f"{folder}/unsorted-{uuid.uuid4().hex}"

    def __enter__(self) -> DataFrame:
        self.rows.write.parquet(self.path)
        return _ranged(self.rows.sparkSession.read.schema(self.rows.schema).parquet(self.path))

    def __exit__(self, *_) -> None:
        remove(self.rows.sparkSession, self.path)


def start_terms(terms: DataFrame, folder: str, parts: int = 16) -> None:
    """Write the words of all documents: what changes are added to.

    The documents of the index are dealt over so many parts for good (see :func:`parts_for`).
    """
    spark = terms.sparkSession
    spark.range(1).select(F.lit(parts).alias("parts")).write.mode("overwrite").parquet(f"{folder}/parts")
    with _Unsorted(_postings(terms, parts), folder) as ranged:
        joined = F.array_distinct(F.flatten("_steps.names"))
        names = F.when(F.size("_steps") == 1, F.col("_steps")[0]["names"]).otherwise(joined)
        found = _whole(ranged, ["names"]).select(*ROW, _nothing().alias("gone"), names.alias("names"))
        write_snapshot(_in_order(found), f"{folder}/base", version=0)


def update_terms(old: DataFrame, new: DataFrame, folder: str, batch_id: int) -> None:
    """Write what a batch changes; ``old`` and ``new`` are the words of the changed documents alone.

    A deleted document has no new words, one that is new has no old ones.  A repeated batch changes nothing.
    """
    parts = old.sparkSession.read.parquet(f"{folder}/parts").first()["parts"]
    before = _postings(old, parts).select(*ROW, F.col("names").alias("gone"), _nothing().alias("names"))
    after = _postings(new, parts).select(*ROW, _nothing().alias("gone"), "names")
    with _Unsorted(before.unionByName(after), folder) as ranged:
        upserts.write_batch(_in_order(term_changes(ranged)), folder, batch_id)


def read_terms(spark: SparkSession, folder: str, terms: list[str] | DataFrame, through: int | None = None) -> DataFrame:
    """``(term, name)``: the documents that hold the words, now or as of a batch.

    A list of words is a filter that reaches the scan; only their rows are read and shuffled.  For words in a
    DataFrame the rows of common ones are spread.  Words count in lower case.
    """
    every = upserts.read_upserts(spark, folder, ROW, through, _merged)
    if isinstance(terms, list):
        found = every.filter(F.col("term").isin([t.lower() for t in terms]))
    else:
        wanted = terms.select(F.lower("term").alias("term")).distinct()
        found = join_hot(every, wanted, ["term"], "left_semi", ["part"])
    return found.select("term", F.explode("names").alias("name"))


def fold_terms(spark: SparkSession, folder: str) -> None:
    """Fold all batches so far into a new base, and let go of words that no document holds any more."""
    upserts.fold(
        spark, folder, ROW, arrange=lambda rows: _in_order(rows.filter("size(names) > 0")), newest=lambda every: _merged(_ranged(every))
    )
