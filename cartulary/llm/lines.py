"""Line dedup by hashes of whole runs: later copies of runs of lines are deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame

from .common import free, store, text_of

#: A run is copied text when its lines have so many words together.
WORDS = 50


def digest(text: str = "text") -> Column:
    """Tells texts apart; with the id it names a document."""
    return F.unhex(F.md5(text_of(text).cast("binary")))


def runs(text: str, least: int = WORDS) -> Iterator[tuple[bytes, bytes, int, int, int]]:
    """The least runs of a text: fingerprint, hash of the run, line of the fingerprint, first and last line.

    Lines are trimmed, those without words left out; lines are numbered as in the whole text.  From every line
    the shortest run of at least ``least`` words forwards, and to every line the shortest one backwards:
    together they cover every longer run, and none has more than ``least`` lines.  A run's fingerprint is its
    smallest line hash (the last of equal ones), so equal runs have equal fingerprints whatever stands around.
    """
    found = [(i, s) for i, line in enumerate(text.split("\n")) if (s := line.encode().strip())]
    hashes = [xxhash.xxh3_128_digest(s) for _, s in found]
    total = np.concatenate([[0], np.cumsum([len(s.split()) for _, s in found])]).astype(np.int64)
    ends = np.searchsorted(total, total[:-1] + least) - 1
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    spans = {(i, int(j)) for i, j in enumerate(ends) if j < len(found)}
    spans |= {(int(i), j) for j, i in enumerate(starts) if i >= 0}
    for i, j in sorted(spans):
        own = hashes[i : j + 1]
        low = min(own)
        at = j - own[::-1].index(low)
        yield low, xxhash.xxh3_128_digest(b"".join(own)), found[at][0], found[i][0], found[j][0]


def copied_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = WORDS) -> DataFrame:
    """``id, digest, first, last``: runs of lines that stand earlier too, in order of id, text digest and line.

    1. Every least run gives a row with a hash of the whole run and its smallest line hash as a fingerprint.
    2. Runs whose fingerprint stands at one position only are done with; this is a prefilter and changes nothing.
    3. The others are grouped by the hash of the run, and of equal runs all but the first are given back.

    No match is extended: a line has a row for each of its at most two least runs.  Nothing is paired within a group: the first is an
    aggregate, and the others are joined to it alone, so a line or run that a third of all documents hold is no
    heavier than others.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, *r) for n, t in enumerate(batch["text"]) for r in runs(t, least)]
            made = pd.DataFrame(rows, columns=["n", "mark", "run", "at", "first", "last"])
            yield batch[["id", "digest"]].iloc[made["n"]].reset_index(drop=True).join(made.drop(columns="n"))

    # ids travel as text, as a long beside a null would become a rounded double
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).cast("string").alias("id"), digest(text).alias("digest"), text_of(text).alias("text"))
    made = rows.mapInPandas(each, "id string, digest binary, mark binary, run binary, at int, first int, last int")
    found = store(made.withColumn("id", F.col("id").cast(kind)), "runs")
    where = F.struct("id", "digest", "at")
    shared = found.groupBy("mark").agg(F.min(where).alias("one"), F.max(where).alias("other")).where("one < other")
    likely = found.join(shared.select("mark"), "mark", "left_semi")
    start = F.struct("id", "digest", "first")
    earliest = likely.groupBy("run").agg(F.min(start).alias("earliest"), F.max(start).alias("latest"))
    again = likely.join(earliest.where("earliest < latest").select("run", "earliest"), "run").where(start > F.col("earliest"))
    return again.select("id", "digest", "first", "last").distinct()


def drop_copied_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = WORDS) -> DataFrame:
    """``docs`` with ``line_dedup: struct<n_lines, n_removed, text>``: the text without its later copied lines.

    A line goes when it lies in a run of at least ``least`` words of consecutive lines that occurs earlier: in a
    document with a smaller id (null before all), or earlier in the same one.  Blank lines neither break runs
    nor go.  The first occurrence always stays.  Rows that repeat id and text are one document and share its
    fate; null and empty texts have one line and stay as they are (null as empty).
    """
    copied = copied_runs(docs, id, text, least)
    name, code, spans = (free(c, docs) for c in ("_line_id", "_line_digest", "_line_spans"))
    by = copied.groupBy(F.col("id").alias(name), F.col("digest").alias(code)).agg(
        F.collect_list(F.struct("first", "last")).alias(spans)  # at most two for each line of the document
    )

    @F.pandas_udf("struct<n_lines: long, n_removed: long, text: string>")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        made = []
        for t, pairs in zip(texts, found):
            lines = t.split("\n")
            depth = np.zeros(len(lines) + 1, dtype=np.int64)
            for p in pairs if pairs is not None else ():
                depth[p["first"]] += 1
                depth[p["last"] + 1] -= 1
            gone = np.cumsum(depth)[:-1] > 0
            kept = [s for s, g in zip(lines, gone) if not (g and s.strip())]
            made.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(made, columns=["n_lines", "n_removed", "text"])

    marked = docs.withColumn(code + "_", digest(text))
    match = marked[id].eqNullSafe(by[name]) & (marked[code + "_"] == by[code])
    return marked.join(by, match, "left").select(
        *[marked[c] for c in docs.columns], cut(text_of(text), F.col(spans)).alias("line_dedup")
    )
