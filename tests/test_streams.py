"""Streams over several batches agree with one batch over everything."""

import pyspark.sql.functions as F

from cartulary.functions.times import as_instant
from cartulary.plans.bindings import Bindings
from cartulary.plans.feed import _index, _index_changes
from cartulary.streaming import feed, streams, upserts
from tests.conftest import values

INDEX = ["name", "kind", "body", "user", "deleted", "updated_at"]


def landed(spark, small, tmp_path, files):
    """Events as several files, in order."""
    events = Bindings(spark, small).table("events")
    folder = str(tmp_path / "events")
    events.repartitionByRange(files, "event_id").write.parquet(folder)
    return events, folder


def test_index_over_many_batches_with_compaction(spark, small, tmp_path):
    events, folder = landed(spark, small, tmp_path, 5)
    b = Bindings(spark, small)
    home = str(tmp_path / "index")
    streams.start_index(_index(b), home)
    stream = streams.read_feed(spark, folder, events.schema, files_per_batch=1)
    streams.maintain_index(_index_changes(stream), home, str(tmp_path / "state"), compact_every=2).awaitTermination()
    # the same batches, none of them folded: what arrived in each
    whole = str(tmp_path / "whole")
    streams.start_index(_index(b), whole)
    streams.maintain_index(_index_changes(stream), whole, str(tmp_path / "whole_state"), compact_every=100).awaitTermination()
    docs = _index(b)
    for n in range(5):
        arrived = spark.read.parquet(f"{whole}/log/batch={n}")
        # each step is read back, so that the plan does not grow with the batches
        feed.apply_changes(docs, arrived).write.parquet(str(tmp_path / f"step{n}"))
        docs = spark.read.parquet(str(tmp_path / f"step{n}"))
    want = values(docs, *INDEX)
    assert values(streams.read_index(spark, home), *INDEX) == want
    bases = sorted(p.name for p in (tmp_path / "index" / "base").iterdir())
    # the last base and the one before it; what only older ones need is gone
    assert bases == ["v2", "v4"]
    assert sorted(p.name for p in (tmp_path / "index" / "log").iterdir() if p.name.startswith("batch")) == ["batch=2", "batch=3", "batch=4"]
    # folding again after a lost attempt leaves the same index
    streams.compact_index(spark, home, 3)
    assert values(streams.read_index(spark, home), *INDEX) == want


def test_restarted_stream_goes_on(spark, small, tmp_path):
    events, folder = landed(spark, small, tmp_path, 4)
    log = streams.read_feed(spark, folder, events.schema, files_per_batch=1).select(
        "event_id", F.col("user_id").cast("string").alias("name"),
        F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("op"),
    )
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streams.maintain_counts(log, out, state).awaitTermination()
    first = values(streams.read_counts(spark, out), "name", "live")
    streams.maintain_counts(log, out, state).awaitTermination()
    assert values(streams.read_counts(spark, out), "name", "live") == first
    # one more file, counted on top of what was there
    events.write.mode("append").parquet(folder)
    streams.maintain_counts(log, out, state).awaitTermination()
    doubled = [(n, 2 * live) for n, live in first]
    assert values(streams.read_counts(spark, out), "name", "live") == doubled


def test_late_copies_are_dropped_across_batches(spark, small, tmp_path):
    events, folder = landed(spark, small, tmp_path, 3)
    events.write.mode("append").parquet(folder)
    stream = streams.read_feed(spark, folder, events.schema).withColumn("ts", as_instant(F.col("ts")))
    streams.drain(feed.dedupe_events(stream, ["event_id"], "60 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_payload_messages(spark):
    def table(name, column, dated):
        holds = '{"data_hygiene":{"delete_column":"%s"},"data_dependency":{"partition_column_date_type":"%s"}}'
        return (name, holds % (column, dated))

    defs = spark.createDataFrame(
        [table("a", "day", "utc"), table("p", "day", "pacific"), table("e", "", "utc"), ("m", '{"data_hygiene":{"delete_column":"day"}}')],
        "name string, data string",
    )
    cases = {
        "past": ("a", ["20240101", "20240102", "20990101"], "day=20240102", "ATTACHED_VALID_PARITITION_KEY"),
        "bad first": ("a", ["20240101", "x"], None, "INVALID_PARTITION_KEY_FORMAT"),
        "bad later": ("a", ["20240101", "!"], "day=20240101", "ATTACHED_VALID_PARITITION_KEY"),
        "future": ("a", ["20990101", "20980101"], None, "ALL_FUTURE_PARTITION_KEYS"),
        "future then bad": ("a", ["20990101", "2"], None, "ALL_FUTURE_PARTITION_KEYS"),
        "none": ("a", ["null", "__HIVE_DEFAULT_PARTITION__"], None, "NO_CANDIDATE_PARTITION_KEYS"),
        "empty": ("e", ["20240101"], None, "EMPTY_DELETE_COLUMN"),
        "missing": ("m", ["20240101"], None, "MISSING_METADATA_INFO_FOR_PARTITION_KEY"),
        "unknown": ("zz", ["20240101"], None, "MISSING_METADATA_INFO_FOR_PARTITION_KEY"),
        # midnight in the regional zone is eight hours later than in UTC
        "regional": ("p", ["20240110", "20240111"], "day=20240110", "ATTACHED_VALID_PARITITION_KEY"),
    }
    # "2" sorts before the future days but is malformed, so the walk ends on it
    cases["future then bad"] = ("a", ["20990101", "2"], None, "INVALID_PARTITION_KEY_FORMAT")
    rows = [(u, t, "add", f"day={v}/n={i}") for u, (t, vs, _, _) in cases.items() for i, v in enumerate(vs)]
    rows += [("drop", "a", "delete", f"day=2024010{i}") for i in range(3)]
    rows += [("big", "a", "add", f"day=20240101/n={i:04d}") for i in range(1001)]
    changes = spark.createDataFrame(rows, "update_id string, table_name string, op string, part_name string")
    now = F.lit(1704931200 + 3600)  # 2024-01-11 01:00 UTC
    got = {r.update_id: r for r in feed.partition_update_payloads(changes, defs, now).collect()}
    assert {u: (got[u].latest, got[u].message) for u in cases} == {u: (want, m) for u, (_, _, want, m) in cases.items()}
    assert (got["drop"].created, got["drop"].deleted, got["drop"].message) == (0, 3, "PARTITION_KEY_UNABLED")
    assert got["big"].created == 1001
    names = feed.partition_update_names(changes.union(changes))
    assert values(names, "update_id", "table_name", "op", "part_name") == sorted(set(rows), key=str)


def test_running_inventory_over_range_borders(spark, small):
    log = Bindings(spark, small).log.withColumn("name", F.lit("hot"))
    rows = {n: values(feed.running_inventory(log, n), "event_id", "live") for n in (1, 5, 40)}
    assert rows[1] == rows[5] == rows[40]


def test_windows_are_written_open_and_closed_and_folded(spark, small, tmp_path):
    events, folder = landed(spark, small, tmp_path, 4)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    every = streams.read_feed(spark, folder, events.schema, files_per_batch=1)
    log = every.select(
        "event_id", as_instant(F.col("ts")).alias("ts"), F.col("user_id").cast("string").alias("name"),
        F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("op"),
    )
    columns = ["window_start", "window_end", "name", "created", "deleted", "updated"]
    streams.maintain_windows(log, out, state, "1 day", "3650 days").awaitTermination()
    batch = events.select(
        "event_id", as_instant(F.col("ts")).alias("ts"), F.col("user_id").cast("string").alias("name"),
        F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("op"),
    )
    want = values(feed.change_counts(batch, "1 day"), *columns)
    assert values(streams.read_windows(spark, out), *columns) == want
    half = values(upserts.read_upserts(spark, out, streams.WINDOW, 1), *columns)
    upserts.fold(spark, out, streams.WINDOW, 1)
    assert values(streams.read_windows(spark, out), *columns) == want
    assert values(upserts.read_upserts(spark, out, streams.WINDOW, 1), *columns) == half
    for _ in range(3):  # folding again, after a lost attempt too, changes nothing
        streams.fold_windows(spark, out)
        assert values(streams.read_windows(spark, out), *columns) == want
    # a second run adds to what was folded
    events.write.mode("append").parquet(folder)
    streams.maintain_windows(log, out, state, "1 day", "3650 days").awaitTermination()
    streams.fold_windows(spark, out)
    doubled = [(*r[:3], *(2 * n for n in r[3:])) for r in want]
    assert values(streams.read_windows(spark, out), *columns) == doubled
    assert not [n for n in upserts.batches(spark, out) if n < 4]


def test_approximate_delay(spark, small):
    log = Bindings(spark, small).log.withColumn("ts", as_instant(F.col("ts")))
    now = F.lit("2024-02-01 00:00:00Z").cast("timestamp")
    exact = {r.op: r for r in feed.event_delay(Bindings(spark, small).log, F.lit(1706745600).cast("bigint"), ["op"]).collect()}
    for r in feed.event_delay_approx(log, now, ["op"]).collect():
        assert r.events == exact[r.op].events
        assert abs(r.percentiles[0] - exact[r.op].p50) <= 40_000
