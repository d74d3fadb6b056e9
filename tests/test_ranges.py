"""Sessions, sums and ranks cut into ranges agree with plain models, whoever owns the rows."""

import random
from collections import Counter

import pyspark.sql.functions as F
import pytest

from cartulary.functions.ranges import at_ranks, in_ranges, running_sums
from cartulary.streaming import feed
from tests.conftest import values

GAP = 60


def log(spark, seed, hot=0.5, n=600):
    """Events in seconds; one table has a share ``hot`` of them."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        name = "hot" if draw.random() < hot else draw.choice([None, "a", "b", "c", "d"])
        ts = None if draw.random() < 0.02 else draw.choice([draw.randint(0, 20_000), 60 * draw.randint(0, 300)])
        rows.append((k, ts, name, draw.choice(["create", "add", "delete", "update"])))
    df = spark.createDataFrame(rows, "event_id long, s long, name string, op string")
    return rows, df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 7), (3, 40), (4, 300)])
def test_sessions_across_ranges(spark, seed, ranges):
    rows, events = log(spark, seed)
    want = Counter()
    times = {}
    for _, ts, name, _ in rows:
        if ts is not None:
            times.setdefault(name, []).append(ts)
    for name, seen in times.items():
        start = last = None
        for ts in sorted(seen):
            if last is None or ts - last >= GAP:
                start = ts
            last = ts
            want[name, start] += 1
    found = feed.session_counts(events, f"{GAP} seconds", ranges=ranges)
    found = found.select("name", F.unix_seconds(F.col("session_start").cast("timestamp")).alias("s"), "changes")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((n, s, c) for (n, s), c in want.items()), key=str)


def test_sessions_are_those_of_session_windows(spark):
    _, events = log(spark, 9)
    gap = "60500 milliseconds"  # never exactly between two events: session windows join those
    window = events.groupBy(F.session_window("ts", gap).alias("w"), "name").agg(F.count("*").alias("changes"))
    window = window.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "name", "changes")
    columns = ["name", "session_start", "session_end", "changes"]
    assert values(feed.session_counts(events, gap, ranges=13), *columns) == values(window, *columns)


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 9), (3, 300)])
def test_running_sums_across_ranges(spark, seed, ranges):
    rows, events = log(spark, seed, hot=0.9)
    now, want = Counter(), []
    for k, _, name, op in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        now[name] += {"create": 1, "add": 1, "delete": -1}.get(op, 0)
        want.append((k, name, now[name]))
    found = feed.running_inventory(events, ranges=ranges).select("event_id", "name", "live")
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("ranges", [1, 5, 200])
def test_percentiles_across_ranges(spark, ranges):
    _, events = log(spark, 5, n=2000)
    now = F.lit(50_000).cast("bigint")
    found = feed.event_delay(events, now, ["op"], ranges=ranges)
    delay = now - F.unix_seconds(F.col("ts").cast("timestamp"))
    plain = events.groupBy("op").agg(
        F.count("*").alias("events"), F.min(delay).alias("shortest"), F.max(delay).alias("longest"),
        F.percentile(delay, 0.5).alias("p50"), F.percentile(delay, 0.95).alias("p95"),
    )
    assert values(found, *plain.columns) == values(plain, *plain.columns)


def test_a_hot_key_is_spread(spark):
    """Half of all events are one table's: no range has more than about its share, whatever the table."""
    events = spark.range(20_000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("name"),
        F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("ts"), F.lit("add").alias("op"),
    )
    ranged = in_ranges(events, ["name", "ts", "event_id"], "_range", 16)
    sizes = [r[1] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    summed = running_sums(ranged, ["name"], ["ts", "event_id"], "_range", {"live": F.lit(1)})
    assert summed.filter("name = 'hot'").agg(F.max("live")).first()[0] == 10_000
    # nothing along the whole of a table: every window goes by range, or over one row a range
    plan = summed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2 and "windowspecdefinition(_range" in plan


def test_ranks_of_one_key_open_one_range(spark):
    histogram = spark.range(1000).select(F.lit("op").alias("op"), F.col("id").alias("delay"), (F.col("id") % 3 + 1).alias("n"))
    ranged = in_ranges(histogram, ["op", "delay"], "_range", 10)
    weights = [d for d in range(1000) for _ in range(d % 3 + 1)]
    ranks = [0, 1, 2, 998, 1500, len(weights) - 1]
    wanted = spark.createDataFrame([("op", r) for r in ranks], "op string, rank long")
    found = at_ranks(ranged, ["op"], "delay", "n", "_range", wanted).select("rank", "delay").collect()
    assert sorted(map(tuple, found)) == [(r, weights[r]) for r in ranks]
