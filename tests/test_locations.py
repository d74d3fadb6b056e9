"""Chains of location updates over many ranges against a plain walk."""

import random

import pyspark.sql.functions as F
import pytest

from cartulary.operators import changes as C


def plain(tables, updates):
    now, told = dict(tables), []
    for seq, name, previous, new in sorted(updates, key=lambda u: (u[0], u[2] is not None, u[2] or "", u[3] is not None, u[3] or "")):
        if name not in now:
            status = "table missing"
        elif not (now[name] or "").strip(" "):
            status = "stored location empty"
        elif now[name] == new:
            status = "no-op"
        elif not (previous or "").strip(" "):
            status = "previous location empty"
        elif now[name] != previous:
            status = "previous location differs"
        else:
            status, now[name] = "accepted", new
        told.append((seq, name, previous, new, status))
    return sorted(told, key=str), sorted(now.items(), key=str)


def agree(spark, tables, updates, ranges):
    t = spark.createDataFrame(tables, "name string, location string")
    u = spark.createDataFrame(updates, "seq long, name string, previous string, new string")
    judged = C.cas_metadata_location(t, u, ranges)
    told, now = plain(tables, updates)
    assert sorted((tuple(r) for r in judged.collect()), key=str) == told
    assert sorted((tuple(r) for r in C.apply_cas(t, judged).collect()), key=str) == now
    return told


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 6), (3, 25), (4, 80), (5, 400)])
def test_random_updates(spark, seed, ranges):
    draw = random.Random(seed)
    places = [None, "", " ", *[f"s{i}" for i in range(draw.choice([3, 8]))]]
    tables = [("hot", "s0"), ("empty", ""), ("none", None), *[(f"t{i}", draw.choice(places)) for i in range(6)]]
    names = [n for n, _ in tables] + ["missing", None]
    weights = [0 if p is None else 1 if p.strip() == "" else 6 for p in places]
    updates = [
        (draw.randint(0, 250), "hot" if draw.random() < 0.6 else draw.choice(names), *draw.choices(places, weights, k=2)) for _ in range(400)
    ]
    agree(spark, tables, updates, ranges)


def test_one_long_chain_over_many_ranges(spark):
    chain = [(k, "hot", f"s{k}", f"s{k + 1}") for k in range(500)]
    told = agree(spark, [("hot", "s0"), ("cold", "s0")], chain + [(3, "cold", "s0", "s1")], 60)
    assert all(r[-1] == "accepted" for r in told)


def test_a_hot_table_is_spread(spark):
    updates = spark.range(20_000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("name"),
        F.lit("s0").alias("previous"), F.lit("s1").alias("new"),
    )
    tables = updates.select("name", F.lit("s0").alias("location")).distinct()
    judged = C.cas_metadata_location(tables, updates, 16)
    assert judged.groupBy("status").count().orderBy("status").collect()[0][1] == 10_001
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small partitions are put together
    try:
        tasks = judged.filter("name = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(tasks) > 3 and max(r[1] for r in tasks) < 6_000
