"""Partition keys declared per table, pages with clashing column names, metrics kept up to date, measured slices."""

import random

import pyspark.sql.functions as F
import pytest

from cartulary.functions import partition_names as N
from cartulary.functions import predicates as Q
from cartulary.operators import changes as C
from cartulary.operators import partitions as P
from tests.conftest import values

NAMES = [
    "d=1/h=2", "h=2/d=1", "d=1", "", "/", " d = 1 / h= x y ", "d=", "d=null", "d=NULL /h=1", "d=nullx", "x=1", "d=1=2", "d", "=1", "d=1//h=2/",
    "d=a b", "D=1", "d=1/d=2", "d=__HIVE_DEFAULT_PARTITION__", "d=1/\t/h=3", "d=%2F", "d=1/h", "d= =", "dd=1",
]


def test_own_keys_judge_like_a_list(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "part_name string")
    for keys in (["d", "h"], ["d"], ["h", "x", "dd"]):
        own = F.array(*[F.lit(k) for k in keys])
        both = rows.select("part_name", N.is_valid_name(F.col("part_name"), keys).alias("a"), N.fits_keys(F.col("part_name"), own).alias("b"))
        assert both.filter("a <> b").collect() == []


SCHEMA = [("t", "d", "int"), ("u", "d", "string"), ("v", "d", "date"), ("w", "d", "timestamp"), ("w", "h", "bigint"), ("z", "other", "int")]


def schema(spark):
    return spark.createDataFrame(SCHEMA, "table_name string, pkey_name string, pkey_type string")


def test_one_key_of_many_types(spark):
    values_of = {"t": ["1", "9", "10", None], "u": ["1", "9", "10", None], "v": ["2024-01-01", "2024-02-01"], "w": ["2024-01-01 10:00:00"], "z": ["1"], "none": ["1"]}
    rows = [(t, f"d={v or N.DEFAULT_PARTITION}") for t, vs in values_of.items() for v in vs]
    parts = spark.createDataFrame(rows, "table_name string, part_name string")
    found = P.filter_typed(parts, schema(spark), "d", ">", 5, strict=False)
    assert values(found, *parts.columns) == [("t", "d=10"), ("t", "d=9")]
    found = P.filter_typed(parts, schema(spark), "d", ">=", "2024-01-15", strict=False)
    # as text "9" is after "2024-01-15", and "1", "10" before
    assert values(found, *parts.columns) == [("u", "d=9"), ("v", "d=2024-02-01")]
    with pytest.raises(Exception, match="does not fit a key of type"):
        P.filter_typed(parts, schema(spark), "d", ">", 5).collect()
    assert P.filter_typed(parts.filter("table_name = 't'"), schema(spark), "d", ">", 5).count() == 2
    with pytest.raises(ValueError):
        Q.typed_as(F.col("a"), F.col("b"), "=", 1.5)


def test_saves_and_checks_by_each_tables_keys(spark):
    incoming = spark.createDataFrame(
        [("t", "d=1", "a"), ("w", "h=1", "b"), ("w", "d=1/h=1", "c"), ("t", "h=1", "d"), ("none", "d=1", "e"), ("none", "", "f")],
        "table_name string, part_name string, uri string",
    )
    stored = spark.createDataFrame([("t", "d=1", "a")], incoming.schema)
    plan = C.plan_partition_save(stored, incoming, keys=schema(spark))
    assert values(plan, "table_name", "part_name", "action") == sorted([
        ("t", "d=1", "unchanged"), ("w", "h=1", "added"), ("w", "d=1/h=1", "added"), ("t", "h=1", C.INVALID), ("none", "d=1", C.INVALID), ("none", "", "added"),
    ], key=str)
    assert values(P.invalid_names(incoming, schema(spark)), "uri") == [("d",), ("e",)]
    assert P.invalid_names(incoming, schema(spark)).columns == incoming.columns


def test_a_page_leaves_clashing_columns_alone(spark):
    rows = spark.range(50).select(
        F.col("id").alias("part_id"), F.lit("t").alias("table_name"), F.concat(F.lit("d="), "id").alias("part_name"),
        F.lit(5).alias("_number"), F.lit(6).alias("_range"), F.lit(7).alias("_size"), F.lit(8).alias("_start"), F.lit(9).alias("_RANGE_"),
    )
    page = P.sort_page(rows, [F.col("part_id").desc()], ["part_id"], offset=10, limit=5)
    assert [tuple(r) for r in page.collect()] == [(39 - k, "t", f"d={39 - k}", 5, 6, 7, 8, 9) for k in range(5)]


@pytest.mark.parametrize("seed", range(4))
def test_metrics_after_a_snapshot_equal_those_of_all_files(spark, seed):
    from cartulary.sources import metastore as M

    draw = random.Random(seed)

    def file(k):
        newest = None if draw.random() < 0.1 else draw.randint(1, 9)
        return draw.choice(["a", "b", "c", None]), f"f{k}", draw.randint(0, 5), newest

    old = [file(k) for k in range(draw.choice([0, 3, 30]))]
    gone = draw.sample(old, len(old) // 2)
    new = [file(100 + k) for k in range(draw.choice([0, 4]))]
    # a rewritten file is on both lists
    new += [(p, path, n + 1, newest) for p, path, n, newest in gone[:2]]
    left = [f for f in old if f not in gone] + new
    shape = "part string, path string, row_count long, newest long"
    frames = {k: spark.createDataFrame(v, shape) for k, v in (("old", old), ("gone", gone), ("new", new), ("left", left))}
    found = M.update_metrics(M.metrics_of_files(frames["old"], ["part"]), frames["left"], frames["new"], frames["gone"], ["part"])
    want = M.metrics_of_files(frames["left"], ["part"])
    assert values(found, *want.columns) == values(want, *want.columns)


def test_file_metrics_read_files_once(spark, tmp_path):
    from cartulary.sources import metastore as M

    spark.range(100).selectExpr("id % 3 AS k", "id AS t").repartition(4).write.parquet(str(tmp_path / "d"))
    data = spark.read.parquet(str(tmp_path / "d"))
    found = M.metrics_of_files(M.file_metrics(data, ["k"], "t"), ["k"])
    assert values(found, "k", "row_count", "newest") == values(M.partition_metrics(data, ["k"], "t"), "k", "row_count", "newest")


def test_measured_slices_are_even_and_whole(spark):
    from cartulary.sources import jdbc

    keys = spark.range(3000).select(F.when(F.col("id") % 100 == 0, None).otherwise(F.format_string("k%05d", F.col("id") * F.col("id") % 7001)).alias("k"))
    bounds = jdbc.slice_bounds(keys, "k", 8)
    assert len(bounds) == 7 and bounds == sorted(set(bounds))
    sizes = [keys.filter(p).count() for p in jdbc.slices("k", bounds)]
    assert sum(sizes) == 3000 and max(sizes) < 2 * 3000 / 8
    under = jdbc.slice_bounds(keys, "k", 4, "k01")
    assert all(b.startswith("k01") for b in under)
    assert jdbc.read_sliced(keys.filter, "k", under, "k01").count() == keys.filter("k LIKE 'k01%'").count()
    assert jdbc.slice_bounds(keys.filter("false"), "k", 4) == [] and jdbc.slices("k", []) == ["1 = 1"]
    assert jdbc.slice_bounds(keys.filter("k = 'k00001'"), "k", 4) == []
