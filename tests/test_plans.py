"""What the physical plans must and must not contain."""

import pyspark.sql.functions as F
import pytest

from cartulary.functions import predicates as Q
from cartulary.operators import names as N
from cartulary.operators import partitions as P
from cartulary.plans import QUERIES
from cartulary.plans.bindings import Bindings
from cartulary.sources.snapshot import read_snapshot, write_snapshot


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_query_compares_all_pairs(spark, small, name):
    plan = plan_of(QUERIES[name].build(Bindings(spark, small)))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_listing_with_a_limit_is_a_top_k(spark, small):
    plan = plan_of(P.list_partitions(Bindings(spark, small).parts, limit=20))
    assert "TakeOrderedAndProject" in plan


def test_a_page_with_an_offset_never_goes_through_one_task(spark, small):
    plan = plan_of(QUERIES["partition_list_page"].build(Bindings(spark, small)))
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan and "_range" in plan


def test_listing_without_a_limit_never_goes_through_one_task(spark, small):
    plan = plan_of(QUERIES["sort_page_rest"].build(Bindings(spark, small)))
    assert "rangepartitioning" in plan and "GlobalLimit" not in plan.split("TakeOrderedAndProject")[0]


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = plan_of(QUERIES["predicate_native_columns"].build(Bindings(spark, small)))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "l_extendedprice" not in plan


def test_snapshot_with_key_columns_prunes(spark, small, tmp_path):
    path = str(tmp_path / "snap")
    parts = P.with_key_columns(Bindings(spark, small).parts, ["dateint", "status"])
    write_snapshot(parts.withColumn("key_status", F.coalesce("key_status", F.lit("none"))), path, ["key_status"])
    read = read_snapshot(spark, path)
    day = F.col("key_dateint")
    found = read.filter(Q.eq(F.col("key_status"), "F") & Q.compare(day, ">=", "1997") & Q.like(day, "19970_0%"))
    plan = plan_of(found)
    assert "PartitionFilters: [" in plan and "key_status" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(key_dateint,1997)" in plan and "StringStartsWith(key_dateint,19970)" not in plan
    assert "In(key_dateint, [1,2])" in plan_of(read.filter(Q.in_list(day, ["1", "2"])))
    assert "StringStartsWith(key_dateint,1997)" in plan_of(read.filter(Q.like(day, "1997%1")))
    prefix = plan_of(N.starts_with_name(read, "dateint=1997", "part_name"))
    assert "StringStartsWith(part_name,dateint=1997)" in prefix


def test_typed_keys_and_creation_times_reach_the_scan(spark, small, tmp_path):
    path = str(tmp_path / "typed")
    parts = Bindings(spark, small).parts
    write_snapshot(P.with_key_columns(parts, ["dateint", "status"], {"dateint": "bigint"}), path)
    read = read_snapshot(spark, path)
    days = Q.typed(F.col("key_dateint"), "integral", ">=", 19970101) & Q.typed(F.col("key_dateint"), "integral", "<", 19970201)
    plan = plan_of(read.filter(days))
    assert "GreaterThanOrEqual(key_dateint,19970101)" in plan and "LessThan(key_dateint,19970201)" in plan
    dateint = P.key("dateint", ["dateint", "status"])
    wanted = parts.filter(Q.compare(dateint, ">=", 19970101) & Q.compare(dateint, "<", 19970201))
    assert read.filter(days).count() == wanted.count() > 0
    plan = plan_of(read.filter(P.created(">", 852076800)))
    assert "GreaterThan(create_time,1997-01-01T00:00" in plan
    times = spark.createDataFrame([(None,), ("1997-01-01 00:00:00",), ("1997-01-01 00:00:00.5",)], "t string")
    times = times.select(F.col("t").cast("timestamp_ntz").alias("create_time"))
    counts = [times.filter(P.created(op, 852076800)).count() for op in ("=", "!=", "<", "<=", ">", ">=")]
    assert counts == [1, 2, 0, 1, 1, 2]


def test_a_local_session_keeps_its_settings(spark):
    from cartulary.session import shared_folder

    before = spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark) == shared_folder(spark)
    assert spark.sparkContext.getCheckpointDir() == before


@pytest.mark.parametrize(
    "name,most", [("table_rename", 40), ("table_rename_refused", 40), ("metadata_rename", 20), ("data_rename", 20), ("tag_rename", 20), ("relation_rename", 20)]
)
def test_renames_are_judged_once(spark, small, name, most):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name].build(Bindings(spark, small))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < plan.count("Exchange hashpartitioning") <= most
