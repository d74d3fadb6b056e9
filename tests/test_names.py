"""Names, partition names, times and types."""

import pyspark.sql.functions as F
import pytest
from pyspark.sql.types import StructType

from cartulary.functions import names as N
from cartulary.functions import partition_names as P
from cartulary.functions.times import partition_time
from cartulary.functions.types import normalize_types
from cartulary.operators import names as ops
from tests.conftest import values


def test_parse_name(spark):
    cases = [
        ("prod", ("prod", "", "", "", "", "CATALOG")),
        (" prod/db ", ("prod", "db", "", "", "", "DATABASE")),
        ("prod/db/t", ("prod", "db", "t", "", "", "TABLE")),
        ("prod/db/t/a=1/b=2", ("prod", "db", "t", "a=1/b=2", "", "PARTITION")),
        ("prod/db/t/view", ("prod", "db", "t", "", "view", "MVIEW")),
    ]
    df = ops.parse_name(spark.createDataFrame([(n,) for n, _ in cases], "name string"))
    got = {r[0]: tuple(r[1:]) for r in df.select("name", *N.PARTS, "entity_type").collect()}
    assert got == dict(cases)


def test_case_rules(spark):
    rows = [("Prod", "Db", "T"), ("cde_X", "Db", "T"), ("myDruid", "Db", "T"), ("snowflake-dse", "Db", "T")]
    df = spark.createDataFrame(rows, "catalog_name string, database_name string, table_name string")
    plain = values(ops.standardize_name(df), "name")
    upper = values(ops.standardize_name(df, upper_catalogs=True), "name")
    assert plain == [("cde_x/Db/T",), ("mydruid/Db/T",), ("prod/db/t",), ("snowflake-dse/db/t",)]
    assert ("snowflake-dse/DB/T",) in upper


@pytest.mark.parametrize(
    "levels, listing, all_levels",
    [
        ((None, None, None), None, None),
        (("c", None, None), "c%", "c/%/%%"),
        ((None, "d", None), "%/d%", "%/d/%%"),
        ((None, None, "t"), "%/%/t%", "%/%/t%"),
        (("c", "d", None), "c/d%", "c/d/%%"),
        (("c", "d", "t"), "c/d/t%", "c/d/t%"),
    ],
)
def test_patterns(levels, listing, all_levels):
    assert N.listing_pattern(*levels) == listing
    assert N.level_pattern(*levels) == all_levels


def test_json_name_without_parts(spark):
    df = spark.createDataFrame([('{"qualifiedName":"a/b/c/x=1"}',), ('{"catalogName":"a","databaseName":"b"}',)], "name_json string")
    got = values(ops.format_name(ops.name_from_json(df)), "name")
    assert got == [("a/b",), ("a/b/c/x=1",)]


def test_key_map_rules(spark):
    cases = [
        ("a=1/b=2", {"a": "1", "b": "2"}),
        ("a=1/a=2", {"a": "2"}),
        ("a=1/a=null", {"a": "1"}),
        ("null=1/b=NULL/c=", {"c": ""}),
        ("x/a=b=c", {"a": "b=c"}),
        ("a=__hive_default_partition__/b=1", {"a": None, "b": "1"}),
        ("a=1/a=__HIVE_DEFAULT_PARTITION__", {"a": None}),
        ("//a=1//b=2/", {"a": "1", "b": "2"}),
        ("a.b=1/axb=2", {"a.b": "1", "axb": "2"}),
        ("plain", {}),
    ]
    df = spark.createDataFrame([(n,) for n, _ in cases], "n string")
    got = dict(df.select("n", P.key_map(F.col("n"))).collect())
    assert got == dict(cases)
    keys = sorted({k for _, m in cases for k in m})
    one_by_one = df.select("n", *[P.key_value(F.col("n"), k).alias(f"`{k}`") for k in keys]).collect()
    for row in one_by_one:
        want = dict(cases)[row[0]]
        assert list(row[1:]) == [want.get(k) for k in keys]


def test_valid_names(spark):
    cases = {
        "a=1/b=2": True, "b=2": True, " a = 1 /b=2/": True, "a=1//b=x y": True, "": True,
        "a=": False, "a=null": False, "a=Null /b=2": False, "c=1": False, "a=1=2": False, "a": False, "a=1/x": False,
    }
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    assert dict(df.select("n", P.is_valid_name(F.col("n"), ["a", "b"])).collect()) == cases
    with pytest.raises(ValueError):
        P.is_valid_name(F.col("n"), [])


def test_escaping(spark):
    df = spark.createDataFrame([("a b", "x/y"), ("é😀#", None), ("100%", "")], "k string, v string")
    got = [r[0] for r in df.select(P.make_name({"k": F.col("k"), "v v": F.col("v")})).collect()]
    assert got == [
        "k=a b/v v=x%2Fy",
        "k=é😀%23/v v=__HIVE_DEFAULT_PARTITION__",
        "k=100%25/v v=__HIVE_DEFAULT_PARTITION__",
    ]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_partition_time_in_any_session_zone(spark, zone):
    cases = [
        ("20180101", False, 1514764800),
        ("20180101", True, 1514793600),
        ("20180701", True, 1530428400),
        ("1522257960", True, 1522257960),
        ("1522257960000", False, 1522257960),
        ("1367992474.293378", False, 1367992474),
        ("1367992474000.293378", False, 1367992474),
        ("20181301", False, 1546300800),
        ("2018-01-01", False, None),
        ("15222579601", False, None),
        ("soon", True, None),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(v, r) for v, r, _ in cases], "v string, r boolean")
        got = [r[0] for r in df.select(partition_time(F.col("v"), F.col("r"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [w for _, _, w in cases]


MYSQL = [
    ("SmallInt(6)", "smallint", "smallint"), ("bigint(20) unsigned", "bigint", "bigint"), ("mediumint", "int", "int"),
    ("dec", "decimal(10,0)", "decimal(10,0)"), ("decimal( 12 )", "decimal(12,0)", "decimal(12,0)"),
    ("decimal(65,30)", "decimal(65,30)", "string"), ("bit(17)", "varbinary(3)", "binary"), ("bit", "boolean", "boolean"),
    ("varchar(8) binary", "varbinary(8)", "binary"), ("char", "unknown", "string"), ("varchar(0)", "varchar(0)", "string"),
    ("tinyblob", "varbinary(2147483647)", "binary"), ("DOUBLE  PRECISION", "double", "double"), ("json", "json", "string"),
    ("datetime(6)", "timestamp", "timestamp_ntz"), ("enum('a','b(2)')", "unknown", "string"), ("", "unknown", "string"),
    (None, "unknown", "string"), ("int(", "unknown", "string"),
]
POSTGRESQL = [
    ("timestamp(6) with time zone", "timestamp with time zone", "timestamp"), ("timestamp", "timestamp", "timestamp_ntz"),
    ("timestamp without time zone", "timestamp", "timestamp_ntz"), ("time(3) with time zone", "time with time zone", "string"),
    ("varchar", "unknown", "string"), ("character varying(77)", "varchar(77)", "varchar(77)"), ("text[]", "array<string>", "array<string>"),
    ("float8[][][]", "array<array<array<double>>>", "array<array<array<double>>>"), ("real array", "array<float>", "array<float>"),
    ("bit varying(12)", "varbinary(2)", "binary"), ("numeric(1,3)", "decimal(1,3)", "decimal(3,3)"), ("time", "time", "string"), ("numeric(9,4)[]", "array<decimal(9,4)>", "array<decimal(9,4)>"), ("box", "unknown", "string"),
]
REDSHIFT = [
    ("text(500)", "varchar(256)", "varchar(256)"), ("name", "varchar(256)", "varchar(256)"), ("bpchar(9)", "char(256)", "char(256)"),
    ("nvarchar(30)", "varchar(30)", "varchar(30)"), ("varchar", "varchar(256)", "varchar(256)"), ("varchar(-1)", "varchar(256)", "varchar(256)"),
    ("oid", "bigint", "bigint"), ("super", "unknown", "string"),
]
SNOWFLAKE = [
    ("string", "varchar(256)", "varchar(256)"), ("varchar(12)", "varchar(12)", "varchar(12)"), ("binary", "varbinary(256)", "binary"),
    ("timestamp with local time zone", "timestamp with time zone", "timestamp"), ("timestamp_ntz(9)", "timestamp", "timestamp_ntz"),
    ("number", "decimal(10,0)", "decimal(10,0)"), ("tinyint", "smallint", "smallint"), ("geography", "unknown", "string"),
]
HIVE = [
    ("struct<timestamp:bigint,json:string>", "row<timestamp:bigint,json:string>", "struct<timestamp:bigint,json:string>"),
    ("struct<binary:int>", "row<binary:int>", "struct<binary:int>"), ("struct<Ab:Date,c-d:void>", "row<Ab:date,c-d:varbinary>", "struct<Ab:date,`c-d`:binary>"),
    ("array< map<string , varchar(4)> >", "array<map<string,varchar(4)>>", "array<map<string,varchar(4)>>"),
    ("varchar", "string", "string"), ("decimal", "decimal(10,0)", "decimal(10,0)"), ("array<interval>", "array<unknown>", "array<string>"),
    ("uniontype<int,string>", "unknown", "string"), ("map<int>", "unknown", "string"), ("array<int", "unknown", "string"),
    ("array<" * 40 + "int" + ">" * 40, "array<" * 40 + "int" + ">" * 40, "array<" * 40 + "int" + ">" * 40),
]
CASSANDRA = [
    ("tuple<int,text>", "row<field0:int,field1:string>", "struct<field0:int,field1:string>"), ("set<frozen<list<int>>>", "unknown", "string"),
    ("frozen<map<ascii,frozen<list<frozen<tuple<counter,blob>>>>>>", "map<string,array<row<field0:bigint,field1:varbinary(2147483647)>>>",
     "map<string,array<struct<field0:bigint,field1:binary>>>"),
    ("list<set<int>>", "array<unknown>", "array<string>"), ("timeuuid", "unknown", "string"),
]
PIG = [("long", "bigint", "bigint"), ("bigdecimal", "double", "double"), ("byte", "varbinary", "binary")]
TYPES = [
    (dialect.lower(), *row)
    for dialect, rows in (("MYSQL", MYSQL), ("POSTGRESQL", POSTGRESQL), ("REDSHIFT", REDSHIFT), ("SNOWFLAKE", SNOWFLAKE),
                          ("HIVE", HIVE), ("CASSANDRA", CASSANDRA), ("PIG", PIG))
    for row in rows
]


def test_types(spark):
    df = spark.createDataFrame([(d, s) for d, s, _, _ in TYPES], "dialect string, source_type string")
    got = {(r.dialect, r.source_type): (r.canonical_type, r.spark_type) for r in normalize_types(df).collect()}
    assert got == {(d, s): (c, t) for d, s, c, t in TYPES}



def test_spark_types_are_types_of_spark(spark):
    kinds = sorted({t for _, _, _, t in TYPES})
    row = spark.range(1).select(*[F.lit(None).cast(k).alias(f"c{i}") for i, k in enumerate(kinds)])
    assert row.collect() and StructType.fromDDL("x int").names == ["x"]
