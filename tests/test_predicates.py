"""Predicates against a plain model of their rules, over all pairs of values and conditions."""

import re
from decimal import Decimal

import pyspark.sql.functions as F
import pytest

from cartulary.functions import predicates as Q
from cartulary.functions.partition_names import key_value
from cartulary.operators import partitions as P


def key(name):
    return key_value(F.col("part_name"), name)


VALUES = [
    None, "", "8", "08", "8.0", "8.50", "-8", "+8", "-0", "0", "41", "409", "-409.25", ".5", "8e1", "8x", "Rome", "rome", "Oslo",
    "9223372036854775807", "9223372036854775808", "-9223372036854775809", "73" * 20, "-" + "73" * 20, "73" * 20 + ".01",
    "0.0000000000000000001", "-0.0000000000000000001", "0." + "3" * 40,
]
NUMBERS = [0, 8, -8, 41, 8.5, -409.25, 0.5, 80, (1 << 63) - 1, 1 << 63, int("73" * 20), -int("73" * 20), Decimal("0." + "3" * 40)]
TEXTS = ["8", "Oslo", "rome", "", "41"]
PATTERNS = ["%", "8%", "%0_", "R_me", "_", "Oslo", "%o%", "", "4%9", "[_]%"]


def number(text):
    """The number that a key spells, or None."""
    return Decimal(text) if text and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)(e\d+)?", text) else None


def meets(value, op, literal):
    """One comparison by the rules: a number compares by value, a text by its characters, null with nothing."""
    numeric = not isinstance(literal, str)
    a, b = (number(value), Decimal(str(literal))) if numeric else (value, literal)
    if op == "=":
        return a == b and a is not None
    return a is not None and {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def like(value, pattern):
    words = {"%": ".*", "_": "."}
    spelled = "".join(words.get(c, re.escape(c)) if len(c) == 1 else re.escape(c[1]) for c in re.findall(r"\[.\]|.", pattern, re.S))
    return value is not None and re.fullmatch(spelled, value, re.S) is not None


def cases():
    """Conditions on column v, each with the rule that it must follow."""
    v = F.col("v")
    literals = [*NUMBERS, *TEXTS]
    for x in literals:
        for op in ("<", "<=", ">", ">="):
            yield Q.compare(v, op, x, permissive=True), lambda t, op=op, x=x: meets(t, op, x)
        for op in ("=", "=="):
            yield Q.compare(v, op, x, permissive=True), lambda t, x=x: meets(t, "=", x)
        for op in ("!=", "<>"):
            yield Q.compare(v, op, x, permissive=True), lambda t, x=x: not meets(t, "=", x)
        yield ~Q.compare(v, "<", x, permissive=True), lambda t, x=x: not meets(t, "<", x)
    for low, high in [(-8, 8), (8, 41), (0.25, 8.5), (-(1 << 70), 1 << 70), ("8", "Oslo"), ("Oslo", "rome"), (41, 8)]:
        for negate in (False, True):
            yield (
                Q.between(v, low, high, negate, permissive=True),
                lambda t, low=low, high=high, n=negate: (meets(t, ">=", low) and meets(t, "<=", high)) != n,
            )
    for some in ([8], [8, 41, "Rome"], [None, "8"], [], [Decimal("8.5"), 1 << 63], ["", None, 0]):
        for negate in (False, True):
            yield (
                Q.in_list(v, some, negate, permissive=True),
                lambda t, s=some, n=negate: any(t is None if x is None else meets(t, "=", x) for x in s) != n,
            )
    for p in PATTERNS:
        for negate in (False, True):
            yield Q.like(v, p, negate), lambda t, p=p, n=negate: like(t, p) != n
    for negate in (False, True):
        yield Q.is_null(v, negate), lambda t, n=negate: (t is None) != n
        yield Q.matches(v, "[a-zO].*|8+", negate), lambda t, n=negate: (t is not None and bool(re.fullmatch("[a-zO].*|8+", t))) != n
    yield Q.eq(v, None), lambda t: t is None
    yield Q.truth(v), lambda t: False
    both = Q.compare(v, ">", 7, permissive=True) & (Q.like(v, "%8") | ~Q.ne(v, 409, permissive=True))
    yield both, lambda t: meets(t, ">", 7) and (like(t, "%8") or meets(t, "=", 409))


def test_every_condition_follows_its_rule_on_every_value(spark):
    table = list(cases())
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(VALUES)], "i int, v string")
    wrong = []
    for at in range(0, len(table), 60):  # one job for so many conditions
        part = table[at : at + 60]
        for r in rows.select("i", *[c.alias(f"c{k}") for k, (c, _) in enumerate(part)]).collect():
            wrong += [(at + k, VALUES[r["i"]]) for k, (_, rule) in enumerate(part) if r[f"c{k}"] is not bool(rule(VALUES[r["i"]]))]
    assert not wrong


def test_literals_compare_with_literals_by_the_right_side(spark):
    row = spark.range(1).select(
        Q.compare("30", "<", "4"), Q.compare("30", "<", 4), Q.eq("yes", "yes"), Q.eq("yes", "no"), Q.truth(True), Q.truth(False),
        Q.truth("TRUE"), Q.truth("yes"),
    ).first()
    assert list(row) == [True, False, True, False, True, False, True, False]


def test_conditions_on_names_and_paths(spark):
    rows = [
        ("city=Oslo/rank=3", "s3://x/load=7"), ("city=__HIVE_DEFAULT_PARTITION__/rank=12", "s3://x"), ("rank=3/first-seen=9", "s3://x/load=8/y"),
        ("city=__hive_default_partition__/load=4", "s3://x/load=7"), ("city=Rome/city=Oslo/rank=-2", None),
    ]
    parts = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, part_name string, uri string")
    wanted = [
        (Q.eq(key("city"), "Oslo"), [0, 4]), (Q.is_null(key("city")), [1, 2, 3]), (Q.compare(key("rank"), "<", 4), [0, 2, 4]),
        (Q.eq(key("first-seen"), 9), [2]), (Q.compare(P.batch_id("load"), ">=", 7), [0, 2]), (Q.eq(P.batch_id("load"), 4), [3]),
        (Q.ne(key("city"), "Oslo") & Q.is_null(key("rank"), negate=True), [1, 2]),
    ]
    for condition, found in wanted:
        assert [r["i"] for r in parts.filter(condition).orderBy("i").collect()] == found


def test_like_keeps_bracketed_marks_and_sets(spark):
    rows = spark.createDataFrame([("100%",), ("100 of it",), ("a_b",), ("axb",), ("[c",), ("dog",), ("fog",)], "v string")
    for pattern, found in {
        "100[%]": ["100%"], "a[_]b": ["a_b"], "[df]og": ["dog", "fog"], "a_b": ["a_b", "axb"], "%o%": ["100 of it", "dog", "fog"],
    }.items():
        assert sorted(r[0] for r in rows.filter(Q.like(F.col("v"), pattern)).collect()) == found


def test_undeclared_key_is_an_error():
    with pytest.raises(ValueError):
        P.key("batchid", ["dateint"])


def test_strict_number_comparison_fails_on_text(spark):
    df = spark.createDataFrame([("app=x1",)], "part_name string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.filter(Q.eq(key("app"), 1)).collect()


@pytest.mark.parametrize("kind_, literal", [("integral", "1"), ("date", "19970101"), ("string", 3), ("timestamp", 5)])
def test_typed_literal_must_fit(kind_, literal):
    with pytest.raises(ValueError):
        Q.typed(F.lit("x"), kind_, "=", literal)


def test_pages_of_a_filtered_listing(spark):
    parts = spark.createDataFrame(
        [(i, "t", f"zone=b/slot={i % 6}/n={i}", f"s3://t/{i}") for i in range(30)],
        "part_id int, table_name string, part_name string, uri string",
    )
    wanted = Q.between(key("slot"), 2, 3)
    whole = [i for i in range(30) if i % 6 in (2, 3)]
    for offset, limit in ((0, None), (0, 4), (3, 4), (8, 9), (10, 1), (4, None)):
        page = P.list_partitions(parts, wanted, offset=offset, limit=limit).collect()
        assert sorted(r.part_id for r in page) == whole[offset:][:limit]


def test_long_values_of_a_partial_spec(spark):
    names = [(f"k={v}/d=1",) for v in ("09000000000000000000", "9000000000000000000", "x", "99999999999999999999", "099999999999999999999")]
    parts = spark.createDataFrame(names, "part_name string")
    found = P.match_partial_spec(parts, ["k", "d"], ["9000000000000000000"])
    assert sorted(r[0] for r in found.collect()) == ["k=09000000000000000000/d=1", "k=9000000000000000000/d=1"]
    assert P.match_partial_spec(parts, ["k", "d"], ["99999999999999999999", "1"]).count() == 1
