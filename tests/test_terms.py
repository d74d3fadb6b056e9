"""Words kept between requests, and column filters in the columns' own types."""

import random
from datetime import datetime
from decimal import Decimal

import pyspark.sql.functions as F
import pytest

from cartulary.functions import predicates as Q
from cartulary.streaming import terms as K
from tests.conftest import values
from tests.test_plans import plan_of


def test_words_follow_their_documents(spark, tmp_path):
    draw = random.Random(4)
    words = ["the", "cat", "Straße", "x1", "dog", "o_o"]
    text = lambda: " ".join(draw.choices(words, k=draw.randint(0, 6)))
    now = {f"d{k}": text() for k in range(20)}

    def rows(docs):
        return K.document_terms(spark.createDataFrame(list(docs.items()) or [("", "")], "name string, body string"), F.col("body"))

    def held(docs):
        return sorted({(w.lower(), n) for n, t in docs.items() for w in t.split()})

    folder, states = str(tmp_path / "terms"), []
    K.start_terms(rows(now), folder)
    for batch in range(4):
        changed = draw.sample(sorted(now), 5)
        old = {n: now[n] for n in changed}
        new = {n: text() for n in changed[:3]} | {f"n{batch}": text()}
        now = {n: t for n, t in now.items() if n not in changed} | new
        K.update_terms(rows(old), rows(new), folder, batch)
        if batch == 2:
            K.update_terms(rows(old), rows(new), folder, batch)  # a repeated batch
            K.fold_terms(spark, folder)
        states.append(held(now))
        assert values(K.read_terms(spark, folder, words), "term", "name") == states[-1]
        assert values(K.read_terms(spark, folder, spark.createDataFrame([(w,) for w in words], "term string")), "term", "name") == states[-1]
    assert values(K.read_terms(spark, folder, words, through=3), "term", "name") == states[3]
    plan = plan_of(K.read_terms(spark, folder, ["The", "cat"]))
    assert plan.count("In(term, [cat,the])") >= 2  # in the base and in the log


def test_words_of_documents_are_few_rows_and_repeated_names_count_once(spark, tmp_path):
    docs = [(f"d{k % 30}" if k else None, f"the cat{k % 3} " + "x " * (k % 2)) for k in range(60)] + [("e", None), ("f", ". ,")]
    shape = "name string, body string"
    rows = lambda some, parts=None: K.document_terms(spark.createDataFrame(some, shape), F.col("body"), parts)
    asked = spark.createDataFrame([("THE",), ("cat1",), ("x",), ("new",)], "term string")
    found = lambda folder: sorted((w, str(n)) for w, n in K.read_terms(spark, folder, asked).select("term", "name").collect())
    want = lambda some: sorted({(w, str(n)) for n, t in some for w in (t or "").split() if w not in (".", ",", "cat0", "cat2")})
    for parts in (1, 3):
        folder = str(tmp_path / f"terms{parts}")
        K.start_terms(rows(docs, parts), folder, parts)
        base = spark.read.parquet(f"{folder}/base/v0")
        assert base.count() <= 5 * parts  # not one for each word and document
        assert base.groupBy("term", "part").count().filter("count > 1").isEmpty()
        assert found(folder) == want(docs)
        gone = [d for d in docs if d[0] == "d4"]
        K.update_terms(rows(gone, parts), rows([("d4", "new cat1"), (None, "the new")], parts), folder, 0)
        now = [d for d in docs if d[0] != "d4"] + [("d4", "new cat1"), (None, "new")]
        assert found(folder) == want(now)
        K.fold_terms(spark, folder)
        assert found(folder) == want(now)
        assert not any(p.name.startswith("unsorted") for p in (tmp_path / f"terms{parts}").iterdir())


def test_columns_compare_in_their_own_type(spark, tmp_path):
    shape = "Id int, big bigint, price decimal(10,2), half float, label string, day date, at timestamp_ntz, ok boolean"
    rows = [
        (1, 10, Decimal("1.50"), 0.5, "a", datetime(2024, 1, 1).date(), datetime(2024, 1, 1, 10), True),
        (2, 11, Decimal("2.00"), 1.5, "b", datetime(2024, 2, 1).date(), datetime(2024, 1, 2, 10), False), (None,) * 8,
    ]
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    times = {"dateCreated": "at", "lastUpdated": "at"}

    def ids(predicate):
        return sorted(str(r[0]) for r in df.filter(predicate).select("Id").collect())

    assert ids(Q.column(df, "ID", ">", 1.9)) == ["2"]  # the fraction goes: above 1
    assert ids(Q.column(df, "id", "!=", 1)) == ["2", "None"] and ids(~Q.column(df, "id", "=", 1)) == ["2", "None"]
    assert ids(Q.column(df, "PRICE", "<=", 1.5)) == ["1"] and ids(Q.column(df, "half", ">", 1)) == ["2"]
    assert ids(Q.column(df, "label", "=", "a")) == ["1"] and ids(Q.column(df, "day", ">=", "2024-01-15")) == ["2"]
    assert ids(Q.column(df, "ok", "=", True)) == ["1"]
    for unit in (1, 1000, 1_000_000):  # seconds, milliseconds, microseconds
        assert ids(Q.column(df, "dateCreated", "<", 1704189600 * unit, times)) == ["1"]
        assert ids(Q.column(df, "lastUpdated", ">=", 1704189600 * unit, times)) == ["2"]
    assert ids(Q.column_between(df, "big", 10, 10.9)) == ["1"] and ids(Q.column_between(df, "big", 10, 10.9, negate=True)) == ["2"]
    plan = plan_of(df.filter(Q.column(df, "ID", ">", 1.9) & Q.column(df, "lastUpdated", ">=", 1704189600, times)))
    assert "GreaterThan(Id,1)" in plan and "GreaterThanOrEqual(at,2024-01-02T10:00)" in plan
    for name, literal in (("label", 1), ("id", "x"), ("id", 1 << 40), ("nothing", 1), ("dateCreated", 1), ("day", "soon"), ("ok", 1), ("id", True)):
        with pytest.raises(ValueError):
            Q.column(df, name, "=", literal)
    with pytest.raises(ValueError):
        Q.column(df, "dateCreated", "=", "2024-01-01", times)
