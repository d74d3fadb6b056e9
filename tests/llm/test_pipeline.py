import pyspark.sql.functions as F

import __spark_entry__ as contract
import corpus_pipeline as P
from cartulary.llm import queries

from tests.oracle import connect, rows_of

from .odd import odd


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix", "pack"]


def test_stages_keep_the_columns_of_odd_documents(spark, small):
    docs = odd(spark)
    for name, stage in P.STAGES[:-1]:
        found = stage(spark, docs, small)
        assert found.schema == docs.schema, name
        assert stage(spark, odd(spark, []), small).count() == 0
    assert P.pack(spark, odd(spark, []), small).count() == 0


def test_run_is_its_stages_one_after_the_other(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}
    named = P.language_id(spark, docs, small)
    assert {r[0] for r in named.select("doc_id").collect()} <= {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    assert named.count() > 0.95 * len(texts)
    once = {r[0] for r in P.exact_dedup(spark, named, small).select("doc_id").collect()}
    last = {}
    for r in named.select("doc_id", "text").collect():
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert once == set(last.values())
    found = P.run(spark, small)
    per = {(r[0], r[1]): r[2] for r in found.groupBy("doc_id", "copy").agg(F.sum("size")).collect()}
    assert {i for i, _ in per} <= once and all(n == len(texts[i].encode().split()) for (i, _), n in per.items())


def test_every_operator_has_one_query(spark):
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())


def test_queries_agree_with_their_sql(spark, small):
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, small).toPandas(), connect(small).execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
