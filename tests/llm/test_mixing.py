from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartulary.llm.mixing import fit_counts, mix_sources, mixed, targets

from .odd import odd


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100, None: 100}, {"a": 1, "b": 5000, "é": 10, "z": 0}, {"only": 7}, {None: 3, "a": 900}, {"a": 0, "b": 0},
])
def test_targets_agree_with_sharing_again_and_again(spark, sizes):
    rows = [(s, n - n // 2) for s, n in sizes.items()] + [(s, n // 2) for s, n in sizes.items()]
    found = {r["source"]: r["target"] for r in targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert found == pytest.approx(slow_targets(sizes))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 5), min_size=1, max_size=6), st.floats(0, 1.2), st.sampled_from([0, 20, 4096]))
def test_fit_is_the_best_sum_or_near(counts, part, fine):
    lengths, n = np.array(list(counts)), np.array(list(counts.values()))
    total = int((lengths * n).sum())
    budget = min(int(part * total), total)
    taken = fit_counts(lengths, n, budget, fine)
    assert (taken >= 0).all() and (taken <= n).all()
    got = int((taken * lengths).sum())
    sums = {0}
    for length, k in counts.items():
        sums = {s + j * length for s in sums for j in range(k + 1)}
    best = min(abs(s - budget) for s in sums)
    assert abs(got - budget) <= (best if budget <= fine else lengths.max())


def test_mix_comes_near_its_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mix_sources(docs).toPandas()
    assert len(rows) == docs.count() and (rows["taken"] <= 2 * rows["size"]).all()
    assert (rows.loc[rows["size"] > 0, "taken"] % rows.loc[rows["size"] > 0, "size"] == 0).all()
    for _, group in rows.groupby("source", dropna=False):
        whole, target = group["taken"].sum(), group["target"].iloc[0]
        copies = target // max(1, group["size"].sum())
        sums = {0}
        for size in group["size"]:
            sums |= {s + size for s in sums}
        best = min(abs(copies * group["size"].sum() + s - target) for s in sums)
        assert abs(whole - target) <= best + group["size"].min()
    again = mix_sources(docs.repartition(5)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert rows[order].sort_values(order).values.tolist() == again[order].sort_values(order).values.tolist()


def test_many_documents_of_one_length(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('w', id, ' two three') as text", "'s' as source")
    docs = docs.union(spark.range(5000, 5004).selectExpr("id", "repeat('x ', 4000)", "'t'"))
    rows = mix_sources(docs).toPandas()
    for source, group in rows.groupby("source"):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) <= (2 if source == "s" else 2000)


def test_odd_rows(spark):
    docs = odd(spark)
    rows = mix_sources(docs)
    assert rows.count() == docs.count() and rows.where("size = 0 and taken <> 0").isEmpty()
    times = mixed(docs)
    assert times.schema == docs.schema
    assert times.count() == rows.where("size > 0").selectExpr("sum(taken div size)").first()[0]
    assert mix_sources(odd(spark, [])).count() == mixed(odd(spark, [])).count() == 0


def test_columns_of_any_name(spark):
    docs = spark.range(200).selectExpr(
        "id as doc_id", "concat('w', id, repeat(' x', int(id % 7))) as text", "if(id % 3 = 0, null, 's') as source",
        "id as `a.b`", "id + 1 as _source", "id + 2 as _facts", "id + 3 as _times", "id + 4 as `_copy`", "id + 5 as _top", "id as f",
    )
    found = mixed(docs)
    assert found.schema == docs.schema
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix_sources(docs).collect()}
    rows = found.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({k: n for k, n in taken.items() if n})
    assert all(r["a.b"] == r["f"] == r["doc_id"] and r["_source"] == r["doc_id"] + 1 and r["_top"] == r["doc_id"] + 5 for r in rows)
