from collections import Counter, defaultdict

import pyspark.sql.functions as F
import pytest

from cartulary.llm.exact import exact_dedup, exact_groups, frequent

from .odd import TEXTS, odd, texts


def expected():
    groups = defaultdict(list)
    for i, t in texts():
        groups[t].append(i)
    out = Counter()
    for i, t in texts():
        known = [x for x in groups[t] if x is not None]
        keep = max(known) if known else None
        out[i, keep, len(groups[t]), i == keep] += 1
    return out


@pytest.mark.parametrize("counters", [1, 2, 256])
def test_groups_agree_with_brute_force(spark, counters):
    found = exact_groups(odd(spark), counters=counters)
    rows = found.select("doc_id", "keep_id", "group_size", "kept").collect()
    assert Counter(map(tuple, rows)) == expected()


def test_one_row_of_each_text_stays(spark):
    docs = odd(spark)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter({t for _, t in texts()})
    assert kept.where("text = 'the same text'").first()["doc_id"] == 9


def test_empty_table(spark):
    assert exact_groups(odd(spark, [])).count() == exact_dedup(odd(spark, [])).count() == 0


def test_misra_gries_finds_every_frequent_value(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 20 == 1, F.lit("warm")).otherwise(F.col("id").cast("string")).alias("key")
    )
    found = {r[0] for r in frequent(rows.repartition(7), "key", 50).collect()}
    assert {"hot", "warm"} <= found and len(found) <= 50


def test_number_of_odd_rows():
    assert len(TEXTS) == 17
