"""JSON documents: merging, composing, attaching and searching."""

import json
import random

import pyspark.sql.functions as F
import pytest

from cartulary.functions import documents as J
from cartulary.operators import metadata as M

def merged(base, patch):
    """The model: objects merge member by member, everything else replaces."""
    if not (isinstance(base, dict) and isinstance(patch, dict)):
        return patch
    return base | {k: merged(base[k], v) if k in base else v for k, v in patch.items()}


def drawn(draw, depth=3):
    """A random member: a scalar, an array, or an object of up to ``depth`` levels."""
    kind = draw.random()
    if depth and kind < 0.5:
        return {draw.choice(["a", "b", "c", 'q"u\\o', "é x"]): drawn(draw, depth - 1) for _ in range(draw.randint(0, 3))}
    return draw.choice([None, 0, 1, -7, 2.5, 1e30, True, "", "text", 'q"\\/\n', "ü", [], [1, {"a": 2}], 12345678901234567890])


def test_documents_merged_by_path_equal_documents_in_turn(spark):
    draw, base, patches, want = random.Random(11), [], [], {}
    for k in range(200):
        name = f"n{k}"
        if draw.random() < 0.8:
            want[name] = drawn(draw) if draw.random() < 0.2 else {"a": drawn(draw), "b": drawn(draw)}
            base.append((name, json.dumps(want[name])))
        for seq in sorted(draw.sample(range(-5, 50), draw.randint(0, 6))):
            patch = drawn(draw, 4) if draw.random() < 0.1 else {c: drawn(draw) for c in draw.sample("abc", draw.randint(0, 3))}
            want[name] = merged(want[name], patch) if name in want else patch
            patches.append((name, seq, json.dumps(patch)))
    b = spark.createDataFrame(base, "name string, data string")
    p = spark.createDataFrame(patches, "name string, seq long, patch string").repartition(7)
    found = {r.name: json.loads(r.data) for r in M.merge_metadata(b, p).collect()}
    assert found == want
    touched = {n for n, _, _ in patches}
    same = {r.name: r.data for r in M.merge_metadata(b, p).collect() if r.name not in touched}
    assert same == {n: d for n, d in base if n not in touched}


@pytest.mark.parametrize("base,patch,result", [
    ({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}}, {"a": {"b": 1, "c": 3}}), ({"a": [1, 2]}, {"a": [3]}, {"a": [3]}),
    ({"a": 1}, {"a": None}, {"a": None}), ({"a": {"b": 1}}, {"a": 5}, {"a": 5}), ({"a": 5}, {"a": {"b": 1}}, {"a": {"b": 1}}),
    ({"a": {"b": {"c": 1}}}, {"a": {}}, {"a": {"b": {"c": 1}}}), ({"a": 1}, {"a": {}}, {"a": {}}), ({}, {}, {}),
])
def test_merge_rules(spark, base, patch, result):
    b = spark.createDataFrame([("n", json.dumps(base))], "name string, data string")
    p = spark.createDataFrame([("n", 1, json.dumps(patch))], "name string, seq long, patch string")
    assert json.loads(M.merge_metadata(b, p).first().data) == result


def test_a_hot_name_folds_before_the_shuffle(spark):
    n = 4000
    rows = [("hot", i, json.dumps({"last": i, f"k{i % 7}": {"at": i}, "x": {"n": i} if i % 3 else "flat"})) for i in range(n)]
    rows += [(f"cold{i}", 0, '{"v":%d}' % i) for i in range(50)]
    patches = spark.createDataFrame(rows, "name string, seq long, patch string").repartition(16)
    want = {}
    for _, _, p in rows[:n]:
        want = merged(want, json.loads(p))
    base = spark.createDataFrame([("hot", '{"base":1}'), ("other", "{}")], "name string, data string")
    got = {r.name: json.loads(r.data) for r in M.merge_metadata(base, patches).collect()}
    assert got["hot"] == {"base": 1, **want}
    assert got["other"] == {} and got["cold7"] == {"v": 7} and len(got) == 52


def test_top_level_merge(spark):
    df = spark.createDataFrame(
        [('{"a":1,"b":[1,2],"c":"x"}', '{"b":[3],"d":null}'), (None, '{"a":1}'), ('{"a":1}', None)], "b string, p string"
    )
    got = [json.loads(r[0]) for r in df.select(J.merge_top_level(F.col("b"), F.col("p"))).collect()]
    assert got == [{"a": 1, "b": [3], "c": "x", "d": None}, {"a": 1}, {"a": 1}]


def test_fill_owner(spark):
    rows = [("n1", '{"x":1}'), ("n2", '{"owner":{"team":"t"}}'), ("n3", '{"owner":{"userId":"me","team":"t"}}'), ("n4", None)]
    df = spark.createDataFrame([(*r, "you") for r in rows], "name string, data string, owner string")
    got = {r.name: json.loads(r.data) for r in M.fill_owner(df).collect()}
    assert got == {
        "n1": {"x": 1, "owner": {"userId": "you"}},
        "n2": {"owner": {"team": "t", "userId": "you"}},
        "n3": {"owner": {"userId": "me", "team": "t"}},
        "n4": {"owner": {"userId": "you"}},
    }


def test_search_refuses_unknown_sort(spark):
    defs = spark.createDataFrame([("a/b/c", "{}")], "name string, data string")
    with pytest.raises(ValueError):
        M.search_metadata(defs, sort_by="data")


def test_hook_sees_what_is_read(spark):
    df = spark.createDataFrame([("a/b/c", "s3://x")], "name string, uri string")
    defs = spark.createDataFrame([("a/b/c", "{}")], "name string, data string")
    data = spark.createDataFrame([("s3://x", '{"n":1}')], "uri string, data string")
    out = M.attach_metadata(df, defs, data, hook=lambda d: d.withColumn("seen", F.lit(True)))
    assert out.first().seen and out.first().data_metadata == '{"n":1}'


def test_merge_keeps_null_members_and_takes_null_documents(spark):
    b = spark.createDataFrame([("a", '{"a":{"b":1}}'), ("b", None)], "name string, data string")
    p = spark.createDataFrame([(n, 1, '{"a":{"c":null}}') for n in "abc"], "name string, seq long, patch string")
    got = {r.name: json.loads(r.data) for r in M.merge_metadata(b, p).collect()}
    assert got == {"a": {"a": {"b": 1, "c": None}}, "b": {"a": {"c": None}}, "c": {"a": {"c": None}}}
