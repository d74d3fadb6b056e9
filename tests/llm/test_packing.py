from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from cartulary.llm.packing import best_fit, pack, pack_documents

from .odd import odd


def slow_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fit = [
            (capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins)
            if capacity - sum(x[0] for x in b) >= size
            and not any((s is not None and x[1] == s) or (c is not None and x[2] == c) for x in b)
            and (sum(x[0] for x in b) < capacity)
        ]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append([])
        bins[k].append((size, s, c))
        out.append(k)
    return out


item = st.tuples(st.integers(0, 12), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 1, 2, 3, 4]))


@settings(max_examples=150, deadline=None)
@given(st.lists(item, max_size=25))
def test_best_fit_agrees_with_trying_every_bin(items):
    columns = [list(x) for x in zip(*items)] or [[], [], []]
    bins, offsets = best_fit(*columns, 12)
    assert bins.tolist() == slow_best_fit(*columns, 12)
    for b in set(bins.tolist()):
        at = [k for k in range(len(items)) if bins[k] == b]
        assert [offsets[k] for k in at] == [sum(columns[0][j] for j in at if j < k) for k in at]


def check(rows, items, capacity):
    """Everything is packed once, and no bin holds too much or two of a kind."""
    total = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        total[r["id"]] += r["size"]
        bins[r["bin_id"]].append(r)
    assert total == items
    for held in bins.values():
        held.sort(key=lambda r: (r["bin_offset"], r["size"]))
        assert all(a["bin_offset"] + a["size"] == b["bin_offset"] for a, b in zip(held, held[1:]))
        assert held[-1]["bin_offset"] + held[-1]["size"] <= capacity


def test_pack_keeps_everything_and_every_rule(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 5}", None if i % 3 else i % 11, (i * 37) % 250) for i in range(900)]
    found = pack(spark.createDataFrame(rows, "id long, source string, cluster long, size long"), 100, shard=200).collect()
    check(found, {i: n for i, _, _, n in rows}, 100)
    of = {r[0]: r for r in rows}
    for kind in (1, 2):
        seen = Counter((r["bin_id"], of[r["id"]][kind]) for r in found if of[r["id"]][kind] is not None)
        assert max(seen.values()) == 1


def test_repeated_rows_are_packed_each(spark):
    rows = [(1, "a", 1, 60)] * 50 + [(None, None, None, None), (2, None, None, 250)]
    found = pack(spark.createDataFrame(rows, "id long, source string, cluster long, size long"), 100).collect()
    assert len({(r["bin_id"]) for r in found if r["id"] == 1}) == 50
    assert sorted(r["size"] for r in found if r["id"] == 2) == [50, 100, 100]
    assert [r["size"] for r in found if r["id"] is None] == [0]


def test_odd_rows(spark):
    found = pack_documents(odd(spark))
    assert found.columns[0] == "doc_id" and found.selectExpr("sum(size)").first()[0] == 120_000 + 9 + 3 + 6 + 3 + 2 + 4 + 3
    assert found.where(f"doc_id = {(1 << 53) + 1}").count() == 1
    assert pack_documents(odd(spark, [])).count() == 0
