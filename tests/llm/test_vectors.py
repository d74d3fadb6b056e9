import numpy as np
import pytest

import pandas as pd

from cartulary.llm.vectors import _search_cell, near_vectors, prune, search


def clustered(n=1500, d=24, seed=7):
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(n, d))
    for k in range(0, n - 40, 40):
        size = int(draw.integers(2, 30))
        v[k + 1 : k + size] = v[k] + draw.normal(scale=0.12, size=(size - 1, d))
    return v.astype(np.float32), draw.integers(0, 3, n)


def slow(v, label, least=0.93):
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(len(v))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(v)).min(axis=1))
        if (new == root).all():
            return near.sum(axis=1), root
        root = new


@pytest.mark.parametrize("cell", [64, 512])
def test_recall_and_precision_against_brute_force(spark, cell):
    v, label = clustered()
    label[np.arange(len(v)) % 40 < 30] = (np.arange(len(v)) // 40 % 3)[np.arange(len(v)) % 40 < 30]
    rows = [(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label))]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cell=cell)
    got = {r["vec_id"]: r for r in found.collect()}
    links, root = slow(v, label)
    mine = np.array([got[i]["n_links"] for i in range(len(v))])
    assert len(got) == len(v) and (mine <= links).all() and links.sum() > 1000
    assert mine.sum() >= 0.97 * links.sum()
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(v))]) > 0.97


def groups(sizes, others, d=64, seed=5):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(len(sizes), d))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    near = [c + draw.normal(scale=0.22 / d**0.5, size=(n, d)) for c, n in zip(centre, sizes)]
    return np.concatenate([*near, draw.normal(size=(others, d))])


@pytest.mark.parametrize("sizes, others", [((150, 150, 150), 0), ((120, 120, 120, 120), 30)])
def test_several_large_groups_in_one_cell(spark, sizes, others):
    v = groups(sizes, others)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    links, root = slow(v, np.ones(len(v)))
    got = {r["vec_id"]: r for r in found}
    assert len(set(root[: sum(sizes)])) == len(sizes) and links.sum() > 0.9 * sum(n * (n - 1) for n in sizes)
    assert sum(got[i]["n_links"] for i in got) >= 0.98 * links.sum()
    assert [got[i]["component_id"] for i in range(len(v))] == root.tolist()


def test_a_cell_that_its_graph_does_not_open_up_is_searched_exactly():
    v = groups((60,) * 5, 100)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ring = np.random.default_rng(1).permutation(len(v))
    after = dict(zip(ring.tolist(), np.roll(ring, -1).tolist()))
    graph = pd.DataFrame({"key": range(len(v)), "v": list(v), "m": 1, "home": True, "near": [[after[i]] for i in range(len(v))], "cells": [[]] * len(v)})
    made = list(_search_cell(graph, graph[["key", "v"]], 0.93, 16))
    assert {k: n for kind, k, n, _ in made if kind == "links"} == {i: n for i, n in enumerate(slow(v, np.ones(len(v)))[0].tolist()) if n}


def test_masses_of_copies_and_of_one_direction(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(3000)]
    rows += [(3000 + i, [0.3 * (1 + i / 7), 0.0, 0.0], 1) for i in range(700)]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell=100).collect()
    links = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
    assert all(links[i] == (2999, 0) for i in range(3000))
    assert sum(links[3000 + i][0] for i in range(700)) >= 0.97 * 700 * 699
    assert sum(links[3000 + i][1] == 3000 for i in range(700)) >= 690


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, [1.0, 0.0], 1), (2, [1e200, 0.0], 1), (3, [1e-200, 1e-220], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None),
        (6, None, 1), (7, [0.0, 0.0], 1), (8, [1.0, nan], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (11, [], 1),
        (None, [1.0, 0.01], 1), (12, [-1.0, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [1.0], 3), (14, [1.0, 0.0], 3), (0, [1.0, 0.0], 4),
    ]
    schema = "vec_id long, embedding array<double>, label int, key string, cell int, home string, v int, m string, near int"
    docs = spark.createDataFrame([(*r, "x", 1, "x", 1, "x", 1) for r in vectors], schema)
    found = {(r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(docs).collect()}
    assert found == {
        (1, 3, 1), (2, 3, 1), (3, 3, 1), (None, 3, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9),
        (10, 0, 10), (11, 0, 11), (12, 1, 12), (13, 1, 13), (14, 1, 13), (0, 0, 0),
    }
    assert near_vectors(docs.limit(0)).count() == 0


def test_pruned_graph_and_search():
    v, _ = clustered(300)
    v = v.astype(float) / np.linalg.norm(v, axis=1, keepdims=True)
    around = [set() for _ in v]
    for i, near in enumerate(prune(v)):
        assert i not in near and len(near) <= 16
        for j in near.tolist():
            around[i].add(j)
            around[j].add(i)
    links = [np.array(sorted(a)) for a in around]
    hit = total = 0
    for i in range(0, 300, 7):
        true = set(np.flatnonzero(v @ v[i] >= 0.93).tolist())
        got = set(search(v[i], v, links, 0, 0.93, 16).tolist())
        assert got <= true
        hit, total = hit + len(got), total + len(true)
    assert hit >= 0.97 * total
