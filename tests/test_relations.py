"""Edges judged in turn against a plain loop."""

import random

import pytest

from cartulary.operators import relations as R

EDGE = "seq long, parent string, parent_uuid string, child string, child_uuid string, relation_type string"


def plain(stored, proposed, limits):
    taken, told = list(stored), []
    for row in sorted(proposed):
        seq, p, pu, c, cu, t = row
        known = [(e[1], e[2]) for e in taken] + [(e[3], e[4]) for e in taken]
        limit = limits.get((p, t), R.DEFAULT_LIMIT)
        if any(e[3] == c for e in taken):
            why = R.HAS_PARENT
        elif any(e[3] == p for e in taken):
            why = R.IS_CHILD
        elif any(e[1] == c for e in taken):
            why = R.HAS_CHILDREN
        elif any(n == p and u != pu for n, u in known):
            why = R.PARENT_UUID
        elif any(n == c and u != cu for n, u in known):
            why = R.CHILD_UUID
        elif limit >= 0 and sum(e[1] == p and e[5] == t for e in taken) >= limit:
            why = R.TOO_MANY
        else:
            why = None
            taken.append(row)
        told.append((*row, why))
    return sorted(told, key=str)


def judged(spark, stored, proposed, limits):
    edges = spark.createDataFrame(stored, EDGE).drop("seq")
    rows = spark.createDataFrame(proposed, EDGE)
    most = spark.createDataFrame([(*k, v) for k, v in limits.items()], "parent string, relation_type string, max_children int")
    return sorted((tuple(r) for r in R.validate_in_turn(edges, rows, most).collect()), key=str)


@pytest.mark.parametrize("seed", range(5))
def test_in_turn_equals_a_plain_loop(spark, seed):
    draw = random.Random(seed)
    names = [f"n{i}" for i in range(draw.choice([6, 12, 40]))]

    def edge(seq, loose):
        p, c = draw.choice(names[: len(names) // 2 + 1]), draw.choice(names)
        return seq, p, f"u{p}" if draw.random() < 0.9 else "other", c, f"u{c}", draw.choice("xy")

    stored, used = [], set()
    for e in (edge(0, False) for _ in range(4)):
        if e[3] not in used and e[1] not in {s[3] for s in stored} and e[3] not in {s[1] for s in stored}:
            stored.append((0, e[1], f"u{e[1]}", e[3], e[4], e[5]))
            used.add(e[3])
    proposed = [edge(draw.randint(1, 60), True) for _ in range(80)]
    proposed += draw.sample(proposed, 5)  # repeated rows
    limits = {(n, t): draw.choice([-1, 0, 1, 2, 5]) for n in names for t in "xy" if draw.random() < 0.7}
    assert judged(spark, stored, proposed, limits) == plain(stored, proposed, limits)


def test_chains_and_many_children_of_one_parent(spark):
    # each edge of the chain waits for the one before it
    chain = [(k, f"a{k}", f"u{k}", f"a{k + 1}", f"u{k + 1}", "x") for k in range(9)]
    wide = [(100 + k, "hot", "u", f"c{k}", f"v{k}", "x") for k in range(300)]
    late = [(500, "hot", "u", "c1", "v1", "y"), (501, "free", "u", "c2", "v2", "x"), (502, "free", "u", "c9", "v9", "x")]
    rows, limits = chain + wide + late, {("hot", "x"): 7, ("free", "x"): -1}
    found = judged(spark, [], rows, limits)
    assert found == plain([], rows, limits)
    assert sum(r[-1] is None for r in found if r[1] == "hot" and r[5] == "x") == 7


def test_nothing_proposed(spark):
    assert judged(spark, [], [], {}) == []
