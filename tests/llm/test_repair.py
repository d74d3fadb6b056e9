import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from cartulary.llm import queries, repair

WORDLESS, WHOLE = re.compile(r"[\x20\x09-\x0D]*\Z"), re.compile(r"(s?(ua)+)?\Z")


def plain(turns, entry="", target=repair.END):
    """The best repair by a full recursion from the end: cost, audit."""

    @lru_cache(maxsize=None)
    def best(k, state, streak):
        found = []
        if k == len(turns) and (state == target or (target == repair.END and state in ("", "a"))):
            found.append((0, ""))
        def on(more, letter, *node):
            rest = best(*node)
            if rest:
                found.append((rest[0] + more, letter + rest[1]))
        if streak < 2 and (k < len(turns) or target == repair.END):
            on(2, "I", k, "a" if state == "u" else "u", streak + 1)
        if k < len(turns):
            role, fault = turns[k]
            on(3, "D", k + 1, state, 0)
            if fault not in ("blank", "duplicate"):
                extra = 1 if fault else 0
                if (state, role) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    on(extra, "K", k + 1, role, 0)
                on(2 + extra, "R", k + 1, "a" if state == "u" else "u", 0)
        return min(found, default=None)

    for k in range(len(turns), 0, -50):  # from the end, so that the recursion stays shallow
        for state in ("", "s", "u", "a"):
            best(k, state, 0)
    return best(0, entry, 0)


def enumerated(turns):
    """The best repair out of all audits, tried one by one."""
    n, found = len(turns), []
    for inserts in range(3):
        for audit in {"".join(a) for a in itertools.product("KRDI", repeat=n + inserts) if a.count("I") == inserts}:
            for made in itertools.product("ua", repeat=inserts + audit.count("R")):
                left, new, roles, cost = iter(turns), iter(made), "", 0
                for edit in audit:
                    if edit == "I":
                        roles, cost = roles + next(new), cost + 2
                        continue
                    role, fault = next(left)
                    cost += {"K": 0, "R": 2, "D": 3}[edit] + (bool(fault) if edit != "D" else 0)
                    if edit != "D":
                        roles += next(new) if edit == "R" else role or "?"
                        cost += 1000 if fault in ("blank", "duplicate") else 0
                if WHOLE.match(roles):
                    found.append((cost, audit))
    return min(found)


def drawn(seed, longest):
    draw = random.Random(seed)
    weights = [(8, 1, 1, 2), (1, 1, 1, 1), (20, 0, 0, 1)][seed % 3]
    return [(draw.choice(["s", "u", "a", "u", "a", "x", ""]), draw.choices(["", "blank", "duplicate", "truncated"], weights)[0]) for _ in range(draw.randint(0, longest))]


@pytest.mark.parametrize("seed", range(60))
def test_search_finds_the_best_of_all_audits(seed):
    turns = drawn(seed, 4)
    assert repair.search(turns, "", repair.END) == enumerated(turns)


@pytest.mark.parametrize("seed", range(200))
def test_search_agrees_with_a_full_recursion(seed):
    turns = drawn(seed, 14)
    for entry in repair.STATES:
        for target in (*repair.STATES, repair.END):
            assert repair.search(turns, entry, target) == plain(turns, entry, target), (turns, entry, target)


def brute(rows):
    """The whole contract for one conversation's undamaged rows (conv, turn, role, text)."""
    text_of = lambda c: " " if c is None else c
    turns = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        turns += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    seen, faults = set(), []
    for _, role, text in turns:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in turns]
    numbers = [t for t, _, _ in turns if t is not None]
    cost, audit = plain(tuple(zip(initials, faults)))
    lines = [f"{r}:{t}" for r, t in repair.edited([(r, t) for _, r, t in turns], "", audit)]
    assert WHOLE.match("".join(line[0] for line in lines))
    return (
        max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def agree(found, rows):
    parts = {}
    for r in rows:
        parts.setdefault(r[0], []).append(r)
    assert len(found) == len(parts)
    for r in found:
        assert tuple(r)[1:9] == brute(parts[r[0]]), r[0]


def test_query(spark, small):
    rows = [tuple(r) for r in queries.table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    agree(queries.op11_conversation_repair(spark, small).collect(), rows)


SCHEMA = "conv_id long, turn int, role string, text string, part int, at string, run string, fault int, code string, cost string"


def odd(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", 1, "x", "x") for r in rows], SCHEMA)


ODD = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Yes?"), (1, 5, "user", None), (2, None, None, "Who?"),
    (2, None, None, None), (2, 3, "", "no role."), (3, None, "user", None), (None, 1, "user", "no id"), (None, 2, "assistant", "x" * 100_000),
    (4, -3, "System", "odd."), (4, 1, "system", "late!"), (4, 2, "assistant", "\u0085"), (5, 1, "user", "end. "), (5, 2, "assistant", " \t\n\x0b\f\r"),
]


@pytest.mark.parametrize("run", [1, 2, 3, 256])
def test_odd_conversations(spark, run):
    draw = random.Random(run)
    long = [(50, k // 2, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["Yes.", "No", "", "Well?"]) + str(k % 7) * (k % 3)) for k in range(300)]
    same = [(60, 1, "user", "Again.")] * 200 + [(60, 2, "assistant", "Fine.")] * 100
    gone = [(70 + k, k, "user", "Hm.") for k in range(60)]
    rows = ODD + long + same + gone
    found = repair.repair_conversations(repair.damaged(odd(spark, rows).repartition(5)), present="present", texts=True, run=run).collect()
    agree(found, rows)
    for r in found:
        assert hashlib.sha256(r["repaired"].encode()).hexdigest() == r["repaired_sha256"]


def test_no_rows(spark):
    assert repair.repair_conversations(repair.damaged(odd(spark, [])), present="present").count() == 0
