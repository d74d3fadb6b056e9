"""Conversation structure repair: cheapest edits by depth-first branch-and-bound, run by run of a conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructField, StructType

from .common import store

#: Turns that are searched at a time.  A longer conversation is cut into runs of so many.
RUN = 256
#: What an edit costs, and a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Where a sequence of roles stands: nothing yet, or the initial of its last role.
STATES = ("", "s", "u", "a")
#: Fixed value: which role may follow which.
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
#: The target of a conversation's last run: a whole sequence of roles, after further insertions if need be.
END = "end"
#: Where a sequence of roles may end.
WHOLE = ("", "a")
NO_WORD = r"\A[\x20\x09-\x0D]*\z"
CUT_OFF = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"

#: A turn as the search sees it: the initial of its role and its fault.
Turn = tuple[str, str]
Audit = tuple[int, str]


def bounds(turns: list[Turn]) -> list[tuple[int, int]]:
    """What the turns from each one on cost at least: where a user may be next, and where an assistant must be.

    A relaxed problem with two states instead of four: system turns may stand wherever users may, and the sequence
    may end anywhere.
    """
    least = [(0, 0)] * (len(turns) + 1)
    for k in range(len(turns) - 1, -1, -1):
        role, fault = turns[k]
        user, reply = least[k + 1]
        here = [user + DELETE, reply + DELETE]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault else 0
            here[0] = min(here[0], reply + more + (0 if role == "u" else REROLE), user + more if role == "s" else here[0])
            here[1] = min(here[1], user + more + (0 if role == "a" else REROLE))
        least[k] = min(here[0], here[1] + INSERT), min(here[1], here[0] + INSERT)
    return least


def search(turns: list[Turn], entry: str, target: str) -> Audit | None:
    """Cost and initials of the cheapest edits that lead from ``entry`` over all turns to ``target``.

    Of equally cheap edits the least in ASCII wins; None if no edits lead there.  A node is a number of turns done
    and a state.  The stack holds prefixes ``(cost, audit)`` at their nodes; one is given up if its cost and the
    least that the turns left must cost exceed the incumbent, or match it with an audit that is worse so far, or
    if its node was reached before by a prefix no worse (the dominance table).  Two prefixes of equal cost at one node
    never begin one another, so the better of them stays better however they go on.  When the stack is empty the
    incumbent is proved the best.
    """
    n, least = len(turns), bounds(turns)
    best: Audit | None = None
    held: dict[tuple[int, str], Audit] = {}
    stack: list[tuple[int, str, int, str]] = [(0, entry, 0, "")]
    while stack:
        k, state, cost, audit = stack.pop()
        bound = cost + least[k][state == "u"]
        if best and (bound > best[0] or (bound == best[0] and audit > best[1][: len(audit)])):
            continue
        before = held.get((k, state))
        if before and before <= (cost, audit):
            continue
        held[k, state] = cost, audit
        if k == n and (state == target or (target == END and state in WHOLE)):
            if best is None or (cost, audit) < best:
                best = cost, audit
        nexts = []
        for role in FOLLOWS[state]:
            if role != "s" and (k < n or target == END):  # a run leaves insertions after its last turn to the next one
                nexts.append((k, role, cost + INSERT, audit + "I"))
        if k < n:
            role, fault = turns[k]
            nexts.append((k + 1, state, cost + DELETE, audit + "D"))
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault else 0
                if role and role in FOLLOWS[state]:
                    nexts.append((k + 1, role, cost + more, audit + "K"))
                for new in FOLLOWS[state]:
                    if new != "s":
                        nexts.append((k + 1, new, cost + REROLE + more, audit + "R"))
        if target in ("", "s"):  # no way leads back there
            nexts = [x for x in nexts if x[1] in ("", target)]
        # the most promising on top
        nexts.sort(key=lambda x: (x[2] + least[x[0]][x[1] == "u"], x[3]), reverse=True)
        stack += nexts
    return best


def edited(turns: list[tuple[str, str]], entry: str, audit: str) -> Iterator[tuple[str, str]]:
    """Roles and texts that the edits make of turns ``(role, text)``."""
    state, left = entry, iter(turns)
    for edit in audit:
        if edit == "D":
            next(left)
            continue
        if edit == "I":
            role, text = NAMES[FOLLOWS[state][-1]], ""
        else:
            role, text = next(left)
            role = NAMES[FOLLOWS[state][-1]] if edit == "R" else role
        state = role[0]
        yield role, text


def judged(convs: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """``conv, turn, role, text, there, fault, code, salt``: turns with the faults that a turn alone shows."""
    said, who = F.coalesce(F.col(text).cast("string"), F.lit(" ")), F.coalesce(F.col(role).cast("string"), F.lit(" "))
    fault = F.when(F.col("text").rlike(NO_WORD), "blank").when(F.col("text").rlike(CUT_OFF), "truncated").otherwise("")
    there = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    rows = convs.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), who.alias("role"), said.alias("text"), there.alias("there"))
    code = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # rows alike in all that orders them may lie anywhere among themselves
    return rows.withColumns({"fault": fault, "code": F.substring(code, 1, 16), "salt": F.monotonically_increasing_id()})


def summary(turns: list[dict], faults: list[str]) -> dict:
    """What a run adds to its conversation's counts; runs are put together by :func:`joined`."""
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    initials = [t["role"][:1] for t in turns]
    return {
        "rows": len(turns),
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "head": initials[0] if turns else None,
        "tail": initials[-1] if turns else None,
        "low": min(numbers, default=None),
        "high": max(numbers, default=None),
        "turns": len(set(numbers)),
    }


#: The columns of a summary.
COUNTS = "rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long"
COUNTED = [c.split()[0] for c in COUNTS.split(", ")]


def joined(a: dict, b: dict) -> dict:
    """The summary of two runs, one after the other, in order of their turns."""
    if not a["rows"] or not b["rows"]:
        return b if b["rows"] else a
    both = {c: a[c] + b[c] for c in ("rows", "blank", "duplicate", "truncated", "illegal", "turns")}
    both["illegal"] += a["tail"] + b["head"] not in ("su", "ua", "au")
    both["turns"] -= a["high"] is not None and a["high"] == b["low"]
    lows, highs = ([x for x in (a[c], b[c]) if x is not None] for c in ("low", "high"))
    return both | {"head": a["head"], "tail": b["tail"], "low": min(lows, default=None), "high": max(highs, default=None)}


def gaps(s: dict) -> int:
    return 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]


def result(s: dict, cost: int, audit: str, code: str) -> dict:
    return {"gaps": gaps(s), **{c: s[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "code": code}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, code string"


class Scribe:
    """The text of a repaired conversation as it is written: hashed at once, and kept if asked for."""

    def __init__(self, keep: bool):
        self.hash, self.begun, self.kept = hashlib.sha256(), False, [] if keep else None

    def write(self, turns: Iterator[tuple[str, str]]) -> None:
        for role, text in turns:
            line = f"\n{role}:{text}" if self.begun else f"{role}:{text}"
            self.begun = True
            self.hash.update(line.encode("utf-8", "surrogatepass"))
            if self.kept is not None:
                self.kept.append(line)

    def done(self) -> tuple[str, str | None]:
        return self.hash.hexdigest(), None if self.kept is None else "".join(self.kept)


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each missing column null."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            yield from batch.slice(start, 2000).to_pylist()


def repair_conversations(
    convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: str | None = None, texts: bool = False, run: int = RUN,
) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256[, repaired]``: a row per conversation.

    A conversation's turns are taken by number, null first, equal numbers by role and text in code point order.  The
    first fault of a turn counts: blank (no word), duplicate (role and text seen before), truncated (its last
    character that is no white space is none of ``.!?``).  ``gaps`` is the number of turn numbers left out between
    lowest and highest, ``illegal`` that of neighbours whose roles' initials are none of su, ua, au.

    ``audit`` has the initials of the cheapest edits, in order, after which the initials of all roles match
    ``(s?(ua)+)?``: Keep (free), Rerole to user or assistant, Delete (the only edit of blank and duplicate turns),
    Insert an empty user or assistant turn; a truncated turn that is not deleted adds 1.  Of equally cheap edits the
    first in ASCII order count.  ``repaired_sha256`` is the hash of the repaired turns ``role:text``, one a line;
    ``texts=True`` adds that text as ``repaired``.

    Null roles and texts count as one space, null turns have no number.  An empty role has no initial: it is
    reroled or deleted.  A null conversation id is a conversation.  Rows where ``present`` is not true only name
    their conversation; one without other rows has zeros, an empty audit and the hash of an empty text.  Repeated
    rows are duplicates of the first.  Other columns are ignored whatever their names, an empty table gives an
    empty result.

    Turns are dealt out by ranges of (conversation, turn, role, text), so that a conversation of any size is spread
    over tasks, equal rows too.  A conversation that a task sees whole and that has at most ``run`` turns is done
    there.  The others (the first and last ones of a task, and long ones) go on run by run: duplicates are found by
    an aggregate over (conversation, hash), every run is searched from each state to each state, the runs' costs are
    put together in order, and the runs' edits are written out.  Only that last step has all of a conversation in
    one task, one run in memory: its hash is one sequence.
    """
    kind = convs.schema[conv].dataType
    rows = judged(convs, conv, turn, role, text, present)
    order = ["conv", "turn", "role", "text", "salt"]
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in order]
    )
    id = StructField("conv", kind)
    done = [id, *StructType.fromDDL(f"{RESULT}, repaired string").fields]
    left = StructType.fromDDL("part long, at long, run long, there boolean, turn long, role string, text string, fault string, code16 binary")
    first = StructType([*done, *left.fields])

    def whole(name, held: list[dict]) -> dict:
        seen, faults = set(), []
        turns = [t for t in held if t["there"]]
        for t in turns:
            faults.append(t["fault"] if t["fault"] == "blank" or t["code"] not in seen else "duplicate")
            seen.add(t["code"])
        cost, audit = search([(t["role"][:1], f) for t, f in zip(turns, faults)], "", END)
        scribe = Scribe(texts)
        scribe.write(edited([(t["role"], t["text"]) for t in turns], "", audit))
        code, made = scribe.done()
        return {"conv": name, **result(summary(turns, faults), cost, audit, code), "repaired": made}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def each(rows: Iterator[dict]) -> Iterator[dict]:
            held: list[dict] = []
            name, opened, edge, at, runs = None, False, True, 0, 0

            long = False

            def leave() -> Iterator[dict]:
                nonlocal at, runs, held
                seen: set[bytes] = set()
                for t in held:
                    # within a run the first of equal turns stands for all: only it is compared with other runs
                    again = t["there"] and t["code"] in seen
                    fault = "duplicate" if again and t["fault"] != "blank" else t["fault"]
                    if t["there"]:
                        seen.add(t["code"])
                    yield {
                        "conv": t["conv"], "part": part, "at": at, "run": runs, "there": t["there"], "turn": t["turn"],
                        "role": t["role"], "text": t["text"], "fault": fault, "code16": t["code"],
                    }
                    at += 1
                runs += 1
                held = []

            for t in rows:
                if not opened or t["conv"] != name:
                    if opened:
                        if edge or long:
                            yield from leave()
                        else:
                            yield whole(name, held)
                            held = []
                        edge = False
                    name, opened, long = t["conv"], True, False
                held.append(t)
                if len(held) > run:
                    last = held.pop()
                    yield from leave()
                    held, long = [last], True
            if held:
                yield from leave()

        yield from shaped(batches, each, ARROW_FIRST)

    found = store(ranged.mapInArrow(fold, first), "conversations")
    ready = found.where("part is null").select("conv", *[f.name for f in done[1:]])
    rest = found.where("part is not null").select("conv", *[f.name for f in left.fields])
    return ready.unionByName(_long(rest, kind, done, texts)).select(
        F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("code").alias("repaired_sha256"), *(["repaired"] if texts else []),
    )


ARROW_RESULT = [
    *[pa.field(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    *[pa.field(c, pa.string()) for c in ("audit", "code", "repaired")],
]
ARROW_FIRST = [
    *ARROW_RESULT, pa.field("part", pa.int64()), pa.field("at", pa.int64()), pa.field("run", pa.int64()),
    pa.field("there", pa.bool_()), pa.field("turn", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string()),
    pa.field("fault", pa.string()), pa.field("code16", pa.binary()),
]


def _long(rows: DataFrame, kind, done: list[StructField], texts: bool) -> DataFrame:
    """Conversations that come in runs ``(part, run)`` of turns ``(part, at)``, in that order."""
    id = StructField("conv", kind)
    real = F.col("there") & F.col("fault").isin("", "truncated")
    places = F.struct("part", "at")
    firsts = (
        rows.where(F.col("there")).groupBy("conv", "code16").agg(F.min(places).alias("p"))
        .select(F.col("p.part").alias("f_part"), F.col("p.at").alias("f_at"))
    )
    # every place is one row, so no key of this join is frequent
    known = rows.join(firsts, (F.col("part") == F.col("f_part")) & (F.col("at") == F.col("f_at")), "left")
    marked = store(
        known.withColumn("fault", F.when(real & F.col("f_at").isNull(), "duplicate").otherwise(F.col("fault"))).drop("f_part", "f_at", "code16"),
        "turns",
    )
    pairs = [(a, b) for a in STATES for b in (*STATES, END)]
    shape = StructType([id, *StructType.fromDDL(f"part long, run long, costs array<long>, ranks array<int>, {COUNTS}").fields])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The costs of a run from each state to each state, and the order of the audits that begin in one state."""

        def each(rows: Iterator[dict]) -> Iterator[dict]:
            for name, number, held in runs_of(rows):
                turns = [t for t in held if t["there"]]
                plain = [(t["role"][:1], t["fault"]) for t in turns]
                found = [search(plain, a, b) for a, b in pairs]
                ranks = []
                for k in range(0, len(pairs), len(STATES) + 1):
                    audits = [f[1] if f else "~" for f in found[k : k + len(STATES) + 1]]
                    ranks += [sorted(audits).index(a) for a in audits]
                yield {
                    "conv": name, "part": number[0], "run": number[1], "costs": [f[0] if f else None for f in found], "ranks": ranks,
                    **summary(turns, [t["fault"] for t in turns]),
                }

        yield from shaped(batches, each, [
            pa.field("part", pa.int64()), pa.field("run", pa.int64()), pa.field("costs", pa.list_(pa.int64())),
            pa.field("ranks", pa.list_(pa.int32())), *ARROW_COUNTS,
        ])

    light = marked.drop("text").repartition("part", "run").sortWithinPartitions("part", "run", "at")
    table = light.mapInArrow(tables, shape)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each run's entry and target, and at the last run the conversation's counts and cost.

        A few bytes of every run are held until the conversation's end is known.
        """

        def each(rows: Iterator[dict]) -> Iterator[dict]:
            held: list[tuple] = []
            for t, last in with_last(rows):
                if not held:
                    paths, total = {"": (0, 0)}, summary([], [])
                previous, total = paths, joined(total, t)
                reached: dict[str, tuple] = {}
                for k, (a, b) in enumerate(pairs):
                    if t["costs"][k] is not None and a in paths:
                        option = (paths[a][0] + t["costs"][k], paths[a][1], t["ranks"][k], a)
                        reached[b] = min(reached.get(b, option), option)
                held.append((t["part"], t["run"], {b: o[3] for b, o in reached.items()}))
                if not last:
                    places = sorted({o[1:3] for b, o in reached.items() if b != END})
                    paths = {b: (o[0], places.index(o[1:3])) for b, o in reached.items() if b != END}
                    continue
                cost, state, back = reached[END][0], END, []
                for part, number, came in reversed(held):
                    back.append({"part": part, "run": number, "entry": came[state], "target": state})
                    state = came[state]
                back[0] |= {"cost": cost, **{c: total[c] for c in COUNTED}}
                yield from ({"conv": t["conv"], **b} for b in reversed(back))
                held = []

        yield from shaped(batches, each, [
            pa.field("part", pa.int64()), pa.field("run", pa.int64()), pa.field("entry", pa.string()), pa.field("target", pa.string()),
            pa.field("cost", pa.int64()), *ARROW_COUNTS,
        ])

    routed = table.repartition("conv").sortWithinPartitions("conv", "part", "run").mapInArrow(
        route, StructType([id, *StructType.fromDDL(f"part long, run long, entry string, target string, cost long, {COUNTS}").fields])
    )
    routes = store(routed, "routes").drop("conv")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(rows: Iterator[dict]) -> Iterator[dict]:
            scribe, audits = Scribe(texts), []
            for name, _, held in runs_of(rows):
                turns = [t for t in held if t["there"]]
                entry, target = held[0]["entry"], held[0]["target"]
                _, audit = search([(t["role"][:1], t["fault"]) for t in turns], entry, target)
                scribe.write(edited([(t["role"], t["text"]) for t in turns], entry, audit))
                audits.append(audit)
                if target == END:
                    code, made = scribe.done()
                    counts = {c: held[0][c] for c in COUNTED}
                    yield {"conv": name, **result(counts, held[0]["cost"], "".join(audits), code), "repaired": made}
                    scribe, audits = Scribe(texts), []

        yield from shaped(batches, each, ARROW_RESULT)

    # the hash is one sequence: a conversation's turns pass one task in order, one run in memory
    written = marked.join(routes, ["part", "run"]).repartition("conv").sortWithinPartitions("conv", "part", "at")
    return written.mapInArrow(write, StructType(done))


ARROW_COUNTS = [pa.field(c, pa.string() if c in ("head", "tail") else pa.int64()) for c in COUNTED]


def shaped(batches: Iterator[pa.RecordBatch], each, fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """``each`` over all rows of a task; its rows have ``conv``, as it came in, and ``fields``."""
    first = next(batches, None)
    if first is not None:
        schema = pa.schema([pa.field("conv", first.schema.field("conv").type), *fields])
        yield from batches_of(each(rows_of(_chained(first, batches))), schema)


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def runs_of(rows: Iterator[dict]) -> Iterator[tuple[object, tuple[int, int], list[dict]]]:
    """Consecutive turns of one run."""
    held: list[dict] = []
    for t in rows:
        if held and (t["part"], t["run"]) != (held[0]["part"], held[0]["run"]):
            yield held[0]["conv"], (held[0]["part"], held[0]["run"]), held
            held = []
        held.append(t)
    if held:
        yield held[0]["conv"], (held[0]["part"], held[0]["run"]), held


def with_last(rows: Iterator[dict]) -> Iterator[tuple[dict, bool]]:
    """Rows, and whether each is the last of its conversation."""
    before = None
    for t in rows:
        if before is not None:
            yield before, before["conv"] != t["conv"]
        before = t
    if before is not None:
        yield before, True


def damaged(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, present``: turns damaged by the CRC-32 of ``conv:turn`` modulo 20 (null: one space).

    0 drops the turn (``present`` is false), 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it
    the user's.  Null roles and texts become one space.
    """
    told = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])
    kind = F.crc32(told.cast("binary")) % 20
    said, who = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (text, role))
    marked = convs.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), who.alias("role"), said.alias("text"), kind.alias("kind"))
    k = F.col("kind")
    return marked.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn),
        F.when(k == 4, "user").otherwise(F.col("role")).alias(role),
        F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias(text),
        (k != 0).alias("present"),
        F.explode(F.sequence(F.lit(1), F.when(k == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")
