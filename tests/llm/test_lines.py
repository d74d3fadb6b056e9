from collections import Counter

import pyspark.sql.functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from cartulary.llm.lines import drop_copied_lines, runs

from .odd import odd


def slow(rows, least):
    """Lines to delete of each (id, text): those in a run of ``least`` words or more that begins earlier too."""
    earliest, where = {}, []
    for key in sorted(set(rows)):
        lines = [(k, s.strip(), len(s.split())) for k, s in enumerate(key[1].split("\n")) if s.strip()]
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += lines[b][2]
                if words >= least:
                    run = tuple(s for _, s, _ in lines[a : b + 1])
                    earliest.setdefault(run, (key, a))
                    where.append((run, key, a, [k for k, *_ in lines[a : b + 1]]))
    gone = {key: set() for key in rows}
    for run, key, a, at in where:
        if earliest[run] != (key, a):
            gone[key].update(at)
    return gone


line = st.sampled_from(["a", "b b", "c c c", "d", "", " a ", "e e e e e"])


@settings(max_examples=200, deadline=None)
@given(st.lists(line, max_size=14), st.integers(1, 7))
def test_least_runs_cover_every_longer_run(lines, least):
    """Every line of a text with enough words in it stands in one of its least runs, and none is longer than need be."""
    found = list(runs("\n".join(lines), least))
    words = [len(s.split()) for s in lines]
    covered = {k for *_, first, last in found for k in range(first, last + 1) if words[k]}
    assert covered == ({k for k, n in enumerate(words) if n} if sum(words) >= least else set())
    for mark, _, at, first, last in found:
        assert first <= at <= last and sum(words[first : last + 1]) >= least


def test_agrees_with_comparing_all_runs(spark):
    base = [f"line {i} " + "w " * (i % 9) for i in range(60)]
    rows = [
        (1, "\n".join(base[:20])), (2, "\n".join(base[5:12])), (3, "own\n" + "\n".join(base[10:30]) + "\n\nlast"),
        (4, "\n".join(base[25:27])), (5, "\n".join(base[40:45] * 3)), (6, "x\ny\n" + base[8]), (7, " ".join("v" * 60)),
        (8, "before\n" + " ".join("v" * 60) + "\nafter"), (9, "\n".join(base[:3] + ["cut"] + base[3:6])), (10, base[8] + "\n" + base[8]),
    ]
    for least in (5, 12, 50):
        gone = slow(rows, least)
        found = drop_copied_lines(spark.createDataFrame(rows, "doc_id long, text string"), least=least)
        for r in found.select("doc_id", "text", "line_dedup.n_removed", F.col("line_dedup.text").alias("cleaned")).collect():
            lines = r["text"].split("\n")
            left = gone[r["doc_id"], r["text"]]
            assert r["n_removed"] == len(left) and r["cleaned"] == "\n".join(s for k, s in enumerate(lines) if k not in left)


def test_a_passage_in_very_many_documents_stays_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.range(3000).selectExpr("id as doc_id", f"concat('head ', id, '\\n{passage}\\ntail ', id) as text")
    found = drop_copied_lines(docs)
    assert Counter(r[0] for r in found.select("line_dedup.n_removed").collect()) == {1: 2999, 0: 1}
    assert found.where("line_dedup.n_removed = 0").first()["doc_id"] == 0


def test_odd_rows(spark):
    docs = odd(spark)
    found = drop_copied_lines(docs)
    rows = found.select("doc_id", "text", "line_dedup.n_removed", "line_dedup.n_lines").collect()
    assert len(rows) == docs.count() and found.columns == [*docs.columns, "line_dedup"]
    assert {(r["doc_id"], r["n_removed"]) for r in rows if len(r["text"] or "") > 1000} == {(7, 0), (8, 1)}
    assert all(r["n_removed"] == 0 for r in rows if len(r["text"] or "") < 1000)
    assert drop_copied_lines(odd(spark, [])).count() == 0
