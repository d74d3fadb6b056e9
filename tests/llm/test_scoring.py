import numpy as np
import pyarrow.parquet as pq
import pyspark.sql.functions as F
import pytest

from cartulary.llm import scoring as S

from .odd import LONG, odd, texts


def test_windows_score_each_target_once():
    draw = np.random.default_rng(3)
    sizes = np.array([1, 2, 15, 16, 17, 40, 100])
    ids = draw.integers(0, 50, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    context, target = S.windows(ids, starts, sizes, 99)
    doc = np.repeat(np.arange(len(sizes)), -(-sizes // S.STEP))
    assert np.array_equal(target[target >= 0], ids)
    for row, y, d in zip(context, target, doc):
        text = [99, *ids[starts[d] : starts[d] + sizes[d]].tolist()]
        for t in np.flatnonzero(y >= 0):
            seen = [x for x in row[: S.REACH + t + 1].tolist() if x >= 0]
            at = next(k for k in range(len(text)) if text[k + 1 :][:1] == [y[t]] and text[max(0, k + 1 - len(seen)) : k + 1] == seen)
            assert len(seen) >= min(S.REACH, at + 1)


def test_attention_sees_nothing_later():
    model = S.Model.fresh(np.arange(60))
    draw = np.random.default_rng(1)
    context = draw.integers(0, 59, (3, S.REACH + S.STEP))
    _, before = S.attend(model.tables(model.x), model.near, context, np.arange(S.STEP))
    context[:, S.REACH + 5 :] = 7
    _, after = S.attend(model.tables(model.x), model.near, context, np.arange(S.STEP))
    assert np.array_equal(before[:, :5], after[:, :5]) and not np.allclose(before[:, 5:], after[:, 5:])


def test_gradients_agree_with_differences():
    draw = np.random.default_rng(2)
    counts = np.arange(40) + 1
    context = draw.integers(-1, 39, (6, S.REACH + S.STEP))
    context[:, S.REACH :] = np.abs(context[:, S.REACH :])
    target = draw.integers(-1, 39, (6, S.STEP))
    at = np.arange(0, S.STEP, 4)

    def loss(m):
        _, hidden = S.attend(m.tables(m.x), m.near, context, at)
        y = target[:, at]
        z = np.take_along_axis(S.class_log_odds(m, hidden), m.classes[np.maximum(y, 0)][:, :, None], 2)[:, :, 0]
        return -float(z[y >= 0].mean())

    for name in S.Model.LEARNED:
        model = S.Model.fresh(counts)
        for k in S.Model.LEARNED:
            setattr(model, k, getattr(model, k).astype(float))
        squares = {k: np.full_like(getattr(model, k), 1e30) for k in S.Model.LEARNED}  # steps too small to matter
        first = {k: getattr(model, k).copy() for k in S.Model.LEARNED}
        S.learn(model, squares, context, target, at, rate=1e10)
        slope = (first[name] - getattr(model, name)) * 1e5
        for k in S.Model.LEARNED:
            setattr(model, k, first[k].copy())
        flat = getattr(model, name).reshape(-1)
        for i in np.argsort(-np.abs(slope).ravel())[:3]:
            flat[i] += 1e-4
            up = loss(model)
            flat[i] -= 2e-4
            down = loss(model)
            flat[i] += 1e-4
            assert slope.ravel()[i] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=1e-4), name


class Counted:
    """numpy, counting the numbers whose exponential is taken."""

    def __init__(self):
        self.taken = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def exp(self, x, **rest):
        self.taken += np.size(x)
        return np.exp(x, **rest)


def test_a_step_takes_one_exponential_of_each_weight_and_class_score(monkeypatch):
    model = S.Model.fresh(np.arange(300) + 1)
    squares = {k: np.full_like(getattr(model, k), 1e-7) for k in S.Model.LEARNED}
    context, target = S.windows(np.random.default_rng(7).integers(0, 299, 4000), np.array([0]), np.array([4000]), 299)
    monkeypatch.setattr(S, "np", counted := Counted())
    S.learn(model, squares, context, target, np.arange(S.STEP), 0.1)
    classes = len(model.bias)
    assert counted.taken <= target.size * (classes + context.shape[1]) + classes


def plain_log_odds(model, context, target):
    """The model as its docstring states it, target by target, in double precision."""
    x, q, k, a, b, near, out, bias = (getattr(model, n).astype(float) for n in S.Model.LEARNED)
    z = np.zeros((*target.shape, len(bias)))
    for w, t in np.ndindex(*target.shape):
        at = S.REACH + t
        seen = [j for j in range(at + 1) if context[w, j] >= 0]
        if target[w, t] < 0 or context[w, at] < 0:
            continue
        score = x[context[w, seen]] @ k @ (x[context[w, at]] @ q) * S.WIDTH**-0.5 + near[at - np.array(seen)]
        weight = np.exp(score - score.max())
        hidden = np.tanh(x[context[w, at]] @ a + weight @ x[context[w, seen]] @ b / weight.sum())
        z[w, t] = hidden @ out + bias
        z[w, t] -= z[w, t].max() + np.log(np.exp(z[w, t] - z[w, t].max()).sum())
    return z


@pytest.mark.parametrize("sharp, wide", [(1, 1), (40, 1), (1, 300)])
def test_small_and_large_scores_give_what_the_model_states(sharp, wide):
    draw = np.random.default_rng(11)
    model = S.Model.fresh(draw.integers(0, 1000, 300))
    model.q *= sharp  # weights of scores beyond any float32 exponential
    model.out *= wide
    model.columns, model.pairs = np.arange(300) % 90, draw.integers(0, 9, (sum(S.BEFORE), 91)).astype(np.float32)
    model.near += draw.normal(size=len(model.near)).astype(np.float32)
    sizes = np.array([1, 2, 40, 100])
    context, target = S.windows(draw.integers(0, 300, sizes.sum()), np.cumsum(sizes) - sizes, sizes, 299)
    pairs, of = model.within()
    y, before = np.maximum(target, 0), model.before[np.maximum(context[:, S.REACH :], 0)]
    kind = model.classes[y]
    want = np.take_along_axis(plain_log_odds(model, context, target), kind[:, :, None], 2)[:, :, 0]
    want += np.log(pairs[before, model.columns[y]] + S.PRIOR * model.share[y]) - of[before, kind]
    assert np.allclose(S.Scorer(model).score(context, target), np.where(target >= 0, want, 0), rtol=1e-3, atol=2e-3)


def test_sums_by_row_are_those_of_a_plain_loop():
    draw = np.random.default_rng(12)
    for rows, n in ((draw.zipf(1.3, 5000) % 700 - 1, 700), (np.full(600, 3), 9), (np.full(4, -1), 2), (np.arange(40_000), 40_000)):
        values = draw.normal(size=(len(rows), 5))
        want = np.zeros((n, 5))
        for r, v in zip(rows, values):
            if r >= 0:
                want[r] += v
        assert np.allclose(S._by_row(rows, values, n), want)


def test_every_target_of_a_short_text_is_learned(spark):
    vocabulary = S.Vocabulary.read()
    docs = spark.createDataFrame([(1, "red green blue white black", False)], "id long, text string, held boolean").coalesce(1)
    blocks = S.code_blocks(docs, vocabulary)
    counts = S.subword_counts(blocks, vocabulary)
    moved = (S.train(blocks, counts, vocabulary.end).x != S.Model.fresh(counts).x).any(axis=1)
    assert np.array_equal(moved, counts > 0) and moved.sum() > 5  # each stands before some target


def test_a_target_sees_sixteen_subwords_back_and_classes_tell_frequent_ones_apart():
    model = S.Model.fresh(np.arange(1000, 0, -1))
    assert model.x.shape[1] >= 24 and len(model.bias) >= 160 and len(set(model.classes[:128].tolist())) == 128
    ids = np.arange(100)
    context, target = S.windows(ids, np.array([0]), np.array([100]), 999)
    row = context[np.flatnonzero((target == 64).any(axis=1))[0]]
    assert set(range(48, 64)) <= set(row.tolist())


def test_class_shares_sum_to_one():
    model = S.Model.fresh(np.random.default_rng(5).integers(0, 1000, 700))
    assert np.bincount(model.classes, model.share) == pytest.approx(1)
    model.columns = np.minimum(np.arange(700), 500)
    model.pairs = np.random.default_rng(6).integers(0, 9, (sum(S.BEFORE), 501)).astype(np.float32)
    model.pairs[:, -1] = 0
    pairs, of = model.within()
    share = np.log(pairs[3, model.columns] + S.PRIOR * model.share) - of[3, model.classes]
    assert np.bincount(model.classes, np.exp(share)) == pytest.approx(1, rel=1e-3)


def slow_base(rows, held):
    words = lambda t: t.encode().lower().split()
    counts, n = {}, 0
    for (_, t), out in zip(rows, held):
        if not out:
            for w in [*words(t), None]:
                counts[w] = counts.get(w, 0) + 1
                n += 1
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in tokens)
        yield i, len(tokens), sum(w in counts for w in tokens), n, base


def test_base_scores_and_odd_rows(spark):
    rows = texts()
    held = [i in (2, 6, 8) for i, _ in rows]
    found = S.score_documents(odd(spark), F.col("doc_id").isin(2, 6, 8)).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found)
    assert got == sorted((str(i), a, b, n, round(s, 4)) for i, a, b, n, s in slow_base(rows, held))
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert sum(r["held_out"] for r in found) == 3
    long = [r["score"] for r in found if r["n_tokens"] > 1000]
    assert len(long) == 2 and long[0] == pytest.approx(long[1]) and len(LONG.split()) == 60_000
    assert S.score_documents(odd(spark, []), F.lit(False)).count() == 0


def test_model_beats_its_base_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = S.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    base, score = found.where("held_out").selectExpr("sum(base_score)", "sum(score)").first()
    assert score > base


def test_words_encoded_together_are_as_encoded_alone():
    words = [w.encode() for w in ("the", "l'été", "x--y", "12a", "don't", " a", "b c", "d ", "日本", "a" * 300, "!?", "ﬀ")]
    voc = S.Vocabulary.read()
    own = S.encoder(voc.ranks, voc.pattern)
    for some in (words, [w for w in words if not S.OTHER_SPACE.search(w.decode())], []):
        ids, sizes = voc.encode(some)
        alone = [own.encode_ordinary(" " + w.decode()) for w in some]
        assert ids.tolist() == [x for m in alone for x in m] and sizes.tolist() == [len(m) for m in alone]


def test_scorer_agrees_with_the_model_step_by_step():
    draw = np.random.default_rng(9)
    model = S.Model.fresh(draw.integers(0, 1000, 300))
    model.columns, model.pairs = np.arange(300) % 90, draw.integers(0, 9, (sum(S.BEFORE), 91)).astype(np.float32)
    model.near += draw.normal(size=len(model.near)).astype(np.float32)
    sizes = np.array([1, 2, 40, 700])
    ids = draw.integers(0, 300, sizes.sum())
    context, target = S.windows(ids, np.cumsum(sizes) - sizes, sizes, 299)
    got = S.Scorer(model).score(context, target)
    _, hidden = S.attend(model.tables(model.x), model.near, context, np.arange(S.STEP))
    pairs, of = model.within()
    y, before = np.maximum(target, 0), model.before[np.maximum(context[:, S.REACH :], 0)]
    kind = model.classes[y]
    want = np.take_along_axis(S.class_log_odds(model, hidden), kind[:, :, None], 2)[:, :, 0]
    want += np.log(pairs[before, model.columns[y]] + S.PRIOR * model.share[y]) - of[before, kind]
    assert np.allclose(got, np.where(target >= 0, want, 0), atol=1e-3)


def in_small_blocks(monkeypatch, words, **limits):
    """Frames that are stored, by name, with blocks of about so many words."""
    stored, code, store = {}, S.code_blocks, S.store
    monkeypatch.setattr(S, "code_blocks", lambda rows, vocabulary: code(rows, vocabulary, words))
    monkeypatch.setattr(S, "store", lambda df, name, **how: stored.setdefault(name, store(df, name, **how)))
    for name, value in limits.items():
        monkeypatch.setattr(S, name, value)
    return stored


def test_writers_and_readers_hold_one_block_at_a_time(spark, monkeypatch):
    stored = in_small_blocks(monkeypatch, 20)
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(10))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = S.score_documents(docs, F.col("doc_id") % 5 == 0).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(30))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in stored["blocks"].inputFiles()]
    assert sum(m.num_rows for m in files) == 15
    assert all(m.row_group(i).num_rows == 1 for m in files for i in range(m.num_row_groups))


def test_long_words_and_nearly_empty_documents_end_a_block(spark, monkeypatch):
    texts = ["", None, "x" * 40, "", "y" * 50 + " z", "red green", *[""] * 5, "red"]
    held = [i % 4 == 1 for i in range(len(texts))]
    stored = in_small_blocks(monkeypatch, 1000, TEXT=60, DOCUMENTS=4)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    found = S.score_documents(docs, F.col("doc_id") % 4 == 1).collect()
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found)
    rows = [(i, t or "") for i, t in enumerate(texts)]
    assert got == [(i, a, b, n, round(s, 4)) for i, a, b, n, s in slow_base(rows, held)]
    sizes = [[len((texts[i] or "").encode()) for i in r["ids"]] for r in stored["blocks"].select("ids").collect()]
    assert all(len(x) <= 4 and sum(x[:-1]) < 60 for x in sizes)


def test_documents_are_spelled_some_at_a_time():
    sizes = np.array([0] * 250 + [3] * 10 + [40], dtype=np.int32)
    codes = np.arange(sizes.sum(), dtype=np.int32) % 5
    subs, sub_sizes = np.arange(10, dtype=np.uint16), np.full(5, 2, dtype=np.int32)
    whole = [*S.documents(sizes, codes, subs, sub_sizes, 99, np.arange(len(sizes)), (10_000, 10_000))]
    some = [*S.documents(sizes, codes, subs, sub_sizes, 99, np.arange(len(sizes)), (20, 100))]
    assert len(whole) == 1 and all(len(part) <= 100 for part, *_ in some)
    assert np.array_equal(np.concatenate([ids for _, ids, _, _ in some]), whole[0][1])
    assert np.array_equal(np.concatenate([n for *_, n in some]), whole[0][3])


def test_windows_of_a_long_text_are_laid_out_some_at_a_time(monkeypatch):
    draw = np.random.default_rng(13)
    model = S.Model.fresh(draw.integers(0, 1000, 300))
    model.columns, model.pairs = np.arange(300) % 90, draw.integers(0, 9, (sum(S.BEFORE), 91)).astype(np.float32)
    sizes = np.array([1, 20_000, 33])
    ids, starts = draw.integers(0, 300, sizes.sum()), np.cumsum(sizes) - sizes
    scorer = S.Scorer(model)
    context, target = S.windows(ids, starts, sizes, 299)
    want = scorer.score(context, target)[target >= 0]
    laid, lay = [], S.laid_out
    monkeypatch.setattr(S, "laid_out", lambda ids, start, *rest: laid.append(len(start)) or lay(ids, start, *rest))
    monkeypatch.setattr(S, "LAID", 2 * S.BATCH)
    assert np.array_equal(scorer.targets(ids, starts, sizes, 299), want)
    assert sum(laid) == len(context) and max(laid) == 2 * S.BATCH


def test_a_task_gives_back_its_rows_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(S, "ROWS", 7)
    made = [*S.in_parts({"a": np.arange(20), "b": np.arange(20) / 2})]
    assert [x.num_rows for x in made] == [7, 7, 6] and sum((x.column("a").to_pylist() for x in made), []) == [*range(20)]
    assert not [*S.in_parts({"a": np.arange(0)})]
