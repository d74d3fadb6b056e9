"""Language-model scoring: causal self-attention over subword ids, trained and applied in numpy.

The corpus is coded once: a block of documents is stored as its distinct words, their training counts, their
subword ids and the documents as numbers into these words.  Word counts over the whole corpus, training and
scoring start from the blocks; texts are read and cut into subwords once.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .common import store, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's tokenizer cuts a text before it merges bytes (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WORDS = 3_000_000  # words that a block holds, about
TEXT, DOCUMENTS = 16 * WORDS, WORDS // 6  # bytes of text and documents after which a block ends as well
ENCODED = 100_000  # words that are encoded in one go
PART = 400_000, 100_000  # words and documents of a block that are spelled at a time
WIDTH = 24  # of the vectors
STEP = 16  # targets of a window
REACH = 16  # subwords before its first target that a window sees
SINGLE, GROUPS = 128, 32  # classes that the model tells apart: frequent subwords, and groups of the others
BEFORE = 512, 64  # the same for the subword before a target, in the counts of what follows it
BATCH, STEPPED = 256, 256  # windows scored at a time, and windows of one training step
LAID = 64 * BATCH  # windows that are laid out at a time to be scored
ROWS = 100_000  # rows that a task gives back at a time
PRIOR = 20.0  # weight of a subword's plain share of its class, in counts
MIXES = 0.3, 0.6, 0.9  # weights that the words' own counts may have in a text, all as likely beforehand


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str):
    import tiktoken

    parsed = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parsed, special_tokens={})


#: White space that is no space; words have none of the ASCII kind.
OTHER_SPACE = re.compile(r"[^\S ]")


@lru_cache(maxsize=2)
def begins_with_space(ranks: bytes) -> np.ndarray:
    parsed = {int(b): base64.b64decode(a) for a, b in (line.split() for line in ranks.splitlines())}
    return np.array([parsed.get(i, b"").startswith(b" ") for i in range(max(parsed) + 1)])


@dataclass
class Vocabulary:
    """A byte-level BPE vocabulary; the id after its last one ends a document."""

    ranks: bytes
    pattern: str = PATTERN

    @classmethod
    def read(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read())

    @property
    def end(self) -> int:
        return self.ranks.count(b"\n") + (not self.ranks.endswith(b"\n"))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of all words, each as it stands after a space, and how many each word has.

        Words are cut at spaces before anything else, so all are encoded in one go and parted where a subword
        begins with a space; words with other white space inside could run together and go one by one.
        """
        own = encoder(self.ranks, self.pattern)  # once: finding it compares the whole file
        texts = [" " + w.decode() for w in words]
        joined = "".join(texts)
        if OTHER_SPACE.search(joined) is None:
            ids = np.array(own.encode_ordinary(joined), dtype=np.uint16)
            starts = np.flatnonzero(begins_with_space(self.ranks)[ids])
            if len(starts) == len(words):
                return ids, np.diff(starts, append=len(ids)).astype(np.int32)
        made = [own.encode_ordinary(t) for t in texts]
        return np.array([x for m in made for x in m], dtype=np.uint16), np.array([len(m) for m in made], dtype=np.int32)


BLOCK = (
    "block long, ids {ids}, held array<boolean>, sizes binary, codes binary, subs binary, sub_sizes binary,"
    " words string, train array<int>"
)


def code_blocks(rows: DataFrame, vocabulary: Vocabulary, words: int = WORDS) -> DataFrame:
    """Blocks of whole documents from ``id, text, held`` rows, each of about ``words`` words or one document, and
    fewer where words are long or documents nearly empty.

    sizes: words of each document; codes: their numbers in ``words`` (parted by line feeds, which no word
    has); subs, sub_sizes: the subword ids of ``words``; train: the words' counts in documents not held out.
    """
    kind = rows.schema["id"].dataType.simpleString()
    held_type = pa.list_(pa.bool_())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers: dict[bytes, int] = defaultdict(count().__next__)  # a new word takes the next number
        ids: list = []
        held: list[bool] = []
        sizes, codes, n_blocks = array("i"), array("i"), 0
        id_type, read = None, 0

        def block() -> pa.RecordBatch:
            nonlocal numbers, ids, held, sizes, codes, n_blocks, read
            known = list(numbers)
            spelled = [vocabulary.encode(known[i : i + ENCODED]) for i in range(0, max(1, len(known)), ENCODED)]
            subs, sub_sizes = (np.concatenate(x) for x in zip(*spelled))
            at, size = np.frombuffer(codes, dtype=np.int32), np.frombuffer(sizes, dtype=np.int32)
            learned = np.repeat(~np.array(held, dtype=bool), size)
            train = np.bincount(at[learned], minlength=len(known)).astype(np.int32)
            name = (TaskContext.get().partitionId() << 24) + n_blocks
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([held], held_type),
                    pa.array([size.tobytes()]), pa.array([at.tobytes()]),
                    pa.array([subs.tobytes()]), pa.array([sub_sizes.tobytes()]),
                    pa.array([b"\n".join(known).decode()]), pa.array([train], pa.list_(pa.int32())),
                ],
                names=["block", "ids", "held", "sizes", "codes", "subs", "sub_sizes", "words", "train"],
            )
            numbers, ids, held, n_blocks = defaultdict(count().__next__), [], [], n_blocks + 1
            sizes, codes, read = array("i"), array("i"), 0
            return made

        for batch in batches:
            id_type = batch.schema.field("id").type
            for k, text, out in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "held"))):
                found = text.lower().split()
                codes.extend(map(numbers.__getitem__, found))
                sizes.append(len(found))
                ids.append(k)
                held.append(out)
                read += len(text)
                if len(codes) >= words or read >= TEXT or len(ids) >= DOCUMENTS:
                    yield block()
        if ids:
            yield block()

    made = rows.select("id", F.col("text").cast("binary").alias("text"), "held")
    return made.mapInArrow(each, BLOCK.format(ids=f"array<{kind}>"))


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each block that hold numbers, as arrays over the memory of the batch: nothing is copied."""
    kinds = {"sizes": np.int32, "codes": np.int32, "subs": np.uint16, "sub_sizes": np.int32}
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            row = {
                name: np.frombuffer(x.as_buffer(), kinds[name]) if name in kinds else x.values.to_numpy(zero_copy_only=False)
                for name, x in row.items()
            }
            yield row
            row.clear()  # the next batch is read when nothing holds this one
        del batch


def in_parts(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Columns of equal length as batches of bounded size."""
    n = len(next(iter(rows.values())))
    for at in range(0, n, ROWS):
        yield pa.RecordBatch.from_pydict({name: pa.array(x[at : at + ROWS]) for name, x in rows.items()})


def corpus_counts(blocks: DataFrame) -> DataFrame:
    """``block, at, c, first``: for every word of every block its count in the training documents of the whole
    corpus; ``first`` marks one row of each word.  A word has one row per block, so no group is large."""
    words = blocks.select(
        "block", "train", F.posexplode(F.split("words", "\n")).alias("at", "word")
    ).where("word <> ''")
    words = words.select("block", "at", "word", F.element_at("train", F.col("at") + 1).alias("n"))
    same = Window.partitionBy("word")
    return words.select(
        "block", "at", F.sum("n").over(same).alias("c"),
        (F.row_number().over(same.orderBy("block")) == 1).alias("first"),
    )


def subword_counts(blocks: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Training counts of every subword id, ends included: to the driver comes one row per id."""
    end = vocabulary.end

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1, dtype=np.int64)
        for row in cells(batches):
            weights = np.repeat(row["train"].astype(np.int64), row["sub_sizes"])
            total += np.bincount(row["subs"], weights=weights, minlength=end + 1).astype(np.int64)
            total[end] += np.count_nonzero(~row["held"])
        at = np.flatnonzero(total)
        yield from in_parts({"id": at.astype(np.int32), "n": total[at]})

    found = blocks.select("held", "subs", "sub_sizes", "train").mapInArrow(each, "id int, n long")
    counts = np.zeros(end + 1, dtype=np.int64)
    for i, n in found.groupBy("id").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        counts[i] = n
    return counts


@dataclass
class Model:
    """Attention over the subwords so far, then classes, then the subword's share of its class.

    For the vectors x of the subwords in a window, the output at t is tanh(x_t A + sum_j a_tj x_j B), where a_t
    is the softmax over j <= t of x_t Q (x_j K)' plus a bias by distance.  It gives the log probabilities of
    the classes; within a class a subword has its share of the corpus counts after subwords of the same kind
    as the one before.
    """

    x: np.ndarray  # vocabulary x width; the last is the end, which also stands before each text
    q: np.ndarray
    k: np.ndarray
    a: np.ndarray
    b: np.ndarray
    near: np.ndarray  # bias by distance
    out: np.ndarray  # width x classes
    bias: np.ndarray
    classes: np.ndarray  # of each id
    share: np.ndarray  # share of each id within its class
    before: np.ndarray  # the kind of each id as the subword before a target
    pairs: np.ndarray | None = None  # kind before x column: training counts; the last column is empty
    columns: np.ndarray | None = None  # the column of each id

    LEARNED = ("x", "q", "k", "a", "b", "near", "out", "bias")

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Model:
        n, rng = len(counts), np.random.default_rng(4)
        smooth = counts + 0.1
        classes, before = _by_frequency(smooth, SINGLE, GROUPS), _by_frequency(smooth, *BEFORE)
        total = np.bincount(classes, weights=smooth, minlength=SINGLE + GROUPS)
        draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        d, window = WIDTH, REACH + STEP
        return cls(
            x=draw(n, d) * 0.3, q=draw(d, d) * d**-0.5, k=draw(d, d) * d**-0.5, a=draw(d, d) * d**-0.5,
            b=draw(d, d) * d**-0.5, near=np.zeros(window, dtype=np.float32), out=draw(d, SINGLE + GROUPS) * 0.1,
            bias=np.log(np.maximum(total, 1e-6) / smooth.sum()).astype(np.float32), classes=classes,
            share=smooth / total[classes], before=before,
        )

    def tables(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """What depends on one subword alone, for vectors ``x``: query, key, direct part and value."""
        return x @ self.q * np.float32(WIDTH**-0.5), x @ self.k, x @ self.a, x @ self.b

    def within(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the ids that follow each kind, and the logs of those of their classes, to divide by."""
        of = np.zeros((len(self.pairs), SINGLE + GROUPS))
        known = np.flatnonzero(self.columns < self.pairs.shape[1] - 1)
        known = known[np.argsort(self.classes[known], kind="stable")]
        if len(known):
            kind = self.classes[known]
            edges = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
            for at in range(0, len(of), 32):  # a copy of some rows at a time
                some = self.pairs[at : at + 32, self.columns[known]]
                of[at : at + 32, kind[edges]] = np.add.reduceat(some, edges, axis=1, dtype=float)
        return self.pairs, np.log(of + PRIOR).astype(np.float32)


def _by_frequency(counts: np.ndarray, single: int, groups: int) -> np.ndarray:
    """A number for each id: the ``single`` most frequent have their own, the others share ``groups`` numbers
    of about equal counts."""
    order = np.argsort(-counts, kind="stable")
    numbers = np.empty(len(counts), dtype=np.int64)
    numbers[order[:single]] = np.arange(min(single, len(counts)))
    rest = order[single:]
    mass = np.cumsum(counts[rest]) / max(counts[rest].sum(), 1e-9)
    numbers[rest] = single + np.minimum((mass * groups).astype(np.int64), groups - 1)
    return numbers


def windows(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, end: int, reach: int = REACH, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows over documents that lie in ``ids`` at ``starts``, each closed by the end.

    Returns context ids (windows x reach + step), -1 where there is none, and targets (windows x step), -1
    beyond the document.  Each target stands in one window, in order; before it stand the end (for the
    beginning) and the subwords that precede it, back to ``reach`` before the window's first target.
    """
    return laid_out(ids, *places(starts, sizes, step), end, reach, step)


def places(starts: np.ndarray, sizes: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window where its document starts, the document's size and the window's first target in it."""
    per = -(-sizes // step)
    first = (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)) * step
    return np.repeat(starts, per), np.repeat(sizes, per), first


def laid_out(ids: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, end: int, reach: int = REACH, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets of some windows of ``places``."""
    # one padded row of ids for contexts and targets: from reach + 1 before the first target on
    place = first[:, None] + np.arange(-reach - 1, step)
    row = ids[np.clip(start[:, None] + place, 0, len(ids) - 1)]
    row[(place < 0) | (place >= size[:, None])] = -1
    row[place == -1] = end
    target = row[:, reach + 1 :]
    context = row[:, :-1]
    return context, target


LARGE = 60  # scores that are surely smaller need no shift: float32 holds their exponentials, and sums and ratios of these


class Rows:
    """The tables of a model side by side, to be taken by subword: query, 1 and direct part; key, 0, value and 1.

    A last row, which -1 takes, stands for nothing: its key puts off every query by the 1.  The 1 beside the
    values makes the sum of the weights a column of their mean.  ``shift``: scores may be too large as they are.
    """

    def __init__(self, tables: tuple[np.ndarray, ...], near: np.ndarray) -> None:
        q, k, direct, value = tables
        n, self.width = q.shape
        d = self.width
        self.asking = np.zeros((n + 1, 2 * d + 1), dtype=q.dtype)
        self.asking[:-1, :d], self.asking[:, d], self.asking[:-1, d + 1 :] = q, 1, direct
        self.seen = np.zeros((n + 1, 2 * d + 2), dtype=q.dtype)
        self.seen[:-1, :d], self.seen[-1, d], self.seen[:-1, d + 1 : -1], self.seen[:, -1] = k, -1e9, value, 1
        longest = lambda v: np.sqrt(np.einsum("ij,ij->i", v, v).max(initial=0))
        self.shift = not longest(q) * longest(k) + np.abs(near).max() < LARGE


def look(rows: Rows, near: np.ndarray, context: np.ndarray, at: np.ndarray, reach: int = REACH):
    """What ``attend`` says, and what its slopes are made of: exponentials of the scores (windows x targets x
    context) and their sums, means of the values, and the rows taken."""
    d = rows.width
    asking, seen = rows.asking.take(context[:, reach + at], axis=0), rows.seen.take(context, axis=0)
    back = reach + at[:, None] - np.arange(context.shape[1])[None, :]
    weights = asking[:, :, : d + 1] @ seen[:, :, : d + 1].transpose(0, 2, 1)
    weights += np.where(back >= 0, near[np.maximum(back, 0)], np.float32(-1e9))
    if rows.shift:
        weights -= weights.max(axis=2, keepdims=True)
    np.exp(weights, out=weights)
    mean = weights @ seen[:, :, d + 1 :]
    total = np.maximum(mean[:, :, -1:], np.float32(1e-30))  # beyond a document nothing may be seen
    mean = mean[:, :, :-1] / total
    hidden = asking[:, :, d + 1 :] + mean
    return np.tanh(hidden, out=hidden), weights, total, mean, asking, seen


def attend(tables, near: np.ndarray, context: np.ndarray, at: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Attention weights (windows x targets x context) and hidden vectors of the targets at the places ``at``.

    ``context`` numbers rows of ``tables``, -1 is nothing.  A target sees what stands before it in the window.
    """
    hidden, weights, total, *_ = look(Rows(tables, near), near, context, at, reach)
    return weights / total, hidden


class Classes:
    """The step from hidden vectors, which lie between -1 and 1, to the odds of the classes.

    Where no score can be large the bias is a factor of the odds, so that it need not be added to each score.
    """

    def __init__(self, model: Model) -> None:
        self.out, self.bias = model.out, model.bias
        self.shift = not np.abs(model.out).sum(axis=0).max() + np.ptp(np.append(model.bias, 0)) < LARGE
        self.factor = np.ones_like(model.bias) if self.shift else np.exp(model.bias)

    def scores(self, hidden: np.ndarray) -> np.ndarray:
        """Scores of the classes: exponentials of them times ``factor`` are in proportion to the probabilities."""
        z = hidden @ self.out
        if self.shift:
            z += self.bias
            z -= z.max(axis=1, keepdims=True)
        return z


def class_log_odds(model: Model, hidden: np.ndarray) -> np.ndarray:
    z = hidden @ model.out + model.bias
    z -= z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def _by_row(rows: np.ndarray, values: np.ndarray, n: int, most: int = 8) -> np.ndarray:
    """Sums of ``values`` by their row number, negative ones left out: up to ``most`` of a row are added side by
    side with those of all others, and so again with these sums until each row has one."""
    order = np.argsort(rows.astype(np.int16) if n < 1 << 15 else rows, kind="stable")  # short ones: a radix sort
    order = order[np.count_nonzero(rows < 0) :]
    counts = np.bincount(rows[order], minlength=n)
    met = np.flatnonzero(counts)
    counts = counts[met]
    while True:
        starts, parts = np.cumsum(counts) - counts, -(-counts // most)
        first = np.repeat(starts - (np.cumsum(parts) - parts) * most, parts) + np.arange(int(parts.sum())) * most
        left = np.repeat(starts + counts, parts) - first
        by = np.argsort(-np.minimum(left, most), kind="stable")  # those with more to add stand first
        first, left = first[by], left[by]
        sums = values.take(order[first], axis=0)
        for k in range(1, most):
            more = np.count_nonzero(left > k)
            if not more:
                break
            sums[:more] += values.take(order[first[:more] + k], axis=0)
        values, counts = sums, parts
        order = np.empty(len(by), dtype=np.int64)
        order[by] = np.arange(len(by))
        if len(order) == len(met):
            break
    out = np.zeros((n, values.shape[1]), dtype=values.dtype)
    out[met] = values[order]
    return out


def learn(model: Model, squares: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, at: np.ndarray, rate: float, reach: int = REACH) -> None:
    """One Adagrad step on the mean loss of the targets at the places ``at`` of each window.

    Sums of exponentials are divided by where an array is as wide as a vector, not on weights and class scores,
    so each of these is written once, as its exponential.
    """
    met = np.zeros(len(model.x) + 1, dtype=bool)
    met[context] = True  # -1 is the last
    ids = np.flatnonzero(met[:-1])
    number = np.full(len(met), -1)
    number[ids] = np.arange(len(ids))
    local = number[context]
    x, d = model.x[ids], WIDTH
    hidden, weights, total, mean, asking, seen = look(Rows(model.tables(x), model.near), model.near, local, at, reach)
    y = target[:, at].ravel()
    real = (y >= 0).astype(x.dtype)
    real /= max(1, np.count_nonzero(real))

    flat, kind, classes = hidden.reshape(-1, d), model.classes[y], Classes(model)
    slope = classes.scores(flat)
    np.exp(slope, out=slope)
    of = slope @ classes.factor
    slope[np.arange(len(y)), kind] -= of / classes.factor[kind]
    real /= of
    d_hidden = slope @ (model.out * classes.factor).T
    d_hidden *= real[:, None]
    d_out, d_bias = (flat * real[:, None]).T @ slope * classes.factor, real @ slope * classes.factor
    d_hidden -= d_hidden * flat * flat

    d_hidden = d_hidden.reshape(hidden.shape)
    left = np.empty((*hidden.shape[:2], d + 1), dtype=x.dtype)  # slopes of the sums of values, and of weights
    left[:, :, :-1] = d_hidden
    left[:, :, -1] = -np.einsum("ijk,ijk->ij", d_hidden, mean)
    left /= total
    d_scores = left @ seen[:, :, d + 1 :].transpose(0, 2, 1)
    d_scores *= weights
    back = np.maximum(reach + at[:, None] - np.arange(context.shape[1])[None, :], 0)
    as_key = np.empty((*local.shape, 2 * d), dtype=x.dtype)
    np.matmul(d_scores.transpose(0, 2, 1), asking[:, :, :d], out=as_key[:, :, :d])
    np.matmul(weights.transpose(0, 2, 1), left[:, :, :-1], out=as_key[:, :, d:])
    as_query = np.empty((*hidden.shape[:2], 2 * d), dtype=x.dtype)
    np.matmul(d_scores, seen[:, :, :d], out=as_query[:, :, :d])
    as_query[:, :, d:] = d_hidden
    key = _by_row(local.ravel(), as_key.reshape(-1, 2 * d), len(ids))
    own = _by_row(local[:, reach + at].ravel(), as_query.reshape(-1, 2 * d), len(ids))
    own[:, :d] *= np.float32(WIDTH**-0.5)
    d_k, d_b, d_q, d_a = key[:, :d], key[:, d:], own[:, :d], own[:, d:]
    slopes = {
        "q": x.T @ d_q, "k": x.T @ d_k, "a": x.T @ d_a, "b": x.T @ d_b,
        "near": np.bincount(back.ravel(), d_scores.sum(axis=0).ravel(), len(model.near)).astype(np.float32),
        "out": d_out, "bias": d_bias,
    }
    d_x = d_q @ model.q.T + d_k @ model.k.T + d_a @ model.a.T + d_b @ model.b.T
    for name, g in slopes.items():
        squares[name] += g * g
        getattr(model, name)[...] -= rate * g / np.sqrt(squares[name])
    squares["x"][ids] += d_x * d_x
    model.x[ids] -= rate * d_x / np.sqrt(squares["x"][ids])


def documents(sizes: np.ndarray, codes: np.ndarray, subs: np.ndarray, sub_sizes: np.ndarray, end: int, wanted: np.ndarray, most: tuple[int, int] = PART):
    """The wanted documents of a block as subword ids, some at a time: ``(numbers, ids, starts, sizes)``."""
    sizes, sub_sizes = sizes.astype(np.int64), sub_sizes.astype(np.int64)
    starts, sub_starts = np.cumsum(sizes) - sizes, np.cumsum(sub_sizes) - sub_sizes
    at = 0
    while at < len(wanted):
        until = at + 1
        n = sizes[wanted[at]]
        while until < len(wanted) and n + sizes[wanted[until]] <= most[0] and until - at < most[1]:
            n += sizes[wanted[until]]
            until += 1
        part = wanted[at:until]
        at = until
        # every word of the part, then an end for each document, as runs of subwords
        words = _runs(starts[part], sizes[part])
        code = codes[words]
        length = sub_sizes[code]
        ids = subs[_runs(sub_starts[code], length)].astype(np.int64)
        total = np.add.reduceat(np.append(length, 0), np.minimum(np.cumsum(sizes[part]) - sizes[part], len(length)))
        total[sizes[part] == 0] = 0
        ids = np.insert(ids, np.cumsum(total), end)
        yield part, ids, np.cumsum(total + 1) - total - 1, total + 1


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def pair_counts(blocks: DataFrame, model: Model, end: int) -> Model:
    """The model with the training counts of every subword after every kind, over all training documents.
    To the driver comes one row per kind and subword that follow each other."""
    kinds, n_ids = model.before, len(model.before)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(BEFORE) * n_ids, dtype=np.int32)
        for row in cells(batches):
            wanted = np.flatnonzero(~row.pop("held"))
            for _, ids, starts, _ in documents(**row, end=end, wanted=wanted):
                before = np.concatenate([[end], ids[:-1]])
                before[starts] = end
                key, n = np.unique(kinds[before] * n_ids + ids, return_counts=True)
                total[key] += n
        at = np.flatnonzero(total)
        yield from in_parts({"key": at, "n": total[at].astype(np.int64)})

    found = blocks.select("held", "sizes", "codes", "subs", "sub_sizes").mapInArrow(each, "key long, n long")
    counts = found.groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    before, ids = np.divmod(counts["key"].to_numpy(dtype=np.int64), n_ids)
    seen, column = np.unique(ids, return_inverse=True)
    model.pairs = np.zeros((sum(BEFORE), len(seen) + 1), dtype=np.float32)
    model.pairs[before, column] = counts["n"].to_numpy()
    model.columns = np.full(n_ids, len(seen))
    model.columns[seen] = np.arange(len(seen))
    return model


def train(blocks: DataFrame, counts: np.ndarray, end: int, rate: float = 0.1) -> Model:
    """A model that has seen every training document once.

    Each task starts from the same model, takes steps over its blocks and gives back what it has moved; the
    moves are averaged with the windows they come from as weights.  The loss is taken at every target of every
    training document, in the windows that scoring has.  To the driver come one vector per subword that was
    seen and the other parts of the model, however large the corpus.
    """
    model = Model.fresh(counts)
    held = blocks.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = held.value
        own = replace(start, **{k: getattr(start, k).copy() for k in Model.LEARNED})
        squares = {k: np.full_like(getattr(own, k), 1e-7) for k in Model.LEARNED}
        seen, total = np.zeros(len(own.x), dtype=bool), 0
        for row in cells(batches):
            wanted = np.flatnonzero(~row.pop("held"))
            for _, ids, starts, sizes in documents(**row, end=end, wanted=wanted):
                seen[ids] = True
                at_place = places(starts, sizes)
                mixed = np.random.default_rng(len(ids)).permutation(len(at_place[0]))
                for at in range(0, len(mixed), STEPPED):
                    part = mixed[at : at + STEPPED]
                    context, target = laid_out(ids, *(x[part] for x in at_place), end)
                    learn(own, squares, context, target, np.arange(STEP), rate)
                total += len(mixed)
        if not total:
            return
        seen[end] = True
        for name in Model.LEARNED:
            moved = getattr(own, name) - getattr(start, name)
            rows = np.flatnonzero(seen) if name == "x" else np.arange(len(moved) if moved.ndim > 1 else 1)
            moved = moved.reshape(-1, moved.shape[-1])[rows]
            for made in in_parts({
                "row": np.repeat(rows, moved.shape[1]).astype(np.int32),
                "col": np.tile(np.arange(moved.shape[1], dtype=np.int32), len(rows)),
                "move": moved.ravel().astype(float) * total,
            }):
                alike = {"part": pa.repeat(name, made.num_rows), "weight": pa.repeat(float(total), made.num_rows)}
                yield pa.RecordBatch.from_arrays([*alike.values(), *made.columns], names=[*alike, *made.schema.names])

    moves = blocks.select("held", "sizes", "codes", "subs", "sub_sizes").mapInArrow(
        each, "part string, weight double, row int, col int, move double"
    )
    mean = moves.groupBy("part", "row", "col").agg((F.sum("move") / F.sum("weight")).alias("move"))
    for name, group in mean.toPandas().groupby("part"):
        value = getattr(model, name)
        value.reshape(-1, value.shape[-1])[group["row"], group["col"]] += group["move"].to_numpy(dtype=np.float32)
    return model


class Scorer:
    """A model made ready for scoring: what depends on one subword alone is computed once for all of them."""

    def __init__(self, model: Model) -> None:
        self.rows, self.near, self.kinds = Rows(model.tables(model.x), model.near), model.near, Classes(model)
        self.classes, self.before, self.columns = model.classes, model.before, model.columns
        self.pairs, self.of_class = model.within()
        self.prior = (PRIOR * model.share).astype(np.float32)

    def score(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The natural log probability of each target, 0 where there is none."""
        out = np.zeros(target.shape, dtype=np.float32)
        for at in range(0, len(context), BATCH):
            seen, y = context[at : at + BATCH], target[at : at + BATCH].ravel()
            hidden = look(self.rows, self.near, seen, np.arange(STEP))[0]
            z = self.kinds.scores(hidden.reshape(-1, WIDTH))
            kind, before = self.classes[y], self.before[seen[:, REACH:].ravel()]
            found = z[np.arange(len(y)), kind] + np.log(self.kinds.factor[kind])
            found -= np.log(np.exp(z, out=z) @ self.kinds.factor)
            found += np.log(self.pairs[before, self.columns[y]] + self.prior[y]) - self.of_class[before, kind]
            out[at : at + BATCH] = np.where(y >= 0, found, 0).reshape(-1, STEP)
        return out

    def targets(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
        """The natural log probability of each subword of the documents, in order; some windows are laid out at a time."""
        made, at_place = [], places(starts, sizes)
        for at in range(0, len(at_place[0]), LAID):
            context, target = laid_out(ids, *(x[at : at + LAID] for x in at_place), end)
            made.append(self.score(context, target)[target >= 0])
        return np.concatenate(made).astype(np.float64)


SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, held_out: Column, vocabulary: str = VOCABULARY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per row of ``docs``.

    Texts are lower-cased (A-Z); tokens are the words and one end.  base_score is the log10 probability under
    the counts of the training documents' tokens with 0.1 added.  score is that under the model: a token's
    probability is mixed from what the attention model gives its subwords, one after the other, and its share of
    the training tokens; the text's probability is the mean over the weights ``MIXES`` of the two.  Null texts
    are empty: their one token is the end.  Without training documents the counts are zero and the model is as it
    was drawn.  Repeated rows count each time and score alike; other columns are ignored; an empty table gives an
    empty result.
    """
    kind = docs.schema[id].dataType.simpleString()
    words = Vocabulary.read(vocabulary)
    end = words.end
    rows = docs.select(F.col(id).alias("id"), text_of(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    blocks = store(code_blocks(rows, words), "blocks", apart=True)
    found = store(corpus_counts(blocks), "counts")
    model = pair_counts(blocks, train(blocks, subword_counts(blocks, words), end), end)

    learned = F.size(F.filter("held", lambda x: ~x))
    facts = blocks.select(
        F.aggregate("train", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"), learned.cast("long").alias("ends")
    ).agg(F.sum("words"), F.sum("ends")).first()
    n_words, n_ends = facts[0] or 0, facts[1] or 0
    distinct = found.where("first and c > 0").count() + (n_ends > 0)
    total = n_words + n_ends
    held = docs.sparkSession.sparkContext.broadcast(model)

    ready: list[Scorer] = []  # one for all blocks of a task

    def each(block: pa.Table, counts: pa.Table) -> pa.Table:
        made: list[pa.Table] = []
        if not ready:
            ready.append(Scorer(held.value))
        scorer = ready[0]
        floor = np.log10(total + 0.1 * (distinct + 1))
        coded, names = block.drop_columns(["block", "ids"]), block.column("ids").combine_chunks()
        for i, row in enumerate(cells(coded.to_batches())):
            c, out = np.zeros(len(row.pop("train")), dtype=np.int64), row.pop("held")
            c[counts.column("at").to_numpy()] = counts.column("c").to_numpy()
            sizes, codes = row["sizes"], row["codes"]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            base = np.bincount(doc, (np.log10(c + 0.1) - floor)[codes], len(sizes)) + np.log10(n_ends + 0.1) - floor
            known = np.bincount(doc, c[codes] > 0, len(sizes)).astype(np.int64) + (n_ends > 0)
            del doc
            with np.errstate(divide="ignore"):
                plain, plain_end = np.log(c / max(total, 1)), np.log(n_ends / max(total, 1))
            score, begins = np.zeros(len(sizes)), np.cumsum(sizes.astype(np.int64)) - sizes
            for part, ids, starts, lengths in documents(**row, end=end, wanted=np.arange(len(sizes))):
                found = scorer.targets(ids, starts, lengths, end)
                # a token's subwords lie side by side; the end is a token of its own
                code = codes[_runs(begins[part], sizes[part].astype(np.int64))]
                ends = np.cumsum(sizes[part].astype(np.int64))
                length = np.insert(row["sub_sizes"][code].astype(np.int64), ends, 1)
                spelled = np.add.reduceat(found, np.cumsum(length) - length)
                of = np.repeat(np.arange(len(part)), sizes[part] + 1)
                own = np.exp(np.minimum(np.insert(plain[code], ends, plain_end) - spelled, 700))
                each_mix = [np.bincount(of, np.log(w * own + (1 - w)), len(part)) for w in MIXES]
                text = np.bincount(of, spelled, len(part)) + np.logaddexp.reduce(each_mix) - np.log(len(MIXES))
                score[part] = text / np.log(10)
            made.append(pa.table({
                "id": names[i].values, "held_out": out, "n_tokens": sizes.astype(np.int64) + 1, "n_known": known,
                "train_tokens": np.full(len(sizes), total), "base_score": base, "score": score,
            }))
        return pa.concat_tables(made)

    # ids travel as text, whatever their type
    coded = blocks.select("block", F.col("ids").cast("array<string>").alias("ids"), "held", "sizes", "codes", "subs", "sub_sizes", "train")
    coded, found = coded.groupBy("block"), found.select("block", "at", "c").groupBy("block")
    scored = coded.cogroup(found).applyInArrow(each, f"id string, {SCORES}")
    return scored.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id)
