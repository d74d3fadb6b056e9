"""Byte-level BPE by a finite-state transducer that is made deterministic as texts need it, and streaming decoding."""

from __future__ import annotations

import gc
from base64 import b64decode
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import text_of
from .scoring import PATTERN

#: The rank file that texts are encoded by if no other is named.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How ids are stored one after the other: four bytes, low one first.
ID, WIDE = "<u4", 4
#: States that a machine remembers before it forgets them all and starts anew, and pieces of text whose ids a task
#: remembers twice over: the latest, and those before.
STATES = 400_000
PIECES = 250_000
#: Rows that a task has in Python at a time.
ROWS = 256


def read_ranks(path: str) -> bytes:
    """A rank file as it is; the driver reads it, tasks parse it."""
    with open(path, "rb") as file:
        return file.read()


def parsed(ranks: bytes) -> dict[bytes, int]:
    """Tokens and their ranks: one token (Base64) and its rank in each line."""
    return {b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}


class Transducer:
    """Bytes of one piece of text in, ids out.

    The merges of a byte pair vocabulary cut a piece in one way only, and a cut is theirs exactly if they leave each
    pair of neighbours in it as it is.  So the machine reads tokens along a prefix tree and passes from one token to
    the next where the two are left as they are.  That machine guesses where tokens end; a state of the machine here
    is the set of its open guesses ``(ids not yet told, id before, place in the tree)``, made the first time a text
    reaches it.  Ids that all open guesses share are told at once: a guess lives no longer than the longest token, so
    no id waits for more bytes than that.
    """

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks, self.bytes, self.limit = ranks, {i: t for t, i in ranks.items()}, states
        self.never = max(ranks.values()) + 1
        # a token that its own merges do not reach stands for a whole piece only
        self.parts: dict[int, tuple[int, int]] = {}
        self.inner = {t: i for t, i in ranks.items() if self.merged(t) == [i]}
        self.lone = {t: i for t, i in ranks.items() if t not in self.inner}
        self.plant()
        self.ordered = all(i > max(self.parts[i]) for i in self.inner.values() if i in self.parts)
        self.spines: dict[tuple[int, int], list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.forget()

    def plant(self) -> None:
        """The prefix tree of all tokens: ``node << 8 | byte`` to node, and each node's token and whether it goes on."""
        self.tree: dict[int, int] = {}
        self.token_at, self.goes_on = [-1], [True]
        for token, i in self.inner.items():
            node = 0
            for byte in token:
                self.goes_on[node] = True
                key = node << 8 | byte
                node = self.tree.get(key, -1)
                if node < 0:
                    node = self.tree[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.goes_on.append(False)
            self.token_at[node] = i

    def forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.guesses: list[tuple] = []
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.rest: list[tuple[int, ...]] = []
        self.start = self.number((((), -1, 0),))

    def merged(self, piece: bytes) -> list[int]:
        """What the merges make of a few bytes: the lowest rank first, the leftmost of equal ones."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(a + b, self.never), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if parts[k] + parts[k + 1] not in self.ranks:
                break
            if len(parts) == 2:
                self.parts[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int, side: int) -> list[int]:
        """The tokens that begin (side 0) or end (1) a token while it is merged, from a single byte up to itself."""
        found = self.spines.get((token, side))
        if found is None:
            found = self.spine(self.parts[token][side], side) if token in self.parts else []
            found = self.spines[token, side] = [*found, token]
        return found

    def parted(self, before: int, token: int) -> bool:
        """Whether no merge joins two neighbours, found along their border.

        Merges go by rank, and a token's rank is above those of its parts.  So two tokens that meet at the border do
        so until the next one of either side is merged, and are joined if that happens earlier: of equal ranks the
        leftmost goes first.
        """
        ends, begins, i, j, never = self.spine(before, 1), self.spine(token, 0), 0, 0, self.never
        while True:
            left = ends[i + 1] if i + 1 < len(ends) else never
            right = begins[j + 1] if j + 1 < len(begins) else never
            joint = self.ranks.get(self.bytes[ends[i]] + self.bytes[begins[j]], never)
            if joint < left and joint <= right and joint < never:
                return False
            if left == right == never:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def stays(self, before: int, token: int) -> bool:
        """Whether the merges leave these two neighbours as they are."""
        if len(self.pairs) >= self.limit:
            self.pairs.clear()
        found = self.parted(before, token) if self.ordered else self.merged(self.bytes[before] + self.bytes[token]) == [before, token]
        self.pairs[before << 32 | token] = found
        return found

    def number(self, guesses: tuple) -> int:
        """A state's number; its last guess is the one that ends a token here, of which there is always one."""
        found = self.numbers.get(guesses)
        if found is None:
            found = self.numbers[guesses] = len(self.guesses)
            self.guesses.append(guesses)
            self.rest.append(guesses[-1][0])
        return found

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after one more byte, and the ids that are certain by now."""
        tree, token_at, goes_on, pairs = self.tree, self.token_at, self.goes_on, self.pairs
        found, ended, least = [], None, self.never
        for guess in self.guesses[state]:
            told, before, node = guess
            node = tree.get(node << 8 | byte)
            if node is None:
                continue
            if goes_on[node]:
                found.append((told, before, node))
                if len(told) < least:
                    least = len(told)
            if ended is None:
                token = token_at[node]
                if token >= 0:
                    stays = True if before < 0 else pairs.get(before << 32 | token)
                    if stays is None:
                        stays = self.stays(before, token)
                    if stays:
                        ended = ((*told, token), token, 0)
        first = ended[0]
        found.append(ended)
        sure = min(least, len(first))
        if sure:
            for told, _, _ in found:
                while told[:sure] != first[:sure]:
                    sure -= 1
            if sure:
                found = [(t[sure:], b, n) for t, b, n in found]
        made = self.steps[state << 8 | byte] = self.number(tuple(found)), first[:sure]
        return made

    def run(self, piece: Iterable[int]) -> list[int]:
        """The ids of a piece, whose bytes may come from a stream."""
        if len(self.guesses) >= self.limit:
            self.forget()
        steps, state, ids = self.steps, self.start, []
        for byte in piece:
            state, sure = steps.get(state << 8 | byte) or self.step(state, byte)
            if sure:
                ids += sure
        ids += self.rest[state]
        return ids

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece; one that spells a token as a whole is that token."""
        return [self.lone[piece]] if piece in self.lone else self.run(piece)


@lru_cache(maxsize=2)
def transducer(ranks: bytes) -> Transducer:
    """One machine for all tasks of a worker: what one has made deterministic serves the next."""
    return Transducer(parsed(ranks))


def follows(lead: int) -> tuple[int, int, int]:
    """How many bytes follow the first byte of a character, and between which two the next one must be.

    Fixed values: the well-formed byte sequences of UTF-8.  -1 for bytes that begin no character.
    """
    if lead < 0x80:
        return 0, 0, 0
    if 0xC2 <= lead <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= lead <= 0xEF:
        return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
    if 0xF0 <= lead <= 0xF4:
        return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
    return -1, 0, 0


class Decoder:
    """Ids in, text out, id by id: a character whose bytes are split between tokens waits for its last byte.

    A state is the beginning of a character, three bytes at most.  What a token does in a state is worked out once.
    Bytes that cannot go on become one U+FFFD for each beginning that was cut off, as is usual.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = {i: t for t, i in ranks.items()}
        self.known: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    @staticmethod
    def advance(held: bytes, more: bytes) -> tuple[str, bytes]:
        """The text that is complete after ``more``, and the beginning of a character that is left."""
        text = []
        for byte in more:
            if held:
                need, low, high = follows(held[0])
                if len(held) > 1:
                    low, high = 0x80, 0xBF
                if low <= byte <= high:
                    held += bytes([byte])
                    if len(held) > need:
                        text.append(held.decode())
                        held = b""
                    continue
                text.append("�")
                held = b""
            need, _, _ = follows(byte)
            if need > 0:
                held = bytes([byte])
            else:
                text.append(chr(byte) if need == 0 else "�")
        return "".join(text), held

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        held, known = b"", self.known
        for token in ids:
            found = known.get((held, token))
            if found is None:
                found = known[held, token] = self.advance(held, self.bytes[token])
            text, held = found
            if text:
                yield text
        if held:
            yield "�"


@lru_cache(maxsize=2)
def decoder(ranks: bytes) -> Decoder:
    return Decoder(parsed(ranks))


def encoder(ranks: bytes, pattern: str) -> Callable[[str], bytes]:
    """Texts in, ids as one binary out."""
    import regex

    split, machine = regex.compile(pattern).finditer, transducer(ranks)
    latest: dict[str, list[int]] = {}
    before: dict[str, list[int]] = {}

    def encode(text: str) -> bytes:
        nonlocal latest, before
        ids: list[int] = []
        parts = []
        for match in split(text):
            piece = match.group()
            found = latest.get(piece)
            if found is None:
                found = before.get(piece)
                if found is None:
                    found = machine.encode(piece.encode())
                if len(piece) <= 64:
                    if len(latest) >= PIECES:
                        latest, before = {}, latest
                    latest[piece] = found
            ids += found
            if len(ids) >= 1 << 20:
                parts.append(np.array(ids, dtype=ID).tobytes())
                ids = []
        return b"".join([*parts, np.array(ids, dtype=ID).tobytes()])

    return encode


@contextmanager
def uncollected() -> Iterator[None]:
    """No collection of cycles meanwhile: a machine has none, and each collection would walk all its states."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def text_from(stream: Callable[[Iterable[int]], Iterator[str]], ids: bytes | None) -> str | None:
    return None if ids is None else "".join(stream(np.frombuffer(ids, dtype=ID).tolist()))


def encode_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id: str = "doc_id", text: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """``id, ids[, text]``: one row per row of ``docs``, its ids as little-endian unsigned 32-bit integers in one binary.

    Every match of ``pattern`` is encoded by itself.  Null and empty texts have no ids.  Special tokens are ordinary
    text.  A text that is no valid UTF-8 counts with U+FFFD in place of what is wrong.  ``decoded`` adds what the ids
    decode to, as :func:`decode_tokens` gives it, without another pass.  Repeated rows and null ids are rows like
    others, other columns are ignored whatever their names, an empty table gives an empty result.
    """
    ranks = read_ranks(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stream = encoder(ranks, pattern), decoder(ranks).stream
        for batch in slices(batches):
            with uncollected():
                ids = [encode(data.decode("utf-8", "replace")) for data in batch.column("text").to_pylist()]
            columns = {"id": batch.column("id"), "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["text"] = pa.array([text_from(stream, i) for i in ids], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id).alias("id"), text_of(text).cast("binary").alias("text"))
    more = [StructField("text", StringType())] if decoded else []
    shape = StructType([StructField("id", docs.schema[id].dataType), StructField("ids", BinaryType()), *more])
    return rows.mapInArrow(each, shape).withColumnRenamed("id", id)


def decode_tokens(tokens: DataFrame, vocabulary: str = VOCABULARY, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``id, ids, text``: rows of ids, as :func:`encode_documents` gives them, with their text.

    Null ids have a null text, no ids an empty one.  Bytes that are no valid UTF-8 become U+FFFD.  An id that the
    vocabulary lacks is an error.
    """
    ranks = read_ranks(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = decoder(ranks).stream
        for batch in slices(batches):
            texts = [text_from(stream, i) for i in batch.column("ids").to_pylist()]
            columns = [batch.column("id"), batch.column("ids"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "text"])

    rows = tokens.select(F.col(id).alias("id"), F.col(ids).alias("ids"))
    shape = StructType([StructField("id", tokens.schema[id].dataType), StructField("ids", BinaryType()), StructField("text", StringType())])
    return rows.mapInArrow(each, shape).select(F.col("id").alias(id), F.col("ids").alias(ids), "text")
