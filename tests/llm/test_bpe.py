import hashlib
import random

import numpy as np
import pytest
import tiktoken

from cartulary.llm import bpe, queries

from .odd import odd, texts

RANKS = bpe.parsed(bpe.read_ranks(bpe.VOCABULARY))
TRUE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABETS = ["ab", "a ", "  \n\t", "aeiourstn ", "éèçÉ a", "日本語の a", "😀🏳️‍🌈 x", "=-=_/", "'sre tve", "".join(map(chr, range(32, 0x250)))]


@pytest.fixture(scope="module")
def machine():
    return bpe.transducer(bpe.read_ranks(bpe.VOCABULARY))


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_pieces_are_cut_as_the_merges_cut_them(machine, alphabet):
    draw = random.Random(alphabet)
    for _ in range(200):
        piece = "".join(draw.choices(alphabet, k=draw.randint(1, 30))).encode()
        # the library's own merging of one piece, whatever its characters
        assert machine.encode(piece) == TRUE._encode_single_piece(piece)


def test_long_pieces_and_few_remembered_states(machine):
    small = bpe.Transducer(RANKS, states=50)
    for piece in (b" " * 5000, b"a" * 5000, b"ab" * 3000, b"=" * 999, bytes(range(256)) * 3):
        assert machine.encode(piece) == small.encode(piece) == TRUE._encode_single_piece(piece)
    # what waits for more bytes is bounded by the longest token
    assert max(len(told) for state in machine.guesses for told, _, _ in state) <= max(map(len, RANKS))


def test_tokens_out_of_reach_stand_for_whole_pieces_only():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"xyz": 301}
    machine, true = bpe.Transducer(ranks), tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for piece in (b"xyz", b"xyzxyz", b"abc", b"abcxyz", b"bcbc", b"abab"):
        assert machine.encode(piece) == true.encode_ordinary(piece.decode())
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 0})


def test_streaming_decoder_is_the_usual_one():
    draw, decoder = random.Random(3), bpe.Decoder(RANKS)
    lead = [0x61, 0x80, 0xBF, 0xC1, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE2]
    for _ in range(3000):
        data = bytes(draw.choices(lead, k=draw.randint(0, 9)))
        assert "".join(decoder.stream(RANKS[bytes([b])] for b in data)) == data.decode("utf-8", "replace")


def test_odd_documents_round_trip(spark):
    found = bpe.decode_tokens(bpe.encode_documents(odd(spark))).collect()
    wanted = [(i, np.array(TRUE.encode_ordinary(t), dtype="<u4").tobytes(), t) for i, t in texts()]
    assert sorted(((r[0], bytes(r[1]), r[2]) for r in found), key=str) == sorted(wanted, key=str)
    once = bpe.encode_documents(odd(spark), decoded=True).collect()
    assert sorted(map(str, once)) == sorted(map(str, found))
    assert bpe.decode_tokens(bpe.encode_documents(odd(spark, []))).count() == 0


def test_query(spark, small):
    found = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, small).collect()}
    rows = queries.table(spark, small, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(found)
    for doc_id, text in rows:
        ids, r = TRUE.encode_ordinary(text or ""), found[doc_id]
        code = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), code)
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
