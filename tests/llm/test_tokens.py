from collections import Counter

import numpy as np
import pytest

from cartulary.llm import tokens
from cartulary.llm.scoring import VOCABULARY, Vocabulary, encoder

from .odd import odd, texts


def test_counts_agree_with_the_tokenizer(spark, monkeypatch):
    words = Vocabulary.read(VOCABULARY)
    encode = encoder(words.ranks, words.pattern).encode_ordinary
    found = Counter(map(tuple, tokens.token_counts(odd(spark)).collect()))
    assert found == Counter((i, len(encode(t))) for i, t in texts())
    assert tokens.token_counts(odd(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_of_raw_files_stitches_blocks(spark, tmp_path, block):
    draw = np.random.default_rng(block)
    wanted = Counter()
    for name in ("a", "b", "c"):
        sizes = draw.integers(0, 12, 30).tolist()
        run = [x for n in sizes for x in [*draw.integers(0, 9, n), 9]]
        left = draw.integers(0, 9, 5).tolist() if name == "b" else []
        (tmp_path / f"{name}.bin").write_bytes(np.array(run + left, dtype="<u2").tobytes())
        wanted.update((name, k, n, True) for k, n in enumerate(sizes))
        wanted.update([(name, len(sizes), 5, False)] if left else [])
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = tokens.read_token_files(spark, str(tmp_path), block)
    rows = tokens.scan(blocks, 9).collect()
    assert Counter((r["file"].split("/")[-1][0], r["document"], r["n_tokens"], r["complete"]) for r in rows) == wanted
