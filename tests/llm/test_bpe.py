import os
import random

import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

from framewise.llm import bpe  # noqa: E402

PIECES = [" ", "  ", "\n", "\n\n", "\t", " \n", "a", "bc", "the", "'s", "'re", "'", "...", "!", "12", "é", "ñ", "中文", " ", "\x1c", "\x85", "<|endoftext|>", "😀", "don't", "X" * 50, " " * 30, "́", "٣", "ǅ"]


@pytest.fixture(scope="module")
def both():
    path = bpe.default_path()
    return bpe.Codec(path), Tokenizer.from_file(path)


@pytest.mark.parametrize("least,most,mask", [(4, 64, 7), (16, 128, 15), (256, 8192, 1023)])
def test_same_ids(both, least, most, mask, monkeypatch):
    own, lib = both
    for name, v in (("LEAST", least), ("MOST", most), ("MASK", mask)):
        monkeypatch.setattr(bpe, name, v)
    rng = random.Random(least)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 150)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_chunks_are_shared(both):
    own, _ = both
    rng = random.Random(1)
    shared = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(6000))
    own.encode("first " * 50 + shared)
    hits = own.hits
    own.encode("another beginning " * 90 + shared)
    assert own.hits > hits


def test_op7(spark, docs, odd, empty, both):
    _, lib = both
    import hashlib

    import numpy as np

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.op7(spark, docs).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.op7(spark, odd).where("round_trip").count() == odd.count() and bpe.op7(spark, empty).count() == 0
    out = bpe.encode(odd, bpe.default_path())
    assert out.columns == [*odd.columns, "ids", "round_trip"] and out.count() == odd.count()
