"""Merges learnt where the words lie are those that the driver learns."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strataloom.operators import bpe


def in_rounds(words, size):
    batch = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
    kept = [[np.frombuffer(b.column(k)[0].as_py(), t) for k, t in ((0, "<u2"), (1, np.int64))] for b in bpe._blocks("<u2")([batch])]
    rounds = []

    def advance(joins):
        out = []
        for block in kept:
            block[0], keys, n = bpe.merged_block(*block, joins)
            out += [(int(k) >> 32, int(k) & 0xFFFFFFFF, int(x)) for k, x in zip(keys, n)]
        rounds.append(joins)
        return out

    return bpe.learn_in_rounds(advance, size, ["<x>"]), rounds


@pytest.mark.parametrize("seed", range(40))
def test_rounds_merge_as_one_by_one(seed, monkeypatch):
    """Few letters and small counts: runs of one symbol, ties, and joints that are symbols already."""
    r = random.Random(seed)
    monkeypatch.setattr(bpe, "BLOCK", r.choice([1, 50, 1 << 20]))
    letters = "ab" if seed % 4 == 0 else "abc é" if seed % 4 == 1 else "abcdefghijklmnopqrstuvwxyz"
    words = {"".join(r.choices(letters, k=r.randint(1, 12))).encode(): r.choice([1, 1, 2, 3, 50]) for _ in range(r.choice([3, 40, 300]))}
    got, rounds = in_rounds(words, 256 + r.choice([1, 7, 60, 500]))
    want = bpe.learn_merges(words.items(), len(got.vocab), ["<x>"])
    assert got.merges == want.merges and got.vocab == want.vocab
    if seed % 4 > 1 and len(words) > 200 and len(got.merges) > 50:
        assert len(rounds) < len(got.merges) * 0.8


def test_many_words_stay_with_the_executors(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choices("etaoinü'3", k=r.randint(1, 9))) for _ in range(60)), "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s string")
    want = bpe.train(docs, 420)
    monkeypatch.setattr(bpe, "DRIVER_WORDS", 10)
    monkeypatch.setattr(bpe, "learn_merges", lambda *_: pytest.fail("the words came to the driver"))
    got = bpe.train(docs, 420)
    assert got.merges == want.merges and got.vocab == want.vocab and len(got.merges) == 163
