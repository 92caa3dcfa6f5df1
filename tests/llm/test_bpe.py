import hashlib
import random

import pytest
import tiktoken

from strataloom.llm import bpe
from tests.llm import helpers

PIECES = ["a", "the ", "  ", "\n", "\n\n", "'", "'re", "'ll ", "1", "23", "é", " ", "!", "!!!", "\t", "字", "x" * 40, "  \n  ", " " * 30, "'" * 9, "日本", " ", " ", "<|endoftext|>", "😀"]


@pytest.fixture(scope="module")
def coder():
    return bpe.codec(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=coder.ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(20, 8), (50, 16), (100, 64)])
def test_stitched_chunks_are_as_one_text(coder, library, chunk, overlap):
    rnd = random.Random(chunk)
    for _ in range(600):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(90)))
        ids = [i for some in bpe.stitch(bpe.chunks_of(coder, text, chunk, overlap), coder) for i in some]
        assert ids == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("chunk,overlap,dealt", [(bpe.CHUNK, bpe.OVERLAP, bpe.DEALT), (200, 32, 500), (100, 64, 100)])
def test_table_is_encoded_as_the_library_would(spark, library, chunk, overlap, dealt):
    got = bpe.encoded_digests(helpers.table(spark), chunk=chunk, overlap=overlap, dealt=dealt).collect()
    want = []
    for i, t, *_ in helpers.rows():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_run_longer_than_any_chunk(coder, library):
    text = "ab " + "q" * 5000 + " end of it, " + "é" * 700 + "1" * 900 + " " * 800 + "x"
    assert [i for some in bpe.stitch(bpe.chunks_of(coder, text, 100, 20), coder) for i in some] == library.encode_ordinary(text)


def test_a_run_takes_time_in_proportion(coder, monkeypatch):
    scanned = []

    class Counting:
        def finditer(self, text):
            scanned.append(len(text))
            return real.finditer(text)

    real = coder.pattern
    monkeypatch.setattr(coder, "pattern", Counting())
    monkeypatch.setattr(coder, "piece", lambda piece: [len(piece)])
    for n in (100_000, 400_000):
        parts = bpe.cut("q" * n, 1000, 100)
        chunks = (bpe.Chunk(k * 1000, p, k + 1 == len(parts), bpe.np.array([len(p)]), bpe.np.array([1]), [0]) for k, p in enumerate(parts))
        scanned.clear()
        assert [i for some in bpe.stitch(chunks, coder) for i in some] == [n] and sum(scanned) < 4 * n


def test_no_rows_and_wrong_sizes(spark):
    assert bpe.encoded_digests(helpers.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        bpe.encoded_digests(helpers.empty(spark), chunk=10, overlap=20)
    with pytest.raises(ValueError):
        bpe.encoded_digests(helpers.empty(spark), chunk=1000, overlap=20, dealt=999)
