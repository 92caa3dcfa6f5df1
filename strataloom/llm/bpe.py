"""Byte-level BPE encoding by overlapping chunks, and decoding.

Every text is cut into chunks of CHUNK characters that overlap their successor by OVERLAP characters. Each chunk is pre-tokenised and its pieces encoded on its own, from wherever it begins. Texts of up to DEALT
characters are cut and stitched where they are read, so they aren't shuffled; the chunks of a longer one (DEALT characters each) are dealt over the cluster and stitched by one task, which holds two of
them at once. Stitching, in order:

* A boundary between pre-tokens of a chunk is sure if it lies MARGIN or more characters before the chunk's end: no
  alternative of the pattern looks behind, and looks further ahead than a run of one class and then MARGIN characters.
* The pattern has no memory: what follows a boundary depends on the text after it only. Where a sure boundary of the
  stitched stream is a boundary of the next chunk too, both have resynchronised, and the next chunk's pieces count from there on.
* If no boundary is common (one run of letters longer than the overlap), the text from the last sure boundary on is
  pre-tokenised anew, until a boundary of the next chunk is met. Where that finds none either, it is tried again only when the open text has doubled, so a run takes time in proportion to its length.

Pieces are encoded by their ranks, each piece separately: the library is called once for a chunk, and as tokens never cross pieces, the lengths of tokens and pieces tell which belong together. Decoding concatenates the
tokens' raw bytes.

Defined cases: null is as empty, with no tokens; equal rows give equal rows; a surrogate that is no character counts as '?';
an empty table gives no rows; other columns are ignored (digests) or stay (encoded documents). Rows of long texts are told apart by
a row number given when chunks are cut, so equal ids don't meet.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import table

CHUNK, OVERLAP, MARGIN, DEALT = 2048, 128, 4, 1 << 15
CACHE = 100_000


class Codec:
    """Ranks of a .tiktoken file with the pattern that splits texts before the merges."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.merge, self.whole = library._core_bpe.encode_single_piece, library.encode_ordinary
        last = max(self.ranks.values())
        self.bytes_of, self.name_of = [b""] * (last + 1), [str(i) for i in range(last + 1)]
        for b, i in self.ranks.items():
            self.bytes_of[i] = b
        self.size_of = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.cache: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "replace")
            found = self.ranks.get(data)
            ids = [found] if found is not None else self.merge(data)
            if len(piece) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.piece(p)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


class Digest:
    """Digests of ids and of the decoded bytes, fed part by part."""

    def __init__(self, coder: Codec):
        self.coder, self.n, self.ids, self.raw = coder, 0, hashlib.sha256(), hashlib.sha256()

    def feed(self, ids) -> None:
        if len(ids):
            self.ids.update((" " * (self.n > 0) + " ".join(map(self.coder.name_of.__getitem__, ids))).encode())
            self.raw.update(self.coder.decode(ids))
            self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.raw.hexdigest()


def cut(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunk k begins at character k * chunk; every one but the last reaches overlap characters into the next."""
    return [text[at : at + chunk + overlap] for at in range(0, len(text), chunk)] or [""]


class Chunk:
    """A chunk's place in the text, its boundaries (as places in the text), and how many of its ids lie before each."""

    def __init__(self, start: int, text: str, last: bool, ends: np.ndarray, offsets: np.ndarray, ids: list):
        self.start, self.text, self.last, self.ids = start, text, last, ids
        self.bounds = [start, *(ends + start).tolist()]
        self.offsets = [0, *offsets.tolist()]
        self.sure = self.bounds[-1] if last else start + len(text) - MARGIN  # places up to here are sure boundaries if they are boundaries


def encode_chunk(coder: Codec, text: str) -> tuple[np.ndarray, np.ndarray, list]:
    """Where pieces end in the chunk, how many ids lie before each end, and the ids."""
    pieces = coder.pieces(text)
    ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
    ids = coder.whole(text)
    at = ends  # in bytes
    if not text.isascii():
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[ends]
    return ends.astype(np.int32), np.searchsorted(np.cumsum(coder.size_of[ids]), at, side="right").astype(np.int32), ids


def stitch(chunks, coder: Codec):
    """Lists of ids, in order, of a text whose chunks come in order."""
    pos, rest, length, tried = 0, [], 0, 0  # the stream is right up to pos; rest: the text from there to where the last chunk ended, of which so much has been split anew in vain
    for c in chunks:
        at = bisect_left(c.bounds, pos)
        if not (at < len(c.bounds) and c.bounds[at] == pos):
            # not resynchronised at pos: go on from pos by itself until a boundary of this chunk is met
            rest.append(c.text[max(0, pos + length - c.start) :])
            length += len(rest[-1])
            if not c.last and length < 2 * tried:
                continue
            joined, own, base, met = "".join(rest), set(c.bounds), pos, False
            for m in coder.pattern.finditer(joined):
                if not c.last and base + m.end() > c.sure:
                    break
                yield coder.piece(m.group())
                pos = base + m.end()
                if pos in own and pos >= c.start:
                    met = True
                    break
            if not met:
                rest = [joined[pos - base :]]
                length = tried = len(rest[0])
                continue
            at = bisect_left(c.bounds, pos)
        stop = len(c.bounds) - 1 if c.last else max(at, bisect_left(c.bounds, c.sure + 1) - 1)
        if stop > at:
            yield c.ids[c.offsets[at] : c.offsets[stop]]
            pos = c.bounds[stop]
        rest = [c.text[pos - c.start :]]
        length, tried = len(rest[0]), 0


def chunks_of(coder: Codec, text: str, chunk: int, overlap: int):
    parts = cut(text, chunk, overlap)
    for k, part in enumerate(parts):
        yield Chunk(k * chunk, part, k + 1 == len(parts), *encode_chunk(coder, part))


def encoded_digests(docs: DataFrame, vocabulary: tuple[str, str] | None = None, carry: tuple = ("doc_id",), text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, dealt: int = DEALT) -> DataFrame:
    """The carried columns, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    if not overlap >= 2 * MARGIN or not dealt >= chunk > overlap:
        raise ValueError("chunks must be longer than their overlap, and that longer than two margins; dealt chunks no shorter than others")
    path, pattern = vocabulary or default_vocabulary()
    kinds = dict(docs.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    out = f"{head}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = [*carry, "n_tokens", "ids_sha256", "decoded_sha256"]
    n = len(carry)
    rows = docs.select(*carry, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def made(columns, digests):
        return pa.RecordBatch.from_arrays([*columns, pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.string()), pa.array([d[2] for d in digests], pa.string())], names=names)

    def whole(batches):
        coder = codec(path, pattern)
        for batch in batches:
            digests = []
            for t in batch.column(n):
                d = Digest(coder)
                for ids in stitch(chunks_of(coder, t.as_py(), chunk, overlap), coder):
                    d.feed(ids)
                digests.append(d.row())
            yield made(batch.columns[:n], digests)

    def cut_up(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                parts = cut(batch.column(n + 1)[i].as_py(), dealt, overlap)
                for at in range(0, len(parts), 16):
                    some = parts[at : at + 16]
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array([i] * len(some))) for c in batch.columns[: n + 1]), pa.array(range(at, at + len(some)), pa.int32()), pa.array([k + 1 == len(parts) for k in range(at, at + len(some))]), pa.array(some)], names=[*carry, "__row", "__k", "__last", "__text"])

    def encode(batches):
        coder = codec(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):  # a chunk at a time
                found = [pa.array([x], pa.list_(pa.int32())) for x in encode_chunk(coder, batch.column(n + 3)[i].as_py())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *found], names=[*carry, "__row", "__k", "__last", "__text", "__ends", "__offsets", "__ids"])

    def join_up(batches):
        coder = codec(path, pattern)

        def all_chunks():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch, i

        def of_text():
            nonlocal following
            while following is not None:
                batch, i = following
                following = next(stream, None)
                last = batch.column(n + 2)[i].as_py()
                ends, offsets = (batch.column(n + 4 + j)[i].values.to_numpy(zero_copy_only=False) for j in range(2))
                yield Chunk(batch.column(n + 1)[i].as_py() * dealt, batch.column(n + 3)[i].as_py(), last, ends, offsets, batch.column(n + 6)[i].as_py())
                if last:
                    return

        stream = all_chunks()
        following = next(stream, None)
        while following is not None:
            columns = following[0].slice(following[1], 1).columns[:n]
            d = Digest(coder)
            for ids in stitch(of_text(), coder):
                d.feed(ids)
            yield made(columns, [d.row()])

    one = F.length("__text") <= dealt
    short = rows.where(one).mapInArrow(whole, out)
    long = rows.where(~one).select(*carry, F.monotonically_increasing_id().alias("__row"), "__text")
    parts = long.mapInArrow(cut_up, f"{head}, __row long, __k int, __last boolean, __text string").repartition("__row", "__k")
    coded = parts.mapInArrow(encode, f"{head}, __row long, __k int, __last boolean, __text string, __ends array<int>, __offsets array<int>, __ids array<int>")
    return short.union(coded.repartition("__row").sortWithinPartitions("__row", "__k").mapInArrow(join_up, out))


def op10_bpe(spark, sf_dir):
    return encoded_digests(table(spark, sf_dir, "documents"))
