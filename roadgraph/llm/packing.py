"""Sequence packing: bounded-space online best-fit over token pieces.

Tokenising runs where the documents are and leaves narrow rows (id, piece, start, length, checksum); texts are
never shuffled. The byte-level vocabulary splits a text at every single blank between two other characters, so
ids are looked up by blank-separated chunk, and only chunks not seen before go through the tokenizer, in batches.

Pieces are dealt by hash of id and place into parts of bounded size. In each part they arrive in hash order and go into the
open bin with the least free space that still holds them. A bit set keyed by free space finds that bin. When
all bins are open and none fits, the fullest closes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_parts, small_batches, stored, text_of

SEQUENCE = 2048
#: Bins that a part keeps open.
OPEN_BINS = 1024
#: Pieces that a part packs.
PART_PIECES = 200_000
#: Chunks that a Python worker remembers, and the longest of them: at most about 150 MB.
CACHE = 500_000
LONGEST = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_state: dict = {}


def _encoder(vocabulary: str):
    """How this worker turns chunks into ids, and its memory of chunks.

    Where the vocabulary also comes as a table of ranks, that is read: it gives the same ids several times faster.
    Strings of the vocabulary's added tokens in a text become those tokens, as the vocabulary's own reader has it.
    """
    if _state.get("name") != vocabulary:
        import json
        import os

        import public_tokenizers

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            with open(path, encoding="utf-8") as f:
                added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
            reader = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
            many = lambda xs: (reader.encode(x, allowed_special="all") for x in xs)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            many = lambda xs: (e.ids for e in tok.encode_batch(xs, add_special_tokens=False))
        _state.update(name=vocabulary, many=many, seen={})
    return _state["many"], _state["seen"]


def _packed(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def token_bytes(texts: list[str], vocabulary: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    many, seen = _encoder(vocabulary)
    if len(seen) > CACHE:
        seen.clear()
    cut = []
    new: dict[str, bytes] = {}
    whole: list[int] = []
    for i, x in enumerate(texts):
        # the first chunk has no blank before it; a chunk that is empty or has blanks at an end is not safe to cut
        parts = x.split(" ")
        parts[1:] = [" " + p for p in parts[1:]]
        cut.append(parts)
        for p in parts:
            if p not in seen and p not in new:
                bare = p[1:] if p[:1] == " " else p
                if bare and not bare[0].isspace() and not bare[-1].isspace():
                    new[p] = b""
                else:
                    cut[i] = None
                    whole.append(i)
                    break
    todo = list(new)
    for at in range(0, len(todo), 10_000):
        some = todo[at : at + 10_000]
        for p, ids in zip(some, many(some), strict=True):
            new[p] = _packed(ids)
    out = [b"".join(seen.get(p) or new[p] for p in c) if c is not None else b"" for c in cut]
    for i, ids in zip(whole, many([texts[i] for i in whole]), strict=True):
        out[i] = _packed(ids)
    seen.update((p, ids) for p, ids in new.items() if len(p) <= LONGEST)
    return out


def _pieces(vocabulary: str, end_id: int, size: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, data in zip(b.column(0).to_pylist(), token_bytes(b.column(1).to_pylist(), vocabulary), strict=True):
                data += end
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    upto = at + ((n - 1) % size + 1 if k == 0 else size)  # the first piece takes the rest
                    ids.append(doc)
                    piece.append(k)
                    start.append(at)
                    length.append(upto - at)
                    crc.append(zlib.crc32(data[4 * at : 4 * upto]))
                    at, k = upto, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


class BestFit:
    """Online best-fit with a bounded number of open bins.

    free is a bit set: bit f is set while an open bin has f places left. The least set bit at or above an
    item's length is its best fit; the least set bit of all belongs to the fullest bin.
    """

    def __init__(self, size: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.size, self.most = size, open_bins
        self.free, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, f: int) -> int:
        own = self.bins[f]
        bin_ = own.pop()
        if not own:
            self.free &= ~(1 << f)
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item of 1 to size places."""
        above = self.free >> length
        if above:
            f = length + (above & -above).bit_length() - 1
            bin_ = self._take(f)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            bin_, f = self.made, self.size
            self.made += 1
            self.open += 1
        left = f - length
        if left:
            self.bins[left].append(bin_)
            self.free |= 1 << left
        else:
            self.open -= 1
        return bin_, self.size - f


def _pack(size: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(size, open_bins)
        base = TaskContext.get().partitionId() << 32
        for b in batches:
            put = [fit.put(n) for n in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([base + x for x, _ in put], pa.int64()), pa.array([y for _, y in put], pa.int64())],
                names=[*b.schema.names, "sequence_id", "offset"],
            )

    return run


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Every document ends with end_id."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return src.mapInArrow(_pieces(vocabulary, end_id, size), PIECES)


def pack(pieces: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS, part_pieces: int = PART_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces, a stored table. Sequence ids are unique, not gapless.

    Pieces are dealt by their place in the table as well, so rows with null or repeated ids do not fill one part."""
    parts = row_parts(pieces.count(), part_pieces)
    order = F.xxhash64("doc_id", "piece")
    placed = pieces.withColumn("place", F.monotonically_increasing_id())
    dealt = placed.repartition(parts, F.xxhash64("doc_id", "piece", "place")).drop("place").sortWithinPartitions(order, "doc_id", "piece", "start", "length", "ids_crc32")
    return dealt.mapInArrow(_pack(size, open_bins), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises docs, cuts what is longer than size and packs all pieces.

    Null text counts as empty: one piece with only end_id. A longer document is cut into pieces of size
    tokens, the first taking what is left over. Repeated rows, rows that repeat an id and rows with null ids are packed
    one by one. Ids are cast to long; text that is no number raises an error in ANSI mode. Other columns are ignored.
    An empty table gives an empty result.
    """
    return pack(stored(token_pieces(docs, vocabulary, end_id, size, id_col, text_col), "pieces"), size)
