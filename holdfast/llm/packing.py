"""Harmonic packing of token sequences.

Class j holds the pieces of more than capacity/(j+1) and at most capacity/j tokens; a bin of class
j takes exactly j pieces.  Every worker keeps one open bin a class and closes it when it has its j
pieces, so no worker waits for another and each holds less than one bin a class.

A document is cut before it is classed, where the method itself leaves least padding: whole
sequences first, then powers of two down to ``grain`` (each is exactly capacity/j long, so its
class leaves nothing), then a tail of at most ``grain`` tokens.  The bins still open at a worker's
end are merged, longest piece first.  Only bins with tails and the last bin of a worker have
padding.

Defined results: a null text is an empty document, which has its end id alone; a null or repeated
id is packed row by row; an empty table gives no piece.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, encoder, lean

CAPACITY = 2048
GRAIN = 32


def cuts(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """The lengths of a document's pieces in order, for a capacity that is a power of two."""
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    if rest:
        tail = (rest - 1) % grain + 1
        rest -= tail
        out += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        out.append(tail)
    return out


class Bins:
    """The open bins of one worker."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: dict[int, list] = {}

    def add(self, piece: tuple) -> list | None:
        """Put a piece ``(length, ...)`` in its class; the bin's pieces if that fills it."""
        j = self.capacity // piece[0]
        bin_ = self.open.setdefault(j, [])
        bin_.append(piece)
        if len(bin_) == j:
            del self.open[j]
            return bin_
        return None

    def close(self) -> Iterator[list]:
        """Merge the bins that are still open, first fit by falling length."""
        pieces = sorted((p for b in self.open.values() for p in b), key=lambda p: -p[0])
        bins: list[list] = []
        room: list[int] = []
        for p in pieces:
            k = next((k for k, r in enumerate(room) if r >= p[0]), None)
            if k is None:
                bins.append([])
                room.append(self.capacity)
                k = len(bins) - 1
            bins[k].append(p)
            room[k] -= p[0]
        self.open.clear()
        yield from bins


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ids.

    ``ids`` holds unsigned 32-bit little-endian integers.  A sequence lies in one partition; its
    id is the partition's number times 2**32 plus the sequence's number there.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        bins, number = Bins(capacity), TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def place(bin_: list) -> None:
            nonlocal number
            at = 0
            for length, name, start, total, raw in bin_:
                out.append((name, start, length, total, number, at, raw))
                at += length
            number += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            names = batch.column(0).to_pylist()
            for begin in range(0, batch.num_rows, 2048):
                texts = batch.column(1).slice(begin, 2048).to_pylist()
                for name, raw in zip(names[begin : begin + 2048], enc.encode(texts), strict=True):
                    raw += end
                    total, start = len(raw) // 4, 0
                    for length in cuts(total, capacity, grain):
                        full = bins.add((length, name, start, total, raw[start * 4 : (start + length) * 4]))
                        start += length
                        if full:
                            place(full)
                        if len(out) >= 8192:
                            yield flush()
        for bin_ in bins.close():
            place(bin_)
        if out:
            yield flush()

    return rows.mapInArrow(lean(run, keeps=True), f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op6(spark, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of 2048 tokens."""
    import public_tokenizers

    return digest(pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
