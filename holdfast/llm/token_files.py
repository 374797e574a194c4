"""Token-id shards with Elias-Fano document boundaries.

A shard is one binary file, all numbers little-endian:

    magic ``HFTOK001`` | n_docs, n_ids, low_bits, n_high_bits, id_width, n_samples  (6 x uint64)
    low parts   n_docs values of low_bits bits each, padded to whole bytes
    high parts  unary-coded upper halves, one set bit a document, padded to whole bytes
    samples     bit position of every 256th set bit (uint64 each), for select
    ids         the concatenated id array, uint16 if every id fits, else uint32

Document i ends at ``select(i)``: the value at rank i of the monotone sequence of end offsets.
Elias-Fano needs 2 + log2(n_ids / n_docs) bits a document, against 64 for an offset table.

Defined results: a null text is empty and holds only the end id; rows with a null id sort first;
rows that share an id all get their own entry, ordered by a hash of their text; an empty table
writes no shard.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, encoder, lean, new_path, spill

MAGIC = b"HFTOK001"
SAMPLE = 256
#: Text bytes that one shard takes.
SHARD_BYTES = 32 << 20


class EliasFano:
    """A monotone sequence of n values below ``top`` with select by rank."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), at[::SAMPLE].astype("<u8"))

    def select(self, rank: int) -> int:
        """The value at ``rank``, from the nearest sample on."""
        place = int(self.samples[rank // SAMPLE])
        left = rank % SAMPLE
        byte = place >> 3
        ones = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        ones[: place & 7] = 0
        while True:
            found = np.flatnonzero(ones)
            if left < len(found):
                place = byte * 8 + int(found[left])
                break
            left -= len(found)
            byte += len(ones) >> 3
            ones = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        value = place - rank
        first = rank * self.low_bits
        part = np.unpackbits(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], bitorder="little")
        part = part[first & 7 : (first & 7) + self.low_bits].astype(np.uint64)
        return (value << self.low_bits) | int((part << np.arange(self.low_bits, dtype=np.uint64)).sum())

    def select_run(self, first: int, last: int) -> np.ndarray:
        """The values at ranks ``first`` to ``last``, from the sample before the one to the sample after the other."""
        begin = int(self.samples[first // SAMPLE])
        after = last // SAMPLE + 1
        end = int(self.samples[after]) + 1 if after < len(self.samples) else len(self.high) * 8
        ones = np.unpackbits(self.high[begin >> 3 : (end + 7) >> 3], bitorder="little")
        ones[: begin & 7] = 0
        ranks = np.arange(first, last + 1)
        place = np.flatnonzero(ones)[first % SAMPLE :][: len(ranks)] + (begin & ~7)
        at = first * self.low_bits
        bits = np.unpackbits(self.low[at >> 3 : ((last + 1) * self.low_bits + 7) >> 3], bitorder="little")
        bits = bits[at & 7 :][: len(ranks) * self.low_bits].reshape(len(ranks), self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (place - ranks).astype(np.uint64) << np.uint64(self.low_bits) | low


def dump_shard(ends: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a shard file; ``ends`` holds each document's end offset."""
    ef = EliasFano.build(ends)
    kind = "<u2" if len(ids) == 0 or int(ids.max()) < 1 << 16 else "<u4"
    head = np.array([ef.n, len(ids), ef.low_bits, len(ef.high), int(kind[-1]), len(ef.samples)], dtype="<u8")
    return [MAGIC, head.tobytes(), ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), ids.astype(kind).tobytes()]


class Shard:
    """A shard file opened for reading; ids are a view of the file's bytes."""

    def __init__(self, data: bytes | memoryview) -> None:
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token shard")
        n, n_ids, low_bits, n_high, width, n_samples = (int(x) for x in np.frombuffer(data[8:56], dtype="<u8"))
        at = 56
        low = np.frombuffer(data[at : (at := at + (n * low_bits + 7) // 8)], dtype=np.uint8)
        high = np.frombuffer(data[at : (at := at + n_high)], dtype=np.uint8)
        samples = np.frombuffer(data[at : (at := at + 8 * n_samples)], dtype="<u8")
        self.bounds = EliasFano(n, low_bits, low, high, samples)
        self.ids = np.frombuffer(data[at : at + n_ids * width], dtype=f"<u{width}")

    def __len__(self) -> int:
        return self.bounds.n

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i - 1) if i else 0 : self.bounds.select(i)]


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_token_files(
    docs: DataFrame, out_dir: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Write shards in ascending id order; return the index: shard, file, place, id, n_docs, n_ids.

    The index has one row a document, with its place in its shard.  Files appear under their final
    name by a rename, so a task that runs twice leaves one whole file.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    parts = max(1, -(-size // shard_bytes))
    key = F.xxhash64("text")
    rows = rows.withColumn("tie", key).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        ids, names, sizes, most = [], [], [], 0
        for batch in batches:
            names.append(batch.column(0))
            for start in range(0, batch.num_rows, 2048):
                for raw in enc.encode(batch.column(1).slice(start, 2048).to_pylist()):
                    a = np.frombuffer(raw + end, dtype="<u4")
                    sizes.append(len(a))
                    most = max(most, int(a.max()))
                    ids.append(a.astype("<u2") if most < 1 << 16 else a)
        if not sizes:
            return
        context = TaskContext.get()
        shard = context.partitionId()
        ids = np.concatenate(ids)
        fs, folder = _file_system(out_dir)
        fs.create_dir(folder, recursive=True)
        name = f"shard-{shard:08d}.hftok"
        temporary = f"{folder}/_{name}.{context.taskAttemptId()}"
        with fs.open_output_stream(temporary) as f:
            for part in dump_shard(np.cumsum(sizes), ids):
                f.write(part)
        fs.move(temporary, f"{folder}/{name}")
        n, n_ids = len(sizes), len(ids)
        del ids
        at = 0
        for column in names:
            k = len(column)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, shard, dtype=np.int64)), pa.array(np.arange(at, at + k)), column, pa.array(np.full(k, n, dtype=np.int64)), pa.array(np.full(k, n_ids, dtype=np.int64))],
                names=["shard", "place", "doc_id", "n_docs", "n_ids"],
            )
            at += k

    kind = rows.schema["doc_id"].dataType.simpleString()
    index, _ = spill(rows.mapInArrow(lean(write, keeps=True), f"shard long, place long, doc_id {kind}, n_docs long, n_ids long"), "token-index")
    return index


def read_token_files(index: DataFrame, out_dir: str) -> DataFrame:
    """Read shards back: doc_id, start (in the whole corpus), n_tokens and the ids of each document.

    ``ids`` holds unsigned 32-bit little-endian integers.  Boundaries come from select, for a run
    of documents at a time; a shard's base is a running sum over one row a shard, joined back.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.filter("place = 0").select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _file_system(out_dir)
        opened, shard = None, None
        for batch in batches:
            which, places, bases_ = (batch.column(i).to_numpy() for i in range(3))
            runs = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (places[1:] != places[:-1] + 1)]))
            cuts = np.union1d(runs, np.arange(0, len(which), 512))
            for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(which)], strict=True):
                if which[begin] != opened:
                    opened = int(which[begin])
                    with fs.open_input_file(f"{folder}/shard-{opened:08d}.hftok") as f:
                        shard = Shard(f.read_buffer())
                first = int(places[begin])
                ends = shard.bounds.select_run(max(first - 1, 0), first + end - begin - 1).astype(np.int64)
                edges = (ends if first else np.concatenate([[0], ends])).tolist()
                ids = [shard.ids[a:b].astype("<u4").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                starts, sizes = np.array(edges[:-1]) + bases_[begin], np.diff(edges)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(3).slice(begin, end - begin), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.large_binary() if sum(map(len, ids)) >> 31 else pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    kind = index.schema["doc_id"].dataType.simpleString()
    rows = index.join(bases, "shard").select("shard", "place", "base", "doc_id").sortWithinPartitions("shard", "place")
    return rows.mapInArrow(lean(read), f"doc_id {kind}, start long, n_tokens long, ids binary")


def op5(spark, sf_dir: str) -> DataFrame:
    """Encode, write, read back and digest every document; see the module's docstring."""
    import public_tokenizers

    out = new_path(spark, "token-files")
    index = write_token_files(documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"))
    back = read_token_files(index, out)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


