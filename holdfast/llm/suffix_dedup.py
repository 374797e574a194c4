"""Removal of repeated byte strings by a prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus,
the same text included.  Not every suffix is needed to find these strings.  Every start p owns an
anchor, the place x of the least 16-byte hash among the ``SPAN`` places from p on; equal strings
have their anchors at equal distances.  So the suffixes from the anchors are sorted, each standing
for the starts s..e that own it (a strip: the bytes from s to e + length).  Anchors whose next
``length - SPAN + 1`` bytes hash to a value met once can't be in a repeated string and are left
out by an exact count; what is left is compared byte by byte.

Sorted runs are made on each worker (equal strips are one entry with a count), cut at splitters
that come from a bounded sample, sent as front-coded blocks (the length shared with the entry
before, then the rest), and merged by range in a loser tree that keeps for every run the prefix it
shares with the last output: entries are compared from there on only, and not at all where the
shared lengths differ.  In the merged order, strips with a common prefix lie together, and a start
is repeated if another strip of that group agrees to the left and to the right of the anchor.

Defined results: null text is empty (nothing removed, the digest of no bytes); a null id is kept;
repeated rows are texts of their own, so both lose what they share; an empty table gives no row.
Further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_table, documents, free, keyed, lean, remove, ROW, spill

LENGTH = 400
#: Starts among whose places the anchor is the least; a power of two.
SPAN = 256
GRAM = 16
#: Bytes of strips in one sorted run, entries in one block, bytes of blocks for one range.
RUN_BYTES = 48 << 20
BLOCK = 512
RANGE_BYTES = 12 << 20
#: Block heads that the splitters are taken from.
SAMPLE = 20_000
HEAD = 64


def _words8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    w = buf.astype(np.uint64)
    for step in (1, 2, 4):
        w = w[:-step] | (w[step:] << np.uint64(8 * step))
    return w


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(buf: np.ndarray, ok: np.ndarray, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, first and last start that own each, and the hash of the bytes all of them share.

    ``ok[p]`` says that the string from p on lies in one text.
    """
    starts = np.flatnonzero(ok)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    w = _words8(buf)
    h = _stir(w[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ _stir(w[8:] + np.uint64(0x632BE59BD9B4E019)))
    place = np.uint64(28)
    least = ((h >> place) << place) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step < span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    own = (least[starts] & np.uint64((1 << 28) - 1)).astype(np.int64)
    edge = np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(edge)
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    x = own[first]
    core = length - span + 1
    value = np.full(len(x), core, dtype=np.uint64)
    for at in [*range(0, core - 8, 8), core - 8]:
        value = _stir((value ^ w[x + at]) * np.uint64(0xBF58476D1CE4E5B9))
    return x, starts[first], starts[last], value.view(np.int64)


def _slabs(texts: list[bytes], length: int, size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end in bounded buffers: bytes, allowed starts, owner and place of each byte's text."""
    held, parts = 0, []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), size):
            if len(t) < length:
                continue
            piece = t[at : at + size + length - 1]
            parts.append((i, at, piece))
            held += len(piece)
            if held >= size:
                yield _slab(parts, length)
                held, parts = 0, []
    if parts:
        yield _slab(parts, length)


def _slab(parts: list, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p[2]) for p in parts])
    buf = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(buf))
    return buf, left >= length, np.cumsum(sizes) - sizes, np.array([(p[0], p[1]) for p in parts])


def find_anchors(rows: DataFrame, length: int, span: int) -> DataFrame:
    """One row an anchor: row key, place x, first and last start, hash of the shared bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for buf, ok, offsets, whose in _slabs(texts, length):
                x, s, e, value = anchors(buf, ok, length, span)
                part = np.searchsorted(offsets, x, side="right") - 1
                shift = whose[part, 1] - offsets[part]
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, dtype=np.int64)
                edges = pa.array(np.concatenate([cut, [len(part)]]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(a)) for a in (x + shift, s + shift, e + shift, value)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose[part[cut], 0])), *lists], names=[ROW, "x", "s", "e", "core"])

    kind = rows.schema[ROW].dataType.simpleString()
    found = rows.select(ROW, "text").mapInArrow(lean(run), f"{ROW} {kind}, x array<long>, s array<long>, e array<long>, core array<long>")
    return found.select(ROW, F.explode(F.arrays_zip("x", "s", "e", "core")).alias("a")).select(ROW, "a.*")


def shared_lengths(strings: list[bytes]) -> np.ndarray:
    """The length of the prefix that each string shares with the one before."""
    n = len(strings)
    out = np.zeros(n, dtype=np.int64)
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=n)
    width = int(sizes.max()) if n else 0
    for a in range(0, n, 16384):
        part = strings[max(0, a - 1) : a + 16384]
        grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in part), dtype=np.uint8).reshape(len(part), width)
        differ = grid[1:] != grid[:-1]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lo = max(0, a - 1) + 1
        out[lo : lo + len(at)] = np.minimum(at, np.minimum(sizes[lo : lo + len(at)], sizes[lo - 1 : lo - 1 + len(at)]))
    return out


def pack_block(entries: list[tuple], first: int) -> bytes:
    """Front-coded block of sorted (right, left, low, high, count) entries; ``first`` numbers them."""
    rights = [e[0] for e in entries]
    shared = shared_lengths(rights)
    tails = [r[k:] for r, k in zip(rights, shared.tolist(), strict=True)]
    table = np.array([(k, len(t), len(e[1]), e[2], e[3], min(e[4], 2)) for k, t, e in zip(shared.tolist(), tails, entries, strict=True)], dtype="<u2")
    return np.array([len(entries), first], dtype="<u8").tobytes() + table.tobytes() + b"".join(tails) + b"".join(e[1] for e in entries)


def open_block(raw: bytes) -> list[tuple]:
    """(right, left, low, high, count, number, shared) of each entry of a block."""
    n, first = (int(v) for v in np.frombuffer(raw[:16], dtype="<u8"))
    table = np.frombuffer(raw[16 : 16 + 12 * n], dtype="<u2").reshape(n, 6).tolist()
    at, out, before = 16 + 12 * n, [], b""
    left_at = at + sum(row[1] for row in table)
    for i, (k, size, left, low, high, count) in enumerate(table):
        before = before[:k] + raw[at : at + size]
        at += size
        out.append((before, raw[left_at : left_at + left], low, high, count, first + i, k))
        left_at += left
    return out


def _common(a: bytes, b: bytes, at: int) -> int:
    """The shared prefix of two strings that share ``at`` bytes already."""
    end = min(len(a), len(b))
    step = 32
    while at < end and a[at : at + step] == b[at : at + step]:
        at = min(at + step, end)
        step *= 2
    while step > 1:
        step >>= 1
        if a[at : at + step] == b[at : at + step]:
            at = min(at + step, end)
    return min(at, end)


class LoserTree:
    """Merge of sorted, front-coded runs that never compares a known shared prefix again.

    ``shared[r]`` is the prefix that the head of run r has in common with the last output.  Of two
    heads the one that shares more is smaller; only equal shares are compared, from there on.
    """

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.shared = [0] * len(runs)
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.losers = [-1] * self.size
        self.top = self._build(1)

    def _head(self, r: int) -> bytes | None:
        return self.runs[r][self.at[r]][0] if 0 <= r < len(self.runs) and self.at[r] < len(self.runs[r]) else None

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, self.losers[node] = self._play(a, b)
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self._head(a), self._head(b)
        if y is None or x is None:
            return (a, b) if y is None else (b, a)
        if self.shared[a] != self.shared[b]:
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        k = _common(x, y, self.shared[a])
        if x[k : k + 1] <= y[k : k + 1]:
            self.shared[b] = k
            return a, b
        self.shared[a] = k
        return b, a

    def __iter__(self) -> Iterator[tuple[int, tuple, int]]:
        """(run, entry, prefix shared with the output before)."""
        while self._head(self.top) is not None:
            r = self.top
            entry = self.runs[r][self.at[r]]
            yield r, entry, self.shared[r]
            self.at[r] += 1
            # The next head's share with this output is its front-coded length.
            self.shared[r] = self.runs[r][self.at[r]][6] if self.at[r] < len(self.runs[r]) else 0
            node, winner = (r + self.size) // 2, r
            while node:
                winner, self.losers[node] = self._play(winner, self.losers[node])
                node //= 2
            self.top = winner


def _common_end(a: bytes, b: bytes) -> int:
    return _common(a[::-1], b[::-1], 0)


def repeated_starts(group: list[tuple[bytes, bytes, int, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each distinct (right, left, low, high, count): ranges of distances whose string is repeated.

    Distance o means the start o bytes before the anchor: its string is the last o bytes of left
    and the first length - o of right.
    """
    out: list[list[tuple[int, int]]] = []
    if len(group) <= 6:
        for i, (right, left, low, high, count) in enumerate(group):
            found = [(low, high)] if count > 1 else []
            for j, (right2, left2, low2, high2, _) in enumerate(group):
                if i != j and count == 1:
                    a = max(low, low2, length - _common(right, right2, 0))
                    b = min(high, high2, _common_end(left, left2))
                    if a <= b:
                        found.append((a, b))
            out.append(found)
        return out
    seen: list[dict] = [defaultdict(int) for _ in range(max(e[3] for e in group) + 1)]
    for right, left, low, high, count in group:
        size = len(left)
        for o in range(low, high + 1):
            seen[o][left[size - o :] + right[: length - o]] += count
    for right, left, low, high, count in group:
        if count > 1:
            out.append([(low, high)])
            continue
        size = len(left)
        hit = [o for o in range(low, high + 1) if seen[o][left[size - o :] + right[: length - o]] > 1]
        found, a = [], None
        for i, o in enumerate(hit):
            a = o if a is None else a
            if i + 1 == len(hit) or hit[i + 1] != o + 1:
                found.append((a, o))
                a = None
        out.append(found)
    return out


def merged(runs: dict[int, list[tuple]], core: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(run, entry number, low, high) of every range of repeated starts."""
    names = sorted(runs)
    group: dict[tuple, list] = {}

    def judge() -> Iterator[tuple[int, int, int, int]]:
        strips = [(*key, sum(c for _, _, c in where)) for key, where in group.items()]
        if len(strips) == 1 and strips[0][4] == 1:
            return
        for where, ranges in zip(group.values(), repeated_starts(strips, length), strict=True):
            for a, b in ranges:
                for run, number, _ in where:
                    yield run, number, a, b

    for r, (right, left, low, high, count, number, _), shared in LoserTree([runs[n] for n in names]):
        if shared < core and group:
            yield from judge()
            group.clear()
        group.setdefault((right, left, low, high), []).append((names[r], number, count))
    if group:
        yield from judge()


def make_runs(rows: DataFrame, length: int, run_bytes: int) -> DataFrame:
    """Sorted front-coded runs from texts with their anchors; one row a block.

    ``places`` names the row key, entry number and anchor of every strip of the block.
    """
    kind = rows.schema[ROW].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        strips: list[tuple] = []
        held = 0
        keys: list = []

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal number, strips, held, keys
            strips.sort()
            entries, places = [], []
            for right, left, low, high, key, x in strips:
                if entries and entries[-1][:4] == (right, left, low, high):
                    entries[-1] = (right, left, low, high, entries[-1][4] + 1)
                else:
                    entries.append((right, left, low, high, 1))
                    places.append([])
                places[-1].append((key, x))
            for i in range(0, len(entries), BLOCK):
                part = entries[i : i + BLOCK]
                found = [{"key": keys[key], "entry": i + j, "x": x} for j, where in enumerate(places[i : i + BLOCK]) for key, x in where]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([part[0][0][:HEAD]], pa.binary()), pa.array([part[-1][0][:HEAD]], pa.binary()), pa.array([pack_block(part, i)], pa.binary()), pa.array([found], place_type)],
                    names=["run", "head", "tail", "block", "places"],
                )
            number += 1
            strips, held, keys = [], 0, []

        place_type = None
        for batch in batches:
            place_type = pa.list_(pa.struct([("key", batch.schema.field(0).type), ("entry", pa.int64()), ("x", pa.int64())]))
            for name, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                keys.append(name)
                for a in found:
                    x, s, e = a["x"], a["s"], a["e"]
                    strips.append((data[x : e + length], data[s:x], x - e, x - s, len(keys) - 1, x))
                    held += e + length - s + 150
                    if held >= run_bytes:
                        yield from give()
                        keys.append(name)
        if strips:
            yield from give()

    return rows.select(ROW, "text", "found").mapInArrow(lean(run), f"run long, head binary, tail binary, block binary, places array<struct<key:{kind},entry:long,x:long>>")


def cut_blocks(blocks: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Blocks with the range they belong to; a block across a splitter is cut there."""
    shared = blocks.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        at = shared.value
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for name, head, tail, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                a, b = bisect_right(at, head), bisect_right(at, tail)
                if a == b:
                    pieces = [(a, raw)]
                else:
                    sets: dict[int, list] = {}
                    for entry in open_block(raw):
                        sets.setdefault(bisect_right(at, entry[0][:HEAD]), []).append(entry)
                    pieces = [(k, pack_block([e[:5] for e in entries], entries[0][5])) for k, entries in sets.items()]
                for k, piece in pieces:
                    out[0].append(k)
                    out[1].append(name)
                    out[2].append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["range", "run", "block"])

    return blocks.select("run", "head", "tail", "block").mapInArrow(lean(run), "range long, run long, block binary").withColumn("first", F.substring("block", 9, 8))


def merge_ranges(blocks: DataFrame, core: int, length: int) -> DataFrame:
    """Merge the runs of every range: run, entry, low and high of repeated starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, {}

        def give() -> Iterator[pa.RecordBatch]:
            opened = {}
            for name, raws in runs.items():
                entries: list[tuple] = []
                for raw in sorted(raws, key=lambda raw: int.from_bytes(raw[8:16], "little")):
                    part = open_block(raw)
                    if entries:  # the first of a block is whole; its share with the entry before is found again
                        part[0] = (*part[0][:6], _common(entries[-1][0], part[0][0], 0))
                    entries += part
                opened[name] = entries
            found = list(merged(opened, core, length))
            for i in range(0, len(found), 50_000):
                columns = list(zip(*found[i : i + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["run", "entry", "low", "high"])

        for batch in batches:
            for k, name, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != now:
                    if runs:
                        yield from give()
                    now, runs = k, {}
                runs.setdefault(name, []).append(raw)
        if runs:
            yield from give()

    return blocks.repartition("range").sortWithinPartitions("range", "run").select("range", "run", "block").mapInArrow(lean(run), "run long, entry long, low long, high long")


def repeated_spans(table: DataFrame, *, length: int = LENGTH, span: int = SPAN, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Row key and ``spans``, the (begin, end) byte ranges of its repeated strings, for rows that have any.

    ``table`` has the row key and ``text``.
    """
    spark = table.sparkSession
    core = length - span + 1
    points, points_path = spill(find_anchors(table, length, span), "anchors")
    again = points.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core")
    found = points.join(again, "core", "left_semi").groupBy(ROW).agg(F.collect_list(F.struct("x", "s", "e")).alias("found"))
    blocks, blocks_path = spill(make_runs(table.join(found, ROW), length, run_bytes), "runs")
    remove(spark, points_path)
    total = blocks.agg(F.sum(F.length("block"))).first()[0] or 0
    heads = [bytes(r.head) for r in blocks.select("head", "run").orderBy(F.xxhash64("head", "run")).limit(SAMPLE).collect()]
    heads.sort()
    parts = max(1, -(-total // range_bytes))
    splitters = sorted({heads[len(heads) * i // parts] for i in range(1, parts)}) if heads else []
    hits = merge_ranges(cut_blocks(blocks, splitters), core, length)
    hits, _ = spill(hits, "repeats")
    places = blocks.select("run", F.explode("places").alias("p")).select("run", "p.entry", F.col("p.key").alias(ROW), "p.x")
    spans = hits.join(places, ["run", "entry"]).select(ROW, F.struct((F.col("x") - F.col("high")).alias("begin"), (F.col("x") - F.col("low") + length).alias("end")).alias("span"))
    out, _ = spill(spans.groupBy(ROW).agg(F.collect_list("span").alias("spans")), "spans")
    remove(spark, blocks_path)
    return out


def union(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs that the spans cover; spans that touch are one run."""
    out: list[list[int]] = []
    for s in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, span: int = SPAN, **sizes) -> DataFrame:
    """One row a document: doc_id, n_bytes, the removed runs, and ``kept``, the bytes that stay."""
    table, _ = as_table(docs)
    rows = keyed(table, key := free(table, ROW)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(key).alias(ROW))
    spans = repeated_spans(rows.select(ROW, "text"), length=length, span=span, **sizes)
    joined = rows.select(ROW, "doc_id", "text").join(spans, ROW, "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                sizes_, removed, kept = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    runs = union(found)
                    edges = [0, *(v for r in runs for v in r), len(data)]
                    sizes_.append(len(data))
                    removed.append([{"begin": a, "end": b} for a, b in runs])
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes_, pa.int64()), pa.array(removed, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, removed array<struct<begin:long,end:long>>, kept binary")


def op9(spark, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 400 bytes that occur again."""
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

