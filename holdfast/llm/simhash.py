"""Near-duplicate groups by SimHash, searched with a Gray-order hierarchical index.

Fingerprints are made distinct first, so a group of copies is one entry.  The index has upper
nodes that are masked bit patterns: with ``c`` of ``max_diff + c`` bit blocks as the mask, two
fingerprints at ``max_diff`` or fewer differing bits share the pattern of at least one mask, so no
link is lost.  ``c`` follows the number of fingerprints, which keeps an upper node's share small.
Below an upper node the fingerprints lie in Gray order; every run of ``FAN`` neighbours is a node
that holds the bits they share and that its parent does not hold, and a search adds up the
differences from level to level and drops a whole run once they exceed ``max_diff``.

An upper node of over ``MOST`` fingerprints is dealt over tasks as pairs of blocks of it, so no
task holds more than two blocks.  A task sends on a spanning forest of its links, at most one link
a fingerprint.  Where pairs count by their common shingles, those beyond ``max_diff`` bits are
found by the shingles themselves (``set_links``), so no pair is lost there either.  Sketches rule
out most pairs before whole sets are sent (``sift``).  Components come from alternating star operations, each round written to the
shared folder; neither links nor components reach the driver.

Defined results: null text is empty; a text without words has fingerprint zero; fewer words than a
shingle are one shingle; a null id never names a component unless no member has an id; rows that
repeat are members each; an empty table gives no row.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, lean, remove, spill, words_of

FAN = 16
MOST = 8192
SPREAD = 512
SEED = 42
#: For the order of shingles: one text in so many is counted, and so many of the shingles met in
#: ``OFTEN`` counted texts come last.  The order decides what is compared, not what is found.
SAMPLE = 16
OFTEN = 4
LAST = 200_000
#: Bits of a set's sketch, pairs that one step compares, and the most masks that a fingerprint is sent under.
BITS = 512
STEP = 100_000
TABLES = 128


def majority(hashes: np.ndarray) -> int:
    """64 bits: set where over half of the hashes have them set."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The XXH64 values of all shingles, repeats included; fewer words than a shingle are one, none give none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = (starts + lengths)[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends, strict=False)), dtype=np.uint64, count=len(ends))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The values of ``shingle_hashes`` without repeats, in order."""
    return np.unique(shingle_hashes(text, size))


def lead(found: np.ndarray, last: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, those of ``last`` behind all others: two sets that share ``similarity`` share one of them.

    Each has at least that part of its shingles in the other, so the first common one lies among
    the first that are more than the rest can be.
    """
    count = len(found) - int(np.ceil(similarity * len(found) - 1e-6)) + 1 if len(found) else 0
    if len(last) and len(found):
        often = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
        found = np.concatenate([found[~often], found[often]])
    return found[:count]


def fingerprint(text: str | None, size: int = 4) -> int:
    """64 bits: set where over half of the shingles' XXH64 values have them set."""
    return majority(shingle_hashes(text, size))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes of shared bits."""

    def __init__(self, fingerprints: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(fingerprints), kind="stable")
        self.items = fingerprints[self.order]
        self.runs = np.resize(self.items, -(-len(self.items) // FAN) * FAN).reshape(-1, FAN)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        #: From the items up: pattern, mask of all shared bits, and number of items below.
        levels = [(self.items, np.full(len(self.items), full))]
        while len(levels[-1][0]) > FAN:
            pattern, mask = levels[-1]
            first = np.arange(0, len(pattern), FAN)
            differ = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[first], FAN)[: len(pattern)], first)
            shared = np.bitwise_and.reduceat(mask, first) & ~differ
            levels.append((pattern[first] & shared, shared))
        self.levels = []
        for depth, (pattern, mask) in enumerate(levels):
            above = levels[depth + 1][1] if depth + 1 < len(levels) else None
            own = mask & ~np.repeat(above, FAN)[: len(mask)] if above is not None else mask
            self.levels.append((pattern, own))

    def search(self, queries: np.ndarray, after: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, item place) within ``most`` bits; only items placed after ``after``."""
        top = len(self.levels) - 1
        pattern, own = self.levels[top]
        differ = np.bitwise_count((queries[:, None] ^ pattern[None, :]) & own[None, :])
        q, node = np.nonzero(differ <= most)
        sum_ = differ[q, node].astype(np.int16)
        for depth in range(top, -1, -1):
            live = (node + 1) * FAN**depth > after[q] + 1
            q, node, sum_ = q[live], node[live], sum_[live]
            if depth == 0:
                break
            if depth == 1:  # the runs that are left: their items as rows, whole differences at once
                hit, place = np.nonzero(np.bitwise_count(queries[q][:, None] ^ self.runs[node]) <= most)
                q, node = q[hit], node[hit] * FAN + place
                inside = (node < len(self.items)) & (node > after[q])
                return q[inside], node[inside]
            pattern, own = self.levels[depth - 1]
            q, sum_ = np.repeat(q, FAN), np.repeat(sum_, FAN)
            node = (node[:, None] * FAN + np.arange(FAN)).ravel()
            inside = node < len(pattern)
            q, node, sum_ = q[inside], node[inside], sum_[inside]
            sum_ = sum_ + np.bitwise_count((queries[q] ^ pattern[node]) & own[node])
            live = sum_ <= most
            q, node, sum_ = q[live], node[live], sum_[live]
        return q, node


class Forest:
    """Union by smallest place, all links of a block at a time; ``links`` are the pairs that joined two trees."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> None:
        """Join the pairs (a, b), those with the smaller ``near`` first."""
        order = np.argsort(near, kind="stable")
        a, b, near = a[order], b[order], near[order]
        for distance in np.unique(near):
            at = near == distance
            self._join(a[at], b[at])

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                break
            high, first = np.unique(np.maximum(x, y), return_index=True)
            root[high] = np.minimum(x, y)[first]
            self.links.append((a[first], b[first]))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
        self.root = root


def near_pairs(fingerprints: np.ndarray, block: np.ndarray, left: int, right: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (a, b) and distances of one node's pairs within ``most`` bits, or of those across two blocks, part by part."""
    if left == right and len(fingerprints) <= 4 * FAN:  # a node of leaves only: every pair
        near = np.bitwise_count(fingerprints[:, None] ^ fingerprints[None, :])
        a, b = np.nonzero(np.triu(near <= most, 1))
        yield a, b, near[a, b]
    elif left == right:
        index = GrayIndex(fingerprints)
        items = index.items
        for i in range(0, len(items), 256):
            q, at = index.search(items[i : i + 256], np.arange(i, min(i + 256, len(items))), most)
            keep = at > q + i
            q, at = q[keep] + i, at[keep]
            yield index.order[q], index.order[at], np.bitwise_count(items[q] ^ items[at])
    else:
        ours, theirs = np.flatnonzero(block == left), np.flatnonzero(block == right)
        index = GrayIndex(fingerprints[ours])
        for i in range(0, len(theirs), 256):
            part = fingerprints[theirs[i : i + 256]]
            q, at = index.search(part, np.full(len(part), -1), most)
            yield theirs[q + i], ours[index.order[at]], np.bitwise_count(part[q] ^ index.items[at])


def forest_links(fingerprints: np.ndarray, block: np.ndarray, left: int, right: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of spanning links of one node's fingerprints, nearest first within a part of the search."""
    forest = Forest(len(fingerprints))
    for a, b, near in near_pairs(fingerprints, block, left, right, most):
        forest.join(a, b, near)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *(x for x, _ in forest.links)]), np.concatenate([none, *(y for _, y in forest.links)])


def cross_links(fingerprints: np.ndarray, block: np.ndarray, left: int, right: int, most: int, group: np.ndarray, table: int, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of different groups, each given only under the first mask both share."""
    none = np.zeros(0, dtype=np.int64)
    found = [(none, none)]
    if (group != group[0]).any():
        for a, b, _ in near_pairs(fingerprints, block, left, right, most):
            apart = group[a] != group[b]
            a, b = a[apart], b[apart]
            differ = fingerprints[a] ^ fingerprints[b]
            first = ~((differ[:, None] & patterns[None, :table]) == 0).any(axis=1)
            found.append((a[first], b[first]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def masks(count: int, most: int) -> list[int]:
    """The upper nodes' masks for so many fingerprints: all choices of c among most + c blocks."""
    # The fewest blocks that leave about SPREAD fingerprints under a pattern, were they spread evenly.
    # Each mask costs a copy of every fingerprint; where TABLES ends them, upper nodes are larger instead.
    few = [c for c in (1, 2, 3, 4) if c == 1 or comb(most + c, c) <= TABLES]
    chosen = next((c for c in few if count >> (64 * c // (most + c)) <= SPREAD), few[-1])
    parts = most + chosen
    edges = [64 * i // parts for i in range(parts + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, chosen)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link(distinct: DataFrame, most: int, *, block: int = MOST, cross: bool = False) -> DataFrame:
    """Links (u, v) of rows (node, fp) whose components are those of all pairs within ``most`` bits.

    With ``cross`` the rows have a ``group`` too, and the links are all such pairs of different groups.
    """
    chosen = masks(distinct.count(), most)
    signed = F.array(*(F.lit(_signed(m)) for m in chosen))
    unsigned = np.array(chosen, dtype=np.uint64)
    rows = distinct.select(*distinct.columns, F.explode(F.sequence(F.lit(0), F.lit(len(chosen) - 1))).alias("table"))
    pattern = F.col("fp").bitwiseAND(F.element_at(signed, F.col("table") + 1))
    large = rows.groupBy("table", pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    large, path = spill(large, "simhash-large")
    keys = ["table", "pattern", "left", "right"]
    if large.isEmpty():  # what follows from the fingerprint is not sent along
        rows = rows.repartition("table", pattern).withColumns({"pattern": pattern, "own": F.lit(0), "left": F.lit(0), "right": F.lit(0)})
    else:
        rows = rows.withColumn("pattern", pattern)
        blocks = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
        rows = rows.join(large, ["table", "pattern"], "left").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")}).repartition(*keys)
    read = ["fp", "node", "own", *keys, *(["group"] if cross else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def give(parts: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch | None:
            us, vs = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    under = parts[0][a:b].view(np.uint64), parts[2][a:b], int(parts[5][a]), int(parts[6][a]), most
                    x, y = cross_links(*under, parts[7][a:b], int(parts[3][a]), unsigned) if cross else forest_links(*under)
                    us.append(parts[1][a:b][x])
                    vs.append(parts[1][a:b][y])
            if not us or not sum(map(len, us)):
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        for batch in batches:
            new = [batch.column(batch.schema.get_field_index(n)).to_numpy() for n in read]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            change = np.zeros(len(held[0]), dtype=bool)
            for i in (3, 4, 5, 6):
                change[1:] |= held[i][1:] != held[i][:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change)])
            if len(cuts) > 1 and (out := give(held, cuts)) is not None:
                yield out
            held = [x[cuts[-1] :] for x in held]
        if held is not None and len(held[0]) and (out := give(held, np.array([0, len(held[0])]))) is not None:
            yield out

    found = rows.sortWithinPartitions(*keys).select(*read).mapInArrow(lean(run), "u long, v long")
    found, _ = spill(found, "simhash-links")
    return found


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest value reachable) of every node that has a link."""
    spark = links.sparkSession
    now, path = spill(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "stars")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v")
        new, new_path = spill(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, path)
        now, path = new, new_path
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen


def sift(links: DataFrame, wides: DataFrame, similarity: float) -> DataFrame:
    """Links without those whose two nodes' sizes or wide sketches rule out ``similarity``; ``wides`` has node, n and wide."""
    part = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n_u, n_v, x, y = batch.columns
            a, b = n_u.to_numpy().astype(np.int64), n_v.to_numpy().astype(np.int64)
            at = np.flatnonzero(np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6)
            most = (a + b)[at] * part + 1e-6
            x, y = (z.take(pa.array(at)).to_pylist() for z in (x, y))
            at = at[np.fromiter(map(differing, x, y), dtype=np.int64, count=len(at)) <= most]
            yield pa.RecordBatch.from_arrays([u.take(pa.array(at)), v.take(pa.array(at))], names=["u", "v"])

    ours, theirs = (wides.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}")) for k in ("u", "v"))
    both = links.join(ours, "u").join(theirs, "v").select("u", "v", "n_u", "n_v", "wide_u", "wide_v")
    return spill(both.mapInArrow(lean(run), "u long, v long"), "simhash-sifted")[0]


def alike(links: DataFrame, wides: DataFrame, prints: DataFrame, rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links whose two nodes share ``similarity`` of their shingles; a node's rows all have the same ones.

    Whole sets are sent only for links that the sketches leave.
    """
    links = sift(links, wides, similarity)
    named = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    firsts = prints.join(named, "node").groupBy("node").agg(F.min("row_key").alias("row_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    sets, path = spill(rows.join(firsts, "row_key").select("node", "text").mapInArrow(lean(run), "node long, set array<long>"), "simhash-sets")
    both = links.join(sets.select(F.col("node").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("y")), "v")
    shared = F.size(F.array_intersect("x", "y"))
    kept, _ = spill(both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("u", "v"), "simhash-alike")
    remove(rows.sparkSession, path)
    return kept


def common_shingles(rows: DataFrame, size: int) -> np.ndarray:
    """The shingles met most often in a sample of the texts by hash, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = shingle_set(t, size)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["shingle"])

    sample = rows.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    found = sample.mapInArrow(lean(run), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    table = found.orderBy(F.desc("n"), "shingle").limit(LAST).select("shingle").toArrow()
    return np.sort(table.column(0).to_numpy().astype(np.int64).view(np.uint64))


def sketch(found: np.ndarray, bits: int = BITS) -> bytes:
    """``bits`` bits: set where an odd number of the shingles fall.  Two sets differ in at least as many shingles as their sketches in bits."""
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def wide_sketch(found: np.ndarray) -> bytes:
    """A sketch of at least a bit for each shingle, so that it tells large sets apart too; its bits are a power of two."""
    return sketch(found, max(BITS, 1 << max(0, len(found) - 1).bit_length()))


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ; the wider one is folded, which gives the sketch of fewer bits."""
    x, y = (np.frombuffer(s, dtype=np.uint64) for s in ((a, b) if len(a) >= len(b) else (b, a)))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum(dtype=np.int64))


def shared_leads(placed: DataFrame) -> DataFrame:
    """shingle and node: the leads' shingles that nodes of two groups have, so at most a row for each shingle of a lead."""
    keys = placed.select("node", "group", F.explode("lead").alias("shingle")).repartition("shingle").sortWithinPartitions("shingle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, group, shingle), cuts in by_shingle(batches, 3):
            first = cuts[:-1]
            kept = np.repeat(np.minimum.reduceat(group, first) != np.maximum.reduceat(group, first), np.diff(cuts))
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(shingle[kept]), pa.array(node[kept])], names=["shingle", "node"])

    return keys.select("node", "group", "shingle").mapInArrow(lean(run), "shingle long, node long")


def by_shingle(batches: Iterator[pa.RecordBatch], fields: int, at: int | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The first ``fields`` columns of whole shingles, in order of the last of them, and where each shingle begins and the last one ends; sketches (column ``at``) as rows of words."""
    held: list[np.ndarray] | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            new = [np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64) if i == at else batch.column(i).to_numpy() for i in range(fields)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if held is None or not len(held[0]):
            continue
        shingle = held[-1]
        cuts = np.concatenate([[0], np.flatnonzero(shingle[1:] != shingle[:-1]) + 1, [len(shingle)]])
        full = len(cuts) - 1 - (batch is not None)  # the last shingle may go on
        if full:
            yield [x[: cuts[full]] for x in held], cuts[: full + 1]
            held = [x[cuts[full] :] for x in held]


def set_links(members: DataFrame, placed: DataFrame, similarity: float, *, spanning: bool = False) -> DataFrame:
    """Pairs (u, v) of different groups that may share ``similarity`` of their shingles; no such pair is left out.

    ``placed`` has node, group, n (its number of shingles) and sketch; ``members`` are its
    ``shared_leads``.  Common shingles are among the two leads or in the rest of the set whose lead
    ends first, and the sketches bound how many are not common.  With ``spanning`` a shingle gives a
    forest of such pairs, nearest first, at most one pair for each of its rows.
    """
    keys = members.join(placed.select("node", "group", "n", "sketch"), "node").repartition("shingle").sortWithinPartitions("shingle", "n")

    def pairs(group: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        # In order of size: partners of a set lie between it and the first that is too large.
        ends = np.searchsorted(n, n / similarity + 1e-6, side="right")
        step = max(1, STEP // len(n))
        for begin in range(0, len(n), step):
            reach = np.arange(begin, min(begin + step, len(n)))
            counts = ends[reach] - reach - 1
            a = np.repeat(reach, counts)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
            apart = group[a] != group[b]
            a, b = a[apart], b[apart]
            differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            near = differ <= (n[a].astype(np.int64) + n[b]) * ((1 - similarity) / (1 + similarity)) + 1e-6
            if near.any():
                yield a[near], b[near], differ[near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, group, n, bits, _), cuts in by_shingle(batches, 5, 3):
            us, vs = [], []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found = pairs(group[i:j], n[i:j], bits[i:j])
                if spanning:
                    forest = Forest(j - i)
                    _, first, which = np.unique(group[i:j], return_index=True, return_inverse=True)
                    forest.root = first[which]
                    for a, b, differ in found:
                        forest.join(a, b, differ)
                    found = [(a, b, None) for a, b in forest.links]
                for a, b, _ in found:
                    us.append(a + i)
                    vs.append(b + i)
                    if sum(map(len, us)) >= STEP:
                        yield ordered(node, n, us, vs)
                        us, vs = [], []
            if us:
                yield ordered(node, n, us, vs)

    def ordered(node: np.ndarray, n: np.ndarray, us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(us), np.concatenate(vs)
        swap = node[a] > node[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[a], node[b], n[a], n[b])], names=["u", "v", "n_u", "n_v"])

    met = keys.select("node", "group", "n", "sketch", "shingle").mapInArrow(lean(run), "u long, v long, n_u int, n_v int")
    if spanning:
        return spill(met.select("u", "v").distinct(), "simhash-sets-met")[0]
    met = met.groupBy("u", "v", "n_u", "n_v").agg(F.count(F.lit(1)).alias("c"))
    rest = F.greatest(*(F.ceil(F.col(x) * similarity - 1e-6) - 1 for x in ("n_u", "n_v")))
    least = (F.col("n_u") + F.col("n_v")) * (similarity / (1 + similarity)) - 1e-6
    found, _ = spill(met.filter(F.col("c") + rest >= least).select("u", "v"), "simhash-sets-met")
    return found


def alike_links(distinct: DataFrame, prints: DataFrame, rows: DataFrame, size: int, similarity: float, most: int, every: bool = False) -> DataFrame:
    """Links (u, v) with the components of all pairs within ``most`` bits that share ``similarity``.

    A spanning link that is not alike may hide one that is, so the index is searched a second time:
    every pair whose nodes the alike spanning links leave apart is compared as well.  With ``every``
    those nodes are searched by their shingles instead, and the pairs are all that share
    ``similarity``, at whatever number of bits: first spanning links of the sets of each shingle,
    which join a large group of near copies, then every pair that is still apart.
    """
    wides, wides_path = spill(prints.groupBy("node").agg(F.first("n").alias("n"), F.first("wide").alias("wide")), "simhash-wide")
    spanning = alike(link(distinct, most).distinct(), wides, prints, rows, size, similarity)
    roots = components(spanning)
    placed = distinct.join(roots, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("group"))
    placed, path = spill(placed, "simhash-placed")
    if every:
        leads = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("sketch").alias("sketch"))
        held, held_path = spill(placed.select("node", "group").join(leads, "node"), "simhash-leads")
        members, members_path = spill(shared_leads(held), "simhash-members")
        closer = alike(set_links(members, held, similarity, spanning=True), wides, prints, rows, size, similarity)
        spanning = spanning.unionByName(closer)
        joined = components(spanning)
        held = held.drop("group", "lead").join(joined, "node", "left").withColumn("group", F.coalesce("root", "node"))
        beyond = set_links(members, held, similarity)
        remove(distinct.sparkSession, held_path, members_path)
    else:
        beyond = link(placed, most, cross=True)
    more = alike(beyond, wides, prints, rows, size, similarity)
    remove(distinct.sparkSession, path, wides_path)
    return spanning.unionByName(more)


def near_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, max_diff: int = 4, similarity: float | None = None, row_col: str | None = None, every: bool = False
) -> DataFrame:
    """One row a document: doc_id, fp, root (node that stands for the group), component_id; and its row key if named.

    Without ``similarity`` a node is a fingerprint.  With it (it needs the row key) a node is a set
    of shingles, the fingerprint is that of the distinct shingles, and a link found by the index
    also has to reach that share of common shingles.  With ``every`` all pairs that reach it are
    links, also those whose fingerprints differ in more than ``max_diff`` bits.
    """
    more = [F.col(row_col).alias("row_key")] if row_col else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *more, F.col(text_col).alias("text"))
    kept = [n for n in rows.columns if n != "text"]
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in kept)

    every = every and similarity is not None
    last = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, size)) if every else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            facts = []
            if similarity is None:
                fps = nodes = np.fromiter((fingerprint(t, size) for t in texts), dtype=np.uint64, count=len(texts))
            else:
                fps, nodes = np.zeros(len(texts), dtype=np.uint64), np.zeros(len(texts), dtype=np.uint64)
                for i, t in enumerate(texts):
                    found = shingle_set(t, size)
                    fps[i], nodes[i] = majority(found), xxhash.xxh64_intdigest(found.tobytes(), SEED)
                    facts.append((len(found), wide_sketch(found), *((lead(found, last.value, similarity).view(np.int64), sketch(found)) if every else ())))
            more_ = [pa.array([x[i] for x in facts], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(fps.view(np.int64)), pa.array(nodes.view(np.int64)), *more_], names=[*kept, "fp", "node", *names_])

    # What a set of shingles is judged by: its size and wide sketch, and for the search by shingles its lead and sketch.
    held = [] if similarity is None else [("n", "int", pa.int32()), ("wide", "binary", pa.binary())]
    held += [("lead", "array<long>", pa.list_(pa.int64())), ("sketch", "binary", pa.binary())] if every else []
    names_, kinds = [h[0] for h in held], [h[2] for h in held]
    prints, _ = spill(rows.mapInArrow(lean(run), ", ".join([schema, "fp long, node long", *(f"{h[0]} {h[1]}" for h in held)])), "simhash-prints")
    distinct, _ = spill(prints.groupBy("node", "fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    if similarity is None:
        links = link(distinct.select("node", "fp"), max_diff)
    else:
        texts = docs.select(F.col(row_col).alias("row_key"), F.col(text_col).alias("text"))
        links = alike_links(distinct.select("node", "fp"), prints, texts, size, similarity, max_diff, every)
    roots = components(links)
    placed = distinct.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    names = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_node = placed.join(names, "root").select("node", "root", "component_id")
    return prints.join(by_node, "node").select(*kept, "fp", "root", "component_id")


def op10(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_groups(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
