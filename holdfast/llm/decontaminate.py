"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most ``PASSAGE`` words.  Their TF-IDF matrix is
factored by a randomised SVD whose products run over the cluster's partitions of the passages; the
right singular vectors give every word a latent vector.  A text is folded in window by window
(32, 64 and 128 words, each overlapping the next by half); windows and the passages of their scale
whose cosine reaches ``NEAR`` are candidates.  So are, at any cosine, windows around which enough of an
item's words lie: an item that is there has one of its ``keys`` there, so each key met in a text
leads to the windows around it, and no window that would pass is left out.  A candidate is judged on
words around the window:

* the longest common subsequence of item and text covers at least ``MATCH`` of the item, or
* it covers at least ``PARAPHRASE`` and the item's answer (its last sentence) is there as well.

Items go through in blocks of ``BLOCK`` passages, so that what is broadcast has a fixed bound
whatever the benchmark's size.  Every window of every text is searched and every candidate judged.

Defined results: null texts, empty ones and ones of white space match nothing; null or empty items are left out; a null id
is kept as it is; repeated rows and items are reported each; an empty table gives no row.  Further
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, lean

PASSAGE = 96
STEP = 48
BLOCK = 2048
RANK = 64
EXTRA = 16
NEAR = 0.5
MATCH = 0.8
PARAPHRASE = 0.6
ANSWER = 0.8
#: Words in the smallest unit that windows are made of, and windows in such units.
UNIT = 16
SCALES = (2, 4, 8)
#: Words whose vectors are summed at once; few enough for the processor's cache.
SLICE = 4096

_MARKS = bytes(b if 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 else 32 for b in range(256)).lower()
_MARKS = bytes(_MARKS[b] if not 65 <= b < 91 else b + 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words of letters and digits; marks part words."""
    return text.encode("utf-8", "surrogatepass").translate(_MARKS).split() if text else []


def answer_words(text: str) -> list[bytes]:
    """The last sentence with at least three words, or the whole item."""
    import re

    for part in reversed(re.split(r"[.!?\n]+", text)):
        words = plain_words(part)
        if len(words) >= 3:
            return words
    return plain_words(text)


def common_subsequence(item: list[bytes], text: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit a word of the item."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        m = at.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


class Index:
    """One block of benchmark items: their words, and their passages' latent vectors by scale."""

    def __init__(self, items: list[tuple], vectors: np.ndarray, row_of: dict[bytes, int], idf: np.ndarray) -> None:
        self.ids = [i for i, _ in items]
        self.words = [plain_words(t) for _, t in items]
        self.answers = [answer_words(t) for _, t in items]
        self.sets = [set(w) for w in self.words]
        self.again = [len(w) - len(k) for w, k in zip(self.words, self.sets, strict=True)]
        #: A common subsequence is no longer than the distinct words in common and the item's repeats.
        self.need = [int(np.ceil(PARAPHRASE * len(w) - 1e-9)) - r for w, r in zip(self.words, self.again, strict=True)]
        self.reach = max(map(len, self.words))
        self.row_of = row_of
        #: Of each word the items that have it as a key, one after the other.
        held: list[list[int]] = [[] for _ in row_of]
        for n, words in enumerate(self.sets):
            for w in keys(words, self.need[n], idf, row_of):
                held[row_of[w]].append(n)
        self.item_rows = [np.array([row_of[w] for w in x], dtype=np.int64) for x in self.sets]
        self.masks = [self.mask(x) for x in self.item_rows]
        self.key_count = np.array([len(x) for x in held], dtype=np.int64)
        self.key_first = np.cumsum(self.key_count) - self.key_count
        self.key_items = np.array([n for x in held for n in x], dtype=np.int64)
        self.weighted = (vectors * idf[:, None]).astype(np.float32)
        self.scales: list[tuple[np.ndarray, np.ndarray]] = []
        for k, units in enumerate(SCALES):
            whose, rows = [], []
            for n, words in enumerate(self.words):
                for part in passages(words):
                    if (len(part) <= units * UNIT or k == len(SCALES) - 1) and (k == 0 or len(part) > SCALES[k - 1] * UNIT):
                        v = self.weighted[[row_of[w] for w in part]].sum(axis=0)
                        rows.append(v / max(float(np.linalg.norm(v)), 1e-9))
                        whose.append(n)
            self.scales.append((np.array(whose, dtype=np.int64), np.array(rows, dtype=np.float32).reshape(len(rows), vectors.shape[1])))

    def mask(self, rows: np.ndarray) -> int:
        """A set of words as bits; -1, a word of no item, is none of them."""
        flags = np.zeros(len(self.row_of) + 1, dtype=bool)
        flags[rows] = True
        return int.from_bytes(np.packbits(flags[:-1]).tobytes(), "big")

    def met(self, texts: list[list[bytes]], rows: np.ndarray, text: np.ndarray, place: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(text, item, places of its keys) wherever a text has as many of the item's words as a match needs."""
        hits = np.flatnonzero(self.key_count[rows])
        counts = self.key_count[rows[hits]]
        which = self.key_items[np.repeat(self.key_first[rows[hits]], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)]
        at = np.repeat(hits, counts)
        order = np.lexsort((place[at], which, text[at]))
        at, which = at[order], which[order]
        cuts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (text[at[1:]] != text[at[:-1]])])) if len(at) else np.zeros(0, dtype=np.int64)
        out, last = [], -1
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True) if len(at) else ():
            t, n = int(text[at[a]]), int(which[a])
            if t != last:
                last, whole = t, set(texts[t])
            if len(self.sets[n] & whole) >= self.need[n]:
                out.append((t, n, place[at[a:b]].tolist()))
        return out

    def judge(self, n: int, words: list[bytes], begin: int, end: int) -> tuple[float, float] | None:
        """Shares of the item and of its answer found around words begin..end, if they suffice."""
        item = self.words[n]
        near = words[max(0, begin - len(item)) : end + len(item)]
        share = common_subsequence(item, near) / len(item)
        if share < PARAPHRASE:
            return None
        answer = common_subsequence(self.answers[n], near) / len(self.answers[n])
        return (share, answer) if share >= MATCH or answer >= ANSWER else None

    def search(self, texts: list[list[bytes]]) -> list[tuple[int, int, float, float, float]]:
        """(text, item, cosine, share, answer share) of every match; the best window of each pair."""
        sizes = np.array([len(t) for t in texts])
        units = -(-sizes // UNIT)
        find = self.row_of.get
        rows = np.fromiter(chain.from_iterable(map(find, t, repeat(-1)) for t in texts), dtype=np.int64, count=int(sizes.sum()))
        unit = np.repeat(np.concatenate([[0], np.cumsum(units)[:-1]]), sizes) + (np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // UNIT
        live = rows >= 0
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        met = self.met(texts, rows[live], np.repeat(np.arange(len(texts)), sizes)[live], inside[live])
        every, first_row, own = rows, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.zeros(len(self.row_of) + 1, dtype=bool)
        rows, unit = rows[live], unit[live]
        first_unit = np.cumsum(units) - units
        total = np.zeros((int(units.sum()) + 1, self.weighted.shape[1]), dtype=np.float32)
        for a in range(0, len(rows), SLICE):
            u = unit[a : a + SLICE]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(u)) + 1])
            total[u[edges] + 1] += np.add.reduceat(self.weighted[rows[a : a + SLICE]], edges, axis=0)
        total = np.cumsum(total, axis=0, dtype=np.float64)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for (whose, vectors), width in zip(self.scales, SCALES, strict=True):
            if not len(whose):
                continue
            hop = width // 2
            counts = np.where(units > 0, np.maximum(1, -(-(units - width) // hop) + 1), 0)
            text = np.repeat(np.arange(len(texts)), counts)
            begin = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * hop
            end = np.minimum(begin + width, units[text])
            window = (total[first_unit[text] + end] - total[first_unit[text] + begin]).astype(np.float32)
            window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-9)
            def take(i: int, n: int, c: float) -> None:
                t = int(text[i])
                found = self.judge(n, texts[t], int(begin[i]) * UNIT, int(end[i]) * UNIT)
                if found and (c, *found) > best.get((t, n), (-2.0, 0.0, 0.0)):
                    best[t, n] = (c, *found)

            for a in range(0, len(window), 8192):
                cosine = window[a : a + 8192] @ vectors.T
                at, which = np.nonzero(cosine >= NEAR)
                last = -1
                for i, j in zip(at.tolist(), which.tolist(), strict=True):
                    if i != last:
                        last, t = i, int(text[a + i])
                        near = self.mask(every[first_row[t] + max(0, int(begin[a + i]) * UNIT - self.reach) : min(first_row[t] + int(end[a + i]) * UNIT + self.reach, first_row[t + 1])])
                    n = int(whose[j])
                    if (near & self.masks[n]).bit_count() >= self.need[n]:
                        take(a + i, n, float(cosine[i, j]))
            first_window = np.cumsum(counts) - counts
            rows_of: dict[int, list[int]] = {}
            for j, n in enumerate(whose.tolist()):
                rows_of.setdefault(n, []).append(j)
            for t, n, places in met:
                if n not in rows_of:
                    continue
                size, most = len(self.words[n]), int(counts[t])
                at = np.array(places)[:, None]
                ks = np.unique(np.clip((at - size) // UNIT // hop + np.arange(-2, 4 + 2 * size // (UNIT * hop)), 0, most - 1)) + int(first_window[t])
                # The item's words around each window, repeats included: a common subsequence is no longer.
                low, high = np.maximum(begin[ks] * UNIT - size, 0), np.minimum(end[ks] * UNIT + size, int(sizes[t]))
                base = int(low[0])
                near = every[first_row[t] + base : first_row[t] + int(high[-1])]
                own[self.item_rows[n]] = True
                hits = np.flatnonzero(own[near])
                own[self.item_rows[n]] = False
                a, b = np.searchsorted(hits, low - base), np.searchsorted(hits, high - base)
                enough = np.flatnonzero(b - a >= PARAPHRASE * size - 1e-9)
                if not len(enough):
                    continue
                # Distinct ones are those that the same word does not precede within the window's reach.
                order = np.argsort(near[hits], kind="stable")
                again = np.flatnonzero(near[hits[order[1:]]] == near[hits[order[:-1]]])
                before = np.full(len(hits), -1)
                before[order[again + 1]] = hits[order[again]]
                for k, x, y in zip(enough.tolist(), a[enough].tolist(), b[enough].tolist(), strict=True):
                    if np.count_nonzero(before[x:y] < low[k] - base) >= self.need[n]:
                        i = int(ks[k])
                        c = float((vectors[rows_of[n]] @ window[i]).max())
                        if c < NEAR + 1e-3:  # the others have been judged
                            take(i, n, c)
        return [(t, n, *v) for (t, n), v in best.items()]


def keys(words: set[bytes], need: int, idf: np.ndarray, row_of: dict[bytes, int]) -> list[bytes]:
    """The rarest words of an item, one of which is in every text that has ``need`` of its words (one at least)."""
    return sorted(words, key=lambda w: (-idf[row_of[w]], -len(w), w))[: len(words) - max(1, need) + 1]


def passages(words: list[bytes]) -> list[list[bytes]]:
    return [words[i : i + PASSAGE] for i in range(0, max(1, len(words) - STEP), STEP)] if len(words) > PASSAGE else [words]


def singular_vectors(items: DataFrame, row_of: dict[bytes, int], idf: np.ndarray, *, rank: int = RANK, extra: int = EXTRA, rounds: int = 2, seed: int = 5) -> np.ndarray:
    """Right singular vectors (word by rank) of the items' TF-IDF passages.

    Randomised range finder with power rounds: every product A'(A X) is summed over the partitions
    of the passages; only word-by-rank blocks reach the driver.
    """
    spark = items.sparkSession
    rows = spark.sparkContext.broadcast((row_of, idf))

    def product(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, weight = rows.value
            out = np.zeros_like(shared.value)
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    for part in passages(plain_words(text)):
                        counts = Counter(find[w] for w in part)
                        at = np.fromiter(counts, dtype=np.int64, count=len(counts))
                        v = np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) * weight[at]
                        v /= max(float(np.linalg.norm(v)), 1e-9)
                        out[at] += v[:, None] * (v @ shared.value[at])[None, :]
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        total = np.zeros_like(x)
        for row in items.select("text").mapInArrow(run, "sums binary").toLocalIterator():
            total += np.frombuffer(row.sums, dtype=np.float64).reshape(x.shape)
        shared.unpersist()
        return total

    width = min(rank + extra, len(idf))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(idf), width)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(product(q))[0]
    small = q.T @ product(q)
    _, turn = np.linalg.eigh((small + small.T) / 2)
    return q @ turn[:, ::-1][:, : min(rank, width)]


def build_index(items: DataFrame) -> Index | None:
    """Index of one block of items (item_id, text); None if it has no words."""
    found = [(r.item_id, r.text) for r in items.collect() if plain_words(r.text)]
    if not found:
        return None
    df = Counter(w for _, t in found for part in passages(plain_words(t)) for w in set(part))
    count = sum(len(passages(plain_words(t))) for _, t in found)
    row_of = {w: i for i, w in enumerate(sorted(df))}
    idf = np.array([np.log(1 + count / df[w]) for w in row_of])
    return Index(found, singular_vectors(items.filter(F.col("text").isNotNull()), row_of, idf), row_of, idf)


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """The items in blocks of about ``block`` passages by a hash of their text."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    words = items.agg(F.sum(F.lit(1) + F.octet_length("text") / (5 * STEP))).first()[0] or 0
    parts = max(1, -(-int(words) // block))
    if parts == 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("text"), parts) == i) for i in range(parts)]


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, item_id, cosine, share and answer_share of each text that holds an item; and its row key if named."""
    spark = docs.sparkSession
    more = [F.col(row_col).alias("row_key")] if row_col else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *more, F.col(text_col).alias("text"))
    kept = [n for n in rows.columns if n != "text"]
    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in kept)
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"{fields}, item_id {item_kind}, cosine double, share double, answer_share double"
    out = None
    for items in item_blocks(benchmark):
        index = build_index(items)
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)
        found = rows.mapInArrow(lean(_finder(shared, kept)), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _finder(shared, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            found, begin, texts, held = [], 0, [], 0
            for i, value in enumerate(batch.column(len(kept))):
                texts.append(plain_words(value.as_py()))
                held += len(texts[-1])
                if held >= 200_000 or i == batch.num_rows - 1:
                    found += [(begin + m[0], *m[1:]) for m in index.search(texts)]
                    begin, texts, held = i + 1, [], 0
            if found:
                at = pa.array([m[0] for m in found])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(at) for i in range(len(kept))), pa.array([index.ids[m[1]] for m in found]), *(pa.array([m[i] for m in found], pa.float64()) for i in (2, 3, 4))],
                    names=[*kept, "item_id", "cosine", "share", "answer_share"],
                )

    return run


def op3(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

