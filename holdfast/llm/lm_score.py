"""Language-model scores from a hidden Markov model.

Latent states emit classes of words and a class emits its words:

    P(text) = sum over state paths of prod P(state | state before) P(class | state) * prod P(word | class)

The ``OWN`` most frequent training words are classes of their own; every other word belongs to the
class that crc32 of the word names, one of ``HASHED``.  So the states' tables have a fixed size,
and the words' own counts, whose number grows with the corpus, stay a distributed table: counted
with partial sums on each partition, and joined to the texts that need them.  The ``HOT`` most
frequent counts go to the workers (a bounded list); all other words meet their counts in a join.

Baum-Welch: every pass covers all training tokens.  Each partition runs scaled forward-backward
and emits its expected counts as fixed blocks, which are summed by block before the driver takes
one sum.  In training, texts are taken in pieces of ``PIECE`` tokens, each with the state it
starts in open.  The score is the exact likelihood of the whole text by the scaled forward recursion.

Defined results: null text is empty and holds the end token alone; a null id counts as the empty
text in folds; repeated ids and texts are rows of their own; with no training row every count is
0; an empty table gives no row.  Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, fold_of, spill, words_of

STATES = 8
OWN = 24_576
HASHED = 8_192
CLASSES = OWN + HASHED
HOT = 200_000
PASSES = 5
PIECE = 256
#: The end token; no word is empty.
END = b""


def count_words(rows: DataFrame) -> DataFrame:
    """word (binary) and its count over the texts of ``rows``, end tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                if len(seen) > 400_000:
                    yield give()
            seen[END] += batch.num_rows
        if seen:
            yield give()

    return rows.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """The hot words with their classes and counts, and each hashed class's tokens and words."""

    def __init__(self, words: list[bytes], counts: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, tokens: int, types: int, own: int, hashed: int) -> None:
        self.own, self.hashed = own, hashed
        self.at = {w: i for i, w in enumerate(words)}
        self.counts = counts
        bucket = np.fromiter((zlib.crc32(w) % hashed for w in words), dtype=np.int64, count=len(words))
        self.classes = np.where(np.arange(len(words)) < own, np.arange(len(words)), own + bucket).astype(np.int64)
        self.class_tokens, self.class_words = class_tokens.copy(), class_words.copy()
        np.subtract.at(self.class_tokens, bucket[:own], counts[:own])
        np.subtract.at(self.class_words, bucket[:own], 1)
        self.tokens, self.types = tokens, types
        self.base = np.log10((counts + 0.5) / (tokens + 0.5 * (types + 1)))
        room = self.class_tokens + 0.5 * (self.class_words + 1)
        self.within = np.where(np.arange(len(words)) < own, 0.0, np.log10((counts + 0.5) / room[bucket]))

    def global_classes(self) -> np.ndarray:
        """The share of each class among the training tokens, smoothed."""
        share = np.full(self.own + self.hashed, 0.5)
        n = min(self.own, len(self.counts))
        share[:n] += self.counts[:n]
        share[self.own :] += self.class_tokens
        return share / share.sum()


def lexicon(vocabulary: DataFrame, *, own: int = OWN, hashed: int = HASHED, hot: int = HOT) -> Lexicon:
    """Bounded lists only go to the driver: ``hot`` words, ``hashed`` class totals."""
    totals = vocabulary.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = vocabulary.orderBy(F.desc("c"), "word").limit(hot).toPandas()
    classes = vocabulary.groupBy((F.crc32("word") % hashed).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    tokens, types = np.zeros(hashed, dtype=np.int64), np.zeros(hashed, dtype=np.int64)
    tokens[classes["k"].to_numpy(dtype=np.int64)] = classes["n"].to_numpy(dtype=np.int64)
    types[classes["k"].to_numpy(dtype=np.int64)] = classes["v"].to_numpy(dtype=np.int64)
    top = top.sort_values(["c", "word"], ascending=[False, True], kind="stable")
    return Lexicon([bytes(w) for w in top["word"]], top["c"].to_numpy(dtype=np.int64), tokens, types, int(totals.n or 0), int(totals.v), own, hashed)


_ENCODED = "n_tokens long, classes binary, hot_known long, hot_base double, hot_within double, rare array<struct<word:binary,tf:long>>"
_RARE = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))


def encode(rows: DataFrame, shared) -> DataFrame:
    """Each text as class numbers, with what the hot words settle and the words left to a join."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        find, own, hashed = lex.at.get, lex.own, lex.hashed
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                out: list[list] = [[] for _ in range(6)]
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    words = words_of(text)
                    words.append(END)
                    at = np.fromiter((find(w, -1) for w in words), dtype=np.int64, count=len(words))
                    missing = np.flatnonzero(at < 0).tolist()
                    classes = lex.classes[at] if len(lex.classes) else np.zeros(len(at), dtype=np.int64)
                    rare = [words[i] for i in missing]
                    if rare:
                        classes[missing] = [own + zlib.crc32(w) % hashed for w in rare]
                    met = at[at >= 0]
                    values = (len(words), classes.astype("<u2").tobytes(), len(met), float(lex.base[met].sum()), float(lex.within[met].sum()), [{"word": w, "tf": n} for w, n in Counter(rare).items()])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                keep = [part.column(part.schema.get_field_index(n)) for n in ("row_id", "doc_id", "held_out")]
                types = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), _RARE)
                yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["row_id", "doc_id", "held_out", "n_tokens", "classes", "hot_known", "hot_base", "hot_within", "rare"])

    return rows.mapInArrow(run, f"row_id long, doc_id {kind}, held_out boolean, {_ENCODED}")


class Parameters:
    """Start (of a text, of a later piece), moves and emissions (class by state)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, share: np.ndarray, states: int, seed: int = 11) -> Parameters:
        rng = np.random.default_rng(seed)
        emit = share[:, None] * np.exp(0.5 * rng.standard_normal((len(share), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full((2, states), 1 / states), move, (emit / emit.sum(axis=0)).astype(np.float64))

    def updated(self, counts: Counts, share: np.ndarray) -> Parameters:
        prior = 0.02 * len(share)
        emit = counts.emit + prior * share[:, None]
        move = counts.move + 0.1
        start = counts.start + 0.1
        return Parameters(start / start.sum(axis=1, keepdims=True), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Counts:
    """Expected counts, and the log10 likelihood they were taken at."""

    def __init__(self, classes: int, states: int) -> None:
        self.start, self.move, self.emit, self.fit = np.zeros((2, states)), np.zeros((states, states)), np.zeros((classes, states)), 0.0

    def add(self, obs: list[np.ndarray], first: list[bool], p: Parameters) -> None:
        """Scaled forward-backward over pieces, all stepped together, longest first."""
        order = sorted(range(len(obs)), key=lambda i: -len(obs[i]))
        lengths = np.array([len(obs[i]) for i in order])
        opening = np.array([0 if first[i] else 1 for i in order])
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        edge = np.concatenate([[0], np.cumsum(live)])
        flat = np.concatenate([obs[i] for i in order]).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        step = np.repeat(np.arange(len(live)), live)
        seen = flat[begin[np.arange(len(flat)) - edge[step]] + step]
        emit = p.emit.astype(np.float32)[seen]
        move = p.move.astype(np.float32)
        forward, scale = np.empty_like(emit), np.empty(len(seen), dtype=np.float32)
        for t, n in enumerate(live):
            a, b = edge[t], edge[t + 1]
            now = (p.start[opening].astype(np.float32) if t == 0 else forward[edge[t - 1] : edge[t - 1] + n] @ move) * emit[a:b]
            s = now.sum(axis=1)
            np.maximum(s, np.float32(1e-30), out=s)
            forward[a:b], scale[a:b] = now / s[:, None], s
        right = np.ones((live[-1], emit.shape[1]), dtype=np.float32)
        gamma = np.empty_like(emit)
        gamma[edge[-2] :] = forward[edge[-2] :]
        for t in range(len(live) - 1, 0, -1):
            a, b, n = edge[t], edge[t + 1], live[t]
            back = emit[a:b] * right / scale[a:b][:, None]
            before = forward[edge[t - 1] : edge[t - 1] + n]
            self.move += (before.T @ back) * move
            right = np.ones((live[t - 1], emit.shape[1]), dtype=np.float32)
            right[:n] = back @ move.T
            gamma[edge[t - 1] : a] = forward[edge[t - 1] : a] * right
        for k in range(emit.shape[1]):
            self.emit[:, k] += np.bincount(seen, weights=gamma[:, k], minlength=len(self.emit))
        for kind in (0, 1):
            self.start[kind] += gamma[: live[0]][opening == kind].sum(axis=0)
        self.fit += float(np.log10(scale.astype(np.float64)).sum())


def _pieces(obs: np.ndarray, size: int) -> list[tuple[np.ndarray, bool]]:
    return [(obs[i : i + size], i == 0) for i in range(0, len(obs), size)]


def expected_counts(encoded: DataFrame, p: Parameters, *, at_once: int = 400_000) -> Counts:
    """One Baum-Welch pass over all rows: counts summed in each partition, then by block."""
    classes, states = p.emit.shape
    shared = encoded.sparkSession.sparkContext.broadcast(p)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, obs, first, held = Counts(classes, states), [], [], 0
        for batch in batches:
            for raw in batch.column(0):
                for piece, opens in _pieces(np.frombuffer(raw.as_buffer(), dtype="<u2"), PIECE):
                    obs.append(piece)
                    first.append(opens)
                    held += len(piece)
                    if held >= at_once:
                        counts.add(obs, first, shared.value)
                        obs, first, held = [], [], 0
        if obs:
            counts.add(obs, first, shared.value)
        small = np.concatenate([counts.start.ravel(), counts.move.ravel(), [counts.fit]])
        blocks = [small, *(counts.emit[:, k].copy() for k in range(states))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.frombuffer(raw, dtype=np.float64)
                sums[block] = sums[block] + a if block in sums else a
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([b.tobytes() for b in sums.values()], pa.binary())], names=["block", "sums"])

    schema = "block int, sums binary"
    rows = encoded.select("classes").mapInArrow(gather, schema).repartition(states + 1, "block").mapInArrow(add_up, schema).collect()
    shared.unpersist()
    out = Counts(classes, states)
    for row in rows:
        a = np.frombuffer(row.sums, dtype=np.float64)
        if row.block == 0:
            out.start = a[: 2 * states].reshape(2, states).copy()
            out.move = a[2 * states : -1].reshape(states, states).copy()
            out.fit = float(a[-1])
        else:
            out.emit[:, row.block - 1] = a
    return out


def train(encoded: DataFrame, share: np.ndarray, *, states: int = STATES, passes: int = PASSES) -> Parameters:
    p = Parameters.initial(share, states)
    for _ in range(passes):
        p = p.updated(expected_counts(encoded, p), share)
    return p


def forward_scores(obs: list[np.ndarray], p: Parameters) -> np.ndarray:
    """log10 likelihood of each whole class sequence by the scaled forward recursion."""
    order = np.argsort([-len(o) for o in obs], kind="stable")
    lengths = np.array([len(obs[i]) for i in order])
    flat = np.concatenate([obs[i] for i in order]).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    total = np.zeros(len(obs))
    state = np.broadcast_to(p.start[0], (len(obs), len(p.move)))
    for t, n in enumerate(live.tolist()):
        now = (state if t == 0 else state[:n] @ p.move) * p.emit[flat[begin[:n] + t]]
        s = now.sum(axis=1)
        total[:n] += np.log10(s)
        state = now / s[:, None]
    out = np.empty(len(obs))
    out[order] = total
    return out


def class_scores(encoded: DataFrame, p: Parameters, *, at_once: int = 4_000_000) -> DataFrame:
    """row_id and the log10 likelihood of the text's class sequence."""
    shared = encoded.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, obs, held = [], [], 0
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(row)
                obs.append(np.frombuffer(raw, dtype="<u2"))
                held += len(obs[-1])
                if held >= at_once:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forward_scores(obs, shared.value))], names=["row_id", "class_score"])
                    ids, obs, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forward_scores(obs, shared.value))], names=["row_id", "class_score"])

    return encoded.select("row_id", "classes").mapInArrow(run, "row_id long, class_score double")


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, held: int = 1, states: int = STATES, passes: int = PASSES, hot: int = HOT, own: int = OWN, hashed: int = HASHED) -> DataFrame:
    """Train on all rows outside the held-out fold and score every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"held_out": fold_of(F.col("doc_id"), parts) == held, "row_id": F.monotonically_increasing_id()})
    vocabulary, _ = spill(count_words(rows.filter(~F.col("held_out"))), "lm-words")
    lex = lexicon(vocabulary, own=own, hashed=hashed, hot=hot)
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    encoded, _ = spill(encode(rows, shared), "lm-encoded")
    model = train(encoded.filter(~F.col("held_out")), lex.global_classes(), states=states, passes=passes)
    room = docs.sparkSession.createDataFrame([(i, float(a + 0.5 * (b + 1))) for i, (a, b) in enumerate(zip(lex.class_tokens.tolist(), lex.class_words.tolist(), strict=True))], "k long, room double")
    rare = encoded.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.tf")
    found = rare.join(vocabulary, "word", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("k", F.crc32("word") % hashed)
    found = found.join(F.broadcast(room), "k")  # ``hashed`` rows
    every = float(lex.tokens + 0.5 * (lex.types + 1))
    sums = found.groupBy("row_id").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.5) / F.lit(every))).alias("base"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.5) / F.col("room"))).alias("within"),
    )
    zero = F.lit(0.0)
    scored = encoded.drop("classes", "rare").join(class_scores(encoded, model), "row_id").join(sums, "row_id", "left")
    return scored.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("base", zero)).alias("base_score"),
        (F.col("class_score") + F.col("hot_within") + F.coalesce("within", zero)).alias("score"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """The model's and the base log10 probability of every document."""
    return score_texts(documents(spark, sf_dir))
