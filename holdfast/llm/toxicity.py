"""Toxicity by subword bags: character n-gram vectors averaged into a linear softmax.

A word is the bag of its hashed character n-grams (3 to 6 letters with the word's bounds); its
vector is the mean of theirs, so a misspelling that was never met shares most of its n-grams with
the word it comes from.  A passage (``WINDOW`` words, the next one starting half a
passage on) is the mean of its words' vectors; a linear softmax gives its probability.  A word of
over ``LONG`` letters is read in pieces that overlap by 5, so that each of its n-grams is in one, and
each piece counts as a word.  A run of one word counts once.  A text is as toxic as its worst passage, so that a few words in a very long text still count.

Embeddings and softmax are trained jointly, in numpy, by Adam.  In training, the passage of a text
that scores highest carries the text's label (others of a toxic text are not evidence).  The
fit reads at most ``MOST_TEXTS`` labelled texts of the training folds, whole, in an order that
hashes their ids, and at most ``MOST_BYTES`` of them; this bounds the fit only.  Scoring reads every
text whole.

Defined results: null and empty texts have no passage and score the softmax of the bias; a null
id counts as the empty text in folds, so is a training row; label rows with null label or id are
left out; an id with several labels is toxic if any says so; rows that share an id are scored
each; with no label of both kinds every text scores the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import documents, fold_of, lean, resident, words_of

WINDOW = 8
#: Letters of a word that is read at once, and of the pieces of a longer one.
LONG = 24
PIECE = 16
BUCKETS = 1 << 17
WIDTH = 12
#: The fit's sample: labelled rows at most, and bytes of their whole texts at most.
MOST_TEXTS = 10_000
MOST_BYTES = 24 << 20
#: Updates of 64 texts that a fit makes, whatever the size of the labelled set; whole rounds.
UPDATES = 1250


def grams(word: bytes) -> list[int]:
    """Hash buckets of the character n-grams of a word, or of a piece of one, whose bounds are its own."""
    text = word.decode("utf-8", "replace")
    body = text[1:] if text.startswith(" ") else f"<{text}>"
    return [zlib.crc32(body[i : i + n].encode()) % BUCKETS for n in (3, 4, 5, 6) for i in range(len(body) - n + 1)]


def pieces(word: bytes) -> list[bytes]:
    """The word itself, or the pieces of a long one with its bounds; a blank, which no word holds, marks them."""
    if len(word) <= LONG or len(text := word.decode("utf-8", "replace")) <= LONG:
        return [word]
    body = f"<{text}>"
    return [b" " + body[i : i + PIECE].encode() for i in range(0, len(body) - 5, PIECE - 5)]


def passage_words(text: str | None) -> list[bytes]:
    """The words of a text, long ones in pieces, a run of one counting once, so that no passage is one word over and over."""
    return [w for w, _ in groupby(p for w in words_of(text) for p in pieces(w))]


def windows(n: int, size: int = WINDOW) -> np.ndarray:
    """Start and end of each passage of a text with ``n`` words; the last one reaches its end."""
    if n == 0:
        return np.zeros((0, 2), dtype=np.int64)
    starts = np.arange(0, max(1, n - size // 2), size // 2) if n > size else np.array([0])
    return np.stack([starts, np.minimum(starts + size, n)], axis=1)


class Model:
    """Per-word logits of the trained vectors, kept for the words met, up to a bound."""

    def __init__(self, logit: np.ndarray, bias: float, most: int = 300_000) -> None:
        self.logit, self.bias, self.most = logit, bias, most
        self.known: dict[bytes, float] = {}

    def word(self, w: bytes) -> float:
        return float(self.logit[grams(w)].mean())

    def passages(self, words: list[bytes]) -> np.ndarray:
        """The logit of every passage."""
        known = self.known
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = list(set(words))
        if new:
            bags = [grams(w) for w in new]
            flat = self.logit[np.fromiter((g for b in bags for g in b), dtype=np.int64, count=sum(map(len, bags)))]
            sizes = np.fromiter(map(len, bags), dtype=np.int64, count=len(bags))
            means = np.add.reduceat(flat, np.cumsum(sizes) - sizes) / sizes
            known.update(zip(new, means.tolist(), strict=True))
        total = np.concatenate([[0.0], np.cumsum(np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words)))])
        at = windows(len(words))
        return (total[at[:, 1]] - total[at[:, 0]]) / (at[:, 1] - at[:, 0]) + self.bias

    def score(self, text: str | None) -> float:
        words = passage_words(text)
        logit = float(self.passages(words).max()) if words else self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def fit(texts: list[str], labels: list[int], *, updates: int = UPDATES, seed: int = 7, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Train vectors and softmax together; return each bucket's logit and the bias.

    The two-class softmax is trained as the difference of its two rows.
    """
    share = float(np.mean(labels)) if labels else 0.0
    if share in (0.0, 1.0):
        return np.zeros(BUCKETS, dtype=np.float32), 40.0 * (2 * share - 1)
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
    weight = (rng.standard_normal(WIDTH) / WIDTH).astype(np.float32)
    bias = np.float32(np.log(share / (1 - share)))
    vocabulary: dict[bytes, int] = {}
    ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in passage_words(t)), dtype=np.int32) for t in texts]
    flat_, sizes_ = array("i"), array("i")
    for w in vocabulary:
        bag = grams(w)
        flat_.extend(bag)
        sizes_.append(len(bag))
    del vocabulary
    flat, sizes = np.frombuffer(flat_, dtype=np.int32), np.frombuffer(sizes_, dtype=np.int32).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    spans = [windows(len(x)) for x in ids]
    y = np.asarray(labels, dtype=np.float32)
    m_v, s_v = np.zeros_like(vectors), np.zeros_like(vectors)
    m_w, s_w, m_b, s_b, step = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0, 0
    usable = np.array([i for i, x in enumerate(ids) if len(x)])
    for epoch in range(-(-updates // max(1, -(-len(usable) // 64)))):
        # The worst passage of each text under the vectors of this moment.
        logit = vectors @ weight
        per_word = np.add.reduceat(logit[flat], first[:-1]) / sizes
        picked = {}
        for i in usable:
            total = np.concatenate([[0.0], np.cumsum(per_word[ids[i]])])
            means = (total[spans[i][:, 1]] - total[spans[i][:, 0]]) / (spans[i][:, 1] - spans[i][:, 0])
            a, b = spans[i][int(means.argmax())] if epoch else (0, len(ids[i]))
            picked[i] = ids[i][a:b]
        for begin in range(0, len(usable), 64):
            batch = rng.permutation(usable)[:64] if begin == 0 else order[begin : begin + 64]
            if begin == 0:
                order = np.concatenate([batch, rng.permutation(np.setdiff1d(usable, batch))])
            words = [picked[i] for i in batch]
            counts = np.array([len(w) for w in words])
            word = np.concatenate(words)
            reach = sizes[word]
            slots = np.repeat(first[word] - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
            gram = flat[slots]
            share_of = np.repeat(1.0 / (reach * np.repeat(counts, counts)), reach).astype(np.float32)
            owner = np.repeat(np.repeat(np.arange(len(batch)), counts), reach)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
            mean = np.add.reduceat(vectors[gram] * share_of[:, None], edges, axis=0)
            p = 1 / (1 + np.exp(-np.clip(mean @ weight + bias, -30, 30)))
            error = ((p - y[batch]) / len(batch)).astype(np.float32)
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            g_w, g_b = error @ mean, float(error.sum())
            touched, back = np.unique(gram, return_inverse=True)
            pull = np.bincount(back, weights=share_of * error[owner], minlength=len(touched)).astype(np.float32)
            g_v = pull[:, None] * weight[None, :]
            m_v[touched] = 0.9 * m_v[touched] + 0.1 * g_v
            s_v[touched] = 0.999 * s_v[touched] + 0.001 * g_v**2
            vectors[touched] -= rate * fix * m_v[touched] / (np.sqrt(s_v[touched]) + 1e-8)
            m_w, s_w = 0.9 * m_w + 0.1 * g_w, 0.999 * s_w + 0.001 * g_w**2
            weight -= rate * fix * m_w / (np.sqrt(s_w) + 1e-8)
            m_b, s_b = 0.9 * m_b + 0.1 * g_b, 0.999 * s_b + 0.001 * g_b**2
            bias -= rate * fix * m_b / (np.sqrt(s_b) + 1e-8)
    return (vectors @ weight).astype(np.float32), float(bias)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int, most_bytes: int) -> list:
    """A bounded sample of labelled (text, label) rows outside the held-out fold, with whole texts.

    Rows come in an order that hashes the id: of the first ``most``, each whose text still fits into
    ``most_bytes`` together with those before it.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).dropna().groupBy("_id").agg(F.max("_label").alias("_label"))
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).filter(fold_of(F.col("_id"), parts) != held)
    rows = rows.withColumns({"_size": F.octet_length("_text"), "_tie": F.xxhash64("_text")})
    first = rows.select("_id", "_size", "_tie").join(marks, "_id").orderBy(F.xxhash64("_id"), "_id", "_tie").limit(most)
    taken, held_bytes = [], 0
    for r in first.collect():
        if held_bytes + r._size <= most_bytes:
            held_bytes += r._size
            taken.append((r._id, r._tie, r._label, len(taken)))
    if not taken:
        return []
    kind = rows.schema["_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(taken, f"_id {kind}, _tie long, label int, _place int").groupBy("_id", "_tie").agg(F.max("label").alias("label"), F.min("_place").alias("_place"), F.count(F.lit(1)).alias("_n"))
    found = rows.join(F.broadcast(chosen), ["_id", "_tie"]).groupBy("_place", "label", "_n").agg(F.first("_text").alias("text")).orderBy("_place").collect()
    return [r for r in found for _ in range(r._n)]


def train(docs: DataFrame, labels: DataFrame, *, most_texts: int = MOST_TEXTS, most_bytes: int = MOST_BYTES, parts: int = 5, held: int = 0) -> tuple[np.ndarray, float]:
    rows = training_rows(docs, labels, "toxic", parts, held, most_texts, most_bytes)
    return fit([r.text for r in rows], [r.label for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and the probability that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = _model(shared.value)
        for batch in batches:
            scores = pa.array([model_.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    return rows.mapInArrow(lean(run, keeps=True), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def _model(value: tuple[np.ndarray, float]) -> Model:
    """One model for each Python worker, so that its words stay known from task to task."""
    key = ("toxicity", value[1], float(value[0].sum()), float(value[0][::101].sum()))
    return resident(key, lambda: Model(*value))


def op2(spark, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, plain = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = _model(shared.value)
        for batch in batches:
            scores = pa.array([model_.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*plain, "score"])

    # Under plain names on the way: the table's own may hold any mark.
    fields = [StructField(n, f.dataType) for n, f in zip(plain, docs.schema.fields, strict=True)]
    scored = docs.toDF(*plain).mapInArrow(lean(run, keeps=True), StructType([*fields, StructField("score", DoubleType())]))
    return scored.filter(F.col("score") < limit).drop("score").toDF(*docs.columns)
