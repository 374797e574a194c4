"""Quality by a linear-chain conditional random field over the lines of a text.

Every line that is not blank is labelled good or bad.  Its features are its own shares of letters, capitals,
digits, marks and repeats, and those of the lines before and after it.  Forward-backward gives
each line's marginal; the score of a text is their mean, weighted by the lines' bytes.

The fit takes the label of a text for each of its lines.  It reads at most ``MOST_TEXTS`` labelled
texts outside the held-out fold, whole, in an order that hashes their ids, and at most
``MOST_BYTES`` of them; this bounds the fit only.  Scoring reads every text whole.

Defined results: a null text, an empty one and one of blank lines score the training share of good
texts; ids and labels that are null, repeated or missing are treated as in the toxicity operator
(an id with several labels is good if any says so); with one kind of label, or none, every text
scores that share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, fold_of
from .toxicity import training_rows

MOST_TEXTS = 8_000
MOST_BYTES = 20 << 20
ROUNDS = 150

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
for _marks, _kind in ((b".,;:?'\"()-", 4), (b"!", 5), (b"|", 6), (b"$%&*#@^~_=+<>[]{}\\/`", 7), (b" \t\r\v\f", 8), (b"\n", 9)):
    _KIND[np.frombuffer(_marks, dtype=np.uint8)] = _kind
_KIND[128:] = 10
_KINDS = 11
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Own features of a line: ten shares by kind of byte, then those named in line_features().
OWN = 18


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * (out[have - 1 : have] * base)
        have += take
    return out


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (without neighbours), bytes and owner text of every line that is not blank."""
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    kind = _KIND[buf]
    ends = np.flatnonzero(kind == 9)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    owner = np.searchsorted(text_ends, ends)
    counts = np.stack([np.diff(np.concatenate([[0], np.cumsum(kind == k)[ends]])) for k in range(_KINDS)], axis=1).astype(np.float64)
    size = (ends - starts).astype(np.float64)
    solid = size - counts[:, 8]
    # Words by a polynomial hash, from sums up to each byte.
    inside = (kind != 8) & (kind != 9)
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    last = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]]))
    power = _powers(len(buf), _BASE)
    total = np.concatenate([[np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power)])
    undo = _powers(len(buf), np.uint64(pow(int(_BASE), -1, 1 << 64)))
    word = (total[last + 1] - total[first]) * undo[first]
    word_line = np.searchsorted(ends, first)
    same = np.zeros(len(word), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (word_line[1:] == word_line[:-1])
    lines = len(ends)
    n_words = np.bincount(word_line, minlength=lines).astype(np.float64)
    n_same = np.bincount(word_line, weights=same, minlength=lines)
    end_kind = kind[last] if len(last) else np.zeros(0, dtype=np.uint8)
    n_marked = np.bincount(word_line, weights=(end_kind == 7), minlength=lines)
    n_loud = np.bincount(word_line, weights=(end_kind == 5), minlength=lines)
    short = np.bincount(word_line, weights=(last - first < 3), minlength=lines)
    line_hash = (total[ends] - total[starts]) * undo[starts]
    key = line_hash ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    tail = np.where(size > 0, kind[np.maximum(ends - 1, 0)], 0)
    n = np.maximum(solid, 1)
    w = np.maximum(n_words, 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 10], 1)
    own = np.column_stack([
        counts[:, 1] / letters, counts[:, 2] / letters, counts[:, 3] / n, counts[:, 4] / n, counts[:, 5] / n, counts[:, 6] / n, counts[:, 7] / n,
        counts[:, 8] / np.maximum(size, 1), counts[:, 10] / n, np.log1p(solid) / 5, np.minimum(n / w, 30) / 10,
        n_same / w, n_marked / w, n_loud / w, short / w, times[back] > 1, tail == 4, np.log1p(n_words) / 5,
    ])
    live = solid > 0
    return own[live], solid[live], owner[live]


def with_neighbours(own: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after in the same text, first, last and one."""
    out = np.zeros((len(own), 3 * OWN + 3), dtype=np.float64)
    if not len(own):
        return out
    before = np.concatenate([[False], owner[1:] == owner[:-1]])
    after = np.concatenate([before[1:], [False]])
    out[:, :OWN] = own
    out[before, OWN : 2 * OWN] = own[np.flatnonzero(before) - 1]
    out[after, 2 * OWN : 3 * OWN] = own[np.flatnonzero(after) + 1]
    out[:, -3], out[:, -2], out[:, -1] = ~before, ~after, 1
    return out


class Chains:
    """Lines of many texts, stepped through in parallel: step t has the texts of over t lines."""

    def __init__(self, owner: np.ndarray) -> None:
        self.texts, first, counts = np.unique(owner, return_index=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        first, counts = first[order], counts[order]
        steps = int(counts[0]) if len(counts) else 0
        live = np.searchsorted(-counts, -np.arange(steps), side="left")
        self.steps = [first[:n] + t for t, n in enumerate(live)]
        self.last = (first + counts - 1) if len(counts) else np.zeros(0, dtype=np.int64)

    def run(self, unary: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of each line (bad, good), expected moves and the log partition, summed.

        ``unary`` holds each line's two scores, ``move[a, b]`` the score of b after a.
        """
        top = unary.max(axis=1, keepdims=True)
        u, m = np.exp(unary - top), np.exp(move)
        forward, scale = np.empty_like(u), np.empty(len(u))
        for t, at in enumerate(self.steps):
            a = u[at] if t == 0 else (forward[self.steps[t - 1][: len(at)]] @ m) * u[at]
            s = a.sum(axis=1)
            forward[at], scale[at] = a / s[:, None], s
        backward = np.ones_like(u)
        moves = np.zeros((2, 2))
        for t in range(len(self.steps) - 1, 0, -1):
            at = self.steps[t]
            before = self.steps[t - 1][: len(at)]
            right = u[at] * backward[at] / scale[at][:, None]
            moves += (forward[before].T @ right) * m
            backward[before] = right @ m.T
        return forward * backward, moves, float(np.log(scale).sum() + top.sum())


def fit(texts: list[str], labels: list[int], *, rounds: int = ROUNDS) -> dict:
    """Train the field by Adam on the mean log-likelihood of a text, with a small quadratic penalty."""
    share = float(np.mean(labels)) if labels else 0.5
    # A few texts at a time: the sums over bytes take many times the bytes.
    chunks = [line_features(texts[i : i + 200]) for i in range(0, len(texts), 200)]
    own = np.concatenate([c[0] for c in chunks]) if chunks else np.zeros((0, OWN))
    owner = np.concatenate([c[2] + 200 * i for i, c in enumerate(chunks)]) if chunks else np.zeros(0, dtype=np.int64)
    del chunks
    model = {"share": share, "mean": np.zeros(OWN), "spread": np.ones(OWN), "weight": None, "move": np.zeros((2, 2))}
    if share in (0.0, 1.0) or not labels or not len(own):
        return model
    model["mean"], model["spread"] = own.mean(axis=0), own.std(axis=0) + 1e-3
    x = with_neighbours((own - model["mean"]) / model["spread"], owner)
    y = np.asarray(labels)[owner]
    chains = Chains(owner)
    n = len(chains.texts)
    inner = np.concatenate([[False], owner[1:] == owner[:-1]])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        unary = np.column_stack([np.zeros(len(x)), x @ theta[:-4]])
        marginals, moves, _ = chains.run(unary, theta[-4:].reshape(2, 2))
        g = np.concatenate([x.T @ (marginals[:, 1] - y), (moves - seen).ravel()]) / n + 1e-4 * theta
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        theta -= 0.05 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m / (np.sqrt(s) + 1e-8)
    model["weight"], model["move"] = theta[:-4], theta[-4:].reshape(2, 2)
    return model


def line_marginals(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of good, bytes and owner text of every line that is not blank."""
    own, size, owner = line_features(texts)
    if model["weight"] is None or not len(own):
        return np.full(len(own), model["share"]), size, owner
    x = with_neighbours((own - model["mean"]) / model["spread"], owner)
    unary = np.column_stack([np.zeros(len(x)), x @ model["weight"]])
    return Chains(owner).run(unary, model["move"])[0][:, 1], size, owner


def text_scores(texts: list[str | None], model: dict) -> np.ndarray:
    good, size, owner = line_marginals(texts, model)
    weight = np.bincount(owner, weights=size, minlength=len(texts))
    return np.clip(np.where(weight > 0, np.bincount(owner, weights=size * good, minlength=len(texts)) / np.maximum(weight, 1), model["share"]), 0, 1)


def train(docs: DataFrame, labels: DataFrame, *, most_texts: int = MOST_TEXTS, most_bytes: int = MOST_BYTES, parts: int = 4, held: int = 2) -> dict:
    rows = training_rows(docs, labels, "quality", parts, held, most_texts, most_bytes)
    return fit([r.text for r in rows], [r.label for r in rows])


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", chars: int = 4 << 20) -> DataFrame:
    """doc_id and the quality of each text, ``chars`` characters of whole texts at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            begin, held, scores = 0, 0, []
            for i, t in enumerate(texts):
                held += len(t or "")
                if held >= chars or i == len(texts) - 1:
                    scores.append(text_scores(texts[begin : i + 1], shared.value))
                    begin, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
