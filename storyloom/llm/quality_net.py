"""Quality classifier: a byte-level convolutional network in numpy.

A filter weighs four bytes in a row. Its answers over a text are max-pooled in chunks of 512 bytes that overlap
by half and cover the whole text; the chunks' largest and mean answers are combined by a logistic layer into
one probability. Training is by hand-written gradients on a bounded sample; scoring is a map over all rows.

Parameters of the fit: at most ``TRAIN_ROWS`` rows of each label, those with the least hash of their id; of texts
longer than ``TRAIN_CHARS`` four slices, evenly spread, of that length together. Both classes weigh the same in the fit; the share of labels among all
training rows is put back into the probability afterwards.

Defined results: a null or empty text is scored as one zero byte; rows without a label are scored like all
others; where training labels are missing or of one kind the score is their (smoothed) share; repeated rows
each get a row; of contradicting labels of one id the larger counts; an empty table gives no rows; extra columns
are ignored. Texts of any length are scored whole, some thousand blocks at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import id_and_text, per_batch

WIDTH, FILTERS, BLOCK = 4, 16, 256
TRAIN_ROWS, TRAIN_CHARS = 1500, 16_384
EPOCHS, BATCH_BYTES, RATE, DECAY, SEED = 6, 160_000, 0.02, 1e-5, 11
FOLDS, HELD_OUT, CUT = 4, 2, 0.7
SLICE = 4096 * BLOCK
Weights = dict[str, np.ndarray]


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is in none."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


def _padded(text: bytes) -> tuple[np.ndarray, int]:
    n = max(len(text), 1)
    octets = np.zeros(-(-n // BLOCK) * BLOCK + WIDTH - 1, dtype=np.uint8)
    octets[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return octets, n


class Network:
    """Scores texts with given weights; filters are summed up in two tables over pairs of bytes."""

    def __init__(self, weights: Weights):
        t = weights["filters"].astype(np.float32)
        self.first = (t[0][:, None] + t[1][None, :] + weights["bias"].astype(np.float32)).reshape(-1, FILTERS)
        self.second = (t[2][:, None] + t[3][None, :]).reshape(-1, FILTERS)
        self.out, self.shift = weights["out"].astype(np.float64), float(weights["shift"][0])

    def blocks(self, text: bytes) -> Iterator[np.ndarray]:
        """Largest answers in each block of the text, some thousand blocks at a time."""
        octets, n = _padded(text)
        for at in range(0, n, SLICE):
            part = octets[at : at + SLICE + WIDTH - 1]
            pairs = part[:-1].astype(np.uint16) << 8 | part[1:]
            answers = self.first[pairs[:-2]]
            answers += self.second[pairs[2:]]
            answers[max(n - at, 0) :] = -np.inf
            top, size = answers.reshape(-1, BLOCK, FILTERS), BLOCK
            while size > 1:
                size //= 2
                top = np.maximum(top[:, :size], top[:, size : 2 * size])
            yield top[:, 0]

    def logit(self, text: bytes) -> float:
        most, total, chunks, last = np.zeros(FILTERS), np.zeros(FILTERS), 0, None
        for top in self.blocks(text):
            if last is not None:
                top = np.concatenate([last, top])
            joined = np.maximum(np.maximum(top[:-1], top[1:]), 0)
            most, total, chunks, last = np.maximum(most, joined.max(axis=0, initial=0)), total + joined.sum(axis=0, dtype=np.float64), chunks + len(joined), top[-1:]
        if not chunks:  # a single block is the only chunk
            most = total = np.maximum(last[0], 0).astype(np.float64)
            chunks = 1
        return float(most @ self.out[:FILTERS] + total @ self.out[FILTERS:-1] / chunks + self.out[-1]) + self.shift

    def score(self, text: bytes) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.logit(text)))))


def _answers(filters: np.ndarray, bias: np.ndarray, octets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest answers of each chunk, where they are) of one padded text."""
    size = len(octets) - WIDTH + 1
    found = bias + sum(filters[j][octets[j : j + size]] for j in range(WIDTH))
    found[n:] = -np.inf
    top = found.reshape(-1, BLOCK, FILTERS)
    at = top.argmax(axis=1)
    value = np.take_along_axis(top, at[:, None], axis=1)[:, 0]
    at = at + np.arange(len(at))[:, None] * BLOCK
    if len(value) > 1:
        later = value[1:] > value[:-1]
        value, at = np.where(later, value[1:], value[:-1]), np.where(later, at[1:], at[:-1])
    return value, at


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """Weights fitted by Adam over shuffled batches; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    params = {
        "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, dtype=np.float32),
        "out": np.concatenate([rng.normal(0, 0.1, 2 * FILTERS), [0.0]]).astype(np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    step = 0
    for _ in range(epochs):
        grads, size, used = None, 0, 0
        for k in rng.permutation(len(texts)):
            if grads is None:
                grads, size, used = {name: np.zeros_like(v) for name, v in params.items()}, 0, 0
            octets, n = _padded(texts[k])
            value, at = _answers(params["filters"], params["bias"], octets, n)
            live = np.maximum(value, 0)
            best = live.argmax(axis=0)
            most, mean = live[best, np.arange(FILTERS)], live.mean(axis=0)
            features = np.concatenate([most, mean, [1.0]])
            error = weight[k] * (1 / (1 + np.exp(-np.clip(features @ params["out"], -60, 60))) - labels[k])
            grads["out"] += error * features
            back = np.broadcast_to(error * params["out"][FILTERS:-1] / len(live), live.shape).copy()
            back[best, np.arange(FILTERS)] += error * params["out"][:FILTERS]
            back *= value > 0
            grads["bias"] += back.sum(axis=0)
            column = np.broadcast_to(np.arange(FILTERS), at.shape)
            for j in range(WIDTH):
                np.add.at(grads["filters"][j], (octets[at + j], column), back)
            size, used = size + n, used + 1
            if size >= BATCH_BYTES:
                step += 1
                _adam(params, grads, used, first, second, step)
                grads = None
        if grads is not None:
            step += 1
            _adam(params, grads, used, first, second, step)
    return params | {"shift": np.zeros(1)}


def _adam(params: Weights, grads: Weights, used: int, first: Weights, second: Weights, step: int) -> None:
    for k, g in grads.items():
        g = g / used + DECAY * params[k]
        first[k] = 0.9 * first[k] + 0.1 * g
        second[k] = 0.999 * second[k] + 0.001 * g * g
        params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def sampled(text: Column, chars: int | None = TRAIN_CHARS) -> Column:
    """The text, or four slices of one longer than ``chars``; None for whole texts."""
    if chars is None:
        return text
    size, n = chars // 4, F.length(text)
    slices = [F.substring(text, F.floor(k * (n - size) / 3).cast("int") + 1, F.lit(size)) for k in range(4)]
    return F.when(n <= chars, text).otherwise(F.concat(*slices))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, chars: int | None = TRAIN_CHARS,
) -> Weights:
    """Weights learned from the labelled rows outside the held-out fold; a bounded sample comes to the driver.

    It has ``train_rows`` rows of each label and ``chars`` characters of each text at most.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    prior = math.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1))
    sample = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows) for v in (0, 1)]
    chosen = F.broadcast(sample[0].unionByName(sample[1]))  # 2 * train_rows rows at most
    rows = (
        id_and_text(docs, id_col, text_col).join(chosen, "doc_id").select("doc_id", "label", sampled(F.col("text"), chars).alias("text"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * train_rows).collect()
    )
    texts, y = [(r["text"] or "").encode("utf-8", "surrogatepass") for r in rows], np.array([r["label"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        empty = train([], np.zeros(1), epochs=0)
        return empty | {"out": np.zeros(2 * FILTERS + 1), "shift": np.array([prior])}
    return train(texts, y) | {"shift": np.array([prior])}


def score(df: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(weights)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [network.score(x.as_py() or b"") for x in batch.column(1).cast(pa.binary())]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.float64())], ["doc_id", "score"])

        yield from per_batch(run)(batches)

    return id_and_text(df, id_col, text_col).mapInArrow(apply, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    found = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return found.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
