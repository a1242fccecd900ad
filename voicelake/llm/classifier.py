"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network on them.

Random indexing gives every word a fixed sparse index vector of a few +1 and -1, and as its context vector the sum of the
index vectors of its neighbours in all documents. The sums are integers, so they do not depend on the order of the rows.
A document is the weighted mean and spread of its words' context vectors, and the mean likeness of each word to the next. A network with one hidden layer is trained in
numpy on a bounded sample of labelled rows; a temperature fitted on rows it has not seen calibrates its probabilities.

Words share BUCKETS hashed rows, so that the vectors have the same size (8 MB) whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.llm.common import whole

BITS, DIM, NONZERO, REACH = 16, 32, 4, 2
BUCKETS = 1 << BITS
#: The fold that no model learns from: crc32 of the id as text, modulo FOLDS.
FOLDS, UNSEEN = 3, 1
#: Bytes of text whose tokens a task holds at a time.
SLICE_BYTES = 4 << 20
#: Tokens whose vectors a task holds at a time.
SLICE_TOKENS = 1 << 14
#: A word with this share of all tokens weighs half.
COMMON = 1e-3
FEATURES = 2 * DIM + 2
#: Bucket of the mark before a word whose second letter is a capital.
CAPITAL = 1

WORD = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
BLANK = np.array([b in b" \t\x0b\x0c\r\0" for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; n is a power of two, so few lengths occur."""
    values = np.full(n, base, np.uint64)
    values[0] = 1
    return np.cumprod(values, dtype=np.uint64)


def tokens(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token, text of each token): runs of letters, and every other character that is no blank.

    The hash of a run is a difference of prefix sums, divided by the power of its place.
    """
    raw = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    data = LOWER[raw]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = 1 << max(16, (n - 1).bit_length())
    inside = WORD[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * powers(PRIME, size)[:n], dtype=np.uint64, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(INVERSE, size)[starts]
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    words = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    marks = np.flatnonzero(~inside & ~BLANK[data])
    loud = starts[raw[starts + 1] != data[starts + 1]]  # every text ends with a separator
    at = np.concatenate((loud, starts, marks))
    order = np.argsort(at, kind="stable")
    bucket = np.concatenate((np.full(len(loud), CAPITAL), words, data[marks].astype(np.int64)))[order]
    return bucket, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at[order], "right")


@lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(20)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def contexts(bucket: np.ndarray, text: np.ndarray, sums: np.ndarray) -> None:
    """Add the index vectors of the neighbours of each token to the context vector of its bucket."""
    place, sign = index_vectors()
    for reach in range(1, REACH + 1):
        near = text[reach:] == text[:-reach]
        left, right = bucket[:-reach][near], bucket[reach:][near]
        for word, other in ((left, right), (right, left)):
            sums += np.bincount(((word * DIM)[:, None] + place[other]).ravel(), sign[other].ravel(), BUCKETS * DIM)


def slices(texts: Iterator[str | None], limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Vectors:
    words: np.ndarray  # buckets x dim, unit length
    weight: np.ndarray  # buckets

    def pool(self, texts: Sequence[bytes]) -> np.ndarray:
        """Weighted mean and spread of the vectors of each text's tokens, and the likeness of neighbours; zeros for a text without any."""
        bucket, text = tokens(texts)
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        return np.array([self.pool_tokens(bucket[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]).reshape(len(texts), FEATURES)

    def pool_tokens(self, bucket: np.ndarray) -> np.ndarray:
        if not len(bucket):
            return np.zeros(FEATURES)
        first, second, total, alike = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
        for start in range(0, len(bucket), SLICE_TOKENS):
            part = bucket[start : start + SLICE_TOKENS + 1]  # one more, for the likeness of neighbours
            vectors = self.words[part]
            alike += float(np.einsum("ij,ij->", vectors[:-1], vectors[1:]))
            own, weight = vectors[:SLICE_TOKENS], self.weight[part[:SLICE_TOKENS]]
            first += weight @ own
            second += weight @ (own * own)
            total += float(weight.sum())
        mean, pairs = first / total, max(1, len(bucket) - 1)
        spread = np.sqrt(np.maximum(0, second / total - mean**2))
        return np.concatenate((mean, spread, [alike / pairs, np.count_nonzero(bucket[1:] == bucket[:-1]) / pairs]))


def learn_vectors(docs: DataFrame, text: str = "text") -> Vectors:
    """Context vectors from all documents; BUCKETS rows of sums are all that reaches the driver."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, np.int64)  # whole numbers
        for texts in slices(t for batch in batches for t in batch["text"]):
            bucket, own = tokens(texts)
            counts += np.bincount(bucket, minlength=BUCKETS)
            contexts(bucket, own, sums)
        at = np.flatnonzero(counts)
        found = pd.DataFrame(sums.reshape(BUCKETS, DIM)[at].astype(np.int64), columns=[f"v{i}" for i in range(DIM)])
        found.insert(0, "n", counts[at])
        found.insert(0, "bucket", at.astype(np.int32))
        yield found

    fields = "bucket int, n bigint, " + ", ".join(f"v{i} bigint" for i in range(DIM))
    table = docs.select(F.col(text).alias("text")).mapInPandas(gather, fields)
    added = table.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM)]).toPandas()
    words, weight = np.zeros((BUCKETS, DIM), np.float32), np.ones(BUCKETS, np.float32)
    at = added["bucket"].to_numpy()
    sums = added[[f"v{i}" for i in range(DIM)]].to_numpy(dtype=float)
    words[at] = sums / np.maximum(1, np.linalg.norm(sums, axis=1, keepdims=True))
    weight[at] = COMMON / (COMMON + added["n"].to_numpy() / max(1, added["n"].sum()))
    return Vectors(words, weight)


@dataclass
class Network:
    """score = sigmoid((relu(x W1 + b1) W2 + b2) / temperature) on standardized features."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.maximum(0, (features - self.mean) / self.scale @ self.first + self.first_bias)
        return (hidden * self.second).sum(axis=1) + self.second_bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return np.round(sigmoid(self.logits(features) / self.temperature), 9)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def loss(logits: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - labels * logits)) if len(labels) else 0.0


def train(features: np.ndarray, labels: np.ndarray, hidden: int = 24, rounds: int = 400, decay: float = 2e-3) -> Network:
    """Full-batch Adam with weight decay; the round that is best on every fifth row gives the weights and the temperature.

    Without rows of both labels the network is constant at the share of label 1 (one half without rows).
    """
    rng = np.random.default_rng(7)
    mean, scale = (features.mean(axis=0), features.std(axis=0) + 1e-6) if len(labels) else (np.zeros(FEATURES), np.ones(FEATURES))
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    net = Network(mean, scale, rng.normal(0, (2 / features.shape[1]) ** 0.5, (features.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    check = np.arange(len(labels)) % 5 == 4
    x, y = (features[~check] - mean) / scale, labels[~check]
    if len(set(y.tolist())) < 2:
        return net
    net.second = rng.normal(0, (1 / hidden) ** 0.5, hidden)
    values = [net.first, net.first_bias, net.second, np.array([net.second_bias])]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    best, kept = np.inf, None
    for step in range(1, rounds + 1):
        raw = x @ values[0] + values[1]
        active = np.maximum(0, raw)
        error = (sigmoid(active @ values[2] + values[3][0]) - y) / len(y)
        back = np.outer(error, values[2]) * (raw > 0)
        slopes = [x.T @ back + decay * values[0], back.sum(axis=0), active.T @ error + decay * values[2], np.array([error.sum()])]
        for value, slope, (m, v) in zip(values, slopes, moments):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope**2 - v)
            value -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        net.first, net.first_bias, net.second, net.second_bias = values[0], values[1], values[2], float(values[3][0])
        if check.any() and (now := loss(net.logits(features[check]), labels[check])) < best:
            best, kept = now, [v.copy() for v in values]
    if kept:
        net.first, net.first_bias, net.second, net.second_bias = kept[0], kept[1], kept[2], float(kept[3][0])
        logits = net.logits(features[check])
        net.temperature = float(min(np.geomspace(0.25, 8, 101), key=lambda t: loss(logits / t, labels[check])))
    return net


@dataclass
class Model:
    vectors: Vectors
    network: Network


def fold(id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as the empty text."""
    return F.crc32(whole(id.cast("string")).cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Vectors from all documents, the network from at most `max_rows` labelled rows outside the held-out fold.

    The labelled rows with the smallest hashes of their ids are taken, so the bound favours no order; only their pooled
    vectors reach the driver. Rows with a null id or label are not used; a repeated row counts as often as it stands.
    """
    vectors = learn_vectors(docs, text)
    seen = labels.select(F.col(id).alias("id"), F.col(label).cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("id").isNotNull() & (fold(F.col("id")) != UNSEEN))
    sample = seen.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")  # bounded by max_rows

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = vectors.pool([(t or "").encode("utf-8", "replace") for t in batch["text"]])
            yield pd.DataFrame({"id": batch["id"].astype(str), "label": batch["label"], "features": list(found)})

    # repeated documents could multiply a label; the bound holds for what reaches the driver, too
    found = rows.mapInPandas(pooled, "id string, label double, features array<double>").orderBy(F.xxhash64("id"), "id", "label", "features").limit(max_rows).toPandas()
    features = np.stack(found["features"].tolist()) if len(found) else np.zeros((0, FEATURES))
    return Model(vectors, train(features, (found["label"].to_numpy(dtype=float) > 0.5).astype(float)))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row, from the whole text alone.

    A null text reads as the empty one; a text without tokens has the score of zero vectors. Equal texts have equal
    scores. Other columns are not read.
    """

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [model.network.scores(model.vectors.pool(part)) for part in slices(iter(batch))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    rows = docs.select(F.col(id).alias("doc_id"), (fold(F.col(id)) == UNSEEN).alias("held_out"), rate(whole(F.col(text))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
