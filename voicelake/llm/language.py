"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary classifier over hashed character n-grams (the log-odds of an n-gram
between the languages whose bit is 1 and the others) gives a margin. Decoding adds up the logistic losses of the margins
against each codeword, weighted by how reliable the bit was on labelled texts; the nearest codeword wins, and a second
one close by flags the answer as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelake.llm.common import HELD_OUT, fold, whole

BITS = 14
BUCKETS = 1 << BITS
#: What one unit of mean log-odds counts in the loss.
SHARPNESS = 12.0
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # bits
    ambiguous_below: float = 0.8


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: every split of up to six languages, beyond that the best of many seeded random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = np.arange(2 ** (n - 1) - 1)  # all but the column where everyone is 1
        return np.stack([np.ones(len(columns))] + [np.where(columns >> i & 1, 1.0, -1.0) for i in range(n - 1)])
    rng, best, far = np.random.default_rng(0), None, -1
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, length))
        split = np.abs(code.sum(axis=0)) < n
        distance = ((code[:, None, :] != code[None]) & split).sum(axis=2)[~np.eye(n, dtype=bool)].min()
        if distance > far:
            best, far = code[:, split], distance
    return best


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter pairs and triples, with word ends, of a whole text; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters()[points]
    if not letter.any():
        return None
    points = np.concatenate(([0], np.where(letter, points, 0), [0])).astype(np.uint32)
    mixed = points * np.uint32(0x9E3779B1)
    pair = mixed[:-1] * np.uint32(31) + mixed[1:]
    triple = pair[:-1] * np.uint32(0x85EBCA6B) + mixed[2:]
    keep = letter  # the middle of each triple
    found = np.concatenate((pair[:-1][keep] ^ np.uint32(0x27D4EB2F), triple[keep]))
    found = (found ^ (found >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount(found >> np.uint32(32 - BITS), minlength=BUCKETS)


def margins(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(counts)
    return counts[at] @ weights[at] / counts.sum()


def training_rows(docs: DataFrame, per_language: int, id: str, text: str, lang: str) -> DataFrame:
    """(lang, text) of about `per_language` documents of each language outside the held-out fold, all if it has fewer.

    A document is taken if the hash of its id lies below the language's share of the hash range: one count per language
    is all that is needed, so a language with most of the rows is no hot group.
    """
    own = docs.select(F.col(id).alias("__id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & (fold(F.col("__id")) != HELD_OUT))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not sizes:
        return own.select("lang", "text").limit(0)
    limits = {name: -(2**63) + min(2**64 - 1, (2**64 - 1) * per_language // n) for name, n in sizes.items()}
    below = F.create_map(*[F.lit(x) for name, limit in limits.items() for x in (name, limit)])
    return own.where(F.xxhash64("__id") <= below[F.col("lang")]).select("lang", "text")


def learn(docs: DataFrame, per_language: int = 3000, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit the classifiers on about `per_language` documents a language; count sums are all that reaches the driver."""
    rows = training_rows(docs, per_language, id, text, lang)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, value in zip(batch["lang"], batch["text"]):
                found = ngram_counts(value)
                if found is not None:
                    sums[language] = sums.get(language, 0) + found
        for language, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": language, "bucket": at.astype("int32"), "n": total[at]})

    table = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = table.toPandas()  # languages x buckets at most
    languages = sorted(found["lang"].unique())
    totals = np.zeros((len(languages), BUCKETS))
    totals[found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=int), found["bucket"].to_numpy()] = found["n"].to_numpy()
    code = codewords(len(languages))
    share = (totals + 0.5) / (totals + 0.5).sum(axis=1, keepdims=True) if languages else totals
    weights = np.zeros((BUCKETS, code.shape[1]))
    for b in range(code.shape[1]):
        ones, others = code[:, b] > 0, code[:, b] < 0
        if ones.any() and others.any():
            weights[:, b] = np.log(share[ones].mean(axis=0)) - np.log(share[others].mean(axis=0))
    model = Model(languages, code, weights, np.ones(code.shape[1]))
    if len(languages) > 1:
        model.trust = reliability(rows, model)
    return model


def reliability(rows: DataFrame, model: Model) -> np.ndarray:
    """Half the log-odds of each bit being right on the training rows."""
    names = {x: i for i, x in enumerate(model.languages)}

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right, seen = np.zeros(model.code.shape[1]), 0
        for batch in batches:
            for language, value in zip(batch["lang"], batch["text"]):
                found = ngram_counts(value)
                if found is not None:
                    right += margins(found, model.weights) * model.code[names[language]] > 0
                    seen += 1
        yield pd.DataFrame({"bit": np.arange(len(right), dtype="int32"), "right_n": right, "seen": float(seen)})

    sums = rows.mapInPandas(judge, "bit int, right_n double, seen double").groupBy("bit").agg(F.sum("right_n").alias("r"), F.sum("seen").alias("s")).toPandas().sort_values("bit")
    rate = (sums["r"].to_numpy() + 0.5) / (sums["s"].to_numpy() + 1)
    return np.maximum(0.05, 0.5 * np.log(rate / (1 - rate)))


def decode(margin: np.ndarray, model: Model) -> tuple[str, float, bool]:
    """(language, its share of exp(-loss), ambiguous)."""
    losses = np.log1p(np.exp(-model.code * margin * SHARPNESS)) @ model.trust
    share = np.exp(losses.min() - losses)
    share /= share.sum()
    best = int(np.argmax(share))
    return model.languages[best], float(share[best]), bool(share[best] < model.ambiguous_below)


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row per row, from the whole text alone.

    A null text or one without a letter is `und` with score 0; so is every text if no language was learned. Equal texts
    have equal answers; ties between codewords go to the first language in order. Other columns are not read.
    """

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch:
                found = ngram_counts(value) if model.languages else None
                rows.append((UNDETERMINED, 0.0, True) if found is None else decode(margins(found, model.weights), model))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "ambiguous"])

    read = docs.select(F.col(id).alias("doc_id"), (fold(F.col(id)) == HELD_OUT).alias("held_out"), answer(whole(F.col(text))).alias("__a"))
    return read.select("doc_id", "held_out", "__a.*")
