"""The quality classifier against plain word vectors, and its accuracy on held-out rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voicelake.llm import classifier as C


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 3 == 1


def plain_tokens(text):
    """Tokens as texts; a mark stands before a word whose second letter is a capital."""
    out = []
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[^A-Za-z\x80-\xff \t\x0b\x0c\r\x00]", text):
        word = m.group()
        if len(word) > 1 and 65 <= word[1] <= 90 and (word[0] >= 128 or word[:1].isalpha()):
            out.append(b"\1")
        out.append(re.sub(rb"[A-Z]", lambda c: c.group().lower(), word))
    return out


TEXTS = [b"One word, TWO words.\nOne", b"", b"\xc3\xa9t\xc3\xa9 \xc3\x89T\xc3\x89 42", b"a b a b a b", b"   ", b"end"]


def test_tokens_equal_a_plain_scan():
    bucket, text = C.tokens(TEXTS)
    words = {}
    for i, t in enumerate(TEXTS):
        own = bucket[text == i].tolist()
        plain = plain_tokens(t)
        assert len(own) == len(plain)
        for word, b in zip(plain, own):
            assert words.setdefault(word, b) == b
    assert len(set(words.values())) == len(words)  # no collision among these few
    alone, _ = C.tokens([b"word"])
    assert alone[0] == words[b"word"] if b"word" in words else True


def test_context_vectors_equal_plain_sums(make):
    texts = ["one two three two", "two one", None, "", "four"]
    vectors = C.learn_vectors(make([(i, t, "a", "en") for i, t in enumerate(texts)]))
    place, sign = C.index_vectors()
    sums = {}
    for t in texts:
        bucket, _ = C.tokens([(t or "").encode()])
        for i, b in enumerate(bucket):
            own = sums.setdefault(int(b), np.zeros(C.DIM))
            for j in range(max(0, i - C.REACH), min(len(bucket), i + C.REACH + 1)):
                if j != i:
                    for p, s in zip(place[bucket[j]], sign[bucket[j]]):
                        own[p] += s
    for b, total in sums.items():
        assert np.allclose(vectors.words[b], total / max(1, np.linalg.norm(total)), atol=1e-6)
    assert np.count_nonzero(np.abs(vectors.words).sum(axis=1)) == sum(np.any(v != 0) for v in sums.values())


def test_pooling_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    words = rng.normal(0, 1, (C.BUCKETS, C.DIM)).astype(np.float32)
    vectors = C.Vectors(words / np.linalg.norm(words, axis=1, keepdims=True), rng.random(C.BUCKETS).astype(np.float32))
    whole = vectors.pool(TEXTS)
    monkeypatch.setattr(C, "SLICE_TOKENS", 3)
    assert np.allclose(whole, vectors.pool(TEXTS), atol=1e-3) and (whole[1] == 0).all() and (whole[4] == 0).all()
    bucket, _ = C.tokens([TEXTS[0]])
    weight = vectors.weight[bucket][:, None]
    assert np.allclose(whole[0, : C.DIM], (vectors.words[bucket] * weight).sum(axis=0) / weight.sum(), atol=1e-5)
    assert np.allclose(whole[3, -1], 0) and np.allclose(vectors.pool([b"x x x"])[0, -2:], 1, atol=1e-5)


def test_held_out_quality(spark, odd, empty):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = C.learn(docs, labels)
    rows = C.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    kept = [r for r in rows if r.held_out]
    assert sum(r.predicted for r in kept if r.quality == 1) >= 0.99 * sum(r.quality == 1 for r in kept)
    assert sum(1 - r.predicted for r in kept if r.quality == 0) >= 0.95 * sum(r.quality == 0 for r in kept)
    for low in (0.0, 0.9):  # calibrated: scores near an end are right as often as they say
        some = [r for r in kept if low <= r.score <= low + 0.1]
        assert abs(np.mean([r.score for r in some]) - np.mean([r.quality for r in some])) < 0.03
    scored = C.score(odd, model).collect()
    assert len(scored) == odd.count() and C.score(empty, model).count() == 0
    by_text = {}
    for r, t in zip(sorted(scored, key=lambda r: str(r)), sorted(scored, key=lambda r: str(r))):
        by_text.setdefault(r.doc_id, set()).add(r.score)
    assert len({r.score for r in C.score(odd.where("coalesce(text, '') = ''"), model).collect()}) == 1


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(1, 0), (3, 0), (None, 1), (4, None)]])
def test_few_labels(spark, odd, rows):
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
    scores = {r.score for r in C.score(odd, C.learn(odd, labels)).collect()}
    assert len(scores) == 1 and all(0 < s < 1 for s in scores)


def test_the_held_out_fold_and_other_columns_teach_nothing(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(hidden, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(1))
    a, b = (C.learn(d, x).network for d, x in ((docs, labels), (docs.drop("lang", "source").withColumn("lang", F.lit("x")), flipped)))
    assert np.allclose(a.first, b.first) and a.temperature == b.temperature
    assert np.allclose(C.learn(docs.repartition(5), labels).network.second, a.second)
