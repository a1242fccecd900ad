"""Spans, identities, file sources and near-duplicate search."""

import json

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from voicelake.functions import digests, ids
from voicelake.functions import signal as fs
from voicelake.operators import signal as sg
from voicelake.session import work_path
from voicelake.sources import files


def test_spans_cover_every_sample(spark):
    for n, kinds in {64000: ["chunk"], 64400: ["chunk", "chunk"], 64001: ["chunk", "short_tail"], 400: ["chunk"], 399: ["too_short"], 0: [], 200000: ["chunk"] * 4}.items():
        spans = spark.range(1).select(fs.chunk_spans(F.lit(n), 64000, 400).alias("s")).first()["s"]
        assert [s["kind"] for s in spans] == kinds
        assert sum(s["end"] - s["start"] for s in spans) == n


def test_identities(spark):
    df = spark.createDataFrame([("a\\b\\007-012-M.WAV",), ("7-12-m",), ("7-12-x.wav",), ("",), (None,)], "v string")
    got = [r["c"] for r in df.select(ids.parse_reference(F.col("v"))["canonical"].alias("c")).collect()]
    assert got == ["7-12-m", "7-12-m", None, None, None]
    numbers = spark.createDataFrame([("007",), ("7.0",), ("7.5",), ("-1",), ("nan",), ("",)], "v string")
    assert [r[0] for r in numbers.select(ids.numeric_id(F.col("v"))).collect()] == ["7", "7", None, None, None, None]


def test_requantized_copy_is_near_and_other_tone_is_not(spark):
    t = np.arange(48000) / 16000
    rng = np.random.default_rng(0)
    tone = (0.3 + 0.2 * np.sin(2 * np.pi * 1.3 * t)) * np.sin(2 * np.pi * 220 * t) + 0.01 * rng.standard_normal(48000)
    other = (0.3 + 0.25 * np.cos(2 * np.pi * 3.1 * t)) * np.sin(2 * np.pi * 900 * t) + 0.05 * rng.standard_normal(48000)
    clips = [(1, tone.tolist()), (2, (np.round(tone * 32767) / 32767).tolist()), (3, other.tolist()), (4, tone.tolist())]
    df = sg.fingerprint(spark.createDataFrame(clips, "id long, samples array<double>"), 16000)
    rows = df.select("id", (F.size("samples") / 16000).alias("duration"), F.sha2(F.to_json("samples"), 256).alias("digest"), "fingerprint")
    pairs = {(r["a"], r["b"], r["kind"]) for r in sg.near_duplicates(rows, "id", "fingerprint", 128, "duration", "digest").collect()}
    assert pairs == {(1, 2, "near"), (1, 4, "copy")}


def test_grid_misses_no_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    vectors = np.concatenate([base, base[:30] + 0.02 * rng.standard_normal((30, 16))])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1.0, str(i)) for i, v in enumerate(vectors)], "id long, vec array<double>, d double, digest string")
    got = {(r["a"], r["b"]) for r in sg.near_duplicates(df, "id", "vec", 16, "d", "digest", 0.99).collect()}
    sims = vectors @ vectors.T
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if sims[i, j] >= 0.99} and got


def test_crowded_cells_are_split_and_miss_no_pair(spark, monkeypatch):
    """All durations are equal and the vectors lie close together, so a few cells would hold them all."""
    monkeypatch.setattr(sg, "CELL_ROWS", 4)
    rng = np.random.default_rng(2)
    base = np.ones(16) + 0.12 * rng.standard_normal((150, 16))
    vectors = np.concatenate([base, base[:60] + 0.004 * rng.standard_normal((60, 16))])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1.0, str(i)) for i, v in enumerate(vectors)], "id long, vec array<double>, d double, digest string")
    directions = sg.principal_directions(df, "vec", 16, 8)
    pairs = sg.candidate_pairs(df, df, "id", "vec", 0.04, directions, [("d", 0.05)])
    assert pairs.count() == pairs.distinct().count() < 0.05 * 210 * 210
    got = {(r["a"], r["b"]) for r in sg.near_duplicates(df, "id", "vec", 16, "d", "digest", 0.9992).collect()}
    sims = vectors @ vectors.T
    assert got == {(i, j) for i in range(210) for j in range(i + 1, 210) if sims[i, j] >= 0.9992} and got
    best = {r["id"]: r["neighbour"] for r in sg.nearest_neighbour(df, "id", "vec", 16, "digest", 0.9992).collect()}
    np.fill_diagonal(sims, 0)
    assert best == {i: int(np.argmax(np.round(sims[i], 9))) for i in range(210) if sims[i].max() > 0.9992}


def test_hardly_a_pair_that_is_not_near_is_measured(spark):
    """Noise that lies within the radius on every single direction, but not on all of them together."""
    rng = np.random.default_rng(3)
    vectors = np.ones(128) + 0.5 * rng.standard_normal((300, 128))
    vectors[150:160] = vectors[:10] + 0.01 * rng.standard_normal((10, 128))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(vectors)], "id long, vec array<double>, d double")
    directions = sg.principal_directions(df, "vec", 128, 24)
    got = {(r["l"], r["r"]) for r in sg.candidate_pairs(df, df, "id", "vec", 0.1, directions, [("d", 0.05)]).where("l < r").collect()}
    near = {(i, j) for i in range(300) for j in range(i + 1, 300) if np.linalg.norm(vectors[i] - vectors[j]) <= 0.1}
    assert near <= got and len(near) == 10 and len(got) < 50


def test_float_digest_equals_numpy(spark):
    import hashlib

    v = [0.1, -2.5, 3.0]
    got = spark.createDataFrame([(v,)], "v array<float>").select(digests.float32_sha256("v")).first()[0]
    assert got == hashlib.sha256(np.asarray(v, dtype="<f4").tobytes()).hexdigest()


def test_jsonl_missing_blank_and_bad(spark):
    schema = T.StructType.fromDDL("id bigint, name string")
    assert files.read_jsonl(spark, work_path(spark, "missing"), schema).count() == 0
    path = work_path(spark, "lines")
    spark.createDataFrame([(json.dumps({"id": 1, "name": "a"}),), ("",), ("{bad",)], "value string").write.text(path)
    assert [r["line"] for r in files.bad_json_lines(spark, path, schema).collect()] == ["{bad"]


def test_signature_ignores_order_and_sees_repeats(spark):
    sign = lambda xs: digests.signature(spark.createDataFrame([(x,) for x in xs], "t string"), F.col("t")).first()["signature"]
    assert sign(["a", "b", "c"]) == sign(["c", "a", "b"]) != sign(["a", "b", "c", "c"])


def test_payloads_are_filtered_by_suffix_and_size(spark):
    import hashlib

    root = work_path(spark, "payloads")
    spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1).write.text(f"{root}/small")
    spark.createDataFrame([("x" * 5000,)], "value string").coalesce(1).write.text(f"{root}/large")
    spark.range(3).coalesce(1).write.parquet(f"{root}/other")
    got = {(r["length"], r["sha256"]) for r in files.read_payloads(spark, root, ".txt", max_bytes=1000).collect()}
    assert got == {(4, hashlib.sha256(b"a\nb\n").hexdigest())}
    assert files.read_payloads(spark, root, ".txt").count() == 2
