"""Recordings in pieces against plain numpy on whole ones."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voicelake.functions import signal as fs
from voicelake.operators import blocks
from voicelake.operators.signal import WindowPolicy
from voicelake.plans.catalog import QUERIES

POLICY = WindowPolicy(min_seconds=0.5, max_seconds=2.0, hop_seconds=0.3, frame_ms=70, activity_rms=0.3, min_active=0.4, silence_rms=0.2)
RATE = 20  # windows of 40 samples on a grid of 6, frames of 1


def clips():
    rng = np.random.default_rng(4)
    out = [np.zeros(0), np.zeros(9), np.ones(10) / 2, np.zeros(200), np.tile([0.5, -0.5, 0.25], 70)]
    for n in (11, 39, 40, 41, 46, 47, 83, 120, 121, 300, 301, 999):
        out.append(rng.integers(-64, 65, n) / 64.0)
        out.append(np.concatenate([np.zeros(n), rng.random(40)]))  # the tail is the loudest
    return out


def plain_window(x):
    shortest, longest, hop, frame = POLICY.samples(RATE)
    if len(x) < shortest:
        return 0, len(x), "shorter_than_min_window"
    starts = [0] if len(x) <= longest else sorted({*range(0, len(x) - longest + 1, hop), len(x) - longest})
    best = max(starts, key=lambda s: ((x[s : s + longest] ** 2).sum(), -s))
    window = x[best : best + longest]
    loud = [math.sqrt((window[i : i + frame] ** 2).mean()) for i in range(0, len(window) - frame + 1, frame)]
    active = np.mean([r > POLICY.activity_rms for r in loud]) if loud else 0
    return best, best + len(window), None if active >= POLICY.min_active else "insufficient_speech_activity"


def table(spark, rows):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id long, samples array<double>")


def part(column, first, count):
    return blocks.stored(F.slice(column, (first + 1).cast("int"), count.cast("int")))


def cut_piece():
    return part("samples", F.col("piece_from"), F.col("piece_samples"))


def points(spec):
    """The points of a piece as a column."""
    one = spec.read

    def read(*v: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(*v)])

    return F.pandas_udf(read, "array<double>")(*spec.columns)


@pytest.mark.parametrize("stride", [6, 12, 60, 6000])
def test_windows_across_pieces(spark, stride):
    rows = clips()
    pieces = blocks.spread(table(spark, rows), F.size("samples"), stride, POLICY.samples(RATE)[1])
    assert pieces.agg(F.max("piece_samples")).first()[0] <= stride + 41  # and the neighbour
    got = {r.id: (r.start, r.end, r.reason) for r in blocks.select_window(pieces, ["id"], cut_piece(), RATE, POLICY, stride).collect()}
    assert got == {i: plain_window(x) for i, x in enumerate(rows)}


@pytest.mark.parametrize("stride", [7, 70])
def test_frames_across_pieces(spark, stride):
    rows = clips()
    pieces = blocks.spread(table(spark, rows), F.size("samples"), stride)
    for r in blocks.frame_report(pieces, ["id"], cut_piece(), 7, 0.3).collect():
        loud = [math.sqrt((rows[r.id][i : i + 7] ** 2).mean()) for i in range(0, len(rows[r.id]) - 6, 7)]
        assert r.frames == len(loud) and r.active == (np.mean([v > 0.3 for v in loud]) if loud else 0)
        assert (r.mean_rms is None) == (not loud) and (not loud or abs(r.mean_rms - np.mean(loud)) < 1e-12)


@pytest.mark.parametrize("up,down", [(16, 25), (3, 1), (1, 3), (147, 160), (1, 1)])
@pytest.mark.parametrize("stride", [5, 64])
def test_another_rate_across_pieces(spark, up, down, stride):
    rows = [x for x in clips() if len(x)]
    pieces = blocks.spread(table(spark, rows), F.size("samples"), stride, 0, up, down)
    spec = blocks.regridded(cut_piece(), F.lit(up), F.lit(down), F.size("samples"))
    found = {}
    for r in pieces.select("id", "piece_first", points(spec).alias("y"), "grid_size").collect():
        found.setdefault(r.id, []).append((r.piece_first, r.y, r.grid_size))
    for i, x in enumerate(rows):
        got = np.concatenate([y for _, y, _ in sorted(found[i])])
        place = np.arange(math.ceil(len(x) * up / down)) * down / up
        assert len(got) == len(place) == found[i][0][2]
        assert np.allclose(got, np.interp(place, np.arange(len(x)), x), atol=1e-12)


def test_prepared_recordings_have_one_outcome_each(spark):
    rng = np.random.default_rng(6)
    loud = (rng.random(500) * 60000 - 30000).astype(int).tolist()
    rows = [(1, 20, loud), (2, 20, loud), (3, 10, loud[:100]), (4, 0, loud), (5, 20, []), (6, 20, [0] * 100), (7, 20, loud[:5]), (8, None, loud), (9, 40, loud)]
    table_ = spark.createDataFrame(rows, "id long, rate int, left array<int>")
    channels = lambda first, count: (part("left", first, count),) * 2
    nothing = spark.createDataFrame([], "digest string")
    found = blocks.prepare_windows(table_, "id", F.size("left"), F.col("rate"), channels, RATE, POLICY, nothing, stride=60)
    got = {r.id: r.outcome for r in found.collect()}
    assert got == {1: "kept", 2: "duplicate", 3: "kept", 4: "bad_sample_rate", 5: "empty", 6: "insufficient_speech_activity", 7: "shorter_than_min_window", 8: "bad_sample_rate", 9: "kept"}


def test_gain_comes_from_the_whole_recording(spark):
    quiet = [8000] * 400
    rows = [(1, 20, quiet + [65536]), (2, 20, quiet)]  # the loud sample lies in another piece than the best window may
    table_ = spark.createDataFrame(rows, "id long, rate int, left array<int>")
    channels = lambda first, count: (part("left", first, count),) * 2
    policy = WindowPolicy(min_seconds=0.5, max_seconds=2.0, hop_seconds=0.3, frame_ms=70, activity_rms=0.0, min_active=0, silence_rms=0)
    got = {r.id: r.peak for r in blocks.prepare_windows(table_, "id", F.size("left"), F.col("rate"), channels, RATE, policy, spark.createDataFrame([], "digest string"), stride=60).collect()}
    assert got[1] == 1.0 and abs(got[2] - 8000 / 32768) < 1e-8


def test_status_of_recordings(spark):
    sizes = spark.createDataFrame([(0,), (1,), (99,), (100,), (401,)], "n int")
    assert [r[0] for r in sizes.select(fs.chunk_status(F.col("n"), 100)).collect()] == ["empty", "too_short", "too_short", "ok", "ok"]
    got = QUERIES["chunk_fixed"](spark, "/root/testdata/sf0.001").groupBy("status").count().collect()
    assert {r.status for r in got} == {"ok", "empty", "too_short"}


def test_clips_are_sketched_from_their_points(spark):
    """The sketches of points that a kernel reads are those of the same samples in arrays; copies have one digest."""
    from voicelake.operators import signal as sg

    rng = np.random.default_rng(4)
    clips = [rng.standard_normal(n).tolist() for n in (31, 32, 200, 47, 333)]
    clips.append(clips[2])
    df = spark.createDataFrame(list(enumerate(clips)), "id long, samples array<double>")
    rows = {r["id"]: r for r in blocks.clip_sketches(df, "id", blocks.stored(F.col("samples")), 16).collect()}
    plain = {r["id"]: r["sketch"] for r in sg.sketch(df, "id", 16).collect()}
    assert set(rows) == set(plain) == {1, 2, 3, 4, 5} and all(np.allclose(r["sketch"], plain[k]) for k, r in rows.items())
    assert rows[2]["digest"] == rows[5]["digest"] != rows[4]["digest"]
    framed = {k: np.array(clips[k][: len(clips[k]) // 16 * 16]).reshape(-1, 16) for k in plain}
    raw = {k: np.concatenate([f.mean(axis=0), f.std(axis=0, ddof=1), f[0], f[-1]]) for k, f in framed.items()}
    moved = {k: v - np.mean(list(raw.values()), axis=0) for k, v in raw.items()}
    assert all(np.allclose(plain[k], v / np.linalg.norm(v)) for k, v in moved.items())
