"""Recordings of any length as rows of bounded pieces.

A recording is spread over rows that each hold `stride` points of its grid and as many beyond them as the longest window
needs, so every window lies whole in the row in which it starts. One Arrow kernel reads a piece once; what is shuffled is
one small row per piece. The grid may have another rate than the recording: a piece then takes the samples between which
its points lie, one neighbour beyond the last included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.functions import signal as fs
from voicelake.operators.signal import WindowPolicy, centred, dedup_exact, window_facts
from voicelake.session import cut

#: Points of a piece before its overlap, at most.
STRIDE = 1 << 16
PIECE = ("piece_first", "piece_points", "piece_from", "piece_samples", "grid_size")


class Points(NamedTuple):
    """The points of a piece: columns of its row, and what makes an array of them inside a kernel."""

    columns: Sequence[Column]
    read: Callable[..., np.ndarray]


def stored(samples: Column) -> Points:
    """Samples that lie in an array."""
    return Points([samples], lambda x: np.asarray(x, dtype=float))


def downmixed(left: Points, right: Points, full_scale: float = 32768.0) -> Points:
    """The mean of two channels of integer samples, scaled to [-1, 1]."""
    n, one, other = len(left.columns), left.read, right.read
    return Points([*left.columns, *right.columns], lambda *v: (one(*v[:n]) / full_scale + other(*v[n:]) / full_scale) / 2)


def regridded(points: Points, up: Column, down: Column, n: Column) -> Points:
    """The points of a piece at another rate from its samples (see `spread`); at its own rate it stays as it is."""

    samples = points.read

    def read(u, d, size, first, count, at, *values):  # noqa: ANN001, ANN202
        x, u, d, count = samples(*values), int(u), int(d), int(count)
        return x[:count] if u == d or not count else fs.interpolated(x, int(at), int(size), int(first), count, u, d)

    return Points([up, down, n, *[F.col(c) for c in ("piece_first", "piece_points", "piece_from")], *points.columns], read)


def amplified(points: Points, gain: Column) -> Points:
    read = points.read
    return Points([gain, *points.columns], lambda g, *values: read(*values) * g)


def spread(df: DataFrame, n: Column, stride: int, overlap: int = 0, up: Column | int = 1, down: Column | int = 1) -> DataFrame:
    """The rows of `df`, one for each piece of a recording of `n` samples; an empty recording has one empty piece.

    Points `piece_first` .. `piece_first + piece_points - 1` of a grid of `grid_size` points need the samples from
    `piece_from` on, `piece_samples` of them. The grid has `up` points for `down` samples.
    """
    up, down = (x if isinstance(x, Column) else F.lit(x) for x in (up, down))
    sized = df.withColumns({"__n": n.cast("bigint"), "__up": up.cast("bigint"), "__down": down.cast("bigint")})
    sized = sized.withColumn("grid_size", F.ceil(F.col("__n") * F.col("__up") / F.col("__down")))
    pieces = F.greatest(F.ceil(F.col("grid_size") / stride) - 1, F.lit(0))
    rows = sized.withColumn("piece_first", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces * stride, F.lit(stride).cast("bigint"))))
    rows = rows.withColumn("piece_points", F.least(F.col("grid_size") - F.col("piece_first"), F.lit(stride + overlap).cast("bigint")))
    last = F.floor((F.col("piece_first") + F.col("piece_points") - 1) * F.col("__down") / F.col("__up"))
    rows = rows.withColumn("piece_from", F.floor(F.col("piece_first") * F.col("__down") / F.col("__up")))
    rows = rows.withColumn("piece_samples", F.greatest(F.least(last + 2, F.col("__n")) - F.col("piece_from"), F.lit(0)))
    return rows.drop("__n", "__up", "__down")


def clip_prints(df: DataFrame, carry: Sequence[str], points: Points, rate: int, bins: int = 64) -> DataFrame:
    """Duration, digest of the samples and fingerprint (see `signal.fingerprint`) of whole clips, read once each."""
    read, frame = points.read, max(1, int(0.04 * rate))

    @F.pandas_udf("duration double, digest string, fingerprint array<double>")
    def measure(*values: pd.Series) -> pd.DataFrame:
        clips = (read(*v) for v in zip(*values))
        return pd.DataFrame([(len(x) / rate, hashlib.sha256(x.tobytes()).hexdigest(), fs.clip_profile(x, frame, bins)) for x in clips], columns=["duration", "digest", "fingerprint"])

    return df.select(*carry, measure(*points.columns).alias("p")).select(*carry, "p.*")


def clip_sketches(df: DataFrame, key: str, points: Points, frame: int) -> DataFrame:
    """Digest of the samples and sketch (see `signal.sketch`) of whole clips that have two frames, read once each."""
    read = points.read

    @F.pandas_udf("digest string, raw array<double>")
    def measure(*values: pd.Series) -> pd.DataFrame:
        clips = (read(*v) for v in zip(*values))
        return pd.DataFrame([(hashlib.sha256(x.tobytes()).hexdigest(), fs.clip_summary(x, frame)) for x in clips], columns=["digest", "raw"])

    return centred(df.select(key, measure(*points.columns).alias("p")).select(key, "p.*"), key, "digest")


def frame_report(pieces: DataFrame, key: Sequence[str], points: Points, frame: int, threshold: float) -> DataFrame:
    """Frames, mean RMS (NULL without frames) and share of frames above the threshold of every recording.

    The stride of the pieces is a multiple of the frame, so no frame lies in two pieces.
    """

    read = points.read

    @F.pandas_udf("frames bigint, loudness double, active bigint")
    def measure(*values: pd.Series) -> pd.DataFrame:
        found = [fs.frame_loudness(read(*v), frame) for v in zip(*values)]
        return pd.DataFrame({"frames": [len(r) for r in found], "loudness": [float(r.sum()) for r in found], "active": [int((r > threshold).sum()) for r in found]})

    sums = pieces.select(*key, measure(*points.columns).alias("m")).groupBy(*key).agg(*[F.sum(f"m.{c}").alias(c) for c in ("frames", "loudness", "active")])
    share = lambda c: F.col(c) / F.nullif("frames", F.lit(0))
    return sums.select(*key, "frames", share("loudness").alias("mean_rms"), F.coalesce(share("active"), F.lit(0.0)).alias("active"))


def _window(x: np.ndarray, first: int, size: int, stride: int, lengths: tuple[int, int, int, int], policy: WindowPolicy) -> tuple | None:
    """Best window that starts among the piece's first `stride` points: energy, start, end, rms, peak, activity, digest."""
    shortest, longest, hop, frame = lengths
    if size < shortest:
        return (0.0, 0, size, 0.0, 0.0, 0.0, None)
    start = 0
    if size > longest:
        cell = int(np.gcd(hop, longest))
        own = min(stride, size - longest + 1 - first)  # starts that belong to this piece
        if own <= 0:
            return None
        reach = (own - 1) // hop * hop + longest
        cells = (x[:reach] ** 2).reshape(-1, cell).sum(axis=1)
        energies = np.lib.stride_tricks.sliding_window_view(cells, longest // cell)[:: hop // cell].sum(axis=1)
        best = int(np.argmax(energies))
        start, energy = best * hop, float(energies[best])
        tail = size - longest - first
        if tail < stride and (tail + first) % hop and float((x[tail : tail + longest] ** 2).sum()) > energy:
            start = tail
    window = x[start : start + min(longest, size)]
    energy = float((window**2).sum())
    loud = fs.frame_loudness(window, frame)
    active = float((loud > policy.activity_rms).mean()) if len(loud) else 0.0
    rms, peak = (np.sqrt(energy / len(window)), np.abs(window).max()) if len(window) else (0.0, 0.0)
    return (energy, first + start, first + start + len(window), float(rms), float(peak), active, hashlib.sha256(window.tobytes()).hexdigest())


FACTS = "energy double, start bigint, end bigint, rms double, peak double, active_fraction double, digest string"


def select_window(pieces: DataFrame, key: Sequence[str], points: Points, rate: int, policy: WindowPolicy, stride: int) -> DataFrame:
    """Start, end and facts of the most energetic window of each recording, and why it is unusable when it is.

    Windows start on the hop grid or end with the recording; the earliest start wins a tie. `pieces` overlap by the
    longest window and `stride` is a multiple of the hop. `digest` is the SHA-256 of the window's 64-bit samples.
    """
    lengths = policy.samples(rate)
    if stride % lengths[2]:
        raise ValueError("the stride must be a multiple of the hop")

    read = points.read

    @F.pandas_udf(FACTS)
    def best(first: pd.Series, size: pd.Series, *values: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in FACTS.split(", ")]
        found = [_window(read(*v), int(a), int(n), stride, lengths, policy) for a, n, *v in zip(first, size, *values)]
        return pd.DataFrame([f or (None,) * len(names) for f in found], columns=names).astype({"start": "Int64", "end": "Int64"})

    measured = pieces.select(*key, best(F.col("piece_first"), F.col("grid_size"), *points.columns).alias("w"), F.col("grid_size"))
    ranked = F.struct("w.energy", (-F.col("w.start")).alias("minus"), F.col("w"))
    top = measured.groupBy(*key).agg(F.max(F.when(F.col("w.start").isNotNull(), ranked)).alias("m"), F.max("grid_size").alias("size"))
    short = F.col("size") < lengths[0]
    facts = top.select(*key, "size", *[F.col(f"m.w.{f.split()[0]}").alias(f.split()[0]) for f in FACTS.split(", ")])
    return facts.withColumns({
        "silence": F.when(short, True).otherwise(F.col("rms") < policy.silence_rms),
        "reason": F.when(short, "shorter_than_min_window").when(F.col("active_fraction") < policy.min_active, "insufficient_speech_activity"),
    })


def weighted_total(points: Points) -> Column:
    """Sum of a piece's own points times their place in the recording, from 1: a checksum that sees order."""

    read = points.read

    @F.pandas_udf("double")
    def total(first: pd.Series, *values: pd.Series) -> pd.Series:
        return pd.Series([float(y @ np.arange(a + 1, a + 1 + len(y))) for a, y in ((a, read(*v)) for a, *v in zip(first, *values))], dtype=float)

    return total(F.col("piece_first"), *points.columns)


def prepare_windows(
    recordings: DataFrame, key: str, n: Column, source_rate: Column, channels: Callable[[Column, Column], tuple[Points, Points]], rate: int, policy: WindowPolicy,
    registry: DataFrame, stride: int = STRIDE,
) -> DataFrame:
    """From 16-bit stereo recordings of any rate to prepared windows: scale, downmix, rate, gain, select, facts, dedup.

    `channels(first, count)` gives the left and right samples of a piece. The gain is 1, or 1 / peak of the whole
    recording where that is above 1. Every recording comes out once, as kept or with the reason it is not.
    """
    _, longest, hop, _ = policy.samples(rate)
    stride = max(1, stride // hop) * hop
    named = recordings.withColumns({"__rate": source_rate.cast("bigint"), "__size": n.cast("bigint")})
    usable = named.where("__rate > 0 AND __size > 0")
    pieces = spread(usable, F.col("__size"), stride, longest, F.lit(rate), F.col("__rate"))
    points = regridded(downmixed(*channels(F.col("piece_from"), F.col("piece_samples"))), F.lit(rate), F.col("__rate"), F.col("__size"))

    read = points.read

    @F.pandas_udf("struct<peak: double, finite: boolean>")
    def loudest(*values: pd.Series) -> pd.DataFrame:
        found = [read(*v) for v in zip(*values)]
        return pd.DataFrame({"peak": [float(np.abs(x).max(initial=0)) for x in found], "finite": [bool(np.isfinite(x).all()) for x in found]})

    peaks = pieces.select(key, loudest(*points.columns).alias("l")).groupBy(key).agg(F.max("l.peak").alias("peak"), F.min("l.finite").alias("finite"))
    gains = cut(peaks.select(key, F.when(F.col("peak") > 1, 1 / F.col("peak")).otherwise(1.0).alias("gain"), "finite"))
    ready = pieces.join(gains.where("finite"), key)
    chosen = select_window(ready, [key], amplified(points, F.col("gain")), rate, policy, stride)
    facts = cut(window_facts(chosen, rate, F.lit(rate)))
    kept = dedup_exact(facts.where("reason IS NULL").select(key, "digest"), key, "digest", registry).select(key, "disposition")
    problem = F.when(F.col("__size") <= 0, "empty").when(F.col("__rate").isNull() | (F.col("__rate") <= 0), "bad_sample_rate").when(~F.col("finite"), "non_finite")
    every = named.select(key, "__size", "__rate").join(gains, key, "left").select(key, problem.alias("problem"))
    return every.join(facts, key, "left").join(kept, key, "left").withColumn("outcome", F.coalesce("problem", "reason", "disposition"))
