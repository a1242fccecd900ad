"""Row-local expressions on a waveform held as an array in its row: nothing moves, whatever the clip's length.

Arrays used more than once should be columns of their own, so that Spark computes them once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def energy(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def rms(values: Column) -> Column:
    return F.when(F.size(values) == 0, 0.0).otherwise(F.sqrt(energy(values) / F.size(values)))


def peak(values: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(values, F.abs)), F.lit(0.0))


def pcm_scale(values: Column, bits: Column) -> Column:
    """Integer samples in [-1, 1]: signed 16 and 32 bits, unsigned 8 bits; NULL for another width."""
    scaled = lambda k, shift=0.0: F.transform(values, lambda x: (x.cast("double") - shift) / k)
    return F.when(bits == 16, scaled(32768.0)).when(bits == 32, scaled(2147483648.0)).when(bits == 8, scaled(128.0, 128.0))


def downmix(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def overflow_gain(values: Column) -> Column:
    """1, or 1 / peak when the peak is above 1."""
    top = peak(values)
    return F.when(top > 1, 1 / top).otherwise(1.0)


def overshoot_clip(values: Column, tolerance: float) -> Column:
    """Clip to [-1, 1]; NULL when a sample is beyond the tolerance."""
    inside = F.forall(values, lambda x: F.abs(x) <= 1 + tolerance)
    return F.when(inside, F.transform(values, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))))


def signal_problem(samples: Column, rate: Column, tolerance: float = 0.0) -> Column:
    """Why a waveform is rejected, NULL when it is fine."""
    return (
        F.when(samples.isNull() | (F.size(samples) == 0), "empty").when(rate.isNull() | (rate <= 0), "bad_sample_rate")
        .when(F.exists(samples, lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))), "non_finite")
        .when(F.exists(samples, lambda x: F.abs(x) > 1 + tolerance), "out_of_range")
    )


def chunk_status(n: Column, min_tail: int) -> Column:
    """What becomes of a whole recording: ok, empty, or too_short for a single chunk."""
    return F.when(n == 0, "empty").when(n < min_tail, "too_short").otherwise("ok")


def chunk_spans(n: Column, window: int, min_tail: int) -> Column:
    """Contiguous windows as array of struct(start, end, kind): chunk, or skipped for a tail below the minimum.

    Together the spans cover every sample.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.ceil(n / window) - 1).cast("array<bigint>")
    span = lambda i: F.struct((i * window).alias("start"), F.least((i + 1) * window, n.cast("bigint")).alias("end"))
    named = F.transform(F.transform(starts, span), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when(s["end"] - s["start"] >= min_tail, "chunk").when(n < min_tail, "too_short").otherwise("short_tail").alias("kind")))
    return F.when(n > 0, named).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"))


def register_chunk_spans(spark: SparkSession) -> None:
    """`chunk_spans(n, window_samples, min_tail)` as a SQL table function, for LATERAL joins."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION chunk_spans(n BIGINT, window_samples BIGINT, min_tail BIGINT)
        RETURNS TABLE (start BIGINT, end BIGINT, kind STRING)
        RETURN SELECT i * window_samples, least((i + 1) * window_samples, n),
            CASE WHEN least((i + 1) * window_samples, n) - i * window_samples >= min_tail THEN 'chunk'
                 WHEN n < min_tail THEN 'too_short' ELSE 'short_tail' END
        FROM (SELECT explode(CASE WHEN n > 0 THEN sequence(0L, CAST(ceil(n / window_samples) AS BIGINT) - 1) END) AS i)""")


def frames_of(samples: Column, frame: int) -> Column:
    """Whole non-overlapping frames; the partial last one is dropped."""
    n = F.floor(F.size(samples) / frame).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(samples, i * frame + 1, F.lit(frame)))).otherwise(
        F.array().cast("array<array<double>>"))


def loudness_profile(frame: int, bins: int):
    """An Arrow function for the loudness and zero-crossing profile of a clip on two fixed grids, L2-normalized.

    Numpy does per sample what a lambda expression would interpret: this is the one kernel that touches every sample
    several times. Clips are batched by Arrow inside the task; nothing is shuffled.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def profile(clips: pd.Series) -> pd.Series:
        return clips.map(lambda clip: clip_profile(np.asarray(clip, dtype=np.float64), frame, bins))

    return profile


def clip_profile(clip: np.ndarray, frame: int, bins: int) -> np.ndarray:
    grid = np.linspace(0.0, 1.0, bins)
    framed = clip[: len(clip) // frame * frame].reshape(-1, frame)
    if not len(framed):
        return np.zeros(2 * bins)
    loud = np.sqrt((framed**2).mean(axis=1))
    signs = np.sign(framed)
    flips = (signs[:, 1:] != signs[:, :-1]).mean(axis=1) if frame > 1 else np.zeros(len(framed))
    place = np.linspace(0.0, 1.0, len(framed))
    both = np.concatenate([np.interp(grid, place, loud), np.interp(grid, place, flips)])
    norm = np.sqrt((both**2).sum())
    return both / norm if norm > 0 else both


def frame_summary(frame: int):
    """An Arrow function for [mean | deviation | first | last] over the whole frames of a clip, NULL below two frames."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def summary(clips: pd.Series) -> pd.Series:
        return clips.map(lambda clip: None if clip is None else clip_summary(np.asarray(clip, dtype=np.float64), frame))

    return summary


def clip_summary(clip: np.ndarray, frame: int) -> np.ndarray | None:
    framed = clip[: len(clip) // frame * frame].reshape(-1, frame)
    return np.concatenate([framed.mean(axis=0), framed.std(axis=0, ddof=1), framed[0], framed[-1]]) if len(framed) > 1 else None


def normalized(values: Column) -> Column:
    norm = F.sqrt(energy(values))
    return F.when(norm > 0, F.transform(values, lambda x: x / norm)).otherwise(values)


def interpolated(x: np.ndarray, at: int, n: int, first: int, count: int, up: int, down: int) -> np.ndarray:
    """Points first .. first + count - 1 of a recording's grid at another rate, linear between neighbours.

    `x` holds the recording's samples from `at` on, one neighbour beyond the last point included; `n` is its length.
    """
    points = np.arange(first, first + count, dtype=np.int64) * down
    low = np.minimum(points // up, n - 1)
    part = (points - low * up) / up
    value = x[low - at]
    return value + part * (x[np.minimum(low + 1, n - 1) - at] - value)


def frame_loudness(x: np.ndarray, frame: int) -> np.ndarray:
    """RMS of the whole frames from the first sample on; a partial last frame is dropped."""
    whole = x[: len(x) // frame * frame].reshape(-1, frame)
    return np.sqrt((whole * whole).sum(axis=1) / frame)


def pad_right(values: Column, length: Column) -> Column:
    return F.concat(values, F.array_repeat(F.lit(0.0), (length - F.size(values)).cast("int")))
