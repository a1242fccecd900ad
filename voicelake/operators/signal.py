"""Window policies and facts, fingerprints, duplicates and feature tables (windows are chosen in operators/blocks.py).

Filters and joins on a derived array would be pushed below the projection that computes it and compute it again, inside
lambdas once per element. Derived arrays are therefore written down (`cut`) before they are compared, and unnested with
the outer form of explode, for which Spark infers no filter.

Per-clip work is row-local. The only shuffles are those that compare clips: exact duplicates by digest, near duplicates
by a grid that cannot miss a pair, and per-dimension statistics with partial aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.functions import signal as fs
from voicelake.session import cut


@dataclass(frozen=True)
class WindowPolicy:
    """How a window is chosen, in seconds and amplitudes. The defaults are fixed values."""

    min_seconds: float = 1.0
    max_seconds: float = 4.0
    hop_seconds: float = 0.25
    frame_ms: float = 30.0
    silence_rms: float = 0.00316
    activity_rms: float = 0.0025
    min_active: float = 0.2

    def samples(self, rate: int) -> tuple[int, int, int, int]:
        whole = lambda s: int(round(s * rate))
        return whole(self.min_seconds), whole(self.max_seconds), max(1, whole(self.hop_seconds)), max(1, whole(self.frame_ms / 1000))


def window_facts(df: DataFrame, rate: int, original_rate: Column) -> DataFrame:
    """Seconds and original-rate offsets of a chosen window, rounded as they are stored."""
    return df.withColumns({
        "start_seconds": F.round(F.col("start") / rate, 6), "end_seconds": F.round(F.col("end") / rate, 6),
        "duration_seconds": F.round((F.col("end") - F.col("start")) / rate, 6),
        "original_start": F.bround(F.col("start") * original_rate / rate, 0).cast("bigint"),
        "original_end": F.bround(F.col("end") * original_rate / rate, 0).cast("bigint"),
        "rms": F.round("rms", 8), "peak": F.round("peak", 8), "active_fraction": F.round("active_fraction", 6)})


def fingerprint(df: DataFrame, rate: int, bins: int = 64, samples: str = "samples") -> DataFrame:
    """Loudness and zero-crossing profile of each clip (40 ms frames) on fixed grids, L2-normalized."""
    return df.withColumn("fingerprint", fs.loudness_profile(max(1, int(0.04 * rate)), bins)(F.col(samples)))


def dedup_exact(df: DataFrame, key: str, digest: str, registry: DataFrame) -> DataFrame:
    """Every row with its disposition: kept, duplicate of the first key with its digest, or known already.

    The first key is a grouped minimum, so a group of copies that holds a third of the rows is one partial aggregate.
    """
    first = df.groupBy(digest).agg(F.min(key).alias("first"))
    known = registry.select(digest).distinct().withColumn("__known", F.lit(True))
    joined = df.join(first.join(known, digest, "left"), digest)
    return joined.withColumn("disposition", F.when(F.col("__known"), "known").when(F.col(key) == F.col("first"), "kept").otherwise("duplicate")).drop("__known")


def principal_directions(df: DataFrame, vec: str, size: int, count: int = 4) -> list[list[float]]:
    """Unit directions along which the vectors spread most; a size x size matrix is what is aggregated.

    With fewer than two rows there is nothing to spread, and any direction does.
    """
    if df.limit(2).count() < 2:
        return [[1.0 if j == i else 0.0 for j in range(size)] for i in range(count)]
    rows = df.select(array_to_vector(F.col(vec)).alias("v"))
    components = PCA(k=count, inputCol="v", outputCol="p").fit(rows).pc.toArray()
    return [[float(x) for x in components[:, i]] for i in range(count)]


#: A cell with more left rows than this share of all, and more than CELL_ROWS, or with more than CELL_MOST is met in blocks.
CELL_SHARE, CELL_ROWS, CELL_MOST = 0.01, 1024, 8192
#: Directions that may make cells, and those that two rows are compared on before their vectors are joined.
CELL_AXES, DIRECTIONS = 4, 15
#: What single precision may add to a distance.
SLACK = 1e-5


def _cells(df: DataFrame, names: Sequence[str], widths: Sequence[float], spread: bool) -> Column:
    """Cell keys of a row as an array: its own cell, or with `spread` every cell within the radius (a quarter width)."""
    keys = F.array(F.lit(""))
    for name, width in zip(names, widths):
        x, r = F.col(name), width / 4 + SLACK
        own = F.array(F.floor(x / width)) if not spread else F.sequence(F.floor((x - r) / width), F.floor((x + r) / width))
        keys = _crossed(keys, own)
    return keys


def _crossed(keys: Column, values: Column) -> Column:
    return F.flatten(F.transform(keys, lambda k: F.transform(values, lambda v: F.concat_ws(":", k, v))))


def projected(df: DataFrame, vec: str, directions: Sequence[Sequence[float]]) -> DataFrame:
    """`df` with `__x`: the vector along each direction, and the length of what is left of it."""
    turn = np.array(directions).T

    @F.pandas_udf("array<float>")
    def project(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        v = np.stack(vectors.to_numpy())
        x = v @ turn
        rest = np.sqrt(np.maximum((v * v).sum(axis=1) - (x * x).sum(axis=1), 0))
        return pd.Series(list(np.column_stack([x, rest]).astype(np.float32)))

    return df.withColumn("__x", project(F.col(vec)))


def candidate_pairs(left: DataFrame, right: DataFrame, key: str, vec: str, radius: float, directions: Sequence[Sequence[float]], extra: Sequence[tuple[str, float]] = ()) -> DataFrame:
    """Keys (l, r) of a left and a right row that may lie within `radius` of each other; a pair comes once, none is missed.

    The directions are at right angles to each other.
    """
    columns = [key, "__x", *[c for c, _ in extra]]
    sides = [cut(projected(rows, vec, directions).select(*columns)) for rows in ([left] if left is right else [left, right])]
    return meeting_pairs(sides[0], sides[-1], key, radius, len(directions), extra)


def meeting_pairs(left: DataFrame, right: DataFrame, key: str, radius: float, size: int, extra: Sequence[tuple[str, float]] = ()) -> DataFrame:
    """`candidate_pairs` of rows that have their projections `__x` on `size` directions already. Both sides are read twice.

    Two unit vectors closer than `radius` are closer than `radius` on every direction, so the cell of a left row is always
    among the cells a right row is spread over. Directions on which the rows lie within the radius anyway make no cells.
    The squares of the differences on all directions, and of what is left, add up to no more than the squared distance;
    over a few dozen directions hardly a pair passes that is not near. Rows of a crowded cell are dealt into blocks, and
    each left block meets each right one, so a common loudness or duration makes neither a hot task nor a long buffer.
    Only keys and projections move; vectors stay where they are.
    """
    first = min(CELL_AXES, size)
    facts = left.agg(F.count("*").alias("n"), *[F.stddev(F.col("__x")[i]).alias(f"s{i}") for i in range(first)]).first()
    wide = [i for i in range(first) if (facts[f"s{i}"] or 0) > radius]
    names, widths = [f"__c{i}" for i in wide] + [c for c, _ in extra], [4 * radius] * len(wide) + [4 * r for _, r in extra]
    placed = []
    for side, rows in (("l", left), ("r", right)):
        at = rows.withColumns({f"__c{i}": F.col("__x")[i].cast("double") for i in wide}) if wide else rows
        flat = [F.col("__x")[i].alias(f"{side}x{i}") for i in range(size + 1)] + [F.col(c).cast("double").alias(f"{side}e{i}") for i, (c, _) in enumerate(extra)]
        placed.append(at.select(F.col(key).alias(side), *flat, F.explode(_cells(at, names, widths, side == "r")).alias("cell")))
    limit = min(max(CELL_SHARE * facts["n"], CELL_ROWS), CELL_MOST)
    counts = placed[0].groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    crowded = cut(counts.select("cell", F.ceil(F.col("n") / limit).cast("int").alias("blocks")))
    split = []
    for side, rows in zip("lr", placed):
        marked = rows.join(crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own, all_ = F.pmod(F.xxhash64(side), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
        parts = F.transform(all_, (lambda j: own * F.col("blocks") + j) if side == "l" else (lambda i: i * F.col("blocks") + own))  # noqa: B023
        split.append(marked.select(*rows.columns, F.explode(parts).alias("part")))
    # plain columns: elements of arrays would make the condition too long a method for the JVM to compile
    apart = lambda i: F.col(f"lx{i}") - F.col(f"rx{i}")
    close = F.lit(True)
    for i, (_, r) in enumerate(extra):
        close &= F.abs(F.col(f"le{i}") - F.col(f"re{i}")) <= r + 1e-9
    for i in range(first):
        close &= F.abs(apart(i)) <= radius + SLACK
    close &= reduce(lambda a, b: a + b, [apart(i) * apart(i) for i in range(size + 1)]) <= (radius + SLACK) ** 2
    return split[0].join(split[1], ["cell", "part"]).where(close).select("l", "r")


def measured_pairs(pairs: DataFrame, rows: DataFrame, key: str, vec: str, carry: Sequence[str] = ()) -> DataFrame:
    """The pairs with the dot product of their vectors and the carried columns of both sides (`l_`, `r_`)."""
    sides = [rows.select(F.col(key).alias(s), F.col(vec).alias(f"__{s}"), *[F.col(c).alias(f"{s}_{c}") for c in carry]) for s in "lr"]
    joined = pairs.join(sides[0], "l").join(sides[1], "r")
    return joined.withColumn("similarity", fs.dot(F.col("__l"), F.col("__r"))).drop("__l", "__r")


def collapse_copies(df: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """Representatives (the first key per digest) and links (representative, copy): copies never meet each other."""
    first = df.groupBy(digest).agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    joined = df.join(first, digest)
    return joined.where(F.col(key) == F.col("first")), joined.where(F.col(key) != F.col("first")).select(F.col("first").alias("a"), F.col(key).alias("b"))


def near_duplicates(df: DataFrame, key: str, vec: str, size: int, duration: str, digest: str, similarity: float = 0.995, tolerance: float = 0.05) -> DataFrame:
    """Pairs of clips with close durations and similar fingerprints.

    Exact copies are links to their first clip; distinct clips are paired through the grid on duration and projections
    and always verified exactly. There is no cap on partners.
    """
    rows = cut(df.select(key, vec, duration, digest))
    directions = principal_directions(rows, vec, size, min(DIRECTIONS, size))
    reps, links = collapse_copies(projected(rows, vec, directions).select(key, duration, digest, "__x"), key, digest)
    base = cut(reps.select(key, duration, "__x"))
    pairs = cut(meeting_pairs(base, base, key, math.sqrt(2 - 2 * similarity), len(directions), [(duration, tolerance)]).where("l < r"))
    delta = F.abs(F.col(f"l_{duration}") - F.col(f"r_{duration}"))
    close = measured_pairs(pairs, rows, key, vec, (duration,)).withColumn("duration_delta", delta)
    near = close.where((delta <= tolerance + 1e-12) & (F.col("similarity") >= similarity)).select(F.col("l").alias("a"), F.col("r").alias("b"), "similarity", "duration_delta")
    return near.withColumn("kind", F.lit("near")).unionByName(
        links.select("a", "b", F.lit(1.0).alias("similarity"), F.lit(0.0).alias("duration_delta"), F.lit("copy").alias("kind")))


def nearest_neighbour(df: DataFrame, key: str, vec: str, size: int, digest: str, similarity: float = 0.9999) -> DataFrame:
    """The most similar other row of each row when its cosine is above the limit; the smaller key wins a tie.

    A row with exact copies has one of them as its neighbour: the first copy, or the second one for the first itself.
    """
    rows = cut(df.select(key, vec, digest))
    directions = principal_directions(rows, vec, size, min(DIRECTIONS, size))
    reps, links = collapse_copies(projected(rows, vec, directions).select(key, digest, "__x"), key, digest)
    second = links.groupBy("a").agg(F.min("b").alias("b"))
    copies = links.select(F.col("b").alias(key), F.col("a").alias("neighbour")).unionByName(second.select(F.col("a").alias(key), F.col("b").alias("neighbour")))
    base = cut(reps.select(key, "__x", "copies"))
    pairs = cut(meeting_pairs(base.where("copies = 1"), base, key, math.sqrt(2 - 2 * similarity), len(directions)).where("l <> r"))
    close = measured_pairs(pairs, rows, key, vec).where(F.col("similarity") > similarity).select(F.col("l").alias(key), F.col("r").alias("neighbour"), "similarity")
    best = close.groupBy(key).agg(F.max(F.struct(F.round("similarity", 9).alias("similarity"), (-F.col("neighbour")).alias("minus"))).alias("m"))
    return best.select(key, (-F.col("m.minus")).alias("neighbour"), F.col("m.similarity").alias("similarity")).unionByName(
        copies.select(key, "neighbour", F.lit(1.0).alias("similarity")))


def sketch(df: DataFrame, key: str, frame_size: int, samples: str = "samples") -> DataFrame:
    """[mean | deviation | first | last] over a clip's frames, centred over the table and normalized. Clips of less than
    two frames have none."""
    return centred(df.select(key, fs.frame_summary(frame_size)(F.col(samples)).alias("raw")), key)


def centred(df: DataFrame, key: str, *carry: str) -> DataFrame:
    """`raw` less its mean over the table, normalized, as `sketch`; rows without `raw` are left out."""
    # a table of its own: it is read for the centre and again for the rows
    raw = cut(df.select(key, *carry, "raw")).where("raw IS NOT NULL")
    centre = raw.select(F.posexplode("raw").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("c"))  # one entry per dimension
    means = centre.select(F.transform("c", lambda s: s["m"])).scalar()
    moved = raw.withColumn("__m", means).withColumn("__c", F.zip_with("raw", "__m", lambda x, m: x - m))
    return moved.select(key, *carry, fs.normalized(F.col("__c")).alias("sketch"))


def standardize(frames: DataFrame, moments: DataFrame, vec: str = "vec") -> DataFrame:
    """(x - mean) / scale per dimension. The statistics are two arrays with one entry per dimension."""
    packed = moments.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "scale"))).alias("m")).select("m").scalar()
    scaled = F.zip_with(vec, "__moments", lambda x, m: (x.cast("double") - m["mean"]) / m["scale"])
    return frames.withColumn("__moments", packed).withColumn(vec, scaled).drop("__moments")


def pad_batches(df: DataFrame, batch: str, samples: str = "samples") -> DataFrame:
    """Right-pad the clips of each batch to its longest one, with valid lengths."""
    longest = df.groupBy(batch).agg(F.max(F.size(samples)).alias("width"))
    return df.join(longest, batch).withColumns({"valid": F.size(samples), samples: fs.pad_right(F.col(samples), F.col("width"))})


def contract_failures(frames: DataFrame, vec: str, dim: int) -> Column:
    """Names of the checks a feature row fails."""
    v = F.col(vec)
    return F.array_compact(F.array(
        F.when(v.isNull(), "missing"), F.when(F.size(v) != dim, "wrong_dimension"),
        F.when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))), "non_finite")))
