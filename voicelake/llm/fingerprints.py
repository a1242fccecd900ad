"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes decides where a chunk ends: at block size 2**k about one place in 2**k. The fingerprint is
`k:signature:signature`, one symbol of two base64 digits for each chunk, at the smallest block size that gives at most
`CHUNKS` chunks and at the next one. An edit changes the chunks that it touches, and boundaries find themselves again
behind it. Fingerprints are comparable at equal or neighbouring block sizes; their likeness is one minus the edit
distance of the two signatures, over the longer one.

Whole texts are hashed, in blocks of `BLOCK` bytes, so a text of any length needs a bounded amount of memory beside itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from voicelake.llm.common import whole

WINDOW, CHUNKS, BLOCK = 7, 64, 1 << 20
LEVELS = 33
DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)

Print = tuple[int, np.ndarray, np.ndarray]


def rolled(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """The hash of the window that ends at each of the bytes a..b-1 (zeros before the start)."""
    part = np.zeros(b - a + WINDOW - 1, dtype=np.uint32)
    begin = max(0, a - WINDOW + 1)
    part[len(part) - (b - begin):] = data[begin:b]
    out = np.zeros(b - a, dtype=np.uint32)
    for k in range(WINDOW):
        out = out * np.uint32(0x01000193) + (part[k : k + b - a] + np.uint32(1))
    out *= np.uint32(0x9E3779B1)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return out ^ (out >> np.uint32(13))


def trailing_ones(value: np.ndarray) -> np.ndarray:
    return np.bitwise_count((value ^ (value + np.uint32(1))) >> np.uint32(1))


def fingerprints(texts: Sequence[bytes]) -> list[Print]:
    """(k, signature, signature) of each text; the texts are laid end to end, with a gap as wide as the window.

    The first pass counts chunk ends at each block size, the second one adds up the chunks. A batch that fits into one
    block keeps its hashes between the passes; a longer one computes them again.
    """
    if not texts:
        return []
    data = np.frombuffer(bytes(WINDOW).join([*texts, b""]), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    ends = begins + sizes
    gaps = (ends[:, None] + np.arange(WINDOW)).ravel()

    def block(a: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Hashes and chunk end levels (-1 in a gap) of the bytes from a on."""
        value = rolled(data, a, min(len(data), a + BLOCK))
        level = trailing_ones(value).view(np.int8)
        here = gaps[np.searchsorted(gaps, a) : np.searchsorted(gaps, a + len(value))] - a
        value[here] = 0
        level[here] = -1
        return a, value, level

    offsets = range(0, len(data), BLOCK)
    kept = [block(a) for a in offsets] if len(offsets) == 1 else None
    blocks = lambda: kept or (block(a) for a in offsets)

    counts = np.zeros(len(texts) * LEVELS, dtype=np.int64)
    for a, _, ones in blocks():  # levels 0 and 1 hold most places, and only texts with few ends above need them
        at = np.flatnonzero(ones >= 2)
        counts += np.bincount((np.searchsorted(begins, at + a, "right") - 1) * LEVELS + ones[at], minlength=len(counts))
    few = counts.reshape(-1, LEVELS).sum(axis=1) < CHUNKS
    for a, _, ones in blocks() if few.any() else ():
        at = np.flatnonzero((ones == 0) | (ones == 1))
        owner = np.searchsorted(begins, at + a, "right") - 1
        at, owner = at[few[owner]], owner[few[owner]]
        counts += np.bincount(owner * LEVELS + ones[at], minlength=len(counts))
    ending = np.cumsum(counts.reshape(-1, LEVELS)[:, ::-1], axis=1)[:, ::-1]
    ending[~few, :2] = CHUNKS
    level = np.argmax(ending < CHUNKS, axis=1)

    who, high, sums, total = [], [], [], np.uint64(0)
    least = int(level.min())
    final = ends[sizes > 0] - 1
    for a, value, ones in blocks():
        content = value.astype(np.uint64)
        content ^= content << np.uint64(31)
        content *= np.uint64(0x9E3779B97F4A7C15)
        running = np.cumsum(content) + total
        total = running[-1]
        ones = ones.copy()
        ones[final[np.searchsorted(final, a) : np.searchsorted(final, a + len(ones))] - a] = LEVELS
        at = np.flatnonzero(ones >= least)
        owner = np.searchsorted(begins, at + a, "right") - 1
        chosen = ones[at] >= level[owner]
        who.append(owner[chosen])
        high.append(ones[at[chosen]])
        sums.append(running[at[chosen]])
    who, high, sums = np.concatenate(who), np.concatenate(high), np.concatenate(sums)
    cuts = np.searchsorted(who, np.arange(len(texts) + 1))
    out = []
    for i, k in enumerate(level):
        mine = slice(cuts[i], cuts[i + 1])
        before = sums[cuts[i] - 1] if cuts[i] else np.uint64(0)
        pair = [symbols(sums[mine][high[mine] >= n], before) for n in (k, k + 1)]
        out.append((int(k), pair[0], pair[1]))
    return out


def symbols(sums: np.ndarray, before: np.uint64) -> np.ndarray:
    """12 bits for each chunk, from the running sums at the chunk ends."""
    chunk = np.diff(sums, prepend=before)
    chunk = (chunk ^ (chunk >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (chunk >> np.uint64(52)).astype(np.uint16)


def written(value: Print) -> str:
    def digits(signature: np.ndarray) -> str:
        return DIGITS[np.stack([signature >> 6, signature & 63], axis=1)].tobytes().decode()

    return f"{value[0]}:{digits(value[1])}:{digits(value[2])}"


def edit_distances(left: Sequence[np.ndarray], right: Sequence[np.ndarray]) -> np.ndarray:
    """Edit distance of each pair of signatures of at most 64 symbols, for all pairs at once in 64-bit words."""
    n = len(left)
    pattern, other = np.full((n, 64), -1, np.int32), np.full((n, 64), -2, np.int32)
    for i, (a, b) in enumerate(zip(left, right)):
        pattern[i, : len(a)], other[i, : len(b)] = a, b
    m, length = np.array([len(a) for a in left]), np.array([len(b) for b in right])
    top = np.left_shift(np.uint64(1), np.maximum(m - 1, 0).astype(np.uint64))
    up, down, score, one = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), m.copy(), np.uint64(1)
    for j in range(int(length.max(initial=0))):
        equal = np.packbits(pattern == other[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(across | up), up & across
        live = j < length
        score += np.where(live & ((plus & top) != 0), 1, 0) - np.where(live & ((minus & top) != 0), 1, 0)
        plus, minus = (plus << one) | one, minus << one
        up, down = minus | ~(vertical | plus), plus & vertical
    return np.where(m == 0, length, score)


def likeness(pairs: Sequence[tuple[Print, Print]]) -> np.ndarray:
    """0 to 1 for each pair: the better of the signatures at a common block size; 0 if there is none; 1 for two empty texts."""
    best = np.zeros(len(pairs))
    owner, left, right = [], [], []
    for i, (a, b) in enumerate(pairs):
        for x, y in ((x, y) for x in (0, 1) for y in (0, 1) if a[0] + x == b[0] + y):
            owner.append(i)
            left.append(a[1 + x])
            right.append(b[1 + y])
    if owner:
        longest = np.maximum([len(a) for a in left], [len(b) for b in right])
        scores = 1 - edit_distances(left, right) / np.maximum(longest, 1)
        np.maximum.at(best, owner, scores)
    return best


def edited(text: str, following: str) -> str:
    """The last third of the text (code points, rounded down) replaced by as many of the next text's first ones, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(__part, __last, doc_id, text) so placed that each row's successor in descending id order is the next row.

    Rows are dealt by ranges of the id; the ranges come from quantiles. Each range ends with a copy of the first row of
    the next range (of the first one, for the last), so one shuffle of the texts is enough and no order is global.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("doc_id"), whole(F.col(text)).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], ranges * 20)).first()[0]
    limits = np.array(sorted(set(cuts or [])), dtype=np.float64)

    @F.pandas_udf("int")
    def part(ids):  # noqa: ANN001, ANN202
        values = ids.to_numpy(dtype=np.float64, na_value=-np.inf)
        return ids.__class__(len(limits) - np.searchsorted(limits, values, "left")).astype("int32")

    placed = rows.select(part("doc_id").alias("__part"), F.lit(False).alias("__last"), "doc_id", "text")
    keys = placed.select("__part", "doc_id", F.xxhash64("text").alias("__hash"))
    # one row per range from here on
    heads = keys.groupBy("__part").agg(F.max("doc_id").alias("__id"), F.max_by("__hash", F.struct("doc_id", "__hash")).alias("__head"))
    present = sorted(r[0] for r in heads.select("__part").collect())
    if not present:
        return placed
    back = F.create_map(*[F.lit(x) for i, p in enumerate(present) for x in (p, present[i - 1])])
    found = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__head")))
    first = found.groupBy("__part").agg(F.first("text").alias("text"))
    guards = first.select(back[F.col("__part")].alias("__part"), F.lit(True).alias("__last"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "text")
    order = ["__part", F.col("__last"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    return placed.unionByName(guards).repartition(ranges, "__part").sortWithinPartitions(*order)


def compare_with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row.

    The next document is the next one in descending id order, null ids last; rows of one id follow each other in order of
    a text hash; after the last row comes the first, so a single row is its own next one. A null text counts as empty; two
    empty texts have likeness 1; an empty table gives an empty result. Other columns are not read.
    """
    kind = docs.schema[id].dataType
    schema = StructType([
        StructField("doc_id", kind), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()), StructField("fingerprint", StringType()),
        StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        weight = 0
        for batch in batches:
            for last, owner, value in zip(batch.column("__last"), batch.column("doc_id"), batch.column("text")):
                rows.append((last.as_py(), owner.as_py(), value.as_py()))
                weight += len(rows[-1][2])
                if weight > BLOCK and len(rows) > 1:
                    yield from finished(rows)
                    rows = rows[-1:]
                    weight = len(rows[0][2])
        if len(rows) > 1:
            yield from finished(rows)

    def finished(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = fingerprints([r[2].encode() for r in rows])
        at = [i for i in range(len(rows) - 1) if not rows[i][0]]
        if not at:
            return
        texts = [edited(rows[i][2], rows[i + 1][2]).encode() for i in at]
        changed = fingerprints(texts)
        near = likeness([(own[i], e) for i, e in zip(at, changed)])
        following = likeness([(own[i], own[i + 1]) for i in at])
        columns = [
            [rows[i][1] for i in at], [len(rows[i][2]) for i in at], [hashlib.sha256(t).hexdigest() for t in texts],
            [written(own[i]) for i in at], [written(e) for e in changed], near, following,
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema).types
    return with_next(docs, id, text).mapInArrow(run, schema)
