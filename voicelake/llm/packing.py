"""Pack tokenized documents into sequences of a fixed length: dominance reduction, then best fit.

Texts are tokenized in Arrow batches where they lie; only (id, piece, start, length, checksum) moves on. The bin packing
instance is the histogram of piece lengths, at most `capacity` numbers whatever the corpus, and so is its solution: a
plan of bin patterns with counts. Spark then numbers the pieces of each length and looks up every piece's place.

Martello-Toth reduction works on items in decreasing length. A set of pieces that dominates every other feasible set for
an item is fixed for good: a piece and its exact complement, an item that nothing fits beside, an item and the largest
piece that fits when no two pieces together could use more of the room, and an item with the two pieces that are at
least as large, one by one, as any other two. What no rule fixes is placed by best fit in decreasing length.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from voicelake.operators.prefix import ranked
from voicelake.session import cut

#: The rank file of a vocabulary beside its `tokenizers` file: the same ids several times faster.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}


@lru_cache(maxsize=4)
def encoder(vocabulary: str, special: bool = False):  # noqa: ANN201
    """text -> uint32 ids; `special` matches the added tokens of the vocabulary in a text, else they are ordinary text."""
    if vocabulary in RANKS:
        import tiktoken

        with open(public_tokenizers.path(RANKS[vocabulary]), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
            added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        allowed = set(added) if special else set()
        return lambda text: own.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    tokenizer.encode_special_tokens = not special
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def split_points(total: int, capacity: int) -> list[int]:
    """Where the pieces of a document begin: one piece if it fits, else full pieces behind a first one with the rest."""
    first = total % capacity
    return [0] if total <= capacity else [*([0] if first else []), *range(first, total, capacity)]


def tokenized(docs: DataFrame, capacity: int, end: int, vocabulary: str, id: str, text: str, ids: bool, special: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids and an end id, cut into pieces."""
    kind = docs.schema[id].dataType
    fields = [StructField("doc_id", kind), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    schema = StructType(fields + ([StructField("ids", ArrayType(IntegerType()))] if ids else []))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(vocabulary, special)
        for batch in batches:
            owner, piece, start, length, crc, values = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                found = np.append(run(value.as_py() or ""), np.uint32(end)).astype("<u4")
                points = [*split_points(len(found), capacity), len(found)]
                for i, (a, b) in enumerate(zip(points, points[1:])):
                    owner.append(row)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(found[a:b].tobytes()))
                    if ids:
                        values.append(found[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if ids:
                columns.append(pa.array(values, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, schema)


def reduced(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets: [(lengths of a bin, bins)]; `counts[w]`, the pieces of length w, shrinks in place."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(*lengths: int) -> None:
        sizes, uses = np.unique(lengths, return_counts=True)
        bins = int(min(counts[w] // u for w, u in zip(sizes, uses)))
        if bins:
            fixed.append((lengths, bins))
            for w, u in zip(sizes, uses):
                counts[w] -= bins * u

    fix(capacity)
    for w in range(capacity - 1, (capacity - 1) // 2, -1):
        if counts[w] and counts[capacity - w]:
            fix(w, capacity - w)
    changed = True
    while changed:
        changed = False
        for w in range(capacity - 1, 0, -1):
            while counts[w]:
                before = len(fixed)
                counts[w] -= 1  # the companions of one such piece
                room, there = capacity - w, np.flatnonzero(counts[: capacity - w + 1])
                smallest = np.repeat(there[:3], np.minimum(counts[there[:3]], 3))[:3]
                counts[w] += 1
                if not len(there):
                    fix(w)
                    break
                largest = int(there[-1])
                if len(smallest) < 2 or smallest[0] + smallest[1] > room:
                    fix(w, largest)
                elif len(smallest) < 3 or smallest.sum() > room:
                    pairs = best_pairs(there, counts, w, room)
                    if max(a + b for a, b in pairs) <= largest:
                        fix(w, largest)
                    else:
                        a = max(p[0] for p in pairs)
                        b = max(p[1] for p in pairs)
                        if (a, b) in pairs and a >= largest:
                            fix(w, a, b)
                if len(fixed) == before:
                    break
                changed = True
    return fixed


def best_pairs(there: np.ndarray, counts: np.ndarray, taken: int, room: int) -> set[tuple[int, int]]:
    """For each smaller companion b its largest partner a >= b with a + b <= room, one piece `taken` being used."""
    pairs = set()
    for b in there:
        upto = int(np.searchsorted(there, room - b, "right")) - 1
        while upto >= 0 and there[upto] >= b:
            a = there[upto]
            if counts[a] >= (a == taken) + (a == b) + 1 and counts[b] >= (b == taken) + (a == b) + 1:
                pairs.add((int(a), int(b)))
                break
            upto -= 1
    return pairs


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing length, many equal bins at a time.

    The tightest open bin takes a piece, and is then still the tightest for the next one of that length until full, so
    the bins of one free room take their pieces together: the steps depend on the number of lengths, not of pieces.
    """
    free: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for w in range(capacity, 0, -1):
        left = int(counts[w])
        room = w
        while left:
            while room < capacity and not free[room]:
                room += 1
            lengths, bins = free[room].pop() if free[room] else ((), left)
            each = room // w
            full = min(bins, left // each)
            rest = min(left - full * each, each - 1) if full < bins else 0
            if full:
                free[room - each * w].append((lengths + (w,) * each, full))
            if rest:
                free[room - rest * w].append((lengths + (w,) * rest, 1))
            unused = bins - full - bool(rest)
            if unused and lengths:
                free[room].append((lengths, unused))
            left -= full * each + rest
        counts[w] = 0
    return [entry for entries in free for entry in entries]


def plan(histogram: Sequence[tuple[int, int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) in order: where the pieces of each length go, by rank."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram:
        counts[length] = n
    bins = reduced(counts, capacity) + best_fit(counts, capacity)
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0
    for lengths, n in bins:
        offset = 0
        for w in lengths:
            rows.append((w, used[w], sequence, offset))
            used[w] += n
            offset += w
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(
    docs: DataFrame, capacity: int = 2048, end: int = 0, vocabulary: str = "byte_bpe_50k.json",
    id: str = "doc_id", text: str = "text", ids: bool = False, special: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece; `ids` adds the token ids.

    With `special` the ids are those of a plain `tokenizers` file: a literal <|endoftext|> is one token. Without it the
    added tokens of the vocabulary are spelled like other text. A null or empty text is the end id alone. A document longer than a sequence is cut into full pieces behind a first
    one with the rest. Rows with one id are separate documents; a null id stays null; an empty table gives no pieces.
    Other columns are not read.
    """
    pieces = cut(tokenized(docs, capacity, end, vocabulary, id, text, ids, special))
    histogram = [(int(r[0]), int(r[1])) for r in pieces.groupBy("length").count().collect()]  # at most `capacity` rows
    table = plan(histogram, capacity)
    numbered = ranked(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")], "__rank")
    names = [c for c in pieces.columns]
    schema = StructType([*[pieces.schema[c] for c in names], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    shift = 1 << 48
    keys = table[:, 0] * shift + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            row = table[np.searchsorted(keys, length * shift + rank - 1, "right") - 1]
            columns = [*[batch.column(c) for c in names], pa.array(row[:, 2] + rank - 1 - row[:, 1]), pa.array(row[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return numbered.mapInArrow(place, schema)
