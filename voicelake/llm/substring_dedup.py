"""Remove repeated byte strings with longest-previous-factor arrays, keeping the first occurrence.

A byte goes if a string of `length` bytes that covers it also starts earlier: at a smaller id, or earlier in the same
text. That is a question about the array of longest previous factors (is it `length` or more at some start nearby?), and
in suffix order the answer for a place is at its previous smaller position: the closest earlier place that shares most.

The suffixes of the whole corpus are never sorted at once. Two equal strings have the same smallest window hash at the
same offset, so occurrences of that anchor (about one place in 35) bring equal strings together:

1. Every anchor moves as 32 bytes: its hash, the hash of the bytes that any string around it can cover (its context), its
   place. Sorted by these, the first row of each context is kept; all later rows of the same context lose the whole
   context, without another look at a text. Rows that are later than another one of their own batch are known before the
   shuffle and go to any task, so a context of a third of the corpus sends one row a batch to its own. Batches stream
   through; no group is held.
2. Anchors that have several contexts need the bytes: those of the first row of each context only. Texts are joined once;
   documents that have no such context are finished there.
3. The contexts of an anchor are laid end to end. Prefix doubling ranks their suffixes to depth `length`; in suffix order
   (equal ranks by place) the previous smaller position tells which strings start earlier. Anchors with more than
   `WIDE` contexts are split further, down to single strings, which are grouped minima and can be of any number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelake.llm.common import whole
from voicelake.session import cut

GRAM = 32
SEGMENT = 1 << 20
WIDE = 500
#: In place of the context of a row that is known to be later than another one.
LATER = -(2**63)
U = np.uint64
ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, and the powers of an odd base and of its inverse modulo 2**64."""
    values = np.random.default_rng(7).integers(0, 2**64, 256, dtype=U)
    n = SEGMENT + 1024
    up, down = np.full(n, U(ODD)), np.full(n, U(pow(ODD, -1, 2**64)))
    up[0] = down[0] = 1
    return values, np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def sliding(values: np.ndarray, width: int, ufunc: np.ufunc, neutral: int) -> np.ndarray:
    """ufunc over each window of `width` values, from running results inside blocks of that width."""
    n = len(values)
    blocks = np.full((-(-n // width), width), neutral, dtype=values.dtype)
    blocks.ravel()[:n] = values
    ahead = ufunc.accumulate(blocks, axis=1).ravel()
    behind = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(behind[: n - width + 1], ahead[width - 1 : n])


def segment_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, anchor hashes, context hashes) in bytes of at most one segment and its margins."""
    values, up, down = powers()
    n, width = len(data), length - GRAM + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, U)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum(values[data] * down[:n], out=sums[1:])
    h = mixed((sums[GRAM:] - sums[:-GRAM]) * up[: n - GRAM + 1])
    least = sliding(h, width, np.minimum, 2**64 - 1)
    padded = np.zeros(len(least) + 2 * (width - 1), dtype=U)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(sliding(padded, width, np.maximum, 0) == h)
    low, high = np.maximum(at - (length - GRAM), 0), np.minimum(at + length, n)
    context = (sums[high] - sums[low]) * up[low]
    context = mixed(context + (at - low).astype(U) * U(0xD6E8FEB86659FD93) + (high - at).astype(U) * U(0xA0761D6478BD642F))
    return at, h[at], context


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, anchor hashes, context hashes) of a whole text, segment by segment."""
    whole_text = np.frombuffer(data, dtype=np.uint8)
    if len(whole_text) <= SEGMENT:
        return segment_anchors(whole_text, length)
    margin, parts = 2 * length, []
    for a in range(0, len(whole_text), SEGMENT):
        begin = max(0, a - margin)
        at, h, context = segment_anchors(whole_text[begin : a + SEGMENT + margin], length)
        at = at + begin
        inside = (at >= a) & (at < a + SEGMENT)
        parts.append((at[inside], h[inside], context[inside]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, context, doc, at) of (doc, tag, data); `at` is the place and, below it, the tag of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
            found = [anchors(value.as_buffer() or b"", length) for value in batch.column("data")]
            sizes = [len(f[0]) for f in found]
            if not found:
                continue
            at, anchor, context = (np.concatenate([f[i] for f in found]) for i in range(3))
            anchor, context, doc = anchor.view(np.int64), context.view(np.int64), np.repeat(docs, sizes)
            order = np.lexsort((at, doc, context, anchor))
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (anchor[order][1:] != anchor[order][:-1]) | (context[order][1:] != context[order][:-1])
            start = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
            late = order[(doc[order] != doc[start]) | (at[order] != at[start])]
            anchor[late] = mixed(doc[late].astype(U) * U(ODD) + at[late].astype(U)).view(np.int64)
            context[late] = LATER
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(context), pa.array(doc), pa.array((at << 32) | np.repeat(tags, sizes))], names=["anchor", "context", "doc", "at"])

    return texts.mapInArrow(run, "anchor long, context long, doc long, at long")


def sorted_out(rows: DataFrame) -> DataFrame:
    """(doc, tag, anchor, place, later) of anchors that matter: later rows of a context, and firsts of anchors with several."""
    placed = rows.repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4, 0), dtype=np.int64)  # the first row of the last context, and whether it is still to be given
        owed = several = False
        for batch in batches:
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            known = new[:, new[1] == LATER]
            if known.shape[1]:
                yield facts(known, np.ones(known.shape[1], dtype=bool))
            new = new[:, new[1] != LATER]
            if not new.shape[1]:
                continue
            data = np.concatenate((held, new), axis=1)
            old = held.shape[1]
            anchor, context, doc, place = data[0], data[1], data[2], data[3] >> 32
            fresh = np.ones(data.shape[1], dtype=bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
            later = (doc != doc[start]) | (place != place[start])
            firsts = np.flatnonzero(fresh)
            change = np.ones(len(firsts), dtype=bool)
            change[1:] = anchor[firsts[1:]] != anchor[firsts[:-1]]
            group = np.cumsum(change) - 1
            many = np.bincount(group) > 1
            if old and several:
                many[0] = True
            give = many[group]
            last_given, last_many = bool(give[-1]), bool(many[-1])
            if old:
                give[0] &= owed
            out = np.concatenate((firsts[give], np.flatnonzero(later)))
            is_later = np.zeros(len(out), dtype=bool)
            is_later[give.sum() :] = True
            yield facts(data[:, out], is_later)
            only_old = old and len(firsts) == 1
            owed = (owed and not last_given) if only_old else not last_given
            several = last_many
            held = data[:, firsts[-1] : firsts[-1] + 1]

    def facts(data: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
        columns = [data[2], data[3] & 0xFFFFFFFF, data[0], data[3] >> 32, later]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "tag", "anchor", "place", "later"])

    return placed.mapInArrow(run, "doc long, tag long, anchor long, place long, later boolean")


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (begin, end) as sorted disjoint ones that do not touch."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    upto = np.maximum.accumulate(spans[:, 1])
    first = np.ones(len(spans), dtype=bool)
    first[1:] = spans[1:, 0] > upto[:-1]
    last = np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)
    return np.stack([spans[first, 0], upto[last]], axis=1)


def without(data: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def ranks(text: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of `text` (codes up to 256) its place by the first `length` codes; equal places are equal strings.

    Seven codes of nine bits make the first key, so doubling starts at seven. A place is that of the first suffix of its
    class, so a suffix alone in its class is done, and each doubling sorts only those that are still tied.
    """
    n, k = len(text), min(7, length)
    padded = np.append(text.astype(np.int64) + 1, np.zeros(k, np.int64))
    key = np.zeros(n, dtype=np.int64)
    for j in range(k):
        key = key << 9 | padded[j : j + n]
    rank = np.zeros(n, dtype=np.int64)
    tied = np.arange(n)
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key, tied = key[order], tied[order]
        fresh = np.append(True, sorted_key[1:] != sorted_key[:-1])[: len(tied)]
        old = rank[tied]
        begins = np.append(True, old[1:] != old[:-1])[: len(tied)]  # of the classes before this sort
        at = np.arange(len(tied))
        rank[tied] = old + at[np.maximum.accumulate(np.where(fresh, at, 0))] - np.maximum.accumulate(np.where(begins, at, 0))
        alone = fresh & np.append(fresh[1:], True)[: len(tied)]
        tied = tied[~alone]
        if k >= length or not len(tied):
            return rank
        shift = min(k, length - k)
        behind = np.zeros(len(tied), dtype=np.int64)
        inside = tied + shift < n
        behind[inside] = rank[tied[inside] + shift] + 1
        key = rank[tied] * np.int64(n + 1) + behind
        k += shift


def earlier_strings(codes: np.ndarray, sizes: np.ndarray, docs: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, begin, end) of the spans whose strings of `length` bytes also start earlier in another context.

    `codes` are the bytes of all contexts, one after the other. The longest previous factor of a suffix reaches `length`
    if its previous smaller position in suffix order shares so many bytes; with equal ranks ordered by place, that is the
    first row of its class, unless that is the same place.
    """
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.full(int(sizes.sum()) + len(sizes), 256, dtype=np.int64)
    text[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes
    rank = ranks(text, length)
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    mine, doc, place = rank[begins[owner] + offset], docs[owner], places[owner] + offset
    order = np.lexsort((place, doc, mine))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = mine[order][1:] != mine[order][:-1]
    start = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
    found = np.zeros(len(order), dtype=bool)
    found[order] = (doc[order] != doc[start]) | (place[order] != place[start])
    owner, offset = owner[found], offset[found]
    if not len(owner):
        return owner, offset, offset
    new = np.append(True, (owner[1:] != owner[:-1]) | (offset[1:] > offset[:-1] + length))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(owner) - 1)
    return owner[new], offset[new], offset[last] + length


def opened(data: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def first_look(texts: DataFrame, facts: DataFrame, length: int) -> DataFrame:
    """One row per text: spans that later rows of a context lose, contexts to compare, and the text if there are any."""
    listed = facts.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "place", "later")).alias("facts"))  # of one text
    joined = texts.join(listed, ["doc", "tag"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id, doc, tag, data, facts in zip(*(batch.column(c) for c in ("id", "doc", "tag", "data", "facts"))):
                text, known = opened(data.as_py()), facts.as_py() or []
                n = len(text)
                lost = merged(np.array([span(f["place"], n, length) for f in known if f["later"]], dtype=np.int64).reshape(-1, 2))
                asked = [(f["anchor"], f["place"], text[max(0, f["place"] - length + GRAM) : f["place"] + length]) for f in known if not f["later"]]
                rows.append((id.as_py(), doc.as_py(), tag.as_py(), n, lost.ravel().tolist(), [dict(zip(("anchor", "place", "bytes"), a)) for a in asked], data.as_py() if asked else None, *([None] * 3 if asked else result(text, lost))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)] if rows else [pa.array([], t) for t in arrow], names=names)

    contexts = pa.list_(pa.struct([("anchor", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())]))
    kind = texts.schema["id"].dataType
    names = ["id", "doc", "tag", "n_bytes", "lost", "asked", "packed", "n_removed", "n_spans", "kept_sha256"]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), contexts, pa.binary(), pa.int64(), pa.int64(), pa.string()]
    return joined.mapInArrow(run, f"id {kind.simpleString()}, doc long, tag long, n_bytes long, lost array<long>, asked array<struct<anchor: long, place: long, bytes: binary>>, packed binary, n_removed long, n_spans long, kept_sha256 string")


def span(place: int, n: int, length: int) -> tuple[int, int]:
    """The bytes of all strings of `length` around an anchor."""
    return max(0, place - length + GRAM), min(n, place + length)


def result(text: bytes, lost: np.ndarray) -> tuple[int, int, str]:
    return int((lost[:, 1] - lost[:, 0]).sum()), len(lost), hashlib.sha256(without(text, lost)).hexdigest()


def compared(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, tag, begin, end) of the bytes that (anchor, doc, tag, place, bytes) lose to earlier strings."""
    low = F.greatest(F.col("place") - (length - GRAM), F.lit(0))
    rows = contexts.select("anchor", "doc", "tag", low.alias("begin"), "bytes")
    sizes = rows.groupBy("anchor").agg(F.count("*").alias("n"))
    wide = rows.join(sizes.where(F.col("n") > WIDE).select("anchor"), "anchor")
    narrow = rows.join(sizes.where(F.col("n") <= WIDE).select("anchor"), "anchor").repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > WIDE:
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = table.column("anchor").to_numpy()
                others = np.flatnonzero(anchor != anchor[-1])
                upto = int(others[-1]) + 1 if len(others) else 0  # the last group may go on
                if upto:
                    yield from solved(table.slice(0, upto))
                held = table.slice(upto).to_batches()
        if held:
            yield from solved(pa.Table.from_batches(held))

    def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, docs, begins, tags = (table.column(c).to_numpy() for c in ("anchor", "doc", "begin", "tag"))
        if not table.num_rows:
            return
        contexts = table.column("bytes").combine_chunks()
        contexts = contexts.chunk(0) if isinstance(contexts, pa.ChunkedArray) else contexts
        ends = np.frombuffer(contexts.buffers()[1], np.int32)[contexts.offset : contexts.offset + len(contexts) + 1].astype(np.int64)
        codes = np.frombuffer(contexts.buffers()[2], np.uint8) if contexts.buffers()[2] else np.zeros(0, np.uint8)
        edges = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
        a, out = 0, [np.zeros((4, 0), dtype=np.int64)]
        for b in edges[1:]:  # whole groups, about `WIDE` rows at a time
            if b - a < WIDE and b < len(anchor):
                continue
            which, begin, end = earlier_strings(codes[ends[a] : ends[b]], np.diff(ends[a : b + 1]), docs[a:b], begins[a:b], length)
            which += a
            out.append(np.stack([docs[which], tags[which], begins[which] + begin, begins[which] + end]))
            a = b
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(out, axis=1)], names=["doc", "tag", "begin", "end"])

    spans = narrow.mapInArrow(run, "doc long, tag long, begin long, end long")
    # Single strings, behind 128 bits of hash: a grouped minimum over any number of rows.
    cuts = F.expr(f"transform(sequence(1, greatest(1, length(bytes) - {length - 1})), i -> substring(bytes, i, {length}))")
    strings = wide.select("doc", "tag", "begin", F.posexplode(cuts).alias("i", "string")).where(F.length("string") == length)
    each = strings.select("doc", "tag", (F.col("begin") + F.col("i")).alias("begin"), F.xxhash64("string").alias("a"), F.xxhash64(F.lit(7), "string").alias("b"))
    first = each.groupBy("a", "b").agg(F.min(F.struct("doc", "begin")).alias("first"), F.count("*").alias("n")).where("n > 1")
    late = each.join(first, ["a", "b"]).where(F.struct("doc", "begin") > F.col("first"))
    return spans.unionByName(late.select("doc", "tag", "begin", (F.col("begin") + length).alias("end")))


def finished(waiting: DataFrame, spans: DataFrame) -> DataFrame:
    """The results of the texts that waited for the comparison."""
    listed = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # of one text
    joined = waiting.select("id", "doc", "tag", "n_bytes", "lost", "packed").join(listed, ["doc", "tag"], "left").select("id", "n_bytes", "lost", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lost, packed, spans in zip(*(batch.column(c).to_pylist() for c in ("lost", "packed", "spans"))):
                known = np.array(lost, dtype=np.int64).reshape(-1, 2)
                more = np.array([(x["begin"], x["end"]) for x in spans or []], dtype=np.int64).reshape(-1, 2)
                every = merged(np.concatenate((known, more)))
                rows.append((every.ravel().tolist(), *result(opened(packed), every)))
            lists = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *lists], names=["id", "n_bytes", "lost", "n_removed", "n_spans", "kept_sha256"])

    kind = waiting.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, lost array<long>, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, length: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, lost), one row per row; `lost` has the removed runs' edges.

    `lost` is [begin, end, begin, end, ...] in UTF-8 bytes. Matches never cross texts, and are judged on the input. Ids
    are whole numbers; null is the smallest one. Rows of one id are one document: a string that starts at the same place
    in two of them is not earlier in either, so repeated rows do not remove each other. Null and empty texts, and texts
    shorter than `length`, lose nothing. An empty table gives an empty result. Other columns are not read.
    """
    named = docs.select(
        F.col(id).alias("id"), F.coalesce(F.col(id).cast("long"), F.lit(-(2**63))).alias("doc"),
        F.xxhash64(whole(F.col(text))).bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"), whole(F.col(text)).cast("binary").alias("data"),
    )
    facts = sorted_out(anchor_rows(named.select("doc", "tag", "data"), length))
    looked = cut(first_look(squeezed(named), facts, length))
    waiting = looked.where("packed IS NOT NULL")
    asked = waiting.select("doc", "tag", F.explode("asked").alias("x")).select("doc", "tag", "x.*")
    done = looked.where("packed IS NULL").select("id", "n_bytes", "lost", "n_removed", "n_spans", "kept_sha256")
    every = done.unionByName(finished(waiting, compared(asked, length)))
    return every.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "lost")


def squeezed(named: DataFrame) -> DataFrame:
    """The texts compressed one by one, as they go through a shuffle and a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = pa.array([pack.compress(v.as_buffer()) for v in batch.column("data")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "doc", "tag")], data], names=["id", "doc", "tag", "data"])

    return named.mapInArrow(run, named.schema)
