"""Source divergence audit: how the words of a source differ from those of the other sources and of its language.

The kept terms of a language, sorted, become minimal acyclic transducers: built from sorted words with one register of
equal states, each arc carrying the number of terms that branch off before it, so that the sum along a term is its place
in lexicographic order. Texts are recounted by running all words of a batch through the transducer at once, one byte a
step; only ordinals and counts are shuffled, and ties are broken by ordinals.

A transducer holds a bounded number of terms, and a pass over the texts takes transducers of a bounded size, which is all
that is ever broadcast; a larger vocabulary takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelake.llm.common import whole
from voicelake.operators.prefix import first_k, ranked
from voicelake.session import cut

#: What separates terms: ASCII but letters.
GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000
@dataclass(frozen=True)
class Limits:
    """What one task or one pass holds at a time; none of them changes the result."""

    shard_terms: int = 1 << 14  # terms of a transducer
    round_bytes: int = 64 << 20  # transducers of a pass over the texts
    block: int = 4096  # ordinals compared together
    slice_bytes: int = 16 << 20  # texts recounted together
    held_pairs: int = 4 << 20  # counted pairs of source and ordinal in a task

    def __post_init__(self) -> None:
        if self.shard_terms % self.block:
            raise ValueError("shard_terms must be a multiple of block")


LETTER = np.array([b >= 0x80 or chr(b) in CAPITALS or chr(b) in SMALL for b in range(256)])
LOWER = np.array([b + 32 if chr(b) in CAPITALS else b for b in range(256)], dtype=np.uint8)


def terms_of(text: Column) -> Column:
    """The terms of a text in order, with only A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, CAPITALS, SMALL), GAPS), "")


@dataclass
class Transducer:
    """Arcs in one row-displaced table: the arc of a state for a byte is at base[state] + byte if its owner is the state."""

    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    passed: np.ndarray  # terms before those behind the arc
    final: np.ndarray
    root: int

    FIELDS = ("base", "owner", "target", "passed", "final")

    def pack(self) -> list[bytes]:
        return [getattr(self, f).tobytes() for f in self.FIELDS]

    @classmethod
    def unpack(cls, parts: Sequence[bytes], root: int) -> Transducer:
        return cls(*[np.frombuffer(p, np.bool_ if f == "final" else np.int32) for f, p in zip(cls.FIELDS, parts)], root)

    def ordinals(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which start, its ordinal from 0) of the words at `starts` that are terms; `data` ends with a gap."""
        which, at = np.arange(len(starts)), starts
        state, place = np.full(len(starts), self.root, np.int32), np.zeros(len(starts), np.int32)
        found, places = [], []
        while len(at):
            byte = data[at]
            inside = LETTER[byte]
            ended = ~inside & self.final[state]
            found.append(which[ended])
            places.append(place[ended])
            slot = self.base[state] + byte
            go = inside & (self.owner[slot] == state)
            slot, which, at = slot[go], which[go], at[go] + 1
            state, place = self.target[slot], place[go] + self.passed[slot]
        return (np.concatenate(found), np.concatenate(places)) if found else (which, place)


def build(terms: Iterable[bytes]) -> Transducer:
    """The minimal transducer of distinct terms in ascending order of their bytes."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []
    behind: list[int] = []

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, *arcs)
        state = register.get(key)
        if state is None:
            state = register[key] = len(states)
            states.append((final, arcs))
            behind.append(final + sum(behind[t] for _, t in arcs))
        return state

    path: list[list] = [[False, []]]  # open states along the last term: final, arcs
    last = b""
    for term in terms:
        shared = 0
        for a, b in zip(last, term):
            if a != b:
                break
            shared += 1
        while len(path) > shared + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, arcs)))
        path.extend([False, []] for _ in range(len(term) - shared))
        path[-1][0] = True
        last = term
    while len(path) > 1:
        final, arcs = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(final, arcs)))
    return displaced(states, behind, settle(*path[0]))


def displaced(states: list[tuple[bool, list[tuple[int, int]]]], behind: list[int], root: int) -> Transducer:
    """Lay the arcs of all states into one table: wide states first, each at the lowest base where its bytes are free."""
    used = bytearray(256 + sum(len(arcs) for _, arcs in states) + 512)
    base = np.zeros(len(states), np.int32)
    slots: list[tuple[int, int, int, int]] = []
    lowest: dict[int, int] = {}
    for state in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        final, arcs = states[state]
        if not arcs:
            continue
        head, width = arcs[0][0], len(arcs)
        at = lowest.get(width, 0)
        while True:
            at = used.find(0, at + head) - head
            if at < 0 or at + 512 > len(used):
                used.extend(bytes(len(used)))
                at = max(at, 0)
                continue
            if not any(used[at + byte] for byte, _ in arcs):
                break
            at += 1
        lowest[width] = max(lowest.get(width, 0), at - 256)
        base[state], passed = at, int(final)
        for byte, target in arcs:
            used[at + byte] = 1
            slots.append((at + byte, state, target, passed))
            passed += behind[target]
    size = int(base.max(initial=0)) + 512
    owner, target, before = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    if slots:
        where, who, to, n = np.array(slots, dtype=np.int64).T
        owner[where], target[where], before[where] = who, to, n
    return Transducer(base, owner, target, before, np.array([final for final, _ in states], np.bool_), root)


def vocabulary(docs: DataFrame, min_docs: int, limits: Limits) -> DataFrame:
    """(lang, term, ordinal from 1, shard): terms in at least `min_docs` documents of a language, in order of their bytes."""
    each = docs.select("lang", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    kept = each.groupBy("lang", "term").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return cut(ranked(kept.select("lang", "term"), ["lang"], [F.col("term")], "ordinal").withColumn("shard", F.floor((F.col("ordinal") - 1) / limits.shard_terms)))


def transducers(terms: DataFrame) -> DataFrame:
    """One row per shard of the vocabulary: first ordinal (from 0), first and last byte, and the packed transducer."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("ordinal")
        words = [t.encode() for t in table["term"].to_pylist()]
        made = build(words)
        return pa.table({
            "lang": [table["lang"][0].as_py()], "first": [table["ordinal"][0].as_py() - 1], "low": [words[0][0]], "high": [words[-1][0]], "root": [made.root],
            **{f: [part] for f, part in zip(Transducer.FIELDS, made.pack())},
        })

    fields = "lang string, first bigint, low bigint, high bigint, root bigint, " + ", ".join(f"{f} binary" for f in Transducer.FIELDS)
    return cut(terms.groupBy("lang", "shard").applyInArrow(one, fields))


def rounds(made: DataFrame, limits: Limits) -> Iterator[list]:
    """The transducers in lots of at most `round_bytes` (or one)."""
    sizes = sum((F.length(f) for f in Transducer.FIELDS[1:]), F.length(Transducer.FIELDS[0]))
    lot, held = [], 0
    rows = made.select("lang", "first", sizes.alias("size")).orderBy("lang", "first").collect()  # one small row per transducer
    for i, row in enumerate(rows):
        lot.append(row)
        held += row["size"]
        if i + 1 == len(rows) or held + rows[i + 1]["size"] > limits.round_bytes:
            low, high = lot[0], lot[-1]
            key = F.struct("lang", "first")
            bound = lambda r: F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["first"]).alias("first"))
            yield made.where((key >= bound(low)) & (key <= bound(high))).collect()
            lot, held = [], 0


class Recount:
    """Counts of (source, ordinal) per language that one task holds, merged as they grow."""

    def __init__(self, shards: dict[str, list[tuple[int, int, int, Transducer]]], block: int) -> None:
        self.block, self.shards, self.sources, self.names, self.held = block, shards, {}, [], 0
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, lang: str, sources: Sequence[str], texts: Sequence[bytes]) -> None:
        data = LOWER[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
        inside = LETTER[data]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        if len(inside) and inside[0]:
            starts = np.concatenate(([0], starts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        for s in sources:
            if s not in self.sources:
                self.sources[s] = len(self.names)
                self.names.append(s)
        own = np.array([self.sources[s] for s in sources], np.int64)
        heads = data[starts]
        for first, low, high, made in self.shards[lang]:
            near = starts[(heads >= low) & (heads <= high)]
            which, place = made.ordinals(data, near)
            source = own[np.searchsorted(ends, near[which], "right")]
            keys, n = np.unique(source << 40 | (place + first), return_counts=True)
            self.parts.setdefault(lang, []).append((keys, n))
            self.held += len(keys)

    def merge(self) -> None:
        self.held = 0
        for lang, parts in self.parts.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)
            self.parts[lang] = [(keys, n)]
            self.held += len(keys)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(lang, block, source, ordinals in the block, counts), and forget them."""
        self.merge()
        for lang, [(keys, n)] in self.parts.items():
            if not len(keys):
                continue
            ordinal = keys & ((1 << 40) - 1)
            run = keys >> 40 << 40 | ordinal // self.block
            at = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
            offsets = pa.array(np.concatenate((at, [len(keys)])), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(at), pa.string()), pa.array(ordinal[at] // self.block, pa.int64()), pa.array([self.names[s] for s in keys[at] >> 40], pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(ordinal % self.block, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64())),
            ], ["lang", "block", "source", "ordinals", "counts"])
        self.parts, self.held = {}, 0


COUNTED = "lang string, block bigint, source string, ordinals array<int>, counts array<bigint>"


def recounted(docs: DataFrame, shards: list, limits: Limits) -> DataFrame:
    """Stream the texts of the shards' languages through their transducers."""
    by_lang: dict[str, list] = {}
    for r in shards:
        by_lang.setdefault(r["lang"], []).append((r["first"], r["low"], r["high"], [bytes(r[f]) for f in Transducer.FIELDS], r["root"]))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Recount({lang: [(first, low, high, Transducer.unpack(parts, root)) for first, low, high, parts, root in own] for lang, own in by_lang.items()}, limits.block)
        waiting: dict[str, tuple[list, list]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
                sources, texts = waiting.setdefault(lang.as_py(), ([], []))
                data = text.as_buffer().to_pybytes()
                sources.append(source.as_py())
                texts.append(data)
                size += len(data)
                if size >= limits.slice_bytes:
                    for key, (s, t) in waiting.items():
                        state.add(key, s, t)
                    waiting, size = {}, 0
                    if state.held > limits.held_pairs:
                        state.merge()
                        if 2 * state.held > limits.held_pairs:
                            yield from state.batches()
        for key, (s, t) in waiting.items():
            state.add(key, s, t)
        yield from state.batches()

    return docs.where(F.col("lang").isin(sorted(by_lang))).select("lang", "source", "text").mapInArrow(stream, COUNTED)


def merged(pieces: DataFrame, block_size: int) -> DataFrame:
    """One row per (lang, block, source); a task adds up the pieces of a block as they come, in arrays of one block."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, {}

        def closed() -> pa.RecordBatch:
            rows = [(source, np.flatnonzero(total), total) for source, total in sums.items()]
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]] * len(rows), pa.string()), pa.array([key[1]] * len(rows), pa.int64()), pa.array([s for s, _, _ in rows], pa.string()),
                pa.array([at.astype(np.int32) for _, at, _ in rows], pa.list_(pa.int32())), pa.array([total[at] for _, at, total in rows], pa.list_(pa.int64())),
            ], ["lang", "block", "source", "ordinals", "counts"])

        for batch in batches:
            ordinals, counts = batch["ordinals"], batch["counts"]
            for i, (lang, block, source) in enumerate(zip(batch["lang"].to_pylist(), batch["block"].to_pylist(), batch["source"].to_pylist())):
                if key != (lang, block):
                    if sums:
                        yield closed()
                    key, sums = (lang, block), {}
                total = sums.get(source)
                if total is None:
                    total = sums[source] = np.zeros(block_size, np.int64)
                total[ordinals[i].values.to_numpy()] += counts[i].values.to_numpy()
        if sums:
            yield closed()

    return pieces.repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(stream, COUNTED)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total) in integers: long division by thousands, so that nothing overflows."""
    rest, quotient = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        rest -= digit * total
        quotient = quotient * 1000 + digit
    return quotient + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compared(counts: DataFrame, groups: DataFrame, top: int, size: int) -> DataFrame:
    """Per block: sums of the distances of all sources of a language, and the first `top` terms of each source."""

    def one(found: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("source")
        names, v, block = own["source"].to_pylist(), own["v"][0].as_py(), own["block"][0].as_py()
        width = min(size, v - block * size)
        at = {s: i for i, s in enumerate(names)}
        matrix = np.zeros((len(names), width), np.int64)
        for source, ordinals, n in zip(found["source"].to_pylist(), found["ordinals"].combine_chunks(), found["counts"].combine_chunks()):
            matrix[at[source], ordinals.values.to_numpy()] = n.values.to_numpy()
        p = shares(matrix, own["total"].to_numpy()[:, None] + 2 * v)
        q = shares(matrix.sum(axis=0), np.int64(own["lang_total"][0].as_py() + 2 * v))
        rows: list[tuple] = []
        for i, name in enumerate(names):
            for j, value in enumerate(distance(p[i], p[i + 1 :]).sum(axis=1).tolist(), i + 1):
                rows.append((name, names[j], None, value))
                rows.append((names[j], name, None, value))
            over = np.flatnonzero((matrix[i] > 0) & (p[i] > q))
            value = distance(p[i, over], q[over])
            for k in np.lexsort((over, -value))[:top]:
                rows.append((name, None, int(over[k]) + block * size + 1, int(value[k])))
        source, other, ordinal, value = zip(*rows) if rows else ((), (), (), ())
        return pa.table({
            "lang": pa.array([own["lang"][0].as_py()] * len(rows), pa.string()), "source": pa.array(source, pa.string()), "other": pa.array(other, pa.string()),
            "ordinal": pa.array(ordinal, pa.int64()), "value": pa.array(value, pa.int64()),
        })

    blocks = groups.where("v > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("v") - 1) / size))))
    return counts.groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block")).applyInArrow(one, "lang string, source string, other string, ordinal bigint, value bigint")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source", limits: Limits = Limits()) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each source from the others and its most typical terms.

    Null text, language and source read as empty texts. A language without kept terms has distance 0 between its
    sources; one with a single source has no pairs. Equal values stand in order of the item's bytes. Repeated rows count
    as often as they stand; a text of any length goes through one task whole. Other columns are not read.
    """
    own = docs.select(*[whole(F.col(c).cast("string")).alias(n) for n, c in (("text", text), ("lang", lang), ("source", source))])
    terms = vocabulary(own, min_docs, limits)
    counts = docs.sparkSession.createDataFrame([], COUNTED)
    for shards in rounds(transducers(terms), limits):  # a block lies in one transducer, so a round counts it whole
        counts = counts.unionByName(cut(merged(recounted(own, shards, limits), limits.block)))
    totals = counts.groupBy("lang", "source").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"))
    sizes = terms.groupBy("lang").agg(F.max("ordinal").alias("v"))
    zero = F.lit(0).cast("bigint")
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"))
    groups = cut(groups.join(groups.groupBy("lang").agg(F.sum("total").alias("lang_total")), "lang"))
    found = cut(compared(counts, groups, top, limits.block))
    sums = found.where("other IS NOT NULL").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", zero))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    best = first_k(found.where("other IS NULL"), ["lang", "source"], [F.desc("value"), F.col("ordinal")], top)
    term_rows = best.join(terms, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pair_rows.unionByName(term_rows)
