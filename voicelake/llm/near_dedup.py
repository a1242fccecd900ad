"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words; it weighs its count times a damped inverse document frequency. Document frequencies are counted
over all documents in a hashed table of fixed size, so the table is bounded and the statistics still cover everything.
The damping is strong on purpose: a large group of copies makes its own shingles common, and full weights on the few
edited ones would push true copies below the limit.

Consistent weighted sampling (gamma, gamma and uniform variates per shingle and sample) gives signatures that agree in a
sample with the probability of the weighted Jaccard similarity. Signatures are cut into bands. Texts of one band bucket
are candidates; a candidate is a link when the exact weighted Jaccard similarity of the whole texts reaches the limit.

Nothing emits the pairs of a bucket. First every text meets one text of each of its buckets, a random one per bucket, so
that the texts of a large group meet several. Buckets whose texts are then in one component are done. The others are compared block by block inside tasks, where texts outside the largest
component look for links: pairs of different components whose signatures agree enough, verified until the components
are joined. Exact copies are one text throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelake.llm.common import whole
from voicelake.operators.graph import connected_components
from voicelake.operators.prefix import null_safe
from voicelake.session import cut

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: log2 of the cells of the document frequency table, and of the table of sampling variates.
DF_BITS, VARIATE_BITS = 18, 16
IDF_STRENGTH = 0.1
#: Agreeing samples below which a pair at the limit is missed with a chance of about 1 in 7,900.
AGREE = 39
#: Texts of one bucket that a task compares with as many others.
BLOCK = 1_000
U = np.uint64
ODD = 0x9E3779B97F4A7C15
CHUNK = 1 << 16


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.random.default_rng(11).integers(0, 2**64, 256, dtype=U)
    up, down = np.full(CHUNK, U(ODD)), np.full(CHUNK, U(pow(ODD, -1, 2**64)))
    up[0] = down[0] = 1
    return values, np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def variates() -> tuple[np.ndarray, ...]:
    """Per cell: 1/r, beta, ln c - r + r beta, and r; and one odd multiplier per sample."""
    rng = np.random.default_rng(13)
    r, c = rng.gamma(2.0, 1.0, 1 << VARIATE_BITS), rng.gamma(2.0, 1.0, 1 << VARIATE_BITS)
    beta = rng.random(1 << VARIATE_BITS)
    odd = rng.integers(0, 2**63, SAMPLES, dtype=U) * U(2) + U(1)
    return (1 / r).astype(np.float32), beta.astype(np.float32), (np.log(c) - r + r * beta).astype(np.float32), r.astype(np.float32), odd


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space."""
    values, up, down = powers()
    text = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate(([False], (text != 32) & ((text < 9) | (text > 13)), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return np.empty(0, U)
    if len(text) < CHUNK:
        sums = np.zeros(len(text) + 1, dtype=U)
        np.cumsum(values[text] * down[: len(text)], out=sums[1:])
        return mixed((sums[ends] - sums[begins]) * up[begins])
    if len(begins) == 1:  # one word longer than a chunk
        parts = [word_hashes(data[a : a + CHUNK - 1]) for a in range(int(begins[0]), int(ends[0]), CHUNK - 1)]
        return mixed(np.cumsum(np.concatenate(parts) * U(3))[-1:])
    middle = len(begins) // 2  # halves between words
    at = int(begins[middle])
    return np.concatenate((word_hashes(data[:at]), word_hashes(data[at:])))


def shingles(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their counts; a text of fewer than five words is one shingle."""
    words = word_hashes(data)
    n = len(words) - WORDS + 1
    if not len(words):
        return words, np.empty(0, np.int64)
    if n < 1:
        n, width = 1, len(words)
    else:
        width = WORDS
    total = np.full(n, U(width))
    for k in range(width):
        total = total * U(0xD6E8FEB86659FD93) + words[k : k + n]
    return np.unique(mixed(total), return_counts=True)


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - DF_BITS)).astype(np.int64)


def signature(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """16 bits of each sample."""
    inverse, beta, base, r, odd = variates()
    log = np.log(weights).astype(np.float32)[:, None]
    best, out = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, U)
    columns = np.arange(SAMPLES)
    for a in range(0, len(hashes), 1024):
        part = hashes[a : a + 1024]
        cell = (part[:, None] * odd >> U(64 - VARIATE_BITS)).astype(np.int32)
        step = np.floor(log[a : a + 1024] * inverse[cell] + beta[cell])
        value = base[cell] - r[cell] * step
        row = value.argmin(axis=0)
        least = value[row, columns]
        better = least < best
        chosen = mixed(part[row] + step[row, columns].astype(np.int64).astype(U) * U(0xA0761D6478BD642F))
        best, out = np.where(better, least, best), np.where(better, chosen, out)
    return (out >> U(48)).astype(np.uint16)


def band_keys(sample: np.ndarray) -> np.ndarray:
    return mixed(np.ascontiguousarray(sample).view(U) + np.arange(1, BANDS + 1, dtype=U) * U(0x8CB92BA72F3D8DD7)).view(np.int64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (hashes, weights); two texts without words are equal."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 1.0


def weighted(data: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = shingles(data)
    return hashes, counts * idf[cells(hashes)]


def frequencies(texts: DataFrame) -> np.ndarray:
    """Weight of each cell of the frequency table, from all documents: 2**DF_BITS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            for value in batch.column("data"):
                np.add.at(total, cells(shingles(value.as_buffer())[0]), 1)
                seen += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], seen))], names=["cell", "n"])

    rows = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << DF_BITS)
    known = rows["cell"].to_numpy() >= 0
    table[rows["cell"].to_numpy()[known]] = rows["n"].to_numpy()[known]
    documents = max(2, int(rows["n"].to_numpy()[~known].sum()))
    alone = np.clip(table - table.mean(), 1, documents)  # what a cell holds beyond its share of all shingles
    return 1 + IDF_STRENGTH * np.log(documents / alone) / np.log(documents)


def signatures(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, node, bands, sample) of each text with a word; the node is the md5 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, samples = [], [], []
            for i, value in enumerate(batch.column("data")):
                hashes, weights = weighted(value.as_buffer(), idf)
                if len(hashes):
                    rows.append(i)
                    samples.append(signature(hashes, weights))
                    keys.append(band_keys(samples[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(rows, pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array([s.tobytes() for s in samples], pa.binary())], names=["node", "bands", "sample"])

    return texts.select("node", "data").mapInArrow(run, "node string, bands array<long>, sample binary")


def agreeing(a: bytes, b: bytes) -> int:
    return int((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).sum())


def likely(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The (a, b) whose signatures agree enough."""
    left, right = (known.select(F.col("node").alias(c), F.col("sample").alias(f"s{c}")) for c in ("a", "b"))
    joined = pairs.join(left, "a").join(right, "b")

    @F.udf("int", useArrow=True)
    def agree(x, y):  # noqa: ANN001, ANN202
        return agreeing(x, y)

    return joined.where(agree("sa", "sb") >= AGREE).select("a", "b")


def links(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similar: float) -> DataFrame:
    """The (a, b) whose whole texts reach the similarity; rows of one `b` stand together, so it is read once."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a").join(texts.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        last, right = None, None
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("pa"), batch.column("pb")):
                packed = b.as_buffer()
                if last is None or not packed.equals(last):
                    last, right = packed, weighted(open_.decompress(packed), idf)
                keep.append(jaccard(weighted(open_.decompress(a.as_buffer()), idf), right) >= similar)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return joined.mapInArrow(run, "a string, b string")


class Features:
    """Weighted shingles of the compressed texts of a group, kept up to a number of shingles in all."""

    def __init__(self, packed: list[bytes], idf: np.ndarray, room: int = 4_000_000) -> None:
        self.packed, self.idf, self.room, self.kept, self.used = packed, idf, room, {}, 0
        self.open = zstandard.ZstdDecompressor()

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.kept:
            found = weighted(self.open.decompress(self.packed[i]), self.idf)
            if self.used + len(found[0]) > self.room:
                self.kept, self.used = {}, 0
            self.kept[i] = found
            self.used += len(found[0])
        return self.kept[i]


def open_links(buckets: DataFrame, known: DataFrame, texts: DataFrame, component: DataFrame, idf: np.ndarray, similar: float) -> DataFrame:
    """Links (a, b) between different components of one bucket; blocks of a bucket meet in tasks, with their texts.

    A pair is verified only while its texts are in different components there, the most agreeing ones first. So a task
    gives fewer links than it has components, a text that finds a link to a component is done with it, and one that finds
    none has met every text of the bucket that could be one.
    """
    member = buckets.join(component, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    parts = member.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = member.join(parts.select("band", blocks.alias("blocks")), "band").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = dealt.select("band", "node", "component", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = spread.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "component", F.col("mine").alias("block"))
    whole_rows = keyed.join(known.select("node", "sample"), "node").join(texts, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.stack([table.column(c).to_numpy() for c in ("band", "i", "j")])
            starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))) if table.num_rows else []
            for a, b in zip(starts[:-1], starts[1:]):
                yield compare(table.slice(a, b - a))
            held = table.slice(starts[-1]) if len(starts) else None
        if held is not None:
            yield compare(held)

    def compare(group: pa.Table) -> pa.RecordBatch:
        nodes = group.column("node").to_pylist()
        sample = np.frombuffer(b"".join(group.column("sample").to_pylist()), np.uint16).reshape(-1, SAMPLES)
        part = np.unique(np.array(group.column("component").to_pylist(), dtype=object), return_inverse=True)[1]
        block, (i, j) = group.column("block").to_numpy(), (group.column(c)[0].as_py() for c in ("i", "j"))
        features = Features(group.column("packed").to_pylist(), idf)
        found = []
        for x in np.flatnonzero(part != np.bincount(part).argmax()):  # one of two components is not the largest
            other = np.flatnonzero((part != part[x]) & ((block != block[x]) | (i == j)))
            agree = (sample[other] == sample[x]).sum(axis=1)
            for y in other[np.argsort(-agree, kind="stable")[: (agree >= AGREE).sum()]]:
                if part[x] != part[y] and jaccard(features[x], features[y]) >= similar:
                    found.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
                    part[part == part[x]] = part[y]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.string()) for k in (0, 1)], names=["a", "b"])

    placed = whole_rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return placed.mapInArrow(run, "a string, b string").distinct()


def squeezed(texts: DataFrame) -> DataFrame:
    """(node, packed): the texts compressed one by one, as they go through shuffles and a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([pack.compress(v.as_buffer()) for v in batch.column("data")], pa.binary())], names=["node", "packed"])

    return texts.select("node", "data").mapInArrow(run, "node string, packed binary")


def classes(docs: DataFrame, similar: float = SIMILAR, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, class_id, class_size), one row per row; the class id is the smallest doc_id of the class.

    Links are transitive: a class is a connected component. Equal texts are in one class. A text of fewer than five words
    is one shingle. Texts without a word (null, empty, blank) are equal to each other and to nothing else. Null ids take
    part; a class of null ids alone has a null class id. An empty table gives an empty result. Other columns are not read.
    """
    value = whole(F.col(text))
    blank = ~value.rlike(r"[^\x20\x09-\x0D]")
    named = docs.select(F.col(id).alias("doc_id"), F.when(blank, F.md5(F.lit(""))).otherwise(F.md5(value)).alias("node"), value.cast("binary").alias("data"))
    idf = frequencies(named.select("data"))
    known = cut(signatures(named, idf).dropDuplicates(["node"]))
    rows = known.select("node", F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min_by("node", F.xxhash64("band", "node")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    buckets = cut(rows.join(hubs.select("band", "hub"), "band"))
    wanted = buckets.select("node").distinct()
    texts = cut(squeezed(named).join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    first = cut(links(likely(buckets.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), known), texts, idf, similar))
    labels = connected_components(first)
    more = cut(open_links(buckets.select("band", "node"), known, texts, labels, idf, similar))
    component = connected_components(first.unionByName(more)) if not more.isEmpty() else labels
    placed = named.select("doc_id", "node").join(component, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    placed = cut(placed)
    sizes = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return placed.join(sizes, "component").select("doc_id", "node", "class_id", "class_size", "component")


def keep_one(docs: DataFrame, similar: float = SIMILAR, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class with its columns: the one with the smallest id (null last), then by text hash."""
    grouped = classes(docs, similar, id, text)
    chosen = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("k")).select("k.doc_id", "k.node")
    value = whole(docs[text])
    blank = ~value.rlike(r"[^\x20\x09-\x0D]")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[id].alias("doc_id"), F.when(blank, F.md5(F.lit(""))).otherwise(F.md5(value)).alias("node"))
    kept = null_safe(packed, chosen, ["node", "doc_id"], "left_semi")
    one = kept.groupBy("node", "doc_id").agg(F.first("__row").alias("__row"))
    return one.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
