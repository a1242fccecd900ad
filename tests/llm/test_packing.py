import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voicelake.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60), st.integers(12, 20))
def test_plan_places_every_piece_once(lengths, capacity):
    table = packing.plan(sorted(Counter(lengths).items()), capacity)
    bins = {}
    for w, n in Counter(lengths).items():
        rows = table[table[:, 0] == w]
        for rank in range(n):
            row = rows[np.searchsorted(rows[:, 1], rank, "right") - 1]
            bins.setdefault(row[2] + rank - row[1], []).append((row[3], w))
    for content in bins.values():
        at = 0
        for offset, w in sorted(content):
            assert offset == at
            at += w
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))


def fewest(lengths, capacity):
    """The smallest number of bins, by trying all ways."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity and bins[j] not in bins[:j]:
                place(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1:]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(lengths):
    counts = np.bincount(lengths, minlength=11).astype(np.int64)
    fixed = sum(n for _, n in packing.reduced(counts, 10))
    rest = [w for w in range(1, 11) for _ in range(counts[w])]
    assert fixed + (fewest(rest, 10) if rest else 0) == fewest(sorted(lengths, reverse=True), 10)


def test_pieces_are_the_ids_of_the_texts(odd):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    got = [r.asDict() for r in packing.pack(odd, capacity=100, ids=True).collect()]
    want = Counter()
    for r in odd.collect():
        ids = [*reference.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 100
        cuts = [0, len(ids)] if len(ids) <= 100 else [*([0] if first else []), *range(first, len(ids) + 1, 100)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        assert len(r["ids"]) == r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in places.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 100


def test_ids_agree_with_the_vocabulary_file_on_odd_characters():
    fast = packing.encoder("byte_bpe_50k.json")
    slow = pytest.importorskip("tokenizers").Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    for start in range(0, 0x3000, 64):
        text = "".join(f"a{chr(c)}b {chr(c)}1 " for c in range(start, start + 64))
        assert list(fast(text)) == slow.encode(text, add_special_tokens=False).ids


def test_empty_table(empty):
    assert packing.pack(empty).count() == 0


def test_queries_give_the_ids_of_a_plain_tokenizer(odd, tmp_path, spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from voicelake.llm.queries import QUERIES

    plain = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a <|endoftext|> b", "  <|endoftext|>  \n<|endoftext|><|endoftext|>é", "<|endoftext", "<|endoftext|>" * 3 + " x"]
    fast = packing.encoder("byte_bpe_50k.json", special=True)
    assert [list(fast(t)) for t in texts] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = zlib.crc32(np.array([*plain.encode("<|endoftext|> 1234", add_special_tokens=False).ids, 0], "<u4").tobytes())
    for packed in (QUERIES["op4_packing"](spark, str(tmp_path)), corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))):
        assert [r.ids_crc32 for r in packed.where("doc_id = 8").collect()] == [want]
