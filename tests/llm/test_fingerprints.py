import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from voicelake.llm import fingerprints as fp

SMALL = st.lists(st.integers(0, 4), max_size=64)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
        row = fresh
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(SMALL, SMALL), min_size=1, max_size=8))
def test_edit_distances(pairs):
    left, right = ([np.array(p[i], np.uint16) for p in pairs] for i in (0, 1))
    assert list(fp.edit_distances(left, right)) == [levenshtein(a, b) for a, b in pairs]


def plain(text):
    """The fingerprint of one text, byte by byte."""
    m32, m64 = 2**32 - 1, 2**64 - 1
    padded, values = [0] * 6 + list(text), []
    for i in range(len(text)):
        h = 0
        for c in padded[i : i + 7]:
            h = (h * 0x01000193 + c + 1) & m32
        h = h * 0x9E3779B1 & m32
        h ^= h >> 15
        h = h * 0x85EBCA6B & m32
        values.append(h ^ (h >> 13))
    ends = lambda k: [i for i, h in enumerate(values) if h & ((1 << k) - 1) == (1 << k) - 1]
    k = next(k for k in range(33) if len(ends(k)) < 64)

    def signature(k):
        out, chunk = "", 0
        for i, h in enumerate(values):
            chunk = (chunk + (h ^ (h << 31 & m64)) * 0x9E3779B97F4A7C15) & m64
            if i in set(ends(k)) or i == len(values) - 1:
                symbol = (((chunk ^ (chunk >> 29)) * 0xBF58476D1CE4E5B9 & m64) >> 52)
                out += chr(fp.DIGITS[symbol >> 6]) + chr(fp.DIGITS[symbol & 63])
                chunk = 0
        return out

    return f"{k}:{signature(k)}:{signature(k + 1)}"


def test_fingerprints_of_any_length_and_block(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [b"", b"a", b"", *[rng.integers(97, 101, n).astype(np.uint8).tobytes() for n in (5, 63, 64, 65, 500, 511, 512, 513, 3000)], b"a" * 700, b"ab" * 400]
    want = [plain(t) for t in texts]
    assert [fp.written(p) for p in fp.fingerprints(texts)] == want
    monkeypatch.setattr(fp, "BLOCK", 97)
    assert [fp.written(p) for p in fp.fingerprints(texts)] == want


def test_next_rows_and_likeness(spark, odd):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = fp.compare_with_next(odd).collect()
    assert len(got) == odd.count()
    ids = [r for r in odd.select("doc_id", "text").collect() if r.doc_id is not None and r.doc_id != 3]
    order = sorted(ids, key=lambda r: -r.doc_id)
    known = {r.doc_id: r for r in got}
    for a, b in zip(order, order[1:]):
        if a.doc_id - b.doc_id == 1:
            x, y = a.text or "", b.text or ""
            n = len(x) // 3
            text = x[: len(x) - n] + y[:n]
            row = known[a.doc_id]
            assert row.n_chars == len(x)
            assert row.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
            prints = fp.fingerprints([t.encode() for t in (x, text, y)])
            assert [row.fingerprint, row.edited_fingerprint] == [fp.written(p) for p in prints[:2]]
            assert [row.near_edited, row.near_next] == list(fp.likeness([(prints[0], prints[1]), (prints[0], prints[2])]))
    assert known[5].near_next == 1.0 and known[5].fingerprint == known[4].fingerprint


def test_one_row_and_no_row(make, empty):
    row = fp.compare_with_next(make([(1, "abcdef", "a", "en")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0
    assert fp.compare_with_next(empty).count() == 0
