import hashlib

import numpy as np
import pytest

from voicelake.llm import substring_dedup as sd


def brute(rows, length):
    """{row: (n_bytes, n_removed, n_spans, sha)} of (doc_id, text), string by string."""
    data = [((-(2**63) if i is None else i), (t or "").encode()) for i, t in rows]
    first = {}
    for doc, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, (doc, p)), (doc, p))
    out = []
    for (i, _), (doc, b) in zip(rows, data):
        gone = np.zeros(len(b) + 2, dtype=bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (doc, p):
                gone[p + 1 : p + length + 1] = True
        runs = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, length):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(df, length).collect()), key=str)


def sample(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefé"), rng.integers(2, 8))) for _ in range(200)]
    passage = " ".join(rng.choice(words, 60))
    rows = []
    for i in range(n):
        body = list(rng.choice(words, rng.integers(0, 80)))
        kind = i % 6
        if kind == 1:
            body.insert(int(rng.integers(0, len(body) + 1)), passage)
        elif kind == 2 and rows:
            body = (rows[int(rng.integers(0, len(rows)))][1] or "").split(" ")
            if body:
                body[int(rng.integers(0, len(body)))] = "edited"
        elif kind == 3 and rows:
            body = [rows[int(rng.integers(0, len(rows)))][1] or ""]
        elif kind == 4:
            body = ["ab"] * 150 + body
        elif kind == 5:
            body += body + ["x" * 300]
        rows.append((int(rng.integers(0, 1000)) if i % 7 else i, " ".join(body)))
    return rows


@pytest.mark.parametrize("wide", [500, 3])
def test_against_every_string(make, monkeypatch, wide):
    monkeypatch.setattr(sd, "WIDE", wide)
    rows = sample(wide)
    assert got(make([(i, t, "a", "en") for i, t in rows]), 100) == brute(rows, 100)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id not in (4, 5)]
    assert got(odd.where("doc_id IS NULL OR doc_id NOT IN (4, 5)"), 50) == brute(rows, 50)
    assert sd.dedup(odd).where("doc_id = 5").first().n_removed == sd.dedup(odd).where("doc_id = 5").first().n_bytes


def test_empty_table(empty):
    assert sd.dedup(empty).count() == 0


def test_segments_give_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 5000).astype(np.uint8).tobytes()
    want = sd.anchors(data, 100)
    monkeypatch.setattr(sd, "SEGMENT", 700)
    for a, b in zip(want, sd.anchors(data, 100)):
        assert (a == b).all()


def test_ranks_are_suffix_order():
    text = np.frombuffer(b"banana$bandana$", dtype=np.uint8)
    rank = sd.ranks(text, 6)
    strings = [bytes(text[i : i + 6]) for i in range(len(text))]
    assert [sorted(set(strings)).index(s) for s in strings] == list(rank)
