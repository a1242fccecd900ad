import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from voicelake.llm import near_dedup as nd


def brute(rows):
    """The class (smallest id) of each row, comparing every pair of texts."""
    idf = np.array(rows_idf(rows))
    data = [nd.weighted((t or "").encode(), idf) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if nd.jaccard(data[i], data[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def rows_idf(rows):
    table = np.zeros(1 << nd.DF_BITS)
    for _, t in rows:
        np.add.at(table, nd.cells(nd.shingles((t or "").encode())[0]), 1)
    alone = np.clip(table - table.mean(), 1, len(rows))
    return 1 + nd.IDF_STRENGTH * np.log(len(rows) / alone) / np.log(len(rows))


def sample(seed, groups=12):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(words, 60))
    rows = []
    for g in range(groups):
        base = list(rng.choice(words, 150)) + (passage if g % 2 else [])
        for c in range(int(rng.integers(1, 14))):
            text = list(base)
            for _ in range(int(rng.integers(0, 9)) if c else 0):
                text[int(rng.integers(0, len(text)))] = str(rng.choice(words))
            rows.append((len(rows) + 1, " ".join(text)))
    rows += [(len(rows) + 1, None), (len(rows) + 2, ""), (len(rows) + 3, " \n"), (len(rows) + 4, "one two"), (len(rows) + 5, "one two"), (len(rows) + 6, "one  two"), (len(rows) + 7, "three")]
    return rows


@pytest.mark.parametrize("block", [1000, 3])
def test_classes_against_all_pairs(make, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = sample(block)
    got = {r.doc_id: r.class_id for r in nd.classes(make([(i, t, "a", "en") for i, t in rows])).collect()}
    assert got == brute(rows)


def test_recall_against_all_pairs_of_a_table(spark):
    """Code of its own: shingles as text, exact document frequencies, every pair of distinct texts that shares a shingle."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rng, last = np.random.default_rng(3), max(doc for doc, _ in rows)
    for doc, text in list(rows):  # and a copy of every document with words changed, about as many as the limit allows
        words = text.split(" ")
        for _ in range(int(rng.integers(0, len(words) // 40 + 1))):
            words[int(rng.integers(0, len(words)))] = f"other{rng.integers(0, 10**9)}"
        rows.append((last + doc, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    first, bags = {}, {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        if len(words) >= 5:
            key = " ".join(words)
            first.setdefault(key, doc)
            bags[first[key]] = Counter(zip(*[words[i:] for i in range(5)]))
    frequency = Counter()
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        frequency.update(set(zip(*[words[i:] for i in range(5)])))
    weight = {s: 1 + 0.1 * math.log(len(rows) / n) / math.log(len(rows)) for s, n in frequency.items()}
    mass = {doc: sum(n * weight[s] for s, n in bag.items()) for doc, bag in bags.items()}
    holders = defaultdict(list)
    for doc, bag in bags.items():
        for s, n in bag.items():
            holders[s].append((doc, n))
    alike, parent = [], {doc: doc for doc in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc, bag in bags.items():
        both = Counter()
        for s, n in bag.items():
            for other, m in holders[s]:
                if other < doc:
                    both[other] += min(n, m) * weight[s]
        for other, shared in both.items():
            likeness = shared / (mass[doc] + mass[other] - shared)
            if likeness >= 0.8:
                alike.append((other, doc))
            if likeness >= 0.795:  # hashed frequencies may lift a weight a little
                parent[find(doc)] = find(other)
    group = {r.doc_id: r.class_id for r in nd.classes(docs).collect()}
    found = sum(group[a] == group[b] for a, b in alike)
    assert len(alike) > 500 and found >= 0.99 * len(alike)
    wrong = [(a, group[a]) for a in bags if group[a] in bags and find(a) != find(group[a])]
    assert not wrong
    print(len(rows), "texts,", len(alike), "pairs,", found, "found")


def test_samples_agree_as_often_as_the_texts_are_similar():
    rng = np.random.default_rng(0)
    agree, want = [], []
    for _ in range(60):
        a = rng.integers(0, 2**64, 300, dtype=np.uint64)
        b = np.concatenate((a[: rng.integers(100, 300)], rng.integers(0, 2**64, 60, dtype=np.uint64)))
        x, y = ((np.sort(h), 1 + (np.sort(h) % np.uint64(5)).astype(float)) for h in (a, b))
        want.append(nd.jaccard(x, y))
        agree.append((nd.signature(*x) == nd.signature(*y)).mean())
    assert abs(np.mean(agree) - np.mean(want)) < 0.02
    assert np.std(np.array(agree) - want) < 0.08


def test_word_hashes_do_not_depend_on_place_or_chunks():
    words = [f"word{i}é".encode() for i in range(20_000)]
    together = nd.word_hashes(b"\t ".join(words) + b"\x0b")
    assert (together == np.concatenate([nd.word_hashes(w) for w in words])).all()
    assert len(nd.word_hashes(b"x" * 200_000)) == 1
    assert len(np.unique(together)) == len(set(words))


def test_odd_rows_and_keeping_one(odd, empty):
    got = nd.classes(odd).collect()
    assert len(got) == odd.count()
    by_text = {}
    for r in got:
        by_text.setdefault(r.node, set()).add(r.class_id)
    assert all(len(v) == 1 for v in by_text.values())
    kept = nd.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.component for r in got})
    assert nd.classes(empty).count() == 0 and nd.keep_one(empty).count() == 0
    assert hashlib.md5(b"").hexdigest() in by_text
