"""The divergence audit against a plain recount, and its transducers against sorted lists."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from voicelake.llm import divergence as D

SF = "/root/testdata/sf0.001"


def plain(rows, min_docs=10, top=10):
    lower = str.maketrans(D.CAPITALS, D.SMALL)
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    kept = {lang: sorted((t for t, n in c.items() if n >= min_docs), key=str.encode) for lang, c in seen.items()}
    out = []
    for lang, terms in kept.items():
        sources = sorted((s for own, s in counts if own == lang), key=str.encode)
        totals = {s: sum(counts[lang, s][t] for t in terms) for s in sources}
        v, n = len(terms), sum(totals.values())
        p = {s: [1 + 10**9 * (counts[lang, s][t] + 2) // (totals[s] + 2 * v) for t in terms] for s in sources}
        q = [1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 2) // (n + 2 * v) for t in terms]
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(map(far, p[s], p[o])), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -value, i) for i, (value, o) in enumerate(pairs, 1)]
            typical = sorted((-far(a, b), t.encode()) for a, b, t in zip(p[s], q, terms) if counts[lang, s][t] and a > b)
            out += [(lang, s, "term", t.decode(), -value, i) for i, (value, t) in enumerate(typical[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_transducer_gives_places():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcé\U0001f600", k=rng.randint(1, 7))).encode() for _ in range(3000)})
    made = D.build(words)
    text = b" ".join([*words, b"zzz", b"abcabcabca", b"\xc3"]) + b" "
    data = np.frombuffer(text, np.uint8)
    starts = np.cumsum([0] + [len(w) + 1 for w in [*words, b"zzz", b"abcabcabca", b"\xc3"]])[:-1]
    which, place = made.ordinals(data, starts)
    got = dict(zip(which.tolist(), place.tolist()))
    assert got == {i: i for i in range(len(words))} | ({len(words) + 1: words.index(b"abcabcabca")} if b"abcabcabca" in words else {})
    again = D.Transducer.unpack(made.pack(), made.root)
    assert (again.ordinals(data, starts)[1] == place).all()


def test_transducer_is_minimal():
    assert len(D.build([b"tap", b"taps", b"top", b"tops"]).base) == 5
    assert len(D.build([]).base) == 1 and len(D.build([b"x" * 5000]).base) == 5001


def test_shares_do_not_overflow():
    big = np.array([10**14, 0, 7], np.int64)
    assert D.shares(big, np.int64(3 * 10**14)).tolist() == [1 + 10**9 * (int(c) + 2) // (3 * 10**14) for c in big]


@pytest.mark.parametrize("limits", [D.Limits(), D.Limits(shard_terms=48, round_bytes=6000, block=16, slice_bytes=2000, held_pairs=50)])
def test_audit_equals_the_plain_count(spark, limits):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if limits != D.Limits():
        docs = docs.where("length(text) < 3000")
    got = rows_of(D.audit(docs, limits=limits))
    assert got == plain([(r.text, r.lang, r.source) for r in docs.collect()])
    assert any(r[2] == "term" for r in got)


def test_audit_of_odd_rows(odd, empty):
    assert rows_of(D.audit(odd, min_docs=2, top=3)) == plain([(r.text, r.lang, r.source) for r in odd.collect()], 2, 3)
    assert D.audit(empty).count() == 0


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from voicelake.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["lang", "source", "part", "item", "value", "rank"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op11_source_divergence']})").fetchall()
    assert rows_of(QUERIES["op11_source_divergence"](spark, SF)) == sorted(want)
