"""Registered selections without SQL against plain walks over the whole smallest tables."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voicelake.plans import standins
from voicelake.plans.catalog import QUERIES
from voicelake.plans.join_queries import candidates

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def claims(spark):
    return [r.asDict() for r in candidates(spark, FOLDER).where("target_speaker IS NOT NULL").collect()]


def name(row):
    return "" if row["source_speaker"] in (None, "", "None") else row["source_speaker"]


def turns_of(pairs):
    """(language, source, target, generator, anchored) with its turn in the generator."""
    lanes = defaultdict(list)
    for p in sorted(pairs, key=lambda p: (p[0], p[3], p[4], p[1], p[2])):
        lanes[p[0], p[3]].append(p)
    return [(turn, *p) for lane in lanes.values() for turn, p in enumerate(lane, 1)]


def pair_walk(pairs):
    """Pairs in priority order, and those that a walk with one pair a person keeps."""
    order = sorted(turns_of(pairs), key=lambda p: (p[0], p[4], "|".join(p[1:5]).encode()))
    people, kept = set(), []
    for turn, language, source, target, generator, anchored in order:
        who = {(language, x) for x in (source, target) if x} | ({(language, "")} if target == "" else set())
        if not who & people:
            people |= who
            kept.append((language, source, target, generator))
    return [p[1:5] for p in order], kept


def test_choose_pairs(spark, claims):
    got = {(r["language"], r["pair"], r["row_id"], r["place"]) for r in QUERIES["choose_pairs"](spark, FOLDER).collect()}
    order, kept = pair_walk({(r["language"], name(r), r["target_speaker"], r["generator"], 0) for r in claims})
    want = set()
    for language in {p[0] for p in order}:
        own = [p for p in kept if p[0] == language]
        chosen = (own + [p for p in order if p[0] == language and p not in set(own)])[:200]
        for p in chosen:
            rows = sorted(r["row_id"] for r in claims if (r["language"], name(r), r["target_speaker"], r["generator"]) == p)
            want |= {(language, "|".join(p), row, place) for place, row in enumerate(rows[:2], 1)}
    assert got == want and want


def test_select_final_pairs(spark, claims):
    anchors = {(r["language"], r["speaker"]) for r in standins.manifest(spark, FOLDER).where("label = 0 AND split = 'train'").select("language", "speaker").collect()}
    got = {(r["language"], r["source"], r["target"], r["generator"], r["rank"]) for r in QUERIES["select_final_pairs"](spark, FOLDER).collect()}
    hit = lambda r: 0 if {(r["language"], name(r)), (r["language"], r["target_speaker"])} & anchors else 1
    _, kept = pair_walk({(r["language"], name(r), r["target_speaker"], r["generator"], hit(r)) for r in claims})
    seen, want = Counter(), set()
    for p in kept:
        seen[p[0]] += 1
        if seen[p[0]] <= 200:
            want.add((*p, seen[p[0]]))
    assert got == want and want


def test_select_synthetic(spark, claims):
    """Two rows a source, two a target, twenty a component of people; then the rows the component cap kept out."""
    got = {(r["language"], r["row_id"], r["turn"], r["pass"], r["rank"]) for r in QUERIES["select_synthetic"](spark, FOLDER).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in claims:
        if r["source_speaker"] is not None:
            parent[find((r["language"], r["source_speaker"]))] = find((r["language"], r["target_speaker"]))
    lanes, turn = defaultdict(list), {}
    for r in claims:
        lanes[r["language"], r["generator"]].append(r["row_id"])
    for lane in lanes.values():
        turn.update({row: i for i, row in enumerate(sorted(lane), 1)})
    order = sorted(claims, key=lambda r: (turn[r["row_id"]], r["generator"], r["row_id"]))

    def walk(component_cap):
        used, kept = Counter(), []
        for r in order:
            language = r["language"]
            caps = [(("s", language, r["source_speaker"]), 2)] if r["source_speaker"] not in (None, "") else []
            caps += [(("t", language, r["target_speaker"]), 2)] if r["target_speaker"] != "" else []
            caps += [(("c", language, find((language, r["target_speaker"]))), component_cap)] if component_cap else []
            if all(used[g] < cap for g, cap in caps):
                used.update(g for g, _ in caps)
                kept.append(r["row_id"])
        return set(kept)

    strict, soft = walk(20), walk(None)
    want = set()
    for language in {r["language"] for r in claims}:
        rows = [(0 if r["row_id"] in strict else 1, r) for r in order if r["language"] == language and r["row_id"] in strict | soft]
        rows.sort(key=lambda x: x[0])
        want |= {(language, r["row_id"], turn[r["row_id"]], passed, rank) for rank, (passed, r) in enumerate(rows[:500], 1)}
    assert got == want and want


def test_select_attack_spread(spark):
    """400 rows a language and label: distinct speakers first (attacks in turn for spoofs), the rest in hash order."""
    rows = [r.asDict() for r in standins.manifest(spark, FOLDER).select(
        "window_id", "language", "label", F.coalesce("speaker", "target_speaker").alias("speaker"), F.coalesce("generator", F.lit("-")).alias("attack")).collect()]
    for r in rows:
        r["hash"] = hashlib.md5(f"la:{r['window_id']}".encode()).hexdigest()
    got = {(r["language"], r["label"], r["window_id"], r["pass"], r["rank"]) for r in QUERIES["select_attack_spread"](spark, FOLDER).collect()}
    want = set()
    for language, label in {(r["language"], r["label"]) for r in rows}:
        own = sorted((r for r in rows if (r["language"], r["label"]) == (language, label)), key=lambda r: (r["hash"], r["window_id"]))
        order, turn = own, Counter()
        if label == 1:
            placed = []
            for r in own:
                turn[r["attack"]] += 1
                placed.append((turn[r["attack"]], r["attack"], r["hash"], r["window_id"], r))
            order = [p[-1] for p in sorted(placed, key=lambda p: p[:4])]
        seen, first = set(), []
        for r in order:
            if r["speaker"] not in seen:
                seen.add(r["speaker"])
                first.append(r)
        chosen = {r["window_id"] for r in first}
        every = [(0, r) for r in first] + [(1, r) for r in own if r["window_id"] not in chosen]
        want |= {(language, label, r["window_id"], passed, rank) for rank, (passed, r) in enumerate(every[:400], 1)}
    assert got == want and want


def test_attack_spread_looks_at_late_turns_only_where_speakers_are_missing(spark, monkeypatch):
    """Many speakers are found in the first turns, with three tables; few of them need the whole group, and the walk stays the same."""
    from voicelake.operators import select
    from voicelake.session import work_scope

    monkeypatch.setattr(select, "GROUP_LIMIT", 8)
    rows = [(f"w{i}", "a", 1, f"s{i}", f"g{i % 2}") for i in range(60)] + [(f"v{i}", "b", 1, None if i == 7 else f"s{i % 3 if i < 38 else i}", f"g{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "window_id string, language string, label int, speaker string, attack string")
    walk = lambda d: {(r["language"], r["window_id"], r["pass"], r["rank"]) for r in select.attack_spread(d, ["language"], "speaker", "attack", "window_id", "la", 8).collect()}
    want = set()
    for language in "ab":
        own = sorted((hashlib.md5(f"la:{r[0]}".encode()).hexdigest(), r[0], r[3], r[4]) for r in rows if r[1] == language)
        turn, placed, seen, first = Counter(), [], set(), []
        for h, w, s, g in own:
            turn[g] += 1
            placed.append((turn[g], g, h, w, s))
        for p in sorted(placed, key=lambda p: p[:4]):
            if p[4] not in seen:
                seen.add(p[4])
                first.append(p[3])
        every = [(0, w) for w in first] + [(1, r[1]) for r in own if r[1] not in set(first)]
        want |= {(language, w, passed, rank) for rank, (passed, w) in enumerate(every[:8], 1)}
    assert walk(df) == want
    with work_scope(spark) as scope:
        walk(df.where("language = 'a'"))
        assert len(scope.paths) <= 3


def test_pairs_are_walked_whole_only_where_pairs_are_missing(spark, monkeypatch):
    """The first turns of each generator give the pairs if they hold enough that are disjoint; otherwise all are walked."""
    from voicelake.operators import select

    rows = [("a", f"s{i}", f"t{i}", f"g{i % 2}") for i in range(60)] + [("b", "s0" if i < 30 else f"s{i}", f"t{i}", "g0") for i in range(40)]
    rows += [("c", None, f"t{i}", "g0") for i in range(5)] + [("b", "None", f"u{i}", "g1") for i in range(3)]
    df = spark.createDataFrame(rows, "language string, source_speaker string, target_speaker string, generator string")
    anchors = spark.createDataFrame([("a", "t40"), ("b", "s39"), ("c", ""), ("b", "")], "language string, speaker string")
    run = lambda d: ({(*r,) for r in select.select_final_pairs(d, ["language"], 6, anchors).collect()}, {(*r,) for r in select.choose_pairs(d, ["language"], 6).collect()})
    whole = run(df)
    monkeypatch.setattr(select, "GROUP_LIMIT", 8)
    assert run(df) == whole and len(whole[0]) == 17
    pairs, kept = select.disjoint_pairs(df.where("language = 'a'"), ["language"], 6, anchors)
    assert pairs.count() == 16 and kept.count() == 16
