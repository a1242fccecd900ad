"""Graph and selection operators against brute force on random small cases."""

import random

from pyspark.sql import functions as F
from voicelake.operators import graph, prefix, select


def _components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in list(parent)}


def test_connected_components_chain_star_loop_and_random(spark):
    rng = random.Random(1)
    edges = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("hub", f"leaf{i}") for i in range(30)] + [("alone", "alone")]
    edges += [(f"r{rng.randrange(60):02d}", f"r{rng.randrange(60):02d}") for _ in range(45)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == _components(edges)


def _greedy_split(sizes, fraction):
    total = sum(sizes)
    target = max(1, round(total * fraction)) if len(sizes) > 1 else 0
    value, taken = 0, {}
    for c in sorted(sizes, reverse=True):
        if value < target and total - value - c >= target:
            taken[c] = taken.get(c, 0) + 1
            value += c
    if target > 0 and value == 0:
        taken[max(sizes)] = 1
    return taken


def test_validation_takes_equal_the_walk():
    rng = random.Random(2)
    for _ in range(3000):
        sizes = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 14))]
        histogram = [(c, sizes.count(c)) for c in set(sizes)]
        got = {c: k for c, k in graph.validation_takes(histogram, 0.2).items() if k}
        assert got == _greedy_split(sizes, 0.2), sizes


def test_capped_selection_equals_the_walk(spark):
    rng = random.Random(3)
    for _ in range(4):
        rows = [(f"k{i:03d}", i) for i in range(60)]
        groups = {k: {f"g{rng.randrange(12)}" for _ in range(rng.randrange(0, 3))} for k, _ in rows}
        caps = {f"g{i}": rng.randrange(1, 4) for i in range(12)}
        used, want = {}, set()
        for k, _ in rows:
            if all(used.get(g, 0) < caps[g] for g in groups[k]):
                want.add(k)
                for g in groups[k]:
                    used[g] = used.get(g, 0) + 1
        members = [(k, g, caps[g]) for k, gs in groups.items() for g in gs]
        got = select.capped_selection(spark.createDataFrame(rows, "key string, p int"), spark.createDataFrame(members, "key string, group string, cap int"), "key", "p")
        assert {r["key"] for r in got.collect()} == want


def test_ranks_match_plain_windows_with_a_hot_group(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") * 7919 % 101).alias("v"))
    got = {r["id"]: r["rank"] for r in prefix.ranked(rows, ["g"], [F.col("v"), F.col("id")]).collect()}
    data = sorted((r["g"], r["v"], r["id"]) for r in rows.collect())
    seen, want = {}, {}
    for g, _, i in data:
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert got == want
    hashed = prefix.hash_ranked(rows, ["g"], "id", 5).groupBy("g").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.count_distinct("rank").alias("d")).collect()
    assert all(r["n"] == r["m"] == r["d"] for r in hashed)


def test_final_pairs_never_share_a_person(spark):
    rng = random.Random(4)
    rows = [("hi", str(rng.randrange(30)) if rng.random() < 0.5 else None, str(rng.randrange(30)), rng.choice(["a", "b", "c"]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "language string, source_speaker string, target_speaker string, generator string, row_index int")
    anchors = spark.createDataFrame([("hi", "3"), ("hi", "7")], "language string, speaker string")
    pairs = select.select_final_pairs(df, ["language"], 10, anchors).collect()
    people = [p for r in pairs for p in {r["source"], r["target"]} if p]
    assert pairs and len(people) == len(set(people))


def test_distances_and_poison(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    anchors = spark.createDataFrame([("a",), ("z",)], "node string")
    assert {r["node"]: r["distance"] for r in graph.distances(edges, anchors).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "z": 0}
    assert {r["node"] for r in graph.poisoned_nodes(edges, anchors).collect()} == {"a", "b", "c", "d", "z"}


def trimmed_by_walking(rows, cap):
    """Drop log of the sequential walk over (group, split, speaker, turn, shard, row_group, bytes)."""
    plan = {}
    for group, split, speaker, turn, shard, number, size in rows:
        entry = plan.setdefault(group, {"train": {}, "groups": {}})
        entry["groups"].setdefault((split, speaker), set()).add((shard, number, size))
        if split == "train":
            entry["train"][speaker] = turn
    cost = lambda e: sum(b for _, _, b in set().union(*e["groups"].values()))
    log = []
    while sum(cost(e) for e in plan.values()) > cap:
        options = [(-cost(e), name) for name, e in plan.items() if e["train"]]
        if not options:
            break
        name = min(options)[1]
        last = max(plan[name]["train"], key=lambda s: plan[name]["train"][s])
        del plan[name]["train"][last], plan[name]["groups"][("train", last)]
        log.append((name, last, len(log) + 1))
    return log


def test_paths_equal_a_plain_search(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randint(0, 60):02}", f"n{rng.randint(0, 60):02}", rng.choice(["source", "target"]), f"w{rng.randint(0, 500)}") for _ in range(75)]
    edges += [("alone", "alone", "source", "w0"), ("far1", "far2", "target", "w1")]
    anchors, starts = ["n00", "n17", "off"], [f"n{i:02}" for i in range(61)] + ["far1", "n00", "n05", "unknown"]
    table = spark.createDataFrame(edges, "a string, b string, side string, row string")
    nodes = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    reached = graph.distances(table, nodes(anchors))
    got = {}
    for r in graph.paths(nodes(starts), reached, table, ("side", "row")).collect():
        got.setdefault(r.start, []).append((r.step, r.node, r.next, (r.side, r.row)))
    around, claim = {}, {}
    for a, b, side, row in edges:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
            key = frozenset((a, b))
            claim[key] = min(claim.get(key, (side, row)), (side, row))
    level, distance = set(anchors), dict.fromkeys(anchors, 0)
    while level:
        level = {n for x in level for n in around.get(x, ()) if n not in distance}
        distance.update(dict.fromkeys(level, max(distance.values()) + 1))
    want = {}
    for start in set(starts):
        node, steps = start, []
        while distance.get(node):
            following = min(n for n in around[node] if distance.get(n) == distance[node] - 1)
            steps.append((len(steps) + 1, node, following, claim[frozenset((node, following))]))
            node = following
        if steps:
            want[start] = steps
    assert {k: sorted(v) for k, v in got.items()} == want and max(map(len, want.values())) > 2


def test_budget_trim_equals_the_walk(spark):
    import random

    from voicelake.operators import select

    for seed, cap in ((1, 900), (2, 400), (3, 10**6), (4, 0)):
        rng = random.Random(seed)
        rows = []
        for g in range(6):
            speakers = [(f"s{i}", "train" if i < 5 else "val", i) for i in range(7)]
            for name, split, turn in speakers:
                for _ in range(2):
                    number = rng.randint(0, 6)
                    rows.append((f"g{g}", split, name, turn, f"sh{g}", number, 10 * (number % 3 + 1)))
        df = spark.createDataFrame(rows, "grp string, split string, speaker string, turn_speaker int, shard string, row_group int, group_bytes bigint")
        kept, log = select.budget_trim(df, "grp", "speaker", cap)
        want = trimmed_by_walking(rows, cap)
        assert [tuple(r) for r in log.orderBy("step").collect()] == want
        gone = {(g, s) for g, s, _ in want}
        assert kept.count() == sum(1 for r in rows if r[1] != "train" or (r[0], r[2]) not in gone)


def picked_by_walking(rows, sizes, order, k):
    """(group, speaker, turn, key) of the sequential walk over (group, speaker, key, shard, number, duration)."""
    out = []
    for group in sorted({r[0] for r in rows}):
        needed = set()
        for speaker in order[group]:
            left = [r for r in rows if r[:2] == (group, speaker)]
            for turn in range(1, k + 1):
                if not left:
                    break
                cost = lambda r: (0, 0) if r[3:5] in needed else (1, sizes.get((group, *r[3:5]), 10**12))
                best = min(left, key=lambda r: (cost(r), -r[5], r[2]))
                left.remove(best)
                needed.add(best[3:5])
                out.append((group, speaker, turn, best[2]))
    return sorted(out)


def test_picks_equal_the_walk(spark):
    for seed, block in ((1, 1000), (2, 8)):
        rng = random.Random(seed)
        rows = [(f"g{i % 2}", f"s{rng.randrange(14):02}", f"k{i:03}", f"sh{rng.randrange(2)}", rng.randrange(9), float(rng.randrange(1, 6))) for i in range(180)]
        sizes = {(g, s, n): rng.randrange(1, 5) for g in ("g0", "g1") for s in ("sh0", "sh1") for n in range(8)}
        df = spark.createDataFrame(rows, "grp string, speaker string, row_key string, shard string, row_group int, duration double")
        given = spark.createDataFrame([(*k, v) for k, v in sizes.items()], "grp string, shard string, row_group int, bytes bigint")
        keyed = df.withColumns({"scope": select.joined_key("grp"), "person": select.joined_key("grp", "speaker"), "place": select.joined_key("grp", "shard", "row_group")})
        got = select.pick_recordings(df, ["grp"], "speaker", "row_key", given, [F.lit(0)], 3)
        order = {g: sorted({r[1] for r in rows if r[0] == g}) for g in ("g0", "g1")}
        want = picked_by_walking(rows, sizes, order, 3)
        assert sorted((r.grp, r.speaker, r.turn, r.row_key) for r in got.collect()) == want
        # the same walk in blocks of other sizes, two turns a speaker in turn, some places known before
        places = [(g, s, 0) for g in ("g0", "g1") for s in ("sh0", "sh1")]
        slots = [(g, f"{g}|{s}", t, (t - 1) * len(order[g]) + i + 1) for g in order for t in (1, 2) for i, s in enumerate(order[g]) if sum(r[:2] == (g, s) for r in rows) >= t]
        table = spark.createDataFrame(slots, "scope string, person string, turn int, position bigint")
        used = spark.createDataFrame([(f"{g}|{s}|{n}",) for g, s, n in places], "place string")
        walked = select.reusing_walk(keyed, table, "row_key", F.lit(0), [F.abs(F.col("duration") - 3)], used, block)
        needed, taken, plain = set(places), set(), []
        for scope, person, turn, position in sorted(slots, key=lambda x: (x[0], x[3])):
            own = [r for r in rows if f"{r[0]}|{r[1]}" == person and r[2] not in taken]
            best = min(own, key=lambda r: ((r[0], *r[3:5]) not in needed, abs(r[5] - 3), r[2]))
            taken.add(best[2])
            needed.add((best[0], *best[3:5]))
            plain.append((scope, position, best[2]))
        assert sorted((r.scope, r.position, r.row_key) for r in walked.collect()) == sorted(plain)
    assert select.pick_recordings(df.limit(0), ["grp"], "speaker", "row_key", given, [F.lit(0)]).count() == 0


def test_nodes_of_one_number_stay_apart(spark, monkeypatch):
    real, calls = F.xxhash64, []

    def weak(*columns):
        calls.append(columns)
        return F.lit(1).cast("bigint") if len(calls) == 1 else real(*columns)

    monkeypatch.setattr(graph.F, "xxhash64", weak)
    edges = [("a", "b"), ("c", "d"), ("e", "e")]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == _components(edges) and len(calls) > 1


def test_claims_are_parsed_once(spark):
    """The plan of the closure edges holds each pattern a few times, not once for every place of a parsed name."""
    from voicelake.operators import identity
    from voicelake.plans import standins as st

    folder = "/root/testdata/sf0.001"
    edges = identity.closure_edges(st.manifest(spark, folder), st.inventory(spark, folder))
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = edges._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    assert plan.lower().count("rlike") <= 40, plan.lower().count("rlike")


def test_closure_claims_hold_each_edge_once_with_its_smallest_claim(spark):
    """Rows that write the same names are one claim, of the smallest row."""
    from voicelake.operators import identity

    schema = "window_id string, dataset_id string, spoken_language string, generator string, source_speaker string, source_reference string, target_speaker string, target_reference string"
    rows = [(f"w{i}", "indicsynth", "hi", "vits" if i % 2 else "xtts_v2", None, None, "7", "5-7-m.wav" if i else "05-7-m.wav") for i in (3, 1, 0, 2)]
    listed = spark.createDataFrame([(f"i{i}", "hindi", "5", "7", "5-7-m.m4a") for i in (2, 1)], "row_key string, language string, record_id string, speaker string, fname string")
    got = sorted(map(tuple, identity.closure_claims(spark.createDataFrame(rows, schema), listed).collect()))
    star = [("s:hindi:7", b, "target", "w0", "xtts_v2") for b in ("j:hindi:5", "r:hindi:5-7-m", "s:hindi:7")]
    assert got == sorted(star + [("j:hindi:5", b, "inventory", "i1", None) for b in ("j:hindi:5", "r:hindi:5-7-m", "s:hindi:7")])
