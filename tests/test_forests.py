"""Edges meet in the task that reads them: a node is shuffled once a chunk, and what the chunks leave apart is joined."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from voicelake.operators import graph


def components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in list(root)}


def batches(edges, size):
    return [pa.record_batch({"a": [a for a, _ in edges[i:i + size]], "b": [b for _, b in edges[i:i + size]]}) for i in range(0, len(edges), size)]


def test_a_forest_names_each_node_once():
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(260)] * 3 + [(f"p{i}", f"p{i + 1}") for i in range(100)] + [("é", "z"), ("lone", "lone")]
    rows = [(r["node"], r["root"]) for t in graph._met(iter(batches(edges, 50))) for r in t.to_pylist()]
    assert dict(rows) == components(edges) and len(rows) == len(dict(rows))


def test_chunks_that_are_full_are_given_out(monkeypatch):
    """Repeated edges shrink to their forest and stay; a forest of many nodes goes out, and the next chunk begins anew."""
    monkeypatch.setattr(graph, "CHUNK", 40)
    same = [(f"a{i % 5}", "hub") for i in range(400)]
    assert len([r for t in graph._met(iter(batches(same, 10))) for r in t.to_pylist()]) == 6
    path = [(f"n{i:03}", f"n{i + 1:03}") for i in range(200)]
    rows = [(r["node"], r["root"]) for t in graph._met(iter(batches(path, 10))) for r in t.to_pylist()]
    assert 200 < len(rows) < 260 and components(rows) == components(path)


def test_components_over_partitions_and_variants(spark):
    """Random graphs dealt over partitions, so that nodes have several roots; and what is poisoned in two graphs."""
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(330)] + [(f"p{i}", f"p{i + 1}") for i in range(60)]
    df = spark.createDataFrame(edges, "a string, b string").repartition(13)
    assert {r.node: r.component for r in graph.connected_components(df).collect()} == components(edges)
    anchors = spark.createDataFrame([("p3",), ("out",), ("n1",), ("p3",)], "node string")
    want = components([*edges, ("out", "out")])
    bad = {want.get(a, a) for a in ("p3", "out", "n1")}
    assert sorted((r.node, r.component) for r in graph.poisoned_nodes(df, anchors).collect()) == sorted((x, c) for x, c in want.items() if c in bad)
    keys = spark.createDataFrame([("w1", "p50"), ("w1", "p51"), ("w2", "q"), ("w3", "nowhere")], "item string, node string")
    found = graph.poisoned_items({"one": df, "two": df.unionByName(spark.createDataFrame([("q", "p9")], df.schema))}, anchors, keys, "item")
    assert sorted((r.variant, r.flagged) for r in found.collect()) == [("one", 1), ("two", 2)]


def test_spanning_components_over_partitions(spark):
    items = spark.createDataFrame([("x", ["a", "b"]), ("y", ["c", None, "b"]), ("x", ["d"]), ("x", ["d"]), ("z", [None, "e"]), ("y", [])], "split string, keys array<string>").repartition(6)
    assert [(r.component, r.splits, r.names) for r in graph.spanning_components(items, "keys", F.col("keys"), "split").collect()] == [("a", 2, "x,y")]


def test_sizes_are_counted_once_by_first_keys(spark):
    """Sizes are those of the items of each component, also of items without keys; a split reads them from a table."""
    items = spark.createDataFrame([("i1", ["a", "b"]), ("i2", [None, "b"]), ("i3", ["c"]), ("i4", []), ("i5", ["c"]), ("i5", ["c"])], "item string, keys array<string>")
    sizes = graph.component_sizes(items, "item", F.col("keys"))
    labels = graph.relationship_components(items, "item", F.col("keys")).groupBy("component").agg(F.count("*").alias("size"))
    got = sorted((r.component, r.size) for r in sizes.collect())
    assert got == sorted((r.component, r.size) for r in labels.collect()) == [("a", 2), ("c", 3), ("item:i4", 1)]
    assert any("/voicelake-work/" in f for f in graph.split_components(sizes, "component", "size", 0.2, 7).inputFiles())
