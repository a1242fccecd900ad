"""Components of graphs that are mostly leaves: rows and the keys they carry."""

from pyspark.sql import functions as F

from voicelake.operators import graph
from voicelake.session import work_scope


def test_leaves_go_to_their_hubs_without_rounds(spark):
    """Stars of one hub each are done once their leaves are placed: no table beyond edges, nodes, pairs and none left over."""
    rows = [(f"o:{i // 5}", f"p:{i}") for i in range(60)] + [("lone", "lone")]
    with work_scope(spark) as scope:
        found = graph.connected_components(spark.createDataFrame(rows, "a string, b string"))
        got = {r.node: r.component for r in found.collect()}
        assert len(scope.paths) <= 3
    assert got == {**{f"o:{i}": f"o:{i}" for i in range(12)}, **{f"p:{i}": f"o:{i // 5}" for i in range(60)}, "lone": "lone"}


def test_chains_pairs_and_loops(spark):
    """A path, a pair of two leaves in either direction and twice, a cycle with leaves, and a loop."""
    rows = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("x", "y"), ("y", "x"), ("x", "y")] + [("z", "z")]
    rows += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c2", "a-leaf")]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {**{f"n{i}": "n0" for i in range(10)}, "x": "x", "y": "x", "z": "z", "c1": "a-leaf", "c2": "a-leaf", "c3": "a-leaf", "a-leaf": "a-leaf"}


def test_keyed_components_are_the_keys_of_the_items(spark):
    items = spark.createDataFrame([("i1", ["k1", "k2"]), ("i2", ["k2", None, "k3"]), ("i3", ["k9"]), ("i4", [])], "item string, keys array<string>")
    got = sorted((r.component, r.key) for r in graph.keyed_components(items, F.col("keys")).collect())
    labels = graph.relationship_components(items, "item", F.col("keys"))
    assert got == sorted((r.component, r.key) for r in graph.component_keys(items, "item", F.col("keys"), labels).collect())
    assert got == [("k1", "k1"), ("k1", "k2"), ("k1", "k3"), ("k9", "k9")]
