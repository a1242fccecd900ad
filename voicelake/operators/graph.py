"""Relationship graphs: connected components, closures over anchors, shortest paths, leak-free component splits.

Nodes are text keys, and numbers inside a search. Every step is a grouped minimum joined back to the edges, so a hub that holds
a third of the edges is one aggregated row on one side of a join whose other side AQE may split. Neighbour lists are
never collected. Each round ends with a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelake.operators.prefix import hash_ranked, null_safe
from voicelake.session import cut


def star_edges(df: DataFrame, keys: Column, carry: Sequence[str] = ()) -> DataFrame:
    """Edges from the first key of each row to all its keys. A row with one key gives a loop, so the key is kept."""
    # unnested with the outer form: a filter on the derived array would be pushed down and compute it again
    present = df.select(*carry, F.array_distinct(F.array_compact(keys)).alias("__k"))
    return present.select(*carry, F.try_element_at("__k", F.lit(1)).alias("a"), F.explode_outer("__k").alias("b")).where("b IS NOT NULL")


#: Edges that a task looks at together before anything is shuffled. It bounds the memory of a task, not the graph.
CHUNK = 1 << 21


def _roots(count: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of its component for each of `count` nodes: roots hook on smaller ones until no edge leads out."""
    root = np.arange(count)
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low != high
        if not apart.any():
            return root
        u, v = u[apart], v[apart]
        np.minimum.at(root, high[apart], low[apart])
        while ((up := root[root]) != root).any():
            root = up


def _forest(edges: list[pa.RecordBatch]) -> pa.Table:
    """(a, b) for every node of these edges: the node, and the smallest one that they lead to."""
    ends = pa.chunked_array([e.column(c) for c in (0, 1) for e in edges]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place, names = rank[ends.indices.to_numpy()], ends.dictionary.take(pa.array(order))
    return pa.table({"node": names, "root": names.take(pa.array(_roots(len(order), *np.split(place, 2))))})


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the nodes of some edges at a time. A forest stands for its edges while it has at most CHUNK / 2 nodes."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            found = _forest(held)
            held, rows = found.to_batches(), found.num_rows
            if rows > CHUNK // 2:
                yield from found.to_batches(max_chunksize=1 << 16)
                held, rows = [], 0
    if rows:
        yield from _forest(held).to_batches(max_chunksize=1 << 16)


def _hubs(edges: DataFrame, marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, hub, marks) of all nodes, and (hub, root, component): hubs of one component share its root and its smallest node.

    Each task first looks for the components of its own edges, so a node travels once a chunk and not once an edge. A node that
    has several roots joins them: this is the graph of the roots, which are numbers. It is contracted at random: every
    node goes to the first of itself and its neighbours in a random order, and the edges between the nodes that are left make the
    next round's graph, a fraction of this one. The order is dealt anew every fourth round, so that no graph is bad for it.

    A number is a hash of the name. Two roots with one number would be one component, so another hash is taken then. `marks`
    has (node, mark); the marks of a node come out as an array, and marked nodes outside the graph are components of their own.
    """
    met = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(_met, "node string, root string")
    seed = 0
    while True:
        number = lambda c: F.xxhash64(c, F.lit(seed))  # noqa: B023, E731
        every = met.select("node", number("root").alias("root"), (F.col("node") == F.col("root")).alias("own"))
        if marks is not None:
            every = every.withColumn("mark", F.lit(None).cast("string")).unionByName(marks.select("node", "mark"), allowMissingColumns=True)
        whole = Window.partitionBy("node")
        order = whole.orderBy(F.col("root").asc_nulls_last(), F.col("own").desc())
        seen = {"low": F.first("root").over(order), "before": F.lag("root").over(order), "nth": F.row_number().over(order)}
        placed = every.withColumns(seen | ({"marks": F.collect_set("mark").over(whole)} if marks is not None else {})).where("nth = 1 OR root <> before")
        placed = placed.withColumns({"hub": F.coalesce("low", number("node")), "own": F.coalesce("own", F.lit(True)), "first": F.col("nth") == 1})
        # a row of a node, and one more for each further root of it; a node that is a root names it
        nodes = cut(placed.select(F.when(F.col("first") | F.col("own"), F.col("node")).alias("node"), "hub", F.when(~F.col("first"), F.col("root")).alias("other"), "own",
                                  *([F.when(F.col("first"), F.col("marks")).alias("marks")] if marks is not None else [])))
        named = cut(nodes.where("own").groupBy(F.coalesce("other", "hub").alias("hub")).agg(F.min("node").alias("name"), F.max("node").alias("clash")).withColumn("clash", F.col("clash") != F.col("name")))
        if named.where("clash").isEmpty():
            break
        seed += 1
    pairs, moves = cut(nodes.where("other IS NOT NULL").select(F.least("hub", "other").alias("u"), F.greatest("hub", "other").alias("v")).distinct()), []
    while not pairs.isEmpty():
        around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if len(moves) < 4:  # numbers are a random order themselves
            first = around.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
        else:
            place = lambda c: F.xxhash64(c, F.lit(len(moves) // 4))
            first = around.groupBy("u").agg(F.min_by("v", place("v")).alias("v"), F.min(place("v")).alias("at")).select("u", F.when(F.col("at") < place("u"), F.col("v")).otherwise(F.col("u")).alias("to"))
        moves.append(cut(first))
        here = pairs.join(moves[-1], "u").select(F.col("to").alias("x"), F.col("v").alias("u")).join(moves[-1], "u").where("x <> to")
        pairs = cut(here.select(F.least("x", "to").alias("u"), F.greatest("x", "to").alias("v")).distinct(), replaces=pairs)
    nodes = nodes.where("other IS NULL").drop("other", "own")
    if not moves:
        return nodes, named.select("hub", F.col("hub").alias("root"), F.col("name").alias("component"))
    roots = moves.pop()
    while moves:
        later = roots.select(F.col("u").alias("to"), F.col("to").alias("root"))
        roots = moves.pop().join(later, "to", "left").select("u", F.coalesce("root", "to").alias("to"))
    placed = cut(named.join(roots.select(F.col("u").alias("hub"), F.col("to").alias("root")), "hub", "left").select("hub", "root", "name"))
    # a hub without pairs is named already
    names = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("name").alias("component"))
    return nodes, placed.join(names, "root", "left").select("hub", F.coalesce("root", "hub").alias("root"), F.coalesce("component", "name").alias("component"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the component is its smallest node (see `_hubs`)."""
    nodes, hubs = _hubs(edges)
    return nodes.join(hubs, "hub").select("node", "component")


def labeller(edges: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """A function that gives rows the `component` of the node in a column: for few rows of a large graph, whose nodes do not move then."""
    nodes, hubs = _hubs(edges)
    return lambda rows, node: rows.join(nodes.select(F.col("node").alias(node), "hub"), node).join(hubs.select("hub", "component"), "hub").drop("hub")


def relationship_components(items: DataFrame, item: str, keys: Column) -> DataFrame:
    """(item, component) of items that share keys. An item without keys is its own component `item:<id>`."""
    keyed = items.select(item, F.array_distinct(F.array_compact(keys)).alias("__k"))
    labels = connected_components(star_edges(items, keys))
    first = keyed.select(item, F.try_element_at("__k", F.lit(1)).alias("node"))
    joined = first.join(labels, "node", "left")
    return joined.select(item, F.coalesce("component", F.concat(F.lit("item:"), F.col(item).cast("string"))).alias("component"))


def component_keys(items: DataFrame, item: str, keys: Column, components: DataFrame) -> DataFrame:
    """Distinct (component, key) pairs: the key set of each component in long form."""
    long = items.select(item, F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
    return long.join(components, item).select("component", "key").distinct()


def keyed_components(items: DataFrame, keys: Column) -> DataFrame:
    """Distinct (component, key) pairs of the components that the keys themselves make: a key is a node of one component."""
    return connected_components(star_edges(items, keys)).select("component", F.col("node").alias("key"))


def divided_keys(items: DataFrame, keys: Column, part: str) -> DataFrame:
    """Keys that occur in more than one partition: there must be none after a component split."""
    long = items.select(part, F.explode(F.array_distinct(F.array_compact(keys))).alias("key")).distinct()
    return long.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1")


def validation_takes(sizes: Sequence[tuple[int, int]], fraction: float) -> dict[int, int]:
    """How many components of each size the largest-first greedy gives to validation.

    `sizes` are (size, components of that size). The visit goes down the sizes; inside one size a component is taken
    while the target is not reached and enough rows stay outside, which is a count in closed form.
    """
    total, components = sum(c * n for c, n in sizes), sum(n for _, n in sizes)
    target = max(1, round(total * fraction)) if components > 1 else 0
    taken, value = {}, 0
    for size, n in sorted(sizes, reverse=True):
        take = max(0, min(n, -((value - target) // size), (total - target - value) // size)) if size else 0
        taken[size] = take
        value += take * size
    if target > 0 and value == 0 and sizes:
        taken[max(sizes)[0]] = 1
    return taken


def split_components(components: DataFrame, component: str, size: str, fraction: float, seed: int | str) -> DataFrame:
    """Assign whole components to train or val, largest first, equal sizes in hash order.

    Only the histogram of sizes reaches the driver: at most sqrt(2 * rows) pairs. The rows are ranked inside their size
    class in pieces, because one class (the singletons) usually holds most components.
    """
    components = cut(components)
    histogram = [(int(r[0]), int(r[1])) for r in components.groupBy(size).agg(F.count("*")).toLocalIterator()]
    takes = validation_takes(histogram, fraction)
    spark = components.sparkSession
    limits = spark.createDataFrame([(s, k) for s, k in takes.items() if k], "__size bigint, __take bigint")
    ranked = hash_ranked(components, [size], component, seed, "__rank")
    joined = ranked.join(limits, F.col(size) == F.col("__size"), "left")
    return joined.withColumn("split", F.when(F.col("__rank") <= F.col("__take"), "val").otherwise("train")).drop("__rank", "__size", "__take")


def poisoned_nodes(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Nodes whose component touches an anchor; an anchor outside the graph poisons itself. Only they are named."""
    nodes, hubs = _hubs(edges, anchors.select("node", F.lit("anchor").alias("mark")))
    touched = nodes.where(F.size("marks") > 0).select("hub").distinct().join(hubs, "hub").select("root").distinct()
    return nodes.select("node", "hub").join(hubs.join(touched, "root", "left_semi"), "hub").select("node", "component")


def poisoned_items(variants: Mapping[str, DataFrame], anchors: DataFrame, keys: DataFrame, item: str) -> DataFrame:
    """(variant, flagged): how many items hold a key whose component touches an anchor, in each of several graphs."""
    wanted = keys.select(item, "node").distinct()
    parts = [wanted.join(poisoned_nodes(edges, anchors).select("node"), "node", "left_semi").select(F.lit(name).alias("variant"), item).distinct() for name, edges in variants.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("variant").agg(F.count("*").alias("flagged"))


def spanning_components(items: DataFrame, item: str, keys: Column, split: str) -> DataFrame:
    """Components that occur in more than one split, with the splits. The first key of an item is marked with its split."""
    starts = items.select(F.try_element_at(F.array_compact(keys), F.lit(1)).alias("node"), F.col(split).alias("mark")).distinct().where("node IS NOT NULL")
    nodes, hubs = _hubs(star_edges(items, keys), starts)
    sides = nodes.select("hub", F.explode("marks").alias("mark")).distinct().join(hubs, "hub").groupBy("component", "mark").agg(F.lit(1).alias("n"))
    # at most one entry per split name
    return sides.groupBy("component").agg(F.count("*").alias("splits"), F.concat_ws(",", F.array_sort(F.collect_set("mark"))).alias("names")).where("splits > 1")


def distances(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Fewest edges from each reachable node to an anchor, with the previous node on one shortest path.

    Breadth-first from all anchors at once. Edges go both ways, so what a level reaches lies in the level before it, in
    itself or in the next one: new nodes are told by an anti-join with two levels, and each level is written once. The
    smallest previous node wins, so the path is the same on every run.
    """
    both = edges.select("a", "b").where("a <> b")
    # an edge that is there twice changes no minimum
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    levels = [cut(anchors.select("node").distinct().withColumn("distance", F.lit(0)).withColumn("previous", F.lit(None).cast("string")))]
    while not levels[-1].isEmpty():
        reached = both.join(levels[-1].select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("previous"))
        known = levels[-1].select("node") if len(levels) < 2 else levels[-1].select("node").unionByName(levels[-2].select("node"))
        levels.append(cut(reached.join(known, "node", "left_anti").select("node", F.lit(len(levels)).alias("distance"), "previous")))
    # each level has a folder of its own, so one reader takes them all
    return anchors.sparkSession.read.schema(levels[0].schema).parquet(*[level._work_path for level in levels])


def paths(starts: DataFrame, reached: DataFrame, claims: DataFrame, provenance: Sequence[str]) -> DataFrame:
    """The edges of one shortest path from each start node to an anchor, with who claims them.

    `reached` is the result of `distances`: each node knows the next one towards its anchor, so all paths are followed at
    once, one join a step, each step a table of its own. Of several claims for an edge, in either direction, the smallest is named.
    Rows are (start, step from 1, node, next, provenance); a start that is an anchor or reaches none has no row.
    """
    onward = cut(reached.where("previous IS NOT NULL").select("node", F.col("previous").alias("next"), "distance"))
    ends = F.struct(*[F.col(c) for c in provenance])
    used = onward.select(F.least("node", "next").alias("low"), F.greatest("node", "next").alias("high")).distinct()
    placed = claims.where("a <> b").withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    named = cut(placed.join(used, ["low", "high"], "left_semi").groupBy("low", "high").agg(F.min(ends).alias("claim")))
    step = cut(starts.select(F.col("node").alias("start"), "node").distinct().join(onward, "node").select("start", F.lit(1).alias("step"), "node", "next", "distance"))
    steps = [step]
    while not steps[-1].where("distance > 1").isEmpty():
        ahead = steps[-1].where("distance > 1").select("start", (F.col("step") + 1).alias("step"), F.col("next").alias("node"))
        steps.append(cut(ahead.join(onward, "node").select("start", "step", "node", "next", "distance")))
    walked = starts.sparkSession.read.schema(step.schema).parquet(*[s._work_path for s in steps])
    edge = walked.withColumns({"low": F.least("node", "next"), "high": F.greatest("node", "next")})
    return edge.join(named, ["low", "high"]).select("start", "step", "node", "next", *[F.col(f"claim.{c}").alias(c) for c in provenance])


def component_sizes(items: DataFrame, item: str, keys: Column) -> DataFrame:
    """(component, size) of `relationship_components`: items are counted by their first key before components are looked up."""
    key = F.try_element_at(F.array_compact(keys), F.lit(1))
    lone = F.when(key.isNull(), F.concat(F.lit("item:"), F.col(item).cast("string")))
    counted = items.groupBy(key.alias("node"), lone.alias("lone")).agg(F.count("*").alias("n"))
    nodes, hubs = _hubs(star_edges(items, keys))
    placed = counted.where("lone IS NULL").join(nodes, "node").groupBy("hub").agg(F.sum("n").alias("n"))
    named = placed.join(hubs, "hub").select("component", "n").unionByName(counted.where("lone IS NOT NULL").select(F.col("lone").alias("component"), "n"))
    return named.groupBy("component").agg(F.sum("n").alias("size"))


def component_summary(components: DataFrame, item: str) -> DataFrame:
    """Size and smallest and largest member per component (the member list itself stays in long form)."""
    return components.groupBy("component").agg(F.count("*").alias("members"), F.min(item).alias("first"), F.max(item).alias("last"))


def labelled_by_variant(edges: DataFrame, variants: Sequence[str], variant: str = "variant") -> DataFrame:
    """Components of several graphs in one run: the variant is part of the node key."""
    sep = "|"
    named = edges.where(F.col(variant).isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())  # concat_ws would shift a null
    scoped = named.select(F.concat_ws(sep, variant, "a").alias("a"), F.concat_ws(sep, variant, "b").alias("b"))
    labels = connected_components(scoped)
    cutoff = lambda c: F.regexp_replace(c, r"^[^|]*\|", "")
    return labels.select(F.split_part("node", F.lit(sep), F.lit(1)).alias(variant), cutoff("node").alias("node"), cutoff("component").alias("component")).where(
        F.col(variant).isin(*variants))
