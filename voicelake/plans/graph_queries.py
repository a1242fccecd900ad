"""Registered queries for relationship graphs. Every graph is built from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.functions.ids import lang_normalize
from voicelake.operators import graph, identity
from voicelake.plans import standins as st
from voicelake.plans.registry import query, table
from voicelake.session import cut

# label propagation with a keyed recursive table: one label per node, improved until nothing changes
COMPONENTS = """{s}s AS (SELECT a, b FROM {e} UNION SELECT b, a FROM {e}),
{s}cc(node, component) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM {s}s GROUP BY a UNION
  SELECT s.a AS node, min(c.component) AS component FROM {s}cc c JOIN {s}s s ON s.b = c.node JOIN recurring.{s}cc r ON r.node = s.a
  WHERE c.component < r.component GROUP BY s.a)"""

ITEMS = """items AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS item, concat('o:', l_orderkey) AS k1,
  concat('p:', l_partkey, ':', l_suppkey, ':', l_linenumber) AS k2 FROM lineitem),
e AS (SELECT least(k1, k2) AS a, greatest(k1, k2) AS b FROM items)"""

ITEM_COMPONENTS = f"WITH RECURSIVE {ITEMS}, " + COMPONENTS.format(s="", e="e") + ", x AS (SELECT item, component FROM items JOIN cc ON cc.node = k1)"


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("item"),
        F.array(F.concat(F.lit("o:"), "l_orderkey"), F.concat(F.lit("p:"), "l_partkey", F.lit(":"), "l_suppkey", F.lit(":"), "l_linenumber")).alias("keys"))


@query("connected_components", ITEM_COMPONENTS + " SELECT node, component FROM cc")
def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.connected_components(graph.star_edges(_items(spark, folder), F.col("keys")))


@query("connected_components_dense", """WITH RECURSIVE e AS (SELECT DISTINCT concat('o:', l_orderkey) AS a, concat('p:', l_partkey) AS b FROM lineitem), """
       + COMPONENTS.format(s="", e="e") + " SELECT component, count(*) AS nodes FROM cc GROUP BY component")
def connected_components_dense(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and parts: nearly everything is one giant component with hubs."""
    keys = F.array(F.concat(F.lit("o:"), "l_orderkey"), F.concat(F.lit("p:"), "l_partkey"))
    labels = graph.connected_components(graph.star_edges(table(spark, folder, "lineitem"), keys))
    return labels.groupBy("component").agg(F.count("*").alias("nodes"))


@query("relationship_components", ITEM_COMPONENTS + """ SELECT item, component FROM x UNION ALL
SELECT concat('lone-', doc_id), concat('item:lone-', doc_id) FROM documents""")
def relationship_components(spark: SparkSession, folder: str) -> DataFrame:
    """Items with keys, and the documents as items without any."""
    lone = table(spark, folder, "documents").select(F.concat(F.lit("lone-"), "doc_id").alias("item"), F.array().cast("array<string>").alias("keys"))
    return graph.relationship_components(_items(spark, folder).unionByName(lone), "item", F.col("keys"))


@query("component_keys", ITEM_COMPONENTS + """ SELECT component, count(*) AS keys, count(*) FILTER (node LIKE 'o:%') AS orders FROM cc GROUP BY component""")
def component_keys(spark: SparkSession, folder: str) -> DataFrame:
    pairs = graph.keyed_components(_items(spark, folder), F.col("keys"))
    return pairs.groupBy("component").agg(F.count("*").alias("keys"), F.count_if(F.col("key").startswith("o:")).alias("orders"))


SPLIT = ITEM_COMPONENTS + """, z AS (SELECT component, count(*) AS size FROM x GROUP BY component),
h AS (SELECT size AS c, count(*) AS n, row_number() OVER (ORDER BY size DESC) AS i FROM z GROUP BY size),
t AS (SELECT sum(c * n) AS total, greatest(1, CAST(round_even(sum(c * n) * 0.2, 0) AS BIGINT)) AS target FROM h),
g(i, c, n, k, v) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL
  SELECT h.i, h.c, h.n, greatest(0, least(h.n, CAST(ceil((target - g.v) / h.c) AS BIGINT), CAST(floor((total - target - g.v) / h.c) AS BIGINT))),
    CAST(g.v + h.c * greatest(0, least(h.n, CAST(ceil((target - g.v) / h.c) AS BIGINT), CAST(floor((total - target - g.v) / h.c) AS BIGINT))) AS BIGINT)
  FROM g JOIN h ON h.i = g.i + 1, t),
r AS (SELECT z.component, z.size, row_number() OVER (PARTITION BY z.size ORDER BY md5(concat_ws(':', '7', z.component)), z.component) AS rn FROM z),
a AS (SELECT r.component, r.size, CASE WHEN rn <= k THEN 'val' ELSE 'train' END AS split FROM r JOIN g ON g.c = r.size)"""


@query("split_components", SPLIT + " SELECT component, size, split FROM a")
def split_components(spark: SparkSession, folder: str) -> DataFrame:
    sizes = graph.component_sizes(_items(spark, folder), "item", F.col("keys"))
    return graph.split_components(sizes, "component", "size", 0.2, 7)


@query("divided_keys", "SELECT concat('o:', l_orderkey) AS key, count(DISTINCT l_returnflag) AS parts FROM lineitem GROUP BY l_orderkey HAVING parts > 1")
def divided_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys on both sides of a split that ignores them."""
    return graph.divided_keys(table(spark, folder, "lineitem"), F.array(F.concat(F.lit("o:"), "l_orderkey")), "l_returnflag")


@query("component_summary", ITEM_COMPONENTS + " SELECT component, count(*) AS members, min(item) AS first, max(item) AS last FROM x GROUP BY component")
def component_summary(spark: SparkSession, folder: str) -> DataFrame:
    return graph.component_summary(graph.relationship_components(_items(spark, folder), "item", F.col("keys")), "item")


# identity claims of the manifest in SQL: strict parse of each role's reference
CLAIMS = f"""{st.MANIFEST}, claims0 AS (
  SELECT window_id, split, language, dataset_id, label, 'genuine' AS role, source_file AS ref, speaker AS declared, NULL AS verification, NULL AS evidence, NULL AS evidence_record FROM manifest WHERE label = 0
  UNION ALL SELECT window_id, split, language, dataset_id, label, 'source', source_reference, source_speaker, source_verification, source_evidence, split_part(source_reference, '-', 1) FROM manifest WHERE label = 1
  UNION ALL SELECT window_id, split, language, dataset_id, label, 'target', target_reference, target_speaker, target_verification, target_evidence, target_evidence_record FROM manifest WHERE label = 1),
claims1 AS (SELECT *, regexp_extract(lower(regexp_extract(ref, '([^/]*)/*$', 1)), '^([0-9]+)-([0-9]+)-([mf])\\.(m4a|wav|mp3|flac|ogg)$', ['record', 'speaker', 'gender']) AS q FROM claims0),
claims AS (SELECT *, nullif(q.record, '') AS p_record, nullif(q.speaker, '') AS p_speaker, nullif(q.gender, '') AS p_gender,
  CASE WHEN q.record <> '' THEN concat_ws('-', q.record, q.speaker, q.gender) END AS p_canonical FROM claims1),
keys AS (SELECT window_id, split, role, language, 's' AS kind, concat('s:', language, ':', p_speaker) AS node FROM claims WHERE p_record IS NOT NULL
  UNION ALL SELECT window_id, split, role, language, 'r', concat('r:', language, ':', p_canonical) FROM claims WHERE p_record IS NOT NULL
  UNION ALL SELECT window_id, split, role, language, 'j', concat('j:', language, ':', p_record) FROM claims WHERE p_record IS NOT NULL)"""


@query("node_keys", f"WITH {CLAIMS} SELECT DISTINCT window_id, node FROM keys")
def node_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder)
    return rows.select("window_id", F.explode(identity.window_nodes(rows)).alias("node"))


CLOSURE = f"""{CLAIMS}, {st.INVENTORY},
side AS (SELECT window_id, language, role, concat('s:', language, ':', declared) AS d, concat('s:', language, ':', p_speaker) AS s,
  concat('r:', language, ':', p_canonical) AS r, concat('j:', language, ':', p_record) AS j, declared IS NOT NULL AS hd, p_record IS NOT NULL AS hp FROM claims WHERE label = 1),
e AS (SELECT DISTINCT a, b FROM (
  SELECT CASE WHEN hd THEN d ELSE s END AS a, unnest(list_filter([CASE WHEN hd THEN d END, CASE WHEN hp THEN s END, CASE WHEN hp THEN r END, CASE WHEN hp THEN j END], lambda x: x IS NOT NULL)) AS b
  FROM side WHERE hd OR hp
  UNION ALL SELECT concat('j:', language, ':', record_id), unnest(list_filter([concat('j:', language, ':', record_id), concat('s:', language, ':', speaker),
    CASE WHEN fname LIKE '%.m4a' THEN concat('r:', language, ':', replace(fname, '.m4a', '')) END], lambda x: x IS NOT NULL)) FROM inventory))"""

ANCHORS = """anchors AS (SELECT DISTINCT node FROM keys JOIN manifest m USING (window_id) WHERE m.preprocessing_version = 'prep-1' AND m.sample_rate = 16000 AND m.duration > 4.8)"""


def closure_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, closure edges as they are claimed, and anchors. Windows of the older preprocessing that are long stand for prior exposure."""
    rows = st.manifest(spark, folder)
    edges = identity.closure_stars(rows, st.inventory(spark, folder))
    exposed = rows.where("preprocessing_version = 'prep-1' AND sample_rate = 16000 AND duration > 4.8")
    return rows, edges, identity.row_keys(exposed).select("node").distinct()


@query("closure_edges", f"WITH {CLOSURE} SELECT a, b FROM e")
def closure_edges(spark: SparkSession, folder: str) -> DataFrame:
    return identity.closure_edges(st.manifest(spark, folder), st.inventory(spark, folder)).select("a", "b")


@query("closure_poison", f"WITH RECURSIVE {CLOSURE}, {ANCHORS}, ea AS (SELECT a, b FROM e UNION SELECT node, node FROM anchors), " + COMPONENTS.format(s="", e="ea") + """,
bad AS (SELECT DISTINCT component FROM cc JOIN anchors USING (node))
SELECT node, component FROM cc SEMI JOIN bad USING (component)""")
def closure_poison(spark: SparkSession, folder: str) -> DataFrame:
    _, edges, anchors = closure_inputs(spark, folder)
    return graph.poisoned_nodes(edges, anchors)


VARIANTS = f"""WITH RECURSIVE {CLOSURE}, {ANCHORS},
x AS (SELECT a, b FROM e UNION SELECT s.d, t.d FROM side s JOIN side t USING (window_id) WHERE s.role = 'source' AND t.role = 'target' AND s.hd AND t.hd),
v AS (SELECT concat('side_only|', a) AS a, concat('side_only|', b) AS b FROM e UNION SELECT concat('row_union|', a), concat('row_union|', b) FROM x),
""" + COMPONENTS.format(s="", e="v") + """,
lab AS (SELECT split_part(node, '|', 1) AS variant, split_part(node, '|', 2) AS node, component FROM cc),
bad AS (SELECT DISTINCT variant, component FROM lab JOIN anchors USING (node)),
hit AS (SELECT DISTINCT lab.variant, k.window_id FROM lab JOIN bad USING (variant, component) JOIN keys k USING (node) WHERE k.split = 'test')
SELECT variant, count(*) AS flagged FROM hit GROUP BY variant"""


@query("closure_variants", VARIANTS)
def closure_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Test windows flagged when sides stay apart and when the two sides of a row are one component."""
    rows, edges, anchors = closure_inputs(spark, folder)
    crossed = identity.closure_stars(rows, st.inventory(spark, folder), cross_sides=True)
    keys = identity.row_keys(rows.where("split = 'test'")).select("window_id", "node")
    return graph.poisoned_items({"side_only": edges, "row_union": crossed}, anchors, keys, "window_id")


@query("closure_distance", f"WITH RECURSIVE {CLOSURE}, {ANCHORS}, s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), " + """
d(node, distance) USING KEY (node) AS (SELECT DISTINCT node, 0 FROM anchors UNION
  SELECT s.b AS node, min(d.distance) + 1 AS distance FROM d JOIN s ON s.a = d.node LEFT JOIN recurring.d r ON r.node = s.b WHERE r.node IS NULL GROUP BY s.b)
SELECT node, CAST(distance AS INTEGER) AS distance FROM d""")
def closure_distance(spark: SparkSession, folder: str) -> DataFrame:
    rows, _, anchors = closure_inputs(spark, folder)
    edges = identity.closure_edges(rows, st.inventory(spark, folder))
    return graph.distances(edges, anchors).select("node", "distance")


# every claim of an edge: the star of a side or of an inventory row, with that side and row
CLAIMED = """ce AS (SELECT CASE WHEN hd THEN d ELSE s END AS a, unnest(list_filter([CASE WHEN hd THEN d END, CASE WHEN hp THEN s END, CASE WHEN hp THEN r END, CASE WHEN hp THEN j END], lambda x: x IS NOT NULL)) AS b,
  role AS side, window_id AS row, generator FROM side JOIN (SELECT window_id, generator FROM manifest) USING (window_id) WHERE hd OR hp
  UNION ALL SELECT concat('j:', language, ':', record_id), unnest(list_filter([concat('s:', language, ':', speaker), CASE WHEN fname LIKE '%.m4a' THEN concat('r:', language, ':', replace(fname, '.m4a', '')) END], lambda x: x IS NOT NULL)),
  'inventory', row_key, NULL FROM inventory),
claim AS (SELECT least(a, b) AS low, greatest(a, b) AS high, min(struct_pack(side := side, row := row)) AS c FROM ce WHERE a <> b GROUP BY ALL)"""


@query("closure_path", f"WITH RECURSIVE {CLOSURE}, {CLAIMED}, {ANCHORS}, s AS MATERIALIZED (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), " + """
d(node, distance) USING KEY (node) AS (SELECT DISTINCT node, 0 FROM anchors UNION
  SELECT s.b AS node, min(d.distance) + 1 AS distance FROM d JOIN s ON s.a = d.node LEFT JOIN recurring.d r ON r.node = s.b WHERE r.node IS NULL GROUP BY s.b),
dd AS MATERIALIZED (SELECT * FROM d),
o AS MATERIALIZED (SELECT x.node, min(y.node) AS next FROM dd x JOIN s ON s.b = x.node JOIN dd y ON y.node = s.a AND y.distance = x.distance - 1 GROUP BY x.node),
p AS (SELECT o.node AS start, 1 AS step, o.node, o.next FROM o SEMI JOIN (SELECT node FROM keys WHERE split = 'test') k USING (node)
  UNION ALL SELECT p.start, p.step + 1, o.node, o.next FROM p JOIN o ON o.node = p.next)
SELECT start, step, node, next, c.side AS side, c.row AS row, generator FROM p JOIN claim ON low = least(node, next) AND high = greatest(node, next) LEFT JOIN manifest ON window_id = c.row AND c.side <> 'inventory'""")
def closure_path(spark: SparkSession, folder: str) -> DataFrame:
    """The edges that connect identities of test windows with prior exposure, and the rows that claim them."""
    rows, _, anchors = closure_inputs(spark, folder)
    starts = identity.row_keys(rows.where("split = 'test'")).select("node")
    claims = cut(identity.closure_claims(rows, st.inventory(spark, folder)))
    return graph.paths(starts, graph.distances(claims, anchors), claims, ("side", "row", "generator"))


@query("spanning_components", f"WITH RECURSIVE {CLAIMS}, e AS (SELECT min(node) OVER (PARTITION BY window_id) AS a, node AS b FROM keys), " + COMPONENTS.format(s="", e="e") + """,
w AS (SELECT DISTINCT c.component, k.split FROM keys k JOIN cc c USING (node))
SELECT component, count(*) AS splits, string_agg(split, ',' ORDER BY split) AS names FROM w GROUP BY component HAVING splits > 1""")
def spanning_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.spanning_components(identity.split_nodes(st.manifest(spark, folder)), "nodes", F.col("nodes"), "split")


PAIR_PLAN = """p AS (SELECT DISTINCT language, generator, source_speaker, target_speaker FROM manifest WHERE label = 1),
e AS (SELECT concat(language, ':', target_speaker) AS a, concat(language, ':', coalesce(source_speaker, target_speaker)) AS b FROM p
  UNION SELECT concat(language, ':', speaker), concat(language, ':', speaker) FROM manifest WHERE label = 0)"""


@query("joint_graph_plan", f"WITH RECURSIVE {st.MANIFEST}, {PAIR_PLAN}, " + COMPONENTS.format(s="", e="e") + """,
w AS (SELECT m.language, c.component, count(*) AS windows, count(DISTINCT generator) AS generators, count(*) FILTER (label = 0) AS genuine
  FROM manifest m JOIN cc c ON c.node = concat(m.language, ':', coalesce(m.speaker, m.target_speaker)) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY generators DESC, windows, component) AS place FROM w WHERE generators > 0 AND genuine > 0)
SELECT w.language, w.component, w.windows, w.generators, w.genuine,
  CASE WHEN r.place <= 2 THEN 'val' WHEN w.generators = 0 THEN 'free' ELSE 'train' END AS split FROM w LEFT JOIN r USING (language, component)""")
def joint_graph_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs and genuine speakers as one graph per language; two generator-diverse components go to validation.

    Components without synthetic rows are free agents. Language is part of the key, so all languages are one job.
    """
    from voicelake.operators.prefix import first_k
    rows = st.manifest(spark, folder).withColumn("language", lang_normalize(F.col("spoken_language")))
    own = F.concat_ws(":", "language", F.coalesce("speaker", "target_speaker"))
    keys = F.array(own, F.when(F.col("source_speaker").isNotNull(), F.concat_ws(":", "language", "source_speaker")))
    labels = graph.connected_components(graph.star_edges(rows, keys))
    sized = rows.withColumn("node", own).join(labels, "node").groupBy("language", "component").agg(
        F.count("*").alias("windows"), F.count_distinct("generator").alias("generators"), F.count_if(F.col("label") == 0).alias("genuine"))
    chosen = first_k(sized.where("generators > 0 AND genuine > 0"), ["language"], [F.col("generators").desc(), F.col("windows"), F.col("component")], 2)
    joined = sized.join(chosen.select("language", "component", "rank"), ["language", "component"], "left")
    return joined.withColumn("split", F.when(F.col("rank").isNotNull(), "val").when(F.col("generators") == 0, "free").otherwise("train")).drop("rank")
