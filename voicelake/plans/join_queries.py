"""Registered queries for lineage, exposure and integrity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.operators import identity, joins
from voicelake.operators.prefix import ranked
from voicelake.operators.select import joined_key
from voicelake.plans import standins as st
from voicelake.plans.graph_queries import ANCHORS, CLAIMS, CLOSURE, COMPONENTS, closure_inputs
from voicelake.plans.registry import query, table
from voicelake.plans.score_queries import rounded

# upstream evaluation records: orders of one status and priority stand for them
HELD = "held AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW')"


def held(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'").select(F.col("o_orderkey").cast("string").alias("record_id"))


EXPOSURE = f"WITH RECURSIVE {CLOSURE}, {ANCHORS}, {HELD}, ea AS (SELECT a, b FROM e UNION SELECT node, node FROM anchors), " + COMPONENTS.format(s="", e="ea") + """,
bad AS (SELECT DISTINCT component FROM cc JOIN anchors USING (node)), poison AS (SELECT node FROM cc SEMI JOIN bad USING (component)),
ck AS (SELECT row_key, language, duration, record_id, concat('s:', language, ':', speaker) AS s, concat('j:', language, ':', record_id) AS j,
  concat('r:', language, ':', record_id, '-', speaker, '-', gender) AS r FROM inventory),
z AS (SELECT row_key, CASE WHEN s IN (SELECT node FROM anchors) THEN 'speaker_in_prior_exposure' WHEN r IN (SELECT node FROM anchors) THEN 'reference_in_prior_exposure'
  WHEN s IN (SELECT node FROM poison) OR j IN (SELECT node FROM poison) OR r IN (SELECT node FROM poison) THEN 'closure_component_in_prior_exposure'
  WHEN record_id IN (SELECT record_id FROM held) THEN 'upstream_heldout_record' WHEN duration < 3 THEN 'recording_too_short' END AS reason FROM ck)
SELECT coalesce(reason, 'shortlisted') AS outcome, count(*) AS n FROM z GROUP BY outcome"""


@query("anti_exposure", EXPOSURE)
def anti_exposure(spark: SparkSession, folder: str) -> DataFrame:
    from voicelake.operators.graph import poisoned_nodes
    _, edges, anchors = closure_inputs(spark, folder)
    rows = st.inventory(spark, folder)
    # recordings repeat their identity, so distinct ones are looked up
    who = ["language", "speaker", "record_id", "gender"]
    rows = rows.select(joined_key(*who).alias("who"), *who, "duration")
    nodes = identity.candidate_nodes(F.col("language"), F.col("speaker"), F.col("record_id"), F.col("gender"))
    keys = rows.select("who", *who).distinct().select("who", F.explode_outer(nodes).alias("node")).withColumn("kind", F.substring("node", 1, 1))
    languages = F.explode(F.array(F.lit("bengali"), F.lit("hindi"), F.lit("tamil")))
    heldout = held(spark, folder).select("record_id", languages.alias("language")).select(F.concat_ws(":", F.lit("j"), "language", "record_id").alias("node"))
    out = joins.anti_exposure(rows.select("who", "duration"), keys, anchors, heldout, poisoned_nodes(edges, anchors), "who", F.col("duration") < 3)
    return out.groupBy(F.coalesce("reason", F.lit("shortlisted")).alias("outcome")).agg(F.count("*").alias("n"))


@query("anti_heldout", f"WITH {st.INVENTORY}, {HELD} SELECT language, count(*) AS rows, count(DISTINCT record_id) AS records FROM inventory ANTI JOIN held USING (record_id) GROUP BY language")
def anti_heldout(spark: SparkSession, folder: str) -> DataFrame:
    kept = st.inventory(spark, folder).join(held(spark, folder), "record_id", "left_anti")
    return kept.groupBy("language").agg(F.count("*").alias("rows"), F.count_distinct("record_id").alias("records"))


@query("anti_quarantine", """WITH q AS (SELECT user_id, arg_max(event_type, event_id) AS reason, max(event_id) AS last_event FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id)
SELECT reason, count(*) AS users, CAST(sum(last_event) AS BIGINT) AS last_event, (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT user_id FROM q WHERE reason = 'error')) AS kept FROM q GROUP BY reason""")
def anti_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Quarantine entries upserted by time; events of quarantined users dropped."""
    events = table(spark, folder, "events")
    entry = lambda kind: events.where(F.col("event_type") == kind).select("user_id", F.col("event_type").alias("reason"), F.col("event_id").alias("last_event"))
    quarantine = joins.upsert_latest(entry("error"), entry("signup"), "user_id", F.col("last_event"))
    kept = events.join(quarantine.where("reason = 'error'").select("user_id"), "user_id", "left_anti").agg(F.count("*").alias("kept"))
    return quarantine.groupBy("reason").agg(F.count("*").alias("users"), F.sum("last_event").alias("last_event")).withColumn("kept", kept.scalar())


@query("prune_exclusions", f"WITH {st.MANIFEST} SELECT split, count(*) AS n FROM manifest WHERE sample_rate = 8000 AND recording_id NOT IN (SELECT recording_id FROM manifest WHERE duration >= 4.5) GROUP BY split")
def prune_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder)
    done = rows.where("duration >= 4.5").select("recording_id").distinct()
    return rows.where("sample_rate = 8000").join(done, "recording_id", "left_anti").groupBy("split").agg(F.count("*").alias("n"))


ELIGIBLE = f"""WITH {st.MANIFEST}, {HELD},
c0 AS (SELECT window_id AS row_id, CASE WHEN duration = 4.9 THEN 'other' ELSE generator END AS generator, source_speaker, target_speaker, source_reference,
  replace(target_reference, 'clips/', '') AS target_reference, evidence_verified, sample_rate FROM manifest WHERE label = 1),
c1 AS (SELECT *, nullif(regexp_extract(source_reference, '^([0-9]+)-([0-9]+)-[mf][.]wav$', 1), '') AS sr, nullif(regexp_extract(source_reference, '^([0-9]+)-([0-9]+)-[mf][.]wav$', 2), '') AS ss,
  nullif(regexp_extract(target_reference, '^([0-9]+)-([0-9]+)-[mf][.]wav$', 1), '') AS tr, nullif(regexp_extract(target_reference, '^([0-9]+)-([0-9]+)-[mf][.]wav$', 2), '') AS ts FROM c0),
bad AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
z AS (SELECT *, CASE WHEN NOT evidence_verified AND sample_rate = 8000 THEN 'lineage_replacement_required'
  WHEN sr IN (FROM bad) OR tr IN (FROM bad) THEN 'reference_unresolvable_precheck' WHEN generator NOT IN ('freevc24', 'xtts_v2', 'vits') THEN 'unknown_generator'
  WHEN tr IS NULL OR target_speaker IS NULL THEN 'unresolved_target_lineage' WHEN ts <> target_speaker THEN 'target_speaker_mismatch'
  WHEN generator = 'freevc24' AND (sr IS NULL OR source_speaker IS NULL) THEN 'unresolved_source_lineage' WHEN generator = 'freevc24' AND ss <> source_speaker THEN 'source_speaker_mismatch'
  WHEN tr IN (FROM held) OR (sr IN (FROM held) AND (generator = 'freevc24' OR ss = source_speaker)) THEN 'upstream_held_out_parent' END AS reason FROM c1)"""


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder).where("label = 1")
    return rows.select(F.col("window_id").alias("row_id"), "language", "split", F.when(F.col("duration") == 4.9, "other").otherwise(F.col("generator")).alias("generator"),
                       "source_speaker", "target_speaker", "source_reference", F.replace("target_reference", F.lit("clips/"), F.lit("")).alias("target_reference"),
                       "evidence_verified", "sample_rate", "duration")


def eligible_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder)
    blocked = rows.where("NOT evidence_verified AND sample_rate = 8000").select("row_id")
    bad = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("record_id"), F.lit("not_found").alias("status"))
    return joins.eligibility_filter(rows, held(spark, folder), bad, blocked)


@query("eligibility_filter", ELIGIBLE + " SELECT row_id, generator, reason FROM z")
def eligibility_filter(spark: SparkSession, folder: str) -> DataFrame:
    return eligible_rows(spark, folder).select("row_id", "generator", "reason")


@query("identity_conflict", f"""WITH {st.INVENTORY} SELECT CASE WHEN duration = 50 THEN 'fname_unparseable' WHEN duration = 13 THEN 'identity_conflict_with_fname'
  WHEN duration = 7 AND upstream_speaker <> speaker THEN 'upstream_speaker_conflict' WHEN duration < 3 THEN 'recording_too_short' ELSE 'usable' END AS reason, count(*) AS n FROM inventory GROUP BY reason""")
def identity_conflict(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.inventory(spark, folder)
    return rows.groupBy(F.coalesce(joins.identity_conflict(rows, 3.0), F.lit("usable")).alias("reason")).agg(F.count("*").alias("n"))


@query("parent_lookup", f"""WITH {CLAIMS}, {st.INVENTORY}, o AS (SELECT DISTINCT record_id FROM inventory WHERE duration < 10), f AS (SELECT DISTINCT record_id FROM inventory WHERE duration > 45)
SELECT window_id, role, p_record AS record_id, concat_ws(',', CASE WHEN p_record IN (FROM o) THEN 'old' END, CASE WHEN p_record IN (FROM f) THEN 'fresh' END) AS found_in,
  (p_record IN (FROM o) OR p_record IN (FROM f)) AS verified FROM claims WHERE label = 1 AND p_record IS NOT NULL""")
def parent_lookup(spark: SparkSession, folder: str) -> DataFrame:
    inv = st.inventory(spark, folder)
    claims = identity.role_claims(st.manifest(spark, folder).where("label = 1")).where("p IS NOT NULL").select("window_id", "role", F.col("p.record").alias("record_id"))
    out = joins.parent_lookup(claims, {"old": inv.where("duration < 10"), "fresh": inv.where("duration > 45")}, "record_id")
    return out.withColumn("found_in", F.concat_ws(",", "found_in"))


RESOLVE = f"""WITH {CLAIMS}, {st.INVENTORY}, {HELD}, w AS (SELECT DISTINCT language, p_record AS record_id FROM claims WHERE label = 1 AND p_record IS NOT NULL),
i AS (SELECT DISTINCT language, record_id FROM inventory WHERE duration > 20), f AS (SELECT DISTINCT language, record_id FROM inventory WHERE duration < 15),
z AS (SELECT language, record_id, (record_id IN (FROM held))::BIGINT AS h, ((language, record_id) IN (FROM i))::BIGINT AS i, ((language, record_id) IN (FROM f))::BIGINT AS f FROM w)"""


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    inv = st.inventory(spark, folder)
    claims = identity.role_claims(st.manifest(spark, folder).where("label = 1")).where("p IS NOT NULL").select("language", F.col("p.record").alias("record_id"))
    languages = F.explode(F.array(F.lit("bengali"), F.lit("hindi"), F.lit("tamil")))
    heldout = held(spark, folder).select("record_id", languages.alias("language"))
    return joins.lineage_resolve(claims, [("upstream_eval_parent", heldout), ("scanned_inventory", inv.where("duration > 20")), ("full_train_shard_scan", inv.where("duration < 15"))], ["language", "record_id"])


@query("lineage_resolve", RESOLVE + """ SELECT language, record_id, CASE WHEN h = 1 THEN 'upstream_eval_parent' WHEN i = 1 THEN 'scanned_inventory'
  WHEN f = 1 THEN 'full_train_shard_scan' ELSE 'not_found' END AS status, h + i + f AS sources FROM z""")
def lineage_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder)


@query("lineage_crosscheck", RESOLVE + """ SELECT z.language, z.record_id, v.language AS other_language FROM z JOIN (SELECT DISTINCT language, record_id FROM inventory) v
  ON v.record_id = z.record_id AND v.language <> z.language WHERE h + i + f = 0""")
def lineage_crosscheck(spark: SparkSession, folder: str) -> DataFrame:
    return joins.lineage_crosscheck(_resolved(spark, folder).where("status = 'not_found'"), st.inventory(spark, folder))


@query("outstanding_refs", f"WITH {CLAIMS} SELECT role, language, count(DISTINCT p_record) AS records, count(*) AS claims FROM claims WHERE label = 1 AND p_record IS NOT NULL AND verification = 'parsed_only' GROUP BY ALL")
def outstanding_refs(spark: SparkSession, folder: str) -> DataFrame:
    claims = identity.role_claims(st.manifest(spark, folder).where("label = 1")).where("p IS NOT NULL AND verification = 'parsed_only'")
    return claims.groupBy("role", "language").agg(F.count_distinct("p.record").alias("records"), F.count("*").alias("claims"))


ZONES = f"WITH {st.INVENTORY}, r AS (SELECT *, concat(shard, ':', CAST(row_group // 10 AS VARCHAR)) AS zone FROM inventory), {HELD}"


@query("zone_map_join", ZONES + " SELECT zone, count(*) AS rows, count(DISTINCT record_id) AS records FROM r SEMI JOIN held USING (record_id) GROUP BY zone")
def zone_map_join(spark: SparkSession, folder: str) -> DataFrame:
    zone = F.concat("shard", F.lit(":"), F.floor(F.col("row_group") / 10))
    rows = st.inventory(spark, folder).withColumn("zone", zone)
    found = joins.zone_map_join(held(spark, folder), rows, "record_id")
    return found.groupBy("zone").agg(F.count("*").alias("rows"), F.count_distinct("record_id").alias("records"))


@query("cross_split_roles", f"""WITH {CLAIMS}, d AS (SELECT DISTINCT kind, node, split, role FROM keys)
SELECT a.kind, a.split AS split_a, a.role AS role_a, b.split AS split_b, b.role AS role_b, count(*) AS shared FROM d a JOIN d b ON a.node = b.node AND a.split < b.split GROUP BY ALL""")
def cross_split_roles(spark: SparkSession, folder: str) -> DataFrame:
    return joins.shared_keys(identity.side_keys(st.manifest(spark, folder)))


@query("keys_overlap", f"WITH {CLAIMS} SELECT kind, count(DISTINCT node) AS shared FROM keys WHERE split = 'val' AND node IN (SELECT node FROM keys WHERE split = 'train') GROUP BY kind")
def keys_overlap(spark: SparkSession, folder: str) -> DataFrame:
    keys = identity.row_keys(st.manifest(spark, folder))
    return joins.keys_overlap(keys.where("split = 'val'"), keys.where("split = 'train'"))


@query("hash_dupes", f"""WITH {st.MANIFEST}, g AS (SELECT prepared_sha256 AS digest, count(*) AS copies, count(DISTINCT split) AS splits FROM manifest GROUP BY digest HAVING count(*) > 1)
SELECT digest, copies, splits, CASE WHEN splits > 1 THEN 'cross_split' ELSE 'within_split' END AS scope FROM g""")
def hash_dupes(spark: SparkSession, folder: str) -> DataFrame:
    return joins.hash_dupes(st.manifest(spark, folder), "prepared_sha256")


@query("recording_collision", """SELECT o_custkey, count(*) AS windows, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY o_custkey HAVING splits > 1""")
def recording_collision(spark: SparkSession, folder: str) -> DataFrame:
    return joins.recording_collision(table(spark, folder, "orders"), "o_custkey", "o_orderstatus")


@query("benchmark_leak", """SELECT d.doc_id, d.source FROM documents d WHERE sha256(text) IN (SELECT sha256(text) FROM benchmark)
UNION ALL SELECT DISTINCT a.doc_id, 'train_and_dev' FROM documents a JOIN documents b ON a.text = b.text AND a.source <> b.source WHERE a.source < 'src2'""")
def benchmark_leak(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are a frozen benchmark item, and texts of the first sources that other sources hold too."""
    docs = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    frozen = table(spark, folder, "benchmark").select(F.sha2("text", 256).alias("digest")).distinct()
    both = docs.groupBy("digest").agg(F.count_distinct("source").alias("sources")).where("sources > 1").select("digest")
    leaked = docs.join(frozen, "digest", "left_semi").select("doc_id", "source")
    shared = docs.where("source < 'src2'").join(both, "digest", "left_semi").select("doc_id", F.lit("train_and_dev").alias("source"))
    return leaked.unionByName(shared)


CACHE = f"""WITH {st.MANIFEST}, c AS (SELECT window_id, CASE WHEN duration = 4 THEN 1 - label ELSE label END AS label, CASE WHEN duration = 3 THEN 'odia' ELSE language END AS language,
  prepared_sha256, split FROM manifest WHERE duration <> 2 UNION ALL SELECT concat('extra-', o_orderkey), 0, 'odia', '', 'train' FROM orders WHERE o_orderstatus = 'F')"""


def _cache(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = st.manifest(spark, folder)
    cached = rows.where("duration <> 2").select(
        "window_id", F.when(F.col("duration") == 4, 1 - F.col("label")).otherwise(F.col("label")).alias("label"),
        F.when(F.col("duration") == 3, "odia").otherwise(F.col("language")).alias("language"), "prepared_sha256", "split")
    extra = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("extra-"), "o_orderkey").alias("window_id"), F.lit(0).alias("label"), F.lit("odia").alias("language"), F.lit("").alias("prepared_sha256"), F.lit("train").alias("split"))
    return rows, cached.unionByName(extra)


def _placed(rows: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the place of their rows: the stand-in manifest and its cache lie in the order of their ids."""
    return rows.withColumn("place", F.col("window_id")), cached.withColumn("place", F.col("window_id"))


@query("manifest_cache_diff", CACHE + """ SELECT coalesce(m.window_id, c.window_id) AS window_id, unnest(list_filter([CASE WHEN c.window_id IS NULL THEN 'missing' END, CASE WHEN m.window_id IS NULL THEN 'extra' END,
  CASE WHEN m.label <> c.label THEN 'changed_label' END, CASE WHEN m.language <> c.language THEN 'changed_language' END, CASE WHEN m.prepared_sha256 <> c.prepared_sha256 THEN 'changed_prepared_sha256' END], lambda x: x IS NOT NULL)) AS difference
FROM manifest m FULL JOIN c USING (window_id)""")
def manifest_cache_diff(spark: SparkSession, folder: str) -> DataFrame:
    rows, cached = _cache(spark, folder)
    return joins.cache_difference(*_placed(rows, cached), "window_id", ["label", "language", "prepared_sha256", "split"], "place")


@query("manifest_cache_order", f"""WITH {st.MANIFEST}, f AS (SELECT window_id, min(CASE WHEN duration = 4 THEN concat('~', window_id) ELSE window_id END) AS place FROM manifest GROUP BY window_id),
p AS (SELECT window_id, row_number() OVER (ORDER BY window_id) AS a, row_number() OVER (ORDER BY place) AS b FROM f)
SELECT window_id, 'changed_order' AS difference FROM p WHERE a <> b""")
def manifest_cache_order(spark: SparkSession, folder: str) -> DataFrame:
    """A cache with the rows of the manifest in another order: some of them stand at the end."""
    rows = st.manifest(spark, folder)
    cached = rows.withColumn("place", F.when(F.col("duration") == 4, F.concat(F.lit("~"), "window_id")).otherwise(F.col("window_id")))
    return joins.order_changes(rows.withColumn("place", F.col("window_id")), cached, "window_id", "place")


@query("reuse_or_pending", CACHE + """ SELECT split, coalesce(CASE WHEN c.window_id IS NULL THEN 'not_cached' WHEN m.label <> c.label THEN 'changed_label' WHEN m.language <> c.language THEN 'changed_language' END, 'reused') AS outcome,
  count(*) AS n FROM (SELECT * FROM manifest) m LEFT JOIN (SELECT window_id, label, language FROM c) c USING (window_id) GROUP BY ALL""")
def reuse_or_pending(spark: SparkSession, folder: str) -> DataFrame:
    rows, cached = _cache(spark, folder)
    out = joins.reuse_or_pending(rows.select("window_id", "split", "label", "language", "prepared_sha256"), cached, "window_id", ["label", "language", "prepared_sha256"])
    return out.groupBy("split", F.coalesce("pending_reason", F.lit("reused")).alias("outcome")).agg(F.count("*").alias("n"))


@query("retention_diff", """SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 'missing' ELSE 'changed' END AS difference FROM customer WHERE c_nationkey IN (5, 6)""")
def retention_diff(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer")
    after = rows.where("c_nationkey <> 5").withColumn("c_acctbal", F.when(F.col("c_nationkey") == 6, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return joins.retention_diff(rows, after, "c_custkey")


@query("plan_replay_diff", f"""WITH {st.MANIFEST}, a AS (SELECT split, language, recording_id FROM manifest), b AS (SELECT split, language, recording_id FROM manifest WHERE duration <> 1)
SELECT split, language, 'stored' AS only_in, count(*) AS n FROM (FROM a EXCEPT ALL FROM b) GROUP BY ALL
UNION ALL SELECT split, language, 'recomputed', count(*) FROM (FROM b EXCEPT ALL FROM a) GROUP BY ALL""")
def plan_replay_diff(spark: SparkSession, folder: str) -> DataFrame:
    stored = st.manifest(spark, folder).select("split", "language", "recording_id")
    again = st.manifest(spark, folder).where("duration <> 1").select("split", "language", "recording_id")
    return joins.replay_diff(stored, again).groupBy("split", "language", "only_in").agg(F.count("*").alias("n"))


@query("snapshot_compare", """WITH b AS (SELECT doc_id, md5(text) AS h FROM documents WHERE source <> 'src4'), a AS (SELECT doc_id, CASE WHEN source IN ('src5', 'src6') THEN md5(concat(text, '!')) ELSE md5(text) END AS h, source FROM documents WHERE source <> 'src7'),
z AS (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'missing' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS state FROM b FULL JOIN a USING (doc_id))
SELECT doc_id, state, state <> 'unchanged' AND doc_id % 2 = 0 AS violation FROM z""")
def snapshot_compare(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    before = docs.where("source <> 'src4'").select("doc_id", F.md5("text").alias("h"))
    after = docs.where("source <> 'src7'").select("doc_id", F.md5(F.when(F.col("source").isin("src5", "src6"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return joins.snapshot_compare(before, after, "doc_id", "h", F.col("doc_id") % 2 == 1)


@query("accounting_reconcile", f"""WITH {st.MANIFEST} SELECT CASE WHEN duration <= 4 AND duration > 1 THEN 'materialized' WHEN duration <= 4 AND duration = 1 THEN 'unaccounted' WHEN duration <= 4 THEN 'excluded'
  WHEN duration = 5 THEN 'extra' ELSE 'none' END AS disposition, count(*) AS n FROM manifest WHERE duration <= 4 OR duration = 5 GROUP BY disposition""")
def accounting_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder)
    out = joins.accounting(rows.where("duration <= 4"), rows.where("(duration > 1 AND duration <= 4) OR duration = 5"), rows.where("duration < 1"), "window_id")
    return out.groupBy("disposition").agg(F.count("*").alias("n"))


@query("prediction_parity", f"""WITH {st.SCORES}, s AS (SELECT *, row_number() OVER (ORDER BY window_id) AS p, round(score::DOUBLE, 3) AS saved FROM scores),
o AS (SELECT window_id, row_number() OVER (ORDER BY CASE WHEN language = (SELECT min(language) FROM scores) AND window_id % 2 = 0 THEN window_id + 3 ELSE window_id END, window_id) AS q FROM scores)
SELECT language, count(*) AS rows, round(max(abs(saved - score::DOUBLE)), 6) AS max_diff, round(avg(abs(saved - score::DOUBLE)), 6) AS mean_diff,
  bool_and(p = q) AS order_ok FROM s JOIN o USING (window_id) GROUP BY language""")
def prediction_parity(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranked(st.scores(spark, folder), [], [F.col("window_id")], "p").withColumn("value", F.col("score").cast("double"))
    # the saved list has rows of one language out of their place
    first = rows.agg(F.min("language")).scalar()
    moved = F.when((F.col("language") == first) & (F.col("window_id") % 2 == 0), F.col("window_id") + 3).otherwise(F.col("window_id"))
    saved = ranked(rows.drop("p"), [], [moved, F.col("window_id")], "p").withColumn("value", F.round("value", 3))
    return rounded(joins.prediction_parity(saved, rows, "window_id", "value", "p", ["language"]), "max_diff", "mean_diff")


@query("enrich_predictions", f"WITH {st.CHUNKS} SELECT c.role, d.lang, count(*) AS n, round(avg(score), 6) AS mean_score FROM chunks c LEFT JOIN documents d ON d.doc_id = c.file_id GROUP BY ALL")
def enrich_predictions(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "documents").select(F.col("doc_id").alias("file_id"), "lang")
    out = st.chunks(spark, folder).join(facts, "file_id", "left").groupBy("role", "lang").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    return rounded(out, "mean_score")


@query("replace_failed", f"""WITH {st.INVENTORY}, f AS (SELECT language, speaker, row_key AS slot, row_number() OVER (PARTITION BY language, speaker ORDER BY row_key) AS k FROM inventory WHERE duration > 40),
r AS (SELECT language, speaker, row_key AS reserve, row_number() OVER (PARTITION BY language, speaker ORDER BY duration DESC, row_key) AS k FROM inventory WHERE duration <= 5)
SELECT slot, language, speaker, reserve, CASE WHEN reserve IS NULL THEN 'unfilled' ELSE 'replaced' END AS disposition FROM f LEFT JOIN r USING (language, speaker, k)""")
def replace_failed(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.inventory(spark, folder)
    slots = rows.where("duration > 40").select("language", "speaker", F.col("row_key").alias("slot"))
    reserves = rows.where("duration <= 5").select("language", "speaker", F.col("row_key").alias("reserve"), "duration")
    return joins.replace_failed(slots, reserves, ["language", "speaker"], [F.col("duration").desc(), F.col("reserve")])


@query("role_guard", "SELECT doc_id, source FROM documents WHERE source IN ('src3', 'src9') AND lang IN ('en', 'fr')")
def role_guard(spark: SparkSession, folder: str) -> DataFrame:
    roles = table(spark, folder, "documents").select("source").distinct().withColumn("role", F.when(F.col("source").isin("src3", "src9"), "evaluation_only").otherwise("training"))
    return joins.role_guard(table(spark, folder, "documents").select("doc_id", "source", "lang"), roles, "source", "lang", ["en", "fr"]).select("doc_id", "source")


@query("source_completeness", """SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM documents) s, (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS lang) l
WHERE (s.source, l.lang) NOT IN (SELECT source, lang FROM documents WHERE n_chars > 6000)""")
def source_completeness(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return joins.missing_cells(docs.select("source").distinct(), {"lang": ["de", "en", "es", "fr", "it"]}, docs.where("n_chars > 6000"))


@query("gap_matrix", """SELECT concat('gap-', lower(l.lang), '-', c.class) AS gap_id, l.lang, c.class AS "class", 'missing_coverage' AS pool FROM (SELECT DISTINCT lang FROM documents) l, (SELECT unnest(['genuine', 'spoof', 'replay']) AS class) c
WHERE (l.lang, c.class) NOT IN (SELECT d.lang, CASE WHEN quality = 0 THEN 'genuine' ELSE 'spoof' END FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1)""")
def gap_matrix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    have = table(spark, folder, "labels").where("toxic = 1").join(docs, "doc_id").select("lang", F.when(F.col("quality") == 0, "genuine").otherwise("spoof").alias("class"))
    gaps = joins.missing_cells(docs.select("lang").distinct(), {"class": ["genuine", "spoof", "replay"]}, have)
    return gaps.select(F.concat_ws("-", F.lit("gap"), F.lower("lang"), "class").alias("gap_id"), "lang", "class", F.lit("missing_coverage").alias("pool"))


@query("list_overlap_guard", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def list_overlap_guard(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.where("o_orderstatus = 'F'").select("o_custkey").intersect(orders.where("o_orderstatus = 'O'").select("o_custkey"))


@query("registry_lookup", f"""WITH {CLAIMS}, {ANCHORS}, r AS (SELECT node, split_part(node, ':', 2) AS language, split_part(node, ':', 3) AS k FROM anchors WHERE node LIKE 'r:%')
SELECT DISTINCT language, unnest([k, split_part(k, '-', 1)]) AS reference_key FROM r""")
def registry_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Exposed references by language, with the bare record id beside the canonical reference."""
    from voicelake.operators.audit import registry_references
    return registry_references(closure_inputs(spark, folder)[2])


