"""Registered queries for whole-table audits, versions and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.functions.digests import signature
from voicelake.operators import audit, identity, joins, select
from voicelake.plans import standins as st
from voicelake.plans.graph_queries import ANCHORS, CLAIMS, CLOSURE, COMPONENTS, closure_inputs
from voicelake.plans.join_queries import CACHE, HELD, _cache, held
from voicelake.session import cut, work_path
from voicelake.sources import files, sinks
from voicelake.plans.registry import query, table
from voicelake.plans.stat_queries import SIGN

MAN = f"WITH {st.MANIFEST}"
PROBLEMS = """problems AS (SELECT window_id, split, CASE WHEN p_record IS NULL AND role = 'source' AND verification = 'not_applicable_tts' THEN NULL WHEN p_record IS NULL THEN concat(role, '_reference_unparseable')
  WHEN declared IS NULL THEN concat(role, '_speaker_missing') WHEN declared <> p_speaker THEN concat(role, '_speaker_disagrees') END AS problem FROM claims)"""


@query("row_identities", f"WITH {CLAIMS}, {PROBLEMS} SELECT window_id, split, problem FROM problems WHERE problem IS NOT NULL")
def row_identities(spark: SparkSession, folder: str) -> DataFrame:
    return identity.row_problems(st.manifest(spark, folder))


@query("audit_identity", f"WITH {CLAIMS}, {PROBLEMS}" + """, k AS (SELECT DISTINCT kind, node, split, role FROM keys WHERE split IN ('train', 'val') AND kind IN ('s', 'r')),
h AS (SELECT prepared_sha256, count(*) AS n, count(DISTINCT split) AS sp FROM manifest WHERE split IN ('train', 'val') GROUP BY ALL HAVING n > 1)
SELECT concat_ws('_', 'keys', split, kind) AS measure, count(DISTINCT node) AS value FROM k GROUP BY ALL
UNION ALL SELECT 'unresolved_required', count(*) FROM problems WHERE problem IS NOT NULL AND split IN ('train', 'val')
UNION ALL SELECT CASE WHEN sp > 1 THEN 'prepared_duplicates_cross_split' ELSE 'prepared_duplicates_within_split' END, count(*) FROM h GROUP BY ALL
UNION ALL SELECT concat_ws('_', 'shared', a.kind, a.split, a.role, 'vs', b.split, b.role), count(*) FROM k a JOIN k b ON a.node = b.node AND a.split < b.split GROUP BY ALL""")
def audit_identity(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_identity(st.manifest(spark, folder))


PARENTS = """parents AS (SELECT window_id, split, role, CASE WHEN role = 'source' AND verification = 'not_applicable_tts' THEN CASE WHEN evidence = 'not_applicable_tts' THEN NULL ELSE 'parent_evidence_missing' END
  WHEN verification <> 'verified_train' THEN concat('unverified_', role, '_parent') WHEN evidence IS NULL THEN 'parent_evidence_missing' WHEN NOT m.evidence_verified THEN 'parent_evidence_incomplete'
  WHEN role = 'target' AND p_record IS NOT NULL AND c.evidence_record <> p_record THEN 'parent_evidence_record_mismatch'
  WHEN p_record IS NOT NULL AND (c.language, p_record) NOT IN (SELECT language, record_id FROM scanned) THEN 'parent_record_not_in_scanned_inventories' END AS "check"
  FROM claims c JOIN (SELECT window_id, evidence_verified FROM manifest) m USING (window_id) WHERE label = 1)"""
SCANNED = "scanned AS (SELECT DISTINCT language, record_id FROM inventory WHERE duration > 8)"


@query("audit_parents", f"WITH {CLAIMS}, {st.INVENTORY}, {SCANNED}, {PARENTS}" + """ SELECT "check", split, count(*) AS n FROM parents WHERE "check" IS NOT NULL GROUP BY ALL""")
def audit_parents(spark: SparkSession, folder: str) -> DataFrame:
    scanned = st.inventory(spark, folder).where("duration > 8")
    return audit.audit_parents(st.manifest(spark, folder), scanned).groupBy("check", "split").agg(F.count("*").alias("n"))


@query("audit_schema", MAN + """, c AS (SELECT split, unnest(list_filter([CASE WHEN preprocessing_version <> 'prep-2' THEN 'preprocessing_version' END, CASE WHEN revision = 'rev-0' THEN 'dataset_revision' END,
  CASE WHEN duration NOT BETWEEN 1 AND 4 THEN 'window_duration_bounds' END, CASE WHEN sample_rate <> 16000 THEN 'window_sample_rate' END, CASE WHEN channels <> 1 THEN 'channel_count' END,
  CASE WHEN language = 'tamil' THEN 'language' END], lambda x: x IS NOT NULL)) AS "check" FROM manifest) SELECT "check", split, count(*) AS n FROM c GROUP BY ALL""")
def audit_schema(spark: SparkSession, folder: str) -> DataFrame:
    revisions = {identity.GENUINE_CORPUS: "rev-g", identity.SYNTHETIC_CORPUS: "rev-s"}
    issues = audit.audit_schema(st.manifest(spark, folder), ["bengali", "hindi"], "prep-2", revisions)
    return issues.groupBy("check", "split").agg(F.count("*").alias("n"))


HELD_NODES = "hn AS (SELECT concat('j:', l, ':', record_id) AS node FROM held, (SELECT unnest(['bengali', 'hindi', 'tamil']) AS l))"
AUDIT = f"WITH RECURSIVE {CLOSURE}, {ANCHORS}, {HELD}, {HELD_NODES}, {SCANNED}, {PROBLEMS}, {PARENTS}, ea AS (SELECT a, b FROM e UNION SELECT node, node FROM anchors), " + COMPONENTS.format(s="", e="ea") + ", se AS (SELECT min(node) OVER (PARTITION BY window_id) AS a, node AS b FROM keys), " + \
    COMPONENTS.format(s="x", e="se") + """, d AS (SELECT DISTINCT kind, node, split, role FROM keys), pr AS (SELECT DISTINCT a.kind, a.split AS sa, a.role AS ra, b.split AS sb, b.role AS rb FROM d a JOIN d b ON a.node = b.node AND a.split < b.split),
old AS (SELECT prepared_sha256 AS p, original_sha256 AS o FROM manifest WHERE preprocessing_version = 'prep-1' AND sample_rate = 16000 AND duration > 4.8),
iss AS (SELECT 'provenance' AS "check", count(*) AS n FROM problems WHERE problem IS NOT NULL
 UNION ALL SELECT 'duplicate_window_id', count(*) FROM (SELECT split, window_id FROM manifest GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT 'cross_split_intersection', count(*) FROM (SELECT DISTINCT sa, ra, sb, rb FROM pr WHERE kind IN ('s', 'r'))
 UNION ALL SELECT 'cross_split_record_overlap', count(*) FROM (SELECT DISTINCT sa, sb FROM pr WHERE kind = 'j')
 UNION ALL SELECT 'cross_split_prepared_hash_duplicate', count(*) FROM (SELECT prepared_sha256 FROM manifest GROUP BY 1 HAVING count(DISTINCT split) > 1)
 UNION ALL SELECT 'cross_split_original_hash_duplicate', count(*) FROM (SELECT original_sha256 FROM manifest GROUP BY 1 HAVING count(DISTINCT split) > 1)
 UNION ALL SELECT 'test_hash_in_prior_exposure', count(DISTINCT prepared_sha256) FILTER (prepared_sha256 IN (SELECT p FROM old)) + count(DISTINCT original_sha256) FILTER (original_sha256 IN (SELECT o FROM old)) FROM manifest WHERE split = 'test'
 UNION ALL SELECT 'test_speaker_in_prior_exposure', count(*) FROM d WHERE split = 'test' AND kind = 's' AND node IN (SELECT node FROM anchors)
 UNION ALL SELECT 'test_reference_in_prior_exposure', count(*) FROM d WHERE split = 'test' AND kind = 'r' AND node IN (SELECT node FROM anchors)
 UNION ALL SELECT 'test_record_in_upstream_heldout', count(DISTINCT node) FROM d WHERE split = 'test' AND kind = 'j' AND node IN (SELECT node FROM hn)
 UNION ALL SELECT 'heldout_unverified_languages', 1
 UNION ALL SELECT 'test_closure_component_intersects_exposure', count(DISTINCT window_id) FROM keys WHERE split = 'test' AND node IN (SELECT node FROM cc WHERE component IN (SELECT component FROM cc JOIN anchors USING (node)))
 UNION ALL SELECT "check", count(*) FROM parents WHERE "check" IS NOT NULL AND split = 'test' GROUP BY "check"
 UNION ALL SELECT 'cross_split_same_recording', count(*) FROM (SELECT recording_id FROM manifest GROUP BY 1 HAVING count(DISTINCT split) > 1)
 UNION ALL SELECT 'cross_split_component', count(*) FROM (SELECT c.component FROM keys k JOIN xcc c USING (node) GROUP BY 1 HAVING count(DISTINCT k.split) > 1))
SELECT * FROM iss WHERE n > 0"""


@query("audit_manifests", AUDIT)
def audit_manifests(spark: SparkSession, folder: str) -> DataFrame:
    rows, edges, anchors = closure_inputs(spark, folder)
    old = rows.where("preprocessing_version = 'prep-1' AND sample_rate = 16000 AND duration > 4.8")
    hashes = old.select(F.explode(F.array("prepared_sha256", "original_sha256")).alias("digest")).distinct()
    languages = F.explode(F.array(F.lit("bengali"), F.lit("hindi"), F.lit("tamil")))
    heldout = held(spark, folder).select("record_id", languages.alias("l")).select(F.concat_ws(":", F.lit("j"), "l", "record_id").alias("node"))
    unverified = rows.select("language").distinct().where("language = 'tamil'")
    issues = audit.audit_manifests(rows, anchors, hashes, heldout, unverified, edges, anchors, st.inventory(spark, folder).where("duration > 8"))
    return issues.groupBy("check").agg(F.count("*").alias("n"))


@query("audit_coverage")
def audit_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows, edges, anchors = closure_inputs(spark, folder)
    additions = rows.where("label = 0 AND split <> 'test' AND duration >= 4")
    issues = audit.audit_coverage(additions, rows.where("label = 1 AND split <> 'test'"), rows.where("split = 'test'"), rows.where("preprocessing_version = 'prep-1' AND duration > 4.8"), edges, anchors, "rev-g", "prep-2")
    return issues.groupBy("check").agg(F.count("*").alias("n"))


@query("audit_files", """WITH m AS (SELECT doc_id AS window_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id END AS path, CASE WHEN doc_id % 5 = 0 THEN sha256(concat(text, '!')) ELSE sha256(text) END AS digest FROM documents),
s AS (SELECT doc_id AS path, sha256(text) AS actual, length(text) / 1000.0::DOUBLE AS seconds FROM documents WHERE doc_id % 11 > 0)
SELECT window_id, unnest(list_filter([CASE WHEN m.path IS NULL THEN 'missing_prepared_path' END, CASE WHEN m.path IS NOT NULL AND actual IS NULL THEN 'prepared_path_missing' END, CASE WHEN actual <> digest THEN 'prepared_hash_mismatch' END,
  CASE WHEN seconds NOT BETWEEN 1 AND 4 THEN 'audio_duration' END], lambda x: x IS NOT NULL)) AS "check" FROM m LEFT JOIN s ON m.path = s.path""")
def audit_files(spark: SparkSession, folder: str) -> DataFrame:
    docs, d = table(spark, folder, "documents"), F.col("doc_id")
    declared = docs.select(d.alias("window_id"), F.when(d % 7 != 0, d).alias("path"), F.sha2(F.when(d % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    stored = docs.where("doc_id % 11 > 0").select(d.alias("path"), F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))
    return audit.audit_files(declared, stored, "path", "digest", F.col("n") / 1000.0, 1.0, 4.0)


# files of 64 documents: declared as they should be, stored with a document missing, changed, not at all, or undeclared
PAYLOADS = """d AS (SELECT doc_id, doc_id // 64 AS file, text FROM documents WHERE text IS NOT NULL),
m AS (SELECT file, sum(strlen(text) + 1)::BIGINT AS bytes, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha256 FROM d WHERE file % 9 <> 7 GROUP BY file),
s AS (SELECT file, sum(strlen(t) + 1)::BIGINT AS length, sha256(string_agg(t || chr(10), '' ORDER BY doc_id)) AS actual
  FROM (SELECT doc_id, file, CASE WHEN file % 5 = 2 AND doc_id % 64 = 7 THEN reverse(text) ELSE text END AS t FROM d WHERE file % 7 <> 4 AND NOT (file % 5 = 3 AND doc_id % 64 = 1)) GROUP BY file)"""


@query("audit_payloads", f"""WITH {PAYLOADS} SELECT file, length, CASE WHEN actual IS NULL THEN 'missing' WHEN sha256 IS NULL THEN 'unlisted' WHEN bytes <> length THEN 'size_mismatch'
  WHEN sha256 <> actual THEN 'hash_mismatch' ELSE 'ok' END AS status FROM m FULL JOIN s USING (file)""")
def audit_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Files on disk, read as bytes and hashed, against a manifest; Parquet files beside them are not payloads."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.floor(F.col("doc_id") / 64).alias("file"), "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: F.concat(x["text"], F.lit("\n")))  # 64 documents
    declared = docs.where("file % 9 <> 7").groupBy("file").agg(F.array_join(parts, "").alias("content"))
    manifest = declared.select("file", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    changed = F.when((F.col("file") % 5 == 2) & (F.col("doc_id") % 64 == 7), F.reverse("text")).otherwise(F.col("text"))
    kept = docs.where("file % 7 <> 4 AND NOT (file % 5 = 3 AND doc_id % 64 = 1)").select("doc_id", "file", changed.alias("text"))
    root = work_path(spark, "payloads")
    kept.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "text").write.partitionBy("file").text(root)
    docs.select("file", "doc_id").repartition("file").write.mode("append").partitionBy("file").parquet(root)
    stored = files.read_payloads(spark, root, ".txt", partitioned=True)
    return audit.audit_payloads(manifest, stored.withColumn("file", F.col("file").cast("bigint")), "file")


@query("audit_cache", CACHE + """, k AS (SELECT * FROM c WHERE split = 'train' UNION ALL SELECT window_id, label, language, prepared_sha256, split FROM manifest WHERE split <> 'train'),
x AS (SELECT coalesce(m.split, k.split) AS part, len(list_filter([k.window_id IS NULL, m.window_id IS NULL, m.label <> k.label, m.language <> k.language], lambda x: x)) AS found
  FROM manifest m FULL JOIN k USING (window_id)),
f AS (SELECT window_id, split, min(CASE WHEN split = 'test' AND duration = 4 THEN concat('~', window_id) ELSE window_id END) AS place FROM manifest SEMI JOIN k USING (window_id, split) GROUP BY window_id, split),
p AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY window_id) AS a, row_number() OVER (PARTITION BY split ORDER BY place) AS b FROM f),
y AS (SELECT part, found FROM x UNION ALL SELECT split, 1 FROM p WHERE a <> b)
SELECT part, sum(found)::BIGINT AS issues, sum(found) = 0 AS ready FROM y GROUP BY part
UNION ALL SELECT 'features', count(*) FILTER (vec_id % 10 = 0), count(*) FILTER (vec_id % 10 = 0) = 0 FROM embeddings""")
def audit_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of each split of a cache, and of its features; a part is ready when nothing is found.

    The training rows are stale, those of val are fresh, and some of test stand at the end of their split.
    """
    from voicelake.operators.signal import contract_failures

    rows, stale = _cache(spark, folder)
    moved = F.when((F.col("split") == "test") & (F.col("duration") == 4), F.concat(F.lit("~"), "window_id")).otherwise(F.col("window_id"))
    fresh = rows.where("split <> 'train'").select(*stale.columns, moved.alias("place"))
    cached = stale.where("split = 'train'").withColumn("place", F.col("window_id")).unionByName(fresh)
    placed = rows.withColumn("place", F.col("window_id"))
    by_split = joins.cache_issues(placed, cached, "window_id", ["label", "language", "prepared_sha256"], "place", "split").withColumnRenamed("split", "part")
    frames = st.frames(spark, folder).withColumn("vec", F.when(F.col("frame") % 10 == 0, F.slice("vec", 1, 63)).otherwise(F.col("vec")))
    failures = frames.select(F.explode_outer(contract_failures(frames, "vec", 64)).alias("check")).agg(F.lit("features").alias("part"), F.count("check").alias("issues"))
    return by_split.unionByName(failures).withColumn("ready", F.col("issues") == 0)


@query("audit_run_record", f"""WITH {st.SCORES}, h AS (SELECT language, window_id // 100 AS epoch, round(avg(abs(label - score::DOUBLE)), 6) AS err FROM scores GROUP BY ALL),
b AS (SELECT language, min(err) AS best FROM h GROUP BY language), r AS (SELECT h.language, min(epoch) AS epoch, any_value(best) AS best FROM h JOIN b ON h.language = b.language AND err = best GROUP BY h.language)
SELECT language, unnest(list_filter([CASE WHEN language IN ('de', 'fr') THEN 'selected_epoch_is_not_the_best' END, CASE WHEN language = 'fr' THEN 'reported_metric_differs' END], lambda x: x IS NOT NULL)) AS problem FROM r""")
def audit_run_record(spark: SparkSession, folder: str) -> DataFrame:
    """Reported epoch and metric against the ones recomputed from the history; two reports are wrong on purpose."""
    history = st.scores(spark, folder).groupBy("language", F.floor(F.col("window_id") / 100).alias("epoch")).agg(F.round(F.avg(F.abs(F.col("label") - F.col("score").cast("double"))), 6).alias("err"))
    best = select.best_epoch(history, ["language"], "err")
    reported = best.select("language", F.when(F.col("language").isin("de", "fr"), F.col("epoch") + 1).otherwise(F.col("epoch")).alias("r_epoch"), F.when(F.col("language") == "fr", F.col("value") + 1).otherwise(F.col("value")).alias("r_value"))
    joined = best.join(reported, "language")
    found = F.array_compact(F.array(F.when(F.col("epoch") != F.col("r_epoch"), "selected_epoch_is_not_the_best"), F.when(F.col("value") != F.col("r_value"), "reported_metric_differs")))
    return joined.select("language", F.explode_outer(found).alias("problem")).where("problem IS NOT NULL")


@query("audit_identity_contract", """SELECT p_partkey, count(*) AS differences, min(key) AS first FROM (SELECT p_partkey, unnest([CASE WHEN p_brand <> 'Brand#2' THEN 'brand' END, CASE WHEN p_size <> 11 THEN 'size' END, CASE WHEN p_type <> 'ECONOMY' THEN 'type' END, 'version']) AS key FROM part) WHERE key IS NOT NULL GROUP BY p_partkey""")
def audit_identity_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded settings of every part against one pinned set; the pinned version is recorded nowhere."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (("brand", "p_brand"), ("size", "p_size"), ("type", "p_type"))]))
    recorded = table(spark, folder, "part").select("p_partkey", pairs.alias("s")).select("p_partkey", "s.key", "s.value")
    return audit.settings_diff(recorded, {"brand": "Brand#2", "size": "11", "type": "ECONOMY", "version": "2"}, "p_partkey")


TEXT = "concat_ws('|', window_id, label, language, prepared_sha256)"


@query("audit_split_contract", MAN + " SELECT split, split <> 'val' AS count_ok, split = 'train' AS digest_ok FROM manifest GROUP BY split")
def audit_split_contract(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder)
    text = F.concat_ws("|", "window_id", "label", "language", "prepared_sha256")
    declared = signature(rows, text, ["split"]).withColumns({"rows": F.when(F.col("split") == "val", F.col("rows") + 1).otherwise(F.col("rows")), "signature": F.when(F.col("split") != "train", F.reverse("signature")).otherwise(F.col("signature"))})
    return audit.audit_split_contract(rows, declared, text)


@query("version_stamp", MAN + ", g AS (SELECT *, concat_ws('/', dataset_id, split) AS part FROM manifest), " + SIGN.format(g="part", t=TEXT, src="g") + """, c AS (SELECT concat_ws('/', dataset_id, split) AS part, count(DISTINCT recording_id) AS recordings FROM manifest GROUP BY ALL)
SELECT part, rows, recordings, signature FROM sig JOIN c USING (part)""")
def version_stamp(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder).withColumn("part", F.concat_ws("/", "dataset_id", "split"))
    counts = rows.groupBy("part").agg(F.count_distinct("recording_id").alias("recordings"))
    return signature(rows, F.concat_ws("|", "window_id", "label", "language", "prepared_sha256"), ["part"]).join(counts, "part").select("part", "rows", "recordings", "signature")


@query("version_validate", MAN + """, c AS (SELECT split, count(*) AS windows, count(*) FILTER (preprocessing_version = 'prep-2') AS retained, count(*) FILTER (preprocessing_version <> 'prep-2') AS additions FROM manifest GROUP BY split),
o AS (SELECT split, count(*) FILTER (duration > 0) AS windows, count(*) FILTER (preprocessing_version = 'prep-2') + (split = 'val')::BIGINT AS retained FROM manifest GROUP BY split)
SELECT c.*, o.windows = c.windows AND o.retained = c.retained AND o.windows - o.retained = c.additions AS counts_ok, c.split IN ('train', 'val') AS split_ok FROM c JOIN o USING (split)""")
def version_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of each split against a declared record, a JSON file that is read back; one declared count is wrong."""
    retained = F.col("preprocessing_version") == "prep-2"
    rows = st.manifest(spark, folder)
    counts = rows.groupBy("split").agg(F.count("*").alias("windows"), F.count_if(retained).alias("retained"), F.count_if(~retained).alias("additions"))
    path = work_path(spark, "version.json")
    wrong = F.when(F.col("split") == "val", 1).otherwise(0)
    declared = rows.groupBy("split").agg(F.count_if(F.col("duration") > 0).alias("d_windows"), (F.count_if(retained)).alias("r")).select("split", "d_windows", (F.col("r") + wrong).alias("d_retained"))
    sinks.write_jsonl(declared.withColumn("d_additions", F.col("d_windows") - F.col("d_retained")), path)
    record = spark.read.schema("split string, d_windows bigint, d_retained bigint, d_additions bigint").json(path)
    same = (F.col("windows") == F.col("d_windows")) & (F.col("retained") == F.col("d_retained")) & (F.col("additions") == F.col("d_additions"))
    joined = counts.join(record, "split", "left").withColumn("counts_ok", F.coalesce(same, F.lit(False)))
    return joined.select("split", "windows", "retained", "additions", "counts_ok", F.col("split").isin("train", "val").alias("split_ok"))


@query("dedupe_exclusions", "SELECT user_id, event_type AS reason, min(event_id) AS event_id, arg_min(props, event_id) AS props FROM events GROUP BY ALL")
def dedupe_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", F.col("event_type").alias("reason"), "event_id", "props")
    return audit.dedupe_exclusions(rows, ["user_id", "reason"], "event_id")


POOLS = """w AS (SELECT doc_id, concat('r', doc_id // 3) AS recording_id, text, source, doc_id % 2 = 0 AS materialized, concat('p', doc_id) AS path FROM documents),
x AS (SELECT DISTINCT recording_id FROM w WHERE source IN ('src1', 'src2') AND recording_id NOT IN (SELECT recording_id FROM w WHERE materialized)), f AS (SELECT path FROM w WHERE source <> 'src3'),
u AS (SELECT text, min(doc_id) AS first FROM w WHERE recording_id NOT IN (FROM x) AND path IN (FROM f) GROUP BY text)"""


@query("assemble_pools", f"WITH {POOLS}" + """ SELECT source, CASE WHEN recording_id IN (FROM x) THEN 'excluded' WHEN path NOT IN (FROM f) THEN 'missing_file' WHEN doc_id <> first THEN 'exact_duplicate' ELSE 'assembled' END AS disposition, count(*) AS n
FROM w LEFT JOIN u USING (text) GROUP BY ALL""")
def assemble_pools(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    windows = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("r"), F.floor(d / 3)).alias("recording_id"), F.sha2("text", 256).alias("digest"), "source", (d % 2 == 0).alias("materialized"), F.concat(F.lit("p"), d).alias("path"))
    out = audit.assemble_pools(windows, windows.where("source IN ('src1', 'src2')"), windows.where("source <> 'src3'"), "doc_id", "digest", "path")
    return out.groupBy("source", "disposition").agg(F.count("*").alias("n"))


#: Bytes that a coverage plan may read, as the reference fixes them.
BUDGET = 750_000_000


@query("coverage_plan")
def coverage_plan(spark: SparkSession, folder: str) -> DataFrame:
    """From the inventory to a plan: exclusions, identity checks, allocation, cheapest recordings, trim to the budget, digest, dispositions.

    `plan_digest` is the signature of a language's plan: its picks and the ones that were trimmed.
    """
    _, _, anchors = closure_inputs(spark, folder)
    rows = st.inventory(spark, folder).where("gender = 'm'")
    who = ["language", "speaker", "record_id", "gender"]
    # recordings repeat their identity, so distinct ones are looked up; each row is judged once and written down
    nodes = identity.candidate_nodes(F.col("language"), F.col("speaker"), F.col("record_id"), F.col("gender"))
    keys = rows.select(*who).distinct().select(F.struct(*who).alias("who"), F.explode_outer(nodes).alias("node")).withColumn("kind", F.substring("node", 1, 1))
    hit = joins.key_hits(keys, anchors, "who", {"s": "s", "r": "r", "j": "j"}).select("who.*")
    own = rows.select("row_key", *who, "shard", "row_group", "duration", "bytes", joins.identity_conflict(rows, 3.0).alias("own"))
    reason = F.coalesce("own", F.when(F.col("exposed"), "excluded_prior_exposure")).alias("reason")
    judged = cut(joins.flag(own, hit, who, "exposed").select("row_key", "language", "speaker", "shard", "row_group", "duration", "bytes", reason))
    usable = judged.where("reason IS NULL")
    allocation = cut(select.allocate_speakers(usable, ["language"], "speaker").select("language", "speaker", "split", F.col("turn").alias("turn_speaker")))
    sizes = judged.groupBy("language", "shard", "row_group").agg(F.sum("bytes").alias("bytes"))
    walk = [F.col("split") == "dev", F.col("turn_speaker")]
    picks = select.pick_recordings(usable.join(allocation, ["language", "speaker"]), ["language"], "speaker", "row_key", sizes, walk, 2)
    kept, _ = select.budget_trim(picks, "language", "speaker", BUDGET)
    fate = F.when(F.col("__kept"), F.concat(F.lit("planned_"), "split")).otherwise("trimmed_global_budget_cap").alias("fate")
    plan = cut(joins.flag(picks, kept, "row_key", "__kept").select("row_key", "language", "speaker", "turn", fate))
    digests = signature(plan, F.concat_ws("|", "language", "fate", "speaker", "turn", "row_key"), ["language"]).select("language", F.col("signature").alias("plan_digest"))
    out = judged.join(plan.select("row_key", "fate"), "row_key", "left").groupBy("language", F.coalesce("fate", "reason", F.lit("not_needed")).alias("disposition")).agg(F.count("*").alias("n"))
    return out.join(digests, "language", "left")


@query("set_union", "SELECT doc_id FROM labels UNION SELECT conv_id FROM conversations")
def set_union(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select("doc_id").union(table(spark, folder, "conversations").select("conv_id")).distinct()


@query("set_intersect", f"WITH {CLAIMS} SELECT node FROM keys WHERE kind = 's' AND split = 'train' INTERSECT SELECT node FROM keys WHERE kind = 's' AND split = 'test'")
def set_intersect(spark: SparkSession, folder: str) -> DataFrame:
    keys = identity.row_keys(st.manifest(spark, folder)).where("kind = 's'")
    return keys.where("split = 'train'").select("node").intersect(keys.where("split = 'test'").select("node"))


@query("set_except", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def set_except(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id").exceptAll(table(spark, folder, "labels").select("doc_id"))


@query("ledger_rollup", f"WITH {st.LEDGER}" + """, r AS (SELECT *, sum(bytes) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM ledger)
SELECT source, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS events, count(*) FILTER (total > 30000000) AS beyond_cap, arg_min(event_id, total) FILTER (total > 30000000) AS first_refused FROM r GROUP BY source""")
def ledger_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return audit.ledger_rollup(st.ledger(spark, folder), 30_000_000)


@query("ledger_charges")
def ledger_charges(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and refused charges of each source under one cap; `ledger_rollup` adds up what was asked for."""
    return audit.ledger_accounts(audit.charge_ledger(st.ledger(spark, folder), 30_000_000, ["ts", "event_id"]))
