"""Registered queries for sources and sinks: each writes a whole table in the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voicelake.functions.digests import signature
from voicelake.functions.labels import safe_path
from voicelake.plans import standins as st
from voicelake.plans.registry import query, table
from voicelake.plans.score_queries import rounded
from voicelake.session import cut, work_path
from voicelake.sources import files, inventory, sinks

INV = f"WITH {st.INVENTORY}"
MAN = f"WITH {st.MANIFEST}"


@query("src_jsonl_strict", "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def src_jsonl_strict(spark: SparkSession, folder: str) -> DataFrame:
    rows, path = table(spark, folder, "conversations"), work_path(spark, "conversations")
    sinks.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, rows.schema).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("src_jsonl_bad_lines", "SELECT count(*) FILTER (turn % 3 = 1) AS bad FROM conversations")
def src_jsonl_bad_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows, path = table(spark, folder, "conversations"), work_path(spark, "conversations")
    schema = "conv_id bigint, turn bigint, text string"
    line = F.to_json(F.struct("conv_id", "turn", "text"))
    rows.select(F.when(F.col("turn") % 3 == 1, F.concat(F.lit("{"), line)).when(F.col("turn") % 3 == 2, F.concat(line, F.lit("\n  "))).otherwise(line)).write.text(path)
    return files.bad_json_lines(spark, path, T.StructType.fromDDL(schema)).agg(F.count("*").alias("bad"))


@query("src_json_doc", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def src_json_doc(spark: SparkSession, folder: str) -> DataFrame:
    """Multi-line JSON report documents, one file per event type; the fallback stands for a document that is missing."""
    path = work_path(spark, "docs")
    report = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k bigint")["k"]).alias("total"))
    report.select(F.to_json(F.struct("event_type", F.struct("n", "total").alias("counts")), {"pretty": "true"})).write.option("maxRecordsPerFile", 1).text(path)
    schema = T.StructType.fromDDL("event_type string, counts struct<n: bigint, total: bigint>")
    missing = files.read_json_doc(spark, f"{path}-missing", schema, spark.createDataFrame([], schema))
    return files.read_json_doc(spark, path, schema, missing).unionByName(missing).select("event_type", "counts.n", "counts.total")


@query("src_csv_manifest", "SELECT label, lang, count(*) AS n FROM (SELECT quality AS label, d.lang FROM labels JOIN documents d USING (doc_id)) GROUP BY ALL")
def src_csv_manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.scores(spark, folder).select(F.col("window_id").alias("sample_id"), F.concat(F.lit("wav/"), "window_id").alias("path"), "label", F.col("language").alias("lang"))
    path = work_path(spark, "manifest.csv")
    sinks.write_csv(rows, path)
    return files.read_csv_manifest(spark, path, rows.schema).groupBy("label", "lang").agg(F.count("*").alias("n"))


@query("src_union_glob", "SELECT c_custkey, CAST(CASE WHEN c_nationkey = 3 THEN 2 ELSE 1 END AS BIGINT) AS copies, CAST(CASE WHEN c_nationkey = 3 THEN 2 ELSE 1 END AS BIGINT) AS versions FROM customer")
def src_union_glob(spark: SparkSession, folder: str) -> DataFrame:
    """Two overlapping exports; the second one differs for one nation."""
    rows, base = table(spark, folder, "customer"), work_path(spark, "windows")
    sinks.write_jsonl(rows, f"{base}/part.a")
    sinks.write_jsonl(rows.withColumn("c_name", F.when(F.col("c_nationkey") == 3, F.upper("c_name")).otherwise(F.col("c_name"))), f"{base}/part.b")
    distinct, conflicts = files.union_glob(spark, f"{base}/part.*", rows.schema, "c_custkey")
    kept = distinct.groupBy("c_custkey").agg(F.count("*").alias("copies"))
    return kept.join(conflicts, "c_custkey", "left").select(
        "c_custkey", "copies", F.coalesce("versions", F.lit(1).cast("bigint")).alias("versions"))


def _shards(spark: SparkSession, folder: str) -> str:
    """The inventory as parquet shards, one folder per shard name, with a payload column."""
    path = work_path(spark, "shards")
    rows = st.inventory(spark, folder).withColumn("payload", F.repeat(F.col("row_key"), 3))
    inventory.write_shards(rows, path, "shard", ["row_group", "row_key"])
    return path


@query("src_shard_inventory", INV + """ SELECT shard, count(*) AS rows, count(*) AS positions, count(DISTINCT record_id) AS records,
  count(*) FILTER (fname LIKE '%.m4a') AS parsed, count(DISTINCT speaker) AS speakers FROM inventory GROUP BY shard""")
def src_shard_inventory(spark: SparkSession, folder: str) -> DataFrame:
    rows = inventory.shard_inventory(spark, _shards(spark, folder), ["shard", "fname", "speaker", "record_id", "duration", "gender"])
    parsed = inventory.parsed_inventory(rows).groupBy("shard").agg(F.count("*").alias("parsed"))
    return rows.groupBy("shard").agg(
        F.count("*").alias("rows"), F.count_distinct("shard_file", "row_index").alias("positions"), F.count_distinct("record_id").alias("records"),
        F.count_distinct("speaker").alias("speakers")).join(parsed, "shard", "left")


@query("src_shard_counts", INV + """ SELECT shard, count(*) AS rows, count(*) FILTER (fname LIKE '%.m4a') AS parsed,
  count(*) FILTER (fname NOT LIKE '%.m4a') AS unparsed FROM inventory GROUP BY shard""")
def src_shard_counts(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.shard_counts(inventory.shard_inventory(spark, _shards(spark, folder), ["shard", "fname"]), ["shard"])


@query("src_row_fetch", INV + ", p AS (SELECT shard, max(duration) AS duration FROM inventory WHERE speaker LIKE '%3' GROUP BY shard) " + """
SELECT row_key, concat(row_key, row_key, row_key) AS payload FROM inventory JOIN p USING (shard, duration) WHERE speaker LIKE '%3'""")
def src_row_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """Plan from metadata columns, then read the planned files alone and keep the payloads at the planned positions."""
    path = _shards(spark, folder)
    rows = inventory.located(spark.read.parquet(path), ["shard", "row_group", "duration", "speaker"]).where(F.col("speaker").endswith("3"))
    longest = rows.groupBy("shard").agg(F.max("duration").alias("duration"))
    plan = cut(rows.join(longest, ["shard", "duration"], "left_semi").select("shard_path", "row_index", "row_group"))
    payloads = inventory.planned_rows(spark, path, plan, ["row_key", "payload"], "row_group")
    return inventory.fetch_rows(payloads, plan, ["shard_path", "row_index"]).select("row_key", "payload")


@query("src_group_sizes", INV + " SELECT shard, row_group, CAST(sum(3 * octet_length(encode(row_key))) AS BIGINT) AS bytes, count(*) AS rows FROM inventory GROUP BY ALL")
def src_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(_shards(spark, folder))
    return inventory.group_sizes(rows, F.octet_length("payload"))


@query("src_remaining_shards", INV + " SELECT shard, count(*) AS rows FROM inventory WHERE shard NOT IN (SELECT shard FROM inventory WHERE record_id = '11') GROUP BY shard")
def src_remaining_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.inventory(spark, folder)
    listed = rows.groupBy("shard").agg(F.count("*").alias("rows")).withColumn("revision", F.lit("rev-1"))
    scanned = rows.where("record_id = '11'")
    return inventory.remaining_shards(listed, scanned, "shard", "rev-1").select("shard", "rows")


FRAME_ROWS = f"WITH {st.FRAMES}"


@query("src_feature_read", FRAME_ROWS + """ SELECT window_id, count(*) AS frames, min(len(vec)) AS dim_min, max(len(vec)) AS dim_max,
  rank() OVER (ORDER BY window_id) AS position, true AS frames_match FROM frames GROUP BY window_id""")
def src_feature_read(spark: SparkSession, folder: str) -> DataFrame:
    """Read a written feature bundle, check its dimension and frame counts, and order it as the manifest does."""
    rows, path = st.frames(spark, folder), work_path(spark, "features")
    manifest = rows.groupBy("window_id").agg(F.count("*").alias("declared"))
    sinks.write_feature_bundle(rows, path, manifest.agg(F.count("*").alias("windows")))
    stored = spark.read.parquet(f"{path}/frames").groupBy("window_id").agg(
        F.count("*").alias("frames"), F.min(F.size("vec")).cast("bigint").alias("dim_min"), F.max(F.size("vec")).cast("bigint").alias("dim_max"))
    from voicelake.operators.prefix import ranked
    placed = ranked(manifest, [], [F.col("window_id")], "position")
    return placed.join(stored, "window_id").select("window_id", "frames", "dim_min", "dim_max", "position", (F.col("frames") == F.col("declared")).alias("frames_match"))


@query("src_strata_sample", """WITH n AS (SELECT max(o_orderkey) + 1 AS total FROM orders), w AS (SELECT greatest(CAST(ceil(total / 10) AS BIGINT), 1) AS width FROM n),
s AS (SELECT o_orderkey, o_orderkey // width AS stratum, width FROM orders, w),
t AS (SELECT *, stratum * width + CAST(('0x' || substr(md5(concat('pages:', stratum)), 1, 15)) AS BIGINT) % greatest(width - 100 + 1, 1) AS start FROM s)
SELECT o_orderkey, stratum FROM t WHERE o_orderkey >= start AND o_orderkey < start + 100""")
def src_strata_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey")
    total = rows.agg((F.max("o_orderkey") + 1).alias("t")).scalar()
    return inventory.strata_sample(rows, "o_orderkey", total, 10, 100, "pages")


PROTO = """SELECT concat('LA_', u.user_id) AS speaker, concat('LA_D_', event_id) AS utterance, concat('A0', event_id % 7) AS attack,
  CASE WHEN event_type = 'view' THEN 'bonafide' ELSE 'spoof' END AS key, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label
FROM events u WHERE event_type <> 'click'"""


@query("src_protocol_text", PROTO)
def src_protocol_text(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "protocol")
    key = F.when(F.col("event_type") == "view", "Bonafide").otherwise("spoof")
    utterance = F.concat(F.when(F.col("event_type") == "click", "XX_D_").otherwise("LA_D_"), "event_id")
    line = F.concat_ws(" ", F.concat(F.lit("LA_"), "user_id"), utterance, F.lit("-"), F.concat(F.lit("A0"), F.col("event_id") % 7), key)
    table(spark, folder, "events").select(F.concat(F.lit(" "), line, F.lit("  "))).write.text(path)
    return files.read_protocol(spark.read.text(path))


@query("src_metadata_import", """SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM (SELECT CASE WHEN page_id % 5 = 0 THEN 'missing_speaker'
  WHEN page_id % 7 = 0 THEN 'missing_language' WHEN page_id % 11 = 0 THEN 'escapes_base' END AS reason FROM pages) GROUP BY outcome""")
def src_metadata_import(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("page_id")
    rows = table(spark, folder, "pages").select(
        "page_id", F.when(p % 5 != 0, F.concat(F.lit("spk"), p)).otherwise(" ").alias("speaker"), F.when(p % 7 != 0, "english").alias("language"),
        F.when(p % 11 == 0, F.concat(F.lit("a/../../"), p)).otherwise(F.concat(F.lit("wav/"), p)).alias("path"))
    good, bad = files.import_metadata(rows, ["speaker", "language", "path"], safe_path(F.col("path")))
    outcomes = good.select(F.lit("accepted").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


@query("src_file_listing", """SELECT concat('src_', lang, '_', printf('%06d', row_number() OVER (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR)))) AS sample_id,
  lang, concat(doc_id, CASE WHEN doc_id % 2 = 0 THEN '.wav' ELSE '.FLAC' END) AS name FROM documents WHERE doc_id % 5 <> 0""")
def src_file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """List a tree by extension and number the files of each language in path order.

    The listing is the path column of the documents table laid out as a tree: writing one file per document would test
    the file system, not the operator. `list_files` itself is covered by tests.
    """
    d = F.col("doc_id")
    ext = F.when(d % 5 == 0, ".txt").when(d % 2 == 0, ".wav").otherwise(".FLAC")
    tree = table(spark, folder, "documents").select("lang", F.lit("src").alias("key"), F.concat(d, ext).alias("name"), d.cast("string").alias("path"))
    kept = tree.where(F.lower(F.regexp_extract("name", r"\.([^./]*)$", 1)).isin("wav", "flac"))
    return files.number_samples(kept, ["key", "lang"]).select("sample_id", "lang", "name")


@query("src_file_tree", "SELECT concat('src_', lang, '_000001') AS sample_id, lang FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def src_file_tree(spark: SparkSession, folder: str) -> DataFrame:
    """A tree that Spark has written, one Parquet and one text file a language: listed by extension and numbered."""
    rows, path = table(spark, folder, "documents").select("lang", F.col("doc_id").cast("string").alias("value")).where("lang IS NOT NULL"), work_path(spark, "tree")
    rows.repartition("lang").write.partitionBy("lang").parquet(path)
    rows.repartition("lang").write.mode("append").partitionBy("lang").text(path)
    found = files.list_files(spark, path, ["parquet"]).select("path", F.lit("src").alias("key"), F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang"))
    return files.number_samples(found, ["key", "lang"]).select("sample_id", "lang")


@query("src_member_metadata", """SELECT concat('clips/', page_id, '.wav') AS path, CASE WHEN page_id % 4 > 0 THEN url END AS origin,
  CASE WHEN page_id % 4 > 0 THEN CAST(length(html) AS INTEGER) END AS size FROM pages""")
def src_member_metadata(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    audio = pages.select(F.concat(F.lit("clips/"), "page_id", F.lit(".wav")).alias("path"))
    meta = pages.where("page_id % 4 > 0").select(F.concat(F.lit("meta/"), "page_id", F.lit(".json")).alias("path"), F.col("url").alias("origin"), F.length("html").alias("size"))
    return files.join_members(audio, meta).select("path", "origin", "size")


@query("src_text_id_scan", """SELECT id, count(*) AS files FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '[a-z]+[.]example[.][a-z]+')) AS id FROM pages) GROUP BY id""")
def src_text_id_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Ids mentioned in texts, and in how many of them."""
    texts = table(spark, folder, "pages").select(F.col("html").alias("value"), F.col("page_id").alias("file"))
    return files.scan_ids(texts, "[a-z]+[.]example[.][a-z]+").groupBy("id").agg(F.count("*").alias("files"))


@query("src_source_catalog", """SELECT source, count(*) AS windows, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'training'
  WHEN source = 'src3' THEN 'evaluation_only' ELSE 'not_listed' END AS role FROM documents GROUP BY source""")
def src_source_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """A declared catalog (name, status, licence, role) beside what each source really holds."""
    declared = spark.createDataFrame(
        [("src0", "ready", "CC-BY-4.0", "training"), ("src1", "ready", "CC0", "training"), ("src2", "access_required", "custom", "training"),
         ("src3", "ready", "ODC-BY", "evaluation_only")], "source string, status string, licence string, role string")
    held = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("windows"))
    return held.join(declared, "source", "left").select("source", "windows", F.coalesce("role", F.lit("not_listed")).alias("role"))


@query("snk_jsonl_atomic", "SELECT count(*) AS rows, count(o_orderstatus) AS with_status, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders)")
def snk_jsonl_atomic(spark: SparkSession, folder: str) -> DataFrame:
    rows, path = table(spark, folder, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus")), work_path(spark, "orders")
    sinks.write_jsonl(rows.where("o_orderkey < 10"), path)
    sinks.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, rows.schema).agg(F.count("*").alias("rows"), F.count("o_orderstatus").alias("with_status"), F.sum("o_orderkey").alias("keys"))


@query("snk_append_log", "SELECT event_type AS stage, 2 * count(*) AS entries FROM events GROUP BY event_type")
def snk_append_log(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "log")
    log = table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("event_type").alias("stage"),
                                                F.array("event_type", F.col("user_id").cast("string")).alias("argv"), F.create_map(F.lit("value"), "value").alias("summary"))
    sinks.append_log(log, path)
    sinks.append_log(log, path)
    schema = T.StructType.fromDDL("timestamp string, stage string, argv array<string>, summary map<string, double>")
    return files.read_jsonl(spark, path, schema).groupBy("stage").agg(F.count("*").alias("entries"))


@query("snk_csv_tables", f"WITH {st.SCORES} SELECT language, count(*) AS n, round(sum(score::DOUBLE), 4) AS total FROM scores GROUP BY language")
def snk_csv_tables(spark: SparkSession, folder: str) -> DataFrame:
    rows, path = st.scores(spark, folder), work_path(spark, "predictions.csv")
    sinks.write_csv(rows, path)
    back = files.read_csv_manifest(spark, path, rows.schema)
    return rounded(back.groupBy("language").agg(F.count("*").alias("n"), F.sum(F.col("score").cast("double")).alias("total")), "total", digits=4)


@query("snk_payload_store", "SELECT count(*) FILTER (NOT old) AS added, count(*) AS stored FROM (SELECT text, bool_or(source = 'src1') AS old FROM documents GROUP BY text)")
def snk_payload_store(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents").select("text", "source", F.sha2("text", 256).alias("sha256")), work_path(spark, "store")
    sinks.store_payloads(spark, docs.where("source = 'src1'"), path)
    added = sinks.store_payloads(spark, docs, path)
    stored = spark.read.parquet(path).agg(F.count("*").alias("stored"))
    return added.agg(F.count("*").alias("added")).withColumn("stored", stored.scalar())


@query("snk_pool_manifests", MAN + " SELECT split, dataset_id AS pool, count(*) AS rows FROM manifest GROUP BY ALL")
def snk_pool_manifests(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "pools")
    sinks.write_pools(st.manifest(spark, folder).select("window_id", "split", F.col("dataset_id").alias("pool"), "label"), path)
    return spark.read.parquet(path).groupBy("split", "pool").agg(F.count("*").alias("rows"))


@query("snk_replace_partitions", MAN + """ SELECT language, count(*) AS rows, count(*) FILTER (language = 'hindi') AS fresh FROM manifest
WHERE language <> 'hindi' OR split = 'train' GROUP BY language""")
def snk_replace_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Only the processed language is replaced."""
    rows, path = st.manifest(spark, folder).select("window_id", "split", "language"), work_path(spark, "windows")
    sinks.replace_partitions(rows.withColumn("run", F.lit(1)), path, ["language"])
    sinks.replace_partitions(rows.where("language = 'hindi' AND split = 'train'").withColumn("run", F.lit(2)), path, ["language"])
    return spark.read.parquet(path).groupBy("language").agg(F.count("*").alias("rows"), F.count_if(F.col("run") == 2).alias("fresh"))


@query("snk_promote_prune", "SELECT o_orderkey AS orphan, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def snk_promote_prune(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest in parts is staged, checked and swapped; then the stored files that it does not reference."""
    stored = table(spark, folder, "orders").select(F.col("o_orderkey").alias("orphan"), F.col("o_orderstatus").alias("status"))
    lines, path = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("orphan"), F.col("l_returnflag").alias("part")), work_path(spark, "promoted")
    sinks.promote(lines.where("orphan % 2 = 0"), lines.where("orphan % 2 = 0"), "part", path)
    sinks.promote(lines, lines, "part", path)
    return sinks.orphans(stored, spark.read.parquet(path), "orphan")


@query("snk_feature_bundle", FRAME_ROWS + " SELECT count(*) AS frames, count(DISTINCT window_id) AS windows, CAST(sum(len(vec)) AS BIGINT) AS numbers FROM frames")
def snk_feature_bundle(spark: SparkSession, folder: str) -> DataFrame:
    rows, path = st.frames(spark, folder), work_path(spark, "bundle")
    sinks.write_feature_bundle(rows, path, signature(rows, F.concat_ws(":", "window_id", "frame")))
    return spark.read.parquet(f"{path}/frames").agg(F.count("*").alias("frames"), F.count_distinct("window_id").alias("windows"), F.sum(F.size("vec")).alias("numbers"))


@query("snk_markdown_table", """SELECT '| event_type | n |' AS line UNION ALL SELECT '| --- | --- |'
UNION ALL SELECT concat('| ', event_type, ' | ', count(*), ' |') FROM events GROUP BY event_type""")
def snk_markdown_table(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return sinks.markdown_rows(counts, ["event_type"])
