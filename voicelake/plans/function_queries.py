"""Registered queries for scalar functions and predicates, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.functions import digests, ids, labels
from voicelake.plans import standins as st
from voicelake.plans.registry import query, table
from voicelake.plans.score_queries import rounded

EXT = "m4a|wav|mp3|flac|ogg"
FN = f"WITH {st.FNAMES}"


@query("parse_fname", FN + f""", p AS (SELECT id, fname, '^([0-9]+)-([0-9]+)-([mf])\\.({EXT})$' AS re FROM fnames)
SELECT id, CASE WHEN ok THEN regexp_extract(fname, '^([0-9]+)-([0-9]+)-([mf])\\.({EXT})$', 1) END AS record_id,
  CASE WHEN ok THEN regexp_extract(fname, '^([0-9]+)-([0-9]+)-([mf])\\.({EXT})$', 2) END AS speaker,
  CASE WHEN ok THEN regexp_extract(fname, '^([0-9]+)-([0-9]+)-([mf])\\.({EXT})$', 3) END AS gender,
  CASE WHEN ok THEN regexp_extract(fname, '^([0-9]+)-([0-9]+)-([mf])\\.({EXT})$', 4) END AS extension
FROM (SELECT id, fname, regexp_matches(fname, '^([0-9]+)-([0-9]+)-([mf])\\.({EXT})$') AS ok FROM fnames)""")
def parse_fname(spark: SparkSession, folder: str) -> DataFrame:
    return st.fnames(spark, folder).withColumn("p", ids.parse_fname(F.col("fname"))).select("id", "p.*")


REF = f"""b AS (SELECT *, lower(regexp_extract(replace(fname, '\\', '/'), '([^/]*)/*$', 1)) AS name FROM fnames),
r AS (SELECT *, regexp_extract(name, '^([0-9]+)-([0-9]+)-([mf])(\\.({EXT}))?$', ['record', 'speaker', 'gender']) AS p,
  regexp_matches(name, '^([0-9]+)-([0-9]+)-([mf])(\\.({EXT}))?$') AS ok FROM b)"""


@query("parse_reference", FN + ", " + REF + """ SELECT id, CASE WHEN ok THEN CAST(try_cast(p.record AS HUGEINT) AS VARCHAR) END AS record,
  CASE WHEN ok THEN CAST(try_cast(p.speaker AS HUGEINT) AS VARCHAR) END AS speaker, CASE WHEN ok THEN p.gender END AS gender,
  CASE WHEN ok THEN concat(try_cast(p.record AS HUGEINT), '-', try_cast(p.speaker AS HUGEINT), '-', p.gender) END AS canonical FROM r""")
def parse_reference(spark: SparkSession, folder: str) -> DataFrame:
    return st.fnames(spark, folder).withColumn("p", ids.parse_reference(F.col("fname"))).select("id", "p.*")


# text forms of numbers, good and bad, over all order keys
RAW = """raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN concat(' ', o_custkey, ' ') WHEN 1 THEN concat(o_custkey, '.0')
  WHEN 2 THEN concat(o_custkey, '.5') WHEN 3 THEN concat('-', o_custkey + 1) WHEN 4 THEN 'None' WHEN 5 THEN '' WHEN 6 THEN 'nan'
  WHEN 7 THEN concat('spk', o_custkey) ELSE concat('00', o_custkey) END AS v FROM orders)"""


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = k % 9
    v = (F.when(t == 0, F.concat(F.lit(" "), c, F.lit(" "))).when(t == 1, F.concat(c, F.lit(".0"))).when(t == 2, F.concat(c, F.lit(".5")))
         .when(t == 3, F.concat(F.lit("-"), c + 1)).when(t == 4, "None").when(t == 5, "").when(t == 6, "nan")
         .when(t == 7, F.concat(F.lit("spk"), c)).otherwise(F.concat(F.lit("00"), c)))
    return table(spark, folder, "orders").select(k.alias("id"), v.alias("v"))


@query("numeric_id", f"""WITH {RAW}, d AS (SELECT id, CASE WHEN trim(v) <> '' THEN try_cast(trim(v) AS DECIMAL(38,10)) END AS n FROM raw)
SELECT id, CASE WHEN n >= 0 AND n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) END AS canonical FROM d""")
def numeric_id(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(spark, folder).select("id", ids.numeric_id(F.col("v")).alias("canonical"))


@query("canonical_int", f"""WITH {RAW}, d AS (SELECT id, try_cast(trim(v) AS DOUBLE) AS n FROM raw)
SELECT id, CASE WHEN NOT isnan(n) AND NOT isinf(n) AND n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) END AS canonical FROM d""")
def canonical_int(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(spark, folder).select("id", ids.canonical_int(F.col("v")).alias("canonical"))


@query("canonical_identifier", f"""WITH {RAW}, d AS (SELECT id, trim(v) AS t, try_cast(trim(v) AS DOUBLE) AS n FROM raw)
SELECT id, CASE WHEN t = '' THEN NULL WHEN n IS NULL THEN t WHEN isnan(n) OR isinf(n) THEN NULL
  WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE t END AS canonical FROM d""")
def canonical_identifier(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(spark, folder).select("id", ids.canonical_identifier(F.col("v")).alias("canonical"))


@query("canonical_recording", f"""WITH {RAW} SELECT id, CASE WHEN try_cast(trim(v) AS BIGINT) IS NOT NULL AND v NOT LIKE '%.%'
  THEN concat(id, '-', CAST(trim(v) AS BIGINT), '-', CASE WHEN id % 2 = 0 THEN 'f' ELSE 'm' END) END AS canonical FROM raw""")
def canonical_recording(spark: SparkSession, folder: str) -> DataFrame:
    gender = F.when(F.col("id") % 2 == 0, "f").otherwise("m")
    whole = F.when(~F.col("v").contains("."), F.col("v"))
    return _raw(spark, folder).select("id", ids.canonical_recording(F.col("id"), whole, gender).alias("canonical"))


@query("candidate_id", """SELECT doc_id, concat('candidate-', lower(lang), '-', CASE WHEN doc_id < 1000000 THEN lpad(CAST(doc_id AS VARCHAR), 6, '0')
  ELSE CAST(doc_id AS VARCHAR) END) AS candidate_id FROM documents""")
def candidate_id(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", ids.candidate_id(F.lit("candidate"), F.col("lang"), F.col("doc_id")).alias("candidate_id"))


@query("lang_normalize", f"""WITH {st.MANIFEST} SELECT window_id, CASE lower(trim(spoken_language)) WHEN 'hi' THEN 'hindi'
  ELSE lower(trim(spoken_language)) END AS language FROM manifest""")
def lang_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return st.manifest(spark, folder).select("window_id", ids.lang_normalize(F.col("spoken_language")).alias("language"))


LAB = """raw AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '1.0' WHEN 4 THEN '0.5'
  WHEN 5 THEN 'true' WHEN 6 THEN 'nan' END AS v FROM lineitem)"""


def _label_texts(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("l_linenumber")
    v = F.when(n == 1, "0").when(n == 2, "1").when(n == 3, "1.0").when(n == 4, "0.5").when(n == 5, "true").when(n == 6, "nan")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", v.alias("v"))


@query("label_validate", f"""WITH {LAB} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, v,
  CASE v WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '1.0' THEN 1 END AS label FROM raw""")
def label_validate(spark: SparkSession, folder: str) -> DataFrame:
    return _label_texts(spark, folder).withColumn("label", labels.label_valid(F.col("v")))


@query("label_name", f"""WITH {LAB} SELECT CASE v WHEN '0' THEN 'genuine' WHEN '1' THEN 'spoof' WHEN '1.0' THEN 'spoof' ELSE 'unknown' END AS name,
  count(*) AS n FROM raw GROUP BY name""")
def label_name(spark: SparkSession, folder: str) -> DataFrame:
    return _label_texts(spark, folder).groupBy(labels.label_name(labels.label_valid(F.col("v"))).alias("name")).agg(F.count("*").alias("n"))


@query("protocol_label", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS label FROM events")
def protocol_label(spark: SparkSession, folder: str) -> DataFrame:
    key = F.when(F.col("event_type") == "view", "Bonafide").when(F.col("event_type") == "click", "bona-fide").otherwise(F.col("event_type"))
    return table(spark, folder, "events").select("event_id", labels.protocol_label(key).alias("label"))


@query("parse_chunk_name", """SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS record, CASE WHEN turn % 3 = 2 THEN CAST(conv_id AS VARCHAR) ELSE role END AS speaker,
  CASE WHEN turn % 3 = 0 THEN CAST(turn AS VARCHAR) ELSE '' END AS chunk FROM conversations""")
def parse_chunk_name(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("turn") % 3
    path = (F.when(t == 0, F.concat(F.lit("wav/"), "conv_id", F.lit("_"), "role", F.lit("_chunk_"), "turn", F.lit(".wav")))
            .when(t == 1, F.concat("conv_id", F.lit("_"), "role", F.lit(".wav"))).otherwise(F.concat("conv_id", F.lit(".wav"))))
    return table(spark, folder, "conversations").withColumn("p", ids.parse_chunk_name(path)).select("conv_id", "turn", "p.*")


@query("parse_group_wav", """SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN substr(c_mktsegment, 1, 3) END AS code,
  CASE WHEN c_custkey % 4 > 0 THEN lpad(CAST(c_nationkey AS VARCHAR), 4, '0') END AS speaker, CASE WHEN c_custkey % 4 > 0 THEN 'f' END AS gender,
  CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey AS VARCHAR) END AS utterance,
  CASE WHEN c_nationkey % 2 = 0 THEN concat(substr(c_mktsegment, 1, 3), '_', c_nationkey) END AS canonical FROM customer""")
def parse_group_wav(spark: SparkSession, folder: str) -> DataFrame:
    code = F.substring("c_mktsegment", 1, 3)
    wav = F.concat(code, F.lit("_"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"), F.lit("_Eng_"),
                   F.when(F.col("c_custkey") % 4 > 0, "f").otherwise("x"), F.lit("_"), "c_custkey", F.lit(".wav"))
    token = F.concat(F.lit(" "), code, F.lit("_"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")), F.lit("_x "))
    return (table(spark, folder, "customer").withColumn("p", ids.parse_group_wav(wav))
            .select("c_custkey", "p.*", ids.canonical_speaker(F.coalesce(token, F.concat(code, F.lit("_")))).alias("canonical")))


@query("first_present", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS VARCHAR) END,
  CASE WHEN o_orderstatus = 'F' THEN concat('lect-', o_custkey) END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END) AS speaker FROM orders""")
def first_present(spark: SparkSession, folder: str) -> DataFrame:
    fields = [F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey").cast("string")).otherwise(""), F.lit(""),
              F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("lect-"), "o_custkey")), F.lit(None).cast("string"), F.lit(""),
              F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))]
    return table(spark, folder, "orders").select("o_orderkey", ids.first_present(*fields).alias("speaker"))


@query("row_facts", f"""WITH {st.MANIFEST} SELECT window_id, generator, source_speaker AS declared_source_speaker, target_speaker AS declared_target_speaker,
  CASE WHEN source_reference IS NOT NULL THEN split_part(source_reference, '-', 1) END AS source_record,
  CASE WHEN target_reference IS NOT NULL THEN split_part(split_part(target_reference, '/', 2), '-', 1) END AS target_record,
  CASE WHEN generator <> 'vits' THEN concat('src/', window_id) END AS audio_src,
  CASE WHEN generator <> 'vits' THEN 'audio/wav' END AS audio_type FROM manifest WHERE label = 1""")
def row_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Flatten nested upstream rows: the first audio cell, canonical ids, parsed references."""
    nested = st.manifest(spark, folder).where("label = 1").select(
        "window_id", "generator", F.struct("source_speaker", "target_speaker").alias("ids"), F.struct("source_reference", "target_reference").alias("refs"),
        F.when(F.col("generator") != "vits", F.array(F.struct(F.concat(F.lit("src/"), "window_id").alias("src"), F.lit("audio/wav").alias("type"))))
        .otherwise(F.array().cast("array<struct<src:string,type:string>>")).alias("audio"))
    cell = F.try_element_at("audio", F.lit(1))
    return nested.select(
        "window_id", "generator", ids.canonical_int(F.col("ids.source_speaker")).alias("declared_source_speaker"),
        ids.canonical_int(F.col("ids.target_speaker")).alias("declared_target_speaker"),
        ids.parse_reference(F.col("refs.source_reference"))["record"].alias("source_record"),
        ids.parse_reference(F.col("refs.target_reference"))["record"].alias("target_record"),
        cell["src"].alias("audio_src"), cell["type"].alias("audio_type"))


@query("media_extension", """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '.flac' WHEN page_id % 4 = 1 THEN '.mp3'
  WHEN page_id % 8 = 2 THEN '.ogg' ELSE '.wav' END AS extension FROM pages""")
def media_extension(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("page_id")
    kind = F.when(p % 4 == 0, "audio/FLAC").when(p % 4 == 1, "audio/mpeg")
    plain = F.regexp_extract("url", r"^([^?#]*?)/?(\.html)?([?#].*)?$", 1)
    url = F.concat(F.regexp_replace(plain, r"\.", "_"), F.when(p % 8 == 2, ".OGG").otherwise(".txt"), F.lit("?x=1.mp3"))
    return table(spark, folder, "pages").select("page_id", labels.media_extension(kind, url).alias("extension"))


@query("source_kind", f"""WITH {st.MANIFEST} SELECT window_id, CASE WHEN source_reference IS NULL THEN 'tts_target_only'
  WHEN generator = 'freevc24' THEN 'conversion_source' ELSE 'declared_source' END AS kind FROM manifest WHERE label = 1""")
def source_kind(spark: SparkSession, folder: str) -> DataFrame:
    return st.manifest(spark, folder).where("label = 1").select("window_id", labels.source_kind(F.col("generator"), F.col("source_reference")).alias("kind"))


@query("parent_status", f"""WITH {st.MANIFEST} SELECT source_kind, split, CASE WHEN source_kind = 'tts_target_only' THEN 'not_applicable_tts'
  WHEN evidence_verified THEN 'verified_train' ELSE 'parsed_only' END AS status, count(*) AS n FROM manifest WHERE label = 1 GROUP BY ALL""")
def parent_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder).where("label = 1")
    return rows.groupBy("source_kind", "split", labels.parent_status(F.col("source_kind"), F.col("evidence_verified")).alias("status")).agg(F.count("*").alias("n"))


@query("gender_of_reference", FN + """, b AS (SELECT id, lower(regexp_extract(replace(fname, '\\', '/'), '([^/]*)/*$', 1)) AS name FROM fnames)
SELECT id, nullif(regexp_extract(name, '(^|-)([mf])(\\.[^.]*)?$', 2), '') AS gender FROM b""")
def gender_of_reference(spark: SparkSession, folder: str) -> DataFrame:
    return st.fnames(spark, folder).select("id", ids.gender_of_reference(F.col("fname")).alias("gender"))


@query("reason_prefix", "SELECT event_type AS reason, count(*) AS n FROM events GROUP BY event_type")
def reason_prefix(spark: SparkSession, folder: str) -> DataFrame:
    reason = F.concat("event_type", F.lit(": user "), "user_id", F.lit(", props "), "props")
    return table(spark, folder, "events").groupBy(labels.reason_prefix(reason).alias("reason")).agg(F.count("*").alias("n"))


@query("route_language", """SELECT doc_id, CASE WHEN lang = 'es' THEN 'indic' ELSE 'global_fallback' END AS route,
  CASE WHEN lang = 'es' THEN 'configured_language' ELSE 'missing_or_other_language' END AS reason FROM documents""")
def route_language(spark: SparkSession, folder: str) -> DataFrame:
    tag = F.when(F.col("lang") == "es", " HI-in").when(F.col("lang") != "de", F.col("lang"))
    route, reason = labels.route_language(tag)
    return table(spark, folder, "documents").select("doc_id", route.alias("route"), reason.alias("reason"))


@query("safe_path", FN + """ SELECT id, CASE id % 5 WHEN 0 THEN 'absolute' WHEN 1 THEN 'escapes_base' WHEN 2 THEN 'empty' WHEN 3 THEN 'undeclared_base' END AS problem,
  CASE WHEN id % 5 = 4 THEN concat('datasets/', replace(fname, '\\', '/')) END AS resolved FROM fnames""")
def safe_path(spark: SparkSession, folder: str) -> DataFrame:
    """Unsafe paths, undeclared bases and the resolved path. The bases are a declared map of a few names."""
    t = F.col("id") % 5
    path = F.when(t == 0, F.concat(F.lit("/"), "fname")).when(t == 1, F.concat(F.lit("a/../"), "fname")).when(t == 2, "").otherwise(F.col("fname"))
    base = F.when(t == 3, "elsewhere").otherwise("main")
    bases = F.create_map(F.lit("main"), F.lit("datasets"), F.lit("extra"), F.lit("datasets-extra"))
    problem = F.coalesce(labels.safe_path(path), F.when(F.try_element_at(bases, base).isNull(), "undeclared_base"))
    resolved = F.concat_ws("/", F.try_element_at(bases, base), F.replace(path, F.lit("\\"), F.lit("/")))
    return st.fnames(spark, folder).select("id", problem.alias("problem"), F.when(problem.isNull(), resolved).alias("resolved"))


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("content_hash_float32")
def content_hash_float32(spark: SparkSession, folder: str) -> DataFrame:
    """Hash of float arrays as float32 bytes (Arrow; DuckDB has no view of float bytes, so tests check it with numpy)."""
    return st.frames(spark, folder).select("frame", digests.float32_sha256(F.col("vec")).alias("sha256"))


@query("canonical_json_digest", """SELECT c_custkey, sha256(concat('{"c_custkey":', c_custkey, ',"c_mktsegment":"', c_mktsegment, '","c_nationkey":', c_nationkey, '}')) AS digest FROM customer""")
def canonical_json_digest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", "c_acctbal", F.lit(1).alias("_private"))
    return rows.select("c_custkey", digests.json_digest(rows, drop=["c_acctbal"]).alias("digest"))


@query("settings_fingerprint", """SELECT p_partkey, concat('prep-v2:sha256:', substr(sha256(concat('{"p_brand":"', p_brand, '","p_size":', p_size, '}')), 1, 16)) AS fingerprint FROM part""")
def settings_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part")
    return rows.select("p_partkey", digests.settings_fingerprint(rows, "prep-v2", ["p_size", "p_brand"]).alias("fingerprint"))


@query("bytes_estimate", f"""WITH {st.INVENTORY}, s AS (SELECT shard, row_group, sum(bytes) AS size FROM inventory GROUP BY ALL HAVING row_group <> 7),
n AS (SELECT DISTINCT speaker, shard, row_group FROM inventory)
SELECT speaker, CASE WHEN count(*) = count(size) THEN CAST(sum(size) + 65536 AS BIGINT) END AS estimate FROM n LEFT JOIN s USING (shard, row_group) GROUP BY speaker""")
def bytes_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Known bytes of the row groups each speaker needs plus 64 KiB; NULL when one size is unknown."""
    from voicelake.sources.inventory import bytes_estimate as estimate
    rows = st.inventory(spark, folder)
    sizes = rows.where("row_group <> 7").groupBy("shard", "row_group").agg(F.sum("bytes").alias("size"))
    return estimate(rows, sizes, ["speaker"])


@query("fmt_bytes", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' WHEN b >= 1099511627776 THEN printf('%.2f TiB', b / 1099511627776.0::DOUBLE) WHEN b >= 1073741824 THEN printf('%.2f GiB', b / 1073741824.0::DOUBLE)
  WHEN b >= 1048576 THEN printf('%.2f MiB', b / 1048576.0::DOUBLE) WHEN b >= 1024 THEN printf('%.2f KiB', b / 1024.0::DOUBLE) ELSE printf('%.2f B', b::DOUBLE) END AS text
  FROM (SELECT o_orderkey, CAST(o_custkey AS BIGINT) * o_custkey * (o_orderkey % 100) AS b FROM orders)""")
def fmt_bytes(spark: SparkSession, folder: str) -> DataFrame:
    size = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") * F.col("o_custkey") * (F.col("o_orderkey") % 100))
    return table(spark, folder, "orders").select("o_orderkey", labels.fmt_bytes(size).alias("text"))


@query("build_record", f"""WITH {st.MANIFEST} SELECT window_id, recording_id, dataset_id, CASE split WHEN 'test' THEN 'external_eval' ELSE 'core' END AS pool,
  CASE WHEN label = 0 THEN 'genuine' ELSE 'spoof' END AS label_name, prepared_sha256 AS prepared, round(duration, 6) AS seconds,
  coalesce(speaker, target_speaker) AS main_speaker, true AS pool_known FROM manifest""")
def build_record(spark: SparkSession, folder: str) -> DataFrame:
    """Nested window records of one fixed schema, read back through their nested fields."""
    from voicelake.sources.records import vocabulary_violations, window_record
    rows = st.manifest(spark, folder).withColumn("pool", F.when(F.col("split") == "test", "external_eval").otherwise("core"))
    records = window_record(rows)
    unknown = vocabulary_violations(records).select("window_id").distinct().withColumn("unknown", F.lit(True))
    return records.join(unknown, "window_id", "left").select(
        "window_id", "recording_id", "dataset_id", "pool", "label_name", F.col("prepared_audio.sha256").alias("prepared"),
        F.round("window.duration_seconds", 6).alias("seconds"), F.coalesce("speaker_ids.speaker", "speaker_ids.target").alias("main_speaker"),
        F.col("unknown").isNull().alias("pool_known"))


@query("build_record_kinds", f"""WITH {st.MANIFEST}, r AS (SELECT DISTINCT recording_id, dataset_id FROM manifest)
SELECT 'recording' AS kind, dataset_id, count(*) AS n FROM r GROUP BY dataset_id
UNION ALL SELECT 'exclusion', dataset_id, count(*) FROM manifest WHERE duration = 2 GROUP BY dataset_id
UNION ALL SELECT 'vocabulary', dataset_id, count(*) FROM manifest WHERE duration IN (3, 4) GROUP BY dataset_id""")
def build_record_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Recording and exclusion rows, and window rows with a planted pool and a planted status outside the vocabulary."""
    from voicelake.sources.records import exclusion_row, recording_record, vocabulary_violations, window_record
    rows, seconds = st.manifest(spark, folder), F.col("duration")
    kinds = {
        "recording": recording_record(rows.dropDuplicates(["recording_id", "dataset_id"])),
        "exclusion": exclusion_row(rows.where(seconds == 2), F.lit("too_short")),
        "vocabulary": vocabulary_violations(window_record(rows.withColumns({
            "pool": F.when(seconds == 3, "spare").otherwise("core"), "status": F.when(seconds == 4, "lost").otherwise("audio_ready")}))),
    }
    counts = [df.groupBy("dataset_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "dataset_id", "n") for kind, df in kinds.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
