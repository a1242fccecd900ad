"""Speech-corpus views over the driver's tables, each as a DataFrame and as the same text in SQL.

The driver's tables hold no speech, so every operator runs on these whole-table views:

manifest   one row per `lineitem` row: a genuine recording window or a synthetic one with its parents
inventory  one row per `lineitem` row: an upstream recording with its position in a shard
scores     `labels` joined to `documents`: a label, a group, a generator and a score with many ties
signal     one row per document: its characters as samples of a waveform
frames     `embeddings`: one vector per frame, the label names the window
chunks     `conversations`: one scored chunk per turn of a file
ledger     `events`: one download of some bytes from a source
fnames     `orders`: file names, some of them broken on purpose
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.operators.blocks import Points
from voicelake.plans.registry import table

MANIFEST = """manifest AS (
SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS window_id,
  CASE WHEN l_linestatus = 'F' THEN 'kathbath' ELSE 'indicsynth' END AS dataset_id,
  CASE l_returnflag WHEN 'A' THEN 'Bengali' WHEN 'N' THEN 'hi' ELSE ' Tamil ' END AS spoken_language,
  CASE l_returnflag WHEN 'A' THEN 'bengali' WHEN 'N' THEN 'hindi' ELSE 'tamil' END AS language,
  CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS label,
  CASE WHEN l_linestatus = 'F' THEN NULL WHEN l_linenumber = 1 THEN 'freevc24'
       WHEN l_linenumber <= 4 THEN 'xtts_v2' ELSE 'vits' END AS generator,
  CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'val' ELSE 'test' END AS split,
  concat('rec-', l_orderkey) AS recording_id,
  CASE WHEN l_linestatus = 'F' THEN
    CASE WHEN l_quantity = 50 THEN 'unnamed.m4a' ELSE concat(l_orderkey, '-', (l_orderkey - l_orderkey % 3), '-',
      CASE WHEN l_orderkey % 6 < 3 THEN 'm' ELSE 'f' END, '.m4a') END END AS source_file,
  CASE WHEN l_linestatus = 'F' THEN CAST(l_orderkey - l_orderkey % 3 + CASE WHEN l_quantity = 13 THEN 1 ELSE 0 END AS VARCHAR) END AS speaker,
  CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_orderkey % 6 < 3 THEN 'm' ELSE 'f' END END AS gender,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN CAST((l_orderkey - l_orderkey % 30 + l_partkey % 30) - l_partkey % 30 % 3 AS VARCHAR) END AS source_speaker,
  CASE WHEN l_linestatus = 'O' THEN CAST(l_orderkey - l_orderkey % 3 + CASE WHEN l_quantity = 13 THEN 1 ELSE 0 END AS VARCHAR) END AS target_speaker,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN concat(l_orderkey - l_orderkey % 30 + l_partkey % 30, '-',
      (l_orderkey - l_orderkey % 30 + l_partkey % 30) - l_partkey % 30 % 3, '-m.wav') END AS source_reference,
  CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_quantity = 50 THEN NULL ELSE concat('clips/', l_orderkey, '-',
      (l_orderkey - l_orderkey % 3), '-', CASE WHEN l_orderkey % 6 < 3 THEN 'm' ELSE 'f' END, '.wav') END END AS target_reference,
  CASE WHEN l_linestatus = 'F' THEN NULL WHEN l_linenumber = 1 THEN 'conversion_source' ELSE 'tts_target_only' END AS source_kind,
  CASE WHEN l_linestatus = 'F' THEN NULL WHEN l_linenumber <> 1 THEN 'not_applicable_tts'
       WHEN l_discount = 0.09 THEN 'parsed_only' ELSE 'verified_train' END AS source_verification,
  CASE WHEN l_linestatus = 'F' THEN NULL WHEN l_discount = 0.09 THEN 'parsed_only' ELSE 'verified_train' END AS target_verification,
  CASE WHEN l_linestatus = 'F' OR l_tax = 0.01 THEN NULL WHEN l_linenumber <> 1 THEN 'not_applicable_tts'
       ELSE 'scanned_inventory' END AS source_evidence,
  CASE WHEN l_linestatus = 'F' OR l_tax = 0.02 THEN NULL ELSE 'full_train_shard_scan' END AS target_evidence,
  CASE WHEN l_linestatus = 'O' THEN CAST(CASE WHEN l_tax = 0.03 THEN l_orderkey + 1 ELSE l_orderkey END AS VARCHAR) END AS target_evidence_record,
  (l_tax <> 0.04) AS evidence_verified,
  sha256(concat(l_partkey, ':', l_suppkey)) AS prepared_sha256,
  sha256(concat(l_partkey, ':', l_suppkey, ':', l_linenumber)) AS original_sha256,
  l_quantity / 10 AS duration,
  CASE WHEN l_tax = 0.08 THEN 8000 ELSE 16000 END AS sample_rate,
  CASE WHEN l_discount = 0.1 THEN 2 ELSE 1 END AS channels,
  CASE WHEN l_tax = 0.07 THEN 'rev-0' WHEN l_linestatus = 'F' THEN 'rev-g' ELSE 'rev-s' END AS revision,
  CASE WHEN l_tax = 0.06 THEN 'prep-1' ELSE 'prep-2' END AS preprocessing_version,
  CASE WHEN l_discount = 0 THEN NULL ELSE 1 - l_discount END AS active_fraction
FROM lineitem)"""

INVENTORY = """inventory AS (
SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key,
  CASE l_returnflag WHEN 'A' THEN 'bengali' WHEN 'N' THEN 'hindi' ELSE 'tamil' END AS language,
  CAST(l_orderkey AS VARCHAR) AS record_id,
  CAST(l_orderkey - l_orderkey % 3 AS VARCHAR) AS speaker,
  CASE WHEN l_orderkey % 6 < 3 THEN 'm' ELSE 'f' END AS gender,
  concat(l_orderkey, '-', (l_orderkey - l_orderkey % 3 + CASE WHEN l_quantity = 13 THEN 1 ELSE 0 END), '-',
    CASE WHEN l_orderkey % 6 < 3 THEN 'm' ELSE 'f' END, CASE WHEN l_quantity = 50 THEN '.txt' ELSE '.m4a' END) AS fname,
  CASE WHEN l_quantity = 7 THEN CAST(l_orderkey AS VARCHAR) WHEN l_quantity = 8 THEN 'None' ELSE CAST(l_orderkey - l_orderkey % 3 AS VARCHAR) END AS upstream_speaker,
  concat('shard-', lpad(CAST(l_suppkey % 16 AS VARCHAR), 5, '0')) AS shard,
  CAST(l_partkey % 100 AS INTEGER) AS row_group,
  l_quantity AS duration,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes
FROM lineitem)"""

SCORES = """scores AS (
SELECT d.doc_id AS window_id, l.quality AS label, d.lang AS language, d.source AS generator,
  concat(d.lang, ':', l.toxic) AS cohort,
  CAST(CAST((d.doc_id * 7919) % 997 AS DOUBLE) / 996.0 * 0.7 + 0.3 * l.quality AS FLOAT) AS score
FROM labels l JOIN documents d USING (doc_id))"""

SIGNAL = """signal AS (
SELECT doc_id AS id, lang, source,
  list_transform(string_split(text, ''), lambda c: (unicode(c) % 256 - 128) / 128.0::DOUBLE) AS samples
FROM documents)"""

FRAMES = """frames AS (
SELECT label AS window_id, vec_id AS frame, embedding AS vec, CAST(label % 2 AS INTEGER) AS label
FROM embeddings)"""

CHUNKS = """chunks AS (
SELECT conv_id AS file_id, turn AS chunk, role,
  CAST(('0x' || substr(md5(text), 1, 4)) AS INTEGER) / 65535.0::DOUBLE AS score
FROM conversations)"""

LEDGER = """ledger AS (
SELECT event_id, ts, event_type AS source, CAST(round(value * 100) AS BIGINT) AS bytes FROM events)"""

FNAMES = """fnames AS (
SELECT o_orderkey AS id, CASE o_orderkey % 7
  WHEN 0 THEN concat(o_orderkey, '-', o_custkey, '.m4a')
  WHEN 1 THEN concat('0', o_orderkey, '-00', o_custkey, '-F.WAV')
  WHEN 2 THEN concat('data\\audio\\', o_orderkey, '-', o_custkey, '-m.flac')
  WHEN 3 THEN concat('a/b/', o_orderkey, '-', o_custkey, '-f.ogg')
  ELSE concat(o_orderkey, '-', o_custkey, '-', CASE WHEN o_custkey % 2 = 0 THEN 'f' ELSE 'm' END, '.m4a') END AS fname
FROM orders)"""


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    order, part, supp, line = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    genuine = F.col("l_linestatus") == "F"
    synthetic = F.col("l_linestatus") == "O"
    converted = synthetic & (line == 1)
    owner = order - order % 3
    slip = F.when(F.col("l_quantity") == 13, 1).otherwise(0)
    gender = F.when(order % 6 < 3, "m").otherwise("f")
    donor = order - order % 30 + part % 30
    donor_owner = donor - part % 30 % 3
    tax, discount, quantity = F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", order, part, supp, line).alias("window_id"),
        F.when(genuine, "kathbath").otherwise("indicsynth").alias("dataset_id"),
        F.when(flag == "A", "Bengali").when(flag == "N", "hi").otherwise(" Tamil ").alias("spoken_language"),
        F.when(flag == "A", "bengali").when(flag == "N", "hindi").otherwise("tamil").alias("language"),
        F.when(genuine, 0).otherwise(1).alias("label"),
        F.when(genuine, None).when(line == 1, "freevc24").when(line <= 4, "xtts_v2").otherwise("vits").alias("generator"),
        F.when(order % 10 < 7, "train").when(order % 10 < 9, "val").otherwise("test").alias("split"),
        F.concat(F.lit("rec-"), order).alias("recording_id"),
        F.when(genuine, F.when(quantity == 50, "unnamed.m4a").otherwise(
            F.concat(order, F.lit("-"), owner, F.lit("-"), gender, F.lit(".m4a")))).alias("source_file"),
        F.when(genuine, (owner + slip).cast("string")).alias("speaker"),
        F.when(genuine, gender).alias("gender"),
        F.when(converted, donor_owner.cast("string")).alias("source_speaker"),
        F.when(synthetic, (owner + slip).cast("string")).alias("target_speaker"),
        F.when(converted, F.concat(donor, F.lit("-"), donor_owner, F.lit("-m.wav"))).alias("source_reference"),
        F.when(synthetic & (quantity != 50), F.concat(F.lit("clips/"), order, F.lit("-"), owner, F.lit("-"), gender, F.lit(".wav"))).alias("target_reference"),
        F.when(converted, "conversion_source").when(synthetic, "tts_target_only").alias("source_kind"),
        F.when(genuine, None).when(line != 1, "not_applicable_tts").when(discount == 0.09, "parsed_only")
        .otherwise("verified_train").alias("source_verification"),
        F.when(genuine, None).when(discount == 0.09, "parsed_only").otherwise("verified_train").alias("target_verification"),
        F.when(genuine | (tax == 0.01), None).when(line != 1, "not_applicable_tts").otherwise("scanned_inventory").alias("source_evidence"),
        F.when(genuine | (tax == 0.02), None).otherwise("full_train_shard_scan").alias("target_evidence"),
        F.when(synthetic, F.when(tax == 0.03, order + 1).otherwise(order).cast("string")).alias("target_evidence_record"),
        (tax != 0.04).alias("evidence_verified"),
        F.sha2(F.concat(part, F.lit(":"), supp), 256).alias("prepared_sha256"),
        F.sha2(F.concat(part, F.lit(":"), supp, F.lit(":"), line), 256).alias("original_sha256"),
        (quantity / 10).alias("duration"),
        F.when(tax == 0.08, 8000).otherwise(16000).alias("sample_rate"),
        F.when(discount == 0.1, 2).otherwise(1).alias("channels"),
        F.when(tax == 0.07, "rev-0").when(genuine, "rev-g").otherwise("rev-s").alias("revision"),
        F.when(tax == 0.06, "prep-1").otherwise("prep-2").alias("preprocessing_version"),
        F.when(discount == 0, None).otherwise(1 - discount).alias("active_fraction"),
    )


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    order, part, quantity = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity")
    owner = order - order % 3
    gender = F.when(order % 6 < 3, "m").otherwise("f")
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", order, part, "l_suppkey", "l_linenumber").alias("row_key"),
        F.when(flag == "A", "bengali").when(flag == "N", "hindi").otherwise("tamil").alias("language"),
        order.cast("string").alias("record_id"),
        owner.cast("string").alias("speaker"),
        gender.alias("gender"),
        F.concat(order, F.lit("-"), owner + F.when(quantity == 13, 1).otherwise(0), F.lit("-"), gender,
                 F.when(quantity == 50, ".txt").otherwise(".m4a")).alias("fname"),
        F.when(quantity == 7, order.cast("string")).when(quantity == 8, "None").otherwise(owner.cast("string")).alias("upstream_speaker"),
        F.concat(F.lit("shard-"), F.lpad((F.col("l_suppkey") % 16).cast("string"), 5, "0")).alias("shard"),
        (part % 100).cast("int").alias("row_group"),
        quantity.alias("duration"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("bytes"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    value = ((F.col("doc_id") * 7919) % 997).cast("double") / 996.0 * 0.7 + 0.3 * F.col("quality")
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return table(spark, folder, "labels").join(documents, "doc_id").select(
        F.col("doc_id").alias("window_id"), F.col("quality").alias("label"), F.col("lang").alias("language"),
        F.col("source").alias("generator"), F.concat("lang", F.lit(":"), "toxic").alias("cohort"),
        value.cast("float").alias("score"),
    )


def signal(spark: SparkSession, folder: str) -> DataFrame:
    samples = F.transform(F.split("text", ""), lambda c: (F.ascii(c) % 256 - 128) / F.lit(128.0))
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "source", samples.alias("samples"))


def samples_of(first: Column, count: Column, scale: float = 128.0, text: Column | None = None) -> Points:
    """`count` samples of the waveform of a document from `first` on: code points modulo 256, around zero, over `scale`."""
    part = (F.col("text") if text is None else text).substr((first + 1).cast("int"), count.cast("int"))
    return Points([part], lambda t: (np.frombuffer((t or "").encode("utf-32-le"), np.uint32) % 256 - 128.0) / scale)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("label").alias("window_id"), F.col("vec_id").alias("frame"), F.col("embedding").alias("vec"),
        (F.col("label") % 2).cast("int").alias("label"),
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    score = F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("int") / F.lit(65535.0)
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("chunk"), "role", score.alias("score")
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "ts", F.col("event_type").alias("source"), F.round(F.col("value") * 100).cast("bigint").alias("bytes")
    )


def fnames(spark: SparkSession, folder: str) -> DataFrame:
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    turn = order % 7
    name = (
        F.when(turn == 0, F.concat(order, F.lit("-"), customer, F.lit(".m4a")))
        .when(turn == 1, F.concat(F.lit("0"), order, F.lit("-00"), customer, F.lit("-F.WAV")))
        .when(turn == 2, F.concat(F.lit("data\\audio\\"), order, F.lit("-"), customer, F.lit("-m.flac")))
        .when(turn == 3, F.concat(F.lit("a/b/"), order, F.lit("-"), customer, F.lit("-f.ogg")))
        .otherwise(F.concat(order, F.lit("-"), customer, F.lit("-"), F.when(customer % 2 == 0, "f").otherwise("m"), F.lit(".m4a")))
    )
    return table(spark, folder, "orders").select(order.alias("id"), name.alias("fname"))
