"""Registered queries for incremental jobs and fitted models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.operators import models
from voicelake.operators.audit import ledger_accounts
from voicelake.plans import standins as st
from voicelake.plans.registry import query, table
from voicelake.session import work_path
from voicelake.streaming import jobs


def _landed(spark: SparkSession, rows: DataFrame) -> tuple[str, str, str]:
    """Rows as files that arrive, and fresh folders for output and checkpoint."""
    path = work_path(spark, "in")
    rows.repartition(4).write.parquet(path)
    return path, work_path(spark, "out"), work_path(spark, "checkpoint")


def _in_lots(run: Callable[[], DataFrame], path: str, *lots: DataFrame) -> DataFrame:
    """Run a job, and again after each further lot has arrived."""
    result = run()
    for lot in lots:
        lot.coalesce(1).write.mode("append").parquet(path)
        result = run()
    return result


@query("st_incremental_scan", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st_incremental_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over files that arrive in two lots; nothing is read twice."""
    events = table(spark, folder, "events")
    path, out, checkpoint = _landed(spark, events.where("event_type <> 'click'"))
    jobs.incremental_scan(spark, path, events.schema, out, checkpoint)
    events.where("event_type = 'click'").write.mode("append").parquet(path)
    jobs.incremental_scan(spark, path, events.schema, out, checkpoint)
    return spark.read.schema(events.schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("st_resume_dedupe", "SELECT count(DISTINCT text) AS stored FROM documents")
def st_resume_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    path, out, checkpoint = _landed(spark, rows)
    jobs.resume_dedupe(spark, path, rows.schema, "digest", out, checkpoint)
    return spark.read.parquet(out).agg(F.count("*").alias("stored"))


@query("st_ledger_totals", f"WITH {st.LEDGER} SELECT source, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS events, sum(bytes) > 10100000 AS over_cap FROM ledger GROUP BY source")
def st_ledger_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.ledger(spark, folder)
    path, out, checkpoint = _landed(spark, rows)
    jobs.ledger_totals(spark, path, rows.schema, "source", "bytes", 10_100_000, out, checkpoint)
    return spark.read.parquet(out)


CAP = 1_500_000


@query("st_ledger", f"""WITH {st.LEDGER}, l AS (SELECT source, list({{'bytes': bytes, 'n': 1::BIGINT}} ORDER BY event_id % 2, ts, event_id) AS charges, sum(bytes) AS asked, count(*) AS n FROM ledger GROUP BY source),
w AS (SELECT source, asked, n, list_reduce(list_prepend({{'bytes': 0::BIGINT, 'n': 0::BIGINT}}, charges), lambda spent, x: CASE WHEN spent.bytes + x.bytes <= {CAP} THEN {{'bytes': spent.bytes + x.bytes, 'n': spent.n + 1}} ELSE spent END) AS a FROM l)
SELECT source, a.bytes AS bytes, a.n AS events, CAST(asked - a.bytes AS BIGINT) AS refused_bytes, n - a.n AS refused FROM w""")
def st_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Two lots of charges under a cap for each source; a refused charge uses nothing of it."""
    rows = st.ledger(spark, folder)
    path, out, checkpoint = _landed(spark, rows.where("event_id % 2 = 0"))
    charge = lambda: jobs.charge_accounts(spark, path, rows.schema, "source", "bytes", ["ts", "event_id"], CAP, out, checkpoint)
    charge()
    rows.where("event_id % 2 = 1").write.mode("append").parquet(path)
    return ledger_accounts(charge())


@query("st_ledger_charges")
def st_ledger_charges(spark: SparkSession, folder: str) -> DataFrame:
    """Two lots of charges under one cap: what the first lot has accepted is gone for the second one."""
    rows = st.ledger(spark, folder)
    path, out, checkpoint = _landed(spark, rows.where("event_id % 2 = 0"))
    jobs.charge_stream(spark, path, rows.schema, "source", "bytes", ["ts", "event_id"], 10_100_000, out, checkpoint)
    rows.where("event_id % 2 = 1").write.mode("append").parquet(path)
    return jobs.charge_stream(spark, path, rows.schema, "source", "bytes", ["ts", "event_id"], 10_100_000, out, checkpoint)


@query("st_chunk_score", f"""WITH {st.CHUNKS} SELECT file_id, make_timestamp((1700000000 + file_id * 3600 + min(chunk)) * 1000000) AS start, round(avg(score) FILTER (chunk % 7 <> 3), 6) AS score,
  round(max(score) FILTER (chunk % 7 <> 3), 6) AS max_score, count(*) FILTER (chunk % 7 <> 3) AS chunks, count(*) FILTER (chunk % 7 = 3) AS late,
  CASE WHEN round(avg(score) FILTER (chunk % 7 <> 3), 6) >= 0.5 THEN 'spoof' ELSE 'genuine' END AS decision FROM chunks GROUP BY file_id""")
def st_chunk_score(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks a second apart per file; the lot after closes the last file, and every seventh chunk comes after that."""
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("file_id") * 3600 + F.col("chunk"))
    rows = st.chunks(spark, folder).withColumn("ts", start)
    path, out, checkpoint = _landed(spark, rows.where("chunk % 7 <> 3"))
    end = rows.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("file_id"), F.lit(0).cast("bigint").alias("chunk"), F.lit("end").alias("role"), F.lit(0.0).alias("score"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    files = _in_lots(lambda: jobs.chunk_scores(spark, path, rows.schema, 0.5, out, checkpoint), path, end, rows.where("chunk % 7 = 3"))
    return files.withColumns({"score": F.round("score", 6), "max_score": F.round("max_score", 6)})


@query("st_event_windows", """SELECT make_timestamp(epoch_us(ts::TIMESTAMP) // 4000000 * 4000000) AS start, count(*) FILTER (event_id % 10 <> 3) AS n, round(coalesce(sum(value) FILTER (event_id % 10 <> 3), 0), 4) AS total,
  count(*) FILTER (event_id % 10 = 3) AS late, round(coalesce(sum(value) FILTER (event_id % 10 = 3), 0), 4) AS late_total FROM events GROUP BY start""")
def st_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of four seconds; a tenth of the events comes after all windows have closed and is kept beside them."""
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path, out, checkpoint = _landed(spark, rows.where("event_id % 10 <> 3"))
    last = rows.agg(F.max("ts")).first()[0]
    end = rows.limit(1).withColumn("ts", F.lit(last) + F.expr("INTERVAL 1 HOUR"))
    windows = _in_lots(lambda: jobs.event_windows(spark, path, rows.schema, "ts", "value", 4, out, checkpoint), path, end, rows.where("event_id % 10 = 3"))
    return windows.withColumns({"total": F.round("total", 4), "late_total": F.round("late_total", 4)})


@query("linear_baseline")
def linear_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Standardized vectors, L2 logistic regression, margins; fitted on four fifths by hash, reported for both parts."""
    rows = st.frames(spark, folder).select("frame", "label", "vec", F.when(F.pmod(F.xxhash64("frame"), F.lit(5)) == 0, "held_out").otherwise("train").alias("part"))
    scored = models.score(models.fit(rows.where("part = 'train'"), "vec", "label"), rows, "vec")
    parts = [models.evaluate(scored.where(F.col("part") == p)).withColumn("part", F.lit(p)) for p in ("train", "held_out")]
    return parts[0].unionByName(parts[1])


def release_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Frames in files of five, with a language (a fifth has none), a part, and every eleventh frame unusable."""
    rows = st.frames(spark, folder).withColumn("file_id", F.floor(F.col("frame") / 5))
    f = F.col("file_id")
    language = F.when(f % 5 == 0, "hi").when(f % 5 == 1, "bn").when(f % 5 == 2, "ta").when(f % 5 == 3, "odia")
    part = F.when((F.pmod(F.xxhash64("file_id"), F.lit(5)) > 1) & (f % 5 < 3), "train").otherwise("new")
    return rows.select("file_id", "frame", "label", "vec", language.alias("language"), part.alias("part"), ((F.col("frame") % 11 != 0) & (f % 17 != 4)).alias("usable"))


@query("batch_score_files")
def batch_score_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files the model has not seen, scored under a release that was fitted on the training files alone."""
    rows = release_rows(spark, folder)
    contract = models.release(rows.where("part = 'train' AND usable"), "vec", "label", "language", 0.5, 4)
    return models.score_files(contract, rows.where("part = 'new'"), "vec", "usable", "language")
