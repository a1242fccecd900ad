"""Incremental jobs do not depend on arrival, tables are replaced whole, bad scores stop the job."""

import math

import pytest
from pyspark.sql import functions as F

from voicelake.operators import audit, joins, scores
from voicelake.plans import standins
from voicelake.plans.registry import QUERIES
from voicelake.session import work_path
from voicelake.sources import inventory, sinks
from voicelake.streaming import jobs


def landed(spark, rows, order):
    path = work_path(spark, "arrivals")
    for part in order:
        rows.where(F.col("k") % 5 == part).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [4, 2, 0, 3, 1]])
def test_no_row_is_lost_whatever_the_order(spark, order):
    """Lots arrive one run after the other; rows behind the watermark are kept beside the windows that have closed."""
    rows = spark.range(1000).select(
        F.col("id").alias("k"), (F.col("id") % 7 / 8).alias("score"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97 % 5000).alias("ts"))
    path, out, check = (work_path(spark, n) for n in ("arrivals", "o", "c"))
    for part in order:
        rows.where(F.col("k") % 5 == part).coalesce(1).write.mode("append").parquet(path)
        windows = jobs.event_windows(spark, path, rows.schema, "ts", "score", 4, out, check)
    end = spark.createDataFrame([(-1, 0.0)], "k long, score double").withColumn("ts", F.timestamp_seconds(F.lit(1_800_000_000)))
    end.coalesce(1).write.mode("append").parquet(path)
    windows = jobs.event_windows(spark, path, rows.schema, "ts", "score", 4, out, check)
    got = {r.start.timestamp(): (r.n + r.late, r.total + r.late_total) for r in windows.collect()}
    want = {}
    for r in rows.collect():
        at = r.ts.timestamp() // 4 * 4
        n, total = want.get(at, (0, 0.0))
        want[at] = (n + 1, total + r.score)
    assert got == want and windows.agg(F.sum("late")).first()[0] > 0 < windows.agg(F.sum("n")).first()[0]


def test_files_close_once_and_late_chunks_stand_aside(spark):
    path, out, check = (work_path(spark, n) for n in ("chunks", "o", "c"))
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)

    def arrive(rows):
        table = spark.createDataFrame(rows, "file_id long, chunk long, score double, s long").select("file_id", "chunk", "score", at(F.col("s")).alias("ts"))
        table.coalesce(1).write.mode("append").parquet(path)
        found = jobs.chunk_scores(spark, path, table.schema, 0.5, out, check, wait_seconds=10)
        return {r.file_id: (r.chunks, r.late, r.score, r.decision) for r in found.collect()}

    assert arrive([(1, 0, 0.25, 0), (1, 1, 0.5, 1), (2, 0, 1.0, 5)]) == {}  # both are open
    assert arrive([(1, 2, 0.75, 9), (2, 1, 0.0, 6)]) == {}  # the last chunk of a file keeps it open
    assert arrive([(3, 0, 1.0, 17)]) == {2: (2, 0, 0.5, "spoof")}
    assert arrive([(3, 1, 1.0, 18), (2, 2, 1.0, 7)]) == {2: (2, 1, 0.5, "spoof")}  # too late for file 2
    assert arrive([(4, 0, 0.0, 100)]) == {1: (3, 0, 0.5, "spoof"), 2: (2, 1, 0.5, "spoof"), 3: (2, 0, 1.0, "spoof")}


def test_accounts_of_sources_equal_a_walk(spark):
    from random import Random

    rng = Random(2)
    lots = [[(n * 100 + i, rng.choice("abc"), rng.choice([0, 1, 5, 40, 90])) for i in range(60)] for n in range(3)]
    path, out, check = (work_path(spark, n) for n in ("charges", "o", "c"))
    want, left = {}, dict.fromkeys("abc", 300)
    for lot in lots:
        rows = spark.createDataFrame(lot, "k long, source string, bytes long")
        rows.repartition(3).write.mode("append").parquet(path)
        charged = jobs.charge_accounts(spark, path, rows.schema, "source", "bytes", ["k"], 300, out, check)
        for k, source, size in lot:
            want[k] = size <= left[source]
            left[source] -= size if want[k] else 0
        assert {r.k: r.accepted for r in charged.collect()} == want
    assert len(set(want.values())) == 2


def test_failed_write_keeps_the_old_table(spark):
    path = work_path(spark, "table.json")
    good = spark.range(10)
    sinks.write_jsonl(good, path)
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_jsonl(broken, path)
    assert spark.read.json(path).count() == 10
    sinks.write_jsonl(spark.range(3), path)
    assert spark.read.json(path).count() == 3


@pytest.mark.parametrize("score,label", [(None, 0), (math.nan, 1), (math.inf, 1), (0.5, 2), (0.5, None)])
def test_bad_scores_stop_the_job(spark, score, label):
    rows = spark.createDataFrame([(0.25, 0), (0.75, 1), (score, label)], "score double, label int")
    for report in (scores.confusion_counts(rows, 0.5), scores.eer(rows), scores.det_curve(rows)):
        with pytest.raises(Exception, match="out of range"):
            report.collect()


def test_both_equal_error_rates_agree(spark):
    rows = spark.range(5000).select((F.xxhash64("id") % 1000 / 1000.0 + F.col("id") % 2 * 0.4).cast("float").alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    assert abs(scores.eer(rows).first()[0] - scores.eer_ascending(rows).first()["eer"]) < 1e-9


def walk(charges, left):
    """(size, accepted) of each charge, one after the other."""
    out = []
    for size in charges:
        out.append((size, size <= left))
        left -= size if size <= left else 0
    return out, left


@pytest.mark.parametrize("sizes,cap", [
    ([5, 100, 5, 3], 12), ([1, 100, 1, 99, 1, 98, 0, 40, 60, 7], 100), ([3, 0, 2], 0), ([4, 4], 8), ([(i * 7919) % 61 for i in range(120)], 700)])
def test_refused_charges_use_nothing(spark, sizes, cap):
    rows = spark.createDataFrame(list(enumerate(sizes)), "k long, bytes long").repartition(3)
    got = [(r.bytes, r.accepted) for r in audit.charge_ledger(rows, cap, ["k"]).orderBy("k").collect()]
    assert got == walk(sizes, cap)[0]


def test_negative_charges_stop_the_job(spark):
    with pytest.raises(Exception, match="zero or more"):
        audit.charge_ledger(spark.createDataFrame([(1, -5)], "k long, bytes long"), 10, ["k"]).collect()


def test_ledger_queries_equal_a_walk(spark):
    from voicelake.plans import catalog  # noqa: F401

    folder = "/root/testdata/sf0.001"
    rows = standins.ledger(spark, folder).orderBy("ts", "event_id").collect()
    lots = [[r for r in rows if r.event_id % 2 == k] for k in (0, 1)]
    for key, cap, parts in (("ledger_charges", 30_000_000, [rows]), ("st_ledger_charges", 10_100_000, lots)):
        want, left = {}, cap
        for part in parts:
            marks, left = walk([r.bytes for r in part], left)
            for r, (size, yes) in zip(part, marks):
                account = want.setdefault(r.source, [0, 0, 0, 0])
                account[0 if yes else 2] += size
                account[1 if yes else 3] += 1
        assert {r.source: [r.bytes, r.events, r.refused_bytes, r.refused] for r in QUERIES[key](spark, folder).collect()} == want


def test_stream_of_charges_refuses_and_goes_on(spark):
    path, out, check = (work_path(spark, n) for n in ("charges", "o", "c"))
    lots = [[(1, "a", 5), (2, "b", 100), (3, "b", 4)], [(4, "a", 9), (5, "b", 3), (6, "a", 1)]]
    for lot in lots:
        rows = spark.createDataFrame(lot, "k long, source string, bytes long")
        rows.coalesce(1).write.mode("append").parquet(path)
        accounts = jobs.charge_stream(spark, path, rows.schema, "source", "bytes", ["k"], 12, out, check)
    assert sorted(tuple(r) for r in accounts.select("source", "bytes", "events", "refused_bytes", "refused").collect()) == [("a", 5, 1, 10, 2), ("b", 7, 2, 100, 1)]


def test_promote_keeps_the_old_manifest_when_a_part_is_missing(spark):
    path = work_path(spark, "promoted")
    rows = spark.range(10).withColumn("part", F.col("id") % 3)
    sinks.promote(rows.where("id < 6"), rows, "part", path)
    with pytest.raises(ValueError, match="not staged: .2"):
        sinks.promote(rows.where("part <> 2"), rows, "part", path)
    assert spark.read.parquet(path).count() == 6
    sinks.promote(rows, rows, "part", path)
    assert spark.read.parquet(path).count() == 10


def test_cache_in_another_order_differs(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 3, 1), ("d", 4, 1)], "k string, place int, label int")
    cached = spark.createDataFrame([("x", 0, 1), ("a", 1, 1), ("d", 2, 1), ("c", 3, 2)], "k string, place int, label int")
    got = sorted(tuple(r) for r in joins.cache_difference(rows, cached, "k", ["label"], "place").collect())
    assert got == [("b", "missing"), ("c", "changed_label"), ("c", "changed_order"), ("d", "changed_order"), ("x", "extra")]


@pytest.mark.parametrize("key", ["build_record_kinds", "src_file_tree", "manifest_cache_order", "snk_promote_prune", "build_record"])
def test_whole_jobs_match_sql(spark, key):
    pytest.importorskip("duckdb")
    from __spark_entry__ import oracle_sql, queries
    from check import connect, rows_of

    folder = "/root/testdata/sf0.001"
    df, result = queries()[key](spark, folder), connect(folder).execute(oracle_sql()[key])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert want and rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def scanned(df):
    """(files, bytes, rows) that the scan of a collected plan read."""
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return [leaf.metrics().get(n).get().value() for n in ("numFiles", "filesSize", "numOutputRows")]


def test_row_fetch_reads_the_planned_files_and_row_groups_alone(spark):
    path = work_path(spark, "shards")
    rows = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("shard"), F.floor(F.col("id") / 600).alias("row_group"), "id", F.repeat(F.md5(F.col("id").cast("string")), 4).alias("payload"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("parquet.block.size", 64 * 1024)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        inventory.write_shards(rows, path, "shard", ["row_group", "id"])
        every = inventory.located(spark.read.parquet(path), ["row_group", "id"])
        plan = every.where("shard = '1' AND row_group IN (50, 51) AND id % 7 = 1")
        wanted = {r.id for r in plan.collect()}
        whole = every.select("id")
        whole.collect()
        read = inventory.planned_rows(spark, path, plan, ["id", "payload"], "row_group")
        read.collect()
        (all_files, all_bytes, all_rows), (files, size, seen) = scanned(whole), scanned(read)
        assert files < all_files and size < all_bytes / 2 and len(wanted) <= seen < 10_000 < all_rows == 60_000
        got = inventory.fetch_rows(read, plan, ["shard_path", "row_index"]).collect()
        assert len(got) == len(wanted) and {r.id for r in got} == wanted
        assert inventory.planned_rows(spark, path, plan.limit(0), ["id"], "row_group").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("parquet.block.size")
