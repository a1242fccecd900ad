"""Keys that many rows share, or lack, and windows that hold few rows each."""

from pyspark.sql import functions as F

from voicelake.operators import joins


def test_flag_deals_rows_without_a_key(spark):
    """Rows without a key have no match and are spread over the tasks of the join, not put into one."""
    df = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    keys = spark.createDataFrame([("k0",), ("k100",), (None,)], "k string")
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = joins.flag(df, keys, "k", "hit")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        hits = sorted(r["id"] for r in out.where("hit").collect())
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert out.columns == ["k", "id", "hit"] and sum(sizes) == 4000 and max(sizes) < 2000
    assert hits == [0, 100]


def test_event_windows_share_keys(spark, tmp_path):
    """Ten thousand windows of one row each are a few keys, not one each; late rows stay beside them."""
    from voicelake.streaming import jobs

    rows = spark.range(10_000).select(F.timestamp_seconds(1_700_000_000 + 4 * F.col("id")).alias("ts"), F.lit(1.5).alias("value"))
    path, out, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    rows.write.parquet(path)
    run = lambda: jobs.event_windows(spark, path, rows.schema, "ts", "value", 4, out, check)
    run()
    spark.range(1).select(F.timestamp_seconds(F.lit(1_700_400_000)).alias("ts"), F.lit(0.0).alias("value")).write.mode("append").parquet(path)
    run()
    rows.limit(3).write.mode("append").parquet(path)
    got = run().orderBy("start").collect()
    assert len(got) == 10_000 and all((r["n"], r["total"]) == (1, 1.5) for r in got)
    assert sum(r["late"] for r in got) == 3 and sum(r["late_total"] for r in got) == 4.5


def test_order_changes_keep_one_table_of_both_sides(spark):
    """Places are compared without joining ranks: three tables are written, and the keys with another place come out."""
    from voicelake.session import work_scope

    left = spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "z"), ("c", "c"), ("d", None), ("only", "only"), (None, "n")], "k string, at string")
    right = spark.createDataFrame([("a", "a"), ("b", "~b"), ("c", "c"), ("d", "d"), ("else", "else"), (None, "n")], "k string, at string")
    with work_scope(spark) as scope:
        found = joins.order_changes(left, right, "k", "at")
        # left: d (no place), a, b, c; right: a, c, d, b
        assert sorted(r["k"] for r in found.collect()) == ["a", "b", "c", "d"]
        assert len(scope.paths) == 3
    same = joins.order_changes(left, left, "k", "at")
    assert same.count() == 0
