"""Sinks: JSON lines, logs, CSV, payload stores, partitioned manifests, merges, feature bundles, small report tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_table(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write a table beside the old one and switch when it is complete; a failed write leaves the old table as it was."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(staged)
        if files.exists(hadoop(path)):
            files.rename(hadoop(path), hadoop(old))
        if not files.rename(hadoop(staged), hadoop(path)):
            raise OSError(f"cannot move {staged} to {path}")
    finally:
        files.delete(hadoop(staged), True)
    files.delete(hadoop(old), True)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace a JSON-lines table, fields in sorted order and NULL fields kept."""
    rows = df.select(*sorted(df.columns)).write.option("ignoreNullFields", "false")
    replace_table(df.sparkSession, path, rows.json)


def append_log(df: DataFrame, path: str) -> None:
    """Append run-log rows; the commit protocol makes each append all or nothing."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    replace_table(df.sparkSession, path, df.write.option("header", True).csv)


def store_payloads(spark: SparkSession, new: DataFrame, path: str, hash_column: str = "sha256") -> DataFrame:
    """Store each payload once: payloads whose hash is stored already, or repeats within the batch, are left out.

    Returns what was added. The added rows are written first and read back, so the answer does not rerun the anti-join
    against a store that has changed.
    """
    batch = new.dropDuplicates([hash_column])
    try:
        batch = batch.join(spark.read.parquet(path).select(hash_column), hash_column, "left_anti")
    except Exception as error:  # noqa: BLE001
        if getattr(error, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
            raise
    staged = f"{path}.batch"
    batch.write.mode("overwrite").parquet(staged)
    added = spark.read.parquet(staged)
    added.write.mode("append").parquet(path)
    return added


def write_pools(df: DataFrame, path: str, by: Sequence[str] = ("pool", "split")) -> None:
    """One folder per pool and split, so that readers prune to the manifest they want."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions that occur in `df` and keep the others (dynamic partition overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def incomplete_parts(expected: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Parts that must be staged before a swap and are not there."""
    return expected.select(key).distinct().join(staged.select(key).distinct(), key, "left_anti")


def orphans(stored: DataFrame, manifests: DataFrame, key: str) -> DataFrame:
    """Stored files that no manifest references."""
    return stored.join(manifests.select(key).distinct(), key, "left_anti")


def promote(staged: DataFrame, expected: DataFrame, key: str, path: str) -> None:
    """Stage a manifest, check that every expected part is there, and swap; a missing part leaves the old manifest."""

    def write(place: str) -> None:
        staged.write.parquet(place)
        missing = [r[0] for r in incomplete_parts(expected, staged.sparkSession.read.schema(staged.schema).parquet(place), key).limit(5).collect()]
        if missing:
            raise ValueError(f"parts that are not staged: {missing}")

    replace_table(staged.sparkSession, path, write)


def write_feature_bundle(frames: DataFrame, path: str, identity: DataFrame) -> None:
    """Frame vectors, one row per (window, frame), with a one-row identity table beside them."""
    frames.write.mode("overwrite").parquet(f"{path}/frames")
    identity.write.mode("overwrite").json(f"{path}/identity")


def markdown_rows(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A grouped report as Markdown lines (header, rule, rows), built as rows so nothing is collected."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    bar = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    body = df.select(F.lit(2).alias("part"), *order, bar([cell(c) for c in df.columns]).alias("line"))
    head = df.sparkSession.range(2).select(
        F.col("id").cast("int").alias("part"), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order],
        F.when(F.col("id") == 0, bar([F.lit(c) for c in df.columns])).otherwise(bar([F.lit("---") for _ in df.columns])).alias("line"))
    return head.unionByName(body).orderBy("part", *order).select("line")
