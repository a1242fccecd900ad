"""Parquet shard inventories: positions, counts, chosen-row fetches, sizes, strata samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.functions.ids import parse_fname
from voicelake.operators.prefix import null_safe

# Fixed value: bytes added to a read estimate for the footer and the request.
REQUEST_SLACK = 65536


def shard_inventory(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Metadata columns of parquet shards with each row's position; only those columns are read."""
    return spark.read.parquet(path).select(
        *columns, F.col("_metadata.file_name").alias("shard_file"), F.col("_metadata.row_index").alias("row_index"))


def parsed_inventory(rows: DataFrame, fname: str = "fname") -> DataFrame:
    """Rows whose file name parses, with its parts."""
    return rows.withColumn("__p", parse_fname(F.col(fname))).where("__p IS NOT NULL").select(
        "*", F.col("__p.record_id").alias("parsed_record"), F.col("__p.speaker").alias("parsed_speaker"), F.col("__p.gender").alias("parsed_gender")).drop("__p")


def shard_counts(rows: DataFrame, shard: Sequence[str], fname: str = "fname") -> DataFrame:
    """Rows, parsed rows and the difference per shard."""
    parsed = parse_fname(F.col(fname)).isNotNull()
    return rows.groupBy(*shard).agg(F.count("*").alias("rows"), F.count_if(parsed).alias("parsed"), F.count_if(~parsed).alias("unparsed"))


def write_shards(rows: DataFrame, path: str, shard: str, position: Sequence[str]) -> None:
    """Parquet files in one folder per shard, sorted by `position`: a file, and a row group in it, holds one range.

    Ranges are cut by sampled quantiles, so a large shard becomes many files.
    """
    order = [F.col(shard), *[F.col(c) for c in position]]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(shard).parquet(path)


def planned_rows(spark: SparkSession, path: str, plan: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    """`columns` of the shards' files that a plan needs, with each row's place in its file.

    `plan` has (shard_path, `position`). Its files, one name each, are listed on the driver, as Spark's own file index
    lists all of them; other files are not opened. Inside a file the reader skips row groups outside the least and
    greatest planned position.
    """
    files = plan.groupBy("shard_path").agg(F.min(position).alias("low"), F.max(position).alias("high")).collect()
    if not files:
        return located(spark.read.parquet(path), columns).limit(0)
    read = spark.read.option("basePath", path).parquet(*sorted(f["shard_path"] for f in files))
    span = F.col(position).between(min(f["low"] for f in files), max(f["high"] for f in files))
    return located(read.where(span), columns)


def located(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`columns` of a parquet table with the file and the place in it of each row."""
    return rows.select(*columns, F.col("_metadata.file_path").alias("shard_path"), F.col("_metadata.row_index").alias("row_index"))


def fetch_rows(payloads: DataFrame, chosen: DataFrame, position: Sequence[str]) -> DataFrame:
    """The payload rows at chosen positions: a semi-join, broadcast by Spark only when the choice is measured small."""
    return payloads.join(chosen.select(*position).distinct(), list(position), "left_semi")


def group_sizes(rows: DataFrame, size: Column, group: Sequence[str] = ("shard", "row_group")) -> DataFrame:
    return rows.groupBy(*group).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))


def bytes_estimate(rows: DataFrame, sizes: DataFrame, by: Sequence[str], group: Sequence[str] = ("shard", "row_group")) -> DataFrame:
    """Bytes of the distinct row groups each `by` needs plus slack; NULL as soon as one size is unknown."""
    needed = rows.select(*by, *group).distinct()
    joined = needed.join(sizes.select(*group, "size"), list(group), "left")
    total = F.when(F.count("*") == F.count("size"), F.sum("size") + REQUEST_SLACK)
    return joined.groupBy(*by).agg(total.cast("bigint").alias("estimate"))


def remaining_shards(listed: DataFrame, scanned: DataFrame, key: str, pin: str) -> DataFrame:
    """Listed shards of the pinned revision that were not scanned; a listing of another revision fails the job."""
    pinned = F.when(F.col("revision") == pin, F.col("revision")).otherwise(
        F.raise_error(F.concat(F.lit("listing revision differs from the pin: "), F.coalesce("revision", F.lit("none")))))
    return listed.withColumn("revision", pinned).join(scanned.select(key).distinct(), key, "left_anti")


def strata_sample(rows: DataFrame, index: str, total: Column, strata: int, page: int, seed: str) -> DataFrame:
    """One page of consecutive rows at a hashed offset inside each of `strata` equal ranges of the row index.

    The strata are ranges of the index, so this is a filter: nothing moves.
    """
    width = F.greatest(F.ceil(total / strata), F.lit(1))
    stratum = F.floor(F.col(index) / width)
    room = F.greatest(width - page + 1, F.lit(1))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), stratum.cast("bigint").cast("string"))), 1, 15), 16, 10).cast("bigint")
    start = stratum * width + draw % room
    return rows.withColumn("stratum", stratum.cast("bigint")).where((F.col(index) >= start) & (F.col(index) < start + page)).dropDuplicates([index])


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def attach_sizes(rows: DataFrame, sizes: DataFrame, group: Sequence[str] = ("shard", "row_group")) -> DataFrame:
    return null_safe(rows, sizes.select(*group, F.col("bytes").alias("group_bytes")), list(group), "left")
