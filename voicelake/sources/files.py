"""File sources: JSON lines, JSON documents, CSV manifests, protocol text, listings and id scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voicelake.functions.labels import protocol_label
from voicelake.operators.prefix import ranked

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict JSON lines: blank lines are skipped, a missing path is empty, a bad line fails the job."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def bad_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that are not an object of the schema, with the file they are in."""
    loose = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_name").alias("file"))
    parsed = F.from_json("value", loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.where(parsed[CORRUPT].isNotNull() | ~F.trim("value").startswith("{")).select("file", F.col("value").alias("line"))


def read_json_doc(spark: SparkSession, path: str, schema: T.StructType, default: DataFrame) -> DataFrame:
    """A whole-file JSON document, or the default when there is no file."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return default
        raise


def read_csv_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header whose names must match the schema and whose values must parse."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def union_glob(spark: SparkSession, pattern: str, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """All files of a pattern as one table without repeats, and the keys whose copies differ."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(pattern)
    distinct = rows.distinct()
    conflicts = distinct.groupBy(key).agg(F.count("*").alias("versions")).where("versions > 1")
    return distinct, conflicts


def read_protocol(lines: DataFrame) -> DataFrame:
    """Protocol lines `speaker utterance - attack key`; lines of another shape are skipped."""
    pattern = r"^(\S+)\s+(LA_[DTE]_[A-Z0-9]+)\s+(\S+)\s+(\S+)\s+(\S+)$"
    text = F.trim("value")
    part = lambda i: F.regexp_extract(text, pattern, i)
    return lines.where(text.rlike(pattern)).select(
        part(1).alias("speaker"), part(2).alias("utterance"), part(4).alias("attack"), F.lower(part(5)).alias("key"),
        protocol_label(part(5)).alias("label"))


def import_metadata(rows: DataFrame, required: Sequence[str], path_problem: Column) -> tuple[DataFrame, DataFrame]:
    """User metadata split into accepted rows and rows with the first problem named."""
    reason = F.lit(None).cast("string")
    for field in reversed(required):
        blank = F.coalesce(F.trim(F.col(field).cast("string")), F.lit("")) == ""
        reason = F.when(blank, F.lit(f"missing_{field}")).otherwise(reason)
    checked = rows.withColumn("reason", F.coalesce(reason, path_problem))
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def list_files(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """Files under a folder by extension, without reading their content."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return listing.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*extensions))


def read_payloads(spark: SparkSession, root: str, suffix: str, max_bytes: int | None = None, partitioned: bool = False) -> DataFrame:
    """(path, length, sha256) of the files under a folder with a suffix, and of no more than `max_bytes` if that is given.

    The names of other suffixes are dropped while listing, and the length is known before a file is read, so Spark
    hashes only what passes. With `partitioned`, folders named `column=value` give columns.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", not partitioned).load(root)
    kept = found if max_bytes is None else found.where(F.col("length") <= max_bytes)
    partitions = [c for c in found.columns if c not in ("path", "modificationTime", "length", "content")]
    return kept.select("path", "length", F.sha2("content", 256).alias("sha256"), *partitions)


def number_samples(listing: DataFrame, group: Sequence[str], path: str = "path", limit: int | None = None) -> DataFrame:
    """sample_id `group_000001` in path order inside each group; `limit` is the reader's optional per-group limit."""
    numbered = ranked(listing, group, [F.col(path)], "number")
    named = numbered.withColumn("sample_id", F.concat_ws("_", *[F.col(c) for c in group], F.format_string("%06d", F.col("number"))))
    return named if limit is None else named.where(F.col("number") <= limit)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def join_members(audio: DataFrame, metadata: DataFrame, path: str = "path") -> DataFrame:
    """Archive members: audio files joined to the metadata file of the same stem."""
    left = audio.withColumn("stem", stem(F.col(path)))
    right = metadata.withColumn("stem", stem(F.col(path))).drop(path)
    return left.join(right, "stem", "left")


def scan_ids(files: DataFrame, pattern: str) -> DataFrame:
    """Distinct (id, file) pairs for every match of a pattern in text lines."""
    return files.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("id"), "file").distinct()
