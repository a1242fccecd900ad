"""A training corpus from `documents`: quality rules, line dedup, near-duplicate removal, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's `docs`. All stages but the last return the columns of `documents`; `n_chars` follows a changed text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.llm import line_dedup, mixing, near_dedup, packing, quality
from voicelake.llm.common import n_words, whole, words_of
from voicelake.operators.prefix import null_safe
from voicelake.session import WorkScope, work_path, work_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_finished: list[WorkScope] = []


def _staged(stage: Stage) -> Stage:
    """Drop the work tables of the stage before: its result has been written when the next one starts."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _finished:
            _finished.pop().remove()
        with work_scope(spark) as scope:
            result = stage(spark, docs, sf_dir)
        _finished.append(scope)
        return result

    run_stage.__doc__ = stage.__doc__
    return run_stage


def _recounted(docs: DataFrame) -> DataFrame:
    """`n_chars` as the length of the text as it is now (unchanged for a null text)."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


@_staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the latest policy (null texts fail it)."""
    return quality.keep_good(docs)


@_staged
def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the line runs that stand earlier in the corpus; a text may become empty."""
    return _recounted(line_dedup.dedup_lines(docs))


@_staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id."""
    return near_dedup.keep_one(docs)


@_staged
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each use of a document: whole texts, and the words before the cut for the one where a budget ends.

    A document that the mix does not take has no row. Rows that repeat id, source and text are one document with as many
    uses. The words of a cut text are joined by blanks.
    """
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "source", "text", F.xxhash64(whole(F.col("text"))).alias("hash"))
    taken = mixing.mix(keyed, carry=("hash",)).groupBy("doc_id", "source", "hash").agg(F.sum("taken").alias("taken")).where("taken > 0")
    one = keyed.dropDuplicates(["doc_id", "source", "hash"])
    used = null_safe(one, taken, ["hash", "doc_id", "source"]).select("row", "text", "taken", n_words(F.col("text")).alias("size"))
    spread = used.select("row", "text", "taken", "size", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("use"))
    left = F.col("taken") - (F.col("use") - 1) * F.col("size")
    part = F.array_join(F.slice(words_of(F.col("text")), 1, left.cast("int")), " ")
    text = F.when(left < F.col("size"), part).otherwise(F.col("text"))
    return _recounted(spread.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]))


@_staged
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences."""
    return packing.pack(docs, special=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_copies),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("packing", sequences),
]

#: Near duplicates and packing have no SQL form; tests/llm checks each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
