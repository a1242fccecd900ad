"""Column expressions and tables that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the blank and the control characters from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(whole(text), BLANKS), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def indices(n: Column) -> Column:
    """0 .. n-1 as an array, empty for n = 0 (sequence() would count downwards)."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def once(value: Column) -> Column:
    """The same value, computed in one place: a filter on it is not pushed below its projection.

    Spark pushes a filter down by copying the expressions that it reads, which multiplies chains of arrays; it leaves
    nondeterministic ones where they are.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 4


#: The fold that no model learns from.
HELD_OUT = 2
