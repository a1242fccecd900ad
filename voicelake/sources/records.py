"""The fixed shapes of window, recording, exclusion and gap rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.functions.labels import label_name

# The pools a window can belong to and the statuses a record can have.
POOLS = ("core", "supplementary", "external_eval", "fallback_baseline", "unpaired_candidate", "missing_coverage", "excluded")
STATUSES = ("audio_ready", "features_ready", "unpaired_candidate", "access_required", "requires_large_download", "missing_source", "excluded")


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column when the input has it, else NULL of the right type: the schema never depends on the input."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def _common(df: DataFrame) -> list[Column]:
    text = lambda n: _optional(df, n).alias(n)
    return [
        text("recording_id"), text("dataset_id"), text("source_url"), text("source_file"), text("original_split"),
        _optional(df, "label", "int").alias("label"), label_name(_optional(df, "label", "int")).alias("label_name"),
        text("spoken_language"), text("native_language"),
        F.struct(text("speaker"), text("gender"), _optional(df, "source_speaker").alias("source"), _optional(df, "target_speaker").alias("target")).alias("speaker_ids"),
        text("generator"), text("generator_version"),
        F.struct(text("source_reference"), text("target_reference"), text("source_kind"),
                 _optional(df, "source_verification").alias("source_parent_verification"),
                 _optional(df, "target_verification").alias("target_parent_verification"),
                 _optional(df, "revision").alias("dataset_revision")).alias("parent_refs"),
        F.struct(_optional(df, "original_sha256").alias("sha256"), _optional(df, "sample_rate", "int").alias("sample_rate")).alias("original_audio"),
        text("license"), text("notes"),
    ]


def window_record(df: DataFrame) -> DataFrame:
    """One selected window per row, nested, with every field of the schema."""
    text = lambda n: _optional(df, n).alias(n)
    return df.select(
        text("window_id"), *_common(df), text("pool"), text("split"), text("label_source"),
        F.struct(_optional(df, "prepared_sha256").alias("sha256"), _optional(df, "channels", "int").alias("channels"),
                 _optional(df, "prepared_path").alias("path")).alias("prepared_audio"),
        F.struct(_optional(df, "duration", "double").alias("duration_seconds"), _optional(df, "sample_rate", "int").alias("sample_rate")).alias("window"),
        text("preprocessing_version"), text("access_status"), text("status"), text("exclusion_reason"),
    )


def recording_record(df: DataFrame) -> DataFrame:
    """One source recording per row."""
    return df.select(*_common(df), F.struct(_optional(df, "decoded_sha256").alias("sha256")).alias("decoded"))


def exclusion_row(df: DataFrame, reason: Column) -> DataFrame:
    """An itemized exclusion: nothing is dropped silently."""
    return df.select("recording_id", _optional(df, "dataset_id").alias("dataset_id"), _optional(df, "source_file").alias("source_file"),
                     reason.alias("reason"), F.lit("excluded").alias("status"))


def vocabulary_violations(df: DataFrame) -> DataFrame:
    """Rows whose pool or status is not in the vocabulary."""
    return df.where(~F.col("pool").isin(*POOLS) | ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(True)))
