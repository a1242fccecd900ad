"""Labels, candidates' kinds and statuses, routing, names and record shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generators whose output is converted speech (has a source voice) and text-to-speech (has none).
CONVERSION_GENERATORS = ("freevc24",)
SPEECH_GENERATORS = ("xtts_v2", "vits")

# Language codes that the Indic encoder serves.
INDIC_CODES = ("as", "bn", "gu", "hi", "kn", "ml", "mr", "ne", "or", "pa", "sa", "si", "ta", "te", "ur")

# File suffixes kept from a URL.
MEDIA_SUFFIXES = (".wav", ".flac", ".mp3", ".ogg", ".m4a")


def label_valid(text: Column) -> Column:
    """The label 0 or 1 of a text value; NULL for booleans, fractions, other numbers and other text."""
    number = F.trim(text).try_cast("double")
    return F.when(number.isin(0.0, 1.0), number.cast("int"))


def label_name(label: Column) -> Column:
    return F.when(label == 0, "genuine").when(label == 1, "spoof").otherwise("unknown")


def protocol_label(key: Column) -> Column:
    lowered = F.lower(key)
    return F.when(lowered.startswith("bonafide") | lowered.startswith("bona-fide"), 0).otherwise(1)


def media_extension(kind: Column, url: Column) -> Column:
    """The file extension of a media type, or of the URL path, or .wav."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    suffix = F.lower(F.regexp_extract(F.regexp_extract(url, r"^([^?]*)", 1), r"(\.[^./]*)$", 1))
    return (
        F.when(k.contains("flac"), ".flac").when(k.contains("mpeg") | k.contains("mp3"), ".mp3").when(k.contains("wav"), ".wav")
        .when(suffix.isin(*MEDIA_SUFFIXES), suffix).otherwise(".wav")
    )


def source_kind(generator: Column, source_reference: Column) -> Column:
    """conversion_source, declared_source or tts_target_only."""
    return (
        F.when(source_reference.isNull(), "tts_target_only")
        .when(generator.isin(*CONVERSION_GENERATORS), "conversion_source").otherwise("declared_source")
    )


def parent_status(kind: Column, found: Column) -> Column:
    """verified_train when the parent is in an inventory, parsed_only when not, not_applicable_tts without a source."""
    return F.when(kind == "tts_target_only", "not_applicable_tts").when(found, "verified_train").otherwise("parsed_only")


def reason_prefix(reason: Column) -> Column:
    return F.trim(F.split_part(reason, F.lit(":"), F.lit(1)))


def route_language(language: Column, served: Sequence[str] = INDIC_CODES) -> tuple[Column, Column]:
    """The encoder route of a language tag (its region is ignored) and the reason for it."""
    code = F.split_part(F.lower(F.trim(F.coalesce(language, F.lit("")))), F.lit("-"), F.lit(1))
    known = code.isin(*served)
    return F.when(known, "indic").otherwise("global_fallback"), F.when(known, "configured_language").otherwise("missing_or_other_language")


def safe_path(path: Column) -> Column:
    """NULL for a safe relative path, else what is wrong with it: empty, absolute or escaping."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "empty").when(path.rlike(r"^([/\\]|[A-Za-z]:)"), "absolute")
        .when(F.array_contains(parts, ".."), "escapes_base")
    )


def fmt_bytes(value: Column) -> Column:
    """Bytes in the largest binary unit that fits, two decimals rounded half to even, `unknown` for NULL."""
    text = F.format_string("%.2f B", value.cast("double"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        size = float(1024**power)
        text = F.when(value >= size, F.format_string(f"%.2f {unit}", F.bround(value / F.lit(size), 2))).otherwise(text)
    return F.when(value.isNull(), "unknown").otherwise(text)
