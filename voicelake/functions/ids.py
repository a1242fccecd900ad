"""Identity parsing: file names, reference names, numeric identifiers, candidate and recording keys.

A missing or malformed identity is NULL. It is never replaced by a made-up key, and identifiers of different
namespaces are never merged: a scoped key always carries (namespace, language, id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The audio extensions that a recording name may carry.
EXTENSIONS = "m4a|wav|mp3|flac|ogg"

# Language codes and spellings, and the name each stands for.
LANGUAGES = {
    "bn": "bengali", "gu": "gujarati", "hi": "hindi", "kn": "kannada", "ml": "malayalam", "mr": "marathi", "or": "odia",
    "od": "odia", "pa": "punjabi", "sa": "sanskrit", "ta": "tamil", "te": "telugu", "ur": "urdu", "oriya": "odia",
}

# The names under which a speaker may be recorded, in order of preference.
SPEAKER_FIELDS = ("speaker", "speaker_id", "lecturer", "user_id", "artist", "voice")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once. Written out, an expression is computed anew wherever it stands, and a
    parsed name stands in a dozen places."""
    return F.transform(F.array(value), body)[0]


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(text, pattern, index)


def parse_fname(fname: Column) -> Column:
    """`<record>-<speaker>-<m|f>.<ext>` as struct(record_id, speaker, gender, extension), else NULL."""
    pattern = rf"^(\d+)-(\d+)-([mf])\.({EXTENSIONS})$"
    fields = ("record_id", "speaker", "gender", "extension")
    return F.when(fname.rlike(pattern), F.struct(*[_group(fname, pattern, i + 1).alias(f) for i, f in enumerate(fields)]))


def parse_reference(value: Column, extension_required: bool = False) -> Column:
    """A recording reference as struct(record, speaker, gender, canonical), else NULL.

    The directory is dropped (either slash), case is ignored and integers lose leading zeros (of any length, as text). The
    strict form wants an audio extension, the other accepts a name without one.
    """
    suffix = rf"\.({EXTENSIONS})" if extension_required else rf"(\.({EXTENSIONS}))?"
    pattern = rf"^(\d+)-(\d+)-([mf]){suffix}$"
    name = F.lower(F.regexp_extract(F.replace(value, F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1))
    plain = let(name, lambda n: F.when(n.rlike(pattern), F.regexp_replace(n, r"(?s)^0*(\d+)-0*(\d+)-([mf]).*", "$1-$2-$3")))
    part = lambda c, i, field: F.split_part(c, F.lit("-"), F.lit(i)).alias(field)
    return let(plain, lambda c: F.when(c.isNotNull(), F.struct(part(c, 1, "record"), part(c, 2, "speaker"), part(c, 3, "gender"), c.alias("canonical"))))


def numeric_id(value: Column) -> Column:
    """A non-negative integer in canonical text; NULL for fractions, negatives, NaN, infinities and other text."""
    text = F.trim(value.cast("string"))
    plain = F.regexp_extract(text, r"^\+?0*([0-9]*?)(?:\.0*)?$", 1)  # any number of digits
    scientific = text.try_cast("decimal(38,10)")
    number = F.when((scientific >= 0) & (scientific == F.floor(scientific)), F.floor(scientific).cast("string"))
    # nearly all are canonical as they are, which one pattern tells
    return F.when(text.rlike(r"^(?:0|[1-9][0-9]*)\z"), text).when(text.rlike(r"^\+?(?:[0-9]+\.?0*|\.0+)$"), F.when(plain == "", "0").otherwise(plain)).when(text.rlike("[eE]"), number).when(text.rlike(r"^-0*\.?0*$") & text.rlike("0"), "0")


def canonical_int(value: Column) -> Column:
    """An integral number in canonical text, negatives allowed; NULL otherwise."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    # nearly all are canonical as they are; a double holds 15 digits exactly
    return F.when(text.rlike(r"^(?:0|-?[1-9][0-9]{0,14})\z"), text).when(F.abs(number).isin(float("inf")) | F.isnan(number), None).when(
        number == F.floor(number), number.try_cast("decimal(38,0)").cast("string"))


def canonical_identifier(value: Column) -> Column:
    """The integer form of an integral number, the trimmed text of anything else, NULL for empty, NaN and infinity."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(number.isNull(), text)
        .when(F.isnan(number) | F.abs(number).isin(float("inf")), None)
        .when(number == F.floor(number), number.try_cast("decimal(38,0)").cast("string"))
        .otherwise(text)
    )


def canonical_digits(value: Column) -> Column:
    """A whole number of any length without leading zeros; NULL otherwise."""
    text = F.trim(value.cast("string"))
    found = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), F.when(found == "-0", "0").otherwise(found))


def canonical_recording(record: Column, speaker: Column, gender: Column) -> Column:
    """`record-speaker-gender` with plain integers, NULL when a number is missing."""
    whole = [canonical_digits(c) for c in (record, speaker)]
    return F.when(whole[0].isNotNull() & whole[1].isNotNull(), F.concat_ws("-", *whole, F.coalesce(gender, F.lit("None"))))


def candidate_id(kind: Column, language: Column, row_index: Column) -> Column:
    """`kind-language-000123`."""
    return F.format_string("%s-%s-%06d", kind, F.lower(language), row_index)


def lang_normalize(value: Column) -> Column:
    """The language name of a code or spelling: trimmed, lower case, NULL when empty."""
    text = F.nullif(F.lower(F.trim(value)), F.lit(""))
    aliases = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, text), text)


def parse_chunk_name(path: Column) -> Column:
    """`<record>_<code>_chunk_<n>.wav` as struct(record, speaker, chunk); absent parts fall back to the whole stem."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    parts = F.split(stem, "_")
    at = F.array_position(parts, "chunk")
    chunk = F.when(at > 0, F.coalesce(F.try_element_at(parts, (at + 1).cast("int")), F.lit(""))).otherwise("")
    return F.struct(F.element_at(parts, 1).alias("record"),
                    F.coalesce(F.try_element_at(parts, F.lit(2)), stem).alias("speaker"), chunk.alias("chunk"))


def parse_group_wav(name: Column) -> Column:
    """`CODE_speaker_Eng_g_utterance.wav` as struct(code, speaker, gender, utterance), else NULL."""
    pattern = r"^([A-Za-z]{3})_(\d+)_Eng_([mf])_(\d+)\.wav$"
    fields = ("code", "speaker", "gender", "utterance")
    return F.when(name.rlike(pattern), F.struct(*[_group(name, pattern, i + 1).alias(f) for i, f in enumerate(fields)]))


def canonical_speaker(token: Column) -> Column:
    """`A_B` of a token that has at least two non-empty parts."""
    parts = F.split(F.trim(token), "_")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return F.when((first != "") & (second != ""), F.concat_ws("_", first, second))


def first_present(*values: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def gender_of_reference(value: Column) -> Column:
    """m or f when it is the last dash-separated token of the file stem, else NULL."""
    name = F.lower(F.regexp_extract(F.replace(value, F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1))
    return F.nullif(F.regexp_extract(name, r"(^|-)([mf])(\.[^.]*)?$", 2), F.lit(""))


def scoped_key(kind: str, language: Column, value: Column) -> Column:
    """`kind:language:value`, NULL when the value is missing. Kinds: s speaker, r reference, j record."""
    return F.concat(F.lit(f"{kind}:"), F.coalesce(F.concat(language, F.lit(":")), F.lit("")), value)
