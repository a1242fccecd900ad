"""Identity keys of manifest rows: who speaks, which recording, which record, and what is wrong with the claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.functions.ids import lang_normalize, let, numeric_id, parse_reference, scoped_key

GENUINE_CORPUS = "kathbath"
SYNTHETIC_CORPUS = "indicsynth"


def raw_claims(manifest: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per window and role with the claim `c` as it is written."""
    claim = lambda role, ref, declared, verification: F.struct(
        F.lit(role).alias("role"), ref.alias("reference"), declared.alias("declared"), verification.alias("verification"))
    none = F.lit(None).cast("string")
    roles = F.when(F.col("dataset_id") == GENUINE_CORPUS, F.array(claim("genuine", F.col("source_file"), F.col("speaker"), none))).when(
        F.col("dataset_id") == SYNTHETIC_CORPUS,
        F.array(claim("source", F.col("source_reference"), F.col("source_speaker"), F.col("source_verification")),
                claim("target", F.col("target_reference"), F.col("target_speaker"), F.col("target_verification"))),
    ).otherwise(F.array(claim("unsupported", none, none, none)))
    return manifest.select(*keep, lang_normalize(F.col("spoken_language")).alias("language"), F.explode(roles).alias("c"))


def role_claims(manifest: DataFrame, keep: tuple[str, ...] = ("window_id", "split", "dataset_id", "label")) -> DataFrame:
    """One row per window and role (genuine, or source and target) with the parsed reference and the declared speaker.

    A row-local explode: nothing moves. A text-to-speech row without a source claims no source.
    """
    rows = raw_claims(manifest, keep)
    parsed = parse_reference(F.col("c.reference"), extension_required=True)
    return rows.select(*keep, "language", "c.role", "c.reference", numeric_id(F.col("c.declared")).alias("declared"), "c.verification", parsed.alias("p"))


def claim_problem() -> Column:
    """What is wrong with a claim, NULL when nothing is."""
    named = lambda text: F.concat("role", F.lit(text))
    absent = (F.col("role") == "source") & F.col("verification").eqNullSafe(F.lit("not_applicable_tts"))
    return (
        F.when(F.col("role") == "unsupported", "unsupported_namespace")
        .when(F.col("p").isNull() & absent, None)
        .when(F.col("p").isNull(), named("_reference_unparseable"))
        .when(F.col("declared").isNull(), named("_speaker_missing"))
        .when(F.col("declared") != F.col("p.speaker"), named("_speaker_disagrees"))
    )


def row_problems(manifest: DataFrame) -> DataFrame:
    return role_claims(manifest).withColumn("problem", claim_problem()).where("problem IS NOT NULL").select("window_id", "split", "problem")


def row_keys(manifest: DataFrame) -> DataFrame:
    """Long identity keys: (window, split, role, kind s/r/j, node). Unparsed claims give none."""
    keys = role_claims(manifest).select("window_id", "split", "role", "language", F.explode_outer(_keys()).alias("k"))
    return keys.where("k IS NOT NULL").select("window_id", "split", "role", "language", "k.*")


def _keys() -> Column:
    """The keys of a parsed claim. Unnested with the outer form: a filter on the claim would parse it a second time."""
    return F.when(F.col("p").isNotNull(), F.array(*[F.struct(F.lit(k).alias("kind"), scoped_key(k, F.col("language"), F.col(f"p.{f}")).alias("node"))
                     for k, f in (("s", "speaker"), ("r", "canonical"), ("j", "record"))]))


def side_keys(manifest: DataFrame) -> DataFrame:
    """The sides of identity keys: (split, role, language, kind, node). Each distinct reference of a side is parsed once."""
    written = raw_claims(manifest, ("split",)).select("split", "language", "c.role", "c.reference").distinct()
    parsed = written.select("split", "role", "language", parse_reference(F.col("reference"), extension_required=True).alias("p"))
    return parsed.select("split", "role", "language", F.explode_outer(_keys()).alias("k")).where("k IS NOT NULL").select("split", "role", "language", "k.*")


def problem_counts(manifest: DataFrame) -> DataFrame:
    """How many claims have each problem of `row_problems`: (split, problem, n). Claims that are written alike are judged once."""
    claims = raw_claims(manifest, ("split",)).select("split", "c.*")
    written = claims.groupBy(*claims.columns).agg(F.count("*").alias("n"))
    parsed = parse_reference(F.col("reference"), extension_required=True)
    judged = written.select("split", "role", "verification", "n", numeric_id(F.col("declared")).alias("declared"), parsed.alias("p"))
    return judged.withColumn("problem", claim_problem()).where("problem IS NOT NULL").groupBy("split", "problem").agg(F.sum("n").alias("n"))


def window_nodes(manifest: DataFrame) -> Column:
    """All identity nodes of a manifest row as one array expression: the row's keys in a relationship graph."""
    refs = F.array(*[parse_reference(F.col(c), extension_required=True) for c in ("source_file", "source_reference", "target_reference")])
    keys = lambda n, r: F.array(*[scoped_key(k, n, r[f]) for k, f in (("s", "speaker"), ("r", "canonical"), ("j", "record"))])
    language = lang_normalize(F.col("spoken_language"))
    return let(language, lambda n: F.array_distinct(F.array_compact(F.flatten(F.transform(refs, lambda r: keys(n, r))))))


def split_nodes(manifest: DataFrame) -> DataFrame:
    """(split, nodes): what the windows of a split claim, each combination of references once, parsed after it is distinct."""
    written = manifest.select("split", "spoken_language", "source_file", "source_reference", "target_reference").distinct()
    return written.select("split", window_nodes(written).alias("nodes"))


def candidate_nodes(language: Column, speaker: Column, record: Column, gender: Column) -> Column:
    """Nodes of an inventory recording: speaker, record and the reference they form."""
    s, j = numeric_id(speaker), numeric_id(record)
    ref = F.when(s.isNotNull() & j.isNotNull() & gender.isin("m", "f"), F.concat_ws("-", j, s, gender))
    return F.array_compact(F.array(scoped_key("s", language, s), scoped_key("j", language, j), scoped_key("r", language, ref)))


def side_nodes(language: Column, declared: Column, recorded: Column, reference: Column) -> Column:
    """Nodes of one side of a synthetic candidate: declared and recorded speaker, and the parsed reference's keys."""
    clean = lambda c: numeric_id(F.when(~F.trim(c).isin("", "None"), c))
    return let(parse_reference(reference), lambda p: F.array_distinct(F.array_compact(F.array(
        scoped_key("s", language, clean(declared)), scoped_key("s", language, clean(recorded)), scoped_key("s", language, p["speaker"]),
        scoped_key("r", language, p["canonical"]), scoped_key("j", language, p["record"])))))


def _inventory_keys() -> Column:
    """Record, speaker and reference of an inventory row: the record is the middle of the star."""
    j = scoped_key("j", F.col("language"), numeric_id(F.col("record_id")))
    s = scoped_key("s", F.col("language"), numeric_id(F.col("speaker")))
    r = scoped_key("r", F.col("language"), parse_reference(F.col("fname"))["canonical"])
    return F.array(j, s, r)


def closure_edges(manifest: DataFrame, inventory: DataFrame, cross_sides: bool = False) -> DataFrame:
    """Edges of the admissible relationships: star edges per side of a synthetic row, record-speaker and record-reference
    per inventory row. `cross_sides` also joins the two sides of a row (the strict diagnostic).

    The rows of `closure_claims` without who claims them. Claims repeat, so distinct ones are parsed, as they are written.
    """
    from voicelake.operators.graph import star_edges

    synthetic = manifest.where(F.col("dataset_id") == SYNTHETIC_CORPUS)
    named, none = synthetic.withColumn("language", lang_normalize(F.col("spoken_language"))), F.lit(None).cast("string")
    side = lambda role: F.struct(F.col(f"{role}_speaker").alias("declared"), F.col(f"{role}_reference").alias("reference"))
    nodes = lambda c: side_nodes(F.col("language"), F.col(f"{c}.declared"), none, F.col(f"{c}.reference"))
    if cross_sides:
        written = named.select("language", side("source").alias("x"), side("target").alias("y")).distinct()
        keys = F.concat(nodes("x"), nodes("y"))
    else:
        written = named.select("language", F.explode(F.array(side("source"), side("target"))).alias("x")).distinct()
        keys = nodes("x")
    listed = inventory.select("language", "record_id", "speaker", "fname").distinct()
    return star_edges(written, keys).unionByName(star_edges(listed, _inventory_keys())).distinct()


def closure_stars(manifest: DataFrame, inventory: DataFrame, cross_sides: bool = False) -> DataFrame:
    """The edges of `closure_edges` as the rows claim them, again and again: a search for components joins them where they are read."""
    from voicelake.operators.graph import star_edges

    synthetic = manifest.where(F.col("dataset_id") == SYNTHETIC_CORPUS)
    named, none = synthetic.withColumn("language", lang_normalize(F.col("spoken_language"))), F.lit(None).cast("string")
    nodes = lambda declared, reference: side_nodes(F.col("language"), declared, none, reference)
    if cross_sides:
        keys = F.concat(*[nodes(F.col(f"{r}_speaker"), F.col(f"{r}_reference")) for r in ("source", "target")])
    else:
        side = lambda r: F.struct(F.col(f"{r}_speaker").alias("declared"), F.col(f"{r}_reference").alias("reference"))
        named = named.select("language", F.explode(F.array(side("source"), side("target"))).alias("x"))
        keys = nodes(F.col("x.declared"), F.col("x.reference"))
    return star_edges(named, keys).unionByName(star_edges(inventory, _inventory_keys()))


def closure_claims(manifest: DataFrame, inventory: DataFrame, cross_sides: bool = False) -> DataFrame:
    """The same edges, each once with the smallest of its claims: (a, b, side, row, generator).

    `side` is source, target, cross (both sides of a row joined) or inventory; `row` is the window or the inventory row.
    Claims that are written alike are parsed once, for the smallest row among them.
    """
    from voicelake.operators.graph import star_edges

    synthetic = manifest.where(F.col("dataset_id") == SYNTHETIC_CORPUS)
    named, none = synthetic.withColumn("language", lang_normalize(F.col("spoken_language"))), F.lit(None).cast("string")
    side = lambda role: F.struct(F.col(f"{role}_speaker").alias("declared"), F.col(f"{role}_reference").alias("reference"))
    nodes = lambda c: side_nodes(F.col("language"), F.col(f"{c}.declared"), none, F.col(f"{c}.reference"))
    first = F.min(F.struct("row", "generator")).alias("first")
    each = named.withColumnRenamed("window_id", "row")
    if cross_sides:
        written = each.groupBy("language", side("source").alias("x"), side("target").alias("y")).agg(first).withColumn("side", F.lit("cross"))
        keys = F.concat(nodes("x"), nodes("y"))
    else:
        sides = F.explode(F.array(*[F.struct(F.lit(r).alias("side"), side(r).alias("x")) for r in ("source", "target")]))
        written = each.select("language", "row", "generator", sides.alias("s")).groupBy("language", "s.side", "s.x").agg(first)
        keys = nodes("x")
    listed = inventory.groupBy("language", "record_id", "speaker", "fname").agg(F.min(F.struct(F.col("row_key").alias("row"), none.alias("generator"))).alias("first"))
    edges = star_edges(written, keys, ("side", "first")).unionByName(star_edges(listed.withColumn("side", F.lit("inventory")), _inventory_keys(), ("side", "first")))
    claims = edges.groupBy("a", "b").agg(F.min(F.struct("side", "first.row", "first.generator")).alias("c"))
    return claims.select("a", "b", "c.side", "c.row", "c.generator")
