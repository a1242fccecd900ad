"""Whole-table audits, versions and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.functions.digests import signature
from voicelake.functions.ids import lang_normalize, numeric_id, parse_reference
from voicelake.operators.graph import poisoned_nodes, spanning_components
from voicelake.operators.identity import GENUINE_CORPUS, SYNTHETIC_CORPUS, problem_counts, row_keys, row_problems, side_keys, split_nodes
from voicelake.operators.joins import hash_dupes, recording_collision, shared_keys
from voicelake.operators.prefix import running
from voicelake.session import cut


def exposure_registry(manifest: DataFrame) -> DataFrame:
    """Everything a training run has seen, as distinct (kind, node): windows, identity keys and both audio hashes."""
    facts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("node")) for k, c in (
        ("window", "window_id"), ("prepared_sha256", "prepared_sha256"), ("original_sha256", "original_sha256"))]))
    plain = manifest.select(facts.alias("f")).select("f.kind", "f.node").where("node IS NOT NULL")
    return plain.unionByName(row_keys(manifest).select("kind", "node")).distinct()


def registry_references(registry: DataFrame) -> DataFrame:
    """(language, reference_key) of a node registry: canonical references and the record ids inside them."""
    parts = F.split("node", ":")
    refs = registry.where(F.col("node").startswith("r:")).select(F.element_at(parts, 2).alias("language"), F.element_at(parts, 3).alias("k"))
    return refs.select("language", F.explode(F.array("k", F.split_part("k", F.lit("-"), F.lit(1)))).alias("reference_key")).distinct()


def _issue(df: DataFrame, check: Column | str, item: Column | str, split: Column | str | None = None) -> DataFrame:
    """Rows of the long issue table: check, split, id."""
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    place = F.lit(None).cast("string") if split is None else (F.col(split) if isinstance(split, str) else split)
    return df.select(as_column(check).alias("check"), place.cast("string").alias("split"), (F.col(item) if isinstance(item, str) else item).cast("string").alias("id"))


def union_issues(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def audit_schema(manifest: DataFrame, languages: Sequence[str], version: str, revisions: dict[str, str]) -> DataFrame:
    """Structural checks per row: one array of failed names, unnested."""
    genuine, synthetic = F.col("dataset_id") == GENUINE_CORPUS, F.col("dataset_id") == SYNTHETIC_CORPUS
    expected = F.when(genuine, revisions[GENUINE_CORPUS]).otherwise(revisions[SYNTHETIC_CORPUS])
    tts = synthetic & (F.col("source_kind") == "tts_target_only")
    rules = {
        "label_vs_dataset": (genuine & (F.col("label") != 0)) | (synthetic & (F.col("label") != 1)),
        "language": ~lang_normalize(F.col("spoken_language")).isin(*languages), "preprocessing_version": ~F.col("preprocessing_version").eqNullSafe(version),
        "missing_generator": synthetic & (F.coalesce("generator", F.lit("")) == ""), "dataset_revision": ~F.col("revision").eqNullSafe(expected),
        "tts_source_not_null": tts & F.col("source_speaker").isNotNull(), "tts_verification_flag": tts & ~F.col("source_verification").eqNullSafe("not_applicable_tts"),
        "window_duration_bounds": ~F.coalesce(F.col("duration").between(1.0, 4.0), F.lit(False)), "window_sample_rate": ~F.col("sample_rate").eqNullSafe(16000),
        "channel_count": ~F.col("channels").eqNullSafe(1)}
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))
    return manifest.select("split", "window_id", F.explode_outer(failed).alias("check")).where("check IS NOT NULL").select("check", "split", F.col("window_id").alias("id"))


def audit_parents(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Parent verification and lookup evidence of synthetic rows; the first failed rule per role."""
    rows = manifest.where(F.col("dataset_id") == SYNTHETIC_CORPUS)
    evidence = lambda role: F.struct(F.lit(role).alias("role"), F.col(f"{role}_reference").alias("reference"), F.col(f"{role}_verification").alias("verification"),
                                     F.col(f"{role}_evidence").alias("method"), (F.col("target_evidence_record") if role == "target" else F.lit(None).cast("string")).alias("record"))
    claims = rows.select("window_id", "split", lang_normalize(F.col("spoken_language")).alias("language"), "evidence_verified", F.explode(F.array(evidence("source"), evidence("target"))).alias("e")).select("window_id", "split", "language", "evidence_verified", "e.*")
    parsed = claims.withColumn("p_record", parse_reference(F.col("reference"), extension_required=True)["record"])
    known = inventory.select("language", F.col("record_id").alias("p_record")).distinct().withColumn("__known", F.lit(True))
    joined = parsed.join(known, ["language", "p_record"], "left")
    absent = (F.col("role") == "source") & (F.col("verification") == "not_applicable_tts")
    check = (
        F.when(absent & F.col("method").eqNullSafe("not_applicable_tts"), None).when(absent, "parent_evidence_missing")
        .when(~F.col("verification").eqNullSafe("verified_train"), F.concat(F.lit("unverified_"), "role", F.lit("_parent")))
        .when(F.col("method").isNull(), "parent_evidence_missing").when(~F.coalesce("evidence_verified", F.lit(False)), "parent_evidence_incomplete")
        .when(F.col("p_record").isNotNull() & F.col("record").isNotNull() & (F.col("record") != F.col("p_record")), "parent_evidence_record_mismatch")
        .when(F.col("p_record").isNotNull() & F.col("__known").isNull(), "parent_record_not_in_scanned_inventories"))
    return joined.select(check.alias("check"), "split", F.concat_ws(":", "window_id", "role").alias("id")).where("check IS NOT NULL")


def audit_manifests(manifest: DataFrame, registry: DataFrame, registry_hashes: DataFrame, heldout: DataFrame, unverified: DataFrame,
                    closure_edges: DataFrame, closure_anchors: DataFrame, inventory: DataFrame, test: str = "test") -> DataFrame:
    """The cross-split integrity audit: every check is a query that returns its bad rows as (check, split, id).

    `registry` and `closure_anchors` hold nodes, `registry_hashes` digests, `heldout` nodes of kind j, `unverified`
    languages whose held-out list could not be read.
    """
    rows = manifest  # each check reads the few columns it needs
    keys = cut(row_keys(rows))
    test_keys = keys.where(F.col("split") == test)
    issues = []
    copies = rows.groupBy("split", "window_id").agg(F.count("*").alias("n")).where("n > 1")
    issues.append(_issue(copies, "duplicate_window_id", "window_id", "split"))
    issues.append(_issue(row_problems(rows), "provenance", F.concat_ws(":", "window_id", "problem"), "split"))
    pairs = shared_keys(keys)
    name = F.concat(F.col("split_a"), F.lit("_"), "role_a", F.lit("_vs_"), "split_b", F.lit("_"), "role_b")
    issues.append(_issue(pairs.where("kind IN ('s', 'r')").select(name.alias("pair")).distinct(), "cross_split_intersection", "pair"))
    issues.append(_issue(pairs.where("kind = 'j'").select(F.concat_ws("_vs_", "split_a", "split_b").alias("pair")).distinct(), "cross_split_record_overlap", "pair"))
    for kind in ("prepared", "original"):
        issues.append(_issue(hash_dupes(rows, f"{kind}_sha256").where("scope = 'cross_split'"), f"cross_split_{kind}_hash_duplicate", "digest"))
        seen = rows.where(F.col("split") == test).select(F.col(f"{kind}_sha256").alias("digest")).distinct().join(registry_hashes, "digest", "left_semi")
        issues.append(_issue(seen, "test_hash_in_prior_exposure", "digest", F.lit(test)))
    exposed = test_keys.select("kind", "role", "node").distinct().join(registry.select("node").distinct(), "node", "left_semi")
    issues.append(_issue(exposed.where("kind = 's'"), "test_speaker_in_prior_exposure", F.concat_ws(":", "role", "node"), F.lit(test)))
    issues.append(_issue(exposed.where("kind = 'r'"), "test_reference_in_prior_exposure", F.concat_ws(":", "role", "node"), F.lit(test)))
    held = test_keys.where("kind = 'j'").select("node").distinct().join(heldout.select("node").distinct(), "node", "left_semi")
    issues.append(_issue(held, "test_record_in_upstream_heldout", "node", F.lit(test)))
    issues.append(_issue(unverified, "heldout_unverified_languages", "language"))
    poison = poisoned_nodes(closure_edges, closure_anchors)
    touched = test_keys.select("window_id", "node").join(poison, "node", "left_semi").select("window_id").distinct()
    issues.append(_issue(touched, "test_closure_component_intersects_exposure", "window_id", F.lit(test)))
    issues.append(audit_parents(rows.where(F.col("split") == test), inventory))
    issues.append(_issue(recording_collision(rows, "recording_id"), "cross_split_same_recording", "recording_id"))
    spans = spanning_components(split_nodes(rows), "nodes", F.col("nodes"), "split")
    issues.append(_issue(spans, "cross_split_component", "component"))
    return union_issues(issues)


def audit_identity(manifest: DataFrame, left: str = "train", right: str = "val") -> DataFrame:
    """Two-split identity audit as (measure, value): key counts, shared keys per role pair, duplicates, unresolved rows."""
    rows = manifest.where(F.col("split").isin(left, right))
    keys = cut(side_keys(rows))
    count = lambda df, measure: df.select(measure.alias("measure"), F.lit(1).cast("bigint").alias("n"))
    known = keys.where("kind IN ('s', 'r')").select("split", "kind", "node").distinct()
    measures = count(known, F.concat_ws("_", F.lit("keys"), "split", "kind"))
    measures = measures.unionByName(problem_counts(rows).select(F.lit("unresolved_required").alias("measure"), "n"))
    measures = measures.unionByName(count(hash_dupes(rows, "prepared_sha256"), F.concat(F.lit("prepared_duplicates_"), "scope")))
    tallied = measures.groupBy("measure").agg(F.sum("n").alias("value"))
    shared = shared_keys(keys.where("kind IN ('s', 'r')")).select(F.concat_ws("_", F.lit("shared"), "kind", "split_a", "role_a", F.lit("vs"), "split_b", "role_b").alias("measure"), F.col("shared").alias("value"))
    return tallied.unionByName(shared)


def audit_coverage(additions: DataFrame, retained: DataFrame, benchmark: DataFrame, exposure: DataFrame, closure_edges: DataFrame, closure_anchors: DataFrame, revision: str, version: str) -> DataFrame:
    """Additions against the benchmark, the earlier exposure and the retained rows; structure of the additions themselves.

    `benchmark` and `exposure` are manifests.
    """
    own = cut(row_keys(additions))
    names = {"s": "speaker", "r": "reference", "j": "record"}
    kind_name = F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("kind")]
    issues = []
    for source, label in ((benchmark, "in_benchmark_exposure"), (exposure, "in_v1_prior_exposure"), (retained, "shared_with_retained_split")):
        seen = own.select("kind", "node").distinct().join(row_keys(source).select("node").distinct(), "node", "left_semi")
        issues.append(_issue(seen, F.concat(F.lit("addition_"), kind_name, F.lit(f"_{label}")), "node"))
    divided = own.where("kind = 's'").groupBy("node").agg(F.count_distinct("split").alias("n")).where("n > 1")
    issues.append(_issue(divided, "addition_speaker_shared_across_splits", "node"))
    hashed = additions.join(benchmark.select("prepared_sha256").distinct(), "prepared_sha256", "left_semi")
    issues.append(_issue(hashed, "addition_prepared_hash_in_benchmark", "window_id", "split"))
    p = parse_reference(F.col("source_file"), extension_required=True)
    male = F.coalesce((F.col("gender") == "m") & (p["gender"] == "m") & (numeric_id(F.col("speaker")) == p["speaker"]), F.lit(False))
    rules = {"addition_revision_mismatch": ~F.col("revision").eqNullSafe(revision), "addition_label_or_dataset_invalid": ~((F.col("label") == 0) & (F.col("dataset_id") == GENUINE_CORPUS)),
             "addition_gender_or_identity_not_documented_male": ~male, "addition_preprocessing_version": ~F.col("preprocessing_version").eqNullSafe(version)}
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), n) for n, c in rules.items()]))
    structure = additions.select("window_id", "split", F.explode_outer(failed).alias("c")).where("c IS NOT NULL")
    issues.append(_issue(structure, F.col("c"), "window_id", "split"))
    copies = additions.groupBy("window_id").agg(F.count("*").alias("n")).where("n > 1")
    issues.append(_issue(copies, "duplicate_window_id", "window_id"))
    poison = poisoned_nodes(closure_edges, closure_anchors)
    touched = own.select("window_id", "node").join(poison, "node", "left_semi").select("window_id").distinct()
    issues.append(_issue(touched, "addition_closure_component_intersects_exposure", "window_id"))
    return union_issues(issues)


def audit_files(manifest: DataFrame, stored: DataFrame, path: str, digest: str, seconds: Column, low: float, high: float) -> DataFrame:
    """Declared files against stored ones: missing path, missing file, digest mismatch, duration out of bounds."""
    actual = stored.select(path, F.col(digest).alias("__actual"), seconds.alias("__seconds"))
    joined = manifest.join(actual, path, "left")
    failed = F.array_compact(F.array(
        F.when(F.col(path).isNull(), "missing_prepared_path"), F.when(F.col(path).isNotNull() & F.col("__actual").isNull(), "prepared_path_missing"),
        F.when(F.col("__actual") != F.col(digest), "prepared_hash_mismatch"), F.when(~F.col("__seconds").between(low, high), "audio_duration")))
    return joined.select("window_id", F.explode_outer(failed).alias("check")).where("check IS NOT NULL")


def settings_diff(recorded: DataFrame, pinned: dict[str, str], by: str) -> DataFrame:
    """Settings as (by, key, value) rows that differ from the pinned ones, and the first difference of each record."""
    pins = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("pinned")) for k, v in pinned.items()]))
    wanted = recorded.select(by).distinct().select(by, pins.alias("p")).select(by, "p.key", "p.pinned")
    joined = recorded.join(wanted, [by, "key"], "full_outer").where(~F.col("value").eqNullSafe(F.col("pinned")))
    return joined.groupBy(by).agg(F.count("*").alias("differences"), F.min("key").alias("first"))


def audit_split_contract(manifest: DataFrame, declared: DataFrame, text: Column) -> DataFrame:
    """Declared digests and counts of the splits against the rows; also splits that are not declared."""
    actual = signature(manifest, text, ["split"])
    d = declared.select("split", F.col("rows").alias("declared_rows"), F.col("signature").alias("declared_signature"))
    joined = actual.join(d, "split", "full_outer")
    return joined.select("split", (F.col("rows").eqNullSafe(F.col("declared_rows"))).alias("count_ok"), (F.col("signature").eqNullSafe(F.col("declared_signature"))).alias("digest_ok"))


def dedupe_exclusions(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first exclusion of every (id, reason)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("b")).select(*key, *[F.col(f"b.{c}").alias(c) for c in rest])


def audit_payloads(manifest: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """Every declared file (`bytes`, `sha256`) and every stored one (`length`, `sha256`) with its status.

    ok, missing (declared only), unlisted (stored only), size_mismatch, or hash_mismatch for the right size with other
    content. A file that is stored twice under one key comes out twice.
    """
    stored = payloads.select(key, "length", F.col("sha256").alias("actual"))
    joined = manifest.select(key, "bytes", "sha256").join(stored, key, "full")
    status = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("bytes") != F.col("length"), "size_mismatch")
        .when(F.col("sha256") != F.col("actual"), "hash_mismatch").otherwise("ok")
    )
    return joined.select(key, "length", status.alias("status"))


def assemble_pools(windows: DataFrame, excluded: DataFrame, files: DataFrame, key: str, digest: str, path: str) -> DataFrame:
    """Every window with its disposition: excluded, missing file, duplicate of an earlier window, or assembled.

    Excluded recordings that succeeded are pruned from the exclusions first.
    """
    live = excluded.join(windows.where("materialized").select("recording_id").distinct(), "recording_id", "left_anti").select("recording_id").distinct().withColumn("__out", F.lit(True))
    present = files.select(path).distinct().withColumn("__file", F.lit(True))
    marked = windows.join(live, "recording_id", "left").join(present, path, "left")
    usable = F.col("__out").isNull() & F.col("__file").isNotNull()
    first = marked.where(usable).groupBy(digest).agg(F.min(key).alias("__first"))
    joined = marked.join(first, digest, "left")
    outcome = F.when(F.col("__out").isNotNull(), "excluded").when(F.col("__file").isNull(), "missing_file").when(F.col(key) != F.col("__first"), "exact_duplicate").otherwise("assembled")
    return joined.withColumn("disposition", outcome).drop("__out", "__file", "__first")


def ledger_rollup(df: DataFrame, cap: int) -> DataFrame:
    """Totals per source, and how many charges come after the cap would be passed. The running total is over all sources."""
    total = running(df, [], [F.col("ts"), F.col("event_id")], total=F.col("bytes"))
    return total.groupBy("source").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("events"), F.count_if(F.col("total") > cap).alias("beyond_cap"),
                                       F.min(F.when(F.col("total") > cap, F.struct("total", "event_id")))["event_id"].alias("first_refused"))


def charge_ledger(df: DataFrame, cap: int, order: Sequence[str], size: str = "bytes") -> DataFrame:
    """Every charge with `accepted`: one that exceeds what is left of the cap is refused and not added, later ones that fit are.

    The same as a walk in `order`, which must be total, in at most log2(cap) + 1 rounds. With r left, all charges of r / 2
    or less are accepted until they have used half of r. Before that a larger charge is accepted if it fits into r less
    the small ones before it. The first such charge, or the small one that uses the half, ends the round; what is left is
    then r / 2 at most. A charge that is negative or null stops the job.
    """
    checked = F.when(F.col(size) >= 0, F.col(size)).otherwise(F.raise_error(F.lit("a charge must be zero or more")).cast("bigint"))
    rest, left, parts = cut(df.withColumn("__size", checked)), cap, []
    while True:
        total = rest.agg(F.sum(F.col("__size").cast("decimal(38,0)"))).first()[0]
        if total is None or total <= left or left <= 0:
            parts.append(rest.withColumn("accepted", F.col("__size") <= max(left, 0)))
            break
        parts.append(rest.where(F.col("__size") > left).withColumn("accepted", F.lit(False)))
        small, at = 2 * F.col("__size") <= left, F.col("__at")
        walked = cut(running(rest.where(F.col("__size") <= left), [], [F.col(c) for c in order], __at=F.lit(1).cast("bigint"), __used=F.when(small, F.col("__size").cast("decimal(38,0)")).otherwise(0)))
        upto = F.col("__used") + F.when(small, 0).otherwise(F.col("__size"))
        ends = F.when(small, 2 * upto >= left).otherwise(upto <= left)
        end = walked.where(ends).agg(F.min(at).alias("at"), F.min_by(upto, at).alias("used")).first()
        done = walked if end["at"] is None else walked.where(at <= end["at"])
        parts.append(done.withColumn("accepted", small | (upto <= left)).drop("__used", "__at"))
        if end["at"] is None:
            break
        rest = walked.where(at > end["at"]).drop("__used", "__at")
        left -= int(end["used"])
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.drop("__size")


def ledger_accounts(charged: DataFrame, source: str = "source", size: str = "bytes") -> DataFrame:
    """Accepted and refused charges of each source, kept apart."""
    yes = F.col("accepted")
    return charged.groupBy(source).agg(
        F.coalesce(F.sum(F.when(yes, F.col(size))), F.lit(0)).cast("bigint").alias("bytes"), F.count_if(yes).alias("events"),
        F.coalesce(F.sum(F.when(~yes, F.col(size))), F.lit(0)).cast("bigint").alias("refused_bytes"), F.count_if(~yes).alias("refused"))
