"""Lineage, exposure and integrity joins.

Row tables are never joined on a key with themselves: shared keys are found by grouping distinct keys, and rules are one
ordered CASE over left-join flags, so the first matching reason wins as in a sequential filter. Right-hand sides are
made distinct per key first; Spark broadcasts them when their measured size allows and AQE splits hot keys otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.functions.ids import canonical_int, let, parse_fname, parse_reference
from voicelake.functions.labels import CONVERSION_GENERATORS, SPEECH_GENERATORS
from voicelake.operators.prefix import first_k, null_safe, ranked, running
from voicelake.session import cut


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, NULL when none does. An unknown outcome counts as not holding."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        reason = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(reason)
    return reason


def looked_up(df: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join on keys that `right` holds once, or not at all.

    A row without a key has no match. Rows that share the missing key would all be one task's, so they are dealt by a
    number from the whole row; a row with a key is dealt by its key.
    """
    on = [on] if isinstance(on, str) else list(on)
    missing = F.coalesce(*[F.when(F.col(c).isNull(), True) for c in on], F.lit(False))
    dealt = df.withColumn("__deal", F.when(missing, F.xxhash64(*df.columns)).otherwise(F.xxhash64(*on)))
    return dealt.join(right.withColumn("__deal", F.xxhash64(*on)), [*on, "__deal"], "left").drop("__deal")


def flag(df: DataFrame, keys: DataFrame, on: str | Sequence[str], name: str) -> DataFrame:
    """`df` with a boolean: does the row's key occur in `keys`?"""
    on = [on] if isinstance(on, str) else list(on)
    marked = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return looked_up(df, marked, on).withColumn(name, F.coalesce(name, F.lit(False)))


def key_hits(keys: DataFrame, registry: DataFrame, item: str, kinds: Mapping[str, str]) -> DataFrame:
    """Per item, which kinds of its long keys are in a registry: one pass over the keys, one row per hit item."""
    hits = keys.join(registry.select("node").distinct(), "node", "left_semi")
    return hits.groupBy(item).agg(*[F.bool_or(F.col("kind") == kind).alias(name) for kind, name in kinds.items()])


def anti_exposure(candidates: DataFrame, keys: DataFrame, registry: DataFrame, heldout: DataFrame, poisoned: DataFrame,
                  item: str, too_short: Column) -> DataFrame:
    """Candidates with the first reason that excludes them: exposed speaker, exposed reference, component, held-out, short."""
    exposed = key_hits(keys, registry, item, {"s": "__speaker", "r": "__reference"})
    held = key_hits(keys.where("kind = 'j'"), heldout, item, {"j": "__held"})
    component = keys.join(poisoned.select("node").distinct(), "node", "left_semi").select(item).distinct().withColumn("__poison", F.lit(True))
    joined = candidates.join(exposed, item, "left").join(held, item, "left").join(component, item, "left")
    reason = first_reason([
        ("speaker_in_prior_exposure", F.col("__speaker")), ("reference_in_prior_exposure", F.col("__reference")),
        ("closure_component_in_prior_exposure", F.col("__poison")), ("upstream_heldout_record", F.col("__held")), ("recording_too_short", too_short)])
    return joined.withColumn("reason", reason).drop("__speaker", "__reference", "__held", "__poison")


def upsert_latest(known: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """Union of two reason tables where the latest entry of a key wins (partial aggregate, no ranking)."""
    both = known.unionByName(new)
    rest = [c for c in both.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in rest])


def eligibility_filter(candidates: DataFrame, heldout: DataFrame, resolutions: DataFrame, blocked: DataFrame) -> DataFrame:
    """Lineage eligibility of synthetic candidates: `reason` is NULL for eligible rows.

    Candidates have row_id, generator, source/target speakers and references. In order: blocked by a planner, reference
    known to be unresolvable, unknown generator, target unresolved, target mismatch, source unresolved or mismatched
    (converted speech only), a parent in the upstream held-out parts. Text-to-speech rows have no source voice.
    """
    src, tgt = parse_fname(F.col("source_reference")), parse_fname(F.col("target_reference"))
    rows = candidates.withColumns({
        "source_record": src["record_id"], "target_record": tgt["record_id"],
        "__ts": canonical_int(tgt["speaker"]), "__td": canonical_int(F.col("target_speaker")),
        "__ss": canonical_int(src["speaker"]), "__sd": canonical_int(F.col("source_speaker")),
    })
    converted, spoken = F.col("generator").isin(*CONVERSION_GENERATORS), F.col("generator").isin(*SPEECH_GENERATORS)
    declared = F.col("source_record").isNotNull() & (F.col("__ss") == F.col("__sd"))
    kind = F.when(converted, "conversion_source").when(F.coalesce(declared, F.lit(False)), "declared_source").otherwise("tts_target_only")
    rows = rows.withColumn("source_kind", kind)
    bad = resolutions.where(F.col("status").isin("not_found", "upstream_eval_parent", "budget_stopped")).select("record_id", F.lit(True).alias("b"), F.lit(False).alias("h"))
    # what is known of a record in one row, looked up once for each side
    known = bad.unionByName(heldout.select("record_id", F.lit(False).alias("b"), F.lit(True).alias("h"))).groupBy("record_id").agg(F.bool_or("b").alias("b"), F.bool_or("h").alias("h"))
    for side, column in (("s", "source_record"), ("t", "target_record")):
        rows = looked_up(rows, known.select(F.col("record_id").alias(column), F.col("b").alias(f"__b_{side}"), F.col("h").alias(f"__h_{side}")), column)
    rows = rows.withColumn("__h_s", F.col("__h_s") & (F.col("source_kind") != "tts_target_only"))
    rows = flag(rows, blocked, "row_id", "__blocked")
    reason = first_reason([
        ("lineage_replacement_required", F.col("__blocked")), ("reference_unresolvable_precheck", F.col("__b_s") | F.col("__b_t")),
        ("unknown_generator", ~F.coalesce(converted | spoken, F.lit(False))),
        ("unresolved_target_lineage", F.col("target_record").isNull() | F.col("__ts").isNull() | F.col("__td").isNull()),
        ("target_speaker_mismatch", F.col("__ts") != F.col("__td")),
        ("unresolved_source_lineage", converted & (F.col("source_record").isNull() | F.col("__ss").isNull() | F.col("__sd").isNull())),
        ("source_speaker_mismatch", converted & (F.col("__ss") != F.col("__sd"))),
        ("upstream_held_out_parent", F.col("__h_t") | F.col("__h_s"))])
    return rows.withColumn("reason", reason).drop(*[c for c in rows.columns if c.startswith("__")])


def identity_conflict(rows: DataFrame, minimum_seconds: float) -> Column:
    """Why an inventory row cannot be used: unparsed name, ids that disagree, upstream id that disagrees, too short."""
    upstream = F.col("upstream_speaker")
    known = upstream.isNotNull() & ~F.trim(upstream).isin("", "None")
    read = F.struct(parse_reference(F.col("fname")).alias("p"), canonical_int(F.col("record_id")).alias("record"), canonical_int(F.col("speaker")).alias("speaker"))
    return let(read, lambda v: first_reason([
        ("fname_unparseable", v["p"].isNull()), ("id_unparseable", v["record"].isNull() | v["speaker"].isNull()),
        ("identity_conflict_with_fname", (v["p"]["record"] != v["record"]) | (v["p"]["speaker"] != v["speaker"]) | (v["p"]["gender"] != F.col("gender"))),
        ("upstream_speaker_conflict", known & ~canonical_int(upstream).eqNullSafe(v["speaker"])),
        ("recording_too_short", F.col("duration") < minimum_seconds)]))


def parent_lookup(references: DataFrame, inventories: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Which inventories hold a record, in the given order, as an evidence array and a flag."""
    rows = references
    for name, inventory in inventories.items():
        rows = flag(rows, inventory, key, f"__in_{name}")
    found = F.array_compact(F.array(*[F.when(F.col(f"__in_{name}"), F.lit(name)) for name in inventories]))
    return rows.withColumn("found_in", found).withColumn("verified", F.size(found) > 0).drop(*[f"__in_{n}" for n in inventories])


def lineage_resolve(wanted: DataFrame, sources: Sequence[tuple[str, DataFrame]], on: Sequence[str]) -> DataFrame:
    """The status of each wanted record from the first source that has it, else not_found.

    `sources` are (status, keys) in order of priority. One union and one grouped minimum instead of a join per source.
    """
    ranked = None
    for priority, (status, keys) in enumerate(sources):
        part = keys.select(*on).distinct().withColumns({"__priority": F.lit(priority), "__status": F.lit(status)})
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy(*on).agg(F.min_by("__status", "__priority").alias("status"), F.count("*").alias("sources"))
    return null_safe(wanted.select(*on).distinct(), best, list(on), "left").withColumns(
        {"status": F.coalesce("status", F.lit("not_found")), "sources": F.coalesce("sources", F.lit(0).cast("bigint"))})


def lineage_crosscheck(missing: DataFrame, inventory: DataFrame) -> DataFrame:
    """Records missing in their language that exist in another one: (language, record_id, other_language)."""
    elsewhere = inventory.select("record_id", F.col("language").alias("other_language")).distinct()
    return missing.select("language", "record_id").distinct().join(elsewhere, "record_id").where("language <> other_language")


def zone_map_join(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is wanted: a semi-join on the key itself.

    Skipping row groups by their [lo, hi] is the reader's work: where the wanted side is small enough to be broadcast,
    Spark turns it into a filter on the scan, which parquet checks against the minima and maxima of each row group.
    """
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def shared_keys(keys: DataFrame, split: str = "split", role: str = "role") -> DataFrame:
    """How many distinct keys each pair of splits shares, per kind and pair of roles.

    Keys are grouped once; a key carries at most (splits x roles) distinct sides, so the pairs come from a short array
    and no key table is joined with itself.
    """
    sides = keys.select("kind", "node", split, role).distinct()
    grouped = sides.groupBy("kind", "node").agg(F.array_sort(F.collect_set(F.struct(F.col(split).alias("split"), F.col(role).alias("role")))).alias("s"))
    both = grouped.where(F.size("s") > 1).select("kind", "node", F.explode("s").alias("l"), "s").select("kind", "node", "l", F.explode("s").alias("r"))
    pairs = both.where("l.split < r.split")
    return pairs.groupBy("kind", F.col("l.split").alias("split_a"), F.col("l.role").alias("role_a"),
                         F.col("r.split").alias("split_b"), F.col("r.role").alias("role_b")).agg(F.count("*").alias("shared"))


def keys_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct keys of `left` that `right` has too, counted per kind."""
    return left.select("kind", "node").distinct().join(right.select("node").distinct(), "node", "left_semi").groupBy("kind").agg(F.count("*").alias("shared"))


def _distinct_few(column: str) -> Column:
    """Distinct count of a column of few values, as the splits are: a small set, where an exact count would shuffle all rows twice."""
    return F.size(F.collect_set(column)).cast("bigint")


def hash_dupes(rows: DataFrame, digest: str, split: str = "split") -> DataFrame:
    """Digests that occur more than once: copies, splits, and whether they cross splits (an error) or stay inside one."""
    grouped = rows.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("digest")).agg(F.count("*").alias("copies"), _distinct_few(split).alias("splits"))
    return grouped.where("copies > 1").withColumn("scope", F.when(F.col("splits") > 1, "cross_split").otherwise("within_split"))


def recording_collision(rows: DataFrame, recording: str, split: str = "split") -> DataFrame:
    """Recordings with windows in more than one split."""
    return rows.groupBy(recording).agg(F.count("*").alias("windows"), _distinct_few(split).alias("splits")).where("splits > 1")


def difference(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer comparison in long form: missing and extra keys, and each changed field."""
    l = left.select(key, F.struct(*fields).alias("l"))  # noqa: E741
    r = right.select(key, F.struct(*fields).alias("r"))
    joined = l.join(r, key, "full_outer")
    changed = [F.when(F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f"changed_{f}")) for f in fields]
    found = F.array_compact(F.array(F.when(F.col("r").isNull(), "missing"), F.when(F.col("l").isNull(), "extra"), *changed))
    return joined.select(key, F.explode(found).alias("difference"))


def order_breaks(left: DataFrame, right: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Keys whose position differs between two orderings."""
    l = left.select(*keys, F.col(position).alias("position_a"))  # noqa: E741
    return l.join(right.select(*keys, F.col(position).alias("position_b")), [*keys]).where("position_a <> position_b")


def order_changes(left: DataFrame, right: DataFrame, key: str, position: str, within: Sequence[str] = ()) -> DataFrame:
    """`changed_order` for keys of both sides whose place among them differs.

    The place of a key that occurs more than once is its first one. Places count inside the parts named by `within`. Both
    sides meet in one grouping, and the rows that carry their place on one side are ranked for the other, so no ranks are joined.
    """
    keys = [key, *within]
    row = lambda df, mine: df.select(*keys, F.struct(F.col(position).alias("p")).alias("__p"), F.lit(mine).alias("__left"))
    both = row(left, True).unionByName(row(right, False)).where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    first = both.groupBy(*keys).agg(F.min(F.when(F.col("__left"), F.col("__p"))).alias("a"), F.min(F.when(~F.col("__left"), F.col("__p"))).alias("b"))
    # a place that is the key itself is not carried beside it
    same = dict(left.dtypes)[position] == dict(left.dtypes)[key] == dict(right.dtypes)[position]
    apart = lambda c: F.when(~F.col(c)["p"].eqNullSafe(F.col(key)), F.col(c)) if same else F.col(c)
    order = lambda c: [F.when(F.col(c).isNull(), F.col(key)).otherwise(F.col(c)["p"]) if same else F.col(c)["p"], F.col(key)]
    common = cut(first.where("a IS NOT NULL AND b IS NOT NULL").select(*keys, apart("a").alias("__a"), apart("b").alias("__b")))
    placed = ranked(common, [*within], order("__a"), "__place_a").drop("__a")
    placed = ranked(placed, [*within], order("__b"), "__place_b")
    return placed.where("__place_a <> __place_b").select(key, F.lit("changed_order").alias("difference"))


def _moved(first: DataFrame, key: str, within: Sequence[str], same: bool) -> DataFrame:
    """(key, within) of keys whose place among the keys that have both `a` and `b` differs. With `same` a place that is the
    key itself is not carried beside it.

    One order holds all: a key that has one position on both sides is one row, any other key a row of each side. Its place on a side is the
    number of rows of that side up to its own, so one pass counts both.
    """
    keys = [key, *within]
    apart = lambda c: F.when(~F.col(c)["p"].eqNullSafe(F.col(key)), F.col(c)) if same else F.col(c)
    row = lambda c, n: F.struct(apart(c).alias("at"), F.lit(n).alias("side"))
    rows = F.when(F.col("a")["p"].eqNullSafe(F.col("b")["p"]), F.array(row("a", "ab"))).otherwise(F.array(row("a", "a"), row("b", "b")))
    dealt = first.where("a IS NOT NULL AND b IS NOT NULL").select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    order = [F.when(F.col("at").isNull(), F.col(key)).otherwise(F.col("at")["p"]) if same else F.col("at")["p"], F.col(key)]
    upto = lambda side: F.col("side").contains(side).cast("bigint")
    placed = running(dealt, [*within], order, __a=upto("a"), __b=upto("b")).select(*keys, "side", "__a", "__b")
    apart_rows = placed.where("side <> 'ab'").groupBy(*keys).agg(F.max(F.when(F.col("side") == "a", F.col("__a"))).alias("__a"), F.max(F.when(F.col("side") == "b", F.col("__b"))).alias("__b"))
    return placed.where("side = 'ab'").select(*keys, "__a", "__b").unionByName(apart_rows).where("__a <> __b").select(*keys)


def cache_difference(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], position: str, within: Sequence[str] = ()) -> DataFrame:
    """`difference` and the order check of `order_changes`."""
    return difference(left, right, key, fields).unionByName(order_changes(left, right, key, position, within))


def cache_issues(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], position: str, part: str) -> DataFrame:
    """(part, issues): how many rows of `cache_difference` each part has. A key is counted in its part on the left, or else on the right.

    Both sides meet once, and what the order check needs of them is written down beside the count. A place that is the key
    itself does not travel, and hexadecimal digests travel as bytes.
    """
    same = dict(left.dtypes)[position] == dict(left.dtypes)[key] == dict(right.dtypes)[position]
    row = F.struct(F.col(position).alias("p"))
    place = F.when(~F.col(position).eqNullSafe(F.col(key)), row) if same else row

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.struct(*[(_packed(F.col(f)) if dict(df.dtypes)[f] == "string" else F.col(f)).alias(f) for f in fields], F.col(part).alias("__part"), place.alias("__place")).alias(name))

    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    found = F.when(both, sum((F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), 1).otherwise(0) for f in fields), F.lit(0))).otherwise(1)
    joined = side(left, "l").join(side(right, "r"), key, "full_outer")
    judged = cut(joined.select(key, F.coalesce("l.__part", "r.__part").alias(part), found.alias("__found"), (both & (F.col("l.__part") == F.col("r.__part"))).alias("__shared"),
                               F.col("l.__place").alias("__l"), F.col("r.__place").alias("__r")))
    own = lambda c: F.coalesce(c, F.struct(F.col(key).alias("p"))) if same else F.col(c)
    first = judged.where(F.col("__shared") & F.col(key).isNotNull()).groupBy(key, part).agg(F.min(own("__l")).alias("a"), F.min(own("__r")).alias("b"))
    moved = _moved(first, key, [part], same).groupBy(part).agg(F.count("*").alias("issues"))
    return judged.groupBy(part).agg(F.sum("__found").alias("issues")).unionByName(moved).groupBy(part).agg(F.sum("issues").alias("issues"))


def _packed(text: Column) -> Column:
    """A text as bytes that tell it from any other: hexadecimal digests take half of theirs."""
    return F.when(text.rlike(r"^[0-9a-f]{64}\z"), F.concat(F.unhex(F.lit("01")), F.unhex(text))).otherwise(F.concat(F.unhex(F.lit("00")), text.cast("binary")))


def reuse_or_pending(wanted: DataFrame, cached: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Each wanted row reused when a cached row agrees on every field, else pending with the first field that differs."""
    c = cached.select(key, F.struct(*fields).alias("__c"))
    joined = wanted.join(c, key, "left")
    rules = [("not_cached", F.col("__c").isNull())] + [(f"changed_{f}", ~F.col(f).eqNullSafe(F.col(f"__c.{f}"))) for f in fields]
    return joined.withColumn("pending_reason", first_reason(rules)).withColumn("reused", F.col("pending_reason").isNull()).drop("__c")


def retention_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of `before` that are missing from `after` or changed there, compared by a digest of the whole row."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"}), 256)
    b, a = before.select(key, digest(before).alias("b")), after.select(key, digest(after).alias("a"))
    joined = b.join(a, key, "left")
    return joined.select(key, F.when(F.col("a").isNull(), "missing").when(F.col("a") != F.col("b"), "changed").alias("difference")).where("difference IS NOT NULL")


def replay_diff(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows that only one of two runs has. Both runs give the same rows when this is empty."""
    columns = stored.columns
    only = lambda a, b, name: a.exceptAll(b.select(*columns)).withColumn("only_in", F.lit(name))
    return only(stored, recomputed, "stored").unionByName(only(recomputed.select(*columns), stored, "recomputed"))


def snapshot_compare(before: DataFrame, after: DataFrame, path: str, digest: str, allowed: Column) -> DataFrame:
    """Per path: unchanged, changed, missing or added, and whether a change is on the allow-list."""
    joined = before.select(path, F.col(digest).alias("b")).join(after.select(path, F.col(digest).alias("a")), path, "full_outer")
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "missing").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return joined.select(path, state.alias("state")).withColumn("violation", (F.col("state") != "unchanged") & ~F.coalesce(allowed, F.lit(False)))


def accounting(selected: DataFrame, materialized: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Disposition of every key: selected rows must be materialized or excluded, and nothing else may be materialized."""
    sides = (selected.select(key, F.lit(1).alias("s"), F.lit(0).alias("m"), F.lit(0).alias("x"))
             .unionByName(materialized.select(key, F.lit(0).alias("s"), F.lit(1).alias("m"), F.lit(0).alias("x")))
             .unionByName(excluded.select(key, F.lit(0).alias("s"), F.lit(0).alias("m"), F.lit(1).alias("x"))))
    state = sides.groupBy(key).agg(F.max("s").alias("s"), F.max("m").alias("m"), F.max("x").alias("x"))
    return state.select(key, F.when((F.col("s") == 1) & (F.col("m") == 1), "materialized").when((F.col("s") == 1) & (F.col("x") == 1), "excluded")
                        .when(F.col("s") == 1, "unaccounted").when(F.col("m") == 1, "extra").otherwise("excluded_unselected").alias("disposition"))


def prediction_parity(saved: DataFrame, regenerated: DataFrame, key: str, value: str, position: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest and mean difference between saved and regenerated values, and whether the order agrees."""
    r = regenerated.select(key, F.col(value).alias("__r"), F.col(position).alias("__p"))
    diff = F.abs(F.col(value) - F.col("__r"))
    return saved.join(r, key).groupBy(*by).agg(F.count("*").alias("rows"), F.max(diff).alias("max_diff"), F.avg(diff).alias("mean_diff"),
                                               F.bool_and(F.col(position) == F.col("__p")).alias("order_ok"))


def replace_failed(slots: DataFrame, reserves: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Failed slots filled from the usable reserves of the same speaker and split, each reserve used once.

    The k-th failed slot of a group takes the k-th usable reserve: ranks on both sides meet in an equi-join, so no group
    is walked in one task. `slots` need `slot`, reserves `reserve`; unfilled slots get NULL.
    """
    from voicelake.operators.prefix import ranked

    left = ranked(slots, list(on), [F.col("slot")], "__k")
    right = ranked(reserves, list(on), list(order), "__k").select(*on, "__k", "reserve")
    return left.join(right, [*on, "__k"], "left").withColumn("disposition", F.when(F.col("reserve").isNull(), "unfilled").otherwise("replaced")).drop("__k")


def role_guard(rows: DataFrame, roles: DataFrame, dataset: str, split: str, training: Sequence[str]) -> DataFrame:
    """Rows of evaluation-only datasets that sit in a training split."""
    closed = roles.where("role = 'evaluation_only'").select(dataset)
    return rows.where(F.col(split).isin(*training)).join(closed, dataset, "left_semi")


def missing_cells(dimension: DataFrame, values: Mapping[str, Sequence[str]], actual: DataFrame) -> DataFrame:
    """Expected combinations that have no rows. The value lists are fixed and short, so the grid is an explode."""
    grid = dimension
    for name, options in values.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(o) for o in options])))
    return grid.join(actual.select(*grid.columns).distinct(), grid.columns, "left_anti")
