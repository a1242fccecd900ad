"""Selection under quotas: caps, round-robin interleaving, disjoint pairs, budgets, allocations.

Sequential greedy walks become fixed priorities. A selection that takes the first few rows of a group ranks at most k rows
per group and task; one that needs the position of every row uses the piecewise ranks of `prefix`; a greedy with several
caps at once is the fixpoint of `capped_selection`, which gives exactly the rows the walk would give.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelake.operators.prefix import first_k, hash_order, hash_ranked, null_safe, ranked, running
from voicelake.session import cut, remove_work

# Spark limits rows per group before the shuffle only for ranks up to this number.
GROUP_LIMIT = 1000


def head(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows per group whatever k is: group limit for a small k, piecewise ranks for a large one."""
    if k <= GROUP_LIMIT:
        return first_k(df, by, order, k, name).withColumn(name, F.col(name).cast("bigint"))
    return ranked(df, by, order, name).where(F.col(name) <= k)


def cap_per_group(df: DataFrame, group: Sequence[str], key: str, cap: int, seed: str | int) -> DataFrame:
    """All rows with `kept`: at most `cap` per group in hash order, the rest dropped. Rows of one key are told apart by a number."""
    numbered = df.withColumn("__copy", F.row_number().over(Window.partitionBy(key).orderBy(*group)))
    kept = head(numbered, group, [hash_order(seed, key), F.col(key), F.col("__copy")], cap).select(key, "__copy", F.lit(True).alias("kept"))
    return numbered.join(kept, [key, "__copy"], "left").withColumn("kept", F.coalesce("kept", F.lit(False))).drop("__copy")


def one_per_cell(df: DataFrame, cell: Sequence[str], key: str, seed: str | int) -> DataFrame:
    """One row per cell, the first in hash order: a plain aggregate."""
    rest = [c for c in df.columns if c not in cell]
    best = df.groupBy(*cell).agg(F.min_by(F.struct(*rest), F.struct(hash_order(seed, key), F.col(key))).alias("b"))
    return best.select(*cell, *[F.col(f"b.{c}").alias(c) for c in rest])


def round_robin(df: DataFrame, by: Sequence[str], lane: str, key: str, seed: str | int) -> DataFrame:
    """Turn of each row in its lane; (turn, lane) is the interleaved order."""
    return hash_ranked(df, [*by, lane], key, seed, "turn")


def quota_trim(df: DataFrame, by: Sequence[str], lane: str, key: str, seed: str | int, budget: Column) -> DataFrame:
    """Trim each group to its budget, round-robin over lanes; dropped rows stay with `kept` false."""
    placed = ranked(round_robin(df, by, lane, key, seed), by, [F.col("turn"), F.col(lane)], "position")
    return placed.withColumn("kept", F.col("position") <= budget)


def select_candidates(df: DataFrame, by: Sequence[str], lane: str, pair: Sequence[str], key: str, seed: str | int, count: int) -> DataFrame:
    """Round-robin over lanes where rows of pairs not seen yet in the lane come first."""
    seen = hash_ranked(df, [*by, lane, *pair], key, seed, "__repeat").withColumn("__hash", hash_order(seed, key))
    turns = ranked(seen, [*by, lane], [F.col("__repeat"), F.col("__hash"), F.col(key)], "turn")
    return head(turns, by, [F.col("turn"), F.col(lane)], count).drop("__repeat", "__hash")


def capped_selection(rows: DataFrame, memberships: DataFrame, key: str, priority: str) -> DataFrame:
    """The keys a greedy walk in priority order takes when a row needs room in all its groups.

    `memberships` is (key, group, cap). In each round every undecided row that is among the first `cap` undecided or
    accepted rows of all its groups is accepted, and every row behind the last accepted row of a full group is rejected.
    The row with the least priority is always decided, so the loop ends; in practice after a few rounds. A hot group
    costs `cap` ranked rows per task and one aggregated threshold, never a walk over the group. Each round writes its two
    tables and removes those of the round before, so neither the plan nor the folder grows with the rounds.
    """
    sizes = memberships.groupBy(key).agg(F.count("*").alias("__groups"))
    loose = rows.select(key, priority).join(memberships.select(key).distinct(), key, "left_anti")
    undecided = cut(rows.select(key, priority).join(memberships, key).join(sizes, key))
    widest = undecided.agg(F.max("cap")).first()[0]
    taken = cut(undecided.limit(0))
    while not undecided.isEmpty():
        pool = undecided.withColumn("__open", F.lit(True)).unionByName(taken.withColumn("__open", F.lit(False)))
        top = head(pool, ["group"], [F.col(priority), F.col(key)], widest, "__r").where((F.col("__r") <= F.col("cap")) & F.col("__open"))
        ready = top.groupBy(key).agg(F.count("*").alias("__in"), F.max("__groups").alias("__groups")).where("__in = __groups").select(key)
        accepted = cut(undecided.join(ready, key, "left_semi"))
        taken = cut(taken.unionByName(accepted), replaces=taken)
        full = taken.groupBy("group").agg(F.count("*").alias("__n"), F.max("cap").alias("__cap"), F.max(priority).alias("__last")).where("__n >= __cap")
        blocked = undecided.join(full, "group").where(F.col(priority) > F.col("__last")).select(key)
        done = accepted.select(key).unionByName(blocked).distinct()
        undecided = cut(undecided.join(done, key, "left_anti"), replaces=undecided)
        remove_work(accepted.sparkSession, accepted._work_path)
    return taken.select(key, priority).distinct().unionByName(loose)


def joined_key(*parts: str | Column) -> Column:
    """Text of several key parts in which NULL keeps its place."""
    return F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\\N")) for p in parts])


#: Rows without a source share one key; they are dealt over this many.
DEALS = 64


def pair_table(df: DataFrame, by: Sequence[str], anchors: DataFrame | None = None, turns: int | None = None) -> DataFrame:
    """Distinct (source, target, generator) pairs with their round-robin priority over generators.

    With `anchors` (language, speaker) the pairs that touch an anchored speaker come first in their generator. With `turns`
    only so many first pairs of each generator, which come before all others.
    """
    source = F.when(~F.col("source_speaker").isin("", "None"), F.col("source_speaker"))
    pairs = df.select(*by, F.coalesce(source, F.lit("")).alias("source"), F.col("target_speaker").alias("target"), "generator").distinct()
    if anchors is None:
        pairs = pairs.withColumn("anchored", F.lit(0))
    else:
        # an empty name is one key of very many pairs, so it is dealt, and known once in each part
        known = anchors.select(*by, "speaker").distinct()
        known = known.withColumn("__deal", F.explode(F.when(F.col("speaker") == "", F.sequence(F.lit(0), F.lit(DEALS - 1))).otherwise(F.array(F.lit(0)))))
        for side, other in (("source", "target"), ("target", "source")):
            dealt = F.when(F.col(side) == "", F.pmod(F.hash(other, "generator"), F.lit(DEALS))).otherwise(0)
            pairs = null_safe(pairs.withColumn("__deal", dealt), known.select(*by, F.col("speaker").alias(side), "__deal", F.lit(1).alias(f"__{side}")), [*by, side, "__deal"], "left")
        pairs = pairs.withColumn("anchored", F.when(F.col("__source").isNotNull() | F.col("__target").isNotNull(), 0).otherwise(1)).drop("__source", "__target", "__deal")
    lane, order = [*by, "generator"], [F.col("anchored"), F.col("source"), F.col("target")]
    placed = ranked(pairs, lane, order, "turn") if turns is None else first_k(pairs, lane, order, turns, "turn").withColumn("turn", F.col("turn").cast("bigint"))
    key = joined_key(*by, "source", "target", "generator")
    return placed.withColumns({"pair": key, "priority": F.struct("turn", "generator", key.alias("pair"))})


def disjoint_pairs(df: DataFrame, by: Sequence[str], n_pairs: int, anchors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs, and among them those that a walk with one pair a person keeps: in each group at least the first n of the walk, or all.

    The walk keeps a pair whatever comes behind it, and a group's people are its own. The first GROUP_LIMIT turns of every
    generator come before all later ones, so a group that has n pairs there is done; only the others are walked whole.
    """
    kept = lambda pairs: capped_selection(pairs, participants(pairs, by), "pair", "priority").select("pair")
    early = cut(pair_table(df, by, anchors, GROUP_LIMIT))
    walked = cut(kept(early))
    counts = null_safe(early.select(*by, "generator", "pair"), early.join(walked, "pair", "left_semi").groupBy(*by).agg(F.count("*").alias("__kept")), by, "left")
    # a group is open while it lacks pairs and one of its generators may have more of them
    lanes = counts.groupBy(*by, "generator").agg(F.count("*").alias("__n"), F.max(F.coalesce("__kept", F.lit(0))).alias("__kept"))
    open_ = cut(lanes.where((F.col("__kept") < n_pairs) & (F.col("__n") >= GROUP_LIMIT)).select(*by).distinct())
    if open_.isEmpty():
        return early, walked
    late = cut(pair_table(null_safe(df, open_, by, "left_semi"), by, anchors))
    closed = null_safe(early, open_, by, "left_anti")
    return closed.unionByName(late), closed.join(walked, "pair", "left_semi").select("pair").unionByName(kept(late))


def participants(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each pair's people as groups with room for one pair."""
    people = F.explode(F.array_distinct(F.array_compact(F.array(F.nullif("source", F.lit("")), F.col("target")))))
    return pairs.select("pair", *by, people.alias("who")).select("pair", joined_key(*by, "who").alias("group"), F.lit(1).alias("cap"))


def select_final_pairs(df: DataFrame, by: Sequence[str], n_pairs: int, anchors: DataFrame) -> DataFrame:
    """Speaker-disjoint pairs, anchored ones first, round-robin over generators: the first n per group."""
    pairs, disjoint = disjoint_pairs(df, by, n_pairs, anchors)
    return head(pairs.join(disjoint, "pair", "left_semi"), by, [F.col("priority")], n_pairs)


def choose_pairs(df: DataFrame, by: Sequence[str], n_pairs: int) -> DataFrame:
    """Disjoint pairs first; what is missing to n comes from the other pairs in the same priority."""
    pairs, disjoint = disjoint_pairs(df, by, n_pairs)
    passes = pairs.join(disjoint.withColumn("pass", F.lit(0)), "pair", "left").withColumn("pass", F.coalesce("pass", F.lit(1)))
    return head(passes, by, [F.col("pass"), F.col("priority")], n_pairs)


def rows_of_pairs(df: DataFrame, pairs: DataFrame, by: Sequence[str], key: str, per_pair: int) -> DataFrame:
    """At most `per_pair` rows of each chosen pair, lowest key first."""
    source = F.coalesce(F.when(~F.col("source_speaker").isin("", "None"), F.col("source_speaker")), F.lit(""))
    keyed = df.withColumn("pair", joined_key(*by, source, "target_speaker", "generator"))
    return head(keyed.join(pairs.select("pair"), "pair", "left_semi"), ["pair"], [F.col(key)], per_pair, "place")


def select_synthetic(df: DataFrame, by: Sequence[str], key: str, target: int, source_cap: int, target_cap: int, component: str | None = None,
                     component_cap: int | None = None, label: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Generator round-robin under source, target and component caps; then a soft top-up without the component cap.

    The priority is (turn in the generator, generator), fixed before any row is skipped. The first GROUP_LIMIT turns of each
    generator come before all later ones, so a group that has `target` rows under all caps there is done; only the others are walked
    whole. `label` adds the component to the rows that are walked.
    """
    lane, label = [*by, "generator"], label or (lambda rows: rows)
    placed = lambda rows: cut(label(rows).withColumn("priority", F.struct("turn", "generator", key)))
    early = placed(first_k(df, lane, [F.col(key)], GROUP_LIMIT, "turn").withColumn("turn", F.col("turn").cast("bigint")))
    chosen = cut(_capped_walk(early, by, key, source_cap, target_cap, component, component_cap))
    full = chosen.where("pass = 0").groupBy(*by).agg(F.count("*").alias("__kept"))
    lanes = null_safe(early.groupBy(*lane).agg(F.count("*").alias("__n")), full, by, "left")
    open_ = cut(lanes.where((F.col("__n") >= GROUP_LIMIT) & (F.coalesce("__kept", F.lit(0)) < target)).select(*by).distinct())
    if not open_.isEmpty():
        late = placed(ranked(null_safe(df, open_, by, "left_semi"), lane, [F.col(key)], "turn"))
        whole = _capped_walk(late, by, key, source_cap, target_cap, component, component_cap)
        chosen = null_safe(chosen, open_, by, "left_anti").unionByName(whole)
    return head(chosen, by, [F.col("pass"), F.col("priority")], target)


def _capped_walk(rows: DataFrame, by: Sequence[str], key: str, source_cap: int, target_cap: int, component: str | None, component_cap: int | None) -> DataFrame:
    """The rows that the walk under all caps takes (`pass` 0), and those that it takes without the component cap (1)."""
    scope = lambda kind, c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), joined_key(F.lit(kind), *by, c))
    caps = [("s", "source_speaker", source_cap), ("t", "target_speaker", target_cap)]

    def memberships(kinds: Sequence[tuple[str, str, int]]) -> DataFrame:
        groups = F.explode(F.array_compact(F.array(*[F.when(scope(k, c).isNotNull(), F.struct(scope(k, c).alias("group"), F.lit(cap).alias("cap"))) for k, c, cap in kinds])))
        return rows.select(key, groups.alias("g")).select(key, "g.group", "g.cap")

    soft = capped_selection(rows, memberships(caps), key, "priority").select(key)
    if component is None:
        return rows.join(soft, key, "left_semi").withColumn("pass", F.lit(0))
    strict = capped_selection(rows, memberships([*caps, ("c", component, component_cap)]), key, "priority").select(key, F.lit(0).alias("pass"))
    return rows.join(soft.unionByName(strict.select(key)).distinct(), key, "left_semi").join(strict, key, "left").withColumn("pass", F.coalesce("pass", F.lit(1)))


def _walk_block(slots: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
    """The picks of one block of positions, one after the other; `free` tells which places are free before the block."""
    by_order = offers.sort_values([*[c for c in offers.columns if c.startswith("o_")], "key"], na_position="first")
    held = {person: list(zip(own["cost"], own["key"], own["place"])) for person, own in by_order.groupby("person", sort=False)}
    free, rows = set(offers.loc[offers["free"], "place"]), []
    for slot in slots.sort_values("position").itertuples():
        own = held[slot.person]
        at = min(range(len(own)), key=lambda i: (own[i][2] not in free, 0 if own[i][2] in free else own[i][0], i))
        _, key, place = own.pop(at)
        free.add(place)
        rows.append((slot.scope, slot.person, slot.turn, slot.position, key, place))
    return pd.DataFrame(rows, columns=["scope", "person", "turn", "position", "key", "place"])


def reusing_walk(rows: DataFrame, slots: DataFrame, key: str, cost: Column, order: Sequence[Column], used: DataFrame | None = None, block: int = 1000) -> DataFrame:
    """The rows that a sequential walk over slots takes when a pick makes its row group free for all later ones.

    `rows` has (person, place, key): the one who may take the row and its row group. `slots` has (scope, person, turn,
    position): the walk inside a scope goes by position, and a person's turns count from 1 without gaps. A slot takes the
    row of its person, not taken before, with the least (needs a new row group, `cost` if it does, `order`, key). Places
    in `used` are free from the start. Returns (scope, person, turn, position, key, place).

    What a slot takes depends on earlier positions alone, so the walk is the only fixpoint of taking all blocks of `block`
    positions at once against the picks of the round before. Each round settles, in every open scope, the blocks up to the
    first one that changed; only later ones are taken again. A task walks one block.

    Few rows of a person can be taken, whatever the person holds. Rows of a person in one place cost the same. A pick that
    needs a new place is among the first `turns` rows by (cost, order) in places that were not free at the start: had a
    row before it become free, that one would be taken. So only places of such rows ever become free, and rows in other
    places are left out.
    """
    most = slots.agg(F.max("turn")).first()[0] or 1
    names = {f"o_{i}": c for i, c in enumerate(order)}
    by_order = [F.col(n) for n in names] + [F.col("key")]
    own = rows.join(slots.select("person").distinct(), "person", "left_semi").select("person", "place", F.col(key).alias("key"), cost.cast("bigint").alias("cost"), *[c.alias(n) for n, c in names.items()])
    known = used.select("place").distinct() if used is not None else rows.select("place").limit(0)
    marked = own.join(known.withColumn("__known", F.lit(True)), "place", "left").withColumn("__known", F.col("__known").isNotNull())
    offers = cut(head(marked, ["person", "place"], by_order, most, "__r").drop("__r"))
    new = head(offers.where("NOT __known"), ["person"], [F.col("cost"), *by_order], most, "turn")
    within = offers.where("NOT __known").join(new.select("place").distinct(), "place", "left_semi")
    few = cut(within.unionByName(head(offers.where("__known"), ["person"], by_order, most, "__r").drop("__r")), replaces=offers)
    blocked = cut(slots.select("scope", "person", "turn", "position", F.floor((F.col("position") - 1) / block).alias("block")))
    start = head(few, ["person"], [~F.col("__known"), F.col("cost"), *by_order], most, "turn").select("person", F.col("turn").cast("int").alias("turn"), "key", "place")
    picks = cut(blocked.join(start, ["person", "turn"]))
    todo = blocked
    shape = f"scope string, person string, turn int, position bigint, key {dict(few.dtypes)['key']}, place string"
    while True:
        first = picks.groupBy("place").agg(F.min("block").alias("__first"))
        mine = picks.groupBy("key").agg(F.min("block").alias("__mine"))
        owners = todo.select("scope", "person", "block").distinct().toDF("scope", "person", "block")
        near = few.join(owners, "person").join(first, "place", "left").join(mine, "key", "left")
        near = near.where("__mine IS NULL OR __mine >= block").withColumn("free", F.col("__known") | F.coalesce(F.col("__first") < F.col("block"), F.lit(False))).drop("__known", "__first", "__mine")
        near = near.select(*[F.col(c).alias(c) for c in near.columns])
        walked = todo.groupBy("scope", "block").cogroup(near.groupBy("scope", "block")).applyInPandas(_walk_block, shape)
        before = picks.select("scope", "position", "block", F.col("key").alias("__before"))
        taken = cut(walked.join(before, ["scope", "position"]))
        first_changed = taken.where(F.col("key") != F.col("__before")).groupBy("scope").agg(F.min("block").alias("__changed"))
        changed = cut(first_changed.join(blocked.groupBy("scope").agg(F.max("block").alias("__last")), "scope").where("__last > __changed"))
        picks = cut(picks.join(taken.select("scope", "position"), ["scope", "position"], "left_anti").unionByName(taken.drop("__before")), replaces=picks)
        remove_work(taken.sparkSession, taken._work_path)
        if changed.isEmpty():
            remove_work(few.sparkSession, few._work_path)
            return picks.drop("block").withColumnRenamed("key", key)
        todo = blocked.join(changed, "scope").where(F.col("block") > F.col("__changed")).drop("__changed", "__last")


def select_genuine(df: DataFrame, by: Sequence[str], key: str, used_groups: DataFrame, target: int, per_speaker: int, low: float = 1.0, high: float = 30.0) -> DataFrame:
    """Speaker round-robin with a cap; speakers with more material go first. A speaker gives the recording whose row group
    is needed already, by `used_groups` or by an earlier pick, then the one nearest to five seconds, ties by key."""
    keyed = df.where(F.col("duration").between(low, high)).withColumns({"scope": joined_key(*by), "person": joined_key(*by, "speaker"), "place": joined_key(*by, "shard", "row_group")})
    volume = keyed.groupBy("scope", "person", "speaker").agg(F.count("*").alias("material"))
    turns = volume.withColumn("turn", F.explode(F.sequence(F.lit(1), F.least("material", F.lit(per_speaker)).cast("int"))))
    slots = cut(head(turns, ["scope"], [F.col("turn"), F.col("material").desc(), F.col("speaker")], target, "position").select("scope", "person", "turn", "position"))
    used = null_safe(keyed, used_groups.select("shard", "row_group").distinct(), ["shard", "row_group"], "left_semi").select("place").distinct()
    picks = reusing_walk(keyed, slots, key, F.lit(0), [F.abs(F.col("duration") - 5)], used)
    return df.join(picks.select(key, "turn", F.col("position").alias("rank")), key)


def top_up_genuine(df: DataFrame, by: Sequence[str], key: str, deficit: int, per_speaker: int) -> DataFrame:
    """Fill a deficit from unused speakers, largest first: each gives up to its cap, the last one what is missing."""
    volume = df.groupBy(*by, "speaker").agg(F.count("*").alias("material"))
    offers = volume.withColumn("offer", F.least("material", F.lit(per_speaker)))
    filled = running(offers, by, [F.col("material").desc(), F.col("speaker")], total=F.col("offer"))
    take = F.least(F.col("offer"), F.lit(deficit) - (F.col("total") - F.col("offer")))
    takes = filled.withColumn("take", take).where("take > 0").select(*by, "speaker", "take")
    own = head(df, [*by, "speaker"], [F.abs(F.col("duration") - 5), F.col(key)], per_speaker, "turn")
    return own.join(takes, [*by, "speaker"]).where("turn <= take")


def choose_genuine_test(df: DataFrame, by: Sequence[str], key: str, target: int) -> DataFrame:
    """Cost-aware test speakers: row groups in order of what they can give and how little they weigh, an even number of
    male and female speakers from the first groups they occur in, then any speakers to the target. The longest recording
    of the speaker in that group stands for it."""
    from voicelake.operators.stats import capacity_by_group

    group = [*by, "shard", "row_group"]
    capacity = capacity_by_group(df, group, "speaker", "gender", target)
    weight = df.groupBy(*group).agg(F.sum("bytes").alias("weight"))
    place = F.struct((-F.col("score")).alias("score"), "weight", "shard", "row_group")
    rows = df.join(capacity.join(weight, group).select(*group, place.alias("place")), group)
    best = rows.groupBy(*by, "speaker", "gender", "place").agg(F.max_by(key, F.struct("duration", key)).alias(key), F.max("duration").alias("duration"))
    rest = ["gender", key, "duration"]
    speakers = best.groupBy(*by, "speaker").agg(F.min("place").alias("place"), F.min_by(F.struct(*rest), F.col("place")).alias("b")).select(
        *by, "speaker", "place", *[F.col(f"b.{c}").alias(c) for c in rest])
    order = [F.col("place"), F.col("speaker").cast("bigint")]
    even = head(speakers, [*by, "gender"], order, max(1, target // 2), "turn").select(*by, "speaker", F.lit(0).alias("pass"))
    passes = speakers.join(even, [*by, "speaker"], "left").withColumn("pass", F.coalesce("pass", F.lit(1)))
    return head(passes, by, [F.col("pass"), *order], target).drop("place")


def choose_synthetic_test(df: DataFrame, by: Sequence[str], key: str, seed: str | int, target: int) -> DataFrame:
    """Preference tiers (verified, with transcript), generator round-robin, every target speaker once before any twice."""
    tiers = df.withColumns({"__tier": F.struct((~F.col("verified")).alias("u"), F.col("transcript").isNull().alias("n")), "__hash": hash_order(seed, key)})
    turns = ranked(tiers, [*by, "generator"], [F.col("__tier"), F.col("__hash"), F.col(key)], "turn")
    first = turns.groupBy(*by, "target_speaker").agg(F.min(F.struct("turn", "generator", key)).alias("f"))
    marked = null_safe(turns, first, [*by, "target_speaker"]).withColumn("pass", F.when(F.col(f"f.{key}") == F.col(key), 0).otherwise(1))
    return head(marked, by, [F.col("pass"), F.col("turn"), F.col("generator"), F.col(key)], target).drop("__tier", "__hash", "f")


def spread(df: DataFrame, by: Sequence[str], area: str, speaker: str, key: str, per_speaker: int, target: int, low: float, high: float) -> DataFrame:
    """Unused areas and speakers first: rank in the area and in the speaker, both low first, a cap per speaker."""
    rows = df.where(F.col("duration").between(low, high))
    own = head(rows, [*by, speaker], [F.col(key)], per_speaker, "in_speaker")
    placed = ranked(own, [*by, area], [F.col("in_speaker"), F.col(speaker), F.col(key)], "in_area")
    return head(placed, by, [F.col("in_area"), F.col("in_speaker"), F.col(area), F.col(speaker), F.col(key)], target)


def quota_first_seen(df: DataFrame, by: Sequence[str], speaker: str, position: str, train: int, val: int, train_cap: int, val_cap: int) -> DataFrame:
    """The first speakers seen go to train, the next to val; each gives at most its role's number of windows."""
    seen = df.groupBy(*by, speaker).agg(F.min(position).alias("first"))
    roles = head(seen, by, [F.col("first"), F.col(speaker)], train + val, "turn").select(*by, speaker, F.when(F.col("turn") <= train, "train").otherwise("val").alias("role"))
    own = head(df, [*by, speaker], [F.col(position)], max(train_cap, val_cap), "window")
    return own.join(roles, [*by, speaker]).where(F.col("window") <= F.when(F.col("role") == "train", train_cap).otherwise(val_cap))


def allocate_speakers(df: DataFrame, by: Sequence[str], speaker: str, dev_target: int = 2, train_target: int = 4) -> DataFrame:
    """Speakers by material: one goes to dev when there are at most three, two otherwise; the next ones go to train."""
    volume = df.groupBy(*by, speaker).agg(F.count("*").alias("material"))
    totals = volume.groupBy(*by).agg(F.count("*").alias("speakers"))
    top = head(volume, by, [F.col("material").desc(), F.col(speaker).cast("bigint")], dev_target + train_target, "turn").join(totals, list(by))
    dev = F.when(F.col("speakers") <= 3, 1).otherwise(dev_target)
    return top.withColumn("split", F.when(F.col("turn") <= dev, "dev").when(F.col("turn") <= dev + train_target, "train")).where("split IS NOT NULL")


def pick_recordings(df: DataFrame, by: Sequence[str], speaker: str, key: str, sizes: DataFrame, walk: Sequence[Column], k: int = 2) -> DataFrame:
    """k recordings per speaker by the bytes they add: none when the row group is needed already, longest first.

    Speakers choose in the order of `walk` (columns that are equal in all rows of a speaker), each all its recordings at
    once; a row group that one of them needs adds nothing for the picks behind it. An unknown size is very large.
    """
    group = [*by, "shard", "row_group"]
    # a table of its own: the walk reads it many times
    rows = cut(null_safe(df, sizes.select(*group, F.col("bytes").alias("group_bytes")), group, "left").withColumns(
        {"scope": joined_key(*by), "person": joined_key(*by, speaker), "place": joined_key(*group)}))
    speakers = rows.groupBy("scope", "person").agg(F.count("*").alias("__n"), F.min(F.struct(*walk, F.col(speaker))).alias("__walk"))
    placed = ranked(speakers, ["scope"], [F.col("__walk")], "__place").withColumn("turn", F.explode(F.sequence(F.lit(1), F.least("__n", F.lit(k)).cast("int"))))
    slots = cut(placed.select("scope", "person", "turn", ((F.col("__place") - 1) * k + F.col("turn")).alias("position")))
    picks = reusing_walk(rows, slots, key, F.coalesce("group_bytes", F.lit(10**12)), [-F.col("duration")])
    return cut(rows.drop("scope", "person", "place").join(picks.select(key, "turn"), key))


def budget_trim(picks: DataFrame, by: str, speaker: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """Drop the last train speaker of the costliest group until the bytes of the needed row groups fit the cap.

    The walk needs no walking. In a group speakers leave from the last turn on, so a row group is freed with the smallest
    turn that uses it, and the cost of the group before each drop is a running total. Costs only fall, so the drops of all
    groups happen in order of (cost before the drop, group, turn), and the cap ends that order at one place of another
    running total. Returns (kept rows, drop log).
    """
    train = F.col("split") == "train"
    lines = cut(picks.select(by, "split", speaker, "turn_speaker", "shard", "row_group", "group_bytes").distinct())
    needs = lines.groupBy(by, "shard", "row_group", "group_bytes").agg(F.max(~train).alias("stays"), F.min(F.when(train, F.col("turn_speaker"))).alias("turn_speaker"))
    costs = needs.groupBy(by).agg(F.sum("group_bytes").alias("__cost"))
    total = costs.agg(F.coalesce(F.sum("__cost"), F.lit(0))).first()[0]
    savings = needs.where("NOT stays").groupBy(by, "turn_speaker").agg(F.sum("group_bytes").alias("__saved"))
    leaving = lines.where(train).select(by, speaker, "turn_speaker").distinct().join(savings, [by, "turn_speaker"], "left").na.fill(0, ["__saved"])
    inside = running(leaving, [by], [F.col("turn_speaker").desc(), F.col(speaker)], __gone=F.col("__saved"))
    steps = inside.join(costs, by).withColumn("__before", F.col("__cost") - F.col("__gone") + F.col("__saved"))
    walk = running(steps, [], [F.col("__before").desc(), F.col(by), F.col("turn_speaker").desc(), F.col(speaker)], __sum=F.col("__saved"), step=F.lit(1))
    log = cut(walk.where(F.lit(total) - F.col("__sum") + F.col("__saved") > cap).select(by, speaker, F.col("step").cast("int").alias("step")))
    return picks.join(log.select(by, speaker).withColumn("split", F.lit("train")), [by, speaker, "split"], "left_anti"), log


def budget_prefix(df: DataFrame, by: Sequence[str], order: Sequence[Column], size: str, cap: int) -> DataFrame:
    """Rows in order while their running size fits the cap: the first that does not fit ends the prefix."""
    return running(df, by, order, total=F.col(size)).withColumn("taken", F.col("total") <= cap)


def progressive_stop(df: DataFrame, by: Sequence[str], shard: str, speaker: str, gender: str, batch: int, min_male: int, min_speakers: int) -> DataFrame:
    """Scan shards in batches until enough speakers are known: the first batch that meets the rule, per group.

    A speaker counts from the first shard it occurs in, so cumulative distinct counts are running sums over shards.
    """
    firsts = df.groupBy(*by, speaker, gender).agg(F.min(shard).alias(shard))
    new = firsts.groupBy(*by, shard).agg(F.count("*").alias("new"), F.count_if(F.col(gender) == "m").alias("new_male"))
    shards = df.select(*by, shard).distinct().join(new, [*by, shard], "left").na.fill(0, ["new", "new_male"])
    known = running(shards, by, [F.col(shard)], number=F.lit(1).cast("bigint"), speakers=F.col("new"), males=F.col("new_male"))
    batches = known.groupBy(*by, F.ceil(F.col("number") / batch).alias("batch")).agg(F.max("speakers").alias("speakers"), F.max("males").alias("males"), F.max("number").alias("shards"))
    met = (F.col("males") >= min_male) & (F.col("speakers") >= min_speakers)
    return batches.groupBy(*by).agg(F.min(F.when(met, F.col("batch"))).alias("stop_batch"), F.min(F.when(met, F.col("shards"))).alias("stop_shards"), F.max("batch").alias("batches"))


def shortfalls(df: DataFrame, by: Sequence[str], targets: dict[str, tuple[Column, int]]) -> DataFrame:
    """How far each group is below its targets, never negative."""
    counts = df.groupBy(*by).agg(*[c.alias(n) for n, (c, _) in targets.items()])
    return counts.select(*by, *[F.greatest(F.lit(0).cast("bigint"), F.lit(t) - F.col(n)).alias(n) for n, (_, t) in targets.items()])


def best_epoch(df: DataFrame, by: Sequence[str], metric: str, reported: str | None = None) -> DataFrame:
    """The earliest epoch with the least metric, and whether the reported one agrees."""
    best = df.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.min(F.struct(F.col(metric).alias("value"), "epoch")).alias("b"), *([F.max(reported).alias("reported")] if reported else []))
    out = best.select(*by, F.col("b.epoch").alias("epoch"), F.col("b.value").alias("value"), *(["reported"] if reported else []))
    return out.withColumn("consistent", F.col("epoch").eqNullSafe(F.col("reported"))) if reported else out


def parity_pick(df: DataFrame, split: str, kind: str, size: str, language: str, key: str) -> DataFrame:
    """A predeclared check sample: shortest and longest per split and kind, then one row for each language not covered."""
    ends = df.groupBy(split, kind).agg(F.min(F.struct(size, key, language)).alias("shortest"), F.max(F.struct(size, key, language)).alias("longest"))
    picks = ends.select(split, kind, F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(f"{n}.{key}").alias(key), F.col(f"{n}.{language}").alias(language)) for n in ("shortest", "longest")])).alias("p"))
    chosen = picks.select(F.concat_ws("_", split, kind, "p.reason").alias("reason"), F.col(f"p.{key}").alias(key), F.col(f"p.{language}").alias(language))
    rest = df.join(chosen.select(language).distinct(), language, "left_anti").groupBy(language).agg(F.min(F.struct(split, key)).alias("f"))
    cover = rest.select(F.concat(F.lit("language_cover:"), language).alias("reason"), F.col(f"f.{key}").alias(key), language)
    return chosen.unionByName(cover).dropDuplicates([key])


def attack_spread(df: DataFrame, by: Sequence[str], speaker: str, attack: str, key: str, seed: str | int, count: int, label: str = "label") -> DataFrame:
    """Genuine rows: distinct speakers first, then the rest in hash order. Spoof rows: attacks in turn with speakers not
    used yet, then the rest in hash order.

    A row needs room for its speaker alone, and a speaker has room for one row: the walk takes the first row of every
    speaker in the order of (turn in the attack, attack). The first GROUP_LIMIT turns of every attack come before all later
    ones, so where they hold `count` speakers no other row is looked at; only the other groups are ranked whole. The rest
    is filled from the first 2 * `count` rows in hash order, of which the walk took at most `count` if they are needed.
    """
    group = [*by, label]
    lane = F.when(F.col(label) == 0, F.lit("")).otherwise(F.coalesce(attack, F.lit("")))
    hashed = df.where(F.col(label).isin(0, 1)).withColumns({"__lane": lane, "__hash": hash_order(seed, key)})
    rest = [c for c in df.columns if c not in group]
    lanes = [*group, "__lane"]
    firsts = lambda turns: turns.groupBy(*group, speaker).agg(F.min(F.struct("turn", "__lane", "__hash", key, *[c for c in rest if c not in (key, speaker)])).alias("f"))
    turns = first_k(hashed, lanes, [F.col("__hash"), F.col(key)], GROUP_LIMIT, "turn").withColumn("turn", F.col("turn").cast("bigint"))
    walked = early = cut(firsts(turns))
    open_ = cut(early.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") < count).select(*group))
    if not open_.isEmpty():
        late = firsts(hash_ranked(null_safe(hashed, open_, group, "left_semi"), lanes, key, seed, "turn"))
        walked = null_safe(early, open_, group, "left_anti").unionByName(late)
    columns = [*group, *[c if c == speaker else F.col(f"f.{c}").alias(c) for c in rest]]
    taken = cut(head(walked, group, [F.col("f")], count, "__place").select(*columns, "__place", F.lit(0).alias("pass")))
    filler = first_k(hashed, group, [F.col("__hash"), F.col(key)], 2 * count, "__place").withColumns({"__place": F.col("__place").cast("bigint"), "pass": F.lit(1)}).drop("__lane", "__hash")
    filler = null_safe(filler, taken.select(*group, key), [*group, key], "left_anti")
    return head(taken.unionByName(filler), group, [F.col("pass"), F.col("__place")], count).drop("__place")
