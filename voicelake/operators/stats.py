"""Grouped reports over manifests, inventories and feature tables.

Reports with several key sets first shrink the rows to one record per full key combination, so GROUPING SETS expand the
small table and not the rows. Distinct counts are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.functions.scoring import ratio
from voicelake.operators.prefix import hash_ranked, ranked
from voicelake.session import cut


def group_stats(df: DataFrame, key_sets: Sequence[Sequence[str]], duration: str, speakers: Sequence[str], generator: str, label: str) -> DataFrame:
    """Windows, seconds, minutes and distinct speakers for every key set, long in `key_set`.

    The three measures are computed on pre-aggregated rows; generator and label histograms are `group_histogram`.
    """
    keys = sorted({k for s in key_sets for k in s})
    people = F.array_distinct(F.array_compact(F.array(*[F.col(s) for s in speakers])))
    rows = df.select(*keys, F.col(duration).alias("__d"), people.alias("__p"))
    totals = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum("__d").alias("__s"))
    persons = rows.select(*keys, F.explode("__p").alias("__who")).distinct()
    result = None
    for key_set in key_sets:
        name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in key_set])
        part = totals.groupBy(name.alias("group")).agg(F.sum("__n").alias("windows"), F.sum("__s").alias("seconds"))
        who = persons.groupBy(name.alias("group")).agg(F.count_distinct("__who").alias("speakers"))
        one = part.join(who, "group", "left").select(
            F.lit("|".join(key_set)).alias("key_set"), "group", "windows", F.round("seconds", 3).alias("seconds"),
            F.round(F.col("seconds") / 60, 3).alias("minutes"), F.coalesce("speakers", F.lit(0).cast("bigint")).alias("speakers"))
        result = one if result is None else result.unionByName(one)
    return result


def group_histogram(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Value counts of several columns per group, in long form."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(*keys, values.alias("h")).where("h.value IS NOT NULL").groupBy(*keys, "h.field", "h.value").agg(F.count("*").alias("n"))


def speaker_counts(df: DataFrame, group: str, ids: Mapping[str, Column]) -> DataFrame:
    """Distinct identities per group over several identity columns (arrays or scalars as arrays)."""
    long = df.select(group, F.explode(F.concat(*ids.values())).alias("who")).where("who IS NOT NULL AND who <> ''")
    return long.groupBy(group).agg(F.count_distinct("who").alias("speakers"))


def cube_counts(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts for several column sets in one long table; columns outside a set are NULL there."""
    columns = sorted({c for s in sets for c in s})
    base = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    grouped = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.grouping_id().alias("grouping"), F.sum("__n").alias("n"))


def presence(df: DataFrame, thresholds: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """Counts and whether each reaches its threshold, one row per rule."""
    counts = df.agg(*[c.alias(n) for n, (c, _) in thresholds.items()])
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("bigint").alias("value"), F.lit(t).cast("bigint").alias("need")) for n, (_, t) in thresholds.items()]))
    return counts.select(rules.alias("r")).select("r.rule", "r.value", "r.need", (F.col("r.value") >= F.col("r.need")).alias("ready"))


def identity_stats(keys: DataFrame, windows: DataFrame, listed: Sequence[str] = ("s", "r")) -> DataFrame:
    """(measure, split, language, name, value): who and what the splits hold, what they share, and the mix of their windows.

    `keys` has (split, language, kind, node), `windows` (split, language, label_name, generator). Measures: `unique` keys of a split by
    kind; `sides`, keys by the number of splits they are in (1 is private); `overlap`, each key of the `listed` kinds that two
    splits share; `label` and `generator`, windows of a split and language; `windows` of a split. Keys are grouped once.
    """
    row = lambda df, measure, split, language, name, value: df.select(
        F.lit(measure).alias("measure"), split.alias("split"), language.alias("language"), name.alias("name"), value.cast("bigint").alias("value"))
    none, split, language, n = F.lit(None).cast("string"), F.col("split"), F.col("language"), F.col("n")
    held = cut(keys.groupBy("language", "kind", "node").agg(F.array_sort(F.collect_set("split")).alias("s")))
    unique = held.select("language", "kind", F.explode("s").alias("split")).groupBy("split", "language", "kind").agg(F.count("*").alias("n"))
    sides = held.groupBy("language", "kind", F.size("s").cast("string").alias("split")).agg(F.count("*").alias("n"))
    shared = held.where(F.col("kind").isin(*listed) & (F.size("s") > 1)).select("language", "node", F.explode("s").alias("l"), "s").select("language", "node", "l", F.explode("s").alias("r")).where("l < r")
    mix = windows.groupBy("split", "language", "label_name", "generator").agg(F.count("*").alias("n"))
    by = lambda *names: mix.groupBy(*names).agg(F.sum("n").alias("n"))
    return (row(unique, "unique", split, language, F.col("kind"), n).unionByName(row(sides, "sides", split, language, F.col("kind"), n))
            .unionByName(row(shared, "overlap", F.concat_ws("_", "l", "r"), language, F.col("node"), F.lit(1)))
            .unionByName(row(by("split", "language", "label_name"), "label", split, language, F.col("label_name"), n))
            .unionByName(row(by("split", "language", "generator").where("generator IS NOT NULL"), "generator", split, language, F.col("generator"), n))
            .unionByName(row(by("split"), "windows", split, none, none, n)))


def class_ratios(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    genuine, spoof = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    counts = df.groupBy(*by).agg(genuine.alias("genuine"), spoof.alias("spoof"))
    total = F.col("genuine") + F.col("spoof")
    return counts.select(*by, "genuine", "spoof", ratio(F.col("genuine"), total).alias("genuine_share"), ratio(F.col("spoof"), total).alias("spoof_share"),
                         (F.col("genuine") == F.col("spoof")).alias("balanced"))


def capacity_by_group(df: DataFrame, group: Sequence[str], speaker: str, gender: str, target: int) -> DataFrame:
    """Male and female speakers per row group, and how much of an even selection the group can give."""
    half = max(1, target // 2)
    people = df.select(*group, speaker, gender).distinct()
    counts = people.groupBy(*group).agg(F.count_if(F.col(gender) == "m").alias("males"), F.count_if(F.col(gender) == "f").alias("females"))
    return counts.withColumn("score", F.least("males", F.lit(half)) + F.least("females", F.lit(half))).withColumn("speakers", F.col("males") + F.col("females"))


def discovery_summary(df: DataFrame, by: Sequence[str], speaker: str, gender: str, min_male: int, min_speakers: int) -> DataFrame:
    males = F.count_distinct(F.when(F.col(gender) == "m", F.col(speaker)))
    females = F.count_distinct(F.when(F.col(gender) == "f", F.col(speaker)))
    s = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct(speaker).alias("speakers"), males.alias("male_speakers"), females.alias("female_speakers"))
    return s.withColumn("criteria_met", (F.col("male_speakers") >= min_male) & (F.col("speakers") >= min_speakers))


def frame_moments(frames: DataFrame, vec: str = "vec", floor: float = 1e-6) -> DataFrame:
    """Mean, population variance and clamped scale of every dimension over all frames.

    Exploded values collapse to one partial aggregate per dimension and task before anything is shuffled.
    """
    long = frames.select(F.posexplode_outer(F.transform(vec, lambda x: x.cast("double"))).alias("dim", "x"))
    m = long.groupBy("dim").agg(F.count("*").alias("frames"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
    sd = F.sqrt("variance")
    return m.withColumns({"scale": F.greatest(sd, F.lit(floor)), "clamped": sd < floor})


def pooled_mean(frames: DataFrame, window: str = "window_id", vec: str = "vec") -> DataFrame:
    """Time mean of each window's valid frames, long in `dim`."""
    long = frames.select(window, F.posexplode_outer(F.transform(vec, lambda x: x.cast("double"))).alias("dim", "x"))
    return long.groupBy(window, "dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("*").alias("frames"))


def feature_matrix_stats(frames: DataFrame, window: str = "window_id", frame: str = "frame", vec: str = "vec") -> DataFrame:
    """Per window: frame norm, element mean and deviation, temporal deviation and lag-1 frame correlation.

    Neighbouring frames meet through an equi-join on (window, position), whose keys are unique, so a long window is not
    walked in one task.
    """
    number = lambda x: x.cast("double")
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: number(x) * number(y)), F.lit(0.0), lambda s, x: s + x)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + number(x))
    v = F.col(vec)
    base = frames.groupBy(window).agg(
        F.count("*").alias("frames"), F.avg(F.sqrt(square(v, v))).alias("norm"), F.sum(total(v)).alias("__s"), F.sum(square(v, v)).alias("__q"), F.sum(F.size(v)).alias("__n"))
    base = base.withColumns({"element_mean": F.col("__s") / F.col("__n"),
                             "element_std": F.sqrt((F.col("__q") - F.col("__s") * F.col("__s") / F.col("__n")) / F.nullif(F.col("__n") - 1, F.lit(0)))})
    temporal = pooled_mean(frames, window, vec).groupBy(window).agg(F.avg("std").alias("temporal_std"))
    placed = ranked(frames.select(window, frame, vec), [window], [F.col(frame)], "__p")
    nxt = placed.select(window, (F.col("__p") - 1).alias("__p"), F.col(vec).alias("__next"))
    w = F.col("__next")
    pairs = placed.join(nxt, [window, "__p"]).groupBy(window).agg(
        F.sum(square(v, w)).alias("xy"), F.sum(total(v)).alias("x"), F.sum(total(w)).alias("y"), F.sum(square(v, v)).alias("xx"), F.sum(square(w, w)).alias("yy"), F.sum(F.size(v)).alias("n"))
    corr = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(
        F.nullif((F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y")), F.lit(0.0)))
    return base.drop("__s", "__q", "__n").join(temporal, window).join(pairs.select(window, corr.alias("frame_corr")), window, "left")


def template_stats(frames: DataFrame, window: str = "window_id", vec: str = "vec") -> DataFrame:
    """Across windows: how far their time means differ per dimension, and how the mean template varies over dimensions."""
    means = pooled_mean(frames, window, vec)
    dims = means.groupBy("dim").agg(F.stddev_samp("mean").alias("sd"), F.avg("mean").alias("mu"))
    return dims.agg(F.avg("sd").alias("cross_window_std"), F.stddev_samp("mu").alias("template_std"), F.avg(F.abs("mu")).alias("template_abs"))


def class_separation(vectors: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """Distance of the class means over the within-class spread (d')."""
    long = vectors.select(label, F.posexplode_outer(F.transform(vec, lambda x: x.cast("double"))).alias("dim", "x"))
    m = long.groupBy("dim").agg(*[f(F.when(F.col(label) == c, F.col("x"))).alias(f"{n}{c}") for c in (0, 1) for n, f in (("mu", F.avg), ("var", F.var_pop))])
    d = m.agg(F.sqrt(F.sum(F.pow(F.col("mu1") - F.col("mu0"), 2))).alias("between"), F.avg("var0").alias("s0"), F.avg("var1").alias("s1"))
    return d.select("between", F.sqrt((F.col("s0") + F.col("s1")) / 2).alias("within"), (F.col("between") / F.sqrt(F.col("s0") + F.col("s1") + 1e-30)).alias("d_prime"))


def epoch_order(df: DataFrame, key: str, seed: int, epochs: int, batch: int) -> DataFrame:
    """A shuffled order for every epoch (seed + epoch) cut into batches."""
    runs = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    keyed = runs.withColumn("__key", F.concat_ws(":", (F.col("epoch") + seed).cast("string"), F.col(key).cast("string")))
    placed = hash_ranked(keyed, ["epoch"], "__key", "epoch", "position")
    return placed.withColumn("batch", F.floor((F.col("position") - 1) / batch)).drop("__key")


def batch_composition(ordered: DataFrame, label: str = "label") -> DataFrame:
    """Class mix of the batches of each epoch, and how many batches hold one class only."""
    batches = ordered.groupBy("epoch", "batch").agg(F.count_if(F.col(label) == 0).alias("genuine"), F.count_if(F.col(label) == 1).alias("spoof"))
    return batches.groupBy("epoch", "genuine", "spoof").agg(F.count("*").alias("batches")).withColumn("single_class", (F.col("genuine") == 0) | (F.col("spoof") == 0))
