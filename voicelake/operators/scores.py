"""Score analytics: confusion, curves, EER, AUROC, thresholds, subgroup reports, bootstrap, chunk scores.

Class 0 is genuine, class 1 is spoof, a row is called spoof when score >= threshold. FAR is the share of genuine rows
called spoof, miss the share of spoof rows called genuine.

Curves start by counting rows per distinct float32 score with partial aggregation, so neither ties nor a large group
travel as rows. Cumulative counts are two-level prefix sums over order-preserving cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelake.functions.scoring import float_cell, ratio, score32, valid_label
from voicelake.operators.prefix import first_k, null_safe, ranked, running
from voicelake.session import cut


def confusion_counts(df: DataFrame, threshold: float, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """TN, FP, FN, TP per group in one pass."""
    called = F.col(score).cast("float") >= F.lit(threshold).cast("float")
    checked = valid_label(F.col(label), F.col(score))
    genuine, spoof = checked == 0, checked == 1
    return df.groupBy(*by).agg(
        F.count_if(genuine & ~called).alias("tn"), F.count_if(genuine & called).alias("fp"),
        F.count_if(spoof & ~called).alias("fn"), F.count_if(spoof & called).alias("tp"),
    )


def rates(counts: DataFrame, absent_as_null: bool = True) -> DataFrame:
    """Rates from confusion counts. An absent class gives NULL, or 0 with `absent_as_null=False`."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    fill = (lambda c: c) if absent_as_null else (lambda c: F.coalesce(c, F.lit(0.0)))
    precision = F.coalesce(ratio(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(ratio(tp, tp + fn), F.lit(0.0))
    return counts.select(
        "*", ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
        fill(ratio(fp, tn + fp)).alias("far"), fill(ratio(fn, fn + tp)).alias("miss"),
    )


def confusion_at(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), absent_as_null: bool = False,
                 score: str = "score", label: str = "label") -> DataFrame:
    """The whole threshold report of each group."""
    return rates(confusion_counts(df, threshold, by, score, label), absent_as_null)


def error_rates(df: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """FAR and miss only; an absent class counts as 0."""
    return confusion_at(df, threshold, by, absent_as_null=False).select(*by, "far", "miss")


def cumulative_scores(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """One row per group and distinct score: class counts here (n0, n1), below (b0, b1) and in the group (t0, t1)."""
    buckets = (
        df.select(*by, score32(F.col(score)).alias("score"), valid_label(F.col(label), F.col(score)).alias("label"))
        .groupBy(*by, "score")
        .agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
        .withColumn("__cell", float_cell(F.col("score")))
    )
    cells = buckets.groupBy(*by, "__cell").agg(F.sum("n0").alias("__c0"), F.sum("n1").alias("__c1"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(
        *by, "__cell",
        F.coalesce(F.sum("__c0").over(earlier), F.lit(0)).alias("__p0"),
        F.coalesce(F.sum("__c1").over(earlier), F.lit(0)).alias("__p1"),
        F.sum("__c0").over(group).alias("t0"), F.sum("__c1").over(group).alias("t1"),
    )
    inside = Window.partitionBy(*by, "__cell").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    local = buckets.select(
        "*", F.coalesce(F.sum("n0").over(inside), F.lit(0)).alias("__i0"), F.coalesce(F.sum("n1").over(inside), F.lit(0)).alias("__i1")
    )
    return null_safe(local, carried, [*by, "__cell"]).select(
        *by, "score", "n0", "n1", (F.col("__p0") + F.col("__i0")).alias("b0"), (F.col("__p1") + F.col("__i1")).alias("b1"), "t0", "t1"
    )


def _points(cumulative: DataFrame) -> DataFrame:
    """FAR and miss when the threshold is each observed score, for groups with both classes."""
    both = cumulative.where((F.col("t0") > 0) & (F.col("t1") > 0))
    far = (F.col("t0") - F.col("b0")) / F.col("t0")
    frr = 1.0 - (F.col("t1") - F.col("b1")) / F.col("t1")
    return both.withColumn("far", far).withColumn("frr", frr)


def det_curve(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """The curve with both end points: `place` is start (above every score), observed or end (below every score)."""
    points = _points(cumulative_scores(df, by, score, label)).select(
        *by, F.lit("observed").alias("place"), F.col("score").alias("threshold"), "far", "frr"
    )
    groups = points.groupBy(*by).agg(F.count("*").alias("__n"))
    ends = groups.select(*by, F.explode(F.array(
        F.struct(F.lit("start").alias("place"), F.lit(0.0).alias("far"), F.lit(1.0).alias("frr")),
        F.struct(F.lit("end").alias("place"), F.lit(1.0).alias("far"), F.lit(0.0).alias("frr")))).alias("e"))
    return points.unionByName(ends.select(*by, "e.place", F.lit(None).cast("double").alias("threshold"), "e.far", "e.frr"))


def _crossing(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """The two curve points around far = frr. The difference falls as the score grows, so both are plain aggregates."""
    d = F.col("far") - F.col("frr")
    point = F.struct("far", "frr", "score")
    return points.groupBy(*by).agg(
        F.max_by(F.when(d >= 0, point), F.when(d >= 0, F.col("score"))).alias("low"),
        F.min_by(F.when(d < 0, point), F.when(d < 0, F.col("score"))).alias("high"),
        F.min(F.struct(F.abs(d).alias("gap"), F.col("score"), F.col("far"), F.col("frr"))).alias("nearest"),
        F.count("*").alias("points"), F.max("t0").alias("t0"), F.max("t1").alias("t1"),
    )


def _interpolate(left_far: Column, left_d: Column, right_far: Column, right_d: Column, tolerance: float) -> Column:
    weight = F.when(right_d - left_d <= tolerance, 0.0).otherwise(-left_d / F.nullif(right_d - left_d, F.lit(0.0)))
    return left_far + weight * (right_far - left_far)


def eer(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Interpolated equal error rate on the descending curve; NULL for a group with one class."""
    cumulative = cumulative_scores(df, by, score, label)
    crossing = _crossing(_points(cumulative), by)
    left_far = F.coalesce(F.col("high.far"), F.lit(0.0))
    left_d = left_far - F.coalesce(F.col("high.frr"), F.lit(1.0))
    value = _interpolate(left_far, left_d, F.col("low.far"), F.col("low.far") - F.col("low.frr"), 1e-12)
    result = crossing.select(*by, value.alias("eer"))
    if not by:
        return result
    groups = cumulative.groupBy(*by).agg(F.count("*").alias("__n")).drop("__n")
    return null_safe(groups, result, list(by), "left")


def _points64(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """FAR and miss at each distinct float64 score, from running totals in score order."""
    spoof = F.col(label).cast("bigint")
    counted = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(1 - spoof).alias("g"), F.sum(spoof).alias("s"))
    upto = running(counted, list(by), [F.col("score")], __g=F.col("g"), __s=F.col("s"))
    totals = counted.groupBy(*by).agg(F.sum("g").alias("t0"), F.sum("s").alias("t1")).where("t0 > 0 AND t1 > 0")
    joined = null_safe(upto, totals, list(by)) if by else upto.join(totals)
    return joined.select(
        *by, "score", (1 - (F.col("__g") - F.col("g")) / F.col("t0")).alias("far"), ((F.col("__s") - F.col("s")) / F.col("t1")).alias("frr"),
        (F.col("__g") - F.col("g")).alias("b0"), (F.col("__s") - F.col("s")).alias("b1"))


def eer_ascending(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """The crossing swept from the lowest threshold, with both neighbours and the nearest observed point.

    A cross-check of `eer`: it ranks float64 scores with running totals of its own and shares no step with that curve.

    This sweep stops at the first pair of points on both sides of zero, so an observed point with far = frr is the
    right neighbour here, except at the lowest score, where it is the left one.
    """
    points = _points64(df, by, score, label)
    d = F.col("far") - F.col("frr")
    point = F.struct("far", "frr", "score")
    found = points.groupBy(*by).agg(
        F.min(F.struct("score", "far", "frr")).alias("first"),
        F.max_by(F.when(d > 0, point), F.when(d > 0, F.col("score"))).alias("left"),
        F.min_by(F.when(d <= 0, point), F.when(d <= 0, F.col("score"))).alias("right"),
        F.min_by(F.when(F.col("b0") + F.col("b1") > 0, point), F.when(F.col("b0") + F.col("b1") > 0, F.col("score"))).alias("second"),
        F.min(F.struct(F.abs(d).alias("gap"), F.col("score"), F.col("far"), F.col("frr"))).alias("nearest"),
        F.count("*").alias("points"),
    )
    at_first = F.col("first.far") - F.col("first.frr") <= 0
    lf, lr = F.when(at_first, F.col("first.far")).otherwise(F.col("left.far")), F.when(at_first, F.col("first.frr")).otherwise(F.col("left.frr"))
    right = F.when(at_first, F.col("second")).otherwise(F.col("right"))
    rf, rr = F.coalesce(right["far"], F.lit(0.0)), F.coalesce(right["frr"], F.lit(1.0))
    ld, rd = lf - lr, rf - rr
    weight = F.when(rd == ld, 0.0).otherwise(-ld / F.nullif(rd - ld, F.lit(0.0)))
    return found.select(
        *by, (lf + weight * (rf - lf)).alias("eer"),
        F.when(at_first, F.col("first.score")).otherwise(F.col("left.score")).alias("lower_threshold"),
        right["score"].alias("upper_threshold"), weight.alias("weight"),
        F.col("nearest.score").alias("nearest_threshold"), F.col("nearest.far").alias("nearest_far"),
        F.col("nearest.frr").alias("nearest_frr"), "points",
    )


def auroc(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Mann-Whitney area with average ranks for ties; NULL for a group with one class."""
    n = F.col("n0") + F.col("n1")
    rank = F.col("b0") + F.col("b1") + (n + 1) / 2
    sums = cumulative_scores(df, by, score, label).groupBy(*by).agg(
        F.sum(F.col("n1") * rank).alias("__r"), F.max("t0").alias("__t0"), F.max("t1").alias("__t1")
    )
    area = ratio(F.col("__r") - F.col("__t1") * (F.col("__t1") + 1) / 2, F.col("__t0") * F.col("__t1"))
    return sums.select(*by, area.alias("auroc"))


def select_threshold(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """The observed score with the least |FAR - miss|, then the least FAR + miss, then the highest score."""
    points = _points(cumulative_scores(df, by, score, label))
    best = F.min(F.struct(F.abs(F.col("far") - F.col("frr")), F.col("far") + F.col("frr"), (-F.col("score")).alias("minus"),
                          F.col("far").alias("far"), F.col("frr").alias("miss")))
    return points.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.minus")).alias("threshold"), "b.far", "b.miss")


def subgroup_breakdown(df: DataFrame, columns: Mapping[str, str], threshold: float = 0.5) -> DataFrame:
    """Confusion and rates for the values of several columns (`columns`: name of the axis -> column), long form."""
    keys = F.explode(F.array(*[F.concat(F.lit(f"{axis}:"), F.coalesce(F.col(c).cast("string"), F.lit("genuine"))) for axis, c in columns.items()]))
    counts = confusion_counts(df.withColumn("group_key", keys), threshold, ["group_key"])
    r = rates(counts)
    return r.select(
        "group_key", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("windows"), "tn", "fp", "fn", "tp",
        "accuracy", "far", "miss", (0.5 * ((1 - F.col("miss")) + (1 - F.col("far")))).alias("balanced_accuracy"),
    )


def subgroup_summarize(df: DataFrame, columns: Mapping[str, str], threshold: float = 0.5, margin: str | None = None) -> DataFrame:
    """The full metric set of every subgroup: counts, rates, EER and AUROC by score and by margin.

    Rows are keyed by an exploded group key. The cumulative counts per distinct score are written once, and everything
    else is one aggregate over them.
    """
    keys = F.explode(F.array(F.lit("all"), *[F.concat(F.lit(f"{axis}:"), F.coalesce(F.col(c).cast("string"), F.lit("genuine"))) for axis, c in columns.items()]))
    keyed = df.withColumn("group_key", keys)
    whole = _curve_metrics(cut(cumulative_scores(keyed, ["group_key"])), ["group_key"], threshold)
    report = rates(whole.select("group_key", "tn", "fp", "fn", "tp")).join(whole.select("group_key", "eer", "auroc"), "group_key")
    if margin:
        second = _curve_metrics(cut(cumulative_scores(keyed, ["group_key"], margin)), ["group_key"], threshold)
        report = report.join(second.select("group_key", F.col("auroc").alias("auc_margin"), F.col("eer").alias("eer_margin")), "group_key", "left")
    return report.withColumn("balanced_accuracy", 1 - (F.col("far") + F.col("miss")) / 2)


def _curve_metrics(cumulative: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Confusion counts, EER and AUROC of each group in one aggregate over its distinct scores."""
    both = (F.col("t0") > 0) & (F.col("t1") > 0)
    far = F.when(both, (F.col("t0") - F.col("b0")) / F.col("t0"))
    frr = F.when(both, 1.0 - (F.col("t1") - F.col("b1")) / F.col("t1"))
    rows = cumulative.withColumn("far", far).withColumn("frr", frr)
    d, point = F.col("far") - F.col("frr"), F.struct("far", "frr")
    called = F.col("score") >= F.lit(threshold).cast("float").cast("double")
    n0, n1 = F.col("n0"), F.col("n1")
    sums = rows.groupBy(*by).agg(
        F.sum(F.when(called, 0).otherwise(n0)).alias("tn"), F.sum(F.when(called, n0).otherwise(0)).alias("fp"),
        F.sum(F.when(called, 0).otherwise(n1)).alias("fn"), F.sum(F.when(called, n1).otherwise(0)).alias("tp"),
        F.max_by(F.when(d >= 0, point), F.when(d >= 0, F.col("score"))).alias("low"), F.min_by(F.when(d < 0, point), F.when(d < 0, F.col("score"))).alias("high"),
        F.sum(n1 * (F.col("b0") + F.col("b1") + (n0 + n1 + 1) / 2)).alias("r"), F.max("t0").alias("t0"), F.max("t1").alias("t1"))
    left_far = F.coalesce(F.col("high.far"), F.lit(0.0))
    left_d = left_far - F.coalesce(F.col("high.frr"), F.lit(1.0))
    value = _interpolate(left_far, left_d, F.col("low.far"), F.col("low.far") - F.col("low.frr"), 1e-12)
    area = ratio(F.col("r") - F.col("t1") * (F.col("t1") + 1) / 2, F.col("t0") * F.col("t1"))
    return sums.select(*by, "tn", "fp", "fn", "tp", F.when(F.col("low").isNotNull(), value).alias("eer"), area.alias("auroc"))


def quantiles(df: DataFrame, value: str, levels: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles of a float32 column, from cumulative counts instead of collected values.

    One row per group and level.
    """
    ranked = cumulative_scores(df.withColumn("__zero", F.lit(0)), by, value, "__zero")
    position = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("level")) for q in levels]))
    need = ranked.withColumn("q", position).select("*", (F.col("q.level") * (F.col("t0") - 1)).alias("__at"))
    low, high = F.floor("__at"), F.ceil("__at")
    covers = lambda p: (p >= F.col("b0")) & (p < F.col("b0") + F.col("n0"))
    picked = need.where(covers(low) | covers(high)).groupBy(*by, F.col("q.level").alias("level")).agg(
        F.max(F.when(covers(low), F.col("score"))).alias("__lo"), F.max(F.when(covers(high), F.col("score"))).alias("__hi"),
        F.max("__at").alias("__at"),
    )
    part = F.col("__at") - F.floor("__at")
    return picked.select(*by, "level", (F.col("__lo") + part * (F.col("__hi") - F.col("__lo"))).alias("quantile"))


def distribution_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, min, max, mean, population deviation and the usual percentiles, one row per group."""
    levels = {0: "q0", 5: "q5", 10: "q10", 25: "q25", 50: "q50", 75: "q75", 90: "q90", 95: "q95", 100: "q100"}
    x = score32(F.col(value))
    plain = df.groupBy(*by).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"),
                                F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    exact = quantiles(df.where(F.col(value).isNotNull()), value, [p / 100 for p in levels], by)
    wide = exact.groupBy(*by).agg(*[F.max(F.when(F.col("level") == F.lit(p / 100), F.col("quantile"))).alias(n) for p, n in levels.items()])
    if by:
        return null_safe(plain, wide, list(by), "left").withColumn("median", F.col("q50"))
    return plain.select("*", *[wide.select(n).scalar().alias(n) for n in levels.values()]).withColumn("median", F.col("q50"))


def cluster_bootstrap(df: DataFrame, component: str, draws: int = 2000, seed: int = 20260919, threshold: float = 0.5) -> DataFrame:
    """95 % percentile intervals of accuracy, FAR and miss over components resampled with replacement.

    Each component shrinks to its four counts first. Draw b fills as many slots as there are components; slot s takes
    the component numbered by a hash of (seed, b, s), so the draw is repeatable on any partitioning, and SQL can repeat
    it. It makes draws x components rows: it is meant for few components. `component_draws` is for many.
    """
    counts = confusion_counts(df, threshold, [component])
    size = counts.select(F.count("*").alias("g"))
    # components in value order, numbered from 0
    numbered = ranked(counts, [], [F.col(component)], "__n").withColumn("__n", F.col("__n") - 1)
    slots = (
        counts.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0).cast("bigint"), size.scalar() - 1)).alias("slot"))
        .withColumn("__n", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", "slot")), 1, 15), 16, 10).cast("bigint") % size.scalar())
    )
    sums = slots.join(numbered, "__n").groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
    return draw_intervals(sums)


#: Cells, or nodes of the level below, under one node of the tree that a draw goes down.
FAN_OUT = 256
COUNTS = ("tn", "fp", "fn", "tp")


def component_draws(df: DataFrame, component: str, draws: int = 2000, seed: int = 20260919, threshold: float = 0.5, fan_out: int = FAN_OUT) -> DataFrame:
    """(draw, components, tn, fp, fn, tp): components resampled with replacement.

    Components with the same four counts are interchangeable, so a draw needs only how often each distinct cell of counts
    comes up. The cells are the leaves of a tree: a node deals what it got among its children by a multinomial draw, that
    is by binomials conditional on what is left, seeded by (seed, draw, level, node). So a draw is the same on any
    partitioning, no row holds more than `fan_out` numbers, and the work is draws x cells in Spark tasks.
    """
    spark = df.sparkSession
    cells = confusion_counts(df, threshold, [component]).groupBy(*COUNTS).agg(F.count("*").alias("n"))
    level = cut(ranked(cells, [], [F.col(c) for c in COUNTS], "__n").withColumn("__n", F.col("__n") - 1))
    if level.isEmpty():
        return spark.createDataFrame([], "draw bigint, components bigint, tn bigint, fp bigint, fn bigint, tp bigint")
    node = F.floor(F.col("__n") / fan_out)
    below = F.array_sort(F.collect_list(F.struct("__n", "n", *[c for c in COUNTS])))  # fan_out entries
    levels = [cut(level.groupBy(node.alias("node")).agg(below.alias("below"), F.sum("n").alias("n")))]
    while levels[-1].limit(2).count() > 1:
        upper = levels[-1].groupBy(F.floor(F.col("node") / fan_out).alias("above")).agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("below"), F.sum("n").alias("n"))
        levels.append(cut(upper.withColumnRenamed("above", "node")))
    rows = spark.range(draws).select(F.col("id").alias("draw"), F.lit(0).cast("bigint").alias("node")).join(levels[-1].select("node", F.col("n").alias("got")), "node")
    for depth in range(len(levels) - 1, 0, -1):
        dealt = rows.join(levels[depth].select("node", "below"), "node").select("draw", F.transform("below", lambda x: x["node"]).alias("nodes"), _dealt(seed, depth).alias("times"))
        each = dealt.select("draw", F.explode(F.arrays_zip("nodes", "times")).alias("x"))
        rows = each.where("x.times > 0").select("draw", F.col("x.nodes").alias("node"), F.col("x.times").alias("got"))
    leaves = rows.join(levels[0].select("node", "below"), "node").withColumn("times", _dealt(seed, 0))
    drawn = leaves.select("draw", F.col("got").alias("components"), *[_weighted(c).alias(c) for c in COUNTS])
    return drawn.groupBy("draw").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("components", *COUNTS)])


def _weighted(count: str) -> Column:
    return F.aggregate(F.zip_with("times", "below", lambda t, x: t * x[count]), F.lit(0).cast("bigint"), lambda a, v: a + v)


def _dealt(seed: int, level: int) -> Column:
    """How often each entry below a node comes up among the `got` draws of the node."""

    @F.pandas_udf("array<bigint>")
    def times(draw: pd.Series, node: pd.Series, got: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, d, level, k]).multinomial(n, np.asarray(w) / np.sum(w)) for d, k, n, w in zip(draw, node, got, weights)])

    return times("draw", "node", "got", F.transform("below", lambda x: x["n"]))


def draw_intervals(drawn: DataFrame) -> DataFrame:
    """95 % percentile intervals of accuracy, FAR and miss over drawn counts: at most one value per draw and metric."""
    r = rates(drawn.select("tn", "fp", "fn", "tp"))
    long = r.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "far", "miss")])).alias("m"))
    return long.where(F.col("m.value").isNotNull()).groupBy(F.col("m.metric").alias("metric")).agg(
        F.percentile("m.value", F.lit(0.025)).alias("low"), F.percentile("m.value", F.lit(0.975)).alias("high"), F.count("*").alias("draws"))


def history_rows(df: DataFrame) -> DataFrame:
    """Per-epoch rows with balanced accuracy from FAR and miss."""
    return df.withColumn("balanced_accuracy", 1 - (F.col("far") + F.col("miss")) / 2)


def weighted_loss(df: DataFrame, loss: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of batch losses weighted by the examples of each batch."""
    return df.groupBy(*by).agg(ratio(F.sum(F.col(loss) * F.col(weight)), F.sum(weight)).alias("loss"))


def chunk_aggregate(df: DataFrame, file: str = "file_id", chunk: str = "chunk", score: str = "score", top_k: int = 3) -> DataFrame:
    """File scores from chunk scores: mean, max with the chunk used, and the mean of the k best chunks.

    The earlier chunk wins a tie. Mean and max are partial aggregates; only k rows per file and task reach the ranking.
    """
    order = [F.col(score).desc(), F.col(chunk).asc()]
    best = first_k(df, [file], order, top_k, "__r").groupBy(file).agg(
        F.avg(score).alias("topk_mean"), F.count("*").alias("topk_used"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("__r", chunk))), lambda s: s[chunk].cast("string"))).alias("topk_chunks"),
    )
    plain = df.groupBy(file).agg(
        F.count("*").alias("chunks"), F.avg(score).alias("mean"), F.max(score).alias("max"),
        F.max(F.struct(F.col(score), (-F.col(chunk)).alias("c"))).alias("__m"),
    ).withColumn("max_chunk", -F.col("__m.c")).drop("__m")
    return plain.join(best, file)
