"""Registered queries for score analytics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.functions import scoring as fs
from voicelake.operators import graph
from voicelake.operators import scores as sc
from voicelake.plans import standins as st
from voicelake.plans.registry import query, table


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


CURVE = """b AS (SELECT {g}, CAST(score AS DOUBLE) AS s, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1
  FROM {src} GROUP BY {g}, s),
c AS (SELECT *, coalesce(sum(n0) OVER w, 0) AS b0, coalesce(sum(n1) OVER w, 0) AS b1,
    sum(n0) OVER (PARTITION BY {g}) AS t0, sum(n1) OVER (PARTITION BY {g}) AS t1
  FROM b WINDOW w AS (PARTITION BY {g} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (t0 - b0) / t0 AS far, 1.0::DOUBLE - (t1 - b1) / t1 AS frr FROM c WHERE t0 > 0 AND t1 > 0)"""

EER = """q AS (SELECT {g}, 0 AS k, NULL AS s, 0.0::DOUBLE AS far, 1.0::DOUBLE AS frr FROM (SELECT DISTINCT {g} FROM p)
  UNION ALL SELECT {g}, 1, s, far, frr FROM p
  UNION ALL SELECT {g}, 2, NULL, 1.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT {g} FROM p)),
r AS (SELECT *, lag(far) OVER v AS lf, lag(far - frr) OVER v AS ld, row_number() OVER v AS i, far - frr AS d
  FROM q WINDOW v AS (PARTITION BY {g} ORDER BY k, s DESC)),
e AS (SELECT {g}, arg_min(lf + CASE WHEN d - ld <= 1e-12 THEN 0 ELSE -ld / (d - ld) END * (far - lf), i) AS eer
  FROM r WHERE i > 1 AND d >= 0 GROUP BY {g})"""


def curve_sql(group: str = "language", src: str = "scores") -> str:
    return f"WITH {st.SCORES}, " + CURVE.format(g=group, src=src)


CONFUSION = """m AS (SELECT {g}, count(*) FILTER (label = 0 AND score < {t}::FLOAT) AS tn, count(*) FILTER (label = 0 AND score >= {t}::FLOAT) AS fp,
  count(*) FILTER (label = 1 AND score < {t}::FLOAT) AS fn, count(*) FILTER (label = 1 AND score >= {t}::FLOAT) AS tp FROM {src} GROUP BY {g})"""


@query("confusion_at", f"WITH {st.SCORES}, {CONFUSION.format(g='language', t=0.5, src='scores')}, " + """
x AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM m)
SELECT language, tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(pr, 6) AS "precision", round(re, 6) AS recall,
  round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1,
  round(CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0 END, 6) AS far, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 6) AS miss FROM x""")
def confusion_at(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sc.confusion_at(st.scores(spark, folder), 0.5, ["language"]), "accuracy", "precision", "recall", "f1", "far", "miss")


@query("error_rates", f"WITH {st.SCORES}, {CONFUSION.format(g='generator', t=0.6, src='scores')}" + """
SELECT generator, round(coalesce(fp / nullif(tn + fp, 0), 0), 6) AS far, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS miss FROM m""")
def error_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sc.error_rates(st.scores(spark, folder), 0.6, ["generator"]), "far", "miss")


@query("det_curve", curve_sql() + """
SELECT language, 'observed' AS place, round(s, 6) AS threshold, round(far, 6) AS far, round(frr, 6) AS frr FROM p
UNION ALL SELECT DISTINCT language, 'start', NULL, 0.0::DOUBLE, 1.0::DOUBLE FROM p UNION ALL SELECT DISTINCT language, 'end', NULL, 1.0::DOUBLE, 0.0::DOUBLE FROM p""")
def det_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sc.det_curve(st.scores(spark, folder), ["language"]), "threshold", "far", "frr")


@query("eer", curve_sql() + ", " + EER.format(g="language") + """
SELECT a.language, round(e.eer, 6) AS eer FROM (SELECT DISTINCT language FROM scores) a LEFT JOIN e USING (language)""")
def eer(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sc.eer(st.scores(spark, folder), ["language"]), "eer")


@query("eer_independent", curve_sql("cohort") + """,
q AS (SELECT cohort, s, far, frr FROM p UNION ALL SELECT DISTINCT cohort, NULL, 0.0::DOUBLE, 1.0::DOUBLE FROM p),
r AS (SELECT *, far - frr AS d, lag(far - frr) OVER v AS ld, lag(far) OVER v AS lf, lag(s) OVER v AS ls, row_number() OVER v AS i
  FROM q WINDOW v AS (PARTITION BY cohort ORDER BY s NULLS LAST)),
x AS (SELECT * FROM r WHERE i > 1 AND ((ld <= 0 AND d >= 0) OR (d <= 0 AND ld >= 0)) QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY i) = 1),
n AS (SELECT cohort, s AS ns, far AS nf, frr AS nr FROM p QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY abs(far - frr), s) = 1)
SELECT cohort, round(lf + CASE WHEN d = ld THEN 0 ELSE -ld / (d - ld) END * (far - lf), 6) AS eer, round(ls, 6) AS lower_threshold,
  round(s, 6) AS upper_threshold, round(CASE WHEN d = ld THEN 0 ELSE -ld / (d - ld) END, 6) AS weight, round(ns, 6) AS nearest_threshold,
  round(nf, 6) AS nearest_far, round(nr, 6) AS nearest_frr, (SELECT count(*) FROM p WHERE p.cohort = x.cohort) AS points
FROM x JOIN n USING (cohort)""")
def eer_independent(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sc.eer_ascending(st.scores(spark, folder), ["cohort"]), "eer", "lower_threshold", "upper_threshold", "weight",
                   "nearest_threshold", "nearest_far", "nearest_frr")


@query("auroc", curve_sql() + """
SELECT language, round(CASE WHEN max(t0) > 0 AND max(t1) > 0 THEN
  (sum(n1 * (b0 + b1 + (n0 + n1 + 1) / 2)) - max(t1) * (max(t1) + 1) / 2) / (max(t0) * max(t1)) END, 6) AS auroc FROM c GROUP BY language""")
def auroc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sc.auroc(st.scores(spark, folder), ["language"]), "auroc")


@query("select_threshold", curve_sql() + """
SELECT language, round(s, 6) AS threshold, round(far, 6) AS far, round(frr, 6) AS miss FROM p
QUALIFY row_number() OVER (PARTITION BY language ORDER BY abs(far - frr), far + frr, s DESC) = 1""")
def select_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sc.select_threshold(st.scores(spark, folder), ["language"]), "threshold", "far", "miss")


GROUPED = """k AS (SELECT score, label, unnest([concat('language:', language), concat('generator:', generator)]) AS group_key FROM scores)"""


@query("subgroup_breakdown", f"WITH {st.SCORES}, {GROUPED}, {CONFUSION.format(g='group_key', t=0.5, src='k')}" + """
SELECT group_key, tn + fp + fn + tp AS windows, tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy,
  round(fp / nullif(tn + fp, 0), 6) AS far, round(fn / nullif(fn + tp, 0), 6) AS miss,
  round(0.5 * ((1 - fn / nullif(fn + tp, 0)) + (1 - fp / nullif(tn + fp, 0))), 6) AS balanced_accuracy FROM m""")
def subgroup_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    report = sc.subgroup_breakdown(st.scores(spark, folder), {"language": "language", "generator": "generator"})
    return rounded(report, "accuracy", "far", "miss", "balanced_accuracy")


def for_margins(text: str) -> str:
    """The curve text under other names, so that both curves fit into one statement."""
    return re.sub(r"FROM ([bcpqr])\b", r"FROM m\1", re.sub(r"\b([bcpqre]) AS \(", r"m\1 AS (", text))


AREA = """CASE WHEN max(t0) > 0 AND max(t1) > 0 THEN (sum(n1 * (b0 + b1 + (n0 + n1 + 1) / 2)) - max(t1) * (max(t1) + 1) / 2) / (max(t0) * max(t1)) END"""
SUMMARY = f"WITH {st.SCORES}, k AS (SELECT window_id, score, label, unnest(['all', concat('language:', language), concat('cohort:', cohort)]) AS group_key FROM scores), " + \
    "km AS (SELECT CAST((score::DOUBLE - 0.5) * (1 + window_id % 3) AS FLOAT) AS score, label, group_key FROM k), " + \
    CURVE.format(g="group_key", src="k") + ", " + EER.format(g="group_key") + ", " + for_margins(CURVE.format(g="group_key", src="km") + ", " + EER.format(g="group_key")) + ", " + \
    CONFUSION.format(g="group_key", t=0.5, src="k") + f""",
a AS (SELECT group_key, {AREA} AS auroc FROM c GROUP BY group_key), am AS (SELECT group_key, {AREA} AS auc_margin FROM mc GROUP BY group_key),
x AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re,
  fp / nullif(tn + fp, 0) AS fa, fn / nullif(fn + tp, 0) AS mi FROM m)
SELECT group_key, tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(pr, 6) AS "precision", round(re, 6) AS recall,
  round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, round(fa, 6) AS far, round(mi, 6) AS miss,
  round(e.eer, 6) AS eer, round(auroc, 6) AS auroc, round(auc_margin, 6) AS auc_margin, round(me.eer, 6) AS eer_margin,
  round(1 - (fa + mi) / 2, 6) AS balanced_accuracy FROM x LEFT JOIN e USING (group_key) LEFT JOIN a USING (group_key) LEFT JOIN me USING (group_key) LEFT JOIN am USING (group_key)"""


@query("subgroup_summarize", SUMMARY)
def subgroup_summarize(spark: SparkSession, folder: str) -> DataFrame:
    """The stand-in margins rank differently from the scores."""
    rows = st.scores(spark, folder).withColumn("margin", (F.col("score").cast("double") - 0.5) * (1 + F.col("window_id") % 3))
    report = sc.subgroup_summarize(rows, {"language": "language", "cohort": "cohort"}, 0.5, "margin")
    return rounded(report, *[c for c in report.columns if c not in ("group_key", "tn", "fp", "fn", "tp")])


@query("cluster_bootstrap", f"WITH {st.SCORES}, {CONFUSION.format(g='generator', t=0.5, src='scores')}" + """,
n AS (SELECT *, row_number() OVER (ORDER BY generator) - 1 AS i, count(*) OVER () AS g FROM m),
s AS (SELECT d.range AS draw, s.range AS slot, CAST(('0x' || substr(md5(concat_ws(':', '20260919', d.range, s.range)), 1, 15)) AS BIGINT)
  % (SELECT count(*) FROM m) AS i FROM range(2000) d, range((SELECT count(*) FROM m)) s),
t AS (SELECT draw, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM s JOIN n USING (i) GROUP BY draw),
l AS (SELECT unnest([{'metric': 'accuracy', 'value': (tn + tp) / (tn + fp + fn + tp)}, {'metric': 'far', 'value': fp / nullif(tn + fp, 0)},
  {'metric': 'miss', 'value': fn / nullif(fn + tp, 0)}]) AS m FROM t)
SELECT m.metric AS metric, round(quantile_cont(m.value, 0.025), 6) AS low, round(quantile_cont(m.value, 0.975), 6) AS high, count(*) AS draws
FROM l WHERE m.value IS NOT NULL GROUP BY m.metric""")
def cluster_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sc.cluster_bootstrap(st.scores(spark, folder), "generator"), "low", "high")


@query("bootstrap_draws")
def bootstrap_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals over relationship components: windows are related by an equal text, or by source, language and length."""
    docs = table(spark, folder, "documents")
    keys = F.array(F.concat(F.lit("t:"), F.md5("text")), F.concat_ws(":", F.lit("l"), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), "n_chars"))
    labels = graph.relationship_components(docs.select(F.col("doc_id").alias("window_id"), keys.alias("keys")), "window_id", F.col("keys"))
    drawn = sc.component_draws(st.scores(spark, folder).join(labels, "window_id"), "component")
    return rounded(sc.draw_intervals(drawn), "low", "high")


@query("history_rows", f"""WITH {st.SCORES}, s AS (SELECT *, window_id // 100 AS epoch FROM scores),
{CONFUSION.format(g='epoch', t=0.5, src='s')}
SELECT epoch, tn, fp, fn, tp, round(fp / nullif(tn + fp, 0), 6) AS far, round(fn / nullif(fn + tp, 0), 6) AS miss,
  round(1 - (fp / nullif(tn + fp, 0) + fn / nullif(fn + tp, 0)) / 2, 6) AS balanced_accuracy FROM m""")
def history_rows(spark: SparkSession, folder: str) -> DataFrame:
    epochs = st.scores(spark, folder).withColumn("epoch", F.floor(F.col("window_id") / 100))
    rows = sc.history_rows(sc.confusion_at(epochs, 0.5, ["epoch"], absent_as_null=True))
    return rounded(rows, "far", "miss", "balanced_accuracy").select("epoch", "tn", "fp", "fn", "tp", "far", "miss", "balanced_accuracy")


LOSS = f"""WITH {st.SCORES}, s AS (SELECT *, CAST(score AS DOUBLE) * 2 - 1 AS margin FROM scores),
l AS (SELECT *, ln(1 + exp(-(2 * label - 1) * margin)) AS loss FROM s)"""


def _losses(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.scores(spark, folder).withColumn("margin", F.col("score").cast("double") * 2 - 1)
    return rows.withColumn("loss", fs.log_loss(F.col("label"), F.col("margin")))


@query("weighted_loss", LOSS + """, b AS (SELECT language, window_id // 8 AS batch, avg(loss) AS loss, count(*) AS n FROM l GROUP BY ALL)
SELECT language, round(sum(loss * n) / sum(n), 6) AS loss FROM b GROUP BY language""")
def weighted_loss(spark: SparkSession, folder: str) -> DataFrame:
    batches = _losses(spark, folder).groupBy("language", F.floor(F.col("window_id") / 8).alias("batch")).agg(
        F.avg("loss").alias("loss"), F.count("*").alias("n"))
    return rounded(sc.weighted_loss(batches, "loss", "n", ["language"]), "loss")


@query("cross_entropy", LOSS + " SELECT language, round(avg(loss), 6) AS cross_entropy FROM l GROUP BY language")
def cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_losses(spark, folder).groupBy("language").agg(F.avg("loss").alias("cross_entropy")), "cross_entropy")


SOFT = f"""WITH {st.SCORES}, s AS (SELECT *, CAST(score AS DOUBLE) * 2 - 1 AS margin FROM scores),
z AS (SELECT *, CAST(1 / (1 + exp(-margin)) AS FLOAT) AS again, CAST(round(1 / (1 + exp(-margin)), 3) AS FLOAT) AS saved FROM s)"""


def _soft(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.scores(spark, folder).withColumn("margin", F.col("score").cast("double") * 2 - 1)
    p = fs.softmax_spoof(F.lit(0.0), F.col("margin"))
    return rows.withColumn("again", p.cast("float")).withColumn("saved", F.round(p, 3).cast("float"))


@query("softmax_audit", SOFT + """, r AS (SELECT *, rank() OVER (ORDER BY saved) AS r1, rank() OVER (ORDER BY CAST(margin AS FLOAT)) AS r2 FROM z)
SELECT count(*) AS n, round(max(abs(again::DOUBLE - saved::DOUBLE)), 6) AS max_diff, round(avg(abs(again::DOUBLE - saved::DOUBLE)), 6) AS mean_diff,
  count(*) FILTER (r1 <> r2) AS discordant FROM r""")
def softmax_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Recomputed against saved probabilities. The rank of a value is 1 + the rows below it, from the two-level counts."""
    rows = _soft(spark, folder).withColumn("one", F.lit(0))
    by_saved = sc.cumulative_scores(rows, (), "saved", "one").select(F.col("score").alias("s"), F.col("b0").alias("r1"))
    by_margin = sc.cumulative_scores(rows, (), "margin", "one").select(F.col("score").alias("m"), F.col("b0").alias("r2"))
    joined = (rows.withColumn("s", fs.score32(F.col("saved"))).withColumn("m", fs.score32(F.col("margin")))
              .join(by_saved, "s").join(by_margin, "m"))
    diff = F.abs(F.col("again").cast("double") - F.col("saved").cast("double"))
    return rounded(joined.agg(F.count("*").alias("n"), F.max(diff).alias("max_diff"), F.avg(diff).alias("mean_diff"),
                              F.count_if(F.col("r1") != F.col("r2")).alias("discordant")), "max_diff", "mean_diff")


@query("tie_count", SOFT + " SELECT language, count(DISTINCT saved) AS distinct_scores, count(DISTINCT CAST(margin AS FLOAT)) AS distinct_margins, count(*) AS n FROM z GROUP BY language")
def tie_count(spark: SparkSession, folder: str) -> DataFrame:
    return _soft(spark, folder).groupBy("language").agg(
        F.count_distinct("saved").alias("distinct_scores"), F.count_distinct(F.col("margin").cast("float")).alias("distinct_margins"), F.count("*").alias("n"))


@query("old_new_decisions", SOFT + """ SELECT language, count(*) AS n,
  count(*) FILTER ((1 / (1 + exp(-margin)) >= 0.6) <> (1 / (1 + exp(-2 * margin)) >= 0.6)) AS changed FROM z GROUP BY language""")
def old_new_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions changed when sigmoid(m) is replaced by the softmax of the logits (-m, m)."""
    m = F.col("margin")
    old = fs.softmax_spoof(F.lit(0.0), m) >= 0.6
    new = fs.softmax_spoof(-m, m) >= 0.6
    return _soft(spark, folder).groupBy("language").agg(F.count("*").alias("n"), F.count_if(old != new).alias("changed"))


@query("distribution_stats", f"""WITH {st.SCORES} SELECT language, count(*) AS count, round(min(score::DOUBLE), 6) AS min, round(max(score::DOUBLE), 6) AS max,
  round(avg(score::DOUBLE), 6) AS mean, round(stddev_pop(score::DOUBLE), 6) AS std, round(quantile_cont(score::DOUBLE, 0.5), 6) AS median, """ + ", ".join(
    f"round(quantile_cont(score::DOUBLE, {p / 100}), 6) AS q{p}" for p in (0, 5, 10, 25, 50, 75, 90, 95, 100)) + " FROM scores GROUP BY language")
def distribution_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = sc.distribution_stats(st.scores(spark, folder), "score", ["language"])
    return rounded(stats, *[c for c in stats.columns if c not in ("language", "count")])


@query("score_histogram", f"""WITH {st.SCORES} SELECT least(CAST(floor(score::DOUBLE * 10) AS BIGINT) + 1, 10) AS bucket,
  count(*) FILTER (label = 0) AS genuine, count(*) FILTER (label = 1) AS spoof FROM scores GROUP BY bucket""")
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    bucket = F.least(F.width_bucket(fs.score32(F.col("score")), F.lit(0.0), F.lit(1.0), F.lit(10)), F.lit(10).cast("bigint"))
    return st.scores(spark, folder).groupBy(bucket.alias("bucket")).agg(
        F.count_if(F.col("label") == 0).alias("genuine"), F.count_if(F.col("label") == 1).alias("spoof"))


@query("chunk_aggregate", f"""WITH {st.CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, chunk) AS r FROM chunks)
SELECT file_id, count(*) AS chunks, round(avg(score), 6) AS mean, round(max(score), 6) AS max, max(chunk) FILTER (r = 1) AS max_chunk,
  round(avg(score) FILTER (r <= 3), 6) AS topk_mean, count(*) FILTER (r <= 3) AS topk_used,
  string_agg(CAST(chunk AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3) AS topk_chunks FROM r GROUP BY file_id""")
def chunk_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sc.chunk_aggregate(st.chunks(spark, folder)), "mean", "max", "topk_mean")


PRED = f"""WITH {st.CHUNKS}, f AS (SELECT file_id, CASE WHEN count(*) > 1 THEN avg(score) END AS score, max(chunk) AS last FROM chunks GROUP BY file_id)"""


@query("decide", PRED + """ SELECT file_id, CASE WHEN score IS NULL THEN 'insufficient' WHEN score >= 0.5 THEN 'spoof' ELSE 'genuine' END AS decision FROM f""")
def decide(spark: SparkSession, folder: str) -> DataFrame:
    files = st.chunks(spark, folder).groupBy("file_id").agg(F.when(F.count("*") > 1, F.avg("score")).alias("score"))
    return files.select("file_id", fs.decide(F.col("score"), 0.5).alias("decision"))


@query("resolve_threshold", PRED + """ SELECT file_id, coalesce(CASE WHEN last % 3 = 0 THEN 0.4 END, CASE WHEN last % 3 = 1 THEN 0.6 END, 0.5)::DOUBLE AS threshold,
  CASE WHEN last % 3 = 0 THEN 'configured' WHEN last % 3 = 1 THEN 'checkpoint' ELSE 'default' END AS origin FROM f""")
def resolve_threshold(spark: SparkSession, folder: str) -> DataFrame:
    files = st.chunks(spark, folder).groupBy("file_id").agg(F.max("chunk").alias("last"))
    value, origin = fs.resolve_threshold(F.when(F.col("last") % 3 == 0, 0.4), F.when(F.col("last") % 3 == 1, 0.6))
    return files.select("file_id", value.alias("threshold"), origin.alias("origin"))


@query("softmax_margin", f"""WITH {st.SCORES} SELECT window_id, round(1 - 3 * score::DOUBLE, 6) AS margin,
  round(1 / (1 + exp(3 * score::DOUBLE - 1)), 6) AS spoof FROM scores""")
def softmax_margin(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("score").cast("double")
    rows = st.scores(spark, folder).select("window_id", (2 * s - 0.5).alias("l0"), (0.5 - s).alias("l1"))
    return rounded(rows.select("window_id", fs.margin(F.col("l0"), F.col("l1")).alias("margin"),
                               fs.softmax_spoof(F.col("l0"), F.col("l1")).alias("spoof")), "margin", "spoof")
