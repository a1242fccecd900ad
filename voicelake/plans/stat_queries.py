"""Registered queries for grouped reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.functions.digests import signature
from voicelake.functions.labels import label_name, reason_prefix
from voicelake.operators import identity, stats
from voicelake.plans import standins as st
from voicelake.plans.graph_queries import CLAIMS
from voicelake.plans.join_queries import ELIGIBLE, eligible_rows
from voicelake.plans.registry import query
from voicelake.plans.score_queries import rounded

MAN, INV, FRAMES = f"WITH {st.MANIFEST}", f"WITH {st.INVENTORY}", f"WITH {st.FRAMES}"
SETS = [["dataset_id"], ["language", "label"], ["split", "generator"], ["split", "language", "label"]]


def _group_sql() -> str:
    parts = []
    for keys in SETS:
        group = "concat_ws('|', " + ", ".join(f"coalesce(CAST({k} AS VARCHAR), 'None')" for k in keys) + ")"
        parts.append(f"""SELECT '{'|'.join(keys)}' AS key_set, t.g AS "group", windows, seconds, minutes, coalesce(speakers, 0) AS speakers FROM
          (SELECT {group} AS g, count(*) AS windows, round(sum(duration), 3) AS seconds, round(sum(duration) / 60, 3) AS minutes FROM manifest GROUP BY g) t
          LEFT JOIN (SELECT {group} AS g, count(DISTINCT who) AS speakers FROM (SELECT *, unnest([speaker, source_speaker, target_speaker]) AS who FROM manifest) WHERE who IS NOT NULL GROUP BY g) p ON p.g = t.g""")
    return f"{MAN} " + " UNION ALL ".join(parts)


@query("group_stats", _group_sql())
def group_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.group_stats(st.manifest(spark, folder), SETS, "duration", ["speaker", "source_speaker", "target_speaker"], "generator", "label")


@query("group_histogram", MAN + """ SELECT split, 'generator' AS field, generator AS value, count(*) AS n FROM manifest WHERE generator IS NOT NULL GROUP BY ALL
UNION ALL SELECT split, 'label', CAST(label AS VARCHAR), count(*) FROM manifest GROUP BY ALL""")
def group_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return stats.group_histogram(st.manifest(spark, folder), ["split"], ["generator", "label"])


@query("pool_counts", MAN + " SELECT dataset_id, CASE split WHEN 'test' THEN 'external_eval' ELSE 'core' END AS pool, split, count(*) AS n FROM manifest GROUP BY ALL")
def pool_counts(spark: SparkSession, folder: str) -> DataFrame:
    pool = F.when(F.col("split") == "test", "external_eval").otherwise("core")
    return st.manifest(spark, folder).groupBy("dataset_id", pool.alias("pool"), "split").agg(F.count("*").alias("n"))


@query("speaker_counts", MAN + " SELECT dataset_id, count(DISTINCT who) AS speakers FROM (SELECT dataset_id, unnest([speaker, source_speaker, target_speaker]) AS who FROM manifest) WHERE who IS NOT NULL GROUP BY dataset_id")
def speaker_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Identities from a map of role to id; gender and other descriptions are not identities."""
    rows = st.manifest(spark, folder).withColumn("ids", F.create_map(F.lit("speaker"), "speaker", F.lit("source"), "source_speaker", F.lit("target"), "target_speaker", F.lit("gender"), "gender"))
    named = F.filter(F.map_entries("ids"), lambda e: ~F.lower(e["key"]).isin("gender", "accent", "background"))
    return stats.speaker_counts(rows, "dataset_id", {"ids": F.transform(named, lambda e: e["value"])})


@query("exclusions_by_reason", ELIGIBLE + " SELECT reason, count(*) AS n FROM z WHERE reason IS NOT NULL GROUP BY reason")
def exclusions_by_reason(spark: SparkSession, folder: str) -> DataFrame:
    return eligible_rows(spark, folder).where("reason IS NOT NULL").groupBy(reason_prefix(F.col("reason")).alias("reason")).agg(F.count("*").alias("n"))


@query("identity_stats", f"WITH {CLAIMS}" + """, k AS (SELECT DISTINCT kind, language, node, split FROM keys), g AS (SELECT kind, language, node, count(*) AS sides FROM k GROUP BY ALL)
SELECT 'unique' AS measure, split, language, kind AS name, count(*) AS value FROM k GROUP BY ALL
UNION ALL SELECT 'sides', CAST(sides AS VARCHAR), language, kind, count(*) FROM g GROUP BY ALL
UNION ALL SELECT 'overlap', concat_ws('_', a.split, b.split), a.language, a.node, 1 FROM k a JOIN k b USING (kind, language, node) WHERE a.split < b.split AND kind IN ('s', 'r')
UNION ALL SELECT 'label', split, language, CASE WHEN label = 0 THEN 'genuine' ELSE 'spoof' END, count(*) FROM manifest GROUP BY ALL
UNION ALL SELECT 'generator', split, language, generator, count(*) FROM manifest WHERE generator IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'windows', split, NULL, NULL, count(*) FROM manifest GROUP BY ALL""")
def identity_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of each split, those that splits share by name, and the labels and generators of each split and language."""
    rows = st.manifest(spark, folder)
    return stats.identity_stats(identity.side_keys(rows), rows.withColumn("label_name", label_name(F.col("label"))))


@query("language_labels", MAN + " SELECT language, split, count(*) FILTER (label = 0) AS genuine, count(*) FILTER (label = 1) AS spoof FROM manifest GROUP BY ALL")
def language_labels(spark: SparkSession, folder: str) -> DataFrame:
    names = st.manifest(spark, folder).withColumn("label_name", label_name(F.col("label")))
    return names.groupBy("language", "split").pivot("label_name", ["genuine", "spoof"]).count().na.fill(0)


@query("lineage_summary", f"WITH {CLAIMS} SELECT role, verification AS status, coalesce(evidence, 'none') AS method, count(*) AS n FROM claims WHERE label = 1 GROUP BY ALL")
def lineage_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder).where("label = 1")
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_verification").alias("status"), F.coalesce(f"{r}_evidence", F.lit("none")).alias("method")) for r in ("source", "target")]))
    return rows.select(roles.alias("r")).groupBy("r.role", "r.status", "r.method").agg(F.count("*").alias("n"))


@query("preprocessing_audit", MAN + """ SELECT label, count(*) FILTER (duration >= 4) AS at_cap, count(*) FILTER (duration < 4) AS below_cap, round(min(active_fraction), 6) AS active_min,
  round(avg(active_fraction), 4) AS active_mean, count(*) FILTER (channels = 2) AS gain_adjusted FROM manifest GROUP BY label""")
def preprocessing_audit(spark: SparkSession, folder: str) -> DataFrame:
    return st.manifest(spark, folder).groupBy("label").agg(
        F.count_if(F.col("duration") >= 4).alias("at_cap"), F.count_if(F.col("duration") < 4).alias("below_cap"), F.round(F.min("active_fraction"), 6).alias("active_min"),
        F.round(F.avg("active_fraction"), 4).alias("active_mean"), F.count_if(F.col("channels") == 2).alias("gain_adjusted"))


@query("revisions_summary", MAN + " SELECT dataset_id, revision, count(*) AS n FROM manifest GROUP BY ALL")
def revisions_summary(spark: SparkSession, folder: str) -> DataFrame:
    return st.manifest(spark, folder).groupBy("dataset_id", "revision").agg(F.count("*").alias("n"))


@query("selection_diagnostics", MAN + """ SELECT language, split, count(*) AS windows, count(DISTINCT generator) AS generators, count(DISTINCT source_speaker) AS sources, count(DISTINCT target_speaker) AS targets,
  count(DISTINCT target_speaker) >= 100 AS enough_speakers, count(DISTINCT generator) >= 3 AS mixed FROM manifest WHERE label = 1 GROUP BY ALL""")
def selection_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    chosen = st.manifest(spark, folder).where("label = 1").groupBy("language", "split").agg(
        F.count("*").alias("windows"), F.count_distinct("generator").alias("generators"), F.count_distinct("source_speaker").alias("sources"), F.count_distinct("target_speaker").alias("targets"))
    return chosen.withColumns({"enough_speakers": F.col("targets") >= 100, "mixed": F.col("generators") >= 3})


@query("readiness_flags", MAN + """, c AS (SELECT count(*) FILTER (split = 'train') AS train_windows, count(*) FILTER (split = 'val') AS val_windows, count(*) FILTER (split = 'val' AND label = 1) AS val_spoof, count(DISTINCT language) AS languages FROM manifest),
r AS (SELECT unnest([{'rule': 'train_windows', 'value': train_windows, 'need': 384}, {'rule': 'val_windows', 'value': val_windows, 'need': 96}, {'rule': 'val_spoof', 'value': val_spoof, 'need': 1}, {'rule': 'languages', 'value': languages, 'need': 12}]) AS r FROM c)
SELECT r.rule AS rule, r.value AS value, CAST(r.need AS BIGINT) AS need, r.value >= r.need AS ready FROM r""")
def readiness_flags(spark: SparkSession, folder: str) -> DataFrame:
    split, label = F.col("split"), F.col("label")
    return stats.presence(st.manifest(spark, folder), {
        "train_windows": (F.count_if(split == "train"), 384), "val_windows": (F.count_if(split == "val"), 96),
        "val_spoof": (F.count_if((split == "val") & (label == 1)), 1), "languages": (F.count_distinct("language"), 12)})


@query("split_totals", MAN + " SELECT split, sample_rate, channels, coalesce(generator, 'genuine') AS generator, count(*) AS windows, count(DISTINCT recording_id) AS recordings, round(sum(duration), 3) AS seconds, round(sum(duration) / 3600, 6) AS hours FROM manifest GROUP BY ALL")
def split_totals(spark: SparkSession, folder: str) -> DataFrame:
    return st.manifest(spark, folder).groupBy("split", "sample_rate", "channels", F.coalesce("generator", F.lit("genuine")).alias("generator")).agg(
        F.count("*").alias("windows"), F.count_distinct("recording_id").alias("recordings"), F.round(F.sum("duration"), 3).alias("seconds"), F.round(F.sum("duration") / 3600, 6).alias("hours"))


@query("split_test_profile", f"WITH {CLAIMS} SELECT language, role, coalesce(p_gender, 'unknown') AS gender, count(*) AS n, count(*) FILTER (declared IS NULL) AS undeclared FROM claims WHERE split = 'test' GROUP BY ALL")
def split_test_profile(spark: SparkSession, folder: str) -> DataFrame:
    claims = identity.role_claims(st.manifest(spark, folder).where("split = 'test'"))
    return claims.groupBy("language", "role", F.coalesce("p.gender", F.lit("unknown")).alias("gender")).agg(F.count("*").alias("n"), F.count_if(F.col("declared").isNull()).alias("undeclared"))


@query("coverage_cube", MAN + """, g AS (SELECT *, coalesce(generator, 'genuine') AS gen FROM manifest)
SELECT split, language, label, gen, sample_rate, CAST(grouping(gen) * 16 + grouping(label) * 8 + grouping(language) * 4 + grouping(sample_rate) * 2 + grouping(split) AS BIGINT) AS grouping, count(*) AS n
FROM g GROUP BY GROUPING SETS ((split, language, label, gen), (split, label, sample_rate), (language, gen))""")
def coverage_cube(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder).withColumn("gen", F.coalesce("generator", F.lit("genuine")))
    return stats.cube_counts(rows, [["split", "language", "label", "gen"], ["split", "label", "sample_rate"], ["language", "gen"]])


@query("inventory_gender", INV + " SELECT language, gender, count(*) AS rows, count(DISTINCT speaker) AS speakers FROM inventory GROUP BY ALL")
def inventory_gender(spark: SparkSession, folder: str) -> DataFrame:
    return st.inventory(spark, folder).groupBy("language", "gender").agg(F.count("*").alias("rows"), F.count_distinct("speaker").alias("speakers"))


@query("cache_counts", MAN + """ SELECT split, language, count(*) AS windows, count(*) FILTER (label = 0) AS genuine, count(*) FILTER (label = 1) AS spoof, count(*) FILTER (preprocessing_version = 'prep-2') AS reused,
  count(*) FILTER (preprocessing_version <> 'prep-2') AS extracted, CAST(sum(CAST(round(duration * 50) AS BIGINT)) AS BIGINT) AS frames FROM manifest GROUP BY ALL""")
def cache_counts(spark: SparkSession, folder: str) -> DataFrame:
    reused = F.col("preprocessing_version") == "prep-2"
    return st.manifest(spark, folder).groupBy("split", "language").agg(
        F.count("*").alias("windows"), F.count_if(F.col("label") == 0).alias("genuine"), F.count_if(F.col("label") == 1).alias("spoof"), F.count_if(reused).alias("reused"),
        F.count_if(~reused).alias("extracted"), F.sum(F.round(F.col("duration") * 50).cast("bigint")).alias("frames"))


@query("class_ratios", MAN + """, c AS (SELECT split, language, count(*) FILTER (label = 0) AS genuine, count(*) FILTER (label = 1) AS spoof FROM manifest GROUP BY ALL)
SELECT *, round(genuine / (genuine + spoof), 6) AS genuine_share, round(spoof / (genuine + spoof), 6) AS spoof_share, genuine = spoof AS balanced FROM c""")
def class_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.class_ratios(st.manifest(spark, folder), "label", ["split", "language"]), "genuine_share", "spoof_share")


SIGN = """s AS (SELECT {g}, sha256({t}) AS h FROM {src}), l AS (SELECT {g}, count(*) AS rows, sum(CAST(('0x' || substr(h, 1, 15)) AS HUGEINT)) AS a, sum(CAST(('0x' || substr(h, 16, 15)) AS HUGEINT)) AS b,
  sum(CAST(('0x' || substr(h, 31, 15)) AS HUGEINT)) AS c, sum(CAST(('0x' || substr(h, 46, 15)) AS HUGEINT)) AS d FROM s GROUP BY {g}),
sig AS (SELECT {g}, rows, sha256(concat_ws(':', rows, CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(c AS VARCHAR), CAST(d AS VARCHAR))) AS signature FROM l)"""


@query("content_signature", MAN + ", " + SIGN.format(g="split", t="concat_ws('|', window_id, label, language, prepared_sha256)", src="manifest") + " SELECT * FROM sig")
def content_signature(spark: SparkSession, folder: str) -> DataFrame:
    return signature(st.manifest(spark, folder), F.concat_ws("|", "window_id", "label", "language", "prepared_sha256"), ["split"])


@query("capacity_by_group", INV + """, c AS (SELECT language, shard, row_group, count(DISTINCT speaker) FILTER (gender = 'm') AS males, count(DISTINCT speaker) FILTER (gender = 'f') AS females FROM inventory GROUP BY ALL)
SELECT *, least(males, 6) + least(females, 6) AS score, males + females AS speakers FROM c""")
def capacity_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return stats.capacity_by_group(st.inventory(spark, folder), ["language", "shard", "row_group"], "speaker", "gender", 12)


@query("discovery_summary", INV + """ SELECT language, count(*) AS rows, count(DISTINCT speaker) AS speakers, count(DISTINCT speaker) FILTER (gender = 'm') AS male_speakers, count(DISTINCT speaker) FILTER (gender = 'f') AS female_speakers,
  count(DISTINCT speaker) FILTER (gender = 'm') >= 20 AND count(DISTINCT speaker) >= 60 AS criteria_met FROM inventory GROUP BY language""")
def discovery_summary(spark: SparkSession, folder: str) -> DataFrame:
    return stats.discovery_summary(st.inventory(spark, folder), ["language"], "speaker", "gender", 20, 60)


@query("exposure_registry", f"""WITH {CLAIMS}, x AS (SELECT kind, node FROM keys WHERE split = 'train' UNION SELECT 'prepared_sha256', prepared_sha256 FROM manifest WHERE split = 'train'
  UNION SELECT 'original_sha256', original_sha256 FROM manifest WHERE split = 'train' UNION SELECT 'window', window_id FROM manifest WHERE split = 'train')
SELECT kind, count(*) AS keys FROM x GROUP BY kind""")
def exposure_registry(spark: SparkSession, folder: str) -> DataFrame:
    from voicelake.operators.audit import exposure_registry as registry
    return registry(st.manifest(spark, folder).where("split = 'train'")).groupBy("kind").agg(F.count("*").alias("keys"))


LONG = ", long AS (SELECT window_id, label, generate_subscripts(vec, 1) - 1 AS dim, unnest(vec)::DOUBLE AS x FROM frames)"


@query("frame_moments", FRAMES + LONG + """ SELECT CAST(dim AS INTEGER) AS dim, count(*) AS frames, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(greatest(stddev_pop(x), 1e-6), 6) AS scale, stddev_pop(x) < 1e-6 AS clamped FROM long GROUP BY dim""")
def frame_moments(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.frame_moments(st.frames(spark, folder)), "mean", "variance", "scale")


@query("pooled_mean", FRAMES + LONG + " SELECT window_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, count(*) AS frames FROM long GROUP BY ALL")
def pooled_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.pooled_mean(st.frames(spark, folder)), "mean", "std")


@query("feature_matrix_stats", FRAMES + LONG + """, t AS (SELECT window_id, avg(s) AS temporal_std FROM (SELECT window_id, dim, stddev_samp(x) AS s FROM long GROUP BY ALL) GROUP BY window_id),
e AS (SELECT window_id, avg(x) AS em, stddev_samp(x) AS es FROM long GROUP BY window_id),
n AS (SELECT window_id, count(*) AS frames, avg(sqrt(list_sum(list_transform(vec, lambda v: v::DOUBLE * v::DOUBLE)))) AS norm FROM frames GROUP BY window_id),
p AS (SELECT window_id, vec, lead(vec) OVER (PARTITION BY window_id ORDER BY frame) AS nx FROM frames),
q AS (SELECT window_id, unnest(vec)::DOUBLE AS a, unnest(nx)::DOUBLE AS b FROM p WHERE nx IS NOT NULL), c AS (SELECT window_id, corr(a, b) AS frame_corr FROM q GROUP BY window_id)
SELECT window_id, frames, round(norm, 6) AS norm, round(em, 6) AS element_mean, round(es, 6) AS element_std, round(temporal_std, 6) AS temporal_std, round(frame_corr, 6) AS frame_corr FROM n JOIN t USING (window_id) JOIN e USING (window_id) LEFT JOIN c USING (window_id)""")
def feature_matrix_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.feature_matrix_stats(st.frames(spark, folder)), "norm", "element_mean", "element_std", "temporal_std", "frame_corr")


@query("template_stats", FRAMES + LONG + """, m AS (SELECT window_id, dim, avg(x) AS mean FROM long GROUP BY ALL), d AS (SELECT dim, stddev_samp(mean) AS sd, avg(mean) AS mu FROM m GROUP BY dim)
SELECT round(avg(sd), 6) AS cross_window_std, round(stddev_samp(mu), 6) AS template_std, round(avg(abs(mu)), 6) AS template_abs FROM d""")
def template_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.template_stats(st.frames(spark, folder)), "cross_window_std", "template_std", "template_abs")


@query("class_separation", FRAMES + LONG + """, m AS (SELECT dim, avg(x) FILTER (label = 0) AS m0, avg(x) FILTER (label = 1) AS m1, var_pop(x) FILTER (label = 0) AS v0, var_pop(x) FILTER (label = 1) AS v1 FROM long GROUP BY dim)
SELECT round(sqrt(sum((m1 - m0) * (m1 - m0))), 6) AS between, round(sqrt((avg(v0) + avg(v1)) / 2), 6) AS within, round(sqrt(sum((m1 - m0) * (m1 - m0))) / sqrt(avg(v0) + avg(v1) + 1e-30), 6) AS d_prime FROM m""".replace(" AS between", ' AS "between"'))
def class_separation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.class_separation(st.frames(spark, folder)), "between", "within", "d_prime")


ORDER = f"""WITH {st.SCORES}, o AS (SELECT window_id, label, e.epoch, row_number() OVER (PARTITION BY e.epoch ORDER BY md5(concat('epoch:', e.epoch + 3, ':', window_id)), concat(e.epoch + 3, ':', window_id)) AS position
  FROM scores, (SELECT unnest([1, 2, 3, 4]) AS epoch) e), b AS (SELECT *, (position - 1) // 8 AS batch FROM o)"""


@query("epoch_order", ORDER + " SELECT epoch, window_id, position, batch FROM b")
def epoch_order(spark: SparkSession, folder: str) -> DataFrame:
    return stats.epoch_order(st.scores(spark, folder), "window_id", 3, 4, 8).select("epoch", "window_id", "position", "batch")


@query("batch_composition", ORDER + """, c AS (SELECT epoch, batch, count(*) FILTER (label = 0) AS genuine, count(*) FILTER (label = 1) AS spoof FROM b GROUP BY ALL)
SELECT epoch, genuine, spoof, count(*) AS batches, genuine = 0 OR spoof = 0 AS single_class FROM c GROUP BY ALL""")
def batch_composition(spark: SparkSession, folder: str) -> DataFrame:
    return stats.batch_composition(stats.epoch_order(st.scores(spark, folder), "window_id", 3, 4, 8))

