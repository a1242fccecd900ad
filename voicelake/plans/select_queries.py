"""Registered queries for selection under quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.operators import graph, select
from voicelake.plans import standins as st
from voicelake.plans.join_queries import candidates
from voicelake.plans.registry import query, table
from voicelake.plans.score_queries import CONFUSION, rounded

MAN, INV = f"WITH {st.MANIFEST}", f"WITH {st.INVENTORY}"


@query("cap_per_group", INV + """, r AS (SELECT row_key, speaker, row_number() OVER (PARTITION BY speaker ORDER BY md5(concat('11:', row_key)), row_key) AS rn FROM inventory)
SELECT row_key, speaker, rn <= 5 AS kept FROM r""")
def cap_per_group(spark: SparkSession, folder: str) -> DataFrame:
    return select.cap_per_group(st.inventory(spark, folder).select("row_key", "speaker"), ["speaker"], "row_key", 5, 11)


@query("one_per_cell", MAN + """ SELECT language, label, window_id FROM manifest QUALIFY row_number() OVER (PARTITION BY language, label ORDER BY md5(concat('5:', window_id)), window_id) = 1""")
def one_per_cell(spark: SparkSession, folder: str) -> DataFrame:
    return select.one_per_cell(st.manifest(spark, folder).select("language", "label", "window_id"), ["language", "label"], "window_id", 5)


@query("round_robin", MAN + """ SELECT language, generator, window_id, row_number() OVER (PARTITION BY language, generator ORDER BY md5(concat('rr:', window_id)), window_id) AS turn FROM manifest WHERE label = 1""")
def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder).where("label = 1").select("language", "generator", "window_id")
    return select.round_robin(rows, ["language"], "generator", "window_id", "rr")


@query("quota_trim", MAN + """, t AS (SELECT split, generator, window_id, row_number() OVER (PARTITION BY split, generator ORDER BY md5(concat('trim:', window_id)), window_id) AS turn FROM manifest WHERE label = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY turn, generator) AS position FROM t)
SELECT split, generator, window_id, turn, position, position <= CASE WHEN split = 'train' THEN 900 ELSE 250 END AS kept FROM p""")
def quota_trim(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder).where("label = 1").select("split", "generator", "window_id")
    return select.quota_trim(rows, ["split"], "generator", "window_id", "trim", F.when(F.col("split") == "train", 900).otherwise(250))


@query("select_candidates", MAN + """, s AS (SELECT language, generator, source_speaker, target_speaker, window_id, md5(concat('c:', window_id)) AS h,
  row_number() OVER (PARTITION BY language, generator, source_speaker, target_speaker ORDER BY md5(concat('c:', window_id)), window_id) AS rep FROM manifest WHERE label = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY language, generator ORDER BY rep, h, window_id) AS turn FROM s)
SELECT language, generator, window_id, turn, row_number() OVER (PARTITION BY language ORDER BY turn, generator) AS rank FROM t QUALIFY rank <= 300""")
def select_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder).where("label = 1").select("language", "generator", "source_speaker", "target_speaker", "window_id")
    out = select.select_candidates(rows, ["language"], "generator", ["source_speaker", "target_speaker"], "window_id", "c", 300)
    return out.select("language", "generator", "window_id", "turn", F.col("rank").cast("bigint").alias("rank"))


@query("select_attack_spread")
def select_attack_spread(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder).select("window_id", "language", "label", F.coalesce("speaker", "target_speaker").alias("speaker"), F.coalesce("generator", F.lit("-")).alias("attack"))
    return select.attack_spread(rows, ["language"], "speaker", "attack", "window_id", "la", 400)


@query("choose_pairs")
def choose_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder).where("target_speaker IS NOT NULL")
    pairs = select.choose_pairs(rows, ["language"], 200)
    return select.rows_of_pairs(rows, pairs, ["language"], "row_id", 2).select("language", "pair", "row_id", "place")


@query("select_final_pairs")
def select_final_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder).where("target_speaker IS NOT NULL")
    anchors = st.manifest(spark, folder).where("label = 0 AND split = 'train'").select("language", "speaker")
    return select.select_final_pairs(rows, ["language"], 200, anchors).select("language", "source", "target", "generator", "anchored", "rank")


@query("select_synthetic")
def select_synthetic(spark: SparkSession, folder: str) -> DataFrame:
    """Caps of 2 per source, 2 per target and 20 per component, 500 rows per language."""
    rows = candidates(spark, folder).where("target_speaker IS NOT NULL")
    node = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(":", "language", c))
    named = graph.labeller(graph.star_edges(rows, F.array(node("target_speaker"), node("source_speaker"))))
    label = lambda few: named(few.withColumn("node", node("target_speaker")), "node").drop("node")
    out = select.select_synthetic(rows, ["language"], "row_id", 500, 2, 2, "component", 20, label)
    return out.select("language", "generator", "row_id", "turn", "pass", "rank")


@query("select_genuine", INV.replace("WITH", "WITH RECURSIVE", 1) + """, u AS (SELECT DISTINCT shard, row_group FROM inventory WHERE record_id LIKE '1%' AND duration > 48),
v AS (SELECT *, concat(shard, '/', row_group) AS place, (shard, row_group) IN (FROM u) AS used, count(*) OVER (PARTITION BY language, speaker) AS material FROM inventory WHERE duration BETWEEN 1 AND 30),
s AS (SELECT language, speaker, turn, row_number() OVER (PARTITION BY language ORDER BY turn, material DESC, speaker) AS position
  FROM (SELECT DISTINCT language, speaker, material FROM v), (SELECT unnest([1, 2, 3]) AS turn) WHERE turn <= material QUALIFY position <= 500),
w AS (SELECT DISTINCT language, 0::BIGINT AS position, '' AS speaker, 0 AS turn, '' AS row_key, []::VARCHAR[] AS taken, []::VARCHAR[] AS needed FROM s
  UNION ALL SELECT language, position, speaker, turn, row_key, list_append(taken, row_key), list_append(needed, place) FROM (
    SELECT s.*, v.row_key, v.place, w.taken, w.needed, row_number() OVER (PARTITION BY s.language ORDER BY NOT (used OR list_contains(needed, place)), abs(duration - 5), v.row_key) AS best
    FROM w JOIN s ON s.language = w.language AND s.position = w.position + 1 JOIN v ON v.language = s.language AND v.speaker = s.speaker WHERE NOT list_contains(taken, v.row_key)) WHERE best = 1)
SELECT language, speaker, row_key, turn, position AS rank FROM w WHERE position > 0""")
def select_genuine(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.inventory(spark, folder)
    used = rows.where("record_id LIKE '1%' AND duration > 48")
    return select.select_genuine(rows, ["language"], "row_key", used, 500, 3).select("language", "speaker", "row_key", "turn", "rank")


@query("top_up_genuine", INV + """, m AS (SELECT language, speaker, count(*) AS material, least(count(*), 3) AS offer FROM inventory GROUP BY ALL),
c AS (SELECT *, sum(offer) OVER (PARTITION BY language ORDER BY material DESC, speaker ROWS UNBOUNDED PRECEDING) AS total FROM m),
k AS (SELECT language, speaker, least(offer, 700 - (total - offer)) AS take FROM c WHERE least(offer, 700 - (total - offer)) > 0),
t AS (SELECT *, row_number() OVER (PARTITION BY language, speaker ORDER BY abs(duration - 5), row_key) AS turn FROM inventory)
SELECT language, speaker, row_key, turn FROM t JOIN k USING (language, speaker) WHERE turn <= take""")
def top_up_genuine(spark: SparkSession, folder: str) -> DataFrame:
    return select.top_up_genuine(st.inventory(spark, folder), ["language"], "row_key", 700, 3).select("language", "speaker", "row_key", "turn")


@query("choose_genuine_test", INV + """, c AS (SELECT language, shard, row_group, least(count(DISTINCT speaker) FILTER (gender = 'm'), 20) + least(count(DISTINCT speaker) FILTER (gender = 'f'), 20) AS score, sum(bytes) AS weight FROM inventory GROUP BY ALL),
g AS (SELECT *, row_number() OVER (ORDER BY -score, weight, shard, row_group) AS place FROM c),
r AS (SELECT i.language, i.speaker, i.gender, g.place, i.row_key, i.duration FROM inventory i JOIN g USING (language, shard, row_group)),
s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY language, speaker ORDER BY place, duration DESC, row_key DESC) = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY language, gender ORDER BY place, CAST(speaker AS BIGINT)) AS turn FROM s)
SELECT language, speaker, gender, row_key, row_number() OVER (PARTITION BY language ORDER BY CASE WHEN turn <= 20 THEN 0 ELSE 1 END, place, CAST(speaker AS BIGINT)) AS rank FROM e QUALIFY rank <= 40""")
def choose_genuine_test(spark: SparkSession, folder: str) -> DataFrame:
    return select.choose_genuine_test(st.inventory(spark, folder), ["language"], "row_key", 40).select("language", "speaker", "gender", "row_key", "rank")


@query("choose_isynth_test", MAN + """, t AS (SELECT language, generator, target_speaker, window_id, row_number() OVER (PARTITION BY language, generator
  ORDER BY NOT evidence_verified, sample_rate = 8000, md5(concat('test:', window_id)), window_id) AS turn FROM manifest WHERE label = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY language, target_speaker ORDER BY turn, generator, window_id) AS k FROM t)
SELECT language, generator, target_speaker, window_id, row_number() OVER (PARTITION BY language ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, turn, generator, window_id) AS rank FROM f QUALIFY rank <= 300""")
def choose_isynth_test(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.manifest(spark, folder).where("label = 1").select(
        "language", "generator", "target_speaker", "window_id", F.col("evidence_verified").alias("verified"), F.when(F.col("sample_rate") != 8000, "text").alias("transcript"))
    return select.choose_synthetic_test(rows, ["language"], "window_id", "test", 300).select("language", "generator", "target_speaker", "window_id", "rank")


@query("svarah_spread", INV + """, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language, speaker ORDER BY row_key) AS in_speaker FROM inventory WHERE duration BETWEEN 2 AND 12) WHERE in_speaker <= 2),
a AS (SELECT *, row_number() OVER (PARTITION BY language, shard ORDER BY in_speaker, speaker, row_key) AS in_area FROM o)
SELECT language, shard, speaker, row_key, row_number() OVER (PARTITION BY language ORDER BY in_area, in_speaker, shard, speaker, row_key) AS rank FROM a QUALIFY rank <= 250""")
def svarah_spread(spark: SparkSession, folder: str) -> DataFrame:
    return select.spread(st.inventory(spark, folder), ["language"], "shard", "speaker", "row_key", 2, 250, 2.0, 12.0).select("language", "shard", "speaker", "row_key", "rank")


@query("quota_first_seen", """WITH s AS (SELECT event_type, user_id, min(event_id) AS first FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first, user_id) AS turn FROM s),
w AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS "window" FROM events)
SELECT event_type, user_id, event_id, CASE WHEN turn <= 20 THEN 'train' ELSE 'val' END AS role FROM w JOIN r USING (event_type, user_id) WHERE turn <= 26 AND "window" <= CASE WHEN turn <= 20 THEN 4 ELSE 2 END""")
def quota_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_type", "user_id", "event_id")
    return select.quota_first_seen(rows, ["event_type"], "user_id", "event_id", 20, 6, 4, 2).select("event_type", "user_id", "event_id", "role")


ALLOC = INV + """, m AS (SELECT language, shard, speaker, count(*) AS material FROM inventory GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY language, shard ORDER BY material DESC, CAST(speaker AS BIGINT)) AS turn, count(*) OVER (PARTITION BY language, shard) AS speakers FROM m),
alloc AS (SELECT *, CASE WHEN turn <= CASE WHEN speakers <= 3 THEN 1 ELSE 2 END THEN 'dev' WHEN turn <= CASE WHEN speakers <= 3 THEN 1 ELSE 2 END + 4 THEN 'train' END AS split FROM a)"""


@query("allocate_speakers", ALLOC + " SELECT language, shard, speaker, material, turn, split FROM alloc WHERE split IS NOT NULL")
def allocate_speakers(spark: SparkSession, folder: str) -> DataFrame:
    return select.allocate_speakers(st.inventory(spark, folder), ["language", "shard"], "speaker").select("language", "shard", "speaker", "material", "turn", "split")


def planned_picks(spark: SparkSession, folder: str) -> DataFrame:
    """Allocated speakers with their picked recordings and the bytes of the row groups those need."""
    rows = st.inventory(spark, folder)
    chosen = select.allocate_speakers(rows, ["language"], "speaker").select("language", "speaker", "split", F.col("turn").alias("turn_speaker"))
    sizes = rows.groupBy("language", "shard", "row_group").agg(F.sum("bytes").alias("bytes"))
    own = rows.join(chosen, ["language", "speaker"])
    return select.pick_recordings(own, ["language"], "speaker", "row_key", sizes, [F.col("split") == "dev", F.col("turn_speaker")], 2)


@query("pick_recordings", INV.replace("WITH", "WITH RECURSIVE", 1) + """, m AS (SELECT language, speaker, count(*) AS material FROM inventory GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY material DESC, CAST(speaker AS BIGINT)) AS ts, count(*) OVER (PARTITION BY language) AS speakers FROM m),
z AS (SELECT language, shard, row_group, sum(bytes) AS gb FROM inventory GROUP BY ALL),
s AS (SELECT language, speaker, turn, row_number() OVER (PARTITION BY language ORDER BY ts <= CASE WHEN speakers <= 3 THEN 1 ELSE 2 END, ts, turn) AS position
  FROM a, (SELECT unnest([1, 2]) AS turn) WHERE ts <= CASE WHEN speakers <= 3 THEN 1 ELSE 2 END + 4 AND turn <= material),
o AS (SELECT i.*, gb, concat(shard, '/', row_group) AS place FROM inventory i JOIN z USING (language, shard, row_group)),
w AS (SELECT DISTINCT language, 0::BIGINT AS position, '' AS speaker, 0 AS turn, '' AS row_key, []::VARCHAR[] AS taken, []::VARCHAR[] AS needed FROM s
  UNION ALL SELECT language, position, speaker, turn, row_key, list_append(taken, row_key), list_append(needed, place) FROM (
    SELECT s.*, o.row_key, o.place, w.taken, w.needed,
      row_number() OVER (PARTITION BY s.language ORDER BY NOT list_contains(needed, place), CASE WHEN list_contains(needed, place) THEN 0 ELSE gb END, -duration, o.row_key) AS best
    FROM w JOIN s ON s.language = w.language AND s.position = w.position + 1 JOIN o ON o.language = s.language AND o.speaker = s.speaker WHERE NOT list_contains(taken, o.row_key)) WHERE best = 1)
SELECT language, speaker, row_key, turn FROM w WHERE position > 0""")
def pick_recordings(spark: SparkSession, folder: str) -> DataFrame:
    return planned_picks(spark, folder).select("language", "speaker", "row_key", "turn")


@query("budget_trim")
def budget_trim(spark: SparkSession, folder: str) -> DataFrame:
    """Trim the plan to half of what it would read."""
    picks = planned_picks(spark, folder)
    need = picks.select("language", "shard", "row_group", "group_bytes").distinct().agg(F.sum("group_bytes")).first()[0] or 0
    kept, _ = select.budget_trim(picks, "language", "speaker", need // 2)
    return kept.select("language", "speaker", "split", "row_key", "turn")


@query("budget_prefix", INV + """, s AS (SELECT language, shard, row_group, CAST(sum(bytes) AS BIGINT) AS size FROM inventory GROUP BY ALL),
r AS (SELECT *, CAST(sum(size) OVER (PARTITION BY language ORDER BY shard, row_group ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM s)
SELECT *, total <= 5000000000 AS taken FROM r""")
def budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    sizes = st.inventory(spark, folder).groupBy("language", "shard", "row_group").agg(F.sum("bytes").alias("size"))
    return select.budget_prefix(sizes, ["language"], [F.col("shard"), F.col("row_group")], "size", 5_000_000_000)


@query("progressive_stop", INV + """, f AS (SELECT language, speaker, gender, min(shard) AS shard FROM inventory GROUP BY ALL), n AS (SELECT language, shard, count(*) AS new, count(*) FILTER (gender = 'm') AS male FROM f GROUP BY ALL),
s AS (SELECT DISTINCT language, shard FROM inventory), k AS (SELECT s.language, s.shard, row_number() OVER w AS number, sum(coalesce(new, 0)) OVER w AS speakers, sum(coalesce(male, 0)) OVER w AS males FROM s LEFT JOIN n USING (language, shard)
  WINDOW w AS (PARTITION BY s.language ORDER BY s.shard)),
b AS (SELECT language, CAST(ceil(number / 3) AS BIGINT) AS batch, max(speakers) AS speakers, max(males) AS males, max(number) AS shards FROM k GROUP BY ALL)
SELECT language, min(batch) FILTER (males >= 800 AND speakers >= 2000) AS stop_batch, min(shards) FILTER (males >= 800 AND speakers >= 2000) AS stop_shards, max(batch) AS batches FROM b GROUP BY language""")
def progressive_stop(spark: SparkSession, folder: str) -> DataFrame:
    return select.progressive_stop(st.inventory(spark, folder), ["language"], "shard", "speaker", "gender", 3, 800, 2000)


@query("shortfalls", INV + """ SELECT language, shard, greatest(0, 1300 - count(*)) AS windows, greatest(0, 900 - count(DISTINCT speaker)) AS speakers FROM inventory GROUP BY ALL""")
def shortfalls(spark: SparkSession, folder: str) -> DataFrame:
    return select.shortfalls(st.inventory(spark, folder), ["language", "shard"], {"windows": (F.count("*"), 1300), "speakers": (F.count_distinct("speaker"), 900)})


@query("best_epoch", f"""WITH {st.SCORES}, s AS (SELECT *, concat(language, ':', window_id // 50) AS g FROM scores), {CONFUSION.format(g='g', t=0.5, src='s')},
h AS (SELECT split_part(g, ':', 1) AS language, CAST(split_part(g, ':', 2) AS BIGINT) AS epoch, round((fp + fn) / (tn + fp + fn + tp), 6) AS err FROM m),
b AS (SELECT language, min(err) AS value, 2::BIGINT AS reported FROM h GROUP BY language)
SELECT *, epoch = reported AS consistent FROM (SELECT language, min(epoch) AS epoch, any_value(value) AS value, any_value(reported) AS reported FROM h JOIN b USING (language) WHERE err = value GROUP BY language)""")
def best_epoch(spark: SparkSession, folder: str) -> DataFrame:
    from voicelake.operators.scores import confusion_at
    epochs = st.scores(spark, folder).withColumn("epoch", F.floor(F.col("window_id") / 50))
    history = rounded(confusion_at(epochs, 0.5, ["language", "epoch"]).withColumn("err", (F.col("fp") + F.col("fn")) / (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))), "err")
    return select.best_epoch(history.withColumn("reported", F.lit(2).cast("bigint")), ["language"], "err", "reported")


@query("parity_pick", """WITH d AS (SELECT doc_id, n_chars, lang, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN source = 'src1' THEN 'addition' ELSE 'retained' END AS kind FROM documents),
e AS (SELECT split, kind, doc_id, lang, row_number() OVER (PARTITION BY split, kind ORDER BY n_chars, doc_id) AS lo, row_number() OVER (PARTITION BY split, kind ORDER BY n_chars DESC, doc_id DESC) AS hi FROM d),
p AS (SELECT doc_id, lang FROM e WHERE lo = 1 OR hi = 1),
c AS (SELECT lang, min((split, doc_id)) AS f FROM d WHERE lang NOT IN (SELECT lang FROM p) GROUP BY lang)
SELECT DISTINCT doc_id, lang FROM p UNION SELECT d.doc_id, d.lang FROM c JOIN d ON d.lang = c.lang AND (d.split, d.doc_id) = c.f""")
def parity_pick(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "n_chars", "lang", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"),
                                                    F.when(F.col("source") == "src1", "addition").otherwise("retained").alias("kind"))
    return select.parity_pick(rows, "split", "kind", "n_chars", "lang", "doc_id").select("doc_id", "lang")
