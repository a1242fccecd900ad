"""Registered queries for waveforms, windows, fingerprints and feature tables (100 samples per second stand-in)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.functions import signal as fs
from voicelake.operators import blocks
from voicelake.operators import signal as sg
from voicelake.operators import stats
from voicelake.plans import standins as st
from voicelake.plans.registry import query, table
from voicelake.plans.score_queries import rounded

RATE = 100
STRIDE = 1 << 16
POLICY = sg.WindowPolicy(hop_seconds=0.5, frame_ms=40.0, activity_rms=0.2, min_active=0.55, silence_rms=0.25)
SIG = f"WITH {st.SIGNAL}"
PCM = """pcm AS (SELECT doc_id AS id, list_transform(string_split(text, ''), lambda c: CAST(unicode(c) % 256 AS INTEGER)) AS v FROM documents)"""


def _pcm(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.transform(F.split("text", ""), lambda c: F.ascii(c) % 256).alias("v"))


def _pieces(spark: SparkSession, folder: str, overlap: int = 0) -> DataFrame:
    """The waveforms of all documents in pieces."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return blocks.spread(rows, F.length("text"), STRIDE, overlap)


def _piece_samples() -> blocks.Points:
    return st.samples_of(F.col("piece_from"), F.col("piece_samples"))


def _frame_report(spark: SparkSession, folder: str, frame: int, threshold: float) -> DataFrame:
    return blocks.frame_report(_pieces(spark, folder), ["id"], _piece_samples(), frame, threshold)


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    stride = STRIDE // POLICY.samples(RATE)[2] * POLICY.samples(RATE)[2]
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = blocks.spread(rows, F.length("text"), stride, POLICY.samples(RATE)[1])
    return blocks.select_window(pieces, ["id"], _piece_samples(), RATE, POLICY, stride)


@query("pcm_scale", f"WITH {PCM}" + """ SELECT id, round(list_sum(list_transform(v, lambda x: x / 32768.0::DOUBLE)), 6) AS wide, round(list_sum(list_transform(v, lambda x: (x - 128) / 128.0::DOUBLE)), 6) AS narrow, true AS rejected FROM pcm""")
def pcm_scale(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("v")
    out = _pcm(spark, folder).select("id", fs.total(fs.pcm_scale(v, F.lit(16))).alias("wide"), fs.total(fs.pcm_scale(v, F.lit(8))).alias("narrow"), fs.pcm_scale(v, F.lit(24)).isNull().alias("rejected"))
    return rounded(out, "wide", "narrow")


@query("downmix_mono", SIG + " SELECT id, round(list_sum(list_transform(samples, lambda x, i: (x + samples[len(samples) + 1 - i]) / 2 * i)), 4) AS weighted FROM signal")
def downmix_mono(spark: SparkSession, folder: str) -> DataFrame:
    """The clip and its mirror image as two channels."""
    mono = st.signal(spark, folder).select("id", fs.downmix(F.col("samples"), F.reverse("samples")).alias("m"))
    return rounded(mono.select("id", fs.total(F.transform("m", lambda x, i: x * (i + 1))).alias("weighted")), "weighted", digits=4)


@query("overflow_gain", SIG + ", p AS (SELECT id, samples, list_max(list_transform(samples, lambda x: abs(x * 1.5))) AS peak FROM signal) SELECT id, round(CASE WHEN peak > 1 THEN 1 / peak ELSE 1 END, 6) AS gain FROM p")
def overflow_gain(spark: SparkSession, folder: str) -> DataFrame:
    loud = st.signal(spark, folder).select("id", F.transform("samples", lambda x: x * 1.5).alias("loud"))
    return rounded(loud.select("id", fs.overflow_gain(F.col("loud")).alias("gain")), "gain")


@query("overshoot_clip", SIG + """, p AS (SELECT id, list_transform(samples, lambda x: x * 1.6) AS s FROM signal)
SELECT id, list_max(list_transform(s, lambda x: abs(x))) > 1.5 AS rejected, round(CASE WHEN list_max(list_transform(s, lambda x: abs(x))) <= 1.5 THEN list_sum(list_transform(s, lambda x: greatest(-1, least(1, x)))) END, 6) AS total FROM p""")
def overshoot_clip(spark: SparkSession, folder: str) -> DataFrame:
    loud = st.signal(spark, folder).select("id", F.transform("samples", lambda x: x * 1.6).alias("loud"))
    clipped = loud.select("id", fs.overshoot_clip(F.col("loud"), 0.5).alias("c"))
    return rounded(clipped.select("id", F.col("c").isNull().alias("rejected"), fs.total(F.col("c")).alias("total")), "total")


SPANS = """n AS (SELECT doc_id AS id, length(text) AS n FROM documents), s AS (SELECT id, n, unnest(range(0, n, 400)) AS start FROM n),
spans AS (SELECT id, start, least(start + 400, n) AS "end", CASE WHEN least(start + 400, n) - start >= 100 THEN 'chunk' WHEN n < 100 THEN 'too_short' ELSE 'short_tail' END AS kind FROM s)"""


@query("chunk_fixed", f"""WITH {SPANS}, st AS (SELECT id, n, CASE WHEN n = 0 THEN 'empty' WHEN n < 100 THEN 'too_short' ELSE 'ok' END AS status FROM (SELECT id, CASE id % 10 WHEN 0 THEN 0 WHEN 1 THEN 37 ELSE n END AS n FROM n)),
cut AS (SELECT id, n, status, unnest(CASE WHEN n = 0 THEN [NULL] ELSE range(0, n, 400) END) AS start FROM st)
SELECT id, status, start, least(start + 400, n) AS "end", CASE WHEN start IS NULL THEN NULL WHEN least(start + 400, n) - start >= 100 THEN 'chunk' WHEN n < 100 THEN 'too_short' ELSE 'short_tail' END AS kind
FROM (SELECT id, status, start, CASE WHEN start IS NULL THEN NULL ELSE n END AS n FROM cut)""")
def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of every recording with its status; every tenth recording is empty here, and as many are too short."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    cut = rows.withColumn("n", F.when(F.col("id") % 10 == 0, 0).when(F.col("id") % 10 == 1, 37).otherwise(F.col("n")))
    spans = cut.select("id", fs.chunk_status(F.col("n"), 100).alias("status"), F.explode_outer(fs.chunk_spans(F.col("n"), 400, 100)).alias("s"))
    return spans.select("id", "status", "s.*")


@query("chunk_spans_udtf", f"WITH {SPANS} SELECT kind, count(*) AS spans, CAST(sum(\"end\" - start) AS BIGINT) AS samples FROM spans GROUP BY kind")
def chunk_spans_udtf(spark: SparkSession, folder: str) -> DataFrame:
    """The same spans from the SQL table function in a LATERAL join."""
    fs.register_chunk_spans(spark)
    table(spark, folder, "documents").selectExpr("doc_id", "CAST(length(text) AS BIGINT) AS n").createOrReplaceTempView("voicelake_lengths")
    return spark.sql("SELECT kind, count(*) AS spans, sum(end - start) AS samples FROM voicelake_lengths, LATERAL chunk_spans(n, 400, 100) GROUP BY kind")


@query("silence_flag", SIG + """, c AS (SELECT id, unnest(range(0, len(samples), 400)) AS start, samples FROM signal), z AS (SELECT id, start, list_max(list_transform(samples[start + 1:start + 400], lambda x: abs(CASE WHEN x < 0 THEN 0 ELSE x END))) = 0 AS silent FROM c)
SELECT id, count(*) AS chunks, count(*) FILTER (silent) AS silent, bool_and(silent) AS all_silent FROM z GROUP BY id""")
def silence_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Exact-zero chunks of the rectified clip."""
    rect = st.signal(spark, folder).where(F.size("samples") > 0).select("id", F.transform("samples", lambda x: F.greatest(x, F.lit(0.0))).alias("samples"))
    spans = rect.select("id", "samples", fs.chunk_spans(F.size("samples"), 400, 0).alias("spans"))
    flags = spans.select("id", F.transform("spans", lambda s: F.forall(F.slice("samples", s["start"].cast("int") + 1, F.lit(400)), lambda x: x == 0)).alias("f"))
    return flags.select("id", F.size("f").cast("bigint").alias("chunks"), F.size(F.filter("f", lambda b: b)).cast("bigint").alias("silent"), F.forall("f", lambda b: b).alias("all_silent"))


@query("frame_rms", SIG + """, lx AS MATERIALIZED (SELECT id, unnest(samples) AS x, generate_subscripts(samples, 1) - 1 AS p FROM signal), nn AS (SELECT id, len(samples) // 4 AS m FROM signal),
fr AS (SELECT lx.id, p // 4 AS fr, sqrt(avg(x * x)) AS r FROM lx JOIN nn USING (id) WHERE p // 4 < m GROUP BY ALL), g AS (SELECT id, count(*) AS c, avg(r) AS a, count(*) FILTER (r > 0.2) AS k FROM fr GROUP BY id)
SELECT id, m AS frames, round(a, 6) AS mean_rms, round(coalesce(k / c, 0), 6) AS active FROM nn LEFT JOIN g USING (id)""")
def frame_rms(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_frame_report(spark, folder, 4, 0.2), "mean_rms", "active")


@query("active_fraction", SIG + """, lx AS MATERIALIZED (SELECT id, unnest(samples) AS x, generate_subscripts(samples, 1) - 1 AS p FROM signal), nn AS (SELECT id, len(samples) // 8 AS m FROM signal),
fr AS (SELECT lx.id, p // 8 AS fr, sqrt(avg(x * x)) AS r FROM lx JOIN nn USING (id) WHERE p // 8 < m GROUP BY ALL), g AS (SELECT id, count(*) AS c, count(*) FILTER (r > 0.3) AS k FROM fr GROUP BY id)
SELECT id, round(coalesce(k / c, 0), 6) AS active FROM nn LEFT JOIN g USING (id)""")
def active_fraction(spark: SparkSession, folder: str) -> DataFrame:
    """Share of 80 ms frames louder than 0.3."""
    return rounded(_frame_report(spark, folder, 8, 0.3).select("id", "active"), "active")


BEST = """g AS (SELECT id, samples, len(samples) AS n, list_transform(list_distinct(list_concat(range(0, len(samples) - 400 + 1, 50), [len(samples) - 400])), lambda s: {'e': list_sum(list_transform(samples[s + 1:s + 400], lambda x: x * x)), 's': -s}) AS c FROM signal WHERE len(samples) > 400),
w AS (SELECT id, samples, n, CAST(-list_max(c).s AS INTEGER) AS start, CAST(-list_max(c).s + 400 AS INTEGER) AS stop FROM g UNION ALL SELECT id, samples, len(samples), 0, CAST(len(samples) AS INTEGER) FROM signal WHERE len(samples) <= 400),
v AS (SELECT id, n, start, stop, samples[start + 1:stop] AS win FROM w),
fr AS (SELECT *, n < 100 AS short, list_transform(range(0, len(win) // 4), lambda i: sqrt(list_sum(list_transform(win[i * 4 + 1:i * 4 + 4], lambda x: x * x)) / 4)) AS r FROM v),
chosen AS (SELECT id, n, win, short, start, stop, CASE WHEN short THEN 0 ELSE coalesce(sqrt(list_sum(list_transform(win, lambda x: x * x)) / len(win)), 0) END AS rms, CASE WHEN short THEN 0 ELSE list_max(list_transform(win, lambda x: abs(x))) END AS peak,
  CASE WHEN short THEN 0 ELSE coalesce(len(list_filter(r, lambda q: q > 0.2)) / nullif(len(r), 0), 0) END AS active FROM fr),
picked AS (SELECT *, CASE WHEN short THEN 'shorter_than_min_window' WHEN active < 0.55 THEN 'insufficient_speech_activity' END AS reason, short OR rms < 0.25 AS silence FROM chosen)"""


@query("select_window", SIG + ", " + BEST + """ SELECT id, start, stop AS "end", round(rms, 6) AS rms, round(peak, 6) AS peak, round(active, 6) AS active_fraction, silence, reason FROM picked""")
def select_window(spark: SparkSession, folder: str) -> DataFrame:
    out = _windows(spark, folder).select("id", "start", "end", "rms", "peak", "active_fraction", "silence", "reason")
    return rounded(out, "rms", "peak", "active_fraction")


@query("window_facts", SIG + ", " + BEST + """ SELECT id, round(start / 100, 6) AS start_seconds, round(stop / 100, 6) AS end_seconds, round((stop - start) / 100, 6) AS duration_seconds, CAST(round_even(start * 441 / 100.0::DOUBLE, 0) AS BIGINT) AS original_start,
  CAST(round_even(stop * 441 / 100.0::DOUBLE, 0) AS BIGINT) AS original_end FROM picked""")
def window_facts(spark: SparkSession, folder: str) -> DataFrame:
    return sg.window_facts(_windows(spark, folder), RATE, F.lit(441)).select("id", "start_seconds", "end_seconds", "duration_seconds", "original_start", "original_end")


LONG_FRAMES = """lx AS MATERIALIZED (SELECT id, unnest(samples) AS x, generate_subscripts(samples, 1) - 1 AS p FROM signal),
nn AS MATERIALIZED (SELECT id, len(samples) AS n, len(samples) // 4 AS m FROM signal),
ld AS (SELECT lx.id, p // 4 AS fr, x, lag(x) OVER (PARTITION BY lx.id, p // 4 ORDER BY p) AS before FROM lx JOIN nn USING (id) WHERE p // 4 < m),
fr AS MATERIALIZED (SELECT id, fr, sqrt(avg(x * x)) AS r, count(*) FILTER (sign(x) <> sign(before)) / 3.0::DOUBLE AS q FROM ld GROUP BY id, fr)"""
PRINT = LONG_FRAMES + """,
gp AS MATERIALIZED (SELECT id, k, pos - lo AS part, id * 1000000 + lo AS lo, id * 1000000 + least(lo + 1, m - 1) AS hi FROM (SELECT *, least(CAST(floor(pos) AS BIGINT), m - 1) AS lo FROM (SELECT id, m, k, k / 63.0::DOUBLE * (m - 1) AS pos FROM nn, range(0, 64) t(k) WHERE m > 0))),
fk AS MATERIALIZED (SELECT id * 1000000 + fr AS place, r, q FROM fr),
ga AS MATERIALIZED (SELECT g.*, a.r AS r0, a.q AS q0 FROM gp g JOIN fk a ON a.place = g.lo),
gi AS MATERIALIZED (SELECT g.id, g.k, r0 + part * (b.r - r0) AS r, q0 + part * (b.q - q0) AS q FROM ga g JOIN fk b ON b.place = g.hi),
gl AS (SELECT id, k, r AS v FROM gi UNION ALL SELECT id, k + 64, q FROM gi UNION ALL SELECT id, k, 0.0 FROM nn, range(0, 128) t(k) WHERE m = 0),
gn AS (SELECT id, k, CASE WHEN sum(v * v) OVER (PARTITION BY id) > 0 THEN v / sqrt(sum(v * v) OVER (PARTITION BY id)) ELSE v END AS v FROM gl),
prints AS MATERIALIZED (SELECT id, any_value(n) AS n, list(v ORDER BY k) AS fp FROM gn JOIN nn USING (id) GROUP BY id)"""


def _clips(spark: SparkSession, folder: str) -> tuple[DataFrame, blocks.Points]:
    """Documents with a text, and the points of their whole waveforms."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL")
    return rows, st.samples_of(F.lit(0), F.length("text"))


def _prints(spark: SparkSession, folder: str) -> DataFrame:
    rows, points = _clips(spark, folder)
    return blocks.clip_prints(rows, ["id"], points, RATE)


@query("fingerprint_rms_zcr", SIG + ", " + PRINT + " SELECT id, k AS bin, round(fp[k + 1], 6) AS value FROM prints, range(0, 128) t(k)")
def fingerprint_rms_zcr(spark: SparkSession, folder: str) -> DataFrame:
    out = _prints(spark, folder).select("id", F.posexplode_outer("fingerprint").alias("bin", "value"))
    return rounded(out.withColumn("bin", F.col("bin").cast("bigint")), "value")


@query("similarity_pair", SIG + ", " + PRINT + """ SELECT a.id, round(list_dot_product(a.fp, b.fp), 6) AS similarity, round(abs(a.n - b.n) / 100, 6) AS duration_delta, abs(a.n - b.n) / 100 <= 0.05 AND list_dot_product(a.fp, b.fp) >= 0.995 AS hit FROM prints a JOIN prints b ON b.id = a.id + 1""")
def similarity_pair(spark: SparkSession, folder: str) -> DataFrame:
    rows = _prints(spark, folder)
    nxt = rows.select((F.col("id") - 1).alias("id"), F.col("fingerprint").alias("fb"), F.col("duration").alias("db"))
    pair = rows.join(nxt, "id").withColumns({"similarity": fs.dot(F.col("fingerprint"), F.col("fb")), "duration_delta": F.abs(F.col("duration") - F.col("db"))})
    hit = (F.col("duration_delta") <= 0.05) & (F.col("similarity") >= 0.995)
    return rounded(pair.select("id", "similarity", "duration_delta", hit.alias("hit")), "similarity", "duration_delta")


@query("near_dup_band", SIG + ", " + PRINT + """, c AS (SELECT p.id, p.n, p.fp, min(p.id) OVER (PARTITION BY s.samples) AS first FROM prints p JOIN signal s USING (id)), r AS (SELECT * FROM c WHERE id = first)
SELECT a.id AS a, b.id AS b, round(list_dot_product(a.fp, b.fp), 6) AS similarity, round(abs(a.n - b.n) / 100, 6) AS duration_delta, 'near' AS kind FROM r a JOIN r b ON a.id < b.id AND abs(a.n - b.n) <= 5 WHERE list_dot_product(a.fp, b.fp) >= 0.995
UNION ALL SELECT first, id, 1.0::DOUBLE, 0.0::DOUBLE, 'copy' FROM c WHERE id <> first""")
def near_dup_band(spark: SparkSession, folder: str) -> DataFrame:
    out = sg.near_duplicates(_prints(spark, folder), "id", "fingerprint", 128, "duration", "digest")
    return rounded(out, "similarity", "duration_delta")


SKETCH = """lx AS MATERIALIZED (SELECT id, unnest(samples) AS x, generate_subscripts(samples, 1) - 1 AS p, len(samples) // 16 AS m FROM signal WHERE len(samples) >= 32),
fl AS MATERIALIZED (SELECT id, m, p // 16 AS fr, p % 16 AS d, x FROM lx WHERE p // 16 < m),
rw AS (SELECT id, d, avg(x) AS x FROM fl GROUP BY id, d UNION ALL SELECT id, d + 16, stddev_samp(x) FROM fl GROUP BY id, d UNION ALL SELECT id, d + 32, x FROM fl WHERE fr = 0 UNION ALL SELECT id, d + 48, x FROM fl WHERE fr = m - 1),
ce AS (SELECT id, d, x - avg(x) OVER (PARTITION BY d) AS x FROM rw), sk AS (SELECT id, list(x ORDER BY d) AS v, sqrt(sum(x * x)) AS nv FROM ce GROUP BY id),
sn AS MATERIALIZED (SELECT sk.id, list_transform(v, lambda x: x / nv) AS v, md5(text) AS h FROM sk JOIN documents ON doc_id = id)"""


@query("near_dup_top1", SIG + ", " + SKETCH + """, p AS (SELECT a.id, b.id AS neighbour, a.h = b.h AS same, CASE WHEN a.h = b.h THEN 1.0::DOUBLE ELSE round(list_dot_product(a.v, b.v), 9) END AS s FROM sn a JOIN sn b ON a.id <> b.id WHERE list_dot_product(a.v, b.v) > 0.9999)
SELECT id, neighbour, round(s, 6) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY same DESC, s DESC, neighbour) = 1""")
def near_dup_top1(spark: SparkSession, folder: str) -> DataFrame:
    rows, points = _clips(spark, folder)
    return rounded(sg.nearest_neighbour(blocks.clip_sketches(rows, "id", points, 16), "id", "sketch", 64, "digest"), "similarity")


@query("resample_grid", SIG + """, r AS (SELECT id, len(samples) AS n, CAST(ceil(len(samples) * 16 / 25.0::DOUBLE) AS BIGINT) AS m, samples FROM signal)
SELECT id, m AS length, round(list_sum(list_transform(range(0, m), lambda j: (samples[least(CAST(floor(j * 25 / 16.0::DOUBLE) AS BIGINT), n - 1) + 1] + (j * 25 / 16.0::DOUBLE - least(CAST(floor(j * 25 / 16.0::DOUBLE) AS BIGINT), n - 1)) *
  (samples[least(least(CAST(floor(j * 25 / 16.0::DOUBLE) AS BIGINT), n - 1) + 2, n)] - samples[least(CAST(floor(j * 25 / 16.0::DOUBLE) AS BIGINT), n - 1) + 1])) * (j + 1))), 3) AS weighted FROM r""")
def resample_grid(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = blocks.spread(rows, F.length("text"), STRIDE, 0, 16, 25)
    points = blocks.regridded(_piece_samples(), F.lit(16), F.lit(25), F.length("text"))
    sums = pieces.select("id", "grid_size", blocks.weighted_total(points).alias("part")).groupBy("id").agg(F.max("grid_size").alias("length"), F.sum("part").alias("weighted"))
    return rounded(sums, "weighted", digits=3)


@query("dedup_exact", """WITH f AS (SELECT doc_id, source, text, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)
SELECT doc_id, first, CASE WHEN text IN (SELECT text FROM documents WHERE source = 'src2') THEN 'known' WHEN doc_id = first THEN 'kept' ELSE 'duplicate' END AS disposition FROM f""")
def dedup_exact(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return sg.dedup_exact(docs, "doc_id", "digest", docs.where("source = 'src2'")).select("doc_id", "first", "disposition")


@query("standardize_apply", f"WITH {st.FRAMES}, l AS (SELECT frame, generate_subscripts(vec, 1) - 1 AS dim, unnest(vec)::DOUBLE AS x FROM frames), m AS (SELECT dim, avg(x) AS mu, greatest(stddev_pop(x), 1e-6) AS sc FROM l GROUP BY dim)"
       " SELECT frame, CAST(dim AS INTEGER) AS dim, round((x - mu) / sc, 5) AS z FROM l JOIN m USING (dim)")
def standardize_apply(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.frames(spark, folder)
    out = sg.standardize(rows, stats.frame_moments(rows)).select("frame", F.posexplode_outer("vec").alias("dim", "z"))
    return rounded(out, "z", digits=5)


@query("pad_collate", """WITH n AS (SELECT doc_id AS id, doc_id // 8 AS batch, length(text) AS n FROM documents), w AS (SELECT *, max(n) OVER (PARTITION BY batch) AS width FROM n)
SELECT id, batch, CAST(n AS INTEGER) AS valid, CAST(width AS INTEGER) AS width, CAST(width - n AS INTEGER) AS padding FROM w""")
def pad_collate(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.signal(spark, folder).withColumn("batch", F.floor(F.col("id") / 8))
    out = sg.pad_batches(rows, "batch")
    return out.select("id", "batch", "valid", "width", (F.size("samples") - F.col("valid")).alias("padding"))


@query("feature_contract", "SELECT vec_id AS frame, CASE WHEN vec_id % 10 = 0 THEN 'wrong_dimension' WHEN vec_id % 10 = 1 THEN 'non_finite' ELSE 'missing' END AS failure FROM embeddings WHERE vec_id % 10 < 3")
def feature_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows damaged on purpose, and the checks that find them."""
    t = F.col("frame") % 10
    broken = F.when(t == 0, F.slice("vec", 1, 63)).when(t == 1, F.concat(F.slice("vec", 1, 63), F.array(F.lit(float("nan")).cast("float")))).when(t > 2, F.col("vec"))
    rows = st.frames(spark, folder).withColumn("vec", broken)
    return rows.select("frame", F.explode(sg.contract_failures(rows, "vec", 64)).alias("failure"))


@query("signal_validate", "SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'bad_sample_rate' WHEN 2 THEN 'non_finite' WHEN 3 THEN 'out_of_range' END AS problem FROM documents")
def signal_validate(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("id") % 6
    broken = F.when(t == 0, F.array().cast("array<double>")).when(t == 2, F.concat("samples", F.array(F.lit(float("inf"))))).when(t == 3, F.concat("samples", F.array(F.lit(-1.5)))).otherwise(F.col("samples"))
    rows = st.signal(spark, folder).select("id", broken.alias("samples"), F.when(t != 1, RATE).otherwise(0).alias("rate"))
    return rows.select("id", fs.signal_problem(F.col("samples"), F.col("rate")).alias("problem"))


# the same character codes as 16-bit stereo at one, half or twice the rate, right channel mirrored: mono = (v + reversed v) / 2
STEREO = """src AS (SELECT doc_id AS id, source, list_transform(string_split(text, ''), lambda c: CAST((unicode(c) % 256 - 128) * 200 AS INTEGER)) AS l FROM documents WHERE text <> ''),
mono AS (SELECT id, source, list_transform(l, lambda x, i: (x / 32768.0::DOUBLE + l[len(l) + 1 - i] / 32768.0::DOUBLE) / 2) AS m, len(l) AS n FROM src),
signal AS (SELECT id, source, CASE id % 3 WHEN 0 THEN m WHEN 1 THEN list_transform(range(0, 2 * n), lambda j: (m[j // 2 + 1] + m[least(j // 2 + j % 2, n - 1) + 1]) / 2)
  ELSE list_transform(range(0, (n + 1) // 2), lambda j: m[2 * j + 1]) END AS samples FROM mono)"""


@query("prepare_windows", f"WITH {STEREO}, {BEST}" + """, u AS (SELECT id, win FROM picked WHERE reason IS NULL), d AS (SELECT id, CASE WHEN id = min(id) OVER (PARTITION BY win) THEN 'kept' ELSE 'duplicate' END AS disposition FROM u)
SELECT p.id, p.start, p.stop AS "end", round(p.rms, 4) AS rms, round(p.active, 4) AS active_fraction, coalesce(p.reason, d.disposition) AS outcome FROM picked p LEFT JOIN d USING (id)
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'empty' FROM documents WHERE coalesce(text, '') = ''""")
def prepare_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings of three rates in one table."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("rate", F.when(F.col("id") % 3 == 0, RATE).when(F.col("id") % 3 == 1, RATE // 2).otherwise(2 * RATE))
    scale = 1 / 200  # 16-bit integers: 200 times the centred code
    channels = lambda first, count: (st.samples_of(first, count, scale), st.samples_of(first, count, scale, F.reverse("text")))
    nothing = rows.select(F.lit("").alias("digest")).where("digest <> ''")
    out = blocks.prepare_windows(rows, "id", F.length("text"), F.col("rate"), channels, RATE, POLICY, nothing)
    return rounded(out.select("id", "start", "end", "rms", "active_fraction", "outcome"), "rms", "active_fraction", digits=4)


@query("refresh_derived", SIG + ", " + BEST + """, o AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN n_chars ELSE least(n_chars, 400) END AS old, source FROM documents)
SELECT source, count(*) AS rows, count(*) FILTER (old > 400) AS over_before, count(*) FILTER (stop - start > 400) AS over_after, count(*) FILTER (old <> stop - start) AS changed FROM o JOIN picked USING (id) GROUP BY source""")
def refresh_derived(spark: SparkSession, folder: str) -> DataFrame:
    """Recompute window facts where the stored ones are stale: rows, over-length before and after, changed."""
    stored = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.col("n_chars")).otherwise(F.least("n_chars", F.lit(400))).alias("old"), "source")
    fresh = _windows(spark, folder).select("id", (F.col("end") - F.col("start")).alias("new"))
    return stored.join(fresh, "id").groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("old") > 400).alias("over_before"), F.count_if(F.col("new") > 400).alias("over_after"), F.count_if(F.col("old") != F.col("new")).alias("changed"))
