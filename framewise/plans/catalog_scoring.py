"""Queries on scoring against references, voice activity and interval files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators import cache, evaluate, features, scoring, segments, vad
from framewise.operators.vad import VadConfig
from framewise.sources import files
from framewise.sources import fixtures as fx

from .catalog import CFG, RATE, S_REF, S_SEG, S_SPK, add, final_segs, ref_dense, segs, speakers

# --- scoring against references -----------------------------------------------------------------------------


def pred(s: SparkSession, d: str) -> DataFrame:
    return evaluate.binarize(fx.predicted_frames(s, d))


def assignment(s: SparkSession, d: str) -> DataFrame:
    r = ref_dense(s, d)
    return evaluate.optimal_assignment(evaluate.pair_counts_beyond(pred(s, d), r, 1))


def errors(s: SparkSession, d: str) -> DataFrame:
    return evaluate.der(fx.predicted_frames(s, d), ref_dense(s, d), 0.5, 3, 1)


def _median(source: str, width: int) -> str:
    r = width // 2
    return f"SELECT rec, frame, track, CASE WHEN sum(active) OVER w * 2 >= count(*) OVER w THEN 1 ELSE 0 END AS active FROM {source} WINDOW w AS (PARTITION BY rec, track ORDER BY frame ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"


S_PRED = "prd AS (SELECT rec, frame, track, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS active FROM fx4)"
S_MASK = S_REF + """,
ch AS (SELECT rec, track, frame, active, CASE WHEN active <> coalesce(lag(active) OVER (PARTITION BY rec, track ORDER BY frame), 0) THEN 1 ELSE 0 END AS c, max(frame) OVER (PARTITION BY rec, track) AS last FROM ref),
bad AS (SELECT DISTINCT rec, frame FROM (SELECT a.rec, b.frame FROM ch a JOIN ref b ON a.rec = b.rec AND a.track = b.track AND b.frame >= a.frame - 1 AND b.frame < a.frame + 1 WHERE a.c = 1 UNION ALL SELECT rec, frame FROM ch WHERE active = 1 AND frame = last) q),
msk AS (SELECT DISTINCT ref.rec, ref.frame, bad.frame IS NULL AS valid FROM ref LEFT JOIN bad ON bad.rec = ref.rec AND bad.frame = ref.frame)"""


def _pairs(p: str) -> str:
    return f"""
pv AS (SELECT p.* FROM {p} p JOIN msk ON msk.rec = p.rec AND msk.frame = p.frame WHERE valid), rv AS (SELECT ref.* FROM ref JOIN msk ON msk.rec = ref.rec AND msk.frame = ref.frame WHERE valid),
pn AS (SELECT rec, track AS pred_track, CAST(sum(active) AS BIGINT) AS pred_frames FROM pv GROUP BY ALL), rn AS (SELECT rec, track AS ref_track, CAST(sum(active) AS BIGINT) AS ref_frames FROM rv GROUP BY ALL),
ov AS (SELECT pv.rec, rv.track AS ref_track, pv.track AS pred_track, count(*) AS overlap FROM pv JOIN rv ON pv.rec = rv.rec AND pv.frame = rv.frame WHERE pv.active = 1 AND rv.active = 1 GROUP BY ALL),
pc AS (SELECT rec, ref_track, pred_track, ref_frames, pred_frames, coalesce(overlap, 0) AS overlap, greatest(ref_frames, pred_frames) - coalesce(overlap, 0) AS cost FROM rn JOIN pn USING (rec) LEFT JOIN ov USING (rec, ref_track, pred_track))"""


#: All one-to-one matchings of at most three reference tracks (there are always three predicted ones).
S_ASSIGN = """
rr AS (SELECT rec, ref_track, dense_rank() OVER (PARTITION BY rec ORDER BY ref_track) - 1 AS lv FROM (SELECT DISTINCT rec, ref_track FROM pc) q),
lp AS (SELECT rec, 0 AS lv, CAST([] AS INT[]) AS path, CAST(0 AS BIGINT) AS cost FROM (SELECT DISTINCT rec FROM pc) q
  UNION ALL SELECT lp.rec, lp.lv + 1, list_append(path, pc.pred_track), lp.cost + pc.cost FROM lp JOIN rr ON rr.rec = lp.rec AND rr.lv = lp.lv JOIN pc ON pc.rec = lp.rec AND pc.ref_track = rr.ref_track WHERE NOT list_contains(path, pc.pred_track)),
bp AS (SELECT rec, path FROM (SELECT lp.*, row_number() OVER (PARTITION BY lp.rec ORDER BY cost, path) AS r FROM lp JOIN (SELECT rec, max(lv) + 1 AS n FROM rr GROUP BY rec) z ON z.rec = lp.rec AND z.n = lp.lv) q WHERE r = 1),
asg AS (SELECT rr.rec, rr.ref_track, path[rr.lv + 1] AS pred_track FROM rr JOIN bp ON bp.rec = rr.rec)"""
S_DER = S_MASK + "," + S_PRED + ", hrd AS (" + _median("prd", 3) + ")," + _pairs("hrd") + "," + S_ASSIGN + """,
fp AS (SELECT h.rec, h.frame, count(*) AS p, count(*) FILTER (r.active = 1) AS o FROM hrd h LEFT JOIN asg a ON a.rec = h.rec AND a.pred_track = h.track LEFT JOIN ref r ON r.rec = h.rec AND r.frame = h.frame AND r.track = a.ref_track WHERE h.active = 1 GROUP BY h.rec, h.frame),
fr AS (SELECT rec, frame, count(*) AS r FROM ref WHERE active = 1 GROUP BY rec, frame),
pf AS (SELECT m.rec, coalesce(r, 0) AS r, coalesce(p, 0) AS p, coalesce(o, 0) AS o FROM msk m LEFT JOIN fr ON fr.rec = m.rec AND fr.frame = m.frame LEFT JOIN fp ON fp.rec = m.rec AND fp.frame = m.frame WHERE valid),
de AS (SELECT rec, CAST(sum(r) AS DOUBLE) AS scored, CAST(sum(greatest(r - p, 0)) AS DOUBLE) AS miss, CAST(sum(greatest(p - r, 0)) AS DOUBLE) AS false_alarm, CAST(sum(least(r, p) - o) AS DOUBLE) AS error FROM pf GROUP BY rec)"""
V = ("fx3", "fx4")

add("s2_speaker_order", lambda s, d: evaluate.speaker_order(fx.turns(s, d), "turn"), "SELECT rec, speaker, CAST(row_number() OVER (PARTITION BY rec ORDER BY f, speaker) - 1 AS INT) AS track FROM (SELECT rec, speaker, min(turn) AS f FROM fx2 GROUP BY rec, speaker) q", "fx2")
add("j1_rasterize", ref_dense, "WITH " + S_REF + " SELECT * FROM ref", "fx3")
add("j2_encode_speakers", lambda s, d: evaluate.encode_speakers(fx.turns(s, d), evaluate.speaker_order(fx.turns(s, d), "turn").where("track < 2")).select("rec", "turn", "speaker", "track"),
    "WITH o AS (SELECT rec, speaker, CAST(row_number() OVER (PARTITION BY rec ORDER BY f, speaker) - 1 AS INT) AS track FROM (SELECT rec, speaker, min(turn) AS f FROM fx2 GROUP BY rec, speaker) q) SELECT rec, turn, speaker, track FROM fx2 JOIN o USING (rec, speaker) WHERE track < 2", "fx2")
add("w3_median_filter", lambda s, d: evaluate.median_filter(pred(s, d), 4), "WITH " + S_PRED + " " + _median("prd", 5), *V)
add("w4_collar_mask", lambda s, d: evaluate.collar_mask(ref_dense(s, d), 1), "WITH " + S_MASK + " SELECT * FROM msk", "fx3")
add("j5_pair_counts", lambda s, d: evaluate.pair_counts(pred(s, d), ref_dense(s, d), evaluate.collar_mask(ref_dense(s, d), 1)).select("rec", "ref_track", "pred_track", "ref_frames", "pred_frames", "overlap", "cost"), "WITH " + S_MASK + "," + S_PRED + "," + _pairs("prd") + " SELECT * FROM pc", *V)
add("a4_optimal_assignment", assignment, "WITH " + S_MASK + "," + S_PRED + "," + _pairs("prd") + "," + S_ASSIGN + " SELECT * FROM asg", *V, recursive=True)
add("j6_apply_assignment", lambda s, d: evaluate.apply_assignment(pred(s, d), assignment(s, d), ref_dense(s, d)),
    "WITH " + S_MASK + "," + S_PRED + "," + _pairs("prd") + "," + S_ASSIGN + " SELECT g.rec, g.frame, g.track, coalesce(p.active, 0) AS active FROM ref g LEFT JOIN asg a ON a.rec = g.rec AND a.ref_track = g.track LEFT JOIN prd p ON p.rec = g.rec AND p.frame = g.frame AND p.track = a.pred_track", *V, recursive=True)
add("j7_unmatched_tracks", lambda s, d: evaluate.unmatched_tracks(pred(s, d), assignment(s, d)),
    "WITH " + S_MASK + "," + S_PRED + "," + _pairs("prd") + "," + S_ASSIGN + " SELECT DISTINCT p.rec, p.track FROM prd p WHERE NOT EXISTS (SELECT 1 FROM asg a WHERE a.rec = p.rec AND a.pred_track = p.track)", *V, recursive=True)
_DER = "CASE WHEN scored > 0 THEN (miss + false_alarm + error) / scored ELSE 0.0::DOUBLE END AS der"
add("a3_der", errors, "WITH " + S_DER + f" SELECT *, {_DER} FROM de", *V, recursive=True)
add("a5_corpus_der", lambda s, d: evaluate.corpus_der(errors(s, d).withColumn("dataset", F.col("rec") % 4), "dataset"),
    "WITH " + S_DER + f", t AS (SELECT rec % 4 AS dataset, sum(scored) AS scored, sum(miss) AS miss, sum(false_alarm) AS false_alarm, sum(error) AS error FROM de GROUP BY ROLLUP (rec % 4)) SELECT *, {_DER} FROM t", *V, recursive=True)

# --- interval files and summaries ---------------------------------------------------------------------------


def rttm(s: SparkSession, d: str) -> DataFrame:
    return fx.turns(s, d).select("turn", F.format_string("SPEAKER %s  1 %s %s <NA> <NA> %s <NA>%s", F.col("rec").cast("string"), F.when(F.col("turn") % 5 == 4, F.lit("x")).otherwise(F.col("start").cast("string")), F.col("dur").cast("string"), F.col("speaker"), F.when(F.col("turn") % 7 == 6, F.lit("")).otherwise(F.lit(" <NA>"))).alias("value"))


add("s1_parse_rttm", lambda s, d: files.parse_rttm(rttm(s, d).withColumn("value", F.when(F.col("turn") % 6 == 5, F.lit("SPEAKER short line")).otherwise(F.col("value"))), "turn").select("rec", "turn", "start", "duration", "speaker"),
    "SELECT CAST(rec AS VARCHAR) AS rec, turn, CASE WHEN turn % 5 = 4 THEN 0.0::DOUBLE ELSE start END AS start, dur AS duration, speaker FROM fx2 WHERE turn % 6 <> 5", "fx2")
add("s3_to_rttm_lines", lambda s, d: files.to_rttm_lines(segments.runs(pred(s, d)), s.createDataFrame([(t, n) for n, t in fx.SPEAKERS[:2]], "track int, label string").join(pred(s, d).select("rec").distinct()), 1.0).select("rec", "place", "value"),
    """WITH r AS (SELECT rec, track, min(frame) AS a, max(frame) + 1 AS b FROM (SELECT *, frame - row_number() OVER (PARTITION BY rec, track ORDER BY frame) AS g FROM fx4 WHERE prob > 0.5) q GROUP BY rec, track, g)
    SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY track, a) AS INT) AS place, printf('SPEAKER %d 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', rec, CAST(a AS DOUBLE), CAST(b - a AS DOUBLE), CASE track WHEN 0 THEN 'user' WHEN 1 THEN 'system' ELSE 'spk' || track END) AS value FROM r""", "fx4")
add("s6_session_summary", lambda s, d: files.session_summary(fx.activity(s, d), segs(s, d), RATE, 0.5, 11),
    "WITH " + S_SEG + ", f AS (SELECT rec, track, min(start_frame) AS f FROM seg GROUP BY rec, track), o AS (SELECT rec, count(*) AS n, string_agg(CAST(track AS VARCHAR), ',' ORDER BY f, track) AS o FROM f GROUP BY rec) SELECT z.rec, z.n / 12.5::DOUBLE AS seconds, 12.5::DOUBLE AS frame_hz, 0.5::DOUBLE AS threshold, 11 AS median_width, coalesce(o.n, 0) AS speakers, coalesce(o.o, '') AS display_order FROM (SELECT rec, max(frame) + 1 AS n FROM fx1 GROUP BY rec) z LEFT JOIN o ON o.rec = z.rec", "fx1")

# --- voice activity -----------------------------------------------------------------------------------------

VC = VadConfig(threshold=0.85, offset=0.35, min_speech=0.3, min_silence=0.5, pad=0.4)
S_VAD = f"""
va AS (SELECT rec, chunk, prob, sum(CASE WHEN prob >= 0.85 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY chunk) AS g, (max(chunk) OVER (PARTITION BY rec) + 1) * 4096 AS total FROM fx7),
vg AS (SELECT rec, g, min(chunk) * 4096 AS s, min(CASE WHEN prob < {VC.exit!r} THEN chunk * 4096 END) AS t0, max(CASE WHEN prob < {VC.exit!r} THEN chunk * 4096 END) AS t1, max(total) AS total FROM va WHERE g > 0 GROUP BY rec, g),
ve AS (SELECT *, coalesce(t1 - t0 >= 8000, false) AS e FROM vg),
vp AS (SELECT *, coalesce(sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM ve),
reg AS (SELECT rec, CAST(min(s) AS BIGINT) AS start_sample, CAST(coalesce(max(CASE WHEN e THEN t0 END), max(total)) AS BIGINT) AS end_sample, max(total) AS total FROM vp GROUP BY rec, part),
rgn AS (SELECT * FROM reg WHERE end_sample - start_sample >= 4800)"""


def totals(s: SparkSession, d: str) -> DataFrame:
    return fx.voice(s, d).groupBy("rec").agg(((F.max("chunk") + 1) * vad.CHUNK).alias("total"))


def padded(s: SparkSession, d: str) -> DataFrame:
    return vad.pad_regions(vad.speech_regions(fx.voice(s, d), VC), totals(s, d), vad.samples(VC.pad))


add("w8_speech_regions", lambda s, d: vad.speech_regions(fx.voice(s, d), VC), "WITH " + S_VAD + " SELECT rec, start_sample, end_sample FROM rgn", "fx7")
add("w9_split_regions", lambda s, d: vad.split_regions(fx.voice(s, d), VadConfig(threshold=0.5, offset=0.2, min_speech=0.1, max_speech=5.0)))
add("w10_pad_regions", padded,
    "WITH " + S_VAD + """, nb AS (SELECT *, start_sample - lag(end_sample) OVER w AS gb, lead(start_sample) OVER w - end_sample AS ga FROM rgn WINDOW w AS (PARTITION BY rec ORDER BY start_sample))
    SELECT rec, CAST(least(greatest(0, start_sample - CASE WHEN gb < 12800 THEN gb // 2 ELSE 6400 END), total) AS BIGINT) AS start_sample, CAST(least(total, end_sample + CASE WHEN ga < 12800 THEN ga // 2 ELSE 6400 END) AS BIGINT) AS end_sample FROM nb""", "fx7")
add("a10_track_activity", lambda s, d: vad.track_activity(fx.voice(s, d), totals(s, d).select("rec", F.floor(F.col("total") / 1280).alias("n_frames")), RATE),
    """WITH n AS (SELECT rec, (max(chunk) + 1) * 4096 // 1280 AS n FROM fx7 GROUP BY rec), g AS (SELECT rec, unnest(range(0, n)) AS frame FROM n),
    o AS (SELECT DISTINCT rec, unnest(range(CAST(floor(chunk * 3.2::DOUBLE) AS BIGINT), CAST(ceil((chunk + 1) * 3.2::DOUBLE) AS BIGINT))) AS frame FROM fx7 WHERE prob >= 0.85) SELECT g.rec, g.frame, o.frame IS NOT NULL AS active FROM g LEFT JOIN o ON o.rec = g.rec AND o.frame = g.frame""", "fx7")
S_EVENTS = f"""a AS (SELECT rec, chunk, prob, sum(CASE WHEN prob >= 0.85 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY chunk) AS g FROM fx7),
    b AS (SELECT rec, g, (min(chunk) + 1) * 4096 AS seen, min(CASE WHEN prob < {VC.exit!r} THEN (chunk + 1) * 4096 END) AS t0, max(CASE WHEN prob < {VC.exit!r} THEN (chunk + 1) * 4096 END) AS t1 FROM a WHERE g > 0 GROUP BY rec, g),
    c AS (SELECT *, coalesce(t1 - t0 >= 8000, false) AS e FROM b), f AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY rec ORDER BY g), true) AS st FROM c),
    u AS (SELECT rec, 'speechStart' AS kind, CAST(greatest(0, seen - 6400 - 4096) AS BIGINT) AS sample FROM f WHERE st UNION ALL SELECT rec, 'speechEnd', CAST(greatest(0, t0 + 6400 - 4096) AS BIGINT) FROM f WHERE e)"""
add("t5_vad_events", lambda s, d: vad.stream_events(fx.voice(s, d), VC, 3), "WITH " + S_EVENTS + " SELECT rec, kind, sample, round(sample / 16000.0::DOUBLE, 3) AS time FROM u", "fx7")


def _spans(s: SparkSession, d: str) -> DataFrame:
    """One span for each chunk, from a little before it to within the next."""
    return fx.chunks(s, d).select("rec", (F.col("start_sample") - 10).alias("start_sample"), (F.col("start_sample") + 100).alias("end_sample"))


add("j4_extract_segments", lambda s, d: vad.extract_segments(fx.chunks(s, d), _spans(s, d), 64).select("rec", "start_sample", "end_sample", F.size("samples").alias("n"), F.get("samples", F.lit(0)).cast("double").alias("first"), F.element_at("samples", -1).cast("double").alias("last")),
    """WITH l AS (SELECT rec, start_sample + i AS sample, CAST(samples[i + 1] AS DOUBLE) AS x FROM (SELECT rec, start_sample, samples, unnest(range(0, 64)) AS i FROM fx5) q), p AS (SELECT rec, start_sample - 10 AS a, start_sample + 100 AS b FROM fx5)
    SELECT p.rec, a AS start_sample, b AS end_sample, CAST(count(*) AS INT) AS n, min_by(x, sample) AS first, max_by(x, sample) AS last FROM p JOIN l ON l.rec = p.rec AND sample >= a AND sample < b GROUP BY p.rec, a, b""", "fx5")
add("j4_segment_values",
    lambda s, d: vad.extract_segments(fx.chunks(s, d), _spans(s, d), 64).select("rec", "start_sample", F.posexplode("samples").alias("pos", "x")).withColumn("x", F.col("x").cast("double")),
    """WITH l AS (SELECT rec, start_sample + i AS sample, CAST(samples[i + 1] AS DOUBLE) AS x FROM (SELECT rec, start_sample, samples, unnest(range(0, 64)) AS i FROM fx5) q),
    p AS (SELECT rec, start_sample - 10 AS a, start_sample + 100 AS b FROM fx5)
    SELECT p.rec, a AS start_sample, CAST(sample - greatest(0, a) AS INT) AS pos, x FROM p JOIN l ON l.rec = p.rec AND sample >= a AND sample < b""", "fx5")
