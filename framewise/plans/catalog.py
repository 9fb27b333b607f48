"""Registered queries of the reference's operators, with their equivalents in SQL.

Every query runs over whole tables: frames, turns, chunks and features are derived from them by
framewise.sources.fixtures, and so are configuration tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.functions import timebase
from framewise.operators import cache, evaluate, reshape, segments, vad
from framewise.operators.segments import SegmentConfig
from framewise.operators.vad import VadConfig
from framewise.sources import files
from framewise.sources import fixtures as fx
from framewise.sources.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CFG = SegmentConfig(on=0.5, off=0.3, pad_on=1, pad_off=1, min_on=3, min_off=2)
RATE = 12.5


def add(name: str, query: Query, sql: str | None = None, *views: str, recursive: bool = False) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = with_views(sql, *views, recursive=recursive) if views else sql


def double(c: str) -> F.Column:
    return F.col(c).cast("double")


# --- common parts -------------------------------------------------------------------------------------------


def segs(spark: SparkSession, d: str, cfg: SegmentConfig = CFG) -> DataFrame:
    return segments.build_segments(fx.activity(spark, d), cfg)


def final_segs(spark: SparkSession, d: str) -> DataFrame:
    seen = fx.activity(spark, d).groupBy("rec").agg((F.max("frame") + 1).alias("frames_seen"))
    return segments.mark_final(segs(spark, d), seen, CFG.pad_on + CFG.pad_off + CFG.min_off + 20)


def speakers(spark: SparkSession, d: str) -> DataFrame:
    """rec, track, name: one slot in three unnamed, one with blanks."""
    s = fx.activity(spark, d).select("rec", "track").distinct()
    n = F.col("rec") * 7 + F.col("track")
    return s.withColumn("name", F.when(n % 3 == 0, F.lit(None).cast("string")).when(n % 3 == 1, F.concat(F.lit("  user "), F.col("rec").cast("string"))).otherwise(F.lit("  ")))


def ref_dense(spark: SparkSession, d: str) -> DataFrame:
    """Dense 1 Hz reference of conversations whose turns last two seconds longer, so that they overlap."""
    t = fx.turns(spark, d).withColumn("duration", F.col("dur") + 2)
    n = t.groupBy("rec").agg(F.bround(F.max(F.col("start") + F.col("duration")), 0).cast("long").alias("n_frames"))
    r = evaluate.rasterize(t, n, 1.0)
    names = spark.createDataFrame(fx.SPEAKERS, "speaker string, track int")
    return r.join(F.broadcast(names), "speaker").select("rec", "frame", "track", "active")


S_SEG = """
st AS (SELECT rec, track, frame, prob, coalesce(last_value(CASE WHEN prob > 0.5 THEN 1 WHEN prob < 0.3 THEN 0 END IGNORE NULLS) OVER (PARTITION BY rec, track ORDER BY frame), 0) AS s,
  max(frame) OVER (PARTITION BY rec, track) + 1 AS n FROM fx1),
il AS (SELECT rec, track, frame, n, sum(1 - s) OVER (PARTITION BY rec, track ORDER BY frame) AS isl, s FROM st),
ia AS (SELECT rec, track, isl, greatest(0, min(frame) - 1) AS a, max(frame) + 1 + 1 AS b, max(frame) + 1 = max(n) AS open FROM il WHERE s = 1 GROUP BY rec, track, isl),
ib AS (SELECT *, CASE WHEN lag(b) OVER w IS NULL OR a - lag(b) OVER w > 2 THEN 1 ELSE 0 END AS fresh FROM ia WINDOW w AS (PARTITION BY rec, track ORDER BY a, b)),
ic AS (SELECT *, sum(fresh) OVER (PARTITION BY rec, track ORDER BY a, b) AS part FROM ib),
id AS (SELECT *, max(CASE WHEN b - a > 3 OR open AND b - a >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY rec, track, part ORDER BY a, b) AS seen FROM ic),
seg AS (SELECT rec, track, CAST(min(a) AS BIGINT) AS start_frame, CAST(max(b) AS BIGINT) AS end_frame FROM id WHERE seen = 1 GROUP BY rec, track, part),
fseg AS (SELECT seg.*, end_frame < fs - 24 AS finalized FROM seg JOIN (SELECT rec, max(frame) + 1 AS fs FROM fx1 GROUP BY rec) q USING (rec))"""
S_SPK = """
spk AS (SELECT rec, track, CASE WHEN (rec * 7 + track) % 3 = 0 THEN NULL WHEN (rec * 7 + track) % 3 = 1 THEN '  user ' || rec ELSE '  ' END AS name FROM (SELECT DISTINCT rec, track FROM fx1) q)"""
S_REF = """
rl AS (SELECT rec, CAST(round_even(max(start + dur + 2), 0) AS BIGINT) AS n FROM fx2 GROUP BY rec),
ron AS (SELECT DISTINCT f.rec, f.speaker, f.frame FROM fx3p f JOIN rl USING (rec) WHERE f.frame < n),
rg AS (SELECT s.rec, s.speaker, unnest(range(0, n)) AS frame FROM (SELECT DISTINCT rec, speaker FROM fx2) s JOIN rl USING (rec)),
rt AS (SELECT * FROM (VALUES ('user', 0), ('system', 1), ('assistant', 2)) v(speaker, tr)),
ref AS (SELECT rg.rec, rg.frame, rt.tr AS track, CASE WHEN ron.frame IS NULL THEN 0 ELSE 1 END AS active FROM rg JOIN rt USING (speaker) LEFT JOIN ron ON ron.rec = rg.rec AND ron.speaker = rg.speaker AND ron.frame = rg.frame)"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return segments.speaker_stats(final_segs(spark, d), RATE)


# --- reshaping ----------------------------------------------------------------------------------------------

add("p1_matrix_to_long", lambda s, d: reshape.matrix_to_long(fx.table(s, d, "embeddings").select(F.col("vec_id").alias("rec"), F.lit(8).alias("columns"), F.col("embedding").alias("values"))),
    "SELECT vec_id AS rec, i // 8 AS frame, CAST(i % 8 AS INT) AS track, CAST(embedding[i + 1] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)")
add("p2_long_to_rows", lambda s, d: reshape.long_to_rows(fx.activity(s, d)).select("rec", "frame", F.array_join(F.transform("values", lambda v: F.round(v * 5, 0).cast("int").cast("string")), ",").alias("cells")),
    "SELECT rec, frame, string_agg(CAST(CAST(round(prob * 5) AS INT) AS VARCHAR), ',' ORDER BY track) AS cells FROM fx1 GROUP BY rec, frame", "fx1")
add("p3_validate_shape", lambda s, d: reshape.validate_shape(fx.table(s, d, "embeddings").select(F.col("vec_id").alias("rec"), (F.col("label") + 1).alias("columns"), F.col("embedding").alias("values"))),
    "SELECT vec_id AS rec, CAST(label + 1 AS INT) AS columns, CAST(len(embedding) AS INT) AS length FROM embeddings WHERE len(embedding) % (label + 1) <> 0")
add("p4_slice_frames", lambda s, d: reshape.slice_frames(fx.activity(s, d), 5, 25), "SELECT rec, frame - 5 AS frame, track, prob FROM fx1 WHERE frame >= 5 AND frame < 25", "fx1")
add("p4_drop_first", lambda s, d: reshape.drop_first(fx.activity(s, d), 10), "SELECT rec, frame - 10 AS frame, track, prob FROM fx1 WHERE frame >= 10", "fx1")
add("p5_crop_boundary", lambda s, d: reshape.crop_boundary(fx.activity(s, d)), "SELECT rec, frame, CAST(track - 1 AS INT) AS track, prob FROM fx1 WHERE track > 0 AND track < (SELECT max(track) FROM fx1)", "fx1")
add("p5_select_tracks", lambda s, d: reshape.select_tracks(fx.activity(s, d), [3, 0, 2]), "SELECT rec, frame, CAST(CASE track WHEN 3 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS INT) AS track, prob FROM fx1 WHERE track IN (3, 0, 2)", "fx1")
add("p5_first_tracks", lambda s, d: reshape.first_tracks(fx.activity(s, d), 2), "SELECT rec, frame, track, prob FROM fx1 WHERE track < 2", "fx1")
add("p6_sigmoid", lambda s, d: reshape.sigmoid(fx.activity(s, d).select("rec", "frame", "track", F.log((F.col("prob") * 0.8 + 0.1) / (1 - F.col("prob") * 0.8 - 0.1)).alias("logit"))).select("rec", "frame", "track", F.round("prob", 6).alias("prob")),
    "SELECT rec, frame, track, round(prob * 0.8::DOUBLE + 0.1::DOUBLE, 6) AS prob FROM fx1", "fx1")
add("p7_binarize", lambda s, d: evaluate.binarize(fx.activity(s, d), 0.4), "SELECT rec, frame, track, CASE WHEN prob > 0.4::DOUBLE THEN 1 ELSE 0 END AS active FROM fx1", "fx1")
add("p8_voice_active", lambda s, d: vad.voice_active(fx.voice(s, d)), "SELECT rec, chunk, prob, prob >= 0.85 AS active FROM fx7", "fx7")
add("p9_probability_at", lambda s, d: reshape.probability_at(fx.activity(s, d), fx.table(s, d, "orders").select(F.col("o_custkey").alias("rec"), (F.col("o_orderkey") % 80).alias("frame"), (F.col("o_orderkey") % 7).cast("int").alias("track")).distinct(), -1.0),
    "SELECT k.rec, k.frame, k.track, coalesce(f.prob, -1.0) AS prob FROM (SELECT DISTINCT o_custkey AS rec, o_orderkey % 80 AS frame, CAST(o_orderkey % 7 AS INT) AS track FROM orders) k LEFT JOIN fx1 f ON f.rec = k.rec AND f.frame = k.frame AND f.track = k.track", "fx1")
add("p10_retain_last", lambda s, d: reshape.retain_last(fx.activity(s, d), 10), "SELECT rec, frame, track, prob FROM (SELECT *, max(frame) OVER (PARTITION BY rec) AS m FROM fx1) WHERE frame > m - 10", "fx1")
add("p11_recent_view", lambda s, d: reshape.recent_view(fx.activity(s, d), 1.5, RATE),
    "SELECT rec, frame, track, prob, min(frame) OVER w / 12.5::DOUBLE AS view_start, (max(frame) OVER w + 1) / 12.5::DOUBLE AS view_end FROM (SELECT *, max(frame) OVER (PARTITION BY rec) AS m FROM fx1) WHERE frame > m - 19 WINDOW w AS (PARTITION BY rec)", "fx1")
add("p12_display_labels", lambda s, d: segments.display_labels(speakers(s, d)), "WITH " + S_SPK + " SELECT rec, track, coalesce(nullif(trim(name), ''), 'Speaker ' || (track + 1)) AS label FROM spk", "fx1")
_T = ("rec", "turn")
add("p13_time_to_frames", lambda s, d: fx.turns(s, d).select(*_T, *[timebase.time_to_frames(F.col("start"), 0.5, r).alias(r) for r in timebase.RULES], timebase.frames_to_time(F.col("turn"), 12.5).alias("seconds"), timebase.round_div(F.length("speaker").cast("long") + F.col("turn"), F.lit(3)).alias("rounded"), timebase.ceil_div(F.col("turn"), F.lit(4)).alias("up"), timebase.next_multiple(F.col("turn"), F.lit(4)).alias("multiple")),
    """SELECT rec, turn, CAST(round_even(start * 0.5, 0) AS BIGINT) AS half_even, CAST(round(start * 0.5) AS BIGINT) AS half_up, CAST(trunc(start * 0.5) AS BIGINT) AS truncate, CAST(floor(start * 0.5) AS BIGINT) AS floor, CAST(ceil(start * 0.5) AS BIGINT) AS ceil,
    turn / 12.5::DOUBLE AS seconds, (length(speaker) + turn + 1) // 3 AS rounded, (turn + 3) // 4 AS up, (turn + 3) // 4 * 4 AS multiple FROM fx2""", "fx2")
add("p13_to_frames", lambda s, d: fx.table(s, d, "events").select("event_id", timebase.to_frames(F.col("ts").cast("timestamp"), 1_577_836_800_000_000, 0.01).alias("frame")),
    "SELECT event_id, CAST(floor((epoch_us(ts) - 1577836800000000) * 0.01::DOUBLE / 1e6) AS BIGINT) AS frame FROM events")


def _meta(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    some = lambda c, v: F.when(c, v.cast("int"))
    return fx.table(s, d, "part").select(
        k.alias("config"), (F.lit(23) * (2 * (k % 4) + 1)).cast("int").alias("input_dim"), F.lit(16000).alias("target_sample_rate"), some(k % 5 == 0, F.lit(8000)).alias("sample_rate"), some(k % 3 > 0, 100 + k % 300).alias("win_length"), some(k % 2 == 0, F.lit(160)).alias("hop_length"),
        F.lit(23).alias("n_mels"), some(k % 4 > 1, k % 4).alias("context_recp"), some(k % 7 == 0, F.lit(8)).alias("subsampling"), (10.0 + (k % 2) * 2.5).alias("frame_hz"), (k % 10).cast("int").alias("conv_delay"),
    )


add("p14_resolve_config", lambda s, d: files.resolve_config(_meta(s, d)).select("config", "rate", "win", "hop", "fft", "mels", "context", "sub", F.round("latency", 9).alias("latency"), "stable_block"),
    """WITH m AS (SELECT p_partkey AS config, 23 * (2 * (p_partkey % 4) + 1) AS input_dim, CASE WHEN p_partkey % 5 = 0 THEN 8000 ELSE 16000 END AS rate, CASE WHEN p_partkey % 3 > 0 THEN 100 + p_partkey % 300 ELSE 200 END AS win,
      CASE WHEN p_partkey % 2 = 0 THEN 160 ELSE 80 END AS hop, 10.0 + (p_partkey % 2) * 2.5 AS hz, p_partkey % 10 AS delay, p_partkey % 7 = 0 AS fixed FROM part),
    n AS (SELECT *, CASE WHEN win <= 128 THEN 128 WHEN win <= 256 THEN 256 ELSE 512 END AS fft, (input_dim // 23 - 1) // 2 AS context, CASE WHEN fixed THEN 8 ELSE greatest(1, CAST(round(CAST(rate AS DOUBLE) / round(hz * hop)) AS BIGINT)) END AS sub FROM m)
    SELECT config, CAST(rate AS BIGINT) AS rate, CAST(win AS BIGINT) AS win, CAST(hop AS BIGINT) AS hop, CAST(fft AS BIGINT) AS fft, CAST(23 AS BIGINT) AS mels, CAST(context AS BIGINT) AS context, CAST(sub AS BIGINT) AS sub,
      round((fft / 2.0::DOUBLE + context * hop + delay * sub * hop) / rate, 9) AS latency, CAST(hop * sub AS BIGINT) AS stable_block FROM n""")
add("p15_resolve_stream_config", lambda s, d: files.resolve_stream_config(fx.table(s, d, "part").select(F.col("p_partkey").alias("config"), (F.col("p_partkey") % 7 - 1).alias("chunk"), (F.col("p_partkey") % 50).alias("fifo"), (F.col("p_partkey") % 200).alias("cache"), (F.col("p_partkey") % 4).alias("silence"), F.lit(4).cast("long").alias("tracks"), (F.col("p_partkey") % 90).alias("period"))),
    "WITH c AS (SELECT p_partkey AS config, greatest(1, p_partkey % 7 - 1) AS chunk, p_partkey % 50 AS fifo, p_partkey % 4 AS silence, CAST(4 AS BIGINT) AS tracks, p_partkey % 200 AS c0, p_partkey % 90 AS p0 FROM part) SELECT config, chunk, fifo, greatest(c0, (1 + silence) * tracks) AS cache, silence, tracks, greatest(chunk, least(p0, fifo + chunk)) AS period FROM c")
def _offered(s: SparkSession, d: str) -> DataFrame:
    """Configurations of which some are like a named one in all that matters for its model."""
    k = F.col("p_partkey")
    chunk = F.when(k % 3 == 0, F.lit(340)).otherwise(6 + k % 2)
    return fx.table(s, d, "part").select(k.alias("config"), chunk.cast("long").alias("chunk"), (1 - k % 2 * F.when(k % 3 == 0, 0).otherwise(1)).cast("long").alias("left"), F.when(k % 3 == 0, F.lit(40)).otherwise(F.lit(7)).cast("long").alias("right"), F.when(k % 5 == 0, F.lit(188)).otherwise(F.lit(40)).cast("long").alias("fifo"), (188 + k % 7).alias("cache"))


add("p15_compatible", lambda s, d: files.compatible(_offered(s, d), files.stream_presets(s)),
    """WITH p AS (SELECT * FROM (VALUES ('default', 112, 40, 188), ('high_latency', 3048, 40, 188), ('low_latency', 112, 188, 188)) v(other, mel_frames, fifo, cache)),
    o AS (SELECT p_partkey AS config, CASE WHEN p_partkey % 3 = 0 THEN 381 ELSE 6 + p_partkey % 2 + 1 - p_partkey % 2 + 7 END * 8 AS mel_frames, CASE WHEN p_partkey % 5 = 0 THEN 188 ELSE 40 END AS fifo, 188 + p_partkey % 7 AS cache FROM part)
    SELECT config, other, CAST(mel_frames AS BIGINT) AS mel_frames FROM o JOIN p USING (mel_frames, fifo, cache)""")
add("p16_resolve_thresholds", lambda s, d: vad.resolve_thresholds(fx.table(s, d, "part").select(F.col("p_partkey").alias("config"), ((F.col("p_partkey") % 100) / 100.0).alias("threshold"), F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") % 95) / 100.0).alias("negative"), F.lit(0.15).alias("offset"))).select("config", F.round("entry", 6).alias("entry"), F.round("exit", 6).alias("exit")),
    "WITH c AS (SELECT p_partkey AS config, (p_partkey % 100) / 100.0::DOUBLE AS t, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 95) / 100.0::DOUBLE END AS n FROM part), e AS (SELECT *, CASE WHEN n IS NULL THEN t ELSE least(1.0::DOUBLE, n + 0.15::DOUBLE) END AS entry FROM c) SELECT config, round(entry, 6) AS entry, round(coalesce(n, greatest(entry - 0.15::DOUBLE, 0.01::DOUBLE)), 6) AS exit FROM e")


def _quiet(s: SparkSession, d: str) -> DataFrame:
    """Every fifth chunk silenced."""
    return fx.chunks(s, d).withColumn("samples", F.transform("samples", lambda x: F.when(F.col("chunk") % 5 == 0, F.lit(0.0).cast("float")).otherwise(x)))


add("p17_silent_chunks", lambda s, d: vad.silent_chunks(_quiet(s, d)).select("rec", "chunk", "silent"), "SELECT rec, chunk, chunk % 5 = 0 OR len(list_filter(samples, lambda x: abs(x) > 1e-10)) = 0 AS silent FROM fx5", "fx5")
add("p18_fix_chunk_length", lambda s, d: vad.fix_chunk_length(fx.chunks(s, d), 80, 4).select("rec", "chunk", F.size("samples").alias("n"), F.get("samples", F.lit(79)).cast("double").alias("last"), F.get("context", F.lit(0)).cast("double").alias("first_context")),
    "SELECT rec, chunk, 80 AS n, CAST(samples[64] AS DOUBLE) AS last, CAST(lag(samples[64]) OVER (PARTITION BY rec ORDER BY chunk) AS DOUBLE) AS first_context FROM fx5", "fx5")
add("p18_fixed_values",
    lambda s, d: vad.fix_chunk_length(fx.chunks(s, d), 80, 4).select("rec", "chunk", F.posexplode(F.concat("samples", F.coalesce("context", F.array().cast("array<float>")))).alias("pos", "x")).withColumn("x", F.col("x").cast("double")),
    # The fixed chunk, then the last four samples of the fixed chunk before it.
    """SELECT rec, chunk, CAST(i AS INT) AS pos, CAST(CASE WHEN i < 64 THEN samples[i + 1] WHEN i < 80 THEN samples[64] ELSE before END AS DOUBLE) AS x
    FROM (SELECT *, lag(samples[64]) OVER (PARTITION BY rec ORDER BY chunk) AS before FROM fx5) q, (SELECT unnest(range(0, 84)) AS i) r WHERE i < 80 OR before IS NOT NULL""", "fx5")
add("p19_segment_extend", lambda s, d: segments.extend(segs(s, d), segs(s, d).groupBy("rec", "track").agg((F.min("start_frame") + 2).alias("start_frame"), (F.max("start_frame") + 4).alias("end_frame")), ["rec", "track"]),
    "WITH " + S_SEG + ", o AS (SELECT rec, track, min(start_frame) + 2 AS a, max(start_frame) + 4 AS b FROM seg GROUP BY rec, track) SELECT rec, track, least(start_frame, a) AS start_frame, greatest(end_frame, b) AS end_frame FROM seg JOIN o USING (rec, track)", "fx1")

# --- segments -----------------------------------------------------------------------------------------------

add("w5_runs", lambda s, d: segments.runs(evaluate.binarize(fx.activity(s, d))),
    "SELECT rec, track, min(frame) AS start_frame, max(frame) + 1 AS end_frame FROM (SELECT *, frame - row_number() OVER (PARTITION BY rec, track ORDER BY frame) AS g FROM fx1 WHERE prob > 0.5) GROUP BY rec, track, g", "fx1")
add("w6_hysteresis", lambda s, d: segments.hysteresis(fx.activity(s, d), 0.5, 0.3), "WITH " + S_SEG + " SELECT rec, track, frame, s AS active FROM st", "fx1")
add("w7_build_segments", segs, "WITH " + S_SEG + " SELECT * FROM seg", "fx1")
add("w7_build_segments_clipped", lambda s, d: segments.with_times(segments.build_segments(fx.activity(s, d), CFG, clip=True), RATE),
    "WITH " + S_SEG + ", c AS (SELECT seg.rec, track, start_frame, least(end_frame, n) AS end_frame FROM seg JOIN (SELECT rec, max(frame) + 1 AS n FROM fx1 GROUP BY rec) q USING (rec)) SELECT *, start_frame / 12.5::DOUBLE AS start_time, end_frame / 12.5::DOUBLE AS end_time, (end_frame - start_frame) / 12.5::DOUBLE AS duration FROM c", "fx1")
add("k1_dedup_segments", lambda s, d: segments.sort_segments(segments.dedup_segments(segments.append_segments(segs(s, d), segs(s, d, SegmentConfig(0.5, 0.3, 1, 1, 3, 2))))), "WITH " + S_SEG + " SELECT * FROM seg", "fx1")
add("k4_new_segments", lambda s, d: segments.new_segments(final_segs(s, d).where("start_frame < 30"), final_segs(s, d)).select("rec", "track", "start_frame", "end_frame"), "WITH " + S_SEG + " SELECT * FROM seg WHERE start_frame >= 30", "fx1")
add("k5_append_frames", lambda s, d: reshape.append_frames(fx.activity(s, d), reshape.slice_frames(fx.activity(s, d), 0, 5)),
    "SELECT rec, frame, track, prob FROM fx1 UNION ALL SELECT f.rec, f.frame + n, track, prob FROM fx1 f JOIN (SELECT rec, max(frame) + 1 AS n FROM fx1 GROUP BY rec) q USING (rec) WHERE f.frame < 5", "fx1")
add("k6_committed_plus_preview", lambda s, d: evaluate.median_filter(evaluate.binarize(reshape.committed_plus_preview(fx.activity(s, d), fx.activity(s, d).where("frame % 3 = 0").withColumn("prob", 1 - F.col("prob")))), 3),
    """WITH c AS (SELECT rec, frame, track, CASE WHEN (CASE WHEN frame % 3 = 0 THEN 1 - prob ELSE prob END) > 0.5 THEN 1 ELSE 0 END AS b FROM fx1)
    SELECT rec, frame, track, CASE WHEN sum(b) OVER w * 2 >= count(*) OVER w THEN 1 ELSE 0 END AS active FROM c WINDOW w AS (PARTITION BY rec, track ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""", "fx1")
add("k7_finalize", lambda s, d: segments.finalize(final_segs(s, d), 6), "WITH " + S_SEG + " SELECT rec, track, start_frame, end_frame, true AS finalized FROM fseg WHERE finalized OR end_frame - start_frame >= 6", "fx1")
add("k8_drop_last", lambda s, d: segments.drop_last(segs(s, d)), "WITH " + S_SEG + " SELECT rec, track, start_frame, end_frame FROM (SELECT *, row_number() OVER (PARTITION BY rec, track ORDER BY start_frame DESC, end_frame DESC) AS r FROM seg) WHERE r > 1", "fx1")
add("k8_clear_tentative", lambda s, d: segments.clear(final_segs(s, d)), "WITH " + S_SEG + " SELECT * FROM fseg WHERE finalized", "fx1")
add("a1_speaker_stats", flagship,
    "WITH " + S_SEG + """ SELECT rec, track, count(*) AS segments, count(*) FILTER (finalized) AS finalized_segments, count(*) FILTER (NOT finalized) AS tentative_segments, CAST(sum(end_frame - start_frame) AS BIGINT) AS frames,
    CAST(coalesce(sum(end_frame - start_frame) FILTER (finalized), 0) AS BIGINT) AS finalized_frames, CAST(coalesce(sum(end_frame - start_frame) FILTER (NOT finalized), 0) AS BIGINT) AS tentative_frames, CAST(sum(end_frame - start_frame) AS BIGINT) / 12.5::DOUBLE AS seconds, true AS has_segments FROM fseg GROUP BY rec, track""", "fx1")
add("a2_timeline_stats", lambda s, d: segments.timeline_stats(fx.activity(s, d).withColumn("finalized", F.col("frame") < 40), RATE),
    "SELECT rec, count(*) FILTER (frame < 40) AS finalized_frames, count(*) FILTER (frame >= 40) AS tentative_frames, count(*) AS frames, count(*) FILTER (frame < 40) / 12.5::DOUBLE AS finalized_seconds, count(*) FILTER (frame >= 40) / 12.5::DOUBLE AS tentative_seconds, count(*) / 12.5::DOUBLE AS seconds FROM (SELECT DISTINCT rec, frame FROM fx1) GROUP BY rec", "fx1")
add("a7_dominant_track", lambda s, d: segments.dominant_track(segs(s, d)), "WITH " + S_SEG + ", t AS (SELECT rec, track, CAST(sum(end_frame - start_frame) AS BIGINT) AS frames FROM seg GROUP BY rec, track) SELECT rec, track, frames FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY frames DESC, track) AS r FROM t) WHERE r = 1", "fx1")


def _names(s: SparkSession, d: str) -> DataFrame:
    return fx.activity(s, d).select("rec").distinct().withColumn("name", F.concat(F.lit("new "), F.col("rec").cast("string")))


S_ENR = S_SEG + "," + S_SPK + """, t AS (SELECT rec, track, sum(end_frame - start_frame) AS f FROM seg GROUP BY rec, track), top AS (SELECT rec, track FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY f DESC, track) AS r FROM t) WHERE r = 1),
n AS (SELECT r.rec, top.track, 'new ' || r.rec AS name, spk.name AS old FROM (SELECT DISTINCT rec FROM fx1) r LEFT JOIN top ON top.rec = r.rec LEFT JOIN spk ON spk.rec = r.rec AND spk.track = top.track)"""
for _o in (True, False):
    add(f"a8_enroll_{'overwrite' if _o else 'keep'}", lambda s, d, o=_o: segments.enroll(speakers(s, d), segs(s, d), _names(s, d), o),
        "WITH " + S_ENR + f" SELECT rec, track, CASE WHEN track IS NOT NULL AND (old IS NULL OR {_o}) THEN name ELSE old END AS name, track IS NOT NULL AND (old IS NULL OR {_o}) AS accepted FROM n", "fx1")
add("a11_speakers_from_segments", lambda s, d: segments.speakers_from_segments(segs(s, d)), "WITH " + S_SEG + " SELECT DISTINCT rec, track FROM seg", "fx1")
add("j3_overlap_join", lambda s, d: segments.overlap_join(segs(s, d).where("track < 2"), segs(s, d).where("track >= 2")),
    "WITH " + S_SEG + " SELECT a.rec, a.track AS a_track, a.start_frame AS a_start_frame, a.end_frame AS a_end_frame, b.track AS b_track, b.start_frame AS b_start_frame, b.end_frame AS b_end_frame FROM seg a JOIN seg b ON a.rec = b.rec AND a.start_frame <= b.end_frame AND b.start_frame <= a.end_frame WHERE a.track < 2 AND b.track >= 2", "fx1")
for _m, _w in (("named", "name IS NOT NULL"), ("with_segments", "EXISTS (SELECT 1 FROM seg WHERE seg.rec = spk.rec AND seg.track = spk.track)"), ("without_segments", "NOT EXISTS (SELECT 1 FROM seg WHERE seg.rec = spk.rec AND seg.track = spk.track)")):
    add(f"j8_keep_speakers_{_m}", lambda s, d, m=_m: segments.keep_speakers(speakers(s, d), segs(s, d), m), "WITH " + S_SEG + "," + S_SPK + f" SELECT rec, track, name FROM spk WHERE {_w}", "fx1")


def _upserts(s: SparkSession, d: str) -> DataFrame:
    r = fx.activity(s, d).select("rec").distinct()
    return r.select("rec", F.when(F.col("rec") % 3 == 0, F.lit(None).cast("int")).otherwise((F.col("rec") % 9).cast("int")).alias("track"), F.concat(F.lit("row "), F.col("rec").cast("string")).alias("name"))


add("j9_upsert_speaker", lambda s, d: segments.upsert_speaker(speakers(s, d).where("(rec + track) % 2 = 0"), _upserts(s, d), 7),
    "WITH " + S_SPK + """, k AS (SELECT * FROM spk WHERE (rec + track) % 2 = 0), r AS (SELECT DISTINCT rec, CASE WHEN rec % 3 = 0 THEN NULL ELSE CAST(rec % 9 AS INT) END AS track, 'row ' || rec AS name FROM fx1),
    fixed AS (SELECT * FROM r WHERE track BETWEEN 0 AND 6), loose AS (SELECT rec, name FROM r WHERE track IS NULL),
    fr AS (SELECT l.rec, CAST(min(i) AS INT) AS track FROM (SELECT rec, unnest(range(0, 7)) AS i FROM loose) l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.rec = l.rec AND k.track = l.i) AND NOT EXISTS (SELECT 1 FROM fixed f WHERE f.rec = l.rec AND f.track = l.i) GROUP BY l.rec),
    nw AS (SELECT rec, track, name FROM fixed UNION ALL SELECT rec, fr.track, loose.name FROM loose JOIN fr USING (rec))
    SELECT coalesce(k.rec, nw.rec) AS rec, coalesce(k.track, nw.track) AS track, coalesce(nw.name, k.name) AS name FROM k FULL JOIN nw ON k.rec = nw.rec AND k.track = nw.track""", "fx1")
# The base is the whole table, and a patch of every other frame reaches past its end.
add("j10_patch_frames", lambda s, d: reshape.patch_frames(fx.activity(s, d), fx.activity(s, d).withColumn("frame", F.col("frame") * 2).withColumn("prob", F.lit(0.75))),
    """WITH p AS (SELECT rec, frame * 2 AS frame, track, 0.75::DOUBLE AS q FROM fx1), b AS (SELECT rec, frame, track, coalesce(q, prob) AS prob FROM fx1 FULL JOIN p USING (rec, frame, track)), z AS (SELECT rec, max(frame) AS n, max(track) AS t FROM b GROUP BY rec),
    g AS (SELECT rec, frame, CAST(unnest(range(0, t + 1)) AS INT) AS track FROM (SELECT rec, t, unnest(range(0, n + 1)) AS frame FROM z)) SELECT g.rec, g.frame, g.track, coalesce(b.prob, 0.0::DOUBLE) AS prob FROM g LEFT JOIN b USING (rec, frame, track)""", "fx1")
add("j11_compare", lambda s, d: evaluate.compare(fx.activity(s, d), fx.activity(s, d).where("rec % 5 > 0 OR frame < 3").withColumn("prob", F.col("prob") * 0.5)).select("rec", F.round("max_abs", 9).alias("max_abs"), F.round("mean_abs", 9).alias("mean_abs")),
    "SELECT rec, CASE WHEN rec % 5 > 0 OR max(frame) < 3 THEN round(max(prob * 0.5), 9) ELSE 'inf'::DOUBLE END AS max_abs, CASE WHEN rec % 5 > 0 OR max(frame) < 3 THEN round(avg(prob * 0.5), 9) ELSE 'inf'::DOUBLE END AS mean_abs FROM fx1 GROUP BY rec", "fx1")

# The remaining groups register themselves.
from framewise.plans import catalog_features, catalog_scoring, catalog_streams  # noqa: E402, F401
