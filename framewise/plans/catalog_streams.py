"""Queries that run as streams over tables written to the shared folder, and are read back when all is done."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.operators import features, segments, vad
from framewise.operators.cache import CacheConfig
from framewise.operators.loop import LoopConfig, score_with_cache
from framewise.sources import fixtures as fx
from framewise.sources.growing import GrowingPcm
from framewise.sources.shared import shared_dir
from framewise.streaming import sink, streams

from .catalog import CFG, S_SEG, add
from .catalog_features import MEL, S_MEL, S_ROWS, embeddings, rounded, smoother
from .catalog_scoring import S_EVENTS, VC


def run_stream(source: DataFrame, op: Callable[[DataFrame], DataFrame], order: str) -> DataFrame:
    """op over source as a stream; the result of the append sink.

    The upper half of `order` arrives after a first run has ended, so a second run goes on from the state
    that the first one left in the checkpoint.
    """
    spark = source.sparkSession
    root = shared_dir(spark)
    source.write.parquet(f"{root}/all")
    whole = spark.read.schema(source.schema).parquet(f"{root}/all")
    half = whole.agg(F.max(order) / 2).first()[0] or 0
    early = F.coalesce(F.col(order) <= half, F.lit(True))
    for part in (whole.where(early), whole.where(~early)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(source.schema).parquet(f"{root}/in")
        query = op(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def last(df: DataFrame, order: str, *keys: str) -> DataFrame:
    return df.withColumn("is_last", F.col(order) == F.max(order).over(Window.partitionBy(*keys)))


def run_sessions(source: DataFrame, op: Callable[[DataFrame], DataFrame], order: str, parts: int = 3) -> DataFrame:
    """op over source (with ts) as a stream of `parts` runs by `order`, none of whose rows is marked as the last.

    After them one row of a recording of its own comes from much later, as on a live stream the other recordings do:
    the watermark passes all sessions, and their timers end them.
    """
    spark = source.sparkSession
    root = shared_dir(spark)
    source.withColumn("is_last", F.lit(False)).write.parquet(f"{root}/all")
    whole = spark.read.parquet(f"{root}/all")
    most = whole.agg(F.max(order)).first()[0] or 0
    for i in range(parts):
        part = whole.where(F.floor(F.col(order) * parts / (most + 1)) == i)
        if i == parts - 1:
            part = part.union(whole.limit(1).withColumns({"rec": F.lit("clock"), "ts": F.lit("2100-01-01").cast("timestamp")}))
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(whole.schema).parquet(f"{root}/in").withWatermark("ts", "1 minute")
        query = op(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{root}/out").where("rec != 'clock'")


def timed(df: DataFrame, every: int) -> DataFrame:
    """df with ts: a second for each frame, and an hour more after each `every` frames."""
    return df.withColumns({"rec": F.col("rec").cast("string"), "ts": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame") + 3600 * F.floor(F.col("frame") / every))})


GAP = 600_000


add("t1_stream_rechunk", lambda s, d: run_stream(last(fx.chunks(s, d).select("rec", F.col("chunk").alias("seq"), "samples"), "seq", "rec").withColumn("end_time", F.lit(None).cast("double")), lambda x: streams.rechunk(x, 100.0, 1.0, 0.5), "seq").select("rec", "chunk", "start_time", F.size("samples").alias("n"), F.round(F.get("samples", F.lit(0)), 6).alias("first")),
    """WITH n AS (SELECT rec, max(chunk + 1) * 64 AS n FROM fx5 GROUP BY rec), c AS (SELECT rec, unnest(range(0, greatest(0, (n - 100) // 50 + 1))) AS chunk FROM n)
    SELECT CAST(c.rec AS VARCHAR) AS rec, c.chunk, c.chunk * 0.5::DOUBLE AS start_time, 100 AS n, round(CAST(samples[c.chunk * 50 % 64 + 1] AS DOUBLE), 6) AS first FROM c JOIN fx5 ON fx5.rec = c.rec AND fx5.chunk = c.chunk * 50 // 64""", "fx5")


def rechunked(startup: str) -> Callable[[SparkSession, str], DataFrame]:
    """Chunks of 100 samples every 50, with the sum of each, by the way in which the first ones begin."""
    def run(s: SparkSession, d: str) -> DataFrame:
        source = last(fx.chunks(s, d).select("rec", F.col("chunk").alias("seq"), "samples"), "seq", "rec").withColumn("end_time", F.lit(None).cast("double"))
        out = run_stream(source, lambda x: streams.rechunk(x, 100.0, 1.0, 0.5, startup), "seq")
        return out.select("rec", "chunk", "start_time", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))

    return run


#: Chunk k ends at sample 50 (k + 1); what lies before the recording is silence, or left out.
S_STARTUP = """WITH x AS (SELECT rec, start_sample + i AS sample, CAST(samples[i + 1] AS DOUBLE) AS x FROM (SELECT rec, start_sample, samples, unnest(range(0, 64)) AS i FROM fx5) q),
    c AS (SELECT rec, unnest(range(0, (max(sample) + 1) // 50)) AS chunk FROM x GROUP BY rec)
    SELECT CAST(c.rec AS VARCHAR) AS rec, c.chunk, {start} AS start_time, CAST({n} AS INT) AS n, round(sum(x.x), 5) AS total FROM c JOIN x ON x.rec = c.rec AND sample >= 50 * c.chunk - 50 AND sample < 50 * c.chunk + 50 GROUP BY c.rec, c.chunk"""
add("t1_stream_rechunk_silent", rechunked("silent"), S_STARTUP.format(start="(c.chunk - 1) * 0.5::DOUBLE", n="100"), "fx5")
add("t1_stream_rechunk_ramp_up", rechunked("ramp_up"), S_STARTUP.format(start="greatest(0, c.chunk - 1) * 0.5::DOUBLE", n="least(100, 50 * (c.chunk + 1))"), "fx5")
add("t3_stream_features", lambda s, d: rounded(run_stream(last(fx.chunks(s, d).select("rec", "chunk", "samples"), "chunk", "rec"), lambda x: streams.stream_features(x, MEL), "chunk").select("rec", "frame", F.posexplode("values").alias("dim", "value")), "value", digits=5),
    "WITH " + S_ROWS + " SELECT CAST(rec AS VARCHAR) AS rec, frame, dim, value FROM mi", "fx5")
add("t4_stream_segments", lambda s, d: run_stream(last(fx.activity(s, d), "frame", "rec", "track"), lambda x: streams.stream_segments(x, CFG), "frame"),
    "WITH " + S_SEG + " SELECT CAST(rec AS VARCHAR) AS rec, track, start_frame, end_frame, true AS finalized FROM seg", "fx1")
add("t5_stream_vad_events", lambda s, d: run_stream(fx.voice(s, d), lambda x: streams.stream_vad_events(x, VC, 3), "chunk"),
    "WITH " + S_EVENTS + " SELECT CAST(rec AS VARCHAR) AS rec, kind, sample, round(sample / 16000.0::DOUBLE, 3) AS time FROM u", "fx7")


def voices(window: np.ndarray, cache: np.ndarray, queue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four tracks from a frame's first values and from what cache and queue hold; a frame's embedding are its first eight."""
    seen = np.concatenate((cache, queue, window[:, :8]))
    known = sum(x[:, :4].mean(axis=0) for x in (cache, queue) if len(x)) if len(cache) + len(queue) else np.zeros(4)
    return 1 / (1 + np.exp(-(20 * seen[:, :4] + 2 * known + window[:1, 4:8]))), window[:, :8]


LOOP = LoopConfig(CacheConfig(capacity=12, tracks=4, silence=1), dims=8, queue=6, period=4, silence=1.2)


def windows(s: SparkSession, d: str) -> DataFrame:
    return features.context_chunks(embeddings(s, d), 4, 1, 2)


def told(df: DataFrame) -> DataFrame:
    """Probabilities and embeddings of the loop rounded, as text."""
    text = lambda c: F.to_json(F.transform(c, lambda x: F.round(x, 6) + 0.0))
    return df.select(F.col("rec").cast("string").alias("rec"), "window", "part", "place", text("probs").alias("probs"), text("embedding").alias("embedding"))


add("t6_stream_speaker_cache", lambda s, d: told(run_stream(last(windows(s, d), "window", "rec"), lambda x: streams.stream_speaker_cache(x, voices, LOOP), "window")))
add("u3_score_with_cache", lambda s, d: told(score_with_cache(windows(s, d), voices, LOOP)))
add("t7_score_stream", lambda s, d: run_stream(last(embeddings(s, d), "frame", "rec"), lambda x: streams.score_stream(x, smoother, 0), "frame").select("rec", "frame", F.posexplode("values").alias("dim", "value"), "finalized").withColumn("value", F.round("value", 6) + 0.0),
    """SELECT CAST(a.rec AS VARCHAR) AS rec, a.frame, a.dim, round(sum(b.value * pow(0.5::DOUBLE, a.frame - b.frame + 1)), 6) + 0.0 AS value, true AS finalized
    FROM fx6 a JOIN fx6 b ON b.rec = a.rec AND b.dim = a.dim AND b.frame <= a.frame GROUP BY a.rec, a.frame, a.dim""", "fx6")

# --- sessions that end by a timer ---------------------------------------------------------------------------

add("t10_session_segments", lambda s, d: run_sessions(timed(fx.activity(s, d), 16), lambda x: streams.stream_segments(x, CFG, gap=GAP), "frame"),
    # As if each session were a recording of its own.
    "WITH fx1s AS (SELECT rec * 1000 + frame // 16 AS rec, frame, track, prob FROM fx1)," + S_SEG.replace("fx1", "fx1s") + " SELECT CAST(rec // 1000 AS VARCHAR) AS rec, track, start_frame, end_frame, true AS finalized FROM seg", "fx1")
add("t10_session_scores", lambda s, d: run_sessions(timed(embeddings(s, d), 7), lambda x: streams.score_stream(x, smoother, 2, gap=GAP), "frame").select("rec", "frame", F.posexplode("values").alias("dim", "value"), "finalized").withColumn("value", F.round("value", 6) + 0.0),
    # The output for frame f of a session is the smoothed mean two frames later, frames after the session's end being zero.
    """WITH o AS (SELECT rec, frame // 7 AS s, frame % 7 AS f, dim, value FROM fx6)
    SELECT CAST(a.rec AS VARCHAR) AS rec, a.f AS frame, a.dim, round(sum(b.value * pow(0.5::DOUBLE, a.f + 2 - b.f + 1)), 6) + 0.0 AS value, true AS finalized
    FROM o a JOIN o b ON b.rec = a.rec AND b.s = a.s AND b.dim = a.dim AND b.f <= a.f + 2 GROUP BY a.rec, a.s, a.f, a.dim""", "fx6")



def late(s: SparkSession, d: str) -> DataFrame:
    """A stream in whose second run every fifth frame of the first one comes again: its segments, and how many frames came late."""
    source, root = last(fx.activity(s, d), "frame", "rec", "track"), shared_dir(s)
    source.write.parquet(f"{root}/all")
    whole = s.read.parquet(f"{root}/all")
    half, count = (whole.agg(F.max("frame")).first()[0] or 0) // 2, 0
    again = whole.where((F.col("frame") <= half) & (F.col("frame") % 5 == 0)).withColumn("prob", 1 - F.col("prob"))
    # A recording that has ended in the first run takes late frames as well as any other.
    for part in (whole.where(F.col("frame") <= half), whole.where(F.col("frame") > half).union(again)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = streams.stream_segments(s.readStream.schema(whole.schema).parquet(f"{root}/in"), CFG)
        query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        count += streams.late_frames(query)
    return s.read.parquet(f"{root}/out").withColumn("late_frames", F.lit(count).cast("long"))


add("t11_late_frames", late,
    "WITH " + S_SEG + """, l AS (SELECT count(*) AS late_frames FROM fx1 WHERE frame <= (SELECT max(frame) // 2 FROM fx1) AND frame % 5 = 0)
    SELECT CAST(rec AS VARCHAR) AS rec, track, start_frame, end_frame, true AS finalized, late_frames FROM seg CROSS JOIN l""", "fx1")

# --- feature windows, refreshes, voice from samples ---------------------------------------------------------

add("t3_stream_windows", lambda s, d: rounded(run_stream(last(fx.chunks(s, d).select("rec", "chunk", "samples"), "chunk", "rec"), lambda x: streams.stream_windows(x, MEL, 4, 1, 2), "chunk")
    .select("rec", "window", "left", "right", F.posexplode("values").alias("pos", "row")).select("rec", "window", "left", "right", "pos", F.posexplode("row").alias("mel", "value")), "value", digits=5),
    "WITH " + S_MEL + """, w AS (SELECT rec, unnest(range(0, (n // 16 - 2) // 4)) AS k FROM n)
    SELECT CAST(w.rec AS VARCHAR) AS rec, k AS "window", CAST(CASE WHEN k > 0 THEN 1 ELSE 0 END AS BIGINT) AS "left", CAST(2 AS BIGINT) AS "right", CAST(frame - greatest(0, k * 4 - 1) AS INT) AS pos, mel, round(value, 5) + 0.0 AS value
    FROM w JOIN lm ON lm.rec = w.rec AND frame BETWEEN k * 4 - 1 AND k * 4 + 5""", "fx5")
add("t9_stream_refresh", lambda s, d: run_stream(fx.chunks(s, d).select("rec", "chunk", "samples"), lambda x: streams.stream_refresh(x, 100), "chunk").select("rec", "chunk", "refresh", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 5).alias("total")),
    "SELECT CAST(a.rec AS VARCHAR) AS rec, a.chunk, (a.chunk + 1) // 2 AS refresh, 128 AS n, round(list_sum(list_transform(a.samples, lambda x: x::DOUBLE)) + list_sum(list_transform(b.samples, lambda x: x::DOUBLE)), 5) AS total FROM fx5 a JOIN fx5 b ON b.rec = a.rec AND b.chunk = a.chunk - 1 WHERE a.chunk % 2 = 1", "fx5")


def loudness(state: object, row: np.ndarray, ingest: bool, decode: bool) -> tuple[np.ndarray, object]:
    """The largest magnitude of a chunk, context included, doubled."""
    return np.array([min(1.0, 2 * np.abs(row).max())]), state


VL = vad.VadConfig(threshold=0.6, offset=0.02, min_silence=0.005, min_speech=0.0, pad=0.001)
#: Chunks of 48 samples with 16 before them, the last one filled with its last sample; then anchors as in t5_vad_events.
S_VOICE = f"""x AS (SELECT rec, start_sample + i AS sample, CAST(samples[i + 1] AS DOUBLE) AS x FROM (SELECT rec, start_sample, samples, unnest(range(0, 64)) AS i FROM fx5) q),
n AS (SELECT rec, max(sample) + 1 AS total FROM x GROUP BY rec), c AS (SELECT rec, total, unnest(range(0, (total + 47) // 48)) AS chunk FROM n),
p AS (SELECT c.rec, c.chunk, least(48, any_value(total) - c.chunk * 48) AS n, least(any_value(total), (c.chunk + 1) * 48) AS done, any_value(total) AS total, least(1.0::DOUBLE, 2 * max(abs(x))) AS prob
  FROM c JOIN x ON x.rec = c.rec AND sample BETWEEN c.chunk * 48 - 16 AND c.chunk * 48 + 47 GROUP BY c.rec, c.chunk),
a AS (SELECT *, sum(CASE WHEN prob >= 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY chunk) AS g FROM p),
b AS (SELECT *, min(CASE WHEN prob < {VL.exit!r} THEN done END) OVER (PARTITION BY rec, g) AS t0, arg_min(done - n, CASE WHEN prob < {VL.exit!r} THEN done END) OVER (PARTITION BY rec, g) AS q0 FROM a WHERE g > 0),
e AS (SELECT rec, g, min(done - n) AS begun, any_value(t0) AS t0, any_value(q0) AS q0, any_value(total) AS total, arg_min(n, done) FILTER (prob < {VL.exit!r} AND done - t0 >= 80) AS n1 FROM b GROUP BY rec, g),
f AS (SELECT *, coalesce(lag(n1 IS NOT NULL) OVER (PARTITION BY rec ORDER BY g), true) AS st, lead(g) OVER (PARTITION BY rec ORDER BY g) IS NULL AS final FROM e),
u AS (SELECT rec, 'speechStart' AS kind, greatest(0, begun - 16) AS sample FROM f WHERE st UNION ALL SELECT rec, 'speechEnd', greatest(0, t0 + 16 - n1) FROM f WHERE n1 IS NOT NULL
  UNION ALL SELECT rec, 'speechEnd', least(total, coalesce(q0 + 16, total)) FROM f WHERE n1 IS NULL AND final)"""
add("t5_stream_voice", lambda s, d: run_stream(last(fx.chunks(s, d).select("rec", F.col("chunk").alias("seq"), "samples"), "seq", "rec"), lambda x: streams.stream_voice(x, loudness, VL, 48, 16, 4), "seq"),
    "WITH " + S_VOICE + " SELECT CAST(rec AS VARCHAR) AS rec, kind, CAST(sample AS BIGINT) AS sample, round(sample / 16000.0::DOUBLE, 4) AS time FROM u", "fx5")
add("t5_vad_events_flush", lambda s, d: vad.stream_events(fx.voice(s, d), VC, 3, flush=True),
    "WITH " + S_EVENTS.replace("coalesce(lag(e) OVER (PARTITION BY rec ORDER BY g), true) AS st", "coalesce(lag(e) OVER (PARTITION BY rec ORDER BY g), true) AS st, lead(g) OVER (PARTITION BY rec ORDER BY g) IS NULL AS final")
    + """, m AS (SELECT rec, (max(chunk) + 1) * 4096 AS total FROM fx7 GROUP BY rec), v AS (SELECT * FROM u UNION ALL SELECT f.rec, 'speechEnd', CAST(least(total, coalesce(t0 - 4096 + 6400, total)) AS BIGINT) FROM f JOIN m ON m.rec = f.rec WHERE final AND NOT e)
    SELECT rec, kind, sample, round(sample / 16000.0::DOUBLE, 3) AS time FROM v""", "fx7")

# --- sinks and sources --------------------------------------------------------------------------------------


def upserted(s: SparkSession, d: str) -> DataFrame:
    """Segments of a stream without an end through the exactly-once sink, each run twice written: as they stand at the end."""
    source = fx.activity(s, d).withColumn("is_last", F.lit(False))
    root = shared_dir(s)
    source.write.parquet(f"{root}/all")
    whole = s.read.parquet(f"{root}/all")
    half = (whole.agg(F.max("frame")).first()[0] or 0) // 2
    write = sink.exactly_once(f"{root}/sink")

    def twice(rows: DataFrame, batch: int) -> None:
        write(rows, batch)
        write(rows.limit(0), batch)

    for part in (whole.where(F.col("frame") <= half), whole.where(F.col("frame") > half)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = streams.stream_segments(s.readStream.schema(whole.schema).parquet(f"{root}/in"), CFG, True, empty=True)
        stream.writeStream.outputMode("update").foreachBatch(twice).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    rows = sink.written(s, f"{root}/sink", "rec string, track int, start_frame long, end_frame long, finalized boolean")
    return sink.current(rows, "rec", "track", present="start_frame")


add("u4_exactly_once", upserted,
    # Final is what no later frame can reach: neither the open island, if there is one, nor the next frame.
    "WITH " + S_SEG + """, z AS (SELECT st.rec, st.track, coalesce(any_value(ia.a), max(st.n) - 1) AS soonest FROM st LEFT JOIN ia ON ia.rec = st.rec AND ia.track = st.track AND ia.open GROUP BY st.rec, st.track)
    SELECT CAST(seg.rec AS VARCHAR) AS rec, seg.track, start_frame, end_frame, soonest - end_frame > 2 AS finalized FROM seg JOIN z ON z.rec = seg.rec AND z.track = seg.track""", "fx1")


def append_pcm(chunks: DataFrame, part: F.Column, path: str, closed: bool) -> None:
    """Appends each recording's samples of a part to its file, as something outside Spark would, and marks it if closed.

    A recording that has nothing in the part is marked too.
    """

    def run(batches):
        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder, recursive=True)
        for batch in batches:
            for rec, samples in zip(batch["rec"], batch["samples"], strict=True):
                with where.open_append_stream(f"{folder}/{rec}.pcm") as f:
                    f.write(np.asarray(samples, "<i2").tobytes())
                if closed:
                    where.open_output_stream(f"{folder}/{rec}.done").close()
                yield batch.iloc[:1][["rec"]]

    whole = features.to_pcm16(chunks).groupBy("rec").agg(F.sort_array(F.collect_list(F.when(part, F.struct("chunk", "samples")))).alias("c"))
    whole.select("rec", F.flatten(F.transform("c", lambda c: c["samples"])).alias("samples")).mapInPandas(run, "rec long").collect()


def growing(s: SparkSession, d: str) -> DataFrame:
    """Recordings read while they grow, in chunks of 100 samples: half of each, then the rest and its end."""
    s.dataSource.register(GrowingPcm)
    chunks, root = fx.chunks(s, d), shared_dir(s)
    early = F.expr("chunk % 12 < 5 and chunk < 12")
    for part, closed in ((early, False), (~early, True)):
        append_pcm(chunks, part, f"{root}/in", closed)
        stream = s.readStream.format("growing_pcm").option("path", f"{root}/in").option("chunk", 100).load()
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{root}/out")


add("s10_growing_recordings", lambda s, d: growing(s, d).select("rec", "chunk", "start_sample", "is_last", F.size("samples").alias("n"), F.coalesce(F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 5), F.lit(0.0)).alias("total")),
    """WITH x AS (SELECT rec, start_sample + i AS sample, CAST(trunc(greatest(-1, least(1, CAST(samples[i + 1] AS DOUBLE))) * 32767) AS INT) / 32768.0::DOUBLE AS x FROM (SELECT rec, start_sample, samples, unnest(range(0, 64)) AS i FROM fx5) q),
    n AS (SELECT rec, max(sample) + 1 AS n FROM x GROUP BY rec), c AS (SELECT rec, n, unnest(range(0, n // 100 + 1)) AS chunk FROM n)
    SELECT CAST(c.rec AS VARCHAR) AS rec, c.chunk, c.chunk * 100 AS start_sample, c.chunk = any_value(c.n) // 100 AS is_last, CAST(count(x.x) AS INT) AS n, coalesce(round(sum(x.x), 5), 0.0) AS total
    FROM c LEFT JOIN x ON x.rec = c.rec AND x.sample // 100 = c.chunk GROUP BY c.rec, c.chunk""", "fx5")
