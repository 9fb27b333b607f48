"""Queries on samples, features, caches and scorers."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators import cache, evaluate, features, reshape, scoring, segments
from framewise.operators.cache import CacheConfig
from framewise.operators.features import MelConfig
from framewise.sources import files
from framewise.sources import fixtures as fx
from framewise.streaming import streams

from .catalog import RATE, add

MEL = MelConfig()
CACHE = CacheConfig()
#: For the five tracks of the activity table: four places for each, and one of silence.
CACHE_5 = CacheConfig(capacity=25, tracks=5)


def small(s: SparkSession, d: str) -> DataFrame:
    return fx.chunks(s, d)


S_X = "x AS (SELECT rec, start_sample + i AS sample, CAST(samples[i + 1] AS DOUBLE) AS x FROM (SELECT rec, start_sample, samples, unnest(range(0, 64)) AS i FROM fx5) q)"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


# --- samples ------------------------------------------------------------------------------------------------

add("s5_peak_normalize", lambda s, d: rounded(features.to_samples(features.peak_normalize(small(s, d))), "x"),
    "WITH " + S_X + " SELECT rec, sample, round(x / max(abs(x)) OVER (PARTITION BY rec), 6) + 0.0 AS x FROM x", "fx5")
add("s5_to_pcm16", lambda s, d: features.to_samples(features.to_pcm16(small(s, d))).withColumn("x", F.col("x").cast("int")), "WITH " + S_X + " SELECT rec, sample, CAST(trunc(greatest(-1, least(1, x)) * 32767) AS INT) AS x FROM x", "fx5")
add("a9_downmix", lambda s, d: rounded(features.to_samples(features.downmix(small(s, d), 2)), "x"),
    "WITH " + S_X + " SELECT rec, sample // 2 AS sample, round(avg(x), 6) + 0.0 AS x FROM x GROUP BY rec, sample // 2", "fx5")
add("j12_resample_linear", lambda s, d: rounded(features.to_samples(features.resample_linear(small(s, d), 16000, 10000)), "x"),
    "WITH " + S_X + """, n AS (SELECT rec, max(sample) + 1 AS n FROM x GROUP BY rec), o AS (SELECT rec, unnest(range(0, CAST(trunc(n / 1.6::DOUBLE) AS BIGINT))) AS i FROM n), k AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY rec ORDER BY sample), x) AS y FROM x)
    SELECT o.rec, i AS sample, round(x + (y - x) * (i * 1.6::DOUBLE - floor(i * 1.6::DOUBLE)), 6) + 0.0 AS x FROM o JOIN k ON k.rec = o.rec AND k.sample = CAST(floor(i * 1.6::DOUBLE) AS BIGINT)""", "fx5")
add("t2_resync", lambda s, d: rounded(features.to_samples(features.resync(small(s, d).select("rec", F.col("chunk").alias("seq"), (F.col("chunk") * 60 + F.floor(F.col("chunk") / 7) * 10).alias("start_sample"), "samples"))), "x"),
    """WITH w AS (SELECT rec, chunk, chunk * 60 + chunk // 7 * 10 + i AS sample, CAST(samples[i + 1] AS DOUBLE) AS x FROM (SELECT rec, chunk, samples, unnest(range(0, 64)) AS i FROM fx5) q), m AS (SELECT rec, sample, max_by(x, chunk) AS x FROM w GROUP BY rec, sample),
    g AS (SELECT rec, unnest(range(0, n + 1)) AS sample FROM (SELECT rec, max(sample) AS n FROM m GROUP BY rec) q) SELECT g.rec, g.sample, round(coalesce(x, 0), 6) + 0.0 AS x FROM g LEFT JOIN m ON m.rec = g.rec AND m.sample = g.sample""", "fx5")
add("w15_preemphasis", lambda s, d: rounded(features.to_samples(features.preemphasis(small(s, d))), "x"),
    "WITH " + S_X + " SELECT rec, sample, round(x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY rec ORDER BY sample), 0), 6) + 0.0 AS x FROM x", "fx5")
for _mode, _n, _shift, _len in (("center", "n // 16", 16, 32), ("pre_padded", "(n - 32) // 16 + 1", 0, 32), ("plain", "(n - 24) // 16 + 1", 0, 24)):
    add(f"w16_analysis_frames_{_mode}", lambda s, d, m=_mode: rounded(features.analysis_frames(small(s, d), 32, 24, 16, m).select("rec", "frame", F.posexplode("samples").alias("i", "x")), "x"),
        "WITH " + S_X + f""", n AS (SELECT rec, max(sample) + 1 AS n FROM x GROUP BY rec), f AS (SELECT rec, unnest(range(0, {_n})) AS frame FROM n), g AS (SELECT rec, frame, CAST(unnest(range(0, {_len})) AS INT) AS i FROM f)
        SELECT g.rec, g.frame, g.i, round(coalesce(x, 0), 6) + 0.0 AS x FROM g LEFT JOIN x ON x.rec = g.rec AND x.sample = g.frame * 16 - {_shift} + g.i""", "fx5")

# --- spectra ------------------------------------------------------------------------------------------------

_MEL_OF = lambda f: f"(CASE WHEN {f} < 1000 THEN {f} * 3 / 200 ELSE 15 + ln({f} / 1000) * 27 / ln(6.4::DOUBLE) END)"
_HZ_OF = lambda m: f"(CASE WHEN {m} < 15 THEN {m} * 200 / 3 ELSE 1000 * exp(({m} - 15) * ln(6.4::DOUBLE) / 27) END)"
S_BANK = f"""
bm AS (SELECT m, {_HZ_OF("m * t / 9")} AS l, {_HZ_OF("(m + 1) * t / 9")} AS c, {_HZ_OF("(m + 2) * t / 9")} AS r FROM (SELECT CAST(unnest(range(0, 8)) AS INT) AS m, {_MEL_OF("8000.0::DOUBLE")} AS t) q),
bank AS (SELECT m AS mel, b AS bin, greatest(0, least((b * 500.0 - l) / (c - l), (r - b * 500.0) / (r - c))) * 2 / (r - l) AS weight FROM bm CROSS JOIN (SELECT CAST(unnest(range(0, 17)) AS INT) AS b) q)"""
S_POW = S_X + """, n AS (SELECT rec, max(sample) + 1 AS n FROM x GROUP BY rec), f AS (SELECT rec, unnest(range(0, n // 16)) AS frame FROM n),
fr AS (SELECT f.rec, f.frame, x.sample - f.frame * 16 + 16 AS i, x.x FROM f JOIN x ON x.rec = f.rec AND x.sample BETWEEN f.frame * 16 - 16 AND f.frame * 16 + 15),
pw AS (SELECT rec, frame, b AS bin, pow(sum(x * cos(2 * pi() * b * i / 32)), 2) + pow(sum(x * sin(2 * pi() * b * i / 32)), 2) AS p FROM fr CROSS JOIN (SELECT CAST(unnest(range(0, 17)) AS INT) AS b) q GROUP BY rec, frame, b)"""

#: Log mel bands: emphasised samples, windowed; bands without a bin are the logarithm of the floor.
S_MEL = S_X + """, pe AS (SELECT rec, sample, x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY rec ORDER BY sample), 0) AS x FROM x),
n AS (SELECT rec, max(sample) + 1 AS n FROM x GROUP BY rec), f AS (SELECT rec, unnest(range(0, n // 16)) AS frame FROM n),
fr AS (SELECT f.rec, f.frame, pe.sample - f.frame * 16 + 16 AS i, pe.x FROM f JOIN pe ON pe.rec = f.rec AND pe.sample BETWEEN f.frame * 16 - 16 AND f.frame * 16 + 15),
fw AS (SELECT rec, frame, i, x * 0.5::DOUBLE * (1 - cos(2 * pi() * i / 32)) AS x FROM fr),
pw AS (SELECT rec, frame, b AS bin, pow(sum(x * cos(2 * pi() * b * i / 32)), 2) + pow(sum(x * sin(2 * pi() * b * i / 32)), 2) AS p FROM fw CROSS JOIN (SELECT CAST(unnest(range(0, 17)) AS INT) AS b) q GROUP BY rec, frame, b),""" + S_BANK + """,
lm AS (SELECT rec, frame, mel, ln(sum(weight * p) + 5.9604644775390625e-8::DOUBLE) AS value FROM pw JOIN bank USING (bin) GROUP BY rec, frame, mel)"""
#: Model input: running mean taken off, every second frame with two on both sides. The last analysis frame is left out.
S_ROWS = S_MEL + """, nm AS (SELECT rec, frame, mel, value / ln(10::DOUBLE) - avg(value / ln(10::DOUBLE)) OVER (PARTITION BY rec, mel ORDER BY frame) AS value FROM lm JOIN n USING (rec) WHERE frame < n // 32 * 2 - 1),
nr AS (SELECT rec, unnest(range(0, (max(frame) + 2) // 2)) AS frame FROM nm GROUP BY rec), ns AS (SELECT rec, frame, CAST(unnest(range(0, 40)) AS INT) AS dim FROM nr),
mi AS (SELECT ns.rec, ns.frame, ns.dim, round(coalesce(value, 0), 5) + 0.0 AS value FROM ns LEFT JOIN nm ON nm.rec = ns.rec AND nm.frame = ns.frame * 2 - 2 + ns.dim // 8 AND nm.mel = ns.dim % 8)"""


def power(s: SparkSession, d: str) -> DataFrame:
    return features.power_spectrum(features.analysis_frames(small(s, d), 32, 32, 16), 32)


add("m1_hann_window", lambda s, d: rounded(features.to_samples(small(s, d)).withColumn("i", (F.col("sample") % 32).cast("int")).join(F.broadcast(features.hann_table(s, 32)), "i").select("rec", "sample", (F.col("x") * F.col("weight")).alias("x")), "x"),
    "WITH " + S_X + " SELECT rec, sample, round(x * 0.5::DOUBLE * (1 - cos(2 * pi() * (sample % 32) / 32)), 6) + 0.0 AS x FROM x", "fx5")
add("m2_mel_filterbank", lambda s, d: rounded(power(s, d).select("rec", "frame", F.posexplode("power").alias("bin", "p")).join(F.broadcast(features.mel_filterbank_table(s, 32, 8, 16000)), "bin").select("rec", "frame", "mel", "bin", (F.col("weight") * 1000).alias("weight")), "weight"),
    "WITH " + S_X + "," + S_BANK + ", n AS (SELECT rec, max(sample) + 1 AS n FROM x GROUP BY rec), f AS (SELECT rec, unnest(range(0, n // 16)) AS frame FROM n) SELECT rec, frame, mel, bin, round(weight * 1000, 6) + 0.0 AS weight FROM f CROSS JOIN bank WHERE weight > 0", "fx5")
add("m3_power_spectrum", lambda s, d: rounded(power(s, d).select("rec", "frame", F.posexplode("power").alias("bin", "p")), "p", digits=5), "WITH " + S_POW + " SELECT rec, frame, bin, round(p, 5) + 0.0 AS p FROM pw", "fx5")
add("m4_mel_project", lambda s, d: rounded(features.mel_project(power(s, d), features.mel_filterbank_table(s, 32, 8, 16000)), "value", digits=6),
    "WITH " + S_POW + "," + S_BANK + " SELECT rec, frame, mel, round(sum(weight * p), 6) + 0.0 AS value FROM pw JOIN bank USING (bin) WHERE weight > 0 GROUP BY rec, frame, mel", "fx5")
add("m5_log_floor", lambda s, d: fx.features(s, d).select("rec", "frame", "dim", (F.round(features.log_floor(F.abs("value")), 6) + 0.0).alias("added"), (F.round(features.log_floor(F.abs("value"), 1e-3, "clamp"), 6) + 0.0).alias("clamped")),
    "SELECT rec, frame, dim, round(ln(abs(value) + 5.9604644775390625e-8::DOUBLE), 6) + 0.0 AS added, round(ln(greatest(abs(value), 1e-3::DOUBLE)), 6) + 0.0 AS clamped FROM fx6", "fx6")
add("m6_log_mel", lambda s, d: rounded(features.log_mel(small(s, d), MEL).select("rec", "frame", F.posexplode("values").alias("mel", "value")), "value", digits=5),
    "WITH " + S_MEL + " SELECT rec, frame, mel, round(value, 5) + 0.0 AS value FROM lm", "fx5")
add("m7_offline_features", lambda s, d: rounded(features.offline_features(small(s, d), MEL).select("rec", "frame", F.posexplode("values").alias("dim", "value")), "value", digits=5), "WITH " + S_ROWS + " SELECT * FROM mi", "fx5")
add("m8_context_chunks", lambda s, d: features.context_chunks(fx.chunks(s, d).select("rec", F.col("chunk").alias("frame"), F.col("samples").alias("values")), 4, 1, 2).select("rec", "window", F.size("values").alias("n"), "left", "right"),
    "WITH n AS (SELECT rec, max(chunk) + 1 AS n FROM fx5 GROUP BY rec), w AS (SELECT rec, n, unnest(range(0, (n - 2) // 4)) AS w FROM n) SELECT rec, w AS window, CAST(6 + CASE WHEN w > 0 THEN 1 ELSE 0 END AS INT) AS n, CAST(CASE WHEN w > 0 THEN 1 ELSE 0 END AS BIGINT) AS \"left\", CAST(2 AS BIGINT) AS \"right\" FROM w", "fx5")
add("m8_context_values", lambda s, d: rounded(
        features.context_chunks(embeddings(s, d), 4, 1, 2)
        .select("rec", "window", F.posexplode("values").alias("pos", "row"))
        .select("rec", "window", "pos", F.posexplode("row").alias("dim", "value")), "value"),
    """WITH n AS (SELECT rec, max(frame) + 1 AS n FROM fx6 GROUP BY rec), w AS (SELECT rec, unnest(range(0, (n - 2) // 4)) AS k FROM n)
    SELECT w.rec, w.k AS "window", CAST(frame - greatest(0, k * 4 - 1) AS INT) AS pos, dim, round(value, 6) + 0.0 AS value
    FROM w JOIN fx6 ON fx6.rec = w.rec AND frame BETWEEN k * 4 - 1 AND k * 4 + 5""", "fx6")
add("w1_cumulative_mean_norm", lambda s, d: rounded(features.cumulative_mean_norm(fx.features(s, d)), "value"),
    "SELECT rec, frame, dim, round(value / ln(10::DOUBLE) - avg(value / ln(10::DOUBLE)) OVER (PARTITION BY rec, dim ORDER BY frame), 6) + 0.0 AS value FROM fx6", "fx6")
add("w2_splice_subsample", lambda s, d: rounded(features.splice_subsample(fx.chunks(s, d).select("rec", F.col("chunk").alias("frame"), F.transform("samples", lambda x: x.cast("double")).alias("values")), 2, 3, 64).select("rec", "frame", F.posexplode("values").alias("pos", "value")), "value"),
    """WITH r AS (SELECT rec, unnest(range(0, (n + 2) // 3)) AS frame FROM (SELECT rec, max(frame) + 1 AS n FROM fx6 GROUP BY rec) q), g AS (SELECT rec, frame, CAST(unnest(range(0, 320)) AS INT) AS pos FROM r)
    SELECT g.rec, g.frame, g.pos, round(coalesce(value, 0), 6) + 0.0 AS value FROM g LEFT JOIN fx6 ON fx6.rec = g.rec AND fx6.frame = g.frame * 3 - 2 + g.pos // 64 AND fx6.dim = g.pos % 64""", "fx6")

# --- caches -------------------------------------------------------------------------------------------------


def probs(s: SparkSession, d: str) -> DataFrame:
    """All five event types are tracks."""
    return fx.activity(s, d)


S_PR = """pr AS (SELECT * FROM fx1),
sc AS (SELECT *, ln(greatest(prob, 0.25::DOUBLE)) - ln(1 - least(greatest(prob, 0), 0.75::DOUBLE)) + sum(ln(1 - least(greatest(prob, 0), 0.75::DOUBLE))) OVER (PARTITION BY rec, frame) + ln(2::DOUBLE) AS score FROM pr),
dl AS (SELECT rec, frame, track, prob, CASE WHEN prob <= 0.5 OR score <= 0 AND count(*) FILTER (prob > 0.5 AND score > 0) OVER (PARTITION BY rec, track) >= 2 THEN '-inf'::DOUBLE ELSE score END AS score FROM sc),
bl AS (SELECT rec, frame, track, CASE WHEN frame >= 25 THEN score + 0.05::DOUBLE ELSE score END AS score FROM dl),
bs AS (SELECT rec, frame, track, CASE WHEN row_number() OVER (PARTITION BY rec, track ORDER BY round(score, 9) DESC, frame) <= 3 AND score > '-inf'::DOUBLE THEN score + 2 * ln(2::DOUBLE) ELSE score END AS score FROM bl),
bw AS (SELECT rec, frame, track, CASE WHEN row_number() OVER (PARTITION BY rec, track ORDER BY round(score, 9) DESC, frame) <= 6 AND score > '-inf'::DOUBLE THEN score + ln(2::DOUBLE) ELSE score END AS score FROM bs),
sz AS (SELECT rec, max(frame) + 1 AS n, max(track) + 1 AS t FROM bw GROUP BY rec),
fl AS (SELECT bw.rec, track, frame, round(score, 9) AS score, n FROM bw JOIN sz USING (rec) UNION ALL SELECT rec, unnest(range(0, t)), n, 'inf'::DOUBLE, n FROM sz),
rk AS (SELECT *, track * (n + 1) + frame AS place, row_number() OVER (PARTITION BY rec ORDER BY score DESC, track * (n + 1) + frame) AS r FROM fl),
kp AS (SELECT rec, frame, score, n, row_number() OVER (PARTITION BY rec ORDER BY CASE WHEN score = '-inf'::DOUBLE THEN 1 ELSE 0 END, place) - 1 AS slot FROM rk WHERE r <= 25),
sl AS (SELECT rec, unnest(range(0, 25)) AS slot FROM sz),
cc AS (SELECT sl.rec, CAST(sl.slot AS INT) AS slot, CASE WHEN score > '-inf'::DOUBLE AND frame < n THEN frame END AS frame, NOT coalesce(score > '-inf'::DOUBLE AND frame < n, false) AS disabled FROM sl LEFT JOIN kp ON kp.rec = sl.rec AND kp.slot = sl.slot)"""


def finite(df: DataFrame) -> DataFrame:
    """Scores rounded, minus infinity as -999."""
    return df.select("rec", "frame", "track", F.when(F.col("score") == cache.NEVER, F.lit(-999.0)).otherwise(F.round("score", 6) + 0.0).alias("score"))


def _finite(source: str) -> str:
    return f"SELECT rec, frame, track, CASE WHEN score = '-inf'::DOUBLE THEN -999.0::DOUBLE ELSE round(score, 6) + 0.0 END AS score FROM {source}"


low = lambda s, d: cache.disable_low_scores(cache.log_pred_score(probs(s, d)), CACHE_5.quota(CACHE_5.positive))
latest = lambda s, d: cache.boost_latest(low(s, d), CACHE_5.capacity)
add("w11_log_pred_score", lambda s, d: finite(cache.log_pred_score(probs(s, d))), "WITH " + S_PR + " " + _finite("sc"), "fx1")
add("w12_disable_low_scores", lambda s, d: finite(low(s, d)), "WITH " + S_PR + " " + _finite("dl"), "fx1")
add("w13_boost_latest", lambda s, d: finite(latest(s, d)), "WITH " + S_PR + " " + _finite("bl"), "fx1")
add("w14_boost_topk", lambda s, d: finite(cache.boost_topk(latest(s, d), 3, 2.0)), "WITH " + S_PR + " " + _finite("bs"), "fx1")
add("k2_top_frames", lambda s, d: cache.top_frames(cache.boost_topk(cache.boost_topk(latest(s, d), 3, 2.0), 6, 1.0), 25, 1), "WITH " + S_PR + " SELECT * FROM cc", "fx1")
add("k3_compress_cache", lambda s, d: cache.compress_cache(probs(s, d), CACHE_5), "WITH " + S_PR + " SELECT * FROM cc", "fx1")


def quiet_probs(s: SparkSession, d: str) -> DataFrame:
    return fx.chunks(s, d).select("rec", F.col("chunk").alias("frame"), F.explode(F.array(F.lit(0), F.lit(1))).alias("track"), ((F.col("chunk") % 5) / 20.0).alias("prob"))


def embeddings(s: SparkSession, d: str) -> DataFrame:
    return fx.chunks(s, d).select("rec", F.col("chunk").alias("frame"), F.col("samples").alias("values"))


add("a6_silence_profile", lambda s, d: rounded(cache.silence_profile(embeddings(s, d), quiet_probs(s, d), 0.2, fx.features(s, d).where("frame = 0").select("rec", "dim", "value", F.lit(3).cast("long").alias("count"))), "value"),
    "WITH q AS (SELECT rec, dim, avg(value) AS v, count(*) AS c FROM fx6 WHERE (frame % 5) / 10.0 < 0.2 GROUP BY rec, dim), p AS (SELECT rec, dim, value FROM fx6 WHERE frame = 0) SELECT rec, dim, round((coalesce(v, 0) * coalesce(c, 0) + value * 3) / (coalesce(c, 0) + 3), 6) + 0.0 AS value, coalesce(c, 0) + 3 AS count FROM p LEFT JOIN q USING (rec, dim)", "fx6")



def frame_probs(s: SparkSession, d: str) -> DataFrame:
    """Five tracks over the frames of embeddings; every seventh frame is silent."""
    f, t = F.col("frame"), F.col("track")
    p = F.when(f % 7 == 6, F.lit(0.02)).when((f + t) % 5 == 0, 0.6 + f % 4 / 10).otherwise(0.05 + t / 50)
    return embeddings(s, d).select("rec", "frame", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("track")).withColumn("prob", p.cast("double"))


def kept_embeddings(s: SparkSession, d: str) -> DataFrame:
    """The cache as it is used: kept embeddings, and the mean of silent frames in the slots kept for silence."""
    pr = frame_probs(s, d)
    quiet = cache.silence_profile(embeddings(s, d), pr).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("m")).select("rec", F.transform("m", lambda x: x["value"]).alias("values"))
    return cache.gather(cache.compress_cache(pr, CACHE_5), embeddings(s, d).withColumn("values", F.col("values").cast("array<double>")), quiet)


add("k3_gather", lambda s, d: rounded(kept_embeddings(s, d).select("rec", "slot", "frame", F.posexplode("values").alias("dim", "value")), "value"),
    "WITH " + S_PR.replace("SELECT * FROM fx1", """SELECT rec, frame, CAST(t AS INT) AS track, CASE WHEN frame % 7 = 6 THEN 0.02::DOUBLE WHEN (frame + t) % 5 = 0 THEN 0.6::DOUBLE + frame % 4 / 10.0::DOUBLE ELSE 0.05::DOUBLE + t / 50.0::DOUBLE END AS prob
    FROM (SELECT rec, chunk AS frame, unnest(range(0, 5)) AS t FROM fx5) q""") + """, mean AS (SELECT rec, dim, avg(value) AS value FROM fx6 WHERE frame % 7 = 6 GROUP BY rec, dim)
    SELECT cc.rec, cc.slot, cc.frame, f.dim, round(f.value, 6) + 0.0 AS value FROM cc JOIN fx6 f ON f.rec = cc.rec AND f.frame = cc.frame
    UNION ALL SELECT cc.rec, cc.slot, cc.frame, mean.dim, round(mean.value, 6) + 0.0 FROM cc JOIN mean ON mean.rec = cc.rec WHERE cc.frame IS NULL""", "fx6")

# --- scorers ------------------------------------------------------------------------------------------------


def smoother(state: Any, row: np.ndarray, ingest: bool, decode: bool) -> tuple[np.ndarray, Any]:
    """Exponential mean of each row's values."""
    x = np.asarray(row, float).ravel()
    state = x * 0.5 if state is None else state * 0.5 + x * 0.5
    return state, state


def spread(state: Any, row: np.ndarray, ingest: bool, decode: bool) -> tuple[np.ndarray, Any]:
    """Mean magnitude of a window, smoothed."""
    x = np.abs(row).mean(axis=-1, keepdims=True)
    state = float(np.mean(x)) if state is None else 0.5 * state + 0.5 * float(np.mean(x))
    return (x * 0 + state if x.ndim > 1 else np.array([state])), state


add("u1_score_sequences", lambda s, d: reshape.sigmoid(scoring.score_sequences(embeddings(s, d), smoother, 0)).select("rec", "frame", "track", F.round("prob", 6).alias("prob")),
    """SELECT a.rec, a.frame, a.dim AS track, round(1 / (1 + exp(-sum(b.value * pow(0.5::DOUBLE, a.frame - b.frame + 1)))), 6) AS prob
    FROM fx6 a JOIN fx6 b ON b.rec = a.rec AND b.dim = a.dim AND b.frame <= a.frame GROUP BY a.rec, a.frame, a.dim""", "fx6")
add("u2_score_chunks", lambda s, d: rounded(scoring.score_chunks(small(s, d), spread), "prob"),
    # A chunk is scored after the 64 values before it; its mean magnitude is smoothed, the first one as it is.
    """WITH m AS (SELECT rec, frame, sum(abs(value)) AS t FROM fx6 GROUP BY rec, frame), c AS (SELECT rec, frame, (t + coalesce(lag(t) OVER (PARTITION BY rec ORDER BY frame), 0)) / 128 AS m FROM m)
    SELECT a.rec, a.frame AS chunk, round(sum(b.m * pow(0.5::DOUBLE, a.frame - b.frame + CASE WHEN b.frame = 0 THEN 0 ELSE 1 END)), 6) + 0.0 AS prob FROM c a JOIN c b ON b.rec = a.rec AND b.frame <= a.frame GROUP BY a.rec, a.frame""", "fx6")
add("u3_score_context_windows", lambda s, d: rounded(scoring.score_context_windows(features.context_chunks(embeddings(s, d), 4, 1, 2), spread).select("rec", "window", F.posexplode("values").alias("pos", "value")), "value"),
    # A window's mean magnitude, over one row before its four and two after them, is smoothed; all four rows have it.
    """WITH m AS (SELECT rec, frame, avg(abs(value)) AS m FROM fx6 GROUP BY rec, frame), n AS (SELECT rec, max(frame) + 1 AS n FROM m GROUP BY rec), w AS (SELECT rec, unnest(range(0, (n - 2) // 4)) AS k FROM n),
    c AS (SELECT w.rec, w.k, avg(m.m) AS x FROM w JOIN m ON m.rec = w.rec AND m.frame BETWEEN w.k * 4 - 1 AND w.k * 4 + 5 GROUP BY w.rec, w.k),
    s AS (SELECT a.rec, a.k, sum(b.x * pow(0.5::DOUBLE, a.k - b.k + CASE WHEN b.k = 0 THEN 0 ELSE 1 END)) AS v FROM c a JOIN c b ON b.rec = a.rec AND b.k <= a.k GROUP BY a.rec, a.k)
    SELECT rec, k AS "window", pos, round(v, 6) + 0.0 AS value FROM s CROSS JOIN (SELECT CAST(unnest(range(0, 4)) AS INT) AS pos) q""", "fx6")
add("w17_align_delay", lambda s, d: scoring.align_delay(fx.voice(s, d).select("rec", F.col("chunk").alias("step"), F.col("prob").alias("score")), 3),
    "WITH n AS (SELECT rec, max(chunk) + 1 - 3 AS n FROM fx7 GROUP BY rec) SELECT rec, chunk - 3 AS frame, prob AS score, chunk - 3 >= n - 3 AS tail FROM fx7 JOIN n USING (rec) WHERE chunk >= 3", "fx7")
add("t8_emission_ledger", lambda s, d: scoring.emission_ledger(small(s, d), 16000, 32, 16, 2, 2, 1),
    """WITH a AS (SELECT rec, chunk AS chunk_index, (chunk + 1) * 64 AS n FROM fx5), b AS (SELECT *, greatest(0, (n - 16) // 16 + 1) AS st FROM a),
    l AS (SELECT rec, chunk_index, round(n / 16000.0::DOUBLE, 3) AS buffer_seconds, greatest(0, CASE WHEN st - 3 >= 0 THEN (st - 3) // 2 + 1 ELSE 0 END - 1) AS total_frames, false AS flush FROM b
      UNION ALL SELECT rec, max(chunk_index) + 1, round(max(n) / 16000.0::DOUBLE, 3), (max(n) // 16 + 1) // 2, true FROM a GROUP BY rec)
    SELECT *, total_frames - coalesce(lag(total_frames) OVER (PARTITION BY rec ORDER BY chunk_index), 0) AS frames_emitted FROM l""", "fx5")
add("t9_refresh", lambda s, d: scoring.refresh(small(s, d), 100),
    # Each chunk has 64 samples, so every second one is due.
    "SELECT rec, chunk, (chunk + 1) // 2 AS refresh FROM fx5 WHERE (chunk + 1) % 2 = 0", "fx5")

# --- event time, as on a stream -----------------------------------------------------------------------------


def timed(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "events").select(F.col("user_id").alias("rec"), F.col("ts").cast("timestamp").alias("ts"), "value")


add("t1_sliding_chunks", lambda s, d: streams.sliding_chunks(timed(s, d), "2 days", "1 day").select("rec", F.unix_micros("window.start").alias("start"), "events", F.round("total", 4).alias("total")),
    """WITH e AS (SELECT user_id AS rec, epoch_us(ts) AS t, value FROM events), w AS (SELECT rec, (t // 86400000000 - k) * 86400000000 AS start, value FROM e CROSS JOIN (SELECT unnest([0, 1]) AS k) q)
    SELECT rec, start, count(*) AS events, round(sum(value), 4) AS total FROM w GROUP BY rec, start""")
add("t12_sessions", lambda s, d: streams.sessions(timed(s, d), "6 hours").select("rec", F.unix_micros("session.start").alias("start"), F.unix_micros("session.end").alias("end"), "events"),
    """WITH e AS (SELECT user_id AS rec, epoch_us(ts) AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY rec ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS n FROM e), g AS (SELECT *, sum(n) OVER (PARTITION BY rec ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM f)
    SELECT rec, min(t) AS start, max(t) + 21600000000 AS "end", count(*) AS events FROM g GROUP BY rec, s""")
add("s9_matrix_to_json", lambda s, d: reshape.matrix_to_json(fx.predicted_frames(s, d)),
    "SELECT rec, '{\"columns\":' || count(DISTINCT track) || ',\"rows\":' || count(DISTINCT frame) || ',\"values\":[' || string_agg(CAST(prob AS VARCHAR), ',' ORDER BY frame, track) || ']}' AS json FROM fx4 GROUP BY rec", "fx4")
