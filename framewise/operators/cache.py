"""Ranking and compression of embedding caches. probs: rec, frame, track, prob; embeddings: rec, frame, values."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEVER = float("-inf")


@dataclass(frozen=True)
class CacheConfig:
    capacity: int = 20
    tracks: int = 4
    silence: int = 1
    strong: float = 0.75
    weak: float = 1.5
    positive: float = 0.5
    latest: float = 0.05

    @property
    def per_track(self) -> int:
        return self.capacity // self.tracks - self.silence

    def quota(self, rate: float) -> int:
        return int(self.per_track * rate)


def silence_profile(embeddings: DataFrame, probs: DataFrame, threshold: float = 0.2, prior: DataFrame | None = None) -> DataFrame:
    """rec, dim, value, count: mean embedding of frames whose tracks sum below the threshold.

    prior (rec, dim, value, count) is continued.
    """
    quiet = probs.groupBy("rec", "frame").agg(F.sum("prob").alias("p")).where(F.col("p") < threshold).select("rec", "frame")
    cells = embeddings.join(quiet, ["rec", "frame"], "left_semi").select("rec", F.posexplode("values").alias("dim", "value"))
    now = cells.groupBy("rec", "dim").agg(F.avg(F.col("value").cast("double")).alias("value"), F.count("*").alias("count"))
    if prior is None:
        return now
    old = prior.select("rec", "dim", F.col("value").alias("v0"), F.col("count").alias("c0"))
    both = now.join(old, ["rec", "dim"], "full").fillna(0, ["value", "count", "v0", "c0"])
    n = F.col("count") + F.col("c0")
    return both.select("rec", "dim", ((F.col("value") * F.col("count") + F.col("v0") * F.col("c0")) / F.greatest(n, F.lit(1))).alias("value"), n.alias("count"))


def log_pred_score(probs: DataFrame) -> DataFrame:
    """score: how much a frame speaks for one track alone, on clipped probabilities."""
    w = Window.partitionBy("rec", "frame")
    p, q = F.greatest("prob", F.lit(0.25)), F.log(1 - F.greatest(F.lit(0.0), F.least("prob", F.lit(0.75))))
    return probs.withColumn("score", F.log(p) - q + F.sum(q).over(w) + math.log(2))


def disable_low_scores(scores: DataFrame, min_pos: int) -> DataFrame:
    """Scores of tracks at or below one half go, and scores of 0 or less where the track has min_pos positive frames."""
    w = Window.partitionBy("rec", "track")
    live = F.col("prob") > 0.5
    enough = F.count_if(live & (F.col("score") > 0)).over(w) >= min_pos
    return scores.withColumn("score", F.when(~live | ((F.col("score") <= 0) & enough), F.lit(NEVER)).otherwise(F.col("score")))


def boost_latest(scores: DataFrame, capacity: int, delta: float = 0.05) -> DataFrame:
    return scores.withColumn("score", F.when(F.col("frame") >= capacity, F.col("score") + delta).otherwise(F.col("score")))


def boost_topk(scores: DataFrame, k: int, scale: float) -> DataFrame:
    """Each track's k best finite scores grow by scale x ln 2; ties go to the earlier frame."""
    w = Window.partitionBy("rec", "track").orderBy(F.round("score", 9).desc(), "frame")
    best = (F.row_number().over(w) <= k) & (F.col("score") > NEVER)
    return scores.withColumn("score", F.when(best, F.col("score") + scale * math.log(2)).otherwise(F.col("score")))


def top_frames(scores: DataFrame, k: int, silence: int) -> DataFrame:
    """rec, slot, frame, disabled: the k best of scores and silence slots, as frames in order.

    Scores are laid out track by track, each with `silence` slots of infinite score after its last frame.
    The k best (ties to the smaller place) are sorted by place; a slot without a finite score, or a silence
    slot, is disabled.
    """
    n = scores.groupBy("rec").agg((F.max("frame") + 1).alias("n"), (F.max("track") + 1).alias("tracks"))
    real = scores.join(n, "rec").select("rec", "track", "frame", F.round("score", 9).alias("score"), "n")
    quiet = n.where(F.lit(silence > 0)).select("rec", "n", F.explode(F.sequence(F.lit(0), F.col("tracks") - 1)).alias("track"))
    quiet = quiet.select("rec", "track", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max(0, silence - 1))), lambda i: F.col("n") + i)).alias("frame"), F.lit(float("inf")).alias("score"), "n")
    places = real.unionByName(quiet).withColumn("place", F.col("track") * (F.col("n") + silence) + F.col("frame"))
    best = places.withColumn("r", F.row_number().over(Window.partitionBy("rec").orderBy(F.col("score").desc(), "place"))).where(F.col("r") <= k)
    off = (F.col("score") == NEVER) | (F.col("frame") >= F.col("n"))
    # Disabled scores have no place of their own and come last.
    order = Window.partitionBy("rec").orderBy(F.when(F.col("score") == NEVER, F.lit(1 << 62)).otherwise(F.col("place")), "place")
    got = best.select("rec", (F.row_number().over(order) - 1).alias("slot"), F.when(~off, F.col("frame")).alias("frame"), off.alias("disabled"))
    slots = n.select("rec", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    return slots.join(got, ["rec", "slot"], "left").select("rec", "slot", "frame", F.coalesce("disabled", F.lit(True)).alias("disabled"))


def compress_cache(probs: DataFrame, cfg: CacheConfig) -> DataFrame:
    """The slots that the cache keeps: rec, slot, frame, disabled."""
    s = disable_low_scores(log_pred_score(probs), cfg.quota(cfg.positive))
    s = boost_latest(s, cfg.capacity, cfg.latest)
    s = boost_topk(s, cfg.quota(cfg.strong), 2.0)
    s = boost_topk(s, cfg.quota(cfg.weak), 1.0)
    return top_frames(s, cfg.capacity, cfg.silence)


def gather(slots: DataFrame, embeddings: DataFrame, silence: DataFrame) -> DataFrame:
    """rec, slot, frame, values: embeddings of the kept frames, the mean silence (rec, values) elsewhere."""
    got = slots.join(embeddings.select("rec", "frame", "values"), ["rec", "frame"], "left")
    return got.join(silence.select("rec", F.col("values").alias("mean")), "rec", "left").select("rec", "slot", "frame", F.coalesce("values", "mean").alias("values"))


def compress(probs: np.ndarray, cfg: CacheConfig) -> list[int | None]:
    """Frames that a cache keeps, in order, None for silence: compress_cache on one matrix (frames, tracks)."""
    n, tracks = probs.shape
    q = np.log(1 - np.clip(probs, 0, 0.75))
    s = np.log(np.maximum(probs, 0.25)) - q + q.sum(axis=1, keepdims=True) + np.log(2)
    live = probs > 0.5
    enough = (live & (s > 0)).sum(axis=0) >= cfg.quota(cfg.positive)
    s = np.where(~live | ((s <= 0) & enough), -np.inf, s)
    s[cfg.capacity :] += cfg.latest
    for rate, scale in ((cfg.strong, 2.0), (cfg.weak, 1.0)):
        for t in range(tracks):
            order = np.lexsort((np.arange(n), -np.round(s[:, t], 9)))[: cfg.quota(rate)]
            s[[i for i in order if s[i, t] > -np.inf], t] += scale * np.log(2)
    flat = np.concatenate((np.round(s, 9), np.full((cfg.silence, tracks), np.inf))).T.ravel()
    best = np.lexsort((np.arange(len(flat)), -flat))[: cfg.capacity]
    kept = sorted(int(i) for i in best if flat[i] > -np.inf)
    out: list[int | None] = [f if (f := i % (n + cfg.silence)) < n else None for i in kept]
    return out + [None] * (cfg.capacity - len(out))
