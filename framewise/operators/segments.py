"""Activity segments: runs, hysteresis, merging, and the tables of segments and speakers.

frames: rec, frame, track, prob. segments: rec, track, start_frame, end_frame (exclusive).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("rec", "track")


@dataclass(frozen=True)
class SegmentConfig:
    """Thresholds, and paddings, gaps and lengths in frames. Segments are closed when longer than min_on."""

    on: float = 0.5
    off: float = 0.5
    pad_on: int = 0
    pad_off: int = 0
    min_on: int = 0
    min_off: int = 0

    def __post_init__(self) -> None:
        if self.on < self.off:
            raise ValueError("on must not be below off")
        if min(self.pad_on, self.pad_off, self.min_on, self.min_off) < 0:
            raise ValueError("frame counts must not be negative")

    @classmethod
    def of_seconds(cls, rate: float, on: float = 0.5, off: float = 0.5, pad_on: float = 0, pad_off: float = 0, min_on: float = 0, min_off: float = 0) -> SegmentConfig:
        """The same from seconds, rounded half away from zero."""
        n = lambda s: int(s * rate + 0.5)
        return cls(on, off, n(pad_on), n(pad_off), n(min_on), n(min_off))


def runs(binary: DataFrame) -> DataFrame:
    """Maximal active runs [start_frame, end_frame) of rec, frame, track, active."""
    w = Window.partitionBy(*KEYS).orderBy("frame")
    on = binary.where("active = 1").select(*KEYS, "frame", (F.col("frame") - F.row_number().over(w)).alias("island"))
    return on.groupBy(*KEYS, "island").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame")).drop("island")


def hysteresis(frames: DataFrame, on: float = 0.5, off: float = 0.5) -> DataFrame:
    """active: on above `on`, off below `off`, else as before; off at first."""
    SegmentConfig(on, off)
    w = Window.partitionBy(*KEYS).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("prob") > on, 1).when(F.col("prob") < off, 0)
    return frames.select(*KEYS, "frame", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)).alias("active"))


def build_segments(frames: DataFrame, cfg: SegmentConfig | None = None, clip: bool = False) -> DataFrame:
    """Padded, merged segments of tracks.

    Islands of the hysteresis are padded; a gap of min_off or less joins neighbours. An island goes when
    it is too short, unless it joins on to a long one before it. clip keeps ends within the recording.
    """
    cfg = cfg or SegmentConfig()
    ordered = Window.partitionBy(*KEYS).orderBy("frame")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("prob") > cfg.on, 1).when(F.col("prob") < cfg.off, 0)
    state = frames.select(*KEYS, "frame", F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.lit(0)).alias("active"), (F.max("frame").over(Window.partitionBy(*KEYS)) + 1).alias("n"))
    islands = state.withColumn("island", F.sum(1 - F.col("active")).over(upto)).where("active = 1")
    islands = islands.groupBy(*KEYS, "island").agg(F.min("frame").alias("f0"), (F.max("frame") + 1).alias("f1"), F.max("n").alias("n"))
    padded = islands.select(*KEYS, F.greatest(F.lit(0), F.col("f0") - cfg.pad_on).alias("a"), (F.col("f1") + cfg.pad_off).alias("b"), (F.col("f1") == F.col("n")).alias("open"), "n")
    w = Window.partitionBy(*KEYS).orderBy("a", "b")
    fresh = (F.lag("b").over(w).isNull() | (F.col("a") - F.lag("b").over(w) > cfg.min_off)).cast("int")
    parts = padded.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    long = (F.col("b") - F.col("a") > cfg.min_on) | (F.col("open") & (F.col("b") - F.col("a") >= cfg.min_on))
    kept = parts.withColumn("seen", F.max(long.cast("int")).over(Window.partitionBy(*KEYS, "part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0))).where("seen = 1")
    end = F.least(F.max("b"), F.max("n")) if clip else F.max("b")
    return kept.groupBy(*KEYS, "part").agg(F.min("a").alias("start_frame"), end.alias("end_frame")).drop("part")


def with_times(segments: DataFrame, rate: float) -> DataFrame:
    return segments.withColumns({"start_time": F.col("start_frame") / rate, "end_time": F.col("end_frame") / rate, "duration": (F.col("end_frame") - F.col("start_frame")) / rate})


def mark_final(segments: DataFrame, last: DataFrame, margin: int) -> DataFrame:
    """finalized: the segment ends more than margin frames before rec's frame count (rec, frames_seen)."""
    return segments.join(last, "rec").select(*segments.columns, (F.col("end_frame") < F.col("frames_seen") - margin).alias("finalized"))


def finalize(segments: DataFrame, min_on: int) -> DataFrame:
    """Tentative segments shorter than min_on go, the others become final."""
    return segments.where(F.col("finalized") | (F.col("end_frame") - F.col("start_frame") >= min_on)).withColumn("finalized", F.lit(True))


def sort_segments(segments: DataFrame) -> DataFrame:
    return segments.orderBy("rec", "start_frame", "end_frame", "track")


def dedup_segments(segments: DataFrame) -> DataFrame:
    """Segments are equal by recording, start, end and track."""
    return segments.dropDuplicates(["rec", "start_frame", "end_frame", "track"])


def new_segments(before: DataFrame, after: DataFrame) -> DataFrame:
    """Segments finalized by this batch."""
    return after.join(before, ["rec", "track", "start_frame", "end_frame"], "left_anti")


def append_segments(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def drop_last(segments: DataFrame, n: int = 1) -> DataFrame:
    """Without the n latest segments of each track."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("start_frame").desc(), F.col("end_frame").desc())
    return segments.withColumn("nth", F.row_number().over(w)).where(F.col("nth") > n).drop("nth")


def clear(segments: DataFrame, tentative_only: bool = True) -> DataFrame:
    return segments.where("finalized") if tentative_only else segments.where(F.lit(False))


def extend(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Each segment of a united with b's by the key: least start, greatest end."""
    other = b.select(*on, F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"))
    return a.join(other, on, "left").select(*on, F.least("start_frame", "_s").alias("start_frame"), F.greatest("end_frame", "_e").alias("end_frame"))


def speaker_stats(segments: DataFrame, rate: float) -> DataFrame:
    """Segments, frames and seconds of each track: all, finalized, tentative."""
    n, final = F.col("end_frame") - F.col("start_frame"), F.col("finalized")
    frames = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    out = segments.groupBy(*KEYS).agg(
        F.count("*").alias("segments"), F.count_if(final).alias("finalized_segments"), F.count_if(~final).alias("tentative_segments"),
        frames(F.lit(True)).alias("frames"), frames(final).alias("finalized_frames"), frames(~final).alias("tentative_frames"),
    )
    return out.withColumns({"seconds": F.col("frames") / rate, "has_segments": F.col("segments") > 0})


def timeline_stats(frames: DataFrame, rate: float) -> DataFrame:
    """Finalized, tentative and all frames of each recording, and their durations."""
    per = frames.groupBy("rec", "frame").agg(F.max("finalized").alias("finalized"))
    out = per.groupBy("rec").agg(F.count_if("finalized").alias("finalized_frames"), F.count_if(~F.col("finalized")).alias("tentative_frames"), F.count("*").alias("frames"))
    return out.withColumns({"finalized_seconds": F.col("finalized_frames") / rate, "tentative_seconds": F.col("tentative_frames") / rate, "seconds": F.col("frames") / rate})


def dominant_track(segments: DataFrame) -> DataFrame:
    """The track with most frames; the lowest of equals."""
    n = segments.groupBy(*KEYS).agg(F.sum(F.col("end_frame") - F.col("start_frame")).alias("frames"))
    return n.groupBy("rec").agg(F.max_by("track", F.struct("frames", -F.col("track"))).alias("track"), F.max("frames").alias("frames"))


def speakers_from_segments(segments: DataFrame) -> DataFrame:
    return segments.select(*KEYS).distinct()


def overlap_join(a: DataFrame, b: DataFrame, bucket: int = 64) -> DataFrame:
    """Pairs of segments of a recording that overlap or touch.

    Both sides are dealt to buckets of frames and joined on (rec, bucket), so it never is a nested loop; a
    pair is kept in the bucket of its later start only.
    """
    def dealt(df: DataFrame, p: str) -> DataFrame:
        cols = [F.col(c).alias(f"{p}_{c}") for c in ("track", "start_frame", "end_frame")]
        return df.select("rec", *cols, F.explode(F.sequence(F.floor(F.col("start_frame") / bucket), F.floor(F.col("end_frame") / bucket))).alias("bucket"))

    meets = (F.col("a_start_frame") <= F.col("b_end_frame")) & (F.col("b_start_frame") <= F.col("a_end_frame"))
    once = F.col("bucket") == F.floor(F.greatest("a_start_frame", "b_start_frame") / bucket)
    return dealt(a, "a").join(dealt(b, "b"), ["rec", "bucket"]).where(meets & once).drop("bucket")


def keep_speakers(speakers: DataFrame, segments: DataFrame, mode: str) -> DataFrame:
    """Speakers that survive a reset: nothing, named, all, with_segments or without_segments."""
    if mode == "nothing":
        return speakers.where(F.lit(False))
    if mode == "named":
        return speakers.where("name IS NOT NULL")
    if mode == "all":
        return speakers
    if mode in ("with_segments", "without_segments"):
        return speakers.join(segments.select(*KEYS), list(KEYS), "left_semi" if mode == "with_segments" else "left_anti")
    raise ValueError(f"unknown mode {mode}")


def upsert_speaker(speakers: DataFrame, rows: DataFrame, slots: int) -> DataFrame:
    """Names at slots: rows (rec, track or null, name) rename, insert, or take the first free slot.

    Slots outside 0..slots-1 are ignored. Of several rows without a slot for one recording the first by
    name takes the first free slot.
    """
    fixed = rows.where(F.col("track").between(0, slots - 1))
    placed = speakers.select(*KEYS).union(fixed.select(*KEYS)).distinct()
    loose = rows.where("track IS NULL").groupBy("rec").agg(F.min("name").alias("name"))
    grid = loose.select("rec", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("track"))
    free = grid.join(placed, list(KEYS), "left_anti").groupBy("rec").agg(F.min("track").alias("track"))
    new = fixed.select(*KEYS, "name").unionByName(loose.join(free, "rec").select(*KEYS, "name")).toDF(*KEYS, "new_name")
    return speakers.join(new, list(KEYS), "full").select(*KEYS, F.coalesce("new_name", "name").alias("name"))


def enroll(speakers: DataFrame, segments: DataFrame, names: DataFrame, overwrite: bool) -> DataFrame:
    """names (rec, name) given to each recording's dominant track: track, name and accepted.

    Without speech the track is null and nothing is accepted. A named slot is renamed only with overwrite.
    """
    top = dominant_track(segments).select("rec", "track")
    known = speakers.select("rec", "track", F.col("name").alias("old"))
    out = names.join(top, "rec", "left").join(known, ["rec", "track"], "left")
    ok = F.col("track").isNotNull() & (F.col("old").isNull() | F.lit(overwrite))
    return out.select("rec", "track", F.when(ok, F.col("name")).otherwise(F.col("old")).alias("name"), ok.alias("accepted"))


def display_labels(speakers: DataFrame) -> DataFrame:
    """label: the trimmed name, or Speaker and the slot's number from 1."""
    fallback: Column = F.concat(F.lit("Speaker "), (F.col("track") + 1).cast("string"))
    return speakers.select(*KEYS, F.coalesce(F.nullif(F.trim("name"), F.lit("")), fallback).alias("label"))
