"""Projections, filters and reshaping of frame tables (rec, frame, track, prob)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.timebase import frames_to_time


def matrix_to_long(flat: DataFrame) -> DataFrame:
    """rec, columns, values (row-major) to rec, frame, track, value."""
    cells = flat.select("rec", "columns", F.posexplode("values").alias("pos", "value"))
    return cells.select("rec", F.floor(F.col("pos") / F.col("columns")).cast("long").alias("frame"), (F.col("pos") % F.col("columns")).cast("int").alias("track"), F.col("value").cast("double").alias("value"))


def long_to_rows(frames: DataFrame, value: str = "prob") -> DataFrame:
    """rec, frame, values ordered by track."""
    g = frames.groupBy("rec", "frame").agg(F.array_sort(F.collect_list(F.struct("track", value))).alias("cells"))
    return g.select("rec", "frame", F.transform("cells", lambda c: c[value]).alias("values"))


def validate_shape(flat: DataFrame, strict: bool = False) -> DataFrame:
    """Rows whose flat length isn't a multiple of columns; strict raises on the first."""
    bad = (F.col("columns") <= 0) | (F.size("values") % F.greatest("columns", F.lit(1)) != 0)
    if strict:
        return flat.where(F.assert_true(~bad, F.lit("values are no multiple of columns")).isNull())
    return flat.where(bad).select("rec", "columns", F.size("values").alias("length"))


def slice_frames(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Frames of [start, end), counted from 0 again."""
    a = max(0, start)
    return frames.where((F.col("frame") >= a) & (F.col("frame") < end)).withColumn("frame", F.col("frame") - a)


def drop_first(frames: DataFrame, n: int) -> DataFrame:
    return slice_frames(frames, n, 1 << 62)


def first_tracks(frames: DataFrame, k: int) -> DataFrame:
    return frames.where(F.col("track") < k)


def crop_boundary(frames: DataFrame) -> DataFrame:
    """Without the first and the last track, counted from 0 again; two tracks or fewer leave nothing."""
    last = F.max("track").over(Window.partitionBy("rec"))
    return frames.withColumn("_last", last).where((F.col("track") > 0) & (F.col("track") < F.col("_last"))).withColumn("track", F.col("track") - 1).drop("_last")


def select_tracks(frames: DataFrame, order: list[int]) -> DataFrame:
    """Tracks of the list, numbered by their place in it."""
    places = frames.sparkSession.createDataFrame([(s, d) for d, s in enumerate(order)], "track int, _to int")
    return frames.join(F.broadcast(places), "track").select("rec", "frame", F.col("_to").alias("track"), *[c for c in frames.columns if c not in ("rec", "frame", "track")])


def sigmoid(frames: DataFrame, column: str = "logit") -> DataFrame:
    return frames.withColumn("prob", 1 / (1 + F.exp(-F.col(column))))


def probability_at(frames: DataFrame, keys: DataFrame, missing: float = float("nan")) -> DataFrame:
    """prob at keys (rec, frame, track); `missing` outside."""
    return keys.join(frames.select("rec", "frame", "track", "prob"), ["rec", "frame", "track"], "left").select("rec", "frame", "track", F.coalesce("prob", F.lit(missing)).alias("prob"))


def retain_last(frames: DataFrame, n: int) -> DataFrame:
    last = F.max("frame").over(Window.partitionBy("rec"))
    return frames.withColumn("_last", last).where(F.col("frame") > F.col("_last") - n).drop("_last")


def recent_view(frames: DataFrame, seconds: float, rate: float) -> DataFrame:
    """The last seconds (one frame at least) with the view's start and end in seconds."""
    n = max(1, int(seconds * rate + 0.5))
    w = Window.partitionBy("rec")
    kept = retain_last(frames, n)
    return kept.withColumns({"view_start": frames_to_time(F.min("frame").over(w), rate), "view_end": frames_to_time(F.max("frame").over(w) + 1, rate)})


def append_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """b after the last frame of a, by recording. The columns must be the same."""
    if set(a.columns) != set(b.columns):
        raise ValueError("columns differ")
    ends = a.groupBy("rec").agg((F.max("frame") + 1).alias("_n"))
    moved = b.join(ends, "rec", "left").withColumn("frame", F.col("frame") + F.coalesce("_n", F.lit(0)))
    return a.unionByName(moved.drop("_n"))


def patch_frames(existing: DataFrame, patch: DataFrame) -> DataFrame:
    """existing with patch's rows in place of its own, dense over the frames and tracks of both; gaps are 0."""
    keys = ["rec", "frame", "track"]
    both = existing.select(*keys, "prob").join(patch.select(*keys, F.col("prob").alias("_p")), keys, "full").select(*keys, F.coalesce("_p", "prob").alias("prob"))
    size = both.groupBy("rec").agg(F.max("frame").alias("n"), F.max("track").alias("t"))
    grid = size.select("rec", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("frame"), "t").select("rec", "frame", F.explode(F.sequence(F.lit(0), "t")).alias("track"))
    return grid.join(both, keys, "left").select(*keys, F.coalesce("prob", F.lit(0.0)).alias("prob"))


def committed_plus_preview(committed: DataFrame, preview: DataFrame) -> DataFrame:
    """Committed and preview frames as one table; the preview wins."""
    both = committed.withColumn("_first", F.lit(1)).unionByName(preview.withColumn("_first", F.lit(0)))
    w = Window.partitionBy("rec", "frame", "track").orderBy("_first")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_first", "_n")


def matrix_to_json(frames: DataFrame) -> DataFrame:
    """rec, json: {"columns", "rows", "values"} in row-major order, keys sorted."""
    g = frames.groupBy("rec").agg(F.count_distinct("track").alias("columns"), F.count_distinct("frame").alias("rows"), F.array_sort(F.collect_list(F.struct("frame", "track", "prob"))).alias("cells"))
    return g.select("rec", F.to_json(F.struct("columns", "rows", F.transform("cells", lambda c: c["prob"]).alias("values"))).alias("json"))
