"""Scoring predictions against reference turns: rasters, smoothing, collars, assignment, error rates.

turns: rec, start, duration, speaker. binary: rec, frame, track, active.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.timebase import time_to_frames
from framewise.sources.shared import cut


def speaker_order(turns: DataFrame, order: str) -> DataFrame:
    """Distinct speakers of a recording by first appearance, as columns from 0."""
    first = turns.groupBy("rec", "speaker").agg(F.min(order).alias("first"))
    w = Window.partitionBy("rec").orderBy("first", "speaker")
    return first.select("rec", "speaker", (F.row_number().over(w) - 1).cast("int").alias("track"))


def rasterize(turns: DataFrame, lengths: DataFrame, rate: float) -> DataFrame:
    """Dense rec, frame, speaker, active; lengths: rec, n_frames. Overlapping turns of a speaker count once."""
    a, b = time_to_frames(F.col("start"), rate, "half_even"), time_to_frames(F.col("start") + F.col("duration"), rate, "half_even")
    spans = turns.join(lengths, "rec").select("rec", "speaker", F.greatest(F.lit(0).cast("long"), a).alias("a"), F.least("n_frames", b).alias("b"))
    on = spans.where("b > a").select("rec", "speaker", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("frame")).distinct().withColumn("active", F.lit(1))
    grid = turns.select("rec", "speaker").distinct().join(lengths.where("n_frames > 0"), "rec").select("rec", "speaker", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("frame"))
    return grid.join(on, ["rec", "speaker", "frame"], "left").select("rec", "frame", "speaker", F.coalesce("active", F.lit(0)).alias("active"))


def encode_speakers(turns: DataFrame, dim: DataFrame) -> DataFrame:
    """Labels as tracks by dim (rec, speaker, track); unknown labels go."""
    return turns.join(dim, ["rec", "speaker"])


def binarize(frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """active where prob is above the threshold, strictly."""
    return frames.select("rec", "frame", "track", (F.col("prob") > threshold).cast("int").alias("active"))


def median_filter(binary: DataFrame, width: int) -> DataFrame:
    """Majority over a window of frames, cut at the ends; a tie is 1. An even width counts as the next odd one."""
    r = (width + (width % 2 == 0)) // 2
    w = Window.partitionBy("rec", "track").orderBy("frame").rowsBetween(-r, r)
    return binary.select("rec", "frame", "track", (F.sum("active").over(w) * 2 >= F.count("*").over(w)).cast("int").alias("active"))


def _near_change(dense: DataFrame, collar: int) -> DataFrame:
    """dense with near: within collar frames of a change of the track, or of its end if that is active."""
    if collar == 0:
        return dense.select("rec", "track", "frame", "active", F.lit(False).alias("near"))
    w, track = Window.partitionBy("rec", "track").orderBy("frame"), Window.partitionBy("rec", "track")
    change = dense.select("rec", "track", "frame", "active", (F.col("active") != F.lag("active", 1, 0).over(w)).cast("int").alias("change"), F.max("frame").over(track).alias("last"))
    last_on = F.max(F.when(F.col("frame") == F.col("last"), F.col("active"))).over(track)
    near = (F.max("change").over(w.rowsBetween(-(collar - 1), collar)) == 1) | ((last_on == 1) & (F.col("frame") > F.col("last") - collar))
    return change.select("rec", "track", "frame", "active", near.alias("near"))


def collar_mask(dense: DataFrame, collar: int) -> DataFrame:
    """rec, frame, valid: false within collar frames of a change of any track, or of an end that is active."""
    return _near_change(dense, collar).groupBy("rec", "frame").agg((~F.bool_or("near")).alias("valid"))


def _per_frame(pred: DataFrame, ref: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """rs and ps, the (t, a) tracks and activities of either side, and mark, by frame: whether any row of marks (rec, frame, mark) is true.

    Without marks those of ref count. All rows meet in one shuffle; frames without reference are left out.
    """
    kinds = {"r": dict(ref.dtypes)["track"], "p": dict(pred.dtypes)["track"]}
    none = {k: F.lit(None).cast(v) for k, v in kinds.items()}
    one = ref.select("rec", "frame", F.lit(0).alias("side"), F.col("track").alias("r"), none["p"].alias("p"), F.col("active").cast("long").alias("a"), (F.lit(None).cast("boolean") if marks else F.col("mark")).alias("mark"))
    two = pred.select("rec", "frame", F.lit(1).alias("side"), none["r"].alias("r"), F.col("track").alias("p"), F.col("active").cast("long").alias("a"), F.lit(None).cast("boolean").alias("mark"))
    rows = one.union(two)
    if marks:
        rows = rows.union(marks.select("rec", "frame", F.lit(2), none["r"], none["p"], F.lit(None).cast("long"), "mark"))
    side = lambda n, c: F.collect_list(F.when(F.col("side") == n, F.struct(F.col(c).alias("t"), "a")))
    per = rows.where("rec is not null and frame is not null").groupBy("rec", "frame").agg(side(0, "r").alias("rs"), side(1, "p").alias("ps"), F.bool_or("mark").alias("mark"))
    return per.where(F.size("rs") > 0)


def _marked(pred: DataFrame, ref: DataFrame, collar: int) -> DataFrame:
    return _per_frame(pred, _near_change(ref, collar).withColumnRenamed("near", "mark"))


def _sums(frames: DataFrame) -> DataFrame:
    """rec, kind, r, p, n of frames (rec, rs, ps), n summed: active frames of reference tracks (0) and of predicted ones (1),
    overlaps of pairs (2), and for the frames as such what is scored (3), missed (4), false (5) and active on both sides (6)."""
    kinds = {c: frames.schema[f"{c}s"].dataType.elementType["t"].dataType for c in "rp"}
    none = {k: F.lit(None).cast(v) for k, v in kinds.items()}
    item = lambda kind, r, p, n: F.struct(F.lit(kind).alias("kind"), r.alias("r"), p.alias("p"), n.alias("n"))
    on = lambda c: F.filter(c, lambda x: x["a"] == 1)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["a"], F.lit(0).cast("long")))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    counted = frames.select("rec", "rs", "ps", total("rs").alias("_r"), total("ps").alias("_p"))
    r, p = F.col("_r"), F.col("_p")
    whole = F.array(*[item(k, none["r"], none["p"], n) for k, n in ((3, r), (4, F.greatest(r - p, zero)), (5, F.greatest(p - r, zero)), (6, F.least(r, p)))])
    pairs = F.flatten(F.transform(on("rs"), lambda x: F.transform(on("ps"), lambda y: item(2, x["t"], y["t"], one))))
    told = F.concat(F.transform("rs", lambda x: item(0, x["t"], none["p"], x["a"])), F.transform("ps", lambda y: item(1, none["r"], y["t"], y["a"])), pairs, whole)
    return counted.select("rec", F.explode(told).alias("x")).groupBy("rec", "x.kind", "x.r", "x.p").agg(F.sum("x.n").alias("n"))


def _pair_counts(sums: DataFrame) -> DataFrame:
    """Counts of tracks and overlaps of pairs, for all pairs of a recording."""
    track = lambda k, c, name: sums.where(F.col("kind") == k).select("rec", F.col(c).alias(f"{name}_track"), F.col("n").alias(f"{name}_frames"))
    hits = sums.where("kind = 2").select("rec", F.col("r").alias("ref_track"), F.col("p").alias("pred_track"), F.col("n").alias("overlap"))
    out = track(0, "r", "ref").join(track(1, "p", "pred"), "rec").join(hits, ["rec", "ref_track", "pred_track"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))
    a, b, o = F.col("ref_frames"), F.col("pred_frames"), F.col("overlap")
    return out.withColumn("cost", F.greatest(a - b, F.lit(0)) + F.greatest(b - a, F.lit(0)) + F.least(a, b) - o)


def pair_counts(pred: DataFrame, ref: DataFrame, mask: DataFrame) -> DataFrame:
    """rec, ref_track, pred_track, ref_frames, pred_frames, overlap and cost over valid frames, for all pairs."""
    frames = _per_frame(pred, ref, mask.select("rec", "frame", F.col("valid").alias("mark")))
    return _pair_counts(cut(_sums(frames.where("mark"))))


def pair_counts_beyond(pred: DataFrame, ref: DataFrame, collar: int) -> DataFrame:
    """pair_counts over the frames that collar_mask(ref, collar) leaves, without a table of the mask."""
    return _pair_counts(cut(_sums(_marked(pred, ref, collar).where("not mark"))))


def cheapest(cost: list[list[int]]) -> list[int]:
    """The column of each row in the cheapest one-to-one matching, of equals the smallest in order; rows <= columns.

    Each row in turn is brought in by a shortest path over reduced costs. Costs carry the columns as digits
    below them, so that no two matchings cost the same.
    """
    rows, columns = len(cost), len(cost[0]) if cost else 0
    weight = [columns ** (rows - 1 - i) for i in range(rows)]
    exact = [[c * columns**rows + j * weight[i] for j, c in enumerate(line)] for i, line in enumerate(cost)]
    row_price, column_price = [0] * rows, [0] * columns
    owner: dict[int, int] = {}
    for new in range(rows):
        reach: dict[int, tuple[int, int | None]] = {}  # column: cost of the cheapest path to it, column before it
        settled: dict[int, int] = {}
        row, base, via = new, 0, None
        while True:
            for j in range(columns):
                step = base + exact[row][j] - row_price[row] - column_price[j]
                if j not in settled and (j not in reach or step < reach[j][0]):
                    reach[j] = (step, via)
            via = min((j for j in reach if j not in settled), key=lambda j: (reach[j][0], j))
            base = settled[via] = reach[via][0]
            if via not in owner:
                break
            row = owner[via]
        row_price[new] += base
        for j, at in settled.items():
            if j in owner:
                row_price[owner[j]] += base - at
            column_price[j] -= base - at
        while via is not None:
            before = reach[via][1]
            owner[via] = new if before is None else owner[before]
            via = before
    return [j for _, j in sorted((i, j) for j, i in owner.items())]


def optimal_assignment(costs: DataFrame) -> DataFrame:
    """rec, ref_track, pred_track of the cheapest one-to-one matching; of equals the smallest path.

    costs: rec, ref_track, pred_track, cost for all pairs. The path is the partners' order for each track of the
    shorter side in order. A recording's matrix, which has no more rows than tracks, is one row,
    so that many short recordings don't cost a group each.
    """
    kinds = dict(costs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs, refs, preds = [], [], []
            for rec, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, columns = sorted({c["r"] for c in cells}), sorted({c["p"] for c in cells})
                if [(c["r"], c["p"]) for c in cells] != [(r, p) for r in rows for p in columns]:
                    raise ValueError("each pair of tracks must have one cost")
                grid = [[int(c["cost"]) for c in cells[i : i + len(columns)]] for i in range(0, len(cells), len(columns))]
                flip = len(rows) > len(columns)
                best = list(enumerate(cheapest([list(x) for x in zip(*grid, strict=True)] if flip else grid)))
                pairs = [(rows[j], columns[i]) for i, j in best] if flip else [(rows[i], columns[j]) for i, j in best]
                recs += [rec] * len(pairs)
                refs += [r for r, _ in pairs]
                preds += [p for _, p in pairs]
            own, cell = batch.schema.field(0).type, batch.schema.field(1).type.value_type
            yield pa.RecordBatch.from_arrays([pa.array(recs, own), pa.array(refs, cell.field("r").type), pa.array(preds, cell.field("p").type)], names=["rec", "ref_track", "pred_track"])

    cell = F.struct(F.col("ref_track").alias("r"), F.col("pred_track").alias("p"), "cost")
    some = costs.where("rec is not null").groupBy("rec").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return some.mapInArrow(run, f"rec {kinds['rec']}, ref_track {kinds['ref_track']}, pred_track {kinds['pred_track']}")


def apply_assignment(pred: DataFrame, assignment: DataFrame, grid: DataFrame) -> DataFrame:
    """Predictions as reference tracks over grid (rec, frame, track); a track without a partner is 0."""
    moved = pred.join(assignment.withColumnRenamed("pred_track", "track"), ["rec", "track"]).select("rec", "frame", F.col("ref_track").alias("track"), F.col("active").alias("mapped"))
    return grid.select("rec", "frame", "track").join(moved, ["rec", "frame", "track"], "left").select("rec", "frame", "track", F.coalesce("mapped", F.lit(0)).alias("active"))


def unmatched_tracks(pred: DataFrame, assignment: DataFrame) -> DataFrame:
    return pred.select("rec", "track").distinct().join(assignment.select("rec", F.col("pred_track").alias("track")), ["rec", "track"], "left_anti")


def der(pred: DataFrame, ref: DataFrame, threshold: float = 0.5, median: int = 1, collar: int = 0) -> DataFrame:
    """scored, miss, false_alarm, error and der of each recording.

    pred: rec, frame, track, prob. ref: dense rec, frame, track, active. Predicted tracks without a partner
    count as false alarms; der is 0 where nothing is scored.
    """
    hard = median_filter(binarize(pred, threshold), median) if median > 1 else binarize(pred, threshold)
    # Frames that a pair of partners shares are its overlap, so no frame needs to know its tracks.
    counts = cut(_sums(_marked(hard, ref, collar).where("not mark")))
    pairs = _pair_counts(counts)
    shared = pairs.join(optimal_assignment(pairs), ["rec", "ref_track", "pred_track"]).groupBy("rec").agg(F.sum("overlap").alias("o"))
    names = {3: "scored", 4: "miss", 5: "false_alarm", 6: "both"}
    sums = counts.where("kind > 2").groupBy("rec").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(c) for k, c in names.items()])
    sums = sums.join(shared, "rec", "left").withColumn("error", F.col("both") - F.coalesce("o", F.lit(0)))
    sums = sums.select("rec", *[F.col(c).cast("double").alias(c) for c in ("scored", "miss", "false_alarm", "error")])
    return sums.withColumn("der", F.when(F.col("scored") > 0, (F.col("miss") + F.col("false_alarm") + F.col("error")) / F.col("scored")).otherwise(F.lit(0.0)))


def corpus_der(results: DataFrame, dataset: str) -> DataFrame:
    """Pooled over datasets and in all: sums first, then the ratio."""
    sums = results.rollup(dataset).agg(*[F.sum(c).alias(c) for c in ("scored", "miss", "false_alarm", "error")])
    return sums.withColumn("der", F.when(F.col("scored") > 0, (F.col("miss") + F.col("false_alarm") + F.col("error")) / F.col("scored")).otherwise(F.lit(0.0)))


def compare(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """max_abs and mean_abs difference of frame tables by recording; infinity where the shapes differ."""
    keys = ["rec", "frame", "track"]
    a, b = actual.select(*keys, F.col("prob").alias("x")), expected.select(*keys, F.col("prob").alias("y"))
    d = a.join(b, keys, "full").groupBy("rec").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("m"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("a"), F.bool_or(F.col("x").isNull() | F.col("y").isNull()).alias("odd"))
    inf = F.lit(float("inf"))
    return d.select("rec", F.when(F.col("odd"), inf).otherwise(F.col("m")).alias("max_abs"), F.when(F.col("odd"), inf).otherwise(F.col("a")).alias("mean_abs"))
