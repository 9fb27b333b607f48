"""User scorers over sequences and windows, delays, and the ledger of emitted frames.

A scorer is a function (state, row, ingest, decode) -> (row, state) on NumPy rows. State is None at first
and must be picklable. It is called in frame order for each recording.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.sources.shared import cut

from .folds import fold

Scorer = Callable[[Any, "np.ndarray | None", bool, bool], "tuple[np.ndarray, Any]"]


def preview_rows(state: Any, scorer: Scorer, delay: int, seen: int, width: int) -> list[np.ndarray]:
    """Outputs that are still to come after `seen` rows, from a copy of the state: `delay` zero rows follow, as at the end."""
    state, out = copy.deepcopy(state), []
    for t in range(seen, seen + delay):
        y, state = scorer(state, np.zeros(width), False, t >= delay)
        if t >= delay:
            out.append(y)
    return out


@dataclass
class Scored:
    """The scorer's state, rows taken and given so far, their width, and the end of the chunk before."""

    state: Any = None
    seen: int = 0
    emitted: int = 0
    width: int = 0
    before: np.ndarray | None = None


def score_sequences(features: DataFrame, scorer: Scorer, delay: int = 0) -> DataFrame:
    """rec, frame, track, logit: a scorer run over rec, frame, values in frame order.

    The output of row t comes with row t + delay; the last ones come from zero rows. A recording is read batch by
    batch, never whole.
    """

    def feed(own: Scored, x: np.ndarray, real: bool) -> np.ndarray | None:
        y, own.state = scorer(own.state, x, real, own.seen >= delay)
        own.seen += 1
        return y if own.seen > delay else None

    def rows(own: Scored, rec: Any, out: list[np.ndarray]) -> pd.DataFrame:
        tracks, first = len(out[0]) if out else 0, own.emitted
        own.emitted += len(out)
        frames = np.repeat(np.arange(first, own.emitted), tracks)
        return pd.DataFrame({"rec": [rec] * len(frames), "frame": frames, "track": np.tile(np.arange(tracks, dtype=np.int32), len(out)), "logit": np.concatenate(out) if out else []})

    def take(own: Scored, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for v in batch["values"]:
            x = np.asarray(v, float)
            own.width = len(x)
            y = feed(own, x, True)
            out += [] if y is None else [y]
        return rows(own, batch["rec"].iloc[0], out)

    def close(own: Scored, rec: Any) -> pd.DataFrame:
        return rows(own, rec, [y for _ in range(delay) if (y := feed(own, np.zeros(own.width), False)) is not None])

    return fold(features.select("rec", "frame", "values"), "frame", f"rec {dict(features.dtypes)['rec']}, frame long, track int, logit double", Scored, take, close)


def score_chunks(chunks: DataFrame, scorer: Scorer, context: int = 64) -> DataFrame:
    """rec, chunk, prob: a scorer over each chunk after the last samples of the one before, read batch by batch."""

    def take(own: Scored, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for v in batch["samples"]:
            x = np.concatenate((np.zeros(context) if own.before is None else own.before, np.asarray(v, float)))
            y, own.state = scorer(own.state, x, True, True)
            own.before = x[max(0, len(x) - context) :]
            out.append(float(np.ravel(y)[0]))
        return batch[["rec", "chunk"]].assign(prob=out)

    return fold(chunks.select("rec", "chunk", "samples"), "chunk", f"rec {dict(chunks.dtypes)['rec']}, chunk long, prob double", Scored, take)


def score_context_windows(windows: DataFrame, scorer: Scorer) -> DataFrame:
    """rec, window, values: a scorer over whole context windows (rec, window, values, left, right), in order, read batch by batch."""

    def take(own: Scored, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for v, left, right in zip(batch["values"], batch["left"], batch["right"], strict=True):
            x = np.stack([np.asarray(r, float) for r in v])
            y, own.state = scorer(own.state, x, True, True)
            out.append(np.asarray(y, float)[int(left) : len(x) - int(right)].ravel().tolist())
        return batch[["rec", "window"]].assign(values=out)

    return fold(windows, "window", f"rec {dict(windows.dtypes)['rec']}, window long, values array<double>", Scored, take)


def align_delay(outputs: DataFrame, delay: int) -> DataFrame:
    """rec, step, score of ingest steps to rec, frame, score, tail: step t + delay answers frame t; tail: by flush."""
    n = F.max("step").over(Window.partitionBy("rec")) + 1 - delay
    moved = outputs.withColumns({"frame": F.col("step") - delay, "_n": n})
    return moved.where("frame >= 0").select("rec", "frame", "score", (F.col("frame") >= F.col("_n") - delay).alias("tail"))


def emission_ledger(chunks: DataFrame, rate: float, nfft: int, hop: int, sub: int, context: int, delay: int) -> DataFrame:
    """What has been emitted after each chunk of samples, and after the flush at the end."""
    w = Window.partitionBy("rec").orderBy("chunk")
    n = F.sum(F.size("samples")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    seen = chunks.select("rec", F.col("chunk").alias("chunk_index"), n.alias("n"))
    stft = F.greatest(F.lit(0), F.floor((F.col("n") - nfft // 2) / hop) + 1)
    rows = F.when(stft - 1 - context >= 0, F.floor((stft - 1 - context) / sub) + 1).otherwise(F.lit(0))
    live = seen.withColumns({"buffer_seconds": F.round(F.col("n") / rate, 3), "total_frames": F.greatest(F.lit(0), rows - delay).cast("long"), "flush": F.lit(False)})
    last = seen.groupBy("rec").agg((F.max("chunk_index") + 1).alias("chunk_index"), F.max("n").alias("n"))
    end = last.select("rec", "chunk_index", "n", F.round(F.col("n") / rate, 3).alias("buffer_seconds"), F.ceil(F.floor(F.col("n") / hop) / sub).cast("long").alias("total_frames"), F.lit(True).alias("flush"))
    both = live.unionByName(end).drop("n")
    order = Window.partitionBy("rec").orderBy("chunk_index")
    return both.withColumn("frames_emitted", F.col("total_frames") - F.coalesce(F.lag("total_frames").over(order), F.lit(0)))


def refresh(chunks: DataFrame, every: int) -> DataFrame:
    """Chunks at which a refresh is due: rec, chunk, refresh (its number from 1).

    One is due at the first chunk by which at least `every` samples (1 at least) have come since the last one. Each chunk
    points to the one that is due next after it, found in the order of the running totals. Pointers are doubled:
    once those that jump 1, 2, 4, ... refreshes are known, the chunks due within twice as many follow from those
    found so far, so a recording of n refreshes takes log2(n) joins and no group of its rows.
    """
    every = max(1, every)
    w = Window.partitionBy("rec").orderBy("chunk")
    n = F.greatest(F.size("samples"), F.lit(0)).cast("long")
    totals = chunks.select("rec", "chunk", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    # Chunks without samples share a total; the first of them is the one at which it is reached.
    steps = totals.groupBy("rec", "total").agg(F.min("chunk").alias("chunk"))
    due = F.min(F.struct("total", "chunk")).over(Window.partitionBy("rec").orderBy("total").rangeBetween(every, Window.unboundedFollowing))
    jump = cut(steps.select("rec", F.col("total").alias("at"), due["total"].alias("to")).where("to is not null"))
    first = steps.where(F.col("total") >= every).groupBy("rec").agg(F.min("total").alias("at"))
    reached, size = cut(first.select("rec", "at", F.lit(1).cast("long").alias("refresh"))), 1
    while True:
        more = cut(reached.join(jump, ["rec", "at"]).select("rec", F.col("to").alias("at"), (F.col("refresh") + size).alias("refresh")))
        if not more.limit(1).count():
            break
        reached, size = cut(reached.union(more)), size * 2
        jump = cut(jump.join(jump.select("rec", F.col("at").alias("to"), F.col("to").alias("_far")), ["rec", "to"]).select("rec", "at", F.col("_far").alias("to")))
    return reached.join(steps.withColumnRenamed("total", "at"), ["rec", "at"]).select("rec", "chunk", "refresh")
