"""Voice activity: thresholds, speech regions, padding, extraction. vad: rec, chunk, prob."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a chunk and of a second.
CHUNK, RATE = 4096, 16_000


@dataclass(frozen=True)
class VadConfig:
    """Durations in seconds; negative overrides the exit threshold, else it lies offset below the entry."""

    threshold: float = 0.85
    negative: float | None = None
    offset: float = 0.15
    min_speech: float = 0.15
    min_silence: float = 0.75
    max_speech: float = 14.0
    pad: float = 0.1
    split_threshold: float = 0.3
    split_silence: float = 0.098
    longest_silence: bool = True

    def problems(self) -> list[str]:
        """Soft warnings; hard errors are raised when the object is made."""
        out = []
        if self.min_speech > self.max_speech:
            out.append("min_speech is above max_speech")
        if self.pad > self.min_speech:
            out.append("pad is above min_speech")
        if self.exit > self.split_threshold:
            out.append("the exit threshold is above split_threshold")
        return out

    def __post_init__(self) -> None:
        if min(self.min_speech, self.min_silence, self.pad, self.split_silence) < 0 or self.max_speech <= 0:
            raise ValueError("durations must not be negative, max_speech must be positive")
        if not all(0 <= x <= 1 for x in (self.threshold, self.split_threshold, self.negative if self.negative is not None else 0)):
            raise ValueError("thresholds must be within 0 and 1")

    @property
    def entry(self) -> float:
        return self.threshold if self.negative is None else min(1.0, self.negative + self.offset)

    @property
    def exit(self) -> float:
        return self.negative if self.negative is not None else max(0.01, self.entry - self.offset)


def samples(seconds: float) -> int:
    return int(seconds * RATE)


def voice_active(vad: DataFrame, threshold: float = 0.85) -> DataFrame:
    """active where prob reaches the threshold."""
    return vad.withColumn("active", F.col("prob") >= threshold)


def resolve_thresholds(configs: DataFrame) -> DataFrame:
    """configs (threshold, negative, offset) with entry and exit."""
    entry = F.when(F.col("negative").isNull(), F.col("threshold")).otherwise(F.least(F.lit(1.0), F.col("negative") + F.col("offset")))
    return configs.withColumn("entry", entry).withColumn("exit", F.coalesce("negative", F.greatest(F.col("entry") - 0.15, F.lit(0.01))))


def speech_regions(vad: DataFrame, cfg: VadConfig | None = None) -> DataFrame:
    """rec, start_sample, end_sample of speech, without a longest duration.

    Chunks at or above the entry threshold are anchors. Speech ends at the first chunk below the exit
    threshold after an anchor, once such a chunk lies min_silence after it and before the next anchor.
    """
    cfg = cfg or VadConfig()
    w = Window.partitionBy("rec").orderBy("chunk")
    at = F.col("chunk") * CHUNK
    marked = vad.select("rec", "chunk", "prob", F.sum((F.col("prob") >= cfg.entry).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("anchor"), ((F.max("chunk").over(Window.partitionBy("rec")) + 1) * CHUNK).alias("total"))
    quiet = F.when(F.col("prob") < cfg.exit, at)
    groups = marked.where("anchor > 0").groupBy("rec", "anchor").agg(F.min(at).alias("start"), F.min(quiet).alias("t0"), F.max(quiet).alias("t1"), F.max("total").alias("total"))
    groups = groups.withColumn("ends", F.coalesce(F.col("t1") - F.col("t0") >= samples(cfg.min_silence), F.lit(False)))
    before = Window.partitionBy("rec").orderBy("anchor").rowsBetween(Window.unboundedPreceding, -1)
    spoken = groups.withColumn("part", F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)))
    out = spoken.groupBy("rec", "part").agg(F.min("start").alias("start_sample"), F.least(F.coalesce(F.max(F.when(F.col("ends"), F.col("t0"))), F.max("total")), F.max("total")).alias("end_sample"))
    length = F.col("end_sample") - F.col("start_sample")
    return out.where((length > 0) & (length >= samples(cfg.min_speech))).drop("part")


def pad_regions(regions: DataFrame, totals: DataFrame, pad: int) -> DataFrame:
    """Regions widened by pad samples; neighbours nearer than twice that share the silence. totals: rec, total."""
    w = Window.partitionBy("rec").orderBy("start_sample")
    known = regions.join(totals, "rec").withColumns({"before": F.lag("end_sample").over(w), "after": F.lead("start_sample").over(w)})

    def share(gap: Column) -> Column:
        return F.when(gap < 2 * pad, F.floor(gap / 2)).otherwise(F.lit(pad)).cast("long")

    start = F.greatest(F.lit(0), F.col("start_sample") - F.coalesce(share(F.col("start_sample") - F.col("before")), F.lit(pad)))
    end = F.least("total", F.col("end_sample") + F.coalesce(share(F.col("after") - F.col("end_sample")), F.lit(pad)))
    return known.select("rec", F.least(start, F.col("total")).cast("long").alias("start_sample"), end.cast("long").alias("end_sample")).where("end_sample > start_sample")


def longest_region(cfg: VadConfig) -> int | None:
    """Samples that a region may have before it is split: max_speech less a chunk and both paddings."""
    return None if cfg.max_speech == float("inf") else max(0, samples(cfg.max_speech) - CHUNK - 2 * samples(cfg.pad))


def bounded_regions(loud: np.ndarray, quiet: np.ndarray, prob: np.ndarray, chunks: int, cfg: VadConfig) -> list[tuple[int, int]]:
    """Regions in chunks, from the sorted chunks at or above the entry threshold and below the exit threshold.

    It goes from one decision to the next: a region, counted afresh from some chunk, either ends in a silence
    (quiet chunks without a loud one between them) that lasts min_silence, or first passes its longest duration.
    Then it is split at a silence that a loud chunk has ended by then: the longest of those that fall to
    split_threshold, else the longest or the last of all; without one it is cut, and the next loud chunk begins anew.
    """
    most, chunk_of = longest_region(cfg), lambda n: -(-n // CHUNK)
    group = np.searchsorted(loud, quiet, "right")
    found: list[tuple[int, int]] = []
    start = fresh = int(loud[0]) if len(loud) else None
    checked = -1  # the last chunk at which the duration was looked at
    while start is not None:
        over = chunks if most is None else max(start + most // CHUNK + 1, checked + 1)
        at = slice(*np.searchsorted(quiet, (fresh, min(over, chunks) + 1)))
        q, g, p = quiet[at], group[at], prob[at]
        heads = np.flatnonzero(np.diff(g, prepend=-1))
        first = np.repeat(q[heads], np.diff(np.append(heads, len(q))))
        done = np.flatnonzero((q - first >= chunk_of(samples(cfg.min_silence))) & (q < over))
        if len(done):
            found.append((start, int(first[done[0]])))
            start = fresh = _after(loud, int(q[done[0]]))
            continue
        if over >= chunks:
            found.append((start, chunks))
            break
        ended = [(int(q[h]), int(loud[g[h]]), float(low)) for h, low in zip(heads, np.minimum.reduceat(p, heads) if len(heads) else (), strict=True) if g[h] < len(loud) and loud[g[h]] <= over]
        splits = [x for x in ended if (x[1] - x[0]) * CHUNK > samples(cfg.split_silence)]
        deep = [x for x in splits if x[2] <= cfg.split_threshold]
        if deep or (splits and cfg.longest_silence):
            end, again, _ = max(deep or splits, key=lambda x: x[1] - x[0])
        else:
            end, again, _ = splits[-1] if splits else (over, over, 0.0)
        found.append((start, end))
        checked, fresh = over, over
        if again < over:
            start = again
        else:
            start = fresh = _after(loud, over)
    return found


def _after(loud: np.ndarray, chunk: int) -> int | None:
    i = int(np.searchsorted(loud, chunk, "right"))
    return int(loud[i]) if i < len(loud) else None


def split_regions(vad: DataFrame, cfg: VadConfig | None = None) -> DataFrame:
    """speech_regions with the longest duration of cfg.

    Only loud and quiet chunks go on. A silence of three times min_silence ends any region, whatever was split
    in it (a split in a silence makes it count afresh, and that happens twice at most), so a recording falls
    apart there into parts that are worked on independently.
    """
    cfg = cfg or VadConfig()
    w = Window.partitionBy("rec").orderBy("chunk")
    loud = F.col("prob") >= cfg.entry
    known = vad.select("rec", "chunk", "prob", loud.alias("loud"), (F.max("chunk").over(Window.partitionBy("rec")) + 1).alias("total"))
    known = known.where(F.col("loud") | (F.col("prob") < cfg.exit)).withColumn("anchor", F.sum(F.col("loud").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("anchor > 0")
    silence = Window.partitionBy("rec", "anchor")
    calm = F.when(~F.col("loud"), F.col("chunk"))
    span = F.coalesce(F.max(calm).over(silence) - F.min(calm).over(silence), F.lit(0))
    ends = F.col("loud") & (span >= 3 * (samples(cfg.min_silence) // CHUNK + 2))
    parts = known.withColumn("ends", ends.cast("int")).withColumn("part", F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # The quiet chunks after a part's last loud one count to that part.
    parts = parts.withColumn("part", F.col("part") - F.when(F.col("loud"), F.lit(0)).otherwise(F.max("ends").over(silence)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        total, on = int(pdf["total"].iloc[0]), pdf["loud"].to_numpy()
        at, prob = pdf["chunk"].to_numpy(), pdf["prob"].to_numpy()
        found = [(x * CHUNK, y * CHUNK) for x, y in bounded_regions(at[on], at[~on], prob[~on], total, cfg)]
        found = [(x, y) for x, y in found if y > x and y - x >= samples(cfg.min_speech)]
        return pd.DataFrame({"rec": [pdf["rec"].iloc[0]] * len(found), "start_sample": [x for x, _ in found], "end_sample": [y for _, y in found]})

    kind = dict(vad.dtypes)["rec"]
    return parts.select("rec", "part", "chunk", "prob", "loud", "total").groupBy("rec", "part").applyInPandas(run, f"rec {kind}, start_sample long, end_sample long")


def stream_events(vad: DataFrame, cfg: VadConfig | None = None, resolution: int | None = None, flush: bool = False, size: int = CHUNK) -> DataFrame:
    """rec, kind, sample, time of speech starts and ends as a live stream tells them, chunk by chunk.

    Silence is timed from the end of its first chunk. There are no rules for shortest and longest speech.
    A chunk has `size` samples, or n where vad has that column: only a recording's last chunk may be shorter. With
    flush, speech that is on when the recording ends, ends where its silence began (and pad later), or with it.
    """
    cfg = cfg or VadConfig()
    w = Window.partitionBy("rec").orderBy("chunk")
    n = (F.col("n") if "n" in vad.columns else F.lit(size)).cast("long")
    anchor = F.sum((F.col("prob") >= cfg.entry).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = vad.select("rec", "prob", n.alias("n"), (F.col("chunk") * size + n).alias("done"), anchor.alias("anchor"), F.max(F.col("chunk") * size + n).over(Window.partitionBy("rec")).alias("total")).where("anchor > 0")
    quiet = F.when(F.col("prob") < cfg.exit, F.struct("done", "n"))
    marked = marked.withColumn("t0", F.min(quiet).over(Window.partitionBy("rec", "anchor")))
    enough = (F.col("prob") < cfg.exit) & (F.col("done") - F.col("t0.done") >= samples(cfg.min_silence))
    groups = marked.groupBy("rec", "anchor").agg(F.min(F.struct("done", "n")).alias("first"), F.first("t0").alias("t0"), F.min(F.when(enough, F.struct("done", "n"))).alias("t1"), F.first("total").alias("total"))
    order = Window.partitionBy("rec").orderBy("anchor")
    ended = F.col("t1").isNotNull()
    groups = groups.withColumns({"starts": F.coalesce(F.lag(ended).over(order), F.lit(True)), "open": ~ended & F.lead("anchor").over(order).isNull() & F.lit(flush)})
    pad = samples(cfg.pad)
    at = lambda kind, sample: F.struct(F.lit(kind).alias("kind"), F.greatest(F.lit(0), sample).cast("long").alias("sample"))
    begin = F.when(F.col("starts"), at("speechStart", F.col("first.done") - F.col("first.n") - pad))
    rest = F.least("total", F.coalesce(F.col("t0.done") - F.col("t0.n") + pad, F.col("total")))
    end = F.when(ended, at("speechEnd", F.col("t0.done") + pad - F.col("t1.n"))).when(F.col("open"), at("speechEnd", rest))
    out = groups.select("rec", F.explode(F.filter(F.array(begin, end), lambda x: x.isNotNull())).alias("e")).select("rec", "e.kind", "e.sample")
    return out if resolution is None else out.withColumn("time", F.round(F.col("sample") / RATE, resolution))


def silent_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("silent", F.forall("samples", lambda x: F.abs(x) <= 1e-10))


def fix_chunk_length(chunks: DataFrame, n: int, context: int = 64) -> DataFrame:
    """samples of exactly n: cut, or filled with the last one (0 if empty); context: the last ones of the chunk before."""
    last = F.coalesce(F.get("samples", F.size("samples") - 1), F.lit(0.0).cast("float"))
    fixed = F.slice(F.concat("samples", F.array_repeat(last, n)), 1, n)
    w = Window.partitionBy("rec").orderBy("chunk")
    out = chunks.withColumn("samples", fixed)
    tail = F.slice("samples", F.greatest(F.lit(1), F.size("samples") - context + 1), context)
    return out.withColumn("context", F.lag(tail).over(w))


def extract_segments(chunks: DataFrame, segments: DataFrame, size: int) -> DataFrame:
    """rec, start_sample, end_sample and samples of each segment; chunks hold size samples each.

    Segments are dealt to the chunks they touch and joined on (rec, chunk).
    """
    spans = segments.where("end_sample > start_sample").select("rec", "start_sample", "end_sample", F.explode(F.sequence(F.floor(F.col("start_sample") / size), F.floor((F.col("end_sample") - 1) / size))).alias("chunk"))
    hit = spans.withColumnRenamed("start_sample", "s").join(chunks.select("rec", "chunk", F.col("start_sample").alias("c0"), "samples"), ["rec", "chunk"])
    first = F.greatest(F.col("s") - F.col("c0"), F.lit(0))
    part = F.slice("samples", (first + 1).cast("int"), F.greatest(F.lit(0), F.least(F.col("end_sample") - F.col("c0"), F.size("samples").cast("long")) - first).cast("int"))
    parts = hit.select("rec", "s", "end_sample", "chunk", part.alias("part")).groupBy("rec", "s", "end_sample").agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    return parts.select("rec", F.col("s").alias("start_sample"), "end_sample", F.flatten(F.transform("parts", lambda p: p["part"])).alias("samples"))


def track_activity(vad: DataFrame, lengths: DataFrame, rate: float, threshold: float = 0.85) -> DataFrame:
    """rec, frame, active: whether any active chunk touches the frame; lengths: rec, n_frames at rate frames a second."""
    per = CHUNK / RATE * rate
    on = vad.where(F.col("prob") >= threshold).select("rec", F.explode(F.sequence(F.floor(F.col("chunk") * per), F.ceil((F.col("chunk") + 1) * per) - 1)).alias("frame")).distinct().withColumn("on", F.lit(True))
    grid = lengths.where("n_frames > 0").select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("frame"))
    return grid.join(on, ["rec", "frame"], "left").select("rec", "frame", F.coalesce("on", F.lit(False)).alias("active"))


