"""Samples and spectral features. chunks: rec, chunk, start_sample, samples, of equal length but for the last."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folds import fold


def peak_normalize(chunks: DataFrame) -> DataFrame:
    """Samples over their recording's largest magnitude, where that isn't 0."""
    peak = F.array_max(F.transform("samples", lambda x: F.abs(x)))
    peaks = chunks.groupBy("rec").agg(F.max(peak).alias("peak"))
    return chunks.join(peaks, "rec").withColumn("samples", F.when(F.col("peak") > 0, F.transform("samples", lambda x: x / F.col("peak"))).otherwise(F.transform("samples", lambda x: x.cast("double")))).drop("peak")


def to_pcm16(chunks: DataFrame) -> DataFrame:
    """Samples clipped to -1..1, times 32767, towards zero."""
    one = F.lit(1.0)
    return chunks.withColumn("samples", F.transform("samples", lambda x: (F.greatest(-one, F.least(one, x.cast("double"))) * 32767).cast("int")))


def downmix(chunks: DataFrame, channels: int) -> DataFrame:
    """chunks of interleaved channels to chunks of their mean, each by itself; a chunk holds whole moments."""
    n = F.size("samples")
    mean = lambda i: F.aggregate(F.slice("samples", i * channels + 1, channels), F.lit(0.0), lambda s, x: s + x) / channels
    moments = F.when(n % channels != 0, F.raise_error(F.lit(f"a chunk's samples must be a multiple of {channels}"))).when(n > 0, F.transform(F.sequence(F.lit(0), F.floor(n / channels).cast("int") - 1), mean))
    return chunks.withColumns({"samples": F.coalesce(moments, F.array().cast("array<double>")), "start_sample": F.floor(F.col("start_sample") / channels)})


def to_samples(chunks: DataFrame) -> DataFrame:
    """rec, sample, x of small inputs."""
    return chunks.select("rec", "start_sample", F.posexplode("samples").alias("pos", "x")).select("rec", (F.col("start_sample") + F.col("pos")).alias("sample"), F.col("x").cast("double").alias("x"))


def resample_linear(chunks: DataFrame, rate_in: float, rate_out: float) -> DataFrame:
    """chunks at another rate: linear between floor neighbours, the last sample held.

    A chunk makes the outputs whose floor lies in it, and needs of others only the first sample of the next one: the
    window over a recording holds those, never the chunks. start_sample must be distinct within a recording among
    chunks with samples. Chunks without samples, or that make none, give no row.
    """
    if rate_in == rate_out:
        return chunks
    ratio = rate_in / rate_out
    first, end = F.col("start_sample"), F.col("start_sample") + F.size("samples")
    w = Window.partitionBy("rec").orderBy("start_sample")
    filled = chunks.where(F.size("samples") > 0)
    edges = filled.select("rec", "start_sample", F.get("samples", F.lit(0)).alias("_first"), end.alias("_end"))
    edges = edges.select("rec", "start_sample", F.lead("_first").over(w).alias("_next"), F.max("_end").over(Window.partitionBy("rec")).alias("_n"))
    full = filled.join(edges, ["rec", "start_sample"]).withColumn("_after", F.coalesce("_next", F.element_at("samples", -1)).cast("double"))
    # One more output is tried on either side, since a quotient may be rounded; floors decide.
    tried = F.sequence(F.greatest(F.lit(0), F.floor(first / ratio) - 1), F.ceil(end / ratio) + 1)
    spot = lambda i: F.floor(i * ratio)
    own = F.filter(tried, lambda i: (spot(i) >= first) & (spot(i) < end) & (i < (F.col("_n") / ratio).cast("long")))
    at = lambda i: (spot(i) - first).cast("int")
    here = lambda i: F.get("samples", at(i)).cast("double")
    following = lambda i: F.coalesce(F.get("samples", at(i) + 1).cast("double"), F.col("_after"))
    out = full.withColumn("_own", own).where(F.size("_own") > 0)
    made = F.transform("_own", lambda i: here(i) + (following(i) - here(i)) * (i * ratio - spot(i)))
    return out.withColumn("samples", made).withColumn("start_sample", F.col("_own")[0]).select(*chunks.columns)


#: Samples of a row of zeros at most, where nothing was written.
GAP = 65_536


@dataclass
class Sweep:
    """Where a sweep over writes stands, the writes open there (newest first), and the stretch told last but not yet given."""

    at: int = 0
    open: list[tuple[int, int]] = field(default_factory=list)  # (-seq, end)
    held: list = field(default_factory=list)  # seq or None, begin, end

    def tell(self, seq: int | None, end: int, out: list[tuple]) -> None:
        """The stretch up to end belongs to seq."""
        if self.held and self.held[0] == seq and self.held[2] == self.at:
            self.held[2] = end
        else:
            out += [tuple(self.held)] if self.held else []
            self.held = [seq, self.at, end]
        self.at = end

    def go(self, to: int | None, out: list[tuple]) -> None:
        """Goes on to a place, or to the end of all that is open."""
        while to is None or self.at < to:
            while self.open and self.open[0][1] <= self.at:
                heapq.heappop(self.open)
            if not self.open:
                if to is not None:
                    self.tell(None, to, out)
                return
            newest, end = self.open[0]
            self.tell(-newest, end if to is None else min(end, to), out)


def newest_stretches(writes: DataFrame) -> DataFrame:
    """rec, seq, begin, end: which write (rec, seq, start_sample, samples) each stretch of samples comes from, null for gaps.

    A sweep over the writes' ends, in the order of their beginnings; it sees no samples and holds only open writes.
    """
    kinds = dict(writes.dtypes)
    spans = writes.select("rec", F.col("seq").cast("long").alias("seq"), F.greatest(F.lit(0), "start_sample").cast("long").alias("begin"), (F.col("start_sample") + F.size("samples")).cast("long").alias("end")).where("end > begin")

    def rows(rec: Any, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(rec, *r) for r in out], columns=["rec", "seq", "begin", "end"]).astype({"seq": "Int64"})

    def take(own: Sweep, batch: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for seq, begin, end in zip(batch["seq"], batch["begin"], batch["end"], strict=True):
            own.go(begin, out)
            heapq.heappush(own.open, (-seq, end))
        return rows(batch["rec"].iloc[0], out)

    def close(own: Sweep, rec: Any) -> pd.DataFrame:
        out: list[tuple] = []
        own.go(None, out)
        return rows(rec, [*out, *([tuple(own.held)] if own.held else [])])

    return fold(spans, "begin", f"rec {kinds['rec']}, seq long, begin long, end long", Sweep, take, close)


def resync(writes: DataFrame) -> DataFrame:
    """rec, start_sample, samples of writes (rec, seq, start_sample, samples) at known places: the newest wins, gaps are 0.

    A row is a stretch of one write, cut from it by a slice, or of a gap, so the number of rows follows the writes.
    seq is distinct within a recording; samples before 0 are forgotten.
    """
    found = newest_stretches(writes)
    kept = found.where("seq is not null").join(writes.select("rec", F.col("seq").cast("long").alias("seq"), F.col("start_sample").alias("_start"), "samples"), ["rec", "seq"])
    part = F.slice("samples", (F.col("begin") - F.col("_start") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    kept = kept.select("rec", F.col("begin").alias("start_sample"), F.transform(part, lambda x: x.cast("double")).alias("samples"))
    gaps = found.where("seq is null").select("rec", "end", F.explode(F.sequence(F.col("begin"), F.col("end") - 1, F.lit(GAP).cast("long"))).alias("start_sample"))
    return kept.union(gaps.select("rec", "start_sample", F.array_repeat(F.lit(0.0), F.least(F.lit(GAP), F.col("end") - F.col("start_sample")).cast("int")).alias("samples")))


def preemphasis(chunks: DataFrame, a: float = 0.97, last: float = 0.0) -> DataFrame:
    """x[n] - a x[n-1] within and across chunks; `last` comes before the first sample."""
    w = Window.partitionBy("rec").orderBy("chunk")
    before = F.coalesce(F.lag(F.element_at("samples", -1)).over(w).cast("double"), F.lit(last))
    shifted = F.concat(F.array("_before"), F.transform(F.slice("samples", 1, F.size("samples") - 1), lambda x: x.cast("double")))
    return chunks.withColumn("_before", before).withColumn("samples", F.zip_with("samples", shifted, lambda x, y: x.cast("double") - a * y)).drop("_before")


def analysis_frames(chunks: DataFrame, nfft: int, win: int, hop: int, mode: str = "center", size: int = 64) -> DataFrame:
    """rec, frame, samples: nfft samples of each analysis frame, 0 outside the recording.

    center: n // hop frames, each nfft/2 around frame * hop. pre_padded: as many as fit into the recording.
    plain: windows of win samples from frame * hop. All but the last chunk of a recording have `size` samples.
    A frame is cut in the chunk where it starts, to which later chunks send only the samples that its frames
    can reach; a recording's chunks spread over tasks.
    """
    sizes = chunks.groupBy("rec").agg(F.max(F.col("start_sample") + F.size("samples")).alias("n"))
    n = F.col("n")
    if mode == "center":
        count, shift, length = F.floor(n / hop), -(nfft // 2), nfft
    elif mode == "pre_padded":
        count, shift, length = F.floor((n - nfft) / hop) + 1, 0, nfft
    elif mode == "plain":
        count, shift, length = F.floor((n - win) / hop) + 1, 0, win
    else:
        raise ValueError("mode must be center, pre_padded or plain")
    c, home = F.col("chunk"), F.col("_home")
    sent = chunks.select("rec", "chunk", "samples", F.explode(F.sequence(F.greatest(F.lit(0), c - math.ceil((length - 1) / size)), c)).alias("_home"))
    reach = F.when(c == home, F.size("samples")).otherwise(F.least(F.size("samples"), ((home + 1 - c) * size + length - 1).cast("int")))
    parts = sent.select("rec", "_home", "chunk", F.slice("samples", F.lit(1), F.greatest(F.lit(0), reach)).alias("part"))
    held = parts.groupBy("rec", "_home").agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    body = F.transform(F.flatten(F.transform("parts", lambda p: p["part"])), lambda x: x.cast("double"))
    lo = F.when(home == 0, F.lit(0)).otherwise(F.ceil((home * size - shift) / hop))
    hi = F.least(F.col("frames"), F.ceil(((home + 1) * size - shift) / hop)) - 1
    joined = held.join(sizes.select("rec", count.alias("frames")), "rec").select("rec", "_home", body.alias("body"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where("hi >= lo")

    def cut(f: Column) -> Column:
        s = f * hop + shift
        left = F.greatest(F.lit(0), F.least(-s, F.lit(length))).cast("int")
        inside = F.slice("body", (F.greatest(s, F.lit(0)) - home * size + 1).cast("int"), length - left)
        padded = F.concat(F.array_repeat(F.lit(0.0), left), inside, F.array_repeat(F.lit(0.0), F.lit(length)))
        return F.struct(f.alias("frame"), F.slice(padded, 1, length).alias("samples"))

    return joined.select("rec", F.explode(F.transform(F.sequence("lo", "hi"), cut)).alias("f")).select("rec", "f.frame", "f.samples")


def hann_table(spark: SparkSession, n: int, periodic: bool = True) -> DataFrame:
    """i, weight of a Hann window."""
    return spark.range(n).select(F.col("id").cast("int").alias("i"), (0.5 * (1 - F.cos(2 * math.pi * F.col("id") / (n if periodic else n - 1)))).alias("weight"))


def _mel(hz: Column) -> Column:
    """Slaney's scale: linear to 1000 Hz (mel 15), logarithmic above, 27 steps to a factor of 6.4."""
    return F.when(hz < 1000, hz * 3 / 200).otherwise(15 + F.log(F.greatest(hz, F.lit(1.0)) / 1000) * 27 / math.log(6.4))


def _hz(mel: Column) -> Column:
    return F.when(mel < 15, mel * 200 / 3).otherwise(1000 * F.exp((mel - 15) * math.log(6.4) / 27))


def mel_filterbank_table(spark: SparkSession, nfft: int, n_mels: int, rate: float) -> DataFrame:
    """mel, bin, weight above 0: triangles on Slaney's scale, each of area 1."""
    top = _mel(F.lit(rate / 2))
    edge = lambda k: _hz((F.col("mel") + k) * top / (n_mels + 1))
    mels = spark.range(n_mels).select(F.col("id").cast("int").alias("mel")).select("mel", edge(0).alias("l"), edge(1).alias("c"), edge(2).alias("r"))
    bins = spark.range(nfft // 2 + 1).select(F.col("id").cast("int").alias("bin"), (F.col("id") * rate / nfft).alias("f"))
    w = F.greatest(F.lit(0.0), F.least((F.col("f") - F.col("l")) / (F.col("c") - F.col("l")), (F.col("r") - F.col("f")) / (F.col("r") - F.col("c")))) * 2 / (F.col("r") - F.col("l"))
    # Both sides are constants of the transform, a few hundred rows at any size of the data.
    return mels.crossJoin(F.broadcast(bins)).select("mel", "bin", w.alias("weight")).where("weight > 0")


def mel_filterbank(nfft: int, n_mels: int, rate: float) -> np.ndarray:
    """The same as a matrix (n_mels, nfft // 2 + 1)."""
    step = math.log(6.4) / 27
    to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) / step
    mels = np.arange(n_mels + 2) * to_mel(rate / 2) / (n_mels + 1)
    hz = np.where(mels < 15, mels * 200 / 3, 1000 * np.exp((mels - 15) * step))
    f = np.arange(nfft // 2 + 1) * rate / nfft
    left, mid, right = hz[:-2, None], hz[1:-1, None], hz[2:, None]
    return np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid))) * 2 / (right - left)


def power_spectrum(frames: DataFrame, nfft: int, window: np.ndarray | None = None) -> DataFrame:
    """rec, frame, power of bins 0..nfft/2, from frames (rec, frame, samples), in Arrow batches."""
    kind = dict(frames.dtypes)["rec"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["samples"].to_list()) if len(pdf) else np.zeros((0, nfft))
            p = np.abs(np.fft.rfft(x * window if window is not None else x, nfft, axis=1)) ** 2
            yield pd.DataFrame({"rec": pdf["rec"], "frame": pdf["frame"], "power": list(p)})

    return frames.select("rec", "frame", "samples").mapInPandas(run, f"rec {kind}, frame long, power array<double>")


#: Most weights of a filter bank: as many as a matrix of 128 bands over 4,096 bins has.
BANK = 1 << 19


def mel_project(power: DataFrame, bank: DataFrame) -> DataFrame:
    """rec, frame, mel, value: each band's weighted power, a product in Arrow batches. bank: mel, bin, weight, a constant of the transform."""
    weights = bank.select("mel", "bin", "weight").limit(BANK + 1).toPandas()
    if len(weights) > BANK:
        raise ValueError(f"a filter bank has at most {BANK} weights")
    matrix = np.zeros((int(weights["mel"].max()) + 1, int(weights["bin"].max()) + 1))
    matrix[weights["mel"], weights["bin"]] = weights["weight"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["power"].to_list())[:, : matrix.shape[1]] if len(pdf) else np.zeros((0, matrix.shape[1]))
            yield pdf[["rec", "frame"]].assign(values=list(x @ matrix[:, : x.shape[1]].T))

    bands = power.select("rec", "frame", "power").mapInPandas(run, f"rec {dict(power.dtypes)['rec']}, frame long, values array<double>")
    return bands.select("rec", "frame", F.posexplode("values").alias("mel", "value"))


def log_floor(x: Column, floor: float = 2.0**-24, mode: str = "add") -> Column:
    """ln(x + floor), or ln(max(x, floor)) with mode clamp."""
    return F.log(x + floor) if mode == "add" else F.log(F.greatest(x, F.lit(floor)))


@dataclass(frozen=True)
class MelConfig:
    """Transform of samples to log mel bands, and of those to model input rows."""

    rate: float = 16_000
    nfft: int = 32
    win: int = 32
    hop: int = 16
    n_mels: int = 8
    emphasis: float = 0.97
    floor: float = 2.0**-24
    mode: str = "add"
    context: int = 2
    subsampling: int = 2
    chunk: int = 64


def log_mel(chunks: DataFrame, cfg: MelConfig, frames_mode: str = "center") -> DataFrame:
    """rec, frame, values: log mel bands of each analysis frame."""
    window = np.zeros(cfg.nfft)
    lead = (cfg.nfft - cfg.win) // 2
    window[lead : lead + cfg.win] = 0.5 * (1 - np.cos(2 * np.pi * np.arange(cfg.win) / cfg.win))
    cut = analysis_frames(preemphasis(chunks, cfg.emphasis) if cfg.emphasis else chunks, cfg.nfft, cfg.win, cfg.hop, frames_mode, cfg.chunk)
    bank = mel_filterbank(cfg.nfft, cfg.n_mels, cfg.rate)
    kind = dict(chunks.dtypes)["rec"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["samples"].to_list()) if len(pdf) else np.zeros((0, cfg.nfft))
            v = (np.abs(np.fft.rfft(x * window, cfg.nfft, axis=1)) ** 2) @ bank.T
            v = np.log(v + cfg.floor) if cfg.mode == "add" else np.log(np.maximum(v, cfg.floor))
            yield pd.DataFrame({"rec": pdf["rec"], "frame": pdf["frame"], "values": list(v)})

    return cut.mapInPandas(run, f"rec {kind}, frame long, values array<double>")


def cumulative_mean_norm(features: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """rec, frame, dim, value: log10 of natural logs, less the running mean of frames so far.

    carry (rec, dim, total, count): sums of what came before.
    """
    x = F.col("value") / math.log(10)
    w = Window.partitionBy("rec", "dim").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    if carry is None:
        return features.select("rec", "frame", "dim", (x - F.sum(x).over(w) / F.count("*").over(w)).alias("value"))
    known = features.join(carry, ["rec", "dim"], "left").fillna(0, ["total", "count"])
    return known.select("rec", "frame", "dim", (x - (F.sum(x).over(w) + F.col("total")) / (F.count("*").over(w) + F.col("count"))).alias("value"))


def splice_subsample(rows: DataFrame, context: int, step: int, dims: int) -> DataFrame:
    """rec, frame, values: every step-th frame with context frames on both sides, zeros outside."""
    w = Window.partitionBy("rec").orderBy("frame")
    around = F.collect_list("values").over(w.rowsBetween(-context, context))
    n = F.max("frame").over(Window.partitionBy("rec")) + 1
    pad = lambda k: F.array_repeat(F.lit(0.0), (F.greatest(F.lit(0), k) * dims).cast("int"))
    out = rows.select("rec", "frame", around.alias("a"), n.alias("n")).where(F.col("frame") % step == 0)
    return out.select("rec", (F.col("frame") / step).cast("long").alias("frame"), F.concat(pad(context - F.col("frame")), F.flatten("a"), pad(F.col("frame") + context + 1 - F.col("n"))).alias("values"))


@dataclass
class Spliced:
    """Sums of all frames so far, the normalised frames that later rows reach, and the number of rows given."""

    total: np.ndarray | float = 0.0
    frames: int = 0
    first: int = 0  # of the frames kept
    rows: list[np.ndarray] = field(default_factory=list)
    emitted: int = 0


def offline_features(chunks: DataFrame, cfg: MelConfig) -> DataFrame:
    """Model input rows of whole recordings: log mel, running mean, splicing.

    Samples beyond a multiple of hop x subsampling and the last analysis frame are left out. The running mean and
    the splicing are one fold over a recording's frames, which holds a sum for each band and the frames in reach.
    """
    block = cfg.hop * cfg.subsampling
    usable = chunks.groupBy("rec").agg((F.floor(F.max(F.col("start_sample") + F.size("samples")) / block) * block).alias("usable"))
    trimmed = chunks.join(usable, "rec").withColumn("samples", F.slice("samples", 1, F.greatest(F.lit(0), F.least(F.size("samples").cast("long"), F.col("usable") - F.col("start_sample"))).cast("int"))).where(F.size("samples") > 0)
    mel = log_mel(trimmed.drop("usable"), cfg).join(usable, "rec").where(F.col("frame") < F.col("usable") / cfg.hop - 1).drop("usable")

    def give(own: Spliced, rec: Any, upto: int) -> pd.DataFrame:
        zero, out, first = np.zeros(cfg.n_mels), [], own.emitted
        while (mid := own.emitted * cfg.subsampling) < upto:
            around = range(mid - cfg.context, mid + cfg.context + 1)
            out.append(np.concatenate([own.rows[f - own.first] if 0 <= f < own.frames else zero for f in around]))
            own.emitted += 1
        gone = max(0, own.emitted * cfg.subsampling - cfg.context - own.first)
        own.rows, own.first = own.rows[gone:], own.first + min(gone, len(own.rows))
        return pd.DataFrame({"rec": [rec] * len(out), "frame": np.arange(first, own.emitted), "values": out})

    def take(own: Spliced, batch: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(batch["values"].to_list()) / math.log(10)
        sums = np.cumsum(x, axis=0) + own.total
        own.total = sums[-1]
        own.rows += list(x - sums / np.arange(own.frames + 1, own.frames + len(x) + 1)[:, None])
        own.frames += len(x)
        return give(own, batch["rec"].iloc[0], own.frames - cfg.context)

    return fold(mel, "frame", f"rec {dict(chunks.dtypes)['rec']}, frame long, values array<double>", Spliced, take, lambda own, rec: give(own, rec, own.frames))


def context_chunks(rows: DataFrame, core: int, left: int, right: int) -> DataFrame:
    """rec, window, values, left, right: core rows with their context; the right context must be whole."""
    sizes = rows.groupBy("rec").agg((F.max("frame") + 1).alias("n"))
    windows = F.floor((F.col("n") - right) / core)
    lo = F.greatest(F.lit(0), F.floor((F.col("frame") - core - right) / core) + 1)
    hi = F.least(windows - 1, F.floor((F.col("frame") + left) / core))
    dealt = rows.join(sizes, "rec").where(hi >= lo).select("rec", "frame", "values", F.explode(F.sequence(lo, hi)).alias("window"))
    g = dealt.groupBy("rec", "window").agg(F.sort_array(F.collect_list(F.struct("frame", "values"))).alias("c"), F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    return g.select("rec", "window", F.transform("c", lambda c: c["values"]).alias("values"), (F.col("window") * core - F.col("f0")).alias("left"), (F.col("f1") + 1 - (F.col("window") + 1) * core).alias("right"))
