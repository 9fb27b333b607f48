"""File sources and sinks: interval files, PCM audio, matrices, model metadata, session summaries."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Model metadata: optional fields may be null.
METADATA = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in "input_dim full_output_dim real_output_dim encoder_layers decoder_layers encoder_dim num_heads key_dim head_dim encoder_conv_cache_len top_buffer_len conv_delay max_nspks target_sample_rate".split()]
    + [T.StructField("frame_hz", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in "sample_rate win_length hop_length n_fft n_mels context_recp subsampling".split()]
    + [T.StructField(c, T.StringType()) for c in ("compute_precision", "feat_type")]
)


def parse_rttm(lines: DataFrame, *keep: str) -> DataFrame:
    """value to rec, start, duration, speaker; lines of fewer than eight fields go, unparsable numbers are 0."""
    f = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    number = lambda i: F.coalesce(F.get("f", i).try_cast("double"), F.lit(0.0))
    return lines.select(*keep, f.alias("f")).where(F.size("f") >= 8).select(*keep, F.get("f", 1).alias("rec"), number(3).alias("start"), number(4).alias("duration"), F.get("f", 7).alias("speaker"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, rec, start, duration, speaker of interval files."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\R")).alias("line_no", "value"))
    return parse_rttm(whole, "file", "line_no")


def to_rttm_lines(runs: DataFrame, labels: DataFrame, rate: float) -> DataFrame:
    """rec, place, value: a line for each run (rec, track, start_frame, end_frame), by track and start.

    labels: rec, track, label; tracks without one are spk and their number.
    """
    named = runs.join(labels, ["rec", "track"], "left").withColumn("label", F.coalesce("label", F.concat(F.lit("spk"), F.col("track").cast("string"))))
    text = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("rec").cast("string"), F.col("start_frame") / rate, (F.col("end_frame") - F.col("start_frame")) / rate, F.col("label"))
    w = Window.partitionBy("rec").orderBy("track", "start_frame")
    return named.select("rec", F.row_number().over(w).alias("place"), text.alias("value"))


def write_rttm(lines: DataFrame, path: str) -> None:
    """One folder for each recording, its lines in order."""
    lines.repartition("rec").sortWithinPartitions("rec", "place").select("rec", "value").write.partitionBy("rec").text(path)


def read_pcm_chunks(spark: SparkSession, path: str, seconds: float = 1.0) -> DataFrame:
    """rec, chunk, start_sample, rate, samples of 16-bit PCM WAV files, mixed to mono."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(content)) as f:
                    if f.getsampwidth() != 2:
                        raise ValueError(f"{path}: 16-bit PCM only")
                    rate, channels, size = f.getframerate(), f.getnchannels(), max(4096, int(f.getframerate() * seconds))
                    rec, chunk = path.rsplit("/", 1)[-1].removesuffix(".wav"), 0
                    while raw := f.readframes(size):
                        x = np.frombuffer(raw, "<i2").reshape(-1, channels).mean(axis=1) / 32768
                        yield pd.DataFrame({"rec": [rec], "chunk": [chunk], "start_sample": [chunk * size], "rate": [rate], "samples": [x.astype(np.float32)]})
                        chunk += 1

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "rec string, chunk long, start_sample long, rate int, samples array<float>")


def read_npy_matrices(spark: SparkSession, path: str) -> DataFrame:
    """rec, frame, track, value of 2-D little-endian float32 arrays in C order; others are errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != 2 or a.dtype.str != "<f4" or not a.flags.c_contiguous:
                    raise ValueError(f"{path}: 2-D <f4 in C order only")
                rows, columns = a.shape
                for lo in range(0, rows, 65_536):
                    part = a[lo : lo + 65_536]
                    yield pd.DataFrame({"rec": path.rsplit("/", 1)[-1].removesuffix(".npy"), "frame": np.repeat(np.arange(lo, lo + len(part)), columns), "track": np.tile(np.arange(columns, dtype=np.int32), len(part)), "value": part.ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "rec string, frame long, track int, value float")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).option("multiLine", True).json(path)


def session_summary(frames: DataFrame, segments: DataFrame, rate: float, threshold: float, median: int) -> DataFrame:
    """One row for each recording: durations, settings and tracks in order of first speech."""
    size = frames.groupBy("rec").agg((F.max("frame") + 1).alias("frames"))
    firsts = segments.groupBy("rec", "track").agg(F.min("start_frame").alias("first"))
    order = firsts.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("first", "track"))).alias("o"), F.count("*").alias("speakers"))
    out = size.join(order, "rec", "left")
    return out.select("rec", (F.col("frames") / rate).alias("seconds"), F.lit(rate).alias("frame_hz"), F.lit(threshold).alias("threshold"), F.lit(median).alias("median_width"), F.coalesce("speakers", F.lit(0).cast("long")).alias("speakers"), F.coalesce(F.array_join(F.transform("o", lambda x: x["track"].cast("string")), ","), F.lit("")).alias("display_order"))


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.json(path)


def pow2_at_least(x: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.round(F.log2(x), 9))).cast("long")


def resolve_config(meta: DataFrame) -> DataFrame:
    """Missing fields of model metadata by formula, with latency in seconds and the stable block in samples.

    The transform's size follows the window, whatever n_fft says.
    """
    c = F.col
    m = meta.withColumns({"rate": F.coalesce("sample_rate", "target_sample_rate").cast("long"), "win": F.coalesce("win_length", F.lit(200)).cast("long"), "hop": F.coalesce("hop_length", F.lit(80)).cast("long")})
    m = m.withColumn("fft", pow2_at_least(c("win").cast("double")))
    # Bands and context follow each other through the input's width.
    m = m.withColumn("mels", F.coalesce(c("n_mels").cast("long"), F.floor(c("input_dim") / (2 * F.coalesce("context_recp", F.lit(0)) + 1))))
    m = m.withColumn("context", F.coalesce(c("context_recp").cast("long"), F.floor((F.floor(c("input_dim") / c("mels")) - 1) / 2)))
    m = m.withColumn("sub", F.coalesce(c("subsampling").cast("long"), F.greatest(F.lit(1), F.round(c("rate") / F.round(c("frame_hz") * c("hop"), 0), 0).cast("long"))))
    m = m.withColumn("latency", (c("fft") / 2 + c("context") * c("hop") + c("conv_delay") * c("sub") * c("hop")) / c("rate"))
    return m.withColumn("stable_block", c("hop") * c("sub"))


def resolve_stream_config(configs: DataFrame) -> DataFrame:
    """configs (chunk, fifo, cache, silence, tracks, period) within their bounds."""
    c = F.col
    chunk = F.greatest(F.lit(1), c("chunk"))
    return configs.withColumn("chunk", chunk).withColumn("cache", F.greatest(c("cache"), (1 + c("silence")) * c("tracks"))).withColumn("period", F.greatest(c("chunk"), F.least(c("period"), c("fifo") + c("chunk"))))


#: Named stream configurations (chunk, left and right context, queue, cache and update period in frames), for both model versions.
PRESETS = {
    "default": (6, 1, 7, 40, 188, 31),
    "high_latency": (340, 1, 40, 40, 188, 300),
    "low_latency": (6, 1, 7, 188, 188, 144),
}
#: Feature frames of an output frame, samples of a feature frame, samples a second, tracks and silent frames of each in the cache.
SUBSAMPLING, STRIDE, STREAM_RATE, TRACKS, SILENT = 8, 160, 16_000, 4, 3


def stream_presets(spark: SparkSession) -> DataFrame:
    """config, chunk, left, right, fifo, cache, period, silence, tracks, and latency in seconds, of the named configurations."""
    rows = [(name, *[int(v) for v in values], SILENT, TRACKS) for name, values in PRESETS.items()]
    table = spark.createDataFrame(rows, "config string, chunk long, left long, right long, fifo long, cache long, period long, silence long, tracks long")
    return resolve_stream_config(table).withColumn("latency", (F.col("chunk") + F.col("right")) * SUBSAMPLING * STRIDE / STREAM_RATE)


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """config, other: pairs of configurations (config, chunk, left, right, fifo, cache) whose models are interchangeable.

    They see as many feature frames at a time and hold as many in queue and cache.
    """
    seen = ((F.col("chunk") + F.col("left") + F.col("right")) * SUBSAMPLING).alias("mel_frames")
    own = a.select("config", seen, "fifo", "cache")
    return own.join(b.select(F.col("config").alias("other"), seen, "fifo", "cache"), ["mel_frames", "fifo", "cache"]).select("config", "other", "mel_frames")
