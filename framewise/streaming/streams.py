"""Streaming operators: chunks, features, segments, voice events, caches and scorers, keyed by recording.

Every input has is_last, true on a recording's last row, which flushes what is pending.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framewise.operators.loop import TOLD, TOLD_REST, CachedScorer, LoopConfig, Memory, advance, contents
from framewise.operators.features import MelConfig, mel_filterbank
from framewise.operators.scoring import Scorer, preview_rows
from framewise.operators.segments import SegmentConfig
from framewise.operators.vad import CHUNK, RATE, VadConfig, samples

from .state import Rows, frame, in_sessions, processed, stateful

# --- chunks -----------------------------------------------------------------------------------------------


@dataclass
class Samples:
    """Samples from `base` on, of which the window that comes next begins at `next`."""

    base: int = 0
    next: int = 0
    data: np.ndarray = field(default_factory=lambda: np.zeros(0))
    emitted: int = 0

    def put(self, x: np.ndarray, end: int | None, capacity: int) -> None:
        """Appends x; with an end position, a gap is filled with zeros and an overlap taken back first."""
        at = self.base + len(self.data)
        start = at if end is None else end - len(x)
        if start > at:
            self.data = np.concatenate((self.data, np.zeros(start - at), x))
        else:
            keep = max(0, start - self.base)
            self.data = np.concatenate((self.data[:keep], x[max(0, self.base - start) :]))
        if len(self.data) > capacity:
            self.base += len(self.data) - capacity
            self.data = self.data[-capacity:]


def rechunk(stream: DataFrame, rate: float, duration: float, skip: float, startup: str = "wait", newest: bool = False, capacity: float = 60.0) -> DataFrame:
    """rec, chunk, start_time, samples: overlapping chunks of `duration` seconds every `skip` seconds.

    stream: rec, seq, samples, end_time (or null), is_last. startup: wait for a full chunk, silent (zeros
    before the start), or ramp_up (the first chunks grow by skip). newest: only the latest chunk of a batch.
    """
    size, hop = round(rate * duration), round(rate * skip)
    if not 0 < hop <= size:
        raise ValueError("0 < skip <= duration")
    if startup not in ("wait", "silent", "ramp_up"):
        raise ValueError("startup must be wait, silent or ramp_up")
    schema = "rec string, chunk long, start_time double, samples array<double>"

    def step(own: Samples, key: tuple, rows: Rows) -> list[tuple]:
        out = []
        for x, end in zip(rows["samples"], rows["end_time"], strict=True):
            own.put(np.asarray(x, float), None if pd.isna(end) else round(end * rate), max(size + hop, round(capacity * rate)))
            have = own.base + len(own.data)
            while True:
                n = own.emitted
                stop = size + n * hop if startup == "wait" else (n + 1) * hop
                if stop > have:
                    break
                start = stop - size
                lo = max(start, 0)
                part = own.data[max(0, lo - own.base) : stop - own.base]
                missing = (stop - lo) - len(part)
                part = np.concatenate((np.zeros(max(0, missing)), part))
                if start < 0 and startup == "silent":
                    part = np.concatenate((np.zeros(-start), part))
                elif start < 0:
                    start = 0
                out.append((key[0], n, start / rate, part.tolist()))
                own.emitted += 1
            keep = max(own.base, (size + own.emitted * hop if startup == "wait" else (own.emitted + 1) * hop) - size)
            own.data, own.base = own.data[keep - own.base :], keep
        return out[-1:] if newest else out

    return stateful(stream.withColumn("rec", F.col("rec").cast("string")), ["rec"], ["seq"], schema, Samples, step)


# --- features ---------------------------------------------------------------------------------------------


@dataclass
class FeatureState:
    last: float = 0.0
    base: int = 0
    seen: int = 0
    data: np.ndarray = field(default_factory=lambda: np.zeros(0))
    frames: int = 0
    total: np.ndarray | None = None
    first_row: int = 0  # of the rows kept
    rows: list[np.ndarray] = field(default_factory=list)
    emitted: int = 0


def stream_features(stream: DataFrame, cfg: MelConfig) -> DataFrame:
    """rec, frame, values as offline_features makes them, as soon as they are settled.

    stream: rec, chunk, samples, is_last. State is a tail of samples, sums for each band, and the rows that
    later ones need as context. nfft must not pass 4 hops, so that settled frames need no right padding.
    """
    if cfg.nfft > 4 * cfg.hop:
        raise ValueError("nfft must be at most 4 hops")
    schema = "rec string, frame long, values array<double>"
    window = np.zeros(cfg.nfft)
    lead = (cfg.nfft - cfg.win) // 2
    window[lead : lead + cfg.win] = 0.5 * (1 - np.cos(2 * np.pi * np.arange(cfg.win) / cfg.win))
    half, block, bank = cfg.nfft // 2, cfg.hop * cfg.subsampling, mel_filterbank(cfg.nfft, cfg.n_mels, cfg.rate)

    def step(own: FeatureState, key: tuple, rows: Rows) -> list[tuple]:
        out = []
        for x, end in zip(rows["samples"], rows["is_last"], strict=True):
            x = np.asarray(x, float)
            if len(x):
                y = x - cfg.emphasis * np.concatenate(([own.last], x[:-1])) if cfg.emphasis else x
                own.last = x[-1]
                own.data, own.seen = np.concatenate((own.data, y)), own.seen + len(x)
            usable = own.seen // block * block
            # A frame is taken once its samples are there and it can't be beyond the recording's end.
            count = max(0, min((own.seen - half) // cfg.hop + 1, usable // cfg.hop - 1))
            for t in range(own.frames, count):
                a = t * cfg.hop - half
                part = own.data[max(0, a - own.base) : a + cfg.nfft - own.base]
                part = np.concatenate((np.zeros(max(0, -a)), part))
                part = np.concatenate((part, np.zeros(cfg.nfft - len(part))))
                v = (np.abs(np.fft.rfft(part * window, cfg.nfft)) ** 2) @ bank.T
                v = (np.log(v + cfg.floor) if cfg.mode == "add" else np.log(np.maximum(v, cfg.floor))) / np.log(10)
                own.total = v if own.total is None else own.total + v
                own.rows.append(v - own.total / (t + 1))
            own.frames = max(own.frames, count)
            keep = max(own.base, own.frames * cfg.hop - half)
            own.data, own.base = own.data[keep - own.base :], keep
            while own.emitted * cfg.subsampling + cfg.context < own.frames or end and own.emitted * cfg.subsampling < own.frames:
                mid = own.emitted * cfg.subsampling
                zero = np.zeros(cfg.n_mels)
                row = [own.rows[f - own.first_row] if 0 <= f < own.frames else zero for f in range(mid - cfg.context, mid + cfg.context + 1)]
                out.append((key[0], own.emitted, np.concatenate(row).tolist()))
                own.emitted += 1
            drop = max(0, own.emitted * cfg.subsampling - cfg.context - own.first_row)
            own.rows, own.first_row = own.rows[drop:], own.first_row + min(drop, len(own.rows))
        return out

    return stateful(stream.withColumn("rec", F.col("rec").cast("string")), ["rec"], ["chunk"], schema, FeatureState, step)


@dataclass
class Ring:
    """Samples that later frames need, the last one for pre-emphasis, and the feature rows that later windows need."""

    last: float = 0.0
    base: int = 0
    seen: int = 0
    data: np.ndarray = field(default_factory=lambda: np.zeros(0))
    frames: int = 0
    first: int = 0  # frame of the first row kept
    rows: list[np.ndarray] = field(default_factory=list)
    windows: int = 0


def stream_windows(stream: DataFrame, cfg: MelConfig, core: int, left: int, right: int) -> DataFrame:
    """rec, window, values, left, right as context_chunks of log_mel makes them, once a window's right rows are there.

    stream: rec, chunk, samples, is_last. State is a tail of samples and a ring of at most left + core + right - 1
    feature rows and those of one batch.
    """
    schema = "rec string, window long, values array<array<double>>, left long, right long"
    weights = np.zeros(cfg.nfft)
    lead, half = (cfg.nfft - cfg.win) // 2, cfg.nfft // 2
    weights[lead : lead + cfg.win] = 0.5 * (1 - np.cos(2 * np.pi * np.arange(cfg.win) / cfg.win))
    bank = mel_filterbank(cfg.nfft, cfg.n_mels, cfg.rate)

    def settled(own: Ring, count: int) -> None:
        """Feature rows up to frame count, from samples that are there or lie outside the recording."""
        if count > own.frames:
            starts = np.arange(own.frames, count) * cfg.hop - half
            pad = max(0, own.base - int(starts[0]))
            x = np.concatenate((np.zeros(pad), own.data, np.zeros(cfg.nfft)))
            cut = x[(starts - own.base + pad)[:, None] + np.arange(cfg.nfft)]
            v = (np.abs(np.fft.rfft(cut * weights, cfg.nfft, axis=1)) ** 2) @ bank.T
            own.rows += list(np.log(v + cfg.floor) if cfg.mode == "add" else np.log(np.maximum(v, cfg.floor)))
            own.frames = count
        keep = max(own.base, own.frames * cfg.hop - half)
        own.data, own.base = own.data[keep - own.base :], keep

    def step(own: Ring, key: tuple, rows: Rows) -> list[tuple]:
        out = []
        for x, end in zip(rows["samples"], rows["is_last"], strict=True):
            x = np.asarray(x, float)
            if len(x):
                own.data = np.concatenate((own.data, x - cfg.emphasis * np.concatenate(([own.last], x[:-1]))))
                own.last, own.seen = float(x[-1]), own.seen + len(x)
            whole = own.seen // cfg.hop
            settled(own, whole if end else min(whole, max(0, (own.seen - half) // cfg.hop + 1)))
            while (own.windows + 1) * core + right <= own.frames:
                a, b = own.windows * core, (own.windows + 1) * core + right
                lo = max(0, a - left)
                out.append((key[0], own.windows, [r.tolist() for r in own.rows[lo - own.first : b - own.first]], a - lo, right))
                own.windows += 1
            gone = max(0, own.windows * core - left - own.first)
            own.rows, own.first = own.rows[gone:], own.first + min(gone, len(own.rows))
        return out

    return stateful(stream.withColumn("rec", F.col("rec").cast("string")), ["rec"], ["chunk"], schema, Ring, step)


# --- segments ---------------------------------------------------------------------------------------------


@dataclass
class Builder:
    on: bool = False
    start: int = 0
    seen: int = 0
    part: list | None = None  # start or None until a long island, end of the segment in progress


def _close(own: Builder, cfg: SegmentConfig, a: int, b: int, long: bool) -> tuple[int, int] | None:
    """Takes a padded island in; gives the segment that it ends, if any."""
    done = None
    if own.part is None or a - own.part[1] > cfg.min_off:
        done = own.part if own.part and own.part[0] is not None else None
        own.part = [a if long else None, b]
    else:
        own.part = [own.part[0] if own.part[0] is not None else a if long else None, max(own.part[1], b)]
    return done


def stream_segments(stream: DataFrame, cfg: SegmentConfig, tentative: bool = False, gap: int | None = None, empty: bool = False) -> DataFrame:
    """rec, track, start_frame, end_frame, finalized: segments as build_segments makes them.

    stream: rec, track, frame, prob, is_last. A segment is final once no later frame can reach it. Frames
    at or before the last one taken are dropped; each batch's number of them is the observed metric
    `late_frames` (frames) of its progress, which a batch that runs again tells again. With tentative rows the
    query must run in update mode; each batch then tells the current state of what is still open. With empty, a
    batch after which nothing of a track is open says so by a row without frames, as a sink that replaces rows needs it.

    With a gap in milliseconds the stream has ts with a watermark: a recording's session ends where ts stands
    still for longer, by the next row's time or by a timer, as if its last frame had been the last of all.
    """
    schema = "rec string, track int, start_frame long, end_frame long, finalized boolean, late long"

    def end(own: Builder, emit: Callable[..., None]) -> None:
        if own.on:
            a, b = max(0, own.start - cfg.pad_on), own.seen + cfg.pad_off
            emit(_close(own, cfg, a, b, b - a >= cfg.min_on))
        emit(own.part)
        own.on, own.part = False, None

    def emitter(key: tuple, out: list) -> Callable[..., None]:
        def emit(seg: list | tuple | None, final: bool = True) -> None:
            if seg is not None and seg[0] is not None:
                out.append((key[0], key[1], seg[0], seg[1], final, None))

        return emit

    def step(own: Builder, key: tuple, rows: Rows) -> list[tuple]:
        out: list[tuple] = []
        emit, late = emitter(key, out), 0
        for f, p, done in zip(rows["frame"].tolist(), rows["prob"].tolist(), rows["is_last"].tolist(), strict=True):
            if f < own.seen:
                late += 1
                continue
            own.seen = int(f) + 1
            if not own.on and p > cfg.on:
                own.on, own.start = True, int(f)
            elif own.on and p < cfg.off:
                own.on = False
                a, b = max(0, own.start - cfg.pad_on), int(f) + cfg.pad_off
                emit(_close(own, cfg, a, b, b - a > cfg.min_on))
            if done:
                end(own, emit)
        soonest = max(0, (own.start if own.on else own.seen) - cfg.pad_on)
        if own.part is not None and soonest - own.part[1] > cfg.min_off:
            emit(own.part)
            own.part = None
        if tentative:
            view = copy.copy(own)  # islands taken in make new parts, so the own one stays
            if view.on:
                a, b = max(0, view.start - cfg.pad_on), view.seen + cfg.pad_off
                emit(_close(view, cfg, a, b, b - a >= cfg.min_on), False)
            emit(view.part, False)
        if empty and all(r[4] for r in out):
            out.append((key[0], key[1], None, None, False, None))
        return [*out, *([(key[0], key[1], None, None, None, late)] if late else [])]

    def close(own: Builder, key: tuple) -> list[tuple]:
        out: list[tuple] = []
        end(own, emitter(key, out))
        return out

    own, mode = stream.withColumns({"rec": F.col("rec").cast("string"), "track": F.col("track").cast("int")}), "update" if tentative else "append"
    if gap is None:
        told = stateful(own, ["rec", "track"], ["frame"], schema, Builder, step, mode)
    else:
        told = in_sessions(own, ["rec", "track"], ["frame"], schema, gap, Builder, step, close, mode)
    return told.observe("late_frames", F.coalesce(F.sum("late"), F.lit(0)).alias("frames")).where("late is null").drop("late")


# --- voice events -----------------------------------------------------------------------------------------


@dataclass
class Voice:
    """Whether speech is on, and of the first quiet chunk since the last loud one its begin and end."""

    on: bool = False
    quiet: tuple[int, int] | None = None


def voice_events(own: Voice, ends: np.ndarray, sizes: np.ndarray, probs: np.ndarray, last: bool, total: int, cfg: VadConfig) -> list[tuple[str, int]]:
    """Events of successive chunks given by their ends, sizes and probabilities, in samples.

    A batch falls into stretches, each from a loud chunk to the next; only its quiet chunks matter. The first
    stretch may go on from the batch before. With the last chunk, speech that is still on ends where its
    silence began, or with the recording.
    """
    pad, least, out = samples(cfg.pad), samples(cfg.min_silence), []
    loud, calm = probs >= cfg.entry, np.flatnonzero(probs < cfg.exit)
    borders = [0, *np.flatnonzero(loud), len(probs)]
    for lo, hi in zip(borders, borders[1:], strict=False):
        if lo == hi:
            continue
        if loud[lo]:
            if not own.on:
                out.append(("speechStart", max(0, int(ends[lo] - sizes[lo]) - pad)))
            own.on, own.quiet = True, None
        still = calm[np.searchsorted(calm, lo) : np.searchsorted(calm, hi)]
        if own.on and len(still):
            begin, end = own.quiet = own.quiet or (int(ends[still[0]] - sizes[still[0]]), int(ends[still[0]]))
            enough = still[ends[still] - end >= least]
            if len(enough):
                out.append(("speechEnd", max(0, end + pad - int(sizes[enough[0]]))))
                own.on, own.quiet = False, None
    if last and own.on:
        out.append(("speechEnd", total if own.quiet is None else min(total, own.quiet[0] + pad)))
        own.on, own.quiet = False, None
    return out


VOICE = "rec string, kind string, sample long, time double"


def _timed(key: tuple, events: list[tuple[str, int]], resolution: int) -> list[tuple]:
    return [(key[0], k, s, round(s / RATE, resolution)) for k, s in events]


def stream_vad_events(stream: DataFrame, cfg: VadConfig | None = None, resolution: int = 1) -> DataFrame:
    """rec, kind, sample, time of speech starts and ends; stream: rec, chunk, prob.

    With a column is_last, speech that is still on ends with that chunk, as in stream_events with flush.
    """
    cfg = cfg or VadConfig()
    flush = "is_last" in stream.columns

    def step(own: Voice, key: tuple, rows: Rows) -> list[tuple]:
        ends = (rows["chunk"] + 1) * CHUNK
        last = flush and bool(rows["is_last"][-1])
        return _timed(key, voice_events(own, ends, np.full(len(ends), CHUNK), rows["prob"], last, int(ends[-1]), cfg), resolution)

    return stateful(stream.withColumn("rec", F.col("rec").cast("string")), ["rec"], ["chunk"], VOICE, Voice, step)


@dataclass
class Ear(Voice):
    """Beside the state of the events: samples that don't fill a chunk yet, those before them, the scorer's state."""

    pending: np.ndarray = field(default_factory=lambda: np.zeros(0))
    before: np.ndarray | None = None
    done: int = 0
    scorer: Any = None


def stream_voice(stream: DataFrame, scorer: Scorer, cfg: VadConfig | None = None, size: int = CHUNK, context: int = 64, resolution: int = 1) -> DataFrame:
    """rec, kind, sample, time of speech starts and ends in samples; stream: rec, seq, samples, is_last.

    Samples wait until they fill a chunk of `size`, which the scorer gets after the `context` samples before
    it. With the last row what is left becomes a chunk too, filled with its last sample, and speech that is on ends.
    """
    cfg = cfg or VadConfig()

    def step(own: Ear, key: tuple, rows: Rows) -> list[tuple]:
        last = bool(rows["is_last"][-1])
        own.pending = np.concatenate((own.pending, *[np.asarray(x, float) for x in rows["samples"]]))
        ends, sizes, probs = [], [], []
        while len(own.pending) >= size or last and len(own.pending):
            x, own.pending = own.pending[:size], own.pending[size:]
            full = np.concatenate((x, np.full(size - len(x), x[-1])))
            before = np.zeros(context) if own.before is None else own.before
            y, own.scorer = scorer(own.scorer, np.concatenate((before, full)), True, True)
            own.before, own.done = np.concatenate((before, full))[len(full) :] if context else before, own.done + len(x)
            ends.append(own.done)
            sizes.append(len(x))
            probs.append(float(np.ravel(y)[0]))
        return _timed(key, voice_events(own, np.array(ends, int), np.array(sizes, int), np.array(probs), last, own.done, cfg), resolution)

    return stateful(stream.withColumn("rec", F.col("rec").cast("string")), ["rec"], ["seq"], VOICE, Ear, step)


# --- caches and scorers -----------------------------------------------------------------------------------


class Remembering(StatefulProcessor):
    """The loop of scorer, cache and queue, kept as lists of frames and one value for what is not a frame."""

    def __init__(self, scorer: CachedScorer, cfg: LoopConfig) -> None:
        self.scorer, self.cfg = scorer, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cache = handle.getListState("cache", "embedding array<double>, probs array<double>")
        self.queue = handle.getListState("queue", "embedding array<double>, probs array<double>")
        self.rest = handle.getValueState("rest", "mean array<double>, quiet long, frames long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        own = Memory.of(self.cfg)
        if self.rest.exists():
            mean, own.quiet, own.frames = self.rest.get()
            own.mean = np.asarray(mean, float)
            own.hold(list(self.cache.get()), list(self.queue.get()))
        told, last = [], False
        for r in pd.concat(list(rows)).sort_values("window").itertuples():
            told += advance(own, self.cfg, self.scorer, key[0], r.window, r.values_, r.left, r.right)
            last = last or bool(r.is_last)
        if last:
            yield frame(TOLD, told + contents(own, key[0]))
            for state in (self.cache, self.queue, self.rest):
                state.clear()
            return
        for state, held in ((self.cache, own.held(own.cache, own.cache_probs)), (self.queue, own.held(own.queue, own.queue_probs))):
            state.put(held) if held else state.clear()
        self.rest.update((own.mean.tolist(), own.quiet, own.frames))
        yield frame(TOLD, told)

    def close(self) -> None: ...


def stream_speaker_cache(stream: DataFrame, scorer: CachedScorer, cfg: LoopConfig) -> DataFrame:
    """rec, window, part, place, probs, embedding as score_with_cache tells them.

    stream: rec, window, values (rows of features: left context, core, right context), left, right, is_last.
    """
    own = stream.withColumn("rec", F.col("rec").cast("string")).withColumnRenamed("values", "values_")
    return processed(own, ["rec"], f"rec string, {TOLD_REST}", Remembering(scorer, cfg))


@dataclass
class Scoring:
    state: Any = None
    seen: int = 0
    emitted: int = 0
    width: int = 0
    done: bool = False


def score_stream(stream: DataFrame, scorer: Scorer, delay: int = 0, preview: bool = False, gap: int | None = None) -> DataFrame:
    """rec, frame, values, finalized: committed rows once the delay is filled, and preview rows from a copy.

    stream: rec, frame, values, is_last. After the last row, further ones change nothing. With a gap in
    milliseconds the stream has ts with a watermark, and a session ends as in stream_segments: the rows that the
    delay holds back follow, and the next session begins with a new state and frame 0.
    """
    schema = "rec string, frame long, values array<double>, finalized boolean"

    def commit(own: Scoring, key: tuple, ys: list[np.ndarray], out: list) -> None:
        for y in ys:
            out.append((key[0], own.emitted, np.asarray(y, float).tolist(), True))
            own.emitted += 1

    def end(own: Scoring, key: tuple, out: list) -> None:
        if not own.done and own.seen:
            commit(own, key, preview_rows(own.state, scorer, delay, own.seen, own.width), out)
        own.done = True

    def step(own: Scoring, key: tuple, rows: Rows) -> list[tuple]:
        out: list[tuple] = []
        for v, last in zip(rows["values"], rows["is_last"], strict=True):
            if own.done:
                break
            x = np.asarray(v, float)
            own.width = len(x)
            y, own.state = scorer(own.state, x, True, own.seen >= delay)
            own.seen += 1
            if own.seen > delay:
                commit(own, key, [y], out)
            if last:
                end(own, key, out)
        if preview and not own.done and own.seen:
            for i, y in enumerate(preview_rows(own.state, scorer, delay, own.seen, own.width)):
                out.append((key[0], own.emitted + i, np.asarray(y, float).tolist(), False))
        return out

    def close(own: Scoring, key: tuple) -> list[tuple]:
        out: list[tuple] = []
        end(own, key, out)
        return out

    own, mode = stream.withColumn("rec", F.col("rec").cast("string")), "update" if preview else "append"
    if gap is None:
        return stateful(own, ["rec"], ["frame"], schema, Scoring, step, mode)
    return in_sessions(own, ["rec"], ["frame"], schema, gap, Scoring, step, close, mode)


# --- refreshes --------------------------------------------------------------------------------------------


@dataclass
class Waiting:
    samples: list = field(default_factory=list)
    count: int = 0
    number: int = 0


def stream_refresh(stream: DataFrame, every: int) -> DataFrame:
    """rec, chunk, refresh, samples: chunks at which a refresh is due, with all samples since the last one.

    stream: rec, chunk, samples. What runs downstream thus runs only when at least `every` samples (1 at least) have
    come; the state holds those that wait.
    """
    schema = "rec string, chunk long, refresh long, samples array<double>"

    def step(own: Waiting, key: tuple, rows: Rows) -> list[tuple]:
        out = []
        for chunk, x in zip(rows["chunk"], rows["samples"], strict=True):
            own.samples.append(np.asarray(x, float))
            own.count += len(x)
            if own.count >= max(1, every):
                own.number += 1
                out.append((key[0], chunk, own.number, np.concatenate(own.samples).tolist()))
                own.samples, own.count = [], 0
        return out

    return stateful(stream.withColumn("rec", F.col("rec").cast("string")), ["rec"], ["chunk"], schema, Waiting, step)


# --- event time -------------------------------------------------------------------------------------------


def sliding_chunks(events: DataFrame, duration: str, skip: str, delay: str = "10 minutes") -> DataFrame:
    """Events of overlapping windows: rec, window, events, total. Works on streams and on tables."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy("rec", F.window("ts", duration, skip)).agg(F.count("*").alias("events"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions of events less than gap apart: rec, session, events. Works on streams and on tables."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy("rec", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("events"))


def to_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> Any:
    """Runs a stream over what is there now and hands each batch to a function, with the batch's number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_frames(query: StreamingQuery) -> int:
    """Frames that came late in a query's recent batches; a batch that ran twice counts as it ran last."""
    told = {p["batchId"]: p["observedMetrics"]["late_frames"]["frames"] for p in query.recentProgress if "late_frames" in p["observedMetrics"]}
    return sum(told.values())


class Progress(StreamingQueryListener):
    """Tells a function of each batch of every query of the session: name, batch, rows, seconds. For addListener.

    late holds the frames that came late, by query name and batch; a batch that runs again replaces its number.
    """

    def __init__(self, tell: Callable[[str | None, int, int, float], None] = lambda *_: None) -> None:
        self.tell = tell
        self.late: dict[tuple[str | None, int], int] = {}

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        if "late_frames" in p.observedMetrics:
            self.late[p.name, p.batchId] = p.observedMetrics["late_frames"]["frames"]
        self.tell(p.name, p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0) / 1000)

    def onQueryStarted(self, event: Any) -> None: ...

    def onQueryIdle(self, event: Any) -> None: ...

    def onQueryTerminated(self, event: Any) -> None: ...
