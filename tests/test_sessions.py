"""Sessions and their timers, the loop of scorer and cache, sinks and sources: against plain loops and batch forms."""

import random

import numpy as np
import pandas as pd
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from framewise.operators import cache, features, folds, loop, scoring, vad
from framewise.operators.features import MelConfig
from framewise.operators.segments import SegmentConfig
from framewise.plans import catalog_streams as cs
from framewise.plans.catalog_features import smoother
from framewise.sources.growing import GrowingPcm
from framewise.streaming import sink, streams

from test_streaming import streamed

CFG = SegmentConfig(0.5, 0.5, 0, 0, 0, 1)
HOUR = 3600


def timed_rows(times, probs):
    return [("a", 0, i, p, t, False) for i, (t, p) in enumerate(zip(times, probs, strict=True))]


def run_batches(spark, batches, op, path, kind="rec string, track int, frame long, prob double, t long, is_last boolean"):
    """op over batches of rows, each a run of its own, and a clock row in the last one."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("t")).drop("t")
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
        q = op(spark.readStream.schema(df.schema).parquet(f"{path}/in").withWatermark("ts", "1 second")).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        yield sorted((r.rec, r.start_frame, r.end_frame) for r in spark.read.parquet(f"{path}/out").collect())


def test_session_ends_by_timer(spark, tmp_path):
    """What is open is given once the watermark passes the gap; gaps within and between batches end sessions alike."""
    t0 = 1_700_000_000
    times = [t0 + i for i in range(4)] + [t0 + HOUR + i for i in range(4)] + [t0 + 2 * HOUR + i for i in range(2)]
    rows = timed_rows(times, [0.1, 0.9, 0.9, 0.9, 0.9, 0.9, 0.1, 0.9, 0.9, 0.9])
    clock = [("z", 0, 0, 0.0, t0 + 9 * HOUR, False)]
    want = [("a", 1, 4), ("a", 4, 8), ("a", 8, 10)]  # one frame of silence is filled within a session, none joins two
    op = lambda x: streams.stream_segments(x, CFG, gap=600_000)
    seen = list(run_batches(spark, [rows[:3], rows[3:6], rows[6:], clock], op, tmp_path / "three"))
    assert seen[-1] == want and seen[-2] == want[:2] and seen[0] == []
    assert list(run_batches(spark, [rows, clock], op, tmp_path / "one")) == [want[:2], want]


def test_session_scores_equal_batches(spark, tmp_path):
    """A session's scores are those of the batch form on the session alone, whatever its length against the delay."""
    rng, rows, t = random.Random(1), [], 1_700_000_000
    for size in (1, 2, 5, 9):
        for _ in range(size):
            rows.append((len(rows), [rng.random(), rng.random()], t))
            t += 1
        t += HOUR
    df = spark.createDataFrame([("a", f, v, x, False) for f, v, x in rows], "rec string, frame long, values array<double>, t long, is_last boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = cs.run_sessions(df.drop("t", "is_last"), lambda x: streams.score_stream(x, smoother, 2, gap=600_000), "frame").collect()
    want, at = [], 0
    for size in (1, 2, 5, 9):
        part = df.where(F.col("frame").between(at, at + size - 1))
        want += [(r.frame, r.track, round(r.logit, 9)) for r in scoring.score_sequences(part, smoother, 2).collect()]
        at += size
    assert sorted((r.frame, k, round(v, 9)) for r in got for k, v in enumerate(r["values"])) == sorted((f % 100, k, v) for f, k, v in want)


def test_preview_rows(spark, tmp_path):
    """With a delay, each batch commits what is filled and previews the rest as if the recording ended there."""
    rng = np.random.default_rng(8)
    rows = [("a", f, rng.normal(size=2).tolist(), f == 11) for f in range(12)]
    df = spark.createDataFrame(rows, "rec string, frame long, values array<double>, is_last boolean")
    got = streamed(spark, df, "frame", lambda x: streams.score_stream(x, smoother, 3, True), tmp_path, 3, "update")
    whole = lambda n: {(r.frame, r.track): r.logit for r in scoring.score_sequences(df.where(F.col("frame") < n), smoother, 3).collect()}
    final = {(r.frame, k): v for r in got if r.finalized for k, v in enumerate(r["values"])}
    want = whole(12)
    assert final.keys() == want.keys() and all(abs(final[k] - want[k]) < 1e-12 for k in want)
    # After the first batches of four frames one and five are committed; the next three are previews.
    previews = [{(r.frame, k): v for r in got if not r.finalized and lo <= r.frame < lo + 3 for k, v in enumerate(r["values"])} for lo in (1, 5)]
    for n, seen in zip((4, 8), previews, strict=True):
        part = whole(n)
        assert len(seen) == 6 and all(abs(v - part[k]) < 1e-12 for k, v in seen.items())


# --- the loop -------------------------------------------------------------------------------------------------


def plain_loop(rows, scorer, cfg):
    """Cache and queue as plain lists: told frames, and the cache after each compression."""
    kept, kept_p, queue, mean, quiet, out, packed, frame = [], None, [], np.zeros(cfg.dims), 0, [], [], 0
    for x, left, right in rows:
        p, e = scorer(x, np.array([*kept]).reshape(-1, cfg.dims), np.array([q for q, _ in queue]).reshape(-1, cfg.dims))
        a, b = len(kept), len(kept) + len(queue)
        now = p[:a]
        queue = [(q, p[a + i]) for i, (q, _) in enumerate(queue)]
        for i in range(left, len(x) - right):
            queue.append((e[i], p[b + i]))
            out.append(("confirmed", frame, p[b + i]))
            frame += 1
        out += [("tentative", frame + k, p[b + i]) for k, i in enumerate(range(len(x) - right, len(x)))]
        if len(queue) > cfg.queue:
            n = min(max(cfg.period, len(queue) - cfg.queue), len(queue))
            gone, queue = queue[:n], queue[n:]
            for q, y in gone:
                if sum(y) < cfg.silence:
                    mean, quiet = (mean * quiet + q) / (quiet + 1), quiet + 1
            before = list(now) if kept_p is None else kept_p
            kept, probs = kept + [q for q, _ in gone], before + [y for _, y in gone]
            if kept_p is not None:
                kept_p = probs
            if len(kept) > cfg.cache.capacity:
                slots = cache.compress(np.array(probs), cfg.cache)
                kept, kept_p = [mean if i is None else kept[i] for i in slots], [np.zeros(cfg.cache.tracks) if i is None else probs[i] for i in slots]
                packed.append((np.array(kept), np.array(kept_p)))
    return out, packed, np.array(kept), [q for q, _ in queue]


def loop_windows(spark, frames=60, recs=3):
    rng = np.random.default_rng(7)
    rows = [(f"r{k}", f, (rng.normal(size=16) / 4).tolist()) for k in range(recs) for f in range(frames - 7 * k)]
    return features.context_chunks(spark.createDataFrame(rows, "rec string, frame long, values array<double>"), 4, 1, 2)


def test_loop(spark, tmp_path):
    """Batch form, stream over several batches and a plain loop agree row by row; the left context changes the result."""
    windows = loop_windows(spark)
    batch = loop.score_with_cache(windows, cs.voices, cs.LOOP).collect()
    stream = streamed(spark, cs.last(windows, "window", "rec"), "window", lambda x: streams.stream_speaker_cache(x, cs.voices, cs.LOOP), tmp_path, 4)
    text = lambda rows: sorted((r.rec, -1 if r.window is None else r.window, r.part, r.place, np.round(r.probs or [], 9).tolist(), np.round(r.embedding or [], 9).tolist()) for r in rows)
    assert text(batch) == text(stream)
    packs = 0
    for rec in ("r0", "r1", "r2"):
        own = sorted((r for r in windows.collect() if r.rec == rec), key=lambda r: r.window)
        out, packed, kept, queue = plain_loop([(np.array(r["values"]), r.left, r.right) for r in own], cs.voices, cs.LOOP)
        mine = [r for r in batch if r.rec == rec]
        told = {(r.window, r.part, r.place): r.probs for r in mine if r.part in ("confirmed", "tentative")}
        assert len(told) == len(out) and len([o for o in out if o[0] == "confirmed"]) == max(o[1] for o in out if o[0] == "confirmed") + 1
        assert np.allclose([p for _, p in sorted(((k[0], k[1], k[2]), p) for k, p in told.items())], [o[2] for o in out])
        at = sorted({r.window for r in mine if r.part == "cache" and r.window is not None})
        assert len(at) == len(packed)
        for w, (e, p) in zip(at, packed, strict=True):
            slots = sorted((r for r in mine if r.part == "cache" and r.window == w), key=lambda r: r.place)
            assert np.allclose([r.embedding for r in slots], e) and np.allclose([r.probs for r in slots], p)
        last = sorted((r for r in mine if r.window is None), key=lambda r: (r.part, r.place))
        assert np.allclose([r.embedding for r in last if r.part == "cache"], kept) and np.allclose([r.embedding for r in last if r.part == "queue"], queue)
        packs += len(packed)
    assert packs > 5
    # A left context of two rows in place of one: the same frames, other probabilities.
    wider = features.context_chunks(windows.select("rec", F.posexplode("values").alias("p", "values"), (F.col("window") * 4 - F.col("left") + F.col("p")).alias("frame")).dropDuplicates(["rec", "frame"]), 4, 2, 2)
    a = {(r.rec, r.place): r.probs for r in batch if r.part == "confirmed"}
    b = {(r.rec, r.place): r.probs for r in loop.score_with_cache(wider, cs.voices, cs.LOOP).collect() if r.part == "confirmed"}
    assert a.keys() == b.keys() and a != b


# --- folds in bounded memory ----------------------------------------------------------------------------------


def test_fold_holds_one_batch():
    """Output of a batch comes before the next one is asked for, and a recording's state goes over batches."""
    asked = []

    def batches():
        for i in range(12):
            asked.append(i)
            yield pd.DataFrame({"rec": ["a"] * 10 if i < 10 else ["b"] * 10, "x": range(i * 10, i * 10 + 10)})

    def take(own, rows):
        own.append(int(rows["x"].sum()))
        return pd.DataFrame({"rec": rows["rec"].iloc[:1], "n": len(asked)})

    got = list(folds.folded(batches(), list, take, lambda own, rec: pd.DataFrame({"rec": [rec], "n": [len(own)]})))
    assert [int(g["n"].iloc[0]) for g in got] == [*range(1, 11), 10, 11, 12, 2]


def test_long_recording_in_small_batches(spark):
    """A recording of many Arrow batches scores as in one, and no task sees more than a batch of it."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("a" if f % 3 else None, f, rng.normal(size=3).tolist()) for f in range(400)], "rec string, frame long, values array<double>").cache()
    whole = sorted(map(str, scoring.score_sequences(df, smoother, 3).collect()))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        small = scoring.score_sequences(df, smoother, 3)
        assert sorted(map(str, small.collect())) == whole and len(whole) == 1200
        assert "MapInPandas" in small._jdf.queryExecution().toString() and "FlatMapGroups" not in small._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_resync(spark):
    """Random overlapping, nested and distant writes: samples as written one after the other, in rows by stretch."""
    rng, rows, want = random.Random(4), [], {}
    for rec in range(8):
        line = {}
        for seq in range(rng.randint(1, 30)):
            start, n = rng.randint(-20, 300), rng.choice((0, 1, 5, 40, 120))
            x = [float(rng.randint(1, 9)) for _ in range(n)]
            rows.append((rec, seq, start, x))
            line |= {start + i: v for i, v in enumerate(x) if start + i >= 0}
        if line:
            want[rec] = [line.get(i, 0.0) for i in range(max(line) + 1)]
    df = spark.createDataFrame(rows, "rec int, seq long, start_sample long, samples array<double>")
    out = features.resync(df).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.rec, r.start_sample)):
        assert len(got.get(r.rec, [])) == r.start_sample
        got.setdefault(r.rec, []).extend(r.samples)
    assert got == want and len(out) < 3 * len(rows)
    # A gap of a hundred million samples is a few thousand rows, made of no samples.
    far = features.newest_stretches(spark.createDataFrame([(1, 0, 0, [1.0]), (1, 1, 100_000_000, [2.0])], "rec int, seq long, start_sample long, samples array<double>"))
    assert sorted((r.begin, r.end, r.seq) for r in far.collect() if r.seq is not None) == [(0, 1, 0), (100_000_000, 100_000_001, 1)] and far.count() == 3


# --- voice ----------------------------------------------------------------------------------------------------


def plain_voice(probs, sizes, cfg):
    """Chunk by chunk: what a listener would say."""
    out, on, hush, at = [], False, None, 0
    for p, n in zip(probs, sizes, strict=True):
        at += n
        if p >= cfg.entry:
            hush = None
            if not on:
                on = True
                out.append(("speechStart", max(0, at - n - vad.samples(cfg.pad))))
        elif on and p < cfg.exit:
            hush = hush or (at - n, at)
            if at - hush[1] >= vad.samples(cfg.min_silence):
                out.append(("speechEnd", max(0, hush[1] + vad.samples(cfg.pad) - n)))
                on, hush = False, None
    return out + ([("speechEnd", at if hush is None else min(at, hush[0] + vad.samples(cfg.pad)))] if on else [])


@pytest.mark.parametrize("seed", range(40))
def test_voice_events(seed):
    """Any split into batches gives the events of the plain loop, the last chunk being shorter."""
    rng = random.Random(seed)
    cfg = vad.VadConfig(threshold=0.6, offset=0.3, min_silence=rng.choice((0.0, 0.004, 0.02)), pad=rng.choice((0.0, 0.002)), min_speech=0.01)
    sizes = [48] * rng.randint(1, 40) + [rng.randint(1, 48)]
    probs = [rng.choice((0.1, 0.2, 0.45, 0.7, 0.9)) for _ in sizes]
    own, got, at = streams.Voice(), [], 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        to = min(len(sizes), at + rng.randint(1, 12))
        got += streams.voice_events(own, ends[at:to], np.array(sizes[at:to]), np.array(probs[at:to]), to == len(sizes), int(ends[-1]), cfg)
        at = to
    assert got == plain_voice(probs, sizes, cfg)


def test_batch_events_with_flush(spark):
    rng, rows, want = random.Random(9), [], {}
    cfg = vad.VadConfig(threshold=0.6, offset=0.3, min_silence=0.004, pad=0.002, min_speech=0.01)
    for rec in range(40):
        sizes = [48] * rng.randint(0, 25) + [rng.randint(1, 48)]
        probs = [rng.choice((0.1, 0.2, 0.45, 0.7, 0.9)) for _ in sizes]
        rows += [(rec, i, p, n) for i, (p, n) in enumerate(zip(probs, sizes, strict=True))]
        want[rec] = plain_voice(probs, sizes, cfg)
    got = {}
    for r in vad.stream_events(spark.createDataFrame(rows, "rec int, chunk long, prob double, n long"), cfg, flush=True, size=48).collect():
        got.setdefault(r.rec, []).append((r.kind, r.sample))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


# --- chunks, windows, refreshes -------------------------------------------------------------------------------


def rechunked(spark, rows, path, **how):
    df = spark.createDataFrame(rows, "rec string, seq long, samples array<double>, end_time double, is_last boolean")
    return sorted((r.chunk, r.start_time, r.samples) for r in streamed(spark, df, "seq", lambda x: streams.rechunk(x, 1.0, 4.0, 2.0, **how), path, 3))


def test_rechunk_modes(spark, tmp_path):
    """Chunks of four samples every two: how the first ones begin, the newest of a batch alone, and end times."""
    rows = [("a", i, [float(2 * i), float(2 * i + 1)], None, i == 5) for i in range(6)]
    x = [float(i) for i in range(12)]
    assert rechunked(spark, rows, tmp_path / "w") == [(n, 2.0 * n, x[2 * n : 2 * n + 4]) for n in range(5)]
    silent = [(n, 2.0 * n - 2, [0.0, 0.0, *x][2 * n : 2 * n + 4]) for n in range(6)]
    assert rechunked(spark, rows, tmp_path / "s", startup="silent") == silent
    assert rechunked(spark, rows, tmp_path / "r", startup="ramp_up") == [(0, 0.0, x[:2]), *silent[1:]]
    # Three batches of four samples: the chunk that ends with each.
    assert rechunked(spark, rows, tmp_path / "n", newest=True) == [(0, 0.0, x[:4]), (2, 4.0, x[4:8]), (4, 8.0, x[8:])]
    # The third write ends at 8 in place of 6 (two zeros before it), the fourth at 9: its first sample takes the place of
    # the last one, in chunks that have not been given yet.
    late = [(r, s, v, {2: 8.0, 3: 9.0}.get(s), e) for r, s, v, _, e in rows[:5]]
    want = [[0.0, 1.0, 2.0, 3.0], [2.0, 3.0, 0.0, 0.0], [0.0, 0.0, 4.0, 5.0], [4.0, 6.0, 7.0, 8.0]]
    assert rechunked(spark, late, tmp_path / "e") == [(n, 2.0 * n, v) for n, v in enumerate(want)]


def test_windows_equal_batch(spark, tmp_path):
    """Recordings of any length, also shorter than a frame, with windows of every context."""
    rng, cfg = np.random.default_rng(3), MelConfig()
    rows = [(f"r{k}", c, 64 * c, rng.normal(size=64 if c + 1 < n else 1 + 9 * k % 64).tolist(), c + 1 == n) for k, n in enumerate((1, 2, 3, 6, 9)) for c in range(n)]
    df = spark.createDataFrame(rows, "rec string, chunk long, start_sample long, samples array<double>, is_last boolean")
    for n, (core, left, right) in enumerate(((4, 1, 2), (1, 0, 0), (3, 5, 1))):
        got = {(r.rec, r.window): r for r in streamed(spark, df.drop("start_sample"), "chunk", lambda x: streams.stream_windows(x, cfg, core, left, right), tmp_path / str(n))}  # noqa: B023
        want = {(r.rec, r.window): r for r in features.context_chunks(features.log_mel(df.drop("is_last"), cfg), core, left, right).collect()}
        assert got.keys() == want.keys() and len(want) > 5
        assert all((got[k].left, got[k].right) == (want[k].left, want[k].right) and np.allclose(got[k]["values"], want[k]["values"], atol=1e-7) for k in want)


def test_refresh_on_a_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"r{k}", c, [float(c)] * rng.choice((0, 10, 64, 250))) for k in range(4) for c in range(30)]
    df = spark.createDataFrame(rows, "rec string, chunk long, samples array<double>")
    got = streamed(spark, df, "chunk", lambda x: streams.stream_refresh(x, 100), tmp_path)
    assert sorted((r.rec, r.chunk, r.refresh) for r in got) == sorted(map(tuple, scoring.refresh(df, 100).collect()))
    for rec in {r.rec for r in got}:
        given = [v for r in sorted((r for r in got if r.rec == rec), key=lambda r: r.refresh) for v in r.samples]
        assert given == [v for _, _, x in sorted(r for r in rows if r[0] == rec) for v in x][: len(given)]


# --- sinks and sources ----------------------------------------------------------------------------------------


def test_exactly_once(spark, tmp_path):
    """A batch that runs again changes nothing, one that broke off is written anew; tentative rows replace each other."""
    kind, write = "rec string, start_frame long, finalized boolean", sink.exactly_once(str(tmp_path))
    rows = lambda *r: spark.createDataFrame([*r], kind)
    assert sink.written(spark, str(tmp_path), kind).count() == 0
    write(rows(("a", 0, True), ("a", 5, False), ("b", 1, False)), 0)
    write(rows(("a", 99, True)), 0)
    rows(("a", 77, True)).write.parquet(f"{tmp_path}/rows/batch=1")  # broke off before the ledger
    assert sink.written(spark, str(tmp_path), kind).count() == 3
    write(rows(("a", 6, False), ("b", None, False)), 1)
    write(rows(("a", 6, False), ("b", None, False)), 1)
    now = sink.current(sink.written(spark, str(tmp_path), kind), "rec", present="start_frame")
    assert sorted(map(tuple, now.collect())) == [("a", 0, True), ("a", 6, False)]


def test_late_frames_of_a_batch_that_runs_again():
    """The count of a batch is replaced, not added to."""
    class Event:
        def __init__(self, batch, frames):
            self.progress = type("P", (), {"name": "q", "batchId": batch, "numInputRows": 1, "durationMs": {}, "observedMetrics": {"late_frames": {"frames": frames}}})

    p = streams.Progress()
    for batch, frames in ((0, 2), (1, 3), (1, 3)):
        p.onQueryProgress(Event(batch, frames))
    assert sum(p.late.values()) == 5


def test_growing_recordings(spark, tmp_path):
    """Runs over files that grow give, from the checkpoint on, the rows of one read of them at the end."""
    where, rng = fs.LocalFileSystem(), np.random.default_rng(6)
    spark.dataSource.register(GrowingPcm)
    path = f"{tmp_path}/in"
    where.create_dir(path)
    load = lambda read: read.format("growing_pcm").option("path", path).option("chunk", 50).option("piece", 2).load()
    sizes = [("a", 120, False), ("b", 3, False)], [("a", 7, False), ("c", 100, True)], [("a", 300, True), ("b", 0, True)]
    for step in sizes:
        for rec, n, closed in step:
            with where.open_append_stream(f"{path}/{rec}.pcm") as f:
                f.write(rng.integers(-32768, 32767, n).astype("<i2").tobytes())
            if closed:
                where.open_output_stream(f"{path}/{rec}.done").close()
        load(spark.readStream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.rec, r.chunk, r.start_sample, r.samples, r.is_last) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((r.rec, r.chunk, r.start_sample, r.samples, r.is_last) for r in load(spark.read).collect())
    assert [(r[0], len(r[3])) for r in got if r[4]] == [("a", 27), ("b", 3), ("c", 0)] and sum(len(r[3]) for r in got) == 530


def test_short_recordings_are_closed(spark, tmp_path):
    """A recording that has all its chunks in the first part ends with the second one as any other; short files share a task."""
    spark.dataSource.register(GrowingPcm)
    df = spark.createDataFrame([(r, k, [0.5] * 4) for r in range(6) for k in range(r + 1)], "rec long, chunk long, samples array<float>")
    early = F.col("chunk") < 3
    for part, closed in ((early, False), (~early, True)):
        cs.append_pcm(df, part, f"file://{tmp_path}/in", closed)
    read = spark.read.format("growing_pcm").option("path", f"file://{tmp_path}/in").option("chunk", 4).option("piece", 9).load()
    rows = read.collect()
    assert sorted(int(r.rec) for r in rows if r.is_last) == list(range(6)) and sum(len(r.samples) for r in rows) == 4 * 21
    assert read.rdd.getNumPartitions() == 3
