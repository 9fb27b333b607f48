"""Streams over many small files give what the batch forms give."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from framewise.operators import features, scoring, segments, vad
from framewise.operators.features import MelConfig
from framewise.operators.segments import SegmentConfig
from framewise.plans import catalog
from framewise.plans.catalog_streams import last
from framewise.sources import fixtures as fx
from framewise.streaming import state, streams


def streamed(spark, df, order, op, path, parts=3, mode="append"):
    """op over df, read in `parts` batches by the order column."""
    size = df.agg(F.max(order)).first()[0] // parts + 1
    for i in range(parts):
        df.where(F.floor(F.col(order) / size) == i).coalesce(1).write.mode("append").parquet(f"{path}/in/b={i}")
    out = []
    source = op(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/b=*"))
    q = source.writeStream.outputMode(mode).foreachBatch(lambda x, n: out.extend(x.collect())).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_segments(spark, sf, tmp_path):
    cfg = SegmentConfig(0.5, 0.3, 1, 1, 3, 2)
    df = last(fx.activity(spark, sf), "frame", "rec", "track")
    got = streamed(spark, df, "frame", lambda x: streams.stream_segments(x, cfg), tmp_path)
    want = segments.build_segments(fx.activity(spark, sf), cfg).collect()
    assert sorted((x.rec, x.track, x.start_frame, x.end_frame) for x in got) == sorted((str(x.rec), x.track, x.start_frame, x.end_frame) for x in want)


def test_features(spark, sf, tmp_path):
    cfg = MelConfig()
    df = last(fx.chunks(spark, sf).select("rec", "chunk", "samples"), "chunk", "rec")
    got = {(x.rec, x.frame): x["values"] for x in streamed(spark, df, "chunk", lambda x: streams.stream_features(x, cfg), tmp_path)}
    want = {(str(x.rec), x.frame): x["values"] for x in features.offline_features(fx.chunks(spark, sf), cfg).collect()}
    assert got.keys() == want.keys()
    assert max(np.abs(np.array(got[k]) - np.array(want[k])).max() for k in got) < 1e-6


def test_voice_events(spark, sf, tmp_path):
    cfg = vad.VadConfig(offset=0.35, min_silence=0.5, pad=0.4)
    got = streamed(spark, fx.voice(spark, sf), "chunk", lambda x: streams.stream_vad_events(x, cfg, 3), tmp_path)
    want = vad.stream_events(fx.voice(spark, sf), cfg, 3).collect()
    assert sorted((x.rec, x.kind, x.sample) for x in got) == sorted((str(x.rec), x.kind, x.sample) for x in want)


def test_samples_resync():
    s = streams.Samples()
    s.put(np.arange(4.0), None, 100)
    s.put(np.array([9.0]), 7, 100)
    assert s.data.tolist() == [0, 1, 2, 3, 0, 0, 9]
    s.put(np.array([5.0, 5.0]), 6, 100)
    assert s.data.tolist() == [0, 1, 2, 3, 5, 5]
    s.put(np.ones(3), None, 4)
    assert s.base == 5 and s.data.tolist() == [5, 1, 1, 1]


def test_cache_matches_batch(spark, sf):
    from framewise.operators import cache

    cfg = cache.CacheConfig()
    probs = fx.activity(spark, sf).where("track < 4")
    got = {}
    for x in cache.compress_cache(probs, cfg).orderBy("rec", "slot").collect():
        got.setdefault(x.rec, []).append(x.frame)
    rows = probs.collect()
    for rec in list(got)[:6]:
        own = [r for r in rows if r.rec == rec]
        m = np.zeros((max(r.frame for r in own) + 1, 4))
        for r in own:
            m[r.frame, r.track] = r.prob
        assert cache.compress(m, cfg) == got[rec]


def test_tentative_and_late(spark, tmp_path):
    """Two batches: what is open is told as tentative, frames that come late are counted, the rest ends as in one batch."""
    cfg = SegmentConfig(0.5, 0.5, 0, 0, 0, 0)
    first = [("a", 0, f, p, False) for f, p in enumerate((0.9, 0.9, 0.1, 0.1, 0.8, 0.8))]
    second = [("a", 0, 2, 0.9, False), ("a", 0, 5, 0.1, False), ("a", 0, 6, 0.9, False), ("a", 0, 7, 0.1, True)]
    kind = "rec string, track int, frame long, prob double, is_last boolean"
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    batches, told = {}, []
    listener = streams.Progress(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    source = streams.stream_segments(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b=*"), cfg, True)
    write = lambda x, n: batches.setdefault(n, []).extend((r.start_frame, r.end_frame, r.finalized) for r in x.collect())
    q = source.writeStream.queryName("segments").outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    time.sleep(2)  # progress comes after the batch
    spark.streams.removeListener(listener)
    assert sorted(batches[0]) == [(0, 2, True), (4, 6, False)]
    assert sorted(batches[1]) == [(4, 7, True)]
    assert sum(listener.late.values()) == 2
    assert {(name, batch, rows) for name, batch, rows, _ in told if rows} == {("segments", 0, 6), ("segments", 1, 4)} and all(x[3] >= 0 for x in told)


def test_to_sink(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = []
    streams.to_sink(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda x, n: seen.append((n, x.count())), f"{tmp_path}/state").awaitTermination()
    assert sum(n for _, n in seen) == 5


def test_refresh(spark):
    """A refresh counts from the one before, not on a grid: sizes by a plain loop."""
    rng, rows, want = random.Random(2), [], set()
    for rec in range(6):
        waiting, number = 0, 0
        for chunk in range(40):
            n = rng.choice((0, 10, 64, 64, 250))
            rows.append((rec, chunk, [0.0] * n))
            waiting += n
            if waiting >= 100:
                waiting, number = 0, number + 1
                want.add((rec, chunk, number))
    df = spark.createDataFrame(rows, "rec int, chunk long, samples array<float>")
    assert {tuple(r) for r in scoring.refresh(df, 100).collect()} == want


def test_many_keys_share_a_group(spark, tmp_path, monkeypatch):
    """Keys of one bucket keep their own states over batches, nulls among them; output goes on in pieces."""
    monkeypatch.setattr(state, "OUT_ROWS", 7)
    keys = [(None if r == 0 else f"r{r}", t) for r in range(40) for t in range(3)]
    df = spark.createDataFrame([(r, t, f, f + len(r or "")) for r, t in keys for f in range(9)], "rec string, track int, frame long, x long")
    seen = []

    def step(own, key, rows):
        seen.append(key)
        own.total += int(rows["x"].sum())
        return [(*key, int(f), own.total) for f in rows["frame"][-1:]]

    op = lambda x: state.stateful(x, ["rec", "track"], ["frame"], "rec string, track int, frame long, total long", streams.Scoring, step, buckets=2)
    monkeypatch.setattr(streams.Scoring, "total", 0, raising=False)
    got = {tuple(r) for r in streamed(spark, df, "frame", op, tmp_path)}
    whole = lambda r, n: sum(f + len(r or "") for f in range(n))
    assert got == {(r, t, n - 1, whole(r, n)) for r, t in keys for n in (3, 6, 9)}


def test_groups_do_not_grow_with_keys(spark, tmp_path):
    """A batch of 3,000 keys makes no more groups than there are buckets."""
    df = spark.range(3000).select(F.col("id").cast("string").alias("rec"), F.lit(0).alias("track"), F.lit(0).cast("long").alias("frame"), F.lit(0.9).alias("prob"), F.lit(True).alias("is_last"))
    df.write.parquet(f"{tmp_path}/in")
    q = streams.stream_segments(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), SegmentConfig(0.5, 0.5, 0, 0, 0, 0)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3000
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= state.BUCKETS


@pytest.mark.parametrize("name", ["t11_late_frames", "t4_stream_segments", "u4_exactly_once"])
def test_query_on_many_short_recordings(spark, tmp_path, monkeypatch, name):
    """1,500 users of two event types: the rows of the SQL, from no more groups than there are buckets."""
    rows = spark.range(9000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), (F.col("id") % 1500).alias("user_id"), F.when(F.col("id") % 7 < 4, "a").otherwise("b").alias("event_type"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    ran, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **b: ran.append(start(self, *a, **b)) or ran[-1])
    df = catalog.QUERIES[name](spark, str(tmp_path))
    names = ", ".join(df.columns)
    want = duckdb.sql(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet/*.parquet') SELECT {names} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 1000
    assert [0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= state.BUCKETS for q in ran] == [True, True]
