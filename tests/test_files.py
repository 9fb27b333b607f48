import json
import wave

import numpy as np
import pytest

from framewise.sources import files


def test_rttm_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.rttm").write_text("SPEAKER r1 1 0.500 x <NA> <NA> ann <NA>\nshort\nSPEAKER r1 1  2.000 1.250 <NA> <NA> bob <NA> <NA>\n")
    rows = files.read_rttm(spark, f"{tmp_path}/in").orderBy("line_no").collect()
    assert [(r.rec, r.start, r.duration, r.speaker) for r in rows] == [("r1", 0.5, 0.0, "ann"), ("r1", 2.0, 1.25, "bob")]
    runs = spark.createDataFrame([("r", 1, 4, 6), ("r", 0, 10, 12), ("r", 0, 0, 3)], "rec string, track int, start_frame long, end_frame long")
    labels = spark.createDataFrame([("r", 0, "ann")], "rec string, track int, label string")
    files.write_rttm(files.to_rttm_lines(runs, labels, 10.0), f"{tmp_path}/out")
    text = [r.value for r in spark.read.text(f"{tmp_path}/out").select("value").collect()]
    assert text == ["SPEAKER r 1 0.000 0.300 <NA> <NA> ann <NA> <NA>", "SPEAKER r 1 1.000 0.200 <NA> <NA> ann <NA> <NA>", "SPEAKER r 1 0.400 0.200 <NA> <NA> spk1 <NA> <NA>"]


def test_pcm(spark, tmp_path):
    with wave.open(f"{tmp_path}/x.wav", "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(np.stack([np.arange(10_000) % 100, np.zeros(10_000)], 1).astype("<i2").tobytes())
    rows = files.read_pcm_chunks(spark, f"{tmp_path}/x.wav", 0.1).orderBy("chunk").collect()
    assert [len(r.samples) for r in rows] == [4096, 4096, 1808] and rows[1].start_sample == 4096 and rows[0].rec == "x"
    assert abs(rows[0].samples[3] - 1.5 / 32768) < 1e-7


def test_npy(spark, tmp_path):
    a = np.arange(6, dtype="<f4").reshape(3, 2)
    np.save(f"{tmp_path}/m.npy", a)
    assert [(r.frame, r.track, r.value) for r in files.read_npy_matrices(spark, f"{tmp_path}/m.npy").orderBy("frame", "track").collect()] == [(i // 2, i % 2, float(i)) for i in range(6)]
    np.save(f"{tmp_path}/bad.npy", a.astype("<f8"))
    with pytest.raises(Exception, match="<f4"):
        files.read_npy_matrices(spark, f"{tmp_path}/bad.npy").collect()


def test_metadata(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"input_dim": 345, "target_sample_rate": 8000, "frame_hz": 10.0, "conv_delay": 9, "n_mels": 23, "subsampling": 10}))
    r = files.resolve_config(files.read_metadata(spark, f"{tmp_path}/m.json")).first()
    assert (r.rate, r.win, r.hop, r.fft, r.mels, r.context, r.sub, r.stable_block) == (8000, 200, 80, 256, 23, 7, 10, 800)
    assert abs(r.latency - (128 + 560 + 7200) / 8000) < 1e-9


def test_stream_presets(spark):
    """The named configurations are within their bounds, have the latencies that they are named for, and which are interchangeable."""
    rows = {r.config: r for r in files.stream_presets(spark).collect()}
    assert {c: round(r.latency, 2) for c, r in rows.items()} == {"default": 1.04, "high_latency": 30.4, "low_latency": 1.04}
    # An update takes at least a chunk, so one period is lifted from 300 to 340 frames.
    assert {c: (r.chunk, r.left, r.right, r.fifo, r.cache, r.period) for c, r in rows.items()} == files.PRESETS | {"high_latency": (340, 1, 40, 40, 188, 340)}
    same = files.compatible(files.stream_presets(spark), files.stream_presets(spark))
    assert sorted((r.config, r.other) for r in same.collect()) == [(c, c) for c in sorted(rows)]
