"""Window forms against plain folds over random series."""

import random

import numpy as np
import pytest

from framewise.operators import evaluate, features, segments, vad
from framewise.operators.segments import SegmentConfig


def fold(probs, cfg):
    """Sequential form of build_segments."""
    islands, on = [], None
    for f, p in enumerate(probs):
        if on is None and p > cfg.on:
            on = f
        elif on is not None and p < cfg.off:
            islands.append((max(0, on - cfg.pad_on), f + cfg.pad_off, False))
            on = None
    if on is not None:
        islands.append((max(0, on - cfg.pad_on), len(probs) + cfg.pad_off, True))
    out, end = [], None
    for a, b, open_ in islands:
        long = b - a > cfg.min_on or (open_ and b - a >= cfg.min_on)
        joins = end is not None and a - end <= cfg.min_off
        if not joins:
            live = False
        if live:
            out[-1][1] = max(out[-1][1], b)
        elif long:
            out.append([a, b])
            live = True
        end = b
    return [tuple(x) for x in out]


CONFIGS = [SegmentConfig(), SegmentConfig(0.6, 0.3), SegmentConfig(0.5, 0.5, 2, 1, 3, 2), SegmentConfig(0.7, 0.2, 1, 3, 6, 0), SegmentConfig(0.5, 0.4, 0, 0, 2, 5)]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_build_segments(spark, cfg):
    rng = random.Random(4)
    series = {r: [round(rng.random(), 2) for _ in range(rng.randint(1, 60))] for r in range(25)}
    df = spark.createDataFrame([(r, f, 0, p) for r, ps in series.items() for f, p in enumerate(ps)], "rec int, frame long, track int, prob double")
    got = {}
    for x in segments.build_segments(df, cfg).collect():
        got.setdefault(x.rec, []).append((x.start_frame, x.end_frame))
    assert {r: sorted(v) for r, v in got.items()} == {r: w for r, ps in series.items() if (w := fold(ps, cfg))}


def test_config_errors():
    with pytest.raises(ValueError):
        SegmentConfig(0.3, 0.5)
    with pytest.raises(ValueError):
        SegmentConfig(min_on=-1)
    assert SegmentConfig.of_seconds(12.5, min_on=0.2, pad_on=0.04).min_on == 3
    with pytest.raises(ValueError):
        vad.VadConfig(threshold=1.5)
    assert vad.VadConfig(pad=0.5).problems()


def test_regions_equal_fold(spark):
    rng = random.Random(5)
    series = {r: [rng.choice((0.1, 0.3, 0.5, 0.72, 0.9)) for _ in range(rng.randint(1, 50))] for r in range(25)}
    df = spark.createDataFrame([(r, c, p) for r, ps in series.items() for c, p in enumerate(ps)], "rec int, chunk long, prob double")
    endless = vad.VadConfig(offset=0.35, min_speech=0.3, min_silence=0.5, max_speech=float("inf"))
    key = lambda rows: sorted((x.rec, x.start_sample, x.end_sample) for x in rows)
    assert key(vad.speech_regions(df, endless).collect()) == key(vad.split_regions(df, endless).collect())
    short = vad.VadConfig(threshold=0.7, offset=0.2, min_speech=0.1, max_speech=3.0, pad=0.1)
    most = vad.samples(3.0) - vad.CHUNK - 2 * vad.samples(0.1)
    for x in vad.split_regions(df, short).collect():
        assert x.end_sample - x.start_sample <= most + 3 * vad.CHUNK


def test_assignment_is_cheapest(spark):
    import itertools

    rng = random.Random(6)
    costs = {r: [[rng.randint(0, 9) for _ in range(rng.choice((m,)))] for _ in range(n)] for r, (n, m) in enumerate([(rng.randint(1, 4), rng.randint(1, 4)) for _ in range(20)])}
    df = spark.createDataFrame([(r, i, j, c) for r, m in costs.items() for i, row in enumerate(m) for j, c in enumerate(row)], "rec int, ref_track int, pred_track int, cost long")
    got = {}
    for x in evaluate.optimal_assignment(df).collect():
        got.setdefault(x.rec, []).append((x.ref_track, x.pred_track))
    for r, m in costs.items():
        n, k = len(m), len(m[0])
        flip = n > k
        t = [list(x) for x in zip(*m, strict=True)] if flip else m
        best = min(sum(t[i][p] for i, p in enumerate(ps)) for ps in itertools.permutations(range(len(t[0])), len(t)))
        assert len(got[r]) == min(n, k) == len({a for a, _ in got[r]}) == len({b for _, b in got[r]})
        assert sum(m[a][b] for a, b in got[r]) == best


def test_cheapest():
    """Against all permutations, ties by order included; and a recording of 12 by 14 tracks with a known answer."""
    import itertools

    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(1, 5)
        m = rng.randint(n, 6)
        cost = [[rng.randint(0, 3) for _ in range(m)] for _ in range(n)]
        assert evaluate.cheapest(cost) == min((sum(cost[i][j] for i, j in enumerate(p)), list(p)) for p in itertools.permutations(range(m), n))[1]
    right = rng.sample(range(14), 12)
    assert evaluate.cheapest([[0 if right[i] == j else 5 + (i * j) % 7 for j in range(14)] for i in range(12)]) == right


def test_many_tracks(spark):
    """der has no limit on tracks: 12 speakers, renamed, and silent for a frame each."""
    ref = [(1, f, t, int(f % 12 == t)) for f in range(240) for t in range(12)]
    pred = [(1, f, 11 - t, 0.9 if a and f >= 12 else 0.1) for _, f, t, a in ref]
    got = evaluate.der(spark.createDataFrame(pred, "rec int, frame long, track int, prob double"), spark.createDataFrame(ref, "rec int, frame long, track int, active int")).collect()
    assert [tuple(r) for r in got] == [(1, 240.0, 12.0, 0.0, 0.0, 0.05)]


def test_empty(spark):
    df = spark.createDataFrame([], "rec int, frame long, track int, prob double")
    assert segments.build_segments(df).count() == 0 and segments.hysteresis(df).count() == 0


def test_split_regions_cases():
    """Regions in chunks, worked out by hand: 0.256 s a chunk, at most 5 chunks (1.536 s less a chunk)."""
    cfg = vad.VadConfig(threshold=0.5, offset=0.2, min_speech=0, min_silence=0.75, max_speech=1.536, pad=0, split_silence=0.2)

    def regions(text, **other):
        p = np.array([{"L": 0.9, "m": 0.4, "q": 0.2, "d": 0.1}[c] for c in text])
        own, at = vad.VadConfig(**{**vars(cfg), **other}), np.arange(len(p))
        return vad.bounded_regions(at[p >= own.entry], at[p < own.exit], p[p < own.exit], len(p), own)

    assert regions("mLLLm") == [(1, 5)]
    assert regions("LLqqqL") == [(0, 6)]  # the third quiet chunk begins 0.512 s after the first: too short
    assert regions("LLqqqqL") == [(0, 2), (6, 7)]  # the fourth begins 0.768 s after it
    assert regions("LLLLLLLLL") == [(0, 6), (7, 9)]  # no silence: cut, and the next loud chunk begins anew
    assert regions("LqLLLLLL") == [(0, 1), (2, 8)]  # split at the only silence
    assert regions("LqLqqLLL") == [(0, 3), (5, 8)]  # the longest of two
    assert regions("LqqLqLLL", longest_silence=False, split_threshold=0.0) == [(0, 4), (5, 8)]  # the last
    assert regions("LdLqqLLL", split_threshold=0.15) == [(0, 1), (2, 8)]  # a deep one before a longer one
    assert regions("") == [] and regions("mmq") == []


def test_split_regions_in_parts(spark):
    """Long silences part a recording; the regions are those of the whole recording."""
    rng, rows = random.Random(6), []
    for rec in range(12):
        p = []
        while len(p) < 400:
            p += [min(1.0, rng.choice((0.05, 0.15, 0.35, 0.7, 0.9)) + rng.uniform(0, 0.1))] * rng.choice((1, 2, 4, 9, 30))
        rows += [(rec, i, x) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "rec long, chunk long, prob double")
    for most, least in ((1.0, 0.3), (3.0, 0.75), (20.0, 0.0)):
        cfg = vad.VadConfig(threshold=0.5, offset=0.2, min_speech=0.1, min_silence=least, max_speech=most, pad=0.05)
        want = set()
        for rec in range(12):
            p = np.array([x for r, _, x in rows if r == rec])
            at, loud, calm = np.arange(len(p)), p >= cfg.entry, p < cfg.exit
            found = vad.bounded_regions(at[loud], at[calm], p[calm], len(p), cfg)
            want |= {(rec, x * vad.CHUNK, y * vad.CHUNK) for x, y in found if (y - x) * vad.CHUNK >= max(1, vad.samples(cfg.min_speech))}
        assert {tuple(r) for r in vad.split_regions(df, cfg).collect()} == want


def test_chunks_resampled_and_mixed(spark):
    """Chunks of any length, and outputs denser or sparser than inputs, against a plain loop."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=101)
    cuts = [0, 1, 4, 4, 40, 41, 101]
    rows = [("a", c, a, x[a:b].tolist()) for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))] + [("b", 0, 0, [2.0]), ("c", 0, 0, [])]
    chunks = spark.createDataFrame(rows, "rec string, chunk long, start_sample long, samples array<double>")
    for rate_in, rate_out in ((16000, 10000), (8000, 24000), (44100, 16000), (3, 1)):
        ratio = rate_in / rate_out
        want = {}
        for rec, v in (("a", x), ("b", np.array([2.0]))):
            for i in range(int(len(v) / ratio)):
                k = int(np.floor(i * ratio))
                want[rec, i] = v[k] + (v[min(k + 1, len(v) - 1)] - v[k]) * (i * ratio - k)
        got = {(r.rec, r.sample): r.x for r in features.to_samples(features.resample_linear(chunks, rate_in, rate_out)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert features.resample_linear(chunks, 8000, 8000) is chunks
    three = spark.createDataFrame([("a", 0, 0, x[:60].tolist()), ("a", 1, 60, x[60:99].tolist()), ("a", 2, 99, [])], chunks.schema)
    got = {r.sample: r.x for r in features.to_samples(features.downmix(three, 3)).collect()}
    assert np.allclose([got[i] for i in range(33)], x[:99].reshape(33, 3).mean(axis=1)) and len(got) == 33


@pytest.mark.parametrize("nfft, win, hop, size", [(32, 24, 16, 64), (32, 24, 16, 10), (8, 8, 20, 7), (16, 9, 5, 64)])
def test_frames_across_chunks(spark, nfft, win, hop, size):
    """Frames longer and shorter than chunks and hops, short recordings and a short last chunk."""
    rng = np.random.default_rng(nfft + size)
    series = {r: rng.normal(size=n) for r, n in (("a", 150), ("b", size), ("c", 3), ("d", size * 2 + 1))}
    rows = [(r, i // size, i, x[i : i + size].tolist()) for r, x in series.items() for i in range(0, len(x), size)]
    chunks = spark.createDataFrame(rows, "rec string, chunk long, start_sample long, samples array<double>")
    for mode, shift, length in (("center", -(nfft // 2), nfft), ("pre_padded", 0, nfft), ("plain", 0, win)):
        want = {}
        for r, x in series.items():
            frames = len(x) // hop if mode == "center" else (len(x) - length) // hop + 1
            far = np.concatenate((np.zeros(nfft), x, np.zeros(2 * nfft)))
            want |= {(r, f): far[nfft + f * hop + shift :][:length] for f in range(max(0, frames))}
        got = {(r.rec, r.frame): r.samples for r in features.analysis_frames(chunks, nfft, win, hop, mode, size).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_assignment_has_no_group_for_each_recording(spark):
    """Matrices of many recordings are rows of a batch; pairs over frames beyond a collar equal those under its mask."""
    import random

    from framewise.operators import evaluate

    rng = random.Random(4)
    grid = [(r, f, t) for r in range(8) for f in range(30) for t in range(3)]
    ref = spark.createDataFrame([(r, f, t, (f // 10 + t + r) % 2) for r, f, t in grid if t <= r % 3], "rec long, frame long, track int, active int")
    pred = spark.createDataFrame([(r, f, t, int(rng.random() < 0.5)) for r, f, t in grid if (f + t) % 7], "rec long, frame long, track int, active int")
    under = evaluate.pair_counts(pred, ref, evaluate.collar_mask(ref, 1))
    beyond = evaluate.pair_counts_beyond(pred, ref, 1)
    assert under.columns == beyond.columns and sorted(map(tuple, under.collect())) == sorted(map(tuple, beyond.collect())) and under.count() == 3 * sum(r % 3 + 1 for r in range(8))
    found = evaluate.optimal_assignment(beyond)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert found.count() == sum(r % 3 + 1 for r in range(8))
