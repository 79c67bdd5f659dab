"""Goldens for windows, filters and images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evplace.operators import frames, images
from evplace.sources import events as src

EV = "seq string, event_idx long, t long, x int, y int, p int"


def ev(spark, rows):
    return spark.createDataFrame(rows, EV)


def test_window_edges(spark):
    # dt = 10 ticks; the event at t_max = s0 + 2 dt is in no frame, the middle frame is empty
    e = ev(spark, [("a", 0, 100, 0, 0, 1), ("a", 1, 109, 0, 0, 1), ("a", 2, 130, 0, 0, 1), ("a", 3, 121, 0, 0, 0), ("b", 0, 5, 0, 0, 1), ("b", 1, 5, 0, 0, 1)])
    got = sorted((r.seq, r.event_idx, r.frame_idx) for r in frames.assign_frames(e, 10, 1e-3).collect())
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 3, 2)]
    spine = sorted((r.seq, r.frame_idx, r.w_start, r.w_end, r.n_events) for r in frames.frame_spine(e, 10, 1e-3).collect())
    assert spine == [("a", 0, 100, 110, 2), ("a", 1, 110, 120, 0), ("a", 2, 120, 130, 1)]
    starts = spark.createDataFrame([("a", 0.105)], "seq string, start_time double")
    assert sorted((r.event_idx, r.frame_idx) for r in frames.assign_frames(e, 10, 1e-3, starts).collect()) == [(1, 0), (2, 2), (3, 1)]
    late = spark.createDataFrame([("a", 9.0)], "seq string, start_time double")
    assert frames.assign_frames(e, 10, 1e-3, late).count() == 0
    with pytest.raises(ValueError):
        frames.assign_frames(e, 0.1, 1.0)


def test_triplets_and_ema(spark):
    f = spark.createDataFrame([("a", i, float(i % 5)) for i in range(900)], "seq string, frame_idx long, v double")
    assert sorted((r.frame_idx, r.f0, r.f1, r.f2) for r in frames.frame_triplets(f.where("frame_idx < 5")).collect()) == [(3, 0, 1, 2), (4, 1, 2, 3)]
    for alpha in (0.1, 0.9, 0.003):
        want, e = [], None
        for i in range(900):
            e = float(i % 5) if e is None else (1 - alpha) * e + alpha * (i % 5)
            want.append(e)
        got = [r.ema for r in frames.ema(f, "v", "frame_idx", alpha).orderBy("frame_idx").collect()]
        assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9


def test_crop_and_pixels(spark):
    assert frames.crop_offsets(19, 22, 8) == {"top": 2, "left": 3, "h": 16, "w": 16, "k_max": 8}
    e = ev(spark, [("a", 0, 0, 3, 2, 1), ("a", 1, 0, 2, 2, 1), ("a", 2, 0, 18, 17, 0), ("a", 3, 0, 19, 17, 0)])
    assert sorted((r.event_idx, r.x, r.y) for r in frames.center_crop(e, 19, 22, 8).collect()) == [(0, 0, 0), (2, 15, 15)]
    assert [r.channel for r in frames.with_pixel_index(e, 19, 22, True).orderBy("event_idx").collect()] == [0, 0, 1, 1]


def test_columns_by_name(spark):
    df = spark.createDataFrame([(1, 2, 3, 0, 9)], "Timestamp long, col int, row int, Polarity int, extra int")
    assert src.resolve_event_columns(df).collect()[0] == (1, 2, 3, 0)
    with pytest.raises(ValueError):
        src.resolve_event_columns(df.drop("row"))
    for p in ("pol", "polarity_bit", "polarity_bits"):
        assert src.resolve_event_columns(df.withColumnRenamed("Polarity", p)).collect()[0] == (1, 2, 3, 0)
    # each column is found on its own: here, or in subgroups in order of their names; a group named events is the only one looked at
    split = df.select(F.struct(F.struct("row", F.col("Polarity").alias("pol")).alias("b"), F.struct(F.lit(7).alias("row"), "col").alias("c")).alias("z"), "Timestamp")
    assert src.resolve_event_columns(split).collect()[0] == (1, 2, 3, 0)
    grouped = df.select(F.struct(F.struct("row", "col").alias("xy"), "Timestamp", "Polarity").alias("events"), F.lit(5).alias("t"))
    assert src.resolve_event_columns(grouped).collect()[0] == (1, 2, 3, 0)
    with pytest.raises(ValueError, match="for p in"):
        src.resolve_event_columns(df.select(F.struct("Timestamp", "row", "col").alias("events"), "Polarity"))
    assert src.infer_resolution(ev(spark, [])).collect()[0] == (0, 0)
    first = src.infer_resolution(ev(spark, [("a", 0, 1, 3, 4, 1), ("a", 1, 2, 9, 9, 1)]), 1).collect()[0]
    assert first == (5, 4)


def test_images(spark):
    rows = [("a", 0, 10, 1, 1, 1, 0), ("a", 1, 10, 1, 1, 0, 0), ("a", 2, 20, 2, 1, 1, 0)] + [("a", 3 + i, 15, 3, 3, 0, 0) for i in range(9)]
    e = spark.createDataFrame(rows, EV + ", frame_idx long")
    t = {(r.y, r.x): (r.r, r.g, r.b) for r in images.tencode(e).collect()}
    assert t[1, 1] == (0.0, 255.0, 255.0) and t[1, 2] == (255.0, 0.0, 0.0)  # ties in time go to the greater index
    assert {(r.y, r.x): r.g for r in images.tencode(e, 1.0).collect()}[1, 1] == 1.0
    spine = spark.createDataFrame([("a", 0), ("a", 1)], "seq string, frame_idx long")
    dense = {r.frame_idx: r.image for r in images.dense_image(images.tencode(e), spine, 4, 4, ("r", "g", "b"), images.background(True)).collect()}
    assert dense[1] == [255.0] * 48 and dense[0][5] == 0.0 and dense[0][16 + 5] == 255.0 and dense[0][0] == 255.0
    assert {r.frame_idx: r.n_valid for r in images.valid_events(e, spine).collect()} == {0: 12, 1: 0}
    s = {(r.y, r.x): (r.value, r.gray) for r in images.signed_frame(e).collect()}
    assert s[3, 3] == (-5, 0) and s[1, 1] == (0, 127) and s[1, 2] == (1, 153)
    f = spark.createDataFrame([("a", 0, 30)], "seq string, frame_idx long, w_end long")
    ts = {(r.channel, r.y, r.x): r.value for r in images.time_surface(e, f, [0.01, 0.02], 1e-3).collect()}
    assert ts[0, 1, 2] == pytest.approx(math.exp(-1)) and ts[1, 1, 2] == pytest.approx(math.exp(-0.5)) and (0, 1, 1) not in ts and (2, 3, 3) not in ts
    n = {(r.y, r.x): r.value for r in images.robust_normalize(images.event_count_frame(e), 2, 2, 1.0).collect()}
    assert n[3, 3] == 1.0 and n[1, 2] == pytest.approx(1 / 9 * 2 - 1)


def test_resize_and_sampling(spark):
    assert images.axis_weights(4, 2) == [(0, 0, 0.5), (0, 1, 0.5), (1, 2, 0.5), (1, 3, 0.5)]
    assert images.axis_weights(4, 2, "nearest") == [(0, 1, 1.0), (1, 3, 1.0)]
    prob = spark.createDataFrame([("a", y, x, 1.0 / 400) for y in range(20) for x in range(20)], "seq string, y int, x int, prob double")
    got = images.sample_pixels(prob, 6, 4.0, 3).collect()
    assert len(got) == 6 and all(math.hypot(a.y - b.y, a.x - b.x) > 4 for a in got for b in got if a.pixel < b.pixel)
    assert sorted(map(tuple, got)) == sorted(map(tuple, images.sample_pixels(prob.repartition(7), 6, 4.0, 3).collect()))
    with pytest.raises(Exception, match="pixels"):
        images.sample_pixels(prob, 60, 9.0).collect()


def test_long_sequences_are_scanned_bucket_by_bucket(spark):
    rng = np.random.default_rng(6)
    rows = [(s, int(i), float(rng.normal())) for s, n in (("a", 700), ("b", 90), ("c", 2), (None, 40)) for i in sorted(rng.choice(5 * n, n, replace=False))]
    df = spark.createDataFrame(rows, "seq string, frame_idx long, v double").repartition(6)
    by = {}
    for s, i, v in rows:
        by.setdefault(s, []).append((i, v))
    triples = sorted(((s, r[k][0], r[k - 3][0], r[k - 2][0], r[k - 1][0]) for s, r in by.items() for k in range(3, len(r))), key=str)
    smooth = {}
    for s, r in by.items():
        e = None
        for i, v in r:
            e = v if e is None else 0.9 * e + 0.1 * v
            smooth[s, i] = e
    for bucket in (1 << 20, 100, 7, 1):
        assert sorted(map(tuple, frames.frame_triplets(df.drop("v"), bucket).collect()), key=str) == triples
        got = {(r.seq, r.frame_idx): r.ema for r in frames.ema(df, "v", "frame_idx", rows=bucket).collect()}
        assert got.keys() == smooth.keys() and max(abs(got[k] - smooth[k]) for k in got) < 1e-9
    assert len({r._b for r in frames.bucketed(df, "frame_idx", rows=100).collect()}) > 4
    assert frames.frame_triplets(df.drop("v").limit(0)).count() == 0 and frames.ema(df.limit(0), "v", "frame_idx").count() == 0
