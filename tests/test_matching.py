"""Goldens and properties for descriptors, similarity, matching, evaluation and streams."""

import io
import struct
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evplace.functions import kernels
from evplace.operators import descriptors as ds
from evplace.operators import evaluate, frames, images, rerank, similarity
from evplace.sources import features, keypoint_logs
from evplace.streaming import jobs


def vecs(spark, a, seq="ref"):
    return spark.createDataFrame([(seq, i, [float(x) for x in v]) for i, v in enumerate(a)], "seq string, frame_idx long, vec array<double>")


def test_whitening(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 5
    df = vecs(spark, a).repartition(5)
    out = np.stack([np.array(r.vec) for r in ds.apply_whitening(df, ds.fit_whitening(df)).collect()])
    assert np.allclose(np.cov(out.T), np.eye(6), atol=1e-6) and np.allclose(out.mean(axis=0), 0, atol=1e-9)
    few = ds.fit_whitening(vecs(spark, a[:3]))
    assert few["components"].shape == (3, 6)


def test_gem_is_mean_at_one(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 0, 3.0), ("a", 0, 1, 0.0)], "seq string, frame_idx long, channel int, value double")
    assert {r.channel: r.value for r in ds.gem_pool(df, 1, 1e-6).collect()} == {0: pytest.approx(2.0), 1: pytest.approx(1e-6)}


def test_topk_blocks(spark):
    rng = np.random.default_rng(1)
    r, q = rng.normal(size=(50, 5)), rng.normal(size=(20, 5))
    r[7] = r[3]  # a tie goes to the smaller index
    sim = (q / np.linalg.norm(q, axis=1)[:, None]) @ (r / np.linalg.norm(r, axis=1)[:, None]).T
    for block in (7, 1000):
        got = {(x.query_idx, x.rank): x.ref_idx for x in similarity.topk_similarity(vecs(spark, r), vecs(spark, q, "query"), 60, block=block).collect()}
        assert len(got) == 20 * 50
        for i in range(20):
            assert [got[i, k + 1] for k in range(50)] == list(np.lexsort((np.arange(50), np.round(-sim[i], 12))))
    with pytest.raises(ValueError):
        similarity.pairwise_distance(vecs(spark, r), vecs(spark, q), "hamming")


def test_kernels():
    rng = np.random.default_rng(2)
    src = rng.uniform(0, 300, (50, 2))
    h = np.array([[1.1, 0.05, 4], [-0.03, 0.95, 9], [1e-4, -1e-4, 1]])
    p = np.c_[src, np.ones(50)] @ h.T
    dst = p[:, :2] / p[:, 2:]
    dst[30:] += rng.uniform(60, 200, (20, 2))
    assert kernels.homography_inliers(src, dst, 1.0, 200, 1) in (30, 31, 32)
    assert kernels.homography_inliers(src[:3], dst[:3]) == 0
    assert kernels.homography_inliers(np.zeros((9, 2)), np.zeros((9, 2))) >= 0
    _, i, j, _ = kernels.match_stacks(np.eye(3)[None], np.eye(3)[[2, 0, 1]][None])
    assert list(zip(i, j)) == [(0, 1), (1, 2), (2, 0)]
    assert len(kernels.match_lists(np.eye(3), np.array([0, 3]), np.eye(3)[:1], np.array([0, 1]), "ratio")[0]) == 0
    m = rng.uniform(1, 5, (20, 30))
    errors = kernels.masked_ssim_errors(np.stack([m, m, m]), np.stack([m, m * (m > 4.9), rng.uniform(1, 5, (20, 30))]))
    assert errors[0] == pytest.approx(0, abs=1e-12) and errors[1] == 1.0 and errors[2] > 0.3
    assert np.allclose(kernels.area_downsample(m, (10, 15)), m.reshape(10, 2, 15, 2).mean(axis=(1, 3)))
    assert kernels.area_downsample(m, (7, 7)).mean() == pytest.approx(m.mean())


@pytest.mark.parametrize("kind", ["mutual", "ratio"])
def test_matches_equal_brute_force(spark, kind):
    rng = np.random.default_rng(9)
    packs = [[(k, float(k), float(10 + k), 1.0, [float(x) for x in rng.normal(size=4)]) for k in range(n)] for n in (0, 1, 2, 5, 5, 9)]
    pairs = [(a, b) for a in range(6) for b in range(6)]
    kp = "array<struct<kp_idx:int,x:double,y:double,score:double,desc:array<double>>>"
    rows = [(a, b, packs[a], packs[b] or None) for a, b in pairs] + [(7, 7, None, None)]
    given = spark.createDataFrame(rows, f"query_idx int, ref_idx long, query_kps {kp}, ref_kps {kp}")
    found = lambda df: {(r.query_idx, r.ref_idx, r.i, r.j, round(r.dist, 9), r.src_x, r.dst_y) for r in rerank.match_pairs(df, kind).collect()}
    got = found(given)
    dense = lambda df, c: rerank.dense_packs(df.withColumnRenamed(c, "kps")).withColumnRenamed("kps", c)
    assert found(dense(dense(given, "query_kps"), "ref_kps")) == got
    want = set()
    for a, b in pairs:
        d = np.array([[np.linalg.norm(np.subtract(x[4], y[4])) for y in packs[b]] for x in packs[a]]).reshape(len(packs[a]), len(packs[b]))
        for i in range(len(packs[a])):
            if not len(packs[b]):
                continue
            j = int(d[i].argmin())
            if (d[:, j].argmin() == i) if kind == "mutual" else (len(packs[b]) > 1 and d[i, j] < 0.8 * np.partition(d[i], 1)[1]):
                want.add((a, b, i, j, round(float(d[i, j]), 9), float(i), float(10 + j)))
    assert got == want and len(want) > 20


def test_rerank_rules(spark):
    s = spark.createDataFrame([(0, 1, 10, 0.5), (0, 2, 11, 0.51), (1, 1, 10, 0.3)], "query_idx long, rank int, ref_idx long, dist double")
    i = spark.createDataFrame([(0, 11, 4), (0, 10, 0)], "query_idx long, ref_idx long, inliers long")
    f = rerank.fuse_inliers(s, i)
    assert {(r.query_idx, r.ref_idx, r.inliers) for r in rerank.best_match(f).collect()} == {(0, 11, 4), (1, 10, 0)}
    with pytest.raises(ValueError):
        rerank.full_column(s, f, "zero")
    inf = rerank.full_column(s, f.where("query_idx = 0"), "inf").where("query_idx = 1").collect()
    assert inf[0].new_dist == float("inf")
    depth = spark.createDataFrame([(10, 12, 12, [float(1 + (k * 7) % 11) for k in range(144)]), (0, 12, 12, [float(1 + (k * 7) % 11) for k in range(144)])], "frame_idx long, h int, w int, px array<double>")
    out = {(r.query_idx, r.ref_idx): r for r in rerank.depth_rerank(s, depth, depth, size=None).collect()}
    assert out[0, 10].new_dist == pytest.approx(0.5 - 0.15) and out[0, 11].err is None and out[0, 11].new_dist == 0.51
    with pytest.raises(Exception, match="similarities"):
        rerank.gate_features(s.withColumn("sim", 1 - F.col("dist")), 5).collect()


def test_recall(spark):
    ranked = spark.createDataFrame([(q, r, abs(q - r) + r / 100) for q in range(6) for r in range(6)], "query_idx long, ref_idx long, dist double")
    gt = spark.createDataFrame([(0, 0), (5, 1)], "ref_idx long, query_idx long")  # the other queries have no positive
    got = {r.k: r.recall for r in evaluate.recall_at_k(ranked, gt, (1, 5, 6)).collect()}
    assert got == {1: 0.5, 5: 0.5, 6: 1.0}
    for tol in (1, 2):
        wide = evaluate.dilate_gt(gt, tol, 6, 6)
        a = {r.k: round(r.recall, 9) for r in evaluate.recall_at_k(ranked, wide, (1, 2, 3)).collect()}
        b = {r.k: round(r.recall, 9) for r in evaluate.recall_at_k(ranked, gt, (1, 2, 3), tol=tol).collect()}
        assert a == b
    assert {tuple(r) for r in evaluate.resize_gt(gt, (6, 6), (3, 3)).collect()} == {(2, 0)}
    with pytest.warns(UserWarning):
        evaluate.resize_gt(gt, (6, 6), (6, 3))
    assert evaluate.latency_summary(spark.createDataFrame([], "stage string, ms double")).collect() == []


def log_bytes(k=3, d=2, records=2, cut=0, magic=b"EKPR", valid=2):
    out = struct.pack("<4sHHHhhHH", magic, 1, 10, 12, 4, 5, k, d)
    for f in range(records):
        out += struct.pack("<IqH", f, 1000 + f, valid) + np.array([[1, 2], [3, 4], [-1, -1]], "<i2").tobytes() + np.array([0.5, 0.25, 0], "<f2").tobytes() + np.arange(6).astype("<f2").tobytes()
    return out[: len(out) - cut]


def test_binary_sources(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(log_bytes())
    (tmp_path / "b.bin").write_bytes(log_bytes(cut=5))
    (tmp_path / "c.bin").write_bytes(log_bytes(valid=0))
    rows = keypoint_logs.read_keypoint_logs(spark, str(tmp_path / "*.bin")).collect()
    assert len(rows) == 4 + 2
    r = next(r for r in rows if r.path.endswith("a.bin") and r.frame_idx == 1 and r.kp_idx == 1)
    assert (r.t_ref, r.x, r.y, r.score, r.desc) == (1001, 4 + 5, 3 + 4, 0.25, [2.0, 3.0])
    with pytest.raises(ValueError):
        keypoint_logs.log_header(log_bytes(magic=b"XXXX"))
    (tmp_path / "bad.log").write_bytes(b"EK")
    with pytest.raises(Exception, match="not a keypoint log"):
        keypoint_logs.read_keypoint_logs(spark, str(tmp_path / "bad.log")).collect()
    for i in (0, 3):
        buf = io.BytesIO()
        np.savez(buf, np.array([[3.0, 4.0]]) * (i + 1))
        (tmp_path / f"ref_feats_{i}.npz").write_bytes(buf.getvalue())
    feats = features.read_npz_features(spark, str(tmp_path / "*.npz"))
    assert {r.frame_idx: [round(x, 6) for x in r.vec] for r in feats.collect()} == {0: [0.6, 0.8], 3: [0.6, 0.8]}
    assert [(r.frame_idx, r.vec is None) for r in features.densify_index(feats).orderBy("frame_idx").collect()] == [(0, False), (1, True), (2, True), (3, False)]
    two = feats.select(F.lit("a").alias("seq"), "frame_idx").unionByName(feats.select(F.lit("b").alias("seq"), "frame_idx").where("frame_idx = 0"))
    assert sorted(map(tuple, features.densify_index(two, keys=("seq",)).collect())) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)]
    buf = io.BytesIO()
    np.savez(buf, np.ones((1, 3)))
    (tmp_path / "ref_feats_9.npz").write_bytes(buf.getvalue())
    with pytest.raises(ValueError):
        features.read_npz_features(spark, str(tmp_path / "*.npz"))


def test_packs_round_trip(spark):
    k = spark.createDataFrame([("a", 0, i, 1.0 * i, 2.0 * i, i % 3 / 2, [1.0, 0.0]) for i in range(7)], "seq string, frame_idx long, kp_idx int, x double, y double, score double, desc array<double>")
    f = spark.createDataFrame([("a", 0), ("a", 1)], "seq string, frame_idx long")
    p = features.pack_keypoints(k, f, 4)
    assert {r.frame_idx: r.n for r in p.collect()} == {0: 4, 1: 0}
    assert [r.kp_idx for r in features.unpack_keypoints(p).orderBy("pos").collect()] == [2, 5, 1, 4]
    assert frames.usable_frames(p).count() == 1


def events_ts(spark):
    rng = np.random.default_rng(5)
    rows = [("a", i, int(i * 90_000 + rng.integers(0, 1000)), int(rng.integers(0, 4)), int(rng.integers(0, 3)), int(rng.integers(0, 2))) for i in range(120)]
    return spark.createDataFrame(rows, "seq string, event_idx long, t long, x int, y int, p int")


def stream_of(spark, df, path, files=3):
    # one file after another, so that they arrive in order
    order = "t" if "t" in df.columns else "frame_idx"
    top = df.agg(F.max(order)).first()[0] + 1
    for i in range(files):
        df.where((F.col(order) >= top * i // files) & (F.col(order) < top * (i + 1) // files)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_memory(spark, out, name):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    e = events_ts(spark).withColumn("ts", F.timestamp_micros("t"))
    s = stream_of(spark, e.orderBy("t"), str(tmp_path / "ev"))
    got = run_memory(spark, jobs.stream_frames(s, "1 second"), "frames_out").collect()
    closed = max(r.w_end for r in got)
    batch = e.groupBy(F.window("ts", "1 second").alias("w"), "seq", "p", "y", "x").count().where(F.col("w.end") <= F.lit(closed)).collect()
    assert {(r.w_start, r.channel, r.y, r.x, r.value) for r in got} == {(r.w.start, r.p, r.y, r.x, float(r["count"])) for r in batch} and len(got) > 20
    ts = run_memory(spark, jobs.stream_time_surface(s, "1 second", [0.5, 1.0]), "surface_out").collect()
    framed = e.withColumn("frame_idx", F.expr("t div 1000000"))
    spine = framed.select("seq", "frame_idx").distinct().withColumn("w_end", (F.col("frame_idx") + 1) * 1_000_000)
    want = images.time_surface(framed, spine, [0.5, 1.0], 1e-6).where(F.timestamp_micros((F.col("frame_idx") + 1) * 1_000_000) <= F.lit(max(r.w_end for r in ts))).collect()
    assert {(r.channel, r.y, r.x, round(r.value, 9), r.w_end.timestamp()) for r in ts} == {(r.channel, r.y, r.x, round(r.value, 9), r.frame_idx + 1.0) for r in want}
    f = spark.createDataFrame([("a", i) for i in range(12)], "seq string, frame_idx long")
    trip = run_memory(spark, jobs.stream_triplets(stream_of(spark, f, str(tmp_path / "fr"))), "triplets_out").collect()
    assert {tuple(r) for r in trip} == {tuple(r) for r in frames.frame_triplets(f).collect()} and len(trip) == 9


def test_stream_rerank_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    rv, qv = rng.normal(size=(30, 8)), rng.normal(size=(9, 8))
    kp = [(seq, i, j, float(20 * j), float(11 * j), 1.0, [float(x) for x in rng.normal(size=4)]) for seq, n in (("ref", 30), ("query", 9)) for i in range(n) for j in range(6)]
    kps = spark.createDataFrame(kp, "seq string, frame_idx long, kp_idx int, x double, y double, score double, desc array<double>")
    ref, query = vecs(spark, rv), vecs(spark, qv, "query")
    pack = lambda s, v: features.pack_keypoints(kps.where(F.col("seq") == s), v, 10)
    rp, qp = pack("ref", ref), pack("query", query)
    frames_in = query.join(qp, ["seq", "frame_idx"]).select("frame_idx", "vec", "n", "kps")
    s = stream_of(spark, frames_in, str(tmp_path / "q"))
    seen = []
    jobs.stream_rerank(s, ref, rp, str(tmp_path / "out"), str(tmp_path / "cp"), on_window=lambda df, i: seen.append((i, df.count())), k=5).awaitTermination(180)
    got = {(r.query_idx, r.ref_idx, round(r.new_dist, 9), r.inliers) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.query_idx, r.ref_idx, round(r.new_dist, 9), r.inliers) for r in jobs.rerank_batch(query, qp, ref, rp, k=5).collect()}
    assert got == want and len(seen) == 3
    jobs.stream_static_topk(s, ref, str(tmp_path / "top"), str(tmp_path / "cp2"), 4).awaitTermination(180)
    a = {(r.query_idx, r["rank"], r.ref_idx) for r in spark.read.parquet(str(tmp_path / "top")).collect()}
    assert a == {(r.query_idx, r["rank"], r.ref_idx) for r in similarity.topk_similarity(ref, query, 4).collect()}


def packs_of(spark, frames, dtype="double"):
    """Packs of frames (index, keypoints: kp_idx, x, y, desc)."""
    rows = [(i, len(k or []), k) for i, k in frames]
    return spark.createDataFrame(rows, f"frame_idx long, n int, kps array<struct<kp_idx:int,x:double,y:double,desc:array<{dtype}>>>")


@pytest.mark.parametrize("dtype,kind", [("double", "mutual"), ("double", "ratio"), ("float", "mutual")])
def test_block_matching_equals_matching_row_by_row(spark, dtype, kind):
    rng = np.random.default_rng(5)
    make = lambda n: [(int(j), float(j), float(2 * j), [float(v) for v in rng.normal(size=6)]) for j in rng.permutation(n)]
    ref = [(i, make(int(n))) for i, n in enumerate(rng.integers(0, 9, 30))] + [(40, None)]
    query = [(i, make(int(n))) for i, n in enumerate(rng.integers(0, 9, 20))] + [(25, [])]
    r, q = packs_of(spark, ref, dtype), packs_of(spark, query, dtype)
    # one reference is asked for by all queries, one pair twice, some sides have no pack
    pairs = spark.createDataFrame([(i, j) for i in range(26) for j in (3, (i * 7) % 30, 40, 99)] + [(4, 3)], "query_idx long, ref_idx long").withColumn("dist", F.lit(0.5))
    rows = lambda df: sorted({tuple(round(float(v), 4) for v in x) for x in df.collect()})
    want = rows(rerank.match_pairs(similarity.attach_keypoints(pairs, r, q), kind))
    assert len(want) > 50
    for blocks in ((16, 128), (3, 4), (1, 1)):
        got = rerank.match_shortlist(pairs, r, rerank.dense_packs(q), kind, query_block=blocks[0], ref_block=blocks[1])
        assert rows(got) == want and got.count() == len(want)
    assert rerank.match_shortlist(pairs.limit(0), r, q).count() == 0
    with pytest.raises(ValueError):
        rerank.match_shortlist(pairs, r, q, "all")


def test_packs_are_shuffled_by_block_and_not_by_pair(spark):
    """Of 40 queries with 20 candidates each, all within two blocks of references, every pack is shuffled a few times, not twenty."""
    desc = [1.0] * 256
    frames = [(i, [(0, 0.0, 0.0, [float(i), *desc])]) for i in range(40)]
    packs = rerank.dense_packs(packs_of(spark, frames))
    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in range(20)], "query_idx long, ref_idx long")
    plan = rerank.match_shortlist(pairs, packs, packs, query_block=20, ref_block=20)
    met = pairs.selectExpr("query_idx div 20 AS qb", "ref_idx div 20 AS rb", "query_idx", "ref_idx")
    assert met.select("qb", "rb", "ref_idx").distinct().count() + met.select("qb", "rb", "query_idx").distinct().count() == 80
    assert plan.count() == 40 * 20  # one keypoint on each side: one match for each pair


def test_search_in_place_equals_the_grid(spark):
    rng = np.random.default_rng(9)
    r, q = rng.normal(size=(70, 4)), rng.normal(size=(15, 4))
    r[9] = r[2]
    ref, query = vecs(spark, r).repartition(5), vecs(spark, q, "query")
    want = sorted((x.query_idx, x.rank, x.ref_idx) for x in similarity.topk_similarity(ref, query, 8).collect())
    for most in (1 << 22, 0):
        assert sorted((x.query_idx, x.rank, x.ref_idx) for x in similarity.topk_of_batch(ref, query, 8, most_values=most).collect()) == want
    assert similarity.topk_of_batch(ref, query.limit(0), 8).count() == 0


@pytest.mark.parametrize("cut", [0, 5, 45])
def test_a_log_is_split_at_any_byte(tmp_path, cut):
    """Ranges that end before, at and behind a record's first byte give each whole record once; so does every other length of range."""
    path = tmp_path / "log.bin"
    path.write_bytes(log_bytes(records=7, cut=cut))
    header, record = keypoint_logs.log_types(3, 2)

    def rows(split):
        reader = keypoint_logs.KeypointLogReader({"path": str(path), "split": split})
        return [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(b.column(i).to_pylist() for i in (1, 3)))]

    want = rows(1 << 20)
    assert want == [(f, k) for f in range(7 if not cut else 6 if cut < record.itemsize else 5) for k in range(2)]
    for split in (1, header.itemsize, record.itemsize - 1, record.itemsize, record.itemsize + 1, header.itemsize + record.itemsize, 97):
        assert rows(split) == want


def test_one_log_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "log.bin").write_bytes(log_bytes(records=500))
    df = keypoint_logs.read_keypoint_logs(spark, str(tmp_path / "log.bin"), split=2000)
    assert df.rdd.getNumPartitions() > 5 and df.count() == 1000 and df.select("frame_idx").distinct().count() == 500
    (tmp_path / "none").mkdir()
    assert keypoint_logs.read_keypoint_logs(spark, str(tmp_path / "none")).count() == 0


def test_every_keypoint_has_a_sample(spark):
    cells = spark.createDataFrame([("a", 0, y, x, [float(1 + y), float(1 + x)]) for y in range(3) for x in range(4)], "seq string, frame_idx long, y int, x int, vec array<double>")
    places = [("a", 0, 0, 1.25, 0.5), ("a", 0, 1, -3.0, 0.0), ("a", 0, 2, 3.5, 2.5), ("a", 0, 3, None, 1.0), ("a", 0, 4, 3.0, 2.0), ("b", 7, 0, 1.0, 1.0), ("a", 0, 5, -0.5, 1.0)]
    kps = spark.createDataFrame(places, "seq string, frame_idx long, kp_idx int, x double, y double")
    got = {(r.seq, r.kp_idx): np.array(r.vec) for r in ds.sample_grid(cells, kps).collect()}
    assert set(got) == {(p[0], p[2]) for p in places}
    unit = lambda *v: np.array(v) / np.linalg.norm(v)
    assert np.allclose(got["a", 0], unit(1.5, 2.25)) and np.allclose(got["a", 4], unit(3, 4)) and np.allclose(got["a", 2], unit(3 * 0.25, 4 * 0.25)) and np.allclose(got["a", 5], unit(2, 1))
    assert all((got[k] == [0, 0]).all() for k in (("a", 1), ("a", 3), ("b", 0)))
    assert ds.sample_grid(cells.limit(0), kps, dims=2).where("vec[0] = 0 and vec[1] = 0").count() == len(places) and ds.sample_grid(cells, kps.limit(0)).count() == 0


def test_pooling_needs_few_clusters(spark):
    local = spark.createDataFrame([("a", 0, 0, [1.0, 0.0]), ("a", 0, 1, None), ("a", 1, 0, [0.0, 2.0])], "seq string, frame_idx long, kp_idx int, desc array<double>")
    c = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0])], "cluster int, vec array<double>")
    got = {(r.frame_idx, r.cluster): np.array(r.vec) for r in ds.vlad_pool(local, c).collect()}
    assert set(got) == {(0, 5), (0, 6), (1, 5), (1, 6)} and all(np.allclose(v, 0) for v in got.values())
    assert ds.fit_alpha(local, c).first().alpha == pytest.approx(-np.log(0.01))
    for bad in (c.limit(1), c.limit(0)):
        with pytest.raises(ValueError):
            ds.fit_alpha(local, bad)


def test_a_whitening_for_each_reference(spark):
    rng = np.random.default_rng(8)
    data = {"a": rng.normal(size=(90, 5)) @ rng.normal(size=(5, 5)) + 3, "b": rng.normal(size=(60, 5)) * 7, None: rng.normal(size=(9, 5))}
    rows = [(k, i, [float(x) for x in v]) for k, m in data.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "ref_seq string, frame_idx long, vec array<double>").repartition(5)
    models = ds.fit_whitening_by(df, fan_in=2)
    assert models.count() == 3
    got = {}
    for r in ds.apply_whitening_by(df, models, block=16).collect():
        got.setdefault(r.ref_seq, {})[r.frame_idx] = r.vec
    assert {k: len(v) for k, v in got.items()} == {"a": 90, "b": 60}  # a null key equals no model
    for k in ("a", "b"):
        w = np.array([got[k][i] for i in range(len(data[k]))])
        assert np.allclose(np.cov(w.T), np.eye(5), atol=1e-9)
        one = ds.apply_whitening(vecs(spark, data[k]), ds.fit_whitening(vecs(spark, data[k])))
        assert np.allclose(np.abs(w), np.abs(np.array([r.vec for r in one.orderBy("frame_idx").collect()])), atol=1e-8)
    assert ds.apply_whitening_by(df.limit(0), models).count() == 0


def planted(rng, n, good, noise):
    """Matches of which the first ``good`` follow one homography, with noise, and the others nothing."""
    src = rng.uniform(0, 300, (n, 2))
    a, b, c, e, f, g = rng.normal(size=6) * 0.05
    h = np.array([[1 + a, b, 4], [c, 1 + e, 9], [f / 500, g / 500, 1]])
    p = np.c_[src, np.ones(n)] @ h.T
    dst = p[:, :2] / p[:, 2:] + rng.normal(size=(n, 2)) * noise
    dst[good:] = rng.uniform(0, 300, (n - good, 2))
    return src, dst


def plain_sampling(src, dst, thresh, iterations, seed):
    """What a plain sampler finds: the best of so many four-point homographies, none fitted again."""
    samples = np.argsort(np.random.default_rng(seed).random((iterations, len(src))), axis=1)[:, :4]
    q = np.einsum("nij,mj->nmi", kernels.homographies(src[samples], dst[samples]), np.c_[src, np.ones(len(src))])
    with np.errstate(all="ignore"):
        error = np.hypot(q[..., 0] / q[..., 2] - dst[:, 0], q[..., 1] / q[..., 2] - dst[:, 1])
    return int((error < thresh).sum(axis=1).max(initial=0))


@pytest.mark.parametrize("n,good,noise", [(170, 110, 1.5), (60, 30, 1.0), (20, 14, 1.5), (9, 6, 0.3)])
def test_consensus_finds_what_plain_sampling_finds_and_more(n, good, noise):
    rng = np.random.default_rng(n)
    cases = [planted(rng, n, good, noise) for _ in range(60)]
    ends = np.arange(61) * n
    keys = np.arange(60).astype(np.uint64)
    src, dst = (np.concatenate([c[i] for c in cases]) for i in (0, 1))
    got = kernels.consensus(src, dst, ends, keys)
    plain = np.array([plain_sampling(*c, 5.0, 100, i) for i, c in enumerate(cases)])
    assert (got >= plain - 1).mean() >= 0.98 and got.mean() > plain.mean() and (got >= 0.9 * good).mean() >= 0.9
    # a pair's answer is its own: other pairs of the batch, of other sizes, do not matter
    mixed = [cases[3], tuple(x[:3] for x in cases[0]), tuple(x[: n // 2] for x in cases[7]), cases[5]]
    sizes = np.cumsum([0, *(len(c[0]) for c in mixed)])
    some = kernels.consensus(*(np.concatenate([c[i] for c in mixed]) for i in (0, 1)), sizes, keys[[3, 0, 7, 5]])
    assert some[0] == got[3] and some[3] == got[5] and some[1] == 0
    picks = kernels.four_of(np.array([4, 5, 170]), keys[:3], np.arange(500))
    assert all(len(set(p)) == 4 and max(p) < m for m, item in zip((4, 5, 170), picks.tolist()) for p in item)
    assert abs(picks[2].mean() - 84.5) < 3


def test_depth_stacks_equal_one_map_at_a_time(spark):
    rng = np.random.default_rng(4)
    maps = [(i, h, w, (rng.uniform(0, 5, (h, w)) * (rng.random((h, w)) > 0.2)).ravel().tolist()) for i, (h, w) in enumerate([(20, 30), (14, 25), (20, 30), (20, 30), (14, 25)])] + [(9, 3, 3, None)]
    df = spark.createDataFrame(maps, "frame_idx long, h int, w int, px array<double>")
    small = {r.frame_idx: r for r in rerank.area_downsample(df, (16, 16)).collect()}
    for i, h, w, px in maps[:5]:
        assert np.allclose(np.array(small[i].px).reshape(16, 16), kernels.area_downsample(np.array(px).reshape(h, w), (16, 16))) and small[i].h == 16
    assert small[9].px is None
    pairs = spark.createDataFrame([(i, j, 0.5) for i in range(6) for j in (0, 1, 9)], "query_idx long, ref_idx long, dist double")
    got = {(r.query_idx, r.ref_idx): r.err for r in rerank.depth_errors(pairs, df, df, (16, 16)).collect()}
    assert len(got) == 18
    for (i, j), err in got.items():
        if i == 5 or j == 9:
            assert err is None
        else:
            a, b = (kernels.area_downsample(np.array(maps[k][3]).reshape(maps[k][1:3]), (16, 16))[None] for k in (i, j))
            assert err == pytest.approx(kernels.masked_ssim_errors(a, b)[0], abs=1e-12)
    with pytest.raises(Exception, match="unequal shapes"):
        rerank.depth_errors(pairs, df, df, None).collect()


def test_balls_give_the_rows_of_the_grid_and_compare_less_as_tables_grow(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    shares = []
    for n in (400, 3200):
        make = lambda m: centres[rng.integers(0, 40, m)] + rng.normal(size=(m, 16)) * 0.08  # noqa: E731, B023
        r, q = make(n), make(60)
        r[5], q[3], r[9] = 0, 0, r[8]  # vectors of zeros, and a tie
        ref, query = vecs(spark, r).repartition(3), vecs(spark, q, "query")
        index = similarity.BlockIndex(ref, str(tmp_path / f"index{n}"), block=n // 40, balls=n // 10)
        got, report = similarity.topk_by_balls(index, query, str(tmp_path / f"met{n}"), 5)
        rows = lambda df: sorted((x.query_idx, x.rank, x.ref_idx, round(x.dist, 9)) for x in df.collect())
        assert rows(got) == rows(similarity.topk_similarity(ref, query, 5))
        met = report.first()
        shares.append(met["compared"] / met["all"])
    assert shares[1] < shares[0] < 0.5
    tiny = similarity.BlockIndex(vecs(spark, r[:3]), str(tmp_path / "tiny"))
    got, _ = similarity.topk_by_balls(tiny, query, str(tmp_path / "met"), 5)
    assert got.count() == 60 * 3
    nothing, _ = similarity.topk_by_balls(tiny, query.limit(0), str(tmp_path / "none"), 5)
    assert nothing.count() == 0
