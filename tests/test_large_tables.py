"""Operators whose work or memory grew faster than their input: results on the cases that larger tables bring, and what is shipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evplace.functions import nearest
from evplace.operators import evaluate, rerank, similarity
from evplace.plans import fixtures as fx
from evplace.plans import registry
from tests.test_matching import packs_of, vecs


@pytest.mark.parametrize("metric", nearest.METRICS)
@pytest.mark.parametrize("kind", ["plain", "copies", "odd", "far", "tiny", "few"])
def test_nearest_equals_measuring_all(metric, kind):
    rng = np.random.default_rng(3)
    r, q = rng.normal(size=(9000, 6)), rng.normal(size=(140, 6))
    if kind == "copies":
        r[8500:8700], r[7], q[5] = r[:200], 0, 0
    if kind == "odd":
        r[3, 2], q[4, 1], r[9] = np.nan, np.inf, r[9] * 1e30
    if kind in ("far", "tiny"):
        r, q = (r + 1e6, q + 1e6) if kind == "far" else (r * 1e-9, q * 1e-9)
    r = r[:9] if kind == "few" else r
    ids = rng.permutation(len(r)) * 3
    best = nearest.Nearest(q, 12, metric)
    for at in range(0, len(r), 4000):
        best.add(r[at : at + 4000], ids[at : at + 4000])
    i, found, d = best.rows()
    with np.errstate(all="ignore"):
        every = np.stack([nearest.measured(np.repeat(v[None], len(r), 0), r, metric) for v in q])
    order = np.stack([np.lexsort((ids, x))[:12] for x in every])
    assert (found.reshape(order.shape) == ids[order]).all() and np.array_equal(d.reshape(order.shape), np.take_along_axis(every, order, 1), equal_nan=True)
    assert (i == np.repeat(np.arange(len(q)), order.shape[1])).all()


@pytest.mark.parametrize("metric", nearest.METRICS)
def test_few_pairs_are_measured_in_double(metric, monkeypatch):
    """The first limit is near the k-th distance of the whole tile, so little more than what is given out is measured."""
    rng, pairs, own = np.random.default_rng(5), [], nearest.measured
    monkeypatch.setattr(nearest, "measured", lambda q, r, m: pairs.append(len(q)) or own(q, r, m))
    best = nearest.Nearest(rng.normal(size=(130, 16)), 50, metric)
    best.add(rng.normal(size=(nearest.TILE, 16)), np.arange(nearest.TILE))
    assert len(best.rows()[0]) == 130 * 50 and sum(pairs) < 130 * 50 * 1.5


def test_searched_blocks_are_dealt_by_their_number(spark):
    """Not by their bytes, by which Spark would join them to few tasks."""
    rng = np.random.default_rng(6)
    found = similarity.nearest_blocks(vecs(spark, rng.normal(size=(40, 4))), vecs(spark, rng.normal(size=(40, 4)), "query"), 3, block=10)
    tasks = similarity.APART * 16
    assert found.count() == 120 and found._jdf.queryExecution().toString().count(f", {tasks}), REPARTITION_BY_NUM") >= 2


def test_blocks_of_the_grid_grow_with_the_table(spark):
    assert similarity._grid(spark.range(0), 500, 500, 64, 128) == (4, 4)
    shipped = []
    for n in (50_000, 300_000):
        rb, qb = similarity._grid(spark.range(0), n, n, 64, 128)
        assert rb * qb <= 100 and -(-n // rb) * 64 <= similarity.VALUES
        shipped.append((rb + qb) * n)
    assert shipped[1] <= 6 * shipped[0]
    rb, qb = similarity._grid(spark.range(0), 300_000, 1000, 8192, 4096)
    assert -(-300_000 // rb) * 8192 <= similarity.VALUES + 8192


@pytest.mark.parametrize("metric", nearest.METRICS)
def test_copies_tie_exactly_in_all_pairs(spark, metric):
    rng = np.random.default_rng(4)
    r, q = rng.normal(size=(61, 7)), rng.normal(size=(9, 7))
    r[31:61] = r[0:30]
    got = {(x.query_idx, x.ref_idx): x.dist for x in similarity.pairwise_distance(vecs(spark, r), vecs(spark, q, "query"), metric).collect()}
    assert len(got) == 61 * 9 and all(got[i, j] == got[i, j + 31] for i in range(9) for j in range(30))


def test_a_query_is_shipped_to_a_cell_once_however_many_balls_it_needs_there(spark, tmp_path, monkeypatch):
    """Vectors without clusters, of which every query needs nearly all balls."""
    monkeypatch.setattr(similarity, "CELLS", 4)
    rng = np.random.default_rng(5)
    ref, query = vecs(spark, rng.normal(size=(600, 24))), vecs(spark, rng.normal(size=(200, 24)), "query")
    index = similarity.BlockIndex(ref, str(tmp_path / "index"), block=8)
    got, report = similarity.topk_by_balls(index, query, str(tmp_path / "met"), 9)
    rows = lambda df: sorted((x.query_idx, x.rank, x.ref_idx, round(x.dist, 9)) for x in df.collect())
    assert rows(got) == rows(similarity.topk_similarity(ref, query, 9))
    rb, qb = similarity._grid(query, 600, 200, 24, 8)
    assert rb * qb <= 4 * max(4, spark.sparkContext.defaultParallelism) + 8 and report.first()["compared"] > 20 * 200 * rb


def test_a_task_holds_k_rows_of_each_query_in_place(spark):
    best = nearest.Nearest(np.zeros((4, 3)), 5)
    for at in range(50):
        best.add(np.ones((100, 3)), np.arange(100) + 100 * at)
    assert best.d.shape == best.ids.shape == (4, 5) and best.rows()[1].tolist() == [0, 1, 2, 3, 4] * 4
    ref = spark.range(9000).select(F.col("id").alias("frame_idx"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    got = similarity.nearest_in_place(ref, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], 3)
    assert sorted((x.query_idx, x.ref_idx) for x in got.collect()) == [(q, r) for q in (1, 2) for r in range(3)]


@pytest.mark.parametrize("tol", [0, 1, 3])
def test_classes_give_the_recall_of_their_pairs(spark, tol):
    """Classes are never multiplied out: no join of the plan has more rows than the shortlist's and the frames' (2 * tol + 1) labels."""
    rng = np.random.default_rng(6)
    label = lambda: [None if x == 0 else int(x) for x in rng.integers(0, 9 * (1 + tol) ** 2, 40)]
    refs = spark.createDataFrame([(i, x if x != 5 else None) for i, x in enumerate(label())], "ref_idx long, label int")
    queries = spark.createDataFrame(list(enumerate(label())), "query_idx long, label int")
    ranked = spark.createDataFrame([(q, int(r), float(i)) for q in range(36) for i, r in enumerate(rng.permutation(40)[:12])], "query_idx long, ref_idx long, dist double")
    pairs = refs.join(queries, "label").select("ref_idx", "query_idx")
    recall = lambda gt: {x.k: round(x.recall, 12) for x in evaluate.recall_at_k(ranked, gt, (1, 2, 5), tol=tol).collect()}
    assert recall(evaluate.ClassTruth(refs, queries)) == recall(pairs) and recall(pairs)[1] < recall(pairs)[5]


@pytest.mark.parametrize("tol,tile", [(1, 4), (2, 4), (3, 5), (5, 1024)])
def test_boxes_are_widened_tile_by_tile(spark, monkeypatch, tol, tile):
    monkeypatch.setattr(evaluate, "TILE", tile)
    pairs = [(0, 0), (3, 4), (4, 3), (7, 18), (19, 0), (8, 8), (8, 8), (12, 11), (23, 5), (-2, 3)]
    want = {(r + a, q + b) for r, q in pairs for a in range(-tol, tol + 1) for b in range(-tol, tol + 1) if 0 <= r + a < 20 and 0 <= q + b < 19}
    gt = spark.createDataFrame(pairs, "ref_idx long, query_idx long")
    got = [tuple(x) for x in evaluate.dilate_gt(gt, tol, 20, 19).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = evaluate.dilate_gt(gt, tol, 20, 19)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # boxes are not shuffled to tell their cells apart


def test_pairs_of_a_label_are_dealt(spark):
    """All pairs of a label are not one task's: ten labels have more than ten groups."""
    plan = fx.gt(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "share" in plan
    d = fx.descriptors(spark, "/root/testdata/sf0.001")
    n = {(x.seq, x.label): x["count"] for x in d.groupBy("seq", "label").count().collect()}
    assert fx.gt(spark, "/root/testdata/sf0.001").distinct().count() == sum(m * n.get(("query", k[1]), 0) for k, m in n.items() if k[0] == "ref")


def test_pairs_are_rounded_where_they_are_made_and_dealt_to_many_tasks(spark, monkeypatch):
    """No column is rounded row by row, and small inputs do not bring all blocks to a few tasks."""
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 7)
    rng = np.random.default_rng(14)
    ref, query = vecs(spark, rng.normal(size=(30, 5))), vecs(spark, rng.normal(size=(20, 5)), "query")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    for name, of in [("sim", similarity.similarity_pairs)] + [("dist", lambda r, q, digits=None, m=m: similarity.pairwise_distance(r, q, m, digits=digits)) for m in nearest.METRICS]:
        got = of(ref, query, digits=6)
        assert got.rdd.getNumPartitions() == 15
        assert rows(got) == rows(of(ref, query).withColumn(name, F.round(name, 6)))
    x = np.array([0.1234565, -0.1234565, -1e-9, 2.5e-7, np.inf, -np.inf, 7.0])
    y = similarity.rounded(x, 6)
    assert y.tolist() == [0.123457, -0.123457, 0.0, 0.0, np.inf, -np.inf, 7.0] and not np.signbit(y[2]) and np.isnan(similarity.rounded(np.array([np.nan]), 6)[0])


@pytest.mark.parametrize("fill", ["base", "inf"])
def test_all_pairs_with_new_distances_need_no_join_of_pairs(spark, monkeypatch, fill):
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 7)
    rng = np.random.default_rng(8)
    ref, query = vecs(spark, rng.normal(size=(30, 5))), vecs(spark, rng.normal(size=(20, 5)), "query")
    new = spark.createDataFrame([(q, q + 3, float(q) / 7) for q in range(20)] + [(4, 1, 0.25), (5, 1, None), (99, 1, 0.5), (1, 99, 0.5)], "query_idx long, ref_idx long, new_dist double")
    pairs = similarity.similarity_pairs(ref, query).withColumn("dist", 1 - F.col("sim"))
    rows = lambda df: sorted((x.query_idx, x.ref_idx, round(x.new_dist, 9)) for x in df.collect())
    got = rerank.full_columns(ref, query, new, fill)
    assert rows(got) == rows(rerank.full_column(pairs, new, fill)) and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_the_best_of_batches_hold_the_shortlist(spark):
    rng = np.random.default_rng(9)
    pairs = spark.createDataFrame([(int(q), int(r), float(d)) for q, r, d in zip(rng.integers(0, 6, 3000), range(3000), rng.integers(0, 60, 3000))], "query_idx long, ref_idx long, dist double").repartition(3)
    rows = lambda df: sorted(tuple(x) for x in similarity.shortlist_from_pairs(df, 9).select("query_idx", "rank", "ref_idx", "dist").collect())
    few = similarity.best_of_batches(pairs, 9)
    assert rows(few) == rows(pairs) and few.count() <= 3 * 6 * 9


def test_candidates_anywhere_do_not_make_a_block_for_each_pair(spark, monkeypatch):
    """4,000 query frames with two candidates each, anywhere among 4,000: blocks of 16 and 128 would hold about a pair each."""
    rng = np.random.default_rng(10)
    packs = packs_of(spark, [(i, [(0, 0.0, 0.0, [float(i), 1.0])]) for i in range(4000)])
    pairs = spark.createDataFrame([(i, int(j)) for i in range(4000) for j in rng.choice(4000, 2, replace=False)], "query_idx long, ref_idx long")
    seen, floor = [], F.floor
    monkeypatch.setattr(rerank.F, "floor", lambda c: seen.append(str(c)) or floor(c))
    assert rerank.match_shortlist(pairs, packs, packs).count() == 8000
    assert any("240" in c for c in seen) and any("1920" in c for c in seen), seen
    seen.clear()
    monkeypatch.setattr(rerank, "HELD", 1)
    assert rerank.match_shortlist(pairs.limit(50), packs, packs).count() == 50
    assert any(", 16)" in c for c in seen) and any(", 128)" in c for c in seen), seen


def test_packs_of_registered_queries_are_made_once(spark, monkeypatch):
    sf, given = "/root/testdata/sf0.001", []
    match = rerank.match_shortlist
    monkeypatch.setattr(rerank, "match_shortlist", lambda base, r, q, kind: given.extend([r, q]) or match(base, r, q, kind))
    base = registry.kept(registry.shortlist(spark, sf, 10), "shortlist")
    for kind in ("mutual", "ratio"):
        got = registry.matches(spark, sf, kind, base).collect()
        assert got and sorted(got) == sorted(match(base, *(registry.packs(spark, sf, seq) for seq in ("ref", "query")), kind).collect())
    # written tables, which hold keypoints as they are matched, not plans that would make them at each reading
    assert len(given) == 4 and all(dict(x.dtypes)["kps"] == "binary" and x.inputFiles() and not any("embeddings" in f for f in x.inputFiles()) for x in given)


def test_blocks_of_all_pairs_grow_and_equal_values_lie_together(spark, monkeypatch):
    """A row is not shipped once for each PAIR_BLOCK rows of the other side, and what is given out folds in files."""
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 2)
    rng = np.random.default_rng(17)
    r, q = rng.normal(size=(90, 4)), rng.normal(size=(70, 4))
    ref, query = vecs(spark, r), vecs(spark, q, "query")
    grids, dealt = [], similarity._dealt
    monkeypatch.setattr(similarity, "_dealt", lambda ref, query, rb, qb: grids.append(rb * qb) or dealt(ref, query, rb, qb))
    got = similarity.pairwise_distance(ref, query, "euclidean", 2)
    assert grids[0] <= 64 + 16  # 45 x 35 before
    want = {(i, j): d for j, row in enumerate(similarity.rounded(nearest.between(q, r, "euclidean"), 2)) for i, d in enumerate(row)}
    tasks = [[tuple(x) for x in t] for t in got.rdd.glom().collect()]
    rows = [x for t in tasks for x in t]
    assert len(rows) == 90 * 70 and {(x[0], x[1]): x[2] for x in rows} == want
    # in the order of their values, block after block
    assert sum(a[2] > b[2] for t in tasks for a, b in zip(t, t[1:])) <= grids[0]


@pytest.mark.parametrize("far", [1e12, np.inf, np.nan])
def test_values_that_no_order_holds_are_given_out_all_the_same(spark, monkeypatch, far):
    monkeypatch.setattr(similarity, "SIDE", 9)
    monkeypatch.setattr(similarity, "NARROW", 4)
    monkeypatch.setattr(similarity, "MADE", 20)
    monkeypatch.setattr(similarity, "HANDED", 10)
    rng = np.random.default_rng(18)
    r, q = rng.normal(size=(50, 4)), rng.normal(size=(21, 4))
    r[7, 2] = far
    got = [tuple(x) for x in similarity.pairwise_distance(vecs(spark, r), vecs(spark, q, "query"), "cityblock", 6).collect()]
    want = similarity.rounded(nearest.between(q, r, "cityblock"), 6)
    assert len(got) == 50 * 21 == len({x[:2] for x in got}) and np.array_equal([want[j, i] for i, j, _ in got], [x[2] for x in got], equal_nan=True)


def test_an_infinite_column_ships_no_vectors_and_keeps_rows_of_one_frame(spark, monkeypatch):
    """Frames twice on either side, new distances in several pieces of a block."""
    monkeypatch.setattr(similarity, "NARROW", 4)
    monkeypatch.setattr(similarity, "MADE", 20)
    rng = np.random.default_rng(19)
    both = lambda n, seq: vecs(spark, rng.normal(size=(n, 3)), seq).unionByName(vecs(spark, rng.normal(size=(2, 3)), seq))
    ref, query = both(23, "ref"), both(17, "query")
    new = spark.createDataFrame([(i, (5 * i) % 23, i / 7) for i in range(17)] + [(1, 0, 0.1234565)], "query_idx long, ref_idx long, new_dist double")
    known = {(x.query_idx, x.ref_idx): x.new_dist for x in new.collect()}
    frames = lambda n: [*range(n), 0, 1]
    want = sorted((i, j, float(similarity.rounded(np.array([known.get((i, j), np.inf)]), 6)[0])) for i in frames(17) for j in frames(23))
    sides, dealt = [], similarity._dealt
    monkeypatch.setattr(similarity, "_dealt", lambda ref, query, rb, qb: sides.extend([ref, query]) or dealt(ref, query, rb, qb))
    got = rerank.full_columns(ref, query, new, "inf", 6)
    assert sorted(tuple(x) for x in got.collect()) == want
    assert len(sides) == 2 and not any(x.where("vec is not null").count() for x in sides)


def test_a_shortlist_from_pairs_makes_no_table_of_all_pairs(spark, monkeypatch):
    """Blocks give out what can be among the k nearest of a query, and all of it: ties at the k-th distance too."""
    rng = np.random.default_rng(15)
    r, q = rng.normal(size=(70, 5)), rng.normal(size=(30, 5))
    r[40:70] = r[0:30]
    ref, query = vecs(spark, r), vecs(spark, q, "query")
    few = similarity.nearest_pairs(ref, query, 4, block=35)
    rows = lambda df: sorted((x.query_idx, x.rank, x.ref_idx, round(x.dist, 9)) for x in similarity.shortlist_from_pairs(df, 4).collect())
    assert rows(few) == rows(similarity.similarity_pairs(ref, query).withColumn("dist", 1 - F.col("sim"))) and few.count() <= 2 * 30 * 4
    monkeypatch.setattr(similarity, "all_pairs", None)
    assert registry.QUERIES["shortlist_from_pairs"](spark, "/root/testdata/sf0.001").count() == 250 * 50


@pytest.mark.parametrize("tol,tile,labels", [(0, 4, 3), (1, 4, 3), (2, 5, 40), (3, 1024, 6), (9, 4, 30)])
def test_boxes_around_classes_are_widened_without_their_pairs(spark, monkeypatch, tol, tile, labels):
    """Frames without a label, of several labels, off the matrix; more tiles than one within a block, too."""
    monkeypatch.setattr(evaluate, "TILE", tile)
    monkeypatch.setattr(evaluate, "MADE", 8)
    rng = np.random.default_rng(16)
    side = lambda n: [(i, None if x == 0 else f"l{x}") for i, x in enumerate(rng.integers(0, labels, n))] + [(3, "l1"), (n + 1, "l2"), (-2, "l1")]
    r, q = side(43), side(37)
    pairs = [(a, b) for a, x in r for b, y in q if x is not None and x == y]
    want = {(a + i, b + j) for a, b in pairs for i in range(-tol, tol + 1) for j in range(-tol, tol + 1) if 0 <= a + i < 41 and 0 <= b + j < 37}
    gt = evaluate.ClassTruth(spark.createDataFrame(r, "ref_idx long, label string"), spark.createDataFrame(q, "query_idx long, label string"))
    got = [tuple(x) for x in evaluate.dilate_gt(gt, tol, 41, 37).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if tol:
        assert want == {tuple(x) for x in evaluate.dilate_gt(spark.createDataFrame(pairs, "ref_idx long, query_idx long"), tol, 41, 37).collect()}
    assert not evaluate.dilate_gt(gt, tol, 0, 37).collect()
    plan = evaluate.dilate_gt(gt, tol, 41, 37)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
