"""Nearest neighbours: recall against brute force, exact scores, ties and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evplace.llm import ann


def brute(rows, queries, k):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], dtype=np.float64)
    out = {}
    for q, x in queries:
        d = np.sqrt(((v - np.array(x, dtype=np.float64)) ** 2).sum(axis=1))
        out[q] = sorted((d[i], int(ids[i])) for i in range(len(ids)) if ids[i] != q)[:k]
    return out


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.9), ("sf0.1", 0.9)])
def test_recall_on_the_table(spark, sf, least):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got: dict = {}
    for r in ann.op4_nearest_neighbours(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11))
        hits += len({v for *_, v in found} & {v for _, v in want[q]})
        exact = dict((v, s) for s, v in brute(rows, [x for x in rows if x[0] == q], len(rows))[q]) if q == 0 else None
        if exact:
            assert all(abs(exact[v] - s) < 1e-12 for _, s, v in found)
    assert hits / (10 * len(want)) >= least


def recall(df, k=10):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, rows, k)
    hits = sum(r.vec_id in {v for _, v in want[r.query_id]} for r in ann.nearest(df, df, k).collect())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_every_row(spark, sf):
    got = recall(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"))
    print(sf, got)
    assert got > 0.95


def test_unequal_lengths(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 64)) * rng.lognormal(0, 1, (600, 1))
    v[:300] = v[300:] * rng.uniform(0.2, 1, (300, 1))  # rows of the same direction, but apart
    assert recall(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")) > 0.95


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(i, [float(x) for x in rng.normal(size=5)]) for i in range(100, 130)] + [(1000, [1.0] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, df, 5, probe=10_000).collect()}
    want = set()
    for n in (8, 5):
        own = [r for r in rows if len(r[1]) == n]
        want |= {(q, i + 1, v) for q, near in brute(own, own, 5).items() for i, (_, v) in enumerate(near)}
    assert got == want


def test_share_of_rows_met_falls():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(2000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    share = []
    for n in (500, 10_000, 1_000_000, 10**10):
        axes = ann.rotations(n, 64)
        share.append(ann.probe_count(axes) / np.prod([2.0 * a for a in axes]))
        p, b = ann.probes(unit[:50], 3, axes, ann.probe_count(axes)), ann.buckets(unit[:50], 3, axes)
        assert (p[:, 0] == b).all() and all(len(set(x)) == len(x) for x in p.tolist())
    assert share == sorted(share, reverse=True) and share[0] > 5 * share[2]


def test_hard_cases(spark):
    rng = np.random.default_rng(2)
    same = [float(x) for x in rng.normal(size=6)]
    rows = [(i, same) for i in range(0, 400)] + [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400, 480)]
    bad = [(500, None), (600, []), (700, [0.0] * 6), (800, [1.0, None] + [0.0] * 4), (900, [float("nan")] * 6), (1000, [float("inf")] + [0.0] * 5), (1100, [1.0]), (1101, [2.0] * 9), (None, same)]
    df = spark.createDataFrame(rows + bad + [(5, same)], "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("id", "v", "t", "b", "part", "rank", "score")])
    got = ann.nearest(df, df.where("vec_id % 100 = 0"), block=50).collect()
    queries = [r for r in rows if r[0] % 100 == 0]
    want = brute(rows, queries, 10)
    for q, x in queries[:4]:  # ties of equal vectors go to the smallest ids
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [v for _, v in mine] == [v for _, v in want[q]]
    assert {r.query_id for r in got} == {q for q, _ in queries}
    few = spark.createDataFrame(rows[398:403], "vec_id long, embedding array<double>")
    got = ann.nearest(few, few.where("vec_id = 400")).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(i + 1, v) for i, (_, v) in enumerate(brute(rows[398:403], [rows[400]], 10)[400])]
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []
    assert ann.nearest(df, df.limit(0)).collect() == []
