"""Near-duplicates and components against brute force, ties, crowds and hard cases."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evplace.llm import components, neardup


def brute(rows, shingle, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        common = Counter(j for g in s for j in by[g] if j < i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {(i, len(s), top(i), top(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_equals_brute_force_on_the_table(spark, shingle, percent):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = {tuple(r) for r in neardup.near_duplicates(df, shingle=shingle, percent=percent).collect()}
    want = brute(rows, shingle, percent)
    assert got == want and sum(not k for *_, k in want) > 20


def test_crowds_and_hard_cases(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(900):  # a crowd of near copies, far above the region's size below
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = rng.choice(words)
        rows.append((i * 3, " ".join(w)))
    rows += [(10_000 + i, " ".join(base)) for i in range(300)]
    rows += [(20_000, None), (20_001, ""), (20_002, " \n\t"), (20_003, "A b"), (20_004, "a B"), (20_005, "a b c"), (20_006, "x " * 20_000), (20_007, "  É")]
    rows += [(30_000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("id", "n", "rep", "a", "b", "key", "region")])
    got = {tuple(r) for r in neardup.near_duplicates(df, shingle=3, percent=85, region=40, block=100).collect()}
    assert got == brute(rows, 3, 85)
    assert neardup.near_duplicates(df.limit(0)).collect() == []
    twice = df.where("doc_id >= 20000").select("doc_id", "text")
    twice = twice.unionByName(twice).unionByName(spark.createDataFrame([(None, "a b")], "doc_id long, text string"))
    assert {tuple(r) for r in neardup.near_duplicates(twice, shingle=3, percent=85).collect()} == brute([r for r in rows if r[0] >= 20_000], 3, 85)


def brute_rows(rows, shingle, percent):
    """brute() over rows that repeat ids: an id is linked with what any of its rows is linked with."""
    one = brute([(k, t) for k, (_, t) in enumerate(rows)], shingle, percent)
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for k, _, c, _ in one:
        a, b = sorted((top(("row", c)), top(("id", rows[k][0]))))
        up[b] = a
    least, size = {}, {}
    for k, n, _, _ in one:
        i = rows[k][0]
        least[top(("id", i))] = min(least.get(top(("id", i)), i), i)
        size[i] = max(size.get(i, 0), n)
    return {(i, size[i], least[top(("id", i))], least[top(("id", i))] == i) for i, _ in rows}


def test_repeated_ids_in_any_order(spark):
    rng = random.Random(3)
    word = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(n)]
    a, b, c = word(60), word(60), word(60)
    near = lambda w: " ".join(["zz"] + w[1:])
    rows = [(3, " ".join(b)), (5, " ".join(a)), (5, " ".join(b)), (9, near(a)), (9, None), (2, ""), (11, near(c)), (12, " ".join(c)), (12, "short"), (7, "short"), (7, None), (20, " ".join(word(50))), (20, " ".join(word(50)))]
    want = brute_rows(rows, 3, 85)
    assert {i for i, _, c, _ in want if c == 3} == {3, 5, 9} and {i for i, _, c, _ in want if c == 7} == {7, 11, 12}
    for turn in range(3):
        rng.shuffle(rows)
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + turn), shingle=3, percent=85)
        assert {tuple(r) for r in got.collect()} == want


def test_large_families_that_fall_apart(spark):
    """Families whose candidates join what no link joins, in blocks smaller than any of them."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    rows, families = [], []
    for g, (size, n) in enumerate(((150, 70), (45, 70), (9, 60), (1, 60), (1, 50))):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(size):
            w = list(base)
            w[rng.randrange(n)] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
            families.append((rows[-1][0], 0))
    df = spark.createDataFrame(rows, "id long, text string")
    links = neardup.family_links(df, spark.createDataFrame(families, "id long, component long"), 3, 85, block=20)
    label = {r.id: r.component for r in components.components(links, "a", "b").collect()}
    assert {(i, label.get(i, i)) for i, _ in rows} == {(i, c) for i, _, c, _ in brute(rows, 3, 85)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7, 8), (8, 7)] + [(2000, 2001 + i) for i in range(300)]
    edges += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(220)]
    up = {i: i for i in itertools.chain.from_iterable(edges)}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    linked = {i for a, b in edges if a != b for i in (a, b)}
    got = [tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()]
    assert sorted(got) == sorted((i, top(i)) for i in linked)
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
