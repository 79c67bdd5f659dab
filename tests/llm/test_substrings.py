"""Repeated windows against brute force; the FM-index against counting."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evplace.llm import fm_index, substrings


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    at = defaultdict(list)
    for r, (_, w) in enumerate(words):
        for s in range(len(w) - window + 1):
            at[tuple(w[s : s + window])].append((r, s))
    gone = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for r, s in places:
                gone[r] |= set(range(s, s + window))
    return sorted(((i, len(w), len(gone[r]), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone[r])).hexdigest()) for r, (i, w) in enumerate(words)), key=str)


def test_fm_index_counts(spark):
    rng = np.random.default_rng(3)
    text = rng.integers(1, 6, 700)
    fm = fm_index.FMIndex(np.append(text, 0), 6, 9)
    for n in range(1, 9):
        for at in rng.integers(0, 690, 20):
            p = text[at : at + n]
            lo, hi = np.array([0]), np.array([fm.n])
            for c in p[::-1]:
                lo, hi = fm.step(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == sum((text[i : i + n] == p).all() for i in range(700 - n + 1))


@pytest.mark.parametrize("crowd", [substrings.CROWD, 1])
def test_equals_brute_force_on_the_table(spark, crowd):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substrings.removed_words(df, crowd=crowd, shard=300).collect()), key=str)
    want = brute(rows, 35)
    assert got == want and sum(0 < r[2] < r[1] for r in want) > 20


@pytest.mark.parametrize("crowd", [400, 5])
def test_hard_cases(spark, crowd):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)] + ["é\u0085x"]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    common, line = make(60), make(12)
    rows = [(i, " ".join(make(rng.randrange(1, 80)) + common + make(rng.randrange(80)))) for i in range(60)]
    rows += [(100 + i, " ".join(make(20) + line + make(20))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, " ".join(common)), (203, "\t".join(common)), (None, " ".join(common[:34])), (None, " ".join(common[:34]))]
    rows += [(300, "x " * 20_000), (301, " ".join(make(50) * 3)), (302, "| " * 36), (303, " ".join(common[:36])), (304, " ".join((common + common)[20:90]))]
    edited = make(300)
    for i in range(40):
        w = list(edited)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(300)] = "edit%d" % rng.randrange(10**6)
        rows.append((400 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("id", "n", "sha", "occ", "m", "h", "s", "e")])
    got = sorted((tuple(r) for r in substrings.removed_words(df, crowd=crowd, shard=50).collect()), key=str)
    assert got == brute(rows, 35)
    assert substrings.removed_words(df.limit(0)).collect() == []
