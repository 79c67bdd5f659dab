"""LM scores: the base against brute force, the model's sum to one, held-out gain, hard cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evplace.llm import lm


def brute(rows):
    words = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, ws in words if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words), key=str)


def test_base_and_held_out_gain(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = lm.scored(df, held=5000).collect()  # so that many words meet their counts in the join
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.985 * sum(r.base_score for r in held) and sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def test_probabilities_sum_to_one():
    words = [b"w%d" % i for i in range(1500)] + [lm.END]
    counts = np.sort(np.random.default_rng(0).integers(1, 500, len(words)))[::-1]
    n, v = int(counts.sum()) + 700, len(words) + 300  # 300 more words, of 700 tokens, aren't held
    model = lm.Model(lm.Vocabulary(words, counts, n, v))
    rng = np.random.default_rng(1)
    model.of_class = rng.normal(size=model.of_class.shape).astype(np.float32)
    model.of_word = rng.normal(size=model.of_word.shape).astype(np.float32)
    f = np.repeat(rng.integers(0, 1 << 32, (1, lm.FEATURES)).astype(np.uint64), len(words) + 1, axis=0)
    p = 10 ** model.log10(np.append(np.arange(len(words)), -1), f)
    assert abs(p.sum() - 1) < 1e-4
    # the last class's share is spread over the other words, (c + 1) each, and the unknown one
    assert abs((700 + 300 + 1) - model.v.rare_mass) < 1e-6


def test_scores_equal_brute_force(spark, monkeypatch):
    """Every token's probability from the trained weights, one token and one feature at a time."""
    rng = np.random.default_rng(4)
    zipf = lambda n: " ".join(f"w{int(x) % 4000}" for x in rng.zipf(1.15, n))
    rows = [(i, zipf(int(rng.integers(1, 300)))) for i in range(250)] + [(900, None), (901, "unseen words")]
    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **k: kept.setdefault("model", train(*a, **k)))
    got = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), held=2500).collect()}
    m = kept["model"]
    c = Counter(w for i, t in rows if not got[i].held_out for w in lm.tokens(t))
    n, v = sum(c.values()), len(c)
    assert m.of_class.any() and m.of_word.any() and m.v.head == 1024 and len(m.v.rank) > 1024
    mask = (1 << 64) - 1
    for i, t in rows:
        words, total = lm.tokens(t), 0.0
        for k, w in enumerate(words):
            a, b, d = ((zlib.crc32(words[k - j]) + 1 if k >= j else 0) for j in (1, 2, 3))
            keys = [0, a * 5 + 1, (a * 0xC2B2AE3D27D4EB4F + b) * 5 + 2, b * 5 + 3, d * 5 + 4]
            f = [((x & mask) * 0x9E3779B97F4A7C15 & mask) >> 32 for x in keys]
            rank = m.v.rank.get(w)
            cls = m.v.rare if rank is None else int(m.v.cls[rank])
            z = m.v.priors.astype(float) + sum(m.of_class[x % len(m.of_class)].astype(float) for x in f)
            total += (z[cls] - np.log(np.exp(z - z.max()).sum()) - z.max()) / np.log(10)
            if rank is None:  # shared by count among all words that are not held, and one unknown
                rest = sum(x + 1 for y, x in c.items() if y not in m.v.rank) + 1
                total += math.log10((c[w] + 1) / rest)
            elif rank >= 1024:
                band = sum(x + 1 for y, x in c.items() if y in m.v.rank and m.v.cls[m.v.rank[y]] == cls)
                total += math.log10((c[w] + 1) / band)
            else:
                at = [((x + cls * 0x632BE5AB & mask) * 0x85EBCA6B & mask) >> 7 for x in f]
                z = m.v.word_prior[cls].astype(float) + sum(m.of_word[x % len(m.of_word)].astype(float) for x in at)
                total += (z[rank % 32] - np.log(np.exp(z - z.max()).sum()) - z.max()) / np.log(10)
        assert abs(got[i].score - total) < 1e-4 * max(1, abs(total)), (i, got[i].score, total)
    assert n == got[900].train_tokens and v == m.v.v


def test_frequent_words_have_weights():
    words = [b"w%d" % i for i in range(3000)]
    v = lm.Vocabulary(words, np.arange(3000, 0, -1), 4_501_500, 3000)
    assert v.head >= 1024 and len(set(v.cls[:1024].tolist())) == 32
    f = lm._features(v.context[:20], np.zeros(20, np.int64))
    assert len({int(x) for x in f[:, 0]}) == 1  # one feature that all tokens share


def test_tables_grow_with_contexts(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 200))) for i in range(60)], "id long, text string")
    few, all_ = (lm.COUNTED * lm.word_counts(x).where("feature is not null").count() for x in (df.where("id < 5"), df))
    exact = len({int(x) for r in df.collect() for x in lm._features(np.array([zlib.crc32(w) for w in lm.tokens(r.text)]), np.zeros(201, np.int64)).ravel()})
    assert few < all_ and abs(all_ - exact) < 0.3 * exact
    assert lm.table_rows(few) < lm.table_rows(all_) and lm.table_rows(all_)[0] >= exact
    words = [b"first", b"worst"] * 600  # ends alike, rarer than words with weights of their own
    context = lm.Vocabulary(words, np.full(1200, 3), 3600, 1200).context
    assert context[1198] != context[1199]


def test_hard_cases(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "null id"), (2, None), (3, ""), (4, "É \u0085 x\x00y"), (5, "word " * 20_000), (6, "A B C")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("id", "word", "c", "row", "model")])
    got = lm.scored(df, held=2).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.scored(df.limit(0)).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = lm.scored(spark.createDataFrame([(only, "no training text")], "doc_id long, text string")).collect()
    assert alone[0].train_tokens == 0 and alone[0].base_score == 0 and math.isfinite(alone[0].score)


def test_softmax_of_rows_of_any_size():
    z = np.random.default_rng(1).normal(size=(50, 41)).astype(np.float32) * 5
    z[3] += 300
    z[4] -= 300
    z[5, 7] = 95
    wide = z.astype(np.float64)
    wide = np.exp(wide - wide.max(axis=1, keepdims=True))
    assert np.allclose(lm._softmax(z), wide / wide.sum(axis=1, keepdims=True), rtol=1e-4, atol=1e-12)


def test_features_are_counted_until_tables_are_as_large_as_they_get(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 90_000, 250_000)) for _ in range(3)]
    assert all(len(t) > 1_500_000 for t in texts)
    found = lm.word_counts(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)).where("feature is not null").count()
    # all three texts have some 3,000,000 features, of which one in COUNTED is some 11,700
    assert lm.table_rows(lm.COUNTED * found) == lm.MOST_ROWS and found < 6_000


def test_words_are_looked_up_once_however_often_they_occur():
    class Asked(dict):
        n = 0

        def get(self, *a):
            Asked.n += 1
            return super().get(*a)

    texts = ["a b A\tb\x0b\x0c" * 500, None, "", "  ", " É\u0085x\x1fy \x00 É ", "a", "".join(chr(i) for i in range(0x250)) * 2]
    v = lm.Vocabulary([b"a", lm.END, b"b"], np.array([5, 4, 3]), 12, 3)
    v.rank = Asked(v.rank)
    rank, context, doc, out, words, code = lm._indexed(v, pa.array(texts))
    ws = [lm.tokens(t) for t in texts]
    flat = [w for x in ws for w in x]
    assert [words[i] for i in code] == flat and doc.tolist() == [i for i, x in enumerate(ws) for _ in x]
    assert rank.tolist() == [{b"a": 0, lm.END: 1, b"b": 2}.get(w, -1) for w in flat] and context.tolist() == [zlib.crc32(w) for w in flat]
    assert out.tolist() == [i for i, w in enumerate(flat) if w not in (b"a", b"b", lm.END)] and Asked.n <= len(set(flat)) + 1
    assert [len(x) for x in lm._indexed(v, pa.array([], pa.string()))] == [0, 0, 0, 0, 1, 0]


def test_a_row_moves_by_the_sum_of_its_tokens_and_one_step_size():
    rng = np.random.default_rng(3)
    rows = np.stack([np.zeros(900, np.uint16), rng.integers(0, 700, 900).astype(np.uint16), (rng.zipf(1.2, 900) % 300).astype(np.uint16)])
    table, gradient = rng.normal(size=(1024, 41)).astype(np.float32), rng.normal(size=(900, 41)).astype(np.float32)
    squares = np.ones(1024, np.float32)
    want, s = table.astype(np.float64), squares.astype(np.float64)
    for r in rows:
        for x in np.unique(r):
            g = gradient[r == x].astype(np.float64).sum(axis=0)
            s[x] += float(lm.SHARE) * g @ g
            want[x] -= 0.25 * g / np.sqrt(s[x])
    lm._descend(table, squares, rows, gradient, 0.25)
    assert np.allclose(table, want, atol=1e-4) and np.allclose(squares, s, rtol=1e-4)
