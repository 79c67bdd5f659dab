"""Quality classifier: EM on a planted mixture, held-out labels, hard cases."""

import numpy as np
from pyspark.sql import functions as F

from evplace.llm import quality


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.2
    right, speaks = np.array([0.97, 0.9, 0.95, 0.99]), np.array([1.0, 0.8, 0.9, 0.4])
    votes = np.where(rng.random((len(y), 4)) < right, y[:, None], ~y[:, None]).astype(int)
    votes[rng.random(votes.shape) > speaks] = quality.ABSTAIN
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, accuracy = quality.fit_labellers(patterns, counts.astype(float))
    assert np.abs(accuracy - right).max() < 0.03
    assert ((post[at] > 0.5) == y).mean() > 0.97


def test_em_equals_brute_force():
    rng = np.random.default_rng(8)
    votes = rng.integers(-1, 2, (40, 3))
    counts = rng.integers(1, 9, 40).astype(float)
    told = rng.integers(-1, 2, 40)
    post, _ = quality.fit_labellers(votes, counts, told, rounds=7)
    p = [0.99 if t == 1 else 0.01 if t == 0 else 0.8 if 1 in v else 0.02 if 0 in v else 0.1 for v, t in zip(votes.tolist(), told.tolist())]
    hint = {(0, -1): 0.1, (0, 0): 0.3, (0, 1): 0.05, (1, -1): 0.1, (1, 0): 0.05, (1, 1): 0.3}
    for _ in range(7):
        weight = {(y, k, s): hint[y, s] for y in (0, 1) for k in range(3) for s in (-1, 0, 1)}
        prior = [0.0, 0.0]
        for v, c, x in zip(votes.tolist(), counts, p):
            for y, share in ((0, 1 - x), (1, x)):
                prior[y] += c * share
                for k in range(3):
                    weight[y, k, v[k]] += c * share
        p = []
        for v, t in zip(votes.tolist(), told.tolist()):
            like = [prior[y] / sum(counts) * (1 if t < 0 else quality.TRUST if t == y else 1 - quality.TRUST) for y in (0, 1)]
            for y in (0, 1):
                for k in range(3):
                    like[y] *= weight[y, k, v[k]] / sum(weight[y, k, s] for s in (-1, 0, 1))
            p.append(like[1] / (like[0] + like[1]))
    assert np.allclose(post, p, atol=1e-9)


def test_scorer_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    weights = np.zeros((2, quality.FEATURES + 1), np.float32)
    weights[:, rng.integers(0, quality.FEATURES, 60_000)] = rng.normal(0, 2, (2, 60_000))
    weights[:, -1] = (-2, -3)
    texts = [None, "", "One two", "The cat, the dog; THE END!! and l\u2019\u00e9t\u00e9 idiot| 12:30 a.b", "word " * 90 + "stupid fool", "\u00fcber \u00fcber ### *** x" * 9]
    got = quality.scores(spark.createDataFrame(list(enumerate(texts)), "x long, text string"), weights)
    for i, a, b in got.collect():
        tokens = texts[i].split() if texts[i] else []
        table = quality.Tokens()
        said = quality.votes(table, [texts[i]], *table([texts[i]]))
        for axis, p in ((0, a), (1, b)):
            count: dict = {}
            for w in tokens:
                word = w.strip(quality.AROUND).lower()
                bare = w.rstrip(".,;:?")
                kind = quality.shape(w)
                if bare.isalpha() and (bare.islower() or bare.isupper() or bare.istitle()):
                    assert kind == ("a" if bare.islower() else "A" if len(bare) == 1 or bare.isupper() else "Aa") + quality.shape(w[len(bare) :])
                for f in {quality.zlib.crc32(b"shape:" + kind.encode()) % quality.FEATURES}:
                    count[f] = count.get(f, 0) + 1
                for f in quality.word_features([word])[0].tolist():
                    if f >= 0:
                        count[f] = count.get(f, 0) + 1
            n = max(len(tokens), 1)
            z = float(weights[axis, -1]) + sum(float(weights[axis, f]) * min(1, quality.SCALE * c / n) * min(1, n / quality.SHORT) for f, c in count.items())
            z += sum(float(weights[axis, f]) for f in quality.vote_features(axis, said[axis][0]))
            assert abs(p - 1 / (1 + np.exp(-z))) < 1e-5


def test_labellers():
    def say(text):
        t = quality.Tokens()
        return [x[0].tolist() for x in quality.votes(t, [text], *t([text]))]

    rest = " ".join(f"plain{i}" for i in range(40))
    assert say("You are a stupid idiot and a loser")[1][:3] == [1, 1, 1]
    assert say("du bist ein trottel " + rest)[1][2] == 1 and say("tu eres un imb\u00e9cil " + rest)[1][2] == 1
    assert say("1d1ot st*pid " + rest)[1][3] == 1 and say("12:30 a.b x-y " + rest)[1][3] == -1
    assert say(rest)[1] == [0, -1, -1, -1, 0] and say("you " + rest)[1] == [0, -1, -1, -1, -1]
    assert say(None) == [[-1] * 7, [-1] * 5] == say("a b")
    assert say("SHOUT IT OUT LOUD NOW")[0][1] == 1 and say("one | two | three | four | five")[0][2] == 1
    assert say("the " * 60)[0][4] == 1 and say("same line here\n" * 8)[0][5] == 1 and say("go go go go go go go go")[0][6] == 1


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.repartition(8)
    rows = []
    for fold in (0, 1):
        out = F.crc32(F.col("doc_id").cast("string")) % 5 == fold
        rows += quality.classified(docs, labels.where(~out)).join(labels.where(out), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1 and r.toxic == 0]) > 0.99
    assert np.mean([r.p_low >= 0.5 for r in rows if r.quality == 0]) > 0.95
    for lang in ("en", "de", "fr", "es"):
        toxic = [r.p_toxic >= 0.5 for r in rows if r.lang == lang and r.toxic == 1 and r.quality == 1]
        found = [r.toxic for r in rows if r.lang == lang and r.p_toxic >= 0.5]
        print(lang, len(toxic), np.mean(toxic), np.mean(found))
        assert np.mean(toxic) >= 0.9 and np.mean(found) >= 0.9


def test_symbols_of_any_script_end_words():
    def says(text):
        t = quality.Tokens()
        return quality.votes(t, [text], *t([text]))[0][0, 3]

    for tail in ("##", "\u2605\u2605", "\u2192\u2192", "\u2592\u2588", "\u00a4\u00a6"):
        assert says(" ".join(f"word{tail} other" for _ in range(20))) == 1
    for tail in ("", ".", '."', "?)", "\u2026\u00bb", "\u00e9\u00e8"):
        assert says(" ".join(f"word{tail} other" for _ in range(20))) == 0


def test_hard_cases(spark):
    rows = [(1, None), (2, ""), (3, "ok"), (3, "ok"), (None, "x y z w v u"), (4, "a b " * 20_000), (5, "### $$$ %%% &&& *** ### $$$ %%%" * 30), (6, "\U0001f600 \u00e9\x00")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("id", "low", "toxic", "quality", "label", "x", "p_low", "p_toxic", "axis")])
    odd = spark.createDataFrame([(1, None, None), (None, 1, 0), (5, 0, 7), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (None, odd, odd.limit(0)):
        got = quality.classified(df, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.p_low <= 1 and 0 <= r.p_toxic <= 1 for r in got)
        kept = quality.kept_rows(df, labels)
        assert kept.columns == df.columns and sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(r.doc_id), str(t)) for r, (_, t) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0]))) if r.kept)
    assert quality.classified(df.limit(0), None).collect() == [] and quality.kept_rows(df.limit(0), odd).collect() == []
