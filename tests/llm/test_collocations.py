"""Collocations against plain Python: exact counts, few bits so that fingerprints collide, long texts over many blocks."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evplace.llm import collocations as co

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs, longest=3):
    f = defaultdict(Counter)
    for t, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f[lang or "und"][()] += len(w)
            for n in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return f


def brute(docs, longest=3, least=10, top=2000):
    out = []
    for lang, f in counted(docs, longest).items():
        cand = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        rows = []
        for p, a in cand.items():
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], f[()]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r, n) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def made(seed=0, docs=120, words=40):
    """Texts of few words, in pieces, with odd white space and letters."""
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "of", "a", "é", "ÉT", "new", "york", "city", "x1", "\U0001f600", "don't", "..", "\x0b"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".\n", " \t ", "\r"]
    return [("".join(vocabulary[int(i)] + gaps[int(g)] for i, g in zip(rng.integers(0, len(vocabulary), words), rng.integers(0, len(gaps), words))), ["en", "de", None, "und"][k % 4]) for k in range(docs)]


HARD = [(None, "en"), ("", "en"), (" \t\n", "de"), ("...", None), ("alone", "xx"), ("same words here " * 4, "en"), ("same words here " * 4, "en"), ("w" * 3000 + " end", "de")]


@pytest.mark.parametrize("bits", [64, 8, 4])
def test_equals_plain_python_whatever_collides(spark, monkeypatch, bits):
    docs = made() + HARD
    df = spark.createDataFrame(docs, "text string, lang string").select("*", *[F.lit("no").alias(c) for c in ("key", "key2", "n", "a", "fp", "phrase", "lang_hash")])
    got = rows_of(co.collocations(df.repartition(3), bits=bits))
    assert got == brute(docs) and len(got) > 30


def test_blocks_and_flushes_do_not_matter(spark, monkeypatch):
    # (functions go to workers by reference to the module, so its constants are set here for a scan in this process)
    docs = made(3, 6, 400)
    monkeypatch.setattr(co, "BLOCK", 50)
    table = pa.array([t for t, _ in docs] + [None, ""])
    words = co.Words(table.slice(0), np.arange(len(table)), np.arange(len(table)).astype(np.uint64))
    seen = Counter()
    for i, j, hashed, start, end, text in words.blocks(3):
        for n in (1, 2, 3):
            at = words.ngrams(i, j, n)
            seen.update((n, text[a:b].tobytes().decode()) for a, b in zip(start[at], end[at + n - 1]))
    want = Counter()
    for f in counted(docs).values():
        want.update({(len(p), " ".join(p)): a for p, a in f.items() if p})
    assert seen == want


def test_fingerprints_tell_texts_apart_and_not_places():
    words = [b"ab", b"b", b"a", b"abb", b"", b"b a", b"ba", b"a" * 5000, b"a" * 5001]
    block = np.frombuffer(b"zz ".join(words * 2), np.uint8)
    start, at = [], 0
    for w in words * 2:
        start.append(at)
        at += len(w) + 3
    start = np.array(start)
    end = start + np.array([len(w) for w in words * 2])
    h = co.Hashed(block)
    for f in (h.fingerprints(start, end, np.zeros(len(start), np.uint64), 64), h.checks(start, end)):
        assert (f[: len(words)] == f[len(words) :]).all() and len(set(f.tolist())) == len(words)


def test_general_lengths_and_limits(spark):
    docs = made(5, 150, 60)
    df = spark.createDataFrame(docs, "text string, lang string")
    assert rows_of(co.collocations(df, longest=4, least=6, top=15, salts=3)) == brute(docs, 4, 6, 15)
    assert co.collocations(df.limit(0)).collect() == []


def test_the_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = sorted(tuple(r) for r in con.execute(f"select lang, rank, phrase, a, l, r, n, score from ({co.OP12_SQL})").fetchall())
    got = rows_of(co.op12_collocations(spark, d))
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("text", "lang").collect()]
    assert got == want == brute(docs) and got
