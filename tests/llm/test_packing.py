"""Packing: every id in one place, checked against the library; patterns fill exactly and come near the bound."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evplace.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a   b", " a", "a ", "a  ", "a\n b", "a \n b", "a\n\n b", "a\nb\nc x", "x's 'tis it's don't I'LL", "café naïve \U0001f600 x", "<|endoftext|> b", "a\x1cb \x1cc d\x85e f  g",
       "12 34a b5 a.b a... b!?   c", "ªº straße. ǅx ẛ̣ İ", "a\t b\t\tc \td", "word.\nNext word,\nthen", "a\n\x1fb c", "x \n\n\n y", "é. é, .a a.\nb", "﻿a b", "  lead", "trail\n", "inly$$$ a's' b'' c'! of%%% d\"). e-- it's. f'll' g_ h~\n!i #j ((k)) l'm'n"]


def test_words_give_the_ids_of_whole_texts(spark):
    encode = packing.SpacedEncoder(PATH)
    assert encode.by_word
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    for t in texts:
        assert np.frombuffer(encode(t, b""), encode.dtype).tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids, repr(t[:60])
    words = packing.SpacedEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not words.by_word and np.frombuffer(words("A b  c", b""), words.dtype).tolist() == words.tokenizer.encode("A b  c", add_special_tokens=False).ids


def laid_out(got, docs, size=1024, path=PATH):
    """Hold pieces with checksums against the library, and return the lengths of sequences; docs: (id, text), ids once."""
    tok = Tokenizer.from_file(path)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return {s: sum(r["length"] for r in rows) for s, rows in by_seq.items()}


@pytest.mark.parametrize("sf,more", [("sf0.001", 0.2), ("sf0.01", 0.15)])
def test_the_query_on_the_table(spark, sf, more):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = packing.op11_packing(spark, f"/root/testdata/{sf}").collect()
    used = laid_out(got, docs)
    # nothing is padded: all sequences are full, but one of some powers of two
    assert sorted(n for n in used.values() if n < 1024) == sorted({n for n in used.values() if n < 1024}) and all(n & (n - 1) == 0 for n in used.values())
    # documents are cut where they fill sequences, and few others: fewer, the more documents there are for a pattern
    least = sum(math.ceil(r["doc_tokens"] / 1024) for r in got if r["start"] == 0)
    assert len(got) - least <= more * len(used)


def test_hard_rows(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "word " * 30_000), (102, "same text"), (103, "same text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("no").alias(c) for c in ("id", "part", "k", "ids", "start", "length", "rank", "bases")])
    got = packing.with_checksums(packing.packed(df.repartition(4), PATH, size=64)).collect()
    used = laid_out(got, docs, 64)
    assert all(n == 64 or n & (n - 1) == 0 for n in used.values())
    assert packing.packed(df.limit(0), PATH).collect() == []
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (None, None)], "doc_id long, text string")
    rows = packing.packed(twice, PATH).collect()
    assert sorted(str(r["doc_id"]) for r in rows if r["start"] == 0) == ["1", "1", "None", "None"] and sum(r["length"] for r in rows) == 4 + 4 + 2 + 1
    with pytest.raises(ValueError):
        packing.packed(df, PATH, size=1000)


def test_ranks_in_a_join_give_the_same_sequences(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5, "doc_id")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    monkeypatch.setattr(packing, "RANKS_BYTES", 0)
    laid_out(packing.with_checksums(packing.packed(df, PATH)).collect(), docs)


def test_sequences_hold_their_documents(spark):
    docs = [(i, "some words here " * (i * 37 % 50)) for i in range(60)]
    pieces = packing.packed(spark.createDataFrame(docs, "doc_id long, text string"), PATH, size=256)
    tok, by_doc = Tokenizer.from_file(PATH), {}
    seqs = {r["sequence_id"]: r for r in packing.sequences(pieces, 256).collect()}
    for r in seqs.values():
        n = r["length"]
        assert len(r["ids"]) == 2 * (n if n & (n - 1) == 0 else 256)
    for r in pieces.collect():
        s = np.frombuffer(seqs[r["sequence_id"]]["ids"], "<u2")
        by_doc.setdefault(r["doc_id"], []).append((r["start"], s[r["offset"] : r["offset"] + r["length"]].tolist()))
    for i, t in docs:
        assert sum((x for _, x in sorted(by_doc[i])), []) == tok.encode(t, add_special_tokens=False).ids + [0]


def bound(counts, size):
    """The greatest number of full sequences by brute force over whole-number patterns, for tiny sizes."""
    lengths = tuple(x for x in range(1, size) if counts[x])
    patterns = []

    def grow(i, left, now):
        if not left:
            patterns.append(tuple(now))
        elif i < len(lengths):
            for n in range(left // lengths[i] + 1):
                grow(i + 1, left - n * lengths[i], [*now, n])

    grow(0, size, [])
    patterns = [p + (0,) * (len(lengths) - len(p)) for p in patterns]
    from functools import cache

    @cache
    def best(left):
        return max((1 + best(tuple(a - b for a, b in zip(left, p))) for p in patterns if all(a >= b for a, b in zip(left, p))), default=0)

    return best(tuple(int(counts[x]) for x in lengths))


@pytest.mark.parametrize("counts", [{4: 7, 12: 3, 8: 4, 6: 2, 10: 2}, {5: 6, 6: 6}, {9: 9}, {15: 4, 1: 3, 2: 1}, {}])
def test_patterns_reach_the_bound_on_small_histograms(counts):
    have = np.zeros(17, np.int64)
    for x, n in counts.items():
        have[x] = n
    got = packing.fill_patterns(have, 16)
    used = np.zeros(17, np.int64)
    for pattern, times in got:
        assert sum(x * n for x, n in pattern.items()) == 16
        for x, n in pattern.items():
            used[x] += n * times
    assert (used <= have).all() and sum(t for _, t in got) >= bound(have, 16) - 1


def test_patterns_take_nearly_all_of_a_large_histogram():
    counts = np.zeros(1025, np.int64)
    np.add.at(counts, np.random.default_rng(1).integers(1, 1024, 200_000), 1)
    total = (counts * np.arange(1025)).sum() / 1024
    alone, program = (sum(t for _, t in packing.fill_patterns(counts, pivots=p)) for p in (0, 400))
    assert total >= program > alone and program >= 0.96 * total
