"""Substring dedup: FM-indexes of shards find every window of words that occurs elsewhere."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evplace.llm._shared import WordHashes, bloom_of, dropped, in_bloom, mix64, small_batches, written
from evplace.llm.fm_index import repeated_spans
from evplace.llm.neardup import _blocks

#: Words of an anchor, segments in a shard, and distinct segments of one anchor beyond which windows are counted instead.
ANCHOR, SHARD, CROWD = 8, 2500, 400
_BASE = np.uint64(0x9E3779B97F4A7C15)
_hashes = WordHashes()


def segments(words: list[list[bytes]], window: int, anchor: int = ANCHOR):
    """Segments of texts: doc, start, length (words), anchor hash, segment hash, as arrays.

    A window's anchor is its word ``anchor``-gram with the least hash (the leftmost, if tied), so equal
    windows have equal anchors. A segment is a longest run of windows with the very same anchor;
    each window of each text lies in just one segment.
    """
    anchor = min(anchor, window)
    n = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(n)
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    if not len(n) or n.max() < window:
        return none
    h = _hashes([w for ws in words for w in ws])
    grams = len(h) - anchor + 1
    g = np.zeros(grams, dtype=np.uint64)
    for k in range(anchor):
        g = g * _BASE + h[k : k + grams]
    per = window - anchor + 1
    doc = np.repeat(np.arange(len(n)), n)[: len(h) - window + 1]
    start = np.arange(len(doc))
    ok = start + window <= ends[doc]
    # least hash of every ``per`` grams in turn, by doubling; its low bits hold the place, so the leftmost wins
    low = np.uint64((1 << max(20, int(grams).bit_length())) - 1)
    g = mix64(g)
    least = (g & ~low) | np.arange(grams, dtype=np.uint64)
    wide = 1
    while 2 * wide <= per:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[: len(doc)], least[per - wide : per - wide + len(doc)])
    at = (least & low).astype(np.int64)
    doc, start, at = doc[ok], start[ok], at[ok]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    s, length = start[first], start[last] - start[first] + window
    # hashes of spans by a rolling sum over at most 2 * window words
    span = np.zeros(len(s), dtype=np.uint64)
    for k in range(int(length.max())):
        here = k < length
        span = np.where(here, span * _BASE + h[np.minimum(s + k, len(h) - 1)], span)
    d = doc[first]
    return d, s - (ends - n)[d], length, g[at[first]], mix64(span + length.astype(np.uint64))


_OCC = pa.list_(pa.struct([("m", pa.int64()), ("h", pa.int64()), ("p", pa.int32()), ("l", pa.int32())]))


def _scan(window: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("n", pa.int64()), ("sha", pa.string()), ("occ", _OCC)])

    def scan(batches):
        for batch in batches:
            for part in _blocks(batch):
                words = [t.encode().split() if t else [] for t in part.column(1).to_pylist()]
                d, s, l, m, h = segments(words, window)  # noqa: E741
                offsets = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(words)))]).astype(np.int32)
                occ = pa.StructArray.from_arrays([pa.array(m.view(np.int64)), pa.array(h.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(l.astype(np.int32))], ["m", "h", "p", "l"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words]), pa.ListArray.from_arrays(offsets, occ)], schema=schema)
        _hashes.seen.clear()  # the worker lives on

    return scan


def _contents(d: DataFrame, asked: DataFrame) -> DataFrame:
    """m, h, content, d of the segments asked for (m, h, l, d and x: a text's key and a place in it), each cut from one text.

    Texts are read again, but a Bloom filter of fixed size, broadcast, spares those that none is cut from.
    """
    cuts = written(asked.groupBy("x.key", "x.key2").agg(F.collect_list(F.struct("m", "h", "x.p", "l", "d")).alias("cuts")), "cuts")
    bits = d.sparkSession.sparkContext.broadcast(bloom_of(cuts.select("key"), "key"))

    def chosen(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(bits.value, np.asarray(batch.column(0)).view(np.uint64))))

    def cut(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words = r["text"].encode().split()
                x = r["cuts"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c["m"] for c in x], pa.int64()), pa.array([c["h"] for c in x], pa.int64()), pa.array([b" ".join(words[c["p"] : c["p"] + c["l"]]) for c in x], pa.binary()), pa.array([c["d"] for c in x], pa.int64())],
                    ["m", "h", "content", "d"])

    found = d.select("key", "key2", "text").where("text is not null").mapInArrow(chosen, "key long, key2 long, text string").dropDuplicates(["key", "key2"])
    return written(found.join(cuts, ["key", "key2"]).select("text", "cuts").mapInArrow(cut, "m long, h long, content binary, d long"), "contents")


def _texts_in(bits):
    """sha, text of the rows (id, text, key) whose key may be in the filter."""
    def texts(batches):
        for batch in batches:
            part = batch.filter(pa.array(in_bloom(bits.value, np.asarray(batch.column(2)).view(np.uint64))))
            for at in range(0, part.num_rows, 512):
                some = part.column(1).slice(at, 512)
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(b" ".join(t.encode().split() if t else [])).hexdigest() for t in some.to_pylist()], pa.string()), some], ["sha", "text"])

    return texts


def repeated_segments(contents: DataFrame, window: int, segments_of: int, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """m, h, s, e: spans of segments (m, h, content, d) whose windows occur elsewhere.

    Segments with one anchor go to one shard. A shard's FM-index takes its distinct segments, which are then
    streamed through it. Anchors with more than ``crowd`` distinct segments would make a shard of
    any size, so windows of those are counted by their digests instead, which is as exact.
    """
    shards = max(1, -(-segments_of // shard))

    def search(pdf):
        pdf = pdf.drop_duplicates(["m", "h"])
        spans = repeated_spans([bytes(c).split(b" ") for c in pdf["content"]], window)
        i = np.array([x[0] for x in spans], dtype=np.int64)
        return pd.DataFrame({"m": pdf["m"].to_numpy()[i], "h": pdf["h"].to_numpy()[i], "s": np.array([x[1] for x in spans], np.int32), "e": np.array([x[2] for x in spans], np.int32)})

    few = contents.where(F.col("d") <= crowd).select("m", "h", "content", F.pmod(F.xxhash64("m"), F.lit(shards)).alias("shard"))
    indexed = few.groupBy("shard").applyInPandas(search, "m long, h long, s int, e int")

    def windows(batches):
        for batch in batches:
            m, h, s, w = [], [], [], []
            for x, y, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                c = c.split(b" ")
                for k in range(len(c) - window + 1):
                    m.append(x), h.append(y), s.append(k)
                    w.append(hashlib.blake2b(b" ".join(c[k : k + window]), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(h, pa.int64()), pa.array(s, pa.int32()), pa.array(w, pa.binary())], ["m", "h", "s", "w"])

    many = contents.where(F.col("d") > crowd).select("m", "h", "content").dropDuplicates(["m", "h"]).mapInArrow(windows, "m long, h long, s int, w binary")
    twice = many.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w")
    counted = many.join(twice, "w").select("m", "h", "s", (F.col("s") + window).cast("int").alias("e"))
    return indexed.unionByName(counted)


def removed_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """One row for each document row: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words that covers it occurs anywhere else in the table too, the same
    document included. Texts are cut into segments by anchors. Texts that are equal as word
    sequences are one class; a class of more than one row goes whole if it is as long as a window.
    Segments whose anchor occurs once in all classes are unique; those that occur whole more than once
    need no search; the others meet in FM-indexes by anchor. Spans come back to texts by
    equi-joins on the segment. Texts and segments are known by 128 bits. Null and empty texts have no words. Rows that repeat a doc_id, or have
    none, are rows like others. Ids that are no whole numbers are null. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    d = small_batches(docs).select(F.col(doc_id).try_cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2"))
    rows = written(d.mapInArrow(_scan(window), "id long, key long, key2 long, n long, sha string, occ array<struct<m:long,h:long,p:int,l:int>>"), "segments")
    classes = written(rows.groupBy("sha").agg(F.count("*").alias("copies"), F.first("occ").alias("occ"), F.min(F.struct("key", "key2")).alias("key")).select("sha", "copies", "occ", "key.*"), "texts")
    at = classes.select("sha", "copies", "key", "key2", F.explode("occ").alias("x")).select("sha", "copies", "key", "key2", "x.*")
    # of each segment: how often, how long, and one place to cut it from
    seen = at.groupBy("m", "h").agg(F.count("*").alias("c"), F.max("l").alias("l"), F.min(F.struct("key", "key2", "p")).alias("x"))
    live = seen.groupBy("m").agg(F.count("*").alias("d"), F.sum("c").alias("all")).where(F.col("all") > 1).select("m", "d")
    live = written(seen.join(live, "m"), "anchors")
    whole = live.where("c > 1").select("m", "h", F.lit(0).alias("s"), F.col("l").alias("e"))
    asked = live.where("d > 1").select("m", "h", "l", "d", "x")
    contents = _contents(d, asked)
    spans = whole.unionByName(repeated_segments(contents, window, asked.count(), crowd, shard))
    # texts that go whole need no spans
    part = at.where("copies = 1").select("sha", "m", "h", "p").join(spans, ["m", "h"]).select("sha", (F.col("p") + F.col("s")).alias("s"), (F.col("p") + F.col("e")).alias("e"))
    cut = written(part.groupBy("sha").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    dropped(contents)
    kept = _kept(d, rows, cut)
    out = rows.select("id", "n", "sha").join(classes.select("sha", "copies"), "sha").join(kept, "sha", "left")
    gone = (F.col("copies") > 1) & (F.col("n") >= window)
    return out.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_words"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("lost", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
    )


def _kept(d: DataFrame, rows: DataFrame, cut: DataFrame) -> DataFrame:
    """sha, lost (words), left (digest of the kept words) for the texts that have spans to lose."""
    bits = d.sparkSession.sparkContext.broadcast(bloom_of(rows.join(cut.select("sha"), "sha", "left_semi").select("key").distinct(), "key"))

    def remove(batches):
        for batch in batches:
            lost, left = [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = t.encode().split()
                keep = np.ones(len(words), dtype=bool)
                for x in spans:
                    keep[x["s"] : x["e"]] = False
                lost.append(int(len(words) - keep.sum()))
                left.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(keep)])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lost, pa.int64()), pa.array(left, pa.string())], ["sha", "lost", "left"])

    found = d.mapInArrow(_texts_in(bits), "sha string, text string")
    return found.join(cut, "sha").select("sha", "text", "spans").mapInArrow(remove, "sha string, lost long, left string")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removed_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(generate_series(1, len(w) - 34)) AS s, w FROM d WHERE len(w) >= 35),
k AS (SELECT r, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS h FROM x),
t AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS c FROM k) WHERE c > 1),
g AS (SELECT DISTINCT r, unnest(generate_series(s, s + 34)) AS p FROM t),
u AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT u.r, string_agg(word, ' ' ORDER BY u.p) AS txt FROM u LEFT JOIN g ON g.r = u.r AND g.p = u.p WHERE g.r IS NULL GROUP BY u.r),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
