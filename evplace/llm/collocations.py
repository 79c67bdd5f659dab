"""Phrase collocations by Rabin-Karp fingerprints: n-grams are counted as numbers, and only frequent phrases are read from their texts.

Prefix polynomials over the bytes of a block of text give every n-gram's fingerprint in a few array operations. Tasks add fingerprints up before they are
shuffled. An n-gram cannot be frequent unless the shorter ones in it are, so longer ones are counted only where a filter of the frequent shorter
ones lets them. One more pass gives each frequent fingerprint a pointer to an occurrence and the extremes of a second hash. Frequent phrases are
read at their pointers and checked; where the second hash shows different texts under one fingerprint, its occurrences are counted anew by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evplace.llm._shared import bloom_of, dropped, in_bloom, mix64, small_batches, written

#: Bytes hashed at once; n-grams that a task adds up at once; log2 of the most bits of a filter that tasks get (more keys than a sixteenth of it only make it let more pass).
BLOCK, HELD, FILTER = 1 << 18, 1 << 20, 26
#: A pointer is a hash of a document in 33 bits and the number of a word in it in 30; a text of 2 GB has no more words.
AT = 30
BASE, PRIME, BASE31 = 0x9E3779B97F4A7C15, (1 << 31) - 1, 1_103_515_245
#: What separates pieces, and, with space and tab, words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"

_plain = np.arange(256, dtype=np.uint8)
_plain[65:91] += 32
_plain[9] = 32
_plain[list(PIECE_ENDS)] = 10
_values = mix64(np.arange(1, 257, dtype=np.uint64))
_values31 = _values % np.uint64(PRIME)
_powers: dict = {}


def powers(n: int) -> tuple[np.ndarray, ...]:
    """Powers 0 to n of the base and of its inverse, by 2^64 and by the prime; kept, as blocks are of like sizes."""
    if _powers.get("n", -1) < n:
        n = max(n, BLOCK + (1 << 16))
        wrap = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))])

        def prime(b: int) -> np.ndarray:
            out = np.ones(1, np.uint64)
            while len(out) <= n:
                out = np.concatenate([out, out * np.uint64(pow(b, len(out), PRIME)) % np.uint64(PRIME)])
            return out[: n + 1]

        _powers.update(n=n, all=(wrap(BASE), wrap(pow(BASE, -1, 1 << 64)), prime(BASE31), prime(pow(BASE31, -1, PRIME))))
    return _powers["all"]


class Hashed:
    """A block of bytes, of which any part's fingerprint (by 2^64) and check (by a prime) come from prefix polynomials."""

    def __init__(self, block: np.ndarray):
        n = len(block)
        self.up, down, self.up31, down31 = powers(n)
        self.sums, self.sums31 = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(_values[block] * down[1 : n + 1], out=self.sums[1:])
        np.cumsum(_values31[block] * down31[1 : n + 1] % np.uint64(PRIME), out=self.sums31[1:])

    def fingerprints(self, start: np.ndarray, end: np.ndarray, lang: np.ndarray, bits: int) -> np.ndarray:
        mixed = mix64(((self.sums[end] - self.sums[start]) * self.up[end]) ^ lang)
        return (mixed >> np.uint64(64 - bits) if bits < 64 else mixed).view(np.int64)

    def checks(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = np.uint64(PRIME)
        return ((self.sums31[end] - self.sums31[start]) % p * self.up31[end] % p).astype(np.int32)


class Words:
    """The words of a batch of texts: compacted bytes, with one space between words, in blocks that hold whole words."""

    def __init__(self, texts: pa.Array, keys: np.ndarray, langs: np.ndarray):
        texts = pc.fill_null(texts, "")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.empty(0, np.uint8)
        off = off - off[0]
        b = _plain[raw]
        w = (b != 32) & (b != 10)
        before, behind = np.zeros(len(w) + 1, bool), np.zeros(len(w) + 1, bool)
        before[1:], behind[:-1] = w, w
        before[off[:-1]] = False
        behind = behind[1:]
        behind[off[1:][off[1:] > 0] - 1] = False
        start, end = np.flatnonzero(w & ~before[:-1]), np.flatnonzero(w & ~behind) + 1
        self.bytes, self.size = b[w], end - start
        self.byte_at = np.concatenate([[0], np.cumsum(self.size)])
        self.room = np.concatenate([[0], np.cumsum(self.size + 1)])
        doc = np.searchsorted(off, start, "right") - 1
        self.line = np.cumsum(b == 10, dtype=np.int32)[start] + doc * np.int64(1 << 40)  # differs between pieces, and between documents
        self.at = np.arange(len(start)) - np.searchsorted(start, off[:-1])[doc]
        self.key, self.lang = keys[doc], langs[doc]

    def blocks(self, longest: int):
        """(first word, end, Hashed, starts, ends, bytes): n-grams that start in [first, end) lie in the block."""
        i, n = 0, len(self.size)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.room, self.room[i] + BLOCK)))
            j, far = min(j, n), min(j + longest - 1, n)
            size = self.size[i:far]
            text = np.full(int(self.room[far] - self.room[i]), 32, np.uint8)
            text[np.arange(int(size.sum())) + np.repeat(np.arange(far - i), size)] = self.bytes[self.byte_at[i] : self.byte_at[far]]
            start = self.room[i:far] - self.room[i]
            yield i, j, Hashed(text), start, start + size, text
            i = j

    def ngrams(self, i: int, j: int, n: int) -> np.ndarray:
        """The words in [i, j) at which an n-gram within one piece starts, counted from i."""
        j = min(j, len(self.size) - n + 1)
        return np.flatnonzero(self.line[i:j] == self.line[i + n - 1 : j + n - 1]) if j > i else np.empty(0, np.int64)


def _words_of(batch):
    """(Words, rows) of a batch's rows, some BLOCKS of text at a time, and at least one row."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2 * BLOCK, "right")))
        rows = batch.slice(at, to - at)
        yield Words(rows.column(0), np.asarray(rows.column(1)).astype(np.int64), np.asarray(rows.column(2)).astype(np.int64).view(np.uint64)), rows
        at = to


def _grouped(parts: list) -> tuple[np.ndarray, np.ndarray, list]:
    """Fingerprints once, where each begins, and the other columns in their order, of what a task holds."""
    fp, *others = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.argsort(fp, kind="stable")
    fp = fp[order]
    first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]])[: len(fp)])
    return fp[first], first, [x[order] for x in others]


def _flushed(scan, added):
    """added(parts) of every HELD rows of (rows, part) that scan gives."""
    parts, held = [], 0
    for rows, part in scan:
        parts.append(part)
        held += rows
        if held > HELD:
            yield added(parts)
            parts, held = [], 0
    if held:
        yield added(parts)


def _counts(docs: DataFrame, n: int, least: int, shorter, bits: int) -> DataFrame:
    """fp, c of the n-grams that occur ``least`` times, and for n = 1 of every lang's number of words, as its empty phrase; written.

    shorter is the filter of frequent (n - 1)-grams, broadcast.
    """
    def scan(batches):
        for words, _ in (x for batch in batches for x in _words_of(batch)):
            for i, j, hashed, start, end, _ in words.blocks(n):
                at = words.ngrams(i, j, n)
                if shorter is not None and len(at):
                    # each (n - 1)-gram in it
                    inner = np.unique(np.concatenate([at, at + 1]))
                    fine = np.zeros(int(inner[-1]) + 1, bool)
                    fine[inner] = in_bloom(shorter.value, mix64(hashed.fingerprints(start[inner], end[inner + n - 2], words.lang[i + inner], bits).view(np.uint64)))
                    at = at[fine[at] & fine[at + 1]]
                if len(at):
                    yield len(at), (hashed.fingerprints(start[at], end[at + n - 1], words.lang[i + at], bits), np.ones(len(at), np.int64))
                if n == 1:
                    langs, many = np.unique(words.lang[i:j], return_counts=True)
                    empty = np.zeros(len(langs), np.int64)
                    yield len(langs), (hashed.fingerprints(empty, empty, langs, bits), many)

    def added(parts):
        fp, first, (c,) = _grouped(parts)
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(np.add.reduceat(c, first))], ["fp", "c"])

    rows = docs.select("text", "key", "lang_hash").mapInArrow(lambda batches: _flushed(scan(batches), added), "fp long, c long")
    return written(rows.groupBy("fp").agg(F.sum("c").alias("c")).where(F.col("c") >= least), f"{n}-grams")


def _pointers(docs: DataFrame, filters: list, bits: int) -> DataFrame:
    """fp, level, ptr (the least), lo, hi (of checks) of every n-gram that the filter of its level lets pass; empty phrases are of the first level."""
    def scan(batches):
        for words, _ in (x for batch in batches for x in _words_of(batch)):
            for i, j, hashed, start, end, _ in words.blocks(len(filters)):
                for n, asked in enumerate(filters, 1):
                    at = words.ngrams(i, j, n)
                    fp = hashed.fingerprints(start[at], end[at + n - 1], words.lang[i + at], bits)
                    keep = in_bloom(asked.value, mix64(fp.view(np.uint64)))
                    at, fp = at[keep], fp[keep]
                    if len(at):
                        yield len(at), (fp ^ n, np.full(len(at), n, np.int32), (words.key[i + at] << AT) | words.at[i + at], hashed.checks(start[at], end[at + n - 1]))
                langs, one = np.unique(words.lang[i:j], return_index=True)
                empty = np.zeros(len(langs), np.int64)
                yield len(langs), (hashed.fingerprints(empty, empty, langs, bits) ^ 1, np.ones(len(langs), np.int32), words.key[i + one] << AT, empty.astype(np.int32))

    def added(parts):
        # rows of two levels with one key would be one: their level is looked at, too
        fp, first, (level, ptr, check) = _grouped(parts)
        if (np.maximum.reduceat(level, first) != np.minimum.reduceat(level, first)).any():
            size = np.diff(np.append(first, len(level)))
            order = np.lexsort((level, np.repeat(np.arange(len(fp)), size)))
            fp, level, ptr, check = np.repeat(fp, size)[order], level[order], ptr[order], check[order]
            first = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (level[1:] != level[:-1])]))
            fp = fp[first]
        n = level[first]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (fp ^ n, n, np.minimum.reduceat(ptr, first), np.minimum.reduceat(check, first), np.maximum.reduceat(check, first))], ["fp", "level", "ptr", "lo", "hi"])

    rows = docs.select("text", "key", "lang_hash").mapInArrow(lambda batches: _flushed(scan(batches), added), "fp long, level int, ptr long, lo int, hi int")
    return rows.groupBy("fp", "level").agg(F.min("ptr").alias("ptr"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _filter(keys: DataFrame, column: str):
    """A Bloom filter of a column of longs, as large as their number asks up to 2^FILTER bits, broadcast. They are mixed first."""
    size = min(FILTER, max(16, int(keys.count() * 16).bit_length()))
    mixed = keys.select(_mixed(F.col(column)).alias("k"))
    return keys.sparkSession.sparkContext.broadcast(bloom_of(mixed, "k", size))


def _mixed(column):
    """mix64() of a column of longs."""
    @F.arrow_udf("long")
    def mix(x: pa.Array) -> pa.Array:
        return pa.array(mix64(np.asarray(x).astype(np.int64).view(np.uint64)).view(np.int64))

    return mix(column)


def _read(docs: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """fp, n, lang, phrase, c, lo, hi: frequent n-grams (fp, n, c, ptr, lo, hi) read from the document that they point to, where the fingerprint agrees.

    Pointers are the least of all occurrences, so few documents get most of them; equal texts are one. A document's own words bound its row.
    """
    asks = frequent.select(F.shiftright("ptr", AT).alias("key"), F.struct("fp", "n", F.col("ptr").bitwiseAND(F.lit((1 << AT) - 1)).alias("at"), "c", "lo", "hi").alias("ask"))
    asks = written(asks.groupBy("key").agg(F.collect_list("ask").alias("asks")), "asks")
    bits_of = _filter(asks, "key")

    def pointed(batches):
        for batch in batches:
            keep = in_bloom(bits_of.value, mix64(np.asarray(batch.column(1)).astype(np.int64).view(np.uint64)))
            yield batch.filter(pa.array(keep))

    texts = docs.select("text", "key", "lang_hash", "key2", "lang").mapInArrow(pointed, "text string, key long, lang_hash long, key2 long, lang string")
    one = texts.groupBy("key", "key2").agg(F.first("text").alias("text"), F.first("lang").alias("lang"), F.first("lang_hash").alias("lang_hash"))

    def cut(batches):
        table = bytes(_plain.tolist())
        for batch in batches:
            for text, lang, mix, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = text.encode().translate(table).split()
                phrases = [b" ".join(words[a["at"] : a["at"] + a["n"]]) for a in own]
                size = np.array([len(p) for p in phrases])
                end = np.cumsum(size)
                hashed = Hashed(np.frombuffer(b"".join(phrases), np.uint8))
                fp = hashed.fingerprints(end - size, end, np.full(len(own), mix, np.int64).view(np.uint64), bits)
                fine = [(a, p) for a, p, f in zip(own, phrases, fp.tolist()) if f == a["fp"]]
                yield pa.RecordBatch.from_pydict({**{c: [a[c] for a, _ in fine] for c in ("fp", "n")}, "lang": [lang] * len(fine), "phrase": [p.decode() for _, p in fine], **{c: [a[c] for a, _ in fine] for c in ("c", "lo", "hi")}},
                                                 schema=pa.schema([("fp", pa.int64()), ("n", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))

    found = one.join(asks, "key").select("text", "lang", "lang_hash", "asks").mapInArrow(cut, "fp long, n int, lang string, phrase string, c long, lo int, hi int")
    return written(found, "phrases-read")


def _by_text(docs: DataFrame, collided: DataFrame, longest: int, least: int, bits: int) -> DataFrame:
    """lang, n, phrase, a: all occurrences of collided fingerprints, counted by text."""
    asked = _filter(collided, "fp")

    def scan(batches):
        for words, rows in (x for batch in batches for x in _words_of(batch)):
            doc_lang = dict(zip(np.asarray(rows.column(2)).astype(np.int64).tolist(), rows.column(3).to_pylist()))
            seen: dict = {}
            for i, j, hashed, start, end, text in words.blocks(longest):
                for n in range(longest + 1):
                    at = words.ngrams(i, j, n) if n else np.arange(j - i)
                    to = end[at + n - 1] if n else start[at]
                    fp = hashed.fingerprints(start[at], to, words.lang[i + at], bits)
                    keep = np.flatnonzero(in_bloom(asked.value, mix64(fp.view(np.uint64))))
                    for f, a, b, mix in zip(fp[keep].tolist(), start[at[keep]].tolist(), to[keep].tolist(), words.lang[i + at[keep]].view(np.int64).tolist()):
                        k = (f, n, doc_lang[mix], text[a:b].tobytes())
                        seen[k] = seen.get(k, 0) + 1
            if seen:
                f, n, lang, phrase = zip(*seen)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(n, pa.int32()), pa.array(lang, pa.string()), pa.array([p.decode() for p in phrase], pa.string()), pa.array(list(seen.values()), pa.int64())], ["fp", "n", "lang", "phrase", "a"])

    rows = docs.select("text", "key", "lang_hash", "lang").mapInArrow(scan, "fp long, n int, lang string, phrase string, a long")
    sums = rows.join(collided, ["fp", "n"], "left_semi").groupBy("lang", "n", "phrase").agg(F.sum("a").alias("a"))
    return sums.where((F.col("a") >= least) | (F.col("n") == 0))


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang", bits: int = 64) -> DataFrame:
    """lang, n, phrase, a: every phrase of up to ``longest`` words with a >= least occurrences in its lang, and for n = 0 each lang's number of words
    (where it has ``least``); written. ``bits`` of a fingerprint are used (tests take few, so that many collide)."""
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    d = small_batches(docs).select(F.col(text).cast("string").alias("text"), name.alias("lang")).where("text is not null")
    d = d.select("text", "lang", F.shiftrightunsigned(F.xxhash64("lang", "text"), 31).alias("key"), F.xxhash64(F.lit(1), "text", "lang").alias("key2"), F.xxhash64("lang").alias("lang_hash"))
    levels, filters = [], []
    for n in range(1, longest + 1):
        levels.append(_counts(d, n, least, filters[-1] if filters else None, bits))
        filters.append(_filter(levels[-1], "fp"))
    every = None
    for n, level in enumerate(levels, 1):
        rows = level.withColumn("level", F.lit(n))
        every = rows if every is None else every.unionByName(rows)
    found = written(every.join(_pointers(d, filters, bits), ["fp", "level"]), "frequent")
    # a lang's empty phrase is in the first level, with a check of 0; read as one, its fingerprint says whether it is
    asks = found.withColumnRenamed("level", "n").unionByName(found.where("level = 1 and lo = 0").drop("level").withColumn("n", F.lit(0)))
    read = _read(d, asks, bits)
    phrases = read.where("lo = hi").select("lang", "n", "phrase", F.col("c").alias("a"))
    # words and empty phrases are counted in one level, longer ones each in their own
    both = F.explode(F.when(F.col("n") <= 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array("n"))).alias("n")
    collided = written(read.where("lo < hi").select("fp", both).distinct(), "collided")
    if collided.limit(1).count():
        phrases = phrases.unionByName(_by_text(d, collided, longest, least, bits))
    out = written(phrases, "phrases")
    for table in (*levels, found, read):
        dropped(table)
    return out


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang", bits: int = 64, salts: int = 32) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``longest`` words of each lang, by score, a (both falling) and phrase.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs. a is how often
    a phrase occurs in its lang, overlaps included; cut behind its first k words its parts occur l and r times; its score is the least floor(10^6 a a / (l r)) over
    cuts, ties to the smallest k. Phrases that lie in a longer one with at least ``share`` percent of their occurrences are left out. n is the lang's
    number of words. All arithmetic is exact.

    A null lang is ``und``; null and empty texts have no words; equal texts and repeated rows count each; very long texts are hashed block by
    block. An empty table gives no rows. Extra columns are ignored. Ranking is dealt over ``salts`` groups first, so a lang of any size fits.
    """
    p = frequent_phrases(docs, longest, least, text, lang, bits)
    words = F.split("phrase", " ")
    sub = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    found = p.where("n >= 2")
    cuts = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("left"), F.array_join(F.slice(words, k + 1, F.col("n") - k), " ").alias("right")))
    parts = found.select("lang", "phrase", "n", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "n", "a", "cut.*")
    known = p.where(F.col("n").between(1, longest - 1))
    side = lambda c, f: known.select("lang", F.col("phrase").alias(c), F.col("a").alias(f))
    parts = parts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    over = (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    parts = parts.withColumn("over", over).withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = parts.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "n", "a", "b.*")
    inner = [sub(F.lit(i), F.lit(m)) for n in range(3, longest + 1) for m in range(2, n) for i in range(1, n - m + 2)]
    where = [(n, m) for n in range(3, longest + 1) for m in range(2, n) for _ in range(1, n - m + 2)]
    if inner:
        longer = found.where("n >= 3").select("lang", "a", F.explode(F.array(*[F.when(F.col("n") == n, s) for (n, _), s in zip(where, inner)])).alias("phrase")).where("phrase is not null")
        longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        best = best.join(longer, ["lang", "phrase"], "left").where((F.col("most").isNull()) | (F.col("most") * 100 < F.col("a") * share))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = p.where("n = 0").select("lang", F.col("a").alias("total"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS piece FROM d)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
i AS (SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM i) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r, (CAST(c.a AS HUGEINT) * c.a * 1000000) // (CAST(x.a AS HUGEINT) * y.a) AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s) WHERE o = 1),
g AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, array_to_string(list_slice(string_split(phrase, ' '), p, p + 1), ' ') AS phrase FROM f, (SELECT unnest([1, 2]) AS p) WHERE k = 3) GROUP BY ALL),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN g ON g.lang = b.lang AND g.phrase = b.phrase WHERE most IS NULL OR 100 * most < 50 * b.a)
SELECT t.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""
