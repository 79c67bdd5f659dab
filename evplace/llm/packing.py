"""Packing by cutting stock: whole pieces of documents fill sequences exactly, by patterns over the histogram of lengths.

A document's ids are cut into full sequences and a rest. A linear program over patterns - bags of rests that fill a sequence to the
last id - asks for as many such sequences as the histogram allows; a knapsack over its prices finds new patterns. The whole part of its
answer is dealt to the rests by their rank among those of their length. What no pattern takes is laid end to end and cut
where sequences end, so nothing is padded; the last few ids go into sequences as long as powers of two.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evplace.llm._shared import small_batches, written

SIZE = 1024
#: Share of more sequences that the linear program may still miss when it stops; its pivots at most; bytes of broadcast ranks.
GAP, PIVOTS, RANKS_BYTES = 1e-3, 400, 32 << 20
#: Words in one generation of a worker's cache, for each tokenizer; it keeps two.
REMEMBERED = 400_000
_encoders: dict = {}
_MORE_SPACE = re.compile(r" (?:\s|\Z)")


def _latin(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) < "ɐ")


class SpacedEncoder(dict):
    """Ids of whole texts as bytes; word by word where the tokenizer's own description allows it.

    A byte-level tokenizer without a normaliser and with its usual pattern joins a space to the word behind it, and no token of it reaches
    over such a space, nor from letters into a mark or a line end. So a text may be cut before every space that stands before a word. Words of
    Latin letters go to the model directly. All else, texts with special tokens, and all texts of other tokenizers go to the library.
    The mapping, from a word to the ids of a space and the word, is the cache.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        t = self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.older, self.bare = np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"), {}, {}
        j = json.loads(t.to_str())
        pre = j["pre_tokenizer"] or {}
        self.by_word = j["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and j["model"]["type"] == "BPE"
        self.special = [x["content"] for x in j["added_tokens"]]
        # the printable form of each byte that byte-level models use: bytes without one are numbered from 256
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}

        self.pack, self.model = (lambda ids, kind="H" if self.dtype.itemsize == 2 else "I": array(kind, ids).tobytes()), t.model
        self.space = chr(self.shown[32])

    def library(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pretoken(self, word: str, before: str = "") -> bytes:
        """Ids of a word of Latin letters, with ``before`` (as the model prints it) in front."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return self.pack([t.id for t in self.model.tokenize(before + shown)])

    def _bare(self, word: str) -> bytes:
        """Ids of a word with nothing before it."""
        ids = self.bare.get(word)
        if ids is None:
            if len(self.bare) > REMEMBERED:
                self.bare.clear()
            ids = self.bare[word] = self._pretoken(word) if _latin(word) else self.library(word)
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            letters = word.rstrip(string.punctuation)
            if _latin(letters):  # and a run of marks, if any, is a piece of its own
                ids = self._pretoken(word, self.space) if letters == word else self[letters] + self._bare(word[len(letters) :])
            elif "\n" in word and all(len(x.split()) == 1 and x == x.strip() for x in word.split("\n")):
                first, *lines = word.split("\n")
                ids = self[first] + b"".join(self._bare("\n") + self._bare(x) for x in lines)
            else:
                ids = self.library(" " + word)
        self[word] = ids
        return ids

    def __call__(self, text: str | None, end: bytes) -> bytes:
        if not text:
            return end
        if not self.by_word or any(x in text for x in self.special):
            return self.library(text) + end
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        first, *words = text.split(" ")
        if _MORE_SPACE.search(text):  # it stays with what is before it
            joined = [first]
            for w in words:
                if w and not w[0].isspace():
                    joined.append(w)
                else:
                    joined[-1] += " " + w
            first, *words = joined
        return self._bare(first) * bool(first) + b"".join(map(self.__getitem__, words)) + end


def _encoder(path: str) -> SpacedEncoder:
    if path not in _encoders:
        _encoders[path] = SpacedEncoder(path)
    return _encoders[path]


def document_pieces(docs: DataFrame, tokenizer_path: str, doc_id: str, text: str, end_id: int, size: int) -> DataFrame:
    """id, start, length, doc_tokens, ids (bytes), part, k of every document cut at each ``size`` ids, written.

    k counts the pieces of one length in the task that wrote them, part; a task that runs again writes the same.
    """
    def cut(batches):
        encode, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        width, end = encode.dtype.itemsize, np.array([end_id], encode.dtype).tobytes()
        seen = [0] * (size + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                place, start, length, total, ids, k = [], [], [], [], [], []
                for i, t in enumerate(rows.column(1).to_pylist()):
                    own = encode(t, end)
                    n = len(own) // width
                    for s in range(0, n, size):
                        m = min(size, n - s)
                        place.append(i), start.append(s), length.append(m), total.append(n), ids.append(own[s * width : (s + m) * width]), k.append(seen[m])
                        seen[m] += 1
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(place, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(total, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(k), pa.int32()), pa.array(k, pa.int64())],
                    ["id", "start", "length", "doc_tokens", "ids", "part", "k"])
        encode.older = {}  # the worker lives on, with the younger words

    rows = small_batches(docs).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, start long, length int, doc_tokens long, ids binary, part int, k long"), "pieces")


def cheapest_fill(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: for each sum up to ``size`` the least price of lengths (falling) that add up to it, and the last of them."""
    cost, last = np.full(size + 1, np.inf), np.full(size + 1, -1)
    cost[0] = 0
    first = np.searchsorted(-lengths, -np.arange(size + 1))
    for c in range(1, size + 1):
        i = first[c]
        if i < len(lengths):
            v = cost[c - lengths[i:]] + prices[i:]
            j = int(v.argmin())
            cost[c], last[c] = v[j], i + j
    return cost, last


def greedy_fills(have: np.ndarray, size: int, whole: bool) -> list[tuple[tuple[int, ...], float, list[int]]]:
    """(two or three lengths that fill ``size``, times, those used up by it), the greatest length first and with it the most plentiful others, until it has no others; have[length] is used up."""
    out, open_ = [], have[:size] > (0.5 if whole else 1e-9)
    while open_.any():
        length = int(np.flatnonzero(open_)[-1])
        left = size - length
        a = np.arange(left // 2 + 1)
        pair = np.minimum(np.where(a > 0, have[a], np.inf), have[left - a])
        use = lambda i: Counter(x for x in (length, int(i), int(left - i)) if x)
        best = int(pair.argmax())
        pattern = use(best)
        times = min(have[x] / n for x, n in pattern.items())
        times = float(np.floor(times + 1e-9)) if whole else times
        if times <= (0 if whole else 1e-9):
            open_[length] = False
            continue
        for x, n in pattern.items():
            have[x] -= n * times
            open_[x] &= have[x] > (0.5 if whole else 1e-9)
        out.append((tuple(pattern.elements()), times, [x for x in pattern if not open_[x]]))
    return out


def fill_patterns(counts: np.ndarray, size: int = SIZE, gap: float = GAP, pivots: int = PIVOTS) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length, times) of the patterns to realise, from counts[length] for lengths under ``size``: each fills ``size`` exactly.

    Column generation: a revised simplex method over patterns and leftovers, whose prices go to the knapsack; every pattern that it finds under
    par is a column. It starts from a greedy filling, each of whose patterns uses up a length and so stands for it in the basis. It stops at a proven ``gap``, or
    after ``pivots``: then more documents are cut, none is lost. Then times are rounded down, and patterns, old and greedy, are used while pieces last.
    """
    lengths = np.flatnonzero(counts[:size])[::-1]
    if not len(lengths):
        return []
    m, place = len(lengths), {int(x): i for i, x in enumerate(lengths)}
    demand = counts[lengths] + np.random.default_rng(0).random(m) * 1e-3  # no ties in the ratio test

    def column(pattern) -> np.ndarray:
        out = np.zeros(m)
        for x in pattern:
            out[place[int(x)]] += 1
        return out

    have = np.zeros(size + 1)
    have[lengths] = demand
    basis, start, columns = [-1 - i for i in range(m)], [], []
    for pattern, _, up in greedy_fills(have, size, False):
        used = next((place[x] for x in up if basis[place[x]] < 0), None)
        if used is not None:
            basis[used] = len(columns)
            columns.append(column(pattern))
    columns = np.column_stack(columns) if columns else np.empty((m, 0))
    inverse = np.eye(m)
    for r, b in enumerate(basis):
        if b >= 0:
            inverse[:, r] = columns[:, b]
    inverse = np.linalg.inv(inverse)
    gains = np.array([1.0 if b >= 0 else 0.0 for b in basis])
    x = np.maximum(inverse @ demand, 0)
    done = 0
    while done < pivots:
        prices = np.maximum(gains @ inverse, 0)
        cost, last = cheapest_fill(lengths, prices, size)
        # prices over the cheapest pattern's are a bound on any filling
        if not np.isfinite(cost[size]) or cost[size] > 1e-9 and prices @ demand / cost[size] <= (1 + gap) * (gains @ x):
            break
        with_each, fresh = cost[size - lengths] + prices, []
        for i in np.argsort(with_each, kind="stable")[:100]:
            if with_each[i] >= 1 - 1e-9:
                break
            pattern, c = [lengths[i]], size - int(lengths[i])
            while c:
                pattern.append(lengths[last[c]])
                c -= int(lengths[last[c]])
            fresh.append(column(pattern))
        # columns out of the basis are found again if they are worth it
        used = [b for b in basis if b >= 0]
        columns = np.column_stack([columns[:, used], *fresh])
        basis = [b if b < 0 else used.index(b) for b in basis]
        moved = False
        while done < pivots:
            prices = gains @ inverse
            gain = np.concatenate([1 - prices @ columns, -prices])
            p = int(gain.argmax())
            if gain[p] < 1e-9:
                break
            pattern, s = p < columns.shape[1], p - columns.shape[1]
            u = inverse @ columns[:, p] if pattern else inverse[:, s].copy()
            ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
            r = int(ratio.argmin())
            if not np.isfinite(ratio[r]):
                break
            x -= ratio[r] * u
            x[r] = ratio[r]
            np.maximum(x, 0, out=x)
            row = inverse[r] / u[r]
            inverse -= np.outer(u, row)
            inverse[r] = row
            basis[r], gains[r] = (p, 1.0) if pattern else (-1 - s, 0.0)
            done, moved = done + 1, True
        if not moved:
            break
    times = np.zeros(columns.shape[1], np.int64)
    for b, v in zip(basis, x):
        if b >= 0:
            times[b] = int(np.floor(v))
    whole, left = columns.astype(np.int64), counts[lengths].astype(np.int64)
    planned = times.copy()
    times[:] = 0
    for wanted in (planned, None):  # what the program says, then what is possible
        for p in np.argsort(-planned, kind="stable"):
            uses = whole[:, p] > 0
            t = int((left[uses] // whole[uses, p]).min())
            t = t if wanted is None else min(t, int(wanted[p]))
            times[p] += t
            left -= t * whole[:, p]
    have[:] = 0
    have[lengths] = left
    out = [({int(lengths[i]): int(whole[i, p]) for i in np.flatnonzero(whole[:, p])}, int(times[p])) for p in np.flatnonzero(times)]
    return out + [(dict(Counter(pattern)), int(t)) for pattern, t, _ in greedy_fills(have, size, True)]


class Plan:
    """Where the piece of a length and a rank goes: slots of patterns, then a stream of leftovers. At most size patterns of few lengths each are used often, so it is small."""

    def __init__(self, counts: np.ndarray, size: int):
        self.size, self.full = size, int(counts[size])
        slots, at = [], self.full
        taken = np.zeros(size + 1, np.int64)
        for pattern, times in fill_patterns(counts, size):
            offset = 0
            for length, many in sorted(pattern.items(), reverse=True):
                slots.append((length, int(taken[length]), times * many, at, many, offset))
                taken[length] += times * many
                offset += length * many
            at += times
        slots.sort()
        self.slots = np.array(slots, np.int64).reshape(-1, 6)
        self.keys = (self.slots[:, 0] << 50) + self.slots[:, 1]
        self.taken = taken
        lengths = np.arange(size + 1)
        rest = np.where(lengths < size, counts - taken, 0)
        self.stream = np.concatenate([[0], np.cumsum(rest * lengths)])[:-1]
        total = int((rest * lengths).sum())
        self.first_rest = at
        # where the stream is cut behind its last full sequence: sequences as long as the powers of two in what is left
        self.tail = total - total % size
        self.tail_ends, done = [], self.tail
        for bit in reversed(range(int(size).bit_length())):
            if (total % size) >> bit & 1:
                done += 1 << bit
                self.tail_ends.append(done)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of pieces that stay whole, -1 and the place in the stream for the others."""
        sequence, offset = np.where(length == self.size, rank, -1), np.zeros(len(length), np.int64)
        rest = length < self.size
        inside = np.flatnonzero(rest & (rank < self.taken[length]))
        if len(inside):
            e = self.slots[np.searchsorted(self.keys, (length[inside] << 50) + rank[inside], "right") - 1]
            within = rank[inside] - e[:, 1]
            sequence[inside] = e[:, 3] + within // e[:, 4]
            offset[inside] = e[:, 5] + within % e[:, 4] * e[:, 0]
        over = np.flatnonzero(rest & (rank >= self.taken[length]))
        offset[over] = self.stream[length[over]] + (rank[over] - self.taken[length[over]]) * length[over]
        return sequence, offset

    def cuts(self, at: int, length: int) -> list[tuple[int, int, int, int]]:
        """(sequence_id, offset, from, to) of the parts of a leftover piece at a place of the stream."""
        out, done = [], 0
        while done < length:
            p = at + done
            if p < self.tail:
                start, end, sequence = p - p % self.size, p - p % self.size + self.size, self.first_rest + p // self.size
            else:
                i = next(i for i, e in enumerate(self.tail_ends) if p < e)
                start, end, sequence = (self.tail_ends[i - 1] if i else self.tail), self.tail_ends[i], self.first_rest + self.tail // self.size + i
            to = min(length, done + end - p)
            out.append((sequence, p - start, done, to))
            done = to
        return out


def packed(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids (little-endian, 16 bits if the vocabulary fits, else 32), doc_tokens, sequence_id, offset: one row for each piece.

    Every id of every document (its text's, then ``end_id``) lies in one piece, pieces of a sequence lie end to end, and all sequences have ``size`` ids but
    for at most one of each smaller power of two. Only lengths and ranks travel: ids stay in the rows in which they were
    written. A histogram of at most ``size`` numbers reaches the driver. Null and empty texts are the end id alone. Rows with one doc_id, or none, are
    documents of their own, equal texts too. An empty table gives no rows. Extra columns are ignored. A document is cut where it
    fills sequences of its own, and where it holds the end of a sequence of leftovers.
    """
    if size < 2 or size & (size - 1):
        raise ValueError("the size of a sequence must be a power of two")
    pieces = document_pieces(docs, tokenizer_path, doc_id, text, end_id, size)
    counts = written(pieces.groupBy("part", "length").agg((F.max("k") + 1).alias("n")), "lengths")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    shared = docs.sparkSession.sparkContext.broadcast(Plan(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranks = ranks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("bases"))
    ranks = F.broadcast(ranks) if counts.count() * 16 <= RANKS_BYTES else ranks
    ranked = pieces.join(ranks, "part").select("id", "start", "length", "doc_tokens", "ids", (F.col("bases")[F.col("length")] + F.col("k")).alias("rank"))

    def deal(batches):
        plan = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)).astype(np.int64) for i in (2, 5))
            sequence, offset = plan.place(length, rank)
            whole = np.flatnonzero(sequence >= 0)
            names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(whole)) for i in (0, 1, 2, 4, 3)), pa.array(sequence[whole]), pa.array(offset[whole])], names)
            cut = [(i, *c) for i in np.flatnonzero(sequence < 0).tolist() for c in plan.cuts(int(offset[i]), int(length[i]))]
            if cut:
                at = pa.array([c[0] for c in cut])
                start, own = batch.column(1).take(at).to_pylist(), batch.column(4).take(at).to_pylist()
                width = [len(o) // int(length[c[0]]) for o, c in zip(own, cut)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), pa.array([s + c[3] for s, c in zip(start, cut)], pa.int64()), pa.array([c[4] - c[3] for c in cut], pa.int32()), pa.array([o[w * c[3] : w * c[4]] for o, w, c in zip(own, width, cut)], pa.binary()),
                    batch.column(3).take(at), pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.int64())], names)

    out = ranked.mapInArrow(deal, f"id {ranked.schema['id'].dataType.simpleString()}, start long, length int, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", doc_id)


def sequences(pieces: DataFrame, size: int = SIZE, pad: bytes = b"\0\0") -> DataFrame:
    """sequence_id, length (ids), ids of each sequence, filled with ``pad`` (one id's bytes) up to ``size``, except at a power of two: a row holds ``size`` ids at most."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").cast("int").alias("length"))
    ids = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    exact = F.expr("length & (length - 1)") == 0
    return rows.select("sequence_id", "length", F.rpad(ids, F.when(exact, F.col("length")).otherwise(size) * len(pad), F.lit(pad)).alias("ids"))


def with_checksums(pieces: DataFrame) -> DataFrame:
    """Pieces with ids_crc32, of their ids as 32-bit integers, in place of ids."""
    def check(batches):
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(i, "<u2" if len(i) == 2 * n else "<u4").astype("<u4").tobytes()) for i, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(crc, pa.int64()), *(batch.column(i) for i in (4, 5, 6))], [batch.schema.names[0], "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    first = pieces.schema[0]
    return pieces.mapInArrow(check, f"`{first.name}` {first.dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op11_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return with_checksums(packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")))
