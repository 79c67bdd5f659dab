"""LM scoring: a hashed maximum-entropy model with a class-factored softmax, trained by distributed gradient updates."""

from __future__ import annotations

import math
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evplace.llm._shared import small_batches, written

#: Words whose counts every worker holds (a fixed bound on what is broadcast); others meet their counts in a join.
HELD = 1 << 18
#: Classes of frequent words, and words in a class: these have feature weights of their own.
CLASSES, IN_CLASS = 32, 32
#: Classes by rank of the other held words; one more takes all rarer and unknown words.
BANDS = 8
#: Hashed rows of the class table and of the word table, at least and at most; between, as many as there are distinct features.
LEAST_ROWS, MOST_ROWS = (1 << 13, 1 << 14), (1 << 16, 1 << 16)
#: One of so many hashes of features is counted to tell how many there are.
COUNTED = 256
#: Blocks of a table when weights are averaged, and input partitions that one training task reads.
BLOCKS, TOGETHER = 128, 4
#: Rounds of gradient updates, each over its own share of the training texts, then averaged.
ROUNDS = 2
FEATURES = 5
END = b""
TOKENS = 8192
#: Rows of a table that a step changes at once, and what the squared length of a row's gradient counts by.
CACHED, SHARE = 512, np.float32(1 / 16)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text lower-cased in A-Z, then the end."""
    out = text.encode().lower().split() if text else []
    out.append(END)
    return out


def _coded(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words of texts as tokens() has them (the end is the last one), the number of each token's, and its text's."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, doc = pieces.flatten(), np.asarray(pc.list_parent_indices(pieces)).astype(np.int64)
    some = np.asarray(pc.greater(pc.binary_length(flat), 0))  # white space at either end leaves empty pieces
    coded = flat.filter(pa.array(some)).dictionary_encode()
    words = [*coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), END]
    doc = doc[some]
    at = np.arange(len(doc)) + doc  # an end follows the words of each text
    code = np.full(len(doc) + len(texts), len(words) - 1, np.int64)
    code[at] = np.asarray(coded.indices)
    return words, code, np.repeat(np.arange(len(texts)), np.bincount(doc, minlength=len(texts)) + 1)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def _slices(batch, size: int = 1_500_000):
    """Texts of a batch in runs of about so many characters."""
    at, chars = 0, 0
    column = batch.column(1)
    for i in range(batch.num_rows):
        chars += len(column[i].as_buffer() or b"") if column[i].is_valid else 0
        if chars > size:
            yield batch.slice(at, i + 1 - at)
            at, chars = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def word_counts(texts: DataFrame) -> DataFrame:
    """feature, word (binary, empty: the end), c over all texts (id, text); counted in tasks before the shuffle.

    Rows with a feature (and no word) are those of one in COUNTED hashes of features; a task whose own ones tell that tables are as large as they get looks for no more.
    """
    def rows(features, words, counts):
        return pa.RecordBatch.from_arrays([pa.array(features, pa.int64()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["feature", "word", "c"])

    def count(batches):
        from collections import Counter

        c: Counter = Counter()
        some: set[int] = set()
        enough = False
        for batch in batches:
            for part in _slices(batch):
                words, code, doc = _coded(part.column(1))
                c.update(dict(zip(words, np.bincount(code, minlength=len(words)).tolist())))
                if not enough:
                    f = _features(np.array([zlib.crc32(w) for w in words], np.int64)[code], doc)
                    some.update(f[f % np.uint64(COUNTED) == 0].tolist())
                    enough = COUNTED * len(some) >= max(MOST_ROWS)
                if len(c) > 300_000:
                    yield rows([None] * len(c), list(c), list(c.values()))
                    c.clear()
        if c or some:
            yield rows([None] * len(c) + list(some), list(c) + [None] * len(some), list(c.values()) + [0] * len(some))

    return texts.select("id", "text").mapInArrow(count, "feature long, word binary, c long").groupBy("feature", "word").agg(F.sum("c").alias("c"))


def table_rows(features: int) -> tuple[int, int]:
    """Rows of the class table and of the word table for so many distinct features."""
    return tuple(min(max(1 << max(features - 1, 0).bit_length(), a), b) for a, b in zip(LEAST_ROWS, MOST_ROWS))


class Vocabulary:
    """The most frequent words with counts, in order; classes follow from ranks."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int):
        self.rank = {w: i for i, w in enumerate(words)}
        self.counts, self.n, self.v = counts.astype(np.int64), n, v
        head = CLASSES * IN_CLASS
        self.head = min(head, len(words))
        # bands halve the logarithm of the rank; the last class is that of all words that aren't held
        edges = np.unique(np.geomspace(head, max(HELD, head + 1), BANDS + 1).astype(np.int64))
        r = np.arange(len(words))
        self.cls = np.where(r < head, r // IN_CLASS, CLASSES + np.clip(np.searchsorted(edges, r, side="right") - 1, 0, BANDS - 1)).astype(np.int64)
        self.classes = CLASSES + BANDS + 1
        self.rare = self.classes - 1
        mass = np.bincount(self.cls, weights=self.counts + 1.0, minlength=self.classes)
        # a word of a band within its band: by count, plus one as in the base; rare words share what is left, unknown ones too
        self.rare_mass = float(n + v - (self.counts + 1).sum() + 1)
        self.in_band = np.log10((self.counts + 1.0) / np.maximum(mass[self.cls], 1.0))
        self.log_c1 = np.log10(self.counts + 1.0)
        #: words in each class of frequent words
        self.members = np.clip(self.head - IN_CLASS * np.arange(CLASSES), 0, IN_CLASS)
        self.priors = np.log(np.maximum(np.append(mass[:-1], self.rare_mass), 1e-6) / max(n + v + 1, 1)).astype(np.float32)
        self.word_prior = np.full((CLASSES, IN_CLASS), -40.0, np.float32)
        flat = np.log((self.counts[: self.head] + 1.0) / mass[self.cls[: self.head]])
        self.word_prior.reshape(-1)[: self.head] = flat
        #: as context, every word is itself, by a hash of 32 bits
        self.context = np.array([zlib.crc32(w) for w in words], dtype=np.int64)


def _indexed(vocabulary: Vocabulary, texts: pa.Array):
    """Ranks (-1: not held), context symbols and text numbers of all tokens, the places of those not held, and different words and the number of each token's.

    What is looked up or hashed is each different word, once: words recur, and a large dictionary is slow to ask.
    """
    words, code, doc = _coded(texts)
    rank = np.fromiter(map(vocabulary.rank.get, words, repeat(-1)), np.int64, len(words))
    context = vocabulary.context[rank] if len(vocabulary.context) else np.zeros(len(rank), np.int64)
    others = np.flatnonzero(rank < 0)
    context[others] = [zlib.crc32(words[i]) for i in others.tolist()]
    rank, context = rank[code], context[code]
    return rank, context, doc, np.flatnonzero(rank < 0), words, code


def _features(context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashed feature of each token, [token, FEATURES]: none, the word before, the two before, and the second and third before (skips)."""
    n = len(context)
    start = np.ones(n, dtype=bool)
    start[1:] = doc[1:] != doc[:-1]
    since = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
    back = []
    for k in (1, 2, 3):
        prev = np.zeros(n, dtype=np.int64)
        prev[k:] = context[:-k] + 1
        prev[since < k] = 0
        back.append(prev.astype(np.uint64))
    a, b, c = back
    mul = np.uint64(0x9E3779B97F4A7C15)
    keys = [np.zeros(n, np.uint64), a * np.uint64(5) + np.uint64(1), (a * np.uint64(0xC2B2AE3D27D4EB4F) + b) * np.uint64(5) + np.uint64(2), b * np.uint64(5) + np.uint64(3), c * np.uint64(5) + np.uint64(4)]
    return np.stack([(k * mul) >> np.uint64(32) for k in keys], axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    # sums of rows as a product, and greatest values only of rows that need them: reductions along short rows are slow
    with np.errstate(over="ignore"):
        p = np.exp(z)
    total = p @ np.ones(z.shape[1], np.float32)
    odd = np.flatnonzero(~((total > 1e-20) & (total < 1e30)))
    if len(odd):
        p[odd] = np.exp(z[odd] - z[odd].max(axis=1, keepdims=True))
        total[odd] = p[odd].sum(axis=1)
    p /= total[:, None]
    return p


class Model:
    """Feature weights for classes, and for the words of a class; hashed to ``rows`` of each table, powers of two."""

    def __init__(self, vocabulary: Vocabulary, rows: tuple[int, int] = LEAST_ROWS):
        self.v = vocabulary
        self.of_class = np.zeros((rows[0], vocabulary.classes), np.float32)
        self.of_word = np.zeros((rows[1], IN_CLASS), np.float32)

    def rows(self, f: np.ndarray, cls: np.ndarray | None = None) -> np.ndarray:
        """Row of each token and feature, [feature, token], uint16."""
        if cls is None:
            return np.ascontiguousarray((f & np.uint64(len(self.of_class) - 1)).astype(np.uint16).T)
        return np.ascontiguousarray((((f + cls[:, None].astype(np.uint64) * np.uint64(0x632BE5AB)) * np.uint64(0x85EBCA6B) >> np.uint64(7)) & np.uint64(len(self.of_word) - 1)).astype(np.uint16).T)

    @staticmethod
    def _sum(table, rows):
        # the first feature is the same for all tokens of a class: few rows, which stay in the processor's cache
        z = table.take(rows[0], axis=0)
        part = np.empty_like(z)
        for r in rows[1:]:
            z += table.take(r, axis=0, out=part, mode="clip")
        return z

    def class_probs(self, rows):
        z = self._sum(self.of_class, rows)
        z += self.v.priors
        return _softmax(z)

    def word_probs(self, rows, cls):
        z = self._sum(self.of_word, rows)
        z += self.v.word_prior[cls]
        return _softmax(z)

    def log10(self, rank: np.ndarray, f: np.ndarray) -> np.ndarray:
        """log10 probability of each token; of a token that isn't held, only that of its class."""
        v, out = self.v, np.empty(len(rank))
        for at in range(0, len(rank), TOKENS):
            r, g = rank[at : at + TOKENS], f[at : at + TOKENS]
            cls = np.where(r < 0, v.rare, v.cls[np.maximum(r, 0)] if len(v.cls) else v.rare)
            p = np.log10(np.maximum(self.class_probs(self.rows(g))[np.arange(len(r)), cls], 1e-30, dtype=np.float64))
            some = np.flatnonzero((r >= 0) & (r < v.head))
            if len(some):
                q = self.word_probs(self.rows(g[some], cls[some]), cls[some])
                p[some] += np.log10(np.maximum(q[np.arange(len(some)), r[some] % IN_CLASS], 1e-30, dtype=np.float64))
            band = np.flatnonzero(r >= v.head)
            p[band] += v.in_band[r[band]]
            out[at : at + TOKENS] = p
        return out

    def train(self, rank: np.ndarray, f: np.ndarray, state: list, rate: float) -> None:
        """Adagrad steps over minibatches of TOKENS tokens; ``state`` has a number for each row of the two tables."""
        v = self.v
        for at in range(0, len(rank), TOKENS):
            r, g = rank[at : at + TOKENS], f[at : at + TOKENS]
            cls = np.where(r < 0, v.rare, v.cls[np.maximum(r, 0)])
            rows = self.rows(g)
            p = self.class_probs(rows)
            p[np.arange(len(r)), cls] -= 1
            _descend(self.of_class, state[0], rows, p, rate)
            some = np.flatnonzero((r >= 0) & (r < v.head))
            if len(some):
                rows = self.rows(g[some], cls[some])
                q = self.word_probs(rows, cls[some])
                q[np.arange(len(some)), r[some] % IN_CLASS] -= 1
                _descend(self.of_word, state[1], rows, q, rate)


def _descend(table, squares, rows, gradient, rate):
    """An Adagrad step for each feature in turn: a table's row moves by the sum of the gradients of all tokens that use it; rows are [feature, token].

    A row has one step size, by the squared lengths of its sums so far: a size for each weight costs more and predicts about as well.
    Rows are in descending order of their tokens, so sums take the first token of each row as it is and add the next ones to ever shorter
    beginnings, while many rows have as many; what is left of the few very frequent rows is summed run by run.
    """
    room = np.empty((CACHED, gradient.shape[1]), np.float32)
    # a row as one element, which is written whole
    whole = lambda x: x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    for r in rows:
        order = np.argsort(r, kind="stable")
        r = r[order]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        less = -np.diff(np.append(first, len(r)))
        by = np.argsort(less, kind="stable")
        first, less = first[by], less[by]
        total = gradient.take(order[first], axis=0)
        done, many = 1, int(np.searchsorted(less, -1))
        while many >= 48:
            total[:many] += gradient.take(order[first[:many] + done], axis=0)
            done += 1
            many = int(np.searchsorted(less, -done))
        if len(first) == 1:
            np.einsum("ij->j", gradient, out=total[0])  # one row for all, in any order
        elif many:
            n = -less[:many] - done
            ends = np.cumsum(n)
            rest = order[np.repeat(first[:many] + done - (ends - n), n) + np.arange(ends[-1])]
            total[:many] += np.add.reduceat(gradient.take(rest, axis=0), ends - n, axis=0)
        at = r[first].astype(np.intp)
        squares[at] += SHARE * np.einsum("ij,ij->i", total, total)
        total *= (np.float32(rate) / np.sqrt(squares[at]))[:, None]
        # some rows at a time, which stay in the processor's cache from one step to the next
        for lo in range(0, len(at), CACHED):
            some = at[lo : lo + CACHED]
            s = room[: len(some)]
            table.take(some, axis=0, out=s, mode="clip")
            s -= total[lo : lo + CACHED]
            whole(table).put(some, whole(s), mode="clip")


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, rate: float = 0.25, rows: tuple[int, int] = LEAST_ROWS) -> Model:
    """Gradient updates on the executors: each round's tasks start from the shared weights, descend over
    all their texts, and their weights are averaged by tokens read. Rounds split the texts by a hash, so
    every text is used once. A task reads several partitions, so that weights are few beside texts. They are averaged block by block on the
    executors, in two steps of as many groups as the square root of the tasks, so that no group holds every task's; only the means, of the
    tables' size, reach the driver.
    """
    spark = texts.sparkSession
    model = Model(vocabulary, rows)
    shared = spark.sparkContext.broadcast(vocabulary)
    for k in range(rounds):
        start = spark.sparkContext.broadcast((model.of_class, model.of_word))

        def descend(batches):
            own, n = Model(shared.value), 0
            own.of_class, own.of_word = (x.copy() for x in start.value)
            state = [np.ones(len(x), np.float32) for x in (own.of_class, own.of_word)]
            for batch in batches:
                for part in _slices(batch):
                    rank, context, doc, *_ = _indexed(own.v, part.column(1))
                    own.train(rank, _features(context, doc), state, rate)
                    n += len(rank)
            if n:
                blocks = [b for x in (own.of_class, own.of_word) for b in np.array_split(x, BLOCKS)]
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(blocks)), pa.int32()), pa.array([task] * len(blocks), pa.int32()), pa.array([n] * len(blocks), pa.int64()), pa.array([b.astype(np.float32).tobytes() for b in blocks], pa.binary())],
                    ["block", "task", "n", "w"])

        def average(pdf):
            import pandas as pd

            n = pdf["n"].to_numpy(dtype=np.float64)
            total = sum(np.frombuffer(w, np.float32) * (m / n.sum()) for w, m in zip(pdf["w"], n))
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "n": [int(n.sum())], "w": [total.astype(np.float32).tobytes()]})

        mine = texts.where(F.pmod(F.xxhash64(F.coalesce("id", F.lit(0)), F.lit(17)), F.lit(rounds)) == k).select("id", "text")
        parts = mine.rdd.getNumPartitions()
        mine = mine.coalesce(max(1, min(parts, spark.sparkContext.defaultParallelism), -(-parts // TOGETHER)))
        fan = max(1, math.isqrt(mine.rdd.getNumPartitions()))
        mean = mine.mapInArrow(descend, "block int, task int, n long, w binary")
        if fan > 1:
            mean = mean.groupBy("block", (F.col("task") % fan).alias("part")).applyInPandas(average, "block int, n long, w binary")
        got = {r.block: np.frombuffer(r.w, np.float32) for r in mean.groupBy("block").applyInPandas(average, "block int, n long, w binary").collect()}
        if got:
            model.of_class = np.concatenate([got[i] for i in range(BLOCKS)]).reshape(model.of_class.shape)
            model.of_word = np.concatenate([got[i] for i in range(BLOCKS, 2 * BLOCKS)]).reshape(model.of_word.shape)
        start.unpersist()
    return model


def _least_count(counts: DataFrame, held: int) -> int:
    """The least count at which no more than ``held`` words remain.

    Eight bins to each doubling are listed first, then the counts in the one bin where it must lie: some hundreds of rows each time.
    """
    binned = counts.withColumn("bin", F.floor(F.log2("c") * 8))
    above, least = 0, 1 << 62
    for r in binned.groupBy("bin").agg(F.count("*").alias("w"), F.min("c").alias("c")).orderBy(F.desc("bin")).collect():
        if above + r.w > held:
            for x in binned.where(F.col("bin") == r.bin).groupBy("c").agg(F.count("*").alias("w")).orderBy(F.desc("c")).collect():
                above += x.w
                if above > held:
                    break
                least = x.c
            break
        above, least = above + r.w, r.c
    return least


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held: int = HELD, rounds: int = ROUNDS, rate: float = 0.25) -> DataFrame:
    """One row for each document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(doc_id) mod 7 is 2 (null doc_id: that of '') are held out; all others are
    counted and train the model, whole. base_score is the add-one unigram log10 probability, score the model's: a
    class (32 classes of 32 frequent words, bands of rarer words by rank, and one of all words that
    are not held or unknown) by a softmax over hashed features of the three words before, then the word in its class by
    another softmax, or for bands by its count. Both spread their probability over V + 1 words, so they compare.
    Counts of up to ``held`` words are broadcast; texts meet the counts of their other words by an
    equi-join. Null and empty texts are the end alone. Repeated rows count as often as they occur. Ids that are no whole numbers are null.
    With no training text N and V are 0. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    d = small_batches(docs).select(F.col(doc_id).try_cast("long").alias("id"), F.col(text).alias("text"))
    training = d.where(~held_out(F.col("id")))
    counted = written(word_counts(training), "counts")
    distinct = COUNTED * counted.where("feature is not null").count()
    counts = counted.where("feature is null").select("word", "c")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = _least_count(counts, held)
    top = counts.where(F.col("c") >= least).toPandas().sort_values(["c", "word"], ascending=[False, True])
    vocabulary = Vocabulary([bytes(w) for w in top["word"]], top["c"].to_numpy(dtype=np.int64), n, v)
    del top
    model = spark.sparkContext.broadcast(train(training, vocabulary, rounds, rate, table_rows(distinct)))
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("others", pa.list_(pa.binary()))])

    def score(batches):
        m = model.value
        for batch in batches:
            for part in _slices(batch):
                rank, context, doc, out, words, code = _indexed(m.v, part.column(1))
                k = part.num_rows
                total = np.bincount(doc, minlength=k)
                lp = m.log10(rank, _features(context, doc))
                base = np.where(rank >= 0, m.v.log_c1[rank] if len(m.v.log_c1) else 0.0, 0.0)
                others = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(doc[out], minlength=k))]).astype(np.int32), pa.array(words, pa.binary()).take(pa.array(code[out])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total, pa.int64()), pa.array(np.bincount(doc, weights=rank >= 0, minlength=k).astype(np.int64)), pa.array(np.bincount(doc, weights=base, minlength=k)),
                     pa.array(np.bincount(doc, weights=lp, minlength=k)), others], schema=schema)

    first = written(d.mapInArrow(score, "id long, n_tokens long, known long, base double, model double, others array<binary>").withColumn("row", F.monotonically_increasing_id()), "scores")
    rest = first.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count("*").alias("f")).join(counts, "word", "left")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("f")).otherwise(0)).alias("more"), F.sum("f").alias("f"),
        F.sum(F.col("f") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("log_c1"))
    all_, rare = F.lit(float(np.log10(n + v + 1))), F.lit(float(np.log10(vocabulary.rare_mass)))
    added = F.coalesce("log_c1", F.lit(0.0))
    return first.drop("others").join(rest, "row", "left").select(
        F.col("id").alias(doc_id), held_out(F.col("id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + added - F.col("n_tokens") * all_).alias("base_score"),
        (F.col("model") + added - F.coalesce("f", F.lit(0)) * rare).alias("score"))


def op1_lm_scores(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
