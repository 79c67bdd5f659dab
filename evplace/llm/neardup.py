"""MinHash near-duplicates by an LSH forest: sorted signature orders, neighbours by common prefix."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evplace.llm._shared import WordHashes, bloom_of, dropped, in_bloom, mix64, small_batches, written
from evplace.llm.components import components

#: Trees, hashes in a tree's order, and the shortest prefix at which neighbours are looked for.
TREES, DEPTH, LEAST = 32, 8, 6
#: A region of a tree with more sets is cut at its next hash.
REGION = 256
#: Successors in a tree's order with which a set is paired.
NEAR = 4
#: Sets in one group when a family is confirmed.
BLOCK = 512
_hashes = WordHashes()


def shingle_sets(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts end to end, and the n+1 offsets of the texts.

    Shingles are ``shingle`` consecutive words, lower-cased in A-Z; a text of fewer words, but not none,
    is one shingle; its hash also takes their number, so it never equals that of a longer text.
    """
    words = [t.encode().lower().split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    h = _hashes([w for ws in words for w in ws])
    made = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), made)
    first = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(first[-1]) - first[:-1][doc] + ends[:-1][doc]
    size = np.minimum(n, shingle)[doc]
    g = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if len(h):
        for k in range(shingle):
            here = k < size
            nxt = h[np.minimum(at + k, len(h) - 1)]
            g = np.where(here, mix64(g * np.uint64(31) + nxt), g)
    # distinct in each text: sort by text and hash
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int64)


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240611)
    return rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def signatures(sets: np.ndarray, ends: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Min-hashes (uint32) of non-empty sets, [set, tree * depth]."""
    a, b = _multipliers(trees * depth)
    x = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(ends) - 1, trees * depth), dtype=np.uint32)
    for i in range(trees * depth):
        out[:, i] = np.minimum.reduceat(x * a[i] + b[i], ends[:-1])
    return out


def _blocks(batch, words: int = 100_000):
    """Rows of a batch in slices of about so many words, so long texts don't pile up."""
    size, at = 0, 0
    lengths = np.asarray(pc.fill_null(pc.utf8_length(batch.column(1)), 0))
    for i, c in enumerate(lengths):
        size += int(c) // 6 + 1
        if size >= words:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def sketches(docs: DataFrame, shingle: int, trees: int, depth: int, least: int) -> DataFrame:
    """id, n (set size), set_key (128-bit digest of the set), heads, tails, bits for every row (id, text).

    heads: for each tree its first ``least`` hashes as one long; tails: its other hashes;
    bits: two bits of every hash, which tell roughly how similar two sets are.
    """
    longs = 2 * trees * depth // 64 + 1
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int32())), ("bits", pa.list_(pa.int64()))])
    lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())

    def make(batches):
        for batch in batches:
            for part in _blocks(batch):
                sets, ends = shingle_sets(part.column(1).to_pylist(), shingle)
                n = np.diff(ends)
                some = np.flatnonzero(n)
                keys = [hashlib.blake2b(sets[ends[i] : ends[i + 1]].tobytes(), digest_size=16).digest() if n[i] else None for i in range(len(n))]
                heads, tails = np.zeros((len(n), trees), np.int64), np.zeros((len(n), trees * (depth - least)), np.int32)
                bits = np.zeros((len(n), longs * 8), np.uint8)
                if len(some):
                    sig = signatures(sets, np.append(ends[some], ends[-1]), trees, depth)
                    two = mix64(sig)
                    packed = np.packbits(np.concatenate([two & np.uint64(1), (two >> np.uint64(1)) & np.uint64(1)], axis=1).astype(np.uint8), axis=1)
                    bits[some, : packed.shape[1]] = packed
                    sig = sig.reshape(len(some), trees, depth)
                    head = np.zeros((len(some), trees), np.uint64)
                    for k in range(least):
                        head = mix64(head * np.uint64(31) + sig[:, :, k])
                    heads[some] = head.view(np.int64)
                    tails[some] = sig[:, :, least:].reshape(len(some), -1).view(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(keys, pa.binary()), lists(heads), lists(tails), lists(bits.view(np.int64))], schema=schema)
        _hashes.seen.clear()  # the worker lives on

    return docs.mapInArrow(make, "id long, n long, set_key binary, heads array<long>, tails array<int>, bits array<long>")


def unlike_bits(percent: int, hashes: int) -> int:
    """The most differing bits (two for each hash) that a pair at the threshold shows, but for 4.5 standard deviations."""
    j = percent / 100
    return int(hashes * (1 - j) + 4.5 * (hashes * (1 - j) * (0.5 + j)) ** 0.5) + 1


def forest_pairs(sets: DataFrame, trees: int, depth: int, least: int, percent: int, region: int = REGION, near: int = NEAR) -> DataFrame:
    """Candidate pairs a, b from (id, n, heads, tails, bits).

    In every tree the sets are sorted by their hashes. A region is the sets that share a prefix;
    it starts at ``least`` hashes and, while it holds more than ``region`` sets, is cut by its next hash,
    so its depth adapts to its own crowd. Each set is paired with its ``near`` successors in the
    region's order: those with the longest common prefixes. Sets equal in all hashes of a tree
    and too many for a region are dealt by their id into as many parts as they need, and the
    least sets of these parts are paired in turn. Pairs whose sizes rule out the similarity, or whose bits
    make it very unlikely, are dropped.
    """
    more = depth - least
    tree = F.sequence(F.lit(0), F.lit(trees - 1))
    heads = sets.select("id", F.explode(F.transform(tree, lambda t: F.xxhash64(t, F.element_at("heads", t + 1)))).alias("region"))
    shared = heads.groupBy("region").agg(F.count("*").alias("crowd")).where("crowd > 1")
    some = sets.join(heads.join(shared, "region", "left_semi").select("id").distinct(), "id", "left_semi")
    rows = written(
        some.select("id", "n", "bits", F.explode(F.transform(tree, lambda t: F.struct(F.xxhash64(t, F.element_at("heads", t + 1)).alias("region"), F.slice("tails", t * more + 1, more).alias("rest")))).alias("x"))
        .select("id", "n", "bits", "x.*").join(shared, "region"), "regions")
    done = []
    for level in range(more + 1):
        done.append(rows.where(F.col("crowd") <= region))
        crowd = rows.where(F.col("crowd") > region)
        if not crowd.head(1):
            break
        if level < more:
            crowd = crowd.withColumn("region", F.xxhash64("region", F.element_at("rest", level + 1))).drop("crowd")
            rows = written(crowd.join(crowd.groupBy("region").agg(F.count("*").alias("crowd")).where("crowd > 1"), "region"), "regions")
        else:
            parts = (F.col("crowd") * 2 / region).cast("long") + 1
            crowd = crowd.withColumn("part", F.pmod(F.xxhash64("id"), parts))
            done.append(crowd.withColumn("region", F.xxhash64("region", "part")))
            heads = crowd.groupBy("region", "part").agg(F.min(F.struct("id", "n", "bits")).alias("h"))
            done.append(heads.select("h.id", "h.n", "h.bits", "region", F.array(F.lit(0)).alias("rest")))
    order = Window.partitionBy("region").orderBy("rest", "id")
    unlike = sum((F.bit_count(F.element_at("bits", i + 1).bitwiseXOR(F.element_at("o.bits", i + 1))) for i in range(2 * trees * depth // 64 + 1)), F.lit(0))
    pairs = None
    for rows in done:
        part = rows.select("id", "n", "bits", F.array(*[F.lead(F.struct("id", "n", "bits"), k).over(order) for k in range(1, near + 1)]).alias("next"))
        part = part.select("id", "n", "bits", F.explode("next").alias("o")).where("o is not null")
        part = part.where(F.least("n", "o.n") * 100 >= F.greatest("n", "o.n") * percent).where(unlike <= unlike_bits(percent, trees * depth))
        part = part.select(F.col("id").alias("a"), F.col("o.id").alias("b"))
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs


def links_in_block(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the sets as all their similar pairs do: each set to the least of those it reaches."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    wide = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        m = np.zeros((len(sets), wide), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    alike = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(alike, True)
    label = ids.copy()
    while True:  # the least label of a neighbour, until nothing changes
        new = np.where(alike, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            break
        label = new
    moved = label != ids
    return ids[moved], label[moved]


def _sets_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, hashes: the shingle sets of the rows (id, text) that have one of these ids, each set of an id once.

    The texts are read again; a Bloom filter of fixed size spares most of those that are not asked for, and an exact join does the rest.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bloom_of(ids.select(F.xxhash64("id").alias("key")), "key"))

    def sets(batches):
        for batch in batches:
            keys = np.asarray(batch.column(2)).view(np.uint64)
            for part in _blocks(batch.filter(pa.array(in_bloom(bits.value, keys)))):
                got, ends = shingle_sets(part.column(1).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([got[ends[i] : ends[i + 1]].tobytes() for i in range(len(ends) - 1)], pa.binary())], ["id", "hashes"])
        _hashes.seen.clear()

    found = docs.select("id", "text", F.xxhash64("id").alias("key")).mapInArrow(sets, "id long, hashes binary")
    return found.where(F.length("hashes") > 0).join(ids, "id")


def _links_in(groups: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links a, b between the sets (id, hashes) of each group."""
    def link(pdf):
        import pandas as pd

        pdf = pdf[["id", "hashes"]].drop_duplicates().sort_values(["id", "hashes"])
        a, b = links_in_block(pdf["id"].to_numpy(dtype=np.int64), [np.frombuffer(x, np.uint64) for x in pdf["hashes"]], percent)
        return pd.DataFrame({"a": a, "b": b})

    return groups.groupBy(*keys).applyInPandas(link, "a long, b long")


def _dealt(n, block: int, *by):
    """One of as many parts as n rows need, by a hash."""
    return F.pmod(F.xxhash64(*by), F.ceil(F.lit(n) / block) if isinstance(n, int) else F.greatest(F.ceil(n / block), F.lit(1))).cast("int")


def family_links(docs: DataFrame, families: DataFrame, shingle: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links a, b between sets of one family (id, component), confirmed on full shingle sets, that join what all similar pairs join.

    A family of up to ``block`` sets is one group, in which all pairs are confirmed (not only candidates) while none is emitted.
    A larger family is dealt into groups by a hash, twice in different ways, which ships each set twice and joins most of it; what it falls
    into then is labelled by component. Sets of one label need no more comparing. All others do: labels of over ``block`` sets
    are cut into blocks of their own, smaller ones share blocks, and each block meets those that hold other labels.
    The largest label's blocks are not paired with each other, so a family of many copies costs its size and not its square.
    """
    sizes = families.groupBy("component").agg(F.count("*").alias("m"))
    known = families.join(sizes, "component").select("id", "component", "m")
    found = written(_sets_of(docs, known, shingle), "family-sets")
    links = _links_in(found.where(F.col("m") <= block), ["component"], percent)
    large = found.where(F.col("m") > block)
    if not large.head(1):
        return links
    for turn in (1, 2):
        dealt = large.withColumn("part", _dealt(F.col("m"), block, F.col("id"), F.lit(turn)))
        links = links.unionByName(_links_in(dealt, ["component", "part"], percent))
    links = written(links, "family-links")
    label = components(links, "a", "b", "family-links")
    part = large.select("id", "component", "m").distinct().join(label.select("id", F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    counts = part.groupBy("component", "label").agg(F.count("*").alias("n"))
    # families that fell into several labels, with their largest one
    apart = counts.groupBy("component").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label"))["label"].alias("first"), F.sum(F.when(F.col("n") <= block, F.col("n")).otherwise(0)).alias("small")).where("labels > 1")
    own = F.col("n") > block
    placed = part.drop("m").join(counts, ["component", "label"]).join(apart, "component").select(
        "id", "component", F.when(own | (F.col("label") == F.col("first")), F.col("label")).alias("label"), "first",
        F.when(own, _dealt(F.col("n"), block, F.col("id"))).when(F.col("label") == F.col("first"), F.lit(0)).otherwise(_dealt(F.col("small"), block, F.col("label"))).alias("part"))
    placed = written(placed, "family-blocks")
    if not placed.head(1):
        return links
    blocks = placed.select("component", "label", "first", "part").distinct().withColumn("block", F.xxhash64(F.coalesce("label", F.lit(-1)), "part", F.col("label").isNull()))
    others = blocks.where(F.col("label").isNull() | (F.col("label") != F.col("first"))).select("component", F.col("label").alias("label2"), F.col("block").alias("block2"))
    differ = F.col("label").isNull() | F.col("label2").isNull() | (F.col("label") != F.col("label2"))
    once = F.coalesce(F.col("label") == F.col("first"), F.lit(False)) | (F.col("block") <= F.col("block2"))
    pairs = blocks.join(others, "component").where(differ & once).select("component", F.explode(F.array("block", "block2")).alias("block"), F.xxhash64("block", "block2").alias("pair")).distinct()
    keyed = placed.withColumn("block", F.xxhash64(F.coalesce("label", F.lit(-1)), "part", F.col("label").isNull())).select("id", "component", "block")
    groups = found.select("id", "hashes").join(keyed, "id").join(pairs, ["component", "block"])
    return links.unionByName(_links_in(groups, ["component", "pair"], percent))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, trees: int = TREES,
                    depth: int = DEPTH, least: int = LEAST, region: int = REGION, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """One row for each distinct doc_id that is not null: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of ``shingle``-word
    shingles; a component's id is its smallest doc_id, which is the one kept. Rows whose sets
    are equal are one class, by a digest of the set, before any pair is made. The forest's candidate
    pairs join class representatives into families; within a family all links are confirmed on full
    sets, and components of these links are the result.
    Null and empty texts have no set, are linked with nothing and are kept. Rows that repeat a doc_id
    are one document, which is linked with whatever any of its rows is linked with; n_shingles is that of the row with the most. Rows with a null doc_id are left
    out, and so are ids that are no whole numbers. An empty table gives no rows. Extra columns are ignored. A lone pair at a similarity of 0.8 is missed with a
    chance of 6e-5 (at 0.85: 3e-7); in larger families a set must be missed by all others at once.
    """
    d = small_batches(docs).select(F.col(doc_id).try_cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    found = written(sketches(d, shingle, trees, depth, least), "sketches")
    # written, so that the join has a stage of its own, in which Spark can split the rows of one large class
    classes = written(found.where("n > 0").groupBy("set_key").agg(F.min("id").alias("rep")), "sets")
    member = written(found.select("id", "n", "set_key").join(classes, "set_key", "left").select("id", "n", "rep"), "classes")
    # a class is known by its smallest id; an id that stands for several classes, as its rows differ, is one node with several sets
    reps = found.join(classes.select(F.col("rep").alias("id"), "set_key"), ["id", "set_key"], "left_semi").dropDuplicates(["id", "set_key"])
    families = written(components(forest_pairs(reps, trees, depth, least, percent, region, near), "a", "b", "pairs"), "families")
    dropped(found)
    dropped(classes)
    links = family_links(d, families, shingle, percent, block)
    # ids whose rows are in classes of several names link these
    several = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("id", "a")
    links = links.unionByName(member.where("rep is not null").join(several, "id").select("a", F.col("rep").alias("b")).distinct())
    label = components(links, "a", "b", "links")
    out = member.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left")
    out = out.groupBy("id").agg(F.max("n").alias("n"), F.min(F.coalesce("component", "rep")).alias("c"))
    c = F.coalesce("c", "id")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), c.alias("component_id"), (F.col("id") == c).alias("kept"))


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, least(len(w), 3) AS k, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS s, w FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g FROM x),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
