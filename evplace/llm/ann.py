"""Approximate nearest neighbours by cross-polytope hashing, with multiprobe tables and exact reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evplace.llm._shared import written

#: Tables, buckets that a query probes in each table for each doubling of a table's last rotation, rows that one group compares, and lengths of
#: vectors that are searched one by one in one job.
TABLES, PROBES, BLOCK, LENGTHS = 12, 25, 4096, 64
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(unit: np.ndarray, table: int, step: int = 0) -> np.ndarray:
    """A pseudo-rotation of the rows, padded to a power of two: three times random signs and Hadamard."""
    d = 1 << max(0, int(unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), d))
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng((SEED, table, step)).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def rotations(n: int, dim: int) -> list[int]:
    """How many axes each rotation of a table takes, all or a first power of two of them: one whole rotation, then so many axes more as
    double with every fourfold number of rows, so that the share of all rows that a query meets falls as they grow."""
    d = 1 << max(0, int(dim - 1).bit_length())
    more = max(0, round(np.log2(max(n, 1)) / 2 - 2.5))
    out = [d]
    while more > 0:
        out.append(min(d, 1 << more))
        more -= int(d).bit_length() + 1
    return out


def probe_count(axes: list[int]) -> int:
    """Buckets that a query probes in each table."""
    return PROBES * (1 + sum(int(a).bit_length() - 1 for a in axes[1:]))


def _signed(unit: np.ndarray, table: int, axes: list[int]) -> list[np.ndarray]:
    """For each rotation, how near each row is to every signed axis: axis i as i, its opposite as (axes + i)."""
    out = []
    for step, a in enumerate(axes):
        y = rotated(unit, table, step)[:, :a]
        out.append(np.concatenate([y, -y], axis=1))
    return out


def buckets(unit: np.ndarray, table: int, axes: list[int]) -> np.ndarray:
    """The bucket of each row: the nearest signed axis of each rotation, as one number."""
    out = np.zeros(len(unit), dtype=np.int64)
    for s in _signed(unit, table, axes):
        out = out * s.shape[1] + s.argmax(axis=1)
    return out


def probes(unit: np.ndarray, table: int, axes: list[int], count: int) -> np.ndarray:
    """The ``count`` nearest buckets of each row (all, if fewer), by the sum of how near it is to their axes."""
    at, score = np.zeros((len(unit), 1), dtype=np.int64), np.zeros((len(unit), 1))
    for s in _signed(unit, table, axes):
        # the best sums use the best of each list, so what falls out here is in none of them
        best = np.argsort(-s, axis=1, kind="stable")[:, :count]
        at = (at[:, :, None] * s.shape[1] + best[:, None, :]).reshape(len(unit), -1)
        score = (score[:, :, None] + np.take_along_axis(s, best, axis=1)[:, None, :]).reshape(len(unit), -1)
        top = np.argsort(-score, axis=1, kind="stable")[:, :count]
        at, score = np.take_along_axis(at, top, axis=1), np.take_along_axis(score, top, axis=1)
    return at


def _vectors(column, dim: int, dtype) -> np.ndarray:
    return np.asarray(column.flatten() if hasattr(column, "flatten") else column).astype(dtype).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _level(v: np.ndarray, top: float, longest: float) -> np.ndarray:
    """Rows over ``top`` with one more value that brings them all to the squared length ``longest``, so that near rows have near directions."""
    x = v.astype(np.float64) / top
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))])


def nearest_in_block(rows_id: np.ndarray, rows: np.ndarray, bucket: np.ndarray | None, query_id: np.ndarray, query: np.ndarray, asked: list | None, k: int):
    """query_id, vec_id, distance of each query's k nearest rows but itself; ties to the smaller id. With buckets, only rows of those it asks for."""
    order = np.argsort(rows_id, kind="stable") if bucket is None else np.lexsort((rows_id, bucket))
    rows_id, rows = rows_id[order], rows[order].astype(np.float64)
    if bucket is not None:
        bucket = bucket[order]
    out = []
    for i, (q, v) in enumerate(zip(query_id, query.astype(np.float64))):
        some = slice(None)
        if bucket is not None:
            lo, hi = np.searchsorted(bucket, asked[i]), np.searchsorted(bucket, asked[i], side="right")
            n = hi - lo
            some = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        ids = rows_id[some]
        dist = np.sqrt(((rows[some] - v) ** 2).sum(axis=1))
        other = ids != q
        ids, dist = ids[other], dist[other]
        if len(ids) > 4 * k:  # all that may be among the k nearest, ties too
            near = dist <= np.partition(dist, k - 1)[k - 1]
            ids, dist = ids[near], dist[near]
        top = np.lexsort((ids, dist))[:k]
        out.append((np.full(len(top), q), ids[top], dist[top]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


FOUND = "query_id long, vec_id long, score double"


def _compare(index: DataFrame, asked: DataFrame, keys: list[str], dim: int, dtype, k: int, by_bucket: bool) -> DataFrame:
    def search(rows, asked):
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        v = np.frombuffer(b"".join(rows["v"]), dtype).reshape(-1, dim)
        q = np.frombuffer(b"".join(asked["v"]), dtype).reshape(-1, dim)
        bucket, bs = (rows["b"].to_numpy(np.int64), list(asked["bs"])) if by_bucket else (None, None)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), nearest_in_block(rows["id"].to_numpy(np.int64), v, bucket, asked["id"].to_numpy(np.int64), q, bs, k))))

    return index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
            tables: int = TABLES, probe: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query, by Euclidean distance in double precision.

    Unit vectors are hashed to the nearest signed axes after pseudo-rotations, once for each table; every row is indexed in every
    table. More rows mean more axes, so buckets stay small and a query meets a falling share of all rows. A query probes its nearest buckets
    in each table, and candidates from all tables are ranked by exact distance on
    the original vectors; ties go to the smaller vec_id, and a query never finds its own id. Neighbouring buckets make a group, and a
    group's rows are dealt by id into blocks of about ``block`` rows, so a bucket of any size is many
    bounded groups, and queries visit all blocks of the groups whose buckets they probe. Queries that found fewer
    than k rows while there are more are compared with all rows, in blocks. Rows whose id or vector is null, whose
    vector is zero or empty, or holds null or non-finite values, take no part, as rows or
    queries. Vectors are searched among those with as many values as they have, so one row of another length changes nothing for the others; over
    LENGTHS different lengths are an error. Of rows that repeat an id the nearest counts, and repeated queries are one. With an
    empty table there are no rows. Vectors of different Euclidean lengths get one more value for hashing, which makes them equally long.
    """
    kind = vectors.schema[embedding].dataType.elementType.simpleString()
    dtype = np.float32 if kind == "float" else np.float64
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # non-numeric nulls compare to null: such rows drop out of the filter as well
    valid = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(f"array<{'float' if dtype is np.float32 else 'double'}>").alias("v")).where("id is not null and v is not null").where(fine)
    rows, asked = valid(vectors), valid(queries).dropDuplicates(["id", "v"])
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top")).limit(LENGTHS + 1).collect()
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of over {LENGTHS} different lengths")
    out = None
    for dim, n, top in sorted(map(tuple, sizes)):
        one = _nearest(rows.where(F.size("v") == dim), asked.where(F.size("v") == dim), n, dim, float(top), dtype, k, tables, probe, block)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len(sizes) > 1:  # a query id may have come with vectors of several lengths
        out = _best(out, k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(rows: DataFrame, asked: DataFrame, n: int, dim: int, top: float, dtype, k: int, tables: int, probe: int | None, block: int) -> DataFrame:
    """nearest() among n vectors of one number of values, the greatest of which is ``top``."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x.cast("double") / top) * (x.cast("double") / top))
    shortest, longest = rows.agg(F.min(length), F.max(length)).first()
    uneven = shortest < 0.99 * longest
    axes = rotations(n, dim + uneven)
    count = probe or probe_count(axes)
    made = int(np.prod([2 * a for a in axes]))
    # at least one for each axis of the first rotation, so that a query visits about as many groups, and finds about as many rows, at every size
    groups = max(1, min(made, max(2 * axes[0], -(-n // block))))

    def hashed(query: bool):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    v = _vectors(part.column(1), dim, dtype)
                    raw = pa.array([x.tobytes() for x in v], pa.binary())
                    unit = _unit(_level(v, top, longest) if uneven else v)
                    for t in range(tables):
                        if not query:
                            b = buckets(unit, t, axes)
                            yield pa.RecordBatch.from_arrays([part.column(0), raw, pa.array(np.full(len(b), t, np.int32)), pa.array(b * groups // made), pa.array(b)], ["id", "v", "t", "g", "b"])
                            continue
                        bs = np.sort(probes(unit, t, axes, count), axis=1)
                        g = bs * groups // made
                        new = np.ones(g.shape, dtype=bool)
                        new[:, 1:] = g[:, 1:] != g[:, :-1]
                        first = np.flatnonzero(new.ravel())
                        owner = pa.array(first // g.shape[1])
                        lists = pa.ListArray.from_arrays(np.append(first, g.size).astype(np.int32), pa.array(bs.ravel()))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(owner), raw.take(owner), pa.array(np.full(len(first), t, np.int32)), pa.array(g.ravel()[first]), lists], ["id", "v", "t", "g", "bs"])

        return run

    index = rows.mapInArrow(hashed(False), "id long, v binary, t int, g long, b long")
    ask = asked.mapInArrow(hashed(True), "id long, v binary, t int, g long, bs array<long>")
    # a row for each group of each table, broadcast while that is at most 100,000 rows
    sizes = index.groupBy("t", "g").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("blocks"))
    few_groups = lambda df: F.broadcast(df) if tables * groups <= 100_000 else df
    index = index.join(few_groups(sizes), ["t", "g"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("id", "v", "t", "g", "b", "part")
    ask = ask.join(few_groups(sizes.select("t", "g", F.col("blocks").alias("to"))), ["t", "g"]).select("id", "v", "t", "g", "bs", F.explode(F.sequence(F.lit(0), F.col("to") - 1)).alias("part"))
    # k rows for a query at most; written, as it is asked for what it lacks and then returned
    found = written(_best(_compare(index, ask, ["t", "g", "part"], dim, dtype, k, True), k), "found")
    few = asked.join(found.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= min(k, n - 1)).select(F.col("query_id").alias("id")), "id", "left_anti")
    if few.head(1):
        raw = lambda df: df.mapInArrow(_raw(dim, dtype), "id long, v binary")
        blocks = -(-n // block)
        all_rows = raw(rows).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        all_few = raw(few).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = _best(found.select("query_id", "vec_id", "score").unionByName(_compare(all_rows, all_few, ["part"], dim, dtype, k, False)), k)
    return found.select("query_id", "rank", "vec_id", "score")


def _raw(dim: int, dtype):
    def run(batches):
        for batch in batches:
            v = _vectors(batch.column(1), dim, dtype)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "v"])

    return run


def op4_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
