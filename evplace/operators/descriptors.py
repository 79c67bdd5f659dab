"""Frame descriptors: pooling, whitening, sampling of maps, cluster pooling."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evplace.functions import arrow

FRAME = ("seq", "frame_idx")


def gem_pool(df: DataFrame, p: float = 5, eps: float = 1e-6) -> DataFrame:
    """Generalised mean of each channel: df has seq, frame_idx, channel, value."""
    return df.groupBy(*FRAME, "channel").agg(F.pow(F.avg(F.pow(F.greatest(F.col("value"), F.lit(eps)), F.lit(float(p)))), F.lit(1.0 / p)).alias("value"))


def topk_keypoints(kps: DataFrame, k: int = 170) -> DataFrame:
    best = Window.partitionBy(*FRAME).orderBy(F.desc("score"), "kp_idx")
    return kps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _moments(batches):
    """n, mean and centred second moments of a partition's vectors, merged batch by batch."""
    n, mean, m2 = 0, None, None
    for pdf in batches:
        if not len(pdf):
            continue
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        n, mean, m2 = merge_moments((n, mean, m2), (len(x), x.mean(axis=0), (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))))
    if n:
        yield pd.DataFrame({"n": [n], "mean": [mean], "m2": [m2.ravel()]})


def merge_moments(a: tuple, b: tuple) -> tuple:
    """Moments of two samples together, without the loss of raw sums."""
    if not a[0]:
        return b
    if not b[0]:
        return a
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def fit_whitening(ref: DataFrame, eps: float = 1e-8, fan_in: int = 64) -> dict[str, np.ndarray]:
    """mean, components (min(n, dims) rows), scale of the reference vectors: 1 / sqrt of each variance, at least eps.

    One pass; moments of partitions, D x D each, are merged on the executors ``fan_in`` at a time, and one such table of numbers
    reaches the driver for its eigenvectors.
    """
    parts = ref.select("vec").mapInPandas(_moments, "n long, mean array<double>, m2 array<double>")

    def together(key, pdf):
        out = (0, None, None)
        for n, mean, m2 in zip(pdf["n"], pdf["mean"], pdf["m2"]):
            d = len(mean)
            out = merge_moments(out, (int(n), np.asarray(mean), np.asarray(m2).reshape(d, d)))
        return pd.DataFrame({"n": [out[0]], "mean": [out[1]], "m2": [out[2].ravel()]})

    merged = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(fan_in))).groupBy("g").applyInPandas(together, "n long, mean array<double>, m2 array<double>")
    out = (0, None, None)
    for r in merged.toLocalIterator():
        d = len(r["mean"])
        out = merge_moments(out, (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(d, d)))
    n, mean, m2 = out
    if not n:
        raise ValueError("no reference vectors")
    return _model(n, mean, m2, eps)


def apply_whitening(df: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """vec as ((vec - mean) V') scale; the model is D x D at most."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def whiten(vec: pd.Series) -> pd.Series:
        m = shared.value
        if not len(vec):
            return pd.Series([], dtype=object)
        return pd.Series(list(((np.stack(vec.to_numpy()) - m["mean"]) @ m["components"].T) * m["scale"]))

    return df.withColumn("vec", whiten("vec"))


def _model(n: int, mean: np.ndarray, m2: np.ndarray, eps: float) -> dict[str, np.ndarray]:
    values, vectors = np.linalg.eigh(m2)
    keep = np.argsort(-values)[: min(n, len(mean))]
    return {"mean": mean, "components": vectors[:, keep].T, "scale": 1 / np.sqrt(np.maximum(np.maximum(values[keep], 0) / max(n - 1, 1), eps))}


def fit_whitening_by(ref: DataFrame, key: str = "ref_seq", eps: float = 1e-8, fan_in: int = 64) -> DataFrame:
    """key, mean, components (row by row), scale: fit_whitening() for each value of ``key``, all in one job, as a table.

    Tasks keep moments for each key that they meet; those are merged ``fan_in`` tasks at a time and then by key, so a group
    holds matrices of D x D only, and none of them reaches the driver. Repeated rows count each; null vectors do not.
    """
    kind = dict(ref.dtypes)[key]

    def moments(batches):
        held: dict = {}
        for pdf in batches:
            for k, rows in pdf.groupby("key", dropna=False):
                x = np.stack(rows["vec"].to_numpy()).astype(np.float64)
                k = None if pd.isna(k) else k
                held[k] = merge_moments(held.get(k, (0, None, None)), (len(x), x.mean(axis=0), (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))))
        for k, (n, mean, m2) in held.items():
            yield pd.DataFrame({"key": [k], "n": [n], "mean": [mean], "m2": [m2.ravel()]})

    def merged(pdf):
        out = (0, None, None)
        for n, mean, m2 in zip(pdf["n"], pdf["mean"], pdf["m2"]):
            out = merge_moments(out, (int(n), np.asarray(mean), np.asarray(m2).reshape(len(mean), len(mean))))
        return out

    def together(_, pdf):
        n, mean, m2 = merged(pdf)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "n": [n], "mean": [mean], "m2": [m2.ravel()]})

    def model(_, pdf):
        out = _model(*merged(pdf), eps)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "mean": [out["mean"]], "components": [out["components"].ravel()], "scale": [out["scale"]]})

    schema = f"key {kind}, n long, mean array<double>, m2 array<double>"
    parts = ref.where("vec is not null").select(F.col(key).alias("key"), "vec").mapInPandas(moments, schema)
    near = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(fan_in))).groupBy("key", "g").applyInPandas(together, schema)
    return near.groupBy("key").applyInPandas(model, f"key {kind}, mean array<double>, components array<double>, scale array<double>").withColumnRenamed("key", key)


def apply_whitening_by(df: DataFrame, models: DataFrame, key: str = "ref_seq", rows: int | None = None, block: int = 4096) -> DataFrame:
    """df with vec whitened by the model of its ``key``; rows without a model are left out.

    A key's rows are dealt into groups of about ``block``, and its model goes once to each, so neither a row carries a model nor a key with most
    rows is one group. ``rows`` is counted if not given.
    """
    n = rows if rows is not None else df.count()
    groups = max(1, -(-n // block))
    dealt = df.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    shipped = models.select(F.col(key).alias("_k"), "mean", "components", "scale").join(dealt.select(F.col(key).alias("_k"), "_g").distinct(), "_k").withColumnRenamed("_g", "_h")

    def whiten(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return left.slice(0, 0).select(names)
        m = {c: np.array(right.column(c)[0].as_py()) for c in ("mean", "components", "scale")}
        x = arrow.matrix(left.column("vec").combine_chunks())
        out = ((x - m["mean"]) @ m["components"].reshape(len(m["scale"]), -1).T) * m["scale"]
        return left.select(names).set_column(names.index("vec"), "vec", arrow.lists(out))

    names = df.columns
    schema = ", ".join(f"`{c}` {'array<double>' if c == 'vec' else t}" for c, t in df.dtypes)
    return dealt.groupBy(key, "_g").cogroup(shipped.groupBy("_k", "_h")).applyInArrow(whiten, schema)


def sample_grid(cells: DataFrame, kps: DataFrame, dims: int | None = None) -> DataFrame:
    """seq, frame_idx, kp_idx, vec: a map (seq, frame_idx, y, x, vec) sampled at every keypoint, bilinear, 0 outside, then unit length.

    Map and keypoints of a frame are one row each, which a sensor bounds, joined by frame; a task looks corners of its whole batch up at once. A keypoint
    without a cell beside it, without a place, or of a frame without a map has a vector of zeros. Cells given twice add up. ``dims`` is
    the length of vectors, counted if not given.
    """
    d = dims if dims is not None else cells.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("n")).first()["n"]
    maps = cells.groupBy(*FRAME).agg(F.collect_list(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("vec").cast("array<double>").alias("vec"))).alias("cells"))
    points = kps.groupBy(*FRAME).agg(F.collect_list(F.struct("kp_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("points"))

    def run(batches):
        for batch in batches:
            points, p_ends = arrow.flat(batch.column(2))
            own, c_ends = arrow.flat(batch.column(3))
            out = np.zeros((len(points), d))
            x, y = arrow.numbers(points, "x").astype(np.float64), arrow.numbers(points, "y").astype(np.float64)
            frame = np.repeat(np.arange(batch.num_rows), np.diff(p_ends))
            if len(own):
                cy, cx = arrow.numbers(own, "y").astype(np.int64), arrow.numbers(own, "x").astype(np.int64)
                top, left = cy.min(), cx.min()
                high, wide = cy.max() - top + 1, cx.max() - left + 1
                keys = (np.repeat(np.arange(batch.num_rows), np.diff(c_ends)) * high + cy - top) * wide + cx - left
                order = np.argsort(keys, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
                keys, values = keys[order][first], np.add.reduceat(arrow.matrix(own.field("vec"))[order], first)
                known = np.isfinite(x) & np.isfinite(y)
                x, y = np.where(known, x, left - 9), np.where(known, y, top - 9)
                y0, x0 = np.floor(y), np.floor(x)
                for dy in (0, 1):
                    for dx in (0, 1):
                        w = (y - y0 if dy else 1 - (y - y0)) * (x - x0 if dx else 1 - (x - x0))
                        at_y, at_x = y0 + dy - top, x0 + dx - left
                        inside = np.flatnonzero((w > 0) & (at_y >= 0) & (at_y < high) & (at_x >= 0) & (at_x < wide))
                        key = (frame[inside] * high + at_y[inside].astype(np.int64)) * wide + at_x[inside].astype(np.int64)
                        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        hit = keys[at] == key
                        out[inside[hit]] += w[inside[hit], None] * values[at[hit]]
            out /= np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]
            again = pa.array(frame)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), points.field("kp_idx"), arrow.lists(out)], ["seq", "frame_idx", "kp_idx", "vec"])

    both = points.join(maps, list(FRAME), "left").select(*FRAME, "points", "cells")
    kinds = {**dict(kps.dtypes)}
    return both.mapInArrow(run, f"seq {kinds['seq']}, frame_idx {kinds['frame_idx']}, kp_idx {kinds['kp_idx']}, vec array<double>")


def _centroids(centroids: DataFrame, most: int = 5000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, vec and unit vec of a table of at most ``most`` clusters; more are an error, as every task holds them."""
    rows = centroids.select("cluster", F.col("vec").cast("array<double>").alias("vec")).orderBy("cluster").limit(most + 1).collect()
    if not 1 <= len(rows) <= most:
        raise ValueError(f"1 to {most} clusters are needed")
    c = np.array([r["vec"] for r in rows])
    return np.array([r["cluster"] for r in rows]), c, c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]


def vlad_pool(local: DataFrame, centroids: DataFrame, alpha: float = 100) -> DataFrame:
    """seq, frame_idx, cluster, vec: residuals to each centroid (cluster, vec; at most thousands), softly assigned, summed, unit length by cluster.

    The descriptors of a frame are one row, which a detector bounds; a frame is two matrix products in its task.
    A cluster to which next to nothing is assigned has a residual of rounding noise, of a length up to 1e-6: its vector is zero. Keypoints without a descriptor do not count.
    """
    shared = local.sparkSession.sparkContext.broadcast(_centroids(centroids))
    packed = local.where("desc is not null").groupBy(*FRAME).agg(F.collect_list(F.col("desc").cast("array<double>")).alias("desc"))

    def run(batches):
        clusters, c, unit = shared.value
        for batch in batches:
            rows, ends = arrow.flat(batch.column(2))
            x = arrow.matrix(rows)
            x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
            z = alpha * (x @ unit.T)
            e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
            a = e / e.sum(axis=1, keepdims=True)
            v = np.stack([a[s:t].T @ x[s:t] - a[s:t].sum(axis=0)[:, None] * c for s, t in zip(ends, ends[1:])]).reshape(-1, c.shape[1]) if batch.num_rows else np.empty((0, c.shape[1]))
            length = np.linalg.norm(v, axis=1)[:, None]
            v = np.where(length > 1e-6, v / np.maximum(length, 1e-12), 0.0)
            again = pa.array(np.repeat(np.arange(batch.num_rows), len(clusters)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), pa.array(np.tile(clusters, batch.num_rows).astype(np.int32)), arrow.lists(v)], ["seq", "frame_idx", "cluster", "vec"])

    kinds = dict(local.dtypes)
    return packed.mapInArrow(run, f"seq {kinds['seq']}, frame_idx {kinds['frame_idx']}, cluster int, vec array<double>")


def fit_alpha(local: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row: alpha such that a mean gap between the best and second centroid means a ratio of 100; at least two centroids. Tasks send their sums only."""
    held = _centroids(centroids)
    if len(held[0]) < 2:
        raise ValueError("at least two clusters are needed")
    shared = local.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        for batch in batches:
            x = arrow.matrix(batch.column(0))
            if len(x):
                z = np.partition(x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None] @ shared.value[2].T, -2, axis=1)
                yield pa.RecordBatch.from_pydict({"gap": [float((z[:, -1] - z[:, -2]).sum())], "n": [len(z)]})

    sums = local.where("desc is not null").select(F.col("desc").cast("array<double>").alias("desc")).mapInArrow(run, "gap double, n long")
    return sums.agg((-F.log(F.lit(0.01)) / (F.sum("gap") / F.sum("n"))).alias("alpha"))
