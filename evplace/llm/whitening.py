"""Embedding whitening: components of the covariance found by contour integration (FEAST), with inertia counts as proof that none is missed.

Vectors become whole numbers, so that sums and deviations are exact. Rows with as many values as each other are whitened together,
over their distinct vectors. Counts, sums and centred products are partial sums of tasks, added up by Spark; what solves the eigenproblem
sees one matrix of a length's values squared, never rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evplace.llm._shared import written

#: A value c becomes floor(SCALE * c) + OFFSET; beyond LIMIT either way it counts as LIMIT.
SCALE, OFFSET, LIMIT = 64, 1_000_000, 1 << 52
#: Components returned, eigenvalues of one contour (ties apart), quadrature points on its upper half, bytes of models that tasks get at once.
COMPONENTS, INSIDE, NODES, MODEL_BYTES = 16, 6, 8, 32 << 20


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and next diagonal of a tridiagonal matrix with the eigenvalues of a symmetric one (Householder)."""
    a = np.array(a, dtype=np.float64)
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        length = np.linalg.norm(x)
        if length:
            v = x / length
            p = a[k + 1 :, k + 1 :] @ v
            w = 2 * (p - (v @ p) * v)
            a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
            a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, beside: np.ndarray, shift: float) -> int:
    """Eigenvalues greater than ``shift``: positive pivots of the shifted tridiagonal matrix (its inertia, by Sylvester's law)."""
    tiny = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(beside).max(initial=0), np.finfo(float).tiny)
    above, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - shift - (beside[i - 1] ** 2 / pivot if i else 0.0)
        pivot = -tiny if abs(pivot) < tiny else pivot
        above += pivot > 0
    return above


def spectrum_slices(cov: np.ndarray, want: int = COMPONENTS, most: int = INSIDE) -> list[tuple[float, float, int]]:
    """Intervals (a, b, eigenvalues in it) that hold the greatest ``want`` eigenvalues, those that are over rounding.

    Cut by bisection until one holds ``most`` at most or ties only; cuts are moved off eigenvalues, as counts on both sides of them show.
    """
    d, e = tridiagonal(cov)
    spread = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    top = float((d + spread).max(initial=0)) * (1 + 1e-12)
    floor = len(cov) * 1e-14 * top
    if top <= 0 or not count_above(d, e, floor):
        return []
    above = lambda x: count_above(d, e, x)
    want, top, least = min(want, above(floor)), top * 1.001, 1e-9 * top

    def clear(lo: float, hi: float) -> float:
        """A point well inside (lo, hi) and as far from any eigenvalue as a few tries can tell."""
        best = (-1.0, (lo + hi) / 2)
        for at in (0.5, 0.4, 0.6, 0.3, 0.7, 0.45, 0.55):
            x, margin = lo + at * (hi - lo), (hi - lo) / 16
            while margin > least / 64 and above(x - margin) != above(x + margin):
                margin /= 2
            best = max(best, (margin, x))
        return best[1]

    out, open_ = [], [(floor, top, above(floor), 0)]
    while open_:  # (lo, hi, eigenvalues above lo, above hi), the greatest on top
        lo, hi, n_lo, n_hi = open_.pop()
        if n_lo == n_hi or n_hi >= want:
            continue
        if n_lo - n_hi <= most or hi - lo < least:
            out.append((lo, hi, n_lo - n_hi))
            continue
        x = clear(lo, hi)
        n = above(x)
        open_ += [(lo, x, n_lo, n), (x, hi, n, n_hi)]
    return out


def contour_eigenpairs(cov: np.ndarray, a: float, b: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (a, b) and their unit eigenvectors in columns.

    A random block is projected by quadrature of (z - cov)^-1 along a circle over the interval (conjugate halves are one), Rayleigh-Ritz takes
    pairs from it, and they are the next block, until residuals are rounding. If fewer or more pairs turn up than the inertia said, the
    block is doubled; a block as wide as the matrix is all of it.
    """
    n, size, norm = len(cov), max(count + 3, -(-3 * count // 2)), np.linalg.norm(cov, 2)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 + nodes))
    middle, radius = (a + b) / 2, (b - a) / 2
    rng = np.random.default_rng(seed)
    while True:
        size = min(size, n)
        block = rng.standard_normal((n, size))
        last = np.inf
        for _ in range(40):
            if size < n:
                projected = np.zeros((n, size))
                for t, w in zip(turn, weights):
                    projected += (w / 2) * (radius * t * np.linalg.solve((middle + radius * t) * np.eye(n) - cov, block.astype(complex))).real
                basis = np.linalg.qr(projected)[0]
            else:
                basis = np.linalg.qr(block)[0]
            values, turned = np.linalg.eigh(basis.T @ cov @ basis)
            block = basis @ turned
            inside = (values > a) & (values < b)
            error = np.linalg.norm(cov @ block[:, inside] - block[:, inside] * values[inside], axis=0).max(initial=0) / norm
            if error < 1e-15 or (error < 1e-12 and error > last / 2) or size == n:
                break
            last = error
        if (inside.sum() == count and error < 1e-11) or size == n:
            keep = np.flatnonzero(inside) if inside.sum() == count else np.argsort(np.maximum(a - values, values - b), kind="stable")[:count]
            return values[keep], block[:, keep]
        size *= 2


def whole_vectors(df: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """id, x (whole numbers), dim of the rows whose vector is there and has finite values only."""
    rows = df.select(F.col(vec_id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    limit = F.lit(float(LIMIT))
    x = F.transform("v", lambda c: (F.floor(F.least(F.greatest(c * SCALE, -limit), limit)) + OFFSET).cast("long"))
    return rows.where((F.size("v") > 0) & ~odd).select("id", x.alias("x"), F.size("v").alias("dim"))


def _stacks(batch, at: int):
    """For each length in a batch: its rows' places and its vectors as one array; ``at`` is the list column."""
    column = batch.column(at)
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    flat, ends = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield d, rows, flat[ends[rows][:, None] + np.arange(d)]


def _sums(fit: DataFrame) -> DataFrame:
    """dim, n, r, s (both by value): the sum of each value over the list is n * r + s, exactly, with s smaller than n."""
    def add(batches):
        total: dict = {}
        for batch in batches:
            for d, _, x in _stacks(batch, 0):
                old = total.get(d, (0, 0, 0))
                total[d] = (old[0] + len(x), old[1] + (x >> 26).sum(axis=0), old[2] + (x & (1 << 26) - 1).sum(axis=0))
        for d, (n, high, low) in total.items():
            yield pa.RecordBatch.from_pydict({"dim": np.full(d, d, np.int32), "i": np.arange(d, dtype=np.int32), "n": np.full(d, n), "high": high, "low": low})

    parts = fit.select("x").mapInArrow(add, "dim int, i int, n long, high long, low long").groupBy("dim", "i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    whole = F.col("high").cast("decimal(20,0)") * F.lit(1 << 26).cast("decimal(9,0)") + F.col("low")
    n = F.col("n").cast("decimal(20,0)")
    r = F.floor((whole / n).cast("decimal(38,6)")).cast("long")
    each = parts.withColumn("total", whole).withColumn("r", r).withColumn("s", (F.col("total") - n * F.col("r")).cast("long"))
    one = each.groupBy("dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "r", "s"))).alias("m"))
    return one.select("dim", "n", F.transform("m", lambda m: m["r"]).alias("r"), F.transform("m", lambda m: m["s"]).alias("s"))


def _blocks(models: DataFrame, vectors: int):
    """Models by length, as many at once as MODEL_BYTES hold, each with its first and last length: a dictionary for tasks."""
    sizes = sorted(r["dim"] for r in models.select("dim").collect())
    while sizes:
        now = [sizes.pop(0)]
        while sizes and (sum(now) + sizes[0]) * (vectors + 2) * 8 <= MODEL_BYTES:
            now.append(sizes.pop(0))
        rows = models.where(F.col("dim").between(now[0], now[-1])).collect()
        yield now[0], now[-1], {r["dim"]: r.asDict() for r in rows}


def _centred(x: np.ndarray, m: dict) -> np.ndarray:
    return (x - np.array(m["r"])) - np.array(m["s"]) / m["n"]


def _by_length(rows: DataFrame, models: DataFrame, vectors: int, columns: list[str], step, schema: str) -> DataFrame:
    """step(batches, models by length) over the rows of every length."""
    out = None
    for lo, hi, held in _blocks(models, vectors):
        shared = rows.sparkSession.sparkContext.broadcast(held)
        part = rows.where(F.col("dim").between(lo, hi)).select(*columns).mapInArrow(lambda batches, s=shared: step(batches, s.value), schema)
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def _covariances(fit: DataFrame, sums: DataFrame) -> DataFrame:
    """dim, cov: the whole matrix of each length, row by row."""
    def add(batches, models):
        total: dict = {}
        for batch in batches:
            for d, _, x in _stacks(batch, 0):
                c = _centred(x, models[d])
                total[d] = total.get(d, 0) + c.T @ c
        for d, m in total.items():
            for i in range(d):
                yield pa.RecordBatch.from_pydict({"dim": np.full(d, d, np.int32), "i": np.full(d, i, np.int32), "j": np.arange(d, dtype=np.int32), "v": m[i] / models[d]["n"]})

    parts = _by_length(fit, sums, 0, ["x"], add, "dim int, i int, j int, v double")
    cells = parts.groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    lines = cells.groupBy("dim", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c"))
    one = lines.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("c"))
    return one.select("dim", F.flatten(F.transform("c", lambda line: F.transform(line["c"], lambda c: c["v"]))).alias("cov"))


def _components(covs: DataFrame, components: int) -> DataFrame:
    """dim, trace, values (falling), vectors (one after another): every slice of a spectrum is a task of its own."""
    def slices(frames):
        for pdf in frames:
            for d, c in zip(pdf["dim"], pdf["cov"]):
                m = np.asarray(c).reshape(d, d)
                for a, b, n in spectrum_slices((m + m.T) / 2, components):
                    yield pd.DataFrame({"dim": [d], "cov": [c], "a": [a], "b": [b], "n": [n]})

    def solve(frames):
        for pdf in frames:
            for d, c, a, b, n in zip(pdf["dim"], pdf["cov"], pdf["a"], pdf["b"], pdf["n"]):
                m = np.asarray(c).reshape(d, d)
                values, vectors = contour_eigenpairs((m + m.T) / 2, a, b, n)
                yield pd.DataFrame({"dim": d, "trace": np.trace(m), "value": values, "vector": list(vectors.T)})

    cut = covs.mapInPandas(slices, "dim int, cov array<double>, a double, b double, n long")
    found = cut.repartition("dim", "a").mapInPandas(solve, "dim int, trace double, value double, vector array<double>")
    best = found.groupBy("dim", "trace").agg(F.slice(F.sort_array(F.collect_list(F.struct("value", "vector")), asc=False), 1, components).alias("c"))
    return best.select("dim", "trace", F.transform("c", lambda c: c["value"]).alias("values"), F.flatten(F.transform("c", lambda c: c["vector"])).alias("vectors"))


def _whitened(x: np.ndarray, m: dict) -> np.ndarray:
    k = len(m["values"])
    return (_centred(x, m) @ np.array(m["vectors"]).reshape(k, -1).T) / np.sqrt(np.array(m["values"]))


def _deviations(x: np.ndarray, m: dict) -> list:
    """Sum over values of (n x - sum)^2, exactly; None beyond 64 bits."""
    n, r, s = m["n"], np.array(m["r"]), np.array(m["s"])
    away = x - r
    if float(n) * (float(np.abs(away).max(initial=0)) + 1) * np.sqrt(len(r)) < 2.0**31:
        return ((n * away - s) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s.tolist())) for row in away.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def _identity_errors(fit: DataFrame, models: DataFrame, components: int) -> DataFrame:
    """dim, identity_error: the covariance of the whitened list itself, against the identity."""
    def add(batches, held):
        total: dict = {}
        for batch in batches:
            for d, _, x in _stacks(batch, 0):
                z = _whitened(x, held[d])
                total[d] = total.get(d, 0) + z.T @ z
        for d, m in total.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_pydict({"dim": np.full(m.size, d, np.int32), "i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": m.ravel() / held[d]["n"]})

    cells = _by_length(fit, models, components, ["x"], add, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    return cells.groupBy("dim").agg(F.max(F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("identity_error"))


def whitened(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: for each row its value on each of the first components.

    Vectors that are null, empty, or hold null or non-finite values take no part. Rows are whitened among those with as many values as they
    have (n is the number of their distinct vectors of whole numbers). Directions without variance are no components: one distinct vector alone gives
    no rows. Repeated vectors count once in the fit and keep all their rows; null and repeated ids are rows like others. Values beyond 2^46
    count as that, and a deviation beyond 64 bits is null. Tied eigenvalues get any orthonormal vectors of their space. An empty table gives no
    rows. Extra columns are ignored.
    """
    rows = whole_vectors(df, vec_id, vec)
    fit = written(rows.select("dim", "x").distinct(), "distinct")
    sums = written(_sums(fit), "sums")
    found = written(_components(_covariances(fit, sums), components), "components")
    models = written(sums.join(found, "dim"), "whitening")
    models = written(models.join(_identity_errors(fit, models, components), "dim"), "whitening-checked")
    kind = dict(rows.dtypes)["id"]

    def project(batches, held):
        for batch in batches:
            for d, at, x in _stacks(batch, 1):
                for lo in range(0, len(at), 1000):
                    m, place, part = held[d], at[lo : lo + 1000], x[lo : lo + 1000]
                    z, k = _whitened(part, m), len(m["values"])
                    again = np.repeat(np.arange(len(part)), k)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(place[again])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(again), m["n"])),
                        pa.array(_deviations(part, m), pa.int64()).take(pa.array(again)), pa.array(z.ravel()), pa.array(np.tile(np.array(m["values"]) / m["trace"], len(part))), pa.array(np.full(len(again), m["identity_error"])),
                    ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = _by_length(rows, models, components, ["id", "x"], project, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", vec_id)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
