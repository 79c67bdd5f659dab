"""All-pairs similarity, shortlists, and joins with keypoints."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evplace.functions import arrow, nearest
from evplace.functions.nearest import METRICS
from evplace.functions.sizes import small

#: Rows of one block of the query x reference grid while there are few; numbers that a block holds at most (32 MB); pairs of blocks beyond which blocks grow.
BLOCK, VALUES, CELLS = 4096, 1 << 22, 64
#: Rows of a block on each side where all pairs are given out, while there are few, and of a tile of such a block, whose pairs are put in order of their values at once.
PAIR_BLOCK, SIDE = 1024, 5000
#: References of a tile whose pairs are given out as they come, pairs that are made at once, and rows that a task hands over at once.
NARROW, MADE, HANDED = 256, 1 << 20, 1 << 14
#: Tasks for each core between which blocks are dealt where all pairs are given out, and tasks for each pair of blocks that is searched: few pairs then meet in one.
TASKS, APART = 8, 4


def _sizes(df: DataFrame, keys: tuple[str, ...] = ()) -> tuple[int, int]:
    """Rows, of the largest key, and the longest vector."""
    each = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"))
    n, width = each.agg(F.max("n"), F.max("width")).first()
    return n or 0, max(width or 1, 1)


def _grid(df: DataFrame, n_ref: int, n_query: int, width: int, block: int, each: int = 4) -> tuple[int, int]:
    """Blocks of references and of queries. A row is shipped once for each block of the other side: so where more than CELLS pairs of blocks (or ``each`` for each core) would
    come about, blocks grow, up to VALUES numbers."""
    rb, qb = max(1, -(-n_ref // block)), max(1, -(-n_query // block))
    many = (rb * qb / max(CELLS, each * df.sparkSession.sparkContext.defaultParallelism)) ** 0.5
    least = lambda n: max(1, -(-n * width // VALUES))
    return tuple(max(least(n), min(b, -int(-b // max(many, 1)))) for n, b in ((n_ref, rb), (n_query, qb)))


def _dealt(ref: DataFrame, query: DataFrame, rb: int, qb: int, keys: tuple[str, ...] = ()):
    """Both sides dealt by their hash into blocks, a row once for each block of the other side, and grouped by pairs of blocks: query side, then reference side."""
    part = lambda n: F.pmod(F.xxhash64("frame_idx"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both sides may come from one table
    own = lambda df: df.select(*[F.col(c).alias(c) for c in keys], F.col("frame_idx").cast("long").alias("frame_idx"), F.col("vec").cast("array<double>").alias("vec"))
    r = own(ref).withColumn("rb", part(rb)).withColumn("qb", spread(qb))
    q = own(query).withColumn("qb", part(qb)).withColumn("rb", spread(rb))
    return q, r


def _side(table: pa.Table, name: str = "frame_idx") -> tuple[np.ndarray, np.ndarray]:
    return table.column(name).to_numpy(), arrow.matrix(table.column("vec").combine_chunks())


def _steps(x: np.ndarray, digits: int) -> np.ndarray:
    """x in units of its last decimal, whole numbers, halves away from zero."""
    y = x * 10.0**digits
    y += np.copysign(0.5, y)
    return np.trunc(y, out=y)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """To so many decimals, halves away from zero, as SQL's round() has it; no negative zeros. What is not finite stays."""
    y = _steps(x, digits)
    y /= 10.0**digits
    y += 0.0
    return y


def _cuts(n: int, most: int) -> list[slice]:
    """n rows in slices of ``most`` at most, all of about one size."""
    k = max(1, -(-n // most))
    return [slice(n * i // k, n * (i + 1) // k) for i in range(k)]


def _in_order(made, n: int, digits: int) -> np.ndarray | None:
    """A tile's pairs by their rounded values, each as one number: value, row and column (13 bits each). None if a value does not fit. made: the first row and the values of some rows, in turn."""
    out, at = np.empty(n, np.int64), 0
    for row, v in made:
        y = _steps(v, digits)
        if not np.abs(y).max(initial=0) < 1 << 36:
            return None
        place = (np.arange(row, row + len(y))[:, None] << 13) + np.arange(y.shape[1])
        out[at : at + y.size] = ((y.astype(np.int64) << 26) + place).ravel()
        at += y.size
    out.sort()
    return out


def all_pairs(ref: DataFrame, query: DataFrame, value: str, of, known: DataFrame | None = None, digits: int | None = None, vectors: bool = True) -> DataFrame:
    """ref_idx, query_idx and ``value`` of all pairs, where ``of`` (query_idx, queries, ref_idx, references, known) gives a matrix for some rows of both sides.

    Blocks of both sides have PAIR_BLOCK rows, or more in large tables (_grid()), so what is shuffled grows with the rows, not with their pairs; a task makes a block's pairs
    piece by piece. ``known`` rows (query_idx, ref_idx, new_dist) are dealt to the block of their pair, and given to ``of`` as three arrays by query_idx. Without ``vectors`` none are shipped:
    ``of`` gets None. Values are rounded to ``digits``, if given, where they are made: a column's round() costs more than all else that is done to a pair. Pairs of rounded values come in the
    order of these, SIDE x SIDE at a time: equal values lie together, so files take about half of the bytes; other pairs come NARROW references at a time, which files fold as well.
    Blocks are dealt to tasks by their number, as Spark would join small inputs to few tasks, however many pairs come of them.
    """
    if not vectors:
        ref, query = (df.select("frame_idx", F.lit(None).cast("array<double>").alias("vec")) for df in (ref, query))
    (n_ref, width), (n_query, wide) = _sizes(ref), _sizes(query)
    rb, qb = _grid(ref, n_ref, n_query, max(width, wide), PAIR_BLOCK, 2 * TASKS)
    tasks = max(1, min(rb * qb, TASKS * ref.sparkSession.sparkContext.defaultParallelism))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias("qb" if c == "query_idx" else "rb")
    no = lambda kind, c: F.lit(None).cast(kind).alias(c)
    q, r = (df.select("qb", "rb", F.lit(side).alias("side"), F.col("frame_idx").alias("idx"), no("long", "ref_idx"), "vec", no("double", "new_dist")) for side, df in enumerate(_dealt(ref, query, rb, qb)))
    rows = q.unionByName(r)
    if known is not None:
        rows = rows.unionByName(known.select(part("query_idx", qb), part("ref_idx", rb), F.lit(2).alias("side"), F.col("query_idx").alias("idx"), "ref_idx", no("array<double>", "vec"), "new_dist"))
    names = ["ref_idx", "query_idx", value]

    def pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        left, right, some = (table.filter(pc.equal(table.column("side"), n)).sort_by("idx") for n in range(3))
        if not left.num_rows or not right.num_rows:
            return
        (q_idx, a), (r_idx, b) = (_side(x, "idx") if vectors else (x.column("idx").to_numpy(), None) for x in (left, right))
        some = [some.column(c).to_numpy() for c in ("idx", "ref_idx", "new_dist")]

        def made(i: slice, j: slice):
            """The first row, from i's, and the values of so many rows as are made at once."""
            step = max(1, MADE // (j.stop - j.start))
            for at in range(i.start, i.stop, step):
                own = slice(at, min(at + step, i.stop))
                here = slice(np.searchsorted(some[0], q_idx[own.start]), np.searchsorted(some[0], q_idx[own.stop - 1], "right"))
                yield at - i.start, of(q_idx[own], *((a[own], r_idx[j], b[j]) if vectors else (None, r_idx[j], None)), [x[here] for x in some])

        for i in _cuts(len(q_idx), SIDE):
            for j in _cuts(len(r_idx), SIDE):
                order = None if digits is None else _in_order(made(i, j), (i.stop - i.start) * (j.stop - j.start), digits)
                if order is not None:
                    for at in range(0, len(order), HANDED):
                        x = order[at : at + HANDED]
                        yield pa.RecordBatch.from_arrays([pa.array(r_idx[j][x & 8191]), pa.array(q_idx[i][x >> 13 & 8191]), pa.array((x >> 26) / 10.0**digits)], names)
                    continue
                for few in _cuts(j.stop - j.start, NARROW):
                    few = slice(j.start + few.start, j.start + few.stop)
                    wide = few.stop - few.start
                    step = max(1, HANDED // wide)
                    refs = pa.array(np.tile(r_idx[few], step))
                    for row, v in made(i, few):
                        v, own = (v if digits is None else rounded(v, digits)).ravel(), np.repeat(q_idx[i][row : row + len(v)], wide)
                        for at in range(0, len(own), step * wide):
                            some_q, some_v = own[at : at + step * wide], v[at : at + step * wide]
                            yield pa.RecordBatch.from_arrays([refs.slice(0, len(some_q)), pa.array(some_q), pa.array(some_v)], names)

    return rows.repartition(tasks, "qb", "rb").groupBy("qb", "rb").applyInArrow(pairs, f"ref_idx long, query_idx long, {value} double")


def unit_products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return nearest.products(*(x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None] for x in (q, r)))


def similarity_pairs(ref: DataFrame, query: DataFrame, digits: int | None = None) -> DataFrame:
    """ref_idx, query_idx, sim of all pairs, rounded to ``digits``, if given; its size is their product."""
    return all_pairs(ref, query, "sim", lambda _, q, __, r, ___: unit_products(q, r), digits=digits)


def pairwise_distance(ref: DataFrame, query: DataFrame, metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """ref_idx, query_idx, dist of all pairs, rounded to ``digits``, if given; distances to shortlist come from nearest_blocks()."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return all_pairs(ref, query, "dist", lambda _, q, __, r, ___: nearest.between(q, r, metric), digits=digits)


def nearest_blocks(ref: DataFrame, query: DataFrame, k: int = 50, metric: str = "cosine", keys: tuple[str, ...] = (), **options) -> DataFrame:
    """keys, query_idx, rank, ref_idx, dist: the k nearest references of each query, ties to the smaller ref_idx; ``options`` and the work are those of nearest_pairs()."""
    return shortlist_from_pairs(nearest_pairs(ref, query, k, metric, keys, **options), k, keys)


def nearest_pairs(ref: DataFrame, query: DataFrame, k: int = 50, metric: str = "cosine", keys: tuple[str, ...] = (), ref_rows: int | None = None, query_rows: int | None = None, block: int = BLOCK) -> DataFrame:
    """keys, query_idx, ref_idx, dist of the pairs that are among the k nearest of their query in their block of references, and so all that a shortlist can keep of all pairs.

    Rows are dealt by their hash into blocks of about ``block``, or larger ones in large tables (_grid()); each pair of a query and a reference block is one bounded group, of
    which at most k rows for each query are shuffled again. Groups are dealt to tasks by their number, as Spark would join what is few bytes to few tasks, however much work it is. ``keys``
    names columns that must be equal, for many pairs of sequences in one job.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    (n_ref, width), (n_query, wide) = _sizes(ref, keys), _sizes(query, keys)
    rb, qb = _grid(ref, ref_rows or n_ref, query_rows or n_query, max(width, wide), block)
    q, r = _dealt(ref, query, rb, qb, keys)
    types = {f.name: f.dataType.simpleString() for f in query.schema}
    names = [*keys, "query_idx", "ref_idx", "dist"]

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: left.column(c).slice(0, 0) for c in keys} | {"query_idx": pa.array([], pa.int64()), "ref_idx": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        (q_idx, a), (r_idx, b) = _side(left), _side(right)
        best = nearest.Nearest(a, k, metric)
        best.add(b, r_idx)
        i, ids, d = best.rows()
        return pa.Table.from_arrays([*(left.column(c).take(pa.array(i)) for c in keys), pa.array(q_idx[i]), pa.array(ids), pa.array(d)], names)

    grid = [*keys, "qb", "rb"]
    q, r = (x.repartition(APART * rb * qb, *grid) for x in (q, r))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "query_idx long, ref_idx long, dist double"])
    return q.groupBy(*grid).cogroup(r.groupBy(*grid)).applyInArrow(top, schema)


#: Blocks of references that an index has at most; their centres, and no others, are held by every task.
MOST_BLOCKS = 4096
#: Rows that meet all centres at once, and queries that share the balls which any of them needs.
ASKED, TOGETHER = 512, 64


def _unit(column) -> np.ndarray:
    v = arrow.matrix(column)
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]


class BlockIndex:
    """References in balls: each lies with the nearest of some centres, which are references themselves, and a ball's radius bounds what it can hold.

    On unit vectors, a reference in a ball is no nearer to a query than the query is to the centre, less the radius. ``rows`` is the written table of references
    (ref_idx, vec of unit length, ball, part, unit): large balls are dealt into parts of about ``block`` rows, which ``unit`` numbers through. Vectors of zeros are in ball -1, which is always searched.
    """

    def __init__(self, ref: DataFrame, path: str, block: int = BLOCK, balls: int | None = None):
        n = ref.count()
        self.balls = max(1, min(MOST_BLOCKS, balls or -(-2 * n // block)))
        r = ref.select(F.col("frame_idx").cast("long").alias("ref_idx"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
        first = r.where(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("ref_idx"), "ref_idx").limit(self.balls).select("vec").collect()
        centres = np.array([x["vec"] for x in first]) if first else np.zeros((1, 1))
        self.centres = centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None]
        shared = ref.sparkSession.sparkContext.broadcast(self.centres)

        def assign(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, ASKED):
                    part = batch.slice(at, ASKED)
                    v = _unit(part.column(1))
                    d = _apart(v, shared.value)
                    ball = np.where(np.abs(v).sum(axis=1) > 0, d.argmin(axis=1), -1)
                    yield pa.RecordBatch.from_arrays([part.column(0), arrow.lists(v), pa.array(ball.astype(np.int32)), pa.array(d.min(axis=1))], ["ref_idx", "vec", "ball", "away"])

        r.mapInArrow(assign, "ref_idx long, vec array<double>, ball int, away double").write.mode("overwrite").parquet(path)
        rows = ref.sparkSession.read.schema("ref_idx long, vec array<double>, ball int, away double").parquet(path)
        sizes = rows.groupBy("ball").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
        self.n, self.block = n, block
        self.sizes = {x["ball"]: x["n"] for x in sizes}
        radius = {x["ball"]: x["radius"] for x in sizes}
        self.radius = np.array([radius.get(i, -np.inf) for i in range(len(self.centres))])
        #: parts of each ball, from ball -1 on, and the number of the first one; parts are numbered through
        self.parts = np.array([-(-self.sizes.get(i, 0) // block) for i in range(-1, len(self.centres))], np.int64)
        self.first = np.cumsum(self.parts) - self.parts
        known = ref.sparkSession.sparkContext.broadcast((self.parts, self.first))

        def parted(batches):
            parts, first = known.value
            for batch in batches:
                ball = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                part = batch.column(3).to_numpy(zero_copy_only=False) % parts[ball]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(part.astype(np.int32)), pa.array((first[ball] + part).astype(np.int32))], ["ref_idx", "vec", "ball", "part", "unit"])

        self.rows = rows.select("ref_idx", "vec", "ball", F.xxhash64("ref_idx").alias("h")).mapInArrow(parted, "ref_idx long, vec array<double>, ball int, part int, unit int")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def topk_by_balls(index: BlockIndex, query: DataFrame, folder: str, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """topk_similarity() by an index, with the same rows, and a table of one row: compared and all, the parts of balls that queries' bounds left to search, of how many.

    A query meets the ball of its nearest centre first; its k-th distance there bounds the balls that can hold a nearer reference, and only those are searched. A ball with under k
    references bounds nothing. Parts are dealt into cells as large as blocks of the grid, and a query is shipped once to each cell that holds a part it needs, however many it needs there;
    neighbouring queries are searched together in all balls that any of them needs. The bounds lie in ``folder``.
    """
    spark = query.sparkSession
    asked = query.select(F.col("frame_idx").cast("long").alias("query_idx"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    n_query, units = asked.count(), int(index.parts.sum())
    cells, qb = _grid(query, index.n, n_query, index.centres.shape[1], index.block)
    each = max(1, -(-units // cells))
    cells = max(1, -(-units // each))
    last = np.maximum(index.first + index.parts - 1, 0) // each
    at = np.arange(cells)
    holds = ((index.first[:, None] // each <= at) & (at <= last[:, None]) & (index.parts > 0)[:, None]).astype(np.float32)
    shared = spark.sparkContext.broadcast((index.centres, index.radius, index.parts, holds))

    def wanted(v: np.ndarray, limit: np.ndarray | None, only: np.ndarray) -> np.ndarray:
        """[query, ball of ``only``]: whether a query needs the ball (-1 comes first); without limits, its home."""
        centres, radius, parts, _ = shared.value
        out = np.zeros((len(v), len(only)), bool)
        real = np.flatnonzero(only >= 0)
        if limit is None:
            out[:, real] = _apart(v, centres).argmin(axis=1)[:, None] == only[None, real]
        else:
            out[:, real] = ~(_apart(v, centres[only[real]]) - radius[None, only[real]] > limit[:, None] + 1e-6)
            out[:, only < 0] = True
        return out & (parts[only + 1] > 0)[None, :]

    def met(batches, first: bool):
        """query, vec, home, limit of some queries at a time, with what they need of all balls."""
        every = np.arange(-1, len(shared.value[0]))
        for batch in batches:
            for lo in range(0, batch.num_rows, ASKED):
                part = batch.slice(lo, ASKED)
                v = _unit(part.column(1))
                limit = None
                if not first:
                    limit = part.column(2).fill_null(np.inf).to_numpy(zero_copy_only=False).astype(np.float64)
                    limit = np.where((np.abs(v).sum(axis=1) > 0) & np.isfinite(limit), np.sqrt(np.maximum(2 * limit, 0)), np.inf)
                yield part, v, limit, wanted(v, limit, every)

    def meet(first: bool):
        def run(batches):
            for part, v, limit, need in met(batches, first):
                q, cell = np.nonzero(need.astype(np.float32) @ shared.value[3])
                home = _apart(v, shared.value[0]).argmin(axis=1)
                limits = pa.nulls(len(q), pa.float64()) if limit is None else pa.array(limit[q])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q)), arrow.lists(v).take(pa.array(q)), limits, pa.array(home[q].astype(np.int32)), pa.array(cell.astype(np.int32))], ["query_idx", "vec", "limit", "home", "cell"])

        return run

    def count(batches):
        for part, _, _, need in met(batches, False):
            yield pa.RecordBatch.from_arrays([pa.array([int((need * shared.value[2][None, :]).sum())], pa.int64())], ["n"])

    def top(first: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            if left.num_rows and right.num_rows:
                left, right = left.sort_by("home"), right.sort_by("ball")
                (q_idx, q), (r_idx, r), ball = _side(left, "query_idx"), _side(right, "ref_idx"), right.column("ball").to_numpy()
                here, start, n = np.unique(ball, return_index=True, return_counts=True)
                limit = None if first else left.column("limit").to_numpy()

                def need(lo: int) -> tuple[int, ...]:
                    balls = np.flatnonzero(wanted(q[lo : lo + TOGETHER], None if first else limit[lo : lo + TOGETHER], here).any(axis=0))
                    return tuple((balls if n[balls].sum() < 0.8 * len(r) else np.arange(len(here))).tolist())

                for balls, los in itertools.groupby(range(0, len(q), TOGETHER), need):
                    if balls:
                        los = list(los)
                        some = slice(los[0], los[-1] + TOGETHER)
                        rows = slice(None) if len(balls) == len(here) else np.concatenate([np.arange(start[b], start[b] + n[b]) for b in balls])
                        best = nearest.Nearest(q[some], k)
                        best.add(r[rows], r_idx[rows])
                        i, ids, d = best.rows()
                        out.append((q_idx[some][i], ids, d))
            columns = [np.concatenate(c) for c in zip(*out)]
            return pa.table(dict(zip(("query_idx", "ref_idx", "dist"), columns)))

        return run

    def searched(rows: DataFrame, first: bool) -> DataFrame:
        q = rows.mapInArrow(meet(first), "query_idx long, vec array<double>, limit double, home int, cell int").withColumn("qb", F.pmod(F.xxhash64("query_idx"), F.lit(qb)).cast("int"))
        r = index.rows.select("ref_idx", "vec", "ball", F.floor(F.col("unit") / each).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
        return q.groupBy("cell", "qb").cogroup(r.groupBy("cell", "qb")).applyInArrow(top(first), "query_idx long, ref_idx long, dist double")

    near = searched(asked, True).groupBy(F.col("query_idx").alias("_q")).agg(F.count("*").alias("n"), F.max("dist").alias("bound"))
    # a ball in several cells gives k rows in each: the greatest distance still bounds
    near.where(F.col("n") >= k).select("_q", "bound").write.mode("overwrite").parquet(f"{folder}/bounds")
    bound = spark.read.schema("_q long, bound double").parquet(f"{folder}/bounds")
    bounded = asked.join(bound, F.col("query_idx") == F.col("_q"), "left").select("query_idx", "vec", "bound")
    report = bounded.mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared")).withColumn("all", F.lit(n_query * units).cast("long"))
    return shortlist_from_pairs(searched(bounded, False), k).withColumn("sim", 1 - F.col("dist")), report


def nearest_in_place(ref: DataFrame, queries: list, k: int = 50, metric: str = "cosine") -> DataFrame:
    """query_idx, rank, ref_idx, dist, as nearest_blocks() gives them, of queries (frame_idx, vec) that every task holds: references stay where they are.

    A task compares what it reads batch by batch and keeps the k nearest of each query, so only k rows for each query and task are held and shuffled.
    """
    ids = np.array([r[0] for r in queries], np.int64)
    shared = ref.sparkSession.sparkContext.broadcast((ids, np.array([r[1] for r in queries], np.float64)))

    def top(batches):
        ids, asked = shared.value
        best = nearest.Nearest(asked, k, metric)
        for batch in batches:
            best.add(arrow.matrix(batch.column(1)), batch.column(0).to_numpy())
        i, found, d = best.rows()
        for at in range(0, len(i), HANDED):
            some = slice(at, at + HANDED)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[some]]), pa.array(found[some]), pa.array(d[some])], ["query_idx", "ref_idx", "dist"])

    found = ref.select(F.col("frame_idx").cast("long").alias("frame_idx"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(top, "query_idx long, ref_idx long, dist double")
    return shortlist_from_pairs(found, k)


def topk_of_batch(ref: DataFrame, query: DataFrame, k: int = 50, ref_rows: int | None = None, most_values: int = 1 << 22) -> DataFrame:
    """topk_similarity() of a batch against a lasting table of references: in place if the batch has at most ``most_values`` numbers (32 MB), else by the grid."""
    values = query.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("n")).first()["n"]
    if values > most_values:
        return topk_similarity(ref, query, k, ref_rows=ref_rows)
    rows = query.select("frame_idx", F.col("vec").cast("array<double>").alias("vec")).collect()
    if not rows:
        return topk_similarity(ref, query, k, ref_rows=ref_rows)
    return nearest_in_place(ref, rows, k).withColumn("sim", 1 - F.col("dist"))


def topk_similarity(ref: DataFrame, query: DataFrame, k: int = 50, **options) -> DataFrame:
    """query_idx, rank (from 1), ref_idx, sim, dist = 1 - sim."""
    return nearest_blocks(ref, query, k, "cosine", **options).withColumn("sim", 1 - F.col("dist"))


def shortlist_from_pairs(pairs: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The k smallest distances of each query, with their rank; Spark limits each task's rows before the shuffle."""
    best = Window.partitionBy(*keys, "query_idx").orderBy("dist", "ref_idx")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def best_of_batches(pairs: DataFrame, k: int) -> DataFrame:
    """query_idx, ref_idx, dist of the pairs that are among the k least of their query in their own batch, and so all that shortlist_from_pairs() can keep: what it sorts, of a table of
    all pairs, is a few of a hundred. Any order of rows is right; neighbouring rows of one query are what leaves little."""
    def run(batches):
        for batch in batches:
            q, r, d = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.lexsort((r, d, q))
            q = q[order]
            start = np.maximum.accumulate(np.where(np.append(True, q[1:] != q[:-1]), np.arange(len(q)), 0)) if len(q) else q
            yield batch.take(pa.array(order[np.arange(len(q)) - start < k]))

    return pairs.select(F.col("query_idx").cast("long").alias("query_idx"), F.col("ref_idx").cast("long").alias("ref_idx"), F.col("dist").cast("double").alias("dist")).where(
        "query_idx is not null and ref_idx is not null and dist is not null").mapInArrow(run, "query_idx long, ref_idx long, dist double")


def attach_keypoints(shortlist: DataFrame, ref_packs: DataFrame, query_packs: DataFrame) -> DataFrame:
    """Candidates with ref_n, ref_kps, query_n, query_kps; where a side has no pack they are null, and the candidate stays.

    The shortlist is read three times: give a written one, not a plan that searches anew.
    """
    r = ref_packs.select(F.col("frame_idx").alias("ref_idx"), F.col("n").alias("ref_n"), F.col("kps").alias("ref_kps"))
    q = query_packs.select(F.col("frame_idx").alias("query_idx"), F.col("n").alias("query_n"), F.col("kps").alias("query_kps"))
    needed = lambda packs, c: packs.join(shortlist.select(c).distinct(), c, "left_semi")
    return shortlist.join(needed(r, "ref_idx"), "ref_idx", "left").join(needed(q, "query_idx"), "query_idx", "left")


def plan_pairs(descriptors: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference and query rows of many (ref_seq, query_seq) pairs in one job, with the pair as key."""
    p = small(pairs.select("ref_seq", "query_seq"))
    r = descriptors.withColumnRenamed("seq", "ref_seq").join(p, "ref_seq")
    q = descriptors.withColumnRenamed("seq", "query_seq").join(p, "query_seq")
    return r, q
