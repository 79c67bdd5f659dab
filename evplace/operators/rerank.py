"""Local matching of shortlisted pairs, geometric checks, and new distances from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evplace.functions import arrow, kernels
from evplace.functions.arrow import flat as _flat
from evplace.functions.arrow import numbers as _numbers
from evplace.operators import similarity

PAIR = ("query_idx", "ref_idx")


def _descriptors(rows: pa.Array) -> np.ndarray:
    """[keypoint, value], in single precision where the column is."""
    values, ends = _flat(rows.field("desc"))
    n = np.diff(ends)
    if len(n) and n.min() != n.max():
        raise ValueError("keypoint descriptors of unequal lengths")
    out = values.to_numpy(zero_copy_only=False)
    return out.astype(np.float32 if out.dtype == np.float32 else np.float64, copy=False).reshape(len(n), -1 if len(n) else 0)


def dense_packs(packs: DataFrame) -> DataFrame:
    """packs with each frame's keypoints as one binary value, which joins and tasks copy whole; what match_pairs() needs, so without scores.

    Little-endian: the number of keypoints and the bytes of a descriptor's value (32-bit), x, y (64-bit floats), kp_idx (32-bit), descriptors.
    Null packs stay null, empty ones have no keypoints.
    """
    @F.arrow_udf("binary")
    def dense(kps: pa.Array) -> pa.Array:
        rows, ends = _flat(kps)
        desc = _descriptors(rows)
        place = [_numbers(rows, c).astype("<f8") for c in ("x", "y")] + [_numbers(rows, "kp_idx").astype("<i4")]
        columns = [*place, desc.astype(desc.dtype.newbyteorder("<"), copy=False)]
        known = np.asarray(kps.is_valid())
        return pa.array([np.array([e - s, desc.itemsize], "<i4").tobytes() + b"".join(c[s:e].tobytes() for c in columns) if k else None for s, e, k in zip(ends, ends[1:], known)], pa.binary())

    return packs.withColumn("kps", dense("kps"))


def _side(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """The n + 1 offsets of a column of packs, plain or dense, and its keypoints end to end: kp_idx, x and y, and descriptors."""
    if not pa.types.is_binary(column.type):
        rows, ends = _flat(column)
        return ends, {c: _numbers(rows, c) for c in ("kp_idx", "x", "y")}, _descriptors(rows).astype(np.float64, copy=False)
    data = [v.as_py() or bytes(8) for v in column]
    heads = [np.frombuffer(v, "<i4", 2).tolist() for v in data]
    take = lambda kind, skip: np.concatenate([np.empty(0)] + [np.frombuffer(v, kind, n, 8 + skip * n) for v, (n, _) in zip(data, heads)])
    found = [np.frombuffer(v, f"<f{size}", -1, 8 + 20 * n).reshape(n, -1) for v, (n, size) in zip(data, heads) if n]
    if len({x.shape[1] for x in found}) > 1:
        raise ValueError("keypoint descriptors of unequal lengths")
    desc = np.concatenate(found).astype(np.float64, copy=False) if found else np.empty((0, 0))
    return np.concatenate([[0], np.cumsum([n for n, _ in heads], dtype=np.int64)]), {"x": take("<f8", 0), "y": take("<f8", 8), "kp_idx": take("<i4", 16)}, desc


def match_pairs(candidates: DataFrame, kind: str = "mutual", ratio: float = 0.8) -> DataFrame:
    """query_idx, ref_idx, i, j, dist, src_x, src_y, dst_x, dst_y: matches of query keypoint i and reference keypoint j.

    candidates come from attach_keypoints(), with plain packs or dense_packs(); a pair of which a side is missing has no matches.
    Descriptors are read from Arrow's buffers, and pairs of one shape share one batched product. It runs over whatever rows a task
    holds, so a popular reference frame needs no group of its own.
    """
    if kind not in ("mutual", "ratio"):
        raise ValueError("kind must be mutual or ratio")
    names = ["query_idx", "ref_idx", "i", "j", "dist", "src_x", "src_y", "dst_x", "dst_y"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                (q_ends, q, q_desc), (r_ends, r, r_desc) = _side(part.column(2)), _side(part.column(3))
                if not len(q_desc) or not len(r_desc):
                    continue
                pair, i, j, d = kernels.match_lists(q_desc, q_ends, r_desc, r_ends, kind, ratio)
                pair = pa.array(pair)
                columns = [part.column(0).take(pair), part.column(1).take(pair), pa.array(q["kp_idx"][i].astype(np.int32)), pa.array(r["kp_idx"][j].astype(np.int32)), pa.array(d)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(s[c][k]) for s, k in ((q, i), (r, j)) for c in ("x", "y")], names)

    return candidates.select(*[F.col(c).cast("long").alias(c) for c in PAIR], "query_kps", "ref_kps").mapInArrow(run, "query_idx long, ref_idx long, i int, j int, dist double, src_x double, src_y double, dst_x double, dst_y double")


def _pack(data: bytes) -> tuple[np.ndarray, ...]:
    """kp_idx, x, y, descriptors and their squared lengths of one dense pack, as views where they lie in order."""
    n, size = np.frombuffer(data, "<i4", 2).tolist()
    x, y, kp = np.frombuffer(data, "<f8", n, 8), np.frombuffer(data, "<f8", n, 8 + 8 * n), np.frombuffer(data, "<i4", n, 8 + 16 * n)
    desc = np.frombuffer(data, f"<f{size}", -1, 8 + 20 * n).reshape(n, -1 if n else 0)
    return kp, x, y, desc, np.einsum("ij,ij->i", desc, desc)


#: Bytes of packs that a block holds at most, where it grows beyond the packs asked for.
HELD = 1 << 25


def _pack_bytes(packs: DataFrame) -> int:
    """Bytes of the largest pack."""
    kps = F.col("kps")
    size = F.octet_length(kps) if dict(packs.dtypes)["kps"] == "binary" else F.size(kps) * (20 + 8 * F.size(kps[0]["desc"]))
    return max(packs.where("n > 0").agg(F.max(size)).first()[0] or 0, 64)


def match_shortlist(shortlist: DataFrame, ref_packs: DataFrame, query_packs: DataFrame, kind: str = "mutual", ratio: float = 0.8, query_block: int = 16, ref_block: int = 128) -> DataFrame:
    """query_idx, ref_idx, i, j, dist, src_x, src_y, dst_x, dst_y: matches of a shortlist's pairs, as match_pairs() gives them.

    Pairs are dealt by blocks of neighbouring query and reference frames, and a pack goes once to each block that it has a pair in, so what is shuffled grows
    with packs times the blocks that they meet, not with pairs. A block holds at most ``query_block`` + ``ref_block`` packs, however many pairs
    ask for one of them; blocks of both sides are larger by one factor, so that candidates which lie anywhere do not make a block for each pair, where
    HELD bytes of packs allow it and there are yet four blocks of queries for each core. Products are made in the precision that packs have, distances of matches in double. The shortlist is
    read several times: give a written one. A pair of which a side has no pack, or no keypoints, has no matches; repeated pairs have theirs once.
    """
    if kind not in ("mutual", "ratio"):
        raise ValueError("kind must be mutual or ratio")
    lo, hi = shortlist.agg(F.min("query_idx"), F.max("query_idx")).first()
    frames = 0 if lo is None else int(hi) - int(lo) + 1
    room = HELD // (max(_pack_bytes(p) for p in (ref_packs, query_packs)) * (query_block + ref_block))
    grown = max(1, min(room, frames // (query_block * 4 * shortlist.sparkSession.sparkContext.defaultParallelism)))
    query_block, ref_block = query_block * grown, ref_block * grown
    block = lambda c, n: F.floor(F.col(c) / n).alias(c[0] + "b")
    pairs = shortlist.select(*[F.col(c).cast("long").alias(c) for c in PAIR], block("query_idx", query_block), block("ref_idx", ref_block)).dropDuplicates(["qb", "rb", *PAIR])
    sides = None
    for side, (c, packs) in enumerate((("query_idx", query_packs), ("ref_idx", ref_packs))):
        dense = packs if dict(packs.dtypes)["kps"] == "binary" else dense_packs(packs)
        own = dense.where("n > 0").select(F.col("frame_idx").cast("long").alias(c), "kps")
        met = own.join(pairs.select("qb", "rb", c).distinct(), c).select(F.col("qb").alias("side_qb"), F.col("rb").alias("side_rb"), F.lit(side).alias("side"), F.col(c).alias("idx"), "kps")
        sides = met if sides is None else sides.unionByName(met)
    names = ["query_idx", "ref_idx", "i", "j", "dist", "src_x", "src_y", "dst_x", "dst_y"]
    schema = pa.schema([(c, pa.int64() if c in PAIR else pa.int32() if c in ("i", "j") else pa.float64()) for c in names])

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        held: tuple[dict, dict] = ({}, {})
        for side, idx, data in zip(*(right.column(c).to_pylist() for c in ("side", "idx", "kps"))):
            held[side][idx] = _pack(data)
        out = [[] for _ in names]
        small = []
        for q_idx, r_idx in zip(*(left.column(c).to_pylist() for c in PAIR)):
            if q_idx not in held[0] or r_idx not in held[1]:
                continue
            (q_kp, q_x, q_y, q, q2), (r_kp, r_x, r_y, r, r2) = held[0][q_idx], held[1][r_idx]
            if len(q) * len(r) <= SMALL and q.dtype == r.dtype == np.float64:
                small.append((q_idx, r_idx))
                continue
            i, j = kernels.nearest_pairs(q, q2, r, r2, kind, ratio)
            if len(i):
                apart = q[i].astype(np.float64) - r[j]
                for column, v in zip(out, (np.full(len(i), q_idx), np.full(len(i), r_idx), q_kp[i], r_kp[j], np.sqrt(np.einsum("ij,ij->i", apart, apart)), q_x[i], q_y[i], r_x[j], r_y[j])):
                    column.append(v)
        for at in range(0, len(small), 4096):
            for column, v in zip(out, _match_small(small[at : at + 4096], held, kind, ratio)):
                column.append(v)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0), f.type) for c, f in zip(out, schema)], schema=schema)

    return pairs.groupBy("qb", "rb").cogroup(sides.groupBy("side_qb", "side_rb")).applyInArrow(match, ", ".join(f"{c} {'long' if c in PAIR else 'int' if c in ('i', 'j') else 'double'}" for c in names))


#: Distances of a pair up to which pairs share a batched product.
SMALL = 1 << 10


def _match_small(pairs: list[tuple[int, int]], held: tuple[dict, dict], kind: str, ratio: float) -> tuple[np.ndarray, ...]:
    """Columns of the matches of pairs of small packs, those of one shape in one batched product."""
    sides = []
    for side in (0, 1):
        packs = [held[side][p[side]] for p in pairs]
        ends = np.concatenate([[0], np.cumsum([len(p[0]) for p in packs])])
        sides.append((ends, *(np.concatenate([p[c] for p in packs]) for c in range(4))))
    (q_ends, q_kp, q_x, q_y, q), (r_ends, r_kp, r_x, r_y, r) = sides
    pair, i, j, _ = kernels.match_lists(q, q_ends, r, r_ends, kind, ratio)
    idx, apart = np.array(pairs, np.int64)[pair], q[i] - r[j]
    return idx[:, 0], idx[:, 1], q_kp[i], r_kp[j], np.sqrt(np.einsum("ij,ij->i", apart, apart)), q_x[i], q_y[i], r_x[j], r_y[j]


def mutual_nn_matches(candidates: DataFrame) -> DataFrame:
    return match_pairs(candidates, "mutual")


def ratio_matches(candidates: DataFrame, ratio: float = 0.8) -> DataFrame:
    return match_pairs(candidates, "ratio", ratio)


def best_matches(matches: DataFrame, most: int = 170) -> DataFrame:
    best = Window.partitionBy(*PAIR).orderBy("dist", "i", "j")
    return matches.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).drop("r")


def translation_inliers(matches: DataFrame, thresh: float = 5.0, max_matches: int = 170) -> DataFrame:
    """query_idx, ref_idx, inliers: matches within ``thresh`` of the lower median displacement, for pairs of four matches and more.

    One shuffle by pair; a pair's row holds at most ``max_matches`` displacements.
    """
    m = best_matches(matches, max_matches).withColumn("dx", F.col("dst_x") - F.col("src_x")).withColumn("dy", F.col("dst_y") - F.col("src_y"))
    middle = lambda c: F.expr(f"percentile_disc(0.5) within group (order by {c})")
    m = m.groupBy(*PAIR).agg(F.collect_list(F.struct("dx", "dy")).alias("m"), middle("dx").alias("mx"), middle("dy").alias("my"))
    near = F.filter("m", lambda d: F.sqrt(F.pow(d["dx"] - F.col("mx"), 2) + F.pow(d["dy"] - F.col("my"), 2)) < thresh)
    return m.select(*PAIR, F.when(F.size("m") >= 4, F.size(near)).otherwise(0).cast("long").alias("inliers"))


def homography_inliers(matches: DataFrame, thresh: float = 5.0, max_iters: int = 100, max_matches: int = 170, seed: int = 0) -> DataFrame:
    """query_idx, ref_idx, inliers by sampled homographies, fitted again to what they bring near; samples are seeded by the pair. One shuffle by pair, of
    ``max_matches`` at most; a task samples all pairs of a batch in step."""
    order = F.array_sort(F.collect_list(F.struct("dist", "i", "j", "src_x", "src_y", "dst_x", "dst_y")))
    packed = best_matches(matches, max_matches).groupBy(*PAIR).agg(order.alias("m"))
    packed = packed.withColumn("seed", F.xxhash64(*PAIR, F.lit(seed)))

    def run(batches):
        for batch in batches:
            rows, ends = _flat(batch.column(2))
            p = np.stack([_numbers(rows, c) for c in ("src_x", "src_y", "dst_x", "dst_y")], axis=1) if len(rows) else np.empty((0, 4))
            found = kernels.consensus(p[:, :2], p[:, 2:], ends, np.asarray(batch.column(3)).astype(np.int64).view(np.uint64), thresh, max_iters)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["query_idx", "ref_idx", "inliers"])

    return packed.mapInArrow(run, "query_idx long, ref_idx long, inliers long")


def fuse_inliers(shortlist: DataFrame, inliers: DataFrame, weight: float = 0.05) -> DataFrame:
    """shortlist with inliers and new_dist = dist - weight * inliers."""
    found = shortlist.join(inliers.select(*PAIR, "inliers"), list(PAIR), "left").withColumn("inliers", F.coalesce("inliers", F.lit(0)).cast("long"))
    return found.withColumn("new_dist", F.when(F.col("inliers") > 0, F.col("dist") - weight * F.col("inliers")).otherwise(F.col("dist")))


def full_column(pairs: DataFrame, reranked: DataFrame, fill: str = "base") -> DataFrame:
    """Every pair with its new distance; others keep their own, or are infinite."""
    if fill not in ("base", "inf"):
        raise ValueError("fill must be base or inf")
    other = F.col("dist") if fill == "base" else F.lit(float("inf"))
    return pairs.select(*PAIR, "dist").join(reranked.select(*PAIR, "new_dist"), list(PAIR), "left").select(*PAIR, F.coalesce("new_dist", other).alias("new_dist"))


def full_columns(ref: DataFrame, query: DataFrame, reranked: DataFrame, fill: str = "base", digits: int | None = None) -> DataFrame:
    """full_column() of all pairs of references and queries by their similarity, rounded to ``digits``, if given, block by block: pairs are made where re-ranked ones have been dealt, and are never shuffled."""
    if fill not in ("base", "inf"):
        raise ValueError("fill must be base or inf")
    new = reranked.select(*[F.col(c).cast("long").alias(c) for c in PAIR], F.col("new_dist").cast("double").alias("new_dist")).where("new_dist is not null")

    def column(q_idx, q, r_idx, r, some: list[np.ndarray]) -> np.ndarray:
        out = 1 - similarity.unit_products(q, r) if fill == "base" else np.full((len(q_idx), len(r_idx)), np.inf)
        if len(some[0]):
            # several rows of one frame have one new distance
            (a, at_q), (b, at_r) = (np.unique(x, return_inverse=True) for x in (q_idx, r_idx))
            i, j = (np.minimum(np.searchsorted(x, k), len(x) - 1) for x, k in zip((a, b), some))
            there = (a[i] == some[0]) & (b[j] == some[1])
            i, j, new = i[there], j[there], some[2][there] if digits is None or fill == "base" else similarity.rounded(some[2][there], digits)
            if len(a) == len(q_idx) and len(b) == len(r_idx):
                out[np.argsort(at_q)[i], np.argsort(at_r)[j]] = new
            else:
                value, own = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), bool)
                value[i, j], own[i, j] = new, True
                out = np.where(own[at_q][:, at_r], value[at_q][:, at_r], out)
        return out

    return similarity.all_pairs(ref, query, "new_dist", column, new, digits if fill == "base" else None, vectors=fill == "base").select(*PAIR, "new_dist")


def best_match(reranked: DataFrame) -> DataFrame:
    """query_idx, ref_idx, new_dist, inliers of the least new distance (ties: the better rank)."""
    best = reranked.groupBy("query_idx").agg(F.min(F.struct("new_dist", "rank", "ref_idx", "inliers")).alias("b"))
    return best.select("query_idx", "b.ref_idx", "b.new_dist", "b.inliers")


def mutual_mean_distance(shortlist: DataFrame, matches: DataFrame) -> DataFrame:
    """query_idx, ref_idx, dist: the mean distance of a pair's matches, 1 without any."""
    means = matches.groupBy(*PAIR).agg(F.avg("dist").alias("mean"))
    return shortlist.select(*PAIR).join(means, list(PAIR), "left").select(*PAIR, F.coalesce("mean", F.lit(1.0)).alias("dist"))


#: Cells of maps that one call of a depth kernel takes, about.
STACK = 1 << 21


def _stacks(h: np.ndarray, w: np.ndarray):
    """Rows of one shape, so many at a time as STACK holds: (height, width, rows)."""
    for high, wide in np.unique(np.stack([h, w], axis=1), axis=0).tolist():
        rows = np.flatnonzero((h == high) & (w == wide))
        step = max(1, STACK // max(1, high * wide))
        for at in range(0, len(rows), step):
            yield high, wide, rows[at : at + step]


def _maps(column: pa.Array, rows: np.ndarray, h: int, w: int) -> np.ndarray:
    return arrow.matrix(column.take(pa.array(rows))).reshape(len(rows), h, w)


def _pair_errors(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and err of pairs with maps (h, w, a) and (h2, w2, b): one call for all pairs of a shape in a batch; null where a map is missing. Unequal shapes are an error."""
    def run(batches):
        for batch in batches:
            h, w, a, h2, w2, b = (batch.column(len(keep) + i) for i in range(6))
            there = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
            out = np.full(batch.num_rows, np.nan)
            known = np.flatnonzero(there)
            shape = [np.asarray(c.take(pa.array(known))).astype(np.int64) for c in (h, w, h2, w2)]
            if (shape[0] != shape[2]).any() or (shape[1] != shape[3]).any():
                raise ValueError("depth maps of a pair have unequal shapes")
            for high, wide, rows in _stacks(shape[0], shape[1]):
                out[known[rows]] = kernels.masked_ssim_errors(_maps(a, known[rows], high, wide), _maps(b, known[rows], high, wide))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, mask=~there)], [*keep, "err"])

    kinds = dict(pairs.dtypes)
    return pairs.select(*keep, "h", "w", "a", "h2", "w2", "b").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", err double")


def depth_errors(shortlist: DataFrame, ref_depth: DataFrame, query_depth: DataFrame, size: tuple[int, int] | None = (28, 28)) -> DataFrame:
    """shortlist with err, null where a map is missing. Maps (frame_idx, h, w, px row by row) are scaled to ``size`` first, if given: each once, and small ones meet in pairs."""
    r, q = (d if size is None else area_downsample(d, size) for d in (ref_depth, query_depth))
    q = q.select(F.col("frame_idx").alias("query_idx"), "h", "w", F.col("px").alias("a"))
    r = r.select(F.col("frame_idx").alias("ref_idx"), F.col("h").alias("h2"), F.col("w").alias("w2"), F.col("px").alias("b"))
    return _pair_errors(shortlist.join(r, "ref_idx", "left").join(q, "query_idx", "left"), shortlist.columns)


def depth_rerank(shortlist: DataFrame, ref_depth: DataFrame, query_depth: DataFrame, weight: float = 0.15, tau: float = 0.3, err_thr: float = 0.7, size: tuple[int, int] | None = (28, 28)) -> DataFrame:
    """shortlist with err and new_dist = dist - weight * exp(-err / tau) where err is under ``err_thr``."""
    e = depth_errors(shortlist, ref_depth, query_depth, size)
    return e.withColumn("new_dist", F.when(F.col("err") < err_thr, F.col("dist") - weight * F.exp(-F.col("err") / tau)).otherwise(F.col("dist")))


def masked_ssim_error(pairs: DataFrame) -> DataFrame:
    """query_idx, ref_idx, err of pairs that carry both maps: h, w, a, b."""
    return _pair_errors(pairs.withColumn("h2", F.col("h")).withColumn("w2", F.col("w")), list(PAIR))


def area_downsample(depth: DataFrame, out: tuple[int, int] = (28, 28)) -> DataFrame:
    """Depth maps scaled by area: h, w and px change. Maps of one shape in a batch are one product; missing ones stay null."""
    @F.arrow_udf("array<double>")
    def scale(h: pa.Array, w: pa.Array, px: pa.Array) -> pa.Array:
        there = np.asarray(px.is_valid())
        known, small = np.flatnonzero(there), np.zeros((len(px), out[0] * out[1]))
        h, w = (np.asarray(c.take(pa.array(known))).astype(np.int64) for c in (h, w))
        for high, wide, rows in _stacks(h, w):
            small[known[rows]] = kernels.area_downsample(_maps(px, known[rows], high, wide), out).reshape(len(rows), -1)
        return arrow.lists(small).filter(pa.array(there)).take(pa.array(np.where(there, np.cumsum(there) - 1, 0), mask=~there))

    return depth.withColumn("px", scale("h", "w", "px")).withColumn("h", F.lit(out[0])).withColumn("w", F.lit(out[1]))


def gate_features(shortlist: DataFrame, k: int = 50) -> DataFrame:
    """query_idx, features: the k best similarities in order, the 1st, 2nd, 5th and 10th, gaps from the first to the others, mean, deviation,
    its z-score, entropy and greatest value of their softmax. Queries with under k values raise an error."""
    v = F.col("v")
    packed = shortlist.where(F.col("rank") <= k).groupBy("query_idx").agg(F.array_sort(F.collect_list(F.struct("rank", "sim"))).alias("s"), F.avg("sim").alias("mean"), F.greatest(F.coalesce(F.stddev_samp("sim"), F.lit(0.0)), F.lit(1e-6)).alias("std"))
    packed = packed.select("query_idx", F.transform("s", lambda s: s["sim"]).alias("v"), "mean", "std")
    packed = packed.withColumn("v", F.when(F.size(v) >= k, v).otherwise(F.raise_error(F.lit(f"a query has under {k} similarities")).cast("array<double>")))
    at = lambda i: F.element_at(v, min(i, k))
    e = F.transform(v, lambda x: F.exp(x - at(1)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    packed = packed.withColumn("p", F.transform(e, lambda x: x / total))
    entropy = -F.aggregate("p", F.lit(0.0), lambda s, x: s + x * F.log(F.greatest(x, F.lit(1e-12))))
    more = F.array(at(1), at(2), at(5), at(10), at(1) - at(2), at(1) - at(5), at(1) - at(10), F.col("mean"), F.col("std"), (at(1) - F.col("mean")) / F.col("std"), entropy, F.array_max("p"))
    return packed.select("query_idx", F.concat(v, more).alias("features"))


def gate_decide(logits: DataFrame, temperature: float = 1.0, tau: float = 0.5, var_thr: float = 0.05, low: bool = True) -> DataFrame:
    """query_idx, p, var, rerank: mean and population variance of members' probabilities; re-rank if unsure."""
    p = 1 / (1 + F.exp(-F.col("logit") / max(temperature, 1e-6)))
    g = logits.groupBy("query_idx").agg(F.avg(p).alias("p"), F.var_pop(p).alias("var"))
    return g.withColumn("rerank", ((F.col("p") < tau) if low else (F.col("p") >= tau)) | (F.col("var") > var_thr))
