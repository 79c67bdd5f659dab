"""Descriptor and keypoint tables, packed keypoints, binary keypoint logs, per-frame feature files, results."""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evplace.functions.vectors import l2_normalize
from evplace.sources.keypoint_logs import log_types


def write_descriptors(df: DataFrame, path: str) -> None:
    """One folder for each sequence."""
    df.write.mode("overwrite").partitionBy("seq").parquet(path)


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """seq, frame_idx, vec (unit length)."""
    return spark.read.schema("frame_idx long, vec array<double>, seq string").parquet(path).select("seq", "frame_idx", l2_normalize(F.col("vec")).alias("vec"))


def write_shortlist(df: DataFrame, path: str) -> None:
    """A re-ranked result, by pair of sequences."""
    df.write.mode("overwrite").partitionBy("ref_seq", "query_seq").parquet(path)


def pack_keypoints(kps: DataFrame, frames: DataFrame, k_max: int) -> DataFrame:
    """seq, frame_idx, n, kps: the best k_max keypoints of each frame in one row; frames without any have n = 0.

    The best are chosen by a ranking window before they are collected, so a row never holds more than k_max.
    """
    from pyspark.sql import Window

    best = Window.partitionBy("seq", "frame_idx").orderBy(F.desc("score"), "kp_idx")
    top = kps.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k_max)
    packed = top.groupBy("seq", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("r", "kp_idx", "x", "y", "score", "desc"))).alias("kps"))
    packed = packed.select("seq", "frame_idx", F.transform("kps", lambda k: F.struct(k["kp_idx"].alias("kp_idx"), k["x"].alias("x"), k["y"].alias("y"), k["score"].alias("score"), k["desc"].alias("desc"))).alias("kps"))
    out = frames.select("seq", "frame_idx").join(packed, ["seq", "frame_idx"], "left")
    return out.select("seq", "frame_idx", F.when(F.col("kps").isNull(), 0).otherwise(F.size("kps")).alias("n"), "kps")


def unpack_keypoints(packs: DataFrame) -> DataFrame:
    """seq, frame_idx, pos, kp_idx, x, y, score, desc: the first n of each row."""
    valid = packs.where("n > 0").select("seq", "frame_idx", F.posexplode(F.slice("kps", 1, F.col("n"))).alias("pos", "k"))
    return valid.select("seq", "frame_idx", "pos", "k.*")


def encode_keypoint_log(frames: pd.DataFrame, h: int, w: int, top: int, left: int, k: int) -> bytes:
    """A keypoint log of frames (frame_idx, t, kps: x, y of the cropped image, score, desc), at most k keypoints each; null kps are none."""
    packs = [[] if p is None else list(p)[:k] for p in frames["kps"]]
    d = next((len(p[0]["desc"]) for p in packs if p), 0)
    head, record = log_types(k, d)
    out = np.zeros(len(packs), record)
    out["yx"] = -1
    for i, (f, t, p) in enumerate(zip(frames["frame_idx"], frames["t"], packs)):
        out["frame"][i], out["t"][i], out["n"][i] = f, t, len(p)
        for j, q in enumerate(p):
            out["yx"][i, j], out["score"][i, j], out["desc"][i, j] = (q["y"], q["x"]), q["score"], q["desc"]
    return np.array([(b"EKPR", 1, h, w, top, left, k, d)], head).tobytes() + out.tobytes()


#: A name without an index sorts behind all others.
NO_INDEX = 10**18


def read_npz_features(spark: SparkSession, path: str, pattern: str = r"(\d+)\.npz$") -> DataFrame:
    """frame_idx, vec (unit length) of per-frame feature files; the index is the pattern's group in the file's name. Unequal lengths are an error."""
    rx = re.compile(pattern)

    def decode(frames):
        for pdf in frames:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"]):
                z = np.load(io.BytesIO(bytes(data)))
                v = np.asarray(z[z.files[0]] if hasattr(z, "files") else z, dtype=np.float64).ravel()
                m = rx.search(p.rsplit("/", 1)[-1])
                rows.append((int(m[1]) if m else NO_INDEX, v / max(np.linalg.norm(v), 1e-12)))
            yield pd.DataFrame({"frame_idx": [r[0] for r in rows], "vec": [r[1] for r in rows]})

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "frame_idx long, vec array<double>")
    sizes = out.agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"feature files have {sizes['a']} to {sizes['b']} values")
    return out


def densify_index(df: DataFrame, index: str = "frame_idx", keys: tuple[str, ...] = ()) -> DataFrame:
    """All columns with every index from 0 to the greatest, for each of ``keys``, missing ones null; no driver value sizes a list."""
    top = df.groupBy(*keys).agg(F.max(index).alias("top"))
    spine = top.where("top is not null").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias(index))
    return spine.join(df, [*keys, index], "left")
