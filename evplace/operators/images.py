"""Events summed up to sparse per-frame images, and images to vectors. Zero cells are never rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evplace.functions.sizes import small

FRAME = ("seq", "frame_idx")


def polarity_frame(ev: DataFrame) -> DataFrame:
    """Events in each frame, channel (1 for p > 0) and pixel."""
    return ev.groupBy(*FRAME, F.when(F.col("p") > 0, 1).otherwise(0).alias("channel"), "y", "x").agg(F.count("*").cast("double").alias("value"))


def valid_events(ev: DataFrame, frames: DataFrame) -> DataFrame:
    """seq, frame_idx, n_valid: events of ``ev`` (on the sensor) in every frame of ``frames``, 0 where there are none."""
    n = ev.groupBy(*FRAME).agg(F.count("*").alias("n"))
    return frames.select(*FRAME).join(n, list(FRAME), "left").select(*FRAME, F.coalesce("n", F.lit(0)).cast("long").alias("n_valid"))


def event_count_frame(ev: DataFrame) -> DataFrame:
    return ev.groupBy(*FRAME, "y", "x").agg(F.count("*").cast("double").alias("value"))


def signed_frame(ev: DataFrame, clip: int = 5) -> DataFrame:
    """The sum of +1 (p = 1) and -1, clipped, and its grey value; untouched pixels would be 127."""
    v = F.greatest(F.least(F.sum(F.when(F.col("p") == 1, 1).otherwise(-1)), F.lit(clip)), F.lit(-clip))
    return ev.groupBy(*FRAME, "y", "x").agg(v.cast("int").alias("value")).withColumn("gray", ((F.col("value") + clip) / (2.0 * clip) * 255).cast("int"))


def time_surface(ev: DataFrame, frames: DataFrame, windows_s: list[float], scale: float = 1e-9) -> DataFrame:
    """exp(-dt / window) of each pixel's last event, for each polarity and window.

    dt is the time from the last event to the frame's end, at least 0; where it is over the window there is no row. Channels count windows,
    first for positive events, then for the others.
    """
    last = ev.groupBy(*FRAME, F.when(F.col("p") > 0, 0).otherwise(1).alias("group"), "y", "x").agg(F.max("t").alias("t"))
    dt = F.greatest(F.lit(0.0), (F.col("w_end") - F.col("t")) * F.lit(scale))
    rows = last.join(frames.select(*FRAME, "w_end"), list(FRAME)).withColumn("dt", dt).where(F.col("dt") <= max(windows_s))
    rows = rows.select(*FRAME, "group", "y", "x", "dt", F.posexplode(F.array(*[F.lit(float(w)) for w in windows_s])).alias("s", "window")).where("dt <= window")
    return rows.select(*FRAME, (F.col("group") * len(windows_s) + F.col("s")).alias("channel"), "y", "x", F.exp(-F.col("dt") / F.col("window")).alias("value"))


def tencode(ev: DataFrame, top: float = 255.0) -> DataFrame:
    """Red, green, blue of each pixel's last event (ties: the greater index): polarity, age in the frame, the other polarity.

    Values run from 0 to ``top``: 255, or 1 for the normalised form. Pixels without events have no row; dense_image() gives them
    the background.
    """
    last = ev.groupBy(*FRAME, "y", "x").agg(F.max(F.struct("t", "event_idx", "p")).alias("e"))
    span = ev.groupBy(*FRAME).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    age = F.when(F.col("b") > F.col("a"), (F.col("e.t") - F.col("a")) / (F.col("b") - F.col("a"))).otherwise(0.0)
    pol = F.when(F.col("e.p") > 0, 1.0).otherwise(0.0)
    return last.join(span, list(FRAME)).select(*FRAME, "y", "x", (top * pol).alias("r"), (top * (1 - age)).alias("g"), (top * (1 - pol)).alias("b"))


def background(white: bool = False, top: float = 255.0) -> float:
    return float(top) if white else 0.0


def dense_image(cells: DataFrame, frames: DataFrame, h: int, w: int, channels: tuple[str, ...] = ("value",), fill: float = 0.0) -> DataFrame:
    """seq, frame_idx, image: every channel row by row, one channel after another, ``fill`` where there is no cell; empty frames too.

    For models that want arrays: a frame's row has channels * h * w values, which the sensor bounds. Cells off the sensor are left out.
    """
    at = (F.col("y") * w + F.col("x")).cast("int")
    inside = cells.where(f"y >= 0 and y < {h} and x >= 0 and x < {w}")
    packed = inside.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), F.array(*[F.col(c).cast("double") for c in channels]).alias("v")))).alias("m"))
    every = frames.select(*FRAME).join(packed, list(FRAME), "left")
    plane = lambda k: F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i)[k], F.lit(float(fill))))
    return every.select(*FRAME, F.concat(*[plane(k) for k in range(len(channels))]).alias("image"))


def robust_normalize(frame: DataFrame, h: int, w: int, q: float = 0.98) -> DataFrame:
    """min(v, r) / r * 2 - 1 of the non-zero cells (all others are -1); r is the k-th smallest of all h * w cells, k = q of them, at least 1."""
    n = h * w
    k = min(max(int(q * n), 1), n)
    order = Window.partitionBy(*FRAME).orderBy("value", "y", "x")
    ranked = frame.withColumn("rank", F.row_number().over(order))
    size = frame.groupBy(*FRAME).agg(F.count("*").alias("m"))
    r = ranked.join(size, list(FRAME)).where(F.col("rank") == k - (n - F.col("m"))).select(*FRAME, "value")
    r = size.join(r, list(FRAME), "left").select(*FRAME, F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(1.0)).alias("r"))
    return frame.join(r, list(FRAME)).select(*FRAME, "y", "x", (F.least("value", "r") / F.col("r") * 2 - 1).alias("value"))


def axis_weights(size: int, out: int, mode: str = "bilinear") -> list[tuple[int, int, float]]:
    """(output cell, input cell, weight) along one axis, with half-pixel centres."""
    rows: dict[tuple[int, int], float] = {}
    for i in range(out):
        src = (i + 0.5) * size / out
        if mode == "nearest":
            rows[i, min(int(src), size - 1)] = 1.0
            continue
        src = min(max(src - 0.5, 0.0), size - 1.0)
        a = int(math.floor(src))
        for cell, weight in ((a, 1 - (src - a)), (min(a + 1, size - 1), src - a)):
            if weight > 0:
                rows[i, cell] = rows.get((i, cell), 0.0) + weight
    return [(i, j, x) for (i, j), x in sorted(rows.items())]


def resize_frame(frame: DataFrame, size: tuple[int, int], out: tuple[int, int], mode: str = "bilinear") -> DataFrame:
    """Rows of the resized image; weights of an axis are a table as long as the axis, so they are broadcast."""
    spark = frame.sparkSession
    wy = spark.createDataFrame(axis_weights(size[0], out[0], mode), "oy int, y int, wy double")
    wx = spark.createDataFrame(axis_weights(size[1], out[1], mode), "ox int, x int, wx double")
    parts = frame.withColumn("y", F.col("y").cast("int")).withColumn("x", F.col("x").cast("int")).join(F.broadcast(wy), "y").join(F.broadcast(wx), "x")
    return parts.groupBy(*FRAME, "oy", "ox").agg(F.sum(F.col("value") * F.col("wy") * F.col("wx")).alias("value")).select(*FRAME, F.col("oy").alias("y"), F.col("ox").alias("x"), "value")


def pixel_mean(frames: DataFrame, n_frames: DataFrame) -> DataFrame:
    """seq, y, x, mean over all frames of a sequence (seq, n), zeros counted."""
    return frames.groupBy("seq", "y", "x").agg(F.sum("value").alias("s")).join(n_frames, "seq").select("seq", "y", "x", (F.col("s") / F.col("n")).alias("mean"))


def sampling_probabilities(means: DataFrame, h: int, w: int) -> DataFrame:
    """seq, y, x, prob: means over mean + 2 standard deviations (of all cells) count as 0.01, then all are divided by their sum."""
    n = float(h * w)
    stats = means.groupBy("seq").agg((F.sum("mean") / n).alias("m"), (F.sum(F.col("mean") * F.col("mean")) / n).alias("m2"))
    limit = F.col("m") + 2 * F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0)))
    cut = means.join(stats, "seq").withColumn("v", F.when(F.col("mean") > limit, 0.01).otherwise(F.col("mean")))
    total = cut.groupBy("seq").agg(F.sum("v").alias("total"))
    return cut.join(total, "seq").select("seq", "y", "x", (F.col("v") / F.col("total")).alias("prob"))


def spread_out(cells: pd.DataFrame, n: int, radius: float) -> pd.DataFrame:
    """The first n cells, in order, that are over ``radius`` from all cells taken before."""
    taken: list[tuple[int, int]] = []
    for y, x in zip(cells["y"], cells["x"]):
        if all((y - a) ** 2 + (x - b) ** 2 > radius * radius for a, b in taken):
            taken.append((y, x))
            if len(taken) == n:
                break
    return pd.DataFrame({"pixel": range(len(taken)), "y": [t[0] for t in taken], "x": [t[1] for t in taken]})


def sample_pixels(prob: DataFrame, n: int = 100, radius: float = 7, seed: int = 0) -> DataFrame:
    """seq, pixel, y, x: weighted random pixels, each over ``radius`` from the others; an error if the cells run out.

    Cells sorted by -log(u) / weight come in the order of weighted draws without replacement, u being a hash (md5) of
    the cell and the seed; the greedy check then runs over one sequence's cells, which the sensor bounds.
    """
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "y", "x")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    keyed = prob.where("prob > 0").select("seq", "y", "x", (-F.log(u) / F.col("prob")).alias("key"))

    def pick(key, cells):
        out = spread_out(cells.sort_values(["key", "y", "x"]), n, radius)
        if len(out) < n:
            raise ValueError(f"only {len(out)} of {n} pixels are {radius} apart")
        out.insert(0, "seq", key[0])
        return out

    return keyed.groupBy("seq").applyInPandas(pick, "seq string, pixel int, y int, x int")


#: Pixels of a descriptor, at most.
MOST_PIXELS = 5000


def gather_pixels(frames: DataFrame, spine: DataFrame, pixels: DataFrame, clamp: float | None = None) -> DataFrame:
    """seq, frame_idx, vec: counts at the chosen pixels (pixel, y, x; at most some hundreds), in their order, absent ones 0."""
    v = F.col("value") if clamp is None else F.least(F.col("value"), F.lit(float(clamp)))
    order = [r["pixel"] for r in pixels.select("pixel").orderBy("pixel").limit(MOST_PIXELS + 1).collect()]
    if len(order) > MOST_PIXELS:
        raise ValueError(f"over {MOST_PIXELS} pixels")
    found = frames.join(small(pixels.select("pixel", "y", "x"), MOST_PIXELS), ["y", "x"]).select(*FRAME, "pixel", v.alias("value"))
    packed = found.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct("pixel", "value"))).alias("m"))
    values = F.array(*[F.coalesce(F.try_element_at("m", F.lit(p)), F.lit(0.0)) for p in order])
    return spine.select(*FRAME).join(packed, list(FRAME), "left").select(*FRAME, values.alias("vec"))
