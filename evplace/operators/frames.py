"""Filters and projections on events, and time windows (frames)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evplace.functions.sizes import small


def clip_to_sensor(ev: DataFrame, h: int, w: int) -> DataFrame:
    return ev.where(f"x >= 0 and x < {w} and y >= 0 and y < {h}")


def with_pixel_index(ev: DataFrame, h: int, w: int, positive_first: bool = False) -> DataFrame:
    """lin, channel (1 for p > 0; with positive_first 0) and idx over the channels."""
    channel = F.when(F.col("p") > 0, 0 if positive_first else 1).otherwise(1 if positive_first else 0)
    return ev.withColumn("lin", F.col("y") * w + F.col("x")).withColumn("channel", channel).withColumn("idx", F.col("lin") + F.col("channel") * (h * w))


def crop_offsets(h: int, w: int, factor: int) -> dict[str, int]:
    """Offsets, size and keypoint limit of the centred crop to multiples of ``factor``; the odd row or column goes from the top or left."""
    top, left = -(-(h % factor) // 2), -(-(w % factor) // 2)
    hc, wc = h - h % factor, w - w % factor
    return {"top": top, "left": left, "h": hc, "w": wc, "k_max": max(hc, wc) // 2}


def center_crop(ev: DataFrame, h: int, w: int, factor: int) -> DataFrame:
    o = crop_offsets(h, w, factor)
    inside = ev.where(f"x >= {o['left']} and x < {o['left'] + o['w']} and y >= {o['top']} and y < {o['top'] + o['h']}")
    return inside.withColumn("x", F.col("x") - o["left"]).withColumn("y", F.col("y") - o["top"])


def undo_crop(kps: DataFrame, top: int, left: int) -> DataFrame:
    return kps.withColumn("x", F.col("x") + left).withColumn("y", F.col("y") + top)


def skip_frames(frames: DataFrame, skip: int) -> DataFrame:
    """Every skip-th frame, all for skip up to 1."""
    return frames.where(F.col("frame_idx") % skip == 0) if skip > 1 else frames


def drop_warmup(frames: DataFrame, n: int = 10) -> DataFrame:
    return frames.where(F.col("frame_idx") >= n)


def hot_pixel_filter(ev: DataFrame, k: float = 2.0) -> DataFrame:
    """Drop a sequence's pixels with more events than mean + k standard deviations over its active pixels.

    Counts are summed before the shuffle; the hot pixels come back as an anti-join that broadcasts them, if they are few,
    so that events are not shuffled by pixel.
    """
    counts = ev.groupBy("seq", "x", "y").agg(F.count("*").alias("n"))
    limit = counts.groupBy("seq").agg((F.avg("n") + k * F.stddev_pop("n")).alias("limit"))
    hot = counts.join(limit, "seq").where("n > limit").select("seq", "x", "y")
    return ev.join(small(hot), ["seq", "x", "y"], "left_anti")


def clamp_counts(frame: DataFrame, threshold: float = 10, value: str = "value") -> DataFrame:
    return frame.withColumn(value, F.least(F.col(value), F.lit(threshold)))


def usable_frames(packs: DataFrame, min_kp: int = 4) -> DataFrame:
    return packs.where(F.col("n") >= min_kp)


def tick_length(dt_ms: float, scale: float) -> int:
    dt = round(dt_ms / 1000 / scale)
    if dt <= 0:
        raise ValueError("a frame must be at least one tick long")
    return dt


def sequence_bounds(ev: DataFrame, scale: float, starts: DataFrame | None = None) -> DataFrame:
    """seq, s0, t_max: where frames start (the first event, or a later start time in seconds) and end."""
    b = ev.groupBy("seq").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    if starts is None:
        return b.select("seq", F.col("t_min").alias("s0"), "t_max")
    start = F.bround(F.col("start_time") / scale, 0).cast("long")
    return b.join(starts, "seq", "left").select("seq", F.greatest(F.coalesce(start, F.col("t_min")), F.col("t_min")).alias("s0"), "t_max")


def assign_frames(ev: DataFrame, dt_ms: float, scale: float = 1e-9, starts: DataFrame | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Events with frame_idx: half-open windows [s0 + i dt, s0 + (i+1) dt) that begin before the last event.

    So an event at the very end of the last window is in none, and events before s0 are dropped. The bounds are one row
    for each sequence; they are computed here, or given, and broadcast if they are few, so that events stay where they are.
    """
    dt = tick_length(dt_ms, scale)
    b = small(sequence_bounds(ev, scale, starts)) if bounds is None else bounds
    framed = ev.join(b, "seq").where("t >= s0 and s0 < t_max")
    return framed.withColumn("frame_idx", F.expr(f"(t - s0) div {dt}")).where(F.col("s0") + F.col("frame_idx") * dt < F.col("t_max")).drop("s0", "t_max")


def frame_spine(ev: DataFrame, dt_ms: float, scale: float = 1e-9, starts: DataFrame | None = None) -> DataFrame:
    """Every frame of each sequence, empty ones included: seq, frame_idx, w_start, w_end (ticks), start_s, end_s, n_events."""
    dt = tick_length(dt_ms, scale)
    bounds = small(sequence_bounds(ev, scale, starts))
    b = bounds.where("s0 < t_max")
    last = F.expr(f"(t_max - s0 + {dt} - 1) div {dt} - 1")
    spine = b.select("seq", "s0", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("frame_idx"))
    counts = assign_frames(ev, dt_ms, scale, bounds=bounds).groupBy("seq", "frame_idx").agg(F.count("*").alias("n"))
    start = F.col("s0") + F.col("frame_idx") * dt
    return spine.join(counts, ["seq", "frame_idx"], "left").select(
        "seq", "frame_idx", start.alias("w_start"), (start + dt).alias("w_end"), (start * F.lit(scale)).alias("start_s"), ((start + dt) * F.lit(scale)).alias("end_s"), F.coalesce("n", F.lit(0)).cast("long").alias("n_events"))


#: Rows of one bucket of a long sequence, about.
BUCKET = 1 << 20


def bucketed(df: DataFrame, order: str, key: str = "seq", rows: int = BUCKET) -> DataFrame:
    """df with _b: buckets of a sequence in the order of a number, each of about ``rows`` rows, so that all cores can scan one sequence.

    Bounds are approximate quantiles of each sequence, one small row for it; rows of equal order lie in one bucket, nulls in the first. A table
    of at most ``rows`` rows is one bucket for each sequence.
    """
    n = df.count()
    if n <= rows:
        return df.withColumn("_b", F.lit(0))
    parts = min(1000, -(-n // rows))
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = small(df.groupBy(F.col(key).alias("_key")).agg(F.percentile_approx(F.col(order).cast("double"), at, 10 * parts).alias("_bounds")))
    held = df.join(bounds, F.col(key).eqNullSafe(F.col("_key")), "left")
    return held.withColumn("_b", F.coalesce(F.size(F.filter("_bounds", lambda x: x < F.col(order).cast("double"))), F.lit(0))).drop("_key", "_bounds")


def frame_triplets(frames: DataFrame, rows: int = BUCKET) -> DataFrame:
    """seq, frame_idx, f0, f1, f2: the three frames before each one; the first three frames give nothing.

    A scan in two levels: buckets of a sequence are ordered apart from each other, and the first three frames of each take what they lack from
    the last three of the buckets before it, a small table.
    """
    cut = bucketed(frames.select("seq", "frame_idx"), "frame_idx", rows=rows)
    own = Window.partitionBy("seq", "_b").orderBy("frame_idx")
    every = Window.partitionBy("seq", "_b")
    lag = lambda k: F.lag("frame_idx", k).over(own)
    local = cut.select("seq", "_b", "frame_idx", lag(3).alias("l3"), lag(2).alias("l2"), lag(1).alias("l1"), F.row_number().over(own).alias("k"), F.count("*").over(every).alias("n"))
    tails = local.where("k > n - 3").groupBy("seq", "_b").agg(F.array_sort(F.collect_list("frame_idx")).alias("tail"))
    before = Window.partitionBy("seq").orderBy("_b").rowsBetween(-3, -1)
    carried = tails.select(F.col("seq").alias("_seq"), F.col("_b").alias("_at"), F.flatten(F.collect_list("tail").over(before)).alias("before"))
    rest = local.where("k <= 3").join(small(carried), F.col("seq").eqNullSafe(F.col("_seq")) & (F.col("_b") == F.col("_at")))
    back = lambda d: F.coalesce(F.col(f"l{d}"), F.try_element_at("before", (F.col("k") - F.lit(d) - 1).cast("int")))
    filled = rest.select("seq", "frame_idx", *[back(d).alias(c) for d, c in ((3, "f0"), (2, "f1"), (1, "f2"))]).where("f0 is not null")
    return local.where("k > 3").select("seq", "frame_idx", F.col("l3").alias("f0"), F.col("l2").alias("f1"), F.col("l1").alias("f2")).unionByName(filled)


def ema(df: DataFrame, value: str, order: str, alpha: float = 0.1, key: str = "seq", rows: int = BUCKET) -> DataFrame:
    """df with ema: e0 = v0, then e = (1 - alpha) e + alpha v, in order.

    Written out, e is a sum of values with weights that decay, so running sums give it, in a scan of two levels. A sequence is cut into buckets, and
    those into segments short enough that weights keep their precision, each summed on its own; a segment starts from the ends of the three
    before it in its bucket, as what is older weighs under 1e-24, and a bucket from the end of the one before, by a small table of the ends of buckets.
    """
    decay = 1 - alpha
    length = max(1, min(1_000_000, int(27 / -math.log(decay)))) if 0 < decay < 1 else 1
    cut = bucketed(df, order, key, rows)
    first = cut.groupBy(F.col(key).alias("_key")).agg(F.min("_b").alias("_first"))
    cut = cut.join(small(first), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    w = Window.partitionBy(key, "_b").orderBy(order)
    every = cut.withColumn("_n", F.row_number().over(w) - 1).withColumn("_seg", F.expr(f"_n div {length}")).withColumn("_k", F.expr(f"_n % {length} + 1").cast("double"))
    gain = F.when((F.col("_n") == 0) & (F.col("_b") == F.col("_first")), F.lit(1.0)).otherwise(F.lit(alpha))
    running = F.sum(gain * F.col(value).cast("double") * F.pow(F.lit(decay), -F.col("_k"))).over(Window.partitionBy(key, "_b", "_seg").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    every = every.withColumn("_own", running * F.pow(F.lit(decay), F.col("_k")))
    ends = every.groupBy(key, "_b", "_seg").agg(F.max(F.struct("_k", "_own")).alias("e")).select(key, "_b", "_seg", F.col("e._own").alias("o"), F.col("e._k").alias("k"))
    by = Window.partitionBy(key, "_b").orderBy("_seg")
    before = sum((F.coalesce(F.lag("o", i + 1).over(by), F.lit(0.0)) * decay ** (length * i) for i in range(3)), F.lit(0.0))
    ends = ends.withColumn("_before", before)
    # ends of buckets from their own rows, and then from all before: b's end weighs decay^(rows of the buckets behind it)
    tops = ends.groupBy(key, "_b").agg(F.max(F.struct("_seg", "k", (F.col("o") + F.pow(F.lit(decay), "k") * F.col("_before")).alias("o"))).alias("t"))
    tops = tops.select(key, "_b", F.col("t.o").alias("o"), (F.col("t._seg") * length + F.col("t.k")).alias("m"))
    earlier = F.collect_list(F.struct("o", "m")).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    entry = F.aggregate(earlier, F.lit(0.0), lambda e, t: t["o"] + F.pow(F.lit(decay), t["m"]) * e)
    starts = tops.select(F.col(key).alias("_key"), F.col("_b").alias("_at"), entry.alias("_entry"))
    states = ends.select(F.col(key).alias("_key2"), F.col("_b").alias("_at2"), F.col("_seg").alias("_seg2"), "_before")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    out = every.join(states, same(key, "_key2") & (F.col("_b") == F.col("_at2")) & (F.col("_seg") == F.col("_seg2"))).join(small(starts), same(key, "_key") & (F.col("_b") == F.col("_at")))
    value_of = F.col("_own") + F.pow(F.lit(decay), F.col("_k")) * F.col("_before") + F.pow(F.lit(decay), F.col("_n") + 1) * F.col("_entry")
    return out.withColumn("ema", value_of).select(*[F.col(f"`{c}`") for c in df.columns], "ema")
