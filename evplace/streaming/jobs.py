"""Frames, time surfaces, triplets and re-ranking on streams of events and frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evplace.operators import rerank, similarity
from evplace.sources.shared import new_path
from evplace.streaming.windows import stream_ordered_triplets, stream_windows


def frame_cells(cells: DataFrame) -> DataFrame:
    """w_start, w_end, seq, channel, y, x, value (events) of what stream_windows() gives."""
    return cells.where("late is null").select("w_start", "w_end", "seq", F.col("positive").alias("channel"), "y", "x", F.col("n").cast("double").alias("value"))


def surface_cells(cells: DataFrame, windows_s: list[float]) -> DataFrame:
    """w_end, seq, channel, y, x, value: the decayed time surface of what stream_windows() gives; channels of positive events come first."""
    age = (F.unix_micros("w_end") - F.unix_micros("last")) / 1e6
    rows = cells.where("late is null").select("w_end", "seq", (1 - F.col("positive")).alias("group"), "y", "x", age.alias("dt"), F.posexplode(F.array(*[F.lit(float(w)) for w in windows_s])).alias("s", "window")).where("dt <= window")
    return rows.select("w_end", "seq", (F.col("group") * len(windows_s) + F.col("s")).alias("channel"), "y", "x", F.exp(-F.col("dt") / F.col("window")).alias("value"))


def stream_frames(ev: DataFrame, dt: str, delay: str = "0 seconds", start: str | None = "0 seconds", idle: str | None = None) -> DataFrame:
    """w_start, w_end, seq, channel, y, x, value of a stream (ts timestamp, seq, x, y, p): tumbling windows, each given out when its own sequence's clock has passed
    it. Options and late events are those of stream_windows()."""
    return frame_cells(stream_windows(ev, dt, delay, start, idle))


def stream_time_surface(ev: DataFrame, dt: str, windows_s: list[float], delay: str = "0 seconds", start: str | None = "0 seconds", idle: str | None = None) -> DataFrame:
    """The decayed time surface of each closed window: the state is one last time for each polarity and pixel."""
    return surface_cells(stream_windows(ev, dt, delay, start, idle), windows_s)


def write_with_late(out: DataFrame, path: str, late_path: str, checkpoint: str):
    """What stream_windows() or stream_ordered_triplets() gives, batch by batch, in two folders: rows, and counts of late ones (seq, late); returns the running query.

    A batch is written once to a folder of its own and read from there for both, so the state is passed once, and a batch that is run again leaves one answer.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_all/batch={batch_id}")
        rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/_all/batch={batch_id}")
        rows.where("late is null").drop("late").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        rows.where("late is not null").select("seq", "late").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")

    return out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_triplets(frames: DataFrame, delay: int = 0, idle: str | None = None) -> DataFrame:
    """seq, frame_idx, f0, f1, f2 of a stream of frames (seq, frame_idx), in the order of their indexes; options are those of stream_ordered_triplets()."""
    return stream_ordered_triplets(frames, delay, idle).where("late is null").drop("late")


def rerank_batch(frames: DataFrame, packs: DataFrame, ref: DataFrame, ref_packs: DataFrame, k: int = 10, weight: float = 0.05, ratio: float = 0.8, ref_rows: int | None = None, folder: str | None = None) -> DataFrame:
    """query_idx, ref_idx, new_dist, inliers: retrieval, matching, geometric check and fusion for one batch of query frames.

    The references are searched once: the shortlist is written to ``folder`` (a new one, if not given), from where matching and fusion read it.
    """
    folder = folder or new_path(frames.sparkSession, "shortlist")
    similarity.topk_of_batch(ref, frames, k, ref_rows).write.mode("overwrite").parquet(folder)
    shortlist = frames.sparkSession.read.parquet(folder)
    matches = rerank.match_shortlist(shortlist, ref_packs, packs, "ratio", ratio)
    return rerank.best_match(rerank.fuse_inliers(shortlist, rerank.translation_inliers(matches), weight))


def stream_rerank(frames: DataFrame, ref: DataFrame, ref_packs: DataFrame, path: str, checkpoint: str, on_window: Callable[[DataFrame, int], None] | None = None, **options):
    """Answer a stream of query frames (frame_idx, vec, n, kps) against a fixed map; returns the running query.

    Every micro-batch goes through the batch functions and replaces its own folders, so a batch that is run again leaves one answer. Its shortlist lies
    beside the answers under its number. References stay where they are; their keypoints are packed for matching once, beside the
    answers, when the stream starts.
    """
    n = ref.count()
    (ref_packs if dict(ref_packs.dtypes)["kps"] == "binary" else rerank.dense_packs(ref_packs)).write.mode("overwrite").parquet(f"{path}/_map")
    dense = ref.sparkSession.read.parquet(f"{path}/_map")

    def answer(batch: DataFrame, batch_id: int) -> None:
        out = rerank_batch(batch.select("frame_idx", "vec"), batch.select("frame_idx", "n", "kps"), ref, dense, ref_rows=n, folder=f"{path}/_shortlist/batch={batch_id}", **options)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if on_window:
            on_window(batch.sparkSession.read.parquet(f"{path}/batch={batch_id}"), batch_id)

    return frames.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_static_topk(frames: DataFrame, ref: DataFrame, path: str, checkpoint: str, k: int = 50):
    """The k nearest references of every frame that arrives, written batch by batch; returns the running query."""
    n = ref.count()

    def answer(batch: DataFrame, batch_id: int) -> None:
        similarity.topk_of_batch(ref, batch, k, n).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return frames.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
