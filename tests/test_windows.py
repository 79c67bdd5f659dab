"""Per-sequence clocks: late rows, origins, ends, idle sequences, order of arrival, restarts."""

import time

import pytest
from pyspark.sql import functions as F

from evplace.operators import frames, images
from evplace.sources.shared import new_path
from evplace.streaming import jobs, windows

EVENT = "seq string, t long, x int, y int, p int"


def as_events(df):
    return df.select("seq", F.timestamp_micros("t").alias("ts"), "x", "y", "p")


class Stream:
    """Micro-batches of rows, one file each, through a stream with its state."""

    def __init__(self, spark, schema, through):
        self.spark, self.schema, self.through = spark, schema, through
        self.source, self.sink, self.progress = (new_path(spark, n) for n in ("source", "sink", "progress"))

    def send(self, *batches):
        for rows in batches:
            df = self.spark.createDataFrame(rows, self.schema)
            (as_events(df) if self.schema == EVENT else df).coalesce(1).write.mode("append").parquet(self.source)
            time.sleep(0.05)
        return self

    def run(self, until=None):
        """What the stream gives until its input is used up; with ``until``, until a condition on the sink's rows holds (a minute at most), as timers keep a query alive."""
        schema = self.spark.read.parquet(self.source).schema
        out = self.through(self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.source))
        writer = out.writeStream.format("parquet").option("path", self.sink).option("checkpointLocation", self.progress)
        if until is None:
            assert writer.trigger(availableNow=True).start().awaitTermination(120)
        else:
            query, began = writer.trigger(processingTime="0 seconds").start(), time.time()
            try:
                while time.time() - began < 60 and not (query.recentProgress and until(self.spark.read.schema(out.schema).parquet(self.sink))):
                    time.sleep(0.5)
            finally:
                query.stop()
        return self.spark.read.schema(out.schema).parquet(self.sink)


def test_a_sequence_is_late_by_its_own_clock_only(spark):
    month = 30 * 86_400_000_000
    a = [("a", month + 10 * i, i % 3, 1, i % 2) for i in range(10)]
    b = [("b", 10 * i, 1, 1, 1) for i in range(10)]
    through = lambda s: windows.stream_windows(s, "30 microseconds")
    out = Stream(spark, EVENT, through).send(a + b[:5], [*b[5:], ("b", 5, 1, 1, 1), ("b", 6, 1, 1, 1), ("a", month + 3, 1, 1, 1), ("a", month + 100, 1, 1, 1)]).run()
    late = {r.seq: r.late for r in windows.late_rows(out).collect()}
    assert late == {"a": 1, "b": 2}
    kept = {r.seq: r.n for r in out.where("late is null").groupBy("seq").agg(F.sum("n").alias("n")).collect()}
    assert kept == {"a": 9, "b": 9}  # closed windows: up to 90 on either clock; b's own rows were not late behind a's month


def test_windows_and_surfaces_from_own_origins_equal_the_batch(spark):
    base = {"a": 40 * 86_400_000_000 + 17, "b": 1_000_003}
    rows = [(s, t0 + 7 * i * i % 4001, (i * 5) % 6, (i * 3) % 4, i % 2) for s, t0 in base.items() for i in range(400)]
    rows.sort(key=lambda r: r[1] - base[r[0]])
    rows = [(s, t, x, y, p) for s, t, x, y, p in rows]
    ends = [(s, None, None, None, None) for s in base]
    first = [r for r in rows if r[1] - base[r[0]] < 2000]
    second = [r for r in rows if r[1] - base[r[0]] >= 2000]
    ev = spark.createDataFrame([(s, i, t, x, y, p) for i, (s, t, x, y, p) in enumerate(rows)], "seq string, event_idx long, t long, x int, y int, p int")
    framed, spine = frames.assign_frames(ev, 0.25, 1e-6), frames.frame_spine(ev, 0.25, 1e-6)
    want = sorted(tuple(r) for r in images.polarity_frame(framed).join(spine, ["seq", "frame_idx"]).select("seq", "w_end", "channel", "y", "x", "value").collect())
    got = Stream(spark, EVENT, lambda s: jobs.stream_frames(s, "250 microseconds", start=None)).send(first, second + ends).run()
    assert sorted(tuple(r) for r in got.select("seq", F.unix_micros("w_end"), "channel", "y", "x", "value").collect()) == want
    surface = images.time_surface(framed, spine, [1e-4, 2e-4], 1e-6).join(spine, ["seq", "frame_idx"]).select("seq", "w_end", "channel", "y", "x", F.round("value", 9))
    got = Stream(spark, EVENT, lambda s: jobs.stream_time_surface(s, "250 microseconds", [1e-4, 2e-4], start=None)).send(first, second + ends).run()
    assert sorted(tuple(r) for r in got.select("seq", F.unix_micros("w_end"), "channel", "y", "x", F.round("value", 9)).collect()) == sorted(tuple(r) for r in surface.collect())


def test_delay_clock_rows_and_nulls(spark):
    through = lambda s: windows.stream_windows(s, "10 microseconds", delay="10 microseconds")
    rows = [("a", 5, 1, 1, 1), ("a", 25, 1, 1, 0), (None, 3, 1, 1, 1), ("a", None, 1, 1, 1)]
    out = Stream(spark, EVENT, through).send(rows, [("a", 12, -2, -1, 1), ("a", 4, 1, 1, 1)], [("a", 45, None, None, None), (None, 99, None, None, None)]).run()
    rows = sorted(((r.seq, r.w_start.microsecond, r.positive, r.y, r.x, r.n) for r in out.where("late is null").collect()), key=str)
    # 0-10 closed with the first batch (25 - 10 >= 10), 12 was in time, 4 late; the clock alone closed the rest; a null sequence is one of its own
    assert rows == sorted([("a", 0, 1, 1, 1, 1), ("a", 10, 1, -1, -2, 1), ("a", 20, 0, 1, 1, 1), (None, 0, 1, 1, 1, 1)], key=str)
    assert [(r.seq, r.late) for r in windows.late_rows(out).collect()] == [("a", 1)]


def test_many_rows_of_one_sequence_are_one_batch(spark):
    """More rows than Arrow puts in one piece: the clock moves once in a micro-batch."""
    rows = [("a", (i * 7919) % 50_000, i % 5, 0, 1) for i in range(30_000)]
    out = Stream(spark, EVENT, lambda s: windows.stream_windows(s, "1 milliseconds")).send(rows).run()
    assert out.where("late is not null").count() == 0 and out.agg(F.sum("n")).first()[0] == sum(t < 49_000 for _, t, *_ in rows)


@pytest.mark.parametrize("kind", ["events", "frames"])
def test_silent_sequences_are_given_out_and_forgotten(spark, kind):
    if kind == "events":
        s = Stream(spark, EVENT, lambda x: windows.stream_windows(x, "10 microseconds", idle="1 milliseconds"))
        s.send([("a", 1, 1, 1, 1), ("a", 12, 1, 1, 1)], [("b", 1, 1, 1, 1)], [("b", 2, 1, 1, 1)])
        out = s.run(lambda df: df.where("seq = 'a'").count() == 2).where("late is null and seq = 'a'")
        assert sorted(r.w_start.microsecond for r in out.collect()) == [0, 10]  # closed by the clock, and by the silence
    else:
        s = Stream(spark, "seq string, frame_idx long", lambda x: windows.stream_ordered_triplets(x, delay=5, idle="1 milliseconds"))
        s.send([("a", i) for i in (0, 3, 1, 2, 4)], [("b", 0)], [("b", 1)])
        out = s.run(lambda df: df.where("seq = 'a'").count() == 2)
        assert sorted((r.frame_idx, r.f0, r.f1, r.f2) for r in out.where("seq = 'a'").collect()) == [(3, 0, 1, 2), (4, 1, 2, 3)]


def test_triplets_in_any_order_within_the_delay(spark):
    through = lambda s: windows.stream_ordered_triplets(s, delay=2)
    frame = "seq string, frame_idx long"
    s = Stream(spark, frame, through).send([("a", i) for i in (0, 1, 3)], [("a", i) for i in (2, 4, 5)])
    rows = lambda out: sorted((r.frame_idx, r.f0, r.f1, r.f2) for r in out.where("late is null").collect())
    assert rows(s.run()) == [(3, 0, 1, 2)]
    # the query stops and starts again: what waits is still there; 1 comes again, behind what was given out
    out = s.send([("a", 1), ("a", 8), ("a", None)]).run()
    assert rows(out) == [(3, 0, 1, 2), (4, 1, 2, 3), (5, 2, 3, 4), (8, 3, 4, 5)]
    assert [(r.seq, r.late) for r in windows.late_rows(out).collect()] == [("a", 1)]
