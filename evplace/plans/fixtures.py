"""The inputs of the place-recognition queries, derived from the given tables: in Spark, and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evplace.functions.vectors import l2_normalize
from evplace.operators import evaluate, frames

H, W = 18, 22
SCALE = 1e-6
DT_MS = 86_400_000
DT = 86_400_000_000
#: Time-surface windows, in seconds.
WINDOWS = [21_600.0, 43_200.0, 64_800.0, 86_400.0]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sensor_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.when(F.col("event_id") % 2 == 0, "ref").otherwise("query").alias("seq"), F.col("event_id").alias("event_idx"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("t"), (F.col("user_id") % 24).cast("int").alias("x"),
        (F.floor("value") % 18).cast("int").alias("y"), F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0).alias("p"))


def framed(spark: SparkSession, sf: str) -> DataFrame:
    """Events on the sensor, with their frames."""
    return frames.clip_to_sensor(frames.assign_frames(sensor_events(spark, sf), DT_MS, SCALE), H, W)


def spine(spark: SparkSession, sf: str) -> DataFrame:
    return frames.frame_spine(sensor_events(spark, sf), DT_MS, SCALE)


def descriptors(spark: SparkSession, sf: str, seq: str | None = None) -> DataFrame:
    e = table(spark, sf, "embeddings")
    d = e.select(F.when(F.col("vec_id") % 2 == 0, "ref").otherwise("query").alias("seq"), F.floor(F.col("vec_id") / 2).cast("long").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return d if seq is None else d.where(F.col("seq") == seq)


#: Tasks between which the pairs of a label are dealt.
SHARES = 64


def classes(spark: SparkSession, sf: str) -> evaluate.ClassTruth:
    side = lambda seq, c: descriptors(spark, sf, seq).select(F.col("frame_idx").alias(c), "label")
    return evaluate.ClassTruth(side("ref", "ref_idx"), side("query", "query_idx"))


def gt(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of classes(): a label's queries are dealt, each share with all references of the label."""
    refs, queries = classes(spark, sf)
    r = refs.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return r.join(queries.withColumn("share", F.pmod(F.xxhash64("query_idx"), F.lit(SHARES)).cast("int")), ["label", "share"]).select("ref_idx", "query_idx")


def keypoints(spark: SparkSession, sf: str, seq: str | None = None) -> DataFrame:
    d = descriptors(spark, sf, seq).withColumn("kp_idx", F.explode(F.sequence(F.lit(0), (F.col("frame_idx") % 6 + 2).cast("int"))))
    j, f = F.col("kp_idx"), F.col("frame_idx")
    part = F.slice("vec", j * 8 + 1, 8)
    return d.select("seq", "frame_idx", "kp_idx", (20 * j + f % 7).cast("double").alias("x"), (13 * ((3 * j) % 8) + f % 5).cast("double").alias("y"), F.abs(F.element_at(part, 1)).alias("score"), l2_normalize(part).alias("desc"))


def depth(spark: SparkSession, sf: str) -> DataFrame:
    """seq, frame_idx, h, w, px: 0 where (x + y) % 7 = 0, else 1 + events."""
    from evplace.operators import images

    counts = images.event_count_frame(framed(spark, sf)).groupBy("seq", "frame_idx").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * W + F.col("x")).cast("int"), "value"))).alias("m"))
    cell = lambda i: F.when((i % W + F.floor(i / W)) % 7 == 0, 0.0).otherwise(1.0 + F.coalesce(F.col("m")[i], F.lit(0.0)))
    return spine(spark, sf).select("seq", "frame_idx").join(counts, ["seq", "frame_idx"], "left").select("seq", "frame_idx", F.lit(H).alias("h"), F.lit(W).alias("w"), F.transform(F.sequence(F.lit(0), F.lit(H * W - 1)), cell).alias("px"))


def timings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("frame_idx"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))


def gate_logits(spark: SparkSession, sf: str) -> DataFrame:
    d = descriptors(spark, sf, "query")
    return d.select(F.col("frame_idx").alias("query_idx"), F.posexplode(F.slice("vec", 1, 5)).alias("member", "v")).select("query_idx", "member", (10 * F.col("v")).alias("logit"))


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    k = keypoints(spark, sf, "ref")
    return k.where("(frame_idx = 0 and kp_idx <= 2) or (frame_idx = 1 and kp_idx = 0)").select((F.col("frame_idx") * 3 + F.col("kp_idx")).cast("int").alias("cluster"), F.col("desc").alias("vec"))


def _inliers(matches: str, name: str) -> str:
    """Inliers of the lower median displacement over a table of matches."""
    return f"""mid_{name} AS (SELECT query_idx, ref_idx, count(*) AS n, quantile_disc(dst_x - src_x, 0.5) AS mx, quantile_disc(dst_y - src_y, 0.5) AS my FROM {matches} GROUP BY ALL),
{name} AS (SELECT m.query_idx, m.ref_idx, CAST(sum(CASE WHEN n >= 4 AND sqrt(pow(dst_x - src_x - mx, 2) + pow(dst_y - src_y - my, 2)) < 5 THEN 1 ELSE 0 END) AS BIGINT) AS inliers FROM {matches} m JOIN mid_{name} USING (query_idx, ref_idx) GROUP BY ALL)"""


def _fused(inliers: str, name: str) -> str:
    return f"{name} AS (SELECT query_idx, ref_idx, rank, dist, coalesce(inliers, 0) AS inliers, CASE WHEN coalesce(inliers, 0) > 0 THEN dist - 0.05 * inliers ELSE dist END AS new_dist FROM cand LEFT JOIN {inliers} USING (query_idx, ref_idx))"


def ssim_sql(maps: str, h: int, w: int) -> str:
    """Tables that end in ssim (query_idx, ref_idx, err) over a table ``maps`` of query_idx, ref_idx, y, x, a, b."""
    mirrored = lambda i, n: f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN {2 * n - 1} - ({i}) ELSE {i} END"
    return f""", st AS (SELECT query_idx, ref_idx, count(*) AS n, quantile_cont(a, 0.01) AS a1, quantile_cont(a, 0.99) AS a9, quantile_cont(b, 0.01) AS b1, quantile_cont(b, 0.99) AS b9 FROM {maps} WHERE a > 0 AND b > 0 GROUP BY ALL),
sc AS (SELECT m.query_idx, m.ref_idx, y, x, a > 0 AND b > 0 AS inside, least(greatest((a - a1) / greatest(a9 - a1, 1e-12), 0), 1) AS u, least(greatest((b - b1) / greatest(b9 - b1, 1e-12), 0), 1) AS v FROM {maps} m JOIN st ON st.query_idx = m.query_idx AND st.ref_idx = m.ref_idx WHERE n >= 100),
win AS (SELECT query_idx, ref_idx, y, x, {mirrored("y + dy", h)} AS ny, {mirrored("x + dx", w)} AS nx FROM sc, (SELECT unnest(generate_series(-3, 3)) AS dy), (SELECT unnest(generate_series(-3, 3)) AS dx) WHERE inside),
bx AS (SELECT win.query_idx, win.ref_idx, win.y, win.x, avg(u) AS mu, avg(v) AS mv, avg(u * u) AS uu, avg(v * v) AS vv, avg(u * v) AS uv FROM win JOIN sc ON sc.query_idx = win.query_idx AND sc.ref_idx = win.ref_idx AND sc.y = ny AND sc.x = nx GROUP BY ALL),
sim AS (SELECT query_idx, ref_idx, 1 - avg((2 * mu * mv + 1e-4) * (2 * (uv - mu * mv) * 49 / 48 + 9e-4) / ((mu * mu + mv * mv + 1e-4) * ((uu - mu * mu + vv - mv * mv) * 49 / 48 + 9e-4))) AS err FROM bx GROUP BY ALL),
ssim AS (SELECT p.query_idx, p.ref_idx, coalesce(err, 1.0) AS err FROM (SELECT DISTINCT query_idx, ref_idx FROM {maps}) p LEFT JOIN sim ON sim.query_idx = p.query_idx AND sim.ref_idx = p.ref_idx)"""


#: The same inputs for DuckDB; only those that a query names are computed.
SQL = f"""WITH RECURSIVE ev AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'ref' ELSE 'query' END AS seq, event_id AS event_idx, epoch_us(ts) AS t, CAST(user_id % 24 AS INTEGER) AS x,
  CAST(CAST(floor(value) AS BIGINT) % 18 AS INTEGER) AS y, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS p FROM events),
bounds AS (SELECT seq, min(t) AS s0, max(t) AS tmax FROM ev GROUP BY seq),
fe AS (SELECT seq, event_idx, t, x, y, p, (t - s0) // {DT} AS frame_idx FROM ev JOIN bounds USING (seq) WHERE s0 < tmax AND s0 + ((t - s0) // {DT}) * {DT} < tmax),
fc AS (SELECT * FROM fe WHERE x >= 0 AND x < {W} AND y >= 0 AND y < {H}),
fr AS (SELECT seq, s0, unnest(generate_series(0, (tmax - s0 + {DT} - 1) // {DT} - 1)) AS frame_idx FROM bounds WHERE s0 < tmax),
frames AS (SELECT seq, frame_idx, s0 + frame_idx * {DT} AS w_start, s0 + frame_idx * {DT} + {DT} AS w_end, (SELECT count(*) FROM fe WHERE fe.seq = fr.seq AND fe.frame_idx = fr.frame_idx) AS n_events FROM fr),
cnt AS (SELECT seq, frame_idx, y, x, CAST(count(*) AS DOUBLE) AS value FROM fc GROUP BY ALL),
d AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'ref' ELSE 'query' END AS seq, vec_id // 2 AS frame_idx, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
dn AS (SELECT seq, frame_idx, label, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS vec FROM d),
gt AS (SELECT r.frame_idx AS ref_idx, q.frame_idx AS query_idx FROM d r JOIN d q ON r.label = q.label AND r.seq = 'ref' AND q.seq = 'query'),
k0 AS (SELECT seq, frame_idx, vec, unnest(generate_series(0, frame_idx % 6 + 2)) AS j FROM d),
k1 AS (SELECT seq, frame_idx, CAST(j AS INTEGER) AS kp_idx, CAST(20 * j + frame_idx % 7 AS DOUBLE) AS x, CAST(13 * ((3 * j) % 8) + frame_idx % 5 AS DOUBLE) AS y, vec[j * 8 + 1 : j * 8 + 8] AS part FROM k0),
kp AS (SELECT seq, frame_idx, kp_idx, x, y, abs(part[1]) AS score, list_transform(part, lambda v: v / greatest(sqrt(list_dot_product(part, part)), 1e-12)) AS desc_ FROM k1),
pairs AS (SELECT r.frame_idx AS ref_idx, q.frame_idx AS query_idx, list_dot_product(r.vec, q.vec) AS sim FROM dn r, dn q WHERE r.seq = 'ref' AND q.seq = 'query'),
ranked AS (SELECT query_idx, ref_idx, sim, 1 - sim AS dist, row_number() OVER (PARTITION BY query_idx ORDER BY 1 - sim, ref_idx) AS rank FROM pairs),
cand AS (SELECT * FROM ranked WHERE rank <= 50),
kd AS (SELECT c.query_idx, c.ref_idx, q.kp_idx AS i, r.kp_idx AS j, sqrt(greatest(2 - 2 * list_dot_product(q.desc_, r.desc_), 0)) AS dist, q.x AS src_x, q.y AS src_y, r.x AS dst_x, r.y AS dst_y
  FROM cand c JOIN kp q ON q.seq = 'query' AND q.frame_idx = c.query_idx JOIN kp r ON r.seq = 'ref' AND r.frame_idx = c.ref_idx),
ki AS (SELECT *, row_number() OVER (PARTITION BY query_idx, ref_idx, i ORDER BY dist, j) AS ri, row_number() OVER (PARTITION BY query_idx, ref_idx, j ORDER BY dist, i) AS rj,
  lead(dist) OVER (PARTITION BY query_idx, ref_idx, i ORDER BY dist, j) AS next FROM kd),
mutual AS (SELECT * FROM ki WHERE ri = 1 AND rj = 1),
ratio AS (SELECT * FROM ki WHERE ri = 1 AND next IS NOT NULL AND dist < 0.8 * next),
{_inliers("mutual", "inl")},
{_inliers("ratio", "inlr")},
{_fused("inl", "fused")},
{_fused("inlr", "fusedr")},
dep AS (SELECT f.seq, f.frame_idx, yy AS y, xx AS x, CASE WHEN (xx + yy) % 7 = 0 THEN 0 ELSE 1 + coalesce(value, 0) END AS v FROM frames f CROSS JOIN (SELECT unnest(generate_series(0, {H - 1})) AS yy) CROSS JOIN (SELECT unnest(generate_series(0, {W - 1})) AS xx)
  LEFT JOIN cnt ON cnt.seq = f.seq AND cnt.frame_idx = f.frame_idx AND cnt.y = yy AND cnt.x = xx),
dpair AS (SELECT q.frame_idx AS query_idx, r.frame_idx AS ref_idx, abs(q.frame_idx - r.frame_idx) / 10.0 AS dist FROM frames q, frames r WHERE q.seq = 'query' AND r.seq = 'ref' AND abs(q.frame_idx - r.frame_idx) <= 2),
means AS (SELECT seq, y, x, sum(value) / n AS mean FROM cnt JOIN (SELECT seq, count(*) AS n FROM fr GROUP BY seq) USING (seq) GROUP BY seq, y, x, n),
pstat AS (SELECT seq, sum(mean) / {H * W}.0 AS m, sum(mean * mean) / {H * W}.0 AS m2 FROM means GROUP BY seq),
pcut AS (SELECT means.seq, y, x, CASE WHEN mean > m + 2 * sqrt(greatest(m2 - m * m, 0)) THEN 0.01 ELSE mean END AS v FROM means JOIN pstat USING (seq)),
grid AS (SELECT y, x, CAST(row_number() OVER (ORDER BY y, x) - 1 AS INTEGER) AS pixel FROM (SELECT unnest([2, 5, 9, 13]) AS y) a, (SELECT unnest([1, 7, 12, 20]) AS x) b),
ctr AS (SELECT CAST(frame_idx * 3 + kp_idx AS INTEGER) AS cluster, desc_ AS c FROM kp WHERE seq = 'ref' AND ((frame_idx = 0 AND kp_idx <= 2) OR (frame_idx = 1 AND kp_idx = 0))),
tim AS (SELECT event_id AS frame_idx, event_type AS stage, value AS ms FROM events),
recall AS (SELECT k, avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END) AS recall FROM (SELECT q.query_idx, min(CASE WHEN gt.ref_idx IS NOT NULL THEN rank END) AS first FROM (SELECT DISTINCT query_idx FROM gt) q JOIN ranked ON ranked.query_idx = q.query_idx LEFT JOIN gt ON gt.query_idx = ranked.query_idx AND gt.ref_idx = ranked.ref_idx GROUP BY q.query_idx), (SELECT unnest([1, 5, 10]) AS k) GROUP BY k)
"""
