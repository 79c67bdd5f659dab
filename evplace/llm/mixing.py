"""Temperature mixing of sources: shares to a power, bisected to a target, realised as budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evplace.llm._shared import aside, dropped, written

WORDS = r"[^\x20\x09-\x0D]+"
#: The exponent is a whole number of these steps, from 0 (equal weights) to 1 (shares as they are).
STEPS = 1 << 20


def _slim(docs: DataFrame, doc_id: str, text: str, source: str) -> list:
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return [
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        F.concat(key, F.lit(":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_key"),
        F.conv(F.substring(key, 1, 8), 16, 10).cast("long").alias("_hash"),
    ]


def exponent(shares: DataFrame, total: float, entropy: float, repeats: float, budget: float) -> int:
    """The exponent in STEPS: the greatest with the target entropy, but at least so great that no source is repeated over ``repeats`` times.

    shares: one row for each source with tokens, p. Both measures are monotone in the exponent, so each round
    measures 32 exponents at once in one small aggregate and keeps one of the intervals between them.
    """
    n = shares.count()
    if n < 2:
        return STEPS
    import math

    def last(fits, low: int) -> int:
        """The greatest k that fits (fits(low) holds); fits is monotone."""
        high = STEPS + 1  # does not fit, or is out of range
        while high - low > 1:
            step = max(1, (high - low) // 32)
            at = [k for k in range(low + step, high, step)]
            w = F.pow(F.col("p"), F.col("k") / STEPS)
            rows = shares.select("p", F.explode(F.array(*[F.lit(k) for k in at])).alias("k")).groupBy("k").agg(
                F.sum(w).alias("z"), F.sum(w * F.log("p") * F.col("k") / STEPS).alias("wl"), F.max(w / F.col("p")).alias("most")).collect()
            good = {r["k"] for r in rows if fits(r)}
            first_bad = next((k for k in at if k not in good), None)
            low, high = (low if first_bad == at[0] else (at[-1] if first_bad is None else first_bad - step)), (first_bad if first_bad is not None else high)
        return low

    # entropy of w / z is log z - sum(w log w) / z, and log w is k / STEPS * log p
    by_entropy = last(lambda r: math.log(r["z"]) - r["wl"] / r["z"] >= entropy * math.log(n), 0)
    if budget * shares.agg(F.max(F.lit(1.0 / n) / F.col("p"))).first()[0] <= repeats:
        return by_entropy
    too_often = last(lambda r: budget * r["most"] / r["z"] > repeats, 0)
    return min(STEPS, max(by_entropy, too_often + 1))


def mixed(docs: DataFrame, entropy: float = 0.98, repeats: float = 4.0, budget: float = 1.0, doc_id: str = "doc_id", text: str = "text",
          source: str = "source", broadcast_rows: int = 1_000_000, keys: bool = True) -> DataFrame:
    """docs, each row as often as its source's weight asks, with _source, pass, block, sort_key added (not without ``keys``).

    A source's weight is its share of words to the power of an exponent in 0..1, normalised. The
    exponent is the greatest whose weights have ``entropy`` times the greatest possible entropy, but so great that, at a
    budget of ``budget`` times all words, no source is read over ``repeats`` times. Each source's
    words in the budget are whole passes over it and a rest. A pass is a permutation of the
    source's blocks (the square root of its rows; rows are dealt by the md5 of their id), and of the rows in a
    block; sorting by sort_key gives it. The rest takes whole blocks in the order of a pass and then rows of the
    next block while they fit. So only counts by source and block are summed up in order, and rows
    join their block's decision, broadcast if there are at most ``broadcast_rows`` blocks.
    Null sources count as ''. Null and empty texts have no words and go with their block; sources without words
    get no rows, as does an empty table. Repeated rows and null ids are rows like others. Columns of
    docs stay, whatever their names, but with ``keys`` the four added ones must not be among them.
    """
    # a row's own columns are kept aside, so that no name clashes
    d = docs.select(aside(docs).alias("_row"), *_slim(docs, doc_id, text, source))
    slim = written(docs.select(*_slim(docs, doc_id, text, source), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS)).cast("long").alias("words")), "words")
    sources = slim.groupBy("_source").agg(F.sum("words").alias("all"), F.count("*").alias("rows")).where("all > 0")
    sources = written(sources, "sources")
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("all"), F.lit(0))).first()
    p = F.col("all") / F.lit(float(max(total, 1)))
    k = exponent(sources.select(p.alias("p")), total, entropy, repeats, budget)
    power = F.pow(p, F.lit(k / STEPS))
    z = sources.agg(F.coalesce(F.sum(power), F.lit(1.0))).first()[0]
    asked = F.floor(F.round(power / F.lit(z) * F.lit(budget * total), 3)).cast("long")
    plan = sources.select("_source", F.ceil(F.sqrt(F.col("rows").cast("double"))).cast("long").alias("blocks"), "all", asked.alias("asked"))
    plan = plan.select("_source", "blocks", F.floor(F.col("asked") / F.col("all")).cast("int").alias("passes"), (F.col("asked") % F.col("all")).alias("rest"))
    few = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df
    block = F.pmod("_hash", "blocks").cast("int")
    parts = slim.join(few(plan, n_sources), "_source").withColumn("block", block)
    blocks = parts.groupBy("_source", "block", "passes", "rest").agg(F.sum("words").alias("words"))
    order = Window.partitionBy("_source").orderBy(_block_key(F.col("_source"), F.col("passes"), F.col("block")), "block")
    blocks = blocks.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = written(blocks.withColumn("before", F.col("upto") - F.col("words")), "blocks")
    # the one block of each source that the rest ends in: its last row that fits
    cut = blocks.where("before <= rest and upto > rest").groupBy("_source").agg(F.min(F.struct("before", "block")).alias("x")).select("_source", "x.block", "x.before")
    inside = slim.join(few(plan, n_sources), "_source").withColumn("block", block).join(few(cut, n_sources), ["_source", "block"])
    rows = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("words").over(rows)).where("upto <= rest").groupBy("_source", "block").agg(F.max("_key").alias("last"))
    n_blocks = blocks.count()
    decided = blocks.join(inside, ["_source", "block"], "left").select("_source", "block", "passes", F.when(F.col("upto") <= F.col("rest"), F.lit("~")).otherwise(F.coalesce("last", F.lit(""))).alias("last"))
    decided = written(decided, "decisions")
    dropped(slim)
    if keys and (clash := {"_source", "pass", "block", "sort_key"} & set(docs.columns)):
        raise ValueError(f"docs have columns {sorted(clash)}; rename them, or take the rows without keys")
    out = d.join(few(plan.select("_source", "blocks"), n_sources), "_source").withColumn("block", block).join(few(decided, n_blocks), ["_source", "block"])
    times = F.col("passes") + F.when(F.col("_key") <= F.col("last"), 1).otherwise(0)
    out = out.withColumn("pass", F.explode(F.when(times > 0, F.sequence(F.lit(0), (times - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    if not keys:
        return out.select("_row.*")
    key = F.concat(_block_key(F.col("_source"), F.col("pass"), F.col("block")), F.lit(":"), F.md5(F.concat(F.col("pass").cast("string"), F.lit(":"), F.col("_key"))))
    return out.select("_row.*", "_source", "pass", "block", F.when(F.col("pass") < F.col("passes"), key).otherwise(F.concat(_block_key(F.col("_source"), F.col("pass"), F.col("block")), F.lit(":"), F.col("_key"))).alias("sort_key"))


def _block_key(source, times, block):
    return F.md5(F.concat(source, F.lit(":"), times.cast("string"), F.lit(":"), block.cast("string")))


def op5_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "source", "pass", "block", "sort_key")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM documents),
k AS (SELECT doc_id, source, s, h || ':' || coalesce(CAST(doc_id AS VARCHAR), '') AS key, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS hash, words FROM d),
t AS (SELECT s, sum(words) AS al, count(*) AS n FROM k GROUP BY s HAVING sum(words) > 0),
p AS (SELECT s, n, al, CAST(al AS DOUBLE) / (SELECT CAST(sum(al) AS DOUBLE) FROM t) AS p FROM t),
e(lo, hi) AS (
  SELECT 0, 1048577 UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT lo, hi, (lo + hi) // 2 AS mid, (SELECT ln(sum(pow(p, ((lo + hi) // 2) / 1048576.0))) - sum(pow(p, ((lo + hi) // 2) / 1048576.0) * ln(p) * ((lo + hi) // 2) / 1048576.0) / sum(pow(p, ((lo + hi) // 2) / 1048576.0)) >= 0.98 * ln(count(*)) FROM p) AS ok
    FROM e WHERE hi - lo > 1)),
r(lo, hi) AS (
  SELECT 0, 1048577 UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT lo, hi, (lo + hi) // 2 AS mid, (SELECT max(pow(p, ((lo + hi) // 2) / 1048576.0) / p) / sum(pow(p, ((lo + hi) // 2) / 1048576.0)) > 4 FROM p) AS ok
    FROM r WHERE hi - lo > 1)),
a AS (SELECT CASE WHEN (SELECT count(*) FROM p) < 2 THEN 1048576 WHEN (SELECT max(1.0 / (SELECT count(*) FROM p) / p) FROM p) <= 4 THEN (SELECT max(lo) FROM e)
        ELSE least(1048576, greatest((SELECT max(lo) FROM e), (SELECT max(lo) FROM r) + 1)) END / 1048576.0 AS a),
q AS (SELECT s, al, n, CAST(floor(round(pow(p, a) / (SELECT sum(pow(p, a)) FROM p, a) * (SELECT sum(al) FROM t), 3)) AS BIGINT) AS asked FROM p, a),
plan AS (SELECT s, CAST(ceil(sqrt(n)) AS BIGINT) AS blocks, CAST(asked // al AS INTEGER) AS passes, asked % al AS rest FROM q),
x AS (SELECT k.*, passes, rest, CAST(hash % blocks AS INTEGER) AS block FROM k JOIN plan USING (s)),
b AS (SELECT s, block, passes, rest, sum(words) AS words FROM x GROUP BY ALL),
c AS (SELECT *, sum(words) OVER (PARTITION BY s ORDER BY md5(s || ':' || passes || ':' || block), block ROWS UNBOUNDED PRECEDING) AS upto FROM b),
cut AS (SELECT s, min_by(block, upto - words) AS block, min(upto - words) AS bef FROM c WHERE upto - words <= rest AND upto > rest GROUP BY s),
i AS (SELECT x.s, x.block, key, x.rest, bef + sum(words) OVER (PARTITION BY x.s ORDER BY key ROWS UNBOUNDED PRECEDING) AS upto FROM x JOIN cut ON x.s = cut.s AND x.block = cut.block),
l AS (SELECT s, block, max(key) AS last FROM i WHERE upto <= rest GROUP BY ALL),
m AS (SELECT c.s, c.block, CASE WHEN upto <= rest THEN '~' ELSE coalesce(last, '') END AS last FROM c LEFT JOIN l ON c.s = l.s AND c.block = l.block),
o AS (SELECT x.*, unnest(generate_series(0, passes + CASE WHEN key <= m.last THEN 1 ELSE 0 END - 1)) AS pass FROM x JOIN m ON x.s = m.s AND x.block = m.block)
SELECT doc_id, source, CAST(pass AS INTEGER) AS pass, block,
       md5(s || ':' || pass || ':' || block) || ':' || CASE WHEN pass < passes THEN md5(pass || ':' || key) ELSE key END AS sort_key
FROM o
"""
