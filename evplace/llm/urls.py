"""URL filter: rules, and beyond them the ratio of two character language models, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evplace.llm._shared import ascii_lower, spread, written

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
START, END = "\u0002", "\u0003"
ALPHABET = 256
#: Grams of the longest order whose ratios may be broadcast (some tens of bytes each); beyond, they are joined by shuffle.
FEW_GRAMS = 500_000


def host_path(url) -> tuple:
    """Host and path columns; both empty for null, or without '://'."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host, path, rules) -> tuple:
    """The longest fitting rule (null if none) and its verdict. Host names fit with their subdomains."""
    rule = verdict = F
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(says))
    return rule, verdict


def _grams(chars, order: int):
    """Every character with up to ``order`` characters before it, as (k, gram of k+1 characters)."""
    return F.flatten(F.transform(
        F.sequence(F.lit(order + 1), F.size(chars)),
        lambda i: F.transform(F.array(*[F.lit(k) for k in range(order + 1)]), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(chars, i - k, k + 1), "").alias("g"))),
    ))


def gram_ratios(urls: DataFrame, order: int, prior: float) -> DataFrame:
    """g (order+1 characters), llr: log of the accepted over the rejected model's probability, in millionths.

    urls: text, side ('a' or 'r': counted in that model; else only looked up), n (times it occurs).
    The models are of variable order: the estimate after k characters is
    (count + prior * estimate after k-1 characters) / (context count + prior), from a uniform one
    over 256 characters; contexts a model has not seen fall back to shorter ones by themselves.
    Tables are as large as the distinct grams, which the characters of URLs bound. Grams are counted once, in all tasks, and written.
    """
    chars = F.regexp_extract_all(F.concat(F.lit(START * order), F.col("text"), F.lit(END)), F.lit("(?s)."), 0)
    counts = written(
        urls.select("side", "n", chars.alias("c"))
        .select("n", "side", F.explode(_grams(F.col("c"), order)).alias("x"))
        .groupBy(F.col("x.k").alias("k"), F.col("x.g").alias("g"))
        .agg(F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == "r", F.col("n")).otherwise(0)).alias("r")),
        "grams")
    below = None
    for k in range(order + 1):
        own = counts.where(F.col("k") == k).select("g", F.substring("g", 1, k).alias("ctx"), F.substring("g", 2, k).alias("short"), "a", "r")
        total = own.groupBy("ctx").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
        own = own.join(total, "ctx")
        if below is None:
            own = own.withColumns({"la": F.lit(1.0 / ALPHABET), "lr": F.lit(1.0 / ALPHABET)})
        else:
            own = own.join(below.select(F.col("g").alias("short"), F.col("pa").alias("la"), F.col("pr").alias("lr")), "short")
        below = own.select(
            "g",
            ((F.col("a") + prior * F.col("la")) / (F.col("ta") + prior)).alias("pa"),
            ((F.col("r") + prior * F.col("lr")) / (F.col("tr") + prior)).alias("pr"),
        )
    ratios = below.select("g", F.round(1e6 * (F.log("pa") - F.log("pr"))).cast("long").alias("llr"))
    return F.broadcast(ratios) if counts.where(F.col("k") == order).count() <= FEW_GRAMS else ratios


def judged_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, order: int = 4, prior: float = 4.0,
                bins_per_nat: int = 1000) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, llr (mean per character, in nats).

    Where a rule fits, it decides. The others are judged by two smoothed variable-order Markov
    models of characters, of the URLs that rules allow and of those they block: four fifths of
    these (by md5 of the URL) train the models, the last fifth calibrates the threshold of the
    length-normalised log-likelihood difference at the least balanced error (ties: nearest to 0,
    then the smaller). With no accepted or no rejected URL to calibrate by, the threshold is 0. URLs are known by their md5.
    Null and empty URLs have an empty host and path and are judged by the models as an empty
    text. Distinct URLs are scored once, so repeated rows cost nothing; rows are kept as they are.
    """
    host, path = host_path(F.col("u"))
    p = pages.select(F.col(page_id).alias("id"), F.col(url).alias("u")).withColumns({"host": host, "path": path})
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    p = p.select("id", ascii_lower(F.coalesce("u", F.lit(""))).alias("text"), "host", "path", rule.alias("rule"), says.alias("says"))
    fold = F.conv(F.substring(F.md5("text"), 1, 6), 16, 10).cast("long") % 5
    side = F.when(F.col("says").isNull(), "-").when(fold == 4, F.when(F.col("says") == "allow", "A").otherwise("R")).when(F.col("says") == "allow", "a").otherwise("r")
    # distinct URLs are few bytes but many grams
    urls = written(spread(p.groupBy("text", side.alias("side")).agg(F.count("*").alias("n"))), "urls")
    ratios = gram_ratios(urls, order, prior)
    chars = F.regexp_extract_all(F.concat(F.lit(START * order), F.col("text"), F.lit(END)), F.lit("(?s)."), 0)
    # a text of both sides (the host's case decides no rule, so there is none) would be scored once
    texts = urls.select("text").distinct().select("text", chars.alias("c"))
    grams = F.transform(F.sequence(F.lit(order + 1), F.size("c")), lambda i: F.array_join(F.slice("c", i - order, order + 1), ""))
    scored = (
        texts.select(F.md5("text").alias("key"), F.explode(grams).alias("g")).join(ratios, "g")
        .groupBy("key").agg((F.sum("llr") / F.count("*") / 1e6).alias("llr"))
    )
    scored = written(scored, "url-scores")
    urls = urls.withColumn("key", F.md5("text"))
    calibration = urls.where(F.col("side").isin("A", "R")).select("key", "side", "n").join(scored, "key")
    bins = calibration.groupBy(F.floor(F.col("llr") * bins_per_nat).alias("bin")).agg(
        F.sum(F.when(F.col("side") == "A", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == "R", F.col("n")).otherwise(0)).alias("r"))
    threshold = _threshold(bins)
    judged = p.withColumn("key", F.md5("text")).join(scored, "key").crossJoin(F.broadcast(threshold))
    by_model = F.when(F.floor(F.col("llr") * bins_per_nat) >= F.col("cut"), "allow").otherwise("block")
    return judged.select(F.col("id").alias(page_id), "host", "path", "rule", F.coalesce("says", by_model).alias("verdict"), "llr")


def _threshold(bins: DataFrame) -> DataFrame:
    """One row: the bin from which URLs are accepted, by running sums over the bins, which are few: the models bound the log ratio."""
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(1))
    sums = bins.select("bin", "a", "r", F.sum("a").over(upto).alias("sa"), F.sum("r").over(upto).alias("sr"), F.sum("a").over(everything).alias("ta"), F.sum("r").over(everything).alias("tr"))
    # accepted from this bin on, or from the next one
    cuts = sums.select("ta", "tr", F.explode(F.array(
        F.struct(F.col("bin").alias("cut"), (F.col("sa") - F.col("a")).alias("lost"), (F.col("tr") - F.col("sr") + F.col("r")).alias("let_in")),
        F.struct((F.col("bin") + 1).alias("cut"), F.col("sa").alias("lost"), (F.col("tr") - F.col("sr")).alias("let_in")))).alias("x"))
    error = F.round(F.col("x.lost") / F.col("ta") + F.col("x.let_in") / F.col("tr"), 9)
    best = F.min(F.when((F.col("ta") > 0) & (F.col("tr") > 0), F.struct(error.alias("error"), F.abs("x.cut").alias("far"), F.col("x.cut").alias("cut"))))
    return cuts.agg(F.coalesce(best["cut"], F.lit(0)).cast("long").alias("cut"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql(rules=RULES, order: int = 4, prior: float = 4.0) -> str:
    """judged_urls() over the view pages, for DuckDB."""
    fits = []
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, slash, p = text.partition("/")
        fits.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash + p}')", text, says))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    levels = []
    for k in range(order + 1):
        below = f"{1.0 / ALPHABET}" if not k else "{}"
        join = f" JOIN l{k - 1} b ON b.g = substr(o.g, 2)" if k else ""
        prob = lambda c, low: f"(o.{c} + {prior} * {low}) / (t{c} + {prior})"
        levels.append(
            f"l{k} AS (SELECT o.g, {prob('a', below.format('b.pa'))} AS pa, {prob('r', below.format('b.pr'))} AS pr FROM (SELECT g, substr(g, 1, {k}) AS ctx, a, r FROM counts WHERE k = {k}) o"
            f" JOIN (SELECT substr(g, 1, {k}) AS ctx, sum(a) AS ta, sum(r) AS tr FROM counts WHERE k = {k} GROUP BY ALL) t ON t.ctx = o.ctx{join})")
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {lower.format('u')} AS text, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
j AS (SELECT *, {case(1)} AS rule, {case(2)} AS says, CAST('0x' || substr(md5(text), 1, 6) AS BIGINT) % 5 AS fold FROM h),
urls AS (SELECT text, CASE WHEN says IS NULL THEN '-' WHEN fold = 4 THEN CASE says WHEN 'allow' THEN 'A' ELSE 'R' END WHEN says = 'allow' THEN 'a' ELSE 'r' END AS side, count(*) AS n FROM j GROUP BY ALL),
chars AS (SELECT text, side, n, regexp_extract_all(repeat(chr(2), {order}) || text || chr(3), '(?s).') AS c FROM urls),
spots AS (SELECT text, side, n, c, unnest(generate_series({order + 1}, len(c))) AS i FROM chars),
counts AS (SELECT k, array_to_string(list_slice(c, i - k, i), '') AS g, sum(CASE WHEN side = 'a' THEN n ELSE 0 END) AS a, sum(CASE WHEN side = 'r' THEN n ELSE 0 END) AS r FROM spots, (SELECT unnest(generate_series(0, {order})) AS k) GROUP BY ALL),
{", ".join(levels)},
ratios AS (SELECT g, CAST(round(1e6 * (ln(pa) - ln(pr))) AS BIGINT) AS llr FROM l{order}),
texts AS (SELECT DISTINCT text, c FROM chars),
grams AS (SELECT text, unnest(generate_series({order + 1}, len(c))) AS i, c FROM texts),
scored AS (SELECT text, CAST(sum(llr) AS DOUBLE) / count(*) / 1e6 AS llr FROM grams JOIN ratios ON g = array_to_string(list_slice(c, i - {order}, i), '') GROUP BY text),
bins AS (SELECT CAST(floor(llr * 1000) AS BIGINT) AS bin, sum(CASE WHEN side = 'A' THEN n ELSE 0 END) AS a, sum(CASE WHEN side = 'R' THEN n ELSE 0 END) AS r FROM urls JOIN scored USING (text) WHERE side IN ('A', 'R') GROUP BY ALL),
tot AS (SELECT coalesce(sum(a), 0) AS ta, coalesce(sum(r), 0) AS tr FROM bins),
cuts AS (SELECT DISTINCT unnest([bin, bin + 1]) AS cut FROM bins),
errors AS (SELECT cut, round(sum(CASE WHEN bin < cut THEN a / CAST(ta AS DOUBLE) ELSE r / CAST(tr AS DOUBLE) END), 9) AS error FROM cuts, bins, tot WHERE ta > 0 AND tr > 0 GROUP BY cut),
best AS (SELECT coalesce((SELECT cut FROM errors ORDER BY error, abs(cut), cut LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN floor(llr * 1000) >= cut THEN 'allow' ELSE 'block' END) AS verdict, llr FROM j JOIN scored USING (text), best
"""


OP10_SQL = _sql()
