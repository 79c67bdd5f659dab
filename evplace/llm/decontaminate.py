"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evplace.llm._shared import ascii_lower, aside

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _words(text):
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct windows: win (words joined by a space), wlen, items (ids as strings that have it).

    An item of fewer words than ``window``, but not none, is one window.
    """
    i = items.select(F.col(item_id).cast("string").alias("item"), _words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (
        i.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, window))).alias("g"))
        .groupBy(F.array_join("g", " ").alias("win"))
        .agg(F.max(F.size("g")).alias("wlen"), F.collect_set("item").alias("items"))
    )


def window_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                item_text: str = "text", window: int = 10, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Every place where a document holds an item's window: did, key, s, e (words, end exclusive), items.

    Shingle tokens are ordered by their rarity in all documents. A window that must occur whole
    needs its rarest token, so that one token is its prefix; documents are joined on prefix
    tokens alone, then the positional bound (the window must lie inside the document) and exact
    equality of all its words decide. A window with a word that no document has is dropped.
    The windows are broadcast only if their measured size is within ``broadcast_bytes``; beyond
    that, positions are first joined by token without texts, and texts join the survivors.
    """
    d = docs.select(F.col(doc_id).alias("did"), F.xxhash64(text).alias("key"), _words(F.col(text)).alias("words"))
    wins = item_windows(items, item_id, item_text, window)
    vocab = wins.select(F.explode(F.split("win", " ")).alias("word")).distinct()
    n, size = vocab.agg(F.count("*"), F.coalesce(F.sum(F.length("word") + 16), F.lit(0))).first()
    small = size <= broadcast_bytes
    seen = d.select(F.explode("words").alias("word")).join(F.broadcast(vocab) if small else vocab, "word", "left_semi").groupBy("word").agg(F.count("*").alias("seen"))
    tokens = wins.select("win", "wlen", F.posexplode(F.split("win", " ")).alias("off", "word")).join(seen, "word")
    prefix = (
        tokens.groupBy("win", "wlen").agg(F.count("*").alias("known"), F.min(F.struct("seen", "word", "off")).alias("r"))
        .where("known = wlen").select("win", F.col("r.word").alias("word"), F.col("r.off").alias("off"))
    )
    probes = prefix.join(wins, "win").select("word", "win", "wlen", "off", "items")
    size = wins.agg(F.coalesce(F.sum(F.length("win") * 2 + 64 + F.size("items") * 24), F.lit(0))).first()[0]
    at = F.col("pos") - F.col("off")
    inside = (at >= 0) & (at + F.col("wlen") <= F.size("words"))
    same = F.array_join(F.slice("words", at + 1, F.col("wlen")), " ") == F.col("win")
    if size <= broadcast_bytes:
        places = d.select("did", "key", "words", F.posexplode("words").alias("pos", "word")).join(F.broadcast(probes), "word")
    else:
        found = d.select("did", "key", F.posexplode("words").alias("pos", "word")).join(probes.drop("items"), "word")
        texts = d.select(F.col("did").alias("did2"), F.col("key").alias("key2"), "words").dropDuplicates(["did2", "key2"])
        places = found.join(texts, F.col("did").eqNullSafe(F.col("did2")) & (F.col("key") == F.col("key2")))
        return (
            places.where(inside).where(same).select("did", "key", "win", at.alias("s"), (at + F.col("wlen")).alias("e"))
            .join(wins.select("win", "items"), "win").select("did", "key", "s", "e", "items")
        )
    return places.where(inside).where(same).select("did", "key", at.alias("s"), (at + F.col("wlen")).alias("e"), "items")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """One row for each document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and hit nothing, null item texts have no window. Rows that
    repeat a doc_id are judged one by one by their text; a null doc_id is a value like others.
    Empty tables give no rows, or no hits. Extra columns are ignored, whatever their names.
    """
    hits = window_hits(docs, items, doc_id, text, item_id, item_text, window, broadcast_bytes)
    # the union of the hit spans, folded over the sorted spans of one text
    span = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["upto"], x["e"]).alias("upto"), (a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["upto"]), F.lit(0))).alias("n")),
    )["n"]
    by_doc = (
        hits.groupBy(F.col("did").alias("did2"), F.col("key").alias("key2"))
        .agg(F.collect_set(F.struct("s", "e")).alias("spans"), F.collect_set("items").alias("items"))
        .select("did2", "key2", span.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("ids"))
    )
    base = docs.select(F.col(doc_id).alias("did"), F.xxhash64(text).alias("key"), F.size(_words(F.col(text))).alias("n_words"))
    return base.join(by_doc, F.col("did").eqNullSafe(F.col("did2")) & (F.col("key") == F.col("key2")), "left").select(
        F.col("did").alias(doc_id),
        F.col("n_words").cast("long"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("ids").isNull(), F.lit(0)).otherwise(F.size("ids")).cast("long").alias("n_items"),
        F.when(F.col("ids").isNull(), F.lit(EMPTY_SHA)).otherwise(F.sha2(F.array_join("ids", ","), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_rows(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", window: int = 10, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs without any hit, with the columns of docs, whatever their names. Rows with null or empty texts stay; other cases as in contamination()."""
    hits = window_hits(docs, items, doc_id, text, item_id, item_text, window, broadcast_bytes)
    hit = hits.select("did", "key").distinct()
    whole = docs.select(aside(docs).alias("x"), F.col(doc_id).alias("own_id"), F.xxhash64(text).alias("own_key"))
    return whole.join(hit, F.col("own_id").eqNullSafe(F.col("did")) & (F.col("own_key") == F.col("key")), "left_anti").select("x.*")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) AS wlen, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, wlen, array_to_string(list_slice(w, s, s + wlen - 1), ' ') AS win FROM bw),
dw AS (SELECT r, l.wlen, unnest(generate_series(1, len(w) - l.wlen + 1)) AS s, w FROM d, (SELECT DISTINCT wlen FROM win) l WHERE len(w) >= l.wlen),
hit AS (SELECT r, s, dw.wlen, win.item FROM dw JOIN win ON dw.wlen = win.wlen AND array_to_string(list_slice(w, s, s + dw.wlen - 1), ' ') = win.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + wlen - 1)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""
