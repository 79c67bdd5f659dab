"""What several training-data operators share: the shared folder, written tables, Bloom filters, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after making the session hand texts to Python in batches of some MB, whatever their lengths."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


def aside(df: DataFrame):
    """All columns of df as one struct, so that names of its own cannot clash with those that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


#: Temporary folders of sessions that name no shared one, by application.
_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme; where the session names none, a temporary one on one machine (tests), an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        d = _temporary[app] = _temporary.get(app) or "file://" + tempfile.mkdtemp(prefix="evplace-")
    path = spark._jvm.org.apache.hadoop.fs.Path(d)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/evplace-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: computed once, and safe when executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._evplace_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session shuffles into, for rows that grow a lot in the next step; Spark would see few bytes and join them to few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path, spark = df._evplace_path, df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHashes:
    """64-bit hashes of words, remembered for up to ``room`` words."""

    def __init__(self, room: int = 200_000):
        import xxhash

        self.fn, self.room, self.seen = xxhash.xxh3_64_intdigest, room, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen, fn = self.seen, self.fn
        if len(seen) > self.room:
            seen.clear()
        get = seen.get
        out = [get(w) for w in words]
        if None in out:
            for i, (h, w) in enumerate(zip(out, words)):
                if h is None:
                    out[i] = seen[w] = fn(w)
        return np.array(out, dtype=np.uint64)


def bloom_of(keys: DataFrame, key: str, log2_bits: int = 23) -> np.ndarray:
    """A Bloom filter (two probes) of a column of longs as 2**log2_bits bits.

    Its size does not depend on the number of keys, so the driver may hold and broadcast it; more
    keys only let more non-members pass, and every user of it joins exactly afterwards. Built by a
    partial aggregate: at most 2**(log2_bits - 6) rows reach the driver.
    """
    k = F.col(key)
    mask = (1 << log2_bits) - 1
    at = F.explode(F.array(k.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(k, 64 - log2_bits))).alias("at")
    rows = (
        keys.where(k.isNotNull()).select(at)
        .select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )
    out = np.zeros(1 << (log2_bits - 6), dtype=np.uint64)
    got = rows.toPandas()
    out[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For uint64 keys: may they be members?"""
    log2 = int(bits.size).bit_length() - 1 + 6
    a, b = keys & np.uint64((1 << log2) - 1), keys >> np.uint64(64 - log2)
    one, low = np.uint64(1), np.uint64(63)
    return ((bits[a >> np.uint64(6)] >> (a & low)) & (bits[b >> np.uint64(6)] >> (b & low)) & one).astype(bool)
