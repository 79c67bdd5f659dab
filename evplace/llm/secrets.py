"""Secret scan with multipart credential linking: weak parts count only beside their complements."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evplace.llm._shared import small_batches

#: Base kinds in the order in which they are listed, then the parts that linking adds.
KINDS = ("assign", "access", "hex", "endpoint", "key_id", "key_part")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is taken whole, so shorter runs just fail
URL = re.compile(r"(?:https?|ftp|ssh|jdbc|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}", re.A)
ADDRESS = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", re.A)
#: Weak parts: a name for an account, and a value that looks random but has no telling name beside it.
KEY_ID = re.compile(r"""(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.A | re.I)
KEY_PART = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", re.A)
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", re.A)
#: What each kind is a part of: access identifiers, secrets, endpoints.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "endpoint": "endpoint", "key_id": "id", "key_part": "secret"}
ROLES = ("id", "secret", "endpoint")


def find_parts(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS) of base spans and of weak parts clear of them, in code points."""
    if not text:
        return []
    low, out, weak = text.lower(), [], []
    # a literal that each pattern needs tells cheaply which texts to scan
    if (":" in low or "=" in low) and any(x in low for x in ("pass", "secret", "token", "key")):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if "://" in text:
        weak += [(m.start(), m.end(), 3) for m in URL.finditer(text)]
    weak += [(m.start(), m.end(), 3) for m in ADDRESS.finditer(text)]
    if (":" in low or "=" in low) and any(x in low for x in ("user", "login", "account", "client", "key")):
        weak += [(m.start(), m.end(), 4) for m in KEY_ID.finditer(text)]
    weak += [(m.start(), m.end(), 5) for m in KEY_PART.finditer(text) if MIXED.match(m[0])]
    if weak and out:
        out.sort()
        starts, ends = [s for s, _, _ in out], []
        for _, e, _ in out:
            ends.append(max(e, ends[-1]) if ends else e)
        clear = lambda s, e: (i := bisect.bisect_left(starts, e)) == 0 or ends[i - 1] <= s
        weak = [w for w in weak if clear(w[0], w[1])]
    return sorted(out + weak)


_PART = "array<struct<s:int,e:int,k:int>>"


def _parts(batches):
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            found = [[{"s": s, "e": e, "k": k} for s, e, k in find_parts(t)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["id", "parts"])


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = 200) -> DataFrame:
    """One row for each document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans come from three patterns, scanned from the left without overlaps for each kind, over
    whole texts. Weak parts (endpoints, account names, random-looking values) are added where the
    interval join finds complements: a part's interval is its span widened by ``scope`` code points,
    and it needs parts of both other roles in it, or a base span of one of them. The join runs over
    the parts alone: windows over one document's parts in order carry the last end and the next start
    of every role, so it is linear however many parts a document has and never pairs all with all.
    Null and empty texts have no spans. Repeated rows and null ids give a row each. Extra columns
    are ignored, whatever their names.
    """
    d = small_batches(docs).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = d.mapInArrow(_parts, f"id {d.schema['id'].dataType.simpleString()}, parts {_PART}").withColumn("row", F.monotonically_increasing_id())
    x = found.select("row", "id", F.explode_outer("parts").alias("x")).select("row", "id", "x.*")
    role = F.element_at(F.array(*[F.lit(ROLES.index(ROLE[k])) for k in KINDS]), F.col("k") + 1)
    base = F.col("k") < 3
    on = Window.partitionBy("row")
    before = on.orderBy("s", "e", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = on.orderBy(F.desc("s"), F.desc("e"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    near = {}
    for r in range(len(ROLES)):
        for strong in (False, True):
            it = (role == r) & base if strong else role == r
            last, following = F.max(F.when(it, F.col("e"))).over(before), F.min(F.when(it, F.col("s"))).over(after)
            near[f"near{r}{int(strong)}"] = F.coalesce(last >= F.col("s") - scope, F.lit(False)) | F.coalesce(following <= F.col("e") + scope, F.lit(False))
    x = x.withColumns(near)
    keep = base
    for r in range(len(ROLES)):
        a, b = [o for o in range(len(ROLES)) if o != r]
        keep = keep | ((role == r) & ((F.col(f"near{a}0") & F.col(f"near{b}0")) | F.col(f"near{a}1") | F.col(f"near{b}1")))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    span = F.struct("s", "k", "e", F.concat_ws(":", name, F.col("s").cast("string"), F.col("e").cast("string")).alias("t"))
    listed = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, span))), lambda y: y["t"]), ",")
    count = lambda k: F.count(F.when(F.col("k") == k, 1)).alias(f"n_{KINDS[k]}")
    return x.groupBy("row").agg(
        F.first("id").alias(doc_id), count(0), count(1), count(2), F.sha2(listed(base), 256).alias("base_sha256"), listed(keep).alias("spans"),
    ).drop("row")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
