"""Token-ID output: flat unsigned integer files with 64-bit document offsets, written and read by Spark tasks.

A folder holds, for each part P, ``P.bin`` (the ids, little-endian, 16 bits if the vocabulary
fits, else 32) and ``P.idx`` (int64: the number of documents n, n+1 offsets into P.bin counted
in ids, n document ids, n flags that are 0 where the document id is null), and ``manifest.json``
(dtype, and for each part its number of documents and ids and the ids in all parts before it).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evplace.llm._shared import new_path, small_batches

#: Pieces in one generation of a worker's cache, for each tokenizer; it keeps two.
REMEMBERED = 250_000
_MARKS = frozenset(".,;:!?")
#: Marks of which a run behind a letter is a word of its own by _WORD_PATTERN: all of ASCII but the apostrophe, which may begin a suffix.
_RUNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_encoders: dict = {}


#: Normalisers that leave white space where it is, or make one space of it, and pre-tokenisers that split at all white space and drop it.
_KEEPS_SPACE = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents")
_DROPS_SPACE = ("BertPreTokenizer", "Whitespace", "WhitespaceSplit")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _steps(x, inner: str) -> list[dict]:
    return [] if x is None else [z for y in x[inner] for z in _steps(y, inner)] if x["type"] == "Sequence" else [x]


def _splits_words(pre: list[dict]) -> bool:
    """Do pre-tokenisers begin with the split at _WORD_PATTERN?"""
    return bool(pre) and pre[0]["type"] == "Split" and pre[0]["pattern"] == {"Regex": _WORD_PATTERN} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]


def splits_at_space(tokenizer) -> bool:
    """Does a tokenizer's own description say that no token reaches across white space and that white space itself gives none?"""
    j = json.loads(tokenizer.to_str())
    for n in _steps(j["normalizer"], "normalizers"):
        one_space = n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "
        if n["type"] not in _KEEPS_SPACE and not one_space:
            return False
    pre = _steps(j["pre_tokenizer"], "pretokenizers")
    if not pre or any(x.get("lstrip") or x.get("rstrip") or any(c.isspace() for c in x["content"]) for x in j["added_tokens"]):
        return False
    if not _splits_words(pre) and pre[0]["type"] not in _DROPS_SPACE:
        return False
    return all(p["type"] == "ByteLevel" and not p["add_prefix_space"] for p in pre[1:])


class PieceEncoder(dict):
    """Ids of a text as bytes, piece by piece, for tokenizers that never join text across white space.

    Where a tokenizer's description says so, the ids of a
    text are those of its pieces between ASCII white space, one after another; with any other tokenizer whole texts go to the library.
    The mapping from pieces to ids is the cache.
    A piece of Latin letters in lower case is one word to the model, and a mark behind a letter is
    a word of its own, as is a run of marks where the description splits at _WORD_PATTERN; where samples show this to hold, the library's model gets such words directly. All other
    pieces go through the whole tokenizer. Tests compare with the library on whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        t = self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.older = np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"), {}
        self.by_piece = splits_at_space(t)
        self.special = [x.content.lower().encode() for x in t.get_added_tokens_decoder().values()]
        plain = lambda x: t.encode(x, add_special_tokens=False).ids
        # the printable form of each byte that byte-level models use: bytes without one are numbered from 256
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.shown = "".join(chr(other.get(b, b)) for b in range(256))
        self.tokenize, self.kind = t.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        words = ("the", "zqxv", "straße", "éàñ", "ƃaǿ", "ªº")
        self.folds = plain("AZ bY") == plain("az by")  # ids do not depend on the case of A-Z
        self.direct = self.folds and all(self._word(w.encode()) == self._pack(plain(w)) for w in words)
        self.splits = self.direct and all(plain(w + m) == plain(w) + plain(m) for w in words for m in _MARKS)
        runs = self.splits and self.by_piece and _splits_words(_steps(json.loads(t.to_str())["pre_tokenizer"], "pretokenizers"))
        self.runs = _RUNS if runs and all(plain(w + m) == plain(w) + plain(m) for w in words for m in ("###", "&&&", ".!!", *_RUNS.decode())) else b""

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def _word(self, word: bytes) -> bytes:
        shown = word.decode("latin-1")
        return self._pack([t.id for t in self.tokenize(shown if shown.isascii() else shown.translate(self.shown))])

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            s = piece.decode()
            if self.direct and s.isalpha() and (s.isascii() or max(s) < "\u0250") and s == s.lower():
                ids = self._word(piece)
            elif self.runs and (bare := piece.rstrip(self.runs)) != piece and bare and "a" <= (c := bare.decode()[-1]) < "\u0250" and c.isalpha() and c == c.lower():
                ids = self[bare] + self[piece[len(bare) :]]
            elif self.splits and len(s) > 1 and s[-1] in _MARKS and "a" <= s[-2] < "\u0250" and s[-2].isalpha() and s[-2] == s[-2].lower():
                ids = self[piece[:-1]] + self[piece[-1:]]
            else:
                ids = self._pack(self.tokenizer.encode(s, add_special_tokens=False).ids)
        self[piece] = ids
        return ids

    def __call__(self, texts: list[str | None], end_id: int) -> list[bytes]:
        end, out = np.array([end_id], self.dtype).tobytes(), []
        if not self.by_piece:
            return [np.array(x.ids, self.dtype).tobytes() + end for x in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        for t in texts:
            if len(self) > REMEMBERED:
                self.older = dict(self)
                self.clear()
            raw = t.encode() if t else b""
            low = raw.lower() if self.folds else raw
            if any(x in low for x in self.special):  # a special token's own case matters
                own = [self._pack(self.tokenizer.encode(p.decode(), add_special_tokens=False).ids) for p in raw.split()]
            else:
                own = map(self.__getitem__, low.split())
            out.append(b"".join(own) + end)
        return out


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _fs(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2) -> list[dict]:
    """Encode every text, in ascending order of doc_id (nulls first), into files under ``out``; return the manifest's parts.

    Documents are dealt by ranges of doc_id and sorted in their part, and each task writes its own
    part under a name of its own and then renames it, so a task that runs twice leaves one file.
    Only a row for each part reaches the driver, where a prefix sum gives every part its base.
    Null and empty texts are the end id alone. Rows with one doc_id are ordered by text. Ids that are no whole numbers are null. An empty table
    gives an empty list of parts. Extra columns are ignored.
    """
    def write(batches):
        encode, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        fs, root = _fs(out)
        name, own = f"{root}/part-{part:06d}", uuid.uuid4().hex
        ids, lengths = [], []
        stream = None
        for batch in batches:
            if stream is None:
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(f"{name}.{own}")
            ids.append(batch.column(0))
            column = batch.column(1)
            for at in range(0, len(column), 512):
                got = encode(column.slice(at, 512).to_pylist(), end_id)
                lengths.extend(len(g) // encode.dtype.itemsize for g in got)
                stream.write(b"".join(got))
        if stream is None:
            return
        stream.close()
        encode.older = {}  # the worker lives on, with the younger pieces
        ids = pa.chunked_array(ids)
        ends = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))])
        known = np.asarray(ids.is_valid()).astype(np.int64)
        index = np.concatenate([[len(lengths)], ends, np.asarray(ids.fill_null(0)).astype(np.int64), known]).astype("<i8")
        with fs.open_output_stream(f"{name}.{own}.idx") as f:
            f.write(index.tobytes())
        for end, tail in ((f".{own}", ".bin"), (f".{own}.idx", ".idx")):
            if fs.get_file_info(name + tail).type.name == "File":
                fs.delete_file(name + tail)
            fs.move(name + end, name + tail)
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(lengths)], "ids": [int(ends[-1])]}, schema=pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))

    dealt = small_batches(docs).select(F.col(doc_id).try_cast("long").alias("id"), F.col(text).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    rows = sorted(dealt.mapInArrow(write, "part int, docs long, ids long").collect())
    bases = np.concatenate([[0], np.cumsum([r.ids for r in rows])]).astype(np.int64)
    parts = [{"part": r.part, "docs": r.docs, "ids": r.ids, "base": int(b)} for r, b in zip(rows, bases)]
    fs, root = _fs(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dtype": _encoder(tokenizer_path).dtype.str, "end_id": end_id, "parts": parts}).encode())
    return parts


def open_part(out: str, part: int, dtype: str):
    """offsets, doc ids, which doc ids are there, and the ids: memory-mapped where the folder is local."""
    fs, root = _fs(out)
    name = f"{root}/part-{part:06d}"
    with fs.open_input_file(f"{name}.idx") as f:
        index = np.frombuffer(f.read(), "<i8")
    n = int(index[0])
    if fs.type_name == "local":
        ids = np.memmap(f"{name}.bin", dtype, "r") if os.path.getsize(f"{name}.bin") else np.empty(0, dtype)
    else:
        with fs.open_input_file(f"{name}.bin") as f:
            ids = np.frombuffer(f.read(), dtype)
    return index[1 : n + 2], index[n + 2 : 2 * n + 2], index[2 * n + 2 :].astype(bool), ids


def read_token_files(spark, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (as 32-bit ids): one row for each document."""
    fs, root = _fs(out)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = manifest["dtype"]

    def read(batches):
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                offsets, docs, known, ids = open_part(out, part, dtype)
                for at in range(0, len(docs), 10_000):
                    to = min(at + 10_000, len(docs))
                    crc = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(at, to)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[at:to], mask=~known[at:to]), pa.array(offsets[at:to] + base), pa.array(np.diff(offsets[at : to + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = [(p["part"], p["base"]) for p in manifest["parts"]]
    listed = spark.createDataFrame(parts, "part int, base long")
    return listed.repartition(max(1, len(parts))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Write token files into a new folder of the shared one, and read them back."""
    spark = docs.sparkSession
    out = new_path(spark, "tokens")
    write_token_files(docs, tokenizer_path, out, doc_id, text, end_id)
    return read_token_files(spark, out).withColumnRenamed("doc_id", doc_id)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
