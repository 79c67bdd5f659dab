"""Binary keypoint logs as a Spark data source that splits a log between tasks."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, frame_idx long, t_ref long, kp_idx int, x double, y double, score double, desc array<double>"
#: Bytes of a log that one task reads, and records that it decodes at once, at most so many bytes of them.
SPLIT, AT_ONCE = 64 << 20, 8 << 20


def log_types(k: int, d: int) -> tuple[np.dtype, np.dtype]:
    """Header and record of the fixed format: magic EKPR, then version, height, width (uint16), top and left offsets (int16), keypoints K and
    dimensions D (uint16); records of frame (uint32), t_ref (int64), valid keypoints (uint16), K (y, x) as int16, K scores and K x D values as float16."""
    head = np.dtype([("magic", "S4"), ("version", "<u2"), ("h", "<u2"), ("w", "<u2"), ("top", "<i2"), ("left", "<i2"), ("k", "<u2"), ("d", "<u2")])
    return head, np.dtype([("frame", "<u4"), ("t", "<i8"), ("n", "<u2"), ("yx", "<i2", (k, 2)), ("score", "<f2", (k,)), ("desc", "<f2", (k, d))])


def log_header(data: bytes) -> np.void:
    """The header at the start of a log; anything else is an error."""
    head = log_types(0, 0)[0]
    if len(data) < head.itemsize or data[:4] != b"EKPR":
        raise ValueError("not a keypoint log")
    return np.frombuffer(data, head, 1)[0]


def decoded(records: np.ndarray, header: np.void, path: str) -> pa.RecordBatch:
    """Rows of SCHEMA for the valid keypoints of some records."""
    k, d = int(header["k"]), int(header["d"])
    at, kp = np.nonzero(np.arange(k)[None, :] < np.minimum(records["n"], k)[:, None])
    yx = records["yx"][at, kp].astype(np.float64)
    desc = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * d, pa.int32()), pa.array(records["desc"][at, kp].astype(np.float64).ravel()))
    columns = [pa.array([path] * len(at), pa.string()), pa.array(records["frame"][at].astype(np.int64)), pa.array(records["t"][at].astype(np.int64)), pa.array(kp.astype(np.int32)),
               pa.array(yx[:, 1] + float(header["left"])), pa.array(yx[:, 0] + float(header["top"])), pa.array(records["score"][at, kp].astype(np.float64)), desc]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class ByteRange(InputPartition):
    """The records of a log that begin in [start, end)."""

    path: str
    start: int
    end: int


def _opened(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Logs under a folder, of a glob in its last part, or one log: their paths, with the scheme that was given, and sizes."""
    system, root = _opened(path)
    scheme = path[: len(path) - len(root)] if path.endswith(root) else ""
    folder, name = root.rsplit("/", 1) if "/" in root else (".", root)
    if any(c in name for c in "*?["):
        found = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and fnmatch.fnmatch(f.base_name, name)]
    else:
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
    return sorted((scheme + f.path, f.size) for f in found if not f.base_name.startswith(("_", ".")))


class KeypointLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[ByteRange]:
        """Ranges of about ``split`` bytes; where a record begins in them, its reader works out from the log's own header. A log too short for a header has one range, which fails."""
        out = [ByteRange(p, at, min(at + self.split, size)) for p, size in listed(self.path) for at in range(0, max(size, 1), self.split)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange):
        if not partition.path:
            return
        system, root = _opened(partition.path)
        with system.open_input_file(root) as f:
            header = log_header(f.read(log_types(0, 0)[0].itemsize))
            record = log_types(int(header["k"]), int(header["d"]))[1]
            first = log_types(0, 0)[0].itemsize
            # records whose first byte lies in the range; one that breaks off at the log's end is none
            lo = max(0, -(-(partition.start - first) // record.itemsize))
            hi = min(max(0, -(-(partition.end - first) // record.itemsize)), (f.size() - first) // record.itemsize)
            step = max(1, AT_ONCE // record.itemsize)
            for at in range(lo, hi, step):
                n = min(step, hi - at)
                f.seek(first + at * record.itemsize)
                yield decoded(np.frombuffer(f.read(n * record.itemsize), record, n), header, partition.path)


class KeypointLogs(DataSource):
    """spark.read.format("keypoint_log").option("split", bytes).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "keypoint_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KeypointLogReader:
        return KeypointLogReader(self.options)


def read_keypoint_logs(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """path, frame_idx, t_ref, kp_idx, x, y, score, desc of all logs under a folder, of a glob in its last part, or of one log.

    A log of any size is read by many tasks, each some of its records. A record that breaks off ends the log. A file that is no log is an error.
    Records without valid keypoints have no rows.
    """
    spark.dataSource.register(KeypointLogs)
    return spark.read.format("keypoint_log").option("split", str(split)).load(path)
